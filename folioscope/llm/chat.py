"""Chat formatting: logged snapshots of growing conversations are collapsed, the maximal ones are rendered.

A log often holds a conversation several times, each snapshot with a few turns
more.  Each turn gets the hash of all turns up to it: the exclusive or of the
hashes of (position, role, text) over a running window, twice 64 bits, so that
a turn costs the same however many stand before it.  Prefixes of equal length
and hash are combined before they are shuffled; a conversation whose whole
hash is a prefix of a longer one, or that of an equal one with a lesser id, is
a snapshot, and an anti-join takes it out before any text is gathered.

Turns are ordered by turn, then role, then hash; nulls come first.  Rows that
repeat a turn exactly are one turn.  Rows without a conversation id form one
conversation whose id is null; a null role or text differs from an empty one
and is rendered as empty.  Equal conversations leave the one with the least
id.  An empty table gives an empty table; columns that are not named are not
read.  A rendered conversation is one string, so it must fit into one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

#: What stands before and after each turn.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def hashed(turns, conv="conv_id", turn="turn", role="role", text="text"):
    """Different turns without their texts: conv, turn, role, a, b (two hashes of role and text)."""
    parts = [F.col(role).isNull(), F.col(role), F.col(text).isNull(), F.col(text)]
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b")).distinct()


def prefixes(marks):
    """conv, n (turns), place, x and y: the hash of the turns up to each place."""
    by = Window.partitionBy("conv")
    order = by.orderBy("turn", "role", "a", "b")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.withColumn("place", F.row_number().over(order))
    return placed.select(
        "conv", "place", F.count("*").over(by).alias("n"),
        F.bit_xor(F.xxhash64("place", "a", "b")).over(so_far).alias("x"),
        F.bit_xor(F.xxhash64("b", "place", "a")).over(so_far).alias("y"))


def snapshots(marks):
    """conv of every conversation that a longer one begins with, or an equal one of lesser id repeats."""
    known = prefixes(marks)
    best = known.groupBy("place", "x", "y").agg(
        F.max("n").alias("longest"), F.min(F.when(F.col("n") == F.col("place"), F.col("conv"))).alias("first"))
    whole = known.where("n = place")
    return whole.join(best, ["place", "x", "y"]).where(
        (F.col("longest") > F.col("n")) | ~F.col("first").eqNullSafe(F.col("conv"))).select(F.col("conv").alias("gone"))


def maximal(turns, conv="conv_id", turn="turn", role="role", text="text"):
    """The turns of conversations that are no snapshot of another."""
    gone = snapshots(hashed(turns, conv, turn, role, text))
    return turns.join(gone, F.col(conv).eqNullSafe(F.col("gone")), "left_anti")


def rendered(turns, conv="conv_id", turn="turn", role="role", text="text", begin=BEGIN, middle=MIDDLE, end=END):
    """conv, n_turns and chat: one string a conversation."""
    parts = [F.col(role).isNull(), F.col(role), F.col(text).isNull(), F.col(text)]
    row = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.xxhash64(*parts).alias("a"),
                   F.xxhash64(F.lit("second"), *parts).alias("b"), F.col(text).alias("text"))
    each = F.transform("turns", lambda t: F.concat(
        F.lit(begin), F.coalesce(t["role"], F.lit("")), F.lit(middle), F.coalesce(t["text"], F.lit("")), F.lit(end)))
    gathered = turns.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_set(row)).alias("turns"))
    return gathered.select("conv", F.size("turns").cast("long").alias("n_turns"), F.array_join(each, "").alias("chat"))


def formatted(turns, conv="conv_id", turn="turn", role="role", text="text"):
    """Maximal conversations as chat strings: conv, n_turns, chat."""
    return rendered(maximal(turns, conv, turn, role, text), conv, turn, role, text)
