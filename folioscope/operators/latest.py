"""Picking one row per slot: the latest filed, the preferred, the nearest.

Every pick is an aggregate (``max_by``/``min_by``), not a window: each task keeps
one row per slot before the shuffle, so a slot or a company holding a third of
all rows adds no more than one row per task to the reducer.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arith import col


def pick(df, keys, order, largest=True, columns=None):
    """One whole row per key: the one with the largest (or smallest) ``order``."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    choose = F.max_by if largest else F.min_by
    best = choose(F.struct(*rest), F.struct(*[col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def latest_filed(df, slot, columns=None):
    """Restated values win: per slot the row of the latest filing, ties by fact id."""
    return pick(df, slot, ["filing_date", "fact_id"], columns=columns)


def preferred(df, slot, rank):
    """Per slot the row with the lowest preference rank (struct order)."""
    return pick(df, slot, rank, largest=False)


def top_n(df, keys, order, n, position="position"):
    """The first n rows per key.  Spark limits each task's group to n before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= n)


def year_earlier(rows, keys, end="period_end", target=365, slack=10, value_cols=("value",), suffix="_year_earlier"):
    """Each row with the row of the same keys that ended ``target`` days (±slack) earlier, nearest first.

    Both halves of the band are frames over the days of the key, so the work per
    key is a sort: the last row up to ``target`` days back and the first one from
    there, of which the nearer counts, on a tie the earlier.
    """
    day = F.unix_date(F.col(end))
    days = Window.partitionBy(*keys).orderBy("_day")
    base = F.struct(F.col(end).alias("end"), *[F.col(c).alias(c) for c in value_cols])
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, end]])
    seen = rows.withColumn("_day", day).withColumns({
        "_far": F.last(base).over(days.rangeBetween(-target - slack, -target)),
        "_near": F.first(base).over(days.rangeBetween(-target, slack - target))})
    nearer = F.datediff(F.col(end), "_near.end") - target
    far = F.col("_far").isNotNull() & (F.col("_near").isNull() | (F.datediff(F.col(end), "_far.end") - target <= -nearer))
    best = F.when(known, F.when(far, F.col("_far")).otherwise(F.col("_near")))
    return seen.withColumn("_base", best).select(
        *rows.columns, F.col("_base.end").alias(end + suffix), *[F.col(f"_base.{c}").alias(c + suffix) for c in value_cols])


def as_of_base(df, base, keys, at="period_end", base_at="period_end", columns=("value",), prefix="base_"):
    """The latest base row strictly before each row's date, per key.

    Both sides are put on one time line per key and the last base seen is carried
    forward, so the work per key is a sort, never a product.  ``base`` is first
    reduced to one row per (key, date).
    """
    packed = F.struct(F.col(base_at).alias("at"), *[F.col(c).alias(c) for c in columns])
    points = base.groupBy(*keys, base_at).agg(F.max(packed).alias("_base"))
    points = points.select(*keys, F.col(base_at).alias("_t"), F.lit(1).alias("_side"), "_base", F.lit(None).alias("_row"))
    dates = df.select(*keys, F.col(at).alias("_t")).distinct().select(
        *keys, "_t", F.lit(0).alias("_side"), F.lit(None).cast(points.schema["_base"].dataType).alias("_base"),
        F.lit(True).alias("_row"))
    line = points.withColumn("_row", F.lit(False)).unionByName(dates)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumn("_base", F.last("_base", ignorenulls=True).over(w)).where("_row")
    found = seen.select(*keys, F.col("_t").alias(at), F.col("_base.at").alias(prefix + base_at),
                        *[F.col(f"_base.{c}").alias(prefix + c) for c in columns])
    return df.join(found, [*keys, at], "left")
