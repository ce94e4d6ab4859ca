"""Null-aware arithmetic: a missing or zero denominator gives NULL, never an error."""

from functools import reduce

from pyspark.sql import functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b):
    return F.try_divide(col(a), col(b))


def growth(current, prior):
    """Relative change against the size of the prior value."""
    return F.try_divide(col(current) - col(prior), F.abs(col(prior)))


def sum_present(*cols):
    """Sum of the values that are there; NULL when none is."""
    cols = [col(c) for c in cols]
    total = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(F.coalesce(*cols).isNotNull(), total)


def literal_map(mapping):
    """A constant lookup table as a MAP column (small by construction)."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping, key, default=None):
    """``mapping[key]`` as a Column, NULL (or the default) when the key is unknown."""
    found = F.try_element_at(literal_map(mapping), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def value_rounded(c, digits):
    """Half-even rounding of the printed decimal value, as the JVM's BigDecimal prints it."""
    return F.bround(col(c), digits)


def once(df, **columns):
    """Adds costly columns so that each is computed exactly once per row.

    A plain projection can be repeated: filters on it (also the NOT NULL filters
    inferred for joins and explodes) are pushed below it with the expression
    copied.  The output of a generator is not copied.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def gather(df, *keys):
    """One shuffle by ``keys``; adaptive execution chooses the number of tasks."""
    return df.repartition(*keys)


def bound(value, use):
    """``use`` of a value that is computed once however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items, state, step, out_type):
    """The outputs of a left fold over an array, in order, as one array.

    ``step(state, item)`` gives the next state (named as in ``state``) and an
    array of outputs.  An array is copied whenever it is appended to, so outputs
    are appended block by block: with blocks of the square root of the length, an
    array of a million items costs a thousandth of what one growing array would.
    """
    none = F.array().cast(f"array<{out_type}>")

    def one(acc, item):
        after, outputs = step(acc.state, item)
        return F.struct(after.alias("state"), F.concat(acc.out, outputs).alias("out"))

    def over(x):
        def block(acc, start):
            inner = F.aggregate(F.slice(x["items"], start, x["size"]), F.struct(acc.state.alias("state"), none.alias("out")), one)
            return bound(inner, lambda y: F.struct(y.state.alias("state"), F.concat(acc.out, F.array(y.out)).alias("out")))

        starts = F.filter(F.sequence(F.lit(1), F.greatest(x["n"], F.lit(1)), x["size"]), lambda i: i <= x["n"])
        blocks = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
        return F.aggregate(starts, blocks, block, lambda acc: F.struct(acc.state.alias("state"), F.flatten(acc.out).alias("out")))

    sized = bound(items, lambda i: F.struct(i.alias("items"), F.size(i).alias("n"), F.greatest(F.ceil(F.sqrt(F.size(i))), F.lit(1)).cast("int").alias("size")))
    return bound(sized, over)
