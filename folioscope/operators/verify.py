"""Checks of written items: quotes found in the source, figures traced to it, citations, segments."""

from pyspark.sql import functions as F

from ..functions import figures as fig
from ..functions import fixed_values as fv
from ..functions.arith import col, once, ratio
from ..functions.text import letters_and_digits
from .latest import top_n


def fragments(quote):
    """The normalized pieces of a quote between ellipses that are long enough to check."""
    parts = F.transform(F.split(col(quote), r"\.\.\.|…"), letters_and_digits)
    return F.filter(parts, lambda p: F.length(p) >= fv.MIN_FRAGMENT_CHARS)


def quote_in_source(quote, normalized_source):
    """Every fragment of a long enough quote is a substring of the normalized source."""
    pieces = fragments(quote)
    return (F.length(letters_and_digits(quote)) >= fv.MIN_QUOTE_CHARS) & (F.size(pieces) > 0) & F.forall(
        pieces, lambda p: F.contains(col(normalized_source), p))


GRAM = 7


def _words(text):
    return F.split(text, " ")


def _quote_key(fragment):
    """One key a source must have to contain the fragment.

    The outer words of a fragment may be parts of longer source words, the inner
    ones are whole: three inner words, else one inner word, else a 7-character
    piece of its longest word (a fragment has at least 15 characters).
    """
    w = _words(fragment)
    n = F.size(w)
    inner = F.slice(w, 2, F.greatest(n - 2, F.lit(0)))
    starts = F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1)))
    threes = F.transform(starts, lambda i: F.array_join(F.slice(inner, i, 3), " "))
    longest = F.array_max(F.transform(threes, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t
    one = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t
    piece = F.array_max(F.transform(w, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t
    return (F.when(n >= 5, F.concat(F.lit("3:"), longest)).when(n >= 3, F.concat(F.lit("1:"), one))
            .otherwise(F.concat(F.lit("g:"), F.substring(piece, 1, GRAM))))


# overlapping runs of three words, words, and the words long enough to cut into pieces
SHAPES = {"3": r"(?:^|(?<= ))(?=([a-z0-9]+ [a-z0-9]+ [a-z0-9]+))", "1": r"([a-z0-9]+)", "g": rf"(?=([a-z0-9]{{{GRAM}}}))"}


def _source_keys(text, kinds):
    """The keys of a normalized source text, of the wanted kinds (an array column)."""
    def keys(kind):
        found = F.regexp_extract_all(text, F.lit(SHAPES[kind]), F.lit(1))
        hashed = F.transform(found, lambda t: F.xxhash64(F.concat(F.lit(kind + ":"), t)))
        return F.when(F.array_contains(kinds, kind), hashed).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[keys(k) for k in sorted(SHAPES)])


def find_quotes(quotes, sources, quote="quote", text="text"):
    """(quote_id, source_id) of every quote found in some source, when the source is not known.

    Candidates meet on one key of the quote's longest fragment (an equi-join on
    hashes), then the real containment test runs on the pair.  Sources only emit
    kinds of keys the quotes use, which a subquery of the same plan tells.
    """
    longest = F.array_max(F.transform(fragments(quote), lambda f: F.struct(F.length(f).alias("n"), f.alias("f")))).f
    asked = once(quotes.select("quote_id", col(quote).alias("quote")), longest=longest).where(
        F.col("longest").isNotNull() & (F.length(letters_and_digits("quote")) >= fv.MIN_QUOTE_CHARS))
    asked = once(asked, word=_quote_key(F.col("longest"))).select(
        "quote_id", "quote", F.substring("word", 1, 1).alias("kind"), F.xxhash64("word").alias("key"))
    kinds = asked.select(F.collect_set("kind")).scalar()
    given = once(sources.select("source_id", col(text).alias("text")), norm=letters_and_digits("text")).drop("text")
    keys = given.select("source_id", F.explode_outer(_source_keys(F.col("norm"), kinds)).alias("key"))
    hits = keys.join(asked.select("quote_id", "key"), "key").select("source_id", "quote_id").distinct()
    pairs = hits.join(given, "source_id").join(asked.select("quote_id", "quote"), "quote_id")
    return pairs.where(quote_in_source("quote", "norm")).select("quote_id", "source_id")


def checked_items(items, sources, fields=("headline", "detail")):
    """Verification status of written items against their own source.

    ``items``: source_id, evidence and the text fields; ``sources``: source_id,
    text.  unverified: the quote is not there; verified: every figure is traced;
    partial otherwise.
    """
    given = once(sources.select("source_id", "text"), norm=letters_and_digits("text"), figures=fig.source_figures("text")).drop("text")
    rows = once(items, claims=F.concat(*[fig.claims(F.coalesce(F.col(f), F.lit(""))) for f in fields])).join(given, "source_id", "left")
    quoted = F.coalesce(quote_in_source("evidence", "norm"), F.lit(False))
    flagged = F.transform("claims", lambda c: F.struct(c.text.alias("text"), c.kind.alias("kind"), F.coalesce(
        fig.traced(c, F.col("figures")), F.lit(False)).alias("verified")))
    rows = once(rows, quote_found=quoted, figure_checks=flagged).drop("norm", "figures", "claims")
    every = F.forall("figure_checks", lambda c: c.verified)
    return rows.withColumn("status", F.when(~F.col("quote_found"), "unverified").when(every, "verified").otherwise("partial"))


def segment_check(segments, revenue, tolerance=0.05):
    """Positive segment values against reported revenue (A10)."""
    total = segments.groupBy("company_id").agg(F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("segments_total"))
    rows = total.join(revenue.select("company_id", "reported_revenue"), "company_id").where(
        (F.col("segments_total") != 0) & (F.col("reported_revenue") != 0))
    rows = rows.withColumn("difference", ratio("segments_total", "reported_revenue") - 1)
    return rows.withColumn("reconciles", F.abs("difference") <= tolerance)


def valid_points(points, refs):
    """Summary points that cite something they were given, with their valid references.

    ``points``: point_id, refs ARRAY; ``refs``: ref, ref_type, target.
    """
    cited = points.select("point_id", F.explode_outer(F.array_distinct("refs")).alias("ref"))
    ok = cited.join(refs, "ref").groupBy("point_id").agg(F.sort_array(F.collect_set("ref")).alias("valid_refs"))
    return points.join(ok, "point_id")


def enum_or(value, allowed, otherwise):
    """The value when it is one of the allowed ones, else the fallback."""
    return F.when(col(value).isin(allowed), col(value)).otherwise(otherwise)


def merged_items(items, limit):
    """Items of the latest filing first, no headline twice (any case), at most ``limit`` per company and list."""
    keys = ["company_id", "list_name"]
    first = items.groupBy(*keys, F.lower("headline").alias("_h")).agg(
        F.min_by(F.struct("headline", "item_id", "filing_rank", "position"), F.struct("filing_rank", "position", "item_id")).alias("i"))
    return top_n(first.select(*keys, "i.*"), keys, ["filing_rank", "position", "item_id"], limit, "rank")
