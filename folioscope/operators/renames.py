"""Following a disclosed line when its key changes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.arith import ratio
from ..session import checkpointed


def _one_to_one(pairs):
    """Pairs whose old key has one new key and whose new key has one old key."""
    news = pairs.groupBy("company_id", "old_key").agg(F.min("new_key").alias("new_key"), F.max("new_key").alias("_max")).where(
        F.col("new_key") == F.col("_max")).drop("_max")
    olds = pairs.groupBy("company_id", "new_key").agg(F.min("old_key").alias("old_key"), F.max("old_key").alias("_max")).where(
        F.col("old_key") == F.col("_max")).drop("_max")
    return news.join(olds, ["company_id", "old_key", "new_key"])


def bridged_by_value(facts):
    """Renames shown by a comparative: a filing repeats, under a key the older filing never used, exactly the value
    the older filing reported for that period under a key this filing never uses (J3)."""
    at = ["company_id", "category", "period_end", "value"]
    new = facts.where(F.col("is_comparative") & F.col("canonical_metric").isNull() & (F.col("value") != 0)).select(
        *at, "period_start", "currency", F.col("fact_key").alias("new_key"), F.col("filing_id").alias("new_filing"),
        F.col("filing_date").alias("new_date"))
    old = facts.where(~F.col("is_comparative")).select(
        *at, F.col("period_start").alias("_start"), F.col("currency").alias("_currency"), F.col("fact_key").alias("old_key"),
        F.col("filing_id").alias("old_filing"), F.col("filing_date").alias("old_date"))
    pairs = new.join(old, at).where(
        F.col("period_start").eqNullSafe(F.col("_start")) & F.col("currency").eqNullSafe(F.col("_currency"))
        & (F.col("old_key") != F.col("new_key")) & (F.col("old_date") < F.col("new_date")))
    used = facts.select("filing_id", "fact_key").distinct()
    pairs = pairs.join(used.select(F.col("filing_id").alias("old_filing"), F.col("fact_key").alias("new_key")), ["old_filing", "new_key"], "left_anti")
    pairs = pairs.join(used.select(F.col("filing_id").alias("new_filing"), F.col("fact_key").alias("old_key")), ["new_filing", "old_key"], "left_anti")
    return _one_to_one(pairs.select("company_id", "old_key", "new_key").distinct()).withColumn("method", F.lit("comparative_period"))


def _words(key):
    return F.array_except(F.array_distinct(F.split(F.substring_index(key, ".", -1), "_")), F.array(*map(F.lit, ["member", "and", "of", "the"])))


def bridged_by_words(facts, filings):
    """Renames by dropped or added words: a line stops in one filing, one whose name nests in it starts in the next."""
    rows = facts.where(F.col("canonical_metric").isNull() & F.col("fact_key").rlike(r"\..*\."))
    own = F.when(~F.col("is_comparative"), F.struct("period_end", "value"))
    spans = rows.groupBy("company_id", "fact_key", "category", "xbrl_concept").agg(
        F.min("filing_date").alias("first_filed"), F.max("filing_date").alias("last_filed"),
        F.min(own).alias("first_own"), F.max(own).alias("last_own"))
    dates = filings.where(~F.col("form_type").endswith("/A")).select("company_id", "filing_date").distinct()
    following = dates.withColumn("next_date", F.lead("filing_date").over(Window.partitionBy("company_id").orderBy("filing_date")))
    old = spans.join(following.select("company_id", F.col("filing_date").alias("last_filed"), "next_date"), ["company_id", "last_filed"]).select(
        "company_id", "category", "xbrl_concept", F.col("next_date").alias("first_filed"), F.col("fact_key").alias("old_key"),
        F.col("last_own.value").alias("old_value"), _stem("fact_key").alias("stem"))
    new = spans.select("company_id", "category", "xbrl_concept", "first_filed", F.col("fact_key").alias("new_key"),
                       F.col("first_own.value").alias("new_value"), _stem("fact_key").alias("stem"))
    pairs = old.join(new, ["company_id", "category", "xbrl_concept", "first_filed", "stem"])
    a, b = _words(F.col("old_key")), _words(F.col("new_key"))
    shared = F.size(F.array_intersect(a, b))
    nested = ((shared == F.size(a)) | (shared == F.size(b))) & ~((shared == F.size(a)) & (shared == F.size(b)))
    specific = F.size(F.array_except(F.array_intersect(a, b), F.array(*map(F.lit, fv.RENAME_GENERIC_WORDS)))) > 0
    fits = (F.col("old_value") != 0) & (F.col("new_value") != 0) & ratio("new_value", "old_value").between(*fv.RENAME_VALUE_RATIO)
    kept = pairs.where(nested & specific & fits).select("company_id", "old_key", "new_key")
    counted = kept.groupBy("company_id", "old_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n")
    counted_new = kept.groupBy("company_id", "new_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n")
    return kept.join(counted, ["company_id", "old_key"]).join(counted_new, ["company_id", "new_key"]).withColumn("method", F.lit("dropped_words"))


def _stem(key):
    """Everything before the last dotted part."""
    return F.regexp_replace(key, r"\.[^.]*$", "")


def renamed_lines(facts, filings):
    """Both kinds of renames; a line linked by value is not linked again by words."""
    by_value = bridged_by_value(facts)
    linked = by_value.select("company_id", F.explode(F.array("old_key", "new_key")).alias("k")).distinct()
    by_words = bridged_by_words(facts, filings)
    for side in ("old_key", "new_key"):
        by_words = by_words.join(linked.withColumnRenamed("k", side), ["company_id", side], "left_anti")
    return by_value.unionByName(by_words)


def _followed(edges, rounds):
    """Where each key stands after 2 ** ``rounds`` links, or at the end of its chain: company_id, old_key, key.  Each round doubles the reach."""
    at = edges.select("company_id", "old_key", F.col("new_key").alias("key"))
    for _ in range(rounds):
        ahead = at.select("company_id", F.col("old_key").alias("key"), F.col("key").alias("_on"))
        both = checkpointed(at.join(ahead, ["company_id", "key"], "left"))
        at = both.select("company_id", "old_key", F.coalesce("_on", "key").alias("key"))
        if both.where("_on IS NOT NULL").isEmpty():
            break
    return at


def newest_keys(links):
    """old key -> newest key along chains of renames.

    Pointers are doubled: after as many rounds as the number of a company's
    links has binary digits every key is at the end of its chain, or on a
    cycle.  A key that comes to a cycle goes round it once, so its newest key is
    the one before the key at which it came to it.
    """
    edges = checkpointed(links.groupBy("company_id", "old_key").agg(F.min("new_key").alias("new_key")))
    longest = edges.groupBy("company_id").count().agg(F.max("count")).first()[0] or 0
    rounds = longest.bit_length()
    at = checkpointed(_followed(edges, rounds))
    # what still has a link after that many steps is on a cycle
    going = edges.select("company_id", F.col("old_key").alias("key"))
    circling = checkpointed(at.join(going, ["company_id", "key"], "left_semi"))
    ended = at.join(going, ["company_id", "key"], "left_anti").select("company_id", "old_key", F.col("key").alias("newest_key"))
    cycle = checkpointed(circling.select("company_id", "key").distinct())
    if cycle.isEmpty():
        return ended
    # the way to a cycle ends at its first key on it
    on = cycle.select("company_id", F.col("key").alias("old_key"))
    towards = edges.join(circling.select("company_id", "old_key"), ["company_id", "old_key"], "left_semi").join(on, ["company_id", "old_key"], "left_anti")
    entry = _followed(towards, rounds).unionByName(on.withColumn("key", F.col("old_key")))
    before = edges.join(on, ["company_id", "old_key"], "left_semi").select("company_id", F.col("new_key").alias("key"), F.col("old_key").alias("newest_key"))
    round_ = entry.join(before, ["company_id", "key"]).select("company_id", "old_key", "newest_key")
    return ended.unionByName(round_)
