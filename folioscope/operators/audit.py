"""Which material items a written summary leaves out, and the reconciliation of decisions about them."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arith import once
from .latest import top_n

# FIXED VALUES: omission check.
MUST_REVIEW = ["subsequent_event", "new_guarantee", "new_financing", "hypothetical_to_realized"]
DECISIONS = ["covered", "add", "not_material"]
SEVERE_WEIGHT, MAX_CHANGES, MAX_LANGUAGE = 0.6, 12, 6


def covered_changes(changes, points):
    """Top or flagged changes with the headlines of all summary points that cite them, by id or by label.

    ``points``: company_id, position, headline, refs ARRAY of change ids or
    lower-case labels.  Headlines come once each, those by id first, in the order
    of the points; NULL where there is none.
    """
    flagged = changes.where((F.col("tier") == "top") | F.arrays_overlap("flags", F.array(*map(F.lit, MUST_REVIEW))))
    cited = points.select("company_id", "position", "headline", F.explode("refs").alias("ref"))
    keys = flagged.select("company_id", "change_id", F.posexplode(F.array("change_id", F.lower("label"))).alias("way", "ref"))
    found = F.array_sort(F.collect_list(F.struct("way", "position", "headline")))
    by = keys.join(cited, ["company_id", "ref"]).groupBy("company_id", "change_id").agg(
        F.array_distinct(F.transform(found, lambda f: f["headline"])).alias("covered_by"))
    return flagged.join(by, ["company_id", "change_id"], "left")


def severe_sentences(sections, key="company_id", order="section_order"):
    """Sentences saying a serious event has happened, the first one per company and phrase."""
    rows = sections.where(F.col("text").rlike(T.ANY_TRIGGER)).select(key, order, F.posexplode_outer(T.sentences("text")).alias("pos", "sentence"))
    told = rows.where(F.col("sentence").rlike(T.ANY_TRIGGER) & ~F.col("sentence").rlike(T.NEGATION)
                      & T.says_realized(F.col("sentence")) & ~T.says_hypothetical(F.col("sentence")))
    marked = T.with_triggers(told, "sentence").select("*", F.explode_outer("triggers").alias("t")).where(
        F.col("t.realized") & (F.col("t.weight") >= SEVERE_WEIGHT))
    first = F.min_by(F.struct("sentence", "t.weight", order, "pos"), F.struct(order, "pos"))
    return marked.groupBy(key, F.col("t.phrase").alias("phrase")).agg(first.alias("s")).select(key, "phrase", "s.*")


def word_stems(text):
    """The first six letters of each word of five letters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{5,}"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 6)))


def covered_language(sentences, points, key="company_id"):
    """Severe sentences with whether the company's summary names their phrase: all its stems occur in the points (C14).

    Phrases meet summaries by stem: an index of the stems of each company's
    points, one row a stem, is asked for the stems of its phrases, so the work
    grows with the stems and not with phrases times summaries.  ``points``:
    company_id, headline, detail.
    """
    said = F.concat_ws(" ", "headline", "detail")
    index = points.select(key, F.explode(word_stems(said)).alias("stem")).distinct().withColumn("_said", F.lit(True))
    asked = sentences.select(key, "phrase", F.explode_outer(word_stems(F.col("phrase"))).alias("stem"))
    missing = asked.where(F.col("stem").isNotNull()).join(index, [key, "stem"], "left").groupBy(key, "phrase").agg(
        F.max(F.col("_said").isNull()).alias("_missing"))
    rows = sentences.join(missing, [key, "phrase"], "left")
    covered = F.when(~F.coalesce("_missing", F.lit(False)), F.array(F.lit("(summary wording)")))
    return rows.withColumn("covered_by", covered).withColumn("item_id", F.substring(F.sha1("sentence"), 1, 16)).drop("_missing")


def audit_items(candidates, keys=("company_id",)):
    """All covered candidates, and the first uncovered ones per kind.

    ``candidates``: company_id, kind ('change' or 'language'), item_id, score, covered_by.
    """
    open_ = candidates.where(F.col("covered_by").isNull())
    limits = [(kind, n) for kind, n in (("change", MAX_CHANGES), ("language", MAX_LANGUAGE))]
    out = candidates.where(F.col("covered_by").isNotNull())
    for kind, n in limits:
        out = out.unionByName(top_n(open_.where(F.col("kind") == kind), list(keys), [F.desc("score"), F.col("item_id")], n, "_n").drop("_n"))
    return out


def reconciled(items, decisions, points):
    """Each audited item with its final decision; unknown or unsupported ones are unresolved.

    ``decisions``: item_id, decision, covered_point; the first per item counts.
    """
    first = decisions.groupBy("item_id").agg(F.min_by(F.struct("decision", "covered_point"), "position").alias("d"))
    names = points.select(F.col("point_id").alias("covered_point"), F.col("headline").alias("_headline"))
    rows = items.join(first.select("item_id", "d.*"), "item_id", "left").join(names, "covered_point", "left")
    decision = F.when(F.col("covered_by").isNotNull(), "covered").when(
        (F.col("decision") == "covered") & F.col("_headline").isNull(), "unresolved").when(
        F.col("decision").isin(DECISIONS), F.col("decision")).otherwise("unresolved")
    out = once(rows, final=decision).drop("decision").withColumnRenamed("final", "decision")
    return out.withColumn("covered_by", F.coalesce("covered_by", F.when(F.col("decision") == "covered", F.array("_headline")))).drop("_headline")


def decision_counts(rows, keys=("company_id",)):
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("checked"), *[
        F.sum((F.col("decision") == d).cast("long")).alias(d) for d in (*DECISIONS, "unresolved")])
