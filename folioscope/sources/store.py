"""Stored tables: replaceable by filing, read with versions, written without gathering anything on the driver."""

from pyspark.sql import functions as F

from ..operators.filings import replace_filings

BUCKETS = 512


def bucket(key="company_id", buckets=BUCKETS):
    """The storage partition of a company: a bounded number of folders whatever the number of companies."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_table(df, path, buckets=BUCKETS):
    """Writes a table laid out by company bucket."""
    out = df.withColumn("bucket", bucket(buckets=buckets))
    out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def replace_in_table(spark, path, new, key="filing_id", buckets=BUCKETS):
    """A re-read filing (or a re-scored company) replaces all its rows; only the buckets it touches are rewritten.

    Dynamic partition overwrite stages the new files and swaps them at commit, so
    a lost executor or a repeated batch leaves the table whole.
    """
    fresh = new.withColumn("bucket", bucket(buckets=buckets))
    old = spark.read.parquet(path)
    touched = old.join(fresh.select("bucket").distinct(), "bucket", "left_semi")
    merged = replace_filings(touched, fresh, key)
    merged.select(*old.columns).repartition("bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def facts_read_model(facts, filings):
    """Facts with their filing and first source."""
    cols = ["filing_id", "accession_number", "form_type", "filing_date", "is_annual"]
    return facts.where(F.col("value").isNotNull()).join(filings.select(*[c for c in cols if c in filings.columns]), "filing_id").withColumn(
        "source", F.try_element_at("sources", F.lit(1))).drop("sources")


def sections_read_model(sections, filings, categories):
    """Retained section texts of some categories."""
    kept = sections.where(F.col("text").isNotNull() & F.col("category").isin(list(categories)))
    return kept.join(filings.select("filing_id", "company_id"), "filing_id")


def resolve_sections(sections, facts):
    """Natural ids for sections and the facts that point at them."""
    def ident(filing, ref):
        return F.sha1(F.concat_ws("|", filing, ref))

    out = sections.withColumn("section_id", ident("filing_id", "ref")).withColumn(
        "parent_id", F.when(F.col("parent_ref").isNotNull(), ident("filing_id", "parent_ref")))
    known = out.select("filing_id", F.col("ref").alias("section_ref"), "section_id")
    return out, facts.join(known, ["filing_id", "section_ref"], "left")


def with_status(facts, changes):
    """The disclosure status and score of the facts that were compared."""
    status = changes.where(F.col("fact_id").isNotNull()).select("company_id", "fact_id", F.col("change_type").alias("_status"), F.col("score").alias("_score"))
    return facts.join(status, ["company_id", "fact_id"], "left").withColumn(
        "disclosure_status", F.coalesce("_status", F.col("disclosure_status"))).withColumn(
        "materiality_score", F.coalesce("_score", F.col("materiality_score"))).drop("_status", "_score")


def merge_companion(facts, companions):
    """A companion filing's facts under its annual report, with prefixed ids."""
    linked = facts.join(companions.select(F.col("filing_id"), F.col("annual_filing_id")).distinct(), "filing_id")
    moved = linked.withColumn("element_id", F.concat_ws(":", F.col("filing_id").cast("string"), "element_id")).withColumn(
        "text_block_id", F.when(F.col("text_block_id").isNotNull(), F.concat_ws(":", F.col("filing_id").cast("string"), "text_block_id"))).withColumn(
        "filing_id", F.col("annual_filing_id")).drop("annual_filing_id")
    rest = facts.join(companions.select("filing_id").distinct(), "filing_id", "left_anti")
    return rest.unionByName(moved.select(*rest.columns))
