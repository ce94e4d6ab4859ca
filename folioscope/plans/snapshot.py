"""One document per company, kept up to date part by part.

A part is a long table (a statement's cells, capital items, groups of changes),
bounded for each company by its own row limits, packed into one JSON payload.
The stored table has a row for each company and part, in buckets of companies.
When filings arrive, they replace their rows in the stored inputs, and only the
parts of the companies they touch are built again, from the buckets these lie in;
dynamic overwrite puts them in place.  What is stored is a function of the
inputs alone, so batches may come in any order, again, or all at once.
"""

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.periods import fiscal_label
from ..operators import grouping
from ..operators import numeric_changes as nc
from ..operators.filings import report_bases
from ..session import checkpointed, stored
from ..sources.store import bucket, replace_in_table, write_table
from . import metrics, views

#: Raised when the shape or meaning of a part changes; parts of another version are built again.
SNAPSHOT_VERSION = 1
HALF_YEARLY = "half_yearly"


class Inputs:
    """A set of companies' filings and facts with what several parts are made of, each computed once.

    ``aliases``: company_id, old_key, newest_key, or None.
    """

    def __init__(self, filings, facts, aliases=None):
        self.read_filings, self.read_facts, self.aliases = filings, facts, aliases

    def _rows(self):
        return metrics.column_table(self.read_facts, self.read_filings)

    @cached_property
    def rows(self):
        """The wide rows by the tagged periods, with each company's profile."""
        return stored(self._rows())

    @cached_property
    def profile(self):
        # where no part has asked for the wide rows yet, only the few columns a profile reads are made
        return checkpointed(metrics.company_profile(self.rows if "rows" in vars(self) else self._rows()))

    def _half_yearly(self):
        return self.profile.where(F.col("interim_kind") == HALF_YEARLY).select("company_id", F.lit(True).alias("_half"))

    @cached_property
    def facts(self):
        """Facts with the second quarter of half-yearly companies read as the first half."""
        rows = self.read_facts.join(self._half_yearly(), "company_id", "left")
        label = views.half_year_label(F.col("_half"))
        return stored(rows.withColumn("fiscal_period", label).drop("_half"))

    @cached_property
    def filings(self):
        rows = self.read_filings.join(self._half_yearly(), "company_id", "left")
        half = F.col("_half") & ~F.col("is_annual") & (F.col("fiscal_period") == "Q2")
        return checkpointed(rows.withColumn("fiscal_period", F.when(half, "H1").otherwise(F.col("fiscal_period"))).drop("_half"))

    @cached_property
    def bases(self):
        return checkpointed(report_bases(self.filings))

    @cached_property
    def anchors(self):
        return checkpointed(nc.anchors(self.rows, self.facts))

    @cached_property
    def changes(self):
        """Scored numbers and ratios; a ratio that the company reports itself replaces the computed one."""
        # read twice below: stored, so that all lines are compared once
        numbers = stored(nc.without_bank_routine(nc.score_numeric(nc.numeric_changes(self.facts, self.filings, self.aliases, self.bases), self.anchors)))
        ratios = nc.score_numeric(nc.without_reported_ratios(nc.derived_changes(self.rows, self.bases), numbers), self.anchors)
        both = numbers.unionByName(ratios, allowMissingColumns=True).where(F.col("change_type") != "repeated")
        text = F.lit(None).cast("string")
        return checkpointed(both.withColumns({"change_id": F.concat_ws("|", "fact_key", "period_type"), "text": text}))

    @cached_property
    def groups(self):
        revenue = self.profile.select("company_id", F.col("anchor_revenue").alias("revenue"))
        return checkpointed(grouping.grouped(self.changes, revenue))


def _label():
    return fiscal_label(F.col("fiscal_year"), F.col("fiscal_period")).alias("label")


def _filings(x):
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("filing_date"), F.desc("filing_id")))
    return x.filings.select("company_id", place.alias("place"), "filing_id", "form_type", F.col("filing_date").cast("string").alias("filing_date"),
                            F.col("period_end").cast("string").alias("period_end"), _label(), "is_annual")


def _company(x):
    reports = x.bases.select("company_id", F.col("latest.filing_id").alias("latest_filing"), F.col("annual.filing_id").alias("base_annual"),
                             F.col("previous.filing_id").alias("previous_filing"))
    note = views.interim_note(x.profile, x.filings).select("company_id", F.col("note").alias("interim_note"))
    return reports.join(x.profile, "company_id", "left").join(note, "company_id", "left").select(
        "company_id", "latest_filing", "previous_filing", "base_annual", "latest_year", "is_bank", "interim_kind", "interim_note")


def _table(kind):
    def build(x):
        both = [metrics.financial_table(x.rows, kind, p).withColumn("profile", F.lit(p)) for p in ("general", "bank")]
        return both[0].unionByName(both[1]).select("company_id", "row_order", "age", "profile", "row_key", "row_group", "unit", "fiscal_year", "fiscal_period",
                                                   _label(), "value")
    return build


def _breakdowns(x):
    kinds = [views.useful_breakdowns(views.breakdown_view(x.facts, x.rows, kind=k)).withColumn("view", F.lit(k)) for k in ("annual", "quarterly")]
    return kinds[0].unionByName(kinds[1]).select("company_id", "view", "family", "place", "fiscal_year", "fiscal_period", "fact_key", "label", "metric", "value",
                                                 "prior_value", "growth", "share_of_revenue")


def _capital(x):
    items = views.capital_items(views.sectioned(x.facts, x.aliases), views.capital_context(x.filings))
    return views.capital_sections(items).select("company_id", "section", "place", "line_key", "period_type", "label", "period_label", "value", "prior_value",
                                                "annual_value", "change_vs_prior", "is_new", "more")


def _bridges(x):
    """The way from revenue or operating income to net income in the latest year and interim period, with its one-off items."""
    latest = [metrics.table_columns(x.rows, k).where("age = 1").withColumn("view", F.lit(k)) for k in ("annual", "quarterly")]
    shown = latest[0].unionByName(latest[1])
    at = shown.select("company_id", "fiscal_year", "period", "view", "is_bank")
    steps = ["operating_income", "non_operating", "revenue", "net_interest_income", "noninterest_income", "credit_loss_expense", "operating_expenses",
             "pretax_income", "income_tax", "other_items", "net_income"]
    general, bank = metrics.earnings_bridge(shown.where("NOT is_bank")), metrics.bank_bridge(shown.where("is_bank"))
    both = general.unionByName(bank, allowMissingColumns=True)
    items = views.one_off_items(x.facts).groupBy("company_id", "fiscal_year", F.col("fiscal_period").alias("period")).agg(
        F.sort_array(F.collect_list(F.struct("place", "fact_key", "category", "value"))).alias("items"))
    keys = ["company_id", "fiscal_year", "period"]
    return at.join(both, keys).join(items, keys, "left").select("company_id", "view", "fiscal_year", "period", "is_bank", *steps, "items")


def _changes(x):
    """Shown groups of changes, each with its lead and the changes folded into it."""
    columns = ["kind", "category", "change_type", "label", "comparison", "value", "base_value", "annual_value", "change", "unit", "currency", "period_label",
               "base_period_label", "flags"]
    rows = x.groups.join(x.changes.select("company_id", "change_id", *columns), ["company_id", "change_id"])
    shown = grouping.shown_groups(rows)
    related = rows.where("change_id <> group_id").groupBy("company_id", "group_id").agg(
        F.sort_array(F.collect_list(F.struct("change_id", "label", "value"))).alias("related"))
    return shown.join(related, ["company_id", "group_id"], "left").select(
        "company_id", "group_place", F.col("group_id").alias("change_id"), F.col("group_score").alias("score"), F.col("group_tier").alias("tier"),
        F.col("group_reasons").alias("reasons"), *columns, "members", "related")


def _counts(x):
    return grouping.group_counts(x.groups)


#: How each part's rows are built; they stand in the order of their first columns.
PARTS = {"company": _company, "filings": _filings, "annual": _table("annual"), "interim": _table("quarterly"), "breakdowns": _breakdowns,
         "capital": _capital, "bridges": _bridges, "changes": _changes, "change_counts": _counts}


def part_rows(inputs, name):
    """One part as a long table: company_id and the part's columns."""
    return PARTS[name](inputs)


def packed(rows, name):
    """A part's rows as one JSON payload for each company."""
    columns = [c for c in rows.columns if c != "company_id"]
    payload = F.to_json(F.sort_array(F.collect_list(F.struct(*columns))))
    return rows.groupBy("company_id").agg(payload.alias("payload")).select(
        "company_id", F.lit(name).alias("part"), F.lit(SNAPSHOT_VERSION).alias("snapshot_version"), "payload")


def parts_table(inputs, names=None):
    """All parts of all companies: company_id, part, snapshot_version, payload."""
    out = None
    if set(names or PARTS) - {"company", "filings", "capital"}:
        inputs.rows  # made before the profile, which then reads them
    for name in names or PARTS:
        rows = packed(part_rows(inputs, name), name)
        out = rows if out is None else out.unionByName(rows)
    return out


def documents(parts, version=SNAPSHOT_VERSION):
    """One JSON object for each company from its stored parts of the current version."""
    current = parts.where(F.col("snapshot_version") == version)
    entry = F.concat(F.lit('"'), F.col("part"), F.lit('":'), F.col("payload"))
    whole = F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}"))
    return current.groupBy("company_id").agg(whole.alias("document"))


def unpacked(parts, name, schema):
    """The rows of a stored part again; ``schema`` as of its columns."""
    rows = parts.where((F.col("part") == name) & (F.col("snapshot_version") == SNAPSHOT_VERSION))
    return rows.select("company_id", F.inline(F.from_json("payload", f"array<struct<{schema}>>")))


def reports_of(filings, facts, arrived_at):
    """Filings as they arrive and are stored: each with its facts, which one document bounds."""
    columns = [c for c in facts.columns if c not in ("company_id", "filing_id")]
    lists = facts.groupBy("filing_id").agg(F.collect_list(F.struct(*columns)).alias("facts"))
    return filings.join(lists, "filing_id", "left").withColumn("arrived_at", arrived_at)


def read_inputs(reports, aliases=None):
    """What parts are built of, from stored reports."""
    return Inputs(reports.drop("facts", "arrived_at"), reports.select("company_id", "filing_id", F.inline("facts")), aliases)


def stored_for(spark, path, companies, buckets):
    """The rows of some companies in a stored table, read from their buckets only."""
    wanted = companies.withColumn("bucket", bucket(buckets=buckets))
    return spark.read.parquet(path).join(wanted, ["bucket", "company_id"], "left_semi").drop("bucket")


def not_older(batch, stored):
    """The reports of a batch, the latest of each filing, that are not older than the stored ones."""
    newest = batch.groupBy("filing_id").agg(F.max("arrived_at").alias("_newest"))
    rows = batch.join(newest, "filing_id").where("arrived_at = _newest").drop("_newest").dropDuplicates(["filing_id"])
    known = stored.select("filing_id", F.col("arrived_at").alias("_stored"))
    return rows.join(known, "filing_id", "left").where("_stored IS NULL OR _stored <= arrived_at").drop("_stored")


def take(batch, folder, buckets, names=None):
    """One batch of arriving reports: they replace the stored ones, then the parts of the companies they touch are built again.

    A batch that is taken again after a failure writes the same rows.
    """
    spark = batch.sparkSession
    stored = spark.read.parquet(f"{folder}/reports")
    fresh = checkpointed(not_older(batch, stored))
    if fresh.isEmpty():
        return
    replace_in_table(spark, f"{folder}/reports", fresh.select([c for c in stored.columns if c != "bucket"]), "filing_id", buckets)
    touched = checkpointed(fresh.select("company_id").distinct())
    reports = checkpointed(stored_for(spark, f"{folder}/reports", touched, buckets))
    replace_in_table(spark, f"{folder}/snapshots", checkpointed(parts_table(read_inputs(reports), names)), "company_id", buckets)


def created(spark, folder, reports, buckets, names=None):
    """The stored tables of a first load: reports, and the parts of all their companies."""
    write_table(reports, f"{folder}/reports", buckets)
    write_table(parts_table(read_inputs(spark.read.parquet(f"{folder}/reports").drop("bucket")), names), f"{folder}/snapshots", buckets)


def maintained(stream, folder, checkpoint, buckets, names=None, trigger=None):
    """Keeps the stored tables up to date with a stream of reports, as ``reports_of`` has them."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: take(batch, folder, buckets, names)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
