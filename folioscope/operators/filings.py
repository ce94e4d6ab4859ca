"""Filings of a company: bases of comparison, amendments, companions, discovery, retention, coverage."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.periods import base_form, is_amendment, is_annual_form
from .latest import pick, top_n

SUPPORTED_FORMS = ["10-K", "10-K/A", "10-KT", "10-Q", "10-Q/A", "20-F", "20-F/A", "40-F", "40-F/A", "6-K", "6-K/A"]
TAGGED_FORMS = ["6-K", "6-K/A"]
ANNUAL_FORMS = ["10-K", "10-KT", "20-F", "40-F"]
INTERIM_FORMS = ["10-Q", "6-K"]
EXPECTED_ANNUAL = ["management_discussion", "risk_factors", "commitments", "debt", "income_taxes", "segment_information", "business"]
EXPECTED_INTERIM = ["management_discussion", "commitments", "debt"]


def originals(filings):
    return filings.where(~is_amendment("form_type") & F.col("period_end").isNotNull())


def report_bases(filings):
    """Per company: the latest original report, the one before it, and the latest annual before it.

    Two aggregates and one join on the one-row-per-company result; no window over
    a company's filings.
    """
    cols = ["filing_id", "form_type", "filing_date", "period_end", "fiscal_year", "fiscal_period", "is_annual"]
    own = originals(filings).select("company_id", *cols)
    order = F.struct("period_end", "filing_date", "filing_id")
    latest = own.groupBy("company_id").agg(F.max_by(F.struct(*cols), order).alias("latest"))
    earlier = own.join(latest.select("company_id", F.col("latest.period_end").alias("_end")), "company_id").where(
        F.col("period_end") < F.col("_end"))
    before = earlier.groupBy("company_id").agg(
        F.max_by(F.struct(*cols), order).alias("previous"),
        F.max_by(F.struct(*cols), F.when(F.col("is_annual"), order)).alias("_annual"),
        F.max(F.col("is_annual").cast("int")).alias("_has"))
    before = before.withColumn("annual", F.when(F.col("_has") == 1, F.col("_annual"))).drop("_has", "_annual")
    return latest.join(before, "company_id", "left")


def report_targets(filings):
    """The reports the tabs describe: the latest interim when newer than the latest annual, and the annual."""
    cols = ["filing_id", "form_type", "period_end"]
    order = F.struct("period_end", "filing_date", "filing_id")
    best = pick(originals(filings), ["company_id", "is_annual"], ["period_end", "filing_date", "filing_id"],
                columns=["company_id", "is_annual", *cols])
    annual_end = F.max(F.when(F.col("is_annual"), F.col("period_end"))).over(Window.partitionBy("company_id"))
    return best.withColumn("_annual", annual_end).where(
        F.col("is_annual") | F.col("_annual").isNull() | (F.col("period_end") >= F.col("_annual"))).drop("_annual")


def amendment_links(filings):
    """Each amendment with the latest filed original of the same form and period."""
    f = filings.withColumn("base_form", base_form("form_type"))
    keys = ["company_id", "base_form", "period_end"]
    first = pick(f.where(~is_amendment("form_type")), keys, ["filing_date", "filing_id"], columns=[*keys, "filing_id", "filing_date"])
    first = first.select(*keys, F.col("filing_id").alias("amends_filing_id"), F.col("filing_date").alias("original_date"))
    return f.where(is_amendment("form_type")).join(first, keys, "left")


def companions(filings, days=10):
    """Tagged 6-Ks furnished within ``days`` of an annual report of the same date, with that report.

    Annual reports are reduced to one row per (company, report date, filing date)
    and each 6-K probes the 2*days+1 dates around its own, an equi-join whose
    output per row is bounded by the window.
    """
    reports = pick(filings.where(is_annual_form("form_type")), ["company_id", "report_date", "filing_date"], ["filing_id"],
                   largest=False, columns=["company_id", "report_date", "filing_date", "filing_id"])
    reports = reports.select("company_id", "report_date", F.col("filing_date").alias("_date"), F.col("filing_id").alias("annual_filing_id"))
    tagged = filings.where(F.col("form_type").isin(TAGGED_FORMS))
    probe = tagged.withColumn("_date", F.explode(F.sequence(F.date_sub("filing_date", days), F.date_add("filing_date", days))))
    hits = probe.join(reports, ["company_id", "report_date", "_date"])
    return hits.select("company_id", "filing_id", "annual_filing_id", F.col("_date").alias("annual_filing_date"))


def discover(filings, annual=3, interim_years=2):
    """Which listed filings to read: the last annual reports, their amendments, and recent interims (F1).

    ``filings`` carries company_id, filing_id, form_type, filing_date,
    report_date, inline_xbrl and ``position`` in the listing (newest first).
    """
    listed = filings.where(F.col("form_type").isin(SUPPORTED_FORMS)
                           & (~F.col("form_type").isin(TAGGED_FORMS) | F.col("inline_xbrl")))
    attached = companions(listed).select("filing_id").distinct()
    listed = listed.join(attached, "filing_id", "left_anti")
    annuals = top_n(listed.where(F.col("form_type").isin(ANNUAL_FORMS)), ["company_id"], ["position"], annual, "annual_rank")
    cutoffs = annuals.groupBy("company_id").agg(
        F.max_by("report_date", "annual_rank").alias("oldest"), F.count(F.lit(1)).alias("n_annual"),
        F.max(F.when(F.col("annual_rank") == interim_years, F.col("report_date"))).alias("recent"))
    cutoffs = cutoffs.withColumn(
        "interim_from", F.when(F.col("n_annual") >= interim_years, F.col("recent"))
        .when(F.col("n_annual") == annual, F.col("oldest")))
    chosen = listed.join(cutoffs, "company_id", "left").join(
        annuals.select("filing_id", F.lit(True).alias("_kept")), "filing_id", "left")
    annual_form = is_annual_form("form_type")
    known = F.col("n_annual").isNotNull() & F.col("report_date").isNotNull() & (
        F.coalesce(F.col("_kept"), F.lit(False)) | (annual_form & (F.col("report_date") >= F.col("oldest")))
        | (~annual_form & (F.col("interim_from").isNull() | (F.col("report_date") >= F.col("interim_from")))))
    young = top_n(chosen.where(F.col("n_annual").isNull()), ["company_id"], ["position"], 4, "_first").drop("_first")
    return chosen.where(known).unionByName(young).select(*filings.columns)


def find_filings(filings, n):
    """The first n filings of each form in listing order."""
    return top_n(filings, ["company_id", "form_type"], ["position"], n, "form_rank")


def latest_profile(filings, companies):
    """Currency, standard and year end of the latest original filing, else what was known."""
    fields = ["reporting_currency", "accounting_standard", "fiscal_year_end"]
    order = F.struct(F.col("period_end").isNotNull(), "period_end", "filing_date", "filing_id")
    latest = filings.where(~is_amendment("form_type")).groupBy("company_id").agg(
        F.max_by(F.struct(*fields), order).alias("new"))
    return companies.join(latest, "company_id", "left").select(
        "company_id", *[c for c in companies.columns if c not in ["company_id", *fields]],
        *[F.coalesce(F.col(f"new.{f}"), F.col(f)).alias(f) for f in fields])


def upsert_companies(old, new):
    """New values over old ones, the showcase flag kept once set."""
    a, b = old.alias("o"), new.alias("n")
    return a.join(b, F.col("o.cik") == F.col("n.cik"), "full_outer").select(
        F.coalesce("n.cik", "o.cik").alias("cik"), F.coalesce("n.ticker", "o.ticker").alias("ticker"),
        F.coalesce("n.name", "o.name").alias("name"),
        (F.coalesce("o.is_showcase", F.lit(False)) | F.coalesce("n.is_showcase", F.lit(False))).alias("is_showcase"))


def replace_filings(old, new, key="filing_id"):
    """A re-read filing replaces all its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def fact_counts(filings, facts):
    """Facts per filing, zero when it has none."""
    counts = facts.groupBy("filing_id").agg(F.count(F.lit(1)).alias("fact_count"))
    return filings.join(counts, "filing_id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0)))


def retained_filings(filings, annual=2, interim=2):
    """Filings whose section text is kept: the latest annual and interim originals (W11).  A filing that is neither takes no slot."""
    own = filings.where(~is_amendment("form_type"))
    interim_report = ~F.col("is_annual") & base_form("form_type").isin(INTERIM_FORMS)
    order = [F.col("period_end").desc_nulls_last(), F.desc("filing_date"), F.desc("filing_id")]
    keep = top_n(own.where("is_annual"), ["company_id"], order, annual, "_rank").unionByName(
        top_n(own.where(interim_report), ["company_id"], order, interim, "_rank"))
    return keep.select("company_id", "filing_id")


def retain_text(sections, filings, annual=2, interim=2):
    """Section text outside the retention window becomes NULL; everything else stays."""
    keep = retained_filings(filings, annual, interim).select("filing_id", F.lit(True).alias("_kept"))
    return sections.join(keep, "filing_id", "left").withColumn("text", F.when(F.col("_kept"), F.col("text"))).drop("_kept")


def eviction_list(companies, keep):
    """Companies beyond the ``keep`` most recently viewed; showcase companies never.

    The cut is found by a top-k (each task keeps at most k rows), not by ranking
    every company in one task.
    """
    order = [F.col("last_viewed").desc_nulls_last(), F.desc("updated_at"), F.col("company_id")]
    own = companies.where(~F.col("is_showcase"))
    kept = own.orderBy(*order).limit(keep).select("company_id")
    return own.join(kept, "company_id", "left_anti")


def coverage_report(filings, sections, found_metrics):
    """Per filing and category: found, with the best confidence; expected ones without a section.

    ``sections`` has filing_id, categories, confidence; ``found_metrics`` has
    filing_id and metric (own periods only).
    """
    expected = F.when(F.col("is_annual"), F.array(*map(F.lit, EXPECTED_ANNUAL))).when(
        F.col("form_type").startswith("10-Q"), F.array(*map(F.lit, EXPECTED_INTERIM)))
    found = (
        sections.where(~F.array_contains("categories", "accounting_policies"))
        .select("filing_id", F.explode("categories").alias("category"), "confidence")
        .groupBy("filing_id", "category").agg(F.max("confidence").alias("confidence")).withColumn("found", F.lit(True)))
    wanted = filings.select("filing_id", F.explode(expected).alias("category"))
    merged = wanted.join(found, ["filing_id", "category"], "full_outer").select(
        "filing_id", "category", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    core = ["revenue", "net_income", "total_assets"]
    statements = found_metrics.groupBy("filing_id").agg(*[
        F.max((F.col("metric") == m).cast("int")).alias(m) for m in core])
    share = F.bround(sum((F.coalesce(F.col(m), F.lit(0)) for m in core[1:]), F.coalesce(F.col(core[0]), F.lit(0))) / 3, 2)
    statements = filings.select("filing_id").join(statements, "filing_id", "left").select(
        "filing_id", F.lit("financial_statements").alias("category"), F.col(core[0]).isNotNull().alias("found"),
        share.alias("confidence"))
    return merged.unionByName(statements)


def parser_confidence(coverage, filings):
    """How much of a filing was read: tagged data, statements, expected sections; with its level."""
    expected = F.when(F.col("is_annual"), F.array(*map(F.lit, EXPECTED_ANNUAL))).when(
        F.col("form_type").startswith("10-Q"), F.array(*map(F.lit, EXPECTED_INTERIM))).otherwise(F.array().cast("array<string>"))
    rows = coverage.join(filings.select("filing_id", "has_tags", expected.alias("_expected")), "filing_id")
    wanted = F.array_contains("_expected", F.col("category"))
    agg = rows.groupBy("filing_id").agg(
        F.first("has_tags").alias("has_tags"), F.first(F.size("_expected")).alias("n"),
        F.sum((wanted & F.col("found")).cast("int")).alias("k"),
        F.max(F.when(F.col("category") == "financial_statements", F.col("confidence"))).alias("statements"))
    share = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(1.0)
    value = F.when(F.col("has_tags"), 0.4).otherwise(0.0) + F.col("statements") * 0.35 + share * 0.25
    return agg.select("filing_id", F.bround(value, 3).alias("parser_confidence")).withColumn(
        "confidence_level", F.when(F.col("parser_confidence") >= 0.8, "high").when(F.col("parser_confidence") >= 0.5, "medium")
        .otherwise("low"))


def needs_parse(listed, parsed, version):
    """Listed filings not yet read at this version."""
    done = parsed.where(F.col("parser_version") == version).select("accession_number").distinct()
    return listed.join(done, "accession_number", "left_anti")


def needs_rewrite(companies, outputs, preferred):
    """Companies whose synthesis or audit a fallback model wrote, most recently viewed first."""
    wanted = F.create_map(*[F.lit(x) for pair in preferred.items() for x in pair])
    fallback = outputs.where((F.col("model") != "none") & (F.col("model") != F.try_element_at(wanted, F.col("stage"))))
    return companies.join(fallback.select("company_id").distinct(), "company_id", "left_semi").orderBy(
        F.col("last_viewed").desc_nulls_last(), "company_id")


def disclosure_documents(documents, min_bytes=15_000):
    """Documents that can hold disclosure text."""
    exhibit = F.col("type").rlike(r"(?i)^EX-(?:99|1|2|3|13|15)(?:\.\d+)?$")
    return documents.where(F.col("role").isin("primary", "companion", "xbrl_financials")
                           | (exhibit & (F.col("size").isNull() | (F.col("size") >= min_bytes))))


def snapshot_is_current(snapshots, now, snapshot_version, parser_version, hours=24):
    """Snapshots at the current versions checked within the last day."""
    fresh = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("checked_at") < hours * 3600
    return snapshots.withColumn("is_current", (F.col("snapshot_version") == snapshot_version)
                                & (F.col("parser_version") == parser_version) & fresh)


