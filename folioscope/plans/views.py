"""What a company's pages show: capital items, breakdowns, one-off items, notes on figures, mixes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.arith import growth, lookup, ratio
from ..functions.periods import fiscal_label
from ..operators.latest import latest_filed, pick, top_n


def sectioned(facts, aliases=None):
    """Rows shown in a capital section, with the section and the newest key."""
    section = F.when(F.col("canonical_metric").isNull() & F.col("category").isin(fv.CAPITAL_SECTIONS), F.col("category")).otherwise(
        lookup(fv.METRIC_SECTIONS, "canonical_metric"))
    rows = facts.withColumn("section", section).where(
        F.col("section").isNotNull() & F.col("normalized_unit").isin("currency", "ratio", "currency_per_share"))
    if aliases is None:
        return rows.withColumn("line_key", F.col("fact_key"))
    names = aliases.select("company_id", F.col("old_key").alias("fact_key"), "newest_key")
    return rows.join(names, ["company_id", "fact_key"], "left").withColumn("line_key", F.coalesce("newest_key", "fact_key")).drop("newest_key")


def capital_items(rows, context):
    """Per line: the latest value, the comparable prior one, the annual one, whether it is new, and its series.

    ``context``: company_id, latest_filing, latest_end, annual_end,
    reference_end, earliest_end.  Spans are reduced first; a line's spans are then
    bounded by the calendar and compared inside one row.
    """
    key = ["company_id", "section", "line_key", "currency", "normalized_unit", "period_type"]
    fiscal = (F.col("period_type") == "instant") | F.col("fiscal_period").isNotNull()
    packed = F.struct("value", "label", "filing_id", "fiscal_year", "fiscal_period", "triggers")
    with_context = rows.join(context, "company_id")
    spans = with_context.groupBy(*key, "period_start", "period_end").agg(
        F.max_by(packed, F.struct("filing_date", "fact_id")).alias("row"), F.max("period_months").alias("months"),
        F.max(fiscal.cast("int")).alias("fiscal"), F.min("filing_id").alias("lo"), F.max("filing_id").alias("hi"),
        F.max(F.col("is_comparative").cast("int")).alias("comparative"),
        *[F.first(c).alias(c) for c in context.columns if c != "company_id"])
    span = F.struct("period_end", "period_start", "months", "row", "fiscal", "comparative")
    lines = spans.groupBy(*key).agg(
        F.sort_array(F.collect_list(span)).alias("all_spans"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max("comparative").alias("any_comparative"), *[F.first(c).alias(c) for c in context.columns if c != "company_id"])
    named = F.filter("all_spans", lambda s: s.fiscal == 1)
    lines = lines.withColumn("spans", F.when(F.size(named) > 0, named).otherwise(F.col("all_spans")))
    instant = F.col("period_type") == "instant"
    end = F.array_max(F.transform("spans", lambda s: s.period_end))
    lines = lines.withColumn("end", end)
    at_end = F.filter("spans", lambda s: s.period_end == F.col("end"))
    longest = F.array_max(F.transform(at_end, lambda s: F.struct(F.coalesce(s.months, F.lit(0)).alias("m"), s.period_start.alias("p"), s.alias("s")))).s
    lines = lines.withColumn("latest", longest)
    lines = lines.withColumn("same", F.when(instant, F.col("spans")).otherwise(
        F.filter("spans", lambda s: s.months.eqNullSafe(F.col("latest.months")))))
    earlier = F.filter("same", lambda s: s.period_end < F.col("end"))
    year_ago = F.filter(earlier, lambda s: F.abs(F.datediff(F.col("end"), s.period_end) - 365) <= 10)
    prior = F.when(instant, F.try_element_at(earlier, F.lit(-1))).otherwise(F.try_element_at(year_ago, F.lit(-1)))
    annual = F.when(instant & (F.col("annual_end") != F.col("end")), F.try_element_at(
        F.filter("same", lambda s: s.period_end == F.col("annual_end")), F.lit(1)))
    lines = lines.withColumn("prior", prior).withColumn("annual", annual).where(F.col("end") >= F.col("reference_end"))
    is_new = ((F.col("lo") == F.col("latest_filing")) & (F.col("hi") == F.col("latest_filing")) & (F.col("any_comparative") == 0)
              & (F.col("earliest_end") < F.col("latest_end")))
    n = F.size("same")
    points = F.transform(F.slice("same", F.greatest(F.lit(1), n - fv.SERIES_POINTS + 1), fv.SERIES_POINTS), lambda s: F.struct(
        s.period_end.alias("period_end"), s.row.value.alias("value")))
    return lines.select(
        *key, F.col("latest.row.label").alias("label"), F.col("end").alias("period_end"),
        fiscal_label(F.col("latest.row.fiscal_year"), F.col("latest.row.fiscal_period")).alias("period_label"),
        F.col("latest.row.value").alias("value"), F.col("prior.row.value").alias("prior_value"),
        F.col("annual.row.value").alias("annual_value"), growth("latest.row.value", "prior.row.value").alias("change_vs_prior"),
        growth("latest.row.value", "annual.row.value").alias("change_vs_annual"), is_new.alias("is_new"),
        F.array_contains("latest.row.triggers", "subsequent_event").alias("subsequent_event"), points.alias("series"))


def capital_context(filings):
    """Per company: latest report, latest annual, and the date before which an item is stale."""
    order = F.struct("period_end", "filing_date", "filing_id")
    return filings.groupBy("company_id").agg(
        F.max_by("filing_id", order).alias("latest_filing"), F.max("period_end").alias("latest_end"),
        F.max(F.when(F.col("is_annual"), F.col("period_end"))).alias("annual_end"), F.min("period_end").alias("earliest_end")).withColumn(
        "reference_end", F.coalesce("annual_end", "latest_end"))


def capital_sections(items):
    """Distinct non-zero items per section, currency first, then by size; 25 shown and the rest counted."""
    alive = items.where(F.exists("series", lambda s: s.value != 0))
    signature = F.struct(F.element_at(F.split("label", ":"), 1).alias("name"), "normalized_unit", "currency", "series")
    order = F.struct((F.col("normalized_unit") != "currency").cast("int").alias("u"), (-F.abs("value")).alias("v"),
                     F.length("label").alias("n"), F.col("line_key").alias("k"))
    once = alive.withColumn("_signature", F.sha1(F.to_json(signature))).withColumn("_order", order)
    kept = pick(once, ["company_id", "section", "_signature"], ["_order"], largest=False)
    # the items are counted where they are ranked; reading them a second time would make them a second time
    n = F.count(F.lit(1)).over(Window.partitionBy("company_id", "section"))
    kept = kept.where("company_id IS NOT NULL AND section IS NOT NULL").withColumn("more", F.greatest(F.lit(0), n - fv.MAX_ITEMS))
    return top_n(kept, ["company_id", "section"], ["_order"], fv.MAX_ITEMS, "place").drop("_order", "_signature")


def breakdown_view(facts, wide_rows, families=("segment", "geography", "product"), kind="annual"):
    """Revenue by segment, geography and product for the latest period, with growth and share of revenue."""
    periods = ["FY"] if kind == "annual" else ["Q1", "Q2", "Q3", "Q4"]
    rows = facts.where(F.col("category").isin(*families) & (F.col("period_type") == "duration") & F.col("fiscal_period").isin(periods)
                       & F.col("fiscal_year").isNotNull())
    keys = ["company_id", "category", "fact_key", "fiscal_year", "fiscal_period"]
    best = latest_filed(rows, keys, columns=[*keys, "label", "value", "filing_date", "fact_id"])
    # after the pick a company's rows are bounded by its lines and periods
    latest = F.max(F.struct("fiscal_year", "fiscal_period")).over(Window.partitionBy("company_id", "category"))
    by_line = Window.partitionBy("company_id", "category", "fact_key", "fiscal_period").orderBy("fiscal_year")
    prior = F.when(F.lag("fiscal_year").over(by_line) == F.col("fiscal_year") - 1, F.lag("value").over(by_line))
    shown = best.withColumn("prior_value", prior).withColumn("_latest", latest).where(
        (F.col("fiscal_year") == F.col("_latest.fiscal_year")) & (F.col("fiscal_period") == F.col("_latest.fiscal_period")))
    revenue = wide_rows.select("company_id", "fiscal_year", F.col("period").alias("fiscal_period"), F.col("revenue").alias("_revenue"))
    metric = F.element_at(F.split("fact_key", r"\."), 2)
    out = shown.join(revenue, ["company_id", "fiscal_year", "fiscal_period"], "left").withColumn("metric", metric)
    out = out.select("company_id", F.col("category").alias("family"), "fiscal_year", "fiscal_period", "fact_key", "label", "metric", "value", "prior_value",
                     growth("value", "prior_value").alias("growth"),
                     F.when(F.col("metric") == "revenue", ratio("value", "_revenue")).alias("share_of_revenue"))
    w = Window.partitionBy("company_id", "family").orderBy((F.col("metric") != "revenue").cast("int"), F.desc(F.abs("value")), "fact_key")
    return out.withColumn("place", F.row_number().over(w))


def useful_breakdowns(view):
    """A sole reported segment says nothing about the mix (F16)."""
    n = F.sum((F.col("metric") == "revenue").cast("int")).over(Window.partitionBy("company_id", "family"))
    return view.withColumn("_n", n).where((F.col("family") != "segment") | (F.col("_n") > 1)).drop("_n")


def one_off_items(facts, categories=("investment", "unusual_item", "non_operating")):
    """Investment gains and unusual items per period, latest filed, by size."""
    rows = facts.where(F.col("category").isin(*categories) & (F.col("period_type") == "duration") & F.col("fiscal_period").isNotNull()
                       & (F.col("normalized_unit") == "currency") & ~F.element_at(F.split("xbrl_concept", ":"), -1).startswith("PaymentsToAcquire"))
    keys = ["company_id", "fiscal_year", "fiscal_period", "fact_key"]
    best = latest_filed(rows, keys, columns=[*keys, "label", "category", "value", "filing_date", "fact_id"])
    w = Window.partitionBy("company_id", "fiscal_year", "fiscal_period").orderBy(F.desc(F.abs("value")), "fact_key")
    return best.withColumn("place", F.row_number().over(w)).drop("filing_date", "fact_id")


def mix_with_other(rows, keys, name="name", value="value", top=5):
    """The largest five positive parts and the rest as 'Other', with shares."""
    parts = rows.where(F.col(value) > 0).groupBy(*keys, name).agg(F.sum(value).alias(value))
    totals = parts.groupBy(*keys).agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n"))
    head = top_n(parts, keys, [F.desc(value), F.col(name)], top + 1, "place").join(totals, keys)
    kept = head.where((F.col("_n") <= top + 1) | (F.col("place") <= top))
    shown = kept.groupBy(*keys).agg(F.sum(value).alias("_shown"), F.first("_total").alias("_total"), F.first("_n").alias("_n"))
    other = shown.where(F.col("_n") > top + 1).select(
        *keys, F.lit("Other").alias(name), (F.col("_total") - F.col("_shown")).alias(value), F.lit(top + 1).alias("place"), "_total")
    out = kept.select(*keys, name, value, "place", "_total").unionByName(other)
    return out.withColumn("share", ratio(value, "_total")).drop("_total")


# FIXED VALUES: notes on figures.
HIGH, LOW, NEAR_ZERO, EXPLAINS_SHARE, MIN_OTHER_PERIODS = 1.8, 0.35, 0.05, 0.4, 3
SPIKE_ROWS = ["net_income", "pretax_income", "operating_income", "noninterest_income", "revenue", "eps_diluted"]
PAYMENT_ROWS = ["dividends_paid", "buybacks"]
CHARGES = "Impairment|WriteDown|Writedown|Restructuring|Litigation|AcquisitionRelatedCosts"
KEY_ROWS = ["revenue", "gross_profit", "operating_income", "pretax_income", "net_income", "eps_diluted", "operating_cash_flow", "capex",
            "free_cash_flow", "cash", "total_debt", "total_assets", "equity"]
RATIO_INPUTS = {
    "revenue_growth": "revenue prior:revenue", "eps_growth": "eps_diluted prior:eps_diluted", "gross_margin": "gross_profit revenue",
    "rnd_intensity": "rnd revenue", "operating_margin": "operating_income revenue", "effective_tax_rate": "income_tax pretax_income",
    "net_margin": "net_income revenue", "capex_intensity": "capex revenue", "free_cash_flow": "operating_cash_flow capex",
    "fcf_margin": "operating_cash_flow capex revenue", "cash_conversion": "operating_cash_flow net_income", "net_cash": "cash total_debt",
    "receivable_days": "accounts_receivable revenue", "inventory_days": "inventory revenue", "nii_share": "net_interest_income revenue",
    "cost_income_ratio": "operating_expenses revenue", "loans_to_deposits": "loans deposits", "credit_loss_rate": "credit_loss_expense loans",
    "roe": "net_income equity"}


def unusual_cells(table):
    """Peaks above both neighbours and losses between profits in a displayed table.

    ``table`` is the long table of ``metrics.financial_table``; a company's row
    has at most eight cells.
    """
    w = Window.partitionBy("company_id", "row_key").orderBy(F.desc("age"))
    rows = table.where(F.col("row_key").isin(SPIKE_ROWS)).withColumn("before", F.lag("value").over(w)).withColumn("after", F.lead("value").over(w))
    v, around = F.col("value"), F.least(F.col("before"), F.col("after"))
    beside = F.greatest(F.col("before"), F.col("after"))
    peak = (around > 0) & (v > F.lit(HIGH) * beside)
    loss = (F.col("row_key") != "revenue") & (v < 0) & (around > 0)
    kind = F.when(peak, "peak").when(loss, "loss")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull())


def explained_spikes(spikes, items):
    """The largest tagged one-off that moves profit the same way as the excess and makes up 40% of it."""
    mean = F.coalesce((F.col("before") + F.col("after")) / 2, F.col("before"), F.col("after"))
    rows = spikes.withColumn("excess", F.col("value") - mean)
    charge = F.col("xbrl_concept").rlike(CHARGES)
    best = items.where(F.col("value") != 0).withColumn("charge", charge).groupBy("company_id", "fiscal_year", "fiscal_period", "charge").agg(
        F.max_by(F.struct("label", "value"), F.struct(F.abs("value"), "label")).alias("item"))
    joined = rows.withColumn("charge", F.col("excess") < 0).join(best, ["company_id", "fiscal_year", "fiscal_period", "charge"], "left")
    enough = F.abs("item.value") >= F.abs("excess") * EXPLAINS_SHARE
    return joined.withColumn("item", F.when(enough, F.col("item"))).drop("charge")


def payment_notes(table):
    """Dividends and buybacks far below their usual level: slipped, near zero, or low."""
    row = Window.partitionBy("company_id", "row_key")
    ordered = row.orderBy(F.desc("age"))
    rows = table.where(F.col("row_key").isin(PAYMENT_ROWS)).withColumn("typical", F.median("value").over(row)).withColumn(
        "_n", F.count("value").over(row)).withColumn("after", F.lead("value").over(ordered))
    v, t = F.col("value"), F.col("typical")
    rows = rows.withColumn("_low", (F.col("_n") > MIN_OTHER_PERIODS) & (t > 0) & (v < t * LOW))
    slipped = (F.col("_low") & (F.col("row_key") == "dividends_paid") & (F.col("after") > t * 1.6)
               & (F.abs(v + F.col("after") - t * 2) <= t * 2 * 0.25))
    kind = F.when(slipped, "slipped").when(F.col("_low") & (F.abs(v) < t * NEAR_ZERO), "near_zero").when(F.col("_low"), "low")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop("_n", "_low")


def releases(table):
    """Net releases of credit loss provisions."""
    return table.where((F.col("row_key") == "credit_loss_expense") & (F.col("value") < 0))


def blank_reasons(table, wide_rows, spread, filings):
    """Why a displayed cell is blank: one of six reasons per cell.

    ``spread`` is ``metrics.fiscal_spread`` (tagged values per label), ``wide_rows``
    the wide rows that ratios were computed from.
    """
    blanks = table.where(F.col("value").isNull()).select("company_id", "fiscal_year", "fiscal_period", "row_key", "unit")
    tagged = spread.select("company_id", "fiscal_year", F.col("canonical_metric").alias("row_key"), "Q1", "H1", "9M", "FY")
    rows = blanks.join(tagged, ["company_id", "fiscal_year", "row_key"], "left")
    reports = filings.where(~F.col("form_type").endswith("/A")).groupBy("company_id", "fiscal_year", "fiscal_period").agg(
        F.min_by("form_type", F.struct("filing_date", "filing_id")).alias("report_form"))
    first = filings.where(F.col("fiscal_year").isNotNull()).groupBy("company_id").agg(
        F.min(F.when(F.col("is_annual"), F.col("fiscal_year"))).alias("first_annual"),
        F.min(F.when(~F.col("is_annual"), F.struct("fiscal_year", "fiscal_period"))).alias("first_interim"))
    wide = wide_rows.select("company_id", "fiscal_year", F.col("period").alias("fiscal_period"),
                            F.struct(*[c for c in wide_rows.columns if c in _INPUTS]).alias("now"), F.col("prior").alias("then"))
    rows = rows.join(wide, ["company_id", "fiscal_year", "fiscal_period"], "left").join(
        reports, ["company_id", "fiscal_year", "fiscal_period"], "left").join(first, "company_id", "left")
    period = F.col("fiscal_period")
    whole = F.when(period == "Q2", F.col("H1")).when(period == "Q3", F.col("9M")).otherwise(F.col("FY"))
    part = F.when(period == "Q2", F.col("Q1")).when(period.isin("Q3", "H2"), F.col("H1")).otherwise(F.col("9M"))
    derived = F.col("row_key").isin(list(RATIO_INPUTS))
    lacks = F.lit(None).cast("string")
    for row, inputs in RATIO_INPUTS.items():
        names = [F.when(_input(n).isNull(), F.lit(n)) for n in inputs.split()]
        lacks = F.when(F.col("row_key") == row, F.array_join(F.array_compact(F.array(*names)), ",")).otherwise(lacks)
    rows = rows.withColumn("missing_inputs", lacks)
    loss = (F.col("row_key") == "cash_conversion") & (F.col("now.net_income") <= 0)
    before = F.when(period == "FY", F.col("fiscal_year") < F.col("first_annual")).otherwise(
        F.struct("fiscal_year", "fiscal_period") < F.col("first_interim"))
    instant = F.col("row_key").isin([m[0] for m in fv.METRIC_TABLE if m[2] == "instant"])
    reason = (
        F.when(derived & loss, "loss_makes_ratio_meaningless")
        .when(derived & (F.col("missing_inputs") != ""), "input_missing")
        .when(derived, None)
        .when(F.col("row_key").isin(fv.NOT_DERIVABLE) & period.isin("Q4", "H2"), "per_share_not_derivable")
        .when(~instant & period.isin("Q2", "Q3", "Q4", "H2") & (whole.isNull() | part.isNull()), "part_not_tagged")
        .when(F.col("report_form").isNotNull(), "not_tagged_in_report")
        .when(before, "only_comparative"))
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "company_id", "fiscal_year", "fiscal_period", "row_key", "reason", "missing_inputs", "report_form")


_INPUTS = sorted({n.removeprefix("prior:") for v in RATIO_INPUTS.values() for n in v.split()} | {
    "long_term_debt", "long_term_debt_noncurrent", "debt_current", "cost_of_revenue"})


def _input(name):
    """An input of a ratio, built from its parts where no total is tagged."""
    side, metric = ("then", name.removeprefix("prior:")) if name.startswith("prior:") else ("now", name)
    if metric == "total_debt":
        return F.coalesce(*[F.col(f"{side}.{m}") for m in ("long_term_debt", "long_term_debt_noncurrent", "debt_current")])
    if metric == "gross_profit":
        return F.coalesce(F.col(f"{side}.gross_profit"), F.col(f"{side}.revenue") + F.col(f"{side}.cost_of_revenue"))
    return F.col(f"{side}.{metric}")


def omitted_rows(table, profiles, annual_table=None):
    """Headline rows a company's table does not show, with the reason."""
    companies = profiles.where(~F.col("is_bank")).select("company_id", F.explode(F.array(*map(F.lit, KEY_ROWS))).alias("row_key"))
    missing = companies.join(table.select("company_id", "row_key").distinct(), ["company_id", "row_key"], "left_anti")
    if annual_table is None:
        return missing.withColumn("reason", F.lit("not_found"))
    annual = annual_table.select("company_id", "row_key", F.lit(True).alias("_annual")).distinct()
    return missing.join(annual, ["company_id", "row_key"], "left").withColumn(
        "reason", F.when(F.col("_annual"), "only_in_annual_reports").otherwise("not_found")).drop("_annual")


def interim_note(profiles, filings):
    """Why a company has no interim view."""
    forms = filings.groupBy("company_id").agg(F.sort_array(F.collect_set(F.regexp_replace("form_type", "/A$", ""))).alias("forms"))
    foreign = F.exists("forms", lambda f: f.isin("20-F", "40-F"))
    return profiles.join(forms, "company_id", "left").select(
        "company_id", "interim_kind", F.when(F.col("interim_kind") == "half_yearly", "half_year_reports")
        .when(F.col("interim_kind").isNotNull(), F.lit(None)).when(foreign, "foreign_annual_only").otherwise("no_tagged_quarters").alias("note"))


def half_year_label(half_yearly):
    """The label of a fact; half-yearly issuers' second-quarter labels are read as half years."""
    half = half_yearly & (F.col("fiscal_period") == "Q2") & ((F.col("period_type") == "instant") | (F.coalesce("period_months", F.lit(0)) >= 6))
    return F.when(half, "H1").otherwise(F.col("fiscal_period"))


def half_year_labels(facts):
    """Facts of half-yearly issuers under these labels."""
    return facts.withColumn("fiscal_period", half_year_label(F.lit(True)))
