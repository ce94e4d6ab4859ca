"""Reported-facts JSON: taxonomy -> tag -> unit -> entries, read long and turned into annual and quarterly series."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.arith import col, growth, ratio, sum_present
from ..functions.periods import between_days

ENTRY = "struct<start:string,end:string,val:double,form:string,filed:string,fy:int,fp:string>"
SCHEMA = f"struct<facts:map<string,map<string,struct<units:map<string,array<{ENTRY}>>>>>>"
SERIES = fv.COMPANYFACTS_SERIES
METRICS = [row[0] for row in SERIES]


def companyfacts_long(raw, payload="payload"):
    """One row per reported entry of each company's JSON (S3)."""
    parsed = raw.select("company_id", F.from_json(payload, SCHEMA).alias("p"))
    taxa = parsed.select("company_id", F.explode("p.facts").alias("taxonomy", "tags"))
    tags = taxa.select("company_id", "taxonomy", F.explode("tags").alias("tag", "t"))
    units = tags.select("company_id", "taxonomy", "tag", F.explode("t.units").alias("unit", "entries"))
    return units.select("company_id", "taxonomy", "tag", "unit", F.inline("entries")).select(
        "company_id", "taxonomy", "tag", "unit", F.to_date("start").alias("start"), F.to_date("end").alias("end"),
        "val", "form", F.to_date("filed").alias("filed"), "fy", "fp")


def tag_metrics(facts, metrics=None):
    """Each entry with the metric its tag stands for and the tag's preference rank.

    The dictionary is a constant of some thirty tags, kept as a MAP literal, so no
    join is needed.
    """
    known = {}
    for metric, period, unit, tags in SERIES:
        if metrics is None or metric in metrics:
            for rank, tag in enumerate(tags):
                known[f"{unit}|{tag}"] = (metric, rank, period)
    entries = [x for k, (m, r, p) in known.items() for x in (
        F.lit(k), F.struct(F.lit(m).alias("metric"), F.lit(r).alias("rank"), F.lit(p).alias("period_type")))]
    meaning = F.try_element_at(F.create_map(*entries), F.concat_ws("|", "unit", "tag"))
    return facts.where(F.col("taxonomy") == "us-gaap").withColumn("_m", meaning).where(F.col("_m").isNotNull()).select(
        *facts.columns, "_m.*")


def preferred_value(entries, end="end"):
    """Per (company, metric, end): the first tag that reports it, latest filed value within the tag (A1)."""
    return entries.groupBy("company_id", "metric", end).agg(
        F.min_by(F.struct("val", "fy", "fp"), F.struct("rank", (-F.unix_date("filed")).alias("f"), "val")).alias("v")).select(
        "company_id", "metric", end, "v.*")


def annual_series(facts, reports):
    """The last five annual periods up to each company's report date, one column per metric.

    ``reports``: company_id, report_date.
    """
    entries = tag_metrics(facts.where(F.col("form").isin("10-K", "10-K/A")))
    duration = F.col("start").isNotNull() & between_days("start", "end", fv.ANNUAL_DAYS)
    entries = entries.where(F.when(F.col("period_type") == "instant", F.col("start").isNull()).otherwise(duration))
    best = preferred_value(entries)
    wide = best.groupBy("company_id", "end").agg(*[F.expr(f"max(CASE WHEN metric = '{m}' THEN val END) AS {m}") for m in METRICS])
    company = Window.partitionBy("company_id")
    has_revenue = F.max(F.col("revenue").isNotNull().cast("int")).over(company)
    wide = wide.withColumn("_anchor", F.when(has_revenue == 1, F.col("revenue")).otherwise(F.col("net_income")))
    wide = wide.join(reports, "company_id").where(
        F.col("_anchor").isNotNull() & (F.datediff("end", "report_date") <= fv.REPORT_DATE_SLACK_DAYS))
    latest = wide.withColumn("age", F.row_number().over(company.orderBy(F.desc("end")))).where(F.col("age") <= fv.COMPANYFACTS_YEARS)
    return latest.drop("_anchor", "report_date").withColumn("free_cash_flow", F.col("operating_cash_flow") - F.col("capex"))


def annual_kpis(series):
    """Key figures of the latest year; growth only against an adjacent year."""
    w = Window.partitionBy("company_id").orderBy("end")
    adjacent = F.datediff("end", F.lag("end").over(w)).between(*fv.ANNUAL_DAYS)
    rows = series.withColumn("_prior", F.when(adjacent, F.lag(F.struct("revenue", "eps_diluted")).over(w)))
    return rows.where(F.col("age") == 1).select(
        "company_id", F.col("end").alias("period_end"), "revenue", growth("revenue", "_prior.revenue").alias("revenue_growth"),
        ratio("gross_profit", "revenue").alias("gross_margin"), ratio("operating_income", "revenue").alias("operating_margin"),
        ratio("net_income", "revenue").alias("net_margin"), "net_income", "free_cash_flow",
        ratio("free_cash_flow", "revenue").alias("fcf_margin"), "eps_diluted",
        growth("eps_diluted", "_prior.eps_diluted").alias("eps_growth"),
        sum_present("buybacks", "dividends").alias("shareholder_returns"), "cash", "long_term_debt")


def capital_deployment(series):
    """Where the latest year's cash went; zero and negative outlays are left out (F16)."""
    uses = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("name"), F.col(m).alias("value"))
                     for i, (m, label) in enumerate(fv.CAPITAL_DEPLOYMENT.items())])
    return series.where(F.col("age") == 1).select("company_id", F.inline(uses)).where(F.col("value") > 0)


def latest_quarter(facts, reports):
    """The quarter ending at the report date against the same quarter a year earlier."""
    metrics = ["revenue", "net_income", "eps_diluted"]
    entries = tag_metrics(facts.where(F.col("form").isin("10-Q", "10-Q/A")), metrics)
    entries = entries.where(F.col("start").isNotNull() & between_days("start", "end", fv.QUARTER_DAYS))
    best = preferred_value(entries).join(reports, "company_id")
    gap = F.datediff("report_date", "end")
    now, then = F.col("end") == F.col("report_date"), gap.between(*fv.SAME_QUARTER_DAYS)
    rows = best.where(now | then).groupBy("company_id", "report_date").agg(
        *[F.max(F.when(now & (F.col("metric") == m), F.col("val"))).alias(m) for m in metrics],
        *[F.min_by("val", F.when(then & (F.col("metric") == m), F.abs(gap - 364))).alias(f"{m}_prior") for m in metrics],
        F.max_by("fp", F.when(now, F.col("metric"))).alias("fiscal_period"), F.max(F.when(now, F.col("fy"))).alias("fiscal_year"),
        F.max(now.cast("int")).alias("_found"))
    rows = rows.where(F.col("_found") == 1).drop("_found")
    return rows.withColumns({f"{m}_growth": growth(m, f"{m}_prior") for m in metrics})


def usd_text(value):
    """'$1.23T', '$4.5B', '$678M', '$12.34' (X16)."""
    v, sign = F.abs(col(value)), F.when(col(value) < 0, "-").otherwise("")
    body = (F.when(v >= 1e12, F.format_string("$%.2fT", v / 1e12)).when(v >= 1e9, F.format_string("$%.1fB", v / 1e9))
            .when(v >= 1e6, F.format_string("$%.0fM", v / 1e6)).otherwise(F.concat(F.lit("$"), F.format_number(v, 2))))
    return F.when(col(value).isNotNull(), F.concat(sign, body))


# FIXED VALUES: the order and wording of the reference lines.
REFERENCE_FIELDS = {
    "revenue": "Revenue", "gross_profit": "Gross profit", "operating_income": "Operating income", "net_income": "Net income",
    "operating_cash_flow": "Operating cash flow", "capex": "Capital expenditures",
    "free_cash_flow": "Free cash flow (operating cash flow minus capital expenditures)", "buybacks": "Share repurchases (cash paid)",
    "dividends": "Dividends paid", "rnd": "R&D expense", "acquisitions": "Acquisitions, net of cash acquired",
    "debt_repayment": "Debt repayments", "eps_diluted": "Diluted EPS", "cash": "Cash and cash equivalents at period end",
    "long_term_debt": "Long-term debt at period end"}


def reference_lines(series, years=2):
    """One line of figures per recent year."""
    parts = F.array_compact(F.array(*[
        F.when(F.col(m) != 0, F.concat(F.lit(f"{label} "), usd_text(m))) for m, label in REFERENCE_FIELDS.items()]))
    return series.where(F.col("age") <= years).select("company_id", "end", F.concat(
        F.lit("- Fiscal year ended "), F.col("end").cast("string"), F.lit(": "), F.array_join(parts, "; ")).alias("line"))


def figure_index(series):
    """Amounts of all years, margins of the last two and growth of the last pair, as traceable figures."""
    w = Window.partitionBy("company_id").orderBy("end")
    grown = ["revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow", "free_cash_flow", "eps_diluted",
             "buybacks", "dividends", "capex", "rnd"]
    rows = series.withColumn("_prior", F.lag(F.struct(*grown)).over(w))
    amounts = [F.struct(F.lit("amount").alias("kind"), F.abs(F.col(m)).alias("value")) for m in [*METRICS, "free_cash_flow"]]
    margins = [F.struct(F.lit("percent").alias("kind"), F.when(F.col("age") <= 2, F.abs(ratio(m, "revenue") * 100)).alias("value"))
               for m in ("gross_profit", "operating_income", "net_income", "free_cash_flow")]
    growths = [F.struct(F.lit("percent").alias("kind"), F.when(F.col("age") == 1, F.abs(growth(m, f"_prior.{m}") * 100)).alias("value"))
               for m in grown]
    return rows.select("company_id", F.inline(F.array(*amounts, *margins, *growths))).where(F.col("value").isNotNull())
