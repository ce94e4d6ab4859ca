"""Financial tables: every metric by fiscal period, ratios, bridges and layouts.

One company's history is small once restated values are resolved (metrics x
periods), so the plan is: reduce to one row per slot with a partial aggregate,
shuffle once by company, and do everything after that inside the company's
partition.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.arith import col, gather, growth, literal_map, ratio, sum_present
from ..functions.periods import fiscal_label
from ..operators.latest import latest_filed

METRICS = [row[0] for row in fv.METRIC_TABLE]
INSTANTS = [row[0] for row in fv.METRIC_TABLE if row[2] == "instant"]
LABELS = ["Q1", "Q2", "Q3", "Q4", "H1", "H2", "9M", "FY"]
PERIODS = ["FY", "Q1", "Q2", "Q3", "Q4", "H1", "H2"]
PERIOD_RANK = {"H1": 1, "H2": 2, "Q1": 1, "Q2": 2, "Q3": 3, "Q4": 4, "FY": 5}
GENERAL = fv.GENERAL_ROWS
BANK = fv.BANK_ROWS
KEYS = ["company_id", "fiscal_year", "period"]


def metric_slots(facts):
    """Latest filed value per (company, metric, span); then one value per fiscal label (M1, A2)."""
    labelled = facts.where(
        F.col("canonical_metric").isNotNull() & F.col("fiscal_year").isNotNull() & F.col("fiscal_period").isNotNull())
    slots = latest_filed(
        labelled, ["company_id", "canonical_metric", "period_start", "period_end"],
        columns=["company_id", "canonical_metric", "period_start", "period_end", "fiscal_year", "fiscal_period", "value",
                 "filing_date", "fact_id"])
    order = F.struct("filing_date", "period_end", (-F.unix_date(F.coalesce("period_start", "period_end"))).alias("span"))
    return (
        slots.groupBy("company_id", "canonical_metric", "fiscal_year", "fiscal_period")
        .agg(F.max_by("value", order).alias("value"))
    )


def fiscal_spread(slots):
    """One row per (company, metric, year) with a column per fiscal label."""
    by = [F.max(F.when(F.col("fiscal_period") == p, F.col("value"))).alias(p) for p in LABELS]
    return gather(slots, "company_id").groupBy("company_id", "canonical_metric", "fiscal_year").agg(*by)


def discrete(spread):
    """Quarters and halves, derived from year-to-date figures where they are not tagged.

    Balances stand at the end of the period; per-share amounts are never derived.
    """
    instant = F.col("canonical_metric").isin(INSTANTS)
    derivable = ~instant & ~F.col("canonical_metric").isin(fv.NOT_DERIVABLE)

    def flow(tagged, whole, part):
        return F.coalesce(F.col(tagged), F.when(derivable, F.col(whole) - F.col(part)))

    values = {
        "FY": F.col("FY"), "Q1": F.col("Q1"),
        "Q2": F.when(instant, F.col("Q2")).otherwise(flow("Q2", "H1", "Q1")),
        "Q3": F.when(instant, F.col("Q3")).otherwise(flow("Q3", "9M", "H1")),
        "Q4": F.when(instant, F.col("FY")).otherwise(flow("Q4", "FY", "9M")),
        "H1": F.when(instant, F.col("Q2")).otherwise(F.col("H1")),
        "H2": F.when(instant, F.col("FY")).otherwise(flow("H2", "FY", "H1")),
    }
    tagged = {p: F.when(instant, values[p]).otherwise(F.col(p)) for p in PERIODS}
    cells = F.array(*[
        F.struct(F.lit(p).alias("period"), values[p].alias("value"), (tagged[p].isNull() & values[p].isNotNull()).alias("derived"))
        for p in PERIODS])
    return (
        spread.select("company_id", "canonical_metric", "fiscal_year", F.inline(cells))
        .where(F.col("value").isNotNull())
    )


def wide(cells, metrics=None):
    """One row per (company, year, period) with a column per metric and the year-earlier row beside it.

    The prior year is read with a window over the company's own rows and kept
    only when it is the year before, so gaps stay NULL.
    """
    metrics = metrics or METRICS
    rows = cells.groupBy(*KEYS).agg(
        *[F.expr(f"max(CASE WHEN canonical_metric = '{m}' THEN value END) AS {m}") for m in metrics])
    w = Window.partitionBy("company_id", "period").orderBy("fiscal_year")
    prior = F.when(F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1, F.lag(F.struct(*metrics)).over(w))
    return rows.withColumn("prior", prior)


def with_opening_equity(rows):
    """The balance a period opened with: the previous period's close, the year before's for a first one."""
    years = Window.partitionBy("company_id").orderBy("fiscal_year")
    period = F.col("period")

    def closed(name, year):
        return F.max(F.when(period == name, F.col("equity"))).over(years.rangeBetween(year, year))

    opening = F.when(period.isin("FY", "H1", "Q1"), closed("FY", -1))
    for now, before in (("H2", "H1"), ("Q2", "Q1"), ("Q3", "Q2"), ("Q4", "Q3")):
        opening = opening.when(period == now, closed(before, 0))
    return rows.withColumn("equity_opening", opening)


def general_values(at=lambda m: F.col(m), before=lambda m: F.col(f"prior.{m}"), days=365.0):
    """The general rows as Columns; ``at`` reads a metric of the period, ``before`` of the year earlier."""
    revenue, cost = at("revenue"), at("cost_of_revenue")
    gross = F.coalesce(at("gross_profit"), revenue - cost)
    ocf, capex, net = at("operating_cash_flow"), at("capex"), at("net_income")
    fcf = ocf - F.abs(capex)
    current, noncurrent, total = at("debt_current"), at("long_term_debt_noncurrent"), at("long_term_debt")
    debt = (
        F.when(current.isNotNull() & noncurrent.isNotNull(), current + noncurrent)
        .when(total.isNotNull(), sum_present(total, at("commercial_paper")))
        .otherwise(sum_present(noncurrent, current))
    )
    inventory_cost = F.coalesce(cost, revenue - gross)
    computed = {
        "revenue_growth": growth(revenue, before("revenue")),
        "gross_profit": gross,
        "gross_margin": ratio(gross, revenue),
        "rnd_intensity": ratio(at("rnd"), revenue),
        "operating_margin": ratio(at("operating_income"), revenue),
        "effective_tax_rate": ratio(at("income_tax"), at("pretax_income")),
        "net_margin": ratio(net, revenue),
        "eps_growth": growth(at("eps_diluted"), before("eps_diluted")),
        "capex_intensity": ratio(capex, revenue),
        "free_cash_flow": fcf,
        "fcf_margin": ratio(fcf, revenue),
        "cash_conversion": F.when(net > 0, ratio(ocf, net)),
        "total_debt": debt,
        "net_cash": at("cash") - debt,
        "receivable_days": ratio(at("accounts_receivable"), revenue) * F.lit(days),
        "inventory_days": ratio(at("inventory"), inventory_cost) * F.lit(days),
    }
    return {row: computed[row] if row in computed else at(row) for row, *_ in GENERAL}


def bank_values(at=lambda m: F.col(m), before=lambda m: F.col(f"prior.{m}"), opening="equity_opening",
                period="period"):
    """The bank rows as Columns; flows are annualized for return on equity and the credit loss rate."""
    scale = F.element_at(literal_map(fv.ANNUALIZE), F.col(period))
    opening = col(opening)
    revenue, net, closing = at("revenue"), at("net_income"), at("equity")
    average = F.when(opening.isNull(), closing).otherwise((closing + opening) / 2)
    computed = {
        "revenue_growth": growth(revenue, before("revenue")),
        "nii_share": ratio(at("net_interest_income"), revenue),
        "cost_income_ratio": ratio(at("operating_expenses"), revenue),
        "effective_tax_rate": ratio(at("income_tax"), at("pretax_income")),
        "net_margin": ratio(net, revenue),
        "eps_growth": growth(at("eps_diluted"), before("eps_diluted")),
        "loans_to_deposits": ratio(at("loans"), at("deposits")),
        "credit_loss_rate": ratio(at("credit_loss_expense") * scale, at("loans")),
        "roe": ratio(net * scale, average),
    }
    return {row: computed[row] if row in computed else at(row) for row, *_ in BANK}


def is_anchor_period():
    return reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in fv.ANCHOR_METRICS])


def with_profile(rows, filings=None):
    """Each wide row with its company's profile: latest fiscal year, bank or not, interim kind (M3, M4, M5).

    The rows are already partitioned by company, so these are windows without a
    shuffle of their own.
    """
    company = Window.partitionBy("company_id")
    fy = is_anchor_period() & (F.col("period") == "FY")
    latest = F.max_by(F.struct("deposits", "total_assets", "net_interest_income", "revenue", "operating_income"),
                      F.when(fy, F.col("fiscal_year"))).over(company)

    def any_period(first):
        return F.max((is_anchor_period() & F.col("period").startswith(first)).cast("int")).over(company)

    out = (
        rows.withColumn("latest_year", F.max(F.when(fy, F.col("fiscal_year"))).over(company))
        .withColumn("_last", F.when(F.col("latest_year").isNotNull(), latest))
        .withColumn("_quarters", any_period("Q")).withColumn("_halves", any_period("H"))
    )
    bank = (F.coalesce(ratio("_last.deposits", "_last.total_assets") >= 0.3, F.lit(False))
            | F.coalesce(ratio("_last.net_interest_income", "_last.revenue") >= 0.25, F.lit(False)))
    out = (out.withColumn("is_bank", bank).withColumn("anchor_revenue", F.col("_last.revenue"))
           .withColumn("anchor_operating_income", F.col("_last.operating_income")))
    quarterly = F.lit(None).cast("int")
    if filings is not None:
        kinds = filings.where(~F.col("is_annual")).groupBy("company_id").agg(
            F.max((F.col("form_type").startswith("10-Q") | F.coalesce(F.col("period_months") == 3, F.lit(False))
                   | F.coalesce(F.col("fiscal_period").isin("Q1", "Q3"), F.lit(False))).cast("int")).alias("_files_quarterly"))
        out = out.join(kinds, "company_id", "left")
        quarterly = F.col("_files_quarterly")
    kind = F.coalesce(F.when((quarterly == 0) & (F.col("_halves") == 1), "half_yearly"),
                      F.when(F.col("_quarters") == 1, "quarterly"), F.when(F.col("_halves") == 1, "half_yearly"))
    return out.withColumn("interim_kind", kind).drop("_last", "_quarters", "_halves", "_files_quarterly")


def company_profile(rows):
    """One profile row per company."""
    return rows.groupBy("company_id").agg(*[
        F.first(c).alias(c) for c in ["latest_year", "is_bank", "interim_kind", "anchor_revenue", "anchor_operating_income"]])


def column_table(facts, filings=None):
    """Wide rows for all periods with the company's profile: the common input of the tables below."""
    return with_profile(with_opening_equity(wide(discrete(fiscal_spread(metric_slots(facts))))), filings)


def table_columns(rows, kind):
    """The last five fiscal years, or the last eight quarters or halves, of each company."""
    if kind == "annual":
        shown, n = F.col("period") == "FY", fv.ANNUAL_COLUMNS
    else:
        shown = F.col("period").startswith("Q") & (F.col("interim_kind") == "quarterly")
        shown = shown | (F.col("period").startswith("H") & (F.col("interim_kind") == "half_yearly"))
        n = fv.INTERIM_COLUMNS
    w = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"), F.desc("period"))
    return rows.where(shown & is_anchor_period()).withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def financial_table(rows, kind="annual", profile="general"):
    """The displayed table in long form, a row kept only when one of its cells has a value (M6, M7, M8)."""
    bank = profile == "bank"
    layout = BANK if bank else GENERAL
    columns = table_columns(rows.where(F.col("is_bank") == bank), kind)
    values = bank_values() if bank else general_values(days=fv.DAYS_IN["annual" if kind == "annual" else "quarterly"])
    cells = F.array(*[
        F.struct(F.lit(i).alias("row_order"), F.lit(key).alias("row_key"), F.lit(group).alias("row_group"),
                 F.lit(unit).alias("unit"), values[key].cast("double").alias("value"))
        for i, (key, group, unit) in enumerate(layout)])
    long = columns.select("company_id", "fiscal_year", F.col("period").alias("fiscal_period"), "age", F.inline(cells))
    filled = F.max(F.col("value")).over(Window.partitionBy("company_id", "row_order"))
    return long.withColumn("_any", filled).where(F.col("_any").isNotNull()).drop("_any")


def earnings_bridge(rows):
    """Operating income to net income (M9)."""
    operating, pretax, net = F.col("operating_income"), F.col("pretax_income"), F.col("net_income")
    other = F.coalesce(F.col("nonoperating_income"), pretax - operating)
    return rows.where(operating.isNotNull() & net.isNotNull()).select(
        *KEYS, "operating_income", other.alias("non_operating"), "pretax_income", "income_tax", "net_income",
        ratio(other, pretax).alias("non_operating_share_of_pretax"))


def bank_bridge(rows, share=0.005):
    """Revenue to net income for a bank, with what is left over as other items."""
    revenue, costs, pretax = F.col("revenue"), F.col("operating_expenses"), F.col("pretax_income")
    credit = F.col("credit_loss_expense")
    residual = pretax - (revenue - costs - F.coalesce(credit, F.lit(0.0)))
    return rows.where(revenue.isNotNull() & F.col("net_income").isNotNull()).select(
        *KEYS, "revenue", "net_interest_income", "fee_income", "noninterest_income", "credit_loss_expense",
        "operating_expenses", "pretax_income", "income_tax",
        F.when(F.abs(residual) > share * F.abs(revenue), residual).alias("other_items"), "net_income",
        ratio(costs, revenue).alias("cost_income_ratio"))


def latest_non_null(table):
    """The latest value of each table row with its period."""
    present = table.where(F.col("value").isNotNull())
    best = F.min_by(F.struct("fiscal_year", "fiscal_period", "value"), "age")
    return present.groupBy("company_id", "row_key").agg(best.alias("b")).select("company_id", "row_key", "b.*")


def chart_series(table, row_keys):
    """One row per period with a column per series; a series without any value is NULL throughout."""
    return table.groupBy("company_id", "fiscal_year", "fiscal_period").agg(
        *[F.max(F.when(F.col("row_key") == key, F.col("value"))).alias(key) for key in row_keys])


def headline_metrics(facts, filing_metrics=fv.HEADLINE_METRICS):
    """The filing's own headline values."""
    return facts.where(~F.col("is_comparative") & F.col("canonical_metric").isin(filing_metrics)).select(
        "company_id", "filing_id", F.col("canonical_metric").alias("metric"), "value", "currency", "period_start", "period_end",
        "fiscal_year", "fiscal_period", "period_months")


def with_label(df, period="period"):
    return df.withColumn("label", fiscal_label(col("fiscal_year"), col(period)))
