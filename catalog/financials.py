"""Financial tables (M1-M10, M25, M26 and the windows and joins inside them)."""

from pyspark.sql import functions as F

from folioscope.plans import metrics, twins

from .views import sql


def _facts(spark, d):
    return twins.facts(spark, d)


def _rows(spark, d):
    return metrics.column_table(twins.facts(spark, d), twins.filings(spark, d))


def latest_filed_wins(spark, d):
    return metrics.metric_slots(_facts(spark, d)).select(
        "company_id", "canonical_metric", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", "value")


def ytd_to_discrete_quarters(spark, d):
    cells = metrics.discrete(metrics.fiscal_spread(metrics.metric_slots(_facts(spark, d))))
    return cells.select("company_id", "canonical_metric", F.col("fiscal_year").cast("long").alias("fiscal_year"),
                        F.col("period").alias("fiscal_period"), "value", F.col("derived").cast("int").alias("derived"))


def _table(kind, profile):
    def run(spark, d):
        t = metrics.financial_table(_rows(spark, d), kind, profile)
        return t.select("company_id", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", "row_key", "value")
    return run


def company_profile(spark, d):
    return metrics.company_profile(_rows(spark, d)).select(
        "company_id", F.col("latest_year").cast("long").alias("latest_year"), F.col("is_bank").cast("int").alias("is_bank"),
        "interim_kind", "anchor_revenue", "anchor_operating_income")


def earnings_bridge(spark, d):
    return metrics.earnings_bridge(_rows(spark, d)).withColumn("fiscal_year", F.col("fiscal_year").cast("long"))


def bank_bridge(spark, d):
    rows = _rows(spark, d).where("is_bank")
    return metrics.bank_bridge(rows).select(
        "company_id", F.col("fiscal_year").cast("long").alias("fiscal_year"), "period", "revenue", "pretax_income", "net_income",
        "other_items", "cost_income_ratio")


def latest_non_null(spark, d):
    t = metrics.financial_table(_rows(spark, d), "quarterly", "general")
    return metrics.latest_non_null(t).withColumn("fiscal_year", F.col("fiscal_year").cast("long"))


SERIES = ["revenue", "operating_income", "net_income", "free_cash_flow"]


def chart_series(spark, d):
    t = metrics.financial_table(_rows(spark, d), "annual", "general")
    return metrics.chart_series(t, SERIES).withColumn("fiscal_year", F.col("fiscal_year").cast("long"))


def headline_metrics(spark, d):
    h = metrics.headline_metrics(_facts(spark, d))
    return h.select("company_id", "filing_id", "metric", F.col("period_months").cast("long").alias("period_months"),
                    F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "value")


QUERIES = {
    "latest_filed_wins": latest_filed_wins,
    "ytd_to_discrete_quarters": ytd_to_discrete_quarters,
    "annual_financial_table": _table("annual", "general"),
    "interim_financial_table": _table("quarterly", "general"),
    "bank_annual_table": _table("annual", "bank"),
    "bank_interim_table": _table("quarterly", "bank"),
    "company_profile": company_profile,
    "earnings_bridge": earnings_bridge,
    "bank_bridge": bank_bridge,
    "latest_non_null": latest_non_null,
    "chart_series": chart_series,
    "headline_metrics": headline_metrics,
}


def _table_sql(view, annual, bank):
    periods = "p = 'FY' AND age <= 5" if annual else "p <> 'FY' AND age <= 8"
    return sql(f"""
        SELECT company_id, fy AS fiscal_year, p AS fiscal_period, k AS row_key, v AS value FROM (
            SELECT *, max(v) OVER (PARTITION BY company_id, k) AS filled FROM (
                SELECT company_id, fy, p, c.k AS k, c.v AS v FROM {view} WHERE {periods} AND is_bank = {bank}) AS a) AS b
        WHERE filled IS NOT NULL""")


ORACLES = {
    "latest_filed_wins": sql("SELECT company_id, canonical_metric, fiscal_year, fiscal_period, value FROM slot"),
    "ytd_to_discrete_quarters": sql("""SELECT company_id, m AS canonical_metric, fy AS fiscal_year, p AS fiscal_period,
                                              v AS value, d::int AS derived FROM cell"""),
    "annual_financial_table": _table_sql("general_cell", True, "false"),
    "interim_financial_table": _table_sql("general_cell", False, "false"),
    "bank_annual_table": _table_sql("bank_cell", True, "true"),
    "bank_interim_table": _table_sql("bank_cell", False, "true"),
    "company_profile": sql("""SELECT company_id, last_fy AS latest_year, is_bank::int AS is_bank, interim_kind, anchor_revenue,
                                     anchor_operating_income FROM profile"""),
    "earnings_bridge": sql("""
        SELECT company_id, fy AS fiscal_year, p AS period, operating_income, pretax_income - operating_income AS non_operating,
               pretax_income, income_tax, net_income,
               (pretax_income - operating_income) / nullif(pretax_income, 0) AS non_operating_share_of_pretax
        FROM wide WHERE operating_income IS NOT NULL AND net_income IS NOT NULL"""),
    "bank_bridge": sql("""
        SELECT w.company_id, fy AS fiscal_year, p AS period, revenue, pretax_income, net_income,
               cast(NULL AS double) AS other_items, cast(NULL AS double) AS cost_income_ratio
        FROM wide AS w JOIN profile ON profile.company_id = w.company_id
        WHERE is_bank AND revenue IS NOT NULL AND net_income IS NOT NULL"""),
    "latest_non_null": sql("""
        SELECT company_id, k AS row_key, fy AS fiscal_year, p AS fiscal_period, v AS value FROM (
            SELECT company_id, fy, p, c.k AS k, c.v AS v,
                   row_number() OVER (PARTITION BY company_id, c.k ORDER BY age) AS rn
            FROM general_cell WHERE p <> 'FY' AND age <= 8 AND NOT is_bank AND c.v IS NOT NULL) AS a
        WHERE rn = 1"""),
    "chart_series": sql("SELECT company_id, fy AS fiscal_year, p AS fiscal_period, " + ", ".join(
        f"max(c.v) FILTER (c.k = '{s}') AS {s}" for s in SERIES) + """
        FROM general_cell WHERE p = 'FY' AND age <= 5 AND NOT is_bank GROUP BY ALL"""),
    "headline_metrics": sql("""
        SELECT company_id, filing_id, canonical_metric AS metric, period_months,
               strftime(period_end, '%Y-%m-%d') AS period_end, value FROM fact
        WHERE NOT is_comparative AND canonical_metric IN ('revenue', 'gross_profit', 'operating_income', 'net_income',
              'operating_cash_flow', 'capex', 'cash', 'total_assets')"""),
}
