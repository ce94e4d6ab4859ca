"""Facts of tagged filings as metrics and disclosure lines."""

from pyspark.sql import functions as F

from folioscope.operators import facts as fa
from folioscope.plans import twins
from folioscope.session import stored

from .changes import day
from .views import VIEWS, sql


def _profiled(spark, d):
    return fa.with_filing_profile(*twins.reported_facts(spark, d))


def filing_profile(spark, d):
    return _profiled(spark, d).select("filing_id", "standard", "reporting_currency", day("fy_start").alias("fy_start")).distinct()


def metric_facts(spark, d):
    f = fa.metric_facts(_profiled(spark, d), spark)
    return f.select("filing_id", "canonical_metric", "xbrl_concept", day("period_start").alias("period_start"), day("period_end").alias("period_end"), "value",
                    "currency", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", F.col("period_months").cast("long").alias("period_months"),
                    F.col("is_comparative").cast("int").alias("is_comparative"), "confidence")


def family_facts(spark, d):
    profiled = stored(_profiled(spark, d))
    f = fa.family_facts(profiled, fa.metric_facts(profiled, spark))
    return f.select("filing_id", "category", "fact_key", "label", day("period_start").alias("period_start"), day("period_end").alias("period_end"), "value",
                    "currency", "confidence")


QUERIES = {f.__name__: f for f in [filing_profile, metric_facts, family_facts]}

_TAGS = ", ".join(f"'{m}': 'us-gaap:{twins.first_tag(m)}'" for m in twins.TWIN_METRICS)

VIEWS.update({
    "tagged_value": f"""
        SELECT *, CASE WHEN canonical_metric = 'inventory' AND company_id % 5 = 0 THEN 'own:InventoryNet2'
                       ELSE (MAP {{{_TAGS}}})[canonical_metric] END AS concept,
               CASE WHEN canonical_metric IS NULL AND line % 2 = 0 THEN 'GBP' WHEN company_id % 4 = 3 THEN 'EUR' ELSE 'USD' END AS cur,
               period_start IS NULL AS instant
        FROM (SELECT *, string_split(fact_id, '|')[4]::int AS line FROM fact) AS f""",
    "filing_currency": """
        SELECT filing_id, arg_min(cur, (-(anchors > 0)::int, -anchors, -monetary, cur)) AS reporting FROM (
            SELECT filing_id, cur, count(*) FILTER (concept IN ('us-gaap:Revenues', 'us-gaap:Assets', 'us-gaap:NetIncomeLoss')) AS anchors, count(*) AS monetary
            FROM tagged_value GROUP BY ALL) AS a GROUP BY filing_id""",
})

ORACLES = {
    "filing_profile": sql("""
        SELECT DISTINCT v.filing_id, CASE WHEN max((v.concept IS NULL OR v.concept LIKE 'us-gaap:%')::int) OVER (PARTITION BY v.filing_id) = 1
                                          THEN 'us-gaap' ELSE 'other' END AS standard, reporting AS reporting_currency,
               strftime(make_date(f.fiscal_year, 1, 1), '%Y-%m-%d') AS fy_start
        FROM tagged_value AS v JOIN filing_currency AS c ON c.filing_id = v.filing_id JOIN filing AS f ON f.filing_id = v.filing_id"""),
    "metric_facts": sql("""
        SELECT filing_id, canonical_metric, concept AS xbrl_concept, strftime(period_start, '%Y-%m-%d') AS period_start,
               strftime(period_end, '%Y-%m-%d') AS period_end, value, cur AS currency, fiscal_year, fiscal_period, period_months,
               is_comparative::int AS is_comparative, round(CASE WHEN concept LIKE 'own:%' THEN 0.6::double ELSE 0.95::double END - CASE WHEN value > 90000 THEN 0.25::double ELSE 0.0::double END, 3) AS confidence
        FROM (SELECT v.*, row_number() OVER (PARTITION BY v.filing_id, canonical_metric, period_start, period_end ORDER BY fact_id) AS n
              FROM tagged_value AS v JOIN filing_currency AS c ON c.filing_id = v.filing_id AND c.reporting = v.cur
              WHERE canonical_metric IS NOT NULL) AS x WHERE n = 1"""),
    "family_facts": sql("""
        SELECT filing_id, category, category || CASE category WHEN 'commitment' THEN '.purchase_obligation' WHEN 'debt' THEN '.debt_instrument_face_amount'
                   WHEN 'guarantee' THEN '.guarantee_obligations_maximum_exposure' ELSE '.equity_method_investments' END || '.line_' || line AS fact_key,
               CASE category WHEN 'debt' THEN 'Debt principal: ' WHEN 'investment' THEN 'Equity-method investments: ' ELSE '' END || 'Line ' || line AS label,
               strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end, value, cur AS currency,
               round(0.9::double - CASE WHEN value > 90000 THEN 0.25::double ELSE 0.0::double END, 3) AS confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, line, period_start, period_end ORDER BY fact_id) AS n
              FROM tagged_value WHERE canonical_metric IS NULL) AS x WHERE n = 1"""),
}
