"""Reported-facts JSON, filing lists and what is read from them."""

from pyspark.sql import functions as F

from folioscope.operators import filings as fo
from folioscope.plans import twins
from folioscope.sources import companyfacts as cf
from folioscope.sources import listings as ls

from .changes import day
from .views import VIEWS, sql


def companyfacts_long(spark, d):
    f = cf.companyfacts_long(twins.companyfacts_json(spark, d))
    return f.select("company_id", "tag", day("start").alias("period_start"), day("end").alias("period_end"), "val", "form",
                    day("filed").alias("filed"), "fp")


def _series(spark, d):
    return cf.annual_series(cf.companyfacts_long(twins.companyfacts_json(spark, d)), twins.report_dates(spark, d, True))


SERIES = ["revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow", "capex", "cash", "rnd", "buybacks", "dividends", "eps_diluted",
          "long_term_debt", "free_cash_flow"]


def annual_series(spark, d):
    return _series(spark, d).select("company_id", day("end").alias("period_end"), *SERIES)


def annual_kpis(spark, d):
    return cf.annual_kpis(_series(spark, d)).select(
        "company_id", day("period_end").alias("period_end"), "revenue", "revenue_growth", "gross_margin", "net_margin", "fcf_margin", "cash",
        "eps_diluted", "eps_growth", "shareholder_returns", "long_term_debt")


def capital_deployment(spark, d):
    return cf.capital_deployment(_series(spark, d)).select("company_id", "name", "value")


def reference_lines(spark, d):
    return cf.reference_lines(_series(spark, d)).select("company_id", day("end").alias("period_end"), "line")


def figure_index(spark, d):
    return cf.figure_index(_series(spark, d)).groupBy("company_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))


def latest_quarter(spark, d):
    q = cf.latest_quarter(cf.companyfacts_long(twins.companyfacts_json(spark, d)), twins.report_dates(spark, d, False))
    return q.select("company_id", day("report_date").alias("report_date"), "revenue", "revenue_prior", "revenue_growth", "net_income",
                    "net_income_prior", "eps_diluted", "eps_diluted_prior", "fiscal_period")


def submissions_rows(spark, d):
    return ls.submissions_rows(twins.submissions_json(spark, d)).select(
        "company_id", "accession_number", "form_type", day("filing_date").alias("filing_date"), day("report_date").alias("report_date"),
        F.col("inline_xbrl").cast("int").alias("inline_xbrl"))


def listing_history(spark, d):
    rows = ls.with_history(ls.submissions_rows(twins.submissions_json(spark, d)))
    return rows.select("company_id", "accession_number", F.col("page").cast("long").alias("page"))


def find_filings(spark, d):
    return fo.find_filings(twins.listing(spark, d), 2).select("company_id", "form_type", "filing_id", F.col("form_rank").cast("long").alias("form_rank"))


def discover_filings(spark, d):
    return fo.discover(twins.listing(spark, d)).select("company_id", "filing_id", "form_type")


def companion_filings(spark, d):
    return fo.companions(twins.listing(spark, d)).select("company_id", "filing_id", day("annual_filing_date").alias("annual_date"))


def amendment_links(spark, d):
    return fo.amendment_links(twins.listing(spark, d)).select("filing_id", "amends_filing_id", day("original_date").alias("original_date"))


def text_retention(spark, d):
    other = (F.col("filing_id") % 5 == 0) & ~F.col("is_annual")
    return fo.retained_filings(twins.listing(spark, d).withColumn("form_type", F.when(other, "8-K").otherwise(F.col("form_type"))))


def fact_counts(spark, d):
    return fo.fact_counts(twins.filings(spark, d), twins.facts(spark, d)).select("filing_id", "fact_count")


def eviction_list(spark, d):
    c = twins.table(spark, d, "customer").select(
        F.col("c_custkey").alias("company_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("last_viewed"),
        F.col("c_nationkey").alias("updated_at"), (F.col("c_mktsegment") == "BUILDING").alias("is_showcase"))
    return fo.eviction_list(c, 100).select("company_id")


def _coverage(spark, d):
    sections = twins.table(spark, d, "labels").join(twins.table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").select(
        F.floor(F.col("doc_id") / 50).cast("long").alias("filing_id"),
        F.when(F.col("lang") == "en", F.array(F.lit("commitments"), F.lit("contingencies"))).when(F.col("lang") == "fr", F.array(F.lit("debt")))
        .when(F.col("lang") == "de", F.array(F.lit("risk_factors"))).otherwise(F.array(F.lit("management_discussion"))).alias("categories"),
        F.when(F.col("quality") == 1, 0.95).otherwise(0.5).alias("confidence"))
    filings = twins.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).cast("long").alias("filing_id")).distinct().select(
        "filing_id", (F.col("filing_id") % 2 == 0).alias("is_annual"), F.when(F.col("filing_id") % 2 == 0, "10-K").otherwise("10-Q").alias("form_type"),
        (F.col("filing_id") % 3 > 0).alias("has_tags"))
    metrics = twins.table(spark, d, "labels").select(F.floor(F.col("doc_id") / 50).cast("long").alias("filing_id"), F.when(
        F.col("doc_id") % 7 == 1, "revenue").when(F.col("doc_id") % 7 == 2, "net_income").otherwise("total_assets").alias("metric"))
    return fo.coverage_report(filings, sections, metrics), filings


def coverage_report(spark, d):
    return _coverage(spark, d)[0].withColumn("found", F.col("found").cast("int"))


def parser_confidence(spark, d):
    return fo.parser_confidence(*_coverage(spark, d))


def company_upsert(spark, d):
    c = twins.table(spark, d, "customer")
    old = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("cik"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
                                              F.col("c_name").alias("name"), (F.col("c_nationkey") < 5).alias("is_showcase"))
    new = c.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("cik"), F.when(F.col("c_nationkey") > 10, F.concat(F.lit("N"), F.col("c_custkey").cast("string"))).alias("ticker"),
        F.when(F.col("c_acctbal") > 5000, F.upper("c_name")).alias("name"), (F.col("c_nationkey") == 20).alias("is_showcase"))
    return fo.upsert_companies(old, new).withColumn("is_showcase", F.col("is_showcase").cast("int"))


def company_latest_profile(spark, d):
    listing = twins.listing(spark, d).withColumns({
        "reporting_currency": F.when(F.col("filing_id") % 3 > 0, F.when(F.col("filing_id") % 2 == 0, "USD").otherwise("EUR")),
        "accounting_standard": F.when(F.col("inline_xbrl"), "us-gaap"), "fiscal_year_end": F.date_format("period_end", "MM-dd")})
    companies = listing.select("company_id").distinct().select(
        "company_id", F.lit("CAD").alias("reporting_currency"), F.lit("ifrs").alias("accounting_standard"), F.lit("12-31").alias("fiscal_year_end"))
    return fo.latest_profile(listing, companies)


QUERIES = {f.__name__: f for f in [
    companyfacts_long, annual_series, annual_kpis, capital_deployment, reference_lines, figure_index, latest_quarter, submissions_rows,
    listing_history, find_filings, discover_filings, companion_filings, amendment_links, text_retention, fact_counts, eviction_list,
    coverage_report, parser_confidence, company_upsert, company_latest_profile]}

_GROWN = ["revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow", "free_cash_flow", "eps_diluted", "buybacks", "dividends",
          "capex", "rnd"]

VIEWS.update({
    "xfact": """
        SELECT * REPLACE (CASE canonical_metric WHEN 'cost_of_revenue' THEN 'rnd' WHEN 'pretax_income' THEN 'buybacks' WHEN 'income_tax' THEN 'dividends'
                            WHEN 'net_interest_income' THEN 'eps_diluted' WHEN 'accounts_receivable' THEN 'long_term_debt'
                            WHEN 'total_assets' THEN 'long_term_debt' ELSE canonical_metric END AS canonical_metric),
               canonical_metric AS reported,
               CASE WHEN canonical_metric IN ('revenue', 'capex') AND year(filing_date) >= 1998 OR canonical_metric = 'total_assets'
                    THEN 1 ELSE 0 END AS tag_rank,
               CASE WHEN is_annual THEN '10-K' ELSE '10-Q' END AS form FROM fact WHERE canonical_metric IS NOT NULL""",
    "annual_best": """
        SELECT company_id, canonical_metric AS m, period_end, min_by(value, (tag_rank, -epoch(filing_date), value)) AS v FROM xfact
        WHERE is_annual AND CASE WHEN canonical_metric IN ('cash', 'long_term_debt') THEN true ELSE period_months = 12 END
          AND canonical_metric NOT IN ('inventory', 'equity', 'deposits') GROUP BY ALL""",
    "annual_wide": """
        SELECT *, max(revenue) OVER (PARTITION BY company_id) IS NOT NULL AS has_revenue FROM (
            SELECT company_id, period_end, """ + ", ".join(f"max(v) FILTER (m = '{m}') AS {m}" for m in SERIES[:-1]) + """
            FROM annual_best GROUP BY ALL) AS w""",
    "annual_five": """
        SELECT *, operating_cash_flow - capex AS free_cash_flow FROM (
            SELECT w.*, row_number() OVER (PARTITION BY w.company_id ORDER BY w.period_end DESC) AS age,
                   lag(w.period_end) OVER (PARTITION BY w.company_id ORDER BY w.period_end) AS prior_end,
                   lag(w.eps_diluted) OVER (PARTITION BY w.company_id ORDER BY w.period_end) AS prior_eps,
                   lag(w.revenue) OVER (PARTITION BY w.company_id ORDER BY w.period_end) AS prior_revenue
            FROM annual_wide AS w
            JOIN (SELECT company_id, max(period_end) AS report_date FROM filing WHERE is_annual GROUP BY ALL) AS r USING (company_id)
            WHERE CASE WHEN has_revenue THEN revenue ELSE net_income END IS NOT NULL
              AND date_diff('day', report_date, w.period_end) <= 10) AS x
        WHERE age <= 5""",
    "figure": """
        SELECT company_id, 'amount' AS kind, abs(unnest([""" + ", ".join(SERIES) + """])) AS value FROM annual_five
        UNION ALL
        SELECT company_id, 'percent', abs(unnest([gross_profit, operating_income, net_income, free_cash_flow]) / nullif(revenue, 0) * 100)
        FROM annual_five WHERE age <= 2
        UNION ALL
        SELECT company_id, 'percent', abs((c - p) / nullif(abs(p), 0) * 100) FROM (
            SELECT company_id, age, """ + ", ".join(f"{m} AS c_{m}, lag({m}) OVER (PARTITION BY company_id ORDER BY period_end) AS p_{m}" for m in _GROWN) + """
            FROM annual_five) AS a, LATERAL (SELECT unnest([""" + ", ".join(f"c_{m}" for m in _GROWN) + """]) AS c, unnest([""" + ", ".join(
            f"p_{m}" for m in _GROWN) + """]) AS p) AS b WHERE age = 1""",
    "quarter_best": """
        SELECT company_id, canonical_metric AS m, period_end, min_by(value, (tag_rank, -epoch(filing_date), value)) AS v,
               min_by(fiscal_period, (tag_rank, -epoch(filing_date), value)) AS fp FROM xfact
        WHERE NOT is_annual AND canonical_metric IN ('revenue', 'net_income', 'eps_diluted') AND period_months = 3 GROUP BY ALL""",
    "listed": """
        SELECT o_custkey // 10 AS company_id, o_orderkey AS filing_id, 'A-' || o_orderkey AS accession_number,
               CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '6-K' END AS base_form,
               CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '6-K' END
               || CASE WHEN o_orderpriority = '1-URGENT' THEN '/A' ELSE '' END AS form_type, cast(o_orderdate AS date) AS filing_date,
               last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS report_date, o_orderkey % 2 = 0 AS inline_xbrl,
               o_orderstatus = 'F' AS annual_form, o_orderpriority = '1-URGENT' AS amended
        FROM orders""",
    "companion": """
        SELECT DISTINCT s.company_id, s.filing_id, a.filing_date AS annual_date
        FROM listed AS s JOIN listed AS a ON a.company_id = s.company_id AND a.report_date = s.report_date AND a.annual_form
             AND abs(date_diff('day', a.filing_date, s.filing_date)) <= 10
        WHERE s.base_form = '6-K'""",
    "readable": """
        SELECT *, row_number() OVER (PARTITION BY company_id, annual_form AND NOT amended ORDER BY filing_date DESC, filing_id DESC) AS k,
               row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, filing_id DESC) AS k_all
        FROM listed WHERE (base_form <> '6-K' OR inline_xbrl)
          AND filing_id NOT IN (SELECT c.filing_id FROM companion AS c JOIN listed AS l ON l.filing_id = c.filing_id WHERE l.inline_xbrl)""",
    "cutoff": """
        SELECT company_id, count(*) AS n, min_by(report_date, filing_date * 1 ) AS x FROM (
            SELECT company_id, report_date, epoch(filing_date) AS filing_date FROM readable WHERE annual_form AND NOT amended AND k <= 3) AS q
        GROUP BY company_id""",
    "cov_section": """
        SELECT doc_id // 50 AS filing_id, unnest(CASE lang WHEN 'en' THEN ['commitments', 'contingencies'] WHEN 'fr' THEN ['debt']
               WHEN 'de' THEN ['risk_factors'] ELSE ['management_discussion'] END) AS category,
               CASE WHEN quality = 1 THEN 0.95::double ELSE 0.5::double END AS confidence
        FROM labels JOIN documents USING (doc_id)""",
    "cov_filing": "SELECT DISTINCT doc_id // 50 AS filing_id FROM documents",
    "cov_expected": """
        SELECT filing_id, unnest(CASE WHEN filing_id % 2 = 0
               THEN ['management_discussion', 'risk_factors', 'commitments', 'debt', 'income_taxes', 'segment_information', 'business']
               ELSE ['management_discussion', 'commitments', 'debt'] END) AS category FROM cov_filing""",
    "cov_found": "SELECT filing_id, category, max(confidence) AS confidence FROM cov_section GROUP BY ALL",
    "cov_metric": """
        SELECT DISTINCT doc_id // 50 AS filing_id, CASE doc_id % 7 WHEN 1 THEN 'revenue' WHEN 2 THEN 'net_income' ELSE 'total_assets' END AS metric
        FROM labels""",
    "cov_report": """
        SELECT coalesce(e.filing_id, f.filing_id) AS filing_id, coalesce(e.category, f.category) AS category,
               (f.category IS NOT NULL)::int AS found, coalesce(f.confidence, 0) AS confidence, e.category IS NOT NULL AS expected
        FROM cov_expected AS e FULL OUTER JOIN cov_found AS f ON f.filing_id = e.filing_id AND f.category = e.category
        UNION ALL
        SELECT c.filing_id, 'financial_statements', (count(m.metric) > 0)::int, round(count(m.metric) / 3, 2), false
        FROM cov_filing AS c LEFT JOIN cov_metric AS m ON m.filing_id = c.filing_id GROUP BY c.filing_id""",
})

ORACLES = {
    "companyfacts_long": sql("""
        SELECT company_id, CASE WHEN reported = 'revenue' AND tag_rank = 1 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax'
                   WHEN reported = 'capex' AND tag_rank = 1 THEN 'PaymentsToAcquireProductiveAssets' ELSE CASE reported """ + " ".join(
                   f"WHEN '{m}' THEN '{t}'" for m, t in twins.FIRST_TAGS.items()) + """ END END AS tag,
               strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end, value AS val, form,
               strftime(filing_date, '%Y-%m-%d') AS filed, fiscal_period AS fp FROM xfact"""),
    "annual_series": sql("SELECT company_id, strftime(period_end, '%Y-%m-%d') AS period_end, " + ", ".join(SERIES) + " FROM annual_five"),
    "annual_kpis": sql("""
        SELECT company_id, strftime(period_end, '%Y-%m-%d') AS period_end, revenue,
               CASE WHEN date_diff('day', prior_end, period_end) BETWEEN 350 AND 380
                    THEN (revenue - prior_revenue) / nullif(abs(prior_revenue), 0) END AS revenue_growth,
               gross_profit / nullif(revenue, 0) AS gross_margin, net_income / nullif(revenue, 0) AS net_margin,
               free_cash_flow / nullif(revenue, 0) AS fcf_margin, cash, eps_diluted,
               CASE WHEN date_diff('day', prior_end, period_end) BETWEEN 350 AND 380
                    THEN (eps_diluted - prior_eps) / nullif(abs(prior_eps), 0) END AS eps_growth,
               CASE WHEN coalesce(buybacks, dividends) IS NOT NULL THEN coalesce(buybacks, 0) + coalesce(dividends, 0) END AS shareholder_returns,
               long_term_debt FROM annual_five WHERE age = 1"""),
    "capital_deployment": sql("""
        SELECT company_id, u.name, u.value FROM (
            SELECT company_id, unnest([{'name': 'Share Buybacks', 'value': buybacks}, {'name': 'Dividends', 'value': dividends},
                                       {'name': 'Capex', 'value': capex}]) AS u FROM annual_five WHERE age = 1) AS a WHERE u.value > 0"""),
    "reference_lines": sql("""
        SELECT company_id, strftime(period_end, '%Y-%m-%d') AS period_end, '- Fiscal year ended ' || strftime(period_end, '%Y-%m-%d') || ': '
               || array_to_string(list_transform(list_filter([""" + ", ".join(
                   f"{{'l': '{label}', 'v': {m if m in SERIES else 'NULL'}::double}}" for m, label in cf.REFERENCE_FIELDS.items()) + """],
                   lambda x: x.v <> 0), lambda x: x.l || ' ' || CASE WHEN x.v < 0 THEN '-' ELSE '' END || CASE
                   WHEN abs(x.v) >= 1e12 THEN printf('$%.2fT', abs(x.v) / 1e12) WHEN abs(x.v) >= 1e9 THEN printf('$%.1fB', abs(x.v) / 1e9)
                   WHEN abs(x.v) >= 1e6 THEN printf('$%.0fM', abs(x.v) / 1e6) ELSE '$' || format('{:,.2f}', abs(x.v)) END), '; ') AS line
        FROM annual_five WHERE age <= 2"""),
    "figure_index": sql("SELECT company_id, kind, count(value) AS n, max(value) AS largest FROM figure WHERE value IS NOT NULL GROUP BY ALL"),
    "latest_quarter": sql("""
        SELECT r.company_id, strftime(r.report_date, '%Y-%m-%d') AS report_date, c.revenue,
               p.revenue AS revenue_prior, (c.revenue - p.revenue) / nullif(abs(p.revenue), 0) AS revenue_growth, c.net_income,
               p.net_income AS net_income_prior, c.eps AS eps_diluted, p.eps AS eps_diluted_prior, c.fp AS fiscal_period
        FROM (SELECT company_id, max(period_end) AS report_date FROM filing WHERE NOT is_annual GROUP BY ALL) AS r
        JOIN (SELECT company_id, period_end, max(v) FILTER (m = 'revenue') AS revenue, max(v) FILTER (m = 'net_income') AS net_income,
                     max(v) FILTER (m = 'eps_diluted') AS eps, max(fp) AS fp FROM quarter_best GROUP BY ALL) AS c ON c.company_id = r.company_id AND c.period_end = r.report_date
        LEFT JOIN (SELECT company_id, period_end, max(v) FILTER (m = 'revenue') AS revenue, max(v) FILTER (m = 'net_income') AS net_income,
                          max(v) FILTER (m = 'eps_diluted') AS eps FROM quarter_best GROUP BY ALL) AS p ON p.company_id = r.company_id
             AND date_diff('day', p.period_end, r.report_date) BETWEEN 357 AND 371"""),
    "submissions_rows": sql("""
        SELECT company_id, accession_number, form_type, strftime(filing_date, '%Y-%m-%d') AS filing_date,
               strftime(report_date, '%Y-%m-%d') AS report_date, inline_xbrl::int AS inline_xbrl FROM listed
        UNION ALL
        SELECT company_id, accession_number || '-b', '8-K', strftime(filing_date + 20, '%Y-%m-%d'), NULL, 0 FROM listed"""),
    "listing_history": sql("""
        SELECT l.company_id, u.accession_number, l.page FROM (
            SELECT company_id, page, coalesce(sum(n) OVER (PARTITION BY company_id ORDER BY page
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT company_id, 2001 - year(filing_date) AS page, count(*) FILTER (form_type = '10-K') AS n FROM listed GROUP BY ALL) AS c) AS l
        JOIN (SELECT company_id, 2001 - year(filing_date) AS page, accession_number FROM listed
              UNION ALL SELECT company_id, 2001 - year(filing_date), accession_number || '-b' FROM listed) AS u
             ON u.company_id = l.company_id AND u.page = l.page
        WHERE l.page = 0 OR l.before < 3"""),
    "find_filings": sql("""
        SELECT company_id, form_type, filing_id, form_rank FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, form_type ORDER BY filing_date DESC, filing_id DESC) AS form_rank FROM listed) AS x
        WHERE form_rank <= 2"""),
    "discover_filings": sql("""
        SELECT r.company_id, r.filing_id, r.form_type FROM readable AS r
        LEFT JOIN (SELECT company_id, count(*) AS n, max(report_date) FILTER (k = 2) AS second, arg_max(report_date, k) AS oldest
                   FROM readable WHERE annual_form AND NOT amended AND k <= 3 GROUP BY company_id) AS c ON c.company_id = r.company_id
        WHERE CASE WHEN c.n IS NULL THEN r.k_all <= 4
                   WHEN r.annual_form AND NOT r.amended AND r.k <= 3 THEN true
                   WHEN r.annual_form THEN r.report_date >= c.oldest
                   WHEN c.n >= 2 THEN r.report_date >= c.second ELSE true END"""),
    "companion_filings": sql("SELECT company_id, filing_id, strftime(annual_date, '%Y-%m-%d') AS annual_date FROM companion"),
    "amendment_links": sql("""
        SELECT filing_id, amends_filing_id, strftime(original_date, '%Y-%m-%d') AS original_date FROM (
            SELECT a.filing_id, o.filing_id AS amends_filing_id, o.filing_date AS original_date,
                   row_number() OVER (PARTITION BY a.filing_id ORDER BY o.filing_date DESC, o.filing_id DESC) AS n
            FROM listed AS a LEFT JOIN listed AS o ON o.company_id = a.company_id AND o.base_form = a.base_form
                 AND o.report_date = a.report_date AND NOT o.amended
            WHERE a.amended) AS x
        WHERE n = 1"""),
    "text_retention": sql("""
        SELECT company_id, filing_id FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, annual_form ORDER BY report_date DESC, filing_date DESC, filing_id DESC) AS n
            FROM listed WHERE CASE WHEN filing_id % 5 = 0 AND NOT annual_form THEN false ELSE NOT amended END) AS x
        WHERE n <= 2"""),
    "fact_counts": sql("""
        SELECT f.filing_id, count(x.fact_id) AS fact_count FROM filing AS f
        LEFT JOIN fact AS x ON x.filing_id = f.filing_id GROUP BY f.filing_id"""),
    "eviction_list": """
        SELECT c_custkey AS company_id FROM (
            SELECT *, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_nationkey DESC, c_custkey) AS n
            FROM customer WHERE c_mktsegment <> 'BUILDING') AS x
        WHERE n > 100""",
    "coverage_report": sql("SELECT filing_id, category, found, confidence FROM cov_report"),
    "parser_confidence": sql("""
        SELECT filing_id, parser_confidence, CASE WHEN parser_confidence >= 0.8 THEN 'high' WHEN parser_confidence >= 0.5 THEN 'medium'
               ELSE 'low' END AS confidence_level FROM (
            SELECT filing_id, round(CASE WHEN filing_id % 3 > 0 THEN 0.4::double ELSE 0.0::double END
                   + max(confidence) FILTER (category = 'financial_statements') * 0.35::double
                   + count(*) FILTER (expected AND found = 1) / CASE WHEN filing_id % 2 = 0 THEN 7 ELSE 3 END * 0.25::double, 3) AS parser_confidence
            FROM cov_report GROUP BY filing_id) AS x"""),
    "company_upsert": """
        SELECT coalesce(n.c_custkey, o.c_custkey) AS cik,
               coalesce(CASE WHEN n.c_nationkey > 10 THEN 'N' || n.c_custkey END, 'T' || o.c_custkey) AS ticker,
               coalesce(CASE WHEN n.c_acctbal > 5000 THEN upper(n.c_name) END, o.c_name) AS name,
               (coalesce(o.c_nationkey < 5, false) OR coalesce(n.c_nationkey = 20, false))::int AS is_showcase
        FROM (SELECT * FROM customer WHERE c_custkey % 3 > 0) AS o
        FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) AS n ON n.c_custkey = o.c_custkey""",
    "company_latest_profile": sql("""
        SELECT c.company_id, coalesce(CASE WHEN filing_id % 3 > 0 THEN CASE WHEN filing_id % 2 = 0 THEN 'USD' ELSE 'EUR' END END, 'CAD')
                   AS reporting_currency,
               coalesce(CASE WHEN inline_xbrl THEN 'us-gaap' END, 'ifrs') AS accounting_standard,
               coalesce(strftime(report_date, '%m-%d'), '12-31') AS fiscal_year_end
        FROM (SELECT DISTINCT company_id FROM listed) AS c
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY report_date DESC, filing_date DESC, filing_id DESC) AS n
                   FROM listed WHERE NOT amended) AS l ON l.company_id = c.company_id AND l.n = 1"""),
}
del VIEWS["cutoff"]
