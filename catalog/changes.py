"""Change detection, bases, scores."""

from pyspark.sql import functions as F

from folioscope.operators import filings as filing_ops
from folioscope.operators import numeric_changes as nc
from folioscope.operators.latest import as_of_base, year_earlier
from folioscope.plans import metrics, twins

from .views import VIEWS, sql


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def report_bases(spark, d):
    b = filing_ops.report_bases(twins.filings(spark, d))
    return b.select("company_id", F.col("latest.filing_id").alias("latest_filing"), F.col("previous.filing_id").alias("previous_filing"),
                    F.col("annual.filing_id").alias("annual_filing"))


def report_targets(spark, d):
    t = filing_ops.report_targets(twins.filings(spark, d))
    return t.select("company_id", "filing_id", "form_type", day("period_end").alias("period_end"))


def _changes(spark, d):
    return nc.numeric_changes(twins.facts(spark, d), twins.filings(spark, d))


def numeric_changes(spark, d):
    return _changes(spark, d).select(
        "company_id", "change_type", "category", "fact_key", "period_type", "comparison", "value", "base_value", "annual_value",
        "change", "base_filing_id", "period_label", "base_period_label", F.when(F.col("series").isNotNull(), F.size("series")).cast("long").alias("points"),
        F.array_contains("flags", "subsequent_event").cast("int").alias("subsequent"))


def removed_lines(spark, d):
    return _changes(spark, d).where(F.col("change_type") == "removed").select("company_id", "fact_key", "base_filing_id", "base_value")


def _scored(spark, d):
    facts, filings = twins.facts(spark, d), twins.filings(spark, d)
    rows = metrics.column_table(facts, filings)
    return nc.without_bank_routine(nc.score_numeric(nc.numeric_changes(facts, filings), nc.anchors(rows, facts)))


def anchors(spark, d):
    facts = twins.facts(spark, d)
    a = nc.anchors(metrics.column_table(facts, twins.filings(spark, d)), facts)
    return a.select("company_id", "anchor_revenue", "anchor_operating_income", "anchor_total_assets",
                    F.col("anchor_bank").cast("int").alias("anchor_bank"))


def materiality_score(spark, d):
    s = _scored(spark, d)
    return s.select("company_id", "fact_key", "period_type", "change_type", "score", "tier")


def ranked_changes(spark, d):
    r = nc.ranked(_scored(spark, d))
    return r.select("company_id", "fact_key", "period_type", "tier", F.col("tier_position").cast("long").alias("tier_position"))


def hidden_changes(spark, d):
    return nc.hidden_changes(_scored(spark, d))


def change_counts(spark, d):
    return nc.change_counts(_scored(spark, d))


def derived_ratio_changes(spark, d):
    facts, filings = twins.facts(spark, d), twins.filings(spark, d)
    changes = nc.derived_changes(metrics.column_table(facts, filings), filing_ops.report_bases(filings))
    return changes.select("company_id", "fact_key", "value", "base_value", "change", "period_label")


def _spans(spark, d):
    facts = twins.facts(spark, d).where(F.col("period_type") == "duration")
    keys = ["company_id", "fact_key", "period_months"]
    return facts.groupBy(*keys, "period_end").agg(F.max_by("value", F.struct("filing_date", "fact_id")).alias("value")), keys


def year_earlier_match(spark, d):
    rows, keys = _spans(spark, d)
    out = year_earlier(rows, keys)
    return out.select("company_id", "fact_key", F.col("period_months").cast("long").alias("period_months"),
                      day("period_end").alias("period_end"), "value", "value_year_earlier")


def as_of_balance(spark, d):
    facts = twins.facts(spark, d).where(F.col("period_type") == "instant")
    keys = ["company_id", "fact_key"]
    rows = facts.groupBy(*keys, "period_end").agg(F.max_by("value", F.struct("filing_date", "fact_id")).alias("value"))
    out = as_of_base(rows, rows, keys, columns=("value",))
    return out.select(*keys, day("period_end").alias("period_end"), "value", "base_value", day("base_period_end").alias("base_end"))


QUERIES = {
    "report_bases": report_bases, "report_targets": report_targets, "numeric_changes": numeric_changes,
    "removed_lines": removed_lines, "anchors": anchors, "materiality_score": materiality_score,
    "ranked_changes": ranked_changes, "hidden_changes": hidden_changes, "change_counts": change_counts, "derived_ratio_changes": derived_ratio_changes,
    "year_earlier_match": year_earlier_match, "as_of_balance": as_of_balance,
}

VIEWS.update({
    "latest_report": "SELECT company_id, max(filing_id) AS latest_filing FROM filing GROUP BY company_id",
    "bases": """
        SELECT l.company_id, l.latest_filing, f.is_annual AS latest_annual, f.period_end AS latest_end,
               max(b.filing_id) AS previous_filing, max(b.period_end) AS previous_end,
               max_by(b.is_annual, b.filing_id) AS previous_annual,
               max(b.filing_id) FILTER (b.is_annual) AS annual_filing, max(b.period_end) FILTER (b.is_annual) AS annual_end
        FROM latest_report AS l JOIN filing AS f ON f.filing_id = l.latest_filing
        LEFT JOIN filing AS b ON b.company_id = l.company_id AND b.period_end < f.period_end
        GROUP BY ALL""",
    "tracked": """
        SELECT f.*, b.* EXCLUDE (company_id), f.filing_id = b.latest_filing AS in_latest,
               f.filing_id = b.latest_filing AND NOT f.is_comparative AS own
        FROM fact AS f JOIN bases AS b ON b.company_id = f.company_id
        WHERE f.canonical_metric IN ('revenue', 'gross_profit', 'operating_income', 'net_income', 'operating_cash_flow', 'capex',
                                     'cash', 'inventory', 'accounts_receivable') OR f.canonical_metric IS NULL""",
    "by_span": """
        SELECT *, fiscal_year::varchar AS fyt FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, fact_key, period_type, period_start, period_end
                                         ORDER BY filing_date DESC, fact_id DESC) AS rn FROM tracked) AS t
        WHERE rn = 1""",
    "own_flow": """
        SELECT * FROM (
            SELECT c.company_id, c.fact_key, c.value, c.period_months, c.subsequent, c.fiscal_year, c.fiscal_period,
                   b.value AS base_value, b.filing_id AS base_filing_id, b.fiscal_year AS bfy, b.fiscal_period AS bfp,
                   row_number() OVER (PARTITION BY c.company_id, c.fact_key ORDER BY b.value IS NULL,
                       CASE WHEN b.value IS NULL THEN 0 WHEN c.period_months = 3 THEN 0 ELSE 1 END, -c.period_months) AS rn
            FROM (SELECT *, max(period_end) OVER (PARTITION BY company_id, fact_key) AS last_end
                  FROM tracked WHERE own AND period_type = 'duration') AS c
            LEFT JOIN by_span AS b ON b.company_id = c.company_id AND b.fact_key = c.fact_key AND b.period_type = 'duration'
                 AND b.period_months = c.period_months AND abs(date_diff('day', b.period_end, c.period_end) - 365) <= 10
            WHERE c.period_end = c.last_end) AS x
        WHERE rn = 1""",
    "own_balance": """
        SELECT c.company_id, c.fact_key, c.value, c.subsequent, c.fiscal_year, c.fiscal_period, c.latest_annual,
               coalesce(p.value, e.value) AS base_value, coalesce(p.filing_id, e.filing_id) AS base_filing_id,
               CASE WHEN p.value IS NULL THEN e.fiscal_year ELSE p.fiscal_year END AS bfy,
               CASE WHEN p.value IS NULL THEN e.fiscal_period ELSE p.fiscal_period END AS bfp,
               CASE WHEN NOT c.latest_annual AND coalesce(p.value, e.value) IS NOT NULL THEN a.value END AS annual_value,
               CASE WHEN p.value IS NOT NULL AND c.latest_annual THEN 'annual_vs_annual'
                    WHEN p.value IS NOT NULL AND c.previous_annual THEN 'vs_annual' ELSE 'sequential' END AS comparison
        FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, fact_key ORDER BY period_end DESC) AS n
                             FROM tracked WHERE own AND period_type = 'instant') AS z WHERE n = 1) AS c
        LEFT JOIN by_span AS p ON p.company_id = c.company_id AND p.fact_key = c.fact_key AND p.period_type = 'instant'
             AND p.period_end = CASE WHEN c.latest_annual THEN c.annual_end ELSE c.previous_end END
        LEFT JOIN (SELECT s.*, row_number() OVER (PARTITION BY s.company_id, s.fact_key ORDER BY s.period_end DESC) AS k
                   FROM by_span AS s
                   JOIN (SELECT company_id, fact_key, max(period_end) FILTER (own) AS own_end FROM tracked
                         WHERE period_type = 'instant' GROUP BY ALL) AS o
                        ON o.company_id = s.company_id AND o.fact_key = s.fact_key
                   WHERE s.period_type = 'instant' AND s.period_end < o.own_end
                     AND EXISTS (SELECT 1 FROM tracked AS t WHERE t.company_id = s.company_id AND t.fact_key = s.fact_key
                                 AND t.period_end = s.period_end AND NOT t.own)) AS e
             ON e.company_id = c.company_id AND e.fact_key = c.fact_key AND e.k = 1
        LEFT JOIN by_span AS a ON a.company_id = c.company_id AND a.fact_key = c.fact_key AND a.period_type = 'instant'
             AND a.period_end = c.annual_end""",
    "line_state": """
        SELECT company_id, fact_key, period_type, any_value(category) AS category, any_value(previous_filing) AS previous_filing,
               bool_or(canonical_metric IS NOT NULL) AS is_metric, bool_or(NOT own) AS has_prior, bool_or(in_latest) AS any_latest
        FROM tracked GROUP BY ALL""",
    "compared": """
        SELECT company_id, fact_key, 'duration' AS period_type, value, base_value, NULL::double AS annual_value, base_filing_id,
               'year_over_year' AS comparison, subsequent, fiscal_year, fiscal_period, bfy, bfp, period_months FROM own_flow
        UNION ALL
        SELECT company_id, fact_key, 'instant', value, base_value, annual_value, base_filing_id, comparison, subsequent,
               fiscal_year, fiscal_period, bfy, bfp, NULL FROM own_balance""",
    "gone": """
        SELECT * FROM (
            SELECT t.*, row_number() OVER (PARTITION BY t.company_id, t.fact_key, t.period_type ORDER BY t.period_end DESC, t.period_start DESC) AS n
            FROM tracked AS t JOIN line_state AS s
                 ON s.company_id = t.company_id AND s.fact_key = t.fact_key AND s.period_type = t.period_type
            WHERE NOT s.any_latest AND NOT s.is_metric AND NOT t.is_comparative
              AND t.filing_id = CASE WHEN t.latest_annual THEN t.annual_filing
                                     WHEN NOT t.previous_annual THEN t.previous_filing END) AS g
        WHERE n = 1""",
    "points": """
        SELECT company_id, fact_key, period_type, period_months, least(count(*), 6) AS points FROM by_span GROUP BY ALL""",
    "change": """
        SELECT c.company_id, c.fact_key, c.period_type, s.category, c.comparison, c.value, c.base_value, c.annual_value,
               c.base_filing_id, c.subsequent::int AS subsequent,
               CASE WHEN c.base_value IS NULL THEN CASE WHEN NOT s.has_prior AND s.previous_filing IS NOT NULL THEN 'new' END
                    WHEN c.base_value = 0 THEN CASE WHEN c.value <> 0 THEN 'changed' ELSE 'repeated' END
                    WHEN abs((c.value - c.base_value) / abs(c.base_value)) >= 0.05 THEN 'changed' ELSE 'repeated' END AS change_type,
               (c.value - c.base_value) / nullif(abs(c.base_value), 0) AS change,
               CASE WHEN c.fiscal_period = 'FY' THEN 'FY' || c.fiscal_year ELSE c.fiscal_period || ' FY' || c.fiscal_year END AS period_label,
               CASE WHEN c.bfp = 'FY' THEN 'FY' || c.bfy ELSE c.bfp || ' FY' || c.bfy END AS base_period_label,
               p.points
        FROM compared AS c
        JOIN line_state AS s ON s.company_id = c.company_id AND s.fact_key = c.fact_key AND s.period_type = c.period_type
        LEFT JOIN points AS p ON p.company_id = c.company_id AND p.fact_key = c.fact_key AND p.period_type = c.period_type
             AND p.period_months IS NOT DISTINCT FROM c.period_months
        UNION ALL
        SELECT g.company_id, g.fact_key, g.period_type, g.category,
               CASE WHEN g.latest_annual THEN 'annual_vs_annual' ELSE 'sequential' END, NULL, g.value, NULL, g.filing_id, 0, 'removed',
               NULL, NULL, CASE WHEN g.fiscal_period = 'FY' THEN 'FY' || g.fiscal_year ELSE g.fiscal_period || ' FY' || g.fiscal_year END,
               NULL
        FROM gone AS g""",
    "scale": """
        SELECT p.company_id, p.is_bank, p.anchor_revenue AS rev, p.anchor_operating_income AS opi, a.assets
        FROM profile AS p LEFT JOIN (
            SELECT company_id, max_by(value, (period_end, filing_date, fact_id)) AS assets FROM fact
            WHERE canonical_metric = 'total_assets' GROUP BY company_id) AS a ON a.company_id = p.company_id""",
    "score_base": """
        SELECT c.*, s.*  EXCLUDE (company_id), coalesce(c.value, c.base_value) AS amount,
               CASE WHEN (c.category = 'financial_metric' OR c.period_type = 'duration' OR (s.is_bank AND c.period_type = 'instant'))
                         AND c.base_value IS NOT NULL
                    THEN coalesce(c.value, c.base_value) - c.base_value ELSE coalesce(c.value, c.base_value) END AS basis,
               s.is_bank AND c.period_type = 'instant' AS bank_balance
        FROM change AS c JOIN scale AS s ON s.company_id = c.company_id
        WHERE c.change_type IS NOT NULL
          AND NOT (s.is_bank AND c.fact_key IN ('metric.operating_cash_flow', 'metric.capex', 'metric.cash', 'metric.accounts_receivable'))""",
    "score_parts": """
        SELECT *, greatest(CASE WHEN NOT bank_balance THEN abs(basis) / nullif(abs(rev), 0) / 0.05::double END,
                           CASE WHEN NOT bank_balance AND rev <> 0 AND opi IS NOT NULL
                                THEN abs(basis) / nullif(greatest(abs(opi), abs(rev) * 0.02::double), 0) / 0.10::double END,
                           abs(basis) / nullif(abs(assets), 0) / 0.10::double) AS largest,
               abs(change) / 0.5::double AS moved,
               CASE WHEN coalesce(rev <> 0 AND abs(amount - coalesce(base_value, 0)) >= abs(rev) * 0.005::double, false)
                         OR abs(amount - coalesce(base_value, 0)) >= 1e9 THEN 1.0::double ELSE 0.3::double END AS damp
        FROM score_base""",
    "scored": """
        SELECT *, CASE WHEN score >= 0.7 THEN 'top' WHEN score >= 0.45 THEN 'notable' ELSE 'background' END AS tier FROM (
            SELECT *, round(least(1.0::double,
                0.35::double * coalesce(CASE WHEN largest <= 1 THEN largest * 0.7::double
                                     ELSE least(1.0::double, (largest - 1) * 0.3::double + 0.7::double) END, 0)
                + 0.25::double * CASE change_type WHEN 'new' THEN 1.0::double WHEN 'removed' THEN 0.6::double WHEN 'repeated' THEN 0.0::double
                    ELSE CASE WHEN change IS NULL THEN 1.0::double WHEN moved <= 1 THEN moved * 0.7::double
                              ELSE least(1.0::double, (moved - 1) * 0.3::double + 0.7::double) END * damp END
                + 0.2::double * CASE category WHEN 'guarantee' THEN 0.9::double WHEN 'commitment' THEN 0.7::double ELSE 0.6::double END
                + 0.1::double * CASE change_type WHEN 'new' THEN 1.0::double WHEN 'changed' THEN 0.6::double WHEN 'removed' THEN 0.5::double ELSE 0.1::double END
                + CASE WHEN subsequent = 1 THEN 0.1::double ELSE 0.0::double END
                + CASE WHEN change_type = 'new' AND category = 'guarantee' THEN 0.1::double ELSE 0.0::double END
                + CASE WHEN change_type = 'new' AND category = 'debt' THEN 0.1::double ELSE 0.0::double END), 3) AS score
            FROM score_parts) AS s""",
    "last_column": """
        SELECT x.*, f.is_annual AS latest_annual, f.filing_id,
               CASE WHEN f.is_annual THEN 365.0::double ELSE 91.25::double END AS days, pr.is_bank,
               coalesce(x.gross_profit, x.revenue - x.cost_of_revenue) AS gross,
               coalesce(x.p_gross_profit, x.p_revenue - x.p_cost_of_revenue) AS p_gross,
               row_number() OVER (PARTITION BY x.company_id ORDER BY x.fy DESC, x.p DESC) AS n
        FROM paired AS x JOIN latest_report AS l ON l.company_id = x.company_id
        JOIN filing AS f ON f.filing_id = l.latest_filing JOIN profile AS pr ON pr.company_id = x.company_id
        WHERE (x.revenue IS NOT NULL OR x.net_income IS NOT NULL)
          AND CASE WHEN f.is_annual THEN x.p = 'FY' ELSE x.p LIKE 'Q%' END""",
    "ratio_pair": """
        SELECT company_id, is_bank, p, fy, unnest([
            {b: 0, k: 'gross_margin', u: 'points', v: gross / nullif(revenue, 0), w: p_gross / nullif(p_revenue, 0)},
            {b: 0, k: 'operating_margin', u: 'points', v: operating_income / nullif(revenue, 0), w: p_operating_income / nullif(p_revenue, 0)},
            {b: 2, k: 'net_margin', u: 'points', v: net_income / nullif(revenue, 0), w: p_net_income / nullif(p_revenue, 0)},
            {b: 0, k: 'capex_intensity', u: 'points', v: capex / nullif(revenue, 0), w: p_capex / nullif(p_revenue, 0)},
            {b: 2, k: 'effective_tax_rate', u: 'points', v: income_tax / nullif(pretax_income, 0), w: p_income_tax / nullif(p_pretax_income, 0)},
            {b: 0, k: 'receivable_days', u: 'days', v: accounts_receivable / nullif(revenue, 0) * days,
             w: p_accounts_receivable / nullif(p_revenue, 0) * days},
            {b: 0, k: 'inventory_days', u: 'days', v: inventory / nullif(coalesce(cost_of_revenue, revenue - gross), 0) * days,
             w: p_inventory / nullif(coalesce(p_cost_of_revenue, p_revenue - p_gross), 0) * days},
            {b: 0, k: 'non_operating_share', u: 'points',
             v: CASE WHEN operating_income IS NOT NULL AND net_income IS NOT NULL AND pretax_income > 0
                          AND abs((pretax_income - operating_income) / pretax_income) <= 1
                     THEN (pretax_income - operating_income) / pretax_income END,
             w: CASE WHEN p_operating_income IS NOT NULL AND p_net_income IS NOT NULL AND p_pretax_income > 0
                          AND abs((p_pretax_income - p_operating_income) / p_pretax_income) <= 1
                     THEN (p_pretax_income - p_operating_income) / p_pretax_income END},
            {b: 0, k: 'accounts_receivable_vs_revenue', u: 'points', v: CASE WHEN (accounts_receivable - p_accounts_receivable)
                 / nullif(abs(p_accounts_receivable), 0) - (revenue - p_revenue) / nullif(abs(p_revenue), 0) >= 0.2::double
                 THEN (accounts_receivable - p_accounts_receivable) / nullif(abs(p_accounts_receivable), 0) END,
             w: (revenue - p_revenue) / nullif(abs(p_revenue), 0)},
            {b: 0, k: 'inventory_vs_revenue', u: 'points', v: CASE WHEN (inventory - p_inventory)
                 / nullif(abs(p_inventory), 0) - (revenue - p_revenue) / nullif(abs(p_revenue), 0) >= 0.2::double
                 THEN (inventory - p_inventory) / nullif(abs(p_inventory), 0) END,
             w: (revenue - p_revenue) / nullif(abs(p_revenue), 0)}]) AS c
        FROM last_column WHERE n = 1""",
})

_BAND = """
    SELECT company_id, fact_key, period_months, strftime(period_end, '%Y-%m-%d') AS period_end, value, value_year_earlier FROM (
        SELECT c.*, b.value AS value_year_earlier, row_number() OVER (
                   PARTITION BY c.company_id, c.fact_key, c.period_months, c.period_end
                   ORDER BY abs(date_diff('day', b.period_end, c.period_end) - 365), b.period_end) AS k
        FROM flow_span AS c LEFT JOIN flow_span AS b ON b.company_id = c.company_id AND b.fact_key = c.fact_key
             AND b.period_months = c.period_months AND abs(date_diff('day', b.period_end, c.period_end) - 365) <= 10) AS x
    WHERE k = 1"""
VIEWS["flow_span"] = """
    SELECT company_id, fact_key, period_months, period_end, max_by(value, (filing_date, fact_id)) AS value
    FROM fact WHERE period_type = 'duration' GROUP BY ALL"""
VIEWS["balance_point"] = """
    SELECT company_id, fact_key, period_end, max_by(value, (filing_date, fact_id)) AS value
    FROM fact WHERE period_type = 'instant' GROUP BY ALL"""

ORACLES = {
    "report_bases": sql("SELECT company_id, latest_filing, previous_filing, annual_filing FROM bases"),
    "report_targets": sql("""
        SELECT company_id, filing_id, form_type, strftime(period_end, '%Y-%m-%d') AS period_end FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, is_annual ORDER BY period_end DESC) AS n,
                   max(period_end) FILTER (is_annual) OVER (PARTITION BY company_id) AS annual_end FROM filing) AS x
        WHERE n = 1 AND (is_annual OR annual_end IS NULL OR period_end >= annual_end)"""),
    "numeric_changes": sql("""
        SELECT company_id, change_type, category, fact_key, period_type, comparison, value,
               base_value, annual_value, change, base_filing_id, period_label, base_period_label, points, subsequent
        FROM change WHERE change_type IS NOT NULL"""),
    "removed_lines": sql("SELECT company_id, fact_key, filing_id AS base_filing_id, value AS base_value FROM gone"),
    "anchors": sql("""SELECT company_id, rev AS anchor_revenue, opi AS anchor_operating_income, assets AS anchor_total_assets,
                             is_bank::int AS anchor_bank FROM scale"""),
    "materiality_score": sql("SELECT company_id, fact_key, period_type, change_type, score, tier FROM scored"),
    "ranked_changes": sql("""
        SELECT company_id, fact_key, period_type, tier, tier_position FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, tier ORDER BY score DESC, fact_key) AS tier_position
            FROM scored WHERE change_type <> 'repeated') AS x
        WHERE tier <> 'background' OR tier_position <= 40"""),
    "hidden_changes": sql("""
        SELECT company_id, greatest(count(*) - 40, 0) AS hidden FROM scored
        WHERE change_type <> 'repeated' AND tier = 'background' GROUP BY company_id"""),
    "change_counts": sql("""
        SELECT company_id, count(*) FILTER (tier = 'top') AS top, count(*) FILTER (tier = 'notable') AS notable,
               count(*) FILTER (tier = 'background') AS background, count(*) FILTER (change_type = 'new') AS new,
               count(*) FILTER (change_type = 'changed') AS changed, count(*) FILTER (change_type = 'removed') AS removed
        FROM scored WHERE change_type <> 'repeated' GROUP BY company_id"""),
    "derived_ratio_changes": sql("""
        SELECT company_id, 'derived.' || c.k AS fact_key, c.v AS value, c.w AS base_value, c.v - c.w AS change,
               CASE WHEN p = 'FY' THEN 'FY' || fy ELSE p || ' FY' || fy END AS period_label
        FROM ratio_pair
        WHERE abs(c.v - c.w) >= CASE WHEN c.u = 'days' THEN 5.0::double ELSE 0.01::double END
          AND (c.b = 2 OR NOT is_bank)"""),
    "year_earlier_match": sql(_BAND),
    "as_of_balance": sql("""
        SELECT c.company_id, c.fact_key, strftime(c.period_end, '%Y-%m-%d') AS period_end, c.value, b.value AS base_value,
               strftime(b.period_end, '%Y-%m-%d') AS base_end
        FROM balance_point AS c ASOF LEFT JOIN balance_point AS b
             ON b.company_id = c.company_id AND b.fact_key = c.fact_key AND b.period_end < c.period_end"""),
}
