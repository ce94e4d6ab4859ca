"""Shared SQL definitions of the table readings in ``folioscope.plans.twins``."""

import re

METRICS = ["revenue", "cost_of_revenue", "gross_profit", "operating_income", "pretax_income", "income_tax", "net_income",
           "operating_cash_flow", "capex", "cash", "accounts_receivable", "inventory", "total_assets", "equity", "deposits",
           "net_interest_income"]
METRIC_LIST = "[" + ", ".join(f"'{m}'" for m in METRICS) + "]"

VIEWS = {
    "line_items": """
        SELECT l_suppkey AS company_id, year(cast(o_orderdate AS date)) AS fy, quarter(cast(o_orderdate AS date)) AS q,
               l_partkey % 24 AS line, l_linenumber % 4 AS variant,
               cast(round(l_extendedprice * 100) AS bigint) AS cents,
               (l_partkey % 24) IN (9, 10, 11, 12, 13, 14, 16, 17, 18, 19) AS instant
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "filing": """
        SELECT DISTINCT company_id, company_id * 1000 + (fy - 1990) * 4 + q AS filing_id,
               CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form_type,
               last_day(make_date(fy, q * 3, 1)) + 30 AS filing_date,
               CASE WHEN q = 4 THEN make_date(fy, 1, 1) ELSE make_date(fy, q * 3 - 2, 1) END AS period_start,
               last_day(make_date(fy, q * 3, 1)) AS period_end, fy AS fiscal_year,
               CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END AS fiscal_period,
               CASE WHEN q = 4 THEN 12 ELSE 3 END AS period_months, q = 4 AS is_annual
        FROM line_items""",
    "fact_cents": """
        SELECT company_id, fy, q, line, instant, span, sum(cents) AS cents
        FROM (SELECT *, CASE WHEN variant = 0 THEN 'prior' WHEN variant = 3 AND NOT instant THEN 'ytd' ELSE 'own' END AS span
              FROM line_items) AS s
        GROUP BY ALL""",
    "fact": f"""
        SELECT company_id, company_id * 1000 + (fy - 1990) * 4 + q AS filing_id,
               last_day(make_date(fy, q * 3, 1)) + 30 AS filing_date, q = 4 AS is_annual,
               concat_ws('|', company_id, fy, q, line, span) AS fact_id,
               CASE WHEN line < 16 THEN {METRIC_LIST}[line + 1] END AS canonical_metric,
               CASE WHEN line < 16 THEN 'metric.' || {METRIC_LIST}[line + 1]
                    ELSE ['commitment', 'guarantee', 'debt', 'investment'][line % 4 + 1] || '.line_' || line END AS fact_key,
               CASE WHEN line < 16 THEN 'financial_metric'
                    ELSE ['commitment', 'guarantee', 'debt', 'investment'][line % 4 + 1] END AS category,
               cents / 100.0::double AS value, CASE WHEN instant THEN 'instant' ELSE 'duration' END AS period_type,
               CASE WHEN NOT instant THEN make_date(CASE WHEN span = 'prior' THEN fy - 1 ELSE fy END,
                                                    CASE WHEN span = 'ytd' THEN 1 ELSE q * 3 - 2 END, 1) END AS period_start,
               last_day(make_date(CASE WHEN span = 'prior' THEN fy - 1 ELSE fy END, q * 3, 1)) AS period_end,
               CASE WHEN span = 'prior' THEN fy - 1 ELSE fy END AS fiscal_year,
               CASE WHEN instant THEN CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || q END
                    WHEN span = 'ytd' THEN ['Q1', 'H1', '9M', 'FY'][q] ELSE 'Q' || q END AS fiscal_period,
               CASE WHEN instant THEN NULL WHEN span = 'ytd' THEN q * 3 ELSE 3 END AS period_months,
               span = 'prior' AS is_comparative, cents % 50 = 0 AS subsequent
        FROM fact_cents""",
    "slot": """
        SELECT company_id, canonical_metric, fiscal_year, fiscal_period, value FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, canonical_metric, fiscal_year, fiscal_period
                                         ORDER BY filing_date DESC, period_end DESC, coalesce(period_start, period_end)) AS pick
            FROM (SELECT *, row_number() OVER (PARTITION BY company_id, canonical_metric, period_start, period_end
                                               ORDER BY filing_date DESC, fact_id DESC) AS rn
                  FROM fact WHERE canonical_metric IS NOT NULL) AS a
            WHERE rn = 1) AS b
        WHERE pick = 1""",
    "spread": """
        SELECT company_id, canonical_metric AS m, fiscal_year AS fy,
               canonical_metric IN ('cash', 'accounts_receivable', 'inventory', 'total_assets', 'equity', 'deposits') AS inst,
               max(value) FILTER (fiscal_period = 'Q1') AS q1, max(value) FILTER (fiscal_period = 'Q2') AS q2,
               max(value) FILTER (fiscal_period = 'Q3') AS q3, max(value) FILTER (fiscal_period = 'Q4') AS q4,
               max(value) FILTER (fiscal_period = 'H1') AS h1, max(value) FILTER (fiscal_period = '9M') AS m9,
               max(value) FILTER (fiscal_period = 'FY') AS f
        FROM slot GROUP BY ALL""",
    "cell": """
        SELECT company_id, m, fy, p, v, d FROM (
            SELECT company_id, m, fy, 'FY' AS p, f AS v, false AS d FROM spread
            UNION ALL SELECT company_id, m, fy, 'Q1', q1, false FROM spread
            UNION ALL SELECT company_id, m, fy, 'Q2', CASE WHEN inst THEN q2 ELSE coalesce(q2, h1 - q1) END,
                             NOT inst AND q2 IS NULL FROM spread
            UNION ALL SELECT company_id, m, fy, 'Q3', CASE WHEN inst THEN q3 ELSE coalesce(q3, m9 - h1) END,
                             NOT inst AND q3 IS NULL FROM spread
            UNION ALL SELECT company_id, m, fy, 'Q4', CASE WHEN inst THEN f ELSE coalesce(q4, f - m9) END,
                             NOT inst AND q4 IS NULL FROM spread
            UNION ALL SELECT company_id, m, fy, 'H1', CASE WHEN inst THEN q2 ELSE h1 END, false FROM spread
            UNION ALL SELECT company_id, m, fy, 'H2', CASE WHEN inst THEN f ELSE f - h1 END, NOT inst FROM spread) AS u
        WHERE v IS NOT NULL""",
    "wide": "SELECT company_id, fy, p, " + ", ".join(
        f"max(v) FILTER (m = '{m}') AS {m}" for m in METRICS) + " FROM cell GROUP BY ALL",
    "paired": """
        SELECT w.*, b.company_id AS prior_company, b.revenue AS p_revenue, b.cost_of_revenue AS p_cost_of_revenue,
               b.gross_profit AS p_gross_profit, b.operating_income AS p_operating_income, b.net_income AS p_net_income,
               b.pretax_income AS p_pretax_income, b.income_tax AS p_income_tax, b.capex AS p_capex,
               b.accounts_receivable AS p_accounts_receivable, b.inventory AS p_inventory, o.equity AS opening
        FROM wide AS w
        LEFT JOIN wide AS b ON b.company_id = w.company_id AND b.p = w.p AND b.fy = w.fy - 1
        LEFT JOIN wide AS o ON o.company_id = w.company_id
             AND o.fy = CASE WHEN w.p IN ('FY', 'H1', 'Q1') THEN w.fy - 1 ELSE w.fy END
             AND o.p = CASE WHEN w.p IN ('FY', 'H1', 'Q1') THEN 'FY' WHEN w.p = 'H2' THEN 'H1'
                            WHEN w.p = 'Q2' THEN 'Q1' WHEN w.p = 'Q3' THEN 'Q2' ELSE 'Q3' END""",
    "latest_year": """
        SELECT company_id, max(fy) AS last_fy FROM wide
        WHERE p = 'FY' AND (revenue IS NOT NULL OR net_income IS NOT NULL) GROUP BY company_id""",
    "profile": """
        SELECT c.company_id, l.last_fy,
               coalesce(w.deposits / nullif(w.total_assets, 0) >= 0.3, false)
               OR coalesce(w.net_interest_income / nullif(w.revenue, 0) >= 0.25, false) AS is_bank,
               w.revenue AS anchor_revenue, w.operating_income AS anchor_operating_income,
               CASE WHEN c.quarters THEN 'quarterly' WHEN c.halves THEN 'half_yearly' END AS interim_kind
        FROM (SELECT company_id, bool_or(p LIKE 'Q%' AND (revenue IS NOT NULL OR net_income IS NOT NULL)) AS quarters,
                     bool_or(p LIKE 'H%' AND (revenue IS NOT NULL OR net_income IS NOT NULL)) AS halves
              FROM wide GROUP BY company_id) AS c
        LEFT JOIN latest_year AS l ON l.company_id = c.company_id
        LEFT JOIN wide AS w ON w.company_id = c.company_id AND w.fy = l.last_fy AND w.p = 'FY'""",
    "general_cell": """
        SELECT company_id, fy, p, is_bank, age, unnest([
            {k: 'revenue', v: revenue}, {k: 'revenue_growth', v: (revenue - p_revenue) / nullif(abs(p_revenue), 0)},
            {k: 'gross_profit', v: gross}, {k: 'gross_margin', v: gross / nullif(revenue, 0)},
            {k: 'operating_income', v: operating_income}, {k: 'operating_margin', v: operating_income / nullif(revenue, 0)},
            {k: 'pretax_income', v: pretax_income}, {k: 'effective_tax_rate', v: income_tax / nullif(pretax_income, 0)},
            {k: 'net_income', v: net_income}, {k: 'net_margin', v: net_income / nullif(revenue, 0)},
            {k: 'operating_cash_flow', v: operating_cash_flow}, {k: 'capex', v: capex},
            {k: 'capex_intensity', v: capex / nullif(revenue, 0)}, {k: 'free_cash_flow', v: operating_cash_flow - abs(capex)},
            {k: 'fcf_margin', v: (operating_cash_flow - abs(capex)) / nullif(revenue, 0)},
            {k: 'cash_conversion', v: CASE WHEN net_income > 0 THEN operating_cash_flow / nullif(net_income, 0) END},
            {k: 'cash', v: cash}, {k: 'accounts_receivable', v: accounts_receivable},
            {k: 'receivable_days', v: accounts_receivable / nullif(revenue, 0) * days},
            {k: 'inventory', v: inventory},
            {k: 'inventory_days', v: inventory / nullif(coalesce(cost_of_revenue, revenue - gross), 0) * days},
            {k: 'total_assets', v: total_assets}, {k: 'equity', v: equity}]) AS c
        FROM (SELECT *, coalesce(gross_profit, revenue - cost_of_revenue) AS gross,
                     CASE WHEN p = 'FY' THEN 365.0::double ELSE 91.25::double END AS days FROM columned) AS g""",
    "columned": """
        SELECT x.*, row_number() OVER (PARTITION BY x.company_id, x.p = 'FY' ORDER BY x.fy DESC, x.p DESC) AS age,
               profile.is_bank
        FROM paired AS x JOIN profile ON profile.company_id = x.company_id
        WHERE (x.p = 'FY' OR x.p LIKE 'Q%') AND (x.revenue IS NOT NULL OR x.net_income IS NOT NULL)""",
    "bank_cell": """
        SELECT company_id, fy, p, is_bank, age, unnest([
            {k: 'revenue', v: revenue}, {k: 'revenue_growth', v: (revenue - p_revenue) / nullif(abs(p_revenue), 0)},
            {k: 'net_interest_income', v: net_interest_income}, {k: 'nii_share', v: net_interest_income / nullif(revenue, 0)},
            {k: 'pretax_income', v: pretax_income}, {k: 'effective_tax_rate', v: income_tax / nullif(pretax_income, 0)},
            {k: 'net_income', v: net_income}, {k: 'net_margin', v: net_income / nullif(revenue, 0)},
            {k: 'deposits', v: deposits}, {k: 'total_assets', v: total_assets}, {k: 'equity', v: equity},
            {k: 'roe', v: net_income * CASE WHEN p = 'FY' THEN 1 ELSE 4 END
                          / nullif(CASE WHEN opening IS NULL THEN equity ELSE (equity + opening) / 2 END, 0)}]) AS c
        FROM columned""",
}


def sql(body):
    """The query with the views it uses (and those they use) put in front, in definition order."""
    used, text = set(), body
    pending = True
    while pending:
        found = {v for v in VIEWS if v not in used and re.search(rf"\b{v}\b", text)}
        pending = bool(found)
        used |= found
        text = body + " ".join(VIEWS[v] for v in used)
    order, done = [], set()

    def visit(name):
        if name in done:
            return
        done.add(name)
        for other in VIEWS:
            if other != name and other in used and re.search(rf"\b{other}\b", VIEWS[name]):
                visit(other)
        order.append(name)

    for name in used:
        visit(name)
    if not order:
        return body
    clauses = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order)
    head = body.lstrip()
    if head.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {clauses}, {head[15:]}"
    if head.upper().startswith("WITH "):
        return f"WITH {clauses}, {head[5:]}"
    return f"WITH {clauses} {body}"
