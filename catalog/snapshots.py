"""The parts of the company documents, built, packed, stored as JSON and read again."""

from pyspark.sql import functions as F

from folioscope.plans import snapshot, twins

from .changes import ORACLES as CHANGES
from .views import VIEWS, sql
from .views_pages import ORACLES as PAGES
from .views_pages import group_views


def _part(spark, d, name, schema):
    inputs = snapshot.Inputs(twins.filings(spark, d), twins.facts(spark, d))
    return snapshot.unpacked(snapshot.packed(snapshot.part_rows(inputs, name), name), name, schema)


def snapshot_company(spark, d):
    rows = _part(spark, d, "company", "latest_filing bigint, previous_filing bigint, base_annual bigint, latest_year bigint, is_bank boolean, interim_kind string, interim_note string")
    return rows.withColumn("is_bank", F.col("is_bank").cast("int"))


def snapshot_filings(spark, d):
    return _part(spark, d, "filings", "place bigint, filing_id bigint, form_type string, period_end string, label string")


def _cells(name):
    def query(spark, d):
        return _part(spark, d, name, "profile string, row_key string, fiscal_year bigint, fiscal_period string, age bigint, value double")
    return query


def snapshot_capital(spark, d):
    return _part(spark, d, "capital", "section string, place bigint, line_key string, period_type string, value double, prior_value double")


def snapshot_breakdowns(spark, d):
    inputs = snapshot.Inputs(twins.filings(spark, d), twins.breakdown_facts(spark, d))
    inputs.rows = snapshot.Inputs(twins.filings(spark, d), twins.facts(spark, d)).rows
    rows = snapshot.packed(snapshot.part_rows(inputs, "breakdowns"), "breakdowns")
    found = snapshot.unpacked(rows, "breakdowns", "view string, family string, place bigint, fact_key string, value double, prior_value double, share_of_revenue double")
    return found.where("view = 'quarterly'").drop("view")


def snapshot_bridges(spark, d):
    return _part(spark, d, "bridges", "view string, fiscal_year bigint, period string, is_bank boolean, operating_income double, non_operating double, revenue double, "
                                      "pretax_income double, net_income double, items array<struct<fact_key:string,value:double>>").select(
        "company_id", "view", "fiscal_year", "period", F.col("is_bank").cast("int").alias("is_bank"), "operating_income", "non_operating", "revenue", "pretax_income",
        "net_income", F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.col("items")[0]["value"].alias("largest_item"))


def snapshot_changes(spark, d):
    rows = _part(spark, d, "changes", "change_id string, kind string, score double, tier string, change_type string, value double, base_value double, members bigint, "
                                      "related array<struct<change_id:string>>")
    return rows.where("kind = 'numeric'").select(
        "company_id", "change_id", "score", "tier", "change_type", "value", "base_value", "members",
        F.array_join(F.transform("related", lambda r: r.change_id), ", ").alias("related"))


def company_snapshots(spark, d):
    """Every company's whole document, by the names of its parts."""
    parts = snapshot.parts_table(snapshot.Inputs(twins.filings(spark, d), twins.facts(spark, d)))
    return snapshot.documents(parts).select("company_id", F.array_join(F.array_sort(F.json_object_keys("document")), ",").alias("parts"))


QUERIES = {"company_snapshots": company_snapshots, "snapshot_company": snapshot_company, "snapshot_filings": snapshot_filings, "snapshot_annual": _cells("annual"), "snapshot_interim": _cells("interim"),
           "snapshot_capital": snapshot_capital, "snapshot_breakdowns": snapshot_breakdowns, "snapshot_bridges": snapshot_bridges,
           "snapshot_changes": snapshot_changes}


def _cells_sql(periods):
    return sql(" UNION ALL ".join(f"""
        SELECT company_id, '{name}' AS profile, k AS row_key, fy AS fiscal_year, p AS fiscal_period, age, v AS value FROM (
            SELECT *, max(v) OVER (PARTITION BY company_id, k) AS filled FROM (
                SELECT company_id, fy, p, age, c.k AS k, c.v AS v FROM {view} WHERE {periods} AND is_bank = {bank}) AS a) AS b
        WHERE filled IS NOT NULL""" for name, view, bank in (("general", "general_cell", "false"), ("bank", "bank_cell", "true"))))


VIEWS.update({
    "latest_column": """
        SELECT *, CASE WHEN p = 'FY' THEN 'annual' ELSE 'quarterly' END AS "view" FROM (
            SELECT w.*, is_bank, row_number() OVER (PARTITION BY w.company_id, w.p = 'FY' ORDER BY w.fy DESC, w.p DESC) AS n
            FROM wide AS w JOIN profile USING (company_id)
            WHERE (revenue IS NOT NULL OR net_income IS NOT NULL) AND (w.p = 'FY' OR w.p LIKE 'Q%')) AS x
        WHERE n = 1""",
    "one_off": """
        SELECT company_id, fiscal_year AS fy, fiscal_period AS p, count(*) AS n, max_by(value, (abs(value), 0)) AS largest FROM (
            SELECT company_id, fiscal_year, fiscal_period, fact_key, max_by(value, (filing_date, fact_id)) AS value FROM fact
            WHERE category = 'investment' AND period_type = 'duration' AND fiscal_period IS NOT NULL GROUP BY ALL) AS a
        GROUP BY ALL""",
})

ORACLES = {
    "snapshot_company": sql("""
        SELECT b.company_id, latest_filing, previous_filing, annual_filing AS base_annual, last_fy AS latest_year, is_bank::int AS is_bank, interim_kind,
               CASE WHEN interim_kind IS NULL THEN 'no_tagged_quarters' END AS interim_note
        FROM bases AS b LEFT JOIN profile AS p ON p.company_id = b.company_id"""),
    "snapshot_filings": sql("""
        SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, filing_id DESC) AS place, filing_id, form_type,
               strftime(period_end, '%Y-%m-%d') AS period_end, CASE WHEN is_annual THEN 'FY' || fiscal_year ELSE fiscal_period || ' FY' || fiscal_year END AS label
        FROM filing"""),
    "snapshot_annual": _cells_sql("p = 'FY' AND age <= 5"),
    "snapshot_interim": _cells_sql("p <> 'FY' AND age <= 8"),
    "snapshot_capital": sql("""
        SELECT l.company_id, l.section, l.fact_key AS line_key, l.period_type, l.value, p.value AS prior_value,
               row_number() OVER (PARTITION BY l.company_id, l.section ORDER BY abs(l.value) DESC, length(l.fact_key), l.fact_key) AS place
        FROM slatest AS l JOIN sctx AS c ON c.company_id = l.company_id
        LEFT JOIN LATERAL (
            SELECT s.value FROM sspan AS s WHERE s.company_id = l.company_id AND s.fact_key = l.fact_key AND s.period_type = l.period_type
              AND s.period_months IS NOT DISTINCT FROM l.period_months AND s.period_end < l.period_end
              AND (l.period_type = 'instant' OR abs(date_diff('day', s.period_end, l.period_end) - 365) <= 10)
            ORDER BY s.period_end DESC LIMIT 1) AS p ON true
        WHERE l.period_end >= coalesce(c.annual_end, c.latest_end)"""),
    "snapshot_bridges": sql("""
        SELECT x.company_id, "view", x.fy AS fiscal_year, x.p AS period, is_bank::int AS is_bank,
               CASE WHEN NOT is_bank THEN operating_income END AS operating_income,
               CASE WHEN NOT is_bank THEN pretax_income - operating_income END AS non_operating, CASE WHEN is_bank THEN revenue END AS revenue, pretax_income,
               net_income, coalesce(n_items, 0) AS n_items, largest AS largest_item
        FROM latest_column AS x LEFT JOIN (SELECT * RENAME (n AS n_items) FROM one_off) AS o ON o.company_id = x.company_id AND o.fy = x.fy AND o.p = x.p
        WHERE net_income IS NOT NULL AND CASE WHEN is_bank THEN revenue IS NOT NULL ELSE operating_income IS NOT NULL END"""),
}

VIEWS.update({
    "plain_change": """
        SELECT company_id, fact_key || '|' || period_type AS change_id, 'numeric' AS kind, []::varchar[] AS stems, category, change_type, value, base_value, score, tier,
               false AS is_text, NULL::varchar AS itemized FROM scored WHERE change_type <> 'repeated'""",
    "plain_revenue": "SELECT company_id, anchor_revenue AS revenue FROM profile",
    **group_views("plain", "plain_change"),
})
ORACLES["snapshot_changes"] = sql("""
    SELECT company_id, group_id AS change_id, group_score AS score, group_tier AS tier, group_type AS change_type, lead_value AS value, lead_base AS base_value,
           members, related FROM plain_group""")
ORACLES["snapshot_breakdowns"] = f"SELECT company_id, family, place, fact_key, value, prior_value, share_of_revenue FROM ({PAGES['breakdown_view']}) AS b"
_PRESENT = {"company": ORACLES["snapshot_company"], "filings": ORACLES["snapshot_filings"], "annual": ORACLES["snapshot_annual"], "interim": ORACLES["snapshot_interim"],
            "capital": ORACLES["snapshot_capital"], "bridges": ORACLES["snapshot_bridges"]}
_CHANGED = f"SELECT company_id FROM ({ORACLES['snapshot_changes']}) AS n UNION SELECT company_id FROM ({CHANGES['derived_ratio_changes']}) AS r"
ORACLES["company_snapshots"] = "SELECT company_id, string_agg(part, ',' ORDER BY part) AS parts FROM (" + " UNION ALL ".join([
    *(f"SELECT DISTINCT company_id, '{name}' AS part FROM ({text}) AS p" for name, text in _PRESENT.items()),
    *(f"SELECT DISTINCT company_id, '{name}' AS part FROM ({_CHANGED}) AS p" for name in ("changes", "change_counts"))]) + ") AS x GROUP BY company_id"
