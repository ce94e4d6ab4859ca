"""Wording changes of companies, digests, snapshots, periods and small readers."""

from pyspark.sql import functions as F

from folioscope.functions import periods
from folioscope.functions import text as T
from folioscope.operators import filings as fo
from folioscope.operators import insights as ins
from folioscope.operators import numeric_changes as nc
from folioscope.operators import wording as w
from folioscope.plans import metrics, twins
from folioscope.session import stored
from folioscope.plans import views as pv
from folioscope.sources import listings as ls

from .search import VIEWS, sql
from .wording import outline_line


def _wording(spark, d):
    sections, filings = twins.disclosure_sections(spark, d)
    return w.wording_changes(sections, filings, fo.report_bases(filings))


def wording_changes(spark, d):
    return _wording(spark, d).select("company_id", "category", "change_type", "kind", F.col("position").cast("long").alias("position"),
                                     F.sha1("text").alias("hash"), F.size("flags").cast("long").alias("n_flags"))


def scored_wording(spark, d):
    found = _wording(spark, d)
    anchors = twins.table(spark, d, "documents").select(
        F.col("doc_id").alias("company_id"), F.lit("USD").alias("anchor_currency"), (F.col("n_chars") * 1e6).alias("anchor_revenue"),
        (F.col("n_chars") * 1e5).alias("anchor_operating_income"), (F.col("n_chars") * 2e6).alias("anchor_total_assets"), F.lit(False).alias("anchor_bank"))
    kept = ins.kept_wording(ins.score_wording(found, anchors))
    return kept.select("company_id", "category", "change_type", "score", "tier", "change_id", F.col("place").cast("long").alias("place"))


def digest_lines(spark, d):
    t = metrics.financial_table(metrics.column_table(twins.facts(spark, d), twins.filings(spark, d)))
    return ins.digest_lines(t, ["revenue", "net_income", "free_cash_flow"]).select("company_id", "line")


#: Budgets small enough that the documents exceed them.
BUDGETS = {"business": 600, "discussion_annual": 1500, "discussion_interim": 900, "risk_outline": 500, "risk_changes": 1200, "risk_updates": 700}


def extraction_inputs(spark, d):
    docs = twins.sections(spark, d)
    annual = F.col("doc_id") % 2 == 0
    filings = docs.select(
        F.col("doc_id").alias("filing_id"), F.col("source").alias("company_id"), F.when(annual, "10-K").otherwise("10-Q").alias("form_type"),
        (F.col("doc_id") % 20 + 2000).cast("int").alias("fiscal_year"), F.when(annual, "FY").otherwise("Q1").alias("fiscal_period"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 9000).cast("int")).alias("period_end"), annual.alias("is_annual"))
    companies = twins.table(spark, d, "documents").select(F.col("source").alias("company_id")).distinct().select(
        "company_id", F.concat(F.lit("Company "), "company_id").alias("name"), F.upper("company_id").alias("ticker"), F.lit(None).cast("string").alias("reporting_currency"))
    kinds = F.array_compact(F.array(F.lit("management_discussion"), F.when(F.col("doc_id") % 3 > 0, "business"), F.when(F.col("doc_id") % 5 > 0, "risk_factors")))
    sections = docs.select(F.col("doc_id").alias("filing_id"), F.lit(1).alias("ordinal"), "text", F.explode(kinds).alias("category"))
    # read twice; stored, the pairs are looked for once
    bases = stored(twins.section_pairs(spark, d).select(F.col("doc_id").alias("filing_id"), F.col("base_id").alias("base_filing_id")))
    out = ins.extraction_inputs(companies, filings, sections, bases, BUDGETS)
    return out.select("company_id", "filing_id", F.length("text").cast("long").alias("chars"), F.sha1("text").alias("hash"))


FIELDS = ("segments", "strategy", "drivers", "outlook", "upside", "downside", "risks", "non_operating", "business_summary")


def _extracted(spark, d):
    """Every document as an extracted item; sources whose name ends in 3 have no annual report read."""
    rank = F.col("doc_id") % 2
    items = twins.texts(spark, d, "documents").select(
        F.col("source").alias("company_id"), F.concat_ws("-", "source", rank).alias("accession_number"), rank.alias("filing_rank"),
        ((rank == 1) & ~F.col("source").endswith("3")).alias("is_annual"), F.col("doc_id").alias("position"),
        F.element_at(F.array(*map(F.lit, FIELDS)), (F.floor(F.col("doc_id") / 2) % len(FIELDS)).cast("int") + 1).alias("field"),
        F.when(F.col("doc_id") % 4 == 0, F.upper(F.substring("text", 1, 3))).otherwise(F.substring("text", 1, 3)).alias("headline"),
        F.sha1("text").alias("detail"))
    return items, items.select("company_id", "accession_number", "filing_rank", "is_annual").distinct()


def insight_lists(spark, d):
    items, read = _extracted(spark, d)
    out = ins.insight_lists(read, items.drop("filing_rank", "is_annual"))
    return out.select("company_id", "field", "position", "headline", "detail", F.col("place").cast("long").alias("place"))


def _digest(spark, d):
    """Every document as a change and as an extracted item of its source."""
    n = F.col("doc_id")
    changes = twins.texts(spark, d, "documents").select(
        F.col("source").alias("company_id"), n.cast("string").alias("change_id"), F.when(n % 4 == 0, "narrative").otherwise("numeric").alias("kind"),
        F.when(n % 4 == 1, "removed").otherwise("changed").alias("change_type"), F.col("lang").alias("category_label"), F.concat(F.lit("Line "), n).alias("label"), "text",
        (n % 40 / 8).alias("value"), F.when(n % 3 > 0, n % 24 / 8).alias("base_value"), F.when(n % 5 > 0, (n % 16 - 8) / 8).alias("change"),
        F.when(n % 2 == 0, "ratio").otherwise("days").alias("unit"), F.lit("USD").alias("currency"), F.concat(F.lit("FY"), n % 20 + 2000).alias("period_label"),
        F.concat(F.lit("FY"), n % 20 + 1999).alias("base_period_label"), (n % 100 / 100).alias("score"),
        F.when(n % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(n % 9 == 0, "noted").alias("note"))
    items, _ = _extracted(spark, d)
    items = items.withColumns({
        "report": F.concat(F.lit("report "), "filing_rank"), "status": F.when(F.col("position") % 3 == 0, "unverified").otherwise("verified"),
        "trend": F.lit("new"), "realized": F.col("position") % 4 < 2, "direction": F.lit("up")})
    return ins.digest_changes(changes).unionByName(ins.digest_items(items))


def digest_input(spark, d):
    return _digest(spark, d).select("company_id", "block", "place", "ref", "key", F.sha1("line").alias("hash"))


def digest_texts(spark, d):
    return ins.digest_text(_digest(spark, d)).select("company_id", F.length("text").cast("long").alias("chars"), F.sha1("text").alias("hash"))


def ranked_insights(spark, d):
    items, _ = _extracted(spark, d)
    ranked = items.select("company_id", F.col("position").alias("statement"), F.col("accession_number").alias("ref_filing"),
                          F.lower("headline").alias("ref_label"))
    return ins.ranked_insights(ranked, items.where("field = 'risks'")).select("company_id", "statement", "extracted_detail")


def base_reports(spark, d):
    changes = nc.numeric_changes(twins.facts(spark, d), twins.filings(spark, d)).where(F.col("change_type") == "changed")
    return ins.base_report(changes, twins.filings(spark, d)).select("company_id", "fact_key", "period_type", "base_period_label", "base_report_id")


def interim_notes(spark, d):
    filings = twins.filings(spark, d)
    profile = metrics.company_profile(metrics.column_table(twins.facts(spark, d), filings))
    return pv.interim_note(profile, filings)


def period_months(spark, d):
    o = twins.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("e"))
    spans = o.withColumn("s", F.date_sub("e", (F.col("o_custkey") % 400).cast("int") + 1))
    year = F.make_date(F.year("e"), F.lit(1), F.lit(1))
    return spans.select("o_orderkey", periods.period_months("s", "e").cast("long").alias("months"),
                        periods.fiscal_year(year, F.year("e"), "e").cast("long").alias("fiscal_year"))


def fiscal_labels(spark, d):
    o = twins.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    end = F.last_day("day")
    start = F.make_date(F.year("day"), F.lit(1), F.lit(1))
    return o.select("o_orderkey", periods.fiscal_period(start, start, end).alias("year_to_date"),
                    periods.fiscal_label(F.year("day"), periods.fiscal_period(start, F.lit(None).cast("date"), end)).alias("balance_label"))


def currency_detection(spark, d):
    return twins.texts(spark, d, "documents").select("doc_id", ins.detect_currency(F.concat_ws(" ", "text", F.when(
        F.col("doc_id") % 4 == 0, "CHF CHF CHF CHF CHF CHF").when(F.col("doc_id") % 4 == 1, "€ € € and £ £ £ £ £ £"))).alias("currency"))


def registrant_names(spark, d):
    p = twins.table(spark, d, "part")
    name = F.concat("p_name", F.lit(", "), F.when(F.col("p_size") % 3 == 0, "Corporation").when(F.col("p_size") % 3 == 1, "Company").otherwise("Limited."))
    return p.select("p_partkey", T.registrant_name(name).alias("conformed"), T.normalized_name(name).alias("normalized"))


def index_documents(spark, d):
    docs = ls.index_documents(twins.index_pages(spark, d))
    kept = fo.disclosure_documents(docs)
    return kept.select("filing_id", "url", "type", "role", F.col("size").cast("long").alias("size"))


def snapshot_freshness(spark, d):
    e = twins.table(spark, d, "events").select("event_id", (F.col("user_id") % 3).cast("int").alias("snapshot_version"), F.lit(1).alias("parser_version"),
                                               F.col("ts").alias("checked_at"))
    s = fo.snapshot_is_current(e, "2024-01-20 00:00:00", 2, 1)
    return s.select("event_id", F.col("is_current").cast("int").alias("is_current"))


def rewrite_list(spark, d):
    companies = twins.table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_acctbal").alias("last_viewed"))
    outputs = twins.table(spark, d, "orders").select(
        F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") == "F", "synthesize").otherwise("audit").alias("stage"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "backup").when(F.col("o_orderpriority") == "2-HIGH", "none").otherwise("main").alias("model"))
    return fo.needs_rewrite(companies, outputs, {"synthesize": "main", "audit": "main"}).select("company_id")


QUERIES = {f.__name__: f for f in [
    wording_changes, scored_wording, digest_lines, extraction_inputs, insight_lists, ranked_insights, digest_input, digest_texts, base_reports, interim_notes, period_months, fiscal_labels, currency_detection,
    registrant_names, index_documents, snapshot_freshness, rewrite_list]}

def _prose(limit):
    """The leading lines of each section text within a budget."""
    return f"""(SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM (
                SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS running FROM prose_line) AS p
            WHERE running <= {limit + 1} GROUP BY doc_id)"""


VIEWS.update({
    "titled": f"""
        SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS i FROM (
            SELECT doc_id, i, trim(regexp_replace(trim(line), '^[•●▪\\- ]+', '')) AS l FROM (
                SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM section) AS a) AS b) AS c
        WHERE {outline_line('l')} GROUP BY doc_id, l""",
    "outlined": f"""
        WITH RECURSIVE r AS (
            SELECT DISTINCT doc_id, 0::bigint AS i, 0 AS size, NULL::varchar AS l FROM titled
            UNION ALL
            SELECT doc_id, i, CASE WHEN fits THEN size + length(l) + 3 ELSE size END, CASE WHEN fits THEN l END FROM (
                SELECT r.doc_id, t.i, r.size, t.l, r.size + length(t.l) <= {BUDGETS['risk_outline']} AS fits
                FROM r JOIN titled AS t ON t.doc_id = r.doc_id AND t.i = r.i + 1) AS x)
        SELECT doc_id, string_agg('- ' || l, chr(10) ORDER BY i) AS t FROM r WHERE l IS NOT NULL GROUP BY doc_id""",
    "risk_block": f"""
        SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS t FROM (
            SELECT *, sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY n) AS running FROM (
                SELECT pair_id AS doc_id, '[' || change_type || '] ' || text AS block, row_number() OVER (
                           PARTITION BY pair_id ORDER BY (change_type <> 'new')::int, -coalesce(top_weight, 0), position) AS n
                FROM passage LEFT JOIN passage_trigger USING (pair_id, change_type, position)
                WHERE kind <> 'numbers' AND change_type <> 'removed') AS a) AS b
        WHERE running <= {BUDGETS['risk_changes'] + 2} GROUP BY doc_id""",
})

VIEWS.update({
    "extracted": f"""
        SELECT source AS company_id, doc_id % 2 AS filing_rank, doc_id % 2 = 1 AND source NOT LIKE '%3' AS is_annual, doc_id AS position,
               {list(FIELDS)}[(doc_id // 2) % {len(FIELDS)} + 1] AS field,
               CASE WHEN doc_id % 4 = 0 THEN upper(text[1:3]) ELSE text[1:3] END AS headline, sha1(text) AS detail FROM documents""",
})

VIEWS.update({
    "digested": r"""
        SELECT company_id, 0 AS block, 'FILING CHANGES, most material first' AS title, place, 'c' || place AS ref, n::varchar AS key,
               'c' || place || ' score ' || printf('%.2f', n % 100 / 100.0::double) || CASE WHEN n % 7 = 0 THEN ' [a, b]' ELSE '' END || ': ' || CASE
                   WHEN n % 4 = 0 THEN 'changed wording in ' || lang || ': "' || text[1:400] || '"'
                   WHEN n % 4 = 1 THEN name || ' no longer disclosed; was ' || base
                   ELSE 'changed: ' || name || ' ' || value || CASE WHEN n % 3 > 0 THEN ' from ' || base ELSE '' END || CASE WHEN n % 5 = 0 THEN ''
                        WHEN n % 2 = 0 THEN printf(' (%+.1f points)', (n % 16 - 8) * 12.5::double) ELSE printf(' (%+.0f days)', CASE WHEN n % 16 < 8 THEN -floor((8 - n % 16) / 8.0::double + 0.5::double) ELSE floor((n % 16 - 8) / 8.0::double + 0.5::double) END) END
                        || CASE WHEN n % 9 = 0 THEN '; noted' ELSE '' END END AS line
        FROM (SELECT source AS company_id, doc_id AS n, lang, text, 'Line ' || doc_id || ' (' || lang || ')' AS name,
                     CASE WHEN doc_id % 2 = 0 THEN printf('%.1f%%', doc_id % 40 * 12.5::double) ELSE printf('%.0f days', floor(doc_id % 40 / 8.0::double + 0.5::double)) END
                         || ' (FY' || (doc_id % 20 + 2000) || ')' AS value,
                     CASE WHEN doc_id % 3 = 0 THEN 'n/a' WHEN doc_id % 2 = 0 THEN printf('%.1f%%', doc_id % 24 * 12.5::double)
                          ELSE printf('%.0f days', floor(doc_id % 24 / 8.0::double + 0.5::double)) END || ' (FY' || (doc_id % 20 + 1999) || ')' AS base,
                     row_number() OVER (PARTITION BY source ORDER BY doc_id % 100 DESC, doc_id::varchar) AS place FROM documents) AS c
        WHERE place <= 25
        UNION ALL
        SELECT company_id, filing_rank + 1, 'EXTRACTED FROM THE report ' || filing_rank || ' (verified quotes)',
               row_number() OVER (PARTITION BY company_id, filing_rank ORDER BY list_position(['segments', 'strategy', 'drivers', 'outlook', 'upside', 'downside', 'risks', 'non_operating'], field), position),
               ref, filing_rank || '|' || headline, ref || ' ' || field || CASE WHEN field = 'drivers' THEN ' [up]'
                   WHEN field = 'risks' THEN CASE WHEN position % 4 < 2 THEN ' [new, has happened]' ELSE ' [new]' END ELSE '' END || ': ' || headline || ': ' || detail
        FROM (SELECT *, CASE field WHEN 'strategy' THEN 'g' WHEN 'downside' THEN 'w' ELSE field[1:1] END
                     || row_number() OVER (PARTITION BY company_id, field ORDER BY filing_rank, position) AS ref
              FROM extracted WHERE position % 3 > 0 AND field <> 'business_summary') AS e""",
})

ORACLES = {
    "digest_input": sql("SELECT company_id, block, place, ref, key, sha1(line) AS hash FROM digested"),
    "digest_texts": sql("""
        SELECT company_id, length(t) AS chars, sha1(t) AS hash FROM (
            SELECT company_id, string_agg(CASE WHEN place = 1 THEN chr(10) || title || chr(10) ELSE '' END || line, chr(10) ORDER BY block, place) AS t
            FROM digested GROUP BY company_id) AS x"""),
    "insight_lists": sql("""
        WITH read AS (SELECT company_id, min(filing_rank) AS latest, min(filing_rank) FILTER (is_annual) AS annual FROM extracted GROUP BY company_id),
        single AS (
            SELECT e.* FROM extracted AS e JOIN read USING (company_id)
            WHERE field IN ('drivers', 'upside', 'downside') AND filing_rank = latest OR field = 'segments' AND filing_rank = annual),
        merged AS (
            SELECT * FROM (
                SELECT e.*, row_number() OVER (PARTITION BY company_id, field, lower(headline) ORDER BY filing_rank, position) AS n FROM extracted AS e JOIN read USING (company_id)
                WHERE field IN ('strategy', 'outlook', 'non_operating', 'risks') OR field = 'segments' AND annual IS NULL) AS x
            WHERE n = 1),
        placed AS (
            SELECT company_id, field, position, headline, detail, filing_rank, true AS is_single FROM single
            UNION ALL SELECT company_id, field, position, headline, detail, filing_rank, false FROM merged)
        SELECT company_id, field, position, headline, detail, place FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, field ORDER BY filing_rank, position) AS place FROM placed) AS p
        WHERE is_single OR place <= CASE field WHEN 'risks' THEN 16 ELSE 6 END"""),
    "ranked_insights": sql("""
        SELECT r.company_id, r.position AS statement, k.detail AS extracted_detail FROM extracted AS r LEFT JOIN (
            SELECT company_id, filing_rank, headline, arg_max(detail, position) AS detail FROM extracted WHERE field = 'risks' GROUP BY ALL) AS k
        ON k.company_id = r.company_id AND k.filing_rank = r.filing_rank AND k.headline = lower(r.headline)"""),
    "extraction_inputs": sql(f"""
        SELECT company_id, filing_id, length(t) AS chars, sha1(t) AS hash FROM (
            SELECT d.source AS company_id, d.doc_id AS filing_id, concat_ws(chr(10) || chr(10),
                       'COMPANY: Company ' || d.source || ' (' || upper(d.source) || '). FILING: ' || CASE WHEN d.doc_id % 2 = 0 THEN '10-K for FY' ELSE '10-Q for Q1 FY' END
                       || (d.doc_id % 20 + 2000) || ', period ended ' || (DATE '2000-01-01' + (d.doc_id % 9000)::int)::date || '. Reporting currency: unknown.',
                       CASE WHEN d.doc_id % 3 > 0 THEN '=== BUSINESS DESCRIPTION ===' || chr(10) || coalesce(b.t, '') END,
                       '=== MANAGEMENT''S DISCUSSION AND ANALYSIS ===' || chr(10) || coalesce(CASE WHEN d.doc_id % 2 = 0 THEN ma.t ELSE mi.t END, ''),
                       CASE WHEN d.doc_id % 5 > 0 AND d.doc_id % 2 = 0 THEN '=== RISK FACTORS: OUTLINE ===' || chr(10) || coalesce(o.t, '') END,
                       CASE WHEN d.doc_id % 5 > 0 AND d.doc_id % 2 = 0 AND f.doc_id % 5 > 0 THEN '=== NEW OR CHANGED RISK FACTORS (since the ' || CASE WHEN f.doc_id % 2 = 0
                           THEN '10-K for FY' ELSE '10-Q for Q1 FY' END || (f.doc_id % 20 + 2000) || ') ===' || chr(10) || k.t END,
                       CASE WHEN d.doc_id % 5 > 0 AND d.doc_id % 2 = 1 THEN '=== RISK FACTOR UPDATES IN THIS QUARTERLY REPORT ===' || chr(10) || coalesce(u.t, '') END) AS t
            FROM documents AS d JOIN doc_pair AS p ON p.pair_id = d.doc_id LEFT JOIN documents AS f ON f.doc_id = p.base_id
            LEFT JOIN {_prose(BUDGETS['business'])} AS b ON b.doc_id = d.doc_id
            LEFT JOIN {_prose(BUDGETS['discussion_annual'])} AS ma ON ma.doc_id = d.doc_id
            LEFT JOIN {_prose(BUDGETS['discussion_interim'])} AS mi ON mi.doc_id = d.doc_id
            LEFT JOIN {_prose(BUDGETS['risk_updates'])} AS u ON u.doc_id = d.doc_id
            LEFT JOIN outlined AS o ON o.doc_id = d.doc_id LEFT JOIN risk_block AS k ON k.doc_id = d.doc_id) AS x"""),
    "digest_lines": sql("""
        SELECT company_id, replace(k, '_', ' ') || ': ' || string_agg('FY' || fy || ' ' || CASE WHEN v IS NULL THEN 'n/a' ELSE
                   CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs(v) >= 1e12 THEN printf('%.1fT', abs(v) / 1e12)
                   WHEN abs(v) >= 1e9 THEN printf('%.1fB', abs(v) / 1e9) WHEN abs(v) >= 1e6 THEN printf('%.1fM', abs(v) / 1e6)
                   ELSE format('{:,.0f}', abs(v)) END END, ' | ' ORDER BY age DESC) AS line
        FROM (SELECT company_id, fy, age, c.k AS k, c.v AS v, max(c.v) OVER (PARTITION BY company_id, c.k) AS filled
              FROM general_cell WHERE p = 'FY' AND age <= 5 AND NOT is_bank) AS x
        WHERE filled IS NOT NULL AND age <= 2 AND k IN ('revenue', 'net_income', 'free_cash_flow') GROUP BY company_id, k"""),
    "base_reports": sql("""
        SELECT c.company_id, c.fact_key, c.period_type, c.base_period_label, f.filing_id AS base_report_id FROM change AS c
        LEFT JOIN filing AS f ON f.company_id = c.company_id
             AND CASE WHEN f.fiscal_period = 'FY' THEN 'FY' || f.fiscal_year ELSE f.fiscal_period || ' FY' || f.fiscal_year END = c.base_period_label
        WHERE c.change_type = 'changed'"""),
    "interim_notes": sql("""SELECT company_id, interim_kind, CASE WHEN interim_kind IS NULL THEN 'no_tagged_quarters'
                                   WHEN interim_kind = 'half_yearly' THEN 'half_year_reports' END AS note FROM profile"""),
    "period_months": """
        SELECT o_orderkey, CASE WHEN n BETWEEN 80 AND 100 THEN 3 WHEN n BETWEEN 170 AND 196 THEN 6 WHEN n BETWEEN 260 AND 285 THEN 9
                                WHEN n BETWEEN 350 AND 380 THEN 12 ELSE greatest(1, round_even(n / 30.4375::double, 0))::bigint END AS months,
               (year(o_orderdate) + ceil(dayofyear(o_orderdate) / 365.25::double - 0.03::double) - 1)::bigint AS fiscal_year
        FROM (SELECT *, o_custkey % 400 + 1 AS n FROM orders) AS o""",
    "fiscal_labels": """
        SELECT o_orderkey, CASE month(o_orderdate) WHEN 3 THEN 'Q1' WHEN 6 THEN 'H1' WHEN 9 THEN '9M' WHEN 12 THEN 'FY' END AS year_to_date,
               CASE month(o_orderdate) WHEN 3 THEN 'Q1 FY' || year(o_orderdate) WHEN 6 THEN 'Q2 FY' || year(o_orderdate)
                    WHEN 9 THEN 'Q3 FY' || year(o_orderdate) WHEN 12 THEN 'FY' || year(o_orderdate) END AS balance_label
        FROM orders""",
    "registrant_names": """
        SELECT p_partkey, p_name || ' ' || CASE p_size % 3 WHEN 0 THEN 'Corp' WHEN 1 THEN 'Co' ELSE 'Ltd' END AS conformed,
               lower(p_name) || ' ' || CASE p_size % 3 WHEN 0 THEN 'corporation' WHEN 1 THEN 'company' ELSE 'limited' END AS normalized FROM part""",
    "index_documents": sql("""
        SELECT filing_id, 'https://www.sec.gov/Archives/edgar/data/' || company_id || '/' || replace(accession_number, '-', '') || '/main.htm' AS url,
               '10-K' AS type, 'primary' AS role, 1200 AS size FROM listed
        UNION ALL
        SELECT filing_id, 'https://www.sec.gov/Archives/edgar/data/' || company_id || '/' || replace(accession_number, '-', '') || '/ex99.htm',
               'EX-99.1', 'exhibit', filing_id % 30000 FROM listed WHERE filing_id % 30000 >= 15000"""),
    "snapshot_freshness": """
        SELECT event_id, (user_id % 3 = 2 AND epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) < 86400)::int AS is_current FROM events""",
    "rewrite_list": """
        SELECT c_custkey AS company_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
}
