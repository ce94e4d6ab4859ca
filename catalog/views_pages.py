"""Renames, capital items, breakdowns, notes, grouping and the omission check."""

from pyspark.sql import functions as F

from folioscope.functions import fixed_values as fv
from folioscope.functions import text
from folioscope.operators import audit as au
from folioscope.operators import filings as fo
from folioscope.operators import grouping as gr
from folioscope.operators import numeric_changes as nc
from folioscope.operators import renames as rn
from folioscope.plans import metrics, twins
from folioscope.plans import views as pv
from folioscope.session import checkpointed, stored

from .changes import ORACLES as CHANGES
from .changes import _scored, day
from .views import VIEWS, sql
from .wording import _TRIGGER_LIST


_PHRASES = [phrase for _, phrase, _ in fv.TRIGGERS]
_PHRASE_LIST = "[" + ", ".join("'" + phrase.replace("'", "''") + "'" for phrase in _PHRASES) + "]"


def rename_bridge(spark, d):
    return rn.bridged_by_value(twins.renamed_facts(spark, d)).select("company_id", "old_key", "new_key")


def rename_by_words(spark, d):
    f = twins.renamed_facts(spark, d)
    return rn.bridged_by_words(f.where("NOT is_comparative"), f.where("NOT is_comparative").select("company_id", "filing_date", "form_type").distinct()).select(
        "company_id", "old_key", "new_key")


def alias_chain(spark, d):
    links = twins.table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 7).cast("long").alias("company_id"), F.col("p_partkey").cast("string").alias("old_key"),
        F.when(F.col("p_partkey") % 10 == 9, F.col("p_partkey") - 3).otherwise(F.col("p_partkey") + 1).cast("string").alias("new_key"))
    return rn.newest_keys(links)


def _capital(spark, d):
    filings = twins.filings(spark, d)
    return pv.capital_items(pv.sectioned(twins.facts(spark, d)), pv.capital_context(filings))


def capital_items(spark, d):
    return _capital(spark, d).select("company_id", "section", F.col("line_key").alias("fact_key"), "period_type", day("period_end").alias("period_end"),
                                     "value", "prior_value", "annual_value", "change_vs_prior", F.col("is_new").cast("int").alias("is_new"),
                                     F.size("series").cast("long").alias("points"))


def capital_sections(spark, d):
    return pv.capital_sections(_capital(spark, d)).select("company_id", "section", F.col("line_key").alias("fact_key"), "period_type",
                                                          F.col("place").cast("long").alias("place"), F.col("more").cast("long").alias("more"))


def breakdown_view(spark, d):
    rows = metrics.column_table(twins.facts(spark, d))
    v = pv.useful_breakdowns(pv.breakdown_view(twins.breakdown_facts(spark, d), rows, kind="quarterly"))
    return v.select("company_id", "family", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", "fact_key", "value",
                    "prior_value", "growth", "share_of_revenue", F.col("place").cast("long").alias("place"))


def _items(spark, d):
    f = twins.facts(spark, d).withColumn("category", F.when(F.col("category") == "guarantee", "unusual_item").otherwise(F.col("category")))
    return pv.one_off_items(f)


def one_off_items(spark, d):
    return _items(spark, d).select("company_id", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", "fact_key", "value",
                                   F.col("place").cast("long").alias("place"))


def mix_with_other(spark, d):
    lines = twins.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", twins.cents("l_extendedprice").alias("cents"))
    parts = twins.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    by = lines.join(parts, "l_partkey").groupBy("l_suppkey", "p_brand").agg(F.sum("cents").alias("value"))
    out = pv.mix_with_other(by, ["l_suppkey"], "p_brand")
    return out.select("l_suppkey", "p_brand", "value", F.col("place").cast("long").alias("place"), F.round("share", 9).alias("share"))


def _table(spark, d):
    return metrics.financial_table(metrics.column_table(twins.facts(spark, d), twins.filings(spark, d)), "quarterly")


def unusual_figures(spark, d):
    u = pv.unusual_cells(_table(spark, d))
    return u.select("company_id", "row_key", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", "kind", "value", "before", "after")


def explained_figures(spark, d):
    u = pv.unusual_cells(_table(spark, d))
    items = _items(spark, d).withColumn("xbrl_concept", F.when(F.col("value") > 30000, "x:ImpairmentLoss").otherwise("x:GainOnSale"))
    e = pv.explained_spikes(u, items)
    return e.select("company_id", "row_key", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", "kind",
                    F.col("item.value").alias("item_value"))


def payment_notes(spark, d):
    renamed = _table(spark, d).withColumn("row_key", F.when(F.col("row_key") == "operating_cash_flow", "dividends_paid")
                                          .when(F.col("row_key") == "capex", "buybacks").otherwise(F.col("row_key")))
    n = pv.payment_notes(renamed)
    return n.select("company_id", "row_key", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", "kind", "value", "typical")


def blank_reasons(spark, d):
    facts, filings = twins.facts(spark, d), twins.filings(spark, d)
    rows = metrics.column_table(facts, filings)
    b = pv.blank_reasons(metrics.financial_table(rows, "quarterly"), rows, metrics.fiscal_spread(metrics.metric_slots(facts)), filings)
    return b.select("company_id", F.col("fiscal_year").cast("long").alias("fiscal_year"), "fiscal_period", "row_key", "reason")


def omitted_rows(spark, d):
    rows = metrics.column_table(twins.facts(spark, d), twins.filings(spark, d))
    return pv.omitted_rows(metrics.financial_table(rows, "quarterly"), metrics.company_profile(rows), metrics.financial_table(rows, "annual"))


def share_sets(spark, d):
    s = nc.share_sets(twins.share_facts(spark, d), fo.report_bases(twins.filings(spark, d)))
    return s.select("company_id", "basis", "filing_id", "base_filing_id", "change_type", "value", "base_value",
                    F.round("change", 9).alias("change"), "count", "base_count")


def first_itemized(spark, d):
    """Every disclosure line is there twice; debt and guarantees are tagged in a company's latest report only."""
    facts, filings = twins.facts(spark, d), twins.filings(spark, d)
    bases = fo.report_bases(filings)
    twice = facts.where("canonical_metric IS NULL").withColumns({"fact_key": F.concat("fact_key", F.lit("_b")), "fact_id": F.concat("fact_id", F.lit("b"))})
    latest = filings.groupBy("company_id").agg(F.max("filing_id").alias("_latest"))
    late = F.col("category").isin("debt", "guarantee") & (F.col("filing_id") != F.col("_latest"))
    one = facts.unionByName(twice).join(latest, "company_id").where(~late).drop("_latest").withColumn("xbrl_concept", F.col("category"))
    changes = nc.numeric_changes(one, filings, bases=bases)
    return nc.first_itemized(changes, one, bases).select("company_id", "fact_key", "change_type", "first_itemized")


def possible_replacements(spark, d):
    """Every second disclosure line goes by another name in a company's latest report."""
    facts, filings = twins.facts(spark, d), twins.filings(spark, d)
    latest = filings.groupBy("company_id").agg(F.max("filing_id").alias("_latest"))
    line = F.element_at(F.split("fact_key", "_"), -1).try_cast("int")
    renamed = F.col("canonical_metric").isNull() & (line % 2 == 0) & (F.col("filing_id") == F.col("_latest"))
    one = facts.join(latest, "company_id").withColumn("xbrl_concept", F.col("category")).withColumn(
        "fact_key", F.when(renamed, F.concat("fact_key", F.lit("_renamed"))).otherwise(F.col("fact_key"))).drop("_latest")
    p = nc.possible_replacements(nc.numeric_changes(one, filings))
    return p.select("company_id", "category", "removed_key", "added_key", F.col("position").cast("long").alias("position"))


def _groups(spark, d):
    facts, filings = twins.facts(spark, d), twins.filings(spark, d)
    revenue = facts.groupBy("company_id").agg(F.max("value").alias("revenue"))
    return gr.grouped(twins.mixed_changes(checkpointed(_scored(spark, d))), revenue)


def grouped_changes(spark, d):
    return _groups(spark, d).select(
        "company_id", "change_id", "group_id", "group_score", "group_tier", F.array_join("group_reasons", ", ").alias("reasons"),
        F.col("members").cast("long").alias("members"), F.col("group_place").cast("long").alias("group_place"))


def group_counts(spark, d):
    return gr.group_counts(_groups(spark, d))


def audit_candidates(spark, d):
    c = stored(twins.change_rows(_scored(spark, d)))
    by_label, by_id = F.array(F.lit("metric revenue")), F.array(F.lit("metric revenue"), F.lit("debt.line_18|instant"))

    def point(position, name, refs):
        return F.struct(F.lit(position).alias("position"), F.concat(F.lit(f"{name} "), "s_name").alias("headline"), refs.alias("refs"))

    # a summary names eight phrases, which ones depends on its number
    named = F.slice(F.array(*map(F.lit, _PHRASES)), (F.col("s_suppkey") % len(_PHRASES) + 1).cast("int"), 8)
    detail = F.array_join(named, ", ")
    points = twins.table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.concat(F.lit("They report a "), detail).alias("detail"), F.inline(F.array(
        point(1, "1", by_label), point(0, "0", by_id), point(2, "0", by_label))))
    changes = au.covered_changes(c, points).select("company_id", F.lit("change").alias("kind"), F.col("change_id").alias("item_id"), "score", "covered_by")
    # a company's report is the document of its number
    sections = twins.sections(spark, d).select(F.col("doc_id").alias("company_id"), F.lit(0).alias("section_order"), "text")
    language = au.covered_language(au.severe_sentences(sections), points).select(
        "company_id", F.lit("language").alias("kind"), "item_id", F.col("weight").alias("score"), "covered_by")
    items = au.audit_items(changes.unionByName(language))
    return items.select("company_id", "kind", "item_id", "score", F.array_join("covered_by", ", ").alias("covered_by"))


def severe_sentences(spark, d):
    s = twins.sections(spark, d).select(F.col("source").alias("company_id"), F.col("doc_id").alias("section_order"), "text")
    return au.severe_sentences(s).select("company_id", "phrase", "section_order", F.sha1("sentence").alias("hash"), "weight")


def audit_decisions(spark, d):
    t = twins.table(spark, d, "conversations")
    items = t.where("role = 'user'").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("item_id"),
                                            F.when(F.col("turn") % 4 == 2, F.array(F.lit("Summary"))).alias("covered_by"))
    decisions = t.where("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("item_id"), F.col("turn").alias("position"),
        F.element_at(F.array(*map(F.lit, ["covered", "add", "not_material", "maybe"])), (F.col("conv_id") % 4 + 1).cast("int")).alias("decision"),
        F.concat(F.lit("T"), (F.col("conv_id") % 9).cast("string")).alias("covered_point"))
    points = twins.table(spark, d, "region").select(F.concat(F.lit("T"), F.col("r_regionkey").cast("string")).alias("point_id"), F.col("r_name").alias("headline"))
    rows = au.reconciled(items, decisions, points)
    return au.decision_counts(rows, ("conv_id",))


QUERIES = {f.__name__: f for f in [
    rename_bridge, rename_by_words, alias_chain, capital_items, capital_sections, breakdown_view, one_off_items, mix_with_other, unusual_figures,
    explained_figures, payment_notes, blank_reasons, omitted_rows, share_sets, first_itemized, possible_replacements, grouped_changes, group_counts,
    audit_candidates, severe_sentences, audit_decisions]}

VIEWS.update({
    "named_line": """
        SELECT company_id, filing_id, filing_date, category, value, period_start, period_end, fact_key AS k, false AS is_comparative FROM fact
        WHERE canonical_metric IS NULL AND NOT is_comparative
        UNION ALL
        SELECT company_id, filing_id + 4, cast(filing_date + INTERVAL 12 MONTH AS date), category, value, period_start, period_end, fact_key, true
        FROM fact WHERE canonical_metric IS NULL AND NOT is_comparative""",
    "rfact": """
        SELECT * EXCLUDE (k), category || '.items.' || CASE WHEN company_id % 3 = 0 AND year(filing_date) >= 1999 THEN 'cloud_line_'
               ELSE 'multi_cloud_line_' END || string_split(k, '_')[-1] AS fact_key FROM named_line""",
    "rpair": """
        SELECT DISTINCT n.company_id, o.fact_key AS old_key, n.fact_key AS new_key
        FROM rfact AS n JOIN rfact AS o ON o.company_id = n.company_id AND o.category = n.category AND o.fact_key <> n.fact_key
             AND o.period_end = n.period_end AND o.period_start IS NOT DISTINCT FROM n.period_start AND o.value = n.value
             AND NOT o.is_comparative AND o.filing_date < n.filing_date
        WHERE n.is_comparative AND n.value <> 0
          AND NOT EXISTS (SELECT 1 FROM rfact AS x WHERE x.filing_id = o.filing_id AND x.fact_key = n.fact_key)
          AND NOT EXISTS (SELECT 1 FROM rfact AS y WHERE y.filing_id = n.filing_id AND y.fact_key = o.fact_key)""",
    "rspan": """
        SELECT company_id, fact_key, category, min(filing_date) AS first_filed, max(filing_date) AS last_filed,
               max_by(value, (period_end, value)) AS last_value, min_by(value, (period_end, value)) AS first_value
        FROM rfact WHERE NOT is_comparative GROUP BY ALL""",
    "rword": """
        SELECT o.company_id, o.fact_key AS old_key, n.fact_key AS new_key
        FROM rspan AS o
        JOIN (SELECT company_id, filing_date, lead(filing_date) OVER (PARTITION BY company_id ORDER BY filing_date) AS next_date
              FROM (SELECT DISTINCT company_id, filing_date FROM rfact WHERE NOT is_comparative) AS dd) AS q
             ON q.company_id = o.company_id AND q.filing_date = o.last_filed
        JOIN rspan AS n ON n.company_id = o.company_id AND n.category = o.category AND n.first_filed = q.next_date
        WHERE replace(o.fact_key, 'multi_', '') = n.fact_key AND o.fact_key <> n.fact_key
          AND n.first_value / nullif(o.last_value, 0) BETWEEN 0.2::double AND 5.0::double""",
    "sect": """
        SELECT f.*, CASE WHEN canonical_metric IS NULL THEN category END AS section FROM fact AS f
        WHERE canonical_metric IS NULL AND category IN ('commitment', 'guarantee', 'debt', 'investment')""",
    "sspan": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, fact_key, period_type, period_start, period_end
                                                    ORDER BY filing_date DESC, fact_id DESC) AS rn FROM sect) AS x WHERE rn = 1""",
    "slatest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, fact_key, period_type ORDER BY period_end DESC, period_months DESC) AS k
                       FROM sspan) AS x WHERE k = 1""",
    "sctx": """
        SELECT company_id, max_by(filing_id, period_end) AS latest_filing, max(period_end) AS latest_end,
               max(period_end) FILTER (is_annual) AS annual_end, min(period_end) AS earliest_end FROM filing GROUP BY company_id""",
    "qcell": """
        SELECT company_id, fy, p, age, c.k AS k, c.v AS v, lag(c.v) OVER w AS before, lead(c.v) OVER w AS after FROM general_cell
        WHERE p <> 'FY' AND age <= 8 AND NOT is_bank
        WINDOW w AS (PARTITION BY company_id, c.k ORDER BY age DESC)""",
    "brow": """
        SELECT *, CASE WHEN canonical_metric IN ('gross_profit', 'operating_income', 'net_income') THEN 'segment' ELSE 'geography' END AS family,
               CASE WHEN canonical_metric = 'net_income' THEN 'operating_income' ELSE 'revenue' END AS measure FROM fact
        WHERE canonical_metric IN ('gross_profit', 'operating_income', 'net_income', 'cost_of_revenue', 'income_tax')
          AND fiscal_period IN ('Q1', 'Q2', 'Q3', 'Q4')""",
    "bbest": """
        SELECT company_id, family, measure, family || '.' || measure || '.' || canonical_metric AS fact_key, fiscal_year AS fy, fiscal_period AS p,
               max_by(value, (filing_date, fact_id)) AS value FROM brow GROUP BY ALL""",
    "share": """
        SELECT l_suppkey AS company_id, year(o_orderdate) AS fy, quarter(o_orderdate) AS q, l_linenumber AS n,
               CASE WHEN l_linenumber <= 4 THEN 'revenue' ELSE 'accounts receivable' END AS basis,
               max(cast(round(l_discount * 100) AS bigint)) / 100.0::double AS v
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "share_set": """
        SELECT company_id, basis, company_id * 1000 + (fy - 1990) * 4 + q AS filing_id, count(*) AS n, max(v) AS top FROM share GROUP BY ALL""",
    "changed_row": """
        SELECT *, fact_key || '|' || period_type AS change_id, replace(replace(fact_key, '.', ' '), '_', ' ') AS label FROM scored
        WHERE change_type <> 'repeated'""",
})

def _words(column):
    return f"list_distinct(list_transform(regexp_extract_all(lower({column}), '[a-z]{{5,}}'), lambda w: w[1:6]))"


_GENERIC = ", ".join(f"'{w}'" for w in fv.GROUP_GENERIC_WORDS)


def _stems(column):
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({column}), '[a-z]{{5,}}'), lambda w: w NOT IN ({_GENERIC})), lambda w: w[1:6]))"


#: Groups one change after the other, as the rule is told; what is grouped in rounds must come to the same.
VIEWS.update({
    "mixed_change": f"""
        SELECT company_id, fact_key || '|' || period_type || v.mark AS change_id, v.kind AS kind, category, change_type, {_stems("CASE WHEN v.kind = 'narrative' THEN 'The guarantees of the year amount to ' ELSE replace(replace(fact_key, '.', ' '), '_', ' ') END")} AS stems,
               value * v.factor AS value, base_value, round(score * v.share, 3) AS score, tier, v.kind = 'narrative' AS is_text,
               CASE WHEN v.kind = 'numeric' AND category = 'investment' THEN 'investment:' || change_type END AS itemized
        FROM scored, (SELECT unnest([{{mark: '', kind: 'numeric', factor: 1.0::double, share: 1.0::double}},
                                     {{mark: '|b', kind: 'numeric', factor: 1.004::double, share: 0.9::double}},
                                     {{mark: '|c', kind: 'numeric', factor: 1.0085::double, share: 0.8::double}},
                                     {{mark: '|w', kind: 'narrative', factor: 1.002::double, share: 1.2::double}}]) AS v) AS vv
        WHERE change_type <> 'repeated'""",
})


def group_views(name, rows):
    """Views of the places, homes and groups of the changes in the view ``rows``, called after ``name``."""
    return {
        f"placed_{name}": f"""
            SELECT m.*, row_number() OVER (PARTITION BY m.company_id ORDER BY is_text::int, score DESC, change_id) AS place,
                   CASE WHEN value <> 0 AND abs(value) >= abs(revenue) * {fv.GROUP_FLOOR_SHARE}::double THEN value END AS amount
            FROM {rows} AS m JOIN {name}_revenue AS r USING (company_id)""",
        f"{name}_home": f"""
            WITH RECURSIVE fold AS (
                SELECT DISTINCT company_id, 0::bigint AS place, ''::varchar AS change_id, 0::bigint AS home,
                       []::struct(place bigint, category varchar, change_type varchar, itemized varchar, stems varchar[], v double, b double)[] AS leads
                FROM placed_{name}
                UNION ALL
                SELECT company_id, place, change_id, coalesce(h, place) AS home,
                       CASE WHEN h IS NULL AND NOT is_text THEN list_append(leads, me) ELSE leads END AS leads
                FROM (
                    SELECT r.company_id, r.place, r.change_id, r.is_text, f.leads,
                           {{place: r.place, category: r.category, change_type: r.change_type, itemized: r.itemized, stems: r.stems, v: r.value, b: r.base_value}} AS me,
                           list_filter(f.leads, lambda l: CASE WHEN r.itemized IS NOT NULL THEN coalesce(l.itemized = r.itemized, false) ELSE
                               coalesce(CASE WHEN r.is_text THEN list_has_any(l.stems, r.stems) ELSE l.category = r.category AND l.change_type = r.change_type END
                               AND (coalesce(l.v <> 0 AND abs(r.amount - l.v) <= greatest(abs(r.amount), abs(l.v)) * {fv.GROUP_TOLERANCE}::double, false)
                                    OR coalesce(l.b <> 0 AND abs(r.amount - l.b) <= greatest(abs(r.amount), abs(l.b)) * {fv.GROUP_TOLERANCE}::double, false)), false)
                               END)[1].place AS h
                    FROM fold AS f JOIN placed_{name} AS r ON r.company_id = f.company_id AND r.place = f.place + 1) AS x)
            SELECT company_id, place, change_id, home FROM fold WHERE place > 0""",
        f"{name}_group": f"""
            SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY group_score DESC, home) AS group_place FROM (
                SELECT h.company_id, h.home, min_by(c.change_id, c.place) AS group_id, min_by(c.change_type, c.place) AS group_type,
                       max(c.score) AS group_score, max_by(c.tier, (c.score, -c.place)) AS group_tier, min_by(c.category, c.place) AS lead_category,
                       min_by(c.kind, c.place) AS lead_kind, max_by(c.category, (c.score, -c.place)) AS top_category,
                       max_by(c.kind, (c.score, -c.place)) AS top_kind, count(*) AS members,
                       string_agg(c.change_id, ', ' ORDER BY c.change_id) FILTER (c.place <> h.home) AS related,
                       min_by(c.value, c.place) AS lead_value, min_by({{b: c.base_value}}, c.place).b AS lead_base
                FROM {name}_home AS h JOIN placed_{name} AS c USING (company_id, place) GROUP BY h.company_id, h.home) AS x""",
    }


VIEWS["change_revenue"] = "SELECT company_id, max(value) AS revenue FROM fact GROUP BY ALL"
VIEWS.update(group_views("change", "mixed_change"))

_NEGATION = text.NEGATION.replace("'", "''")

ORACLES = {
    "rename_bridge": sql("""
        SELECT company_id, old_key, new_key FROM rpair
        WHERE (company_id, old_key) IN (SELECT (company_id, old_key) FROM rpair GROUP BY company_id, old_key HAVING count(*) = 1)
          AND (company_id, new_key) IN (SELECT (company_id, new_key) FROM rpair GROUP BY company_id, new_key HAVING count(*) = 1)"""),
    "rename_by_words": sql("SELECT company_id, old_key, new_key FROM rword"),
    "alias_chain": """
        WITH RECURSIVE link AS (
            SELECT p_partkey // 7 AS company_id, p_partkey::varchar AS old_key,
                   (CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 3 ELSE p_partkey + 1 END)::varchar AS new_key
            FROM part),
        walk AS (
            SELECT company_id, old_key, new_key AS key, [old_key, new_key] AS seen FROM link
            UNION ALL
            SELECT w.company_id, w.old_key, l.new_key, list_append(w.seen, l.new_key) FROM walk AS w
            JOIN link AS l ON l.company_id = w.company_id AND l.old_key = w.key WHERE NOT list_contains(w.seen, l.new_key))
        SELECT company_id, old_key, max_by(key, len(seen)) AS newest_key FROM walk GROUP BY ALL""",
    "capital_items": sql("""
        SELECT l.company_id, l.section, l.fact_key, l.period_type, strftime(l.period_end, '%Y-%m-%d') AS period_end, l.value, p.value AS prior_value,
               CASE WHEN l.period_type = 'instant' AND c.annual_end <> l.period_end THEN a.value END AS annual_value,
               (l.value - p.value) / nullif(abs(p.value), 0) AS change_vs_prior,
               (g.lo = c.latest_filing AND g.hi = c.latest_filing AND NOT g.comp AND c.earliest_end < c.latest_end)::int AS is_new,
               least(8, n.n) AS points
        FROM slatest AS l JOIN sctx AS c ON c.company_id = l.company_id
        JOIN (SELECT company_id, fact_key, period_type, min(filing_id) AS lo, max(filing_id) AS hi, bool_or(is_comparative) AS comp
              FROM sect GROUP BY ALL) AS g ON g.company_id = l.company_id AND g.fact_key = l.fact_key AND g.period_type = l.period_type
        JOIN (SELECT company_id, fact_key, period_type, period_months, count(*) AS n FROM sspan GROUP BY ALL) AS n
             ON n.company_id = l.company_id AND n.fact_key = l.fact_key AND n.period_type = l.period_type
             AND n.period_months IS NOT DISTINCT FROM l.period_months
        LEFT JOIN LATERAL (
            SELECT s.value FROM sspan AS s WHERE s.company_id = l.company_id AND s.fact_key = l.fact_key AND s.period_type = l.period_type
              AND s.period_months IS NOT DISTINCT FROM l.period_months AND s.period_end < l.period_end
              AND (l.period_type = 'instant' OR abs(date_diff('day', s.period_end, l.period_end) - 365) <= 10)
            ORDER BY s.period_end DESC LIMIT 1) AS p ON true
        LEFT JOIN sspan AS a ON a.company_id = l.company_id AND a.fact_key = l.fact_key AND a.period_type = l.period_type
             AND l.period_type = 'instant' AND a.period_end = c.annual_end
        WHERE l.period_end >= coalesce(c.annual_end, c.latest_end)"""),
    "breakdown_view": sql("""
        SELECT * EXCLUDE (measure, sole) FROM (
            SELECT b.company_id, b.family, b.measure, b.fy AS fiscal_year, b.p AS fiscal_period, b.fact_key, b.value, o.value AS prior_value,
                   (b.value - o.value) / nullif(abs(o.value), 0) AS growth,
                   CASE WHEN b.measure = 'revenue' THEN b.value / nullif(w.revenue, 0) END AS share_of_revenue,
                   row_number() OVER (PARTITION BY b.company_id, b.family ORDER BY (b.measure <> 'revenue')::int, abs(b.value) DESC, b.fact_key) AS place,
                   b.family = 'segment' AND count(*) FILTER (b.measure = 'revenue') OVER (PARTITION BY b.company_id, b.family) <= 1 AS sole
            FROM (SELECT *, max(fy * 10 + p[2:2]::int) OVER (PARTITION BY company_id, family) AS last FROM bbest) AS b
            LEFT JOIN bbest AS o ON o.company_id = b.company_id AND o.fact_key = b.fact_key AND o.p = b.p AND o.fy = b.fy - 1
            LEFT JOIN wide AS w ON w.company_id = b.company_id AND w.fy = b.fy AND w.p = b.p
            WHERE b.fy * 10 + b.p[2:2]::int = b.last) AS x
        WHERE NOT sole"""),
    "one_off_items": sql("""
        SELECT company_id, fiscal_year, fiscal_period, fact_key, value,
               row_number() OVER (PARTITION BY company_id, fiscal_year, fiscal_period ORDER BY abs(value) DESC, fact_key) AS place FROM (
            SELECT company_id, fiscal_year, fiscal_period, fact_key, max_by(value, (filing_date, fact_id)) AS value FROM fact
            WHERE category IN ('investment', 'guarantee') AND period_type = 'duration' GROUP BY ALL) AS x"""),
    "mix_with_other": """
        SELECT l_suppkey, p_brand, value, place, round(value / total, 9) AS share FROM (
            SELECT l_suppkey, CASE WHEN n > 6 AND r > 5 THEN 'Other' ELSE p_brand END AS p_brand, sum(value)::bigint AS value,
                   min(r) AS place, any_value(total) AS total FROM (
                SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY value DESC, p_brand) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n,
                       sum(value) OVER (PARTITION BY l_suppkey) AS total FROM (
                    SELECT l_suppkey, p_brand, sum(cast(round(l_extendedprice * 100) AS bigint)) AS value
                    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) AS a) AS b
            GROUP BY ALL) AS c""",
    "unusual_figures": sql("""
        SELECT company_id, k AS row_key, fy AS fiscal_year, p AS fiscal_period, kind, v AS value, before, after FROM (
            SELECT *, CASE WHEN least(before, after) > 0 AND v > 1.8::double * greatest(before, after) THEN 'peak'
                           WHEN k <> 'revenue' AND v < 0 AND least(before, after) > 0 THEN 'loss' END AS kind FROM qcell
            WHERE k IN ('net_income', 'pretax_income', 'operating_income', 'revenue')) AS x
        WHERE kind IS NOT NULL"""),
    "payment_notes": sql("""
        SELECT company_id, row_key, fy AS fiscal_year, p AS fiscal_period, kind, v AS value, t AS typical FROM (
            SELECT *, CASE WHEN row_key = 'dividends_paid' AND after > t * 1.6::double AND abs(v + after - t * 2) <= t * 2 * 0.25::double THEN 'slipped'
                           WHEN abs(v) < t * 0.05::double THEN 'near_zero' ELSE 'low' END AS kind FROM (
                SELECT *, CASE k WHEN 'capex' THEN 'buybacks' ELSE 'dividends_paid' END AS row_key,
                       median(v) OVER (PARTITION BY company_id, k) AS t, count(v) OVER (PARTITION BY company_id, k) AS n FROM qcell
                WHERE k IN ('operating_cash_flow', 'capex')) AS a
            WHERE n > 3 AND t > 0 AND v < t * 0.35::double) AS b"""),
    "share_sets": sql("""
        SELECT c.company_id, c.basis, c.filing_id, b.filing_id AS base_filing_id,
               CASE WHEN b.filing_id IS NULL THEN 'new' WHEN abs(c.top - b.top) >= 0.01::double OR c.n <> b.n THEN 'changed' ELSE 'repeated' END AS change_type,
               c.top AS value, b.top AS base_value, round(c.top - b.top, 9) AS change, c.n AS count, b.n AS base_count
        FROM share_set AS c JOIN bases AS x ON x.company_id = c.company_id AND x.latest_filing = c.filing_id
        LEFT JOIN LATERAL (
            SELECT * FROM share_set AS s WHERE s.company_id = c.company_id AND s.basis = c.basis AND s.filing_id <> c.filing_id
            ORDER BY (s.filing_id = CASE WHEN x.latest_annual THEN x.annual_filing ELSE x.previous_filing END)::int DESC, s.filing_id DESC
            LIMIT 1) AS b ON true"""),
    "audit_candidates": sql(f"""
        SELECT company_id, kind, item_id, score, covered_by FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, kind, covered_by IS NULL ORDER BY score DESC, item_id) AS n FROM (
                SELECT c.company_id, 'change' AS kind, c.change_id AS item_id, c.score, CASE WHEN c.label = 'metric revenue' THEN '0 ' || s_name || ', 1 ' || s_name
                            WHEN c.change_id = 'debt.line_18|instant' THEN '0 ' || s_name END AS covered_by
                FROM changed_row AS c LEFT JOIN supplier ON s_suppkey = c.company_id
                WHERE c.tier = 'top' OR c.subsequent = 1 OR (c.change_type = 'new' AND c.category = 'debt')
                UNION ALL
                SELECT doc_id AS company_id, 'language' AS kind, left(sha1(s), 16) AS item_id, weight AS score,
                       CASE WHEN len(list_filter(stems, lambda x: NOT list_contains(coalesce(said, []), x))) = 0 THEN '(summary wording)' END AS covered_by
                FROM (SELECT doc_id, phrase, min_by(s, pos) AS s, any_value(w) AS weight, {_words("phrase")} AS stems FROM (
                          SELECT doc_id, pos, s, t.phrase AS phrase, t.w AS w FROM sentence, (SELECT unnest({_TRIGGER_LIST}) AS t) AS tt
                          WHERE t.w >= 0.6 AND regexp_matches(s, '(?i)' || t.p) AND regexp_matches(s, '(?i){fv.REALIZED}')
                            AND NOT regexp_matches(s, '(?i){fv.HYPOTHETICAL}') AND NOT regexp_matches(s, '{_NEGATION}')
                            AND NOT (t.phrase = 'restatement' AND regexp_matches(s, '(?i){fv.PRESENTATION_RESTATEMENT}'))) AS told
                      GROUP BY doc_id, phrase) AS severe
                LEFT JOIN (SELECT s_suppkey, {_words(f"'0 1 ' || s_name || ' They report a ' || array_to_string({_PHRASE_LIST}[s_suppkey % {len(_PHRASES)} + 1:s_suppkey % {len(_PHRASES)} + 8], ', ')")} AS said FROM supplier) AS p
                          ON s_suppkey = doc_id) AS a) AS b
        WHERE covered_by IS NOT NULL OR n <= CASE kind WHEN 'change' THEN 12 ELSE 6 END"""),
    "severe_sentences": sql(f"""
        SELECT company_id, phrase, section_order, sha1(s) AS hash, w AS weight FROM (
            SELECT source AS company_id, t.phrase AS phrase, t.w AS w, doc_id AS section_order, s,
                   row_number() OVER (PARTITION BY source, t.phrase ORDER BY doc_id, pos) AS n
            FROM sentence JOIN (SELECT doc_id, source FROM documents) AS d USING (doc_id), (SELECT unnest({_TRIGGER_LIST}) AS t) AS tt
            WHERE t.w >= 0.6 AND regexp_matches(s, '(?i)' || t.p) AND regexp_matches(s, '(?i){fv.REALIZED}')
              AND NOT regexp_matches(s, '(?i){fv.HYPOTHETICAL}') AND NOT regexp_matches(s, '{_NEGATION}')
              AND NOT (t.phrase = 'restatement' AND regexp_matches(s, '(?i){fv.PRESENTATION_RESTATEMENT}'))) AS x
        WHERE n = 1"""),
    "audit_decisions": """
        SELECT conv_id, count(*) AS checked, count(*) FILTER (f = 'covered') AS covered, count(*) FILTER (f = 'add') AS "add",
               count(*) FILTER (f = 'not_material') AS not_material, count(*) FILTER (f = 'unresolved') AS unresolved FROM (
            SELECT i.conv_id, CASE WHEN i.turn % 4 = 2 THEN 'covered' WHEN a.turn IS NULL THEN 'unresolved'
                       WHEN i.conv_id % 4 = 0 THEN CASE WHEN i.conv_id % 9 < 5 THEN 'covered' ELSE 'unresolved' END
                       WHEN i.conv_id % 4 = 1 THEN 'add' WHEN i.conv_id % 4 = 2 THEN 'not_material' ELSE 'unresolved' END AS f
            FROM conversations AS i LEFT JOIN conversations AS a ON a.conv_id = i.conv_id AND a.turn = i.turn + 1 AND a.role = 'assistant'
            WHERE i.role = 'user') AS x
        GROUP BY conv_id""",
}

ORACLES["grouped_changes"] = sql("""
    SELECT h.company_id, h.change_id, group_id, group_score, group_tier, members, group_place,
           array_to_string(list_filter(['is ' || lead_kind, 'of ' || lead_category, CASE WHEN top_kind <> lead_kind THEN 'is ' || top_kind END,
                                        CASE WHEN top_category <> lead_category THEN 'of ' || top_category END], lambda x: x IS NOT NULL), ', ') AS reasons
    FROM change_home AS h JOIN change_group AS g ON g.company_id = h.company_id AND g.home = h.home""")
ORACLES["group_counts"] = sql("""
    SELECT company_id, count(*) FILTER (group_tier = 'top') AS top, count(*) FILTER (group_tier = 'notable') AS notable,
           count(*) FILTER (group_tier = 'background') AS background, count(*) FILTER (group_type = 'new') AS "new",
           count(*) FILTER (group_type = 'changed') AS changed, count(*) FILTER (group_type = 'removed') AS removed,
           greatest(count(*) FILTER (group_tier = 'background') - 40, 0) AS hidden
    FROM change_group GROUP BY company_id""")
ORACLES["capital_sections"] = sql("""
    SELECT company_id, section, fact_key, period_type, row_number() OVER (
               PARTITION BY company_id, section ORDER BY abs(value) DESC, length(fact_key), fact_key) AS place, 0 AS more
    FROM (SELECT l.company_id, l.section, l.fact_key, l.period_type, l.value FROM slatest AS l JOIN sctx AS c ON c.company_id = l.company_id
          WHERE l.period_end >= coalesce(c.annual_end, c.latest_end)) AS x""")
ORACLES["omitted_rows"] = sql(f"""
    WITH shown AS (
        SELECT DISTINCT company_id, p = 'FY' AS annual, c.k AS k FROM general_cell
        WHERE NOT is_bank AND c.v IS NOT NULL AND age <= CASE WHEN p = 'FY' THEN 5 ELSE 8 END)
    SELECT x.company_id, x.k AS row_key,
           CASE WHEN EXISTS (SELECT 1 FROM shown AS s WHERE s.company_id = x.company_id AND s.k = x.k AND s.annual)
                THEN 'only_in_annual_reports' ELSE 'not_found' END AS reason
    FROM (SELECT company_id, unnest([{", ".join(f"'{k}'" for k in pv.KEY_ROWS)}]) AS k FROM profile WHERE NOT is_bank) AS x
    WHERE NOT EXISTS (SELECT 1 FROM shown AS s WHERE s.company_id = x.company_id AND s.k = x.k AND NOT s.annual)""")

ORACLES["explained_figures"] = f"""
    SELECT u.company_id, row_key, u.fiscal_year, u.fiscal_period, kind, CASE WHEN abs(i.value) >= abs(u.excess) * 0.4::double THEN i.value END AS item_value
    FROM (SELECT *, value - coalesce((before + after) / 2, before, after) AS excess FROM ({ORACLES["unusual_figures"]}) AS a) AS u
    LEFT JOIN (SELECT company_id, fiscal_year, fiscal_period, value > 30000 AS charge, max_by(value, (abs(value), fact_key)) AS value
               FROM ({ORACLES["one_off_items"]}) AS b WHERE value <> 0 GROUP BY ALL) AS i
         ON i.company_id = u.company_id AND i.fiscal_year = u.fiscal_year AND i.fiscal_period = u.fiscal_period AND i.charge = (u.excess < 0)"""

_RENAMED = """SELECT f.* REPLACE (CASE WHEN canonical_metric IS NULL AND try_cast(string_split(fact_key, '_')[-1] AS int) % 2 = 0 AND filing_id = latest
                                       THEN fact_key || '_renamed' ELSE fact_key END AS fact_key)
              FROM fact_before AS f JOIN (SELECT company_id AS c, max(filing_id) AS latest FROM fact_before GROUP BY ALL) AS l ON c = company_id"""
ORACLES["possible_replacements"] = """
    SELECT company_id, category, removed_key, added_key, position FROM (
        SELECT r.company_id, r.category, r.fact_key AS removed_key, a.fact_key AS added_key,
               row_number() OVER (PARTITION BY r.company_id, r.category, r.fact_key ORDER BY a.fact_key) AS position
        FROM (SELECT DISTINCT company_id, category, fact_key FROM ({0}) AS x WHERE change_type = 'removed') AS r
        JOIN (SELECT DISTINCT company_id, category, fact_key FROM ({0}) AS y WHERE change_type = 'new') AS a
             ON a.company_id = r.company_id AND a.category = r.category) AS p
    WHERE position <= 4""".format(CHANGES["numeric_changes"].replace(
        f"fact AS MATERIALIZED ({VIEWS['fact']})", f"fact_before AS MATERIALIZED ({VIEWS['fact']}), fact AS MATERIALIZED ({_RENAMED})"))

_TWICE = """SELECT f.* FROM (SELECT * FROM fact_before UNION ALL
                             SELECT * REPLACE (fact_key || '_b' AS fact_key, fact_id || 'b' AS fact_id) FROM fact_before WHERE canonical_metric IS NULL) AS f
            JOIN (SELECT company_id AS c, max(filing_id) AS latest FROM fact_before GROUP BY ALL) AS l ON c = company_id
            WHERE NOT (category IN ('debt', 'guarantee') AND filing_id <> latest)"""
ORACLES["first_itemized"] = sql("""
    SELECT company_id, fact_key, change_type, CASE WHEN change_type = 'new' AND fresh AND n >= 3 THEN category || ':' || category END AS first_itemized FROM (
        SELECT c.*, count(*) FILTER (c.change_type = 'new') OVER (PARTITION BY c.company_id, c.category) AS n,
               NOT EXISTS (SELECT 1 FROM fact AS f WHERE f.company_id = c.company_id AND f.category = c.category AND f.filing_id <> b.latest_filing) AS fresh
        FROM change AS c JOIN bases AS b ON b.company_id = c.company_id WHERE c.change_type IS NOT NULL) AS x""").replace(
    f"fact AS MATERIALIZED ({VIEWS['fact']})", f"fact_before AS MATERIALIZED ({VIEWS['fact']}), fact AS MATERIALIZED ({_TWICE})")
