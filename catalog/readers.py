"""Read models, stored tables, and the small readers and labels."""

import uuid

from pyspark.sql import functions as F

from folioscope.functions import labels, periods
from folioscope.functions import text as T
from folioscope.operators import insights as ins
from folioscope.plans import twins
from folioscope.session import shared_folder
from folioscope.sources import listings as ls
from folioscope.sources import store

from .changes import _scored
from .views import sql


def _part(spark, d):
    return twins.table(spark, d, "part")


def _pick(number, *values):
    """One of the values by a number's remainder."""
    out = F.when(number % len(values) == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        out = out.when(number % len(values) == i, F.lit(v))
    return out


def company_directory(spark, d):
    entry = F.to_json(F.struct(F.col("p_partkey").alias("cik_str"), F.lower("p_brand").alias("ticker"), F.concat("p_name", F.lit(" & Co.")).alias("title")))
    return ls.directory(_part(spark, d).select(F.col("p_partkey").alias("position"), entry.alias("payload")))


def watchlist_tickers(spark, d):
    p = _part(spark, d)
    line = F.when(F.col("p_partkey") % 3 == 0, "# a note").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  "), "p_name", F.lit(" # held"))).otherwise(F.col("p_name"))
    return ls.watchlist(p.select(line.alias("value"))).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


def facts_with_filings(spark, d):
    source = F.array(F.struct(F.col("label").alias("row_text"), F.col("fact_id").alias("element_id")))
    facts = twins.facts(spark, d).select("filing_id", "fact_id", F.when(F.col("value") > 1000, F.col("value")).alias("value"), source.alias("sources"))
    model = store.facts_read_model(facts, twins.filings(spark, d))
    return model.select("filing_id", "fact_id", "form_type", F.col("is_annual").cast("int").alias("is_annual"), "value", "source.row_text")


def kept_sections(spark, d):
    docs = twins.texts(spark, d, "documents")
    sections = docs.select(F.col("doc_id").alias("filing_id"), F.col("lang").alias("category"), F.when(F.col("n_chars") > 500, F.col("text")).alias("text"))
    filings = docs.select(F.col("doc_id").alias("filing_id"), F.col("source").alias("company_id"))
    return store.sections_read_model(sections, filings, ["en", "de"]).select("filing_id", "company_id", "category", F.sha1("text").alias("hash"))


def section_ids(spark, d):
    docs = twins.table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 4).alias("filing_id"), F.concat(F.lit("n"), (F.col("doc_id") % 4).cast("string")).alias("ref"),
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("n"), (F.col("doc_id") % 4 - 1).cast("string"))).alias("parent_ref"))
    facts = twins.table(spark, d, "labels").select(
        F.floor(F.col("doc_id") / 4).alias("filing_id"), F.concat(F.lit("n"), (F.col("doc_id") % 5).cast("string")).alias("section_ref"), "doc_id")
    sections, linked = store.resolve_sections(docs, facts)
    named = sections.select(F.concat(F.lit("s"), "filing_id", "ref").alias("row"), "section_id", "parent_id")
    return named.unionByName(linked.select(F.concat(F.lit("f"), "doc_id").alias("row"), "section_id", F.lit(None).cast("string").alias("parent_id")))


def facts_with_status(spark, d):
    facts = twins.facts(spark, d).select(
        "company_id", "fact_id", F.when(F.col("is_comparative"), "old").alias("disclosure_status"), F.lit(0.0).alias("materiality_score"), "value", "is_annual")
    changes = facts.where("is_annual").select(
        "company_id", F.when(F.col("value") > 5000, F.col("fact_id")).alias("fact_id"), F.lit("new").alias("change_type"), (F.col("value") / 1e6).alias("score"))
    return store.with_status(facts, changes).select("company_id", "fact_id", "disclosure_status", "materiality_score")


def companion_facts(spark, d):
    facts = twins.facts(spark, d).select("filing_id", F.col("fact_id").alias("element_id"),
                                         F.when(F.col("canonical_metric").isNull(), F.col("category")).alias("text_block_id"), "value")
    companions = twins.filings(spark, d).where("fiscal_period = 'Q1'").select("filing_id", (F.col("filing_id") + 3).alias("annual_filing_id"))
    return store.merge_companion(facts, companions)


def stored_replacement(spark, d):
    """Filings of one period are read anew: the stored table holds their new rows and all others."""
    facts = twins.facts(spark, d).select("company_id", "filing_id", "fact_id", "value", "fiscal_period", "is_annual")
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    store.write_table(facts.drop("is_annual"), path, 16)
    store.replace_in_table(spark, path, facts.where("is_annual AND value > 1000").drop("is_annual").withColumn("value", F.col("value") * 2), buckets=16)
    return spark.read.parquet(path).select("company_id", "filing_id", "fact_id", "value")


def shown_wording(spark, d):
    related = F.array(F.struct(F.when(F.col("company_id") % 2 == 0, "narrative").otherwise("numeric").alias("kind")))
    groups = _scored(spark, d).where("change_type <> 'repeated'").withColumn("kind", F.lit("numeric")).withColumn("related", related)
    return ins.shown_changes(groups, "notable", "wording").select("company_id", "fact_key", "period_type", "score")


def unranked_risks(spark, d):
    first = F.element_at(F.split("text", "\n"), 1)
    docs = twins.texts(spark, d, "documents").select("doc_id", F.col("source").alias("company_id"), first.alias("headline"), (F.col("doc_id") % 3 > 0).alias("company_specific"))
    ranked = docs.where("doc_id % 2 = 0").select("company_id", F.upper("headline").alias("headline"))
    return ins.unranked_risks(docs, ranked).select("doc_id", "company_id")


def changed_risks(spark, d):
    n = F.col("doc_id")
    passages = twins.texts(spark, d, "documents").select(
        "doc_id", F.col("source").alias("company_id"), _pick(n, "wording", "wording", "numbers", "wording").alias("kind"),
        _pick(n, "new", "changed", "removed").alias("change_type"), n.alias("position"), F.element_at(F.split("text", "\n"), 1).alias("text"),
        F.when(n % 5 > 0, F.array(F.struct((n % 5 / 5.0).alias("weight")))).otherwise(F.array().cast("array<struct<weight:double>>")).alias("triggers"))
    return ins.changed_risks(passages, ["company_id"], 3000).select("company_id", "doc_id", F.sha1("block").alias("hash"))


def change_texts(spark, d):
    p = _part(spark, d)
    unit = _pick(F.col("p_partkey"), "points", "days", "ratio", "share")
    change = F.when(F.col("p_partkey") % 4 == 3, F.col("p_size").cast("double")).when(F.col("p_partkey") % 4 == 1, (F.col("p_size") - 25).cast("double")).otherwise(
        (F.col("p_size") - 25) / 1000.0)
    return p.select("p_partkey", labels.change_text(change, unit).alias("shown"))


def money_texts(spark, d):
    o = twins.table(spark, d, "orders")
    value = F.floor(F.col("o_totalprice") / 100) * F.pow(F.lit(10.0), F.col("o_orderkey") % 4 * 3 + 2) * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)
    shown = labels.money_text(value, _pick(F.col("o_orderkey"), "USD", "CHF", "EUR", "CAD"))
    return o.where("o_totalprice >= 100").select("o_orderkey", shown.alias("shown"))


UNITS = ["iso4217:USD", "iso4217:EUR/xbrli:shares", "xbrli:pure", "xbrli:shares", "utr:bbl", "iso4217:GBP/utr:bbl"]


def unit_kinds(spark, d):
    p = _part(spark, d).withColumn("unit", _pick(F.col("p_partkey"), *UNITS))
    return p.select("p_partkey", periods.currency_of_unit("unit").alias("currency"), periods.normalized_unit("unit").alias("kind"))


def year_ends(spark, d):
    o = twins.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("day", "'--'MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("day", "M/d")).when(
        F.col("o_orderkey") % 4 == 2, F.date_format("day", "MMMM d")).otherwise("unknown")
    return o.select("o_orderkey", periods.year_end_mmdd(shown).alias("year_end"))


def headings(spark, d):
    return twins.texts(spark, d, "documents").select("doc_id", T.heading_of("text").alias("heading"), T.text_hash("text").alias("hash"))


def statement_labels(spark, d):
    label = F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" (Note 3):  net** . "))
    return _part(spark, d).select("p_partkey", T.statement_label_key(label).alias("key"))


def one_off_names(spark, d):
    label = F.concat(F.lit("Adjustments for "), _pick(F.col("p_partkey"), "gain loss on disposal", "Impairment", "losses of a sale"),
                     F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(": "), "p_name")).otherwise(""))
    return _part(spark, d).select("p_partkey", labels.one_off_name(label).alias("name"))


NOTE_CONCEPTS = {
    "us-gaap:SubsequentEventsTextBlock": "subsequent_events", "us-gaap:GuaranteesTextBlock": "guarantees", "us-gaap:DebtDisclosureTextBlock": "debt",
    "us-gaap:CommitmentsAndContingenciesDisclosureTextBlock": "commitments,contingencies", "us-gaap:IncomeTaxDisclosureTextBlock": "income_taxes",
    "us-gaap:SegmentReportingDisclosureTextBlock": "segment_information", "us-gaap:RevenueRecognitionPolicyTextBlock": "accounting_policies",
    "own:SomethingElseTextBlock": "other", "ifrs-full:DisclosureOfLeasesExplanatory": "leases", "us-gaap:InventoryDisclosureTextBlock": "inventory"}


def note_categories(spark, d):
    concept = _pick(F.col("p_partkey"), *NOTE_CONCEPTS)
    return _part(spark, d).select("p_partkey", F.array_join(labels.text_block_categories(concept), ",").alias("categories"))


QUERIES = {f.__name__: f for f in [
    company_directory, watchlist_tickers, facts_with_filings, kept_sections, section_ids, facts_with_status, companion_facts, stored_replacement,
    shown_wording, unranked_risks, changed_risks, change_texts, money_texts, unit_kinds, year_ends, headings, statement_labels, one_off_names,
    note_categories]}


def _case(number, values):
    return f"([{', '.join(repr(v) for v in values)}])[{number} % {len(values)} + 1]"


_SPACES = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"

ORACLES = {
    "company_directory": f"""
        SELECT p_partkey AS position, p_partkey AS cik, upper(p_brand) AS ticker, p_name || ' & Co.' AS name, norm_name, replace(norm_name, ' ', '') AS compact_name
        FROM (SELECT *, {_SPACES.format("regexp_replace(lower(p_name || ' & Co.'), '[^a-z0-9 ]', ' ', 'g')")} AS norm_name FROM part) AS p""",
    "watchlist_tickers": "SELECT p_name AS ticker, count(*) AS n FROM part WHERE p_partkey % 3 > 0 GROUP BY p_name",
    "facts_with_filings": sql("""
        SELECT x.filing_id, x.fact_id, f.form_type, f.is_annual::int AS is_annual, x.value, replace(replace(x.fact_key, '.', ' '), '_', ' ') AS row_text
        FROM fact AS x JOIN filing AS f ON f.filing_id = x.filing_id WHERE x.value > 1000"""),
    "kept_sections": """
        SELECT doc_id AS filing_id, source AS company_id, lang AS category, sha1(text) AS hash FROM documents
        WHERE n_chars > 500 AND lang IN ('en', 'de')""",
    "section_ids": """
        SELECT 's' || doc_id // 4 || 'n' || doc_id % 4 AS row, sha1(doc_id // 4 || '|n' || doc_id % 4) AS section_id,
               CASE WHEN doc_id % 4 > 0 THEN sha1(doc_id // 4 || '|n' || (doc_id % 4 - 1)) END AS parent_id FROM documents
        UNION ALL
        SELECT 'f' || l.doc_id, CASE WHEN s.doc_id IS NOT NULL THEN sha1(l.doc_id // 4 || '|n' || l.doc_id % 5) END, NULL
        FROM labels AS l LEFT JOIN documents AS s ON s.doc_id // 4 = l.doc_id // 4 AND s.doc_id % 4 = l.doc_id % 5""",
    "facts_with_status": sql("""
        SELECT company_id, fact_id, CASE WHEN is_annual AND value > 5000 THEN 'new' WHEN is_comparative THEN 'old' END AS disclosure_status,
               CASE WHEN is_annual AND value > 5000 THEN value / 1e6 ELSE 0 END AS materiality_score FROM fact"""),
    "companion_facts": sql("""
        SELECT CASE WHEN first THEN filing_id + 3 ELSE filing_id END AS filing_id, CASE WHEN first THEN filing_id || ':' ELSE '' END || fact_id AS element_id,
               CASE WHEN canonical_metric IS NULL THEN CASE WHEN first THEN filing_id || ':' ELSE '' END || category END AS text_block_id, value
        FROM (SELECT *, filing_id % 1000 % 4 = 1 AS first FROM fact) AS f"""),
    "stored_replacement": sql("""
        SELECT company_id, filing_id, fact_id, CASE WHEN is_annual THEN value * 2 ELSE value END AS value FROM fact AS f
        WHERE NOT EXISTS (SELECT 1 FROM fact AS g WHERE g.filing_id = f.filing_id AND g.is_annual AND g.value > 1000) OR is_annual AND value > 1000"""),
    "shown_wording": sql("""
        SELECT company_id, fact_key, period_type, score FROM scored WHERE change_type <> 'repeated' AND tier = 'notable' AND company_id % 2 = 0"""),
    "unranked_risks": """
        WITH r AS (SELECT doc_id, source, lower(string_split(text, chr(10))[1]) AS h FROM documents)
        SELECT doc_id, source AS company_id FROM r WHERE doc_id % 3 > 0
          AND NOT EXISTS (SELECT 1 FROM r AS o WHERE o.doc_id % 2 = 0 AND o.source = r.source AND o.h = r.h)""",
    "changed_risks": """
        SELECT company_id, doc_id, sha1(block) AS hash FROM (
            SELECT *, sum(length(block) + 2) OVER (PARTITION BY company_id ORDER BY change <> 'new', w DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM (
                SELECT doc_id, source AS company_id, change, doc_id % 5 AS w, '[' || change || '] ' || string_split(text, chr(10))[1] AS block
                FROM (SELECT *, (['new', 'changed', 'removed'])[doc_id % 3 + 1] AS change FROM documents) AS a
                WHERE doc_id % 4 <> 2 AND doc_id % 3 < 2) AS b) AS c
        WHERE running <= 3002""",
    "change_texts": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN CASE WHEN p_size >= 9 THEN printf('%.0f×', p_size + 1.0) ELSE printf('+%.1f%%', p_size * 100.0) END
               WHEN 1 THEN CASE WHEN p_size > 25 THEN '+' ELSE '' END || printf('%.0f days', p_size - 25.0)
               ELSE CASE WHEN p_size > 25 THEN '+' ELSE '' END || printf('%.1f pts', (p_size - 25) / 10.0) END AS shown FROM part""",
    "money_texts": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || (['$', 'CHF ', '€', 'C$'])[o_orderkey % 4 + 1]
               || CASE WHEN v >= 1e12 THEN printf('%.1fT', v / 1e12) WHEN v >= 1e9 THEN printf('%.1fB', v / 1e9)
                       WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) ELSE format('{:,.0f}', v) END AS shown
        FROM (SELECT *, floor(o_totalprice / 100) * pow(10.0, o_orderkey % 4 * 3 + 2) AS v FROM orders) AS o WHERE o_totalprice >= 100""",
    "unit_kinds": f"""
        SELECT p_partkey, {_case('p_partkey', ['USD', 'EUR', '', '', '', 'GBP'])} AS c, {_case('p_partkey', ['currency', 'currency_per_share', 'ratio', 'shares', 'other', 'other'])} AS kind
        FROM part""".replace(" AS c,", " AS currency,").replace("''", "NULL"),
    "year_ends": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%m-%d') END AS year_end FROM orders",
    "headings": f"""
        SELECT doc_id, nullif(substring(trim(string_split(trim(text), chr(10))[1]), 1, 160), '') AS heading, sha1(lower({_SPACES.format('text')})) AS hash FROM documents""",
    "statement_labels": "SELECT p_partkey, lower(p_name) || ' net' AS key FROM part",
    "one_off_names": f"""
        SELECT p_partkey, {_case('p_partkey', ['a gain on disposal', 'an impairment', 'a losses of a sale'])}
               || CASE WHEN p_size % 2 = 0 THEN ' (' || p_name || ')' ELSE '' END AS name FROM part""",
    "note_categories": f"SELECT p_partkey, {_case('p_partkey', list(NOTE_CONCEPTS.values()))} AS categories FROM part",
}
