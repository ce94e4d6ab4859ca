"""Search, passages, quotes, figures and citations."""

from pyspark.sql import functions as F

from folioscope.functions import figures as fig
from folioscope.functions import text as T
from folioscope.operators import search as s
from folioscope.operators import verify as v
from folioscope.plans import twins

from .views import VIEWS, sql
from .wording import tabular


def _companies(spark, d):
    p = twins.table(spark, d, "part")
    name = T.normalized_name(F.concat_ws(" ", "p_name", "p_brand"))
    return p.select(F.col("p_partkey").alias("position"), F.concat(F.substring("p_type", 1, 2), F.col("p_size").cast("string")).alias("ticker"),
                    name.alias("norm_name"), F.replace(name, F.lit(" "), F.lit("")).alias("compact_name"))


def company_search(spark, d):
    p = twins.table(spark, d, "part")
    queries = p.select(F.explode(F.array("p_name", F.substring("p_name", 3, 5), "p_brand", F.substring("p_type", 1, 3), F.lit("b"),
                                         F.concat(F.substring("p_type", 1, 2), F.col("p_size").cast("string")))).alias("query"))
    return s.search_companies(_companies(spark, d), queries, 5).select(
        "query", "position", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


def _chunks(spark, d):
    c = s.chunks(twins.sections(spark, d), ["doc_id", "source"])
    return c.select(F.col("source").alias("pool"), F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), "chunk")


def section_chunks(spark, d):
    return _chunks(spark, d).select("pool", "chunk_id", F.length("chunk").cast("long").alias("chars"), F.sha1("chunk").alias("hash"))


def term_statistics(spark, d):
    index = s.postings(_chunks(spark, d)).where(F.col("term").isNotNull())
    return index.groupBy("pool", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def bm25_top_passages(spark, d):
    r = s.rank_passages(s.passage_index(_chunks(spark, d)), twins.questions(spark, d))
    return r.select("question_id", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def _paragraphs(spark, d):
    lines = twins.texts(spark, d, "documents").select(F.col("source").alias("pool"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "chunk"))
    return lines.where(F.length("chunk") >= 80).select("pool", F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), "chunk")


def paragraph_terms(spark, d):
    index = s.passage_index(_paragraphs(spark, d))
    return index.terms.select("pool", "term", "df", F.round("idf", 9).alias("idf"), F.round("most", 9).alias("most"))


def bm25_paragraphs(spark, d):
    r = s.rank_passages(s.passage_index(_paragraphs(spark, d)), twins.questions(spark, d))
    return r.select("question_id", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def recent_turns(spark, d):
    t = s.recent_turns(twins.table(spark, d, "conversations"))
    return t.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


def quote_in_source(spark, d):
    quotes = twins.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    docs = twins.texts(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return v.find_quotes(quotes, docs)


def figure_claims(spark, d):
    c = twins.sections(spark, d).select("doc_id", F.explode_outer(fig.claims("text")).alias("c")).where(F.col("c").isNotNull())
    return c.select("doc_id", "c.kind", "c.value", F.round("c.tolerance", 9).alias("tolerance"), "c.text")


def source_figures(spark, d):
    f = twins.sections(spark, d).select("doc_id", F.explode_outer(fig.source_figures("text")).alias("f")).where(F.col("f").isNotNull())
    return f.select("doc_id", "f.kind", "f.value")


def verified_items(spark, d):
    items, sources = twins.written_items(spark, d)
    return v.checked_items(items, sources).select("item_id", F.col("quote_found").cast("int").alias("quote_found"), "status",
                                                  F.size("figure_checks").cast("long").alias("n_figures"))


def segment_reconcile(spark, d):
    f = twins.facts(spark, d).where("NOT is_comparative")
    segments = f.where("canonical_metric IN ('gross_profit', 'operating_income', 'net_income')").select(
        "company_id", (F.col("value") - 20000).alias("value"))
    revenue = f.where("canonical_metric = 'revenue'").groupBy("company_id").agg(F.round(F.sum("value") * 3, 2).alias("reported_revenue"))
    return v.segment_check(segments, revenue).select("company_id", F.round("segments_total", 2).alias("segments_total"), "reported_revenue",
                                                     F.round("difference", 6).alias("difference"), F.col("reconciles").cast("int").alias("reconciles"))


def citation_check(spark, d):
    t = twins.table(spark, d, "conversations")
    points = t.where("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("point_id"),
        F.array(*[F.concat(F.lit("C"), (F.col(c) * k).cast("string")) for c, k in (("conv_id", 3), ("turn", 2), ("conv_id", 7))]).alias("refs"))
    refs = twins.table(spark, d, "labels").select(F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("ref"), F.lit("change").alias("ref_type"))
    out = v.valid_points(points, refs)
    return out.select("point_id", F.size("valid_refs").cast("long").alias("n_valid"), F.array_join("valid_refs", ",").alias("valid_refs"))


def merge_headlines(spark, d):
    docs = twins.texts(spark, d, "documents")
    items = docs.select("source", F.col("lang").alias("list_name"), F.col("doc_id").alias("item_id"), (F.col("doc_id") % 2).alias("filing_rank"),
                        F.col("n_chars").alias("position"), F.element_at(F.split("text", "\n"), 1).alias("headline"))
    out = v.merged_items(items.withColumnRenamed("source", "company_id"), 3)
    return out.select("company_id", "list_name", "item_id", F.col("rank").cast("long").alias("rank"))


def corpus_stats(spark, d):
    docs = twins.table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("languages"))


def text_prose_budget(spark, d):
    lines = twins.sections(spark, d).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where(F.col("line") != "")
    kept = s.take_within(lines, ["doc_id"], ["pos"], F.length("line") + 1, 2000)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max("running").alias("chars"))


QUERIES = {f.__name__: f for f in [
    company_search, section_chunks, term_statistics, bm25_top_passages, paragraph_terms, bm25_paragraphs, recent_turns, quote_in_source, figure_claims, source_figures,
    verified_items, segment_reconcile, citation_check, merge_headlines, corpus_stats, text_prose_budget]}

_NUM = fig.NUMBER
_STOP = "[" + ", ".join(f"'{w}'" for w in s.QUESTION_STOPWORDS) + "]"
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TERMS = ("list_transform(list_filter(regexp_extract_all(lower({}), '[a-z][a-z0-9''-]{{2,}}'), lambda w: NOT list_contains(" + _STOP
          + ", w)), lambda w: w[1:6])")
_SCALE = """CASE WHEN regexp_matches({0}, '(?i)trillion$') OR regexp_matches({0}, '(tn|T)$') THEN 1e12
                 WHEN regexp_matches({0}, '(?i)billion$') OR regexp_matches({0}, '(bn|B)$') THEN 1e9
                 WHEN regexp_matches({0}, '(?i)million$') OR regexp_matches({0}, '(mm|M)$') THEN 1e6
                 WHEN regexp_matches({0}, '(?i)thousand$') OR regexp_matches({0}, 'K$') THEN 1e3 ELSE 1.0::double END"""

VIEWS.update({
    "claim_text": rf"""
        SELECT doc_id, 'amount' AS kind, unnest(regexp_extract_all(text,
               '\$\s?(?:{_NUM})(?:\s*(?:(?i:trillion|billion|million|thousand))\b|(?:tn|bn|mm|[TBMK])\b)?')) AS t FROM section
        UNION ALL
        SELECT doc_id, 'percent', unnest(regexp_extract_all(text,
               '(^|[^\w.])((?:{_NUM})\s*(?:%|(?i:percentage\s+points?|percent|basis\s+points?|bps|pts?)\b))', 2)) FROM section""",
    "claim": rf"""
        SELECT doc_id, kind, t AS text, regexp_extract(t, '({_NUM})', 1) AS digits,
               CASE WHEN kind = 'amount' THEN {_SCALE.format('t')}
                    WHEN regexp_matches(lower(t), '(basis\s+points?|bps)$') THEN 0.01::double ELSE 1.0::double END AS scale
        FROM claim_text""",
    "claim_value": r"""
        SELECT doc_id, kind, text, CASE WHEN kind = 'percent' AND scale < 1 THEN replace(digits, ',', '')::double / 100
                                        ELSE replace(digits, ',', '')::double * scale END AS value,
               0.5::double * pow(10.0::double, -length(regexp_extract(digits, '\.(\d+)$', 1))) AS half, scale FROM claim""",
    "searched": """
        SELECT p_partkey AS position, p_type[1:2] || p_size AS ticker,
               trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part""",
    "asked": """
        SELECT query, replace(upper(trim(query)), '.', '-') AS tq,
               trim(regexp_replace(regexp_replace(lower(query), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS nq FROM (
            SELECT DISTINCT unnest([p_name, substring(p_name, 3, 5), p_brand, p_type[1:3], 'b', p_type[1:2] || p_size]) AS query FROM part) AS q""",
})

VIEWS.update({
    "para": f"""
        SELECT pool, chunk_id, length(line) AS chars, {_TERMS.format('line')} AS terms FROM (
            SELECT source AS pool, doc_id || '-' || i AS chunk_id, lines[i + 1] AS line FROM (
                SELECT source, doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents) AS a) AS b) AS c
        WHERE length(line) >= 80""",
    "para_pool": "SELECT pool, count(*) AS n, avg(len(terms)) AS average FROM para GROUP BY pool",
    "para_term": """
        SELECT t.*, tf * 2.2::double / (tf + (length / average * 0.75::double + 0.25::double) * 1.2::double) AS part FROM (
            SELECT pool, chunk_id, chars, len(terms) AS length, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM para) AS x GROUP BY ALL) AS t
        JOIN para_pool USING (pool)""",
    "para_stat": """
        SELECT pool, term, df, most, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) AS idf
        FROM (SELECT pool, term, count(*) AS df, max(part) AS most FROM para_term GROUP BY ALL) AS x JOIN para_pool USING (pool)""",
    "ask_turn": """
        SELECT t.conv_id || '-' || t.turn AS question_id, 'src' || (t.conv_id % 20) AS pool, t.text[1:500] AS question, b.text[1:500] AS follow_up
        FROM conversations AS t LEFT JOIN conversations AS b ON b.conv_id = t.conv_id AND b.role = 'user' AND b.turn + 2 = t.turn WHERE t.role = 'user'""",
    "ask_term": f"""
        SELECT question_id, pool, term, max(weight) AS weight FROM (
            SELECT question_id, pool, unnest({_TERMS.format('question')}) AS term, 1.0::double AS weight FROM ask_turn
            UNION ALL
            SELECT question_id, pool, unnest({_TERMS.format("coalesce(follow_up, '')")}), 0.5::double FROM ask_turn) AS x
        GROUP BY ALL""",
    "para_score": """
        SELECT question_id, chunk_id, any_value(chars) AS chars, round(sum(weight * idf * part), 9) AS score
        FROM ask_term JOIN para_stat USING (pool, term) JOIN para_term USING (pool, term) GROUP BY ALL""",
})

VIEWS.update({
    "prose_line": rf"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, line FROM (
            SELECT doc_id, unnest(range(len(lines))) AS i, trim(unnest(lines)) AS line FROM (
                SELECT doc_id, string_split(regexp_replace(translate(text, '{T.WIDE_SPACES}', '{' ' * len(T.WIDE_SPACES)}'), '{T.PAGE_FURNITURE}', '', 'g'), chr(10)) AS lines
                FROM section) AS a) AS b
        WHERE line <> '' AND NOT ({tabular('line')})""",
    "packed": f"""
        WITH RECURSIVE r AS (
            SELECT DISTINCT doc_id, 0::bigint AS i, '' AS buffer, NULL::varchar AS done, 0 AS ordinal FROM prose_line
            UNION ALL
            SELECT doc_id, i, CASE WHEN closes OR buffer = '' THEN line ELSE buffer || ' ' || line END, CASE WHEN closes THEN buffer END,
                   ordinal + closes::int FROM (
                SELECT r.doc_id, l.i, r.buffer, r.ordinal, l.line, r.buffer <> '' AND length(r.buffer) + length(l.line) > {s.CHUNK_CHARS} AS closes
                FROM r JOIN prose_line AS l ON l.doc_id = r.doc_id AND l.i = r.i + 1) AS x)
        SELECT doc_id, ordinal - 1 AS ordinal, done AS chunk FROM r WHERE done IS NOT NULL
        UNION ALL
        SELECT * FROM (SELECT doc_id, arg_max(ordinal, i) AS ordinal, arg_max(buffer, i) AS chunk FROM r GROUP BY doc_id) AS t WHERE length(chunk) >= {s.MIN_TAIL}""",
    "chk": f"""
        SELECT d.source AS pool, p.doc_id || '-' || p.ordinal AS chunk_id, length(chunk) AS chars, chunk, {_TERMS.format('chunk')} AS terms
        FROM packed AS p JOIN documents AS d USING (doc_id)""",
})
# the statistics and scores of paragraphs, said of chunks
VIEWS.update({name.replace("para", "chk"): VIEWS[name].replace("para", "chk") for name in ("para_pool", "para_term", "para_stat", "para_score")})

_BEST = """
        SELECT question_id, chunk_id, round(score, 6) AS score, place FROM (
            SELECT *, sum(chars) OVER (PARTITION BY question_id ORDER BY place) AS size FROM (
                SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS place FROM {} WHERE score > 0) AS a
            WHERE place <= 8) AS b
        WHERE size <= 7000"""

ORACLES = {
    "section_chunks": sql("SELECT pool, chunk_id, chars, sha1(chunk) AS hash FROM chk"),
    "term_statistics": sql("SELECT pool, term, count(*) AS df, sum(tf)::bigint AS tf FROM chk_term GROUP BY ALL"),
    "bm25_top_passages": sql(_BEST.format("chk_score")),
    "paragraph_terms": sql("SELECT pool, term, df, round(idf, 9) AS idf, round(most, 9) AS most FROM para_stat"),
    "bm25_paragraphs": sql(_BEST.format("para_score")),
    "company_search": sql("""
        SELECT query, position, rank, place FROM (
            SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, position) AS place FROM (
                SELECT query, position, CASE WHEN ticker = tq THEN 0 WHEN starts_with(ticker, tq) THEN 1
                           WHEN nq <> '' AND starts_with(name, nq) THEN 2 WHEN nq <> '' AND contains(' ' || name, ' ' || nq) THEN 3
                           WHEN length(replace(nq, ' ', '')) >= 3 AND contains(replace(name, ' ', ''), replace(nq, ' ', '')) THEN 4 END AS rank
                FROM asked, searched) AS a
            WHERE rank IS NOT NULL) AS b
        WHERE place <= 5"""),
    "recent_turns": """
        SELECT conv_id, turn, role, least(length(text), 1500) AS chars FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) AS x
        WHERE n <= 8 AND role IN ('user', 'assistant')""",
    "quote_in_source": f"""
        SELECT item_id AS quote_id, doc_id AS source_id
        FROM (SELECT item_id, {_NORM.format('text')} AS q, list_filter(list_transform(string_split_regex(text, '\\.\\.\\.|…'),
                     lambda f: {_NORM.format('f')}), lambda f: length(f) >= 15) AS parts FROM benchmark) AS b
        JOIN (SELECT doc_id, {_NORM.format('text')} AS t FROM documents) AS d
             ON length(q) >= 25 AND len(parts) > 0 AND len(list_filter(parts, lambda f: NOT contains(t, f))) = 0""",
    "figure_claims": sql("""
        SELECT doc_id, kind, value, round(CASE WHEN kind = 'amount' THEN half * scale * (1 + 1e-9::double)
                                               WHEN scale < 1 THEN half / 100 + 1e-9::double ELSE half + 1e-9::double END, 9) AS tolerance, text
        FROM claim_value"""),
    "segment_reconcile": sql("""
        SELECT company_id, segments_total, reported_revenue, round(segments_total / reported_revenue - 1, 6) AS difference,
               (abs(segments_total / reported_revenue - 1) <= 0.05::double)::int AS reconciles FROM (
            SELECT company_id, round(sum(value - 20000) FILTER (canonical_metric <> 'revenue' AND value > 20000), 2) AS segments_total,
                   round(sum(value) FILTER (canonical_metric = 'revenue') * 3, 2) AS reported_revenue
            FROM fact WHERE NOT is_comparative AND canonical_metric IN ('revenue', 'gross_profit', 'operating_income', 'net_income')
            GROUP BY company_id) AS x
        WHERE segments_total <> 0 AND reported_revenue <> 0"""),
    "citation_check": """
        SELECT point_id, count(*) AS n_valid, string_agg(ref, ',' ORDER BY ref) AS valid_refs FROM (
            SELECT DISTINCT conv_id || '-' || turn AS point_id, unnest(['C' || conv_id * 3, 'C' || turn * 2, 'C' || conv_id * 7]) AS ref
            FROM conversations WHERE role = 'assistant') AS p
        WHERE ref IN (SELECT 'C' || doc_id FROM labels) GROUP BY point_id""",
    "merge_headlines": """
        SELECT company_id, list_name, item_id, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, list_name ORDER BY filing_rank, position, item_id) AS rank FROM (
                SELECT source AS company_id, lang AS list_name, doc_id AS item_id, doc_id % 2 AS filing_rank, n_chars AS position,
                       row_number() OVER (PARTITION BY source, lang, lower(string_split(text, chr(10))[1]) ORDER BY doc_id % 2, n_chars, doc_id) AS n
                FROM documents) AS a
            WHERE n = 1) AS b
        WHERE rank <= 3""",
    "corpus_stats": """
        SELECT source, count(*) AS entries, sum(n_chars)::bigint AS chars, count(DISTINCT lang) AS languages FROM documents GROUP BY source""",
    "text_prose_budget": sql("""
        SELECT doc_id, count(*) AS lines, max(running)::bigint AS chars FROM (
            SELECT doc_id, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS running FROM (
                SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM section) AS l
            WHERE line <> '') AS r
        WHERE running <= 2000 GROUP BY doc_id"""),
}
