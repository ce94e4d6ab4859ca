"""Sentences, fingerprints, section differences, trigger phrases."""

from pyspark.sql import functions as F

from folioscope.functions import fixed_values as fv
from folioscope.functions import text as T
from folioscope.operators import wording as w
from folioscope.plans import twins

from .views import VIEWS, sql


def sentence_fingerprints(spark, d):
    return w.sentence_rows(twins.sections(spark, d), ["doc_id"]).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.length("sentence").cast("long").alias("chars"), "exact", "masked")


def _status(spark, d, side="new"):
    return w.compare_sentences(twins.diff_inputs(spark, d)).where(F.col("side") == side)


def sentence_status(spark, d):
    return _status(spark, d).select("pair_id", F.col("pos").cast("long").alias("pos"), "status", F.sha1("old_text").alias("old_hash"))


def diff_counts(spark, d):
    return w.diff_counts(w.compare_sentences(twins.diff_inputs(spark, d)))


def reworded_sentences(spark, d):
    return _status(spark, d).where(F.col("status") == "reworded").select(
        "pair_id", F.col("pos").cast("long").alias("pos"), "similarity", F.sha1("old_text").alias("old_hash"))


def unused_base_sentences(spark, d):
    return _status(spark, d, "base").where(F.col("status") == "unused").select("pair_id", F.col("pos").cast("long").alias("pos"), "exact")


def section_passages(spark, d):
    p = w.section_diff(twins.diff_inputs(spark, d))
    return p.select("pair_id", "change_type", "kind", F.col("position").cast("long").alias("position"), F.sha1("text").alias("text_hash"),
                    F.col("modality_shift").cast("int").alias("modality_shift"), F.size("triggers").cast("long").alias("n_triggers"),
                    F.try_element_at("triggers", F.lit(1)).weight.alias("top_weight"))


def trigger_phrases(spark, d):
    t = T.with_triggers(twins.sections(spark, d)).select("doc_id", F.explode_outer("triggers").alias("t")).where(F.col("t").isNotNull())
    return t.select("doc_id", "t.phrase", "t.weight", F.col("t.realized").cast("int").alias("realized"))


def repeated_lines(spark, d):
    return w.repeated_lines(twins.texts(spark, d, "documents"))


def outline_lines(spark, d):
    lines = twins.sections(spark, d).select("doc_id", F.explode_outer(T.outline_lines("text")).alias("line")).where(F.col("line").isNotNull())
    return lines.select("doc_id", F.sha1("line").alias("line_hash"))


QUERIES = {f.__name__: f for f in [
    sentence_fingerprints, sentence_status, diff_counts, reworded_sentences, unused_base_sentences, section_passages,
    trigger_phrases, repeated_lines, outline_lines]}

_NOTES = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in twins.NOTES) + "]"
_ABBR = "|".join(fv.ABBREVIATIONS)
_SHAPE = r"trim(regexp_replace(lower({}), '[^a-z0-9#]+', ' ', 'g'))"
_DATE = T.DATE
_WORD_LIST = "[" + ", ".join(f"'{w_}'" for w_ in fv.STOPWORDS) + "]"
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z][a-z''-]{{2,}}')), lambda x: NOT list_contains(" + _WORD_LIST + ", x))"


def _mark(source):
    """A text column with sentence breaks as line feeds."""
    steps = [
        (r"(?i)\s*\b\d{0,3}\s*Table of Contents\b\s*", " "),
        (r"\b(USD|CHF|EUR|GBP|CAD|JPY|AUD|HKD|SGD|CNY|TWD|NTD|RMB)[ \t]*\n\s*([\d(])", r"\1 \2"),
        (r"([$€£¥])[ \t]*\n\s*(\d)", r"\1 \2"),
        (r"(?im)^(?:\d{1,3}|PART\s+[IV]+|Item\s+\d{1,2}[A-C]?\.?|Table of Contents)[ \t]*\n", ""),
        (r"[ \t]*\n\s*([a-z])", r" \1"),
        (rf"\b({_ABBR})\.(\s)", "\\1\x01\\2"),
        (r"([A-Z]\.[A-Z])\.(\s)", "\\1\x01\\2"),
        ("([.!?;])\\s+([A-Z“\"(•])", "\\1\n\\2"),
        (r"\s*•\s*", "\n"),
        ("\x01", "."),
    ]
    text = f"translate({source}, '{T.WIDE_SPACES}', '{' ' * len(T.WIDE_SPACES)}')"
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


def _sentences(source):
    return (f"list_filter(list_transform(string_split({_mark(source)}, chr(10)), "
            r"lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 40 "
            f"AND NOT regexp_matches(x, '(?i){fv.BOILERPLATE}') AND NOT ({tabular('x')}))")


def tabular(x):
    tokens = rf"string_split_regex(trim({x}), '\s+')"
    figures = rf"len(list_filter({tokens}, lambda t: regexp_matches(t, '{T.FIGURE}')))"
    end = "[.!?:;][”\"'')]*$"
    return (f"(len({tokens}) >= 8 AND {figures} / len({tokens}) > 0.3) OR ({figures} > 0 AND NOT regexp_matches(trim({x}), '{end}'))")


def outline_line(x):
    return f"length({x}) BETWEEN 40 AND 400 AND regexp_matches({x}, '[.:]$') AND len({_sentences(x)}) = 1"


VIEWS.update({
    "section": f"""
        SELECT doc_id, text || chr(10) || replace(replace({_NOTES}[doc_id % {len(twins.NOTES)} + 1], '{{n}}', (doc_id % 50 + 1)::varchar),
               '{{y}}', (doc_id % 3 + 2020)::varchar) AS text FROM documents""",
    "sentence": f"""
        SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS s FROM (SELECT doc_id, {_sentences('text')} AS s FROM section) AS x""",
    "fingerprint": f"""
        SELECT doc_id, pos, s, sha1({_SHAPE.format('s')}) AS exact,
               sha1({_SHAPE.format(f"regexp_replace(regexp_replace(s, '{_DATE}', '#date', 'g'), '{T.NUMBER}', '#', 'g')")}) AS masked
        FROM sentence""",
    "doc_line": "SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM section",
    "doc_pair": """
        SELECT doc_id AS pair_id, coalesce(b.base_id, doc_id - 8) AS base_id
        FROM documents LEFT JOIN (
            SELECT doc_id, max_by(first_id, (votes, -first_id)) AS base_id FROM (
                SELECT l.doc_id, f.first_id, count(*) AS votes
                FROM doc_line AS l JOIN (SELECT line, min(doc_id) AS first_id FROM doc_line GROUP BY line) AS f ON f.line = l.line
                WHERE length(l.line) > 60 AND f.first_id < l.doc_id GROUP BY ALL) AS v
            GROUP BY doc_id) AS b USING (doc_id)""",
    "new_sentence": """
        SELECT pair_id, pos, s, exact, masked FROM doc_pair JOIN fingerprint ON doc_id = pair_id""",
    "base_sentence": """
        SELECT pair_id, pos, s, exact, masked FROM doc_pair JOIN fingerprint ON doc_id = base_id""",
    "first_status": f"""
        SELECT n.*, o.s AS old_s, o.exact AS old_exact,
               CASE WHEN k.exact IS NOT NULL THEN 'repeated' WHEN o.s IS NULL THEN 'new'
                    WHEN len(xs) = len(ys) AND len(list_filter(list_zip(xs, ys), lambda z: NOT (z[1] = z[2] OR coalesce(
                         regexp_full_match(z[1], '(19|20)\\d\\d') AND regexp_full_match(z[2], '(19|20)\\d\\d')
                         AND abs(try_cast(z[1] AS int) - try_cast(z[2] AS int)) <= 2, false)))) = 0 THEN 'repeated'
                    ELSE 'numbers' END AS status, k.exact IS NOT NULL AS same
        FROM (SELECT *, regexp_extract_all(regexp_replace(s, '{_DATE}', ' ', 'g'), '{T.NUMBER}') AS xs FROM new_sentence) AS n
        LEFT JOIN (SELECT DISTINCT pair_id, exact FROM base_sentence) AS k ON k.pair_id = n.pair_id AND k.exact = n.exact
        LEFT JOIN (SELECT *, regexp_extract_all(regexp_replace(s, '{_DATE}', ' ', 'g'), '{T.NUMBER}') AS ys FROM (
                       SELECT pair_id, masked, arg_min(s, pos) AS s, arg_min(exact, pos) AS exact FROM base_sentence GROUP BY ALL) AS q) AS o
             ON o.pair_id = n.pair_id AND o.masked = n.masked""",
    "unmatched_base": """
        SELECT b.* FROM base_sentence AS b WHERE NOT EXISTS (
            SELECT 1 FROM first_status AS f WHERE f.pair_id = b.pair_id AND f.status <> 'new'
            AND CASE WHEN f.same THEN f.exact ELSE f.old_exact END = b.exact)""",
    "similar_pair": f"""
        SELECT * FROM (
            SELECT a.pair_id, a.pos, b.s AS old_s, b.exact AS old_exact, b.pos AS old_pos,
                   len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity,
                   row_number() OVER (PARTITION BY a.pair_id, a.pos ORDER BY
                       len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) DESC, b.pos) AS n
            FROM (SELECT *, {_WORDS.format('s')} AS w FROM first_status WHERE status = 'new') AS a
            JOIN (SELECT *, {_WORDS.format('s')} AS w FROM unmatched_base) AS b ON b.pair_id = a.pair_id
            WHERE len(a.w) >= 4
              AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.75) AS x
        WHERE n = 1""",
    "final_status": """
        SELECT f.pair_id, f.pos, f.s, CASE WHEN m.pos IS NOT NULL THEN 'reworded' ELSE f.status END AS status,
               CASE WHEN m.pos IS NOT NULL THEN m.old_s WHEN f.status = 'numbers' THEN f.old_s END AS old_text, m.similarity
        FROM first_status AS f LEFT JOIN similar_pair AS m ON m.pair_id = f.pair_id AND m.pos = f.pos""",
})

_TRIGGER_LIST = "[" + ", ".join(
    "{p: '" + p.replace("'", "''") + f"', phrase: '{phrase}', w: {weight}::double" + "}" for p, phrase, weight in fv.TRIGGERS) + "]"

VIEWS.update({
    "run_step": f"""
        WITH RECURSIVE r AS (
            SELECT DISTINCT pair_id, -1::bigint AS pos, 0 AS n, 0 AS size, 0 AS mine, '' AS s, '' AS status FROM final_status
            UNION ALL
            SELECT pair_id, pos, CASE WHEN closes THEN n + 1 ELSE n END, CASE WHEN closes THEN 0 ELSE grown END, n, s, status FROM (
                SELECT f.pair_id, f.pos, r.n, r.size + length(f.s) AS grown, f.s, f.status,
                       f.status <> 'new' OR r.size + length(f.s) >= {fv.PASSAGE_CHARS} AS closes
                FROM r JOIN final_status AS f ON f.pair_id = r.pair_id AND f.pos = r.pos + 1) AS x)
        SELECT pair_id, pos, mine, s FROM r WHERE status = 'new'""",
    "unused_base": """
        SELECT b.pair_id, b.pos, b.s, b.exact FROM unmatched_base AS b
        WHERE NOT EXISTS (SELECT 1 FROM similar_pair AS m WHERE m.pair_id = b.pair_id AND m.old_exact = b.exact)""",
    "passage": f"""
        SELECT pair_id, 'new' AS change_type, 'wording' AS kind, min(pos) AS position, string_agg(s, ' ' ORDER BY pos)[1:{fv.PASSAGE_CHARS}] AS text,
               NULL::varchar AS base_text FROM run_step GROUP BY pair_id, mine
        UNION ALL
        SELECT pair_id, 'changed', CASE status WHEN 'numbers' THEN 'numbers' ELSE 'wording' END, pos, s, old_text
        FROM final_status WHERE status IN ('numbers', 'reworded')
        UNION ALL
        SELECT pair_id, 'removed', 'wording', min(pos) + coalesce(any_value(news), 0), string_agg(s, ' ' ORDER BY pos)[1:{fv.PASSAGE_CHARS}], NULL
        FROM (SELECT *, pos - row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS island FROM unused_base) AS u
        LEFT JOIN (SELECT pair_id, count(*) AS news FROM final_status GROUP BY pair_id) AS c USING (pair_id)
        WHERE pair_id % 2 = 0 GROUP BY pair_id, island""",
    "passage_trigger": f"""
        SELECT pair_id, change_type, position, count(*) AS n_triggers, max(weight) AS top_weight FROM (
            SELECT pair_id, change_type, position, t.p, max(CASE WHEN realized THEN t.w ELSE round(t.w * 0.5::double, 3) END) AS weight
            FROM (SELECT *, regexp_matches(u, '(?i){fv.REALIZED}') AND NOT regexp_matches(u, '(?i){fv.HYPOTHETICAL}') AS realized FROM (
                      SELECT pair_id, change_type, position, unnest(CASE WHEN len(units) > 0 THEN units ELSE [text] END) AS u FROM (
                          SELECT *, {_sentences('text')} AS units FROM passage) AS a) AS b) AS c,
                 (SELECT unnest({_TRIGGER_LIST}) AS t) AS d
            WHERE regexp_matches(u, '(?i)' || t.p)
              AND NOT (t.phrase = 'restatement' AND regexp_matches(u, '(?i){fv.PRESENTATION_RESTATEMENT}')) GROUP BY ALL) AS e
        GROUP BY ALL""",
})

ORACLES = {
    "section_passages": sql(f"""
        SELECT pair_id, change_type, kind, position, sha1(text) AS text_hash, coalesce(n_triggers, 0) AS n_triggers, top_weight,
               (base_text IS NOT NULL AND regexp_matches(coalesce(base_text, ''), '(?i){fv.HYPOTHETICAL}')
                AND NOT regexp_matches(text, '(?i){fv.HYPOTHETICAL}') AND regexp_matches(text, '(?i){fv.REALIZED}'))::int AS modality_shift
        FROM passage LEFT JOIN passage_trigger USING (pair_id, change_type, position)"""),
    "sentence_fingerprints": sql("SELECT doc_id, pos, length(s) AS chars, exact, masked FROM fingerprint"),
    "sentence_status": sql("SELECT pair_id, pos, status, sha1(old_text) AS old_hash FROM final_status"),
    "diff_counts": sql("""
        SELECT pair_id, count(*) AS total, count(*) FILTER (status = 'repeated') AS repeated,
               count(*) FILTER (status = 'numbers') AS numbers, count(*) FILTER (status = 'reworded') AS reworded,
               count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'repeated') / count(*) AS repeated_share
        FROM final_status GROUP BY pair_id
        UNION ALL
        SELECT DISTINCT pair_id, 0, 0, 0, 0, 0, 1.0::double FROM base_sentence WHERE pair_id NOT IN (SELECT pair_id FROM final_status)"""),
    "reworded_sentences": sql("SELECT pair_id, pos, similarity, sha1(old_s) AS old_hash FROM similar_pair"),
    "unused_base_sentences": sql("""
        SELECT b.pair_id, b.pos, b.exact FROM unmatched_base AS b
        WHERE NOT EXISTS (SELECT 1 FROM similar_pair AS m WHERE m.pair_id = b.pair_id AND m.old_exact = b.exact)"""),
    "trigger_phrases": sql(f"""
        SELECT doc_id, phrase, max(CASE WHEN realized THEN w ELSE w * 0.5::double END) AS weight, max(realized::int) AS realized FROM (
            SELECT doc_id, t.phrase AS phrase, t.w AS w,
                   regexp_matches(s, '(?i){fv.REALIZED}') AND NOT regexp_matches(s, '(?i){fv.HYPOTHETICAL}') AS realized
            FROM sentence, (SELECT unnest({_TRIGGER_LIST}) AS t) AS tt
            WHERE regexp_matches(s, '(?i)' || t.p)
              AND NOT (t.phrase = 'restatement' AND regexp_matches(s, '(?i){fv.PRESENTATION_RESTATEMENT}'))) AS x
        GROUP BY doc_id, phrase"""),
    "outline_lines": sql(f"""
        SELECT DISTINCT doc_id, sha1(l) AS line_hash FROM (
            SELECT doc_id, trim(regexp_replace(trim(line), '^[•●▪\\- ]+', '')) AS l FROM doc_line) AS x
        WHERE {outline_line('l')}"""),
    "repeated_lines": """
        SELECT line, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS l
        WHERE length(line) BETWEEN 4 AND 120 AND NOT regexp_matches(line, '(?i)^(page\\s+)?\\d{1,3}$')
        GROUP BY line HAVING count(*) >= 10""",
}
