"""The registered queries of this package and their SQL twins.

Each query applies one operator to its whole table with the parameters a
pipeline would use, and derives the columns that are compared.
"""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from folioscope.functions.arith import once
from folioscope.llm import bpe, chat, decontaminate, fill_middle, licenses, line_crf, line_runs, periodic, simhash, substrings, toxicity, warc, wrappers


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op4_byte_bpe(spark, folder):
    """Token ids of every document and the bytes they decode to, as counts and digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_chat(spark, folder):
    """Conversations that no longer one begins with, rendered."""
    found = chat.formatted(table(spark, folder, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "n_turns", F.char_length("chat").cast("long").alias("n_chars"),
                        F.sha2("chat", 256).alias("chat_sha256"))


OP1_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), so_far AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(coalesce('=' || role, '-') || chr(2) || coalesce('=' || text, '-'), chr(1)) OVER (
           w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST)
), whole AS (
  SELECT * FROM so_far WHERE place = n
), gone AS (
  SELECT DISTINCT a.conv_id FROM whole a JOIN so_far b ON a.place = b.place AND a.prefix = b.prefix
  WHERE b.n > a.n OR b.n = a.n AND b.conv_id < a.conv_id
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST) AS chat
  FROM t WHERE conv_id NOT IN (SELECT conv_id FROM gone) GROUP BY conv_id
)
SELECT conv_id, n_turns, CAST(length(chat) AS BIGINT) AS n_chars, sha256(chat) AS chat_sha256 FROM chats
"""


def op2_simhash(spark, folder):
    """Fingerprint of every document and the least document that near-duplicate links reach."""
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontamination(spark, folder):
    """Words of every document that windows of benchmark items cover, and the items."""
    found = decontaminate.hits(decontaminate.contaminated(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM windows)
), found AS (
  SELECT p.doc_id, p.p, p.size, x.item_id FROM places p
  JOIN windows x ON x.size = p.size AND x.win = array_to_string(p.w[p.p:p.p + p.size - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM found) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

def op5_licenses(spark, folder):
    """Licence of every document, seen as the file ``source/lang/thousands of the id/id``."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    found = licenses.scan(docs.select("doc_id", "text", path.alias("path")), keep=["doc_id"])
    return found.select("doc_id", "path", "license", "via", F.round("score", 6).alias("score"), "licence_dir")


OP5_SQL = r"""
WITH terms(template, license, word, n) AS (
  VALUES """ + ",\n         ".join(
    f"({i}, '{name}', '{w}', {n})" for i, (name, text) in enumerate(licenses.TEMPLATES) for w, n in Counter(licenses.words_of(text)).items()) + r"""
), d AS (
  SELECT doc_id, source || '/' || lang || '/' || (doc_id // 1000) AS folder, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), n AS (
  SELECT count(*) AS n FROM d
), number AS (
  SELECT word, count(*) AS k FROM (SELECT unnest(list_distinct(words)) AS word FROM d) GROUP BY word
), idf AS (
  SELECT DISTINCT t.word, ln((n.n + 1) / (coalesce(k, 0) + 1)) + 1 AS idf FROM terms t CROSS JOIN n LEFT JOIN number m ON m.word = t.word
), raw AS (
  SELECT template, license, word, (1 + ln(n)) * idf AS v FROM terms JOIN idf USING (word)
), vec AS (
  SELECT template, license, word, v / sqrt(sum(v * v) OVER (PARTITION BY template)) AS v FROM raw
), needed AS (
  SELECT DISTINCT word FROM (
    SELECT word, sum(v * v) OVER (PARTITION BY template ORDER BY v, word ROWS UNBOUNDED PRECEDING) AS below FROM vec) WHERE below >= 0.25
), need AS (
  SELECT list(word) AS words FROM needed
), lines AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(lower(body), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM d)
), chosen AS (
  SELECT doc_id, line, l.words, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run
  FROM lines l, need WHERE list_has_any(l.words, need.words)
), units AS (
  SELECT doc_id, 'line' AS kind, line AS pos, words FROM chosen
  UNION ALL
  SELECT doc_id, 'run', run, flatten(list(words ORDER BY line)) FROM chosen GROUP BY doc_id, run HAVING count(*) > 1
  UNION ALL
  SELECT doc_id, 'whole', 0, d.words FROM d, need WHERE list_has_any(d.words, need.words)
), weighted AS (
  SELECT doc_id, kind, pos, u.word, (1 + ln(k)) * coalesce(idf, ln(n.n + 1) + 1) AS v
  FROM (SELECT doc_id, kind, pos, word, count(*) AS k FROM (SELECT doc_id, kind, pos, unnest(words) AS word FROM units) GROUP BY ALL) u
  CROSS JOIN n LEFT JOIN idf ON idf.word = u.word
), norms AS (
  SELECT doc_id, kind, pos, sqrt(sum(v * v)) AS norm FROM weighted GROUP BY ALL
), scored AS (
  SELECT doc_id, kind, pos, license, round(dot / norm, 9) AS score FROM (
    SELECT doc_id, kind, pos, template, license, sum(w.v * t.v) AS dot FROM weighted w JOIN vec t ON t.word = w.word GROUP BY ALL)
  JOIN norms USING (doc_id, kind, pos)
), best AS (
  SELECT doc_id, kind, pos, license, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, kind, pos ORDER BY score DESC, license) = 1
), own AS (
  SELECT doc_id, license, score, kind = 'whole' AS is_file FROM best
  WHERE kind = 'whole' AND score >= 0.5 OR kind <> 'whole' AND score >= 0.6
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind = 'whole' DESC, score DESC, license) = 1
), folders AS (
  SELECT folder, license FROM own JOIN d USING (doc_id) WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, license) = 1
)
SELECT d.doc_id, d.folder || '/' || d.doc_id AS path, coalesce(o.license, f.license) AS license,
       CASE WHEN o.is_file THEN 'file' WHEN o.license IS NOT NULL THEN 'header' WHEN f.license IS NOT NULL THEN 'inherited' END AS via,
       round(o.score, 6) AS score, CASE WHEN o.license IS NULL THEN f.folder END AS licence_dir
FROM d LEFT JOIN own o USING (doc_id) LEFT JOIN folders f ON f.folder = d.folder
"""


def op6_substring_dedup(spark, folder):
    """Words of every document that are left when repeats of 35 words and more are removed."""
    left = substrings.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)
), again AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS pos FROM windows WHERE win IN (SELECT win FROM again)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS body FROM words ANTI JOIN removed USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op7_toxicity(spark, folder):
    """Toxicity of every document, fitted on labels outside the held-out bucket."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, table(spark, folder, "labels").select("doc_id", "toxic"))
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(toxicity.bucket("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))



def op8_quality_lines(spark, folder):
    """Counts over every document, and whether its lines are content for the better part."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chain = line_crf.trained(docs, table(spark, folder, "labels").select("doc_id", "quality"))
    return line_crf.judged(docs, chain).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark, folder):
    """Every page through archives: written as one stream, normalised, and read by offset."""
    back = warc.archived(table(spark, folder, "pages").select("page_id", "url", "html"))
    return back.select(F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                       F.col("kind").alias("record_type"), "refers_to")


OP9_SQL = """
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND largest <> page_id THEN largest END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
"""


def op10_html_extraction(spark, folder):
    """Main text of every page."""
    found = wrappers.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select(F.col("page").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_fill_in_middle(spark, folder):
    """Every document cut at random between tokens and rearranged, as lengths and digests, and what is rebuilt from that."""
    done = fill_middle.transformed(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents
), t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         CAST('0x' || substr(hash, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hash, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(hash, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hash, 25, 8) AS BIGINT) AS h4 FROM d
), forms AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS low,
         greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:low], '') AS prefix, array_to_string(w[low + 1:high], '') AS middle,
         array_to_string(w[high + 1:n], '') AS suffix FROM forms
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def planted(docs):
    """Documents of which one in ten repeats a part of its words up to its end, as the hash of its id says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = h % 10 == 0
    docs = docs.select("doc_id", "text", h.alias("h"))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    g, n = F.expr("h div 10"), F.size("words")
    first = (F.col("g") % n).cast("int")
    period = (1 + F.floor((n - F.col("first")) / (3 + F.col("g") % 8))).cast("int")
    rest = n - F.col("first")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("first") + 1, F.col("period")), F.ceil(rest / F.col("period")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("first")), F.slice(again, F.lit(1), rest)), " ")
    docs = once(once(once(docs, words=words, g=g), first=F.when(n > 0, first)), period=F.when(F.col("first").isNotNull(), period))
    return docs.select("doc_id", F.when(F.col("period").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, folder):
    """Runs of words that repeat with a period, in every document after one in ten was made periodic."""
    found = periodic.periodic_runs(planted(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_line_dedup(spark, folder):
    """Every document without the long lines that five documents have, but for the last of these."""
    left = line_runs.without_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), often AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(owner) FILTER (owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN often USING (key) GROUP BY r, doc_id
"""


QUERIES = {"op1_chat": op1_chat, "op2_simhash": op2_simhash, "op3_decontamination": op3_decontamination, "op4_byte_bpe": op4_byte_bpe,
           "op5_licenses": op5_licenses,
           "op6_substring_dedup": op6_substring_dedup, "op7_toxicity": op7_toxicity,
           "op8_quality_lines": op8_quality_lines, "op9_warc": op9_warc, "op10_html_extraction": op10_html_extraction,
           "op11_fill_in_middle": op11_fill_in_middle, "op12_periodic_runs": op12_periodic_runs, "op13_line_dedup": op13_line_dedup}

ORACLES = {"op1_chat": OP1_SQL, "op3_decontamination": OP3_SQL, "op5_licenses": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op9_warc": OP9_SQL,
           "op11_fill_in_middle": OP11_SQL, "op13_line_dedup": OP13_SQL}
