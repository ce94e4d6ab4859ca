import random
import time

from pyspark.sql import functions as F

from folioscope.functions import figures, text
from folioscope.functions import fixed_values as fv
from folioscope.operators import search, verify, wording

BASE = """We depend on a limited number of suppliers for key components of our products. Our revenue grew 12% because demand for accelerators was strong in all regions. \
Competition in our markets could reduce our margins and harm our operating results over time. Changes in export rules issued in fiscal 2025 may limit our sales to customers. \
The lease of our old campus expires soon and will not be renewed by the landlord."""
NEW = """We depend on a limited number of suppliers for key components of our products. Our revenue grew 15% because demand for accelerators was strong in all regions. \
Competition in our markets could significantly reduce our margins and harm our operating results over time. Changes in export rules issued in fiscal 2026 may limit our sales to customers. \
A subpoena was received from the regulator about our partner program."""


def test_section_diff(spark):
    df = spark.createDataFrame([(1, "new", NEW, True), (1, "base", BASE, True)], "pair_id long, side string, text string, same_kind boolean")
    rows = wording.sentence_rows(df, ["pair_id", "side", "same_kind"])
    status = [r.status for r in wording.compare_sentences(rows).where("side = 'new'").orderBy("pos").collect()]
    assert status == ["repeated", "numbers", "reworded", "repeated", "new"]
    found = {(r.change_type, r.kind): r for r in wording.section_diff(rows).collect()}
    assert set(found) == {("changed", "numbers"), ("changed", "wording"), ("new", "wording"), ("removed", "wording")}
    assert [t.phrase for t in found[("new", "wording")].triggers] == ["subpoena"]
    assert found[("new", "wording")].triggers[0].weight == 0.7     # it has happened, so it counts in full
    assert found[("removed", "wording")].text.startswith("The lease of our old campus")


def test_removals_only_between_reports_of_a_kind(spark):
    df = spark.createDataFrame([(1, "new", NEW, False), (1, "base", BASE, False)], "pair_id long, side string, text string, same_kind boolean")
    kinds = {r.change_type for r in wording.section_diff(wording.sentence_rows(df, ["pair_id", "side", "same_kind"])).collect()}
    assert "removed" not in kinds


def test_passages_are_closed_at_the_limit(spark):
    sentences = [f"Sentence number {c} talks at length about quite a different topic than all others do. " for c in "ABCDEFGH"]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "pos int, sentence string")
    rows = items.agg(F.sort_array(F.collect_list(F.struct("pos", "sentence"))).alias("items"))
    got = rows.select(wording.run_numbers("items", lambda i: i.pos != 5, 200)).collect()[0][0]
    assert got == [0, 0, 0, 1, 1, -1, 2, 2]


def test_figures_trace_within_their_rounding(spark):
    source = "Revenue was $215.9 billion. (in millions) Total 215,938 and 4,020 in 2026. Margin 71.1%, up 25 basis points."
    claims = "Revenue of $216B and $215.94B, $999M, 71% margin, 0.25% more; 2026 was page 12."
    df = spark.createDataFrame([(source, claims)], "s string, c string").select(figures.source_figures("s").alias("f"), figures.claims("c").alias("c"))
    got = df.select(F.transform("c", lambda c: F.struct(c.text.alias("t"), figures.traced(c, F.col("f")).alias("ok"))).alias("r")).collect()[0].r
    assert {r.t: r.ok for r in got} == {"$216B": True, "$215.94B": True, "$999M": False, "71%": True, "0.25%": True}


def test_quotes(spark):
    source = "Demand for our products was strong in every region, and supply remained constrained throughout the year."
    quotes = ["Demand for our products was “strong” in every region", "Demand for our products … supply remained constrained",
              "Demand for products was strong everywhere", "Demand for our"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(quotes)], "quote_id int, quote string")
    src = spark.createDataFrame([(7, source), (8, "Nothing of the kind was ever written here.")], "source_id int, text string")
    assert sorted((r.quote_id, r.source_id) for r in verify.find_quotes(df, src).collect()) == [(0, 7), (1, 7)]


def test_short_quotes_are_found_like_brute_force(spark):
    words = "incomprehensibilities notwithstanding counterproductively said internationalization experts yesterday"
    quotes = ["incomprehensibilities notwithstand", "comprehensibilities notwithstanding c", "counterproductively said internat", "internationalizations experts"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(quotes)], "quote_id int, quote string")
    src = spark.createDataFrame([(1, words)], "source_id int, text string")
    assert sorted(r.quote_id for r in verify.find_quotes(df, src).collect()) == [i for i, q in enumerate(quotes) if q in words]


def test_company_search_ranks(spark):
    rows = [(0, "AAPL", "apple inc"), (1, "APLE", "apple hospitality reit"), (2, "BRK-B", "berkshire hathaway inc"), (3, "PIN", "big pineapple co")]
    companies = spark.createDataFrame(rows, "position int, ticker string, norm_name string").withColumn("compact_name", F.replace("norm_name", F.lit(" "), F.lit("")))
    queries = spark.createDataFrame([("apple",), ("aapl",), ("brk.b",), ("hathaway",), ("neapple",)], "query string")
    got = {}
    for r in search.search_companies(companies, queries).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.ticker)
    assert got == {"apple": ["AAPL", "APLE", "PIN"], "aapl": ["AAPL"], "brk.b": ["BRK-B"], "hathaway": ["BRK-B"], "neapple": ["PIN"]}


def test_small_texts(spark):
    df = spark.createDataFrame([("Grew to $25.0 B 【S1†L3】 and [S2, F] **now**",)], "t string")
    assert df.select(text.tidy_answer("t")).collect()[0][0] == "Grew to $25.0B [S1] and [S2][F] now"
    labels = spark.createDataFrame([("Supply commitments (a)*",), ("Total",), ("Net other",)], "t string")
    assert [r[0] for r in labels.select(text.reported_label("t")).collect()] == ["Supply commitments", None, None]


def test_citations_become_one_bracket_each(spark):
    from folioscope.functions import text
    df = spark.createDataFrame([("So [S1, S2; S3, S4, S5, S6] and [F] and [S7†x, y] S8, S9] **end** $25.0 B",)], "t string")
    assert df.select(text.tidy_answer("t")).first()[0] == "So [S1][S2][S3][S4][S5][S6] and [F] and [S7] S8, S9] end $25.0B"


def test_entities_become_their_characters(spark):
    from folioscope.sources import html
    rows = [("caf&eacute; &#8208; &#x2019; &#937; &#x1F600; &Omega; &amp;lt; &nope; &#0; &#xD800; &nbsp;end &amp;amp;",)]
    got = spark.createDataFrame(rows, "html string").select(html.text_of("html")).first()[0]
    assert got == "café ‐ ' Ω 😀 Ω &lt; &nope; &#0; &#xD800; end &amp;"


def test_language_that_the_summary_names(spark):
    from folioscope.operators import audit
    sentences = spark.createDataFrame([(1, "going concern", "a"), (1, "default", "b"), (2, "default", "c"), (3, "no", "d")], "company_id long, phrase string, sentence string")
    points = spark.createDataFrame([(1, "Doubts about GOING on", "There is concern."), (1, "Other", None), (2, None, "Defaulted")],
                                   "company_id long, headline string, detail string")
    got = {(r.company_id, r.phrase): r.covered_by for r in audit.covered_language(sentences, points).collect()}
    assert got == {(1, "going concern"): ["(summary wording)"], (1, "default"): None, (2, "default"): ["(summary wording)"], (3, "no"): ["(summary wording)"]}


def test_any_trigger_matches_where_one_of_its_patterns_does(spark):
    plain = "(?i)" + "|".join(f"(?:{p})" for p, _, _ in fv.TRIGGERS)
    said = [phrase for _, phrase, _ in fv.TRIGGERS] + [
        "Restated", "prestated", "SUBSEQUENT to the end of the quarter", "subsequently", "significant non-refundable payment", "License Requirement",
        "cyberattack", "in default", "defaulting", "defaults under", "materially adversely affect", "guarantor", "unable", "unable to", "ſubpoena",
        "INVESTİGATION", "", "nothing", "event\nof default"]
    rows = spark.createDataFrame([(f"{before}{s}{after}",) for s in said for before in ("", "x", "a ") for after in ("", "y", " b.")] + [(None,)], "text string")
    got = rows.select(F.col("text").rlike(text.ANY_TRIGGER).alias("new"), F.col("text").rlike(plain).alias("plain")).collect()
    assert all(r.new == r.plain for r in got) and any(r.new for r in got) and any(r.new is False for r in got)


def test_looking_for_triggers_costs_less_than_trying_every_pattern(spark):
    plain = "(?i)" + "|".join(f"(?:{p})" for p, _, _ in fv.TRIGGERS)
    words = " ".join(["the merchant sold goods in every region and expected no restraint or unusual demand"] * 10000)
    rows = spark.range(8).select(F.concat(F.lit(words), F.col("id").cast("string")).alias("text")).localCheckpoint()

    def seconds(pattern):
        begun = time.perf_counter()
        assert rows.where(F.col("text").rlike(pattern)).count() == 0
        return time.perf_counter() - begun

    assert min(seconds(text.ANY_TRIGGER) for _ in range(2)) < min(seconds(plain) for _ in range(2)) / 2


def test_breaks_and_wide_spaces_in_prose(spark):
    texts = ["It cost EUR \n 5 and $\n7 more.\n\n  we paid it. The end came. • Next  • item", "one two three\nfour", "a \t\n b", "Inc. A. U.S. The rest.  (So it is", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.p for r in rows.select("i", text.prose_text("text").alias("p")).orderBy("i").collect()]
    assert got == ["It cost EUR 5 and $ 7 more. we paid it. The end came. • Next  • item", "one two three four", "a b", "Inc. A. U.S. The rest.  (So it is", "", ""]
    cut = rows.where("i IN (0, 3)").select("i", F.regexp_replace("text", text.SENTENCE_BREAK, "|").alias("p")).orderBy("i").collect()
    assert [r.p for r in cut] == ["It cost EUR \n 5 and $\n7 more.\n\n  we paid it.|The end came.||Next|item", "Inc. A.|U.S. The rest.|(So it is"]


def test_breaks_are_those_of_the_patterns_without_what_they_begin_with(spark):
    rnd = random.Random(6)
    pieces = [" ", "\n", "\t", "•", ".", "?", ";", "A", "b", "U.S.", "Inc.", "EUR", "$", "(", "5", "“", '"', "\u00a0", "é"]
    rows = spark.createDataFrame([("".join(rnd.choices(pieces, k=rnd.randint(0, 25))),) for _ in range(3000)], "t string")
    for pattern, begin in ((text.SENTENCE_BREAK, "(?=[\\s•])(?:"), (text.CURRENCY_BREAK, "(?=[ \\t\\n])(?:")):
        assert pattern.startswith(begin) and pattern.endswith(")")
        plain = pattern[len(begin):-1]
        assert rows.where(F.regexp_replace("t", pattern, "|") != F.regexp_replace("t", plain, "|")).count() == 0
        assert rows.where(F.col("t").rlike(plain)).count() > 0
