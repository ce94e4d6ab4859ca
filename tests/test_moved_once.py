"""What is moved once, counted once or made only where it is read."""

from datetime import date

from pyspark.sql import functions as F

from folioscope.operators import facts as fa
from folioscope.operators import numeric_changes as nc
from folioscope.operators import wording
from folioscope.operators.latest import year_earlier
from folioscope.plans import snapshot, twins, views


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _orders(spark, folder, parts=(0, 9, 17, None)):
    orders = [(1, "1996-02-03"), (2, "1997-02-03"), (3, "1997-11-30"), (4, None)]
    spark.createDataFrame(orders, "o_orderkey long, d string").select("o_orderkey", F.to_timestamp("d").alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    lines = [(o, p, 7, n, 10.25 * o, 0.05) for o in (1, 2, 3, 4) for p in parts for n in (1, 3, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double").write.parquet(
        f"{folder}/lineitem.parquet")


def test_facts_meet_by_company_before_they_are_named(spark, tmp_path):
    _orders(spark, tmp_path)
    facts = twins.facts(spark, str(tmp_path))
    per_line = facts.groupBy("company_id", "fact_key", "period_end").agg(F.max("value").alias("value"))
    assert _plan(facts).count("Exchange hashpartitioning") == _plan(per_line).count("Exchange hashpartitioning")
    got = {(r.fact_id, r.value, r.label, str(r.period_start), r.fiscal_period) for r in facts.where("filing_id = 7032").collect()}
    assert ("7|1997|4|0|own", 30.75, "metric revenue", "1997-10-01", "Q4") in got
    assert ("7|1997|4|0|ytd", 30.75, "metric revenue", "1997-01-01", "FY") in got
    assert ("7|1997|4|0|prior", 30.75, "metric revenue", "1996-10-01", "Q4") in got
    assert ("7|1997|4|9|own", 61.5, "metric cash", "None", "FY") in got


def test_tasks_by_company_are_bounded_by_lines(spark, tmp_path, monkeypatch):
    _orders(spark, tmp_path)
    monkeypatch.setattr(twins, "TASK_LINES", 3)
    facts = twins.facts(spark, str(tmp_path))
    assert "hashpartitioning(company_id#" in _plan(facts) and ", 16), REPARTITION_BY_NUM" in _plan(facts)
    assert facts.count() > 0


def test_year_earlier_is_the_nearest_and_reads_its_rows_once(spark):
    days = ["1999-01-01", "1999-01-04", "1999-01-08", "1999-01-12", "2000-01-06", "2000-01-30"]
    rows = spark.createDataFrame([("a", date.fromisoformat(x), float(i)) for i, x in enumerate(days)] + [(None, date(1999, 1, 6), 1.0), (None, date(2000, 1, 6), 2.0),
                                 ("a", None, 9.0)], "k string, period_end date, value double")
    out = year_earlier(rows, ["k"])
    got = {(r.k, str(r.period_end)): (str(r.period_end_year_earlier), r.value_year_earlier) for r in out.collect()}
    assert got["a", "2000-01-06"] == ("1999-01-04", 1.0)  # 367 and 363 days: the earlier
    assert got["a", "2000-01-30"] == ("None", None) and got[None, "2000-01-06"] == ("None", None) and got["a", "None"] == ("None", None)
    assert got["a", "1999-01-01"] == ("None", None)
    assert "Join" not in _plan(out)


def test_items_are_counted_where_they_are_ranked(spark):
    items = spark.createDataFrame([(1, "debt", f"k{i}", f"l{i}", float(i + 1)) for i in range(30)] + [(2, "debt", "k", "l", 1.0)],
                                  "company_id long, section string, line_key string, label string, value double").withColumns({
        "currency": F.lit("USD"), "normalized_unit": F.lit("currency"), "series": F.array(F.struct(F.lit("x").alias("at"), F.col("value").alias("value")))})
    out = views.capital_sections(items)
    assert {(r.company_id, r.n, r.more) for r in out.groupBy("company_id").agg(F.count("*").alias("n"), F.max("more").alias("more")).collect()} == {(1, 25, 5), (2, 1, 0)}
    assert "Join" not in _plan(out)


def test_new_lines_are_counted_where_they_stand(spark):
    rows = [(1, "debt", "new", "c", "USD")] * 3 + [(1, "debt", "changed", "c", "USD"), (1, "lease", "new", "d", "USD")] + [(2, "debt", "new", "c", "USD")] * 3 + [
        (3, "debt", "new", "c", None)] * 3
    changes = spark.createDataFrame(rows, "company_id long, category string, change_type string, xbrl_concept string, currency string")
    facts = spark.createDataFrame([(1, "e", 10), (2, "c", 10), (2, "c", 11)], "company_id long, xbrl_concept string, filing_id long")
    report = "struct<filing_id:long,is_annual:boolean,period_end:date>"
    bases = spark.createDataFrame([(c, (11, True, None), None, None) for c in (1, 2, 3)],
                                  f"company_id long, latest {report}, previous {report}, annual {report}")
    out = nc.first_itemized(changes, facts, bases)
    got = sorted((r.company_id, r.category, r.change_type, r.first_itemized, r.itemized) for r in out.where("first_itemized IS NOT NULL").collect())
    assert got == [(1, "debt", "new", "debt:c", 3)] * 3 and out.count() == len(rows)


def test_a_profile_alone_does_not_make_the_wide_rows(spark, tmp_path):
    _orders(spark, tmp_path)
    inputs = snapshot.Inputs(twins.filings(spark, str(tmp_path)), twins.facts(spark, str(tmp_path)))
    assert snapshot.part_rows(inputs, "filings").count() == 4
    assert "rows" not in vars(inputs)


def test_lines_do_not_move_to_their_kind_or_metric(spark, tmp_path):
    _orders(spark, tmp_path, (0, 9, 17))
    profiled = fa.with_filing_profile(*twins.reported_facts(spark, str(tmp_path)))
    lines = fa.family_facts(profiled, fa.metric_facts(profiled, spark))
    assert "hashpartitioning(concept" not in _plan(lines) and "_s#" not in "".join(x for x in _plan(lines).splitlines() if "Exchange" in x)
    assert {r.fact_key for r in lines.collect()} == {"guarantee.guarantee_obligations_maximum_exposure.line_17"}


def test_the_sentences_of_a_pair_are_compared_where_they_stand(spark):
    """Rows that stand by pair in any number of tasks do not move again, are not joined and not stored."""
    def line(n, end):
        return f"The {n} carrier signed a charter for {n} vessels with partners in {n} harbours {end}."

    names = ["alpha", "bravo", "carol", "delta"]
    texts = [(p, s, " ".join(line(n, e) for n in names[p:])) for p in (0, 1) for s, e in (("new", "again"), ("base", "before"))] + [(2, "new", line("echo", "once"))]
    df = spark.createDataFrame(texts, "pair_id long, side string, text string").repartition(13, "pair_id")
    out = wording.compare_sentences(wording.sentence_rows(df, ["pair_id", "side"]))
    assert _plan(out).count("Exchange") == 1 and "Join" not in _plan(out) and "ExistingRDD[pair_id#" in _plan(out)
    got = {(r.pair_id, r.side, r.pos): (r.status, r.old_text) for r in out.collect()}
    assert {k: v for k, v in got.items() if k[1] == "new"} == {
        **{(p, "new", i): ("reworded", line(n, "before")) for p in (0, 1) for i, n in enumerate(names[p:])}, (2, "new", 0): ("new", None)}
    assert {v for k, v in got.items() if k[1] == "base"} == {("used", None)} and len(got) == 4 + 4 + 3 + 3 + 1


def test_a_text_is_split_once_and_goes_to_its_pairs_in_bounded_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(twins, "TASK_TEXTS", 1)
    said = "The carrier signed a charter for nine vessels with partners in the northern harbours again."
    rows = [(i, f"{said}\nIt also sold the {'old ' * i}warehouses beside the river to a partner of the group.", "en", "src0", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    inputs = twins.diff_inputs(spark, str(tmp_path))
    assert "hashpartitioning(pair_id#" in _plan(inputs) and ", 20), REPARTITION_BY_NUM" in _plan(inputs)
    below = _plan(inputs).split("REPARTITION_BY_NUM", 1)
    assert "regexp_replace" in below[1] and "Table of Contents" not in below[0]
    got = {(r.pair_id, r.pos): r.status for r in wording.compare_sentences(inputs).where("side = 'new'").collect()}
    assert [got[i, 0] for i in (0, 1, 19)] == ["new", "repeated", "repeated"] and got[7, 1] == "reworded"


def test_texts_meet_their_base_in_one_move(spark):
    day = date.fromisoformat
    filings = spark.createDataFrame([(1, 10, "10-K", day("2023-12-31"), True), (1, 11, "10-Q", day("2024-03-31"), False), (1, 12, "10-Q", day("2024-06-30"), False),
                                     (2, 20, "10-K", day("2024-12-31"), True)], "company_id long, filing_id long, form_type string, period_end date, is_annual boolean")
    report = "struct<filing_id:long,is_annual:boolean,period_end:date>"
    bases = spark.createDataFrame([(1, (12, False, day("2024-06-30")), (10, True, day("2023-12-31"))), (2, (20, True, day("2024-12-31")), None)],
                                  f"company_id long, latest {report}, annual {report}")
    rows = [(f, c, n, f"{c} of {f} {n}") for f in (10, 11, 12, 20) for c in ("risk_factors", "guarantees", "subsequent_events") for n in (1, 2)] + [
        (12, "commitments", 1, "new here"), (None, "guarantees", 1, "of nobody"), (12, "guarantees", 3, "guarantees of 12 1")]
    sections = spark.createDataFrame(rows, "filing_id long, category string, ordinal int, text string").where("ordinal < 9")
    pairs = wording.section_pairs(wording.merged_sections(sections), filings, bases)
    assert _plan(pairs).count("SortMergeJoin") == 2  # bases with reports, and their texts
    got = {r.pair_id: (r.text, r.base_text, r.same_kind) for r in pairs.collect()}
    assert got == {
        "1|risk_factors|12|10": ("risk_factors of 12 1\n\nrisk_factors of 12 2", "risk_factors of 10 1\n\nrisk_factors of 10 2", False),
        "1|guarantees|12|11": ("guarantees of 12 1\n\nguarantees of 12 2", "guarantees of 11 1\n\nguarantees of 11 2", True),
        "1|subsequent_events|12|11": ("subsequent_events of 12 1\n\nsubsequent_events of 12 2", "subsequent_events of 11 1\n\nsubsequent_events of 11 2", True),
        "2|subsequent_events|20|": ("subsequent_events of 20 1\n\nsubsequent_events of 20 2", None, False)}
