import json

from pyspark.sql import functions as F

from folioscope.plans import snapshot, twins

FOLDER = "/root/testdata/sf0.001"
NAMES = ("company", "annual", "capital")


def rows_of(parts):
    return {(r.company_id, r.part): r.payload for r in parts.collect()}


def test_a_stream_in_any_order_comes_to_the_batch(spark, tmp_path):
    reports = snapshot.reports_of(twins.filings(spark, FOLDER), twins.facts(spark, FOLDER), F.lit(10))
    reports.write.parquet(f"{tmp_path}/all")
    reports = spark.read.parquet(f"{tmp_path}/all").where("company_id <= 4")
    want = rows_of(snapshot.parts_table(snapshot.read_inputs(reports), NAMES))

    # the older reports of two companies, of which one is wrong, are there; the rest comes newest first, with an outdated version of one
    folder, arriving = f"{tmp_path}/store", f"{tmp_path}/in"
    first = reports.where("company_id IN (1, 2) AND fiscal_year < 1996")
    wrong = F.col("filing_id") == first.agg(F.max("filing_id")).first()[0]
    early = first.withColumn("facts", F.when(wrong, F.slice("facts", 1, 1)).otherwise(F.col("facts"))).withColumn("arrived_at", F.lit(5))
    snapshot.created(spark, folder, early, 4, NAMES)
    later = reports.where("NOT (company_id IN (1, 2) AND fiscal_year < 1996)").unionByName(first.where(wrong))
    newest = later.where("company_id = 3 OR fiscal_year >= 1997")
    batches = [newest, later.join(newest.select("filing_id"), "filing_id", "left_anti").unionByName(
        later.where("company_id = 3").limit(1).withColumn("arrived_at", F.lit(9)).withColumn("facts", F.slice("facts", 1, 1)))]
    for batch in batches:
        batch.select(reports.columns).coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    snapshot.maintained(stream, folder, f"{tmp_path}/cp", 4, NAMES).awaitTermination(600)
    stored = spark.read.parquet(f"{folder}/snapshots")
    assert rows_of(stored) == want and stored.count() == len(want)

    # the last batch again changes nothing, and other companies' files are not touched
    before = {f for f in spark.read.parquet(f"{folder}/snapshots").inputFiles()}
    snapshot.take(batches[1].where("company_id = 1"), folder, 4, NAMES)
    assert rows_of(spark.read.parquet(f"{folder}/snapshots")) == want
    own = spark.range(1, 2).select(snapshot.bucket("id", 4)).first()[0]
    after = {f for f in spark.read.parquet(f"{folder}/snapshots").inputFiles()}
    assert {f for f in before ^ after if f"bucket={own}" not in f} == set()


def test_documents_hold_all_current_parts(spark):
    parts = spark.createDataFrame([(1, "b", 1, "[2]"), (1, "a", 1, '[{"x":1}]'), (1, "c", 0, "[3]"), (2, "a", 0, "[4]")],
                                  "company_id long, part string, snapshot_version int, payload string")
    got = {r.company_id: json.loads(r.document) for r in snapshot.documents(parts).collect()}
    assert got == {1: {"a": [{"x": 1}], "b": [2]}}


def test_half_yearly_companies_read_their_second_quarter_as_a_half(spark):
    filings = twins.filings(spark, FOLDER).where("company_id = 1 AND fiscal_period IN ('Q2', 'FY')").withColumn(
        "form_type", F.when(F.col("is_annual"), "20-F").otherwise("6-K")).withColumn("period_months", F.when(F.col("is_annual"), 12).otherwise(6))
    facts = twins.facts(spark, FOLDER).where("company_id = 1").join(filings.select("filing_id", "is_annual").withColumnRenamed("is_annual", "_a"), "filing_id")
    six = (F.col("period_type") == "duration") & ~F.col("_a")
    facts = facts.withColumns({"fiscal_period": F.when(F.col("_a"), "FY").when(six, "H1").otherwise("Q2"),
                               "period_months": F.when(F.col("period_type") == "instant", None).when(F.col("_a"), 12).otherwise(6)}).drop("_a")
    inputs = snapshot.Inputs(filings, facts)
    assert inputs.profile.first().interim_kind == "half_yearly"
    assert {r.fiscal_period for r in inputs.filings.collect()} == {"FY", "H1"} and {r.fiscal_period for r in inputs.facts.select("fiscal_period").collect()} == {"FY", "H1"}
    assert snapshot.part_rows(inputs, "company").first().interim_note == "half_year_reports"
