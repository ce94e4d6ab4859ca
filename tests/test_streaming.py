from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioscope.sources import store
from folioscope.streaming import jobs

START = datetime(2026, 1, 1)


def test_rate_limit_matches_the_stream(spark, tmp_path):
    rows = [(v, i, START + timedelta(seconds=4 * i * (1 + v))) for v in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "visitor long, request_id long, at timestamp")
    batch = {(r.visitor, r.request_id): r.allowed for r in jobs.rate_limit(df).collect()}
    times = {}
    for v, i, at in sorted(rows, key=lambda r: (r[0], r[2])):
        recent = [t for t in times.get(v, []) if (at - t).total_seconds() < 60]
        assert batch[(v, i)] == (len(recent) < 10)
        times[v] = recent + [at] if len(recent) < 10 else recent
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    query = jobs.rate_limit_stream(stream).writeStream.format("memory").queryName("limited").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.visitor, r.request_id): r.allowed for r in spark.table("limited").collect()} == batch


def test_ingest_replaces_filings_once(spark, tmp_path):
    table, arriving = str(tmp_path / "facts"), str(tmp_path / "in")
    schema = "company_id long, filing_id long, accession_number string, value double, parser_version int"
    store.write_table(spark.createDataFrame([(1, 1, "a", 1.0, 8), (1, 2, "b", 2.0, 7), (2, 3, "c", 3.0, 8)], schema), table, 4)
    spark.createDataFrame([(1, 1, "a", 100.0, 8), (1, 2, "b", 20.0, 8), (1, 2, "b", 21.0, 8), (2, 4, "d", 4.0, 8)], schema).write.parquet(arriving)
    stream = spark.readStream.schema(schema).parquet(arriving)
    jobs.ingest(stream, table, str(tmp_path / "cp"), 8, buckets=4).awaitTermination(120)
    got = sorted((r.accession_number, r.value) for r in spark.read.parquet(table).collect())
    assert got == [("a", 1.0), ("b", 20.0), ("b", 21.0), ("c", 3.0), ("d", 4.0)]


def test_abandoned_runs(spark):
    starts = spark.createDataFrame([(1, START), (2, START)], "run_id long, started_at timestamp")
    ends = spark.createDataFrame([(1, START + timedelta(minutes=5)), (2, START + timedelta(minutes=50))], "finished_run long, finished_at timestamp")
    assert [r.run_id for r in jobs.abandoned_runs(starts, ends).collect()] == [2]


def test_back_off(spark):
    at = spark.createDataFrame([(1, START + timedelta(minutes=m)) for m in (10, 35, 41, 80)], "company_id long, at timestamp")
    failed = spark.createDataFrame([(1, START + timedelta(minutes=11))], "company_id long, failed_at timestamp")
    got = jobs.backing_off(at, failed).orderBy("at").select(F.col("backing_off")).collect()
    assert [r[0] for r in got] == [False, True, False, False]
