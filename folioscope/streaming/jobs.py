"""Time-driven work as Structured Streaming jobs; the same functions read batch tables."""

from collections import deque

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.latest import latest_filed
from ..sources.store import replace_in_table


def seconds_of(column):
    """A timestamp as seconds, whatever its time zone type."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


def new_filings(stream, delay="30 days"):
    """Arriving filings, each accession once within the watermark."""
    return stream.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["accession_number"])


def ingest(stream, table_path, checkpoint_path, version, trigger=None, buckets=512):
    """Reads arriving facts and replaces the touched filings in the table.

    Filings already stored at this version are skipped; a repeated micro-batch
    rewrites the same rows, so the table is the same after a restart.
    """
    def merge(batch, _epoch):
        spark = batch.sparkSession
        stored = spark.read.parquet(table_path).where(F.col("parser_version") == version).select("accession_number").distinct()
        fresh = batch.join(stored, "accession_number", "left_anti").withColumn("parser_version", F.lit(version))
        replace_in_table(spark, table_path, fresh, buckets=buckets)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_upsert(current, arrived, slot):
    """Latest filing wins per slot, however late the rows arrive."""
    return latest_filed(current.unionByName(arrived.select(*current.columns)), slot)


def _admitted(times, now, limit, seconds):
    """Whether a request is allowed, given the accepted times before it, oldest first; drops those that are out of the window."""
    while times and now - times[0] >= seconds:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(now)
    return True


def _limiter(limit, seconds, key, idle_minutes):
    """Keeps the accepted times of one visitor, at most ``limit`` of them; rejected requests do not count."""
    admitted = _admitted

    def admit(visitor, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        allowed = [admitted(times, at.timestamp(), limit, seconds) for at in rows["at"]]
        state.update((list(times),))
        state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({key: visitor[0], "request_id": rows["request_id"].values, "allowed": allowed})

    return admit


def rate_limit_stream(requests, limit=10, seconds=60, key="visitor", idle_minutes=1440):
    """Allowed or rejected, per request of a stream (R2).

    State per visitor is at most ``limit`` times, and is dropped once the visitor
    has been silent for ``idle_minutes``, which must be longer than the window.
    """
    return requests.groupBy(key).applyInPandasWithState(
        _limiter(limit, seconds, key, idle_minutes), f"{key} long, request_id long, allowed boolean", "times array<double>", "append",
        GroupStateTimeout.ProcessingTimeTimeout)


def rate_limit(requests, limit=10, seconds=60, key="visitor"):
    """The same decision over a stored table (R2).

    A visitor's requests are sorted by Spark and pass once, in batches; what is
    kept is the visitor at hand and at most ``limit`` accepted times.
    """
    admitted = _admitted

    def decide(batches):
        visitor, times = None, deque()
        for batch in batches:
            allowed = []
            for who, now in zip(batch[key], batch["_t"]):
                if who != visitor:
                    visitor, times = who, deque()
                allowed.append(admitted(times, now, limit, seconds))
            yield pd.DataFrame({key: batch[key], "request_id": batch["request_id"], "allowed": allowed})

    rows = requests.select(key, "request_id", seconds_of("at").alias("_t"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "_t", "request_id")
    return ordered.mapInPandas(decide, f"{key} long, request_id long, allowed boolean")


def abandoned_runs(starts, finishes, minutes=15):
    """Runs that did not finish within the time.

    A stored table keeps the runs without a match.  On streams, watermark both
    sides: there the outer join emits a run once the watermark passes its
    deadline.  ``starts``: run_id, started_at; ``finishes``: finished_run,
    finished_at.
    """
    until = F.col("started_at") + F.expr(f"INTERVAL {minutes} MINUTES")
    in_time = (F.col("run_id") == F.col("finished_run")) & (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= until)
    if starts.isStreaming:
        return starts.join(finishes, in_time, "left_outer").where(F.col("finished_at").isNull()).select(*starts.columns)
    return starts.join(finishes, in_time, "left_anti")


def backing_off(requests, failures, minutes=30, key="company_id"):
    """Requests with a quota failure of the same company in the minutes before.

    Failures are reduced to the first and last of each time slot; a request looks
    at its own slot and the one before, which is exact for a window as long as a
    slot and never multiplies rows.
    """
    width = minutes * 60
    slot = F.floor(seconds_of("failed_at") / width)
    ends = failures.groupBy(key, slot.alias("_slot")).agg(F.min("failed_at").alias("first"), F.max("failed_at").alias("last"))
    rows = requests.withColumn("_slot", F.floor(seconds_of("at") / width))
    own = ends.select(key, "_slot", F.col("first").alias("_first"))
    before = ends.select(key, (F.col("_slot") + 1).alias("_slot"), F.col("last").alias("_last"))
    out = rows.join(own, [key, "_slot"], "left").join(before, [key, "_slot"], "left")
    recent = F.coalesce(F.col("_first") < F.col("at"), F.lit(False)) | F.coalesce(
        seconds_of("_last") > seconds_of("at") - width, F.lit(False))
    return out.withColumn("backing_off", recent).drop("_slot", "_first", "_last")
