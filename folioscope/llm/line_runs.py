"""Line dedup by levelled sorted runs of line hashes.

The documents come in batches, those with the largest ids first.  A batch's
lines are counted by hash, with Spark combining before it shuffles.  A run is a
table sorted by hash, in buckets of it, so that it is merged with a batch
without being shuffled again.  Each new batch is merged against all runs: hashes
that none of them has (the anti-join) are new, and the batch's largest id owns
them; the others add to the counts only.  The batch's hashes become a run of the
lowest level.  When a level has ``FANOUT`` runs they are compacted into one of
the next, counts added.  So a hash is rewritten as often as there are levels,
and a batch is merged against few runs.  After the last batch one more
compaction gives the hashes that occur in enough documents, and each document
loses the lines of those that it doesn't own.

No line is gathered: a line's row is its hash, count and owner.  What is joined
by hash is stored first, so that Spark can split a hash that a third of all
documents have, and so is what is joined by document.  Lines are known by a hash
of 128 bits of their key.

A null text is one empty line.  All rows with one id are one document, so they
count once and own together; rows without an id are one document whose id is
less than all others.  Texts of any length are read whole; lines of any length
are hashed whole.  An empty table gives an empty table; columns that are not
named are not read.
"""

import uuid
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import by_batches, chunks_of, shared_folder, stored

#: Code points of a key, and documents that it is found in, at least.
LENGTH, DOCUMENTS = 40, 5
#: Batches that a table is dealt into, and runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 8, 4

BLANKS = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
KEY = ["a", "b"]


def key_of(line, length=LENGTH):
    """The hash of a line's key as two signed longs, or None if the key is short.  Only A-Z are lower-cased."""
    if len(line) < length:
        return None
    key = line.strip(BLANKS).lower()
    if len(key) < length or len(key) < 4 * length and len(key.translate(None, CONTINUATION)) < length:
        return None
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def keyed(docs, text, doc, length=LENGTH):
    """A row for each different key of each row: batch, doc, a, b."""
    rows = docs.select("batch", F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    fields = T.StructType([*rows.schema.fields[:2], T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        for batch in batches:
            for start, chunk in chunks_of(batch, 2):
                keys = [{k for k in (key_of(line, length) for line in data.split(b"\n")) if k} if data else () for data in chunk]
                rows = pa.array([i for i, found in enumerate(keys, start) for _ in found], pa.int64())
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows),
                         *(pa.array([k[side] for found in keys for k in found], pa.int64()) for side in (0, 1))], names=fields.names)

    return by_batches(rows, run, fields)


def stored_by(rows, column, name):
    """Rows written to the shared folder, in a folder for each value of a column, and read back."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy(column).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Run(NamedTuple):
    """A run as a bucketed table, and the folder of its files."""

    table: DataFrame
    path: str


class LineRuns:
    """Levelled sorted runs of line hashes: ``a``, ``b``, ``n`` (documents) and ``owner`` (null where an earlier batch has it).

    Batches come by falling id, and a document is in one batch.
    """

    def __init__(self, spark, fanout=FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self):
        return [run for level in self.levels for run in level]

    def written(self, rows):
        """Rows, which are partitioned by hash, as a run: in buckets of the hash, sorted.  The catalog forgets its name at once."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        run = Run(self.spark.table(name), path)
        self.spark.sql(f"DROP TABLE {name}")
        return run

    def merged(self, runs):
        """One row a hash of several runs, whose files are read as one table without buckets.

        A union of bucketed tables is taken for bucketed by this version of
        Spark, which then does not bring the rows of one hash together.
        """
        rows = self.spark.read.schema(runs[0].table.schema).parquet(*(run.path for run in runs))
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))

    def add(self, keys):
        """Adds a batch of (doc, a, b); returns its run, in which what no earlier batch has is owned."""
        # documents without an id count as one
        own = keys.groupBy(*KEY).agg(F.countDistinct(F.struct("doc")).alias("n"), F.max("doc").alias("owner"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            own = own.join(run.table.select(*KEY, F.lit(True).alias(f"in_{i}")), KEY, "left")
            known = known | F.col(f"in_{i}").isNotNull()
        run = self.written(own.select(*KEY, "n", F.when(~known, F.col("owner")).alias("owner")))
        self._put(run, 0)
        return run.table

    def _put(self, run, level):
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            compact = self.written(self.merged(self.levels[level]))
            self.levels[level] = []
            self._put(compact, level + 1)

    def total(self):
        """All hashes with their count and owner."""
        return self.merged(self.runs())


def dealt(docs, doc, batches=BATCHES):
    """Documents with the number of their batch, by falling id; those without an id come last.  Where the batches part is approximate."""
    shares = [1 - i / batches for i in range(1, batches)]
    limits = docs.agg(F.percentile_approx(doc, shares).alias("at")).first().at or [] if shares else []
    number = reduce(lambda x, limit: x + F.when(F.col(doc) > limit, 0).otherwise(1), limits, F.lit(0))
    return docs.select("*", number.alias("batch"))


def without_lines(data, gone, length=LENGTH):
    """Number of lines, of lines dropped, and the text without them."""
    lines = (data or b"").split(b"\n")
    kept = [line for line in lines if key_of(line, length) not in gone] if gone else lines
    return len(lines), len(lines) - len(kept), b"\n".join(kept) if gone else data or b""


def without_repeated_lines(docs, text="text", doc="doc_id", keep=("doc_id",), kept="kept", length=LENGTH, documents=DOCUMENTS,
                           batches=BATCHES, fanout=FANOUT):
    """For every row ``keep``, ``n_lines``, ``n_dropped`` and the text that is kept.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    A key of at least ``length`` code points in at least ``documents``
    documents stays in the one with the largest id only.  ``doc`` is a number.
    """
    spark, keep = docs.sparkSession, list(keep)
    source = docs.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keep)], F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    found = stored_by(keyed(dealt(source.select("doc", "text"), "doc", batches), "text", "doc", length), "batch", "line-keys")
    index = LineRuns(spark, fanout)
    for number in range(batches):
        index.add(found.where(F.col("batch") == number))
    often = stored(index.total().where(F.col("n") >= documents).select(*KEY, "owner"), "repeated-lines")
    # merge joins at every size: what a small table broadcasts a large one cannot
    gone = found.join(often.hint("merge"), KEY).where(~F.col("doc").eqNullSafe(F.col("owner"))).select("doc", F.struct(*KEY).alias("key"))
    gone = stored(gone.groupBy("doc").agg(F.collect_set("key").alias("gone")), "dropped-lines")
    rows = source.join(gone.hint("merge"), source["doc"].eqNullSafe(gone["doc"]), "left").drop("doc")
    k = len(keep)
    schema = T.StructType([*rows.schema[:k], *T.StructType.fromDDL(f"n_lines long, n_dropped long, {kept} string")])

    def run(batches):
        for batch in batches:
            for start, chunk in chunks_of(batch, k):
                part = batch.slice(start, len(chunk))
                done = [without_lines(data, {(x["a"], x["b"]) for x in keys or ()}, length)
                        for data, keys in zip(chunk, part.column(k + 1).to_pylist())]
                lines, dropped, left = zip(*done)
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:k], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                    pa.array(left, pa.binary()).cast(pa.string(), safe=False)], names=schema.names)

    return by_batches(rows, run, schema).toDF(*keep, *schema.names[k:])
