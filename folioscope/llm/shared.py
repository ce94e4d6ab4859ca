"""What several operators need: intermediate tables, and rows of Arrow batches."""

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark):
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests) gets a temporary folder, once.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df, name):
    """Writes an intermediate table to the shared folder and reads it back.

    This cuts the lineage: whatever executor is lost, later steps read the
    table again and need not make it anew.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What the texts of each label in a training sample cost at most: a byte of UTF-8 counts one, a line ``LINE_COST`` more,
#: since what is computed of a line takes memory however short it is.
SAMPLE_COST = 32 << 20
LINE_COST = 100


def within(sizes, most):
    """Numbers of the sizes taken in order while their sum is at most ``most``, passing over what does not fit; the least one if none fits."""
    taken, total = [], 0
    for i, size in enumerate(sizes):
        if total + size <= most:
            taken.append(i)
            total += size
    return taken or [min(range(len(sizes)), key=sizes.__getitem__)] if sizes else []


def training_sample(docs, known, text, doc, sample, most=SAMPLE_COST):
    """(text, label) of the documents that a fit takes, in a fixed order, for the driver.

    ``known``: one row an id, with ``label`` 0 or 1.  At most ``sample`` ids of
    each label, those with the least hash; of an id with several rows one text,
    not null if there is one, with the least hash.  So each task hands on one
    row an id, however often an id is repeated.  Of these the ones that fit
    into ``most``; their sizes alone are looked at before any text is taken.
    """
    parts = [known.where(F.col("label") == value).orderBy(F.xxhash64(doc), doc).limit(sample) for value in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(doc, F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), doc)
    rows = rows.groupBy(doc).agg(F.min("label").alias("label"), F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("text"))
    rows = stored(rows.select(F.xxhash64(doc).alias("place"), F.col(doc).cast("string").alias("id"), "label", "text"), "sample")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    cost = F.coalesce(F.octet_length("text") + LINE_COST * lines, F.lit(0)).cast("long")
    order = lambda r: (r.place, r.id)
    sizes = sorted(rows.select("place", "id", "label", cost.alias("cost")).collect(), key=order)
    wanted = set()
    for value in (0, 1):
        of = [r for r in sizes if r.label == value]
        wanted.update(of[i].id for i in within([r.cost for r in of], most))
    if len(wanted) < len(sizes):
        rows = rows.where(F.col("id").isin(sorted(wanted)))
    return [(r.text, r.label) for r in sorted(rows.collect(), key=order)]


#: Rows of an Arrow batch.  Spark's 10,000 long texts would be held several times over, in the JVM and in Python.
ARROW_ROWS = 1_000
ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back():
    """Hands free memory back to the system: a Python worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def by_batches(df, run, schema):
    """``df.mapInArrow(run, schema)`` in small batches, unless the cluster's own settings name a size; memory goes back after each task."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(ARROW_CONF):
        spark.conf.set(ARROW_CONF, str(ARROW_ROWS))

    def lean(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def batches_of(rows, schema, size=4096):
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows, schema):
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def chunks_of(batch, column, size=1 << 20):
    """Slices of a batch with about ``size`` bytes of text: (first row, texts as bytes or None)."""
    texts = batch.column(column).cast(pa.binary())
    start, held, total = 0, [], 0
    for i, value in enumerate(texts):
        data = value.as_py()
        if held and total + len(data or b"") > size:
            yield start, held
            start, held, total = i, [], 0
        held.append(data)
        total += len(data or b"")
    if held:
        yield start, held
