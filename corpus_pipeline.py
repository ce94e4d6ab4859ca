"""The corpus pipeline: five stages over ``documents``, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept.  All but the last return the columns of ``documents``.  Columns of the
input never clash with those of an operator, because a row travels as one
struct.  Nulls, empty texts and empty tables are treated as each operator says:
a document without text is clean and stays, as one of its group of copies.
"""

import public_tokenizers
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, simhash, substrings, toxicity
from folioscope.llm.shared import stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _rows(docs):
    """Each row as a struct beside its text."""
    return docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))


def without_toxic(spark, docs, sf_dir):
    """Rejects documents with a toxicity of one half or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.trained(docs.select("doc_id", "text"), labels)
    return toxicity.scored(_rows(docs), model, keep=["row"]).where("score < 0.5").select("row.*")


def without_near_copies(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def without_repeated_passages(spark, docs, sf_dir):
    """Cuts passages of 35 words or more that also start elsewhere; every document stays, with what is left of it."""
    left = substrings.without_repeats(_rows(docs), keep=["row"], layout=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("row.n_chars"))}
    return left.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def without_benchmark(spark, docs, sf_dir):
    """Drops documents of whose words a twentieth or more lie in windows of benchmark items."""
    found = decontaminate.contaminated(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return decontaminate.hits(found).where(~F.col("contaminated")).select("row.*")


def as_tokens(spark, docs, sf_dir):
    """Token ids of every document, with the text that they decode to."""
    done = bpe.encode_and_decode(docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text"),
                                 public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=["row"])
    return done.select("row.*", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", as_tokens),
]

#: No stage but decontamination and substring dedup can be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, from ``documents`` to tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {}
