"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's logit is a bias plus the weights of its different words; a word's
weight is that of the word itself plus those of its runs of four letters, so
that unseen forms of a stem count as well.  Weights are not negative, since no
polite word makes an insult harmless, and a cost of size keeps them few.  A document's score is the noisy-or
of its sentences, 1 - prod(1 - p), and the weights are trained from document
labels through it, without labels of sentences.  The sentences then tell where
the offence is.

The fit takes at most ``SAMPLE`` labelled documents of each label, those with
the least hash of their id, one text an id, and of these as many as fit into
``SAMPLE_COST`` bytes, weighted back to the numbers in the table.  Scores
cover every sentence of every document.

Null and empty texts have no sentence and the score 0.  Labels that are null
are left out; where an id has several labels the greatest holds.  Without
documents of both labels every score is 0.  Repeated rows get equal scores; an
empty table gives an empty table; columns that are not named are not read.
"""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import by_batches, chunks_of, training_sample

#: Labelled documents of each label that the fit takes at most.
SAMPLE = 2_000
#: Feature hashes; a power of two.
SLOTS = 1 << 18
LETTERS = 4
STEPS = 80
#: Further steps without the cost of size, for the weights that have left zero.
REFITS = 40
RATE = 0.15
#: Documents that a feature must explain for its weight to leave zero.
EVIDENCE = 1.5
#: Word weights that a task remembers.
REMEMBERED = 150_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def slots(word):
    """Features of a word: itself, and each run of four letters with its ends marked."""
    marked = f"<{word}>"
    parts = {f"={word}", *(marked[i:i + LETTERS] for i in range(max(1, len(marked) - LETTERS + 1)))}
    return [zlib.crc32(p.encode("utf-8", "replace")) & (SLOTS - 1) for p in parts]


def sentences(text):
    """(start, stop, different words) of each sentence that has a word."""
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m[0].lower()))
        if words:
            yield m.start(), m.end(), words


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts, labels, weights, steps=STEPS, refits=REFITS, rate=RATE, evidence=EVIDENCE):
    """(feature weights, bias) from whole texts with their labels and the rows each stands for; None without both labels."""
    labels, weights = np.asarray(labels, float), np.asarray(weights, float)
    if not len(labels) or labels.min() == labels.max():
        return None
    blocks = list(featured(texts))
    if not blocks:
        return None
    of_text = np.concatenate([b[2] for b in blocks])
    cuts = np.cumsum([0] + [len(b[1]) for b in blocks])
    weights = weights / weights.sum()
    w, bias = np.zeros(SLOTS, np.float32), math.log(0.01)
    moment, square = np.zeros(SLOTS + 1, np.float32), np.zeros(SLOTS + 1, np.float32)
    y, allowed = labels[of_text], np.ones(SLOTS, bool)
    for step in range(1, steps + refits + 1):
        if step == steps + 1:
            allowed = w > 0
        p = sigmoid(bias + np.concatenate([np.add.reduceat(w[flat], starts) for flat, starts, _ in blocks]))
        none = np.bincount(of_text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(labels))
        clean = np.exp(none)  # the chance that no sentence is toxic
        lift = clean / np.maximum(1 - clean, 1e-9)
        slope = np.where(y == 1, -p * lift[of_text], p) * weights[of_text]
        gradient = np.zeros(SLOTS + 1)
        for (flat, starts, _), i, j in zip(blocks, cuts, cuts[1:]):
            each = np.repeat(slope[i:j], np.diff(np.r_[starts, len(flat)]))
            gradient[:-1] += np.bincount(flat, each, minlength=SLOTS)
        gradient[:-1] += evidence / len(labels) if step <= steps else 0
        gradient[-1] = slope.sum()
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, bias = np.where(allowed, np.maximum(w - move[:-1], 0), 0).astype(np.float32), bias - move[-1]
    return w, float(bias)


def featured(texts, size=1 << 21):
    """Blocks of sentences: (features, first feature of each sentence, text of each sentence)."""
    known, flat, starts, of_text, n = {}, [], [], [], 0
    for number, text in enumerate(texts):
        for _, _, words in sentences(text or ""):
            if n >= size:
                yield np.concatenate(flat), np.array(starts), np.array(of_text)
                flat, starts, of_text, n = [], [], [], 0
            starts.append(n)
            of_text.append(number)
            for w in words:
                if w not in known:
                    known[w] = np.array(slots(w), np.int32)
                flat.append(known[w])
                n += len(known[w])
    if flat:
        yield np.concatenate(flat), np.array(starts), np.array(of_text)


class Scorer:
    """Scores texts in one task with a fitted model."""

    def __init__(self, model):
        self.model = model
        self.known = {}
        # the weights that aren't zero are few
        self.own = {int(i): float(model[0][i]) for i in np.flatnonzero(model[0])} if model else {}

    def weight(self, word):
        own = self.own
        value = self.known[word] = sum([own[s] for s in slots(word) if s in own])
        return value

    def score(self, text, limit):
        """The document's score, and (start, stop, score) of sentences with ``limit`` or more."""
        if not text or self.model is None:
            return 0.0, []
        known, weight, bias = self.known, self.weight, self.model[1]
        if len(known) > REMEMBERED:
            known.clear()
        clean, found = 0.0, []
        for start, stop, words in sentences(text):
            z = bias + math.fsum([known[w] if w in known else weight(w) for w in words])
            z = min(max(z, -30.0), 30.0)
            clean -= math.log1p(math.exp(z))
            p = 1 / (1 + math.exp(-z))
            if p >= limit:
                found.append({"start": start, "stop": stop, "score": p})
        return -math.expm1(clean), found


def bucket(doc, folds=5):
    """crc32 of the id as text, modulo ``folds``; a null id is in none."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % folds


def trained(docs, labels, text="text", doc="doc_id", label="toxic", sample=SAMPLE):
    """A model from labelled rows whose id falls in no held-out bucket."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(doc).agg(F.max(label).alias("label")).where(bucket(doc) != 0)
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    rows = training_sample(docs, known, text, doc, sample)
    counts = {v: sum(x == v for _, x in rows) for v in (0, 1)}
    return fit([t for t, _ in rows], [x for _, x in rows], [totals[x] / counts[x] for _, x in rows])


def scored(docs, model, text="text", keep=("doc_id",), limit=0.5):
    """For every row ``keep``, ``score``, and ``offending``: sentences (start, stop, score) with ``limit`` or more."""
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    spans = T.ArrayType(T.StructType.fromDDL("start int, stop int, score double"))
    schema = T.StructType([*(rows.schema[k] for k in keep), T.StructField("score", T.DoubleType()), T.StructField("offending", spans)])
    n = len(keep)

    def run(batches):
        scorer = Scorer(sent.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for start, chunk in chunks_of(batch, n):
                found = [scorer.score(data.decode() if data else None, limit) for data in chunk]
                yield pa.RecordBatch.from_arrays([
                    *batch.slice(start, len(chunk)).columns[:n], pa.array([s for s, _ in found], pa.float64()),
                    pa.array([x for _, x in found], kind)], names=schema.names)

    return by_batches(rows, run, schema)
