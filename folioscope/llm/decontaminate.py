"""Benchmark decontamination: an exact search for item windows by a prefix-filtered set join.

A window is 13 consecutive words of an item (all words of a shorter one), seen
as the set of its word shingles.  Containing a window means containing all its
shingles, so a prefix of one shingle is necessary: the rarest one, counted over
all documents.  Documents are joined on prefix shingles only; a candidate must
fit the document at its place (positional and length bounds), and its words
are then compared one by one.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, each
broadcast and joined with all documents, so its size is not limited.

Nulls and texts without words have no words and no windows.  An item without
an id counts as hit but is in no list; rows of one id are one item.  Repeated
documents are each judged by themselves; empty tables give no rows or no hits;
columns that are not named are not read.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import by_batches, chunks_of

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 16 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
ITEMS = T.ArrayType(T.StringType())

#: Bytes of words stay, A-Z in lower case; all other ASCII parts words.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(data):
    """Words of a text given as UTF-8: runs of letters, digits and anything beyond ASCII, A-Z in lower case."""
    return data.translate(WORD_BYTES).split() if data else []


class Block:
    """Part of the benchmark: its vocabulary, its windows, and their shingles."""

    def __init__(self, items, window=WINDOW, shingle=SHINGLE):
        self.vocabulary = {}
        owners = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())]
            for i in range(max(len(ids) - window + 1, min(len(ids), 1))):
                owners[tuple(ids[i:i + window])] |= {str(item)} if item is not None else set()
        self.margin = window
        self.base = len(self.vocabulary) + 1
        if self.base ** shingle >= 1 << 63:
            raise ValueError("the block has too many different words; make blocks smaller")
        self.shingle = shingle
        windows = list(owners)
        self.items = [sorted(owners[w]) for w in windows]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int32)
        for row, w in zip(self.words, windows):
            row[:len(w)] = w
        # shingles of each window; a window of fewer words than a shingle is its own, shorter one
        self.parts = []
        for w in windows:
            size = min(shingle, len(w))
            self.parts.append([self.code(w[i:i + size]) for i in range(len(w) - size + 1)])
        self.codes = np.array(sorted({c for p in self.parts for c in p}), np.int64)
        self.sizes = sorted({min(shingle, len(w)) for w in windows})

    def code(self, ids):
        value = 0
        for i in range(self.shingle):
            value = value * self.base + (int(ids[i]) if i < len(ids) else 0)
        return value

    def choose(self, counts):
        """Joins each window by its rarest shingle; windows with a shingle that no document has are dropped."""
        at = {c: i for i, c in enumerate(self.codes.tolist())}
        chosen = defaultdict(list)
        for w, part in enumerate(self.parts):
            rarity, code, offset = min((int(counts[at[c]]), c, o) for o, c in enumerate(part))
            if rarity:
                chosen[code].append((w, offset))
        self.prefixes = np.array(sorted(chosen), np.int64)
        rows = [chosen[c] for c in self.prefixes.tolist()]
        self.starts = np.cumsum([0, *map(len, rows)])
        self.window = np.array([w for row in rows for w, _ in row], np.int64)
        self.offset = np.array([o for row in rows for _, o in row], np.int64)
        self.parts = self.codes = None
        return self

    def numbered(self, texts):
        """Word numbers of all texts in one array, 0 for words of no item, with a margin around each; starts and counts."""
        get = self.vocabulary.get
        flat, starts, counts = [0] * self.margin, [], []
        for data in texts:
            words = words_of(data)
            starts.append(len(flat))
            counts.append(len(words))
            flat += [get(w, 0) for w in words]
            flat += [0] * self.margin
        return np.array(flat, np.int32), np.array(starts, np.int64), np.array(counts, np.int64)

    def shingled(self, flat):
        """Places and codes of all shingles made of known words only."""
        for size in self.sizes:
            known = flat[:len(flat) - size + 1] > 0
            for i in range(1, size):
                known &= flat[i:len(flat) - size + 1 + i] > 0
            places = np.flatnonzero(known)
            codes = np.zeros(len(places), np.int64)
            for i in range(self.shingle):
                codes = codes * self.base + (flat[places + i] if i < size else 0)
            yield places, codes

    @staticmethod
    def found(sorted_codes, codes):
        at = np.searchsorted(sorted_codes, codes)
        at[at == len(sorted_codes)] = 0
        return at, sorted_codes[at] == codes if len(sorted_codes) else np.zeros(len(codes), bool)

    def count(self, texts, counts):
        flat, _, _ = self.numbered(texts)
        for _, codes in self.shingled(flat):
            at, there = self.found(self.codes, codes)
            counts += np.bincount(at[there], minlength=len(counts))

    def search(self, texts):
        """For each text: number of words, spans covered by windows, items whose windows occur."""
        flat, starts, counts = self.numbered(texts)
        pairs = []
        for places, codes in self.shingled(flat):
            at, there = self.found(self.prefixes, codes)
            at, places = at[there], places[there]
            many = self.starts[at + 1] - self.starts[at]
            row = np.repeat(self.starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            window, first = self.window[row], np.repeat(places, many) - self.offset[row]
            # positional and length bounds: the window lies within the text that holds the shingle
            text = np.searchsorted(starts, np.repeat(places, many), side="right") - 1
            fits = (first >= starts[text]) & (first + self.lengths[window] <= starts[text] + counts[text])
            window, first, text = window[fits], first[fits], text[fits]
            for j in range(self.words.shape[1]):
                same = (j >= self.lengths[window]) | (flat[np.minimum(first + j, len(flat) - 1)] == self.words[window, j])
                window, first, text = window[same], first[same], text[same]
            pairs += zip(text.tolist(), (first - starts[text]).tolist(), window.tolist())
        spans, items = defaultdict(list), defaultdict(set)
        for text, first, window in pairs:
            spans[text].append((first, first + int(self.lengths[window])))
            items[text].update(self.items[window])
        return counts.tolist(), spans, items


def merged(spans):
    """Spans joined where they touch or overlap."""
    out = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def counted(texts, sent):
    """How often each shingle of a block occurs in all texts; a row for each shingle and task before the sum."""
    def run(batches):
        block = sent.value
        counts = np.zeros(len(block.codes), np.int64)
        for batch in batches:
            for _, chunk in chunks_of(batch, 0):
                block.count(chunk, counts)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(counts[there], pa.int64())], names=["shingle", "n"])

    rows = by_batches(texts, run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(sent.value.codes), np.int64)
    for row in rows.collect():  # bounded by the block
        counts[row.shingle] = row.n
    return counts


def searched(docs, sent, keep):
    """One block against all documents; what earlier blocks found is carried along."""
    n = len(keep)
    schema = docs.schema

    def run(batches):
        block = sent.value
        for batch in batches:
            before = [batch.column(n + i).to_pylist() for i in (2, 3)]
            for start, chunk in chunks_of(batch, n):
                counts, spans, items = block.search(chunk)
                rows = range(start, start + len(chunk))
                old_spans = [[(s["start"], s["stop"]) for s in before[0][r]] for r in rows]
                now = [merged(old_spans[i] + spans[i]) if i in spans else old_spans[i] for i in range(len(chunk))]
                names = [sorted({*before[1][r], *items[i]}) if i in items else before[1][r] for i, r in enumerate(rows)]
                part = batch.slice(start, len(chunk))
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:n + 1], pa.array(counts, pa.int64()),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for s in now],
                             pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array(names, pa.list_(pa.string()))], names=batch.schema.names)

    return by_batches(docs, run, schema)


def contaminated(docs, benchmark, text="text", keep=("doc_id",), item="item_id", item_text="text", block_bytes=BLOCK_BYTES):
    """For each document: ``keep``, ``n_words``, ``spans`` of words hit by item windows, and ``items`` that hit."""
    spark = docs.sparkSession
    keep = list(keep)
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(
        *keep, F.col(text).cast("string").alias("__text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("spans"), F.array().cast(ITEMS).alias("items"))
    for number in range(blocks):
        # a block is bounded by block_bytes; each goes against all documents
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()
        block = Block([(r.item, r.text) for r in part])
        first = spark.sparkContext.broadcast(block)
        counts = counted(docs.select(F.col(text).cast("string").alias("__text")), first)
        block.choose(counts)
        rows = searched(rows, spark.sparkContext.broadcast(block), keep)
    return rows.drop("__text")


def hits(found):
    """``n_hit`` words, and whether they are a twentieth of the words or more, added to ``contaminated``'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
