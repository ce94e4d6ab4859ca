"""Substring dedup by suffix trees, one for each prefix, over sampled suffixes.

Every window of 35 words is anchored at the least hash among its 24 runs of 12
words.  Equal windows have equal anchors, so the suffixes of anchors are all
that is needed; they are about a twelfth of all.  They are split by prefix,
first the 12 words of the anchor, of which only prefixes that occur twice go
on.  The words of all windows with one anchor are its context; equal contexts
are counted before they are shuffled and then stand for one.  A prefix with at
most ``GROUP`` different contexts fits in memory: one task sorts the suffixes of
its windows, which is their suffix tree; inner nodes 35 or more words deep are
repeats, taken as far as they reach.  A prefix with more is lengthened to the
full 35 words of each window; what is that deep needs no tree, its occurrences
are counted, which Spark combines before it shuffles.  So neither a copy nor a
passage, however common, is gathered in one task.

Equal texts are searched once for all of them, and repeat as a whole.  A text,
a context or a lengthened prefix is known by a hash of 128 bits; within a tree
words are compared themselves.

A row needs no id: what is removed depends on its text alone.  Rows that repeat
an id and a text are rows like others, their windows occur in each other.  Null
texts have no words.  Texts of any length are read whole; an empty table gives
an empty table; columns that are not named are not read.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import batches_of, by_batches, chunks_of, stored

WINDOW = 35
#: Words of an anchor; its place is the least hash among WINDOW - GRAM + 1 of them.
GRAM = 12
#: Different contexts of a prefix that one task takes into memory.
GROUP = 50_000
#: Word hashes that a task remembers.
REMEMBERED = 150_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: White space that parts words: blank and the control characters 9 to 13.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word):
        value = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return value


def window_wise(values, width, combine):
    """``combine`` over each run of ``width`` neighbours, by doubling."""
    parts, size = {1: values}, 1
    while size * 2 <= width:
        v = parts[size]
        parts[size * 2] = combine(v[:len(v) - size], v[size:], size)
        size *= 2
    out, done = parts[size], size
    for size in sorted(parts, reverse=True):
        if done + size <= width:
            more = parts[size][done:]
            out = combine(out[:len(more)], more, size)
            done += size
    return out


def gram_hashes(hashes, gram):
    """A hash of each run of ``gram`` words."""
    powers = {}

    def combine(left, right, size):
        if size not in powers:
            powers[size] = np.uint64(pow(int(FACTOR), size, 1 << 64))
        return left * powers[size] + right

    out = window_wise(hashes, gram, combine)
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def anchors(hashes, window=WINDOW, gram=GRAM):
    """Runs of windows with one anchor: (gram hash, first window, last window, anchor's place after the first) arrays."""
    grams = gram_hashes(hashes, gram)

    def least(left, right, _):
        return np.where(grams[right] < grams[left], right, left)

    place = window_wise(np.arange(len(grams)), window - gram + 1, least)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return grams[place[first]], first, last, place[first] - first


#: The seed of a second hash: what Spark's xxhash64 of this word and a text goes on with.
SECOND = "second"
SECOND_SEED = xxhash.xxh64_intdigest(SECOND.encode(), 42)


def two_hashes(column):
    """A text's hash of 128 bits, as two longs."""
    return F.xxhash64(column), F.xxhash64(F.lit(SECOND), column)


def two_hashes_of(data):
    return xxhash.xxh64_intdigest(data, 42), xxhash.xxh64_intdigest(data, SECOND_SEED)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def anchored(texts, window=WINDOW, gram=GRAM):
    """A row for each run of each different text that a task meets.

    a, b: the text's hash; prefix: the anchor's; place: first window, number of
    further windows, and where the anchor stands after the first, 5 bits each.
    """
    if window - gram > 31:
        raise ValueError("a run has at most 32 windows")

    def run(batches):
        known, seen = WordHashes(), set()
        for batch in batches:
            for _, chunk in chunks_of(batch, 0):
                if len(known) > REMEMBERED:
                    known.clear()
                keys, found = [], []
                for data in chunk:
                    words = data.split() if data else []
                    if len(words) < window:
                        continue
                    key = two_hashes_of(data)
                    if key in seen:
                        continue
                    seen.add(key)
                    found.append(anchors(np.array([known[w] for w in words], np.uint64), window, gram))
                    keys.append(key)
                if found:
                    key = np.repeat(np.array(keys, np.uint64), [len(x[0]) for x in found], axis=0).view(np.int64)
                    prefix, first, last, lead = (np.concatenate(x) for x in zip(*found))
                    place = first << 10 | (last - first) << 5 | lead
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(x)) for x in (prefix.view(np.int64), key[:, 0], key[:, 1], place)],
                        names=["prefix", "a", "b", "place"])

    return by_batches(texts.select("text"), run, "prefix long, a long, b long, place long")


def contexts(texts, wanted, window=WINDOW):
    """The words of each wanted run: a, b, first, prefix, lead, c and d (the context's hash), words."""
    rows = texts.join(wanted, ["a", "b"]).select("a", "b", "text", "runs")
    schema = "a long, b long, first long, prefix long, lead long, c long, d long, words binary"

    def run(batches):
        def found():
            seen = set()
            for batch in batches:
                texts = batch.column(2).cast(pa.binary())
                for a, b, data, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3)):
                    if (a, b) in seen:
                        continue
                    seen.add((a, b))
                    words = data.as_py().split()
                    for r in runs.as_py():
                        first, more, lead = r["place"] >> 10, r["place"] >> 5 & 31, r["place"] & 31
                        context = b" ".join(words[first:first + more + window])
                        yield (a, b, first, r["prefix"], lead, *map(signed, two_hashes_of(context)), context)

        names = ["a", "b", "first", "prefix", "lead", "c", "d"]
        yield from batches_of(found(), pa.schema([*((n, pa.int64()) for n in names), ("words", pa.binary())]))

    return by_batches(rows, run, schema)


def deep_repeats(members, window=WINDOW):
    """Spans of the repeats in the different contexts of one prefix: {member: [(start, stop)]}.

    ``members``: (words, where the anchor stands, number of copies).  Suffixes
    that begin as far before the anchor are sorted; neighbours with 35 or more
    words in common share an inner node of that depth, and the deeper of a
    leaf's two is as far as its repeat goes.
    """
    spans = {i: [(0, len(words))] for i, (words, _, n) in enumerate(members) if n > 1}
    if len(members) == 1:
        return spans
    most = max(lead for _, lead, _ in members)
    for before in range(most + 1):
        suffixes = sorted((words[lead - before:], i) for i, (words, lead, _) in enumerate(members) if 0 <= lead - before <= len(words) - window)
        for (x, i), (y, j) in zip(suffixes, suffixes[1:]):
            if x[:window] != y[:window]:
                continue
            common, least = window, min(len(x), len(y))
            while common < least and x[common] == y[common]:
                common += 1
            for k in (i, j):
                start = members[k][1] - before
                spans.setdefault(k, []).append((start, start + common))
    return spans


def joined_spans(spans):
    """Spans (start, stop) without overlap."""
    out = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


SPANS = "array<struct<start:int,stop:int>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def as_structs(spans):
    return [{"start": a, "stop": b} for a, b in spans]


def tree_spans(rows, window=WINDOW):
    """Repeats of all prefixes that fit in memory: c, d, spans.  A task holds one prefix at a time.  ``rows``: different contexts."""
    def run(batches):
        def prefixes():
            now, held, known = None, [], {}
            for batch in batches:
                for prefix, lead, c, d, words, n in zip(*(x.to_pylist() for x in batch.columns)):
                    if prefix != now and held:
                        yield held
                        held, known = [], {}
                    now = prefix
                    held.append(((c, d), ([known.setdefault(w, w) for w in words.split(b" ")], lead, n)))
            if held:
                yield held

        def found():
            for held in prefixes():
                for i, spans in deep_repeats([m for _, m in held], window).items():
                    yield (*held[i][0], as_structs(joined_spans(spans)))

        yield from batches_of(found(), pa.schema([("c", pa.int64()), ("d", pa.int64()), ("spans", ARROW_SPANS)]))

    dealt = rows.select("prefix", "lead", "c", "d", "words", "n").repartition("prefix").sortWithinPartitions("prefix")
    return by_batches(dealt, run, f"c long, d long, spans {SPANS}")


def lengthened(rows, window=WINDOW):
    """All windows of different contexts: c, d, start, n, and v and w, the window's hash."""
    def run(batches):
        def found():
            for batch in batches:
                for c, d, words, n in zip(*(x.to_pylist() for x in batch.columns)):
                    words = words.split(b" ")
                    for p in range(len(words) - window + 1):
                        yield (c, d, p, n, *map(signed, two_hashes_of(b" ".join(words[p:p + window]))))

        yield from batches_of(found(), pa.schema([(n, pa.int64()) for n in ("c", "d", "start", "n", "v", "w")]))

    return by_batches(rows.select("c", "d", "words", "n"), run, "c long, d long, start long, n long, v long, w long")


def repeats(texts, window=WINDOW, gram=GRAM, group=GROUP):
    """Spans of words covered by windows that also start elsewhere, which may overlap: a, b, spans.

    ``texts``: a, b (a text's hash) and text.  Tables that are joined by a key
    of any frequency are stored first, so that Spark can split the key's rows.
    """
    runs = stored(anchored(texts, window, gram), "anchors")
    often = stored(runs.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "prefixes")
    wanted = stored(runs.join(often, "prefix").groupBy("a", "b").agg(F.collect_set(F.struct("prefix", "place")).alias("runs")), "runs")
    found = stored(contexts(texts, wanted, window), "contexts")
    different = stored(found.groupBy("prefix", "lead", "c", "d", "words").agg(F.count("*").alias("n")), "different")
    crowded = stored(different.groupBy("prefix").agg(F.count("*").alias("m")).where(F.col("m") > group).select("prefix"), "crowded")
    few = tree_spans(different.join(crowded, "prefix", "left_anti"), window)
    windows = stored(lengthened(different.join(crowded, "prefix", "left_semi"), window), "windows")
    again = stored(windows.groupBy("v", "w").agg(F.sum("n").alias("n")).where("n > 1").select("v", "w"), "again")
    many = windows.join(again, ["v", "w"]).groupBy("c", "d").agg(
        F.collect_list(F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + window).cast("int").alias("stop"))).alias("spans"))
    spans = found.select("a", "b", "first", "c", "d").join(stored(few.unionByName(many), "repeats"), ["c", "d"]).select(
        "a", "b", F.transform("spans", lambda s: F.struct(
            (F.col("first") + s["start"]).cast("int").alias("start"), (F.col("first") + s["stop"]).cast("int").alias("stop"))).alias("spans"))
    # equal texts are repeats from end to end
    copies = texts.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select(
        "a", "b", F.array(F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("stop"))).alias("spans"))
    return spans.unionByName(copies).groupBy("a", "b").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def cut(data, spans, layout, window=WINDOW):
    """Number of words, spans removed, and what is kept.

    Kept words are joined by one space; with ``layout`` the text between kept
    words stays as it is, and a text with nothing removed is left alone.
    """
    if not data:
        return 0, [], b""
    words = data.split()
    n = len(words)
    spans = [(a, min(b, n)) for a, b in joined_spans(spans)] if n >= window else []
    if layout and not spans:
        return n, spans, data
    kept, at = [], 0
    if layout:
        places = [m.span() for m in WORD.finditer(data)]
        for start, stop in spans:
            kept.append(data[at:places[start][0]])
            at = places[stop][0] if stop < n else len(data)
        return n, spans, b"".join([*kept, data[at:]])
    for start, stop in spans:
        kept += words[at:start]
        at = stop
    return n, spans, b" ".join(kept + words[at:])


def without_repeats(docs, text="text", keep=("doc_id",), kept="kept", layout=False, window=WINDOW, gram=GRAM, group=GROUP):
    """For every row ``keep``, ``n_words``, ``n_removed``, ``spans`` of removed words, and the text that is kept.

    A word is removed if a window of 35 words that covers it also starts
    anywhere else, as the input has it.
    """
    keep = list(keep)
    rows = docs.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    a, b = two_hashes("text")
    rows = rows.withColumn("a", a).withColumn("b", b)
    found = stored(repeats(rows.select("a", "b", "text"), window, gram, group), "spans")
    rows = rows.join(found, ["a", "b"], "left").drop("a", "b")
    n = len(keep)
    schema = T.StructType([*(docs.select(*keep).schema if keep else ()), *T.StructType.fromDDL(f"n_words long, n_removed long, spans {SPANS}, {kept} string")])

    def run(batches):
        for batch in batches:
            for start, chunk in chunks_of(batch, n):
                part = batch.slice(start, len(chunk))
                done = [cut(data, [(s["start"], s["stop"]) for s in x or ()], layout, window)
                        for data, x in zip(chunk, part.column(n + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:n], pa.array([w for w, _, _ in done], pa.int64()),
                    pa.array([sum(y - x for x, y in s) for _, s, _ in done], pa.int64()),
                    pa.array([as_structs(s) for _, s, _ in done], ARROW_SPANS),
                    pa.array([k for _, _, k in done], pa.binary()).cast(pa.string())], names=schema.names)

    return by_batches(rows, run, schema)
