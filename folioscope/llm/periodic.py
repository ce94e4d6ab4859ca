"""Periodic run detection by recursive frequency splitting.

A run is a stretch of words that repeats with a period of q words, four times
over and six words long at least, as far as it goes.  Every word of a run
occurs four times in it.  So a word that occurs less often in a text can be in
no run and splits it; within the pieces words are counted anew, and what has
become too rare there splits them further, until nothing changes.  Of a split
piece only the smaller parts are counted; the largest keeps the counts less
theirs, so all rounds together take n log n steps.  Most texts are used up by
this.  What survives is scanned lag by lag: short lags by comparing all words
with those a lag further, longer ones by comparing hashes at every lag-th word,
of which a run covers three in a row, and extending what agrees word by word.
That is n log n comparisons.  A stretch that lies in a run of a shorter period
isn't a run of its own (two periods of one stretch have a common divisor).

No row needs another one, so nothing is shuffled and no key can be hot.  A null
text has no words and no runs.  Texts are taken whole, their words as numbers.
Repeated rows are rows like others; an empty table gives an empty table; columns
that are not named are not read.
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import by_batches, chunks_of
from folioscope.llm.substrings import gram_hashes

#: Times that a run repeats its period, and its words, at least.
TIMES, SHORTEST = 4, 6
#: Lags below this are scanned word by word.
SHORT = 16


def numbered(words):
    """Each word as a number; equal words have equal ones."""
    known = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def stretches(flags):
    """(start, stop) arrays of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def counted(words):
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return counts


def split_to_stability(words, times=TIMES, shortest=SHORTEST):
    """(start, stop) of the pieces of a list of words in which every word occurs ``times`` times."""
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    stack = [(0, len(words), {w: len(p) for w, p in places.items()}, list(places))]
    while stack:
        start, stop, counts, suspects = stack.pop()
        rare = [w for w in suspects if 0 < counts[w] < times]
        if not rare:
            yield start, stop
            continue
        cuts = []
        for w in rare:
            p = places[w]
            at = bisect_left(p, start)
            cuts += p[at:at + counts[w]]
            counts[w] = 0
        cuts.sort()
        parts = sorted(((b - a, a, b) for a, b in zip([start, *(c + 1 for c in cuts)], [*cuts, stop]) if b > a), reverse=True)
        if not parts or parts[0][0] < shortest:
            continue
        touched = set()
        for size, a, b in parts[1:]:
            piece = words[a:b]
            for w in piece:
                counts[w] -= 1
            touched.update(piece)
            if size >= shortest:
                fresh = counted(piece)
                stack.append((a, b, fresh, list(fresh)))
        stack.append((*parts[0][1:], counts, touched))


def segments(ids, times=TIMES, shortest=SHORTEST):
    """(start, stop) of the surviving pieces of a text, by frequency in the whole text first."""
    often = np.bincount(ids)[ids] >= times if len(ids) else np.zeros(0, bool)
    for a, b in zip(*stretches(often)):
        if b - a >= shortest:
            for x, y in split_to_stability(ids[a:b].tolist(), times, shortest):
                yield int(a) + x, int(a) + y


class Found:
    """Runs found so far, which tell whether a stretch lies in one of them."""

    def __init__(self):
        self.runs, self.starts, self.furthest = [], None, None

    def over(self, size):
        """Whether the last run goes over all of a piece."""
        return bool(self.runs) and self.runs[-1][:2] == (0, size)

    def add(self, start, stop, period):
        self.runs.append((start, stop, period))
        self.starts = None

    def cover(self, starts, stops):
        """Which of the stretches lie in a run."""
        if not self.runs:
            return np.zeros(len(starts), bool)
        if self.starts is None:
            edges = np.array([r[:2] for r in sorted(self.runs)])
            self.starts, self.furthest = edges[:, 0], np.maximum.accumulate(edges[:, 1])
        at = np.searchsorted(self.starts, starts, "right") - 1
        return (at >= 0) & (self.furthest[at] >= stops)


def agreeing(values, start, lag):
    """The first place from ``start`` on whose word differs from the one a lag further."""
    last, i, step = len(values) - lag, start, 64
    while i < last:
        stop = min(i + step, last)
        other = values[i:stop] != values[i + lag:stop + lag]
        if other.any():
            return i + int(other.argmax())
        i, step = stop, step * 2
    return last


def lag_scan(values, times=TIMES, shortest=SHORTEST):
    """(start, stop, period) of the runs in a surviving piece, by period."""
    if times < 4:
        raise ValueError("a run must cover three marks in a row")
    found, n = Found(), len(values)
    backwards, grams, size = values[::-1], None, 0
    for lag in range(1, n // times + 1):
        need = max(shortest, times * lag)
        if need > n or found.over(n):
            break  # a run over all of it leaves no longer period
        if lag < SHORT:
            starts, stops = stretches(values[lag:] == values[:-lag])
            stops = stops + lag
            long = stops - starts >= need
            starts, stops = starts[long], stops[long]
            new = ~found.cover(starts, stops)
            for a, b in zip(starts[new].tolist(), stops[new].tolist()):
                found.add(a, b, lag)
            continue
        if size * 2 <= lag:
            size = 1 << lag.bit_length() - 1
            grams = gram_hashes(values.astype(np.uint64), size)
        marks = grams[::lag]
        hits = np.flatnonzero((marks[:-2] == marks[1:-1]) & (marks[1:-1] == marks[2:])) * lag
        if not len(hits):
            continue
        hits = hits[~found.cover(hits, hits + 2 * lag + size)]
        at = 0
        while at < len(hits):
            x = int(hits[at])
            stop = agreeing(values, x, lag)
            start = n - lag - agreeing(backwards, n - x - lag, lag)
            if stop + lag - start >= need and not found.cover([start], [stop + lag])[0]:
                found.add(start, stop + lag, lag)
            at = max(at + 1, int(np.searchsorted(hits, stop)))
    return found.runs


def runs_of(words, times=TIMES, shortest=SHORTEST):
    """(start, length, period) of all runs, by start, then period."""
    ids = numbered(words)
    return sorted((a + x, y - x, q) for a, b in segments(ids, times, shortest) for x, y, q in lag_scan(ids[a:b], times, shortest))


def strongest(runs):
    """The run with the greatest length in periods, compared exactly; of equal ones the first, then the one of least period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words, runs):
    """The words without those that a run repeats: what lies in a run behind its first period."""
    if not runs:
        return words
    level = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        level[start + period] += 1
        level[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(level[:-1]) == 0).tolist()]


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
ARROW_RUN = pa.struct([(name, pa.int64()) for name in RUN.names])


def as_structs(runs):
    return [None if r is None else dict(zip(RUN.names, r)) for r in runs]


def periodic_runs(docs, text="text", keep=("doc_id",), times=TIMES, shortest=SHORTEST):
    """For every row ``keep``, ``n_words``, ``runs`` by start, the ``strongest`` run (null if none), and the text ``collapsed``.

    A run has its start (number of its first word), length and period in
    words.  ``collapsed`` has what no run repeats, joined by one space.
    """
    keep = list(keep)
    rows = docs.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keep)], F.col(text).cast("string").alias("__text"))
    k = len(keep)
    schema = T.StructType([*rows.schema[:k], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for batch in batches:
            for start, chunk in chunks_of(batch, k):
                words = [(data or b"").split() for data in chunk]
                found = [runs_of(w, times, shortest) for w in words]
                yield pa.RecordBatch.from_arrays([
                    *batch.slice(start, len(chunk)).columns[:k], pa.array([len(w) for w in words], pa.int64()),
                    pa.array([as_structs(r) for r in found], pa.list_(ARROW_RUN)), pa.array(as_structs(map(strongest, found)), ARROW_RUN),
                    pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, found)], pa.binary()).cast(pa.string(), safe=False)],
                    names=schema.names)

    return by_batches(rows, run, schema).toDF(*keep, *schema.names[k:])
