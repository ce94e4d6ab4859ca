"""Fill-in-the-middle transformation by content-defined chunk memoization.

A text is cut at random between its tokens into prefix, middle and suffix,
which are written in another order behind sentinels.  Where the cuts lie depends
on how many tokens the whole text has.  So a rolling hash of the last 32 bytes
cuts the text into chunks; since it looks at nothing else, a passage that two
texts share falls into the same chunks, wherever it stands.  Each task keeps
the boundary summary of every chunk that it met: runs of words that it holds,
whether it begins and ends within one, and its code points.  A chunk is looked
up by its bytes, which are compared, so a summary is never taken for another
content's.  Summaries combine: a word that goes over a boundary is counted once.
Sums of the chunks' counts give a text's number of tokens and the chunk in which
a cut lies, and only that chunk is looked at for the cut.

No row needs another one, so nothing is shuffled and no key can be hot.  A
null text is empty.  A null id has the random numbers of an empty id; rows with
one id have the same.  Texts are taken whole whatever their length, in blocks
for the rolling hash.  Nothing depends on the text being valid UTF-8: every byte
that doesn't continue a character counts as one code point.  An empty table
gives an empty table; columns that are not named are not read, and those of
``keep`` come first whatever they are called.
"""

import re
from bisect import bisect_left
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import by_batches, chunks_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Random seed; percentage of texts that are cut; percentage of these with the suffix first.
SEED, CUT, SUFFIX_FIRST = 42, 50, 80
#: A chunk ends where so many leading bits of the rolling hash are zero: 1 kB on average.
BITS = 10
#: Least and most bytes of a chunk, but for a text's last.
LEAST, MOST = 128, 1 << 16
#: Bytes that go through the rolling hash at once.
BLOCK = 1 << 20
#: Bytes of chunks that a task remembers.
REMEMBERED = 32 << 20

BLANKS = b" \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CONTINUATION = bytes(range(0x80, 0xC0))
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
#: Bytes that the rolling hash looks at: one for each bit.
REACH = 32


def code_points(data):
    return len(data.translate(None, CONTINUATION))


def rolling(data):
    """The rolling hash behind every byte: each of the last 32 bytes' random number, shifted by its distance."""
    out, size = GEAR[np.frombuffer(data, np.uint8)], 1
    while size < REACH:
        more = out.copy()
        more[size:] += out[:-size] << np.uint32(size)
        out, size = more, size * 2
    return out


def chunk_stops(data):
    """Where the chunks of a text end."""
    stops, last, n = [], 0, len(data)
    for start in range(0, n, BLOCK):
        before = min(start, REACH - 1)
        hashes = rolling(data[start - before:start + BLOCK])[before:]
        for stop in (np.flatnonzero(hashes >> np.uint32(32 - BITS) == 0) + (start + 1)).tolist():
            while stop - last > MOST:
                last += MOST
                stops.append(last)
            if stop - last >= LEAST:
                last = stop
                stops.append(last)
    while n - last > MOST:
        last += MOST
        stops.append(last)
    if last < n:
        stops.append(n)
    return stops


def summary(chunk):
    """Runs of words, whether the chunk begins and ends within one, and code points."""
    return len(chunk.split()), chunk[0] not in BLANKS, chunk[-1] not in BLANKS, code_points(chunk)


class Summaries(dict):
    """Summaries of the chunks that a task met, by their bytes."""

    held = 0

    def __missing__(self, chunk):
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        self.held += len(chunk)
        value = self[chunk] = summary(chunk)
        return value


class Counted:
    """A text's chunks with the sums of their counts."""

    def __init__(self, data, known):
        self.data = data
        self.stops = chunk_stops(data)
        found = [known[data[a:b]] for a, b in zip([0, *self.stops], self.stops)]
        begins = [*(f[1] for f in found[1:]), False]
        #: Words that end up to the end of each chunk.  The last one of a chunk ends there unless the next goes on with it.
        self.words = list(accumulate(runs - (ends and goes_on) for (runs, _, ends, _), goes_on in zip(found, begins)))
        self.points = list(accumulate(f[3] for f in found))
        words = self.words[-1] if found else 0
        #: Every word with the blanks before it is a token; so are blanks at the end.
        self.n = words + (bool(found) and not found[-1][2])

    def after(self, tokens):
        """Bytes and code points up to the end of the first ``tokens`` tokens."""
        if tokens == 0:
            return 0, 0
        if tokens == self.n:
            return len(self.data), self.points[-1]
        at = bisect_left(self.words, tokens)
        start, words, points = (self.stops[at - 1], self.words[at - 1], self.points[at - 1]) if at else (0, 0, 0)
        chunk = self.data[start:self.stops[at]]
        stop = next(islice(WORD.finditer(chunk), tokens - words - 1, None)).end()
        return start + stop, points + code_points(chunk[:stop])


def arranged(data, draws, known, cut=CUT, suffix_first=SUFFIX_FIRST):
    """Tokens, form, code points of prefix and middle, and the text as it is written."""
    whole = Counted(data, known)
    first, second, third, fourth = draws
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or third % 100 >= cut:
        return whole.n, "plain", None, None, data
    low, high = sorted((first % (whole.n + 1), second % (whole.n + 1)))
    (a, before), (b, upto) = whole.after(low), whole.after(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if fourth % 100 < suffix_first:
        return whole.n, "spm", before, upto - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return whole.n, "psm", before, upto - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def draws(doc, seed=SEED):
    """Four random numbers of an id: the leading groups of eight digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transformed(docs, text="text", doc="doc_id", keep=("doc_id",), seed=SEED, cut=CUT, suffix_first=SUFFIX_FIRST):
    """For every row ``keep``, ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    A token is a word with the white space before it, or white space at the
    end.  A text that is empty or has a sentinel in it stays plain.
    """
    keep = list(keep)
    rows = docs.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keep)], draws(doc, seed).alias("__draws"),
                       F.col(text).cast("string").alias("__text"))
    k = len(keep)
    schema = T.StructType([*rows.schema[:k], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")])

    def run(batches):
        known = Summaries()
        for batch in batches:
            for start, chunk in chunks_of(batch, k + 1):
                part = batch.slice(start, len(chunk))
                done = [arranged(data or b"", four, known, cut, suffix_first) for data, four in zip(chunk, part.column(k).to_pylist())]
                n, form, before, middle, output = zip(*done)
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:k], pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()).cast(pa.string(), safe=False)], names=schema.names)

    return by_batches(rows, run, schema).toDF(*keep, *schema.names[k:])


def restored(output, form):
    """The text that was written: the parts behind the sentinels put back in order."""
    output, form = F.col(output), F.col(form)
    rest = F.substr(output, F.lit(len(PREFIX) + 1))

    def between(start, stop):
        return F.substr(rest, start, stop - start)

    def at(sentinel):
        return F.locate(sentinel.decode(), rest)

    first, middle = F.lit(1), F.substr(rest, at(MIDDLE) + len(MIDDLE))
    psm = F.concat(between(first, at(SUFFIX)), middle, between(at(SUFFIX) + len(SUFFIX), at(MIDDLE)))
    spm = F.concat(between(at(PREFIX) + len(PREFIX), at(MIDDLE)), middle, between(first, at(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
