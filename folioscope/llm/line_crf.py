"""Quality rules by line labelling: a linear-chain conditional random field marks content or boilerplate.

Every line with a word is described by a few numbers; a chain over the lines of
a document scores labels and their changes, and Viterbi decoding gives the best
labels of the whole document.  It is kept if at least half of its words lie in
content lines, and if counts over the whole text pass as well.

The chain is trained from document labels: in good documents all lines are
content.  In bad ones the boilerplate lines are not known; they all count as
such at first, then those that the fitted chain still calls boilerplate, the
one that it finds worst always among them.  The fit takes at most ``SAMPLE``
labelled documents of each label, those with the least hash of their id, one
text an id, and of these as many as fit into ``SAMPLE_COST`` bytes; how much
more frequent good ones are in the table is added to the chain's start.

Null texts have no words; texts without words have a share of content of 1 and
fail the counts.  Labels that are null are left out; where an id has several
the least holds.  Without documents of both labels every line is content.
Repeated rows are judged alike; empty tables give empty tables; columns that
are not named are not read.  Texts of any length are read whole.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import by_batches, chunks_of, training_sample

SAMPLE = 1_500
STEPS, RATE, RIDGE = 100, 0.1, 1e-3
ROUNDS = 3
#: The least share of a document's words in content lines.
SHARE = 0.5
MIN_WORDS = 50
#: Per cent of words in repeated windows that a document may have.
MAX_REPEATED = 50

SYMBOLS = "#*$%&|<>"
#: White space that parts words: blank and the control characters 9 to 13.
SPACE = "\t\n\x0b\x0c\r "
SPLIT = re.compile("[^" + SPACE + "]+")
UNSPACED = {ord(c): None for c in SPACE}
LETTERS = re.compile(r"[^\W\d_]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
FEATURES = 14


def line_features(line, words, again, first, last):
    """Numbers that describe a line, most between 0 and 1; the first is always 1."""
    chars = sum(map(len, words))
    letters = len(LETTERS.findall(line))
    n = len(words)
    repeated = 1 - len(set(words)) / n
    symbols = sum(line.count(c) for c in SYMBOLS)
    return (1.0, float(again), repeated, float(repeated > 0.5 and n > 5), min(1.0, 4 * symbols / chars), float(symbols * 10 > chars),
            len(UPPER.findall(line)) / max(1, letters), 1 - letters / chars, min(1.0, line.count("!") / n),
            float(line.count("|") * 3 >= n), float(n < 4), min(1.0, n / 50), float((line.rstrip() or line)[-1] in ".!?…:;\"'”»"),
            float(first or last))


def lines_of(text):
    """(number, line, words) of each line with a word."""
    for number, line in enumerate(text.split("\n")):
        words = SPLIT.findall(line)
        if words:
            yield number, line, words


def described(text):
    """Line numbers, word counts and features of a text's lines."""
    found = list(lines_of(text))
    seen, rows = set(), []
    for i, (_, line, words) in enumerate(found):
        rows.append(line_features(line, words, line in seen, i == 0, i + 1 == len(found)))
        seen.add(line)
    return [f[0] for f in found], [len(f[2]) for f in found], np.array(rows, np.float64).reshape(len(rows), FEATURES)


class Chain:
    """Weights: ``w`` for boilerplate against content, ``change[a, b]`` from a line's label to the next one's, ``prior`` for content at the start."""

    def __init__(self, w, change, prior=0.0):
        self.w, self.change, self.prior = w, change, prior

    def decode(self, x):
        """The best labels of a document's lines, 1 for boilerplate; content wins ties."""
        if not len(x):
            return []
        scores = (x @ self.w).tolist()
        (cc, cb), (bc, bb) = self.change.tolist()
        content, boiler, back = self.prior, scores[0], []
        for s in scores[1:]:
            from_c, from_b = content + cc >= boiler + bc, content + cb >= boiler + bb
            back.append((0 if from_c else 1, 0 if from_b else 1))
            content, boiler = (content + cc if from_c else boiler + bc), (content + cb if from_b else boiler + bb) + s
        label = 0 if content >= boiler else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _marginals(scores, change, lengths):
    """Forward and backward over all documents at once, longest first: log Z, P(boilerplate) and the expected changes."""
    n, most = scores.shape
    alive = [int((lengths > t).sum()) for t in range(most)]
    emit = np.stack([np.zeros_like(scores), scores], 2)
    forward = np.full((n, most, 2), -np.inf)
    forward[:, 0] = emit[:, 0]
    for t in range(1, most):
        k = alive[t]
        forward[:k, t] = np.logaddexp(forward[:k, t - 1, :1] + change[0], forward[:k, t - 1, 1:] + change[1]) + emit[:k, t]
    backward = np.zeros((n, most, 2))
    expected = np.zeros((2, 2))
    total = forward[np.arange(n), lengths - 1]
    z = np.logaddexp(total[:, 0], total[:, 1])
    for t in range(most - 2, -1, -1):
        k = alive[t + 1]
        after = emit[:k, t + 1] + backward[:k, t + 1]
        pair = change[None] + after[:, None, :]
        expected += np.exp(forward[:k, t, :, None] + pair - z[:k, None, None]).sum(0)
        backward[:k, t] = np.logaddexp(pair[:, :, 0], pair[:, :, 1])
    return z, np.exp(forward + backward - z[:, None, None])[:, :, 1], expected


def fit_chain(documents, labels, steps=STEPS, rate=RATE, ridge=RIDGE):
    """Weights that make the labels of all lines likeliest, with a cost of squared weights."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    lengths = np.array([len(documents[i]) for i in order])
    most = int(lengths[0])
    x = np.zeros((len(order), most, FEATURES))
    y = np.zeros((len(order), most))
    for row, i in enumerate(order):
        x[row, :lengths[row]], y[row, :lengths[row]] = documents[i], labels[i]
    there = np.arange(most) < lengths[:, None]
    lines = there.sum()
    both = there[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    seen_w = (x * (y * there)[:, :, None]).sum((0, 1))
    theta, moment, square = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, steps + 1):
        w, change = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        _, p, expected = _marginals(x @ w, change, lengths)
        p = np.where(there, p, 0)
        gradient = np.r_[np.einsum("ij,ijk->k", p, x) - seen_w, (expected - seen).ravel()] / lines + ridge * theta
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta - rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Chain(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def fit(texts, good, odds=1.0, rounds=ROUNDS):
    """A chain from whole texts and whether each is good, and the odds of good ones in the table; None without both."""
    pairs = [(described(t or "")[2], g) for t, g in zip(texts, good)]
    pairs = [(x, g) for x, g in pairs if len(x)]
    if len({bool(g) for _, g in pairs}) < 2:
        return None
    # documents that are much longer than most are fitted in parts of this many lines
    part = 200
    pairs = [(x[i:i + part], g) for x, g in pairs for i in range(0, len(x), part)]
    documents = [x for x, _ in pairs]
    labels = [np.zeros(len(x)) if g else np.ones(len(x)) for x, g in pairs]
    for turn in range(rounds):
        chain = fit_chain(documents, labels)
        if turn + 1 < rounds:
            for i, (x, g) in enumerate(pairs):
                if not g:
                    labels[i] = np.array(chain.decode(x), float)
                    labels[i][int(np.argmax(x @ chain.w))] = 1
    chain.prior = max(0.0, float(np.log(odds)))
    return chain


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = SPLIT.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif SPLIT.search(line):
            seen.add(line)
    return len(words), len(text.translate(UNSPACED)), sum(text.count(c) for c in SYMBOLS), again, repeated_words(words)


def repeated_words(words):
    """Words in windows of three that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i:n - 2 + i] |= often
    return int(covered.sum())


def trained(docs, labels, text="text", doc="doc_id", label="quality", sample=SAMPLE):
    """A chain from labelled rows."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(doc).agg(F.min(label).alias("label"))
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    rows = training_sample(docs, known, text, doc, sample)
    return fit([t for t, _ in rows], [x == 1 for _, x in rows], totals.get(1, 1) / totals.get(0, 1))


def judged(docs, chain, text="text", keep=("doc_id",), share=SHARE):
    """For every row ``keep``, the counts, ``boilerplate`` (numbers of such lines), ``content_share``, ``base_failed`` and ``kept``."""
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([*(rows.schema[k] for k in keep), *(T.StructField(x, T.LongType()) for x in names),
                           T.StructField("boilerplate", T.ArrayType(T.IntegerType())), T.StructField("content_share", T.DoubleType())])
    n = len(keep)

    def run(batches):
        for batch in batches:
            for start, chunk in chunks_of(batch, n):
                found = []
                for data in chunk:
                    body = (data or b"").decode()
                    numbers, counts, x = described(body)
                    marks = sent.value.decode(x) if sent.value else [0] * len(x)
                    content = sum(c for c, m in zip(counts, marks) if not m)
                    found.append((*base_counts(body), [k for k, m in zip(numbers, marks) if m], content / sum(counts) if counts else 1.0))
                columns = [pa.array(c, t) for c, t in zip(zip(*found), [*[pa.int64()] * 5, pa.list_(pa.int32()), pa.float64()])]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(chunk)).columns[:n], *columns], names=schema.names)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return by_batches(rows, run, schema).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("content_share") >= share))
