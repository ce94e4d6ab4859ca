import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from folioscope.llm import periodic as op
from folioscope.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs by trying every stretch's least period."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if j > i and length >= max(6, 4 * q):
                if not any(all(words[x] == words[x + p] for x in range(start, start + length - p)) for p in range(1, q)):
                    found.add((start, length, q))
            i = j + 1 if j > i else i + 1
    return sorted(found)


def made(rng, letters, n):
    """Words with repeats in repeats."""
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.4:
            out += rng.choices(letters, k=rng.randint(1, 6))
        elif kind < 0.8:
            out += rng.choices(letters, k=rng.randint(1, 7)) * rng.randint(2, 7)
        else:
            at = rng.randrange(len(out) + 1)
            out += out[at:at + rng.randint(1, 40)] * rng.randint(1, 5)
        if rng.random() < 0.3:
            out = out[:-1]
    return out[:n]


def test_runs_against_brute_force():
    rng = random.Random(5)
    for i in range(700):
        words = made(rng, "abcdefgh"[:rng.choice([1, 2, 3, 8])], rng.choice([0, 1, 5, 6, 7, 12, 60, 200]))
        assert op.runs_of(words) == brute(words), words


def test_long_periods_against_brute_force():
    rng = random.Random(6)
    for i in range(30):
        q = rng.randint(14, 70)
        block = rng.choices("abc" if i % 2 else "abcdefghijklmnop", k=q)
        words = rng.choices("abc", k=rng.randint(0, 50)) + (block * 7)[:rng.randint(4 * q - 2, 7 * q)] + rng.choices("abc", k=rng.randint(0, 50))
        if i % 3 == 0:
            words[len(words) // 2] = "z"
        if i % 5 == 0:
            words += words[-3 * q:]
        assert op.runs_of(words) == brute(words)


def test_splitting_leaves_words_that_occur_four_times():
    rng = random.Random(7)
    for _ in range(200):
        words = made(rng, "abcdefghijkl", 150)
        ids = op.numbered(words)
        pieces = sorted(op.segments(ids))
        for a, b in pieces:
            assert min(np.bincount(ids[a:b])[ids[a:b]]) >= 4
        for start, length, _ in brute(words):
            assert any(a <= start and start + length <= b for a, b in pieces)


def test_rounds_that_remove_little_take_no_square_of_time():
    # every round takes one word from each end: w0 w1 ... in nested pairs
    n = 30_000
    words = [i // 3 for i in range(n)] + [i // 3 + 1 for i in range(n)]
    start = time.time()
    op.runs_of(list(map(str, words)))
    for words in (["a"] * 400_000, random.Random(1).choices("ab", k=200_000), ["a"] * 100_000 + ["b"] * 100_000 + ["a"] * 100_000,
                  (random.Random(2).choices("abcdefghij", k=30_000) * 6)):
        op.runs_of(words)
    assert time.time() - start < 60


def test_strongest_is_exact():
    assert op.strongest([]) is None
    assert op.strongest([(0, 8, 2), (9, 4 * 10**8 + 1, 10**8), (20, 4 * 10**8, 10**8)]) == (9, 4 * 10**8 + 1, 10**8)
    assert op.strongest([(0, 8, 2), (0, 12, 3), (5, 8, 2)]) == (0, 8, 2)


def as_rows(doc, words):
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode() if doc is not None else b"")
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n", "x " * 50, "é " * 6, "a b\xa0c", "\x1c a" * 9, "漢 字 " * 400]
    texts += [rng.choice([" ", "\n", "\t "]).join(made(rng, ["a", "bb", "ç", "\x00"], rng.choice([1, 7, 40, 90]))) for _ in range(250)]
    texts += [" ".join(str(i % 37 if i > 60 else -i) for i in range(300))] * 3
    rows = [(None if i == 20 else i, t, 1) for i, t in enumerate(texts)] + [(7, texts[-1], 2), (7, texts[-1], 2)]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted((as_rows(d, planted(d, t)) for d, t, _ in rows), key=order)
    assert queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").where("n_runs > 0").count() > 0


def test_given_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 6000").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, folder).collect()}
    for d in docs:
        assert got[d.doc_id] == as_rows(d.doc_id, planted(d.doc_id, d.text))


def test_general_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("p", "a " * 7, 3), ("q", None, 4)], "runs string, body string, n_words int")
    found = op.periodic_runs(docs, "body", keep=["runs"])
    assert sorted((r[0], r.n_words, len(r[2]), r.collapsed) for r in found.collect()) == [("p", 7, 1, "a"), ("q", 0, 0, "")]
    assert op.periodic_runs(docs.limit(0), "body", keep=["runs"]).count() == 0
