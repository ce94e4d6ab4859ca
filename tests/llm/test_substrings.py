import random
from collections import Counter

import pytest

from compare import check, connect
from folioscope.llm import queries
from folioscope.llm import substrings as op


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p:p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p + i for p in range(len(w) - window + 1) if seen[tuple(w[p:p + window])] > 1 for i in range(window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def texts_of(rng):
    passages = [" ".join(rng.choices("abcdefgh", k=n)) for n in (8, 9, 12, 30)]
    texts = [None, "", " \n", "x " * 100, "\x01a \x1cb c", "ä ö\xa0ü"]
    for _ in range(60):
        parts = [" ".join(rng.choices(["a", "bb", "ccc", "d\x00", "é"], k=rng.randint(0, 12))) for _ in range(3)]
        parts.insert(1, rng.choice(passages))
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return texts + [texts[-1], texts[-2], passages[3]]


def test_hashes_as_spark_has_them(spark):
    rows = [("",), ("a b",), ("é漢" * 50,)]
    got = spark.createDataFrame(rows, "t string").select("t", *op.two_hashes("t")).collect()
    assert all((op.signed(x), op.signed(y)) == (a, b) for t, a, b in got for x, y in [op.two_hashes_of(t.encode())])


@pytest.mark.parametrize("group", [10_000, 3, 0])
def test_against_all_windows(spark, group):
    texts = texts_of(random.Random(4))
    docs = spark.createDataFrame([(i if i % 7 else None, t, "k", i) for i, t in enumerate(texts)],
                                 "doc_id long, text string, key string, n_words int")
    left = op.without_repeats(docs, window=8, gram=3, group=group)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in left.collect())
    assert got == sorted((str(i if i % 7 else None), *x) for i, x in enumerate(brute(texts, 8)))


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "a b"), (1, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in op.without_repeats(docs).collect())
    assert got == [(1, 2, 0), (1, 50, 50), (1, 50, 50), (2, 2, 0)]
    assert op.without_repeats(docs.limit(0)).count() == 0


def test_layout_is_kept():
    assert op.cut(b" a  b\nc d", [(1, 2)], True, 1) == (4, [(1, 2)], b" a  c d")
    assert op.cut(b" a  b\nc d ", [(2, 3), (3, 9)], True, 1) == (4, [(2, 4)], b" a  b\n")
    assert op.cut(b" a  b\n", [], True, 1) == (2, [], b" a  b\n")
    assert op.cut(b" a  b\n", [(0, 9)], False, 3) == (2, [], b"a b")


def test_long_text(spark):
    rng = random.Random(1)
    body = " ".join(str(rng.random()) for _ in range(40_000))
    piece = " ".join(body.split()[100:160])
    docs = spark.createDataFrame([(1, body), (2, piece)], "doc_id int, text string")
    got = sorted((r.doc_id, r.n_removed) for r in op.without_repeats(docs).collect())
    assert got == [(1, 60), (2, 60)]


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message = check(spark, connect(folder), folder, queries.op6_substring_dedup, queries.OP6_SQL)
    assert ok, message
