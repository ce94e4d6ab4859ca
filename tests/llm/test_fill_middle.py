import hashlib
import random
import re

import pytest

from compare import check, connect
from folioscope.llm import fill_middle as op
from folioscope.llm import queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_of(rng):
    words = ["a", "bb", "é", "漢字" * 30, "\xa0", "　x", "<", "<P", "S>", "🤦🏽", "\x1c", "\x00", "x" * 300]
    blanks = [" ", "\n", "  ", "\t \r\n", "\x0b\x0c", " " * 200]
    texts = [None, "", " ", "\n" * 500, "x" * 5000, "a<P>b c d", "<S>", "x <M>", "é" * 3000 + " ", "<<S a", "a <S<P b>"]
    for _ in range(300):
        parts = [rng.choice(blanks)] if rng.random() < 0.3 else []
        for _ in range(rng.randint(0, 120)):
            parts += [rng.choice(words), rng.choice(blanks)]
        texts.append("".join(parts[:-1] if rng.random() < 0.6 else parts))
    shared = texts[-1] * 20
    return texts + [shared, "ä " + shared, shared + shared[5:]]


@pytest.mark.parametrize("least, most, bits, block", [(128, 1 << 16, 10, 1 << 20), (1, 7, 1, 50), (3, 40, 3, 64), (1, 1, 2, 33)])
def test_cuts_wherever_chunks_end(monkeypatch, least, most, bits, block):
    for name, value in (("LEAST", least), ("MOST", most), ("BITS", bits), ("BLOCK", block)):
        monkeypatch.setattr(op, name, value)
    known = op.Summaries()
    for text in texts_of(random.Random(1))[:80]:
        data, tokens = (text or "").encode(), TOKEN.findall(text or "")
        whole = op.Counted(data, known)
        assert whole.n == len(tokens)
        assert [data[a:b] for a, b in zip([0, *whole.stops], whole.stops)] == [data[a:b] for a, b in zip([0, *whole.stops], whole.stops) if b > a]
        for k in range(len(tokens) + 1):
            before = "".join(tokens[:k])
            assert whole.after(k) == (len(before.encode()), len(before))


def test_a_passage_falls_into_the_same_chunks():
    rng = random.Random(3)
    passage = " ".join(str(rng.random()) for _ in range(2000)).encode()
    cut = lambda data: {data[a:b] for a, b in zip([0, *op.chunk_stops(data)], op.chunk_stops(data))}
    one, other = cut(b"begin " + passage), cut(passage + b" end of another text")
    assert len(one & other) > 0.8 * len(one)


def test_remembered_chunks_stay_within_bound(monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 5000)
    known = op.Summaries()
    for i in range(1000):
        assert known[b"%d x" % i] == (2, True, True, len(b"%d x" % i))
    assert sum(map(len, known)) <= 5000 + 10


def test_against_brute_force(spark):
    texts = texts_of(random.Random(2))
    rows = [(i if i % 9 else None, t, "k", i) for i, t in enumerate(texts)] + [(5, "a b", "k", 0), (5, "a b", "k", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").withColumnRenamed("form", "output2")
    done = op.transformed(docs, keep=["doc_id"])
    got = done.select("*", op.restored("output", "form").alias("back"), op.F.xxhash64("output").alias("x")).collect()
    want = [(d, *brute(d, t)) for d, t, _, _ in rows]
    order = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=order) == sorted(want, key=order)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t, _, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(i, "wörd  " * 300_000 + "e") for i in range(6)], "doc_id int, text string")
    assert op.transformed(docs.limit(0)).count() == 0
    for r in op.transformed(docs).collect():
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (r.doc_id, *brute(r.doc_id, "wörd  " * 300_000 + "e"))


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message = check(spark, connect(folder), folder, queries.op11_fill_in_middle, queries.OP11_SQL)
    assert ok, message
