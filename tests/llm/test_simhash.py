import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import queries
from folioscope.llm import simhash as op


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    """Least position reachable over links of 3 bits or fewer, by comparing all pairs."""
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(values))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAÄb \n\t\x0b\x1c\xa0é"), max_size=30))
def test_fingerprint(text):
    assert op.fingerprint(text.encode()) == plain(text)


def clustered(rng, n):
    values = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(values) < n:
        v = rng.choice(values)
        for b in rng.sample(range(64), rng.choice([1, 1, 2, 3, 4])):
            v ^= 1 << b
        values.append(v)
    return sorted(set(values))


def test_forest_against_all_pairs():
    rng = random.Random(3)
    for n, fanout in ((40, 2), (200, 4), (400, 16)):
        values = clustered(rng, n)
        forest = op.Forest(np.zeros(len(values), np.int64), np.array(values, np.uint64), fanout)
        label = forest.joined()
        want = groups(forest.values.tolist())
        assert label.tolist() == want


def test_dense_ball():
    base = 0x123456789ABCDEF0
    values = sorted({base ^ (1 << a | 1 << b) for a in range(40) for b in range(40)})
    forest = op.Forest(np.zeros(len(values), np.int64), np.array(values, np.uint64))
    assert set(forest.joined().tolist()) == {0}


def test_links_with_crowded_roots(spark):
    values = clustered(random.Random(9), 300)
    df = spark.createDataFrame([(op.signed(v),) for v in values], "fp long")
    want = groups(values)
    for crowded in (1, 3, 10_000):
        label = {v: v for v in values}

        def root(v):
            while label[v] != v:
                v = label[v]
            return v
        for r in op.links(df, crowded).collect():
            a, b = sorted((root(r.a % (1 << 64)), root(r.b % (1 << 64))))
            label[b] = a
        assert [values.index(root(v)) for v in values] == want


def test_edges(spark):
    rows = [(5, None, 1), (4, "", 2), (9, "one two three four five six", 3), (7, "One two three four five six", 3), (7, "One two three four five six", 3),
            (None, "quite another text stands here alone", 4), (2, "x " * 30000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in op.near_duplicates(docs).collect()), key=str)
    assert [x[1] for x in got if x[0] in (4, 5)] == [0, 0]
    want = sorted(((d, plain(t), {5: 4, 4: 4, 9: 7, 7: 7, None: None, 2: 2}[d]) for d, t, _ in rows), key=str)
    assert got == want
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents").orderBy("doc_id").collect()
    values = [plain(d.text) for d in docs]
    names = groups(values)
    want = sorted((d.doc_id, f"{v:016x}", docs[i].doc_id) for d, v, i in zip(docs, values, names))
    assert sorted(tuple(r) for r in queries.op2_simhash(spark, folder).collect()) == want
