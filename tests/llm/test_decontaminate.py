import random

import pytest

from compare import check, connect
from folioscope.llm import decontaminate as op
from folioscope.llm import queries


def brute(text, items):
    words = op.words_of((text or "").encode())
    hit, names = set(), set()
    for item, body in items:
        own = op.words_of((body or "").encode())
        size = min(13, len(own))
        for i in range(max(len(own) - 12, 1) if own else 0):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == own[i:i + size]:
                    hit |= set(range(p, p + size))
                    names |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    vocab = ["a", "B", "c9", "é", "the", "X"]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([1, 2, 3, 12, 13, 14, 30, 40, 0])]
    items += [(3, items[5][1]), (None, items[6][1]), (77, None), (78, "- -")]
    items = [x for x in items if x[0] not in (0, 1, 2)] + [(200, "zz"), (201, "zz yy")]
    texts = [None, "", "--", "zz", "ZZ-yy!", "x " * 30]
    for _ in range(40):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        body = rng.choice(items)[1] or ""
        at = rng.randint(0, len(words))
        texts.append(rng.choice([" ", "-", "\n"]).join(words[:at] + body.split()[rng.randint(0, 3):] + words[at:]))
    texts.append(texts[-1])
    docs = spark.createDataFrame([(i % 40, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_words int")
    found = op.hits(op.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect())
    want = sorted((i % 40, n, h, names, h > 0 and 20 * h >= n) for i, (n, h, names) in enumerate(brute(t, items) for t in texts))
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:2] for r in op.contaminated(docs, none).collect()] == [(1, 3)]
    assert op.contaminated(docs.limit(0), none).count() == 0


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message = check(spark, connect(folder), folder, queries.op3_decontamination, queries.OP3_SQL)
    assert ok, message
