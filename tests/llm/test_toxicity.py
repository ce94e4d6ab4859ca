import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import queries, shared
from folioscope.llm import toxicity as op


def corpus(rng, n):
    syllables = ["ba", "ne", "ti", "ro", "su", "la", "me"]
    rows = []
    for i in range(n):
        body = [[rng.choice(syllables) + rng.choice(syllables) + rng.choice(syllables) for _ in range(8)] for _ in range(rng.randint(1, 20))]
        toxic = i % 5 == 0
        if toxic:
            rng.choice(body)[3] = rng.choice(["grumbok", "zwoltar"]) + rng.choice(["", "en", "isch"])
        rows.append((i, ". ".join(" ".join(s) for s in body), int(toxic)))
    return rows


def test_finds_documents_and_their_sentence():
    rows = corpus(random.Random(2), 600)
    model = op.fit([r[1] for r in rows[:400]], [r[2] for r in rows[:400]], [1] * 400)
    scorer = op.Scorer(model)
    for _, text, toxic in rows[400:]:
        score, found = scorer.score(text, 0.5)
        assert (score >= 0.5) == bool(toxic)
        if toxic:
            worst = max(found, key=lambda f: f["score"])
            assert any(w in text[worst["start"]:worst["stop"]] for w in ("grumbok", "zwoltar"))


def test_noisy_or():
    model = (np.zeros(op.SLOTS, np.float32), 0.0)
    score, found = op.Scorer(model).score("One. Two! 3. Four", 0.5)
    assert abs(score - (1 - 0.5**3)) < 1e-12
    assert [(f["start"], f["stop"]) for f in found] == [(0, 3), (4, 8), (12, 17)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_score_is_a_chance(text):
    text = text.encode("utf-8", "replace").decode()
    model = (np.linspace(-3, 9, op.SLOTS).astype(np.float32), -2.0)
    score, found = op.Scorer(model).score(text, 0.0)
    assert 0 <= score <= 1
    assert all(0 <= f["start"] < f["stop"] <= len(text) for f in found)


def test_edges(spark):
    rows = corpus(random.Random(3), 300)
    docs = spark.createDataFrame([(i, t, "x", 3.0) for i, t, _ in rows] + [(None, "grumbok", "y", 1.0), (900, None, "y", 1.0), (900, "", "y", 1.0), (901, "a " * 50000, "z", 2.0)],
                                 "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in rows] + [(0, 0, 1), (1, None, 1), (None, 1, 1), (900, 0, 0), (5000, 1, 0)],
                                   "doc_id long, toxic int, text int")
    model = op.trained(docs, labels)
    got = op.scored(docs, model)
    assert got.count() == len(rows) + 4
    assert {r.score for r in got.where("doc_id = 900").collect()} == {0.0}
    assert got.where("doc_id IS NULL").first().score > 0.5
    assert op.trained(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in op.scored(docs, None).collect()} == {0.0}
    assert op.scored(docs.limit(0), model).count() == 0
    assert op.trained(docs.limit(0), labels.limit(0)) is None


def test_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(20)] + [(3, f"again {i}") for i in range(500)] + [(4, None), (5, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, body string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(op, "fit", lambda texts, labels, weights: seen.append(list(zip(texts, labels, weights))))
    op.trained(docs, labels, text="body")
    op.trained(docs.repartition(2), labels, text="body")
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5]
    assert seen[0] == seen[1] and len(seen[0]) == len(ids) and all(w == 1 for _, _, w in seen[0])
    assert sorted(x for _, x, _ in seen[0]) == sorted(i % 2 for i in ids) and all(t for t, _, _ in seen[0])


def test_sample_fits_its_bound(spark):
    docs = spark.createDataFrame([(i, "x" * (2000 if i == 2 else 50)) for i in range(20)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    got = shared.training_sample(docs, known, "text", "doc_id", 100, 1000)
    assert sorted(x for _, x in got) == [0] * 6 + [1] * 6 and all(len(t) == 50 for t, _ in got)
    assert len(shared.training_sample(docs, known, "text", "doc_id", 100, 10)) == 2
    assert len(shared.training_sample(docs, known, "text", "doc_id", 100)) == 20
    assert shared.within([], 5) == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op7_toxicity(spark, folder).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_accuracy():
    import duckdb
    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    test = [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 5]
    scorer = op.Scorer(op.fit([r[1] for r in train], [r[2] for r in train], [1] * len(train)))
    score = np.array([scorer.score(r[1], 0.5)[0] for r in test])
    toxic = np.array([r[2] for r in test])
    higher = (score[toxic == 1][:, None] > score[toxic == 0]).mean()
    assert higher > 0.95
    assert ((score >= 0.5) == toxic).mean() > 0.95
