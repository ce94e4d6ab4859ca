import random

import pytest

import corpus_pipeline as pipe
from folioscope.llm import toxicity
from test_bpe import PEER
from test_decontaminate import brute as hits_of
from test_simhash import groups, plain
from test_substrings import brute as without_repeats


def table(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    passage, item = prose(60), prose(20)
    texts = {i: prose(rng.randint(40, 120)) for i in range(300)}
    toxic = {i for i in range(0, 300, 6)}
    for i in toxic:
        texts[i] += " grumbok zwoltar."
    texts[301], texts[302] = texts[1], texts[1] + "\n"  # copies
    texts[303] = texts[2] + " " + passage + " " + prose(80)
    texts[304] = prose(70) + "\n" + passage + "\n" + prose(80)
    texts[305] = prose(30) + " " + item
    texts[306] = prose(2000) + " " + item  # under a twentieth
    texts[307], texts[308], texts[309] = None, "", "short"
    rows = [(i, t, "en", "src", len(t or ""), i * 2) for i, t in texts.items()] + [(None, prose(50), None, None, None, None)]
    table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, score long", folder, "documents")
    table(spark, [(i, 1, int(i in toxic)) for i in range(250)], "doc_id long, quality int, toxic int", folder, "labels")
    table(spark, [(7, item), (8, None)], "item_id long, text string", folder, "benchmark")
    return folder, texts, toxic


def test_each_stage_on_its_input(spark, planted):
    folder, texts, toxic = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = toxicity.trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    before = docs.collect()
    for name, stage in pipe.STAGES:
        after = pipe.stored(stage(spark, docs, folder), "test")
        rows = after.collect()
        if name == "toxicity":
            want = sorted(str(r.doc_id) for r in before if scorer.score(r.text, 0.5)[0] < 0.5)
            assert sorted(str(r.doc_id) for r in rows) == want
            assert not toxic & {r.doc_id for r in rows}
        elif name == "simhash near-dedup":
            order = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
            label = groups([plain(r.text) for r in order])
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(order[i].doc_id) for i in sorted(set(label)))
            assert not {301, 302} & {r.doc_id for r in rows}
        elif name == "substring dedup":
            want = without_repeats([r.text for r in before], 35)
            got = {r.doc_id: r for r in rows}
            for r, (n, gone, kept) in zip(before, want):
                assert (got[r.doc_id].text or "").split() == kept.split()
                if not gone:
                    assert got[r.doc_id] == r
            assert len((got[304].text or "").split()) <= 150
        elif name == "benchmark decontamination":
            items = [(7, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 7").collect()]
            bad = {r.doc_id for r in before for n, h, _ in [hits_of(r.text, items)] if h and 20 * h >= n}
            assert bad == {305}
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} - bad
        else:
            want = {r.doc_id: r.text or "" for r in before}
            assert {r.doc_id: r.text for r in rows} == want
            assert all(list(r.ids) == PEER.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in rows)
            break
        assert after.columns == columns
        docs, before = after, rows
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, pipe.run(spark, folder).collect()), key=str)


def test_empty_documents(spark, planted, tmp_path):
    folder, *_ = planted
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is pipe.run
    assert [n for n, _ in pipe.STAGES][1] == "simhash near-dedup"
