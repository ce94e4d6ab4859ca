import itertools
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import line_crf as op
from folioscope.llm import queries


def counts(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    dup = sum(bool(line.strip("\t\n\x0b\x0c\r ")) and line in (text or "").split("\n")[:i] for i, line in enumerate((text or "").split("\n")))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t#é\xa0|\x1c"), max_size=60))
def test_base_counts(text):
    assert op.base_counts(text) == counts(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \n\t\r#é|\xa0\u3000\x85\x1c\u2028"), max_size=60))
def test_any_text_is_described(text):
    numbers, n_words, x = op.described(text)
    lines = text.split("\n")
    assert numbers == [i for i, line in enumerate(lines) if counts(line)[0]] and n_words == [counts(lines[i])[0] for i in numbers]
    assert x.shape == (len(numbers), op.FEATURES) and np.isfinite(x).all()


def test_lines_of_unicode_white_space(spark):
    blank = [f"{GOOD}{c}\n {c}{c} \n{GOOD}" for c in "\xa0\u3000\x85\x1c\u2028"] + ["\xa0"]
    rows = [(i, (GOOD if i % 2 else BAD) * 5 + "\xa0\n") for i in range(20)] + list(enumerate(blank, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = op.trained(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in op.judged(docs, chain).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all((got[i].n_words, got[i].word_chars) == counts(t)[:2] for i, t in rows)


def score(chain, x, labels):
    value = 0 if labels[0] else chain.prior
    value += sum(float(x[i] @ chain.w) for i in range(len(x)) if labels[i])
    return value + sum(chain.change[a, b] for a, b in itertools.pairwise(labels))


def test_decoding_and_marginals_against_all_labellings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        chain = op.Chain(rng.normal(size=op.FEATURES), rng.normal(size=(2, 2)), 0.7)
        x = rng.normal(size=(n, op.FEATURES))
        every = list(itertools.product((0, 1), repeat=n))
        values = [score(chain, x, y) for y in every]
        assert score(chain, x, chain.decode(x)) == max(values)
        chain.prior = 0.0
        values = np.array([score(chain, x, y) for y in every])
        lengths = np.array([n, 1])
        scores = np.zeros((2, n))
        scores[0] = x @ chain.w
        z, p, expected = op._marginals(scores, chain.change, lengths)
        chance = np.exp(values - np.logaddexp.reduce(values))
        assert np.allclose(z[0], np.logaddexp.reduce(values))
        assert np.allclose(p[0, :n], [sum(c for c, y in zip(chance, every) if y[i]) for i in range(n)])
        for a, b in every[:0] or itertools.product((0, 1), repeat=2):
            assert np.isclose(expected[a, b], sum(c * sum(q == (a, b) for q in itertools.pairwise(y)) for c, y in zip(chance, every)))


GOOD = "The small boat went out early this morning and came back with fish.\nNobody had seen it leave, they said at the harbour.\n"
BAD = "BUY!! NOW!! CLICK!! HERE!!\nHome | Login | Help | About | More | Cart\nfree free free free free free free free\n"


def test_edges(spark):
    rows = [(i, (GOOD if i % 2 else BAD) * 5 + f"Line {i}." + " again and on" * (i % 3)) for i in range(40)]
    rows += [(100, None), (101, ""), (101, " \n "), (None, GOOD * 2), (102, BAD + GOOD * 9 + "and so forth until the very end of it all"), (103, GOOD * 20_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, 1), (101, None), (None, 0), (1, 1)], "doc_id long, quality int")
    chain = op.trained(docs, labels)
    got = op.judged(docs, chain).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (100, 101):
            assert (r.n_words, r.boilerplate, r.content_share, r.kept) == (0, [], 1.0, False)
        elif r.doc_id is not None and r.doc_id < 40:
            assert (r.content_share >= 0.5) == bool(r.doc_id % 2)
        elif r.doc_id == 102:
            assert {0, 1, 2} <= set(r.boilerplate) and r.content_share > 0.8
    assert op.trained(docs, labels.where("quality = 1")) is None
    assert all(r.content_share == 1 for r in op.judged(docs, None).collect())
    assert op.judged(docs.limit(0), chain).count() == 0


def test_one_text_of_a_repeated_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i, GOOD if i % 2 else BAD) for i in range(10)] + [(1, f"{GOOD}{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(op, "fit", lambda texts, good, odds: seen.append((texts, good, odds)))
    op.trained(docs, labels)
    (texts, good, odds), = seen
    assert len(texts) == 10 and sum(good) == 5 and odds == 1


def test_query_counts_and_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, folder, "labels").collect()}
    right = 0
    for r in queries.op8_quality_lines(spark, folder).collect():
        want = counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
        right += labels.get(r.doc_id) == r.kept or (labels.get(r.doc_id) == 1 and r.base_failed)
    assert right > 0.95 * len(labels)
