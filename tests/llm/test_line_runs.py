import random
from collections import defaultdict

import pytest

from compare import check, connect
from folioscope.llm import line_runs as op
from folioscope.llm import queries

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, length=40, documents=5):
    at = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            at[key(line)].add(doc)
    owner = {k: max(-1 if d is None else d for d in docs) for k, docs in at.items() if len(k) >= length and len(docs) >= documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows_of(rng, n, width=40):
    common = ["Line Of %d " % i + "é" * rng.randint(width - 14, width) for i in range(30)] + ["\xa0" * width, "Ä" * width, "ä" * width, "x" * (width - 1)]
    rows = [(None, common[0]), (None, common[0] + "\n" + common[0].upper()), (3, None), (4, ""), (5, "\n\n"), (5, "\n\n")]
    for i in range(n):
        lines = [rng.choice([str(rng.random()) * 4, " " + rng.choice(common) + "\t\r", rng.choice(common).lower(), rng.choice(common[:3]), ""])
                 for _ in range(rng.randint(0, 8))]
        rows.append((rng.choice([i, i, i, 7, None]), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("batches, fanout", [(8, 4), (1, 2), (5, 2)])
def test_against_brute_force(spark, batches, fanout):
    rows = rows_of(random.Random(batches), 150)
    docs = spark.createDataFrame([(*r, "t", 5) for r in rows], "doc_id long, text string, gone string, n_lines int")
    left = op.without_repeated_lines(docs, batches=batches, fanout=fanout)
    order = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, left.collect()), key=order)
    assert got == sorted(brute(rows), key=order)
    assert sum(r[2] for r in got) > 50


def test_all_documents_of_one_id(spark):
    line = "the same long line in every row of a single document"
    docs = spark.createDataFrame([(1, line)] * 50 + [(2, line), (3, line), (4, line)], "doc_id int, text string")
    assert {r.n_dropped for r in op.without_repeated_lines(docs).collect()} == {0}  # four documents
    more = docs.unionByName(spark.createDataFrame([(0, f"a\n{line} ")], docs.schema))
    got = sorted((r.doc_id, r.n_dropped, r.kept) for r in op.without_repeated_lines(more).distinct().collect())
    assert got == [(0, 1, "a"), (1, 1, ""), (2, 1, ""), (3, 1, ""), (4, 0, line)]


def test_levels_are_compacted(spark):
    index = op.LineRuns(spark, fanout=2)
    rows = spark.createDataFrame([(d, k, k) for d in range(16) for k in range(20) if (d + k) % 3], "doc long, a long, b long")
    for high in range(16, 0, -2):
        fresh = index.add(rows.where(f"doc >= {high - 2} and doc < {high}")).where("owner is not null").count()
        assert fresh == (20 if high == 16 else 0)
    assert [len(level) for level in index.levels] == [0, 0, 0, 1]
    want = {k: (sum((d + k) % 3 > 0 for d in range(16)), max(d for d in range(16) if (d + k) % 3)) for k in range(20)}
    assert {r.a: (r.n, r.owner) for r in index.total().collect()} == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_empty_tables_and_long_lines(spark):
    long = "word " * 200_000
    docs = spark.createDataFrame([(i, f"{i}\n{long}\n{i}") for i in range(6)], "doc_id int, text string")
    assert op.without_repeated_lines(docs.limit(0)).count() == 0
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.kept)) for r in op.without_repeated_lines(docs).collect()}
    assert got == {i: (3, 1, 3) if i < 5 else (3, 0, len(long) + 4) for i in range(6)}


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message = check(spark, connect(folder), folder, queries.op13_line_dedup, queries.OP13_SQL)
    assert ok, message
