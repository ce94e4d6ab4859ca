import random

from compare import check, connect
from folioscope.llm import chat as op
from folioscope.llm import queries


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, set()).add((turn, role, text))
    # turn numbers may differ between logs, their order counts; ties don't occur here
    listed = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in convs.items()}

    def before(a, b):  # nulls never come first among equals
        return b is None or a is not None and a < b
    kept = {}
    for c, v in listed.items():
        if not any(d != c and w[:len(v)] == v and (len(w) > len(v) or before(d, c)) for d, w in listed.items()):
            kept[c] = v
    return kept


def test_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for conv in list(range(120)) + [None]:
        start = rng.choice([0, 0, 5])
        n = rng.randint(1, 6)
        said = [(rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None])) for _ in range(n)] if conv is not None and conv % 3 else [
            ("user" if i % 2 == 0 else "assistant", "hello" * (i + 1)) for i in range(n)]
        rows += [(conv, start + i * 2 if i or conv != 7 else None, r, t) for i, (r, t) in enumerate(said)]
    rows += rows[:5]
    turns = spark.createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, chat string, place int")
    got = {r.conv: r for r in op.formatted(turns).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for c, v in want.items():
        assert got[c].n_turns == len(v)
        assert got[c].chat == "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in v)
    assert op.formatted(turns.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(20_000)] + [(2, i, "user", f"t{i}") for i in range(15_000)]
    got = op.formatted(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert [(r.conv, r.n_turns) for r in got] == [(1, 20_000)]


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message = check(spark, connect(folder), folder, queries.op1_chat, queries.OP1_SQL)
    assert ok, message
