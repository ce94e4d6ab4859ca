import math
from collections import Counter

import pytest

from compare import check, connect
from folioscope.llm import licenses as op
from folioscope.llm import queries

MIT = "Released under the MIT License."


def brute(rows, header=op.HEADER, whole=op.WHOLE):
    """Every line, run and file against every template, without leaving any out but by the rule for runs."""
    files = sorted({(p, t or "") for p, t in rows}, key=str)
    texts = [t or "" for _, t in rows]
    n = len(rows)
    counts = [Counter(op.words_of(t)) for _, t in op.TEMPLATES]
    vocab = {w for c in counts for w in c}
    idf = {w: math.log((n + 1) / (sum(w in op.words_of(t) for t in texts) + 1)) + 1 for w in vocab}
    weigh = lambda c: {w: (1 + math.log(k)) * idf.get(w, math.log(n + 1) + 1) for w, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [weigh(c) for c in counts]
    needed = set()
    for v in vectors:
        below = 0
        for w, x in sorted(v.items(), key=lambda i: (i[1] / norm(v), i[0])):
            below += (x / norm(v)) ** 2
            if below >= min(header, whole) ** 2:
                needed.add(w)

    def best(words):
        v = weigh(Counter(words))
        if not v:
            return 0, ""
        return min((-round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 9), name) for t, (name, _) in zip(vectors, op.TEMPLATES))
    own, dirs = {}, {}
    for path, text in files:
        found, run = [], []
        for line in [*text.split("\n"), ""]:
            words = op.words_of(line)
            found.append((*best(words), False))
            if needed & set(words):
                run.append(words)
                continue
            if len(run) > 1:
                found.append((*best(sum(run, [])), False))
            run = []
        found.append((*best(op.words_of(text)), True))
        name = (path or "").rpartition("/")[2].lower()
        is_name = name.split(".")[0] in ("license", "licence", "copying", "unlicense")
        rows_ = [(not (w and -s >= whole or is_name and -s >= header), s, lic) for s, lic, w in found if w and -s >= whole or (not w or is_name) and -s >= header]
        if rows_:
            other, s, lic = min(rows_)
            own[path, text] = ("header" if other else "file", lic, -s)
            if not other and path is not None:
                d = path.rpartition("/")[0]
                dirs[d] = min(dirs.get(d, (9, "")), (s, lic))
    out = []
    for path, text in rows:
        got = own.get((path, text or ""))
        if got:
            out.append((path, got[1], got[0], round(got[2], 6), None))
            continue
        at = path.rpartition("/")[0] if path is not None else None
        while at is not None and at not in dirs and at:
            at = at.rpartition("/")[0]
        out.append((path, dirs[at][1], "inherited", None, at) if at in dirs else (path, None, None, None, None))
    return sorted(out, key=str)


ROWS = [
    ("a/LICENSE", "Some project\n" + MIT + "\nCopyright someone"), ("a/x.py", "import x"), ("a/b/y.py", "print()"),
    ("a/b/z.py", "# Licensed under the Apache License, Version 2.0.\ncode here"), ("a/b/c/COPYING.txt", op.TEMPLATES[4][1]),
    ("a/b/c/d/e.c", "int main"), ("q/none.txt", "nothing to see"), ("top.txt", "words and words"), (None, MIT + " x"), (None, None), ("q/empty", ""),
    ("q/multi.c", "/* Licensed under the Apache License, Version 2.0 (the License);\n * you may not use this file except in compliance with the License.\n"
                  " * You may obtain a copy of the License at\n *  http://www.apache.org/licenses/LICENSE-2.0 */\nint f(void);" + "".join(f"\nint g{i}of(x{i});" for i in range(200))),
    ("a/x.py", "import x"), ("a/x.py", "another text of the path"), ("q/cc", "long prose before it " * 40 + "\nLicensed under CC BY-NC 4.0."),
    ("q/near", "This program is licensed to you under the GNU General Public License version 2"), ("deep/" * 30 + "f", "x"),
] + [(f"w/{i}.txt", f"the work of version {i} is this one") for i in range(30)]


def test_against_all_pairs(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "path string, text string, file int, license string")
    got = sorted(((r.path, r.license, r.via, r.score and round(r.score, 6), r.licence_dir) for r in op.scan(docs).collect()), key=str)
    assert got == brute(ROWS)
    assert ("a/b/c/d/e.c", "GPL-3.0", "inherited", None, "a/b/c") in got
    assert any(r[0] == "q/multi.c" and r[1:3] == ("Apache-2.0", "header") for r in got)
    assert op.scan(docs.limit(0)).count() == 0


def test_root_licence(spark):
    docs = spark.createDataFrame([("LICENSE", MIT), ("a/b.c", "x"), ("c.c", "y")], "path string, text string")
    got = {r.path: (r.license, r.via, r.licence_dir) for r in op.scan(docs).collect()}
    assert got == {"LICENSE": ("MIT", "file", None), "a/b.c": ("MIT", "inherited", ""), "c.c": ("MIT", "inherited", "")}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, folder):
    ok, message = check(spark, connect(folder), folder, queries.op5_licenses, queries.OP5_SQL)
    assert ok, message
