import gzip
import hashlib
import json
import uuid

import pytest

from compare import check, connect
from folioscope.llm import queries
from folioscope.llm import warc as op

LONG = "é" * 600


def rows():
    return [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (7, None, LONG), (3, "http://b/ x\r\ny", "short"), (4, "u", "short"), (5, "u", None),
            (6, "u", ""), (None, "u", LONG), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "\r\n\r\nWARC/1.0\r\n" * 90),
            (11, "u", "z" * 5_000_000), (7, None, LONG)]


def want(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        other = len(data) >= 1000 and same and page != max(same)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", max(same) if other else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [op.ARCHIVE_BYTES, 3000])
def test_round_trip(spark, archive_bytes):
    pages = spark.createDataFrame([(*r, "k") for r in rows()], "page_id long, url string, html string, digest string")
    back = op.archived(pages, archive_bytes=archive_bytes).collect()
    assert sorted(((r.page, r.payload_bytes, r.digest, r.kind, r.refers_to) for r in back), key=str) == want(rows())
    bodies = {r.page: r.payload for r in back if r.kind == "response"}
    assert bodies[10].decode() == rows()[10][2] and bodies[11] == b"z" * 5_000_000
    assert op.archived(pages.limit(0)).count() == 0


def test_members_and_index(tmp_path):
    records = [op.record(i, f"http://a/{i}", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None) for i in range(40)]
    source, target, index = (str(tmp_path / n) for n in ("in.gz", "out.gz", "out.idx"))
    body = b"".join(records)
    # one stream, and one of several members cut anywhere
    for data in (gzip.compress(body), gzip.compress(body[:777]) + gzip.compress(body[777:])):
        open(source, "wb").write(data)
        assert op.normalise(source, target, index)[0] == 40
        out = open(target, "rb").read()
        lines = [json.loads(x) for x in open(index)]
        assert [gzip.decompress(out[x["offset"]:x["offset"] + x["length"]]) for x in lines] == records
        assert gzip.decompress(out) == body
        assert [x["uri"] for x in lines] == [f"http://a/{i}" for i in range(40)]


def test_damage_is_told(tmp_path):
    body = op.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    paths = [str(tmp_path / n) for n in ("in.gz", "out.gz", "out.idx")]
    for data in (gzip.compress(body)[:-12], gzip.compress(body[:-8]), gzip.compress(b"nonsense\r\n\r\n")):
        open(paths[0], "wb").write(data)
        with pytest.raises(ValueError):
            op.normalise(*paths)
    wrong = op.record(1, "u", b"abd", hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(ValueError):
        op.read_record(gzip.compress(wrong))


def test_record_ids_are_uuids():
    uuid.UUID(op.record_id(5)[10:-1])


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message = check(spark, connect(folder), folder, queries.op9_warc, queries.OP9_SQL)
    assert ok, message
