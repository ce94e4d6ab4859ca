import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENS = bpe.read_ranks(PATH)
MODEL = bpe.model_bytes(TOKENS)
ENCODER = bpe.Encoder(MODEL, public_tokenizers.PATTERN, bpe.unreached(TOKENS, MODEL))
PEER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t ab's1é漢🎉.,!▁"), max_size=40) | st.text(max_size=60))
def test_same_ids_as_the_peer(text):
    text = text.encode("utf-8", "replace").decode()
    assert ENCODER.encode([text])[0].tolist() == PEER.encode_ordinary(text)


def test_every_token_is_reached():
    whole = bpe.unreached(TOKENS, MODEL)
    for i, token in enumerate(TOKENS):
        assert whole.get(bpe.as_characters(token), [i]) == [i]


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "word " * 40000, "w"), (3, "a  b \n\n c", "v"), (3, "a  b \n\n c", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, len(r.ids), bytes(r.decoded)) for r in bpe.encode_and_decode(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {(d, len(PEER.encode_ordinary(t or "")), (t or "").encode()) for d, t, _ in rows}
    apart = bpe.decode(bpe.encode(docs, TOKENS, public_tokenizers.PATTERN), TOKENS)
    assert {(r.doc_id, len(r.ids), bytes(r.decoded)) for r in apart.collect()} == got
    no_ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r.decoded) for r in bpe.decode(no_ids, TOKENS).collect()} == {b""}
    assert bpe.encode_and_decode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_peer(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents").collect()
    want = set()
    for d in docs:
        ids = PEER.encode_ordinary(d.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.add((d.doc_id, len(ids), digest, hashlib.sha256((d.text or "").encode()).hexdigest()))
    got = {tuple(r) for r in queries.op4_byte_bpe(spark, folder).collect()}
    assert got == want


def test_rank_file_with_gaps(tmp_path):
    (tmp_path / "x").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(tmp_path / "x")
