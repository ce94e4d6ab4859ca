"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised directly from the vocabulary, without training: every
token becomes a piece whose characters stand for its bytes, scored by the
negative of its rank, with identity normalisation.  Merging the neighbours
with the best score is then merging the pair of least rank.  Text is cut by
the vocabulary's pattern, each match is encoded by itself, and decoding maps
ids to the bytes of their tokens.

Nulls and empty texts have no ids and decode to no bytes.  Repeated rows are
encoded each by themselves, an empty table gives an empty table, and columns
that are not named are not read.  A text of any length is encoded whole.
"""

import base64
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import by_batches

#: Bytes are written as the characters from this one on.
FIRST_CHARACTER = 256
BYTE_TO_CHARACTER = {i: FIRST_CHARACTER + i for i in range(256)}
#: Encoded pieces of text that a task remembers; a task that has met more begins anew.
REMEMBERED = 200_000
#: Bytes of text that a task handles at once.
BYTES_AT_ONCE = 1 << 19


def read_ranks(path):
    """Tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [tokens[rank] for rank in range(len(tokens))]


def as_characters(data):
    """Bytes, one character each."""
    return data.decode("latin-1").translate(BYTE_TO_CHARACTER)


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field, value):
    return _varint(field << 3) + _varint(value)


def _bytes(field, value):
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens):
    """A serialised sentencepiece model: message fields of the public model format.

    Model: 1 pieces, 2 trainer, 3 normaliser.  Piece: 1 text, 2 score, 3 kind
    (1 normal, 2 unknown).  Trainer: 3 type (2 is BPE), 4 size, 40-43 ids of
    the unknown, begin, end and padding pieces.  Normaliser: 1 name, 3 dummy
    prefix, 4 removal of white space, 5 its escaping.
    """
    def piece(text, score, kind):
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    none = (1 << 64) - 1  # -1 as a varint
    unknown = len(tokens)
    pieces = [piece(as_characters(token), -float(rank), 1) for rank, token in enumerate(tokens)]
    trainer = (_number(3, 2) + _number(4, unknown + 1) + _number(40, unknown)
               + _number(41, none) + _number(42, none) + _number(43, none))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + piece("<unk>", 0.0, 2) + _bytes(2, trainer) + _bytes(3, normaliser)


class Encoder:
    """Encodes texts in one task.

    Text between single spaces, with the space before it, is cut by the
    pattern as it would be within the whole text, so its ids are remembered.
    Where blanks follow one another that isn't so, and the text is cut whole.
    """

    def __init__(self, model, pattern, whole):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor()
        self.pieces.LoadFromSerializedProto(model)
        self.find = regex.compile(pattern).findall
        self.whole = whole  # tokens that merging alone doesn't reach, by their characters
        self.known = {}

    def encode_parts(self, parts):
        """Ids of each text, every match of the pattern by itself."""
        cut = [[as_characters(m.encode()) for m in self.find(p)] for p in parts]
        flat = list(chain.from_iterable(cut))
        ids = iter(self.pieces.encode(flat, num_threads=1))
        out = []
        for matches in cut:
            one = []
            for m in matches:
                found = next(ids)
                one += self.whole.get(m, found) if self.whole else found
            out.append(tuple(one))
        return out

    def parts(self, text):
        if "  " in text or text.endswith(" "):
            return [text]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def encode(self, texts):
        """Ids of each text."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [self.parts(t) if t else [] for t in texts]
        new = list(dict.fromkeys(p for parts in split for p in parts if p not in known))
        known.update(zip(new, self.encode_parts(new)))
        out = [np.array(list(chain.from_iterable(map(known.__getitem__, parts))), dtype=np.int32) for parts in split]
        for p in new:
            if len(p) > 64:  # long parts seldom come again
                del known[p]
        return out


def unreached(tokens, model):
    """Tokens that merging doesn't reach, by their characters: a match equal to one is that token all the same."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor()
    pieces.LoadFromSerializedProto(model)
    names = [as_characters(t) for t in tokens]
    return {n: [i] for i, (n, got) in enumerate(zip(names, pieces.encode(names, num_threads=1))) if got != [i]}


def _encoding(sent, pattern, names):
    """Arrow batches of the columns ``names`` but the last and a text become batches with ids in the text's place."""
    n = len(names) - 1

    def run(batches):
        encoder = Encoder(sent.value[0], pattern, sent.value[1])
        for batch in batches:
            texts = batch.column(n)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            start = 0
            while start < len(lengths):
                stop, size = start + 1, lengths[start]
                while stop < len(lengths) and size + lengths[stop] <= BYTES_AT_ONCE:
                    size += lengths[stop]
                    stop += 1
                found = encoder.encode(texts.slice(start, stop - start).to_pylist())
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                values = np.concatenate(found) if found else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns[:n], lists], names=names)
                start = stop

    return run


def _decoding(sent, names):
    """Arrow batches whose last column is ids get the bytes they stand for beside it."""
    def run(batches):
        table = sent.value
        for batch in batches:
            data = [b"".join(map(table.__getitem__, row)) if row else b"" for row in _rows(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, type=pa.binary())], names=names)

    return run


def _rows(lists):
    """Each list of an Arrow list column, as Python numbers, one row at a time."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    valid = lists.is_valid().to_pylist()
    for i, there in enumerate(valid):
        yield values[offsets[i]:offsets[i + 1]].tolist() if there else None


def _prepared(docs, tokens, pattern, text, keep, ids):
    model = model_bytes(tokens)
    sent = docs.sparkSession.sparkContext.broadcast((model, unreached(tokens, model)))
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [*(rows.schema[k] for k in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return rows, _encoding(sent, pattern, [*keep, ids]), fields


def encode(docs, tokens, pattern, text="text", keep=("doc_id",), ids="ids"):
    """The columns ``keep`` and ``ids``, an array of the token ids of the whole text.

    ``tokens`` (from ``read_ranks``) bounds what is broadcast: the vocabulary.
    """
    rows, encoding, fields = _prepared(docs, tokens, pattern, text, keep, ids)
    return by_batches(rows, encoding, T.StructType(fields))


def decode(encoded, tokens, ids="ids", keep=("doc_id",), decoded="decoded"):
    """The columns ``keep`` and ``ids`` and the bytes that the ids stand for; null ids give no bytes."""
    rows = encoded.select(*keep, ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(decoded, T.BinaryType())])
    return by_batches(rows, _decoding(encoded.sparkSession.sparkContext.broadcast(tokens), schema.names), schema)


def encode_and_decode(docs, path, pattern, text="text", keep=("doc_id",), ids="ids", decoded="decoded"):
    """Every whole text's ids and what they decode to: ``keep``, ``ids``, ``decoded``, in one pass."""
    tokens = read_ranks(path)
    rows, encoding, fields = _prepared(docs, tokens, pattern, text, keep, ids)
    schema = T.StructType([*fields, T.StructField(decoded, T.BinaryType())])
    decoding = _decoding(docs.sparkSession.sparkContext.broadcast(tokens), schema.names)
    return by_batches(rows, lambda batches: decoding(encoding(batches)), schema)
