"""WARC archives: writing, a normaliser of monolithic gzip files, and reading by offset.

Some writers compress a whole archive as one gzip stream, which can only be
read from its start.  The normaliser inflates such a file once, as a stream,
writes every record as a gzip member of its own, and writes a sidecar index:
one JSON line a record with the offset and length of its member.  A reader then
takes any record alone.  One archive is one task, of which the size is bounded
by what ``write`` puts into a file; record bodies pass in pieces.

Files are written under a name of their own in the folder given, which must be
one that all executors see, and are known only by the rows that a finished
task returns.  A task that is repeated writes new files, so a lost executor
leaves nothing but unused ones.

Of records with equal payloads of ``least`` bytes or more, that with the
largest id is a response and the others are revisits of it; repeated rows of
that id are responses as well, and where no id is known all are.  A null
payload is an empty one.  Null addresses have no target header.  An empty table
gives no archives and no rows; columns that are not named are not read.
"""

import base64
import hashlib
import json
import re
import uuid
import zlib
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import functions as F

from folioscope.llm.shared import batches_of, by_batches, shared_folder, stored

#: Payloads of fewer bytes are always responses.
LEAST = 1000
#: Bytes of records, before compression, after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
PIECE = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
GZIP = 31  # window bits of zlib for a gzip member


def place(path):
    """The file system and the path within it, for any address that Arrow knows."""
    return files.FileSystem.from_uri(path)


@contextmanager
def output(path):
    """A stream to a file."""
    system, name = place(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, compression=None) as stream:
        yield stream


def record_id(page):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page, url, payload, digest, refers_to, date=DATE):
    """One record as bytes: the page's payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    name = record_id(page) if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_head(head):
    """Fields of a record's head, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


class Inflated:
    """The bytes of a gzip file, of one member or many, read once from its start."""

    def __init__(self, stream):
        self.stream, self.held, self.raw = stream, bytearray(), b""
        self.inflate = zlib.decompressobj(GZIP)
        self.begun = self.ended = False

    def more(self):
        """Inflates a further piece; false at the end."""
        if self.ended:
            return False
        raw = self.raw or self.stream.read(PIECE)
        if not raw:
            if self.begun and not self.inflate.eof:
                raise ValueError("the gzip stream is cut off")
            self.ended = True
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(GZIP)
        self.begun = True
        self.held += self.inflate.decompress(raw, PIECE)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark):
        """Bytes up to a mark and past it; None at the end of the file."""
        at = 0
        while True:
            found = self.held.find(mark, at)
            if found >= 0:
                return self.take(found + len(mark))
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record's head")
                return None

    def take(self, n):
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def pieces(self, n):
        """The next n bytes, piece by piece."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            if self.held:
                piece = self.take(min(n, PIECE))
                n -= len(piece)
                yield piece


def normalise(source, target, index):
    """Rewrites one archive with a member for each record and a sidecar index; returns records and bytes written."""
    system, name = place(source)
    offset = count = 0
    with system.open_input_stream(name, compression=None) as stream, output(target) as out, output(index) as lines:
        inflated = Inflated(stream)
        while True:
            head = inflated.until(b"\r\n\r\n")
            if head is None:
                break
            head = head.lstrip(b"\r\n")
            fields = parse_head(head)
            deflate = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            size = out_size = 0
            for piece in (head, *inflated.pieces(int(fields["content-length"]) + 4)):
                data = deflate.compress(piece)
                out.write(data)
                out_size += len(data)
                size += len(piece)
            data = deflate.flush()
            out.write(data)
            out_size += len(data)
            line = {"offset": offset, "length": out_size, "bytes": size, "type": fields.get("warc-type"),
                    "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri")}
            lines.write(json.dumps(line).encode() + b"\n")
            offset += out_size
            count += 1
    return count, offset


def read_record(member):
    """(page, url, bytes and digest of the full payload, kind, page it refers to, payload) of a member; a response's payload is checked."""
    data = zlib.decompress(member, GZIP)
    end = data.index(b"\r\n\r\n") + 4
    fields = parse_head(data[:end])
    body = data[end:end + int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
    return (int(page) if page else None, fields.get("warc-target-uri"), length, digest, kind,
            int(refers) if refers else None, payload if kind == "response" else None)


def classified(pages, page="page_id", url="url", html="html", least=LEAST):
    """page, url, payload, digest, and ``refers_to``: the page whose record a revisit points to, null for responses.

    Copies are counted by digest before anything is joined, and only digests
    that come again are, so a payload that many pages share is one row there.
    """
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.max("page").alias("largest"), F.count("*").alias("n")).where("n > 1").select("digest", "largest")
    first = stored(first, "copies")  # so that the pages of one payload can be split where this is joined
    return rows.join(first, "digest", "left").select(
        "page", "url", "payload", "digest",
        F.when(~F.col("page").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def write(records, folder, archive_bytes=ARCHIVE_BYTES):
    """Writes records as monolithic gzip archives, one stream a file; a row (path, records) for each file."""
    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        made = []
        row = next(rows, None)
        while row is not None:
            path, count, size = f"{folder}/monolithic/{uuid.uuid4().hex}.warc.gz", 0, 0
            with output(path) as out:
                deflate = zlib.compressobj(1, zlib.DEFLATED, GZIP)
                while row is not None and size < archive_bytes:
                    data = record(*row)
                    out.write(deflate.compress(data))
                    size += len(data)
                    count += 1
                    row = next(rows, None)
                out.write(deflate.flush())
            made.append((path, count))
        yield from batches_of(made, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return by_batches(records.select("page", "url", "payload", "digest", "refers_to"), run, "path string, records long")


def each_apart(archives):
    """One row a task, since a row is an archive."""
    return archives.repartition(max(1, archives.count()))


def normalised(archives, folder):
    """Normalises archives (``path``), a task each; a row (path, index, records, bytes) for each."""
    def run(batches):
        def made():
            for batch in batches:
                for source in batch.column(0).to_pylist():
                    target = f"{folder}/members/{uuid.uuid4().hex}.warc.gz"
                    index = f"{target}.idx"
                    yield (target, index, *normalise(source, target, index))
        kinds = [("path", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]
        yield from batches_of(made(), pa.schema(kinds), 1)

    return each_apart(archives.select("path")).mapInArrow(run, "path string, index string, records long, bytes long")


def read(archives):
    """All records of normalised archives (``path``, ``index``), each taken by its offset.

    page, url, payload_bytes, digest, kind, refers_to, payload (null for revisits).
    """
    names = ["page", "url", "payload_bytes", "digest", "kind", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        def found():
            for batch in batches:
                for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    system, name = place(path)
                    _, lines = place(index)
                    with system.open_input_file(name) as archive, system.open_input_stream(lines, compression=None) as entries:
                        rest = b""
                        while piece := entries.read(PIECE):
                            *whole, rest = (rest + piece).split(b"\n")
                            for line in whole:
                                entry = json.loads(line)
                                yield read_record(archive.read_at(entry["length"], entry["offset"]))
        yield from batches_of(found(), pa.schema(list(zip(names, kinds))), 256)

    return each_apart(archives.select("path", "index")).mapInArrow(
        run, "page long, url string, payload_bytes long, digest string, kind string, refers_to long, payload binary")


def archived(pages, page="page_id", url="url", html="html", least=LEAST, folder=None, archive_bytes=ARCHIVE_BYTES):
    """Writes pages as archives, normalises these and reads them back."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    written = stored(write(classified(pages, page, url, html, least), folder, archive_bytes), "monolithic")
    return read(stored(normalised(written, folder), "members"))
