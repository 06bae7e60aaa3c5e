"""WARC archives: one gzip member per record, written by tasks and read back one record after another.

Writing: each task writes archives of its own below the shared folder and reports them in a manifest.
The manifest is stored, and only listed archives are read, so what a lost or repeated task left
behind is never seen. Records with equal payloads are kept once: the one with the smallest id is a
``response``, the others are ``revisit`` records that refer to it and hold no payload.

Reading: an archive is a stream of gzip members. It is inflated piece by piece; the WARC headers give
the block's length, and the digests of block and payload are computed on the way and compared. No
more than one piece and one record's headers are held, however long a record is; headers may have any length.

Defined results
    null payload          the empty payload
    null id               never the smallest of a group that has another id; comes back as null
    text id               written percent-encoded, so an id may hold any characters
    equal id and payload  all such rows are responses where their id is the smallest, else revisits
    damaged record        its ``status`` says what is wrong; reading goes on with the next gzip member, or
                          with the next archive where the member cannot be inflated to its end
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import SLICE_BYTES, stored
from tillwatch.session import work_path

ARCHIVE_BYTES = 64 << 20  # an archive that has grown beyond this is closed
PIECE = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_TEXT = "status string, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _location(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(uri, safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n")
    return head + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _urn(number: str | None) -> str:
    """The record id of a page: a null id has a name that no encoded id can have."""
    return "urn:page:" + ("%" if number is None else quote(number, safe=""))


def _id_of(urn: str, kind: str) -> Column:
    """The page id in a record id column."""
    own = F.substring(urn, 10, 1 << 30)
    return F.when(own != "%", F.try_url_decode(F.replace(own, F.lit("+"), F.lit("%2B"))).try_cast(kind))


def mark_copies(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(id, uri-less) rows with the payload and ``first``: the id that a copy refers to, null for responses.

    Only payloads that occur under several ids are looked up, so the pages themselves are shuffled
    only where those are many.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.withColumn("payload", payload).withColumn("digest", F.sha1("payload"))
    copies = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(
        F.min(id_col).alias("first"), F.max(id_col).alias("last"), F.count_if(F.col(id_col).isNull()).alias("nameless")
    )
    several = (F.col("first") < F.col("last")) | ((F.col("nameless") > 0) & F.col("first").isNotNull())
    copies = stored(copies.filter(several).select("digest", "first"), "warc-copies")
    own = rows.join(copies, "digest", "left").drop("digest")
    return own.withColumn("first", F.when(~F.col(id_col).eqNullSafe(F.col("first")), F.col("first")))


def write_archives(pages: DataFrame, target: str, id_col: str = "page_id", uri_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all rows below ``target`` (a folder that all executors reach); returns the stored manifest
    (path, records, bytes)."""
    named = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).alias("html"))
    rows = mark_copies(named, "id", "html", min_bytes)
    rows = rows.select(F.col("id").cast("string"), "uri", "payload", F.col("first").cast("string"))

    def write(batches):
        out, path, records, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            columns = (batch.column(i) for i in range(4))
            for number, uri, payload, first in zip(*columns):
                if out is None:
                    path = f"{target}/{uuid.uuid4().hex}.warc.gz"
                    system, local = _location(path)
                    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    out, records, size = system.open_output_stream(local, compression=None), 0, 0
                number, uri, payload, first = number.as_py(), uri.as_py(), payload.as_py(), first.as_py()
                member = record_bytes(
                    "response" if first is None else "revisit", _urn(number), uri or "", payload, base32_sha1(payload),
                    None if first is None else _urn(first),
                )
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


# --- reading -------------------------------------------------------------------------------


class _Member:
    """The inflated bytes of one gzip member, piece by piece."""

    def __init__(self, source, left: bytes):
        self.source, self.left, self.inflate = source, left, zlib.decompressobj(31)
        self.ready = b""

    def more(self) -> bool:
        """Get some inflated bytes ready; False at the member's end."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.left or self.source.read(PIECE)
            self.left = b""
            if not data:
                raise EOFError("truncated")
            got = self.inflate.decompress(data, PIECE)
            if got:
                self.ready += got
                return True
        return False

    def head(self) -> bytes:
        """Everything up to the empty line, which is passed over."""
        parts, last = [], b""
        while True:
            tail = last[-3:] + self.ready  # the empty line may begin in the piece before
            at = tail.find(b"\r\n\r\n")
            if at >= 0:
                break
            if self.ready:
                parts.append(self.ready)
                last = tail
            self.ready = b""
            if not self.more():
                raise ValueError("no header")
        whole = b"".join([*parts, self.ready])
        head, _, self.ready = whole.partition(b"\r\n\r\n")
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise EOFError("truncated")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def rest(self) -> bytes:
        """What is left of the member; of a long rest only the beginning."""
        kept = self.ready[:PIECE]
        self.ready = b""
        while self.more():
            kept, self.ready = (kept + self.ready)[:PIECE], b""
        return kept


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_records(source) -> Iterator[dict]:
    """The records of one archive in order. ``source`` has read(n)."""
    left = source.read(PIECE)
    while left:
        row = dict.fromkeys(("record_type", "record_id", "refers_to", "uri", "payload_bytes", "payload_digest"))
        member = _Member(source, left)
        try:
            fields = _fields(member.head())
            row |= {
                "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>"),
                "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                "uri": fields.get("warc-target-uri"),
            }
            whole, body = hashlib.sha1(), hashlib.sha1()
            length, head, read = int(fields["content-length"]), b"", None
            for piece in member.take(length):
                whole.update(piece)
                if read is None:  # still in the HTTP headers
                    head += piece
                    if b"\r\n\r\n" not in head:
                        continue
                    head, _, piece = head.partition(b"\r\n\r\n")
                    read = 0
                body.update(piece)
                read += len(piece)
            named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            block = base64.b32encode(whole.digest()).decode()
            good = fields.get("warc-block-digest", "").removeprefix("sha1:") == block
            if row["record_type"] == "response":
                row |= {"payload_bytes": read, "payload_digest": base64.b32encode(body.digest()).decode()}
                good &= row["payload_digest"] == named
            else:  # a revisit tells the length of the payload it stands for, but does not hold it
                row |= {"payload_bytes": int(_fields(head).get("content-length", 0)), "payload_digest": named}
            row["status"] = ("ok" if good else "digest") if member.rest() == b"\r\n\r\n" else "framing"
            yield row
        except EOFError:
            yield row | {"status": "truncated"}
            if not member.inflate.eof:  # else the member is whole, and only its record is short
                return
        except zlib.error:
            yield row | {"status": "damaged"}
            return
        except (ValueError, KeyError):
            yield row | {"status": "damaged"}
            try:
                member.rest()
            except (EOFError, zlib.error):
                return
        left = member.inflate.unused_data or source.read(PIECE)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives: status, record_type, record_id, refers_to, uri,
    payload_bytes, payload_digest."""
    names = [f.split()[0] for f in _TEXT.split(", ")]

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, local = _location(path)
                rows, size = [], 0
                with system.open_input_stream(local, compression=None) as source:
                    for row in read_records(source):
                        rows.append(row)
                        size += len(row["uri"] or "")
                        if len(rows) == 1000 or size > SLICE_BYTES:
                            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
    return manifest.select("path").mapInArrow(read, _TEXT)


def archive_pages(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0, target: str | None = None) -> DataFrame:
    """Write all rows as WARC records, read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, status."""
    kind = pages.schema[id_col].dataType
    manifest = write_archives(
        pages, target or work_path(pages.sparkSession, "warc"), id_col, uri_col, payload_col, min_bytes
    )
    return read_archives(manifest).select(
        _id_of("record_id", kind.simpleString()).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _id_of("refers_to", kind.simpleString()).alias("refers_to"), "status",
    )
