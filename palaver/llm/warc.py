"""WARC archives: a writer with revisit records, and a splittable reader.

Written: one gzip member per record, so that a reader can begin anywhere. Of records with equal payloads of ``REVISIT_BYTES`` or more,
that with the largest page_id is the response and the others revisit it; only digests are compared across tasks. A task writes one file, under a
name of its own; the manifest, which Spark commits, lists the files that count.

Read: archives are cut into byte ranges. A task scans its range for gzip magic, takes a candidate for a member only if it decodes
to a WARC header, and owns the records that start inside the range; it reads the last one to its end, beyond the range if need
be. A payload that differs from its digest is an error.

Defined results: a very long payload is compressed and read as one record in its task; a null html is an empty payload; a null url gives no target; a null page_id is below all others; of repeated rows that share
the largest page_id each is a response; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, save, scratch

REVISIT_BYTES = 1000
#: Bytes of an archive that a task scans, and that it reads at a time.
RANGE, STEP = 8 << 20, 1 << 20
MAGIC, DATE = b"\x1f\x8b\x08", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _write(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, size, n = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs, at = filesystem(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                member = record(*row)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return run


def write(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write archives to the shared folder; returns the manifest: path, bytes, records."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    equal = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    # written, so that its size is known: small lists are broadcast, others joined with hot digests split
    equal = save(equal.where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "warc-equal")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = rows.join(equal, "digest", "left").select(
        "page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), "digest", "size", F.when(revisit, F.col("keeper")), revisit
    )
    return save(rows.mapInArrow(_write(scratch(pages.sparkSession, "warc")), "path string, bytes long, records long"), "warc-manifest")


class Member:
    """A gzip member that begins at ``at`` of an open file, decoded as far as it is asked for."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.next = file, at, at
        self.inflate, self.data = zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        self.file.seek(self.next)
        got = self.file.read(STEP)
        if not got:
            raise zlib.error("the member is cut off")
        self.data += self.inflate.decompress(got)
        self.next += len(got) - len(self.inflate.unused_data)
        return True

    def head(self) -> bytes | None:
        """The record's header, or None if this is no WARC record."""
        try:
            while (end := self.data.find(b"\r\n\r\n")) < 0 and bytes(self.data[:7]) in (b"WARC/1.", b"WARC/0.", b""):
                if not self.more():
                    return None
            return bytes(self.data[:end]) if end >= 0 and self.data[:5] == b"WARC/" else None
        except zlib.error:
            return None

    def body(self) -> bytes:
        while self.more():
            pass
        return bytes(self.data[self.data.find(b"\r\n\r\n") + 4 :])


def records(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of the records that start in [start, end) of an archive."""
    fs, at = filesystem(path)
    with fs.open_input_file(at) as file:
        place = start
        while place < end:
            file.seek(place)
            window = file.read(min(STEP, end - place) + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found < 0:
                place += STEP
                continue
            place += found
            if place >= end:
                return
            member = Member(file, place)
            head = member.head()
            if head is None:
                place += 1
                continue
            names = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            names = {k.lower(): v for k, v in names.items()}
            yield names, member.body()[: int(names["content-length"])]
            place = member.next


def _read(with_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                for names, block in records(path, start, end):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
                    digest = base64.b32decode(names["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = names["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a payload of {path} differs from its digest")
                    own, other = (re.search(r"page:(\d+|-\d+)>", names.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
                    rows.append((own and int(own[1]), names.get("warc-target-uri"), size, digest, kind, other and int(other[1]), payload if with_payload and kind == "response" else None))
                    held += len(payload) if with_payload else 0
                    if len(rows) >= 5000 or held > 32 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return run


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in SCHEMA.split(", ")])


def read(archives: DataFrame, with_payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The records of archives (path, bytes), read by byte ranges; payloads of responses unless not asked for."""
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + range_bytes).alias("end"))
    return ranges.repartition(max(1, ranges.count())).mapInArrow(_read(with_payload), SCHEMA)
