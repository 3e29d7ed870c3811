"""Operator 9: WARC archives with segmented records, and their reassembly.

Each record is a gzip member of its own. Members are written by Spark's own text writer, so that archives lie wherever Spark
can write: the last byte of a member is the highest of its four-byte length, which is zero below 16 MB, and the writer's line
separator supplies it. They are read back as binary files, again wherever Spark can read."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import spans, stash, stash_dir, trimmed

#: A block longer than that goes on in continuation records.
SEGMENT = 65_536
#: Bytes of a chunk of the transfer coding.
CHUNK = 8_192
#: Records in an archive at most, so that reading one takes bounded memory.
PER_FILE = 1_000
#: Payloads that occur more than once are broadcast up to so many, joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace (a fixed value)
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NS, row)}>"


def cuts(data: bytes, size: int) -> list[tuple[int, int]]:
    """Ranges of at most that many bytes; an empty one of no bytes."""
    return [(a, min(a + size, len(data))) for a in range(0, max(1, len(data)), size)]


def member(record: bytes) -> bytes:
    """A record, closed, as a gzip member without its last byte, which is zero."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(record) + z.compress(b"\r\n\r\n") + z.flush()
    if out[-1]:
        raise ValueError("a record of 16 MB or more")
    return out[:-1]


def members(archive: bytes, step: int = 65_536):
    """What each gzip member of an archive holds. It is fed in steps, as what a member leaves over is copied."""
    view, at = memoryview(archive), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("member isn't closed")
            out.append(z.decompress(view[at : at + step]))
            at += len(view[at : at + step]) - len(z.unused_data)
        yield b"".join(out)


def chunked(data: bytes) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (b - a, data[a:b]) for a, b in cuts(data, CHUNK) if b > a) + b"0\r\n\r\n"


def unchunk(data: bytes) -> bytes:
    """The body under chunked framing; ValueError where a size, a line end or the last chunk is missing."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            if not data[at:].endswith(b"\r\n"):
                raise ValueError("no end of trailers")
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk isn't closed")
        out.append(data[at : at + n])
        at += n + 2


def head(fields: dict) -> bytes:
    return ("WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in fields.items() if v is not None) + CRLF).encode()


def records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, row: str, origin: str | None = None):
    """The records of a page as bytes without their closing line ends: one, or one and its continuations. row names the
    record; origin, where it is known, the one that a revisit refers to."""
    own = {"WARC-Date": DATE, "WARC-Target-URI": (url or "urn:none").encode("ascii", "backslashreplace").decode().replace("\r", "%0D").replace("\n", "%0A"), "WARC-Page-ID": page, "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    kind = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(row)}
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        own |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(origin) if origin else None, "WARC-Refers-To-Date": DATE, "WARC-Refers-To-Page": refers_to}
        yield head(kind | own | {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    ranges = cuts(block, SEGMENT)
    for n, (a, b) in enumerate(ranges, 1):
        fields = kind | own | {"Content-Type": "application/http; msgtype=response", "WARC-Segment-Number": n if len(ranges) > 1 else None}
        if n > 1:
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(f"{row}#{n}"), "WARC-Date": own["WARC-Date"], "WARC-Target-URI": own["WARC-Target-URI"], "WARC-Segment-Origin-ID": kind["WARC-Record-ID"], "WARC-Segment-Number": n}
        if n == len(ranges) > 1:
            fields["WARC-Segment-Total-Length"] = len(block)
        yield head(fields | {"Content-Length": b - a}) + block[a:b]


def parse(archive: bytes):
    """(fields, block) of each record, by the stated lengths."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError("not a record")
        fields = dict(x.split(": ", 1) for x in lines)
        at = end + 4 + int(fields["Content-Length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record isn't closed")
        yield fields, archive[end + 4 : at]
        at += 4


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (segment number, total length where stated, bytes), in any order. ValueError if a number is missing or
    repeated, no length is stated or it doesn't match."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[2] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] != len(block):
        raise ValueError("segments don't add up")
    return block


def write(pages: DataFrame, path: str, at_least: int = 0) -> None:
    """Writes archives of pages (page_id, url, html) under path, a gzip member for each record.

    Of rows with equal payloads of at least that many bytes, those with the smallest page_id are responses, the others
    revisits of it; a null id comes after all others, and with no other id all are responses. Rows that repeat an id and
    a payload are alike, each with a record of its own; as none of them is the one that a revisit could name, it names
    their page only. A null html is an empty payload, a null URL has a placeholder. Other columns play no part, and an empty
    table gives no records."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html")).withColumn("sha", F.sha1("html"))
    same = rows.filter(F.octet_length("html") >= at_least).groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    first = same.groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("n").alias("n"), F.max(F.col("n")).alias("most")).filter("n > 1").drop("n")
    first = stash(first, "warc-first")
    few = first.count() <= BROADCAST_ROWS  # of about 70 bytes each
    known = rows.join(F.broadcast(first) if few else first, "sha", "left").select("page_id", "url", "html", "sha", "first", "most")

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for whole in batches:
            for begin, size in spans([whole.column(2)], whole.num_rows):
                out = []
                for page, url, html, sha, origin, most in zip(*(c.to_pylist() for c in whole.slice(begin, size).columns)):
                    revisit = origin is not None and origin != page
                    n += 1
                    alone = page is not None and most in (None, 1)  # then its page and payload name it
                    row = f"{path}/{page}/{sha}" if alone else f"{path}/{page}/{sha}/{task}/{n}"
                    out += map(member, records(page, url, html, origin if revisit else None, revisit, row, f"{path}/{origin}/{sha}" if most == 1 else None))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = known.mapInArrow(trimmed(run), "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", PER_FILE).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_digest) of the pages in the archives under path.

    Records that are whole are decoded where they are read; segments, read in a pass of their own, are grouped by the id of
    their origin, ordered by number, joined and checked against the stated total. Chunked framing is undone and the payload
    checked against its digest; what doesn't add up is an error. A revisit's payload is null here; its digest is as stated.
    An empty folder gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    whole_type = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string"

    def number(f, k):
        return int(f[k]) if k in f else None

    def page(f, block):
        """The row of a record that is complete."""
        stated = f["WARC-Payload-Digest"].removeprefix("sha1:")
        body = None
        if f["WARC-Type"] != "revisit":
            http, body = block.split(b"\r\n\r\n", 1)
            body = unchunk(body) if b"transfer-encoding: chunked" in http.lower() else body
            if digest(body) != stated:
                raise ValueError("payload doesn't match its digest")
        return number(f, "WARC-Page-ID"), f["WARC-Target-URI"], f["WARC-Type"], number(f, "WARC-Refers-To-Page"), body, stated

    def batch(rows, names, kinds):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def complete(batches):
        for b in batches:
            for raw in b.column(0):
                yield batch([page(f, block) for r in members(raw.as_py()) for f, block in parse(r) if "WARC-Segment-Number" not in f], names, kinds)

    def segments(batches):
        for b in batches:
            for raw in b.column(0):
                rows = [(f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), number(f, "WARC-Segment-Number"), number(f, "WARC-Segment-Total-Length"), json.dumps(f), block) for r in members(raw.as_py()) for f, block in parse(r) if "WARC-Segment-Number" in f]
                yield batch(rows, ["origin", "number", "total", "fields", "block"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()])

    def unite(batches):
        for b in batches:
            rows = []
            for parts in b.column(0).to_pylist():
                block = join_segments([(s["number"], s["total"], s["block"]) for s in parts])
                rows.append(page(json.loads(next(s["fields"] for s in parts if s["number"] == 1)), block))
            yield batch(rows, names, kinds)

    cut = files.mapInArrow(segments, "origin string, number long, total long, fields string, block binary")
    cut = cut.groupBy("origin").agg(F.collect_list(F.struct("number", "total", "fields", "block")).alias("parts")).select("parts")
    return files.mapInArrow(complete, whole_type).union(cut.mapInArrow(unite, whole_type))


def fresh_folder(spark: SparkSession) -> str:
    return f"{stash_dir(spark)}/warc-{uuid.uuid4().hex}"
