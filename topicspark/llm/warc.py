"""WARC archives: written from pages, read back with segments reassembled and chunked transfer framing decoded."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, new_folder, scratch, small_batches, table

DATE = "2024-01-01T00:00:00Z"
#: Bytes of a record's block in one segment, of a chunk of the transfer framing, and of an archive before the next one.
SEGMENT, FRAME, ARCHIVE = 1 << 15, 1 << 13, 24 << 20
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
#: Bytes of an archive that the parser feeds to a member at once: what it looks at beyond a member's end is this much at most.
FEED = 1 << 12


def file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """Where tasks write archives: a folder of any scheme that pyarrow's file systems know (s3a:// is their s3://)."""
    return pa.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if folder.startswith("s3a://") else folder)


def chunked(payload: bytes) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for lo in range(0, len(payload), FRAME):
        part = payload[lo : lo + FRAME]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked body; framing that breaks off or doesn't parse is an error."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked framing breaks off")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk of another length than its size")
        out.append(framed[at : at + size])
        at += size + 2


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def records(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> Iterator[bytes]:
    """A page's records: one revisit, or a response, in segments where its block is longer than SEGMENT.

    A record's id is unique; the page's id is a field of its own, as is the page that a revisit refers to.
    """
    name = f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split()) or "about:blank"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    page = [] if page_id is None else [("WARC-Page-ID", str(page_id))]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n".encode()
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(refers_to)), kind]
        yield member([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *page, *fields, *more], http)
        return
    block = http + chunked(payload)
    if len(block) <= SEGMENT:
        yield member([("WARC-Type", "response"), ("WARC-Record-ID", name), *page, *fields, kind], block)
        return
    last = (len(block) - 1) // SEGMENT
    for k in range(last + 1):
        part = block[k * SEGMENT : (k + 1) * SEGMENT]
        if k == 0:
            yield member([("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Segment-Number", "1"), *page, *fields, kind], part)
        else:
            end = [("WARC-Segment-Total-Length", str(len(block)))] if k == last else []
            yield member([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k + 1)), *fields, *end], part)


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a WARC record per page into folder (.warc.gz archives); returns the archives' names (`archive`).

    Of pages with equal payloads (by SHA-1) of at least LEAST_REVISIT bytes, that with the largest page_id is a response and
    the others are revisits of it; rows that share that largest id are all responses, as are rows without an id. A null
    html is an empty payload. Every attempt of a task writes archives of its own names and only those of the attempts
    that Spark commits are returned, so a lost executor leaves no record twice.
    """
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    df = df.withColumn("digest", F.sha1("payload")).select("page_id", "url", "payload", "digest")
    # digests are grouped without their payloads; only payloads that may be revisits meet them, a hot one by a broadcast
    long = F.length("payload") >= LEAST_REVISIT
    last = df.filter(long).groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1")
    last = scratch(pages.sparkSession, last, "warc-digests")
    some = hot_join(df.filter(long), last, "digest", "n", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("last_id"), F.col("last_id")))
    none = df.filter(~long).withColumn("refers_to", F.lit(None).cast(pages.schema[page_id].dataType))
    df = some.select(none.columns).unionByName(none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, n = uuid.uuid4().hex, 0
        fs, path = file_system(folder)
        out, names = None, []
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                if out is None:
                    names.append(f"{attempt}-{n:05d}.warc.gz")
                    out, size, n = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0, n + 1
                p, u, payload, digest, refers = (x.as_py() for x in row)
                for data in records(p, u, payload, digest, refers):
                    out.write(data)
                    size += len(data)
                if size >= ARCHIVE:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string())], ["archive"])

    fs, path = file_system(folder)
    fs.create_dir(path)
    written = df.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string")
    return scratch(pages.sparkSession, written, "warc-archives")


RECORD = "record_id string, type string, origin string, segment int, total long, page_id string, url string, digest string, refers_to string, block binary"


def parsed(data: bytes) -> Iterator[dict]:
    """The records of an archive, member by member; no member looks further than FEED bytes past its end."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("an archive breaks off")
            fed = view[at : at + FEED]
            out.append(z.decompress(fed))
            at += len(fed) - len(z.unused_data)
        raw = b"".join(out)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        f = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(f["Content-Length"])]
        if len(block) != int(f["Content-Length"]):
            raise ValueError("a record breaks off")
        yield {
            "record_id": f["WARC-Record-ID"], "type": f["WARC-Type"], "origin": f.get("WARC-Segment-Origin-ID"), "segment": int(f["WARC-Segment-Number"]) if "WARC-Segment-Number" in f else None,
            "total": int(f["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in f else None, "page_id": f.get("WARC-Page-ID"), "url": f.get("WARC-Target-URI"),
            "digest": f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), "refers_to": f.get("WARC-Refers-To-Page"), "block": block,
        }


def read_warc(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """(page_id, url, type, digest, refers_to, payload) of the folder's .warc.gz archives (only those in archives, if given).

    Continuation records join the record they continue by its id, in the order of their segment numbers; a missing
    segment, or a total length that is not the segments' sum, is an error, as is a payload of another SHA-1 than its
    record says. Chunked transfer framing is decoded. A revisit's payload is null. A group is one record's segments.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.substring_index("path", "/", -1).alias("archive"), "content")
    if archives is not None:
        files = files.join(archives, "archive", "left_semi")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found, size = [], 0
                for r in parsed(content.as_py()):
                    found.append(r)
                    size += len(r["block"])
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(found, schema=fields)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=fields)

    fields = pa.schema([(k, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in RECORD.split(", "))])
    rows = scratch(spark, files.select("content").mapInArrow(parse, RECORD), "warc-records")  # each archive is parsed once
    whole = rows.filter("segment IS NULL").select("page_id", "url", "type", "digest", "refers_to", "block")
    pieces = rows.filter("segment IS NOT NULL").withColumn("whole_id", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = pieces.groupBy("whole_id").agg(
        *(first(c) for c in ("page_id", "url", "type", "digest", "refers_to")),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"),
        F.max("total").alias("total"),
    )
    block = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    right = (F.element_at("s", -1)["segment"] == F.size("s")) & (F.col("total") == F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"])))
    joined = joined.withColumn("block", F.when(right, block).otherwise(F.raise_error(F.lit("segments that don't make up their record"))))
    both = whole.unionByName(joined.select(whole.columns))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, digest, block in zip(batch.column(2), batch.column(3), batch.column(5), strict=True):
                head, _, body = block.as_py().partition(b"\r\n\r\n")
                payload = None
                if kind.as_py() == "response":
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if digest.as_py() and hashlib.sha1(payload).hexdigest() != digest.as_py():
                        raise ValueError("a payload that isn't its digest's")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, type=pa.binary())], ["page_id", "url", "type", "digest", "refers_to", "payload"])

    return both.mapInArrow(decode, "page_id string, url string, type string, digest string, refers_to string, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 256)
    folder = new_folder(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    back = read_warc(spark, folder, write_warc(table(spark, sf_dir, "pages"), folder))
    back = back.select(F.col("page_id").cast("long"), F.length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast("long"))
    back = scratch(spark, back, "warc-read")
    # a revisit has its referred record's payload, and so its length
    named = back.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("n"))
    out = back.join(named, ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS d FROM pages
), m AS (SELECT d, max(page_id) AS last_id FROM p WHERE octet_length(b) >= 1000 GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND octet_length(b) >= 1000
"""
