"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is three records: the response (or a revisit of an earlier equal payload), the request and a metadata
record, the latter two concurrent to the first. Each record is a gzip member of its own. Files are written and read
by Spark, so they may live in any store it reaches; an empty gzip member serves as the writer's line separator.

Captures are named by id and payload. Files are cut by bytes: a line of the writer stands for a megabyte at most, or for one
record with blank lines for its further megabytes, so a file holds about `file_mb` and one record.

Defined cases: null payloads are empty; equal payloads include empty ones (min_bytes=0); rows that repeat an id and its
payload are one capture, those that share an id alone are captures of their own; a row with a null id is a capture of its own,
a revisit where a page with an id has its payload; records without partners are still emitted with nulls; an empty table
gives no rows; extra columns are ignored. A null URL is written as about:blank.
"""

from __future__ import annotations

import atexit
import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remove, scratch_dir, small_batches, stage, table

EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
DATE = "2024-01-01T00:00:00Z"
RECORD = ("record_id string, type string, concurrent_to string, target_uri string, date string, refers_to string, content_type string, "
          "payload_digest string, payload_bytes long, payload binary, digest_ok boolean")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, rid: str, uri: str, block: bytes, content_type: str, *more: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more,
            ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def capture(own: str, page_id, uri: str | None, payload: bytes, keep) -> list[bytes]:
    """own: what names the capture of a null id; keep: the id whose record has the payload, None if this one has."""
    uri = "".join((uri or "about:blank").split()) or "about:blank"
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    digest, refers = f"sha1:{sha}", None if keep is None else f"urn:page:{keep}:{sha}"
    rid, http = f"urn:page:{own if page_id is None else page_id}:{sha}", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "application/http; msgtype=response"
    if refers is None:
        first = record("response", rid, uri, http + payload, kind, ("WARC-Payload-Digest", digest))
    else:
        first = record("revisit", rid, uri, http, kind, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", f"<{refers}>"),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    mine = ("WARC-Concurrent-To", f"<{rid}>")
    request = record("request", rid + ":request", uri, f"GET {uri} HTTP/1.1\r\n\r\n".encode(), "application/http; msgtype=request", mine)
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(payload)}\r\n".encode()
    return [first, request, record("metadata", rid + ":metadata", uri, fields, "application/warc-fields", mine)]


def choose(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """rows (id, u, p) with `keep`: the id whose record holds the payload, null where it is the row's own. Groups are found by
    SHA-256 and length, summed before any shuffle, written, and joined back by that key (one row a key)."""
    d = rows.select("*", F.unhex(F.sha2("p", 256)).alias("k"), F.octet_length("p").cast("long").alias("n"))
    sums = d.where(F.col("n") >= min_bytes).groupBy("k", "n").agg(F.max("id").alias("keep"), F.min("id").alias("least"), F.count("id").alias("named"), F.count(F.lit(1)).alias("rows"))
    groups = stage(sums.where("keep <> least or (named > 0 and named < rows)").select("k", "n", "keep"), "warc-groups")
    own = F.col("id").eqNullSafe(F.col("keep"))
    return d.join(groups.hint("merge"), ["k", "n"], "left").select("id", "u", "p", F.when(~own, F.col("keep")).alias("keep"))


MEGABYTE = 1 << 20


def write(df: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", min_bytes: int = 0, file_mb: int = 64) -> None:
    """The archives of df in the folder path; of equal payloads the largest id has the response."""
    small_batches(df.sparkSession, 1000)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = choose(df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("u"), payload.alias("p")), min_bytes)

    def run(batches):
        from pyspark import TaskContext

        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            out = []
            for i, u, p, keep in zip(*(c.to_pylist() for c in b.columns)):
                n += 1
                for r in capture(f"null-{task}-{n}", i, u, p, keep):
                    held.append(member(r))
                    size += len(held[-1])
                    if size >= MEGABYTE:
                        out += [b"".join(held), *[b""] * (size // MEGABYTE - 1)]
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)] if held else [], pa.binary())], names=["value"])

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_mb).text(path)


def parse(data: bytes):
    """(headers, block) of every record, by Content-Length."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        n = int(head.get("content-length", "0") or 0)
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row a record. payloads=False: the payload is digested and checked but not returned."""
    small_batches(spark, 1000)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                out = []
                rest = memoryview(content.as_buffer())
                for part in split(rest):
                    for head, block in parse(part):
                        out.append(row(head, block))
                        if len(out) == 500:
                            yield batch(out)
                            out = []
                yield batch(out)

    def split(view):
        at = 0
        if bytes(view[:2]) != b"\x1f\x8b":
            yield bytes(view)
            return
        while at < len(view):
            z, got = zlib.decompressobj(31), []
            while at < len(view) and not z.eof:
                piece = view[at : at + 4096]
                got.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
            out = b"".join(got)
            if out:
                yield out

    def row(head, block):
        strip = lambda k: head.get(k, "").strip("<>") or None
        kind = head.get("warc-type")
        payload, size, ok = block, len(block), True
        given = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            for line in http.split(b"\r\n")[1:]:
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":", 1)[1])
            if kind == "response":
                mine = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                ok, size = given in (None, mine) and size == len(payload), len(payload)
                given = mine
        keep = payload if payloads or kind == "metadata" else None
        return (strip("warc-record-id"), kind, strip("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-date"), strip("warc-refers-to"),
                head.get("content-type"), given, size, keep, ok)

    def batch(out):
        cols = list(zip(*out)) if out else [()] * 11
        kinds = [pa.string()] * 8 + [pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and metadata records concurrent to it.
    Captures are found by identifier alone, wherever their records lie."""
    cols = [F.col(c) for c in records.columns]
    key = F.coalesce("concurrent_to", "record_id")
    side = F.when(F.col("type").isin("response", "revisit"), F.lit("response")).otherwise(F.col("type"))
    return (records.where(F.col("type").isin("response", "revisit", "request", "metadata")).select(key.alias("capture_id"), side.alias("side"), F.struct(*cols).alias("r"))
            .groupBy("capture_id").agg(*[F.max(F.when(F.col("side") == s, F.col("r"))).alias(s) for s in ("request", "response", "metadata")]))


def op7_warc(spark, sf_dir):
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    atexit.register(remove, spark, path)
    c = assemble(read(spark, path, payloads=False))
    return c.select(
        F.regexp_extract(F.decode(F.col("metadata.payload"), "UTF-8"), r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.regexp_extract(F.col("response.refers_to"), r"^urn:page:(-?\d+):", 1).try_cast("long").alias("refers_to"),
        F.col("response.digest_ok").alias("digest_ok"))
