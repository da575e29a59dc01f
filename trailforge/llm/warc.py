"""WARC archives: a writer of one gzip member per record, and a sequential reader.

Records follow WARC/1.1. A response record's block is an HTTP header and the
payload; a revisit record (profile identical-payload-digest) has the HTTP header
alone, which still gives the payload's length, and names the response it
repeats. Files are written by executors, each under a temporary name that is
renamed when complete, so a repeated task replaces its own file.

Defined results: a null payload is empty; of records with equal payloads of at
least ``revisit_bytes`` bytes those with the largest identifier are responses
(all of them, where rows repeat); null identifiers are written as such and are
never the largest unless all are null; ties don't occur otherwise. A damaged record, one that is cut short anywhere, or a file with fewer or more records than
were written makes the reader fail. An empty table gives no files and no records. A payload is held whole in memory by the task that writes or
reads its record, however long. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, open_fs, scratch, tables, tidily

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that doesn't agree with its own lengths or digests."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: {_sha1(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The unpacked members of a gzip file, one at a time, read chunk by chunk."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while data := rest or source.read(chunk):
        parts.append(z.decompress(data))  # a part may be empty: a member's first bytes give nothing yet
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if parts:
        raise WarcError("the last record is cut short")


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parse(data: bytes) -> dict:
    """One record: headers, block and payload, with lengths and digests verified."""
    if not data.startswith(b"WARC/"):
        raise WarcError("no WARC version line")
    head, sep, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    length = int(warc["content-length"])
    block = rest[:length]
    if not sep or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the record")
    if _sha1(block) != warc["warc-block-digest"]:
        raise WarcError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(_headers(http)["content-length"])
    revisit = warc["warc-type"] == "revisit"
    if not revisit and (len(payload) != told or _sha1(payload) != warc["warc-payload-digest"]):
        raise WarcError("payload digest differs")
    return {"warc": warc, "revisit": revisit, "payload": payload, "payload_bytes": told, "digest": base64.b32decode(warc["warc-payload-digest"][5:]).hex()}


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+|null)>", urn)
    if not found:
        raise WarcError(f"not a page: {urn}")
    return None if found[1] == "null" else int(found[1])


def plan_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", revisit_bytes: int = 1000) -> DataFrame:
    """Rows (id, url, payload, digest, first, revisit): which record each page becomes.

    The digest groups are combined on the map side before their shuffle, and
    only groups of at least two come to the join, so a payload that a third of
    the pages share is not gathered in one task (Spark splits a skewed join).
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")).alias("url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= revisit_bytes
    groups = rows.where(large).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(groups.withColumn("again", F.lit(True)), "digest", "left").withColumn("revisit", F.coalesce(F.col("again") & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))).drop("again")


def write_warc(plan: DataFrame, folder: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Write the planned records; returns (path, records, bytes), a row for each file."""

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = open_fs(folder)
        part, number, out, n, size, tmp, done = TaskContext.get().partitionId(), 0, None, 0, 0, "", []

        def close():
            nonlocal out, number
            if out is not None:
                out.close()
                name = f"part-{part:06d}-{number:04d}.warc.gz"
                fs.move(tmp, f"{root}/{name}")
                done.append((f"{folder}/{name}", n, size))
                out, number = None, number + 1

        for batch in batches:
            for page, url, payload, digest, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "first", "revisit")), strict=True):
                data = member(record(page, url, payload, digest, first, revisit))
                if out is not None and size + len(data) > max_bytes:
                    close()
                if out is None:
                    fs.create_dir(root, recursive=True)
                    tmp, n, size = f"{root}/_part-{part:06d}-{uuid.uuid4().hex}", 0, 0
                    out = fs.open_output_stream(tmp, compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    bound_batches(plan.sparkSession)
    return plan.select("id", "url", "payload", "digest", "first", "revisit").mapInArrow(tidily(write), "path string, records long, bytes long")


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Read archives (column path) record by record, verifying lengths and digests, and their number where files has a column records.

    Without payloads that column is null; the records are read and verified all the same.
    """

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.large_binary())])
        for batch in batches:
            for path, written in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                fs, where = open_fs(path)
                rows, held, n = [], 0, 0
                with fs.open_input_stream(where, compression=None) as source:
                    for data in members(source):
                        r, n = parse(data), n + 1
                        rows.append((_page(r["warc"]["warc-record-id"]), r["payload_bytes"], r["digest"], r["warc"]["warc-type"], _page(r["warc"]["warc-refers-to"]) if r["revisit"] else None, r["warc"]["warc-target-uri"], r["payload"] if payloads and not r["revisit"] else None))
                        held += len(r["payload"]) * payloads
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                if written is not None and n != written:
                    raise WarcError(f"{path} has {n} records, not {written}")

    told = F.col("records") if "records" in files.columns else F.lit(None).cast("long").alias("records")
    return files.select("path", told).mapInArrow(tidily(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def files_written(written: DataFrame) -> DataFrame:
    """Run the writer; its file names come back as a table dealt out one to a task."""
    spark = written.sparkSession
    path = scratch(spark, "files")
    written.write.parquet(path)
    files = spark.read.schema(written.schema).parquet(path)
    n = max(1, files.count())
    return files.repartition(min(n, 10_000), "path")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    plan = plan_revisits(tables(spark, sf_dir, "pages"))
    files = files_written(write_warc(plan, scratch(spark, "warc")))
    return read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
