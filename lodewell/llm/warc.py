"""Deterministic sharded WARC writer, and a reader of what it wrote.

Writing: payload digests are computed first; of records with equal payloads of `revisit_bytes` and more,
the one with the largest page_id is the response and the others are revisits of it. Only the few
revisits travel as marks beside the pages into one range shuffle by page_id; within a partition the
records are sorted, headers and digests are made anew, each record is a gzip member, and a file ends when
its compressed size reaches `roll_bytes`. A task writes to names of its own attempt and renames a
file once it is complete; a repeated task writes the same bytes over the same names. The manifest table
is written last and commits the archive; the reader opens only the files that it lists, streams them record by
record, and checks every digest.

Null html is an empty payload; null url is written as urn:page:<id>. Rows that repeat a page_id are
records of their own (all of them responses where it is the largest). An empty table gives an archive
without files and an empty reading. Dates are a parameter, so that equal input gives equal bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.plans.storage import scratch_path, small_batches


@dataclass(frozen=True)
class Writer:
    roll_bytes: int = 32 << 20
    task_bytes: int = 64 << 20
    revisit_bytes: int = 1000
    date: str = "2000-01-01T00:00:00Z"
    level: int = 6


_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "file string, first_page long, last_page long, records long, bytes long, sha1 string"


def _record_id(page_id: int | None, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{nth}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, nth: int, url: str | None, payload: bytes, keeper: int | None, w: Writer) -> bytes:
    """One WARC record, as a gzip member; with keeper, a revisit of that page's response."""
    http = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_CRLF}{_CRLF}".encode()
    block = http if keeper is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, nth)}",
        f"WARC-Date: {w.date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if keeper is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(keeper, 0)}", f"Refers-To-Page-ID: {keeper}"]
    raw = _CRLF.join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(w.level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the tasks open it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def write(pages: DataFrame, path: str | None = None, w: Writer = Writer()) -> str:
    """Write the archive; its place is returned once the manifest is there."""
    spark = pages.sparkSession
    small_batches(spark)
    path = path or scratch_path(spark, "warc")
    uri = _uri(spark, path)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    narrow = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n"))
    total = narrow.agg(F.sum("n"), F.count("*")).first()
    tasks = max(1, ceil((total[0] or 0) / w.task_bytes), min(spark.sparkContext.defaultParallelism, total[1] // 100))
    large = narrow.where(F.col("n") >= w.revisit_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").select("digest", "keeper")
    marks = large.join(groups, "digest").where("page_id is null or page_id != keeper").select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "keeper")
    records = rows.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("keeper"))
    laid = records.unionByName(marks).repartitionByRange(tasks, "page_id").sortWithinPartitions("page_id", "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = FileSystem.from_uri(uri)
        fs.create_dir(f"{root}/data", recursive=True)
        done, sink, tmp, parts, now, marked, nth = [], None, "", 0, None, {}, 0

        def close() -> None:
            nonlocal sink, parts
            sink.close()
            name = f"part-{task.partitionId():06d}-{parts:05d}.warc.gz"
            fs.move(tmp, f"{root}/data/{name}")
            done.append((name, state[0], state[1], state[2], state[3], state[4].hexdigest()))
            sink, parts = None, parts + 1

        state: list = []
        for batch in batches:
            for page_id, kind, url, html, digest, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (page_id,):
                    now, marked, nth = (page_id,), {}, 0
                if not kind:
                    marked[digest] = keeper
                    continue
                payload = html.encode()
                of = marked.get(hashlib.sha1(payload).hexdigest()) if marked else None
                data = record(page_id, nth, url, payload, of, w)
                nth += 1
                if sink is None:
                    tmp = f"{root}/data/.tmp-{task.partitionId()}-{parts}-{task.taskAttemptId()}"
                    sink, state[:] = fs.open_output_stream(tmp), [page_id, page_id, 0, 0, hashlib.sha1()]
                sink.write(data)
                state[1], state[2], state[3] = page_id, state[2] + 1, state[3] + len(data)
                state[4].update(data)
                if state[3] >= w.roll_bytes:
                    close()
        if sink is not None:
            close()
        columns = list(zip(*done, strict=True)) or [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    laid.select("page_id", "kind", "url", "html", "digest", "keeper").mapInArrow(run, _SCHEMA).write.parquet(f"{path}/manifest")
    return path


def members(source, size: int = 1 << 20, seen=lambda data: None) -> Iterator[bytes]:
    """The gzip members of an open file, one after the other; seen gets all its bytes."""
    rest = b""
    while True:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest:
                rest = source.read(size)
                seen(rest)
                if not rest:
                    if out:
                        raise ValueError("a record is cut short")
                    return
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of a record, the block by its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    names = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(names["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _sha1(block) != names["warc-block-digest"]:
        raise ValueError(f"record {names.get('warc-record-id')} is damaged")
    return names, block


def read(spark: SparkSession, path: str, w: Writer = Writer()) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record that the manifest commits."""
    manifest = spark.read.schema(_SCHEMA).parquet(f"{path}/manifest")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    size = manifest.agg(F.count("*"), F.sum("bytes")).first()
    if not size[0]:
        return spark.createDataFrame([], schema)
    uri, tasks = _uri(spark, path), max(1, ceil(size[1] / w.task_bytes), min(spark.sparkContext.defaultParallelism, size[0]))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def row(raw: bytes) -> tuple:
        head, block = parse(raw)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError("a payload differs from its digest")
        return int(head["page-id"]) if head["page-id"] else None, size, digest, head["warc-type"], int(head["refers-to-page-id"]) if "refers-to-page-id" in head else None, head["warc-target-uri"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(uri)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            rows.clear()
            return done

        for batch in batches:
            for name, sha1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = hashlib.sha1()
                with fs.open_input_stream(f"{root}/data/{name}", compression=None) as source:
                    for raw in members(source, seen=whole.update):
                        rows.append(row(raw))
                        if len(rows) >= 1024:
                            yield out()
                if whole.hexdigest() != sha1:
                    raise ValueError("a file differs from its manifest")
        yield out()

    return manifest.select("file", "sha1").repartitionByRange(tasks, "file").mapInArrow(run, schema)
