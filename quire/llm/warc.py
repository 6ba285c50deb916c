"""Deterministic sharded WARC writer and reader.

Rows are sorted by page id inside ranges whose bounds come from the ids alone, so that names and contents of the
files do not depend on the cluster. A file is rolled when its compressed size passes ROLL_BYTES. Headers and digests
are made anew; a payload equal to that of a smaller page id is a revisit. A range is a task of its own. Each attempt
of a task writes under temporary names of its own; Spark's commit of a first manifest says which attempt counts, its
files are then given their final names, and the manifest, written last, lists them. So a task or a renaming that runs
twice, or an executor that is lost, leaves neither half files nor two of one name.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, range_bounds, range_number, shared_folder

ROLL_BYTES = 64 << 20
ROWS_PER_SHARD = 5_000
#: Payloads shorter than this are never revisits.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, compressed_bytes long, sha256 string"
_NAMES = [c.split()[0] for c in MANIFEST.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _files(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    target = quote(url or "urn:page:none", safe="!#$%&'()*+,/:;=?@[]~-._")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(first)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shard:
    """One output file at a time of a shard."""

    def __init__(self, uri: str, shard: int, attempt: str, roll: int):
        self.fs, self.root = _files(uri)
        self.shard, self.attempt, self.roll, self.number = shard, attempt, roll, 0
        self.stream = None

    def write(self, record: bytes) -> Iterator[tuple]:
        if self.stream is None:
            self.name = f".shard-{self.shard:06d}-{self.number:04d}.warc.gz.{self.attempt}.tmp"
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.records = self.size = 0
            self.digest = hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.stream.write(member)
        self.digest.update(member)
        self.records, self.size = self.records + 1, self.size + len(member)
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.stream.close()
        self.stream = None
        self.number += 1
        return self.name, self.shard, self.records, self.size, self.digest.hexdigest()


def write(pages: DataFrame, uri: str, rows_per_shard: int = ROWS_PER_SHARD, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into files under uri; returns the manifest, read back.

    Null html is an empty payload; a null url gets a placeholder; a null page_id never is the first of its payload while
    another row has an id. Of repeated rows with one page_id the first is the response, the others revisit it. An
    empty table writes an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    fs, root = _files(uri)
    fs.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    ids = rows.where(F.octet_length("payload") >= LEAST_BYTES).select("page_id", "digest")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = ids.join(firsts, "digest").groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    bounds = range_bounds(pages.select(F.col("page_id").cast("long").alias("page_id")), "page_id", rows_per_shard)
    both = again.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first")
    both = both.unionByName(rows.withColumn("first", F.lit(None).cast("long")))
    both = both.withColumn("shard", range_number("page_id", bounds).cast("int"))
    both = both.repartitionById(len(bounds), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.isnotnull("payload"), "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{uuid.uuid4().hex[:12]}-{context.taskAttemptId() if context else 0}"
        out: _Shard | None = None
        done: list[tuple] = []
        page, first, written = object(), {}, set()
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, known, shard = (batch.column(c)[k].as_py() for c in range(6))
                if page_id != page:
                    page, first, written = page_id, {}, set()
                if payload is None:
                    first[digest] = known
                    continue
                if out is None or shard != out.shard:
                    done += [out.close()] if out is not None and out.stream else []
                    out = _Shard(uri, shard, attempt, roll_bytes)
                target = first.get(digest)
                revisit = digest in first and target is not None and (target != page_id or digest in written)
                written.add(digest)
                done += out.write(_record("revisit" if revisit else "response", page_id, url, payload, digest, target))
        done += [out.close()] if out is not None and out.stream else []
        columns = list(zip(*done)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], _NAMES)

    both.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{uri}/attempts")
    named = spark.read.schema(MANIFEST).parquet(f"{uri}/attempts").mapInArrow(_final_names(uri), MANIFEST)
    named.write.mode("overwrite").parquet(f"{uri}/manifest")
    for left in fs.get_file_info(FileSelector(root)):  # of attempts that did not count
        if left.base_name.endswith(".tmp"):
            fs.delete_file(left.path)
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def _final_names(uri: str):
    """Arrow function that gives the files of a manifest their final names; running it again changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(uri)
        for batch in batches:
            names = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                final = name[1 : name.index(".warc.gz") + len(".warc.gz")]
                own, there = fs.get_file_info([f"{root}/{name}", f"{root}/{final}"])
                if own.type == FileType.File:
                    if there.type == FileType.File:  # of an earlier call on this folder
                        fs.delete_file(there.path)
                    try:
                        fs.move(own.path, there.path)
                    except OSError:  # another attempt of this task was faster
                        there = fs.get_file_info(there.path)
                if own.type != FileType.File and there.size != size:
                    raise OSError(f"{final} is missing or not whole")
                names.append(final)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns[1:]], _NAMES)

    return run


_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest, packer, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            return
        parts.append(packer.decompress(data))
        rest = packer.unused_data
        if packer.eof:
            yield b"".join(parts)
            packer, parts = zlib.decompressobj(31), []


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(head + b"\r\n")}
    block = rest[: int(fields["content-length"])]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged block of {fields['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])
    return number(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind, number(fields.get("warc-refers-to"))


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """(RECORDS) of every record of the files in the manifest; block and payload digests are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(uri)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows: list[tuple] = []
                    for member in _members(stream):
                        rows.append(_parse(member))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return manifest.select("file").repartition("file").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, uri: str | None = None) -> DataFrame:
    """Write the archives (to a new shared folder unless uri is given) and return the records read back from them."""
    uri = uri or shared_folder(pages.sparkSession, "warc")
    return read(cut(write(pages, uri)), uri)
