"""Deterministic sharded WARC writer and its reader.

Records are sorted by ranges of their id into shards. A shard's task writes one gzip member a record, rolls to a new
file once the compressed size is reached, under a temporary name of its attempt, and renames whole files; a file that an
earlier attempt put in place with the same bytes stays. Bounds of shards depend on the ids alone. The manifest
of all files is written last, by Spark's own committer; readers take only files that it lists. Names, headers and
digests depend on the records alone, so a task that runs twice writes the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, range_bounds, range_of

_SPACE = uuid.UUID("6f0a8d3c-52f5-4c63-9d2a-6b0c7a0e7c11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, url: str | None) -> str:
    """The same for the same page in every run."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}' if page_id is not None else f'url {url}')}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headed(lines: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Length", str(len(block)))])
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One compressed record, headers and digests made anew: a response, or a revisit of the page ``refers_to``."""
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url) if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        lines += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, None)), ("X-Refers-To-Page-ID", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _headed(lines, http + (payload if refers_to is None else b""))


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of pages whose payload (column payload, at least ``least_bytes``) a page of smaller id has too.

    Only ids and digests are shuffled, and the first page of a payload is found by a partial minimum.
    """
    small = pages.where(F.length("payload") >= least_bytes).select("page_id", "sha1")
    first = small.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return small.join(first, "sha1").where(F.coalesce(F.col("page_id") != F.col("refers_to"), F.lit(True))).select("page_id", "sha1", "refers_to").distinct()


MANIFEST = "shard int, roll int, file string, records long, bytes long, sha256 string, first_id long, last_id long"


def write_warc(
    pages: DataFrame, path: str, shards: int | None = None, roll_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Writes one record per row into ``path`` and gives the manifest: one row per file.

    ``path`` must be one that all executors reach (local, HDFS or an object store that Arrow knows). Equal payloads of
    at least ``least_bytes`` are one response, that of the smallest id, and revisits. A null payload is empty; a null
    id has no id header, sorts first and is a revisit if its payload has a page with an id; rows that share the
    smallest id are responses each. An empty table gives an empty manifest. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    # marks of revisits travel as rows before their pages, so that payloads are shuffled once
    nothing = F.lit(None)
    marks = revisits(rows, least_bytes).select("page_id", nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "sha1", "refers_to", F.lit(0).alias("kind"))
    both = rows.select("page_id", "url", "payload", "sha1", nothing.cast("long").alias("refers_to"), F.lit(1).alias("kind")).unionAll(marks)
    shards = shards or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lowest = F.coalesce("page_id", F.lit(-(1 << 63)).cast("long"))
    bounds = range_bounds(rows.select(lowest.alias("id")), min(shards, 4096))
    ordered = both.repartitionById(len(bounds) + 1, range_of(lowest, bounds).cast("int")).sortWithinPartitions("page_id", "kind", "url", "sha1")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        shard = TaskContext.get().partitionId()
        temporary = f"{root}/_temporary/{shard:05d}-{uuid.uuid4().hex}"
        done: list[tuple] = []
        state: dict = {}

        def opened():
            name = f"part-{shard:05d}-{len(done):05d}.warc.gz"
            fs.create_dir(temporary, recursive=True)
            info = _headed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            state.update(name=name, out=fs.open_output_stream(f"{temporary}/{name}", compression=None), bytes=0, records=0, sha=hashlib.sha256(), first=None)
            put(info)

        def put(member: bytes):
            state["out"].write(member)
            state["sha"].update(member)
            state["bytes"] += len(member)

        def same(target: str, size: int, digest: bytes) -> bool:
            if fs.get_file_info(target).size != size:
                return False
            with fs.open_input_stream(target, compression=None) as f:
                found = hashlib.sha256()
                while part := f.read(1 << 20):
                    found.update(part)
                return found.digest() == digest

        def closed():
            state["out"].close()
            made, target = f"{temporary}/{state['name']}", f"{root}/{state['name']}"
            # what an earlier attempt finished stays in its place
            if same(target, state["bytes"], state["sha"].digest()):
                fs.delete_file(made)
            else:
                fs.move(made, target)
            done.append((shard, len(done), state["name"], state["records"], state["bytes"], state["sha"].hexdigest(), state["first"], state["last"]))
            state.clear()

        page, firsts = object(), {}
        for batch in batches:
            for page_id, url, payload, sha1, refers_to, kind in zip(*batch.columns, strict=True):
                page_id, sha1 = page_id.as_py(), sha1.as_py()
                if page_id != page:
                    page, firsts = page_id, {}
                if not kind.as_py():
                    firsts[sha1] = refers_to.as_py()
                    continue
                if not state:
                    opened()
                put(build_record(page_id, url.as_py(), payload.as_py(), firsts.get(sha1), date))
                if not state["records"]:
                    state["first"] = page_id
                state["records"] += 1
                state["last"] = page_id
                if state["bytes"] >= roll_bytes:
                    closed()
        if state:
            closed()
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            fs.delete_dir(temporary)

    in_batches(ordered, write, MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a stream of gzip members."""
    unzip, buffer, more = zlib.decompressobj(31), bytearray(), True
    while more:
        raw = stream.read(1 << 20)
        more = bool(raw)
        while raw:
            buffer += unzip.decompress(raw)
            raw = unzip.unused_data
            if unzip.eof:
                yield _parsed(bytes(buffer))
                unzip, buffer = zlib.decompressobj(31), bytearray()
    if buffer:
        raise ValueError("the archive ends inside a record")


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{_digest(block)}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


#: The round trip's rows in DuckDB's SQL: base32 from five hex digits for four letters.
SQL = """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT x, min(page_id) AS page FROM d GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + (i // 4)::INT * 5, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest,
CASE WHEN page_id = page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> page THEN page END AS refers_to FROM d JOIN f USING (x)
"""

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(manifest: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """One row per page record of the files that the manifest lists; block digests, and responses' payload digests, are checked.

    payload_bytes is the length that the stored HTTP header gives, so revisits have that of the full payload; their
    payload is null.
    """
    spark = manifest.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, block in read_records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or _digest(payload) != digest):
                            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                        page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), fields["WARC-Target-URI"], length, digest, kind, first and int(first), payload if payloads and kind == "response" else None))
                        size += len(payload)
                        if size > 8 << 20 or len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return in_batches(manifest.select("file").repartition(parts, "file"), read, RECORD)
