"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page id and cut into shards at bounds that depend on the rows alone. Each shard is one task: it writes gzip
members, one a record, starts a new file when the compressed size reaches ``roll_bytes``, builds all headers and digests anew, and
writes under a temporary name that it renames when the file is whole. The same rows give the same bytes, so a task that runs twice
replaces a file by itself. The manifest, a Parquet table of files, records and checksums, is committed last; readers open only what
it lists, so leftovers of lost tasks are never read.

Of pages with equal payloads of ``revisit_from`` bytes or more, the one with the largest id is a response record; the others are
revisit records that name it (``WARC-Refers-To`` and its target URI and date) and carry no payload.

Defined results: null html is an empty payload; null urls are empty; rows that repeat an id with the same payload are records of the
same kind, each with a record id of its own; a null id is kept and sorts first; an id or null that many rows share is cut into several
shards by payload; a payload of any length is one record; an empty table gives an empty manifest; other input columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetika.llm.skew import hot_join, range_bounds, range_of
from kinetika.session import materialize, new_folder, text_batches

WARC_DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
SHARD_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f1c1f0e-8f2b-5b57-9a06-3f7f2f0c9d11")
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, url: str, digest: str, occurrence: int = 0) -> str:
    """The id of the record of a page; rows equal in all three are told apart by their ``occurrence``."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page} {occurrence} {digest} {url}')}>"


def _uri(url: str) -> str:
    return "".join(c for c in url if c >= " ")


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _http(payload_length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode()


def page_record(page: int | None, url: str, payload: bytes, digest: str, response: tuple[int, str] | None = None, occurrence: int = 0, level: int = 6) -> bytes:
    """The gzip member of one page; ``response``: the page and url of the record that a revisit refers to."""
    http = _http(len(payload))
    block = http + payload if response is None else http
    headers = [
        ("WARC-Type", "response" if response is None else "revisit"), ("WARC-Record-ID", record_id(page, url, digest, occurrence)), ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload))),
    ]
    if response is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*response, digest)), ("WARC-Refers-To-Target-URI", _uri(response[1])), ("WARC-Refers-To-Date", WARC_DATE), ("X-Refers-To-Page-Id", str(response[0]))]
    return _member(headers, block, level)


@dataclass
class _File:
    """One archive file under a temporary name until it is whole."""

    store: fs.FileSystem
    folder: str
    shard: int
    number: int
    records: int = 0
    size: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def __post_init__(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.temporary = f"{self.folder}/_temporary-{self.name}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        info = f"software: kinetika\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        self.add(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>"), ("WARC-Date", WARC_DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))], info, 6))
        self.records = 0

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1

    def commit(self) -> tuple:
        self.out.close()
        self.store.move(self.temporary, f"{self.folder}/{self.name}")
        return self.shard, self.name, self.records, self.size, self.digest.hexdigest()


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write one record for each row of ``pages`` to ``folder``; returns the committed manifest."""
    text_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("_order", F.coalesce("page", F.lit(-(2**63)))).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("_salt", F.xxhash64("sha"))
    narrow = materialize(rows.select("page", "url", "sha", F.octet_length("html").cast("long").alias("size"), "_order", "_salt"), "warc-digests")
    large = narrow.filter(F.col("size") >= revisit_from).select("page", "sha", "_order", "_salt")
    shared = narrow.filter(F.col("size") >= revisit_from).groupBy("sha").agg(F.max(F.struct("page", "url")).alias("response"), F.count("*").alias("key_rows"))
    shared = materialize(shared.filter("key_rows > 1").select("sha", F.col("response.page").alias("response"), F.col("response.url").alias("response_url"), "key_rows"), "warc-payloads")
    revisits = hot_join(large, shared, "sha", narrow=False).filter(~F.col("page").eqNullSafe(F.col("response"))).select("_order", "_salt", "sha", "response", "response_url").distinct()
    total = narrow.agg(F.coalesce(F.sum(F.col("size") + 512), F.lit(0))).first()[0]
    bounds = range_bounds(narrow, "_order", "_salt", F.col("size") + 512, max(1, -(-int(total) // shard_bytes)))
    # Marks of revisits travel with the pages, so the payloads are shuffled once.
    shard = range_of(F.col("_order"), F.col("_salt"), bounds)
    dealt = rows.select(shard.alias("shard"), "_order", "_salt", F.lit(True).alias("is_page"), "page", "url", "html", "sha", F.lit(None).cast("long").alias("response"))
    marks = revisits.select(shard.alias("shard"), "_order", "_salt", F.lit(False).alias("is_page"), F.lit(None).cast("long").alias("page"), F.col("response_url").alias("url"), F.lit("").alias("html"), "sha", "response")
    dealt = dealt.unionByName(marks).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "_order", "_salt", "is_page", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        current: _File | None = None
        marked_at, responses, last, occurrence = None, {}, None, 0
        for batch in batches:
            done = []
            for shard, order, is_page, page, u, h, sha, response in zip(*(batch.column(c).to_pylist() for c in ("shard", "_order", "is_page", "page", "url", "html", "sha", "response")), strict=True):
                if order != marked_at:
                    marked_at, responses = order, {}
                if not is_page:
                    responses[sha] = (response, u)
                    continue
                occurrence = occurrence + 1 if last == (order, sha, u) else 0
                last = (order, sha, u)
                if current and (current.shard != shard or current.size >= roll_bytes):
                    done.append(current.commit())
                    current = _File(store, path, shard, current.number + 1 if current.shard == shard else 0)
                current = current or _File(store, path, shard, 0)
                current.add(page_record(page, u, h.encode(), base64.b32encode(sha).decode(), responses.get(sha), occurrence))
            if done:
                yield _rows(done, MANIFEST)
        if current:
            yield _rows([current.commit()], MANIFEST)

    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest")
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; raises ``ValueError`` on a malformed or altered record."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = source.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record ends early")
        if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{payload_digest(block)}":
            raise ValueError(f"block digest differs in {headers['warc-record-id']}")
        yield headers, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = False, splits: int | None = None) -> DataFrame:
    """The page records of the files that the manifest lists.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url and file; with ``payloads`` also ``payload``, which is null
    for revisits. Every block is held against its digest, every file against its checksum and number of records.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string" + ", payload string" * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, count, sha256 in zip(*(batch.column(c).to_pylist() for c in ("file", "records", "sha256")), strict=True):
                found, out, held = 0, [], 0
                with store.open_input_file(f"{path}/{file}") as stream:
                    whole = hashlib.sha256()
                    while chunk := stream.read(1 << 20):
                        whole.update(chunk)
                    if whole.hexdigest() != sha256:
                        raise ValueError(f"checksum differs in {file}")
                    stream.seek(0)
                    for headers, block in records(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        found += 1
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, revisit = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "revisit"
                        if not revisit and (payload_digest(payload) != digest or len(payload) != int(headers["x-payload-length"])):
                            raise ValueError(f"payload digest differs in {headers['warc-record-id']}")
                        page, refers = headers["x-page-id"], headers.get("x-refers-to-page-id")
                        out.append((int(page) if page else None, int(headers["x-payload-length"]), digest, headers["warc-type"], int(refers) if refers else None, headers["warc-target-uri"], file, *[None if revisit else payload.decode()] * payloads))
                        held += len(payload) * payloads + 200
                        if held > 8 << 20:
                            yield _rows(out, schema)
                            out, held = [], 0
                if found != count:
                    raise ValueError(f"{file} has {found} records; the manifest says {count}")
                yield _rows(out, schema)

    manifest = read_manifest(spark, folder)
    splits = splits or max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("file", "records", "sha256").repartitionByRange(splits, "file").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives (by default in a new shared folder), then read them back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder)
