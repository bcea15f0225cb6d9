"""WARC archives compressed record by record with a common Zstandard dictionary.

The dictionary is trained on a bounded sample of the records. Each archive
starts with a skippable frame (0x184D2A5D) that holds it; then every record is
a frame of its own, so any record can be read with the dictionary and its
offset. Archives are written by the executors into a folder they share, through
Arrow's file systems (local or mounted folders, HDFS, object stores). A
file's name is new for each attempt at a task, and only names that a finished
task reported are read, so tasks that run again do no harm.

Records whose payload is that of another of at least ``least_bytes`` are
revisits of the one with the smallest page id and carry no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, write

MAGIC = 0x184D2A5D


@dataclass(frozen=True)
class WarcConfig:
    """sample and sample_bytes: whole records, and bytes of them, that the dictionary is trained on at most."""

    least_bytes: int = 100
    sample: int = 400
    sample_bytes: int = 8 << 20
    dictionary_bytes: int = 65_536
    level: int = 3
    file_bytes: int = 256 << 20


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, refers_url: str | None, kind: str) -> bytes:
    """A WARC/1.1 record; a revisit has no body. Line ends in a url are percent-encoded."""
    clean = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if payload is None else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    lines += [f"WARC-Target-URI: {clean(url)}"] if url is not None else []
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
        lines += [f"WARC-Refers-To-Target-URI: {clean(refers_url)}"] if refers_url is not None else []
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary; empty if there are too few samples to make one."""
    if len(samples) < 8 or sum(map(len, samples)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def classified(pages: DataFrame, cfg: WarcConfig) -> DataFrame:
    """(page_id, url, html, size, digest, refers_to, refers_url).

    Only digests that stand in more than one row are joined back.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    many = page.where(F.col("size") >= cfg.least_bytes).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = write(many.select(F.col("digest").alias("m_digest"), F.col("first.page_id").alias("m_id"), F.col("first.url").alias("m_url")), "payloads").df
    joined = page.join(many, F.col("digest") == F.col("m_digest"), "left")
    other = F.col("m_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("m_id"))
    return joined.select("page_id", "url", "html", "size", "digest", other.alias("revisit"), F.when(other, F.col("m_id")).alias("refers_to"), F.when(other, F.col("m_url")).alias("refers_url"))


def archive(pages: DataFrame, folder: str, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``; (path, records, bytes) of each archive.

    A null html is an empty payload; null ids and urls leave their header out.
    Of rows that share the smallest page id of their payload all are
    responses. An empty table makes no archive.
    """
    # hashes and sizes are looked at first: a top-k of the payloads would send k of them from every task
    order, size = F.xxhash64("page_id", "url"), F.octet_length(F.coalesce("html", F.lit("")))
    taken, room = [], cfg.sample_bytes
    for h, n in pages.select(order.alias("h"), size.alias("n")).orderBy("h", "n").limit(cfg.sample).collect():
        if n <= room:
            taken.append((h, n))
            room -= n
    chosen = pages.sparkSession.createDataFrame(sorted(set(taken)), "h long, n int")
    # rows that share a hash and a size may be more than were counted
    sample = pages.join(F.broadcast(chosen), (order == F.col("h")) & (size == F.col("n")), "left_semi").select(F.coalesce("html", F.lit(""))).limit(len(taken)).collect() if taken else []
    samples = [record(i, "http://www.example.com/", p, len(p), "0" * 64, None, None, "response") for i, p in enumerate(r[0].encode() for r in sample)]
    dictionary = train_dictionary(samples, cfg.dictionary_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = file_system(folder)
        where.create_dir(at, recursive=True)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=cfg.level, dict_data=data, write_content_size=True, write_checksum=True)
        done, out, path, n = [], None, "", 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    path = f"{folder.rstrip('/')}/{name}"
                    out = where.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                payload = None if r["revisit"] else r["html"].encode()
                out.write(packer.compress(record(r["page_id"], r["url"], payload, r["size"], r["digest"], r["refers_to"], r["refers_url"], "revisit" if r["revisit"] else "response")))
                n += 1
                if out.tell() >= cfg.file_bytes:
                    done.append((path, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, n, out.tell()))
            out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write(classified(pages, cfg).mapInArrow(run, "path string, records long, bytes long"), "archives").df


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path or a URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def frames(path: str) -> Iterator[bytes]:
    """The records of one archive; one frame is in memory at a time."""
    where, at = file_system(path)
    with where.open_input_stream(at, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path} has no dictionary frame")
        dictionary = f.read(size)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        rest = b""
        while True:
            rest = rest or f.read(1 << 20)
            if not rest:
                return
            one, out = reader.decompressobj(), []
            while True:
                out.append(one.decompress(rest))
                rest = one.unused_data
                if one.eof:
                    break
                rest = f.read(1 << 20)
                if not rest:
                    raise ValueError(f"{path} ends within a record")
            yield b"".join(out)


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record of the archives (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is held against its digest and length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for raw in frames(path):
                    h, payload = parse(raw)
                    digest, size, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"]), h["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {path} isn't what was written")
                    rows.append({"page_id": number(h.get("X-Page-ID")), "url": h.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(h.get("X-Refers-To-Page-ID"))})
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    # an archive is a task's: by default many names would share one
    spread = archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism * 2)
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Archive ``pages`` into a new folder and read the archives back."""
    back = read_back(archive(pages, new_path(spark, "warc"), cfg))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
