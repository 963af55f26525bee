"""Deterministic sharded WARC archives.

Records are range-sorted by id and payload digest into shards whose bounds follow from exact
ranks, so the same input makes the same files and far-off ids make no uneven shards.  A task streams its shard into gzip members, one a record, rolls to
the next file when the compressed size reaches the limit, and gives a file its final name only
when it is complete.  The manifest lists the finished files with sizes and digests; readers go
by it alone, so what a lost attempt leaves behind is never read.

Of records with equal payloads of at least ``revisit_from`` bytes the one with the largest id is
a response and the others are revisits of it.

Defined results: null payloads are empty; a null or control-bearing URL is left out or escaped;
of repeated rows with one id and payload the first in order is the response, the rest revisit
it; records without id are responses, or revisits if an equal payload has an id; an empty table
makes an empty manifest.

Archives are written by executors through Arrow's file systems: local paths, ``s3://`` (also
spelt ``s3a://``), ``gs://`` and, where the native library is installed, ``hdfs://``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import salted_join
from .storage import fresh_path, map_batches, written

ROLL_BYTES = 256 << 20
REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def open_folder(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    scheme, found, rest = root.partition("://")
    return pa.fs.FileSystem.from_uri(f"s3://{rest}" if found and scheme in ("s3a", "s3n") else root)


def record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}{f':{repeat}' if repeat else ''}>"


def record(kind: str, page_id: int | None, repeat: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A whole record; a revisit keeps the HTTP headers, and with them the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, repeat)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{base32(digest)}")
    lines.append(f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"software: seriesforge\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


class ShardWriter:
    """Writes one shard's records to rolled files; each gets its name when it is complete."""

    def __init__(self, root: str, shard: int, roll_bytes: int, attempt: str):
        self.fs, self.folder = open_folder(root)
        self.shard, self.roll_bytes, self.attempt = shard, roll_bytes, attempt
        self.number, self.out = 0, None

    def write(self, raw: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/temporary/{self.attempt}-{self.name}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha1()
            self._put(_info(self.name))
        self._put(raw)
        self.records += 1
        if self.size >= self.roll_bytes:
            yield self.close()

    def _put(self, raw: bytes) -> None:
        packer = zlib.compressobj(5, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        self.out = None
        self.number += 1
        return self.name, self.shard, self.records, self.size, self.sha.hexdigest()


MANIFEST = "file string, shard int, records long, bytes long, sha1 string"


def _place(page_id, digest: str) -> tuple[int, str]:
    """What rows are sorted by; rows without id come first."""
    return -(1 << 63) - 1 if page_id is None or pd.isna(page_id) else int(page_id), digest


def bounds_of(rows: DataFrame, shards: int) -> list[tuple[int, str]]:
    """Where each shard but the first begins, by the exact rank of (page_id, digest): shards of about equal counts."""
    counts = rows.groupBy("page_id", "digest").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("count").to_numpy()
            ends = before + n.cumsum()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(ends - n, pa.int64()), *batch.columns], ["part", "before", *batch.schema.names])
            before = int(ends[-1]) if len(n) else before

    dealt = counts.repartitionByRange(shards, "page_id", "digest").sortWithinPartitions("page_id", "digest")
    keys = written(map_batches(dealt, run, "part int, before long, page_id long, digest string, count long"), "warc-keys")
    parts = sorted((r["part"], r["n"]) for r in keys.groupBy("part").agg(F.sum("count").alias("n")).collect())  # a row a part
    total, offsets, at = sum(n for _, n in parts), [], 0
    for part, n in parts:
        offsets.append((part, at))
        at += n
    first = keys.join(F.broadcast(keys.sparkSession.createDataFrame(offsets, "of int, offset long")), F.col("part") == F.col("of"))  # a row a part
    shard = F.floor((F.col("offset") + F.col("before")) * shards / F.lit(max(1, total)))
    begins = first.groupBy(shard.alias("shard")).agg(F.min(F.struct("page_id", "digest")).alias("first")).collect()  # a row a shard
    return sorted(_place(r["first"]["page_id"], r["first"]["digest"]) for r in begins)[1:]


def write_archives(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Writes page_id, url and html as archives under root; returns the manifest, itself a table under root."""
    spark = pages.sparkSession
    fs, folder = open_folder(root)
    fs.create_dir(f"{folder}/temporary", recursive=True)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"))
    small = rows.where(F.octet_length("html") >= revisit_from).select("page_id", "digest")
    winners = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = salted_join(small, F.col("page_id"), winners.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of")).drop("of").distinct()
    bounds = bounds_of(rows.select("page_id", "digest"), shards)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, _place(p, d)) for p, d in zip(page_id.astype(object), digest)], dtype="int32")

    # a revisit's mark comes just before the record that it is for, so that one shuffle brings both
    both = rows.withColumns({"mark": F.lit(1), "refers_to": F.lit(None).cast("long")}).unionByName(revisits.withColumns({"mark": F.lit(0), "url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")}))
    dealt = both.withColumn("shard", shard_of(F.col("page_id"), F.col("digest")))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "mark", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, writer, done, marked, seen, repeat = f"{TaskContext.get().taskAttemptId()}", None, [], None, None, 0
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, html, digest, mark, refers_to, shard = (batch.column(c)[at].as_py() for c in ("page_id", "url", "html", "digest", "mark", "refers_to", "shard"))
                if not mark:
                    marked = page_id, digest, refers_to
                    continue
                if writer is None or writer.shard != shard:
                    if writer is not None and writer.out is not None:
                        done.append(writer.close())
                    writer = ShardWriter(root, shard, roll_bytes, attempt)
                repeat = repeat + 1 if seen == (page_id, digest) else 0
                seen = page_id, digest
                target = marked[2] if marked is not None and marked[:2] == seen else None
                if target is not None and target == page_id and not repeat:
                    target = None
                done += writer.write(record("response" if target is None else "revisit", page_id, repeat, url, html.encode("utf-8", "surrogatepass"), digest, target))
        if writer is not None and writer.out is not None:
            done.append(writer.close())
        columns = list(zip(*done)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "records", "bytes", "sha1"])

    map_batches(dealt, run, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
            if data:
                continue
        data = stream.read(1 << 20)
    if any(parts):
        raise ValueError("an archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(uri: str) -> int | None:
    name = uri.removeprefix("<urn:x-page:").rstrip(">").split(":")[0]
    return None if name == "none" else int(name)


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """One row per response or revisit of the files that the manifest lists; digests are verified."""
    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(root)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        fields, block = parse(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None))
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return map_batches(manifest.select("file").repartition(shards), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages to a new folder of the shared place and reads them back."""
    root = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, root), root)
