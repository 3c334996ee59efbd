"""A deterministic sharded WARC writer and its reader.

Records are built and compressed where the pages are read, one gzip member
each; only compressed members are shuffled. Shards are ranges of the key,
cut at fixed amounts of payload from exact running sums, so the same pages
give the same files whatever the partitioning. A shard's records are sorted
by key and appended to files that roll at a compressed size. Files are
written under temporary names of their own task attempt; the attempts that
Spark commits name theirs in a manifest, those files get their final names,
and the manifest, written last, says which files belong to the archive.

Equal payloads of at least ``least`` bytes: the one with the largest key is
a response, the others are revisits that refer to it.

Defined results: a null payload is an empty one; a null url is written as
the record's own id; control characters in urls are percent-encoded; rows
that repeat the response's key and payload are responses too; a null key
sorts first, and refers to the largest key if there is one; empty tables give
an archive without files. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faresight.llm.common import arrow_batches, map_arrow, materialize, materialize_counted, scratch_path, small, table

SHARD_BYTES = 32 << 20     # payload of a shard
ROLL_BYTES = 8 << 20       # compressed size at which a file is closed
DATE = "2024-01-01T00:00:00Z"
SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, intact boolean")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha1:" + payload_digest(block)),
            ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_id(key) -> str:
    return f"<urn:record:{'null' if key is None else key}>"


def page_record(key, url: str | None, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """One gzip member: the page as a response, or a revisit of
    ``refers_to`` (the HTTP header keeps the payload's length)."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(key)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(key)), ("WARC-Date", date), ("WARC-Target-URI", target),
              ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
              ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
               ("WARC-Refers-To", record_id(refers_to))]
    return _record("revisit", fields, http)


def info_record(name: str, date: str = DATE) -> bytes:
    return _record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name),
                                ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def shard_starts(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """First key of each shard after the first. Exact running sums of the
    payload in key order: sums of sorted partitions, then inside each."""
    placed = materialize(sizes.where("key IS NOT NULL").groupBy("key").agg(F.sum("bytes").alias("bytes"))
                         .orderBy("key").withColumn("part", F.spark_partition_id()), "warc_sizes")
    before = placed.groupBy("part").agg(F.sum("bytes").alias("part_bytes"))
    before = before.select("part", (F.sum("part_bytes").over(Window.orderBy("part")) - F.col("part_bytes")).alias("base"))
    upto = Window.partitionBy("part").orderBy("key")
    at = (placed.join(F.broadcast(before), "part")          # one row a partition
          .withColumn("shard", F.floor((F.col("base") + F.sum("bytes").over(upto) - F.col("bytes")) / shard_bytes)))
    starts = at.groupBy("shard").agg(F.min("key").alias("key")).orderBy("shard").collect()
    return np.array([r["key"] for r in starts][1:], np.int64)


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
                  date: str = DATE) -> DataFrame:
    """Write ``pages`` below ``folder`` (a URI that all executors reach);
    returns the manifest: shard, seq, name, records, bytes, sha256."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("hash", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    narrow = materialize(rows.select("key", "hash", "bytes"), "warc_keys")
    same, n = materialize_counted(
        narrow.where(F.col("bytes") >= least).groupBy("hash").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("hash", "first"), "warc_same")
    starts = spark.sparkContext.broadcast(shard_starts(narrow, shard_bytes))
    refers = F.when(F.col("first") > F.coalesce("key", F.col("first") - 1), F.col("first"))
    rows = rows.join(small(same, n, 64), "hash", "left").select("key", "url", "payload", refers.alias("refers"))

    def build(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, urls, bodies, refs = (c.to_pylist() for c in b.columns)
        shard = [0 if k is None else int(np.searchsorted(starts.value, k, "right")) for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.int64()), b.column(0), b.column(1), pa.array(refs, pa.int64()),
             pa.array([page_record(k, u, p, r, date) for k, u, p, r in zip(keys, urls, bodies, refs)], pa.binary())],
            ["shard", "key", "url", "refers", "member"])

    members = map_arrow(rows, build, "shard long, key long, url string, refers long, member binary")
    members = (members.repartitionById(len(starts.value) + 1, F.col("shard").cast("int"))    # a shard, a task
               .sortWithinPartitions("shard", "key", "url", "refers", F.md5("member")).select("shard", "key", "member"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        attempt, out = f"{root}/_temporary/{uuid.uuid4().hex}", None
        fs.create_dir(attempt, recursive=True)

        class File:
            def __init__(self, shard: int, seq: int):
                self.shard, self.seq, self.records, self.bytes = shard, seq, 0, 0
                self.name = f"shard-{shard:06d}-{seq:05d}.warc.gz"
                self.sha, self.stream = hashlib.sha256(), fs.open_output_stream(f"{attempt}/{self.name}", compression=None)
                self.add(info_record(self.name, date), 0)

            def add(self, data: bytes, records: int = 1) -> None:
                self.stream.write(data)
                self.sha.update(data)
                self.bytes += len(data)
                self.records += records

            def done(self) -> pa.RecordBatch:
                self.stream.close()
                row = (self.shard, self.seq, self.name, self.records, self.bytes, self.sha.hexdigest(),
                       f"{attempt}/{self.name}")
                return pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(),
                                                            pa.int64(), pa.string(), pa.string()))],
                    ["shard", "seq", "name", "records", "bytes", "sha256", "temporary"])

        for b in batches:
            for shard, member in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if out is not None and (out.shard != shard or out.bytes >= roll_bytes):
                    yield out.done()
                    out = File(shard, out.seq + 1 if out.shard == shard else 0)
                elif out is None:
                    out = File(shard, 0)
                out.add(member)
        if out is not None:
            yield out.done()

    arrow_batches(spark)
    written = materialize(members.mapInArrow(
        write, "shard long, seq long, name string, records long, bytes long, sha256 string, temporary string"),
        "warc_written")

    def commit(b: pa.RecordBatch) -> pa.RecordBatch:
        fs, root = pafs.FileSystem.from_uri(folder)
        for name, temporary in zip(b.column(2).to_pylist(), b.column(6).to_pylist()):
            if fs.get_file_info(temporary).type != pafs.FileType.NotFound:      # else an earlier try moved it
                fs.move(temporary, f"{root}/{name}")
        return b

    map_arrow(written, commit, written.schema).drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest")
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")         # of attempts that failed
    return spark.read.parquet(f"{folder}/manifest")


def _key(uri: str) -> int | None:
    text = uri.rpartition(":")[2].rstrip(">")
    return None if text == "null" else int(text)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a decompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's files, record by record: the columns of ``SCHEMA``.
    ``intact``: the digests of the block and of a response's payload are as
    written."""
    files = spark.read.parquet(f"{folder}/manifest").select("name")
    files = files.repartition(max(1, files.count()), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                with gzip.GzipFile(fileobj=fs.open_input_file(f"{root}/{name}")) as f:
                    for head, block in read_records(f):
                        kind = head["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?mi)^content-length: (\d+)", http)[1])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        intact = head["warc-block-digest"] == "sha1:" + payload_digest(block) and (
                            kind == "revisit" or (len(body) == size and payload_digest(body) == digest))
                        rows.append((_key(head["warc-record-id"]), head["warc-target-uri"], size, digest, kind,
                                     _key(head["warc-refers-to"]) if kind == "revisit" else None, intact))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(read, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      [x.split()[0] for x in SCHEMA.split(", ")])


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM {pages}),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex,
      max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)
           FOR i IN generate_series(0, 31)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM h
"""
