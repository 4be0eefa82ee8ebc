"""Deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_shard, cut, joined, numbered

#: Payload bytes of a shard, and compressed bytes after which a shard's file is closed and the next begun.
SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
#: Fixed, so that the same rows give the same bytes.
DATE = "1970-01-01T00:00:00Z"
LOWEST = -(1 << 63)
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()),
])
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()),
])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record_id(page: int | None, sha: str, copy: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{sha}:{copy}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int | str) -> bytes:
    """One record: headers and digests made anew from the payload.  Line ends in a url are escaped, and a header says so."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = url or ""
    broken = "\r" in target or "\n" in target
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, sha, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _escaped(target) if broken else target),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", "" if page is None else str(page)),
        ("X-URL-Null", str(int(url is None))),
    ]
    if broken:
        head.append(("X-URL-Escaped", "1"))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, sha, 0)), ("X-Refers-To-Page", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """One gzip member, without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Files:
    """The files of one shard, rolled by compressed size."""

    def __init__(self, out: str, shard: int):
        self.shard, self.part, self.file, self.done = shard, 0, None, []
        self.fs, self.root = pafs.FileSystem.from_uri(out)

    def add(self, raw: bytes) -> None:
        if self.file is None:
            self.temporary = f"{self.root}/_temporary-{self.shard:08d}-{uuid.uuid4().hex}"
            self.file, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.file.write(raw)
        self.sha.update(raw)
        self.size += len(raw)
        self.records += 1
        if self.size >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            name = f"shard-{self.shard:08d}-{self.part:05d}.warc.gz"
            self.fs.move(self.temporary, f"{self.root}/{name}")
            self.done.append((self.shard, name, self.size, self.records, self.sha.hexdigest()))
            self.file, self.part = None, self.part + 1


def write_warc(spark: SparkSession, pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> str:
    """Write a record for each row in key order under ``out``; returns ``out``.

    Of the rows with equal payloads of at least ``least`` bytes, those with the smallest key are
    responses and the others revisits of it; shorter payloads are all responses.
    Shards are ranges of (key, payload, url) with about SHARD_BYTES of payload, found from a distributed
    prefix sum, each a task of its own: they, the rolled files and every byte depend on the rows alone.  A task
    writes to temporary names and renames, so a repeated task leaves the same files;
    the manifest is committed last, and only files that it lists count.

    A null payload is empty, a null url is kept as null, line ends in a url come back as they were.  Rows with the
    same key and payload are all of the same type (several responses if theirs is the smallest key); null keys come
    first, and only if all keys of a payload are null are its rows responses.  A key that very many rows have, as null may
    be, takes several shards; only rows with the same key, payload and url stay together.
    An empty table gives an empty manifest.  Other columns are ignored.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"))
    place = [F.coalesce("key", F.lit(LOWEST)).alias("k"), F.sha1("payload").alias("sha"), F.xxhash64("url").alias("u")]
    small = cut(spark, rows.select(*place, F.octet_length("payload").cast("long").alias("n"), "key"))
    # keys of payloads that occur more than once: (payload, smallest key)
    copied = small.where(F.col("n") >= least).groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("c")).where("c > 1").select(F.col("sha").alias("f_sha"), "first", "c")
    revisits = joined(small.select("k", "sha", "key"), cut(spark, copied), ("sha", "f_sha"), "c")
    revisits = revisits.where(~F.col("key").eqNullSafe(F.col("first"))).select(F.col("k").alias("r_k"), F.col("sha").alias("r_sha"), "first").distinct()
    sizes = numbered(spark, small.select("k", "sha", "u", "n"), ["k", "sha", "u", "n"], "n")
    first = sizes.groupBy(F.floor(F.col("before") / F.lit(SHARD_BYTES)).alias("s")).agg(F.min(F.struct("k", "sha", "u")).alias("first")).select("first.*").distinct().orderBy("k", "sha", "u").collect()
    bounds = spark.sparkContext.broadcast([(r["k"], r["sha"], r["u"]) for r in first])

    @F.pandas_udf("long")
    def shard_of(k: pd.Series, sha: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds.value, x) - 1 for x in zip(k.tolist(), sha.tolist(), u.tolist())], dtype="int64")

    def write(batches):
        now, last, copy, note = None, None, 0, None
        for batch in batches:
            for s, k, sha, _, tag, null, u, first, payload in zip(*(c.to_pylist() for c in batch.columns[:8]), batch.column(8)):
                if not tag:
                    note = (k, sha, first)
                    continue
                if now is None or now.shard != s:
                    if now is not None:
                        now.close()
                        yield _manifest(now.done)
                    now, last = _Files(out, s), None
                    begun = s > 0 and bounds.value[s][:2] == (k, sha)  # the shard before may hold copies of its first record
                copy = copy + 1 if last == (k, null, sha) else 0
                begun = begun and last in (None, (k, null, sha))
                last = (k, null, sha)
                to = note[2] if note and note[:2] == (k, sha) else None
                now.add(member(record(None if null else k, u, payload.as_py(), to, f"{s}-{copy}" if begun else copy)))
        if now is not None:
            now.close()
            yield _manifest(now.done)

    # what a row revisits travels as a narrow row just before it, in each of its shards: the payloads are shuffled once
    notes = revisits.select(F.col("r_k").alias("k"), F.col("r_sha").alias("sha"), F.lit(LOWEST).alias("u"), F.lit(0).alias("tag"), F.lit(False).alias("null"), F.lit(None).cast("string").alias("url"), "first", F.lit(None).cast("binary").alias("payload"))
    whole = rows.select(*place, F.lit(1).alias("tag"), F.col("key").isNull().alias("null"), "url", F.lit(None).cast("long").alias("first"), "payload")
    placed = whole.select(shard_of("k", "sha", "u").alias("shard"), "*")
    placed = placed.union(notes.select(F.explode(F.sequence(F.greatest(shard_of("k", "sha", "u"), F.lit(0)), shard_of("k", "sha", F.lit((1 << 63) - 1)))).alias("shard"), "*"))
    placed = by_shard(placed, len(first)).sortWithinPartitions("shard", "k", "sha", "tag", "u", "url")
    placed.mapInArrow(write, "shard long, file string, bytes long, records long, sha256 string").write.parquet(f"{out}/manifest")
    bounds.unpersist()
    return out


def _manifest(done) -> pa.RecordBatch:
    names = ["shard", "file", "bytes", "records", "sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)


def members(stream):
    """(offset, bytes) of each gzip member, one in memory at a time."""
    z, out, at, start = zlib.decompressobj(31), [], 0, 0
    while True:
        raw = stream.read(1 << 18)
        if not raw:
            break
        while raw:
            out.append(z.decompress(raw))
            used = len(raw) - len(z.unused_data)
            at += used
            if not z.eof:
                break
            yield start, b"".join(out)
            raw, start, z, out = z.unused_data, at, zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the file ends within a record")


def parsed(raw: bytes) -> dict:
    """A record's columns; its digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    url = None if fields["X-URL-Null"] == "1" else _plain(fields["WARC-Target-URI"]) if "X-URL-Escaped" in fields else fields["WARC-Target-URI"]
    if not revisit and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, "url": url,
        "record_type": fields["WARC-Type"], "refers_to": int(fields["X-Refers-To-Page"]) if revisit else None, "payload_digest": sha, "payload_bytes": size, "payload": None if revisit else payload,
    }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all files that the manifest lists; a revisit has no payload of its own (null).

    With ``payloads`` off the payloads are checked but not returned.
    """
    files = cut(spark, spark.read.schema("shard long, file string, bytes long, records long, sha256 string").parquet(f"{path}/manifest").select("file"))
    n = max(1, min(files.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for offset, raw in members(f):
                        row = parsed(raw) | {"file": name, "offset": offset}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return files.repartition(n, "file").mapInArrow(read, RECORD)
