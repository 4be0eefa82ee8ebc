"""Helpers that the operators share: shared storage, prefix sums, byte-level tokenising."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLOCK = 1 << 20
#: Bytes of text whose words are hashed at a time.
_HASHED = 1 << 18


# --------------------------------------------------------------- storage


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and driver and executors are one process (tests) a
    folder of our own is made and set, so that ``checkpoint()`` works as well; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/tidemill-{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage."""
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """What runs inside has this setting; it is put back after it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """Inside, Spark deletes the shuffle files of a query as soon as that has ended, not whenever the driver collects its garbage.

    For queries that end in a table, a checkpoint or a few rows, and are run once.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; keeps the partitioning."""
    shared_root(spark)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that clash with none of ``df``'s, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


# ------------------------------------------------------ workers' memory

#: Rows in a batch between Spark and Python where they hold whole texts: Spark's 10,000 are held by both, twice while they grow.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession):
    """Inside, at most TEXT_ROWS rows make a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    return setting(spark, name, str(now if 0 < now < TEXT_ROWS else TEXT_ROWS))


def tidied(run):
    """``run``, a function of batches, that gives memory back at its end: workers live on, with all that they have freed but kept."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidy


# ----------------------------------------------------------- prefix sums


def numbered(spark: SparkSession, df: DataFrame, order: list[str], value: str | None = None) -> DataFrame:
    """Global row numbers (``rn``, from 0) in ``order``, and the sum of ``value`` over all rows before (``before``).

    A range sort puts the rows in order over partitions, and a checkpoint fixes
    them; only one count and sum per partition reach the driver (bounded by the
    number of partitions).  ``df`` should hold narrow rows: no texts.
    """
    value = value or "_one"
    df = df.withColumn("_one", F.lit(1).cast("long"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(spark, df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    rows = rows.withColumn("_pid", F.spark_partition_id())
    sums = sorted(rows.groupBy("_pid").agg(F.count("*").alias("n"), F.sum(value).alias("s")).collect())
    count, total, starts = 0, 0, {}
    for r in sums:
        starts[r["_pid"]] = (count, total)
        count, total = count + r["n"], total + int(r["s"] or 0)
    out_schema = pa.schema([("rn", pa.int64()), ("before", pa.int64())])

    def number(batches):
        from pyspark import TaskContext

        at = starts.get(TaskContext.get().partitionId(), (0, 0))
        rn, before = at
        for batch in batches:
            sizes = np.asarray(batch.column(batch.schema.get_field_index(value)).fill_null(0), dtype=np.int64)
            ends = np.cumsum(sizes)
            cols = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("_one", "_pid")]
            names = [c for c in batch.schema.names if c not in ("_one", "_pid")]
            cols += [pa.array(np.arange(rn, rn + len(sizes))), pa.array(before + ends - sizes)]
            yield pa.RecordBatch.from_arrays(cols, names=names + out_schema.names)
            rn += len(sizes)
            before += int(ends[-1]) if len(ends) else 0

    kept = [f for f in rows.schema.fields if f.name not in ("_one", "_pid")]
    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("rn", T.LongType()), T.StructField("before", T.LongType())])
    return rows.mapInArrow(number, schema)


def placed_by(spark: SparkSession, df: DataFrame, *order) -> DataFrame:
    """The rows of ``df`` range-sorted and fixed by a checkpoint: ``part`` (long) is a row's partition, ``at`` its place among them all.

    Both ascend in ``order``; rows that tie in it stand in any order, and are split over partitions by ``tied``, a number of no meaning.
    """
    rows = df.withColumn("tied", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(spark, rows.repartitionByRange(n, *order, "tied").sortWithinPartitions(*order, "tied")).drop("tied")
    return rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))


def joined(left: DataFrame, right: DataFrame, on: tuple[str, str], n: str) -> DataFrame:
    """Inner join of rows with one row a key, where ``n`` of ``right`` says how many rows of ``left`` have the key.

    A key that holds more than its share goes by broadcast: of such keys there are HOT_KEYS at most.
    ``left`` and ``right`` are read twice: they should be tables or checkpoints.
    """
    total = right.agg(F.sum(n).alias("t")).first()["t"] or 0
    most = max(1000, total // HOT_KEYS)
    hot = right.where(F.col(n) > most)
    met = F.col(on[0]) == F.col(on[1])
    rest = left.join(F.broadcast(hot.select(on[1])), met, "left_anti")
    return left.join(F.broadcast(hot), met).union(rest.join(right.where(F.col(n) <= most), met))


#: Keys that a join may broadcast for holding many rows each.
HOT_KEYS = 20_000
#: Partitions of one shuffle at most: beyond that a task has several shards.
MOST_TASKS = 20_000


def by_shard(df: DataFrame, shards: int) -> DataFrame:
    """Rows dealt out by their column ``shard`` (0 to ``shards`` - 1): neighbouring shards, one in nearly all cases, make a partition."""
    tasks = max(1, min(shards, MOST_TASKS))
    return df.repartitionById(tasks, F.floor(F.col("shard") * F.lit(tasks) / F.lit(max(1, shards))).cast("int"))


# ------------------------------------------------------------ key filter

#: Bits of a filter: at 16 a key, so at most 32 MB; callers with more keys go another way.
FILTER_BITS = 1 << 28


class KeyFilter:
    """Two bits of each of a table's 64-bit keys: has all of them, and few others."""

    def __init__(self, slices: dict[int, bytes], bits: int):
        self.bits = bits
        self.words = np.zeros(256 * bits // 8, np.uint8)
        for i, raw in slices.items():
            self.words[i * bits // 8 : (i + 1) * bits // 8] = np.frombuffer(raw, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return keys & np.uint64(bits - 1), (keys >> np.uint64(28)) & np.uint64(bits - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        base = (keys >> np.uint64(56)) * np.uint64(self.bits)
        out = np.ones(len(keys), bool)
        for p in self.places(keys, self.bits):
            at = base + p
            out &= (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def key_filter(keys: DataFrame, count: int) -> KeyFilter:
    bits = 1 << max(10, (16 * max(1, count) // 256 - 1).bit_length())

    def build(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            for s in np.unique(batch.column(0).to_numpy()):
                word = own.setdefault(int(s), np.zeros(bits, bool))
                for p in KeyFilter.places(keys[batch.column(0).to_numpy() == s], bits):
                    word[p] = True
        if own:
            raw = [np.packbits(w, bitorder="little").tobytes() for w in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array(raw, pa.binary())], names=["slice", "raw"])

    sliced = keys.select(F.shiftrightunsigned("key", 56).cast("int").alias("slice"), "key").repartition("slice")
    return KeyFilter({r["slice"]: r["raw"] for r in sliced.mapInArrow(build, "slice int, raw binary").collect()}, bits)  # FILTER_BITS at most, together


# -------------------------------------------------------- text as bytes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts (one more at the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = 4 << 20):
    """Row ranges of a column with at most ``limit`` bytes of text, or one row."""
    _, offs = utf8(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


_BYTE = randoms(256, 1)
_BASE = int(randoms(1, 2)[0]) | 1
_STEP = randoms(64, 3) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK + 1), np.uint64(base))
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if n <= 4 * _BLOCK:
            _powers[base] = have
    return have


def word_table(word: str) -> np.ndarray:
    """Table of the bytes that make up words: "space" for anything but ASCII white space, "alnum" for ASCII letters, digits and all non-ASCII bytes."""
    table = np.zeros(256, bool)
    if word == "space":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
        table[0x80:] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words never cross texts."""
    mask = table[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    edges = offs[:-1][offs[:-1] < len(data)]
    begin[edges] = mask[edges]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    last = offs[1:][offs[1:] > 0] - 1
    end[last] = mask[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, A-Z in lower case: a polynomial over random values of the bytes, mixed."""
    out = np.empty(len(s), np.uint64)
    inverse = pow(_BASE, -1, 2**64)
    i = 0
    table = _BYTE[LOWER]
    with np.errstate(over="ignore"):
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + _HASHED, side="right")))
            a, b = int(s[i]), int(e[j - 1])
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(table[data[a:b]] * _powers_of(_BASE, b - a)[: b - a], out=sums[1:])
            h = (sums[e[i:j] - a] - sums[s[i:j] - a]) * _powers_of(inverse, b - a)[s[i:j] - a]
            out[i:j] = mix64(h + (e[i:j] - s[i:j]).astype(np.uint64) * GOLDEN)
            i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, also of runs that cross texts (the caller leaves those out)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(n) * GOLDEN)
        for k in range(n):
            h += words[k : k + m] * _STEP[k]
    return mix64(h)


def texts_of(values) -> pa.Array:
    return pa.array(list(values), type=pa.string())
