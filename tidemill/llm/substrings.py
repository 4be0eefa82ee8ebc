"""Removal of repeated byte strings with suffix arrays made by external induced sorting.

A string of ``length`` bytes belongs, by its content alone, to an anchor: the run of
ANCHOR bytes in it with the smallest hash.  All strings of one anchor occurrence that follow
each other form a segment, so every string starts in exactly one segment, and equal
strings lie in segments with the same anchor.  Segments whose anchor occurs once
in the corpus can hold no repeat; the others are dealt out by anchor into
shards, each is sorted by itself, and strings whose common prefix with
a neighbour reaches ``length`` are repeats.  Equal segments are
counted before they are sorted, so copies cost nothing.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE, _BYTE, FILTER_BITS, _powers_of, cut, fresh, joined, key_filter, mix64, removed, utf8, written
from .induced import suffix_array

#: Bytes of an anchor, and of text hashed at a time.
ANCHOR = 100
CHUNK = 1 << 18
#: Bytes of segments in a shard; segments of one anchor beyond which its strings are dealt out in smaller pieces, of so many
#: strings, and pieces of one core beyond which each string goes by itself.
SHARD = 6 << 20
HOT, PIECE = 20_000, 8
_POSITION = np.uint64((1 << 24) - 1)


def segments(data: np.ndarray, length: int):
    """Segments of one text: arrays of first string, number of strings, the anchor's place and its hash."""
    n, window = len(data), length - ANCHOR + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    inverse = pow(_BASE, -1, 2**64)
    firsts, keys = [], []
    with np.errstate(over="ignore"):
        for start in range(0, n - length + 1, CHUNK):
            part = data[start : start + CHUNK + length - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.multiply(_BYTE[part], _powers_of(_BASE, len(part))[: len(part)], out=sums[1:])
            np.cumsum(sums, out=sums)
            h = (sums[ANCHOR:] - sums[:-ANCHOR]) * _powers_of(inverse, len(part))[: len(part) - ANCHOR + 1]
            h = mix64(h)
            low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= window:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < window:
                low = np.minimum(low[: -(window - width)], low[window - width :])
            at = (low & _POSITION).astype(np.int64)
            edge = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            firsts.append((start + edge, start + at[edge]))
            keys.append(mix64(h[at[edge]] + np.uint64(1)))  # the smallest of many are small: mixed, they spread over all values
    first, anchor, key = np.concatenate([x[0] for x in firsts]), np.concatenate([x[1] for x in firsts]), np.concatenate(keys)
    # a segment that a chunk's end has cut goes on in the next chunk
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    first, anchor, key = first[new], anchor[new], key[new]
    return first, np.diff(np.concatenate([first, [n - length + 1]])), anchor, key


def _identity(data: np.ndarray) -> bytes:
    return hashlib.md5(data.tobytes()).digest()


def _occurrences(tid: bytes, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.frombuffer(tid[:8], "<u8")[0]).view(np.int64)


def _each(column: pa.Array):
    data, offs = utf8(column)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield data[a:b]


def _repeats(length: int):
    """mapInArrow function: rows (key, id, bytes) in order of key to (key, id, mask of the strings that occur again).

    Whole keys are put together until they hold SHARD bytes; their text lies in
    a file, so a key that is larger by far is sorted the same way.
    """

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            keys, ids, sizes, total, file = [], [], [], 0, open(f"{folder}/text", "wb")
            for batch in batches:
                for key, i, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    if total >= SHARD and key != keys[-1]:
                        file.close()
                        yield sort(folder, keys, ids, sizes)
                        keys, ids, sizes, total, file = [], [], [], 0, open(f"{folder}/text", "wb")
                    symbols = np.frombuffer(raw, np.uint8).astype("<u2") + np.uint16(2)
                    file.write(symbols.tobytes() + b"\x01\x00")
                    keys.append(key)
                    ids.append(i)
                    sizes.append(len(raw))
                    total += len(raw) + 1
            file.close()
            if keys:
                yield sort(folder, keys, ids, sizes)

    def sort(folder, keys, ids, sizes):
        with open(f"{folder}/text", "ab") as f:
            f.write(b"\x00\x00")
        text = np.memmap(f"{folder}/text", "<u2", "r")
        again, last = np.zeros(len(text), bool), 0
        for at, lcp in suffix_array(text, 258, length, folder):
            long = np.flatnonzero(lcp >= length)
            again[at[long]] = True
            again[at[long[long > 0] - 1]] = True
            if len(long) and long[0] == 0:
                again[last] = True
            last = int(at[-1])
        starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
        masks = [np.packbits(again[a : a + n - length + 1], bitorder="little").tobytes() for a, n in zip(starts.tolist(), sizes)]
        del text
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], names=["key", "id", "mask"])

    return run


def _pieces(length: int):
    """mapInArrow function: strings of a hot anchor, PIECE neighbours at a time.

    Pieces are counted from the anchor and take as key what all strings that can be
    in them share, so equal strings get equal keys and few others do.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, sid, anchor, raw in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(raw) - length + 1
                for high in range(anchor, anchor - (length - ANCHOR) - PIECE, -PIECE):
                    low = high - PIECE + 1
                    a, b = max(0, low), min(n - 1, high)
                    if a <= b:
                        core = hashlib.md5(raw[high : low + length] + key.to_bytes(8, "little", signed=True) + (anchor - high).to_bytes(2, "little")).digest()
                        part = raw[a : b + length]
                        rows.append((int.from_bytes(core[:8], "little", signed=True), hashlib.md5(part).digest(), key, sid, a, b - a + 1, part))
            if rows:
                types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["piece", "id", "key", "sid", "at", "n", "bytes"])

    return run


def _strings(length: int):
    """mapInArrow function: each string of a piece by itself, with its md5."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, _, key, sid, at, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(hashlib.md5(raw[i : i + length]).digest(), key, sid, at + i) for i in range(n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary(), pa.int32()))], names=["h", "key", "sid", "at"])

    return run


def _sorted(contents: DataFrame, length: int) -> DataFrame:
    """(key, id, bytes), each once, to (key, id, mask): anchors are dealt out into shards."""
    volume = contents.agg(F.sum(F.octet_length("bytes")).alias("v")).first()["v"] or 0
    rows = contents.select("key", "id", "bytes").repartition(max(1, -(-volume // SHARD)), "key").sortWithinPartitions("key")
    return rows.mapInArrow(_repeats(length), "key long, id binary, mask binary")


def find_repeats(spark: SparkSession, docs: DataFrame, text: str, length: int = 200) -> tuple[DataFrame, str]:
    """Parts of each distinct text that occur again: (tid: md5 of the text's bytes, whole: whether all of it does, parts: array of first, n, mask).

    A part is ``n`` strings from ``first`` on; where there is a mask, those whose bits are set.
    Texts without any are missing.  The place of the table that holds the result is returned beside it.
    """
    if not ANCHOR < length < 256:
        raise ValueError(f"length must be between {ANCHOR + 1} and 255")
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).where(F.octet_length("t") >= length)

    def anchors(batches):
        for batch in batches:
            keys, seen = [], []
            for data in _each(batch.column(0)):
                first, _, _, key = segments(data, length)
                keys.append(key.view(np.int64))
                seen.append(_occurrences(_identity(data), first))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(seen))], names=["key", "seen"])

    counted = texts.mapInArrow(anchors, "key long, seen long").groupBy("key").agg(F.min("seen").alias("a"), F.max("seen").alias("b"))
    repeated, repeated_at = written(spark, counted.where("a <> b").select("key"), "anchors")
    count = repeated.count()
    known = spark.sparkContext.broadcast(key_filter(repeated, count)) if 16 * count <= FILTER_BITS else None  # else through a semi join
    types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def cut_out(batches):
        names = ["key", "sid", "seen", "tid", "first", "n", "anchor", "bytes"]

        def batch_of(numbers, tids, raws):
            key, seen, first, n, anchor = (np.concatenate(x) for x in zip(*numbers))
            sids = [hashlib.md5(r).digest() for r in raws]
            cols = [key, sids, seen, tids, first, n.astype(np.int32), anchor.astype(np.int32), raws]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            numbers, tids, raws = [], [], []
            for data in _each(batch.column(0)):
                first, n, anchor, key = segments(data, length)
                keep = np.flatnonzero(known.value.has(key)) if known is not None else np.arange(len(key))
                if len(keep):
                    tid, whole, f = _identity(data), data.tobytes(), first[keep]
                    numbers.append((key[keep].view(np.int64), _occurrences(tid, f), f, n[keep], anchor[keep] - f))
                    raws += [whole[a:b] for a, b in zip(f.tolist(), (f + n[keep] - 1 + length).tolist())]
                    tids += [tid] * len(keep)
                if len(raws) > 8000:
                    yield batch_of(numbers, tids, raws)
                    numbers, tids, raws = [], [], []
            if raws:
                yield batch_of(numbers, tids, raws)

    found = texts.mapInArrow(cut_out, "key long, sid binary, seen long, tid binary, first long, n int, anchor int, bytes binary")
    if known is None:
        found = found.join(repeated.withColumnRenamed("key", "r"), F.col("key") == F.col("r"), "left_semi")
    found, found_at = written(spark, found, "segments")

    # each segment once; anchors with one segment in several places are repeats as they are, those with several are sorted
    contents = found.groupBy("key", F.col("sid").alias("id")).agg(F.min("seen").alias("a"), F.max("seen").alias("b"), F.min("anchor").alias("anchor"), F.first("bytes").alias("bytes"))
    contents, contents_at = written(spark, contents, "contents")
    by_key = contents.groupBy("key").agg((F.min("a") != F.max("b")).alias("again"), (F.min("id") != F.max("id")).alias("hard")).where("again").select("key", "hard")
    by_key = cut(spark, by_key)
    contents = contents.join(by_key.where("hard").select(F.col("key").alias("h")), F.col("key") == F.col("h"), "left_semi").select("key", "id", (F.col("a") != F.col("b")).alias("twice"), "anchor", "bytes")
    hot = cut(spark, contents.groupBy("key").count().where(F.col("count") > HOT).select(F.col("key").alias("k")))
    plain = contents.join(hot, F.col("key") == F.col("k"), "left_anti")
    masks = _sorted(plain, length).select("key", F.col("id").alias("sid"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("m"), "mask")
    if hot.count():
        split = contents.join(hot, F.col("key") == F.col("k"), "left_semi").select("key", "id", "anchor", "bytes")
        split = split.mapInArrow(_pieces(length), "piece long, id binary, key long, sid binary, at int, n int, bytes binary")
        split = cut(spark, split)
        # pieces that many rims share with a common core would be one task: their strings are told apart by themselves
        crowded = cut(spark, split.select("piece", "id").distinct().groupBy("piece").count().where(F.col("count") > HOT).select(F.col("piece").alias("c_piece")))
        among = F.col("piece") == F.col("c_piece")
        if crowded.count():
            strings = cut(spark, split.join(crowded, among, "left_semi").mapInArrow(_strings(length), "h binary, key long, sid binary, at int"))
            again = cut(spark, strings.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("n")).where("n > 1"))
            single = joined(strings, again, ("h", "g"), "n").select("key", "sid", "at", F.lit(1).alias("m"), F.lit(None).cast("binary").alias("mask"))
            masks = masks.union(single)
            split = cut(spark, split.join(crowded, among, "left_anti"))
        of_piece = split.groupBy("piece", "id").agg((F.min("sid") != F.max("sid")).alias("twice"), F.first("bytes").alias("bytes"))
        sorted_ = _sorted(of_piece.select(F.col("piece").alias("key"), "id", "bytes"), length).withColumnRenamed("key", "p").withColumnRenamed("id", "i")
        sorted_ = of_piece.drop("bytes").join(sorted_, (F.col("piece") == F.col("p")) & (F.col("id") == F.col("i"))).select("p", "i", F.when(~F.col("twice"), F.col("mask")).alias("mask"))
        sorted_ = split.join(sorted_, (F.col("piece") == F.col("p")) & (F.col("id") == F.col("i")))
        masks = masks.union(sorted_.select("key", "sid", "at", F.col("n").alias("m"), "mask"))
    twice = contents.where("twice").select("key", F.col("id").alias("sid"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("m"), F.lit(None).cast("binary").alias("mask"))
    masks, masks_at = written(spark, masks.where("mask IS NULL OR ltrim('0', hex(mask)) <> ''").union(twice), "masks")
    own = found.select("key", "sid", "tid", "first", "n")
    easy = own.join(by_key.where("NOT hard").select(F.col("key").alias("h")), F.col("key") == F.col("h"), "left_semi").select("tid", "first", "n", F.lit(None).cast("binary").alias("mask"))
    rest = own.join(masks.select(F.col("key").alias("h"), F.col("sid").alias("s"), "at", "m", "mask"), (F.col("key") == F.col("h")) & (F.col("sid") == F.col("s")))
    rest = rest.select("tid", (F.col("first") + F.col("at")).alias("first"), F.coalesce("m", "n").alias("n"), "mask")
    parts = easy.union(rest).groupBy("tid").agg(F.collect_set(F.struct("first", "n", "mask")).alias("parts"))
    copies = texts.groupBy(F.unhex(F.md5("t")).alias("tid")).count().where("count > 1").select(F.col("tid").alias("c"))
    result = parts.join(copies, F.col("tid") == F.col("c"), "full_outer")
    result, result_at = written(spark, result.select(F.coalesce("tid", "c").alias("tid"), F.col("c").isNotNull().alias("whole"), "parts"), "repeats")
    removed(spark, repeated_at, found_at, contents_at, masks_at)  # before the texts are moved
    return result, result_at


def remove_repeats(spark: SparkSession, docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts anywhere else.

    Adds ``n_bytes``, ``removed_spans`` (array of start, end of the maximal runs removed, in bytes) and
    ``kept`` (binary: the other bytes, in order) to ``docs``.  All strings are
    judged on the input; overlaps of a string with itself count, matches never cross texts.

    A null text is empty.  Texts shorter than ``length`` keep all bytes.  Repeated rows are each other's
    copies: from ``length`` bytes on nothing of them is kept, and so for a text that repeats
    within itself.  Columns of ``docs`` named like a result are replaced.  An empty table stays empty.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_bytes", "removed_spans", "kept")])
    repeats, _ = find_repeats(spark, docs, text, length)
    tid, c_tid, c_whole, c_parts = fresh(docs, "tid", "r_tid", "r_whole", "r_parts")
    repeats = repeats.select(F.col("tid").alias(c_tid), F.col("whole").alias(c_whole), F.col("parts").alias(c_parts))
    rows = docs.withColumn(tid, F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    rows = rows.join(repeats, F.col(tid) == F.col(c_tid), "left").drop(tid, c_tid)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("removed_spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    at, n_cols = docs.columns.index(text), len(docs.columns)

    def cut_out(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                data, offs = utf8(batch.column(at))
                base = offs + np.arange(len(offs))  # a place more after each text, so that spans end there
                edge = np.zeros(int(base[-1]) + 1, np.int32)
                full = np.flatnonzero(batch.column(n_cols).fill_null(False).to_numpy(zero_copy_only=False))
                np.add.at(edge, base[full], 1)
                np.add.at(edge, base[full + 1] - 1, -1)
                lists = batch.column(n_cols + 1)
                parts = lists.flatten()
                if len(parts):
                    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
                    first = base[doc] + parts.field("first").to_numpy()
                    n, masks = parts.field("n").to_numpy(), parts.field("mask")
                    plain = masks.is_null().to_numpy(zero_copy_only=False)
                    np.add.at(edge, first[plain], 1)
                    np.add.at(edge, first[plain] + n[plain] - 1 + length, -1)
                    raw, at_byte = utf8(masks)
                    bits = np.flatnonzero(np.unpackbits(raw, bitorder="little"))
                    part = np.searchsorted(at_byte, bits >> 3, side="right") - 1
                    starts = first[part] + bits - 8 * at_byte[part]
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + length, -1)
                gone = np.cumsum(edge) > 0
                turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                a, b = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)
                doc = np.searchsorted(base, a, side="right") - 1
                lists = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(a - base[doc]), pa.array(b - base[doc])], ["start", "end"]))
                kept = [data[x:y][~gone[x + k : y + k]].tobytes() for k, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist()))]
                cols = [*batch.columns[:n_cols], pa.array(np.diff(offs)), spans, pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n_cols], "n_bytes", "removed_spans", "kept"])

    return rows.mapInArrow(cut_out, schema)
