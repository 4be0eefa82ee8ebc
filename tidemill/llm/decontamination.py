"""Benchmark decontamination: a broadcast hash set of test n-grams against the windows of training texts.

The set is broadcast up to MOST_WINDOWS windows and MOST_BYTES of text.  A larger benchmark stays distributed: the windows
of texts that a broadcast filter of bounded size lets through meet those of the items in a join on hash and words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILTER_BITS, chunks, cut, fresh, gram_hashes, key_filter, mix64, utf8, word_hashes, word_spans, word_table

WINDOW = 10
#: Test windows, and bytes of test texts, that are broadcast as they are; more go through a join.
MOST_WINDOWS, MOST_BYTES = 1 << 20, 64 << 20
_BITS = 20


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offs = utf8(column)
    s, e, doc = word_spans(data, offs, word_table("alnum"))
    return data, s, e, doc, word_hashes(data, s, e)


class Windows:
    """Hashes of the windows of some items, by window length, and the items' words to verify them by."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        data, s, e, doc, hashes = words_of(pa.array(texts, type=pa.string()))
        lower = bytes(data).lower()
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.ids, self.words = ids, [[lower[a:b] for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])] for i in range(len(ids))]
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(len(ids)):
            n = int(first[i + 1] - first[i])
            if n:
                length = min(n, window)
                grams = gram_hashes(hashes[first[i] : first[i + 1]], length)
                by_length.setdefault(length, []).extend((int(h), i, k) for k, h in enumerate(grams))
        self.tables = []
        for length, rows in sorted(by_length.items()):
            rows.sort()
            h = np.array([r[0] for r in rows], dtype=np.uint64)
            seen = np.zeros(1 << _BITS, bool)
            seen[h >> np.uint64(64 - _BITS)] = True
            self.tables.append((length, h, np.array([r[1:] for r in rows], dtype=np.int64), seen))

    def hits(self, data, s, e, doc, hashes):
        """(first word, length, item) of each verified occurrence."""
        out = []
        for length, table, where, seen in self.tables:
            grams = gram_hashes(hashes, length)
            at = np.flatnonzero(seen[grams >> np.uint64(64 - _BITS)])
            at = at[doc[at] == doc[at + length - 1]]
            lo, hi = np.searchsorted(table, grams[at], side="left"), np.searchsorted(table, grams[at], side="right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            for w, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                words = [data[x:y].tobytes().lower() for x, y in zip(s[w : w + length], e[w : w + length])]
                out.extend((w, length, int(i)) for i, k in where[a:b] if self.words[i][k : k + length] == words)
        return out


def find_contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Which words of each text lie inside a window of a test item.

    Adds to ``docs``: ``n_words``, ``hit_spans`` (array of start, end of the maximal runs
    of hit words, as word numbers) and ``hit_items`` (sorted ids as strings).  A
    window is ``window`` consecutive words of an item, or a shorter item as a whole; equal hashes are
    verified word by word.  A table of windows within MOST_WINDOWS and MOST_BYTES is broadcast and texts are not shuffled;
    a larger one is joined with the windows of the texts.

    Null and empty texts have no words and no hits; items without words or with a null text
    have no windows; items with a null id hit words like others and are, together, one null at the end of ``hit_items``;
    repeated items and items that share windows all count.  Repeated rows keep
    their own results.  Columns of ``docs`` named like a result are replaced.
    An empty table on either side gives no hits.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "hit_spans", "hit_items")])
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL").distinct()
    words = F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    size = items.agg(F.sum(F.greatest(words - (window - 1), F.lit(1))).alias("windows"), F.sum(F.octet_length("t")).alias("bytes")).first()
    if (size["windows"] or 0) <= MOST_WINDOWS and (size["bytes"] or 0) <= MOST_BYTES:
        return _scanned(spark, docs, items, text, window)
    return _met(spark, docs, items, text, window)


def _added() -> list[T.StructField]:
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(span)), T.StructField("hit_items", T.ArrayType(T.StringType()))]


def _in_order(ids) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i))


def _columns(first: np.ndarray, hits: list[tuple[int, int, int]], ids: list[list[str | None]]) -> list[pa.Array]:
    """The columns of ``_added`` for a batch: ``first`` has each text's first word, hits are (text, first word in the batch, words)."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    spans: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for _, at, n in hits:
        edge[at] += 1
        edge[at + n] -= 1
    if hits:
        hit = np.cumsum(edge[:-1]) > 0
        for d in {h[0] for h in hits}:
            own = np.diff(np.concatenate([[0], hit[first[d] : first[d + 1]].astype(np.int8), [0]]))
            spans[d] = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(own > 0), np.flatnonzero(own < 0))]
    return [pa.array(np.diff(first), type=pa.int64()), pa.array(spans, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(ids, type=pa.list_(pa.string()))]


def _scanned(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str, window: int) -> DataFrame:
    """Against a broadcast table."""
    rows = items.orderBy("i", "t").collect()  # within MOST_WINDOWS and MOST_BYTES
    shared = spark.sparkContext.broadcast(Windows([r["i"] for r in rows], [r["t"] for r in rows], window))
    added = _added()

    def scan(batches):
        for whole in batches:
            texts = whole.column(whole.schema.get_field_index(text))
            for i, j in chunks(texts):
                batch = whole.slice(i, j - i)
                data, s, e, doc, hashes = words_of(texts.slice(i, j - i))
                first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                hits, ids = [], [set() for _ in range(batch.num_rows)]
                for w, length, item in shared.value.hits(data, s, e, doc, hashes):
                    hits.append((int(doc[w]), w, length))
                    ids[int(doc[w])].add(shared.value.ids[item])
                cols = _columns(first, hits, [_in_order(x) for x in ids])
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *added]))


_WINDOW = "n int, hash long, words string"


def _windows(column: pa.Array, lengths: list[int], keep=None):
    """(text, first word, length, hash, words) arrays of a batch's windows; ``keep`` says of hashes which are of use."""
    data, s, e, doc, hashes = words_of(column)
    first = np.searchsorted(doc, np.arange(len(column) + 1))
    for n in lengths:
        grams = gram_hashes(hashes, n)
        at = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        if keep is not None and len(at):
            at = at[keep(grams[at], n)]
        words = [b" ".join(data[x:y].tobytes().lower() for x, y in zip(s[w : w + n], e[w : w + n])).decode() for w in at.tolist()]
        yield doc[at], at - first[doc[at]], n, grams[at].view(np.int64), words


def _salted(hashes: np.ndarray, n: int) -> np.ndarray:
    return mix64(hashes + np.uint64(n))


def _met(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str, window: int) -> DataFrame:
    """By a join; texts are known by their md5, so copies are looked up once and nothing depends on a row's place."""

    def of_items(batches):
        for batch in batches:
            column = batch.column(1)
            count = np.bincount(words_of(column)[3], minlength=len(column))
            for n in np.unique(np.minimum(count, window)):
                if not n:
                    continue
                own = np.flatnonzero(np.minimum(count, window) == n)
                for doc, _, n_, hashes, words in _windows(column.take(pa.array(own)), [int(n)]):
                    ids = batch.column(0).take(pa.array(own[doc]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(doc), n_, np.int32)), pa.array(hashes), pa.array(words, pa.string())], names=["i", "n", "hash", "words"])

    table = cut(spark, items.mapInArrow(of_items, "i string, " + _WINDOW).distinct())
    lengths = [r["n"] for r in table.select("n").distinct().orderBy("n").collect()]  # ``window`` at most
    keys = cut(spark, table.select("n", "hash").distinct())
    count = keys.count()

    def salted(batches):
        for batch in batches:
            key = _salted(batch.column(1).to_numpy().view(np.uint64), batch.column(0).to_numpy().astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    known = spark.sparkContext.broadcast(key_filter(keys.mapInArrow(salted, "key long"), count)) if 16 * count <= FILTER_BITS else None
    texts = docs.select(F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")

    def of_texts(batches):
        keep = None if known is None else lambda hashes, n: known.value.has(_salted(hashes, n))
        for whole in batches:
            for i, j in chunks(whole.column(0)):
                column = whole.column(0).slice(i, j - i)
                tids = pa.array([hashlib.md5(t.as_buffer() or b"").digest() for t in column], pa.binary())
                for doc, at, n, hashes, words in _windows(column, lengths, keep):
                    cols = [tids.take(pa.array(doc)), pa.array(at), pa.array(np.full(len(doc), n, np.int32)), pa.array(hashes), pa.array(words, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["tid", "at", "n", "hash", "words"])

    found = texts.mapInArrow(of_texts, "tid binary, at long, " + _WINDOW).distinct()
    theirs = table.select("i", *[F.col(c).alias(f"i_{c}") for c in ("n", "hash", "words")])
    met = (F.col("hash") == F.col("i_hash")) & (F.col("n") == F.col("i_n")) & (F.col("words") == F.col("i_words"))
    hits = cut(spark, found.join(theirs, met).select("tid", "at", "n", "i"))
    spots = hits.select("tid", "at", "n").distinct().groupBy(F.col("tid").alias("s_tid")).agg(F.collect_list(F.struct("at", "n")).alias("spots"))
    named = hits.select("tid", F.struct("i").alias("i")).distinct().groupBy("tid").agg(F.collect_list("i").alias("ids"))
    hits = cut(spark, spots.join(named, F.col("tid") == F.col("s_tid")).drop("s_tid"))
    tid, h_tid, h_spots, h_ids = fresh(docs, "tid", "h_tid", "h_spots", "h_ids")
    hits = hits.select(F.col("tid").alias(h_tid), F.col("spots").alias(h_spots), F.col("ids").alias(h_ids))
    rows = docs.withColumn(tid, F.unhex(F.md5(F.col(f"`{text}`")))).join(hits, F.col(tid) == F.col(h_tid), "left").drop(tid, h_tid)
    n_cols, added = len(docs.columns), _added()

    def mark(batches):
        for whole in batches:
            texts = whole.column(whole.schema.get_field_index(text))
            for i, j in chunks(texts):
                batch = whole.slice(i, j - i)
                doc = words_of(texts.slice(i, j - i))[3]
                first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                spots = batch.column(n_cols).to_pylist()
                ids = [_in_order(x["i"] for x in own or ()) for own in batch.column(n_cols + 1).to_pylist()]
                hits = [(d, int(first[d]) + x["at"], x["n"]) for d, own in enumerate(spots) for x in own or ()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], *_columns(first, hits, ids)], names=[*batch.schema.names[:n_cols], *[f.name for f in added]])

    return rows.mapInArrow(mark, T.StructType([*docs.schema.fields, *added]))


def decontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, action: str = "documents", text: str = "text", **options) -> DataFrame:
    """Remove what is contaminated: whole rows (``documents``), or the hit words with what stands between them (``spans``).

    Rows without a hit are returned as they were, texts byte for byte; null and empty texts stay.
    """
    found = find_contamination(spark, docs.select("*"), items, text=text, **options)
    if action == "documents":
        return found.where(F.size("hit_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    if action != "spans":
        raise ValueError(f"unknown action: {action}")
    at = found.schema.fieldNames().index(text)

    def cut_out(batches):
        for batch in batches:
            texts, spans = batch.column(at), batch.column(batch.schema.get_field_index("hit_spans"))
            out = []
            for t, runs in zip(texts, spans):
                value = t.as_py()
                if runs.as_py():
                    data, s, e, _, _ = words_of(pa.array([value], type=pa.string()))
                    left, last = b"", 0
                    for run in runs.as_py():
                        left += data[last : s[run["start"]]].tobytes()
                        last = int(e[run["end"] - 1])
                    value = (left + data[last:].tobytes()).decode("utf-8")
                out.append(value)
            cols = [pa.array(out, type=pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return found.mapInArrow(cut_out, found.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
