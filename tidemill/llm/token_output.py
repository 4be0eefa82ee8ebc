"""Token-ID output: a static range asymmetric numeral system over independent interleaved blocks.

File of a shard (little-endian)::

    b"TMRANS1\\n"
    blocks: lane states (LANES x u64), then the renormalisation words (u32)
    document index, zlib: keys (i64), key-is-null flags (u8), id counts (i64)
    footer, JSON: first document's start, blocks [offset, bytes, first id, ids, crc32], index, table's crc32
    footer's length (u32), b"TMRANS1\\n"

All shards share one frequency table (``table.bin``, u32 a symbol).  Each block
starts from its own lane states, so a reader may decode any block alone: the
footer's entries are the checkpoints.  ``manifest`` (Parquet) lists the shards that count.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import LOWER, by_shard, chunks, cut, numbered, removed, shared_path, text_batches, tidied, utf8, written

MAGIC = b"TMRANS1\n"
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
BLOCK = 1 << 18
#: Ids in a shard's file (the document that passes the mark belongs to it still).
SHARD_IDS = 1 << 23
LOWEST = -(1 << 63)
#: Pieces that a worker's cache holds, about 200 bytes each; later ones are encoded each time.
_CACHE_MOST = 500_000
#: Bytes of text that are tokenised at a time (or one text).
_CHUNK = 8 << 20
#: Marks that combine with letters before them.
_MARKS = "[\u02be\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"
#: Letters that no normal form and no lower case changes.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Pieces of letters, digits and signs other than the apostrophe, and their parts.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
#: A stop or comma at the end of a piece, after a letter or digit that no normal form takes apart.
_STOPPED = "([a-z0-9À-ÖØ-öø-ÿ])([.,])( |$)"
#: The words of tokenizers whose pieces :class:`Encoder` knows to take apart.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# ------------------------------------------------------------------ rANS


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE; every symbol that occurs has 1 at least."""
    total, size = int(counts.sum()), 1 << SCALE
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out.astype(np.uint32)
    have = counts > 0
    if have.sum() > size:
        raise ValueError("more symbols than the scale has slots")
    out[have] = np.maximum(1, (counts[have].astype(np.float64) * size / total).astype(np.int64))
    order = np.argsort(-out, kind="stable")
    excess, i = int(out.sum()) - size, 0
    while excess > 0:  # take from the most frequent, which lose the least by it
        k = order[i % len(order)]
        step = min(excess, int(out[k]) // 2)
        out[k] -= step
        excess -= step
        i += 1
    out[order[0]] -= excess
    return out.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Lanes take ids in turn; steps run backwards, so that decoding runs forwards."""
    x = np.full(LANES, LOW)
    words = []
    for t in range(-(-len(ids) // LANES) - 1, -1, -1):
        sym = ids[t * LANES : (t + 1) * LANES]
        f, c, own = table.freq[sym], table.cum[sym], x[: len(sym)]
        full = own >= f << np.uint64(63 - SCALE)
        words.append((own[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        own[full] >>= np.uint64(32)
        q = own // f
        own[:] = (q << np.uint64(SCALE)) + (own - q * f) + c
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(raw: bytes, n: int, table: Table) -> np.ndarray:
    x = np.frombuffer(raw, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(raw, "<u4", offset=8 * LANES).astype(np.uint64)
    out, at = np.empty(n, np.uint32), 0
    for i in range(0, n, LANES):
        own = x[: min(LANES, n - i)]
        slot = own & np.uint64((1 << SCALE) - 1)
        sym = table.symbol[slot]
        out[i : i + len(own)] = sym
        own[:] = table.freq[sym] * (own >> np.uint64(SCALE)) + slot - table.cum[sym]
        low = np.flatnonzero(own < LOW)
        own[low] = (own[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
    if at != len(words) or (x != LOW).any():
        raise ValueError("block does not end in its first state")
    return out


# ------------------------------------------------------------ tokenising


def apart(spec: dict) -> bool:
    """Whether a tokenizer (its file's JSON) encodes what stands between blanks by itself, and takes words as ``_WORDS`` does.

    Its normaliser must only compose, lower and join white space, which never acts across a blank; its words must hold no
    white space and end with a mark of their own; no special token may hold a blank or take one in.
    """
    steps = lambda x, name: [] if x is None else [y for z in x[name] for y in steps(z, name)] if x["type"] == "Sequence" else [x]
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    rules = steps(spec["normalizer"], "normalizers")
    words = steps(spec["pre_tokenizer"], "pretokenizers")
    return (
        all(x["type"] in ("NFC", "Lowercase") or x == blank for x in rules)
        and sum(x["type"] == "Lowercase" for x in rules) == 1
        and [x["type"] for x in words] == ["Split", "ByteLevel"]
        and words[0]["pattern"] == {"Regex": _WORDS} and words[0]["behavior"] == "Removed" and words[0]["invert"]
        and not words[1]["add_prefix_space"] and not words[1]["use_regex"]
        and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("dropout")
        and spec.get("truncation") is None and spec.get("padding") is None
        and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"])
    )


class Encoder:
    """A tokenizer with a cache of what stands between blanks.

    The texts of a batch are cut at blanks and line ends and each distinct piece is looked up once; Arrow puts the
    ids together.  Pieces that are not known are encoded by the tokenizer, many in one text where their words are
    plain to see.  A tokenizer that isn't :func:`apart` gets whole texts.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart = apart(spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = "<u2" if self.size <= 1 << 16 else "<u4"
        self.cache: dict[str, bytes] = {"": b""}
        if not self.apart:
            return
        #: The same for words of letters alone, which it neither changes nor takes apart.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Ids that end a word; each word has one, its last.
        self.last = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        special = "|".join(re.escape(x["content"]) for x in spec["added_tokens"])
        #: What keeps a text as it is: there, lower case could change more than the letters.
        self.asis = _MARKS + (f"|(?i:{special})" if special else "")
        self.plain_only = re.compile(self.asis)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode new pieces: those whose parts are plain to see many in one text, others one by one.

        Parts are runs of letters, single digits and runs of other signs; each ends with one id that ends a word.
        """
        out: dict[str, bytes] = {}
        letters, mixed, rest = [], [], []
        for w in words:
            (letters if _LETTERS.fullmatch(w) else mixed if _PLAIN.fullmatch(w) and not self.plain_only.search(w) else rest).append(w)
        for tokenizer, group in ((self.letters, letters), (self.tokenizer, mixed)):
            for i in range(0, len(group), 256):
                part = group[i : i + 256]
                ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.type)
                ends = np.flatnonzero(self.last[ids]) + 1
                at = np.arange(1, len(part) + 1) if group is letters else np.cumsum([len(_PARTS.findall(w)) for w in part])
                if len(ends) != at[-1]:
                    rest += part
                    continue
                cuts, raw, k = ends[at - 1].tolist(), ids.tobytes(), ids.itemsize
                out.update(zip(part, [raw[k * x : k * y] for x, y in zip([0, *cuts], cuts)]))
        if rest:
            out.update((w, np.array(e.ids, self.type).tobytes()) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.cache.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        learnt = self._learn([pieces[i] for i in new])
        for i in new:
            found[i] = learnt[pieces[i]]
        if len(self.cache) <= _CACHE_MOST:
            self.cache.update(learnt)
        return found

    def encoded(self, column: pa.Array) -> pa.LargeBinaryArray:
        """The ids of each whole text, as bytes of ``type``; null counts as empty."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        if not self.apart:
            return pa.array([np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)], pa.large_binary())
        column = pc.replace_substring(column, "\n", " ")
        # texts with few different pieces, but the same ids: A-Z in lower case, a last stop or comma as a piece of its own
        data, offs = utf8(column)
        low = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offs.tobytes()), pa.py_buffer(LOWER[data]))
        column = pc.if_else(pc.match_substring_regex(column, self.asis), column, pc.replace_substring_regex(low, _STOPPED, r"\1 \2\3"))
        lists = pc.split_pattern(column, " ")
        pieces = lists.flatten().dictionary_encode()
        ids = pa.array(self._pieces(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        starts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[ends]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(starts.tobytes()), ids.buffers()[2]])

    def ids(self, text: str | None) -> bytes:
        return self.encoded(pa.array([text], pa.string()))[0].as_py()


# ----------------------------------------------------------- the operator


def _fs(path: str):
    return pafs.FileSystem.from_uri(path)


def write_ids(spark: SparkSession, docs: DataFrame, out: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> str:
    """Tokenise every whole text and write the ids in ascending key order under ``out``; returns ``out``.

    The texts are read and tokenised once; the ids wait in a table until they are counted
    for the shared frequencies and for the starts, and are then encoded.  Shards are ranges of keys with SHARD_IDS ids
    each, found from a distributed prefix sum, so they depend on the data alone.
    A task writes a shard under a temporary name and renames it; a repeated task
    writes the same bytes.  The manifest comes last.

    Null texts are empty: they hold the end id alone.  Rows with the same key stay
    together, in the order of their ids; null keys come first.  An empty table gives
    an empty manifest.  Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))

    def count(batches):
        enc = Encoder.at(tokenizer)
        counts = np.zeros(max(enc.size, end_id + 1), np.int64)
        for whole in batches:
            for i, j in chunks(whole.column(1), _CHUNK):
                batch = whole.slice(i, j - i)
                found = enc.encoded(batch.column(1))
                offs = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
                sizes = np.diff(offs) // np.dtype(enc.type).itemsize + 1
                raw = found.buffers()[2]
                counts += np.bincount(np.frombuffer(raw, enc.type, int(offs[-1]) // np.dtype(enc.type).itemsize) if offs[-1] else np.zeros(0, int), minlength=len(counts))
                counts[end_id] += len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), np.int32)), batch.column(0), pa.array(sizes), found.cast(pa.binary())], names=names)
        have = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(have), np.int32)), pa.array(have), pa.array(counts[have]), pa.nulls(len(have), pa.binary())], names=names)

    names = ["kind", "a", "b", "ids"]
    with text_batches(spark):
        counted, counted_at = written(spark, docs.mapInArrow(tidied(count), "kind int, a long, b long, ids binary"), "counts")
    per_id = counted.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(max([end_id, *(r["a"] for r in per_id)]) + 1, np.int64)
    for r in per_id:
        counts[r["a"]] = r["n"]
    freq = scaled(counts)
    sizes = numbered(spark, counted.where("kind = 0").select(F.coalesce("a", F.lit(LOWEST)).alias("k"), "b"), ["k", "b"], "b")
    first = sizes.groupBy(F.floor(F.col("before") / F.lit(SHARD_IDS)).alias("s")).agg(F.min("k").alias("first")).select("first").distinct()
    shards = sizes.join(F.broadcast(first), F.col("k") == F.col("first")).groupBy("first").agg(F.min("before").alias("start")).orderBy("first").collect()
    firsts, starts = [r["first"] for r in shards], [r["start"] for r in shards]
    fs, root = _fs(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/table.bin") as f:
        f.write(freq.astype("<u4").tobytes())
    bounds = spark.sparkContext.broadcast((firsts, starts, freq))

    @F.pandas_udf("long")
    def shard_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds.value[0], np.int64), k.to_numpy(), side="right") - 1)

    def write(batches):
        _, starts, freq = bounds.value
        Encoder._made.pop(tokenizer, None)  # a worker that has tokenised keeps its cache no longer
        table, now = Table(freq), None
        for batch in batches:
            for s, k, null, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.shard != s:
                    if now is not None:
                        yield now.closed()
                    now = _Writer(out, s, starts[s], table)
                now.add(0 if null else k, null, np.frombuffer(ids, "<u2" if len(ids) == 2 * (n - 1) else "<u4"), end_id)
        if now is not None:
            yield now.closed()

    keyed = counted.where("kind = 0").withColumn("k", F.coalesce("a", F.lit(LOWEST)))
    rows = keyed.select(shard_of("k").alias("shard"), "k", F.col("a").isNull().alias("null"), F.col("b").alias("n"), "ids")
    rows = by_shard(rows, len(firsts)).sortWithinPartitions("shard", "k", "ids")
    rows.mapInArrow(write, "shard long, file string, start long, ids long, docs long, bytes long").write.parquet(f"{out}/manifest")
    bounds.unpersist()
    removed(spark, counted_at)
    return out


class _Writer:
    """One shard's file; holds a block of ids and the document index."""

    def __init__(self, out: str, shard: int, start: int, table: Table):
        self.shard, self.start, self.table, self.n, self.held = shard, start, table, 0, 0
        self.fs, self.root = _fs(out)
        self.name, self.temporary = f"ids-{shard:08d}.rans", f"{self.root}/_temporary-{shard:08d}-{uuid.uuid4().hex}"
        self.file = self.fs.open_output_stream(self.temporary)
        self.file.write(MAGIC)
        self.at, self.ids, self.blocks, self.keys, self.nulls, self.sizes = len(MAGIC), [], [], [], [], []

    def add(self, key: int, null: bool, ids: np.ndarray, end_id: int) -> None:
        self.keys.append(key)
        self.nulls.append(null)
        self.sizes.append(len(ids) + 1)
        self.ids += [ids.astype("<u4"), np.array([end_id], "<u4")]
        self.held += len(ids) + 1
        if self.held >= BLOCK:
            whole = np.concatenate(self.ids)
            cut_at = len(whole) // BLOCK * BLOCK
            for i in range(0, cut_at, BLOCK):
                self._block(whole[i : i + BLOCK])
            self.ids, self.held = [whole[cut_at:]], len(whole) - cut_at

    def _block(self, ids: np.ndarray) -> None:
        raw = encode_block(ids, self.table)
        self.file.write(raw)
        self.blocks.append([self.at, len(raw), self.n, len(ids), zlib.crc32(raw)])
        self.at += len(raw)
        self.n += len(ids)

    def closed(self) -> pa.RecordBatch:
        if self.held:
            self._block(np.concatenate(self.ids))
        index = zlib.compress(np.array(self.keys, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.sizes, "<i8").tobytes(), 6)
        foot = json.dumps({"start": self.start, "blocks": self.blocks, "index": [self.at, len(index), len(self.keys), zlib.crc32(index)], "table": self.table.crc}).encode()
        self.file.write(index + foot + len(foot).to_bytes(4, "little") + MAGIC)
        self.file.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        total = self.at + len(index) + len(foot) + 4 + len(MAGIC)
        row = [self.shard, self.name, self.start, self.n, len(self.keys), total]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["shard", "file", "start", "ids", "docs", "bytes"])


class ShardFile:
    """Reads a shard's file: any block alone, or the documents in turn."""

    def __init__(self, root: str, name: str, fs, table: Table):
        self.file, self.table = fs.open_input_file(f"{root}/{name}"), table
        size = self.file.size()
        tail = self.file.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        n = int.from_bytes(tail[:4], "little")
        if tail[4:] != MAGIC:
            raise ValueError(f"{name} is not a shard's file")
        self.foot = json.loads(self.file.read_at(n, size - 4 - len(MAGIC) - n))
        if self.foot["table"] != table.crc:
            raise ValueError(f"{name} belongs to another table")
        self.start = self.foot["start"]

    def block(self, i: int) -> np.ndarray:
        at, size, _, n, crc = self.foot["blocks"][i]
        raw = self.file.read_at(size, at)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {i} is damaged")
        return decode_block(raw, n, self.table)

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, size, n, crc = self.foot["index"]
        raw = self.file.read_at(size, at)
        if zlib.crc32(raw) != crc:
            raise ValueError("the document index is damaged")
        raw = zlib.decompress(raw)
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the shard's ``first``, from the blocks that hold them alone."""
        starts = [b[2] for b in self.foot["blocks"]]
        i, out = bisect.bisect_right(starts, first) - 1, []
        skip, left = first - starts[i], n
        while left > 0:
            got = self.block(i)[skip : skip + left]
            out.append(got)
            skip, left, i = 0, left - len(got), i + 1
        return np.concatenate(out)

    def documents(self):
        """(key, start, ids) of each document, with one block and one document in memory."""
        keys, nulls, sizes = self.index()
        held, i, start = np.zeros(0, np.uint32), 0, self.start
        for key, null, size in zip(keys.tolist(), nulls.tolist(), sizes.tolist()):
            parts, have = [held], len(held)
            while have < size:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
            held = whole[size:]
            yield None if null else key, start, whole[:size]
            start += size


def read_ids(spark: SparkSession, path: str, of=None, schema: str = "key long, start long, ids array<long>") -> DataFrame:
    """Documents read from the files that the manifest lists.

    ``of`` turns (key, start, ids) into a row of ``schema``; without it the ids
    themselves are returned.
    """
    of = of or (lambda key, start, ids: (key, start, ids.tolist()))
    files = cut(spark, spark.read.schema("shard long, file string").parquet(f"{path}/manifest"))
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count()))

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def rows_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), fields)], schema=fields)

    def read(batches):
        table = None
        for batch in batches:
            for name in batch.column(1).to_pylist():
                fs, root = _fs(path)
                if table is None:
                    with fs.open_input_file(f"{root}/table.bin") as f:
                        table = Table(np.frombuffer(f.read(), "<u4"))
                found = []
                for d in ShardFile(root, name, fs, table).documents():
                    found.append(of(*d))
                    if len(found) == 2000:
                        yield rows_of(found)
                        found = []
                if found:
                    yield rows_of(found)

    return files.repartition(n, "shard").mapInArrow(read, schema)


def ids_digest(key, start, ids):
    return key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def ids_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text) and read back one row a document: doc_id, start, n_tokens, ids_crc32."""
    out = write_ids(spark, docs, shared_path(spark, "ids"), tokenizer, end_id=end_id)
    return read_ids(spark, out, ids_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
