"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered

ROUNDS = 6


def _keys(seed: int) -> list[int]:
    """Round keys of 32 bits from the seed."""
    out, x = [], (seed * 2654435761 + 97) & 0xFFFFFFFF
    for _ in range(ROUNDS):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(x)
    return out


def _half_bits(n: int) -> int:
    """Half of the even number of bits whose range covers n; at most 4 n values."""
    bits = max(2, (max(1, n) - 1).bit_length())
    return (bits + 1) // 2


def _mixed(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    """Round function on halves of up to 31 bits; no product passes 63 bits."""
    x = (x + key) & 0xFFFFFFFF
    x = (x ^ (x >> 16)) * 73244475 & 0xFFFFFFFF
    x = (x ^ (x >> 13)) * 73244475 & 0xFFFFFFFF
    return (x ^ (x >> 16)) & mask


def permute(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse, on an int64 array.

    A balanced Feistel network permutes the next even power of two; values that
    fall outside walk on along their cycle until they come back into range.
    """
    h = _half_bits(n)
    mask, keys = (1 << h) - 1, _keys(seed)
    out = np.array(x, dtype=np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> h, out[todo] & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ _mixed(left, k, mask), left
        else:
            for k in keys:
                left, right = right, left ^ _mixed(right, k, mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n]
    return out


def place_of(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number: computable without the table."""
    at = int(permute(np.array([row]), n, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that a shard's slot holds: the inverse of :func:`place_of`."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def feistel_shards(spark: SparkSession, df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Give every row of ``df`` its ``row_number``, ``shard`` and ``slot``.

    ``order`` must order the rows; rows that tie in all of it are the same to the
    operator and take neighbouring numbers in any order.  Null keys come first.
    The law is ``rows``: shards differ by one row at most, slots are gapless from 0.
    An empty table gives an empty result.  Columns named like a result are replaced, all others stay.  Pass narrow rows (keys, sizes), not texts:
    the range sort moves each row once.
    """
    base = [c for c in df.columns if c.lower() not in ("row_number", "shard", "slot")]
    keys = [F.col(f"`{c}`").alias(f"key{i}") for i, c in enumerate(order)]
    rows = df.select(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in base]).alias("row"), *keys)
    rows = numbered(spark, rows, [f"key{i}" for i in range(len(order))])
    # the rows that numbered() keeps come from a checkpoint, so this count reads no table again
    n = rows.select(F.max("rn").alias("m")).first()["m"]
    n = 0 if n is None else n + 1

    @F.pandas_udf("long")
    def at(rn: pd.Series) -> pd.Series:
        return pd.Series(permute(rn.to_numpy(), n, seed))

    out = rows.withColumn("_at", at("rn"))
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in base],
        F.col("rn").alias("row_number"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / F.lit(shards)).cast("long").alias("slot"),
    )
