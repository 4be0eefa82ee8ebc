"""Nested documents: trees to rows, provisions compared, packs cut to size, checks to errors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "text")])))
def tree_rows(tree: pd.Series) -> pd.Series:
    """A JSON tree of {tag, attr, children} as (path, text) rows; numbered siblings keep their number in the path."""

    def walk(node, path) -> Iterator[dict]:
        if isinstance(node, str):
            if node.strip():
                yield {"path": path, "text": " ".join(node.split())}
            return
        own = f"{path}/{node.get('tag', '')}" + (f"[{n}]" if (n := (node.get("attr") or {}).get("Num")) else "")
        for child in node.get("children") or ():
            yield from walk(child, own)

    def rows(raw):
        try:
            return list(walk(json.loads(raw), ""))
        except (TypeError, ValueError, AttributeError):
            return []

    return tree.map(rows)


def provisions(df: DataFrame, tree: str, keep: list[str]) -> DataFrame:
    """One row a path: texts below it in order."""
    rows = df.select(*keep, F.posexplode(tree_rows(F.col(tree))).alias("n", "r")).select(*keep, "n", "r.*")
    return rows.groupBy(*keep, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))


def provision_diff(old: DataFrame, new: DataFrame, citation: str) -> DataFrame:
    """added, removed, citation (equal but for citations) or substantive, a row a path that differs."""
    o = old.select(F.col("path").alias("op"), F.col("text").alias("ot"))
    n = new.select(F.col("path").alias("np"), F.col("text").alias("nt"))
    plain = lambda t: F.regexp_replace(t, citation, "")
    kind = F.when(F.col("op").isNull(), "added").when(F.col("np").isNull(), "removed").when(plain(F.col("ot")) == plain(F.col("nt")), "citation").otherwise("substantive")
    return o.join(n, F.col("op") == F.col("np"), "full_outer").where(~F.col("ot").eqNullSafe(F.col("nt"))).select(F.coalesce("np", "op").alias("path"), kind.alias("kind"))


def fitted(text: Column, sizes: tuple[int, ...], most: int) -> Column:
    """The longest cut of the ladder that stays below a number of bytes."""
    out = F.substring(text, 1, sizes[-1])
    for n in reversed(sizes[:-1]):
        cut = F.substring(text, 1, n)
        out = F.when(F.octet_length(cut) <= most, cut).otherwise(out)
    return out


def budgeted(docs: Column, most: int) -> Column:
    """Texts of an array cut to what is left of a budget of characters, in order; those after it go."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        part = F.substring(t, F.lit(1), F.greatest(F.lit(0), F.lit(most) - acc["used"]))
        return F.struct((acc["used"] + F.length(part)).alias("used"), F.when(F.length(part) > 0, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(docs, start, step)["out"]


def merged(base: Column, override: Column) -> Column:
    """Map union in which the second wins."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def first_object(text: Column) -> Column:
    """What looks like the first JSON object in free text."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def packed_id(kind: Column, id_: Column, digest: Column, mask: Column) -> Column:
    return F.concat_ws("-", kind, F.regexp_replace(id_, "-", "_"), F.substring(digest, 1, 16), mask.cast("string"))


def unpacked_id(packed: Column) -> Column:
    part = F.split(packed, "-")
    return F.struct(part[0].alias("kind"), F.regexp_replace(part[1], "_", "-").alias("id"), part[2].alias("digest"), part[3].cast("int").alias("mask"))


def errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
