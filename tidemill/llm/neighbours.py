"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, removed, written

#: The tree is begun on this many rows at most (those with the smallest hash of their id); every row is indexed.
SAMPLE = 20_000
#: Children of a node, levels below the root that the sample makes, and rows of a sample that a node needs to be split.
BRANCHES, LEVELS, LEAF = 16, 2, 16
#: A leaf with more rows is split on a sample of its own of so many, level by level, while there are fewer leaves than MOST_LEAVES.
LEAF_ROWS, LEAF_SAMPLE, MOST_LEAVES = 8192, 1024, 1 << 16
#: Queries whose exact neighbours calibrate the traversal, and the recall they must reach.
PROBES, RECALL = 200, 0.97
#: Vectors of a leaf in one block, queries that are sent on together, and bytes of queries that meet a block in one task.
BLOCK, QUERIES, GROUP_BYTES = 4096, 1024, 32 << 20


class Tree:
    """Nodes with centres; leaves are numbered.  ``lift`` turns inner products into distances."""

    def __init__(self, sample: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.lift = float(np.sqrt((sample**2).sum(1).max())) if len(sample) else 1.0
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(self.lifted(sample), rng)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """One more coordinate, that makes all lengths alike: then the nearest is the one with the largest inner product."""
        rest = np.sqrt(np.maximum(0, self.lift**2 - (x**2).sum(1)))
        return np.column_stack([x, rest])

    def _node(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    def _grow(self, x: np.ndarray, rng) -> None:
        todo = [(self._node(x.mean(0) if len(x) else np.zeros(x.shape[1])), np.arange(len(x)), 0)]
        while todo:
            node, own, level = todo.pop()
            parts = split(x[own], rng) if len(own) > LEAF and level < LEVELS else None
            if parts is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for k in range(parts.max() + 1):
                child = self._node(x[own[parts == k]].mean(0))
                self.children[node].append(child)
                todo.append((child, own[parts == k], level + 1))

    def widened(self, leaf: int, centres: np.ndarray) -> None:
        """Put children below a leaf: the first takes its number, the others new ones."""
        node = self.leaf.index(leaf)
        self.leaf[node] = -1
        for k, centre in enumerate(centres):
            child = self._node(centre)
            self.children[node].append(child)
            self.leaf[child] = leaf if k == 0 else self.leaves
            self.leaves += k > 0

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at each node."""
        x, out = self.lifted(x), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
                continue
            c = np.stack([self.centres[k] for k in self.children[node]])
            near = (x[own] @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
            todo += [(child, own[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visits(self, q: np.ndarray, counts: np.ndarray, leaves: int, rows: int) -> list[int]:
        """Leaves in best-bin-first order: at least ``leaves`` that hold rows, and on until they hold ``rows``."""
        q = np.append(q, 0.0) / (np.sqrt((q**2).sum()) or 1.0) * self.lift  # at the length of the indexed vectors
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < leaves or held < rows):
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                if counts[self.leaf[node]]:
                    out.append(self.leaf[node])
                    held += int(counts[self.leaf[node]])
                continue
            d = np.stack([self.centres[c] for c in self.children[node]]) - q
            for pair in zip((d * d).sum(1).tolist(), self.children[node]):
                heapq.heappush(heap, pair)
        return out


def split(x: np.ndarray, rng) -> np.ndarray | None:
    """Parts of k-means; None if the rows don't come apart (copies)."""
    centres = x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)]
    for _ in range(10):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        used = np.unique(near)
        centres = np.stack([x[near == k].mean(0) for k in used])
    near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
    used, near = np.unique(near, return_inverse=True)
    return near if len(used) > 1 else None


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, none with nulls, as rows."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(queries, qid, vectors, vid, k):
    """The k largest inner products of each query with the vectors: (query, vector, score) arrays; ties to the smaller id."""
    if not len(vid) or not len(qid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rough = queries @ vectors.T
    rough[qid[:, None] == vid[None, :]] = -np.inf
    cut = np.partition(rough, len(vid) - k, axis=1)[:, len(vid) - k] if len(vid) > k else np.full(len(qid), -np.inf)
    # sums of a matrix product depend on the place: whatever is as large as the k-th but for rounding is summed anew
    a, b = np.nonzero((rough >= cut[:, None] - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(cut), cut, 0)))[:, None]) & np.isfinite(rough))
    score = np.concatenate([(queries[a[i : i + 65536]] * vectors[b[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    order = np.lexsort((vid[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    a, b, score = a[rank < k], b[rank < k], score[rank < k]
    return qid[a], vid[b], score


def usable(vector) -> F.Column:
    """Vectors with no part in a search: null, empty, zero, or with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of ``vectors`` for each key of ``queries``, by inner product in double precision.

    Returns query_id, rank, vec_id, score.  Both tables have ``key`` (an integer) and ``vector``; a
    row never finds its own key.  Scores are exact; what is approximate is which
    leaves are looked into.  Their number is widened until PROBES of the queries,
    held against all rows, reach RECALL; if it ends at all leaves, the search is exact.
    A query goes on to further leaves until they hold more than k rows.

    The tree is begun on a sample; leaves with over LEAF_ROWS rows are split on rows of their own, so their number
    grows with the table, to MOST_LEAVES.  Rows of leaves that stay large for holding copies are reduced to those of
    each vector that can be found at all (the k + 1 smallest keys).  A leaf is cut into blocks of about BLOCK rows by a hash of
    the key.  A query is sent to the blocks of the leaves that it visits and to no others; where more than
    GROUP_BYTES of queries meet a leaf, its blocks are met by several groups of them.

    Unusable vectors and null keys take no part, nor do vectors of another length than most have.
    A repeated key is a candidate as often as it occurs.  A key that ``queries`` repeats is one query, with the
    smallest of its vectors (by their components in turn).  Ties go to the smaller key.  Empty tables give no rows.
    """
    pick = lambda df: df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    vectors, queries = pick(vectors), pick(queries)
    schema = "query_id long, rank int, vec_id long, score double"
    by_hash = [F.xxhash64("id"), F.col("id")]
    sample = vectors.orderBy(*by_hash).limit(SAMPLE).select("id", "v").toArrow().combine_chunks()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    lists = sample.column("v").combine_chunks()
    sizes, times = np.unique(lists.value_lengths().to_numpy(), return_counts=True)
    dim = int(sizes[times.argmax()])
    vectors = vectors.where(F.size("v") == dim)
    # many tasks, however few bytes: the tree is walked for each query
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = cut(spark, queries.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")).repartition(partitions, "id"))
    tree = Tree(_matrix(lists.filter(pa.array(lists.value_lengths().to_numpy() == dim))))
    placed, counts, paths = _placed(spark, vectors, tree, k)
    leaves = _calibrated(spark, placed, queries, tree, counts, k)
    blocks = np.maximum(1, -(-counts // BLOCK))
    shared = spark.sparkContext.broadcast((tree, leaves, counts))

    def visit(batches):
        """For each leaf, the queries of a batch that look into it, as one row."""
        tree, leaves, counts = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(i, QUERIES)
                ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1))
                by: dict[int, list[int]] = {}
                for row, one in enumerate(q):
                    for leaf in tree.visits(one, counts, leaves, k + 1):
                        by.setdefault(int(leaf), []).append(row)
                if by:
                    cols = [pa.array(list(by), pa.int32()), pa.array([len(own) for own in by.values()], pa.int64())]
                    cols += [pa.array([x[own].tobytes() for own in by.values()], pa.binary()) for x in (ids, q)]
                    yield pa.RecordBatch.from_arrays(cols, names=["leaf", "n", "ids", "vectors"])

    asked, asked_at = written(spark, queries.mapInArrow(visit, "leaf int, n long, ids binary, vectors binary"), "visits")
    visits = np.zeros(tree.leaves, np.int64)
    for r in asked.groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # one row a leaf
        visits[r["leaf"]] = r["n"]
    groups = np.maximum(1, -(-visits * dim * 8 // GROUP_BYTES))
    plan = spark.sparkContext.broadcast({"block": blocks, "grp": groups})

    def dealt(rows: DataFrame, own: str, other: str, *by: str) -> DataFrame:
        """A row's own part of its leaf, by a hash, and a copy for each part of the other side."""

        @F.pandas_udf("struct<own:int,others:int>")
        def parts(leaf: pd.Series, h: pd.Series) -> pd.DataFrame:
            of = leaf.to_numpy()
            return pd.DataFrame({"own": (h.to_numpy() % plan.value[own][of]).astype(np.int32), "others": plan.value[other][of].astype(np.int32)})

        rows = rows.withColumn("p", parts("leaf", F.pmod(F.xxhash64(*by), F.lit(1 << 31))))
        return rows.withColumn(own, F.col("p.own")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("p.others") - 1))).drop("p")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        vid, vectors, out = left["id"].to_numpy(), np.stack(left["v"]), []
        for ids, raw in zip(right["ids"], right["vectors"]):
            out.append(_best(np.frombuffer(raw, np.float64).reshape(-1, dim), np.frombuffer(ids, np.int64), vectors, vid, k))
        return pd.DataFrame({"q": np.concatenate([x[0] for x in out]), "id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    by = ["leaf", "block", "grp"]
    rows, asked = dealt(placed, "block", "grp", "id"), dealt(asked.drop("n"), "grp", "block", "ids")
    found = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(search, "q long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id")))).where(F.col("rank") <= k)
    out = cut(spark, ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"))
    removed(spark, asked_at, *paths)  # what follows reads the checkpoint alone
    return out


def _counts(placed: DataFrame, tree: Tree) -> np.ndarray:
    counts = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row a leaf
        counts[r["leaf"]] = r["count"]
    return counts


def _placed(spark: SparkSession, vectors: DataFrame, tree: Tree, k: int) -> tuple[DataFrame, np.ndarray, list[str]]:
    """(id, v, leaf), the rows of each leaf, and the tables' places; ``tree`` grows until its leaves are small or won't come apart."""

    def place(tree):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tree.value.leaf_of(_matrix(batch.column(1))))], names=["id", "v", "leaf"])

        return run

    schema = "id long, v array<double>, leaf int"
    placed, path = written(spark, vectors.mapInArrow(place(spark.sparkContext.broadcast(tree)), schema), "leaves")
    paths, counts, whole = [path], _counts(placed, tree), set()
    while True:
        large = [int(x) for x in np.flatnonzero(counts > LEAF_ROWS) if int(x) not in whole]
        large = large[: max(0, MOST_LEAVES - tree.leaves) // (BRANCHES - 1)]
        if not large:
            break
        shared = spark.sparkContext.broadcast(tree)

        def centres(part: pd.DataFrame) -> pd.DataFrame:
            leaf = int(part["leaf"].iloc[0])
            x = shared.value.lifted(np.stack(part["v"]))
            parts = split(x, np.random.default_rng(leaf))
            if parts is None:
                return pd.DataFrame({"leaf": [leaf], "centres": [b""]})
            return pd.DataFrame({"leaf": [leaf], "centres": [np.stack([x[parts == i].mean(0) for i in range(parts.max() + 1)]).tobytes()]})

        asked = spark.createDataFrame([(x,) for x in large], "leaf int")  # MOST_LEAVES at most
        rows = placed.join(F.broadcast(asked), "leaf")
        order = Window.partitionBy("leaf").orderBy(F.xxhash64("id"), "id")
        own = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEAF_SAMPLE).orderBy("leaf", "r").groupBy("leaf").applyInPandas(centres, "leaf int, centres binary")
        width = len(tree.centres[0])
        for r in sorted(own.collect()):  # BRANCHES centres a leaf
            if r["centres"]:
                tree.widened(r["leaf"], np.frombuffer(r["centres"], np.float64).reshape(-1, width))
            else:
                whole.add(r["leaf"])
        placed, path = written(spark, placed.mapInArrow(place(spark.sparkContext.broadcast(tree)), schema), "leaves")
        removed(spark, paths.pop())
        paths.append(path)
        counts = _counts(placed, tree)
    hot = [int(x) for x in np.flatnonzero(counts > 2 * LEAF_ROWS)]
    if hot:
        # of equal vectors only those with the smallest keys are ever found; Spark drops the others before they are shuffled
        these = spark.createDataFrame([(x,) for x in hot], "leaf int")
        first = F.row_number().over(Window.partitionBy("leaf", "v").orderBy("id"))
        some = placed.join(F.broadcast(these), "leaf", "left_semi").withColumn("r", first).where(F.col("r") <= k + 1).select("id", "v", "leaf")
        placed, path = written(spark, placed.join(F.broadcast(these), "leaf", "left_anti").select("id", "v", "leaf").union(some), "leaves")
        removed(spark, paths.pop())
        paths.append(path)
        counts = _counts(placed, tree)
    return placed, counts, paths


def _calibrated(spark, placed: DataFrame, queries: DataFrame, tree: Tree, counts: np.ndarray, k: int) -> int:
    """Leaves to visit: as many as the probes' recall against all rows asks for."""
    probes = queries.orderBy(F.xxhash64("id"), "id").limit(PROBES).toArrow().combine_chunks()
    if not probes.num_rows:
        return 1
    qid, q = probes.column("id").to_numpy(), _matrix(probes.column("v").combine_chunks())
    ask = spark.sparkContext.broadcast((qid, q))

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                vid, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                a, b, s = _best(ask.value[1], ask.value[0], _matrix(batch.column(1)), vid, k)
                where = dict(zip(vid.tolist(), leaf.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array([where[x] for x in b.tolist()], pa.int32())], names=["q", "id", "score", "leaf"])

    best = placed.mapInArrow(exact, "q long, id long, score double, leaf int")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).where(F.col("r") <= k)
    needed: dict[int, list[int]] = {}
    for r in best.select("q", "leaf").collect():  # PROBES * k rows
        needed.setdefault(r["q"], []).append(r["leaf"])
    orders = {int(i): {leaf: n for n, leaf in enumerate(tree.visits(v, counts, tree.leaves, 0))} for i, v in zip(qid, q)}
    places = np.array([orders[i][leaf] for i, own in needed.items() for leaf in own])
    if not len(places):
        return 1
    # widen leaf by leaf until the share of the true neighbours that lie in visited leaves reaches RECALL
    return int(np.sort(places)[max(0, int(np.ceil(RECALL * len(places))) - 1)]) + 1
