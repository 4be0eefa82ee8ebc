"""Toxicity by non-negative positive-unlabelled learning with numpy classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut, mix64, tidied, utf8, word_hashes, word_spans, word_table

#: Bounds of the fitting sample: confirmed examples and unlabelled texts, and telling features of each (those that tell most).
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 4000, 10000, 2048
#: Hashed features: whole words, and their first 4, 5 and 7 bytes.
BITS, PREFIXES = 20, (4, 5, 7)
CUT = 0.7
#: Bytes of text whose features are worked out at a time (or one text).
_CHUNK = 1 << 20
_SIZE = 1 << BITS
FOLDS = (0, 2)


def fold(doc_id: Column) -> Column:
    """0, 1 or 2: crc32 of the id as text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and word beginning, with repeats."""
    data, offs = utf8(column)
    s, e, doc = word_spans(data, offs, word_table("alnum"))
    parts = [word_hashes(data, s, e)]
    for n in PREFIXES:
        parts.append(mix64(word_hashes(data, s, np.minimum(e, s + n)) + np.uint64(n)))
    return np.tile(doc, len(parts)), (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def _dedup(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc.astype(np.int64) << BITS | feature)
    return both >> BITS, both & (_SIZE - 1)


def _log1pexp(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def excess(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The risk on negatives as far as positives don't explain it: it is 0 or more but for overfitting."""
    return float(_log1pexp(fu).mean() - prior * _log1pexp(fp).mean())


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The non-negative risk of scores of positives and unlabelled, with the logistic loss."""
    return float(prior * _log1pexp(-fp).mean() + max(0.0, excess(fp, fu, prior)))


def gradients(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the risk by each score; where the excess is below zero, of the excess turned round."""
    sp, su = (1 / (1 + np.exp(-np.clip(f, -30, 30))) for f in (fp, fu))
    if excess(fp, fu, prior) >= 0:
        return -prior * np.ones(len(fp)) / len(fp), su / len(fu)
    return prior * sp / len(fp), -su / len(fu)


class Fit:
    """A linear classifier over hashed features, trained on the non-negative risk.

    The risk is ``prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])``
    with the logistic loss.  Where the second part of a batch falls below zero its
    gradient is reversed, which keeps the classifier from fitting the
    unlabelled toxic texts.
    """

    def __init__(self, rows: list[np.ndarray], positive: np.ndarray, known: np.ndarray, prior: float, epochs=40, batch=1024, rate=0.05, shrink=2e-4, seed=0):
        """``rows``: each text's distinct features; those not in ``known`` (sorted) play no part."""
        n, self.known = len(rows), known
        place = np.full(_SIZE, -1, np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        kept = [(c := place[row])[c >= 0] for row in rows]
        col = np.concatenate(kept) if kept else np.zeros(0, np.int32)
        first = np.concatenate([[0], np.cumsum([len(c) for c in kept])]).astype(np.int64)
        del kept, place
        w, bias = np.zeros(len(self.known)), float(np.log(prior / (1 - prior)))
        m, v, mb, vb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
        rng = np.random.default_rng(seed)
        pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
        for epoch in range(epochs):
            pos, unl = rng.permutation(pos), rng.permutation(unl)
            parts = max(1, n // batch)
            for a, b in zip(np.array_split(pos, parts), np.array_split(unl, parts)):
                if not len(a) or not len(b):
                    continue
                rows = np.concatenate([a, b])
                at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows]) if len(rows) else np.zeros(0, int)
                own = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
                f = bias + np.bincount(own, weights=w[col[at]], minlength=len(rows))
                g = np.concatenate(gradients(f[: len(a)], f[len(a) :], prior))
                grad, gb, step = np.bincount(col[at], weights=g[own], minlength=len(w)), float(g.sum()), step + 1
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                c1, c2 = 1 - 0.9**step, 1 - 0.999**step
                w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
                w = np.sign(w) * np.maximum(0, np.abs(w) - rate * shrink * 10)
                bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        self.w, self.bias = w, bias

    def weights(self) -> np.ndarray:
        out = np.zeros(_SIZE)
        out[self.known] = self.w
        return out


def telling(up: np.ndarray, un: np.ndarray, n_pos: int, n_unl: int) -> np.ndarray:
    """How many deviations apart a feature's rates among positives and unlabelled are; 0 where it says nothing.

    ``up`` and ``un`` count the texts that have it; three deviations and three texts are the least that says something.
    """
    both = (up + un) / max(1, n_pos + n_unl)
    z = np.abs(up / max(1, n_pos) - un / max(1, n_unl)) / np.sqrt(np.maximum(1e-12, both * (1 - both) * (1 / max(1, n_pos) + 1 / max(1, n_unl))))
    return np.where((z > 3) & (up + un >= 3), z, 0.0)


class Model:
    """The mean of the folds' classifiers, moved so that the best cut found out of fold scores CUT."""

    def __init__(self, weights: np.ndarray, bias: float, cut: float, scale: float):
        self.weights, self.bias, self.cut, self.scale = weights.astype(np.float32), bias, cut, scale

    def score(self, column: pa.Array) -> np.ndarray:
        doc, feature = features(column)
        keep = self.weights[feature] != 0
        doc, feature = _dedup(doc[keep], feature[keep])
        f = self.bias + np.bincount(doc, weights=self.weights[feature], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(np.log(CUT / (1 - CUT)) + (f - self.cut) * self.scale, -30, 30)))


def _best_cut(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap it lies in."""
    order = np.argsort(-f, kind="stable")
    f, y, weight = f[order], y[order], weight[order]
    tp, fp = np.cumsum(weight * y), np.cumsum(weight * (1 - y))
    f1 = 2 * tp / (tp + fp + (weight * y).sum())
    f1[:-1][f[:-1] == f[1:]] = 0
    k = int(np.argmax(f1))
    return float((f[k] + f[min(k + 1, len(f) - 1)]) / 2)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model | None:
    """Fit on a bounded sample: MOST_POSITIVE confirmed toxic rows and MOST_UNLABELLED rows of any kind.

    Both samples are the rows with the smallest hash of their id, from folds 0 and 2
    alone, so reruns agree; of rows with the same id it is the one with the smallest text.  Each fold trains a classifier, the other
    fold's labelled rows set its cut, and the model takes the mean of both.  The class prior is the
    share of toxic labels in the two folds.  None if there is no toxic label to learn from.

    Executors count how many texts have each feature; from the counts (of _SIZE features) the driver chooses the telling ones,
    and of each text it then gets these alone, MOST_FEATURES at most: what it holds does not grow with the texts.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{toxic}`").alias("y")).where("i IS NOT NULL AND y IN (0, 1)").groupBy("i").agg(F.max("y").alias("y")).where(fold(F.col("i")) != 1)
    prior = marks.select(F.avg("y")).first()[0]
    if not prior:
        return None
    prior = min(max(float(prior), 1e-3), 0.5)
    order = [F.xxhash64("i"), F.col("i")]
    chosen = marks.where("y = 1").orderBy(*order).limit(MOST_POSITIVE).select("i", F.lit(1).alias("kind"))
    others = docs.select(F.col(f"`{doc_id}`").alias("i")).where("i IS NOT NULL").where(fold(F.col("i")) != 1).distinct().orderBy(*order).limit(MOST_UNLABELLED).select("i", F.lit(0).alias("kind"))
    chosen = chosen.union(others).groupBy("i").agg(F.max("kind").alias("positive"), F.min("kind").alias("unlabelled"))
    chosen = chosen.select("i", (F.col("positive") == 1).alias("positive"), (F.col("unlabelled") == 0).alias("unlabelled"))
    chosen = chosen.join(marks, "i", "left").select("i", "positive", "unlabelled", "y", fold(F.col("i")).alias("fold"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("d"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    # bounded: MOST_POSITIVE + MOST_UNLABELLED ids
    rows = rows.join(F.broadcast(chosen), F.col("d") == F.col("i")).groupBy("i", "positive", "unlabelled", "y", "fold").agg(F.min("t").alias("t"))

    def extract(batches):
        for batch in batches:
            for i, j in chunks(batch.column(5), _CHUNK):
                part = batch.slice(i, j - i)
                doc, feature = _dedup(*features(part.column(5)))
                first = np.searchsorted(doc, np.arange(j - i + 1))
                blobs = [feature[first[k] : first[k + 1]].astype("<u4").tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(blobs, type=pa.binary())], names=["i", "positive", "unlabelled", "y", "fold", "f"])

    sample = cut(spark, rows.mapInArrow(tidied(extract), T.StructType([*rows.schema.fields[:5], T.StructField("f", T.BinaryType())])))

    def count(batches):
        """(fold, feature, texts among the positives, texts among the unlabelled), a task's own sums."""
        sums = np.zeros((len(FOLDS), 2, _SIZE), np.int32)
        for batch in batches:
            for positive, unlabelled, own, f in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)), batch.column(5)):
                at = np.frombuffer(f.as_buffer(), "<u4")
                for kind, has in enumerate((positive, unlabelled)):
                    if has:
                        sums[FOLDS.index(own), kind, at] += 1
        for k, own in enumerate(FOLDS):
            have = np.flatnonzero(sums[k].any(0))
            if len(have):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(have), own, np.int32)), pa.array(have), *(pa.array(x[have].astype(np.int64)) for x in sums[k])], names=["fold", "feature", "up", "un"])

    sizes = {r["fold"]: (r["up"], r["un"]) for r in sample.groupBy("fold").agg(F.sum(F.col("positive").cast("int")).alias("up"), F.sum(F.col("unlabelled").cast("int")).alias("un")).collect()}
    counted = sample.mapInArrow(tidied(count), "fold int, feature long, up long, un long").groupBy("fold", "feature").agg(F.sum("up").alias("up"), F.sum("un").alias("un"))
    tells = {own: np.zeros(_SIZE) for own in sizes}
    table = counted.where("up + un >= 3").toArrow()  # _SIZE features of two folds at most
    at = table.column("fold").to_numpy()
    for own in sizes:
        up, un = np.zeros((2, _SIZE))
        mine = table.column("feature").to_numpy()[at == own]
        up[mine], un[mine] = (table.column(c).to_numpy()[at == own] for c in ("up", "un"))
        tells[own] = telling(up, un, *sizes[own])
    most = spark.sparkContext.broadcast(np.max([np.zeros(_SIZE), *tells.values()], axis=0).astype(np.float32))  # _SIZE floats

    def reduced(batches):
        for batch in batches:
            out = []
            for f in batch.column(5):
                own = np.frombuffer(f.as_buffer(), "<u4")
                own = own[most.value[own] > 0]
                if len(own) > MOST_FEATURES:
                    own = np.sort(own[np.lexsort((own, -most.value[own]))[:MOST_FEATURES]])
                out.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=batch.schema.names)

    table = sample.mapInArrow(tidied(reduced), sample.schema).toArrow().sort_by("i").combine_chunks()
    positive, unlabelled = (table.column(c).to_numpy() for c in ("positive", "unlabelled"))
    folds, y = table.column("fold").to_numpy(), table.column("y").fill_null(-1).to_numpy()
    texts = [np.frombuffer(f.as_buffer(), "<u4") for f in table.column("f")]
    fits, values, truth = [], [], []
    for own in FOLDS:
        # a text that is both is drawn on as each
        drawn = [(k, kind) for k in np.flatnonzero(folds == own) for kind, has in ((True, positive), (False, unlabelled)) if has[k]]
        kinds = np.array([kind for _, kind in drawn], bool)
        if not kinds.any() or kinds.all():
            continue
        one = Fit([texts[k] for k, _ in drawn], kinds, np.flatnonzero(tells[own]), prior, seed=own)
        fits.append(one)
        w = one.weights()
        other = [k for k in np.flatnonzero(folds != own) if y[k] >= 0]
        values += [one.bias + w[texts[k]].sum() for k in other]
        truth += [y[k] for k in other]
    if not fits:
        return None
    weights, bias = np.mean([f.weights() for f in fits], axis=0), float(np.mean([f.bias for f in fits]))
    middle = 0.0
    if any(t == 1 for t in truth):
        # positives were chosen apart from the rest: weigh them back to the prior
        yy = np.array(truth, float)
        weight = np.where(yy == 1, prior / max(1, yy.sum()), (1 - prior) / max(1, (1 - yy).sum()))
        middle = _best_cut(np.array(values), yy, weight)
    return Model(weights, bias, middle, 1.0)


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``tox_score`` (0 to 1) and ``tox_predicted`` (1 if the score is CUT or more) to every row.

    The score sees the whole text and nothing else.  Null and empty texts have no
    features and get the score of the bias, which is low; without any toxic label in folds 0 and 2 all
    scores are 0.  Labels that are null, repeated (the largest counts) or of unknown rows do no harm.
    Equal texts get equal scores.  Columns of ``docs`` named like a result are replaced; an empty table stays empty.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("tox_score", "tox_predicted")])
    model = fit(spark, docs, labels, doc_id, text)
    shared = spark.sparkContext.broadcast(model)  # _SIZE floats
    at = docs.columns.index(text)

    def score(batches):
        for batch in batches:
            scores = [np.zeros(batch.num_rows)] if shared.value is None else [np.zeros(0)]
            if shared.value is not None:
                for i, j in chunks(batch.column(at), _CHUNK):
                    scores.append(shared.value.score(batch.column(at).slice(i, j - i)))
            s = np.concatenate(scores)
            cols = [*batch.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "tox_score", "tox_predicted"])

    return docs.mapInArrow(tidied(score), T.StructType([*docs.schema.fields, T.StructField("tox_score", T.DoubleType()), T.StructField("tox_predicted", T.IntegerType())]))
