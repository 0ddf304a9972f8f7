"""Gradient boosted trees for several classes, from histograms of gradients.

Features are cut into bins at quantiles once.  A round grows one tree per class on the gradients of the softmax loss; each level
of the trees is one job: tasks sum gradients and hessians per node, feature and bin, a shuffle brings the sums of a node together, and
only the best split of each node comes to the driver.  A leaf's value is -G / (H + l2), times the rate.

All models of a grid, and of all folds, grow side by side in the same jobs: a row adds to the models that its fold is not
held out of.  Scores are kept with the rows, in a table that each round writes anew, so a lost executor costs one round at most.

Rows without a target are left out; a missing value, or NaN, is below all others.  What a task holds are sums: nodes of a level x features x bins
for each model and class, whatever the number of rows.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.storage import Scratch

#: Bins of a feature, at most; the relative error of their edges' ranks.
BINS, EDGE_ERROR = 32, 0.001


class Options(NamedTuple):
    rounds: int = 20
    depth: int = 6
    rate: float = 0.1
    l2: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1e-3


class Tree:
    """Nodes as in a heap: node i has 2i + 1 (values up to the cut) and 2i + 2 below it; feature -1 marks a leaf."""

    def __init__(self, depth: int):
        self.feature = np.full((1 << depth) - 1, -1, dtype=np.int32)
        self.cut = np.zeros((1 << depth) - 1, dtype=np.int32)
        self.gain = np.zeros((1 << depth) - 1)
        self.value = np.zeros((2 << depth) - 1)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        moving = rows[: len(bins) if len(self.feature) and self.feature[0] >= 0 else 0]
        while len(moving):
            f = self.feature[at[moving]]
            at[moving] = 2 * at[moving] + 1 + (bins[moving, f] > self.cut[at[moving]])
            inner = at[moving] < len(self.feature)
            moving = moving[inner]
            moving = moving[self.feature[at[moving]] >= 0]
        return at


class Model(NamedTuple):
    """Trees by round and class, on values cut at edges."""

    features: list[str]
    classes: list
    edges: list[list[float]]
    rate: float
    trees: list[list[Tree]]

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes)))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.value[tree.nodes(bins)]
        return out

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, side="left")) for c, e in zip(columns, self.edges)]).astype(np.uint8)

    def gains(self) -> dict[str, float]:
        """What each feature's splits have gained, without those of 0."""
        sums = dict.fromkeys(self.features, 0.0)
        for tree in itertools.chain(*self.trees):
            for f, gain in zip(tree.feature.tolist(), tree.gain.tolist()):
                if f >= 0:
                    sums[self.features[f]] += gain
        return {f: g for f, g in sums.items() if g}

    def to_json(self) -> str:
        trees = [[{"feature": t.feature.tolist(), "cut": t.cut.tolist(), "gain": t.gain.tolist(), "value": t.value.tolist()} for t in row] for row in self.trees]
        return json.dumps({"features": self.features, "classes": self.classes, "edges": self.edges, "rate": self.rate, "trees": trees})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)

        def tree(t: dict) -> Tree:
            out = Tree(0)
            out.feature, out.cut = np.array(t["feature"], dtype=np.int32), np.array(t["cut"], dtype=np.int32)
            out.gain, out.value = np.array(t["gain"], dtype=np.float64), np.array(t["value"], dtype=np.float64)
            return out

        return Model(d["features"], d["classes"], d["edges"], d["rate"], [[tree(t) for t in row] for row in d["trees"]])


def _rows(batch: pa.RecordBatch, n_features: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bins, label, fold and scores (row, model, class) of a batch."""
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(n, n_features)
    scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(n, *shape)
    return bins, batch.column("label").to_numpy(), batch.column("fold").to_numpy(), scores


def _gradients(scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - (np.arange(p.shape[1]) == label[:, None]), p * (1 - p)


def _sum_gradients(batches: Iterator[pa.RecordBatch], state: dict, level: int) -> Iterator[pa.RecordBatch]:
    """Sums of gradients and hessians of the open nodes of a level, per feature and bin."""
    s = state
    f, b, first, width = s["n_features"], s["bins"], (1 << level) - 1, 1 << level
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        bins, label, fold, scores = _rows(batch, f, (len(s["models"]), s["classes"]))
        for m, (options, held_out) in enumerate(s["models"]):
            if level > options.depth or m not in s["trees"]:
                continue
            used = np.flatnonzero(fold != held_out)
            g, h = _gradients(scores[used, m], label[used])
            for k, tree in enumerate(s["trees"][m]):
                node = tree.nodes(bins[used]) - first
                here = node >= 0  # rows whose node was closed above stay there
                if not here.any():
                    continue
                cells = ((node[here, None] * f + np.arange(f)) * b + bins[used][here]).ravel()
                part = np.stack([np.bincount(cells, np.repeat(x[here, k], f), width * f * b) for x in (g, h)])
                sums[m, k] = sums[m, k] + part if (m, k) in sums else part
    for (m, k), part in sums.items():
        part = part.reshape(2, width, f * b)
        full = np.flatnonzero(part[1].any(axis=1))
        if len(full):
            same = lambda v: pa.array(np.full(len(full), v, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([same(m), same(k), pa.array(full.astype(np.int32)), pa.array([part[:, n].tobytes() for n in full])], ["m", "k", "node", "sums"])


def _best_splits(batches: Iterator[pa.RecordBatch], state: dict) -> Iterator[pa.RecordBatch]:
    """Each node's sums and its split of the highest gain; ties go to the first feature and bin."""
    sums: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        for *key, body in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(body).reshape(2, state["n_features"], state["bins"])
            sums[tuple(key)] = sums[tuple(key)] + part if tuple(key) in sums else part
    out = []
    for (m, k, node), part in sums.items():
        options = state["models"][m][0]
        g, h = part[:, 0].sum(axis=1)
        (gl, hl) = part.cumsum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / (hl + options.l2) + (g - gl) ** 2 / (h - hl + options.l2) - g**2 / (h + options.l2)
        gain[~((hl >= options.least_weight) & (h - hl >= options.least_weight))] = -np.inf
        feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
        out.append((m, k, node, float(g), float(h), float(gain[feature, cut]), int(feature), int(cut)))
    columns = list(zip(*out)) if out else [[]] * 8
    kinds = (pa.int32(),) * 3 + (pa.float64(),) * 3 + (pa.int32(),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["m", "k", "node", "g", "h", "gain", "feature", "cut"])


def _add_trees(batches: Iterator[pa.RecordBatch], state: dict) -> Iterator[pa.RecordBatch]:
    """Rows with the values of the finished trees added to their scores."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bins, _, _, scores = _rows(batch, state["n_features"], (len(state["models"]), state["classes"]))
        scores = scores.copy()
        for m, trees in state["trees"].items():
            for k, tree in enumerate(trees):
                scores[:, m, k] += state["models"][m][0].rate * tree.value[tree.nodes(bins)]
        flat = pa.array(scores.ravel())
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (scores.shape[1] * scores.shape[2]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "label", "fold")), pa.ListArray.from_arrays(offsets, flat)], ["bins", "label", "fold", "scores"])


def _bin_of(value: Column, edges: list[float]) -> Column:
    """0 for a missing value, else 1 and the number of edges below the value."""
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < value)) if edges else F.lit(0)
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(1 + below)


def fit(df: DataFrame, features: Sequence[str], target: str, grid: Sequence[Options] = (Options(),), folds: int = 0, bins: int = BINS, fold_col: Column | None = None) -> tuple[list[Model], list[float | None]]:
    """A model on all rows for each of the options, and the accuracy of each over the held-out folds (None without folds)."""
    spark = df.sparkSession
    if fold_col is None:
        fold_col = F.pmod(F.xxhash64(*[F.col(c) for c in features]), F.lit(max(1, folds)))
    values = [F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)]
    rows = df.where(F.col(target).isNotNull()).select(F.col(target).alias("target"), *values, fold_col.cast("int").alias("fold"))
    names = [f"f{k}" for k in range(len(features))]
    clean = rows.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names])
    ranks = [k / (bins - 1) for k in range(1, bins - 1)]
    edges = [sorted(set(e)) for e in clean.approxQuantile(names, ranks, EDGE_ERROR)]
    classes = sorted(r[0] for r in rows.select("target").distinct().collect())
    models = [(o, fold) for o in grid for fold in (-1, *range(folds))]
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("target")) - 1
    codes = F.concat(*[F.unhex(F.lpad(F.hex(_bin_of(F.col(c), e)), 2, "0")) for c, e in zip(names, edges)])
    none = F.array_repeat(F.lit(0.0), len(models) * len(classes))
    schema = "bins binary, label int, fold int, scores array<double>"
    state = {"n_features": len(features), "bins": bins, "classes": len(classes), "models": models}
    grown: list[list[list[Tree]]] = [[] for _ in models]
    with Scratch(spark) as scratch:
        data = scratch.table(rows.select(codes.alias("bins"), number.cast("int").alias("label"), "fold", none.alias("scores")), "boosting")
        for turn in range(max(o.rounds for o in grid)):
            state["trees"] = {m: [Tree(o.depth) for _ in classes] for m, (o, _) in enumerate(models) if turn < o.rounds}
            for level in range(1 + max(o.depth for o in grid)):
                if not _grow(data, state, level):
                    break
            data = scratch.table(data.mapInArrow(partial(_add_trees, state=state), schema), "boosting")
            for m, trees in state["trees"].items():
                grown[m].append(trees)
        right = _right(data, state) if folds else {}
    every = folds + 1
    fitted = [Model(list(features), classes, edges, o.rate, grown[k * every]) for k, o in enumerate(grid)]
    return fitted, [right.get(k) for k in range(len(grid))]


def _grow(data: DataFrame, state: dict, level: int) -> bool:
    """Give the nodes of a level their values and, above the last one, their splits; whether any was split."""
    sums = data.mapInArrow(partial(_sum_gradients, state=state, level=level), "m int, k int, node int, sums binary")
    sums = sums.repartition("m", "k", "node")
    split = False
    for r in sums.mapInArrow(partial(_best_splits, state=state), "m int, k int, node int, g double, h double, gain double, feature int, cut int").collect():
        options, tree, at = state["models"][r.m][0], state["trees"][r.m][r.k], (1 << level) - 1 + r.node
        tree.value[at] = -r.g / (r.h + options.l2)
        if level < options.depth and r.gain > options.least_gain:
            tree.feature[at], tree.cut[at], tree.gain[at], split = r.feature, r.cut, r.gain, True
    return split


def _right(data: DataFrame, state: dict) -> dict[int, float]:
    """Share of rows, over all folds, that the model without their fold gets right; by place in the grid."""
    every = 1 + max(f for _, f in state["models"]) + 1
    k = state["classes"]
    hits = []
    for g in range(len(state["models"]) // every):
        own = F.slice("scores", (F.lit(g * every + 1) + F.col("fold")) * k + 1, F.lit(k))
        hits.append(F.avg((F.array_position(own, F.array_max(own)) - 1 == F.col("label")).cast("double")).alias(f"a{g}"))
    return dict(enumerate(data.agg(*hits).first()))


def predicted(model: Model, df: DataFrame, name: str = "predicted") -> DataFrame:
    """df with the class of the highest score and the classes' probabilities."""
    kind = {str: "string", int: "long", float: "double", bool: "boolean"}[type(model.classes[0])]

    @F.pandas_udf(f"{name} {kind}, probabilities array<double>")
    def classify(*columns: pd.Series) -> pd.DataFrame:
        scores = model.scores(model.binned([c.to_numpy(dtype=np.float64) for c in columns]))
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return pd.DataFrame({name: [model.classes[k] for k in scores.argmax(axis=1)], "probabilities": list(p)})

    found = df.withColumn("_p", classify(*[F.col(c).cast("double") for c in model.features]))
    return found.select(*df.columns, f"_p.{name}", "_p.probabilities")


def save(model: Model, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.text(path, wholetext=True).first().value)
