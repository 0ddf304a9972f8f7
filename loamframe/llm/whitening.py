"""Whitening of embeddings from a covariance summed in tiles.

The fit list holds each distinct integer vector once.  Its vectors, less their rounded means, are cut into column
blocks of TILE dimensions; a pair of blocks is a tile.  Column blocks are dealt out by their block of rows, so that
the two of a tile meet in a join, are multiplied there, and the products are summed per tile: map-side first, then by a shuffle
of (tile, place).  One task per length of vectors assembles the tiles, of the dimension's square only, corrects them by what the rounded
means left out, and takes the eigenvectors.

All sums of integers are exact: sums per dimension are decimals, and products of values less their rounded means stay below 2^53, where
doubles are integers, for all but extreme values.  So results do not depend on how rows were dealt out.

Defined results: vectors that are null or hold null or non-finite components are dropped; vectors of each length are whitened by
themselves; repeated rows and equal vectors count once in the fit and are all whitened; null ids are whitened too; a component whose
eigenvalue is not above the rounding of the largest one has whitened null and is left out of identity_error, which is null if no component is left;
empty vectors have no component and give no row; an empty table gives no rows; entries whose integer does not fit a long stop the query, as casts do in Spark; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamframe.llm.kernels import in_batches, ragged
from loamframe.llm.topk import packed
from loamframe.storage import Scratch, written

#: Dimensions of a column block; rows of a block of rows, at most.
TILE, BLOCK_ROWS = 32, 4096
#: Tiles that a task sums up before it passes them on, at most.
HELD = 4096
#: Models of up to so many bytes are broadcast; beyond that rows meet them in a salted join.
BROADCAST_BYTES, SALTS = 64 << 20, 256
#: Eigenvalues up to this share of the largest one, times the dimensions, are zero.
ZERO = np.finfo(np.float64).eps


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the batch's vectors x of each length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        x = batch.column("x").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
        yield dim, own, x.reshape(len(own), dim)


class Known:
    """Models by length: from a broadcast, or else from the columns of the rows themselves."""

    def __init__(self, shared: Broadcast | None, columns: tuple[str, ...]):
        self.shared, self.columns = shared, columns

    def of(self, batch: pa.RecordBatch, dim: int, row: int) -> dict:
        if self.shared is not None:
            return self.shared.value[dim]
        return {c: batch.column(c)[row].as_py() for c in self.columns}


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of rows and exact sums per dimension of a batch."""
    for batch in batches:
        for dim, own, x in _by_length(batch):
            if dim:
                top = max(int(x.max()), -int(x.min())) * len(x)
                total = x.sum(axis=0) if top < 1 << 63 else x.astype(object).sum(axis=0)
                values = pa.array([int(v) for v in total], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(own)], pa.int64()), ragged(values, np.array([dim]))], ["dim", "n", "sums"])


def _column_blocks(batches: Iterator[pa.RecordBatch], tile: int, known: Known) -> Iterator[pa.RecordBatch]:
    """Vectors less their middle, cut into column blocks per block of rows."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for dim, own, x in _by_length(batch):
            if not dim:
                continue
            y = x - np.array(known.of(batch, dim, int(own[0]))["middle"], dtype=np.int64)
            for top in range(0, len(y), BLOCK_ROWS):
                number += 1
                for col, left in enumerate(range(0, dim, tile)):
                    part = y[top : top + BLOCK_ROWS, left : left + tile]
                    kind, body = packed(part)
                    row = [pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([col], pa.int32()), pa.array([part.shape[1]], pa.int32()), pa.array([kind]), pa.array([body])]
                    yield pa.RecordBatch.from_arrays(row, ["dim", "rows", "col", "width", "kind", "body"])


def _tile_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of two column blocks of one block of rows, one per row of the join, summed per tile as far as HELD tiles reach."""
    sums: dict[tuple[int, int, int], np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys = np.array(list(sums), dtype=np.int32).reshape(-1, 3)
        tiles = ragged(np.concatenate([t.ravel() for t in sums.values()]), np.array([t.size for t in sums.values()]))
        sums.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(keys[:, k].copy()) for k in range(3)), tiles], ["dim", "a", "b", "tile"])

    for batch in batches:
        for r in range(batch.num_rows):
            at = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            a, b = (np.frombuffer(at[f"{c}_body"], dtype=at[f"{c}_kind"]).reshape(-1, at[f"{c}_width"]).astype(np.float64) for c in "ab")
            key = at["dim"], at["a"], at["b"]
            sums[key] = sums[key] + a.T @ b if key in sums else a.T @ b
            if len(sums) >= HELD:
                yield flush()
    if sums:
        yield flush()


def _components(group: pd.DataFrame, tile: int, most: int) -> pd.DataFrame:
    """The model of one length: components by falling eigenvalue, each with its largest entry above zero."""
    dim, n = int(group["dim"].iloc[0]), int(group["n"].iloc[0])
    sums, middle = group["sums"].iloc[0], group["middle"].iloc[0]
    total = np.zeros((dim, dim))
    for a, b, places, values in group[["a", "b", "places", "products"]].itertuples(index=False):
        width = min(tile, dim - b * tile)
        i, j = a * tile + np.asarray(places) // width, b * tile + np.asarray(places) % width
        total[i, j] = values
        total[j, i] = values
    rest = np.array([(int(s) - n * int(m)) / n for s, m in zip(sums, middle)])
    cov = total / n - np.outer(rest, rest)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(dim), np.abs(vectors).argmax(axis=1)])[:, None]
    trace = float(np.trace(cov))
    kept = min(most, dim)
    useful = values[:kept] > ZERO * dim * values[0]
    return pd.DataFrame(
        {
            "dim": [dim],
            "n": [n],
            "sums": [[int(s) for s in sums]],
            "eigenvalues": [np.where(useful, values[:kept], 0.0).tolist()],
            "explained": [(np.where(useful, values[:kept], 0.0) / trace).tolist() if trace > 0 else [0.0] * kept],
            "vectors": [vectors[:kept].ravel().tolist()],
        }
    )


MODEL = "dim int, n long, sums array<decimal(38,0)>, eigenvalues array<double>, explained array<double>, vectors array<double>"


def _deviations(x: np.ndarray, n: int, sums: list) -> tuple[np.ndarray, pa.Array]:
    """(n * x - S) / n as doubles and the exact sum of (n * x - S)^2 of each row."""
    dim = x.shape[1]
    top = n * max((int(np.abs(x).max()) if x.size else 0), 1) * 2
    narrow = top < 1 << 62 and all(abs(s) < 1 << 62 for s in sums)
    d = x * n - np.array(sums, dtype=np.int64) if narrow else x.astype(object) * n - np.array(sums, dtype=object)
    most = int(np.abs(d).max()) if d.size else 0
    if d.dtype == object or most * most * dim >= 1 << 63:
        wide = d.astype(object)
        squares = pa.array([int(v) for v in (wide * wide).sum(axis=1)], pa.decimal128(38, 0))
    else:
        squares = pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    return d.astype(np.float64) / n, squares


def _project(batches: Iterator[pa.RecordBatch], known: Known) -> Iterator[pa.RecordBatch]:
    """Deviation and whitened components of rows."""
    for batch in batches:
        for dim, own, x in _by_length(batch):
            if not dim:
                continue
            white, squares = _whitened(x, known.of(batch, dim, int(own[0])))
            values = ragged(pa.array(white.ravel(), from_pandas=True), np.full(len(x), white.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(np.full(len(x), dim, dtype=np.int32)), squares, values], ["id", "dim", "deviation", "whitened"])


def _whitened(x: np.ndarray, model: dict) -> tuple[np.ndarray, pa.Array]:
    values = np.array(model["eigenvalues"])
    vectors = np.array(model["vectors"]).reshape(len(values), x.shape[1])
    centred, squares = _deviations(x, model["n"], [int(s) for s in model["sums"]])
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(values > 0, 1 / np.sqrt(values), np.nan)
    return (centred @ vectors.T) * scale, squares


def _moments(batches: Iterator[pa.RecordBatch], known: Known) -> Iterator[pa.RecordBatch]:
    """Sums of whitened components and of their products over a batch."""
    for batch in batches:
        for dim, own, x in _by_length(batch):
            if not dim:
                continue
            model = known.of(batch, dim, int(own[0]))
            white, _ = _whitened(x, model)
            white = white[:, np.array(model["eigenvalues"]) > 0]
            flat = np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([model["n"]], pa.int64()), ragged(flat, np.array([len(flat)]))], ["dim", "n", "flat"])


def _identity_error(group: pd.DataFrame) -> pd.DataFrame:
    n, flat = int(group["n"].iloc[0]), np.zeros(len(group))
    flat[group["pos"].to_numpy()] = group["value"]
    k = (round((1 + 4 * len(flat)) ** 0.5) - 1) // 2
    mean = flat[:k] / n
    error = float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()) if k else None
    return pd.DataFrame({"dim": group["dim"].iloc[:1], "identity_error": [error]})


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "x", tile: int = TILE) -> DataFrame:
    """Per row of integer vectors: id, dim, n, deviation (decimal), whitened and explained (arrays by component), identity_error."""
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.table(vectors.select(F.col(id_col).alias("id"), F.size(vector_col).alias("dim"), F.col(vector_col).alias("x")), "vectors")
        fit = scratch.table(rows.select("dim", "x").distinct(), "fit")
        parts = in_batches(fit, _sums, "dim int, n long, sums array<decimal(38,0)>").select("dim", "n", F.posexplode("sums").alias("pos", "sum"))
        cells = parts.groupBy("dim", "pos").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
        sums = cells.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "sum"))).getField("sum").alias("sums"))
        sums = scratch.table(sums.withColumn("middle", F.transform("sums", lambda s: F.round(s / F.col("n")).cast("long"))), "sums")
        blocks = _with_models(scratch, fit, sums.select("dim", "middle"), partial(_column_blocks, tile=tile), "dim int, rows long, col int, width int, kind string, body binary")
        left, right = (blocks.select("dim", "rows", F.col("col").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("width", "kind", "body")]) for c in "ab")
        pairs = left.join(right, ["dim", "rows"]).where("a <= b").drop("rows")
        tiles = in_batches(pairs, _tile_products, "dim int, a int, b int, tile array<double>")
        tiles = tiles.select("dim", "a", "b", F.posexplode("tile").alias("place", "product")).groupBy("dim", "a", "b", "place").agg(F.sum("product").alias("product"))
        tiles = tiles.groupBy("dim", "a", "b").agg(F.collect_list("place").alias("places"), F.collect_list("product").alias("products"))
        models = tiles.join(sums, "dim").groupBy("dim").applyInPandas(partial(_components, tile=tile, most=components), MODEL)
        models = scratch.table(models, "models")
        moments = _with_models(scratch, fit, models.drop("explained"), _moments, "dim int, n long, flat array<double>")
        moments = moments.select("dim", "n", F.posexplode("flat").alias("pos", "value")).groupBy("dim", "n", "pos").agg(F.sum("value").alias("value"))
        errors = moments.groupBy("dim").applyInPandas(_identity_error, "dim int, identity_error double")
        known = scratch.table(models.select("dim", "n", "explained").join(errors, "dim", "left"), "known")
        found = _with_models(scratch, rows, models.drop("explained"), _project, f"id {rows.schema['id'].dataType.simpleString()}, dim int, deviation decimal(38,0), whitened array<double>")
        found = _joined(found, known)
        return written(found.withColumnRenamed("id", id_col), "whitened")


def _bytes(models: DataFrame) -> int:
    """What models take, each entry at 16 bytes."""
    entries = [F.size(c) if kind.startswith("array") else F.lit(1) for c, kind in models.dtypes]
    return 16 * (models.agg(F.sum(reduce(add, entries))).first()[0] or 0)


def _with_models(scratch: Scratch, rows: DataFrame, models: DataFrame, work, schema: str) -> DataFrame:
    """Work on batches of rows with the models of their lengths."""
    columns = tuple(models.columns)
    if _bytes(models) <= BROADCAST_BYTES:
        shared = scratch.broadcast({m["dim"]: m.asDict() for m in models.collect()})
        return in_batches(rows, partial(work, known=Known(shared, columns)), schema)
    return in_batches(_joined(rows, models), partial(work, known=Known(None, columns)), schema)


def _joined(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with their models' columns; lengths without a model have none of their rows here."""
    if _bytes(models) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(models), "dim")
    salted = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["dim", "_salt"]).drop("_salt")
