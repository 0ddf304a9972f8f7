"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Vectors are dealt into shards by a hash, about 16 times the root of their number each, so that the copies
of queries that shards need grow slower than the vectors' square.  Each shard becomes one ball tree: nodes
split at the median of the line between two distant points until LEAF vectors are left.  The inner product of
a query q with any vector of a ball with centre c and radius r is at most q.c + |q| r.

Queries are packed into blocks.  A block meets a shard in one row of a join; the tree's nodes are visited by falling bound,
each for the queries whose bound reaches their current kth score only.  Shards are searched in two waves: the first holds a sixteenth
of them, at least one; its kth scores are what the second one starts from, so most of what other shards hold is cut off in
the tree and never leaves its task.

Products are exact: up to 2^53 they are sums of doubles that are integers, up to 2^63 sums of longs, beyond that of Python's
integers; a score that leaves a long stops the query, as arithmetic of longs does in Spark.

Defined results: vectors that are null or hold null or non-finite components take no part; only vectors of one length meet, each
length being searched by itself (empty vectors score 0); a query's own rows, all those with its id, are no candidates of it;
ties go to the smaller id, null ids last; repeated candidates count each; repeated queries are answered once, queries of one id
with several vectors once each; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.llm.kernels import in_batches
from loamframe.storage import Scratch, written

#: Vectors of a leaf; entries of a shard and of a block of queries, at most.
LEAF, SHARD_ENTRIES, BLOCK_ENTRIES = 256, 1 << 23, 1 << 17
#: The first wave holds one in so many shards.
FIRST_WAVE = 16
#: Relative slack of a bound, far above the rounding of doubles.
SLACK = 1e-9
#: With so many different lengths their numbers of shards, 12 bytes each, are broadcast.
FEW_LENGTHS = 100_000
#: What stands for a null id, which is behind all others.
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null, infinite or missing components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """An integer matrix in the smallest type that holds it."""
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, matrix.astype(kind).tobytes()


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, ends, centres, radii) of nodes; the children of node i that is no leaf are 2i + 1 and 2i + 2.

    Each level halves its runs of rows, so the tree is complete: level by level, with as many leaves as a power of two.
    """
    n, order = len(x), np.arange(len(x))
    levels = max(0, math.ceil(math.log2(max(1, n / leaf))))
    starts, ends = [0], [n]
    for level in range(levels):
        for node in range((1 << level) - 1, (2 << level) - 1):
            a, b = starts[node], ends[node]
            half = (a + b) // 2
            if b - a > 1:
                own = x[order[a:b]].astype(np.float64)
                far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
                other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
                order[a:b] = order[a:b][np.argpartition(own @ (other - far), half - a)]
            starts += [a, half]
            ends += [half, b]
    centres, radii = np.zeros((len(starts), x.shape[1])), np.zeros(len(starts))
    for node, (a, b) in enumerate(zip(starts, ends)):
        if a < b:
            own = x[order[a:b]].astype(np.float64)
            centres[node] = own.mean(axis=0)
            radii[node] = math.sqrt(((own - centres[node]) ** 2).sum(axis=1).max()) * (1 + SLACK)
    return order, np.array(starts), np.array(ends), centres, radii


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of one shard from its rows."""
    rows = pa.Table.from_batches(batches)
    dim = rows.column("dim")[0].as_py()
    ids = rows.column("id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
    x = _matrix(rows.column("v").combine_chunks(), dim)
    order, starts, ends, centres, radii = ball_tree(x)
    kind, body = packed(x[order])
    row = [dim, rows.column("shard")[0].as_py(), ids[order].tobytes(), kind, body, starts.tobytes(), ends.tobytes(), centres.tobytes(), radii.tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row[:2]] + [pa.array([v], pa.string() if isinstance(v, str) else pa.binary()) for v in row[2:]], TREE_COLUMNS)


TREE_COLUMNS = ["dim", "shard", "ids", "kind", "body", "starts", "ends", "centres", "radii"]
TREE = "dim int, shard long, ids binary, kind string, body binary, starts binary, ends binary, centres binary, radii binary"
BLOCK = "dim int, block long, q_ids binary, q_kind string, q_body binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries packed into blocks of one length each."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    number = TaskContext.get().partitionId() << 32

    def flush(dim: int) -> pa.RecordBatch:
        nonlocal number
        parts = waiting.pop(dim)
        kind, body = packed(np.concatenate([v for _, v in parts]))
        number += 1
        row = [pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([np.concatenate([i for i, _ in parts]).tobytes()]), pa.array([kind]), pa.array([body])]
        return pa.RecordBatch.from_arrays(row, ["dim", "block", "q_ids", "q_kind", "q_body"])

    for batch in batches:
        dims, ids = batch.column("dim").to_numpy(), batch.column("id").to_numpy()
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            size = max(1, BLOCK_ENTRIES // max(1, dim))
            for k in range(0, len(own), size):
                at = own[k : k + size]
                parts = waiting.setdefault(dim, [])
                parts.append((ids[at], _matrix(batch.column("v").take(pa.array(at)), dim)))
                if sum(len(i) for i, _ in parts) >= size:
                    yield flush(dim)
        while sum(v.size for parts in waiting.values() for _, v in parts) > 8 * BLOCK_ENTRIES:
            yield flush(max(waiting, key=lambda d: sum(v.size for _, v in waiting[d])))
    while waiting:
        yield flush(next(iter(waiting)))


class _Best:
    """The k best (score, id) of each query; ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None):
        self.k = k
        self.kth = np.full(n, LEAST) if floor is None else floor.copy()
        self.query, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        query, score, ident = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, ~score, query))
        query, score, ident = query[order], score[order], ident[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        full = rank == self.k - 1
        self.kth[query[full]] = np.maximum(self.kth[query[full]], score[full])
        kept = rank < self.k
        self.query, self.score, self.id = query[kept], score[kept], ident[kept]


def branch_and_bound(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, tree: tuple, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, score, id) of the k best of each query in one tree, without those below its floor."""
    starts, ends, centres, radii = tree
    longest = [math.isqrt(max((int(v) for v in _norms(m)), default=0)) + 1 for m in (q, x)]
    kind = np.float64 if math.prod(longest) < 1 << 53 else np.int64 if math.prod(longest) < 1 << 63 else object
    exact, points = q.astype(kind), x.astype(kind)
    rough = q.astype(np.float64)
    length = np.sqrt((rough**2).sum(axis=1))
    size = np.sqrt((centres**2).sum(axis=1)) + radii
    bound = rough @ centres.T + length[:, None] * radii + SLACK * length[:, None] * size + SLACK
    best = _Best(len(q), k, floor)
    leaves = len(starts) // 2
    heap = [(-float(bound[:, 0].max(initial=0)), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        active = np.flatnonzero(bound[:, node] >= best.kth)
        a, b = int(starts[node]), int(ends[node])
        if not len(active) or a == b:
            continue
        if node < leaves:
            for child in (2 * node + 1, 2 * node + 2):
                heapq.heappush(heap, (-float(bound[active, child].max()), child))
            continue
        score = exact[active] @ points[a:b].T
        own = ids[a:b] == q_ids[active][:, None]
        score[own] = LEAST
        if kind is object and (np.abs(score[~own]) >= 1 << 63).any():
            raise OverflowError("an inner product leaves a long")
        score = score.astype(np.int64)
        floor_of = best.kth[active]
        if b - a > k:  # the leaf's own kth score
            floor_of = np.maximum(floor_of, np.partition(score, b - a - k, axis=1)[:, b - a - k])
        row, col = np.nonzero((score >= floor_of[:, None]) & ~own)
        best.add(active[row], score[row, col], ids[a:b][col])
    return best.query, best.score, best.id


def _norms(m: np.ndarray) -> np.ndarray:
    """Squared lengths; as Python integers where a long could overflow."""
    top = max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    wide = m.astype(object) if top * top * max(1, m.shape[1]) >= 1 << 63 else m.astype(np.int64)
    return (wide * wide).sum(axis=1)


def _unpack(kind: str, body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, dtype=kind).reshape(n, -1) if body else np.zeros((n, 0), dtype=np.int64)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each row is a block of queries and a tree; its answers are the tree's best for each query."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            q_ids, ids = np.frombuffer(row["q_ids"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64)
            q, x = _unpack(row["q_kind"], row["q_body"], len(q_ids)), _unpack(row["kind"], row["body"], len(ids))
            starts, ends = (np.frombuffer(row[c], dtype=np.int64) for c in ("starts", "ends"))
            tree = (starts, ends, np.frombuffer(row["centres"], dtype=np.float64).reshape(len(starts), -1), np.frombuffer(row["radii"], dtype=np.float64))
            floor = np.full(len(q_ids), LEAST)
            for f in row["floors"] or []:
                floor[f["at"]] = f["floor"]
            at, score, ident = branch_and_bound(q, q_ids, x, ids, tree, k, floor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), row["block"])), pa.array(at.astype(np.int32)), pa.array(q_ids[at]), pa.array(ident, mask=ident == NO_ID), pa.array(score)],
                ["block", "at", "query_id", "id", "score"],
            )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "v", shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query, by exact inner product of long vectors."""
    spark = candidates.sparkSession
    asked, rows = (df.select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), F.col(vector_col).alias("v")) for df in (queries, candidates))
    with Scratch(spark) as scratch:
        counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
        most = F.greatest(F.lit(LEAF), F.floor(F.lit(shard_entries) / F.greatest(F.lit(1), F.col("dim"))))
        share = F.ceil(F.col("n") / F.least(most, F.greatest(F.lit(LEAF), F.ceil(16 * F.sqrt("n")))))
        counts = scratch.table(counts.select("dim", share.cast("long").alias("shards")), "shards")
        lengths, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("shards"), F.lit(1))).first()
        # numbered where they are read, so that the copies of one row spread over all shards
        dealt = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(counts) if lengths <= FEW_LENGTHS else counts, "dim")
        dealt = dealt.select("dim", F.pmod(F.xxhash64("row"), "shards").alias("shard"), "id", "v")
        trees = scratch.table(dealt.groupBy("dim", "shard").applyInArrow(_of_group, TREE), "trees")
        trees = trees.repartition(total, "dim", "shard").hint("merge")
        blocks = scratch.table(in_batches(asked.where("id IS NOT NULL").distinct().select("dim", "id", "v"), _blocks, BLOCK), "blocks")
        wave = F.col("shard") < F.greatest(F.lit(1), F.floor(F.col("shards") / FIRST_WAVE))
        places = blocks.select("dim", "block").join(counts, "dim").select("dim", "block", "shards", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        best = None
        for shards in (wave, ~wave):
            floors = F.lit(None).cast("array<struct<at:int,floor:bigint>>") if best is None else None
            ready = blocks.withColumn("floors", floors) if best is None else blocks.join(_floors(best, k), "block", "left")
            meets = places.where(shards).select("block", "shard").join(ready, "block").join(trees, ["dim", "shard"])
            found = in_batches(meets.select("block", "q_ids", "q_kind", "q_body", "floors", *TREE_COLUMNS[2:]), partial(_search, k=k), "block long, at int, query_id long, id long, score long")
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            best = written(_ranked(found, k), "best") if best is not None else scratch.table(_ranked(found, k), "best")
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _of_group(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_build(rows.to_batches())).cast(pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()), ("kind", pa.string()), *[(c, pa.binary()) for c in TREE_COLUMNS[4:]]]))


def _floors(best: DataFrame, k: int) -> DataFrame:
    """Per block the kth scores so far, of the queries that have one."""
    kth = best.where(F.col("rank") == k).select("block", F.struct("at", F.col("score").alias("floor")).alias("f"))
    return kth.groupBy("block").agg(F.collect_list("f").alias("floors"))

