"""Exact top-k search and whitening, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamframe.llm import queries, topk, whitening

VECTORS = "vec_id long, v array<long>"


def best_of(queries_, candidates, k):
    """{(id, vector): [(rank, id, score)]} by full comparison with Python integers."""
    out = {}
    for q, v in queries_:
        found = [(-sum(a * b for a, b in zip(v, w)), math.inf if c is None else c, c) for c, w in candidates if c != q and len(w) == len(v)]
        out[q, tuple(v)] = [(n + 1, c, -s) for n, (s, _, c) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return out


def check(spark, rows, k=3, shard_entries=topk.SHARD_ENTRIES):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", id string, shard int").repartition(3)
    asked = df.where("vec_id % 10 = 0")
    got = sorted((r.query_id, r["rank"], r.vec_id if r.vec_id is not None else -1, r.score) for r in topk.top_k(asked, df, k=k, shard_entries=shard_entries).collect())
    wanted = best_of([(i, v) for i, v in rows if i is not None and i % 10 == 0], rows, k)
    assert got == sorted((q, n, c if c is not None else -1, s) for (q, _), found in wanted.items() for n, c, s in found)


@pytest.mark.parametrize("shard_entries", [topk.SHARD_ENTRIES, 3000])
def test_clusters_ties_and_copies(spark, shard_entries):
    draw = random.Random(1)
    centres = [[draw.randrange(-900, 900) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + draw.randrange(-3, 4) for x in draw.choice(centres)]) for i in range(900)]
    rows += [(i, centres[0]) for i in range(2000, 2700)] + [(None, centres[0]), (None, centres[1])]
    check(spark, rows, shard_entries=shard_entries)


def test_lengths_and_repeated_rows(spark):
    rows = [(10, [1, 2]), (10, [1, 2]), (10, [3]), (11, [1, 2]), (11, [1, 2]), (12, [1, 2, 3]), (20, []), (21, []), (22, []), (30, [5, 5, 5, 5]), (None, [1, 1])]
    check(spark, rows)


def test_large_components(spark):
    rows = [(10, [2**40, 3]), (11, [2**21, 1]), (12, [2**21 + 1, 0]), (13, [-(2**22), 2])]
    check(spark, rows)
    with pytest.raises(Exception, match="leaves a long"):
        check(spark, [(10, [2**40, 3]), (11, [2**40, 1])])


def test_pruning_and_shared_scores():
    random_ = np.random.default_rng(5)
    centres = random_.integers(-1000, 1000, (40, 16))
    x = np.concatenate([c + random_.integers(-5, 6, (200, 16)) for c in centres])
    order, starts, ends, middles, radii = topk.ball_tree(x)
    x, ids = x[order], order.astype(np.int64)
    leaves = slice(len(starts) // 2, None)
    assert sorted(order.tolist()) == list(range(len(x))) and (ends - starts)[leaves].sum() == len(x) and (ends - starts)[leaves].max() <= topk.LEAF
    q, q_ids = x[:50], ids[:50]
    tree = (starts, ends, middles, radii)
    at, score, ident = topk.branch_and_bound(q, q_ids, x, ids, tree, 4)
    every = q @ x.T
    every[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    for k in range(50):
        wanted = sorted((-v, i) for v, i in zip(every[k].tolist(), ids.tolist()))[:4]
        assert sorted(zip((-score[at == k]).tolist(), ident[at == k].tolist())) == wanted
    # with the kth scores of elsewhere nothing below them comes back
    kth = np.array([score[at == k].min() for k in range(50)])
    at, score, _ = topk.branch_and_bound(q, q_ids, x, ids, tree, 4, kth)
    assert (score >= kth[at]).all() and len(np.unique(at)) == 50
    assert not len(topk.branch_and_bound(q, q_ids, x, ids, tree, 4, kth + 10**7)[0])


def test_unusable_vectors(spark, tmp_path):
    rows = [(100, [1.0, 0.5]), (101, [0.5, 0.25]), (102, None), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (200, [-0.0001, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op12_top_products(spark, str(tmp_path)).collect())
    assert got == [(100, 1, 101, 1024 * 512 + 512 * 256), (100, 2, 200, -1024 + 512 * 1024), (200, 1, 100, -1024 + 512 * 1024), (200, 2, 101, -512 + 256 * 1024)]
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk.top_k(empty, empty).count() == 0
    assert spark.range(1).select(topk.usable(F.lit(None).cast("array<float>"))).first()[0] is False


# --- whitening ---------------------------------------------------------------------


def whitened_by_hand(rows, components):
    """{(id, x): (n, deviation, whitened, explained)} of one length, and the fit list's whitened rows, by numpy on the whole matrix."""
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in rows:
        d = [n * v - s for v, s in zip(x, sums)]
        out[i, tuple(x)] = (n, sum(v * v for v in d), np.array(d) / n @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n))
    return out


@pytest.mark.parametrize("tile", [3, 32])
def test_whitening(spark, tile):
    random_ = np.random.default_rng(2)
    base = random_.normal(size=(200, 7)) @ random_.normal(size=(7, 7)) * 40
    rows = [(i, (1_000_000 + np.floor(v)).astype(int).tolist()) for i, v in enumerate(base)]
    rows += [(900 + i, rows[3][1]) for i in range(400)] + [(None, rows[5][1]), (7, rows[7][1])]
    short = [(2000 + i, [int(v) for v in random_.integers(0, 50, 3)]) for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + short + [(5000, [])]], "vec_id long, x array<long>, dim string, n int").repartition(5)
    got = whitening.whiten(df, components=5, tile=tile).collect()
    assert len(got) == len(rows) + len(short)
    for part, dim, kept in ((rows, 7, 5), (short, 3, 3)):
        wanted = whitened_by_hand(part, kept)
        mine = [r for r in got if r.dim == dim]
        signs = None
        for r in mine:
            n, deviation, white, explained = next(w for (i, _), w in wanted.items() if i == r.vec_id and w[1] == r.deviation)
            signs = np.sign(np.array(r.whitened) * white) if signs is None else signs
            assert r.n == n and np.allclose(np.array(r.whitened), white * signs, atol=1e-9) and np.allclose(r.explained, explained, rtol=1e-9)
            assert r.identity_error < 1e-9


def test_whitening_of_few_directions_and_large_entries(spark):
    rows = [(i, [10**15 + i * i, 10**15 + 2 * i * i, 5]) for i in range(1, 40)] + [(99, [7] * 4)]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, x array<long>")).collect()}
    wanted = whitened_by_hand(rows[:-1], 1)
    assert all(int(got[i].deviation) == w[1] for (i, _), w in wanted.items())
    assert got[3].whitened[1:] == [None, None] and got[3].whitened[0] is not None and got[3].identity_error < 1e-6
    assert got[99].whitened == [None] * 4 and got[99].n == 1 and got[99].deviation == 0 and got[99].identity_error is None
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, x array<long>")).count() == 0


def test_models_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, [i % 7, i % 5, i]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    key = lambda out: sorted((r.vec_id, r.n, r.deviation, *np.round(r.whitened, 9)) for r in out.collect())
    wanted = key(whitening.whiten(df))
    monkeypatch.setattr(whitening, "BROADCAST_BYTES", 0)
    assert key(whitening.whiten(df)) == wanted


def test_unusable_vectors_are_not_whitened(spark, tmp_path):
    rows = [(1, [1.0, 0.5]), (2, [0.5, 0.25]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, [0.0, 1.0]), (8, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_whitened_embeddings(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in (1, 2, 7, 8) for c in (1, 2)]
    assert {r.n for r in got} == {3} and all(r.identity_error < 1e-9 for r in got) and isinstance(got[0].deviation, int)
