"""Unions of polygons by a planar overlay in grid cells.

Corners are moved to a grid of the given precision, so that all that follows is arithmetic of integers.
Edges meet in cells of a tree that divides where they are many.  Each cell finds where its edges cross and which grid points they
pass by half a step (points that it owns, so that no point is found twice), and edges are split there: pieces then meet at
their ends only.  A piece is on the border of the union if it bounds polygons on one side alone and lies inside no other.  Border pieces
keep the union on their left; at each end the next one is the sharpest turn to the left.  Runs of pieces are chained inside
cells, chains are joined to rings as components of a graph of chains.

Rings that touch themselves in a point are cut there so that each part of the union inside has its own ring.  Outer rings run
counter-clockwise, holes clockwise; corners on a straight line are left out.

A ring crosses no edge of its own; of equal rings of a group one is used.  Rings with fewer than three different corners or without
area, and null rings, add nothing.  Nor do rings inside another one of their group: where that one is convex and among the widest
of its cell, they are left out at the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.functions import geo
from loamframe.operators.celltree import CELL, CellTree
from loamframe.operators.graph import components
from loamframe.storage import Scratch, written

_POINTS = "array<struct<x:bigint,y:bigint>>"
_FROM, _TO = ("x1", "y1"), ("x2", "y2")
#: Pairs that are compared at a time inside a cell.
PAIRS = 1 << 21


#: Edges whose sides are shorter than this many steps cross by arithmetic of 64 bits.
SIDE = 1 << 30
#: Convex rings of a cell, its widest, in which others are looked for.
WIDEST = 64


def neighbours(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows before and after each row of closed curves of n rows each."""
    last = np.cumsum(n)
    first, last = (last - n)[n > 0], last[n > 0] - 1
    before, after = np.arange(n.sum()) - 1, np.arange(n.sum()) + 1
    before[first], after[last] = last, first
    return before, after


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n > 0 values each."""
    return np.add.reduceat(values, np.cumsum(n) - n) if len(n) else np.zeros(0)


def snapped_rings(xy: np.ndarray, n: np.ndarray, precision: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer corners of rings of n corners each, without repeated neighbours, counter-clockwise; the number of corners and the number of each ring that is left."""
    steps = np.abs(xy / precision)
    if not (steps < 2.0**63).all():
        raise ValueError("a corner is not finite or too far out for the precision")
    low = np.floor(steps)
    xy = np.copysign(low + (steps - low >= 0.5), xy).astype(np.int64)  # halves away from zero
    of = np.repeat(np.arange(len(n)), n)
    new = (xy != xy[neighbours(n)[0]]).any(axis=1)
    n = np.bincount(of[new], minlength=len(n))
    large = np.repeat(n > 2, n)
    ring, xy, n = np.flatnonzero(n > 2), xy[new][large], n[n > 2]
    first, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    rest = xy - xy[first[of]]
    if len(rest) and np.abs(rest).max() >= SIDE:  # integers without a limit; below it, sums that wrap around come back
        rest = xy.astype(object) - xy[first[of]].astype(object)
    after = neighbours(n)[1]
    twice = sums(rest[:, 0] * rest[after, 1] - rest[after, 0] * rest[:, 1], n)
    at = np.arange(len(xy))
    at = np.where((twice < 0).astype(bool)[of], (2 * first + n - 1)[of] - at, at)
    real = (twice != 0).astype(bool)
    return xy[at][real[of]], n[real], ring[real]


def _snapped(df: DataFrame, ring_col: str, precision: float) -> DataFrame:
    """g and ring of each different snapped ring; equal rings are dropped before they are snapped, in a shuffle that spreads the others over all tasks."""
    point = pa.struct([("x", pa.int64()), ("y", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column("ring")
            flat, sizes = rings.flatten(), rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
            xy, n, at = snapped_rings(xy, sizes, precision)
            corners = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(point))
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), corners)
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(at, pa.int64())), out], ["g", "ring"])

    points = F.transform(ring_col, lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y")))
    rows = df.select("g", points.alias("ring")).distinct()
    # a ring with a corner that is not known has no area
    rows = rows.where((F.size("ring") > 2) & ~F.exists("ring", lambda p: p.x.isNull() | p.y.isNull()))
    return rows.mapInArrow(work, f"g {rows.schema['g'].dataType.simpleString()}, ring {_POINTS}").distinct()


def _ahead(ring: Column, n: int = 1) -> Column:
    """The corners of a ring, begun n corners later."""
    return F.concat(F.slice(ring, n + 1, F.size(ring)), F.slice(ring, 1, n))


def _turn(p: Column, q: Column, r: Column) -> Column:
    return (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)


def _convex(ring: Column) -> Column:
    """Whether a counter-clockwise ring never turns right and winds once: its edges turn upward once."""
    edges = F.arrays_zip(ring.alias("p"), _ahead(ring).alias("q"), _ahead(ring, 2).alias("r"))
    up = lambda p, q: (q.y > p.y) | ((q.y == p.y) & (q.x > p.x))
    return F.forall(edges, lambda e: _turn(e.p, e.q, e.r) >= 0) & (F.size(F.filter(edges, lambda e: ~up(e.p, e.q) & up(e.q, e.r))) == 1)


def outermost(rings: DataFrame, size: float) -> DataFrame:
    """Counter-clockwise rings of integers (g, poly, ring) without those inside another of their group, as far as the WIDEST convex ones of a cell show it.

    A ring is left out for one that comes before it, by the size of its box and by poly, so that never both of a pair go.
    """
    box = geo.ring_box("ring")
    sides = {"_x0": box.minx, "_y0": box.miny, "_x1": box.maxx, "_y1": box.maxy}
    rings = rings.withColumns(sides).withColumn("_wide", (F.col("_x1").cast("double") - F.col("_x0")) * (F.col("_y1").cast("double") - F.col("_y0")))
    narrow = (F.col("_x1").cast("double") - F.col("_x0") < SIDE) & (F.col("_y1").cast("double") - F.col("_y0") < SIDE)  # no product of sides is too large
    over = rings.where(F.when(narrow, _convex(F.col("ring"))).otherwise(False))
    over = over.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_x0") / size), F.floor(F.col("_x1") / size))))
    over = over.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_y0") / size), F.floor(F.col("_y1") / size))))
    first = Window.partitionBy("g", "_cx", "_cy").orderBy(F.col("_wide").desc(), "poly")
    over = over.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= WIDEST).drop("_n")
    over = over.select(*[F.col(c).alias(f"o{c}") for c in over.columns])
    same = (F.col("g") == F.col("og")) & (F.floor(F.col("_x0") / size) == F.col("o_cx")) & (F.floor(F.col("_y0") / size) == F.col("o_cy"))
    before = (F.col("o_wide") > F.col("_wide")) | ((F.col("o_wide") == F.col("_wide")) & (F.col("opoly") < F.col("poly")))
    boxed = (F.col("o_x0") <= F.col("_x0")) & (F.col("o_y0") <= F.col("_y0")) & (F.col("o_x1") >= F.col("_x1")) & (F.col("o_y1") >= F.col("_y1"))
    edges = F.arrays_zip(F.col("oring").alias("p"), _ahead(F.col("oring")).alias("q"))
    inside = F.forall(edges, lambda e: F.forall("ring", lambda r: _turn(e.p, e.q, r) >= 0))
    return rings.join(over, same & F.when(before & boxed, inside).otherwise(False), "left_anti").select("g", "poly", "ring")


def crossing_points(edges: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of edges i and j cross, and the grid points nearest to where they do, by exact arithmetic."""
    p, q = edges[i], edges[j]
    r, s, gap = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2], q[:, :2] - p[:, :2]
    wide = np.maximum(np.abs(r), np.maximum(np.abs(s), np.abs(gap))).max(axis=1, initial=0) >= SIDE
    if wide.any():  # integers without a limit
        r, s, gap = r.astype(object), s.astype(object), gap.astype(object)
    den, t, u = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0], gap[:, 0] * s[:, 1] - gap[:, 1] * s[:, 0], gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]
    sign = np.where(den < 0, -1, 1)
    den, t, u = den * sign, t * sign, u * sign
    found = np.flatnonzero((den != 0) & (t >= 0) & (t <= den) & (u >= 0) & (u <= den))
    den, t, r = den[found, None], t[found, None], r[found]
    # a first guess; products that do not fit into 64 bits wrap around, but their difference, less than 2 * den, is right
    guess = np.rint(t.astype(np.float64) / den.astype(np.float64) * r.astype(np.float64)).astype(np.int64)
    with np.errstate(over="ignore"):
        steps = guess + (2 * t * r + den - 2 * den * guess) // (2 * den)
    return found, p[found, :2] + steps.astype(np.int64)


def hot_points(edges: np.ndarray) -> np.ndarray:
    """Ends and crossings of edges (rows x1, y1, x2, y2 of integers), each once."""
    flat = np.unique(np.where((edges[:, :2] <= edges[:, 2:]).all(axis=1)[:, None], edges, edges[:, [2, 3, 0, 1]]), axis=0)
    low, high = np.minimum(flat[:, :2], flat[:, 2:]), np.maximum(flat[:, :2], flat[:, 2:])
    hot = [np.unique(flat.reshape(-1, 2), axis=0)]
    step = max(1, PAIRS // max(1, len(flat)))
    for top in range(0, len(flat), step):
        part = slice(top, top + step)
        meet = ((low[part, None] <= high[None]) & (low[None] <= high[part, None])).all(axis=2)
        i, j = np.nonzero(meet)
        i += top
        hot.append(np.unique(crossing_points(flat, i[i < j], j[i < j])[1], axis=0))
    return np.unique(np.concatenate(hot), axis=0)


def passes(edges: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (edge, point) of an edge and a point that it passes by half a step, without its own ends."""
    out = [np.zeros((0, 2), dtype=np.int64)]
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    step = max(1, PAIRS // max(1, len(points)))
    for top in range(0, len(edges), step):
        e = edges[top : top + step]
        d = e[:, 2:] - e[:, :2]
        near = ((low[top : top + step, None] <= points[None]) & (points[None] <= high[top : top + step, None])).all(axis=2)
        off = d[:, None, 0] * (points[None, :, 1] - e[:, None, 1]) - d[:, None, 1] * (points[None, :, 0] - e[:, None, 0])
        near &= 2 * np.abs(off) <= np.abs(d).sum(axis=1)[:, None]
        for end in (e[:, :2], e[:, 2:]):
            near &= (points[None] != end[:, None]).any(axis=2)
        i, j = np.nonzero(near)
        out.append(np.column_stack([i + top, j]))
    found = np.concatenate(out)
    return found[:, 0], found[:, 1]


def _split_points(size: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """Grid points of a cell at which its edges are split."""
        first = rows.iloc[0]
        side = size / 2 ** int(first["_level"])
        edges = rows[[*_FROM, *_TO]].to_numpy(dtype=np.int64)
        base = edges[:, :2].min(axis=0)
        edges = edges - np.tile(base, 2)
        points = hot_points(edges)
        points = points[(np.floor((points + base) / side) == np.array([first["_cx"], first["_cy"]])).all(axis=1)]
        i, j = passes(edges, points)
        return pd.DataFrame({"poly": rows["poly"].to_numpy()[i], "k": rows["k"].to_numpy()[i], "px": points[j, 0] + base[0], "py": points[j, 1] + base[1]})

    return work


def _inside(pieces: pd.DataFrame, polygons: pd.DataFrame) -> pd.DataFrame:
    """Numbers of a cell's pieces whose middle lies in a polygon that does not own them."""
    number, x, y = (pieces[c].to_numpy() for c in ("number", "mx", "my"))
    owners = [set(o) for o in pieces["owners"]]
    left, found = np.arange(len(pieces)), []
    for poly, xs, ys in zip(polygons["poly"].tolist(), polygons["xs"], polygons["ys"]):
        x1, y1 = np.asarray(xs, dtype=np.float64)[:, None], np.asarray(ys, dtype=np.float64)[:, None]
        x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
        px, py = x[left], y[left]
        spans = (y1 > py) != (y2 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
        hit = (spans & beyond).sum(axis=0) % 2 == 1
        hit &= np.array([poly not in owners[k] for k in left], dtype=bool)
        found.append(left[hit])
        left = left[~hit]
        if not len(left):
            break
    return pd.DataFrame({"number": number[np.concatenate(found)] if found else number[:0]})


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of pieces that follow each other inside a cell: chain (its first piece), pos and, behind the last one, out."""
    after = dict(zip(rows["piece"].tolist(), rows["next"].tolist(), strict=True))
    heads = sorted(set(after) - set(after.values()))
    done: dict[int, tuple[int, int]] = {}
    for head in [*heads, *sorted(after)]:
        piece, pos = head, 0
        while piece in after and piece not in done:
            done[piece] = (head, pos)
            piece, pos = after[piece], pos + 1
    pieces = list(done)
    out = [after[p] if after[p] not in after else None for p in pieces]
    return pd.DataFrame({"piece": pieces, "chain": [done[p][0] for p in pieces], "pos": [done[p][1] for p in pieces], "out": pd.array(out, dtype="Int64")})


def _ring(precision: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        """Corners of one ring from its chains in their order."""
        rows = rows.sort_values(["chain", "pos"])
        chains = {c: g for c, g in rows.groupby("chain", sort=False)}
        follows = {c: g["follows"].iloc[-1] for c, g in chains.items()}
        order = {min(chains): None}  # a dict, as an ordered set; rings that cross themselves could lead back elsewhere than to the first
        while not pd.isna(after := follows[next(reversed(order))]) and int(after) not in order:
            order[int(after)] = None
        xy = np.concatenate([chains[c][list(_FROM)].to_numpy(dtype=np.int64) for c in order])
        a, b = xy - np.roll(xy, 1, axis=0), np.roll(xy, -1, axis=0) - xy
        xy = xy[a[:, 0] * b[:, 1] != a[:, 1] * b[:, 0]]
        xy = np.roll(xy, -int(np.lexsort((xy[:, 1], xy[:, 0]))[0]), axis=0)
        rest = (xy - xy[0]).astype(np.float64) * precision
        area = float((rest[:, 0] * np.roll(rest[:, 1], -1) - np.roll(rest[:, 0], -1) * rest[:, 1]).sum() / 2)
        points = [{"x": float(x) * precision, "y": float(y) * precision} for x, y in xy.tolist()]
        return pd.DataFrame({"ring_id": [int(rows["ring"].iloc[0])], "ring": [points], "area": [area]})

    return work


def union_rings(polygons: DataFrame, size: float, by: str | None = None, ring_col: str = "ring", precision: float = 1e-6, limit: int = 512) -> DataFrame:
    """The border of the union of all polygons, or of those of each group `by`: one row per ring.

    Columns: the group, ring_id, ring (points x, y), area (negative for holes).  size is the side of a cell and should be
    near that of the polygons.  Jobs run when this is called; the result is a table in the shared folder.
    """
    spark = polygons.sparkSession
    group = F.struct((F.lit(0) if by is None else F.col(by)).alias("v"))  # a struct is never null, so null groups join like others
    with Scratch(spark) as scratch:
        rings = _snapped(polygons.select(group.alias("g"), F.col(ring_col).alias("ring")), "ring", precision)
        rings = scratch.table(rings, "rings")
        # numbered where the written table is read, which gives the same numbers each time
        rings = scratch.table(rings.select("g", F.monotonically_increasing_id().alias("poly"), "ring"), "numbered")
        rings = scratch.table(outermost(rings, size / precision), "outermost")
        ends = F.arrays_zip(F.col("ring").alias("p"), _ahead(F.col("ring")).alias("q"))
        edges = rings.select("g", "poly", F.posexplode(ends).alias("k", "e"))
        edges = edges.select("g", "poly", "k", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
        edges = scratch.table(edges, "edges")
        box = [F.least("x1", "x2") - 1, F.least("y1", "y2") - 1, F.greatest("x1", "x2") + 1, F.greatest("y1", "y2") + 1]
        # a cell of one step holds one grid point: to divide it parts nothing
        depth = min(16, max(0, math.floor(math.log2(size / precision))))
        tree = CellTree(scratch, size / precision, ["g"], limit, depth).grow(edges.withColumns(dict(zip(("_x0", "_y0", "_x1", "_y1"), box))))
        placed = scratch.table(tree.place(edges, *box), "placed")
        cell = ["g", *CELL]
        split = placed.groupBy(*cell).applyInPandas(_split_points(tree.size), "poly long, k int, px long, py long")
        split = split.groupBy("poly", "k").agg(F.collect_set(F.struct("px", "py")).alias("cuts"))
        along = lambda p: (p.px - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p.py - F.col("y1")) * (F.col("y2") - F.col("y1"))
        cuts = F.transform(F.array_sort(F.transform("cuts", lambda p: F.struct(along(p).alias("t"), p.px.alias("x"), p.py.alias("y")))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
        corners = F.concat(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))), F.coalesce(cuts, F.array().cast(_POINTS)))
        whole = edges.join(split, ["poly", "k"], "left").select("g", "poly", "k", "x2", "y2", corners.alias("c"))
        ends = F.arrays_zip(F.col("c").alias("p"), F.concat(F.slice("c", 2, F.size("c")), F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("q"))
        pieces = whole.select("g", "poly", "k", F.posexplode(ends).alias("j", "e")).where("e.p <> e.q")
        pieces = scratch.table(pieces.select("g", "poly", "k", "j", "e.p", "e.q"), "pieces")
        moved = pieces.groupBy("g", "poly").agg(F.array_sort(F.collect_list(F.struct("k", "j", "p"))).getField("p").alias("ring"))
        forward = F.col("p") < F.col("q")
        sides = pieces.groupBy("g", "poly", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("net"))
        sides = sides.where("net <> 0").groupBy("g", "a", "b").agg(F.bool_or(F.col("net") > 0).alias("left"), F.bool_or(F.col("net") < 0).alias("right"), F.collect_set("poly").alias("owners"))
        middle = [(F.col("a.x") + F.col("b.x")) / 2, (F.col("a.y") + F.col("b.y")) / 2]
        sides = scratch.table(sides.where("left <> right"), "sides")
        sides = sides.select("g", "a", "b", "left", "owners", F.monotonically_increasing_id().alias("number"), middle[0].alias("mx"), middle[1].alias("my"))
        sides = scratch.table(tree.place(sides, F.col("mx"), F.col("my")), "sides")
        # cells that a polygon covers without an edge in them hold no border
        here = placed.select(*cell, "poly").distinct()
        box = geo.ring_box("ring")
        over = tree.place(moved, box.minx, box.miny, box.maxx, box.maxy).join(here, [*cell, "poly"], "left_anti")
        covered = over.where(geo.contains("ring", *tree.middle())).select(*cell).distinct()
        sides = sides.join(covered, cell, "left_anti")
        around = here.join(moved.select("poly", F.col("ring.x").alias("xs"), F.col("ring.y").alias("ys")), "poly")
        inside = sides.select(*cell, "number", "mx", "my", "owners").groupBy(*cell).cogroup(around.groupBy(*cell)).applyInPandas(_inside, "number long")
        border = sides.join(inside, "number", "left_anti")
        start, end = F.when(F.col("left"), F.col("a")).otherwise(F.col("b")), F.when(F.col("left"), F.col("b")).otherwise(F.col("a"))
        border = scratch.table(border.select("g", start.alias("p"), end.alias("q")), "border")
        border = scratch.table(border.select(F.monotonically_increasing_id().alias("piece"), "g", "p", "q"), "border")
        # around each corner, clockwise: what leads out next behind what leads in
        turned = lambda p, q: -F.atan2(F.col(f"{q}.y").cast("double") - F.col(f"{p}.y"), F.col(f"{q}.x").cast("double") - F.col(f"{p}.x"))
        around = border.select("g", F.col("q").alias("at"), turned("q", "p").alias("turn"), F.lit(None).cast("long").alias("leaves"), "piece")
        around = around.unionByName(border.select("g", F.col("p").alias("at"), turned("p", "q").alias("turn"), F.col("piece").alias("leaves"), F.lit(None).cast("long").alias("piece")))
        corner = Window.partitionBy("g", "at").orderBy("turn", F.col("leaves").isNotNull())
        ahead = F.first("leaves", ignorenulls=True).over(corner.rowsBetween(1, Window.unboundedFollowing))
        again = F.first("leaves", ignorenulls=True).over(corner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        follows = around.select("piece", F.coalesce(ahead, again).alias("next")).where("piece IS NOT NULL")
        border = border.join(follows, "piece").select("g", "piece", "next", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))
        border = scratch.table(tree.place(border, F.col("x1"), F.col("y1")), "runs")
        chains = scratch.table(border.groupBy(*cell).applyInPandas(_chained, "piece long, chain long, pos int, out long"), "chains")
        links = chains.where("out IS NOT NULL").select(F.col("chain").alias("a"), F.col("out").alias("piece")).join(chains.select("piece", F.col("chain").alias("b")), "piece").select("a", "b")
        links = scratch.table(links, "links")
        labels = components(links, scratch).select(F.col("id").alias("chain"), "component")
        ordered = border.select("piece", "g", *_FROM).join(chains.drop("out"), "piece").join(links.select(F.col("a").alias("chain"), F.col("b").alias("follows")), "chain", "left")
        ordered = ordered.join(labels, "chain", "left").withColumn("ring", F.coalesce("component", "chain"))
        ordered = scratch.table(ordered.select("g", "ring", "chain", "pos", "follows", *_FROM), "ordered")
        shapes = ordered.groupBy("ring").applyInPandas(_ring(precision), "ring_id long, ring array<struct<x:double,y:double>>, area double")
        groups = ordered.groupBy(F.col("ring").alias("ring_id")).agg(F.first("g").alias("g"))
        found = written(shapes.join(groups, "ring_id").select(F.col("g.v").alias(by or "g"), "ring_id", "ring", "area"), "union")
    return found if by is not None else found.drop("g")


def dissolved(polygons: DataFrame, size: float, by: str | None = None, ring_col: str = "ring", precision: float = 1e-6, limit: int = 512) -> DataFrame:
    """The parts of the union, one row each: the group, ring_id, ring, holes (rings) and area."""
    rings = union_rings(polygons, size, by, ring_col, precision, limit)
    keys = [by] if by is not None else []
    with Scratch(polygons.sparkSession) as scratch:
        rings = rings.withColumn("_g", F.struct(*keys) if keys else F.struct(F.lit(0).alias("v")))
        outer, holes = rings.where("area > 0"), rings.where("area < 0")
        box = geo.ring_box("ring")
        tree = CellTree(scratch, size)
        # the middle of an edge of a hole lies on no other ring
        first, second = F.element_at("ring", 1), F.element_at("ring", 2)
        at = [(first.x + second.x) / 2, (first.y + second.y) / 2]
        near = tree.place(holes.select("_g", F.col("ring_id").alias("hole"), F.col("ring").alias("hole_ring"), F.col("area").alias("hole_area"), at[0].alias("x"), at[1].alias("y")), F.col("x"), F.col("y"))
        over = tree.place(outer, box.minx, box.miny, box.maxx, box.maxy)
        pairs = near.join(over, ["_g", *CELL]).where((F.col("area") > -F.col("hole_area")) & geo.contains("ring", "x", "y"))
        owner = pairs.groupBy("hole").agg(F.min(F.struct("area", "ring_id")).alias("o"), F.first("hole_ring").alias("hole_ring"), F.first("hole_area").alias("hole_area"))
        owned = owner.groupBy(F.col("o.ring_id").alias("ring_id")).agg(F.array_sort(F.collect_list("hole_ring")).alias("holes"), F.sum("hole_area").alias("_less"))
        none = F.array().cast("array<array<struct<x:double,y:double>>>")
        parts = outer.join(owned, "ring_id", "left").withColumn("area", F.col("area") + F.coalesce("_less", F.lit(0.0)))
        return written(parts.select(*keys, "ring_id", "ring", F.coalesce("holes", none).alias("holes"), "area"), "dissolved")
