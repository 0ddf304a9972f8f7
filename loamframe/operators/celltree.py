"""Grid cells that are divided where many boxes meet.

A cell is (level, column, row); its side is size / 2^level.  Boxes are counted per cell, and those of
cells with more than `limit` of them go on to the four cells below that they touch, until no cell is too
full or `depth` levels are made.  The lists of full cells are all that is kept: any other table of boxes or
points can be placed in the same cells, so that both meet in an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamframe.storage import Scratch, written

CELL = ("_level", "_cx", "_cy")
_SIDES = ("_x0", "_y0", "_x1", "_y1")


class CellTree:
    """Cells for boxes, each tree by itself in every group of the columns `by`; scratch holds boxes while it grows."""

    def __init__(self, scratch: Scratch, size: float, by: Sequence[str] = (), limit: int = 512, depth: int = 16):
        self.scratch, self.size, self.by, self.limit, self.depth = scratch, float(size), list(by), limit, depth
        self.full: list[DataFrame] = []

    def grow(self, *tables: DataFrame) -> CellTree:
        """Divide cells until the tables' boxes (columns _x0, _y0, _x1, _y1) are at most `limit` in each, as far as depth goes."""
        rows = reduce(DataFrame.unionByName, [t.select(*self.by, *_SIDES) for t in tables])
        rows = self.top(rows)
        for _ in range(self.depth):
            counts = rows.groupBy(*self.by, *CELL).agg(F.count(F.lit(1)).alias("_n"))
            full = written(counts.where(F.col("_n") > self.limit).select(*self.by, *CELL), "full_cells")
            if full.isEmpty():
                break
            self.full.append(full)
            rows = self.scratch.table(self.below(self._only(rows, full, "left_semi")), "boxes")
        return self

    def place(self, df: DataFrame, x0: Column, y0: Column, x1: Column | None = None, y1: Column | None = None) -> DataFrame:
        """df once per cell that its box, or point, touches; with _level, _cx and _cy."""
        x1, y1 = x0 if x1 is None else x1, y0 if y1 is None else y1
        rows = self.top(df.withColumns(dict(zip(_SIDES, (x0, y0, x1, y1), strict=True))))
        done = []
        for full in self.full:
            done.append(self._only(rows, full, "left_anti"))
            rows = self.below(self._only(rows, full, "left_semi"))
        return reduce(DataFrame.unionByName, [*done, rows]).drop(*_SIDES)

    def _only(self, rows: DataFrame, full: DataFrame, how: str) -> DataFrame:
        same = full.select(*[F.col(c).alias(f"_f{c}") for c in (*self.by, *CELL)])
        return rows.join(same, [F.col(c).eqNullSafe(F.col(f"_f{c}")) for c in (*self.by, *CELL)], how)

    def top(self, rows: DataFrame) -> DataFrame:
        """rows once per undivided cell that their boxes (columns _x0, _y0, _x1, _y1) touch."""
        low = lambda c: F.floor(F.col(c) / self.size)
        rows = rows.withColumn("_level", F.lit(0)).withColumn("_cx", F.explode(F.sequence(low("_x0"), low("_x1"))))
        return rows.withColumn("_cy", F.explode(F.sequence(low("_y0"), low("_y1"))))

    def below(self, rows: DataFrame) -> DataFrame:
        """Rows of cells once per quarter of theirs that their boxes touch."""
        rows = rows.withColumn("_level", F.col("_level") + 1)
        side = F.lit(self.size) / F.pow(F.lit(2.0), F.col("_level"))
        for c, low, high in (("_cx", "_x0", "_x1"), ("_cy", "_y0", "_y1")):
            halves = F.array(F.col(c) * 2, F.col(c) * 2 + 1)
            first, last = F.floor(F.col(low) / side), F.floor(F.col(high) / side)
            rows = rows.withColumn(c, F.explode(F.filter(halves, lambda h: (h >= first) & (h <= last))))  # noqa: B023
        return rows

    def middle(self) -> tuple[Column, Column]:
        """The middle of a placed row's cell."""
        side = F.lit(self.size) / F.pow(F.lit(2.0), F.col("_level"))
        return (F.col("_cx") + 0.5) * side, (F.col("_cy") + 0.5) * side
