"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each; the cell's index
on the Hilbert curve orders the documents, and the order is cut into runs.  A
run covers few cells in every dimension, so that a manifest of the runs' ranges
prunes files for predicates on any of them.

Rows of one cell are spread over hash buckets of the id; only the bounded table
of cells is summed in one task.  Everything is DataFrame expressions.

Defined results: null texts have size 1 and checksum 0; very long texts are sized
and summed whole, and above about 46 kB all lie in the last level of size; null
metadata lie in bucket 0; null ids come first in their bucket; repeated rows take slots of their
own; equal texts are rows like others, which law `rows` may place in several shards, and
no two documents are kept together; an empty table gives no rows; other columns, whatever their names, are not
read, and carried through by `write`, whose own columns give way to columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.llm.bloom import free_name
from loamframe.llm.ranking import hash_bucket, ranked
from loamframe.storage import keep

BITS = 5
#: Buckets that the rows of one cell are spread over.
SPREAD = 512


@dataclass(frozen=True)
class Hashed:
    """A dimension of equality predicates: a hash bucket of the value."""

    column: str

    def level(self, bits: int) -> Column:
        value = F.col(self.column).cast("string")
        return F.when(value.isNull(), 0).otherwise(F.pmod(F.crc32(value.cast("binary")), F.lit(1 << bits))).cast("int")


@dataclass(frozen=True)
class Log2:
    """A dimension of range predicates: steps of the logarithm of a positive number."""

    column: str
    per_octave: int = 2

    def level(self, bits: int) -> Column:
        step = F.floor(F.log2(F.greatest(F.col(self.column).cast("double"), F.lit(1.0))) * self.per_octave)
        return F.coalesce(F.least(step, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def size_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def with_hilbert_index(rows: DataFrame, levels: Sequence[str], bits: int, name: str) -> DataFrame:
    """rows with the index on the Hilbert curve of a cell with `bits` bits in each of the columns `levels`.

    Coordinates are rotated and reflected from the highest bit down, then
    Gray-coded; their bits, interleaved, are the index.  Each step is a projection
    of its own, so that compiled code computes every value once.
    """
    n = len(levels)
    xs = [f"_x{i}" for i in range(n)]
    rows = rows.withColumns({x: F.col(c).cast("int") for x, c in zip(xs, levels, strict=True)})
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, F.lit((1 << bit) - 1)
        for x in xs:
            here, first = F.col(x), F.col(xs[0])
            is_set = here.bitwiseAND(F.lit(q)) != 0
            if x == xs[0]:
                rows = rows.withColumns({x: F.when(is_set, here.bitwiseXOR(low)).otherwise(here)})
            else:
                swap = first.bitwiseXOR(here).bitwiseAND(low)
                rows = rows.withColumns({xs[0]: first.bitwiseXOR(F.when(is_set, low).otherwise(swap)), x: F.when(is_set, here).otherwise(here.bitwiseXOR(swap))})
    for before, x in zip(xs, xs[1:], strict=False):
        rows = rows.withColumns({x: F.col(x).bitwiseXOR(F.col(before))})
    flips = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        flips = flips.bitwiseXOR(F.when(F.col(xs[-1]).bitwiseAND(F.lit(1 << bit)) != 0, (1 << bit) - 1).otherwise(0))
    rows = rows.withColumns({"_flips": flips})
    rows = rows.withColumns({x: F.col(x).bitwiseXOR(F.col("_flips")) for x in xs})
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for x in xs:
            index = index * 2 + F.shiftright(F.col(x), bit).bitwiseAND(F.lit(1))
    return rows.withColumns({name: index.cast("long")}).drop(*xs, "_flips")


def with_shards(rows: DataFrame, cell: str, id_col: str, shards: int, law: str = "rows") -> DataFrame:
    """rows with shard and slot, cut along (cell, hash of the id, id).

    law `rows`: the counts of two shards differ by one at most.  law `bytes`: the
    column `size` is cut, and the sums differ by about a row.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    rows = rows.withColumn("_bucket", hash_bucket(F.col(id_col).cast("string"), n=SPREAD))
    ties = [F.col(id_col), F.col("size"), F.col("text_crc32")]
    placed = ranked(rows, [cell], "_bucket", ties)
    in_order = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cells = (
        rows.groupBy(F.col(cell).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"))
        .select(
            "_cell",
            F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_first"),
            F.sum("_n").over(whole).alias("_all"),
            F.coalesce(F.sum("_bytes").over(in_order), F.lit(0)).alias("_first_bytes"),
            F.sum("_bytes").over(whole).alias("_all_bytes"),
        )
    )
    placed = placed.join(cells, F.col(cell) == F.col("_cell")).withColumn("_global", F.col("_first") + F.col("_rank"))
    if law == "rows":
        shard = F.call_function("div", F.col("_global") * shards, F.col("_all"))
        first = F.call_function("div", F.col("shard").cast("long") * F.col("_all") + (shards - 1), F.lit(shards).cast("long"))
        placed = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_global") - first).cast("long"))
    else:
        inside = Window.partitionBy(cell, "_bucket").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(F.col(cell).alias("_c"), F.col("_bucket").alias("_b")).agg(F.sum("size").alias("_s"))
        sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        placed = placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        placed = placed.join(sums, (F.col(cell) == F.col("_c")) & (F.col("_bucket") == F.col("_b")))
        middle = (F.col("_first_bytes") + F.col("_before") + F.col("_in")) * 2 + F.col("size")
        shard = F.least(F.lit(shards - 1), F.floor(middle.cast("double") * shards / (F.col("_all_bytes") * 2)))
        placed = placed.withColumn("shard", shard.cast("int"))
        starts = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("_global").alias("_start"))  # one row per shard
        placed = placed.join(F.broadcast(starts), F.col("shard") == F.col("_shard")).withColumn("slot", (F.col("_global") - F.col("_start")).cast("long"))
    return placed.select(*rows.drop("_bucket").columns, "shard", "slot")


DOCUMENT_DIMENSIONS = (Hashed("source"), Hashed("lang"), Log2("size"))


def shard_documents(df: DataFrame, shards: int = 8, law: str = "rows", dimensions: Sequence[Hashed | Log2] = DOCUMENT_DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, size, text_crc32, the levels of the dimensions, cell, shard and slot."""
    text = F.col(text_col).cast("string")
    metadata = [d.column for d in dimensions if d.column != "size"]
    rows = df.select(F.col(id_col), size_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), *metadata)
    rows = rows.select(id_col, "size", "text_crc32", *[d.level(BITS).alias(f"level_{d.column}") for d in dimensions])
    rows = with_hilbert_index(rows, [f"level_{d.column}" for d in dimensions], BITS, "cell")
    return with_shards(keep(rows), "cell", id_col, shards, law)


def manifest(assigned: DataFrame) -> DataFrame:
    """One row per shard: rows, bytes and the range of every level, for pruning."""
    levels = [c for c in assigned.columns if c.startswith("level_")]
    ranges = [f(c).alias(f"{f.__name__}_{c}") for c in levels for f in (F.min, F.max)]
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ranges)


def prune(shards: DataFrame, **levels: int) -> DataFrame:
    """Rows of a manifest that can hold documents with the given levels, as prune(m, source=3, lang=7)."""
    for name, level in levels.items():
        shards = shards.where((F.col(f"min_level_{name}") <= level) & (F.col(f"max_level_{name}") >= level))
    return shards


def write(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write df's rows as one folder of Parquet files per shard, in slot order; ids must be unique.

    Where df has columns shard or slot of its own, the written ones are called _shard and _slot.
    """
    key, shard, slot = (free_name(df, name) for name in ("_key", "shard", "slot"))
    placed = assigned.select(F.col(id_col).alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows = df.join(placed, F.col(id_col).eqNullSafe(F.col(key))).drop(key)
    rows.repartition(shard, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
