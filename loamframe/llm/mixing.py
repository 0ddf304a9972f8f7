"""Mixing sources to target weights by fitting each source's budget as a subset sum.

The size of a document is its number of words.  A source's target is water-filled
from weights and a cap.  As many whole passes over the source as fit are taken
first.  For the rest, documents are counted by exact length; each length gives
its proportional share, single documents then bring the open budget below a
constant, and a bounded-knapsack dynamic programme over the remaining lengths
finds the sum nearest below it.  Which documents of a length are taken follows
from a seeded hash of the id.

Defined results: null texts have size 0, very long ones are counted whole; a null
source is a source of its own and comes last; documents of size 0 follow their
source's whole passes; repeated rows count as documents of their own; an empty table
gives no rows; other columns, whatever their names, are not read, and pass through
`mixed`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamframe.llm.bloom import free_name
from loamframe.llm.ranking import ranked
from loamframe.storage import keep

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words that the knapsack programme looks at; what is above is filled before it.
DP_BUDGET = 1 << 16

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size), one row per source, with weight and target.

    The level at which sum(min(cap * size, level * weight)) meets the budget is
    found in one pass over the sources sorted by cap * size / weight: those below
    the level stop at their cap, the others share what is left by weight.
    """
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(everyone) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.partitionBy()
    found = (
        sources.withColumn("weight", weight.cast("double"))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
        # levels rise while sources are capped and fall after, so the highest is where the capping ends
        .withColumn("_level", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(whole))
    )
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("weight")))
    return found.select("source", "source_size", "weight", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take, so that the sum is the nearest found not above budget."""
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = counts - taken
    rest = budget - int((taken * lengths).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    while rest > DP_BUDGET:
        before = rest
        for k in order:
            if left[k] and 0 < lengths[k] <= rest:
                taken[k] += 1
                left[k] -= 1
                rest -= int(lengths[k])
                if rest <= DP_BUDGET:
                    break
        if rest == before:
            break
    top = min(rest, DP_BUDGET)
    # items are 1, 2, 4 ... documents of one length; came[s] is the item by which the sum s was first reached
    came = np.full(top + 1, -1, dtype=np.int64)
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k in order:
        n = min(int(left[k]), top // int(lengths[k])) if lengths[k] > 0 else 0
        part = 1
        while n > 0 and not reached[top]:
            part = min(part, n)
            weight = part * int(lengths[k])
            new = reached[: top + 1 - weight] & ~reached[weight:]
            came[weight:][new] = len(items)
            reached[weight:] |= new
            items.append((int(k), part))
            n -= part
            part *= 2
    s = int(np.flatnonzero(reached)[-1])
    while s:
        k, part = items[came[s]]
        taken[k] += part
        s -= part * int(lengths[k])
    return taken


def quotas(lengths: DataFrame, seed: int) -> DataFrame:
    """lengths (source, size, n, source_size, target) to (source, size, quota): documents taken beyond whole passes.

    One group holds a row per distinct length of one source, not its documents.
    """

    def fit_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        budget = int(round(target - (target // size) * size)) if size else 0
        rows["quota"] = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), budget, seed)
        return rows[["source", "size", "quota"]]

    return lengths.groupBy("source").applyInPandas(fit_source, "source string, size long, quota long")


def mix(df: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of df: id, size, source_size, target, copies (times taken) and taken (words taken).

    share is the part of all words that the mix holds, cap the most passes over a source.
    """
    slim = df.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("_order"),
        F.xxhash64(F.col(text_col)).alias("_text"),
    )
    rows = keep(slim)  # so that texts are read and counted once
    sizes = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goals = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target")
    lengths = sizes.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = quotas(lengths, seed).select(F.col("source").alias("_s"), F.col("size").alias("_l"), "quota")
    plan = plan.join(goals.withColumnRenamed("_s", "_g"), F.col("_s").eqNullSafe(F.col("_g"))).drop("_g")
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_order", 56).cast("int"))
    placed = ranked(rows, ["source", "size"], "_bucket", [F.col("_order"), F.col("_id"), F.col("_text")])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    copies = (passes + F.when(F.col("_rank") < F.col("quota"), 1).otherwise(0)).cast("long")
    return (
        placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_l")))
        .withColumn("copies", copies)
        .select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """df's rows as often as the mix takes them; rows with one id are all taken as often as the one taken most."""
    key, times, copy = (free_name(df, x) for x in ("_mixed_id", "_mixed_times", "_mixed_copy"))
    taken = mix(df, id_col=id_col, **options).groupBy(F.col(id_col).alias(key)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    rows = df.join(taken, F.col(id_col).eqNullSafe(F.col(key)))
    return rows.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(copy)).drop(copy)
