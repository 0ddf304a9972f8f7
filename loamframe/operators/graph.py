"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loamframe.storage import Scratch, written

#: Rows of a file of labels, so that small graphs do not make many files.
ROWS_PER_FILE = 200_000


def components(links: DataFrame, keeper: Scratch | None = None) -> DataFrame:
    """id and component (the smallest id reachable) of every id in links (a, b).

    Labels sink to the smallest one next to each id, then to their label's label,
    until none changes.  The rounds run when this is called: each writes its labels
    to the shared folder.  These tables go when keeper ends; without one, all but
    the last go at once.
    """
    if keeper is None:
        with Scratch(links.sparkSession) as scratch:
            return written(components(links, scratch), "components")
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("src", "dst")
    edges = keeper.table(both, "edges")
    files = 1 + edges.count() // ROWS_PER_FILE
    first = edges.groupBy("src").agg(F.min("dst").alias("m"))
    labels = keeper.table(first.select(F.col("src").alias("id"), F.least("src", "m").alias("component")).coalesce(files), "labels")
    while True:
        around = edges.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        sunk = labels.join(around, F.col("id") == F.col("src")).select("id", F.col("component").alias("old"), F.least("component", "m").alias("label"))
        above = labels.select(F.col("id").alias("p"), F.col("component").alias("q"))
        new = sunk.join(above, F.col("label") == F.col("p"), "left").select("id", "old", F.coalesce(F.least("label", "q"), F.col("label")).alias("component"))
        moved = Observation()
        new = new.observe(moved, F.count_if(F.col("component") != F.col("old")).alias("n"))
        labels = keeper.table(new.select("id", "component").coalesce(files), "labels")
        if not moved.get["n"]:
            return labels
