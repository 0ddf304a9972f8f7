"""From documents to training shards: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet to the shared folder and read again.  All but the
last return the columns of documents.

Defined results: rows with a null id are never labelled, deduplicated or found to
leak, so only their toxicity drops them; null and empty texts pass all filters, and
very long ones are read whole; rows with one id are dropped or kept together and, in
the mix, all taken as often as the one taken most; an empty table gives no rows; extra
columns, whatever their names, pass through all stages but the last, which does not
read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamframe.llm import decontaminate, mixing, neardup, toxicity
from loamframe.llm.queries import shard_digest, table
from loamframe.storage import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; labels of held-out ids are not learnt from."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with five-word shingles at a similarity of 0.8 or more."""
    return neardup.without_near_duplicates(docs, neardup.Similarity(width=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents in eight shards along a Hilbert curve."""
    return shard_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
