"""Every catalogue query against its SQL, and the entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from loamframe.plans import catalog

QUERIES, SQL = catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame, order):
    def plain(x):
        if x is None or pd.api.types.is_scalar(x) and pd.isna(x):
            return ""
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[order].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    found, expected = QUERIES[name](spark, sf), duck.sql(SQL[name])
    order = sorted(found.columns)
    assert order == sorted(expected.columns)
    assert rows(found.toPandas(), order) == rows(expected.df(), order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data folders and the pipeline everything else still imports."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "loamframe"), tmp_path / "loamframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_queries_read_whole_tables(spark, sf):
    rows = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    buyers = rows("orders").select("o_custkey").distinct().count()
    assert QUERIES["detection_counts"](spark, sf).groupBy().sum("n").first()[0] == buyers
    assert QUERIES["utm_round_trip"](spark, sf).count() == rows("customer").count()
    assert QUERIES["ranked_counts"](spark, sf).groupBy().sum("n").first()[0] == rows("lineitem").count()
    assert QUERIES["merge_cubes"](spark, sf).where("spent IS NOT NULL").count() == buyers
    assert QUERIES["cross_job_grid"](spark, sf).count() == 3 * rows("region").count() * rows("nation").count()
