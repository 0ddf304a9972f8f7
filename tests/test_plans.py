"""What the plans must not hold: nested loops, row-wise Python, or columns that nobody asked for."""

import pytest

from loamframe.plans import catalog

QUERIES, _ = catalog.load()
#: Grids of small dimensions are crosses; ledgers match at most their capacity's slots.
CROSSES = {"cross_job_grid", "extraction_plan"}
#: Forests and hulls run Python or collect by design; streams have run before their result is read.
OTHERS = {"ml_train_predict", "ml_feature_importance", "ml_cv", "ml_boosting", "cluster_hulls", "stream_interval_means", "overlap_groups", "overlap_groups_exact", "parcels_without_overlaps", "ml_gbdt", "dissolved_polygons", "dissolved_parcels", "buffer_outward", "buffer_inward"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHERS))
def test_plan(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    if name not in CROSSES:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "InPandas" not in text and "InArrow" not in text


def test_season_statistics_shuffle_twice(spark, sf):
    """By pixel, band and window; then by pixel and band, for all that follows."""
    assert plan(QUERIES["cube_statistics"](spark, sf)).count("Exchange hashpartitioning") == 2


def test_windows_of_a_day_are_not_joined(spark, sf):
    assert "Join" not in plan(QUERIES["cube_interval_median"](spark, sf))


def test_points_are_drawn_in_their_row(spark, sf):
    """No row per candidate, and no joins to find the first good one."""
    text = plan(QUERIES["polygon_points"](spark, sf))
    assert "Generate" not in text and "Join" not in text and "Exchange" not in text


def test_names_of_files_are_taken_apart_once(spark, sf):
    """What takes a name apart reads the sums per file, not every value."""
    assert "regexp_extract(format_string" not in plan(QUERIES["training_rows"](spark, sf))
