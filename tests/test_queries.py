"""Registered queries against DuckDB at the smallest scale, and the shape of their plans."""

import re

import pytest

import __spark_entry__ as entry_point
from compare import check, connect

PLANS, ORACLES = entry_point.queries(), entry_point.oracle_sql()



@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_registry():
    assert set(ORACLES) <= set(PLANS) and len(PLANS) >= 110
    assert len(ORACLES) >= 90
    # a limit only where it is the feature
    limited = {n for n, sql in ORACLES.items() if re.search(r"\bLIMIT\b", sql)}
    assert limited <= {"worst_videos", "seeded_sample"}


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["score", "n", "mean", "std", "min", "max", "median"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_matches_sql(spark, sf_dir, con, name):
    ok, message, rows = check(spark, name, PLANS[name], ORACLES.get(name), sf_dir, con)
    assert ok, message
    assert rows > 0 or name in {"score_response", "longitudinal_exclusion", "retry_list"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["path_parse", "composite_v2", "gap_interp", "hampel", "cycle_features", "med_pairs", "visit_pivot_deltas", "resume_antijoin", "frame_filter", "hausdorff_w1", "loso_ridge"],
)
def test_no_cartesian_products(spark, sf_dir, name):
    plan = plan_of(PLANS[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    # the only nested loop allowed is the carry or scalar join of at most two rows per slice
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned(spark, sf_dir):
    plan = plan_of(PLANS["interruptions"](spark, sf_dir))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans and all("l_tax" not in s and "l_returnflag" not in s for s in scans)


def test_window_stack_shares_one_exchange(spark):
    from pyspark.sql import functions as F

    from oscilla.operators import sequence as S

    df = spark.range(100).select(
        (F.col("id") % 5).alias("video"), F.lit(0).alias("clip"), F.col("id").alias("frame_idx"), F.rand().alias("v")
    )
    out = S.gradient(S.hampel(S.interpolate_gaps(df, "v", "a"), "a", "b"), "b", "c", 25.0)
    assert plan_of(out).count("Exchange hashpartitioning") == 1
