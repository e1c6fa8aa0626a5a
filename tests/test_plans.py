"""Plans: pruned scans, no products of large sides, partial sums before each shuffle."""

import os

import pytest
from pyspark.sql import functions as F

from framelake.operators import histogram, pairs, statistics
from framelake.queries import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    text = plan(load()[0]["c2_all_densities"](spark, SF))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in text or "ReadSchema: struct<embedding:array<float>,label:int>" in text
    text = plan(load()[0]["p11_filter_ge"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text


def test_histograms_sum_before_the_shuffle(spark):
    text = plan(load()[0]["a1_weighted_histogram"](spark, SF))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1 and "partial_sum" in text


def test_cells_join_by_key(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("frame_index"), F.col("id").alias("atom_index"), *(F.lit(1.0).alias(c) for c in "xyz"))
    text = plan(pairs.cell_pairs(df, df, (10.0, 10.0, 10.0), 2.0))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_moments_need_one_shuffle_each(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("bin"), (F.col("id") % 5).alias("frame"), F.col("id").cast("double").alias("v"))
    sums = df.groupBy("bin", "frame").agg(F.sum("v").alias("v"))
    text = plan(statistics.dense_moments(sums, "bin", "v", 5))
    assert text.count("Exchange") == 2 and "Join" not in text


@pytest.mark.parametrize("name", sorted(load()[0]))
def test_no_cartesian_products(spark, name):
    if name.startswith("t"):  # streams run when they are built
        pytest.skip()
    assert "CartesianProduct" not in plan(load()[0][name](spark, SF))


def test_grid_guard(spark):
    grid = spark.range(50).select(F.col("id").cast("int").alias("i_x"))
    histogram.check_size(grid, 50)
    with pytest.raises(ValueError):
        histogram.check_size(grid, 49)
