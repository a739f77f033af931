"""The physical plans that scale: how often rows are shuffled, and what a scan reads."""

import re

from pyspark.sql import functions as F

import kinetika as K
from kinetika.operators import features, nmf, normalisation, plots, reshape

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Round|Single)", plan(df)))


def test_one_shuffle_makes_all_features(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert shuffles(features.native_features(events, ["user_id"], "event_id", "value")) == 1
    assert shuffles(features.frame_features(events, ["user_id"], "event_id", "value")) == 1
    assert "props" not in plan(features.native_features(events, ["user_id"], "event_id", "value"))


def test_one_shuffle_smooths_all_columns(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    assert shuffles(K.RollingSmoother(2, "l_orderkey", ["l_tax", "l_discount"], order_col="l_linenumber").transform(lines)) == 1


def test_normalising_shuffles_one_row(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_tax", "l_discount")
    made = normalisation.ZScoreShiftNormalizer(["l_tax", "l_discount"]).fit(lines).transform(lines)
    assert shuffles(made) == 1 and "SinglePartition" in plan(made) and "BroadcastNestedLoopJoin" in plan(made)


def test_series_take_one_shuffle_and_filters_reach_the_scan(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").filter(F.col("l_orderkey") > 10)
    made = reshape.series_arrays(lines, ["l_tax"], [], "l_orderkey", "l_linenumber")
    assert shuffles(made) == 1 and "PushedFilters: [IsNotNull(l_orderkey), GreaterThan(l_orderkey,10)]" in plan(made) and "l_comment" not in plan(made) and "l_quantity" not in plan(made)


def test_smoothing_has_no_frame_that_is_read_anew_for_every_row(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    made = plan(K.RollingSmoother(4, "user_id", ["value"], order_col="event_id").transform(events.select("user_id", "event_id", "value")))
    assert "unboundedpreceding$(), unboundedfollowing$()" in made and "currentrow$(), unboundedfollowing$()" not in made


def test_folds_need_no_task_with_all_groups(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderstatus")
    made = plan(K.RepeatedStratifiedGroupKFold(5, 2, 1).assign(orders, "o_orderstatus", "o_custkey"))
    assert "SinglePartition" not in made and "Window" in made and "BroadcastHashJoin" in made


def test_density_counts_before_it_meets_the_grid(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("y"), (F.col("id") / 1000).alias("s"))
    made = plan(plots.probability_distribution_data(rows, "y", "s", 16))
    assert made.index("BroadcastNestedLoopJoin") < made.rindex("HashAggregate") and made.count("BroadcastNestedLoopJoin") == 1


def test_factorisation_shuffles_sums_alone(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_tax", "l_discount")
    model = nmf.NMFDecomposer(1, ["l_tax", "l_discount"], max_iter=3).fit(lines)
    assert shuffles(model.transform(lines)) == 0 and "ArrowEvalPython" in plan(model.transform(lines))
