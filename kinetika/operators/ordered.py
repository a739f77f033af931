"""Running totals over a global order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetika.session import materialize


def running_totals(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``df``, one row per ``order`` value, with ``before_{c}``: the sum of ``c`` over all smaller values.

    Rows are dealt by range; each range is summed within itself, and the totals of the ranges before it, one row per range, are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = sorted(dealt.groupBy("_range").agg(*[F.sum(c).alias(c) for c in columns]).collect(), key=lambda r: r._range)
    rows, sums = [], [0] * len(columns)
    for r in totals:
        rows.append((r._range, *map(float, sums)))
        sums = [a + r[c] for a, c in zip(sums, columns, strict=True)]
    offsets = df.sparkSession.createDataFrame(rows, "_range int, " + ", ".join(f"_off_{i} double" for i in range(len(columns))))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, *[(F.col(f"_off_{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for i, c in enumerate(columns)])


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """``value``, its ``count`` and ``mid_rank``, the mean of the ranks of equal values."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("count"))
    return running_totals(counted, value, ["count"]).select(value, "count", (F.col("before_count") + (F.col("count") + 1) / 2).alias("mid_rank"))
