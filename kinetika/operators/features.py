"""Time-series features of many series.

``frame_features`` works on frame rows: windows and aggregates on one shuffle give all but the three entropies and the partial
autocorrelations in the JVM, and those four come from an Arrow function over the array of the same group. ``extract_timeseries_features``
works on wide rows or array rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetika.functions import series as S
from kinetika.functions.columns import is_constant, missing_to_null
from kinetika.operators.reshape import split_wide

FEATURE_NAMES, FEATURE_GROUPS = S.FEATURE_NAMES, S.FEATURE_GROUPS
NATIVE = [f for f in FEATURE_NAMES if f not in ("pacf5_sumsq", "sample_entropy", "permutation_entropy", "spectral_entropy")]


def _check_threshold(rule: str | float) -> None:
    if not isinstance(rule, (int, float)) and rule not in ("mean", "median"):
        raise ValueError(f"activation_threshold must be 'mean', 'median' or a number, not {rule!r}")


def native_features(df: DataFrame, group_cols: list[str], order_col: str, value_col: str, activation_threshold: str | float = "mean", with_values: bool = False) -> DataFrame:
    """27 of the features for each group, in the JVM alone. A missing value is an error when the rows are read."""
    _check_threshold(activation_threshold)
    whole = Window.partitionBy(*group_cols)
    ordered = whole.orderBy(order_col)
    value = missing_to_null(F.col(value_col))
    base = df.select(*group_cols, F.col(order_col).alias("_o"), F.coalesce(value, F.raise_error(F.lit("a series must not have missing values")).cast("double")).alias("x"))
    ordered = whole.orderBy("_o")
    # Sums of doubles depend on their order in the last bits, and so does whether a value that equals the mean lies above it: add in the series' order.
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    staged = base.withColumns({"_n": F.count("*").over(whole), "_mean": F.avg("x").over(every), "_first": F.first("x").over(ordered), "_t": F.row_number().over(ordered) - 1, "_prev": F.lag("x").over(ordered), "_next": F.lead("x").over(ordered)})
    limit = F.median("x").over(whole) if activation_threshold == "median" else F.col("_mean") if activation_threshold == "mean" else F.lit(float(activation_threshold))
    staged = staged.withColumns({"_c": F.col("x") - F.col("_mean"), "_above": F.col("x") > F.col("_mean"), "_active": F.col("x") > limit})
    lags = {f"_p{k}": F.col("_c") * F.lag("_c", k).over(ordered) for k in range(1, 11)}
    staged = staged.withColumns(lags | {"_was_above": F.lag("_above").over(ordered), "_was_active": F.lag("_active").over(ordered), "_runs_above": F.sum((~F.col("_above")).cast("int")).over(ordered), "_runs_active": F.sum((~F.col("_active")).cast("int")).over(ordered)})
    # The level before a plateau: the last value that differs from this one.
    staged = staged.withColumn("_changed", (F.col("_prev").isNull() | (F.col("_prev") != F.col("x"))).cast("int")).withColumn("_level", F.sum("_changed").over(ordered))
    starts = F.when(F.col("_changed") == 1, F.col("_prev"))
    staged = staged.withColumn("_before", F.max(starts).over(Window.partitionBy(*group_cols, "_level")))
    size = Window.partitionBy(*group_cols, "_above", "_runs_above")
    staged = staged.withColumn("_run_above", F.when(F.col("_above"), F.count("*").over(size)))
    size = Window.partitionBy(*group_cols, "_active", "_runs_active")
    staged = staged.withColumn("_run_active", F.when(F.col("_active"), F.count("*").over(size)))
    n, power = F.count("*").cast("double"), F.sum(F.col("_c") * F.col("_c"))
    flat = is_constant(F.col("x"), F.col("_first"))
    step = F.col("x") - F.col("_prev")
    begins = F.col("_active") & ~F.coalesce("_was_active", F.lit(False))

    def unless_flat(c: Column) -> Column:
        return F.when(~F.col("_flat"), c)

    sums = {
        "_flat": flat, "length": n, "mean": F.avg("x"), "sd": F.stddev_samp("x"), "min": F.min("x"), "max": F.max("x"), "median": F.median("x"),
        "_q1": F.percentile("x", F.lit(0.25)), "_q3": F.percentile("x", F.lit(0.75)), "_m2": power, "_m3": F.sum(F.pow("_c", F.lit(3))), "_m4": F.sum(F.pow("_c", F.lit(4))),
        **{f"_acf{k}": F.sum(f"_p{k}") for k in range(1, 11)}, "_dsd": F.stddev_samp(step), "_mad": F.avg(F.abs(step)),
        "_slope": F.regr_slope("x", F.col("_t").cast("double")), "_r2": F.regr_r2("x", F.col("_t").cast("double")),
        "_cross": F.count_if(F.col("_above") != F.col("_was_above")), "_longest": F.max("_run_above"),
        "_prop": F.avg(F.col("_active").cast("double")), "_episodes": F.count_if(begins), "_on": F.count_if("_active"), "_longest_on": F.max("_run_active"),
        "_rise": F.avg(F.when(begins & F.col("_prev").isNotNull(), step)), "_fall": F.avg(F.when(~F.col("_active") & F.col("_was_active"), step)),
        "_peaks": F.count_if((F.col("_before") < F.col("x")) & (F.col("x") > F.col("_next"))),
    }
    if with_values:
        sums["_values"] = F.transform(F.array_sort(F.collect_list(F.struct("_t", "x"))), lambda s: s["x"])
    g = staged.groupBy(*group_cols).agg(*[c.alias(k) for k, c in sums.items()])
    acf = {k: F.when(F.col("length") > k, F.try_divide(F.col(f"_acf{k}"), F.col("_m2"))) for k in range(1, 11)}
    long_enough = F.col("length") >= 2
    out = {
        "mean": F.col("mean"), "sd": F.col("sd"), "min": F.col("min"), "max": F.col("max"), "range": F.col("max") - F.col("min"), "median": F.col("median"), "iqr": F.col("_q3") - F.col("_q1"),
        "skewness": unless_flat(F.try_divide(F.col("_m3") / F.col("length"), F.pow(F.col("_m2") / F.col("length"), F.lit(1.5)))),
        "kurtosis": unless_flat(F.try_divide(F.col("_m4") / F.col("length"), F.pow(F.col("_m2") / F.col("length"), F.lit(2))) - 3),
        "acf1": unless_flat(acf[1]), "acf2": unless_flat(acf[2]), "acf10_sumsq": unless_flat(sum(F.coalesce(a * a, F.lit(0.0)) for a in acf.values())), "pacf1": unless_flat(acf[1]),
        "diff1_sd": unless_flat(F.col("_dsd")), "mean_abs_diff": unless_flat(F.col("_mad")), "trend_slope": unless_flat(F.col("_slope")), "trend_r2": unless_flat(F.col("_r2")),
        "mean_crossings": unless_flat(F.col("_cross") / F.col("length")), "longest_run_above_mean": unless_flat(F.coalesce(F.col("_longest"), F.lit(0)) / F.col("length")),
        "prop_active": F.when(long_enough, F.col("_prop")), "n_episodes": F.when(long_enough, F.col("_episodes").cast("double")),
        "mean_episode_len": F.when(long_enough, F.try_divide(F.col("_on") / F.col("length"), F.col("_episodes"))), "max_episode_len": F.when(long_enough, F.col("_longest_on") / F.col("length")),
        "mean_onset_slope": F.when(long_enough, F.col("_rise")), "mean_offset_slope": F.when(long_enough, F.col("_fall")), "peak_rate": F.when(long_enough, F.col("_peaks") / F.col("length")), "length": F.col("length"),
    }
    return g.select(*group_cols, *[out[f].alias(f) for f in NATIVE], *(["_values"] if with_values else []))


def frame_features(df: DataFrame, group_cols: list[str], order_col: str, value_col: str, activation_threshold: str | float = "mean") -> DataFrame:
    """All 31 features for each group of frame rows. Each of the four in Arrow is a function of its own, so those not asked for aren't worked out."""

    def of_values(f: Callable[[np.ndarray], float]) -> Column:
        @F.pandas_udf("double")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([f(np.asarray(v, float)) for v in values], dtype=float)

        return missing_to_null(run("_values"))

    rest = {"pacf5_sumsq": S.pacf5_sumsq, "sample_entropy": S.sample_entropy, "permutation_entropy": S.permutation_entropy, "spectral_entropy": S.spectral_entropy}
    found = native_features(df, group_cols, order_col, value_col, activation_threshold, with_values=True)
    return found.select(*group_cols, *[(of_values(rest[f]) if f in rest else F.col(f)).alias(f) for f in FEATURE_NAMES])


def apply_rowwise(df: DataFrame, fn: Callable[[np.ndarray], dict[str, float]], names: list[str], values: Column, keep: list[str]) -> DataFrame:
    """``fn`` on each row's array; its results become double columns, NaN as null."""

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def run(arrays: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn(np.asarray(a, float)) for a in arrays], columns=names, dtype=float)

    return df.withColumn("_results", run(values)).select(*keep, *[missing_to_null(F.col(f"_results.`{n}`")).alias(n) for n in names])


def extract_timeseries_features(df: DataFrame, frame_pattern: str = "^fr_", activation_threshold: str | float = "mean", values_col: str = "values") -> DataFrame:
    """All 31 features of each row, whose series is in ``values_col`` or in the columns of ``frame_pattern``."""
    _check_threshold(activation_threshold)
    if values_col in df.columns:
        keep, values = [c for c in df.columns if c not in (values_col, "frames")], F.col(values_col)
    else:
        keep, values = split_wide(df, frame_pattern)
    return apply_rowwise(df, lambda x: S.extract_features(x, activation_threshold), FEATURE_NAMES, values, keep)


class TimeSeriesFeatureExtractor:
    """``extract_timeseries_features`` as a stage."""

    def __init__(self, frame_pattern: str = "^fr_", activation_threshold: str | float = "mean") -> None:
        self.frame_pattern, self.activation_threshold = frame_pattern, activation_threshold

    def fit(self, df: DataFrame) -> TimeSeriesFeatureExtractor:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return extract_timeseries_features(df, self.frame_pattern, self.activation_threshold)

    def get_feature_names_out(self) -> list[str]:
        return list(FEATURE_NAMES)
