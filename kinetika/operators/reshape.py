"""From frame rows to series rows, and from feature rows to one row per entity."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetika.functions.columns import numeric


def resolve_id_vars(df: DataFrame, candidates: list[str], group_col: str) -> list[str]:
    """The candidates with at most one value in each group, where null counts as a value; the others are left out with a warning."""
    if not candidates:
        return []
    per_group = df.groupBy(group_col).agg(*[((F.min(c).isNotNull() & (F.min(c) != F.max(c))) | (F.count_if(F.col(c).isNull()).between(1, F.count("*") - 1))).alias(f"_{i}") for i, c in enumerate(candidates)])
    varies = per_group.agg(*[F.coalesce(F.bool_or(f"_{i}"), F.lit(False)).alias(f"_{i}") for i in range(len(candidates))]).first()
    dropped = [c for i, c in enumerate(candidates) if varies[i]]
    if dropped:
        warnings.warn(f"columns that vary within a group are left out: {dropped}", stacklevel=3)
    return [c for c in candidates if c not in dropped]


def series_arrays(df: DataFrame, value_cols: list[str], id_vars: list[str] | None = None, group_col: str = "video_filename", frame_col: str = "frame") -> DataFrame:
    """One row per series: the group, its id columns, ``series``, ``frames`` and ``values`` in the order of frames.

    A frame that occurs twice in a series is an error when the rows are read. One shuffle on the group makes all series.
    """
    rest = [c for c in df.columns if c not in {*value_cols, group_col, frame_col}]
    ids = resolve_id_vars(df, rest, group_col) if id_vars is None else [c for c in id_vars if c != group_col]
    grouped = df.groupBy(group_col, *ids).agg(F.array_sort(F.collect_list(F.struct(F.col(frame_col).alias("frame"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(value_cols)]))).alias("_rows"))
    checked = F.when(F.size(F.array_distinct(F.col("_rows.frame"))) == F.size("_rows"), F.col("_rows.frame")).otherwise(F.raise_error(F.concat(F.lit("a frame occurs twice in "), F.col(group_col).cast("string"))))
    parts = F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"_rows.v{i}").alias("values")) for i, c in enumerate(value_cols)])
    return grouped.select(group_col, *ids, checked.alias("frames"), F.explode(parts).alias("_s")).select(group_col, *ids, F.col("_s.series").alias("series"), "frames", F.col("_s.values").alias("values"))


def to_wide(series: DataFrame, prefix: str = "fr_") -> DataFrame:
    """``values`` as one column per frame, in rising order; frames that a series lacks are null."""
    numbers = sorted(r.frame for r in series.select(F.explode("frames").alias("frame")).distinct().collect())  # as many as a series has frames
    mapped = F.map_from_arrays("frames", "values")
    kept = [c for c in series.columns if c not in ("frames", "values")]
    return series.withColumn("_m", mapped).select(*kept, *[F.try_element_at("_m", F.lit(n).cast(series.schema["frames"].dataType.elementType)).alias(f"{prefix}{n}") for n in numbers])


def reshape_to_wide(df: DataFrame, value_cols: list[str], id_vars: list[str] | None = None, group_col: str = "video_filename", frame_col: str = "frame") -> DataFrame:
    return to_wide(series_arrays(df, value_cols, id_vars, group_col, frame_col))


def frame_columns(wide: DataFrame, frame_pattern: str = "^fr_") -> list[str]:
    found = [c for c in wide.columns if re.search(frame_pattern, c)]
    if not found:
        raise ValueError(f"no column matches {frame_pattern!r}")
    return found


def split_wide(wide: DataFrame, frame_pattern: str = "^fr_") -> tuple[list[str], Column]:
    """The metadata columns and the frames as an array column."""
    frames = frame_columns(wide, frame_pattern)
    return [c for c in wide.columns if c not in frames], F.array(*[F.col(c).cast("double") for c in frames])


def pivot_features_wide(df: DataFrame, group_col: str, series_col: str = "series", feature_columns: list[str] | None = None, id_vars: list[str] | None = None, series: list[str] | None = None) -> DataFrame:
    """One row per entity with a column ``{feature}_{series}``, feature by feature."""
    ids = [c for c in id_vars or [] if c != group_col]
    features = feature_columns or [c for c in numeric(df) if c not in {group_col, series_col, *ids}]
    names = series or sorted(r[0] for r in df.select(series_col).distinct().collect())
    pivoted = df.groupBy(group_col, *ids).pivot(series_col, names).agg(*[F.first(f).alias(f"_{i}_") for i, f in enumerate(features)])
    return pivoted.select(group_col, *ids, *[F.col(f"`{s}__{i}_`").alias(f"{f}_{s}") for i, f in enumerate(features) for s in names])
