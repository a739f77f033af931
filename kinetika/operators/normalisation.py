"""Z-scores with frozen moments, shifted to be non-negative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetika.functions.columns import by_pattern, missing_to_null


class ZScoreShiftNormalizer:
    """z = (x - mean) / sd with the mean and sd of the fitted rows, minus the least z of the rows being transformed; missing becomes 0.

    ``fit`` runs one aggregation. ``transform`` stays lazy: the least values are a one-row aggregate that is broadcast.
    """

    def __init__(self, columns: list[str] | None = None, column_pattern: str = "^smth_") -> None:
        self.columns, self.column_pattern = columns, column_pattern

    def fit(self, df: DataFrame) -> ZScoreShiftNormalizer:
        self.columns_ = by_pattern(df, self.columns, self.column_pattern)
        row = df.agg(*[f(missing_to_null(F.col(c))).alias(f"{k}{i}") for i, c in enumerate(self.columns_) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        self.means_ = {c: row[f"m{i}"] for i, c in enumerate(self.columns_)}
        self.sds_ = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(self.columns_)}  # 0 or none: 1
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "means_"):
            raise ValueError("fit the normalizer first")
        values = {c: missing_to_null(F.col(c)) for c in self.columns_}
        least = df.agg(*[F.min(v).alias(f"_least_{i}") for i, v in enumerate(values.values())])
        scaled = {c: F.coalesce((v - F.lit(self.means_[c])) / self.sds_[c] - (F.col(f"_least_{i}") - F.lit(self.means_[c])) / self.sds_[c], F.lit(0.0)) for i, (c, v) in enumerate(values.items())}
        return df.crossJoin(F.broadcast(least)).withColumns(scaled).select(*df.columns)  # one row

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
