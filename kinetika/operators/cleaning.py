"""Diagnostics and cleaning of feature columns."""

from __future__ import annotations

import warnings

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetika.functions.columns import finite, is_constant, missing_to_null, numeric


def feature_diagnostics(df: DataFrame, feature_columns: list[str] | None = None) -> DataFrame:
    """A row per column: n_nan, pct_nan, n_inf, pct_inf, sd, is_constant, all_nan. One aggregation over all columns."""
    columns = feature_columns or numeric(df)
    exprs = []
    for i, c in enumerate(columns):
        x, f = missing_to_null(F.col(c)), finite(F.col(c))
        # any finite value serves as the one to hold the others against
        span = F.max(f) - F.min(f)
        exprs += [F.count_if(x.isNull()).alias(f"n{i}"), F.count_if(F.abs(x) == float("inf")).alias(f"i{i}"), F.stddev_samp(f).alias(f"s{i}"), F.coalesce(span <= 1e-12 + 1e-8 * F.greatest(F.abs(F.min(f)), F.abs(F.max(f))), F.lit(True)).alias(f"c{i}")]
    wide = df.agg(F.count("*").alias("rows"), *exprs)
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n_nan"), F.try_divide(F.col(f"n{i}").cast("double"), F.col("rows")).alias("pct_nan"), F.col(f"i{i}").alias("n_inf"), F.try_divide(F.col(f"i{i}").cast("double"), F.col("rows")).alias("pct_inf"), F.col(f"s{i}").alias("sd"), F.col(f"c{i}").alias("is_constant"), (F.col(f"n{i}") == F.col("rows")).alias("all_nan")) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*parts)).alias("d")).select("d.*")


class IterativeForestImputer:
    """Fill missing values by forests: each incomplete column, the least incomplete first, is predicted from all others, in rounds."""

    def __init__(self, columns: list[str], trees: int = 100, rounds: int = 10, tol: float = 1e-3, seed: int = 0) -> None:
        self.columns, self.trees, self.rounds, self.tol, self.seed = columns, trees, rounds, tol, seed

    def fit(self, df: DataFrame) -> IterativeForestImputer:
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in self.columns]).first()
        self.order_ = sorted((c for c in self.columns if row[c]), key=lambda c: row[c])
        self.start_ = df.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in self.columns]).first().asDict()
        self.models_: list[tuple[str, object]] = []
        if not self.order_:
            return self
        work, before = self._started(df).cache(), None
        for _ in range(self.rounds):
            models = []
            for c in self.order_:
                others = VectorAssembler(inputCols=[o for o in self.columns if o != c], outputCol="_x")
                forest = RandomForestRegressor(featuresCol="_x", labelCol=c, predictionCol="_p", numTrees=self.trees, seed=self.seed)
                model = forest.fit(others.transform(work.filter(~F.col(f"_gap_{c}"))))
                work = self._filled(work, c, model)
                models.append((c, model))
            self.models_ = models
            state = work.agg(*[F.avg(F.when(F.col(f"_gap_{c}"), F.col(c))).alias(c) for c in self.order_]).first()
            if before and all(abs(state[c] - before[c]) <= self.tol * max(1.0, abs(before[c])) for c in self.order_):
                break
            before = state
        return self

    def _started(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_gap_{c}": F.col(c).isNull() for c in self.columns}).withColumns({c: F.coalesce(F.col(c), F.lit(self.start_[c])) for c in self.columns})

    def _filled(self, work: DataFrame, c: str, model: object) -> DataFrame:
        others = VectorAssembler(inputCols=[o for o in self.columns if o != c], outputCol="_x")
        return model.transform(others.transform(work)).withColumn(c, F.when(F.col(f"_gap_{c}"), F.col("_p")).otherwise(F.col(c))).drop("_x", "_p")

    def transform(self, df: DataFrame) -> DataFrame:
        work = self._started(df)
        for c, model in self.models_:
            work = self._filled(work, c, model)
        return work.select(*df.columns)


class FeatureCleaner:
    """Infinite to missing, drop columns, impute, drop constant columns; all decisions are frozen at fit.

    ``impute``: True for forests, ``"median"`` or ``"mean"`` for Spark's imputer, any estimator that keeps column names, or False.
    A column is dropped if it is named, or if its missing share is ``max_nan_fraction`` or more.
    """

    def __init__(self, feature_columns: list[str] | None = None, drop_columns: list[str] | None = None, max_nan_fraction: float = 1.0, impute: bool | str | Estimator = True, drop_zero_sd: bool = True, random_state: int | None = None) -> None:
        self.feature_columns, self.drop_columns, self.max_nan_fraction, self.impute, self.drop_zero_sd, self.random_state = feature_columns, drop_columns, max_nan_fraction, impute, drop_zero_sd, random_state

    def fit(self, df: DataFrame) -> FeatureCleaner:
        self.feature_columns_ = self.feature_columns or numeric(df)
        cleaned = df.withColumns({c: finite(F.col(c)) for c in self.feature_columns_})
        self.diagnostics_ = feature_diagnostics(df, self.feature_columns_)
        share = cleaned.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in self.feature_columns_]).first()
        explicit = set(self.drop_columns or [])
        if missing := explicit - set(self.feature_columns_):
            raise KeyError(f"columns to drop that aren't features: {sorted(missing)}")
        self.dropped_columns_ = sorted(explicit | {c for c in self.feature_columns_ if (share[c] or 0.0) >= self.max_nan_fraction})
        left = [c for c in self.feature_columns_ if c not in self.dropped_columns_]
        self.imputer_ = self._imputer(left)
        if self.imputer_ is not None and left:
            self.imputer_ = self.imputer_.fit(cleaned)
            cleaned = self.imputer_.transform(cleaned)
        self.zero_sd_columns_ = []
        if self.drop_zero_sd and left:
            firsts = cleaned.agg(*[F.any_value(c, True).alias(f"_f{i}") for i, c in enumerate(left)])
            row = cleaned.crossJoin(F.broadcast(firsts)).agg(*[(is_constant(F.col(c), F.col(f"_f{i}")) & (F.count(c) == F.count("*"))).alias(f"_{i}") for i, c in enumerate(left)]).first()
            self.zero_sd_columns_ = sorted(c for i, c in enumerate(left) if row[i])
            if self.zero_sd_columns_:
                warnings.warn(f"constant columns are dropped: {self.zero_sd_columns_}", stacklevel=2)
        self.feature_names_out_ = [c for c in left if c not in self.zero_sd_columns_]
        return self

    def _imputer(self, columns: list[str]):
        if self.impute is False or not columns:
            return None
        if self.impute is True:
            return IterativeForestImputer(columns, seed=self.random_state or 0)
        if self.impute in ("median", "mean"):
            return Imputer(inputCols=columns, outputCols=columns, strategy=self.impute)
        return Pipeline(stages=[self.impute]) if isinstance(self.impute, Estimator) else self.impute

    def transform(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "feature_names_out_"):
            raise ValueError("fit the cleaner first")
        out = df.withColumns({c: finite(F.col(c)) for c in self.feature_columns_ if c not in self.dropped_columns_})
        if self.imputer_ is not None:
            out = self.imputer_.transform(out)
        return out.select(*[c for c in df.columns if c not in self.feature_columns_], *self.feature_names_out_)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def get_feature_names_out(self) -> list[str]:
        return list(self.feature_names_out_)
