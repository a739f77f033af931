"""Feature extractors from outside: any Python function, or a function of an R package."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetika.functions.columns import missing_to_null
from kinetika.operators.features import apply_rowwise
from kinetika.operators.reshape import split_wide


def as_features(result, feature_names: list[str] | None = None) -> dict[str, float]:
    """Named values from a Series, a mapping, (names, values), {"names", "values"}, or a bare sequence with ``feature_names``."""
    if isinstance(result, pd.Series):
        return {str(k): float(v) for k, v in result.items()}
    if isinstance(result, Mapping):
        if set(result) == {"names", "values"}:
            return dict(zip(map(str, result["names"]), map(float, result["values"]), strict=True))
        return {str(k): float(v) for k, v in result.items()}
    if isinstance(result, tuple) and len(result) == 2 and not np.isscalar(result[0]):
        return dict(zip(map(str, result[0]), map(float, result[1]), strict=True))
    values = np.asarray(result, float).ravel()
    if feature_names is None:
        raise TypeError(f"the extractor returned {len(values)} values without names; give feature_names")
    if len(feature_names) != len(values):
        raise ValueError(f"{len(feature_names)} feature_names for {len(values)} values")
    return dict(zip(feature_names, map(float, values), strict=True))


class CallableFeatureExtractor:
    """``fn`` of each row's series as features. Without ``feature_names`` one row is tried on the driver to learn the names."""

    def __init__(self, fn: Callable[[np.ndarray], object], feature_names: list[str] | None = None, frame_pattern: str = "^fr_") -> None:
        self.fn, self.feature_names, self.frame_pattern = fn, feature_names, frame_pattern

    def fit(self, df: DataFrame) -> CallableFeatureExtractor:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        keep, values = split_wide(df, self.frame_pattern)
        fn, names = self.fn, self.feature_names
        if names is None:
            first = df.select(values.alias("v")).limit(1).collect()
            if not first:
                raise ValueError("feature_names are needed where there is no row to learn them from")
            names = list(as_features(fn(np.asarray(first[0].v, float))))
        given = self.feature_names
        return apply_rowwise(df, lambda x: as_features(fn(x), given), names, values, keep)


def require_rpy2(package: str) -> None:
    if importlib.util.find_spec("rpy2") is None:
        raise ImportError("rpy2 isn't installed: it is needed to call R; install it and R itself")
    try:
        from rpy2.robjects.packages import importr
    except Exception as error:
        raise ImportError(f"rpy2 can't start R: {error}") from error
    try:
        importr(package)
    except Exception as error:
        raise ImportError(f"the R package {package!r} isn't installed") from error


def as_feature_table(result, rows: int, feature_names: list[str] | None = None) -> dict[str, list[float]]:
    """Named columns of ``rows`` values each, from a mapping, a DataFrame, or a matrix with ``feature_names``."""
    if isinstance(result, (pd.DataFrame, Mapping)):
        table = {str(k): [float(v) for v in result[k]] for k in result}
    else:
        matrix = np.asarray(result, float)
        if feature_names is None or matrix.ndim != 2 or matrix.shape[1] != len(feature_names):
            raise TypeError(f"the extractor returned a matrix of shape {matrix.shape}; feature_names must name its columns")
        table = {n: matrix[:, i].tolist() for i, n in enumerate(feature_names)}
    if wrong := [k for k, v in table.items() if len(v) != rows]:
        raise ValueError(f"features {wrong} don't have a value for each of {rows} series")
    return table


class MatrixFeatureExtractor:
    """``fn`` of a matrix, one series a row, as features: one call for each batch of rows whose series are equally long.

    Without ``feature_names`` one row is tried on the driver to learn the names.
    """

    def __init__(self, fn: Callable[[np.ndarray], object], feature_names: list[str] | None = None, frame_pattern: str = "^fr_") -> None:
        self.fn, self.feature_names, self.frame_pattern = fn, feature_names, frame_pattern

    def fit(self, df: DataFrame) -> MatrixFeatureExtractor:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        keep, values = split_wide(df, self.frame_pattern)
        fn, given = self.fn, self.feature_names
        names = given
        if names is None:
            first = df.select(values.alias("v")).limit(1).collect()
            if not first:
                raise ValueError("feature_names are needed where there is no row to learn them from")
            names = list(as_feature_table(fn(np.asarray([first[0].v], float)), 1))

        @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
        def run(arrays: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame(np.nan, index=range(len(arrays)), columns=names)
            sizes = np.array([len(v) for v in arrays])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                table = as_feature_table(fn(np.stack([np.asarray(arrays.iloc[i], float) for i in at])), len(at), given)
                for n in names:
                    out.loc[at, n] = table[n]
            return out

        return df.withColumn("_results", run(values)).select(*keep, *[missing_to_null(F.col(f"_results.`{n}`")).alias(n) for n in names])


class RFeatureExtractor:
    """A function of an R package as features; every Python worker starts its own R.

    It is called with a matrix of series, one a row, for each batch of rows, or with ``per_row`` with one series after another.
    """

    def __init__(self, package: str, function: str | None = None, per_row: bool = False, frame_pattern: str = "^fr_", feature_names: list[str] | None = None, **r_kwargs) -> None:
        self.package, self.function, self.per_row, self.frame_pattern, self.feature_names, self.r_kwargs = package, function or package, per_row, frame_pattern, feature_names, r_kwargs

    def fit(self, df: DataFrame) -> RFeatureExtractor:
        require_rpy2(self.package)
        return self

    def caller(self) -> Callable[[np.ndarray], object]:
        """The call of R, for one series or for a matrix."""
        package, function, options, per_row = self.package, re.sub(r"\W", "_", self.function), self.r_kwargs, self.per_row

        def call(x: np.ndarray):
            from rpy2 import robjects
            from rpy2.robjects.packages import importr

            vector, home = robjects.FloatVector(x.ravel()), importr(package)
            if not hasattr(home, function):
                raise AttributeError(f"the R package {package!r} has no function {function!r}")
            made = getattr(home, function)(vector if per_row else robjects.r.matrix(vector, nrow=x.shape[0], byrow=True), **options)
            if per_row:
                return list(made.names), list(made)
            return {n: list(v) for n, v in zip(made.names, made, strict=True)}

        return call

    def transform(self, df: DataFrame) -> DataFrame:
        require_rpy2(self.package)
        kind = CallableFeatureExtractor if self.per_row else MatrixFeatureExtractor
        return kind(self.caller(), self.feature_names, self.frame_pattern).transform(df)


def cmfts_r_features(df: DataFrame, frame_pattern: str = "^fr_", n_cores: int = 1, **r_kwargs) -> DataFrame:
    """The features of the R package ``cmfts``, matrix by matrix."""
    return RFeatureExtractor("cmfts", "cmfts", frame_pattern=frame_pattern, n_cores=n_cores, **r_kwargs).fit(df).transform(df)
