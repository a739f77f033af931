"""The column that stands for each component."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kinetika.operators.nmf import NMFDecomposer


def representatives(decomposer: NMFDecomposer) -> list[str]:
    """For each component the column of the largest weight; the first one on ties."""
    return [decomposer.columns_[int(i)] for i in np.argmax(decomposer.components_, axis=1)]


def select_representative_aus(spark: SparkSession, decomposer: NMFDecomposer, labels: dict[str, str] | None = None) -> DataFrame:
    """component, au and, with ``labels``, label."""
    chosen = representatives(decomposer)
    if len(set(chosen)) < len(chosen):
        warnings.warn("one column represents several components", stacklevel=2)
    rows = [(f"{decomposer.prefix}{i + 1}", c, (labels or {}).get(c, c)) for i, c in enumerate(chosen)]
    made = spark.createDataFrame(rows, "component string, au string, label string")
    return made if labels else made.drop("label")


class RepresentativeAUSelector:
    """Keep the metadata and, of a fitted decomposer's columns, the representative ones, each once."""

    def __init__(self, decomposer: NMFDecomposer) -> None:
        self.decomposer = decomposer

    def fit(self, df: DataFrame) -> RepresentativeAUSelector:
        if not hasattr(self.decomposer, "components_"):
            raise ValueError("the decomposer must be fitted")
        chosen = representatives(self.decomposer)
        self.selected_columns_ = list(dict.fromkeys(chosen))
        if len(self.selected_columns_) < len(chosen):
            warnings.warn("one column represents several components; it is kept once", stacklevel=2)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[c for c in df.columns if c not in self.decomposer.columns_], *self.selected_columns_)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
