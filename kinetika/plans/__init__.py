"""Whole plans: from frames to a fitted, evaluated classifier."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetika.operators.cleaning import FeatureCleaner
from kinetika.operators.features import extract_timeseries_features
from kinetika.operators.nmf import NMFDecomposer
from kinetika.operators.normalisation import ZScoreShiftNormalizer
from kinetika.operators.representatives import RepresentativeAUSelector
from kinetika.operators.reshape import pivot_features_wide, series_arrays
from kinetika.operators.selection import BorutaSelector
from kinetika.operators.smoothing import RollingSmoother


@dataclass
class DynamicsPipeline:
    """Smooth, normalise, factorise, pick representatives, extract features, clean and select. Fitted on training rows alone."""

    group_col: str = "video_filename"
    frame_col: str = "frame"
    label_col: str = "isfakeorreal"
    id_vars: list[str] = field(default_factory=lambda: ["isfakeorreal"])
    window: int = 4
    n_components: int = 3
    column_pattern: str = "_r$"
    impute: bool | str = "median"
    selector: BorutaSelector | None = None
    random_state: int = 0

    def _features(self, frames: DataFrame) -> DataFrame:
        columns = self.representatives_.selected_columns_
        series = series_arrays(frames.select(self.group_col, self.frame_col, *self.id_vars, *columns), columns, self.id_vars, self.group_col, self.frame_col)
        features = extract_timeseries_features(series)
        return pivot_features_wide(features, self.group_col, id_vars=self.id_vars, series=sorted(columns))

    def fit(self, frames: DataFrame) -> DynamicsPipeline:
        self.smoother_ = RollingSmoother(self.window, self.group_col, column_pattern=self.column_pattern, order_col=self.frame_col).fit(frames)
        smoothed = self.smoother_.transform(frames)
        self.normalizer_ = ZScoreShiftNormalizer().fit(smoothed)
        normal = self.normalizer_.transform(smoothed)
        self.decomposer_ = NMFDecomposer(self.n_components, random_state=self.random_state, max_iter=100, tol=1e-5).fit(normal)
        self.representatives_ = RepresentativeAUSelector(self.decomposer_).fit(normal)
        features = self._features(normal)
        self.cleaner_ = FeatureCleaner([c for c in features.columns if c not in {self.group_col, *self.id_vars}], impute=self.impute, random_state=self.random_state).fit(features)
        cleaned = self.cleaner_.transform(features)
        self.features_ = self.cleaner_.get_feature_names_out()
        if self.selector is not None:
            self.selector.feature_columns = self.features_
            self.selector.fit(cleaned.filter(F.col(self.label_col).isNotNull()), self.label_col)
            self.features_ = self.selector.selected_columns_
        return self

    def transform(self, frames: DataFrame) -> DataFrame:
        """One row per entity with the chosen features; nothing is refitted."""
        cleaned = self.cleaner_.transform(self._features(self.normalizer_.transform(self.smoother_.transform(frames))))
        return cleaned.select(self.group_col, *self.id_vars, *self.features_)
