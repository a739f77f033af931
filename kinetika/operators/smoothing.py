"""Rolling smoothing of series, as one window sort for all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetika.functions.columns import by_pattern, missing_to_null


class RollingSmoother:
    """Left-aligned rolling mean over ``window`` rows, extended to both ends of the series.

    A row's value is the mean of it and the ``window - 1`` rows after it, where none of them is missing; the last known value fills
    forward, then the first fills backward. A series shorter than the window has no value. Rows without a group have none either.
    Raw columns are kept, smoothed ones are added with ``prefix``. No fit is needed.
    """

    def __init__(self, window: int = 4, group_col: str = "video_filename", columns: list[str] | None = None, column_pattern: str = "_r$", prefix: str = "smth_", order_col: str = "frame") -> None:
        if window < 1:
            raise ValueError("window must be 1 at least")
        self.window, self.group_col, self.columns, self.column_pattern, self.prefix, self.order_col = window, group_col, columns, column_pattern, prefix, order_col

    def fit(self, df: DataFrame) -> RollingSmoother:
        self.columns_ = by_pattern(df, self.columns, self.column_pattern)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        columns = by_pattern(df, getattr(self, "columns_", self.columns), self.column_pattern)
        ordered = Window.partitionBy(self.group_col).orderBy(self.order_col)
        ahead = ordered.rowsBetween(0, self.window - 1)
        past, whole = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rolled = {f"_rolled_{i}": F.when((F.count(missing_to_null(F.col(c))).over(ahead) == self.window) & F.col(self.group_col).isNotNull(), F.avg(missing_to_null(F.col(c))).over(ahead)) for i, c in enumerate(columns)}
        # Only rows before the first known value lack a past one, and for them it is the first of the whole series: one value a series.
        filled = {self.prefix + c: F.coalesce(F.last(f"_rolled_{i}", ignorenulls=True).over(past), F.first(f"_rolled_{i}", ignorenulls=True).over(whole)) for i, c in enumerate(columns)}
        return df.withColumns(rolled).withColumns(filled).drop(*rolled)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
