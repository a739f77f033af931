"""Sources and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def frame_schema(signals: list[str], extra: list[str] = ()) -> T.StructType:
    """Video, partner, label, frame and signal columns, given rather than inferred."""
    names = ["video_filename", "corresponding_video", "isfakeorreal", *extra]
    return T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("frame", T.IntegerType()), *[T.StructField(s, T.DoubleType()) for s in signals]])


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV; in CSV a blank is null and ``inf`` is infinite."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if format == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, positiveInf="inf", negativeInf="-inf", nanValue="NaN", enforceSchema=False)
    return getattr(reader, format)(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if format == "csv" else getattr(writer, format)(path)


def write_json_summary(summary: dict, path: str) -> None:
    """A small summary as one JSON file, by the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(summary, indent=2, default=str))


def save_figure(figure, save_path: str | None, output_dir: str | None = None, dpi: int = 300) -> None:
    """Save a figure unless ``save_path`` is None; folders are made."""
    if save_path is None:
        return
    path = Path(output_dir or ".") / save_path
    path.parent.mkdir(parents=True, exist_ok=True)
    figure.savefig(path, dpi=dpi, bbox_inches="tight")
