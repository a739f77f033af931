"""Save and load fitted objects: settings and arrays as JSON, Spark's models and tables in folders beside it.

A folder holds one object. ``state`` is a text table of JSON lines, numbered; ``parts`` has a folder for each Spark model or table
that the object holds. All of it is written through Spark, so any store that Spark reaches will do. The format has a version, and a
later library refuses versions that it doesn't know.
"""

from __future__ import annotations

import dataclasses
import json
import math
from importlib import import_module
from typing import Any

import numpy as np
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
#: Classes are looked up in these packages alone.
PACKAGES = ("kinetika.", "pyspark.ml.")
_LINE = 1 << 20


def _class_name(value: object) -> str:
    kind = type(value)
    if "<locals>" in kind.__qualname__ or not kind.__module__.startswith(PACKAGES):
        raise TypeError(f"{kind.__module__}.{kind.__qualname__} can't be saved")
    return f"{kind.__module__}:{kind.__qualname__}"


def _class_of(name: str) -> type:
    module, _, path = name.partition(":")
    if not module.startswith(PACKAGES):
        raise ValueError(f"{name!r} isn't a class of this library")
    found: Any = import_module(module)
    for part in path.split("."):
        found = getattr(found, part)
    return found


class _Writer:
    def __init__(self, folder: str) -> None:
        self.folder, self.parts = folder, 0

    def _part(self) -> str:
        self.parts += 1
        return f"parts/{self.parts}"

    def encode(self, value: object) -> object:
        if value is None or isinstance(value, (bool, str)):
            return value
        if isinstance(value, (int, np.integer)):
            return int(value)
        if isinstance(value, (float, np.floating)):
            return float(value) if math.isfinite(value) else {"float": repr(float(value))}
        if isinstance(value, np.ndarray):
            if value.dtype.kind not in "biufU":
                return {"objects": [self.encode(v) for v in value.tolist()]}
            return {"array": [self.encode(v) for v in value.ravel().tolist()], "shape": list(value.shape), "dtype": value.dtype.str}
        if isinstance(value, (list, tuple)):
            items = [self.encode(v) for v in value]
            return items if isinstance(value, list) else {"tuple": items}
        if isinstance(value, dict):
            return {"dict": [[self.encode(k), self.encode(v)] for k, v in value.items()]}
        if isinstance(value, DataFrame):
            part = self._part()
            value.write.mode("errorifexists").parquet(f"{self.folder}/{part}")
            return {"table": part}
        if isinstance(value, MLWritable):
            part = self._part()
            value.write().save(f"{self.folder}/{part}")
            return {"model": part, "class": _class_name(value)}
        state = {f.name: getattr(value, f.name) for f in dataclasses.fields(value)} if dataclasses.is_dataclass(value) else {}
        return {"object": _class_name(value), "state": [[k, self.encode(v)] for k, v in (state | vars(value)).items()]}


def save(value: object, folder: str, spark: SparkSession | None = None) -> None:
    """Write a fitted object to a new ``folder``; functions given to it can't be saved and are an error."""
    spark = spark or SparkSession.getActiveSession()
    text = json.dumps({"version": VERSION, "value": _Writer(folder).encode(value)})
    lines = [(i, text[a : a + _LINE]) for i, a in enumerate(range(0, len(text), _LINE))]
    spark.createDataFrame(lines, "i int, part string").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/state")


def load(folder: str, spark: SparkSession | None = None) -> Any:
    """The object that ``save`` wrote to ``folder``."""
    spark = spark or SparkSession.getActiveSession()
    made = json.loads("".join(r.part for r in spark.read.parquet(f"{folder}/state").orderBy("i").collect()))
    if made["version"] != VERSION:
        raise ValueError(f"{folder} has version {made['version']}; this library reads {VERSION}")

    def decode(value: Any) -> Any:
        if isinstance(value, list):
            return [decode(v) for v in value]
        if not isinstance(value, dict):
            return value
        if "float" in value:
            return float(value["float"])
        if "array" in value:
            return np.array([decode(v) for v in value["array"]], value["dtype"]).reshape(value["shape"])
        if "objects" in value:
            return np.array([decode(v) for v in value["objects"]], object)
        if "tuple" in value:
            return tuple(decode(v) for v in value["tuple"])
        if "dict" in value:
            return {decode(k): decode(v) for k, v in value["dict"]}
        if "table" in value:
            return spark.read.parquet(f"{folder}/{value['table']}")
        if "model" in value:
            kind = _class_of(value["class"])
            if not issubclass(kind, MLReadable):
                raise ValueError(f"{value['class']} can't be loaded")
            return kind.load(f"{folder}/{value['model']}")
        kind = _class_of(value["object"])
        out = kind.__new__(kind)
        for name, part in value["state"]:
            object.__setattr__(out, name, decode(part))
        return out

    return decode(made["value"])


def saved_versions(spark: SparkSession, folders: list[str]) -> DataFrame:
    """folder, version and class of saved objects."""
    out = None
    for folder in folders:
        whole = spark.read.parquet(f"{folder}/state").orderBy("i").agg(F.concat_ws("", F.collect_list("part")).alias("t"))
        row = whole.select(F.lit(folder).alias("folder"), F.get_json_object("t", "$.version").cast("int").alias("version"), F.get_json_object("t", "$.value.object").alias("class"))
        out = row if out is None else out.unionByName(row)
    return out
