"""Faces drawn from action units: 68 landmarks by an affine model, and the regions of the muscles.

The model isn't part of the library. ``load_face_model`` reads one from a file or from base64 text: a numpy archive, gzipped or not, of
``coef`` (action units x 136), ``intercept`` (136) and ``x_mean`` (action units), where the 136 values are 68 x and then 68 y.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetika.functions.labels import extract_au_code
from kinetika.operators.nmf import NMFDecomposer

LANDMARKS = 68
# The 68-point scheme, as ranges of landmarks; a closed line ends where it began.
OUTLINES = {"jaw": (0, 17), "left_brow": (17, 22), "right_brow": (22, 27), "nose_bridge": (27, 31), "nose_base": (31, 36), "left_eye": (36, 42), "right_eye": (42, 48), "outer_lips": (48, 60), "inner_lips": (60, 68)}
CLOSED = ("left_eye", "right_eye", "outer_lips", "inner_lips")
# Muscles as corners at landmarks, and the action unit that each shows.
MUSCLES = {
    "frontalis_inner_l": ("AU01", [27, 39, 21]), "frontalis_inner_r": ("AU01", [27, 42, 22]),
    "frontalis_l": ("AU02", [27, 39, 38, 37, 36, 17, 18, 19, 20, 21]), "frontalis_r": ("AU02", [27, 22, 23, 24, 25, 26, 45, 44, 43, 42]),
    "cor_sup_l": ("AU04", [28, 19, 20]), "cor_sup_r": ("AU04", [28, 23, 24]),
    "lev_lab_sup_an_l": ("AU09", [39, 49, 31]), "lev_lab_sup_an_r": ("AU09", [35, 42, 53]), "lev_lab_sup_l": ("AU10", [41, 40, 49]), "lev_lab_sup_r": ("AU10", [47, 46, 53]),
    "zyg_maj_l": ("AU12", [48, 3, 2]), "zyg_maj_r": ("AU12", [54, 13, 14]), "dep_ang_or_l": ("AU14", [48, 7, 6]), "dep_ang_or_r": ("AU14", [54, 9, 10]),
    "mentalis_l": ("AU15", [58, 7, 8]), "mentalis_r": ("AU15", [56, 9, 8]), "risorius_l": ("AU17", [4, 5, 48]), "risorius_r": ("AU17", [11, 12, 54]),
    "orb_oris_u": ("AU20", [48, 49, 50, 51, 52, 53, 54, 33]), "dep_lab_inf_l": ("AU23", [57, 58, 59, 6, 7]), "dep_lab_inf_r": ("AU23", [57, 56, 55, 10, 9]),
    "temporalis_l": ("AU26", [2, 1, 0, 17, 36]), "temporalis_r": ("AU26", [14, 15, 16, 26, 45]),
}
#: Rings around the eyes: the eye's outline, drawn so many times as large about its middle.
EYE_RINGS = {"AU45": 1.4, "AU07": 1.8, "AU06": 2.4}


@dataclass
class FaceModel:
    """(action units - mean) . coef + intercept gives the landmarks."""

    coef: np.ndarray
    intercept: np.ndarray
    mean: np.ndarray

    def predict(self, units: np.ndarray) -> np.ndarray:
        """Rows of action units as rows of 68 x and 68 y."""
        return (np.atleast_2d(units) - self.mean) @ self.coef + self.intercept

    def landmarks(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``df`` with ``landmark_x`` and ``landmark_y``, arrays of 68; a missing unit counts as its mean."""
        if len(columns) != len(self.mean):
            raise ValueError(f"the model needs {len(self.mean)} action units, not {len(columns)}")

        @F.arrow_udf("array<double>")
        def run(units: pa.Array) -> pa.Array:
            made = self.predict(np.asarray(units.flatten(), float).reshape(len(units), -1))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))

        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in zip(columns, self.mean, strict=True)])
        kept = [c for c in df.columns if c not in ("landmark_x", "landmark_y")]
        return df.withColumn("_face", run(values)).select(*kept, F.slice("_face", 1, LANDMARKS).alias("landmark_x"), F.slice("_face", LANDMARKS + 1, LANDMARKS).alias("landmark_y"))


def load_face_model(source: str) -> FaceModel:
    """The model in a file, or in base64 text."""
    try:
        raw = base64.b64decode(source, validate=True)
    except (binascii.Error, ValueError):
        with open(source, "rb") as file:
            raw = file.read()
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    with np.load(io.BytesIO(raw), allow_pickle=False) as held:
        model = FaceModel(*(np.asarray(held[k], float) for k in ("coef", "intercept", "x_mean")))
    if model.coef.shape != (len(model.mean), 2 * LANDMARKS) or model.intercept.shape != (2 * LANDMARKS,):
        raise ValueError(f"coefficients of shape {model.coef.shape} don't give {LANDMARKS} landmarks")
    return model


def outline_paths(face: np.ndarray) -> dict[str, np.ndarray]:
    """The lines of a face (68 x, then 68 y) as rows of points."""
    points = np.asarray(face, float).reshape(2, LANDMARKS).T
    return {n: np.concatenate([points[a:b], points[a : a + 1]]) if n in CLOSED else points[a:b] for n, (a, b) in OUTLINES.items()}


def muscle_regions(face: np.ndarray) -> dict[str, tuple[str, np.ndarray]]:
    """By muscle, the action unit that it shows and its corners."""
    points = np.asarray(face, float).reshape(2, LANDMARKS).T
    out = {n: (unit, points[corners]) for n, (unit, corners) in MUSCLES.items()}
    for side in ("left", "right"):
        eye = points[slice(*OUTLINES[f"{side}_eye"])]
        for unit, size in EYE_RINGS.items():
            out[f"orb_oc_{side[0]}_{unit}"] = (unit, eye.mean(axis=0) + size * (eye - eye.mean(axis=0)))
    return out


def face_map_data(spark: SparkSession, decomposer: NMFDecomposer, model: FaceModel, units: list[str]) -> DataFrame:
    """component, muscle, au, shade (0 to 1, of the component's largest weight) and corners (x, y) of every region of every component.

    ``units`` names the columns that the model takes, in its order; a face is drawn at its component's shades.
    """
    codes = [extract_au_code(c) for c in decomposer.columns_]
    rows = []
    for j, weights in enumerate(decomposer.components_):
        shade = {c: float(w / max(weights.max(), 1e-12)) for c, w in zip(codes, weights, strict=True) if c}
        face = model.predict(np.array([shade.get(extract_au_code(u) or u, 0.0) for u in units]))[0]
        for muscle, (unit, corners) in muscle_regions(face).items():
            rows.append((f"{decomposer.prefix}{j + 1}", muscle, unit, shade.get(unit), [(float(x), float(y)) for x, y in corners]))
    return spark.createDataFrame(rows, "component string, muscle string, au string, shade double, corners array<struct<x:double,y:double>>")
