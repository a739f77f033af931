"""Four classifiers, each standardised features and an estimator, built on Spark ML.

A fitted model's ``transform`` adds ``prediction`` (a label) and ``positive_probability``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetika.session import materialize

# Names, labels and published settings.
CLASSIFIER_NAMES = ("random_forest", "c50_substitute", "svm_rbf", "logistic_regression")
CLASSIFIER_LABELS = {"random_forest": "Random Forest", "c50_substitute": "C5.0 substitute (AdaBoost)", "svm_rbf": "SVM (RBF)", "logistic_regression": "Logistic Regression"}
PAPER1_PARAMS = {"random_forest": {"n_estimators": 500, "max_features": 4}, "c50_substitute": {"n_estimators": 20}, "svm_rbf": {"C": 0.25}, "logistic_regression": {}}
PAPER1_PARAM_GRIDS = {"random_forest": {"max_features": [1, 2, 4, 6, 8]}, "c50_substitute": {"n_estimators": [1, 10, 20, 30, 40]}, "svm_rbf": {"C": [0.25, 0.5, 1.0, 2.0, 4.0]}, "logistic_regression": {}}
DEFAULTS = {"random_forest": {"n_estimators": 500, "max_features": "sqrt", "max_depth": 30}, "c50_substitute": {"n_estimators": 20, "max_depth": 1}, "svm_rbf": {"C": 1.0, "n_features": 300, "max_iter": 100}, "logistic_regression": {"max_iter": 1000}}


#: Up to so many rows the radial kernel is worked out exactly; beyond, by random Fourier features.
MOST_KERNEL_ROWS = 2_000


class Waves:
    """Random Fourier features of ``_x`` as ``_z``."""

    def __init__(self, turn: np.ndarray, shift: np.ndarray) -> None:
        self.turn, self.shift = turn, shift

    def transform(self, df: DataFrame) -> DataFrame:
        turn, shift = self.turn, self.shift

        @F.pandas_udf("array<double>")
        def waves(x: pd.Series) -> pd.Series:
            return pd.Series(list(math.sqrt(2 / len(shift)) * np.cos(np.stack(x.to_numpy()) @ turn + shift)))

        return df.withColumn("_z", array_to_vector(waves(vector_to_array("_x"))))


class KernelMachine:
    """The decision value ``_margin`` of a machine with a radial kernel, from its support vectors."""

    def __init__(self, support: np.ndarray, weight: np.ndarray, bias: float, gamma: float) -> None:
        self.support, self.weight, self.bias, self.gamma = support, weight, bias, gamma

    @staticmethod
    def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
        return np.exp(-gamma * np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, c: float, gamma: float, tol: float = 1e-3, most: int = 100_000) -> KernelMachine:
        """Sequential minimal optimisation on the pair that breaks the optimality conditions most; ``y`` is 1 or -1."""
        k, alpha, slope = cls.kernel(x, x, gamma), np.zeros(len(y)), -np.ones(len(y))
        for _ in range(most):
            up, down = np.where(y > 0, alpha < c, alpha > 0), np.where(y > 0, alpha > 0, alpha < c)
            pull = -y * slope
            i, j = int(np.where(up, pull, -np.inf).argmax()), int(np.where(down, pull, np.inf).argmin())
            if pull[i] - pull[j] <= tol:
                break
            step = (pull[i] - pull[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
            step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
            alpha[i] += y[i] * step
            alpha[j] -= y[j] * step
            slope += y * step * (k[i] - k[j])
        bias, held = (pull[i] + pull[j]) / 2, alpha > 1e-12
        return cls(x[held], (alpha * y)[held], float(bias), gamma)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.support, self.gamma) @ self.weight + self.bias if len(self.support) else np.full(len(x), self.bias)

    def transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(self.margin(np.stack(x.to_numpy())))

        return df.withColumn("_margin", margin(vector_to_array("_x")))


class Margin:
    """The decision value of a linear machine as ``_margin``."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_margin", vector_to_array("_m")[1])


class FittedClassifier:
    """Standardised features, a probability of the positive class, and the labels.

    ``votes`` are the trees of a boosted model with their weights; without them the probability is that of the last stage.
    """

    def __init__(self, prepare, stages: list, features: list[str], labels: tuple, votes: list[tuple[int, float]] | None = None) -> None:
        self.prepare, self.stages, self.features, self.labels, self.votes = prepare, stages, features, labels, votes

    def probability(self) -> Column:
        if self.votes is None:
            return vector_to_array("_q")[1]
        total = sum(w for _, w in self.votes) or 1.0
        lean = sum((2 * F.col(f"_t{i}") - 1) * w for i, w in self.votes) / total if self.votes else F.lit(0.0)
        return 1 / (1 + F.exp(-2 * lean))

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.prepare.transform(df)
        for stage in self.stages:
            out = stage.transform(out)
        negative, positive = self.labels
        made = out.withColumn("positive_probability", self.probability()).withColumn("prediction", F.when(F.col("positive_probability") >= 0.5, F.lit(positive)).otherwise(F.lit(negative)))
        return made.select(*[c for c in df.columns if c not in ("prediction", "positive_probability")], "prediction", "positive_probability")


class Classifier:
    """An unfitted classifier; ``fit`` returns a ``FittedClassifier``."""

    def __init__(self, name: str, params: dict, random_state: int | None = None) -> None:
        self.name, self.params, self.random_state = name, params, random_state or 0

    def fit(self, df: DataFrame, features: list[str], label_col: str, positive_label=None) -> FittedClassifier:
        labels = sorted((r[0] for r in df.select(label_col).distinct().collect() if r[0] is not None), key=str)
        if len(labels) != 2:
            raise ValueError(f"two labels are needed, not {labels}")
        if positive_label is not None:
            if positive_label not in labels:
                raise ValueError(f"no row has the label {positive_label!r}")
            labels = [x for x in labels if x != positive_label] + [positive_label]
        scaled = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)])
        prepare = scaled.fit(df)
        ready = prepare.transform(df.filter(F.col(label_col).isNotNull())).select("_x", (F.col(label_col) == F.lit(labels[1])).cast("double").alias("_y")).cache()
        try:
            stages, votes = getattr(self, f"_fit_{self.name}")(ready, len(features))
        finally:
            ready.unpersist()
        return FittedClassifier(prepare, stages, features, tuple(labels), votes)

    def _fit_random_forest(self, ready: DataFrame, width: int):
        mtry = self.params["max_features"]
        forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=self.params["n_estimators"], featureSubsetStrategy=mtry if isinstance(mtry, str) else str(min(mtry, width)), maxDepth=min(30, self.params["max_depth"]), minInstancesPerNode=1, seed=self.random_state, predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q")
        return [forest.fit(ready)], None

    def _fit_logistic_regression(self, ready: DataFrame, width: int):
        model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0, maxIter=self.params["max_iter"], standardization=False, predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q")
        return [model.fit(ready)], None

    def _fit_c50_substitute(self, ready: DataFrame, width: int):
        """AdaBoost of small trees, discrete SAMME; each round reweighs the rows by a column expression."""
        stages, votes = [], []
        work = ready.withColumn("_w", F.lit(1.0))
        for i in range(self.params["n_estimators"]):
            tree = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=self.params["max_depth"], predictionCol=f"_t{i}", rawPredictionCol=f"_rt{i}", probabilityCol=f"_qt{i}", seed=self.random_state + i).fit(work)
            made = tree.transform(work).withColumn("_miss", F.col(f"_t{i}") != F.col("_y"))
            row = made.agg(F.sum(F.when(F.col("_miss"), F.col("_w")).otherwise(0.0)).alias("bad"), F.sum("_w").alias("all")).first()
            error = (row.bad or 0.0) / row.all
            if error >= 0.5:
                break
            weight = math.log((1 - error) / error) if error > 1e-10 else 10.0
            stages.append(tree)
            votes.append((i, weight))
            if error <= 1e-10:
                break
            work = made.select("_x", "_y", (F.col("_w") * F.when(F.col("_miss"), F.lit(math.exp(weight))).otherwise(F.lit(1.0)) / row.all).alias("_w"))
            if i % 5 == 4:
                work = materialize(work, "boosting")  # keeps the plan short
        return stages, votes

    def _fit_svm_rbf(self, ready: DataFrame, width: int):
        """A machine with a radial kernel and Platt's probabilities: exact for ``MOST_KERNEL_ROWS`` rows, by random Fourier features beyond."""
        spread = float(ready.select(F.avg(F.aggregate(vector_to_array("_x"), F.lit(0.0), lambda a, v: a + v * v))).first()[0]) / width
        n, gamma = ready.count(), 1 / (width * max(spread, 1e-12))
        if n <= MOST_KERNEL_ROWS:
            rows = sorted(([float(v) for v in r.x], r["_y"]) for r in ready.select(vector_to_array("_x").alias("x"), "_y").collect())  # MOST_KERNEL_ROWS at most
            stages = [KernelMachine.fit(np.array([x for x, _ in rows]), np.array([2 * y - 1 for _, y in rows]), float(self.params["C"]), gamma)]
            made = stages[0].transform(ready)
        else:
            rng, count = np.random.default_rng(self.random_state), self.params["n_features"]
            waves = Waves(rng.normal(0, math.sqrt(2 * gamma), (width, count)), rng.uniform(0, 2 * math.pi, count))
            wide = waves.transform(ready).cache()
            machine = LinearSVC(featuresCol="_z", labelCol="_y", regParam=1 / (self.params["C"] * n), maxIter=self.params["max_iter"], standardization=False, predictionCol="_p", rawPredictionCol="_m").fit(wide)
            stages = [waves, machine, Margin()]
            made = Margin().transform(machine.transform(wide))
        assembler = VectorAssembler(inputCols=["_margin"], outputCol="_f")
        platt = LogisticRegression(featuresCol="_f", labelCol="_y", predictionCol="_pp", rawPredictionCol="_pr", probabilityCol="_q").fit(assembler.transform(made))
        if n > MOST_KERNEL_ROWS:
            wide.unpersist()
        return [*stages, assembler, platt], None


def make_classifier(name: str, preset: str | None = "paper1", random_state: int | None = None, **overrides) -> Classifier:
    if name not in CLASSIFIER_NAMES:
        raise ValueError(f"unknown classifier {name!r}; one of {CLASSIFIER_NAMES}")
    if preset not in (None, "paper1"):
        raise ValueError(f"unknown preset {preset!r}")
    if extra := set(overrides) - set(DEFAULTS[name]):
        raise ValueError(f"{name} has no parameters {sorted(extra)}")
    return Classifier(name, DEFAULTS[name] | (PAPER1_PARAMS[name] if preset else {}) | overrides, random_state)


def make_classifiers(names: list[str] | None = None, preset: str | None = "paper1", random_state: int | None = None) -> dict[str, Classifier]:
    return {n: make_classifier(n, preset, random_state) for n in names or CLASSIFIER_NAMES}


def fit_classifiers(models: dict[str, Classifier], df: DataFrame, features: list[str], label_col: str, positive_label=None) -> dict[str, FittedClassifier]:
    return {n: m.fit(df, features, label_col, positive_label) for n, m in models.items()}
