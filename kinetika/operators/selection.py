"""All-relevant feature selection: Boruta runs, their stability, and clusters of correlated features.

The table has one row per entity, so a run holds it whole; runs are dealt one to a task. ``MOST_VALUES`` bounds what is broadcast.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetika.functions import forest, stats
from kinetika.functions.columns import numeric

MOST_VALUES = 20_000_000
TENTATIVE, CONFIRMED, REJECTED = "Tentative", "Confirmed", "Rejected"


def oob_permutation_importance(x, y, n_estimators: int = 500, max_features: str | int = "sqrt", random_state: int = 0, max_samples: int | float | None = None) -> np.ndarray:
    return forest.importance(x, y, n_estimators, None if max_features == "sqrt" else int(max_features), random_state, "permutation", max_samples)


def gini_importance(x, y, n_estimators: int = 500, max_features: str | int = "sqrt", random_state: int = 0, max_samples: int | float | None = None) -> np.ndarray:
    return forest.importance(x, y, n_estimators, None if max_features == "sqrt" else int(max_features), random_state, "gini", max_samples)


#: Importances are held against so many shadows at least.
LEAST_SHADOWS = 5


@dataclass
class BorutaRun:
    """What one run decided for each of ``names``, and how.

    ``history`` has a row per iteration with the importance of every feature, -inf once it is rejected; ``shadows`` has the least, the
    mean and the greatest importance of that iteration's shadows; ``hits`` counts how often a feature beat them all.
    """

    names: list[str]
    decisions: list[str]
    rough_decisions: list[str]
    history: np.ndarray
    shadows: np.ndarray
    hits: np.ndarray

    def confirmed(self, rough_fixed: bool = True) -> list[str]:
        """The confirmed features; ``rough_fixed``: those that only the rough fix confirms as well."""
        final = dict(zip(self.names, self.rough_decisions if rough_fixed else self.decisions, strict=True))
        return [name for name in self.names if final[name] == CONFIRMED]

    @property
    def shadow_max(self) -> np.ndarray:
        """The greatest shadow of every iteration."""
        return self.shadows[:, -1]

    def rows(self, run: int) -> list[tuple]:
        """One row per feature: run, feature, decision, rough_decision, share of hits and its finite importances."""
        share = self.hits / max(len(self.history), 1)
        return [(run, n, self.decisions[i], self.rough_decisions[i], float(share[i]), [float(v) for v in self.history[:, i] if np.isfinite(v)]) for i, n in enumerate(self.names)]


RUN_ROWS = "run int, feature string, decision string, rough_decision string, hit_share double, importances array<double>"


def make_shadows(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The columns in a random order of rows, each in another; narrow tables are repeated, doubling until there are ``LEAST_SHADOWS``."""
    times = 1
    while times * x.shape[1] < LEAST_SHADOWS:
        times *= 2
    return rng.permuted(np.tile(x, (1, times)), axis=0)


def do_tests(decisions: np.ndarray, hits: np.ndarray, n_iter: int, alpha: float) -> np.ndarray:
    """Confirm or reject tentative features by a binomial test of their hits, with Bonferroni's correction over all features."""
    out = decisions.copy()
    limit = alpha / len(decisions)
    for i in np.flatnonzero(decisions == TENTATIVE):
        if stats.binomial_sf(int(hits[i]) - 1, n_iter, 0.5) < limit:
            out[i] = CONFIRMED
        elif stats.binomial_cdf(int(hits[i]), n_iter, 0.5) < limit:
            out[i] = REJECTED
    return out


def tentative_rough_fix(decisions: np.ndarray, history: np.ndarray, shadow_max: np.ndarray) -> np.ndarray:
    """Confirm a tentative feature if its median importance beats the median of the greatest shadow; else reject it."""
    out = decisions.copy()
    for i in np.flatnonzero(decisions == TENTATIVE):
        out[i] = CONFIRMED if len(history) and np.median(history[:, i]) > np.median(shadow_max) else REJECTED
    return out


def boruta_run(x: np.ndarray, y: np.ndarray, names: list[str], importance_fn: Callable, alpha: float = 0.01, max_iter: int = 100, seed: int = 0) -> BorutaRun:
    """While a feature is tentative, at most ``max_iter - 1`` times: hold all that aren't rejected against permuted shadows."""
    rng = np.random.default_rng(seed)
    decisions, hits = np.full(len(names), TENTATIVE, object), np.zeros(len(names), int)
    history, shadows, done = [], [], 0
    while (decisions == TENTATIVE).any() and done + 1 < max_iter:
        active = np.flatnonzero(decisions != REJECTED)
        found = np.asarray(importance_fn(np.hstack([x[:, active], make_shadows(x[:, active], rng)]), y, int(rng.integers(1 << 31))), float)
        own, shade = found[: len(active)], found[len(active) :]
        row = np.full(len(names), -np.inf)
        row[active] = own
        hits[active] += own > shade.max()
        history.append(row)
        shadows.append((shade.min(), shade.mean(), shade.max()))
        done += 1
        decisions = do_tests(decisions, hits, done, alpha)
    history, shadows = np.array(history).reshape(done, len(names)), np.array(shadows).reshape(done, 3)
    return BorutaRun(list(names), list(decisions), list(tentative_rough_fix(decisions, history, shadows[:, 2])), history, shadows, hits)


def abs_correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Absolute Pearson correlations, 0 where undefined, 1 on the diagonal; one distributed pass."""
    rows = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df.select(*[F.col(c).cast("double") for c in columns])).select("_v")
    r = np.nan_to_num(np.abs(Correlation.corr(rows, "_v").first()[0].toArray()))
    np.fill_diagonal(r, 1.0)
    return r


def correlated_feature_clusters(df: DataFrame, feature_columns: list[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """feature, cluster, cluster_size, max_abs_corr: average linkage on 1 - |r|, cut at 1 - ``threshold``; large clusters first."""
    columns, schema = feature_columns or numeric(df), "feature string, cluster int, cluster_size int, max_abs_corr double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([(c, 1, 1, None) for c in columns], schema)
    r = abs_correlations(df, columns)
    number = stats.cut(stats.average_linkage(1 - r), len(columns), 1 - threshold)
    rows = []
    for i, c in enumerate(columns):
        mates = [j for j in np.flatnonzero(number == number[i]) if j != i]
        rows.append((c, int(number[i]), len(mates) + 1, float(r[i, mates].max()) if mates else None))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda v: (-v[2], v[1], v[0])), schema)


class BorutaSelector:
    """Repeated seeded Boruta runs; a feature is selected if its share of confirming runs reaches ``selection_threshold``.

    ``importance``: ``"permutation"``, ``"gini"`` or a function of (x, y, random_state). After ``fit``: ``runs_``, ``stability_`` (a
    DataFrame), ``selection_frequency_``, ``selected_columns_``, ``support_`` and ``support_weak_``.
    """

    def __init__(self, feature_columns: list[str] | None = None, n_repeats: int = 20, selection_threshold: float = 0.5, importance: str | Callable = "permutation", n_estimators: int = 500, alpha: float = 0.01, max_iter: int = 100, correlation_threshold: float | None = 0.8, random_state: int = 0) -> None:
        if n_repeats < 1:
            raise ValueError("n_repeats must be 1 at least")
        if not callable(importance) and importance not in ("permutation", "gini"):
            raise ValueError(f"importance must be 'permutation', 'gini' or a function, not {importance!r}")
        self.feature_columns, self.n_repeats, self.selection_threshold, self.importance, self.n_estimators = feature_columns, n_repeats, selection_threshold, importance, n_estimators
        self.alpha, self.max_iter, self.correlation_threshold, self.random_state = alpha, max_iter, correlation_threshold, random_state

    def clone(self) -> BorutaSelector:
        return BorutaSelector(self.feature_columns, self.n_repeats, self.selection_threshold, self.importance, self.n_estimators, self.alpha, self.max_iter, self.correlation_threshold, self.random_state)

    def fit(self, df: DataFrame, label_col: str) -> BorutaSelector:
        spark = df.sparkSession
        names = self.feature_columns_ = self.feature_columns or [c for c in numeric(df) if c != label_col]
        if (n := df.count()) * len(names) > MOST_VALUES:
            raise ValueError(f"{n} x {len(names)} values are more than a run takes into its task ({MOST_VALUES})")
        rows = df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("x"), F.col(label_col).cast("string").alias("y")).collect()
        if any(v is None or v != v for r in rows for v in r.x):
            raise ValueError("features must not have missing values; clean them first")
        shared = spark.sparkContext.broadcast((np.array([r.x for r in rows], float), np.array([r.y for r in rows])))
        importance, trees, alpha, max_iter = self.importance, self.n_estimators, self.alpha, self.max_iter

        def rate(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
            return importance(x, y, seed) if callable(importance) else forest.importance(x, y, trees, None, seed, importance)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for number, seed in frame[["run", "seed"]].itertuples(index=False):
                    made = boruta_run(*shared.value, names, rate, alpha, max_iter, int(seed))
                    yield pd.DataFrame({"run": [number], "decisions": [made.decisions], "rough": [made.rough_decisions], "history": [made.history.ravel().tolist()], "shadows": [made.shadows.ravel().tolist()], "hits": [made.hits.tolist()]})

        if self.n_repeats == 1:
            warnings.warn("one run says nothing of stability; all it confirms is selected", stacklevel=2)
        seeds = spark.createDataFrame([(i, self.random_state + i) for i in range(self.n_repeats)], "run int, seed int").repartition(self.n_repeats)
        found = seeds.mapInPandas(run, "run int, decisions array<string>, rough array<string>, history array<double>, shadows array<double>, hits array<int>")
        self.runs_ = [BorutaRun(names, list(r.decisions), list(r.rough), np.array(r.history).reshape(-1, len(names)), np.array(r.shadows).reshape(-1, 3), np.array(r.hits)) for r in sorted(found.collect(), key=lambda r: r.run)]
        self.clusters_ = correlated_feature_clusters(df, names, self.correlation_threshold) if self.correlation_threshold is not None else None
        self._summarise(spark)
        return self

    def _summarise(self, spark: SparkSession) -> None:
        rows = spark.createDataFrame([r for i, run in enumerate(self.runs_) for r in run.rows(i)], RUN_ROWS)
        table = {r.feature: r for r in stability_rollup(rows).collect()}  # a row per feature
        self.selection_frequency_ = {n: table[n].selection_freq for n in self.feature_columns_}
        limit = self.selection_threshold if self.n_repeats > 1 else 1.0
        self.selected_columns_ = [n for n, share in self.selection_frequency_.items() if share >= limit and share > 0]
        self.support_ = [n in self.selected_columns_ for n in self.feature_columns_]
        self.support_weak_ = [table[n].n_tentative > 0 and n not in self.selected_columns_ for n in self.feature_columns_]
        columns = ("selection_freq", "n_confirmed", "n_tentative", "n_rejected", "median_imp")
        stable = spark.createDataFrame([(n, *(table[n][c] for c in columns), n in self.selected_columns_) for n in self.feature_columns_], "feature string, selection_freq double, n_confirmed int, n_tentative int, n_rejected int, median_imp double, selected boolean")
        if self.clusters_ is not None:
            stable = stable.join(F.broadcast(self.clusters_), "feature", "left")
        self.stability_ = stable.orderBy(F.desc("selection_freq"), F.col("median_imp").desc_nulls_last(), "feature")

    def cluster_stability(self) -> DataFrame:
        """cluster, n_features, cluster_freq, best_feature, best_feature_freq, members: a cluster counts if any member is confirmed."""
        if self.clusters_ is None:
            raise ValueError("clustering is off: correlation_threshold is None")
        confirmed = [set(r.confirmed()) for r in self.runs_]
        rows = [(i, name, name in c) for i, c in enumerate(confirmed) for name in self.feature_columns_]
        runs = self.stability_.sparkSession.createDataFrame(rows, "run int, feature string, confirmed boolean")
        by_run = runs.join(F.broadcast(self.clusters_.select("feature", "cluster")), "feature").groupBy("cluster", "run").agg(F.bool_or("confirmed").alias("any"))
        share = by_run.groupBy("cluster").agg(F.avg(F.col("any").cast("double")).alias("cluster_freq"))
        best = self.stability_.groupBy("cluster").agg(F.count("*").cast("int").alias("n_features"), F.max_by("feature", F.struct("selection_freq", "median_imp")).alias("best_feature"), F.max("selection_freq").alias("best_feature_freq"), F.array_sort(F.collect_list("feature")).alias("members"))
        return best.join(share, "cluster").select("cluster", "n_features", "cluster_freq", "best_feature", "best_feature_freq", "members").orderBy(F.desc("cluster_freq"), "cluster")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[c for c in df.columns if c not in self.feature_columns_], *self.selected_columns_)

    def get_feature_names_out(self) -> list[str]:
        return list(self.selected_columns_)

    def history(self, spark: SparkSession) -> DataFrame:
        """run, iteration, feature, importance (null where rejected)."""
        rows = [(i, t, f, float(v) if np.isfinite(v) else None) for i, r in enumerate(self.runs_) for t, line in enumerate(r.history) for f, v in zip(r.names, line, strict=True)]
        return spark.createDataFrame(rows, "run int, iteration int, feature string, importance double")


def boruta_feature_stats(spark: SparkSession, selector: BorutaSelector, run: int = 0) -> DataFrame:
    """feature, meanImp, medianImp, minImp, maxImp, normHits, decision, roughFixedDecision; the most important first."""
    r = selector.runs_[run]
    rows = []
    for i, name in enumerate(r.names):
        v = r.history[:, i][np.isfinite(r.history[:, i])]
        rows.append((name, *((float(v.mean()), float(np.median(v)), float(v.min()), float(v.max())) if len(v) else (None,) * 4), float(r.hits[i] / max(len(r.history), 1)), r.decisions[i], r.rough_decisions[i]))
    return spark.createDataFrame(rows, "feature string, meanImp double, medianImp double, minImp double, maxImp double, normHits double, decision string, roughFixedDecision string").orderBy(F.col("medianImp").desc_nulls_last(), "feature")


def stability_rollup(runs: DataFrame) -> DataFrame:
    """feature, selection_freq, n_confirmed, n_tentative, n_rejected, median_imp and norm_hits from rows of ``RUN_ROWS``.

    ``selection_freq`` is the share of runs whose roughly fixed decision confirms; the counts are of decisions before that fix. Medians
    are taken within each run, then over runs. Two aggregations, so any number of runs and features can be summarised.
    """
    medians = runs.select("run", "feature", F.explode("importances").alias("v")).groupBy("run", "feature").agg(F.median("v").alias("_median"))
    known = runs.drop("importances").join(medians, ["run", "feature"], "left")
    counts = [F.count_if(F.col("decision") == d).cast("int").alias(f"n_{d.lower()}") for d in (CONFIRMED, TENTATIVE, REJECTED)]
    return known.groupBy("feature").agg(F.avg((F.col("rough_decision") == CONFIRMED).cast("double")).alias("selection_freq"), *counts, F.median("_median").alias("median_imp"), F.avg("hit_share").alias("norm_hits"))


def importance_top_k(df: DataFrame, label_col: str, feature_columns: list[str], k: int = 8, n_seeds: int = 20, n_estimators: int = 500, importance: str = "permutation", random_state: int = 0) -> DataFrame:
    """feature, n_top, top_freq, mean_imp: how often a forest of another seed puts a feature among its ``k`` most important.

    Held against ``BorutaSelector.stability_``, it shows what a single ranking hides. A seed is a task; the table is bounded as for Boruta.
    """
    if df.count() * len(feature_columns) > MOST_VALUES:
        raise ValueError(f"the table has more than {MOST_VALUES} values")
    rows = df.select(F.array(*[F.col(c).cast("double") for c in feature_columns]).alias("x"), F.col(label_col).cast("string").alias("y")).collect()
    shared = df.sparkSession.sparkContext.broadcast((np.array([r.x for r in rows], float), np.array([r.y for r in rows])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seed in frame["seed"]:
                found = forest.importance(*shared.value, n_estimators, None, int(seed), importance)
                yield pd.DataFrame({"seed": seed, "feature": feature_columns, "imp": found})

    seeds = df.sparkSession.createDataFrame([(random_state + i,) for i in range(n_seeds)], "seed int").repartition(n_seeds)
    ranked = seeds.mapInPandas(run, "seed int, feature string, imp double").withColumn("_rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("imp"), "feature")))
    return ranked.groupBy("feature").agg(F.count_if(F.col("_rank") <= k).alias("n_top"), F.avg((F.col("_rank") <= k).cast("double")).alias("top_freq"), F.avg("imp").alias("mean_imp")).orderBy(F.desc("top_freq"), F.desc("mean_imp"), "feature")
