"""Registered queries of the fitted half of the library, over the driver's tables, with DuckDB SQL for the same rows.

Where a model itself is beyond SQL, it is given inputs whose results have a closed form: a basis of rank one, a model that follows a rule, a
feature that is the label.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetika import persistence, sources
from kinetika.functions import columns as C
from kinetika.functions import forest, stats
from kinetika.functions.labels import AU_DESCRIPTIONS, humanise_au_labels
from kinetika.operators import classifiers, cleaning, evaluation, external, faces, features, nmf, normalisation, plots, representatives, reshape, selection, smoothing, splitting, tuning
from kinetika.queries import _BASIS, _DELONG, SIGNALS, SQL, _folds_sql, _matrix, _query, _r, _read, _rounded, _scored
from kinetika.session import new_folder


def _values(*rows: tuple, names: str) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return f"CAST({v} AS INTEGER)" if isinstance(v, int) else f"'{v}'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


# --- sources and columns ---------------------------------------------------------------------------------------------------


_NATION = "SELECT n_nationkey, n_name, n_regionkey, n_nationkey / 7.0 AS share FROM nation"


def _through(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_nationkey") / 7.0).alias("share"))
        path = new_folder(spark, f"nation-{kind}")
        sources.write_table(rows, path, kind)
        return _rounded(sources.read_table(spark, path, kind, rows.schema))

    run.__name__ = f"through_{kind}"
    return run


for _kind in ("csv", "json", "orc", "parquet"):
    _query(f"SELECT n_nationkey, n_name, n_regionkey, {_r('share', 'share')} FROM ({_NATION})")(_through(_kind))


@_query(_values(("p_partkey", True, True), ("p_name", False, True), ("p_brand", False, True), ("p_size", True, True), ("p_retailprice", True, True), names="column_name, is_numeric, starts_with_p"))
def chosen_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    numeric, named = C.numeric(part), C.by_pattern(part, None, "^p_")
    return spark.createDataFrame([(c, c in numeric, c in named) for c in part.columns], "column_name string, is_numeric boolean, starts_with_p boolean")


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 AND l_linenumber % 4 <> 1 THEN round(l_tax + 1e-10, 6) + 0.0 END AS x FROM lineitem")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinite values and NaN become null."""
    odd = F.when(F.col("l_linenumber") % 4 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") % 4 == 1, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    return _rounded(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.finite(odd).alias("x")))


@_query(
    "SELECT 'x' AS feature, count(*) FILTER (l_linenumber % 4 = 0) AS n_nan, "
    + _r("avg(CASE WHEN l_linenumber % 4 = 0 THEN 1.0 ELSE 0.0 END)", "pct_nan")
    + ", count(*) FILTER (l_linenumber % 4 = 1) AS n_inf, "
    + _r("avg(CASE WHEN l_linenumber % 4 = 1 THEN 1.0 ELSE 0.0 END)", "pct_inf")
    + ", "
    + _r("stddev_samp(CASE WHEN l_linenumber % 4 >= 2 THEN l_tax END)", "sd")
    + ", false AS is_constant, false AS all_nan FROM lineitem"
)
def diagnostics_of_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("l_linenumber") % 4 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") % 4 == 1, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    return _rounded(cleaning.feature_diagnostics(_read(spark, sf_dir, "lineitem").select(odd.alias("x"))))


@_query("SELECT l_orderkey, l_linenumber, " + _r("l_tax", "full_column") + " FROM lineitem")
def clean_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns go by name, by their share of gaps and by being constant."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("full_column"), F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("gaps"), F.col("l_discount").alias("named"), F.lit(2.5).alias("flat"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fitted = cleaning.FeatureCleaner(["full_column", "gaps", "named", "flat"], ["named"], 0.2, impute=False).fit(lines)
    return _rounded(fitted.transform(lines))


@_query(" UNION ALL ".join(f"SELECT {_r(f'CAST({i / 20!r} AS DOUBLE)', 'threshold')}" for i in range(21)))
def threshold_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spark.createDataFrame([(t,) for t in tuning.threshold_grid(20)], "threshold double"))


@_query(_values(*[(c, f"{c} - {t}") for c, t in AU_DESCRIPTIONS.items()], ("plain", "plain"), names="name, label"))
def label_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*AU_DESCRIPTIONS, "plain"]
    return spark.createDataFrame(list(zip(names, humanise_au_labels(names), strict=True)), "name string, label string")


# --- series -------------------------------------------------------------------------------------------------------------------


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return reshape.series_arrays(events, ["value"], [], "user_id", "event_id")


@_query("SELECT * FROM (" + SQL["features_distribution"] + ") JOIN (SELECT * EXCLUDE (length) FROM (" + SQL["features_activation"] + ")) USING (user_id)")
def features_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of series that are held as arrays, one row each."""
    made = features.extract_timeseries_features(_series(spark, sf_dir))
    return _rounded(made.select("user_id", *features.FEATURE_GROUPS["distribution"], *features.FEATURE_GROUPS["activation"], "length"))


_LINES = "SELECT l_orderkey, series, v FROM (SELECT l_orderkey, l_linenumber, 'l_quantity' AS series, max(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return reshape.reshape_to_wide(lines, ["l_quantity"], [], "l_orderkey", "l_linenumber")


@_query("SELECT l_orderkey, series, " + ", ".join((_r("sum(v)", "total"), _r("max(v) - min(v)", "span"), _r("sum(v * v)", "energy"))) + f" FROM ({_LINES}) GROUP BY l_orderkey, series")
def features_of_a_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    def own(x: np.ndarray) -> dict[str, float]:
        return {"total": np.nansum(x), "span": np.nanmax(x) - np.nanmin(x), "energy": np.nansum(x * x)}

    return _rounded(external.CallableFeatureExtractor(own, ["total", "span", "energy"]).transform(_wide(spark, sf_dir)))


@_query("SELECT l_orderkey, series, " + ", ".join((_r("avg(v)", "middle"), _r("min(v)", "least"))) + f" FROM ({_LINES}) GROUP BY l_orderkey, series")
def features_of_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(external.MatrixFeatureExtractor(lambda m: np.stack([np.nanmean(m, axis=1), np.nanmin(m, axis=1)], axis=1), ["middle", "least"]).transform(_wide(spark, sf_dir)))


@_query("SELECT event_id, " + _r("value", "raw") + ", " + _r("avg(value) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)", "smoothed") + " FROM events WHERE user_id = 1 QUALIFY lead(event_id) OVER (ORDER BY event_id) IS NOT NULL")
def smoothing_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a plot of one series, but for its last, which is filled forward."""
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    made = smoothing.RollingSmoother(2, "user_id", ["value"], order_col="event_id").transform(events)
    rows = plots.smoothing_comparison_data(made, 1, "value", "user_id", "event_id")
    last = rows.agg(F.max("event_id")).first()[0]
    return _rounded(rows.filter(F.col("event_id") != F.lit(-1 if last is None else last)))


# --- factorisation ---------------------------------------------------------------------------------------------------------


def _given(spark: SparkSession) -> nmf.NMFDecomposer:
    model = nmf.NMFDecomposer(1)
    model.columns_, model.components_ = [f"smth_{c}" for c in SIGNALS], np.array([_BASIS])
    return model


_GIVEN_SQL = (
    "WITH x AS (SELECT l_quantity * 0.02 AS x0, l_extendedprice * 1e-5 AS x1, l_discount * 10.0 AS x2, l_tax * 12.0 AS x3 FROM lineitem), w AS (SELECT *, greatest(0, ("
    + " + ".join(f"x{i} * {b}" for i, b in enumerate(_BASIS))
    + f") / {sum(b * b for b in _BASIS)!r}) AS w FROM x)"
)


@_query(_GIVEN_SQL + " SELECT au, " + _r("r2", "r2") + " FROM (" + " UNION ALL ".join(f"SELECT 'smth_{c}' AS au, 1 - sum(pow(x{i} - w * {_BASIS[i]}, 2)) / (var_pop(x{i}) * count(*)) AS r2 FROM w" for i, c in enumerate(SIGNALS)) + ")")
def reconstruction_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nmf.nmf_reconstruction_r2_per_au(_given(spark), _matrix(spark, sf_dir)))


@_query(_values(("nmf1", f"smth_{SIGNALS[2]}"), names="component, au"))
def representative_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representatives.select_representative_aus(spark, _given(spark))


@_query("SELECT l_orderkey, l_linenumber, " + _r("l_discount * 10.0", f"smth_{SIGNALS[2]}") + " FROM lineitem")
def representative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matrix(spark, sf_dir)
    return _rounded(representatives.RepresentativeAUSelector(_given(spark)).fit_transform(rows))


_SCALED = [(b - min(_BASIS)) / (max(_BASIS) - min(_BASIS)) for b in _BASIS]


@_query(" UNION ALL ".join(f"SELECT 'nmf1' AS component, 'smth_{c}' AS au, 'smth_{c}' AS label, {_r(f'CAST({w!r} AS DOUBLE)', 'weight')}" for c, w in zip(SIGNALS, _SCALED, strict=True)))
def basis_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(plots.nmf_basis_data(spark, _given(spark)))


_SWEEP_SQL = "SELECT CAST(n_regionkey + 2 AS INTEGER) AS rank, CAST(count(*) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS rep, n_regionkey * n_regionkey * n_regionkey * 3 + n_nationkey / 10.0 AS test_mse FROM nation"


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for replicates of a sweep over ranks."""
    region = F.col("n_regionkey")
    return _read(spark, sf_dir, "nation").select((region + 2).cast("int").alias("rank"), F.lit(0).alias("rep"), F.lit(0).alias("seed"), F.lit(0.0).alias("train_mse"), (region * region * region * 3 + F.col("n_nationkey") / 10.0).alias("test_mse"))


@_query(
    f"WITH s AS ({_SWEEP_SQL}), r AS (SELECT rank, median(test_mse) AS median_mse, avg(test_mse) AS mean_mse, min(test_mse) AS min_mse, max(test_mse) AS max_mse FROM s GROUP BY rank), m AS (SELECT median(median_mse) AS m FROM r), d AS (SELECT 1.4826 * median(abs(median_mse - m)) AS s FROM r, m) SELECT rank, "
    + ", ".join(_r(c, c) for c in ("median_mse", "mean_mse", "min_mse", "max_mse"))
    + ", median_mse > m + 5 * s AS is_outlier FROM r, m, d"
)
def rank_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(plots.nmf_rank_cv_data(_sweep(spark, sf_dir)))


@_query(f"WITH s AS ({_SWEEP_SQL}) SELECT rank, {_r('median(test_mse)', 'median_mse')}, {_r('avg(test_mse)', 'mean_mse')} FROM s GROUP BY rank ORDER BY median(test_mse), rank LIMIT 1")
def best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nmf.best_rank(_sweep(spark, sf_dir)))


_AFFINE = [[0.5, -1.0, 0.25], [2.0, 0.125, -0.75]]


@_query("SELECT l_orderkey, l_linenumber, " + ", ".join(_r(f"(l_discount - 0.05) * {_AFFINE[0][k]} + (coalesce(l_tax, 0.02) - 0.02) * {_AFFINE[1][k]} + {k + 1}", n) for k, n in enumerate(("x1", "x2", "y1"))) + " FROM lineitem")
def face_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks of a given affine model of two action units."""
    coef, intercept = np.zeros((2, 136)), np.zeros(136)
    for k, place in enumerate((0, 1, 68)):
        coef[:, place], intercept[place] = [_AFFINE[0][k], _AFFINE[1][k]], k + 1
    made = faces.FaceModel(coef, intercept, np.array([0.05, 0.02])).landmarks(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"])
    return _rounded(made.select("l_orderkey", "l_linenumber", F.get("landmark_x", F.lit(0)).alias("x1"), F.get("landmark_x", F.lit(1)).alias("x2"), F.get("landmark_y", F.lit(0)).alias("y1")))


@_query(SQL["normalise"])
def normalise_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A normaliser that was saved and loaded again."""
    lines, folder = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SIGNALS), new_folder(spark, "normaliser")
    persistence.save(normalisation.ZScoreShiftNormalizer(SIGNALS).fit(lines), folder, spark)
    return _rounded(persistence.load(folder, spark).transform(lines))


# --- selection -----------------------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return _read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", F.col("quality").cast("double").alias("signal"), (F.col("quality") * -3.0).alias("mirrored"), F.lit(1.0).alias("flat"), "n_chars")


@_query(_values(("signal", 1.0, 3, 0, 0, True, 1, 2), ("mirrored", 1.0, 3, 0, 0, True, 1, 2), ("flat", 0.0, 0, 0, 3, False, 2, 1), names="feature, selection_freq, n_confirmed, n_tentative, n_rejected, selected, cluster, cluster_size"))
def boruta_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boruta with the default importance, given the label, its mirror image and a constant: all runs must agree."""
    fitted = selection.BorutaSelector(["signal", "mirrored", "flat"], n_repeats=3, n_estimators=60, max_iter=40, random_state=2).fit(_labelled(spark, sf_dir), "quality")
    return fitted.stability_.select("feature", "selection_freq", "n_confirmed", "n_tentative", "n_rejected", "selected", "cluster", "cluster_size")


@_query(_values((1, 2, 1.0, 1.0, "mirrored,signal"), (2, 1, 0.0, 0.0, "flat"), names="cluster, n_features, cluster_freq, best_feature_freq, members"))
def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    def label_alone(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
        truth = (y == "1").astype(float)
        return np.array([abs(np.corrcoef(c, truth)[0, 1]) if c.std() > 0 else 0.0 for c in x.T])

    fitted = selection.BorutaSelector(["signal", "mirrored", "flat"], n_repeats=2, importance=label_alone, max_iter=30).fit(_labelled(spark, sf_dir), "quality")
    return fitted.cluster_stability().select("cluster", "n_features", "cluster_freq", "best_feature_freq", F.array_join("members", ",").alias("members"))


@_query(_values(("signal", 1.0), ("flat", 0.0), names="feature, importance"))
def gini_of_a_certain_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select("signal", "flat", "quality").collect()  # a row per label
    found = forest.importance(np.array([[r.signal, r.flat] for r in rows]), np.array([r.quality for r in rows]), 20, 2, 1, "gini")
    return spark.createDataFrame([("signal", float(found[0])), ("flat", float(found[1]))], "feature string, importance double")


@_query("SELECT feature, " + ", ".join((_r("n_top", "n_top"), _r("top_freq", "top_freq"))) + " FROM (" + _values(("signal", 4.0, 1.0), ("flat", 0.0, 0.0), names="feature, n_top, top_freq") + ")")
def importance_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = selection.importance_top_k(_labelled(spark, sf_dir), "quality", ["signal", "flat"], 1, 4, 15)
    return _rounded(made.select("feature", F.col("n_top").cast("double").alias("n_top"), "top_freq"))


# --- evaluation ----------------------------------------------------------------------------------------------------------------


class Rule:
    """A model that says ``fake`` where its first feature is over a limit, with that feature scaled as its probability."""

    def __init__(self, limit: float, top: float) -> None:
        self.limit, self.top = limit, top

    def fit(self, df: DataFrame, features: list[str], label_col: str, positive_label=None) -> Rule:
        fitted = Rule(self.limit, self.top)
        fitted.features = features
        return fitted

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.features[0])
        return df.withColumn("prediction", F.when(x > self.limit, "fake").otherwise("real")).withColumn("positive_probability", x / self.top)


_RULE_SQL = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'fake' ELSE 'real' END AS y, CASE WHEN l_discount > 0.05 THEN 'fake' ELSE 'real' END AS p, l_discount, l_tax, l_suppkey FROM lineitem"


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_tax", F.when(F.col("l_quantity") > 25, "fake").otherwise("real").alias("y"))


@_query(
    _folds_sql("lineitem", "l_suppkey", {"n0": "l_quantity > 25", "n1": "l_quantity <= 25"}, 3, [4, 1004])
    + f" SELECT repeat, fold, {_r('avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM f JOIN ({_RULE_SQL}) USING (l_suppkey) GROUP BY repeat, fold"
)
def cross_validated_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation by groups of a model that follows a rule."""
    found = evaluation.cross_validate_grouped(Rule(0.05, 0.1), _ruled(spark, sf_dir), ["l_discount"], "y", "l_suppkey", "accuracy", 3, 2, 4, "fake")
    return _rounded(found)


@_query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS model, count(*) AS n, {_r('avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END)', 'accuracy')}, {_r(tp, 'sensitivity')}, {_r(tn, 'specificity')} FROM (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y, CASE WHEN {c} > {limit} THEN 1 ELSE 0 END AS p FROM lineitem)"
        for name, c, limit in (("discount", "l_discount", 0.05), ("tax", "l_tax", 0.04))
        for tp, tn in (("avg(CASE WHEN y = 1 THEN CAST(p AS DOUBLE) END)", "avg(CASE WHEN y = 0 THEN 1.0 - p END)"),)
    )
)
def evaluated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ruled(spark, sf_dir)
    models = {"discount": Rule(0.05, 0.1).fit(rows, ["l_discount"], "y"), "tax": Rule(0.04, 0.08).fit(rows, ["l_tax"], "y")}
    return _rounded(evaluation.evaluate_models(models, rows, "y", "fake").select("model", "n", "accuracy", "sensitivity", "specificity"))


@_query(
    " UNION ALL ".join(
        f"SELECT {_r(f'CAST({t} AS DOUBLE)', 'threshold')}, CAST({n} AS INTEGER) AS n_features, '{chosen}' AS features, " + (_r(f"avg(CASE WHEN (l_quantity > 25) = ({c} > 0.04) THEN 1.0 ELSE 0.0 END)", "score") + " FROM lineitem" if c else "CAST(NULL AS DOUBLE) AS score")
        for t, n, chosen, c in ((0.0, 2, "l_discount,l_tax", "l_discount"), (0.5, 1, "l_tax", "l_tax"), (1.0, 0, "", None))
    )
)
def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep of selection thresholds over given frequencies, scored by the accuracy of a rule."""
    selector = selection.BorutaSelector(["l_discount", "l_tax"])
    selector.feature_columns_, selector.selection_frequency_ = ["l_discount", "l_tax"], {"l_discount": 0.3, "l_tax": 0.8}
    rows = _ruled(spark, sf_dir)
    made = tuning.threshold_sweep(selector, rows, rows, "y", Rule(0.04, 0.1), "accuracy", "fake", [0.0, 0.5, 1.0])
    return _rounded(spark.createDataFrame([(r["threshold"], r["n_features"], ",".join(r["features"]), None if math.isnan(r["score"]) else r["score"]) for r in made], "threshold double, n_features int, features string, score double"))


#: The upper tail of the normal distribution on both sides, by the midpoint rule.
_TWO_SIDED = "(SELECT sum(exp(-pow(abs(z) / sqrt(2) + (k + 0.5) / 2000, 2))) / 2000 * 2 / sqrt(pi()) FROM range(0, 24000) t(k))"


@_query(
    _DELONG
    + ", u AS (SELECT auc_a, auc_b, (SELECT (var_samp(vb) FILTER (pos)) / max(p) + (var_samp(vb) FILTER (NOT pos)) / max(n) FROM v, t) AS var_b, var_a FROM s), z AS (SELECT auc_a, auc_b, (auc_a - auc_b) / sqrt(var_a + var_b) AS z FROM u) SELECT "
    + ", ".join((_r("auc_a", "auc_a"), _r("auc_b", "auc_b"), _r("auc_a - auc_b", "difference"), _r("z", "z"), _r(_TWO_SIDED, "p_value")))
    + ", false AS paired FROM z"
)
def delong_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    made = evaluation.delong_roc_test(rows, "quality", "a", "b", other=rows)
    return _rounded(spark.createDataFrame([(made["auc_a"], made["auc_b"], made["difference"], made["z"], made["p_value"], made["paired"])], "auc_a double, auc_b double, difference double, z double, p_value double, paired boolean"))


@_query(_DELONG + ", z AS (SELECT (auc_a - auc_b) / sqrt(var_d) AS z FROM s) SELECT " + _r(_TWO_SIDED, "p_value") + " FROM z")
def delong_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluation.delong_roc_test(_scored(spark, sf_dir), "quality", "a", "b")
    return _rounded(spark.createDataFrame([(made["p_value"],)], "p_value double"))


def _bound(goal: float, above: bool) -> str:
    """Bisection for the proportion at which the chance of ``k`` successes or more (or of ``k`` or fewer) is ``goal``."""
    terms = "i >= k" if above else "i <= k"
    chance = f"(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))) FROM range(0, n + 1) t(i) WHERE {terms})"
    rising = ">=" if above else "<="
    return f"(WITH RECURSIVE b(step, lo, hi, k, n) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), k, n FROM c UNION ALL SELECT step + 1, CASE WHEN {chance} {rising} {goal} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {chance} {rising} {goal} THEN (lo + hi) / 2 ELSE hi END, k, n FROM b WHERE step < 40) SELECT (lo + hi) / 2 FROM b WHERE step = 40)"


@_query(
    "WITH c AS (SELECT count(*) FILTER (quality = 1 - toxic) AS k, count(*) AS n, greatest(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) / CAST(count(*) AS DOUBLE) AS nir, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS fp FROM labels), x AS (SELECT *, sqrt(pow(greatest(abs(fp - fn) - 1, 0), 2) / CAST(fp + fn AS DOUBLE)) AS z FROM c) SELECT "
    + ", ".join(
        (
            _r(_bound(0.025, True), "accuracy_ci_lower"), _r(_bound(0.025, False), "accuracy_ci_upper"),
            _r("(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(nir) + (n - i) * ln(1 - nir))) FROM range(0, n + 1) t(i) WHERE i >= k)", "p_acc_gt_nir"), _r(_TWO_SIDED, "mcnemar_p"),
        )
    )
    + " FROM x"
)
def exact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact interval of accuracy, the binomial test against the larger class, and McNemar's test."""
    labels = _read(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).cast("int").alias("guess"))
    return _rounded(evaluation.classification_metrics(labels, "quality", "guess").select("accuracy_ci_lower", "accuracy_ci_upper", "p_acc_gt_nir", "mcnemar_p"))


@_query("SELECT CAST(k AS INTEGER) AS k, " + ", ".join((_r("(SELECT sum(exp(lgamma(41) - lgamma(i + 1) - lgamma(41 - i)) * pow(0.3, i) * pow(0.7, 40 - i)) FROM range(0, 41) t(i) WHERE i > k)", "above"), _r("(SELECT sum(exp(lgamma(41) - lgamma(i + 1) - lgamma(41 - i)) * pow(0.3, i) * pow(0.7, 40 - i)) FROM range(0, 41) t(i) WHERE i <= k)", "up_to"))) + " FROM range(0, 40) r(k)")
def binomial_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spark.createDataFrame([(k, stats.binomial_sf(k, 40, 0.3), stats.binomial_cdf(k, 40, 0.3)) for k in range(40)], "k int, above double, up_to double"))


@_query(_values(("l_discount", 0.0), ("l_tax", 0.0), ("l_extendedprice", 0.0), names="feature, slope"))
def logistic_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression without a penalty: at its optimum the residuals are orthogonal to every feature."""
    names = ["l_discount", "l_tax", "l_extendedprice"]
    rows = _read(spark, sf_dir, "lineitem").select(*names, F.when(F.col("l_quantity") > 25, "fake").otherwise("real").alias("y"))
    made = classifiers.make_classifier("logistic_regression").fit(rows, names, "y", "fake").transform(rows)
    residual = (F.col("y") == "fake").cast("double") - F.col("positive_probability")
    slopes = made.agg(*[F.round(F.covar_pop(residual, F.col(c)) / F.stddev_pop(c), 3).alias(c) for c in names]).first()
    return spark.createDataFrame([(c, float(slopes[c]) + 0.0) for c in names], "feature string, slope double")


@_query("WITH d AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id)), g AS (SELECT min(x) AS lo, max(x) AS hi FROM d) SELECT " + ", ".join((_r("lo + i * (hi - lo) / 9", "n_chars"), _r("CAST(j / 9.0 AS DOUBLE)", "signal"), _r("(lo + i * (hi - lo) / 9) / 100000.0", "positive_probability"))) + " FROM g, range(0, 10) a(i), range(0, 10) b(j)")
def boundary_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of a plot of decisions over two features, with the probabilities of a rule."""
    rows = _labelled(spark, sf_dir)
    model = Rule(1000.0, 100_000.0).fit(rows, ["n_chars", "signal"], "quality")
    return _rounded(plots.decision_boundary_data(model, rows, "n_chars", "signal", 10))


@_query(
    "WITH t AS (SELECT DISTINCT l_suppkey, l_quantity > 25 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END ORDER BY md5((l_orderkey * 10 + l_linenumber) || '|6'), l_orderkey * 10 + l_linenumber) - 1) % 4 AS INTEGER) AS fold FROM lineitem"
)
def stratified_row_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of rows, each label dealt evenly in a seeded order."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_quantity") > 25).cast("int").alias("y"))
    return splitting.stratified_folds(lines, "y", "key", 4, 6).select("l_orderkey", "l_linenumber", "fold")
