"""Registered queries of the library's operators over the driver's tables, with DuckDB SQL for the same rows.

Doubles are rounded to six places on both sides, as sums of doubles depend on their order in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetika.functions import columns as C
from kinetika.functions.labels import AU_DESCRIPTIONS, au_code, au_label
from kinetika.operators import classifiers, cleaning, evaluation, features, nmf, normalisation, ordered, plots, reshape, selection, smoothing, splitting, tuning
from kinetika.session import materialize
from kinetika.streaming import windowed_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    # 1e-10 moves exact halves off the edge of rounding; adding 0.0 turns a negative zero into zero
    return df.select(*[(F.round(F.col(f.name) + 1e-10, places) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in df.schema.fields])


def _r(expression: str, name: str) -> str:
    return f"round({expression} + 1e-10, 6) + 0.0 AS {name}"


@_query(
    """
WITH r AS (
    SELECT event_id, user_id, CASE WHEN count(value) OVER w = 4 THEN avg(value) OVER w END AS m
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
), f AS (
    SELECT event_id, user_id,
        coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS s
    FROM r
)
SELECT event_id, user_id, round(s + 1e-10, 6) + 0.0 AS smth_value FROM f
"""
)
def smoothing_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = smoothing.RollingSmoother(4, "user_id", ["value"], order_col="event_id").transform(_read(spark, sf_dir, "events").select("event_id", "user_id", "value"))
    return _rounded(made.select("event_id", "user_id", "smth_value"))


@_query(
    "WITH m AS (SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}, min({c}) AS n_{c}" for c in SIGNALS)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(_r(f"coalesce(({c} - a_{c}) / s_{c} - (n_{c} - a_{c}) / s_{c}, 0)", c) for c in SIGNALS)
    + " FROM lineitem, m"
)
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *SIGNALS)
    return _rounded(normalisation.ZScoreShiftNormalizer(SIGNALS).fit(lines).transform(lines))


@_query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_nan, {_r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'pct_nan')}, CAST(0 AS BIGINT) AS n_inf, CAST(0.0 AS DOUBLE) AS pct_inf, {_r(f'stddev_samp({c})', 'sd')}, max({c}) - min({c}) <= 1e-12 AS is_constant, count({c}) = 0 AS all_nan FROM lineitem"
        for c in SIGNALS
    )
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cleaning.feature_diagnostics(_read(spark, sf_dir, "lineitem").select(*SIGNALS)))


@_query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS q, l_tax AS t FROM lineitem), m AS (SELECT avg(q) AS a FROM l) SELECT l_orderkey, l_linenumber, "
    + _r("coalesce(q, a)", "q")
    + ", "
    + _r("t", "t")
    + " FROM l, m"
)
def clean_mean_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("q"), F.col("l_tax").alias("t"), F.lit(1.5).alias("flat"), F.lit(None).cast("double").alias("none"))
    return _rounded(cleaning.FeatureCleaner(["q", "t", "flat", "none"], impute="mean").fit(lines).transform(lines))


@_query(
    "SELECT l_orderkey, series, "
    + ", ".join(_r(f"max(CASE WHEN l_linenumber = {i} THEN v END)", f"fr_{i}") for i in range(1, 8))
    + " FROM (SELECT l_orderkey, l_linenumber, 'l_quantity' AS series, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem) GROUP BY l_orderkey, series"
)
def series_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_tax").alias("l_tax"))
    return _rounded(reshape.reshape_to_wide(lines, ["l_quantity", "l_tax"], [], "l_orderkey", "l_linenumber"))


@_query(
    "WITH t AS (SELECT user_id, event_type, avg(value) AS m, max(value) AS x FROM events GROUP BY ALL) SELECT user_id, "
    + ", ".join(_r(f"max(CASE WHEN event_type = '{e}' THEN {c} END)", f"{n}_{e}") for n, c in (("mean", "m"), ("max", "x")) for e in EVENT_TYPES)
    + " FROM t GROUP BY user_id"
)
def features_pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    return _rounded(reshape.pivot_features_wide(rows, "user_id", "event_type", ["mean", "max"], series=EVENT_TYPES))


def _event_features(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return _rounded(features.native_features(events, ["user_id"], "event_id", "value").select("user_id", *[f for f in features.FEATURE_GROUPS[group] if f in features.NATIVE], "length"))


_STAGED = """
WITH b AS (
    SELECT user_id, event_id, value AS x, avg(value) OVER p AS mean, count(*) OVER p AS n, min(value) OVER p = max(value) OVER p AS flat, row_number() OVER w - 1 AS t, lag(value) OVER w AS prev, lead(value) OVER w AS nxt
    FROM events WINDOW p AS (PARTITION BY user_id), w AS (PARTITION BY user_id ORDER BY event_id)
), s AS (
    SELECT *, x - mean AS c, x > mean AS above, lag(x > mean) OVER w AS was, sum(CASE WHEN x > mean THEN 0 ELSE 1 END) OVER w AS island FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), l AS (
    SELECT *, count(*) OVER (PARTITION BY user_id, above, island) AS run FROM s
)
"""


@_query(
    _STAGED
    + "SELECT user_id, "
    + ", ".join(
        _r(e, n)
        for e, n in (
            ("avg(x)", "mean"), ("stddev_samp(x)", "sd"), ("min(x)", "min"), ("max(x)", "max"), ("max(x) - min(x)", "range"), ("median(x)", "median"), ("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "iqr"),
            ("CASE WHEN NOT any_value(flat) THEN avg(c * c * c) / pow(avg(c * c), 1.5) END", "skewness"), ("CASE WHEN NOT any_value(flat) THEN avg(c * c * c * c) / pow(avg(c * c), 2) - 3 END", "kurtosis"), ("CAST(count(*) AS DOUBLE)", "length"),
        )
    )
    + " FROM l GROUP BY user_id"
)
def features_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_features(spark, sf_dir, "distribution")


@_query(
    _STAGED
    + ", a AS (SELECT user_id, x, c, flat, n, prev, "
    + ", ".join(f"c * lag(c, {k}) OVER w AS p{k}" for k in range(1, 11))
    + " FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT user_id, any_value(flat) AS flat, sum(c * c) AS v, count(*) AS n, stddev_samp(x - prev) AS dsd, avg(abs(x - prev)) AS mad, "
    + ", ".join(f"sum(p{k}) AS p{k}" for k in range(1, 11))
    + " FROM a GROUP BY user_id) SELECT user_id, "
    + ", ".join(f"CASE WHEN NOT flat THEN round({e} + 1e-10, 6) + 0.0 END AS {n}" for e, n in (("p1 / v", "acf1"), ("p2 / v", "acf2"), (" + ".join(f"coalesce(pow(p{k} / v, 2), 0)" for k in range(1, 11)), "acf10_sumsq"), ("p1 / v", "pacf1"), ("dsd", "diff1_sd"), ("mad", "mean_abs_diff")))
    + ", CAST(n AS DOUBLE) AS length FROM g"
)
def features_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_features(spark, sf_dir, "dynamics")


@_query(
    _STAGED
    + "SELECT user_id, "
    + ", ".join(
        f"CASE WHEN NOT any_value(flat) THEN round({e} + 1e-10, 6) + 0.0 END AS {n}"
        for e, n in (("regr_slope(x, t)", "trend_slope"), ("regr_r2(x, t)", "trend_r2"), ("count(*) FILTER (above <> was) / CAST(count(*) AS DOUBLE)", "mean_crossings"), ("coalesce(max(CASE WHEN above THEN run END), 0) / CAST(count(*) AS DOUBLE)", "longest_run_above_mean"))
    )
    + ", CAST(count(*) AS DOUBLE) AS length FROM l GROUP BY user_id"
)
def features_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_features(spark, sf_dir, "trend")


@_query(
    _STAGED
    + ", k AS (SELECT *, above AND NOT coalesce(was, false) AS begins, sum(CASE WHEN prev IS NULL OR prev <> x THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS level FROM l), q AS (SELECT *, max(CASE WHEN prev <> x THEN prev END) OVER (PARTITION BY user_id, level) AS before FROM k) SELECT user_id, "
    + ", ".join(
        f"CASE WHEN count(*) >= 2 THEN round({e} + 1e-10, 6) + 0.0 END AS {n}"
        for e, n in (
            ("avg(CASE WHEN above THEN 1.0 ELSE 0.0 END)", "prop_active"), ("CAST(count(*) FILTER (begins) AS DOUBLE)", "n_episodes"), ("count(*) FILTER (above) / CAST(count(*) AS DOUBLE) / nullif(count(*) FILTER (begins), 0)", "mean_episode_len"),
            ("max(CASE WHEN above THEN run END) / CAST(count(*) AS DOUBLE)", "max_episode_len"), ("avg(CASE WHEN begins AND prev IS NOT NULL THEN x - prev END)", "mean_onset_slope"), ("avg(CASE WHEN NOT above AND was THEN x - prev END)", "mean_offset_slope"),
            ("count(*) FILTER (before < x AND x > nxt) / CAST(count(*) AS DOUBLE)", "peak_rate"),
        )
    )
    + ", CAST(count(*) AS DOUBLE) AS length FROM q GROUP BY user_id"
)
def features_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_features(spark, sf_dir, "activation")


@_query(
    """
WITH b AS (
    SELECT user_id, value AS x, row_number() OVER w AS i, lead(value, 1) OVER w AS y, lead(value, 2) OVER w AS z, count(*) OVER (PARTITION BY user_id) AS n, 0.2 * stddev_samp(value) OVER (PARTITION BY user_id) AS r, min(value) OVER (PARTITION BY user_id) = max(value) OVER (PARTITION BY user_id) AS flat
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), pe AS (
    SELECT user_id, (CASE WHEN x <= y THEN 1 ELSE 0 END) * 4 + (CASE WHEN x <= z THEN 1 ELSE 0 END) * 2 + (CASE WHEN y <= z THEN 1 ELSE 0 END) AS shape, count(*) AS k FROM b WHERE z IS NOT NULL AND NOT flat GROUP BY ALL
), pt AS (
    SELECT user_id, -sum(k / CAST(s AS DOUBLE) * ln(k / CAST(s AS DOUBLE))) / ln(6) AS permutation_entropy FROM (SELECT *, sum(k) OVER (PARTITION BY user_id) AS s FROM pe) GROUP BY user_id
), se AS (
    SELECT p.user_id, count(*) FILTER (p.y IS NOT NULL AND q.y IS NOT NULL AND abs(p.x - q.x) <= p.r AND abs(p.y - q.y) <= p.r) AS short,
        count(*) FILTER (p.z IS NOT NULL AND q.z IS NOT NULL AND abs(p.x - q.x) <= p.r AND abs(p.y - q.y) <= p.r AND abs(p.z - q.z) <= p.r) AS long
    FROM b p JOIN b q ON p.user_id = q.user_id AND p.i < q.i AND p.n >= 4 AND p.r > 0 GROUP BY p.user_id
)
SELECT u.user_id, round(permutation_entropy + 1e-10, 6) + 0.0 AS permutation_entropy, CASE WHEN short > 0 AND long > 0 THEN round(-ln(CAST(long AS DOUBLE) / short) + 1e-10, 6) + 0.0 END AS sample_entropy
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN pt USING (user_id) LEFT JOIN se USING (user_id)
"""
)
def features_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return _rounded(features.frame_features(events, ["user_id"], "event_id", "value").select("user_id", "permutation_entropy", "sample_entropy"))


@_query("SELECT prediction, count(*) FILTER (quality = 0) AS \"0\", count(*) FILTER (quality = 1) AS \"1\" FROM (SELECT CAST(1 - toxic AS INTEGER) AS prediction, quality FROM labels) GROUP BY prediction")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).cast("int").alias("guess"))
    return evaluation.confusion_matrix_frame(labels, "quality", "guess", [0, 1])


@_query(
    """
WITH c AS (
    SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS DOUBLE) AS tn, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS fn, CAST(count(*) AS DOUBLE) AS n FROM labels
)
SELECT CAST(n AS BIGINT) AS n, """
    + ", ".join(
        _r(e, k)
        for e, k in (
            ("(tp + tn) / n", "accuracy"), ("greatest(tp + fn, tn + fp) / n", "no_information_rate"), ("((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n))", "kappa"),
            ("tp / (tp + fn)", "sensitivity"), ("tn / (tn + fp)", "specificity"), ("tp / (tp + fp)", "ppv"), ("tn / (tn + fn)", "npv"), ("(tp + fn) / n", "prevalence"), ("tp / n", "detection_rate"), ("(tp + fp) / n", "detection_prevalence"),
            ("(tp / (tp + fn) + tn / (tn + fp)) / 2", "balanced_accuracy"), ("2 * tp / (2 * tp + fp + fn)", "f1"), ("(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))", "mcc"),
        )
    )
    + " FROM c"
)
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).cast("int").alias("guess"))
    made = evaluation.classification_metrics(labels, "quality", "guess")
    return _rounded(made.drop("accuracy_ci_lower", "accuracy_ci_upper", "p_acc_gt_nir", "mcnemar_p", "roc_auc", "roc_auc_ci_lower", "roc_auc_ci_upper"))


_DELONG = """
WITH d AS (
    SELECT quality = 1 AS pos, CAST(n_chars AS DOUBLE) AS a, CAST(length(text) % 97 AS DOUBLE) AS b FROM labels JOIN documents USING (doc_id)
), t AS (SELECT count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM d), r AS (
    SELECT pos, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY pos ORDER BY a) + (count(*) OVER (PARTITION BY pos, a) - 1) / 2.0 AS oa,
        rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb, rank() OVER (PARTITION BY pos ORDER BY b) + (count(*) OVER (PARTITION BY pos, b) - 1) / 2.0 AS ob FROM d
), v AS (
    SELECT pos, CASE WHEN pos THEN (ra - oa) / n ELSE 1 - (ra - oa) / p END AS va, CASE WHEN pos THEN (rb - ob) / n ELSE 1 - (rb - ob) / p END AS vb FROM r, t
), s AS (
    SELECT avg(va) FILTER (pos) AS auc_a, avg(vb) FILTER (pos) AS auc_b, (var_samp(va) FILTER (pos)) / max(p) + (var_samp(va) FILTER (NOT pos)) / max(n) AS var_a,
        (var_samp(va - vb) FILTER (pos)) / max(p) + (var_samp(va - vb) FILTER (NOT pos)) / max(n) AS var_d FROM v, t
)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("a"), (F.length("text") % 97).cast("double").alias("b"))
    return _read(spark, sf_dir, "labels").join(docs, "doc_id")


@_query(_DELONG + "SELECT " + ", ".join((_r("auc_a", "auc"), _r("greatest(0, auc_a - 1.959963984540054 * sqrt(var_a))", "ci_lower"), _r("least(1, auc_a + 1.959963984540054 * sqrt(var_a))", "ci_upper"))) + " FROM s")
def delong_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spark.createDataFrame([evaluation.roc_auc_delong_ci(_scored(spark, sf_dir), "quality", "a")], "auc double, ci_lower double, ci_upper double"))


@_query(_DELONG + "SELECT " + ", ".join((_r("auc_a", "auc_a"), _r("auc_b", "auc_b"), _r("auc_a - auc_b", "difference"), _r("(auc_a - auc_b) / sqrt(var_d)", "z"))) + ", true AS paired FROM s")
def delong_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = evaluation.delong_roc_test(_scored(spark, sf_dir), "quality", "a", "b")
    return _rounded(spark.createDataFrame([(made["auc_a"], made["auc_b"], made["difference"], made["z"], made["paired"])], "auc_a double, auc_b double, difference double, z double, paired boolean"))


@_query(
    "WITH d AS (SELECT quality = 1 AS pos, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM d GROUP BY s) SELECT s AS threshold, "
    + _r("sum(p) OVER (ORDER BY s DESC) / CAST(sum(p) OVER () AS DOUBLE)", "tpr")
    + ", "
    + _r("sum(n) OVER (ORDER BY s DESC) / CAST(sum(n) OVER () AS DOUBLE)", "fpr")
    + " FROM c"
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.roc_points(_scored(spark, sf_dir), "quality", "a"))


@_query("SELECT c_acctbal, count(*) AS \"count\", sum(count(*)) OVER (ORDER BY c_acctbal) - count(*) + (count(*) + 1) / 2.0 AS mid_rank FROM customer GROUP BY c_acctbal".replace("sum(count(*))", "CAST(sum(count(*))").replace("ORDER BY c_acctbal) -", "ORDER BY c_acctbal) AS DOUBLE) -"))
def mid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.mid_ranks(_read(spark, sf_dir, "customer"), "c_acctbal")


@_query("WITH k AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(o_custkey || '|7'), o_custkey) AS i, count(*) OVER () AS n FROM k) SELECT o_orderkey, i <= floor(0.8 * n + 1e-9) AS is_train FROM orders JOIN r USING (o_custkey)")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = splitting.group_train_test_split(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 0.8, 7, "o_custkey")
    return train.select("o_orderkey", F.lit(True).alias("is_train")).unionByName(test.select("o_orderkey", F.lit(False).alias("is_train")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # real customers have even keys; the next odd key is the partner
    even = F.col("c_custkey") % 2 == 0
    other = F.when(even, F.col("c_custkey") + 1).otherwise(F.col("c_custkey") - 1)
    known = _read(spark, sf_dir, "customer").select("c_custkey")
    rows = known.select("c_custkey", F.concat(F.lit("v"), "c_custkey").alias("video"), F.concat(F.lit("v"), other).alias("pair"), F.when(even, "real").otherwise("fake").alias("label"), other.alias("o"))
    return rows.join(known.withColumnRenamed("c_custkey", "o"), "o", "left_semi").drop("o")


_PAIRS = "WITH v AS (SELECT c.c_custkey, 'v' || c.c_custkey AS video, 'v' || o.c_custkey AS pair, CASE WHEN c.c_custkey % 2 = 0 THEN 'real' ELSE 'fake' END AS label FROM customer c JOIN customer o ON o.c_custkey = CASE WHEN c.c_custkey % 2 = 0 THEN c.c_custkey + 1 ELSE c.c_custkey - 1 END)"


@_query(_PAIRS + ", r AS (SELECT video, pair, row_number() OVER (ORDER BY md5(video || '|3'), video) AS i, count(*) OVER () AS n FROM v WHERE label = 'real'), t AS (SELECT video FROM r WHERE i <= floor(0.7 * n + 1e-9) UNION SELECT pair FROM r WHERE i <= floor(0.7 * n + 1e-9)) SELECT c_custkey, video IN (SELECT video FROM t) AS is_train FROM v")
def paired_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = splitting.paired_train_test_split(_pairs(spark, sf_dir), 0.7, 3, "video", "label", "pair")
    return train.select("c_custkey", F.lit(True).alias("is_train")).unionByName(test.select("c_custkey", F.lit(False).alias("is_train")))


@_query(_PAIRS + " SELECT c_custkey, video, least(video, pair) AS pair_group FROM v")
def pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pair_groups(_pairs(spark, sf_dir), "video", "pair").select("c_custkey", "video", "pair_group")


@_query("WITH g AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS group_size FROM orders GROUP BY o_custkey) SELECT group_size, count(*) AS n_groups, group_size * count(*) AS n_videos FROM g GROUP BY group_size")
def pair_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pair_group_report(_read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '__scene' ELSE c_custkey || '__scene_' || c_nationkey END AS pair_group FROM customer")
def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, scene = F.col("c_custkey").cast("string"), F.concat(F.lit("__scene_"), F.col("c_nationkey").cast("string"))
    real = F.col("c_custkey") % 3 == 0
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.when(real, F.concat(key, F.lit("__scene"))).otherwise(F.concat(key, F.lit("_99"), scene, F.lit("__ABCD"))).alias("name"), F.when(real, "real").otherwise("fake").alias("label"))
    return splitting.pair_groups_from_filenames(rows, "name", "label").select("c_custkey", "pair_group")


@_query(
    "WITH n AS (SELECT s_suppkey, 'AU' || lpad(CAST(s_suppkey % 50 AS VARCHAR), 2, '0') AS code FROM supplier) SELECT s_suppkey, code, CASE code "
    + " ".join(f"WHEN '{code}' THEN '{code} - {text}'" for code, text in AU_DESCRIPTIONS.items())
    + " ELSE 'smth_' || lower(code) || '_r' END AS label FROM n"
)
def au_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("smth_au"), F.lpad((F.col("s_suppkey") % 50).cast("string"), 2, "0"), F.lit("_r"))
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return rows.select("s_suppkey", au_code(F.col("name")).alias("code"), au_label(F.col("name")).alias("label"))


@_query(" UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, {_r(f'abs(corr({a}, {b}))', 'abs_corr') if a != b else 'max(CAST(1.0 AS DOUBLE)) AS abs_corr'} FROM lineitem" for a in SIGNALS for b in SIGNALS))
def abs_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = selection.abs_correlations(_read(spark, sf_dir, "lineitem"), SIGNALS)
    return _rounded(spark.createDataFrame([(a, b, float(r[i, j])) for i, a in enumerate(SIGNALS) for j, b in enumerate(SIGNALS)], "feature string, other string, abs_corr double"))


@_query("WITH m AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS d FROM part) SELECT p_partkey, " + _r("(p_retailprice - a) / (b - a)", "p_retailprice") + ", " + _r("CAST(p_size - c AS DOUBLE) / (d - c)", "p_size") + " FROM part, m")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double"), F.col("p_size").cast("double"))
    return _rounded(C.min_max_scaled(rows, ["p_retailprice", "p_size"]))


@_query("SELECT l_discount AS threshold, CAST(count(l_tax) AS INTEGER) AS n_splits_scored, " + ", ".join((_r("avg(l_quantity)", "n_features_mean"), _r("min(l_quantity)", "n_features_min"), _r("max(l_quantity)", "n_features_max"), _r("avg(l_tax)", "score_mean"), _r("stddev_samp(l_tax) / sqrt(count(l_tax))", "score_se"))) + " FROM lineitem GROUP BY l_discount")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("threshold"), F.col("l_quantity").alias("n_features"), F.col("l_tax").alias("score"))
    return _rounded(tuning.curve_of(rows)).withColumn("threshold", F.col("threshold"))


@_query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(value) AS length, " + ", ".join((_r("avg(value)", "mean"), _r("stddev_samp(value)", "sd"), _r("min(value)", "min"), _r("max(value)", "max"))) + " FROM events GROUP BY ALL")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windowed_features(_read(spark, sf_dir, "events"), "user_id", "ts", "value", "1 hour"))


@_query(
    "WITH v AS (SELECT quality AS label, (length(text) % 1000) / 1000.0 AS v FROM labels JOIN documents USING (doc_id)), c AS (SELECT label, floor(v * 128) AS cell, count(*) AS n, avg(v) AS middle FROM v GROUP BY ALL), s AS (SELECT label, count(*) AS total, stddev_samp(v) * pow(count(*), -0.2) AS width FROM v GROUP BY label), g AS (SELECT unnest(range(0, 32)) / 31.0 AS x) SELECT label, "
    + _r("x", "x")
    + ", "
    + _r("sum(n * exp(-pow((x - middle) / width, 2) / 2)) / (max(total) * max(width) * sqrt(2 * pi()))", "density")
    + " FROM c JOIN s USING (label), g GROUP BY label, x"
)
def score_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", ((F.length("text") % 1000) / 1000.0).alias("s"))
    return _rounded(plots.probability_distribution_data(_read(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "s", 32))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", *[(F.col(c) * scale).alias(f"smth_{c}") for c, scale in zip(SIGNALS, (0.02, 1e-5, 10.0, 12.0), strict=True)])


def _gram_power() -> str:
    """The leading direction of the matrix's 4 x 4 Gram table, by 60 squarings' worth of power iteration: the best basis of rank one."""
    cells = [f"sum(x{i} * x{j}) AS g{i}{j}" for i in range(4) for j in range(4)]
    steps = ["p0 AS (SELECT *, CAST(0.5 AS DOUBLE) AS v0, CAST(0.5 AS DOUBLE) AS v1, CAST(0.5 AS DOUBLE) AS v2, CAST(0.5 AS DOUBLE) AS v3 FROM gram)"]
    columns = ", ".join(f"g{i}{j}" for i in range(4) for j in range(4))
    for k in range(1, 31):
        made = ", ".join("(" + " + ".join(f"g{i}{j} * v{j}" for j in range(4)) + f") AS u{i}" for i in range(4))
        steps.append(f"q{k} AS (SELECT {columns}, {made} FROM p{k - 1}), p{k} AS (SELECT {columns}, " + ", ".join(f"u{i} / sqrt(u0 * u0 + u1 * u1 + u2 * u2 + u3 * u3) AS v{i}" for i in range(4)) + f" FROM q{k})")
    matrix = "x AS (SELECT l_orderkey, l_linenumber, l_quantity * 0.02 AS x0, l_extendedprice * 1e-5 AS x1, l_discount * 10.0 AS x2, l_tax * 12.0 AS x3 FROM lineitem)"
    return "WITH " + matrix + ", gram AS (SELECT " + ", ".join(cells) + " FROM x), " + ", ".join(steps) + ", w AS (SELECT x.*, v0, v1, v2, v3, x0 * v0 + x1 * v1 + x2 * v2 + x3 * v3 AS w FROM x, p30)"


def _rank_one(spark: SparkSession, sf_dir: str) -> tuple[nmf.NMFDecomposer, DataFrame]:
    rows = _matrix(spark, sf_dir)
    return nmf.NMFDecomposer(1, max_iter=200, tol=1e-14).fit(rows), rows


@_query(_gram_power() + " SELECT l_orderkey, l_linenumber, " + _r("w", "nmf1") + " FROM w")
def nmf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the best factorisation of rank one, for a basis of length one: non-negative data make it the leading direction."""
    model, rows = _rank_one(spark, sf_dir)
    made = model.transform(rows)
    return _rounded(made.withColumn("nmf1", F.col("nmf1") * float((model.components_[0] ** 2).sum() ** 0.5)))


@_query(
    _gram_power()
    + ", e AS (SELECT unnest([x0, x1, x2, x3]) AS x, unnest([x0 - w * v0, x1 - w * v1, x2 - w * v2, x3 - w * v3]) AS e FROM w) SELECT unnest(['RMSE', 'NRMSE', 'MAE', 'R2']) AS metric, round(unnest([sqrt(avg(e * e)), sqrt(avg(e * e)) / (max(x) - min(x)), avg(abs(e)), 1 - sum(e * e) / (var_pop(x) * count(*))]) + 1e-10, 6) + 0.0 AS value FROM e"
)
def nmf_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _rank_one(spark, sf_dir)
    return _rounded(nmf.nmf_reconstruction_error(model, rows))


@_query(_gram_power() + ", e AS (SELECT avg(pow(x0 - w * v0, 2) + pow(x1 - w * v1, 2) + pow(x2 - w * v2, 2) + pow(x3 - w * v3, 2)) / 4 AS m FROM w) SELECT CAST(1 AS INTEGER) AS rank, " + _r("m", "mse") + " FROM e")
def nmf_rank_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nmf.nmf_rank_mse_sweep(_matrix(spark, sf_dir), [1], max_iter=200, tol=1e-14))


@_query("SELECT true AS error_falls, true AS nonnegative, true AS rows_are_optimal, count(*) AS n FROM lineitem")
def nmf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factorisation of rank two at the default settings: its error is less than that of rank one, and every row's weights are optimal."""
    one, rows = _rank_one(spark, sf_dir)
    two = nmf.NMFDecomposer(2, random_state=1).fit(rows)
    h = two.components_
    gram = h @ h.T
    w, x = [F.get("_w", F.lit(j)) for j in range(2)], [F.col(c) for c in two.columns_]
    slope = [sum(w[k] * float(gram[j, k]) for k in range(2)) - sum(v * float(h[j, i]) for i, v in enumerate(x)) for j in range(2)]
    scale = float(abs(gram).max())
    good = (F.least(*w) >= 0) & (F.least(*slope) >= -1e-6 * scale) & (F.greatest(*[F.abs(a * b) for a, b in zip(w, slope, strict=True)]) <= 1e-6 * scale)
    row = two.weights(rows).agg(F.min(F.least(*w)).alias("least"), F.bool_and(good).alias("good"), F.count("*").alias("n")).first()
    falls = two.reconstruction_error_ < one.reconstruction_error_
    return spark.createDataFrame([(bool(falls), bool(row.least >= 0 and (h >= 0).all()), row.good, row.n)], "error_falls boolean, nonnegative boolean, rows_are_optimal boolean, n long")


def _folds_sql(table: str, group: str, labels: dict[str, str], splits: int, seeds: list[int]) -> str:
    """Folds by position: groups by size and label counts, the largest first, then by hash, dealt there and back."""
    counts = ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in labels.items())
    order = ", ".join(["s DESC", *[f"{n} DESC" for n in labels]])
    parts = [f"SELECT CAST({i} AS INTEGER) AS repeat, {group}, row_number() OVER (ORDER BY {order}, md5({group} || '|{seed}')) - 1 AS i FROM g" for i, seed in enumerate(seeds)]
    return f"WITH g AS (SELECT {group}, count(*) AS s, {counts} FROM {table} GROUP BY {group}), r AS ({' UNION ALL '.join(parts)}), f AS (SELECT repeat, {group}, CAST(CASE WHEN (i // {splits}) % 2 = 0 THEN i % {splits} ELSE {splits - 1} - i % {splits} END AS INTEGER) AS fold FROM r)"


@_query(_folds_sql("orders", "o_custkey", {x: f"o_orderstatus = '{x}'" for x in "FOP"}, 5, [1, 1001]) + " SELECT repeat, o_custkey, fold FROM f")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return splitting.RepeatedStratifiedGroupKFold(5, 2, 1).assign(orders, "o_orderstatus", "o_custkey")


@_query()
def feature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)])
    return selection.correlated_feature_clusters(rows)


@_query()
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four classifiers, smaller than by default, learned from four fifths of the vectors and measured on the rest."""
    names = [f"e{i}" for i in range(64)]
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 1, "fake").otherwise("real").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    rows, held = materialize(vectors, "vectors"), F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    models = {n: classifiers.make_classifier(n, random_state=1, **o) for n, o in (("random_forest", {"n_estimators": 20}), ("c50_substitute", {"n_estimators": 5}), ("svm_rbf", {"max_iter": 20}), ("logistic_regression", {}))}
    return evaluation.evaluate_models(classifiers.fit_classifiers(models, rows.filter(~held), names, "y", "fake"), rows.filter(held), "y", "fake")


@_query()
def boruta_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double"), F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("capitals"), F.length(F.regexp_replace("text", "[A-Za-z ]", "")).cast("double").alias("marks"), (F.xxhash64("doc_id") % 1000).cast("double").alias("noise"))
    rows = _read(spark, sf_dir, "labels").join(docs, "doc_id")
    chosen = selection.BorutaSelector(["n_chars", "capitals", "marks", "noise"], n_repeats=4, n_estimators=20, max_iter=15, random_state=5).fit(rows, "quality")
    return chosen.stability_.select("feature", "selection_freq", "n_confirmed", "n_tentative", "n_rejected", "selected", "cluster")


@_query(
    "WITH m AS (SELECT avg(value) FILTER (user_id % 2 = 0) AS a, stddev_samp(value) FILTER (user_id % 2 = 0) AS s, min(value) AS n FROM events) SELECT event_id, "
    + _r("(value - a) / s - (n - a) / s", "value")
    + " FROM events, m"
)
def normalise_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return _rounded(normalisation.ZScoreShiftNormalizer(["value"]).fit(events.filter("user_id % 2 = 0")).transform(events).drop("user_id"))


@_query(
    """
WITH b AS (
    SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events
), k AS (
    SELECT DISTINCT user_id, n, unnest(range(1, n // 2 + 1)) AS f FROM b WHERE n >= 4
), p AS (
    SELECT user_id, b.n, f, (pow(sum(c * cos(2 * pi() * f * t / b.n)), 2) + pow(sum(c * sin(2 * pi() * f * t / b.n)), 2)) * CASE WHEN 2 * f = b.n THEN 1 ELSE 2 END AS power FROM b JOIN k USING (user_id) GROUP BY user_id, b.n, f
), q AS (
    SELECT user_id, power / sum(power) OVER (PARTITION BY user_id) AS p, count(*) OVER (PARTITION BY user_id) AS bins FROM p
)
SELECT user_id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(max(bins)) + 1e-10, 6) + 0.0 AS spectral_entropy FROM q GROUP BY user_id
"""
)
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.frame_features(_read(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", "spectral_entropy"))


def _levinson() -> str:
    """The recursion over five lags, a step per common table expression."""
    steps, weights = [], []
    for k in range(1, 6):
        before = " - ".join([f"r{k}", *[f"w{k - 1}_{j} * r{k - j}" for j in range(1, k)]])
        new = f"(({before}) / v{k - 1})" if k > 1 else "r1"
        weights = [f"w{k - 1}_{j} - {new} * w{k - 1}_{k - j} AS w{k}_{j}" for j in range(1, k)] + [f"{new} AS w{k}_{k}"]
        steps.append(f"s{k} AS (SELECT *, {', '.join(weights)}, v{k - 1} * (1 - pow({new}, 2)) AS v{k} FROM s{k - 1})")
    return ", ".join(steps)


@_query(
    "WITH b AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS c FROM events), l AS (SELECT user_id, c, "
    + ", ".join(f"c * lag(c, {k}) OVER w AS p{k}" for k in range(1, 6))
    + " FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s0 AS (SELECT user_id, CAST(1.0 AS DOUBLE) AS v0, "
    + ", ".join(f"sum(p{k}) / sum(c * c) AS r{k}" for k in range(1, 6))
    + " FROM l GROUP BY user_id), "
    + _levinson()
    + " SELECT user_id, "
    + _r(" + ".join(f"pow(w{k}_{k}, 2)" for k in range(1, 6)), "pacf5_sumsq")
    + " FROM s5"
)
def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.frame_features(_read(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", "pacf5_sumsq"))


@_query("WITH g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) AS a, count(DISTINCT o_custkey % 7) AS b FROM orders GROUP BY o_custkey) SELECT 'o_orderstatus' AS column_name, max(a) <= 1 AS constant FROM g UNION ALL SELECT 'bucket', max(b) <= 1 FROM g")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    import warnings

    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", (F.col("o_custkey") % 7).alias("bucket"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kept = reshape.resolve_id_vars(orders, ["o_orderstatus", "bucket"], "o_custkey")
    return spark.createDataFrame([(c, c in kept) for c in ("o_orderstatus", "bucket")], "column_name string, constant boolean")


_BASIS = (0.02, 0.5, 1.5, 0.8)


@_query(
    "WITH x AS (SELECT l_quantity * 0.02 AS a, l_extendedprice * 1e-5 AS b, l_discount * 10.0 AS c, l_tax * 12.0 AS d FROM lineitem), w AS (SELECT *, greatest(0, (a * 0.02 + b * 0.5 + c * 1.5 + d * 0.8) / "
    + repr(sum(v * v for v in _BASIS))
    + ") AS w FROM x), e AS (SELECT unnest([a, b, c, d]) AS x, unnest([a - w * 0.02, b - w * 0.5, c - w * 1.5, d - w * 0.8]) AS e FROM w) SELECT unnest(['RMSE', 'NRMSE', 'MAE', 'R2']) AS metric, round(unnest([sqrt(avg(e * e)), sqrt(avg(e * e)) / (max(x) - min(x)), avg(abs(e)), 1 - sum(e * e) / (var_pop(x) * count(*))]) + 1e-10, 6) + 0.0 AS value FROM e"
)
def reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of a given basis of rank one, whose least squares have a closed form."""
    import numpy as np

    model = nmf.NMFDecomposer(1)
    model.columns_, model.components_ = [f"smth_{c}" for c in SIGNALS], np.array([_BASIS])
    return _rounded(nmf.nmf_reconstruction_error(model, _matrix(spark, sf_dir)))


_RUNS_SQL = """
WITH h AS (
    SELECT CAST(o_orderkey % 5 AS INTEGER) AS run, o_orderpriority AS feature, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS importance, CASE WHEN o_custkey % 5 = o_orderkey % 5 THEN 1.0 ELSE 0.0 END AS hit FROM orders
), r AS (
    SELECT run, feature, median(importance) AS m, round(avg(hit), 9) AS share FROM h GROUP BY run, feature
)
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for iterations: a run, a feature, its importance (missing where it is rejected) and whether it beat the shadows."""
    orders = _read(spark, sf_dir, "orders")
    hit = F.when(F.col("o_custkey") % 5 == F.col("o_orderkey") % 5, 1.0).otherwise(0.0)
    runs = orders.groupBy((F.col("o_orderkey") % 5).cast("int").alias("run"), F.col("o_orderpriority").alias("feature")).agg(F.round(F.avg(hit), 9).alias("hit_share"), F.collect_list(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1000)).alias("importances"))
    share = F.col("hit_share")
    decision = F.when(share >= 0.205, "Confirmed").when(share < 0.195, "Rejected").otherwise("Tentative")
    return runs.select("run", "feature", decision.alias("decision"), F.when(share >= 0.2, "Confirmed").otherwise("Rejected").alias("rough_decision"), "hit_share", "importances")


@_query(
    _RUNS_SQL
    + "SELECT feature, "
    + _r("avg(CASE WHEN share >= 0.2 THEN 1.0 ELSE 0.0 END)", "selection_freq")
    + ", CAST(count(*) FILTER (share >= 0.205) AS INTEGER) AS n_confirmed, CAST(count(*) FILTER (share >= 0.195 AND share < 0.205) AS INTEGER) AS n_tentative, CAST(count(*) FILTER (share < 0.195) AS INTEGER) AS n_rejected, "
    + _r("median(m)", "median_imp")
    + ", "
    + _r("avg(share)", "norm_hits")
    + " FROM r GROUP BY feature"
)
def stability_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.stability_rollup(_runs(spark, sf_dir)))


@_query(
    "WITH c AS (SELECT l_discount AS threshold, avg(l_tax) AS m, stddev_samp(l_tax) / sqrt(count(*)) AS se FROM lineitem GROUP BY l_discount), b AS (SELECT m AS bm, se AS bse FROM c ORDER BY m DESC, threshold LIMIT 1) SELECT max(threshold) AS one_se, (SELECT threshold FROM c ORDER BY m DESC, threshold LIMIT 1) AS best FROM c, b WHERE m >= bm - bse"
)
def one_se_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("threshold"), F.col("l_quantity").alias("n_features"), F.col("l_tax").alias("score"))
    curve = materialize(tuning.curve_of(rows), "curve")
    return spark.createDataFrame([(tuning.select_threshold(curve, "one_se"), tuning.select_threshold(curve, "best"))], "one_se double, best double")


@_query("SELECT feature, n, CASE WHEN k >= 17 THEN 'Confirmed' WHEN k <= 3 THEN 'Rejected' ELSE 'Tentative' END AS decision FROM (SELECT 'f' || n_nationkey AS feature, CAST(20 AS INTEGER) AS n, n_nationkey % 21 AS k FROM nation)")
def binomial_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rounds, with a nation's key as its hits; alpha leaves 17 or more, and 3 or fewer, significant after correction."""
    import numpy as np

    rows = _read(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()
    hits = np.array([r[0] % 21 for r in rows])
    decided = selection.do_tests(np.full(len(rows), selection.TENTATIVE, object), hits, 20, 0.0014 * len(rows))
    return spark.createDataFrame([(f"f{r[0]}", 20, str(d)) for r, d in zip(rows, decided, strict=True)], "feature string, n int, decision string")


def _together(*names: str) -> str:
    """The rows of several queries side by side; ``length`` comes from the first alone."""
    parts = [f"(SELECT * {'EXCLUDE (length)' if i and name in ('features_dynamics', 'features_trend', 'features_activation') else ''} FROM ({SQL[name]}))" for i, name in enumerate(names)]
    return "SELECT * FROM " + parts[0] + "".join(f" JOIN {p} USING (user_id)" for p in parts[1:])


@_query(_together("features_distribution", "features_dynamics", "features_trend", "features_activation", "features_complexity", "spectral_entropy", "partial_autocorrelation"))
def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.frame_features(_read(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value"))


from kinetika import queries_models  # noqa: E402, F401
