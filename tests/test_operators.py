import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import kinetika as K
from kinetika.functions import series as S
from kinetika.functions.columns import min_max_scaled
from kinetika.operators import classifiers, cleaning, evaluation, external, features, nmf, ordered, plots, selection, splitting, tuning


def series(spark, values, group="v"):
    return spark.createDataFrame([(group, i, None if v is None else float(v)) for i, v in enumerate(values)], "video_filename string, frame int, AU01_r double")


@pytest.mark.parametrize("values,window,expected", [([1, 2, 3, 4, 5, 6], 4, [2.5, 3.5, 4.5, 4.5, 4.5, 4.5]), ([1, 2, 3, 4, 5, 6], 2, [1.5, 2.5, 3.5, 4.5, 5.5, 5.5]), ([5, 5, 5], 4, [None] * 3), ([None, 1, 3, None, 5, 7], 2, [2, 2, 2, 2, 6, 6])])
def test_smoother(spark, values, window, expected):
    rows = K.RollingSmoother(window).fit_transform(series(spark, values)).orderBy("frame").collect()
    assert [r.smth_AU01_r for r in rows] == expected and [r.AU01_r for r in rows] == [None if v is None else float(v) for v in values]


def test_smoother_leaves_rows_without_a_group(spark):
    assert all(r.smth_AU01_r is None for r in K.RollingSmoother(1).fit_transform(series(spark, [1, 2], None)).collect())


def test_normalizer_keeps_moments_and_shifts_anew(spark):
    frame = spark.createDataFrame([(float(v),) for v in [1, 3, 2, 8, 4, 4, 9]], "smth_x double")
    model = K.ZScoreShiftNormalizer().fit(frame)
    out = [r.smth_x for r in model.transform(frame).collect()]
    assert min(out) == 0 and max(out) == pytest.approx(8 / np.std([1, 3, 2, 8, 4, 4, 9], ddof=1))
    shifted = model.transform(frame.select((F.col("smth_x") + 100).alias("smth_x"))).collect()
    assert [r.smth_x for r in shifted] == pytest.approx(out)
    flat = spark.createDataFrame([(5.0,), (None,), (float("nan"),)], "smth_x double")
    assert [r.smth_x for r in K.ZScoreShiftNormalizer().fit(flat).transform(flat).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        K.ZScoreShiftNormalizer().transform(frame)


def test_reshape(spark):
    rows = [(v, lab, f, float(f), f * 2.0, f % 2) for v, lab in (("a", "real"), ("b", "fake")) for f in (10, 2, 1) if not (v == "b" and f == 2)]
    frame = spark.createDataFrame(rows, "video_filename string, isfakeorreal string, frame int, x double, y double, odd int")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        wide = K.reshape_to_wide(frame, ["x", "y"])
    assert wide.columns == ["video_filename", "isfakeorreal", "series", "fr_1", "fr_2", "fr_10"] and any("odd" in str(w.message) for w in said)
    got = {(r.video_filename, r.series): (r.fr_1, r.fr_2, r.fr_10) for r in wide.collect()}
    assert got["a", "y"] == (2, 4, 20) and got["b", "x"] == (1, None, 10)
    keep, _ = K.split_wide(wide)
    assert keep == ["video_filename", "isfakeorreal", "series"]
    with pytest.raises(ValueError):
        K.split_wide(wide, "^none")
    with pytest.raises(Exception, match="twice"):
        K.reshape_to_wide(frame.union(frame.limit(1)), ["x"], []).collect()
    pivoted = K.pivot_features_wide(spark.createDataFrame([("a", "s", 1.0, 2.0), ("a", "t", 3.0, 4.0)], "video_filename string, series string, mean double, sd double"), "video_filename")
    assert pivoted.columns == ["video_filename", "mean_s", "mean_t", "sd_s", "sd_t"] and tuple(pivoted.first()) == ("a", 1, 3, 2, 4)


def test_native_features_agree_with_numpy(spark):
    rng = np.random.default_rng(2)
    known = {"noise": rng.normal(size=50), "steps": np.tile([1.0, 1, 0, 0, 2], 8), "flat": np.full(9, 3.0), "one": np.array([2.0]), "two": np.array([1.0, 4.0]), "ramp": np.arange(12.0)}
    rows = [(g, i, float(v)) for g, x in known.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "g string, i int, v double").repartition(3)
    for rule in ("mean", "median", 0.5):
        for r in features.frame_features(frame, ["g"], "i", "v", rule).collect():
            expected = S.extract_features(known[r.g], rule)
            for name in S.FEATURE_NAMES:
                got = float("nan") if r[name] is None else r[name]
                assert got == pytest.approx(expected[name], abs=1e-9, nan_ok=True), (r.g, rule, name)
    with pytest.raises(Exception, match="missing"):
        features.frame_features(frame.union(spark.createDataFrame([("x", 1, None)], "g string, i int, v double")), ["g"], "i", "v").collect()
    with pytest.raises(ValueError):
        features.native_features(frame, ["g"], "i", "v", "mode")
    assert features.frame_features(frame.limit(0), ["g"], "i", "v").count() == 0


def test_feature_extractor_and_callables(spark):
    wide = spark.createDataFrame([("a", "s", 1.0, 2.0, 4.0), ("b", "s", 3.0, 3.0, 3.0)], "video_filename string, series string, fr_1 double, fr_2 double, fr_3 double")
    out = K.TimeSeriesFeatureExtractor().fit(wide).transform(wide)
    assert out.columns == ["video_filename", "series", *K.FEATURE_NAMES] and {r.video_filename: r.mean for r in out.collect()} == {"a": pytest.approx(7 / 3), "b": 3}
    assert {r.acf1 is None for r in out.filter("video_filename = 'b'").collect()} == {True}
    made = K.CallableFeatureExtractor(lambda x: {"total": x.sum(), "top": x.max()}).transform(wide)
    assert made.columns[-2:] == ["total", "top"] and made.filter("video_filename = 'a'").first().total == 7
    assert external.as_features({"names": ["a"], "values": [1]}) == {"a": 1} and external.as_features((["a"], [2])) == {"a": 2} and external.as_features(pd.Series({"z": 3})) == {"z": 3}
    with pytest.raises(TypeError):
        external.as_features([1, 2])
    with pytest.raises(ValueError):
        external.as_features([1, 2], ["a"])
    with pytest.raises(ImportError, match="rpy2"):
        K.cmfts_r_features(wide)


def test_diagnostics_and_cleaner(spark):
    inf, nan = float("inf"), float("nan")
    frame = spark.createDataFrame([("v", 1.0, nan, inf, nan, 2.0), ("w", 2.0, 1.0, 1.0, None, 2.0), ("x", 4.0, 3.0, 5.0, nan, 2.0)], "id string, a double, b double, c double, d double, e double")
    found = {r.feature: r for r in K.feature_diagnostics(frame).collect()}
    assert found["b"].n_nan == 1 and found["c"].n_inf == 1 and found["d"].all_nan and found["d"].is_constant and found["e"].is_constant and not found["a"].is_constant
    with pytest.warns(UserWarning, match="constant"):
        model = cleaning.FeatureCleaner(impute="median").fit(frame)
    assert model.dropped_columns_ == ["d"] and model.zero_sd_columns_ == ["e"] and model.get_feature_names_out() == ["a", "b", "c"]
    rows = {r.id: r for r in model.transform(frame).collect()}
    assert rows["v"].b in (1, 2, 3) and rows["v"].c in (1, 3, 5)
    raw = cleaning.FeatureCleaner(impute=False, drop_columns=["a"], drop_zero_sd=False).fit(frame)
    assert raw.get_feature_names_out() == ["b", "c", "e"] and raw.transform(frame).filter("id = 'v'").first().c is None
    with pytest.raises(ValueError):
        cleaning.FeatureCleaner().transform(frame)


def test_forest_imputer(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    rows = [(float(a), None if i % 6 == 0 else float(2 * a), float(b)) for i, (a, b) in enumerate(zip(x, rng.normal(size=60), strict=True))]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    model = cleaning.IterativeForestImputer(["a", "b", "c"], trees=10, rounds=2).fit(frame)
    out = model.transform(frame).collect()
    assert all(r.b is not None for r in out) and np.corrcoef([r.a for r in out], [r.b for r in out])[0, 1] > 0.9


def pairs(spark, n=12):
    rows = [(f"{kind}_{i}", f"{other}_{i}", kind, f) for i in range(n) for kind, other in (("real", "fake"), ("fake", "real")) for f in range(2)]
    return spark.createDataFrame(rows, "video_filename string, corresponding_video string, isfakeorreal string, frame int")


def test_splits_keep_groups_whole(spark):
    frame = pairs(spark)
    train, test = K.paired_train_test_split(frame, 0.75, 3)
    a, b = ({r.video_filename for r in side.collect()} for side in (train, test))
    assert not a & b and len(a) == 18 and len(b) == 6 and {v.split("_")[1] for v in a} & {v.split("_")[1] for v in b} == set()
    again = {r.video_filename for r in K.paired_train_test_split(frame.repartition(5), 0.75, 3)[0].collect()}
    assert again == a
    train, test = K.group_train_test_split(frame, 0.5, 1)
    assert train.select("video_filename").distinct().count() == 12 and train.count() + test.count() == frame.count()
    broken = frame.filter("video_filename != 'fake_3'")
    with pytest.raises(ValueError, match="broken"):
        K.paired_train_test_split(broken, 1.0, 0)
    with pytest.raises(KeyError):
        K.group_train_test_split(frame, video_col="nope")


def test_pair_groups(spark):
    frame = pairs(spark, 3)
    assert {r.video_filename: r.pair_group for r in K.pair_groups(frame).collect()} == {f"{k}_{i}": f"fake_{i}" for i in range(3) for k in ("real", "fake")}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", None), ("z", "gone")], "video_filename string, corresponding_video string")
    with pytest.warns(UserWarning):
        found = {r.video_filename: r.pair_group for r in K.pair_groups(chain).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}
    with pytest.raises(ValueError, match="more than one"):
        K.pair_groups(chain.union(spark.createDataFrame([("a", "d")], chain.schema)))
    report = {r.group_size: (r.n_groups, r.n_videos) for r in K.pair_group_report(K.pair_groups(frame)).collect()}
    assert report == {2: (3, 6)}
    named = spark.createDataFrame([("1__s", "real"), ("1_2__s__H", "fake")], "video_filename string, isfakeorreal string")
    assert {r.pair_group for r in K.pair_groups_from_filenames(named).collect()} == {"1__s"}
    assert {r.pair_group for r in K.pair_groups_from_filenames(named, key_fn=lambda v, lab: v[:1] + "!" if isinstance(v, str) else v.nope()).collect()} == {"1!"}


def test_group_folds(spark):
    frame = K.pair_groups(pairs(spark, 20))
    folds = K.RepeatedStratifiedGroupKFold(5, 2, 0)
    rows = folds.assign(frame, "isfakeorreal", "pair_group").collect()
    assert len(rows) == 40 and {(r.repeat, r.fold) for r in rows} == {(a, b) for a in range(2) for b in range(5)}
    for repeat, fold, train, test in list(folds.split(frame, "isfakeorreal", "pair_group"))[:1]:
        assert train.join(test, "pair_group").count() == 0 and test.filter("isfakeorreal = 'real'").count() == test.count() / 2
    with pytest.raises(ValueError):
        folds.assign(frame, "isfakeorreal", None)


def test_stratified_folds_are_even(spark):
    frame = spark.range(103).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("y"))
    made = splitting.stratified_folds(frame, "y", "k", 4, 1)
    counts = {}
    for r in made.groupBy("y", "fold").count().collect():
        counts.setdefault(r.y, []).append(r["count"])
    assert made.count() == 103 and all(len(v) == 4 and max(v) - min(v) <= 1 for v in counts.values())
    half, rest = K.group_train_test_split(frame, 0.5, 2, "k")
    assert (half.count(), rest.count()) == (51, 52)
    assert K.group_train_test_split(frame, 1.0, 2, "k")[1].count() == 0 and K.group_train_test_split(frame, 0.0, 2, "k")[0].count() == 0


def test_nmf(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 3)) @ rng.random((3, 8)) + rng.random((200, 8)) * 0.01
    frame = spark.createDataFrame([(f"v{i % 10}", i, *map(float, r)) for i, r in enumerate(x)], "video_filename string, frame int, " + ", ".join(f"smth_AU0{j}_r double" for j in range(8)))
    model = K.NMFDecomposer(3, max_iter=60).fit(frame)
    assert (model.components_ >= 0).all()
    out = model.transform(frame)
    assert out.columns == ["video_filename", "frame", "nmf1", "nmf2", "nmf3"] and out.filter("nmf1 < 0").count() == 0
    error = {r.metric: r.value for r in K.nmf_reconstruction_error(model, frame).collect()}
    assert error["R2"] > 0.99 and error["RMSE"] < 0.05
    assert K.nmf_reconstruction_r2_per_au(model, frame).count() == 8
    sweep = K.nmf_rank_mse_sweep(frame, [2, 3], max_iter=30).collect()
    assert sweep[0].mse > sweep[1].mse
    cv = K.nmf_rank_cv_sweep(frame, [2, 3], n_replicates=2, max_iter=200)
    assert cv.count() == 4 and nmf.best_rank(cv).first()["rank"] == 3
    assert K.nmf_rank_cv_sweep(frame, [3], n_replicates=1, method="als").first().test_mse < 0.1
    stable = {r["rank"]: r.cophenetic for r in K.nmf_cophenetic_correlation(frame.limit(40), [2, 3], n_runs=3, max_iter=50).collect()}
    assert all(0 < v <= 1 for v in stable.values())
    chosen = K.select_representative_aus(spark, model)
    selector = K.RepresentativeAUSelector(model).fit(frame)
    assert chosen.count() == 3 and selector.transform(frame).columns == ["video_filename", "frame", *selector.selected_columns_]
    with pytest.raises(ValueError):
        K.NMFDecomposer().transform(frame)
    assert plots.nmf_basis_data(spark, model).agg(F.max("weight")).first()[0] == 1
    assert plots.nmf_rank_cv_data(cv).count() == 2


def test_masked_nmf_ignores_held_entries():
    x = np.outer(np.arange(1, 9.0), np.arange(1, 6.0))
    mask = np.ones(x.shape, bool)
    mask[2, 3] = False
    hidden = x.copy()
    hidden[2, 3] = 1e6
    w, h = nmf.masked_nmf(hidden, mask, 1, 500, 1e-9, 0)
    assert (w @ h)[2, 3] == pytest.approx(12, rel=0.02)


def test_boruta_state_machine():
    decisions = np.array([selection.TENTATIVE] * 3, object)
    assert list(selection.do_tests(decisions, np.array([20, 10, 0]), 20, 0.01)) == ["Confirmed", "Tentative", "Rejected"]
    history = np.array([[1.0, 0.0], [3.0, 0.0]])
    assert list(selection.tentative_rough_fix(np.array(["Tentative"] * 2, object), history, np.array([0.5, 0.5]))) == ["Confirmed", "Rejected"]
    assert selection.make_shadows(np.ones((4, 2)), np.random.default_rng(0)).shape == (4, 8)
    run = selection.boruta_run(np.zeros((30, 2)), np.arange(30) % 2, ["a", "b"], lambda x, y, seed: np.r_[5.0, np.zeros(x.shape[1] - 1)], max_iter=40)
    assert run.confirmed() == ["a"] and run.decisions[1] == "Rejected" and len(run.shadows) == len(run.history) <= 39


def test_boruta_selector(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, 3))
    frame = spark.createDataFrame([(f"v{i}", *map(float, r), "fake" if r[0] > 0 else "real") for i, r in enumerate(x)], "video_filename string, informative double, noise_a double, noise_b double, isfakeorreal string")
    model = K.BorutaSelector(n_repeats=2, n_estimators=25, max_iter=20, random_state=1).fit(frame, "isfakeorreal")
    assert model.selected_columns_ == ["informative"] and model.support_ == [True, False, False]
    assert model.transform(frame).columns == ["video_filename", "isfakeorreal", "informative"]
    assert model.stability_.first().feature == "informative" and model.cluster_stability().first().best_feature == "informative"
    assert K.boruta_feature_stats(spark, model).first().decision == "Confirmed" and plots.boruta_importance_data(spark, model, max_features=1).count() == 1
    with pytest.raises(ValueError):
        K.BorutaSelector(n_repeats=0)
    with pytest.raises(ValueError):
        K.BorutaSelector(importance="x")
    with pytest.warns(UserWarning, match="one run"):
        one = K.BorutaSelector(n_repeats=1, importance=lambda a, b, s: np.r_[1.0, np.zeros(a.shape[1] - 1)], max_iter=30, correlation_threshold=None).fit(frame, "isfakeorreal")
    assert one.selected_columns_ == ["informative"]
    with pytest.raises(ValueError):
        one.cluster_stability()


def test_clusters(spark):
    rng = np.random.default_rng(5)
    base, other = rng.normal(size=200), rng.normal(size=200)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[base + rng.normal(size=200) * 0.05, base, other, np.ones(200)]], "dup_a double, dup_b double, independent double, flat double")
    got = {r.feature: (r.cluster, r.cluster_size, r.max_abs_corr) for r in K.correlated_feature_clusters(frame).collect()}
    assert got["dup_a"][0] == got["dup_b"][0] and got["dup_a"][1] == 2 and got["independent"][2] is None and got["flat"][1] == 1
    assert plots.feature_cluster_data(frame, ["dup_a", "dup_b", "independent"]).count() == 9


def counts_frame(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp, "y int, p int")


def test_metrics(spark):
    row = K.classification_metrics(counts_frame(spark, 30, 17, 13, 34), "y", "p").first()
    assert row.n == 94 and row.accuracy == pytest.approx(64 / 94) and row.accuracy_ci_lower == pytest.approx(0.57669, abs=1e-5) and row.mcc == pytest.approx((34 * 30 - 17 * 13) / math.sqrt(51 * 47 * 47 * 43))
    assert K.classification_metrics(counts_frame(spark, 3, 0, 0, 3), "y", "p").first().mcnemar_p is None
    assert K.classification_metrics(counts_frame(spark, 3, 2, 2, 3), "y", "p").first().mcnemar_p == 1
    assert K.classification_metrics(counts_frame(spark, 3, 0, 2, 0), "y", "p").first().ppv is None
    named = counts_frame(spark, 2, 1, 1, 2).select(F.when(F.col("y") == 1, "fake").otherwise("real").alias("y"), F.when(F.col("p") == 1, "fake").otherwise("real").alias("p"))
    with pytest.raises(ValueError, match="positive_label"):
        K.classification_metrics(named, "y", "p")
    assert K.classification_metrics(named, "y", "p", positive_label="fake").first().sensitivity == pytest.approx(2 / 3)
    table = [tuple(r) for r in K.confusion_matrix_frame(named, "y", "p", ["real", "fake", "none"]).collect()]
    assert table == [("real", 2, 1, 0), ("fake", 1, 2, 0), ("none", 0, 0, 0)]


def brute_auc(pos, neg):
    return np.mean([[1.0 if a > b else 0.5 if a == b else 0.0 for b in neg] for a in pos])


def test_delong(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 80)
    a, b = np.round(rng.normal(size=80) + y, 1), np.round(rng.normal(size=80) + y * 0.5, 1)
    frame = spark.createDataFrame([(int(t), float(u), float(v)) for t, u, v in zip(y, a, b, strict=True)], "y int, a double, b double")
    auc, low, high = K.roc_auc_delong_ci(frame, "y", "a")
    assert auc == pytest.approx(brute_auc(a[y == 1], a[y == 0])) and low < auc < high
    paired, apart = K.delong_roc_test(frame, "y", "a", "b"), K.delong_roc_test(frame, "y", "a", "b", other=frame)
    assert paired["paired"] and not apart["paired"] and paired["difference"] == pytest.approx(apart["difference"]) and paired["z"] != apart["z"]
    assert K.delong_roc_test(frame, "y", "a", "a")["p_value"] == 1
    with pytest.raises(ValueError):
        K.roc_auc_delong_ci(frame.filter("y = 1"), "y", "a")
    points = evaluation.roc_points(frame, "y", "a").orderBy("fpr", "tpr").toPandas()
    assert np.trapezoid([0, *points.tpr], [0, *points.fpr]) == pytest.approx(auc)
    assert {r.a: r.mid_rank for r in ordered.mid_ranks(frame, "a").collect()} == pytest.approx(dict(zip(a, pd.Series(a).rank(), strict=True)))
    assert plots.probability_distribution_data(frame.select("y", F.rand(1).alias("s")), "y", "s", 8).count() > 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        shared = rng.normal()
        for lab, sign in (("fake", 1), ("real", -1)):
            rows.append((f"{lab}_{i}", f"g{i}", lab, float(sign + rng.normal() * 0.7), float(shared)))
    return spark.createDataFrame(rows, "video string, pair_group string, y string, f0 double, f1 double").cache()


@pytest.mark.parametrize("name,options", [("random_forest", {"n_estimators": 15, "max_features": 1}), ("c50_substitute", {"n_estimators": 6}), ("svm_rbf", {"n_features": 60, "max_iter": 20}), ("logistic_regression", {})])
def test_classifiers(labelled, name, options):
    model = K.make_classifier(name, random_state=1, **options).fit(labelled, ["f0", "f1"], "y", "fake")
    made = model.transform(labelled)
    assert K.classification_metrics(made, "y", "prediction", "positive_probability", "fake").first().roc_auc > 0.85
    assert {r.prediction for r in made.collect()} == {"fake", "real"}


def test_classifier_arguments(labelled):
    for bad in (lambda: K.make_classifier("x"), lambda: K.make_classifier("svm_rbf", "other"), lambda: K.make_classifier("svm_rbf", depth=1)):
        with pytest.raises(ValueError):
            bad()
    assert list(K.make_classifiers()) == list(K.CLASSIFIER_NAMES) and K.make_classifier("random_forest").params["max_features"] == 4
    with pytest.raises(ValueError):
        K.make_classifier("logistic_regression").fit(labelled.filter("y = 'fake'"), ["f0"], "y")


def test_cross_validation_and_tuning(labelled):
    model = K.make_classifier("logistic_regression")
    rows = K.cross_validate_grouped(model, labelled, ["f0", "f1"], "y", "pair_group", n_splits=3, n_repeats=1, positive_label="fake").collect()
    assert len(rows) == 3 and all(r.roc_auc > 0.7 for r in rows)
    with pytest.warns(UserWarning, match="no groups"):
        assert K.cross_validate_grouped(model, labelled, ["f0"], "y", None, "accuracy", 2, 1, positive_label="fake", key_col="video").count() == 2
    selector = K.BorutaSelector(["f0", "f1"], n_repeats=2, n_estimators=10, max_iter=12)
    found = K.tune_selection_threshold(labelled, "y", "pair_group", ["f0", "f1"], selector, model, positive_label="fake", thresholds=[0.0, 0.5, 1.0], n_splits=3, n_repeats=2)
    assert found.best_threshold in (0.0, 0.5, 1.0) and "f0" in found.selected_columns_ and found.curve.count() == 3 and found.per_split.count() == 6
    confirmed = tuning.confirm_thresholds(found, labelled, labelled, "y", [0.5], model, "fake").collect()
    assert {r.is_chosen for r in confirmed} >= {True} and all(r.roc_auc > 0.7 for r in confirmed)
    with pytest.raises(ValueError):
        K.tune_selection_threshold(labelled, "y", None)
    top = selection.importance_top_k(labelled, "y", ["f0", "f1"], k=1, n_seeds=2, n_estimators=10).collect()
    assert top[0].feature == "f0" and top[0].top_freq == 1 and K.RepeatedStratifiedGroupKFold(4, 2).get_n_splits() == 8


def test_threshold_rules(spark):
    def curve(*rows):
        return spark.createDataFrame(rows, "threshold double, score_mean double, score_se double")

    whole = curve((0.0, 0.7, 0.02), (0.25, 0.7, 0.5), (0.5, 0.69, 0.02), (0.8, 0.6, 0.02), (1.0, None, None))
    assert tuning.select_threshold(whole, "best") == 0 and tuning.select_threshold(whole) == 0.5
    with pytest.raises(ValueError):
        tuning.select_threshold(whole, "x")
    with pytest.raises(ValueError):
        tuning.select_threshold(whole.filter("threshold = 1"))
    with pytest.warns(UserWarning):
        assert tuning.select_threshold(curve((0.3, 0.5, None))) == 0.3
    splits = spark.createDataFrame([(0, 0.5, 3, 0.8, 0.1), (0, 0.7, 2, 0.6, 0.1), (1, 0.7, 4, 0.8, 0.3), (0, 0.9, 0, None, None), (1, 0.9, 0, float("nan"), None)], "split int, threshold double, n_features int, score double, score_se double")
    made = {r.threshold: r for r in tuning.curve_of(splits).collect()}
    assert made[0.5].score_se == 0.1 and made[0.7].score_se == pytest.approx(0.1) and made[0.7].n_features_mean == 3 and made[0.9].score_mean is None and made[0.9].n_splits_scored == 0
    assert K.threshold_grid(4) == [0, 0.25, 0.5, 0.75, 1]
    with pytest.raises(ValueError):
        K.threshold_grid(0)


def test_tuning_leaves_groups_and_the_callers_selector_alone(spark, monkeypatch):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(i // 2, int(i % 2), float(i % 2 + rng.normal()), float(rng.normal())) for i in range(40)], "pair int, y int, a double, b double")
    seen = []
    monkeypatch.setattr(tuning, "threshold_sweep", lambda selector, *a, **k: seen.append(list(selector.feature_columns_)) or [{"threshold": 0.5, "n_features": 1, "features": ["a"], "score": 0.6, "score_se": 0.1}])
    mine = K.BorutaSelector(n_repeats=2, n_estimators=5, max_iter=3)
    K.tune_selection_threshold(frame, "y", "pair", selector=mine, n_splits=2, n_repeats=1, refit=False)
    assert seen == [["a", "b"]] and mine.feature_columns is None


def test_sample_entropy_counts_every_pair():
    rng = np.random.default_rng(8)
    for n in (5, 40, 700):
        for x in (rng.normal(size=n), np.round(rng.normal(size=n), 1), np.arange(n) % 7 * 1.0):
            reach = 0.2 * x.std(ddof=1)
            expected = []
            for m in (2, 3):
                views = np.array([x[i : i + m] for i in range(n - m + 1)])
                expected.append(sum(int((np.abs(views[i + 1 :] - views[i]).max(axis=1) <= reach).sum()) for i in range(len(views) - 1)))
            assert S.close_templates(x, 2, reach) == tuple(expected), n
    assert math.isnan(S.sample_entropy(np.ones(9))) and math.isnan(S.sample_entropy(np.array([1.0, 2.0])))
    x = np.array([1.0, 2.0, 1.0, 1.0, 3.0, 2.0, 2.0, 5.0])
    patterns = [tuple(sorted(range(3), key=lambda j: (x[i + j], j))) for i in range(6)]
    share = np.array([patterns.count(p) / 6 for p in set(patterns)])
    assert S.permutation_entropy(x) == pytest.approx(-(share * np.log(share)).sum() / math.log(6))


def test_long_series_are_smoothed_and_measured_in_time(spark):
    import time

    long = spark.range(80_000).select(F.lit("v").alias("video_filename"), F.col("id").alias("frame"), F.when(F.col("id") % 50 > 3, F.rand(1)).alias("AU01_r"))
    smoother = K.RollingSmoother().fit(long)
    smoother.transform(long.limit(100)).count()
    began = time.perf_counter()
    smoother.transform(long).agg(F.sum("smth_AU01_r")).first()
    assert time.perf_counter() - began < 5
    began = time.perf_counter()
    assert S.sample_entropy(np.random.default_rng(1).normal(size=20_000)) > 0
    assert time.perf_counter() - began < 20


def test_missing_values_are_refused_by_factorisation(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (0.5, 0.0)], "smth_a double, smth_b double")
    model = K.NMFDecomposer(1, random_state=1).fit(frame)
    for bad in (None, float("nan"), -1.0, float("inf")):
        odd = frame.union(spark.createDataFrame([(bad, 1.0)], frame.schema))
        with pytest.raises(Exception, match="missing, infinite or negative"):
            K.NMFDecomposer(1).fit(odd)
        with pytest.raises(Exception, match="missing, infinite or negative"):
            model.transform(odd).collect()


def test_masked_factorisation_gains_every_round():
    rng = np.random.default_rng(3)
    x, mask = rng.random((30, 8)) @ np.diag(np.arange(1, 9.0)), rng.random((30, 8)) > 0.2
    errors = []
    for rounds in (1, 2, 4, 8, 30):
        w, h = nmf.masked_nmf(x, mask, 3, rounds, 0.0, 1)
        assert (w >= 0).all() and (h >= 0).all()
        errors.append((((x - w @ h) * mask) ** 2).sum())
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False)) and errors[-1] < 0.5 * errors[0]


def test_folds_keep_groups_whole_and_labels_even(spark):
    rng = np.random.default_rng(4)
    rows = [(g, ["a", "b", None][int(rng.integers(0, 3))]) for g in range(203) for _ in range(int(rng.integers(1, 9)))]
    frame = spark.createDataFrame(rows, "g int, y string")
    folds = K.RepeatedStratifiedGroupKFold(5, 3, 1).assign(frame, "y", "g")
    assert folds.count() == 3 * 203 and folds.groupBy("repeat", "g").count().filter("count > 1").count() == 0
    counts = folds.join(frame, "g").groupBy("repeat", "fold").agg(F.count_if(F.col("y") == "a").alias("a"), F.count("*").alias("n"), F.countDistinct("g").alias("groups")).collect()
    for repeat in range(3):
        own = [r for r in counts if r.repeat == repeat]
        assert len(own) == 5 and max(r.groups for r in own) - min(r.groups for r in own) <= 1
        assert max(r.n for r in own) - min(r.n for r in own) <= 0.05 * len(rows) and max(r.a for r in own) - min(r.a for r in own) <= 0.06 * len(rows)
    again = K.RepeatedStratifiedGroupKFold(5, 3, 1).assign(frame.repartition(7), "y", "g")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, folds.collect()))
    assert sorted(map(tuple, K.RepeatedStratifiedGroupKFold(5, 1, 2).assign(frame, "y", "g").collect())) != sorted(map(tuple, folds.filter("repeat = 0").collect()))
    with pytest.raises(ValueError):
        K.RepeatedStratifiedGroupKFold(5).assign(frame.filter("g < 3"), "y", "g")


def test_stability_of_runs(spark):
    rows = [(0, "a", "Confirmed", "Confirmed", 0.9, [1.0, 3.0, 2.0]), (1, "a", "Tentative", "Confirmed", 0.5, [5.0]), (2, "a", "Rejected", "Rejected", 0.1, [])]
    rows += [(r, "b", "Rejected", "Rejected", 0.0, []) for r in range(3)]
    got = {r.feature: r for r in selection.stability_rollup(spark.createDataFrame(rows, selection.RUN_ROWS)).collect()}
    a, b = got["a"], got["b"]
    assert (a.selection_freq, a.n_confirmed, a.n_tentative, a.n_rejected, a.median_imp, a.norm_hits) == (pytest.approx(2 / 3), 1, 1, 1, 3.5, pytest.approx(0.5))
    assert (b.selection_freq, b.n_rejected, b.median_imp) == (0, 3, None)


def test_kernel_machine_separates_a_ring(spark):
    rng = np.random.default_rng(6)
    angle, far = rng.uniform(0, 2 * math.pi, 300), np.repeat([0.5, 2.0], 150)
    points = np.c_[far * np.cos(angle), far * np.sin(angle)] + rng.normal(0, 0.15, (300, 2))
    frame = spark.createDataFrame([(float(a), float(b), "out" if r > 1 else "in") for (a, b), r in zip(points, far, strict=True)], "a double, b double, y string")
    made = K.make_classifier("svm_rbf", C=1.0).fit(frame, ["a", "b"], "y", "out").transform(frame)
    assert K.classification_metrics(made, "y", "prediction", "positive_probability", "out").first().accuracy > 0.98
    y = np.where(far > 1, 1.0, -1.0)
    machine = classifiers.KernelMachine.fit(points, y, 1.0, 0.5, 1e-4)
    alpha, margin = machine.weight, machine.margin(machine.support)
    inside = np.abs(alpha) < 1 - 1e-6  # free support vectors lie on the margin, the others within it
    assert abs(alpha.sum()) < 1e-6 and np.allclose(margin[inside] * np.sign(alpha[inside]), 1, atol=1e-3) and (margin * np.sign(alpha) <= 1 + 1e-3).all()


def test_models_without_probabilities(labelled):
    class Bare:
        def fit(self, *a):
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.col("y"))

    with pytest.raises(TypeError, match="positive_probability"):
        K.evaluate_models({"bare": Bare()}, labelled, "y", "fake")
    with pytest.raises(TypeError):
        K.cross_validate_grouped(Bare(), labelled, ["f0"], "y", "pair_group", n_splits=2, n_repeats=1, positive_label="fake")

    class Halves:
        def split(self, df, label_col, group_col):
            for fold in (0, 1):
                own = F.pmod(F.xxhash64(group_col), F.lit(2)) == fold
                yield 0, fold, df.filter(~own), df.filter(own)

    rows = K.cross_validate_grouped(Bare(), labelled, ["f0"], "y", "pair_group", "accuracy", positive_label="fake", cv=Halves()).collect()
    assert [(r.fold, r.accuracy) for r in rows] == [(0, 1.0), (1, 1.0)]


def test_density_against_sums(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.random(300), "b": rng.beta(2, 5, 500), "flat": np.full(9, 0.33)}
    frame = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("a", None)], "y string, s double")
    got = plots.probability_distribution_data(frame, "y", "s", 64).collect()
    assert len(got) == 3 * 64
    for r in got:
        x = values[r.label]
        if r.label == "flat":
            assert r.density == (20 if 0.3 <= r.x < 0.35 else 0)
            continue
        width = x.std(ddof=1) * len(x) ** -0.2
        assert r.density == pytest.approx(np.exp(-(((r.x - x) / width) ** 2) / 2).sum() / (len(x) * width * math.sqrt(2 * math.pi)), rel=2e-3)


def test_command_line_jobs(spark, tmp_path):
    import json

    from kinetika import tools

    rng = np.random.default_rng(9)
    rows = [(i, i // 2, int(i % 2), float(i % 2 + rng.normal() * 0.3), float(rng.normal())) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, pair int, y int, good double, noise double")
    for name, part in (("train", frame.filter("id < 40")), ("test", frame.filter("id >= 40"))):
        part.write.parquet(str(tmp_path / name))
    common = ["--train", str(tmp_path / "train"), "--test", str(tmp_path / "test"), "--label", "y", "--key", "id", "--fast"]
    found = tools.main(["tune", *common, "--group", "pair", "--n-splits", "2", "--n-repeats", "1", "--out", str(tmp_path / "tune.json")], spark)
    assert "good" in found["features"] and found["held_out"][0]["roc_auc"] > 0.7 and json.loads((tmp_path / "tune.json").read_text())["threshold"] == found["threshold"]
    found = tools.main(["ranks", *common, "--top", "1", "--n-seeds", "2", "--out", str(tmp_path / "ranks.json")], spark)
    assert found["top"][0]["feature"] == "good" and found["sets"]["top"] == ["good"] and all(0 <= r["p_value"] <= 1 for r in found["compared"])
    with pytest.raises(SystemExit):
        tools.main(["tune", "--train", "x"], spark)


def test_probabilities_are_averaged_over_seeds(labelled):
    class Fixed:
        def __init__(self, p):
            self.p = p

        def transform(self, df):
            return df.withColumn("positive_probability", F.lit(self.p) * F.col("f0"))

    got = {r.video: r.positive_probability for r in evaluation.seed_averaged([Fixed(1.0), Fixed(3.0)], labelled, "video", ["y"]).collect()}
    assert got == {r.video: pytest.approx(2 * r.f0) for r in labelled.collect()}
    with pytest.raises(ValueError):
        evaluation.compare_feature_sets({"a": ["f0"]}, None, labelled, labelled, "y", "video")


def test_bootstrap_sizes():
    from kinetika.functions import forest

    assert [forest.draws(10, s) for s in (None, 4, 0.25, 0.01, 1.0)] == [10, 4, 2, 1, 10]
    x = np.c_[np.arange(40) % 2, np.zeros(40)]
    assert K.gini_importance(x, np.arange(40) % 2, 10, max_samples=0.5).tolist() == [1.0, 0.0]


def test_matrix_extractors(spark):
    from kinetika.operators import external

    wide = spark.createDataFrame([("v1", 1.0, 2.0, 3.0), ("v2", 4.0, 5.0, 9.0), ("v3", 0.0, 0.0, 0.0)], "video string, fr_1 double, fr_2 double, fr_3 double")
    calls = external.MatrixFeatureExtractor(lambda m: {"mean": m.mean(axis=1), "rows": np.full(len(m), float(len(m)))})
    assert {r.video: r["mean"] for r in calls.transform(wide.coalesce(1)).collect()} == {"v1": 2, "v2": 6, "v3": 0}
    assert {r.rows for r in calls.transform(wide.coalesce(1)).collect()} == {3.0}
    named = external.MatrixFeatureExtractor(lambda m: m[:, :2], ["first", "second"])
    assert {r.video: (r.first, r.second) for r in named.transform(wide).collect()}["v2"] == (4, 5)
    with pytest.raises(TypeError):
        external.as_feature_table(np.ones((2, 3)), 2, ["a"])
    with pytest.raises(ValueError):
        external.as_feature_table({"a": [1.0]}, 2)
    assert K.RFeatureExtractor("p", per_row=True).per_row and not K.RFeatureExtractor("p").per_row


def test_min_max(spark):
    out = min_max_scaled(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in out] == [(0, 0), (1, 0), (None, 0)]


def test_plots_need_matplotlib(labelled):
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="matplotlib"):
            plots.plot_roc_curves(labelled, "y", ["f0"], "fake")
    model = K.make_classifier("logistic_regression").fit(labelled, ["f0", "f1"], "y", "fake")
    assert plots.decision_boundary_data(model, labelled, "f0", "f1", 5).count() == 25
