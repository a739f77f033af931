"""What plots draw, by a stand-in for matplotlib that notes every call."""

import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

import kinetika as K
from kinetika.operators import faces, plots


class Recorder:
    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a, **k: self.calls.append((name, a, k))

    def named(self, name):
        return [(a, k) for n, a, k in self.calls if n == name]


class Figure(Recorder):
    def savefig(self, path, **k):
        with open(path, "w") as file:
            file.write("drawn")


@pytest.fixture(autouse=True)
def drawing(monkeypatch):
    pyplot = types.ModuleType("matplotlib.pyplot")
    pyplot.subplots = lambda **k: (Figure(), Recorder())
    package = types.ModuleType("matplotlib")
    package.pyplot = pyplot
    monkeypatch.setitem(sys.modules, "matplotlib", package)
    monkeypatch.setitem(sys.modules, "matplotlib.pyplot", pyplot)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.random((60, 3))
    return spark.createDataFrame([("v", i, *map(float, r), "fake" if r[0] > 0.5 else "real") for i, r in enumerate(x)], "video_filename string, frame int, smth_AU01_r double, smth_AU06_r double, smth_AU12_r double, y string").cache()


@pytest.fixture(scope="module")
def model(rows):
    return K.NMFDecomposer(2, random_state=1, max_iter=30).fit(rows)


def test_series_and_factorisations(spark, rows, model, tmp_path):
    made = rows.withColumn("smth_raw", F.col("smth_AU01_r") / 2).withColumnRenamed("smth_AU06_r", "raw")
    _, axes = plots.plot_smoothing_comparison(made, "v", "raw", "overlay")
    assert [k["label"] for _, k in axes.named("plot")] == ["raw", "smoothed"] and len(axes.named("plot")[0][0][0]) == 60
    _, axes = plots.plot_smoothing_comparison(made, "v", "raw")
    (low, _), (high, _) = axes.named("plot")[1], axes.named("plot")[0]
    assert min(high[1]) >= max(low[1]) - 1e-9
    with pytest.raises(ValueError):
        plots.plot_smoothing_comparison(made, "v", "raw", "side")
    sweep = spark.createDataFrame([(k, 0, 0, 0.0, float(k)) for k in (2, 3, 4)], "rank int, rep int, seed int, train_mse double, test_mse double")
    assert plots.plot_nmf_rank_cv(sweep)[1].named("plot")[0][0] == ([2, 3, 4], [2.0, 3.0, 4.0])
    table = spark.createDataFrame([(3, 0.5), (2, 0.9)], "rank int, cophenetic double")
    assert plots.plot_nmf_cophenetic_correlation(table)[1].named("plot")[0][0] == ([2, 3], [0.9, 0.5])
    _, axes = plots.plot_nmf_basis_heatmap(spark, model)
    assert axes.named("imshow")[0][0][0].shape == (3, 2) and axes.named("set_xticks")[0][0][1] == ["nmf1", "nmf2"]
    assert len(plots.plot_nmf_face_maps(spark, model)[1].named("barh")) == 2
    rng = np.random.default_rng(2)
    face = faces.FaceModel(rng.normal(size=(3, 136)), rng.normal(size=136), np.zeros(3))
    _, axes = plots.plot_nmf_face_maps(spark, model, face, ["AU01", "AU06", "AU12"])
    assert len(axes.named("fill")) == 2 * (len(faces.MUSCLES) + 6) and len(axes.named("plot")) == 2 * len(faces.OUTLINES)
    assert all(0 <= k["alpha"] <= 1 for _, k in axes.named("fill"))
    _, axes = plots.plot_nmf_reconstruction(model, rows, "v", "smth_AU01_r", save_path="r.png", output_dir=str(tmp_path))
    assert len(axes.named("plot")) == 2 and (tmp_path / "r.png").read_text() == "drawn"
    best, worst = plots.nmf_reconstruction_extremes_data(model, rows)
    assert {k["label"] for _, k in plots.plot_nmf_reconstruction_extremes(model, rows, "v")[1].named("plot")} == {best, worst, f"{best} reconstructed", f"{worst} reconstructed"}
    _, axes = plots.plot_nmf_reconstruction_r2_bar(model, rows)
    (places, values), _ = axes.named("barh")[0]
    assert len(places) == 3 and values == sorted(values, reverse=True)


def test_features_and_selection(spark, rows):
    features = ["smth_AU01_r", "smth_AU06_r", "smth_AU12_r"]
    assert len(plots.plot_feature_diagnostics(rows.select(*features))[1].named("barh")) == 2
    chosen = K.BorutaSelector(features, n_repeats=2, n_estimators=15, max_iter=15).fit(rows, "y")
    (places, values), options = plots.plot_boruta_importance(spark, chosen)[1].named("barh")[0]
    assert places[0] == "smth_AU01_r" and values == sorted(values, reverse=True) and options["color"][0] == "tab:green"
    (places, values), _ = plots.plot_boruta_stability(chosen, 2)[1].named("barh")[0]
    assert places[0] == "smth_AU01_r" and values[0] == 1 and len(places) == 2
    _, axes = plots.plot_feature_clusters(rows, features)
    shown = axes.named("imshow")[0][0][0]
    assert shown.shape == (3, 3) and np.allclose(np.diag(shown), 1) and np.allclose(shown, shown.T)


def test_evaluations(spark, rows):
    scored = rows.withColumn("random_forest", F.col("smth_AU01_r")).withColumn("other", F.col("smth_AU06_r"))
    lines = plots.plot_roc_curves(scored, "y", ["random_forest", "other"], "fake")[1].named("plot")
    assert [k.get("label") for _, k in lines] == ["Random Forest", "other", None] and lines[0][1]["color"] == plots.model_colour("random_forest") and lines[0][0][1][-1] == 1
    said = rows.withColumn("p", F.lit("fake"))
    _, axes = plots.plot_confusion_matrix(said, "y", "p")
    counts = rows.groupBy("y").count().orderBy("y").collect()
    assert axes.named("imshow")[0][0][0].tolist() == [[r["count"] for r in counts], [0, 0]]
    _, axes = plots.plot_probability_distributions(scored, "y", "random_forest")
    assert len(axes.named("fill_between")) == 2 and len(axes.named("fill_between")[0][0][0]) == 512 and axes.named("axvline")[0][0] == (0.5,)
    fitted = K.make_classifier("logistic_regression").fit(rows, ["smth_AU01_r", "smth_AU06_r"], "y", "fake")
    (x, y), options = plots.plot_decision_boundary(fitted, rows, "smth_AU01_r", "smth_AU06_r")[1].named("scatter")[0]
    assert len(x) == len(y) == len(options["c"]) == 40_000
    table = spark.createDataFrame([("svm_rbf", 0.5), ("mine", 0.75)], "model string, accuracy double")
    (places, values), options = plots.plot_accuracy_comparison(table)[1].named("bar")[0]
    assert places == ["SVM (RBF)", "mine"] and values == [0.5, 0.75] and options["color"] == [plots.model_colour("svm_rbf"), plots.model_colour("mine")]
    curve = spark.createDataFrame([(0.5, 0.7, None), (0.0, 0.6, 0.1)], "threshold double, score_mean double, score_se double")
    _, axes = plots.plot_threshold_sweep(types.SimpleNamespace(curve=curve))
    (places, low, high), _ = axes.named("fill_between")[0]
    assert places == [0.0, 0.5] and low == [0.5, 0.7] and high == [0.7, 0.7]
