import base64
import gzip
import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import kinetika as K
from kinetika import persistence
from kinetika.operators import faces
from kinetika.operators.cleaning import IterativeForestImputer
from tests.test_plans import frames


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.random((60, 4))
    return spark.createDataFrame([(f"v{i}", *map(float, r), "fake" if r[0] + r[1] > 1 else "real") for i, r in enumerate(x)], "video string, smth_a double, smth_b double, smth_c double, smth_d double, y string").cache()


def same(a, b):
    assert a.columns == b.columns
    left, right = (sorted(map(tuple, d.collect()), key=str) for d in (a, b))
    assert len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        assert all(u == pytest.approx(v) if isinstance(u, float) else u == v for u, v in zip(x, y, strict=True))


def kept(spark, tmp_path, value, name="o"):
    folder = f"file://{tmp_path}/{name}"
    K.save(value, folder, spark)
    return K.load(folder, spark)


def test_transformers_come_back(spark, rows, tmp_path):
    features = ["smth_a", "smth_b", "smth_c", "smth_d"]
    gaps = rows.withColumn("smth_c", F.when(F.col("smth_c") > 0.3, F.col("smth_c")))
    for i, fitted in enumerate([
        K.ZScoreShiftNormalizer().fit(rows), K.NMFDecomposer(2, random_state=1, max_iter=30).fit(rows), K.FeatureCleaner(features, impute="median").fit(gaps),
        K.FeatureCleaner(features, impute=False, drop_columns=["smth_d"]).fit(rows), IterativeForestImputer(features, trees=5, rounds=2).fit(gaps),
    ]):
        same(fitted.transform(gaps if i in (2, 4) else rows), kept(spark, tmp_path, fitted, f"t{i}").transform(gaps if i in (2, 4) else rows))
    model = K.NMFDecomposer(2, random_state=1, max_iter=30).fit(rows)
    chosen = K.RepresentativeAUSelector(model).fit(rows)
    again = kept(spark, tmp_path, chosen, "r")
    assert again.selected_columns_ == chosen.selected_columns_ and (again.decomposer.components_ == model.components_).all()


@pytest.mark.parametrize("name,options", [("random_forest", {"n_estimators": 5}), ("c50_substitute", {"n_estimators": 3}), ("svm_rbf", {}), ("logistic_regression", {})])
def test_classifiers_come_back(spark, rows, tmp_path, name, options):
    model = K.make_classifier(name, random_state=1, **options).fit(rows, ["smth_a", "smth_b"], "y", "fake")
    same(model.transform(rows), kept(spark, tmp_path, model).transform(rows))


def test_wave_machine_comes_back(spark, rows, tmp_path, monkeypatch):
    from kinetika.operators import classifiers

    monkeypatch.setattr(classifiers, "MOST_KERNEL_ROWS", 10)
    model = K.make_classifier("svm_rbf", n_features=20, max_iter=5).fit(rows, ["smth_a", "smth_b"], "y", "fake")
    same(model.transform(rows), kept(spark, tmp_path, model).transform(rows))


def test_selector_comes_back(spark, rows, tmp_path):
    fitted = K.BorutaSelector(["smth_a", "smth_b", "smth_c"], n_repeats=2, n_estimators=5, max_iter=5).fit(rows, "y")
    again = kept(spark, tmp_path, fitted)
    assert again.selected_columns_ == fitted.selected_columns_ and again.runs_[1].decisions == fitted.runs_[1].decisions
    assert (again.runs_[0].history == fitted.runs_[0].history).all()
    same(again.transform(rows), fitted.transform(rows))
    same(again.stability_, fitted.stability_)
    mine = K.BorutaSelector(importance=lambda x, y, s: x.mean(axis=0))
    with pytest.raises(TypeError, match="can't be saved"):
        K.save(mine, f"file://{tmp_path}/f", spark)


def test_whole_plan_comes_back(spark, tmp_path):
    data = frames(spark, pairs=6, length=20)
    plan = K.DynamicsPipeline(n_components=2).fit(data)
    same(kept(spark, tmp_path, plan).transform(data), plan.transform(data))
    found = persistence.saved_versions(spark, [f"file://{tmp_path}/o"]).first()
    assert found.version == 1 and found["class"] == "kinetika.plans:DynamicsPipeline"


def test_values_versions_and_foreign_classes(spark, tmp_path):
    value = {"a": (1, 2.5, None, True, "x"), 3: [math.inf, np.arange(4.0).reshape(2, 2), np.array(["p", "q"], object)]}
    again = kept(spark, tmp_path, value)
    assert again["a"] == value["a"] and again[3][0] == math.inf and (again[3][1] == value[3][1]).all() and again[3][2].tolist() == ["p", "q"]
    assert math.isnan(kept(spark, tmp_path, [float("nan")], "n")[0])
    with pytest.raises(Exception, match="exists"):
        K.save(value, f"file://{tmp_path}/o", spark)
    for name, text in (("later", {"version": 99, "value": 1}), ("foreign", {"version": 1, "value": {"object": "os:system", "state": []}})):
        spark.createDataFrame([(0, json.dumps(text))], "i int, part string").write.parquet(f"file://{tmp_path}/{name}/state")
        with pytest.raises(ValueError):
            K.load(f"file://{tmp_path}/{name}", spark)


def test_face_model(spark, rows, tmp_path):
    rng = np.random.default_rng(2)
    coef, intercept, mean = rng.normal(size=(4, 136)).astype(np.float32), rng.normal(size=136), rng.random(4)
    held = io.BytesIO()
    np.savez(held, coef=coef, intercept=intercept, x_mean=mean)
    (tmp_path / "face.npz").write_bytes(held.getvalue())
    packed = base64.b64encode(gzip.compress(held.getvalue())).decode()
    units = ["smth_a", "smth_b", "smth_c", "smth_d"]
    for model in (K.load_face_model(str(tmp_path / "face.npz")), K.load_face_model(packed)):
        out = model.landmarks(rows.withColumn("landmark_x", F.lit(1)).withColumn("smth_d", F.lit(None).cast("double")), units).collect()
        for r in out:
            expected = (np.array([r.smth_a, r.smth_b, r.smth_c, mean[3]]) - mean) @ coef + intercept
            assert np.allclose(r.landmark_x, expected[:68], atol=1e-6) and np.allclose(r.landmark_y, expected[68:], atol=1e-6)
    with pytest.raises(ValueError):
        model.landmarks(rows, units[:2])
    face = np.concatenate([np.arange(68.0), np.arange(68.0) * 2])
    lines = faces.outline_paths(face)
    assert len(lines["jaw"]) == 17 and (lines["left_eye"][0] == lines["left_eye"][-1]).all() and sum(len(v) for v in lines.values()) == 68 + len(faces.CLOSED)
    regions = faces.muscle_regions(face)
    assert regions["mentalis_l"][0] == "AU15" and regions["mentalis_l"][1].tolist() == [[58, 116], [7, 14], [8, 16]] and len(regions) == len(faces.MUSCLES) + 6
    named = rows.select(*[F.col(c).alias(f"smth_AU{n}_r") for c, n in zip(units, ("01", "06", "12", "45"), strict=True)])
    decomposer = K.NMFDecomposer(2, random_state=1, max_iter=20).fit(named)
    data = faces.face_map_data(spark, decomposer, model, ["AU01", "AU06", "AU12", "AU45"])
    assert data.count() == 2 * len(regions) and data.filter("au = 'AU04' AND shade IS NOT NULL").count() == 0 and data.groupBy("component").agg(F.max("shade")).filter("`max(shade)` = 1").count() == 2
