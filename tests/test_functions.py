import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetika.functions import forest, stats
from kinetika.functions import series as S
from kinetika.functions.labels import au_code, au_label, extract_au_code, humanise_au_label, humanise_au_labels, pair_key


def test_au_labels(spark):

    assert extract_au_code("smth_au12_r") == "AU12" and extract_au_code("x") is None
    assert humanise_au_label("AU12_r") == "AU12 - Lip Corner Puller" and humanise_au_label("AU99_r") == "AU99_r"
    assert humanise_au_labels(["a", "AU45"]) == ["a", "AU45 - Blink"]
    names = ["smth_au12_r", "AU99_r", "none", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", au_code(F.col("n")).alias("c"), au_label(F.col("n")).alias("l")).collect()
    for r in rows:
        if r.n is not None:
            assert (r.c, r.l) == (extract_au_code(r.n), humanise_au_label(r.n))


def test_pair_key(spark):

    rows = spark.createDataFrame([("20__exit_room", "real"), ("20_21__exit_room__HASH", "fake"), ("plain", "fake")], "n string, l string")
    assert [r[0] for r in rows.select(pair_key(F.col("n"), F.col("l"))).collect()] == ["20__exit_room", "20__exit_room", "plain"]


def test_exact_intervals():
    low, high = stats.clopper_pearson(64, 94)
    assert (round(low, 5), round(high, 5)) == (0.57669, 0.77326)
    assert stats.binomial_sf(63, 94, 0.5) == pytest.approx(2.9395e-4, rel=1e-3)
    assert stats.clopper_pearson(0, 5)[0] == 0 and stats.clopper_pearson(5, 5)[1] == 1
    assert stats.binomial_cdf(3, 3, 0.2) == 1 and stats.binomial_sf(5, 5, 0.5) == 0


def test_linkage():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], float)
    merges = stats.average_linkage(d)
    assert merges[:, 2].tolist() == [1, 2, 4.5]
    assert stats.cut(merges, 4, 2.5).tolist() == [1, 1, 2, 2]
    assert stats.cophenetic(merges, 4)[0, 3] == 4.5


def test_features_of_simple_series():
    ramp = S.extract_features(np.arange(20.0))
    assert ramp["trend_slope"] == pytest.approx(1) and ramp["trend_r2"] == pytest.approx(1) and ramp["permutation_entropy"] == 0 and ramp["peak_rate"] == 0
    square = S.extract_features(np.tile([1.0] * 5 + [0.0] * 5, 6))
    assert square["n_episodes"] == 6 and square["max_episode_len"] == pytest.approx(5 / 60) and square["mean_onset_slope"] == 1 and square["mean_offset_slope"] == -1
    assert square["mean_crossings"] == pytest.approx(11 / 60) and square["longest_run_above_mean"] == pytest.approx(5 / 60)
    flat = S.extract_features(np.full(120, 0.5))
    assert flat["prop_active"] == 0 and flat["n_episodes"] == 0 and flat["peak_rate"] == 0 and math.isnan(flat["mean_onset_slope"]) and math.isnan(flat["acf1"]) and math.isnan(flat["spectral_entropy"])
    one = S.extract_features([3.0])
    assert math.isnan(one["sd"]) and math.isnan(one["prop_active"]) and one["length"] == 1
    assert S.extract_features([1, 2, 2, 1, 3, 1])["peak_rate"] == pytest.approx(2 / 6)
    wave = S.extract_features(np.sin(np.arange(400) * 2 * np.pi * 8 / 400))
    assert wave["spectral_entropy"] < 0.01 and wave["pacf1"] == wave["acf1"]
    assert 0.9 < S.extract_features(np.random.default_rng(1).normal(size=200))["spectral_entropy"] <= 1
    with pytest.raises(ValueError):
        S.extract_features([1, float("nan")])
    with pytest.raises(ValueError):
        S.extract_features([1, 2], "mode")
    assert S.extract_features([1, 2, 3, 9], "median")["prop_active"] == 0.5 and S.extract_features([1, 2, 3], 2.5)["prop_active"] == pytest.approx(1 / 3)


def test_constancy_is_a_tolerance():
    assert S.is_constant(np.array([])) and S.is_constant(np.array([1, 1 + 1e-9])) and not S.is_constant(np.array([1, 1.001])) and not S.is_constant(np.array([1, np.nan]))


@pytest.mark.parametrize("kind", ["permutation", "gini"])
def test_forest_finds_the_informative_column(kind):
    x = np.random.default_rng(0).normal(size=(120, 4))
    found = forest.importance(x, x[:, 2] > 0, trees=40, seed=1, kind=kind)
    assert found.argmax() == 2 and (found == forest.importance(x, x[:, 2] > 0, trees=40, seed=1, kind=kind)).all()


def test_written_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from kinetika import session

    before = spark.conf.get(session._CLEANUP, "false")
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: session.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), f"t{i}"), range(8)))
    assert spark.conf.get(session._CLEANUP, "false") == before and not session._writers and all(t.count() == 7 for t in made)
    files = made[0].inputFiles()
    session.discard(made[0])
    import os

    assert files and not os.path.exists(files[0].removeprefix("file://")) and made[1].count() == 7
    assert session.unused(spark.createDataFrame([(1, 2)], "_id int, __ID int"), "id", "hash", "id") == ["___id", "_hash", "____id"]


def test_only_a_local_master_has_a_folder_of_its_own(spark, monkeypatch):
    from kinetika import session

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "other"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)
    assert session.shared_folder(spark)


def test_texts_go_to_python_in_small_batches_unless_the_session_says_otherwise(spark):
    from kinetika import session

    before = spark.conf.get(session._BATCH, "10000")
    try:
        for setting, expected in (("10000", str(session.TEXT_ROWS)), ("77", "77")):
            spark.conf.set(session._BATCH, setting)
            session.text_batches(spark)
            assert spark.conf.get(session._BATCH) == expected
    finally:
        spark.conf.set(session._BATCH, before)
