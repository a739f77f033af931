import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import kinetika as K
from kinetika import sources
from kinetika.streaming import windowed_features


def frames(spark, pairs=16, length=30):
    rng = random.Random(1)
    rows = []
    for i in range(pairs):
        for kind, other, size in (("real", "fake", 0.5), ("fake", "real", 1.4)):
            phase = [rng.random() * 6 for _ in range(4)]
            rows += [(f"{kind}_{i}", f"{other}_{i}", kind, f, *(abs(1 + size * math.sin(f / 6 + p) + rng.gauss(0, 0.15)) for p in phase)) for f in range(length)]
    return spark.createDataFrame(rows, "video_filename string, corresponding_video string, isfakeorreal string, frame int, AU01_r double, AU06_r double, AU12_r double, AU17_r double")


def test_end_to_end(spark):
    train, test = K.paired_train_test_split(frames(spark), 0.75, 1)
    plan = K.DynamicsPipeline(n_components=2).fit(train)
    state = dict(plan.normalizer_.means_)
    made, held = plan.transform(train).cache(), plan.transform(test).cache()
    assert plan.normalizer_.means_ == state and made.columns == held.columns and made.count() == 24 and held.count() == 8
    model = K.make_classifier("logistic_regression").fit(made, ["sd_" + c for c in plan.representatives_.selected_columns_], "isfakeorreal", "fake")
    assert K.classification_metrics(model.transform(held), "isfakeorreal", "prediction", None, "fake").first().accuracy >= 0.75


def test_streaming_matches_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "user int, at string, value double").select("user", F.to_timestamp("at").alias("ts"), "value")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = windowed_features(stream, "user", "ts", "value").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        query.processAllAvailable()
        got = sorted(map(tuple, spark.sql("select * from windows").collect()), key=str)
    finally:
        query.stop()
    assert got == sorted(map(tuple, windowed_features(frame, "user", "ts", "value").collect()), key=str)


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("video_filename,corresponding_video,isfakeorreal,frame,a\nv,w,real,1,inf\nv,w,real,2,\n")
    frame = sources.read_table(spark, str(tmp_path / "t.csv"), "csv", sources.frame_schema(["a"]))
    assert [r.a for r in frame.orderBy("frame").collect()] == [math.inf, None]
    for kind in ("parquet", "orc", "json", "csv"):
        sources.write_table(frame.na.fill(0.0), str(tmp_path / kind), kind)
        assert sources.read_table(spark, str(tmp_path / kind), kind, frame.schema if kind != "csv" else sources.frame_schema(["a"])).count() == 2
    sources.write_json_summary({"a": 1}, str(tmp_path / "x/y.json"))
    assert '"a": 1' in (tmp_path / "x/y.json").read_text()
    sources.save_figure(None, None)


def test_queries_match_sql(spark):
    from kinetika.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")

    def rows(cells):
        return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in cells)

    slow = {"cross_validated_rule", "evaluated_rules", "threshold_scores", "nmf_facts"}
    for name in sorted(set(SQL) - slow):
        made = QUERIES[name](spark, folder)
        columns = sorted(made.columns)
        expected = con.sql(SQL[name])
        assert columns == sorted(expected.columns), name
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert rows(made.select(columns).collect()) == rows(con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()), name


def test_values_equal_to_the_mean_match_sql(spark, tmp_path):
    """Whether these values lie above the mean depends on its last bit, and so on the order in which it is summed."""
    from kinetika.queries import QUERIES, SQL

    series = [
        [77.35, 169.59, 126.61, 51.63, 153.54, 49.46, 113.22, 50.11, 154.52, 61.32, 151.47, 199.82],
        [48.43, 7.83, 27.58, 166.74, 74.73, 87.47, 79.21, 110.13, 63.14, 78.77, 54.55, 6.83, 86.64, 32.24, 26.54, 59.41],
    ]
    rows = [(100 * u + i, u, v) for u, x in enumerate(series) for i, v in enumerate(x)]
    spark.createDataFrame(rows[::-1], "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("features_activation", "features_trend", "features_of_arrays", "features_all"):
        made = QUERIES[name](spark, str(tmp_path)).orderBy("user_id")
        quoted = ", ".join(f'"{c}"' for c in made.columns)
        expected = con.sql(f"SELECT {quoted} FROM ({SQL[name]}) ORDER BY user_id").fetchall()
        for r, e in zip(made.collect(), expected, strict=True):
            assert tuple(r) == pytest.approx(e, abs=1e-9), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["kinetika", "kinetika.plans"])
def test_library_does_not_import_the_text_operators(name):
    import subprocess
    import sys

    code = f"import sys, {name}; assert not any(m.startswith('kinetika.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
