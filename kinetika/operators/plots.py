"""Plots: each has a producer of the rows it draws (``*_data``), and draws only where matplotlib is installed.

Only bounded rows are drawn: one video, one row per feature or component, or binned points.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetika.functions import stats
from kinetika.functions.labels import humanise_au_label
from kinetika.operators import evaluation, faces
from kinetika.operators.classifiers import CLASSIFIER_LABELS, CLASSIFIER_NAMES
from kinetika.operators.cleaning import feature_diagnostics
from kinetika.operators.nmf import NMFDecomposer, nmf_reconstruction_r2_per_au
from kinetika.operators.selection import BorutaSelector, abs_correlations, boruta_feature_stats
from kinetika.sources import save_figure


def _axes(width: float = 8, height: float = 5):
    try:
        import matplotlib.pyplot as plt
    except ImportError as error:
        raise ImportError("matplotlib is needed to draw; the *_data functions give the rows without it") from error
    return plt.subplots(figsize=(width, height))


def smoothing_comparison_data(df: DataFrame, video: str, column: str, group_col: str = "video_filename", frame_col: str = "frame", prefix: str = "smth_") -> DataFrame:
    return df.filter(F.col(group_col) == video).select(frame_col, F.col(column).alias("raw"), F.col(prefix + column).alias("smoothed")).orderBy(frame_col)


def nmf_rank_cv_data(sweep: DataFrame, outlier: float = 5.0) -> DataFrame:
    """rank, median, mean, least, greatest, and is_outlier: more than ``outlier`` scaled MADs above the median of medians."""
    by_rank = sweep.groupBy("rank").agg(F.median("test_mse").alias("median_mse"), F.avg("test_mse").alias("mean_mse"), F.min("test_mse").alias("min_mse"), F.max("test_mse").alias("max_mse"))
    middle = by_rank.agg(F.median("median_mse").alias("_m"))
    spread = by_rank.crossJoin(F.broadcast(middle)).agg((1.4826 * F.median(F.abs(F.col("median_mse") - F.col("_m")))).alias("_s"), F.first("_m").alias("_m"))
    return by_rank.crossJoin(F.broadcast(spread)).withColumn("is_outlier", F.col("median_mse") > F.col("_m") + outlier * F.col("_s")).drop("_m", "_s").orderBy("rank")


def nmf_basis_data(spark: SparkSession, decomposer: NMFDecomposer) -> DataFrame:
    """component, au, label, weight scaled to 0 .. 1 within the component. This is what face maps shade muscles by."""
    h = decomposer.components_
    span = h.max(axis=1) - h.min(axis=1)
    scaled = np.where(span[:, None] > 0, (h - h.min(axis=1)[:, None]) / np.where(span > 0, span, 1)[:, None], 0.0)
    return spark.createDataFrame([(f"{decomposer.prefix}{j + 1}", c, humanise_au_label(c), float(scaled[j, i])) for j in range(len(h)) for i, c in enumerate(decomposer.columns_)], "component string, au string, label string, weight double")


def nmf_reconstruction_data(decomposer: NMFDecomposer, df: DataFrame, video: str, column: str, group_col: str = "video_filename", frame_col: str = "frame") -> DataFrame:
    made = decomposer.reconstruct(df.filter(F.col(group_col) == video))
    return made.select(frame_col, F.col(column).alias("original"), F.col(f"{column}_hat").alias("reconstructed")).orderBy(frame_col)


def nmf_reconstruction_extremes_data(decomposer: NMFDecomposer, df: DataFrame) -> tuple[str, str]:
    """The columns that are reconstructed best and worst."""
    ranked = [r.au for r in nmf_reconstruction_r2_per_au(decomposer, df).collect()]
    return ranked[0], ranked[-1]


def boruta_importance_data(spark: SparkSession, selector: BorutaSelector, run: int = 0, max_features: int | None = None) -> DataFrame:
    rows = boruta_feature_stats(spark, selector, run).na.drop(subset=["medianImp"])
    return rows.limit(max_features) if max_features else rows


def boruta_stability_data(selector: BorutaSelector, max_features: int | None = None) -> DataFrame:
    return selector.stability_.limit(max_features) if max_features else selector.stability_


def feature_cluster_data(df: DataFrame, columns: list[str]) -> DataFrame:
    """position, feature, other, abs_corr: the correlation matrix in the order of the dendrogram's leaves."""
    r = abs_correlations(df, columns)
    members = {i: [i] for i in range(len(columns))}
    for step, (a, b, _, _) in enumerate(stats.average_linkage(1 - r)):
        members[len(columns) + step] = members.pop(int(a)) + members.pop(int(b))
    order = [i for group in members.values() for i in group]
    return df.sparkSession.createDataFrame([(n, columns[i], columns[j], float(r[i, j])) for n, i in enumerate(order) for j in order], "position int, feature string, other string, abs_corr double")


def probability_distribution_data(df: DataFrame, label_col: str, score: str = "positive_probability", points: int = 512) -> DataFrame:
    """label, x, density: a Gaussian kernel estimate of the scores of each label, at ``points`` even places from 0 to 1.

    The bandwidth is Scott's. Scores are counted in 4 x ``points`` cells first, with their mean in each, so any number of rows can be drawn;
    a label without spread has its histogram instead, in 20 cells. Rows without a score are left out.
    """
    value = F.col(score).cast("double")
    known = df.select(F.col(label_col).alias("label"), value.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    cells = known.groupBy("label", F.floor(F.col("_v") * 4 * points).alias("_cell")).agg(F.count("*").alias("n"), F.avg("_v").alias("at"))
    sizes = known.groupBy("label").agg(F.count("*").alias("all"), (F.stddev_samp("_v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("width"))
    grid = df.sparkSession.range(points).select((F.col("id") / (points - 1)).alias("x"))
    spread = F.coalesce(F.col("width"), F.lit(0.0)) > 1e-12
    joined = cells.join(F.broadcast(sizes), "label").crossJoin(F.broadcast(grid))  # labels x 4 points x points rows
    z = (F.col("x") - F.col("at")) / F.col("width")
    smooth = F.col("n") * F.exp(-z * z / 2) / (F.col("all") * F.col("width") * (2 * math.pi) ** 0.5)
    same_cell = F.least(F.floor(F.col("x") * 20), F.lit(19)) == F.least(F.floor(F.col("at") * 20), F.lit(19))
    return joined.groupBy("label", "x").agg(F.sum(F.when(spread, smooth).otherwise(F.when(same_cell, F.col("n") * 20 / F.col("all")).otherwise(0.0))).alias("density"))


def decision_boundary_data(model, df: DataFrame, x: str, y: str, points: int = 200) -> DataFrame:
    """x, y, positive_probability on a grid; the other features rest at their medians."""
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(model.features) for k, f in (("lo", F.min), ("hi", F.max), ("me", F.median))]).first()
    at = {c: i for i, c in enumerate(model.features)}

    def line(c: str, name: str) -> DataFrame:
        low, high = row[f"lo{at[c]}"], row[f"hi{at[c]}"]
        return df.sparkSession.range(points).select((F.lit(float(low)) + F.col("id") * float((high - low) / max(points - 1, 1))).alias(name))

    grid = line(x, x).crossJoin(F.broadcast(line(y, y)))  # points x points
    rest = [F.lit(float(row[f"me{i}"])).alias(c) for c, i in at.items() if c not in (x, y)]
    return model.transform(grid.select(x, y, *rest)).select(x, y, "positive_probability")


#: Colours of drawn series, in order; models keep theirs in every plot.
COLOURS = ["tab:blue", "tab:orange", "tab:green", "tab:red", "tab:purple", "tab:brown", "tab:pink", "tab:gray"]


def model_colour(name: str) -> str:
    """The same colour for a classifier wherever it is drawn; others by their name."""
    return COLOURS[CLASSIFIER_NAMES.index(name) if name in CLASSIFIER_NAMES else sum(map(ord, name)) % len(COLOURS)]


def model_label(name: str) -> str:
    return CLASSIFIER_LABELS.get(name, name)


def _draw(frame, kind: str, title: str, save_path: str | None, output_dir: str | None, dpi: int, x: str, y: list[str], error: str | None = None, colours: list[str] | None = None):
    """Columns ``y`` of a pandas frame against ``x``, as lines, bars, lying bars, areas or points."""
    figure, axes = _axes()
    places = frame[x].tolist()
    for i, c in enumerate(y):
        values, colour = frame[c].tolist(), (colours or COLOURS)[i % len(colours or COLOURS)]
        if kind == "line":
            axes.plot(places, values, label=c, color=colour)
            if error:
                spread = [0.0 if v is None or v != v else v for v in frame[error].tolist()]
                axes.fill_between(places, [a - b for a, b in zip(values, spread, strict=True)], [a + b for a, b in zip(values, spread, strict=True)], color=colour, alpha=0.2)
        elif kind == "area":
            axes.fill_between(places, values, label=c, color=colour, alpha=0.5)
        elif kind == "barh":
            axes.barh([f"{p}" for p in places] if len(y) == 1 else [n + 0.8 * i / len(y) for n in range(len(places))], values, height=0.8 / len(y), label=c, color=colours if colours and len(y) == 1 else colour)
        elif kind == "bar":
            axes.bar(places, values, label=c, color=colours if colours and len(y) == 1 else colour)
        else:
            axes.scatter(places, frame[y[0]].tolist(), c=frame[y[1]].tolist())
            break
    if kind == "barh" and len(y) > 1:
        axes.set_yticks([n + 0.4 for n in range(len(places))], places)
    axes.set_title(title)
    axes.set_xlabel(x)
    if len(y) > 1 and kind != "scatter":
        axes.legend()
    save_figure(figure, save_path, output_dir, dpi)
    return figure, axes


def _image(table, title: str, save_path: str | None, output_dir: str | None, dpi: int, rows: list, columns: list, **options):
    figure, axes = _axes()
    axes.imshow(table, aspect="auto", **options)
    axes.set_xticks(range(len(columns)), columns)
    axes.set_yticks(range(len(rows)), rows)
    axes.set_title(title)
    save_figure(figure, save_path, output_dir, dpi)
    return figure, axes


def plot_smoothing_comparison(df, video, column, layout: str = "stacked", save_path=None, output_dir=None, dpi=300, **names):
    """Raw and smoothed values of one series: over each other, or ``stacked`` with each in a half of its own."""
    if layout not in ("stacked", "overlay"):
        raise ValueError("layout must be 'stacked' or 'overlay'")
    rows = smoothing_comparison_data(df, video, column, **names).toPandas()
    if layout == "stacked":
        rows["raw"] = rows["raw"] + (rows["smoothed"].max() - rows["raw"].min())
    return _draw(rows, "line", str(video), save_path, output_dir, dpi, names.get("frame_col", "frame"), ["raw", "smoothed"])


def plot_nmf_rank_cv(sweep, save_path=None, output_dir=None, dpi=300):
    return _draw(nmf_rank_cv_data(sweep).toPandas(), "line", "Held-out error by rank", save_path, output_dir, dpi, "rank", ["median_mse", "mean_mse"])


def plot_nmf_cophenetic_correlation(table, save_path=None, output_dir=None, dpi=300):
    return _draw(table.orderBy("rank").toPandas(), "line", "Cophenetic correlation by rank", save_path, output_dir, dpi, "rank", ["cophenetic"])


def plot_nmf_basis_heatmap(spark, decomposer, save_path=None, output_dir=None, dpi=300):
    table = nmf_basis_data(spark, decomposer).toPandas().pivot(index="label", columns="component", values="weight")
    return _image(table.to_numpy(), "Weights by component", save_path, output_dir, dpi, list(table.index), list(table.columns))


def plot_nmf_face_maps(spark, decomposer, model=None, units=None, save_path=None, output_dir=None, dpi=300):
    """A face for each component, its muscles shaded by weight; without a face ``model``, a bar per action unit and component."""
    if model is None:
        table = nmf_basis_data(spark, decomposer).toPandas().pivot(index="label", columns="component", values="weight")
        return _draw(table.reset_index(), "barh", "Muscle weights by component", save_path, output_dir, dpi, "label", list(table.columns))
    rows = faces.face_map_data(spark, decomposer, model, units).collect()
    figure, axes = _axes()
    for r in rows:
        column = int(r.component.removeprefix(decomposer.prefix)) - 1
        corners = np.array([(c.x + 200 * column, -c.y) for c in r.corners])
        axes.fill(corners[:, 0], corners[:, 1], color="firebrick", alpha=min(max(r.shade or 0.0, 0.0), 1.0))
    for j, weights in enumerate(decomposer.components_):
        shade = {faces.extract_au_code(c): w / max(weights.max(), 1e-12) for c, w in zip(decomposer.columns_, weights, strict=True)}
        for line in faces.outline_paths(model.predict(np.array([shade.get(faces.extract_au_code(u) or u, 0.0) for u in units]))[0]).values():
            axes.plot(line[:, 0] + 200 * j, -line[:, 1], color="black", linewidth=0.8)
    save_figure(figure, save_path, output_dir, dpi)
    return figure, axes


def plot_nmf_reconstruction(decomposer, df, video, column, save_path=None, output_dir=None, dpi=300, group_col="video_filename", frame_col="frame"):
    rows = nmf_reconstruction_data(decomposer, df, video, column, group_col, frame_col).toPandas()
    return _draw(rows, "line", f"{video}: {column}", save_path, output_dir, dpi, frame_col, ["original", "reconstructed"])


def plot_nmf_reconstruction_extremes(decomposer, df, video, save_path=None, output_dir=None, dpi=300, group_col="video_filename", frame_col="frame"):
    """The columns that are reconstructed best and worst, in one plot."""
    best, worst = nmf_reconstruction_extremes_data(decomposer, df)
    rows = None
    for c in dict.fromkeys((best, worst)):
        part = nmf_reconstruction_data(decomposer, df, video, c, group_col, frame_col).toPandas().rename(columns={"original": c, "reconstructed": f"{c} reconstructed"})
        rows = part if rows is None else rows.merge(part, on=frame_col)
    return _draw(rows, "line", f"{video}: best and worst", save_path, output_dir, dpi, frame_col, [c for c in rows.columns if c != frame_col])


def plot_nmf_reconstruction_r2_bar(decomposer, df, save_path=None, output_dir=None, dpi=300):
    return _draw(nmf_reconstruction_r2_per_au(decomposer, df).toPandas(), "barh", "Share of variance reconstructed", save_path, output_dir, dpi, "au", ["r2"])


def plot_feature_diagnostics(df, save_path=None, output_dir=None, dpi=300):
    return _draw(feature_diagnostics(df).toPandas(), "barh", "Share of missing values", save_path, output_dir, dpi, "feature", ["pct_nan", "pct_inf"])


def plot_boruta_importance(spark, selector, run=0, max_features=None, save_path=None, output_dir=None, dpi=300):
    rows = boruta_importance_data(spark, selector, run, max_features).toPandas()
    colours = ["tab:green" if d == "Confirmed" else "tab:red" if d == "Rejected" else "tab:orange" for d in rows["decision"]]
    return _draw(rows, "barh", "Importance", save_path, output_dir, dpi, "feature", ["medianImp"], colours=colours)


def plot_boruta_stability(selector, max_features=None, save_path=None, output_dir=None, dpi=300):
    return _draw(boruta_stability_data(selector, max_features).toPandas(), "barh", "Selection frequency", save_path, output_dir, dpi, "feature", ["selection_freq"])


def plot_feature_clusters(df, columns, save_path=None, output_dir=None, dpi=300):
    rows = feature_cluster_data(df, columns).toPandas()
    order = rows.drop_duplicates("position").sort_values("position")["feature"].tolist()
    table = rows.pivot(index="feature", columns="other", values="abs_corr").loc[order, order]
    return _image(table.to_numpy(), "Correlated features", save_path, output_dir, dpi, order, order, vmin=0, vmax=1)


def plot_roc_curves(df, truth, scores, positive_label=None, save_path=None, output_dir=None, dpi=300):
    """ROC curves of score columns; a column named like a classifier is drawn in its colour and by its label."""
    figure, axes = _axes(6, 6)
    for s in scores:
        points = evaluation.roc_points(df, truth, s, positive_label).orderBy("fpr", "tpr").toPandas()
        axes.plot([0, *points.fpr], [0, *points.tpr], label=model_label(s), color=model_colour(s))
    axes.plot([0, 1], [0, 1], color="gray", linestyle=":")
    axes.legend()
    save_figure(figure, save_path, output_dir, dpi)
    return figure, axes


def plot_confusion_matrix(df, truth, prediction, save_path=None, output_dir=None, dpi=300):
    table = evaluation.confusion_matrix_frame(df, truth, prediction).toPandas().set_index("prediction")
    return _image(table.to_numpy(), "Predicted by true label", save_path, output_dir, dpi, list(table.index), list(table.columns))


def plot_probability_distributions(df, label_col, score="positive_probability", threshold=0.5, save_path=None, output_dir=None, dpi=300):
    table = probability_distribution_data(df, label_col, score).toPandas().pivot(index="x", columns="label", values="density").fillna(0)
    table.columns = [str(c) for c in table.columns]
    figure, axes = _draw(table.reset_index(), "area", "Probability by label", None, None, dpi, "x", list(table.columns))
    axes.axvline(threshold, linestyle=":", color="black")
    save_figure(figure, save_path, output_dir, dpi)
    return figure, axes


def plot_decision_boundary(model, df, x, y, save_path=None, output_dir=None, dpi=300):
    return _draw(decision_boundary_data(model, df, x, y).toPandas(), "scatter", "Decision boundary", save_path, output_dir, dpi, x, [y, "positive_probability"])


def plot_accuracy_comparison(table, save_path=None, output_dir=None, dpi=300):
    rows = table.toPandas()
    colours, rows["model"] = [model_colour(m) for m in rows["model"]], [model_label(m) for m in rows["model"]]
    return _draw(rows, "bar", "Accuracy", save_path, output_dir, dpi, "model", ["accuracy"], colours=colours)


def plot_threshold_sweep(result, save_path=None, output_dir=None, dpi=300):
    return _draw(result.curve.orderBy("threshold").toPandas(), "line", "Score by threshold", save_path, output_dir, dpi, "threshold", ["score_mean"], error="score_se")
