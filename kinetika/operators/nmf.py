"""Non-negative matrix factorisation X ~ W H, rows distributed, H (components x columns) small.

Every iteration solves the rows of W exactly for the current H where the rows lie, and sends home only W'X and W'W, k(p + k)
numbers; H is then updated on the driver. X is never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetika.functions import stats
from kinetika.functions.columns import by_pattern
from kinetika.session import materialize

#: Sweeps that fit many small factorisations take the matrix whole into each task; a larger one must be sampled first, or use ALS.
MOST_LOCAL_VALUES = 4_000_000
_EPS = 1e-10


def solve_rows(x: np.ndarray, h: np.ndarray, sweeps: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Non-negative least squares of every row of ``x`` on ``h``, by coordinate descent over all rows at once."""
    gram, right = h @ h.T, x @ h.T
    w = np.maximum(right / (np.diag(gram).max() + _EPS), 0)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(h)):
            if gram[j, j] <= _EPS:
                w[:, j] = 0
                continue
            new = np.maximum(w[:, j] + (right[:, j] - w @ gram[:, j]) / gram[j, j], 0)
            moved = max(moved, float(np.abs(new - w[:, j]).max(initial=0)))
            w[:, j] = new
        if moved <= tol * (1 + float(w.max(initial=0))):
            break
    return w


def _values(columns: list[str]) -> Column:
    """The columns as one array of doubles; a missing, infinite or negative value is an error when the row is read."""

    def checked(name: str) -> Column:
        value = F.col(name).cast("double")
        known = value.isNotNull() & ~F.isnan(value) & (value < float("inf")) & (value >= 0)
        return F.when(known, value).otherwise(F.raise_error(F.lit(f"column {name!r} has values that are missing, infinite or negative")).cast("double"))

    return F.array(*[checked(c) for c in columns])


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return _flat(batch.column("x"))


def _sums(rows: DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """W'X, W'W and the squared error, for the best W."""
    k, p = h.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * p + k * k + 1)
        for batch in batches:
            x = _matrix(batch)
            w = solve_rows(x, h)
            total += np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel(), [((x - w @ h) ** 2).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    flat = np.zeros(k * p + k * k + 1)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r.i] = r.v
    return flat[: k * p].reshape(k, p), flat[k * p : -1].reshape(k, k), float(flat[-1])


class NMFDecomposer:
    """``fit`` learns H; ``transform`` replaces the source columns by ``nmf1`` .. ``nmfk``, the non-negative least squares on H."""

    def __init__(self, n_components: int = 3, columns: list[str] | None = None, column_pattern: str = "^smth_", prefix: str = "nmf", random_state: int | None = None, max_iter: int = 750, tol: float = 1e-6) -> None:
        self.n_components, self.columns, self.column_pattern, self.prefix, self.random_state, self.max_iter, self.tol = n_components, columns, column_pattern, prefix, random_state, max_iter, tol

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(_values(self.columns_).alias("x"))

    def _start(self, rows: DataFrame, p: int) -> np.ndarray:
        """Non-negative double SVD: right vectors from the p x p Gram matrix, signs by the larger half."""
        k = min(self.n_components, p)

        def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, s = np.zeros((p, p)), 0, 0.0
            for batch in batches:
                x = _matrix(batch)
                total += x.T @ x
                n, s = n + x.size, s + float(x.sum())
            flat = np.append(total.ravel(), [n, s])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

        flat = np.zeros(p * p + 2)
        for r in rows.mapInArrow(gram, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r.i] = r.v
        if not flat[-2]:
            raise ValueError("no rows to factorise")
        values, vectors = np.linalg.eigh(flat[:-2].reshape(p, p))
        order = np.argsort(values)[::-1][:k]
        v, fill = vectors[:, order].T, max(flat[-1] / flat[-2], _EPS)
        halves = rows.select(*[F.sum(F.pow(F.greatest(F.lit(sign) * sum(F.get("x", F.lit(i)) * float(v[j, i]) for i in range(p)), F.lit(0.0)), F.lit(2))).alias(f"{'p' if sign > 0 else 'n'}{j}") for j in range(k) for sign in (1.0, -1.0)]).first()
        h = np.empty((self.n_components, p))
        rng = np.random.default_rng(self.random_state)
        for j in range(self.n_components):
            if j >= k:
                h[j] = rng.random(p) * fill
                continue
            plus, minus = np.maximum(v[j], 0), np.maximum(-v[j], 0)
            up, down = np.linalg.norm(plus) * math.sqrt(halves[f"p{j}"]), np.linalg.norm(minus) * math.sqrt(halves[f"n{j}"])
            part, weight = (plus, up) if up >= down else (minus, down)
            h[j] = math.sqrt(max(weight, 0.0)) * part / max(np.linalg.norm(part), _EPS) / max(flat[-2] / p, 1) ** 0.25
            h[j][h[j] < _EPS] = fill * 0.1
        return h

    def fit(self, df: DataFrame) -> NMFDecomposer:
        self.columns_ = by_pattern(df, self.columns, self.column_pattern)
        rows = self._rows(df).cache()
        try:
            h, before = self._start(rows, len(self.columns_)), None
            for self.n_iter_ in range(1, self.max_iter + 1):
                wx, ww, error = _sums(rows, h)
                if before is not None and before - error <= self.tol * max(before, _EPS):
                    break
                before = error
                for _ in range(20):
                    for j in range(len(h)):
                        h[j] = np.maximum(h[j] + (wx[j] - ww[j] @ h) / max(ww[j, j], _EPS), _EPS)
        finally:
            rows.unpersist()
        self.components_, self.reconstruction_error_ = h, math.sqrt(max(error, 0.0))
        return self

    def weights(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_w``, the weights of every row as an array."""
        h = self.components_

        @F.arrow_udf("array<double>")
        def solve(x: pa.Array) -> pa.Array:
            w = solve_rows(_flat(x), h)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))

        return df.withColumn("_w", solve(_values(self.columns_)))

    def transform(self, df: DataFrame) -> DataFrame:
        if not hasattr(self, "components_"):
            raise ValueError("fit the decomposer first")
        kept = [c for c in df.columns if c not in self.columns_]
        return self.weights(df).select(*kept, *[F.get("_w", F.lit(j)).alias(f"{self.prefix}{j + 1}") for j in range(self.n_components)])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def reconstruct(self, df: DataFrame) -> DataFrame:
        """The other columns, and for each source column its value and ``{c}_hat``."""
        h, w = self.components_, self.weights(df)
        hats = [sum(F.get("_w", F.lit(j)) * float(h[j, i]) for j in range(len(h))).alias(f"{c}_hat") for i, c in enumerate(self.columns_)]
        return w.select(*df.columns, *hats)


def nmf_reconstruction_error(decomposer: NMFDecomposer, df: DataFrame) -> DataFrame:
    """metric, value: RMSE, NRMSE (of the range), MAE and R2 (against the mean of the whole matrix). One pass."""
    made = decomposer.reconstruct(df)
    pairs = F.explode(F.array(*[F.struct(F.col(c).cast("double").alias("x"), F.col(f"{c}_hat").alias("y")) for c in decomposer.columns_])).alias("p")
    e = F.col("p.x") - F.col("p.y")
    s = made.select(pairs).agg(F.sum(e * e).alias("sq"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.min("p.x").alias("lo"), F.max("p.x").alias("hi"), (F.var_pop("p.x") * F.count("*")).alias("all"))
    parts = {"RMSE": F.sqrt("mse"), "NRMSE": F.try_divide(F.sqrt("mse"), F.col("hi") - F.col("lo")), "MAE": F.col("mae"), "R2": 1 - F.try_divide(F.col("sq"), F.col("all"))}
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in parts.items()])).alias("m")).select("m.*")


def nmf_reconstruction_r2_per_au(decomposer: NMFDecomposer, df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """au, r2 from the best: each column against its own mean."""
    made, sums = decomposer.reconstruct(df), []
    for i, c in enumerate(decomposer.columns_):
        e = F.col(c).cast("double") - F.col(f"{c}_hat")
        sums.append((1 - F.try_divide(F.sum(e * e), F.var_pop(F.col(c).cast("double")) * F.count("*"))).alias(f"r{i}"))
    row = made.agg(*sums)
    parts = [F.struct(F.lit((labels or {}).get(c, c)).alias("au"), F.col(f"r{i}").alias("r2")) for i, c in enumerate(decomposer.columns_)]
    return row.select(F.explode(F.array(*parts)).alias("m")).select("m.*").orderBy(F.col("r2").desc_nulls_last(), "au")


def nmf_rank_mse_sweep(df: DataFrame, ranks=range(2, 11), columns: list[str] | None = None, column_pattern: str = "^smth_", random_state: int | None = None, max_iter: int = 200, tol: float = 1e-5) -> DataFrame:
    """rank, mse of a fit to all rows for each rank."""
    names, rows = by_pattern(df, columns, column_pattern), []
    cached = df.select(*names).cache()
    n = cached.count() * len(names)
    for rank in ranks:
        model = NMFDecomposer(rank, names, random_state=random_state, max_iter=max_iter, tol=tol).fit(cached)
        rows.append((int(rank), model.reconstruction_error_**2 / n))
    cached.unpersist()
    return df.sparkSession.createDataFrame(rows, "rank int, mse double")


def masked_nmf(x: np.ndarray, mask: np.ndarray, k: int, max_iter: int = 500, tol: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A non-negative factorisation of the entries that ``mask`` shows, by coordinate descent.

    One component after another is solved exactly for what the others leave over, its columns of W and then its row of H; the leftovers are
    kept up to date. It ends when a round gains less than ``tol`` of the error.
    """
    observed = mask.astype(float)
    draw = np.random.default_rng(seed).random
    level = math.sqrt(max(float((x * observed).sum()), _EPS) / max(float(observed.sum()), 1.0) / k)
    w, h = 2 * level * draw((len(x), k)), 2 * level * draw((k, x.shape[1]))
    left = observed * (np.where(mask, x, 0.0) - w @ h)
    error = float((left**2).sum())
    for _ in range(max_iter):
        for j in range(k):
            step = np.maximum((left @ h[j]) / np.maximum(observed @ h[j] ** 2, _EPS), -w[:, j])
            w[:, j] += step
            left -= observed * np.outer(step, h[j])
            step = np.maximum((w[:, j] @ left) / np.maximum(w[:, j] ** 2 @ observed, _EPS), -h[j])
            h[j] += step
            left -= observed * np.outer(w[:, j], step)
        gained, error = error, float((left**2).sum())
        if gained - error < tol * max(gained, _EPS):
            break
    return w, h


def _local(df: DataFrame, names: list[str]) -> np.ndarray:
    n = df.count()
    if n * len(names) > MOST_LOCAL_VALUES:
        raise ValueError(f"{n} x {len(names)} values are more than a sweep takes into each task ({MOST_LOCAL_VALUES}); sample rows first, or use method='als'")
    return np.array([r.x for r in df.select(_values(names).alias("x")).collect()], float).reshape(-1, len(names))


def nmf_rank_cv_sweep(df: DataFrame, ranks=range(2, 11), test_fraction: float = 0.1, n_replicates: int = 3, n_seeds: int = 1, columns: list[str] | None = None, column_pattern: str = "^smth_", random_state: int = 0, max_iter: int = 500, tol: float = 1e-6, method: str = "local") -> DataFrame:
    """rank, rep, seed, train_mse, test_mse: single entries are held out, the same for all ranks of a replicate.

    ``local`` deals fits to tasks, each with the whole matrix; ``als`` fits each by Spark's non-negative ALS, for any size.
    """
    names, spark = by_pattern(df, columns, column_pattern), df.sparkSession
    schema = "rank int, rep int, seed int, train_mse double, test_mse double"
    if method == "als":
        return _als_sweep(df, names, ranks, test_fraction, n_replicates, random_state)
    shared = spark.sparkContext.broadcast(_local(df, names))  # at most MOST_LOCAL_VALUES
    grid = [(int(k), rep, s) for s in range(n_seeds) for rep in range(n_replicates) for k in ranks]

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for frame in frames:
            out = []
            for k, rep, s in frame[["rank", "rep", "seed"]].itertuples(index=False):
                seed = random_state + 1_000_000 * s
                held = np.random.default_rng(seed + 1000 * rep).random(x.shape) < test_fraction
                w, h = masked_nmf(x, ~held, k, max_iter, tol, seed + 1000 * rep + k)
                error = (x - w @ h) ** 2
                out.append((k, rep, s, error[~held].mean(), error[held].mean() if held.any() else None))
            yield pd.DataFrame(out, columns=["rank", "rep", "seed", "train_mse", "test_mse"])

    return materialize(spark.createDataFrame(grid, "rank int, rep int, seed int").repartition(max(1, min(len(grid), spark.sparkContext.defaultParallelism))).mapInPandas(fit, schema), "rank-cv")


def _als_sweep(df: DataFrame, names: list[str], ranks, test_fraction: float, replicates: int, seed: int) -> DataFrame:
    from pyspark.ml.recommendation import ALS

    spark = df.sparkSession
    numbered = materialize(df.select(_values(names).alias("x")).withColumn("row", F.monotonically_increasing_id()), "als-rows")
    keys = materialize(numbered.select("row", F.dense_rank().over(Window.partitionBy(F.shiftright("row", 33)).orderBy("row")).alias("n"), F.shiftright("row", 33).alias("part")), "als-keys")
    sizes = sorted(keys.groupBy("part").count().collect())
    first, total = [], 0
    for r in sizes:
        first.append((r.part, total))
        total += r["count"]
    offsets = spark.createDataFrame(first or [(0, 0)], "part long, first long")
    cells = materialize(numbered.join(keys, "row").join(F.broadcast(offsets), "part").select((F.col("first") + F.col("n") - 1).cast("int").alias("r"), F.posexplode("x").alias("c", "v")), "als-cells")
    out = []
    for rep in range(replicates):
        marked = cells.withColumn("held", F.pmod(F.xxhash64("r", "c", F.lit(seed + 1000 * rep)), F.lit(1 << 20)) < int(test_fraction * (1 << 20)))
        for k in ranks:
            model = ALS(rank=int(k), maxIter=15, regParam=1e-3, nonnegative=True, userCol="r", itemCol="c", ratingCol="v", seed=seed + 1000 * rep + int(k), coldStartStrategy="drop").fit(marked.filter("not held"))
            e = F.pow(F.col("v") - F.col("prediction"), F.lit(2))
            row = model.transform(marked).agg(F.avg(F.when(~F.col("held"), e)).alias("train"), F.avg(F.when(F.col("held"), e)).alias("test")).first()
            out.append((int(k), rep, 0, row.train, row.test))
    return spark.createDataFrame(out, "rank int, rep int, seed int, train_mse double, test_mse double")


def nmf_cophenetic_correlation(df: DataFrame, ranks=range(2, 11), n_runs: int = 10, columns: list[str] | None = None, column_pattern: str = "^smth_", random_state: int = 0, max_iter: int = 300, most_rows: int = 2_000) -> DataFrame:
    """rank, cophenetic: how stably runs from random starts group the rows, by average linkage of their consensus.

    The consensus is quadratic in the rows; beyond ``most_rows`` a sample must be given.
    """
    names, spark = by_pattern(df, columns, column_pattern), df.sparkSession
    x = _local(df, names)
    if len(x) > most_rows:
        raise ValueError(f"{len(x)} rows: the consensus of more than {most_rows} rows needs a sample")
    shared = spark.sparkContext.broadcast(x)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        k, data = int(frame["rank"].iloc[0]), shared.value
        together = np.zeros((len(data), len(data)))
        for run in range(n_runs):
            label = masked_nmf(data, np.ones(data.shape, bool), k, max_iter, 1e-6, random_state + 1000 * run + k)[0].argmax(axis=1)
            together += label[:, None] == label[None, :]
        distance = 1 - together / n_runs
        upper = np.triu_indices(len(data), 1)
        a, b = distance[upper], stats.cophenetic(stats.average_linkage(distance), len(data))[upper]
        value = 1.0 if a.std() < 1e-12 and b.std() < 1e-12 else float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else None
        return pd.DataFrame({"rank": [k], "cophenetic": [value]})

    return spark.createDataFrame([(int(k),) for k in ranks], "rank int").groupBy("rank").applyInPandas(one, "rank int, cophenetic double")


def best_rank(sweep: DataFrame) -> DataFrame:
    """rank with the least median test error, and its median and mean."""
    by_rank = sweep.groupBy("rank").agg(F.median("test_mse").alias("median_mse"), F.avg("test_mse").alias("mean_mse"))
    return by_rank.orderBy("median_mse", "rank").limit(1)
