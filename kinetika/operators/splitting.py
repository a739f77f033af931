"""Splits and folds that keep groups whole."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetika.functions.labels import pair_key
from kinetika.operators.ordered import running_totals
from kinetika.session import materialize


def seeded_order(key: Column, seed: int | None) -> Column:
    """A pseudo-random order of keys that every engine with MD5 repeats."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed or 0))).cast("binary"))


def _need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"columns not found: {missing}")


def _first_ranked(keys: DataFrame, key: str, part: float, seed: int | None) -> DataFrame:
    """The first floor(part x n) of distinct ``keys`` in the seeded order.

    Keys are counted by the first four digits of their hash, at most 65,536 counts; whole cells are taken below the cell that holds the
    last one, and only that cell is sorted.
    """
    ranked = keys.withColumn("_rank", seeded_order(F.col(key), seed)).withColumn("_cell", F.substring("_rank", 1, 4))
    cells = sorted(ranked.groupBy("_cell").count().collect())
    wanted = math.floor(part * sum(r["count"] for r in cells) + 1e-9)
    edge, left = "", wanted
    for r in cells:
        edge = r._cell
        if r["count"] > left:
            break
        left -= r["count"]
    else:
        return keys if cells and wanted else keys.limit(0)
    whole = ranked.filter(F.col("_cell") < edge)
    return whole.unionByName(ranked.filter(F.col("_cell") == edge).orderBy("_rank", key).limit(left)).select(key)


def group_train_test_split(df: DataFrame, train_size: float = 0.8, random_state: int | None = None, video_col: str = "video_filename") -> tuple[DataFrame, DataFrame]:
    """Whole groups to one side or the other."""
    _need(df, video_col)
    keys = df.select(video_col).filter(F.col(video_col).isNotNull()).distinct()
    chosen = materialize(_first_ranked(keys, video_col, train_size, random_state), "train-groups")
    return df.join(chosen, video_col, "left_semi"), df.join(chosen, video_col, "left_anti")


def _partners(df: DataFrame, video_col: str, pair_col: str) -> DataFrame:
    """Distinct (video, partner); a video with two partners is an error."""
    pairs = df.select(F.col(video_col).alias("video"), F.col(pair_col).alias("partner")).filter(F.col("video").isNotNull()).distinct()
    offenders = pairs.groupBy("video").agg(F.count("*").alias("n")).filter("n > 1").orderBy("video").limit(5).collect()
    if offenders:
        raise ValueError(f"videos with more than one partner: {[r.video for r in offenders]}")
    return pairs


def paired_train_test_split(df: DataFrame, train_size: float = 0.8, random_state: int | None = None, video_col: str = "video_filename", label_col: str = "isfakeorreal", pair_col: str = "corresponding_video", real_label: str = "real") -> tuple[DataFrame, DataFrame]:
    """Sampled real videos and their partners train, everything else tests; a sampled video without its partner is an error."""
    _need(df, video_col, label_col, pair_col)
    reals = _partners(df.filter(F.col(label_col) == real_label), video_col, pair_col)
    chosen = materialize(_first_ranked(reals.select("video"), "video", train_size, random_state).join(reals, "video"), "train-pairs")
    broken = chosen.join(df.select(F.col(video_col).alias("partner")).distinct(), "partner", "left_anti").limit(1).collect()
    if broken:
        raise ValueError(f"broken pairing: {broken[0].video!r} points to {broken[0].partner!r}, which isn't there")
    train = materialize(chosen.select(F.explode(F.array("video", "partner")).alias(video_col)).distinct(), "train-videos")
    return df.join(train, video_col, "left_semi"), df.join(train, video_col, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``group``, the least node reachable, of string edges ``a`` - ``b``.

    The least label is handed on along edges until nothing changes; each round is written to the shared folder. Matched pairs need
    two rounds.
    """
    both = materialize(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")), F.struct(F.col("a").alias("node"), F.col("a").alias("to")), F.struct(F.col("b").alias("node"), F.col("b").alias("to")))).alias("e")).select("e.*").distinct(), "pair-edges")
    state = materialize(both.groupBy("node").agg(F.min("to").alias("group")), "pair-groups")
    while True:
        spread = both.join(state.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("group").alias("near"))
        jumped = spread.join(state.select(F.col("node").alias("near"), F.col("group").alias("far")), "near", "left").select("node", F.least("near", "far").alias("group"))
        following = materialize(jumped, "pair-groups")
        changed = following.join(state.withColumnRenamed("group", "old"), "node").filter("group != old").limit(1).count()
        state = following
        if not changed:
            return state


def pair_groups(df: DataFrame, video_col: str = "video_filename", pair_col: str = "corresponding_video") -> DataFrame:
    """``df`` with ``pair_group``: the least video that pairing ties a video to."""
    _need(df, video_col, pair_col)
    pairs = materialize(_partners(df, video_col, pair_col), "partners")
    present = pairs.select(F.col("video").alias("partner")).distinct()
    absent = pairs.filter(F.col("partner").isNotNull()).join(present, "partner", "left_anti").count()
    if absent:
        warnings.warn(f"{absent} videos point to a partner that isn't there; each forms a group of its own", stacklevel=2)
    found = components(pairs.join(present, "partner", "left_semi").select(F.col("video").alias("a"), F.col("partner").alias("b")))
    large = found.groupBy("group").count().filter("count > 2").count()
    if large:
        warnings.warn(f"{large} groups have more than two videos", stacklevel=2)
    return df.join(found.select(F.col("node").alias(video_col), F.col("group").alias("_g")), video_col, "left").withColumn("pair_group", F.coalesce("_g", video_col)).select(*[c for c in df.columns if c != "pair_group"], "pair_group")


def pair_groups_from_filenames(df: DataFrame, video_col: str = "video_filename", label_col: str = "isfakeorreal", real_label: str = "real", key_fn: Callable[[str, str], str] | Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``df`` with ``pair_group`` derived from the video's name, by the default rule or by ``key_fn`` (on columns, or on strings)."""
    _need(df, video_col, label_col)
    name, label = F.col(video_col), F.col(label_col)
    if key_fn is None:
        keyed = df.withColumn("pair_group", pair_key(name, label, real_label))
        row = keyed.agg(F.count_if(label != real_label).alias("n"), F.count_if((label != real_label) & (F.col("pair_group") != name)).alias("k")).first()
        if row.k < row.n:
            warnings.warn(f"the name rule resolves {row.k} of {row.n} rows that aren't {real_label!r}", stacklevel=2)
        return keyed
    try:
        made = key_fn(name, label)
    except Exception:  # a function of strings
        made = None
    if isinstance(made, Column):
        return df.withColumn("pair_group", made)

    @F.pandas_udf("string")
    def keys(names, labels):
        return __import__("pandas").Series([key_fn(a, b) for a, b in zip(names, labels, strict=True)])

    return df.withColumn("pair_group", keys(name, label))


def pair_group_report(df: DataFrame, video_col: str = "video_filename", group_col: str = "pair_group") -> DataFrame:
    """group_size, n_groups, n_videos: how many groups there are of each size."""
    _need(df, video_col, group_col)
    sizes = df.select(video_col, group_col).distinct().groupBy(group_col).agg(F.count("*").alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count("*").alias("n_groups")).withColumn("n_videos", F.col("group_size") * F.col("n_groups")).orderBy("group_size")


class RepeatedStratifiedGroupKFold:
    """Folds that keep groups whole and label shares even; ``assign`` returns ``repeat``, the group and ``fold``.

    Groups are sorted by their counts of each label, the largest first, and in a seeded order among equals, and dealt to the folds in
    turn, there and back. So each fold gets its share of every kind of group. Positions are running totals over ranges: no task
    holds all groups and none go to the driver.
    """

    def __init__(self, n_splits: int = 5, n_repeats: int = 3, random_state: int | None = None) -> None:
        if n_splits < 2:
            raise ValueError("n_splits must be 2 at least")
        self.n_splits, self.n_repeats, self.random_state = n_splits, n_repeats, random_state

    def assign(self, df: DataFrame, label_col: str, group_col: str | None) -> DataFrame:
        if group_col is None or label_col is None:
            raise ValueError("groups and labels are required")
        labels = sorted((r[0] for r in df.select(label_col).distinct().collect()), key=lambda v: (v is not None, str(v)))  # few: they are classes
        counts = [F.count_if(F.col(label_col).eqNullSafe(F.lit(x))).alias(f"n{i}") for i, x in enumerate(labels)]
        groups = materialize(df.groupBy(F.col(group_col).alias("group")).agg(F.count("*").alias("size"), *counts), "fold-groups")
        if (n := groups.count()) < self.n_splits:
            raise ValueError(f"{n} groups can't fill {self.n_splits} folds")
        profile = F.concat(*[F.lpad((F.lit(10**15) - F.col(c)).cast("string"), 16, "0") for c in ("size", *[f"n{i}" for i in range(len(labels))])])
        out = None
        for repeat in range(self.n_repeats):
            placed = running_totals(groups.select("group", F.concat(profile, seeded_order(F.col("group"), (self.random_state or 0) + 1000 * repeat)).alias("key"), F.lit(1).alias("one")), "key", ["one"])
            turn, place = F.floor(F.col("before_one") / self.n_splits), F.pmod(F.col("before_one").cast("long"), F.lit(self.n_splits))
            fold = F.when(turn % 2 == 0, place).otherwise(self.n_splits - 1 - place).cast("int")
            part = placed.select(F.lit(repeat).alias("repeat"), F.col("group").alias(group_col), fold.alias("fold"))
            out = part if out is None else out.unionByName(part)
        return out

    def get_n_splits(self) -> int:
        return self.n_splits * self.n_repeats

    def split(self, df: DataFrame, label_col: str, group_col: str | None):
        """(repeat, fold, train, test) of every fold."""
        folds = materialize(self.assign(df, label_col, group_col), "folds")
        for repeat in range(self.n_repeats):
            for fold in range(self.n_splits):
                own = folds.filter((F.col("repeat") == repeat) & (F.col("fold") == fold)).select(group_col)
                yield repeat, fold, df.join(own, group_col, "left_anti"), df.join(own, group_col, "left_semi")


def stratified_folds(df: DataFrame, label_col: str, key: str, n_splits: int, seed: int | None) -> DataFrame:
    """``df`` with ``fold``: rows of each label dealt evenly in a seeded order of ``key``.

    Rows are numbered within 4,096 cells of the hash, after the counts of the cells before, so no task holds a whole label.
    """
    rank = seeded_order(F.col(key), seed)
    ranked = df.withColumns({"_rank": rank, "_cell": F.substring(rank, 1, 3)})
    offsets: list[tuple] = []
    seen: dict = {}
    for r in sorted(ranked.groupBy(label_col, "_cell").count().collect(), key=lambda r: r[1]):  # labels x 4,096 rows at most
        offsets.append((r[0], r[1], seen.get(r[0], 0)))
        seen[r[0]] = seen.get(r[0], 0) + r[2]
    kind = df.schema[label_col].dataType.simpleString()
    first = df.sparkSession.createDataFrame(offsets, f"_label {kind}, _of string, _first long")
    order = Window.partitionBy(label_col, "_cell").orderBy("_rank", key)
    numbered = ranked.withColumn("_row", F.row_number().over(order))
    joined = numbered.join(F.broadcast(first), numbered[label_col].eqNullSafe(first["_label"]) & (numbered["_cell"] == first["_of"]))
    return joined.select(*[numbered[c] for c in df.columns if c != "fold"], F.pmod(F.col("_first") + F.col("_row") - 1, F.lit(n_splits)).cast("int").alias("fold"))
