"""Connected components: by alternating star contraction in DataFrame operations, or in one task where there are few edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetika.llm.skew import hot_join
from kinetika.session import materialize


#: Up to so many edges, 8 MB, are tied together in one task; more are contracted by joins.
LOCAL_EDGES = 500_000


def least_members(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The least member of the component of each of ``n`` numbered nodes."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, first, root[second])
        np.minimum.at(root, second, root[first])
        root = root[root]
        if (root == before).all():
            return root


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        first, second = (np.concatenate(side) for side in zip(*held, strict=True))
        ids, places = np.unique(np.concatenate([first, second]), return_inverse=True)
        root = least_members(len(ids), places[: len(first)], places[len(first) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], ["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (or smaller) neighbours at the least node of its neighbourhood."""
    if large:
        sided = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("key_rows")), "star-least")
    joined = hot_join(sided, least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Does every node either have one edge down, or only edges up? Then each star is a component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down = 1 AND up = 1)").limit(1).count()


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """The component of every node of ``edges`` (``u``, ``v``: long): ``node`` and ``component``, its least node.

    Large-star and small-star steps alternate until the edges are stars; the number of rounds grows with the logarithm of the size
    of the largest component, whatever its shape. Each step is written to the shared folder. ``LOCAL_EDGES`` edges or fewer, counted first, are
    tied together in one task instead.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialize(down.filter(F.col("u") != F.col("v")).distinct(), "edges")
    if current.count() <= LOCAL_EDGES:
        return current.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    for _ in range(rounds):
        if _is_star_forest(current):
            break
        current = materialize(_star(materialize(_star(current, large=True), "large-star"), large=False), "small-star")
    else:
        raise RuntimeError(f"components don't settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
