"""Joins and range bounds that stay even when a few keys hold most of the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetika.session import unused

#: A key is hot when it holds more than this part of all rows; so there are fewer hot keys than its inverse.
HOT_PART = 1 / 1000


#: Narrow tables of up to so many rows are broadcast, some 50 MB.
BROADCAST_ROWS = 500_000


def small_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``left`` with a written table of a few fixed-size columns: by broadcast while it has few rows, by shuffle beyond."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def hot_join(left: DataFrame, per_key: DataFrame, key: str, how: str = "inner", rows: str = "key_rows", narrow: bool = True) -> DataFrame:
    """Join ``left`` with ``per_key``, which has one row for each ``key`` and in ``rows`` how many rows of ``left`` have it.

    Hot keys, of which there can be 1,000 at most, are joined by broadcast where their rows lie; all others are shuffled, and none
    of them holds more than a thousandth of the rows. Both inputs should be written tables, as they are read twice.
    A ``narrow`` table, of columns of fixed size, is broadcast whole while it has few rows.
    Null keys match nothing; with ``how="left"`` they are kept. ``rows`` isn't returned.
    """
    found = per_key.agg(F.count("*").alias("keys"), F.coalesce(F.sum(rows), F.lit(0)).alias("total"), F.coalesce(F.max(rows), F.lit(0)).alias("most")).first()
    if narrow and found["keys"] <= BROADCAST_ROWS:
        return left.join(F.broadcast(per_key.drop(rows)), key, how)
    most = max(1000, int(found.total * HOT_PART))
    hot = per_key.filter(F.col(rows) > most)
    cold = per_key.filter(F.col(rows) <= most).drop(rows)
    if how == "inner" and found.most <= most:
        return left.join(cold, key)
    hit = left.join(F.broadcast(hot.drop(rows)), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    if how == "left":
        keyed = rest.filter(F.col(key).isNotNull()).join(cold, key, "left")
        bare = rest.filter(F.col(key).isNull()).join(cold.limit(0), key, "left")
        return hit.unionByName(keyed).unionByName(bare)
    return hit.unionByName(rest.join(cold, key, how))


#: ``split_by_bits`` has so many bits, in maps of ``_MAP_BITS`` each: 4 MB in all, whatever the number of keys.
FILTER_BITS = 1 << 25
_MAP_BITS = 32_768


def split_by_bits(left: DataFrame, keys: DataFrame, columns: list[str], never: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``left`` in two: the rows whose ``columns`` may be among ``keys``, and those that certainly aren't, with all that are ``never``.

    Hashes of the keys set bits in a table of ``FILTER_BITS``, which is broadcast, so rows that match nothing needn't be shuffled to find
    that out. With more keys more rows pass, and none that matches is ever in the second part.
    """
    (flag, number, bits) = unused(left, "flag", "number", "bits")
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    maps = keys.select(place.alias("p")).groupBy((F.floor(F.col("p") / _MAP_BITS)).cast("int").alias(number)).agg(F.bitmap_construct_agg((F.col("p") % _MAP_BITS).cast("long")).alias(bits))
    joined = left.withColumn(flag, place.cast("int")).withColumn(number, F.floor(F.col(flag) / _MAP_BITS).cast("int")).join(F.broadcast(maps), number, "left")
    at = F.col(flag) % _MAP_BITS
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.col(bits).isNotNull() & (F.call_function("getbit", byte, at % 8) == 1), F.lit(False))
    hit = hit if never is None else hit & ~never
    return joined.filter(hit).select(*left.columns), joined.filter(~hit).select(*left.columns)


#: At most so many ranges, so what the driver samples for their bounds has a limit too.
MOST_RANGES = 50_000


def range_bounds(df: DataFrame, order: str, salt: str, weight: Column, parts: int, sample: int = 20_000) -> np.ndarray:
    """At most ``parts - 1`` bounds, pairs of longs, that cut ``df`` into ranges of (``order``, ``salt``) of about equal ``weight``.

    The bounds depend on the rows alone, not on how they lie in partitions: they come from the pairs whose hash falls under a
    limit, about ``sample`` of them or 32 for each range. Other than such a sample nothing goes to the driver. A value of ``order`` that
    holds many rows is cut by ``salt``.
    """
    count = df.count()
    if parts < 2 or not count:
        return np.zeros((0, 2), np.int64)
    parts = min(parts, MOST_RANGES)
    step = max(1, count // max(sample, 32 * parts))
    picked = (
        df.filter(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order, salt), F.lit(step)) == 0))
        .groupBy(F.col(order).alias("o"), F.col(salt).alias("s"))
        .agg(F.sum(weight.cast("double")).alias("w"))
        .orderBy("o", "s")
        .collect()
    )
    if not picked:
        return np.zeros((0, 2), np.int64)
    keys = np.array([(r.o, r.s) for r in picked], np.int64)
    sums = np.cumsum([max(r.w or 0.0, 1.0) for r in picked])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at + 1, len(keys) - 1)], axis=0)


def range_of(order: Column, salt: Column, bounds: np.ndarray) -> Column:
    """The number of the range that (``order``, ``salt``) falls in."""
    first, second = np.ascontiguousarray(bounds[:, 0]), np.ascontiguousarray(bounds[:, 1])

    @F.pandas_udf("int")
    def find(orders, salts):
        orders, salts = orders.to_numpy(), salts.to_numpy()
        low, high = np.searchsorted(first, orders, "left"), np.searchsorted(first, orders, "right")
        out = low.copy()
        for a, b in {*zip(low[high > low].tolist(), high[high > low].tolist(), strict=True)}:
            at = (low == a) & (high == b)
            out[at] = a + np.searchsorted(second[a:b], salts[at], "right")
        return __import__("pandas").Series(out.astype("int32"))

    return find(order, salt)
