"""Removal of repeated passages by overlapping windows of three lines.

Every three consecutive lines of a text make a window, known by the MD5 of its lines. A window that occurs again anywhere, in
the order of id, text hash and position, is a later occurrence; all lines that later occurrences cover are removed.

What the texts lose is broadcast to them where it is small; beyond ``BROADCAST_BYTES`` the texts that may lose lines are shuffled to meet it,
and a table of bits of fixed size tells the others apart where they lie.

Defined results: a text of fewer than three lines has no window and stays; null texts stay null; a text that loses all its lines
becomes empty; a null id comes first in the order; rows equal in id and text count as one occurrence, so all stay alike; a very long
text is taken whole, in one row; an empty table gives no rows. Input columns are kept whatever their names, but for ``removed_lines``, which
is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetika.llm.skew import hot_join, split_by_bits
from kinetika.session import materialize, unused

WINDOW_LINES = 3
#: What texts lose is broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW_LINES) -> DataFrame:
    """``docs`` without the lines that later occurrences of repeated windows cover, and ``removed_lines`` (long)."""
    source = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    windows = materialize(
        source.filter(F.col("_text").isNotNull())
        .withColumn("_lines", F.split(F.col("_text"), "\n", -1))
        .filter(F.size("_lines") >= window)
        .select("_id", F.xxhash64("_text").alias("_hash"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_lines") - (window - 1)), lambda i: F.unhex(F.md5(F.array_join(F.slice("_lines", i, window), "\n"))))).alias("_pos", "_window")),
        "line-windows",
    )
    place = F.struct(F.col("_id"), F.col("_hash"), F.col("_pos"))
    repeated = materialize(windows.groupBy("_window").agg(F.count("*").alias("key_rows"), F.min(place).alias("_first")).filter("key_rows > 1"), "line-repeats")
    later = hot_join(windows, repeated, "_window").filter(place > F.col("_first"))
    positions = F.array_distinct(F.flatten(F.transform(F.collect_set("_pos"), lambda p: F.sequence(p, p + (window - 1)))))
    covered = materialize(later.groupBy("_id", "_hash").agg(positions.alias("_covered")), "line-covered")

    kept_columns = [c for c in docs.columns if c != "removed_lines"]
    id_, hash_, with_id, with_hash, gone = unused(docs, "id", "hash", "with_id", "with_hash", "gone")
    hashed = docs.drop("removed_lines").withColumn(id_, F.col(key).cast("long")).withColumn(hash_, F.xxhash64(text))
    known = covered.select(F.col("_id").alias(with_id), F.col("_hash").alias(with_hash), F.col("_covered").alias(gone))
    size = covered.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_covered")), F.lit(0)).alias("lines")).first()
    if 32 * size.rows + 4 * size.lines <= BROADCAST_BYTES:
        met, untouched = hashed, None
        known = F.broadcast(known)
    else:
        met, untouched = split_by_bits(hashed, covered.select(F.col("_id").alias(id_), F.col("_hash").alias(hash_)), [id_, hash_], F.col(text).isNull())
    joined = met.join(known, (F.col(hash_) == F.col(with_hash)) & F.col(id_).eqNullSafe(F.col(with_id)), "left")

    def kept_lines(own: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.get(own, i)), "\n")

    lines = F.split(F.col(text), "\n", -1)
    left_over = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.get(F.transform(F.array(lines), kept_lines), F.lit(0)))
    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("removed_lines")
    touched = joined.select(*[left_over.alias(text) if c == text else F.col(c) for c in kept_columns], removed)
    return touched if untouched is None else touched.unionByName(untouched.select(*kept_columns, F.lit(0).cast("long").alias("removed_lines")))
