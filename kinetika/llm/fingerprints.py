"""Document fingerprints by MinHash.

Universal hash functions over the five-word shingles of a text, in vectorised numpy, give its signature; 16 mixed bits of each
minimum make the fingerprint. The share of equal places estimates the Jaccard similarity. ``near_classes`` joins ``BANDS`` bands of the
signature in Spark and verifies the similarity of all that meet exactly.

Defined results: a null text counts as empty (and is in no class with others); a text without words has one shingle of all its
characters, so equal texts always have equal fingerprints; a null id comes first in the order and forms a class of its own; rows that
repeat an id follow each other in the order of their text hashes; a very long text is worked on alone and whole; an empty table
gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetika.llm import ngram_join
from kinetika.llm import textarrays as ta
from kinetika.llm.components import connected_components
from kinetika.llm.skew import hot_join, range_bounds, range_of
from kinetika.session import discard, materialize, text_batches

HASHES = 128
SEED = 11
BANDS = 21
BAND_ROWS = 6


def signature_values(hashes: np.ndarray, bounds: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Texts x functions: 16 bits of each minimum over the shingles of a text."""
    return (ta.mix(ta.minima(hashes, bounds, functions)) & np.uint64(0xFFFF)).astype(">u2").T


def signatures(texts: pa.Array, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The signatures of texts."""
    return signature_values(*ta.shingles(texts, wordless=True), functions)


def _hex(rows: np.ndarray) -> list[str]:
    raw, width = np.ascontiguousarray(rows).tobytes().hex(), rows.shape[1] * 4
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", hashes: int = HASHES) -> DataFrame:
    """The key and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = ta.permutations(hashes, SEED)
        for batch in batches:
            for part in ta.slices(batch):
                texts = pa.array(part.column("text").fill_null(""))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_hex(signatures(texts, functions)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string").withColumnRenamed("doc_id", key)


def likeness(first: str, second: str) -> float:
    """The estimated similarity of two fingerprints: their share of equal places."""
    a, b = (np.frombuffer(bytes.fromhex(x), ">u2") for x in (first, second))
    return float((a == b).mean())


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id``, ``text_key``, ``class_id`` and ``n_links`` of every row: documents with a Jaccard similarity of ``threshold`` or more
    make a class, named by its least id.

    Bands of signatures are joined: all that share a band meet the least of them, and what hangs together is verified exactly. Two
    texts of similarity s share a band with probability 1 - (1 - s**band_rows)**bands, 0.998 at 0.8.
    """

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = ta.permutations(HASHES, SEED)
        for batch in batches:
            for part in ta.slices(batch):
                hashes, bounds = ta.shingles(part.column("text"), wordless=True)
                sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                values = signature_values(hashes, bounds, functions)[:, : bands * band_rows].reshape(len(sets), bands, band_rows)
                label = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sets), axis=0)
                for i in range(band_rows):
                    label = ta.mix(label * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i].astype(np.uint64))
                labels = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(label.view(np.int64).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(digests, pa.binary()), labels], ["doc_id", "text_key", "digest", "forest"])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), ngram_join.text_key(text).alias("text_key"), F.col(text).alias("text"))
    signed = materialize(rows.mapInArrow(band, "doc_id long, text_key binary, digest binary, forest array<long>"), "banded")
    sets = ngram_join.distinct_sets(signed)
    banded = sets.select("node", F.explode("forest").alias("label"))
    nodes = materialize(banded.groupBy("label").agg(F.min("node").alias("least"), F.count("*").alias("key_rows")).filter("key_rows > 1"), "bands")
    tied = materialize(hot_join(banded, nodes, "label").filter("node != least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "band-links")
    groups = materialize(connected_components(tied), "band-groups")
    texts = ngram_join.texts_of(docs, sets, groups.select("node"), key, text)
    links = ngram_join.verified_links(texts, groups, threshold)
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = materialize(ngram_join.classes_of(signed, sets, totals, [links.select("node", "root").filter("node != root")]), "near-classes")
    discard(signed, sets, nodes, tied, groups, texts, links)
    return classes.select("doc_id", "text_key", "class_id", "n_links")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", hashes: int = HASHES, parts: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends with the beginning of the next document.

    One range shuffle brings neighbours together; the first row of each range is also dealt to the range before it. ``classes``, as
    ``near_classes`` gives them, travel the same way and add ``near_class`` and ``near_links``.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce("doc_id", F.lit(-(2**63))).alias("_order")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole.alias("text"), ngram_join.text_key(text).alias("_key")).select("*", order, F.xxhash64("_key").alias("_salt"))
    bounds = range_bounds(rows.select("_order", "_salt", F.length("text").alias("_chars")), "_order", "_salt", F.col("_chars") + 64, parts)
    number = range_of(F.col("_order"), F.col("_salt"), bounds).alias("_range")
    firsts = sorted((r._range, r.least._order, r.least._salt) for r in rows.select("_order", "_salt", number).groupBy("_range").agg(F.min(F.struct("_order", "_salt")).alias("least")).collect())  # one row per range
    before = spark.createDataFrame([(o, s, firsts[i - 1][0]) for i, (_, o, s) in enumerate(firsts)], "_order long, _salt long, _before int")
    none = F.lit(None).cast("long")
    texts = rows.select(number, F.lit(1).alias("_kind"), "_order", "_salt", "doc_id", "text", none.alias("class_id"), none.alias("n_links"))
    tails = rows.join(F.broadcast(before), ["_order", "_salt"]).groupBy("_order", "_salt").agg(F.any_value("_before").alias("_range"), F.any_value("text").alias("text"))
    dealt = texts.unionByName(tails.select("_range", F.lit(2).alias("_kind"), "_order", "_salt", none.alias("doc_id"), "text", none.alias("class_id"), none.alias("n_links")))
    if classes is not None:
        keyed = classes.select(order, F.xxhash64("text_key").alias("_salt"), "class_id", "n_links").distinct()
        dealt = dealt.unionByName(keyed.select(number, F.lit(0).alias("_kind"), "_order", "_salt", none.alias("doc_id"), F.lit("").alias("text"), "class_id", "n_links"))
    dealt = dealt.repartitionById(max(1, len(bounds) + 1), "_range").sortWithinPartitions("_range", F.col("_kind") == 2, "_order", "_salt", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = ta.permutations(hashes, SEED)
        waiting: list[tuple[int | None, str, int | None, int | None]] = []
        done, held, mark = False, 0, (None, None)

        def emit(following: str) -> pa.RecordBatch:
            texts = [t for _, t, _, _ in waiting]
            edited = []
            for t, n in zip(texts, [*texts[1:], following], strict=True):
                half = len(t) // 2
                edited.append(t[: len(t) - half] + n[:half])
            own = signatures(pa.array([*texts, following], pa.string()), functions)
            other = signatures(pa.array(edited, pa.string()), functions)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([w[0] for w in waiting], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_hex(own[:-1]), pa.string()), pa.array(_hex(other), pa.string()),
                    pa.array((own[:-1] == other).mean(axis=1)), pa.array((own[:-1] == own[1:]).mean(axis=1)), pa.array([w[2] for w in waiting], pa.int64()), pa.array([w[3] for w in waiting], pa.int64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_class", "near_links"],
            )

        for batch in batches:
            for part in ta.slices(batch):
                for kind, k, t, c, n in zip(*(part.column(x).to_pylist() for x in ("_kind", "doc_id", "text", "class_id", "n_links")), strict=True):
                    if done:
                        continue
                    if kind == 0:
                        mark = (c, n)
                        continue
                    if waiting and (kind == 2 or held > ta.SLICE_BYTES):
                        yield emit(t)
                        waiting, held = [], 0
                    if kind == 2:
                        done = True
                    else:
                        waiting.append((k, t, *mark))
                        held += len(t)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class long, near_links long"
    out = dealt.select("_kind", "doc_id", "text", "class_id", "n_links").mapInArrow(run, schema).withColumnRenamed("doc_id", key)
    return out if classes is not None else out.drop("near_class", "near_links")
