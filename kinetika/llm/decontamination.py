"""Benchmark decontamination: short test items found inside long documents.

The items are partitioned by size: class u holds items of u/2 < n <= u shingles, u a power of two. For each class a document is cut
into blocks of u shingles, and two neighbouring blocks make a window; an occurrence of an item lies in one window whole. So the
Jaccard similarity of item and window is at least 0.8 / 4.2 where the containment is 0.8, however long the document is, and 64 MinHash
values, each a band of its own, miss less than one such item in 500,000. Each candidate is verified by the exact containment of
the item's shingles in the whole document.

Defined results: an item or document of fewer than five words is one shingle of all its words; one without words, or null, has no
shingles and matches nothing; every row of both tables is matched by itself, so repeated rows give repeated results; a text of any
length is searched whole; empty tables give none; other input columns are ignored (kept by ``decontaminate``), whatever their names. Test items
are taken in blocks of a fixed number and a fixed number of bytes, four blocks to a scan of all documents, so what is broadcast has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetika.llm import textarrays as ta
from kinetika.session import text_batches

HASHES = 64
SEED = 5
ITEMS_PER_BLOCK = 50_000
BYTES_PER_BLOCK = 32 << 20
#: Blocks that one scan of the documents is held against; what a worker keeps of them has this bound.
BLOCKS_PER_SCAN = 4
_FILTER_BITS = 18


class ItemIndex:
    """MinHash values and shingle sets of one block of test items, by size class."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        hashes, bounds = ta.shingles(pa.array(texts, pa.string()))
        sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kept = [i for i, s in enumerate(sets) if len(s)]
        self.ids = np.array([ids[i] for i in kept], object)
        self.sets = [sets[i] for i in kept]
        self.classes = []
        functions = ta.permutations(HASHES, SEED)
        size = np.array([1 << (len(s) - 1).bit_length() for s in self.sets], np.int64)
        for u in sorted(set(size.tolist())):
            members = np.flatnonzero(size == u)
            least = ta.minima(np.concatenate([self.sets[i] for i in members]), np.cumsum([0, *(len(self.sets[i]) for i in members)]), functions)
            tables = []
            for row in least:
                order = np.argsort(row, kind="stable")
                tables.append((row[order], members[order]))
            coarse = np.zeros((HASHES, 1 << _FILTER_BITS), bool)
            for k, row in enumerate(least):
                coarse[k, (ta.mix(row.copy()) & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.classes.append((u, tables, np.packbits(coarse, axis=1)))


def _starts(first: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of ``step`` in runs that begin at ``first`` and have ``counts`` members, and the blocks of each run."""
    blocks = -(-counts // step)
    ends = np.cumsum(blocks)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - blocks, blocks)
    return np.repeat(first, blocks) + inner * step, np.concatenate([[0], ends])


def _candidates(hashes: np.ndarray, bounds: np.ndarray, index: ItemIndex, functions: tuple[np.ndarray, np.ndarray]) -> set[tuple[int, int]]:
    """(document, item) that share a MinHash value in some window."""
    counts = np.diff(bounds)
    texts = np.flatnonzero(counts > 0)
    out: set[tuple[int, int]] = set()
    if not len(texts) or not index.classes:
        return out
    base = index.classes[0][0]
    starts, of_text = _starts(bounds[:-1][texts], counts[texts], base)
    scratch = np.empty_like(hashes)
    layouts = []
    for u, tables, coarse in index.classes:
        s, o = _starts(of_text[:-1], np.diff(of_text), u // base)
        last = np.zeros(len(s), bool)
        last[o[1:] - 1] = True
        layouts.append((s, np.repeat(texts, np.diff(o)), np.flatnonzero(~last), tables, coarse))
    for k, (a, b) in enumerate(zip(*functions, strict=True)):
        np.multiply(hashes, a, out=scratch)
        scratch += b
        least = np.minimum.reduceat(scratch, starts)
        for s, owner, joined, tables, coarse in layouts:
            block = np.minimum.reduceat(least, s)
            window = block.copy()
            window[joined] = np.minimum(block[joined], block[joined + 1])
            place = (ta.mix(window.copy()) & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)
            hits = np.flatnonzero(coarse[k][place >> 3] & (128 >> (place & 7)))
            if len(hits):
                values, members = tables[k]
                lo, hi = np.searchsorted(values, window[hits], "left"), np.searchsorted(values, window[hits], "right")
                for h in np.flatnonzero(hi > lo):
                    out.update((int(owner[hits[h]]), int(m)) for m in members[lo[h] : hi[h]])
    return out


def _verified(hashes: np.ndarray, bounds: np.ndarray, index: ItemIndex, functions: tuple[np.ndarray, np.ndarray], threshold: float) -> Iterator[tuple[int, int, int]]:
    """(text, item, shared shingles) of all items that a text contains to ``threshold`` or more."""
    sorted_text: dict[int, np.ndarray] = {}
    for at, item in sorted(_candidates(hashes, bounds, index, functions)):
        if at not in sorted_text:
            sorted_text = {at: np.unique(hashes[bounds[at] : bounds[at + 1]])}
        own, whole = index.sets[item], sorted_text[at]
        shared = int((whole[np.minimum(np.searchsorted(whole, own), len(whole) - 1)] == own).sum())
        if shared >= threshold * len(own) - 1e-9:
            yield at, item, shared


def _indexes(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, items_per_block: int) -> Iterator[list]:
    """Broadcast indexes of the test items, ``BLOCKS_PER_SCAN`` blocks at a time; one at least."""
    text_batches(docs.sparkSession)
    wanted = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // items_per_block), -(-size.bytes // BYTES_PER_BLOCK))
    held: list = []
    for i in range(blocks):
        taken = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()  # about BYTES_PER_BLOCK at most
        held.append(docs.sparkSession.sparkContext.broadcast(ItemIndex([r.item_id for r in taken], [r.text for r in taken])))
        if len(held) == BLOCKS_PER_SCAN or i + 1 == blocks:
            yield held
            held = []


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """Pairs of a document and a test item whose shingles the document contains to ``threshold`` or more.

    Returns the document's key, the item's key, ``shared`` and ``item_shingles`` (int) and ``containment``.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, shared int, item_shingles int, containment double"

    def scan(indexes: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            functions = ta.permutations(HASHES, SEED)
            for batch in batches:
                found: list[tuple] = []
                for part in ta.slices(batch):
                    hashes, bounds = ta.shingles(part.column("text"))
                    for index in (held.value for held in indexes):
                        for at, item, shared in _verified(hashes, bounds, index, functions, threshold):
                            size = len(index.sets[item])
                            found.append((part.column("doc_id")[at].as_py(), index.ids[item], shared, size, shared / size))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], schema.replace(",", "").split()[::2])

        return run

    found = reduce(DataFrame.unionAll, [rows.mapInArrow(scan(indexes), schema) for indexes in _indexes(docs, items, item_key, item_text, items_per_block)])
    return found.withColumnRenamed("item_id", item_key).withColumnRenamed("doc_id", key)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``docs`` without the rows whose text contains a test item. Rows go by their own text, whatever other rows share their key."""

    def clean(indexes: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            functions = ta.permutations(HASHES, SEED)
            for batch in batches:
                for part in ta.slices(batch, text):
                    hashes, bounds = ta.shingles(part.column(text))
                    keep = np.ones(part.num_rows, bool)
                    for held in indexes:
                        keep[[at for at, _, _ in _verified(hashes, bounds, held.value, functions, threshold)]] = False
                    yield part.filter(pa.array(keep))

        return run

    for indexes in _indexes(docs, items, "item_id", "text", items_per_block):
        docs = docs.mapInArrow(clean(indexes), docs.schema)
    return docs
