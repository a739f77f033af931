"""Packing of tokenised documents into sequences by minimum bin slack.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the search works on counts by length. For each bin a
bitset subset-sum over the available lengths finds the fullest feasible combination that holds the longest remaining length. The
combination is removed as often as the counts allow, which uses up one of its lengths or leaves fewer of it than the combination takes; so
the number of searches grows with the number of lengths (some 1,050 for 1,024 lengths of random counts), not of documents. Documents
then take their places by rank within their length.

Defined results: a null text counts as empty, which packs as the end id alone; a document longer than the capacity is cut so that only
its first piece may be shorter; rows that repeat an id are packed each; equal lengths are interchangeable and take places in a fixed
order; a text of any length is tokenised whole; an empty table gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetika.llm import textarrays as ta
from kinetika.session import materialize, text_batches

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Pieces of one length that one task ranks: a length of more is ranked in parts.
PART_ROWS = 32_768
#: ``tiktoken`` gives up on white space of nearly a million characters in one run; texts with runs from this on go to ``tokenizers``.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")
_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The byte-level BPE of a vocabulary file, by its ranks: the same ids as the ``tokenizers`` file gives with
    ``encode_special_tokens`` (so ``<|endoftext|>`` in a text is ordinary text), several times as fast."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        ranks = Path(public_tokenizers.path(Path(vocabulary).stem + ".tiktoken")).read_bytes().splitlines()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks)}
        _encoders[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[vocabulary]


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of a text, however long its white space is."""
    if len(text) < LONG_SPACE or not _LONG_SPACE.search(text):
        return encoder(vocabulary).encode_ordinary(text)
    whole = vocabulary + " whole"
    if whole not in _encoders:
        import public_tokenizers
        from tokenizers import Tokenizer

        _encoders[whole] = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        _encoders[whole].encode_special_tokens = True
    return _encoders[whole].encode(text, add_special_tokens=False).ids


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: the key, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                out: list[list] = [[], [], [], [], [], []]
                for k, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(t or "", vocabulary), end_id], "<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        for column, value in zip(out, (k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype("<i4") if with_ids else None), strict=True):
                            column.append(value)
                arrays = [pa.array(v, kind) for v, kind in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 6 if with_ids else 5], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])

    text_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("doc_id", key)


def fullest(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The fullest combination of available lengths that holds the longest one: length -> how many.

    Bit i of a bitset says whether some combination has the sum i. Lengths come in falling order, so long pieces are used up first.
    """
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    longest = lengths[0]
    room, mask = capacity - longest, (1 << (capacity - longest + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        most = min(int(counts[length]) - (length == longest), room // length)
        taken = 1
        while most > 0:  # as many as there are, by doubling
            n = min(taken, most)
            steps.append((length, n, reach))
            reach |= reach << (length * n) & mask
            most -= n
            taken *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    out = {longest: 1}
    for length, n, before in reversed(steps):
        if not before >> left & 1:
            out[length] = out.get(length, 0) + n
            left -= length * n
    return out


def patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (combination, how often), until no piece is left."""
    counts, out = counts.astype(np.int64).copy(), []
    while counts.any():
        chosen = fullest(counts, capacity)
        times = min(int(counts[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        out.append((chosen, times))
    return out


def _segments(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, first sequence, pieces of that length in each sequence, offset of the first of them."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for chosen, times in bins:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            out.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack_pieces(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with ``length``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    by_length = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    parts = np.array([-(-by_length.get(n, 0) // PART_ROWS) for n in range(capacity + 1)], np.int64)
    starts = np.cumsum(parts) - parts
    shared = F.broadcast(spark.createDataFrame([(n, int(starts[n]), int(parts[n])) for n in by_length], "length long, _start long, _parts long"))
    part = F.col("_start") + F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.col("_parts"))
    dealt = pieces.join(shared, "length").withColumn("_part", part).select(*pieces.columns, "_part")
    count = np.zeros(int(parts.sum()), np.int64)
    for r in dealt.groupBy("_part").count().collect():  # one row per length, and per PART_ROWS pieces
        count[r._part] = r["count"]
    before = np.cumsum(count) - count
    total = np.array([by_length.get(n, 0) for n in range(capacity + 1)], np.int64)
    first = before - np.repeat(np.cumsum(total) - total, parts)  # the rank within its length of the first piece of each part
    segments = _segments(patterns(total, capacity))
    columns = pieces.columns
    schema = pieces.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = first[batch.column("_part").to_numpy()] + batch.column("_rank").to_numpy() - 1
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                at, rows = np.flatnonzero(length == size), segments[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inner = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + inner // row[:, 2]
                offset[at] = row[:, 3] + inner % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    within = Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first(), "piece", "ids_crc32")
    return dealt.withColumn("_rank", F.row_number().over(within)).mapInArrow(place, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset; see the module."""
    return pack_pieces(materialize(tokenize(docs, key, text, capacity, END_ID, vocabulary, with_ids), "pieces"), key, capacity)
