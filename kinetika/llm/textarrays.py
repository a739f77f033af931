"""Whole texts as numpy arrays: code points, words, shingle hashes and MinHash values.

A batch of texts is decoded once and every step is vectorised over all of its characters or words, so no Python object is made
per word. A word is a maximal run of letters and digits, in lower case; a shingle is ``size`` consecutive words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_U64 = np.uint64


@lru_cache(maxsize=1)
def character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter or digit, is it a letter, its lower case."""
    count = 0x110000

    def each(of: Callable[[str], object], kind: type) -> np.ndarray:
        return np.fromiter((of(" " if 0xD800 <= c < 0xE000 else chr(c)) for c in range(count)), kind, count)

    word, letter = each(str.isalnum, bool), each(str.isalpha, bool)
    lower = each(lambda c: ord(x) if len(x := c.lower()) == 1 else ord(c), np.uint32)
    return word, letter, lower


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``most`` text bytes each, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and where each text begins and ends; null counts as empty."""
    filled = pc.fill_null(texts, "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(filled.type) else np.int32
    _, offsets, data = filled.buffers()
    offsets = np.frombuffer(offsets, kind)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None else b""
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    leads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=leads[1:])
    return points, leads[offsets - offsets[0]]


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    def run(step: int) -> np.ndarray:
        out = np.full(length, step, _U64)
        out[0] = 1
        return np.cumprod(out, dtype=_U64)

    return run(_MULTIPLIER), run(pow(_MULTIPLIER, -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = values ^ (values >> _U64(31))
    values *= _U64(0x7FB5D329728EA185)
    values ^= values >> _U64(27)
    values *= _U64(0x81DADEF4BC2DD44D)
    values ^= values >> _U64(33)
    return values


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``, wherever it stands."""
    size = 1 << max(16, int(len(values)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(values) + 1, _U64)
    np.cumsum((values.astype(_U64) + _U64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U64))


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and which words belong to each text."""
    is_word = character_tables()[0][points]
    before = np.empty_like(is_word)
    after = np.empty_like(is_word)
    if len(points):
        before[0], before[1:] = False, is_word[:-1]
        after[-1], after[:-1] = False, is_word[1:]
        before[offsets[:-1][offsets[:-1] < len(points)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every word, which words belong to each text, the code points and their offsets."""
    points, offsets = code_points(texts)
    starts, ends, of_text = words(points, offsets)
    return span_hashes(character_tables()[2][points], starts, ends), of_text, points, offsets


def shingles(texts: pa.Array, size: int = 5, wordless: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts with repeats, in order, and which belong to each text.

    A text of fewer than ``size`` words has one shingle of all its words. A text without words has none, or with ``wordless``
    one made of all its characters; a null text has none.
    """
    hashes, of_text, points, offsets = word_hashes(texts)
    n_words = np.diff(of_text)
    full, short = n_words >= size, (n_words > 0) & (n_words < size)
    bare = (n_words == 0) & wordless & ~pc.is_null(texts).to_numpy(zero_copy_only=False)
    counts = np.where(full, n_words - size + 1, (short | bare).astype(np.int64))
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, _U64)
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1 << 62, 1 << 63, size, dtype=_U64) * _U64(2) + _U64(1)
    if full.any():
        span = max(0, len(hashes) - size + 1)
        sums = np.zeros(span, _U64)
        for j in range(size):
            sums += hashes[j : j + span] * factors[j]
        own = counts[full]
        source = np.repeat(of_text[:-1][full] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        target = np.repeat(ends[full] - own - (np.cumsum(own) - own), own) + np.arange(own.sum())
        out[target] = mix(sums[source])
    for i in np.flatnonzero(short):
        part = hashes[of_text[i] : of_text[i + 1]]
        out[ends[i] - 1] = mix(np.array([(part * factors[: len(part)]).sum() + _U64(len(part))], _U64))[0]
    if bare.any():
        at = np.flatnonzero(bare)
        out[ends[at] - 1] = mix(span_hashes(points, offsets[at], offsets[at + 1]) ^ _U64(0x5BD1E995))
    return out, np.concatenate([[0], ends])


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` universal hash functions x -> a x + b modulo 2**64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=_U64) * _U64(2) + _U64(1), rng.integers(0, 1 << 63, count, dtype=_U64)


def minima(hashes: np.ndarray, bounds: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each function over each group of hashes: functions x groups; all ones for an empty group."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.full((len(functions[0]), len(bounds) - 1), np.iinfo(_U64).max, _U64)
    if len(full):
        starts = bounds[:-1][full]
        scratch = np.empty_like(hashes)
        for k, (a, b) in enumerate(zip(*functions, strict=True)):
            np.multiply(hashes, a, out=scratch)
            scratch += b
            out[k, full] = np.minimum.reduceat(scratch, starts)
    return out
