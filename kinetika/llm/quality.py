"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded by a learned layer over its hashed n-grams: one to three
characters, and one and two words, counted in ``CHARACTER_PLACES`` and ``WORD_PLACES`` places, with a few shares of kinds of characters
beside them. Gated attention weighs the passages, and the weighted passage representation is scored. Encoder, attention and score are
learned together from document labels alone, so the attention finds which passages decide.

Training takes a bounded sample: about ``TRAIN_ROWS`` labelled rows, found by a hash of the id, and of each at most
``TRAIN_PASSAGES`` passages, spread evenly over the whole text. Every text is scored whole.

Defined results: a text without words is one passage of all its characters; a null text counts as empty; without labels every score is 0.5;
a row labelled more than once counts with its mean label; of rows that repeat an id, that with the least text hash is learned from, and each
is scored by its own text; rows without an id or label aren't learned from; a very long text is encoded in blocks of passages; an empty
table gives no rows; the other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetika.llm import textarrays as ta
from kinetika.session import text_batches

PASSAGE_WORDS = 48
TRAIN_ROWS = 4_000
TRAIN_PASSAGES = 64
THRESHOLD = 0.3
CHARACTER_PLACES, WORD_PLACES, SHARES = 512, 512, 8
FEATURES = CHARACTER_PLACES + WORD_PLACES + SHARES
HIDDEN, GATES = 16, 8
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.005, 1e-3
#: Passages that are encoded at once.
BLOCK = 4096
_U64 = np.uint64
_FACTORS = (_U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F), _U64(0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 0 other letter, 1 capital, 2 digit, 3 white space, 4 any other sign."""
    word, letter, lower = ta.character_tables()
    out = np.full(len(word), 4, np.uint8)
    out[letter] = 0
    out[letter & (lower != np.arange(len(lower)))] = 1
    out[word & ~letter] = 2
    out[[c for c in range(0x3001) if chr(c).isspace()]] = 3
    return out


def _places(grams: np.ndarray, places: int, first: int) -> np.ndarray:
    return (ta.mix(grams) & _U64(places - 1)).astype(np.int64) + first


class Passages:
    """The passages of a batch of texts: where they begin and end, and their features block by block."""

    def __init__(self, texts: pa.Array, size: int = PASSAGE_WORDS) -> None:
        self.hashes, of_text, self.points, offsets = ta.word_hashes(texts)
        starts, ends, _ = ta.words(self.points, offsets)
        self.length = (ends - starts).astype(np.float64)
        n_words = np.diff(of_text)
        counts = np.maximum(1, n_words // size)  # the last takes what is left over
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(self.bounds[-1]) - self.bounds[:-1][owner]
        place = np.concatenate([starts, [len(self.points)]])
        self.first = of_text[:-1][owner] + inner * size
        self.last = np.where(inner + 1 == counts[owner], of_text[1:][owner], self.first + size)
        self.begin = np.where(inner == 0, offsets[:-1][owner], place[np.minimum(self.first, len(starts))])
        self.end = np.where(inner + 1 == counts[owner], offsets[1:][owner], place[np.minimum(self.last, len(starts))])
        self.text_end, self.word_end = offsets[1:][owner], of_text[1:][owner]

    def counts(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of passages ``a`` to ``b``: counts of n-grams by place (at most 255), and shares."""
        n, width = b - a, CHARACTER_PLACES + WORD_PLACES
        low, high = (int(self.begin[a]), int(self.end[b - 1])) if n else (0, 0)
        row = np.repeat(np.arange(n), (self.end - self.begin)[a:b]) * width
        points = np.concatenate([self.points[low : high + 2].astype(_U64) + _U64(1), np.zeros(2, _U64)])
        stop, at = np.repeat(self.text_end[a:b], (self.end - self.begin)[a:b]), np.arange(low, high)
        gram, cells = np.zeros(high - low, _U64), []
        for j in range(3):  # grams that would run into the next text don't count
            gram = gram + points[j : j + high - low] * _FACTORS[j]
            inside = at + j < stop
            cells.append((row + _places(gram, CHARACTER_PLACES, 0))[inside])
        w_low, w_high = (int(self.first[a]), int(self.last[b - 1])) if n else (0, 0)
        own = np.repeat(np.arange(n), (self.last - self.first)[a:b])
        word = self.hashes[w_low:w_high]
        cells.append(own * width + _places(word, WORD_PLACES, CHARACTER_PLACES))
        following = np.concatenate([self.hashes[w_low + 1 : w_high + 1], np.zeros(1, _U64)])[: len(word)]
        inside = np.arange(w_low, w_high) + 1 < np.repeat(self.word_end[a:b], (self.last - self.first)[a:b])
        cells.append((own * width + _places(word * _FACTORS[1] + following, WORD_PLACES, CHARACTER_PLACES))[inside])
        counted = np.minimum(np.bincount(np.concatenate(cells), minlength=n * width), 255).astype(np.uint8).reshape(n, width)

        kind, chars = _kinds()[self.points[low:high]], np.maximum((self.end - self.begin)[a:b], 1)
        shares = [np.bincount(row[kind == k] // width, minlength=n) / chars for k in range(1, 5)]
        words = np.maximum((self.last - self.first)[a:b], 1)
        known = own[np.unique(ta.mix(word + own.astype(_U64) * _FACTORS[2]), return_index=True)[1]]
        shares += [np.bincount(known, minlength=n) / words, np.bincount(own, self.length[w_low:w_high], n) / words / 10, np.log1p(words) / 4, ((self.last - self.first)[a:b] == 0).astype(float)]
        return counted, np.stack(shares, axis=1).astype(np.float32)


def features(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Square roots of the shares of n-grams, for characters and for words, and the other shares."""
    out = np.empty((len(counts), FEATURES), np.float32)
    for a, b in ((0, CHARACTER_PLACES), (CHARACTER_PLACES, CHARACTER_PLACES + WORD_PLACES)):
        part = counts[:, a:b].astype(np.float32)
        out[:, a:b] = np.sqrt(part / np.maximum(part.sum(axis=1, keepdims=True), 1))
    out[:, -SHARES:] = shares
    return out


def _segments(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1], axis=0)


class AttentionModel:
    """Encoder, gated attention and score of a bag of passages."""

    def __init__(self, features: int = FEATURES, seed: int = 4, hidden: int = HIDDEN, gates: int = GATES) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features, np.float32), np.ones(features, np.float32)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {
            "W": draw(features**-0.5, features, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden**-0.5, hidden, gates),
            "U": draw(hidden**-0.5, hidden, gates), "w": draw(gates**-0.5, gates), "c": draw(hidden**-0.5, hidden), "d": np.zeros(1, np.float32),
        }

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The learned representation of passages, from their standardised features."""
        return np.tanh(x @ self.weights["W"] + self.weights["b"])

    def attend(self, h: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        e = np.exp(e - np.maximum.reduceat(e, bounds[:-1])[bag])
        a = e / _segments(e, bounds)[bag]
        z = _segments(a[:, None] * h, bounds)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "p": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def loss(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> float:
        """The mean cross-entropy of the labels."""
        p = self.attend(self.encode(x), bounds)["p"]
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    def slopes(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of ``loss`` by every weight."""
        f, p = self.attend(self.encode(x), bounds), self.weights
        h, t, s, a, bag = f["h"], f["t"], f["s"], f["a"], f["bag"]
        do = (f["p"] - y) / len(y)
        dz = (do[:, None] * p["c"])[bag]
        da = (dz * h).sum(axis=1)
        de = a * (da - _segments(a * da, bounds)[bag])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ do, "d": np.array([do.sum()])}

    def fit(self, counts: np.ndarray, shares: np.ndarray, bounds: np.ndarray, y: np.ndarray, seed: int = 5) -> AttentionModel:
        """Adam on the cross-entropy, ``EPOCHS`` times over all documents in batches of ``BATCH``."""
        total, squares = np.zeros(FEATURES), np.zeros(FEATURES)
        for a in range(0, len(counts), BLOCK):
            x = features(counts[a : a + BLOCK], shares[a : a + BLOCK]).astype(np.float64)
            total, squares = total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        mean = total / len(counts)
        self.mean, self.scale = mean.astype(np.float32), np.maximum(np.sqrt(np.maximum(squares / len(counts) - mean * mean, 0)), 1e-3).astype(np.float32)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        rng, step = np.random.default_rng(seed), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                docs, step = order[at : at + BATCH], step + 1
                rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
                own = np.concatenate([[0], np.cumsum(np.diff(bounds)[docs])])
                slope = self.slopes(self.standard(features(counts[rows], shares[rows])), own, y[docs].astype(np.float32))
                for k, g in slope.items():
                    g = (g + DECAY * self.weights[k]).astype(np.float32)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = (self.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, passages: Passages) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text and the attention weight of each passage."""
        n = int(passages.bounds[-1])
        if len(passages.bounds) < 2:
            return np.zeros(0), np.zeros(0)
        h = np.concatenate([self.encode(self.standard(features(*passages.counts(a, min(a + BLOCK, n))))) for a in range(0, n, BLOCK)])
        f = self.attend(h.astype(np.float64), passages.bounds)
        return f["p"], f["a"]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> AttentionModel | None:
    """Learn from about ``rows`` labelled documents that aren't held out; None where there are none."""
    known = labels.select(F.col(key).cast("long").alias("_k"), F.col(label).cast("double").alias("_y")).filter(F.col("_k").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_k")))
    known = known.groupBy("_k").agg(F.avg("_y").alias("_y"))
    count = known.count()
    if count > rows:
        known = known.filter(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int(rows / count * (1 << 30)))
    sample = known.collect()  # about ``rows``
    if not sample:
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r._k, r._y) for r in sample], "_k long, _y double")
    of_id = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(wanted), "_k")
    picked = of_id.groupBy("_k", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("_k", "_y", F.col("least.text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                found = Passages(part.column("text"))
                counts, shares = [], []
                for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
                    chosen = np.unique(np.linspace(a, b - 1, min(b - a, TRAIN_PASSAGES)).astype(np.int64))
                    runs = np.split(chosen, np.flatnonzero(np.diff(chosen) > 1) + 1)
                    made = [found.counts(int(r[0]), int(r[-1]) + 1) for r in runs]
                    counts.append(b"".join(c.tobytes() for c, _ in made))
                    shares.append(b"".join(s.tobytes() for _, s in made))
                yield pa.RecordBatch.from_arrays([part.column("_k"), part.column("_y"), pa.array(counts, pa.binary()), pa.array(shares, pa.binary())], ["_k", "_y", "counts", "shares"])

    found = sorted(picked.select("_k", "_y", "text").mapInArrow(encode, "_k long, _y double, counts binary, shares binary").collect(), key=lambda r: r._k)  # rows x TRAIN_PASSAGES passages at most
    if not found:
        return None
    shares = [np.frombuffer(r.shares, np.float32).reshape(-1, SHARES) for r in found]
    counts = np.frombuffer(b"".join(r.counts for r in found), np.uint8).reshape(-1, CHARACTER_PLACES + WORD_PLACES)
    return AttentionModel().fit(counts, np.concatenate(shares), np.cumsum([0, *(len(v) for v in shares)]), np.array([r._y for r in found]))


def score(docs: DataFrame, model: AttentionModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``score`` (0 to 1, higher: better) of every row."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                scores = shared.value.score(Passages(part.column("text")))[0] if shared.value else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double").withColumnRenamed("doc_id", key)
