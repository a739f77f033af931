"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed by each automaton into phrases, each the longest match
from where the last ended; a language that needs few phrases resembles the text. Phrases are normalised to bits a character, as each costs
the logarithm of the labelled text's length; the language of the fewest wins. All automata run in step over many blocks of
text at once, in numpy, so no character is handled alone.

Training takes a bounded sample: about ``TRAIN_DOCUMENTS`` different labelled texts of each language, found by a hash of the text, and
``TRAIN_CHARACTERS`` of their letters at most. These are taken from ``PASSAGES`` parts of each document, at a place in each part that
a hash gives, so ends count as much as openings; passages that mostly repeat others of the language are left out. Each text is parsed
whole, in blocks of ``BLOCK`` characters.

Defined results: a null text or one without letters is ``und`` with score 0; if no row is labelled, so is every text; ties go to the
first language in order; every label is learned, in tables of ``MOST_LANGUAGES`` labels each, and steps of large alphabets are kept sparse, so
memory grows with the labels and the letters learned from; repeated rows are learned from once and predicted each; rows without an id are like
any other, as the id only says which are held out; an empty table gives no rows and a model without languages; other input columns are kept by
``keep_languages`` and ignored by ``identify``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetika.llm import textarrays as ta
from kinetika.session import text_batches

TRAIN_DOCUMENTS = 96
TRAIN_CHARACTERS = 16_000
MOST_LANGUAGES = 64
BLOCK = 1024
PASSAGES = 4
#: Up to so many keys (states x symbols) are kept as one table: 32 MB.
DENSE_KEYS = 1 << 23
#: A passage repeats others if more than half of its stretches of so many characters are known.
REPEAT_CHARACTERS = 16
_RARE = 1


class SuffixAutomaton:
    """The least automaton that accepts every substring of ``symbols``; state 1 is the start, 0 means no way on."""

    def __init__(self, symbols: list[int], alphabet: int) -> None:
        following: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in symbols:
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if not p:
                link[new] = 1
            else:
                q = following[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(following)
                    following.append(dict(following[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and following[p].get(c) == q:
                        following[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.states = len(following)
        edges = [(state * alphabet + c, to) for state, steps in enumerate(following) for c, to in steps.items()]
        self.keys, self.targets = np.array(edges, np.int64).reshape(-1, 2).T


class Transitions:
    """Steps of automata by key, ``state * alphabet + symbol``: a table of all keys where that is small, else a hash table of those there are."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, most: int, dense: int = DENSE_KEYS) -> None:
        self.dense = most <= dense
        if self.dense:
            self.to = np.zeros(most, np.int32)
            self.to[keys] = targets
            return
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):  # the first to come to a free place takes it, the others look at the next
            free = left[self.keys[place[left]] == -1]
            won = free[np.unique(place[free], return_index=True)[1]]
            self.keys[place[won]], self.to[place[won]] = keys[won], targets[won]
            left = np.setdiff1d(left, won)
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """Where each key leads; 0 where there is no such step."""
        if self.dense:
            return self.to[keys]
        flat = keys.ravel()
        place = self._home(flat)
        found = self.keys[place]
        out = np.where(found == flat, self.to[place], 0)
        left = np.flatnonzero((found != flat) & (found != -1))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[place[left]]
            hit = found == flat[left]
            out[left[hit]] = self.to[place[left[hit]]]
            left = left[~hit & (found != -1)]
        return out.reshape(keys.shape)


class LanguageModel:
    """Automata of all languages in one table, or in blocks of ``MOST_LANGUAGES`` with a table each."""

    def __init__(self, samples: dict[str, list[str]], characters: int = TRAIN_CHARACTERS) -> None:
        self.languages = sorted(samples)
        self.blocks: list[LanguageModel] = []
        if len(samples) > MOST_LANGUAGES:
            names = [self.languages[i : i + MOST_LANGUAGES] for i in range(0, len(samples), MOST_LANGUAGES)]
            self.blocks = [LanguageModel({n: samples[n] for n in block}, characters) for block in names]
            return
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.alphabet = len(letters) + 2  # 0: a break between words, 1: a letter that was never seen
        self.letters = np.array([ord(c) for c in letters], np.int64)
        keys, targets, self.bits, self.root = [], [], [], []
        base = 0
        for name in self.languages:
            share = max(1, characters // max(1, len(samples[name])))
            parts = [self.encode(pa.array([t]))[0][: 4 * share] for t in samples[name]]
            text = np.concatenate([p[:share] for p in parts] or [np.zeros(0, np.uint8)])[:characters]
            own = SuffixAutomaton(text.tolist(), self.alphabet)
            known = own.keys % self.alphabet != _RARE
            keys.append(own.keys[known] + base * self.alphabet)
            targets.append(own.targets[known] + base)
            self.root.append(base + 1)
            self.bits.append(np.log2(len(text) + 2))
            base += own.states
        self.steps = Transitions(np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(targets or [np.zeros(0, np.int64)]), base * self.alphabet)
        roots = np.array(self.root, np.int64)[:, None] * self.alphabet
        self.first_steps = self.steps.follow(roots + np.arange(self.alphabet))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, one break for each run of other characters, and the bounds of each text."""
        points, offsets = ta.code_points(texts)
        _, letter, lower = ta.character_tables()
        table = np.full(0x110000, _RARE, np.uint8 if self.alphabet <= 256 else np.uint16)
        table[self.letters] = np.arange(2, self.alphabet)
        table[~letter] = 0
        symbols = table[lower[points]]
        keep = symbols != 0
        if len(keep):
            first = np.zeros(len(keep), bool)
            first[offsets[:-1][offsets[:-1] < len(keep)]] = True
            keep |= np.concatenate([[False], symbols[:-1] != 0]) & ~first
        bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
        return symbols[keep], bounds

    def costs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages: bits a character; and how many letters each text has."""
        if self.blocks:
            found = [block.costs(texts) for block in self.blocks]
            return np.concatenate([cost for cost, _ in found], axis=1), found[0][1]
        symbols, bounds = self.encode(texts)
        counts, n = np.diff(bounds), len(self.languages)
        blocks = -(-counts // BLOCK)
        owner = np.repeat(np.arange(len(counts)), blocks)
        inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[:-1][owner] + inner * BLOCK
        length = np.minimum(bounds[1:][owner] - start, BLOCK)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        roots = np.array(self.root, np.int64)[:, None] * self.alphabet
        state = np.repeat(roots, len(start), axis=1)
        phrases = np.zeros((n, len(start)), np.int32)
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for step, live in enumerate(active.tolist()):
            c = symbols[start[:live] + step].astype(np.int64)
            to = self.steps.follow(state[:, :live] + c)
            stuck = to == 0
            phrases[:, :live] += stuck
            again = self.first_steps[:, c]
            unknown = stuck & (again == 0)
            phrases[:, :live] += unknown
            to = np.where(stuck, np.where(unknown, roots // self.alphabet, again), to)
            np.multiply(to, self.alphabet, out=state[:, :live])
        total = np.zeros((len(counts), n))
        for j in range(n):
            total[:, j] = np.bincount(owner, phrases[j] + 1, len(counts)) * self.bits[j]
        letters = np.concatenate([[0], np.cumsum(symbols != 0)])[bounds]
        return total / np.maximum(counts, 1)[:, None], np.diff(letters)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and bits a character of the language chosen."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        cost, letters = self.costs(texts)
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(cost)), best]
        weight = np.exp2(-2 * (cost - least[:, None]))
        score = np.where(letters > 0, 1 / weight.sum(axis=1), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], score, least


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = TRAIN_DOCUMENTS, characters: int = TRAIN_CHARACTERS, holdout: bool = True) -> LanguageModel:
    """Learn from the labelled rows that aren't held out."""
    known = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).cast("string").alias("_l")).filter(F.col("_t").isNotNull() & F.col("_l").isNotNull())
    if holdout:
        known = known.filter(~F.coalesce(held_out(F.col("_k")), F.lit(False)))
    counts = known.groupBy("_l").agg(F.approx_count_distinct(F.xxhash64("_t")).alias("texts"))
    counts = counts.select("_l", (F.least(F.lit(1.0), documents / F.greatest("texts", F.lit(1))) * (1 << 30)).cast("long").alias("_below")).collect()  # one row a label
    if not counts:
        return LanguageModel({})
    limits = F.broadcast(docs.sparkSession.createDataFrame(counts, "_l string, _below long"))
    place = F.pmod(F.xxhash64("_t"), F.lit(1 << 30))
    share = max(1, characters // (documents * PASSAGES))
    size = F.length("_t")
    parts = F.greatest(F.lit(1), F.least(F.lit(PASSAGES), F.floor(size / share)))
    width = size / parts

    def passage(i: Column) -> Column:
        start = i * width + F.pmod(F.xxhash64("_t", i), F.greatest(F.lit(1), F.floor(width) - share + 1))
        return F.substring("_t", F.floor(start).cast("int") + 1, F.lit(8 * share))

    chosen = F.transform(F.sequence(F.lit(0), parts.cast("int") - 1), passage)
    rows = known.join(limits, "_l").filter(place < F.col("_below")).select("_l", place.alias("_p"), F.posexplode(chosen).alias("_i", "_s")).distinct().collect()  # about documents x PASSAGES x languages
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r._l, r._p, r._i, r._s)):
        samples.setdefault(r._l, []).append(r._s)
    return LanguageModel({name: unrepeated(texts, share)[: 2 * documents * PASSAGES] for name, texts in samples.items()}, characters)


def unrepeated(passages: list[str], share: int) -> list[str]:
    """Passages without those whose first characters mostly stand in earlier ones; the first always stays."""
    known: set[str] = set()
    kept = []
    for p in passages:
        opening = p[: max(share, REPEAT_CHARACTERS)]
        if sum(opening[i : i + REPEAT_CHARACTERS] in known for i in range(max(1, len(opening) - REPEAT_CHARACTERS + 1))) * 2 <= max(1, len(opening) - REPEAT_CHARACTERS + 1):
            kept.append(p)
            known.update(p[i : i + REPEAT_CHARACTERS] for i in range(max(1, len(p) - REPEAT_CHARACTERS + 1)))
    return kept


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``lang_pred``, ``score`` (0 to 1) and ``bits`` (a character, of the language chosen) of every row."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                names, score, bits = shared.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double").withColumnRenamed("doc_id", key)


def keep_languages(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``lang`` as predicted, without the rows whose language is ``und``."""
    text_batches(docs.sparkSession)
    shared, columns, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns, docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, text):
                names = pa.array(shared.value.predict(part.column(text))[0], pa.string())
                yield pa.RecordBatch.from_arrays([names if i == at else part.column(i) for i in range(len(columns))], columns).filter(pc.not_equal(names, "und"))

    return docs.mapInArrow(run, docs.schema)
