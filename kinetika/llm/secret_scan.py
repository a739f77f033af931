"""Secret scan: fixed patterns, and a battery of randomness tests. All of it in DataFrame expressions.

Three base kinds are matched by pattern. Beside them every run of 20 or more characters of the usual encodings that holds a letter and a
digit is a candidate: runs of letters and digits alone, with ``+`` and ``/``, and with ``-`` and ``_``, so that a token is also tested
without the path or name it stands in. Of candidates found inside one another the outer one is reported. The encoding is inferred from the
characters present (hex, base32, base36 of one case, base62, base64 or base64url), and five tests hold it against what random data in that
encoding would look like: chi-squared uniformity over the alphabet, the same over pooled character classes, the number of runs above and
below the middle of the alphabet, the number of runs of digits and of others, and the lag-one serial correlation. The least of the
five p-values, times five, says how random a candidate looks.

A discovery is a random token among ordinary text, so ordinary text is the null hypothesis. The corpus's whole text without its
candidates, squeezed to letters and digits and cut into stretches that end with a number, goes through the same battery. Their counts by length class, encoding and
outcome give every candidate a p-value: how often ordinary text of this length class looks like that encoding and as random. Within each
length class Benjamini-Hochberg over all candidates holds the rate of false discoveries at ``FALSE_DISCOVERY``, so short tokens, on
which the tests are weak, compete with short ones alone. A corpus with too little text to tell reports none.

Defined results: a null or empty text has no spans; repeated rows give repeated results and count as often; a run that mixes the marks of two
encodings is cut at those of either; very long texts and tokens are searched and tested whole; an empty table gives no rows; other
input columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetika.session import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+"
LEAST_SECRET = 6
LEAST_CANDIDATE = 20
FALSE_DISCOVERY = 0.01
#: The battery rejects randomness under this p-value.
RANDOM_LEVEL = 0.001
#: Length classes begin at so many characters.
CLASS_STARTS = (20, 32, 48, 80)
_PART = 1000
_BIN, _BINS = 4, 400
#: The last bin that isn't rejected.
LAST_BIN = int(-math.log(RANDOM_LEVEL) * _BIN)
#: So many stretches of ordinary text are cut out at once, and then one by one.
_TOGETHER = 64
_SPANS = "array<struct<class:int,encoding:int,bin:int>>"
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": _DIGIT + "abcdef", "base32": _UPPER + "234567", "base36": _DIGIT + _LOWER, "base62": _UPPER + _LOWER + _DIGIT, "base64": _UPPER + _LOWER + _DIGIT + "+/", "base64url": _UPPER + _LOWER + _DIGIT + "-_"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stretch(marks: str) -> str:
    """Runs of letters, digits and ``marks`` that are long enough for a candidate."""
    return rf"(?<![A-Za-z0-9{marks}])[A-Za-z0-9{marks}]{{{LEAST_CANDIDATE},}}+=*+"


def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` from left to right, without overlap: structs of start (code points) and the matched string.

    Starts are running sums over the n matches, taken in about sqrt(n) parts of as many, so no array grows match by match.
    """
    kind = "array<struct<start:int,token:string>>"

    def width(pair: Column) -> Column:
        return pair["gap"] + F.length(pair["token"])

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        return F.struct((begin + F.length(pair["token"])).alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), pair["token"].alias("token")))).alias("out"))

    def within(part: Column, first: Column) -> Column:
        return F.aggregate(part, F.struct(first.alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])

    def firsts(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(parts, begin, lambda s, p: F.struct((s["at"] + F.aggregate(p, F.lit(0), lambda a, x: a + width(x))).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def placed(pairs: Column) -> Column:
        n = F.size(pairs) - 1  # the last is what follows the last match

        def cut(size: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(pairs, i * size + 1, F.least(size, n - i * size)))
            return _let(parts, lambda parts: F.flatten(F.zip_with(parts, firsts(parts), within)))

        return _let(F.ceil(F.sqrt(n)).cast("int"), cut)

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, t: F.struct(F.length(g).alias("gap"), t.alias("token")))
    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(F.array().cast(kind))


def _span(start: Column, token: Column) -> Column:
    """A token with its place, length class, encoding and how random it looks (in bins); without encoding, that is null."""
    return _let(randomness(token), lambda r: F.struct(start.alias("start"), (start + F.length(token)).alias("end"), length_class(F.length(token)).alias("class"), r["encoding"].alias("encoding"), _bin(r["p"]).alias("bin")))


def candidates(text: Column) -> Column:
    """By run: ``marked``, its stretches with ``-`` or ``_``, and ``plain``, its stretches of letters, digits, ``+`` and ``/``; a stretch that
    holds ``+`` or ``/`` has those of letters and digits alone as ``inner``. Texts are searched once, and then only the runs found."""

    def spans(found: Column, first: Column) -> Column:
        return F.transform(found, lambda m: _span(first + m["start"], m["token"]))

    def of_run(run: Column) -> Column:
        marked = F.filter(located(run["token"], stretch("_-")), lambda m: m["token"].rlike("[_-]"))

        def with_inner(m: Column) -> Column:
            first = run["start"] + m["start"]
            inner = F.when(m["token"].rlike("[+/]"), spans(located(m["token"], stretch("")), first))
            return F.struct(_span(first, m["token"]).alias("whole"), inner.alias("inner"))

        return F.struct(spans(marked, run["start"]).alias("marked"), F.transform(located(run["token"], stretch("+/")), with_inner).alias("plain"))

    return F.transform(located(text, CANDIDATE), of_run)


def reported(runs: Column, is_found: Callable[[Column], Column]) -> Column:
    """Of ``candidates`` those that ``is_found``, without those that lie inside another that is."""

    def of_run(run: Column) -> Column:
        def with_marked(marked: Column) -> Column:
            def free(s: Column) -> Column:
                return is_found(s) & ~F.exists(marked, lambda m: (m["start"] <= s["start"]) & (m["end"] >= s["end"]))

            def of_plain(p: Column) -> Column:
                return F.when(is_found(p["whole"]), F.filter(F.array(p["whole"]), free)).otherwise(F.filter(F.coalesce(p["inner"], F.slice(F.array(p["whole"]), 1, 0)), free))

            return F.concat(marked, F.flatten(F.transform(run["plain"], of_plain)))

        return _let(F.filter(run["marked"], is_found), with_marked)

    return F.flatten(F.transform(runs, of_run))


def _numbered(length: int, digits: int) -> bool:
    """Does the test of digit runs alone reject ``length`` characters whose last ``digits`` are their only digits? Clearly, so rounding doesn't matter."""
    mean = 1 + 2 * digits * (length - digits) / length
    z = (2 - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (length - 1), 1e-9))
    return 5 * math.erfc(abs(z) / math.sqrt(2)) < 0.8 * math.exp(-(LAST_BIN + 1) / _BIN)


def ordinary(text: Column) -> Column:
    """How random ordinary text looks: ``stretches``, how many there are by length class, and ``close``, structs of length class, encoding and
    bin of those that the battery doesn't reject.

    The whole text, without candidates and all but letters and digits, is cut for each class into stretches that have the least length of the
    class when the number of characters of the text ends each, as names with numbers do; what is left at the end is shorter than a
    stretch. Letters with nothing but a number of three digits at their end are rejected by the runs of digits alone, so these are only counted.
    """
    squeezed = F.regexp_replace(F.regexp_replace(text, CANDIDATE, " "), "[^A-Za-z0-9]+", "")

    def of_class(t: Column, i: int, least: int) -> Column:
        width = F.lit(least) - F.length(t["number"])
        one = F.concat(F.lit(".{"), width.cast("string"), F.lit("}"))
        many = F.concat(F.lit(".{"), width.cast("string"), F.lit(","), (width * _TOGETHER).cast("string"), F.lit("}"))
        rejected = F.length(t["number"]).isin([d for d in range(1, 11) if _numbered(least, d)])

        def tested(token: Column) -> Column:
            return _let(randomness(F.concat(token, t["number"])), lambda r: F.struct(F.lit(i).alias("class"), r["encoding"].alias("encoding"), _bin(r["p"]).alias("bin")))

        def of_part(part: Column) -> Column:
            open_ = F.filter(F.regexp_extract_all(part, one, F.lit(0)), lambda x: ~rejected | x.rlike("[0-9]"))
            return F.when(~rejected | part.rlike("[0-9]"), F.filter(F.transform(open_, tested), lambda x: x["bin"] <= LAST_BIN)).otherwise(F.array().cast(_SPANS))

        return F.flatten(F.transform(F.regexp_extract_all(t["text"], many, F.lit(0)), of_part))

    def of_text(t: Column) -> Column:
        counts = [F.floor(F.length(t["text"]) / (least - F.length(t["number"]))).cast("long") for least in CLASS_STARTS]
        return F.struct(F.array(*counts).alias("stretches"), F.concat(*[of_class(t, i, least) for i, least in enumerate(CLASS_STARTS)]).alias("close"))

    return _let(F.struct(squeezed.alias("text"), F.length(text).cast("string").alias("number")), of_text)


def _two_sided(z: Column) -> Column:
    """The normal tail on both sides, by Abramowitz and Stegun's 7.1.26."""

    def tail(x: Column) -> Column:
        def poly(t: Column) -> Column:
            return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))

        return _let(1 / (1 + 0.3275911 * x), poly) * F.exp(-x * x)

    return _let(F.least(F.abs(z) / F.lit(2**0.5), F.lit(26.0)), tail)


def _upper_chi2(value: Column, df: Column) -> Column:
    """The upper tail of chi-squared, by Wilson and Hilferty."""
    z = (F.pow(value / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return _let(z, lambda z: _let(_two_sided(z) / 2, lambda half: F.when(z > 0, half).otherwise(1 - half)))


def _count(token: Column, characters: str) -> Column:
    return F.length(token) - F.length(F.translate(token, characters, ""))


_POOLS = {"digit": _DIGIT, "lower": _LOWER, "upper": _UPPER}


def _encoding(name: str, fold: bool = False) -> Column:
    """What the tests need to know of an alphabet; ``fold``: capitals count as small letters."""
    alphabet = ALPHABETS[name]
    k = len(alphabet)
    shares = {pool: len(set(characters) & set(alphabet)) / k for pool, characters in _POOLS.items()}
    rest = 1 - sum(shares.values())
    values = {"alphabet": alphabet, "halves": "0" * (k // 2) + "1" * (k - k // 2), "k": float(k), **shares, "rest": rest if rest > 1e-9 else 0.0, "df": float(sum(x > 0 for x in shares.values()) - (rest <= 1e-9)), "fold": fold, "place": list(ALPHABETS).index(name)}
    return F.struct(*[F.lit(v).alias(n) for n, v in values.items()])


def _test(s: Column, e: Column) -> Column:
    """The least p-value of the five tests, times five; one expression for all encodings ``e``."""
    n, k = F.length(s).cast("double"), e["k"]
    letters = F.split(F.when(n <= k, s).otherwise(e["alphabet"]), "")  # each is counted once, those of a short token alone
    squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a + F.pow(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
    uniform = _upper_chi2(F.greatest(k / n * squares - n, F.lit(0.001)), k - 1)
    seen = {pool: _count(s, characters) for pool, characters in _POOLS.items()}
    cells = [(seen[pool], e[pool]) for pool in _POOLS] + [(n - sum(seen.values()), e["rest"])]
    pooled_value = sum(F.when(share > 0, F.pow(o - share * n, F.lit(2.0)) / (share * n)).otherwise(0.0) for o, share in cells)
    pooled = _upper_chi2(F.greatest(pooled_value, F.lit(0.001)), e["df"])

    def by_runs(r: Column) -> Column:
        ones, mean = r["ones"], 1 + 2 * r["ones"] * (n - r["ones"]) / n
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        return F.when((ones == 0) | (ones == n), F.pow(F.lit(2.0), 1 - n)).otherwise(_two_sided((r["runs"] - mean) / spread))

    def counted(half: Column) -> Column:
        ones = F.length(F.replace(half, F.lit("0"), F.lit(""))).cast("double")
        runs = F.length(F.regexp_replace(F.regexp_replace(half, "1+", "1"), "0+", "0")).cast("double")
        return _let(F.struct(ones.alias("ones"), runs.alias("runs")), by_runs)

    block = F.regexp_replace(F.regexp_replace(s, "[^0-9]+", "a"), "[0-9]+", "0")
    digits = _let(F.struct(seen["digit"].cast("double").alias("ones"), F.length(block).cast("double").alias("runs")), by_runs)
    # Characters are taken ``_PART`` at a time, so a token of many millions makes no array of as many.
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("sp"), F.lit(None).cast("double").alias("last"))
    grown = lambda a, v: F.struct((a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"), (a["sp"] + F.coalesce(v * a["last"], F.lit(0.0))).alias("sp"), v.alias("last"))
    each = lambda a, c: _let((F.call_function("instr", e["alphabet"], c) - 1).cast("double"), lambda v: grown(a, v))
    sums = F.aggregate(F.regexp_extract_all(s, F.lit(f".{{1,{_PART}}}"), F.lit(0)), start, lambda a, part: F.aggregate(F.split(part, ""), a, each))

    value = lambda c: (F.call_function("instr", e["alphabet"], c) - 1).cast("double")
    serially = _let(sums, lambda t: _serial_p(t, value(F.left(s, F.lit(1))) + value(F.right(s, F.lit(1))), n))
    return F.least(F.lit(1.0), 5 * F.least(uniform, pooled, _let(F.call_function("translate", s, e["alphabet"], e["halves"]), counted), digits, serially))


def randomness(token: Column) -> Column:
    """``p``, the p-value of a candidate under the hypothesis that it is random, and ``encoding``, its place in ``ALPHABETS``; null if it has none."""
    bare = F.rtrim(token, F.lit("="))
    encoding = (
        F.when(~bare.rlike("[0-9]") | ~bare.rlike("[A-Za-z]") | (F.length(bare) < LEAST_CANDIDATE), None)
        .when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), _encoding("hex", True))
        .when(bare.rlike("^[A-Z2-7]+$"), _encoding("base32"))
        .when(bare.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), _encoding("base36", True))
        .when(bare.rlike("^[A-Za-z0-9]+$"), _encoding("base62"))
        .when(bare.rlike("^[A-Za-z0-9+/]+$"), _encoding("base64"))
        .when(bare.rlike("^[A-Za-z0-9_-]+$"), _encoding("base64url"))
    )

    def tested(t: Column) -> Column:
        p = F.when(t["e"].isNotNull(), _let(F.when(t["e"]["fold"], F.lower(t["s"])).otherwise(t["s"]), lambda s: _test(s, t["e"])))
        return F.struct(t["e"]["place"].alias("encoding"), p.alias("p"))

    return _let(F.struct(bare.alias("s"), encoding.alias("e")), tested)


def _serial_p(t: Column, ends: Column, n: Column) -> Column:
    mean = t["s"] / n
    above = t["sp"] - mean * (2 * t["s"] - ends) + (n - 1) * mean * mean
    below = t["ss"] - n * mean * mean
    r = F.when(below <= 1e-9, F.lit(1.0)).otherwise(above / F.greatest(below, F.lit(1e-9)))
    return _two_sided((r + 1 / n) * F.sqrt(n))


def length_class(length: Column) -> Column:
    return sum((length >= edge).cast("int") for edge in CLASS_STARTS[1:])


def _bin(p: Column) -> Column:
    return F.when(p.isNotNull(), F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * _BIN), F.lit(_BINS)).cast("int"))


def _counts(spans: DataFrame) -> np.ndarray:
    """Length classes x encodings x bins: how many spans. Those without an encoding stand in the last."""
    out = np.zeros((len(CLASS_STARTS), len(ALPHABETS) + 1, _BINS + 1), np.int64)
    for r in spans.groupBy("class", "encoding", "bin").count().collect():  # one row a cell at most
        out[r["class"], len(ALPHABETS) if r.encoding is None else r.encoding, _BINS if r.bin is None else r.bin] += r["count"]
    return out


def ordinary_p(plain: np.ndarray) -> np.ndarray:
    """By encoding and bin, the p-value of a token under the hypothesis that it is ordinary text.

    ``plain`` counts the ordinary stretches of one length class. A cell is as rare as there are few stretches of its encoding that look as
    random or more so; the p-value is the share of stretches in cells as rare as this one, with one added to both counts. What the battery
    holds not to be random, at ``RANDOM_LEVEL``, and what has no encoding has p-value 1.
    """
    last = LAST_BIN
    tail = np.cumsum(plain[:-1, : last + 1], axis=1)
    order = np.argsort(tail, axis=None, kind="stable")
    rarity, held = tail.ravel()[order], np.cumsum(plain[:-1, : last + 1].ravel()[order])
    within = held[np.searchsorted(rarity, tail.ravel(), side="right") - 1].reshape(tail.shape)
    out = np.ones(plain.shape)
    out[:-1, : last + 1] = (1 + within) / (1 + plain.sum())
    return out


def discovery_limits(found: np.ndarray, plain: np.ndarray, rate: float = FALSE_DISCOVERY) -> np.ndarray:
    """For each length class and encoding the last bin that counts as random, or -1: Benjamini-Hochberg within each length class.

    ``found`` and ``plain`` count candidates and stretches of ordinary text by length class, encoding and bin.
    """
    limits = np.full((found.shape[0], found.shape[1] - 1), -1)
    for c in range(len(found)):
        p, total = ordinary_p(plain[c]), found[c].sum()
        order = np.argsort(p, axis=None, kind="stable")
        values, reached = p.ravel()[order], np.cumsum(found[c].ravel()[order])
        last = np.searchsorted(values, values, side="right") - 1  # equal p-values stand together
        good = (values * total <= rate * reached[last]) & (values < 1)
        if total and good.any():
            limits[c] = [np.flatnonzero(row <= values[good].max()).max(initial=-1) for row in p[:-1]]
    return limits


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """Per row: the key, ``spans`` (array of kind, start, end, by start and then by kind) and ``base`` (those of the base kinds)."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def spans(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["token"])).alias("end")))

    assign = F.filter(located(whole, ASSIGN), lambda m: F.length(F.regexp_extract(m["token"], ASSIGN, 2)) >= LEAST_SECRET)
    tested = materialize(
        docs.select(
            F.col(key).alias("_key"), F.concat(spans(assign, 0), spans(located(whole, ACCESS), 1), spans(located(whole, HEX), 2)).alias("base"),
            candidates(whole).alias("runs"), ordinary(whole).alias("ordinary"),
        ),
        "secret-candidates",
    )
    every = F.flatten(F.transform("runs", lambda r: F.concat(r["marked"], F.flatten(F.transform(r["plain"], lambda p: F.concat(F.array(p["whole"]), F.coalesce(p["inner"], F.slice(F.array(p["whole"]), 1, 0))))))))
    found = _counts(tested.filter(F.size("runs") > 0).select(F.explode(every).alias("s")).select("s.class", "s.encoding", "s.bin"))
    plain = _counts(tested.filter(F.size("ordinary.close") > 0).select(F.explode("ordinary.close").alias("s")).select("s.class", "s.encoding", "s.bin"))
    stretches = tested.agg(*[F.coalesce(F.sum(F.get("ordinary.stretches", F.lit(i))), F.lit(0)) for i in range(len(CLASS_STARTS))]).first()
    plain[:, -1, -1] += np.array(stretches) - plain.sum(axis=(1, 2))  # the others are rejected or have no encoding
    limit = F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in discovery_limits(found, plain, rate)])
    random = F.transform(
        reported(F.col("runs"), lambda s: F.coalesce(s["bin"] <= F.get(F.get(limit, s["class"]), s["encoding"]), F.lit(False))),
        lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")),
    )

    def named(spans: Column) -> Column:
        names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "random")])
        return F.transform(F.array_sort(spans), lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return tested.select(F.col("_key").alias(key), named(F.concat("base", random)).alias("spans"), named(F.col("base")).alias("base"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs, key, text).select(key, count("assign"), count("access"), count("hex"), F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
