"""Action-unit labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard names of the facial action units.
AU_DESCRIPTIONS = {
    "AU01": "Inner Brow Raiser",
    "AU02": "Outer Brow Raiser",
    "AU04": "Brow Lowerer",
    "AU05": "Upper Lid Raiser",
    "AU06": "Cheek Raiser",
    "AU07": "Lid Tightener",
    "AU09": "Nose Wrinkler",
    "AU10": "Upper Lip Raiser",
    "AU12": "Lip Corner Puller",
    "AU14": "Dimpler",
    "AU15": "Lip Corner Depressor",
    "AU17": "Chin Raiser",
    "AU20": "Lip Stretcher",
    "AU23": "Lip Tightener",
    "AU25": "Lips Part",
    "AU26": "Jaw Drop",
    "AU45": "Blink",
}


def au_code(name: Column) -> Column:
    """The first action-unit code in a name, in capitals; null where there is none."""
    return F.upper(F.nullif(F.regexp_extract(name, r"(?i)AU\d{2}", 0), F.lit("")))


def au_label(name: Column) -> Column:
    """``AU12 - Lip Corner Puller`` for a name with a known code; otherwise the name itself."""
    known = F.create_map(*[F.lit(x) for pair in AU_DESCRIPTIONS.items() for x in pair])
    code = au_code(name)
    return F.when(known[code].isNotNull(), F.concat(code, F.lit(" - "), known[code])).otherwise(name)


def extract_au_code(name: str) -> str | None:
    found = re.search(r"AU\d{2}", name, re.IGNORECASE | re.ASCII)
    return found[0].upper() if found else None


def humanise_au_label(name: str) -> str:
    code = extract_au_code(name)
    return f"{code} - {AU_DESCRIPTIONS[code]}" if code in AU_DESCRIPTIONS else name


def humanise_au_labels(names: list[str]) -> list[str]:
    return [humanise_au_label(n) for n in names]


def pair_key(name: Column, label: Column, real_label: str = "real") -> Column:
    """``a__scene`` for a non-real ``a_b__scene__hash``; a real name, or one without a double underscore, stays."""
    parts = F.split(name, "__")
    stem = F.regexp_extract(F.get(parts, F.lit(0)), "^([^_]*)", 1)
    return F.when((label == real_label) | ~name.contains("__"), name).otherwise(F.concat(stem, F.lit("__"), F.get(parts, F.lit(1))))
