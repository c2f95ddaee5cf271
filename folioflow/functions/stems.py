"""Word stems by Porter's published steps (1980), for a dictionary of distinct terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes and what they become, by step of the paper. Fixed values.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
LONG_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
SUFFIXES = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST_SUFFIXES = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _sounds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel's run is followed by a consonant's."""
    return _sounds(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last one not w, x or y."""
    return _sounds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, pairs) -> tuple[str, str] | None:
    """(stem, new end) by the longest suffix that the word has."""
    fits = [p for p in pairs if word.endswith(p[0])]
    if not fits:
        return None
    old, new = max(fits, key=lambda p: len(p[0]))
    return word[: len(word) - len(old)], new


def stem(word: str) -> str:
    """The stem of a lower-case word. Words of up to two letters, and those with other signs than a to z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if cut := _longest(word, PLURALS):
        word = "".join(cut)

    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (base := next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)) is not None and "v" in _sounds(base):
        if base.endswith(("at", "bl", "iz")):
            word = base + "e"
        elif len(base) > 1 and base[-1] == base[-2] and _sounds(base)[-1] == "c" and base[-1] not in "lsz":
            word = base[:-1]
        else:
            word = base + "e" if _measure(base) == 1 and _short(base) else base
    if word.endswith("y") and "v" in _sounds(word[:-1]):
        word = word[:-1] + "i"

    for pairs in (LONG_SUFFIXES, SUFFIXES):
        if (cut := _longest(word, pairs)) and _measure(cut[0]) > 0:
            word = "".join(cut)
    if (cut := _longest(word, [(x, "") for x in LAST_SUFFIXES])) and _measure(cut[0]) > 1 and (not word.endswith("ion") or cut[0].endswith(("s", "t"))):
        word = cut[0]

    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(stem)


def stem_dictionary(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term of ``terms`` (term): Python sees every term once, however many rows have it."""
    return terms.select("term").where("term is not null").distinct().withColumn("stem", _stems("term"))
