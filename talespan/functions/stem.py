"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), with the published later change of -bli and -logi."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes and what replaces them, by step.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _kinds(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return _kinds(stem).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, and the last is not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes: list[str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: -len(suffix)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    suffix = _longest(word, ["ed", "ing"])
    if suffix is None or "v" not in _kinds(word[: -len(suffix)]):
        return word
    word = word[: -len(suffix)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _kinds(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def _swap(word: str, table: list[tuple[str, str]]) -> str:
    suffix = _longest(word, [s for s, _ in table])
    if suffix and _measure(word[: -len(suffix)]):
        return word[: -len(suffix)] + dict(table)[suffix]
    return word


def porter(word: str) -> str:
    """Stem of a lower-case word; words with other than a-z and those of two letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    suffix = _longest(word, STEP4)
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """Stems, made once for each different word of a batch."""
    return words.map({w: porter(w) for w in words.unique() if w is not None})
