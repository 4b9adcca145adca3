"""The scoring token stream as columns; Python sees nothing but the numerals of a text."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.functions.text import CLITIC_HOSTS, CLITICS, CONTRACTIONS, SPOKEN_SYMBOLS, spell_number

#: White space of any kind but the space.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Typographic marks and what they count as.
MARKS, PLAIN = "‘’“”–—…-/‐‑", "''\"\"       "


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _spelled(numerals: pd.Series) -> pd.Series:
    return numerals.map(lambda some: [spell_number(int(n), len(n)) if int(n) < 1 << 64 else [n] for n in some])


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _replaced(rows: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Rows with `__text` changed where it has something to change: a look is many times cheaper than a replacement."""
    text = F.col("__text")
    for old, new in pairs:
        rows = rows.withColumn("__text", F.when(F.contains(text, F.lit(old)), F.replace(text, F.lit(old), F.lit(new))).otherwise(text))
    return rows


def _expanded(rows: DataFrame, text: Column) -> DataFrame:
    """Rows with `__text`: in lower case, with plain marks, said symbols, single spaces, and contractions in full."""
    rows = _replaced(rows.withColumn("__text", F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS + SPACES, PLAIN + " " * len(SPACES))), SPOKEN_SYMBOLS.items())
    s = F.array_join(_words(F.col("__text")), " ")
    # clitics and the t of a negation belong to the word before, but for words of two bytes; patterns begin with the space, so that they fail at once elsewhere
    s = F.regexp_replace(s, rf" (?<=(?<!\S)(?:{'|'.join(CLITIC_HOSTS)}) )({'|'.join(CLITICS)})(?!\S)", "'$1")
    s = F.regexp_replace(s, r" (?<=\S\Sn |[^\x00-\x7F\s]n )t(?!\S)", "'t")
    return _replaced(rows.withColumn("__text", s), CONTRACTIONS)


def _bare(s: Column) -> Column:
    """Tokens of an expanded text: of each word letters, digits and the apostrophes within."""
    s = F.regexp_replace(s, r"[^\p{L}\p{N}' ]+", "")
    return _words(F.regexp_replace(s, r"(?=')(?:(?<![^ ])'+|'+(?![^ ]))", ""))


def normalized(rows: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Rows with the tokens of a text, as `functions.text.normalize_text` makes them; none for null. Python gets each row's different numerals."""
    parts = _expanded(rows, F.col(text)).withColumn("__tokens", _bare(F.col("__text"))).drop("__text").withColumn("__numerals", F.array_distinct(F.filter("__tokens", lambda w: w.rlike("^[0-9]+$")))).withColumn("__spelled", _spelled("__numerals"))
    # a numeral is looked up by its place: Spark would make a map again for each token
    said = F.flatten(F.transform("__tokens", lambda w: F.coalesce(F.get("__spelled", F.array_position("__numerals", w).cast("int") - 1), F.array(w))))
    return parts.withColumn(out, F.when(F.size("__numerals") == 0, F.col("__tokens")).otherwise(said)).drop("__tokens", "__numerals", "__spelled")
