"""Quality rules by distribution divergence, in DataFrame functions alone.

Two references are counted over all documents of a language: the shares of character classes, and
the shares of its `common_words` most frequent words (all other words in one more bin). A
document's own histograms are compared to them by Jensen-Shannon distance (base 2, 0 to 1). Guards
leave out comparisons that short texts can't carry: the class distance needs `min_chars` characters
in words, the word distance `min_words` words.

Defined results: null text is like empty text, without words, and fails the base rules; a null lang is a language
of its own; repeated rows count and are judged each by itself; a language with a single document is
its own reference. With no documents there are no rows. Other columns are dropped by `judged()`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespan.runtime import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COMMON_WORDS = 16
#: Distances above these reject a document.
MAX_CLASS_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.30
#: Guards: characters in words, and words, below which a distance is not judged.
GUARD_CHARS = 200
GUARD_WORDS = 100
#: Languages up to which the references are broadcast (each is well under 2 kB); beyond, they are joined.
BROADCAST_LANGUAGES = 4096

_SPACE = " \t\n\x0b\x0c\r"
#: Classes of characters: capitals, digits, symbols, punctuation, beyond ASCII, white space, the rest.
_CLASSES = {"capital": "[A-Z]", "digit": "[0-9]", "punct": "[.,;:!?'\"()-]", "beyond": "[^\\x00-\\x7F]"}
_TAGS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def common_words(documents: DataFrame, n: int = COMMON_WORDS) -> DataFrame:
    """lang, ref_words, ref_counts (the last for all other words), from every word of every document."""
    words = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words_of(F.coalesce("text", F.lit("")))).alias("word"))
    counted = words.groupBy("lang", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    top = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= n)
    first = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    return first.select("lang", F.col("top.word").alias("ref_words"), F.col("top.n").alias("ref_counts"))


def _joined(documents: DataFrame, references: DataFrame) -> DataFrame:
    """Left join by lang; the references are materialised, so their size is known before the join."""
    small = references.count() <= BROADCAST_LANGUAGES
    return documents.join(F.broadcast(references) if small else references, "lang", "left")


def measures(documents: DataFrame, references: DataFrame) -> DataFrame:
    """One row a document: counts for the base rules, class counts and common-word counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = _joined(documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text")), references)
    one = base.withColumn("w", words_of(F.col("text"))).withColumn("n", F.size("w"))
    three = F.expr("transform(sequence(0, n - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))")
    two = one.withColumn("grams", F.when(F.col("n") >= 3, three).otherwise(F.expr("cast(array() as array<bigint>)")))
    # A hash of three words with the place in its low bits: equal windows are neighbours once sorted.
    packed = F.expr("sort_array(transform(grams, (g, i) -> (g & -shiftleft(1L, length(bin(n)))) | i))")
    some = two.withColumn("m", F.expr("shiftleft(1L, length(bin(n)))")).withColumn("s", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), packed))
    same = "filter(s, (x, j) -> coalesce((x & -m) = (get(s, j - 1) & -m), false) or coalesce((x & -m) = (get(s, j + 1) & -m), false))"
    places = f"array_sort(transform({same}, x -> x & (m - 1)))"
    covered = f"aggregate({places}, named_struct('last', -3L, 'sum', 0L), (a, p) -> named_struct('last', p, 'sum', a.sum + least(3L, p - a.last)), a -> a.sum)"
    lines = F.expr(f"filter(split(text, '\\n', -1), l -> btrim(l, '{''.join(f'\\u{ord(c):04x}' for c in _SPACE)}') != '')")
    tags = F.expr(f"array_join(transform(w, x -> substring('{_TAGS}', 1 + array_position(ref_words, lower(x)), 1)), '')")
    wide = some.withColumn("lines", lines).withColumn("tags", tags)
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    hist = F.expr(f"transform(sequence(1, size(ref_words)), k -> cast(char_length(tags) - char_length(replace(tags, substring('{_TAGS}', 1 + k, 1), '')) as bigint))")
    return wide.select(
        "doc_id", "lang", F.col("n").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), F.char_length("text").cast("long").alias("chars"), count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(F.expr(covered)).alias("n_repeat_words"),
        *(count(p).alias(f"n_{k}") for k, p in _CLASSES.items()), hist.alias("word_hist"), "ref_words", "ref_counts",
    )


def class_counts() -> Column:
    space = F.col("chars") - F.col("word_chars")
    named = [F.col("n_capital"), F.col("n_digit"), F.col("n_symbols"), F.col("n_punct"), F.col("n_beyond"), space]
    rest = F.col("chars")
    for c in named:
        rest = rest - c
    return F.array(*named, rest)


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts of equal length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x / total(a)).alias("p"), (y / total(b)).alias("q")))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    summed = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + term(v["p"], (v["p"] + v["q"]) / 2) + term(v["q"], (v["p"] + v["q"]) / 2))
    return F.sqrt(F.greatest(summed / 2, F.lit(0.0)))


def judged(documents: DataFrame, common: int = COMMON_WORDS, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, guard_chars: int = GUARD_CHARS, guard_words: int = GUARD_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances (-1 where a guard holds) and kept."""
    found = materialize(measures(documents, materialize(common_words(documents, common))).withColumn("classes", class_counts()))
    n = len(_CLASSES) + 3
    shares = materialize(found.groupBy("lang").agg(F.array(*(F.sum(F.col("classes")[i]) for i in range(n))).alias("ref_classes"), F.sum("n_words").alias("ref_n_words")))
    both = _joined(found, shares)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    own = F.concat("word_hist", F.array(F.col("n_words") - total(F.col("word_hist")))).alias("own")
    ref = F.concat("ref_counts", F.array(F.col("ref_n_words") - total(F.col("ref_counts")))).alias("ref")
    ready = both.select("*", own, ref)
    class_distance = F.when(F.col("word_chars") >= guard_chars, distance(F.col("classes"), F.col("ref_classes")))
    word_distance = F.when(F.col("n_words") >= guard_words, distance(F.col("own"), F.col("ref")))
    scored = ready.withColumn("class_distance", class_distance).withColumn("word_distance", word_distance)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), F.coalesce(F.round("class_distance", 6), F.lit(-1.0)).alias("class_distance"), F.coalesce(F.round("word_distance", 6), F.lit(-1.0)).alias("word_distance"), (~base_failed & good).alias("kept"))
