"""Timed words and audio: word assembly, word ends, suspect words, mono mix, resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_SAMPLES = 400


def decoded(data: Column) -> Column:
    """Bytes as text, U+FFFD for each longest part that can't be UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


def assemble(tokens: DataFrame, key: str) -> DataFrame:
    """Words of (key, idx, bytes, at, p): a token that begins with a space opens a word; the bytes of
    a word are joined before they are decoded, its time is its first token's, p its least."""
    w = W.partitionBy(key).orderBy("idx")
    opens = (F.substring("bytes", 1, 1) == F.lit(b" ")) | (F.row_number().over(w) == 1)
    grouped = tokens.withColumn("opens", opens.cast("int")).withColumn("word", F.sum("opens").over(w)).groupBy(key, "word").agg(F.sort_array(F.collect_list(F.struct("idx", "bytes"))).alias("parts"), F.min_by("at", "idx").alias("start"), F.min("p").alias("p"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["bytes"]))
    return grouped.select(key, "word", F.regexp_replace(decoded(joined), "^ +", "").alias("text"), "start", "p")


def word_ends(words: DataFrame, key: list[str], segment_end: str) -> DataFrame:
    """A word ends where the next begins, the last with its segment, never before its own start."""
    after = F.lead("start").over(W.partitionBy(*key).orderBy("idx"))
    return words.withColumn("end", F.greatest("start", F.coalesce(after, segment_end)))


def carry_time(words: DataFrame, key: list[str], at: str, segment_start: str) -> DataFrame:
    """Times that never go back; an unset time takes the last one, at first the segment's start."""
    w = W.partitionBy(*key).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return words.withColumn("start", F.greatest(F.coalesce(F.max(at).over(w), segment_start), segment_start))


def suspects(words: Column, most: float = 0.05, around: int = 3) -> Column:
    """The first word with p at most `most` and its neighbours, the word itself in « »."""
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  a value inside a lambda is made anew for each word otherwise

    def context(all_words: Column, place: Column) -> Column:
        first = F.greatest(place - around, F.lit(1))
        near = F.slice(all_words, first.cast("int"), (F.least(place + around, F.size(all_words)) - first + 1).cast("int"))
        return F.array_join(F.transform(near, lambda w, i: F.when(i + first == place, F.concat(F.lit("«"), w["word"], F.lit("»"))).otherwise(w["word"])), " ")

    place = lambda all_words: F.array_position(F.transform(all_words, lambda w: (w["p"] <= most).cast("int")), 1)
    return once(words, lambda ws: once(place(ws), lambda at: F.when(at > 0, context(ws, at))))


def to_mono(samples: DataFrame, key: list[str], channels: int) -> DataFrame:
    """Mean over the channels of each frame of interleaved (i, value); a partial last frame is dropped."""
    return samples.groupBy(*key, F.floor(F.col("i") / channels).alias("frame")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).where(F.col("n") == channels).drop("n")


def resample(values: np.ndarray, source: int, target: int, taps: int = 256, cutoff: float = 0.95) -> np.ndarray:
    """Windowed-sinc resampling; the result has floor(n * target / source) samples."""
    if not (0 < source <= 384_000 and 0 < target <= 384_000 and 1 / 64 <= target / source <= 64):
        raise ValueError("rates out of bounds")
    n = len(values) * target // source
    centre = np.arange(n) * source / target
    scale = cutoff * min(1.0, target / source)
    near = np.floor(centre).astype(np.int64)[:, None] + np.arange(-taps // 2 + 1, taps // 2 + 1)
    x = centre[:, None] - near
    window = 0.5 + 0.5 * np.cos(2 * np.pi * np.clip(x / taps, -0.5, 0.5))
    padded = np.concatenate((values, [0.0]))
    inside = (near >= 0) & (near < len(values))
    return (scale * np.sinc(scale * x) * window * padded[np.where(inside, near, len(values))]).sum(axis=1)


def resampled(files: DataFrame, target: int) -> DataFrame:
    """Files (file, rate, samples) at another rate, in blocks so that memory stays bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [resample(np.asarray(s, dtype=np.float64), int(r), target) for r, s in zip(batch["rate"], batch["samples"], strict=True)]
            yield pd.DataFrame({"file": batch["file"], "rate": target, "samples": [o.tolist() for o in out]})

    return files.select("file", "rate", "samples").mapInPandas(run, T.StructType([files.schema["file"]]).add("rate", "long").add("samples", T.ArrayType(T.DoubleType())))
