"""Readers: result and segment JSON, lexicons, turns, anchors, reference turns, terms, WAV audio."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan import schema
from talespan.functions.normal import normalized
from talespan.functions.text import timecode_seconds
from talespan.runtime import ship


def results(spark: SparkSession, path: str) -> DataFrame:
    """One row a result file; unknown fields are left out, wrong types stop the read."""
    return spark.read.schema(schema.RESULT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())


def segments(json: Column) -> Column:
    """A JSON list of segments."""
    return F.from_json(json, T.ArrayType(schema.SEGMENT), {"mode": "FAILFAST"})


def config(json: Column) -> Column:
    """A configuration with its defaults filled in, field by field."""
    given = F.from_json(json, schema.CONFIG, {"mode": "FAILFAST"})
    parts = [F.struct(*(F.coalesce(given[part][k], F.lit(v)).alias(k) for k, v in fields.items())).alias(part) for part, fields in schema.CONFIG_DEFAULTS.items()]
    return F.struct(*parts)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """pos, term and words (its tokens) of a word list: comments and blanks left out, the first of terms with equal tokens kept."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "term")).withColumn("term", F.trim("term"))
    ship(spark)
    tokens = normalized(rows.where("term <> '' and term not like '#%'"), "term", "words").where(F.size("words") > 0)
    return tokens.groupBy("words").agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos")).select("pos", "term", "words")


def turns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TURNS_FILE).option("multiLine", True).json(path).select(F.posexplode("turns").alias("pos", "t")).select("pos", "t.*")


def anchors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ANCHORS_FILE).option("multiLine", True).json(path).select(F.posexplode("anchors").alias("pos", "a")).select("pos", "a.*")


def reference_turns(text: Column) -> Column:
    """Blocks of an optional number, `tc - tc`, a speaker and text, parted by blank lines."""
    blocks = F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("")), r"\n[ \t]*\n+"), lambda b: b.rlike(r"\d+:\d+:\d+:\d+ *- *\d+:\d+:\d+:\d+"))
    span = lambda b, g: timecode_seconds(F.regexp_extract(b, r"(\d+:\d+:\d+:\d+) *- *(\d+:\d+:\d+:\d+)", g))
    after = lambda b: F.split(F.regexp_extract(b, r"(?s)\d+:\d+:\d+:\d+ *- *\d+:\d+:\d+:\d+[^\n]*\n(.*)", 1), "\n")
    return F.transform(blocks, lambda b: F.struct(span(b, 1).alias("start"), span(b, 2).alias("end"), F.trim(after(b)[0]).alias("speaker")))


def terms(spark: SparkSession, path: str, tier: str = "1") -> list[str]:
    """Patterns of one tier of a tier<TAB>pattern file."""
    return [r["pattern"] for r in spark.read.schema("tier string, pattern string").csv(path, sep="\t").where(F.col("tier") == tier).collect()]


def _pcm(data: bytes, width: int) -> np.ndarray:
    """Samples in -1..1 of PCM data of one to four bytes a sample; single bytes are unsigned."""
    if width == 1:
        return np.frombuffer(data, dtype=np.uint8) / 128.0 - 1.0
    if width == 3:
        wide = np.zeros((len(data) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = np.frombuffer(data, dtype=np.uint8)[: len(data) // 3 * 3].reshape(-1, 3)
        return wide.reshape(-1).view("<i4") / 2147483648.0
    return np.frombuffer(data, dtype=f"<i{width}") / float(1 << (8 * width - 1))


def wav(spark: SparkSession, path: str) -> DataFrame:
    """file, rate, channels and interleaved samples in -1..1 of PCM files of 8, 16, 24 or 32 bits; another file is an error."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rows.append((name, w.getframerate(), w.getnchannels(), _pcm(w.readframes(w.getnframes()), w.getsampwidth()).tolist()))
            yield pd.DataFrame(rows, columns=["file", "rate", "channels", "samples"])

    out = T.StructType().add("file", "string").add("rate", "long").add("channels", "long").add("samples", T.ArrayType(T.DoubleType()))
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, out)
