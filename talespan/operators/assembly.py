"""Composite operators: voice-activity timelines, turns, chunks, phrase search, score reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.operators import intervals, speakers
from talespan.operators.evaluate import find_all
from talespan.operators.speakers import FIRST_SAMPLE, FRAME_SAMPLES
from talespan.operators.words import LEAST_SAMPLES

# Fixed values of the timeline of kept speech.
SAMPLE_RATE, OVERLAP_SECONDS, GLUE_SECONDS = 16000, 0.1, 0.1
#: Fixed patterns of a printed transcript's labels and running lines.
LABEL = r"\b[A-Z]{2,}(?:\s+[A-Z]{2,})*:"
BOILERPLATE = r"(?i)A PROGRAM OF|Interviewee:|Interviewer:|Interview Number:|Date of Interview:|Interview of "


def vad_timeline(speech: DataFrame, key: str) -> DataFrame:
    """Regions of (key, start, end, total): each but the last runs on by the overlap, whole samples
    count, and the kept parts follow each other with a short silence between."""
    w = W.partitionBy(key).orderBy("start", "end")
    last = F.lead("start").over(w).isNull()
    begin = F.greatest(F.least("start", "total"), F.lit(0.0))
    stop = F.least(F.greatest(F.col("end") + F.when(last, 0.0).otherwise(OVERLAP_SECONDS), begin), F.col("total"))
    cut = speech.withColumn("_stop", stop).withColumn("orig_start", begin).withColumn("samples", F.floor(F.col("_stop") * SAMPLE_RATE) - F.floor(F.col("orig_start") * SAMPLE_RATE)).where("samples > 0")
    w2 = W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("samples") + int(GLUE_SECONDS * SAMPLE_RATE)).over(w2), F.lit(0))
    return cut.select(key, "orig_start", (before / SAMPLE_RATE).alias("filtered_start"), (F.col("samples") / SAMPLE_RATE).alias("duration"))


def frame_seconds(window: Column, frame: Column, window_seconds: int = 10) -> Column:
    """When a frame of an analysis window begins."""
    return window * window_seconds + (FIRST_SAMPLE + frame * FRAME_SAMPLES) / SAMPLE_RATE


def usable_embeddings(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Segments long enough to embed, with finite vectors."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(((F.col("end") - F.col("start")) * SAMPLE_RATE >= LEAST_SAMPLES) & finite)


def gold_text(text: Column, titles: list[str] | None = None) -> Column:
    """The body of a printed transcript: from the first label on, without running lines and labels.

    titles: patterns of an archive's own running lines, besides the common ones.
    """
    running = "|".join([BOILERPLATE, *(titles or [])])
    at = F.regexp_instr(text, F.lit(LABEL))
    body = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    lines = F.filter(F.split(body, "\n"), lambda x: ~x.rlike(running))
    return F.regexp_replace(F.array_join(lines, "\n"), LABEL, " ")


def turns(lines: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Runs of lines of one speaker as one text."""
    w = W.partitionBy(key).orderBy(order)
    opens = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))).cast("int")
    numbered = lines.withColumn("opens", opens).withColumn("turn", F.sum("opens").over(w))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), " ")
    return numbered.groupBy(key, "turn").agg(F.first("speaker").alias("speaker"), parts.alias("text"))


def chunks(segments: DataFrame, key: str, most: float = 30.0) -> DataFrame:
    """Statements by speaker: a new one at a change of speaker, or at a sentence's end once `most`
    seconds have passed since the speaker began."""
    w = W.partitionBy(key).orderBy("start_time", "uid")
    change = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))).cast("int")
    runs = segments.withColumn("_c", change).withColumn("run", F.sum("_c").over(w))
    r = W.partitionBy(key, "run").orderBy("start_time", "uid")
    slot = F.floor((F.col("start_time") - F.first("start_time").over(r)) / most)
    ended = F.lag("text").over(r).rlike(r"[.!?]\s*$")
    split = runs.withColumn("_slot", slot).withColumn("_s", ((F.col("_slot") > F.lag("_slot").over(r)) & F.coalesce(ended, F.lit(False))).cast("int")).withColumn("part", F.coalesce(F.sum("_s").over(r), F.lit(0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_time", "uid", "text"))), lambda x: x["text"]), " ")
    return split.groupBy(key, "run", "part").agg(F.first("speaker").alias("speaker"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), text.alias("text"))


def prefix_match(files: DataFrame, papers: DataFrame) -> DataFrame:
    """`NNN.…` files with the first paper whose name begins with `NNN `."""
    left = files.withColumn("number", F.split_part("file", F.lit("."), F.lit(1)))
    right = papers.groupBy(F.split_part("paper", F.lit(" "), F.lit(1)).alias("number")).agg(F.min("paper").alias("paper"))
    return left.join(right, "number", "left")


def phrase_counts(tokens: DataFrame, key: str, phrases: list[list[str]]) -> DataFrame:
    """(key, term, n) for the phrases that a token array has, without overlaps; one pass, and no row for those it lacks."""
    open_, close = "\x01", "\x02"  # no token has these
    text = F.concat(F.lit(open_), F.array_join("tokens", close + open_), F.lit(close))

    def count(phrase: list[str]) -> Column:
        sought = "".join(f"{open_}{w}{close}" for w in phrase)
        return ((F.length(text) - F.length(F.replace(text, F.lit(sought), F.lit("")))) / len(sought)).cast("long")

    found = F.explode(F.array(*(F.struct(F.lit(" ".join(p)).alias("term"), count(p).alias("n")) for p in phrases)))
    return tokens.select(key, found.alias("f")).where("f.n > 0").select(key, "f.term", "f.n")


@F.pandas_udf(T.LongType())
def locate(tokens: pd.Series, phrase: pd.Series) -> pd.Series:
    """Place of the longest prefix of a phrase, three tokens at least, or of a shorter whole phrase; -1 if none."""
    out = []
    for t, p in zip(tokens, phrase, strict=True):
        t, p = list(t), list(p)
        tries = range(len(p), max(min(len(p), 3), 1) - 1, -1)
        out.append(next((at[0] for n in tries if (at := find_all(t, p[:n]))), -1))
    return pd.Series(out, dtype="int64")


def diarization_score(reference: DataFrame, predicted: DataFrame, key: str, width: float, reach: float = 3.0) -> DataFrame:
    """Dominant-speaker accuracy, the naming of labels that it counts by, and boundary recall of each recording.

    reference: (key, segment, l_start, l_end, name); predicted: (key, speaker, r_start, r_end).
    """
    said = intervals.dominant(reference, predicted, [key], width).join(reference.select(key, "segment", "name"), [key, "segment"])
    # a label that never dominates still needs a name
    labels = predicted.groupBy(key).agg(F.collect_set("speaker").alias("labels"))
    shares = said.groupBy(key, F.col("speaker").alias("label"), "name").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").cast("int").alias("turns"), F.collect_set("name").alias("names"), F.collect_list(F.struct("label", "name", "n")).alias("rows"))
    known = [F.coalesce("labels", F.array().cast("array<string>")), "names", "rows"]
    named = shares.join(labels, key, "left").select(key, "turns", F.round(speakers.most_named_right(*known) / F.col("turns"), 6).alias("accuracy"), speakers.best_names(*known).alias("mapping"))
    real = intervals.changes(reference, [key], ["l_start", "segment"], "name").select(key, F.col("l_start").alias("t")).distinct()
    guess = intervals.changes(predicted, [key], ["r_start", "speaker"], "speaker").select(key, F.col("r_start").alias("m"))
    recall = intervals.within(real, guess, [key], reach).groupBy(key).agg(F.count(F.lit(1)).alias("changes"), F.count_if("hit").alias("detected"))
    return named.join(recall, key, "left").select(key, "turns", "accuracy", "mapping", F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("detected", F.lit(0)).alias("detected"))


def scorecard(errors: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """One JSON report a recording, version 4."""
    both = errors.join(stats, key, "left")
    return both.select(key, F.to_json(F.struct(F.lit(4).alias("version"), *(c for c in both.columns if c != key))).alias("report"))
