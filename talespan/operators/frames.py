"""Frame scores of a segmentation model to stretches of speech, and the padded windows that such a model reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespan.operators.speakers import FIRST_SAMPLE, FRAME_SAMPLES

WINDOW_SECONDS = 10


def padded_windows(samples: Column, rate: int, seconds: int = WINDOW_SECONDS) -> Column:
    """Samples in windows of equal length, the last filled up with zeros; none for no samples."""
    n = rate * seconds
    count = F.ceil(F.size(samples) / n).cast("int")
    windows = F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.slice(samples, (i - 1) * n + 1, n), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(i * n - F.size(samples), F.lit(0)))))
    return F.when(F.size(samples) > 0, windows).otherwise(F.array().cast("array<array<float>>"))


def loudest_class(scores: Column) -> Column:
    """Place of the largest score, the last one on a tie; NaN is the largest."""
    return F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores)).cast("int")


def speech(frames: DataFrame, key: str, rate: int, total: str = "total_samples") -> DataFrame:
    """(key, start, end) of runs of speech in (key, window, frame, scores, total): seconds.

    A frame is speech unless class 0 scores most. Frames are numbered through all windows, so a run goes on over a
    window's edge; it ends where the next frame begins. A run that is open at the end stops at the recording's
    true length, without the padding, but not before its start. Frames without scores are no speech.
    """
    w = W.partitionBy(key).orderBy("window", "frame")
    said = F.coalesce(loudest_class(F.col("scores")) != 0, F.lit(False)) & (F.size("scores") > 0)
    rows = frames.select(key, "window", "frame", F.col(total).alias("_total"), said.alias("said")).withColumn("n", F.row_number().over(w) - 1)
    edges = rows.withColumn("begins", F.col("said") & ~F.coalesce(F.lag("said").over(w), F.lit(False))).withColumn("last", F.lead("n").over(w).isNull())
    runs = edges.withColumn("run", F.sum(F.col("begins").cast("int")).over(w)).where("said")
    place = lambda n: FIRST_SAMPLE + n * FRAME_SAMPLES
    ends = runs.groupBy(key, "run").agg(place(F.min("n")).alias("start"), place(F.max("n") + 1).alias("stop"), F.max("last").alias("open"), F.max("_total").alias("_total"))
    stop = F.when(F.col("open"), F.greatest("_total", "start")).otherwise(F.col("stop"))
    return ends.select(key, (F.col("start") / rate).alias("start"), (stop / rate).alias("end"))
