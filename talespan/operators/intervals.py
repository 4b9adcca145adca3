"""Joins over time: overlap, as-of, tolerance, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of (l_start, l_end) and (r_start, r_end) that share time, with `shared`.

    Each interval goes to the buckets it touches; a pair counts in the bucket where it begins, once.
    """
    cut = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width))))
    pairs = cut(left, "l_start", "l_end").join(cut(right, "r_start", "r_end"), [*keys, "bucket"])
    begin = F.greatest("l_start", "r_start")
    shared = F.least("l_end", "r_end") - begin
    return pairs.withColumn("shared", shared).where((F.col("shared") > 0) & (F.floor(begin / width) == F.col("bucket"))).drop("bucket")


def dominant(segments: DataFrame, speech: DataFrame, keys: list[str], width: float) -> DataFrame:
    """For each segment the speaker with most shared time, the least name on ties, or null."""
    total = overlaps(segments, speech, keys, width).groupBy(*keys, "segment", "speaker").agg(F.sum("shared").alias("total"))
    order = W.partitionBy(*keys, "segment").orderBy(F.desc("total"), "speaker")
    best = total.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    return segments.select(*keys, "segment").join(best, [*keys, "segment"], "left")


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def within(times: DataFrame, marks: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Each time (t) and whether any mark (m) is at most `reach` away."""
    spread = marks.select(*keys, "m", F.explode(F.array(*(F.floor(F.col("m") / reach) + d for d in (-1, 0, 1)))).alias("bucket"))
    near = times.withColumn("bucket", F.floor(F.col("t") / reach)).join(spread, [*keys, "bucket"]).where(F.abs(F.col("t") - F.col("m")) <= reach).select(*keys, "t").distinct().withColumn("hit", F.lit(True))
    return times.join(near, [*keys, "t"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def islands(frames: DataFrame, keys: list[str], order: str, active: Column) -> DataFrame:
    """Runs of active frames: first and last frame of each."""
    w = W.partitionBy(*keys).orderBy(order)
    on = frames.withColumn("on", active)
    start = on.withColumn("starts", (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int")).withColumn("island", F.sum("starts").over(w))
    return start.where("on").groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("frames"))


def as_of(points: DataFrame, steps: DataFrame, keys: list[str], time: str, payload: list[str]) -> DataFrame:
    """Each point with the payload of the latest step at or before it: one sort, no join."""
    null = [F.lit(None).cast(steps.schema[p].dataType).alias(p) for p in payload]
    both = points.select("*", *null, F.lit(1).alias("_side")).unionByName(steps.select(*keys, time, *payload, F.lit(0).alias("_side")), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = both.select(*points.columns, "_side", *(F.last(p, ignorenulls=True).over(w).alias(p) for p in payload))
    return filled.where("_side = 1").drop("_side")


def to_original(points: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Filtered times t to original times: the region at or before t, clamped to its end; times
    before the first region go to its start."""
    packed = regions.withColumn("t", F.col("filtered_start")).withColumn("region", F.struct("orig_start", "filtered_start", "duration"))
    found = as_of(points, packed, keys, "t", ["region"])
    first = regions.groupBy(*keys).agg(F.min_by("orig_start", "filtered_start").alias("first_start"))
    at = F.col("region.orig_start") + F.least(F.col("t") - F.col("region.filtered_start"), F.col("region.duration"))
    return found.join(first, keys, "left").withColumn("original", F.coalesce(at, "first_start", "t")).drop("region", "first_start")


def interpolate(rows: DataFrame, keys: list[str], order: str, anchor: str, tail: float = 300.0, lone: int = 60) -> DataFrame:
    """Seconds for every row, by the rows whose `anchor` is known; -1 where a key has none.

    Between two anchors it is linear. Before the first it goes back at tail / (rows between the first
    two anchors), not below 0; after the last it goes on at tail / (rows between the last two); a lone
    anchor counts as `lone` rows. Results are cut to whole seconds.
    """
    o, key = F.col(order), W.partitionBy(*keys)
    marks = rows.where(F.col(anchor).isNotNull()).select(*keys, order)
    up, down = key.orderBy(order), key.orderBy(F.desc(order))
    gaps = marks.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).where("_up <= 2 or _down <= 2")
    pick = lambda rank, n: F.max(F.when(F.col(rank) == n, o))
    ends = gaps.groupBy(*keys).agg((pick("_up", 2) - pick("_up", 1)).alias("_head"), (pick("_down", 1) - pick("_down", 2)).alias("_tail"))
    back, ahead = key.orderBy(order).rowsBetween(W.unboundedPreceding, 0), key.orderBy(order).rowsBetween(0, W.unboundedFollowing)
    place = F.when(F.col(anchor).isNotNull(), o)
    wide = rows.select("*", F.last(anchor, True).over(back).alias("_pa"), F.last(place, True).over(back).alias("_po"), F.first(anchor, True).over(ahead).alias("_na"), F.first(place, True).over(ahead).alias("_no"))
    wide = wide.join(ends, keys, "left")
    between = F.col("_pa") + F.coalesce(F.try_divide((o - F.col("_po")) * (F.col("_na") - F.col("_pa")), F.col("_no") - F.col("_po")), F.lit(0.0))
    before = F.greatest(F.col("_na") - (F.col("_no") - o) * tail / F.coalesce("_head", F.lit(lone)), F.lit(0.0))
    after = F.col("_pa") + (o - F.col("_po")) * tail / F.coalesce("_tail", F.lit(lone))
    value = F.when(F.col("_pa").isNull() & F.col("_na").isNull(), -1.0).when(F.col("_pa").isNull(), before).when(F.col("_na").isNull(), after).otherwise(between)
    return wide.withColumn("seconds", value.cast("long")).drop("_pa", "_po", "_na", "_no", "_head", "_tail")
