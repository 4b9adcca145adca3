"""Filter interaction audit: what each filter removes in every order of five filters.

A document fails a set of the filters A to E, its mask. In a given order the document is removed by the
first filter that is in its mask. Orders are ranked as in a dictionary (their Lehmer rank, 0 to 119), so
all orders that start with the same letters have consecutive ranks: an ordered run of filters that are
not in the mask, then one that is, is one interval of ranks at one step. Documents are counted by part and mask; the
counts go to the starts of their mask's intervals and, negated, to the ends; a running sum over the
ranks gives what each step of each order removes. So every document is counted once, not 120 times.

A: under 100 words. B: 100 * distinct words < 80 * words. C: 100 * [A-Z] > 10 * code points. D: any of
[#$%&*|]. E: the text is the same as that of a smaller doc_id. Texts are compared by sha256 and don't
leave the scan; equal rows of documents are counted before they are shuffled.

Defined results: a null text is empty, a null lang is the part of the empty string. A null doc_id is not
smaller or larger than any other and has no labels. Rows with equal doc_id and text are not smaller than each
other, each counts. A document has a label if any row of `labels` gives it. No documents give no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talespan.runtime import materialize

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS = 100
DISTINCT_SHARE = 80
CAPITAL_SHARE = 10
MARKS = "[#$%&*|]"
#: Runs of white space end words.
GAPS = r"[\x20\x09-\x0D]+"


def intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of the orders in which a document of this mask is removed at the step."""
    found: list[tuple[int, int, int]] = []

    def walk(rank: int, step: int, left: list[int]) -> None:
        width = factorial(len(left) - 1)  # orders that share one more letter
        for place, f in enumerate(left):
            at = rank + place * width
            if not mask >> f & 1:
                walk(at, step + 1, left[:place] + left[place + 1 :])
            elif found and found[-1][0] == step and found[-1][2] == at:
                found[-1] = (step, found[-1][1], at + width)
            else:
                found.append((step, at, at + width))

    if mask:
        walk(0, 1, list(range(STEPS)))
    return found


def ends(spark: SparkSession) -> DataFrame:
    """mask, step, rank and sign of both ends of every interval of every mask; some hundred rows, whatever the input."""
    rows = [(mask, step, rank, sign) for mask in range(1 << STEPS) for step, a, b in intervals(mask) for rank, sign in ((a, 1), (b, -1)) if rank < len(ORDERS)]
    return spark.createDataFrame(rows, "mask int, step int, rank int, sign int")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D, which look at one text."""
    words = F.array_remove(F.split(text, GAPS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    a, b = n < LEAST_WORDS, F.lit(100) * distinct < F.lit(DISTINCT_SHARE) * n
    c = F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(CAPITAL_SHARE) * F.length(text)
    return sum((x.cast("int") * (1 << i) for i, x in enumerate((a, b, c, text.rlike(MARKS)))), F.lit(0))


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: documents of each mask, and those of them with either label."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own_failures(text).alias("own"))
    rows = materialize(rows.groupBy("doc_id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n")))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    # null ids have no labels; a second key spreads them over the partitions of the join
    spread = [F.coalesce("doc_id", F.xxhash64("digest")).alias("spread"), F.col("doc_id").isNull().alias("no_id")]
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("spread"), F.lit(False).alias("no_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    rows = rows.join(first, ["digest", "doc_id"], "left").select("*", *spread).join(marks, ["spread", "no_id"], "left")
    mask = F.col("own") + F.when(F.col("doc_id").isNull() | F.col("is_first"), 0).otherwise(1 << 4)
    return materialize(rows.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))))


def removed(counts: DataFrame) -> DataFrame:
    """part, rank, step, removed, good_lost and toxic_lost of every order and step, from counts by mask."""
    spark = counts.sparkSession
    steps = counts.join(F.broadcast(ends(spark)), "mask").groupBy("part", "step", "rank").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("n", "good", "toxic")))
    grid = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"))
    running = "over (partition by part, step order by rank rows unbounded preceding)"
    sums = [F.expr(f"coalesce(sum({c}) {running}, 0)").alias(name) for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
    return grid.join(steps, ["part", "step", "rank"], "left").select("part", "rank", "step", *sums)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    counts = masks(documents, labels)
    fails = F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(STEPS)))
    alone = F.array(*(F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(STEPS)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), fails.alias("fails"), alone.alias("alone"))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("rank") + 1)
    rows = removed(counts).withColumn("filter_order", order).withColumn("filter", F.ascii(F.substr("filter_order", F.col("step"), F.lit(1))) - ord(FILTERS[0]) + 1)
    gone = F.expr("sum(removed) over (partition by part, rank order by step rows unbounded preceding)")
    shapley = F.expr("sum(removed) over (partition by part, filter)")
    rows = rows.select("*", gone.alias("gone"), shapley.alias("shapley")).join(parts, "part")
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - F.col("gone")).alias("kept"), "removed", (F.element_at("fails", F.col("filter")) - F.col("removed")).alias("redundant"), F.element_at("alone", F.col("filter")).alias("unique_fails"), "good_lost", "toxic_lost", "shapley")
