"""Corpus reconnaissance and manifests: topics, rosters, line clean-up, stems, fuzzy names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespan.functions.text import most_similar

# Fixed patterns of lines that are no speech.
FURNITURE = [
    r"Interview[ \t]+[0-9]+[ \t]*$",
    r"^(January|February|March|April|May|June|July|August|September|October|November|December)[ \t]+[0-9]{1,2},?[ \t]*[0-9]{4}[ \t]*[0-9]*[ \t]*$",
    r"^[0-9]{1,3}$",
    r"^Tape[ \t]+[IVX0-9]+[ \t]*$",
    r"^(Interview of|A Program of)",
]
SPEAKER_TAG = r"^([A-Z]{2,3}):[ \t]*"
LEAST_SIMILARITY = 0.5
#: No letter, digit or underscore beside a group's name.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Candidates that a name is compared to in one call.
CANDIDATES_AT_ONCE = 1000


def lines_of(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def topic_hits(lines: DataFrame, key: str, patterns: list[str], n: int | None = None) -> DataFrame:
    """Lines that match any term, a document: the terms are one alternation, so each line is read once."""
    hits = lines.groupBy(key).agg(F.count_if(F.col("line").rlike("(?i)" + "|".join(patterns))).alias("hits")).where("hits > 0").orderBy(F.desc("hits"), key)
    return hits if n is None else hits.limit(n)


def group_roster(documents: DataFrame, key: str, groups: dict[str, str], text: str = "text") -> DataFrame:
    """(group, document) where the group's pattern occurs: one pass for all groups."""
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), g) for g, p in groups.items())))
    return documents.select(key, F.explode(found).alias("grp"))


def flattened(text: Column) -> Column:
    """A text as one line, white space as single spaces."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n\f]+", " "))


def _stands_in(name: str, text: str) -> Column:
    """Whether a group's name stands in a text as words of its own, the text taken as flattened.

    A name of plain words is sought in the text as it is, and by a pattern only where the text has each of them. That pattern
    begins with the first word and looks back from its end, so that it fails at once at most places. Other names are patterns
    and need the flattened text.
    """
    parts = name.split(" ")
    if not all(re.fullmatch(r"[^\s\\.^$|?*+()\[\]{}]+", w) for w in parts):
        return F.col("_flat").rlike(f"{BEFORE}(?:{name}){AFTER}")
    has = F.lit(True)
    for w in parts:
        has = has & F.contains(F.col(text), F.lit(w))
    first, *others = parts
    return has & F.col(text).rlike(r"[ \t\r\n\f]++".join([f"{first}(?<![A-Za-z0-9_]{first})", *others]) + AFTER)


def members(documents: DataFrame, key: str, groups: list[str], text: str = "text") -> DataFrame:
    """(key, grp) where a group's name stands as words of its own in the flattened text; one pass for all groups."""
    found = F.array_compact(F.array(*(F.when(_stands_in(g, text), g) for g in groups)))
    return documents.select(key, text, flattened(F.col(text)).alias("_flat")).select(key, F.explode(found).alias("grp"))


def roster_totals(roster: DataFrame, key: str) -> DataFrame:
    """One row: memberships, and different people and groups in them."""
    return roster.agg(F.count(F.lit(1)).alias("memberships"), F.count_distinct(key).alias("people"), F.count_distinct("grp").alias("groups"))


def bridges(roster: DataFrame, key: str) -> DataFrame:
    """Documents in more than one group, with the groups' names."""
    return roster.groupBy(key).agg(F.count(F.lit(1)).alias("n_groups"), F.array_join(F.array_sort(F.collect_list("grp")), ", ").alias("groups")).where("n_groups > 1")


def is_furniture(line: Column) -> Column:
    test = F.lit(False)
    for p in FURNITURE:
        test = test | line.rlike(p)
    return test


def speech_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines of real speech, lower-cased, numbered, each with the speaker of the last tag ("?" before any)."""
    bare = F.regexp_replace(F.btrim(F.replace("line", F.lit("\r"), F.lit("")), F.lit(" \t")), r"^Tape[ \t]+[IVX]+[ \t]+", "")
    whole = lines.withColumn("line", F.btrim(F.replace("line", F.lit("\r"), F.lit("")), F.lit(" \t"))).where((F.col("line") != "") & ~is_furniture(F.col("line")))
    tag = F.regexp_extract("line", SPEAKER_TAG, 1)
    w = W.partitionBy(key).orderBy("line_no")
    tagged = whole.withColumn("line", bare).withColumn("tag", F.when(tag != "", tag)).withColumn("line", F.regexp_replace("line", SPEAKER_TAG, ""))
    spoken = tagged.withColumn("speaker", F.coalesce(F.last("tag", True).over(w), F.lit("?"))).where("line <> ''")
    return spoken.select(key, "line_no", F.row_number().over(w).alias("seq"), "speaker", F.lower("line").alias("line"))


def tape_seconds(marks: DataFrame, key: str, order: str, clock: str, pause: float = 300.0) -> DataFrame:
    """Clock readings to running seconds: when the clock goes back a new tape begins, `pause` later."""
    w = W.partitionBy(key).orderBy(order)
    before = F.lag(clock).over(w)
    reset = marks.withColumn("_add", F.when(F.col(clock) < before, before + pause).otherwise(0.0))
    return reset.withColumn("seconds", F.sum("_add").over(w) + F.col(clock)).drop("_add")


def missing_stems(manifest: DataFrame, files: DataFrame, stem: str = "stem") -> DataFrame:
    return manifest.join(files.select(stem).distinct(), stem, "left_anti")


def best_download(files: DataFrame, key: str) -> DataFrame:
    """The source file if there is one, else the widest, then the largest."""
    rank = F.struct((F.col("quality") == "source").alias("s"), "width", "size", "link")
    return files.groupBy(key).agg(F.max_by("link", rank).alias("link"))


def fuzzy_best(names: DataFrame, candidates: DataFrame, name: str, candidate: str, order: str) -> DataFrame:
    """The most similar candidate of each distinct name, if similar enough; of equal ones the first by `order`.

    Candidates, a manifest's names, are dealt to lists of CANDIDATES_AT_ONCE; each name meets a list as a
    whole, so that no row is made for a pair.
    """
    lists = F.ceil(F.lit(candidates.count()) / CANDIDATES_AT_ONCE)
    dealt = candidates.select(F.pmod(F.xxhash64(order), F.greatest(lists, F.lit(1))).alias("list"), F.struct(F.col(order).alias("at"), F.col(candidate).alias("name")).alias("c"))
    listed = dealt.groupBy("list").agg(F.sort_array(F.collect_list("c")).alias("c")).select(F.lit(1).alias("one"), "c")
    found = names.select(name).distinct().withColumn("one", F.lit(1)).join(listed, "one").withColumn("best", most_similar(name, "c.name"))
    scored = found.select(name, F.struct("best.ratio", F.element_at("c.at", F.col("best.place") + 1).alias("at"), F.element_at("c.name", F.col("best.place") + 1).alias("name")).alias("b")).where(F.col("b.ratio") >= LEAST_SIMILARITY)
    ranked = scored.withColumn("rn", F.row_number().over(W.partitionBy(name).orderBy(F.desc("b.ratio"), "b.at"))).where("rn = 1")
    return ranked.select(name, F.col("b.name").alias(candidate), F.round("b.ratio", 6).alias("ratio"))
