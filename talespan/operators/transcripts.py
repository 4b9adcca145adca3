"""Printed transcripts: turns rebuilt from displaced lines, and clean text by an ordered table of repairs."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.runtime import ship

# Fixed patterns of tape marks, of a sentence's end and of editorial cuts, and the words read after a mark.
TAPE, CLOCK = r"^Tape\s+(I|II|III|IV)$", r"^(\d\d):(\d\d):(\d\d)$"
ENDED, EDITORIAL = r"""[.?!–"']\s*$""", r"\[[^\]]*\]\s*"
FOLLOWING_WORDS = 14
#: A mark stands in the text as one word of these, which no transcript has.
MARK = "\x01"
_PLACED = "kind string, seq long, placed int"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def classified(lines: DataFrame, key: str, tags: list[str], furniture: list[str], order: str = "line_no") -> DataFrame:
    """(key, order, line) with kind (blank, tag, tape, clock, furniture, text) and what the lines before it say: speaker and
    `opens` (the first text since a tag), `wraps` (no blank line before), mark (of a tape and clock since the last text)."""
    w = W.partitionBy(key).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    s = _trimmed(F.coalesce("line", F.lit("")))
    tag = r"^(" + "|".join(tags) + r"):$"
    rows = lines.select(key, order, s.alias("line")).withColumn("_clock", F.when(F.col("line").rlike(TAPE), "tape").when(F.col("line").rlike(CLOCK), "clock"))
    # a clock counts if a tape and no other clock came before it
    rows = rows.withColumn("_last", F.last("_clock", True).over(before))
    clock = (F.col("_clock") == "clock") & (F.col("_last") == "tape")
    is_furniture = F.col("line").rlike("|".join(f"(?:{p})" for p in furniture)) if furniture else F.lit(False)
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").rlike(tag), "tag").when(F.col("_clock") == "tape", "tape").when(clock, "clock").when(is_furniture, "furniture").otherwise("text")
    rows = rows.withColumn("kind", kind).withColumn("_mark", F.count_if(F.col("kind") == "clock").over(w) - 1)
    seen = lambda k, value: F.last(F.when(F.col("kind") == k, value), True).over(before)
    at = F.col(order)
    rows = rows.withColumns({"_tag": seen("tag", F.struct(at.alias("at"), F.regexp_extract("line", tag, 1).alias("speaker"))), "_text": seen("text", at), "_marked": seen("clock", F.struct(at.alias("at"), F.col("_mark").alias("mark"))), "roman": F.last(F.when(F.col("_clock") == "tape", F.regexp_extract("line", TAPE, 1)), True).over(before), "wraps": F.coalesce(F.lag("kind").over(w) != "blank", F.lit(False))})
    since = lambda c: F.col(f"{c}.at").isNotNull() & (F.col("_text").isNull() | (F.col(f"{c}.at") > F.col("_text")))
    return rows.select(key, order, "line", "kind", "roman", F.when(F.col("kind") == "clock", F.col("_mark")).alias("own_mark"), F.col("_tag.speaker").alias("speaker"), since("_tag").alias("opens"), "wraps", F.when(since("_marked"), F.col("_marked.mark")).alias("mark"))


class Fold:
    """Turns so far and those of them whose text stops within a sentence; all that placing a line depends on."""

    def __init__(self) -> None:
        self.turns, self.open = 0, []

    def place(self, opens: bool, wraps: bool, ended: bool) -> int:
        if opens or not self.turns:
            at = self.turns
            self.turns += 1
        elif wraps or not self.open:
            at = self.turns - 1
        else:
            at = self.open[0]
        i = bisect_left(self.open, at)
        known = i < len(self.open) and self.open[i] == at
        if ended and known:
            self.open.pop(i)
        elif not ended and not known:
            insort(self.open, at)
        return at


def placed(texts: DataFrame, key: str, order: str = "line_no") -> DataFrame:
    """Rows of (key, order, opens, wraps, line) with `turn`, the turn that each line belongs to.

    A line opens a turn after a tag and follows the last line where no blank line is between; another one is
    displaced and goes on with the oldest turn that stops within a sentence, or else with the last one. Text before any
    tag makes a turn. Lines pass a task in order and only the open turns are held.
    """
    ship(texts.sparkSession)
    schema = T.StructType([*texts.schema.fields, T.StructField("turn", T.IntegerType())])
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = object(), Fold()
        for batch in batches:
            out = []
            for k, opens, wraps, ended in zip(*(batch.column(names.index(c)).to_pylist() for c in (key, "opens", "wraps", "ended")), strict=True):
                if k != now:
                    now, fold = k, Fold()
                out.append(fold.place(opens, wraps, ended))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], schema.names)

    return texts.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def rebuilt(lines: DataFrame, key: str, tags: dict[str, str], furniture: list[str], repairs: list[tuple[str, str]], order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Turns (key, turn, speaker, text) and tape marks (key, mark, tape, tape_seconds, following_text) of raw lines.

    tags: what a line before its colon says, and whose turn then begins. repairs: patterns and what replaces them, in
    order, in each turn; then editorial insertions are cut and white space becomes single spaces; empty turns go.
    A mark's following text is read where the mark stands in the rebuilt text. Null lines are blank, rows need a unique order.
    """
    rows = classified(lines, key, list(tags), furniture, order)
    ended = F.col("line").rlike(ENDED)
    texts = placed(rows.where("kind = 'text'").select(key, order, "line", "speaker", "opens", "wraps", "mark", ended.alias("ended")), key, order)
    chunk = F.concat(F.when(F.col("mark").isNotNull(), F.concat(F.lit(MARK), F.col("mark"), F.lit(MARK + " "))).otherwise(""), F.col("line"))
    names = F.create_map(*(F.lit(x) for pair in tags.items() for x in pair))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, chunk.alias("c")))), lambda x: x["c"]), " ")
    text = F.col("text")
    for pattern, replacement in [*repairs, (EDITORIAL, ""), (r"\s+", " ")]:
        text = F.regexp_replace(text, pattern, replacement)
    turns = texts.groupBy(key, "turn").agg(F.min_by(F.struct("speaker", "opens"), order).alias("first"), joined.alias("text")).select(key, "turn", F.when(F.col("first.opens"), names[F.col("first.speaker")]).alias("speaker"), _trimmed(text).alias("text")).where("text <> ''")
    marks = rows.where("kind = 'clock'").select(key, F.col("own_mark").alias("mark"), F.array_position(F.array(*map(F.lit, ("I", "II", "III", "IV"))), F.col("roman")).cast("int").alias("tape"), sum((F.regexp_extract("line", CLOCK, i + 1).cast("int") * n for i, n in enumerate((3600, 60, 1))), F.lit(0)).alias("tape_seconds"))
    flat = turns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("flat"))
    sign = F.concat(F.lit(MARK), F.col("mark"), F.lit(MARK))
    after = F.when(F.instr("flat", sign) > 0, F.regexp_replace(F.split_part("flat", sign, F.lit(-1)), f"{MARK}[0-9]+{MARK}", " ")).otherwise("")
    following = F.array_join(F.slice(F.array_remove(F.split(after, r"\s+"), ""), 1, FOLLOWING_WORDS), " ")
    marks = marks.join(flat, key, "left").select(key, "mark", "tape", "tape_seconds", F.coalesce(following, F.lit("")).alias("following_text"))
    clean = _trimmed(F.regexp_replace("text", rf"\s*{MARK}[0-9]+{MARK}\s*", " "))
    return turns.withColumn("text", clean).where("text <> ''"), marks


def joined_turns(turns: DataFrame, key: str, order: str = "turn") -> DataFrame:
    """(key, text): a recording's turns as one text."""
    return turns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))


def must_agree(turns: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """`joined_turns`, or an error where they and the clean text (key, text) are not the same words, or one is missing."""
    both = joined_turns(turns, key).join(clean.select(key, F.col("text").alias("clean")), key, "full")
    same = F.split(F.coalesce(_trimmed(F.col("text")), F.lit("\0")), r"\s+") == F.split(F.coalesce(_trimmed(F.col("clean")), F.lit("\0")), r"\s+")
    said = F.raise_error(F.concat(F.lit("turns and clean text differ in "), F.col(key).cast("string")))
    return both.select(key, F.when(same, F.col("text")).otherwise(said.cast("string")).alias("text"))


def _times(items: Column, item: int) -> Column:
    return F.size(F.filter(items, lambda x: x == item))


def cleaned(text: Column, cuts: list[tuple[str, str]], drops: list[tuple[str, str]], replacements: list[tuple[str, str, str]]) -> Column:
    """A struct of `text` and `counts` (array of rule and n) of a raw transcript.

    In this order: cuts (pattern, replacement) change parts of lines, one after the other; drops (pattern, rule) remove
    whole lines, the first rule that fits counts; the lines left are one text, in which replacements (pattern, replacement, rule) are
    made, one after the other; white space becomes single spaces. Null is empty. All of it stays in the row.
    """
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("﻿"), F.lit("")), "\n")
    changed: Column = F.lit(0)
    for pattern, replacement in cuts:
        new = F.transform(lines, lambda x: F.regexp_replace(x, pattern, replacement))  # noqa: B023
        changed = changed + F.aggregate(F.zip_with(lines, new, lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x)
        lines = new
    lines = F.filter(F.transform(lines, _trimmed), lambda x: x != "")
    rule = lambda x: F.coalesce(*(F.when(x.rlike(p), i) for i, (p, _) in enumerate(drops)), F.lit(-1))
    why = F.transform(lines, lambda x: F.struct(rule(x).alias("rule"), x.alias("line")))
    kept = F.array_join(F.transform(F.filter(why, lambda x: x["rule"] < 0), lambda x: x["line"]), " ")
    counts = [F.struct(F.lit("cuts").alias("rule"), changed.alias("n"))]
    counts += [F.struct(F.lit(name).alias("rule"), _times(why["rule"], i).alias("n")) for i, (_, name) in enumerate(drops)]
    for pattern, replacement, name in replacements:
        counts.append(F.struct(F.lit(name).alias("rule"), F.regexp_count(kept, F.lit(pattern)).alias("n")))
        kept = F.regexp_replace(kept, pattern, replacement)
    return F.struct(_trimmed(F.regexp_replace(kept, r"\s+", " ")).alias("text"), F.array(*counts).alias("counts"))
