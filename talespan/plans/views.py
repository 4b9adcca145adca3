"""The archive's tables as views of the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespan.runtime import table


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a conversation is a statement of an interview."""
    start = F.col("turn") * 10.0
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("interview"), F.format_string("st%d_%d", "conv_id", "turn").alias("uid"), F.col("role").alias("speaker"), "text", start.alias("start_time"), (start + F.least(F.lit(12.0), 1.0 + F.length("text") / 20.0)).alias("end_time"), "turn")


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("number")).distinct()
    return numbers.select("number", F.format_string("iv%d", "number").alias("uid"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("number") % 365).cast("int")).alias("date"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole seconds since the start of 2024, and their order within a user."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1704067200
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds.alias("t"))
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id")))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents with made-up times."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("idx", "word"))
    return rows.withColumn("at", F.when(F.col("idx") % 7 != 3, F.col("idx") * 0.5 - (F.col("idx") % 5) * 0.25)).withColumn("segment_end", F.col("n") * 0.5)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each turn of a conversation and of the next one, as truth and heard."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("w"))
    # joined on the turn too, so that one long conversation spreads over the tasks
    return c.select("conv_id", "turn", F.col("w").alias("truth")).hint("merge").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("heard")), ["conv_id", "turn"])


def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations; a participant's first line has a tag, system lines have none."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    tag = F.when((F.col("p") == 0) & (F.col("role") == "user"), "US: ").when((F.col("p") == 0) & (F.col("role") == "assistant"), "AS: ").otherwise("")
    return rows.select("conv_id", (F.col("turn") * 1000 + F.col("p")).alias("line_no"), F.concat(tag, "line").alias("line"))


#: A lexicon, with terms of several tokens, one that is never said and one without tokens.
LEXICON = ["of", "the", "and", "to", "of of", "an the", "the of", "to to", "is", "zzzz", ""]


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(i, term, term.split()) for i, term in enumerate(LEXICON)]
    return spark.createDataFrame(rows, "term_id int, term string, words array<string>")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is the transcript, with its turns; the next one is what was heard, each turn a segment of timed words."""
    # texts travel, tokens and words are made where they arrive
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("_said"))
    tokens = lambda x: F.coalesce(F.split(F.lower(x["text"]), " "), F.array().cast("array<string>"))  # noqa: E731  a null text has none
    begin = lambda x: x["turn"] * 10.0
    words = lambda x: F.transform(F.split(x["text"], " "), lambda w, i: F.struct(
        F.when(i % 50 == 7, F.concat(w, F.lit("[_TT_"))).otherwise(w).alias("text"), (begin(x) + i * 0.25).alias("start"),
        (begin(x) + i * 0.25 + ((F.length(w) * 3 + i) % 9 - 1) * 0.5).alias("end"), F.array(F.lower(w)).alias("tokens")))
    turn = lambda x: F.struct(x["role"].alias("speaker"), tokens(x).alias("tokens"))
    segment = lambda x: F.struct(begin(x).alias("start_time"), (begin(x) + F.least(F.lit(12.0), 1.0 + F.length(x["text"]) / 20.0)).alias("end_time"), tokens(x).alias("tokens"), words(x).alias("words"))
    in_order = lambda c, part: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x["turn"].alias("turn"), part(x).alias("p")))), lambda y: y["p"])
    heard = said.select((F.col("conv_id") - 1).alias("conv_id"), F.col("_said").alias("_heard"))
    rows = said.hint("merge").join(heard, "conv_id").select("conv_id", in_order("_said", turn).alias("turns"), in_order("_heard", segment).alias("segments"))
    rows = rows.withColumn("_t", F.flatten("turns.tokens")).withColumn("_h", F.flatten("segments.tokens"))
    # some phrases begin as they are heard and go on as in the transcript, some are never heard
    mark = lambda j: F.struct((F.lit(j) % 2 + 1).alias("tape"), F.format_string("mark %d", F.lit(j)).alias("label"), F.lit(j * 30.0).alias("tape_seconds"), (F.concat(F.slice("_h", 40 * j + 1, 3), F.slice("_t", 40 * j + 1, 4)) if j < 6 else F.slice("_t", 1, j - 5)).alias("phrase"))
    extra = F.when(F.col("conv_id") % 10 == 3, F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>"))
    return rows.select("conv_id", F.concat("_t", extra).alias("truth"), "turns", "segments", F.array(*map(mark, range(9))).alias("anchors"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a printed transcript's raw lines: a tag line for each turn, pieces of text with blank lines,
    page numbers, tape marks and editorial insertions between them."""
    none = F.array().cast("array<string>")
    tag = F.when(F.col("role") == "user", F.array(F.lit("US:"))).when(F.col("role") == "assistant", F.array(F.lit("AS:"))).otherwise(none)
    turn = F.col("turn")
    piece = lambda x, p: F.concat(
        F.when((p > 0) & ((p + turn) % 3 == 0), F.array(F.lit(""))).otherwise(none), F.when(p % 7 == 5, F.array(p.cast("string"))).otherwise(none),
        F.when((p == 2) & (turn % 3 == 1), F.array(F.lit("Tape II"), F.concat(F.lit("00:0"), turn % 10, F.lit(":15")))).otherwise(none),
        F.array(F.when(p % 5 == 1, F.concat(x, F.lit(" [note] "))).otherwise(x)))
    lines = F.concat(tag, F.flatten(F.transform(F.split("text", "[,\n]"), piece)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(lines).alias("p", "line")).select("conv_id", (turn * 100000 + F.col("p")).alias("line_no"), "line")


def delayed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of vectors in a row, each vector with a loudness of its own, and the same ones begun some samples later."""
    loud = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") * 7919 % 13))
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 25).cast("long").alias("signal"), F.struct("vec_id", loud.alias("x")).alias("v"))
    rows = rows.groupBy("signal").agg(F.flatten(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["x"])).alias("a"))
    return rows.withColumn("b", F.concat(F.array_repeat(F.lit(0.0), (F.col("signal") * 37 % 200).cast("int")), "a"))
