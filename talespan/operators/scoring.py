"""Scoring of whole recordings against a transcript: edits with places, terms, tape drift, speakers, structure, scorecards.

A recording is one row: keys, `truth` (tokens), `turns` (array of speaker and tokens, in order), `segments`
(array of start_time, end_time, tokens and words, a word being its text, start, end and tokens, in order) and
`anchors` (array of tape, label, tape_seconds and phrase, tokens). Arrays may be null and count as empty then.
Keys are unique. Tokens are what `functions.text` makes of a text; heard tokens are those of the segments.

Work is spread by token, not by recording: streams are exploded, joined and windowed. A recording's edit script
alone is made by one task, in memory that grows with the power 1.5 of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespan.operators import evaluate
from talespan.runtime import materialize

# Fixed values of the reports.
VERSION, CONFUSIONS, RANKED, GRID_SECONDS, GRID_SLACK, LEAST_PREFIX = 4, 6, 40, 30.0, 0.1, 3
_TOKENS = "array<string>"


def _array(name: str, kind: str = _TOKENS) -> Column:
    return F.coalesce(F.col(name), F.array().cast(kind))


def _whole(parts: Column) -> Column:
    """The arrays of an array as one; null ones among them count as empty."""
    return F.flatten(F.filter(parts, lambda p: p.isNotNull()))


def heard_tokens(segments: Column) -> Column:
    """Tokens of all segments."""
    return F.coalesce(_whole(segments["tokens"]), F.array().cast(_TOKENS))


def pairs(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Both token streams of each recording."""
    return recordings.select(*keys, _array("truth").alias("truth"), heard_tokens(F.col("segments")).alias("heard"))


def spans(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """The ranges that both streams cover, see `evaluate.anchors`."""
    return evaluate.anchors(pairs(recordings, keys), keys)


def edits(recordings: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Edit script between the ranges: idx, op, truth, heard, and the places `truth_pos` and `heard_pos` in the
    whole streams before which the edit stands."""
    cut = pairs(recordings, keys).hint("merge").join(ranges, keys)
    part = lambda c, x, y: F.slice(c, F.col(x) + 1, F.col(y) - F.col(x))
    ops = evaluate.scripts(cut.select(*keys, "t0", "h0", part("truth", "t0", "t1").alias("truth"), part("heard", "h0", "h1").alias("heard")), [*keys, "t0", "h0"])
    return ops.select(*keys, "idx", "op", "truth", "heard", (F.col("t0") + F.col("truth_pos")).alias("truth_pos"), (F.col("h0") + F.col("heard_pos")).alias("heard_pos"))


# --- terms ---------------------------------------------------------------------------------


def _occurrences(streams: DataFrame, keys: list[str], terms: DataFrame, most: int) -> DataFrame:
    """(keys, term_id, n): leftmost occurrences without overlaps of every term in (keys, tokens)."""
    near = F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.slice("tokens", i + 1, most).alias("next")))
    places = streams.select(*keys, F.inline(near)).join(terms, F.col("token") == F.col("first")).where(F.slice("next", 1, F.size("words")) == F.col("words"))
    step = lambda s, p: F.when(p >= s["free"], F.struct((s["n"] + 1).alias("n"), (p + F.col("size")).alias("free"))).otherwise(s)
    counted = places.groupBy(*keys, "term_id", F.size("words").alias("size")).agg(F.array_sort(F.collect_list("pos")).alias("at"))
    return counted.select(*keys, "term_id", F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("free")), step)["n"].alias("n"))


def lexicon_report(recordings: DataFrame, ranges: DataFrame, ops: DataFrame, terms: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Recall of a lexicon's terms, for each recording and term that its truth has, and for each recording.

    `terms` is (term_id, term, words: array of tokens), in the lexicon's order; a term may have several tokens and those without
    any are left out. Occurrences are found in the common ranges. First table: keys, rank, term, expected, found, confusions
    (what was heard for the term's tokens where it was missed: the first six, sorted), most missed first.
    Second table: keys, expected, found and recall, which is 1 where nothing is expected.
    """
    sought = terms.where(F.size("words") > 0).select("term_id", "term", "words", F.element_at("words", 1).alias("first"))
    many, most = sought.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("words")), F.lit(1))).first()
    # the terms go to the tokens, so that these stay where they are; a long lexicon is joined
    sent = F.broadcast if many <= evaluate.BROADCAST_TERMS else lambda df: df
    sought = sent(sought)
    cut = pairs(recordings, keys).hint("merge").join(ranges, keys)
    part = lambda c, x, y: cut.select(*keys, F.slice(c, F.col(x) + 1, F.col(y) - F.col(x)).alias("tokens"))
    expected = _occurrences(part("truth", "t0", "t1"), keys, sought, most).withColumnRenamed("n", "expected")
    heard = _occurrences(part("heard", "h0", "h1"), keys, sought, most).withColumnRenamed("n", "heard")
    rows = expected.join(heard, [*keys, "term_id"], "left").withColumn("found", F.least(F.coalesce("heard", F.lit(0)), "expected")).drop("heard")
    rows = materialize(rows.join(sent(sought.select("term_id", "term", "words")), "term_id"))  # a row for each recording and term that it has; both tables read it
    asked = sent(sought.select(F.explode("words").alias("token")).distinct())
    wrong = ops.where("op = 'sub'").select(*keys, F.col("truth").alias("token"), F.col("heard").alias("wrote")).join(asked, "token").distinct()
    missed = rows.where("found < expected").select(*keys, "term_id", F.explode(F.array_distinct("words")).alias("token"))
    confused = missed.join(wrong.hint("merge"), [*keys, "token"]).groupBy(*keys, "term_id").agg(F.slice(F.array_sort(F.collect_set("wrote")), 1, CONFUSIONS).alias("confusions"))
    by = W.partitionBy(*keys).orderBy(F.desc(F.col("expected") - F.col("found")), F.desc("expected"), "term_id")
    each = rows.join(confused, [*keys, "term_id"], "left").select(*keys, F.row_number().over(by).alias("rank"), "term", "expected", "found", _array("confusions").alias("confusions"))
    sums = rows.groupBy(*keys).agg(F.sum("expected").alias("expected"), F.sum("found").alias("found"))
    zero = F.lit(0).cast("long")
    whole = recordings.select(*keys).join(sums, keys, "left").select(*keys, F.coalesce("expected", zero).alias("expected"), F.coalesce("found", zero).alias("found"))
    return each, whole.withColumn("recall", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("found") / F.col("expected")))


# --- tape drift ----------------------------------------------------------------------------


def located(recordings: DataFrame, keys: list[str], ranges: DataFrame | None = None) -> DataFrame:
    """Anchors with the media time of the first place where their phrase, or else its longest possible prefix, is heard.

    The stream is that of the timed words, within what it shares with the truth. A prefix has three tokens at
    least, or all of a shorter phrase. One row an anchor: keys, at (its place), tape, label, tape_seconds, media_seconds.
    ranges, as `spans` gives them, hold for recordings whose timed words have the tokens of their segments; the others get their own.
    """
    timed = _whole(F.transform("segments", lambda s: _whole(F.transform(s["words"], lambda w: F.transform(w["tokens"], lambda t: F.struct(t.alias("token"), w["start"].alias("start")))))))
    streams = recordings.select(*keys, _array("truth").alias("truth"), F.coalesce(timed, F.array().cast("array<struct<token:string,start:double>>")).alias("timed"), heard_tokens(F.col("segments")).alias("said"))
    streams = streams.select(*keys, "truth", "timed", F.col("timed.token").eqNullSafe(F.col("said")).alias("same"))
    own = streams if ranges is None else materialize(streams.where("not same"))
    made = evaluate.anchors(own.select(*keys, "truth", F.col("timed.token").alias("heard")), keys)
    ranges = made if ranges is None else ranges.join(own.select(*keys), keys, "left_anti").unionByName(made)
    marks = recordings.select(*keys, F.posexplode("anchors").alias("at", "a")).select(*keys, "at", "a.*")
    heard = streams.hint("merge").join(ranges, keys).select(*keys, F.posexplode(F.slice("timed", F.col("h0") + 1, F.col("h1") - F.col("h0"))).alias("pos", "w")).select(*keys, "pos", "w.*")
    # a phrase's tokens meet the stream one by one; places that agree on where the phrase begins are counted together
    sought = marks.select(*keys, "at", F.size("phrase").alias("size"), F.posexplode("phrase").alias("i", "token"))
    met = heard.join(sought.hint("merge"), [*keys, "token"]).groupBy(*keys, "at", "size", (F.col("pos") - F.col("i")).alias("begin"))
    runs = met.agg(F.array_sort(F.collect_set("i")).alias("have"), F.max(F.when(F.col("i") == 0, F.col("start"))).alias("start"))
    first = runs.withColumn("length", F.size(F.filter("have", lambda i, n: i == n))).where(F.col("length") >= F.least(F.lit(LEAST_PREFIX), F.col("size")))
    best = first.groupBy(*keys, "at").agg(F.max(F.struct("length", -F.col("begin"), "start"))["start"].alias("media_seconds"))
    return marks.drop("phrase").hint("merge").join(best, [*keys, "at"], "left")


def drift_report(places: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Residuals of anchors from their tape's line (keys, at, tape, label, tape_seconds, media_seconds, residual), and a
    recording's time_slope: that of the tape with most points, the first of these on a tie. Two different points make a line."""
    places = materialize(places)  # a row for each anchor; rows and slopes read it
    timed = places.where("media_seconds is not null")
    x, y = F.col("tape_seconds"), F.col("media_seconds")
    lines = timed.groupBy(*keys, "tape").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("points")).where("slope is not null")
    rows = places.join(lines, [*keys, "tape"], "left").withColumn("residual", y - (F.col("slope") * x + F.col("intercept")))
    slope = lines.groupBy(*keys).agg(F.max(F.struct("points", -F.col("tape"), "slope"))["slope"].alias("time_slope"))
    return rows.select(*keys, "at", "tape", "label", "tape_seconds", "media_seconds", "residual"), slope


# --- speakers ------------------------------------------------------------------------------


def speaker_report(recordings: DataFrame, ops: DataFrame, keys: list[str]) -> DataFrame:
    """How far segment boundaries follow the truth's changes of speaker; a row for each recording that can be judged.

    A change lies between the last matched token before it and the first from it on, both within reach; it is
    covered if a segment begins between what was heard for them. The chance expectation is that of
    boundaries as dense but anywhere. No row where there are no turns or segments, where nothing was heard, where the
    turns' tokens are not as many as the truth's, or where no change can be placed.
    """
    sizes = recordings.select(*keys, "turns", "segments", F.size(_array("truth")).alias("n"), F.size(heard_tokens(F.col("segments"))).alias("m"), F.coalesce(F.size("segments"), F.lit(0)).alias("parts"), F.aggregate("turns", F.lit(0), lambda n, t: n + F.coalesce(F.size(t["tokens"]), F.lit(0))).alias("said"))
    fair = sizes.where("n = said and m > 0 and parts > 0")
    # what holds for a turn or segment, at the place of each of its tokens
    spread = lambda c, what: F.posexplode(F.flatten(F.transform(c, lambda p, i: F.array_repeat(what(p, i), F.coalesce(F.size(p["tokens"]), F.lit(0))))))
    truth = fair.select(*keys, spread("turns", lambda p, i: p["speaker"]).alias("pos", "speaker"))
    heard = fair.select(*keys, spread("segments", lambda p, i: i).alias("heard_pos", "seg"))
    matched = ops.where("op = 'match'").select(*keys, F.col("truth_pos").alias("pos"), "heard_pos").join(heard.hint("merge"), [*keys, "heard_pos"])
    positions = truth.join(matched.hint("merge"), [*keys, "pos"], "left")
    found = evaluate.speaker_boundaries(positions, keys).where("changes > 0").join(fair.select(*keys, "m", F.col("parts").alias("segments")), keys)
    chance = F.col("changes") * F.col("segments") / F.col("m")
    return found.select(*keys, "changes", "covered", (F.col("changes") - F.col("covered")).alias("bleed"), chance.alias("expected_by_chance"), (F.col("covered") / chance).alias("lift"), (F.col("m") / F.col("segments")).alias("mean_segment_tokens"))


# --- structure -----------------------------------------------------------------------------


def structure_report(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of words with control marks, without duration, too long to be true and ending before they begin; the
    upper median of segment durations, and the share of segments that begin on the 30 s grid. All within a row."""
    segments = F.coalesce(F.col("segments"), F.array().cast(recordings.schema["segments"].dataType))
    words = _whole(F.transform(segments, lambda s: s["words"]))
    count = lambda test: F.size(F.filter("_words", test))
    long = lambda w: (w["end"] - w["start"] > 2.0) & (w["end"] - w["start"] > F.char_length(w["text"]) / 4.0)
    phase = lambda s: F.least(s["start_time"] % GRID_SECONDS, F.lit(GRID_SECONDS) - s["start_time"] % GRID_SECONDS)
    n = F.size("_segments")
    durations = F.array_sort(F.transform("_segments", lambda s: s["end_time"] - s["start_time"]))
    rows = recordings.select(*keys, segments.alias("_segments"), F.coalesce(words, F.array().cast(recordings.schema["segments"].dataType.elementType["words"].dataType)).alias("_words"))
    return rows.select(
        *keys, n.alias("segments"), F.size("_words").alias("words"), count(lambda w: F.contains(w["text"], F.lit("[_"))).alias("control_token_words"), count(lambda w: w["end"] <= w["start"]).alias("zero_duration_words"), count(long).alias("implausible_duration_words"), count(lambda w: w["end"] < w["start"]).alias("backwards_time_words"),
        F.when(n > 0, F.size(F.filter("_segments", lambda s: phase(s) < GRID_SLACK)) / n).otherwise(0.0).alias("boundary_quantization"), F.when(n > 0, F.element_at(durations, F.floor(n / 2).cast("int") + 1)).otherwise(0.0).alias("median_segment_seconds"),
    )


# --- scorecards ----------------------------------------------------------------------------


def error_report(recordings: DataFrame, ranges: DataFrame, ops: DataFrame, keys: list[str]) -> DataFrame:
    """Word errors within the common ranges; insertions count apart as fillers and content."""
    script = F.transform(F.array_sort(F.collect_list(F.struct("idx", "op", "truth", "heard"))), lambda o: F.struct(o["op"].alias("op"), o["truth"].alias("truth"), o["heard"].alias("heard")))
    counts = ops.groupBy(*keys).agg(F.count_if(F.col("op") == "sub").alias("subs"), F.count_if(F.col("op") == "del").alias("dels"), F.count_if(F.col("op") == "ins").alias("ins"), script.alias("script"))
    kinds = counts.select(*keys, "subs", "dels", "ins", evaluate.classify_insertions("script").alias("k"))
    zero = F.lit(0).cast("long")
    rows = ranges.select(*keys, (F.col("t1") - F.col("t0")).alias("truth_tokens"), (F.col("h1") - F.col("h0")).alias("hyp_tokens")).join(kinds, keys, "left")
    rows = rows.select(*keys, "truth_tokens", "hyp_tokens", *(F.coalesce(c, zero).alias(c) for c in ("subs", "dels", "ins")), F.coalesce("k.filler", zero).alias("ins_filler"), F.coalesce("k.content", zero).alias("ins_content"))
    return rows.withColumn("rate", F.when(F.col("truth_tokens") > 0, (F.col("subs") + F.col("dels") + F.col("ins")) / F.col("truth_tokens")).otherwise(0.0)).drop("ins")


def taxonomy_report(ops: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent substitutions, insertions and deletions of each recording: arrays of truth, heard and n."""
    counts = ops.where("op <> 'match'").groupBy(*keys, "op", "truth", "heard").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(W.partitionBy(*keys, "op").orderBy(F.desc("n"), "truth", "heard"))).where(F.col("rn") <= RANKED)
    rows = lambda op: F.transform(F.array_sort(F.collect_list(F.when(F.col("op") == op, F.struct("rn", "truth", "heard", "n")))), lambda x: F.struct(x["truth"].alias("truth"), x["heard"].alias("heard"), x["n"].alias("n")))
    return ranked.groupBy(*keys).agg(rows("sub").alias("substitutions"), rows("ins").alias("insertions"), rows("del").alias("deletions"))


def scorecards(recordings: DataFrame, terms: DataFrame, keys: list[str], ranges: DataFrame | None = None, ops: DataFrame | None = None) -> DataFrame:
    """One nested row a recording: wer, lexicon, drift, structure with speaker and time_slope, taxonomy, and how it was anchored.

    ranges and ops: as `spans` and `edits` give them, where the caller has kept them; every part reads both. Each part, a row for a
    recording, is kept before they are joined: one plan of all of them is more than a driver of common size holds.
    """
    ranges = spans(recordings, keys) if ranges is None else ranges
    ops = edits(recordings, ranges, keys) if ops is None else ops
    named = lambda df, name: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))
    listed = lambda df, by, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(by, *(c for c in df.columns if c not in (*keys, by))))).alias(name))
    each, whole = lexicon_report(recordings, ranges, ops, terms, keys)
    drift, slope = drift_report(located(recordings, keys, ranges), keys)
    out = ranges.select(*keys, "confidence", F.array("t0", "t1").alias("anchored_truth_range"), F.array("h0", "h1").alias("anchored_hyp_range"), F.col("partial").alias("partial_coverage"))
    # each is kept before the next is planned
    speaker = materialize(named(speaker_report(recordings, ops, keys), "speaker"))
    structure = structure_report(recordings, keys).join(slope.hint("merge"), keys, "left").join(speaker.hint("merge"), keys, "left")
    parts = [named(error_report(recordings, ranges, ops, keys), "wer"), whole.select(*keys, "recall"), listed(each, "rank", "terms"), listed(drift, "at", "drift"), named(structure, "structure"), named(taxonomy_report(ops, keys), "taxonomy")]
    for part in parts:
        out = out.join(materialize(part).hint("merge"), keys, "left")
    return out.select(*keys, F.lit(VERSION).alias("harness_version"), "wer", F.struct("recall", F.coalesce("terms", F.array().cast(out.schema["terms"].dataType)).alias("terms")).alias("lexicon"), "drift", "structure", F.col("confidence").alias("anchor_confidence"), "anchored_truth_range", "anchored_hyp_range", "partial_coverage", "taxonomy")
