"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talespan.functions import normal
from talespan.functions import text as tx
from talespan.operators import archive, assembly, corpus, evaluate, frames, fulltext, graph, intervals, scoring, signals, speakers, transcripts, words
from talespan.plans import views
from talespan.runtime import keep, materialize, ship, table
from talespan.sources import manifests, sinks
from talespan.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TERMS = ["the", "that", "nicht", "pour", "para"]
PHRASES = [["of", "the"], ["the", "the"], ["in", "the", "of"]]
TOPICS = ["thtion", "nicht", "queque"]
GROUPS = {"North": "thtion", "East": "keit", "South": "ment", "West": "ciones"}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def hybrid_wrrf(spark, d):
    text = archive.top(archive.text_scores(table(spark, d, "documents"), TERMS), "doc_id").withColumnRenamed("doc_id", "id")
    return archive.fused([(text, archive.FULLTEXT_WEIGHT), (archive.top(_near_seven(spark, d), "vec_id").withColumnRenamed("vec_id", "id"), archive.VECTOR_WEIGHT)])


def _near_seven(spark, d):
    vectors = table(spark, d, "embeddings")
    return archive.similar(vectors, vectors.where("vec_id = 7").select("embedding"), "vec_id")


@query
def text_score_topk(spark, d):
    return archive.top(archive.text_scores(table(spark, d, "documents"), TERMS), "doc_id")


@query
def vector_topk(spark, d):
    return archive.top(_near_seven(spark, d), "vec_id")


@query
def transcript_view(spark, d):
    people = views.statements(spark, d).where("speaker <> 'system'").select("interview", "speaker").distinct().withColumn("person", F.concat(F.lit("p_"), "speaker", F.lit("_"), "interview"))
    return archive.statements_with_people(views.statements(spark, d), people).select("interview", "uid", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"), F.coalesce("person", F.lit("")).alias("person"))


@query
def interviews_first5(spark, d):
    return archive.latest_interviews(views.interviews(spark, d)).withColumn("date", F.col("date").cast("string"))


@query
def interview_lookup(spark, d):
    return archive.interview_lookup(views.interviews(spark, d), uid="iv7").withColumn("date", F.col("date").cast("string"))


@query
def span_at_time(spark, d):
    times = views.interviews(spark, d).select(F.col("number").alias("interview"), F.explode(F.array(*map(F.lit, (0.5, 10.5, 21.75, 500.0)))).alias("t"))
    return archive.span_at_time(views.statements(spark, d), times).select("interview", "t", "uid")


@query
def statement_text_match(spark, d):
    return archive.statement_text(views.statements(spark, d), "tion").select("interview", "uid", "start_time")


@query
def captions_vtt(spark, d):
    return archive.captions(views.statements(spark, d)).select("interview", "uid", "cue")


@query
def dominant_speaker(spark, d):
    t = views.ticks(spark, d)
    w = F.lead("t").over(intervals.W.partitionBy("user_id").orderBy("seq"))
    speech = t.withColumn("r_end", w).where("r_end is not null").select("user_id", F.col("event_type").alias("speaker"), F.col("t").alias("r_start"), "r_end")
    cells = t.select("user_id", F.floor(F.col("t") / 21600).alias("segment")).distinct().withColumn("l_start", F.col("segment") * 21600).withColumn("l_end", F.col("segment") * 21600 + 21600)
    return intervals.dominant(cells, speech, ["user_id"], 43200.0).select("user_id", "segment", F.coalesce("speaker", F.lit("")).alias("speaker"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


@query
def change_boundaries(spark, d):
    return intervals.changes(views.ticks(spark, d), ["user_id"], ["seq"], "event_type").select("user_id", "t", "before", "event_type")


@query
def boundary_recall(spark, d):
    t = views.ticks(spark, d).withColumn("high", F.col("value") > 50)
    real = intervals.changes(t, ["user_id"], ["seq"], "event_type").select("user_id", "t").distinct()
    guess = intervals.changes(t, ["user_id"], ["seq"], "high").select("user_id", F.col("t").alias("m"))
    hit = intervals.within(real, guess, ["user_id"], 3600.0)
    return hit.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("detected"))


@query
def pairwise_diagnostic(spark, d):
    rows = table(spark, d, "embeddings").withColumn("recording", F.floor(F.col("vec_id") / 40))
    pairs = speakers.pair_distances(rows, ["recording"], "vec_id", "embedding", "label")
    return pairs.groupBy("recording", "same").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query
def speech_islands(spark, d):
    found = intervals.islands(views.ticks(spark, d), ["user_id"], "seq", F.col("event_type") != "view")
    return found.select("user_id", "first", "last", "frames")


@query
def timeline_remap(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    regions = c.select("conv_id", (F.col("turn") * 20.0).alias("orig_start"), (F.col("turn") * 5.0 + 1).alias("filtered_start"), F.lit(3.0).alias("duration"))
    points = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, (0.5, 2.5, 4.75, 7.25, 99.0)))).alias("t"))
    return intervals.to_original(points, regions, ["conv_id"])


@query
def word_end_lead(spark, d):
    w = views.words(spark, d).withColumn("start", F.col("idx") * 0.5)
    return words.word_ends(w, ["doc_id"], "segment_end").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("end") * (F.col("idx") % 3 + 1)), 3).alias("weighted_ends"))


@query
def word_time_carry(spark, d):
    w = words.carry_time(views.words(spark, d).withColumn("segment_start", F.lit(0.25)), ["doc_id"], "at", "segment_start")
    return w.groupBy("doc_id").agg(F.round(F.sum(F.col("start") * (F.col("idx") % 3 + 1)), 3).alias("weighted_starts"))


@query
def drift_fit(spark, d):
    points = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("tape"), "o_orderkey", (F.col("o_orderkey") / 100.0).alias("tape_seconds"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 1000.0).alias("media_seconds"))
    return evaluate.drift(points).select("o_orderkey", F.round("slope", 6).alias("slope"), F.coalesce(F.round("residual", 4), F.lit(-999.0)).alias("residual"))


@query
def structure_stats(spark, d):
    return evaluate.structure(views.statements(spark, d), ["interview"])


@query
def wer_from_ops(spark, d):
    ship(spark)
    return evaluate.word_errors(evaluate.ops_table(views.turn_pairs(spark, d), ["conv_id", "turn"]), ["conv_id", "turn"])


@query
def error_taxonomy(spark, d):
    ship(spark)
    return evaluate.taxonomy(evaluate.ops_table(views.turn_pairs(spark, d), ["conv_id", "turn"]))


@query
def lexicon_recall(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", F.explode(archive.terms_of(F.col("text"))).alias("token"))
    terms = spark.createDataFrame(list(enumerate([*TERMS, "tion", "zzzz"])), "pos int, term string")
    return evaluate.lexicon_recall(tokens.where("doc_id % 2 = 0"), tokens.where("doc_id % 2 = 1"), terms)


@query
def diagonal_votes(spark, d):
    pairs = views.turn_pairs(spark, d)
    keys = ["conv_id", "turn"]
    side = lambda c: pairs.select(*keys, F.posexplode(c).alias("pos", "token"))
    return evaluate.best_offsets(evaluate.diagonal_votes(side("truth"), side("heard"), keys), keys)


@query
def speaker_boundaries(spark, d):
    rows = views.words(spark, d).select("doc_id", F.col("idx").alias("pos"), F.floor(F.col("idx") / 11).cast("string").alias("speaker"), F.when(F.length("word") % 3 > 0, F.floor(F.col("idx") / 7)).alias("seg"))
    return evaluate.speaker_boundaries(rows, ["doc_id"])


@query
def topic_rank(spark, d):
    return corpus.topic_hits(corpus.lines_of(table(spark, d, "documents"), "doc_id"), "doc_id", TOPICS, 40)


@query
def group_roster(spark, d):
    return corpus.group_roster(table(spark, d, "documents"), "doc_id", GROUPS)


@query
def bridges(spark, d):
    return corpus.bridges(corpus.group_roster(table(spark, d, "documents"), "doc_id", GROUPS), "doc_id")


@query
def sticky_speaker(spark, d):
    return corpus.speech_lines(views.tagged_lines(spark, d), "conv_id")


@query
def timecode_interp(spark, d):
    t = views.ticks(spark, d).select("user_id", "seq", F.when(F.col("event_id") % 5 == 0, (F.floor(F.col("t") / 60) % 7200).cast("double")).alias("clock"))
    marks = corpus.tape_seconds(t.where("clock is not null"), "user_id", "seq", "clock").select("user_id", "seq", F.col("seconds").alias("anchor"))
    return intervals.interpolate(t.join(marks, ["user_id", "seq"], "left"), ["user_id"], "seq", "anchor").select("user_id", "seq", "seconds")


@query
def stem_antijoin(spark, d):
    pages = table(spark, d, "pages").select("page_id", tx.stem(F.regexp_replace("url", r"^https?://", "")).alias("stem"))
    return corpus.missing_stems(pages, pages.where("page_id % 3 <> 0")).select("page_id", "stem")


@query
def best_download(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "source").otherwise("sd").alias("quality"), F.col("l_quantity").alias("width"), F.col("l_extendedprice").alias("size"), F.col("l_linenumber").cast("string").alias("link"))
    return corpus.best_download(rows, "l_orderkey")


@query
def low_conf_windows(spark, d):
    arr = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (((F.length(w) * 7 + i) % 100) / 100.0).alias("p")))
    rows = table(spark, d, "documents").select("doc_id", arr.alias("words")).select("doc_id", words.suspects(F.col("words")).alias("context"))
    return rows.where("context is not null")


@query
def collapse_repeats(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.size(tx.collapse_repeats(F.col("w"))).alias("n_kept"))


@query
def ingest_statements(spark, d):
    s = views.statements(spark, d)
    item = F.struct("turn", F.struct("speaker", "text", "start_time", "end_time").alias("s"))
    seeds = s.withColumn("speaker", F.when(F.col("speaker") != "system", F.col("speaker"))).groupBy(F.col("interview").alias("number")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"])).alias("segments"))
    return sinks.statements(seeds).select("interview", "pos", "uid", "speaker", "text")


@query
def upsert_parts(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return sinks.upsert(parts.where("p_partkey % 4 <> 0"), parts.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100), ["p_partkey"])


@query
def embedding_parameters(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.camel_name(F.col("text")).alias("name"))


@query
def mean_to_mono(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"), F.col("l_quantity").alias("value"))
    return words.to_mono(rows, ["l_orderkey"], 2)


@query
def event_windows(spark, d):
    return jobs.event_windows(table(spark, d, "events"))


@query
def align_ops(spark, d):
    ship(spark)
    return evaluate.ops_table(views.turn_pairs(spark, d), ["conv_id", "turn"])


@query
def insertion_classes(spark, d):
    ship(spark)
    ops = evaluate.ops_table(views.turn_pairs(spark, d), ["conv_id", "turn"])
    script = F.transform(F.array_sort(F.collect_list(F.struct("idx", "op", "truth", "heard"))), lambda o: F.struct(o["op"].alias("op"), o["truth"].alias("truth"), o["heard"].alias("heard")))
    rows = ops.groupBy("conv_id", "turn").agg(script.alias("ops"))
    return rows.select("conv_id", "turn", evaluate.classify_insertions("ops").alias("k")).select("conv_id", "turn", "k.filler", "k.content")


@query
def normalize_tokens(spark, d):
    ship(spark)
    return normal.normalized(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "tokens")


@query
def cluster_labels(spark, d):
    ship(spark)
    rows = table(spark, d, "embeddings").withColumn("recording", F.floor(F.col("vec_id") / 40))
    return speakers.cluster(rows, "recording", "vec_id", "embedding")


@query
def fuzzy_match(spark, d):
    ship(spark)
    nation = table(spark, d, "nation")
    names = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.expr("substring(n_name, 2)"), F.lit(" "), F.col("c_custkey")).alias("heard"))
    return corpus.fuzzy_best(names, nation, "heard", "n_name", "n_nationkey")


@query
def difflib_wer(spark, d):
    ship(spark)
    c = table(spark, d, "conversations").select("conv_id", "turn", tx.plain_tokens(F.col("text")).alias("w"))
    # joined on the turn too, so that one long conversation spreads over the tasks
    pairs = c.select("conv_id", "turn", F.col("w").alias("g")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("h")), ["conv_id", "turn"])
    scored = pairs.withColumn("e", tx.block_edits("g", "h"))
    longer = lambda p: F.greatest(F.size(p["gold"]), F.size(p["heard"]))
    lexical = F.aggregate(F.filter("e.pairs", lambda p: tx.classify(p["gold"], p["heard"]) == "lexical"), F.lit(0), lambda n, p: n + longer(p))
    return scored.select("conv_id", "turn", *evaluate.difference_columns(F.col("e")), tx.verdict(F.size("g"), F.size("h"), lexical).alias("verdict"))


@query
def resample(spark, d):
    ship(spark)
    files = table(spark, d, "embeddings").select(F.col("vec_id").alias("file"), F.lit(48000).cast("long").alias("rate"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    return words.resampled(files, 16000)


@query
def job_registry(spark, d):
    ship(spark)
    kind = F.element_at(F.array(*map(F.lit, ("submit", "status", "cancel", "done", "submit"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("slot"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("job"))
    return jobs.replay(rows)


@query
def vad_regions(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    speech = c.select("conv_id", (F.col("turn") * 4.0 + 0.25).alias("start"), (F.col("turn") * 4.0 + 2.5).alias("end"), F.lit(25.0).alias("total"))
    return assembly.vad_timeline(speech, "conv_id").select("conv_id", *(F.round(x, 6).alias(x) for x in ("orig_start", "filtered_start", "duration")))


@query
def speaker_turns(spark, d):
    return assembly.turns(corpus.speech_lines(views.tagged_lines(spark, d), "conv_id"), "conv_id")


@query
def statement_chunks(spark, d):
    rows = views.statements(spark, d).withColumn("speaker", F.when(F.col("turn") % 4 < 3, "A").otherwise("B"))
    return assembly.chunks(rows, "interview", 20.0).select("interview", "run", "part", "speaker", "start_time", F.round("end_time", 3).alias("end_time"), F.length("text").alias("n_chars"))


@query
def gold_transcript(spark, d):
    text = F.concat(F.lit("Cover page\nInterview of X\nSARAH DOE: "), "text", F.lit("\nA PROGRAM OF y\nAF: yes"))
    return table(spark, d, "documents").select("doc_id", assembly.gold_text(text).alias("gold"))


@query
def paper_match(spark, d):
    docs = table(spark, d, "documents")
    return assembly.prefix_match(docs.select(F.concat(F.col("doc_id") % 300, F.lit(".wav.json")).alias("file"), "doc_id"), docs.where("doc_id % 2 = 0").select(F.concat("doc_id", F.lit(" "), "source").alias("paper"))).select("doc_id", "file", F.coalesce("paper", F.lit("")).alias("paper"))


@query
def lexicon_phrases(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", archive.terms_of(F.col("text")).alias("tokens"))
    return assembly.phrase_counts(tokens, "doc_id", PHRASES)


@query
def vector_norms(spark, d):
    norm = table(spark, d, "embeddings").select("label", signals.l2_norm(F.col("embedding")).alias("x"))
    return norm.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.round(f("x"), 5).alias(f"{name}_norm") for name, f in (("mean", F.avg), ("least", F.min), ("most", F.max))))


@query
def signal_compare(spark, d):
    rows = table(spark, d, "embeddings")
    pairs = rows.select("vec_id", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    best = signals.best_lag(F.col("a"), F.col("b"), 2)
    return pairs.select("vec_id", F.round(signals.rms(F.col("a")), 5).alias("level"), best.alias("best"), F.round(F.element_at(signals.envelope(F.col("a"), 24), -1), 5).alias("last_block")).select("vec_id", "level", "last_block", F.round("best.correlation", 5).alias("correlation"), "best.lag")


@query
def ingest_edges(spark, d):
    people = views.statements(spark, d).where("speaker <> 'system'").select("interview", "speaker").distinct().select("interview", "speaker", F.format_string("p%d_%s", "interview", "speaker").alias("person_uid"))
    contains, says = sinks.edges(views.statements(spark, d), people)
    both = says.join(contains, ["interview", "statement_uid"])
    return both.select("interview", "statement_uid", "speaker_label", F.coalesce("person_uid", F.lit("")).alias("person_uid"), "start_time", F.round("end_time", 3).alias("end_time"))


@query
def search_hits(spark, d):
    s = views.statements(spark, d)
    found = archive.text_scores(s.select("uid", "text"), ["nicht", "the", "pour"], "uid", "text")
    return archive.hits(archive.top(found, "uid", 15), s, "uid").select("rank", "uid", "interview", "speaker", "start_time", "score")


@query
def phrase_places(spark, d):
    ship(spark)
    pairs = views.turn_pairs(spark, d)
    return pairs.select("conv_id", "turn", assembly.locate("heard", F.slice("truth", 1, 5)).alias("place"))


@query
def diarization_score(spark, d):
    ship(spark)
    t = views.ticks(spark, d)
    w = intervals.W.partitionBy("user_id").orderBy("seq")
    spans = t.withColumn("stop", F.lead("t").over(w)).where("stop > t")
    truth = spans.select("user_id", F.col("seq").alias("segment"), F.col("t").cast("double").alias("l_start"), F.col("stop").cast("double").alias("l_end"), F.when(F.col("value") > 50, "high").otherwise("low").alias("name"))
    guess = spans.select("user_id", F.when(F.col("event_type").isin("purchase", "signup"), "S1").otherwise("S0").alias("speaker"), F.col("t").cast("double").alias("r_start"), F.col("stop").cast("double").alias("r_end"))
    score = assembly.diarization_score(truth, guess, "user_id", 43200.0, 3600.0)
    return score.withColumn("mapping", F.array_join(F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))


KEY = ["conv_id"]


def _scored(spark, d):
    """Recordings and their common ranges, kept, since every report reads them, and edit scripts, which one report reads."""
    ship(spark)
    rows = keep(views.recordings(spark, d))
    ranges = materialize(scoring.spans(rows, KEY))
    return rows, ranges, scoring.edits(rows, ranges, KEY)


@query
def recording_edits(spark, d):
    return _scored(spark, d)[2]


@query
def speaker_report(spark, d):
    rows, _, ops = _scored(spark, d)
    known = lambda *names: [F.coalesce(F.round(c, 6), F.lit(-1)).alias(c) for c in names]
    return rows.select(*KEY).join(scoring.speaker_report(rows, ops, KEY), KEY, "left").select(*KEY, *known("changes", "covered", "bleed", "expected_by_chance", "lift", "mean_segment_tokens"))


@query
def lexicon_report(spark, d):
    rows, ranges, ops = _scored(spark, d)
    each, _ = scoring.lexicon_report(rows, ranges, ops, views.lexicon(spark), KEY)
    return each.withColumn("confusions", F.array_join("confusions", " "))


@query
def lexicon_overall(spark, d):
    rows, ranges, ops = _scored(spark, d)
    _, whole = scoring.lexicon_report(rows, ranges, ops, views.lexicon(spark), KEY)
    return whole.withColumn("recall", F.round("recall", 6))


@query
def tape_drift(spark, d):
    rows, slope = scoring.drift_report(scoring.located(keep(views.recordings(spark, d)), KEY), KEY)
    every = lambda c, n: F.coalesce(F.round(c, n), F.lit(-999.0)).alias(c)
    return rows.join(slope, KEY, "left").select(*KEY, F.col("at").alias("mark"), "tape", "label", "tape_seconds", every("media_seconds", 3), (every("residual", 4) + 0.0).alias("residual"), every("time_slope", 5))


@query
def structure_words(spark, d):
    rows = scoring.structure_report(views.recordings(spark, d), KEY)
    return rows.withColumns({c: F.round(c, 6) for c in ("boundary_quantization", "median_segment_seconds")})


@query
def scorecards(spark, d):
    rows, ranges, ops = _scored(spark, d)
    card = scoring.scorecards(rows, views.lexicon(spark), KEY, ranges, keep(ops))
    first = F.get("taxonomy.substitutions", F.lit(0))  # null where nothing was substituted
    known = {"time_slope": F.round("structure.time_slope", 5), "covered": F.col("structure.speaker.covered"), "recall": F.round("lexicon.recall", 6)}
    return card.select(
        *KEY, "harness_version", "wer.subs", "wer.dels", (F.col("wer.ins_filler") + F.col("wer.ins_content")).alias("ins"), "wer.truth_tokens", "wer.hyp_tokens", F.round("wer.rate", 6).alias("rate"), *(F.coalesce(c, F.lit(-1)).alias(name) for name, c in known.items()),
        F.size("lexicon.terms").alias("terms"), F.size(F.filter("drift", lambda a: a["media_seconds"].isNotNull())).alias("found_anchors"), "structure.words", "anchor_confidence", "partial_coverage", F.coalesce(F.concat(first["truth"], F.lit(">"), first["heard"]), F.lit("")).alias("top_substitution"),
    )


TAGS, FURNITURE, REPAIRS = {"US": "SUBJECT", "AS": "INTERVIEWER"}, [r"^[0-9]{1,3}$"], [("thth", "th"), ("tiontion", "tion")]


@query
def rebuilt_turns(spark, d):
    return transcripts.rebuilt(views.raw_lines(spark, d), "conv_id", TAGS, FURNITURE, REPAIRS)[0].withColumn("speaker", F.coalesce("speaker", F.lit("")))


@query
def tape_marks(spark, d):
    return transcripts.rebuilt(views.raw_lines(spark, d), "conv_id", TAGS, FURNITURE, REPAIRS)[1]


@query
def clean_truth(spark, d):
    text = transcripts.cleaned(F.col("text"), [("^Th[a-z]* ", ""), ("[0-9]+$", "")], [("^[0-9]{1,3}$", "page number"), ("^[A-Za-z.]{1,12}$", "debris"), ("[Ll]icen[sc]e", "license")], [(r"\{[^}]*\}", "", "stage directions"), ("tionti", "tion ti", "repairs"), ("ofof ", "of ", "more repairs")])
    counts = F.array_join(F.transform("t.counts", lambda c: F.concat_ws("=", c["rule"], c["n"].cast("string"))), ";")
    return table(spark, d, "documents").select("doc_id", text.alias("t")).select("doc_id", "t.text", counts.alias("counts"))


@query
def speech_segments(spark, d):
    rec = (F.col("vec_id") / 40).cast("long")
    rows = table(spark, d, "embeddings").select(rec.alias("recording"), F.floor(F.col("vec_id") % 40 / 10).alias("window"), (F.col("vec_id") % 10).alias("frame"), F.slice("embedding", 1, 3).alias("scores"), (F.lit(11000) - rec % 3 * 200).alias("total_samples"))
    return frames.speech(rows, "recording", 16000).select("recording", F.round("start", 7).alias("start"), F.round("end", 7).alias("end"))


@query
def interview_paths(spark, d):
    s = views.statements(spark, d)
    people = s.where("speaker <> 'system'").select("interview", "speaker").distinct().select("interview", "speaker", F.format_string("p%d_%s", "interview", "speaker").alias("person_uid"))
    contains, says = sinks.edges(s, people)
    about = s.where("speaker = 'user'").select("interview", F.format_string("p%d_user", "interview").alias("person_uid"))
    hops = [graph.Hop(contains, "interview", "statement_uid", "number", "statement", ("start_time",)), graph.Hop(says, "statement_uid", "person_uid", "statement", "person"), graph.Hop(about, "person_uid", "interview", "person", only_filter=True)]
    return graph.paths(views.interviews(spark, d).select("number"), hops)


@query
def zipped_embeddings(spark, d):
    rows = table(spark, d, "embeddings")
    request = (F.col("vec_id") / 8).cast("long").alias("request")
    texts = rows.select(request, (F.col("vec_id") * 3 + 1).alias("pos"), F.format_string("st%d", "vec_id").alias("uid"))
    both = graph.zipped(texts, rows.select(request, F.col("vec_id").alias("pos"), F.col("embedding").alias("vector")), "request")
    return both.select("request", "uid", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query
def signal_offsets(spark, d):
    ship(spark)
    rows = views.delayed_signals(spark, d).withColumn("lag", signals.global_offset(F.col("a"), F.col("b"), 16))
    both = rows.withColumn("s", signals.shifted(F.col("a"), F.col("b"), F.col("lag")))
    return both.select("signal", "lag", F.size("s.a").alias("overlap"), F.round(signals.correlation(F.col("s.a"), F.col("s.b")), 6).alias("correlation"))


#: Query strings of each kind: words, both, either and not, a phrase, prefixes, parentheses.
SEARCHES = ["the", "nicht AND der", "para OR pour", "the NOT and", '"of the"', "verzu*", "(das OR les) AND -en", '+in "in the" OR tionen*']


@query
def fulltext_syntax(spark, d):
    return fulltext.searches(table(spark, d, "documents"), SEARCHES, analyzer=fulltext.Analyzer(english=False))


@query
def fulltext_english(spark, d):
    ship(spark)
    return fulltext.searches(views.statements(spark, d), ["tions OR erings", '"tion and"', "ering* NOT tions", "edly AND the"], "uid")


@query
def hybrid_statements(spark, d):
    """Text and vector search over the same statements, fused, with the hits."""
    s = views.statements(spark, d)
    text = archive.top(archive.text_scores(s.select("uid", "text"), ["nicht", "the", "pour"], "uid"), "uid").withColumnRenamed("uid", "id")
    vectors = table(spark, d, "embeddings").join(s.select((F.col("interview") * 7 + F.col("turn")).alias("vec_id"), "uid"), "vec_id")
    near = archive.top(archive.similar(vectors, vectors.where("vec_id = 7").select("embedding"), "uid"), "uid").withColumnRenamed("uid", "id")
    best = archive.fused([(text, archive.FULLTEXT_WEIGHT), (near, archive.VECTOR_WEIGHT)])
    return archive.hits(best.withColumnRenamed("id", "uid"), s, "uid").select("uid", "interview", "speaker", "start_time", F.round("end_time", 3).alias("end_time"), "text", "wrrf")


GROUP_NAMES = ["The", "und", "de la", "of the", "queque"]


@query
def group_members(spark, d):
    return corpus.members(table(spark, d, "documents"), "doc_id", GROUP_NAMES)


@query
def roster_totals(spark, d):
    return corpus.roster_totals(corpus.members(table(spark, d, "documents"), "doc_id", GROUP_NAMES), "doc_id")


@query
def embedding_diagnostic(spark, d):
    rows = table(spark, d, "embeddings").withColumn("recording", F.floor(F.col("vec_id") / 40))
    card = speakers.diagnostic(rows, ["recording"], "vec_id", "embedding", "label")
    return card.withColumns({c: F.coalesce(F.round(c, 5), F.lit(-1.0)) for c in ("mean_norm", "least_norm", "most_norm", "same_distance", "other_distance")})


@query
def vector_parameters(spark, d):
    rows = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    few = F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x.cast("double") * 8) / 8)
    return rows.select("vec_id", sinks.vector_parameter(F.col("text"), few, 4).alias("parameter"))


@query
def manifest_entries(spark, d):
    """Pages as a YAML manifest and read again, with dates parsed."""
    p = table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("2003-0"), F.col("page_id") % 10, F.lit("-30"))).alias("date"))
    lists = p.groupBy(F.col("page_id") % 10).agg(F.concat(F.lit("# made from pages\npages:\n"), F.array_join(F.array_sort(F.collect_list(manifests.entry_text(["page_id", "url", "date"]))), "\n")).alias("value"))
    rows = manifests.entries(lists.select(F.col("(page_id % 10)").alias("file"), "value"), "file")
    return rows.select(F.col("fields")["page_id"].cast("long").alias("page_id"), F.col("section"), F.col("fields")["url"].alias("url"), F.coalesce(manifests.plain_date(F.col("fields")["date"]).cast("string"), F.lit("")).alias("date"))


@query
def decoded_bytes(spark, d):
    cut = F.substring(F.col("text").cast("binary"), 1, (F.col("doc_id") % 40 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", words.decoded(F.concat(cut, F.unhex(F.lit("C328FF61E282")))).alias("text"))
