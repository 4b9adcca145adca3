"""Reads over the archive: interviews, transcripts, statements, captions and search.

Statements are rows (interview, uid, speaker, text, start_time, end_time). Lookups are plain filters,
so they reach the Parquet scan; every sort ends in a unique column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespan.functions.text import cosine_distance, timestamp_ms

# Fixed values of rank fusion.
FULLTEXT_WEIGHT, VECTOR_WEIGHT, RANK_CONSTANT, SOURCE_K, DEFAULT_LIMIT = 1.0, 0.8, 60, 100, 15
BM25_K1, BM25_B = 1.2, 0.75


def interview_lookup(interviews: DataFrame, uid: str | None = None, number: int | None = None) -> DataFrame:
    """The interview with this uid or number; one of them is needed, and one row must match."""
    tests = [F.col(c) == v for c, v in (("uid", uid), ("number", number)) if v is not None]
    if not tests:
        raise ValueError("uid or number is needed")
    found = interviews.where(reduce(Column.__or__, tests))
    if found.limit(2).count() != 1:
        raise LookupError("not exactly one interview")
    return found


def latest_interviews(interviews: DataFrame, n: int = 5) -> DataFrame:
    return interviews.orderBy("date", "number").limit(n)


def transcript(statements: DataFrame, interview: int) -> DataFrame:
    return statements.where(F.col("interview") == interview).orderBy("start_time", "uid")


def statements_with_people(statements: DataFrame, speakers: DataFrame) -> DataFrame:
    """Speakers map to people where known; unmapped speakers stay, with a null person."""
    return statements.join(speakers, ["interview", "speaker"], "left")


def span_at_time(statements: DataFrame, times: DataFrame) -> DataFrame:
    """For each (interview, t) the statement with start <= t <= end that starts last.

    As-of by sort: statements and times are merged per interview. Ends may overlap, so all statements
    that hold t are matched on coarse time buckets, and the latest start wins.
    """
    width = 60.0
    spans = statements.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_time") / width), F.floor(F.greatest("start_time", "end_time") / width))))
    hit = times.withColumn("bucket", F.floor(F.col("t") / width)).join(spans, ["interview", "bucket"]).where("start_time <= t and end_time >= t")
    return hit.groupBy("interview", "t").agg(F.max_by(F.struct("uid", "start_time", "end_time"), F.struct("start_time", "uid")).alias("s")).select("interview", "t", "s.*")


def statement_text(statements: DataFrame, fragment: str, interview: int | None = None) -> DataFrame:
    """Statements with the fragment as given; an empty fragment finds nothing."""
    if not fragment:
        return statements.limit(0)
    found = statements.where(F.contains("text", F.lit(fragment)))
    return (found if interview is None else found.where(F.col("interview") == interview)).orderBy("start_time", "uid")


def captions(statements: DataFrame) -> DataFrame:
    """One WebVTT cue a statement, with its place in the interview; ends are one millisecond early."""
    ms = lambda c: F.floor(F.round(F.col(c) * 1000, 3)).cast("long")
    cue = F.concat("uid", F.lit("\n"), timestamp_ms(ms("start_time")), F.lit(" --> "), timestamp_ms(F.greatest(ms("end_time") - 1, F.lit(0))), F.lit("\n"), "text", F.lit("\n"))
    return statements.select("interview", "start_time", "uid", cue.alias("cue"))


def webvtt(statements: DataFrame, interview: int) -> str:
    rows = captions(statements.where(F.col("interview") == interview)).orderBy("start_time", "uid").select("cue")
    return "WEBVTT\n\n" + "\n".join(r["cue"] for r in rows.toLocalIterator())


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")


def text_scores(documents: DataFrame, query: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """BM25 of the documents that hold any query term.

    The documents are counted once for n and mean length; postings are made for the query terms only.
    """
    wanted = sorted(set(query))
    tokens = documents.select(key, terms_of(F.col(text)).alias("terms")).withColumn("len", F.size("terms"))
    stats = tokens.groupBy(F.lit(1).alias("all")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    posts = tokens.select(key, "len", F.explode(F.filter("terms", lambda t: t.isin(wanted))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = posts.join(F.broadcast(df), "term").withColumn("all", F.lit(1)).join(F.broadcast(stats), "all")  # one row a query term at most, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("mean")))
    return joined.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def vector_scores(embeddings: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return embeddings.select(key, F.round(1 - cosine_distance(F.col(vector), q), 6).alias("score"))


def similar(embeddings: DataFrame, query: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Scores as in `vector_scores`, against the vector of the one row of `query`; more rows are an error, none finds nothing."""
    one = query.limit(2).agg(F.count(F.lit(1)).alias("_n"), F.first(vector).alias("_q")).where("_n > 0")
    q = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one query vector"))).otherwise(F.col("_q"))
    return embeddings.join(F.broadcast(one)).select(key, F.round(1 - cosine_distance(F.col(vector), q), 6).alias("score"))  # one row


def top(scored: DataFrame, key: str, k: int = SOURCE_K) -> DataFrame:
    """Best k, with their ranks from 1: the sort and limit come first, so the window sees k rows."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def fused(sources: list[tuple[DataFrame, float]], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked (id, rank) sources."""
    parts = [s.select("id", (F.lit(w) / (RANK_CONSTANT + F.col("rank"))).alias("part")) for s, w in sources]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("part"), 8).alias("wrrf")).orderBy(F.desc("wrrf"), "id").limit(limit)


def hits(found: DataFrame, statements: DataFrame, key: str) -> DataFrame:
    """Scored keys, cut to a few before, with their statement's interview, speaker, text and times."""
    return statements.join(F.broadcast(found), key)
