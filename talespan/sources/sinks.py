"""Writers: ingest of segments, replacement by interview, upserts, property updates, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespan.functions.text import camel_name, stable_uid
from talespan.sources.files import segments

UNKNOWN_SPEAKER = "SPEAKER_??"


def statements(seeds: DataFrame) -> DataFrame:
    """One statement a segment of (number, segments JSON), with ids that reruns give again."""
    rows = seeds.select(F.col("number").alias("interview"), F.posexplode(segments(F.col("segments"))).alias("pos", "s"))
    uid = stable_uid(F.col("interview").cast("string"), F.col("pos").cast("string"), F.col("s.text"))
    return rows.select("interview", "pos", uid.alias("uid"), F.coalesce("s.speaker", F.lit(UNKNOWN_SPEAKER)).alias("speaker"), "s.text", "s.start_time", "s.end_time", F.to_json("s.words").alias("words"))


def replace_interviews(rows: DataFrame, path: str) -> None:
    """Rewrite the partitions of the interviews that the rows name, and no others.

    A second run leaves the same rows; interviews without an asset are replaced like all others.
    """
    rows.write.partitionBy("interview").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win over current ones with the same key."""
    fresh = new.dropDuplicates(keys)
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def with_vectors(rows: DataFrame, vectors: DataFrame, key: str = "uid") -> DataFrame:
    """Fill embeddings in; a second run changes nothing."""
    new = vectors.select(key, F.col("embedding").alias("_new"))
    return rows.join(new, key, "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def assets(seeds: DataFrame) -> DataFrame:
    """An asset only where the input names one."""
    return seeds.where(F.col("vimeo_id").isNotNull()).select(F.col("number").alias("interview"), F.lit("vimeo").alias("kind"), "vimeo_id")


def not_written(results: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """Results whose output doesn't exist yet."""
    return results.join(done.select(key).distinct(), key, "left_anti")


def parameter(text: Column) -> Column:
    """A text as a named parameter."""
    return F.format_string(":param %s => %s", camel_name(text), F.to_json(F.struct(text.alias("text"))))


def vector_parameter(text: Column, vector: Column, dimensions: int = 1024) -> Column:
    """A text's vector as a named parameter statement; null for a null vector."""
    numbers = F.array_join(F.transform(vector, lambda x: x.cast("double").cast("string")), ", ")
    return F.when(vector.isNotNull(), F.concat(F.lit(":param "), camel_name(text), F.lit("Embedding => vector(["), numbers, F.lit(f"], {dimensions}, FLOAT64);")))


def edges(statements: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge rows of ingested statements: what each interview contains, with its times, and who says it.

    Speakers that map to no person keep their label, with a null person.
    """
    contains = statements.select("interview", F.col("uid").alias("statement_uid"), "start_time", "end_time")
    says = statements.join(people, ["interview", "speaker"], "left").select("interview", F.col("uid").alias("statement_uid"), F.col("speaker").alias("speaker_label"), "person_uid")
    return contains, says
