"""Paths over edge tables: hops that go on to the next node, and hops that only ask whether there is one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hop:
    """A step from nodes to nodes over `edges`.

    source and target are columns of the edges, at is the column of the rows so far from which the step starts, name the
    column that the nodes it reaches are called. keep: edge columns that come along. only_filter: rows stay as they
    are if there is such an edge, once each, however many there are.
    """

    edges: DataFrame
    source: str
    target: str
    at: str
    name: str = ""
    keep: tuple[str, ...] = field(default=())
    only_filter: bool = False


def paths(start: DataFrame, hops: list[Hop]) -> DataFrame:
    """Rows of `start` along all hops, one for each path: repeated edges and rows count each. Null nodes meet nothing.

    Only the columns that a hop names are read of its edges.
    """
    rows = start
    for hop in hops:
        edges = hop.edges.where(F.col(hop.source).isNotNull() & F.col(hop.target).isNotNull())
        if hop.only_filter:
            rows = rows.join(edges.select(F.col(hop.source).alias("__from")), F.col(hop.at) == F.col("__from"), "left_semi")
        else:
            step = edges.select(F.col(hop.source).alias("__from"), F.col(hop.target).alias(hop.name), *hop.keep)
            rows = rows.join(step, F.col(hop.at) == F.col("__from")).drop("__from")
    return rows


def zipped(texts: DataFrame, vectors: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Texts (key, order, …) and vectors (key, order, vector) of requests, matched by their place in each request.

    Orders need not agree, only how many there are: a request with more of one than of the other is an error, and
    nothing of it may be written, since the error fails the whole job. The numbers are compared before any row is matched.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    sizes = texts.groupBy(key).agg(F.count(F.lit(1)).alias("_texts")).join(vectors.groupBy(key).agg(F.count(F.lit(1)).alias("_vectors")), key, "full")
    odd = F.coalesce("_texts", F.lit(0)) != F.coalesce("_vectors", F.lit(0))
    said = F.concat(F.lit("request "), F.col(key).cast("string"), F.lit(" has "), F.coalesce("_texts", F.lit(0)).cast("string"), F.lit(" texts and "), F.coalesce("_vectors", F.lit(0)).cast("string"), F.lit(" vectors"))
    checked = sizes.select(key, F.when(odd, F.raise_error(said).cast("long")).otherwise(F.col("_texts")).alias("_n"))
    left, right = texts.withColumn("_place", place), vectors.select(key, place.alias("_place"), "vector")
    return left.join(right, [key, "_place"], "full").join(checked, key, "full").where("_n > 0").drop("_place", "_n")
