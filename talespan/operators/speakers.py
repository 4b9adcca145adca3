"""Speaker diarisation: clustering, scoring and diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.functions.text import cosine_distance

# Fixed values of the frame grid: samples a frame, samples before the first, seconds a window.
FRAME_SAMPLES, FIRST_SAMPLE, WINDOW_SECONDS = 270, 721, 10


def cluster_vectors(vectors: np.ndarray, most: int) -> list[int]:
    """Complete-linkage clusters of cosine distances, merged until `most` are left; numbered as seen."""
    n = len(vectors)
    if n == 0:
        return []
    norm = np.linalg.norm(vectors, axis=1)
    safe = np.where(norm == 0, 1, norm)
    far = np.clip(1 - (vectors / safe[:, None]) @ (vectors / safe[:, None]).T, 0, 2)
    far[norm == 0, :] = far[:, norm == 0] = 1.0
    np.fill_diagonal(far, np.inf)
    label = np.arange(n)
    for _ in range(max(n - max(most, 1), 0)):
        a, b = sorted(divmod(int(far.argmin()), n))
        far[a] = far[:, a] = np.maximum(far[a], far[b])
        far[b], far[:, b], far[a, a] = np.inf, np.inf, np.inf
        label[label == b] = a
    seen: dict[int, int] = {}
    return [seen.setdefault(int(x), len(seen)) for x in label]


def cluster(segments: DataFrame, key: str, order: str, vector: str, most: int = 4) -> DataFrame:
    """A speaker label for each segment of each recording; a recording is one group by nature."""
    kind = segments.schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        labels = cluster_vectors(np.array([np.asarray(v, dtype=np.float64) for v in group[vector]]), most)
        return pd.DataFrame({key: group[key], order: group[order], "speaker": [f"SPEAKER_{x:02d}" for x in labels]})

    schema = T.StructType([kind[key], kind[order]]).add("speaker", "string")
    return segments.select(key, order, vector).groupBy(key).applyInPandas(run, schema)


def pair_distances(segments: DataFrame, key: list[str], order: str, vector: str, speaker: str) -> DataFrame:
    """Cosine distances of all pairs in a recording, and whether the speakers agree."""
    a = segments.select(*key, F.col(order).alias("i"), F.col(vector).alias("u"), F.col(speaker).alias("su"))
    b = segments.select(*key, F.col(order).alias("j"), F.col(vector).alias("v"), F.col(speaker).alias("sv"))
    return a.join(b, key).where("i < j").select(*key, "i", "j", (F.col("su") == F.col("sv")).alias("same"), cosine_distance(F.col("u"), F.col("v")).alias("distance"))


def assignment(gain: np.ndarray) -> list[int]:
    """The column given to each row so that the sum of gains is largest; rows are at most as many as columns.

    Rows enter one after another; each takes the cheapest chain of reassignments, by Dijkstra's
    algorithm on costs that potentials keep non-negative.
    """
    rows, columns = gain.shape
    cost = gain.max(initial=0) - gain
    of_row, of_column = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for new in range(rows):
        reach, before, open_ = np.full(columns, np.inf), np.full(columns, -1), np.ones(columns, bool)
        row, came, far = new, -1, 0.0
        while row >= 0:
            step = far + cost[row] - of_row[row] - of_column
            shorter = open_ & (step < reach)
            reach[shorter], before[shorter] = step[shorter], came
            came = int(np.where(open_, reach, np.inf).argmin())
            open_[came], far, row = False, reach[came], owner[came]
        closed = ~open_
        of_row[owner[closed & (owner >= 0)]] += far - reach[closed & (owner >= 0)]
        of_row[new] += far
        of_column[closed] -= far - reach[closed]
        while came >= 0:
            owner[came] = owner[before[came]] if before[came] >= 0 else new
            came = before[came]
    out = [-1] * rows
    for column, row in enumerate(owner.tolist()):
        if row >= 0:
            out[row] = column
    return out


def diagnostic(segments: DataFrame, key: list[str], order: str, vector: str, speaker: str) -> DataFrame:
    """One row a recording: vectors and their norms, and mean distances of pairs of one speaker and of two."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    norms = segments.groupBy(*key).agg(F.count(F.lit(1)).alias("vectors"), *(f(norm).alias(f"{name}_norm") for name, f in (("mean", F.avg), ("least", F.min), ("most", F.max))))
    pairs = pair_distances(segments, key, order, vector, speaker).groupBy(*key).agg(F.count_if("same").alias("same_pairs"), F.count_if(~F.col("same")).alias("other_pairs"), F.avg(F.when(F.col("same"), F.col("distance"))).alias("same_distance"), F.avg(F.when(~F.col("same"), F.col("distance"))).alias("other_distance"))
    zero = F.lit(0).cast("long")
    return norms.join(pairs, key, "left").withColumns({c: F.coalesce(c, zero) for c in ("same_pairs", "other_pairs")})


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def best_names(labels: pd.Series, names: pd.Series, turns: pd.Series) -> pd.Series:
    """The naming of labels under which most turns are right; of equal ones the first, labels and names in order. Empty if there are
    more labels than names, or none names a turn right."""

    def one(own: list[str], names: list[str], rows: list[dict]) -> dict[str, str]:
        if not own or len(own) > len(names):
            return {}
        gain = np.zeros((len(own), len(names)))
        for r in rows:
            if r["label"] is not None:
                gain[own.index(r["label"]), names.index(r["name"])] = r["n"]
        n, m = gain.shape
        # among equal sums an early name for an early label counts most; with very many of both, ties are left as they come
        early = (m - 1 - np.arange(m)) * float(m) ** (n - 1 - np.arange(n))[:, None] if n * np.log2(m) < 40 else 0.0
        found = assignment(gain * float(m) ** n + early if n * np.log2(m) < 40 else gain)
        return {own[i]: names[j] for i, j in enumerate(found)} if sum(gain[i, j] for i, j in enumerate(found)) else {}

    return pd.Series([one(sorted(x), sorted(y), z) for x, y, z in zip(labels, names, turns, strict=True)])


@F.pandas_udf(T.LongType())
def most_named_right(labels: pd.Series, names: pd.Series, turns: pd.Series) -> pd.Series:
    """Turns named right under the best naming of labels; turns are (label, name, n). More labels than names name none."""

    def one(own: list[str], names: list[str], rows: list[dict]) -> int:
        if not own or len(own) > len(names):
            return 0
        gain = np.zeros((len(own), len(names)))
        for r in rows:
            if r["label"] is not None:
                gain[own.index(r["label"]), names.index(r["name"])] = r["n"]
        return int(sum(gain[i, j] for i, j in enumerate(assignment(gain))))

    return pd.Series([one(sorted(x), sorted(y), z) for x, y, z in zip(labels, names, turns, strict=True)], dtype="int64")
