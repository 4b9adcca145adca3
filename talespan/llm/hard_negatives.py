"""Hard negatives from embeddings, by an exact inverted multi-index.

Vectors are split in halves; each half has a codebook of centroids, and a pair of centroids is a cell.
The inner product with a query is at most, half by half, that with the centroid plus the query's length times
the radius of the cell's members, and the two bounds add up. So a query sorts both halves' bounds and a heap yields the cells
in order of the sum (multi-sequence); when the next cell's bound is below all that is still wanted, the answer is certified.
Nothing is approximate: codebooks come from a bounded sample and only decide how early a search stops.

The index is dealt in shards of bounded size, runs of neighbouring cells; a cell that is larger than a shard is split. A
query asks the shard with its best bound first; what it finds there says which others can still matter, and it
asks only those. Shards and queries meet by a shuffle on the shard, rows before queries, so a task holds
one shard and streams the queries through it. First the positives are searched, then the windows below
each of them.

Rows without a label or vector, or with any null or non-finite component, take no part. Every
seventh vec_id has its label moved on by one (mod 10). Components become floor(256 * x), limited to 2^26
either way; scores are integer inner products; shorter vectors count as filled up with zeros.

Defined results: a null vec_id is no anchor and no multiple of seven, and comes before all others in ties. Rows with equal
vec_id are separate rows: one may be the positive of another. Positives with a negative score have no window, since 80 % of it is
above it. A label that no other row has gives an anchor without positives, so no rows. No rows give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.llm.words import FIRST_ID
from talespan.runtime import materialize, ship

ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is between this share, in per cent, of the positive's and the positive's.
FLOOR = 80
SCALE = 256
LIMIT = 1 << 26
#: The codebooks are fitted on rows with so many components together, those with the least hashes.
SAMPLE_VALUES = 1 << 21
#: Centroids of a half at most; below that, cells have about this many rows.
CODES, CELL_ROWS = 256, 64
FITTING = 8
#: Rows of a shard, and components at most; a small table has SHARDS shards or smaller ones of LEAST_ROWS.
SHARD_ROWS, SHARD_VALUES, SHARDS, LEAST_ROWS = 1 << 16, 1 << 23, 64, 4096
#: Rows of the visited cells that are scored together.
SCORED = 1024
_EXACT = 1 << 53

_WINDOW = T.ArrayType(T.StructType().add("top", "long").add("need", "long"))
_CODED = T.StructType().add("id", "long").add("label", "integer").add("cell", "integer").add("vector", "binary").add("far1", "double").add("far2", "double")
_MET = T.StructType().add("shard", "integer").add("kind", "integer").add("row", "long").add("id", "long").add("label", "integer").add("cell", "integer").add("vector", "binary").add("windows", _WINDOW)
_FOUND = T.StructType().add("anchor", "long").add("top", "long").add("score", "long").add("id", "long")


def scaled(embeddings: DataFrame) -> DataFrame:
    """id, label and vector (array of long) of the rows that take part."""
    id_ = F.col("vec_id").cast("long")
    label = F.when(id_ % 7 == 0, (F.col("label").cast("int") + 1) % 10).otherwise(F.col("label").cast("int"))
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.coalesce(id_, F.lit(FIRST_ID)).alias("id"), label.alias("label"), whole.alias("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if len(flat) == len(size) * dim and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _nearest(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not points.shape[1]:
        return np.zeros(len(points), dtype=np.int64)
    return np.argmin((codes**2).sum(1) - 2 * points @ codes.T, axis=1)


def codebook(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the points, by Lloyd's rounds from evenly spaced ones."""
    codes = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(np.int64)].copy()
    for _ in range(FITTING):
        of = _nearest(points, codes)
        n = np.bincount(of, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, of, points)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


class Index:
    """Codebooks, and the cells' radii and shards; of bounded size, whatever the table."""

    def __init__(self, dim: int, codes: tuple[np.ndarray, np.ndarray]):
        self.dim, self.half, self.codes = dim, dim // 2, codes

    def lay(self, cells: list[tuple[int, int, float, float]], rows: int) -> None:
        """Deal (cell, rows, radii) to shards; `first` and `pieces` of a cell are its first shard and how many it is split over."""
        cells = sorted(cells)
        most = max(1, min(SHARD_ROWS, SHARD_VALUES // max(self.dim, 1), max(LEAST_ROWS, rows // SHARDS)))
        self.cell = np.array([c[0] for c in cells], dtype=np.int64)
        self.radii = np.array([c[2:] for c in cells], dtype=np.float64).reshape(-1, 2)
        self.first, self.pieces = np.zeros(len(cells), dtype=np.int64), np.ones(len(cells), dtype=np.int64)
        shard, held, slots = 0, 0, []
        for i, (_, n, *_) in enumerate(cells):
            if held and held + n > most:
                shard, held = shard + 1, 0
            self.first[i], self.pieces[i] = shard, -(-n // most)
            slots += [(s, i) for s in range(shard, shard + int(self.pieces[i]))]
            shard, held = shard + int(self.pieces[i]) - 1, held + n
        self.shards = shard + 1
        self.slot_cell = np.array([i for _, i in slots], dtype=np.int64)
        self.slot_first = np.searchsorted([s for s, _ in slots], np.arange(self.shards))

    def halves(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each half: inner products with the centroids, and lengths."""
        return [(q @ codes.T, np.sqrt((q**2).sum(-1, keepdims=True))) for q, codes in zip((queries[..., : self.half], queries[..., self.half :]), self.codes, strict=True)]

    def shard_bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that a row of each shard can score with each query."""
        k = len(self.codes[1])
        (a, la), (b, lb) = self.halves(queries)
        bound = a[:, self.cell // k] + la * self.radii[:, 0] + b[:, self.cell % k] + lb * self.radii[:, 1]
        return np.maximum.reduceat(bound[:, self.slot_cell], self.slot_first, axis=1) + slack(queries)[:, None]


def slack(query: np.ndarray) -> np.ndarray:
    """More than bounds lose by rounding."""
    return 0.01 + 1e-9 * np.abs(query).sum(-1) * np.abs(query).max(-1, initial=1.0)


class Shard:
    """Rows of a shard in order of their cells."""

    def __init__(self, index: Index, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, vectors: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.rows, self.ids, self.labels, self.vectors = rows[order], ids[order], labels[order], vectors[order]
        self.largest = float(np.abs(vectors).max(initial=0.0))
        own, first = np.unique(cells[order], return_index=True)
        stop = np.append(first[1:], len(order))
        k, place = len(index.codes[1]), np.searchsorted(index.cell, own)
        self.index, self.parts = index, (own // k, own % k)
        self.at = dict(zip(zip(*(p.tolist() for p in self.parts), strict=True), zip(first.tolist(), stop.tolist(), strict=True), strict=True))
        self.halves = []
        for half, part in enumerate(self.parts):
            codes, at = np.unique(part, return_inverse=True)
            radius = np.zeros(len(codes))
            np.maximum.at(radius, at, index.radii[place, half])
            self.halves.append((codes, radius))

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Bound, first and last row of the cells, by falling bound: a heap over two sorted lists of half bounds."""
        sides = []
        for (inner, length), (codes, radius) in zip(self.index.halves(query), self.halves, strict=True):
            bound = inner[codes] + length[0] * radius
            order = np.argsort(-bound, kind="stable")
            sides.append((bound[order].tolist(), codes[order].tolist()))
        (u, left), (v, right) = sides
        more = float(slack(query))
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            if (left[i], right[j]) in self.at:
                yield (more - bound, *self.at[left[i], right[j]])

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(query).max(initial=0.0)) * max(len(query), 1) < _EXACT:
            return (self.vectors[at] @ query).astype(np.int64)
        return self.vectors[at].astype(np.int64) @ query.astype(np.int64)

    def search(self, row: int, label: int, query: np.ndarray, windows: list[tuple[int | None, int | None]], k: tuple[int, int] = (POSITIVES, NEGATIVES)) -> list[tuple[int | None, int, int]]:
        """(top, score, id) of what each window wants most: without a top, rows of the label; else rows of others with
        scores from FLOOR per cent of the top up to it. `need`: a score below which nothing is wanted any more."""
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        need = [-(2**62) if n is None else n for _, n in windows]
        need = [n if top is None else max(n, -(-FLOOR * top // 100)) for n, (top, _) in zip(need, windows, strict=True)]

        def score(spans: list[tuple[int, int]]) -> None:
            at = np.concatenate([np.arange(a, b) for a, b in spans])
            got = self.scores(query, at)
            same = self.labels[at] == label
            for w, (top, _) in enumerate(windows):
                wanted = (same & (self.rows[at] != row) if top is None else ~same & (got <= top)) & (got >= need[w])
                if wanted.any():
                    s, ids = np.concatenate((kept[w][0], got[wanted])), np.concatenate((kept[w][1], self.ids[at[wanted]]))
                    best = np.lexsort((ids, -s))[: k[top is not None]]
                    kept[w] = s[best], ids[best]
                    if len(best) == k[top is not None]:
                        need[w] = max(need[w], int(s[best[-1]]))

        spans: list[tuple[int, int]] = []
        held = 0
        for bound, a, b in self.cells(query):
            if bound < min(need):
                break
            spans.append((a, b))
            held += b - a
            if held >= SCORED:
                score(spans)
                spans, held = [], 0
        if spans:
            score(spans)
        return [(top, *pair) for (top, _), (s, ids) in zip(windows, kept, strict=True) for pair in zip(s.tolist(), ids.tolist(), strict=True)]


def _vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4").astype(np.float64)


def build(rows: DataFrame) -> tuple[DataFrame, Index] | None:
    """Coded rows (those of `_CODED` and row, a number of its own for each), materialised, and the index; None without rows."""
    spark = rows.sparkSession
    count, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not count:
        return None
    sample = rows.select("vector", F.xxhash64("id", "vector").alias("hash")).orderBy("hash").limit(max(1, min(count, SAMPLE_VALUES // max(dim, 1)))).select("vector").toArrow().column(0).combine_chunks()
    points = _matrix(sample, dim)
    k = min(CODES, max(1, round((count / CELL_ROWS) ** 0.5)))
    index = Index(dim, (codebook(points[:, : dim // 2], k), codebook(points[:, dim // 2 :], k)))
    shared = spark.sparkContext.broadcast(index)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            vectors = _matrix(batch.column(2), index.dim)
            of, far = [], []
            for points, codes in zip((vectors[:, : index.half], vectors[:, index.half :]), index.codes, strict=True):
                of.append(_nearest(points, codes))
                far.append(np.sqrt(((points - codes[of[-1]]) ** 2).sum(1)))
            cell = of[0] * len(index.codes[1]) + of[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary()), *map(pa.array, far)], _CODED.names)

    coded = materialize(rows.mapInArrow(code, _CODED).withColumn("row", F.monotonically_increasing_id()))
    cells = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect()
    index.lay([tuple(c) for c in cells], count)
    return coded, index


class Search:
    """An index whose shards are dealt to tasks, and searches of many queries in it."""

    def __init__(self, coded: DataFrame, index: Index):
        spark = coded.sparkSession
        self.index, self.shared = index, spark.sparkContext.broadcast(index)
        shared = self.shared
        place = spark.createDataFrame(list(zip(index.cell.tolist(), index.first.tolist(), index.pieces.tolist(), strict=True)), "cell int, first int, pieces int")
        shard = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("int")
        # cells are CODES^2 at most
        self.rows = coded.join(F.broadcast(place), "cell").select(shard.alias("shard"), F.lit(0).alias("kind"), "row", "id", "label", "cell", "vector", F.lit(None).cast(_WINDOW).alias("windows"))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, shard = -1, [], None
            for batch in batches:
                out = []
                of, kind = (batch.column(i).to_numpy() for i in range(2))
                edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(of)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if of[a] != now:
                        now, held, shard = int(of[a]), [], None
                    part = batch.slice(a, b - a)
                    if not kind[a]:
                        vectors = np.frombuffer(b"".join(part.column(6).to_pylist()), "<i4").reshape(b - a, -1)
                        held.append((*(part.column(i).to_numpy() for i in range(2, 6)), vectors))
                        continue
                    if shard is None and held:
                        *columns, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                        shard, held = Shard(shared.value, *columns, vectors.astype(np.float64)), []
                    if shard is not None:  # a piece of a split cell may be empty
                        for r in part.select(["row", "label", "vector", "windows"]).to_pylist():
                            out += [(r["row"], *x) for x in shard.search(r["row"], r["label"], _vector(r["vector"]), [(w["top"], w["need"]) for w in r["windows"]])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], _FOUND.names)

        self.meet = meet

    def _ask(self, queries: DataFrame, home: bool) -> DataFrame:
        """What the best shard of each query has, or all others that can have what it needs."""
        shared = self.shared

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    bounds = shared.value.shard_bounds(np.stack([_vector(v) for v in part.column(3).to_pylist()]))
                    best = np.argmax(bounds, axis=1)
                    if home:
                        query, shard = np.arange(len(best)), best
                    else:
                        need = np.array([min((-(2**62) if w["need"] is None else w["need"] for w in ws), default=2**62) for ws in part.column(4).to_pylist()], dtype=np.float64)
                        bounds[np.arange(len(best)), best] = -np.inf
                        query, shard = np.nonzero(bounds >= need[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *(part.column(i).take(pa.array(query)) for i in range(5))], ["shard", "row", "id", "label", "vector", "windows"])

        schema = T.StructType([f for f in _MET.fields if f.name not in ("kind", "cell")])
        asked = queries.select("row", "id", "label", "vector", "windows").mapInArrow(route, schema).select("shard", F.lit(1).alias("kind"), "row", "id", "label", F.lit(0).alias("cell"), "vector", "windows")
        met = self.rows.unionByName(asked).repartitionById(self.index.shards, F.col("shard")).sortWithinPartitions("shard", "kind")
        return met.mapInArrow(self.meet, _FOUND)

    def best(self, queries: DataFrame, k: int) -> DataFrame:
        """The first k rows (anchor, top, score, id, rank) of each window of the queries (row, id, label, vector, windows), materialised."""
        rank = F.row_number().over(_by("anchor", "top"))
        near = materialize(self._ask(queries, True))
        if self.index.shards == 1:  # there is no other one to ask
            return materialize(near.withColumn("rank", rank))
        full = near.groupBy("anchor", "top").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("found"))
        window = queries.select("row", F.explode("windows").alias("w")).select("row", "w.top", "w.need")
        known = window.join(full, (window["row"] == full["anchor"]) & window["top"].eqNullSafe(full["top"]), "left")
        windows = known.select(window["row"], F.struct(window["top"], F.greatest("need", "found").alias("need")).alias("w")).groupBy("row").agg(F.collect_list("w").alias("windows"))
        far = self._ask(queries.drop("windows").join(windows, "row"), False)
        return materialize(near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k))


def _by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")


def mined(embeddings: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor and positive."""
    spark = embeddings.sparkSession
    ship(spark)
    built = build(scaled(embeddings))
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if built is None:
        return spark.createDataFrame([], names)
    coded, index = built
    search = Search(coded, index)
    anchors = materialize(coded.where((F.col("id") != FIRST_ID) & (F.col("id") % every == 0)).select("row", "id", "label", "vector"))
    window = lambda top, need: F.array(F.struct(top.cast("long").alias("top"), need.cast("long").alias("need")))
    positives = search.best(anchors.withColumn("windows", window(F.lit(None), F.lit(None))), POSITIVES)
    floor = F.expr(f"(score * {FLOOR} + 99) div 100")
    tops = positives.where("score >= 0").select("anchor", F.struct(F.col("score").alias("top"), floor.alias("need")).alias("w")).groupBy("anchor").agg(F.collect_set("w").alias("windows"))
    negatives = search.best(anchors.join(tops, anchors["row"] == tops["anchor"]).drop("anchor"), NEGATIVES)
    pairs = positives.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select(F.col("anchor").alias("_anchor"), F.col("top"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    rows = pairs.join(found, (F.col("anchor") == F.col("_anchor")) & (F.col("positive_score") == F.col("top"))).join(anchors.select(F.col("row"), F.col("id").alias("anchor_id")), F.col("anchor") == F.col("row"))
    known: list[Column] = [F.when(F.col(c) != FIRST_ID, F.col(c)).alias(c) for c in ("positive_id", "negative_id")]
    return rows.select("anchor_id", known[0], F.col("rank").cast("int").alias("rank"), known[1], "positive_score", "negative_score")
