"""Mixing sources to target weights: a min-cost flow from patterns of membership to the sources' quotas.

A document belongs to one or more sources and has a size. Documents are added up by pattern, the set of
their sources; the network has a node for each pattern and each source. A pattern gives its size once
for each repetition, at a cost that rises with the repetition (`COSTS`, convex, so no document comes a second time while
another that would do comes not at all), to any of its sources; a source takes its target. The cheapest
largest flow says how many words each pattern gives. Patterns and sources that hang together, and no others,
are solved together, in one task for each such component.

Documents of a pattern then come whole: as many full rounds of all of them as the flow has, and of the rest those that a seeded
hash puts first. The hash deals a pattern's documents into buckets of about BUCKET_UNITS; whole buckets are
taken up to the one in which the quota ends, where documents are taken in order of the hash if they still
fit, and one more if that comes nearer. Equal rows are one unit with a count, however many there are.

Targets: sources in order of code points, null last, have the weights over and over; by weight they share the
total of all sizes, none takes more than `most` times its own size, and what is above goes to the others by weight
until none is above.

Defined results: null texts have no words, null is a source of its own, an empty set of sources gives
nothing, sources without words have the target 0, ties of the hash go to the smaller doc_id. The same rows give the
same result in any order and partitioning. No documents give no rows. A component of more than MAX_EDGES pairs of pattern
and source raises an error, since it is solved in one task.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talespan.llm.components import components
from talespan.runtime import materialize, ship

WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20
#: Cost of a word at its first, second and third repetition; as many as a document may come.
COSTS = (1, 4, 9)
BUCKET_UNITS = 1024
#: Copies of one row that one task writes.
CHUNK_COPIES = 1 << 16
#: Pairs of pattern and source that one task solves.
MAX_EDGES = 100_000
#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Rows with their place in the order of the keys, from 0; only the partitions' counts reach the driver."""
    place = F.monotonically_increasing_id()
    ranged = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("__at", place)
    counts = sorted(tuple(r) for r in ranged.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, seen = [], 0
    for part, n in counts:
        before.append((part, seen))
        seen += n
    offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    joined = ranged.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(offsets), "__part")
    return materialize(joined.withColumn(name, F.col("__before") + inside).drop("__at", "__part", "__before"))


def _beside(rows: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join to a materialised table: broadcast where it is counted to be small; else Spark splits hot keys of the shuffle."""
    return rows.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other, on, how)


def targets(sources: DataFrame, total: int, weights: tuple[float, ...] = WEIGHTS, most: int = len(COSTS)) -> DataFrame:
    """`sources` (source, source_size) with `at`, its place in the order, and `target`."""
    placed = _numbered(sources, [F.col("source").asc_nulls_last()], "at")
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    level, above = 0.0, -1
    while True:  # each round some more sources stop at their limit
        over = F.col("weight") * level > F.col("source_size") * most
        w, full, n = weighed.agg(F.sum(F.when(~over, F.col("weight"))), F.coalesce(F.sum(F.when(over, F.col("source_size") * most)), F.lit(0)), F.count_if(over)).first()
        if n == above or not w:
            break
        level, above = (total - full) / w, n
    return materialize(weighed.withColumn("target", F.least(F.col("weight") * level, (F.col("source_size") * most).cast("double"))).drop("weight"))


def cheapest_flow(patterns: dict[int, int], quotas: dict[int, int], edges: list[tuple[int, int]], costs: tuple[int, ...] = COSTS) -> dict[tuple[int, int], int]:
    """Words from each pattern to each source: a largest flow, and among these one of least cost.

    Augments along shortest paths with node potentials; ties go to the smaller nodes, so that reruns agree.
    """
    nodes = ["start", *(("p", p) for p in sorted(patterns)), *(("s", s) for s in sorted(quotas)), "end"]
    index = {x: i for i, x in enumerate(nodes)}
    head: list[list[int]] = [[] for _ in nodes]
    to, room, cost = [], [], []

    def link(a: int, b: int, cap: int, price: int) -> None:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    for p in sorted(patterns):
        for price in costs:
            link(0, index["p", p], patterns[p], price)
    pairs = {}
    for p, s in sorted(set(edges)):
        pairs[p, s] = len(to)
        link(index["p", p], index["s", s], len(costs) * patterns[p], 0)
    for s in sorted(quotas):
        link(index["s", s], len(nodes) - 1, quotas[s], 0)
    potential = [0] * len(nodes)
    while True:
        far: list[float] = [float("inf")] * len(nodes)
        came = [-1] * len(nodes)
        far[0] = 0
        queue: list[tuple[float, int]] = [(0, 0)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in head[x]:
                y = to[e]
                if room[e] and (longer := d + cost[e] + potential[x] - potential[y]) < far[y]:
                    far[y], came[y] = longer, e
                    heapq.heappush(queue, (longer, y))
        if came[-1] < 0:
            break
        reach = max(d for d in far if d < float("inf"))
        potential = [int(p + min(d, reach)) for p, d in zip(potential, far, strict=True)]
        path, x = [], len(nodes) - 1
        while x:
            path.append(came[x])
            x = to[came[x] ^ 1]
        n = min(room[e] for e in path)
        for e in path:
            room[e] -= n
            room[e ^ 1] += n
    return {pair: room[e ^ 1] for pair, e in pairs.items()}


def _solved(edges: DataFrame) -> DataFrame:
    """pattern, at and flow of `edges` (pattern, size, at, quota), each component in a task of its own."""
    linked = components(edges.select((F.col("pattern") * 2 + 1).alias("a"), (F.col("at") * 2).alias("b")))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > MAX_EDGES:
            raise ValueError(f"a component has {len(group)} pairs of pattern and source; {MAX_EDGES} are the limit")
        pairs = list(zip(group["pattern"].tolist(), group["at"].tolist(), strict=True))
        flow = cheapest_flow(dict(zip(group["pattern"].tolist(), group["size"].tolist(), strict=True)), dict(zip(group["at"].tolist(), group["quota"].tolist(), strict=True)), pairs)
        return pd.DataFrame([(p, s, n) for (p, s), n in flow.items()], columns=["pattern", "at", "flow"])

    net = edges.join(linked, F.col("pattern") * 2 + 1 == F.col("id")).select("component", "pattern", "size", "at", "quota")
    return materialize(net.groupBy("component").applyInPandas(solve, "pattern long, at long, flow long"))


def _partial(group: pd.DataFrame) -> pd.DataFrame:
    """How many copies of each unit of the bucket in which a pattern's rest ends are taken."""
    rows = group.sort_values(["order", "doc_id", "size"], na_position="first", kind="stable")
    left = int(rows["left"].iloc[0])
    sizes, counts, taken = rows["size"].tolist(), rows["n"].tolist(), []
    for size, n in zip(sizes, counts, strict=True):
        m = min(n, left // size) if size else 0
        left -= m * size
        taken.append(m)
    spare = [i for i, (size, n) in enumerate(zip(sizes, counts, strict=True)) if size and taken[i] < n]
    if spare and 2 * left >= sizes[least := min(spare, key=lambda i: sizes[i])]:
        taken[least] += 1
    return rows.assign(more=taken)[["unit", "more"]]


def mixed(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From `documents` (doc_id, members: array of sources, size): a row for each with doc_id, members, size and
    taken, and a table of the sources: source, source_size, target and flow, the words that the flow gives it."""
    ship(documents.sparkSession)
    members = F.array_sort(F.array_distinct(F.coalesce("members", F.array(F.lit(None).cast("string")))))
    units = documents.select(F.col("doc_id").cast("long").alias("doc_id"), members.alias("members"), F.col("size").cast("long").alias("size"))
    units = materialize(units.groupBy("doc_id", "members", "size").agg(F.count(F.lit(1)).alias("n")))
    all_words = F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))
    total = units.agg(all_words).first()[0]
    patterns = _numbered(units.groupBy("members").agg(all_words.alias("pattern_size"), F.count(F.lit(1)).alias("units")), [F.col("members")], "pattern")
    pairs = patterns.select("pattern", F.col("pattern_size").alias("size"), F.explode("members").alias("source"))
    sources = targets(pairs.groupBy("source").agg(F.sum("size").alias("source_size")), total, weights)
    quotas = sources.select(F.col("source").alias("_source"), "at", F.floor(F.col("target") + 0.5).alias("quota"))
    flow = _solved(pairs.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).select("pattern", "size", "at", "quota"))
    given = patterns.join(flow.groupBy("pattern").agg(F.sum("flow").alias("flow")), "pattern", "left").withColumn("flow", F.coalesce("flow", F.lit(0)))
    rounds = F.expr("if(pattern_size > 0, flow div pattern_size, 0L)")
    given = materialize(given.select("members", "pattern", rounds.alias("rounds"), (F.col("flow") - rounds * F.col("pattern_size")).alias("rest"), F.ceil(F.col("units") / BUCKET_UNITS).alias("buckets")))
    order = F.xxhash64(F.lit(seed), "doc_id", "size", "members")
    dealt = materialize(_beside(units, given, "members").withColumn("order", order).withColumn("bucket", F.expr("pmod(order, buckets)")).drop("buckets").withColumn("unit", F.monotonically_increasing_id()))
    sums = dealt.where("rest > 0").groupBy("pattern", "bucket", "rest").agg(F.sum(F.col("n") * F.col("size")).alias("here"))
    upto = F.expr("sum(here) over (partition by pattern order by bucket rows unbounded preceding)")
    edge = materialize(sums.withColumn("upto", upto).where("upto > rest and upto - here <= rest").select("pattern", F.col("bucket").alias("edge"), (F.col("rest") - F.col("upto") + F.col("here")).alias("left")))
    dealt = _beside(dealt, edge, "pattern", "left")
    last = dealt.where("bucket = edge").select("pattern", "unit", "doc_id", "order", "size", "n", "left").groupBy("pattern").applyInPandas(_partial, "unit long, more long")
    dealt = dealt.join(last, "unit", "left").withColumn("more", F.expr("coalesce(more, if(rest > 0 and bucket < edge, n, 0L))"))
    return _copies(dealt), sources.join(flow.groupBy("at").agg(F.sum("flow").alias("flow")), "at", "left").select("source", "source_size", "target", F.coalesce("flow", F.lit(0)).alias("flow"))


def _copies(units: DataFrame) -> DataFrame:
    """Every row again: `more` copies of a unit come once more than the others. Many copies are spread over tasks."""
    taken = (F.col("rounds") * F.col("size") + F.when(F.col("copy") < F.col("more"), F.col("size")).otherwise(F.lit(0))).alias("taken")
    some, many = materialize(units.select("doc_id", "members", "size", "rounds", "more", "n")), f"n > {CHUNK_COPIES}"
    few = some.where(f"not {many}").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    parts = some.where(many).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK_COPIES).cast("long"))).alias("chunk")).repartition("doc_id", "members", "size", "chunk")
    spread = parts.select("*", F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + CHUNK_COPIES, F.col("n")) - 1)).alias("copy")).drop("chunk")
    return few.unionByName(spread).select("doc_id", "members", "size", taken)


def by_source(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words, source_size, target and taken of every document of a table with a text and a source."""
    source = F.col("source").cast("string")
    rows, sources = mixed(documents.select("doc_id", F.array(source).alias("members"), words(F.col("text")).alias("size")), weights, seed)
    sources = materialize(sources.select(F.array("source").alias("members"), "source", "source_size", "target"))
    return _beside(rows, sources, "members").select("doc_id", "source", "size", "source_size", "target", "taken")
