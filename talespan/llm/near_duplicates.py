"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles. Two sets of sizes a <= b link when their
Jaccard similarity reaches the threshold; their symmetric difference then has at most
(1 - t) / (1 + t) * (a + b) members. Sizes are cut into bands; a set meets the band of its own size
and the next one. A band cuts the shingle domain into first-level partitions, and each of them into
second-level ones. A signature is the content of a subset of the second-level partitions of one
first-level partition; all subsets of one size are enumerated. D differing members change the
most signatures when they are spread evenly over the first-level partitions. So among any one more than that, taken in an order that both sets share, one is equal. The order puts subsets
with rare shingles first, those of passages that HOT_DOCS documents share next, and empty ones last.
How many documents share a shingle is counted over all of them. The limit is a number and no share of the table: passages
of a share would connect ever more documents to one family as the table grows.

Signatures travel packed: a batch sends each block of the signature space one row. A block joins all
documents with an equal signature to the least one of its groups, and sends each document's row to
the document's bucket, where equal rows of different blocks become one. What these rows connect is a
family: every pair that shares a signature lies in one. Members of families that are too large for
one task sign again with more shingles a signature, which takes most such families apart. The exact sets of a family's different
texts meet in one task, or, for a large family, each pair of its parts does. There a document is
compared to all others at once, first one that joins most of them, then each that is outside the
largest class; so a pair is left out only if both are known to be in one class. Tasks give back
one row a document, not the pairs.

Defined results: null text and text without words have no shingles and link with nothing. A text
with fewer than `shingle` words is one shingle. Rows with equal doc_id are one node; each gives its own row. A null
doc_id is a node before all others, given back as null. Other columns pass through `one_of_each()`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.llm import planes
from talespan.llm.components import components
from talespan.llm.words import CHUNK_BYTES, FIRST_ID, PLACE, Words, batched, byte_table, mix, texts_of
from talespan.runtime import materialize, release, ship

SHINGLE = 5
#: The threshold 75/100 as a fraction.
LIKE, OF = 3, 4
BATCH_BYTES = 6 << 20
#: Second-level partitions of a first-level one, how many of them may differ in linked sets, and a factor (as a fraction)
#: for the number of first-level ones, which leaves the order something to choose from.
COARSE = (4, 2, 11, 10)
#: Signatures with more shingles, for families that COARSE leaves too large for one task.
FINE = (6, 3, 1, 1)
#: Bits of a signature; more would travel for nothing, since equal signatures are only candidates.
SIGNATURE_BITS = 48
#: Members of sets, over all documents of a family, that one part of it holds; a task sees two parts at most.
PART_MEMBERS = 1 << 18
#: Rows (32 bytes each) up to which a counted table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Texts with this share of all rows, at most 1000 of them, are joined apart from the others.
HOT_COPIES = 1 / 1000
#: A shingle in so many documents is put late in the order; changes speed only.
HOT_DOCS = 32
#: Hot shingles that are broadcast, 8 bytes each; of more, those in the most documents are.
HOT_MOST = 1 << 22
#: Bits of a shingle by which documents are counted, and bytes of text that are counted together.
HOT_BITS = 40
COUNT_BYTES = 24 << 20
#: Seconds between two collections of the driver's garbage, of which the second finds the last step's files.
RELEASE_S = 2

_ROW = T.StructType().add("block", "integer").add("data", "binary")
_FOUND = T.StructType().add("kind", "byte").add("a", "long").add("b", "long").add("n", "long")


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The ascending shingle hashes of each text."""
    out, table = [], byte_table("space-lower")
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            words = Words(texts[at : i + 1], table)
            hashes, _ = words.shingles(k)
            first = words.first.tolist()
            for a, b in zip(first, first[1:], strict=False):
                if b - a >= k:
                    out.append(np.unique(hashes[a : b - k + 1]))
                elif b > a:
                    part = words.hashes[a:b] * PLACE[: b - a]
                    out.append(mix(part.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
                else:
                    out.append(np.empty(0, np.uint64))
            at, size = i + 1, 0
    return out


def bands(largest: int) -> np.ndarray:
    """The greatest size of each band, up to one that holds `largest`; a partner of a set lies in its band or the next."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, out[-1] * OF // LIKE))
    return np.array(out, dtype=np.int64)


def _lost(partitions: int, differ: int, first: np.ndarray, differences: np.ndarray) -> np.ndarray:
    """Signatures that so many differing members change at most: spread evenly over the first-level partitions they change most."""
    whole = math.comb(partitions, differ)
    at = np.array([whole - (math.comb(partitions - d, partitions - differ) if d <= differ else 0) for d in range(differ + 3)])
    each, more = np.divmod(differences, first)
    return (first - more) * at[each] + more * at[each + 1]


def signatures(sets: list[np.ndarray], hot: np.ndarray, scheme: tuple[int, int, int, int] = COARSE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ascending sets that are not empty, and the set that each belongs to."""
    partitions, differ, extra, of_extra = scheme
    subsets = list(itertools.combinations(range(partitions), partitions - differ))
    size = np.array([len(s) for s in sets], dtype=np.int64)
    own = np.concatenate(sets)
    mixed = mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    hot, short = hot >> np.uint64(64 - HOT_BITS), own >> np.uint64(64 - HOT_BITS)
    cold = hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] != short if len(hot) else np.ones(len(own), bool)
    most = size * OF // LIKE
    greatest = bands(int(most.max()))
    band = np.searchsorted(greatest, size)
    values, docs = [], []
    for step in (0, 1):
        chosen = most > greatest[band] if step else np.ones(len(sets), bool)
        doc, inside = np.flatnonzero(chosen), np.repeat(chosen, size)
        if not len(doc):
            continue
        last = greatest[band[doc] + step]
        # enough first-level partitions that one has at most `differ` second-level ones in which linked sets differ
        first = -(-(2 * last * (OF - LIKE) // (OF + LIKE) + 1) * extra // (of_extra * (differ + 1))) + 1
        differences = (size[doc] + np.minimum(last, most[doc])) * (OF - LIKE) // (OF + LIKE)
        need = _lost(partitions, differ, first, differences) + 1
        cells, units = np.concatenate(([0], np.cumsum(partitions * first))), np.concatenate(([0], np.cumsum(len(subsets) * first)))
        cell = ((own[inside] >> np.uint64(32)) * np.repeat(partitions * first, size[doc]).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = cell + np.repeat(cells[:-1], size[doc])  # ascending, since sets are
        run = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        total = np.zeros(cells[-1], np.uint64)
        total[at[run]] = np.add.reduceat(mixed[inside], run)
        level = np.full(cells[-1], 2, np.int8)  # 0 with a rare shingle, 1 with frequent ones only, 2 empty
        level[at[run]] = np.where(np.logical_or.reduceat(cold[inside], run), 0, 1)
        total, level = total.reshape(-1, partitions), level.reshape(-1, partitions)
        content = np.stack([sum(total[:, x] * PLACE[i] for i, x in enumerate(some)) for some in subsets], axis=1).ravel()
        level = np.stack([level[:, list(some)].min(axis=1) for some in subsets], axis=1).ravel()
        whose = np.repeat(np.arange(len(doc)), len(subsets) * first)
        rank, before = np.zeros(len(level), np.int64), np.zeros(len(doc), np.int64)
        for k in (0, 1, 2):
            of = level == k
            count = np.concatenate(([0], np.cumsum(of)))
            rank = np.where(of, count[:-1] + (before - count[units[:-1]])[whose], rank)
            before += count[units[1:]] - count[units[:-1]]
        pick = np.flatnonzero(rank < need[whose])
        number = (pick - units[:-1][whose[pick]]).astype(np.uint64)
        which = (band[doc] + step).astype(np.uint64)[whose[pick]]
        values.append(mix(content[pick] + mix(number + (which << np.uint64(40)) + np.uint64(1))) >> np.uint64(64 - SIGNATURE_BITS))
        docs.append(doc[whose[pick]])
    return np.concatenate(values), np.concatenate(docs).astype(np.uint32)


def hot_shingles(documents: DataFrame, shingle: int, blocks: int) -> np.ndarray:
    """Ascending shingles, of which the first HOT_BITS count, that HOT_DOCS documents have; HOT_MOST at most."""
    unused = np.uint64(64 - HOT_BITS)
    edges = np.array([b * ((1 << HOT_BITS) // blocks + 1) for b in range(1, blocks)], dtype=np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batched(batches, COUNT_BYTES):
            keys, n = np.unique(np.concatenate(shingle_sets(texts, shingle)) >> unused, return_counts=True)
            cut = np.searchsorted(keys, edges).tolist()
            for b, (x, y) in enumerate(zip([0, *cut], [*cut, len(keys)], strict=True)):
                if y > x:
                    own, more = keys[x:y], n[x:y] > 1
                    data = planes.pack_sorted(own) + planes.pack_sorted(own[more]) + planes.pack(n[x:y][more].astype(np.uint32) - np.uint32(1))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary())], _ROW.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, several, more = [], [], []
        for batch in batches:
            for x in batch.column(1):
                data = x.as_py()
                own, at = planes.unpack_sorted(data)
                keys.append(own)
                own, at = planes.unpack_sorted(data, at)
                several.append(own)
                more.append(planes.unpack(data, np.uint32, at=at)[0])
        if keys:
            keys = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            np.add.at(n, np.searchsorted(keys, np.concatenate(several)), np.concatenate(more))
            often = n >= HOT_DOCS
            yield pa.RecordBatch.from_arrays([pa.array((keys[often] << unused).view(np.int64)), pa.array(n[often])], ["h", "n"])

    sent = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(send, _ROW)
    found = materialize(sent.repartitionById(blocks, F.col("block")).mapInArrow(count, T.StructType().add("h", "long").add("n", "long")))
    if found.count() > HOT_MOST:
        # the least count that no more than HOT_MOST shingles reach
        least = F.floor(F.log2("n") * 8)
        steps, total, limit = found.groupBy(least.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect(), 0, 0
        for r in steps:
            total += r["n"]
            if total > HOT_MOST:
                limit = r["step"] + 1
                break
        found = found.where(least >= limit)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def _signature_rows(ids: np.ndarray, texts: list[bytes], shingle: int, hot: np.ndarray, blocks: int, scheme: tuple[int, int, int, int]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[i] for i in order]
    sets = shingle_sets(texts, shingle)
    sizes = np.array([len(s) for s in sets], dtype=np.uint32)
    prints = np.array([mix(s + np.uint64(7)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    yield int(prints.sum() % np.uint64(blocks)), b"\1" + planes.pack_sorted(ids.view(np.uint64)) + planes.pack(sizes) + planes.pack(prints)
    # copies within a batch are linked by their fingerprint; the least one signs
    _, first = np.unique(np.stack([sizes.astype(np.uint64), prints]), axis=1, return_index=True)
    first = np.sort(first[sizes[first] > 0])
    if not len(first):
        return
    values, doc = signatures([sets[i] for i in first], hot, scheme)
    order = np.argsort(values)
    values, doc = values[order], doc[order]
    width = (1 << SIGNATURE_BITS) // blocks + 1
    cut = np.searchsorted(values, np.array([b * width for b in range(1, blocks)], dtype=np.uint64)).tolist()
    for b, (x, y) in enumerate(zip([0, *cut], [*cut, len(values)], strict=True)):
        if y > x:
            held, local = np.unique(doc[x:y], return_inverse=True)
            yield b, b"".join([b"\0", planes.pack_sorted(values[x:y]), planes.pack(local.astype(np.uint32)), planes.pack_sorted(ids[first[held]].view(np.uint64))])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected to by the edges (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _match(rows: Iterator[bytes], blocks: int) -> Iterator[tuple[int, bytes]]:
    """Rows of documents as they came, and for each bucket of documents what this block connects them to."""
    values, docs, ids, base = [], [], [], 0
    for data in rows:
        if data[0] == 1:
            yield int.from_bytes(data[-3:], "little") % blocks, data
            continue
        v, at = planes.unpack_sorted(data, 1)
        local, at = planes.unpack(data, np.uint32, at=at)
        own, _ = planes.unpack_sorted(data, at)
        values.append(v)
        docs.append(local + np.uint32(base))
        ids.append(own.view(np.int64))
        base += len(own)
    if not values:
        return
    value, doc = np.concatenate(values), np.concatenate(docs)
    del values, docs
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    count = np.diff(np.append(first, len(value)))
    known, of = np.unique(np.concatenate(ids), return_inverse=True)
    several = count > 1
    a, b = np.repeat(of[doc[first[several]]], count[several]), of[doc[np.repeat(several, count)]]
    root = roots(len(known), a, b)
    child = np.flatnonzero(root != np.arange(len(known)))
    if not len(child):
        return
    bucket = mix(known[child].view(np.uint64)) % np.uint64(blocks)
    order = np.argsort(bucket, kind="stable")
    child, edge = child[order], np.searchsorted(bucket[order], np.arange(blocks + 1, dtype=np.uint64)).tolist()
    for k, (x, y) in enumerate(zip(edge, edge[1:], strict=False)):
        if y > x:
            yield k, b"\0" + planes.pack_sorted(known[child[x:y]].view(np.uint64)) + planes.pack(known[root[child[x:y]]].view(np.uint64))


def _gather(rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """kind 0: document, size, fingerprint. kind 1: two documents of one family, once each."""

    def batch(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), kind, np.int8)), *(pa.array(x[part].astype(np.int64)) for x in (a, b, n))], _FOUND.names)

    low, high = [], []
    for data in rows:
        own, at = planes.unpack_sorted(data, 1)
        if data[0] == 1:
            size, at = planes.unpack(data, np.uint32, at=at)
            yield from batch(0, own.view(np.int64), size, planes.unpack(data, np.uint64, at=at)[0].view(np.int64))
        else:
            high.append(own.view(np.int64))
            low.append(planes.unpack(data, np.uint64, at=at)[0].view(np.int64))
    if low:
        a, b = np.unique(np.stack([np.concatenate(low), np.concatenate(high)]), axis=1)
        yield from batch(1, a, b, np.zeros(len(a), np.int64))


def linked(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of documents that links connect, the least id and each other one.

    A document is compared to all at once. Those in the largest class need no look of their own:
    a link that is left leads to a document outside of it, which is compared to all.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    member = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    known, label = np.unique(ids, return_inverse=True)  # labels are places of ids, so the least is a class's least id
    own, asked = label.copy(), np.zeros(len(sets), bool)
    mark = np.zeros(int(member.max()) + 1, bool)
    while True:
        open_ = np.flatnonzero((label != np.bincount(label).argmax()) & ~asked)
        if not len(open_):
            break
        one = open_[len(open_) // 2]
        asked[one] = True
        # sets of sizes that can link lie next to each other
        x, y = np.searchsorted(size, (-(-size[one] * LIKE // OF), size[one] * OF // LIKE + 1))
        mine = member[start[one] : start[one + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[member[start[x] : start[y]]], start[x:y] - start[x], dtype=np.int64)
        mark[mine] = False
        near = np.unique(label[x:y][OF * both >= LIKE * (size[x:y] + size[one] - both)])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]
    own, at = np.unique(own, return_index=True)
    child = own[label[at] != own]
    return known[label[at][label[at] != own]], known[child]


def _families(groups: DataFrame) -> DataFrame:
    """The linked documents of (family, lo, hi, id, members), each family's rows together: (a, b) for a class's least id and another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                a, b = linked(np.array(ids, dtype=np.int64), sets)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for *own, i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    yield from done()
                    key, ids, sets = own, [], []
                ids.append(i)
                sets.append(planes.unpack_sorted(data)[0])
        yield from done()

    return groups.mapInArrow(run, T.StructType().add("a", "long").add("b", "long"))


def _exact_sets(keyed: DataFrame, shingle: int) -> DataFrame:
    """family, part, parts, id and the packed set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = shingle_sets([t or b"" for t in texts_of(some.column(4))], shingle)
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array([planes.pack_sorted(s) for s in sets], pa.binary())], ["family", "part", "parts", "id", "members"])

    return keyed.select("family", "part", "parts", "id", "text").mapInArrow(run, T.StructType().add("family", "long").add("part", "integer").add("parts", "integer").add("id", "long").add("members", "binary"))


def _beside(frame: DataFrame, other: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join to a materialised table: broadcast when its counted size is within the bound."""
    return frame.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other.hint("shuffle_hash"), on, how)


def _copies(nodes: DataFrame) -> DataFrame:
    """size, print, least and copies of every text."""
    return nodes.where("size > 0").groupBy("size", "print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))


def _found(texts: DataFrame, shingle: int, hot: Broadcast, blocks: int, scheme: tuple[int, int, int, int]) -> DataFrame:
    """Documents (kind 0) and what connects families (kind 1), materialised."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in batched(batches, BATCH_BYTES * 6 // math.comb(*scheme[:2])):
            for block, data in _signature_rows(ids, some, shingle, hot.value, blocks, scheme):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], _ROW.names)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in _match((x.as_py() for batch in batches for x in batch.column(1)), blocks):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], _ROW.names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gather(x.as_py() for batch in batches for x in batch.column(1))

    matched = texts.mapInArrow(sign, _ROW).repartitionById(blocks, F.col("block")).mapInArrow(match, _ROW)
    return materialize(matched.repartitionById(blocks, F.col("block")).mapInArrow(gather, _FOUND))


def _parted(texts: DataFrame, edges: DataFrame, part_members: int) -> DataFrame:
    """id, family, parts, size of the members of families with several texts, materialised."""
    family = components(edges).withColumnRenamed("component", "family")
    member = texts.select(F.col("least").alias("id"), "size").join(family, "id")
    whole = member.groupBy("family").agg(F.sum("size").alias("members"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    parts = F.least(F.ceil(F.col("members") / part_members), F.col("texts")).cast("int")
    return materialize(member.join(whole, "family").select("id", "family", parts.alias("parts"), "size").distinct())


def classes(documents: DataFrame, shingle: int = SHINGLE, blocks: int | None = None, part_members: int = PART_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach."""
    spark = documents.sparkSession
    ship(spark)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = spark.sparkContext.broadcast(hot_shingles(documents, shingle, n))
    release(spark, RELEASE_S)
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("id"), "text")
    found = _found(texts, shingle, hot, n, COARSE)
    nodes = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("size"), F.col("n").alias("print"))
    unlike = materialize(_copies(nodes))
    release(spark, RELEASE_S)  # signatures take most of the disk
    dealt = _parted(unlike, found.where("kind = 1").select("a", "b"), part_members)
    large = materialize(dealt.where("parts > 1").select("id").distinct())
    fine = _found(_beside(texts, large, "id", "inner"), shingle, hot, n, FINE)
    again = _parted(unlike.join(large.withColumnRenamed("id", "least"), "least", "left_semi"), fine.where("kind = 1").select("a", "b"), part_members)
    dealt = materialize(dealt.where("parts = 1").unionByName(again).select("id", "family", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).distinct())
    release(spark)
    exact = _exact_sets(_beside(texts, dealt, "id", "inner"), shingle)
    # every pair of parts; a family of one part stays by itself
    other = F.explode(F.expr("if(parts = 1, array(0), filter(sequence(0, parts - 1), x -> x <> part))"))
    pairs = exact.select("*", other.alias("other")).select("family", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "id", "members")
    links = _families(pairs.repartition(n, "family", "lo", "hi").sortWithinPartitions("family", "lo", "hi"))
    # copies: every document with the least one of its text; texts with very many copies are few enough to broadcast
    several = unlike.where("copies > 1")
    many = F.lit(int(HOT_COPIES * nodes.count()) + 1)
    copies = nodes.join(F.broadcast(several.where(F.col("copies") >= many)), ["size", "print"]).unionByName(nodes.join(F.broadcast(several.where(F.col("copies") >= many).select("size", "print")), ["size", "print"], "left_anti").join(several.where(F.col("copies") < many), ["size", "print"])).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    edges = materialize(links.unionByName(copies))  # components() reads them twice
    final = components(edges)
    release(spark)
    out = nodes.join(final, "id", "left").select("id", "size", F.coalesce("component", "id").alias("component"))
    given = lambda c: F.when(F.col(c) != FIRST_ID, F.col(c))
    return out.select(given("id").alias("doc_id"), F.col("size").alias("n_shingles"), given("component").alias("component_id"))


def _row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("__talespan_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__talespan_text")]


def one_row_each(documents: DataFrame) -> DataFrame:
    """Documents with one row for each doc_id and text; which one of several stays is left open if other columns differ.

    Repeated rows are counted by their text's sha256, so that only their own texts are shuffled.
    """
    names = documents.columns
    keys = [F.col("__talespan_id"), F.col("__talespan_text")]
    many = materialize(documents.select(*_row_key()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    keyed = documents.select("*", *_row_key())
    on = ["__talespan_id", "__talespan_text"]
    single, several = _beside(keyed, many, on, "left_anti"), _beside(keyed, many, on, "left_semi")
    # first() of whole rows is added up in each task before it is shuffled, so a row that is a third of all is no burden
    whole = several.groupBy(*on).agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return single.select(*names).unionByName(whole)


def one_of_each(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Documents without those that link, over links, to one with a smaller doc_id, and without repeated rows."""
    drop = materialize(classes(documents, shingle).where("component_id < doc_id or (component_id is null and doc_id is not null)").select("doc_id").distinct())
    release(documents.sparkSession)
    return _beside(one_row_each(documents), drop, "doc_id", "left_anti").select(*documents.columns)
