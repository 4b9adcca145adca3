"""Quality classifier: interpolated modified Kneser-Ney model of words and per-language perplexity quantiles.

The model is of order 2 over lower-cased words, hashed to 32 bits, with a start and an end for every
text. Documents fall in two halves by their id. Each half's trusted documents are counted for a model of
their own, which scores all documents of the other half, so no document, trusted or not, is judged by its own counts.
A model's n-gram space is cut into shards by
context; contexts of a large share of all words, listed first, are dealt over all shards by the whole
n-gram. A batch sends each shard its distinct n-grams, packed. A shard adds them up, asks the shards
that own its words in how many contexts each word follows, and so has all counts of its n-grams: the
tables grow with the trusted text and no table is sent whole.

The logarithm of a text's probability is a sum over its n-grams. For context v and word w it is
log g(v) + log p(w), and log(1 + (n - d) / (f(v) p(w))) more if the n-gram was counted n times, with
back-off weight g, discount d, freed mass f, and continuation share p. Every word of a text is a
context once, and the start stands for the end, so the shard of v adds log g(v) + log p(v). Documents' n-grams
travel to the shards with their document's place in the batch; sums by document come back.

A document is rejected when its perplexity is above its language's quantile among trusted
documents, times a margin; languages with few of these use the quantile of all. Short texts are drawn
towards their language's mean by PRIOR_WORDS words of it.

Defined results: null and empty texts have no words, perplexity 0 and are kept. A null lang is a
language of its own. A document is trusted if any of its labels is; repeated rows are counted and
scored each. With no trusted document nothing is rejected. Other columns pass through `keep()`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.llm import planes
from talespan.llm.words import FIRST_ID, Words, batched, byte_table, mix
from talespan.runtime import materialize, release, ship

QUANTILE = 0.995
MARGIN = 1.1
#: Halves of the documents, by crc32 of the id; each is judged by the other one's model.
HALVES = 2
#: Trusted documents of a language from which it has a threshold of its own.
LEAST_TRUSTED = 30
PRIOR_WORDS = 20
#: Bytes of text in a batch whose n-grams are sorted together.
BATCH_BYTES = 5 << 20
#: Rows up to which a counted table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Contexts with this share of a shard's fair load are dealt over all shards, so there are at most shards / HOT_LOAD of them.
HOT_LOAD = 0.25
#: Sums that a scoring task holds before it sends them.
HELD_SUMS = 1 << 20
#: Rounds in which a half of the documents meets its shards; more rounds take less disk and more hashing of words.
ROUNDS = 2
START, END = np.uint64(1), np.uint64(2)
_LOW = np.uint64(0xFFFFFFFF)

_ROW = T.StructType().add("kind", "integer").add("block", "integer").add("data", "binary")
_NAMES = _ROW.names


def _row(kind: int, block: int, *parts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([b"".join(parts)], pa.binary())], _NAMES)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context << 32 | word of every n-gram of the texts that have words, and the text of each."""
    words = Words(texts, byte_table("space-lower"))
    count = np.diff(words.first)
    own = np.maximum((words.hashes >> np.uint64(32)).astype(np.uint32), np.uint32(3)).astype(np.uint64)
    some = np.flatnonzero(count)
    out = np.empty(len(own) + len(some), np.uint64)
    doc = np.repeat(some, count[some] + 1)
    last = np.cumsum(count[some] + 1) - 1
    follows = np.ones(len(out), bool)
    follows[last] = False
    out[follows] = own
    out[last] = END
    context = np.concatenate((np.array([START]), out[:-1])) if len(out) else out
    context[np.concatenate(([0], last[:-1] + 1))[: len(last)]] = START
    return context << np.uint64(32) | out, doc


def shard_of(key: np.ndarray, hot: np.ndarray, blocks: int) -> np.ndarray:
    """Shards of n-grams: by context, or by the whole n-gram where the context is hot."""
    context = key >> np.uint64(32)
    by = np.where(np.isin(context, hot), mix(key), mix(context))
    return (by % np.uint64(blocks)).astype(np.int64)


def _dealt(key: np.ndarray, hot: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard's n-grams, in the given order."""
    shard = shard_of(key, hot, blocks)
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    edge = np.searchsorted(shard[order], np.arange(blocks + 1)).tolist()
    for b, (x, y) in enumerate(zip(edge, edge[1:], strict=False)):
        if y > x:
            yield b, order[x:y]


def _pack_keys(key: np.ndarray) -> bytes:
    """Ascending n-grams as contexts, how many words each has, and the words."""
    context = (key >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    word = (key & _LOW).astype(np.uint32)
    step = np.diff(word, prepend=np.uint32(0))
    step[first] = word[first]
    return planes.pack(np.diff(context[first], prepend=np.uint32(0))) + planes.pack(np.diff(np.append(first, len(key))).astype(np.uint32)) + planes.pack(step)


def _unpack_keys(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    context, at = planes.unpack(data, np.uint32, at=at)
    count, at = planes.unpack(data, np.uint32, at=at)
    step, at = planes.unpack(data, np.uint32, at=at)
    first = np.cumsum(count.astype(np.int64)) - count
    word = np.cumsum(step.astype(np.uint64))
    base = np.where(first > 0, word[first - 1], 0).astype(np.uint64)
    word -= np.repeat(base, count)
    return np.repeat(np.cumsum(context, dtype=np.uint32).astype(np.uint64), count) << np.uint64(32) | word, at


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([np.empty(0, np.uint64), *keys]), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([np.empty(0), *counts]), minlength=len(key)).astype(np.int64)


def _hot_contexts(trusted: DataFrame, blocks: int) -> np.ndarray:
    """Contexts with so large a share of all words that one shard should not hold them."""
    share = HOT_LOAD / blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batched(batches, BATCH_BYTES):
            word, n = np.unique(grams(texts)[0] >> np.uint64(32), return_counts=True)
            often = n >= share / 2 * n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[often], 0).astype(np.int64)), pa.array(np.append(n[often], n.sum()))], ["word", "n"])

    found = materialize(trusted.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = found.where("word = 0").select("n").first()
    rows = found.where((F.col("word") != 0) & (F.col("n") >= share * (total[0] if total else 0))).select("word").toArrow()
    return np.sort(rows.column("word").to_numpy().astype(np.uint64))


class Discounts:
    """Of n-grams that were counted once, twice, and more often, by how many were counted once to four times."""

    def __init__(self, often: list[int]):
        n1, n2, n3, n4 = (max(n, 1) for n in often)
        y = n1 / (n1 + 2 * n2)
        self.by = np.array([0.0] + [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])

    def of(self, counts: np.ndarray) -> np.ndarray:
        return self.by[np.minimum(counts, 3)]


def _often(counts: np.ndarray) -> bytes:
    return np.array([*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 2).sum()), len(counts), int(counts.sum())], dtype="<i8").tobytes()


#: Kinds of rows. OWN: a shard's n-grams and counts. ASK: words of a shard and contexts there that each follows.
#: OFTEN: counts of counts. HOT: per hot context, sums of its n-grams in a shard; per hot word, its contexts.
OWN, TOLD, REQUEST, ASK, OFTEN, HOT = range(6)


def _count(trusted: DataFrame, hot: Broadcast, blocks: int) -> DataFrame:
    """OWN, ASK, OFTEN and HOT rows of every shard, materialised."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batched(batches, BATCH_BYTES):
            key, n = np.unique(grams(texts)[0], return_counts=True)
            for b, at in _dealt(key, hot.value, blocks):
                yield _row(OWN, b, _pack_keys(key[at]), planes.pack(n[at].astype(np.uint32)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, block = [], [], 0
        for batch in batches:
            for b, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key, at = _unpack_keys(data)
                keys.append(key)
                counts.append(planes.unpack(data, np.uint32, at=at)[0])
                block = b
                if len(keys) >= 32:
                    keys, counts = ([x] for x in _summed(keys, counts))
        if not keys:
            return
        key, n = _summed(keys, counts)
        yield _row(OWN, block, _pack_keys(key), planes.pack(n.astype(np.uint32)))
        yield _row(OFTEN, 0, _often(n))
        # hot contexts are in many shards, so their sums are made elsewhere
        context = key >> np.uint64(32)
        mine = np.isin(context, hot.value)
        if mine.any():
            own, at = np.unique(context[mine], return_inverse=True)
            sums = [np.bincount(at, weights=x[mine], minlength=len(own)).astype(np.uint32) for x in (n, n == 1, n == 2, n > 2)]
            yield _row(HOT, 0, planes.pack_sorted(own), *map(planes.pack, sums))
        word, follows = np.unique(key & _LOW, return_counts=True)
        asked = np.union1d(word, np.where(context == START, END, context)[~mine])
        told = np.zeros(len(asked), np.uint32)
        told[np.searchsorted(asked, word)] = follows
        owner = (mix(asked) % np.uint64(blocks)).astype(np.int64)
        for b in np.unique(owner).tolist():
            at = np.flatnonzero(owner == b)
            yield _row(ASK, b, np.array([block], "<i4").tobytes(), planes.pack_sorted(asked[at]), planes.pack(told[at]))

    return materialize(trusted.mapInArrow(send, _ROW).repartitionById(blocks, F.col("block")).mapInArrow(add, _ROW))


def _tell(counted: DataFrame, hot: Broadcast, blocks: int) -> DataFrame:
    """TOLD rows for the shards that asked, OFTEN rows of continuations, HOT rows of hot words, materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for batch in batches:
            for data in batch.column(2).to_pylist():
                word, at = planes.unpack_sorted(data, 4)
                asked.append((int.from_bytes(data[:4], "little"), word, planes.unpack(data, np.uint32, at=at)[0]))
        if not asked:
            return
        word, follows = _summed([a[1] for a in asked], [a[2] for a in asked])
        yield _row(OFTEN, 0, _often(follows[follows > 0]))
        for block, own, _ in asked:
            yield _row(TOLD, block, planes.pack_sorted(own), planes.pack(follows[np.searchsorted(word, own)].astype(np.uint64)))
        mine = np.isin(word, hot.value) | (word == END)
        if mine.any():
            yield _row(HOT, 0, planes.pack_sorted(word[mine]), planes.pack(follows[mine].astype(np.uint64)))

    return materialize(counted.where(F.col("kind") == ASK).repartitionById(blocks, F.col("block")).mapInArrow(run, _ROW))


def _hot_sums(rows: DataFrame, kinds: list[type]) -> tuple[np.ndarray, np.ndarray]:
    """Hot words and, for each, sums of the values that shards have for it; as many as there are hot words, not one for each shard."""
    names = [f"v{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own, at = planes.unpack_sorted(data)
                values = []
                for kind in kinds:
                    value, at = planes.unpack(data, kind, at=at)
                    values.append(pa.array(value.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *values], ["word", *names])

    schema = ", ".join(f"{n} long" for n in ["word", *names])
    found = rows.where(F.col("kind") == HOT).select("data").mapInArrow(run, schema).groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).orderBy("word").toArrow()
    return found.column("word").to_numpy().astype(np.uint64), np.stack([found.column(n).to_numpy() for n in names], axis=1).reshape(-1, len(kinds))


def _small(rows: DataFrame, kind: int) -> list[bytes]:
    """Rows of a kind that a shard makes one of, of bounded size."""
    return [bytes(r["data"]) for r in rows.where(F.col("kind") == kind).select("data").collect()]


class Shares:
    """What all shards need to know: discounts, sums over all words, and the hot contexts' values."""

    def __init__(self, counted: DataFrame, told: DataFrame):
        often = [sum(np.frombuffer(x, "<i8") for x in _small(rows, OFTEN)) + np.zeros(7, np.int64) for rows in (counted, told)]
        self.bigram, self.word = (Discounts(x[:4].tolist()) for x in often)
        self.words, self.pairs = int(often[1][5]), max(int(often[1][6]), 1)
        self.freed = float(self.word.by[1:] @ np.array([often[1][0], often[1][1], often[1][4]])) / self.pairs
        self.any = self.freed / (self.words + 1) if self.words else 1.0
        self.hot, rows = _hot_sums(counted, [np.uint32] * 4)
        words, n = _hot_sums(told, [np.uint64])
        follows = dict(zip(words.tolist(), n[:, 0].tolist(), strict=True))
        self.hot_freed = rows[:, 1:] @ self.bigram.by[1:]
        self.hot_base = np.log(self.hot_freed / np.maximum(rows[:, 0], 1)) + np.log(self.share(np.array([follows.get(int(END) if c == START else c, 0) for c in self.hot.tolist()], dtype=np.int64)))

    def share(self, follows: np.ndarray) -> np.ndarray:
        """Interpolated share of words that follow so many contexts."""
        return (follows - self.word.of(follows)) / self.pairs + self.any


class Shard:
    """Logarithms that a shard adds: by context for each n-gram, and more for each counted one."""

    def __init__(self, shares: Shares, key: np.ndarray, n: np.ndarray, words: np.ndarray, follows: np.ndarray):
        context, word = key >> np.uint64(32), key & _LOW
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))[: len(key)]
        own = context[first]
        cut = shares.bigram.of(n)
        each = np.diff(np.append(first, len(key)))
        freed = np.add.reduceat(cut, first) if len(key) else np.empty(0)
        total = np.add.reduceat(n, first) if len(key) else np.empty(0)
        hot = np.isin(own, shares.hot)
        freed[hot] = shares.hot_freed[np.searchsorted(shares.hot, own[hot])]
        share = lambda x: shares.share(follows[np.searchsorted(words, x)])
        self.key, self.more = key, np.log1p((n - cut) / (np.repeat(freed, each) * share(word))) if len(key) else np.empty(0)
        cold = ~hot
        self.context = np.concatenate((own[cold], shares.hot))
        base = np.log(freed[cold] / total[cold]) + np.log(share(np.where(own[cold] == START, END, own[cold]))) if cold.any() else np.empty(0)
        order = np.argsort(self.context)
        self.context, self.base, self.unknown = self.context[order], np.concatenate((base, shares.hot_base))[order], np.log(shares.any)

    def add(self, key: np.ndarray) -> np.ndarray:
        """What each n-gram adds to its text."""
        out = np.full(len(key), self.unknown)
        for table, values, asked, replace in ((self.context, self.base, key >> np.uint64(32), True), (self.key, self.more, key, False)):
            if len(table):
                at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
                known = table[at] == asked
                out[known] = values[at[known]] + (0 if replace else out[known])
        return out


def _scores(documents: DataFrame, model: DataFrame, shares: Broadcast, hot: Broadcast, blocks: int, rounds: int) -> DataFrame:
    """id, crc, logarithm of the probability and number of words of every text with words.

    Shards meet the documents in rounds, each over all documents and some of the shards, so that only
    a part of all n-grams is on disk at a time; the sums of all rounds are added up.
    """
    edge = [blocks * k // rounds for k in range(rounds + 1)]
    parts = []
    for low, high in zip(edge, edge[1:], strict=False):
        if high > low:
            parts.append(_sums(documents, model.where(F.col("block").between(low, high - 1)), shares, hot, blocks, low, high))
            release(documents.sparkSession)
    return reduce(DataFrame.unionByName, parts).groupBy("id", "crc").agg(F.sum("log").alias("log"), F.sum("n").alias("n"))


def _sums(documents: DataFrame, model: DataFrame, shares: Broadcast, hot: Broadcast, blocks: int, low: int, high: int) -> DataFrame:
    """What the shards from low to high add to every text, materialised."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batched(batches, BATCH_BYTES):
            key, doc = grams(texts)
            shard = shard_of(key, hot.value, blocks)
            mine = np.flatnonzero((shard >= low) & (shard < high))
            order = mine[np.argsort(key[mine], kind="stable")]
            key, doc = key[order], doc[order]
            crc = np.array([zlib.crc32(t) for t in texts], dtype=np.uint32)
            for b, at in _dealt(key, hot.value, blocks):
                held, local = np.unique(doc[at], return_inverse=True)
                yield _row(REQUEST, b, _pack_keys(key[at]), planes.pack(local.astype(np.uint32)), planes.pack(ids[held].view(np.uint64)), planes.pack(crc[held]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, words, follows, shard = np.empty(0, np.uint64), np.empty(0, np.int64), [np.empty(0, np.uint64)], [np.empty(0, np.int64)], None
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == OWN:
                    key, at = _unpack_keys(data)
                    n = planes.unpack(data, np.uint32, at=at)[0].astype(np.int64)
                elif kind == TOLD:
                    own, at = planes.unpack_sorted(data)
                    words.append(own)
                    follows.append(planes.unpack(data, np.uint64, at=at)[0].astype(np.int64))
                else:
                    if shard is None:
                        word, first = np.unique(np.concatenate(words), return_index=True)
                        shard = Shard(shares.value, key, n, word, np.concatenate(follows)[first])
                    asked, at = _unpack_keys(data)
                    local, at = planes.unpack(data, np.uint32, at=at)
                    ids, at = planes.unpack(data, np.uint64, at=at)
                    crc, _ = planes.unpack(data, np.uint32, at=at)
                    held.append((ids, crc, np.bincount(local, weights=shard.add(asked), minlength=len(ids)), np.bincount(local, minlength=len(ids))))
                    if sum(len(h[0]) for h in held) >= HELD_SUMS:
                        yield from sums(held)
                        held = []
        if held:
            yield from sums(held)

    def sums(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, crc, log, n = _merged(held)
        bucket = (mix(ids ^ mix(crc.astype(np.uint64))) % np.uint64(blocks)).astype(np.int64)  # many texts may have one id, or none
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(blocks + 1)).tolist()
        for b, (x, y) in enumerate(zip(edge, edge[1:], strict=False)):
            if y > x:
                at = order[x:y]
                yield _row(0, b, planes.pack_sorted(ids[at]), planes.pack(crc[at]), planes.pack(log[at].astype(np.float32).view(np.uint32)), planes.pack(n[at].astype(np.uint32)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for data in batch.column(2).to_pylist():
                ids, at = planes.unpack_sorted(data)
                crc, at = planes.unpack(data, np.uint32, at=at)
                log, at = planes.unpack(data, np.uint32, at=at)
                n, _ = planes.unpack(data, np.uint32, at=at)
                held.append((ids, crc, log.view(np.float32).astype(np.float64), n.astype(np.int64)))
                size += len(ids)
                if size >= HELD_SUMS:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size >= HELD_SUMS // 2:  # so many different texts go on as they are
                        yield from whole(held)
                        held, size = [], 0
        if held:
            yield from whole(held)

    def whole(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, crc, log, n = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(crc.astype(np.int64)), pa.array(log), pa.array(n)], ["id", "crc", "log", "n"])

    requests = documents.mapInArrow(send, _ROW)
    # the model's rows of a shard come before its requests
    met = model.unionByName(requests).repartitionById(blocks, F.col("block")).sortWithinPartitions("kind")
    parts = met.mapInArrow(score, _ROW).repartitionById(blocks, F.col("block")).mapInArrow(gather, "id long, crc long, log double, n long")
    return materialize(parts.groupBy("id", "crc").agg(F.sum("log").alias("log"), F.sum("n").alias("n")))


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Ids, crcs, and the sums of two values for each."""
    ids, crc, *values = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((crc, ids))
    ids, crc = ids[order], crc[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (crc[1:] != crc[:-1]))))
    return ids[first], crc[first], *(np.add.reduceat(v[order], first) for v in values)


def _beside(documents: DataFrame, other: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join to a materialised table: broadcast when its counted size is within the bound."""
    return documents.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other, on, how)


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")]


def judged(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, blocks: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """id, crc, lang, perplexity, threshold and kept of every document, materialised."""
    spark = documents.sparkSession
    ship(spark)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    half = F.crc32(F.col("id").cast("string").cast("binary")) % HALVES
    ids = materialize(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct())
    texts = documents.select(_key()[0], "text").withColumn("half", half)
    parts = []
    for k in range(HALVES):
        trusted = _beside(texts.where(F.col("half") == k), ids, "id", "left_semi").select("id", "text")
        hot = spark.sparkContext.broadcast(_hot_contexts(trusted, n))
        counted = _count(trusted, hot, n)
        told = _tell(counted, hot, n)
        release(spark)
        shares = spark.sparkContext.broadcast(Shares(counted, told))
        model = counted.where(F.col("kind") == OWN).unionByName(told.where(F.col("kind") == TOLD))
        parts.append(_scores(texts.where(F.col("half") != k).select("id", "text"), model, shares, hot, n, rounds))
    found = reduce(DataFrame.unionByName, parts)
    rows = documents.select(*_key(), F.col("lang").cast("string").alias("lang")).join(found, ["id", "crc"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = materialize(rows.join(ids.withColumn("sets", F.lit(True)), "id", "left").withColumn("language", F.coalesce("lang", F.lit(""))))
    sets = rows.where("sets and n > 0")
    mean = sets.groupBy("language").agg((F.sum("log") / F.sum("n")).alias("mean"))
    all_mean = sets.agg(F.sum("log") / F.sum("n")).first()[0]
    drawn = rows.join(F.broadcast(mean), "language", "left").withColumn("mean", F.coalesce("mean", F.lit(all_mean).cast("double"), F.lit(0.0)))
    drawn = drawn.withColumn("entropy", F.when(F.col("n") > 0, -(F.coalesce("log", F.lit(0.0)) + PRIOR_WORDS * F.col("mean")) / (F.col("n") + PRIOR_WORDS)).otherwise(F.lit(0.0)))
    # quantiles over steps of a hundredth, so that a task holds few values however many documents there are
    steps = drawn.where("sets and n > 0").groupBy("language", F.ceil(F.col("entropy") * 100).alias("step")).agg(F.count(F.lit(1)).alias("docs"))
    cut = (F.percentile("step", quantile, F.col("docs")) / 100).alias("cut")
    every = steps.agg(cut).first()["cut"]
    own = steps.groupBy("language").agg(cut, F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_TRUSTED).select("language", "cut")
    limit = F.exp(F.coalesce("cut", F.lit(every).cast("double"), F.lit(float("inf")))) * margin
    perplexity = F.when(F.col("n") > 0, F.exp("entropy")).otherwise(F.lit(0.0))
    return materialize(drawn.join(F.broadcast(own), "language", "left").select("id", "crc", "lang", perplexity.alias("perplexity"), limit.alias("threshold"), (perplexity <= limit).alias("kept")))


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every document."""
    return judged(documents, labels).select(F.when(F.col("id") != FIRST_ID, F.col("id")).alias("doc_id"), "lang", "perplexity", "threshold", "kept")


def keep(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass."""
    names = documents.columns
    gone = materialize(judged(documents, labels).where(~F.col("kept")).select(F.col("id").alias("__talespan_id"), F.col("crc").alias("__talespan_crc")).distinct())
    key, crc = _key()
    keyed = documents.withColumns({"__talespan_id": key, "__talespan_crc": crc})
    return _beside(keyed, gone, ["__talespan_id", "__talespan_crc"], "left_anti").select(*names)
