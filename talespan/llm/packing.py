"""Lexical retrieval packing of token ids into windows.

Every document is encoded whole and gets an end id. Runs of `window` ids from its start are windows
by themselves; the rest of a document is packed with others. Rests are range-partitioned by a
lexical key (the least hash of their id pairs) and the document, so that like rests meet and copies
of one text, however many, spread over the shards. A shard is searched whole: it has one BM25
inverted index over token ids, with document frequencies and mean length counted over all rests of
the table. A seed rest opens a window; its unused neighbours, best score first, fill it greedily,
and the last is cut where the window is full; what is left of it stays a neighbour for later seeds.
Postings of common ids are kept as dense rows; rests that are used up leave the index. A shard
leaves at most one window short.

Defined results: null and empty texts have the end id alone. Repeated rows are packed each by
itself. Ties of scores go to the earlier rest of the shard. No documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from talespan.llm.tokens import encoder
from talespan.llm.words import chunks, mix
from talespan.runtime import materialize, ship

WINDOW = 2048
END_ID = 1
#: Pieces that the encoder keeps; a pipeline may keep fewer, since its stages' data share the workers.
CACHE_PIECES = 800_000
#: Bytes of texts that are encoded in one call: fewer look up more pieces twice, more leave the processor's caches.
ENCODED_BYTES = 4 << 20
#: Rests that are used up before an index drops them.
BLOCK_RESTS = 512
#: Rests a shard on average at most, whatever the session's settings, so that a task's index is bounded and equal tables are packed alike. A
#: seed's neighbours are those of its shard; more rests a shard find more of the true ones at a cost that grows as much.
SHARD_RESTS = 5000
#: Rests from which a shard is filled in parts, which range partitions reach only where very many rests are equal.
MOST_RESTS = 16384
#: Ids fit in 16 bits.
IDS = 1 << 16
#: Ids in more than this share of an index's rests have dense rows.
COMMON = 1 / 8
K1, B = 1.2, 0.75

_REST = T.StructType().add("doc_id", "long").add("lexical", "long").add("doc_tokens", "long").add("full_crc", T.ArrayType(T.LongType())).add("rest", "binary")
_PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def lexical_key(ids: np.ndarray) -> int:
    """Near copies mostly have the same least pair."""
    wide = ids.astype(np.uint64)
    pairs = wide[:-1] << np.uint64(20) | wide[1:] if len(ids) > 1 else wide
    return int(mix(pairs + np.uint64(1)).min() >> np.uint64(1)) if len(pairs) else 0


def rests(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, cache_pieces: int = CACHE_PIECES, encoded_bytes: int = ENCODED_BYTES) -> DataFrame:
    """One row a document: its length, the checksums of its full windows, and the ids that are left."""
    ship(documents.sparkSession)
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    if max(size, end_id + 1) > IDS:
        raise ValueError(f"the tokenizer has {size} ids and the end id is {end_id}; ids are kept in 16 bits")
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, "<u2", cache_pieces=cache_pieces)
        for batch in batches:
            for rows, _ in chunks(batch, limit=encoded_bytes):
                total, full, left, key = [], [], [], []
                for data in encode.encode(rows.column(1).to_pylist()):
                    data += end
                    n = len(data) // 2
                    cut = n - n % window
                    total.append(n)
                    ids = np.frombuffer(data, "<u2")
                    full.append([crc(ids[a : a + window]) for a in range(0, cut, window)])
                    left.append(data[2 * cut :])
                    key.append(lexical_key(ids[cut:]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(key, pa.int64()), pa.array(total, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(left, pa.binary())], _REST.names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _REST)


def statistics(encoded: DataFrame) -> tuple[int, np.ndarray, float]:
    """Rests, rests with each id, and mean length, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS + 2, dtype=np.int64)
        for batch in batches:
            for rest in batch.column(0).to_pylist():
                ids = np.frombuffer(rest, "<u2")
                total[ids] += 1  # an indexed sum counts equal ids once
                total[IDS:] += len(ids) > 0, len(ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    out = np.zeros(IDS + 2, dtype=np.int64)
    for r in encoded.select("rest").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return int(out[IDS]), out[:IDS], out[IDS + 1] / max(out[IDS], 1)


class Index:
    """BM25 over the token ids of rests; `live` are those that are left in it."""

    def __init__(self, ids: list[np.ndarray], corpus: tuple[int, np.ndarray, float] | None = None):
        length = np.array([len(i) for i in ids], dtype=np.float64)
        # one sort for all rests: a cell is a rest and an id of it
        key = np.concatenate(ids).astype(np.uint64) | np.repeat(np.arange(len(ids), dtype=np.uint64) << np.uint64(16), length.astype(np.int64))
        key.sort()
        cell = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf = np.diff(np.append(cell, len(key))).astype(np.float64)
        all_terms, all_docs = (key[cell] & np.uint64(0xFFFF)).astype(np.uint16), (key[cell] >> np.uint64(16)).astype(np.int32)
        order = np.argsort(all_terms, kind="stable")
        df = np.bincount(all_terms, minlength=IDS)
        vocabulary = np.flatnonzero(df)
        df = df[vocabulary]
        place = np.zeros(IDS, dtype=np.int32)
        place[vocabulary] = np.arange(len(vocabulary))
        term = place[all_terms[order]]
        n, mean = len(ids), length.mean()
        if corpus is not None:
            n, df, mean = corpus[0], corpus[1][vocabulary], corpus[2]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(mean, 1.0))
        self.term, self.doc = term, all_docs[order]
        self.weight = idf[term] * (tf * (K1 + 1))[order] / (tf[order] + norm[self.doc])
        self.vocabulary = len(vocabulary)
        self.terms = np.split(place[all_terms], np.searchsorted(all_docs, np.arange(1, len(ids))))
        self.live = np.arange(len(ids))
        self._lay()

    def _lay(self) -> None:
        """Dense rows of the common ids and postings of the others."""
        n = len(self.live)
        df = np.bincount(self.term, minlength=self.vocabulary)
        common = df > COMMON * n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        dense = common[self.term]
        self.dense = np.zeros((int(common.sum()), n), dtype=np.float32)
        self.dense[self.row[self.term[dense]], self.doc[dense]] = self.weight[dense]
        self.docs, self.weights = self.doc[~dense], self.weight[~dense]
        self.df = np.where(common, 0, df)
        self.first = np.cumsum(self.df) - self.df

    def drop(self, open_: np.ndarray) -> None:
        """Only open rests stay."""
        stay = open_[self.live]
        kept = stay[self.doc]
        self.term, self.doc, self.weight = self.term[kept], (np.cumsum(stay) - 1).astype(np.int32)[self.doc[kept]], self.weight[kept]
        self.live = self.live[stay]
        self._lay()

    def scores(self, seed: int) -> np.ndarray:
        """Scores of the live rests."""
        terms = self.terms[seed]
        row = self.row[terms]
        df = self.df[terms]
        shift = np.repeat(self.first[terms] - np.cumsum(df) + df, df)
        at = np.arange(len(shift)) + shift
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=len(self.live)) + self.dense[row[row >= 0]].sum(axis=0)

    def ranked(self, seed: int, open_: np.ndarray, head: int = 64) -> Iterator[int]:
        """Open rests, best score first; all but the first few are sorted only when asked for."""
        score, stay = self.scores(seed), open_[self.live]
        score, live = score[stay], self.live[stay]
        least = np.partition(score, len(score) - head)[len(score) - head] if len(score) > head else -np.inf
        for some in (score >= least, score < least):
            at = np.flatnonzero(some)
            yield from live[at[np.argsort(-score[at], kind="stable")]].tolist()


class Rest:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, total: int, ids: np.ndarray):
        self.doc, self.start, self.total, self.ids = doc, start, total, ids


def fill(block: list[Rest], window: int, last: bool, corpus: tuple[int, np.ndarray, float] | None = None, drop_after: int = BLOCK_RESTS) -> tuple[list[list[tuple[Rest, int, int]]], list[Rest]]:
    """Windows of (rest, from, to), and the rests of an unfilled window unless these are the shard's last rests."""
    index = Index([r.ids for r in block], corpus)
    used = np.zeros(len(block), dtype=np.int64)
    size = np.array([len(r.ids) for r in block], dtype=np.int64)
    left, gone = int(size.sum()), 0
    windows: list[list[tuple[Rest, int, int]]] = []
    for seed in range(len(block)):
        while used[seed] < size[seed] and (left >= window or last):
            taken, room = [], window
            ranked = None
            at = seed
            while room and left:
                open_ = int(size[at] - used[at])
                if open_:
                    n = min(open_, room)
                    taken.append((block[at], int(used[at]), int(used[at]) + n))
                    used[at] += n
                    room, left = room - n, left - n
                    gone += n == open_
                if room:
                    if ranked is None:
                        ranked = index.ranked(seed, used < size)
                    at = next((d for d in ranked if used[d] < size[d]), -1)
                    if at < 0:
                        break
            windows.append(taken)
            if gone >= max(drop_after, len(index.live) // 8):
                index.drop(used < size)
                gone = 0
    kept = []
    for r, u in zip(block, used.tolist(), strict=True):
        if u < len(r.ids):
            kept.append(Rest(r.doc, r.start + u, r.total, r.ids[u:]))
    return windows, kept


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, block_rests: int = BLOCK_RESTS, cache_pieces: int = CACHE_PIECES, encoded_bytes: int = ENCODED_BYTES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    encoded = materialize(rests(documents, tokenizer, window, end_id, cache_pieces, encoded_bytes))
    counted = statistics(encoded)
    shards = max(1, -(-counted[0] // SHARD_RESTS))
    corpus = spark.sparkContext.broadcast(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[Rest] = []
        out: list[tuple] = []

        def put(windows: list[list[tuple[Rest, int, int]]]) -> None:
            nonlocal sequence
            for pieces in windows:
                at = 0
                for r, a, b in pieces:
                    out.append((r.doc, r.start + a, b - a, crc(r.ids[a:b]), r.total, sequence, at))
                    at += b - a
                sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out, strict=True)) or [[]] * len(_PIECE_NAMES)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _PIECE_NAMES)

        for batch in batches:
            for row in batch.to_pylist():
                for i, full in enumerate(row["full_crc"]):
                    out.append((row["doc_id"], i * window, window, full, row["doc_tokens"], sequence, 0))
                    sequence += 1
                ids = np.frombuffer(row["rest"], "<u2")
                if len(ids):
                    held.append(Rest(row["doc_id"], row["doc_tokens"] - len(ids), row["doc_tokens"], ids))
                if len(held) >= MOST_RESTS:
                    windows, held = fill(held, window, False, corpus.value, block_rests)
                    put(windows)
            yield flush()
        if held:
            put(fill(held, window, True, corpus.value, block_rests)[0])
        yield flush()

    schema = T.StructType()
    for name in _PIECE_NAMES:
        schema = schema.add(name, "long")
    # the ids' checksum orders rests of one doc_id, so that a task that runs again packs as before
    order = [F.col("lexical"), F.col("doc_id"), F.crc32("rest"), F.col("doc_tokens")]
    return encoded.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, schema)
