"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Examples are a bounded sample of the labelled rows that are not held out. Features are words whose
rate among toxic examples differs from that among the others by a clear margin; their inverse
document frequencies are counted over all documents. Each feature's postings lie in blocks of
examples with the largest weight of each block. A query adds up block maxima to upper bounds, then
scores blocks from the highest bound down until no block can reach the k-th best cosine, so the
neighbours are exact. Ties go to the earlier example. Neighbours vote with their cosine against a
prior; the votes are calibrated by shares of toxic examples among leave-one-out scores. Each example
counts for as many labelled rows as were drawn for one of its label, so that prior, votes and shares
are those of all training labels, whether the sample's bound cuts one label, both or none.

Labels, language, source and doc_id are no inputs of a score. Defined results: null, empty and
feature-free texts have no neighbours and get the share of toxic examples among such texts; a
document whose labels contradict each other counts as toxic if any says so; null labels are left out; without any
example every score is 0. Repeated rows are scored each. A null doc_id is held out if crc32 of "" says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.llm.words import Words, byte_table, chunks
from talespan.runtime import ship

#: Examples of each label at most: the labelled rows with the least hashed ids.
EXAMPLES_EACH = 4000
FOLDS = 5
NEIGHBOURS = 25
BLOCK = 128
#: Blocks scored between two looks at the bounds.
BLOCKS_AT_ONCE = 8
#: Standard errors by which a word's rates must differ, and examples that must have it.
LEAST_Z = 4.0
LEAST_EXAMPLES = 3
#: Times by which one rate must exceed the other; long texts have more of every word, but not so much more.
LEAST_RATIO = 3.0
PRIOR_WEIGHT = 0.5
#: Edges of the calibration's score bins.
BINS = 12


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def examples(documents: DataFrame, labels: DataFrame, each: int = EXAMPLES_EACH) -> tuple[list[bytes], np.ndarray, np.ndarray, list]:
    """Texts and labels of the bounded sample, smallest hashed id first, the rows that an example of label 0 and 1 stands for, and doc_ids.

    `each` ids of a label are drawn; where ids repeat, at most twice as many rows.
    """
    own = labels.where("toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = reduce(DataFrame.unionByName, [own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for label in (0, 1)])
    found = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    present = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")]
    # repeated rows of one label must not push out the other label
    bounded = reduce(DataFrame.unionByName, [found.where(F.col("toxic") == label).orderBy(*order).limit(2 * each) for label in (0, 1)])
    rows = bounded.orderBy(*order).select("doc_id", F.col("text").cast("binary").alias("text"), "toxic").collect()
    toxic = np.array([r["toxic"] for r in rows], dtype=np.int64)
    drawn = np.bincount(toxic, minlength=2)
    stands_for = np.array([ids.get(k, 0) / max(min(ids.get(k, 0), each), 1) * present.get(k, 0) / max(drawn[k], 1) for k in (0, 1)])
    return [bytes(r["text"] or b"") for r in rows], toxic, stands_for, [r["doc_id"] for r in rows]


def choose(words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Ascending hashes of the feature words."""
    seen, at = np.unique(np.concatenate([np.empty(0, np.uint64), *words]), return_inverse=True)
    label = np.repeat(toxic, [len(w) for w in words])
    n = np.bincount(at, minlength=len(seen)).astype(float)
    bad = np.bincount(at, weights=label, minlength=len(seen))
    n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    rate = n / (n1 + n0)
    z = (bad / n1 - (n - bad) / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
    one, other = (bad + 0.5) / (n1 + 1), (n - bad + 0.5) / (n0 + 1)
    return seen[(n >= LEAST_EXAMPLES) & (np.abs(z) >= LEAST_Z) & (np.maximum(one / other, other / one) >= LEAST_RATIO)]


def term_rows(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and count of every feature in the texts."""
    if not len(vocabulary):
        return (np.empty(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
    known = vocabulary[at] == words.hashes
    key, n = np.unique(words.doc_of()[known] * len(vocabulary) + at[known], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n


def document_frequencies(documents: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents with each feature, and all documents; both over the whole table."""
    v = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(v.value) + 1, np.int64), 0
        for batch in batches:
            for _, texts in chunks(batch):
                _, term, _ = term_rows(Words(texts, byte_table("alnum-lower")), v.value)
                total[:-1] += np.bincount(term, minlength=len(v.value))
                n += len(texts)
        total[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    rows = documents.select("text").mapInArrow(run, T.StructType().add("term", "long").add("n", "long")).groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


class Index:
    """Unit TF-IDF vectors of the examples that have features, as blocked postings."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, stands_for: np.ndarray | None = None):
        self.vocabulary, self.idf = vocabulary, idf
        doc, term, n = term_rows(Words(texts, byte_table("alnum-lower")), vocabulary)
        has = np.unique(doc)
        bare = np.setdiff1d(np.arange(len(texts)), has)
        rows = np.ones(len(texts)) if stands_for is None else stands_for[toxic]
        rows = rows / max(rows.mean(), 1e-12) if len(texts) else rows
        self.bare = float((rows[bare] @ toxic[bare] + 1e-9) / max(rows[bare].sum(), 1e-9)) if len(bare) else 0.0
        self.toxic, self.stands_for, self.place = toxic[has].astype(np.float64), rows[has], has
        self.prior = float(self.stands_for @ self.toxic / self.stands_for.sum()) if len(has) else self.bare
        doc = np.searchsorted(has, doc)
        weight = self.unit(doc, term, n, len(has))
        order = np.lexsort((doc, term))
        self.doc, self.term, self.weight = doc[order], term[order], weight[order]
        self.blocks = max(-(-len(has) // BLOCK), 1)
        # postings of one feature in one block are a run; `first` finds it
        cell = self.term * self.blocks + self.doc // BLOCK
        self.first = np.searchsorted(cell, np.arange(len(vocabulary) * self.blocks + 1))
        self.most = np.zeros(len(vocabulary) * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(len(vocabulary), self.blocks)
        self.rows = (doc, term, weight)
        self.edges, self.shares = np.array([0.0]), np.array([self.prior])
        self._calibrate(len(has))

    def unit(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
        w = (1 + np.log(np.maximum(n, 1))) * self.idf[term]
        return w / np.maximum(np.sqrt(np.bincount(doc, weights=w * w, minlength=docs))[doc], 1e-12)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines, best first."""
        bound = weight @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score = np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(order), BLOCKS_AT_ONCE):
            some = order[at : at + BLOCKS_AT_ONCE]
            if len(score) >= k and bound[some[0]] < score[k - 1]:
                break
            cell = (term[:, None] * self.blocks + np.sort(some)).ravel()
            first, n = self.first[cell], self.first[cell + 1] - self.first[cell]
            row = np.arange(n.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            found, own = np.unique(self.doc[row], return_inverse=True)
            got = np.bincount(own, weights=self.weight[row] * np.repeat(np.repeat(weight, len(some)), n), minlength=len(found))
            other = found != without
            best, score = np.concatenate((best, found[other])), np.concatenate((score, got[other]))
            top = np.lexsort((best, -score))[:k]
            best, score = best[top], score[top]
        return best, score

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        weight = score * self.stands_for[best]
        return float((weight @ self.toxic[best] + PRIOR_WEIGHT * self.prior) / (weight.sum() + PRIOR_WEIGHT))

    def _calibrate(self, docs: int) -> None:
        """Shares of toxic examples in bins of leave-one-out votes, made to rise by pooling."""
        if not docs:
            return
        doc, term, weight = self.rows
        cut = np.searchsorted(doc, np.arange(docs + 1))
        raw = np.array([self.vote(*self.nearest(term[a:b], weight[a:b], NEIGHBOURS, i)) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))])
        order = np.argsort(raw, kind="stable")
        rows = self.stands_for
        pools = [[float(rows[p] @ raw[p] / rows[p].sum()), float(rows[p] @ self.toxic[p] / rows[p].sum()), float(rows[p].sum())] for p in np.array_split(order, min(BINS, docs)) if len(p)]
        merged: list[list[float]] = []
        for pool in pools:
            merged.append(pool)
            while len(merged) > 1 and merged[-2][1] >= merged[-1][1]:
                (x, p, n), (y, q, m) = merged[-2], merged.pop()
                merged[-1] = [(x * n + y * m) / (n + m), (p * n + q * m) / (n + m), n + m]
        self.edges, self.shares = np.array([m[0] for m in merged]), np.array([m[1] for m in merged])

    def score(self, best: np.ndarray, score: np.ndarray) -> float:
        return float(np.interp(self.vote(best, score), self.edges, self.shares)) if len(best) else self.bare


def scores(documents: DataFrame, labels: DataFrame, each: int = EXAMPLES_EACH, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted, and the neighbours that speak for the score."""
    spark = documents.sparkSession
    ship(spark)
    texts, toxic, stands_for, names = examples(documents, labels, each)
    words = Words(texts, byte_table("alnum-lower"))
    vocabulary = choose([np.unique(words.hashes[a:b]) for a, b in zip(words.first, words.first[1:], strict=False)], toxic) if texts else np.empty(0, np.uint64)
    df, n = document_frequencies(documents, vocabulary)
    named = spark.sparkContext.broadcast(names)
    index = spark.sparkContext.broadcast(Index(texts, toxic, vocabulary, np.log((1 + n) / (1 + df)) + 1, stands_for))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, names = index.value, named.value
        for batch in batches:
            for rows, some in chunks(batch):
                doc, term, n_ = term_rows(Words(some, byte_table("alnum-lower")), ix.vocabulary)
                weight = ix.unit(doc, term, n_, len(some))
                cut = np.searchsorted(doc, np.arange(len(some) + 1)).tolist()
                value, near = [], []
                for a, b in zip(cut, cut[1:], strict=False):
                    best, cosine = ix.nearest(term[a:b], weight[a:b], neighbours) if b > a else (np.empty(0, np.int64), np.empty(0))
                    value.append(ix.score(best, cosine))
                    near.append([{"doc_id": names[ix.place[e]], "toxic": int(ix.toxic[e]), "cosine": round(float(c), 6)} for e, c in zip(best[:3], cosine[:3], strict=True)])
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(value, pa.float64()), pa.array(near, kind)], ["doc_id", "score", "evidence"])

    evidence = T.ArrayType(T.StructType().add("doc_id", "long").add("toxic", "integer").add("cosine", "double"))
    out = documents.select("doc_id", "text").mapInArrow(run, T.StructType([documents.schema["doc_id"]]).add("score", "double").add("evidence", evidence))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
