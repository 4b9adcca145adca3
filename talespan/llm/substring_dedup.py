"""Substring dedup by relative Lempel-Ziv parsing against sharded reference blocks.

Every document is a reference for the documents with larger ids. The reference is indexed in
blocks: a block holds all word windows whose hash falls into its range, with document and place. Each
document's windows are looked up in every block that can hold them and give the least document that
has them; a greedy parse then reads the document from left to right, opens a factor at a window that
an earlier document has, and extends it as long as the next window follows in the same source.
Windows across the boundaries of factors are looked up like all others, so a copied passage of `span`
words is found wherever its sources begin and end. Factors have `span` words at least, with source
and place (`spans()`); they are the duplicate spans, and everything else is literal.

The index travels packed: a batch of documents sends each block one row with its sorted window
hashes. A window that several documents of a batch share is sent once, for the smallest id, and the
others are marked at once; so a passage that a third of all rows holds sends one entry a batch.

Defined results: null or empty text has no words, nothing is removed and the digest is that of the
empty string. Rows with equal doc_id are one place in the order: they never remove each other's words. A
null doc_id comes before all others. Other columns pass through `cut()` unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.llm import planes
from talespan.llm.words import CHUNK_BYTES, FIRST_ID, Words, batched, byte_table, mix, texts_of
from talespan.runtime import ship

SPAN = 13
#: Bytes of text in a batch whose windows are sorted together.
BATCH_BYTES = 10 << 20

_ROW = T.StructType().add("block", "integer").add("data", "binary")
_HITS = T.StructType().add("__talespan_id", "long").add("__talespan_crc", "long").add("__talespan_found", "binary")


def window_hashes(texts: list[bytes], span: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of all texts, and the number of windows of each text."""
    found, counts = [np.empty(0, np.uint64)], []
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            words = Words(texts[at : i + 1], table)
            h, whole = words.shingles(span)
            found.append(h[whole])
            counts.append(np.maximum(np.diff(words.first) - span + 1, 0))
            at, size = i + 1, 0
    return np.concatenate(found), np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64)


Hits = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pack_hits(ids: np.ndarray, crcs: np.ndarray, places: np.ndarray, sources: np.ndarray, source_places: np.ndarray) -> bytes:
    """Found windows of many documents: one entry a document, then all places and where each was found."""
    order = np.lexsort((places, crcs, ids))
    ids, crcs, places, sources, source_places = (x[order] for x in (ids, crcs, places, sources, source_places))
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1]))))
    sizes = np.diff(np.append(first, len(ids)))
    return b"".join([planes.pack(ids[first].view(np.uint64)), planes.pack(crcs[first]), planes.pack(sizes.astype(np.uint32)), pack_places(places, sources, source_places)])


def pack_places(places: np.ndarray, sources: np.ndarray, source_places: np.ndarray) -> bytes:
    """Windows of a copied passage follow each other in both texts, so differences are mostly 0 and 1."""
    return planes.pack(np.diff(places.astype(np.uint32), prepend=np.uint32(0))) + planes.pack_sorted(sources.view(np.uint64)) + planes.pack(np.diff(source_places.astype(np.uint32), prepend=np.uint32(0)))


def unpack_places(data: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places, at = planes.unpack(data, np.uint32, at=at)
    sources, at = planes.unpack_sorted(data, at)
    source_places, _ = planes.unpack(data, np.uint32, at=at)
    return np.cumsum(places, dtype=np.uint32), sources.view(np.int64), np.cumsum(source_places, dtype=np.uint32)


def unpack_hits(data: bytes, at: int = 0) -> Hits:
    ids, at = planes.unpack(data, np.uint64, at=at)
    crcs, at = planes.unpack(data, np.uint32, at=at)
    sizes, at = planes.unpack(data, np.uint32, at=at)
    return np.repeat(ids.view(np.int64), sizes), np.repeat(crcs, sizes), *unpack_places(data, at)


def index_rows(ids: list[int], texts: list[bytes], span: int, blocks: int) -> Iterator[tuple[int, bytes]]:
    """Rows of one batch: (block, entries), and (block, places that the batch itself settles)."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    hashes, counts = window_hashes(texts, span, byte_table("space"))
    crc = np.array([zlib.crc32(t) for t in texts], dtype=np.uint64)
    doc_ids = np.array(ids, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    if not len(hashes):
        return
    sort = np.argsort(hashes, kind="stable").astype(np.uint32)
    hashes = hashes[sort]
    doc = np.repeat(np.arange(len(ids), dtype=np.uint32), counts)[sort]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]  # documents are in order, so the first of equal windows has the least id
    least = doc_ids[doc[lead]]
    settled = doc_ids[doc] > least
    if settled.any():
        which, at, of = doc[settled], sort[settled] - first[doc[settled]].astype(np.uint32), lead[settled]
        yield int(crc.sum() % np.uint64(blocks)), b"\1" + pack_hits(doc_ids[which], crc[which].astype(np.uint32), at, least[settled], sort[of] - first[doc[of]].astype(np.uint32))
    hashes, sort, doc = hashes[~settled], sort[~settled], doc[~settled]
    width = (1 << 64) // blocks + 1
    cut = np.searchsorted(hashes, np.array([b * width for b in range(1, blocks)], dtype=np.uint64))
    for b, (x, y) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(hashes)], strict=True)):
        if y > x:
            held, local = np.unique(doc[x:y], return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(counts[held])))
            place = starts[local] + sort[x:y] - first[doc[x:y]]
            yield b, b"".join([b"\0", planes.pack_sorted(hashes[x:y]), planes.pack(place.astype(np.uint32)), planes.pack(doc_ids[held].view(np.uint64)), planes.pack(crc[held].astype(np.uint32)), planes.pack(counts[held].astype(np.uint32))])


def match_rows(rows: Iterator[bytes]) -> Iterator[Hits]:
    """All that one block found: documents, crcs of their texts, the places of found windows, and the least document that has each, and where."""
    hashes, places, docs, ids, crcs = [], [], [], [], []
    base = 0
    for data in rows:
        if data[0] == 1:
            yield unpack_hits(data, 1)
            continue
        h, at = planes.unpack_sorted(data, 1)
        place, at = planes.unpack(data, np.uint32, at=at)
        i, at = planes.unpack(data, np.uint64, at=at)
        c, at = planes.unpack(data, np.uint32, at=at)
        counts, _ = planes.unpack(data, np.uint32, at=at)
        starts = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
        local = np.searchsorted(starts, place, side="right") - 1
        hashes.append(h)
        places.append((place - starts[local]).astype(np.uint32))
        docs.append((local + base).astype(np.uint32))
        ids.append(i.view(np.int64))
        crcs.append(c)
        base += len(i)
    if not hashes:
        return
    all_ids, all_crcs = np.concatenate(ids), np.concatenate(crcs)
    all_hashes = np.concatenate(hashes)
    del hashes
    sort = np.argsort(all_hashes, kind="stable").astype(np.uint32)
    all_hashes = all_hashes[sort]
    new = np.concatenate(([True], all_hashes[1:] != all_hashes[:-1]))
    del all_hashes
    group = np.flatnonzero(new)
    alone = new & np.concatenate((new[1:], [True]))
    docs = np.concatenate(docs)[sort]
    size = np.diff(np.append(group, len(docs)))
    least = np.repeat(np.minimum.reduceat(all_ids[docs], group), size)
    hit = ~alone & (all_ids[docs] > least)
    places = np.concatenate(places)[sort]
    first_there = np.minimum.reduceat(np.where(all_ids[docs] == least, places, np.uint32(0xFFFFFFFF)), group)
    yield all_ids[docs[hit]], all_crcs[docs[hit]], places[hit], least[hit], np.repeat(first_there, size)[hit]


def found_windows(documents: DataFrame, span: int = SPAN, blocks: int | None = None) -> DataFrame:
    """_id, _crc and _found (packed places): a row for each document with windows of earlier ones.

    Both exchanges move one packed row for each pair of partitions.
    """
    spark = documents.sparkSession
    ship(spark)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batched(batches, BATCH_BYTES):
            for block, data in index_rows(ids, texts, span, n):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for x in match_rows(x.as_py() for batch in batches for x in batch.column(1)) if len(x[0])]
        if found:
            ids, crcs, *where = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = mix(ids.view(np.uint64)) % np.uint64(n)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64)).tolist()
            for b, (x, y) in enumerate(zip(edge, edge[1:], strict=False)):
                if y > x:
                    part = order[x:y]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack_hits(ids[part], crcs[part], *(x[part] for x in where))], pa.binary())], ["block", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack_hits(x.as_py()) for batch in batches for x in batch.column(1)]
        if found:
            ids, crcs, *where = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((where[0], crcs, ids))
            ids, crcs, where = ids[order], crcs[order], [x[order] for x in where]
            edge = np.flatnonzero((ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])) + 1
            starts, ends = [0, *edge.tolist()], [*edge.tolist(), len(ids)]
            for at in range(0, len(starts), 4096):
                some = starts[at : at + 4096]
                packed = [pack_places(*(x[a:b] for x in where)) for a, b in zip(some, ends[at : at + 4096], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(crcs[some].astype(np.int64)), pa.array(packed, pa.binary())], ["__talespan_id", "__talespan_crc", "__talespan_found"])

    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, _ROW)
    found = rows.repartitionById(n, F.col("block")).mapInArrow(match, _ROW)
    return found.repartitionById(n, F.col("block")).mapInArrow(gather, _HITS)


def factors(places: np.ndarray, sources: np.ndarray, source_places: np.ndarray, span: int) -> list[tuple[int, int, int, int]]:
    """The parse: [from, to) of each factor, its source document, and where it begins there.

    A factor opens at the first window that was found and goes on as long as the next window was
    found next in the same source. The windows across a boundary were looked up like all others, so
    neighbouring factors overlap and what they cover has no gap where sources change.
    """
    if not len(places):
        return []
    goes_on = (np.diff(places.astype(np.int64)) == 1) & (sources[1:] == sources[:-1]) & (np.diff(source_places.astype(np.int64)) == 1)
    first = np.concatenate(([0], np.flatnonzero(~goes_on) + 1))
    last = np.append(first[1:], len(places)) - 1
    return list(zip(places[first].tolist(), (places[last].astype(np.int64) + span).tolist(), sources[first].tolist(), source_places[first].tolist(), strict=True))


def parsed(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """Documents with _found: the packed places of all found windows, or null."""
    found = found_windows(documents, span)
    keyed = documents.withColumn("__talespan_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))).withColumn("__talespan_crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return keyed.join(found.hint("shuffle_hash"), ["__talespan_id", "__talespan_crc"], "left")


def _kept(text: bytes, found: bytes | None, span: int) -> tuple[list[bytes], list[bytes]]:
    words = text.split()
    if not found:
        return words, words
    out, at = [], 0
    for a, b, _, _ in factors(*unpack_places(found), span):
        out += words[at:a] if a > at else []
        at = max(at, b)
    return words, out + words[at:]


def spans(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id and its factors: words [start, stop), and the earlier document and the word there that they copy."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column(1).to_pylist():
                own = factors(*unpack_places(found), span) if found else []
                rows.append([{"start": a, "stop": b, "source": None if source == FIRST_ID else source, "source_start": at} for a, b, source, at in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "factors"])

    factor = T.StructType().add("start", "long").add("stop", "long").add("source", "long").add("source_start", "long")
    return parsed(documents.select("doc_id", "text"), span).select("doc_id", "__talespan_found").mapInArrow(run, T.StructType([documents.schema["doc_id"]]).add("factors", T.ArrayType(factor)))


def digests(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest = [], [], []
            for text, found in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, kept = _kept(text or b"", found, span)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([documents.schema["doc_id"]]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return parsed(documents.select("doc_id", "text"), span).select("doc_id", "text", "__talespan_found").mapInArrow(run, schema)


def cut(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """Documents with duplicate spans cut out of their texts; texts without any stay byte for byte."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            if batch.column("__talespan_found").null_count < batch.num_rows:
                texts = column.to_pylist()
                for i, found in enumerate(batch.column("__talespan_found").to_pylist()):
                    if found:
                        texts[i] = b" ".join(_kept(texts[i].encode(), found, span)[1]).decode()
                column = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([column if n == "text" else batch.column(n) for n in names], names)

    return parsed(documents, span).select(*names, "__talespan_found").mapInArrow(run, documents.schema)
