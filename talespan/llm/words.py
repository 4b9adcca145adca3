"""Words, word hashes and shingle hashes of many texts at once, in numpy, inside Spark tasks.

Texts are handled as UTF-8 bytes. A byte table says which bytes separate words and folds ASCII
capitals where asked; every byte of a character beyond ASCII is part of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A sub-batch holds about this many bytes of text, so that a task's arrays stay small.
CHUNK_BYTES = 2 << 20
#: Bytes of one text that are hashed at a time.
BLOCK_BYTES = 2 << 20


def byte_table(keep: str) -> np.ndarray:
    """keep: "space" (words end at ASCII white space), "space-lower" (the same, A-Z folded) or
    "alnum-lower" (words are ASCII letters and digits and all beyond ASCII, A-Z folded)."""
    table = np.arange(256, dtype=np.uint8)
    if keep == "alnum-lower":
        code = np.arange(256)
        word = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)) | (code >= 128)
        table[~word] = 32
    else:
        table[9:14] = 32
    if keep != "space":
        table[65:91] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_BYTE_CODE[32] = 0
_BASE = 0xD1342543DE82EF95
#: Odd factors for the places of a shingle's words, without any simple relation to each other.
PLACE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1000)) * _STEP) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    if which not in _powers or len(_powers[which]) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def _hash_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of folded bytes; the last byte is a gap."""
    gap = data == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[data] * _power("up", len(data)), out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * _power("down", len(data) + 1)[starts])


class Words:
    """Hashes of all words of some texts; words of text i are first[i]:first[i + 1]."""

    __slots__ = ("hashes", "first", "starts", "ends", "data")

    def __init__(self, texts: list[bytes | None], table: np.ndarray):
        joined = b" ".join(t or b"" for t in texts) + b" "
        self.data = data = table[np.frombuffer(joined, dtype=np.uint8)]
        starts, ends, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        at = 0
        while at < len(data):  # a long text is hashed in blocks that end between words
            stop = min(at + BLOCK_BYTES, len(data))
            while stop < len(data) and data[stop - 1] != 32:
                more = np.flatnonzero(data[stop : stop + BLOCK_BYTES] == 32)
                stop = stop + int(more[0]) + 1 if len(more) else min(stop + BLOCK_BYTES, len(data))
            for out, part in zip((starts, ends, hashes), _hash_block(data[at:stop]), strict=True):
                out.append(part + at if out is not hashes else part)
            at = stop
        self.starts, self.ends, self.hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes))))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of k words from each word on, and whether they all lie in one text."""
        h, n = self.hashes, len(self.hashes)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        size = n - k + 1
        for j in range(k):
            out[:size] += h[j : j + size] * PLACE[j]
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mix(out), np.arange(n) + k <= last

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a record batch with about limit bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, done + limit)), at) + 1
        part = batch.slice(at, stop - at)
        yield part, texts_of(part.column(column))
        at = stop


#: Stands for a null id, before all others.
FIRST_ID = -(1 << 63)


def batched(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of (id, text) batches, anew in batches of about limit bytes of text; null texts are empty.

    Texts become bytes slice by slice, so that a large batch is never held twice.
    """
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for part, some in chunks(batch):
            for i, t in zip(part.column(0).to_pylist(), some, strict=True):
                ids.append(FIRST_ID if i is None else i)
                texts.append(t or b"")
                size += len(texts[-1]) + 1
                if size >= limit:
                    yield np.array(ids, dtype=np.int64), texts
                    ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), texts
