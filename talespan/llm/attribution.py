"""Offset-mapped token counts: whole documents are encoded once, tokens are joined to sections.

A section is a line of the text: it starts after a line feed and ends with its own line feed. Tokens
are character intervals; they are joined to the sections by their start (a sorted search, as both
sides are ordered). A token that crosses a boundary is given by an explicit rule: to the section
that holds most of its characters, on a tie to the earlier one ("most"), or to the section of its
first ("first") or last character ("last").

Defined results: null and empty texts have one empty section without tokens. Tokens of an empty
interval (parts of one character beyond the first) belong to the section of their start. Every row
is counted by itself, repeated rows too; other columns pass through `counts(..., keep=...)`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talespan.llm.tokens import encoder
from talespan.llm.words import chunks
from talespan.runtime import ship

#: Pieces that the encoder keeps; each has an array of offsets.
CACHE_PIECES = 200_000
RULES = ("most", "first", "last")


def section_starts(text: str) -> np.ndarray:
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, dtype=np.int64)


def allocate(spans: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and the number of tokens of each section that cross its end."""
    first = np.searchsorted(starts, spans[:, 0], side="right") - 1
    last = np.maximum(np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1, first)
    cross = np.flatnonzero(last > first)
    owner = first if rule != "last" else last
    if rule == "most" and len(cross):
        owner = owner.copy()
        ends = np.append(starts[1:], length)
        for t in cross.tolist():
            within = range(int(first[t]), int(last[t]) + 1)
            owner[t] = max(within, key=lambda s: (min(ends[s], spans[t, 1]) - max(starts[s], spans[t, 0]), -s))
    return owner, np.bincount(first[cross], minlength=len(starts))


def counts(documents: DataFrame, tokenizer: str, rule: str = "most") -> DataFrame:
    """doc_id, section, start, stop, n_tokens and n_crossing of every section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, with_offsets=True, cache_pieces=CACHE_PIECES)
        for batch in batches:
            for rows, _ in chunks(batch):
                texts = rows.column(1).to_pylist()
                out = []
                for text, spans in zip(texts, encode.offsets(texts), strict=True):
                    text = text or ""
                    starts = section_starts(text)
                    owner, crossing = allocate(spans, starts, len(text), rule)
                    out.append((starts, np.append(starts[1:], len(text)), np.bincount(owner, minlength=len(starts)), crossing))
                sizes = [len(o[0]) for o in out]
                docs = rows.column(0).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
                number = np.concatenate([np.arange(s) for s in sizes])
                cols = [np.concatenate([o[k] for o in out]).astype(np.int64) for k in range(4)]
                yield pa.RecordBatch.from_arrays([docs, *map(pa.array, [number.astype(np.int64), *cols])], ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    schema = T.StructType([documents.schema["doc_id"]])
    for name in ("section", "start", "stop", "n_tokens", "n_crossing"):
        schema = schema.add(name, "long")
    return documents.select("doc_id", "text").mapInArrow(run, schema)
