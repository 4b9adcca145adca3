"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words and put into suffix automata over word numbers, one for each
block of items; tasks make them from the words' hashes, which are broadcast up to a checked bound. Training
texts are streamed through one after the other; an automaton gives, at every word, the length of the longest match
with any of its items. A match of at least `span` words marks the last `span` words as hit; an item with
fewer words than `span` marks an occurrence of the whole item.

Defined results: null text and empty text have no words and are never contaminated; null items and
items without words are ignored; repeated item rows count once for each item id, items with equal
words count each under its id; a null item id is named "null". Every document row gives one row,
repeated rows too. Columns of the documents with other names pass through `clean()` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talespan.llm.words import CHUNK_BYTES, Words, byte_table, chunks
from talespan.runtime import materialize, ship

SPAN = 13
#: Share of hit words, in percent, from which a document counts as contaminated.
COVERAGE_PERCENT = 5
#: Words of items in one automaton. Texts pass the automata of a larger benchmark one after the other, a task holds one.
BLOCK_WORDS = 50_000
#: Words of all items together; their hashes are broadcast, eight bytes each. More are an error.
MAX_WORDS = 8_000_000
#: Bytes of texts that pass all automata together where there are several.
PASS_BYTES = 16 << 20
_ADDED = ["__talespan_n_words", "__talespan_spans", "__talespan_items"]


class SuffixAutomaton:
    """All substrings of all items; a state knows its items once `finish()` was called."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        self.ends: list[dict[int, set[int]]] = [{}]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, state: int, child: int, token: int) -> int:
        """The state for the child's strings of at most one word more than the state's."""
        if self.length[child] == self.length[state] + 1:
            return child
        copy = self._new(self.length[state] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while state >= 0 and self.next[state].get(token) == child:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return self._split(last, known, token)
        state = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, self.next[at][token], token)
        return state

    def add(self, item: int, tokens: list[int]) -> None:
        last = 0
        for token in tokens:
            last = self._extend(last, token)
            self.items[last].add(item)

    def end(self, item: int, tokens: list[int]) -> None:
        """The whole of a short item counts as a window."""
        state = 0
        for token in tokens:
            state = self.next[state][token]
        self.ends[state].setdefault(len(tokens), set()).add(item)

    def finish(self) -> None:
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0:
                self.items[self.link[state]] |= self.items[state]
        # whole short items that end where this state's strings end
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in order:
            own = tuple((n, item) for n, items in self.ends[state].items() for item in items)
            self.short[state] = self.short[self.link[state]] + own

    def scan(self, tokens: list[int], span: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges [from, to) and the items with a window in the tokens."""
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        state = length = 0
        nexts, link, lengths, short = self.next, self.link, self.length, self.short
        for i, token in enumerate(tokens):
            while state and token not in nexts[state]:
                state = link[state]
                length = lengths[state]
            state = nexts[state].get(token, 0)
            length = length + 1 if state else 0
            if length >= span:
                at = state
                while lengths[link[at]] >= span:
                    at = link[at]
                items |= self.items[at]
                ranges.append((i + 1 - span, i + 1))
            for n, item in short[state]:
                if n <= length:
                    items.add(item)
                    ranges.append((i + 1 - n, i + 1))
        return ranges, items


class Index:
    """A block of items, given by the hashes of their words: word numbers by hash, the automaton, and the item ids."""

    def __init__(self, items: list[tuple[str, np.ndarray]], span: int):
        hashes = [h for _, h in items]
        self.vocabulary, numbers = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_inverse=True)
        self.ids, self.least, self.automaton = [i for i, _ in items], span, SuffixAutomaton()
        streams = [x.tolist() for x in np.split(numbers, np.cumsum([len(h) for h in hashes])[:-1])] if items else []
        for i, s in enumerate(streams):
            self.automaton.add(i, s)
        for i, s in enumerate(streams):
            if 0 < len(s) < span:
                self.automaton.end(i, s)
                self.least = min(self.least, len(s))
        self.automaton.finish()

    def scan(self, hashes: np.ndarray, span: int) -> tuple[list[tuple[int, int]], set[str]]:
        """Only runs of words that items have, as long as the shortest window, reach the automaton."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        ranges, items = [], set()
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.least:
                found, which = self.automaton.scan(at[a:b].tolist(), span)
                ranges += [(a + x, a + y) for x, y in found]
                items |= {self.ids[i] for i in which}
        return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Blocks:
    """All items' word hashes in blocks of bounded size, to be broadcast; automata are made where texts are."""

    def __init__(self, items: Iterator[tuple[str, np.ndarray]], span: int, block_words: int):
        self.blocks: list[list[tuple[str, np.ndarray]]] = [[]]
        size = 0
        for item, hashes in items:
            # pieces of a very long item share what a window needs
            most = max(block_words, 2 * span)
            cuts = range(0, max(len(hashes) - span + 1, 1), most) if len(hashes) > most else range(1)
            for at in cuts:
                piece = hashes[at : at + most + span - 1] if len(hashes) > most else hashes
                if size and size + len(piece) > block_words:
                    self.blocks.append([])
                    size = 0
                self.blocks[-1].append((item, piece))
                size += len(piece)
        self.span, self.kept = span, None

    def automata(self) -> Iterator[Index]:
        """One after the other; a single one is made once in a worker."""
        if len(self.blocks) > 1:
            for block in self.blocks:
                yield Index(block, self.span)
            return
        if self.kept is None:
            self.kept = Index(self.blocks[0], self.span)
        yield self.kept

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": None}

    @property
    def pass_bytes(self) -> int:
        return PASS_BYTES if len(self.blocks) > 1 else CHUNK_BYTES


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, words): the hashes of the words of every different item that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table("alnum-lower")
        for batch in batches:
            for rows, texts in chunks(batch):
                words = Words(texts, table)
                own = [words.hashes[words.first[i] : words.first[i + 1]].tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own, pa.binary())], ["item", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null").distinct()
    return rows.mapInArrow(run, "item string, words binary").where("octet_length(words) > 0")


def _found(blocks: Blocks, words: Words, texts: int) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Number of words, merged hit ranges and item ids of each text."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(texts)]
    items: list[set[str]] = [set() for _ in range(texts)]
    for index in blocks.automata():
        for i in range(texts):
            r, f = index.scan(words.hashes[words.first[i] : words.first[i + 1]], blocks.span)
            ranges[i] += r
            items[i] |= f
    for i in range(texts):
        yield int(words.first[i + 1] - words.first[i]), merged(ranges[i]), sorted(items[i])


def _broadcast(documents: DataFrame, benchmark: DataFrame, span: int, block_words: int) -> Broadcast:
    spark = documents.sparkSession
    ship(spark)
    items = materialize(item_words(benchmark))
    total = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 8
    if total > MAX_WORDS:
        raise ValueError(f"the benchmark has {total} words; {MAX_WORDS} are the limit, clean against parts of it one after the other")
    return spark.sparkContext.broadcast(Blocks(((r["item"], np.frombuffer(bytes(r["words"]), np.uint64)) for r in items.toLocalIterator()), span, block_words))


def scan(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with their number of words, spans (hit word ranges) and items (ids found).

    The hashes of the items' words are broadcast, at most MAX_WORDS of them; a map over the documents needs no shuffle.
    """
    blocks = _broadcast(documents, benchmark, span, block_words)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table("alnum-lower")
        for batch in batches:
            for rows, texts in chunks(batch, limit=blocks.value.pass_bytes):
                found = list(_found(blocks.value, Words(texts, table), len(texts)))
                added = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in r] for _, r, _ in found], spans), pa.array([i for _, _, i in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, *_ADDED])

    span_type = T.StructType().add("start", "long").add("stop", "long")
    added = [T.LongType(), T.ArrayType(span_type), T.ArrayType(T.StringType())]
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *(T.StructField(n, t) for n, t in zip(_ADDED, added, strict=True))]))


def verdicts(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, coverage_percent: int = COVERAGE_PERCENT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the item ids themselves."""
    found = scan(documents.select("doc_id", "text"), benchmark, span)
    n_hit = F.aggregate("__talespan_spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", F.col("__talespan_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__talespan_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__talespan_items"), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 100 >= F.col("__talespan_n_words") * coverage_percent)).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, coverage_percent: int = COVERAGE_PERCENT) -> DataFrame:
    """Documents without contaminated ones; shorter hit spans are cut out of the others' texts.

    A text without hits stays as it is, byte for byte. A cut takes the bytes from the first word of
    a span to the last.
    """
    blocks = _broadcast(documents, benchmark, span, BLOCK_WORDS)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table("alnum-lower")
        for batch in batches:
            for rows, texts in chunks(batch, limit=blocks.value.pass_bytes):
                words, keep, changed = Words(texts, table), [], {}
                for i, (n, hit, _) in enumerate(_found(blocks.value, words, len(texts))):
                    n_hit = sum(b - a for a, b in hit)
                    keep.append(not hit or 100 * n_hit < coverage_percent * n)
                    if hit and keep[-1]:
                        changed[i] = _without(texts[i], Words([texts[i]], table), hit)
                column = rows.column("text")
                if changed:
                    column = pa.array([changed.get(i, t) for i, t in enumerate(column.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([column if n == "text" else rows.column(n) for n in names], names).filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def _without(raw: bytes, words: Words, hit: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each range."""
    out, at = [], 0
    for a, b in hit:
        out.append(raw[at : words.starts[a]])
        at = int(words.ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()
