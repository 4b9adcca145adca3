"""The source mix: targets and flow against plain searches, selection by its rules, edge cases, reruns."""

import random
import re
from collections import defaultdict
from itertools import product

import pytest

from talespan.llm import mixture

DOCS = "doc_id long, text string, lang string, source string, n_chars long, members string, size double, target string, taken int, unit int"


def plain_targets(sizes, total, weights=(5.0, 2.0, 1.0), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def check_rules(rows, want_sizes):
    """rows: (doc_id, source, size, source_size, target, taken)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    targets = plain_targets({s: sum(r[2] for r in rs) for s, rs in by.items()}, sum(r[2] for r in rows))
    assert sorted(((r[0] is None, r[0] or 0), r[2]) for r in rows) == sorted(((d is None, d or 0), n) for d, n in want_sizes)
    for s, rs in by.items():
        assert {r[3] for r in rs} == {sum(r[2] for r in rs)}
        assert all(r[4] == pytest.approx(targets[s]) for r in rs)
        times = {r[5] // r[2] for r in rs if r[2]}
        assert all(r[5] % r[2] == 0 for r in rs if r[2]) and all(r[5] == 0 for r in rs if not r[2])
        assert not times or (max(times) - min(times) <= 1 and max(times) <= 3)
        short = targets[s] - sum(r[5] for r in rs)
        spare = [r[2] for r in rs if r[2] and r[5] // r[2] == min(times) and min(times) < 3]
        assert not spare or abs(short) <= max(min(spare), 1) / 2 + 1 or abs(short) <= max(r[2] for r in rs) / 2 + 1


def corpus():
    rng, rows = random.Random(8), []
    for i in range(400):
        rows.append((i, "w " * rng.choice((0, 1, 3, 20, 200, 900)), rng.choice(["b", "a", "a", "a", "é", "Z", None, "", "c"])))
    rows += [(7, "again and again", "a")] * 60 + [(None, "no id", "b"), (None, None, "b"), (5, None, None), (6, "", "only empty"), (1000, "x" * 300_000 + " y\x0b z\n", "a"), (1001, "one", "tiny"), (1002, "m " * 30_000, "c")]
    rng.shuffle(rows)
    return rows


def test_mix(spark):
    rows = corpus()
    frame = spark.createDataFrame([(d, t, "en", s, 1, "clash", 0.5, "clash", 3, 4) for d, t, s in rows], DOCS)
    got = sorted(map(tuple, mixture.by_source(frame.repartition(3)).collect()), key=str)
    check_rules(got, [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _ in rows])
    assert got == sorted(map(tuple, mixture.by_source(frame.orderBy("n_chars", "text").repartition(7)).collect()), key=str)
    assert got != sorted(map(tuple, mixture.by_source(frame, seed=21).collect()), key=str)


def test_copies_beyond_a_task(spark, monkeypatch):
    monkeypatch.setattr(mixture, "CHUNK_COPIES", 7)
    monkeypatch.setattr(mixture, "BUCKET_UNITS", 4)
    rows = [(1, "a b c", "s")] * 40 + [(2, "a b", "t")] * 3 + [(i, "w " * i, "t") for i in range(3, 30)]
    got = [tuple(r) for r in mixture.by_source(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    check_rules(got, [(d, len(t.split())) for d, t, _ in rows])


def test_empty(spark):
    frame = spark.createDataFrame([], DOCS)
    assert mixture.by_source(frame).collect() == []
    nothing = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixture.by_source(nothing).collect())) == [(1, "s", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]


def test_overlapping_sources(spark):
    rows = [(i, m, 10) for i, m in enumerate([["a"]] * 10 + [["a", "b"]] * 20 + [["b", "a", "b"]] * 10 + [["c"]] * 5 + [["c", None]] * 5 + [[]] * 2 + [None] * 2)]
    out, sources = mixture.mixed(spark.createDataFrame(rows, "doc_id long, members array<string>, size long"))
    table = {r["source"]: r for r in sources.collect()}
    want = plain_targets({"a": 400, "b": 300, "c": 100, None: 70}, sum(n for _, m, n in rows))
    assert {s: r["target"] for s, r in table.items()} == pytest.approx(want)
    taken = {r["doc_id"]: r["taken"] for r in out.collect()}
    assert len(taken) == len(rows) and taken[50] == taken[51] == 0
    assert sum(taken.values()) == pytest.approx(sum(r["flow"] for r in table.values()), abs=25)
    assert max(taken.values()) <= 30


def test_flow_is_the_cheapest(spark):
    rng = random.Random(3)
    for _ in range(60):
        patterns, quotas = {p: rng.randrange(3) for p in range(3)}, {s: rng.randrange(5) for s in range(2)}
        edges = [(p, s) for p in patterns for s in quotas if rng.random() < 0.7]
        if not edges:
            continue
        best = None
        for flow in product(range(5), repeat=len(edges)):
            out, into = defaultdict(int), defaultdict(int)
            for (p, s), n in zip(edges, flow):
                out[p] += n
                into[s] += n
            if all(out[p] <= 3 * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
                cost = sum(mixture.COSTS[k // patterns[p]] for p in patterns for k in range(out[p]))
                best = min(best, (-sum(flow), cost)) if best else (-sum(flow), cost)
        got = mixture.cheapest_flow(patterns, quotas, edges)
        out = defaultdict(int)
        for (p, _), n in got.items():
            out[p] += n
        assert (-sum(got.values()), sum(mixture.COSTS[k // patterns[p]] for p in patterns for k in range(out[p]))) == best
