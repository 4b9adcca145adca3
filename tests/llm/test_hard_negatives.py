"""Mined negatives against all pairs, over several shards, with ties, nulls, repeated rows and clashing columns."""

import math
import random

import numpy as np
import pytest

from talespan.llm import hard_negatives

NAMES = "vec_id long, embedding array<float>, label int, row long, cell int, shard int, vector string"


def brute(rows, every=100):
    """Rows are (vec_id, vector, label); identity is the place in the list."""
    v = []
    for i, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, [max(min(math.floor(256 * float(c)), 1 << 26), -(1 << 26)) for c in x], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    first = lambda i: -(1 << 63) if i is None else i
    for a, (i, x, label) in enumerate(v):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), first(j), j, m) for b, (j, y, m) in enumerate(v) if b != a), key=lambda r: r[:2])
        for s, _, j, _ in [r for r in scored if r[3] == label][:5]:
            below = [r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, k, r[2], -s, -r[0]) for k, r in enumerate(below, 1)]
    return sorted(out, key=str)


def table(spark, rows, cut=3):
    return spark.createDataFrame([(*r, 5, 6, 7, "clash") for r in rows], NAMES).repartition(cut)


def clustered(rng, n, dim=8):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        x = [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)]
        rows.append((i, x, rng.randrange(4)))
    return rows


@pytest.mark.parametrize("shard_rows", [1 << 16, 40])
def test_mined(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 1)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard_rows)
    rng = random.Random(4)
    rows = clustered(rng, 700)
    same = rows[50][1]
    rows += [(800 + i, same, i % 2) for i in range(120)]  # a vector of many rows, in one cell
    rows += [(None, rows[9][1], 1), (None, rows[9][1], 1), (300, rows[300][1], rows[300][2]), (300, rows[300][1], rows[300][2]), (7, rows[7][1], 2), (-200, rows[2][1], 1), (-7, rows[3][1], 9)]
    rows += [(1000, None, 1), (1100, rows[0][1], None), (1200, [1.0, None] + [0.0] * 6, 1), (1300, [float("nan")] * 8, 1), (1400, [float("inf")] * 8, 1), (1500, [1.0, 2.0, 3.0], 1), (1600, [], 2), (1700, [0.0] * 8, 3), (1701, [1e30, -1e30] + [0.0] * 6, 3), (1800, [1e30] + [0.0] * 7, 3)]
    got = sorted((tuple(r) for r in hard_negatives.mined(table(spark, rows)).collect()), key=str)
    assert got and got == brute(rows)


def test_few_rows_and_none(spark):
    one = [(0, [1.0, 0.5], 1)]
    assert hard_negatives.mined(table(spark, one)).collect() == []
    assert hard_negatives.mined(table(spark, one).limit(0)).collect() == []
    few = [*one, (1, [1.0, 0.5], 2), (2, [0.9, 0.5], 2), (3, [1.0, 0.4], 1), (4, [-1.0, -1.0], 2)]
    assert [tuple(r) for r in hard_negatives.mined(table(spark, few, 1)).collect()] == brute(few) != []


def test_search_stops_early_and_cells_come_in_order():
    rng = random.Random(6)
    points = np.floor(256 * np.array([x for _, x, _ in clustered(rng, 2000, 16)]))
    codes = hard_negatives.codebook(points[:, :8], 8), hard_negatives.codebook(points[:, 8:], 8)
    index = hard_negatives.Index(16, codes)
    of = [hard_negatives._nearest(points[:, a:b], c) for (a, b), c in zip(((0, 8), (8, 16)), codes)]
    far = [np.sqrt(((points[:, a:b] - c[o]) ** 2).sum(1)) for (a, b), c, o in zip(((0, 8), (8, 16)), codes, of)]
    cell = of[0] * 8 + of[1]
    index.lay([(int(c), int((cell == c).sum()), far[0][cell == c].max(), far[1][cell == c].max()) for c in np.unique(cell)], len(points))
    shard = hard_negatives.Shard(index, np.arange(2000), np.arange(2000), np.arange(2000) % 3, cell, points)
    seen = []
    scores = shard.scores
    shard.scores = lambda q, at: (seen.append(len(at)), scores(q, at))[1]
    for i in range(0, 2000, 97):
        cells = list(shard.cells(points[i]))
        bounds = [b for b, _, _ in cells]
        assert bounds == sorted(bounds, reverse=True) and sum(b - a for _, a, b in cells) == 2000
        got = shard.search(i, i % 3, points[i], [(None, None)])
        want = sorted((-int(points[i] @ points[j]), j) for j in range(i % 3, 2000, 3) if j != i)[:5]
        assert [(-s, j) for _, s, j in got] == want
        assert all((points[shard.rows[a:b]] @ points[i]).max() <= bound for bound, a, b in cells)
    assert sum(seen) < 0.7 * 2000 * len(range(0, 2000, 97))
