"""Embedding near-duplicates against all pairs; recall of the index."""

import math
import random

import numpy as np

from tidewell.llm import embed_dup
from tidewell.llm.embed_dup import MultiIndex, multi_sequence, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label string, node int, unit string"


def brute(rows, threshold=0.95):
    dim = max([len(e) for _, e in rows if e] + [1])
    units = []
    for _, e in rows:
        ok = e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        v = np.array([*e, *[0.0] * (dim - len(e))], np.float64) if ok else None
        units.append(v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) if ok else None)
    parent = list(range(len(rows)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and None not in (rows[i][0], rows[j][0]) and units[i] is not None and units[j] is not None and units[i] @ units[j] >= threshold:
                links[i] += 1
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return sorted([(r[0], links[i], rows[find(i)][0]) for i, r in enumerate(rows)], key=repr)


def vectors(rng, n):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            e = [x + rng.gauss(0, rng.choice([0, 0.05, 0.3])) for x in rng.choice(rows)[1]]
        else:
            e = [rng.gauss(0, 1) for _ in range(9)]
        rows.append((i * 13 % 1999, [float(np.float32(x)) for x in e]))
    return rows


def test_against_all_pairs(spark):
    rng = random.Random(4)
    rows = vectors(rng, 400)
    odd = [(5000, None), (5001, []), (5002, [0.0] * 9), (5003, [float("nan")] * 9), (5004, [float("inf"), *[1.0] * 8]), (5005, [None, *[1.0] * 8]), (None, rows[0][1]), (5006, rows[0][1]), (5006, rows[0][1]), (5007, [1e-30] * 9), (5008, [1e30] * 9), (5009, [1.0, 0.0]), (5010, [2.0]), (5011, [-1.0, 0.0])]
    odd = [(k, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for k, e in odd]
    df = spark.createDataFrame([(k, e, None, 1, "clash") for k, e in rows + odd], SCHEMA).repartition(3)
    got = near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    out = got.collect()
    assert sorted([tuple(r)[:3] for r in out], key=repr) == brute(rows + odd)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)
    assert near_vectors(df.limit(0)).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    got = list(multi_sequence(a, b))
    assert len(set(got)) == 35
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums)


def test_recall_of_index():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32))
    x[3000:] = x[:3000] + rng.normal(size=(3000, 32)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = MultiIndex(x, 60_000, 0.95, 0.99)
    assert 1 < index.visits < len(index.books[0]) * len(index.books[1])
    home = index.cell(*index.codes(x))
    met = total = 0
    for q, cells in enumerate(index.visited(x[:1500])):
        near = np.flatnonzero(x[q] @ x.T >= 0.95)
        near = near[near != q]
        assert home[q] in cells
        total += len(near)
        met += np.isin(home[near], cells).sum()
    assert total > 200 and met / total >= 0.9


def test_links_that_one_side_finds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(embed_dup, "CELL", 4)
    monkeypatch.setattr(MultiIndex, "_calibrate", lambda self, *a: made.append(self) or 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[200:] = x[:200] + rng.normal(size=(200, 8)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(400) * 3
    rows = [(int(k), v.tolist(), 1 + int(k) % 2) for k, v in zip(ids, x)]
    df = spark.createDataFrame([(k + c, v) for k, v, n in rows for c in range(n)], "vec_id long, embedding array<double>").repartition(3)
    out = {r.vec_id: r for r in near_vectors(df).collect()}
    (index,) = made
    home, cells = index.cell(*index.codes(x)), index.visited(x)
    near = (x @ x.T >= 0.95) & ~np.eye(400, dtype=bool)
    finds = near & np.array([[h in c for h in home] for c in cells])
    assert (finds & ~finds.T).sum() > 10
    both = finds | finds.T
    weight = np.array([n for _, _, n in rows])
    least = ids.copy()
    for _ in range(400):
        least = np.minimum(least, np.where(both, least[None], 1 << 40).min(1))
    for (k, _, n), links, c in zip(rows, both @ weight + weight - 1, least):
        for copy in range(n):
            assert (out[k + copy].n_links, out[k + copy].component_id, out[k + copy].kept) == (links, c, k + copy == c)


def test_recall_where_neighbours_differ_in_few_directions():
    rng = np.random.default_rng(6)
    spread = np.where(np.arange(64) % 32 < 3, 1.0, 0.02)
    x = rng.normal(size=(8000, 64)) * spread
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = MultiIndex(x, 200_000, 0.95, 0.999)
    y = x[:2000]
    side = rng.normal(size=y.shape) * spread
    side -= (side * y).sum(1)[:, None] * y
    side /= np.linalg.norm(side, axis=1)[:, None]
    home = index.cell(*index.codes(0.95 * y + math.sqrt(1 - 0.95**2) * side))
    assert np.mean([h in c for h, c in zip(home, index.visited(y))]) >= 0.995
