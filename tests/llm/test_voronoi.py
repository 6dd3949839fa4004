"""Voronoi join: against brute force on odd, hot and clustered vectors."""

import math

import numpy as np
import pytest

from feedlens.llm import voronoi

SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell int, score string, v string, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 7, "y", "z", 3) for i, v in rows], SCHEMA)


def model(rows, k=10, every=100):
    part = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(part):
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for j, (i, b) in enumerate(part) if j != at)
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(spark, rows, **options):
    return sorted(map(tuple, voronoi.search(spark, table(spark, rows), **options).collect()), key=str)


def test_equals_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(350)]
    rows += [(400, None), (401, [None, 1.0] + [0.0] * 6), (402, [float("nan")] * 8), (500, [float("inf")] + [0.0] * 7), (None, [9.0] * 8),
             (600, []), (700, [3.0, -2.0]), (800, [0.0] * 8), (100, rows[5][1]), (0, rows[0][1]), (351, rows[9][1]), (352, rows[9][1])]
    assert found(spark, rows) == model(rows)
    assert found(spark, rows, k=3, every=7, pivots=9) == model(rows, 3, 7)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [-1.0, 0.0])]
    assert found(spark, rows) == model(rows) and len(found(spark, rows)) == 4
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_hot_vector_and_ties(spark):
    rng = np.random.default_rng(2)
    copy = rng.normal(size=6).tolist()
    rows = [(i, copy if i % 3 == 0 else rng.normal(size=6).tolist()) for i in range(900)]
    assert found(spark, rows) == model(rows)


def test_large_integers_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 50, [float(x) for x in rng.integers(-(1 << 17), 1 << 17, 5)]) for i in range(60)]
    assert found(spark, rows) == model(rows)


def test_only_necessary_data_is_replicated(spark, monkeypatch):
    """Well separated clusters: exact, and each query needs few of the cells."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(1200)]
    result, queries = voronoi.joined(spark, table(spark, rows), every=10, pivots=12)
    assert sorted(map(tuple, result.collect()), key=str) == model(rows, every=10)
    sizes = [len(r["cells"]) for r in queries.collect()]
    assert len(sizes) == 120 and np.mean(sizes) < 4


@pytest.mark.parametrize("block, group", [(16, 4), (50, 1000)])
def test_blocks_and_groups_of_any_size(spark, monkeypatch, block, group):
    monkeypatch.setattr(voronoi, "BLOCK", block)
    monkeypatch.setattr(voronoi, "GROUP", group)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + (3 if i % 3 else 0)).tolist()) for i in range(500)]
    assert found(spark, rows, every=20, pivots=5) == model(rows, every=20)


def test_bounds_never_exclude_a_better_row():
    rng = np.random.default_rng(6)
    data, q = np.floor(rng.normal(size=(500, 4)) * 1000), np.floor(rng.normal(size=(40, 4)) * 1000)
    cells = voronoi.Cells(voronoi.fitted(data, 20))
    far = voronoi.distances(data, cells.pivots)
    cell = far.argmin(axis=1)
    near = far[np.arange(500), cell]
    norms = np.sqrt((data ** 2).sum(axis=1))
    cells.summarised([{"cell": j, "rows": int((cell == j).sum()), "queries": 1, "least": near[cell == j].min(), "most": near[cell == j].max(),
                       "norm": norms[cell == j].max()} for j in np.unique(cell)])
    score = q @ data.T
    least = np.sort(score, axis=1)[:, -10]
    need = cells.necessary(q, np.sqrt((q ** 2).sum(axis=1)), least)
    for i in range(40):
        assert need[i, cell[score[i] >= least[i]]].all()
    assert not need.all()
