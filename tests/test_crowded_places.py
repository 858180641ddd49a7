"""Neighbours where many points share few places: at ties, with any bound, and without comparing all of them."""

import numpy as np
import pytest

from krigstone.operators import neighbors, tree

from test_graph import plain_neighbors, points_of, searched


def crowded(n, d, seed=3):
    """Half of the points at a few places of a grid, the others once or twice on a finer one."""
    rng = np.random.default_rng(seed)
    few, many = rng.integers(0, 2, (n // 2, d)), rng.integers(0, 24, (n - n // 2, d)) / 8 - 1
    return rng.permutation(np.concatenate([few.astype(float), many]))


def asked_of(spark, n, seed=4):
    rng = np.random.default_rng(seed)
    pairs = sorted({(int(q), int(b)) for q, b in zip(rng.integers(0, n, 300), rng.integers(1, n + 1, 300), strict=True)} | {(q, q) for q in range(12, n)})
    return pairs, spark.createDataFrame(pairs, "query long, bound long")


@pytest.mark.parametrize("tile,ties,d", [(12, "least", 2), (12, "met", 2), (3, "least", 2), (3, "met", 2), (3, "met", 3)])
def test_crowded_places(spark, monkeypatch, tile, ties, d):
    monkeypatch.setattr(neighbors, "TILE", tile)
    monkeypatch.setattr(neighbors, "GROUP", 40)
    n, k = 260, 4
    built = tree.build_tree(points_of(spark, crowded(n, d)))
    rows = built.orderBy("node").collect()
    x, split = np.array([[r[f"x{i}"] for i in range(d)] for r in rows]), [r["split_dim"] for r in rows]
    pairs, asked = asked_of(spark, n)
    found = {}
    for r in neighbors.query_neighbors(built, asked, k, ties=ties).orderBy("query", "bound", "slot").collect():
        found.setdefault((r["query"], r["bound"]), []).append((r["nb"], r["d2"]))
    assert sorted(found) == pairs
    for q, b in pairs:
        want = plain_neighbors(x, b, q, k) if ties == "least" else [(m, d2) for d2, m in searched(x, split, b, q, k)]
        assert found[q, b] == want, (q, b)


def test_distances_that_vanish(spark):
    """Other places may be at a distance of 0: they count as the place itself."""
    x = np.repeat([[0.0, 1.0], [1e-170, 1.0], [-1e-170, 1.0], [0.5, 0.25]], 12, axis=0)
    built = tree.build_tree(points_of(spark, np.random.default_rng(5).permutation(x)))
    at = np.array([[r["x0"], r["x1"]] for r in built.orderBy("node").collect()])
    found = {}
    for r in neighbors.query_preceding_neighbors(built, 6, 3).orderBy("idx", "slot").collect():
        found.setdefault(r["idx"], []).append((r["nb"], r["d2"]))
    assert found == {q: plain_neighbors(at, q, q, 3) for q in range(6, len(at))}


@pytest.mark.parametrize("ties", ["least", "met"])
def test_work_at_one_place(spark, monkeypatch, ties):
    """What a search finds grows with the points, not with the square of those at a place."""
    rows = []
    plain = neighbors.materialize

    def counted(df, *args):
        out = plain(df, *args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "materialize", counted)
    n = 3000
    built = tree.build_tree(points_of(spark, np.arange(n)[:, None] % 3.0))
    found = neighbors.query_preceding_neighbors(built, 10, 4, ties=ties)
    assert found.where("d2 = 0").count() > 4 * (n - 40) and found.count() == 4 * (n - 10)
    assert max(rows) <= 8 * n


def test_groups_of_deep_trees(spark, monkeypatch):
    """However deep a tree is, queries meet no more tiles than the lowest level of the top has nodes."""
    monkeypatch.setattr(neighbors, "TILE", 4)
    groups, plain = [], neighbors.materialize

    def counted(df, *args):
        out = plain(df, *args)
        groups.append(out.count() if "salts" in out.columns else 0)
        return out

    monkeypatch.setattr(neighbors, "materialize", counted)
    n = 2500
    x = np.random.default_rng(6).standard_normal((n, 2))
    built = tree.build_tree(points_of(spark, x))
    at = np.array([[r["x0"], r["x1"]] for r in built.orderBy("node").collect()])
    found = {}
    for r in neighbors.query_preceding_neighbors(built, 10, 3).orderBy("idx", "slot").collect():
        found.setdefault(r["idx"], []).append((r["nb"], r["d2"]))
    assert 0 < max(groups) <= 1 << 4
    assert all(found[q] == plain_neighbors(at, q, q, 3) for q in range(10, n, 7)) and len(found) == n - 10
