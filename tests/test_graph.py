"""Tree, neighbours, depth, order and sorts against plain numpy."""

import numpy as np
import pytest

from krigstone.operators import neighbors, tree
from krigstone.operators.depth import compute_depths, offsets, order_by_depth
from krigstone.operators.graph import build_graph, check_points
from krigstone.operators.sorting import sort, sort_positions
from krigstone.storage import numbered


def points_of(spark, x):
    rows = [(int(i), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "point_id long, " + ", ".join(f"x{i} double" for i in range(x.shape[1])))


def plain_tree(x):
    """node -> (point, split dimension), by recursion from the definition."""
    out = {}

    def place(rows, tag, level):
        if not len(rows):
            return
        spread = x[rows].max(axis=0) - x[rows].min(axis=0)
        dim = int(spread.argmax())
        rows = sorted(rows, key=lambda i: (x[i, dim], i))
        half = len(rows) // 2
        out[tag] = (rows[half], dim)
        place(rows[:half], tag + 2**level, level + 1)
        place(rows[half + 1 :], tag + 2 * 2**level, level + 1)

    place(list(range(len(x))), 0, 0)
    return out


def cloud(n, d, kind="normal", seed=1):
    rng = np.random.default_rng(seed)
    if kind == "ties":
        return rng.integers(0, 4, (n, d)).astype(float)
    return rng.standard_normal((n, d))


@pytest.mark.parametrize("n,d,kind,leaf", [(1, 3, "normal", 4096), (2, 1, "normal", 4096), (7, 2, "ties", 4096), (8, 6, "normal", 2), (100, 3, "ties", 16), (257, 2, "normal", 32)])
def test_tree(spark, n, d, kind, leaf):
    x = cloud(n, d, kind)
    found = {r["node"]: (r["point_id"], r["split_dim"]) for r in tree.build_tree(points_of(spark, x), leaf).collect()}
    assert found == plain_tree(x)


@pytest.mark.parametrize("kind,few", [("ties", 1 << 16), ("normal", 1 << 16), ("one place", 1), ("far away", 1 << 16)])
def test_medians_of_refined_histograms(spark, monkeypatch, kind, few):
    """Cells of few points, so that histograms are refined several times, also by point_id."""
    monkeypatch.setattr(tree, "SELECT", 3)
    monkeypatch.setattr(tree, "CELLS", 16)
    monkeypatch.setattr(tree, "FEW", few)
    x = cloud(200, 3, "ties" if kind == "ties" else "normal")
    if kind == "one place":
        x[20:180] = x[0]
    elif kind == "far away":
        x[7], x[8:12] = 1e200, -1e-300
    found = {r["node"]: (r["point_id"], r["split_dim"]) for r in tree.build_tree(points_of(spark, x), 40).collect()}
    assert found == plain_tree(x)


def plain_neighbors(x, bound, q, k):
    gap = x[q] - x[:bound]
    d2 = gap[:, 0] * gap[:, 0]
    for j in range(1, x.shape[1]):
        d2 = d2 + gap[:, j] * gap[:, j]
    order = np.lexsort((np.arange(bound), d2))[:k]
    return [(int(i), float(d2[i])) for i in order]


@pytest.mark.parametrize("kind,tile", [("normal", 12), ("ties", 12), ("normal", 3)])
def test_neighbors(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(neighbors, "TILE", tile)
    monkeypatch.setattr(neighbors, "GROUP", 20)
    built = tree.build_tree(points_of(spark, cloud(150, 3, kind)))
    x = np.array([[r["x0"], r["x1"], r["x2"]] for r in sorted(built.collect(), key=lambda r: r["node"])])
    found = {}
    for r in neighbors.query_preceding_neighbors(built, 10, 4).orderBy("idx", "slot").collect():
        found.setdefault(r["idx"], []).append((r["nb"], r["d2"]))
    assert found == {q: plain_neighbors(x, q, q, 4) for q in range(10, 150)}


def searched(x, split, bound, query, k):
    """Neighbours by a depth-first search of the tree in node order, nearer child first."""
    kept = []

    def visit(node, level):
        if node >= bound:
            return
        gap = x[query] - x[node]
        d2 = sum(g * g for g in gap.tolist())
        if len(kept) < k or d2 < kept[-1][0]:
            kept.append((d2, node))
            kept.sort()
            del kept[k:]
        side = gap[split[node]]
        children = (node + 2**level, node + 2 * 2**level)
        for child in children if side < 0 else children[::-1]:
            visit(child, level + 1)

    visit(0, 0)
    return kept


@pytest.mark.parametrize("tile", [12, 3])
def test_ties_as_a_search_meets_them(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbors, "TILE", tile)
    x = np.array([(a, b, c) for a in range(5) for b in range(5) for c in range(5)], float)
    built = tree.build_tree(points_of(spark, x))
    rows = built.orderBy("node").collect()
    at, split = np.array([[r[f"x{i}"] for i in range(3)] for r in rows]), [r["split_dim"] for r in rows]
    n0, k = 10, 6
    lists = {}
    for ties in ("least", "met"):
        found = {}
        for r in neighbors.query_preceding_neighbors(built, n0, k, ties=ties).collect():
            found.setdefault(r["idx"], []).append((r["slot"], r["d2"], r["nb"]))
        lists[ties] = {i: [(d, nb) for _, d, nb in sorted(rows_)] for i, rows_ in found.items()}
    differ = 0
    for i in range(n0, len(x)):
        assert lists["met"][i] == searched(at, split, i, i, k)
        assert [d for d, _ in lists["met"][i]] == [d for d, _ in lists["least"][i]]
        differ += lists["met"][i] != lists["least"][i]
    assert differ > 5


def test_bounded_neighbors_and_padding(spark):
    built = tree.build_tree(points_of(spark, cloud(40, 2)))
    asked = spark.createDataFrame([(30, 0), (30, 2), (5, 40), (39, 40)], "query long, bound long")
    found = neighbors.query_neighbors(built, asked, 4, pad=True).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["slot"]):
        by.setdefault((r["query"], r["bound"]), []).append(r["nb"])
    assert by[30, 1] == [0, 0, 0, 0] and len(by[30, 2]) == 4 and set(by[30, 2]) == {0, 1}
    assert by[5, 40][0] == 5 and by[39, 40][0] == 39
    with pytest.raises(ValueError):
        neighbors.query_preceding_neighbors(built, 2, 4)
    with pytest.raises(ValueError):
        neighbors.query_neighbors(built, asked, 65)


def test_depth_and_order(spark):
    edges = spark.createDataFrame([(2, 0, 0), (2, 1, 1), (3, 0, 2), (3, 1, 0), (4, 0, 0), (4, 1, 1), (5, 0, 3), (5, 1, 4)], "idx long, slot int, nb long")
    nodes = spark.createDataFrame([(i, i, float(i)) for i in range(6)], "idx long, point_id long, x0 double")
    found = compute_depths(edges, nodes, 2)
    assert {r["idx"]: r["depth"] for r in found.collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 1, 5: 3}
    points, moved = order_by_depth(nodes, edges, found, 2)
    assert [r["point_id"] for r in points.orderBy("idx").collect()] == [0, 1, 2, 4, 3, 5]
    assert all(r["nb"] < r["idx"] for r in moved.collect())
    assert [(r["depth"], r["end"]) for r in offsets(found).orderBy("depth").collect()] == [(0, 2), (1, 4), (2, 5), (3, 6)]
    loop = spark.createDataFrame([(2, 0, 3), (3, 0, 2)], "idx long, slot int, nb long")
    with pytest.raises(ValueError):
        compute_depths(loop, nodes.where("idx < 4"), 2)


def test_graph_order(spark):
    graph = build_graph(points_of(spark, cloud(120, 2)), 10, 3)
    rows = graph.points.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(120))
    assert [r["depth"] for r in rows] == sorted(r["depth"] for r in rows)
    depth = {r["idx"]: r["depth"] for r in rows}
    edges = graph.edges.collect()
    assert len(edges) == 110 * 3 and all(r["nb"] < r["idx"] and depth[r["nb"]] < depth[r["idx"]] for r in edges)


def test_validation(spark):
    with pytest.raises(ValueError):
        check_points(spark.createDataFrame([(1, float("nan"))], "point_id long, x0 double"))
    with pytest.raises(ValueError):
        check_points(spark.createDataFrame([(1,)], "point_id long"))


def test_sorts(spark):
    rows = [(i % 3, i % 5, i % 2, i) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    assert [tuple(r) for r in sort(df, "a", "b", "c", "d").collect()] == sorted(rows)
    placed = sort_positions(df, "a", "b", "c", "d").orderBy("position").collect()
    assert [tuple(r)[:4] for r in placed] == sorted(rows) and [r["position"] for r in placed] == list(range(60))
    assert numbered(df.limit(0), "d").count() == 0
    with pytest.raises(ValueError):
        sort(df)
