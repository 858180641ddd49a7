"""The neighbour graph of a point set: tree, preceding neighbours, depth, order by depth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.points import coordinates
from ..storage import materialize
from .depth import compute_depths, offsets, order_by_depth
from .neighbors import query_preceding_neighbors
from .tree import LEAF, build_tree


@dataclass(frozen=True)
class Graph:
    points: DataFrame  # idx, point_id, coordinates, depth
    edges: DataFrame  # idx, slot, nb
    n0: int
    k: int

    @property
    def offsets(self) -> DataFrame:
        return offsets(self.points.select("idx", "depth"))


def check_points(points: DataFrame) -> DataFrame:
    """points with finite coordinates and different ids; raises ValueError for others."""
    bad = F.lit(False)
    for c in coordinates(points):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if points.where(bad | F.col("point_id").isNull()).limit(1).count():
        raise ValueError("coordinates and ids must be finite and not null")
    if points.groupBy("point_id").count().where("count > 1").limit(1).count():
        raise ValueError("point_id must differ from point to point")
    return points


def build_graph(points: DataFrame, n0: int, k: int, leaf: int = LEAF, few: int | None = None, tree: Callable[[], DataFrame] | None = None) -> Graph:
    """The graph of k nearest preceding neighbours in the order by depth; leaf and few bound what single tasks finish of tree and depths.

    tree: gives the tree of the points, where others share it."""
    if n0 < k:
        raise ValueError(f"n0 = {n0} must be at least k = {k}")
    points = check_points(points)
    tree = build_tree(points, leaf) if tree is None else tree()
    edges = materialize(query_preceding_neighbors(tree, n0, k).select("idx", "slot", "nb"))
    nodes = tree.withColumnRenamed("node", "idx").drop("split_dim")
    ordered, moved = order_by_depth(nodes, edges, compute_depths(edges, nodes, n0, few), n0)
    return Graph(ordered, moved, n0, k)
