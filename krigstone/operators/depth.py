"""Dependency depth of the nodes of a neighbour graph, and the order by depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.points import coordinates
from ..storage import Growing, materialize, numbered


#: Edges that one task may hold to finish the depths.
FEW = 1 << 20


def compute_depths(edges: DataFrame, nodes: DataFrame, n0: int, few: int | None = None) -> DataFrame:
    """idx and depth of every node: 0 below n0, else one more than its deepest neighbour.

    Nodes that are nobody's neighbour follow from the others at the end.  Among the others, round r finds the nodes of depth r
    or more: those with a neighbour of depth r - 1 or more.  They are a part of those of the round before, so only edges between these
    are looked at again, and an edge is read as often as the node that it leads to is deep.  Each round adds its nodes to a growing table,
    in which a node's last round is its depth.  When few (FEW) edges are left, one task goes on alone.  If a round
    finds as many nodes as the last one, the graph has a cycle.
    """
    edges = edges.select("idx", "nb").where(F.col("idx") >= n0)
    inner = materialize(edges.where(F.col("nb") >= n0).select(F.col("nb").alias("idx")).distinct())
    found = Growing(edges.sparkSession, "idx long", by="depth", merge=_deepest)
    found.add(inner.select("idx", F.lit(1).alias("depth")))
    live = materialize(edges.where(F.col("nb") >= n0).join(inner, "idx", "left_semi"))
    depth, before = 2, None
    while live.count() > (FEW if few is None else few):
        deeper = materialize(live.select("idx").distinct())
        n = deeper.count()
        if n == before:
            raise ValueError("the neighbour graph has a cycle")
        found.add(deeper.select("idx", F.lit(depth).alias("depth")))
        live = materialize(live.join(deeper.withColumnRenamed("idx", "nb"), "nb", "left_semi"))
        depth, before = depth + 1, n
    last = materialize(_finished(live, depth))
    if last.where("depth < 0").limit(1).count():
        raise ValueError("the neighbour graph has a cycle")
    found.add(last)
    known = materialize(_deepest(found.read()))
    above = edges.join(inner, "idx", "left_anti").join(known.withColumnRenamed("idx", "nb"), "nb").groupBy("idx").agg((F.max("depth") + 1).alias("depth"))
    own = nodes.select("idx")
    outer = own.where(F.col("idx") >= n0).join(inner, "idx", "left_anti").join(above, "idx", "left").select("idx", F.coalesce("depth", F.lit(1)).alias("depth"))
    return materialize(own.where(F.col("idx") < n0).select("idx", F.lit(0).alias("depth")).unionByName(known).unionByName(outer))


def _deepest(found: DataFrame) -> DataFrame:
    return found.groupBy("idx").agg(F.max("depth").alias("depth"))


def _finished(live: DataFrame, depth: int) -> DataFrame:
    """idx and depth of the nodes that at most FEW edges lead from, all of depth or more; -1 in a cycle."""

    def run(batches):
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        idx, nb = (np.concatenate(c) for c in zip(*rows, strict=True))
        every, now, before = np.unique(idx), depth, None
        deep = np.zeros(len(every), np.int32)
        while len(idx):
            deeper = np.unique(idx)
            deep[np.searchsorted(every, deeper)] = now if before != len(deeper) else -1
            if before == len(deeper):
                break
            keep = np.isin(nb, deeper)
            idx, nb, now, before = idx[keep], nb[keep], now + 1, len(deeper)
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(deep)], ["idx", "depth"])

    return live.select("idx", "nb").coalesce(1).mapInArrow(run, "idx long, depth int")


def order_by_depth(points: DataFrame, edges: DataFrame, depths: DataFrame, n0: int) -> tuple[DataFrame, DataFrame]:
    """points(idx, point_id, coordinates, depth) and edges(idx, slot, nb) renumbered by (depth, idx).

    The first n0 stay in place: they have depth 0 and the lowest numbers."""
    dims = coordinates(points)
    with_depth = points.select("idx", "point_id", *dims).join(depths, "idx")
    placed = materialize(numbered(with_depth, "depth", "idx", name="new"))
    to = placed.select(F.col("idx").alias("nb"), F.col("new").alias("new_nb"))
    own = placed.select("idx", "new")
    moved = edges.select("idx", "slot", "nb").join(own, "idx").join(to, "nb").select(F.col("new").alias("idx"), "slot", F.col("new_nb").alias("nb"))
    return placed.select(F.col("new").alias("idx"), "point_id", *dims, "depth"), materialize(moved)


def offsets(depths: DataFrame) -> DataFrame:
    """depth and the exclusive end of its rows in the order by depth; one row a depth."""
    running = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return depths.groupBy("depth").agg(F.count("*").alias("n")).select("depth", F.sum("n").over(running).alias("end"))
