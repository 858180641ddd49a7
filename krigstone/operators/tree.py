"""Balanced k-d tree order of a point set.

Node c of level l has the children c + 2**l and c + 2 * 2**l.  In each round a segment (the points
that share a tag) is split at its median along its widest dimension, ties by point_id; the
median becomes the node of that tag, the others go on with the tags of its children.  Ids 0 to
N - 1 are all used, and every prefix of them is a sample of the whole set.

Medians are found by counting: histograms of all segments at once, refined around the median.  Points are scanned
and written anew with their tags, but not shuffled, until segments have at most LEAF points; then each is
finished in one step, in a task of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.points import coordinates
from ..storage import materialize

LEAF = 1 << 15
#: Points of a median's cell that are sorted.
SELECT = 4096
#: Cells of a segment's histogram at most, and of all segments together.
MOST_CELLS, CELLS = 4096, 1 << 20
#: Segments whose table, some 60 bytes each, is sent to all tasks.
FEW = 1 << 16


def widest(spreads: list) -> F.Column:
    """The dimension of the largest spread, the lowest one on ties."""
    out = F.lit(len(spreads) - 1)
    for i in range(len(spreads) - 2, -1, -1):
        best = F.lit(True)
        for other in spreads[i + 1 :]:
            best = best & (spreads[i] >= other)
        out = F.when(best, i).otherwise(out)
    return out


def _joined(points: DataFrame, segments: DataFrame, few: bool) -> DataFrame:
    return points.join(F.broadcast(segments) if few else segments, "tag")


def _along(dims: list[str]) -> F.Column:
    return F.element_at(F.array(*dims), F.col("split_dim") + 1)


def medians(points: DataFrame, dims: list[str], n_segments: int, select: int) -> DataFrame:
    """tag, split_dim, at, at_id: the exact median of each segment by (coordinate along its widest dimension, point_id).

    Points are counted, not sorted: a histogram of each segment tells in which of its cells the median lies, and
    that cell is cut anew until it has at most ``select`` points, which are then sorted.  Where a cell holds
    one coordinate only, point_ids are counted instead.  Cells never part equal keys, as their numbers never decrease with the key.
    """
    few = n_segments <= FEW
    cells = max(16, min(MOST_CELLS, CELLS // n_segments))
    spreads = [F.max(c) - F.min(c) for c in dims]
    seek = points.groupBy("tag").agg(
        widest(spreads).alias("split_dim"), F.count("*").alias("n"), F.array(*map(F.min, dims)).alias("lows"), F.array(*map(F.max, dims)).alias("highs"), F.min("point_id").alias("id_low"), F.max("point_id").alias("id_high"))
    pick = lambda c: F.element_at(c, F.col("split_dim") + 1)
    seek = materialize(seek.select("tag", "split_dim", "n", F.floor(F.col("n") / 2).alias("rank"), pick("lows").alias("low"), pick("highs").alias("high"), "id_low", "id_high"))
    one_value = F.col("low") == F.col("high")
    inside = F.col("c").between(F.col("low"), F.col("high")) & (~one_value | F.col("point_id").between(F.col("id_low"), F.col("id_high")))

    def within(columns):
        return _joined(points, seek, few).withColumn("c", _along(dims)).where(inside).select("tag", "split_dim", "rank", "low", "high", "id_low", "id_high", "c", "point_id", *columns)

    before = None
    while True:
        most = seek.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if most["most"] is None or most["most"] <= select or most == before:  # cells that can't be parted any more are sorted as they are
            break
        before = most
        over = lambda c, low, high: F.coalesce(F.try_divide(F.col(c) - F.col(low), F.col(high) - F.col(low)), F.lit(0.0))
        share = F.when(one_value, over("point_id", "id_low", "id_high")).otherwise(over("c", "low", "high"))
        cell = F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")
        counted = within([cell.alias("cell")]).groupBy("tag", "split_dim", "rank", "cell").agg(
            F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("point_id").alias("id_low"), F.max("point_id").alias("id_high"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("tag").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("below", below).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        seek = materialize(found.select("tag", "split_dim", "n", (F.col("rank") - F.col("below")).alias("rank"), "low", "high", "id_low", "id_high"))
    keys = F.sort_array(F.collect_list(F.struct("c", "point_id")))
    chosen = within([]).groupBy("tag", "split_dim", "rank").agg(keys.alias("keys")).select("tag", "split_dim", F.get("keys", F.col("rank").cast("int")).alias("key"))
    return materialize(chosen.select("tag", "split_dim", F.col("key.c").alias("at"), F.col("key.point_id").alias("at_id")))


def _finish(ids: np.ndarray, x: np.ndarray, tag: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and split dimensions of one segment, all of its levels."""
    n = len(ids)
    node, split, tags = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.full(n, tag, np.int64)
    while (open_ := np.flatnonzero(node < 0)).size:
        by_tag = open_[np.argsort(tags[open_], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(tags[by_tag]) != 0]))
        sizes = np.diff(np.append(starts, len(by_tag)))
        spread = np.maximum.reduceat(x[by_tag], starts) - np.minimum.reduceat(x[by_tag], starts)
        dim = np.repeat(spread.argmax(axis=1), sizes)
        order = np.lexsort((ids[by_tag], x[by_tag, dim], tags[by_tag]))
        rows, rank, half = by_tag[order], np.arange(len(by_tag)) - np.repeat(starts, sizes), np.repeat(sizes // 2, sizes)
        split[rows] = dim
        placed = rank == half
        node[rows[placed]] = tags[rows[placed]]
        tags[rows] += np.where(rank < half, 1, 2) << level
        level += 1
    return node, split


def build_tree(points: DataFrame, leaf: int = LEAF) -> DataFrame:
    """node, point_id, coordinates, split_dim (0 where nothing is split)."""
    dims = coordinates(points)
    rest = points.select("point_id", *dims).withColumn("tag", F.lit(0).cast("long"))
    size, level, placed = rest.count(), 0, []
    columns = ["node", "point_id", *dims, "split_dim"]
    while size > leaf:
        split = medians(rest, dims, 1 << level, SELECT)
        c = F.col("c")
        side = F.when((c == F.col("at")) & (F.col("point_id") == F.col("at_id")), 0).when((c < F.col("at")) | ((c == F.col("at")) & (F.col("point_id") < F.col("at_id"))), 1).otherwise(2)
        done = materialize(_joined(rest, split, 1 << level <= FEW).withColumn("c", _along(dims)).select("tag", "point_id", *dims, "split_dim", side.alias("side")))
        placed.append(done.where("side = 0").withColumn("node", F.col("tag")).select(*columns))
        rest = done.where("side > 0").select("point_id", *dims, (F.col("tag") + F.col("side") * (1 << level)).alias("tag"))
        size, level = size // 2, level + 1
    schema = f"node long, point_id long, {', '.join(f'{c} double' for c in dims)}, split_dim int"

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("point_id").to_numpy()
        x = np.column_stack([table.column(c).to_numpy() for c in dims])
        node, split = _finish(ids, x, table.column("tag")[0].as_py(), level)
        return pa.table({"node": node, "point_id": ids, **{c: x[:, i] for i, c in enumerate(dims)}, "split_dim": split})

    tree = rest.groupBy("tag").applyInArrow(run, schema)
    for part in placed:
        tree = tree.unionByName(part.withColumn("split_dim", F.col("split_dim").cast("int")))
    return materialize(tree)
