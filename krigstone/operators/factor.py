"""Conditional weights of every point given its neighbours.

With K the covariance of a point's neighbours and itself, w = K_cc^-1 k_f and s = sqrt(K_ff -
k_f w) are all that the operators on values need.  They depend on the graph and the covariance
only, so they are computed once, in one pass without order, and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.covariance import Covariance, lookup
from ..sources.points import coordinates
from ..storage import materialize
from .graph import Graph

#: Bytes of covariance matrices that one step of a task holds.
BLOCK_BYTES = 64 << 20


def local_sets(graph: Graph) -> DataFrame:
    """idx, depth, nbs, nb_depths and at: coordinates of the neighbours by slot and then of the
    point, one after the other.  Each list has at most k + 1 points."""
    dims = coordinates(graph.points)
    point = F.array(*dims)
    nb = graph.points.select(F.col("idx").alias("nb"), F.col("depth").alias("nb_depth"), point.alias("nb_at"))
    lists = (
        graph.edges.join(nb, "nb").groupBy("idx")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "nb", "nb_depth", "nb_at"))).alias("l"))
    )
    own = graph.points.select("idx", "depth", point.alias("own"))
    return lists.join(own, "idx").select(
        "idx", "depth", F.col("l.nb").alias("nbs"), F.col("l.nb_depth").alias("nb_depths"), F.concat(F.flatten("l.nb_at"), "own").alias("at"),
    )


def distances(at: np.ndarray) -> np.ndarray:
    """(M, k + 1, d) to (M, k + 1, k + 1)."""
    gap = at[:, :, None, :] - at[:, None, :, :]
    return np.sqrt((gap * gap).sum(axis=3))


def conditional(K: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """w and s of each of a stack of matrices; NaN where one isn't positive definite."""
    m, n, _ = K.shape
    w, s = np.full((m, n - 1), np.nan), np.full(m, np.nan)
    try:
        L = np.linalg.cholesky(K)
        good = np.ones(m, bool)
    except np.linalg.LinAlgError:
        L, good = np.zeros_like(K), np.zeros(m, bool)
        for i in range(m):
            try:
                L[i] = np.linalg.cholesky(K[i])
                good[i] = True
            except np.linalg.LinAlgError:
                pass
    if good.any():
        w[good] = np.linalg.solve(L[good, :-1, :-1].transpose(0, 2, 1), L[good, -1, :-1, None])[:, :, 0]
        s[good] = L[good, -1, -1]
    return w, s


def blocks(batch, k: int, d: int):
    """Slices of a batch of local sets, with their coordinates as an array."""
    step = max(1, BLOCK_BYTES // (8 * (k + 1) ** 2 * max(d, 4)))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield part, np.asarray(part.column("at").flatten()).reshape(part.num_rows, k + 1, d)


def factorize(graph: Graph, cov: Covariance) -> DataFrame:
    """batch, idx, depth, nbs, nb_depths, w, s for every point with neighbours."""
    k, d = graph.k, len(coordinates(graph.points))
    schema = "batch int, idx long, depth int, nbs array<long>, nb_depths array<int>, w array<double>, s double"
    bins, tables = np.array(cov.bins), [np.array(v) for v in cov.values]

    def run(batches):
        for batch in batches:
            for part, at in blocks(batch, k, d):
                r = distances(at)
                for b, values in enumerate(tables):
                    w, s = conditional(lookup(bins, values, r))
                    lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), w.ravel())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), b, np.int32)), *(part.column(c) for c in ("idx", "depth", "nbs", "nb_depths")), lists, pa.array(s)],
                        ["batch", "idx", "depth", "nbs", "nb_depths", "w", "s"],
                    )

    return materialize(local_sets(graph).mapInArrow(run, schema))


def spread(factors: DataFrame, *more: str) -> DataFrame:
    """One row for each neighbour: batch, idx, depth, nb, nb_depth, w."""
    each = F.explode(F.arrays_zip("nbs", "nb_depths", "w")).alias("e")
    return factors.select("batch", "idx", "depth", *more, each).select("batch", "idx", "depth", *more, F.col("e.nbs").alias("nb"), F.col("e.nb_depths").alias("nb_depth"), F.col("e.w").alias("w"))
