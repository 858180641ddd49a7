"""Whole fields: a dense start of n0 points, then the refinement; their inverse and derivatives.

The dense part is a table of tiles (``dense``), so n0 is bounded by the work, n0**3 / 3, and by a row of tiles in
a task.  Its factor can be made once (``start_factor``) and handed to all functions here as ``start``.

With ``shared``, batches are noises under one covariance, the first one of cov; else batch b has covariance b.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.covariance import Covariance
from ..storage import materialize
from . import dense
from .deriv import refine_jvp, refine_vjp
from .graph import Graph
from .refine import refine, refine_inv, refine_logdet, union


def _tables(cov: Covariance | None, shared: bool) -> Covariance | None:
    return replace(cov, values=cov.values[:1]) if cov and shared else cov


def start_factor(graph: Graph, cov: Covariance, dcov: Covariance | None = None, tile: int = dense.TILE) -> DataFrame:
    """Tiles of the Cholesky factor of the first n0 points' covariance, and of its derivative along dcov."""
    return dense.factorize_tiles(dense.covariance_tiles(graph.points, graph.n0, cov, dcov, tile), graph.n0, tile)


def generate(graph: Graph, cov: Covariance, factors: DataFrame, xi: DataFrame, shared: bool = False, start: DataFrame | None = None, tile: int = dense.TILE) -> DataFrame:
    """batch, idx, v from noise xi (batch, idx, xi) for all points."""
    L = start_factor(graph, _tables(cov, shared), tile=tile) if start is None else start
    first = dense.times(L, dense.sides(xi, "xi", graph.n0, shared, tile), graph.n0, tile=tile)
    return refine(factors, materialize(dense.unpack(first, "v", tile)), xi.where(F.col("idx") >= graph.n0), shared)


def generate_inv(graph: Graph, cov: Covariance, factors: DataFrame, values: DataFrame, shared: bool = False, start: DataFrame | None = None, tile: int = dense.TILE) -> DataFrame:
    """batch, idx, xi of all points."""
    L = start_factor(graph, _tables(cov, shared), tile=tile) if start is None else start
    first, xi = refine_inv(factors, values, shared)
    noise = dense.solve(L, dense.sides(first, "v", graph.n0, shared, tile), graph.n0, tile=tile)
    return dense.unpack(noise, "xi", tile).unionByName(xi)


def generate_logdet(graph: Graph, cov: Covariance, factors: DataFrame, start: DataFrame | None = None, tile: int = dense.TILE) -> DataFrame:
    """batch, logdet of the whole map from noise to values, for each covariance."""
    L = start_factor(graph, cov, tile=tile) if start is None else start
    return union([refine_logdet(factors), dense.logdet(L)]).groupBy("batch").agg(F.sum("logdet").alias("logdet"))


def generate_jvp(graph: Graph, cov: Covariance, factors: DataFrame, values: DataFrame, xi: DataFrame, dcov: Covariance | None, dxi: DataFrame, shared: bool = False, tile: int = dense.TILE) -> DataFrame:
    """batch, idx, v: the derivative of ``generate`` at noise xi, which gave values, along dcov (None: the
    covariance is constant) and dxi (batch, idx, dxi), for all points."""
    n0, cov, dcov = graph.n0, _tables(cov, shared), _tables(dcov, shared)
    L = start_factor(graph, cov, dcov, tile)
    parts = [dense.times(L, dense.sides(dxi, "dxi", n0, shared, tile), n0, tile=tile)]
    if dcov is not None:
        parts.append(dense.times(L, dense.sides(xi, "xi", n0, shared, tile), n0, column="moved", tile=tile))
    first = union([dense.unpack(p, "v", tile) for p in parts]).groupBy("batch", "idx").agg(F.sum("v").alias("v"))
    later = F.col("idx") >= n0
    return refine_jvp(graph, cov, factors, values, xi.where(later), dcov, materialize(first), dxi.where(later), shared)


def generate_vjp(graph: Graph, cov: Covariance, factors: DataFrame, values: DataFrame, xi: DataFrame, cotangent: DataFrame, shared: bool = False, start: DataFrame | None = None, tile: int = dense.TILE) -> tuple[DataFrame, DataFrame]:
    """(batch, bin_id, cov_bar) and (batch, idx, xi_bar) of all points from a cotangent (batch, idx, vbar)."""
    n0, cov = graph.n0, _tables(cov, shared)
    L = start_factor(graph, cov, tile=tile) if start is None else start
    cov_bar, initial_bar, xi_bar = refine_vjp(graph, cov, factors, values, xi.where(F.col("idx") >= n0), cotangent, shared)
    back, noise = dense.sides(initial_bar, "initial_bar", n0, shared, tile), dense.sides(xi, "xi", n0, shared, tile)
    received = dense.factor_cotangent(L, dense.outer(back, noise, n0, each=shared, tile=tile), n0, tile)
    total = cov_bar.unionByName(dense.to_bins(graph.points, n0, received, cov, tile)).groupBy("batch", "bin_id").agg(F.sum("cov_bar").alias("cov_bar"))
    return total, dense.unpack(dense.times(L, back, n0, transpose=True, tile=tile), "xi_bar", tile).unionByName(xi_bar)
