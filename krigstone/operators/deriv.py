"""Forward and reverse derivatives of the refinement in noise, initial values and covariance, and of its
inverse and log-determinant in values and covariance, which need no levels; together these are the gradient of
a likelihood.

With ``shared``, batches are noises under one covariance, as in ``refine``: factors and their derivatives are computed
once for all noises, which flow along each edge together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.covariance import Covariance, lookup, scatter
from ..sources.points import coordinates
from ..storage import materialize
from .factor import blocks, conditional, distances, local_sets, spread
from .graph import Graph
from .refine import KEYS, back, bars, columns, each_pass, names, of, passes, refine_inv, refine_logdet, rows, scaled, solve_forward, union


def _tangent_factors(graph: Graph, cov: Covariance, dcov: Covariance) -> DataFrame:
    """batch, idx, nbs, dw, ds along the direction dcov of the tabulated values."""
    k, d = graph.k, len(coordinates(graph.points))
    bins, tables = np.array(cov.bins), [(np.array(v), np.array(dv)) for v, dv in zip(cov.values, dcov.values, strict=True)]

    def run(batches):
        for batch in batches:
            for part, at in blocks(batch, k, d):
                r = distances(at)
                for b, (values, dvalues) in enumerate(tables):
                    K, dK = lookup(bins, values, r), lookup(bins, dvalues, r)
                    w, s = conditional(K)
                    push = np.einsum("mij,mj->mi", dK[:, :-1, :-1], w)
                    good = np.isfinite(s)
                    dw = np.full_like(w, np.nan)
                    if good.any():
                        dw[good] = np.linalg.solve(K[good, :-1, :-1], (dK[good, -1, :-1] - push[good])[:, :, None])[:, :, 0]
                    ds = (dK[:, -1, -1] - 2 * (dK[:, -1, :-1] * w).sum(axis=1) + (w * push).sum(axis=1)) / (2 * s)
                    lists = pa.ListArray.from_arrays(np.arange(0, dw.size + 1, k, dtype=np.int32), dw.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), b, np.int32)), part.column("idx"), part.column("nbs"), lists, pa.array(ds)], ["batch", "idx", "nbs", "dw", "ds"])

    return local_sets(graph).mapInArrow(run, "batch int, idx long, nbs array<long>, dw array<double>, ds double")


def refine_jvp(graph, cov, factors, values, xi, dcov, dinitial, dxi, shared: bool = False) -> DataFrame:
    """batch, idx, v: the derivative of the values at (values, xi) along dcov (None: only the linear
    inputs vary), dinitial (batch, idx, v) and dxi (batch, idx, dxi)."""
    own = of(factors, shared)
    tangents = materialize(_tangent_factors(graph, cov, dcov)) if dcov is not None else None

    def make(ids):
        value = names(ids)
        source = scaled(own, columns(dxi, "dxi", ids), value)
        if tangents is not None:
            each = tangents.select(*KEYS, F.explode(F.arrays_zip("nbs", "dw")).alias("e")).select(*KEYS, F.col("e.nbs").alias("nb"), F.col("e.dw").alias("dw"))
            met = each.join(columns(values, "v", ids).withColumnRenamed("idx", "nb"), ["batch", "nb"])
            moved = met.groupBy(*KEYS).agg(*(F.sum(F.col("dw") * F.col(c)).alias(f"moved_{c}") for c in value))
            noise = columns(xi, "xi", ids).select(*KEYS, *(F.col(c).alias(f"xi_{c}") for c in value))
            all_ = source.join(tangents.select(*KEYS, "ds"), KEYS).join(noise, KEYS).join(moved, KEYS)
            source = all_.select(*KEYS, *((F.col(c) + F.col(f"moved_{c}") + F.col("ds") * F.col(f"xi_{c}")).alias(c) for c in value))
        return rows(solve_forward(own, source, columns(dinitial, "v", ids), value), "v", ids)

    return each_pass(shared, [values, dxi, dinitial], make)


def _bins(graph: Graph, cov: Covariance, factors: DataFrame, values: DataFrame, received: DataFrame, ids) -> DataFrame:
    """batch, bin_id, cov_bar: what the bins receive, in one pass without levels.

    received: batch, idx, and for each noise what the point's weights receive for each unit of its neighbours'
    values (a0, a1, ...) and what its scale receives (s0, s1, ...).
    """
    value = names(ids)
    k, d, m = graph.k, len(coordinates(graph.points)), len(value)
    slots = factors.select(*KEYS, F.posexplode("nbs").alias("slot", "nb"))
    known = columns(values, "v", ids).select("batch", F.col("idx").alias("nb"), F.array(*value).alias("v"))
    held = slots.join(known, ["batch", "nb"]).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("slot", "v"))).alias("l"))
    met = held.join(received.select(*KEYS, F.array(*(f"a{i}" for i in range(m))).alias("a"), F.array(*(f"s{i}" for i in range(m))).alias("s")), KEYS)
    met = met.join(local_sets(graph).select("idx", "at"), "idx").select("batch", F.flatten("l.v").alias("v"), "a", "s", "at")
    bins, tables = np.array(cov.bins), [np.array(v) for v in cov.values]
    # of each covariance, or of each noise under the one
    out_ids = list(range(len(tables))) if ids is None else ids

    def run(batches):
        total = np.zeros((len(out_ids), len(bins)))
        for batch in batches:
            for part, at in blocks(batch, k, d):
                which = part.column("batch").to_numpy()
                vs = np.asarray(part.column("v").flatten()).reshape(-1, k, m)
                scales, sbars = (np.asarray(part.column(c).flatten()).reshape(-1, m) for c in ("a", "s"))
                r = distances(at)
                for b, values_ in enumerate(tables):
                    rows_ = which == b
                    if not rows_.any():
                        continue
                    K = lookup(bins, values_, r[rows_])
                    w, s = conditional(K)
                    y = np.linalg.solve(K[:, :-1, :-1], scales[rows_, None, :] * vs[rows_])
                    for c in range(m):
                        sigma = (sbars[rows_, c] / s)[:, None]
                        Kbar = np.zeros_like(K)
                        Kbar[:, -1, :-1] = y[:, :, c] - sigma * w
                        Kbar[:, :-1, :-1] = -y[:, :, c, None] * w[:, None, :] + (sigma / 2)[:, :, None] * w[:, :, None] * w[:, None, :]
                        Kbar[:, -1, -1] = sigma[:, 0] / 2
                        total[b if ids is None else c] += scatter(bins, r[rows_], Kbar)
        for b, row in zip(out_ids, total, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), b, np.int32)), pa.array(np.arange(len(bins), dtype=np.int32)), pa.array(row)], ["batch", "bin_id", "part"])

    return met.mapInArrow(run, "batch int, bin_id int, part double").groupBy("batch", "bin_id").agg(F.sum("part").alias("cov_bar"))


def refine_vjp(graph: Graph, cov: Covariance, factors: DataFrame, values: DataFrame, xi: DataFrame, cotangent: DataFrame, shared: bool = False):
    """(batch, bin_id, cov_bar), (batch, idx, initial_bar), (batch, idx, xi_bar).

    Only the flow of the cotangent needs levels; the bins receive theirs in one pass.  With shared factors
    each noise has its own cov_bar.
    """
    own = of(factors, shared)
    flows = back(factors, cotangent, shared)
    parts = [bars(own, ids, vbar) for ids, vbar in flows]

    def received(ids, vbar):
        value = names(ids)
        noise = columns(xi, "xi", ids).select(*KEYS, *(F.col(c).alias(f"xi_{c}") for c in value))
        each = [x for i, c in enumerate(value) for x in (F.col(c).alias(f"a{i}"), (F.col(c) * F.col(f"xi_{c}")).alias(f"s{i}"))]
        return vbar.join(noise, KEYS).select(*KEYS, *each)

    cov_bar = [_bins(graph, cov, own, values, received(ids, vbar), ids) for ids, vbar in flows]
    return union(cov_bar), union([p[0] for p in parts]), union([p[1] for p in parts])


def refine_inv_jvp(graph: Graph, cov: Covariance, factors: DataFrame, values: DataFrame, dcov: Covariance | None, dvalues: DataFrame, shared: bool = False) -> DataFrame:
    """batch, idx, dxi: the derivative of the noise that ``refine_inv`` finds in values along dcov (None: the covariance
    is constant) and dvalues (batch, idx, v)."""
    own = of(factors, shared)
    tangents = materialize(_tangent_factors(graph, cov, dcov)) if dcov is not None else None

    def make(ids):
        value = names(ids)
        _, found = refine_inv(factors, values, shared)
        noise = columns(found, "xi", ids).select(*KEYS, *(F.col(c).alias(f"xi_{c}") for c in value))
        known, moved = columns(values, "v", ids), columns(dvalues, "v", ids)
        at_nb = known.join(moved.select(*KEYS, *(F.col(c).alias(f"d_{c}") for c in value)), KEYS, "full")
        each = spread(own)
        if tangents is not None:
            changes = tangents.select(*KEYS, F.explode(F.arrays_zip("nbs", "dw")).alias("e")).select(*KEYS, F.col("e.nbs").alias("nb"), F.col("e.dw").alias("dw"))
            each = each.join(changes, [*KEYS, "nb"])
        else:
            each = each.withColumn("dw", F.lit(0.0))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        met = each.join(at_nb.withColumnRenamed("idx", "nb"), ["batch", "nb"])
        pulled = met.groupBy(*KEYS).agg(*(F.sum(F.col("w") * zero(f"d_{c}") + F.col("dw") * zero(c)).alias(f"pull_{c}") for c in value))
        scale = tangents.select(*KEYS, "ds") if tangents is not None else own.select(*KEYS, F.lit(0.0).alias("ds"))
        all_ = pulled.join(own.select(*KEYS, "s"), KEYS).join(scale, KEYS).join(noise, KEYS).join(moved, KEYS, "left")
        return rows(all_.select(*KEYS, *(((zero(c) - F.col(f"pull_{c}") - F.col("ds") * F.col(f"xi_{c}")) / F.col("s")).alias(c) for c in value)), "dxi", ids)

    return each_pass(shared, [values, dvalues], make)


def refine_inv_vjp(graph: Graph, cov: Covariance, factors: DataFrame, values: DataFrame, xi_bar: DataFrame, logdet_bar: float = 0.0, shared: bool = False) -> tuple[DataFrame, DataFrame]:
    """(batch, bin_id, cov_bar) and (batch, idx, v_bar): what covariance and values receive from the cotangent
    xi_bar (batch, idx, xi_bar) of the noise that ``refine_inv`` finds, and, the bins, from logdet_bar times
    the log-determinant."""
    own = of(factors, shared)
    found = materialize(refine_inv(factors, values, shared)[1])
    bins, bars_ = [], []
    for ids in passes(shared, values):
        value = names(ids)
        noise = columns(found, "xi", ids).select(*KEYS, *(F.col(c).alias(f"xi_{c}") for c in value))
        cotangent = own.select(*KEYS, "s").join(noise, KEYS).join(columns(xi_bar, "xi_bar", ids), KEYS, "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        each = [x for i, c in enumerate(value) for x in (
            (-zero(c) / F.col("s")).alias(f"a{i}"), ((F.lit(float(logdet_bar)) - zero(c) * F.col(f"xi_{c}")) / F.col("s")).alias(f"s{i}"))]
        bins.append(_bins(graph, cov, own, values, cotangent.select(*KEYS, *each), ids))
        # a value receives its own noise's cotangent, and less those of the points that it is a neighbour of
        scaled_ = cotangent.select(*KEYS, *((zero(c) / F.col("s")).alias(c) for c in value))
        pulled = spread(own).select(*KEYS, "nb", "w").join(scaled_, KEYS).select("batch", F.col("nb").alias("idx"), *((-F.col("w") * F.col(c)).alias(c) for c in value))
        bars_.append(rows(scaled_.unionByName(pulled).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in value)), "v_bar", ids))
    return union(bins), union(bars_)


def refine_logdet_jvp(graph: Graph, cov: Covariance, factors: DataFrame, dcov: Covariance) -> DataFrame:
    """batch, dlogdet: the derivative of ``refine_logdet`` along dcov."""
    moved = factors.select(*KEYS, "s").join(_tangent_factors(graph, cov, dcov).select(*KEYS, "ds"), KEYS)
    return moved.groupBy("batch").agg(F.sum(F.col("ds") / F.col("s")).alias("dlogdet"))


def log_likelihood(factors: DataFrame, values: DataFrame, shared: bool = False) -> DataFrame:
    """batch, log_likelihood of values above the first n0, given these, without the constant."""
    _, xi = refine_inv(factors, values, shared)
    squares = xi.groupBy("batch").agg((-F.sum(F.col("xi") * F.col("xi")) / 2).alias("squares"))
    own = refine_logdet(of(factors, shared))
    if shared:
        return squares.select("batch", (F.col("squares") - own.select("logdet").scalar()).alias("log_likelihood"))
    return squares.join(own, "batch").select("batch", (F.col("squares") - F.col("logdet")).alias("log_likelihood"))


def log_likelihood_gradient(graph: Graph, cov: Covariance, factors: DataFrame, values: DataFrame, shared: bool = False) -> tuple[DataFrame, DataFrame]:
    """(batch, bin_id, cov_bar) and (batch, idx, v_bar): the gradient of ``log_likelihood`` in the tabulated covariance and in the values."""
    xi = materialize(refine_inv(factors, values, shared)[1])
    return refine_inv_vjp(graph, cov, factors, values, xi.select(*KEYS, (-F.col("xi")).alias("xi_bar")), -1.0, shared)
