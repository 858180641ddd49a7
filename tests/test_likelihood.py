"""Derivatives of the inverse and the log-determinant against differences, and the gradient of the likelihood."""

import numpy as np
import pytest

from krigstone.functions import covariance as C
from krigstone.operators.deriv import log_likelihood, log_likelihood_gradient, refine_inv_jvp, refine_inv_vjp, refine_logdet_jvp
from krigstone.operators.factor import factorize
from krigstone.operators.graph import build_graph
from krigstone.storage import materialize

N, N0, K = 50, 7, 3
COV = C.matern(1, 1.0, 1.0, 1e-2, 10.0, 60, 1e-3)


def frame(spark, name, values, lo=0):
    rows = [(b, i + lo, float(v)) for b, row in enumerate(values) for i, v in enumerate(row)]
    return materialize(spark.createDataFrame(rows, f"batch int, idx long, {name} double"))


def array(df, name, shape, key="idx", lo=0):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["batch"], r[key] - lo] = r[name]
    return out


@pytest.fixture(scope="module")
def graph(spark):
    x = np.random.default_rng(3).standard_normal((N, 2))
    return build_graph(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id long, x0 double, x1 double"), N0, K)


def plain(at, nb, table, values):
    r = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    cov = np.interp(r, COV.bins, table)
    xi, total = np.zeros(N - N0), 0.0
    for i in range(N0, N):
        c = nb[i - N0]
        w = np.linalg.solve(cov[np.ix_(c, c)], cov[c, i])
        s = np.sqrt(cov[i, i] - cov[c, i] @ w)
        xi[i - N0], total = (values[i] - w @ values[c]) / s, total + np.log(s)
    return xi, total


@pytest.mark.parametrize("shared", [False, True])
def test_inverse_and_likelihood(spark, graph, shared):
    at = np.array([[r["x0"], r["x1"]] for r in graph.points.orderBy("idx").collect()])
    nb = np.array([r["nb"] for r in graph.edges.orderBy("idx", "slot").collect()]).reshape(-1, K)
    cov = COV if shared else C.Covariance(COV.bins, (COV.values[0], tuple(2 * v for v in COV.values[0])))
    tables = [np.array(cov.values[0 if shared else b]) for b in range(2)]
    rng = np.random.default_rng(4)
    d_tables = [rng.standard_normal(len(COV.bins)) * 1e-3 for _ in cov.values]
    d_cov = C.Covariance(COV.bins, tuple(tuple(d.tolist()) for d in d_tables))
    d_each = [d_tables[0 if shared else b] for b in range(2)]
    factors = factorize(graph, cov)
    v, dv, bar = rng.standard_normal((2, N)), rng.standard_normal((2, N)), rng.standard_normal((2, N - N0))
    values, moved = frame(spark, "v", v), frame(spark, "v", dv)
    dxi = array(refine_inv_jvp(graph, cov, factors, values, d_cov, moved, shared), "dxi", (2, N - N0), lo=N0)
    linear = array(refine_inv_jvp(graph, cov, factors, values, None, moved, shared), "dxi", (2, N - N0), lo=N0)
    cov_bar, v_bar = refine_inv_vjp(graph, cov, factors, values, frame(spark, "xi_bar", bar, N0), 0.7, shared)
    bins, back = array(cov_bar, "cov_bar", (2, len(COV.bins)), "bin_id"), array(v_bar, "v_bar", (2, N))
    dlog = {r["batch"]: r["dlogdet"] for r in refine_logdet_jvp(graph, cov, factors, d_cov).collect()}
    scores = {r["batch"]: r["log_likelihood"] for r in log_likelihood(factors, values, shared).collect()}
    g_cov, g_v = log_likelihood_gradient(graph, cov, factors, values, shared)
    g_bins, g_values = array(g_cov, "cov_bar", (2, len(COV.bins)), "bin_id"), array(g_v, "v_bar", (2, N))
    h = 1e-5
    for b in range(2):
        ends = [plain(at, nb, tables[b] + e * d_each[b], v[b] + e * dv[b]) for e in (h, -h)]
        assert np.allclose(dxi[b], (ends[0][0] - ends[1][0]) / (2 * h), rtol=1e-4, atol=1e-5)
        assert np.allclose(linear[b], plain(at, nb, tables[b], dv[b])[0])
        log_moved = (ends[0][1] - ends[1][1]) / (2 * h)
        assert np.isclose(dlog[0 if shared else b], log_moved, rtol=1e-4)
        # the adjoint, of both outputs at once
        assert np.isclose(bar[b] @ dxi[b] + 0.7 * dlog[0 if shared else b], bins[b] @ d_each[b] + back[b] @ dv[b], rtol=1e-8)
        xi, total = plain(at, nb, tables[b], v[b])
        assert np.isclose(scores[b], -xi @ xi / 2 - total)
        slope = [-x @ x / 2 - t for x, t in ends]
        assert np.isclose(g_bins[b] @ d_each[b] + g_values[b] @ dv[b], (slope[0] - slope[1]) / (2 * h), rtol=1e-4, atol=1e-5)
