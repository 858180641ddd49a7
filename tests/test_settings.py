"""The usual setting (1000 points, 3 dimensions, a start of 100, 10 neighbours, 1000 bins), the limits (64
neighbours, 6 dimensions), whole fields with derivatives, and one covariance for several noises."""

import numpy as np
import pytest

from krigstone import storage
from krigstone.functions import covariance as C
from krigstone.operators import depth
from krigstone.operators import refine as refine_module
from krigstone.operators.factor import factorize
from krigstone.operators.dense import cholesky_jvp, cholesky_vjp
from krigstone.operators.generate import generate, generate_inv, generate_jvp, generate_logdet, generate_vjp
from krigstone.operators.graph import build_graph, check_points
from krigstone.operators.refine import refine, refine_inv, refine_logdet, refine_transpose
from krigstone.storage import materialize


def make(spark, n, d, n0, k, cov, seed=3, kind=np.float64):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(kind).astype(float)
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id long, " + ", ".join(f"x{i} double" for i in range(d)))
    graph = build_graph(points, n0, k)
    at = np.array([[r[f"x{i}"] for i in range(d)] for r in graph.points.orderBy("idx").collect()])
    nb = np.array([r["nb"] for r in graph.edges.orderBy("idx", "slot").collect()]).reshape(-1, k)
    return graph, factorize(graph, cov), at, nb


def frame(spark, name, values, lo=0):
    rows = [(b, i + lo, float(v)) for b, row in enumerate(np.atleast_2d(values)) for i, v in enumerate(row)]
    return materialize(spark.createDataFrame(rows, f"batch int, idx long, {name} double"))


def array(df, name, shape, lo=0):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["batch"], r["idx"] - lo] = r[name]
    return out


def plain(at, nb, n0, bins, table, xi):
    """Values, their log-determinant, by dense algebra for each point."""
    r = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    K = np.interp(r, bins, table)
    L = np.linalg.cholesky(K[:n0, :n0])
    v, total = np.concatenate([L @ xi[:n0], np.zeros(len(at) - n0)]), np.log(np.diag(L)).sum()
    for i in range(n0, len(at)):
        c = nb[i - n0]
        w = np.linalg.solve(K[np.ix_(c, c)], K[c, i])
        s = np.sqrt(K[i, i] - K[c, i] @ w)
        v[i], total = w @ v[c] + s * xi[i], total + np.log(s)
    return v, total


@pytest.mark.parametrize("n,d,n0,k,kind", [(1000, 3, 100, 10, np.float64), (1000, 3, 100, 10, np.float32), (220, 6, 100, 64, np.float64)])
def test_settings(spark, n, d, n0, k, kind):
    """Coordinates in single precision give the answer in double precision, as all sums are double."""
    cov = C.matern(0, 1.0, 1.0, 1e-3, 10.0, 1000, 1e-4)
    graph, factors, at, nb = make(spark, n, d, n0, k, cov, kind=kind)
    xi = np.random.default_rng(4).standard_normal(n).astype(kind).astype(float)
    want, total = plain(at, nb, n0, cov.bins, cov.values[0], xi)
    values = materialize(generate(graph, cov, factors, frame(spark, "xi", xi)))
    assert np.allclose(array(values, "v", (1, n))[0], want, rtol=1e-9, atol=1e-9)
    back = array(generate_inv(graph, cov, factors, values), "xi", (1, n))[0]
    assert np.allclose(back, xi, atol=1e-7)
    assert np.isclose(generate_logdet(graph, cov, factors).first()["logdet"], total)


def test_derivatives_of_whole_fields(spark):
    n, n0, k = 80, 9, 3
    one = C.matern(1, 1.0, 1.0, 1e-2, 10.0, 60, 1e-3)
    cov = C.Covariance(one.bins, (one.values[0], tuple(2 * v for v in one.values[0])))
    graph, factors, at, nb = make(spark, n, 2, n0, k, cov)
    rng = np.random.default_rng(6)
    xi, dxi, v_bar = (rng.standard_normal((2, n)) for _ in range(3))
    d_tables = rng.standard_normal((2, len(one.bins))) * 1e-3
    d_cov = C.Covariance(one.bins, tuple(map(tuple, d_tables.tolist())))
    noise = frame(spark, "xi", xi)
    values = materialize(generate(graph, cov, factors, noise))
    moved = array(generate_jvp(graph, cov, factors, values, noise, d_cov, frame(spark, "dxi", dxi)), "v", (2, n))
    h = 1e-5
    for b in range(2):
        ends = [plain(at, nb, n0, cov.bins, np.array(cov.values[b]) + e * d_tables[b], xi[b] + e * dxi[b])[0] for e in (h, -h)]
        assert np.allclose(moved[b], (ends[0] - ends[1]) / (2 * h), rtol=1e-4, atol=1e-5)
    linear = array(generate_jvp(graph, cov, factors, values, noise, None, frame(spark, "dxi", dxi)), "v", (2, n))
    assert np.allclose(linear[1], plain(at, nb, n0, cov.bins, cov.values[1], dxi[1])[0])
    cov_bar, xi_bar = generate_vjp(graph, cov, factors, values, noise, frame(spark, "vbar", v_bar))
    got = np.zeros_like(d_tables)
    for r in cov_bar.collect():
        got[r["batch"], r["bin_id"]] = r["cov_bar"]
    right = (got * d_tables).sum(axis=1) + (array(xi_bar, "xi_bar", (2, n)) * dxi).sum(axis=1)
    assert np.allclose((v_bar * moved).sum(axis=1), right, rtol=1e-8)


def test_cholesky_derivatives():
    rng = np.random.default_rng(7)
    a, d, bar = rng.standard_normal((5, 5)), rng.standard_normal((5, 5)), rng.standard_normal((5, 5))
    K, dK = a @ a.T + 5 * np.eye(5), d + d.T
    L, h = np.linalg.cholesky(K), 1e-6
    dL = cholesky_jvp(L, dK)
    assert np.allclose(dL, (np.linalg.cholesky(K + h * dK) - np.linalg.cholesky(K - h * dK)) / (2 * h), atol=1e-7)
    assert np.isclose((np.tril(bar) * dL).sum(), (cholesky_vjp(L, bar) * dK).sum())


def test_shared_factors(spark):
    """Three noises under one covariance, against a covariance for each."""
    n, n0, k = 90, 10, 3
    one = C.matern(0, 1.0, 1.0, 1e-2, 10.0, 60, 1e-3)
    graph, factors, *_ = make(spark, n, 2, n0, k, one)
    each = factorize(graph, C.Covariance(one.bins, one.values * 3))
    rng = np.random.default_rng(8)
    initial, xi, bar = frame(spark, "v", rng.standard_normal((3, n0))), frame(spark, "xi", rng.standard_normal((3, n - n0)), n0), frame(spark, "vbar", rng.standard_normal((3, n)))
    values = materialize(refine(factors, initial, xi, shared=True))
    want = materialize(refine(each, initial, xi))
    assert np.allclose(array(values, "v", (3, n)), array(want, "v", (3, n)), rtol=1e-12)
    for a, b, lo in ((refine_inv(factors, values, shared=True), refine_inv(each, want), n0), (refine_transpose(factors, bar, shared=True), refine_transpose(each, bar), n0)):
        for x, y, at in ((a[0], b[0], 0), (a[1], b[1], lo)):
            name, shape = x.columns[-1], (3, n - lo if at else n0)
            assert np.allclose(array(x, name, shape, at), array(y, name, shape, at), rtol=1e-9, atol=1e-9)
    assert refine_logdet(factors).count() == 1


@pytest.mark.parametrize("together,few,merge", [(0, 0, 16), (0, 0, 2), (25, 30, 3), (1 << 16, 1 << 20, 16)])
def test_levels_alone_and_together(spark, monkeypatch, together, few, merge):
    """The same depths and values however many levels one task settles."""
    n, n0, k = 150, 8, 3
    one = C.matern(0, 1.0, 1.0, 1e-2, 10.0, 60, 1e-3)
    monkeypatch.setattr(depth, "FEW", few)
    monkeypatch.setattr(refine_module, "TOGETHER", together)
    monkeypatch.setattr(storage, "MERGE", merge)
    graph, factors, at, nb = make(spark, n, 2, n0, k, C.Covariance(one.bins, one.values * 2))
    levels = np.zeros(n, int)
    for i in range(n0, n):
        levels[i] = levels[nb[i - n0]].max() + 1
    assert [r["depth"] for r in graph.points.orderBy("idx").collect()] == levels.tolist()
    xi = np.random.default_rng(2).standard_normal((2, n))
    values = generate(graph, C.Covariance(one.bins, one.values * 2), factors, frame(spark, "xi", xi))
    want = np.array([plain(at, nb, n0, one.bins, one.values[0], x)[0] for x in xi])
    assert np.allclose(array(values, "v", (2, n)), want)
    bar = np.random.default_rng(3).standard_normal((2, n))
    first, later = refine_transpose(factors, frame(spark, "vbar", bar))
    # the transpose against the map itself, on random directions
    start, noise = np.random.default_rng(4).standard_normal((2, n0)), np.random.default_rng(5).standard_normal((2, n - n0))
    moved = array(refine(factors, frame(spark, "v", start), frame(spark, "xi", noise, n0)), "v", (2, n))
    right = (array(first, "initial_bar", (2, n0)) * start).sum(axis=1) + (array(later, "xi_bar", (2, n - n0), n0) * noise).sum(axis=1)
    assert np.allclose((bar * moved).sum(axis=1), right)


def test_repeated_ids_are_refused(spark):
    with pytest.raises(ValueError, match="differ"):
        check_points(spark.createDataFrame([(1, 0.5), (1, 0.7)], "point_id long, x0 double"))
