"""Refinement, its inverse, determinants and derivatives against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from krigstone.functions import covariance as C
from krigstone.functions.band import band, scatter_rows
from krigstone.operators.deriv import refine_jvp, refine_vjp
from krigstone.operators.factor import conditional, factorize
from krigstone.operators.generate import generate, generate_inv, generate_logdet
from krigstone.operators.graph import build_graph
from krigstone.operators.refine import refine, refine_inv, refine_logdet, refine_transpose
from krigstone.storage import materialize

N, N0, K = 120, 12, 3


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(99)
    rows = [(i, *map(float, r)) for i, r in enumerate(rng.standard_normal((N, 2)))]
    graph = build_graph(spark.createDataFrame(rows, "point_id long, x0 double, x1 double"), N0, K)
    one = C.matern(0, 1.0, 1.0, 1e-3, 10.0, 200, 1e-5)
    cov = C.Covariance(one.bins, (one.values[0], tuple(2 * v for v in one.values[0])))
    factors = factorize(graph, cov)
    x = np.array([[r["x0"], r["x1"]] for r in graph.points.orderBy("idx").collect()])
    nb = np.array([r["nb"] for r in graph.edges.orderBy("idx", "slot").collect()]).reshape(-1, K)
    xi = np.random.default_rng(1).standard_normal((2, N))
    return {"graph": graph, "cov": cov, "factors": factors, "x": x, "nb": nb, "xi": xi}


def frame(spark, name, values, lo=0):
    rows = [(b, i + lo, float(v)) for b, row in enumerate(values) for i, v in enumerate(row)]
    return materialize(spark.createDataFrame(rows, f"batch int, idx long, {name} double"))


def array(df, name, lo=0):
    rows = df.collect()
    out = np.full((2, N - lo), np.nan)
    for r in rows:
        out[r["batch"], r["idx"] - lo] = r[name]
    return out


def plain(case, tables, initial, xi):
    r = np.sqrt(((case["x"][:, None] - case["x"][None]) ** 2).sum(axis=2))
    out, logs = [], []
    for values, start, noise in zip(tables, initial, xi, strict=True):
        cov = np.interp(r, case["cov"].bins, values)
        v, total = np.concatenate([start, np.zeros(N - N0)]), 0.0
        for i in range(N0, N):
            c = case["nb"][i - N0]
            w = np.linalg.solve(cov[np.ix_(c, c)], cov[c, i])
            s = np.sqrt(cov[i, i] - cov[c, i] @ w)
            v[i] = w @ v[c] + s * noise[i - N0]
            total += np.log(s)
        out.append(v)
        logs.append(total)
    return np.array(out), np.array(logs)


def test_refine_inverse_and_logdet(spark, case):
    initial, noise = case["xi"][:, :N0], case["xi"][:, N0:]
    want, logs = plain(case, case["cov"].values, initial, noise)
    values = materialize(refine(case["factors"], frame(spark, "v", initial), frame(spark, "xi", noise, N0)))
    assert np.allclose(array(values, "v"), want, rtol=1e-12, atol=1e-12)
    first, xi = refine_inv(case["factors"], values)
    assert np.allclose(array(xi, "xi", N0), noise, atol=1e-10) and first.count() == 2 * N0
    found = {r["batch"]: r["logdet"] for r in refine_logdet(case["factors"]).collect()}
    assert np.allclose([found[0], found[1]], logs)


def test_generate(spark, case):
    xi = frame(spark, "xi", case["xi"])
    values = materialize(generate(case["graph"], case["cov"], case["factors"], xi))
    assert np.allclose(array(generate_inv(case["graph"], case["cov"], case["factors"], values), "xi"), case["xi"], atol=1e-9)
    found = {r["batch"]: r["logdet"] for r in generate_logdet(case["graph"], case["cov"], case["factors"]).collect()}
    assert np.isclose(found[1] - found[0], N * np.log(2) / 2)


def test_derivatives(spark, case):
    rng = np.random.default_rng(5)
    initial, noise = case["xi"][:, :N0], case["xi"][:, N0:]
    d_initial, d_noise, v_bar = rng.standard_normal((2, N0)), rng.standard_normal((2, N - N0)), rng.standard_normal((2, N))
    bins = case["cov"].bins
    d_tables = rng.standard_normal((2, len(bins))) * 0.01
    d_cov = C.Covariance(bins, tuple(map(tuple, d_tables.tolist())))
    factors, graph, cov = case["factors"], case["graph"], case["cov"]
    xi = frame(spark, "xi", noise, N0)
    values = materialize(refine(factors, frame(spark, "v", initial), xi))
    moved = array(refine_jvp(graph, cov, factors, values, xi, d_cov, frame(spark, "v", d_initial), frame(spark, "dxi", d_noise, N0)), "v")
    h = 1e-5
    ends = [plain(case, np.array(cov.values) + e * d_tables, initial + e * d_initial, noise + e * d_noise)[0] for e in (h, -h)]
    assert np.allclose(moved, (ends[0] - ends[1]) / (2 * h), rtol=1e-5, atol=1e-6)
    linear = array(refine_jvp(graph, cov, factors, values, xi, None, frame(spark, "v", d_initial), frame(spark, "dxi", d_noise, N0)), "v")
    assert np.allclose(linear, plain(case, cov.values, d_initial, d_noise)[0])
    cov_bar, initial_bar, xi_bar = refine_vjp(graph, cov, factors, values, xi, frame(spark, "vbar", v_bar))
    got = np.zeros_like(d_tables)
    for r in cov_bar.collect():
        got[r["batch"], r["bin_id"]] = r["cov_bar"]
    right = (got * d_tables).sum(axis=1) + np.nansum(array(initial_bar, "initial_bar")[:, :N0] * d_initial, axis=1) + (array(xi_bar, "xi_bar", N0) * d_noise).sum(axis=1)
    assert np.allclose((v_bar * moved).sum(axis=1), right, rtol=1e-9)
    transposed = refine_transpose(factors, frame(spark, "vbar", v_bar))
    assert np.allclose(array(transposed[1], "xi_bar", N0), array(xi_bar, "xi_bar", N0))


def test_singular_points_give_nan():
    K_ = np.stack([np.eye(3), np.ones((3, 3))])
    w, s = conditional(K_)
    assert np.allclose(w[0], 0) and s[0] == 1 and np.isnan(w[1]).all() and np.isnan(s[1])


def test_covariance(spark):
    bins, values = np.array([0.0, 1.0, 3.0]), np.array([2.0, 1.0, 0.0])
    r = np.array([0.0, 0.5, 1.0, 2.0, 3.0, 9.0])
    assert np.allclose(C.lookup(bins, values, r), np.interp(r, bins, values))
    cov = C.Covariance(tuple(bins.tolist()), (tuple(values.tolist()),))
    df = spark.createDataFrame([(float(x), 1.0) for x in r], "r double, bar double")
    assert np.allclose([row["c"] for row in band(df, cov, "r").select("r", F.col("val").alias("c")).orderBy("r").collect()], np.interp(r, bins, values))
    rows = scatter_rows(df, cov, "r", "bar").collect()
    assert np.allclose([x["val"] for x in sorted(rows, key=lambda x: x["bin_id"])], C.scatter(bins, r, np.ones(6)))
    assert C.Covariance.from_table(cov.table(spark)) == cov
    assert np.isclose(C.matern(1, 2.0, 0.5).values[0][0], 2.0 * (1 + 1e-5))
    with pytest.raises(ValueError):
        C.Covariance((1.0, 0.0), ((1.0, 1.0),))
