"""The tiled start against dense algebra, and several noises under one covariance through whole fields and derivatives."""

import numpy as np
import pytest

from krigstone.functions import covariance as C
from krigstone.operators import dense
from krigstone.operators import refine as refine_module
from krigstone.operators.factor import factorize
from krigstone.operators.generate import generate, generate_inv, generate_jvp, generate_vjp, start_factor
from krigstone.operators.graph import build_graph
from krigstone.storage import materialize

N0, TILE = 50, 14  # four rows of tiles, the last one smaller
COV = C.matern(1, 1.0, 1.0, 1e-2, 10.0, 60, 1e-3)
BOTH = C.Covariance(COV.bins, (COV.values[0], tuple(2 * v for v in COV.values[0])))


def frame(spark, name, values):
    rows = [(b, i, float(v)) for b, row in enumerate(np.atleast_2d(values)) for i, v in enumerate(row)]
    return materialize(spark.createDataFrame(rows, f"batch int, idx long, {name} double"))


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["batch"], r["idx"]] = r[name]
    return out


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(5).standard_normal((N0 + 9, 2))
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "idx long, x0 double, x1 double"), x[:N0]


def matrix(tiles, batch, column="block"):
    out = np.zeros((N0, N0))
    for r in tiles.where(f"batch = {batch}").collect():
        i, j = r["i"] * TILE, r["j"] * TILE
        width = min(TILE, N0 - j)
        block = np.frombuffer(r[column]).reshape(-1, width)
        out[i : i + len(block), j : j + width] = block
    return out


def test_tiles_against_dense_algebra(spark, points):
    frame_, x = points
    r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rng = np.random.default_rng(6)
    d_tables = rng.standard_normal((2, len(COV.bins))) * 1e-3
    d_cov = C.Covariance(COV.bins, tuple(map(tuple, d_tables.tolist())))
    L = dense.factorize_tiles(dense.covariance_tiles(frame_, N0, BOTH, d_cov, TILE), N0, TILE)
    assert L.count() == 2 * 10
    noise, bar = rng.standard_normal((2, N0)), rng.standard_normal((2, N0))
    side = dense.sides(frame(spark, "v", noise), "v", N0, False, TILE)
    vbar = dense.sides(frame(spark, "v", bar), "v", N0, False, TILE)
    products = {k: array(dense.unpack(f, "v", TILE), "v", (2, N0)) for k, f in {
        "times": dense.times(L, side, N0, tile=TILE), "transpose": dense.times(L, side, N0, transpose=True, tile=TILE), "moved": dense.times(L, side, N0, column="moved", tile=TILE),
        "forward": dense.solve(L, side, N0, tile=TILE), "backward": dense.solve(L, side, N0, transpose=True, tile=TILE)}.items()}
    logs = {r_["batch"]: r_["logdet"] for r_ in dense.logdet(L).collect()}
    bars = dense.factor_cotangent(L, dense.outer(vbar, side, N0, False, TILE), N0, TILE)
    received = np.zeros_like(d_tables)
    for row in dense.to_bins(frame_, N0, bars, BOTH, TILE).collect():
        received[row["batch"], row["bin_id"]] = row["cov_bar"]
    for b in range(2):
        K, dK = (C.lookup(np.array(COV.bins), t, r) for t in (np.array(BOTH.values[b]), d_tables[b]))
        want = np.linalg.cholesky(K)
        moved = dense.cholesky_jvp(want, dK)
        assert np.allclose(matrix(L, b), want, rtol=1e-10, atol=1e-12) and np.allclose(matrix(L, b, "moved"), moved, rtol=1e-8, atol=1e-11)
        assert np.allclose(products["times"][b], want @ noise[b]) and np.allclose(products["transpose"][b], want.T @ noise[b]) and np.allclose(products["moved"][b], moved @ noise[b], atol=1e-9)
        assert np.allclose(products["forward"][b], np.linalg.solve(want, noise[b])) and np.allclose(products["backward"][b], np.linalg.solve(want.T, noise[b]))
        assert np.isclose(logs[b], np.log(np.diag(want)).sum())
        # the adjoint of the derivative
        assert np.isclose(bar[b] @ moved @ noise[b], received[b] @ d_tables[b], rtol=1e-9)


def test_a_start_that_is_not_positive_definite(spark):
    same = spark.createDataFrame([(i, 0.5) for i in range(6)], "idx long, x0 double")
    L = dense.factorize_tiles(dense.covariance_tiles(same, 6, C.Covariance((0.0, 1.0), ((1.0, 0.0),)), tile=2), 6, 2)
    assert all(np.isnan(np.frombuffer(r["block"])).all() for r in L.collect())


def test_noises_and_a_row_for_some_only(spark):
    rows = spark.createDataFrame([(7, 0, 1.0), (7, 5, 2.0), (130, 5, 3.0), (7, 40, 9.0)], "batch int, idx long, v double")
    found = {(r["batch"], r["idx"]): r["v"] for r in dense.unpack(dense.sides(rows, "v", 6, True, 4), "v", 4).collect()}
    assert {k: v for k, v in found.items() if v} == {(7, 0): 1.0, (7, 5): 2.0, (130, 5): 3.0} and len(found) == 12


def test_many_noises_under_one_covariance(spark, monkeypatch):
    """Five noises, three to a pass, against a covariance for each; values, inverse and both derivatives."""
    monkeypatch.setattr(refine_module, "WIDE", 3)
    monkeypatch.setattr(refine_module, "TOGETHER", 30)
    n, n0, k, m = 45, 8, 3, 5
    rng = np.random.default_rng(8)
    at = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.standard_normal((n, 2)))], "point_id long, x0 double, x1 double")
    graph = build_graph(at, n0, k)
    each = C.Covariance(COV.bins, COV.values * m)
    d_row = tuple((rng.standard_normal(len(COV.bins)) * 1e-3).tolist())
    d_one, d_each = C.Covariance(COV.bins, (d_row,)), C.Covariance(COV.bins, (d_row,) * m)
    one, all_ = factorize(graph, COV), factorize(graph, each)
    xi, dxi, bar = (frame(spark, c, rng.standard_normal((m, n))) for c in ("xi", "dxi", "vbar"))
    start = materialize(start_factor(graph, COV, tile=3))
    values, want = materialize(generate(graph, COV, one, xi, shared=True, start=start, tile=3)), materialize(generate(graph, each, all_, xi))
    assert np.allclose(array(values, "v", (m, n)), array(want, "v", (m, n)), rtol=1e-11)
    assert np.allclose(array(generate_inv(graph, COV, one, values, shared=True, start=start, tile=3), "xi", (m, n)), array(xi, "xi", (m, n)), atol=1e-9)
    moved = [array(f, "v", (m, n)) for f in (generate_jvp(graph, COV, one, values, xi, d_one, dxi, shared=True, tile=3), generate_jvp(graph, each, all_, want, xi, d_each, dxi))]
    assert np.allclose(moved[0], moved[1], rtol=1e-9, atol=1e-11)
    (bins, noise), (bins_each, noise_each) = generate_vjp(graph, COV, one, values, xi, bar, shared=True, start=start, tile=3), generate_vjp(graph, each, all_, want, xi, bar)
    assert np.allclose(array(noise, "xi_bar", (m, n)), array(noise_each, "xi_bar", (m, n)), rtol=1e-9, atol=1e-11)
    got, expected = ({(r["batch"], r["bin_id"]): r["cov_bar"] for r in f.collect()} for f in (bins, bins_each))
    assert set(got) == set(expected) and all(np.isclose(got[x], expected[x], rtol=1e-8, atol=1e-10) for x in got)
