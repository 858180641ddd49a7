"""Band lookup against searchsorted, on even, growing, repeated and few bins."""

import numpy as np
import pytest

from krigstone.functions import covariance as C
from krigstone.functions.band import band, scatter_rows

GRIDS = {
    "even": np.arange(41) / 20, "growing": np.concatenate([[0.0], np.geomspace(1e-4, 10, 999)]), "squares": np.arange(1000.0) ** 2 / 4e5, "two": np.array([0.0, 1.0]),
    "repeated": np.array([0.0, 0.5, 0.5, 0.5, 2.0, 2.0]), "from above zero": np.geomspace(0.3, 7, 50), "clustered": np.concatenate([np.linspace(1, 1 + 1e-9, 30), [5.0]]), "one value": np.array([2.0, 2.0]),
}


@pytest.mark.parametrize("kind", GRIDS)
def test_equals_searchsorted(spark, kind):
    bins, rng = GRIDS[kind], np.random.default_rng(4)
    cov = C.Covariance(tuple(bins.tolist()), (tuple(rng.standard_normal(len(bins)).tolist()),) * 2)
    inner = rng.uniform(bins[0], bins[-1], 300)
    near = np.concatenate([bins, np.nextafter(bins, np.inf), np.nextafter(bins, -np.inf)])
    r = np.concatenate([inner, rng.choice(bins, 100) * rng.uniform(0.5, 1.5, 100), near, [0.0, 1e-300, 1e6, -1.0, float("inf")]])
    rows = spark.createDataFrame([(i, float(x), float(i % 5), 3) for i, x in enumerate(r)] + [(-1, None, 1.0, 3)], "id long, r double, bar double, lo_ int")
    lo, hi, t = C.weights(bins, np.minimum(r, 1e300))
    found = {x["id"]: x for x in band(rows, cov, "r", batch=1).collect()}
    assert len(found) == len(r) + 1 and found[-1]["val"] is None and found[-1]["lo"] is None
    for i in range(len(r)):
        x = found[i]
        assert (x["lo"], x["hi"]) == (lo[i], hi[i]) or t[i] == x["t"] == 0, (kind, r[i], x, lo[i], hi[i])
        assert np.isclose(x["t"], t[i]) and np.isclose(x["val"], C.lookup(bins, np.array(cov.values[0]), np.minimum(r[i : i + 1], 1e300))[0])
    got = np.zeros(len(bins))
    for x in scatter_rows(rows, cov, "r", "bar").collect():
        got[x["bin_id"]] = x["val"]
    want = np.bincount(lo, np.arange(len(r)) % 5 * (1 - t), len(bins)) + np.bincount(hi, np.arange(len(r)) % 5 * t, len(bins))
    assert np.allclose(got, want)
