"""Points that are nobody's neighbour: settled at the end or the start, and in no round or level before."""

import numpy as np
import pytest

from krigstone.operators import depth
from krigstone.operators import refine as refine_module
from krigstone.storage import Growing

N0, CHAIN, N = 2, 12, 300


def graph():
    """A chain of points, and many points that hang on its end and on its start."""
    nb = [(i - 1, i - 2) for i in range(N0, N0 + CHAIN)]
    return nb + [(N0 + CHAIN - 1, i % (N0 + CHAIN)) for i in range(N0 + CHAIN, N)]


def levels(nb):
    out = [0] * N0
    for pair in nb:
        out.append(1 + max(out[j] for j in pair))
    return out


def test_rounds_of_depths(spark, monkeypatch):
    rows, plain = [], depth.materialize

    def counted(df, *args):
        out = plain(df, *args)
        rows.append(out.count() if out.columns == ["idx", "nb"] else 0)
        return out

    monkeypatch.setattr(depth, "materialize", counted)
    nb = graph()
    edges = spark.createDataFrame([(i + N0, s, j) for i, pair in enumerate(nb) for s, j in enumerate(pair)], "idx long, slot int, nb long")
    found = depth.compute_depths(edges, spark.range(N).withColumnRenamed("id", "idx"), N0, 5)
    assert [r["depth"] for r in found.orderBy("idx").collect()] == levels(nb)
    assert sum(rows) <= CHAIN * CHAIN * 2


@pytest.mark.parametrize("up", [True, False])
def test_levels_of_values(spark, monkeypatch, up):
    rows, plain = [], Growing.add

    def counted(self, df):
        rows.append(df.count())
        plain(self, df)

    monkeypatch.setattr(Growing, "add", counted)
    nb, rng = graph(), np.random.default_rng(2)
    deep, w, x = levels(nb), rng.standard_normal((len(nb), 2)) / 3, rng.standard_normal(N)
    factors = spark.createDataFrame(
        [(0, i + N0, deep[i + N0], list(p), [deep[j] for j in p], [float(c) for c in w[i]], 0.5) for i, p in enumerate(nb)],
        "batch int, idx long, depth int, nbs array<long>, nb_depths array<int>, w array<double>, s double")
    values = lambda name, lo, hi: spark.createDataFrame([(0, i, float(x[i])) for i in range(lo, hi)], f"batch int, idx long, {name} double")
    want = x.copy()
    if up:
        for i, p in enumerate(nb):
            want[i + N0] = w[i] @ want[list(p)] + 0.5 * x[i + N0]
        found = refine_module.refine(factors, values("v", 0, N0), values("xi", N0, N), together=0).collect()
        got = {r["idx"]: r["v"] for r in found}
    else:
        for i in range(len(nb) - 1, -1, -1):
            for c, j in zip(w[i], nb[i], strict=True):
                want[j] += c * want[i + N0]
        want[N0:] *= 0.5
        first, later = refine_module.refine_transpose(factors, values("vbar", 0, N), together=0)
        got = {r["idx"]: r["initial_bar"] for r in first.collect()} | {r["idx"]: r["xi_bar"] for r in later.collect()}
    assert len(got) == N and np.allclose([got[i] for i in range(N)], want)
    assert sum(rows) < N
