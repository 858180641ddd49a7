"""Comparison of the members that are left in a large bucket."""

import random

import numpy as np
import pytest

from krigstone.llm import setsketch


def test_groups_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    monkeypatch.setattr(setsketch, "partitions", lambda spark: 1)
    rng, n, sizes = np.random.default_rng(5), 1200, []
    sketches = rng.integers(0, 60000, (n, setsketch.REGISTERS), dtype=np.uint16)
    sketches[n // 2 :] = sketches[: n // 2]  # the only pairs that may be linked
    left = spark.createDataFrame([(1, i, i, False) for i in range(n)], "band long, rep long, comp long, near boolean")
    kept = spark.createDataFrame([(i, 100, bytearray(sketches[i].tobytes())) for i in range(n)], "rep long, n_set long, registers binary")
    grouped = type(left).groupBy

    def counted(self, *by):
        if by == ("bin",):
            sizes.extend(r["count"] for r in grouped(self, "bin").count().collect())
        return grouped(self, *by)

    monkeypatch.setattr(type(left), "groupBy", counted)
    found = setsketch._block_pairs(left, kept).collect()
    assert sorted((r["a"], r["b"]) for r in found) == [(i, i + n // 2) for i in range(n // 2)]
    assert sum(sizes) == n * (n // 8) and np.mean(sizes) < 80 and max(sizes) < 40 * 8


@pytest.mark.parametrize(("rows", "bins"), [(0, 96), (393216, 96), (2 * 10**9, 488282)])
def test_groups_grow_with_the_rows(rows, bins):
    assert setsketch._bins(rows, 12) == bins


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Pages of one template, each with contents of its own, and a few copies of these with edits."""
    from test_small_operators import check_components

    rng = random.Random(3)
    template = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(90):
        rows.append((i, " ".join(template + [f"c{rng.randrange(10**6)}" for _ in range(60 + i % 7)])))
    for i in range(90, 130):  # near to another page, not to the template
        words = rows[rng.randrange(90)][1].split()
        for _ in range(rng.randrange(3)):
            words[150 + rng.randrange(50)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(setsketch, "CROWD", 4)
    check_components(spark, rows)
    # the new buckets themselves: as if all were left in one
    left = spark.createDataFrame([(1, i, i, False) for i, _ in rows], "band long, rep long, comp long, near boolean")
    dealt = setsketch._by_rare_elements(left, spark.createDataFrame(rows, "rep long, text string")).collect()
    members = {}
    for r in dealt:
        members.setdefault(r["band"], set()).add(r["rep"])
    assert max(map(len, members.values())) < 12  # none holds the pages of the template
    met = {(a, b) for m in members.values() for a in m for b in m if a < b}
    sets = {i: set(setsketch.shingle_set(t).tolist()) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and setsketch.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))}
    assert len(links) > 30 and links <= met and len(met) < len(sets) ** 2 / 10
