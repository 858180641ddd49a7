"""Substring dedup where one doc_id has several texts."""

import pytest
from test_small_operators import plain_dedup

from krigstone.llm import seed_extend


@pytest.mark.parametrize("parts", [1, 10**6])  # no hot anchors, or many
def test_substrings_of_two_texts_under_one_id(spark, monkeypatch, parts):
    monkeypatch.setattr(seed_extend, "partitions", lambda spark: parts)
    common, own = (" ".join(f"{c}{k}" for k in range(30)) for c in "pq")
    rows = [(1, common), (2, "x " + common + " y"), (2, own), (2, own), (2, own + " z"), (3, own), (3, None), (None, own)] + [(i, "x " + common) for i in range(4, 9)]
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in seed_extend.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == plain_dedup(rows)
