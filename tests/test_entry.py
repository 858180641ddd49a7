"""The entry points, and queries against their SQL on the small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from krigstone import queries as graph_queries
from krigstone import storage

SMALL = "/root/testdata/sf0.001"
CHECKED = ["tree_build", "tree_navigation", "knn_preceding", "order_by_depth", "cov_lookup", "factor_weights", "refine_values", "refine_inverse", "sort_4"]


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(3).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(graph_queries.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    found = graph_queries.queries()[name](spark, SMALL).toPandas()
    base = duckdb.connect()
    for file in os.listdir(SMALL):
        base.execute(f"create view {file.split('.')[0]} as select * from '{SMALL}/{file}'")
    want = base.execute(graph_queries.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).itertuples(index=False)))
    assert rows(found) == rows(want)


def test_missing_and_broken_modules(monkeypatch, tmp_path):
    assert entry._optional("krigstone.nothing_here") is None and entry._optional("nothing_here.queries") is None
    (tmp_path / "broken_module.py").write_text("import nothing_here")
    monkeypatch.syspath_prepend(tmp_path)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_module")


def test_tables_are_removed(spark):
    table = storage.materialize(spark.range(5))
    assert table.count() == 5 and storage.remove_tables(spark) > 0 and storage.remove_tables(spark) == 0
    graph_queries.forget()
    with pytest.raises(Exception, match="(?i)does not exist|no such file|FILE_NOT_EXIST"):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_shared_tables_are_built_anew_after_removal(spark):
    before = graph_queries._tree(spark, SMALL)
    assert graph_queries._tree(spark, SMALL) is before
    storage.remove_tables(spark)
    after = graph_queries._tree(spark, SMALL)
    assert after is not before and after.count() == 500


def test_growing_tables_are_merged(spark, monkeypatch):
    monkeypatch.setattr(storage, "MERGE", 3)
    table = storage.Growing(spark, "idx long, v double", "depth", lambda df: df.groupBy("idx", "depth").agg(F.sum("v").alias("v")))
    paths, old = [], None
    for i in range(7):
        table.add(spark.range(4).selectExpr("id as idx", "1D as v", "cast(id % 2 as int) as depth"))
        paths.append(table.path)
        old = table.read() if i == 1 else old
    assert len(set(paths)) == 3 and len(table.read().inputFiles()) < 7 * 4
    assert {(r["idx"], r["s"]) for r in table.read().groupBy("idx").agg(F.sum("v").alias("s")).collect()} == {(i, 7.0) for i in range(4)}
    assert table.read().count() == 4 * 2 and old.count() == 4 * 2  # once merged and once more; what was read before stays readable
