"""Covariances from tables above the bound."""

import pytest

from krigstone.functions import covariance as C


def test_large_tables_are_refused(spark):
    table = spark.range(2049 * 2048).selectExpr("cast(id div 2048 as int) batch", "cast(id % 2048 as int) bin_id", "double(id % 2048) r", "1d val")
    with pytest.raises(ValueError, match="4196352"):
        C.Covariance.from_table(table)
