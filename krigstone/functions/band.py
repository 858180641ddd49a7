"""Band lookup: for each distance the two bins around it, by a grid over the bins.

Cells of the grid are numbered by arithmetic on the distance, evenly or evenly in its logarithm, whichever spreads
the bins better; both never decrease with the distance.  Each cell's row holds the bins that lie in it and one on
either side, so a distance meets its cell in an equi-join and is compared with these few bins, however
many there are in all.  Bins and distances are numbered by the same engine, so that rounding can't part them.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .covariance import Covariance

#: Cells for each bin.
FINE = 2


def _numbering(bins: tuple[float, ...]):
    """A function from a distance column to its cell, 0 to FINE * bins at most."""
    most = FINE * len(bins)
    positive = [b for b in bins if b > 0]
    low, high = bins[0], bins[-1]
    even = most / (high - low) if high > low else 0.0
    choices = {"even": lambda b: math.floor((b - low) * even)}
    if len(positive) > 1 and positive[-1] > positive[0]:
        start, step = math.log(positive[0]), most / (math.log(positive[-1]) - math.log(positive[0]))
        choices["logarithmic"] = lambda b: math.floor((math.log(b) - start) * step) if b > 0 else 0
    fullest = {kind: max(Counter(map(f, bins)).values()) for kind, f in choices.items()}
    kind = min(fullest, key=fullest.get)

    def cell(r: Column) -> Column:
        if kind == "even":
            place = (r - low) * even
        else:
            place = F.when(r > 0, (F.log(r) - start) * step).otherwise(0.0)
        return F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(float(most)))).cast("int")

    return cell, most


def _cells(spark: SparkSession, cov: Covariance, batch: int, cell, most: int) -> DataFrame:
    """cell, first (bins before those listed) and near: (r, val) of its bins, the last one before and the next one.

    At most FINE * bins + 1 rows, with three entries for each bin and cell on average."""
    table = Covariance(cov.bins, (cov.values[batch],)).table(spark).select("bin_id", "r", "val", cell(F.col("r")).alias("cell"))
    # a bin serves its own cell, those up to the next bin's cell, and those down to the last one's
    along = Window.orderBy("bin_id")  # bins only, MOST_BINS at most
    down, up = F.coalesce(F.lag("cell").over(along), F.lit(0)), F.coalesce(F.lead("cell").over(along), F.lit(most))
    reach = table.select("bin_id", "r", "val", down.alias("down"), up.alias("up"))
    spread = reach.select("bin_id", "r", "val", F.explode(F.sequence("down", "up")).alias("cell"))
    return spread.groupBy("cell").agg(F.min("bin_id").alias("first"), F.sort_array(F.collect_list(F.struct("bin_id", "r", "val"))).alias("near"))


def band(df: DataFrame, cov: Covariance, r: str, batch: int = 0, names: tuple[str, str, str, str] = ("lo", "hi", "t", "val")) -> DataFrame:
    """df with the bins below and above each distance, the weight of the upper one, and the value between them.

    A distance at or below the first bin, or above the last one, has that bin twice and weight 0.  Null distances have nulls.
    """
    cell, most = _numbering(cov.bins)
    cells = _cells(df.sparkSession, cov, batch, cell, most).select(F.col("cell").alias("_cell"), F.col("first").alias("_first"), F.col("near").alias("_near"))
    met = df.withColumn("_cell", cell(F.col(r))).join(F.broadcast(cells), "_cell", "left")
    j = F.size(F.filter("_near", lambda b: b["r"] < F.col(r)))
    at = lambda k, field: F.get(F.col(f"_near.{field}"), F.least(F.greatest(k, F.lit(0)), F.size("_near") - 1))
    met = met.withColumn("_j", j)
    lo, hi = at(F.col("_j") - 1, "bin_id"), at(F.col("_j"), "bin_id")
    r0, r1, v0, v1 = at(F.col("_j") - 1, "r"), at(F.col("_j"), "r"), at(F.col("_j") - 1, "val"), at(F.col("_j"), "val")
    t = F.when(r1 > r0, (F.col(r) - r0) / (r1 - r0)).otherwise(0.0)
    value = F.when(r1 > r0, v0 + (v1 - v0) * (F.col(r) - r0) / (r1 - r0)).otherwise(v0)
    known = F.col("_first").isNotNull() & F.col(r).isNotNull()
    columns = [F.when(known, c).alias(n) for c, n in zip((lo, hi, t, value), names, strict=True)]
    return met.select(*df.columns, *columns)


def scatter_rows(df: DataFrame, cov: Covariance, r: str, cotangent: str) -> DataFrame:
    """bin_id, val: the transpose of the lookup over a table of distances and cotangents."""
    placed = band(df.select(F.col(r).alias("r"), F.col(cotangent).alias("bar")), cov, "r")
    parts = F.array(F.struct(F.col("lo").alias("bin_id"), (F.col("bar") * (1 - F.col("t"))).alias("val")), F.struct(F.col("hi").alias("bin_id"), (F.col("bar") * F.col("t")).alias("val")))
    return placed.where("lo is not null").select(F.explode(parts).alias("p")).groupBy("p.bin_id").agg(F.sum("p.val").alias("val"))
