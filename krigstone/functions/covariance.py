"""Tabulated covariances: values at ascending distances, linear between, constant outside.

A Covariance is small (its table has a fixed number of bins, whatever the data), so it travels
inside the functions that use it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MOST_BINS = 1 << 16
#: Values of all batches that are read from a table.
MOST_ROWS = MOST_BINS * 64


@dataclass(frozen=True)
class Covariance:
    bins: tuple[float, ...]
    values: tuple[tuple[float, ...], ...]  # one table of values for each batch

    def __post_init__(self):
        if not 2 <= len(self.bins) <= MOST_BINS or any(len(v) != len(self.bins) for v in self.values):
            raise ValueError("a covariance needs as many values as bins")
        if any(not a <= b for a, b in zip(self.bins, self.bins[1:], strict=False)) or not all(map(math.isfinite, self.bins)):
            raise ValueError("bins must ascend")

    def table(self, spark: SparkSession) -> DataFrame:
        """batch, bin_id, r, val."""
        rows = [(b, i, r, v) for b, vs in enumerate(self.values) for i, (r, v) in enumerate(zip(self.bins, vs, strict=True))]
        return spark.createDataFrame(rows, "batch int, bin_id int, r double, val double")

    @staticmethod
    def from_table(table: DataFrame) -> Covariance:
        n_rows = table.count()
        if n_rows > MOST_ROWS:
            raise ValueError(f"a covariance has {MOST_ROWS} values at most, not {n_rows}")
        rows = table.orderBy("batch", "bin_id").select("batch", "r", "val").collect()
        batches = sorted({r["batch"] for r in rows})
        pick = lambda b, c: tuple(r[c] for r in rows if r["batch"] == b)
        return Covariance(pick(batches[0], "r"), tuple(pick(b, "val") for b in batches))


def matern(p: int = 0, variance=1.0, cutoff=1.0, r_min=1e-4, r_max=10.0, n_bins=1000, jitter=1e-5) -> Covariance:
    """Matern covariance of smoothness p + 1/2 on 0 and a geometric grid; jitter adds to distance 0."""
    r = np.concatenate([[0.0], np.geomspace(r_min, r_max, n_bins - 1)])
    s = math.sqrt(2 * p + 1) * r / cutoff
    poly = sum(math.factorial(p + i) / (math.factorial(i) * math.factorial(p - i)) * (2 * s) ** (p - i) for i in range(p + 1))
    value = variance * math.factorial(p) / math.factorial(2 * p) * poly * np.exp(-s)
    value[0] = variance * (1 + jitter)
    return Covariance(tuple(r.tolist()), (tuple(value.tolist()),))


def weights(bins: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bin, upper bin and the upper one's weight for each distance."""
    j = np.searchsorted(bins, r, side="left")
    lo, hi = np.clip(j - 1, 0, len(bins) - 1), np.clip(j, 0, len(bins) - 1)
    gap = bins[hi] - bins[lo]
    t = np.where(gap > 0, (r - bins[lo]) / np.where(gap > 0, gap, 1), 0.0)
    return lo, hi, t


def lookup(bins: np.ndarray, values: np.ndarray, r: np.ndarray) -> np.ndarray:
    lo, hi, t = weights(bins, r)
    return values[lo] + (values[hi] - values[lo]) * t


def scatter(bins: np.ndarray, r: np.ndarray, cotangent: np.ndarray) -> np.ndarray:
    """The transpose of lookup in its values: what each bin receives."""
    lo, hi, t = weights(bins, r)
    n = len(bins)
    return np.bincount(lo.ravel(), (cotangent * (1 - t)).ravel(), n) + np.bincount(hi.ravel(), (cotangent * t).ravel(), n)
