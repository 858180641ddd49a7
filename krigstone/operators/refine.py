"""White noise to correlated values along the graph, back, and the linear maps between them.

Values are tables (batch, idx, <value>).  Levels of equal depth depend only on lower ones.  Edges are
laid out by the depth at which their values become known: once a level's values are, they flow along
the edges that start there to the points above (or, in the transpose, below), where they are added up.
So each edge is read once, in one join and one aggregation a level, and each value twice.  Consecutive levels
that have few points together are settled in one task a batch, as a deep graph ends in many thin levels.
Points that are nobody's neighbour, half of them or more, take no part in the levels: one join and one aggregation serve all of them.
The inverse and the log-determinant need no levels.

``shared`` means that the factors of one covariance, batch 0, serve all batches of the values, which are then
noises: up to WIDE of them are columns of one table and flow along each edge together, so edges are read
once for all.  A noise without a row for a point counts as 0 there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Growing, materialize
from .factor import spread

#: Points of all batches in levels that are settled together.
TOGETHER = 1 << 16
#: Noises that flow together.
WIDE = 64
KEYS = ["batch", "idx"]


def passes(shared: bool, *tables: DataFrame) -> list[list[int] | None]:
    """The noises of each pass, up to WIDE; None without shared factors, where there is one pass for all."""
    if not shared:
        return [None]
    every = reduce(DataFrame.unionByName, (t.select("batch") for t in tables)).distinct()
    ids = sorted(r["batch"] for r in every.collect())  # a row a noise
    return [ids[i : i + WIDE] for i in range(0, len(ids), WIDE)]


def names(ids: list[int] | None) -> list[str]:
    return [f"c{i}" for i in range(1 if ids is None else len(ids))]


def columns(values: DataFrame, name: str, ids: list[int] | None) -> DataFrame:
    """batch, idx and a column for each noise; without shared factors the one column c0."""
    if ids is None:
        return values.select(*KEYS, F.col(name).alias("c0"))
    each = [F.coalesce(F.max(F.when(F.col("batch") == b, F.col(name))), F.lit(0.0)).alias(c) for b, c in zip(ids, names(ids), strict=True)]
    return values.where(F.col("batch").isin(ids)).groupBy("idx").agg(*each).select(F.lit(0).alias("batch"), "idx", *names(ids))


def rows(wide: DataFrame, name: str, ids: list[int] | None) -> DataFrame:
    """batch, idx, name: the columns of ``columns`` as rows again."""
    if ids is None:
        return wide.select(*KEYS, F.col("c0").alias(name))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("batch"), F.col(c).alias(name)) for b, c in zip(ids, names(ids), strict=True)))).alias("e")
    return wide.select("idx", each).select("e.batch", "idx", f"e.{name}")


def of(factors: DataFrame, shared: bool) -> DataFrame:
    return factors.where("batch = 0") if shared else factors


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _levels(factors: DataFrame, together: int | None) -> list[list[int]]:
    """The depths that occur, ascending, in groups of those that are settled together."""
    groups, held, most = [], 0, TOGETHER if together is None else together
    for r in factors.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth").collect():  # a row a level
        if groups and held + r["n"] <= most:
            groups[-1].append(r["depth"])
            held += r["n"]
        else:
            groups.append([r["depth"]])
            held = r["n"]
    return groups


def _settled(edges: DataFrame, received: Growing, value: list[str], group: list[int], up: bool) -> DataFrame:
    """What the points of a group of levels receive from others of the group: batch, idx, values, depth."""
    low, high = group[0], group[-1]
    inside = F.col("depth").between(low + 1, high) & F.col("nb_depth").between(low, high - 1)
    inner = edges.where(inside).select(F.col("batch").alias("of"), "idx", "nb", "depth", "nb_depth", "w")
    known = received.read().where(F.col("depth").between(low, high)).groupBy("batch", "idx", "depth").agg(*(F.sum(c).alias(c) for c in value))

    def run(points: pa.Table, links: pa.Table) -> pa.Table:
        own, v0 = points.column("idx").to_numpy(), np.column_stack([points.column(c).to_numpy() for c in value])
        idx, nb, depth, nb_depth, w = (links.column(c).to_numpy() for c in ("idx", "nb", "depth", "nb_depth", "w"))
        every, first = np.unique(np.concatenate([own, idx, nb]), return_index=True)
        level = np.concatenate([points.column("depth").to_numpy(), depth, nb_depth])[first]
        v = np.zeros((len(every), len(value)))
        v[np.searchsorted(every, own)] = v0
        start = v.copy()
        source, target = np.searchsorted(every, nb if up else idx), np.searchsorted(every, idx if up else nb)
        # edges by level and, within it, by the point that receives
        order = np.lexsort((target, depth if up else -depth))
        source, target, w, depth = source[order], target[order], w[order], depth[order]
        cuts = [0, *(np.flatnonzero(np.diff(depth)) + 1).tolist(), len(depth)] if len(depth) else []
        for a, e in zip(cuts, cuts[1:], strict=False):  # one level after the other
            starts = np.flatnonzero(np.append(True, np.diff(target[a:e]) != 0))
            v[target[a:e][starts]] += np.add.reduceat(w[a:e, None] * v[source[a:e]], starts, axis=0)
        got = np.unique(target)
        batch = (points if points.num_rows else links).column("batch" if points.num_rows else "of").to_numpy()[:1]
        change = (v - start)[got]
        return pa.table({"batch": pa.array(np.repeat(batch, len(got)), pa.int32()), "idx": every[got], **{c: change[:, i] for i, c in enumerate(value)}, "depth": pa.array(level[got], pa.int32())})

    schema = f"batch int, idx long, {', '.join(f'{c} double' for c in value)}, depth int"
    return known.groupBy("batch").cogroup(inner.groupBy("of")).applyInArrow(run, schema)


def _parted(factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The factors (without s) of points that are a neighbour of others, and of those that aren't."""
    asked = factors.select("batch", F.explode("nbs").alias("idx")).distinct().withColumn("inner", F.lit(1))
    marked = factors.select(*KEYS, "depth", "nbs", "nb_depths", "w").join(asked, KEYS, "left").withColumn("inner", F.coalesce("inner", F.lit(0)))
    marked = materialize(marked, by="inner")
    return marked.where("inner = 1").drop("inner"), marked.where("inner = 0").drop("inner")


def _edges(factors: DataFrame, by: str) -> DataFrame:
    return materialize(spread(factors).select("batch", "idx", "depth", "nb", "nb_depth", "w"), by=by)


def _received(factors: DataFrame, value: list[str]) -> Growing:
    return Growing(
        factors.sparkSession, f"batch int, idx long, {', '.join(f'{c} double' for c in value)}", by="depth",
        merge=lambda received: received.groupBy(*KEYS, "depth").agg(*(F.sum(c).alias(c) for c in value)))


def _flow(value: list[str]) -> list:
    return [F.sum(F.col("w") * F.col(c)).alias(c) for c in value]


def solve_forward(factors: DataFrame, source: DataFrame, initial: DataFrame, value: list[str], together: int | None = None) -> DataFrame:
    """batch, idx, values v with v = initial, and above it v_i = sum_j w_ij v_nb(j) + source_i."""
    inner, outer = _parted(factors)
    edges = _edges(inner, "nb_depth")
    own = source.join(inner.select(*KEYS, "depth"), KEYS)
    # what each point receives, laid out by its depth: its source, then the flows from below
    received = _received(factors, value)
    received.add(own.select(*KEYS, *value, "depth").unionByName(initial.select(*KEYS, *value, F.lit(0).alias("depth"))))
    groups = _levels(inner, together)
    for group in [[0], *groups]:
        low, high = group[0], group[-1]
        if low < high:
            received.add(_settled(edges, received, value, group, up=True))
        if groups and high < groups[-1][-1]:
            known = received.read().where(F.col("depth").between(low, high)).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in value)).withColumnRenamed("idx", "nb")
            sent = edges.where(F.col("nb_depth").between(low, high) & (F.col("depth") > high)).join(known, ["batch", "nb"])
            received.add(sent.groupBy(*KEYS, "depth").agg(*_flow(value)).select(*KEYS, *value, "depth"))
    known = materialize(received.read().groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in value)))
    flows = spread(outer).select(*KEYS, "nb", "w").join(known.withColumnRenamed("idx", "nb"), ["batch", "nb"]).select(*KEYS, *((F.col("w") * F.col(c)).alias(c) for c in value))
    last = flows.unionByName(source.select(*KEYS, *value).join(outer.select(*KEYS), KEYS)).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in value))
    return known.unionByName(last)


def solve_backward(factors: DataFrame, cotangent: DataFrame, value: list[str], together: int | None = None) -> DataFrame:
    """batch, idx, values: cotangent (batch, idx, values) plus what flows back from later points."""
    inner, outer = _parted(factors)
    edges = _edges(inner, "depth")
    last = materialize(cotangent.select(*KEYS, *value).join(outer.select(*KEYS), KEYS))
    own = cotangent.join(outer.select(*KEYS), KEYS, "left_anti").join(inner.select(*KEYS, "depth"), KEYS, "left")
    # what each point receives, laid out by its depth: its cotangent, then the flows from above, those of outer points first
    received = _received(factors, value)
    flow = spread(outer).join(last, KEYS).groupBy("batch", "nb", "nb_depth").agg(*_flow(value))
    received.add(own.select(*KEYS, *value, F.coalesce("depth", F.lit(0)).alias("depth")).unionByName(flow.select("batch", F.col("nb").alias("idx"), *value, F.col("nb_depth").alias("depth"))))
    for group in reversed(_levels(inner, together)):
        low, high = group[0], group[-1]
        if low < high:
            received.add(_settled(edges, received, value, group, up=False))
        total = received.read().where(F.col("depth").between(low, high)).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in value))
        sent = edges.where(F.col("depth").between(low, high) & (F.col("nb_depth") < low)).join(total, KEYS)
        flow = sent.groupBy("batch", "nb", "nb_depth").agg(*_flow(value))
        received.add(flow.select("batch", F.col("nb").alias("idx"), *value, F.col("nb_depth").alias("depth")))
    return received.read().groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in value)).unionByName(last)


def scaled(factors: DataFrame, noise: DataFrame, value: list[str]) -> DataFrame:
    """batch, idx, values: s times the noise, 0 where there is none."""
    own = factors.select(*KEYS, "s").join(noise, KEYS, "left")
    return own.select(*KEYS, *((F.col("s") * F.coalesce(c, F.lit(0.0))).alias(c) for c in value))


def each_pass(shared: bool, tables: list[DataFrame], make: Callable[[list[int] | None], DataFrame]) -> DataFrame:
    return union([make(ids) for ids in passes(shared, *tables)])


def refine(factors: DataFrame, initial: DataFrame, xi: DataFrame, shared: bool = False, together: int | None = None) -> DataFrame:
    """batch, idx, v from initial (batch, idx, v) and noise xi (batch, idx, xi)."""
    own = of(factors, shared)

    def make(ids):
        value = names(ids)
        source = own.select(*KEYS, "s").join(columns(xi, "xi", ids), KEYS).select(*KEYS, *((F.col("s") * F.col(c)).alias(c) for c in value))
        return rows(solve_forward(own, source, columns(initial, "v", ids), value, together), "v", ids)

    return each_pass(shared, [initial, xi], make)


def back(factors: DataFrame, cotangent: DataFrame, shared: bool, together: int | None = None) -> list[tuple[list[int] | None, DataFrame]]:
    """The cotangents of all values, as columns, for each pass."""
    own = of(factors, shared)
    return [(ids, materialize(solve_backward(own, columns(cotangent, "vbar", ids), names(ids), together))) for ids in passes(shared, cotangent)]


def bars(factors: DataFrame, ids: list[int] | None, vbar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, idx, initial_bar) and (batch, idx, xi_bar) from what ``back`` gives."""
    initial_bar = vbar.join(factors.select(*KEYS), KEYS, "left_anti")
    return rows(initial_bar, "initial_bar", ids), rows(scaled(factors, vbar, names(ids)), "xi_bar", ids)


def refine_transpose(factors: DataFrame, cotangent: DataFrame, shared: bool = False, together: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(batch, idx, initial_bar) and (batch, idx, xi_bar) from a cotangent (batch, idx, vbar)."""
    found = [bars(of(factors, shared), ids, vbar) for ids, vbar in back(factors, cotangent, shared, together)]
    return union([f[0] for f in found]), union([f[1] for f in found])


def refine_inv(factors: DataFrame, values: DataFrame, shared: bool = False) -> tuple[DataFrame, DataFrame]:
    """(batch, idx, v) below n0 and (batch, idx, xi) from values (batch, idx, v): one join, no levels."""
    own = of(factors, shared)

    def make(ids):
        value = names(ids)
        known = columns(values, "v", ids)
        mean = spread(own).join(known.withColumnRenamed("idx", "nb"), ["batch", "nb"]).groupBy(*KEYS).agg(*(F.sum(F.col("w") * F.col(c)).alias(f"mean_{c}") for c in value))
        xi = mean.join(own.select(*KEYS, "s"), KEYS).join(known, KEYS).select(*KEYS, *(((F.col(c) - F.col(f"mean_{c}")) / F.col("s")).alias(c) for c in value))
        return rows(xi, "xi", ids)

    keys = ["idx"] if shared else KEYS
    return values.join(own.select(*keys), keys, "left_anti").select("batch", "idx", "v"), each_pass(shared, [values], make)


def refine_logdet(factors: DataFrame) -> DataFrame:
    """batch, logdet: the sum of the logarithms of the conditional standard deviations."""
    return factors.groupBy("batch").agg(F.sum(F.log("s")).alias("logdet"))
