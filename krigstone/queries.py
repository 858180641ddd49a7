"""Queries of the graph engine over the embeddings (three components) and the star schema.

Results are rounded, as engines sum in different orders.  Noise, values and directions are exact
integer arithmetic, so that no transcendental function is evaluated twice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions.band import band, scatter_rows
from .functions.covariance import Covariance, lookup, matern
from .functions.geometry import left_child, level_of, parent, right_child, square_distance
from .operators import dense
from .operators.deriv import log_likelihood, log_likelihood_gradient, refine_inv_jvp, refine_jvp, refine_logdet_jvp, refine_vjp
from .operators.factor import blocks, distances, factorize, local_sets
from .operators.generate import generate, generate_inv, generate_jvp, generate_logdet, generate_vjp, start_factor
from .operators.graph import Graph, build_graph
from .operators.neighbors import query_neighbors, query_preceding_neighbors
from .operators.refine import refine, refine_inv, refine_logdet, refine_transpose
from .operators.sorting import sort_positions
from .operators.tree import build_tree
from .plans import oracle as sql
from .sources.points import embedding_points, order_points, read_points
from .storage import materialize

N0, K = 50, 2
#: The start of whole fields, small enough to be written out in SQL.
START = 3
BINS = tuple(i / 20 for i in range(41))
COV = Covariance(BINS, (tuple(round(math.exp(-r / 0.3), 9) + 1e-5 * (r == 0) for r in BINS),))
BOTH = Covariance(BINS, (COV.values[0], tuple(round(2 * math.exp(-r / 0.5), 9) + 1e-5 * (r == 0) for r in BINS)))
#: 1000 bins whose gaps grow, and values without transcendental functions.
FINE = Covariance(tuple(i * i / 400000.0 for i in range(1000)), (tuple(1.0 / (1.0 + i * i / 100000.0) for i in range(1000)),))
#: The usual setting: a start of 100 points in four rows of tiles, 10 neighbours, 1000 bins.
USUAL_N0, USUAL_K, USUAL_TILE = 100, 10, 32
USUAL = Covariance(FINE.bins, ((FINE.values[0][0] + 1e-5, *FINE.values[0][1:]),))
#: What a task finishes of the orders' tree (points), depths (edges) and levels (points): little, so that the ways of large
#: tables are taken at any size.
ORDER_LEAF, ORDER_FEW, ORDER_TOGETHER = 2048, 2000, 1000
#: For orders, whose plane is about one wide: exponential, with more jitter, as many orders are close.
ORDER_COV = Covariance(BINS, (tuple(round(math.exp(-r / 0.3), 9) + 1e-3 * (r == 0) for r in BINS),))
#: Noises under one covariance.
NOISES = 5
DCOV = Covariance(BINS, (tuple(((i * 37) % 11) / 100 for i in range(41)),))

_kept: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make):
    """What several queries of a session share: tables in the shared folder, until they are removed.  See ``forget``."""
    key = (storage.removals, spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf_dir, what)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Later queries build everything anew, as after a change of the tables."""
    _kept.clear()


def _tree(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "tree", lambda: build_tree(embedding_points(spark, sf_dir)))


def _graph(spark, sf_dir, k=K, n0=N0) -> Graph:
    return _once(spark, sf_dir, f"graph{k}-{n0}", lambda: build_graph(embedding_points(spark, sf_dir), n0, k))


def _order_tree(spark, sf_dir) -> DataFrame:
    """15000 orders at sf0.01: segments are split by counting, and neighbours are sought in more than the top tile."""
    return _once(spark, sf_dir, "order tree", lambda: build_tree(order_points(spark, sf_dir), ORDER_LEAF))


def _order_graph(spark, sf_dir) -> Graph:
    return _once(spark, sf_dir, "order graph", lambda: build_graph(order_points(spark, sf_dir), N0, K, few=ORDER_FEW, tree=lambda: _order_tree(spark, sf_dir)))


def _factors(spark, sf_dir, cov=COV, name="one", n0=N0) -> DataFrame:
    return _once(spark, sf_dir, f"factors-{name}-{n0}", lambda: factorize(_graph(spark, sf_dir, n0=n0), cov))


def _noise(shift: int = 0) -> Column:
    return ((F.col("idx") * 7919 + (13 + shift)) % 2003) / 1001.0 - 1.0


def _over(graph: Graph, name: str, value: Column, batches: int = 1) -> DataFrame:
    batch = F.explode(F.array(*map(F.lit, range(batches)))).alias("batch")
    return graph.points.select("idx", batch).select("batch", "idx", value.alias(name))


def _rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(column, digits) + 0.0


def _initial_and_noise(graph, batches=1):
    first = F.col("idx") < N0
    return _over(graph, "v", _noise(), batches).where(first), _over(graph, "xi", _noise(), batches).where(~first)


# graph


def tree_build(spark, sf_dir):
    return _tree(spark, sf_dir).select("node", "point_id")


def tree_split_dims(spark, sf_dir):
    return _tree(spark, sf_dir).select("node", F.col("split_dim").cast("int").alias("split_dim"))


def tree_navigation(spark, sf_dir):
    level = level_of(F.col("node"))
    return _tree(spark, sf_dir).select("node", level.cast("int").alias("level"), left_child(F.col("node"), level).alias("left"), right_child(F.col("node"), level).alias("right"), F.coalesce(parent(F.col("node")), F.lit(-1)).alias("parent"))


def knn_preceding(spark, sf_dir):
    found = query_preceding_neighbors(_tree(spark, sf_dir), N0, 4)
    return found.select("idx", F.col("slot").cast("int").alias("slot"), "nb", _rounded("d2", 9).alias("d2"))


def knn_bounded(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    asked = tree.select(F.col("node").alias("query"), (F.floor(F.col("node") * 3 / 4) + 8).cast("long").alias("bound"))
    found = query_neighbors(tree, asked, 3)
    return found.select("query", F.col("slot").cast("int").alias("slot"), "nb", _rounded("d2", 9).alias("d2"))


def knn_padded(spark, sf_dir):
    """Fewer candidates than neighbours asked for: node 0 fills up, at no distance (-1)."""
    tree = _tree(spark, sf_dir)
    asked = tree.select(F.col("node").alias("query"), (1 + F.col("node") % 5).cast("long").alias("bound"))
    found = query_neighbors(tree, asked, 3, pad=True)
    d2 = F.when(F.col("d2") == float("inf"), -1.0).otherwise(F.col("d2"))
    return found.select("query", F.col("slot").cast("int").alias("slot"), "nb", _rounded(d2, 9).alias("d2"))


def depths(spark, sf_dir):
    return _graph(spark, sf_dir, 4).points.select("point_id", F.col("depth").cast("int").alias("depth"))


def order_by_depth(spark, sf_dir):
    return _graph(spark, sf_dir, 4).points.select("idx", "point_id", F.col("depth").cast("int").alias("depth"))


def build_graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir, 4).edges.select("idx", F.col("slot").cast("int").alias("slot"), "nb")


def offsets(spark, sf_dir):
    return _graph(spark, sf_dir, 4).offsets.select(F.col("depth").cast("int").alias("depth"), F.col("end").cast("long").alias("end_idx"))


# beyond one task


def order_tree(spark, sf_dir):
    return _order_tree(spark, sf_dir).select("node", "point_id", F.col("split_dim").cast("int").alias("split_dim"))


def order_neighbors(spark, sf_dir):
    found = query_preceding_neighbors(_order_tree(spark, sf_dir), N0, 3)
    return found.select("idx", F.col("slot").cast("int").alias("slot"), "nb", _rounded("d2", 12).alias("d2"))


def knn_ties_met(spark, sf_dir):
    """Distances of parts (many at one place) to the neighbours that a search would meet; they are those of the least ones."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    tree = _once(spark, sf_dir, "part tree", lambda: build_tree(read_points(parts, "p_partkey", F.floor(F.col("p_size") / 5), F.floor(F.col("p_retailprice") / 100))))
    found = query_preceding_neighbors(tree, N0, 4, ties="met")
    return found.select("idx", F.col("slot").cast("int").alias("slot"), _rounded("d2", 9).alias("d2"))


def order_depths(spark, sf_dir):
    return _order_graph(spark, sf_dir).points.select("idx", "point_id", F.col("depth").cast("int").alias("depth"))


def order_refine(spark, sf_dir):
    graph = _order_graph(spark, sf_dir)
    factors = _once(spark, sf_dir, "order factors", lambda: factorize(graph, ORDER_COV))
    return refine(factors, *_initial_and_noise(graph), together=ORDER_TOGETHER).select("idx", _rounded("v", 5).alias("v"))


def order_transpose(spark, sf_dir):
    graph = _order_graph(spark, sf_dir)
    factors = _once(spark, sf_dir, "order factors", lambda: factorize(graph, ORDER_COV))
    first, later = refine_transpose(factors, _over(graph, "vbar", _noise(5)), together=ORDER_TOGETHER)
    return first.select("idx", F.col("initial_bar").alias("bar")).unionByName(later.select("idx", F.col("xi_bar").alias("bar"))).select("idx", _rounded("bar", 4).alias("bar"))


# sorting

SORTS = {
    "sort_1": ("customer", ("c_custkey",)),
    "sort_2": ("customer", ("c_acctbal", "c_custkey")),
    "sort_3": ("part", ("p_size", "p_retailprice", "p_partkey")),
    "sort_4": ("lineitem", ("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber")),
}


def _sort(name):
    table, keys = SORTS[name]
    return lambda spark, sf_dir: sort_positions(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys), *keys)


def _sort_sql(name):
    table, keys = SORTS[name]
    return f"SELECT {', '.join(keys)}, row_number() OVER (ORDER BY {', '.join(keys)}) - 1 AS position FROM {table}"


# distances and covariances


def parent_distance(spark, sf_dir):
    tree = _tree(spark, sf_dir).withColumn("parent", parent(F.col("node")))
    up = tree.select(F.col("node").alias("parent"), *(F.col(f"x{i}").alias(f"y{i}") for i in range(3)))
    d2 = square_distance([F.col(f"x{i}") for i in range(3)], [F.col(f"y{i}") for i in range(3)])
    return tree.join(up, "parent").select("node", "parent", _rounded(d2, 9).alias("d2"))


def _order_distances(spark, sf_dir):
    """node and r: how far each node but the root is from its parent."""
    tree = _order_tree(spark, sf_dir).withColumn("parent", parent(F.col("node")))
    up = tree.select(F.col("node").alias("parent"), *(F.col(f"x{i}").alias(f"y{i}") for i in range(2)))
    d2 = square_distance([F.col(f"x{i}") for i in range(2)], [F.col(f"y{i}") for i in range(2)])
    return tree.join(up, "parent").select("node", F.sqrt(d2).alias("r"))


def _edge_distances(graph):
    at = lambda p: [F.col(f"{p}.x{i}") for i in range(3)]
    joined = graph.edges.alias("e").join(graph.points.alias("q"), F.col("e.idx") == F.col("q.idx")).join(graph.points.alias("n"), F.col("e.nb") == F.col("n.idx"))
    return joined.select("e.idx", "e.slot", "e.nb", F.sqrt(square_distance(at("q"), at("n"))).alias("r"))


def cov_lookup(spark, sf_dir):
    return band(_edge_distances(_graph(spark, sf_dir)), COV, "r").select("idx", F.col("slot").cast("int").alias("slot"), _rounded("val").alias("val"))


def cov_lookup_fine(spark, sf_dir):
    """1000 bins, at the distances of orders to their parents in the tree."""
    return band(_order_distances(spark, sf_dir), FINE, "r").select("node", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), _rounded("val", 9).alias("val"))


def cov_lookup_vjp_fine(spark, sf_dir):
    rows = _order_distances(spark, sf_dir).withColumn("bar", 1 / (1.0 + F.col("node") % 7))
    return scatter_rows(rows, FINE, "r", "bar").select(F.col("bin_id").cast("int").alias("bin_id"), _rounded("val").alias("val"))


def cov_lookup_vjp(spark, sf_dir):
    rows = _edge_distances(_graph(spark, sf_dir)).withColumn("bar", 1 / (1.0 + F.col("slot")))
    return scatter_rows(rows, COV, "r", "bar").select(F.col("bin_id").cast("int").alias("bin_id"), _rounded("val").alias("val"))


def _per_point(spark, sf_dir, names, make):
    """Doubles named names for each point with neighbours, from its covariance matrix."""
    graph = _graph(spark, sf_dir)
    bins, values = np.array(COV.bins), np.array(COV.values[0])

    def run(batches):
        for batch in batches:
            for part, at in blocks(batch, K, 3):
                columns = make(lookup(bins, values, distances(at)))
                yield pa.RecordBatch.from_arrays([part.column("idx"), *map(pa.array, columns)], ["idx", *names])

    found = local_sets(graph).mapInArrow(run, "idx long, " + ", ".join(f"{n} double" for n in names))
    return found.select("idx", *(_rounded(n).alias(n) for n in names))


def cov_matrix(spark, sf_dir):
    return _per_point(spark, sf_dir, ("k00", "k10", "k11", "k20", "k21", "k22"), lambda K_: [K_[:, i, j] for i in range(3) for j in range(i + 1)])


def cholesky(spark, sf_dir):
    def lower(K_):
        L = np.linalg.cholesky(K_)
        return [L[:, i, j] for i in range(3) for j in range(i + 1)]

    return _per_point(spark, sf_dir, ("l00", "l10", "l11", "l20", "l21", "l22"), lower)


def apply_cholesky(spark, sf_dir):
    """L (1, -1, 1/2)."""
    def product(K_):
        z = np.linalg.cholesky(K_) @ np.array([1.0, -1.0, 0.5])
        return [z[:, 0], z[:, 1], z[:, 2]]

    return _per_point(spark, sf_dir, ("z0", "z1", "z2"), product)


def matern_table(spark, sf_dir):
    return matern(1, 2.0, 0.5, 1e-3, 10.0, 40).table(spark).select("bin_id", _rounded("r", 9).alias("r"), _rounded("val", 9).alias("val"))


def solve_forward(spark, sf_dir):
    """L y = k_f on the neighbours."""
    def solve(K_):
        y = np.linalg.solve(np.linalg.cholesky(K_[:, :2, :2]), K_[:, 2, :2, None])[:, :, 0]
        return [y[:, 0], y[:, 1]]

    return _per_point(spark, sf_dir, ("y0", "y1"), solve)


def solve_backward(spark, sf_dir):
    """L' z = k_f on the neighbours."""
    def solve(K_):
        z = np.linalg.solve(np.linalg.cholesky(K_[:, :2, :2]).transpose(0, 2, 1), K_[:, 2, :2, None])[:, :, 0]
        return [z[:, 0], z[:, 1]]

    return _per_point(spark, sf_dir, ("z0", "z1"), solve)


def factor_weights(spark, sf_dir):
    return _factors(spark, sf_dir).select("idx", _rounded(F.col("w")[0]).alias("w0"), _rounded(F.col("w")[1]).alias("w1"), _rounded("s").alias("s"))


# refinement


def refine_values(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    return refine(factors, *_initial_and_noise(graph)).select("idx", _rounded("v").alias("v"))


def batch_refine(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir, BOTH, "both")
    return refine(factors, *_initial_and_noise(graph, 2)).select("batch", "idx", _rounded("v").alias("v"))


def refine_transpose_bars(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    first, later = refine_transpose(factors, _over(graph, "vbar", _noise(5)))
    return first.select("idx", F.col("initial_bar").alias("bar")).unionByName(later.select("idx", F.col("xi_bar").alias("bar"))).select("idx", _rounded("bar").alias("bar"))


def refine_inverse(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    return refine_inv(factors, _over(graph, "v", _noise(3)))[1].select("idx", _rounded("xi").alias("xi"))


def refine_log_determinant(spark, sf_dir):
    return refine_logdet(_factors(spark, sf_dir)).select(_rounded("logdet").alias("logdet"))


def _values(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    return _once(spark, sf_dir, "values", lambda: materialize(refine(factors, *_initial_and_noise(graph))))


def refine_tangent(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    _, xi = _initial_and_noise(graph)
    first = F.col("idx") < N0
    moved = refine_jvp(graph, COV, factors, _values(spark, sf_dir), xi, DCOV, _over(graph, "v", _noise(7)).where(first), _over(graph, "dxi", _noise(9)).where(~first))
    return moved.select("idx", _rounded("v").alias("dv"))


def refine_cotangent(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    cov_bar, _, _ = refine_vjp(graph, COV, factors, _values(spark, sf_dir), _initial_and_noise(graph)[1], _over(graph, "vbar", _noise(5)))
    return cov_bar.select(F.col("bin_id").cast("int").alias("bin_id"), _rounded("cov_bar", 5).alias("cov_bar"))


def refine_tangent_linear(spark, sf_dir):
    """Along initial values and noise only."""
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    _, xi = _initial_and_noise(graph)
    first = F.col("idx") < N0
    moved = refine_jvp(graph, COV, factors, _values(spark, sf_dir), xi, None, _over(graph, "v", _noise(7)).where(first), _over(graph, "dxi", _noise(9)).where(~first))
    return moved.select("idx", _rounded("v").alias("dv"))


def refine_cotangent_bars(spark, sf_dir):
    """What initial values and noise receive."""
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    _, first, later = refine_vjp(graph, COV, factors, _values(spark, sf_dir), _initial_and_noise(graph)[1], _over(graph, "vbar", _noise(5)))
    return first.select("idx", F.col("initial_bar").alias("bar")).unionByName(later.select("idx", F.col("xi_bar").alias("bar"))).select("idx", _rounded("bar").alias("bar"))


def refine_inverse_tangent(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    moved = refine_inv_jvp(graph, COV, factors, _over(graph, "v", _noise(3)), DCOV, _over(graph, "v", _noise(7)))
    return moved.select("idx", _rounded("dxi", 5).alias("dxi"))


def log_determinant_tangent(spark, sf_dir):
    return refine_logdet_jvp(_graph(spark, sf_dir), COV, _factors(spark, sf_dir), DCOV).select(_rounded("dlogdet", 5).alias("dlogdet"))


def likelihood(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    return log_likelihood(factors, _over(graph, "v", _noise(3))).select(_rounded("log_likelihood", 4).alias("log_likelihood"))


def likelihood_gradient(spark, sf_dir):
    """In the covariance's bins."""
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    found, _ = log_likelihood_gradient(graph, COV, factors, _over(graph, "v", _noise(3)))
    return found.select(F.col("bin_id").cast("int").alias("bin_id"), _rounded("cov_bar", 3).alias("gradient"))


def likelihood_gradient_values(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    _, found = log_likelihood_gradient(graph, COV, factors, _over(graph, "v", _noise(3)))
    return found.select("idx", _rounded("v_bar", 4).alias("gradient"))


def shared_refine(spark, sf_dir):
    """Two noises under one covariance, whose factors are kept once."""
    graph, factors = _graph(spark, sf_dir), _factors(spark, sf_dir)
    noise, first = ((F.col("idx") * 7919 + (13 + 11 * F.col("batch"))) % 2003) / 1001.0 - 1.0, F.col("idx") < N0
    values = refine(factors, _over(graph, "v", noise, 2).where(first), _over(graph, "xi", noise, 2).where(~first), shared=True)
    return values.select("batch", "idx", _rounded("v").alias("v"))


def _field(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir, n0=START), _factors(spark, sf_dir, n0=START)
    xi = _over(graph, "xi", _noise())
    return graph, factors, xi, _once(spark, sf_dir, "field", lambda: materialize(generate(graph, COV, factors, xi)))


def field_generate(spark, sf_dir):
    return _field(spark, sf_dir)[3].select("idx", _rounded("v").alias("v"))


def field_invert(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir, n0=START), _factors(spark, sf_dir, n0=START)
    return generate_inv(graph, COV, factors, _over(graph, "v", _noise(3))).select("idx", _rounded("xi").alias("xi"))


def field_log_determinant(spark, sf_dir):
    graph, factors = _graph(spark, sf_dir, n0=START), _factors(spark, sf_dir, n0=START)
    return generate_logdet(graph, COV, factors).select(_rounded("logdet").alias("logdet"))


def field_tangent(spark, sf_dir):
    graph, factors, xi, values = _field(spark, sf_dir)
    return generate_jvp(graph, COV, factors, values, xi, DCOV, _over(graph, "dxi", _noise(9))).select("idx", _rounded("v", 5).alias("dv"))


def field_cotangent(spark, sf_dir):
    graph, factors, xi, values = _field(spark, sf_dir)
    cov_bar, _ = generate_vjp(graph, COV, factors, values, xi, _over(graph, "vbar", _noise(5)))
    return cov_bar.select(F.col("bin_id").cast("int").alias("bin_id"), _rounded("cov_bar", 4).alias("cov_bar"))


def field_cotangent_noise(spark, sf_dir):
    graph, factors, xi, values = _field(spark, sf_dir)
    _, xi_bar = generate_vjp(graph, COV, factors, values, xi, _over(graph, "vbar", _noise(5)))
    return xi_bar.select("idx", _rounded("xi_bar").alias("xi_bar"))


def _many(spark, sf_dir):
    """Five noises under one covariance."""
    graph, factors = _graph(spark, sf_dir, n0=START), _factors(spark, sf_dir, n0=START)
    start = _once(spark, sf_dir, "start", lambda: materialize(start_factor(graph, COV)))
    xi = _over(graph, "xi", _noises(0), NOISES)
    return graph, factors, xi, start, _once(spark, sf_dir, "fields", lambda: materialize(generate(graph, COV, factors, xi, shared=True, start=start)))


def _noises(shift: int) -> Column:
    """Noise of each batch."""
    return ((F.col("idx") * 7919 + (13 + shift + 11 * F.col("batch"))) % 2003) / 1001.0 - 1.0


def many_fields(spark, sf_dir):
    return _many(spark, sf_dir)[-1].select("batch", "idx", _rounded("v").alias("v"))


def many_inverses(spark, sf_dir):
    graph, factors, _, start, _ = _many(spark, sf_dir)
    return generate_inv(graph, COV, factors, _over(graph, "v", _noises(3), NOISES), shared=True, start=start).select("batch", "idx", _rounded("xi").alias("xi"))


def many_tangents(spark, sf_dir):
    graph, factors, xi, _, values = _many(spark, sf_dir)
    return generate_jvp(graph, COV, factors, values, xi, DCOV, _over(graph, "dxi", _noises(9), NOISES), shared=True).select("batch", "idx", _rounded("v", 5).alias("dv"))


def many_cotangents(spark, sf_dir):
    graph, factors, xi, start, values = _many(spark, sf_dir)
    cov_bar, _ = generate_vjp(graph, COV, factors, values, xi, _over(graph, "vbar", _noises(5), NOISES), shared=True, start=start)
    return cov_bar.select("batch", F.col("bin_id").cast("int").alias("bin_id"), _rounded("cov_bar", 4).alias("cov_bar"))


def _usual(spark, sf_dir):
    graph = _graph(spark, sf_dir, USUAL_K, USUAL_N0)
    factors = _once(spark, sf_dir, "usual factors", lambda: factorize(graph, USUAL))
    return graph, factors, _once(spark, sf_dir, "usual start", lambda: materialize(start_factor(graph, USUAL, tile=USUAL_TILE)))


def usual_round_trip(spark, sf_dir):
    """Five noises to fields and back, in the usual setting."""
    graph, factors, start = _usual(spark, sf_dir)
    values = materialize(generate(graph, USUAL, factors, _over(graph, "xi", _noises(0), NOISES), shared=True, start=start, tile=USUAL_TILE))
    return generate_inv(graph, USUAL, factors, values, shared=True, start=start, tile=USUAL_TILE).select("batch", "idx", _rounded("xi").alias("xi"))


def _start_product(spark, sf_dir):
    """The covariance of the start times five vectors, as its factor times the factor's transpose."""
    graph, _, start = _usual(spark, sf_dir)
    side = dense.sides(_over(graph, "v", _noises(0), NOISES), "v", USUAL_N0, True, USUAL_TILE)
    return start, dense.times(start, dense.times(start, side, USUAL_N0, transpose=True, tile=USUAL_TILE), USUAL_N0, tile=USUAL_TILE)


def dense_product(spark, sf_dir):
    return dense.unpack(_start_product(spark, sf_dir)[1], "v", USUAL_TILE).select("batch", "idx", _rounded("v").alias("v"))


def dense_solve(spark, sf_dir):
    """Both triangular solves on that product give the vectors back."""
    start, product = _start_product(spark, sf_dir)
    once = dense.solve(start, materialize(product), USUAL_N0, tile=USUAL_TILE)
    return dense.unpack(dense.solve(start, once, USUAL_N0, transpose=True, tile=USUAL_TILE), "v", USUAL_TILE).select("batch", "idx", _rounded("v").alias("v"))


def queries() -> dict:
    found = (
        tree_build, tree_split_dims, tree_navigation, knn_preceding, knn_bounded, knn_padded, depths, order_by_depth, build_graph_edges, offsets,
        parent_distance, cov_lookup, cov_lookup_vjp, matern_table, cov_matrix, cholesky, apply_cholesky, solve_forward, solve_backward, factor_weights,
        refine_values, batch_refine, refine_transpose_bars, refine_inverse, refine_log_determinant, refine_tangent, refine_tangent_linear, refine_cotangent,
        refine_cotangent_bars, shared_refine, field_generate, field_invert, field_log_determinant, field_tangent, field_cotangent, field_cotangent_noise,
        refine_inverse_tangent, log_determinant_tangent, likelihood, likelihood_gradient, likelihood_gradient_values,
        order_tree, order_neighbors, knn_ties_met, order_depths, order_refine, order_transpose, cov_lookup_fine, cov_lookup_vjp_fine, many_fields, many_inverses, many_tangents, many_cotangents,
        usual_round_trip, dense_product, dense_solve,
    )
    return {f.__name__: f for f in found} | {name: _sort(name) for name in SORTS}


def oracle_sql() -> dict[str, str]:
    base = (sql.points(), sql.tree())
    two, four = (*base, sql.graph(K, N0)), (*base, sql.graph(4, N0))
    fact = (*two, sql.factors(COV))
    r = sql.rounded
    d2 = sql.D2
    j = f"len(list_filter([{', '.join(map(repr, BINS))}], lambda z: z < r))"
    edge_r = "er AS (SELECT e.idx, e.slot, sqrt(" + d2 + ") AS r FROM ge e JOIN gp a ON a.idx = e.idx JOIN gp b ON b.idx = e.nb)"
    low = "sqrt(kk)"
    chol = f"SELECT *, {low} AS l00, b / {low} AS l10, sqrt(kk - (b / {low}) * (b / {low})) AS l11 FROM f"
    refined = sql.forward(sql.noise("idx"), f"s * ({sql.noise('f.idx')})")

    def to_bins(parts: tuple, y: str, more: str, digits: int, name: str = "cov_bar") -> str:
        """What the bins receive through the conditional weights, and more (distance, cotangent); y: f with what the scale
        receives over s (sg) and what the weights do, solved against the neighbours' covariance (y0, y1)."""
        return sql.query(
            *parts, y,
            f"""parts AS (SELECT 0.0::DOUBLE AS r, -y0 * w0 + sg / 2 * w0 * w0 - y1 * w1 + sg / 2 * w1 * w1 + sg / 2 AS bar FROM y
                UNION ALL SELECT r01, -y0 * w1 - y1 * w0 + sg * w0 * w1 FROM y UNION ALL SELECT r0, y0 - sg * w0 FROM y UNION ALL SELECT r1, y1 - sg * w1 FROM y {more})""",
            f"placed AS (SELECT *, {j} AS j FROM parts)",
            f"tt AS (SELECT *, CASE WHEN j = 0 OR j = {len(BINS)} THEN 0 ELSE (r - (j - 1) / 20.0::DOUBLE) * 20 END AS t FROM placed)",
            select=f"""SELECT b.bin_id::INTEGER AS bin_id, {r('coalesce(sum(val), 0)', digits)} AS {name} FROM (SELECT unnest(range({len(BINS)})) AS bin_id) b LEFT JOIN
                (SELECT greatest(j - 1, 0) AS bin_id, bar * (1 - t) AS val FROM tt UNION ALL SELECT least(j, {len(BINS) - 1}), bar * t FROM tt) x ON x.bin_id = b.bin_id GROUP BY b.bin_id""")

    def cotangent(parts: tuple, more: str, digits: int, shift: int = 0) -> str:
        y = f"""y AS MATERIALIZED (SELECT f.*, vbar * ({sql.noise('f.idx', shift)}) / s AS sg, vbar * (kk * a.v - b * c.v) / (kk * kk - b * b) AS y0, vbar * (kk * c.v - b * a.v) / (kk * kk - b * b) AS y1
            FROM f JOIN z USING (idx) JOIN u a ON a.idx = f.n0 JOIN u c ON c.idx = f.n1)"""
        return to_bins(parts, y, more, digits)

    out = {
        "tree_build": sql.query(*base, select="SELECT node, point_id FROM t"),
        "tree_split_dims": sql.query(*base, select="SELECT node, split_dim FROM t"),
        "tree_navigation": sql.query(*base, select="""SELECT c.node, c.l AS level, c.node + (1::BIGINT << c.l) AS "left", c.node + 2 * (1::BIGINT << c.l) AS "right", coalesce(p.node, -1) AS parent
            FROM (SELECT node, length(bin(node + 1))::INTEGER - 1 AS l FROM t) c LEFT JOIN
            (SELECT node, unnest([node + (1::BIGINT << l), node + 2 * (1::BIGINT << l)]) AS child FROM (SELECT node, length(bin(node + 1))::INTEGER - 1 AS l FROM t)) p ON p.child = c.node"""),
        "knn_preceding": sql.query(*base, sql.neighbors(4, N0), select=f"SELECT idx, slot::INTEGER AS slot, nb, {r('d2', 9)} AS d2 FROM e0"),
        "knn_bounded": sql.query(*base, select=f"""SELECT query, slot::INTEGER AS slot, nb, {r('d2', 9)} AS d2 FROM (
            SELECT a.node AS query, row_number() OVER (PARTITION BY a.node ORDER BY {d2}, b.node) - 1 AS slot, b.node AS nb, {d2} AS d2
            FROM t a JOIN t b ON b.node < floor(a.node * 3 / 4.0) + 8) WHERE slot < 3"""),
        "knn_padded": sql.query(*base, select=f"""SELECT a.node AS query, slots.slot::INTEGER AS slot, coalesce(e.nb, 0)::BIGINT AS nb, {r('coalesce(e.d2, -1)', 9)} AS d2 FROM t a
            CROSS JOIN (SELECT unnest([0, 1, 2]) AS slot) slots LEFT JOIN (
              SELECT a.node, row_number() OVER (PARTITION BY a.node ORDER BY {d2}, b.node) - 1 AS slot, b.node AS nb, {d2} AS d2
              FROM t a JOIN t b ON b.node < 1 + a.node % 5) e ON e.node = a.node AND e.slot = slots.slot"""),
        "depths": sql.query(*four, select="SELECT point_id, depth FROM gp"),
        "order_by_depth": sql.query(*four, select="SELECT idx, point_id, depth FROM gp"),
        "build_graph_edges": sql.query(*four, select="SELECT idx, slot::INTEGER AS slot, nb FROM ge"),
        "offsets": sql.query(*four, select="SELECT depth, (sum(n) OVER (ORDER BY depth))::BIGINT AS end_idx FROM (SELECT depth, count(*) AS n FROM gp GROUP BY depth)"),
        "parent_distance": sql.query(*base, select=f"""SELECT a.node, b.node AS parent, {r(d2, 9)} AS d2 FROM
            (SELECT *, length(bin(node + 1)) - 1 AS l FROM t WHERE node > 0) a JOIN t b
            ON b.node = (a.node + 1 - (1::BIGINT << a.l::INTEGER)) % (1::BIGINT << (a.l - 1)::INTEGER) + (1::BIGINT << (a.l - 1)::INTEGER) - 1"""),
        "cov_lookup": sql.query(*two, edge_r, select=f"SELECT idx, slot::INTEGER AS slot, {r(sql.lookup(COV.bins, COV.values[0], 'r'))} AS val FROM er"),
        "cov_lookup_vjp": sql.query(*two, edge_r, select=f"""SELECT bin_id::INTEGER AS bin_id, {r('sum(val)')} AS val FROM (
            SELECT greatest(j - 1, 0) AS bin_id, bar * (1 - t) AS val FROM (SELECT *, CASE WHEN j = 0 OR j = {len(BINS)} THEN 0 ELSE (r - (j - 1) / 20.0::DOUBLE) * 20 END AS t FROM
              (SELECT 1 / (1.0::DOUBLE + slot) AS bar, r, {j} AS j FROM er))
            UNION ALL SELECT least(j, {len(BINS) - 1}), bar * t FROM (SELECT *, CASE WHEN j = 0 OR j = {len(BINS)} THEN 0 ELSE (r - (j - 1) / 20.0::DOUBLE) * 20 END AS t FROM
              (SELECT 1 / (1.0::DOUBLE + slot) AS bar, r, {j} AS j FROM er))) GROUP BY bin_id"""),
        "cov_matrix": sql.query(*fact, select=f"SELECT idx, {r('kk')} AS k00, {r('b')} AS k10, {r('kk')} AS k11, {r('f0')} AS k20, {r('f1')} AS k21, {r('kk')} AS k22 FROM f"),
        "cholesky": sql.query(*fact, select=f"""SELECT idx, {r('l00')} AS l00, {r('l10')} AS l10, {r('l11')} AS l11, {r('f0 / l00')} AS l20,
            {r('(f1 - l10 * f0 / l00) / l11')} AS l21, {r('s')} AS l22 FROM ({chol})"""),
        "apply_cholesky": sql.query(*fact, select=f"""SELECT idx, {r('l00')} AS z0, {r('l10 - l11')} AS z1, {r('f0 / l00 - (f1 - l10 * f0 / l00) / l11 + s / 2')} AS z2 FROM ({chol})"""),
        "matern_table": f"""SELECT i::INTEGER AS bin_id, {r('r', 9)} AS r, {r('CASE WHEN i = 0 THEN 2 * (1 + 1e-5) ELSE 2 * (1 + sqrt(3.0::DOUBLE) * r / 0.5) * exp(-sqrt(3.0::DOUBLE) * r / 0.5) END', 9)} AS val
            FROM (SELECT i, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 1e-3::DOUBLE * pow(1e4::DOUBLE, (i - 1) / 38.0::DOUBLE) END AS r FROM (SELECT unnest(range(40)) AS i))""",
        "solve_forward": sql.query(*fact, select=f"SELECT idx, {r('f0 / l00')} AS y0, {r('(f1 - l10 * f0 / l00) / l11')} AS y1 FROM ({chol})"),
        "solve_backward": sql.query(*fact, select=f"SELECT idx, {r('(f0 - l10 * f1 / l11) / l00')} AS z0, {r('f1 / l11')} AS z1 FROM ({chol})"),
        "factor_weights": sql.query(*fact, select=f"SELECT idx, {r('w0')} AS w0, {r('w1')} AS w1, {r('s')} AS s FROM f"),
        "refine_values": sql.query(*fact, refined, select=f"SELECT idx, {r('v')} AS v FROM u"),
        "refine_transpose_bars": sql.query(*fact, sql.backward(sql.noise("g.idx", 5)), select=f"SELECT z.idx, {r('coalesce(s, 1) * vbar')} AS bar FROM z LEFT JOIN f USING (idx)"),
        "refine_inverse": sql.query(*fact, select=f"SELECT idx, {r('((' + sql.noise('idx', 3) + ') - w0 * (' + sql.noise('f.n0', 3) + ') - w1 * (' + sql.noise('f.n1', 3) + ')) / s')} AS xi FROM f"),
        "refine_log_determinant": sql.query(*fact, select=f"SELECT {r('sum(ln(s))')} AS logdet FROM f"),
        "refine_tangent": sql.query(
            *two, sql.factors(COV, DCOV), refined,
            "src AS MATERIALIZED (SELECT df.idx, dw0 * a.v + dw1 * b.v + ds * (" + sql.noise("df.idx") + ") + s * (" + sql.noise("df.idx", 9) + ") AS q FROM df JOIN u a ON a.idx = df.n0 JOIN u b ON b.idx = df.n1)",
            sql.forward(sql.noise("idx", 7), "(SELECT q FROM src WHERE src.idx = f.idx)", "j"), select=f"SELECT idx, {r('v')} AS dv FROM j"),
        "refine_cotangent": cotangent((*fact, refined, sql.backward(sql.noise("g.idx", 5))), "", 5),
    }
    out["refine_tangent_linear"] = sql.query(*fact, sql.forward(sql.noise("idx", 7), f"s * ({sql.noise('f.idx', 9)})"), select=f"SELECT idx, {r('v')} AS dv FROM u")
    out["refine_cotangent_bars"] = out["refine_transpose_bars"]
    again = sql.forward(sql.noise("idx", 11), f"s * ({sql.noise('f.idx', 11)})", "m")
    out["shared_refine"] = sql.query(*fact, refined, again, select=f"SELECT 0 AS batch, idx, {r('v')} AS v FROM u UNION ALL SELECT 1, idx, {r('v')} FROM m")
    # the inverse, the log-determinant and the likelihood of values
    v, va, vb = sql.noise("f.idx", 3), sql.noise("f.n0", 3), sql.noise("f.n1", 3)
    inverse = f"xs AS MATERIALIZED (SELECT f.*, {v} AS v, {va} AS va, {vb} AS vb, (({v}) - w0 * ({va}) - w1 * ({vb})) / s AS xi FROM f)"
    moved = " - ".join([f"({sql.noise('idx', 7)})", f"w0 * ({sql.noise('n0', 7)})", f"w1 * ({sql.noise('n1', 7)})", "dw0 * va", "dw1 * vb", "ds * xi"])
    out["refine_inverse_tangent"] = sql.query(*two, sql.factors(COV, DCOV), inverse, select=f"SELECT idx, {r(f'({moved}) / s', 5)} AS dxi FROM xs JOIN (SELECT idx, dw0, dw1, ds FROM df) USING (idx)")
    out["log_determinant_tangent"] = sql.query(*two, sql.factors(COV, DCOV), select=f"SELECT {r('sum(ds / s)', 5)} AS dlogdet FROM df")
    out["likelihood"] = sql.query(*fact, inverse, select=f"SELECT {r('-sum(xi * xi) / 2 - sum(ln(s))', 4)} AS log_likelihood FROM xs")
    y = """y AS MATERIALIZED (SELECT *, (xi * xi - 1) / s / s AS sg, xi / s * (kk * va - b * vb) / (kk * kk - b * b) AS y0, xi / s * (kk * vb - b * va) / (kk * kk - b * b) AS y1 FROM xs)"""
    out["likelihood_gradient"] = to_bins((*fact, inverse), y, "", 3, "gradient")
    out["likelihood_gradient_values"] = sql.query(*fact, inverse, select=f"""SELECT idx, {r('sum(g)', 4)} AS gradient FROM (
        SELECT idx, -xi / s AS g FROM xs UNION ALL SELECT n0, w0 * xi / s FROM xs UNION ALL SELECT n1, w1 * xi / s FROM xs) GROUP BY idx""")
    # whole fields, and the same for each of several noises
    three = (*base, sql.graph(K, START))
    whole = (*three, sql.factors(COV), sql.start(COV))

    def fields(more: int) -> dict[str, str]:
        noise = lambda idx, shift=0: sql.noise(idx, shift + more)
        x, dx = ([noise(str(i), shift) for i in range(3)] for shift in (0, 9))
        made = sql.forward(sql.times("l", x), f"s * ({noise('f.idx')})")
        found = {"generate": sql.query(*whole, made, select=f"SELECT idx, {r('v')} AS v FROM u")}
        v = [noise(str(i), 3) for i in range(3)]
        x0 = f"(({v[0]}) / l00)"
        x1 = f"((({v[1]}) - l10 * {x0}) / l11)"
        x2 = f"((({v[2]}) - l20 * {x0} - l21 * {x1}) / l22)"
        later = "((" + noise("idx", 3) + ") - w0 * (" + noise("f.n0", 3) + ") - w1 * (" + noise("f.n1", 3) + ")) / s"
        found["invert"] = sql.query(*whole, select=f"SELECT idx, {r(later)} AS xi FROM f UNION ALL SELECT 0, {r(x0)} FROM dn UNION ALL SELECT 1, {r(x1)} FROM dn UNION ALL SELECT 2, {r(x2)} FROM dn")
        found["tangent"] = sql.query(
            *three, sql.factors(COV, DCOV), sql.start(COV, DCOV), made,
            "src AS MATERIALIZED (SELECT df.idx, dw0 * a.v + dw1 * b.v + ds * (" + noise("df.idx") + ") + s * (" + noise("df.idx", 9) + ") AS q FROM df JOIN u a ON a.idx = df.n0 JOIN u b ON b.idx = df.n1)",
            sql.forward(sql.times("l", dx) + " + " + sql.times("dl", x), "(SELECT q FROM src WHERE src.idx = f.idx)", "j"), select=f"SELECT idx, {r('v', 5)} AS dv FROM j")
        back = sql.backward(noise("g.idx", 5))
        found["cotangent_noise"] = sql.query(*whole, back, """zz AS MATERIALIZED (SELECT max(vbar) FILTER (idx = 0) AS z0, max(vbar) FILTER (idx = 1) AS z1, max(vbar) FILTER (idx = 2) AS z2 FROM z)""", select=f"""
            SELECT idx, {r('s * vbar')} AS xi_bar FROM z JOIN f USING (idx) UNION ALL SELECT 0, {r('l00 * z0 + l10 * z1 + l20 * z2')} FROM dn, zz
            UNION ALL SELECT 1, {r('l11 * z1 + l21 * z2')} FROM dn, zz UNION ALL SELECT 2, {r('l22 * z2')} FROM dn, zz""")
        # the dense factor in reverse, entry by entry
        reverse = f"""zz AS MATERIALIZED (SELECT max(vbar) FILTER (idx = 0) AS z0, max(vbar) FILTER (idx = 1) AS z1, max(vbar) FILTER (idx = 2) AS z2 FROM z),
            b0 AS (SELECT *, z2 * ({x[2]}) / (2 * l22) AS t22 FROM dn, zz),
            b1 AS (SELECT *, z2 * ({x[1]}) - 2 * l21 * t22 AS g21 FROM b0),
            b2 AS (SELECT *, z2 * ({x[0]}) - 2 * l20 * t22 - l10 * g21 / l11 AS g20, z1 * ({x[1]}) - l21 * g21 / l11 AS g11 FROM b1),
            b3 AS (SELECT *, g11 / (2 * l11) AS t11 FROM b2),
            b4 AS (SELECT *, z1 * ({x[0]}) - l20 * g21 / l11 - 2 * l10 * t11 AS g10 FROM b3),
            b5 AS MATERIALIZED (SELECT *, (z0 * ({x[0]}) - l20 * g20 / l00 - l10 * g10 / l00) / (2 * l00) AS t00 FROM b4)"""
        dense = "UNION ALL SELECT 0.0::DOUBLE, t22 + t11 + t00 FROM b5 UNION ALL SELECT q01, g10 / l00 FROM b5 UNION ALL SELECT q02, g20 / l00 FROM b5 UNION ALL SELECT q12, g21 / l11 FROM b5"
        found["cotangent"] = cotangent((*whole, made, back, reverse), dense, 4, more)
        return found

    out |= {f"field_{name}": text for name, text in fields(0).items()}
    out["field_log_determinant"] = sql.query(*whole, select=f"SELECT {r('sum(ln(s)) + (SELECT ln(l00) + ln(l11) + ln(l22) FROM dn)')} AS logdet FROM f")
    each = [fields(11 * b) for b in range(NOISES)]
    for name, kind in (("many_fields", "generate"), ("many_inverses", "invert"), ("many_tangents", "tangent"), ("many_cotangents", "cotangent")):
        out[name] = "\nUNION ALL ".join(f"SELECT {b} AS batch, q.* FROM ({found[kind]}) q" for b, found in enumerate(each))
    # orders
    plane = (sql.order_points(), sql.tree(15))
    orders = (*plane, sql.graph(K, N0, sql.least_neighbors), sql.factors(ORDER_COV))
    out["order_tree"] = sql.query(*plane, select="SELECT node, point_id, split_dim FROM t")
    out["order_neighbors"] = sql.query(*plane, sql.least_neighbors(3, N0), select=f"SELECT idx, slot::INTEGER AS slot, nb, {r('d2', 12)} AS d2 FROM e0")
    parts = ("p AS (SELECT p_partkey::BIGINT AS point_id, floor(p_size / 5)::DOUBLE AS x0, floor(p_retailprice / 100)::DOUBLE AS x1, 0.0::DOUBLE AS x2 FROM part)", sql.tree())
    out["knn_ties_met"] = sql.query(*parts, sql.neighbors(4, N0), select=f"SELECT idx, slot::INTEGER AS slot, {r('d2', 9)} AS d2 FROM e0")
    out["order_depths"] = sql.query(*plane, sql.graph(K, N0, sql.least_neighbors), select="SELECT idx, point_id, depth FROM gp")
    out["order_refine"] = sql.query(*orders, refined, select=f"SELECT idx, {r('v', 5)} AS v FROM u")
    out["order_transpose"] = sql.query(*orders, sql.backward(sql.noise("g.idx", 5)), select=f"SELECT z.idx, {r('coalesce(s, 1) * vbar', 4)} AS bar FROM z LEFT JOIN f USING (idx)")
    up = """up AS (SELECT a.node, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS r FROM (SELECT *, length(bin(node + 1)) - 1 AS l FROM t WHERE node > 0) a JOIN t b
        ON b.node = (a.node + 1 - (1::BIGINT << a.l::INTEGER)) % (1::BIGINT << (a.l - 1)::INTEGER) + (1::BIGINT << (a.l - 1)::INTEGER) - 1)"""
    bins = "fb AS (SELECT i AS bin_id, (i * i)::DOUBLE / 400000.0::DOUBLE AS r0, 1.0::DOUBLE / (1.0::DOUBLE + (i * i)::DOUBLE / 100000.0::DOUBLE) AS val FROM (SELECT unnest(range(1000)) AS i))"
    near = """nr AS (SELECT up.node, up.r, coalesce(b.bin_id, 0) AS lo, CASE WHEN b.bin_id IS NULL THEN 0 ELSE least(b.bin_id + 1, 999) END AS hi FROM up ASOF LEFT JOIN fb b ON up.r > b.r0),
        nt AS (SELECT nr.*, a.val AS v0, b.val AS v1, CASE WHEN b.r0 > a.r0 THEN (nr.r - a.r0) / (b.r0 - a.r0) ELSE 0 END AS t FROM nr JOIN fb a ON a.bin_id = lo JOIN fb b ON b.bin_id = hi)"""
    ids = f"(SELECT unnest(range({NOISES}))::INTEGER AS batch)"
    vector = lambda idx: sql.noise(f"{idx}", "11 * batch")
    out["usual_round_trip"] = sql.query(*base, select=f"SELECT batch, node AS idx, {r(vector('node'))} AS xi FROM t, {ids}")
    out["dense_solve"] = sql.query(*base, select=f"SELECT batch, node AS idx, {r(vector('node'))} AS v FROM t, {ids} WHERE node < {USUAL_N0}")
    pairs = f"""pr AS (SELECT a.node AS i, b.node AS j, sqrt({d2}) AS r FROM t a, t b WHERE a.node < {USUAL_N0} AND b.node < {USUAL_N0}),
        pn AS (SELECT pr.*, coalesce(b.bin_id, 0) AS lo, CASE WHEN b.bin_id IS NULL THEN 0 ELSE least(b.bin_id + 1, 999) END AS hi FROM pr ASOF LEFT JOIN fb b ON pr.r > b.r0),
        pk AS MATERIALIZED (SELECT i, j, CASE WHEN b.r0 > a.r0 THEN a.val + (b.val - a.val) * (pn.r - a.r0) / (b.r0 - a.r0) ELSE a.val END AS k FROM pn JOIN fu a ON a.bin_id = lo JOIN fu b ON b.bin_id = hi)"""
    jittered = "fu AS (SELECT bin_id, r0, val + CASE WHEN bin_id = 0 THEN 1e-5::DOUBLE ELSE 0.0::DOUBLE END AS val FROM fb)"
    out["dense_product"] = sql.query(*base, bins, jittered, pairs, select=f"SELECT batch, i AS idx, {r('sum(k * (' + vector('j') + '))')} AS v FROM pk, {ids} GROUP BY batch, i")
    out["cov_lookup_fine"] = sql.query(*plane, up, bins, near, select=f"SELECT node, lo::INTEGER AS lo, hi::INTEGER AS hi, {r('v0 + (v1 - v0) * t', 9)} AS val FROM nt")
    out["cov_lookup_vjp_fine"] = sql.query(*plane, up, bins, near, select=f"""SELECT bin_id::INTEGER AS bin_id, {r('sum(val)')} AS val FROM (
        SELECT lo AS bin_id, (1 - t) / (1.0::DOUBLE + node % 7) AS val FROM nt UNION ALL SELECT hi, t / (1.0::DOUBLE + node % 7) FROM nt) GROUP BY bin_id""")
    out["batch_refine"] = sql.query(*two, sql.factors(BOTH, batch=0), refined, select=f"SELECT 0 AS batch, idx, {r('v')} AS v FROM u") + "\nUNION ALL SELECT * FROM (" + sql.query(*two, sql.factors(BOTH, batch=1), refined, select=f"SELECT 1 AS batch, idx, {r('v')} AS v FROM u") + ")"
    return out | {name: _sort_sql(name) for name in SORTS}
