"""The k nearest nodes before a bound, exactly, without comparing all pairs.

1. Places that hold more than k nodes.  Of the nodes at one place only few can be neighbours at all: at ties the k least ones, or those
   that k others at the place don't precede both in number and in the search.  The others are left out, but for those that lead to
   nodes that stay.  A query with k such nodes at its own place before its bound is answered by them.
2. The tile of the query.  The tree is cut below its top tile, which is sent to all tasks, into one tile for each subtree, of
   n / 2**TILE nodes or up to 2**(TILE + 2).  The nodes of the t levels above the bound's level that share an ancestor with the query are 2**t - 1 >= 2k
   nodes before the bound and near the query, most in its tile: the k-th distance among them is a first radius for a descent of the top and
   of this tile, and the k-th distance that this finds is the radius for other tiles.
3. Other tiles.  Queries whose radius reaches into another tile meet its nodes, in groups of bounded size; the k least by
   (distance, node) of all that is found are taken.  The others, most of them, are settled in their own tile.

At ties of the k-th distance the least nodes are taken; with ``ties="met"`` those that a depth-first search meets which
goes to the nearer child first, keeps the k least by (distance, node) that it has met, and takes a further node only if it
is nearer than all but k - 1 of them.  Each visit carries its place in that search, so the outcome follows
from the pairs up to the k-th distance alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import ancestor, level_of, parent
from ..sources.points import check_neighbors, coordinates
from ..storage import materialize

#: Levels of the top tile at most; tiles below it have TILE + 2 levels at most while the tree has no more than 2 * TILE + 2.
TILE = 12
#: The bit of a path for the children of the root.
DEEPEST = 61
#: Queries of a group that visits one tile.
GROUP = 50_000
#: Nearby nodes that are looked at in one step of a task.
STEP = 1 << 21
#: Coordinates other than 0 above this have no square distance of 0 to others.
TINY = 1e-140


def _levels(node: np.ndarray) -> np.ndarray:
    """floor(log2(node + 1)), exact below 2**53."""
    return np.frexp((node + 1).astype(float))[1].astype(np.int64) - 1


def _sorted(ids, x, split, counts):
    order = np.argsort(ids)
    return ids[order], x[order], split[order], counts[order]


def _places(ids: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where nodes stand in the sorted ids, and whether they do."""
    pos = np.minimum(np.searchsorted(ids, node), max(len(ids) - 1, 0))
    return pos, ids[pos] == node if len(ids) else np.zeros(node.shape, bool)


def _squares(gap: np.ndarray) -> np.ndarray:
    d2 = gap[..., 0] * gap[..., 0]
    for j in range(1, gap.shape[-1]):
        d2 = d2 + gap[..., j] * gap[..., j]
    return d2


def _first_radius(query: np.ndarray, bound: np.ndarray, at: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, level: int) -> np.ndarray:
    """The k-th square distance among nearby nodes before the bound, or infinity; ids: of the top, of level levels, and of the queries' tile."""
    t = (2 * k).bit_length()
    fit = lambda start: np.where((start < level) & (start + t > level), level - t, start)
    r2 = np.full(len(query), np.inf)
    start = fit(np.minimum(_levels(query), _levels(bound) - t))
    while (open_ := np.flatnonzero((start >= 0) & np.isinf(r2))).size:
        for i in range(0, len(open_), STEP >> t):
            rows = open_[i : i + (STEP >> t)]
            width = np.int64(1) << start[rows]
            place = (query[rows] + 1) & (width - 1)
            near = np.concatenate([(width * (1 << j) - 1 + place)[:, None] + width[:, None] * np.arange(1 << j) for j in range(t)], axis=1)
            pos, known = _places(ids, near)
            known &= near < bound[rows, None]
            d2 = np.where(known, _squares(at[rows, None, :] - x[pos]), np.inf)
            r2[rows] = np.partition(d2, k - 1, axis=1)[:, k - 1]
        start[open_] = fit(start[open_] - t)
    return r2


def _descend(q: dict, tile: tuple, at: np.ndarray, node: np.ndarray, path: np.ndarray, low: np.ndarray, level: int, levels: int, same: bool = False):
    """Pairs found in a tile (sorted ids, coordinates, split dimensions, whether a node counts) and what is left to visit below it.

    q: arrays x, r2, bound, and lean: the dimensions, as bits, along which the left child is the nearer one on a tie.
    path: the choices that lead to a node, a bit a level from the highest on, 1 for the child farther from the query.
    low: a square distance that no node below can be nearer than.  same: find only what is at the place of the query."""
    found = []
    ids, x, split, counts = tile
    for here in range(level, level + levels):
        if not len(ids) or not len(node):
            break
        pos, ok = _places(ids, node)
        ok &= node < q["bound"][at]
        at, node, pos, path, low = at[ok], node[ok], pos[ok], path[ok], low[ok]
        gap = q["x"][at] - x[pos]
        d2 = _squares(gap)
        hit = counts[pos] & ((gap == 0).all(axis=1) if same else d2 <= q["r2"][at])
        found.append((at[hit], node[hit], d2[hit], path[hit]))
        side = gap[np.arange(len(at)), split[pos]]
        right_first = (side > 0) | ((side == 0) & ((q["lean"][at] >> split[pos]) & 1 == 0))
        square = side * side
        close = square <= q["r2"][at]
        left, right = close | (side <= 0), close | (side >= 0)
        bit, beyond = np.int64(1 << (DEEPEST - here)), np.maximum(low, square)
        path = np.concatenate([path[left] + bit * right_first[left], path[right] + bit * ~right_first[right]])
        low = np.concatenate([np.where(right_first, beyond, low)[left], np.where(right_first, low, beyond)[right]])
        node = np.concatenate([node[left] + (1 << here), node[right] + (2 << here)])
        at = np.concatenate([at[left], at[right]])
    pairs = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    return pairs, [at, node, path, low]


def _schema(dims: list[str]) -> str:
    return f"query long, bound long, {', '.join(f'q_{c} double' for c in dims)}, r2 double, lean int, node long, d2 double, path long, slot int"


def _rows(q, dims, pairs, rest, slot=None):
    """Found pairs (d2 set, and slot where the query is settled) and visits to come (d2 null) in one table."""
    at = np.concatenate([pairs[0], rest[0]]).astype(np.int64)
    node = np.concatenate([pairs[1], rest[1]]).astype(np.int64)
    path = np.concatenate([pairs[3], rest[2]]).astype(np.int64)
    visit = np.arange(len(at)) >= len(pairs[0])
    d2 = pa.array(np.concatenate([pairs[2], np.zeros(len(rest[0]))]), mask=visit)
    slots = np.full(len(at), -1, np.int32)
    if slot is not None:
        slots[: len(slot)] = slot
    moving = {f"q_{c}": pa.array(q["x"][at, i], mask=~visit) for i, c in enumerate(dims)} | {"r2": pa.array(q["r2"][at], mask=~visit)}
    return pa.table({"query": q["query"][at], "bound": q["bound"][at], **moving, "lean": q["lean"][at].astype(np.int32), "node": node, "d2": d2, "path": path, "slot": pa.array(slots, mask=slots < 0)})


def _tile_of(table: pa.Table, dims: list[str]) -> tuple:
    x = np.column_stack([table.column(c).to_numpy() for c in dims])
    return _sorted(table.column("node").to_numpy(), x, table.column("split_dim").to_numpy(), table.column("counts").to_numpy(zero_copy_only=False))


def _settle(asked, tile, top, root, dims, k, level, n, settled):
    """The k least of the top and of the queries' own tile for each query, with its visits to other tiles; in steps.

    asked: query and bound, and the coordinates where the tree lacks some of the queries."""
    ids, x = (np.concatenate([a, b]) for a, b in zip(top[:2], tile[:2], strict=True))  # sorted, as the top has the lowest
    for i in range(0, asked.num_rows, 1 << 14):
        part = asked.slice(i, 1 << 14)
        query, bound = part.column("query").to_numpy(), part.column("bound").to_numpy()
        if f"q_{dims[0]}" in asked.column_names:
            place = np.column_stack([part.column(f"q_{c}").to_numpy() for c in dims])
        else:
            pos, known = _places(ids, query)
            query, bound, place = query[known], bound[known], x[pos[known]]
        q = {"query": query, "bound": bound, "x": place, "lean": np.zeros(len(query), np.int64), "r2": _first_radius(query, bound, place, ids, x, k, level)}
        at, zero = np.arange(len(query)), np.zeros(len(query), np.int64)
        pairs, rest = _descend(q, top, at, zero, zero, np.zeros(len(query)), 0, level)
        own = rest[1] == root
        more, _ = _descend(q, tile, *(r[own] for r in rest), level, DEEPEST + 1 - level)
        pairs = [np.concatenate(c) for c in zip(pairs, more, strict=True)]
        order = np.lexsort((pairs[1], pairs[2], pairs[0]))
        pairs = [c[order] for c in pairs]
        rank = np.arange(len(order)) - np.searchsorted(pairs[0], pairs[0])
        kth = rank == k - 1
        q["r2"][pairs[0][kth]] = pairs[2][kth]
        keep = pairs[2] <= q["r2"][pairs[0]]
        pairs, rank = [c[keep] for c in pairs], rank[keep]
        go = ~own & (rest[1] < np.minimum(bound[rest[0]], n)) & (rest[3] <= q["r2"][rest[0]])
        rest = [r[go] for r in rest]
        if settled:
            going = np.zeros(len(query), bool)
            going[rest[0]] = True
            keep = going[pairs[0]] | (rank < k)
            pairs, rank = [c[keep] for c in pairs], rank[keep]
            yield _rows(q, dims, pairs, rest, np.where(going[pairs[0]], -1, rank))
        else:
            yield _rows(q, dims, pairs, rest)


def _visited(state: DataFrame, tree: DataFrame, dims: list[str], level: int, same: bool = False) -> DataFrame:
    """The pairs that the visits of a state find in their tiles, whose roots are of that level."""
    visits = state.where("d2 is null").withColumn("tile", F.col("node"))
    # as many groups for a tile as its visits, counted, fill
    salts = materialize(visits.groupBy("tile").agg(F.ceil(F.count("*") / GROUP).alias("salts")))  # a row a tile of the top's 2**level
    visits = visits.join(F.broadcast(salts), "tile").withColumn("salt", F.pmod(F.xxhash64("query"), F.col("salts")))
    below = tree.where(F.col("node") >= (1 << level) - 1).withColumn("tile", ancestor(F.col("node"), F.lit(level)))
    below = below.join(F.broadcast(salts), "tile").select(F.col("tile").alias("to_tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("to_salt"), "node", *dims, "split_dim", "counts")

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        q = {c: left.column(c).to_numpy() for c in ("query", "bound", "r2", "lean")} | {"x": np.column_stack([left.column(f"q_{c}").to_numpy() for c in dims])}
        at, tile = np.arange(left.num_rows), _tile_of(right, dims)
        pairs, _ = _descend(q, tile, at, left.column("node").to_numpy(), left.column("path").to_numpy(), np.zeros(len(at)), level, DEEPEST + 1 - level, same)
        return _rows(q, dims, pairs, [np.zeros(0, np.int64)] * 4)

    return visits.groupBy("tile", "salt").cogroup(below.groupBy("to_tile", "to_salt")).applyInArrow(visit, _schema(dims))


def _first_met(pairs: pa.Table, k: int) -> pa.Table:
    """Of the nodes at a place (query, lean), those that fewer than k others precede both in number and in the search."""
    table = pairs.sort_by([("query", "ascending"), ("lean", "ascending"), ("node", "ascending")])
    query, lean, path = (table.column(c).to_numpy() for c in ("query", "lean", "path"))
    cuts = np.flatnonzero((np.diff(query) != 0) | (np.diff(lean) != 0)) + 1
    keep = np.ones(len(path), bool)
    for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(path)], strict=True):
        run, last = path[a:e], np.iinfo(np.int64).max
        for _ in range(k):  # the next least path among those before
            least = np.minimum.accumulate(run)
            before = np.concatenate([[last], least[:-1]])
            run = np.maximum(run, before)
        keep[a:e] = path[a:e] < before
    return table.filter(pa.array(keep))


def _kept(tree: DataFrame, members: DataFrame, places: DataFrame, dims: list[str], k: int, ties: str, top, level: int, n: int) -> DataFrame:
    """coordinates, lean, node, path: what can be a neighbour at crowded places, and its place in the search of a query."""
    if ties == "least":
        first = members.withColumn("_rank", F.row_number().over(Window.partitionBy(*dims).orderBy("node"))).where(F.col("_rank") <= k)
        return first.select(*dims, F.lit(0).alias("lean"), "node", F.col("node").alias("path"))
    places = materialize(places.withColumn("query", F.monotonically_increasing_id()))
    leans = F.explode(F.sequence(F.lit(0), F.lit((1 << len(dims)) - 1))).alias("lean")

    def from_root(batches):
        for batch in batches:
            m = batch.num_rows
            q = {"query": batch.column("query").to_numpy(), "bound": np.full(m, n), "r2": np.zeros(m), "lean": batch.column("lean").to_numpy().astype(np.int64), "x": np.column_stack([batch.column(c).to_numpy() for c in dims])}
            zero = np.zeros(m, np.int64)
            pairs, rest = _descend(q, top.value, np.arange(m), zero, zero, np.zeros(m), 0, level, same=True)
            go = rest[1] < n
            yield from _rows(q, dims, pairs, [r[go] for r in rest]).to_batches()

    state = materialize(places.select("query", *dims, leans).mapInArrow(from_root, _schema(dims)))
    found = state.where("d2 is not null").unionByName(_visited(state, tree, dims, level, same=True)).select("query", "lean", "node", "path")
    schema = "query long, lean int, node long, path long"
    # each batch first, so that a large place isn't one task's
    few = found.mapInArrow(lambda batches: (b for batch in batches for b in _first_met(pa.Table.from_batches([batch]), k).to_batches()), schema)
    few = few.groupBy("query", "lean").applyInArrow(lambda table: _first_met(table, k), schema)
    return few.join(places, "query").select(*dims, "lean", "node", "path")


def _thinned(tree: DataFrame, dims: list[str], k: int, ties: str, top, level: int, n: int) -> tuple[DataFrame, DataFrame | None]:
    """The tree without what can't be a neighbour, and query, firsts: the nodes at a query's own place that can be, in the order of the search."""
    places = materialize(tree.groupBy(*dims).agg(F.count("*").alias("_n")).where(F.col("_n") > k).select(*dims))
    if not places.limit(1).count():
        return tree, None
    members = materialize(tree.select("node", *dims).join(places, dims))
    kept = materialize(_kept(tree, members, places, dims, k, ties, top, level, n))
    spare = materialize(members.select("node").join(kept.select("node"), "node", "left_anti"))
    # a spare node stays if a node that is none is below it
    above = tree.select("node").join(spare, "node", "left_anti").select(parent(F.col("node")).alias("node"))
    seeds = spare.join(above, "node", "left_semi")
    upward = seeds.select("node", F.explode(F.sequence(F.lit(0), level_of(F.col("node")))).alias("up")).select(ancestor(F.col("node"), F.col("up")).alias("node")).distinct()
    lead = spare.join(upward, "node", "left_semi")
    thin = materialize(tree.join(spare, "node", "left_anti").unionByName(tree.join(lead, "node", "left_semi").withColumn("counts", F.lit(False))))
    least = tree.agg(F.least(*(F.coalesce(F.min(F.when(F.col(c) != 0, F.abs(c))), F.lit(1.0)) for c in [*dims, dims[0]]))).first()[0]
    if least < TINY:  # other places may be at a distance of 0
        return thin, None
    finite = " and ".join(f"{c} - {c} = 0" for c in dims)
    firsts = kept.where("lean = 0").where(finite).groupBy(*dims).agg(F.sort_array(F.collect_list(F.struct("path", "node"))).alias("firsts"))
    return thin, tree.select(F.col("node").alias("query"), *dims).join(firsts, dims).select("query", "firsts")


def _met(pairs: DataFrame, k: int) -> DataFrame:
    """pairs without those at the k-th distance of their query that the search doesn't keep."""
    by = ["query", "bound"]
    ranked = pairs.withColumn("_slot", F.row_number().over(Window.partitionBy(*by).orderBy("d2", "node")))
    kth = ranked.where(F.col("_slot") == k).select(*by, F.col("d2").alias("kth"))
    near = pairs.join(kth, by, "left").where(F.col("kth").isNull() | (F.col("d2") <= F.col("kth")))
    # in the order of the search: a node before its children, the nearer child and all below it before the other one
    visits = F.sort_array(F.collect_list(F.struct("path", "node", (F.col("d2") == F.col("kth")).alias("tied"))))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("tied"))

    def step(kept, visit):
        full, tied = kept["n"] == k, kept["tied"]
        one_less = F.filter(tied, lambda x: x != F.array_max(tied))
        more = F.struct((kept["n"] + 1).alias("n"), F.when(visit["tied"], F.concat(tied, F.array(visit["node"]))).otherwise(tied).alias("tied"))
        instead = F.struct(kept["n"].alias("n"), one_less.alias("tied"))
        return F.when(~full, more).when(visit["tied"], kept).otherwise(instead)

    chosen = near.where("kth is not null").groupBy(*by).agg(F.aggregate(visits, start, step)["tied"].alias("kept"))
    return near.join(chosen, by, "left").where(F.col("kth").isNull() | (F.col("d2") < F.col("kth")) | F.array_contains("kept", F.col("node"))).select(*pairs.columns)


def query_neighbors(tree: DataFrame, queries: DataFrame, k: int, pad: bool = False, ties: str = "least") -> DataFrame:
    """query, slot, nb, d2: the k nodes nearest to each query among nodes before its bound.

    queries: query (a node) and bound.  Order within a query is by (d2, nb).  A query counts itself if
    it is before its bound, and the root always counts.  With fewer than k candidates the rest
    of the slots are left out, or filled with node 0 and an infinite distance if pad is set.
    """
    asked = queries.select("query", F.greatest("bound", F.lit(1)).cast("long").alias("bound")).distinct()
    return _neighbors(tree, asked, k, pad, ties)


def _neighbors(tree: DataFrame, asked: DataFrame, k: int, pad: bool, ties: str) -> DataFrame:
    check_neighbors(k)
    if ties not in ("least", "met"):
        raise ValueError(f"ties are broken by 'least' or 'met', not {ties!r}")
    dims = coordinates(tree)
    spark, n = tree.sparkSession, tree.count()
    whole = n < 1 << TILE
    level = TILE if whole else max(1, min(TILE, n.bit_length() - TILE - 1))

    def sent(table):
        top = table.where(F.col("node") < (1 << level) - 1).select("node", *dims, "split_dim", "counts").toPandas()  # fewer than 2**TILE rows
        return spark.sparkContext.broadcast(_sorted(top["node"].to_numpy(np.int64), top[dims].to_numpy(float), top["split_dim"].to_numpy(), top["counts"].to_numpy(bool)))

    tree = tree.select("node", *dims, "split_dim", F.lit(True).alias("counts"))
    every, (thin, firsts) = asked, _thinned(tree, dims, k, ties, sent(tree), level, n)
    at_place = None
    if firsts is not None:
        asked = materialize(asked.join(firsts, "query", "left").withColumn("firsts", F.filter("firsts", lambda f: f["node"] < F.col("bound"))))
        enough = F.coalesce(F.size("firsts") >= k, F.lit(False))
        nodes = F.sort_array(F.transform(F.slice("firsts", 1, k), lambda f: f["node"]))
        at_place = asked.where(enough).select("query", "bound", F.posexplode(nodes).alias("slot", "nb"), F.lit(0.0).alias("d2"))
        asked = asked.where(~enough).select("query", "bound")
    if thin is not tree:
        asked = asked.join(tree.select(F.col("node").alias("query"), *(F.col(c).alias(f"q_{c}") for c in dims)), "query")
    top = sent(thin)
    if whole:
        none = tuple(c[:0] for c in top.value)

        def alone(batches):
            for batch in batches:
                for rows in _settle(pa.Table.from_batches([batch]), none, top.value, -1, dims, k, level, n, ties == "least"):
                    yield from rows.to_batches()

        state = materialize(asked.mapInArrow(alone, _schema(dims)))
        pairs = state.where("slot is null")
    else:

        def together(left: pa.Table, right: pa.Table) -> pa.Table:
            root = (left if left.num_rows else right).column("tile")[0].as_py()
            done = list(_settle(left, _tile_of(right, dims), top.value, root, dims, k, level, n, ties == "least"))
            return pa.concat_tables(done) if done else _rows({"query": np.zeros(0, np.int64), "bound": np.zeros(0, np.int64), "x": np.zeros((0, len(dims))), "r2": np.zeros(0), "lean": np.zeros(0, np.int64)}, dims, [np.zeros(0)] * 4, [np.zeros(0)] * 4)

        tile = lambda c: ancestor(F.col(c), F.lit(level)).alias("tile")  # noqa: E731  # the first one below, for a query in the top
        below = thin.where(F.col("node") >= (1 << level) - 1).select(tile("node"), "*")
        state = materialize(asked.select(tile("query"), "*").groupBy("tile").cogroup(below.groupBy("tile")).applyInArrow(together, _schema(dims)))
        pairs = state.where("slot is null and d2 is not null").unionByName(_visited(state, thin, dims, level))
    if ties == "met":
        pairs = _met(materialize(pairs.select("query", "bound", "node", "d2", "path")), k)
    best = Window.partitionBy("query", "bound").orderBy("d2", "node")
    ranked = pairs.select("query", "bound", "node", "d2", (F.row_number().over(best) - 1).alias("slot")).where(F.col("slot") < k)
    ranked = ranked.unionByName(state.where("slot is not null").select("query", "bound", "node", "d2", "slot"))
    ranked = ranked.select("query", "bound", "slot", F.col("node").alias("nb"), "d2")
    if at_place is not None:
        ranked = ranked.unionByName(at_place)
    if pad:
        there = every.join(tree.select(F.col("node").alias("query")), "query", "left_semi")
        slots = there.select("query", "bound", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
        ranked = slots.join(ranked, ["query", "bound", "slot"], "left").fillna({"nb": 0, "d2": float("inf")})
    return ranked


def query_preceding_neighbors(tree: DataFrame, n0: int, k: int, pad: bool = False, ties: str = "least") -> DataFrame:
    """idx, slot, nb, d2 for every node from n0 on: its k nearest among the nodes before it."""
    if n0 < k and not pad:
        raise ValueError(f"n0 = {n0} leaves the first queries fewer than k = {k} candidates; use pad")
    asked = tree.where(F.col("node") >= n0).select(F.col("node").alias("query"), F.greatest("node", F.lit(1)).cast("long").alias("bound"))
    return _neighbors(tree, asked, k, pad, ties).select(F.col("query").alias("idx"), "slot", "nb", "d2")
