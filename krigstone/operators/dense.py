"""Dense algebra on the start of a field as a table of tiles: (batch, i, j, block), lower triangle only.

The covariance of the first n0 points is cut into tiles of TILE * TILE values (row-major doubles).  The
Cholesky factor is made column of tiles by column of tiles: the pivot tile is factorised, those below it are solved
against it, and each tile to the right meets the two tiles of the column that it takes a product of.  No
task holds more than a row of tiles, and nothing of the matrix is on the driver.  Each column is two jobs; their
tables are in the shared folder.

Right-hand sides are tables (batch, part, i, ids, block): row i of tiles, a column for each noise, whose
numbers are ids; at most NOISES noises to a part.  ``batch`` is that of the covariance.

A matrix that isn't positive definite gives NaN from the tile on where it fails.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.covariance import Covariance, lookup, weights
from ..sources.points import coordinates
from ..storage import materialize

TILE = 512
NOISES = 64
TILES = "batch int, i int, j int, block binary, moved binary"
SIDES = "batch int, part int, i int, ids array<int>, block binary"


def tiles_in(n0: int, tile: int) -> int:
    return -(-n0 // tile)


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, columns)


def _size(i: int, n0: int, tile: int) -> int:
    return min(tile, n0 - i * tile)


def _upto(low, high) -> F.Column:
    """The numbers from low to high, both included, one a row; no row where there are none."""
    return F.explode(F.when(low <= high, F.sequence(low, high)))


def _positions(points: DataFrame, n0: int, tile: int) -> DataFrame:
    """i and at: coordinates of the points of a row of tiles."""
    dims = coordinates(points)
    first = points.where(F.col("idx") < n0).select(F.floor(F.col("idx") / tile).cast("int").alias("i"), "idx", F.array(*dims).alias("x"))
    return first.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("l")).select("i", F.flatten("l.x").alias("at"))


def tile_pairs(points: DataFrame, n0: int, tile: int = TILE) -> DataFrame:
    """i, j and the coordinates of both, for i >= j."""
    rows = _positions(points, n0, tile)
    below = rows.select("i", F.col("at").alias("at_i"), _upto(F.lit(0), F.col("i")).alias("j"))
    return below.join(rows.select(F.col("i").alias("j"), F.col("at").alias("at_j")), "j").select("i", "j", "at_i", "at_j")


def _distances(table: pa.Table, d: int, row: int = 0) -> np.ndarray:
    a, b = (np.asarray(table.column(c)[row].values).reshape(-1, d) for c in ("at_i", "at_j"))
    gap = a[:, None, :] - b[None, :, :]
    return np.sqrt((gap * gap).sum(axis=2))


def covariance_tiles(points: DataFrame, n0: int, cov: Covariance, dcov: Covariance | None = None, tile: int = TILE) -> DataFrame:
    """TILES of the covariance of the first n0 points, and with dcov of its derivative (moved)."""
    d, bins = len(coordinates(points)), np.array(cov.bins)
    values = [np.array(v) for v in cov.values]
    moved = [np.array(v) for v in dcov.values] if dcov else [None] * len(values)

    def make(table: pa.Table) -> pa.Table:
        r = _distances(table, d)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        blocks, changes = [], []
        for v, dv in zip(values, moved, strict=True):
            blocks.append(lookup(bins, v, r).tobytes())
            changes.append(lookup(bins, dv, r).tobytes() if dv is not None else None)
        n = len(values)
        return pa.table({"batch": pa.array(range(n), pa.int32()), "i": pa.array([i] * n, pa.int32()), "j": pa.array([j] * n, pa.int32()), "block": pa.array(blocks, pa.binary()), "moved": pa.array(changes, pa.binary())})

    return materialize(tile_pairs(points, n0, tile).groupBy("i", "j").applyInArrow(make, TILES))


def half(a: np.ndarray) -> np.ndarray:
    """The lower triangle with half of the diagonal."""
    return np.tril(a) - np.diag(np.diag(a)) / 2


def cholesky(K: np.ndarray) -> np.ndarray:
    try:
        L = np.linalg.cholesky(K)
    except np.linalg.LinAlgError:
        L = np.full_like(K, np.nan)
    return L if np.isfinite(L).all() else np.full_like(K, np.nan)


def cholesky_jvp(L: np.ndarray, dK: np.ndarray) -> np.ndarray:
    """The derivative of the Cholesky factor L of K along the symmetric dK."""
    inner = np.linalg.solve(L, np.linalg.solve(L, dK).T)
    return L @ half(inner)


def cholesky_vjp(L: np.ndarray, L_bar: np.ndarray) -> np.ndarray:
    """The symmetric cotangent of K from the cotangent of its Cholesky factor (lower triangle)."""
    inner = np.linalg.solve(L.T, half(L.T @ np.tril(L_bar)))
    whole = np.linalg.solve(L.T, inner.T).T
    return (whole + whole.T) / 2


def _roles(table: pa.Table) -> dict[int, list[dict]]:
    """Rows by their role; a group has a row of tiles at most."""
    out: dict[int, list[dict]] = {}
    for row in table.to_pylist():
        out.setdefault(row["role"], []).append(row)
    return out


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _as(df: DataFrame, role: int, *columns) -> DataFrame:
    return df.select(*columns, F.lit(role).alias("role"))


def factorize_tiles(tiles: DataFrame, n0: int, tile: int = TILE) -> DataFrame:
    """TILES of the Cholesky factor, and of its derivative where tiles have one (moved)."""
    n, done = tiles_in(n0, tile), []

    def panel(table: pa.Table) -> pa.Table:
        roles = _roles(table)
        own, pivot = roles[0][0], roles[1][0]
        size = _size(pivot["j"], n0, tile)
        L = cholesky(_matrix(pivot["block"], size))
        dL = cholesky_jvp(L, _matrix(pivot["moved"], size)) if pivot["moved"] is not None else None
        block, moved = L, dL
        if own["i"] != own["j"]:
            A = _matrix(own["block"], size)
            block = np.linalg.solve(L, A.T).T
            if dL is not None:
                moved = np.linalg.solve(L, (_matrix(own["moved"], size) - block @ dL.T).T).T
        return _tile(own, block, moved)

    def update(table: pa.Table) -> pa.Table:
        roles = _roles(table)
        own, left, right = (roles[k][0] for k in range(3))
        width = _size(left["k"], n0, tile)
        a, b = (_matrix(x["block"], width) for x in (left, right))
        block = _matrix(own["block"], len(b)) - a @ b.T
        moved = None
        if own["moved"] is not None:
            da, db = (_matrix(x["moved"], width) for x in (left, right))
            moved = _matrix(own["moved"], len(b)) - da @ b.T - a @ db.T
        return _tile(own, block, moved)

    for k in range(n):
        column = tiles.where(F.col("j") == k)
        pivot = column.where(F.col("i") == k)
        rows = _union(_as(column, 0, "batch", "i", "j", "block", "moved"), _as(pivot, 1, "batch", _upto(F.lit(k), F.lit(n - 1)).alias("i"), "j", "block", "moved"))
        done.append(materialize(rows.groupBy("batch", "i").applyInArrow(panel, TILES)))
        if k + 1 < n:
            below = done[-1].where(F.col("i") > k)
            parts = _union(
                _as(tiles.where(F.col("j") > k).withColumn("k", F.lit(k)), 0, "batch", "i", "j", "k", "block", "moved"),
                _as(below, 1, "batch", "i", _upto(F.lit(k + 1), F.col("i")).alias("j"), F.lit(k).alias("k"), "block", "moved"),
                _as(below, 2, "batch", _upto(F.col("i"), F.lit(n - 1)).alias("i"), F.col("i").alias("j"), F.lit(k).alias("k"), "block", "moved"),
            )
            tiles = materialize(parts.groupBy("batch", "i", "j").applyInArrow(update, TILES))
    return _union(*done)


def _tile(own: dict, block: np.ndarray, moved: np.ndarray | None) -> pa.Table:
    out = {c: pa.array([own[c]], pa.int32()) for c in ("batch", "i", "j")}
    return pa.table({**out, "block": pa.array([np.ascontiguousarray(block).tobytes()], pa.binary()), "moved": pa.array([None if moved is None else np.ascontiguousarray(moved).tobytes()], pa.binary())})


def sides(values: DataFrame, name: str, n0: int, shared: bool, tile: int = TILE) -> DataFrame:
    """SIDES from values(batch, idx, name): those below n0; a missing one counts as 0.  ``shared``: all batches have covariance 0."""
    first = values.where(F.col("idx") < n0)
    cov = F.lit(0) if shared else F.col("batch")
    part = F.floor(F.col("batch") / NOISES).cast("int") if shared else F.lit(0)
    keyed = first.select(cov.cast("int").alias("cov"), part.alias("part"), F.floor(F.col("idx") / tile).cast("int").alias("i"), "batch", "idx", F.col(name).alias("value"))
    # every row of tiles has the same noises, whichever values there are
    every = keyed.select("cov", "part", "batch").distinct().groupBy("cov", "part").agg(F.sort_array(F.collect_list("batch")).alias("ids"))

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        cov, part, ids = (left.column(c)[0].as_py() for c in ("cov", "part", "ids"))
        i = left.column("i")[0].as_py()
        out = np.zeros((_size(i, n0, tile), len(ids)))
        if right.num_rows:
            out[right.column("idx").to_numpy() - i * tile, np.searchsorted(ids, right.column("batch").to_numpy())] = right.column("value").to_numpy()
        return pa.table({"batch": pa.array([cov], pa.int32()), "part": pa.array([part], pa.int32()), "i": pa.array([i], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int32())), "block": pa.array([out.tobytes()], pa.binary())})

    wanted = every.select("cov", "part", "ids", _upto(F.lit(0), F.lit(tiles_in(n0, tile) - 1)).alias("i"))
    found = keyed.select(F.col("cov").alias("of"), F.col("part").alias("of_part"), F.col("i").alias("of_i"), "batch", "idx", "value")
    return materialize(wanted.groupBy("cov", "part", "i").cogroup(found.groupBy("of", "of_part", "of_i")).applyInArrow(pack, SIDES))


def unpack(found: DataFrame, name: str, tile: int = TILE) -> DataFrame:
    """batch, idx, name: one row for each value of SIDES."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["ids"], np.int32)
                block = _matrix(row["block"], len(ids))
                idx = np.arange(len(block), dtype=np.int64) + row["i"] * tile
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(block))), pa.array(np.repeat(idx, len(ids))), pa.array(block.ravel())], ["batch", "idx", name])

    return found.mapInArrow(run, f"batch int, idx long, {name} double")


def _against(factor: DataFrame, side: DataFrame, column: str = "block") -> DataFrame:
    """Rows of the factor for each part of its right-hand sides."""
    parts = side.select("batch", "part").distinct()
    return factor.join(parts, "batch").select("batch", "part", "i", "j", F.col(column).alias("block"), F.lit(None).cast("array<int>").alias("ids"))


def _side(like: dict, i: int, block: np.ndarray) -> pa.Table:
    return pa.table({
        "batch": pa.array([like["batch"]], pa.int32()), "part": pa.array([like["part"]], pa.int32()), "i": pa.array([i], pa.int32()),
        "ids": pa.array([like["ids"]], pa.list_(pa.int32())), "block": pa.array([np.ascontiguousarray(block).tobytes()], pa.binary()),
    })


def times(factor: DataFrame, side: DataFrame, n0: int, transpose: bool = False, column: str = "block", tile: int = TILE) -> DataFrame:
    """SIDES: the factor (or its derivative, column moved), or its transpose, times right-hand sides, in one job."""
    n = tiles_in(n0, tile)
    own, other = ("j", "i") if transpose else ("i", "j")
    to = _upto(F.lit(0), F.col("i")) if transpose else _upto(F.col("i"), F.lit(n - 1))

    def add(table: pa.Table) -> pa.Table:
        roles = _roles(table)
        at = {x["other"]: x for x in roles[1]}
        total = None
        for x in roles[0]:
            y = at[x["other"]]
            L = _matrix(x["block"], _size(x["to"] if transpose else x["other"], n0, tile))
            part = (L.T if transpose else L) @ _matrix(y["block"], len(y["ids"]))
            total = part if total is None else total + part
        return _side(y, roles[0][0]["to"], total)

    L = _against(factor, side, column).select("batch", "part", F.col(own).alias("to"), F.col(other).alias("other"), "ids", "block")
    rows = _union(_as(L, 0, "batch", "part", "to", "other", "ids", "block"), _as(side, 1, "batch", "part", to.alias("to"), F.col("i").alias("other"), "ids", "block"))
    return rows.groupBy("batch", "part", "to").applyInArrow(add, SIDES)


def solve(factor: DataFrame, side: DataFrame, n0: int, transpose: bool = False, tile: int = TILE) -> DataFrame:
    """SIDES: x with L x = side, or with L' x = side: one row of tiles after the other, a job each."""
    n, done = tiles_in(n0, tile), []

    def step(table: pa.Table) -> pa.Table:
        roles = _roles(table)
        right = roles[1][0]
        rest, pivot = _matrix(right["block"], len(right["ids"])), None
        known = {x["i"]: x for x in roles.get(2, ())}
        for x in roles[0]:
            L = _matrix(x["block"], _size(x["j"], n0, tile))
            if x["i"] == x["j"]:
                pivot = L
            else:
                y = known[x["i"] if transpose else x["j"]]
                rest = rest - (L.T if transpose else L) @ _matrix(y["block"], len(y["ids"]))
        return _side(right, right["i"], np.linalg.solve(pivot.T if transpose else pivot, rest))

    L = _against(factor, side)
    for k in reversed(range(n)) if transpose else range(n):
        line = L.where(F.col("j" if transpose else "i") == k)
        wanted = side.where(F.col("i") == k).withColumn("j", F.lit(k))
        rows = [_as(x.withColumn("j", F.lit(k)) if role == 2 else x, role, "batch", "part", "i", "j", "ids", "block") for role, x in [(0, line), (1, wanted), *((2, d) for d in done)]]
        done.append(materialize(_union(*rows).groupBy("batch", "part").applyInArrow(step, SIDES)))
    return _union(*done)


def logdet(factor: DataFrame) -> DataFrame:
    """batch, logdet: the sum of the logarithms of the factor's diagonal."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                L = _matrix(row["block"], round((len(row["block"]) // 8) ** 0.5))  # a square
                yield pa.RecordBatch.from_arrays([pa.array([row["batch"]], pa.int32()), pa.array([np.log(np.diag(L)).sum()])], ["batch", "part"])

    return factor.where("i = j").select("batch", "block").mapInArrow(run, "batch int, part double").groupBy("batch").agg(F.sum("part").alias("logdet"))


BARS = "batch int, id int, i int, j int, kind int, block binary"


def outer(left: DataFrame, right: DataFrame, n0: int, each: bool, tile: int = TILE) -> DataFrame:
    """BARS (kind 0): the lower triangle of left right', the cotangent of a factor whose product with right has the
    cotangent left.  ``each``: one for every noise (id), else one for each covariance (id = batch)."""
    n = tiles_in(n0, tile)

    def make(table: pa.Table) -> pa.Table:
        roles = _roles(table)
        i, j = table.column("to_i")[0].as_py(), table.column("to_j")[0].as_py()
        other = {x["part"]: x for x in roles[1]}
        found: dict[int, np.ndarray] = {}
        for x in roles[0]:
            y = other[x["part"]]
            a, b = (_matrix(z["block"], len(z["ids"])) for z in (x, y))
            for c, noise in enumerate(x["ids"]):
                made = np.outer(a[:, c], b[:, c])
                made = np.tril(made) if i == j else made
                key = noise if each else x["batch"]
                found[key] = made if key not in found else found[key] + made
        return _bars([(x["batch"], key, i, j, 0, block) for key, block in found.items()])

    low = _as(left, 0, "batch", "part", F.col("i").alias("to_i"), _upto(F.lit(0), F.col("i")).alias("to_j"), "ids", "block")
    high = _as(right, 1, "batch", "part", _upto(F.col("i"), F.lit(n - 1)).alias("to_i"), F.col("i").alias("to_j"), "ids", "block")
    by = ["batch", "part", "to_i", "to_j"] if each else ["batch", "to_i", "to_j"]
    return materialize(_union(low, high).groupBy(*by).applyInArrow(make, BARS))


def _bars(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int32()) for c in columns[:5]] + [pa.array([np.ascontiguousarray(b).tobytes() for b in columns[5]], pa.binary())]
    return pa.table(arrays, names=["batch", "id", "i", "j", "kind", "block"])


def factor_cotangent(factor: DataFrame, bars: DataFrame, n0: int, tile: int = TILE) -> DataFrame:
    """BARS (kind 1) of the covariance from those of its factor: the columns of tiles in reverse.

    Those on the diagonal are symmetric; those below it stand for themselves and their mirror image.
    """
    n, done = tiles_in(n0, tile), []
    by = bars.select("batch", "id").distinct()
    L = factor.join(by, "batch").select("batch", "id", "i", "j", F.lit(2).alias("kind"), "block")

    def below(table: pa.Table) -> pa.Table:
        """Tile (i, k) of the covariance, and what the pivot of column k receives through it (kind 3)."""
        rows, total = table.to_pylist(), None
        i, k = rows[0]["to"], rows[0]["k"]
        width = _size(k, n0, tile)
        blocks = {(x["kind"], x["i"], x["j"]): x["block"] for x in rows}
        G = _matrix(blocks[0, i, k], width)
        for (kind, a, b), data in blocks.items():
            if kind == 1:
                other = b if a == i else a
                S = _matrix(data, _size(b, n0, tile))
                S = 2 * S if a == b else S if a == i else S.T
                G = G - S @ _matrix(blocks[2, other, k], width)
        pivot, own = _matrix(blocks[2, k, k], width), _matrix(blocks[2, i, k], width)
        A = np.linalg.solve(pivot.T, G.T).T
        total = -np.tril(A.T @ own)
        return _bars([(rows[0]["batch"], rows[0]["id"], i, k, 1, A), (rows[0]["batch"], rows[0]["id"], k, k, 3, total)])

    def pivots(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        width = round((len(rows[0]["block"]) // 8) ** 0.5)
        received = sum(_matrix(x["block"], width) for x in rows if x["kind"] in (0, 3))
        pivot = next(_matrix(x["block"], width) for x in rows if x["kind"] == 2)
        return _bars([(rows[0]["batch"], rows[0]["id"], rows[0]["i"], rows[0]["j"], 1, cholesky_vjp(pivot, received))])

    for k in reversed(range(n)):
        column, mine = L.where(F.col("j") == k), bars.where(F.col("j") == k)
        parts = [column.where(F.col("i") == k), mine.where(F.col("i") == k)]
        if k + 1 < n:
            every = ("batch", "id", "i", "j", "kind", "block", F.lit(k).alias("k"))
            low = column.where(F.col("i") > k)
            rows = [
                mine.where(F.col("i") > k).select(*every, F.col("i").alias("to")),
                column.where(F.col("i") == k).select(*every, _upto(F.lit(k + 1), F.lit(n - 1)).alias("to")),
                low.select(*every, _upto(F.lit(k + 1), F.lit(n - 1)).alias("to")),
                *(d.select(*every, F.explode(F.array_distinct(F.array("i", "j"))).alias("to")) for d in done),
            ]
            found = materialize(_union(*rows).groupBy("batch", "id", "to").applyInArrow(below, BARS))
            done.append(found.where("kind = 1"))
            parts.append(found.where("kind = 3"))
        done.append(materialize(_union(*parts).groupBy("batch", "id").applyInArrow(pivots, BARS)))
    return _union(*done)


def to_bins(points: DataFrame, n0: int, bars: DataFrame, cov: Covariance, tile: int = TILE) -> DataFrame:
    """batch (id of bars), bin_id, cov_bar: what the bins receive from the cotangent of the covariance."""
    d, bins = len(coordinates(points)), np.array(cov.bins)
    n = len(bins)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, parts = [], []
        if left.num_rows and right.num_rows:
            lo, hi, t = (x.ravel() for x in weights(bins, _distances(left, d)))
            for row in right.to_pylist():
                bar = np.frombuffer(row["block"], np.float64)
                ids.append(row["id"])
                parts.append(np.bincount(lo, bar * (1 - t), n) + np.bincount(hi, bar * t, n))
        return pa.table({"batch": pa.array(np.repeat(np.array(ids, np.int32), n)), "bin_id": pa.array(np.tile(np.arange(n, dtype=np.int32), len(ids))), "cov_bar": pa.array(np.concatenate([*parts, np.zeros(0)]))})

    pairs = tile_pairs(points, n0, tile)
    found = pairs.groupBy("i", "j").cogroup(bars.select("i", "j", "id", "block").groupBy("i", "j")).applyInArrow(run, "batch int, bin_id int, cov_bar double")
    return found.groupBy("batch", "bin_id").agg(F.sum("cov_bar").alias("cov_bar"))
