"""SQL for another engine that derives the same results from the same tables, step by step.

Each function gives the text of common table expressions; ``query`` puts a chain of them together.
The forms are unrolled for three dimensions (two with the third at 0), two or four neighbours and, for whole fields, a start of
three points.  Trees and graphs that are deeper than the unrolling raise an error.
"""

from __future__ import annotations

LEVELS = 13  # of the tree: up to 8191 points
DEPTHS = 40  # of the graph


def query(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def points() -> str:
    at = ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(3))
    return f"p AS (SELECT vec_id::BIGINT AS point_id, {at} FROM embeddings)"


def order_points() -> str:
    """Orders as points in a plane: the third coordinate is 0."""
    return """p AS (SELECT o_orderkey::BIGINT AS point_id, o_totalprice / 500000.0::DOUBLE AS x0,
      date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 2500.0::DOUBLE AS x1, 0.0::DOUBLE AS x2 FROM orders)"""


def tree(levels: int = LEVELS) -> str:
    """t: node, point_id, x0, x1, x2, split_dim."""
    out = ["s0 AS MATERIALIZED (SELECT *, 0::BIGINT AS tag FROM p)"]
    for level in range(levels):
        out += [
            f"""g{level} AS (SELECT *, max(x0) OVER w - min(x0) OVER w AS g0, max(x1) OVER w - min(x1) OVER w AS g1,
                max(x2) OVER w - min(x2) OVER w AS g2, count(*) OVER w AS n FROM s{level} WINDOW w AS (PARTITION BY tag))""",
            f"d{level} AS (SELECT *, CASE WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END AS split_dim FROM g{level})",
            f"""k{level} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY CASE split_dim WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END, point_id) - 1 AS rk
                FROM d{level})""",
            f"""s{level + 1} AS MATERIALIZED (SELECT point_id, x0, x1, x2, tag + CASE WHEN rk < n // 2 THEN {1 << level} ELSE {2 << level} END AS tag
                FROM k{level} WHERE rk <> n // 2)""",
        ]
    placed = " UNION ALL ".join(f"SELECT tag AS node, point_id, x0, x1, x2, split_dim FROM k{level} WHERE rk = n // 2" for level in range(levels))
    whole = f"(SELECT count(*) FROM s{levels}) = 0 OR error('more than {levels} levels')"
    return ",\n".join([*out, f"t AS MATERIALIZED (SELECT * FROM ({placed}) WHERE {whole})"])


D2 = "(a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)"


def neighbors(k: int, n0: int) -> str:
    """e0: idx, slot, nb, d2 in tree order."""
    return f"""e0 AS MATERIALIZED (SELECT * FROM (
      SELECT a.node AS idx, row_number() OVER (PARTITION BY a.node ORDER BY {D2}, b.node) - 1 AS slot, b.node AS nb, {D2} AS d2
      FROM t a JOIN t b ON b.node < a.node WHERE a.node >= {n0}) WHERE slot < {k})"""


def least_neighbors(k: int, n0: int) -> str:
    """As ``neighbors``, keeping the k least of each node only while all pairs are compared."""
    return f"""l0 AS (SELECT a.node AS idx, min({{'d2': {D2}, 'nb': b.node}}, {k}) AS l FROM t a JOIN t b ON b.node < a.node WHERE a.node >= {n0} GROUP BY a.node),
    e0 AS MATERIALIZED (SELECT idx, k AS slot, l[k + 1].nb AS nb, l[k + 1].d2 AS d2 FROM l0, (SELECT unnest(range({k})) AS k))"""


def graph(k: int, n0: int, found=neighbors) -> str:
    """gp: idx, old, point_id, x0..x2, depth; ge: idx, slot, nb, in the order by depth."""
    return found(k, n0) + f""",
    walk AS (SELECT node AS idx, 0 AS depth FROM t WHERE node < {n0}
             UNION SELECT e0.idx, walk.depth + 1 FROM e0 JOIN walk ON e0.nb = walk.idx),
    dep AS MATERIALIZED (SELECT idx, max(depth)::INTEGER AS depth FROM walk GROUP BY idx),
    gp AS MATERIALIZED (SELECT row_number() OVER (ORDER BY depth, node) - 1 AS idx, node AS old, point_id, x0, x1, x2, depth FROM t JOIN dep ON t.node = dep.idx),
    ge AS MATERIALIZED (SELECT a.idx, e0.slot, b.idx AS nb FROM e0 JOIN gp a ON e0.idx = a.old JOIN gp b ON e0.nb = b.old)"""


def lookup(bins, values, r: str) -> str:
    b, v = (f"[{', '.join(map(repr, x))}]" for x in (bins, values))
    j = f"len(list_filter({b}, lambda z: z < {r}))"
    return f"""(CASE WHEN {j} = 0 THEN {values[0]!r} WHEN {j} = {len(bins)} THEN {values[-1]!r}
      ELSE ({v})[{j}] + (({v})[{j} + 1] - ({v})[{j}]) * ({r} - ({b})[{j}]) / (({b})[{j} + 1] - ({b})[{j}]) END)"""


def factors(cov, dcov=None, batch: int = 0) -> str:
    """f: idx, depth, n0, n1 (neighbours), d0, d1 (their depths), k00 .. kff, w0, w1, s for two
    neighbours, and dw0, dw1, ds along dcov."""
    at = lambda a, b: f"sqrt(({a}.x0 - {b}.x0) * ({a}.x0 - {b}.x0) + ({a}.x1 - {b}.x1) * ({a}.x1 - {b}.x1) + ({a}.x2 - {b}.x2) * ({a}.x2 - {b}.x2))"
    v = cov.values[batch]
    look = lambda r, values=v: lookup(cov.bins, values, r)
    out = f"""loc AS MATERIALIZED (SELECT q.idx, q.depth, a.idx AS n0, b.idx AS n1, a.depth AS d0, b.depth AS d1,
      {at('a', 'b')} AS r01, {at('a', 'q')} AS r0, {at('b', 'q')} AS r1
      FROM gp q JOIN ge e ON e.idx = q.idx AND e.slot = 0 JOIN ge h ON h.idx = q.idx AND h.slot = 1
      JOIN gp a ON a.idx = e.nb JOIN gp b ON b.idx = h.nb),
    cv AS MATERIALIZED (SELECT *, {v[0]!r} AS kk, {look('r01')} AS b, {look('r0')} AS f0, {look('r1')} AS f1 FROM loc),
    fw AS MATERIALIZED (SELECT *, (kk * f0 - b * f1) / (kk * kk - b * b) AS w0, (kk * f1 - b * f0) / (kk * kk - b * b) AS w1 FROM cv),
    f AS MATERIALIZED (SELECT *, sqrt(kk - f0 * w0 - f1 * w1) AS s FROM fw)"""
    if dcov is None:
        return out
    dv = dcov.values[batch]
    return out + f""",
    dc AS MATERIALIZED (SELECT *, {dv[0]!r} AS dk, {look('r01', dv)} AS db, {look('r0', dv)} AS df0, {look('r1', dv)} AS df1 FROM f),
    dr AS (SELECT *, df0 - (dk * w0 + db * w1) AS e0_, df1 - (db * w0 + dk * w1) AS e1_ FROM dc),
    df AS MATERIALIZED (SELECT *, (kk * e0_ - b * e1_) / (kk * kk - b * b) AS dw0, (kk * e1_ - b * e0_) / (kk * kk - b * b) AS dw1,
      (dk - 2 * (df0 * w0 + df1 * w1) + w0 * w0 * dk + 2 * w0 * w1 * db + w1 * w1 * dk) / (2 * s) AS ds FROM dr)"""


def noise(idx: str, shift: int | str = 0) -> str:
    return f"(({idx} * 7919 + {13 + shift if isinstance(shift, int) else f'13 + {shift}'}) % 2003) / 1001.0::DOUBLE - 1.0::DOUBLE"


_SHALLOW = f"(SELECT max(depth) FROM gp) <= {DEPTHS} OR error('deeper than {DEPTHS}')"


def forward(initial: str, source: str, name: str = "u") -> str:
    """{name}: idx, v; source: an expression over f joined as f."""
    out = [f"{name}0 AS MATERIALIZED (SELECT idx, ({initial})::DOUBLE AS v FROM gp WHERE depth = 0)"]
    for level in range(1, DEPTHS + 1):
        out.append(f"""{name}{level} AS MATERIALIZED (SELECT * FROM {name}{level - 1} UNION ALL
          SELECT f.idx, w0 * a.v + w1 * b.v + ({source}) AS v FROM f JOIN {name}{level - 1} a ON a.idx = f.n0 JOIN {name}{level - 1} b ON b.idx = f.n1 WHERE f.depth = {level})""")
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {name}{DEPTHS} WHERE {_SHALLOW})"])


def backward(cotangent: str, name: str = "z") -> str:
    """{name}: idx, vbar; cotangent: an expression over idx."""
    flows = "SELECT 0::BIGINT AS idx, 0.0::DOUBLE AS vbar WHERE false"
    out = [f"{name}f{DEPTHS + 1} AS MATERIALIZED ({flows})"]
    for level in range(DEPTHS, 0, -1):
        out += [
            f"""{name}{level} AS MATERIALIZED (SELECT g.idx, ({cotangent}) + coalesce((SELECT sum(vbar) FROM {name}f{level + 1} y WHERE y.idx = g.idx), 0) AS vbar
              FROM gp g WHERE g.depth = {level})""",
            f"""{name}f{level} AS MATERIALIZED (SELECT * FROM {name}f{level + 1}
              UNION ALL SELECT n0, w0 * vbar FROM f JOIN {name}{level} USING (idx) UNION ALL SELECT n1, w1 * vbar FROM f JOIN {name}{level} USING (idx))""",
        ]
    parts = " UNION ALL ".join(f"SELECT * FROM {name}{level}" for level in range(1, DEPTHS + 1))
    first = f"SELECT g.idx, ({cotangent}) + coalesce((SELECT sum(vbar) FROM {name}f1 y WHERE y.idx = g.idx), 0) AS vbar FROM gp g WHERE g.depth = 0"
    return ",\n".join([*out, f"{name} AS MATERIALIZED (SELECT * FROM ({first} UNION ALL {parts}) WHERE {_SHALLOW})"])


def start(cov, dcov=None) -> str:
    """dn: one row with the covariances of the first three points (kk, c01, c02, c12), their Cholesky factor
    l00 .. l22, and the factor's derivative dl00 .. dl22 along dcov, entry by entry."""
    at = lambda a, b: f"sqrt(({a}.x0 - {b}.x0) * ({a}.x0 - {b}.x0) + ({a}.x1 - {b}.x1) * ({a}.x1 - {b}.x1) + ({a}.x2 - {b}.x2) * ({a}.x2 - {b}.x2))"
    table = lambda v, p: f"{v[0]!r} AS {p}kk, {lookup(cov.bins, v, 'q01')} AS {p}c01, {lookup(cov.bins, v, 'q02')} AS {p}c02, {lookup(cov.bins, v, 'q12')} AS {p}c12"
    v = cov.values[0]
    out = f"""dn0 AS MATERIALIZED (SELECT {at('a', 'b')} AS q01, {at('a', 'c')} AS q02, {at('b', 'c')} AS q12 FROM gp a, gp b, gp c WHERE a.idx = 0 AND b.idx = 1 AND c.idx = 2),
    dn1 AS MATERIALIZED (SELECT *, {table(v, '')}{', ' + table(dcov.values[0], 'd') if dcov else ''} FROM dn0),
    dn2 AS (SELECT *, sqrt(kk) AS l00, c01 / sqrt(kk) AS l10, c02 / sqrt(kk) AS l20 FROM dn1),
    dn3 AS (SELECT *, sqrt(kk - l10 * l10) AS l11 FROM dn2),
    dn4 AS (SELECT *, (c12 - l20 * l10) / l11 AS l21 FROM dn3),
    dn5 AS MATERIALIZED (SELECT *, sqrt(kk - l20 * l20 - l21 * l21) AS l22 FROM dn4)"""
    if dcov is None:
        return out + ",\ndn AS MATERIALIZED (SELECT * FROM dn5)"
    return out + """,
    dn6 AS (SELECT *, dkk / (2 * l00) AS dl00 FROM dn5),
    dn7 AS (SELECT *, (dc01 - l10 * dl00) / l00 AS dl10, (dc02 - l20 * dl00) / l00 AS dl20 FROM dn6),
    dn8 AS (SELECT *, (dkk - 2 * l10 * dl10) / (2 * l11) AS dl11 FROM dn7),
    dn9 AS (SELECT *, (dc12 - dl20 * l10 - l20 * dl10 - l21 * dl11) / l11 AS dl21 FROM dn8),
    dn AS MATERIALIZED (SELECT *, (dkk - 2 * l20 * dl20 - 2 * l21 * dl21) / (2 * l22) AS dl22 FROM dn9)"""


def times(p: str, x: list[str]) -> str:
    """The product of the factor (p: l) or its derivative (p: dl) with three numbers, by gp.idx."""
    rows = [" + ".join(f"{p}{i}{j} * ({x[j]})" for j in range(i + 1)) for i in range(3)]
    return "(SELECT CASE gp.idx " + " ".join(f"WHEN {i} THEN {row}" for i, row in enumerate(rows)) + " END FROM dn)"


def rounded(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"
