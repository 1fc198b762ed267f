"""SQL of whole models for the oracles: the normal equations of any components, with or without covariates, from block sums,
solved by Gauss-Jordan elimination in a recursive query."""

from __future__ import annotations


def eliminate(name: str, source: str, n: int, width: int, keys: str = "") -> str:
    """Recursive query name (keys, p, m): source's matrices m (n rows of width numbers) after p pivots on the diagonal."""
    cell = "m[i][c] - m[i][p + 1] * m[p + 1][c] / m[p + 1][p + 1]"
    row = f"CASE WHEN i = p + 1 THEN list_transform(m[i], lambda v: v / m[p + 1][p + 1]) ELSE list_transform(range(1, {width + 1}), lambda c: {cell}) END"
    return f"{name}({keys}p, m) AS (SELECT {keys}0, m FROM ({source}) UNION ALL SELECT {keys}p + 1, list_transform(range(1, {n + 1}), lambda i: {row}) FROM {name} WHERE p < {n})"


def _fitted(source: str, key: str) -> str:
    """The projection on the covariates of columns (key, i, v)."""
    sums = ", ".join(f"sum(c{a} * v) AS s{a}" for a in range(3))
    fit = " + ".join(f"c{a} * m[{a + 1}][{b + 4}] * s{b}" for a in range(3) for b in range(3))
    return f"SELECT {key}, cov.i AS i, {fit} AS v FROM (SELECT {key}, {sums} FROM ({source}) JOIN cov USING (i) GROUP BY {key}) CROSS JOIN cov CROSS JOIN (SELECT m FROM inv WHERE p = 3)"


def equations(kinds: tuple[str, ...], covariates: bool, vectors: int, blocks: int) -> tuple[str, list[str]]:
    """Fragments behind x, xb, blk, two, nl, z, yc, env, cov and ids, up to sol (j, c, value, trace), and the components; fragment t
    (j, k, l, t) is the left side among components, kinds being g, d, gxe and nxe with two bins each but for the last."""
    names = [f"{k}:{b}" for k in kinds if k != "nxe" for b in (0, 1)] + ["nxe:0"] * ("nxe" in kinds)
    n, nxe = len(names), "nxe" in kinds
    order = f"list_position([{', '.join(repr(x) for x in names)}], {{0}})"
    every = f"CROSS JOIN range({blocks + 1}) r(jj)"
    cx = {
        "g": "SELECT 'g:' || bin AS c, i, m, j, x FROM xb",
        "d": "SELECT 'd:' || bin AS c, i, m, j, (e - avg(e) OVER (PARTITION BY m)) / (mu * (1 - mu / 2)) AS x FROM (SELECT i, m, mu, CASE d WHEN 0 THEN 0 WHEN 1 THEN mu ELSE 2 * mu - 2 END AS e FROM geno JOIN mu USING (m) WHERE mu > 0 AND mu < 2) JOIN two USING (m) JOIN blk USING (m)",
        "gxe": "SELECT 'gxe:' || bin AS c, i, m, j, x * e AS x FROM xb JOIN env USING (i)",
    }
    add: list[tuple[str, str] | str] = [("cx", " UNION ALL ".join(cx[k] for k in kinds if k != "nxe"))]
    if covariates:
        gram = ", ".join("[" + ", ".join([f"sum(c{a} * c{b})" for b in range(3)] + [f"{float(a == b)}::DOUBLE" for b in range(3)]) + "]" for a in range(3))
        add += [eliminate("inv", f"SELECT [{gram}] AS m FROM cov", 3, 6), ("uz", _fitted("SELECT i, b, z AS v FROM z", "b")), ("yf", _fitted("SELECT i, 0 AS b, y AS v FROM yc", "b")), ("yy", "SELECT i, y - v AS y FROM yc JOIN yf USING (i)")]
    else:
        add += [("yy", "SELECT i, y FROM yc")]
    add += [
        ("zz", "SELECT 0 AS u, i, b, z FROM z" + " UNION ALL SELECT 1, i, b, v FROM uz" * covariates),
        ("cw", "SELECT c, m, u, b, sum(x * z) AS w FROM cx JOIN zz USING (i) GROUP BY ALL"),
        ("cb", "SELECT c, j, u, i, b, sum(x * w) AS v FROM cx JOIN cw USING (c, m) GROUP BY ALL"),
        ("ct", "SELECT c, u, i, b, sum(v) AS v FROM cb GROUP BY ALL"),
        ("cn", " UNION ALL ".join(f"SELECT j, '{k}:' || bin AS c, n FROM nl" for k in kinds if k != "nxe") + f" UNION ALL SELECT jj, 'nxe:0', 1 FROM range({blocks + 1}) r(jj)" * nxe),
        ("cl", f"SELECT jj AS j, ct.c AS c, ct.u AS u, ct.i AS i, ct.b AS b, ct.v - coalesce(cb.v, 0) AS v FROM ct {every} LEFT JOIN cb ON cb.j = jj AND cb.c = ct.c AND cb.u = ct.u AND cb.i = ct.i AND cb.b = ct.b"
         + f" UNION ALL SELECT jj, 'nxe:0', u, i, b, e * e * z FROM zz JOIN env USING (i) {every}" * nxe),
        ("g", "SELECT a.j AS j, a.c AS k, o.c AS l, sum(a.v * o.v) AS g FROM cl a JOIN cl o ON a.j = o.j AND a.i = o.i AND a.b = o.b WHERE a.u = 0 AND o.u = 0 GROUP BY a.j, a.c, o.c"),
    ]
    if covariates:
        inner = " + ".join(f"p.s{a} * m[{a + 1}][{b + 4}] * q.s{b}" for a in range(3) for b in range(3))
        add += [
            ("ca", "SELECT j, c, u, b, " + ", ".join(f"sum(c{a} * v) AS s{a}" for a in range(3)) + " FROM cl JOIN cov USING (i) GROUP BY j, c, u, b"),
            ("fix", f"SELECT p.j AS j, p.c AS k, q.c AS l, sum(CASE WHEN p.u = 1 THEN 1 ELSE -2 END * ({inner})) AS f FROM ca p JOIN ca q ON p.j = q.j AND p.b = q.b AND q.u = 0 CROSS JOIN (SELECT m FROM inv WHERE p = 3) GROUP BY p.j, p.c, q.c"),
            ("own", "SELECT j, c, sum(v * uz.v2) AS with_u FROM cl JOIN (SELECT i, b, v AS v2 FROM uz) uz USING (i, b) WHERE u = 0 GROUP BY j, c"),
        ]
    fixed, less = ("g.g + fix.f", f" - with_u / ({vectors} * cn.n)") if covariates else ("g.g", "")
    join_fix, join_own = (" JOIN fix USING (j, k, l)", " JOIN own USING (j, c)") if covariates else ("", "")
    free = f"(SELECT count(*)::DOUBLE - {3 * covariates} FROM ids)"
    add += [
        ("t", f"SELECT g.j AS j, g.k AS k, g.l AS l, ({fixed}) / ({vectors} * p.n * q.n) AS t FROM g{join_fix} JOIN cn p ON p.j = g.j AND p.c = g.k JOIN cn q ON q.j = g.j AND q.c = g.l"),
        ("zv", "SELECT j, c, sum(v * z) AS zv FROM cl JOIN z USING (i, b) WHERE u = 0 GROUP BY j, c"),
        ("base", f"SELECT j, c, CASE WHEN c LIKE '%xe:%' THEN zv / ({vectors} * cn.n) ELSE (SELECT count(*)::DOUBLE FROM ids) END{less} AS base FROM zv JOIN cn USING (j, c){join_own}"),
        ("q", f"SELECT s.j AS j, s.c AS c, s / n AS q FROM (SELECT jj AS j, c, sum(s) AS s FROM (SELECT c, m, j AS own, pow(sum(x * y), 2) AS s FROM cx JOIN yy USING (i) GROUP BY ALL) {every} WHERE own <> jj GROUP BY ALL) s JOIN cn USING (j, c)"
         + f" UNION ALL SELECT jj, 'nxe:0', sum(e * e * y * y) FROM env JOIN yy USING (i) {every} GROUP BY jj" * nxe),
        ("rows", f"SELECT j, {order.format('k')} AS r, list_append(list_append(list(t ORDER BY {order.format('l')}), any_value(base)), any_value(q)) AS row FROM t JOIN base ON base.j = t.j AND base.c = t.k JOIN q ON q.j = t.j AND q.c = t.k GROUP BY t.j, t.k"
         .replace("SELECT j,", "SELECT t.j AS j,", 1)
         + f" UNION ALL SELECT j, {n + 1}, list_append(list_append(list(base ORDER BY {order.format('c')}), {free}), (SELECT sum(y * y) FROM yy)) FROM base GROUP BY j"),
        eliminate("solved", "SELECT j, list(row ORDER BY r) AS m FROM rows GROUP BY j", n + 1, n + 2, "j, "),
        ("sol", f"SELECT solved.j AS j, c, m[{order.format('c')}][{n + 2}] AS value, base AS trace FROM solved JOIN base USING (j) WHERE p = {n + 1} UNION ALL SELECT j, 'e', m[{n + 1}][{n + 2}], {free} FROM solved WHERE p = {n + 1}"),
    ]
    return ", ".join(x if isinstance(x, str) else f"{x[0]} AS MATERIALIZED ({x[1]})" for x in add), names


#: erfc(x) by erf's power series, for x below 4.
ERFC = "(1 - 2 / sqrt(pi()) * list_reduce(list_transform(range(1, 80), lambda n: [n::DOUBLE, 0, 0]), lambda s, e: [e[1], s[2] * -(x * x) / e[1], s[3] + s[2] * -(x * x) / e[1] / (2 * e[1] + 1)], [0::DOUBLE, x, x])[3])"
