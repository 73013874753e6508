"""The same results in SQL for DuckDB, written from the definitions and not from the Spark code.

A query is a list of named steps (common table expressions) and a last SELECT. Vectors are
``DOUBLE[]`` lists. Iterations are recursive steps.
"""

from __future__ import annotations

from .data import FIRST_YEAR

Steps = list[tuple[str, str]]

EMB: Steps = [("y", "SELECT vec_id AS signal_id, label::BIGINT AS node_id, embedding::DOUBLE[] AS vec FROM embeddings")]

_KINDS = "(SELECT list(DISTINCT event_type ORDER BY event_type) FROM events WHERE event_type IS NOT NULL)"
EVENT_CELLS: Steps = [("a", f"""SELECT user_id AS row_id, list_position({_KINDS}, event_type) - 1 AS col_id,
  sum(value) AS value FROM events WHERE event_type IS NOT NULL GROUP BY ALL""")]
EVENTS: Steps = EVENT_CELLS + [
    ("ym", "SELECT row_id, map_from_entries(list((col_id, value))) AS c FROM a GROUP BY row_id"),
    ("y", f"""SELECT row_id AS signal_id, list_transform(range(len({_KINDS})),
      lambda j: coalesce(c[j], 0.0::DOUBLE) * 0.001::DOUBLE) AS vec FROM ym"""),
]
MONTH_CELLS: Steps = [("a", f"""SELECT l_partkey AS row_id,
  (year(l_shipdate) - {FIRST_YEAR}) * 12 + month(l_shipdate) - 1 AS col_id, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL""")]


def query(steps: Steps, last: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" if not sql.startswith("RECURSE") else f"{name} AS ({sql[7:]})"
                      for name, sql in steps)
    return f"WITH RECURSIVE {body}\n{last}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0::DOUBLE AS {name}"


def unit(vec: str) -> str:
    return f"list_transform({vec}, lambda x: x / sqrt(list_inner_product({vec}, {vec})))"


def formula(n_atoms: int = 64, m: int = 64, name: str = "d") -> Steps:
    return [(f"{name}_raw", f"""SELECT k::INTEGER AS atom_id, list_transform(range({m}),
      lambda j: ((37 * k + 101 * j + 11 + (k // 1009) * (2 * j + 3) + (j // 1009) * (2 * k + 3)) ** 3 % 1009 + 1)::DOUBLE / 1010::DOUBLE) AS c FROM range({n_atoms}) t(k)"""),
            (name, f"SELECT atom_id, {unit('c')} AS atom FROM {name}_raw")]


CENTROIDS: Steps = [
    ("d_mean", "SELECT node_id, i, avg(vec[i + 1]) AS v FROM y, range(64) t(i) GROUP BY ALL"),
    ("d_row", "SELECT node_id, list(v ORDER BY i) AS c FROM d_mean GROUP BY node_id"),
    ("d", f"SELECT node_id::INTEGER AS atom_id, {unit('c')} AS atom FROM d_row"),
]


def pursuit(n_atoms: int, m: int, limit: int, tol: float | None = None, signals: str = "y", atoms: str = "d",
            name: str = "p", keep_rounds: bool = False) -> Steps:
    """Orthogonal matching pursuit. Step r of a signal holds its residual and coefficients after r picks.

    New atoms are made orthogonal to the earlier ones; ``ts`` says how each orthonormal vector is made of atoms.
    Gives ``{name}``: (signal_id, picks, r, x).
    """
    more = f"picks < {limit}" + (f" AND (picks = 0 OR sqrt(list_inner_product(r, r)) > {tol!r}::DOUBLE)" if tol is not None else "")
    step = f"""RECURSE
  SELECT signal_id, 0 AS picks, vec AS r, []::INTEGER[] AS chosen, []::DOUBLE[][] AS qs, []::DOUBLE[][] AS ts,
    list_transform(range({n_atoms}), lambda k: 0::DOUBLE) AS x FROM {signals}
  UNION ALL
  SELECT signal_id, picks + 1,
    list_transform(range(1, {m} + 1), lambda i: r[i] - s * q[i]), list_append(chosen, best), list_append(qs, q), list_append(ts, t),
    list_transform(range(1, {n_atoms} + 1), lambda k: x[k] + s * t[k])
  FROM (SELECT *, list_inner_product(q, r) AS s FROM (
    SELECT *, list_transform(v, lambda z: z / rho) AS q,
      list_transform(range(1, {n_atoms} + 1), lambda k: ((CASE WHEN k = best THEN 1 ELSE 0 END) -
        coalesce(list_sum(list_transform(range(1, len(ts) + 1), lambda j: h[j] * ts[j][k])), 0::DOUBLE)) / rho) AS t
    FROM (SELECT *, sqrt(list_inner_product(v, v)) AS rho FROM (
      SELECT *, list_transform(range(1, {m} + 1), lambda i: a[i] -
        coalesce(list_sum(list_transform(range(1, len(qs) + 1), lambda j: h[j] * qs[j][i])), 0::DOUBLE)) AS v
      FROM (SELECT *, list_transform(qs, lambda z: list_inner_product(z, a)) AS h FROM (
        SELECT *, atoms[best] AS a FROM (
          SELECT *, list_position(corr, list_max(corr)) AS best FROM (
            SELECT w.*, l.atoms, list_transform(range(1, {n_atoms} + 1), lambda k: CASE WHEN list_contains(w.chosen, k) THEN -1::DOUBLE
              ELSE round(abs(list_inner_product(l.atoms[k], w.r)), 12) END) AS corr
            FROM {name}_all w, {name}_atoms l WHERE {more}))))))))"""
    steps = [(f"{name}_atoms", f"SELECT list(atom ORDER BY atom_id) AS atoms FROM {atoms}"), (f"{name}_all", step)]
    if not keep_rounds:
        steps.append((name, f"SELECT signal_id, max(picks) AS picks, arg_max(r, picks) AS r, arg_max(x, picks) AS x "
                            f"FROM {name}_all GROUP BY signal_id"))
    return steps


def in_step(n_atoms: int, m: int, tol: float, depth: int | None = None, signals: str = "y", atoms: str = "d", name: str = "p") -> Steps:
    """Pursuit of all signals in step to a global tolerance; rounds past the first good one are dropped."""
    depth = min(n_atoms, m) if depth is None else depth
    return pursuit(n_atoms, m, depth, None, signals, atoms, name, keep_rounds=True) + [
        (f"{name}_norm", f"SELECT picks, sqrt(sum(list_inner_product(r, r))) AS norm FROM {name}_all GROUP BY picks"),
        (f"{name}_stop", f"SELECT coalesce(min(picks) FILTER (norm <= {tol!r}::DOUBLE), {depth}) AS n FROM {name}_norm"),
        (name, f"SELECT signal_id, picks, r, x FROM {name}_all, {name}_stop WHERE picks = n"),
    ]


def codes(name: str = "p", out: str = "codes") -> Steps:
    return [(out, f"SELECT signal_id, (k - 1)::INTEGER AS atom_id, x[k] AS coef FROM {name}, "
                  f"unnest(range(1, len(x) + 1)) t(k) WHERE abs(x[k]) > 1e-13")]


def pruned(n_new: str = "d2", code: str = "codes", atoms: str = "d", out_codes: str = "codes2") -> Steps:
    return [
        (f"{n_new}_number", f"SELECT atom_id, (row_number() OVER (ORDER BY atom_id) - 1)::INTEGER AS new_id "
                            f"FROM (SELECT DISTINCT atom_id FROM {code})"),
        (n_new, f"SELECT new_id AS atom_id, atom FROM {atoms} JOIN {n_new}_number USING (atom_id)"),
        (out_codes, f"SELECT signal_id, new_id AS atom_id, coef FROM {code} JOIN {n_new}_number USING (atom_id)"),
    ]


def residual_and_errors(m: int, signals: str = "y", atoms: str = "d", code: str = "codes", name: str = "e",
                        keep: str = "") -> Steps:
    """``{name}_r``: residual vectors from the codes; ``{name}``: y - sum over the other atoms, per atom and signal."""
    return [
        (f"{name}_ax", f"""SELECT signal_id, i, sum(coef * atom[i]) AS v FROM {code} JOIN {atoms} USING (atom_id),
          range(1, {m} + 1) t(i) GROUP BY ALL"""),
        (f"{name}_axl", f"SELECT signal_id, list(v ORDER BY i) AS ax FROM {name}_ax GROUP BY signal_id"),
        (f"{name}_r", f"""SELECT signal_id, {keep} vec, CASE WHEN ax IS NULL THEN vec ELSE
          list_transform(range(1, {m} + 1), lambda i: vec[i] - ax[i]) END AS r FROM {signals} LEFT JOIN {name}_axl USING (signal_id)"""),
        (name, f"""SELECT signal_id, {keep} atom_id, coalesce(coef, 0::DOUBLE) AS x, CASE WHEN coef IS NULL THEN r ELSE
          list_transform(range(1, {m} + 1), lambda i: r[i] + coef * atom[i]) END AS v
          FROM {name}_r CROSS JOIN {atoms} LEFT JOIN {code} USING (signal_id, atom_id)"""),
    ]


def gramians(m: int, errors: str = "e", name: str = "g") -> Steps:
    """E E' of every atom as cells and as nested lists."""
    return [
        (f"{name}_cell", f"""SELECT atom_id, i, j, sum(v[i] * v[j]) AS value FROM {errors}, range(1, {m} + 1) s(i),
          range(1, {m} + 1) t(j) GROUP BY ALL"""),
        (f"{name}_row", f"SELECT atom_id, i, list(value ORDER BY j) AS row FROM {name}_cell GROUP BY ALL"),
        (name, f"SELECT atom_id, list(row ORDER BY i) AS g FROM {name}_row GROUP BY atom_id"),
    ]


def leading(m: int, gram: str = "g", atoms: str = "d", name: str = "u", squarings: int = 45) -> Steps:
    """Largest singular value and vector by squaring the moment matrix until one direction is left."""
    trace = f"list_sum(list_transform(range(1, {m} + 1), lambda i: s[i][i]))"
    return [
        (f"{name}_pow", f"""RECURSE SELECT atom_id, 0 AS step, g AS s FROM {gram} UNION ALL
          SELECT atom_id, step + 1, list_transform(s, lambda a: list_transform(s, lambda b:
            list_inner_product(a, b) / (tr * tr))) FROM (SELECT *, {trace} AS tr FROM {name}_pow WHERE step < {squarings})"""),
        (f"{name}_dir", f"""SELECT atom_id, list_transform(s[best], lambda z: z / sqrt(list_inner_product(s[best], s[best]))) AS q FROM (
          SELECT *, list_position(dg, list_max(dg)) AS best FROM (SELECT atom_id, s, list_transform(range(1, {m} + 1), lambda i: s[i][i]) AS dg
          FROM {name}_pow WHERE step = {squarings}))"""),
        (name, f"""SELECT atom_id, atom AS old, sqrt(list_inner_product(q, list_transform(g, lambda a: list_inner_product(a, q)))) AS sigma,
          list_transform(q, lambda z: z * CASE WHEN q[1] * atom[1] < 0 THEN -1 ELSE 1 END) AS q
          FROM {name}_dir JOIN {gram} USING (atom_id) JOIN {atoms} USING (atom_id)"""),
    ]


def metropolis(edges: str, name: str = "w") -> Steps:
    return [
        (f"{name}_both", f"SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}"),
        (f"{name}_deg", f"SELECT src, count(*) AS deg FROM {name}_both GROUP BY src"),
        (f"{name}_off", f"""SELECT b.src, b.dst, 1::DOUBLE / (greatest(p.deg, q.deg) + 1) AS w FROM {name}_both b
          JOIN {name}_deg p ON p.src = b.src JOIN {name}_deg q ON q.src = b.dst"""),
        (name, f"SELECT * FROM {name}_off UNION ALL SELECT src, src, 1 - sum(w) FROM {name}_off GROUP BY src"),
    ]


SUPPLY_EDGES: Steps = [("edges", """SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src,
  lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE src != dst""")]
RING: Steps = [("labels_in_order", "SELECT DISTINCT label::BIGINT AS l FROM embeddings"),
               ("edges", """SELECT l AS src, coalesce(lead(l) OVER (ORDER BY l), (SELECT min(l) FROM labels_in_order)) AS dst
                 FROM labels_in_order""")]


def power_of(weights: str, c: int, name: str) -> Steps:
    steps: Steps = [(f"{name}_1", f"SELECT src, dst, w FROM {weights}")]
    for k in range(2, c + 1):
        steps.append((f"{name}_{k}", f"""SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM {name}_{k - 1} a
          JOIN {weights} b ON a.dst = b.src GROUP BY ALL"""))
    return steps + [(name, f"SELECT * FROM {name}_{c}")]


def site_power(m: int, rounds: int, weights: str, start: str, mix: str = "before", errors: str = "e", name: str = "q") -> Steps:
    """Power steps at the sites over errors (node_id, signal_id, atom_id, v); ``{name}``: (node_id, atom_id, q)."""
    steps: Steps = [(f"{name}_0", f"SELECT node_id, atom_id, atom AS q FROM (SELECT DISTINCT node_id FROM {errors}), {start}")]
    for r in range(1, rounds + 1):
        steps += [
            (f"{name}_{r}a", f"SELECT e.node_id, e.atom_id, e.v, list_inner_product(e.v, q.q) AS c FROM {errors} e "
                             f"JOIN {name}_{r - 1} q USING (node_id, atom_id)"),
            (f"{name}_{r}b", f"SELECT node_id, atom_id, i, sum(c * v[i]) AS z FROM {name}_{r}a, range(1, {m} + 1) t(i) GROUP BY ALL"),
        ]
        scaled = (f"SELECT node_id, atom_id, i, CASE WHEN n > 0 THEN z / n ELSE z END AS z FROM (SELECT *, "
                  f"sqrt(sum(z * z) OVER (PARTITION BY node_id, atom_id)) AS n FROM {{0}})")
        mixed = (f"SELECT w.dst AS node_id, atom_id, i, sum(w.w * z) AS z FROM {{0}} s JOIN {weights} w ON w.src = s.node_id GROUP BY ALL")
        one, two = (mixed, scaled) if mix == "before" else (scaled, mixed)
        steps += [(f"{name}_{r}c", one.format(f"{name}_{r}b")), (f"{name}_{r}d", two.format(f"{name}_{r}c")),
                  (f"{name}_{r}", f"SELECT node_id, atom_id, list(z ORDER BY i) AS q FROM {name}_{r}d GROUP BY ALL")]
    return steps + [(name, f"SELECT node_id, atom_id, {unit('q')} AS q FROM {name}_{rounds}")]
