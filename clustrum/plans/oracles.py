"""DuckDB SQL for the registered queries, written apart from the DataFrame code."""

from __future__ import annotations

X = "SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings"
SEEDS = "SELECT id::INT AS k, id, x FROM s WHERE id < 10"


def _fold(a: str, b: str, kind: str) -> str:
    terms = {
        "l0": f"list_sum([CASE WHEN {a}[i] <> {b}[i] THEN 1.0::DOUBLE ELSE 0 END FOR i IN range(1, len({a}) + 1)])",
        "l1": f"list_sum([abs({a}[i] - {b}[i]) FOR i IN range(1, len({a}) + 1)])",
        "l2": f"sqrt(list_sum([({a}[i] - {b}[i]) * ({a}[i] - {b}[i]) FOR i IN range(1, len({a}) + 1)]))",
        "li": f"list_max([abs({a}[i] - {b}[i]) FOR i IN range(1, len({a}) + 1)])",
    }
    return terms[kind]


def _near(samples: str, centers: str, metric: str, own: bool = True) -> str:
    """(id, x, a1, d1, a2, d2) of samples and centers named so."""
    mine = "CASE WHEN s.id = c.id THEN 0 ELSE 1 END, " if own else ""
    return f"""(WITH d AS (SELECT s.id, s.x, c.k, {_fold('s.x', 'c.x', metric)} AS d, row_number() OVER (PARTITION BY s.id ORDER BY {mine}{_fold('s.x', 'c.x', metric)}, c.k) AS r FROM {samples} s, {centers} c)
SELECT a.id, a.x, a.k AS a1, a.d AS d1, b.k AS a2, b.d AS d2 FROM d a JOIN d b ON a.id = b.id AND a.r = 1 AND b.r = 2)"""


STATE = f"s AS MATERIALIZED ({X}), c AS MATERIALIZED ({SEEDS}), st AS MATERIALIZED ({_near('s', 'c', 'l2')})"


def _u(*parts: str) -> str:
    joined = " || '|' || ".join(parts)
    return f"((('0x' || substr(md5({joined}), 1, 8))::BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


def _race(weight: str, *parts: str) -> str:
    return f"(-ln({_u(*parts)}) / nullif({weight}, 0))"


def _first(seed: int = 1011) -> str:
    return f"(SELECT id FROM s ORDER BY md5('{seed}|first|' || id), id LIMIT 1)"


def _kmeanspp(k: int, bins: int = 1, state: bool = False) -> str:
    ctes = [f"s AS MATERIALIZED ({X})", f"c0 AS MATERIALIZED (SELECT id, x FROM s WHERE id = {_first()})",
            f"d0 AS MATERIALIZED (SELECT s.id, s.x, {_fold('s.x', 'c0.x', 'l2')} AS d FROM s, c0)"]
    from_bins = max(0, k - max(min(k, 50), -(-k // bins))) if bins > 1 else 0
    for i in range(1, k):
        pool = f"WHERE floor({_u(chr(39) + '1011' + chr(39), chr(39) + 'bin' + chr(39), 'id')} * {bins}) = {(i - 1) % bins}" if i <= from_bins else ""
        weight = _race("d * d", "'1011'", "'draw'", f"'{i}'", "'0'", "id")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT id, x FROM d{i - 1} {pool} ORDER BY {weight} NULLS LAST LIMIT 1)")
        ctes.append(f"d{i} AS MATERIALIZED (SELECT p.id, p.x, least(p.d, {_fold('p.x', f'c{i}.x', 'l2')}) AS d FROM d{i - 1} p, c{i})")
    picks = " UNION ALL ".join(f"SELECT id FROM c{i}" for i in range(k))
    if state:
        ctes.append(f"c AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, s.id, s.x FROM s JOIN ({picks}) USING (id))")
        return f"WITH {', '.join(ctes)} SELECT id, a1, round(d1, 6) AS d1, a2, round(d2, 6) AS d2 FROM {_near('s', 'c', 'l2')}"
    return f"WITH {', '.join(ctes)} SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, id FROM ({picks})"


def _greedy(k: int, n: int) -> str:
    ctes = [f"s AS MATERIALIZED ({X})", f"c0 AS MATERIALIZED (SELECT id, x FROM s WHERE id = {_first()})",
            f"d0 AS MATERIALIZED (SELECT s.id, s.x, {_fold('s.x', 'c0.x', 'l2')} AS d FROM s, c0)"]
    for i in range(1, k):
        picks = " UNION ALL ".join(
            f"(SELECT {j} AS j, id, x FROM d{i - 1} ORDER BY {_race('d * d', chr(39) + '1011' + chr(39), chr(39) + 'draw' + chr(39), f'{chr(39)}{i}{chr(39)}', f'{chr(39)}{j}{chr(39)}', 'id')} NULLS LAST LIMIT 1)"
            for j in range(n)
        )
        ctes.append(f"p{i} AS MATERIALIZED ({picks})")
        ctes.append(f"g{i} AS MATERIALIZED (SELECT q.j, sum(greatest(d.d * d.d - power({_fold('d.x', 'q.x', 'l2')}, 2), 0)) AS g FROM d{i - 1} d, p{i} q GROUP BY q.j)")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT q.id, q.x FROM p{i} q JOIN g{i} g ON q.j = g.j ORDER BY g.g DESC, q.j DESC LIMIT 1)")
        ctes.append(f"d{i} AS MATERIALIZED (SELECT p.id, p.x, least(p.d, {_fold('p.x', f'c{i}.x', 'l2')}) AS d FROM d{i - 1} p, c{i})")
    union = " UNION ALL ".join(f"SELECT id FROM c{i}" for i in range(k))
    return f"WITH {', '.join(ctes)} SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, id FROM ({union})"


def _hex(key: str, at: int) -> str:
    return f"('0x' || substr(md5({key}), {at}, 8))::BIGINT"


def _offers(medoids: str, state: str, first: str, n: int) -> str:
    """(p, k, id, x): proposals p = first .. first + n - 1 against the medoids; rows are ordered by a * h + b modulo a prime, a and b by p."""
    named = "'1011|sample|' || p"
    return f"""(WITH o AS (SELECT p, 1 + {_hex(named, 1)} % 2147483646 AS a, {_hex(named, 9)} % 2147483647 AS b FROM (SELECT unnest(range(0, {n})) + {first} AS p)),
h AS (SELECT id, x, {_hex("'1011|row|' || id", 1)} % 2147483647 AS h FROM {state}),
r AS (SELECT o.p, h.id, h.x, row_number() OVER (PARTITION BY o.p ORDER BY (h.h * o.a + o.b) % 2147483647, h.id) AS r FROM o, h WHERE h.id NOT IN (SELECT id FROM {medoids}))
SELECT p::INT AS p, floor({_u("'1011'", "'cluster'", "p")} * 10)::INT AS k, id, x FROM r WHERE r = 1)"""


def _deltas(state: str, offers: str) -> str:
    dp = _fold("t.x", "o.x", "l2")
    return f"(SELECT o.p, o.k, o.id, o.x, sum(power(least(CASE WHEN t.a1 = o.k THEN t.d2 ELSE t.d1 END, {dp}), 2) - power(t.d1, 2)) AS delta FROM {state} t, {offers} o GROUP BY o.p, o.k, o.id, o.x)"


def _clarans(patient: bool, rounds: int = 2) -> str:
    """Rounds of 64 proposals at most, all of which SQL evaluates at once; the first improving one counts, or the best of the first batch of 16 that has one."""
    ctes = [STATE, "m0 AS MATERIALIZED (SELECT * FROM c)", "t0 AS MATERIALIZED (SELECT * FROM st)", "n0 AS MATERIALIZED (SELECT 0 AS seen)"]
    for i in range(1, rounds + 1):
        j = i - 1
        ctes.append(f"o{i} AS MATERIALIZED {_offers(f'm{j}', f't{j}', f'(SELECT seen FROM n{j})', 64)}")
        ctes.append(f"e{i} AS MATERIALIZED {_deltas(f't{j}', f'o{i}')}")
        order = f"floor((p - (SELECT seen FROM n{j})) / 16), delta, p" if patient else "p"
        ctes.append(f"w{i} AS MATERIALIZED (SELECT * FROM e{i} WHERE delta < 0 ORDER BY {order} LIMIT 1)")
        used = f"(SELECT seen FROM n{j}) + (floor((p - (SELECT seen FROM n{j})) / 16) + 1) * 16" if patient else "p + 1"
        ctes.append(f"n{i} AS MATERIALIZED (SELECT coalesce(max({used}), (SELECT seen FROM n{j}) + 64)::BIGINT AS seen FROM w{i})")
        ctes.append(f"m{i} AS MATERIALIZED (SELECT m.k, coalesce(w.id, m.id) AS id, coalesce(w.x, m.x) AS x FROM m{j} m LEFT JOIN w{i} w ON m.k = w.k)")
        ctes.append(f"t{i} AS MATERIALIZED {_near('s', f'm{i}', 'l2')}")
    return f"WITH {', '.join(ctes)} SELECT m.k, m.id, count(*) AS size, round(sum(d1 * d1), 6) AS energy FROM m{rounds} m JOIN t{rounds} t ON m.k = t.a1 GROUP BY m.k, m.id"


def _voronoi(rounds: int) -> str:
    ctes = [STATE, "m0 AS MATERIALIZED (SELECT * FROM c)", "t0 AS MATERIALIZED (SELECT * FROM st)"]
    for i in range(1, rounds + 1):
        j = i - 1
        ctes.append(f"e{i} AS MATERIALIZED (SELECT a.a1 AS k, b.id, b.x, sum(power({_fold('a.x', 'b.x', 'l2')}, 2)) AS cost FROM t{j} a JOIN t{j} b ON a.a1 = b.a1 GROUP BY 1, 2, 3)")
        ctes.append(f"b{i} AS MATERIALIZED (SELECT k, id, x, cost FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cost, id) AS r FROM e{i}) WHERE r = 1)")
        ctes.append(f"m{i} AS MATERIALIZED (SELECT m.k, CASE WHEN b.cost < e.cost THEN b.id ELSE m.id END AS id, CASE WHEN b.cost < e.cost THEN b.x ELSE m.x END AS x FROM m{j} m JOIN b{i} b ON m.k = b.k JOIN e{i} e ON e.k = m.k AND e.id = m.id)")
        ctes.append(f"t{i} AS MATERIALIZED {_near('s', f'm{i}', 'l2')}")
    return f"WITH {', '.join(ctes)} SELECT m.k, m.id, count(*) AS size, round(sum(d1 * d1), 6) AS energy FROM m{rounds} m JOIN t{rounds} t ON m.k = t.a1 GROUP BY m.k, m.id"


def _refine(metric: str, how: str, rounds: int, many: int = 10) -> str:
    """Centers after `rounds` rounds of assignment and update, from the given seeds."""
    value = "avg(v)" if how == "mean" else "list_sort(list(v))[count(*) // 2 + 1]"
    ctes = [f"s AS MATERIALIZED ({X})", f"c0 AS MATERIALIZED (SELECT id::INT AS k, x FROM s WHERE id < {many})"]
    for i in range(1, rounds + 1):
        d = _fold("s.x", "c.x", metric)
        ctes.append(f"a{i} AS MATERIALIZED (SELECT id, x, k FROM (SELECT s.id, s.x, c.k, row_number() OVER (PARTITION BY s.id ORDER BY {d}, c.k) AS r FROM s, c{i - 1} c) WHERE r = 1)")
        ctes.append(f"u{i} AS MATERIALIZED (SELECT k, pos, {value} AS v FROM (SELECT k, unnest(x) AS v, unnest(range(0, len(x))) AS pos FROM a{i}) GROUP BY k, pos)")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT c.k, coalesce(n.x, c.x) AS x FROM c{i - 1} c LEFT JOIN (SELECT k, list(v ORDER BY pos) AS x FROM u{i} GROUP BY k) n ON c.k = n.k)")
    return f"WITH {', '.join(ctes)} SELECT k, unnest(range(0, len(x)))::INT AS pos, round(unnest(x), 6) AS v FROM c{rounds}"


def _refined_items(rounds: int) -> str:
    """Centers of line items after `rounds` rounds, from those of assign_items."""
    ctes = ["s AS MATERIALIZED (SELECT [l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[] AS x FROM lineitem)",
            "c0 AS MATERIALIZED (SELECT k::INT AS k, [5.0 * k + 1, 9000.0 * k + 1000, 0.01 * k, 0.08 - 0.01 * k]::DOUBLE[] AS x FROM range(0, 10) t(k))"]
    for i in range(1, rounds + 1):
        d = _fold("s.x", "c.x", "l2")
        ctes.append(f"a{i} AS MATERIALIZED (SELECT s.x, (SELECT arg_min(c.k, ({d}, c.k)) FROM c{i - 1} c) AS k FROM s)")
        ctes.append(f"u{i} AS MATERIALIZED (SELECT k, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4])] AS x FROM a{i} GROUP BY k)")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT c.k, coalesce(u.x, c.x) AS x FROM c{i - 1} c LEFT JOIN u{i} u ON c.k = u.k)")
    return f"WITH {', '.join(ctes)} SELECT k, unnest(range(0, 4))::INT AS pos, round(unnest(x), 4) AS v FROM c{rounds}"


TERMS = """t AS MATERIALIZED (SELECT doc_id AS id, ascii(c)::BIGINT AS i, count(*)::DOUBLE AS v FROM
  (SELECT doc_id, unnest(string_split(lower(text), '')) AS c FROM documents) WHERE regexp_full_match(c, '[a-z0-9]') GROUP BY 1, 2)"""
SPARSE_PAIRS = """ks AS (SELECT DISTINCT id AS k FROM t WHERE id < 3), ids AS (SELECT DISTINCT id FROM t), allp AS (SELECT ids.id, ks.k, i FROM ids, ks, (SELECT DISTINCT i FROM t)),
j AS (SELECT p.id, p.k, coalesce(a.v, 0) - coalesce(b.v, 0) AS e FROM allp p LEFT JOIN t a ON a.id = p.id AND a.i = p.i LEFT JOIN t b ON b.id = p.k AND b.i = p.i)"""

EVENTS = """kinds AS (SELECT event_type, chr((96 + row_number() OVER (ORDER BY event_type))::INT) AS c FROM (SELECT DISTINCT event_type FROM events)),
q AS MATERIALIZED (SELECT user_id AS id, string_agg(c, '' ORDER BY ts, event_id) AS s FROM events JOIN kinds USING (event_type) GROUP BY 1)"""

NAMES = "n AS (SELECT DISTINCT p_name AS s FROM part), pairs AS MATERIALIZED (SELECT a.s AS a, b.s AS b FROM n a JOIN n b ON a.s < b.s)"

WEIGHTED = f"""WITH RECURSIVE {NAMES},
rows AS (SELECT a, b, 0 AS i, [2.0::DOUBLE * j FOR j IN range(0, length(b) + 1)] AS r FROM pairs
  UNION ALL SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc::DOUBLE[], least(r[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 3.0 END, r[j + 1] + 2.0, acc[-1] + 2.0)), [2.0::DOUBLE * (i + 1)]) FROM rows WHERE i < length(a))"""


TABLED = f"""WITH RECURSIVE {NAMES},
rows AS (SELECT a, b, 0 AS i, [coalesce(list_sum([2 + ascii(b[m]) % 3 * 0.25 FOR m IN range(1, j + 1)]), 0)::DOUBLE FOR j IN range(0, length(b) + 1)] AS r FROM pairs
  UNION ALL SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc::DOUBLE[], least(r[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 + abs(ascii(a[i + 1]) - ascii(b[j])) / 64.0::DOUBLE END,
  r[j + 1] + 2 + ascii(a[i + 1]) % 3 * 0.25, acc[-1] + 2 + ascii(b[j]) % 3 * 0.25)::DOUBLE), [r[1] + 2 + ascii(a[i + 1]) % 3 * 0.25::DOUBLE]) FROM rows WHERE i < length(a))"""

BALANCE = f"""two AS (SELECT a.k AS k, b.k AS j, {_fold('a.x', 'b.x', 'l2')} AS d FROM c a JOIN c b ON a.k <> b.k),
steps AS (SELECT row_number() OVER (ORDER BY k, d, j) AS n, k, j FROM two), z AS (SELECT a1 AS k, count(*) AS n FROM st GROUP BY a1),
lim AS (SELECT greatest(2, floor((SELECT count(*) FROM st) / 15.0)::BIGINT) AS least),
plan AS (SELECT 0::BIGINT AS n, (SELECT list(n ORDER BY k) FROM z) AS sizes, [0::BIGINT FOR q IN range(0, 10)] AS given, NULL::INT AS donor, NULL::INT AS receiver, 0::BIGINT AS low, 0::BIGINT AS high
 UNION ALL SELECT n, [sizes[q] + CASE WHEN q = k + 1 THEN m WHEN q = j + 1 THEN -m ELSE 0 END FOR q IN range(1, 11)], [given[q] + CASE WHEN q = j + 1 THEN m ELSE 0 END FOR q IN range(1, 11)], j, k, given[j + 1] + 1, given[j + 1] + m
 FROM (SELECT s.n, s.k, s.j, p.sizes, p.given, greatest(0, least(p.sizes[s.j + 1] - l.least, l.least - p.sizes[s.k + 1])) AS m FROM plan p JOIN steps s ON s.n = p.n + 1, lim l)),
ranked AS (SELECT id, a1, row_number() OVER (PARTITION BY a1 ORDER BY id DESC) AS r FROM st)"""


def _afkmc2(k: int, chain: int) -> str:
    """Chains unrolled: pick j of chain s is taken over what stands before it by its energy over its weight."""
    ctes = [f"s AS MATERIALIZED ({X})", f"c0 AS MATERIALIZED (SELECT id, x FROM s WHERE id = {_first()})",
            f"e0 AS MATERIALIZED (SELECT s.id, s.x, power({_fold('s.x', 'c0.x', 'l2')}, 2) AS e FROM s, c0)",
            "q AS MATERIALIZED (SELECT id, x, (e / (SELECT sum(e) FROM e0) + 1.0::DOUBLE / (SELECT count(*) FROM e0)) / 2 AS q FROM e0 WHERE id NOT IN (SELECT id FROM c0))"]
    for s in range(1, k):
        for j in range(chain):
            draw = _race("q", "'1011'", "'mc2'", f"'{s}'", f"'{j}'", "id")
            ctes.append(f"p{s}_{j} AS MATERIALIZED (SELECT q.id, q.x, e.e / q.q AS w FROM (SELECT * FROM q ORDER BY {draw} NULLS LAST LIMIT 1) q JOIN e{s - 1} e ON e.id = q.id)")
            if j == 0:
                ctes.append(f"t{s}_0 AS MATERIALIZED (SELECT * FROM p{s}_0)")
                continue
            u, before = _u("'1011'", "'accept'", f"'{s}'", f"'{j}'"), f"t{s}_{j - 1}"
            take = f"p.w > 0 AND (t.w = 0 OR {u} < p.w / nullif(t.w, 0))"
            ctes.append(f"t{s}_{j} AS MATERIALIZED (SELECT CASE WHEN {take} THEN p.id ELSE t.id END AS id, CASE WHEN {take} THEN p.x ELSE t.x END AS x, CASE WHEN {take} THEN p.w ELSE t.w END AS w FROM p{s}_{j} p, {before} t)")
        ctes.append(f"c{s} AS MATERIALIZED (SELECT id, x FROM t{s}_{chain - 1})")
        ctes.append(f"e{s} AS MATERIALIZED (SELECT p.id, p.x, CASE WHEN p.id = c.id THEN 0 ELSE least(p.e, power({_fold('p.x', 'c.x', 'l2')}, 2)) END AS e FROM e{s - 1} p, c{s} c)")
    picks = " UNION ALL ".join(f"SELECT id FROM c{i}" for i in range(k))
    return f"WITH {', '.join(ctes)} SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, id FROM ({picks})"


def oracle_sql() -> dict[str, str]:
    stats = f"""WITH {STATE}, f AS (SELECT st.*, st.id IN (SELECT id FROM c) AS med, d1 * d1 AS e1, d2 * d2 AS e2 FROM st)
SELECT a1 AS k, count(*) AS size, round(sum(e1), 6) AS energy, round(coalesce(sum(e1) / nullif(count(*) - 1, 0), 0), 6) AS mean_energy,
round(coalesce(max(e2 - e1) FILTER (WHERE NOT med), 0), 6) AS max_margin, round(coalesce(sum(e2 - e1) FILTER (WHERE NOT med), 0), 6) AS sum_margin, round(max(d1), 6) AS r1,
round(coalesce(max(d2) FILTER (WHERE NOT med), 0), 6) AS r2, round(coalesce(max(e2 - e1) FILTER (WHERE NOT med) / nullif(count(*) - 1, 0), 0), 6) AS m_mean,
round(coalesce(sum(e2 - e1) FILTER (WHERE NOT med) / nullif(count(*) - 1, 0), 0), 6) AS m_star_mean FROM f GROUP BY a1"""
    cc = f"cc AS (SELECT a.k, b.k AS kp, {_fold('a.x', 'b.x', 'l2')} AS d FROM c a JOIN c b ON a.k < b.k)"
    item = "[l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[]"
    return {
        "dist_dense": f"WITH s AS ({X}), c AS ({SEEDS}) SELECT s.id, c.k, " + ", ".join(f"round({_fold('s.x', 'c.x', m)}, 6) AS {m}" for m in ("l0", "l1", "l2", "li")) + " FROM s, c",
        "dist_sparse": f"WITH {TERMS}, {SPARSE_PAIRS} SELECT id, k, sum(CASE WHEN e <> 0 THEN 1 ELSE 0 END)::DOUBLE AS l0, sum(abs(e)) AS l1, round(sqrt(sum(e * e)), 6) AS l2, max(abs(e)) AS li FROM j GROUP BY id, k",
        "edit_unit": f"WITH {NAMES} SELECT a, b, levenshtein(a, b)::DOUBLE AS d, round(2.0 * levenshtein(a, b) / (length(a) + length(b) + levenshtein(a, b)), 6)::DOUBLE AS normalised FROM pairs",
        "edit_weighted": f"{WEIGHTED} SELECT a, b, r[-1] AS d, round(2 * r[-1] / (2.0 * (length(a) + length(b)) + r[-1]), 6) AS normalised FROM rows WHERE i = length(a)",
        "event_sequences_edit": f"WITH {EVENTS}, f AS (SELECT id AS k, s AS c FROM q ORDER BY id LIMIT 3) SELECT id, k, length(s)::INT AS n, levenshtein(s, c)::DOUBLE AS d FROM q, f",
        "energies": f"WITH {STATE} SELECT id, round(d1, 6) AS identity, round(d1 * d1, 6) AS quadratic, round(d1 * d1 * d1, 6) AS cubic, round(ln(1 + d1), 6) AS log, round(sqrt(d1), 6) AS sqrt, round(exp(0.7 * d1) - 1, 6) AS exp, (CASE WHEN d1 > 1.2 THEN 1 ELSE 0 END)::DOUBLE AS squarepotential FROM st",
        "assign_nearest2": f"WITH {STATE} SELECT id, a1, round(d1, 6) AS d1, a2, round(d2, 6) AS d2 FROM st",
        "assign_nearest2_l1_columns": f"WITH s AS ({X}), c AS ({SEEDS}), st AS {_near('s', 'c', 'l1')} SELECT id, a1, round(d1, 6) AS d1, a2, round(d2, 6) AS d2 FROM st",
        "assign_items": f"""WITH s AS (SELECT row_number() OVER () AS id, {item} AS x FROM lineitem),
c AS (SELECT k::INT AS k, [5.0 * k + 1, 9000.0 * k + 1000, 0.01 * k, 0.08 - 0.01 * k]::DOUBLE[] AS x FROM range(0, 10) t(k)),
d AS (SELECT s.id, c.k, {_fold('s.x', 'c.x', 'l2')} AS d FROM s, c), a AS (SELECT id, arg_min(k, (d, k)) AS k, min(d) AS d FROM d GROUP BY id)
SELECT k, count(*) AS size, round(avg(d), 4) AS mean_d, round(max(d), 4) AS max_d FROM a GROUP BY k""",
        "cluster_stats": stats,
        "center_center": f"WITH s AS ({X}), c AS ({SEEDS}), {cc} SELECT k, kp, round(d, 6) AS d FROM cc",
        "nearest_center": f"WITH s AS ({X}), c AS ({SEEDS}), {cc}, two AS (SELECT * FROM cc UNION ALL SELECT kp, k, d FROM cc) SELECT k, arg_min(kp, (d, kp)) AS nearest, round(min(d), 6) AS d FROM two GROUP BY k",
        "seed_uniform": f"WITH s AS ({X}) SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, id FROM (SELECT id FROM s ORDER BY md5('1011|uniform|' || id), id LIMIT 8)",
        "seed_kmeanspp": _kmeanspp(5),
        "seed_state": _kmeanspp(5, state=True),
        "seed_kmeanspp_binned": _kmeanspp(53, 20),
        "seed_afkmc2": _afkmc2(4, 5),
        "edit_tables": f"{TABLED} SELECT a, b, round(r[-1], 6) AS d, CASE WHEN r[-1] <= 14.0 THEN round(r[-1], 6) END AS near FROM rows WHERE i = length(a)",
        "balance_labels": f"WITH RECURSIVE {STATE}, {BALANCE} SELECT coalesce(p.receiver, r.a1)::INT AS k, count(*) AS size, min(r.id) AS first_id FROM ranked r LEFT JOIN plan p ON p.donor = r.a1 AND r.r BETWEEN p.low AND p.high GROUP BY 1",
        "seed_kmeanspp_greedy": _greedy(4, 3),
        **dict.fromkeys(("swap_delta", "swap_delta_pruned"), f"WITH {STATE}, o AS MATERIALIZED {_offers('c', 'st', '0', 16)} SELECT p, k, id, round(delta, 6) AS delta FROM {_deltas('st', 'o')}"),
        "clarans_greedy": _clarans(False),
        "clarans_patient": _clarans(True),
        "clarans_level1": _clarans(False),
        "clarans_level2": _clarans(True),
        "voronoi_round": f"WITH {STATE}, e AS (SELECT a.a1 AS k, b.id, round(sum(power({_fold('a.x', 'b.x', 'l2')}, 2)), 9) AS cost FROM st a JOIN st b ON a.a1 = b.a1 GROUP BY 1, 2) SELECT k, arg_min(id, (cost, id)) AS id, round(min(cost), 6) AS cost FROM e GROUP BY k",
        "voronoi": _voronoi(2),
        "vcenters": "SELECT k, pos::INT AS pos, round(avg(v), 6) AS v FROM (SELECT label AS k, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY k, pos",
        "vmedians": "SELECT k, pos::INT AS pos, round(list_sort(list(v))[count(*) // 2 + 1], 6) AS v FROM (SELECT label AS k, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY k, pos",
        "refine_l2": _refine("l2", "mean", 2),
        "refine_yinyang": _refine("l2", "mean", 3, 20),
        "refine_exponion": _refined_items(2),
        "item_medians": """SELECT k, pos::INT AS pos, list_sort(list(v))[count(*) // 2 + 1] AS v FROM (SELECT l_returnflag || l_linestatus AS k,
unnest([l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[]) AS v, unnest(range(0, 4)) AS pos FROM lineitem) GROUP BY k, pos""",
        "assign_many": f"WITH s AS MATERIALIZED ({X}), c AS MATERIALIZED (SELECT id::INT AS k, id, x FROM s WHERE id < 200), st AS {_near('s', 'c', 'l2')} SELECT id, a1, round(d1, 6) AS d1, a2, round(d2, 6) AS d2 FROM st",
        "refine_l1": _refine("l1", "median", 2),
        "refine_sparse_l2": f"""WITH {TERMS}, {SPARSE_PAIRS}, d AS (SELECT id, k, sqrt(sum(e * e)) AS d FROM j GROUP BY id, k), a AS (SELECT id, arg_min(k, (d, k))::INT AS k FROM d GROUP BY id),
z AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT a.k, t.i, round(sum(t.v) / max(z.n), 6) AS v FROM a JOIN t ON a.id = t.id JOIN z ON z.k = a.k GROUP BY a.k, t.i""",
        "dim_variance_order": f"WITH s AS ({X}), v AS (SELECT pos, var_pop(v) AS var FROM (SELECT unnest(x) AS v, unnest(range(0, len(x))) AS pos FROM s) GROUP BY pos) SELECT (row_number() OVER (ORDER BY var DESC, pos) - 1)::INT AS rank, pos::INT AS pos, round(var, 6) AS var FROM v WHERE var > 1e-16 * (SELECT max(var) FROM v)",
        "vdimap_distances": f"WITH s AS ({X}) SELECT a.id, b.id AS k, round({_fold('a.x', 'b.x', 'l2')}, 5) AS d FROM s a, s b WHERE b.id < 3",
        "alphabet": "SELECT symbol, (row_number() OVER (ORDER BY symbol) - 1)::INT AS code FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS symbol FROM part) WHERE symbol <> ''",
        "cost_violations": """WITH w AS (SELECT a.n_name AS a, b.n_name AS b, abs(a.n_nationkey - b.n_nationkey) * 0.5 AS cost FROM nation a JOIN nation b ON a.n_name <> b.n_name)
SELECT 'triangle' AS rule, count(*) AS n FROM w x JOIN w y ON x.b = y.a JOIN w z ON z.a = x.a AND z.b = y.b WHERE x.cost + y.cost < z.cost HAVING count(*) > 0
UNION ALL SELECT 'switch above two indels', count(*) FROM w WHERE cost > 6.0 HAVING count(*) > 0 UNION ALL SELECT 'indel above switch and indel', count(*) FROM w WHERE 3.0 > 3.0 + cost HAVING count(*) > 0""",
    }
