"""Independent SQL (DuckDB dialect) for each registered query.

The SQL receives nothing computed by Spark: fixtures are the FIXTURES.md
definitions, parameters come from the same fixed formulas, and iterative
fits are unrolled into CTE chains by the small builders below.  The SQL
works in long form (rows x columns, rows x slots) with joins and group-bys,
so it shares no code path with the generated Spark expressions.
"""

from __future__ import annotations

from . import queries as Q
from .functions.columns import (HASH_ADD, HASH_ID_MULT, HASH_PRIMES, HASH_RANGE, HASH_STEP_MULT, STREAM_FOLD, STREAM_KMEANS,
                                STREAM_SELECT, STREAM_SLOT, stream_salt)
from .spec import random_logistic

# Fixture definitions (FIXTURES.md section 2).
ORDERS_SQL = """WITH b AS (SELECT o_orderkey AS row_id,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS c0,
  CAST(substr(o_orderpriority,1,1) AS INT)-1 AS c1,
  CAST(least(3, floor(o_totalprice/125000.0)) AS INT) AS c2,
  o_totalprice/500000.0E0 AS x0,
  (extract(month FROM o_orderdate)-1)/11.0E0 AS x1,
  CAST(CASE WHEN o_orderkey % 20 = 7 THEN 1 ELSE 0 END AS INT) AS label FROM orders)
SELECT row_id, label, c0, c1, CASE WHEN label=1 THEN (c2+2)%4 ELSE c2 END AS c2,
  CAST(x0 AS DOUBLE) AS x0,
  CAST(CASE WHEN label=1 THEN x1*0.5E0+0.55E0 ELSE x1 END AS DOUBLE) AS x1 FROM b"""

EVENTS_SQL = """SELECT event_id AS row_id, CAST(CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS INT) AS label,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS c0,
  CAST(floor(extract(hour FROM ts)/6) AS INT) AS c1,
  CAST(ln(1+value)/6.5E0 + CASE WHEN event_id % 10 = 3 THEN 0.25E0 ELSE 0.0E0 END AS DOUBLE) AS x0,
  CAST(extract(hour FROM ts)/23.0E0 AS DOUBLE) AS x1,
  CAST((user_id % 7)/6.0E0 AS DOUBLE) AS x2 FROM events"""

SPARSE_SQL = """SELECT l_orderkey AS row_id, l_linenumber-1 AS idx, CAST(sum(l_quantity) AS DOUBLE) AS value
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

# Fixed shape of mixed_orders (widths 3, 5, 4): only used to name wide output columns.
ORDERS_SLOTS = 12

ORDERS_CATS = ["c0", "c1", "c2"]
ORDERS_CONTS = ["x0", "x1"]
EVENTS_CATS = ["c0", "c1"]
EVENTS_CONTS = ["x0", "x1", "x2"]


def f(v: float) -> str:
    """Double literal."""
    return f"{float(v)!r}E0" if "e" not in repr(float(v)) else f"CAST({float(v)!r} AS DOUBLE)"


def rnd(x: str, digits: int = Q.DIG) -> str:
    return f"(round({x}, {digits}) + 0.0E0)"


def logsig(m: str) -> str:
    return f"(-(greatest(-({m}), 0.0E0) + ln(1.0E0 + exp(-abs({m})))))"


def sig(m: str) -> str:
    return (f"(CASE WHEN ({m}) >= 0 THEN 1.0E0/(1.0E0 + exp(-abs({m}))) "
            f"ELSE exp(-abs({m}))/(1.0E0 + exp(-abs({m}))) END)")


def hsh(row_id: str, step: str, seed: int, stream: int) -> str:
    """The portable hash; every intermediate value fits a BIGINT."""
    halves = []
    for p, m, t, add in zip(HASH_PRIMES, HASH_ID_MULT, HASH_STEP_MULT, HASH_ADD):
        salt = stream_salt(seed, stream) % p
        x = (f"((((CAST({row_id} AS BIGINT) % {p} + {p}) % {p}) * {m} + (CAST({step} AS BIGINT) % {p}) * {t} + {salt}) % {p})")
        x = f"((({x} * {x}) % {p} * {x}) % {p})"
        x = f"(({x} * {t} + {add}) % {p})"
        halves.append(f"((({x} * {x}) % {p} * {x}) % {p})")
    return f"({halves[0]} * {HASH_PRIMES[1]} + {halves[1]})"


def cutoff_sql(minibatch: int, n: str) -> str:
    """Hashes below it are in a minibatch."""
    return (f"(SELECT CASE WHEN {minibatch} >= N THEN {HASH_RANGE} "
            f"ELSE CAST(floor(({f(minibatch)} / N) * CAST({HASH_RANGE} AS DOUBLE)) AS BIGINT) END FROM {n})")


class Ctes:
    def __init__(self):
        self.items: list[tuple[str, str]] = []
        self.recursive = False
        self.kept: set[str] = set()  # computed once, where a recursion would compute them again in every step

    def add(self, name: str, sql: str, keep: bool = False) -> "Ctes":
        self.items.append((name, sql))
        if keep:
            self.kept.add(name)
        return self

    def sql(self, final: str) -> str:
        body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in self.kept else ''}(\n{s}\n)" for n, s in self.items)
        return f"WITH {'RECURSIVE ' if self.recursive else ''}{body}\n{final}"


# ---------------------------------------------------------------------------
# building blocks
# ---------------------------------------------------------------------------

def long_parts(c: Ctes, fixture: str, cats: list[str], conts: list[str], intercept: bool = True,
               ns: str = "") -> None:
    """Fixture + long forms: ``cl`` (row, column, code), slot layout, ``xc``/``xl`` (row, dim, x).

    ``ns`` prefixes every CTE name, so several fits can live in one query.
    """
    c.add(f"{ns}fx", fixture)
    if cats:
        c.add(f"{ns}cl", "\nUNION ALL\n".join(f"SELECT row_id, {i} AS ci, {col} AS code FROM {ns}fx"
                                               for i, col in enumerate(cats)))
        c.add(f"{ns}wd", f"SELECT ci, max(code) + 1 AS width FROM {ns}cl GROUP BY ci")
        c.add(f"{ns}sl", "SELECT ci, width, coalesce(sum(width) OVER (ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING "
                         f"AND 1 PRECEDING), 0) AS off FROM {ns}wd")
        c.add(f"{ns}slots", "SELECT ci, v AS code, CAST(off + v AS INTEGER) AS j FROM "
                            f"(SELECT ci, off, unnest(range(width)) AS v FROM {ns}sl)")
        c.add(f"{ns}jn", f"SELECT count(*) AS J FROM {ns}slots")
    parts = [f"SELECT row_id, {i} AS c, {col} AS x FROM {ns}fx" for i, col in enumerate(conts)]
    c.add(f"{ns}xc", "\nUNION ALL\n".join(parts))
    if intercept:
        c.add(f"{ns}xl", f"SELECT row_id, c, x FROM {ns}xc UNION ALL SELECT row_id, {len(conts)} AS c, 1.0E0 AS x "
                         f"FROM {ns}fx")
    c.add(f"{ns}nn", f"SELECT count(*) AS N FROM {ns}fx")


def given_logistic_ctes(c: Ctes, k: int, d: int, suffix: str = "0", ns: str = "") -> None:
    c.add(f"{ns}pv{suffix}", f"SELECT r, cc AS c, ((3*r + 5*cc) % 7 - 3) / 10.0E0 AS v "
                             f"FROM range({k}) t1(r), range({d + 1}) t2(cc)")
    c.add(f"{ns}pw{suffix}", f"SELECT r, j, ((5*r + 2*j) % 9 - 4) / 10.0E0 AS v FROM range({k}) t1(r), {ns}slots")


def given_gmm_cte(c: Ctes, K: int, d: int, name: str = "gp0") -> None:
    c.add(name, f"SELECT m, cc AS c, 1.0E0/{K} AS wt, (m + 0.5E0)/{K} AS mu, 0.05E0 AS var "
                f"FROM range({K}) t1(m), range({d}) t2(cc)")


def logistic_ctes(c: Ctes, pv: str, pw: str, lam: float, p: str = "", data_ns: str = "",
                  slots_ns: str | None = None) -> str:
    """Adds CTEs computing log P(y|x) per row of ``data_ns``, with the slot layout of
    ``slots_ns`` (default: the same); returns the name of (row_id, log_p_cat)."""
    sn = data_ns if slots_ns is None else slots_ns
    c.add(f"{p}h", f"SELECT xl.row_id, pv.r, sum(pv.v * xl.x) AS h FROM {data_ns}xl xl JOIN {pv} pv ON xl.c = pv.c "
                   "GROUP BY xl.row_id, pv.r")
    c.add(f"{p}w", f"SELECT h.row_id, pw.j, sum(h.h * pw.v) AS w FROM {p}h h JOIN {pw} pw ON h.r = pw.r "
                   "GROUP BY h.row_id, pw.j")
    c.add(f"{p}z", f"SELECT w.row_id, w.j, w.w, CASE WHEN cl.code = s.code THEN 1.0E0 ELSE -1.0E0 END AS z "
                   f"FROM {p}w w JOIN {sn}slots s ON s.j = w.j JOIN {data_ns}cl cl ON cl.row_id = w.row_id "
                   "AND cl.ci = s.ci")
    c.add(f"{p}lpc", f"SELECT row_id, sum({logsig(f'z * w / {f(lam)}')}) AS log_p_cat FROM {p}z GROUP BY row_id")
    return f"{p}lpc"


def gmm_ctes(c: Ctes, gp: str, d: int, p: str = "", with_weight: bool = True,
             data_ns: str = "") -> tuple[str, str, str]:
    """Adds component log-densities, row loglik and responsibilities; returns their CTE names."""
    wt = " + ln(max(gp.wt))" if with_weight else ""
    c.add(f"{p}lp", f"SELECT xc.row_id, gp.m, -0.5E0 * ({d} * ln(2 * pi()) + sum(ln(gp.var))){wt} "
                    f"- 0.5E0 * sum((xc.x - gp.mu) * (xc.x - gp.mu) * (1.0E0 / gp.var)) AS lp "
                    f"FROM {data_ns}xc xc JOIN {gp} gp ON xc.c = gp.c GROUP BY xc.row_id, gp.m")
    c.add(f"{p}ll", f"SELECT row_id, mx + ln(sum(exp(lp - mx))) AS ll FROM "
                    f"(SELECT row_id, lp, max(lp) OVER (PARTITION BY row_id) AS mx FROM {p}lp) GROUP BY row_id, mx")
    c.add(f"{p}rs", f"SELECT lp.row_id, lp.m, exp(lp.lp - ll.ll) AS r FROM {p}lp lp JOIN {p}ll ll "
                    "ON lp.row_id = ll.row_id")
    return f"{p}lp", f"{p}ll", f"{p}rs"


def em_step_ctes(c: Ctes, gp_in: str, gp_out: str, d: int, min_covar: float = Q.MIN_COVAR,
                 data_ns: str = "") -> str:
    p = f"{gp_out}_"
    _, ll, rs = gmm_ctes(c, gp_in, d, p, data_ns=data_ns)
    c.add(f"{p}es", f"SELECT rs.m, xc.c, sum(rs.r) AS n, sum(rs.r * xc.x) AS s1, sum(rs.r * xc.x * xc.x) AS s2 "
                    f"FROM {rs} rs JOIN {data_ns}xc xc ON rs.row_id = xc.row_id GROUP BY rs.m, xc.c")
    mc = f(min_covar)
    c.add(f"{p}mv", f"SELECT es.m, es.c, es.n / (SELECT sum(n) FROM {p}es WHERE c = 0) AS wt, "
                    f"CASE WHEN es.n > 0 THEN es.s1 / es.n ELSE g.mu END AS mu, "
                    f"CASE WHEN es.n > 0 THEN es.s2 / es.n - (es.s1 / es.n) * (es.s1 / es.n) + {mc} ELSE g.var END AS var "
                    f"FROM {p}es es JOIN {gp_in} g ON g.m = es.m AND g.c = es.c")
    c.add(gp_out, f"SELECT m, c, wt, mu, CASE WHEN var > 0 THEN var ELSE {mc} END AS var FROM {p}mv")
    return f"{p}es"


def sgd_ctes(c: Ctes, steps: int, lam: float, radius: float, k: int, d: int, seed: int = Q.SEED,
             minibatch: int = Q.MINIBATCH, reg: float = Q.REG, lr0: float = Q.LR0, speed: float = Q.LR_SPEED,
             ns: str = "") -> None:
    """Unrolled SGD: params {ns}pv0/pw0 -> {ns}pv{steps}/pw{steps}; history rows in {ns}hist{t}."""
    cutoff = cutoff_sql(minibatch, f"{ns}nn")
    scale_w = f"(1.0E0 / sqrt((SELECT J FROM {ns}jn) * {k}))"
    scale_v = f"(1.0E0 / sqrt({(d + 1) * k}))"
    xl, cl, slots = f"{ns}xl xl", f"{ns}cl cl", f"{ns}slots s"
    for t in range(1, steps + 1):
        pv, pw = f"{ns}pv{t - 1}", f"{ns}pw{t - 1}"
        n = lambda name: f"{ns}{name}{t}"
        lr = f"({f(lr0)} / (1.0E0 + {f(speed)} * {t - 1}))"
        c.add(n("mb"), f"SELECT row_id, CAST({hsh('row_id', str(t), seed, STREAM_SLOT)} % (SELECT J FROM {ns}jn) "
                       f"AS INTEGER) AS slot FROM {ns}fx WHERE {hsh('row_id', str(t), seed, STREAM_SELECT)} < {cutoff}")
        c.add(n("n"), f"SELECT count(*) AS n FROM {n('mb')}")
        c.add(n("hh"), f"SELECT mb.row_id, pv.r, sum(pv.v * xl.x) AS h FROM {n('mb')} mb JOIN {xl} "
                       f"ON xl.row_id = mb.row_id JOIN {pv} pv ON pv.c = xl.c GROUP BY mb.row_id, pv.r")
        c.add(n("ws"), f"SELECT mb.row_id, mb.slot, pw.r, pw.v AS wv FROM {n('mb')} mb JOIN {pw} pw ON pw.j = mb.slot")
        c.add(n("ww"), f"SELECT hh.row_id, sum(hh.h * ws.wv) AS w FROM {n('hh')} hh JOIN {n('ws')} ws "
                       f"ON ws.row_id = hh.row_id AND ws.r = hh.r GROUP BY hh.row_id")
        z = "CASE WHEN cl.code = s.code THEN 1.0E0 ELSE -1.0E0 END"
        c.add(n("zz"), f"SELECT mb.row_id, mb.slot, ww.w, {z} AS z FROM {n('mb')} mb JOIN {n('ww')} ww "
                       f"ON ww.row_id = mb.row_id JOIN {slots} ON s.j = mb.slot JOIN {cl} ON cl.row_id = mb.row_id "
                       "AND cl.ci = s.ci")
        c.add(n("gg"), f"SELECT row_id, slot, -{sig(f'(-z) * w / {f(lam)}')} * z AS g FROM {n('zz')}")
        c.add(n("gw"), f"SELECT hh.r, gg.slot AS j, sum(gg.g * hh.h) / (SELECT n FROM {n('n')}) AS g "
                       f"FROM {n('gg')} gg JOIN {n('hh')} hh ON hh.row_id = gg.row_id GROUP BY hh.r, gg.slot")
        c.add(n("gv"), f"SELECT ws.r, xl.c, sum(gg.g * ws.wv * xl.x) / (SELECT n FROM {n('n')}) AS g "
                       f"FROM {n('gg')} gg JOIN {n('ws')} ws ON ws.row_id = gg.row_id JOIN {xl} ON xl.row_id = gg.row_id "
                       f"GROUP BY ws.r, xl.c")
        c.add(n("wu"), f"SELECT pw.r, pw.j, pw.v - {lr} * (coalesce(g.g, 0.0E0) + 2.0E0 * {f(reg)} * {scale_w} * pw.v) "
                       f"AS v FROM {pw} pw LEFT JOIN {n('gw')} g ON g.r = pw.r AND g.j = pw.j")
        c.add(n("vu"), f"SELECT pv.r, pv.c, pv.v - {lr} * (coalesce(g.g, 0.0E0) + 2.0E0 * {f(reg)} * {scale_v} * pv.v) "
                       f"AS v FROM {pv} pv LEFT JOIN {n('gv')} g ON g.r = pv.r AND g.c = pv.c")
        for m, key in (("w", "j"), ("v", "c")):
            c.add(n(f"p{m}"), f"SELECT u.r, u.{key}, CASE WHEN nm.norm > {f(radius)} THEN u.v * ({f(radius)} / nm.norm) "
                              f"ELSE u.v END AS v FROM {n(m + 'u')} u JOIN (SELECT {key}, sqrt(sum(v * v)) AS norm "
                              f"FROM {n(m + 'u')} GROUP BY {key}) nm ON nm.{key} = u.{key}")
        c.add(n("hist"), f"SELECT CAST({t} AS INTEGER) AS iter, CAST((SELECT n FROM {n('n')}) AS BIGINT) AS n, "
                         f"(SELECT sum(abs(g)) FROM {n('gw')}) AS grad_l1, {lr} AS lr")


# -- fits that run to their end: each is a recursion over one row of state ------------------------------


def kmeans_ctes(c: Ctes, K: int, conts: list[str], seed: int, max_iter: int = 100, tol: float = 1e-4, rounds: int = 5,
                ns: str = "") -> str:
    """k-means|| start and Lloyd steps over {ns}fx; returns the CTE with the final centres k{m}_{c} in one row."""
    c.recursive = True
    xs, cx = ", ".join(conts), ", ".join(f"p.{x}" for x in conts)

    def dist(a: str, b: str) -> str:
        return " + ".join(f"({a}.{x} - {b}.{x}) * ({a}.{x} - {b}.{x})" for x in conts)

    c.add(f"{ns}ca0", f"SELECT {xs} FROM {ns}fx ORDER BY {hsh('row_id', '0', seed, STREAM_KMEANS)}, row_id LIMIT 1")
    for t in range(1, rounds + 1):
        c.add(f"{ns}cd{t}", f"SELECT p.row_id, {cx}, min({dist('p', 'q')}) AS d2 FROM {ns}fx p, {ns}ca{t - 1} q GROUP BY p.row_id, {cx}")
        draw = f"((CAST({hsh('row_id', str(t), seed, STREAM_KMEANS)} AS DOUBLE) + 0.5E0) / CAST({HASH_RANGE} AS DOUBLE))"
        c.add(f"{ns}ca{t}", f"SELECT {xs} FROM {ns}ca{t - 1} UNION SELECT {xs} FROM {ns}cd{t}, (SELECT sum(d2) AS cost FROM {ns}cd{t}) "
                            f"WHERE cost > 0 AND {draw} < d2 * ({f(2.0 * K)} / cost)")
    near = ", ".join(f"q.{x} AS q{x}" for x in conts)
    qs = ", ".join(f"q{x}" for x in conts)
    c.add(f"{ns}cn", f"SELECT {qs}, row_number() OVER (PARTITION BY row_id ORDER BY d2, {qs}) AS rn FROM "
                     f"(SELECT p.row_id, {near}, {dist('p', 'q')} AS d2 FROM {ns}fx p, {ns}ca{rounds} q)")
    named = ", ".join(f"q{x} AS {x}" for x in conts)
    c.add(f"{ns}cw", f"SELECT {named}, CAST(count(*) AS DOUBLE) AS wt FROM {ns}cn WHERE rn = 1 GROUP BY {qs}")
    c.add(f"{ns}se0", f"SELECT {xs} FROM {ns}cw ORDER BY wt DESC, {xs} LIMIT 1")
    for m in range(1, K):
        least = ", ".join(f"({dist('p', f's{k}')})" for k in range(m))
        gain = f"least({least})" if m > 1 else least
        c.add(f"{ns}se{m}", f"SELECT {cx} FROM {ns}cw p, {', '.join(f'{ns}se{k} s{k}' for k in range(m))} "
                            f"ORDER BY p.wt * {gain} DESC, {cx} LIMIT 1")
    cells = [(m, i) for m in range(K) for i in range(len(conts))]
    start = ", ".join(f"s{m}.{conts[i]} AS k{m}_{i}" for m, i in cells)
    state = ", ".join(f"k{m}_{i}" for m, i in cells)
    d = [" + ".join(f"({x} - k{m}_{i}) * ({x} - k{m}_{i})" for i, x in enumerate(conts)) for m in range(K)]
    near_case = " ".join(f"WHEN {' AND '.join(f'd{m} <= d{o}' for o in range(m + 1, K))} THEN {m}" for m in range(K - 1))
    moved = [f"sqrt({' + '.join(f'(n{m}_{i} - k{m}_{i}) * (n{m}_{i} - k{m}_{i})' for i in range(len(conts)))})" for m in range(K)]

    def steps(name: str, base: str, rows: str, mean: str) -> None:
        """k-means steps over ``rows`` from the centres of ``base``; ``mean`` is of {x} over the rows where {own}."""
        new = ", ".join(f"coalesce({mean.format(x=conts[i], own=f'a = {m}')}, k{m}_{i}) AS n{m}_{i}" for m, i in cells)
        c.add(name, f"SELECT 0 AS it, 1.0E300 AS moved, {base}\n"
                    f"UNION ALL SELECT it + 1, greatest({', '.join(moved)}), {', '.join(f'n{m}_{i}' for m, i in cells)} FROM (\n"
                    f"SELECT it, {state}, {new} FROM (SELECT *, CASE {near_case} ELSE {K - 1} END AS a FROM (\n"
                    f"SELECT s.*, r.*, {', '.join(f'{e} AS d{m}' for m, e in enumerate(d))} FROM {name} s, {rows} r\n"
                    f"WHERE s.moved >= {f(tol)} AND s.it < {max_iter})) GROUP BY it, {state})")

    steps(f"{ns}kw", f"{start} FROM {', '.join(f'{ns}se{m} s{m}' for m in range(K))}", f"{ns}cw",
          "sum(CASE WHEN {own} THEN wt * {x} END) / sum(CASE WHEN {own} THEN wt END)")
    c.add(f"{ns}kwf", f"SELECT {state} FROM {ns}kw ORDER BY it DESC LIMIT 1")
    c.add(f"{ns}xs", f"SELECT {xs} FROM {ns}fx", keep=True)
    steps(f"{ns}km", f"{state} FROM {ns}kwf", f"{ns}xs", "avg(CASE WHEN {own} THEN {x} END)")
    c.add(f"{ns}kmf", f"SELECT {state} FROM {ns}km ORDER BY it DESC LIMIT 1")
    return f"{ns}kmf"


def em_fit_ctes(c: Ctes, K: int, conts: list[str], centres: str, max_iter: int, tol: float, min_covar: float, ns: str = "") -> str:
    """EM from centres and column variances until the mean log-likelihood settles; returns the CTE (m, c, wt, mu, var)."""
    c.recursive = True
    d, cells = len(conts), [(m, i) for m in range(K) for i in range(len(conts))]
    names = [f"w{m}" for m in range(K)] + [f"u{m}_{i}" for m, i in cells] + [f"v{m}_{i}" for m, i in cells]
    first = ([f"1.0E0 / {K}"] * K + [f"k{m}_{i}" for m, i in cells]
             + [f"(SELECT var_pop({conts[i]}) + {f(min_covar)} FROM {ns}fx)" for m, i in cells])
    lp = [f"ln(w{m}) - 0.5E0 * ({d} * ln(2 * pi()) + {' + '.join(f'ln(v{m}_{i})' for i in range(d))}) - 0.5E0 * ("
          + " + ".join(f"({x} - u{m}_{i}) * ({x} - u{m}_{i}) / v{m}_{i}" for i, x in enumerate(conts)) + ")" for m in range(K)]
    sums = [f"sum(exp(l{m} - ll)) AS n{m}" for m in range(K)]
    sums += [f"sum(exp(l{m} - ll) * ({conts[i]} - u{m}_{i})) AS a{m}_{i}" for m, i in cells]
    sums += [f"sum(exp(l{m} - ll) * ({conts[i]} - u{m}_{i}) * ({conts[i]} - u{m}_{i})) AS b{m}_{i}" for m, i in cells]
    var = {(m, i): f"(b{m}_{i} / n{m} - (a{m}_{i} / n{m}) * (a{m}_{i} / n{m}) + {f(min_covar)})" for m, i in cells}
    total = " + ".join(f"n{m}" for m in range(K))
    nxt = ([f"n{m} / ({total})" for m in range(K)] + [f"CASE WHEN n{m} > 0 THEN u{m}_{i} + a{m}_{i} / n{m} ELSE u{m}_{i} END" for m, i in cells]
           + [f"CASE WHEN n{m} > 0 THEN CASE WHEN {var[m, i]} > 0 THEN {var[m, i]} ELSE {f(min_covar)} END ELSE v{m}_{i} END" for m, i in cells])
    state = ", ".join(names)
    mx = f"greatest({', '.join(f'l{m}' for m in range(K))})"
    inner = (f"SELECT *, mx + ln({' + '.join(f'exp(l{m} - mx)' for m in range(K))}) AS ll FROM (SELECT *, {mx} AS mx FROM (\n"
             f"SELECT s.*, {', '.join(conts)}, {', '.join(f'{e} AS l{m}' for m, e in enumerate(lp))} FROM {ns}em s, {ns}xs\n"
             f"WHERE NOT s.done AND s.it < {max_iter}))")
    c.add(f"{ns}em", f"SELECT 0 AS it, CAST(NULL AS DOUBLE) AS prev, false AS done, "
                     f"{', '.join(f'{e} AS {n}' for e, n in zip(first, names))} FROM {centres}\n"
                     f"UNION ALL SELECT it + 1, cur, coalesce(abs(cur - prev) < {f(tol)}, false), {', '.join(nxt)} FROM (\n"
                     f"SELECT it, prev, {state}, avg(ll) AS cur, {', '.join(sums)} FROM ({inner}) GROUP BY it, prev, {state})")
    c.add(f"{ns}emf", f"SELECT * FROM {ns}em ORDER BY it DESC LIMIT 1")
    out = f"{ns}emp"
    c.add(out, "\nUNION ALL\n".join(f"SELECT {m} AS m, {i} AS c, w{m} AS wt, u{m}_{i} AS mu, v{m}_{i} AS var FROM {ns}emf" for m, i in cells))
    return out


def sgd_fit_ctes(c: Ctes, p, start, cats: list[str], conts: list[str], ns: str = "") -> tuple[str, str]:
    """All SGD steps from given parameters (k x (d+1) and k x J numbers); returns the CTEs (r, c, v) and (r, j, v)."""
    c.recursive = True
    k, d1 = start.V.shape
    J = start.W.shape[1]
    xs = [*conts, "1.0E0"]
    vs, ws = [(r, i) for r in range(k) for i in range(d1)], [(r, j) for r in range(k) for j in range(J)]
    hot = " OR ".join(f"slot = {col} + (SELECT off FROM {ns}sl WHERE ci = {i})" for i, col in enumerate(cats))
    c.add(f"{ns}mb", f"SELECT step, row_id, slot, {', '.join(conts)}, CASE WHEN {hot} THEN 1.0E0 ELSE -1.0E0 END AS z FROM ("
                     f"SELECT CAST(t.step AS INTEGER) AS step, fx.*, CAST({hsh('row_id', 't.step', p.seed, STREAM_SLOT)} % (SELECT J FROM {ns}jn) "
                     f"AS INTEGER) AS slot FROM {ns}fx fx, range(1, {p.max_iterations}) t(step) "
                     f"WHERE {hsh('row_id', 't.step', p.seed, STREAM_SELECT)} < {cutoff_sql(p.minibatch_size, f'{ns}nn')})", keep=True)
    state = [f"v{r}_{i}" for r, i in vs] + [f"w{r}_{j}" for r, j in ws]
    first = [f(start.V[r, i]) for r, i in vs] + [f(start.W[r, j]) for r, j in ws]
    h = [" + ".join(f"v{r}_{i} * {x}" for i, x in enumerate(xs)) for r in range(k)]
    own = [f"CASE slot {' '.join(f'WHEN {j} THEN w{r}_{j}' for j in range(J))} END" for r in range(k)]
    margin = " + ".join(f"h{r} * o{r}" for r in range(k))
    rows = (f"SELECT *, -{sig(f'(-z) * m / {f(p.logistic_lambda)}')} * z AS g FROM (SELECT *, {margin} AS m FROM ("
            f"SELECT s.*, mb.slot, mb.z, {', '.join(f'mb.{x}' for x in conts)}, {', '.join(f'{e} AS h{r}' for r, e in enumerate(h))}, "
            f"{', '.join(f'{e} AS o{r}' for r, e in enumerate(own))} FROM {ns}sg s JOIN {ns}mb mb ON mb.step = s.it "
            f"WHERE s.idle < {p.no_progress_steps} AND s.it < {p.max_iterations}))")
    sums = [f"sum(g * o{r} * {xs[i]}) / count(*) AS gv{r}_{i}" for r, i in vs]
    sums += [f"coalesce(sum(CASE WHEN slot = {j} THEN g * h{r} END), 0.0E0) / count(*) AS gw{r}_{j}" for r, j in ws]
    lr = f"({f(p.learning_rate_start)} / (1.0E0 + {f(p.learning_rate_speed)} * (it - 1)))"
    reg = f(p.regularization_parameter)
    pull = {"v": f"(1.0E0 / sqrt({d1 * k}))", "w": f"(1.0E0 / sqrt({J * k}))"}
    moved = [f"{a}{r}_{i} - {lr} * (g{a}{r}_{i} + 2.0E0 * {reg} * {pull[a]} * {a}{r}_{i}) AS n{a}{r}_{i}"
             for a, cells in (("v", vs), ("w", ws)) for r, i in cells]
    norms = [f"sqrt({' + '.join(f'n{a}{r}_{i} * n{a}{r}_{i}' for r in range(k))}) AS q{a}{i}" for a, m in (("v", d1), ("w", J)) for i in range(m)]
    radius = f(p.normalizing_radius)
    nxt = [f"CASE WHEN q{a}{i} > {radius} THEN n{a}{r}_{i} * ({radius} / q{a}{i}) ELSE n{a}{r}_{i} END"
           for a, cells in (("v", vs), ("w", ws)) for r, i in cells]
    progress = " + ".join(f"abs(gw{r}_{j})" for r, j in ws)
    c.add(f"{ns}sg", f"SELECT 1 AS it, 0 AS idle, {', '.join(f'{e} AS {n}' for e, n in zip(first, state))}\n"
                     f"UNION ALL SELECT it + 1, CASE WHEN {progress} < {f(p.no_progress_tol)} THEN idle + 1 ELSE 0 END, {', '.join(nxt)} FROM (\n"
                     f"SELECT *, {', '.join(norms)} FROM (SELECT *, {', '.join(moved)} FROM (\n"
                     f"SELECT it, idle, {', '.join(state)}, {', '.join(sums)} FROM ({rows}) GROUP BY it, idle, {', '.join(state)})))")
    c.add(f"{ns}sgf", f"SELECT * FROM {ns}sg ORDER BY it DESC LIMIT 1")
    c.add(f"{ns}pvf", " UNION ALL ".join(f"SELECT {r} AS r, {i} AS c, v{r}_{i} AS v FROM {ns}sgf" for r, i in vs))
    c.add(f"{ns}pwf", " UNION ALL ".join(f"SELECT {r} AS r, {j} AS j, w{r}_{j} AS v FROM {ns}sgf" for r, j in ws))
    return f"{ns}pvf", f"{ns}pwf"


def full_fit_ctes(c: Ctes, p, ns: str = "") -> tuple[str, str, str]:
    """The default fit on mixed_orders rows {ns}fx: CTEs of V, W and the mixture."""
    d = len(ORDERS_CONTS)
    start = random_logistic(p.subspace_dimension, d, ORDERS_SLOTS, p.logistic_lambda, p.seed)
    pv, pw = sgd_fit_ctes(c, p, start, ORDERS_CATS, ORDERS_CONTS, ns)
    centres = kmeans_ctes(c, p.gaussian_num, ORDERS_CONTS, p.seed, p.kmeans_max_iter, ns=ns)
    return pv, pw, em_fit_ctes(c, p.gaussian_num, ORDERS_CONTS, centres, p.em_max_iter, p.em_tol, p.min_covar, ns)


def sql_gmm_kmeans_init() -> str:
    c = _events()
    out = kmeans_ctes(c, Q.GMM_K, EVENTS_CONTS, Q.SEED)
    return c.sql("\nUNION ALL\n".join(
        f"SELECT CAST({m} AS INTEGER) AS component, "
        + ", ".join(f"{rnd(f'k{m}_{i}', Q.AGG_DIG)} AS centre{i}" for i in range(len(EVENTS_CONTS))) + f" FROM {out}" for m in range(Q.GMM_K)))


def sql_fit_end_to_end() -> str:
    p, d = Q.FULL_FIT, len(ORDERS_CONTS)
    c = _orders()
    pv, pw, gp = full_fit_ctes(c, p)
    lpc = logistic_ctes(c, pv, pw, p.logistic_lambda, "fin_")
    _, ll, _ = gmm_ctes(c, gp, d, "fing_")
    c.add("sc", f"SELECT fx.row_id, fx.label, g.ll + l.log_p_cat AS score "
                f"FROM fx JOIN {ll} g ON g.row_id = fx.row_id JOIN {lpc} l ON l.row_id = fx.row_id")
    _threshold_ctes(c, p.anomaly_ratio, "score ASC")
    return c.sql(f"SELECT row_id, label, {rnd('score', Q.SCORE_DIG)} AS score, score <= (SELECT thr FROM th) AS is_anomaly FROM sc")


def pivot(source: str, key: str, col: str, names: list[tuple[int, str]], value: str, digits: int = Q.DIG) -> str:
    cols = ", ".join(f"{rnd(f'max(CASE WHEN {col} = {i} THEN {value} END)', digits)} AS {n}" for i, n in names)
    return f"SELECT {key}, {cols} FROM {source} GROUP BY {key}"


# ---------------------------------------------------------------------------
# per-query SQL
# ---------------------------------------------------------------------------

def _orders(intercept=True) -> Ctes:
    c = Ctes()
    long_parts(c, ORDERS_SQL, ORDERS_CATS, ORDERS_CONTS, intercept)
    return c


def _events() -> Ctes:
    c = Ctes()
    long_parts(c, EVENTS_SQL, [], EVENTS_CONTS, intercept=False)
    return c


def sql_mixed_split() -> str:
    return (f"SELECT row_id, label, c0, c1, c2, {rnd('x0')} AS x0, {rnd('x1')} AS x1 FROM ({ORDERS_SQL})")


def sql_validate_profile() -> str:
    parts = ["count(*) AS n_rows"]
    for cc in ORDERS_CATS:
        parts += [f"CAST(min({cc}) AS BIGINT) AS {cc}_min", f"CAST(max({cc}) AS BIGINT) AS {cc}_max",
                  f"CAST(coalesce(max({cc}), -1) + 1 AS BIGINT) AS {cc}_width",
                  f"CAST(sum(CASE WHEN {cc} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {cc}_nulls",
                  f"CAST(sum(CASE WHEN {cc} < 0 OR CAST({cc} AS DOUBLE) <> floor(CAST({cc} AS DOUBLE)) THEN 1 ELSE 0 END)"
                  f" AS BIGINT) AS {cc}_bad"]
    for x in ORDERS_CONTS:
        parts += [f"{rnd(f'var_pop({x})')} AS {x}_var",
                  f"CAST(sum(CASE WHEN {x} IS NULL OR isnan({x}) THEN 1 ELSE 0 END) AS BIGINT) AS {x}_bad",
                  f"CAST(sum(CASE WHEN isinf({x}) THEN 1 ELSE 0 END) AS BIGINT) AS {x}_inf"]
    return f"SELECT {', '.join(parts)} FROM ({ORDERS_SQL})"


def sql_slot_layout() -> str:
    c = _orders()
    return c.sql("SELECT 'c' || CAST(ci AS VARCHAR) AS cat_col, CAST(off AS INTEGER) AS \"offset\", "
                 "CAST(width AS INTEGER) AS width FROM sl")


def sql_one_hot_long() -> str:
    c = _orders()
    return c.sql("SELECT cl.row_id, s.j AS slot, CAST(CASE WHEN cl.code = s.code THEN 1 ELSE 0 END AS INTEGER) AS hot "
                 "FROM cl JOIN slots s ON s.ci = cl.ci")


def sql_logistic_margin() -> str:
    c = _orders()
    given_logistic_ctes(c, Q.LOGISTIC_K, len(ORDERS_CONTS))
    logistic_ctes(c, "pv0", "pw0", Q.LAMBDA)
    c.add("hp", pivot("h", "row_id", "r", [(r, f"h{r}") for r in range(Q.LOGISTIC_K)], "h"))
    c.add("wp", pivot("w", "row_id", "j", [(j, f"w{j}") for j in range(ORDERS_SLOTS)], "w"))
    return c.sql("SELECT * FROM hp JOIN wp USING (row_id)")


def sql_cat_likelihood() -> str:
    c = _orders()
    given_logistic_ctes(c, Q.LOGISTIC_K, len(ORDERS_CONTS))
    lpc = logistic_ctes(c, "pv0", "pw0", Q.LAMBDA)
    return c.sql(f"SELECT row_id, {rnd('log_p_cat')} AS log_p_cat, {rnd('exp(log_p_cat)')} AS p_cat FROM {lpc}")


def sql_minibatch_sample() -> str:
    c = _orders()
    cutoff = cutoff_sql(Q.MINIBATCH, "nn")
    return c.sql(f"SELECT CAST(step AS INTEGER) AS step, row_id, "
                 f"CAST({hsh('row_id', 'step', Q.SEED, STREAM_SLOT)} % (SELECT J FROM jn) AS INTEGER) AS slot "
                 f"FROM fx, range(1, {Q.SGD_STEPS + 1}) t(step) "
                 f"WHERE {hsh('row_id', 'step', Q.SEED, STREAM_SELECT)} < {cutoff}")


def _sgd(steps: int, radius: float) -> Ctes:
    c = _orders()
    given_logistic_ctes(c, Q.LOGISTIC_K, len(ORDERS_CONTS))
    sgd_ctes(c, steps, Q.LAMBDA, radius, Q.LOGISTIC_K, len(ORDERS_CONTS))
    return c


def sql_sgd_gradient() -> str:
    c = _sgd(1, Q.FIT3_RADIUS)
    return c.sql(
        "SELECT 'V' AS matrix, CAST(pv.r AS INTEGER) AS r, CAST(pv.c AS INTEGER) AS c, "
        f"{rnd('coalesce(g.g, 0.0E0)', Q.FIT_DIG)} AS value, CAST((SELECT n FROM n1) AS BIGINT) AS n "
        "FROM pv0 pv LEFT JOIN gv1 g ON g.r = pv.r AND g.c = pv.c\nUNION ALL\n"
        "SELECT 'W', CAST(pw.r AS INTEGER), CAST(pw.j AS INTEGER), "
        f"{rnd('coalesce(g.g, 0.0E0)', Q.FIT_DIG)}, CAST((SELECT n FROM n1) AS BIGINT) "
        "FROM pw0 pw LEFT JOIN gw1 g ON g.r = pw.r AND g.j = pw.j")


def _params_out(t: int) -> str:
    return (f"SELECT 'V' AS matrix, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, {rnd('v', Q.FIT_DIG)} AS value "
            f"FROM pv{t}\nUNION ALL SELECT 'W', CAST(r AS INTEGER), CAST(j AS INTEGER), {rnd('v', Q.FIT_DIG)} FROM pw{t}")


def sql_sgd_fit_3() -> str:
    return _sgd(3, Q.FIT3_RADIUS).sql(_params_out(3))


def sql_sgd_history() -> str:
    c = _sgd(3, Q.FIT3_RADIUS)
    rows = "\nUNION ALL\n".join(f"SELECT iter, n, {rnd('grad_l1', Q.FIT_DIG)} AS grad_l1, {rnd('lr')} AS lr FROM hist{t}"
                                for t in range(1, 4))
    return c.sql(rows)


def sql_gmm_var_init() -> str:
    cols = ", ".join(f"{rnd(f'var_pop({x}) + {f(Q.MIN_COVAR)}')} AS {x}_var" for x in EVENTS_CONTS)
    return f"SELECT {cols} FROM ({EVENTS_SQL})"


def sql_sparse_variance() -> str:
    c = Ctes()
    c.add("sp", SPARSE_SQL)
    c.add("nn", "SELECT count(DISTINCT row_id) AS N FROM sp")
    c.add("sums", "SELECT idx, sum(value) AS s1, sum(value * value) AS s2 FROM sp GROUP BY idx")
    c.add("dims", "SELECT CAST(i AS INTEGER) AS idx FROM range(7) t(i)")
    expr = ("coalesce(s.s2, 0.0E0) / n.N - (coalesce(s.s1, 0.0E0) / n.N) * (coalesce(s.s1, 0.0E0) / n.N) + "
            f"{f(Q.MIN_COVAR)}")
    return c.sql(f"SELECT d.idx, {rnd(expr)} AS variance FROM dims d LEFT JOIN sums s ON s.idx = d.idx, nn n")


def _sparse(iters: int = 1) -> Ctes:
    """The sparse vectors with their zeros, seven rows a vector."""
    c = Ctes()
    c.add("sp", SPARSE_SQL)
    c.add("ids", "SELECT DISTINCT row_id FROM sp")
    c.add("xc", "SELECT i.row_id, CAST(t.c AS INTEGER) AS c, coalesce(sp.value, 0.0E0) / 50.0E0 AS x FROM ids i CROSS JOIN range(7) t(c) "
                "LEFT JOIN sp ON sp.row_id = i.row_id AND sp.idx = t.c")
    given_gmm_cte(c, Q.GMM_K, 7)
    for t in range(1, iters + 1):
        em_step_ctes(c, f"gp{t - 1}", f"gp{t}", 7)
    return c


def sql_gmm_estep_sparse() -> str:
    return _estep_out(_sparse(), "gp1_es", "gp1_ll")


def sql_gmm_fit_sparse_3() -> str:
    return _sparse(3).sql(_gmm_params_out("gp3"))


def sql_gmm_predict_sparse() -> str:
    c = _sparse()
    c.add("wide", pivot("gp1_rs", "row_id", "m", [(m, f"r{m}") for m in range(Q.GMM_K)], "r"))
    c.add("best", "SELECT rs.row_id, CAST(min(rs.m) AS INTEGER) AS component FROM gp1_rs rs JOIN "
                  "(SELECT row_id, max(r) AS mr FROM gp1_rs GROUP BY row_id) b ON b.row_id = rs.row_id AND rs.r = b.mr GROUP BY rs.row_id")
    return c.sql(f"SELECT w.*, {rnd('l.ll')} AS loglik, b.component FROM wide w JOIN gp1_ll l ON l.row_id = w.row_id "
                 "JOIN best b ON b.row_id = w.row_id")


def sql_kmeans_lloyd_step() -> str:
    K, d = Q.GMM_K, len(EVENTS_CONTS)
    dist = {m: " + ".join(f"({x} - {f((m + 0.5) / K)}) * ({x} - {f((m + 0.5) / K)})" for x in EVENTS_CONTS)
            for m in range(K)}
    conds = []
    for m in range(K - 1):
        others = " AND ".join(f"d{m} <= d{o}" for o in range(m + 1, K))
        conds.append(f"WHEN {others} THEN {m}")
    assign = f"CAST(CASE {' '.join(conds)} ELSE {K - 1} END AS INTEGER)"
    # "first minimum": d_m must also be strictly below every earlier distance, which the CASE order gives.
    inner = f"SELECT *, {', '.join(f'{dist[m]} AS d{m}' for m in range(K))} FROM ({EVENTS_SQL})"
    cols = ", ".join(f"{rnd(f'avg({x})')} AS centre{i}" for i, x in enumerate(EVENTS_CONTS))
    return (f"SELECT {assign} AS component, count(*) AS n, {cols} FROM ({inner}) GROUP BY {assign}")


def sql_gmm_component_logpdf() -> str:
    c = _events()
    given_gmm_cte(c, Q.GMM_K, len(EVENTS_CONTS))
    lp, _, _ = gmm_ctes(c, "gp0", len(EVENTS_CONTS), with_weight=False)
    return c.sql(pivot(lp, "row_id", "m", [(m, f"lp{m}") for m in range(Q.GMM_K)], "lp"))


def sql_gmm_loglik() -> str:
    c = _events()
    given_gmm_cte(c, Q.GMM_K, len(EVENTS_CONTS))
    _, ll, _ = gmm_ctes(c, "gp0", len(EVENTS_CONTS))
    return c.sql(f"SELECT row_id, {rnd('ll')} AS loglik FROM {ll}")


def _resp_sql(c: Ctes, gp: str, p: str) -> str:
    _, _, rs = gmm_ctes(c, gp, len(EVENTS_CONTS), p)
    return rs


def sql_gmm_responsibilities() -> str:
    c = _events()
    given_gmm_cte(c, Q.GMM_K, len(EVENTS_CONTS))
    rs = _resp_sql(c, "gp0", "")
    return c.sql(pivot(rs, "row_id", "m", [(m, f"r{m}") for m in range(Q.GMM_K)], "r"))


def _estep_out(c: Ctes, es: str, ll: str) -> str:
    return c.sql(f"SELECT CAST(m AS INTEGER) AS component, CAST(c AS INTEGER) AS dim, {rnd('n', Q.AGG_DIG)} AS n, "
                 f"{rnd('s1', Q.AGG_DIG)} AS s1, {rnd('s2', Q.AGG_DIG)} AS s2, "
                 f"{rnd(f'(SELECT sum(ll) FROM {ll})', Q.AGG_DIG)} AS ll FROM {es}")


def sql_gmm_estep() -> str:
    c = _events()
    given_gmm_cte(c, Q.GMM_K, len(EVENTS_CONTS))
    es = em_step_ctes(c, "gp0", "gp1", len(EVENTS_CONTS))
    return _estep_out(c, es, "gp1_ll")


def sql_gmm_estep_wide() -> str:
    c = _wide()
    es = em_step_ctes(c, "gp0", "gp1", 64)
    return _estep_out(c, es, "gp1_ll")


def _gmm_params_out(gp: str) -> str:
    return (f"SELECT CAST(m AS INTEGER) AS component, CAST(c AS INTEGER) AS dim, {rnd('wt', Q.FIT_DIG)} AS weight, "
            f"{rnd('mu', Q.FIT_DIG)} AS mean, {rnd('var', Q.FIT_DIG)} AS var FROM {gp}")


def _em(iters: int) -> Ctes:
    c = _events()
    given_gmm_cte(c, Q.GMM_K, len(EVENTS_CONTS))
    for t in range(1, iters + 1):
        em_step_ctes(c, f"gp{t - 1}", f"gp{t}", len(EVENTS_CONTS))
    return c


def sql_gmm_em_step() -> str:
    return _em(1).sql(_gmm_params_out("gp1"))


def sql_gmm_fit_3() -> str:
    return _em(3).sql(_gmm_params_out("gp3"))


def sql_gmm_fit_offset() -> str:
    """The fit without the offset: the same numbers, but for the rounding of the shifted column."""
    out = ", ".join(f"{rnd(v, 6)} AS {n}" for v, n in (("wt", "weight"), ("mu", "mean"), ("var", "var")))
    return _em(3).sql(f"SELECT CAST(m AS INTEGER) AS component, CAST(c AS INTEGER) AS dim, {out} FROM gp3")


def sql_gmm_predict() -> str:
    c = _em(1)
    rs = _resp_sql(c, "gp1", "pr_")
    return c.sql(pivot(rs, "row_id", "m", [(m, f"r{m}") for m in range(Q.GMM_K)], "r", Q.FIT_DIG))


def sql_gmm_assign() -> str:
    c = _em(1)
    rs = _resp_sql(c, "gp1", "pr_")
    c.add("best", f"SELECT row_id, max(r) AS mr FROM {rs} GROUP BY row_id")
    return c.sql(f"SELECT rs.row_id, CAST(min(rs.m) AS INTEGER) AS cluster FROM {rs} rs JOIN best b "
                 "ON b.row_id = rs.row_id AND rs.r = b.mr GROUP BY rs.row_id")


def _scores(mode: str) -> Ctes:
    c = _orders()
    given_logistic_ctes(c, Q.LOGISTIC_K, len(ORDERS_CONTS))
    lpc = logistic_ctes(c, "pv0", "pw0", Q.LAMBDA)
    given_gmm_cte(c, Q.GMM_K, len(ORDERS_CONTS))
    _, ll, _ = gmm_ctes(c, "gp0", len(ORDERS_CONTS))
    score = "g.ll + l.log_p_cat" if mode == "joint" else "l.log_p_cat * g.ll"
    c.add("sc", f"SELECT fx.row_id, fx.label, g.ll AS log_p_cont, l.log_p_cat, {score} AS score "
                f"FROM fx JOIN {ll} g ON g.row_id = fx.row_id JOIN {lpc} l ON l.row_id = fx.row_id")
    return c


def sql_stream_score_events() -> str:
    """Batch SQL of what the streaming query computes per micro-batch."""
    d = len(EVENTS_CONTS)
    c = Ctes()
    long_parts(c, EVENTS_SQL, EVENTS_CATS, EVENTS_CONTS, intercept=True)
    given_logistic_ctes(c, Q.LOGISTIC_K, d)
    lpc = logistic_ctes(c, "pv0", "pw0", Q.LAMBDA)
    given_gmm_cte(c, Q.GMM_K, d)
    _, ll, _ = gmm_ctes(c, "gp0", d)
    c.add("sc", f"SELECT fx.row_id, fx.label, g.ll AS log_p_cont, l.log_p_cat, g.ll + l.log_p_cat AS score "
                f"FROM fx JOIN {ll} g ON g.row_id = fx.row_id JOIN {lpc} l ON l.row_id = fx.row_id")
    return c.sql(_score_out())


def _wide() -> Ctes:
    d = 64
    c = Ctes()
    c.add("fx", "SELECT vec_id AS row_id, embedding FROM embeddings")
    c.add("xc", f"SELECT row_id, CAST(i - 1 AS INTEGER) AS c, CAST(embedding[i] AS DOUBLE) AS x "
                f"FROM fx, range(1, {d + 1}) t(i)")
    given_gmm_cte(c, Q.GMM_K, d)
    return c


def sql_gmm_loglik_wide() -> str:
    c = _wide()
    _, ll, _ = gmm_ctes(c, "gp0", 64)
    return c.sql(f"SELECT row_id, {rnd('ll')} AS loglik FROM {ll}")


def _score_out() -> str:
    return (f"SELECT row_id, label, {rnd('log_p_cont')} AS log_p_cont, {rnd('log_p_cat')} AS log_p_cat, "
            f"{rnd('score')} AS score FROM sc")


def sql_score_product() -> str:
    return _scores("product").sql(_score_out())


def sql_score_joint() -> str:
    return _scores("joint").sql(_score_out())


def sql_score_table() -> str:
    return _scores("product").sql(f"SELECT label, {rnd('score')} AS estimator FROM sc")


def sql_score_quality() -> str:
    """Counts of the planted issues; flagged rows from the scores of the rows whose values are finite."""
    c = _orders()
    given_logistic_ctes(c, Q.LOGISTIC_K, len(ORDERS_CONTS))
    given_gmm_cte(c, Q.GMM_K, len(ORDERS_CONTS))
    long_parts(c, """SELECT row_id, CASE WHEN row_id % 43 = 0 THEN -1 ELSE c0 END AS c0, CASE WHEN row_id % 41 = 0 THEN 9 ELSE c1 END AS c1,
      CASE WHEN row_id % 47 <> 0 THEN c2 END AS c2, x0, x1 FROM fx WHERE row_id % 31 <> 0 AND row_id % 37 <> 0 AND row_id % 53 <> 0""",
               ORDERS_CATS, ORDERS_CONTS, ns="d")
    lpc = logistic_ctes(c, "pv0", "pw0", Q.LAMBDA, p="d", data_ns="d", slots_ns="")
    _, ll, _ = gmm_ctes(c, "gp0", len(ORDERS_CONTS), p="d", data_ns="d")
    c.add("flagged", f"SELECT g.row_id FROM {ll} g JOIN {lpc} l ON l.row_id = g.row_id WHERE g.ll + l.log_p_cat <= {f(Q.QUALITY_THRESHOLD)}")
    counts = {"n_rows": "true", "null_x0": "row_id % 31 = 0", "inf_x0": "row_id % 53 = 0 AND row_id % 31 <> 0", "nan_x1": "row_id % 37 = 0",
              "bad_c0": "row_id % 43 = 0", "unseen_c1": "row_id % 41 = 0", "null_c2": "row_id % 47 = 0",
              "n_dirty": "row_id % 31 = 0 OR row_id % 53 = 0 OR row_id % 37 = 0 OR row_id % 43 = 0 OR row_id % 41 = 0 OR row_id % 47 = 0",
              "null_scores": "row_id % 31 = 0", "nan_scores": "row_id % 31 <> 0 AND (row_id % 53 = 0 OR row_id % 37 = 0)"}
    none = ["nan_x0", "null_x1", "inf_x1", "null_c0", "unseen_c0", "null_c1", "bad_c1", "bad_c2", "unseen_c2"]
    parts = [f"SELECT '{name}' AS metric, count(*) FILTER ({cond}) AS n FROM fx" for name, cond in counts.items()]
    parts += [f"SELECT '{name}', CAST(0 AS BIGINT)" for name in none] + ["SELECT 'n_flagged', count(*) FROM flagged"]
    return c.sql(" UNION ALL ".join(parts))


def _order_lines(fixture: str) -> str:
    """Orders as text fields; ``kind`` tells which line is planted as bad."""
    return (f"SELECT row_id % 101 AS kind, CAST(label AS VARCHAR) AS y, CAST(c0 AS VARCHAR) AS c0, CAST(c1 AS VARCHAR) AS c1, "
            f"CAST(c2 AS VARCHAR) AS c2, CAST(CAST(floor(x0 * 500000.0E0) AS BIGINT) AS VARCHAR) AS x0, CAST(row_id AS VARCHAR) AS x1 FROM ({fixture})")


def sql_csv_rejects() -> str:
    c = Ctes().add("t", _order_lines(ORDERS_SQL))
    return c.sql("""SELECT CASE kind WHEN 1 THEN concat_ws(',', y, c0, 'x', c2, x0, x1) WHEN 2 THEN concat_ws(',', y, c0, c1, c2, x0)
      WHEN 3 THEN concat_ws(',', y, c0, c1, c2, x0, x1, '7') WHEN 4 THEN concat_ws(',', y, c0, c1, c2, '', x1)
      WHEN 5 THEN concat_ws(',', 'NaN', c0, c1, c2, x0, x1) WHEN 6 THEN concat_ws(',', y, '-1', c1, c2, x0, x1)
      WHEN 7 THEN concat_ws(',', y, c0, c1, '1.5', x0, x1) WHEN 8 THEN concat_ws(',', y, c0, c1, c2, 'Infinity', x1)
      WHEN 9 THEN concat_ws(',', y, '?', c1, c2, x0, '') ELSE concat_ws(',', y, c0, c1, c2, x0, x1) END AS line,
      CASE kind WHEN 1 THEN '1: not a number' WHEN 2 THEN 'wrong number of fields' WHEN 3 THEN 'wrong number of fields'
      WHEN 4 THEN '3: empty' WHEN 5 THEN 'label: not finite' WHEN 6 THEN '0: not a code' WHEN 7 THEN '2: not a code'
      WHEN 8 THEN '3: not finite' WHEN 9 THEN '0: not a number; 4: empty' ELSE '' END AS reasons FROM t""")


def sql_libsvm_rejects() -> str:
    c = Ctes().add("t", _order_lines(ORDERS_SQL))
    return c.sql("""SELECT concat_ws(' ', CASE WHEN kind = 1 THEN 'y' ELSE y END, CASE kind WHEN 2 THEN '1' WHEN 6 THEN '1:0.5' ELSE '1:' || c0 END,
      CASE WHEN kind = 3 THEN '1:0' ELSE '2:' || c1 END, '3:' || c2, CASE WHEN kind = 5 THEN '4:NaN' ELSE '4:' || x0 END,
      CASE WHEN kind = 4 THEN '6:1' ELSE '5:' || x1 END) AS line,
      CASE kind WHEN 1 THEN 'label: not a number' WHEN 2 THEN 'pair: not index:value' WHEN 3 THEN 'index: not ascending'
      WHEN 4 THEN 'index: out of range' WHEN 5 THEN 'value: not finite' WHEN 6 THEN 'value: not a code' ELSE '' END AS reasons FROM t""")


def sql_sql_function_score() -> str:
    c = _scores("joint")
    _threshold_ctes(c, Q.FLAG_RATIO, "score ASC")
    c.add("lim", "SELECT min(score) AS lo, max(score) AS hi FROM sc")
    return c.sql(f"SELECT row_id, {rnd('score')} AS score, score <= (SELECT thr FROM th) AS is_anomaly, "
                 f"{rnd('(score - lo) / (hi - lo)')} AS p0 FROM sc, lim")


def sql_threshold_sketch() -> str:
    """The exact target rank and range; a sketch within its bound gives true."""
    c = _scores("joint")
    _threshold_ctes(c, Q.FLAG_RATIO, "score ASC")
    return c.sql(f"SELECT count(*) AS n, (SELECT k FROM kk) AS target, true AS within_bound, {rnd('min(score)')} AS lo, {rnd('max(score)')} AS hi FROM sc")


def sql_topk_anomalies() -> str:
    return _scores("joint").sql(f"SELECT row_id, label, {rnd('score')} AS score FROM sc "
                                f"ORDER BY score, row_id LIMIT {Q.TOPK}")


def _threshold_ctes(c: Ctes, ratio: float, order: str) -> None:
    c.add("kk", f"SELECT greatest(1, CAST(floor(N * {f(ratio)}) AS BIGINT)) AS k FROM nn")
    c.add("th", f"SELECT score AS thr FROM (SELECT score, row_number() OVER (ORDER BY {order}) AS rn FROM sc) "
                "WHERE rn = (SELECT k FROM kk)")


def sql_threshold_score() -> str:
    c = _scores("joint")
    _threshold_ctes(c, Q.FLAG_RATIO, "score ASC")
    return c.sql(f"SELECT (SELECT k FROM kk) AS k, {rnd('thr')} AS threshold FROM th")


def sql_threshold_label_score() -> str:
    c = _scores("product")
    _threshold_ctes(c, Q.PARITY_RATIO, "label DESC, score DESC")
    return c.sql(f"SELECT (SELECT k FROM kk) AS k, {rnd('thr')} AS threshold FROM th")


def sql_flag_anomalies() -> str:
    c = _scores("joint")
    _threshold_ctes(c, Q.FLAG_RATIO, "score ASC")
    return c.sql(f"SELECT row_id, {rnd('score')} AS score, score <= (SELECT thr FROM th) AS is_anomaly FROM sc")


def sql_predict_labels() -> str:
    c = _scores("joint")
    _threshold_ctes(c, Q.FLAG_RATIO, "score ASC")
    return c.sql("SELECT row_id, CAST(CASE WHEN score <= (SELECT thr FROM th) THEN 1 ELSE 0 END AS INTEGER) "
                 "AS prediction FROM sc")


def sql_predict_proba() -> str:
    c = _scores("joint")
    c.add("rg", "SELECT min(score) AS mn, max(score) AS mx FROM sc")
    t = "((score - rg.mn) / (rg.mx - rg.mn))"
    return c.sql(f"SELECT row_id, {rnd(t)} AS p0, {rnd(f'1.0E0 - {t}')} AS p1 FROM sc, rg")


def sql_auc() -> str:
    c = _scores("joint")
    c.add("ar", f"SELECT label, {rnd('-score')} AS s FROM sc")
    c.add("rk", "SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0E0 AS rk FROM ar")
    c.add("cnt", "SELECT CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1, "
                 "CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0 FROM ar")
    auc = ("(sum(CASE WHEN rk.label = 1 THEN rk.rk ELSE 0 END) - cnt.n1 * (cnt.n1 + 1) / 2.0E0) "
           "/ (CAST(cnt.n1 AS DOUBLE) * CAST(cnt.n0 AS DOUBLE))")
    return c.sql(f"SELECT {rnd(auc)} AS auc, cnt.n1 AS n_pos, cnt.n0 AS n_neg FROM rk, cnt GROUP BY cnt.n1, cnt.n0")


def _kfold(order: str, normal_only: bool) -> str:
    k = Q.FOLDS
    c = Ctes()
    c.add("fx", ORDERS_SQL)
    c.add("nn", "SELECT count(*) AS N FROM fx")
    c.add("pos", f"SELECT row_id, label, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM fx")
    c.add("qr", f"SELECT N // {k} AS q, N % {k} AS r FROM nn")
    c.add("fa", "SELECT row_id, label, CAST(CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) "
                "ELSE r + (pos - r * (q + 1)) // q END AS INTEGER) AS fold FROM pos, qr")
    c.add("lg", f"SELECT CAST(t.f AS INTEGER) AS fold, CASE WHEN fa.fold = t.f THEN 'test' ELSE 'train' END AS split, "
                f"fa.row_id, fa.label FROM fa, range({k}) t(f)")
    where = " WHERE NOT (split = 'train' AND coalesce(label = 1, false))" if normal_only else ""
    return c.sql(f"SELECT fold, split, row_id FROM lg{where}")


def sql_kfold_contiguous() -> str:
    return _kfold("row_id", False)


def sql_kfold_shuffled() -> str:
    return _kfold(f"{hsh('row_id', '0', Q.SEED, STREAM_FOLD)}, row_id", False)


def sql_kfold_normal_only() -> str:
    return _kfold("row_id", True)


def sql_fit_end_to_end_small() -> str:
    """Given start, 2 SGD steps + 2 EM steps, joint score, k-th smallest threshold, flags."""
    p = Q.SMALL_FIT
    steps = p.max_iterations - 1
    d = len(ORDERS_CONTS)
    c = _orders()
    given_logistic_ctes(c, p.subspace_dimension, d)
    sgd_ctes(c, steps, p.logistic_lambda, p.normalizing_radius, p.subspace_dimension, d, seed=p.seed,
             minibatch=p.minibatch_size, reg=p.regularization_parameter, lr0=p.learning_rate_start,
             speed=p.learning_rate_speed)
    lpc = logistic_ctes(c, f"pv{steps}", f"pw{steps}", p.logistic_lambda, "fin_")
    given_gmm_cte(c, p.gaussian_num, d)
    for t in range(1, p.em_max_iter + 1):
        em_step_ctes(c, f"gp{t - 1}", f"gp{t}", d, p.min_covar)
    _, ll, _ = gmm_ctes(c, f"gp{p.em_max_iter}", d, "fing_")
    c.add("sc", f"SELECT fx.row_id, fx.label, g.ll + l.log_p_cat AS score "
                f"FROM fx JOIN {ll} g ON g.row_id = fx.row_id JOIN {lpc} l ON l.row_id = fx.row_id")
    _threshold_ctes(c, p.anomaly_ratio, "score ASC")
    return c.sql(f"SELECT row_id, label, {rnd('score', Q.FIT_DIG)} AS score, score <= (SELECT thr FROM th) AS is_anomaly "
                 "FROM sc")


def _auc_ctes(c: Ctes, scores: str, p: str, digits: int) -> str:
    """Rank AUC (ties averaged) of -score over (row_id, label, score); returns the CTE with auc, n1, n0."""
    c.add(f"{p}ar", f"SELECT label, {rnd('-score', digits)} AS s FROM {scores} WHERE label IS NOT NULL")
    c.add(f"{p}rk", f"SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0E0 AS rk "
                    f"FROM {p}ar")
    c.add(f"{p}cnt", "SELECT CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1, "
                     f"CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0 FROM {p}ar")
    auc = ("(sum(CASE WHEN rk.label = 1 THEN rk.rk ELSE 0 END) - cnt.n1 * (cnt.n1 + 1) / 2.0E0) "
           "/ (CAST(cnt.n1 AS DOUBLE) * CAST(cnt.n0 AS DOUBLE))")
    c.add(f"{p}auc", f"SELECT {rnd(auc)} AS auc, cnt.n1 AS n_pos, cnt.n0 AS n_neg FROM {p}rk rk, {p}cnt cnt "
                     "GROUP BY cnt.n1, cnt.n0")
    return f"{p}auc"


def _parity_ctes() -> Ctes:
    """Constant start (0.5 everywhere), 2 SGD + 2 EM steps, product score."""
    p = Q.PARITY_FIT
    steps, d = p.max_iterations - 1, len(ORDERS_CONTS)
    c = _orders()
    c.add("pv0", f"SELECT r, cc AS c, 0.5E0 AS v FROM range({p.subspace_dimension}) t1(r), range({d + 1}) t2(cc)")
    c.add("pw0", f"SELECT r, j, 0.5E0 AS v FROM range({p.subspace_dimension}) t1(r), slots")
    sgd_ctes(c, steps, p.logistic_lambda, p.normalizing_radius, p.subspace_dimension, d, seed=p.seed,
             minibatch=p.minibatch_size, reg=p.regularization_parameter, lr0=p.learning_rate_start,
             speed=p.learning_rate_speed)
    lpc = logistic_ctes(c, f"pv{steps}", f"pw{steps}", p.logistic_lambda, "fin_")
    given_gmm_cte(c, p.gaussian_num, d)
    for t in range(1, p.em_max_iter + 1):
        em_step_ctes(c, f"gp{t - 1}", f"gp{t}", d, p.min_covar)
    _, ll, _ = gmm_ctes(c, f"gp{p.em_max_iter}", d, "fing_")
    c.add("sc", f"SELECT fx.row_id, fx.label, g.ll * l.log_p_cat AS score "
                f"FROM fx JOIN {ll} g ON g.row_id = fx.row_id JOIN {lpc} l ON l.row_id = fx.row_id")
    return c


def sql_fit_parity_small() -> str:
    c = _parity_ctes()
    _threshold_ctes(c, Q.PARITY_RATIO, "label DESC, score DESC")
    return c.sql(f"SELECT row_id, label, {rnd('score', Q.AGG_DIG)} AS score, score < (SELECT thr FROM th) AS is_anomaly FROM sc")


def sql_auc_parity_small() -> str:
    c = _parity_ctes()
    c.add("neg", "SELECT label, -score AS score FROM sc")
    return c.sql(f"SELECT auc, n_pos, n_neg FROM {_auc_ctes(c, 'neg', 'pa_', Q.AGG_DIG)}")


def _small_fit(c: Ctes, ns: str) -> tuple[str, str, str]:
    p, d = Q.SMALL_FIT, len(ORDERS_CONTS)
    steps = p.max_iterations - 1
    given_logistic_ctes(c, p.subspace_dimension, d, ns=ns)
    sgd_ctes(c, steps, p.logistic_lambda, p.normalizing_radius, p.subspace_dimension, d, seed=p.seed,
             minibatch=p.minibatch_size, reg=p.regularization_parameter, lr0=p.learning_rate_start,
             speed=p.learning_rate_speed, ns=ns)
    given_gmm_cte(c, p.gaussian_num, d, name=f"{ns}gp0")
    for t in range(1, p.em_max_iter + 1):
        em_step_ctes(c, f"{ns}gp{t - 1}", f"{ns}gp{t}", d, p.min_covar, data_ns=ns)
    return f"{ns}pv{steps}", f"{ns}pw{steps}", f"{ns}gp{p.em_max_iter}"


def sql_cv_auc() -> str:
    return _cv(Q.FULL_FIT, lambda c, ns: full_fit_ctes(c, Q.FULL_FIT, ns), Q.SCORE_DIG, Q.SCORE_DIG)


def sql_cv_auc_small() -> str:
    return _cv(Q.SMALL_FIT, _small_fit, Q.AGG_DIG, Q.DIG)


def _cv(p, fit, digits: int, out_digits: int) -> str:
    """Per fold: fit on the normal-only train rows, score the held-out rows with the train slot layout, rank AUC."""
    k, d = Q.FOLDS, len(ORDERS_CONTS)
    c = Ctes()
    c.add("fxa", ORDERS_SQL)
    c.add("posa", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM fxa")
    c.add("qra", f"SELECT count(*) // {k} AS q, count(*) % {k} AS r FROM fxa")
    c.add("fa", "SELECT row_id, CAST(CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) "
                "ELSE r + (pos - r * (q + 1)) // q END AS INTEGER) AS fold FROM posa, qra")
    outs = []
    for fo in range(k):
        tr, te = f"tr{fo}_", f"te{fo}_"
        long_parts(c, f"SELECT fxa.* FROM fxa JOIN fa ON fa.row_id = fxa.row_id WHERE fa.fold <> {fo} "
                      "AND coalesce(fxa.label <> 1, true)", ORDERS_CATS, ORDERS_CONTS, ns=tr)
        pv, pw, gp = fit(c, tr)
        long_parts(c, f"SELECT fxa.* FROM fxa JOIN fa ON fa.row_id = fxa.row_id WHERE fa.fold = {fo}",
                   ORDERS_CATS, ORDERS_CONTS, ns=te)
        lpc = logistic_ctes(c, pv, pw, p.logistic_lambda, p=f"{te}s_", data_ns=te, slots_ns=tr)
        _, ll, _ = gmm_ctes(c, gp, d, p=f"{te}g_", data_ns=te)
        c.add(f"{te}sc", f"SELECT x.row_id, x.label, g.ll + l.log_p_cat AS score FROM {te}fx x "
                         f"JOIN {ll} g ON g.row_id = x.row_id JOIN {lpc} l ON l.row_id = x.row_id")
        auc = _auc_ctes(c, f"{te}sc", te, digits)
        outs.append(f"SELECT CAST({fo} AS INTEGER) AS fold, {rnd('auc', out_digits)} AS auc, n_pos, n_neg FROM {auc}")
    return c.sql("\nUNION ALL\n".join(outs))


ORACLES = {
    "mixed_split": sql_mixed_split,
    "validate_profile": sql_validate_profile,
    "score_table": sql_score_table,
    "slot_layout": sql_slot_layout,
    "one_hot_long": sql_one_hot_long,
    "logistic_margin": sql_logistic_margin,
    "cat_likelihood": sql_cat_likelihood,
    "cat_likelihood_arrow": sql_cat_likelihood,
    "minibatch_sample": sql_minibatch_sample,
    "sgd_gradient": sql_sgd_gradient,
    "sgd_gradient_arrow": sql_sgd_gradient,
    "sgd_gradient_grouped": sql_sgd_gradient,
    "sgd_fit_3": sql_sgd_fit_3,
    "sgd_fit_barrier": sql_sgd_fit_3,
    "sgd_fit_jobs": sql_sgd_fit_3,
    "sgd_history": sql_sgd_history,
    "gmm_var_init": sql_gmm_var_init,
    "sparse_variance": sql_sparse_variance,
    "kmeans_lloyd_step": sql_kmeans_lloyd_step,
    "gmm_kmeans_init": sql_gmm_kmeans_init,
    "gmm_component_logpdf": sql_gmm_component_logpdf,
    "gmm_loglik": sql_gmm_loglik,
    "gmm_loglik_arrow": sql_gmm_loglik,
    "gmm_responsibilities": sql_gmm_responsibilities,
    "gmm_estep": sql_gmm_estep,
    "gmm_estep_wide": sql_gmm_estep_wide,
    "gmm_loglik_wide": sql_gmm_loglik_wide,
    "gmm_estep_sparse": sql_gmm_estep_sparse,
    "gmm_fit_sparse_3": sql_gmm_fit_sparse_3,
    "gmm_predict_sparse": sql_gmm_predict_sparse,
    "gmm_em_step": sql_gmm_em_step,
    "gmm_fit_3": sql_gmm_fit_3,
    "gmm_fit_offset": sql_gmm_fit_offset,
    "gmm_predict": sql_gmm_predict,
    "gmm_assign": sql_gmm_assign,
    "score_product": sql_score_product,
    "score_joint": sql_score_joint,
    "stream_score_events": sql_stream_score_events,
    "score_quality": sql_score_quality,
    "csv_rejects": sql_csv_rejects,
    "libsvm_rejects": sql_libsvm_rejects,
    "sql_function_score": sql_sql_function_score,
    "threshold_sketch": sql_threshold_sketch,
    "topk_anomalies": sql_topk_anomalies,
    "threshold_score": sql_threshold_score,
    "threshold_label_score": sql_threshold_label_score,
    "flag_anomalies": sql_flag_anomalies,
    "predict_labels": sql_predict_labels,
    "predict_proba": sql_predict_proba,
    "auc": sql_auc,
    "auc_many_ranges": sql_auc,
    "kfold_contiguous": sql_kfold_contiguous,
    "kfold_many_ranges": sql_kfold_contiguous,
    "kfold_shuffled": sql_kfold_shuffled,
    "kfold_normal_only": sql_kfold_normal_only,
    "fit_end_to_end": sql_fit_end_to_end,
    "fit_end_to_end_small": sql_fit_end_to_end_small,
    "cv_auc": sql_cv_auc,
    "auc_parity_small": sql_auc_parity_small,
    "fit_parity_small": sql_fit_parity_small,
    "cv_auc_small": sql_cv_auc_small,
}


def oracle_sql() -> dict[str, str]:
    return {name: fn() for name, fn in ORACLES.items()}
