"""Queries of the low-rank operators on tables, each with its SQL, which works on the same derived panels by other ways:
singular vectors from powers of Gram matrices, 3 x 3 systems by determinants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions import scalars as S
from panelmill.operators import folds as FD
from panelmill.operators import lowrank as W
from panelmill.operators.checkpoints import written
from panelmill.plans import relational as R
from panelmill.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _cells(spark, sf_dir) -> DataFrame:
    """The shipments panel, made once for the many readers in each query."""
    return written(T.complete_shipments(spark, sf_dir), "shipments")


# --- projection of rank 0, 1 and 2: columns 1 and t - mean t, and 1 and (-1)^i less its mean, made orthonormal --------

_SPACES = """un AS (SELECT t_ix, 1 / sqrt((SELECT count(*) FROM periods)) AS u1, (t_ix - (SELECT avg(t_ix) FROM periods)) / sqrt((SELECT count(*) * var_pop(t_ix) FROM periods)) AS u2 FROM periods),
    vn AS (SELECT unit_ix, 1 / sqrt((SELECT count(*) FROM units)) AS v1, (unit_ix % 3 - (SELECT avg(unit_ix % 3) FROM units)) / sqrt((SELECT count(*) * var_pop(unit_ix % 3) FROM units)) AS v2 FROM units),
    c AS (SELECT t_ix, unit_ix, y, u1, u2, v1, v2 FROM panel JOIN un USING (t_ix) JOIN vn USING (unit_ix))"""


def _projected(rank: int) -> str:
    if not rank:
        return "SELECT 0 AS rank, t_ix, unit_ix, 0.0::DOUBLE AS value FROM c"
    ks = range(1, rank + 1)
    ux = ", ".join(f"sum(u{k} * y) AS a{k}" for k in ks)
    xv = ", ".join(f"sum(y * v{k}) AS b{k}" for k in ks)
    core = ", ".join(f"sum(u{k} * y * v{m}) AS c{k}{m}" for k in ks for m in ks)
    value = " + ".join([f"u{k} * a{k} + b{k} * v{k}" for k in ks]) + "".join(f" - u{k} * c{k}{m} * v{m}" for k in ks for m in ks)
    return f"SELECT {rank} AS rank, t_ix, unit_ix, {value} AS value FROM c JOIN (SELECT unit_ix, {ux} FROM c GROUP BY 1) USING (unit_ix) JOIN (SELECT t_ix, {xv} FROM c GROUP BY 1) USING (t_ix) CROSS JOIN (SELECT {core} FROM c)"


def _space(cells: DataFrame, key: str, raw, name: str) -> DataFrame:
    """(key, name ARRAY): a constant and a centred column, of unit length."""
    base = cells.select(key).distinct().withColumn("a", raw)
    one = base.agg(F.count("*").alias("n"), F.avg("a").alias("m"), F.var_pop("a").alias("s"))
    return base.crossJoin(F.broadcast(one)).select(key, F.array(1 / F.sqrt(F.col("n").cast("double")), (F.col("a") - F.col("m")) / F.sqrt(F.col("n") * F.col("s"))).alias(name))


@query(R._sql(f"SELECT CAST(rank AS BIGINT) AS rank, {R._KEYS}, {R._r('value')} AS value FROM ({' UNION ALL '.join(_projected(r) for r in range(3))})", "panel", _SPACES))
def tangent_project_ranks(spark, sf_dir):
    """The shipments panel projected on tangent spaces of ranks 0, 1 and 2."""
    cells = _cells(spark, sf_dir)
    u, v = _space(cells, "t_ix", F.col("t_ix"), "u"), _space(cells, "unit_ix", F.pmod(F.col("unit_ix"), F.lit(3)), "v")
    x = cells.select("t_ix", "unit_ix", F.col("y").alias("value"))
    parts = [W.tangent_project(x, u, v, r).withColumn("rank", F.lit(r)) for r in range(3)]
    return R._out(parts[0].unionByName(parts[1]).unionByName(parts[2]), "rank", "unit_ix", "t_ix", value="value")


# --- singular vectors of a surface from its factors -----------------------------------------------------------------


@query(
    R._sql(
        f"""SELECT side, CAST(ix AS BIGINT) AS ix, {R._r('(a * a * q22 - 2 * a * b * q12 + b * b * q11) / (q11 * q22 - q12 * q12)')} AS leverage,
        {R._r('sqrt((tr + sqrt(tr * tr - 4 * det)) / 2)')} AS first, {R._r('sqrt((tr - sqrt(tr * tr - 4 * det)) / 2)')} AS second
        FROM (SELECT 'period' AS side, t_ix AS ix, a, b, f11 AS q11, f12 AS q12, f22 AS q22 FROM f CROSS JOIN ff UNION ALL SELECT 'unit', unit_ix, a, b, g11, g12, g22 FROM g CROSS JOIN gg)
        CROSS JOIN (SELECT f11 * g11 + 2 * f12 * g12 + f22 * g22 AS tr, (f11 * f22 - f12 * f12) * (g11 * g22 - g12 * g12) AS det FROM ff CROSS JOIN gg)""",
        "panel",
        "f AS (SELECT t_ix, avg(y) AS a, avg(x) AS b FROM panel GROUP BY 1), g AS (SELECT unit_ix, avg(q) AS a, avg(y) AS b FROM panel GROUP BY 1)",
        "ff AS (SELECT sum(a * a) AS f11, sum(a * b) AS f12, sum(b * b) AS f22 FROM f), gg AS (SELECT sum(a * a) AS g11, sum(a * b) AS g12, sum(b * b) AS g22 FROM g)",
    )
)
def block_svd_factors(spark, sf_dir):
    """Singular values of the rank-2 surface of period means and unit means, and the diagonals of its projectors."""
    cells = _cells(spark, sf_dir)
    f = cells.groupBy("t_ix").agg(F.array(F.avg("y"), F.avg("x")).alias("v"))
    g = cells.groupBy("unit_ix").agg(F.array(F.avg("q"), F.avg("y")).alias("v"))
    left, right, s = W.block_svd(f, g, 2, 2)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    both = left.select(F.lit("period").alias("side"), F.col("t_ix").alias("ix"), square.alias("leverage")).union(right.select(F.lit("unit"), "unit_ix", square))
    return R._out(both, "side", "ix", leverage="leverage", first=F.lit(s[0]), second=F.lit(s[1]))


# --- imputation -----------------------------------------------------------------------------------------------------


def _leading_sql(cells: str, name: str, power: int = 7) -> list[str]:
    """CTEs that end in ``{name}_v`` (unit_ix, v), the leading right singular vector of cells (t_ix, unit_ix, x), from
    the Gram matrix squared ``power`` times."""
    out = [f"{name}_p0 AS MATERIALIZED (SELECT a.unit_ix AS i, b.unit_ix AS j, sum(a.x * b.x) AS g FROM {cells} a JOIN {cells} b USING (t_ix) GROUP BY 1, 2)"]
    for k in range(power):
        out.append(f"{name}_p{k + 1} AS MATERIALIZED (SELECT i, j, g / (SELECT max(abs(g)) FROM (SELECT sum(a.g * b.g) AS g FROM {name}_p{k} a JOIN {name}_p{k} b ON a.j = b.i GROUP BY a.i, b.j)) AS g FROM (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM {name}_p{k} a JOIN {name}_p{k} b ON a.j = b.i GROUP BY 1, 2))")
    last = f"{name}_p{power}"
    out.append(f"{name}_v AS MATERIALIZED (SELECT i AS unit_ix, g / sqrt((SELECT sum(g * g) FROM {last} WHERE j = (SELECT arg_max(j, g) FROM {last} WHERE i = j))) AS v FROM {last} WHERE j = (SELECT arg_max(j, g) FROM {last} WHERE i = j))")
    return out


def _impute_sql(rounds: int) -> list[str]:
    out = ["w0 AS MATERIALIZED (SELECT t_ix, unit_ix, y AS part, CASE WHEN (t_ix * 2 + unit_ix) % 5 <> 0 THEN y ELSE 0 END AS x FROM panel)"]
    for k in range(rounds):
        out += _leading_sql(f"w{k}", f"l{k}")
        out.append(f"s{k} AS MATERIALIZED (SELECT t_ix, sum(x * v) AS f FROM w{k} JOIN l{k}_v USING (unit_ix) GROUP BY 1)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT t_ix, unit_ix, part, CASE WHEN (t_ix * 2 + unit_ix) % 5 <> 0 THEN part ELSE f * v END AS x FROM w{k} JOIN s{k} USING (t_ix) JOIN l{k}_v USING (unit_ix))")
    out += _leading_sql(f"w{rounds}", "e")
    out.append(f"es AS MATERIALIZED (SELECT t_ix, sum(x * v) AS f FROM w{rounds} JOIN e_v USING (unit_ix) GROUP BY 1)")
    return out


@query(R._sql(f"SELECT {R._KEYS}, {R._r('f * v', 5)} AS value FROM panel JOIN es USING (t_ix) JOIN e_v USING (unit_ix) WHERE (t_ix * 2 + unit_ix) % 5 = 0", "panel", *_impute_sql(4)))
def soft_impute(spark, sf_dir):
    """A fifth of the shipments panel is held out and filled by four rounds of rank 1; the held-out cells' fit."""
    cells = _cells(spark, sf_dir).withColumn("held", (F.col("t_ix") * 2 + F.col("unit_ix")) % 5 == 0)
    f, g, _ = W.soft_impute(cells.where("NOT held").select("t_ix", "unit_ix", F.col("y").alias("x")), 1)
    held = cells.where("held").join(f, "t_ix").join(g.withColumnRenamed("v", "w"), "unit_ix")
    return R._out(held, "unit_ix", "t_ix", digits=5, value=F.col("v")[0] * F.col("w")[0])


# --- a few sweeps of three blocks in all folds ------------------------------------------------------------------------

_FOLDS, _RIDGE, _SWEEPS = 3, 0.5, 2
_Z = ("x * 10", "q", "1.0")


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _half_sql(name: str, side: str, other: str) -> str:
    """Ridge factors a0, a1, a2 of one side from those of the other, by Cramer's rule."""
    d = [f"z{k} * a{k}" for k in range(3)]
    sums = ", ".join([f"sum({d[a]} * {d[b]}) + {_RIDGE if a == b else 0.0} AS g{a}{b}" for a in range(3) for b in range(a, 3)] + [f"sum({d[k]} * y) AS b{k}" for k in range(3)])
    m = [[f"g{min(a, b)}{max(a, b)}" for b in range(3)] for a in range(3)]
    by = ", ".join(f"{_det([[f'b{a}' if b == k else m[a][b] for b in range(3)] for a in range(3)])} / {_det(m)} AS a{k}" for k in range(3))
    return f"{name} AS MATERIALIZED (SELECT run, {side}, {by} FROM (SELECT run, {side}, {sums} FROM train JOIN {other} USING (run, {'unit_ix' if side == 't_ix' else 't_ix'}) GROUP BY run, {side}))"


def _fit_sql() -> list[str]:
    out = [
        f"runs AS (SELECT range AS run FROM range({_FOLDS}))",
        f"held AS (SELECT a.t_ix, a.unit_ix, r.run, max(CASE WHEN (b.t_ix + b.unit_ix) % {_FOLDS} = r.run THEN 1 ELSE 0 END) AS near FROM panel a JOIN panel b ON a.unit_ix = b.unit_ix AND b.t_ix BETWEEN a.t_ix - 1 AND a.t_ix CROSS JOIN runs r GROUP BY 1, 2, 3)",
        f"train AS MATERIALIZED (SELECT run, t_ix, unit_ix, y, {', '.join(f'{z} AS z{k}' for k, z in enumerate(_Z))} FROM panel JOIN held USING (t_ix, unit_ix) WHERE near = 0)",
        "u0 AS (SELECT run, unit_ix, 1.0 + (unit_ix % 3) / 10.0 AS a0, 1.0 AS a1, 1.0 - (unit_ix % 4) / 10.0 AS a2 FROM units CROSS JOIN runs)",
    ]
    for k in range(_SWEEPS):
        out += [_half_sql(f"p{k + 1}", "t_ix", f"u{k}"), _half_sql(f"u{k + 1}", "unit_ix", f"p{k + 1}")]
    return out


@query(
    R._sql(
        f"""SELECT CAST(run AS BIGINT) AS run, {R._r('0.5 * sse + 0.5 * ' + str(_RIDGE) + ' * (ff + gg)', 5)} AS objective, {R._r('ff', 5)} AS period_norm, {R._r('gg', 5)} AS unit_norm
        FROM (SELECT run, sum(pow(y - z0 * f.a0 * g.a0 - z1 * f.a1 * g.a1 - z2 * f.a2 * g.a2, 2)) AS sse FROM train JOIN p{_SWEEPS} f USING (run, t_ix) JOIN u{_SWEEPS} g USING (run, unit_ix) GROUP BY 1)
        JOIN (SELECT run, sum(a0 * a0 + a1 * a1 + a2 * a2) AS ff FROM p{_SWEEPS} GROUP BY 1) USING (run) JOIN (SELECT run, sum(a0 * a0 + a1 * a1 + a2 * a2) AS gg FROM u{_SWEEPS} GROUP BY 1) USING (run)""",
        "panel",
        *_fit_sql(),
    )
)
def fit_factor_ridge_sweeps(spark, sf_dir):
    """Two sweeps of three blocks in three purged folds at once: objective and squared norms of both sides' factors."""
    cells = _cells(spark, sf_dir).withColumn("z", F.array(F.col("x") * 10, F.col("q"), F.lit(1.0)))
    masks = FD.purged_sets(FD.checker(cells.select("t_ix", "unit_ix"), _FOLDS), _FOLDS, 1)
    long = cells.select("t_ix", "unit_ix", "y", "z").join(masks.select("t_ix", "unit_ix", F.col("trains").alias("runs")), ["t_ix", "unit_ix"])
    runs = F.explode(F.sequence(F.lit(0), F.lit(_FOLDS - 1)))
    g = cells.select("unit_ix").distinct().select(runs.alias("run"), "unit_ix", F.array(1.0 + F.pmod("unit_ix", F.lit(3)) / 10.0, F.lit(1.0), 1.0 - F.pmod("unit_ix", F.lit(4)) / 10.0).alias("v"))
    f = cells.select("t_ix").distinct().select(runs.alias("run"), "t_ix", F.array(*[F.lit(0.0)] * 3).alias("v"))
    f, g, paths = W.fit_factor_ridge(long, f, g, [0, 1, 2], _RIDGE, levels=1, sweeps=_SWEEPS, tol=0.0)
    square = F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    out = f.groupBy("run").agg(square.alias("ff")).join(g.groupBy("run").agg(square.alias("gg")), "run")
    last = F.element_at(F.create_map(*[F.lit(x) for run, path in paths.items() for x in (run, path[-1])]), F.col("run"))
    return R._out(out, "run", digits=5, objective=last, period_norm="ff", unit_norm="gg")


# --- two steps of the debiasing weights' solver -------------------------------------------------------------------------

_STEPS = 2


def _weights_sql() -> list[str]:
    """Conjugate gradients in the coordinates (B, A) of two blocks of rank 1; states b{k} by unit and a{k} by period."""
    out = [
        _SPACES,
        "d AS MATERIALIZED (SELECT t_ix, unit_ix, x * 10 AS z, 1.0 + unit_ix % 2 + t_ix % 2 AS w, (t_ix + unit_ix) % 5 <> 0 AS train, u1, u2, v1, v2 FROM panel JOIN un USING (t_ix) JOIN vn USING (unit_ix))",
        "size AS (SELECT count(*) / count(*) FILTER (train) AS alpha FROM d)",
        "a_raw AS (SELECT t_ix, any_value(u1) AS u1, sum(w * v1) AS h FROM d GROUP BY 1)",
        "b0 AS MATERIALIZED (SELECT unit_ix, 0.0 AS q0, 0.0 AS q1, sum(w * u1) AS r0, 0.0 AS r1, sum(w * u1) AS p0, 0.0 AS p1 FROM d GROUP BY 1)",
        "a0 AS MATERIALIZED (SELECT t_ix, 0.0 AS q0, 0.0 AS q1, h - u1 * c AS r0, 0.0 AS r1, h - u1 * c AS p0, 0.0 AS p1 FROM a_raw CROSS JOIN (SELECT sum(u1 * h) AS c FROM a_raw))",
    ]
    for k in range(_STEPS):
        out += [
            f"s{k} AS MATERIALIZED (SELECT t_ix, unit_ix, z, u1, u2, v1, v2, alpha * (z * (u1 * b.p0 + v1 * a.p0) + u2 * b.p1 + v2 * a.p1) AS s FROM d JOIN b{k} b USING (unit_ix) JOIN a{k} a USING (t_ix) CROSS JOIN size WHERE train)",
            f"hb{k} AS MATERIALIZED (SELECT unit_ix, sum(s * z * u1) AS h0, sum(s * u2) AS h1 FROM s{k} GROUP BY 1)",
            f"hr{k} AS MATERIALIZED (SELECT t_ix, any_value(u1) AS u1, any_value(u2) AS u2, sum(s * z * v1) AS h0, sum(s * v2) AS h1 FROM s{k} GROUP BY 1)",
            f"ha{k} AS MATERIALIZED (SELECT t_ix, h0 - u1 * c0 AS h0, h1 - u2 * c1 AS h1 FROM hr{k} CROSS JOIN (SELECT sum(u1 * h0) AS c0, sum(u2 * h1) AS c1 FROM hr{k}))",
            f"st{k} AS MATERIALIZED (SELECT sum(r0 * r0 + r1 * r1) AS rr, sum(p0 * h0 + p1 * h1) AS ph FROM (SELECT r0, r1, p0, p1, h0, h1 FROM b{k} JOIN hb{k} USING (unit_ix) UNION ALL SELECT r0, r1, p0, p1, h0, h1 FROM a{k} JOIN ha{k} USING (t_ix)))",
        ]
        for side, key in (("b", "unit_ix"), ("a", "t_ix")):
            out.append(f"{side}n{k} AS MATERIALIZED (SELECT {key}, q0 + rr / ph * p0 AS q0, q1 + rr / ph * p1 AS q1, r0 - rr / ph * h0 AS r0, r1 - rr / ph * h1 AS r1, p0, p1 FROM {side}{k} JOIN h{side}{k} USING ({key}) CROSS JOIN st{k})")
        out.append(f"be{k} AS MATERIALIZED (SELECT (SELECT sum(x) FROM (SELECT sum(r0 * r0 + r1 * r1) AS x FROM bn{k} UNION ALL SELECT sum(r0 * r0 + r1 * r1) FROM an{k})) / rr AS beta FROM st{k})")
        for side, key in (("b", "unit_ix"), ("a", "t_ix")):
            out.append(f"{side}{k + 1} AS MATERIALIZED (SELECT {key}, q0, q1, r0, r1, r0 + beta * p0 AS p0, r1 + beta * p1 AS p1 FROM {side}n{k} CROSS JOIN be{k})")
    return out


@query(R._sql(f"SELECT {R._KEYS}, {R._r('z * (u1 * b.q0 + v1 * a.q0) + u2 * b.q1 + v2 * a.q1', 5)} AS psi FROM d JOIN b{_STEPS} b USING (unit_ix) JOIN a{_STEPS} a USING (t_ix)", "panel", *_weights_sql()))
def riesz_weights_steps(spark, sf_dir):
    """Two steps of the matrix-free solver without ridge: weights of one target of the first block, two blocks of rank 1."""
    cells = _cells(spark, sf_dir)
    z = F.array(F.col("x") * 10, F.lit(1.0))
    u, v = _space(cells, "t_ix", F.col("t_ix"), "u"), _space(cells, "unit_ix", F.pmod(F.col("unit_ix"), F.lit(3)), "v")
    long = cells.select("t_ix", "unit_ix", z.alias("z"), ((F.col("t_ix") + F.col("unit_ix")) % 5 != 0).alias("is_train"))
    w = (1.0 + F.col("unit_ix") % 2 + F.col("t_ix") % 2).alias("w")
    directions = cells.select(F.lit("target").alias("target"), F.lit(0).alias("block"), "t_ix", "unit_ix", w)
    n, trained = long.agg(F.count("*"), F.count_if("is_train")).first()
    psi, _ = W.riesz_weights(long, directions, ["target"], u, v, [0, 1], n / max(trained, 1), ridge=0.0, tol=0.0, most=_STEPS)
    return R._out(psi, "unit_ix", "t_ix", digits=5, psi=F.col("psi")[0])


# --- balanced folds over the whole panel ------------------------------------------------------------------------------

_SCATTERED = f"SELECT t_ix, unit_ix, (row_number() OVER (ORDER BY md5('{7}:' || t_ix || ':' || unit_ix), t_ix, unit_ix) - 1) % 6 AS fold FROM panel"


@query(R._sql(f"SELECT {R._KEYS}, CAST(fold AS BIGINT) AS fold FROM ({_SCATTERED})", "panel"))
def folds_scatter(spark, sf_dir):
    """Pseudo-random folds whose sizes differ by one at most over the whole panel."""
    return R._out(FD.scatter_balanced(_cells(spark, sf_dir).select("t_ix", "unit_ix"), 6, 7), "unit_ix", "t_ix", "fold")
