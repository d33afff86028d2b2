"""Low-rank linear algebra on tables, for panels that no task could hold.

Cells are rows (t_ix, unit_ix, ...), absent cells are zero. Factors are rows (t_ix, v ARRAY) and (unit_ix, v ARRAY).
A product of cells with a factor is a join on one key and sums by the other; what goes to the driver are
Gram matrices of factors, whose size is the number of columns, never a row for each period or unit.
Tables that a loop makes anew are written to the shared folder, which cuts the lineage, and deleted again.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.checkpoints import drop_written, written

_SIDE = {"t_ix": "unit_ix", "unit_ix": "t_ix"}


def _total(terms: list[Column]) -> Column:
    return reduce(operator.add, terms) if terms else F.lit(0.0)


def _array(terms: list[Column]) -> Column:
    return F.array(*terms) if terms else F.array().cast("array<double>")


def times(v: Column, w: np.ndarray) -> Column:
    """A row vector times a small matrix."""
    return _array([_total([v[k] * float(w[k, m]) for k in range(w.shape[0])]) for m in range(w.shape[1])])


def gram(table: DataFrame, size: int, other: str = "v") -> np.ndarray:
    """The sums of v v' (or v other') over all rows."""
    if not size:
        return np.zeros((0, 0))
    row = table.agg(*[F.coalesce(F.sum(F.col("v")[a] * F.col(other)[b]), F.lit(0.0)) for a in range(size) for b in range(size)]).first()
    return np.array(row, float).reshape(size, size)


def product(cells: DataFrame, factor: DataFrame, size: int, side: str) -> DataFrame:
    """(side, v ARRAY): the sums of x times the other side's factor, by ``side``."""
    joined = cells.join(factor, _SIDE[side])
    return joined.groupBy(side).agg(_array([F.sum(F.col("x") * F.col("v")[k]) for k in range(size)]).alias("v"))


# --- singular vectors --------------------------------------------------------------------------------------------


def tall_r(table: DataFrame, size: int, fan: int = 64) -> np.ndarray:
    """R of the QR decomposition of the rows v: each partition gives its own R, and a tree of ``fan`` stacks and
    decomposes them again, so no task and not the driver holds more than ``fan`` small matrices or a partition's rows."""

    def local(batches):
        r = np.zeros((0, size))
        for pdf in batches:
            if len(pdf):
                r = np.linalg.qr(np.vstack([r, np.stack(pdf["v"])]), mode="r")
        if len(r):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def stack(pdf):
        r = np.linalg.qr(np.vstack([np.asarray(x).reshape(-1, size) for x in pdf["r"]]), mode="r")
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // fan], "r": [r.ravel()]})

    parts = table.select("v").mapInPandas(local, "part long, r array<double>")
    for _ in range(3):
        parts = parts.groupBy(F.floor(F.col("part") / fan)).applyInPandas(stack, "part long, r array<double>")
    top = [np.asarray(x.r).reshape(-1, size) for x in parts.collect()]
    return np.linalg.qr(np.vstack(top), mode="r") if top else np.zeros((0, size))


def signs(left: DataFrame, size: int) -> np.ndarray:
    """Signs that make the entry of largest size of each left vector positive; the first of equal ones counts."""
    if not size:
        return np.ones(0)
    first = [F.max_by(F.col("v")[k], F.struct(F.abs(F.col("v")[k]), -F.col("t_ix"))) for k in range(size)]
    return np.array([-1.0 if x is not None and x < 0 else 1.0 for x in left.agg(*first).first()])


def block_svd(f: DataFrame, g: DataFrame, columns: int, rank: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """(left (t_ix, v), right (unit_ix, v), singular values) of the surface f g', from thin factors only: QR of both
    and a decomposition of the small core. Rank 0 gives empty vectors."""
    rf, rg = tall_r(f, columns), tall_r(g, columns)
    u, s, vt = np.linalg.svd(rf @ rg.T)
    rank = min(rank, len(s))
    left = f.select("t_ix", times(F.col("v"), np.linalg.pinv(rf) @ u[:, :rank]).alias("v"))
    sign = np.diag(signs(left, rank))
    right = g.select("unit_ix", times(F.col("v"), np.linalg.pinv(rg) @ vt[:rank].T @ sign).alias("v"))
    return left.select("t_ix", times(F.col("v"), sign).alias("v")), right, [float(x) for x in s[:rank]]


def _whitening(g: np.ndarray) -> np.ndarray:
    """Columns that turn vectors of Gram matrix ``g`` orthonormal, largest first; directions that are lost in
    rounding are left out."""
    values, q = np.linalg.eigh((g + g.T) / 2)
    keep = np.flatnonzero(values > 1e-13 * max(values.max(initial=0.0), 1e-300))[::-1]
    return q[:, keep] / np.sqrt(values[keep])


def leading(cells: DataFrame, rank: int, low: tuple[DataFrame, DataFrame, int] | None = None, extra: int = 8, tol: float = 1e-14, most: int = 60, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """(left (t_ix, v), right (unit_ix, v), singular values) of the ``rank`` largest of a matrix that is the sum of
    cells (t_ix, unit_ix, x) and a low-rank part (f, g, columns), by block power iteration with ``extra`` more
    columns. It ends once the values move by at most ``tol`` of the largest. ``start`` (unit_ix, v) holds vectors that are
    near the right ones already. A matrix of zeros, or no cells at all, gives no vectors. The cells are made once."""
    own = written(cells.select("t_ix", "unit_ix", "x"), "power-cells")
    out = _leading(own, rank, low, extra, tol, most, start)
    drop_written(own)
    return out


def _leading(cells: DataFrame, rank: int, low: tuple[DataFrame, DataFrame, int] | None = None, extra: int = 8, tol: float = 1e-14, most: int = 60, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """``leading`` of cells that are cheap to read, as every step reads them twice."""
    size = rank + extra
    noise = [(F.xxhash64(F.lit(k), "unit_ix") / 2.0**63).alias(f"c{k}") for k in range(size)]
    units = cells.select("unit_ix") if low is None else cells.select("unit_ix").union(low[1].select("unit_ix"))
    v = units.distinct().select("unit_ix", *noise)
    if start is not None:
        v = v.join(start.withColumnRenamed("v", "near"), "unit_ix", "left")
        v = v.select("unit_ix", *[F.coalesce(F.get("near", F.lit(k)), F.lit(0.0)).alias(f"c{k}") if k < rank else F.col(f"c{k}") for k in range(size)])
    v = written(v.select("unit_ix", F.array(*[f"c{k}" for k in range(size)]).alias("v")), "power-start")

    def apply(factor: DataFrame, size: int, side: str) -> DataFrame:
        out = product(cells, factor, size, side)
        if low is not None:
            own, other = (low[0], low[1]) if side == "t_ix" else (low[1], low[0])
            both = other.withColumnRenamed("v", "w").join(factor, _SIDE[side])
            sums = both.agg(*[F.coalesce(F.sum(F.col("w")[a] * F.col("v")[b]), F.lit(0.0)) for a in range(low[2]) for b in range(size)]).first()
            core = np.array(sums, float).reshape(low[2], size)
            plus = own.select(side, times(F.col("v"), core).alias("w"))
            out = out.join(plus, side, "full").select(side, _array([F.coalesce(F.col("v")[k], F.lit(0.0)) + F.coalesce(F.col("w")[k], F.lit(0.0)) for k in range(size)]).alias("v"))
        return written(out, f"power-{side}")

    before, calm, old = None, 0, [v]
    for _ in range(most):
        y = apply(v, size, "t_ix")
        turn = _whitening(gram(y, size))
        if not turn.shape[1]:
            return y.select("t_ix", _array([]).alias("v")), v.select("unit_ix", _array([]).alias("v")), []
        orthonormal = y.select("t_ix", times(F.col("v"), turn).alias("v"))
        z = apply(orthonormal, turn.shape[1], "unit_ix")
        values, q = np.linalg.eigh(gram(z, turn.shape[1]))
        values, q = values[::-1].clip(min=0.0), q[:, ::-1]
        s = np.sqrt(values)
        drop_written(*old)
        old = [y, z]
        keep = s > 1e-13 * s[0]
        size = int(keep.sum())
        v = z.select("unit_ix", times(F.col("v"), q[:, keep] / s[keep]).alias("v"))
        now = s[:rank]
        calm = calm + 1 if before is not None and len(before) == len(now) and np.abs(now - before).max(initial=0.0) <= tol * s[0] else 0
        before = now
        if calm or size == 1:
            break
    rank = min(rank, size)
    left = orthonormal.select("t_ix", times(F.col("v"), q[:, :rank]).alias("v"))
    right = v.select("unit_ix", F.slice("v", 1, rank).alias("v"))
    return left, right, [float(x) for x in s[:rank]]


def first_singular_share(cells: DataFrame) -> DataFrame:
    """(share): the largest squared singular value of cells (t_ix, unit_ix, x) over the sum of squares; 0 of none."""
    cells = written(cells.select("t_ix", "unit_ix", "x"), "power-cells")
    total = cells.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    left, right, s = _leading(cells, 1)
    drop_written(left, right, cells)
    share = float(s[0] ** 2 / total) if s and total and total > 0 else 0.0
    return cells.sparkSession.range(1).select(F.lit(share).alias("share"))


def soft_impute(cells: DataFrame, rank: int, rounds: int = 4) -> tuple[DataFrame, DataFrame, list[float]]:
    """(f (t_ix, v), g (unit_ix, v), singular values) of training cells (t_ix, unit_ix, x) after ``rounds`` of filling
    all other cells with the best rank-``rank`` fit; both factors carry the square roots of the values.

    The filled matrix is never made: it is the training cells' distance from the fit plus the fit itself. Other
    cells are zero before the first round.
    """
    cells = written(cells.select("t_ix", "unit_ix", "x"), "impute-cells")
    low, s, old, now = None, [], [], cells
    for k in range(rounds + 1):
        left, right, s = _leading(now, rank, low, start=low and low[1])
        root = np.diag(np.sqrt(s)) if s else np.zeros((0, 0))
        f = written(left.select("t_ix", times(F.col("v"), root).alias("v")), "impute-period")
        g = written(right.select("unit_ix", times(F.col("v"), root).alias("v")), "impute-unit")
        drop_written(left, right, *old)
        if now is not cells:
            drop_written(now)
        if not s or k == rounds:
            break
        low, old = (f, g, len(s)), [f, g]
        fit = cells.join(f, "t_ix", "left").join(g.withColumnRenamed("v", "w"), "unit_ix", "left")
        inner = _total([F.coalesce(F.col("v")[k] * F.col("w")[k], F.lit(0.0)) for k in range(len(s))])
        now = written(fit.select("t_ix", "unit_ix", (F.col("x") - inner).alias("x")), "impute-rest")
    drop_written(cells)
    return f, g, s


def warm_start(cells: DataFrame, ranks: tuple[int, ...], rounds: int = 4, floor: float = 1e-3) -> list[tuple[DataFrame, DataFrame, list[float]]]:
    """Factors by block for cells (t_ix, unit_ix, y, z ARRAY, is_train): each outcome is split over its blocks by least
    norm, and each block's part is imputed on the training cells. A block of rank 0 has none."""
    norm = F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x) + floor
    train = cells.where("is_train")
    return [soft_impute(train.select("t_ix", "unit_ix", (F.col("z")[b] * F.col("y") / norm).alias("x")), r, rounds) for b, r in enumerate(ranks) if r]


# --- tangent spaces ----------------------------------------------------------------------------------------------


def tangent_project(x: DataFrame, u: DataFrame, v: DataFrame, rank: int) -> DataFrame:
    """U U'X + X V V' - U U'X V V' for one block: x (t_ix, unit_ix, value), u (t_ix, u ARRAY) and v (unit_ix, v ARRAY)
    with orthonormal columns. Two sums by unit and by period, a core of rank x rank in one row; rank 0 gives zeros."""
    if not rank:
        return x.select("t_ix", "unit_ix", F.lit(0.0).alias("value"))
    cells = x.join(u, "t_ix").join(v, "unit_ix")
    ux = cells.groupBy("unit_ix").agg(_array([F.sum(F.col("u")[k] * F.col("value")) for k in range(rank)]).alias("ux"))
    xv = cells.groupBy("t_ix").agg(_array([F.sum(F.col("value") * F.col("v")[k]) for k in range(rank)]).alias("xv")).join(u, "t_ix")
    core = xv.agg(*[F.sum(F.col("u")[k] * F.col("xv")[m]).alias(f"c{k}_{m}") for k in range(rank) for m in range(rank)])
    rest = xv.crossJoin(F.broadcast(core)).select("t_ix", _array([F.col("xv")[m] - _total([F.col("u")[k] * F.col(f"c{k}_{m}") for k in range(rank)]) for m in range(rank)]).alias("rest"))
    out = cells.join(ux, "unit_ix").join(rest, "t_ix")
    return out.select("t_ix", "unit_ix", _total([F.col("u")[k] * F.col("ux")[k] + F.col("rest")[k] * F.col("v")[k] for k in range(rank)]).alias("value"))


def riesz_weights(cells: DataFrame, directions: DataFrame, targets: list[str], u: DataFrame, v: DataFrame, block: list[int], alpha: float, ridge: float = 1e-8, tol: float = 1e-10, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Weights (t_ix, unit_ix, psi ARRAY by target) and solver report (target, iterations, converged, rayleigh).

    Solves (alpha P A* M A P + ridge lambda P) q = P D by conjugate gradients for all targets at once and gives
    A q, where A sums z times a surface over the blocks, M keeps training cells, P projects on the tangent space and
    lambda is the Rayleigh quotient after four power steps from P D. cells: (t_ix, unit_ix, z ARRAY, is_train);
    directions: sparse weights (target, block, t_ix, unit_ix, w); u (t_ix, u ARRAY) and v (unit_ix, v ARRAY) hold
    the orthonormal columns of all blocks side by side, ``block`` names each column's.

    A tangent surface of a block is U B' + A V' with U'A = 0, and inner products are those of (B, A): the state of the
    solver is a row for each unit and period, and one step is two sums over cells. The numbers that steer it, some
    for each target, are the only ones that the driver reads. A target without direction gets zeros.
    """
    m, r = len(targets), len(block)
    spark = cells.sparkSession
    if not r:
        zero = cells.select("t_ix", "unit_ix", _array([F.lit(0.0)] * m).alias("psi"))
        return zero, spark.createDataFrame([(t, 0, True, 0.0) for t in targets], "target string, iterations int, converged boolean, rayleigh double")
    at = [(j, k) for j in range(m) for k in range(r)]
    same = [(j, k, n) for j, k in at for n in range(r) if block[n] == block[k]]
    zero = _array([F.lit(0.0)] * (m * r))
    # every step reads U
    u, v = written(u.select("t_ix", "u"), "riesz-u"), written(v.select("unit_ix", "v"), "riesz-v")
    base = cells.join(u, "t_ix").join(v, "unit_ix").select("t_ix", "unit_ix", "is_train", _array([F.col("z")[b] * F.col("u")[k] for k, b in enumerate(block)]).alias("zu"), _array([F.col("z")[b] * F.col("v")[k] for k, b in enumerate(block)]).alias("zv"))
    base = written(base, "riesz-cells")
    train = base.where("is_train")
    # the state's rows: every period with its row of u, every unit with none
    rows = written(u.select(F.lit(True).alias("period"), F.col("t_ix").alias("ix"), "u").unionByName(v.select(F.lit(False).alias("period"), F.col("unit_ix").alias("ix"), _array([F.lit(0.0)] * r).alias("u"))), "riesz-rows")

    def flat(name: str, j: int, k: int) -> Column:
        return F.col(name)[j * r + k]

    def level(j: int) -> Column:
        """A of target j's tangent surface, in a cell."""
        return _total([F.col("zu")[k] * flat("own_i", j, k) + F.col("zv")[k] * flat("own_t", j, k) for k in range(r)])

    def met(state: DataFrame, name: str, of: DataFrame) -> DataFrame:
        by = [state.where("period").select(F.col("ix").alias("t_ix"), F.col(name).alias("own_t")), state.where("NOT period").select(F.col("ix").alias("unit_ix"), F.col(name).alias("own_i"))]
        return of.join(by[0], "t_ix").join(by[1], "unit_ix")

    def projected(state: DataFrame, sums: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The state with the projection of ``sums`` (period, ix, h) beside it as h, and the table that it reads: the part
        of the period side along U is taken out, block by block."""
        made = written(sums, "riesz-sums")
        side = made.where("period").select("ix", "h").join(u.withColumnRenamed("t_ix", "ix"), "ix")
        row = side.agg(*[F.coalesce(F.sum(F.col("u")[n] * flat("h", j, k)), F.lit(0.0)) for j, k, n in same]).first()
        core = {p: float(x) for p, x in zip(same, row, strict=True)}
        joined = state.join(made, ["period", "ix"], "left").withColumn("h", F.coalesce("h", zero))
        return joined.withColumn("h", _array([flat("h", j, k) - _total([F.col("u")[n] * core[j, k, n] for n in range(r) if block[n] == block[k]]) for j, k in at])), made

    def grown(state: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """alpha P A* M A of a column."""
        cell = met(state, name, train).select("t_ix", "unit_ix", "zu", "zv", _array([level(j) * float(alpha) for j in range(m)]).alias("s"))
        unit = cell.groupBy(F.lit(False).alias("period"), F.col("unit_ix").alias("ix")).agg(_array([F.sum(F.col("s")[j] * F.col("zu")[k]) for j, k in at]).alias("h"))
        period = cell.groupBy(F.lit(True).alias("period"), F.col("t_ix").alias("ix")).agg(_array([F.sum(F.col("s")[j] * F.col("zv")[k]) for j, k in at]).alias("h"))
        return projected(state, unit.unionByName(period))

    def inner(state: DataFrame, *pairs: str) -> np.ndarray:
        """Inner products of columns, such as "ph", by pair and target."""
        row = state.agg(*[F.coalesce(F.sum(_total([flat(a, j, k) * flat(b, j, k) for k in range(r)])), F.lit(0.0)) for a, b in pairs for j in range(m)]).first()
        return np.array(row, float).reshape(len(pairs), m)

    def scaled(name: str, by: np.ndarray) -> Column:
        return _array([flat(name, j, k) * float(by[j]) for j, k in at])

    # right-hand side: P D, summed from the sparse directions
    weight = written(directions.join(u, "t_ix").join(v, "unit_ix").select("target", "block", "t_ix", "unit_ix", "w", "u", "v"), "riesz-directions")
    mine = {(j, k): F.when((F.col("target") == targets[j]) & (F.col("block") == block[k]), F.col("w")).otherwise(0.0) for j, k in at}
    unit = weight.groupBy(F.lit(False).alias("period"), F.col("unit_ix").alias("ix")).agg(_array([F.sum(mine[j, k] * F.col("u")[k]) for j, k in at]).alias("h"))
    period = weight.groupBy(F.lit(True).alias("period"), F.col("t_ix").alias("ix")).agg(_array([F.sum(mine[j, k] * F.col("v")[k]) for j, k in at]).alias("h"))
    begun, read = projected(rows, unit.unionByName(period))
    state = written(begun.select("period", "ix", "u", zero.alias("q"), F.col("h").alias("r"), F.col("h").alias("p")), "riesz-state")
    drop_written(read, weight, rows, v)

    # lambda by four power steps
    power, rayleigh = state.select("period", "ix", "u", "p"), np.zeros(m)
    for step in range(5):
        nxt, read = grown(power, "p")
        ph, pp, hh = inner(nxt, "ph", "pp", "hh")
        rayleigh = np.divide(ph, pp, out=np.zeros(m), where=pp > 0)
        new = power
        if step < 4:
            new = written(nxt.select("period", "ix", "u", scaled("h", np.divide(1, np.sqrt(hh), out=np.zeros(m), where=hh > 0)).alias("p")), "riesz-power")
        drop_written(read, *([power] if step else []))
        power = new
    shift = ridge * np.maximum(rayleigh, 1e-12)

    # each step's squared residual is summed from the residual itself: a recursion would lose it near the end
    rr = inner(state, "rr")[0]
    begin = rr.copy()
    table, steps, done = state, np.zeros(m, int), rr <= 0
    for step in range(1, most + 1):
        if done.all():
            break
        nxt, read = grown(state, "p")
        ph, pp = inner(nxt, "ph", "pp")
        bend = ph + shift * pp
        a = np.where(done, 0.0, np.divide(rr, bend, out=np.zeros(m), where=bend > 0))
        less = [flat("r", j, k) - (flat("h", j, k) + flat("p", j, k) * float(shift[j])) * float(a[j]) for j, k in at]
        more = [flat("q", j, k) + flat("p", j, k) * float(a[j]) for j, k in at]
        old, table = table, written(nxt.select("period", "ix", "u", _array(more).alias("q"), _array(less).alias("r"), "p"), "riesz-state")
        drop_written(old, read)
        rest = inner(table, "rr")[0]
        steps[~done] = step
        b = np.where(done, 0.0, np.divide(rest, rr, out=np.zeros(m), where=rr > 0))
        done = done | (np.sqrt(rest) <= tol * np.sqrt(begin))
        rr = rest
        state = table.select("period", "ix", "u", "q", "r", _array([flat("r", j, k) + flat("p", j, k) * float(b[j]) for j, k in at]).alias("p"))
    psi = met(state, "q", base).select("t_ix", "unit_ix", _array([level(j) for j in range(m)]).alias("psi"))
    drop_written(u)
    report = spark.createDataFrame([(t, int(steps[j]), bool(done[j]), float(rayleigh[j])) for j, t in enumerate(targets)], "target string, iterations int, converged boolean, rayleigh double")
    return psi, report


# --- factor ridge ------------------------------------------------------------------------------------------------


def ridge_levels(ridge: float, levels: int) -> list[float]:
    return [float(x) for x in np.geomspace(max(1.0, 50 * ridge), ridge, levels)] if levels > 1 else [ridge]


def fit_factor_ridge(cells: DataFrame, f: DataFrame, g: DataFrame, block: list[int], ridge: float = 0.02, levels: int = 8, sweeps: int = 80, tol: float = 1e-8, least_sweeps: int = 15) -> tuple[DataFrame, DataFrame, dict[int, list[float]]]:
    """Annealed alternating ridge of several runs (folds or restarts) at once: (f (run, t_ix, v), g (run, unit_ix, v),
    objective path of the last level by run).

    cells: (t_ix, unit_ix, y, z ARRAY, runs ARRAY<INT>), where ``runs`` names the runs that a cell trains, so the panel
    is one row a cell however many folds there are. f and g are starting factors; ``block`` names each column's block.
    A half-sweep sums the normal equations of all blocks by (run, key) in one aggregation and solves them in
    batches. The solutions carry their own squared error, so the objective needs no other pass; a run whose decrease
    is at most ``tol`` of it stops, and its factors stay. The driver reads one number a run and sweep. Periods and
    units without training cells get zeros, as the ridge alone decides there.
    """
    r = len(block)
    pairs = [(a, b) for a in range(r) for b in range(a, r)]
    cells = written(cells.select("t_ix", "unit_ix", "y", "z", "runs"), "ridge-cells")
    ends = {"t_ix": f.select("run", "t_ix"), "unit_ix": g.select("run", "unit_ix")}
    ends = {k: written(x, f"ridge-{k}") for k, x in ends.items()}

    def half(side: str, factors: DataFrame, level: float, active: list[int], before: DataFrame) -> DataFrame:
        long = cells.select("t_ix", "unit_ix", "y", "z", F.explode("runs").alias("run")).where(F.col("run").isin(active))
        joined = long.join(factors.select("run", _SIDE[side], "v"), ["run", _SIDE[side]])
        d = [F.col("z")[b] * F.col("v")[k] for k, b in enumerate(block)]
        joined = joined.select("run", side, "y", *[x.alias(f"d{k}") for k, x in enumerate(d)])
        made = joined.groupBy("run", side).agg(
            F.array(*[F.sum(F.col(f"d{a}") * F.col(f"d{b}")) for a, b in pairs]).alias("a"),
            F.array(*[F.sum(F.col(f"d{k}") * F.col("y")) for k in range(r)]).alias("b"),
            F.sum(F.col("y") * F.col("y")).alias("yy"),
        )
        empty = [F.coalesce(F.col(c), F.array(*[F.lit(0.0)] * n)).alias(c) for c, n in (("a", len(pairs)), ("b", r))]
        made = ends[side].where(F.col("run").isin(active)).join(made, ["run", side], "left").select("run", side, *empty, F.coalesce("yy", F.lit(0.0)).alias("yy"))

        def solve(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                flat, b = np.stack(pdf["a"]), np.stack(pdf["b"])
                a = np.zeros((len(pdf), r, r))
                for n, (i, j) in enumerate(pairs):
                    a[:, i, j] = a[:, j, i] = flat[:, n]
                x = np.linalg.solve(a + level * np.eye(r), b[:, :, None])[:, :, 0]
                sse = pdf["yy"].to_numpy() - 2 * (b * x).sum(axis=1) + np.einsum("nk,nkl,nl->n", x, a, x)
                yield pd.DataFrame({"run": pdf["run"], side: pdf[side], "v": list(x), "sse": sse, "norm": (x * x).sum(axis=1)})

        kinds = dict(made.dtypes)
        solved = made.mapInPandas(solve, f"run int, {side} {kinds[side]}, v array<double>, sse double, norm double")
        # runs that have stopped keep what they have
        return written(solved.unionByName(before.where(~F.col("run").isin(active))), f"ridge-{side}")

    zero = [F.lit(0.0).alias(c) for c in ("sse", "norm")]
    f, g = f.select("run", "t_ix", "v", *zero), g.select("run", "unit_ix", "v", *zero)
    runs = sorted(x[0] for x in ends["t_ix"].select("run").distinct().collect())
    paths: dict[int, list[float]] = {}
    own: list[DataFrame] = []
    for number, level in enumerate(ridge_levels(ridge, levels) if r else []):
        last = number == max(levels, 1) - 1
        paths, active = {run: [] for run in runs}, list(runs)
        for _ in range(sweeps if last else max(least_sweeps, sweeps // 3)):
            f_new = half("t_ix", g, level, active, f)
            g_new = half("unit_ix", f_new, level, active, g)
            drop_written(*own)
            f, g = f_new, g_new
            own = [f, g]
            sums = f.select("run", F.lit(0.0).alias("sse"), "norm").unionByName(g.select("run", "sse", "norm")).groupBy("run").agg((0.5 * F.sum("sse") + 0.5 * level * F.sum("norm")).alias("o"))
            for row in sums.where(F.col("run").isin(active)).collect():
                paths[row.run].append(row.o)
            active = [run for run in active if len(paths[run]) < 2 or paths[run][-2] - paths[run][-1] > tol * max(1.0, abs(paths[run][-2]))]
            if not active:
                break
    drop_written(cells, *ends.values())
    return f.select("run", "t_ix", "v"), g.select("run", "unit_ix", "v"), paths


def best_runs(f: DataFrame, g: DataFrame, paths: dict[int, list[float]], restarts: int) -> tuple[DataFrame, DataFrame]:
    """Of runs numbered fold * restarts + restart, the factors of each fold's least final objective; earlier on ties."""
    folds = sorted({run // restarts for run in paths})
    best = [min((paths[j * restarts + k][-1], j * restarts + k) for k in range(restarts))[1] for j in folds]
    pick = [x.where(F.col("run").isin(best)).withColumn("run", F.floor(F.col("run") / restarts).cast("int")) for x in (f, g)]
    return pick[0], pick[1]


def perturbed(factor: DataFrame, key: str, size: int, restarts: int, amount: float = 0.1, seed: int = 0) -> DataFrame:
    """``restarts`` copies of a starting factor (run, key, v), numbered run * restarts + restart: the first as it is, the
    others with normal noise that depends on seed, run, restart and key only."""
    copies = factor.select("run", key, "v", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))

    def uniform(k: int, which: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(key), "run", "restart", key, F.lit(k), F.lit(which)), F.lit(2**52)) + 0.5) / float(2**52)

    noise = [F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(2 * np.pi * uniform(k, 1)) for k in range(size)]
    moved = _array([F.col("v")[k] + F.when(F.col("restart") == 0, 0.0).otherwise(amount * noise[k]) for k in range(size)])
    return copies.select((F.col("run") * restarts + F.col("restart")).cast("int").alias("run"), key, moved.alias("v"))
