"""Residual and coefficient diagnostics on long frames."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.checkpoints import written
from panelmill.operators.quantiles import quantiles


def _order():
    return Window.partitionBy("unit_ix").orderBy("t_ix")


def autocorrelations(panel: DataFrame, value: str, max_lag: int = 6) -> DataFrame:
    """Mean over units of sum r_t r_{t-k} / sum r_t^2, r centred by unit; zero where the unit is constant."""
    r = panel.withColumn("r", F.col(value) - F.avg(value).over(Window.partitionBy("unit_ix")))
    products = [F.sum(F.col("r") * F.coalesce(F.col(f"l{k}"), F.lit(0.0))).alias(f"p{k}") for k in range(1, max_lag + 1)]
    lagged = r.select("*", *[F.lag("r", k).over(_order()).alias(f"l{k}") for k in range(1, max_lag + 1)])
    units = lagged.groupBy("unit_ix").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), *products)
    means = units.agg(*[F.avg(F.when(F.col("rr") > 0, F.col(f"p{k}") / F.col("rr")).otherwise(0.0)).alias(f"a{k}") for k in range(1, max_lag + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("autocorr")) for k in range(1, max_lag + 1)])
    return means.select(F.explode(pairs).alias("p")).select("p.lag", "p.autocorr")


def average_cross_correlation(panel: DataFrame, value: str) -> DataFrame:
    """Mean off-diagonal correlation of units without the N x N matrix: (sum_t (sum_i z)^2 / T - n) / (n (n-1))."""
    w = Window.partitionBy("unit_ix")
    sd = F.stddev_pop(value).over(w)
    z = panel.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd))
    z = z.where("z is not null")
    t = z.groupBy("t_ix").agg(F.sum("z").alias("s"))
    n = z.agg(F.countDistinct("unit_ix").alias("n"))
    return t.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("t")).crossJoin(n).select(F.try_divide(F.col("ss") / F.col("t") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("avg_corr"))


def quantile_stats(table: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, population sd and exact 5, 50, 95 % quantiles."""
    q = quantiles(table, value, (0.05, 0.5, 0.95), by)
    out = table.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    out = out.join(F.broadcast(q), by, "left") if by else out.join(F.broadcast(q), F.lit(True), "left")
    return out.select(*by, "mean", "sd", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"))


def heterogeneity(table: DataFrame, value: str, group: str) -> DataFrame:
    """The same overall and by group, labels as values."""
    overall = quantile_stats(table.withColumn(group, F.lit("all")), value, [group])
    return overall.unionByName(quantile_stats(table, value, [group]))


def histogram(table: DataFrame, value: str, bins: int = 40, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Counts in equal bins between two quantiles; outside values go, the last bin is closed."""
    edges = quantiles(table, value, (low, high)).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    x = table.crossJoin(F.broadcast(edges)).where(F.col(value).between(F.col("lo"), F.col("hi")))
    bin_ = F.least(F.floor(F.try_divide((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    counts = x.groupBy(F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    grid = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def residual_fit(panel: DataFrame, residual: str, outcome: str) -> DataFrame:
    r, y = F.col(residual), F.col(outcome)
    return panel.agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), F.sqrt(F.avg(r * r)).alias("rmse"), F.var_pop(r).alias("variance"), (1 - F.var_pop(r) / F.var_pop(y)).alias("r2"))


def first_singular_share(panel: DataFrame, value: str) -> DataFrame:
    """Largest squared singular value over their sum, by block power iteration on the cells."""
    from panelmill.operators.lowrank import first_singular_share as share

    return share(panel.select("t_ix", "unit_ix", F.col(value).alias("x")))


def residual_diagnostics(panel: DataFrame, residual: str, outcome: str) -> DataFrame:
    """(lag, autocorr) with the residual's fit, average cross correlation and first singular share beside them. The
    panel is made once; what the result reads of it stays until the program ends."""
    panel = written(panel.select("unit_ix", "t_ix", *dict.fromkeys((residual, outcome))), "residuals")
    one = residual_fit(panel, residual, outcome).crossJoin(average_cross_correlation(panel, residual)).crossJoin(first_singular_share(panel, residual))
    # one row beside six
    return autocorrelations(panel, residual).crossJoin(F.broadcast(one))


def adf_statistics(panel: DataFrame, value: str, p: int = 4, critical: float = -2.86) -> DataFrame:
    """(unit_ix, t_stat, unit_root): augmented test with a constant and ``p`` lagged differences; levels of
    positive series are tested in logs, missing values left out, series of up to p + 8 differences give 0.

    The regression runs in windows by unit, all under one partitioning: each regressor in turn is taken out
    of those behind it and of the difference, so the last step leaves the lagged level's coefficient.
    """
    w, o = Window.partitionBy("unit_ix"), _order()
    y = panel.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("least", F.min(value).over(w))
    y = y.select("unit_ix", "t_ix", F.when(F.col("least") > 0, F.log(F.col(value))).otherwise(F.col(value)).alias("y"))
    y = y.select("*", F.row_number().over(o).alias("k"), F.count("*").over(w).alias("size"), F.lag("y").over(o).alias("level"))
    y = y.withColumn("d", F.col("y") - F.col("level"))
    names = [*[f"d{j}" for j in range(1, p + 1)], "level", "d"]
    y = y.select("*", *[F.lag("d", j).over(o).alias(f"d{j}") for j in range(1, p + 1)])
    used = F.col("k") >= p + 2
    y = y.select("unit_ix", "size", *[F.when(used, F.col(c)).alias(c) for c in names])
    y = y.select("unit_ix", "size", *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in names])
    for k in range(p):
        own = F.col(names[k])
        rest = [(F.col(c) - own * F.coalesce(F.try_divide(F.sum(own * F.col(c)).over(w), F.sum(own * own).over(w)), F.lit(0.0))).alias(c) for c in names[k + 1 :]]
        y = y.select("unit_ix", "size", *[F.col(c) for c in names[: k + 1]], *rest)
    x, d = F.col("level"), F.col("d")
    sums = y.groupBy("unit_ix").agg(F.max("size").alias("size"), F.count("d").alias("n"), F.sum(x * x).alias("xx"), F.sum(x * d).alias("xd"), F.sum(d * d).alias("dd"))
    variance = (F.col("dd") - F.col("xd") * F.col("xd") / F.col("xx")) / F.greatest(F.col("n") - (p + 2), F.lit(1))
    stat = F.when((F.col("size") - 1 > p + 8) & (F.col("xx") > 0) & (variance > 0), F.col("xd") / F.col("xx") / F.sqrt(variance / F.col("xx"))).otherwise(0.0)
    return sums.select("unit_ix", stat.alias("t_stat")).withColumn("unit_root", F.col("t_stat") > critical)


def horizon(panel: DataFrame) -> int:
    """The log of the number of cells, rounded up, at least 1 and at most the number of periods; counted here, as the
    windows to plan depend on it."""
    cells, periods = panel.agg(F.count("*"), F.countDistinct("t_ix")).first()
    return max(1, min(math.ceil(math.log(cells)) if cells else 1, periods))


def companion_persistence(panel: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """(unit_ix, growth, persistence): the largest h-th root of the spectral norm of products of h consecutive
    companion matrices of a two-lag process, h up to ``most``, which is the panel's ``horizon`` unless it is given;
    persistence is capped at 0.99. Norms of 2 x 2 products are closed forms, so all is windows by unit."""
    o = _order()
    most = most or horizon(panel)
    df = panel.select("unit_ix", "t_ix", F.col(a).alias("a"), F.col(b).alias("b"))
    ahead = [F.lead(c, h).over(o).alias(f"{c}{h}") for h in range(1, most) for c in ("a", "b")]
    df = df.select("*", *ahead, F.col("a").alias("p1"), F.col("b").alias("q1"), F.lit(1.0).alias("r1"), F.lit(0.0).alias("s1"))
    for h in range(1, most):
        p, q, r, s = (F.col(f"{c}{h}") for c in "pqrs")
        x, y = F.col(f"a{h}"), F.col(f"b{h}")
        df = df.select("*", (x * p + y * r).alias(f"p{h + 1}"), (x * q + y * s).alias(f"q{h + 1}"), p.alias(f"r{h + 1}"), q.alias(f"s{h + 1}"))

    def root(h: int):
        p, q, r, s = (F.col(f"{c}{h}") for c in "pqrs")
        square, det = p * p + q * q + r * r + s * s, p * s - q * r
        norm = F.sqrt((square + F.sqrt(F.greatest(square * square - 4 * det * det, F.lit(0.0)))) / 2)
        return F.pow(norm, F.lit(1.0 / h))

    out = df.groupBy("unit_ix").agg(F.max(F.greatest(*[root(h) for h in range(1, most + 1)], F.lit(0.0))).alias("growth"))
    return out.withColumn("persistence", F.least("growth", F.lit(0.99)))


def persistence_window(panel: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """For h = 1..most, the panel's ``horizon`` unless given, the largest geometric mean of |a| over h consecutive
    periods, over all cells."""
    most = most or horizon(panel)
    log = panel.withColumn("l", F.log(F.greatest(F.abs(F.col(value)), F.lit(1e-12))))

    def one(h: int) -> DataFrame:
        frame = _order().rowsBetween(-(h - 1), 0)
        full = log.select(F.avg("l").over(frame).alias("m"), F.count("l").over(frame).alias("k")).where(F.col("k") == h)
        return full.agg(F.exp(F.max("m")).alias("persistence")).select(F.lit(h).alias("h"), "persistence")

    return reduce(DataFrame.unionByName, [one(h) for h in range(1, most + 1)])
