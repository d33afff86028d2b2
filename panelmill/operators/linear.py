"""The linear design map and its pieces on rows: z and theta are arrays by block, one row for each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_blocks(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Design array z with a trailing one for the interactive block."""
    return panel.withColumn("z", F.array(*[F.col(c).cast("double") for c in columns], F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def design_apply(cells: DataFrame) -> DataFrame:
    return cells.withColumn("fitted", dot(F.col("z"), F.col("theta")))


def design_adjoint(cells: DataFrame) -> DataFrame:
    """(block, t_ix, unit_ix, value): z times r."""
    return cells.select("t_ix", "unit_ix", F.posexplode(F.transform("z", lambda v: v * F.col("r"))).alias("block", "value"))


def theta_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frobenius inner product of two surface tables (block, t_ix, unit_ix, value)."""
    keys = ["block", "t_ix", "unit_ix"]
    return a.join(b.withColumnRenamed("value", "other"), keys).agg(F.sum(F.col("value") * F.col("other")).alias("inner_product"))


def gram(cells: DataFrame, by: str, factors: list[str]) -> DataFrame:
    """Normal equations of one half-sweep: for each ``by`` the sums of d_k d_l and d_k y over training
    cells, where d = z * factor. Partial aggregation makes the shuffle one row for each group and task."""
    d = [F.col(f) for f in factors]
    mask = F.col("is_train").cast("int")
    pairs = [(k, m) for k in range(len(d)) for m in range(k, len(d))]
    return cells.groupBy(by).agg(*[F.sum(mask * d[k] * d[m]).alias(f"g{k}{m}") for k, m in pairs], *[F.sum(mask * d[k] * F.col("y")).alias(f"b{k}") for k in range(len(d))])


def objective(cells: DataFrame, f: DataFrame, lam: DataFrame, ridge: float) -> DataFrame:
    """Half the masked squared error plus half the ridge times the factors' squared norms."""
    sse = cells.agg(F.sum(F.when(F.col("is_train"), F.pow(F.col("y") - F.col("fitted"), 2)).otherwise(0.0)).alias("sse"))
    ff, ll = (x.agg(F.sum(F.col("v") * F.col("v")).alias(n)) for x, n in ((f, "ff"), (lam, "ll")))
    return sse.crossJoin(ff).crossJoin(ll).select((0.5 * F.col("sse") + 0.5 * ridge * (F.col("ff") + F.col("ll"))).alias("objective"))


def tangent_project(x: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """U U'X + X V V' - U U'X V V' for one block of rank 1: x (t_ix, unit_ix, value), u (t_ix, u), v (unit_ix, v)
    of unit norm. Two aggregations and three joins on panel keys."""
    cells = x.join(F.broadcast(u), "t_ix").join(F.broadcast(v), "unit_ix")
    ux = cells.groupBy("unit_ix").agg(F.sum(F.col("u") * F.col("value")).alias("ux"))
    xv = cells.groupBy("t_ix").agg(F.sum(F.col("value") * F.col("v")).alias("xv"))
    uxv = cells.agg(F.sum(F.col("u") * F.col("value") * F.col("v")).alias("uxv"))
    out = cells.join(ux, "unit_ix").join(xv, "t_ix").crossJoin(F.broadcast(uxv))
    return out.select("t_ix", "unit_ix", (F.col("u") * F.col("ux") + F.col("xv") * F.col("v") - F.col("u") * F.col("uxv") * F.col("v")).alias("value"))
