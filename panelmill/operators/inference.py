"""Standard errors from score tables (target, t_ix, unit_ix, psi, u)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _floored(s2, n: int):
    return F.sqrt(F.greatest(s2, F.lit(float(n) ** -2.0)))


def scores(table: DataFrame) -> DataFrame:
    return table.withColumn("v", F.col("psi") * F.col("u"))


def white_se(table: DataFrame, n: int) -> DataFrame:
    """Square root of the sum of psi^2 u^2, by target."""
    return table.groupBy("target").agg(_floored(F.sum(F.col("psi") * F.col("psi") * F.col("u") * F.col("u")), n).alias("se"))


def cluster_se(table: DataFrame, n: int) -> DataFrame:
    """Clustered by period."""
    by_period = scores(table).groupBy("target", "t_ix").agg(F.sum("v").alias("s"))
    return by_period.groupBy("target").agg(_floored(F.sum(F.col("s") * F.col("s")), n).alias("se"))


def default_bandwidth(t: int, n: int) -> int:
    return max(1, round((t + n) ** (1 / 3)))


def bartlett_se(table: DataFrame, n: int, bandwidth: int) -> DataFrame:
    """Bartlett kernel over unit distance within the period, for units 0..N-1 that are all present: the
    lags come from one window by (target, period), so no pairs are made."""
    order = Window.partitionBy("target", "t_ix").orderBy("unit_ix")
    v = F.col("v")
    total = v * v
    for d in range(1, bandwidth):
        total = total + 2.0 * (1.0 - d / bandwidth) * v * F.coalesce(F.lead("v", d).over(order), F.lit(0.0))
    return scores(table).withColumn("k", total).groupBy("target").agg(_floored(F.sum("k"), n).alias("se"))


def conley_se(table: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Triangular kernel over distance; pairs (i, j, w) hold both orders and i = j, only w > 0."""
    s = scores(table)
    left = s.select("target", "t_ix", F.col("unit_ix").alias("i"), F.col("v").alias("vi"))
    right = s.select("target", "t_ix", F.col("unit_ix").alias("j"), F.col("v").alias("vj"))
    return left.join(pairs, "i").join(right, ["target", "t_ix", "j"]).groupBy("target").agg(_floored(F.sum(F.col("vi") * F.col("w") * F.col("vj")), n).alias("se"))


def _wide(table: DataFrame, names: list[str]) -> DataFrame:
    return table.groupBy("t_ix", "unit_ix", "u").pivot("target", names).agg(F.first("psi"))


def joint_cov(table: DataFrame, a: str, b: str) -> DataFrame:
    """Sum of psi_a psi_b u^2."""
    w = _wide(table, [a, b])
    return w.agg(F.sum(F.col(a) * F.col(b) * F.col("u") * F.col("u")).alias("cov"))


def joint_cov_cluster(table: DataFrame, a: str, b: str) -> DataFrame:
    w = _wide(table, [a, b]).groupBy("t_ix").agg(F.sum(F.col(a) * F.col("u")).alias("sa"), F.sum(F.col(b) * F.col("u")).alias("sb"))
    return w.agg(F.sum(F.col("sa") * F.col("sb")).alias("cov"))


def joint_cov_bartlett(table: DataFrame, a: str, b: str, bandwidth: int) -> DataFrame:
    """Symmetrised Bartlett cross-covariance, no floor."""
    order = Window.partitionBy("t_ix").orderBy("unit_ix")
    w = _wide(table, [a, b]).withColumn("va", F.col(a) * F.col("u")).withColumn("vb", F.col(b) * F.col("u"))
    total = F.col("va") * F.col("vb")
    for d in range(1, bandwidth):
        lead_a, lead_b = (F.coalesce(F.lead(c, d).over(order), F.lit(0.0)) for c in ("va", "vb"))
        total = total + (1.0 - d / bandwidth) * (F.col("va") * lead_b + F.col("vb") * lead_a)
    return w.withColumn("k", total).agg(F.sum("k").alias("cov"))


def one_step(fold_plugs: DataFrame, scores_: DataFrame) -> DataFrame:
    """Estimates: share-weighted plug-ins (j, target, p, plug) plus held-out corrections psi * residual."""
    plug = fold_plugs.groupBy("target").agg(F.sum(F.col("p") * F.col("plug")).alias("plugin"))
    correction = scores_.groupBy("target").agg(F.sum(F.col("psi") * F.col("u")).alias("correction"))
    return plug.join(correction, "target").select("target", "plugin", (F.col("plugin") + F.col("correction")).alias("estimate"))


def estimates(scores_: DataFrame, z: float) -> DataFrame:
    """One row for each target of scores (target, t_ix, plug, psi, u): plug-in, estimate, White and clustered errors,
    and intervals of ``z`` errors. The scores, which hold fits, are read once: a fold's plug-in stands on each of its
    cells, so their mean is the share-weighted plug-in."""
    v = F.col("psi") * F.col("u")
    by_period = scores_.groupBy("target", "t_ix").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum("plug").alias("g"), F.count("*").alias("n"))
    n = F.sum("n")
    floor = F.pow(n.cast("double"), F.lit(-2.0))
    out = by_period.groupBy("target").agg((F.sum("g") / n).alias("plugin"), (F.sum("g") / n + F.sum("s")).alias("estimate"), F.sqrt(F.greatest(F.sum("q"), floor)).alias("se"), F.sqrt(F.greatest(F.sum(F.col("s") * F.col("s")), floor)).alias("se_xs"))
    e = F.col("estimate")
    return out.select("*", (e - z * F.col("se")).alias("lower"), (e + z * F.col("se")).alias("upper"), (e - z * F.col("se_xs")).alias("lower_xs"), (e + z * F.col("se_xs")).alias("upper_xs"))
