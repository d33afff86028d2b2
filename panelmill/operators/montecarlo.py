"""Aggregation of replication records (config, rep, target, err, plugin_err, se, se_xs, cov, cov_xs)."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.scalars import Z95


def unfinished(total: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks (config, rep) without a record."""
    return total.join(done.select("config", "rep").distinct(), ["config", "rep"], "left_anti")


def aggregate(records: DataFrame) -> DataFrame:
    """One row for each target: bias, errors, standard errors, coverage, lengths, studentised quantiles.
    Records that repeat (config, rep, target) count once."""
    r = records.dropDuplicates(["config", "rep", "target"])
    z = F.when(F.col("se") > 0, F.col("err") / F.col("se"))
    q = F.percentile(z, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = r.groupBy("config", "target").agg(
        F.count("*").alias("reps"),
        F.avg("err").alias("bias"),
        F.avg(F.abs("err")).alias("mean_abs"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.stddev_pop("err").alias("sd"),
        F.avg("se").alias("mean_se"),
        F.avg("se_xs").alias("mean_se_xs"),
        F.avg(F.col("cov").cast("double")).alias("coverage"),
        F.avg(F.col("cov_xs").cast("double")).alias("coverage_xs"),
        F.avg(2 * Z95 * F.col("se")).alias("length"),
        F.avg(2 * Z95 * F.col("se_xs")).alias("length_xs"),
        F.avg("plugin_err").alias("plugin_bias"),
        F.sqrt(F.avg(F.col("plugin_err") * F.col("plugin_err"))).alias("plugin_rmse"),
        F.avg(z).alias("t_mean"),
        F.stddev_pop(z).alias("t_sd"),
        q.alias("q"),
    )
    return out.select("*", F.col("q")[0].alias("t_q05"), F.col("q")[1].alias("t_q50"), F.col("q")[2].alias("t_q95")).drop("q")


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile, null outside (0, 1)."""

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        return x.map(lambda v: inv(v) if 0 < v < 1 else None)

    return of(p)


def studentized_qq(records: DataFrame, step: int = 1) -> DataFrame:
    """Plotting positions (k - 1/2)/n by target against sorted studentised errors, every ``step``-th point."""
    z = records.where("se > 0").dropDuplicates(["config", "rep", "target"]).select("target", (F.col("err") / F.col("se")).alias("z"), "rep")
    w = Window.partitionBy("target")
    out = z.select("target", "z", F.row_number().over(w.orderBy("z", "rep")).alias("k"), F.count("*").over(w).alias("n"))
    return out.where(F.col("k") % step == 0).select("target", "k", ((F.col("k") - 0.5) / F.col("n")).alias("p"), "z")


def argmin_rank(table: DataFrame) -> DataFrame:
    """Candidate with the least (criterion, dimension, ranks)."""
    return table.orderBy("criterion", "dimension", "ranks").limit(1)
