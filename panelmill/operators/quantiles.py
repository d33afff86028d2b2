"""Exact quantiles whose last step holds a narrow band of values, not the whole column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups up to this size are ranked whole.
SMALL = 100_000
#: Share of the values on either side of a quantile that the band reaches for.
SLACK = 0.0005
ACCURACY = 10_000


def quantiles(table: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., q ARRAY): interpolated quantiles of the values that are not null, for few groups.

    A sketch brackets every quantile within ``SLACK`` of its rank. Values below a bracket are only counted, those
    inside are counted by value and ranked, so a task sees about a thousandth of a large group. Groups without
    values have no row.
    """
    by = list(by)
    x = table.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ladder = [max(0.0, p - SLACK) for p in probs] + [min(1.0, p + SLACK) for p in probs]
    # one row for each group
    sizes = F.broadcast(x.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ladder)), F.lit(ACCURACY)).alias("_b")))
    met = x.join(sizes, by) if by else x.crossJoin(sizes)
    large, k = F.col("_n") > SMALL, len(probs)
    bands = [F.struct(F.lit(i).alias("i"), F.when(large, F.col("_b")[i]).alias("low"), F.when(large, F.col("_b")[k + i]).alias("high"), ((F.col("_n") - 1) * p).alias("pos")) for i, p in enumerate(probs)]
    cells = met.select(*by, "_v", F.explode(F.array(*bands)).alias("p")).select(*by, "_v", "p.*").where(F.col("high").isNull() | (F.col("_v") <= F.col("high")))
    inside = F.when(F.col("low").isNull() | (F.col("_v") >= F.col("low")), F.col("_v"))
    counts = cells.groupBy(*by, "i", "pos", inside.alias("v")).agg(F.count("*").alias("c"))
    # what lies below the band is the null that sorts first
    ranked = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first())))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    out = ranked.groupBy(*by, "i", "pos").agg(at(F.floor("pos")).alias("a"), at(F.ceil("pos")).alias("b"))
    q = (F.col("a") + (F.col("pos") - F.floor("pos")) * (F.col("b") - F.col("a"))).alias("q")
    out = out.select(*by, "i", q).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("all"))
    return out.select(*by, F.transform("all", lambda s: s["q"]).alias("q")) if by else out.where(F.size("all") > 0).select(F.transform("all", lambda s: s["q"]).alias("q"))
