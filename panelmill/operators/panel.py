"""Panel shaping on long frames (unit_ix, t_ix, value columns). Missing values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import scalars as S
from panelmill.operators.quantiles import quantiles


def _unit():
    return Window.partitionBy("unit_ix")


def _by_time():
    return _unit().orderBy("t_ix")


def full_grid(cells: DataFrame) -> DataFrame:
    """Every unit at every period of ``cells``; absent cells get nulls. Units and periods are small
    dimension tables, so their product is as large as the panel itself."""
    units, periods = cells.select("unit_ix").distinct(), cells.select("t_ix").distinct()
    return units.crossJoin(periods).join(cells, ["unit_ix", "t_ix"], "left")


def balanced(panel: DataFrame, value: str) -> DataFrame:
    """Units whose value is present in every period of the panel."""
    periods = panel.agg(F.countDistinct("t_ix").alias("periods"))
    keep = panel.groupBy("unit_ix").agg(F.count(value).alias("n")).join(F.broadcast(periods), F.col("n") == F.col("periods")).select("unit_ix")
    return panel.join(keep, "unit_ix", "left_semi")


def without_sparse_units(grid: DataFrame, value: str, most_missing: int = 6) -> DataFrame:
    keep = grid.groupBy("unit_ix").agg(F.sum(F.col(value).isNull().cast("int")).alias("gaps")).where(F.col("gaps") <= most_missing).select("unit_ix")
    return grid.join(keep, "unit_ix", "left_semi")


def kept_on_grid(cells: DataFrame, value: str, most_missing: int = 6) -> DataFrame:
    """The grid of the units that lack at most ``most_missing`` of the periods of ``cells``. Observations are counted
    first, so the grid is made for kept units only, however many sparse ones there are."""
    periods = cells.select("t_ix").distinct()
    size = periods.agg(F.count("*").alias("size"))
    enough = F.col("n") >= F.col("size") - most_missing
    keep = cells.groupBy("unit_ix").agg(F.count(value).alias("n")).crossJoin(F.broadcast(size)).where(enough).select("unit_ix")  # one row
    return keep.crossJoin(periods).join(cells, ["unit_ix", "t_ix"], "left")


def interpolated_by_index(grid: DataFrame, value: str) -> DataFrame:
    """Linear by position between observations, flat at both ends; all-missing units unchanged."""
    before, after = _by_time().rowsBetween(Window.unboundedPreceding, 0), _by_time().rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("t_ix").alias("t"), F.col(value).alias("v")))
    out = grid.withColumn("_l", F.last(seen, ignorenulls=True).over(before)).withColumn("_n", F.first(seen, ignorenulls=True).over(after))
    between = F.col("_l.v") + (F.col("_n.v") - F.col("_l.v")) * F.try_divide(F.col("t_ix") - F.col("_l.t"), F.col("_n.t") - F.col("_l.t"))
    filled = F.coalesce(F.col(value), between, F.col("_l.v"), F.col("_n.v"))
    return out.withColumn(value, filled).drop("_l", "_n")


def interpolated_by_days(annual: DataFrame, value: str) -> DataFrame:
    """Annual values (unit_ix, year) standing at 1 July, on the month grid from the first to the last
    year: linear in days, missing before the first anchor, flat after the last."""
    anchors = annual.select("unit_ix", F.make_date("year", F.lit(7), F.lit(1)).alias("d"), F.col(value).alias("v")).where("v is not null")
    span = annual.groupBy("unit_ix").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    months = span.select("unit_ix", F.explode(F.sequence(F.make_date("a", F.lit(1), F.lit(1)), F.make_date("b", F.lit(12), F.lit(1)), F.expr("interval 1 month"))).alias("d"))
    at = months.join(anchors, ["unit_ix", "d"], "left")
    order = _unit().orderBy("d")
    seen = F.when(F.col("v").isNotNull(), F.struct("d", "v"))
    out = at.withColumn("_l", F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(seen, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    part = F.try_divide(F.datediff("d", F.col("_l.d")), F.datediff(F.col("_n.d"), F.col("_l.d")))
    filled = F.coalesce("v", F.col("_l.v") + (F.col("_n.v") - F.col("_l.v")) * part, F.col("_l.v"))
    return out.select("unit_ix", F.col("d").alias("month"), filled.alias(value))


def annual_to_monthly_step(annual: DataFrame, value: str) -> DataFrame:
    """Each year's value in all months of the next year."""
    months = annual.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("m"))
    return annual.crossJoin(F.broadcast(months)).select("unit_ix", F.make_date(F.col("year") + 1, F.col("m"), F.lit(1)).alias("month"), value)


def deseasonalized(panel: DataFrame, value: str, month: Column) -> Column:
    by_month = Window.partitionBy("unit_ix", month)
    return F.col(value) - (F.avg(value).over(by_month) - F.avg(value).over(_unit()))


def standardized(value: str) -> Column:
    """z-score within the unit, population standard deviation; a constant unit is only centred."""
    sd = F.stddev_pop(value).over(_unit())
    return (F.col(value) - F.avg(value).over(_unit())) / F.when(sd > 0, sd).otherwise(F.lit(1.0))


def winsorized_zscore(panel: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip at pooled percentiles, then pooled z-score; one-row statistics are broadcast."""
    cut = quantiles(panel, value, (low, high)).withColumnRenamed("q", "_p")
    clipped = panel.join(F.broadcast(cut), F.lit(True), "left").withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("_p")[0]), F.col("_p")[1]))).drop("_p")
    stats = clipped.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return clipped.crossJoin(F.broadcast(stats)).withColumn(value, (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def median_split(panel: DataFrame, value: str) -> DataFrame:
    """unit_ix, unit mean, and the label ``high`` where the mean lies strictly above the median mean."""
    means = panel.groupBy("unit_ix").agg(F.avg(value).alias("unit_mean"))
    middle = quantiles(means, "unit_mean", (0.5,)).select(F.col("q")[0].alias("middle"))
    return means.join(F.broadcast(middle), F.lit(True), "left").select("unit_ix", "unit_mean", F.when(F.col("unit_mean") > F.col("middle"), "high").otherwise("low").alias("grp"))


def pct_change(value: str, k: int) -> Column:
    """Change over k rows of the unit."""
    return F.try_divide(F.col(value), F.lag(value, k).over(_by_time())) - 1


def lagged(value: str, k: int = 1) -> Column:
    return F.lag(value, k).over(_by_time())


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(position).desc())
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(position))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def numbered_duplicates(rows: DataFrame, name: str, position: str) -> Column:
    """Second and later rows of a name get `` #k``."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(position))
    return F.when(k > 1, F.concat(F.col(name), F.lit(" #"), k.cast("string"))).otherwise(F.col(name))


def stationarized(panel: DataFrame, value: str, unit_roots: DataFrame) -> DataFrame:
    """Units flagged in ``unit_roots`` (unit_ix, unit_root) become log differences if all positive, else
    differences; the others keep their level. Every unit loses its first period."""
    out = panel.join(unit_roots, "unit_ix")
    positive = F.min(value).over(_unit()) > 0
    last = lagged(value)
    log_step = F.log(F.greatest(F.col(value), F.lit(1e-300))) - F.log(F.greatest(last, F.lit(1e-300)))
    new = F.when(~F.col("unit_root"), F.col(value)).when(positive, log_step).otherwise(F.col(value) - last)
    first = F.row_number().over(_by_time())
    return out.withColumn("_first", first).withColumn("_v", new).where("_first > 1").drop(value, "_first", "unit_root").withColumnRenamed("_v", value)


def with_ar_design(panel: DataFrame, value: str, lags: int, covariates: list[str] = ()) -> DataFrame:
    """y with its first ``lags`` lags and covariates lagged once; the first ``lags`` periods go."""
    out = panel.select("unit_ix", "t_ix", F.col(value).alias("y"), *[lagged(value, k).alias(f"lag{k}") for k in range(1, lags + 1)], *[lagged(c).alias(c) for c in covariates], F.row_number().over(_by_time()).alias("_k"))
    return out.where(F.col("_k") > lags).drop("_k")


def within_frame(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The two-way within transform by three aggregates joined back, none of which gathers all rows in
    one task; the grand means are one row."""
    units = panel.groupBy("unit_ix").agg(*[F.avg(c).alias(f"_u_{c}") for c in columns])
    periods = panel.groupBy("t_ix").agg(*[F.avg(c).alias(f"_t_{c}") for c in columns])
    grand = panel.agg(*[F.avg(c).alias(f"_g_{c}") for c in columns])
    out = panel.join(units, "unit_ix").join(periods, "t_ix").crossJoin(F.broadcast(grand))
    return out.select("unit_ix", "t_ix", *[(F.col(c) - F.col(f"_u_{c}") - F.col(f"_t_{c}") + F.col(f"_g_{c}")).alias(c) for c in columns])


def two_way_ar(panel: DataFrame, value: str, lags: int) -> DataFrame:
    """Pooled within AR(1) or AR(2): coefficients, their sum, RMSE, R2 and cells, in one aggregation."""
    names = ["y", *[f"lag{k}" for k in range(1, lags + 1)]]
    w = within_frame(with_ar_design(panel, value, lags), names)
    x, y = F.col("lag1"), F.col("y")
    sums = [F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.count("*").alias("n_cells")]
    if lags == 1:
        s = w.agg(*sums).withColumn("beta1", F.col("xy") / F.col("xx"))
        s = s.withColumn("ssr", F.col("yy") - F.col("beta1") * F.col("xy")).withColumn("total", F.col("beta1"))
        coefficients = ["beta1"]
    else:
        z = F.col("lag2")
        s = w.agg(*sums, F.sum(z * z).alias("zz"), F.sum(x * z).alias("xz"), F.sum(z * y).alias("zy"))
        det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
        s = s.withColumn("beta1", (F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy")) / det).withColumn("beta2", (F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy")) / det)
        s = s.withColumn("ssr", F.col("yy") - F.col("beta1") * F.col("xy") - F.col("beta2") * F.col("zy")).withColumn("total", F.col("beta1") + F.col("beta2"))
        coefficients = ["beta1", "beta2"]
    return s.select(*coefficients, F.col("total").alias("beta_sum"), F.sqrt(F.col("ssr") / F.col("n_cells")).alias("rmse"), (1 - F.col("ssr") / F.col("yy")).alias("r2"), "n_cells")


def state_of_codes(areas: DataFrame, states: list[str] = S.STATES) -> DataFrame:
    """(code, state) of areas (code, name, position): the first state that the name holds; codes without leading
    zeros, of a code's several states the last row's."""
    rows = areas.select(S.bare_code(F.col("code")).alias("code"), S.state_token(F.col("name"), states).alias("state"), "position").where("state IS NOT NULL")
    return rows.groupBy("code").agg(F.max_by("state", "position").alias("state"))


def state_means(values: DataFrame, states: DataFrame) -> DataFrame:
    """(state, mean, n) of values (code, value) by the state of their code; codes without one are left out."""
    keyed = values.withColumn("code", S.bare_code(F.col("code"))).join(states, "code")
    return keyed.groupBy("state").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
