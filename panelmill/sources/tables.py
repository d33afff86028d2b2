"""Input tables and the panels derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.operators import panel as P


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def month_index(ts):
    return (F.year(ts) - 1995) * 12 + F.month(ts) - 1


def indexed(cells: DataFrame) -> DataFrame:
    """unit_ix and t_ix from 0 in the order of ``unit`` and ``t``; the numbering runs over the small
    tables of distinct units and periods."""
    units = cells.select("unit").distinct().withColumn("unit_ix", F.row_number().over(Window.orderBy("unit")) - 1)
    periods = cells.select("t").distinct().withColumn("t_ix", F.row_number().over(Window.orderBy("t")) - 1)
    return cells.join(units, "unit").join(periods, "t")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation by month of shipment: y = ln(1 + net price), x = mean discount, q = mean quantity,
    on the full grid; absent cells are null."""
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    nations = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    cells = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("unit"), month_index(F.col("l_shipdate")).alias("t"))
    cells = cells.agg(F.log(1 + F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("y"), F.avg("l_discount").alias("x"), (F.avg("l_quantity") / 50).alias("q"))
    grid = P.full_grid(indexed(cells).select("unit_ix", "t_ix", "y", "x", "q"))
    return grid


def complete_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with zeros for absent cells."""
    return shipments(spark, sf_dir).fillna(0.0, ["y", "x", "q"])


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation by month of order: y = ln(1 + total price); absent cells are null."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    cells = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("unit"), month_index(F.col("o_orderdate")).alias("t")).agg(F.log(1 + F.sum("o_totalprice")).alias("y"))
    return P.full_grid(indexed(cells).select("unit_ix", "t_ix", "y"))


def user_day_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day of event, days with events only: y = mean value; sparse."""
    events = table(spark, sf_dir, "events", "user_id", "ts", "value")
    cells = events.groupBy(F.col("user_id").alias("unit"), F.to_date("ts").alias("t")).agg(F.avg("value").alias("y"))
    return indexed(cells).select("unit_ix", "t_ix", "y")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the full grid; absent cells are null."""
    return P.full_grid(user_day_cells(spark, sf_dir))


def annual_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation by year: total = sum of order prices in millions."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    j = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("unit_ix"), F.year("o_orderdate").alias("year")).agg((F.sum("o_totalprice") / 1e6).alias("total"))


def coordinates(panel: DataFrame) -> DataFrame:
    """Deterministic stand-in coordinates from the unit number: the tables carry none."""
    u = F.col("unit_ix")
    return panel.select("unit_ix").distinct().select("unit_ix", (25 + F.pmod(u * 7, F.lit(23)) * 1.0).alias("lat"), (-120 + F.pmod(u * 13, F.lit(47)) * 1.0).alias("lon"))


def score_table(panel: DataFrame) -> DataFrame:
    """Scores of two targets as formulas of the cell, for the inference operators."""
    t, i = F.col("t_ix"), F.col("unit_ix")
    base = panel.select("t_ix", "unit_ix", ((F.pmod(t * 5 + i * 3, F.lit(17)) - 8) / 10.0).alias("u"), F.array(F.struct(F.lit("a").alias("target"), ((F.pmod(t * 7 + i * 2, F.lit(11)) - 5) / 100.0).alias("psi")), F.struct(F.lit("b").alias("target"), ((F.pmod(t * 3 + i * 5, F.lit(13)) - 6) / 100.0).alias("psi"))).alias("s"))
    return base.select("t_ix", "unit_ix", "u", F.explode("s").alias("s")).select("s.target", "t_ix", "unit_ix", "s.psi", "u")


def replication_records(spark: SparkSession, reps: int = 200) -> DataFrame:
    """A fixed table of replication records from integer formulas, for the aggregation operators."""
    r = F.col("rep")
    base = spark.range(reps).select(F.lit("fixed").alias("config"), F.col("id").alias("rep"), F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("k"))
    err = (F.pmod(r * 37 + F.col("k") * 11, F.lit(101)) - 50) / 100.0
    se = (F.pmod(r * 13 + F.col("k") * 5, F.lit(29)) + 10) / 100.0
    return base.select("config", "rep", F.concat(F.lit("target"), F.col("k").cast("string")).alias("target"), err.alias("err"), (err + 0.05).alias("plugin_err"), se.alias("se"), (se * 1.1).alias("se_xs"), (F.abs(err) <= 1.96 * se).cast("int").alias("cov"), (F.abs(err) <= 1.96 * 1.1 * se).cast("int").alias("cov_xs"))
