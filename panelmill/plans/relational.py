"""Queries of the relational operators, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import scalars as S
from panelmill.operators import diagnostics as D
from panelmill.operators import estimator as E
from panelmill.operators import folds as FD
from panelmill.operators import inference as I
from panelmill.operators import linear as L
from panelmill.operators import montecarlo as M
from panelmill.operators import panel as P
from panelmill.operators.checkpoints import written
from panelmill.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_MONTH = "(year({0}) - 1995) * 12 + month({0}) - 1"
_CTES = {
    "panel": f"""cells AS (SELECT s_nationkey AS unit, {_MONTH.format('l_shipdate')} AS t, ln(1 + sum(l_extendedprice * (1 - l_discount))) AS y,
        avg(l_discount) AS x, avg(l_quantity) / 50 AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    units AS (SELECT unit, CAST(row_number() OVER (ORDER BY unit) - 1 AS INT) AS unit_ix FROM (SELECT DISTINCT unit FROM cells)),
    periods AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS INT) AS t_ix FROM (SELECT DISTINCT t FROM cells)),
    grid AS (SELECT unit_ix, t_ix, y, x, q FROM units CROSS JOIN periods LEFT JOIN cells USING (unit, t)),
    panel AS (SELECT unit_ix, t_ix, coalesce(y, 0) AS y, coalesce(x, 0) AS x, coalesce(q, 0) AS q FROM grid)""",
    "orders": f"""cells AS (SELECT c_nationkey AS unit, {_MONTH.format('o_orderdate')} AS t, ln(1 + sum(o_totalprice)) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    units AS (SELECT unit, CAST(row_number() OVER (ORDER BY unit) - 1 AS INT) AS unit_ix FROM (SELECT DISTINCT unit FROM cells)),
    periods AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS INT) AS t_ix FROM (SELECT DISTINCT t FROM cells)),
    grid AS (SELECT unit_ix, t_ix, y FROM units CROSS JOIN periods LEFT JOIN cells USING (unit, t))""",
    "days": """cells AS (SELECT user_id AS unit, CAST(ts AS DATE) AS t, avg(value) AS y FROM events GROUP BY 1, 2),
    units AS (SELECT unit, CAST(row_number() OVER (ORDER BY unit) - 1 AS INT) AS unit_ix FROM (SELECT DISTINCT unit FROM cells)),
    periods AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS INT) AS t_ix FROM (SELECT DISTINCT t FROM cells)),
    grid AS (SELECT unit_ix, t_ix, y FROM units CROSS JOIN periods LEFT JOIN cells USING (unit, t))""",
    "annual": "annual AS (SELECT c_nationkey AS unit_ix, year(o_orderdate) AS year, sum(o_totalprice) / 1e6 AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
}
_SCORES = """scores AS (SELECT 'a' AS target, t_ix, unit_ix, ((t_ix * 7 + unit_ix * 2) % 11 - 5) / 100.0 AS psi, ((t_ix * 5 + unit_ix * 3) % 17 - 8) / 10.0 AS u FROM panel
    UNION ALL SELECT 'b', t_ix, unit_ix, ((t_ix * 3 + unit_ix * 5) % 13 - 6) / 100.0, ((t_ix * 5 + unit_ix * 3) % 17 - 8) / 10.0 FROM panel),
    size AS (SELECT count(*) AS n FROM panel)"""
_RECORDS = """base AS (SELECT r.range AS rep, k.range AS k FROM range(200) r CROSS JOIN range(8) k),
    e AS (SELECT 'fixed' AS config, rep, 'target' || k AS target, ((rep * 37 + k * 11) % 101 - 50) / 100.0 AS err, ((rep * 13 + k * 5) % 29 + 10) / 100.0 AS se FROM base),
    records AS (SELECT config, rep, target, CAST(err AS DOUBLE) AS err, CAST(err + 0.05 AS DOUBLE) AS plugin_err, CAST(se AS DOUBLE) AS se, CAST(se AS DOUBLE) * 1.1 AS se_xs,
        CAST(abs(err) <= 1.96 * se AS INT) AS cov, CAST(abs(err) <= 1.96 * 1.1 * se AS INT) AS cov_xs FROM e)"""


def _sql(body: str, *ctes: str) -> str:
    parts = [_CTES.get(c, c) for c in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _out(df: DataFrame, *keys: str, digits: int = 6, **values) -> DataFrame:
    """Key columns as 64-bit integers where numeric, values rounded."""
    kinds = dict(df.dtypes)
    ks = [F.col(k).cast("long").alias(k) if kinds[k] in ("int", "bigint", "smallint") else F.col(k) for k in keys]
    return df.select(*ks, *[S.rounded(F.col(v) if isinstance(v, str) else v, digits).alias(k) for k, v in values.items()])


_KEYS = "CAST(unit_ix AS BIGINT) AS unit_ix, CAST(t_ix AS BIGINT) AS t_ix"
_BY_T = "PARTITION BY unit_ix ORDER BY t_ix"


# --- panel shaping ---------------------------------------------------------------------------------


@query(_sql(f"SELECT {_KEYS}, {_r('y')} AS y, {_r('x')} AS x, {_r('q')} AS q FROM grid", "panel"))
def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(T.shipments(spark, sf_dir), "unit_ix", "t_ix", y="y", x="x", q="q")


@query(_sql(f"SELECT {_KEYS}, {_r('y')} AS y FROM grid WHERE unit_ix IN (SELECT unit_ix FROM grid GROUP BY unit_ix HAVING count(y) = (SELECT count(*) FROM periods))", "panel"))
def balance_panel(spark, sf_dir):
    return _out(P.balanced(T.shipments(spark, sf_dir), "y"), "unit_ix", "t_ix", y="y")


@query(_sql(f"SELECT {_KEYS}, {_r('y')} AS y FROM grid WHERE unit_ix IN (SELECT unit_ix FROM grid GROUP BY unit_ix HAVING count(*) - count(y) <= 6)", "days"))
def drop_sparse_units(spark, sf_dir):
    cells = T.user_day_cells(spark, sf_dir)
    return _out(P.kept_on_grid(cells, "y", 6), "unit_ix", "t_ix", y="y")


@query(
    _sql(
        f"""SELECT {_KEYS}, {_r('coalesce(y, lv + (nv - lv) * (t_ix - lt) / nullif(nt - lt, 0), lv, nv)')} AS y FROM (SELECT *,
        last_value(CASE WHEN y IS NOT NULL THEN t_ix END IGNORE NULLS) OVER a AS lt, last_value(y IGNORE NULLS) OVER a AS lv,
        first_value(CASE WHEN y IS NOT NULL THEN t_ix END IGNORE NULLS) OVER b AS nt, first_value(y IGNORE NULLS) OVER b AS nv FROM grid
        WINDOW a AS ({_BY_T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({_BY_T} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        "days",
    )
)
def interpolate_index(spark, sf_dir):
    return _out(P.interpolated_by_index(T.user_days(spark, sf_dir), "y"), "unit_ix", "t_ix", y="y")


@query(
    _sql(
        f"""SELECT CAST(unit_ix AS BIGINT) AS unit_ix, CAST(d AS DATE) AS month, {_r('coalesce(v, lv + (nv - lv) * (d - ld) / nullif(nd - ld, 0), lv)')} AS total FROM (
        SELECT unit_ix, d, v, last_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER a AS ld, last_value(v IGNORE NULLS) OVER a AS lv,
        first_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER b AS nd, first_value(v IGNORE NULLS) OVER b AS nv
        FROM (SELECT m.unit_ix, CAST(m.d AS DATE) AS d, annual.total AS v FROM (SELECT unit_ix, unnest(generate_series(make_date(min(year), 1, 1), make_date(max(year), 12, 1), INTERVAL 1 MONTH)) AS d FROM annual GROUP BY 1) m
        LEFT JOIN annual ON annual.unit_ix = m.unit_ix AND CAST(m.d AS DATE) = make_date(annual.year, 7, 1))
        WINDOW a AS (PARTITION BY unit_ix ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY unit_ix ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        "annual",
    )
)
def interpolate_time(spark, sf_dir):
    return _out(P.interpolated_by_days(T.annual_nation(spark, sf_dir), "total"), "unit_ix", "month", total="total")


@query(_sql(f"SELECT CAST(unit_ix AS BIGINT) AS unit_ix, make_date(year + 1, m, 1) AS month, {_r('total')} AS total FROM annual CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS m)", "annual"))
def annual_to_monthly_step(spark, sf_dir):
    return _out(P.annual_to_monthly_step(T.annual_nation(spark, sf_dir), "total"), "unit_ix", "month", total="total")


@query(_sql("SELECT m, count(*) AS n, count(DISTINCT unit_ix) AS units FROM annual CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS BIGINT) AS m) GROUP BY m", "annual"))
def cross_months(spark, sf_dir):
    return P.annual_to_monthly_step(T.annual_nation(spark, sf_dir), "total").groupBy(F.month("month").cast("long").alias("m")).agg(F.count("*").alias("n"), F.countDistinct("unit_ix").alias("units"))


@query(_sql(f"SELECT {_KEYS}, {_r('y - (avg(y) OVER (PARTITION BY unit_ix, t_ix % 12) - avg(y) OVER (PARTITION BY unit_ix))')} AS y FROM panel", "panel"))
def deseasonalize(spark, sf_dir):
    df = T.complete_shipments(spark, sf_dir)
    return _out(df.withColumn("y", P.deseasonalized(df, "y", F.col("t_ix") % 12)), "unit_ix", "t_ix", y="y")


@query(_sql(f"SELECT {_KEYS}, {_r('(y - avg(y) OVER (PARTITION BY unit_ix)) / coalesce(nullif(stddev_pop(y) OVER (PARTITION BY unit_ix), 0), 1)')} AS y FROM panel", "panel"))
def standardize_unit(spark, sf_dir):
    return _out(T.complete_shipments(spark, sf_dir).withColumn("y", P.standardized("y")), "unit_ix", "t_ix", y="y")


@query(
    _sql(
        f"SELECT {_KEYS}, {_r('(c - (SELECT avg(c) FROM w)) / (SELECT stddev_pop(c) FROM w)')} AS x FROM w",
        "panel",
        "w AS (SELECT unit_ix, t_ix, least(greatest(x, (SELECT quantile_cont(x, 0.01) FROM panel)), (SELECT quantile_cont(x, 0.99) FROM panel)) AS c FROM panel)",
    )
)
def winsorize_zscore(spark, sf_dir):
    return _out(P.winsorized_zscore(T.complete_shipments(spark, sf_dir), "x"), "unit_ix", "t_ix", x="x")


@query(_sql(f"SELECT CAST(unit_ix AS BIGINT) AS unit_ix, CASE WHEN m > (SELECT median(m) FROM u) THEN 'high' ELSE 'low' END AS grp, {_r('m')} AS unit_mean FROM u", "panel", "u AS (SELECT unit_ix, avg(y) AS m FROM panel GROUP BY 1)"))
def median_split(spark, sf_dir):
    return _out(P.median_split(T.complete_shipments(spark, sf_dir), "y"), "unit_ix", "grp", unit_mean="unit_mean")


@query(_sql(f"SELECT {_KEYS}, {_r(f'y / nullif(lag(y, 12) OVER ({_BY_T}), 0) - 1')} AS growth FROM panel", "panel"))
def pct_change(spark, sf_dir):
    return _out(T.complete_shipments(spark, sf_dir).withColumn("growth", P.pct_change("y", 12)), "unit_ix", "t_ix", growth="growth")


@query(f"SELECT CAST(s_nationkey AS BIGINT) AS nation, {_r('1000 * sum(CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END) / nullif(count(*), 0)')} AS per_1000 FROM supplier GROUP BY 1")
def per_capita(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum((F.col("s_acctbal") > 5000).cast("int")).alias("k"), F.count("*").alias("n"))
    return _out(s, "nation", per_1000=1000 * F.try_divide("k", "n"))


_WINS = "SELECT user_id, CAST(ts AS DATE) AS d, event_id, {} AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id {}) AS k FROM events) WHERE k = 1"


@query(_WINS.format(_r("value"), "DESC"))
def last_wins(spark, sf_dir):
    e = T.table(spark, sf_dir, "events", "user_id", "ts", "event_id", "value").withColumn("d", F.to_date("ts"))
    return _out(P.last_wins(e, ["user_id", "d"], "event_id"), "user_id", "d", "event_id", value="value")


@query(_WINS.format(_r("value"), "ASC"))
def first_wins(spark, sf_dir):
    e = T.table(spark, sf_dir, "events", "user_id", "ts", "event_id", "value").withColumn("d", F.to_date("ts"))
    return _out(P.first_wins(e, ["user_id", "d"], "event_id"), "user_id", "d", "event_id", value="value")


@query("SELECT p_partkey, CASE WHEN k > 1 THEN p_type || ' #' || k ELSE p_type END AS name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)")
def numbered_duplicates(spark, sf_dir):
    p = T.table(spark, sf_dir, "part", "p_partkey", "p_type")
    return p.select("p_partkey", P.numbered_duplicates(p, "p_type", "p_partkey").alias("name"))


_FULL_NAME = "n_name || '-' || r_name || ', ' || upper(substr(n_name, 1, 2)) || '-' || upper(substr(r_name, 1, 2))"


@query(
    f"SELECT CAST(n_nationkey AS BIGINT) AS nation, lower(trim(regexp_split_to_array(split_part(name, ',', 1), '[-/]')[1])) AS city, lower(trim(split_part(split_part(name, ',', 2), '-', 1))) AS state FROM (SELECT n_nationkey, {_FULL_NAME} AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"
)
def metro_key(spark, sf_dir):
    return _named(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("nation"), S.metro_key(F.col("name")).alias("k")).select("nation", "k.city", "k.state")


def _named(spark, sf_dir) -> DataFrame:
    n, r = T.table(spark, sf_dir, "nation"), T.table(spark, sf_dir, "region")
    code = lambda c: F.upper(F.substring(c, 1, 2))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("name", F.concat("n_name", F.lit("-"), "r_name", F.lit(", "), code("n_name"), F.lit("-"), code("r_name")))


@query()
def stationarize(spark, sf_dir):
    """Units that the unit-root test does not reject are differenced, in logs where positive; others keep their level."""
    df = T.complete_shipments(spark, sf_dir)
    flags = D.adf_statistics(df, "y").select("unit_ix", "unit_root")
    return _out(P.stationarized(df, "y", flags), "unit_ix", "t_ix", y="y")


# --- joins and sets --------------------------------------------------------------------------------

_CROSSWALK = "crosswalk AS (SELECT lower(n_name) AS city, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code FROM nation)"


def _crosswalk(spark, sf_dir) -> DataFrame:
    n = T.table(spark, sf_dir, "nation")
    return n.select(F.lower("n_name").alias("city"), S.padded_code(F.col("n_nationkey"), 5).alias("code"))


@query(_sql(f"SELECT code, CAST(t_ix AS BIGINT) AS t_ix, {_r('x')} AS x FROM nation JOIN crosswalk ON lower(n_name) = city JOIN grid ON unit_ix = n_nationkey WHERE unit_ix IN (SELECT unit_ix FROM grid GROUP BY 1 HAVING count(x) = (SELECT count(*) FROM periods))", "panel", _CROSSWALK))
def join_crosswalk_cov(spark, sf_dir):
    names = T.table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("city"))
    coded = names.join(_crosswalk(spark, sf_dir), "city")
    cov = P.balanced(T.shipments(spark, sf_dir), "x")
    return _out(coded.join(cov, F.col("n_nationkey") == F.col("unit_ix")), "code", "t_ix", x="x")


@query(_sql(f"SELECT CAST(unit_ix AS VARCHAR) AS code, CAST(t_ix AS BIGINT) AS t_ix, {_r('x')} AS x FROM grid JOIN crosswalk ON coalesce(nullif(ltrim(code, '0'), ''), '0') = CAST(unit_ix AS VARCHAR) WHERE x IS NOT NULL", "panel", _CROSSWALK))
def join_code_cov(spark, sf_dir):
    bare = _crosswalk(spark, sf_dir).select(F.when(S.bare_code(F.col("code")) == "", "0").otherwise(S.bare_code(F.col("code"))).alias("code"))
    cov = T.shipments(spark, sf_dir).where("x is not null").withColumn("code", F.col("unit_ix").cast("string"))
    return _out(cov.join(bare, "code"), "code", "t_ix", x="x")


@query(_sql("SELECT CAST(c.c_custkey AS BIGINT) AS c_custkey, coalesce(k.code, '') AS code FROM customer c LEFT JOIN crosswalk k ON lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') = k.code", _CROSSWALK))
def join_codes(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumn("code", S.padded_code(F.col("c_nationkey"), 5))
    k = _crosswalk(spark, sf_dir).select("code", F.col("code").alias("found"))
    return c.join(k, "code", "left").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.coalesce("found", F.lit("")).alias("code"))


@query(_sql(f"SELECT {_KEYS}, {_r('o.y')} AS permits, {_r('x')} AS x, {_r('q')} AS q FROM (SELECT unit_ix, t_ix, y FROM grid) o LEFT JOIN (SELECT unit_ix, t_ix, x FROM grid WHERE x IS NOT NULL) USING (unit_ix, t_ix) LEFT JOIN (SELECT unit_ix, t_ix, q FROM grid WHERE q IS NOT NULL) USING (unit_ix, t_ix)", "panel"))
def left_join_covariates(spark, sf_dir):
    g = T.shipments(spark, sf_dir)
    keys = ["unit_ix", "t_ix"]
    out = g.select(*keys, F.col("y").alias("permits")).join(g.where("x IS NOT NULL").select(*keys, "x"), keys, "left").join(g.where("q IS NOT NULL").select(*keys, "q"), keys, "left")
    return _out(out, *keys, permits="permits", x="x", q="q")


@query(_sql("SELECT CAST(unit_ix AS BIGINT) AS unit_ix, count(x) = (SELECT count(*) FROM periods) AS complete FROM grid GROUP BY 1", "panel"))
def complete_match_mask(spark, sf_dir):
    g = T.shipments(spark, sf_dir)
    periods = g.agg(F.countDistinct("t_ix").alias("periods"))
    return g.groupBy(F.col("unit_ix").cast("long").alias("unit_ix")).agg(F.count("x").alias("n")).crossJoin(F.broadcast(periods)).select("unit_ix", (F.col("n") == F.col("periods")).alias("complete"))


@query(f"SELECT tier, c_nationkey::BIGINT AS nation, count(*) AS n, {_r('sum(c_acctbal)', 2)} AS total FROM (SELECT 'top' AS tier, c_nationkey, c_acctbal FROM customer WHERE c_acctbal >= 4500 UNION ALL SELECT 'bottom', c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 4500) GROUP BY 1, 2")
def union_tiers(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal")
    both = c.where("c_acctbal >= 4500").withColumn("tier", F.lit("top")).unionByName(c.where("c_acctbal < 4500").withColumn("tier", F.lit("bottom")))
    return _out(both.groupBy("tier", F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")), "tier", "nation", "n", digits=2, total="total")


@query("SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
def intersect_regions(spark, sf_dir):
    a = T.table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("nation"))
    return a.intersect(T.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long")))


@query("SELECT count(*) AS n, CAST(min(c_custkey) AS BIGINT) AS first_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def except_done(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer", "c_custkey").select(F.lit("c").alias("config"), F.col("c_custkey").alias("rep"))
    done = T.table(spark, sf_dir, "orders", "o_custkey").select(F.lit("c").alias("config"), F.col("o_custkey").alias("rep"))
    return M.unfinished(c, done).agg(F.count("*").alias("n"), F.min("rep").alias("first_key"))


@query("SELECT a.range AS r1, b.range AS r2, c.range AS r3, a.range * (183 - a.range) + b.range * (183 - b.range) + c.range * (183 - c.range) AS dimension FROM range(3) a CROSS JOIN range(3) b CROSS JOIN range(3) c")
def rank_box(spark, sf_dir):
    axis = lambda n: spark.range(3).select(F.col("id").alias(n))
    box = axis("r1").crossJoin(axis("r2")).crossJoin(axis("r3"))
    return box.select("r1", "r2", "r3", S.effective_dim(F.array("r1", "r2", "r3"), F.lit(100), F.lit(83)).alias("dimension"))


_LOSS = "(100 - 10 * r1 - 5 * r2 + 3 * r3 * r3) + 0.01 * dimension"
_BOX = "box AS (SELECT a.range AS r1, b.range AS r2, c.range AS r3, a.range * (183 - a.range) + b.range * (183 - b.range) + c.range * (183 - c.range) AS dimension FROM range(3) a CROSS JOIN range(3) b CROSS JOIN range(3) c)"


def _criteria(spark, sf_dir) -> DataFrame:
    return rank_box(spark, sf_dir).withColumn("criterion", F.expr(_LOSS).cast("double")).withColumn("ranks", F.array("r1", "r2", "r3"))


@query(_sql(f"SELECT r1, r2, r3, {_r(f'CAST({_LOSS} AS DOUBLE)')} AS criterion FROM box ORDER BY {_LOSS}, dimension, r1, r2, r3 LIMIT 8", _BOX))
def rank_top_k(spark, sf_dir):
    return _out(_criteria(spark, sf_dir).orderBy("criterion", "dimension", "ranks").limit(8), "r1", "r2", "r3", criterion="criterion")


@query(_sql(f"SELECT r1, r2, r3, {_r(f'CAST({_LOSS} AS DOUBLE)')} AS criterion FROM box ORDER BY {_LOSS}, dimension, r1, r2, r3 LIMIT 1", _BOX))
def rank_argmin(spark, sf_dir):
    return _out(M.argmin_rank(_criteria(spark, sf_dir)), "r1", "r2", "r3", criterion="criterion")


@query(_sql(f"SELECT r1 + r2 + r3 AS total, {_r('sum(CAST(dimension AS DOUBLE) / 1000)')} AS loss FROM box GROUP BY 1", _BOX))
def cv_loss(spark, sf_dir):
    return _out(_criteria(spark, sf_dir).groupBy((F.col("r1") + F.col("r2") + F.col("r3")).alias("total")).agg(F.sum(F.col("dimension") / 1000.0).alias("loss")), "total", loss="loss")


@query(f"SELECT CAST(l_returnflag AS VARCHAR) AS flag, CAST(year(l_shipdate) AS BIGINT) AS year, {_r('coalesce(sum(l_tax), 0)', 4)} AS total FROM lineitem GROUP BY 1, 2")
def group_sum(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem", "l_returnflag", "l_shipdate", "l_tax")
    return _out(li.groupBy(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year")).agg(F.coalesce(F.sum("l_tax"), F.lit(0.0)).alias("total")), "flag", "year", digits=4, total="total")


@query(_sql(f"SELECT CAST(t_ix AS BIGINT) AS t_ix, {_r('avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing FROM grid GROUP BY 1", "days"))
def missing_share(spark, sf_dir):
    cells = T.user_day_cells(spark, sf_dir)
    units = cells.agg(F.countDistinct("unit_ix").alias("units"))
    by_day = cells.groupBy("t_ix").agg(F.count("y").alias("n")).crossJoin(F.broadcast(units))  # one row
    return _out(by_day.select("t_ix", (1 - F.col("n") / F.col("units")).alias("missing")), "t_ix", missing="missing")


@query(_sql(f"SELECT CAST(unit_ix AS BIGINT) AS unit_ix, {_r('avg(y)')} AS level, {_r('stddev_pop(y)')} AS vol FROM grid GROUP BY 1", "days"))
def unit_mean_level(spark, sf_dir):
    return _out(T.user_day_cells(spark, sf_dir).groupBy("unit_ix").agg(F.avg("y").alias("level"), F.stddev_pop("y").alias("vol")), "unit_ix", level="level", vol="vol")


# --- design and folds ------------------------------------------------------------------------------


@query(_sql(f"SELECT {_KEYS}, {_r('y')} AS y, {_r('l1')} AS lag1, {_r('l2')} AS lag2, {_r('lx')} AS x FROM (SELECT unit_ix, t_ix, y, lag(y) OVER ({_BY_T}) AS l1, lag(y, 2) OVER ({_BY_T}) AS l2, lag(x) OVER ({_BY_T}) AS lx, row_number() OVER ({_BY_T}) AS k FROM panel) WHERE k > 2", "panel"))
def build_ar2(spark, sf_dir):
    return _out(P.with_ar_design(T.complete_shipments(spark, sf_dir), "y", 2, ["x"]), "unit_ix", "t_ix", y="y", lag1="lag1", lag2="lag2", x="x")


@query(_sql(f"SELECT {_KEYS}, CAST(b AS BIGINT) AS block, {_r('CASE b WHEN 0 THEN x WHEN 1 THEN q ELSE 1.0 END')} AS z FROM panel CROSS JOIN (SELECT unnest([0, 1, 2]) AS b)", "panel"))
def build_blocks(spark, sf_dir):
    return _out(L.with_blocks(T.complete_shipments(spark, sf_dir), ["x", "q"]).select("unit_ix", "t_ix", F.posexplode("z").alias("block", "z")), "unit_ix", "t_ix", "block", z="z")


@query(_sql(f"SELECT {_KEYS}, CAST((t_ix + unit_ix) % 6 AS BIGINT) AS fold FROM panel", "panel"))
def folds_checker(spark, sf_dir):
    return _out(FD.checker(T.complete_shipments(spark, sf_dir), 6), "unit_ix", "t_ix", "fold")


@query(_sql(f"SELECT {_KEYS}, CAST(least(floor(t_ix * 6 / (SELECT count(*) FROM periods)), 5) AS BIGINT) AS fold FROM panel", "panel"))
def folds_contiguous(spark, sf_dir):
    df = T.complete_shipments(spark, sf_dir)
    t = df.agg(F.countDistinct("t_ix").alias("n")).first()[0]
    return _out(FD.contiguous(df, 6, t), "unit_ix", "t_ix", "fold")


def _purge_sql(q: int, r: int) -> str:
    return f"""folds AS (SELECT unit_ix, t_ix, (t_ix * t_ix + 3 * unit_ix) % 12 AS fold FROM panel), ids AS (SELECT unnest(range(12)) AS j),
    masks AS (SELECT j, f.t_ix, f.unit_ix, f.fold = j AS is_val, NOT EXISTS (SELECT 1 FROM folds h WHERE h.fold = ids.j AND h.t_ix BETWEEN f.t_ix - {q} AND f.t_ix AND h.unit_ix BETWEEN f.unit_ix - {r} AND f.unit_ix + {r}) AS is_train FROM folds f CROSS JOIN ids)"""


def _masks(spark, sf_dir, q: int, r: int) -> DataFrame:
    cells = T.complete_shipments(spark, sf_dir).select("unit_ix", "t_ix").withColumn("fold", F.pmod(F.col("t_ix") * F.col("t_ix") + 3 * F.col("unit_ix"), F.lit(12)))
    return FD.purged(cells, 12, q, r)


@query(_sql(f"SELECT CAST(j AS BIGINT) AS j, {_KEYS}, is_val, is_train FROM masks", "panel", _purge_sql(3, 0)))
def forward_purge(spark, sf_dir):
    return _out(_masks(spark, sf_dir, 3, 0), "j", "unit_ix", "t_ix", "is_val", "is_train")


@query(_sql(f"SELECT CAST(j AS BIGINT) AS j, {_KEYS}, is_val, is_train FROM masks", "panel", _purge_sql(2, 1)))
def forward_purge_spatial(spark, sf_dir):
    return _out(_masks(spark, sf_dir, 2, 1), "j", "unit_ix", "t_ix", "is_val", "is_train")


@query(_sql(f"SELECT CAST(j AS BIGINT) AS j, CAST(sum(is_train::INT) AS BIGINT) AS n_train, {_r('avg(is_val::INT)')} AS p, {_r('count(*) / greatest(sum(is_train::INT), 1)')} AS alpha FROM masks GROUP BY 1", "panel", _purge_sql(3, 0)))
def fold_meta(spark, sf_dir):
    return _out(FD.fold_meta(_masks(spark, sf_dir, 3, 0)), "j", "n_train", p="p", alpha="alpha")


@query(_sql("SELECT CAST(j AS BIGINT) AS j, min(s) AS min_support FROM (SELECT j, t_ix, CAST(sum(is_train::INT) AS BIGINT) AS s FROM masks GROUP BY 1, 2) GROUP BY 1", "panel", _purge_sql(3, 0)))
def min_row_support(spark, sf_dir):
    return _out(FD.least_row_support(_masks(spark, sf_dir, 3, 0)), "j", "min_support")


@query(f"SELECT j.range AS j, q.range AS q, r.range AS r, {_r('pow(1 - 1.0 / j.range, (q.range + 1) * (2 * r.range + 1))')} AS share FROM range(4, 13) j CROSS JOIN range(9) q CROSS JOIN range(3) r")
def retained_share(spark, sf_dir):
    axis = lambda n, a, b: spark.range(a, b).select(F.col("id").alias(n))
    g = axis("j", 4, 13).crossJoin(axis("q", 0, 9)).crossJoin(axis("r", 0, 3))
    return _out(g, "j", "q", "r", share=S.retained_share(F.col("j"), F.col("q"), F.col("r")))


# --- linear map ------------------------------------------------------------------------------------

# The root keeps products of round inputs away from ties at the sixth digit.
_THETA = "((5 + t_ix % 5) / 10.0 * sqrt(CAST(2 AS DOUBLE))) AS th0, ((2 - unit_ix % 3) / 10.0 * sqrt(CAST(2 AS DOUBLE))) AS th1, ((5 * (t_ix % 7)) / 100.0) AS th2, ((t_ix * 7 + unit_ix * 2) % 11 - 5) / 10.0 AS r"


def _cells(spark, sf_dir) -> DataFrame:
    t, i = F.col("t_ix"), F.col("unit_ix")
    df = L.with_blocks(T.complete_shipments(spark, sf_dir), ["x", "q"])
    root = F.sqrt(F.lit(2.0))
    theta = F.array((5 + t % 5) / 10.0 * root, (2 - i % 3) / 10.0 * root, (5 * (t % 7)) / 100.0)
    return df.withColumn("theta", theta).withColumn("r", (F.pmod(t * 7 + i * 2, F.lit(11)) - 5) / 10.0).withColumn("is_train", (t + i) % 4 != 0)


@query(_sql(f"SELECT {_KEYS}, {_r('x * th0 + q * th1 + th2')} AS fitted FROM (SELECT *, {_THETA} FROM panel)", "panel"))
def design_apply(spark, sf_dir):
    return _out(L.design_apply(_cells(spark, sf_dir)), "unit_ix", "t_ix", fitted="fitted")


@query(_sql(f"SELECT {_KEYS}, CAST(b AS BIGINT) AS block, {_r('r * CASE b WHEN 0 THEN x WHEN 1 THEN q ELSE 1 END')} AS value FROM (SELECT *, {_THETA} FROM panel) CROSS JOIN (SELECT unnest([0, 1, 2]) AS b)", "panel"))
def design_adjoint(spark, sf_dir):
    return _out(L.design_adjoint(_cells(spark, sf_dir)), "unit_ix", "t_ix", "block", value="value")


@query(_sql(f"SELECT {_r('sum(r * (x * th0 + q * th1 + th2))', 5)} AS inner_product FROM (SELECT *, {_THETA} FROM panel)", "panel"))
def theta_dot(spark, sf_dir):
    c = _cells(spark, sf_dir)
    theta = c.select("t_ix", "unit_ix", F.posexplode("theta").alias("block", "value"))
    return _out(L.theta_dot(L.design_adjoint(c), theta), digits=5, inner_product="inner_product")


_GRAMS = "round(sum(m * d0 * d0), 5) + 0.0 AS g00, round(sum(m * d0 * d1), 5) + 0.0 AS g01, round(sum(m * d1 * d1), 5) + 0.0 AS g11, round(sum(m * d0 * y), 4) + 0.0 AS b0, round(sum(m * d1 * y), 4) + 0.0 AS b1"
_FACTOR = "factored AS (SELECT *, CAST((t_ix + unit_ix) % 4 <> 0 AS INT) AS m, x * (1 + 0.1 * (unit_ix % 4)) AS d0, CAST(1 - 0.05 * (t_ix % 6) AS DOUBLE) AS d1 FROM panel)"


def _factored(spark, sf_dir) -> DataFrame:
    return _cells(spark, sf_dir).withColumn("d0", F.col("x") * (1 + 0.1 * (F.col("unit_ix") % 4))).withColumn("d1", 1 - 0.05 * (F.col("t_ix") % 6))


def _gram(spark, sf_dir, by):
    g = L.gram(_factored(spark, sf_dir), by, ["d0", "d1"])
    return g.select(F.col(by).cast("long").alias(by), *[S.rounded(F.col(c), 5).alias(c) for c in ("g00", "g01", "g11")], *[S.rounded(F.col(c), 4).alias(c) for c in ("b0", "b1")])


@query(_sql(f"SELECT CAST(t_ix AS BIGINT) AS t_ix, {_GRAMS} FROM factored GROUP BY 1", "panel", _FACTOR))
def als_row_gram(spark, sf_dir):
    return _gram(spark, sf_dir, "t_ix")


@query(_sql(f"SELECT CAST(unit_ix AS BIGINT) AS unit_ix, {_GRAMS} FROM factored GROUP BY 1", "panel", _FACTOR))
def als_col_gram(spark, sf_dir):
    return _gram(spark, sf_dir, "unit_ix")


@query(_sql(f"SELECT {_r('0.5 * (SELECT sum(CASE WHEN (t_ix + unit_ix) % 4 <> 0 THEN pow(y - (x * th0 + q * th1 + th2), 2) ELSE 0 END) FROM c) + 0.01 * ((SELECT sum(pow(0.1 * (t_ix % 5), 2)) FROM periods) + (SELECT sum(pow(0.2 * (unit_ix % 3), 2)) FROM units))', 3)} AS objective", "panel", f"c AS (SELECT *, {_THETA} FROM panel)"))
def objective(spark, sf_dir):
    c = L.design_apply(_cells(spark, sf_dir))
    f = c.select("t_ix").distinct().select((0.1 * (F.col("t_ix") % 5)).alias("v"))
    lam = c.select("unit_ix").distinct().select((0.2 * (F.col("unit_ix") % 3)).alias("v"))
    return _out(L.objective(c, f, lam, 0.02), digits=3, objective="objective")


@query(
    _sql(
        f"""SELECT {_KEYS}, {_r('u * ux + xv * v - u * uxv * v')} AS value FROM c JOIN (SELECT unit_ix, sum(u * y) AS ux FROM c GROUP BY 1) USING (unit_ix)
        JOIN (SELECT t_ix, sum(y * v) AS xv FROM c GROUP BY 1) USING (t_ix) CROSS JOIN (SELECT sum(u * y * v) AS uxv FROM c)""",
        "panel",
        "un AS (SELECT t_ix, 1 + t_ix % 3 AS a FROM periods), vn AS (SELECT unit_ix, 2 - unit_ix % 2 AS b FROM units), c AS (SELECT t_ix, unit_ix, y, a / sqrt((SELECT sum(a * a) FROM un)) AS u, b / sqrt((SELECT sum(b * b) FROM vn)) AS v FROM panel JOIN un USING (t_ix) JOIN vn USING (unit_ix))",
    )
)
def tangent_project(spark, sf_dir):
    df = T.complete_shipments(spark, sf_dir)

    def unit_norm(key: str, raw, name: str) -> DataFrame:
        base = df.select(key).distinct().withColumn("a", raw)
        norm = base.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm"))
        return base.crossJoin(F.broadcast(norm)).select(key, (F.col("a") / F.col("norm")).alias(name))

    u = unit_norm("t_ix", 1 + F.col("t_ix") % 3, "u")
    v = unit_norm("unit_ix", 2 - F.col("unit_ix") % 2, "v")
    return _out(L.tangent_project(df.select("t_ix", "unit_ix", F.col("y").alias("value")), u, v), "unit_ix", "t_ix", value="value")


# --- regressions -----------------------------------------------------------------------------------


def _within_sql(lags: int) -> str:
    names = ["y", *[f"l{k}" for k in range(1, lags + 1)]]
    lagged = ", ".join(f"lag(y, {k}) OVER ({_BY_T}) AS l{k}" for k in range(1, lags + 1))
    demeaned = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY unit_ix) - avg({c}) OVER (PARTITION BY t_ix) + avg({c}) OVER () AS {c}" for c in names)
    return f"ar AS (SELECT * FROM (SELECT unit_ix, t_ix, y, {lagged}, row_number() OVER ({_BY_T}) AS k FROM (SELECT unit_ix, t_ix, coalesce(y, 0) AS y FROM grid)) WHERE k > {lags}), w AS (SELECT {demeaned} FROM ar)"


@query(_sql(f"SELECT {_r('xy / xx')} AS beta1, {_r('xy / xx')} AS beta_sum, {_r('sqrt((yy - xy * xy / xx) / n)')} AS rmse, {_r('xy * xy / xx / yy')} AS r2, n AS n_cells FROM (SELECT sum(l1 * l1) AS xx, sum(l1 * y) AS xy, sum(y * y) AS yy, count(*) AS n FROM w)", "orders", _within_sql(1)))
def two_way_fe_ar1(spark, sf_dir):
    out = P.two_way_ar(T.orders_monthly(spark, sf_dir).fillna(0.0, ["y"]), "y", 1)
    return _out(out, "n_cells", beta1="beta1", beta_sum="beta_sum", rmse="rmse", r2="r2")


@query(
    _sql(
        f"SELECT {_r('b1')} AS beta1, {_r('b2')} AS beta2, {_r('b1 + b2')} AS beta_sum, {_r('sqrt((yy - b1 * xy - b2 * zy) / n)')} AS rmse, {_r('(b1 * xy + b2 * zy) / yy')} AS r2, n AS n_cells FROM (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM (SELECT sum(l1 * l1) AS xx, sum(l2 * l2) AS zz, sum(l1 * l2) AS xz, sum(l1 * y) AS xy, sum(l2 * y) AS zy, sum(y * y) AS yy, count(*) AS n FROM w))",
        "orders",
        _within_sql(2),
    )
)
def two_way_fe_ar2(spark, sf_dir):
    out = P.two_way_ar(T.orders_monthly(spark, sf_dir).fillna(0.0, ["y"]), "y", 2)
    return _out(out, "n_cells", beta1="beta1", beta2="beta2", beta_sum="beta_sum", rmse="rmse", r2="r2")


# --- inference -------------------------------------------------------------------------------------


def _scores(spark, sf_dir) -> tuple[DataFrame, int]:
    df = T.complete_shipments(spark, sf_dir)
    return T.score_table(df), df.count()


@query(_sql(f"SELECT target, {_r('sqrt(greatest(sum(psi * psi * u * u), pow((SELECT n FROM size), -2)))')} AS se FROM scores GROUP BY 1", "panel", _SCORES))
def white_se(spark, sf_dir):
    return _out(I.white_se(*_scores(spark, sf_dir)), "target", se="se")


@query(_sql(f"SELECT target, {_r('sqrt(greatest(sum(s * s), pow((SELECT n FROM size), -2)))')} AS se FROM (SELECT target, t_ix, sum(psi * u) AS s FROM scores GROUP BY 1, 2) GROUP BY 1", "panel", _SCORES))
def cluster_se(spark, sf_dir):
    return _out(I.cluster_se(*_scores(spark, sf_dir)), "target", se="se")


@query(_sql(f"SELECT a.target, {_r('sqrt(greatest(sum((1 - abs(a.unit_ix - b.unit_ix) / 5.0) * a.psi * a.u * b.psi * b.u), pow((SELECT n FROM size), -2)))')} AS se FROM scores a JOIN scores b ON a.target = b.target AND a.t_ix = b.t_ix AND abs(a.unit_ix - b.unit_ix) < 5 GROUP BY 1", "panel", _SCORES))
def bartlett_se(spark, sf_dir):
    return _out(I.bartlett_se(*_scores(spark, sf_dir), 5), "target", se="se")


_COORDS = "coords AS (SELECT unit_ix, 25.0 + (unit_ix * 7) % 23 AS lat, -120.0 + (unit_ix * 13) % 47 AS lon FROM units), km AS (SELECT a.unit_ix AS i, b.unit_ix AS j, 2 * 6371.0088 * asin(sqrt(least(1, greatest(0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))) AS km FROM coords a CROSS JOIN coords b)"


def distance_pairs(points: DataFrame, most_km: float) -> DataFrame:
    """(i, j, km) within ``most_km``. Points meet only in their own and the neighbouring cells, so the pairs grow
    with the neighbours, not with the square of the points. Cells are bands of latitude, cut by longitude into
    pieces at least as wide as ``most_km`` reaches anywhere in the band and those beside it; where these come
    within 15 degrees of a pole, a band is one cell."""
    band = most_km / 111.0
    row = lambda lat: F.floor(F.col(lat) / band)
    edge = lambda r: F.greatest(F.abs(r - 1), F.abs(r + 2)) * band
    reach = lambda r: F.sin(F.radians(F.lit(band / 2))) / F.cos(F.radians(F.least(edge(r), F.lit(75.0))))
    wide = lambda r: F.when(edge(r) < 75, F.degrees(2 * F.asin(F.least(reach(r), F.lit(1.0)))))
    count = lambda r: F.coalesce(F.floor(360 / wide(r)), F.lit(1))
    col = lambda lon, r: F.pmod(F.floor(F.pmod(F.col(lon), F.lit(360.0)) / 360 * count(r)), count(r))
    a = points.select(F.col("unit_ix").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), row("lat").alias("row"))
    a = a.withColumn("col", col("lon1", F.col("row")))
    b = points.select(F.col("unit_ix").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.array(*[row("lat") + k for k in (-1, 0, 1)])).alias("row"))
    near = F.array_distinct(F.array(*[F.pmod(col("lon2", F.col("row")) + k, count(F.col("row"))) for k in (-1, 0, 1)]))
    b = b.withColumn("col", F.explode(near))
    km = S.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, ["row", "col"]).withColumn("km", km).where(F.col("km") < most_km).select("i", "j", "km")


@query(_sql(f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_r('km', 4)} AS km FROM km WHERE km < 1500", "panel", _COORDS))
def haversine(spark, sf_dir):
    return _out(distance_pairs(T.coordinates(T.complete_shipments(spark, sf_dir)), 1500.0), "i", "j", digits=4, km="km")


@query(_sql(f"SELECT a.target, {_r('sqrt(greatest(sum((1 - km / 1500) * a.psi * a.u * b.psi * b.u), pow((SELECT n FROM size), -2)))')} AS se FROM scores a JOIN km ON km.i = a.unit_ix AND km < 1500 JOIN scores b ON b.unit_ix = km.j AND a.target = b.target AND a.t_ix = b.t_ix GROUP BY 1", "panel", _SCORES, _COORDS))
def conley_se(spark, sf_dir):
    table, n = _scores(spark, sf_dir)
    pairs = distance_pairs(T.coordinates(T.complete_shipments(spark, sf_dir)), 1500.0).withColumn("w", 1 - F.col("km") / 1500.0)
    return _out(I.conley_se(table, pairs, n), "target", se="se")


@query(_sql(" UNION ALL ".join(f"SELECT a.target, CAST({b} AS BIGINT) AS km, {_r(f'sqrt(greatest(sum((1 - km / {b}.0) * a.psi * a.u * b.psi * b.u), pow((SELECT n FROM size), -2)))')} AS se FROM scores a JOIN km ON km.i = a.unit_ix AND km < {b} JOIN scores b ON b.unit_ix = km.j AND a.target = b.target AND a.t_ix = b.t_ix GROUP BY 1" for b in (300, 600)), "panel", _SCORES, _COORDS))
def geographic_se(spark, sf_dir):
    """Standard errors under a triangular kernel of 300 and of 600 km."""
    table, n = _scores(spark, sf_dir)
    points = T.coordinates(T.complete_shipments(spark, sf_dir))
    frames = [I.conley_se(table, distance_pairs(points, b).withColumn("w", 1 - F.col("km") / b), n).withColumn("km", F.lit(int(b))) for b in (300.0, 600.0)]
    return _out(union_of(frames), "target", "km", se="se")


_AB = "ab AS (SELECT a.t_ix, a.unit_ix, a.psi * a.u AS va, b.psi * b.u AS vb FROM scores a JOIN scores b USING (t_ix, unit_ix) WHERE a.target = 'a' AND b.target = 'b')"


@query(_sql(f"SELECT {_r('sum(va * vb)', 5)} AS cov FROM ab", "panel", _SCORES, _AB))
def joint_cov(spark, sf_dir):
    return _out(I.joint_cov(_scores(spark, sf_dir)[0], "a", "b"), digits=5, cov="cov")


@query(_sql(f"SELECT {_r('sum(sa * sb)', 5)} AS cov FROM (SELECT sum(va) AS sa, sum(vb) AS sb FROM ab GROUP BY t_ix)", "panel", _SCORES, _AB))
def joint_cov_xs(spark, sf_dir):
    return _out(I.joint_cov_cluster(_scores(spark, sf_dir)[0], "a", "b"), digits=5, cov="cov")


@query(_sql(f"SELECT {_r('sum((1 - abs(x.unit_ix - y.unit_ix) / 5.0) * x.va * y.vb)', 5)} AS cov FROM ab x JOIN ab y ON x.t_ix = y.t_ix AND abs(x.unit_ix - y.unit_ix) < 5", "panel", _SCORES, _AB))
def joint_cov_bartlett(spark, sf_dir):
    return _out(I.joint_cov_bartlett(_scores(spark, sf_dir)[0], "a", "b", 5), digits=5, cov="cov")


@query(_sql(f"SELECT target, {_r('plugin', 5)} AS plugin, {_r('plugin + c', 5)} AS estimate FROM (SELECT target, sum(psi * u) AS c FROM scores GROUP BY 1) JOIN (SELECT t AS target, sum((j + 1) / 21.0 * (j * 0.1 + CASE t WHEN 'a' THEN 0.2 ELSE 0.4 END)) AS plugin FROM (SELECT unnest(range(6)) AS j) CROSS JOIN (SELECT unnest(['a', 'b']) AS t) GROUP BY 1) USING (target)", "panel", _SCORES))
def one_step_assembly(spark, sf_dir):
    plugs = spark.range(6).select(F.col("id").alias("j"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("target"))
    plugs = plugs.select("j", "target", ((F.col("j") + 1) / 21.0).alias("p"), (F.col("j") * 0.1 + F.when(F.col("target") == "a", 0.2).otherwise(0.4)).alias("plug"))
    return _out(I.one_step(plugs, _scores(spark, sf_dir)[0]), "target", digits=5, plugin="plugin", estimate="estimate")


# --- dynamics --------------------------------------------------------------------------------------

_COEF = "coef AS (SELECT * FROM (VALUES (1, 0.5, 0.2), (2, 1.25, -0.419), (3, 0.9, 0.0), (4, 0.3, 0.4), (5, -0.6, 0.1)) v(id, a, b))"


def _coefficients(spark) -> DataFrame:
    return spark.createDataFrame([(1, 0.5, 0.2), (2, 1.25, -0.419), (3, 0.9, 0.0), (4, 0.3, 0.4), (5, -0.6, 0.1)], "id long, a double, b double")


@query(_sql(f"SELECT CAST(id AS BIGINT) AS id, h.range AS h, {_r('pow(CAST(a AS DOUBLE), h.range)')} AS irf, {_r('h.range * pow(CAST(a AS DOUBLE), h.range - 1)')} AS gradient FROM coef CROSS JOIN range(1, 13) h", _COEF))
def irf_p1(spark, sf_dir):
    c = _coefficients(spark).crossJoin(spark.range(1, 13).select(F.col("id").alias("h")))
    h, zero = F.col("h").cast("int"), F.lit(0.0)
    return _out(c, "id", "h", irf=S.irf(F.col("a"), zero, h), gradient=S.irf_gradient(F.col("a"), zero, h)["da"])


@query(f"WITH RECURSIVE {_COEF}, walk AS (SELECT id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, 0 AS h, CAST(1 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS p1, CAST(0 AS DOUBLE) AS da, CAST(0 AS DOUBLE) AS da1, CAST(0 AS DOUBLE) AS db, CAST(0 AS DOUBLE) AS db1 FROM coef UNION ALL SELECT id, a, b, h + 1, a * p + b * p1, p, p + a * da + b * da1, da, p1 + a * db + b * db1, db FROM walk WHERE h < 12) SELECT CAST(id AS BIGINT) AS id, CAST(h AS BIGINT) AS h, {_r('p')} AS irf, {_r('da')} AS da, {_r('db')} AS db FROM walk WHERE h > 0")
def irf_p2(spark, sf_dir):
    c = _coefficients(spark).crossJoin(spark.range(1, 13).select(F.col("id").alias("h")))
    a, b, h = F.col("a"), F.col("b"), F.col("h").cast("int")
    g = S.irf_gradient(a, b, h)
    return _out(c, "id", "h", irf=S.irf(a, b, h), da=g["da"], db=g["db"])


@query(_sql(f"SELECT CAST(id AS BIGINT) AS id, {_r('1 / (1 - CAST(a AS DOUBLE))')} AS lrm FROM coef WHERE a < 1", _COEF))
def lrm_p1(spark, sf_dir):
    return _out(_coefficients(spark).where("a < 1"), "id", lrm=S.long_run_multiplier(F.col("a"), F.lit(0.0)))


@query(_sql(f"SELECT CAST(id AS BIGINT) AS id, {_r('1 / (1 - CAST(a AS DOUBLE) - CAST(b AS DOUBLE))')} AS lrm FROM coef", _COEF))
def lrm_p2(spark, sf_dir):
    return _out(_coefficients(spark), "id", lrm=S.long_run_multiplier(F.col("a"), F.col("b")))


@query(_sql(f"SELECT CAST(id AS BIGINT) AS id, {_r('CASE WHEN d >= 0 THEN greatest(abs(a + sqrt(greatest(d, 0))), abs(a - sqrt(greatest(d, 0)))) / 2 ELSE sqrt(-b) END')} AS radius FROM (SELECT id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(a * a + 4 * b AS DOUBLE) AS d FROM coef)", _COEF))
def companion_radius(spark, sf_dir):
    return _out(_coefficients(spark), "id", radius=S.companion_radius(F.col("a"), F.col("b")))


@query(_sql(f"SELECT CAST(id AS BIGINT) AS id, {_r('CAST(a + b AS DOUBLE)')} AS persistence, {_r('sqrt(CAST(0.01 + 2 * -0.004 + 0.02 AS DOUBLE))')} AS se FROM coef", _COEF))
def cumulative_persistence(spark, sf_dir):
    one = F.lit(1.0)
    return _out(_coefficients(spark), "id", persistence=F.col("a") + F.col("b"), se=S.delta_se(one, one, F.lit(0.01), F.lit(-0.004), F.lit(0.02)))


@query(_sql(f"SELECT CAST(id AS BIGINT) AS id, {_r('sqrt(CAST(a * a * 0.01 + 2 * a * b * -0.004 + b * b * 0.02 AS DOUBLE))')} AS se FROM coef", _COEF))
def delta_se(spark, sf_dir):
    return _out(_coefficients(spark), "id", se=S.delta_se(F.col("a"), F.col("b"), F.lit(0.01), F.lit(-0.004), F.lit(0.02)))


_HORIZON = "least(greatest(1, ceil(ln(count(*)))), count(DISTINCT t_ix))"
#: The SQL writes out this many windows; panels of the given tables have far fewer than e^16 cells.
_WINDOWS = 16


@query(
    _sql(
        " UNION ALL ".join(f"SELECT CAST({h} AS BIGINT) AS h, {_r('exp(max(m))')} AS persistence FROM (SELECT avg(l) OVER w AS m, count(l) OVER w AS k FROM s1 WINDOW w AS ({_BY_T} ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)) WHERE k = {h} AND {h} <= (SELECT {_HORIZON} FROM s1)  GROUP BY ALL HAVING count(*) > 0" for h in range(1, _WINDOWS + 1)),
        "panel",
        "s1 AS (SELECT unit_ix, t_ix, ln(greatest(abs(0.1 + CAST((t_ix * 3 + unit_ix) % 9 AS DOUBLE) / 10), 1e-12)) AS l FROM panel)",
    )
)
def persistence_window(spark, sf_dir):
    """Up to the log of the number of cells, rounded up."""
    df = T.complete_shipments(spark, sf_dir).withColumn("a", 0.1 + F.pmod(F.col("t_ix") * 3 + F.col("unit_ix"), F.lit(9)) / 10.0)
    return _out(D.persistence_window(df, "a"), "h", persistence="persistence")


# --- diagnostics -----------------------------------------------------------------------------------


@query(
    _sql(
        " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, round(avg(p / rr), 6) + 0.0 AS autocorr FROM (SELECT sum(r * coalesce(l, 0)) AS p, sum(r * r) AS rr FROM (SELECT unit_ix, r, lag(r, {k}) OVER ({_BY_T}) AS l FROM c) GROUP BY unit_ix)" for k in range(1, 7)),
        "panel",
        "c AS (SELECT unit_ix, t_ix, y - avg(y) OVER (PARTITION BY unit_ix) AS r FROM panel)",
    )
)
def autocorr(spark, sf_dir):
    return _out(D.autocorrelations(T.complete_shipments(spark, sf_dir), "y"), "lag", autocorr="autocorr")


@query(_sql(f"SELECT {_r('avg(c)')} AS avg_corr FROM (SELECT corr(a.y, b.y) AS c FROM panel a JOIN panel b ON a.t_ix = b.t_ix AND a.unit_ix <> b.unit_ix GROUP BY a.unit_ix, b.unit_ix)", "panel"))
def avg_xs_corr(spark, sf_dir):
    return _out(D.average_cross_correlation(T.complete_shipments(spark, sf_dir), "y"), avg_corr="avg_corr")


_QSTAT = f"{_r('avg(y)')} AS mean, {_r('stddev_pop(y)')} AS sd, {_r('quantile_cont(y, 0.05)')} AS q05, {_r('quantile_cont(y, 0.5)')} AS q50, {_r('quantile_cont(y, 0.95)')} AS q95"


@query(_sql(f"SELECT {_QSTAT} FROM panel", "panel"))
def qstats(spark, sf_dir):
    return _out(D.quantile_stats(T.complete_shipments(spark, sf_dir), "y", []), mean="mean", sd="sd", q05="q05", q50="q50", q95="q95")


@query(_sql(f"SELECT grp, {_QSTAT} FROM g GROUP BY 1 UNION ALL SELECT 'all', {_QSTAT} FROM g", "panel", "u AS (SELECT unit_ix, avg(y) AS m FROM panel GROUP BY 1), g AS (SELECT y, CASE WHEN m > (SELECT median(m) FROM u) THEN 'high' ELSE 'low' END AS grp FROM panel JOIN u USING (unit_ix))"))
def heterogeneity(spark, sf_dir):
    df = T.complete_shipments(spark, sf_dir)
    g = df.join(F.broadcast(P.median_split(df, "y")), "unit_ix")
    return _out(D.heterogeneity(g, "y", "grp"), "grp", mean="mean", sd="sd", q05="q05", q50="q50", q95="q95")


@query(_sql("SELECT CAST(b.range AS BIGINT) AS bin, count(x.y) AS n FROM range(40) b LEFT JOIN (SELECT y, least(floor((y - lo) * 40 / (hi - lo)), 39) AS k FROM panel CROSS JOIN (SELECT quantile_cont(y, 0.005) AS lo, quantile_cont(y, 0.995) AS hi FROM panel) WHERE y BETWEEN lo AND hi) x ON x.k = b.range GROUP BY 1", "panel"))
def histogram40(spark, sf_dir):
    return _out(D.histogram(T.complete_shipments(spark, sf_dir), "y"), "bin", "n")


@query(_sql(f"SELECT CAST(t_ix AS BIGINT) AS t_ix, {_r('avg(y)')} AS coef FROM panel GROUP BY 1", "panel"))
def coef_path(spark, sf_dir):
    return _out(T.complete_shipments(spark, sf_dir).groupBy("t_ix").agg(F.avg("y").alias("coef")), "t_ix", coef="coef")


@query(_sql(f"SELECT CAST(unit_ix AS BIGINT) AS unit_ix, {_r('avg(y)')} AS coef FROM panel GROUP BY 1", "panel"))
def coef_by_unit(spark, sf_dir):
    return _out(T.complete_shipments(spark, sf_dir).groupBy("unit_ix").agg(F.avg("y").alias("coef")), "unit_ix", coef="coef")


@query(_sql(f"SELECT {_r('avg(r)')} AS mean, {_r('stddev_pop(r)')} AS sd, {_r('sqrt(avg(r * r))')} AS rmse, {_r('var_pop(r)')} AS variance, {_r('1 - var_pop(r) / var_pop(y)')} AS r2 FROM (SELECT y, y - avg(y) OVER (PARTITION BY unit_ix) AS r FROM panel)", "panel"))
def residual_fit(spark, sf_dir):
    df = T.complete_shipments(spark, sf_dir)
    means = df.groupBy("unit_ix").agg(F.avg("y").alias("m"))
    return _out(D.residual_fit(df.join(means, "unit_ix").withColumn("r", F.col("y") - F.col("m")), "r", "y"), mean="mean", sd="sd", rmse="rmse", variance="variance", r2="r2")


def spectrum_sql(cells: str, name: str, count: int = 1, squarings: int = 12) -> tuple[str, ...]:
    """CTEs up to ``{name}_l1(v)``, ``{name}_l2(v)`` and so on: the largest squared singular values of ``cells``
    (unit_ix, t_ix, v), and ``{name}_sum(v)``, the sum of all. A normalised power of the unit Gram matrix, made by
    squaring, is the projector on its first eigenvector, which is then taken out."""
    out = [f"{name}_g1 AS MATERIALIZED (SELECT a.unit_ix AS i, b.unit_ix AS j, sum(a.v * b.v) AS v FROM {cells} a JOIN {cells} b USING (t_ix) GROUP BY 1, 2)"]
    out.append(f"{name}_sum AS (SELECT sum(v) AS v FROM {name}_g1 WHERE i = j)")
    for c in range(1, count + 1):
        last = f"{name}_g{c}"
        for k in range(squarings + 1):
            if k:
                out.append(f"{name}_s{c}_{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2)")
                last = f"{name}_s{c}_{k}"
            out.append(f"{name}_n{c}_{k} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {last} WHERE i = j) AS v FROM {last})")
            last = f"{name}_n{c}_{k}"
        out.append(f"{name}_l{c} AS MATERIALIZED (SELECT sum(a.v * b.v) AS v FROM {name}_g{c} a JOIN {last} b USING (i, j))")
        out.append(f"{name}_g{c + 1} AS MATERIALIZED (SELECT a.i, a.j, a.v - (SELECT v FROM {name}_l{c}) * b.v AS v FROM {name}_g{c} a JOIN {last} b USING (i, j))")
    return tuple(out)


def _share_sql(cells: str, name: str) -> tuple[str, ...]:
    """CTEs that end in ``{name}_share(share)``: the first squared singular value over their sum."""
    return (*spectrum_sql(cells, name), f"{name}_share AS (SELECT a.v / b.v AS share FROM {name}_l1 a CROSS JOIN {name}_sum b)")


@query(_sql(f"SELECT {_r('share')} AS share FROM y_share", "panel", "yv AS (SELECT unit_ix, t_ix, y AS v FROM panel)", *_share_sql("yv", "y")))
def first_sv_share(spark, sf_dir):
    return _out(D.first_singular_share(T.complete_shipments(spark, sf_dir), "y"), share="share")


_TWO_WAY = "w AS (SELECT unit_ix, t_ix, y, y - avg(y) OVER (PARTITION BY unit_ix) - avg(y) OVER (PARTITION BY t_ix) + avg(y) OVER () AS v FROM panel)"
_LAGS = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag, avg(p / rr) AS autocorr FROM (SELECT sum(v * coalesce(l, 0)) AS p, sum(v * v) AS rr FROM (SELECT unit_ix, v, lag(v, {k}) OVER ({_BY_T}) AS l FROM w) GROUP BY unit_ix)" for k in range(1, 7))


@query(
    _sql(
        f"""SELECT lag, {_r('autocorr')} AS autocorr, {_r('c')} AS avg_corr, {_r('mean')} AS mean, {_r('sd')} AS sd, {_r('rmse')} AS rmse, {_r('variance')} AS variance, {_r('r2')} AS r2, {_r('share')} AS share
        FROM ({_LAGS}) CROSS JOIN (SELECT avg(c) AS c FROM (SELECT corr(a.v, b.v) AS c FROM w a JOIN w b ON a.t_ix = b.t_ix AND a.unit_ix <> b.unit_ix GROUP BY a.unit_ix, b.unit_ix))
        CROSS JOIN (SELECT avg(v) AS mean, stddev_pop(v) AS sd, sqrt(avg(v * v)) AS rmse, var_pop(v) AS variance, 1 - var_pop(v) / var_pop(y) AS r2 FROM w) CROSS JOIN r_share""",
        "panel",
        _TWO_WAY,
        *_share_sql("w", "r"),
    )
)
def residual_diag(spark, sf_dir):
    """Autocorrelations, cross correlation, fit and singular share of the two-way residual."""
    df = written(T.complete_shipments(spark, sf_dir).select("unit_ix", "t_ix", "y", F.col("y").alias("v")), "shipments")
    within = P.within_frame(df, ["v"]).join(df.select("unit_ix", "t_ix", "y"), ["unit_ix", "t_ix"])
    out = D.residual_diagnostics(within, "v", "y")
    return _out(out, "lag", **{c: c for c in ("autocorr", "avg_corr", "mean", "sd", "rmse", "variance", "r2", "share")})


def _adf_sql(p: int = 4) -> str:
    names = [*[f"d{j}" for j in range(1, p + 1)], "level", "d"]
    by = "OVER (PARTITION BY unit_ix)"
    steps = [
        f"a0 AS (SELECT unit_ix, t_ix, CASE WHEN min(y) {by} > 0 THEN ln(greatest(y, 1e-300)) ELSE y END AS y FROM panel)",
        f"a1 AS (SELECT unit_ix, t_ix, y - lag(y) OVER ({_BY_T}) AS d, lag(y) OVER ({_BY_T}) AS level, row_number() OVER ({_BY_T}) AS k, count(*) {by} AS size FROM a0)",
        f"a2 AS (SELECT unit_ix, k, size, level, d, {', '.join(f'lag(d, {j}) OVER ({_BY_T}) AS d{j}' for j in range(1, p + 1))} FROM a1)",
        f"b0 AS (SELECT unit_ix, size, {', '.join(f'{c} - avg({c}) {by} AS {c}' for c in names)} FROM a2 WHERE k >= {p + 2})",
    ]
    for k in range(p):
        own = names[k]
        rest = ", ".join(f"{c} - {own} * coalesce(sum({own} * {c}) {by} / nullif(sum({own} * {own}) {by}, 0), 0) AS {c}" for c in names[k + 1 :])
        steps.append(f"b{k + 1} AS (SELECT unit_ix, size, {rest} FROM b{k})")
    steps.append(f"sums AS (SELECT unit_ix, max(size) AS size, count(*) AS n, sum(level * level) AS xx, sum(level * d) AS xd, sum(d * d) AS dd FROM b{p} GROUP BY 1)")
    steps.append(f"stats AS (SELECT unit_ix, CASE WHEN size - 1 > {p + 8} AND xx > 0 AND dd > xd * xd / xx THEN xd / xx / sqrt((dd - xd * xd / xx) / greatest(n - {p + 2}, 1) / xx) ELSE 0.0 END AS t_stat FROM sums)")
    return ",\n".join(steps)


@query(_sql(f"SELECT CAST(unit_ix AS BIGINT) AS unit_ix, {_r('t_stat')} AS t_stat, t_stat > -2.86 AS unit_root FROM stats", "panel", _adf_sql()))
def adf_tstat(spark, sf_dir):
    out = D.adf_statistics(T.complete_shipments(spark, sf_dir), "y")
    return out.select(F.col("unit_ix").cast("long").alias("unit_ix"), S.rounded(F.col("t_stat")).alias("t_stat"), "unit_root")


ORACLE_SQL["stationarize"] = _sql(
    f"""SELECT {_KEYS}, {_r('v')} AS y FROM (SELECT unit_ix, t_ix, CASE WHEN t_stat > -2.86 THEN CASE WHEN min(y) OVER (PARTITION BY unit_ix) > 0
    THEN ln(greatest(y, 1e-300)) - ln(greatest(lag(y) OVER ({_BY_T}), 1e-300)) ELSE y - lag(y) OVER ({_BY_T}) END ELSE y END AS v, row_number() OVER ({_BY_T}) AS k FROM panel JOIN stats USING (unit_ix)) WHERE k > 1""",
    "panel",
    _adf_sql(),
)


def _companion_sql(most: int = 16) -> tuple[str, ...]:
    lead = ", ".join(f"lead({c}, {h}) OVER ({_BY_T}) AS {c}{h}" for h in range(1, most) for c in "ab")
    out = [f"m1 AS (SELECT *, a AS p1, b AS q1, 1.0::DOUBLE AS r1, 0.0::DOUBLE AS s1, (SELECT greatest(1, ceil(ln(count(*)))) FROM coef) AS horizon, {lead} FROM coef)"]
    out += [f"m{h + 1} AS (SELECT *, a{h} * p{h} + b{h} * r{h} AS p{h + 1}, a{h} * q{h} + b{h} * s{h} AS q{h + 1}, p{h} AS r{h + 1}, q{h} AS s{h + 1} FROM m{h})" for h in range(1, most)]
    norm = "sqrt(({0} + sqrt(greatest({0} * {0} - 4 * {1} * {1}, 0))) / 2)"
    roots = " UNION ALL ".join(f"SELECT unit_ix, pow({norm.format(f'(p{h} * p{h} + q{h} * q{h} + r{h} * r{h} + s{h} * s{h})', f'(p{h} * s{h} - q{h} * r{h})')}, 1.0 / {h}) AS root FROM m{most} WHERE horizon >= {h} AND p{h} IS NOT NULL AND r{h} IS NOT NULL" for h in range(1, most + 1))
    return (*out, f"roots AS ({roots})")


@query(_sql(f"SELECT CAST(unit_ix AS BIGINT) AS unit_ix, {_r('max(root)')} AS growth, {_r('least(max(root), 0.99)')} AS persistence FROM roots GROUP BY 1", "panel", "coef AS (SELECT unit_ix, t_ix, (30 + t_ix % 7) / 100.0 AS a, (10 + 2 * (unit_ix % 5)) / 100.0 AS b FROM panel)", *_companion_sql()))
def companion_product_norm(spark, sf_dir):
    """Persistence of a two-lag panel by companion products."""
    cells = T.complete_shipments(spark, sf_dir).select("unit_ix", "t_ix", ((30 + F.col("t_ix") % 7) / 100.0).alias("a"), ((10 + 2 * (F.col("unit_ix") % 5)) / 100.0).alias("b"))
    return _out(D.companion_persistence(cells, "a", "b"), "unit_ix", growth="growth", persistence="persistence")


def _als_sql(sweeps: int, ridge: float) -> tuple[str, ...]:
    """Half-sweeps of a rank-one level block from factors of ones."""
    out = ["tr AS (SELECT t_ix, unit_ix, y FROM panel WHERE (t_ix + unit_ix) % 5 <> 0)", "g0 AS (SELECT unit_ix, 1.0::DOUBLE AS g FROM units)"]
    for k in range(sweeps):
        out.append(f"f{k + 1} AS MATERIALIZED (SELECT t_ix, sum(y * g) / (sum(g * g) + {ridge}) AS f FROM tr JOIN g{k} USING (unit_ix) GROUP BY 1)")
        out.append(f"g{k + 1} AS MATERIALIZED (SELECT unit_ix, sum(y * f) / (sum(f * f) + {ridge}) AS g FROM tr JOIN f{k + 1} USING (t_ix) GROUP BY 1)")
    return tuple(out)


@query(_sql(f"SELECT {_r('sqrt(avg((y - f * g) * (y - f * g)))')} AS rmse FROM panel JOIN f3 USING (t_ix) JOIN g3 USING (unit_ix)", "panel", *_als_sql(3, 0.02)))
def distributed_als(spark, sf_dir):
    """A few distributed half-sweeps of the level block on the shipments panel."""
    df = T.complete_shipments(spark, sf_dir).select("t_ix", "unit_ix", "y", ((F.col("t_ix") + F.col("unit_ix")) % 5 != 0).alias("is_train"), F.array(F.lit(1.0)).alias("d"))
    lam = df.select("unit_ix").distinct().withColumn("v", F.array(F.lit(1.0)))
    f, lam = E.distributed_als(df, df.select("t_ix").distinct().withColumn("v", F.array(F.lit(1.0))), lam, 0.02, 3, 1)
    fitted = df.join(f.withColumnRenamed("v", "f"), "t_ix").join(lam.withColumnRenamed("v", "g"), "unit_ix").withColumn("e", F.col("y") - F.col("f")[0] * F.col("g")[0])
    return _out(fitted.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")), rmse="rmse")


@query(_sql(f"SELECT j.range AS j, {_r('0.09 * pow(8300.0, 0.125) * greatest(1, ln(ln(8300.0))) * sqrt(ln(8300.0 * j.range)) / sqrt(1.0 / 100 + 1.0 / 83)')} AS penalty FROM range(4, 13) j"))
def rank_penalty(spark, sf_dir):
    return _out(spark.range(4, 13).select(F.col("id").alias("j")), "j", penalty=S.rank_penalty(F.lit(0.09), F.lit(100.0), F.lit(83.0), F.col("j")))


@query(_sql("SELECT r1, r2, r3, dimension FROM box WHERE r1 + r2 + r3 <= 3", _BOX))
def effective_dim(spark, sf_dir):
    return rank_box(spark, sf_dir).where("r1 + r2 + r3 <= 3")


@query(_sql(f"SELECT CAST(unit_ix AS BIGINT) AS unit_ix, {_r('(rho * sin(n * (radians(lon) - radians(-96.0))))')} AS x, {_r('rho0 - rho * cos(n * (radians(lon) - radians(-96.0)))')} AS y FROM (SELECT unit_ix, lon, n, sqrt(c - 2 * n * sin(radians(lat))) / n AS rho, sqrt(c - 2 * n * sin(radians(23.0))) / n AS rho0 FROM coords CROSS JOIN (SELECT n, pow(cos(radians(29.5)), 2) + 2 * n * sin(radians(29.5)) AS c FROM (SELECT (sin(radians(29.5)) + sin(radians(45.5))) / 2 AS n)))", "panel", _COORDS.split("), km AS")[0] + ")"))
def albers_projection(spark, sf_dir):
    c = T.coordinates(T.complete_shipments(spark, sf_dir)).withColumn("p", S.albers(F.col("lat"), F.col("lon")))
    return _out(c, "unit_ix", x="p.x", y="p.y")


# --- Monte Carlo records ---------------------------------------------------------------------------

_Z2 = 2 * S.Z95


@query(
    _sql(
        f"""SELECT config, target, count(*) AS reps, {_r('avg(err)')} AS bias, {_r('avg(abs(err))')} AS mean_abs, {_r('sqrt(avg(err * err))')} AS rmse, {_r('stddev_pop(err)')} AS sd, {_r('avg(se)')} AS mean_se, {_r('avg(se_xs)')} AS mean_se_xs,
        {_r('avg(cov)')} AS coverage, {_r('avg(cov_xs)')} AS coverage_xs, {_r(f'avg({_Z2} * se)')} AS length, {_r(f'avg({_Z2} * se_xs)')} AS length_xs, {_r('avg(plugin_err)')} AS plugin_bias, {_r('sqrt(avg(plugin_err * plugin_err))')} AS plugin_rmse,
        {_r('avg(err / se)')} AS t_mean, {_r('stddev_pop(err / se)')} AS t_sd, {_r('quantile_cont(err / se, 0.05)')} AS t_q05, {_r('quantile_cont(err / se, 0.5)')} AS t_q50, {_r('quantile_cont(err / se, 0.95)')} AS t_q95 FROM records GROUP BY 1, 2""",
        _RECORDS,
    )
)
def mc_aggregate(spark, sf_dir):
    a = M.aggregate(T.replication_records(spark))
    return _out(a, "config", "target", "reps", **{c: c for c in a.columns if c not in ("config", "target", "reps")})


@query(_sql(f"SELECT target, k, {_r('(k - 0.5) / n')} AS p, {_r('z')} AS z FROM (SELECT target, err / se AS z, row_number() OVER (PARTITION BY target ORDER BY err / se, rep) AS k, count(*) OVER (PARTITION BY target) AS n FROM records WHERE se > 0) WHERE k % 5 = 0", _RECORDS))
def studentized_qq(spark, sf_dir):
    return _out(M.studentized_qq(T.replication_records(spark), 5), "target", "k", p="p", z="z")


@query(_sql(f"SELECT target, {_r('CAST(err AS DOUBLE) / se')} AS z FROM records WHERE se > 0", _RECORDS))
def studentized_sample(spark, sf_dir):
    return _out(T.replication_records(spark).where("se > 0"), "target", z=F.col("err") / F.col("se"))


@query(_sql("SELECT target, CAST(arg_min(rep, (err * err, rep)) AS BIGINT) AS best FROM records GROUP BY 1", _RECORDS))
def best_restart(spark, sf_dir):
    r = T.replication_records(spark)
    return r.groupBy("target").agg(F.min_by("rep", F.struct(F.col("err") * F.col("err"), F.col("rep"))).alias("best"))


@query(_sql("SELECT target, format('{:.3f}', avg(err)) AS bias FROM records GROUP BY 1", _RECORDS))
def fixed_decimals(spark, sf_dir):
    return T.replication_records(spark).groupBy("target").agg(F.avg("err").alias("b")).select("target", S.fixed_decimals(F.col("b")).alias("bias"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_panel_cells(spark, sf_dir):
    from panelmill.streaming.cells import batch_cells

    return batch_cells(T.table(spark, sf_dir, "events", "event_type", "ts"))


_STATE_NAMES = "named AS (SELECT n_nationkey AS key, concat('City ', n_nationkey, ', ', substr(n_name, 1, 2), '-', substr(n_name, 3, 2)) AS name FROM nation)"


@query(
    _sql(
        f"""SELECT state, {_r('avg(v)')} AS mean, count(*) AS n FROM (SELECT list_filter(regexp_extract_all(name, '[A-Z]{{2}}'), lambda x: x IN ('AR', 'BR', 'CA', 'IN', 'JA', 'KE', 'MO', 'UN'))[1] AS state, c_acctbal AS v
        FROM named JOIN customer ON c_nationkey = key) WHERE state IS NOT NULL GROUP BY 1""",
        _STATE_NAMES,
    )
)
def state_lookup(spark, sf_dir):
    """Means of customers' balances by the state that their area's name holds; areas are matched by code."""
    nation = T.table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    name = F.concat(F.lit("City "), F.col("n_nationkey").cast("string"), F.lit(", "), F.substring("n_name", 1, 2), F.lit("-"), F.substring("n_name", 3, 2))
    areas = nation.select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code"), name.alias("name"), F.col("n_nationkey").cast("long").alias("position"))
    values = T.table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").select(F.col("c_nationkey").cast("string").alias("code"), F.col("c_acctbal").alias("value"))
    out = P.state_means(values, P.state_of_codes(areas, ["AR", "BR", "CA", "IN", "JA", "KE", "MO", "UN"]))
    return _out(out, "state", "n", mean="mean")


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
