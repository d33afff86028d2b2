"""Queries of the estimator, simulation and robustness operators. Singular vectors, alternating fits and
replications have no SQL; identities that a fit must meet have, and tests hold the rest against kernels."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import kernels as K
from panelmill.functions import scalars as S
from panelmill.operators import estimator as E
from panelmill.operators import inference as I
from panelmill.operators import linear as L
from panelmill.operators import montecarlo as M
from panelmill.operators import panel as P
from panelmill.plans import applications as A
from panelmill.plans import relational as R
from panelmill.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 2024
SMALL = K.Tuning(ranks=(1, 1, 1), q=1, folds=6, sweeps=30, restarts=2)
BASE = {"t": 24, "n": 24, "q": 1, "folds": 6, "sweeps": 30, "restarts": 1, "oracle": True}


def query(f):
    QUERIES[f.__name__] = f
    return f


def ar_panel(spark: SparkSession, sf_dir: str, lags: int = 1) -> DataFrame:
    """Standardised shipments with lag designs, one covariate, and the trailing ones: t_ix, unit_ix, y, z."""
    df = T.complete_shipments(spark, sf_dir).withColumn("y", P.standardized("y")).withColumn("x", P.standardized("x"))
    ar = P.with_ar_design(df, "y", lags, ["x"])
    return L.with_blocks(ar, [*[f"lag{k}" for k in range(1, lags + 1)], "x"]).select((F.col("t_ix") - lags).alias("t_ix"), "unit_ix", "y", "z")


def high_units(spark: SparkSession, sf_dir: str) -> list[int]:
    """Units above the median mean; a panel has few units."""
    split = P.median_split(T.complete_shipments(spark, sf_dir), "y")
    return [r[0] for r in split.where("grp = 'high'").select("unit_ix").collect()]


@query
def fit_factor_ridge(spark, sf_dir):
    factors = E.fit_folds(ar_panel(spark, sf_dir), SMALL, SEED)
    cells = E.surface_cells(factors)
    return cells.groupBy("j", "block").agg(F.avg("value").alias("mean"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.count("*").alias("n_cells"))


_AR = """st AS (SELECT unit_ix, t_ix, (y - avg(y) OVER u) / CASE WHEN stddev_pop(y) OVER u > 0 THEN stddev_pop(y) OVER u ELSE 1 END AS y,
    (x - avg(x) OVER u) / CASE WHEN stddev_pop(x) OVER u > 0 THEN stddev_pop(x) OVER u ELSE 1 END AS x FROM panel WINDOW u AS (PARTITION BY unit_ix)),
    ar AS (SELECT * FROM (SELECT unit_ix, t_ix, y, lag(y) OVER o AS l, lag(x) OVER o AS c, row_number() OVER o AS k FROM st WINDOW o AS (PARTITION BY unit_ix ORDER BY t_ix)) WHERE k > 1)"""


@query
def warm_start(spark, sf_dir):
    """Norms of the first factors of every block's share of the outcome."""

    def run(y, z, _):
        f, g = K.warm_factors(y, z, (1, 1, 1), np.ones(y.shape, bool))
        return pd.DataFrame({"block": range(3), "norm_f": np.linalg.norm(f, axis=0), "norm_g": np.linalg.norm(g, axis=0)})

    out = E.run_tasks(ar_panel(spark, sf_dir), [None], run, "block long, norm_f double, norm_g double")
    return out.select("block", S.rounded(F.col("norm_f")).alias("norm_f"), S.rounded(F.col("norm_g")).alias("norm_g"))


_PARTS = {f"w{b}": f"w{b} AS (SELECT unit_ix, t_ix, {d} * y / (l * l + c * c + 1 + 0.001) AS v FROM ar)" for b, d in enumerate(("l", "c", "1"))}
ORACLE_SQL["warm_start"] = R._sql(
    " UNION ALL ".join(f"SELECT CAST({b} AS BIGINT) AS block, round(pow(v, 0.25), 6) + 0.0 AS norm_f, round(pow(v, 0.25), 6) + 0.0 AS norm_g FROM w{b}_l1" for b in range(3)),
    "panel",
    _AR,
    *(c for name, part in _PARTS.items() for c in (part, *R.spectrum_sql(name, name))),
)


@query
def block_svd(spark, sf_dir):
    """The three largest singular values of the outcome."""

    def run(y, z, _):
        return pd.DataFrame({"k": range(3), "singular_value": np.linalg.svd(y, compute_uv=False)[:3]})

    return E.run_tasks(ar_panel(spark, sf_dir), [None], run, "k long, singular_value double").select("k", S.rounded(F.col("singular_value")).alias("singular_value"))


ORACLE_SQL["block_svd"] = R._sql(
    " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, round(sqrt(v), 6) + 0.0 AS singular_value FROM y_l{k + 1}" for k in range(3)),
    "panel",
    _AR,
    "yv AS (SELECT unit_ix, t_ix, y AS v FROM ar)",
    *R.spectrum_sql("yv", "y", 3),
)


def _scores(spark, sf_dir, tuning=SMALL, lags=1) -> DataFrame:
    return E.score_cells(ar_panel(spark, sf_dir, lags), tuning, SEED, lags, 1, high_units(spark, sf_dir))


@query
def riesz_weights(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return s.groupBy("target", "j").agg(F.sqrt(F.sum(F.col("psi") * F.col("psi"))).alias("norm"), F.max(F.abs("psi")).alias("largest"))


_TARGETS = "lag1_mean lag1_high lag1_low lag1_high_minus_low covariate1_mean".split()


@query
def riesz_identity(spark, sf_dir):
    """The weights represent every target on the fitted tangent spaces."""
    gaps = E.riesz_gaps(ar_panel(spark, sf_dir), SMALL, SEED, 1, 1, high_units(spark, sf_dir))
    return gaps.select(F.col("j").cast("long").alias("j"), "target", S.rounded(F.col("gap"), 4).alias("gap"))


ORACLE_SQL["riesz_identity"] = f"SELECT j.range AS j, t.target, CAST(0 AS DOUBLE) AS gap FROM range({SMALL.folds}) j CROSS JOIN (SELECT unnest([{', '.join(repr(t) for t in _TARGETS)}]) AS target) t"


@query
def ridge_normal_equations(spark, sf_dir):
    """Largest slope of the objective in the unit factors, which the last half-sweep solves for: zero by fold."""
    panel = ar_panel(spark, sf_dir)
    factors = E.fit_folds(panel, SMALL, SEED)
    folds = E.training_cells(panel, SMALL, SEED)
    f = factors.where("side = 'period'").select("j", "k", "block", F.col("ix").alias("t_ix"), F.col("v").alias("f"))
    g = factors.where("side = 'unit'").select("j", "k", F.col("ix").alias("unit_ix"), F.col("v").alias("g"))
    terms = folds.join(f, ["j", "t_ix"]).join(g, ["j", "k", "unit_ix"]).withColumn("d", F.element_at("z", F.col("block") + 1) * F.col("f"))
    cells = terms.groupBy("j", "t_ix", "unit_ix").agg((F.first("y") - F.sum(F.col("d") * F.col("g"))).alias("r"))
    slope = terms.join(cells, ["j", "t_ix", "unit_ix"]).groupBy("j", "k", "unit_ix").agg((F.sum(F.col("d") * F.col("r")) - SMALL.ridge * F.first("g")).alias("slope"))
    return slope.groupBy(F.col("j").cast("long").alias("j")).agg(S.rounded(F.max(F.abs("slope"))).alias("slope"))


ORACLE_SQL["ridge_normal_equations"] = f"SELECT range AS j, CAST(0 AS DOUBLE) AS slope FROM range({SMALL.folds})"


@query
def one_step(spark, sf_dir):
    return I.estimates(_scores(spark, sf_dir), S.Z95)


@query
def run_ar2(spark, sf_dir):
    """The whole report of a two-lag model with one covariate, in groups by the units' mean."""
    return A.report(ar_panel(spark, sf_dir, 2), K.Tuning(ranks=(1, 1, 1, 1), q=1, folds=6, sweeps=30, restarts=2), SEED, 1, high_units(spark, sf_dir))


@query
def housing_specs(spark, sf_dir):
    """The four housing specifications on the shipments panel: two lags, covariates where matched; without the sections of
    a full fit, which ``run_ar2`` shows."""
    return A.specifications(T.shipments(spark, sf_dir), A.HOUSING, ["x", "q"], K.Tuning(q=1, folds=6, ridge=0.1, sweeps=20, restarts=1, levels=3), 7, diagnostics=False)


@query
def unemployment_specs(spark, sf_dir):
    """The four unemployment specifications on the shipments panel: one lag, the second kept at rank 0; without the
    sections of a full fit."""
    return A.specifications(T.shipments(spark, sf_dir), A.UNEMPLOYMENT, ["x", "q"], K.Tuning(q=1, folds=6, ridge=0.5, sweeps=20, restarts=1, levels=3), 13, diagnostics=False)


@query
def select_ranks(spark, sf_dir):
    df = ar_panel(spark, sf_dir)
    t, n = df.agg(F.countDistinct("t_ix"), F.countDistinct("unit_ix")).first()
    tuning = K.Tuning(q=1, folds=4, sweeps=15, restarts=1, levels=2)
    return E.select_ranks(df, list(itertools.product(range(3), repeat=3)), tuning, SEED, 0.03, int(t), int(n)).orderBy("criterion", "dimension", "ranks")


@query
def roadmap(spark, sf_dir):
    return E.roadmap(ar_panel(spark, sf_dir), K.Tuning(sweeps=20, restarts=1, levels=3), SEED)


@query
def no_dynamics_baseline(spark, sf_dir):
    """Residual variance with only the interactive block, against that of the full fit."""
    def run(pdf):
        y, z = E._dense(pdf)
        rows = []
        for name, ranks in (("level only", (0, 0, 1)), ("full", (1, 1, 1))):
            fit = K.fit_factor_ridge(y, z, K.Tuning(sweeps=25, restarts=1, levels=3), None, K.generator(SEED), ranks)
            rows.append((name, float(np.var(y - sum(fit.surface(b) * z[b] for b in range(3))))))
        return pd.DataFrame(rows, columns=["model", "variance"])

    return ar_panel(spark, sf_dir).groupBy(F.lit(0).alias("k")).applyInPandas(run, "model string, variance double")


@query
def rank_robustness(spark, sf_dir):
    """Lag-1 mean over the rank of the interactive block."""
    return _robust(spark, sf_dir, {f"level rank {r}": (1, 1, r) for r in range(4)})


@query
def covariate_robustness(spark, sf_dir):
    """Lag-1 mean with the covariate block kept and dropped."""
    return _robust(spark, sf_dir, {"with covariate": (1, 1, 1), "without covariate": (1, 0, 1)})


def _robust(spark, sf_dir, specs: dict) -> DataFrame:
    return A.over_ranks(ar_panel(spark, sf_dir), specs, K.Tuning(q=1, folds=6, sweeps=25, restarts=1, levels=3), SEED)


@query
def simulate(spark, sf_dir):
    """Simulated panels: (rep, t_ix, unit_ix, y, lag, x, a, b, h, u)."""
    def run(batches):
        for pdf in batches:
            for rep in pdf["id"].tolist():
                p = K.simulate(24, 20, K.generator(SEED, rep))
                t, i = np.indices(p["y"].shape)
                a, b, h = p["surfaces"]
                yield pd.DataFrame({"rep": rep, "t_ix": t.ravel(), "unit_ix": i.ravel(), **{k: v.ravel() for k, v in {"y": p["y"], "lag": p["z"][0], "x": p["z"][1], "a": a, "b": b, "h": h, "u": p["u"]}.items()}})

    return spark.range(4).mapInPandas(run, "rep long, t_ix int, unit_ix int, y double, lag double, x double, a double, b double, h double, u double")


def _summary(records: DataFrame) -> DataFrame:
    return M.aggregate(records)


@query
def run_grid(spark, sf_dir):
    return _summary(E.run_grid(E.replication_tasks(spark, [BASE | {"t": s, "n": s} for s in (24, 32)], 6)))


@query
def purge_sweep(spark, sf_dir):
    return _summary(E.run_grid(E.replication_tasks(spark, E.purge_configs(BASE, [0, 1, 2]), 4, SEED)))


@query
def debiasing_demo(spark, sf_dir):
    out = _summary(E.run_grid(E.replication_tasks(spark, [BASE], 80))).where("target = 'lag_entry'")
    return out.select("target", "reps", "plugin_bias", "bias", "coverage")


@query
def rank_consistency(spark, sf_dir):
    tasks = E.replication_tasks(spark, [{"t": 16, "n": 14, "q": 1, "folds": 3, "sweeps": 10, "restarts": 1, "levels": 2}], 100)
    return E.rank_choices(tasks, (2, 2, 2)).groupBy("config").agg(F.avg("hit").alias("share"), F.count("*").alias("reps"))


@query
def irf_lrm_coverage(spark, sf_dir):
    return E.irf_coverage(E.replication_tasks(spark, [BASE], 60)).groupBy("quantity").agg(F.avg("hit").alias("coverage"), F.count("*").alias("reps"))


@query
def xs_coverage(spark, sf_dir):
    out = _summary(E.run_grid(E.replication_tasks(spark, [BASE | {"noise": "xs"}], 60)))
    return out.select("target", "reps", "coverage", "coverage_xs")


@query
def contiguous_fold_singular(spark, sf_dir):
    both = [E.information_map(spark, 24, 16, 6, 1, s).withColumn("scheme", F.lit(s)) for s in ("scatter", "contiguous")]
    return both[0].unionByName(both[1])


@query
def fold_comparison(spark, sf_dir):
    configs = [BASE | {"scheme": s, "q": q} for s in ("scatter", "checker") for q in (0, 1)]
    return _summary(E.run_grid(E.replication_tasks(spark, configs, 3)))


@query
def stress_folds(spark, sf_dir):
    return _summary(E.run_grid(E.replication_tasks(spark, [BASE | {"folds": j} for j in (6, 8)], 3)))


@query
def stress_ranks(spark, sf_dir):
    return _summary(E.run_grid(E.replication_tasks(spark, [BASE | {"ranks": r, "oracle": False} for r in ([1, 1, 1], [2, 2, 2])], 3)))


@query
def stress_persistence(spark, sf_dir):
    return _summary(E.run_grid(E.replication_tasks(spark, [BASE | {"rho": r} for r in (0.5, 0.99)], 3)))


@query
def xs_stress(spark, sf_dir):
    return _summary(E.run_grid(E.replication_tasks(spark, [BASE | {"n": n, "noise": "xs"} for n in (24, 36)], 3)))


@query
def oracle_vs_feasible(spark, sf_dir):
    return _summary(E.run_grid(E.replication_tasks(spark, [BASE, BASE | {"oracle": False}], 4)))
