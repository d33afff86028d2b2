"""Reports of a dynamic panel model and the specifications A to D of the two applications.

A report is one long table (section, quantity, grp, estimate, se, se_xs, lower, upper); groups are labels. It is
composed of task frames (scores, one full fit) and relational summaries of them.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions import kernels as K
from panelmill.functions import scalars as S
from panelmill.operators import diagnostics as D
from panelmill.operators import estimator as E
from panelmill.operators import inference as I
from panelmill.operators import linear as L
from panelmill.operators import panel as P
from panelmill.operators.checkpoints import written

COLUMNS = ("section", "quantity", "grp", "estimate", "se", "se_xs", "lower", "upper")
HORIZONS = (1, 2, 4, 8, 12)
#: Cumulative persistence is a sum of lag targets, so it has both errors like any target.
SUMS = {f"persistence_{g}": (f"lag1_{g}", f"lag2_{g}") for g in ("mean", "high", "low")}
KAPPA = 0.03


def _row(section: str, quantity: Column | str, grp: Column | str, estimate: Column, se: Column | None = None, **more: Column) -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    values = {"estimate": estimate, "se": se} | more
    cells = [lit(section).alias("section"), lit(quantity).alias("quantity"), lit(grp).alias("grp")]
    return [*cells, *[(values[c] if values.get(c) is not None else F.lit(None)).cast("double").alias(c) for c in COLUMNS[3:]]]


def target_rows(estimates: DataFrame) -> DataFrame:
    name = F.regexp_replace("target", "_(mean|high|low|high_minus_low)$", "")
    grp = F.regexp_replace(F.regexp_extract("target", "_(mean|high_minus_low|high|low)$", 1), "^mean$", "all")
    return estimates.select(*_row("target", name, grp, F.col("estimate"), F.col("se"), se_xs=F.col("se_xs"), lower=F.col("lower"), upper=F.col("upper")), "plugin")


def dynamics(estimates: DataFrame) -> DataFrame:
    """Companion radius, long-run multiplier and impulse responses of the mean lags, by the delta method. The lags'
    covariance is what the variance of their sum leaves over."""
    names = ["lag1_mean", "lag2_mean", "persistence_mean"]
    one = estimates.groupBy().pivot("target", names).agg(F.first("estimate").alias("e"), F.first("se").alias("s"))
    a, b = F.col("lag1_mean_e"), F.col("lag2_mean_e")
    vaa, vbb, vpp = (F.pow(F.col(f"{n}_s"), F.lit(2.0)) for n in names)
    vab = (vpp - vaa - vbb) / 2
    lrm = S.long_run_multiplier(a, b)
    rows = [_row("dynamics", "companion_radius", "all", S.companion_radius(a, b)), _row("dynamics", "long_run_multiplier", "all", lrm, S.delta_se(lrm * lrm, lrm * lrm, vaa, vab, vbb))]
    for h in HORIZONS:
        g = S.irf_gradient(a, b, F.lit(h))
        rows.append(_row("dynamics", f"response_{h}", "all", S.irf(a, b, F.lit(h)), S.delta_se(g["da"], g["db"], vaa, vab, vbb)))
    return one.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("r")).select("r.*")


def fit_rows(cells: DataFrame, high_units: list[int]) -> DataFrame:
    """Residual diagnostics, fit, solver, sizes and the lag-1 surface's spread by group, from one full fit's cells."""
    c = cells.withColumn("a", F.col("theta")[0]).withColumn("grp", F.when(F.col("unit_ix").isin(*high_units) if high_units else F.lit(False), "high").otherwise("low"))
    residual = D.residual_diagnostics(c, "residual", "y")
    lags = residual.select(*_row("residual", F.concat(F.lit("autocorrelation_"), F.col("lag").cast("string")), "all", F.col("autocorr")))
    first = residual.where("lag = 1")
    names = {"mean": "mean", "sd": "sd", "rmse": "rmse", "r2": "r2", "avg_corr": "cross_correlation", "share": "first_singular_share"}
    fit = first.select(F.explode(F.array(*[F.struct(*_row("residual", label, "all", F.col(k))) for k, label in names.items()])).alias("r")).select("r.*")
    sums = c.agg((1 - F.var_pop("residual") / F.var_pop("level")).alias("r2_level"), F.min(F.col("monotone").cast("double")).alias("monotone"), F.max("restarts").alias("restarts"), F.max("dispersion").alias("dispersion"), F.countDistinct("t_ix").alias("periods"), F.countDistinct("unit_ix").alias("units"))
    solver = [("fit", "r2_against_level_only", "r2_level"), *[("solver", k, k) for k in ("monotone", "restarts", "dispersion")], *[("data", k, k) for k in ("periods", "units")]]
    meta = sums.select(F.explode(F.array(*[F.struct(*_row(s, label, "all", F.col(k))) for s, label, k in solver])).alias("r")).select("r.*")
    spread = D.heterogeneity(c, "a", "grp")
    spread = spread.select(F.explode(F.array(*[F.struct(*_row("heterogeneity", f"lag1_{k}", F.col("grp"), F.col(k))) for k in ("mean", "sd", "q05", "q50", "q95")])).alias("r")).select("r.*")
    return lags.unionByName(fit).unionByName(meta).unionByName(spread)


def report(panel: DataFrame, tuning: K.Tuning, seed: int, covariates: int, high_units: list[int], diagnostics: bool = True) -> DataFrame:
    """All sections for a panel of two lag blocks, ``covariates`` blocks and the level; those after the dynamics, which
    need a fit to the whole panel, only with ``diagnostics``."""
    estimates = I.estimates(E.score_cells(panel, tuning, seed, 2, covariates, high_units, SUMS), S.Z95)
    # what holds fits and is read several times is written once
    estimates = written(estimates, "estimates")
    out = target_rows(estimates).drop("plugin").unionByName(dynamics(estimates))
    return out.unionByName(fit_rows(written(E.full_fit(panel, tuning, seed), "full-fit"), high_units)) if diagnostics else out


def over_ranks(panel: DataFrame, specs: dict[str, tuple[int, ...]], tuning: K.Tuning, seed: int) -> DataFrame:
    """(spec, estimate, se, se_xs): the lag-1 mean under other ranks, one task for each."""

    def run(y: np.ndarray, z: np.ndarray, spec: str) -> pd.DataFrame:
        t, n = y.shape
        est = K.estimate(y, z, {"lag1_mean": (0, np.full((t, n), 1 / (t * n)))}, replace(tuning, ranks=specs[spec]), (seed,))
        return pd.DataFrame({"spec": [spec], "estimate": est["estimate"], "se": [K.white(est["psi"][0], est["u"])], "se_xs": [K.clustered(est["psi"][0], est["u"])]})

    return E.run_tasks(panel, list(specs), run, "spec string, estimate double, se double, se_xs double")


@dataclass(frozen=True)
class Spec:
    """One specification: its window as shares of the sample's periods, whether units need complete covariates, whether
    these enter, and which extras go with it."""

    name: str
    window: tuple[float, float] = (0.0, 1.0)
    matched: bool = False
    covariates: bool = False
    extras: tuple[str, ...] = ()


@dataclass(frozen=True)
class Application:
    lag_ranks: tuple[int, int]
    caps: tuple[int, int, int]
    level_ranks: tuple[int, ...]
    specs: tuple[Spec, ...]

    @property
    def lags(self) -> int:
        return sum(r > 0 for r in self.lag_ranks)


HOUSING = Application((1, 1), (2, 2, 3), (0, 1, 2), (Spec("A", extras=("ranks", "level")), Spec("B", (0.2, 0.95), matched=True), Spec("C", (0.2, 0.95), matched=True, covariates=True, extras=("covariates",)), Spec("D", (0.0, 0.75), extras=("ranks",))))
UNEMPLOYMENT = Application((1, 0), (2, 2, 4), (1, 2, 3, 4), (Spec("A"), Spec("B", (0.2, 0.95), matched=True, extras=("ranks", "level")), Spec("C", (0.2, 0.95), matched=True, covariates=True, extras=("covariates",)), Spec("D", (0.2, 0.75), matched=True, extras=("ranks",))))


def sample(cells: DataFrame, spec: Spec, covariates: list[str]) -> DataFrame:
    """The window's periods and the units that are whole in it (in the covariates too, if these must match), numbered
    anew from 0, values standardised by unit."""
    periods = cells.agg(F.max("t_ix")).first()[0] + 1
    low, high = round(spec.window[0] * periods), round(spec.window[1] * periods)
    out = P.balanced(cells.where((F.col("t_ix") >= low) & (F.col("t_ix") < high)), "y")
    for c in covariates if spec.matched else ():
        out = P.balanced(out, c)
    units = out.select("unit_ix").distinct()
    # few units: their numbering is one small window
    numbered = units.selectExpr("unit_ix", "CAST(row_number() OVER (ORDER BY unit_ix) - 1 AS INT) AS new")
    out = out.join(F.broadcast(numbered), "unit_ix").select(F.col("new").alias("unit_ix"), (F.col("t_ix") - low).cast("int").alias("t_ix"), "y", *covariates)
    return out


def run_spec(cells: DataFrame, app: Application, spec: Spec, covariates: list[str], tuning: K.Tuning, seed: int, diagnostics: bool = True) -> DataFrame:
    """The report of one specification with its sample's size, the homogeneous benchmark and its extras."""
    data = written(sample(cells, spec, covariates), "sample")
    high = [r[0] for r in P.median_split(data, "y").where("grp = 'high'").select("unit_ix").collect()]
    used = covariates if spec.covariates else []
    scaled = data.withColumn("y", P.standardized("y"))
    for c in used:
        scaled = scaled.withColumn(c, F.coalesce(P.standardized(c), F.lit(0.0)))
    panel = L.with_blocks(P.with_ar_design(scaled, "y", 2, used), ["lag1", "lag2", *used]).select((F.col("t_ix") - 2).alias("t_ix"), "unit_ix", "y", "z")
    panel = written(panel, "panel")
    ranks = (*app.lag_ranks, *[1] * len(used), 1)
    tuning = replace(tuning, ranks=ranks)
    out = report(panel, tuning, seed, len(used), high, diagnostics)
    pooled = P.two_way_ar(scaled, "y", app.lags)
    size = scaled.agg(F.countDistinct("t_ix").alias("periods"), F.countDistinct("unit_ix").alias("units"))
    out = out.unionByName(size.select(F.explode(F.array(*[F.struct(*_row("sample", k, "all", F.col(k))) for k in ("periods", "units")])).alias("r")).select("r.*"))
    names = [c for c in ("beta1", "beta2", "beta_sum", "rmse", "r2") if c in pooled.columns]
    out = out.unionByName(pooled.select(F.explode(F.array(*[F.struct(*_row("homogeneous", c, "all", F.col(c))) for c in names])).alias("r")).select("r.*"))
    if "ranks" in spec.extras:
        t, n = panel.agg(F.max("t_ix"), F.max("unit_ix")).first()
        boxes = [(a, b, *[1] * len(used), r) for a, b, r in itertools.product(*(range(c + 1) for c in app.caps))]
        table = E.select_ranks(panel, boxes, replace(tuning, folds=3, sweeps=8, levels=2), seed, KAPPA, int(t) + 1, int(n) + 1)
        best = table.orderBy("criterion", "dimension", "ranks").limit(8)
        out = out.unionByName(best.select(*_row("rank_selection", F.col("ranks").cast("string"), "all", F.col("criterion"))))
    others = {}
    if "level" in spec.extras:
        others |= {f"level rank {r}": (*ranks[:-1], r) for r in app.level_ranks}
    if "covariates" in spec.extras:
        others |= {f"without {c}": (*ranks[: 2 + k], 0, *ranks[3 + k :]) for k, c in enumerate(used)}
    if others:
        robust = over_ranks(panel, others, tuning, seed)
        out = out.unionByName(robust.select(*_row("robustness", F.col("spec"), "all", F.col("estimate"), F.col("se"), se_xs=F.col("se_xs"))))
    return out.select(F.lit(spec.name).alias("spec"), *COLUMNS)


def specifications(cells: DataFrame, app: Application, covariates: list[str], tuning: K.Tuning, seed: int, diagnostics: bool = True) -> DataFrame:
    """All specifications of an application on cells (unit_ix, t_ix, y and covariates), missing values null."""
    cells = written(cells.select("unit_ix", "t_ix", "y", *covariates), "cells")
    frames = [run_spec(cells, app, s, covariates, tuning, seed, diagnostics) for s in app.specs]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
