"""Estimation as tasks: one for each fold, candidate, specification or replication.

A panel is sent to as many slots as can run at once, as rows (t_ix, unit_ix, y, z); each slot goes through its
share of the tasks, so the copies of the panel do not grow with the tasks. The numerical work is a kernel in a
grouped map. Every task derives its seed from its own key, so results do not depend on cores or slots.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import kernels as K
from panelmill.functions.scalars import Z95

RECORD = "config string, rep long, target string, err double, plugin_err double, se double, se_xs double, cov int, cov_xs int, retained double, monotone boolean"


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """y (T, N) and z (B, T, N) of rows t_ix, unit_ix, y, z."""
    t, i = pdf["t_ix"].to_numpy(), pdf["unit_ix"].to_numpy()
    t, i = t - t.min(), i - i.min()
    y = np.zeros((t.max() + 1, i.max() + 1))
    z = np.zeros((len(pdf["z"].iloc[0]), *y.shape))
    y[t, i] = pdf["y"]
    z[:, t, i] = np.stack(pdf["z"].to_list(), axis=1)
    return y, z


def run_tasks(panel: DataFrame, tasks: list, run: Callable[[np.ndarray, np.ndarray, object], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of ``run(y, z, task)`` for every task. Tasks are few and small, and travel with the function."""
    slots = min(len(tasks), 2 * panel.sparkSession.sparkContext.defaultParallelism)

    def share(key, pdf):
        y, z = _dense(pdf)
        return pd.concat([run(y, z, t) for t in tasks[int(key[0]) :: slots]])

    spread = panel.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "t_ix", "unit_ix", "y", "z")
    return spread.groupBy("slot").applyInPandas(share, schema)


def fit_folds(panel: DataFrame, tuning: K.Tuning, seed: int) -> DataFrame:
    """Factor tables of each fold's purged fit: (j, side, block, k, ix, v), with objective and monotone flag."""

    def run(y: np.ndarray, z: np.ndarray, j: int) -> pd.DataFrame:
        ids = K.fold_ids(*y.shape, tuning.folds, tuning.scheme, K.generator(seed, 1))
        fit = K.fit_factor_ridge(y, z, tuning, K.training_mask(ids == j, tuning.q, tuning.radius), K.generator(seed, 2, j))
        rows = [(j, side, int(fit.block[k]), k, ix, float(m[ix, k]), fit.path[-1], fit.monotone) for side, m in (("period", fit.f), ("unit", fit.g)) for k in range(m.shape[1]) for ix in range(len(m))]
        return pd.DataFrame(rows, columns=["j", "side", "block", "k", "ix", "v", "objective", "monotone"])

    return run_tasks(panel, list(range(tuning.folds)), run, "j int, side string, block int, k int, ix int, v double, objective double, monotone boolean")


def training_cells(panel: DataFrame, tuning: K.Tuning, seed: int) -> DataFrame:
    """(j, t_ix, unit_ix, y, z) of the cells that each fold is fitted to; periods and units count from 0."""

    def run(y: np.ndarray, z: np.ndarray, j: int) -> pd.DataFrame:
        ids = K.fold_ids(*y.shape, tuning.folds, tuning.scheme, K.generator(seed, 1))
        t, i = np.nonzero(K.training_mask(ids == j, tuning.q, tuning.radius))
        return pd.DataFrame({"j": j, "t_ix": t, "unit_ix": i, "y": y[t, i], "z": list(z[:, t, i].T)})

    return run_tasks(panel, list(range(tuning.folds)), run, "j int, t_ix int, unit_ix int, y double, z array<double>")


def surface_cells(factors: DataFrame) -> DataFrame:
    """(j, block, t_ix, unit_ix, value) from factor tables: a join and a sum."""
    f = factors.where("side = 'period'").select("j", "block", "k", F.col("ix").alias("t_ix"), F.col("v").alias("f"))
    g = factors.where("side = 'unit'").select("j", "block", "k", F.col("ix").alias("unit_ix"), F.col("v").alias("g"))
    return f.join(g, ["j", "block", "k"]).groupBy("j", "block", "t_ix", "unit_ix").agg(F.sum(F.col("f") * F.col("g")).alias("value"))


def panel_targets(t: int, n: int, high: np.ndarray | None, covariates: int, lags: int = 2) -> dict[str, tuple[int, np.ndarray]]:
    """Cell means of the lag blocks, overall and by labelled group, the lag-1 contrast, and of covariates."""
    def mean(w: np.ndarray) -> np.ndarray:
        return np.repeat((w / (w.sum() * t))[None, :], t, axis=0)

    ones, out = np.ones(n), {}
    for b in range(lags):
        out[f"lag{b + 1}_mean"] = (b, mean(ones))
        if high is not None and 0 < high.sum() < n:
            out[f"lag{b + 1}_high"] = (b, mean(high.astype(float)))
            out[f"lag{b + 1}_low"] = (b, mean((~high).astype(float)))
    if "lag1_high" in out:
        out["lag1_high_minus_low"] = (0, out["lag1_high"][1] - out["lag1_low"][1])
    for c in range(covariates):
        out[f"covariate{c + 1}_mean"] = (lags + c, mean(ones))
    return out


def score_cells(panel: DataFrame, tuning: K.Tuning, seed: int, lags: int, covariates: int, high_units: list[int] = (), sums: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One task for each fold: plug-ins, weights and residuals (j, target, t_ix, unit_ix, p, plug, psi, u) of
    the held-out cells, for ``inference`` to aggregate. ``sums`` names targets that are sums of others; sums of
    targets that the panel lacks are left out."""

    def run(y: np.ndarray, z: np.ndarray, j: int) -> pd.DataFrame:
        t, n = y.shape
        held = K.fold_ids(t, n, tuning.folds, tuning.scheme, K.generator(seed, 1)) == j
        mask = K.training_mask(held, tuning.q, tuning.radius)
        fit = K.fit_factor_ridge(y, z, tuning, mask, K.generator(seed, 2, j))
        surfaces = [fit.surface(b) for b in range(len(z))]
        residual = y - sum(s * d for s, d in zip(surfaces, z, strict=True))
        targets = panel_targets(t, n, np.isin(np.arange(n), list(high_units)) if high_units else None, covariates, lags)
        psi = K.debiasing_weights(list(targets.values()), z, [fit.spaces(b) for b in range(len(z))], mask, t * n / max(1, int(mask.sum())), tuning.weight_ridge)
        at, who = np.nonzero(held)
        own = {name: (float((d * surfaces[b]).sum()), psi[k]) for k, (name, (b, d)) in enumerate(targets.items())}
        own |= {name: tuple(sum(own[m][i] for m in parts) for i in (0, 1)) for name, parts in (sums or {}).items() if all(m in own for m in parts)}
        return pd.concat([pd.DataFrame({"j": j, "target": name, "t_ix": at, "unit_ix": who, "p": float(held.mean()), "plug": plug, "psi": weight[at, who], "u": residual[at, who]}) for name, (plug, weight) in own.items()])

    return run_tasks(panel, list(range(tuning.folds)), run, "j int, target string, t_ix int, unit_ix int, p double, plug double, psi double, u double")


def riesz_gaps(panel: DataFrame, tuning: K.Tuning, seed: int, lags: int, covariates: int, high_units: list[int] = ()) -> DataFrame:
    """(j, target, gap): the weights represent a target on the tangent space, so their scaled training sum against
    the fitted surfaces' own outcome is the target's plug-in; the gap is what is left of that, over its size."""

    def run(y: np.ndarray, z: np.ndarray, j: int) -> pd.DataFrame:
        t, n = y.shape
        mask = K.training_mask(K.fold_ids(t, n, tuning.folds, tuning.scheme, K.generator(seed, 1)) == j, tuning.q, tuning.radius)
        fit = K.fit_factor_ridge(y, z, tuning, mask, K.generator(seed, 2, j))
        surfaces = [fit.surface(b) for b in range(len(z))]
        fitted = sum(s * d for s, d in zip(surfaces, z, strict=True))
        targets = panel_targets(t, n, np.isin(np.arange(n), list(high_units)) if high_units else None, covariates, lags)
        scale = t * n / max(1, int(mask.sum()))
        psi = K.debiasing_weights(list(targets.values()), z, [fit.spaces(b) for b in range(len(z))], mask, scale, tuning.weight_ridge)
        plugs = [float((d * surfaces[b]).sum()) for b, d in targets.values()]
        gaps = [float(scale * (w * fitted * mask).sum() - p) / max(1.0, abs(p)) for w, p in zip(psi, plugs, strict=True)]
        return pd.DataFrame({"j": j, "target": list(targets), "gap": gaps})

    return run_tasks(panel, list(range(tuning.folds)), run, "j int, target string, gap double")


def full_fit(panel: DataFrame, tuning: K.Tuning, seed: int) -> DataFrame:
    """(t_ix, unit_ix, y, residual, theta ARRAY, level, monotone, restarts, dispersion) of one fit to the whole panel;
    ``level`` is the residual of the fit that has only the interactive block."""

    def run(y: np.ndarray, z: np.ndarray, _) -> pd.DataFrame:
        fit = K.fit_factor_ridge(y, z, tuning, None, K.generator(seed, 5))
        level = K.fit_factor_ridge(y, z, tuning, None, K.generator(seed, 6), (*[0] * (len(z) - 1), max(1, tuning.ranks[-1])))
        surfaces = np.stack([fit.surface(b) for b in range(len(z))])
        residual = y - (surfaces * z).sum(axis=0)
        t, i = np.indices(y.shape)
        low, high = min(fit.finals), max(fit.finals)
        return pd.DataFrame({"t_ix": t.ravel(), "unit_ix": i.ravel(), "y": y.ravel(), "residual": residual.ravel(), "theta": list(surfaces.reshape(len(z), -1).T), "level": (y - level.surface(len(z) - 1)).ravel(), "monotone": fit.monotone, "restarts": len(fit.finals), "dispersion": (high - low) / (1 + abs(low))})

    return run_tasks(panel, [None], run, "t_ix int, unit_ix int, y double, residual double, theta array<double>, level double, monotone boolean, restarts int, dispersion double")


def candidate_losses(panel: DataFrame, candidates: list[tuple[int, ...]], tuning: K.Tuning, seed: int) -> DataFrame:
    """(candidate, j, sse): held-out squared error of every rank candidate in every fold."""

    def run(y: np.ndarray, z: np.ndarray, task: tuple[int, int]) -> pd.DataFrame:
        c, j = task
        held = K.fold_ids(*y.shape, tuning.folds, tuning.scheme, K.generator(seed, 1)) == j
        fit = K.fit_factor_ridge(y, z, tuning, K.training_mask(held, tuning.q, tuning.radius), K.generator(seed, 4, c, j), candidates[c])
        r = y - sum(fit.surface(b) * z[b] for b in range(len(z)))
        return pd.DataFrame({"candidate": [c], "j": [j], "sse": [float((r[held] ** 2).sum())]})

    return run_tasks(panel, [(c, j) for c in range(len(candidates)) for j in range(tuning.folds)], run, "candidate int, j int, sse double")


def select_ranks(panel: DataFrame, candidates: list[tuple[int, ...]], tuning: K.Tuning, seed: int, kappa: float, t: int, n: int) -> DataFrame:
    """Criterion table (candidate, ranks, loss, dimension, criterion): mean held-out error plus penalty."""
    from panelmill.functions.scalars import effective_dim

    loss = candidate_losses(panel, candidates, tuning, seed).groupBy("candidate").agg((F.sum("sse") / (t * n)).alias("loss"))
    named = panel.sparkSession.createDataFrame([(i, list(c)) for i, c in enumerate(candidates)], "candidate int, ranks array<int>")
    out = named.join(loss, "candidate").withColumn("dimension", effective_dim(F.col("ranks"), F.lit(t), F.lit(n)))
    return out.withColumn("criterion", F.col("loss") + kappa * F.col("dimension") / (t * n))


def roadmap(panel: DataFrame, tuning: K.Tuning, seed: int, lags: int = 1, c: float = 1.0) -> DataFrame:
    """One row of settings from the data: rho, sigma2, q, folds, kappa."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, z = _dense(pdf)
        m = K.roadmap(y, z, lags, tuning, (seed,), c)
        return pd.DataFrame({k: [m[k]] for k in ("rho", "sigma2", "q", "folds", "kappa")})

    return panel.select("t_ix", "unit_ix", "y", "z").groupBy(F.lit(0).alias("k")).applyInPandas(run, "rho double, sigma2 double, q int, folds int, kappa double")


# --- Monte Carlo -----------------------------------------------------------------------------------


def replication_tasks(spark: SparkSession, configs: list[dict], reps: int, master: int = 2024) -> DataFrame:
    """(config, rep, settings): config is the settings' own text, so records of other settings never mix."""
    rows = [(json.dumps(c, sort_keys=True), k) for c in configs for k in range(reps)]
    return spark.createDataFrame(rows, "config string, rep long").withColumn("master", F.lit(master).cast("long"))


def _settings(text: str) -> tuple[dict, K.Tuning]:
    c = json.loads(text)
    names = {"ranks", "q", "folds", "ridge", "sweeps", "restarts", "levels", "tol", "scheme", "radius", "weight_ridge"}
    tuning = K.Tuning(**{k: tuple(v) if k == "ranks" else v for k, v in c.items() if k in names})
    return c, tuning


def replicate(config: str, rep: int, master: int) -> list[tuple]:
    """Simulate one panel, estimate the standard targets, and score them."""
    c, tuning = _settings(config)
    t, n = c["t"], c["n"]
    key = (master, t, n, rep)
    panel = K.simulate(t, n, K.generator(*key), r=c.get("r", 1), rho=c.get("rho", 0.85), noise=c.get("noise", "iid"))
    targets = K.standard_targets(t, n)
    est = K.estimate(panel["y"], panel["z"], targets, tuning, key, panel["spaces"] if c.get("oracle") else None)
    rows = []
    for k, name in enumerate(est["names"]):
        b, d = targets[name]
        truth = float((d * panel["surfaces"][b]).sum())
        err, se, xs = est["estimate"][k] - truth, K.white(est["psi"][k], est["u"]), K.bartlett(est["psi"][k], est["u"])
        rows.append((config, rep, name, float(err), float(est["plugin"][k] - truth), se, xs, int(abs(err) <= Z95 * se), int(abs(err) <= Z95 * xs), est["retained"], bool(est["monotone"])))
    return rows


def run_grid(tasks: DataFrame, partitions: int | None = None) -> DataFrame:
    """Records of all tasks; each task is one panel inside one core."""

    def run(batches):
        for pdf in batches:
            rows = [r for c, k, m in zip(pdf["config"], pdf["rep"], pdf["master"], strict=True) for r in replicate(c, int(k), int(m))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    spread = tasks.repartition(partitions or max(8, tasks.sparkSession.sparkContext.defaultParallelism * 2), "config", "rep")
    return spread.mapInPandas(run, RECORD)


def resume_grid(tasks: DataFrame, path: str) -> DataFrame:
    """Run only tasks without a record under ``path``, append theirs, and return all records."""
    from panelmill.operators.montecarlo import unfinished
    from panelmill.sources.files import read_records

    spark = tasks.sparkSession
    done = read_records(spark, path)
    run_grid(unfinished(tasks, done) if done is not None else tasks).write.mode("append").partitionBy("config").parquet(path)
    return read_records(spark, path)


def purge_configs(base: dict, qs: list[int]) -> list[dict]:
    return [base | {"q": q} for q in qs]


def irf_coverage(tasks: DataFrame, horizons: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """(config, rep, quantity, hit): does the 95 % interval of the lag entry's response cover its truth."""

    def run(batches):
        for pdf in batches:
            rows = []
            for config, rep, master in zip(pdf["config"], pdf["rep"], pdf["master"], strict=True):
                c, tuning = _settings(config)
                key = (int(master), c["t"], c["n"], int(rep))
                panel = K.simulate(c["t"], c["n"], K.generator(*key))
                target = {"lag_fmean": K.standard_targets(c["t"], c["n"])["lag_fmean"]}
                est = K.estimate(panel["y"], panel["z"], target, tuning, key, panel["spaces"] if c.get("oracle") else None)
                a, truth = float(est["estimate"][0]), float((target["lag_fmean"][1] * panel["surfaces"][0]).sum())
                se = K.white(est["psi"][0], est["u"])
                for h in horizons:
                    rows.append((config, int(rep), f"irf{h}", int(abs(a**h - truth**h) <= Z95 * abs(h * a ** (h - 1)) * se)))
                rows.append((config, int(rep), "lrm", int(abs(1 / (1 - a) - 1 / (1 - truth)) <= Z95 * se / (1 - a) ** 2)))
            yield pd.DataFrame(rows, columns=["config", "rep", "quantity", "hit"])

    return tasks.repartition(max(8, 2 * tasks.sparkSession.sparkContext.defaultParallelism), "config", "rep").mapInPandas(run, "config string, rep long, quantity string, hit int")


def rank_choices(tasks: DataFrame, caps: tuple[int, int, int] = (2, 2, 2), c: float = 0.03) -> DataFrame:
    """(config, rep, ranks, hit): the candidate of the full box with the least penalised held-out error."""
    import itertools

    def run(batches):
        for pdf in batches:
            rows = []
            for config, rep, master in zip(pdf["config"], pdf["rep"], pdf["master"], strict=True):
                s, tuning = _settings(config)
                t, n = s["t"], s["n"]
                key = (int(master), t, n, int(rep))
                panel = K.simulate(t, n, K.generator(*key))
                y, z = panel["y"], panel["z"]
                ids = K.fold_ids(t, n, tuning.folds, tuning.scheme, K.generator(*key, 1))
                kappa = K.roadmap(y, z, 1, tuning, key, c)["kappa"]
                table = []
                for k, ranks in enumerate(itertools.product(*(range(m + 1) for m in caps))):
                    loss = 0.0
                    for j in range(tuning.folds):
                        fit = K.fit_factor_ridge(y, z, tuning, K.training_mask(ids == j, tuning.q), K.generator(*key, 4, k, j), ranks)
                        loss += float(((y - sum(fit.surface(b) * z[b] for b in range(3))) ** 2)[ids == j].sum())
                    dim = sum(r * (t + n - r) for r in ranks)
                    table.append((loss / (t * n) + kappa * dim / (t * n), dim, ranks))
                best = min(table)[2]
                rows.append((config, int(rep), str(best), int(best == (1, 1, 1))))
            yield pd.DataFrame(rows, columns=["config", "rep", "ranks", "hit"])

    return tasks.repartition(max(8, 2 * tasks.sparkSession.sparkContext.defaultParallelism), "config", "rep").mapInPandas(run, "config string, rep long, ranks string, hit int")


def information_map(spark: SparkSession, t: int, n: int, folds: int, q: int, scheme: str, radius: int = 0, seed: int = 1) -> DataFrame:
    """Least and greatest eigenvalue of the tangent information matrix and least period support, by fold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        j = int(pdf["j"].iloc[0])
        panel = K.simulate(t, n, K.generator(seed))
        held = K.fold_ids(t, n, folds, scheme, K.generator(seed, 1)) == j
        mask = K.training_mask(held, q, radius)
        z, columns = panel["z"], []
        for b, (u, v) in enumerate(panel["spaces"]):
            left = np.einsum("tk,tn,nm->tnkm", u, z[b], np.eye(n)).reshape(t * n, -1)
            rest = np.eye(t) - u @ u.T
            right = np.einsum("ts,tn,nk->tnsk", rest, z[b], v).reshape(t * n, -1)
            columns += [left, right]
        a = np.hstack(columns) * mask.reshape(-1, 1)
        e = np.linalg.eigvalsh(a.T @ a * (t * n / max(1, int(mask.sum()))))
        # the projected period directions leave one null direction for each rank of each block
        null = sum(u.shape[1] * v.shape[1] for u, v in panel["spaces"])
        low, high = float(e[null]), float(e[-1])
        return pd.DataFrame({"j": [j], "least": [low], "greatest": [high], "condition": [high / max(low, 1e-300)], "min_support": [int(mask.sum(axis=1).min())]})

    return spark.range(folds).select(F.col("id").cast("int").alias("j")).groupBy("j").applyInPandas(run, "j int, least double, greatest double, condition double, min_support int")


def distributed_als(panel: DataFrame, f: DataFrame, lam: DataFrame, ridge: float, sweeps: int, spaces: int) -> tuple[DataFrame, DataFrame]:
    """Alternating ridge for panels too large for a task. panel (t_ix, unit_ix, y, is_train, d ARRAY of the
    designs of each factor column); f (t_ix, v ARRAY), lam (unit_ix, v ARRAY). Each half-sweep is one
    aggregation of normal equations and a batched solve; factors are written to cut the lineage."""
    from panelmill.operators.checkpoints import drop_written, written

    def half(side: str, other: str, factors: DataFrame) -> DataFrame:
        cells = panel.where("is_train").join(factors, other)
        for k in range(spaces):
            cells = cells.withColumn(f"d{k}", F.col("d")[k] * F.col("v")[k])
        pairs = [(a, b) for a in range(spaces) for b in range(a, spaces)]
        sums = cells.groupBy(side).agg(*[F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"g{a}_{b}") for a, b in pairs], *[F.sum(F.col(f"d{a}") * F.col("y")).alias(f"b{a}") for a in range(spaces)])

        def solve(batches):
            for pdf in batches:
                g = np.zeros((len(pdf), spaces, spaces))
                for a, b in pairs:
                    g[:, a, b] = g[:, b, a] = pdf[f"g{a}_{b}"]
                g += ridge * np.eye(spaces)
                x = np.linalg.solve(g, np.stack([pdf[f"b{a}"] for a in range(spaces)], axis=1)[:, :, None])[:, :, 0]
                yield pd.DataFrame({side: pdf[side], "v": list(x)})

        return written(sums.mapInPandas(solve, f"{side} int, v array<double>"), f"als-{side}")

    for k in range(sweeps):
        old = (f, lam) if k else ()
        f = half("t_ix", "unit_ix", lam)
        lam = half("unit_ix", "t_ix", f)
        drop_written(*old)
    return f, lam
