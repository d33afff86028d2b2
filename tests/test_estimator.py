"""Task frames: agreement with the kernels, resume, streaming cells, entry contract."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from panelmill.functions import kernels as K
from panelmill.operators import estimator as E
from panelmill.operators import folds as FD
from panelmill.operators import inference as I
from panelmill.operators import montecarlo as M

ROOT = Path(__file__).parents[1]


@pytest.fixture(scope="module")
def simulated():
    return K.simulate(14, 10, K.generator(3))


@pytest.fixture(scope="module")
def frame(spark, simulated):
    p = simulated
    t, i = np.indices(p["y"].shape)
    return spark.createDataFrame(pd.DataFrame({"t_ix": t.ravel(), "unit_ix": i.ravel(), "y": p["y"].ravel(), "z": [list(map(float, v)) for v in p["z"].reshape(3, -1).T]}))


def test_fold_fits_equal_the_kernel(spark, frame, simulated):
    tuning = K.Tuning(q=1, folds=3, restarts=1, sweeps=20)
    cells = E.surface_cells(E.fit_folds(frame, tuning, 5)).where("j = 1 and block = 0").toPandas()
    ids = K.fold_ids(14, 10, 3, "scatter", K.generator(5, 1))
    fit = K.fit_factor_ridge(simulated["y"], simulated["z"], tuning, K.training_mask(ids == 1, 1), K.generator(5, 2, 1))
    assert np.allclose(fit.surface(0)[cells.t_ix, cells.unit_ix], cells.value)


def test_scores_give_the_kernel_estimate(spark, frame, simulated):
    tuning = K.Tuning(q=1, folds=3, restarts=1, sweeps=20)
    s = E.score_cells(frame, tuning, 5, 1, 1).persist()
    got = I.one_step(s.select("j", "target", "p", "plug").distinct(), s).toPandas().set_index("target")
    want = K.estimate(simulated["y"], simulated["z"], E.panel_targets(14, 10, None, 1, 1), tuning, (5,))
    assert np.allclose(got.loc[want["names"], "estimate"], want["estimate"])
    se = I.white_se(s, 140).toPandas().set_index("target")
    assert np.allclose(se.loc[want["names"], "se"], [K.white(p, want["u"]) for p in want["psi"]])
    xs = I.bartlett_se(s, 140, 4).toPandas().set_index("target")
    assert np.allclose(xs.loc[want["names"], "se"], [K.bartlett(p, want["u"], 4) for p in want["psi"]])


def test_purged_frame_equals_the_kernel(spark):
    ids = K.fold_ids(12, 9, 4, "scatter", K.generator(1))
    t, i = np.indices(ids.shape)
    df = spark.createDataFrame(pd.DataFrame({"t_ix": t.ravel(), "unit_ix": i.ravel(), "fold": ids.ravel()}))
    got = FD.purged(df, 4, 2, 1).toPandas()
    for j in range(4):
        want = K.training_mask(ids == j, 2, 1)
        own = got[got.j == j]
        assert (own.is_train.to_numpy() == want[own.t_ix, own.unit_ix]).all()


def test_scattered_folds_are_near_balanced(spark):
    cells = spark.range(600).selectExpr("cast(id div 20 as int) t_ix", "cast(id % 20 as int) unit_ix")
    sizes = FD.scatter(cells, 6, 3).groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 6 and sizes.min() > 60


def test_grid_does_not_depend_on_partitions_and_resumes(spark, tmp_path):
    base = {"t": 14, "n": 12, "q": 1, "folds": 3, "sweeps": 8, "restarts": 1, "oracle": True}
    few, all_ = E.replication_tasks(spark, [base], 2), E.replication_tasks(spark, [base], 3)
    one, many = (E.run_grid(few, k).orderBy("rep", "target").toPandas() for k in (1, 4))
    assert np.allclose(one["err"], many["err"])
    path = f"file://{tmp_path}/records"
    E.resume_grid(few, path)
    records = E.resume_grid(all_, path)
    assert records.count() == 24
    out = M.aggregate(records).toPandas()
    assert len(out) == 8 and (out["reps"] == 3).all()


def test_distributed_half_sweeps_equal_the_kernel(spark, frame, simulated):
    from pyspark.sql import functions as F

    y = simulated["y"]
    df = frame.select("t_ix", "unit_ix", "y", F.lit(True).alias("is_train"), F.array(F.lit(1.0)).alias("d"))
    ones = lambda k: frame.select(k).distinct().withColumn("v", F.array(F.lit(1.0)))
    f, g = E.distributed_als(df, ones("t_ix"), ones("unit_ix"), 0.02, 2, 1)
    kf, kg, _ = K.alternate(y, np.ones((14, 1)), np.ones((10, 1)), np.ones((1, 14, 10)), np.ones(y.shape, bool), 0.02, 2, 0.0)
    assert np.allclose(sorted(v[0] for v in f.toPandas()["v"]), sorted(kf[:, 0]))
    assert np.allclose(sorted(v[0] for v in g.toPandas()["v"]), sorted(kg[:, 0]))


def test_rank_choices_search_the_box_of_27(spark, sf):
    from panelmill.plans import estimation

    settings = {"t": 16, "n": 14, "q": 1, "folds": 3, "sweeps": 10, "restarts": 1, "levels": 2}
    chosen = [r.ranks for r in E.rank_choices(E.replication_tasks(spark, [settings], 8)).collect()]
    assert len(chosen) == 8 and any("2" in r for r in chosen)
    assert len({tuple(r.ranks) for r in estimation.QUERIES["select_ranks"](spark, sf).collect()}) == 27
    assert estimation.QUERIES["rank_consistency"](spark, sf).first().reps > 2


def test_streaming_cells_equal_batch_cells(spark, sf, tmp_path):
    from panelmill.streaming.cells import batch_cells, streaming_cells

    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = streaming_cells(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, batch_cells(events).collect()))


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "panelmill", tmp_path / "panelmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


def test_native_statistics_equal_the_kernels(spark):
    from panelmill.operators import diagnostics as D

    rng = np.random.default_rng(8)
    y = np.vstack([np.cumsum(rng.normal(size=60)), np.exp(np.cumsum(0.1 * rng.normal(size=60))), rng.normal(size=60), np.full(60, 2.0)])
    a, b = rng.uniform(-0.6, 0.6, y.shape), rng.uniform(-0.4, 0.4, y.shape)
    i, t = np.indices(y.shape)
    pdf = pd.DataFrame({"unit_ix": i.ravel(), "t_ix": t.ravel(), "y": y.ravel(), "a": a.ravel(), "b": b.ravel()})
    short = pd.DataFrame({"unit_ix": 9, "t_ix": range(13), "y": rng.normal(size=13), "a": 0.1, "b": 0.1})
    df = spark.createDataFrame(pd.concat([pdf, short]))
    got = {r.unit_ix: r.t_stat for r in D.adf_statistics(df, "y").collect()}
    want = {k: K.adf_t(np.log(v) if (v > 0).all() else v) for k, v in enumerate(y)}
    assert got[9] == 0.0 and got[3] == 0.0
    assert all(abs(got[k] - want[k]) < 1e-8 for k in range(3))
    gaps = spark.createDataFrame(pd.concat([pdf[pdf.unit_ix == 0].assign(t_ix=lambda x: 2 * x.t_ix), pd.DataFrame({"unit_ix": [0], "t_ix": [3], "y": [float("nan")], "a": [0.0], "b": [0.0]})]))
    assert abs(D.adf_statistics(gaps, "y").first().t_stat - want[0]) < 1e-8
    roots = {r.unit_ix: (r.growth, r.persistence) for r in D.companion_persistence(df.where("unit_ix < 4"), "a", "b").collect()}
    assert D.horizon(df.where("unit_ix < 4")) == 6  # log(60 * 4), not log(60)
    assert min(0.99, max(g for g, _ in roots.values())) == K.persistence([a.T, b.T])
    for k in range(4):
        c = np.zeros((60, 2, 2))
        c[:, 0, 0], c[:, 0, 1], c[:, 1, 0] = a[k], b[k], 1
        best, running = 0.0, c
        for h in range(1, 7):
            running = c[h - 1 :] @ running[: 60 - h + 1] if h > 1 else c
            best = max(best, float(np.linalg.norm(running, ord=2, axis=(1, 2)).max()) ** (1 / h))
        assert abs(roots[k][0] - best) < 1e-10 and roots[k][1] == min(0.99, roots[k][0])
    s = np.linalg.svd(y[:3], compute_uv=False) ** 2
    assert abs(D.first_singular_share(df.where("unit_ix < 3"), "y").first().share - s[0] / s.sum()) < 1e-10


def test_estimates_in_one_pass_equal_the_parts(spark, frame):
    tuning = K.Tuning(q=1, folds=3, restarts=1, sweeps=10)
    s = E.score_cells(frame, tuning, 5, 1, 1, [0, 1, 2], {"both": ("lag1_high", "lag1_low"), "absent": ("lag1_mean", "none")}).toPandas()
    df = spark.createDataFrame(s)
    got = I.estimates(df, 1.96).toPandas().set_index("target")
    parts = I.one_step(df.select("j", "target", "p", "plug").distinct(), df).join(I.white_se(df, 140), "target").join(I.cluster_se(df, 140).withColumnRenamed("se", "xs"), "target").toPandas().set_index("target")
    assert "absent" not in got.index and set(got.index) == set(parts.index)
    for mine, theirs in (("plugin", "plugin"), ("estimate", "estimate"), ("se", "se"), ("se_xs", "xs")):
        assert np.allclose(got[mine], parts.loc[got.index, theirs])
    assert np.isclose(got.estimate["both"], got.estimate["lag1_high"] + got.estimate["lag1_low"])


def test_report_of_a_two_lag_panel(spark):
    from panelmill.plans import applications as A

    p = K.simulate(20, 12, K.generator(4))
    y, z = p["y"], p["z"]
    lag2 = np.vstack([z[0][:1], z[0][:-1]])
    t, i = np.indices(y.shape)
    blocks = np.stack([z[0], lag2, z[1], z[2]])
    df = spark.createDataFrame(pd.DataFrame({"t_ix": t.ravel(), "unit_ix": i.ravel(), "y": y.ravel(), "z": [list(map(float, v)) for v in blocks.reshape(4, -1).T]}))
    tuning = K.Tuning(ranks=(1, 1, 1, 1), q=1, folds=3, restarts=2, sweeps=10, levels=3)
    out = A.report(df, tuning, 3, 1, [0, 1, 2, 3, 4, 5]).toPandas().set_index(["section", "quantity", "grp"])
    e = out["estimate"]
    for g in ("all", "high", "low"):
        assert np.isclose(e["target", "persistence", g], e["target", "lag1", g] + e["target", "lag2", g])
        assert out.loc[("target", "persistence", g), ["se", "se_xs"]].gt(0).all()
    assert np.isclose(e["target", "lag1", "high_minus_low"], e["target", "lag1", "high"] - e["target", "lag1", "low"])
    a, b = e["target", "lag1", "all"], e["target", "lag2", "all"]
    assert np.isclose(e["dynamics", "response_2", "all"], a * a + b) and np.isclose(e["dynamics", "companion_radius", "all"], np.abs(np.roots([1, -a, -b])).max())
    assert np.isclose(e["dynamics", "long_run_multiplier", "all"], 1 / (1 - a - b))
    assert np.isclose(out["se"]["dynamics", "response_1", "all"], out["se"]["target", "lag1", "all"])
    assert e["data", "periods", "all"] == 20 and e["data", "units", "all"] == 12 and e["solver", "restarts", "all"] == 2
    assert {"residual", "fit", "heterogeneity"} <= set(out.index.get_level_values(0))


def test_specifications_of_an_application(spark):
    from panelmill.plans import applications as A

    p = K.simulate(40, 9, K.generator(2))
    t, i = np.indices(p["y"].shape)
    cells = pd.DataFrame({"unit_ix": i.ravel(), "t_ix": t.ravel(), "y": p["y"].ravel(), "x": p["z"][1].ravel()})
    cells.loc[(cells.unit_ix == 4) & (cells.t_ix == 20), "x"] = None
    small = A.Application((1, 0), (1, 0, 1), (1, 2), (A.Spec("A", extras=("ranks",)), A.Spec("C", (0.2, 0.9), matched=True, covariates=True, extras=("covariates", "level"))))
    df = spark.createDataFrame(cells).withColumn("x", __import__("pyspark.sql.functions", fromlist=["x"]).expr("nullif(x, double('NaN'))"))
    out = A.specifications(df, small, ["x"], K.Tuning(q=1, folds=3, sweeps=6, restarts=1, levels=2), 1, diagnostics=False).toPandas()
    e = {(r.spec, r.section, r.quantity): r.estimate for r in out[out.grp == "all"].itertuples()}
    assert e["A", "sample", "units"] == 9 and e["A", "sample", "periods"] == 40
    assert e["C", "sample", "units"] == 8 and e["C", "sample", "periods"] == 28
    rows = out.groupby(["spec", "section"]).size()
    assert rows["A", "rank_selection"] == 4 and rows["C", "robustness"] == 3
    assert np.isclose(e["A", "target", "lag2"], 0) and ("C", "target", "covariate1") in e and ("A", "homogeneous", "beta2") not in e


def test_distance_cells_lose_no_pair(spark):
    from panelmill.plans.relational import distance_pairs

    rng = np.random.default_rng(5)
    points = pd.DataFrame({"unit_ix": range(300), "lat": np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), "lon": rng.uniform(-180, 180, 300)})
    points.loc[0:5, "lat"] = [89.9, 89.5, -89.9, 0.0, 0.0, 60.0]
    points.loc[3:4, "lon"] = [179.9, -179.9]
    df = spark.createDataFrame(points)
    la, lo = np.radians(points["lat"].to_numpy()), np.radians(points["lon"].to_numpy())
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
    for most in (300.0, 1500.0, 4000.0):
        got = sorted((r.i, r.j) for r in distance_pairs(df, most).collect())
        assert got == sorted(zip(*map(list, np.nonzero(km < most)), strict=True))
