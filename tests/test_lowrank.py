"""Low-rank operators on tables against dense algebra."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import kernels as K
from panelmill.operators import checkpoints
from panelmill.operators import lowrank as W

T, N = 9, 7


def cells_of(spark, x, mask=None, **more):
    t, i = np.nonzero(np.ones(x.shape, bool) if mask is None else mask)
    return spark.createDataFrame(pd.DataFrame({"t_ix": t, "unit_ix": i, "x": x[t, i], **{k: v[..., t, i].T.tolist() if v.ndim == 3 else v[t, i] for k, v in more.items()}})).repartition(3)


def table_of(spark, m, key, name="v", run=None):
    pdf = pd.DataFrame({key: range(len(m)), name: [list(map(float, r)) for r in m]})
    out = spark.createDataFrame(pdf, f"{key} long, {name} array<double>").repartition(3)
    return out if run is None else out.select(F.lit(run).alias("run"), key, name)


def dense(df, key, size=None):
    rows = sorted((r[key], list(r.v)) for r in df.collect())
    return np.array([v for _, v in rows], float).reshape(len(rows), -1 if size is None else size)


def test_tall_r_and_block_svd_equal_dense(spark):
    rng = np.random.default_rng(1)
    f, g = rng.standard_normal((40, 3)), rng.standard_normal((23, 3))
    r = W.tall_r(table_of(spark, f, "t_ix").repartition(9), 3)
    assert np.allclose(r.T @ r, f.T @ f)
    left, right, s = W.block_svd(table_of(spark, f, "t_ix"), table_of(spark, g, "unit_ix"), 3, 2)
    u, v = K._spaces(f, g)
    assert np.allclose(s, np.linalg.svd(f @ g.T, compute_uv=False)[:2])
    assert np.allclose(dense(left, "t_ix"), u[:, :2])
    assert np.allclose(dense(right, "unit_ix"), v[:, :2])
    # a column that repeats: rank 1 of two columns
    left, right, s = W.block_svd(table_of(spark, f[:, [0, 0]], "t_ix"), table_of(spark, g[:, :2], "unit_ix"), 2, 1)
    assert np.allclose(dense(left, "t_ix") * s[0] @ dense(right, "unit_ix").T, f[:, [0, 0]] @ g[:, :2].T)
    assert W.block_svd(table_of(spark, f, "t_ix"), table_of(spark, g, "unit_ix"), 3, 0)[2] == []


def test_leading_vectors_of_sparse_plus_low_rank(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((T, N))
    mask = rng.random((T, N)) < 0.6
    f, g = rng.standard_normal((T, 2)), rng.standard_normal((N, 2))
    left, right, s = W.leading(cells_of(spark, x, mask), 2, (table_of(spark, f, "t_ix"), table_of(spark, g, "unit_ix"), 2), extra=3)
    u, want, vt = np.linalg.svd(x * mask + f @ g.T)
    assert np.allclose(s, want[:2])
    assert np.allclose((dense(left, "t_ix") * s) @ dense(right, "unit_ix").T, (u[:, :2] * want[:2]) @ vt[:2], atol=1e-8)
    share = W.first_singular_share(cells_of(spark, x, mask)).first().share
    sv = np.linalg.svd(x * mask, compute_uv=False) ** 2
    assert share == pytest.approx(sv[0] / sv.sum())
    assert W.first_singular_share(cells_of(spark, np.zeros((3, 2)))).first().share == 0.0


def counted(df, folder):
    """``df`` as it is, from one task that leaves a file in ``folder`` each time it is made."""

    def run(batches):
        (folder / uuid.uuid4().hex).touch()
        yield from batches

    return df.coalesce(1).mapInPandas(run, df.schema)


def times_made(folder):
    return len(list(folder.iterdir()))


def test_singular_vectors_make_the_cells_once(spark, tmp_path):
    x = np.random.default_rng(7).standard_normal((T, N))
    for k, f in enumerate((lambda c: W.leading(c, 1)[0], W.first_singular_share)):
        folder = tmp_path / str(k)
        folder.mkdir()
        f(counted(cells_of(spark, x), folder)).collect()
        assert times_made(folder) == 1


def test_imputation_makes_the_cells_once(spark, tmp_path):
    x = np.outer(np.arange(1.0, T + 1), np.arange(2.0, N + 2))
    f, g, _ = W.soft_impute(counted(cells_of(spark, x), tmp_path), 1, rounds=1)
    assert np.allclose(dense(f, "t_ix") @ dense(g, "unit_ix").T, x) and times_made(tmp_path) == 1


def test_weights_make_what_they_are_given_once(spark, tmp_path):
    rng = np.random.default_rng(8)
    given = [tmp_path / k for k in ("cells", "directions", "u", "v")]
    for folder in given:
        folder.mkdir()
    cells = cells_of(spark, np.ones((T, N)), None, z=np.ones((1, T, N)), is_train=np.ones((T, N), bool))
    directions = cells.select(F.lit("d").alias("target"), F.lit(0).alias("block"), "t_ix", "unit_ix", (F.col("t_ix") + 1.0).alias("w"))
    u, v = spaces(rng, 1)
    frames = cells, directions, table_of(spark, u, "t_ix", "u"), table_of(spark, v, "unit_ix")
    cells, directions, u, v = map(counted, frames, given)
    psi, _ = W.riesz_weights(cells, directions, ["d"], u, v, [0], 1.0, most=2)
    assert psi.count() == T * N
    assert [times_made(f) for f in given] == [1, 1, 1, 1]


def test_soft_impute_equals_kernel(spark):
    rng = np.random.default_rng(3)
    y = np.outer(rng.standard_normal(T), rng.standard_normal(N)) + 0.1 * rng.standard_normal((T, N))
    z = np.stack([rng.standard_normal((T, N)), np.ones((T, N))])
    mask = (np.add.outer(np.arange(T), np.arange(N)) % 4) != 0
    made = W.warm_start(cells_of(spark, y, None, y=y, z=z, is_train=mask), (2, 1), rounds=1)
    f, g = K.warm_factors(y, z, (2, 1), mask, rounds=1)
    for (df, dg, _), own in zip(made, (slice(0, 2), slice(2, 3)), strict=True):
        assert np.allclose(dense(df, "t_ix") @ dense(dg, "unit_ix").T, f[:, own] @ g[:, own].T, atol=1e-7)


def spaces(rng, r):
    return np.linalg.qr(rng.standard_normal((T, max(r, 1))))[0][:, :r], np.linalg.qr(rng.standard_normal((N, max(r, 1))))[0][:, :r]


@pytest.mark.parametrize("rank", [0, 1, 2])
def test_projection_is_dense_and_idempotent(spark, rank):
    rng = np.random.default_rng(4)
    x, (u, v) = rng.standard_normal((T, N)), spaces(rng, rank)
    want = u @ u.T @ x + x @ v @ v.T - u @ u.T @ x @ v @ v.T
    once = W.tangent_project(cells_of(spark, x).withColumnRenamed("x", "value"), table_of(spark, u, "t_ix", "u"), table_of(spark, v, "unit_ix"), rank)
    twice = W.tangent_project(once, table_of(spark, u, "t_ix", "u"), table_of(spark, v, "unit_ix"), rank)
    for df in (once, twice):
        got = np.zeros((T, N))
        for r in df.collect():
            got[r.t_ix, r.unit_ix] = r.value
        assert np.allclose(got, want)


def test_weights_equal_the_dense_solution(spark):
    rng = np.random.default_rng(5)
    t, n = 6, 5
    z = np.stack([rng.standard_normal((t, n)), np.ones((t, n))])
    mask = rng.random((t, n)) < 0.85
    f = [np.linalg.qr(rng.standard_normal((t, 1)))[0] for _ in range(2)]
    g = [np.linalg.qr(rng.standard_normal((n, 1)))[0] for _ in range(2)]
    d = {"mean": (0, np.full((t, n), 1 / (t * n))), "cell": (1, np.eye(t, n, 2)), "none": (0, np.zeros((t, n)))}
    alpha = t * n / mask.sum()
    want = K.debiasing_weights(list(d.values()), z, list(zip(f, g, strict=True)), mask, alpha, 1e-8)
    rows = [(k, b, int(a), int(c), float(w[a, c])) for k, (b, w) in d.items() for a in range(t) for c in range(n) if w[a, c]]
    directions = spark.createDataFrame(rows, "target string, block int, t_ix long, unit_ix long, w double")
    cells = cells_of(spark, z[0], None, z=z, is_train=mask)
    psi, report = W.riesz_weights(cells, directions, list(d), table_of(spark, np.hstack(f), "t_ix", "u"), table_of(spark, np.hstack(g), "unit_ix"), [0, 1], alpha, tol=1e-9, most=40)
    got = np.zeros_like(want)
    for r in psi.collect():
        got[:, r.t_ix, r.unit_ix] = r.psi
    assert np.allclose(got, want, atol=1e-6)
    rows = {r.target: r for r in report.collect()}
    assert all(r.converged for r in rows.values())
    assert rows["none"].iterations == 0 and rows["mean"].iterations > 1 and rows["mean"].rayleigh > 0


def test_runs_of_the_fit_equal_the_kernel(spark):
    rng = np.random.default_rng(6)
    z = np.stack([rng.standard_normal((T, N)), rng.standard_normal((T, N)), np.ones((T, N))])
    y = rng.standard_normal((T, N)) + np.outer(np.arange(T), np.ones(N)) / 3
    masks = [(np.add.outer(np.arange(T), np.arange(N)) % 3) != j for j in range(2)]
    masks[1][:, 2] = False  # a unit that trains nothing
    block, ranks = [0, 1, 2], (1, 1, 1)
    f0, g0 = rng.standard_normal((T, 3)), rng.standard_normal((N, 3))
    runs = np.array([[[j for j in range(2) if masks[j][a, b]] for b in range(N)] for a in range(T)], dtype=object)
    cells = cells_of(spark, y, None, y=y, z=z)
    lookup = spark.createDataFrame([(a, b, [int(x) for x in runs[a, b]]) for a in range(T) for b in range(N)], "t_ix long, unit_ix long, runs array<int>")
    start = [table_of(spark, m, key, run=0).union(table_of(spark, m, key, run=1)) for m, key in ((f0, "t_ix"), (g0, "unit_ix"))]
    f, g, paths = W.fit_factor_ridge(cells.join(lookup, ["t_ix", "unit_ix"]), *start, block, ridge=0.3, levels=2, sweeps=5, tol=0.2, least_sweeps=3)
    for j in range(2):
        a, b = f0, g0
        for level in K.ridge_levels(0.3, 2):
            a, b, path = K.alternate(y, a, b, z[np.repeat(range(3), ranks)], masks[j], float(level), 5 if level == 0.3 else 3, 0.2)
        assert np.allclose(dense(f.where(F.col("run") == j), "t_ix"), a, atol=1e-8)
        assert np.allclose(dense(g.where(F.col("run") == j), "unit_ix"), b, atol=1e-8)
        assert np.allclose(paths[j], path)
    assert min(len(p) for p in paths.values()) < 5  # a run stopped early


def test_restarts_are_numbered_and_chosen(spark):
    f = W.perturbed(table_of(spark, np.ones((4, 2)), "t_ix", run=1), "t_ix", 2, 3, seed=9)
    rows = {(r.run, r.t_ix): list(r.v) for r in f.collect()}
    assert {k for k, _ in rows} == {3, 4, 5}
    assert all(rows[3, t] == [1.0, 1.0] for t in range(4)) and rows[4, 0] != rows[5, 0]
    pick, _ = W.best_runs(f, f, {3: [2.0], 4: [1.0], 5: [1.0]}, 3)
    assert {(r.run, tuple(r.v)) for r in pick.collect()} == {(1, tuple(rows[4, t])) for t in range(4)}


def test_only_own_folders_are_dropped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/given")
    given = spark.read.parquet(f"{tmp_path}/given")
    own = checkpoints.written(given, "own")
    checkpoints.drop_written(given, own)
    assert given.count() == 3
    with pytest.raises(Exception, match="(?i)not|exist"):
        own.count()
