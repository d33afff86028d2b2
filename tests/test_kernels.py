"""Identities of the numerical kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.functions import kernels as K


def panel(t=24, n=20, seed=0, **kw):
    return K.simulate(t, n, K.generator(seed), **kw)


def spaces_of(p):
    return p["spaces"]


def project(x, u, v):
    return u @ (u.T @ x) + (x @ v) @ v.T - u @ (u.T @ x @ v) @ v.T


def test_adjoint():
    p, rng = panel(), K.generator(1)
    theta, r = rng.standard_normal(p["z"].shape), rng.standard_normal(p["y"].shape)
    left = float((np.einsum("btn,btn->tn", p["z"], theta) * r).sum())
    assert np.isclose(left, float((theta * (p["z"] * r)).sum()), rtol=1e-10)


def test_forward_exclusion_by_hand():
    ids = np.array([0, 1, 0, 1, 0, 1])[:, None]
    assert K.training_mask(ids == 1, 2).ravel().tolist() == [True] + [False] * 5


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(1, 8), st.integers(0, 4), st.integers(0, 2), st.integers(0, 10_000))
def test_purge_equals_brute_force(t, n, q, r, seed):
    held = np.random.default_rng(seed).random((t, n)) < 0.25
    want = np.array([[not held[max(0, s - q) : s + 1, max(0, i - r) : i + r + 1].any() for i in range(n)] for s in range(t)])
    assert (K.training_mask(held, q, r) == want).all()


def test_objective_never_rises():
    p = panel()
    fit = K.fit_factor_ridge(p["y"], p["z"], K.Tuning(restarts=2), None, K.generator(3))
    assert fit.monotone and all(b <= a * (1 + 1e-8) for a, b in zip(fit.path, fit.path[1:], strict=False))


def test_tangent_projector_is_idempotent_and_self_adjoint():
    rng = K.generator(2)
    u, v = (np.linalg.qr(rng.standard_normal((k, 2)))[0] for k in (15, 12))
    x, y = rng.standard_normal((2, 15, 12))
    px = project(x, u, v)
    assert np.allclose(project(px, u, v), px, atol=1e-10)
    assert np.isclose((px * y).sum(), (x * project(y, u, v)).sum(), rtol=1e-10)


def test_weights_represent_the_target_on_the_tangent_space():
    p, rng = panel(20, 16), K.generator(4)
    t, n = p["y"].shape
    d = np.zeros((t, n))
    d[3, 4] = 1
    psi = K.debiasing_weights([(0, d)], p["z"], p["spaces"], np.ones((t, n), bool), 1.0, 1e-12)[0]
    delta = [project(rng.standard_normal((t, n)), u, v) for u, v in p["spaces"]]
    left = float((psi * np.einsum("btn,btn->tn", p["z"], np.stack(delta))).sum())
    assert np.isclose(left, float((d * delta[0]).sum()), rtol=1e-5, atol=1e-7)


def test_noiseless_recovery():
    p = panel(sd=0.0)
    fit = K.fit_factor_ridge(p["y"], p["z"], K.Tuning(ridge=1e-4, restarts=2, sweeps=200), None, K.generator(5))
    rms = np.sqrt(np.mean((p["y"] - sum(fit.surface(b) * p["z"][b] for b in range(3))) ** 2))
    assert rms < 1e-2


def test_scaled_training_norm_is_near_the_full_one():
    p = panel(18, 14)
    t, n = p["y"].shape
    ids = K.fold_ids(t, n, 6, "scatter", K.generator(6))
    full = float((p["z"] ** 2).sum())
    for j in range(6):
        mask = K.training_mask(ids == j, 2)
        assert 0.3 < float(((p["z"] ** 2) * mask).sum()) * t * n / mask.sum() / full < 3


def test_ranks_of_zero_are_legal():
    p = panel()
    fit = K.fit_factor_ridge(p["y"], p["z"], K.Tuning(restarts=1), None, K.generator(1), (0, 0, 0))
    assert not fit.surface(0).any()
    d = np.ones(p["y"].shape)
    assert not K.debiasing_weights([(0, d)], p["z"], [fit.spaces(b) for b in range(3)], d > 0, 1.0, 1e-8).any()


def test_adf_separates_walks_from_stationary_series():
    rng = np.random.default_rng(0)
    e = rng.standard_normal(400)
    ar = np.zeros(400)
    for k in range(1, 400):
        ar[k] = 0.3 * ar[k - 1] + e[k]
    assert K.adf_t(ar) < -2.86 < K.adf_t(np.cumsum(e)) + 2
    assert K.adf_t(np.arange(12.0)) == 0.0


def test_published_dynamics_agree():
    a, b = 1.250, -0.419
    assert round(a + b, 3) == 0.831 and round(1 / (1 - a - b), 1) == 5.9 and round(np.sqrt(-b), 3) == 0.647


@pytest.mark.parametrize("noise", ["iid", "hetero", "xs"])
def test_innovations_have_the_asked_scale(noise):
    assert abs(K.innovations(300, 60, 0.3, K.generator(1), noise, np.ones((300, 60))).std() - 0.3) < 0.03


def test_oracle_coverage_is_near_nominal():
    tuning, hits = K.Tuning(q=1, restarts=1, sweeps=40), []
    for rep in range(8):
        p = panel(40, 40, seed=100 + rep)
        targets = K.standard_targets(40, 40)
        est = K.estimate(p["y"], p["z"], targets, tuning, (9, rep), p["spaces"])
        for k, name in enumerate(est["names"]):
            b, d = targets[name]
            hits.append(abs(est["estimate"][k] - (d * p["surfaces"][b]).sum()) <= 1.96 * K.white(est["psi"][k], est["u"]))
    assert 0.8 <= np.mean(hits) <= 1.0
