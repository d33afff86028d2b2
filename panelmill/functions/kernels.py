"""Dense numerical kernels for one panel. They run inside tasks, one panel each, with their own seed.

A panel is y (T, N) and z (B, T, N), the last block of ones. A fit is a pair of stacked factors f (T, R)
and g (N, R) with ``block`` (R,) naming the block of each column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


def generator(*key: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([int(k) for k in key]))


@dataclass(frozen=True)
class Tuning:
    ranks: tuple[int, ...] = (1, 1, 1)
    q: int = 3
    folds: int = 6
    ridge: float = 0.02
    sweeps: int = 80
    restarts: int = 2
    levels: int = 8
    tol: float = 1e-8
    scheme: str = "scatter"
    radius: int = 0
    weight_ridge: float = 1e-8


@dataclass
class Fit:
    f: np.ndarray
    g: np.ndarray
    block: np.ndarray
    path: list[float]
    monotone: bool
    finals: list[float] = field(default_factory=list)

    def surface(self, b: int) -> np.ndarray:
        own = self.block == b
        return self.f[:, own] @ self.g[:, own].T

    def spaces(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Orthonormal left and right spaces of a block, from its thin factors."""
        own = self.block == b
        return _spaces(self.f[:, own], self.g[:, own])


def _spaces(f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not f.shape[1]:
        return f, g
    (qf, rf), (qg, rg) = np.linalg.qr(f), np.linalg.qr(g)
    u, _, vt = np.linalg.svd(rf @ rg.T)
    u, v = qf @ u, qg @ vt.T
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    return u * sign, v * sign


# --- folds -----------------------------------------------------------------------------------------


def fold_ids(t: int, n: int, folds: int, scheme: str, rng: np.random.Generator) -> np.ndarray:
    if scheme == "checker":
        return np.add.outer(np.arange(t), np.arange(n)) % folds
    if scheme == "contiguous":
        return np.repeat(np.minimum(np.arange(t) * folds // t, folds - 1)[:, None], n, axis=1)
    ids = np.arange(t * n) % folds
    rng.shuffle(ids)
    return ids.reshape(t, n)


def training_mask(held: np.ndarray, q: int, radius: int = 0) -> np.ndarray:
    """Cells not held out and not within q periods after and radius units beside a held-out cell."""
    t, n = held.shape
    hits = np.cumsum(np.pad(held.astype(np.int64), ((q + 1, 0), (0, 0))), axis=0)
    near = hits[q + 1 :] - hits[: t]
    wide = np.cumsum(np.pad(near, ((0, 0), (radius + 1, radius))), axis=1)
    near = wide[:, 2 * radius + 1 :] - wide[:, : n] if radius else near
    return near == 0


# --- factor ridge ----------------------------------------------------------------------------------


def warm_factors(y: np.ndarray, z: np.ndarray, ranks: tuple[int, ...], mask: np.ndarray, rounds: int = 4, floor: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Split each cell over its blocks by least norm, fill held-out cells by low-rank rounds, factor."""
    split = z * y / ((z * z).sum(axis=0) + floor)
    fs, gs = [], []
    for part, r in zip(split, ranks, strict=True):
        if not r:
            continue
        filled = np.where(mask, part, 0.0)
        for k in range(rounds + 1):
            u, s, vt = np.linalg.svd(filled, full_matrices=False)
            if k < rounds:
                filled = np.where(mask, part, (u[:, :r] * s[:r]) @ vt[:r])
        root = np.sqrt(s[:r])
        fs.append(u[:, :r] * root)
        gs.append(vt[:r].T * root)
    t, n = y.shape
    return (np.hstack(fs), np.hstack(gs)) if fs else (np.zeros((t, 0)), np.zeros((n, 0)))


def _half(design: np.ndarray, other: np.ndarray, y: np.ndarray, mask: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge rows for one side: design (R, rows, cols), other (cols, R), y and mask (rows, cols)."""
    d = np.transpose(design * other.T[:, None, :], (1, 0, 2))
    m = d * mask[:, None, :]
    a = m @ np.transpose(d, (0, 2, 1))
    a += ridge * np.eye(d.shape[1])
    return np.linalg.solve(a, (m @ y[:, :, None]))[:, :, 0]


def fitted(f: np.ndarray, g: np.ndarray, design: np.ndarray) -> np.ndarray:
    return np.einsum("tk,ktn,nk->tn", f, design, g, optimize=True)


def objective(y, f, g, design, mask, ridge) -> float:
    r = (y - fitted(f, g, design)) * mask
    return 0.5 * float((r * r).sum()) + 0.5 * ridge * (float((f * f).sum()) + float((g * g).sum()))


def alternate(y, f, g, design, mask, ridge: float, sweeps: int, tol: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    flipped, path = np.ascontiguousarray(np.transpose(design, (0, 2, 1))), []
    for _ in range(sweeps):
        f = _half(design, g, y, mask, ridge)
        g = _half(flipped, f, y.T, mask.T, ridge)
        path.append(objective(y, f, g, design, mask, ridge))
        if len(path) > 1 and path[-2] - path[-1] <= tol * max(1.0, abs(path[-2])):
            break
    return f, g, path


def ridge_levels(ridge: float, levels: int) -> np.ndarray:
    return np.geomspace(max(1.0, 50 * ridge), ridge, levels) if levels > 1 else np.array([ridge])


def fit_factor_ridge(y: np.ndarray, z: np.ndarray, tuning: Tuning, mask: np.ndarray | None = None, rng: np.random.Generator | None = None, ranks: tuple[int, ...] | None = None) -> Fit:
    """Annealed alternating ridge from a warm start and perturbed restarts; the least objective wins."""
    ranks = tuple(tuning.ranks if ranks is None else ranks)
    mask = np.ones(y.shape, bool) if mask is None else mask
    rng = rng or generator(0)
    block = np.repeat(np.arange(len(z)), ranks)
    design = z[block]
    f0, g0 = warm_factors(y, z, ranks, mask)
    best, finals = None, []
    for k in range(max(1, tuning.restarts)):
        f, g = (f0, g0) if k == 0 else (f0 + 0.1 * rng.standard_normal(f0.shape), g0 + 0.1 * rng.standard_normal(g0.shape))
        if not len(block):
            path = [objective(y, f, g, design, mask, tuning.ridge)]
        else:
            for level in ridge_levels(tuning.ridge, tuning.levels):
                last = level == tuning.ridge
                f, g, path = alternate(y, f, g, design, mask, float(level), tuning.sweeps if last else max(15, tuning.sweeps // 3), tuning.tol)
        finals.append(path[-1])
        if best is None or path[-1] < best.path[-1]:
            rises = [b - a for a, b in zip(path, path[1:], strict=False)]
            best = Fit(f, g, block, path, all(r <= 1e-9 * max(1.0, abs(path[0])) for r in rises))
    best.finals = finals
    return best


# --- debiasing weights -----------------------------------------------------------------------------


def debiasing_weights(directions: list[tuple[int, np.ndarray]], z: np.ndarray, spaces: list[tuple[np.ndarray, np.ndarray]], mask: np.ndarray, scale: float, ridge: float) -> np.ndarray:
    """Weights (targets, T, N) from one factorisation for all targets.

    A tangent vector of block b is U B' + A V'; in the coordinates (B, A) the normal matrix is the sum over
    cells of g g', where g holds z U in the unit's slots and z V in the period's. Its overlap of both
    parametrisations is a null space, to which the right-hand sides are orthogonal.
    """
    blocks, t, n = z.shape
    used = [b for b in range(blocks) if spaces[b][0].shape[1]]
    block = np.repeat(used, [spaces[b][0].shape[1] for b in used]) if used else np.empty(0, int)
    r = len(block)
    if not r:
        return np.zeros((len(directions), t, n))
    u = np.hstack([spaces[b][0] for b in used])
    v = np.hstack([spaces[b][1] for b in used])
    zu = z[block] * u.T[:, :, None]
    zv = z[block] * v.T[:, None, :]
    w = scale * mask
    size = r * (n + t)

    def matrix(a: np.ndarray, c: np.ndarray, weight: np.ndarray, same: np.ndarray) -> np.ndarray:
        out = np.zeros((size, size))
        unit, period = out[: r * n, : r * n].reshape(n, r, n, r), out[r * n :, r * n :].reshape(t, r, t, r)
        i, s = np.arange(n), np.arange(t)
        unit[i, :, i, :] = np.einsum("ktn,ltn,tn->nkl", a, a, weight, optimize=True) * same
        period[s, :, s, :] = np.einsum("ktn,ltn,tn->tkl", c, c, weight, optimize=True) * same
        cross = (np.einsum("ktn,ltn,tn->nktl", a, c, weight, optimize=True) * same[None, :, None, :]).reshape(r * n, r * t)
        out[: r * n, r * n :], out[r * n :, : r * n] = cross, cross.T
        return out

    m = matrix(zu, zv, w, np.ones((r, r)))
    same = (block[:, None] == block[None, :]).astype(float)
    flat_u, flat_v = np.broadcast_to(u.T[:, :, None], zu.shape), np.broadcast_to(v.T[:, None, :], zv.shape)
    plain = matrix(flat_u, flat_v, np.ones((t, n)), same)
    # largest eigenvalue of the operator itself, by power steps on the tangent space
    x = np.ones(size)
    for _ in range(6):
        x = m @ x
        x /= max(np.linalg.norm(x), 1e-300)
    m += ridge * max(float(x @ (m @ x)), 1e-12) * plain
    rhs = np.zeros((size, len(directions)))
    for k, (b, d) in enumerate(directions):
        own = block == b
        rhs[: r * n, k].reshape(n, r)[:, own] = d.T @ u[:, own]
        rhs[r * n :, k].reshape(t, r)[:, own] = d @ v[:, own]
    values, vectors = np.linalg.eigh(m)
    keep = values > 1e-11 * values[-1]
    x = vectors[:, keep] @ ((vectors[:, keep].T @ rhs) / values[keep][:, None])
    units = x[: r * n].reshape(n, r, -1)
    periods = x[r * n :].reshape(t, r, -1)
    return np.einsum("ktn,nkm->mtn", zu, units, optimize=True) + np.einsum("ktn,tkm->mtn", zv, periods, optimize=True)


# --- estimation ------------------------------------------------------------------------------------


def white(psi: np.ndarray, u: np.ndarray) -> float:
    return math.sqrt(max(float((psi * psi * u * u).sum()), u.size**-2.0))


def bartlett(psi: np.ndarray, u: np.ndarray, bandwidth: int | None = None) -> float:
    v = psi * u
    t, n = v.shape
    b = bandwidth or max(1, round((t + n) ** (1 / 3)))
    total = float((v * v).sum()) + sum(2 * (1 - d / b) * float((v[:, d:] * v[:, : n - d]).sum()) for d in range(1, min(b, n)))
    return math.sqrt(max(total, float(t * n) ** -2.0))


def clustered(psi: np.ndarray, u: np.ndarray) -> float:
    return math.sqrt(max(float(((psi * u).sum(axis=1) ** 2).sum()), u.size**-2.0))


def estimate(y: np.ndarray, z: np.ndarray, targets: dict[str, tuple[int, np.ndarray]], tuning: Tuning, key: tuple[int, ...], true_spaces=None) -> dict:
    """Cross-fitted one-step estimates: plug-in, correction, weights and residuals by held-out cell."""
    t, n = y.shape
    ids = fold_ids(t, n, tuning.folds, tuning.scheme, generator(*key, 1))
    names = list(targets)
    psi, u = np.zeros((len(names), t, n)), np.zeros((t, n))
    est, plug = np.zeros(len(names)), np.zeros(len(names))
    monotone, kept = True, []
    for j in range(tuning.folds):
        held = ids == j
        mask = training_mask(held, tuning.q, tuning.radius)
        fit = fit_factor_ridge(y, z, tuning, mask, generator(*key, 2, j))
        surfaces = [fit.surface(b) for b in range(len(z))]
        residual = y - sum(s * d for s, d in zip(surfaces, z, strict=True))
        spaces = true_spaces or [fit.spaces(b) for b in range(len(z))]
        weights = debiasing_weights([targets[k] for k in names], z, spaces, mask, t * n / max(1, int(mask.sum())), tuning.weight_ridge)
        share = float(held.mean())
        for k, name in enumerate(names):
            b, d = targets[name]
            value = float((d * surfaces[b]).sum())
            plug[k] += share * value
            est[k] += share * value + float((weights[k] * residual)[held].sum())
            psi[k][held] = weights[k][held]
        u[held] = residual[held]
        monotone &= fit.monotone
        kept.append(float(mask.mean()))
    return {"names": names, "estimate": est, "plugin": plug, "psi": psi, "u": u, "monotone": monotone, "retained": float(np.mean(kept)), "fold": ids}


def standard_targets(t: int, n: int) -> dict[str, tuple[int, np.ndarray]]:
    """Entry, first-half mean, full mean and contrast of halves, for the lag and the slope block."""
    at, out = t // 2, {}
    rows = {"gmean": np.where(np.arange(n) < n // 2, 1 / (n // 2), 0.0), "fmean": np.full(n, 1 / n), "contrast": np.where(np.arange(n) < n // 2, 1 / (n // 2), -1 / (n - n // 2)), "entry": np.eye(n)[n // 2]}
    for b, label in ((0, "lag"), (1, "slope")):
        for kind, row in rows.items():
            d = np.zeros((t, n))
            d[at] = row
            out[f"{label}_{kind}"] = (b, d)
    return out


# --- simulation ------------------------------------------------------------------------------------


def smooth_factors(t: int, r: int, positive: bool, phase: float) -> np.ndarray:
    s, p = np.arange(1, t + 1)[:, None] / t, np.arange(r)[None, :]
    wave = np.sin((p + 1) * np.pi * s + phase + 0.3 * p)
    return 0.6 + 0.4 * np.abs(wave) if positive else 0.7 + 0.3 * wave


def scaled_surface(f: np.ndarray, v: np.ndarray, rms: float) -> np.ndarray:
    r = f.shape[1]
    m = (f * (1 - 0.2 * np.arange(r) / max(r, 1))) @ v.T
    return m * (rms / math.sqrt(float((m * m).mean())))


def coherence(v: np.ndarray) -> float:
    return float((v * v).sum(axis=1).max() * len(v) / max(v.shape[1], 1))


def innovations(t: int, n: int, sd: float, rng: np.random.Generator, kind: str, h: np.ndarray) -> np.ndarray:
    e = rng.standard_normal((t, n))
    if kind == "iid":
        return sd * e
    if kind == "hetero":
        s = 0.6 + 0.8 * np.abs(h) / (np.abs(h).mean() + 1e-12)
        return e * s * (sd / s.mean())
    if kind == "xs":
        theta = 0.85
        e[:, 1:] *= math.sqrt(1 - theta * theta)
        for i in range(1, n):
            e[:, i] += theta * e[:, i - 1]
        return sd * e
    raise ValueError(kind)


def simulate(t: int, n: int, rng: np.random.Generator, r: int = 1, rho: float = 0.85, sd: float = 0.30, load: float = 0.3, sd_x: float = 1.0, burn: int = 50, noise: str = "iid", rms_a: float = 0.55, rms: float = 0.50) -> dict:
    """One panel with exact low-rank surfaces (lag, slope, level) and its truth."""
    q, _ = np.linalg.qr(rng.standard_normal((n, 3 * r)))
    va = 0.4 + np.abs(rng.standard_normal((n, r)))
    a = scaled_surface(smooth_factors(t, r, True, 0.0), va / np.linalg.norm(va, axis=0), rms_a)
    a *= min(1.0, 0.92 * rho / np.abs(a).max())
    b = scaled_surface(smooth_factors(t, r, False, 0.7), q[:, r : 2 * r], rms)
    h = scaled_surface(smooth_factors(t, r, False, 1.4), q[:, :r], rms)
    x = load * np.outer(rng.standard_normal(t + burn + 1), rng.standard_normal(n)) + sd_x * rng.standard_normal((t + burn + 1, n))
    x = (x - x[burn + 1 :].mean()) / x[burn + 1 :].std()
    last = 0.1 * rng.standard_normal(n)
    for s in range(burn + 1):
        last = a[0] * last + x[s] * b[0] + h[0] + sd * rng.standard_normal(n)
    u = innovations(t, n, sd, rng, noise, h)
    y, lag = np.empty((t, n)), np.empty((t, n))
    for s in range(t):
        lag[s] = last
        last = y[s] = a[s] * last + x[burn + 1 + s] * b[s] + h[s] + u[s]
    z = np.stack((lag, x[burn + 1 :], np.ones((t, n))))
    spaces = []
    for m in (a, b, h):
        w, _, vt = np.linalg.svd(m, full_matrices=False)
        spaces.append((w[:, :r], vt[:r].T))
    return {"y": y, "z": z, "surfaces": [a, b, h], "spaces": spaces, "u": u}


# --- settings from data ----------------------------------------------------------------------------


def persistence(surfaces: list[np.ndarray]) -> float:
    """Largest growth per period over windows: geometric mean of |a| for one lag, companion products else."""
    t, n = surfaces[0].shape
    horizon = min(max(1, math.ceil(math.log(t * n))), t)
    if len(surfaces) == 1:
        sums = np.cumsum(np.vstack((np.zeros((1, n)), np.log(np.maximum(np.abs(surfaces[0]), 1e-12)))), axis=0)
        return min(0.99, max(float(np.exp(((sums[h:] - sums[:-h]) / h).max())) for h in range(1, horizon + 1)))
    p, best = len(surfaces), 0.0
    c = np.zeros((t, n, p, p))
    c[:, :, 0, :] = np.stack(surfaces, axis=-1)
    c[:, :, np.arange(1, p), np.arange(p - 1)] = 1.0
    running = c
    for h in range(1, horizon + 1):
        if h > 1:
            running = c[h - 1 :] @ running[: t - h + 1]
        best = max(best, float(np.linalg.norm(running, ord=2, axis=(2, 3)).max()) ** (1 / h))
    return min(0.99, best)


def roadmap(y: np.ndarray, z: np.ndarray, lags: int, tuning: Tuning, key: tuple[int, ...], c: float = 1.0, keep: float = 0.45, fallback_largest: bool = False) -> dict:
    """Window, folds, rank caps and penalty from a rank-2 working fit."""
    t, n = y.shape
    work = (2,) * len(z)
    fit = fit_factor_ridge(y, z, tuning, None, generator(*key, 3), work)
    surfaces = [fit.surface(b) for b in range(len(z))]
    sigma2 = float(np.var(y - sum(s * d for s, d in zip(surfaces, z, strict=True))))
    rho = persistence(surfaces[:lags])
    q = min(8, math.ceil(math.log(t * n) / max(abs(math.log(rho)), 1e-6)))
    fits = [j for j in (6, 8, 10, 12) if (1 - 1 / j) ** ((q + 1) * (2 * tuning.radius + 1)) >= keep]
    j = fits[0] if fits else 12 if fallback_largest else 6
    kappa = c * sigma2 * (t * n) ** 0.125 * max(1.0, math.log(math.log(t * n))) * math.sqrt(math.log(t * n * j)) / math.sqrt(1 / t + 1 / n)
    return {"rho": rho, "sigma2": sigma2, "q": int(q), "folds": int(j), "kappa": kappa, "caps": work}


def adf_t(y: np.ndarray, p: int = 4) -> float:
    """t value of the lagged level in the augmented regression; short series give 0."""
    y = np.asarray(y, float)
    d = np.diff(y)
    if len(d) <= p + 8:
        return 0.0
    rows = np.arange(p, len(d))
    x = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - k] for k in range(1, p + 1)]])
    beta, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
    e = d[rows] - x @ beta
    cov = np.linalg.pinv(x.T @ x) * (e @ e) / max(1, len(rows) - x.shape[1])
    return float(beta[1] / math.sqrt(cov[1, 1])) if cov[1, 1] > 0 else 0.0
