"""Bidirectional LSTM in numpy: training by back-propagation through time, batched inference.

Arrays are time-major with the batch last: inputs (T, 4H, B) are already projected, states (T, H, B).
Gates stand in the order input, forget, output, candidate. Sequences of a batch may differ in length;
they are padded at the end, and each is reversed within its own length for the second direction.
"""

from __future__ import annotations

import numpy as np


def soft(z: np.ndarray, out: np.ndarray | None = None, tmp: np.ndarray | None = None) -> np.ndarray:
    """z / (1 + |z|): the squashing function of all gates and cells; unlike tanh it vectorises everywhere."""
    tmp = np.abs(z, out=tmp)
    tmp += np.float32(1)
    return np.divide(z, tmp, out=out)


def squash(z: np.ndarray, h: int, tmp: np.ndarray | None = None) -> None:
    """Gates in place: the first 3h rows to (0, 1), the rest to (-1, 1)."""
    soft(z, z, tmp)
    gates = z[: 3 * h]
    gates *= np.float32(0.5)
    gates += np.float32(0.5)


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of ``soft`` where its value is y."""
    return (1 - np.abs(y)) ** 2


def forward(zx: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, dict]:
    t, h4, b = zx.shape
    h = h4 // 4
    hs, cs, gs = np.zeros((t + 1, h, b), np.float32), np.zeros((t + 1, h, b), np.float32), np.empty_like(zx)
    for k in range(t):
        z = zx[k] + u @ hs[k]
        squash(z, h)
        gs[k] = z
        cs[k + 1] = z[h : 2 * h] * cs[k] + z[:h] * z[3 * h :]
        hs[k + 1] = z[2 * h : 3 * h] * soft(cs[k + 1])
    return hs[1:], {"h": hs, "c": cs, "g": gs}


def backward(dh: np.ndarray, kept: dict, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the projected inputs, gradient of u)."""
    hs, cs, gs = kept["h"], kept["c"], kept["g"]
    t, h, b = dh.shape
    dz, du = np.empty_like(gs), np.zeros_like(u)
    next_h, next_c = np.zeros((h, b), np.float32), np.zeros((h, b), np.float32)
    for k in range(t - 1, -1, -1):
        i, f, o, g = gs[k][:h], gs[k][h : 2 * h], gs[k][2 * h : 3 * h], gs[k][3 * h :]
        total = dh[k] + next_h
        th = soft(cs[k + 1])
        dc = total * o * slope(th) + next_c
        dz[k][:h] = dc * g * 0.5 * slope(2 * i - 1)
        dz[k][h : 2 * h] = dc * cs[k] * 0.5 * slope(2 * f - 1)
        dz[k][2 * h : 3 * h] = total * th * 0.5 * slope(2 * o - 1)
        dz[k][3 * h :] = dc * i * slope(g)
        du += dz[k] @ hs[k].T
        next_h, next_c = u.T @ dz[k], dc * f
    return dz, du


def reversal(lengths: np.ndarray, t: int) -> np.ndarray:
    """(T, B) index that reverses each sequence within its length and keeps its padding."""
    k = np.arange(t)[:, None]
    return np.where(k < lengths[None, :], lengths[None, :] - 1 - k, k)


def reordered(x: np.ndarray, index: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, index[:, None, :], axis=0)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.99**self.step)
            self.params[k] -= ((rate or self.rate) * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def new_params(rng: np.random.Generator, inputs: int, h: int, tags: int) -> dict[str, np.ndarray]:
    """wf, wb: (4H, inputs + 1), the last column is the bias; uf, ub: (4H, H); of, ob: (tags, H); bias; transitions."""
    out = {}
    for d in "fb":
        w = rng.normal(0, 0.3, (4 * h, inputs + 1))
        w[:, -1] = 0
        w[h : 2 * h, -1] = 1
        out["w" + d], out["u" + d], out["o" + d] = w, rng.normal(0, 0.3, (4 * h, h)), rng.normal(0, 0.3, (tags, h))
    out["bias"], out["trans"] = np.zeros(tags), np.zeros((tags, tags))
    return {k: v.astype(np.float32) for k, v in out.items()}


def emissions(p: dict, zf: np.ndarray, zb: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, dict]:
    """(T, tags, B) scores; zf and zb are the projected inputs, zb already reversed."""
    hf, kf = forward(zf, p["uf"])
    hb, kb = forward(zb, p["ub"])
    e = np.einsum("kh,thb->tkb", p["of"], hf) + reordered(np.einsum("kh,thb->tkb", p["ob"], hb), index)
    return e + p["bias"][None, :, None], {"hf": hf, "hb": hb, "kf": kf, "kb": kb}


def emission_grads(p: dict, de: np.ndarray, kept: dict, index: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of all but the projections, and those of both projected inputs."""
    back = reordered(de, index)
    g = {"of": np.einsum("tkb,thb->kh", de, kept["hf"]), "ob": np.einsum("tkb,thb->kh", back, kept["hb"]), "bias": de.sum((0, 2))}
    dzf, g["uf"] = backward(np.einsum("kh,tkb->thb", p["of"], de), kept["kf"], p["uf"])
    dzb, g["ub"] = backward(np.einsum("kh,tkb->thb", p["ob"], back), kept["kb"], p["ub"])
    return g, dzf, dzb


def crf_gradients(e: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of tag paths (T, B), its gradients by emissions and by transitions."""
    t, k, b = e.shape

    def lse(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    a = np.empty_like(e)
    z = np.empty_like(e)
    a[0] = e[0]
    for i in range(1, t):
        a[i] = lse(a[i - 1][:, None] + trans[:, :, None], 0) + e[i]
    z[-1] = 0
    for i in range(t - 2, -1, -1):
        z[i] = lse(trans[:, :, None] + (e[i + 1] + z[i + 1])[None], 1)
    total = lse(a[-1], 0)
    de = np.exp(a + z - total)
    dt = np.zeros_like(trans)
    for i in range(1, t):
        dt += np.exp(a[i - 1][:, None] + trans[:, :, None] + (e[i] + z[i])[None] - total).sum(2)
    cols = np.arange(b)
    gold = e[np.arange(t)[:, None], tags, cols].sum(0)
    de[np.arange(t)[:, None], tags, cols] -= 1
    for i in range(1, t):
        gold += trans[tags[i - 1], tags[i]]
        np.add.at(dt, (tags[i - 1], tags[i]), -1)
    return float((total - gold).mean()), de / b, dt / b


def viterbi(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tag paths (T, B); beyond a sequence's length the path repeats its last tag."""
    t, k, b = e.shape
    score = e[0].copy()
    back = np.zeros((t, k, b), np.int8)
    for i in range(1, t):
        s = score[:, None] + trans[:, :, None]
        best = s.argmax(axis=0)
        new = np.take_along_axis(s, best[None], axis=0)[0] + e[i]
        live = i < lengths
        back[i] = np.where(live, best, np.arange(k)[:, None])
        score = np.where(live, new, score)
    path = np.empty((t, b), np.int8)
    path[-1] = score.argmax(axis=0)
    for i in range(t - 1, 0, -1):
        path[i - 1] = np.take_along_axis(back[i], path[i][None].astype(np.int64), axis=0)[0]
    return path
