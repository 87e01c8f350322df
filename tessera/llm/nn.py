"""Gated recurrent networks in numpy: forward, backpropagation through time, Adam.

Arrays are feature-major, (features, batch), so that every gate is a contiguous block.  The gates'
rows are update, reset, candidate; with z, r the logistic gates and c the candidate,

    c = tanh(x_c + r * (U_c h)),   h' = z * h + (1 - z) * c
"""

from __future__ import annotations

import numpy as np

F4 = np.float32


def init(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale if scale is not None else shape[-1] ** -0.5)).astype(F4)


def run(x: np.ndarray, u: np.ndarray, reverse: bool = False) -> tuple[np.ndarray, tuple]:
    """x (T, 3H, B): input parts of the gates.  Returns states (T, H, B) and what backward() needs."""
    steps, three, b = x.shape
    h = three // 3
    states, z_, r_, c_, g_ = (np.empty((steps, h, b), F4) for _ in range(5))
    prev = np.empty((steps, h, b), F4)
    s = np.zeros((h, b), F4)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        prev[t] = s
        g = u @ s
        zr = 0.5 * np.tanh(0.5 * (x[t, : 2 * h] + g[: 2 * h])) + 0.5
        z, r = zr[:h], zr[h:]
        c = np.tanh(x[t, 2 * h :] + r * g[2 * h :])
        s = c + z * (s - c)
        states[t], z_[t], r_[t], c_[t], g_[t] = s, z, r, c, g[2 * h :]
    return states, (prev, z_, r_, c_, g_)


def back(d: np.ndarray, cache: tuple, u: np.ndarray, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """d (T, H, B): loss by state.  Returns the loss by x and by u."""
    prev, z_, r_, c_, g_ = cache
    steps, h, b = d.shape
    dx, dg = np.empty((steps, 3 * h, b), F4), np.empty((3 * h, b), F4)
    du, carry = np.zeros_like(u), np.zeros((h, b), F4)
    for t in range(steps) if reverse else range(steps - 1, -1, -1):
        ds = d[t] + carry
        z, r, c, s = z_[t], r_[t], c_[t], prev[t]
        dc = ds * (1 - z) * (1 - c * c)
        dx[t, 2 * h :] = dc
        dg[2 * h :] = dc * r
        dg[:h] = dx[t, :h] = ds * (s - c) * z * (1 - z)
        dg[h : 2 * h] = dx[t, h : 2 * h] = dc * g_[t] * r * (1 - r)
        du += dg @ s.T
        carry = ds * z + u.T @ dg
    return dx, du


def halved(table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights for states(): logistic gates become tanh there.  table (3H, V), u (3H, H)."""
    h = u.shape[1]
    t, w = table.astype(F4).copy(), u.astype(F4).copy()
    t[: 2 * h] *= 0.5
    w *= 0.5
    return np.ascontiguousarray(t), np.ascontiguousarray(w)


def states(table: np.ndarray, u: np.ndarray, idx: np.ndarray, reverse: bool = False, every: bool = True) -> np.ndarray:
    """Inference over looked-up inputs: idx (T, B) into the columns of a halved() table.

    Returns all states (T, H, B), or the last one (H, B) if not every.
    """
    steps, b = idx.shape
    h = u.shape[1]
    s = np.zeros((h, b), F4)
    out = np.empty((steps, h, b), F4) if every else None
    g, x = np.empty((3 * h, b), F4), np.empty((3 * h, b), F4)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        np.take(table, idx[t], axis=1, out=x, mode="clip")
        np.matmul(u, s, out=g)
        zr = x[: 2 * h]
        zr += g[: 2 * h]
        np.tanh(zr, out=zr)
        z, r = zr[:h], zr[h:]
        r += 1
        r *= g[2 * h :]
        r += x[2 * h :]
        np.tanh(r, out=r)
        z += 1
        z *= 0.5
        s -= r
        s *= z
        s += r
        if every:
            out[t] = s
    return out if every else s


def scatter(idx: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Sum the columns of d (rows, N) by idx (N): (rows, size)."""
    return np.stack([np.bincount(idx, weights=row, minlength=size) for row in d]).astype(F4)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], share: float = 1.0) -> None:
        """share scales the learning rate; gradients are clipped to norm 1 together."""
        self.t += 1
        norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values())))
        clip = min(1.0, 1.0 / (norm + 1e-12))
        a = self.rate * share * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * F4(clip)
            self.m[k] += F4(0.1) * (g - self.m[k])
            self.v[k] += F4(0.001) * (g * g - self.v[k])
            self.p[k] -= (a * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(F4)
