"""Small bidirectional recurrent networks in numpy: a gated unit (GRU) and an LSTM with a CRF on top, trained by Adam.

Inputs are symbols (T, B): time first, one column for each window. A symbol's share of the gates is a row of a table, so
there is no separate embedding. The last symbol is padding: states are zero there.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


class Gru:
    """One direction. z: update, r: reset, n: proposal; h += z * (n - h)."""

    gates = 3

    @staticmethod
    def run(p: dict, x: np.ndarray, live: np.ndarray, keep: list) -> np.ndarray:
        """States (T, B, H) for time running forward; keep gets what backward() needs."""
        size = p["u"].shape[0]
        h = np.zeros((x.shape[1], size), F32)
        out = np.empty((*x.shape, size), F32)
        u, un = np.ascontiguousarray(p["u"][:, : 2 * size]), np.ascontiguousarray(p["u"][:, 2 * size :])
        for t in range(len(x)):
            gate = p["x"][x[t]]
            zr = _sigmoid(gate[:, : 2 * size] + h @ u)
            z, r = zr[:, :size], zr[:, size:]
            n = np.tanh(gate[:, 2 * size :] + (r * h) @ un)
            keep.append((h, z, r, n))
            h = h + z * (n - h)
            if not live[t].all():
                h *= live[t][:, None]
            out[t] = h
        return out

    @staticmethod
    def predict(p: dict, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The states of run() as (T, H, B), so that each gate is one block of memory. Sigmoids are taken as the tanh of half their sums."""
        size, wide = p["u"].shape[0], x.shape[1]
        by = np.repeat(np.array([0.5, 1], F32), [2 * size, size])
        table, u = np.ascontiguousarray((p["x"] * by).T), np.ascontiguousarray((p["u"] * by).T)
        h, n, r = np.zeros((size, wide), F32), np.empty((size, wide), F32), np.empty((size, wide), F32)
        gate, zr = np.empty((3 * size, wide), F32), np.empty((2 * size, wide), F32)
        out = np.empty((len(x), size, wide), F32)
        full = live.all(axis=1)
        for t in range(len(x)):
            np.take(table, x[t], axis=1, out=gate, mode="clip")
            np.matmul(u[: 2 * size], h, out=zr)
            zr += gate[: 2 * size]
            np.tanh(zr, out=zr)
            zr += F32(1)
            zr *= F32(0.5)
            np.multiply(zr[size:], h, out=r)
            np.matmul(u[2 * size :], r, out=n)
            n += gate[2 * size :]
            np.tanh(n, out=n)
            n -= h
            n *= zr[:size]
            h = np.add(h, n, out=out[t])
            if not full[t]:
                h *= live[t]
        return out

    @staticmethod
    def back(p: dict, x: np.ndarray, live: np.ndarray, keep: list, grad: np.ndarray) -> dict:
        size = p["u"].shape[0]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        later = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n = keep[t]
            d = (grad[t] + later) * live[t][:, None]
            dn = d * z * (1 - n * n)
            dz = d * (n - h) * z * (1 - z)
            back = dn @ p["u"][:, 2 * size :].T
            dr = back * h * r * (1 - r)
            both = np.concatenate([dz, dr], axis=1)
            later = d * (1 - z) + back * r + both @ p["u"][:, : 2 * size].T
            g["u"][:, : 2 * size] += h.T @ both
            g["u"][:, 2 * size :] += (r * h).T @ dn
            np.add.at(g["x"], x[t], np.concatenate([both, dn], axis=1))
        return g


class Lstm:
    """One direction. i, f, o: input, forget, output; c = f * c + i * g; h = o * tanh(c)."""

    gates = 4

    @staticmethod
    def run(p: dict, x: np.ndarray, live: np.ndarray, keep: list) -> np.ndarray:
        size = p["u"].shape[0]
        h = c = np.zeros((x.shape[1], size), F32)
        out = np.empty((*x.shape, size), F32)
        for t in range(len(x)):
            gate = p["x"][x[t]]
            gate += h @ p["u"]
            ifo, g = _sigmoid(gate[:, : 3 * size]), np.tanh(gate[:, 3 * size :])
            i, f, o = ifo[:, :size], ifo[:, size : 2 * size], ifo[:, 2 * size :]
            old, c = c, f * c + i * g
            if not live[t].all():
                c = c * live[t][:, None]
            s = np.tanh(c)
            keep.append((h, old, i, f, o, g, s))
            h = o * s
            out[t] = h
        return out

    @staticmethod
    def predict(p: dict, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The states of run() as (T, H, B); sigmoids are taken as the tanh of half their sums."""
        size, wide = p["u"].shape[0], x.shape[1]
        by = np.repeat(np.array([0.5, 1], F32), [3 * size, size])
        table, u = np.ascontiguousarray((p["x"] * by).T), np.ascontiguousarray((p["u"] * by).T)
        h, c, s = np.zeros((size, wide), F32), np.zeros((size, wide), F32), np.empty((size, wide), F32)
        seen, gate = np.empty((4 * size, wide), F32), np.empty((4 * size, wide), F32)
        out = np.empty((len(x), size, wide), F32)
        full = live.all(axis=1)
        for t in range(len(x)):
            np.take(table, x[t], axis=1, out=seen, mode="clip")
            np.matmul(u, h, out=gate)
            gate += seen
            np.tanh(gate, out=gate)
            ifo = gate[: 3 * size]
            ifo += F32(1)
            ifo *= F32(0.5)
            c *= gate[size : 2 * size]
            np.multiply(gate[:size], gate[3 * size :], out=s)
            c += s
            if not full[t]:
                c *= live[t]
            np.tanh(c, out=s)
            h = np.multiply(gate[2 * size : 3 * size], s, out=out[t])
        return out

    @staticmethod
    def back(p: dict, x: np.ndarray, live: np.ndarray, keep: list, grad: np.ndarray) -> dict:
        out = {k: np.zeros_like(v) for k, v in p.items()}
        later = carry = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, old, i, f, o, g, s = keep[t]
            d = grad[t] + later
            dc = (d * o * (1 - s * s) + carry) * live[t][:, None]
            gate = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), d * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            carry, later = dc * f, gate @ p["u"].T
            out["u"] += h.T @ gate
            np.add.at(out["x"], x[t], gate)
        return out


class Tagger:
    """Both directions and a linear layer: scores (T, B, labels) of every position."""

    def __init__(self, cell: type, symbols: int, labels: int, size: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(F32)
        self.cell, self.pad = cell, symbols
        self.params = {}
        for side in "fb":
            self.params[f"{side}.x"] = draw(symbols + 1, cell.gates * size, by=0.3)
            self.params[f"{side}.u"] = draw(size, cell.gates * size, by=size**-0.5)
            self.params[f"{side}.v"] = draw(size, labels, by=size**-0.5)
        self.params["c"] = np.zeros(labels, F32)

    def _side(self, side: str) -> dict:
        return {k: self.params[f"{side}.{k}"] for k in ("x", "u")}

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The scores as (T, labels, B)."""
        live = (x != self.pad).astype(F32)
        total = np.zeros((len(x), len(self.params["c"]), x.shape[1]), F32) + self.params["c"][:, None]
        for side in "fb":
            step = 1 if side == "f" else -1
            total += np.matmul(self.params[f"{side}.v"].T, self.cell.predict(self._side(side), x[::step], live[::step]))[::step]
        return total

    def scores(self, x: np.ndarray, keep: dict) -> np.ndarray:
        live = (x != self.pad).astype(F32)
        total = self.params["c"]
        for side in "fb":
            step = 1 if side == "f" else -1
            kept: list = []
            h = self.cell.run(self._side(side), x[::step], live[::step], kept)
            keep[side] = (h, kept)
            total = total + (h @ self.params[f"{side}.v"])[::step]
        return total

    def gradients(self, x: np.ndarray, keep: dict, grad: np.ndarray) -> dict:
        """Of all parameters, from the gradient of the scores."""
        live = (x != self.pad).astype(F32)
        out = {"c": grad.sum(axis=(0, 1))}
        for side in "fb":
            step = 1 if side == "f" else -1
            h, kept = keep[side]
            d = np.ascontiguousarray(grad[::step])
            out[f"{side}.v"] = np.einsum("tbh,tbl->hl", h, d)
            for k, v in self.cell.back(self._side(side), x[::step], live[::step], kept, d @ self.params[f"{side}.v"].T).items():
                out[f"{side}.{k}"] = v
        return out


class Adam:
    def __init__(self, params: dict, rate: float) -> None:
        self.params, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.n += 1
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        shrink = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * F32(shrink)
            self.m[k] = F32(0.9) * self.m[k] + F32(0.1) * g
            self.v[k] = F32(0.99) * self.v[k] + F32(0.01) * g * g
            m, v = self.m[k] / (1 - 0.9**self.n), self.v[k] / (1 - 0.99**self.n)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def windows(lengths: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of windows that cover every text; each starts `stride` after the one before."""
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - size) // stride)), 0)
    text = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride
    return text, start, np.minimum(size, lengths[text] - start)


def cut(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int, pad: int) -> np.ndarray:
    """The windows as columns of symbols (size, windows)."""
    at = begin + np.arange(size)[:, None]
    return np.where(np.arange(size)[:, None] < length, flat[np.minimum(at, max(len(flat) - 1, 0))], pad)
