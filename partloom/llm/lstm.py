"""A bidirectional LSTM in numpy: forward, backward through time, and Adam. Arrays are time x batch x width."""

from __future__ import annotations

import numpy as np


def init(rng: np.random.Generator, width: int, hidden: int) -> dict[str, np.ndarray]:
    """Parameters of one direction; gates in the order input, forget, output, candidate."""
    p = {"x": rng.normal(0, width**-0.5, (width, 4 * hidden)), "h": rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), "b": np.zeros(4 * hidden)}
    p["b"][hidden : 2 * hidden] = 1
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def forward(p: dict[str, np.ndarray], inputs: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states for inputs already multiplied by p['x']; where the mask is 0 the state stays. keep: what backward needs."""
    steps, batch, hidden = *inputs.shape[:2], p["h"].shape[0]
    h = c = np.zeros((batch, hidden), np.float32)
    out, held = np.empty((steps, batch, hidden), np.float32), []
    for t in range(steps):
        z = inputs[t] + h @ p["h"] + p["b"]
        gates, g = _sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        new = f * c + i * g
        squashed = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            held.append((h, c, i, f, o, g, squashed, m))
        h, c = m * (o * squashed) + (1 - m) * h, m * new + (1 - m) * c
        out[t] = h
    return out, held


def backward(p: dict[str, np.ndarray], held: list, d_out: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of h and b, and of the inputs (after their product with x)."""
    steps, batch, hidden = d_out.shape
    dh = dc = np.zeros((batch, hidden), np.float32)
    d_in = np.empty((steps, batch, 4 * hidden), np.float32)
    d_h = np.zeros_like(p["h"])
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, squashed, m = held[t]
        dh = dh + d_out[t]
        on, dnew = dh * m, dc * m
        dnew = dnew + on * o * (1 - squashed**2)
        z = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), on * squashed * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
        d_in[t] = z
        d_h += h.T @ z
        dh, dc = z @ p["h"].T + dh * (1 - m), dnew * f + dc * (1 - m)
    return {"h": d_h, "b": d_in.sum((0, 1))}, d_in


class Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g**2
            params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def both_ways(params: dict[str, np.ndarray], inputs: tuple[np.ndarray, np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Forward and backward states side by side; inputs: of each direction, in page order. params: keys f_* and r_*."""
    one = {k[2:]: v for k, v in params.items() if k.startswith("f_")}
    two = {k[2:]: v for k, v in params.items() if k.startswith("r_")}
    a, held_a = forward(one, inputs[0], mask, keep)
    b, held_b = forward(two, inputs[1][::-1], mask[::-1], keep)
    return np.concatenate([a, b[::-1]], axis=2), (one, held_a, two, held_b)


def both_back(held: tuple, d_out: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    one, held_a, two, held_b = held
    hidden = one["h"].shape[0]
    grads_a, in_a = backward(one, held_a, np.ascontiguousarray(d_out[:, :, :hidden]))
    grads_b, in_b = backward(two, held_b, np.ascontiguousarray(d_out[::-1, :, hidden:]))
    return {f"f_{k}": v for k, v in grads_a.items()} | {f"r_{k}": v for k, v in grads_b.items()}, in_a, in_b[::-1]
