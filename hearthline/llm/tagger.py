"""A bidirectional LSTM over characters with a linear-chain CRF on top, in numpy: tagging and training by Adam."""

from __future__ import annotations

import numpy as np

from hearthline.llm.chain_crf import forward_backward, viterbi
from hearthline.llm.pii_rules import KINDS

#: outside; then begin and inside of each kind
TAGS = 1 + 2 * len(KINDS)
SYMBOLS = 131


def symbols(codes: np.ndarray) -> np.ndarray:
    """1 to 128 for ASCII, 129 for any other character; 0 is padding."""
    return np.where(codes < 128, codes + 1, 129).astype(np.int16)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """States of all steps of x (steps, rows, inputs); with ``keep`` also what the gradient needs."""
    steps, rows, _ = x.shape
    size = wh.shape[0]
    drive = x @ wx + b
    h = c = np.zeros((rows, size), dtype=x.dtype)
    out = np.empty((steps, rows, size), dtype=x.dtype)
    kept = []
    for t in range(steps):
        z = drive[t] + h @ wh
        gates = sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((i, f, o, g, before, tc, h))
        h = o * tc
        out[t] = h
    return (out, kept) if keep else out


def lstm_grad(d_out: np.ndarray, x: np.ndarray, kept: list, wx: np.ndarray, wh: np.ndarray):
    """Gradients of inputs and weights from those of the states."""
    steps, rows, size = d_out.shape
    dz = np.empty((steps, rows, 4 * size))
    dh, dc = np.zeros((rows, size)), np.zeros((rows, size))
    d_wh = np.zeros_like(wh)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d_wh += h.T @ dz[t]
        dh = dz[t] @ wh.T
        dc = dc * f
    flat = dz.reshape(-1, 4 * size)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, d_wh, flat.sum(axis=0)


class Tagger:
    def __init__(self, size: int = 16, inputs: int = 12, seed: int = 3):
        draw = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return draw.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = {"emb": draw.normal(0, 0.5, (SYMBOLS, inputs)), "out": normal(2 * size, TAGS), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for side in "fb":
            self.p |= {f"wx_{side}": normal(inputs, 4 * size), f"wh_{side}": normal(size, 4 * size), f"b_{side}": np.zeros(4 * size)}

    def single(self) -> Tagger:
        """A copy in single precision, for tagging."""
        copy = Tagger.__new__(Tagger)
        copy.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return copy

    def emissions(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        e = p["emb"][x.T]
        h = np.concatenate([lstm(e, p["wx_f"], p["wh_f"], p["b_f"]), lstm(e[::-1], p["wx_b"], p["wh_b"], p["b_b"])[::-1]], axis=2)
        return (h @ p["out"] + p["out_b"]).transpose(1, 0, 2)

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags of windows of symbols (rows, steps)."""
        return viterbi(self.emissions(x), np.full(len(x), x.shape[1]), self.p["trans"])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log likelihood of the tags y, and its gradient."""
        p, (rows, steps) = self.p, x.shape
        e = p["emb"][x.T]
        hf, kf = lstm(e, p["wx_f"], p["wh_f"], p["b_f"], keep=True)
        hb, kb = lstm(e[::-1], p["wx_b"], p["wh_b"], p["b_b"], keep=True)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        emit = (h @ p["out"] + p["out_b"]).transpose(1, 0, 2)
        log_z, marginal, pairs = forward_backward(emit, np.full(rows, steps), p["trans"])
        score = np.take_along_axis(emit, y[..., None].astype(np.int64), 2).sum() + p["trans"][y[:, :-1], y[:, 1:]].sum()
        d_emit = -marginal
        np.put_along_axis(d_emit, y[..., None].astype(np.int64), np.take_along_axis(d_emit, y[..., None].astype(np.int64), 2) + 1, 2)
        d_trans = -pairs
        np.add.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d_emit = d_emit.transpose(1, 0, 2)
        flat = d_emit.reshape(-1, TAGS)
        dh = d_emit @ p["out"].T
        size = hf.shape[2]
        g = {"out": h.reshape(-1, 2 * size).T @ flat, "out_b": flat.sum(axis=0), "trans": d_trans}
        de_f, g["wx_f"], g["wh_f"], g["b_f"] = lstm_grad(dh[:, :, :size], e, kf, p["wx_f"], p["wh_f"])
        de_b, g["wx_b"], g["wh_b"], g["b_b"] = lstm_grad(dh[::-1, :, size:], e[::-1], kb, p["wx_b"], p["wh_b"])
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], x.T, de_f + de_b[::-1])
        return float(score - log_z.sum()) / rows, {k: v / rows for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 150, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
        draw = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            own = draw.choice(len(x), min(batch, len(x)), replace=False)
            _, grad = self.gradient(x[own], y[own])
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self
