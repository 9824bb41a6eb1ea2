"""A linear-chain conditional random field over padded sequences, in numpy: likelihood, marginals, Viterbi."""

from __future__ import annotations

import numpy as np


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the sequences by falling length, and how many reach each step."""
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max(initial=0))
    return order, np.searchsorted(-lengths[order], -np.arange(steps), side="left")


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, state marginals and summed pair marginals of sequences sorted by falling length.

    ``emit`` has shape (sequences, steps, labels); entries beyond a length are ignored.
    """
    n, steps, k = emit.shape
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    alpha = np.full((n, steps, k), -1e30)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, steps):
        m = live[t]
        alpha[:m, t] = lse(alpha[:m, t - 1, :, None] + trans, 1) + emit[:m, t]
    beta = np.zeros((n, steps, k))
    for t in range(steps - 2, -1, -1):
        m = live[t + 1]
        beta[:m, t] = lse(trans + (emit[:m, t + 1] + beta[:m, t + 1])[:, None, :], 2)
    log_z = lse(alpha[np.arange(n), lengths - 1], 1)
    inside = np.arange(steps)[None, :] < lengths[:, None]
    marginal = np.exp(np.where(inside[..., None], alpha + beta - log_z[:, None, None], -1e30))
    pairs = np.zeros((k, k))
    for t in range(1, steps):
        m = live[t]
        pairs += np.exp(
            alpha[:m, t - 1, :, None] + trans + (emit[:m, t] + beta[:m, t])[:, None, :] - log_z[:m, None, None]
        ).sum(axis=0)
    return log_z, marginal, pairs


def viterbi(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label of each step of sequences sorted by falling length; ties go to the smaller label."""
    n, steps, k = emit.shape
    best = np.zeros((n, steps), dtype=np.int8)
    if not n or not steps:
        return best
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    back = np.zeros((n, steps, k), dtype=np.int8)
    score = emit[:, 0].copy()
    final = score.copy()
    for t in range(1, steps):
        m = live[t]
        options = score[:m, :, None] + trans
        back[:m, t] = options.argmax(axis=1)
        score = options.max(axis=1) + emit[:m, t]
        final[:m] = score
    state = final.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        best[:m, t] = state[:m]
        if t:
            state[:m] = back[np.arange(m), t, state[:m]]
    return best
