"""A linear-chain conditional random field of two states, ordinary (0) and toxic (1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Cells of a padded group of sequences.
AREA = 1_000_000


@dataclass(frozen=True)
class Chain:
    """emit[f]: log-odds of toxic of a token with feature f; step[i, j]: log-weight of state j after i; first: log-odds at the start."""

    emit: np.ndarray
    step: np.ndarray
    first: float

    def marginals(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of each token, by forward and backward odds."""
        out: list[np.ndarray] = [np.empty(0)] * len(sequences)
        for at, padded, lengths in grouped(sequences):
            forward, backward = self._odds(padded, lengths)
            odds = forward * backward
            p = odds / (1.0 + odds)
            for row, k in enumerate(at):
                out[k] = p[: lengths[row], row]
        return out

    def _odds(self, padded: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds of toxic, by place and sequence. Sequences fall in length, so place t holds the first ones."""
        m = np.exp(self.step)
        e = np.exp(self.emit)[padded]
        held = np.searchsorted(-lengths, -np.arange(len(padded)), side="left")  # sequences longer than t
        f, b = np.ones_like(e), np.ones_like(e)
        f[0] = e[0] * np.exp(self.first)
        for t in range(1, len(padded)):
            k = held[t]
            r = f[t - 1, :k]
            f[t, :k] = e[t, :k] * (r * m[1, 1] + m[0, 1]) / (r * m[1, 0] + m[0, 0])
        for t in range(len(padded) - 2, -1, -1):
            k = held[t + 1]
            g = e[t + 1, :k] * b[t + 1, :k]
            b[t, :k] = (m[1, 1] * g + m[1, 0]) / (m[0, 1] * g + m[0, 0])
        return f, b

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected counts of toxic tokens by feature, of steps, and of toxic starts."""
        m = np.exp(self.step)
        emits, steps, first = np.zeros(len(self.emit)), np.zeros((2, 2)), 0.0
        for _, padded, lengths in grouped(sequences):
            f, b = self._odds(padded, lengths)
            real = np.arange(len(padded))[:, None] < lengths
            p = f * b / (1.0 + f * b)
            emits += np.bincount(padded[real], p[real], len(self.emit))
            first += p[0].sum()
            g = np.exp(self.emit)[padded[1:]] * b[1:]
            # one state after the other, so that few arrays of this size are held
            g0, f0 = m[0, 1] * g, f[:-1] * m[1, 0]
            g *= f[:-1]
            g *= m[1, 1]
            each = g0 + f0
            each += g
            each += m[0, 0]
            np.divide(real[1:], each, out=each)
            steps += [[m[0, 0] * each.sum(), np.vdot(g0, each)], [np.vdot(f0, each), np.vdot(g, each)]]
        return emits, steps, first


def grouped(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices, padded features (place x sequence) and lengths of groups of sequences of like length, empty ones left out."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[: int((lengths > 0).sum())]
    begin = 0
    while begin < len(order):
        longest = int(lengths[order[begin]])
        at = order[begin : begin + max(1, AREA // longest)]
        at = at[lengths[at] * 4 >= longest]
        padded = np.zeros((longest, len(at)), np.int32)
        for column, k in enumerate(at):
            padded[: lengths[k], column] = sequences[k]
        yield at, padded, lengths[at]
        begin += len(at)


def fit(sequences: list[np.ndarray], tags: list[np.ndarray], n_features: int, rounds: int = 80, rate: float = 0.3, penalty: float = 0.5) -> Chain:
    """Maximum a-posteriori weights by Adam on the exact gradient: observed minus expected counts."""
    emits, steps, first = np.zeros(n_features), np.zeros((2, 2)), 0.0
    for s, y in zip(sequences, tags):
        if len(s):
            emits += np.bincount(s, y, n_features)
            np.add.at(steps, (y[:-1], y[1:]), 1)
            first += y[0]
    weights = np.zeros(n_features + 5)
    weights[0] = -2.0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    scale = np.sqrt(sum(map(len, sequences)) + 1.0)
    for k in range(1, rounds + 1):
        chain = Chain(weights[:n_features], weights[n_features : n_features + 4].reshape(2, 2), float(weights[-1]))
        e, s, f = chain.expected(sequences)
        gradient = (np.concatenate([emits - e, (steps - s).ravel(), [first - f]]) - penalty * weights) / scale
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights = weights + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Chain(weights[:n_features], weights[n_features : n_features + 4].reshape(2, 2), float(weights[-1]))
