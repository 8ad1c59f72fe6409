"""A linear-chain conditional random field over two labels (0 boilerplate, 1 main), in numpy.

Observations are sets of feature names per element. Training maximises the regularised log-likelihood by L-BFGS with
exact gradients from the forward-backward recursion, run over all sequences at once; decoding is Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """``weights``: feature name to the score of label 1 over label 0. ``transitions[a, b]``, ``start``: scores."""

    weights: dict[str, float]
    transitions: np.ndarray
    start: np.ndarray

    def scores(self, elements: list[set[str]]) -> list[float]:
        weights = self.weights
        return [sum([weights[f] for f in x if f in weights]) for x in elements]

    def decode(self, elements: list[set[str]]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to label 0."""
        return self.best_path(self.scores(elements))

    def best_path(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.transitions.tolist()
        zero, one = float(self.start[0]), float(self.start[1]) + scores[0]
        back: list[tuple[bool, bool]] = []
        for s in scores[1:]:
            to_zero, to_one = one + t10 > zero + t00, one + t11 > zero + t01
            back.append((to_zero, to_one))
            zero, one = (one + t10 if to_zero else zero + t00), (one + t11 if to_one else zero + t01) + s
        labels = [int(one > zero)]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


def _likelihood(theta: np.ndarray, x: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], l2: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood and gradient. ``x``: elements by features (dense 0/1). Each group holds sequences of
    about one length, places first: the elements' numbers, the places that exist, the labels there."""
    k = x.shape[1]
    w, trans, start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 : k + 6]
    every = x @ w.astype(np.float32)
    error = np.zeros(x.shape[0], np.float32)
    moves, firsts, value = np.zeros((2, 2)), np.zeros(2), 0.0
    for rows, mask, gold in groups:
        size, n = rows.shape
        s = np.where(mask, every[rows], 0.0)
        a0, a1 = np.empty((size, n)), np.empty((size, n))
        a0[0], a1[0] = start[0], start[1] + s[0]
        for j in range(1, size):
            p, q, m = a0[j - 1], a1[j - 1], mask[j]
            a0[j] = np.where(m, np.logaddexp(p + trans[0, 0], q + trans[1, 0]), p)
            a1[j] = np.where(m, np.logaddexp(p + trans[0, 1], q + trans[1, 1]) + s[j], q)
        z = np.logaddexp(a0[-1], a1[-1])
        b0, b1 = np.zeros((size, n)), np.zeros((size, n))
        for j in range(size - 2, -1, -1):
            p, q, m = b0[j + 1], b1[j + 1] + s[j + 1], mask[j + 1]
            b0[j] = np.where(m, np.logaddexp(trans[0, 0] + p, trans[0, 1] + q), b0[j + 1])
            b1[j] = np.where(m, np.logaddexp(trans[1, 0] + p, trans[1, 1] + q), b1[j + 1])
        marginal = np.where(mask, np.exp(a1 + b1 - z), 0.0)
        ahead, inside = (b0[1:] - z, b1[1:] + s[1:] - z), mask[1:]
        for y, before in enumerate((a0[:-1], a1[:-1])):
            for y2 in (0, 1):
                moves[y, y2] += np.exp(np.where(inside, before + trans[y, y2] + ahead[y2], -np.inf)).sum() - (inside & (gold[:-1] == y) & (gold[1:] == y2)).sum()
        firsts += (1 - marginal[0]).sum() - (gold[0] == 0).sum(), marginal[0].sum() - (gold[0] == 1).sum()
        error[rows[mask]] = (marginal - gold)[mask]
        score = (s * gold)[mask].sum() + start[gold[0]].sum()
        value += z.sum() - score - sum(trans[y, y2] * (inside & (gold[:-1] == y) & (gold[1:] == y2)).sum() for y in (0, 1) for y2 in (0, 1))
    gradient = np.concatenate([x.T @ error, moves.ravel(), firsts]).astype(np.float64)
    return value + l2 * (theta @ theta) / 2, gradient + l2 * theta


def train(sequences: list[list[set[str]]], labels: list[list[int]], l2: float = 1.0, rounds: int = 80, least: int = 3) -> Model:
    """Fit on labelled sequences; features met fewer than ``least`` times are dropped."""
    pairs = [(s, y) for s, y in zip(sequences, labels, strict=True) if s]
    if not pairs:
        return Model({}, np.zeros((2, 2)), np.zeros(2))
    seen: dict[str, int] = {}
    for s, _ in pairs:
        for element in s:
            for f in element:
                seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, n in seen.items() if n >= least)
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((sum(len(s) for s, _ in pairs), len(names)), np.float32)
    at, places = 0, []
    for s, y in pairs:
        places.append((at, np.array(y)))
        for element in s:
            x[at, [index[f] for f in element if f in index]] = 1
            at += 1
    groups, order = [], sorted(range(len(pairs)), key=lambda i: len(places[i][1]))
    while order:  # lengths within a group differ by less than half
        longest = len(places[order[-1]][1])
        own = [i for i in order if 2 * len(places[i][1]) > longest]
        rows, mask, gold = np.zeros((longest, len(own)), np.int64), np.zeros((longest, len(own)), bool), np.zeros((longest, len(own)), np.int64)
        for c, i in enumerate(own):
            begin, y = places[i]
            rows[: len(y), c], mask[: len(y), c], gold[: len(y), c] = np.arange(begin, begin + len(y)), True, y
        groups.append((rows, mask, gold))
        order = order[: len(order) - len(own)]
    theta = _minimise(lambda t: _likelihood(t, x, groups, l2), np.zeros(len(names) + 6), rounds)
    k = len(names)
    return Model(dict(zip(names, theta[:k].tolist(), strict=True)), theta[k : k + 4].reshape(2, 2), theta[k + 4 :])


def _minimise(f, theta: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    value, gradient = f(theta)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, used = gradient.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ direction)
            used.append(a)
            direction -= a * y
        if steps:
            s, y, _ = steps[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.abs(gradient).sum())
        for (s, y, r), a in zip(steps, reversed(used), strict=True):
            direction += s * (a - r * (y @ direction))
        slope, rate = -(gradient @ direction), 1.0
        while True:
            moved = theta - rate * direction
            new_value, new_gradient = f(moved)
            if new_value <= value + 1e-4 * rate * slope or rate < 1e-6:
                break
            rate /= 2
        s, y = moved - theta, new_gradient - gradient
        if s @ y > 1e-10:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
        done = value - new_value < 1e-5 * max(1.0, abs(value))
        theta, value, gradient = moved, new_value, new_gradient
        if done:
            break
    return theta
