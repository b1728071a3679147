"""Two-state linear-chain conditional random fields over streams of sequences.

Messages are kept as ratios of state 1 to state 0. They follow linear fractional recursions, which compose, so a stream
of any number of sequences of any length is worked off in columns.
"""

from __future__ import annotations

import numpy as np

WIDTH = 256  # columns of the recursions


def recursion(a, b, c, d) -> np.ndarray:
    """``x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t])``; where a = c = 0 the chain starts anew."""
    n = len(a)
    if not n:
        return np.zeros(0)
    rows = -(-n // WIDTH)
    pad = rows * WIDTH - n
    a, b, c, d = (np.r_[v, np.full(pad, f)].reshape(rows, WIDTH).T.copy()
                  for v, f in zip((a, b, c, d), (1.0, 0.0, 0.0, 1.0)))
    p, q, r, s = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()  # the steps of a row so far, as one
    for t in range(1, WIDTH):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        if t % 4 == 0:
            top = p + q + r + s
            p, q, r, s = p / top, q / top, r / top, s / top
    x = np.empty(rows)
    now = 0.0
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        x[i] = now
        now = (pi * now + qi) / (ri * now + si)
    out = np.empty((WIDTH, rows))
    for t in range(WIDTH):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.ravel()[:n]


def messages(logits: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission, forward and backward ratio of each token; ``logits`` favour state 1, ``move`` holds 2 x 2 log weights,
    ``first`` the first token of each sequence and the end."""
    e = np.exp(np.clip(logits, -30, 30))
    m = np.exp(move)
    opens = np.unique(first[:-1][first[1:] > first[:-1]])
    a, b, c, d = e * m[1, 1], e * m[0, 1], np.full(len(e), m[1, 0]), np.full(len(e), m[0, 0])
    a[opens], b[opens], c[opens], d[opens] = 0.0, e[opens], 0.0, 1.0
    forward = recursion(a, b, c, d)
    follow = np.r_[e[1:], 1.0][:len(e)]
    a, b, c, d = follow * m[1, 1], np.full(len(e), m[1, 0]), follow * m[0, 1], np.full(len(e), m[0, 0])
    closes = np.r_[opens[1:] - 1, len(e) - 1] if len(e) else opens
    a[closes], b[closes], c[closes], d[closes] = 0.0, 1.0, 0.0, 1.0
    return e, forward, recursion(a[::-1], b[::-1], c[::-1], d[::-1])[::-1]


def marginals(logits: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of state 1 of each token."""
    _, forward, backward = messages(logits, move, first)
    odds = forward * backward
    return odds / (1 + odds)


def fit(weights: np.ndarray, move: np.ndarray, logits, gradient, label: np.ndarray, first: np.ndarray,
        rounds: int = 80, rate: float = 0.15, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights that maximise the conditional likelihood of ``label`` (Adam). ``logits(w)`` gives the emissions,
    ``gradient(gap)`` the sum of the features times the gap of each token."""
    n = len(label)
    opens = np.zeros(n, bool)
    opens[first[:-1][first[1:] > first[:-1]]] = True
    link = np.flatnonzero(~opens)  # tokens with one before them in the same sequence
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[link - 1].astype(int), label[link].astype(int)), 1)
    k = len(weights)
    theta = np.r_[weights, move.ravel()]
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        move = theta[k:].reshape(2, 2)
        e, forward, backward = messages(logits(theta[:k]), move, first)
        odds = forward * backward
        w = np.exp(move)[None] * np.ones((len(link), 1, 1))
        w[:, 1, :] *= forward[link - 1][:, None]
        w[:, :, 1] *= (e[link] * backward[link])[:, None]
        w /= w.sum((1, 2), keepdims=True)
        slope = np.r_[gradient(label - odds / (1 + odds)), (seen - w.sum(0)).ravel()] / n - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return theta[:k], theta[k:].reshape(2, 2)


def viterbi(logits: list[float], move: list[list[float]]) -> list[int]:
    """The likeliest states of one sequence."""
    (m00, m01), (m10, m11) = move
    back, gain = [], None  # gain: best path that ends in state 1 over the best that ends in state 0
    for x in logits:
        if gain is None:
            gain = x
            continue
        zero, one = gain + m10 > m00, gain + m11 > m01
        back.append((zero, one))
        gain = x + (gain + m11 if one else m01) - (gain + m10 if zero else m00)
    if gain is None:
        return []
    state, out = int(gain > 0), []
    out.append(state)
    for pair in reversed(back):
        state = int(pair[state])
        out.append(state)
    return out[::-1]
