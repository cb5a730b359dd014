"""Linear-chain conditional random fields with two states, over many sequences at once.

Messages are kept as ratios of state 1 to state 0.  Sequences are cut into pieces of
``PIECE`` positions that advance side by side; the linear map of a whole piece carries the
message from piece to piece, so a long sequence is exact and takes no longer loop.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 128
LIMIT = 30.0


def forward(e: np.ndarray, bounds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """f[k] = alpha_k(1) / alpha_k(0) for node ratios ``e`` and edge weights ``t`` (not logs)."""
    n = np.diff(bounds)
    pieces = -(-n // PIECE)
    m = int(pieces.sum())
    out = np.empty(len(e))
    if not m:
        return out
    first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    number = np.arange(m) - np.repeat(first, pieces)
    start = np.repeat(bounds[:-1], pieces) + number * PIECE
    size = np.minimum(PIECE, np.repeat(bounds[1:], pieces) - start)
    (t00, t01), (t10, t11) = t

    # the map of every piece that another one follows
    last = number == np.repeat(pieces, pieces) - 1
    full = np.flatnonzero(~last)
    entry = np.full(m, np.nan)  # the ratio before the piece; none before a sequence
    if len(full):
        a, b, c, d = np.ones(len(full)), np.zeros(len(full)), np.zeros(len(full)), np.ones(len(full))
        base = start[full]
        for s in range(PIECE):
            x = e[base + s]
            a, b = a * t00 + b * t10, (a * t01 + b * t11) * x
            c, d = c * t00 + d * t10, (c * t01 + d * t11) * x
            if s % 8 == 7:
                scale = 1.0 / (a + b + c + d)
                a, b, c, d = a * scale, b * scale, c * scale, d * scale
        place = np.full(m, -1)
        place[full] = np.arange(len(full))
        # a sequence's first piece starts without an edge: there its first step is undone by starting from the node itself
        for k in range(1, int(pieces.max())):
            now = np.flatnonzero(number == k)
            before = place[now - 1]
            if k == 1:
                entry[now] = _first_piece(e, start[now - 1], t)
            else:
                r = entry[now - 1]
                entry[now] = (b[before] + d[before] * r) / (a[before] + c[before] * r)
    order = np.argsort(-size, kind="stable")
    start, size, ratio = start[order], size[order], entry[order]
    fresh = np.isnan(ratio)
    live = len(order)
    for s in range(int(size[0])):
        while live and size[live - 1] <= s:
            live -= 1
        x = e[start[:live] + s]
        r = ratio[:live]
        step = x * (t01 + t11 * r) / (t00 + t10 * r)
        ratio[:live] = np.where(fresh[:live], x, step) if s == 0 else step
        out[start[:live] + s] = ratio[:live]
    return out


def _first_piece(e: np.ndarray, start: np.ndarray, t: np.ndarray) -> np.ndarray:
    (t00, t01), (t10, t11) = t
    r = e[start]
    for s in range(1, PIECE):
        r = e[start + s] * (t01 + t11 * r) / (t00 + t10 * r)
    return r


def messages(scores: np.ndarray, bounds: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(e, f, b): node, forward and backward ratios; ``scores`` and ``edges`` are logs."""
    e = np.exp(np.clip(scores, -LIMIT, LIMIT))
    t = np.exp(edges - edges.max())
    f = forward(e, bounds, t)
    back = forward(e[::-1].copy(), len(e) - bounds[::-1], t.T)[::-1]
    return e, f, back / e


def marginals(scores: np.ndarray, bounds: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """P(state 1) at every position."""
    _, f, b = messages(scores, bounds, edges)
    product = f * b
    return product / (1.0 + product)


@dataclass
class Field:
    """Node weights over features and edge weights between neighbouring states."""

    weights: np.ndarray
    edges: np.ndarray


def pair_marginals(e: np.ndarray, f: np.ndarray, b: np.ndarray, bounds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Expected number of each pair of neighbouring states, as a 2 x 2 table."""
    inner = np.ones(len(e), bool)
    inner[bounds[:-1][bounds[:-1] < len(e)]] = False
    k = np.flatnonzero(inner)
    right = e[k] * b[k]
    left = f[k - 1]
    cells = np.stack([t[0, 0] * np.ones(len(k)), t[0, 1] * right, t[1, 0] * left, t[1, 1] * left * right])
    cells /= cells.sum(axis=0)
    return cells.sum(axis=1).reshape(2, 2)


def observed_pairs(states: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    inner = np.ones(len(states), bool)
    inner[bounds[:-1][bounds[:-1] < len(states)]] = False
    k = np.flatnonzero(inner)
    return np.bincount(states[k - 1] * 2 + states[k], minlength=4).reshape(2, 2).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression (the last column of x is the constant), by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -LIMIT, LIMIT)))
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x.T * np.maximum(p * (1 - p), 1e-9)) @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -LIMIT, LIMIT)))
