"""A tree-structured graphical model of pages, and its training from labelled pages.

Each node is furniture (0) or body (1). A node potential is a weighted sum of its features; each kind of edge has a 2 x 2 parent-child
potential. Sum-product messages pass from the leaves to the root and back, for all pages of a batch at once, depth by depth, and
give every node's marginal. Training maximises the likelihood of labelled trees (its gradient is observed minus expected counts).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from weftline.llm.pages import EDGES, N_FEATURES, Trees

N_EDGES = len(EDGES)


@dataclass
class Model:
    weights: np.ndarray  # (N_FEATURES,): log-odds of body
    edges: np.ndarray  # (N_EDGES, 2, 2): by label of parent, then of child


class Flat:
    """Trees as arrays, nodes ordered as they came; levels: the nodes of each depth."""

    def __init__(self, t: Trees):
        self.n = len(t.page)
        self.parent = np.array(t.parent, np.int64)
        self.edge = np.array(t.edge, np.int64)
        count = np.fromiter(map(len, t.features), np.int64, self.n)
        self.active = np.fromiter((f for fs in t.features for f in fs), np.int64, int(count.sum()))
        self.owner = np.repeat(np.arange(self.n), count)
        depth = np.array(t.depth, np.int64)
        order = np.argsort(depth, kind="stable")
        cut = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cut) if self.n else []


def marginals(m: Model, f: Flat) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each node: P(label), P(parent's label, own label); and the log of the partition function over all trees."""
    up = np.zeros((f.n, 2))  # belief of the subtree, at first the node's own potential
    up[:, 1] = np.bincount(f.owner, m.weights[f.active], f.n)
    sent = np.zeros((f.n, 2))  # message to the parent, by the parent's label
    for level in f.levels[:0:-1]:
        x = m.edges[f.edge[level]] + up[level][:, None, :]
        sent[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        for label in (0, 1):
            up[:, label] += np.bincount(f.parent[level], sent[level, label], f.n)
    full = up.copy()  # belief of the whole tree
    pair = np.zeros((f.n, 2, 2))
    z = 0.0
    for k, level in enumerate(f.levels):
        if k == 0:
            z = float(np.logaddexp(up[level, 0], up[level, 1]).sum())
            continue
        rest = full[f.parent[level]] - sent[level]  # the parent's belief without this child
        joint = rest[:, :, None] + m.edges[f.edge[level]] + up[level][:, None, :]
        both = np.logaddexp(joint[:, 0], joint[:, 1])
        full[level] = both
        pair[level] = np.exp(joint - np.logaddexp(both[:, 0], both[:, 1])[:, None, None])
    p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500)))
    return np.stack([1 - p, p], 1), pair, z


def train(t: Trees, labels: np.ndarray, steps: int = 150, rate: float = 0.15, decay: float = 2e-3) -> Model:
    """Gradient ascent (Adam) on the likelihood of the labels, with a small quadratic penalty."""
    f = Flat(t)
    m = Model(np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2)))
    child = f.parent >= 0
    seen_f = np.bincount(f.active, labels[f.owner].astype(float), N_FEATURES)
    seen_e = np.zeros((N_EDGES, 2, 2))
    np.add.at(seen_e, (f.edge[child], labels[f.parent[child]], labels[child]), 1.0)
    state = [np.zeros_like(m.weights), np.zeros_like(m.weights), np.zeros_like(m.edges), np.zeros_like(m.edges)]
    for step in range(1, steps + 1):
        p, pair, _ = marginals(m, f)
        g_f = (seen_f - np.bincount(f.active, p[f.owner, 1], N_FEATURES)) / f.n * 50 - decay * m.weights
        g_e = seen_e.copy()
        np.subtract.at(g_e, f.edge[child], pair[child])
        g_e = g_e / f.n * 50 - decay * m.edges
        for x, g, i in ((m.weights, g_f, 0), (m.edges, g_e, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            x += rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-6)
    return m


@lru_cache(1)
def trained() -> Model:
    """The model learnt from the labelled pages of ``labelled``."""
    from weftline.llm.labelled import labelled_pages

    t, labels = labelled_pages()
    return train(t, labels)
