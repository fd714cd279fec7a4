"""Learned space partitions: a balanced cut of a neighbour graph and a classifier that routes to its parts.

Everything here runs in one task over a bounded sample; see :mod:`siftlode.llm.neighbours` for the search.
The method is that of Dong, Indyk, Razenshteyn and Wagner (2020), "Learning Space Partitions for Nearest
Neighbor Search".
"""

from __future__ import annotations

import numpy as np

GRAPH_K = 10


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int, block: int = 2048) -> np.ndarray:
    """Indices of the ``k`` most similar other rows of each row of ``x`` (unit rows), in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), dtype=np.int64)
    for i in range(0, n, block):
        s = x[i : i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _fill(preference: np.ndarray, capacity: int) -> np.ndarray:
    """Parts by preference (rows x parts), the clearest rows first, none beyond ``capacity``."""
    n, parts = preference.shape
    room = np.full(parts, capacity)
    out = np.empty(n, dtype=np.int64)
    top = np.sort(preference, axis=1)
    clear = top[:, -1] - (top[:, -2] if parts > 1 else 0)
    order = np.argsort(-preference, axis=1)
    for i in np.argsort(-clear, kind="stable"):
        for p in order[i]:
            if room[p] > 0:
                out[i] = p
                room[p] -= 1
                break
    return out


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """A part for each row: few graph edges between parts, no part above ``slack`` times the mean size.

    Starts from capacity-bound k-means and then moves rows to the part that holds most of their graph
    neighbours, again within the capacity.
    """
    n = len(x)
    if parts <= 1:
        return np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(seed)
    capacity = int(np.ceil(slack * n / parts))
    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        label = _fill(x @ centre.T, capacity)
        for p in range(parts):
            own = x[label == p]
            if len(own):
                c = own.mean(0)
                centre[p] = c / max(np.linalg.norm(c), 1e-12)
    back = np.concatenate([graph, np.full((n, 0), 0, dtype=np.int64)], axis=1)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        rows = np.repeat(np.arange(n), back.shape[1])
        np.add.at(votes, (rows, label[back.ravel()]), 1.0)
        np.add.at(votes, (back.ravel(), np.repeat(label, back.shape[1])), 1.0)
        votes[np.arange(n), label] += 0.5  # stay unless another part is really better
        new = _fill(votes + 0.1 * (x @ centre.T), capacity)
        if (new == label).all():
            break
        label = new
        for p in range(parts):
            own = x[label == p]
            if len(own):
                c = own.mean(0)
                centre[p] = c / max(np.linalg.norm(c), 1e-12)
    return label


class Router:
    """A classifier with one hidden layer: vector to probabilities of the parts."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray):
        self.w1, self.b1, self.w2, self.b2 = (np.asarray(a, dtype=np.float32) for a in (w1, b1, w2, b2))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    @staticmethod
    def fit(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, batch: int = 256, seed: int = 7) -> "Router":
        """Adam on the cross-entropy to ``target`` (rows x parts, each row sums to 1)."""
        rng = np.random.default_rng(seed)
        d, parts = x.shape[1], target.shape[1]
        p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        m = [np.zeros_like(a) for a in p]
        v = [np.zeros_like(a) for a in p]
        t = 0
        for epoch in range(epochs):
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                b = order[i : i + batch]
                h = x[b] @ p[0] + p[1]
                a = np.maximum(h, 0)
                z = a @ p[2] + p[3]
                z -= z.max(1, keepdims=True)
                e = np.exp(z)
                g = (e / e.sum(1, keepdims=True) - target[b]) / len(b)
                ga = (g @ p[2].T) * (h > 0)
                t += 1
                for j, gr in enumerate([x[b].T @ ga, ga.sum(0), a.T @ g, g.sum(0)]):
                    m[j] = 0.9 * m[j] + 0.1 * gr
                    v[j] = 0.999 * v[j] + 0.001 * gr * gr
                    p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        return Router(*p)


def fit_router(sample: np.ndarray, parts: int, k: int = GRAPH_K) -> Router:
    """Graph, balanced cut and router over the rows of ``sample``; the target of a row is where it and its neighbours lie."""
    x = unit(np.asarray(sample, dtype=np.float64))
    parts = max(1, min(parts, len(x)))
    if parts == 1 or len(x) < 4:
        d = x.shape[1] if x.ndim == 2 else 1
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, k)
    label = balanced_cut(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1.0)
    target[np.arange(len(x)), label] += graph.shape[1]
    return Router.fit(x, target / target.sum(1, keepdims=True))


class Index:
    """Routers of all models: ``top`` by model, ``below`` by (model, part) where parts are cut again."""

    #: Rows that are routed together.
    BATCH = 1024

    def __init__(self, top: dict[str, Router], below: dict[tuple, Router], width: int):
        self.top, self.below, self.width = top, below, width

    def homes(self, model: str, vectors: list) -> np.ndarray:
        """The most probable part of the first level for each vector; 0 for vectors of another length than the router's."""
        router = self.top[model]
        d = router.w1.shape[0]
        out = np.zeros(len(vectors), dtype=np.int32)
        at = [i for i, v in enumerate(vectors) if len(v) == d]
        if at:
            out[at] = router.probabilities(unit(np.stack([np.asarray(vectors[i], dtype=np.float64) for i in at]))).argmax(1)
        return out

    def visits(self, model: str, raw: np.ndarray, mass: float, least: int) -> list[np.ndarray]:
        """The parts that each row of ``raw`` visits, the most probable first: until they hold ``mass``, and at least ``least``.

        A model without router, and rows of another length than its router's, have the one part 0.
        """
        router = self.top.get(model)
        if router is None or router.w1.shape[0] != raw.shape[1]:
            return [np.zeros(1, dtype=np.int32)] * len(raw)
        x = unit(raw.astype(np.float64))
        p = router.probabilities(x)
        if not any(m == model for m, _ in self.below):
            return _most(p, np.arange(p.shape[1], dtype=np.int32), mass, least)
        out: list = [None] * len(raw)
        home = p.argmax(1)
        # rows of one home share their few probable parts, so each batch opens a few routers only
        for h in np.unique(home):
            rows = np.flatnonzero(home == h)
            for i in range(0, len(rows), self.BATCH):
                at = rows[i : i + self.BATCH]
                order = np.argsort(-p[at], axis=1, kind="stable")
                need = (np.cumsum(np.take_along_axis(p[at], order, 1), axis=1) < mass).sum(1) + 1
                opened = np.zeros(p[at].shape, dtype=bool)
                np.put_along_axis(opened, order, np.arange(p.shape[1])[None, :] < np.maximum(need, 2)[:, None], 1)
                tables, names = [], []
                for t in np.flatnonzero(opened.any(0)):
                    sub = self.below.get((model, int(t)))
                    q = sub.probabilities(x[at]) if sub is not None else np.ones((len(at), 1))
                    tables.append(q * (p[at, t] * opened[:, t])[:, None])
                    names.append(t * self.width + np.arange(q.shape[1]))
                joint = np.concatenate(tables, axis=1)
                joint /= joint.sum(1, keepdims=True)
                for r, parts in zip(at, _most(joint, np.concatenate(names).astype(np.int32), mass, least)):
                    out[r] = parts
        return out


def _most(p: np.ndarray, names: np.ndarray, mass: float, least: int) -> list[np.ndarray]:
    order = np.argsort(-p, axis=1, kind="stable")
    need = (np.cumsum(np.take_along_axis(p, order, 1), axis=1) < mass).sum(1) + 1
    need = np.minimum(np.maximum(need, least), p.shape[1])
    return [names[o[:n]] for o, n in zip(order, need)]
