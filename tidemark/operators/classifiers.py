"""Classifiers of two classes in numpy, for training sets that one task holds: logistic regression, a decision tree, a forest, boosted trees.

Trees are grown level by level on binned features (at most BINS cuts a feature, at the values' own midpoints where there are no more), all nodes of a level at once:
one histogram of gradients and curvatures per level.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BINS = 63


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients, constant first, by Newton's method; the slopes are held by ridge * |b|^2 / 2."""
    a = np.column_stack([np.ones(len(y)), x])
    hold = np.diag([1e-9, *([ridge] * x.shape[1])])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        move = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + hold, a.T @ (y - p) - hold @ b)
        b = b + move
        if np.abs(move).max() < 1e-10:
            break
    return b


def cuts_of(x: np.ndarray, most: int = BINS) -> list[np.ndarray]:
    """Cuts of each feature: midpoints of neighbouring values, or quantiles where there are more."""
    out = []
    for col in x.T:
        v = np.unique(col)
        mid = (v[1:] + v[:-1]) / 2
        out.append(mid if mid.size <= most else np.unique(np.quantile(col, np.linspace(0, 1, most + 2)[1:-1])))
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts lie below each value: a value of at most a cut stays on its lower side."""
    return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1) if len(cuts) else np.zeros((len(x), 0), np.int64)


def bins_of(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's cells in a table of features and bins."""
    return codes + np.arange(codes.shape[1]) * (int(sizes.max(initial=0)) + 1)


class Tree:
    """A regression tree on gradients g and curvatures h: a leaf's value is sum g / (sum h + ridge)."""

    def __init__(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, sizes: np.ndarray, depth: int | None, ridge: float = 0.0, least: float = 0.0, pick: Callable[[int], np.ndarray] | None = None, bins: np.ndarray | None = None):
        """codes: binned features; sizes: cuts of each; least: curvature that either side of a split has at least; pick(n): for n nodes, which features each may split on;
        bins: bins_of(codes, sizes), for those who grow many trees on the same codes. leaf: the node that each row ends in."""
        n_features, width = codes.shape[1], int(sizes.max(initial=0)) + 1
        bins = bins_of(codes, sizes) if bins is None else bins
        cells, least = n_features * width, max(least, 1e-12)
        parts, self.leaf = [], np.zeros(len(g), np.int64)
        node, rows, level = np.zeros(len(g), np.int64), np.arange(len(g)), 0
        first, n_nodes = 0, 1
        no_cut = np.arange(width)[None] >= sizes[:, None]  # the last bin has no cut above it
        wide_g, wide_h = (np.repeat(x, n_features).reshape(-1, n_features) for x in (g, h))
        while n_nodes:
            gs, hs = np.bincount(node, g[rows], n_nodes), np.bincount(node, h[rows], n_nodes)
            feature, cut, left = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
            parts.append((feature, cut, left, gs / np.maximum(hs + ridge, 1e-300)))
            self.leaf[rows] = first + node
            if not rows.size or n_features == 0 or depth is not None and level >= depth:
                break
            chosen = None if pick is None else pick(n_nodes)
            # a node whose curvature can't make two sides is a leaf, whatever the histograms say
            able = np.flatnonzero(hs >= 2 * least * (1 - 1e-9))
            if able.size < n_nodes:
                place = np.full(n_nodes, -1)
                place[able] = np.arange(able.size)
                keep = place[node] >= 0
                rows, node, gs, hs = rows[keep], place[node[keep]], gs[able], hs[able]
                if not rows.size:
                    break
            all_rows = rows.size == len(g)
            at = bins if all_rows else bins[rows]
            at = (at if able.size == 1 else at + (node * cells)[:, None]).ravel()
            shape = (able.size, n_features, width)
            gl = np.bincount(at, (wide_g if all_rows else wide_g[rows]).ravel(), able.size * cells).reshape(shape).cumsum(2)
            hl = np.bincount(at, (wide_h if all_rows else wide_h[rows]).ravel(), able.size * cells).reshape(shape).cumsum(2)
            gr, hr = gs[:, None, None] - gl, hs[:, None, None] - hl
            bad = hl < least
            bad |= hr < least
            bad |= no_cut
            with np.errstate(divide="ignore", invalid="ignore"):
                np.square(gl, out=gl)
                np.square(gr, out=gr)
                hl += ridge
                hr += ridge
                gl /= hl
                gr /= hr
                gl += gr
                gl -= (gs**2 / (hs + ridge))[:, None, None]
            if ridge == 0:
                bad |= ~np.isfinite(gl)
            if chosen is not None:
                bad |= ~chosen[able][:, :, None]
            gl[bad] = -np.inf
            flat = gl.reshape(able.size, -1)
            best = flat.argmax(1)
            good = flat[np.arange(able.size), best] > 1e-9
            at_feature, at_cut = best // width, best % width
            number = np.cumsum(good) - 1
            below = first + n_nodes
            feature[able[good]], cut[able[good]], left[able[good]] = at_feature[good], at_cut[good], below + 2 * number[good]
            keep = good[node]
            rows, node = rows[keep], node[keep]
            node = 2 * number[node] + (codes[rows, at_feature[node]] > at_cut[node])
            first, n_nodes, level = below, 2 * int(good.sum()), level + 1
        self.feature, self.cut, self.left, self.value = (np.concatenate([p[k] for p in parts]) for k in range(4))

    def predict(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            i = np.flatnonzero(inner)
            at[i] = self.left[at[i]] + (codes[i, f[i]] > self.cut[at[i]])


def boosted(x: np.ndarray, y: np.ndarray, new: np.ndarray, rounds: int = 100, depth: int = 6, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0) -> np.ndarray:
    """Probabilities of class 1 by trees boosted under log loss from a probability of one half."""
    cuts = cuts_of(x)
    codes, others, sizes = binned(x, cuts), binned(new, cuts), np.array([c.size for c in cuts])
    f, out, bins = np.zeros(len(y)), np.zeros(len(new)), bins_of(codes, sizes)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = Tree(codes, y - p, p * (1 - p), sizes, depth, ridge, least, bins=bins)
        if len(tree.value) == 1 and abs(tree.value[0]) < 1e-6:
            break
        f += rate * tree.value[tree.leaf]
        out += rate * tree.predict(others)
    return 1 / (1 + np.exp(-out))


def decision_tree(x: np.ndarray, y: np.ndarray, new: np.ndarray, depth: int | None = 5) -> np.ndarray:
    """Probabilities of class 1 by one tree; the split of least squared error is that of least Gini impurity for two classes."""
    cuts = cuts_of(x)
    return Tree(binned(x, cuts), y.astype(float), np.ones(len(y)), np.array([c.size for c in cuts]), depth).predict(binned(new, cuts))


def forest(x: np.ndarray, y: np.ndarray, new: np.ndarray, trees: int = 100, seed: int = 42) -> np.ndarray:
    """Mean probability of full-depth trees, each on rows drawn again with replacement, its splits on a root of the features."""
    rng, cuts = np.random.default_rng(seed), cuts_of(x)
    codes, others, sizes = binned(x, cuts), binned(new, cuts), np.array([c.size for c in cuts])
    n_features, out = x.shape[1], np.zeros(len(new))
    some = max(1, int(np.sqrt(n_features)))
    pick = lambda n: rng.random((n, n_features)).argsort(1).argsort(1) < some
    for _ in range(trees):
        weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        rows = weight > 0
        out += Tree(codes[rows], (weight * y)[rows], weight[rows], sizes, None, pick=pick).predict(others)
    return out / trees


#: Classifiers by name: functions of (x, y, new rows, depth, trees, seed) to probabilities of class 1. Only logistic regression scales its features.
CLASSIFIERS: dict[str, Callable[..., np.ndarray]] = {
    "logistic_regression": lambda x, y, new, depth, trees, seed: _scaled_logistic(x, y, new),
    "decision_tree": lambda x, y, new, depth, trees, seed: decision_tree(x, y, new, depth),
    "random_forest": lambda x, y, new, depth, trees, seed: forest(x, y, new, trees, seed),
    "xgboost": lambda x, y, new, depth, trees, seed: boosted(x, y, new, trees, depth),
}


def _scaled_logistic(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-12)
    b = logistic((x - mean) / sd, y)
    return 1 / (1 + np.exp(-np.clip(b[0] + (new - mean) / sd @ b[1:], -500, 500)))


def probabilities(method: str, x: np.ndarray, y: np.ndarray, new: np.ndarray, depth: int = 6, trees: int = 100, seed: int = 42) -> np.ndarray:
    """Probabilities of class 1 for new rows. Labels of one kind only give that kind's constant."""
    if method not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {method!r}; one of {list(CLASSIFIERS)}")
    y = np.asarray(y, float)
    if len(y) and y.min() == y.max():
        return np.full(len(new), y[0])
    return CLASSIFIERS[method](np.asarray(x, float), y, np.asarray(new, float), depth, trees, seed)


def smoothed(p: np.ndarray, half_life: float) -> np.ndarray:
    """Exponentially weighted mean of all values so far; none for a half-life of 0."""
    if not half_life:
        return p
    fade, num, den, out = 0.5 ** (1.0 / half_life), 0.0, 0.0, np.empty(len(p))
    for i, v in enumerate(p.tolist()):
        num, den = num * fade + v, den * fade + 1
        out[i] = num / den
    return out
