"""Decision trees over a bounded set of rows, grown level by level for many trees at once. Runs inside Spark tasks.

All trees of a task share one histogram per level, over (node, feature, bin); a bin is a distinct value, so splits are exact.
Trees are flat arrays: a row in node i goes on to ``child[i]``, or to the node after it where its feature exceeds the
threshold; a leaf has itself as child and an infinite threshold.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int


def binned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of every cell, value of every (feature, bin)); features with fewer values are filled with infinity."""
    order = np.argsort(x, axis=0, kind="stable")
    ordered = np.take_along_axis(x, order, axis=0)
    fresh = np.vstack([np.zeros((1, x.shape[1]), bool), ordered[1:] != ordered[:-1]])
    rank = np.cumsum(fresh, axis=0)
    bins = np.empty_like(rank)
    np.put_along_axis(bins, order, rank, axis=0)
    values = np.full((x.shape[1], int(rank.max()) + 1), np.inf)
    values[np.arange(x.shape[1])[None, :], rank] = ordered
    return bins.astype(np.int16 if len(x) < 1 << 15 else np.int64), values


def grow(
    bins: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, max_depth: int | None = None,
    n_try: int | None = None, rng: np.random.Generator | None = None,
) -> tuple[Trees, np.ndarray]:
    """One tree per row of ``weight`` (trees x rows), and the leaf every row falls into, -1 without weight.

    A split maximises wl * wr / (wl + wr) * (mean_l - mean_r) ** 2, which orders splits as Gini impurity does for labels of 0 and 1
    and as squared error does otherwise. ``n_try`` features that are not constant are drawn per node; None tries all.
    Ties go to the first feature, then to the lowest value. A leaf's value is its weighted mean.
    """
    n_trees, n_rows = weight.shape
    width, n_bins = values.shape
    tree, row = np.nonzero(weight)
    w, node = weight[tree, row].astype(np.float64), tree.copy()
    target = y[row]
    leaf = np.full((n_trees, n_rows), -1)
    feature, threshold, child, value = [np.zeros(n_trees, np.int64)], [np.full(n_trees, np.inf)], [np.arange(n_trees)], [np.zeros(n_trees)]
    first, size, depth = 0, n_trees, 0  # nodes of this level are first .. first + size - 1
    while size:
        at = np.argsort(node, kind="stable")
        tree, row, w, node, target = tree[at], row[at], w[at], node[at], target[at]
        local = node - first
        total = np.bincount(local, w, minlength=size)
        mean = np.bincount(local, w * target, minlength=size) / np.maximum(total, 1e-300)
        value[-1][:] = mean
        leaf[tree, row] = node
        begin = np.searchsorted(local, np.arange(size))
        # a node without rows (a tree without weight) stays a leaf
        full = np.flatnonzero(total > 0)
        low, high = np.full((size, width), 0), np.full((size, width), 0)
        cells = bins[row]
        low[full], high[full] = np.minimum.reduceat(cells, begin[full], axis=0), np.maximum.reduceat(cells, begin[full], axis=0)
        spread = np.zeros(size)
        spread[full] = np.maximum.reduceat(target, begin[full]) - np.minimum.reduceat(target, begin[full])
        useful = low < high
        open_nodes = np.flatnonzero((spread > 0) & useful.any(axis=1)) if max_depth is None or depth < max_depth else np.zeros(0, np.int64)
        if not len(open_nodes):
            break
        tried = _draw(useful[open_nodes], n_try, rng)
        best_feature, best_bin, next_bin = _best(bins, tried, open_nodes, local, row, w, target, size, n_bins)
        splits = best_feature >= 0
        open_nodes, best_feature, best_bin, next_bin = open_nodes[splits], best_feature[splits], best_bin[splits], next_bin[splits]
        if not len(open_nodes):
            break
        begin_next = first + size
        feature[-1][open_nodes], child[-1][open_nodes] = best_feature, begin_next + 2 * np.arange(len(open_nodes))
        a, b = values[best_feature, best_bin], values[best_feature, next_bin]
        middle = a + (b - a) / 2
        threshold[-1][open_nodes] = np.where(middle < b, middle, a)
        place = np.full(size, -1)
        place[open_nodes] = np.arange(len(open_nodes))
        goes = place[local] >= 0
        tree, row, w, local, target = tree[goes], row[goes], w[goes], local[goes], target[goes]
        k = place[local]
        node = begin_next + 2 * k + (bins[row, best_feature[k]] > best_bin[k])
        first, size, depth = begin_next, 2 * len(open_nodes), depth + 1
        feature.append(np.zeros(size, np.int64))
        threshold.append(np.full(size, np.inf))
        child.append(first + np.arange(size))
        value.append(np.zeros(size))
    parts = (np.concatenate(p) for p in (feature, threshold, child, value))
    return Trees(*parts, np.arange(n_trees), depth), leaf


def _draw(useful: np.ndarray, n_try: int | None, rng: np.random.Generator | None) -> np.ndarray:
    """Per node the features to try, in order; -1 fills up."""
    width = useful.shape[1]
    if n_try is None or n_try >= width:
        return np.where(useful, np.arange(width), -1)
    luck = np.where(useful, rng.random(useful.shape), 2.0)
    picked = np.argpartition(luck, n_try - 1, axis=1)[:, :n_try]
    picked = np.where(np.take_along_axis(useful, picked, axis=1), picked, -1)
    return np.sort(picked, axis=1)


def _best(bins, tried, open_nodes, local, row, w, target, size, n_bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, last bin on the left and first bin on the right of the best split of every open node; feature -1 if there is none."""
    place = np.full(size, -1)
    place[open_nodes] = np.arange(len(open_nodes))
    inside = np.flatnonzero(place[local] >= 0)
    k = place[local[inside]]
    n, m = tried.shape
    out = np.full((3, n), -1)
    step = max(1, 2_000_000 // (m * n_bins))  # nodes per histogram, so that memory is bounded
    for begin in range(0, n, step):
        end = min(n, begin + step)
        mine = (k >= begin) & (k < end)
        entry, node = inside[mine], k[mine] - begin
        feats = tried[begin:end]
        slot = (node[:, None] * m + np.arange(m)[None, :]) * n_bins + bins[row[entry][:, None], np.maximum(feats[node], 0)]
        cells, shape = (end - begin) * m * n_bins, (end - begin, m, n_bins)
        ww = np.broadcast_to(w[entry][:, None], slot.shape).ravel()
        wy = np.broadcast_to((w[entry] * target[entry])[:, None], slot.shape).ravel()
        weight = np.bincount(slot.ravel(), ww, minlength=cells).reshape(shape)
        total = np.bincount(slot.ravel(), wy, minlength=cells).reshape(shape)
        left_w, left_y = np.cumsum(weight, axis=2), np.cumsum(total, axis=2)
        right_w, right_y = left_w[:, :, -1:] - left_w, left_y[:, :, -1:] - left_y
        can = (weight > 0) & (right_w > 0.5) & (feats >= 0)[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(can, left_w * right_w / (left_w + right_w) * (left_y / left_w - right_y / right_w) ** 2, -1.0)
        flat = np.round(gain, 12).reshape(end - begin, -1)  # sums in another order must not break ties
        best = flat.argmax(axis=1)
        some = np.take_along_axis(flat, best[:, None], axis=1)[:, 0] >= 0
        f, b = best // n_bins, best % n_bins
        later = (np.arange(n_bins)[None, :] > b[:, None]) & (weight[np.arange(end - begin), f] > 0)
        out[0, begin:end] = np.where(some, feats[np.arange(end - begin), f], -1)
        out[1, begin:end], out[2, begin:end] = b, later.argmax(axis=1)
    return out[0], out[1], out[2]


def tree_values(trees: Trees, x: np.ndarray, rows_at_once: int = 2048) -> np.ndarray:
    """Sum over all trees of the value each row of ``x`` ends at."""
    out = np.empty(len(x))
    for begin in range(0, len(x), rows_at_once):
        part = x[begin:begin + rows_at_once]
        at = np.broadcast_to(trees.roots, (len(part), len(trees.roots)))
        line = np.arange(len(part))[:, None]
        for _ in range(trees.depth):
            at = trees.child[at] + (part[line, trees.feature[at]] > trees.threshold[at])
        out[begin:begin + rows_at_once] = trees.value[at].sum(axis=1)
    return out


def fit_forest(x: np.ndarray, y: np.ndarray, n_trees: int, rng: np.random.Generator, max_depth: int | None = None) -> Trees:
    """Bootstrapped classification trees that try sqrt(width) features per node; values are shares of class 1."""
    bins, values = binned(x)
    draws = rng.integers(0, len(y), (n_trees, len(y)))
    weight = np.zeros((n_trees, len(y)))
    np.add.at(weight, (np.arange(n_trees)[:, None], draws), 1.0)
    return grow(bins, values, y, weight, max_depth, max(1, int(np.sqrt(x.shape[1]))), rng)[0]


def fit_boosting(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, step: float) -> tuple[Trees, float]:
    """Boosted trees for log loss, and the log odds they start from. Each leaf holds ``step`` times its Newton step."""
    bins, values = binned(x)
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw, all_rows, grown, nodes = np.full(len(y), start), np.ones((1, len(y))), [], 0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-raw))
        tree, leaf = grow(bins, values, y - p, all_rows, depth)
        size = len(tree.value)
        up = np.bincount(leaf[0], y - p, minlength=size)
        down = np.bincount(leaf[0], p * (1 - p), minlength=size)
        moved = np.where(np.abs(down) < 1e-150, 0.0, step * up / np.maximum(down, 1e-150))
        raw += moved[leaf[0]]
        grown.append(tree._replace(value=moved, child=tree.child + nodes, roots=tree.roots + nodes))
        nodes += size
    if not grown:
        return Trees(*(np.zeros(0, t) for t in (np.int64, float, np.int64, float, np.int64)), 0), start
    parts = (np.concatenate([getattr(t, f) for t in grown]) for f in ("feature", "threshold", "child", "value", "roots"))
    return Trees(*parts, max(t.depth for t in grown)), start
