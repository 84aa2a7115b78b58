"""Small NumPy helpers that run inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def dense_rows(column: pa.Array) -> np.ndarray:
    """list<double> column of equal lengths -> n x d matrix, without touching single rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def mask_rows(column: pa.Array) -> np.ndarray:
    """list<bool> column of equal lengths -> n x k matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(bool)
    return flat.reshape(len(column), -1)


def target_slices(batch: pa.RecordBatch):
    """(target, positions, features, ids, test mask) per target occurring in an Arrow batch."""
    if not batch.num_rows:
        return
    x, mask = dense_rows(batch.column("features")), mask_rows(batch.column("test_mask"))
    ids = batch.column("mol_id").to_numpy(zero_copy_only=False)
    encoded = batch.column("target").dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    for code, target in enumerate(encoded.dictionary.to_pylist()):
        at = np.flatnonzero(codes == code)
        yield target, at, x[at], ids[at], mask[at]


def nearest_squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every row to its nearest centre, by differences (exact for equal rows)."""
    near = np.full(len(x), np.inf)
    for centre in centres:
        diff = x - centre
        np.minimum(near, np.einsum("ij,ij->i", diff, diff), out=near)
    return near


def farthest_point_order(ids: np.ndarray, x: np.ndarray, first: int, n_select: int) -> list[int]:
    """Positions of a farthest-point selection that starts at ``first``; ties go to the smallest id."""
    if n_select > len(ids):
        raise ValueError(f"{n_select} rows wanted of {len(ids)}")
    chosen = [first]
    near = np.full(len(ids), np.inf)
    while len(chosen) < n_select:
        diff = x - x[chosen[-1]]
        near = np.minimum(near, np.einsum("ij,ij->i", diff, diff))
        near[chosen] = -np.inf
        tied = np.flatnonzero(near == near.max())
        chosen.append(int(tied[np.argmin(ids[tied])]))
    return chosen


def farthest_while(x: np.ndarray, near: np.ndarray, most: int, bound: float) -> list[int]:
    """Positions of up to ``most`` farthest points, taken as long as none of the rows left out can come before; the first is taken anyway.

    ``near`` holds squared distances to the nearest centre and is brought up to date. Ties go to the first row. Rows left out are at
    most ``bound`` away; those that are just as far come after the rows that were given with that distance.
    """
    chosen: list[int] = []
    given = near.copy()
    while len(chosen) < min(most, len(x)):
        pick = int(np.argmax(near))
        if chosen and (near[pick] < bound or (near[pick] == bound and given[pick] != bound)):
            break
        diff = x - x[pick]
        np.minimum(near, np.einsum("ij,ij->i", diff, diff), out=near)
        near[pick] = -np.inf
        chosen.append(pick)
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, scale: bool = True, max_iter: int = 100) -> tuple:
    """(mean, scale, weights, intercept) minimising 0.5 |w|^2 + sum of log losses, free intercept.

    Newton steps in the span of the rows: weights are X' a, so the system has n + 1 unknowns
    however wide the rows are. Columns are standardised with the population deviation; a
    constant column keeps scale 1.
    """
    if len(np.unique(y)) < 2:
        raise ValueError("the labeled rows hold one class only; a classifier needs both")
    mean = x.mean(axis=0) if scale else np.zeros(x.shape[1])
    dev = x.std(axis=0) if scale else np.ones(x.shape[1])
    dev = np.where(dev < 1e-12, 1.0, dev)
    z = (x - mean) / dev
    gram = z @ z.T
    a, b = np.zeros(len(y)), 0.0

    def loss(a, b):
        f = gram @ a + b
        return 0.5 * a @ gram @ a + np.sum(np.logaddexp(0.0, f) - y * f)

    current = loss(a, b)
    for _ in range(max_iter):
        f = gram @ a + b
        p = 1.0 / (1.0 + np.exp(-np.clip(f, -500, 500)))
        grad = a + p - y  # gradient in the row span; the intercept's is sum(p - y)
        if max(np.abs(grad).max(), abs(np.sum(p - y))) < 1e-10:
            break
        w = np.maximum(p * (1 - p), 1e-12)
        # Newton: (I + W G) da + W 1 db = -grad ; 1'(W G) da + 1'W db = -sum(p - y)
        system = np.empty((len(y) + 1, len(y) + 1))
        system[:-1, :-1] = np.eye(len(y)) + w[:, None] * gram
        system[:-1, -1] = w
        system[-1, :-1] = w @ gram
        system[-1, -1] = w.sum()
        step = np.linalg.solve(system, -np.append(grad, np.sum(p - y)))
        t = 1.0
        while t > 1e-8:
            trial = loss(a + t * step[:-1], b + t * step[-1])
            if trial <= current + 1e-12 * abs(current):
                break
            t /= 2
        a, b = a + t * step[:-1], b + t * step[-1]
        current = loss(a, b)
    return mean, dev, z.T @ a, float(b)
