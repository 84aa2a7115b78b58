"""Toxicity by a linear-chain conditional random field over words.

Labels of documents give labels of words: in documents labelled toxic, words found far more often there than in
clean ones, or whose first bytes are, are toxic; all other words are not. The field has a weight for each of the most telling words
and beginnings of words (of PREFIXES bytes, so that one root with many endings is learned from few texts), for words in capitals, a
bias and three transition weights; it is fitted in one task, by gradient steps on a bounded sample. Over every whole text
forward-backward gives each word's probability of being toxic; its expected number and maximum make the document's score by a
logistic fit, and runs of likely words are the offending spans.

The sample: up to ``per_class`` labelled documents of each class, those with the smallest hash of doc_id, with texts of at most
``max_chars`` characters, one text for each doc_id. Nothing else is bounded. Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased A-Z.

Cases: null and empty texts get the score of a text without toxic words; a doc_id with several labels counts
as toxic if one says so; null labels and ids are ignored; without labels of both classes every score is the share of toxic labels,
(toxic + 1) / (labels + 2), and no span is given; repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, Words, hashes, mix, pieces, words

PER_CLASS = 2000
MAX_CHARS = 20_000
PREFIXES = (4, 5, 7)
VOCABULARY = 20_000
BATCH = 32  # texts of like length whose chains are run side by side


class Model(NamedTuple):
    known: np.ndarray  # sorted word hashes
    weight: np.ndarray  # of each; the last entry is that of all others, 0
    bias: float
    capitals: float
    move: tuple[float, float, float, float]  # 0-0, 0-1, 1-0, 1-1, as factors
    score: np.ndarray  # logistic weights: bias, log of expected number, maximum
    prior: float


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words of a piece, as hashes: the word and its beginnings, 0 where it is shorter; which distinct word
    each word is; whether it is in capitals."""
    upper = np.concatenate([[0], np.cumsum((w.data >= 65) & (w.data <= 90))])
    size = w.end - w.start
    capitals = (upper[w.end] - upper[w.start] == size) & (size > 2)
    distinct, first, which = np.unique(hashes(w), return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    cuts = hashes(w, np.tile(start, len(PREFIXES)), np.concatenate([np.minimum(end, start + k) for k in PREFIXES])).reshape(len(PREFIXES), -1)
    begins = [np.where(end - start >= k, mix(h ^ np.uint64(k)), np.uint64(0)) for k, h in zip(PREFIXES, cuts)]
    return np.stack([distinct, *begins], axis=1), which, capitals


def _ids(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each feature in ``known``; len(known) for all others."""
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    return np.where(known[at] == h, at, len(known)) if len(known) else np.zeros(len(h), np.int64)


def chain(odds: np.ndarray, first: np.ndarray, move, side: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds and marginal probability of state 1 of every word of every row.

    ``odds`` are the words' own odds. ``side`` rows of like length are run side by side.
    """
    a00, a01, a10, a11 = move
    forward, backward = np.empty(len(odds)), np.empty(len(odds))
    n = np.diff(first)
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    for k in range(0, len(order), side):
        rows = order[k:k + side]
        length, begin = n[rows], first[rows]
        longest = int(length.max())
        at = begin[None, :] + np.arange(longest)[:, None]
        inside = np.arange(longest)[:, None] < length[None, :]
        own = np.where(inside, odds[np.minimum(at, len(odds) - 1)], 1.0)
        f, b = np.empty_like(own), np.ones_like(own)
        r = own[0]
        f[0] = r
        for t in range(1, longest):
            r = np.clip(own[t] * (a01 + a11 * r) / (a00 + a10 * r), 1e-12, 1e12)
            f[t] = r
        q = np.ones(len(rows))
        for t in range(longest - 1, 0, -1):
            q = np.where(inside[t], (a10 + a11 * own[t] * q) / (a00 + a01 * own[t] * q), q)
            b[t - 1] = q
        # rows that end before t have met only steps outside them, which leave q at 1
        forward[at[inside]], backward[at[inside]] = f[inside], b[inside]
    joint = forward * backward
    return forward, backward, joint / (1 + joint)


def _features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    total = np.concatenate([[0], np.cumsum(p)])
    most = np.zeros(len(n))
    full = n > 0
    if full.any():
        most[full] = np.maximum.reduceat(p, first[:-1][full])
    return np.stack([np.ones(len(n)), np.log1p(np.maximum(0, total[first[1:]] - total[first[:-1]])), most], axis=1)


def training_rows(labels: DataFrame, holdout_mod: int = 3, holdout: int = 1) -> DataFrame:
    """(doc_id, toxic): labels that may be learned from, one for each doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % holdout_mod != holdout)
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sample(docs: DataFrame, rows: DataFrame, per_class: int, max_chars: int) -> DataFrame:
    """(doc_id, text, toxic): at most 2 * per_class rows, however often a doc_id repeats."""
    picked = None
    for label in (0, 1):
        part = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    texts = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(texts: pa.Array, toxic: np.ndarray, clean_n: int, toxic_n: int, vocabulary: int = VOCABULARY, steps: int = 40) -> Model:
    prior = (toxic_n + 1) / (clean_n + toxic_n + 2)
    empty = Model(np.zeros(0, np.uint64), np.zeros(1), 0.0, 0.0, (1.0, 1.0, 1.0, 1.0), np.array([np.log(prior / (1 - prior)), 0.0, 0.0]), prior)
    if not (toxic == 1).any() or not (toxic == 0).any():
        return empty
    parts = []  # piece by piece, so that only words are held, not arrays over all bytes
    for begin, data, offset in pieces(texts):
        w = words(data, offset, ALNUM)
        found, which, capitals = _tokens(w)
        parts.append((found[which], capitals, w.row + begin, np.diff(w.first)))
    h, capitals, row, n = (np.concatenate(x) for x in zip(*parts))
    first = np.concatenate([[0], np.cumsum(n)])
    if not len(h):
        return empty
    distinct, ids = np.unique(h, return_inverse=True)
    ids = ids.reshape(h.shape)
    pairs = np.unique(row.astype(np.int64)[:, None] * len(distinct) + ids)
    in_toxic = np.bincount(pairs[toxic[pairs // len(distinct)] == 1] % len(distinct), minlength=len(distinct))
    in_clean = np.bincount(pairs[toxic[pairs // len(distinct)] == 0] % len(distinct), minlength=len(distinct))
    nt, nc = (toxic == 1).sum(), (toxic == 0).sum()
    gain = np.log((in_toxic + 0.5) / (nt - in_toxic + 0.5)) - np.log((in_clean + 0.5) / (nc - in_clean + 0.5))
    sure = gain / np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_clean + 0.5))
    telling = (gain >= 3.0) & (sure >= 3.2) & (in_toxic >= 3) & (distinct > 0)
    # the weights kept: the features with the surest gain either way
    keep = np.sort(np.argsort(-np.abs(sure), kind="stable")[:vocabulary])
    known = distinct[keep]
    place = np.full(len(distinct), len(known))
    place[keep] = np.arange(len(known))
    target = (telling[ids].any(axis=1) & (toxic[row] == 1)).astype(float)
    del h, pairs
    ids = place[ids].astype(np.int32)

    v_n = len(known)
    bias, cap, move = v_n, v_n + 1, slice(v_n + 2, v_n + 6)
    theta = np.zeros(v_n + 6)
    theta[bias] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(ids), bool)
    inner[first[:-1][first[:-1] < len(ids)]] = False  # words with a predecessor in their text
    now = np.flatnonzero(inner)
    seen = np.bincount((2 * target[now - 1] + target[now]).astype(int), minlength=4)
    scale = max(1.0, target.sum())
    for step in range(1, steps + 1):
        own = np.append(theta[:v_n], 0.0)
        odds = np.exp(np.clip(own[ids].sum(axis=1) + theta[bias] + theta[cap] * capitals, -25, 25))
        factors = np.exp(theta[move])
        f, b, p = chain(odds, first, tuple(factors), 256)
        miss = target - p
        grad = np.zeros_like(theta)
        grad[:v_n] = sum(np.bincount(column, weights=miss, minlength=v_n + 1) for column in ids.T)[:v_n]
        grad[bias], grad[cap] = miss.sum(), (miss * capitals).sum()
        left, right = f[now - 1], odds[now] * b[now]
        joint = np.stack([np.full(len(now), factors[0]), factors[1] * right, factors[2] * left, factors[3] * left * right])
        grad[move] = seen - (joint / joint.sum(axis=0)).sum(axis=1)
        grad[move.start] = 0.0  # the first transition is the unit of the others
        grad = grad / scale - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = empty._replace(known=known, weight=np.append(theta[:v_n], 0.0), bias=float(theta[bias]), capitals=float(theta[cap]), move=tuple(np.exp(theta[move]).tolist()))
    own = model.weight[ids].sum(axis=1) + model.bias + model.capitals * capitals
    x = _features(chain(np.exp(np.clip(own, -25, 25)), first, model.move)[2], first)
    return model._replace(score=_logistic(x, toxic, np.where(toxic == 1, toxic_n / nt, clean_n / nc)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic fit by damped Newton steps with a small ridge; all but the bias are kept from going below zero."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-1, 1e-1])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float(weight @ (np.logaddexp(0.0, z) - y * z) + beta @ ridge @ beta / 2)

    now = loss(beta)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge @ beta
        # a weight held at zero that would go below stays out of the step
        free = ~((beta <= 0) & (grad < 0))
        free[0] = True
        curve = (x.T * (weight * p * (1 - p))) @ x + ridge
        step = np.zeros(len(beta))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], grad[free])
        size = 1.0
        while size > 1e-6:
            trial = beta + size * step
            trial[1:] = np.maximum(trial[1:], 0)
            if loss(trial) <= now:
                break
            size /= 2
        else:
            break
        if np.abs(trial - beta).max() < 1e-9:
            break
        beta, now = trial, loss(trial)
    return beta


def _marginals(w: Words, model: Model) -> np.ndarray:
    found, which, capitals = _tokens(w)
    own = model.weight[_ids(found, model.known)].sum(axis=1)[which] + model.bias + model.capitals * capitals
    return chain(np.exp(np.clip(own, -25, 25)), w.first, model.move)[2]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """The field, fitted in a task on the sample; only its weights come to the driver."""
    rows = training_rows(labels)
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("toxic", pa.int32())]))
        model = fit(got.column("text"), got.column("toxic").to_numpy().astype(np.int64), counts.get(0, 0), counts.get(1, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.known.view(np.int64)], pa.list_(pa.int64())), pa.array([model.weight]), pa.array([model.bias]), pa.array([model.capitals]), pa.array([list(model.move)]),
             pa.array([model.score]), pa.array([model.prior])], list(Model._fields))

    one = sample(docs, rows, per_class, max_chars).repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")
    kinds = "known array<bigint>, weight array<double>, bias double, capitals double, move array<double>, score array<double>, prior double"
    r = one.mapInArrow(work, kinds).first()
    if r is None:  # no partition at all
        return fit(pa.array([], pa.string()), np.zeros(0, np.int64), counts.get(0, 0), counts.get(1, 0))
    return Model(np.array(r.known, np.int64).view(np.uint64), np.array(r.weight), r.bias, r.capitals, tuple(r.move), np.array(r.score), r.prior)


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, body, score, spans), a row for each row of ``docs``.

    ``spans`` (start, end, p) are runs of words of probability ``least`` or more, in code points, end exclusive, with the
    largest probability. ``body`` is xxhash64 of the text. The model has at most VOCABULARY weights.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for begin, data, offset in pieces(batch.column(2)):
                w = words(data, offset, ALNUM)
                p = _marginals(w, model) if len(model.known) and len(w.start) else np.zeros(len(w.start))
                value = 1 / (1 + np.exp(-np.clip(_features(p, w.first) @ model.score, -500, 500)))
                n = w.rows
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), batch.column(1).slice(begin, n), pa.array(value), pa.array(_spans(w, p, least), kind)],
                                                 ["doc_id", "body", "score", "spans"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(
        work, f"doc_id {ids}, body bigint, score double, spans array<struct<start:bigint,end:bigint,p:double>>")


def _spans(w: Words, p: np.ndarray, least: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(w.rows)]
    hit = np.flatnonzero(p >= least)
    if len(hit):
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        cuts = np.flatnonzero((np.diff(hit) > 1) | (np.diff(w.row[hit]) > 0)) + 1
        for run in np.split(hit, cuts):
            row = w.row[run[0]]
            zero = points[w.offset[row]]
            out[row].append({"start": int(points[w.start[run[0]]] - zero), "end": int(points[w.end[run[-1]]] - zero), "p": float(p[run].max())})
    return out
