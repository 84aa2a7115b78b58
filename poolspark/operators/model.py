"""Base model: many small fits at once, then one scan of the pool scores for all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.operators import committee as qbc
from poolspark.operators.matrix import fit_logistic, target_slices
from poolspark.operators.pool import blocks, feature_bytes
from poolspark.session import BROADCAST_BYTES, cut_lineage, dealt_by

# A grouped fit solves an n x n system; larger labeled sets go to the distributed solver.
MAX_GROUP_ROWS = 5_000

MODEL_SCHEMA = "campaign string, target string, strategy string, seed int, features array<double>, intercept double"


def fit_campaigns(labeled: DataFrame) -> DataFrame:
    """One standardised logistic regression per campaign, folded into raw weights (``features``) and intercept.

    ``labeled``: campaign, target, strategy, seed, label, features. Group sizes are bounded by
    n_initial + rounds * batch; a larger set is refused here and belongs to fit_large.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > MAX_GROUP_ROWS:
            raise ValueError(f"campaign {group['campaign'].iloc[0]}: {len(group)} labeled rows, use fit_large")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in group["features"]])
        try:
            mean, dev, w, b = fit_logistic(x, group["label"].to_numpy(dtype=np.float64))
        except ValueError as error:
            raise ValueError(f"campaign {group['campaign'].iloc[0]}: {error}") from error
        w = w / dev
        head = group[["campaign", "target", "strategy", "seed"]].head(1)
        return head.assign(features=[w], intercept=[b - float(mean @ w)])

    wanted = labeled.select("campaign", "target", "strategy", "seed", "mol_id", "label", "features")
    # Sorted rows make the sums, and so the result, independent of the shuffle order.
    ordered = lambda group: fit(group.sort_values("mol_id"))
    return dealt_by(wanted, "campaign").applyInPandas(ordered, MODEL_SCHEMA)


def fit_large(labeled: DataFrame, n_rows: int, max_iter: int = 100):
    """The same objective on one large labeled set, as a pyspark.ml pipeline model.

    ml divides the loss by n, so C = 1 becomes regParam = 1 / n. The scaler uses the sample
    deviation; the difference is a factor of sqrt((n - 1) / n), nil at this size.
    """
    if labeled.select("label").distinct().count() < 2:
        raise ValueError("the labeled rows hold one class only; a classifier needs both")
    stages = [
        StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="scaled", labelCol="label", regParam=1.0 / n_rows, elasticNetParam=0.0,
            standardization=False, maxIter=max_iter, tol=1e-9,
        ),
    ]
    return Pipeline(stages=stages).fit(labeled.withColumn("vector", array_to_vector("features")))


def model_blocks(models: DataFrame, extra: Sequence[str] = ()) -> Iterator[dict[str, list]]:
    """Models by target, in broadcast blocks of bounded size. ``extra`` adds further columns."""
    ordered = models.orderBy("target", "campaign", *extra)
    for block in blocks(ordered.toLocalIterator(), ("target", "campaign"), BROADCAST_BYTES):
        by_target: dict[str, list] = {}
        for (target, _), rows in block:
            by_target.setdefault(target, []).extend(rows)
        yield by_target


def weights(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["features"] for r in rows], dtype=np.float64), np.array([r["intercept"] for r in rows])


def probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(active): one row per item, one column per model."""
    return 1.0 / (1.0 + np.exp(-np.clip(x @ w.T + b, -500, 500)))


SCORE_SCHEMA = "campaign string, round int, mol_id bigint, label int, p double"


def score_rows(pool: DataFrame, models: DataFrame, seeds: Sequence[int], held_out: bool) -> DataFrame:
    """P(active) of every held-out (or every pool) row under every model of its target and seed.

    ``models`` carries a round column, so the models of all rounds are applied in one scan.
    """
    position = {s: i for i, s in enumerate(seeds)}
    parts = []
    for block in model_blocks(models, ["round"]):
        packed = {
            target: (*weights(rows), [(r["campaign"], r["round"], position[r["seed"]]) for r in rows])
            for target, rows in block.items()
        }
        parts.append(_score_block(pool, packed, held_out))
    parts = parts or [_score_block(pool, {}, held_out)]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored


def _score_block(pool: DataFrame, packed: dict, held_out: bool) -> DataFrame:
    shared = pool.sparkSession.sparkContext.broadcast(packed)

    def scan(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for target, at, x, ids, mask in target_slices(batch):
                if target not in shared.value:
                    continue
                w, b, heads = shared.value[target]
                p = probabilities(x, w, b)
                for column, (campaign, round_id, seed_no) in enumerate(heads):
                    rows = np.flatnonzero(mask[:, seed_no] == held_out)
                    if len(rows):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "campaign": [campaign] * len(rows),
                                "round": pa.array([round_id] * len(rows), pa.int32()),
                                "mol_id": ids[rows],
                                "label": pa.array(labels[at[rows]], pa.int32()),
                                "p": p[rows, column],
                            }
                        )

    return pool.select("target", "mol_id", "label", "features", "test_mask").mapInArrow(scan, SCORE_SCHEMA)


CANDIDATE_SCHEMA = "campaign string, mol_id bigint, score double"


def best_candidates(
    pool: DataFrame, models: DataFrame, labeled: DataFrame, seeds: Sequence[int], keep: dict[str, int],
    committees: DataFrame | None = None,
) -> DataFrame:
    """The best unlabeled rows per campaign and task, ids and scores only, to be ranked further by score, then id.

    ``keep`` maps a strategy to the number of rows it needs; low scores are better. ``pool`` may
    carry ``draw``, one random number per seed, which is the score of the random strategy; a campaign with members in
    ``committees`` is scored by their disagreement. A task keeps only the best rows it has seen so far, so the output has
    at most that many rows per campaign and task. Labeled ids travel with the models: a few per campaign.

    Models go out in blocks of at most BROADCAST_BYTES, each of which is scored in a scan of its own, written, and dropped.
    """
    tested = labeled.groupBy("campaign").agg(F.collect_list("mol_id").alias("tested"))
    rows = models.join(tested, "campaign")
    if committees is not None:
        fields = [c for c in committees.columns if c not in ("campaign", "target", "seed")]
        members = committees.groupBy("campaign").agg(F.collect_list(F.struct(*fields)).alias("members"))
        rows = rows.join(members, "campaign", "left")
    else:
        rows = rows.withColumn("members", F.lit(None))
    position = {s: i for i, s in enumerate(seeds)}
    cost = lambda r: feature_bytes(r) + 8 * len(r["tested"]) + qbc.member_cost(r["members"] or ())
    found = None
    for block in blocks(rows.orderBy("target", "campaign").toLocalIterator(), ("target", "campaign"), BROADCAST_BYTES, cost):
        packed: dict[str, list] = {}
        for (target, _), own in block:
            packed.setdefault(target, []).extend(own)
        shared = pool.sparkSession.sparkContext.broadcast({target: (*weights(own), [_head(r, position, keep) for r in own]) for target, own in packed.items()})
        part = cut_lineage(_candidate_block(pool, shared))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return pool.sparkSession.createDataFrame([], CANDIDATE_SCHEMA) if found is None else found


def _head(row, position: dict[int, int], keep: dict[str, int]) -> tuple:
    committee = qbc.unpack(row["members"]) if row["members"] else None
    return row["campaign"], row["strategy"], position[row["seed"]], np.array(row["tested"]), keep[row["strategy"]], committee


def _candidate_block(pool: DataFrame, shared) -> DataFrame:
    columns = ["target", "mol_id", "features", "test_mask"]
    columns += [c for c in ("draw",) if c in pool.columns]

    def scores(strategy, committee, x, p, draw, seed_no):
        if committee is not None:
            return -np.var(qbc.member_probabilities(committee, x), axis=0)
        if strategy == "random":
            return draw[:, seed_no]
        return -p if strategy == "greedy" else np.abs(p - 0.5)

    def scan(batches):
        best: dict[str, tuple] = {}
        for batch in batches:
            draws = None
            if "draw" in columns:
                draws = batch.column("draw").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                draws = draws.reshape(batch.num_rows, -1)
            for target, at, x, ids, mask in target_slices(batch):
                if target not in shared.value:
                    continue
                w, b, heads = shared.value[target]
                p = probabilities(x, w, b)
                for column, (campaign, strategy, seed_no, tested, k, committee) in enumerate(heads):
                    rows = np.flatnonzero(~mask[:, seed_no])
                    score = scores(strategy, committee, x[rows], p[rows, column], None if draws is None else draws[at[rows]], seed_no)
                    if np.isnan(score).any():
                        raise ValueError(f"campaign {campaign}: NaN score")
                    if len(rows) > k + len(tested):
                        # Enough of the lowest scores to fill k after removing tested rows, with all ties.
                        edge = np.partition(score, k + len(tested) - 1)[k + len(tested) - 1]
                        close = score <= edge
                        rows, score = rows[close], score[close]
                    fresh = ~np.isin(ids[rows], tested)
                    new = (score[fresh], ids[rows[fresh]])
                    old = best.get(campaign)
                    if old is not None:
                        new = tuple(np.concatenate([a, c]) for a, c in zip(old, new))
                    order = np.lexsort((new[1], new[0]))[:k]
                    best[campaign] = tuple(part[order] for part in new)
        for campaign, (score, ids) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_pydict({"campaign": [campaign] * len(ids), "mol_id": ids, "score": score.astype(np.float64)})

    return pool.select(*columns).mapInArrow(scan, CANDIDATE_SCHEMA)


def with_features(pool: DataFrame, chosen: DataFrame, most: int = 200_000) -> DataFrame:
    """``chosen`` (target, mol_id, ...) with label and features; up to ``most`` chosen rows are sent to the pool, not the pool to them."""
    narrow = F.broadcast(chosen) if chosen.limit(most + 1).count() <= most else chosen
    return pool.select("target", "mol_id", "label", "features").join(narrow, ["target", "mol_id"])


MEMBER_SCHEMA = "campaign string, mol_id bigint, label int, member_p array<struct<member:string,p:double>>"


def score_committees(pool: DataFrame, committees: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """P(active) by each member for every pool row of the campaign's target that its seed does not hold out."""
    position = {s: i for i, s in enumerate(seeds)}
    fields = [c for c in committees.columns if c not in ("campaign", "target", "seed")]
    rows = committees.groupBy("target", "campaign", "seed").agg(F.collect_list(F.struct(*fields)).alias("members")).orderBy("target", "campaign")
    scored = None
    for block in blocks(rows.toLocalIterator(), ("target", "campaign"), BROADCAST_BYTES, lambda r: qbc.member_cost(r["members"])):
        packed: dict[str, list] = {}
        for (target, campaign), (row,) in block:
            packed.setdefault(target, []).append((campaign, position[row["seed"]], qbc.unpack(row["members"])))
        part = _member_block(pool, pool.sparkSession.sparkContext.broadcast(packed))
        scored = part if scored is None else scored.unionByName(part)
    return pool.sparkSession.createDataFrame([], MEMBER_SCHEMA) if scored is None else scored


def _member_block(pool: DataFrame, shared) -> DataFrame:
    kind = pa.list_(pa.struct([("member", pa.string()), ("p", pa.float64())]))

    def scan(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for target, at, x, ids, mask in target_slices(batch):
                for campaign, seed_no, committee in shared.value.get(target, ()):
                    rows = np.flatnonzero(~mask[:, seed_no])
                    p = qbc.member_probabilities(committee, x[rows])
                    entries = pa.StructArray.from_arrays([pa.array(qbc.MEMBERS * len(rows)), pa.array(p.T.ravel())], ["member", "p"])
                    offsets = pa.array(np.arange(len(rows) + 1) * len(qbc.MEMBERS), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([campaign] * len(rows), pa.string()), pa.array(ids[rows], pa.int64()), pa.array(labels[at[rows]], pa.int32()),
                         pa.ListArray.from_arrays(offsets, entries).cast(kind)], ["campaign", "mol_id", "label", "member_p"])

    return pool.select("target", "mol_id", "label", "features", "test_mask").mapInArrow(scan, MEMBER_SCHEMA)
