"""Committees of three classifiers and their disagreement.

The committees of a round are fitted side by side: a labeled set is small, so a task fits one member of one campaign, or a part
of its forest. One labeled set too large for a task goes to pyspark.ml instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.operators.matrix import fit_logistic
from poolspark.operators.ranking import HOT_ROWS, exact_percentiles
from poolspark.operators.trees import Trees, fit_boosting, fit_forest, tree_values
from poolspark.session import dealt_by

# Fixed values.
FOREST_TREES = 300
FOREST_DEPTH = 30
BOOSTING_ROUNDS = 100
BOOSTING_DEPTH = 3
BOOSTING_STEP = 0.1
LOGISTIC_ITERATIONS = 2000
MEMBERS = ("logistic", "forest", "boosting")

# Trees of a forest that are grown in one task.
FOREST_PART = 100
# As for the base model: rows of one campaign that a task takes.
MAX_GROUP_ROWS = 5_000

# Arrays are stored as their bytes (int32 and float64): nobody reads them number by number.
MEMBER_COLUMNS = (
    "member string, part int, weights binary, intercept double, feature binary, threshold binary, "
    "child binary, value binary, roots binary, depth int"
)
COMMITTEE_SCHEMA = f"campaign string, target string, seed int, {MEMBER_COLUMNS}"


def fit_committees(
    labeled: DataFrame, round_id: int = 0, trees: int = FOREST_TREES, boosting_rounds: int = BOOSTING_ROUNDS
) -> DataFrame:
    """The members of every campaign's committee, one row each; a forest has a row for each FOREST_PART trees.

    ``labeled``: campaign, target, seed, mol_id, label, features. All campaigns and members are fitted in one job. The draws of a
    forest follow from campaign, seed, round and part, and rows are sorted, so neither retries nor the layout change them.
    """
    parts = [("logistic", 0, 0), ("boosting", 0, boosting_rounds)]
    parts += [("forest", k, min(FOREST_PART, trees - k * FOREST_PART)) for k in range(-(-trees // FOREST_PART))]
    tasks = F.array(*[F.struct(F.lit(m).alias("member"), F.lit(k).alias("part"), F.lit(n).alias("size")) for m, k, n in parts])
    none, no_ints = np.zeros(0), np.zeros(0, np.int32)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        head = group[["campaign", "target", "seed", "member", "part"]].head(1)
        campaign, member, size = head["campaign"].iloc[0], head["member"].iloc[0], int(group["size"].iloc[0])
        if len(group) > MAX_GROUP_ROWS:
            raise ValueError(f"campaign {campaign}: {len(group)} labeled rows, use train_committee")
        group = group.sort_values("mol_id")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in group["features"]])
        y = group["label"].to_numpy(dtype=np.float64)
        if len(np.unique(y)) < 2:
            raise ValueError(f"campaign {campaign}: the labeled rows hold one class only; a classifier needs both")
        weights, start, grown = none, 0.0, None
        if member == "logistic":
            _, _, weights, start = fit_logistic(x, y, scale=False, max_iter=LOGISTIC_ITERATIONS)
        elif member == "boosting":
            grown, start = fit_boosting(x, y, size, BOOSTING_DEPTH, BOOSTING_STEP)
        else:
            draw = [zlib.crc32(campaign.encode()), int(head["seed"].iloc[0]) & 0xFFFFFFFF, round_id, int(head["part"].iloc[0])]
            grown = fit_forest(x, y, size, np.random.default_rng(draw))
        grown = grown or Trees(no_ints, none, no_ints, none, no_ints, 0)
        arrays = {f: [getattr(grown, f).astype(t).tobytes()] for f, t in TREE_TYPES.items()}
        return head.assign(weights=[weights.tobytes()], intercept=[start], **arrays, depth=[grown.depth])

    wanted = labeled.select("campaign", "target", "seed", "mol_id", "label", "features", F.explode(tasks).alias("_t"))
    rows = wanted.select("*", "_t.member", "_t.part", "_t.size").drop("_t")
    return dealt_by(rows, "campaign", "member", "part").applyInPandas(fit, COMMITTEE_SCHEMA)


class Committee(NamedTuple):
    weights: np.ndarray
    intercept: float
    forest: list[Trees]
    boosting: Trees
    start: float


TREE_TYPES = {"feature": np.int32, "threshold": np.float64, "child": np.int32, "value": np.float64, "roots": np.int32}


def unpack(members: Sequence) -> Committee:
    """A committee from its rows (MEMBER_COLUMNS)."""
    kinds: dict[str, list] = {m: [] for m in MEMBERS}
    for r in sorted(members, key=lambda r: r["part"]):
        kinds[r["member"]].append(r)
    grown = {m: [_trees(r) for r in kinds[m]] for m in ("forest", "boosting")}
    (line,), (boosted,) = kinds["logistic"], kinds["boosting"]
    return Committee(np.frombuffer(line["weights"], np.float64), line["intercept"], grown["forest"], grown["boosting"][0], boosted["intercept"])


def _trees(r) -> Trees:
    return Trees(*(np.frombuffer(r[f], t) for f, t in TREE_TYPES.items()), r["depth"])


def member_cost(members: Sequence) -> int:
    """Bytes of a committee's rows."""
    return sum(64 + len(r["weights"]) + sum(len(r[f]) for f in TREE_TYPES) for r in members)


def member_probabilities(committee: Committee, x: np.ndarray) -> np.ndarray:
    """P(active) of every row by every member, in the order of MEMBERS."""
    sigmoid = lambda s: 1.0 / (1.0 + np.exp(-np.clip(s, -500, 500)))
    n_trees = sum(len(t.roots) for t in committee.forest)
    forest = sum(tree_values(t, x) for t in committee.forest) / max(n_trees, 1)
    return np.stack([
        sigmoid(x @ committee.weights + committee.intercept), forest,
        sigmoid(committee.start + tree_values(committee.boosting, x)),
    ])


def train_committee(
    labeled: DataFrame, seed: int, n_rows: int, trees: int = FOREST_TREES, boosting_rounds: int = BOOSTING_ROUNDS
) -> dict[str, Model]:
    """Logistic regression, random forest and gradient boosting on the same labeled rows."""
    rows = labeled.select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        raise ValueError("the labeled rows hold one class only; a classifier needs both")
    common = {"featuresCol": "vector", "labelCol": "label"}
    members = {
        "logistic": LogisticRegression(
            regParam=1.0 / n_rows, elasticNetParam=0.0, standardization=False, maxIter=LOGISTIC_ITERATIONS, **common
        ),
        "forest": RandomForestClassifier(
            numTrees=trees, maxDepth=FOREST_DEPTH, featureSubsetStrategy="sqrt", seed=seed, **common
        ),
        "boosting": GBTClassifier(
            maxIter=boosting_rounds, maxDepth=BOOSTING_DEPTH, stepSize=BOOSTING_STEP, seed=seed, **common
        ),
    }
    rows = rows.persist()
    try:
        return {name: member.fit(rows) for name, member in members.items()}
    finally:
        rows.unpersist()


def committee_probabilities(committee: dict[str, Model], df: DataFrame) -> DataFrame:
    """Adds ``member_p``: P(active) by each member, in one pass over the rows."""
    scored = df.withColumn("_vector", array_to_vector("features"))
    for name, model in committee.items():
        model = model.copy()
        model.setFeaturesCol("_vector")
        model.setProbabilityCol(f"_p_{name}").setRawPredictionCol(f"_r_{name}").setPredictionCol(f"_y_{name}")
        scored = model.transform(scored).drop(f"_r_{name}", f"_y_{name}")
    members = [
        F.struct(F.lit(name).alias("member"), F.element_at(vector_to_array(f"_p_{name}"), 2).alias("p"))
        for name in committee
    ]
    return scored.select(*df.columns, F.array(*members).alias("member_p"))


def long_probabilities(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, member, p."""
    return df.select(*keys, F.inline("member_p"))


def disagreement(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population variance of the members' P(active) per item."""
    return long.groupBy(*keys).agg(F.var_pop("p").alias("disagreement"))


def with_disagreement(df: DataFrame) -> DataFrame:
    """The same variance taken inside the row, with no shuffle, where all members are at hand."""
    p = F.transform("member_p", lambda m: m["p"])
    n = F.size(p)
    mean = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v) / n
    spread = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + (v - F.col("_mean")) * (v - F.col("_mean"))) / n
    return df.withColumn("_mean", mean).withColumn("disagreement", spread).drop("_mean")


def disagreement_stats(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, maximum and exact median disagreement per campaign."""
    medians = exact_percentiles(
        df, keys, "disagreement", [0.5], hot_rows,
        _sum=(F.sum("disagreement"), F.sum("_sum")),
        _n=(F.count(F.lit(1)), F.sum("_n")),
        max_disagreement=(F.max("disagreement"), F.max("max_disagreement")),
    )
    return medians.select(
        *keys,
        (F.col("_sum") / F.col("_n")).alias("mean_disagreement"),
        "max_disagreement",
        F.element_at("percentiles", 1).alias("median_disagreement"),
    )


def diagnostics(rows: DataFrame, scores: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row with its disagreement (0 where it is labeled already) and whether it was selected."""
    chosen = selected.select(*keys).withColumn("_s", F.lit(True))
    return (
        rows.join(scores.select(*keys, "disagreement"), list(keys), "left")
        .join(chosen, list(keys), "left")
        .withColumn("disagreement", F.coalesce("disagreement", F.lit(0.0)))
        .withColumn("selected", F.coalesce("_s", F.lit(False)))
        .drop("_s")
    )
