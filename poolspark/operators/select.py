"""Batch selection strategies: which unlabeled rows to test next.

Inputs hold one row per (campaign, candidate). Every strategy is a top-k, which Spark prunes
inside each task before anything is shuffled; ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from poolspark.functions.ordering import order_key
from poolspark.functions.scoring import uncertainty
from poolspark.operators.matrix import farthest_point_order
from poolspark.operators.ranking import top_k

# Fixed values.
BATCH_SIZE = 10
SHORTLIST = 100


def reject_nan(score: Column) -> Column:
    """NaN sorts above every number in Spark, so a NaN score must not reach a ranking."""
    return F.when(F.isnan(score), F.raise_error(F.lit("NaN score"))).otherwise(score)


def require_batch(candidates: DataFrame, keys: Sequence[str], batch_size: int) -> None:
    """A random draw without replacement needs at least batch_size rows per campaign."""
    short = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < batch_size)
    found = short.limit(5).collect()
    if found:
        raise ValueError(f"batch_size {batch_size} exceeds the unlabeled pool of {found}")


def select_random(
    candidates: DataFrame, keys: Sequence[str], seed: Column, batch_size: int = BATCH_SIZE,
    row_id: str = "mol_id", method: str = "xxhash64",
) -> DataFrame:
    """Uniform draw; ``seed`` is the campaign's seed plus the round."""
    require_batch(candidates, keys, batch_size)
    keyed = candidates.withColumn("_k", order_key(seed, F.col(row_id), method))
    return top_k(keyed, keys, [F.col("_k"), F.col(row_id)], batch_size).drop("_k")


def select_by_score(
    candidates: DataFrame, keys: Sequence[str], score: Column, batch_size: int = BATCH_SIZE,
    highest: bool = True, row_id: str = "mol_id",
) -> DataFrame:
    """The rows with the highest (or lowest) score; a short pool gives fewer rows."""
    checked = reject_nan(score)
    order = checked.desc() if highest else checked.asc()
    return top_k(candidates, keys, [order, F.col(row_id)], batch_size)


def select_greedy(candidates: DataFrame, keys: Sequence[str], batch_size: int = BATCH_SIZE, p: str = "p") -> DataFrame:
    return select_by_score(candidates, keys, F.col(p), batch_size)


def select_uncertainty_topk(
    candidates: DataFrame, keys: Sequence[str], batch_size: int = BATCH_SIZE, p: str = "p"
) -> DataFrame:
    return select_by_score(candidates, keys, uncertainty(F.col(p)), batch_size, highest=False)


def select_query_by_committee(
    candidates: DataFrame, keys: Sequence[str], batch_size: int = BATCH_SIZE, disagreement: str = "disagreement"
) -> DataFrame:
    return select_by_score(candidates, keys, F.col(disagreement), batch_size)


def select_uncertainty_diverse(
    candidates: DataFrame, keys: Sequence[str], seed: Column, batch_size: int = BATCH_SIZE,
    candidate_pool_size: int = SHORTLIST, p: str = "p", row_id: str = "mol_id", features: str = "features",
    method: str = "xxhash64",
) -> DataFrame:
    """A spread-out batch from the most uncertain rows, with its ``rank``."""
    if candidate_pool_size < batch_size:
        raise ValueError("a batch does not fit into a shortlist of candidate_pool_size rows")
    shortlist = select_uncertainty_topk(candidates, keys, candidate_pool_size, p)
    return select_diverse_subset(shortlist.drop("rank"), keys, seed, batch_size, row_id, features, method)


def select_diverse_subset(
    shortlist: DataFrame, keys: Sequence[str], seed: Column, n_select: int = BATCH_SIZE,
    row_id: str = "mol_id", features: str = "features", method: str = "xxhash64",
) -> DataFrame:
    """Farthest-point selection within each campaign's shortlist, from a random start; adds ``rank``.

    A shortlist holds at most the shortlist size per campaign, so a group is always small.
    """
    wanted = shortlist.withColumn("_k", order_key(seed, F.col(row_id), method))
    schema = StructType([*shortlist.schema.fields, StructField("rank", IntegerType())])

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_k", row_id]).reset_index(drop=True)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in group[features]])
        order = farthest_point_order(group[row_id].to_numpy(), x, 0, n_select)
        out = group.iloc[order].drop(columns="_k")
        return out.assign(rank=np.arange(1, len(order) + 1, dtype="int32"))

    return wanted.groupBy(*keys).applyInPandas(pick, schema)


def restrict_to(candidates: DataFrame, shortlist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that are on the shortlist."""
    return candidates.join(shortlist.select(*keys), list(keys), "left_semi")


def exclude(candidates: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that have not been chosen yet."""
    return candidates.join(chosen.select(*keys), list(keys), "left_anti")
