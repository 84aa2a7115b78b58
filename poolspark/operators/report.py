"""Summaries and comparison tables over campaign histories, metadata and descriptors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolspark.operators.pool import STRATEGIES
from poolspark.operators.ranking import HOT_ROWS, exact_percentiles, hot_groups, top_k

# Fixed values.
STRATEGY_LABELS = {
    "greedy": "Greedy",
    "random": "Random",
    "uncertainty_topk": "Top-K",
    "uncertainty_diverse": "Diverse",
    "query_by_committee": "QBC",
}
CAMPAIGN_KEYS = ("target", "initialization_strategy", "strategy", "round")
REPORT_ROUND = 10


def strategy_label(strategy: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STRATEGY_LABELS.items() for x in pair])[strategy]


def summarize(history: DataFrame, keys: Sequence[str] = CAMPAIGN_KEYS) -> DataFrame:
    """Mean and sample deviation of AUC and actives over the seeds of a target; the deviation of one seed is NULL."""
    return history.groupBy(*keys).agg(
        F.avg("roc_auc").alias("roc_auc_mean"),
        F.stddev_samp("roc_auc").alias("roc_auc_std"),
        F.avg("n_actives_found").alias("actives_mean"),
        F.stddev_samp("n_actives_found").alias("actives_std"),
    )


def at_round(summary: DataFrame, round_id: int = REPORT_ROUND) -> DataFrame:
    return summary.where(F.col("round") == round_id)


def auc_band(summary: DataFrame) -> DataFrame:
    """AUC curve with its band of one deviation to each side."""
    mean, std = F.col("roc_auc_mean"), F.col("roc_auc_std")
    return summary.withColumn("auc_low", mean - std).withColumn("auc_high", mean + std)


def best_initialization(summary: DataFrame, round_id: int = REPORT_ROUND) -> DataFrame:
    """The row of the best initialization by AUC per (target, strategy)."""
    order = [F.desc("roc_auc_mean"), F.col("initialization_strategy")]
    return top_k(at_round(summary, round_id), ["target", "strategy"], order, 1).drop("rank")


def best_campaign(summary: DataFrame, round_id: int = REPORT_ROUND) -> DataFrame:
    """The best (init, strategy) of a round per target."""
    order = [F.desc("roc_auc_mean"), F.col("initialization_strategy"), F.col("strategy")]
    return top_k(at_round(summary, round_id), ["target"], order, 1).drop("rank")


def metric_matrix(best: DataFrame, metric: str) -> DataFrame:
    """target x strategy in fixed column order; an absent combination is NULL."""
    return best.groupBy("target").pivot("strategy", list(STRATEGIES)).agg(F.first(metric))


def matrix_cells(best: DataFrame, metric: str) -> DataFrame:
    """Long form of the matrix with absent cells: target, position, strategy, value."""
    stacked = F.posexplode(F.array(*[F.lit(s) for s in STRATEGIES])).alias("position", "strategy")
    frame = best.select("target").distinct().select("target", stacked)
    values = best.select("target", "strategy", F.col(metric).alias("value"))
    return frame.join(values, ["target", "strategy"], "left")


def rank_table(best: DataFrame, metric: str = "roc_auc_mean") -> DataFrame:
    """Strategies of each target from best to worst; absent ones come last."""
    order = W.partitionBy("target").orderBy(F.desc_nulls_last("value"), "position")
    ranked = matrix_cells(best, metric).withColumn("rank", F.row_number().over(order))
    names = list(range(1, len(STRATEGIES) + 1))
    wide = ranked.groupBy("target").pivot("rank", names).agg(F.first(strategy_label(F.col("strategy"))))
    return wide.select("target", *[F.col(str(i)).alias(f"rank_{i}") for i in names])


def win_counts(best: DataFrame, metric: str = "roc_auc_mean") -> DataFrame:
    """How many targets each strategy wins, zero included."""
    order = [F.desc_nulls_last("value"), F.col("position")]
    winners = top_k(matrix_cells(best, metric).where(F.col("value").isNotNull()), ["target"], order, 1)
    counts = winners.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    listed = best.sparkSession.createDataFrame([(s,) for s in STRATEGIES], "strategy string")
    return listed.join(counts, "strategy", "left").select(
        "strategy", strategy_label(F.col("strategy")).alias("label"), F.coalesce("n", F.lit(0)).cast("bigint").alias("wins")
    )


def heatmap_cells(best: DataFrame, metric: str) -> DataFrame:
    """Cells scaled to 0..1 over the whole matrix. Both bounds are one scalar subquery."""
    cells = matrix_cells(best, metric)
    bounds = best.agg(F.struct(F.min(metric).alias("low"), F.max(metric).alias("high"))).scalar()
    scaled = (F.col("value") - bounds["low"]) / (bounds["high"] - bounds["low"] + F.lit(1e-12))
    return cells.select("target", "strategy", "value", scaled.alias("scaled"))


def pareto_points(best: DataFrame) -> DataFrame:
    """Model quality against discovery per (target, strategy)."""
    return best.select("target", "strategy", strategy_label(F.col("strategy")).alias("label"), "roc_auc_mean", "actives_mean")


def attach_metric(campaigns: DataFrame, summary: DataFrame, round_id: int = REPORT_ROUND) -> DataFrame:
    """Campaign rows with the metrics of their (target, init, strategy) at a round."""
    keys = ["target", "initialization_strategy", "strategy"]
    joined = campaigns.join(at_round(summary, round_id).select(*keys, "roc_auc_mean", "roc_auc_std", "actives_mean"), keys)
    return joined.withColumn("label", strategy_label(F.col("strategy")))


def descriptor_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair (a, b) over rows where both are known; NULL for a constant column.

    Rows are unfolded into pairs and summed up in the same task, so only one row per pair and task
    is shuffled.
    """
    number = lambda name: F.col(name).cast("double")
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), number(a).alias("x"), number(b).alias("y"))
        for i, a in enumerate(columns)
        for b in columns[i:]
    ]
    complete = df.select(*columns).select(F.inline(F.array(*pairs))).na.drop(subset=["x", "y"])
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    half = complete.groupBy("a", "b").agg(F.try_divide(F.covar_pop("x", "y"), spread).alias("r"))
    both = F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return half.select(F.inline(F.array_distinct(both)))


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, descriptor, value."""
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(keys), list(columns), "descriptor", "value")


def descriptor_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """target, descriptor and one column per quantile (q01, q25, ...)."""
    long = melt(df, ["target"], columns)
    # Rows per target bound rows per (target, descriptor); counting them reads no descriptor.
    hot = hot_groups(df, ["target"], hot_rows)
    found = exact_percentiles(long, ["target", "descriptor"], "value", list(probs), hot=hot)
    values = [F.element_at("percentiles", i + 1).alias(f"q{round(p * 100):02d}") for i, p in enumerate(probs)]
    return found.select("target", "descriptor", *values)


def clip_limits(df: DataFrame, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Plot limits per descriptor over all targets: 1 % (not below 0) and 99 %."""
    hot = hot_groups(df, [], hot_rows)
    found = exact_percentiles(melt(df, [], columns), ["descriptor"], "value", [0.01, 0.99], hot=hot)
    low, high = F.element_at("percentiles", 1), F.element_at("percentiles", 2)
    return found.select("descriptor", F.greatest(F.lit(0.0), low).alias("low"), high.alias("high"))


def descriptor_scatter(df: DataFrame, x: str, y: str, row_id: str = "mol_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Scatter rows of the two chosen descriptors, flagged when beyond their own 99 % limit."""
    limits = clip_limits(df, [x, y], hot_rows)
    limit = lambda name: limits.where(F.col("descriptor") == name).select("high").scalar()
    inside = (F.col("x") <= limit(x)) & (F.col("y") <= limit(y))
    rows = df.select("target", row_id, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "label")
    return rows.withColumn("inside", inside)


def dataset_table(metadata: DataFrame) -> DataFrame:
    return metadata.select(
        "target", F.col("n_valid").alias("molecules"), F.round("active_fraction", 3).alias("active_fraction"), "threshold"
    )
