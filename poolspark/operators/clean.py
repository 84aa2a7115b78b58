"""Measurement cleaning: one usable value per row, then one row per (target, entity, type)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.functions.measures import activity_label, best_measure, blank_to_null, free_energy
from poolspark.operators.ranking import HOT_ROWS, exact_percentiles, hot_groups

GROUP = ("target_name", "entity_key", "measure_type")


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["target_name", "raw_key"])


def add_best_measure(df: DataFrame) -> DataFrame:
    """Adds measure_type, value and relation; NULL where no measure is usable."""
    return df.select("*", best_measure())


def pick_measure(df: DataFrame) -> DataFrame:
    return add_best_measure(df).where(F.col("value").isNotNull())


def add_entity_key(df: DataFrame) -> DataFrame:
    """Keeps a supplied entity_key, else derives it from the raw key; invalid rows are dropped."""
    if "entity_key" not in df.columns:
        df = df.withColumn("entity_key", blank_to_null(F.col("raw_key")))
    return df.where(F.col("entity_key").isNotNull())


def clean(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Stateless per-row cleaning, in batch or on a stream. ``order`` columns are carried along."""
    rows = pick_measure(add_entity_key(drop_unnamed(df)))
    return rows.select("target_name", "raw_key", "entity_key", "measure_type", "value", "relation", *order)


def build_master(raw: DataFrame, order: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Raw measurements -> one row per (target, entity, type).

    Columns: exact median, count, first raw key, energy, label. "First" means lowest by
    ``order``, then by raw key. One shuffle, on the group; the size probe reads only the two name
    columns, since rows per (target, entity) bound rows per group.
    """
    return aggregate_clean(clean(raw, order), order, hot_rows, add_entity_key(drop_unnamed(raw)))


def aggregate_clean(
    cleaned: DataFrame, order: Sequence[str] = (), hot_rows: int = HOT_ROWS, sized: DataFrame | None = None
) -> DataFrame:
    """build_master for rows that are clean already."""
    first = F.min(F.struct(*order, "raw_key"))
    hot = hot_groups(cleaned if sized is None else sized, GROUP[:2], hot_rows)
    grouped = exact_percentiles(
        cleaned,
        list(GROUP),
        "value",
        [0.5],
        hot=hot,
        n_meas=(F.count(F.lit(1)), F.sum("n_meas")),
        first=(first, F.min("first")),
    )
    median = F.col("value_median")
    return grouped.withColumn("value_median", F.element_at("percentiles", 1)).select(
        "target_name",
        F.col("first.raw_key").alias("raw_key"),
        "entity_key",
        "measure_type",
        median,
        free_energy(median).alias("dg"),
        "n_meas",
        activity_label(median).alias("label"),
        F.lower("target_name").alias("target_lc"),
    )


def master_totals(master: DataFrame) -> DataFrame:
    """Rows, distinct targets and overall active fraction."""
    return master.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("target_name").alias("n_targets"),
        F.avg("label").alias("active_fraction"),
    )


def chunk_counts(raw: DataFrame, chunk: str) -> DataFrame:
    """Raw and cleaned rows per input piece, in one pass.

    A plain aggregate rather than an Observation: once a session has observed something, pyspark.ml
    models can no longer be applied in it, because their closures capture the session.
    """
    usable = (
        F.col("target_name").isNotNull() & F.col("value").isNotNull() & blank_to_null(F.col("raw_key")).isNotNull()
    )
    return add_best_measure(raw).groupBy(chunk).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count(F.when(usable, 1)).alias("n_cleaned"),
    )


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)
