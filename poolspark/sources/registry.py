"""Target registry: which names belong to a target and at which value it counts as active."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolspark.functions.measures import DEFAULT_THRESHOLD_NM

REGISTRY_SCHEMA = "target string, query string, match string, threshold double"
MATCH_MODES = ("exact", "contains")

# Shipped targets as (target, query, match, threshold in nM).
SHIPPED_TARGETS = (
    ("EGFR", "Epidermal growth factor receptor", "exact", 500.0),
    ("JAK2", "Tyrosine-protein kinase JAK2", "exact", 100.0),
    ("PARP1", "Poly [ADP-ribose] polymerase 1", "exact", 50.0),
    ("BRAF", "Serine/threonine-protein kinase B-raf", "exact", 100.0),
    ("ABL1", "Tyrosine-protein kinase ABL1", "exact", 500.0),
    ("SRC", "Proto-oncogene tyrosine-protein kinase Src", "exact", 1000.0),
    ("VEGFR2", "Vascular endothelial growth factor receptor 2", "exact", 500.0),
    ("CDK2", "Cyclin-dependent kinase 2", "exact", 1000.0),
    ("DRD2", "D(2) dopamine receptor", "exact", 500.0),
    ("CA2", "Carbonic anhydrase 2", "exact", 100.0),
)

# A registry is a hand-written configuration; it is broadcast, so its size is checked.
MAX_REGISTRY_ROWS = 10_000


def registry_from_rows(spark: SparkSession, rows: Sequence[tuple] = SHIPPED_TARGETS) -> DataFrame:
    """Rows (target, query, match or None, threshold or None) with the defaults filled in."""
    if len(rows) > MAX_REGISTRY_ROWS:
        raise ValueError(f"A registry holds at most {MAX_REGISTRY_ROWS} targets, got {len(rows)}")
    unknown = sorted({r[2] for r in rows if r[2] is not None} - set(MATCH_MODES))
    if unknown:
        raise ValueError(f"unknown match modes {unknown}, known are {MATCH_MODES}")
    return spark.createDataFrame(list(rows), REGISTRY_SCHEMA).select(
        "target",
        "query",
        F.coalesce("match", F.lit("contains")).alias("match"),
        F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD_NM)).alias("threshold"),
    )


def registry_from_mapping(spark: SparkSession, config: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """The parsed form of a configuration file: target -> {query, match, activity_threshold_nM}."""
    rows = []
    for target, entry in config.items():
        limit = entry.get("activity_threshold_nM")
        rows.append((target, entry["query"], entry.get("match"), None if limit is None else float(limit)))
    return registry_from_rows(spark, rows)


def pick_targets(registry: DataFrame, targets: Sequence[str]) -> DataFrame:
    """The requested registry rows; an unknown name is an error that lists the known ones."""
    known = [r["target"] for r in registry.select("target").collect()]
    unknown = [t for t in targets if t not in known]
    if unknown:
        raise ValueError(f"the registry has no targets {unknown}, it has {known}")
    return registry.where(F.col("target").isin(*targets))
