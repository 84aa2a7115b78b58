"""Build the master table and prepare all registry targets in one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolspark.functions.features import DEFAULT_BITS, DEFAULT_RADIUS, DESCRIPTORS
from poolspark.operators.clean import build_master
from poolspark.operators.features import add_fingerprint, add_profile
from poolspark.operators.targets import label_targets, metadata_documents, missing_targets, target_metadata
from poolspark.session import shared_table
from poolspark.sources.registry import pick_targets
from poolspark.sources.tables import read_master, read_measurements, require_columns, write_metadata, write_table


def write_master(spark: SparkSession, source: str, path: str) -> None:
    """Delimited dump -> master table. The lower-case target name is stored for later filters."""
    write_table(build_master(read_measurements(spark, source)), path, partition_by=())


def row_key() -> F.Column:
    """Stable 64-bit id of a master row; the readable key columns are kept beside it. ``require_unique`` tells when two rows share one."""
    return F.xxhash64("target_name", "entity_key", "measure_type")


def require_unique(featured: DataFrame) -> None:
    """Joins by (target, mol_id) rely on one row for each; from billions of rows a 64-bit hash may repeat."""
    twice = featured.groupBy("target", "mol_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"row ids that stand for several rows: {[(r.target, r.mol_id) for r in twice]}")


def featurize_targets(
    sliced: DataFrame, radius: int = DEFAULT_RADIUS, n_bits: int = DEFAULT_BITS, unit: str = "char"
) -> DataFrame:
    """Labelled slices with mol_id, on-bits and profile; ``fp`` is NULL for rows too short to featurise."""
    keyed = sliced.withColumn("mol_id", row_key())
    return add_profile(add_fingerprint(keyed, "entity_key", radius=radius, n_bits=n_bits, unit=unit), "entity_key")


def prepare_targets(
    spark: SparkSession, master_path: str, registry: DataFrame, base_dir: str, targets: Sequence[str] | None = None,
    radius: int = DEFAULT_RADIUS, n_bits: int = DEFAULT_BITS,
) -> None:
    """Slices, features, descriptors and metadata of all (or the named) targets, partitioned by target.

    The slices are written once and everything else is derived from that table.
    """
    wanted = registry if targets is None else pick_targets(registry, targets)
    sliced = label_targets(read_master(spark, master_path), wanted)
    featured = shared_table(featurize_targets(sliced, radius, n_bits), "prepared")
    absent = missing_targets(featured, wanted).select("target", "query").collect()
    if absent:
        raise ValueError("no name matches " + ", ".join(f"{r.query!r} (target {r.target})" for r in absent))
    require_unique(featured)
    _write_prepared(featured, base_dir, radius, n_bits)


def prepare_labelled(
    spark: SparkSession, path: str, target: str, base_dir: str, radius: int = DEFAULT_RADIUS, n_bits: int = DEFAULT_BITS
) -> None:
    """The same outputs for a single-target table that has its labels already."""
    rows = require_columns(spark.read.parquet(path), ["entity_key", "label"])
    fill = {"target_name": F.lit(target), "measure_type": F.lit(None).cast("string")}
    rows = rows.withColumns({name: value for name, value in fill.items() if name not in rows.columns})
    sliced = rows.withColumns(
        {"target": F.lit(target), "query": F.lit(target), "match": F.lit("exact"), "threshold": F.lit(None).cast("double")}
    )
    _write_prepared(shared_table(featurize_targets(sliced, radius, n_bits), "prepared"), base_dir, radius, n_bits)


def _write_prepared(featured: DataFrame, base_dir: str, radius: int, n_bits: int) -> None:
    valid = featured.where(F.col("fp").isNotNull())
    write_table(featured.drop("fp", *DESCRIPTORS), f"{base_dir}/clean")
    write_table(valid.select("target", "mol_id", "entity_key", "fp", "label"), f"{base_dir}/prepared")
    write_table(valid.select("target", "mol_id", *DESCRIPTORS, "label"), f"{base_dir}/descriptors")
    write_metadata(metadata_documents(target_metadata(featured, "fp"), base_dir, radius, n_bits), f"{base_dir}/metadata")
