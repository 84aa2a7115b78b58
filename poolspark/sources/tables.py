"""Scans, lookups and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolspark.functions.measures import missing_to_null_text

# Source column -> our column.
MEASUREMENT_COLUMNS = {
    "Target Name": "target_name",
    "Ligand SMILES": "raw_key",
    "Ki (nM)": "ki",
    "Kd (nM)": "kd",
    "IC50 (nM)": "ic50",
}

SUMMARY_SCHEMA = (
    "target string, initialization_strategy string, strategy string, round int, "
    "roc_auc_mean double, roc_auc_std double, actives_mean double, actives_std double"
)

METADATA_SCHEMA = (
    "target string, query string, n_molecules_raw bigint, n_molecules_valid bigint, active_fraction double, "
    "fingerprint struct<type: string, radius: int, n_bits: int>, activity_threshold_nM double, match string, descriptor_set string, "
    "created_at string, files struct<prepared: string, descriptors: string>"
)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores when the scan has fewer splits than that (few, unsplittable files).

    Ahead of costly per-row work only; a scan that fills the cluster is left alone. Select the
    needed columns first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def source_columns(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Ordinal and name of every column of a delimited file; only its first line is read."""
    header = spark.read.text(path).limit(1)
    names = header.select(F.posexplode(F.split("value", sep)).alias("ordinal", "name"))
    return names.withColumn("name", F.regexp_replace("name", r"\r$", ""))


def read_measurements(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str] = MEASUREMENT_COLUMNS,
    sep: str = "\t",
) -> DataFrame:
    """Wide delimited dump -> the mapped columns as strings, missing tokens as NULL.

    All columns are declared as strings from the header line, so nothing is inferred from the
    data, and the parser only materialises the selected ones. ``path`` names files that share
    one header; a file with another one is an error.
    """
    first = spark.read.text(path).head()
    if first is None:
        raise ValueError(f"Empty source: {path}")
    header = first[0].rstrip("\r").split(sep)
    absent = [c for c in columns if c not in header]
    if absent:
        raise ValueError(f"the table has no columns {absent}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(schema).csv(path, sep=sep, header=True, quote='"', escape='"', enforceSchema=False)
    return raw.select(*[missing_to_null_text(F.col(f"`{c}`")).alias(name) for c, name in columns.items()])


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fails on absent columns, then drops rows that miss one of them."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"the table has no columns {absent}")
    return df.na.drop(subset=list(required))


def read_master(spark: SparkSession, path: str, required: Sequence[str] = ("entity_key", "label")) -> DataFrame:
    return require_columns(spark.read.parquet(path), required)


def read_target(spark: SparkSession, path: str, target: str) -> DataFrame:
    """One target of a table partitioned by ``target``; only its directory is listed for reading."""
    part = spark.read.parquet(path).where(F.col("target") == target)
    if part.isEmpty():
        raise FileNotFoundError(f"target {target!r} has no rows below {path}")
    return part


def target_dir(base: str, target: str) -> str:
    """Directory of one target below a partitioned table."""
    return f"{base.rstrip('/')}/target={target}"


def read_summary(spark: SparkSession, path: str, round_id: int = 10) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).csv(path, header=True).where(F.col("round") == round_id)


def read_metadata(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Metadata documents of any number of targets, one per line as ``write_metadata`` leaves them; ``path`` may be a glob.

    ``one_per_file`` reads files that hold a single document over several lines; of further documents nothing would be seen.
    The schema is declared, since a field that is NULL in all documents is not written.
    """
    return spark.read.schema(METADATA_SCHEMA).json(path, multiLine=one_per_file)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("target",)) -> None:
    """Parquet, zstd. A partitioned table is rebalanced by its keys first: small targets give one file, a hot one
    is split into files of the advisory size, however many tasks held its rows."""
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_metadata(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
