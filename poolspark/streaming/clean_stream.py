"""Incremental cleaning: the same stateless clean as in batch, applied to files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from poolspark.operators.clean import clean


def clean_stream(
    spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, order: Sequence[str] = (),
    file_format: str = "parquet", max_files: int = 1000, **options: str,
) -> None:
    """Clean all files not seen yet and append them to ``sink``, then stop.

    The checkpoint remembers what was read and the file sink commits each batch once, so running
    again after a failure neither loses nor repeats rows. The aggregation to one row per entity
    needs all rows of a group and stays a batch job over the sink (aggregate_clean).
    """
    arriving = (
        spark.readStream.format(file_format).schema(schema).options(**options).option("maxFilesPerTrigger", max_files).load(source)
    )
    query = (
        clean(arriving, order)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination()


def read_cleaned(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink)
