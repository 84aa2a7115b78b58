"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, GroupedData, SparkSession

# A driver-side block (models, centres) is shipped to every executor. Anything that grows with
# the number of campaigns is split into blocks of at most this many bytes first.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "poolspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; keyword arguments override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Percentiles keep one small map per group; the default of 128 groups falls back to sorting.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local path
    is lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="poolspark-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan stops growing and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder as parquet and read it back.

    Used for wide tables that several later jobs scan with different columns: unlike a
    checkpoint, parquet keeps column pruning and compression.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Written tables of a job, in a folder of its own below the shared one, that can be dropped before the job ends.

    A table may be dropped once all that is derived from it has been written: then no task, retried or not, reads it again.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.written = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        path = f"{self.base}/{name}-{self.written}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(conf).delete(path, True)

    def collect(self) -> None:
        """Lets Spark drop the shuffle files and checkpoints of plans that nothing refers to any more, which waits for the driver's garbage collector."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def dealt_by(rows: DataFrame, *keys: str) -> GroupedData:
    """``rows`` grouped by ``keys`` for grouped work that is long however few the rows are.

    Left to itself, adaptive execution puts groups of few bytes together in one task.
    """
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys).groupBy(*keys)
