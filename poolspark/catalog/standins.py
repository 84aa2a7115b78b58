"""The driver tables seen as the tables this library works on, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolspark.functions.measures import missing_to_null_text
from poolspark.functions.ordering import order_key
from poolspark.functions.scoring import logistic_score
from poolspark.operators.clean import build_master, clean
from poolspark.operators.targets import label_targets
from poolspark.sources.registry import registry_from_rows
from poolspark.sources.tables import spread

ORDER = ("l_orderkey", "l_linenumber")

# A registry with both modes, a missing mode, a missing threshold and no match.
REGISTRY = (
    ("ECO", "economy", "exact", 500.0),
    ("SMALL", "Small", "exact", None),
    ("AN", "an", "contains", 1000.0),
    ("ARD", "ARD", None, 100.0),
    ("MED", "medium", None, None),
    ("NONE", "x[1]", "contains", 50.0),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to part, its numbers dressed up as messy measurement strings."""
    lines = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
    ))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    quantity = F.col("l_quantity").cast("bigint")
    price = F.col("l_extendedprice").cast("bigint")
    flag = F.col("l_returnflag")
    ki = F.when(flag == "A", F.concat(F.lit("<"), (quantity * 37).cast("string"))).when(flag == "R", "NA")
    kd = F.when(
        (F.col("l_linestatus") == "F") & (flag == "N"),
        F.concat(
            F.floor(price / 1000).cast("bigint").cast("string"), F.lit(","), F.lpad((price % 1000).cast("string"), 3, "0")
        ),
    ).otherwise("0")
    ic50 = F.when(
        F.col("l_linenumber") < 7, F.concat(F.lit(" >"), (quantity % 10).cast("string"), F.lit("."), quantity.cast("string"), F.lit("e2 "))
    )
    return lines.join(parts, "l_partkey").select(
        "l_orderkey",
        "l_linenumber",
        F.col("p_type").alias("target_name"),
        F.concat(F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(""), F.col("l_partkey").cast("string")).alias("raw_key"),
        missing_to_null_text(F.coalesce(ki, F.lit("n.d."))).alias("ki"),
        kd.alias("kd"),
        ic50.alias("ic50"),
    )


RAW_SQL = r"""
raw AS (
  SELECT l_orderkey, l_linenumber, p_type AS target_name,
    (CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END) || CAST(l_partkey AS VARCHAR) AS raw_key,
    CASE WHEN l_returnflag = 'A' THEN '<' || CAST(q * 37 AS VARCHAR)
         WHEN l_returnflag = 'R' THEN NULL ELSE 'n.d.' END AS ki,
    CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N'
         THEN CAST(p // 1000 AS VARCHAR) || ',' || lpad(CAST(p % 1000 AS VARCHAR), 3, '0') ELSE '0' END AS kd,
    CASE WHEN l_linenumber < 7
         THEN ' >' || CAST(q % 10 AS VARCHAR) || '.' || CAST(q AS VARCHAR) || 'e2 ' END AS ic50
  FROM (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS q, CAST(trunc(l_extendedprice) AS BIGINT) AS p FROM lineitem) l
  JOIN part ON l_partkey = p_partkey
)"""

NUMBER_SQL = (
    "TRY_CAST(NULLIF(regexp_extract(replace(trim({c}), ',', ''), "
    r"'[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?', 0), '') AS DOUBLE)"
)

CLEAN_SQL = RAW_SQL + f""",
parsed AS (
  SELECT *, {NUMBER_SQL.format(c='ki')} AS vki, {NUMBER_SQL.format(c='kd')} AS vkd,
    {NUMBER_SQL.format(c='ic50')} AS vic FROM raw
),
picked AS (
  SELECT *, CASE WHEN vki > 0 THEN 'Ki' WHEN vkd > 0 THEN 'Kd' WHEN vic > 0 THEN 'IC50' END AS measure_type,
    CASE WHEN vki > 0 THEN vki WHEN vkd > 0 THEN vkd WHEN vic > 0 THEN vic END AS value,
    CASE WHEN vki > 0 THEN ki WHEN vkd > 0 THEN kd WHEN vic > 0 THEN ic50 END AS chosen
  FROM parsed
),
clean AS (
  SELECT target_name, raw_key, NULLIF(trim(raw_key), '') AS entity_key, measure_type, value,
    CASE WHEN trim(chosen) LIKE '<%' THEN '<' WHEN trim(chosen) LIKE '>%' THEN '>' ELSE '=' END AS relation,
    l_orderkey, l_linenumber
  FROM picked WHERE target_name IS NOT NULL AND raw_key IS NOT NULL AND measure_type IS NOT NULL
    AND NULLIF(trim(raw_key), '') IS NOT NULL
)"""

MASTER_SQL = CLEAN_SQL + """,
master AS (
  SELECT target_name, entity_key, measure_type, median(value) AS value_median, count(*) AS n_meas,
    first(raw_key ORDER BY l_orderkey, l_linenumber, raw_key) AS raw_key,
    0.0019872041 * 298.15 * ln(median(value) * 1e-9) AS dg,
    CAST(median(value) <= 1000 AS INTEGER) AS label, lower(target_name) AS target_lc
  FROM clean GROUP BY target_name, entity_key, measure_type
)"""

REGISTRY_SQL = """
registry AS (
  SELECT target, query, coalesce(mode, 'contains') AS "match", coalesce(threshold, 1000.0) AS threshold
  FROM (VALUES ('ECO', 'economy', 'exact', 500.0), ('SMALL', 'Small', 'exact', NULL),
    ('AN', 'an', 'contains', 1000.0), ('ARD', 'ARD', NULL, 100.0), ('MED', 'medium', NULL, NULL),
    ('NONE', 'x[1]', 'contains', 50.0)) t(target, query, mode, threshold)
)"""

LABELLED_SQL = MASTER_SQL + "," + REGISTRY_SQL + """,
labelled AS (
  SELECT m.* EXCLUDE (label, target_lc), m.label AS label_default, r.target, r.query, r."match",
    CAST(r.threshold AS DOUBLE) AS threshold, CAST(m.value_median <= r.threshold AS INTEGER) AS label
  FROM master m JOIN registry r
    ON CASE WHEN r."match" = 'exact' THEN m.target_lc = lower(r.query)
            ELSE contains(m.target_lc, lower(r.query)) END
)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw_measurements(spark, sf_dir), ORDER)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_master(raw_measurements(spark, sf_dir), ORDER)


def registry(spark: SparkSession) -> DataFrame:
    return registry_from_rows(spark, REGISTRY)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_targets(master(spark, sf_dir), registry(spark))


# Pools ---------------------------------------------------------------------------------------

POOL_TARGETS = 2
SEEDS = (0, 1, 2, 3, 4)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense feature pool: embeddings dealt to two targets, label = upper half of the classes."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("T"), (F.col("vec_id") % POOL_TARGETS).cast("string")).alias("target"),
        F.col("vec_id").alias("mol_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") >= 5).cast("int").alias("label"),
    )


POOL_SQL = """
pool AS (
  SELECT 'T' || CAST(vec_id % 2 AS VARCHAR) AS target, vec_id AS mol_id,
    CAST(embedding AS DOUBLE[]) AS features, CAST(label >= 5 AS INTEGER) AS label
  FROM embeddings
)"""

SEEDS_SQL = "seeds AS (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS seed)"


def with_seeds(df: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool scored by a fixed formula, a different pair of features for each seed."""
    at = lambda shift: F.element_at("features", F.col("seed") + 1 + shift)
    return with_seeds(pool(spark, sf_dir)).select("seed", "target", "mol_id", "label", logistic_score(at(0), at(1)).alias("p"))


SCORED_SQL = POOL_SQL + ",\n" + SEEDS_SQL + """,
scored AS (
  SELECT seed, target, mol_id, label,
    1.0 / (1.0 + exp(-(1.5 * features[seed + 1] - features[seed + 2]
      + 0.8 * features[seed + 1] * features[seed + 2]))) AS p
  FROM pool CROSS JOIN seeds
)"""


def draw_key(seed: Column, row_id: Column) -> Column:
    return order_key(seed, row_id, "md5")


def draw_sql(seed: str, row_id: str = "mol_id") -> str:
    return f"md5(CAST({seed} AS VARCHAR) || ':' || CAST({row_id} AS VARCHAR))"


# Campaign history ----------------------------------------------------------------------------

# Event type -> strategy.
EVENT_STRATEGIES = {
    "view": "greedy",
    "click": "random",
    "purchase": "uncertainty_topk",
    "signup": "uncertainty_diverse",
    "error": "query_by_committee",
}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as campaign rounds: one row per (target, init, strategy, seed, round)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    names = F.create_map(*[F.lit(x) for pair in EVENT_STRATEGIES.items() for x in pair])
    return events.select(
        F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("target"),
        F.when(F.col("event_id") % 2 == 0, "random").otherwise("diverse").alias("initialization_strategy"),
        names[F.col("event_type")].alias("strategy"),
        F.col("event_id").alias("seed"),
        (F.col("event_id") % 11).cast("int").alias("round"),
        (F.col("value") / 500.0).alias("roc_auc"),
        F.floor("value").cast("bigint").alias("n_actives_found"),
    )


HISTORY_SQL = """
history AS (
  SELECT 'T' || CAST(user_id % 10 AS VARCHAR) AS target,
    CASE WHEN event_id % 2 = 0 THEN 'random' ELSE 'diverse' END AS initialization_strategy,
    CASE event_type WHEN 'view' THEN 'greedy' WHEN 'click' THEN 'random' WHEN 'purchase' THEN 'uncertainty_topk'
      WHEN 'signup' THEN 'uncertainty_diverse' WHEN 'error' THEN 'query_by_committee' END AS strategy,
    event_id AS seed, CAST(event_id % 11 AS INTEGER) AS round, value / 500.0 AS roc_auc,
    CAST(floor(value) AS BIGINT) AS n_actives_found
  FROM events
)"""
