"""Registered queries: tables written by the sinks and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from poolspark.catalog import standins as st
from poolspark.catalog.reports import SUMMARY_SQL, count_sql
from poolspark.functions.features import DESCRIPTORS
from poolspark.operators import report
from poolspark.plans.prepare import prepare_targets, write_master
from poolspark.session import shared_dir
from poolspark.sources import tables

QUERIES = {}
SQL = {}

TARGETS = ("ECO", "SMALL", "AN", "ARD", "MED")
# The widest slice: a "contains" target.
TARGET = "AN"


def fresh_path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_dump(spark, df, name):
    """``df`` as a tab-separated dump with header lines, blanks at both ends of a field kept."""
    path = fresh_path(spark, name)
    df.write.csv(path, sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def measurement_dump(spark, sf_dir):
    """The raw measurements under the names of the source, between columns nobody asks for."""
    raw = st.raw_measurements(spark, sf_dir)
    named = [F.col(ours).alias(theirs) for theirs, ours in tables.MEASUREMENT_COLUMNS.items()]
    return written_dump(spark, raw.select("l_orderkey", *named, "l_linenumber"), "dump")


def schema_list(spark, sf_dir):
    return tables.source_columns(spark, written_dump(spark, st.table(spark, sf_dir, "lineitem"), "lines"))


QUERIES["schema_list"] = schema_list
SQL["schema_list"] = """SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS ordinal, name
FROM (SELECT unnest(json_keys(to_json(l))) AS name FROM (SELECT l FROM lineitem l LIMIT 1))"""


QUERIES["dump_scan"] = lambda spark, sf_dir: tables.read_measurements(spark, measurement_dump(spark, sf_dir))
SQL["dump_scan"] = f"WITH {st.RAW_SQL} SELECT target_name, raw_key, ki, kd, ic50 FROM raw"


def dump_master(spark, sf_dir):
    """Dump -> master table -> the rows that have a key and a label. Copies of a key keep any raw text, so that is left out."""
    path = fresh_path(spark, "master")
    write_master(spark, measurement_dump(spark, sf_dir), path)
    return path


def master_round_trip(spark, sf_dir):
    rows = tables.read_master(spark, dump_master(spark, sf_dir))
    return rows.drop("raw_key").withColumn("dg", F.round("dg", 6))


QUERIES["master_round_trip"] = master_round_trip
SQL["master_round_trip"] = f"""WITH {st.MASTER_SQL}
SELECT * EXCLUDE (raw_key) REPLACE (round(dg, 6) AS dg) FROM master WHERE entity_key IS NOT NULL AND label IS NOT NULL"""


def prepared(spark, sf_dir):
    base = fresh_path(spark, "targets")
    prepare_targets(spark, dump_master(spark, sf_dir), st.registry(spark), base, TARGETS, radius=RADIUS)
    return base


# Keys are short numbers: n-grams of two characters. Those of one digit have no features.
RADIUS = 1
VALID_SQL = f"length(entity_key) >= {2 * RADIUS}"


def target_slice(spark, sf_dir):
    """All rows of one target, from its directory of the partitioned table."""
    rows = tables.read_target(spark, f"{prepared(spark, sf_dir)}/clean", TARGET)
    return rows.select("target", "query", "match", "threshold", "target_name", "entity_key", "measure_type", "value_median", "n_meas", "label")


QUERIES["target_slice"] = target_slice
SQL["target_slice"] = f"""WITH {st.LABELLED_SQL}
SELECT target, query, "match", threshold, target_name, entity_key, measure_type, value_median, n_meas, label
FROM labelled WHERE target = '{TARGET}'"""


def target_features(spark, sf_dir):
    """Rows of one target that have features. The bits are hashed, so their form is checked: ascending, within the width."""
    rows = tables.read_target(spark, f"{prepared(spark, sf_dir)}/prepared", TARGET)
    bits = F.col("fp")
    sound = (F.size(bits) > 0) & (bits == F.array_sort(F.array_distinct(bits))) & (bits[0] >= 0) & (F.element_at(bits, -1) < 2048)
    return rows.select("target", "entity_key", "label", sound.alias("sound"))


QUERIES["target_features"] = target_features
SQL["target_features"] = f"""WITH {st.LABELLED_SQL}
SELECT target, entity_key, label, true AS sound FROM labelled WHERE target = '{TARGET}' AND {VALID_SQL}"""


def target_descriptors(spark, sf_dir):
    rows = tables.read_target(spark, f"{prepared(spark, sf_dir)}/descriptors", TARGET)
    return rows.select("target", "label", *DESCRIPTORS)


QUERIES["target_descriptors"] = target_descriptors
SQL["target_descriptors"] = f"""WITH {st.LABELLED_SQL},
texts AS (SELECT target, label, entity_key AS text FROM labelled WHERE target = '{TARGET}' AND {VALID_SQL}),
counted AS (SELECT target, label, length(text) AS length,
  length(regexp_replace(regexp_replace(text, '[^ \\t\\r\\n]+', 'w', 'g'), '[ \\t\\r\\n]+', '', 'g')) AS n_words,
  {count_sql('0123456789')} AS n_digits, {count_sql('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS n_upper, {count_sql('.,;:!?()')} AS n_punct,
  {count_sql('aeiouAEIOU')} AS n_vowel, {count_sql(' ')} AS n_space FROM texts)
SELECT target, label, CAST(length AS INTEGER) AS length, CAST(n_words AS INTEGER) AS n_words, CAST(n_digits AS INTEGER) AS n_digits,
  CAST(n_upper AS INTEGER) AS n_upper, CAST(n_punct AS INTEGER) AS n_punct, n_vowel / CAST(length AS DOUBLE) AS vowel_ratio,
  (length - n_space) / CAST(n_words AS DOUBLE) AS mean_word, n_space / CAST(length AS DOUBLE) AS space_ratio FROM counted"""


def metadata_round_trip(spark, sf_dir):
    docs = tables.read_metadata(spark, f"{prepared(spark, sf_dir)}/metadata/*.json")
    return docs.select(
        "target", "query", "match", "n_molecules_raw", "n_molecules_valid", F.round("active_fraction", 6).alias("active_fraction"),
        "activity_threshold_nM", F.col("fingerprint.radius").cast("int").alias("radius"), F.col("fingerprint.n_bits").cast("int").alias("n_bits"),
        F.regexp_extract("files.prepared", "[^/]+$", 0).alias("directory"),
    )


QUERIES["metadata_round_trip"] = metadata_round_trip
SQL["metadata_round_trip"] = f"""WITH {st.LABELLED_SQL}
SELECT target, query, "match", count(*) AS n_molecules_raw, count(*) FILTER (WHERE {VALID_SQL}) AS n_molecules_valid,
  round(avg(label) FILTER (WHERE {VALID_SQL}), 6) AS active_fraction, threshold AS "activity_threshold_nM",
  CAST({RADIUS} AS INTEGER) AS radius, CAST(2048 AS INTEGER) AS n_bits, 'target=' || target AS directory
FROM labelled GROUP BY target, query, "match", threshold"""


def history_round_trip(spark, sf_dir):
    """Histories keep arrays: the rows of a campaign are numbered in the order of their rounds."""
    path = fresh_path(spark, "history")
    rows = st.history(spark, sf_dir).withColumn("selected", F.when(F.col("round") < 10, F.array("seed", "n_actives_found")))
    tables.write_table(rows, path, partition_by=())
    back = spark.read.parquet(path)
    return back.withColumns({"roc_auc": F.round("roc_auc", 6), "selected": F.array_join(F.col("selected").cast("array<string>"), ",")})


QUERIES["history_round_trip"] = history_round_trip
SQL["history_round_trip"] = f"""WITH {st.HISTORY_SQL}
SELECT * REPLACE (round(roc_auc, 6) AS roc_auc),
  CASE WHEN round < 10 THEN CAST(seed AS VARCHAR) || ',' || CAST(n_actives_found AS VARCHAR) END AS selected FROM history"""


def summary_round_trip(spark, sf_dir):
    path = fresh_path(spark, "summary")
    tables.write_summary(report.summarize(st.history(spark, sf_dir)), path)
    measures = ("roc_auc_mean", "roc_auc_std", "actives_mean", "actives_std")
    return tables.read_summary(spark, path).withColumns({c: F.round(c, 6) for c in measures})


QUERIES["summary_round_trip"] = summary_round_trip
SQL["summary_round_trip"] = f"""WITH {SUMMARY_SQL}
SELECT target, initialization_strategy, strategy, round, round(roc_auc_mean, 6) AS roc_auc_mean, round(roc_auc_std, 6) AS roc_auc_std,
  round(actives_mean, 6) AS actives_mean, round(actives_std, 6) AS actives_std FROM summary WHERE round = 10"""
