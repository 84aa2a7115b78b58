"""Registered queries: cleaning, target slices and affinity reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolspark.catalog import standins as st
from poolspark.functions.measures import parse_measure
from poolspark.operators import clean, targets
from poolspark.session import shared_table

QUERIES = {}
SQL = {}


def parse_measures(spark, sf_dir):
    raw = st.raw_measurements(spark, sf_dir)
    return raw.select(*st.ORDER, "raw_key", *[parse_measure(F.col(c)).alias(f"v_{c}") for c in ("ki", "kd", "ic50")])


QUERIES["parse_measure"] = parse_measures
SQL["parse_measure"] = f"""WITH {st.CLEAN_SQL}
SELECT l_orderkey, l_linenumber, raw_key, vki AS v_ki, vkd AS v_kd, vic AS v_ic50 FROM parsed"""


def best_measures(spark, sf_dir):
    raw = clean.add_best_measure(st.raw_measurements(spark, sf_dir))
    return raw.select(*st.ORDER, "raw_key", "measure_type", "value")


QUERIES["best_measure"] = best_measures
SQL["best_measure"] = f"""WITH {st.CLEAN_SQL}
SELECT l_orderkey, l_linenumber, raw_key, measure_type, value FROM picked"""

QUERIES["clean_rows"] = st.cleaned
SQL["clean_rows"] = f"WITH {st.CLEAN_SQL} SELECT * FROM clean"


def clean_master(spark, sf_dir):
    return st.master(spark, sf_dir).withColumn("dg", F.round("dg", 6))


QUERIES["clean_master"] = clean_master
SQL["clean_master"] = f"WITH {st.MASTER_SQL} SELECT * REPLACE (round(dg, 6) AS dg) FROM master"

QUERIES["master_totals"] = lambda spark, sf_dir: clean.master_totals(st.master(spark, sf_dir)).withColumn(
    "active_fraction", F.round("active_fraction", 6)
)
SQL["master_totals"] = f"""WITH {st.MASTER_SQL}
SELECT count(*) AS n_rows, count(DISTINCT target_name) AS n_targets, round(avg(label), 6) AS active_fraction FROM master"""


def chunk_counts(spark, sf_dir):
    raw = st.raw_measurements(spark, sf_dir).withColumn("chunk", F.floor(F.col("l_orderkey") / 100).cast("bigint"))
    return clean.chunk_counts(raw, "chunk")


QUERIES["chunk_counts"] = chunk_counts
SQL["chunk_counts"] = f"""WITH {st.CLEAN_SQL}
SELECT l_orderkey // 100 AS chunk, count(*) AS n_raw, count(measure_type) AS n_cleaned FROM picked GROUP BY 1"""

QUERIES["target_exact"] = lambda spark, sf_dir: targets.filter_target(
    st.master(spark, sf_dir), "economy", "exact"
).select("target_name", "entity_key", "measure_type", "value_median")
SQL["target_exact"] = f"""WITH {st.MASTER_SQL}
SELECT target_name, entity_key, measure_type, value_median FROM master WHERE lower(target_name) = 'economy'"""

QUERIES["target_contains"] = lambda spark, sf_dir: targets.filter_target(
    st.master(spark, sf_dir), "aR", "contains"
).select("target_name", "entity_key", "measure_type", "value_median")
SQL["target_contains"] = f"""WITH {st.MASTER_SQL}
SELECT target_name, entity_key, measure_type, value_median FROM master WHERE contains(lower(target_name), 'ar')"""


def target_labels(spark, sf_dir):
    return st.labelled(spark, sf_dir).withColumn("dg", F.round("dg", 6))


QUERIES["target_labels"] = target_labels
SQL["target_labels"] = f"WITH {st.LABELLED_SQL} SELECT * REPLACE (round(dg, 6) AS dg) FROM labelled"

QUERIES["missing_targets"] = lambda spark, sf_dir: targets.missing_targets(
    st.labelled(spark, sf_dir), st.registry(spark)
)
SQL["missing_targets"] = f"""WITH {st.LABELLED_SQL}
SELECT target, query, "match", CAST(threshold AS DOUBLE) AS threshold FROM registry
WHERE target NOT IN (SELECT target FROM labelled)"""

QUERIES["target_metadata"] = lambda spark, sf_dir: targets.target_metadata(st.labelled(spark, sf_dir)).withColumn(
    "active_fraction", F.round("active_fraction", 6)
)
SQL["target_metadata"] = f"""WITH {st.LABELLED_SQL},
per_entity AS (SELECT target, query, "match", threshold, entity_key, count(*) AS n, sum(label) AS a
  FROM labelled GROUP BY ALL)
SELECT target, query, "match", threshold, CAST(sum(n) AS BIGINT) AS n_raw, CAST(sum(n) AS BIGINT) AS n_valid,
  round(sum(a) / sum(n), 6) AS active_fraction, count(*) FILTER (WHERE n > 1) AS n_repeated
FROM per_entity GROUP BY target, query, "match", threshold"""

QUERIES["measure_percentiles"] = lambda spark, sf_dir: targets.affinity_percentiles(
    shared_table(st.labelled(spark, sf_dir).select("target", "value_median"), "slices"), ["target"], "value_median"
).withColumn("value", F.round("value", 6))
SQL["measure_percentiles"] = f"""WITH {st.LABELLED_SQL},
ps AS (SELECT unnest([0, 10, 25, 50, 75, 90, 95, 99, 100]) AS percent),
q AS (SELECT target, quantile_cont(value_median, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS v
  FROM labelled GROUP BY target)
SELECT target, unnest([0, 10, 25, 50, 75, 90, 95, 99, 100]) AS percent, round(unnest(v), 6) AS value FROM q"""

QUERIES["threshold_sweep"] = lambda spark, sf_dir: targets.threshold_sweep(
    st.labelled(spark, sf_dir), ["target"], "value_median"
).withColumn("active_fraction", F.round("active_fraction", 6))
SQL["threshold_sweep"] = f"""WITH {st.LABELLED_SQL},
ts AS (SELECT unnest([10, 50, 100, 500, 1000, 5000, 10000]) AS threshold)
SELECT target, ts.threshold, round(avg(CAST(value_median <= ts.threshold AS INTEGER)), 6) AS active_fraction
FROM labelled CROSS JOIN ts GROUP BY target, ts.threshold"""

QUERIES["type_share"] = lambda spark, sf_dir: targets.type_share(st.labelled(spark, sf_dir), ["target"])
SQL["type_share"] = f"""WITH {st.LABELLED_SQL}
SELECT target, measure_type, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY target), 2) AS share
FROM labelled GROUP BY target, measure_type"""


def log_histogram(spark, sf_dir):
    rows = targets.log_histogram(st.labelled(spark, sf_dir), ["target"], "value_median")
    return rows.withColumn("left_edge", F.round("left_edge", 6)).withColumn("right_edge", F.round("right_edge", 6))


QUERIES["log_histogram"] = log_histogram
SQL["log_histogram"] = f"""WITH {st.LABELLED_SQL},
x AS (SELECT target, log10(value_median) AS v FROM labelled),
b AS (SELECT target, min(v) AS lo, max(v) AS hi FROM x GROUP BY target)
SELECT target, bin, round(lo + (hi - lo) / 60 * (bin - 1), 6) AS left_edge,
  round(lo + (hi - lo) / 60 * bin, 6) AS right_edge, count(*) AS n
FROM (SELECT target, lo, hi, CAST(least(floor((v - lo) / (hi - lo) * 60) + 1, 60) AS INTEGER) AS bin FROM x JOIN b USING (target))
GROUP BY target, bin, lo, hi"""

QUERIES["label_counts"] = lambda spark, sf_dir: clean.label_counts(st.labelled(spark, sf_dir))
SQL["label_counts"] = f"WITH {st.LABELLED_SQL} SELECT label, count(*) AS n FROM labelled GROUP BY label"

QUERIES["preview"] = lambda spark, sf_dir: clean.preview(
    st.master(spark, sf_dir).select("target_name", "entity_key", "measure_type", "value_median", "label"),
    ["target_name", "entity_key", "measure_type"],
)
SQL["preview"] = f"""WITH {st.MASTER_SQL}
SELECT target_name, entity_key, measure_type, value_median, label FROM master
ORDER BY target_name, entity_key, measure_type LIMIT 5"""
