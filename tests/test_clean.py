import pytest
from pyspark.sql import functions as F

from poolspark.operators.clean import (
    build_master, chunk_counts, clean, label_counts, master_totals, preview,
)

RAW = [
    # order, target, raw key, ki, kd, ic50
    (1, "EGFR", "m1", "10", None, None),
    (2, "EGFR", " m1", "<30", None, None),
    (3, "EGFR", "m1", "1,000", None, None),
    (4, "EGFR", "m1", None, None, "5"),
    (5, "EGFR", "m2", "0", "2000", "7"),
    (6, "egfr", "m2", "abc", "-1", " >1e3 "),
    (7, None, "m3", "5", None, None),
    (8, "JAK2", None, "5", None, None),
    (9, "JAK2", "  ", "5", None, None),
    (10, "JAK2", "m4", "x", "y", "z"),
    (11, "JAK2", "m5", "900", None, None),
    (12, "JAK2", "m5", "1100", None, None),
]
SCHEMA = "pos int, target_name string, raw_key string, ki string, kd string, ic50 string"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, SCHEMA)


def rows_of(df):
    return {(r.target_name, r.entity_key, r.measure_type): (r.value_median, r.n_meas, r.raw_key, r.label) for r in df.collect()}


WANT = {
    ("EGFR", "m1", "Ki"): (30.0, 3, "m1", 1),
    ("EGFR", "m1", "IC50"): (5.0, 1, "m1", 1),
    ("EGFR", "m2", "Kd"): (2000.0, 1, "m2", 0),
    ("egfr", "m2", "IC50"): (1000.0, 1, "m2", 1),
    ("JAK2", "m5", "Ki"): (1000.0, 2, "m5", 1),
}


@pytest.mark.parametrize("hot_rows", [1_000_000, 1, 0])
@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_master(raw, hot_rows, partitions):
    assert rows_of(build_master(raw.repartition(partitions), ["pos"], hot_rows)) == WANT


def test_master_is_one_shuffle(raw):
    plan = build_master(raw, ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_supplied_entity_key_is_kept(spark):
    df = spark.createDataFrame([("T", "k", "E", "1", None, None)], "target_name string, raw_key string, entity_key string, ki string, kd string, ic50 string")
    assert clean(df).head().entity_key == "E"


def test_reports(raw):
    master = build_master(raw, ["pos"])
    totals = master_totals(master).head()
    assert (totals.n_rows, totals.n_targets, totals.active_fraction) == (5, 3, pytest.approx(0.8))
    counts = {r.chunk: (r.n_raw, r.n_cleaned) for r in chunk_counts(raw.withColumn("chunk", F.col("pos") > 6), "chunk").collect()}
    assert counts == {False: (6, 6), True: (6, 2)}
    assert {r.label: r.n for r in label_counts(master).collect()} == {0: 1, 1: 4}
    assert [r.entity_key for r in preview(master, ["target_name", "entity_key", "measure_type"], 2).collect()] == ["m1", "m1"]
