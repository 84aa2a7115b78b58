import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from poolspark.operators import ranking
from poolspark.operators.ranking import auc_by_group, exact_percentiles, key_cutoffs, running_sums, top_k, within_cutoff


@pytest.fixture(scope="module")
def skewed(spark):
    """One group owns most rows; values tie often."""
    rng = np.random.default_rng(1)
    rows = [("big", float(v), int(l)) for v, l in zip(rng.integers(0, 3000, 4000) / 7, rng.integers(0, 2, 4000))]
    rows += [("small", float(v), int(l)) for v, l in zip(rng.integers(0, 5, 40), rng.integers(0, 2, 40))]
    rows += [("one", 1.0, 1)]
    return spark.createDataFrame(rows, "g string, v double, label int").cache()


@pytest.mark.parametrize("hot_rows", [1_000_000, 30, 0])
def test_percentiles_match_numpy_on_both_ways(skewed, hot_rows):
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    found = exact_percentiles(skewed, ["g"], "v", probs, hot_rows, size=(F.count(F.lit(1)), F.sum("size")))
    data = skewed.toPandas()
    rows = {r.g: r for r in found.collect()}
    assert set(rows) == {"big", "small", "one"}
    for g, part in data.groupby("g"):
        np.testing.assert_allclose(rows[g].percentiles, np.quantile(part["v"], probs), rtol=1e-12)
        assert rows[g].size == len(part)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1, 0])
def test_percentiles_keep_infinities(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_HOT", 1 if hot_rows == 1 else 100)  # the salted way as well
    inf = float("inf")
    rows = [(g, v) for g in ("a", "b") for v in (1.0, 2.0, inf, inf, inf)] + [("c", v) for v in (-inf, -0.0, 0.0, 5.0)] + [("d", float("nan")), ("d", None)]
    found = exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.1, 0.5, 1.0], hot_rows)
    got = {r.g: r.percentiles for r in found.collect()}
    assert got == {"a": [1.0, 1.4, inf, inf], "b": [1.0, 1.4, inf, inf], "c": [-inf, -inf, 0.0, 5.0]}


@pytest.mark.parametrize("hot_rows", [1_000_000, 30])
def test_running_sums(skewed, hot_rows):
    found = running_sums(skewed, ["g"], "v", {"pos": F.sum("label")}, hot_rows).toPandas().sort_values(["g", "v"])
    for _, part in found.groupby("g"):
        np.testing.assert_array_equal(part["before_pos"], part["pos"].cumsum() - part["pos"])
        np.testing.assert_array_equal(part["before_n"], part["n"].cumsum() - part["n"])
    assert found["n"].sum() == skewed.count()


def test_auc_hand_case_and_single_class(spark):
    rows = [("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.4, 1), ("a", 0.8, 1), ("b", 0.5, 1)]
    got = {r.g: r.roc_auc for r in auc_by_group(spark.createDataFrame(rows, "g string, p double, label int"), ["g"]).collect()}
    assert got == {"a": 0.875, "b": None}


@pytest.mark.parametrize("hot_rows", [1_000_000, 30])
def test_auc_equals_evaluator(spark, skewed, hot_rows):
    got = {r.g: r.roc_auc for r in auc_by_group(skewed, ["g"], "v", "label", hot_rows).collect()}
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0)
    for g in ("big", "small"):
        part = skewed.where(F.col("g") == g).select(array_to_vector(F.array(-F.col("v"), "v")).alias("raw"), F.col("label").cast("double"))
        assert got[g] == pytest.approx(ev.evaluate(part), abs=1e-12)


def test_key_cutoffs_take_exactly_the_quota(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("row"), F.xxhash64("id").alias("k"))
    quota = spark.createDataFrame([(0, 17), (1, 1667), (2, 0)], "g bigint, take bigint")
    cuts = key_cutoffs(rows, ["g"], "k", "row", quota)
    taken = rows.join(cuts, "g", "left").where(within_cutoff(F.col("k"), F.col("row")))
    best = rows.toPandas().sort_values(["k", "row"])
    for g, n in ((0, 17), (1, 1667), (2, 0)):
        want = set(best[best["g"] == g]["row"].head(n))
        assert {r.row for r in taken.where(F.col("g") == g).collect()} == want


def test_top_k_is_pruned_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    plan = top_k(df, ["g"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
