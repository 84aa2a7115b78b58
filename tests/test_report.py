import numpy as np
import pytest
from pyspark.sql import functions as F

from poolspark.operators import report

SUMMARY = [
    ("A", "random", "greedy", 10, 0.9, 50.0), ("A", "diverse", "greedy", 10, 0.8, 60.0), ("A", "random", "random", 10, 0.9, 40.0),
    ("A", "random", "greedy", 9, 0.99, 1.0), ("B", "random", "random", 10, 0.7, 30.0), ("B", "diverse", "random", 10, 0.7, 35.0),
    ("B", "random", "query_by_committee", 10, 0.6, 20.0),
]


@pytest.fixture(scope="module")
def summary(spark):
    df = spark.createDataFrame(SUMMARY, "target string, initialization_strategy string, strategy string, round int, roc_auc_mean double, actives_mean double")
    return df.withColumn("roc_auc_std", F.lit(0.1))


@pytest.fixture(scope="module")
def best(summary):
    return report.best_initialization(summary)


def test_best_rows(summary, best):
    got = {(r.target, r.strategy): (r.initialization_strategy, r.actives_mean) for r in best.collect()}
    assert got == {
        ("A", "greedy"): ("random", 50.0), ("A", "random"): ("random", 40.0), ("B", "random"): ("diverse", 35.0),
        ("B", "query_by_committee"): ("random", 20.0),
    }
    assert {r.target: r.roc_auc_mean for r in report.best_campaign(summary).collect()}["A"] == 0.9


def test_matrix_ranks_wins_heatmap(best):
    matrix = {r.target: r for r in report.metric_matrix(best, "roc_auc_mean").collect()}
    assert matrix["A"].uncertainty_topk is None and matrix["B"].query_by_committee == 0.6
    ranks = {r.target: list(r)[1:] for r in report.rank_table(best).collect()}
    assert ranks["A"] == ["Greedy", "Random", "Top-K", "Diverse", "QBC"]
    assert ranks["B"] == ["Random", "QBC", "Greedy", "Top-K", "Diverse"]
    wins = {r.strategy: (r.label, r.wins) for r in report.win_counts(best).collect()}
    assert wins["greedy"] == ("Greedy", 1) and wins["random"] == ("Random", 1) and wins["uncertainty_topk"] == ("Top-K", 0)
    cells = {(r.target, r.strategy): r.scaled for r in report.heatmap_cells(best, "roc_auc_mean").collect()}
    assert len(cells) == 10 and cells["A", "uncertainty_topk"] is None
    assert cells["A", "greedy"] == pytest.approx(1.0) and cells["B", "query_by_committee"] == pytest.approx(0.0)


def test_summary_of_one_seed_has_no_deviation(spark):
    rows = [("A", "random", "greedy", 0, 0.5, 3), ("B", "random", "greedy", 0, 0.9, 3), ("A", "random", "random", 0, 0.5, 3), ("A", "random", "random", 0, 0.7, 5)]
    history = spark.createDataFrame(rows, "target string, initialization_strategy string, strategy string, round int, roc_auc double, n_actives_found int")
    summary = report.auc_band(report.summarize(history)).collect()
    assert sorted(r.roc_auc_mean for r in summary if r.strategy == "greedy") == [0.5, 0.9]  # targets are not mixed
    got = {r.strategy: r for r in summary if r.target == "A"}
    assert got["greedy"].roc_auc_std is None and got["greedy"].auc_low is None
    assert got["random"].actives_std == pytest.approx(2**0.5) and got["random"].auc_high == pytest.approx(0.6 + 0.02**0.5)


@pytest.fixture(scope="module")
def described(spark):
    rng = np.random.default_rng(5)
    rows = [("t%d" % (i % 2), i, float(rng.normal()), float(i * i), 4.0, int(i % 3 == 0)) for i in range(60)]
    rows[0] = ("t0", 0, None, 0.0, 4.0, 1)
    return spark.createDataFrame(rows, "target string, mol_id bigint, a double, b double, c double, label int")


def test_correlation_with_gaps_and_constant(described):
    got = {(r.a, r.b): r.r for r in report.descriptor_correlation(described, ["a", "b", "c"]).collect()}
    want = described.toPandas()[["a", "b"]].corr()
    assert len(got) == 9
    assert got["a", "b"] == got["b", "a"] == pytest.approx(want.loc["a", "b"], abs=1e-12)
    assert got["a", "a"] == pytest.approx(1.0) and got["c", "c"] is None and got["a", "c"] is None


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_quantiles_and_limits(described, hot_rows):
    data = described.toPandas()
    rows = {(r.target, r.descriptor): r for r in report.descriptor_quantiles(described, ["a", "b"], hot_rows=hot_rows).collect()}
    for t, part in data.groupby("target"):
        assert rows[t, "b"].q25 == pytest.approx(part.b.quantile(0.25))
        assert rows[t, "a"].q50 == pytest.approx(part.a.quantile(0.5))
    limits = {r.descriptor: (r.low, r.high) for r in report.clip_limits(described, ["a", "b"], hot_rows).collect()}
    assert limits["a"] == (0.0, pytest.approx(data.a.quantile(0.99)))
    points = report.descriptor_scatter(described, "b", "c", hot_rows=hot_rows).collect()
    assert sum(not r.inside for r in points) == 1


def test_attach_metric(summary, spark):
    runs = spark.createDataFrame([("A", "random", "greedy", 1), ("A", "random", "greedy", 2)], "target string, initialization_strategy string, strategy string, seed int")
    rows = report.attach_metric(runs, summary).collect()
    assert [(r.label, r.roc_auc_mean) for r in rows] == [("Greedy", 0.9)] * 2
