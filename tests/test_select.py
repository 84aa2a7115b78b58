import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from poolspark.operators import select
from poolspark.operators.matrix import farthest_point_order

K = ["campaign"]


@pytest.fixture(scope="module")
def candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, float(p), [float(v) for v in rng.normal(size=3)]) for c in "ab" for i, p in enumerate(rng.random(150))]
    return spark.createDataFrame(rows, "campaign string, mol_id bigint, p double, features array<double>").cache()


def picked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.campaign, []).append((r["rank"], r.mol_id))
    return {c: [m for _, m in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize(
    "name,key", [("select_greedy", lambda d: -d.p), ("select_uncertainty_topk", lambda d: (d.p - 0.5).abs())]
)
def test_top_strategies(candidates, name, key):
    got = picked(getattr(select, name)(candidates.repartition(9), K, 7))
    for c, part in candidates.toPandas().groupby("campaign"):
        assert got[c] == list(part.assign(k=key(part)).sort_values(["k", "mol_id"]).mol_id.head(7))


def test_ties_short_pools_and_nan(spark):
    df = spark.createDataFrame([("a", i, 0.5) for i in (5, 3, 9)], "campaign string, mol_id bigint, p double")
    assert picked(select.select_greedy(df, K, 2)) == {"a": [3, 5]}
    assert len(picked(select.select_greedy(df, K, 10))["a"]) == 3
    assert picked(select.select_by_score(df, K, F.col("mol_id").cast("double"), 1, highest=False)) == {"a": [3]}
    bad = df.withColumn("p", F.lit(float("nan")))
    with pytest.raises(PySparkException, match="NaN score"):
        select.select_greedy(bad, K, 2).collect()


def test_random_draw(candidates):
    one = picked(select.select_random(candidates, K, F.lit(5)))
    assert one == picked(select.select_random(candidates.repartition(7), K, F.lit(5)))
    assert one != picked(select.select_random(candidates, K, F.lit(6)))
    assert all(len(set(v)) == 10 for v in one.values())
    with pytest.raises(ValueError, match="exceeds the unlabeled pool"):
        select.select_random(candidates, K, F.lit(5), 151)


def test_uncertain_and_diverse(candidates):
    got = picked(select.select_uncertainty_diverse(candidates, K, F.lit(1), 8, 40))
    for c, part in candidates.toPandas().groupby("campaign"):
        near = part.assign(u=(part.p - 0.5).abs()).sort_values(["u", "mol_id"]).head(40)
        ids, x = near.mol_id.to_numpy(), np.stack(near.features)
        order = farthest_point_order(ids, x, int(np.flatnonzero(ids == got[c][0])[0]), 8)
        assert got[c] == [int(i) for i in ids[order]]
    with pytest.raises(ValueError, match="candidate_pool_size"):
        select.select_uncertainty_diverse(candidates, K, F.lit(1), 8, 7)
    few = candidates.where(F.col("mol_id") < 5)
    with pytest.raises(PySparkException, match="rows wanted of"):
        select.select_uncertainty_diverse(few, K, F.lit(1), 8, 40).collect()


def test_committee_choice_and_sets(candidates):
    scored = candidates.withColumn("disagreement", F.col("p"))
    assert picked(select.select_query_by_committee(scored, K, 4)) == picked(select.select_greedy(candidates, K, 4))
    best = select.select_greedy(candidates, K, 4)
    keys = ["campaign", "mol_id"]
    assert select.restrict_to(candidates, best, keys).count() == 8
    assert select.exclude(candidates, best, keys).count() == 292
