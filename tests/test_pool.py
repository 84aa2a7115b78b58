import numpy as np
import pytest
from pyspark.sql import functions as F

from poolspark.operators import pool as pl
from poolspark.operators.matrix import farthest_point_order


def split_rows(df, partitions):
    rows = df.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1)))).repartition(partitions)
    found = pl.stratified_split(rows.select("target", "mol_id", "label", "seed"), ["target"])
    return {(r.target, r.seed, r.mol_id): (r.split, r.label) for r in found.collect()}


def test_split_is_exact_stratified_and_partition_independent(separable):
    one = split_rows(separable, 1)
    assert one == split_rows(separable, 4) == split_rows(separable, 17)
    data = separable.toPandas()
    for target in "AB":
        n_pos = int(data[data.target == target].label.sum())
        for seed in (0, 1):
            test = [label for (t, s, _), (split, label) in one.items() if t == target and s == seed and split == "test"]
            assert len(test) == 24 and abs(sum(test) - 0.2 * n_pos) < 1
    draws = lambda seed: {m for (t, s, m), (split, _) in one.items() if t == "A" and s == seed and split == "test"}
    assert draws(0) != draws(1)


def test_prepared_mask_agrees_with_split(separable):
    rows = split_rows(separable, 3)
    for r in pl.prepare_pool(separable, [0, 1]).collect():
        assert r.test_mask == [rows[r.target, s, r.mol_id][0] == "test" for s in (0, 1)]


def test_cutoffs_meet_the_pool_the_same_both_ways(separable, monkeypatch, capsys):
    found, spark = {}, separable.sparkSession
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for limit in (pl.BROADCAST_CUTOFFS, 0):
        monkeypatch.setattr(pl, "BROADCAST_CUTOFFS", limit)
        prepared = pl.prepare_pool(separable, [0, 1, 2])
        prepared.explain()
        found[limit] = sorted(map(str, prepared.collect()))
        plan = capsys.readouterr().out
        assert ("BroadcastHashJoin" in plan) == (limit > 0) and ("hashpartitioning(target" in plan) == (limit == 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert len(set(map(tuple, found.values()))) == 1


def test_quota_by_largest_remainder(spark):
    counts = spark.createDataFrame([("t", 0, 7), ("t", 1, 4)], "target string, label int, n bigint")
    assert {r.label: r.take for r in pl.test_quota(counts, ["target"], "label").collect()} == {0: 2, 1: 1}
    counts = spark.createDataFrame([("t", 0, 99), ("t", 1, 1)], "target string, label int, n bigint")
    assert {r.label: r.take for r in pl.test_quota(counts, ["target"], "label").collect()} == {0: 20, 1: 0}


def test_grid_and_names(separable):
    grid = pl.campaign_grid(separable, ["random"], ["greedy", "random"], [3, 4])
    assert grid.count() == 8 and grid.select("campaign").distinct().count() == 8
    assert "Cartesian" not in grid._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="unknown strategy"):
        pl.campaign_grid(separable, ["random"], ["best"], [1])
    with pytest.raises(ValueError, match="unknown initialization"):
        pl.campaign_grid(separable, ["corner"], ["greedy"], [1])


def test_starting_sets(separable):
    prepared = pl.prepare_pool(separable, [0, 1]).cache()
    rows = pl.init_random(prepared, [0, 1], 5).collect()
    assert len(rows) == 20 and len({(r.target, r.seed, r.mol_id) for r in rows}) == 20
    held = {(r.target, i, r.mol_id) for r in prepared.collect() for i in (0, 1) if r.test_mask[i]}
    assert not held & {(r.target, r.seed, r.mol_id) for r in rows}
    again = pl.init_random(prepared.repartition(7), [0, 1], 5).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for draw in (pl.init_random, pl.init_diverse):
        with pytest.raises(ValueError, match="leaves nothing to choose"):
            draw(prepared, [0, 1], 96)


@pytest.mark.parametrize("limit, candidates", [(64 * 1024 * 1024, 256), (64 * 1024 * 1024, 20), (300, 3), (64 * 1024 * 1024, 1)])
@pytest.mark.parametrize("copies", [False, True])
def test_diverse_start_equals_brute_force(spark, separable, monkeypatch, limit, candidates, copies):
    """Also with centres split over many small broadcast blocks, few candidates a pass, and many rows alike."""
    monkeypatch.setattr(pl, "BROADCAST_BYTES", limit)
    n = 20 if candidates >= 20 else 5
    rows = separable.withColumn("features", F.transform("features", lambda v: F.round(v / 2))) if copies else separable
    prepared = pl.prepare_pool(rows, [0, 1]).repartition(5).cache()
    found = pl.init_diverse(prepared, [0, 1], n, candidates=candidates).collect()
    data = prepared.toPandas()
    for target in "AB":
        for seed in (0, 1):
            part = data[(data.target == target) & ~data.test_mask.str[seed]].reset_index(drop=True)
            got = [r.mol_id for r in sorted((r for r in found if r.target == target and r.seed == seed), key=lambda r: r["rank"])]
            ids, x = part.mol_id.to_numpy(), np.stack(part.features)
            order = farthest_point_order(ids, x, int(np.flatnonzero(ids == got[0])[0]), n)
            assert got == [int(i) for i in ids[order]]


def test_passes_over_rows_that_are_all_alike(spark, separable, monkeypatch):
    passes = []
    plain = pl.more_centres
    monkeypatch.setattr(pl, "more_centres", lambda *a: passes.append(1) or plain(*a))
    alike = separable.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    found = pl.init_diverse(pl.prepare_pool(alike, [0]).cache(), [0], 12, candidates=16)
    ids = sorted((r.target, r["rank"], r.mol_id) for r in found.collect())
    assert len(ids) == 24 and len(passes) == 1
    for target in "AB":
        later = [m for t, rank, m in ids if t == target and rank > 1]
        assert later == sorted(later)


def test_farthest_points_on_a_line():
    x = np.array([[0.0], [1.0], [2.0], [3.0], [4.0], [10.0]])
    assert farthest_point_order(np.arange(6), x, 0, 4) == [0, 5, 4, 2]
    same = np.zeros((4, 2))
    assert farthest_point_order(np.array([9, 4, 7, 5]), same, 0, 3) == [0, 1, 3]
    with pytest.raises(ValueError, match="rows wanted of"):
        farthest_point_order(np.arange(3), x[:3], 0, 4)


def test_state_operators(spark):
    rows = [("c", 1, 1, -1), ("c", 2, 0, -1), ("c", 3, 1, 0), ("c", 4, 0, 1), ("c", 5, 1, None), ("c", 6, 0, None)]
    state = spark.createDataFrame(rows, "campaign string, mol_id bigint, label int, round_labeled int")
    tags = lambda df, name: [r[name] for r in df.orderBy("mol_id").collect()]
    assert tags(pl.state_at_round(state, 1), "tag") == ["Initial", "Initial", "New active", "Untested", "Untested", "Untested"]
    assert tags(pl.state_at_round(state, 2), "tag")[3] == "New inactive"
    assert tags(pl.truth_tags(state), "truth_tag") == ["labeled active", "labeled inactive", "labeled active", "labeled inactive", "unlabeled active", "unlabeled inactive"]
    assert tags(pl.truth_tags(state), "open_tag")[4:] == ["unlabeled", "unlabeled"]
    found = {r["round"]: (r.n_labeled, r.n_actives_found) for r in pl.running_actives(state, ["campaign"]).collect()}
    assert found == {0: (2, 1), 1: (3, 2), 2: (4, 2)}
    chosen = spark.createDataFrame([("c", 5), ("c", 1)], "campaign string, mol_id bigint")
    assert tags(pl.update_pool(state, chosen, ["campaign", "mol_id"], F.lit(7)), "round_labeled") == [-1, -1, 0, 1, 7, None]
    assert pl.unlabeled(state, chosen, ["campaign", "mol_id"]).count() == 4
    assert pl.reveal_labels(state.drop("label"), state.select("mol_id", "label"), ["mol_id"]).count() == 4
