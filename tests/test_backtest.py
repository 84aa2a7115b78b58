import pytest
from pyspark.sql import functions as F

from poolspark.operators import model, space
from poolspark.operators.report import summarize
from poolspark.plans import panels
from poolspark.plans.backtest import run_backtest

STRATEGIES_ALL = ("greedy", "random", "uncertainty_topk", "uncertainty_diverse", "query_by_committee")
STRATEGIES = ["random", "greedy", "uncertainty_topk", "uncertainty_diverse"]
SETUP = {"n_initial": 10, "batch_size": 4, "n_rounds": 2, "shortlist": 12}


def history_of(run):
    rows = run.history.collect()
    return {(r.campaign, r["round"]): (r.n_labeled, r.n_actives_found, r.roc_auc, r.selected) for r in rows}


@pytest.fixture(scope="module")
def run(separable):
    return run_backtest(separable, STRATEGIES, ["random", "diverse"], [0, 1], **SETUP)


def test_invariants(run, separable):
    history = history_of(run)
    assert len(history) == 2 * 2 * 4 * 2 * 3
    state = run.state.toPandas()
    assert not state.duplicated(["campaign", "mol_id"]).any()
    held = {(r.target, s, r.mol_id) for r in run.pool.collect() for s in (0, 1) if r.test_mask[s]}
    assert not held & set(zip(state.target, state.seed, state.mol_id))
    truth = {(r.target, r.mol_id): r.label for r in separable.collect()}
    assert all(truth[t, m] == y for t, m, y in zip(state.target, state.mol_id, state.label))
    for campaign, part in state.groupby("campaign"):
        for r in range(3):
            n, actives, auc, selected = history[campaign, r]
            seen = part[part.round_labeled < r]
            assert (n, actives) == (10 + 4 * r, seen.label.sum()) and 0 <= auc <= 1
            want = sorted(part[part.round_labeled == r].mol_id)
            assert selected == (want if r < 2 else None)
    rounds = panels.campaign_state(run).groupBy("campaign").count().collect()
    assert {r["count"] for r in rounds} == {96}


def test_shared_start_and_better_than_chance(run):
    first = run.state.where(F.col("round_labeled") == -1).toPandas()
    sets = first.groupby(["target", "init", "seed", "strategy"]).mol_id.apply(lambda s: tuple(sorted(s)))
    assert (sets.groupby(level=[0, 1, 2]).nunique() == 1).all()
    assert summarize(run.history).where("round = 2").agg(F.min("roc_auc_mean")).head()[0] > 0.6


def test_greedy_picks_the_highest_scores(run):
    scores = model.score_rows(run.pool, run.models.where("strategy = 'greedy' and round = 0"), run.seeds, False).toPandas()
    state = run.state.where("strategy = 'greedy'").toPandas()
    for campaign, part in scores.groupby("campaign"):
        own = state[state.campaign == campaign]
        fresh = part[~part.mol_id.isin(own[own.round_labeled == -1].mol_id)]
        best = fresh.assign(s=-fresh.p).sort_values(["s", "mol_id"]).mol_id.head(4)
        assert sorted(best) == sorted(own[own.round_labeled == 0].mol_id)


def test_same_result_under_other_partitions_and_blocks(run, separable, monkeypatch):
    monkeypatch.setattr(model, "BROADCAST_BYTES", 400)
    again = run_backtest(separable.repartition(7), STRATEGIES, ["random", "diverse"], [0, 1], **SETUP)
    one, two = history_of(run), history_of(again)
    assert one.keys() == two.keys()
    for key in one:
        assert one[key][:2] == two[key][:2] and one[key][3] == two[key][3]
        assert one[key][2] == pytest.approx(two[key][2], abs=1e-9)


def test_errors(separable):
    with pytest.raises(ValueError, match="unknown strategy"):
        run_backtest(separable, ["best"])
    with pytest.raises(ValueError, match="candidate_pool_size"):
        run_backtest(separable, ["greedy"], shortlist=5)
    with pytest.raises(ValueError, match="rows are needed"):
        run_backtest(separable, ["random"], n_rounds=10)
    with pytest.raises(ValueError, match="leaves nothing to choose"):
        run_backtest(separable, ["greedy"], n_initial=96)


def test_a_used_up_pool_keeps_its_counts(separable):
    small = separable.where("target = 'A' and mol_id < 30")
    run = run_backtest(small, ["greedy"], ["random"], [0], n_initial=8, batch_size=8, n_rounds=4)
    rounds = [history_of(run)["A/random/greedy/0", r] for r in range(5)]
    assert [r[0] for r in rounds] == [8, 16, 24, 24, 24] and rounds[4][1] == rounds[2][1]


def test_committee_rounds(separable):
    one = separable.where("target = 'A'")
    run = run_backtest(one, ["query_by_committee"], ["random"], [0], n_initial=12, batch_size=4, n_rounds=1, trees=5, boosting_rounds=3)
    history = history_of(run)
    assert [history["A/random/query_by_committee/0", r][0] for r in (0, 1)] == [12, 16]


def test_all_strategies_and_layers_of_their_panels(separable):
    run = run_backtest(separable, list(STRATEGIES_ALL), ["random", "diverse"], [0], trees=20, boosting_rounds=5, **SETUP)
    assert run.history.select("campaign").distinct().count() == 2 * 2 * 5
    projected, _ = space.fit_pca(separable, 2)
    points, marks = panels.campaign_layers(run, projected)
    assert points.count() == 240 and marks.count() == run.state.count()
    # the layers hold the same tags as the panel of all campaigns and rows
    for r in (0, 1, 2):
        full = panels.campaign_panel(run, projected, r).where("tag <> 'Untested'").select("campaign", "mol_id", "tag")
        mine = marks.where(F.col("from_round") <= r).select("campaign", "mol_id", "tag")
        assert sorted(map(tuple, full.collect())) == sorted(map(tuple, mine.collect()))
    assert marks.where("roc_auc_mean is null").count() == 0


def test_panels(run, separable):
    projected, variance = space.fit_pca(separable, 3)
    rows = panels.campaign_panel(run, projected, 2)
    counts = {(r.campaign, r.tag): r["count"] for r in rows.groupBy("campaign", "tag").count().collect()}
    assert counts["A/random/greedy/0", "Initial"] == 10 and counts["A/random/greedy/0", "Untested"] == 96 - 18
    card = panels.experiment_card(separable, summarize(run.history), variance, 2).collect()
    assert len(card) == 2 and card[0].n == 120 and card[0].variance_3 > card[0].variance_2 > 0
    assert card[0].variance_2 != card[1].variance_2
    shown, _, _ = panels.projection_panel(projected, variance)
    share = {(r.target, r.pair): r.variance for r in shown.select("target", "pair", "variance").distinct().collect()}
    assert len(share) == 6 and share[card[0].target, "PC1-PC2"] == pytest.approx(card[0].variance_2)
