import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from poolspark.operators import committee, model, pool, select, trees
from poolspark.operators.matrix import fit_logistic


@pytest.fixture(scope="module")
def trained(separable):
    labeled = separable.where("target = 'A' and mol_id < 40")
    return committee.train_committee(labeled, 1, 40, trees=10, boosting_rounds=5)


def test_probabilities_and_disagreement(trained, separable):
    rows = separable.where("mol_id >= 40").select("target", "mol_id", "features", "label")
    scored = committee.committee_probabilities(trained, rows).cache()
    keys = ["target", "mol_id"]
    long = committee.long_probabilities(scored, keys)
    p = long.toPandas()
    assert set(p.member) == {"logistic", "forest", "boosting"} and p.p.between(0, 1).all()
    want = p.groupby(keys).p.var(ddof=0)
    for df in (committee.disagreement(long, keys), committee.with_disagreement(scored)):
        got = df.toPandas().set_index(keys).disagreement.sort_index()
        np.testing.assert_allclose(got, want.sort_index(), atol=1e-12)


@pytest.mark.parametrize("hot_rows", [1_000_000, 10])
def test_stats_and_diagnostics(spark, hot_rows):
    rows = [("c", i, float(i) / 100) for i in range(40)]
    scores = spark.createDataFrame(rows, "campaign string, mol_id bigint, disagreement double")
    r = committee.disagreement_stats(scores, ["campaign"], hot_rows).head()
    assert (r.mean_disagreement, r.max_disagreement, r.median_disagreement) == (pytest.approx(0.195), 0.39, pytest.approx(0.195))
    everything = spark.range(45).select(F.lit("c").alias("campaign"), F.col("id").alias("mol_id"))
    chosen = select.select_query_by_committee(scores, ["campaign"], 3)
    got = {r.mol_id: (r.disagreement, r.selected) for r in committee.diagnostics(everything, scores, chosen, ["campaign", "mol_id"]).collect()}
    assert got[44] == (0.0, False) and got[39] == (0.39, True) and sum(s for _, s in got.values()) == 3


def test_one_class_is_refused(separable):
    with pytest.raises(ValueError, match="one class"):
        committee.train_committee(separable.withColumn("label", F.lit(0)), 1, 240)


# Trees and committees fitted side by side ---------------------------------------------------------


def plain_tree(x, y, w, depth):
    """(value of a row) by the same rule, one node after the other."""
    total = w.sum()
    mean = (w * y).sum() / total
    used = w > 0
    best = None
    if depth and np.ptp(y[used]) > 0:
        for f in range(x.shape[1]):
            values = np.unique(x[used, f])
            for a, b in zip(values, values[1:]):
                left = w * (x[:, f] <= a)
                right = w - left
                ml, mr = (left * y).sum() / left.sum(), (right * y).sum() / right.sum()
                gain = round(left.sum() * right.sum() / total * (ml - mr) ** 2, 12)
                if best is None or gain > best[0]:
                    best = (gain, f, a + (b - a) / 2)
    if best is None:
        return lambda v: mean
    _, f, cut = best
    low = plain_tree(x, y, w * (x[:, f] <= cut), depth - 1)
    high = plain_tree(x, y, w * (x[:, f] > cut), depth - 1)
    return lambda v: low(v) if v[f] <= cut else high(v)


@pytest.mark.parametrize("depth", [1, 3, 40])
@pytest.mark.parametrize("levels", [2, 5, 1000])
def test_trees_grow_like_a_plain_search(depth, levels):
    rng = np.random.default_rng(depth + levels)
    x = np.round(rng.random((45, 5)) * levels)
    x[:, 3] = 1.0
    y = (rng.random(45) < 0.5).astype(float)
    weight = rng.integers(0, 3, (4, 45)).astype(float)
    bins, values = trees.binned(x)
    grown, leaf = trees.grow(bins, values, y, weight, depth)
    fresh = np.vstack([x, np.round(rng.random((30, 5)) * levels)])
    for t in range(4):
        one = grown._replace(roots=grown.roots[t:t + 1])
        plain = plain_tree(x, y, weight[t], depth)
        np.testing.assert_allclose(trees.tree_values(one, fresh, 7), [plain(v) for v in fresh], atol=1e-12)
        assert ((leaf[t] >= 0) == (weight[t] > 0)).all()
        np.testing.assert_allclose(grown.value[leaf[t][weight[t] > 0]], trees.tree_values(one, x[weight[t] > 0]))


def test_features_are_drawn_among_those_that_vary():
    rng = np.random.default_rng(1)
    useful = rng.random((200, 9)) < 0.4
    drawn = trees._draw(useful, 3, rng)
    for row, ok in zip(drawn, useful):
        picked = row[row >= 0]
        assert ok[picked].all() and len(set(picked)) == len(picked) == min(3, ok.sum())


def test_boosting_lowers_the_loss_and_forest_votes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    losses = []
    for rounds in (0, 5, 40):
        grown, start = trees.fit_boosting(x, y, rounds, 3, 0.1)
        raw = start + trees.tree_values(grown, x)
        losses.append(np.mean(np.logaddexp(0, raw) - y * raw))
    assert losses[0] > losses[1] > losses[2]
    forest = trees.fit_forest(x, y, 60, np.random.default_rng(0))
    share = trees.tree_values(forest, x) / 60
    assert ((share > 0.5) == y).mean() > 0.95 and ((share >= 0) & (share <= 1)).all()


@pytest.fixture(scope="module")
def side_by_side(separable):
    prepared = pool.prepare_pool(separable, [0, 1]).cache()
    grid = pool.campaign_grid(prepared, ["random"], ["query_by_committee"], [0, 1])
    drawn = pool.init_random(prepared, [0, 1], 30).select("target", "seed", "mol_id")
    labeled = drawn.join(prepared, ["target", "mol_id"]).join(grid, ["target", "seed"]).cache()
    return prepared, labeled, committee.fit_committees(labeled, 2, trees=130, boosting_rounds=12).cache()


def test_committees_equal_members_fitted_and_scored_one_by_one(side_by_side):
    prepared, labeled, committees = side_by_side
    assert committees.groupBy("campaign").count().where("count <> 4").count() == 0
    data = prepared.toPandas()
    got = committee.with_disagreement(model.score_committees(prepared, committees, [0, 1])).toPandas().set_index(["campaign", "mol_id"])
    mine = labeled.toPandas()
    for (campaign, target, seed), rows in mine.groupby(["campaign", "target", "seed"]):
        rows = rows.sort_values("mol_id")
        x, y = np.stack(rows.features), rows.label.to_numpy(float)
        _, _, w, b = fit_logistic(x, y, scale=False)
        boosted, start = trees.fit_boosting(x, y, 12, 3, 0.1)
        forest = [committee._trees(r) for r in committees.where((F.col("campaign") == campaign) & (F.col("member") == "forest")).collect()]
        open_rows = data[(data.target == target) & np.array([not m[seed] for m in data.test_mask])]
        for mol_id, v in zip(open_rows.mol_id, open_rows.features):
            v = np.asarray(v)[None, :]
            votes = []
            for r in forest:
                for at in r.roots:
                    while r.child[at] != at:
                        at = r.child[at] + (v[0][r.feature[at]] > r.threshold[at])
                    votes.append(r.value[at])
            assert len(votes) == 130
            p = [1 / (1 + np.exp(-(v[0] @ w + b))), np.mean(votes), 1 / (1 + np.exp(-(start + trees.tree_values(boosted, v)[0])))]
            row = got.loc[campaign, mol_id]
            np.testing.assert_allclose([m["p"] for m in row.member_p], p, atol=1e-9)
            assert row.disagreement == pytest.approx(np.var(p), abs=1e-9)


def test_committees_do_not_depend_on_layout(side_by_side):
    _, labeled, committees = side_by_side
    again = committee.fit_committees(labeled.repartition(7, "mol_id"), 2, trees=130, boosting_rounds=12)
    key = ["campaign", "member", "part"]
    assert committees.orderBy(key).collect() == again.orderBy(key).collect()
    other = committee.fit_committees(labeled, 3, trees=130, boosting_rounds=12).where("member = 'forest'")
    assert other.orderBy(key).collect() != committees.where("member = 'forest'").orderBy(key).collect()


def test_committee_candidates_are_the_most_disputed(side_by_side):
    prepared, labeled, committees = side_by_side
    models = model.fit_campaigns(labeled)
    found = model.best_candidates(prepared.repartition(5), models, labeled, [0, 1], {"query_by_committee": 6}, committees).toPandas()
    scores = committee.with_disagreement(model.score_committees(prepared, committees, [0, 1])).toPandas()
    tested = {(r.campaign, r.mol_id) for r in labeled.collect()}
    for campaign, part in scores.groupby("campaign"):
        fresh = part[[(campaign, m) not in tested for m in part.mol_id]]
        want = fresh.assign(s=-fresh.disagreement.round(12)).sort_values(["s", "mol_id"]).mol_id.head(6)
        got = found[found.campaign == campaign].assign(s=lambda f: f.score.round(12)).sort_values(["s", "mol_id"]).mol_id.head(6)
        assert list(got) == list(want)


def test_one_class_and_oversized_sets_are_refused_side_by_side(side_by_side, monkeypatch):
    _, labeled, _ = side_by_side
    with pytest.raises(PySparkException, match="one class"):
        committee.fit_committees(labeled.withColumn("label", F.lit(1))).collect()
