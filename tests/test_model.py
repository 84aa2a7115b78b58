import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from poolspark.operators import model, pool
from poolspark.operators.matrix import fit_logistic
from poolspark.operators.ranking import auc_by_group


def gradient(x, y, mean, dev, w, b):
    z = (x - mean) / dev
    p = 1 / (1 + np.exp(-(z @ w + b)))
    return np.append(w + z.T @ (p - y), np.sum(p - y))


@pytest.mark.parametrize("n,d", [(20, 3), (30, 200), (120, 2048)])
@pytest.mark.parametrize("scale", [True, False])
def test_fit_is_a_stationary_point(n, d, scale):
    rng = np.random.default_rng(n)
    x = (rng.random((n, d)) < 0.2).astype(float)
    x[:, 0] = 1.0  # constant column
    y = (rng.random(n) < 0.4).astype(float)
    y[0], y[1] = 0, 1
    fit = fit_logistic(x, y, scale)
    assert np.abs(gradient(x, y, *fit)).max() < 1e-6
    if scale:
        assert fit[1][0] == 1.0


def test_fit_hand_case_and_one_class():
    x, y = np.array([[-1.0], [1.0], [-1.0], [1.0]]), np.array([0.0, 1.0, 0.0, 1.0])
    _, _, w, b = fit_logistic(x, y)
    # Minimise w^2 / 2 + 4 log(1 + exp(-w)): w = 4 / (1 + exp(w)).
    assert b == pytest.approx(0.0, abs=1e-9) and w[0] == pytest.approx(4 / (1 + np.exp(w[0])), abs=1e-9)
    with pytest.raises(ValueError, match="one class"):
        fit_logistic(x, np.ones(4))


@pytest.fixture(scope="module")
def fitted(spark, separable):
    prepared = pool.prepare_pool(separable, [0, 1]).cache()
    grid = pool.campaign_grid(prepared, ["random"], ["greedy"], [0, 1])
    drawn = pool.init_random(prepared, [0, 1], 30).select("target", "seed", "mol_id")
    labeled = drawn.join(prepared, ["target", "mol_id"]).join(grid, ["target", "seed"]).cache()
    return prepared, labeled, model.fit_campaigns(labeled).withColumn("round", F.lit(0)).cache()


@pytest.mark.parametrize("limit", [64 * 1024 * 1024, 100])
def test_scores_equal_direct_evaluation(fitted, monkeypatch, limit):
    monkeypatch.setattr(model, "BROADCAST_BYTES", limit)
    prepared, _, models = fitted
    data = {(r.target, r.mol_id): r for r in prepared.collect()}
    rows = model.score_rows(prepared, models, [0, 1], held_out=True).collect()
    assert len(rows) == 4 * 24
    for r in rows:
        m = next(m for m in models.collect() if m.campaign == r.campaign)
        source = data[m.target, r.mol_id]
        assert source.test_mask[m.seed] and source.label == r.label
        assert r.p == pytest.approx(1 / (1 + np.exp(-(np.dot(source.features, m.features) + m.intercept))), abs=1e-12)


def test_auc_on_separable_data(fitted):
    prepared, _, models = fitted
    quality = auc_by_group(model.score_rows(prepared, models, [0, 1], True), ["campaign", "round"]).collect()
    assert len(quality) == 4 and all(r.roc_auc > 0.85 for r in quality)


def test_candidates_are_the_best_unlabeled_rows(fitted):
    prepared, labeled, models = fitted
    keep = {"greedy": 5}
    found = model.best_candidates(prepared.repartition(6), models, labeled, [0, 1], keep).toPandas()
    scores = model.score_rows(prepared, models, [0, 1], held_out=False).toPandas()
    tested = {(r.campaign, r.mol_id) for r in labeled.collect()}
    for campaign, part in scores.groupby("campaign"):
        fresh = part[[(campaign, m) not in tested for m in part.mol_id]]
        want = fresh.assign(s=-fresh.p).sort_values(["s", "mol_id"]).mol_id.head(5)
        got = found[found.campaign == campaign].sort_values(["score", "mol_id"]).mol_id.head(5)
        assert list(got) == list(want)


def test_one_class_and_oversized_sets_are_refused(fitted, monkeypatch):
    _, labeled, _ = fitted
    with pytest.raises(PySparkException, match="one class"):
        model.fit_campaigns(labeled.withColumn("label", F.lit(1))).collect()
    with pytest.raises(ValueError, match="one class"):
        model.fit_large(labeled.withColumn("label", F.lit(1)), 30)


def test_large_fit_agrees_with_grouped_fit(fitted):
    _, labeled, models = fitted
    one = labeled.where(F.col("campaign") == "A/random/greedy/0")
    m = models.where(F.col("campaign") == "A/random/greedy/0").head()
    rows = model.fit_large(one, 30).transform(one.withColumn("vector", model.array_to_vector("features")))
    got = {r.mol_id: r.p for r in rows.select("mol_id", vector_to_array("probability")[1].alias("p")).collect()}
    for r in one.collect():
        direct = 1 / (1 + np.exp(-(np.dot(r.features, m.features) + m.intercept)))
        assert got[r.mol_id] == pytest.approx(direct, abs=0.02)
