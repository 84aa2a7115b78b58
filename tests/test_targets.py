import pytest
from pyspark.sql import functions as F

from poolspark.operators import targets
from poolspark.sources.registry import SHIPPED_TARGETS, pick_targets, registry_from_mapping, registry_from_rows

NAMES = ["Poly [ADP-ribose] polymerase 1", "poly [adp-ribose] POLYMERASE 1", "Poly A", None, "Epidermal growth factor receptor"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(n, None if n is None else n.lower(), f"m{i}", float(10**i)) for i, n in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "target_name string, target_lc string, entity_key string, value_median double")
    return df.withColumn("label", (F.col("value_median") <= 1000).cast("int"))


def test_filter_modes(named):
    keys = lambda df: sorted(r.entity_key for r in df.collect())
    assert keys(targets.filter_target(named, "POLY [adp-ribose] polymerase 1", "exact")) == ["m0", "m1"]
    assert keys(targets.filter_target(named, "[ADP-ribose]")) == ["m0", "m1"]
    assert keys(targets.filter_target(named, "poly")) == ["m0", "m1", "m2"]
    with pytest.raises(ValueError):
        targets.filter_target(named, "poly", "regex")
    with pytest.raises(ValueError):
        targets.require_rows(targets.filter_target(named, "nothing"), "target 'X'")


def test_registry_defaults_and_errors(spark):
    config = {"A": {"query": "a"}, "B": {"query": "b", "match": "exact", "activity_threshold_nM": 50}}
    got = {r.target: (r["match"], r.threshold) for r in registry_from_mapping(spark, config).collect()}
    assert got == {"A": ("contains", 1000.0), "B": ("exact", 50.0)}
    with pytest.raises(ValueError, match="unknown match modes"):
        registry_from_rows(spark, [("A", "a", "regex", None)])
    with pytest.raises(ValueError, match="the registry has no targets"):
        pick_targets(registry_from_rows(spark), ["EGFR", "NOPE"])
    assert pick_targets(registry_from_rows(spark), ["EGFR"]).count() == 1
    assert registry_from_rows(spark).count() == len(SHIPPED_TARGETS)


def test_names_are_found_by_grams_as_by_comparison(spark):
    """Queries shorter than a gram, empty, repeated, longer than every name, with brackets and beyond ASCII."""
    names = ["", "a", "ab", "abc", "abcd", "xabcx", "poly [adp-ribose] polymerase 1", "αβγδ kinase", "kinase", "aaaa", "a\U0001f600b c"]
    texts = ["", "a", "AB", "abc", "abcd", "[ADP", "ribose]", "βγδ", "Kinase", "aaa", "\U0001f600b", "zz", "abcdefgh", "n" * 60, "ab"]
    registry = registry_from_rows(spark, [(f"T{i}", q, None, None) for i, q in enumerate(texts)] + [("E", "AB", "exact", 1.0)] * 2)
    frame = spark.createDataFrame([(n,) for n in [*names, None]], "target_lc string")
    matched = targets.match_names(frame, registry)
    want = [(n, f"T{i}") for n in names for i, q in enumerate(texts) if q.lower() in n] + [("ab", "E")] * 2
    assert sorted((r.target_lc, r.target) for r in matched.collect()) == sorted(want)
    assert "NestedLoop" not in matched._jdf.queryExecution().executedPlan().toString()
    only_exact = targets.match_names(frame, registry.where("match = 'exact'"))
    assert only_exact.count() == 2


@pytest.mark.parametrize("sent", [200_000, 0])
def test_slices_are_the_same_by_broadcast_and_by_shuffle(spark, named, monkeypatch, sent):
    monkeypatch.setattr(targets, "MAX_SENT_ROWS", sent)
    sliced = targets.label_targets(named, registry_from_rows(spark, [("P", "poly", None, 10.0), ("E", "EPIDERMAL growth factor receptor", "exact", None)]))
    assert sorted((r.target, r.entity_key, r.label) for r in sliced.collect()) == [("E", "m4", 0), ("P", "m0", 1), ("P", "m1", 1), ("P", "m2", 0)]


def test_label_targets(spark, named):
    reg = registry_from_rows(spark, [("PARP1", NAMES[0], "exact", 5.0), ("POLY", "POLY", None, None), ("GONE", "zzz", "exact", 1.0)])
    got = targets.label_targets(named, reg)
    rows = sorted((r.target, r.entity_key, r.label, r.label_default) for r in got.collect())
    assert rows == [("PARP1", "m0", 1, 1), ("PARP1", "m1", 0, 1), ("POLY", "m0", 1, 1), ("POLY", "m1", 1, 1), ("POLY", "m2", 1, 1)]
    assert [r.target for r in targets.missing_targets(got, reg).collect()] == ["GONE"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_reports(spark):
    df = spark.createDataFrame([("a", 10.0, "Ki"), ("a", 100.0, "Ki"), ("a", 1000.0, None), ("b", 7.0, "Kd")], "target string, v double, measure_type string")
    sweep = {(r.target, r.threshold): r.active_fraction for r in targets.threshold_sweep(df, ["target"], "v").collect()}
    assert sweep["a", 10] == pytest.approx(1 / 3) and sweep["a", 1000] == 1.0 and len(sweep) == 14
    share = {(r.target, r.measure_type): r.share for r in targets.type_share(df, ["target"]).collect()}
    assert share == {("a", "Ki"): 100.0, ("b", "Kd"): 100.0}
    bins = {(r.target, r.bin): (r.n, r.left_edge, r.right_edge) for r in targets.log_histogram(df, ["target"], "v", 4).collect()}
    assert [bins["a", b][0] for b in (1, 3, 4)] == [1, 1, 1]
    only = [v for (t, _), v in bins.items() if t == "b"]
    assert len(only) == 1 and only[0][0] == 1
    pct = {(r.target, r.percent): r.value for r in targets.affinity_percentiles(df, ["target"], "v").collect()}
    assert pct["a", 50] == 100.0 and pct["a", 75] == 550.0 and pct["b", 0] == 7.0


def test_metadata_counts_repeats_and_invalid_rows(spark):
    rows = [("T", "q", "exact", 5.0, "m1", 1, [1]), ("T", "q", "exact", 5.0, "m1", 0, [1]), ("T", "q", "exact", 5.0, "m2", 1, None)]
    df = spark.createDataFrame(rows, "target string, query string, `match` string, threshold double, entity_key string, label int, fp array<int>")
    r = targets.target_metadata(df, "fp").head()
    assert (r.n_raw, r.n_valid, r.active_fraction, r.n_repeated) == (3, 2, 0.5, 1)
