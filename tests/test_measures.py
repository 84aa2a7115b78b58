import math

import pytest
from pyspark.sql import functions as F

from poolspark.functions import features as ff
from poolspark.functions.measures import activity_label, best_measure, free_energy, parse_measure, relation_of
from poolspark.functions.ordering import order_bucket, order_key
from poolspark.operators.features import add_fingerprint, add_profile, dense_bits, packed_bits

GOLDEN = [
    ("10", 10.0), ("<10", 10.0), (">10000", 10000.0), ("1,200", 1200.0), ("1.5e3", 1500.0), (" 5. ", 5.0),
    (".5", 0.5), ("-3", -3.0), ("0", 0.0), ("abc", None), ("10-20", 10.0), ("", None), (None, None), ("1e400", math.inf),
]


def test_parse_measure(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", parse_measure(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [v for _, v in GOLDEN]


def test_best_measure_priority(spark):
    rows = [
        (0, "10", "20", "30"), (1, "-3", ">20", "30"), (2, "0", "abc", "<1,000"), (3, None, "", "x"), (4, " <7", None, None),
    ]
    df = spark.createDataFrame(rows, "i int, ki string, kd string, ic50 string").select("i", best_measure())
    got = {r.i: (r.measure_type, r.value, r.relation) for r in df.collect()}
    assert got == {
        0: ("Ki", 10.0, "="), 1: ("Kd", 20.0, ">"), 2: ("IC50", 1000.0, "<"), 3: (None, None, None), 4: ("Ki", 7.0, "<"),
    }


def test_parsing_is_not_repeated_in_pushed_filters(spark):
    df = spark.createDataFrame([("1", "2", "3")], "ki string, kd string, ic50 string").select(best_measure())
    plan = df.where(F.col("value") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 3


def test_energy_label_relation(spark):
    df = spark.createDataFrame([(1000.0,), (1000.1,)], "v double")
    rows = df.select(free_energy(F.col("v")).alias("g"), activity_label(F.col("v")).alias("y")).collect()
    assert rows[0].g == pytest.approx(0.0019872041 * 298.15 * math.log(1e-6), rel=1e-12)
    assert [r.y for r in rows] == [1, 0]
    one = spark.createDataFrame([(" >5",)], "t string").select(relation_of(F.col("t")).alias("r")).head()
    assert one.r == ">"


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_order_bucket_is_monotone(spark, method):
    key = order_key(F.lit(3), F.col("id"), method)
    rows = spark.range(2000).select(key.alias("k"), order_bucket(key, method, 6).alias("b")).collect()
    rows.sort(key=lambda r: r.k)
    buckets = [r.b for r in rows]
    assert buckets == sorted(buckets)
    assert max(buckets.count(b) for b in set(buckets)) < 100
    assert len(set(buckets)) > 60


def test_order_key_rejects_unknown_method():
    with pytest.raises(ValueError):
        order_key(F.lit(1), F.lit(2), "sha")


def test_fingerprint_matches_plain_python(spark):
    texts = ["CC(=O)Oc1ccccc1C(=O)O", "abc", None, "", "äöüäöü", "abcd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.fp for r in add_fingerprint(df, "t", method="md5").collect()}
    import hashlib

    for i, text in enumerate(texts):
        grams = {text[j : j + 4] for j in range(len(text) - 3)} if text else set()
        want = sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 2048 for g in grams})
        assert (got[i] or []) == want
        assert (got[i] is None) == (not grams)


def test_word_grams_and_bad_options(spark):
    df = spark.createDataFrame([(" a b\n c  d e ",)], "t string")
    units = df.select(ff.text_units(F.col("t"), "word").alias("u"))
    assert units.select(ff.ngrams(F.col("u"), 4, "word").alias("g")).head().g == ["a b c d", "b c d e"]
    with pytest.raises(ValueError):
        ff.text_units(F.col("t"), "line")
    with pytest.raises(ValueError):
        ff.hashed_bits(F.col("g"), 8, "crc")


def test_dense_and_packed_bits(spark):
    df = spark.createDataFrame([(0, [0, 63, 64, 2047]), (1, [])], "i int, fp array<int>")
    rows = packed_bits(dense_bits(df)).orderBy("i").collect()
    assert [j for j, v in enumerate(rows[0].features) if v] == [0, 63, 64, 2047]
    assert len(rows[1].features) == 2048 and not any(rows[1].features)
    words = rows[0].packed
    assert len(words) == 32 and words[0] == 1 - 2**63 and words[1] == 1 and words[31] == -(2**63)


def test_profile(spark):
    df = spark.createDataFrame([("Ab 12, c.",), ("",)], "t string")
    rows = add_profile(df, "t").collect()
    assert (rows[0]["length"], rows[0].n_words, rows[0].n_digits, rows[0].n_upper, rows[0].n_punct) == (9, 3, 2, 1, 2)
    assert rows[0].mean_word == pytest.approx(7 / 3) and rows[0].vowel_ratio == pytest.approx(1 / 9)
    assert rows[1].vowel_ratio is None and rows[1].mean_word is None


def test_md5_bits_of_words_are_those_of_the_expressions(spark):
    """In batches, without an array of n-grams in the plan; other blanks than the four belong to a word."""
    texts = ["a b c d", " a\tb\r\nc  d e a b c d ", "a b c", "", "  ", None, "ü x 日本   y\x0bz w v w v w v", "a b c d\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    units = ff.text_units(F.col("t"), "word")
    want = {r.i: r.fp for r in df.select("i", ff.hashed_bits(ff.ngrams(units, 4, "word"), 2048, "md5").alias("fp")).collect()}
    made = add_fingerprint(df, "t", unit="word", method="md5")
    assert {r.i: r.fp for r in made.collect()} == want and made.schema["fp"].dataType.simpleString() == "array<int>"
    known = add_fingerprint(df, "t", unit="word", method="md5", valid_only=True)
    assert {r.i: r.fp for r in known.collect()} == {i: fp for i, fp in want.items() if fp is not None}
    assert "zip_with" not in known._jdf.queryExecution().toString()
