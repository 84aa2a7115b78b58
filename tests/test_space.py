import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolspark.catalog import spaces
from poolspark.operators import features, space
from poolspark.plans import panels


def eigen(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] > 0, 1, -1)
    return (values / values.sum())[:k], ((x - x.mean(axis=0)) @ (vectors * signs))[:, :k]


POOL_SCHEMA = "target string, mol_id bigint, features array<double>, label int"


def test_components_of_each_target_equal_its_eigen_decomposition(spark):
    """A hot target, a small one and rows without target, far from the origin; rows without features take no part."""
    rng = np.random.default_rng(2)
    data = {t: rng.normal(size=(n, 7)) @ rng.normal(size=(7, 7)) + 300.0 for t, n in (("A", 400), ("B", 30), (None, 50))}
    rows = [(t, i, v.tolist(), i % 2) for t, x in data.items() for i, v in enumerate(x)] + [("A", 999, None, 1)]
    df = spark.createDataFrame(rows, POOL_SCHEMA).repartition(9)
    projected, variance = space.fit_pca(df, 3)
    found, shares = projected.orderBy("mol_id").collect(), variance.orderBy("component").collect()
    assert len(found) == 480 and len(shares) == 9
    for t, x in data.items():
        explained, points = eigen(x, 3)
        np.testing.assert_allclose([r.explained for r in shares if r.target == t], explained, rtol=1e-8)
        np.testing.assert_allclose([r.cumulative for r in shares if r.target == t], np.cumsum(explained), rtol=1e-8)
        np.testing.assert_allclose(np.array([r.embedding for r in found if r.target == t]), points, atol=1e-7)
    rows = space.projection_rows(projected.where("target = 'B'"), ["mol_id"]).where("pair = 'PC2-PC3'").orderBy("mol_id").collect()
    np.testing.assert_allclose([(r.x, r.y) for r in rows], eigen(data["B"], 3)[1][:, 1:3], atol=1e-7)


@pytest.mark.parametrize("options", [{"block_columns": 3, "fan_in": 2}, {"block_columns": 7, "scan_bytes": 1}, {}])
def test_blocks_of_any_width_and_merges_of_any_size_agree(spark, options):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 7)) * np.arange(1, 8) + 1e4
    rows = spark.createDataFrame([("A" if i % 4 else "B", v.tolist()) for i, v in enumerate(x)], "key string, features array<double>").repartition(11)
    width = options.get("block_columns", 256)
    blocks = space.covariance_blocks(rows, **options).collect()
    assert len(blocks) == 2 * {3: 6, 7: 1, 256: 1}[width]
    for r in blocks:
        own = x[np.arange(200) % 4 != 0] if r.key == "A" else x[::4]
        centred = own - own.mean(axis=0)
        want = (centred.T @ centred)[r.i * width : (r.i + 1) * width, r.j * width : (r.j + 1) * width]
        assert r.n == len(own)
        np.testing.assert_allclose(np.reshape(r.block, want.shape), want, atol=1e-6)


def test_rows_that_do_not_vary_and_no_rows(spark):
    df = spark.createDataFrame([("A", 1, [1.0, 2.0], 0), ("A", 2, [1.0, 2.0], 1), ("B", 3, [5.0, 6.0], 1)], POOL_SCHEMA)
    projected, variance = space.fit_pca(df, 2)
    assert {tuple(r.embedding) for r in projected.collect()} == {(0.0, 0.0)}
    assert {(r.explained, r.cumulative) for r in variance.collect()} == {(0.0, 0.0)}
    projected, variance = space.fit_pca(df.where("mol_id > 9"), 2)
    assert projected.count() == 0 and variance.count() == 0


def test_loadings_in_parts_give_the_same_points(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(t, i, rng.normal(size=4).tolist(), 0) for t in "ABCDEF" for i in range(20)], POOL_SCHEMA)
    whole = {(r.target, r.mol_id): r.embedding for r in space.fit_pca(df, 2)[0].collect()}
    monkeypatch.setattr(space, "BROADCAST_BYTES", 200)
    parts = {(r.target, r.mol_id): r.embedding for r in space.fit_pca(df, 2)[0].collect()}
    assert whole.keys() == parts.keys()
    np.testing.assert_allclose([whole[k] for k in whole], [parts[k] for k in whole], atol=1e-9)


def test_components_of_on_bits_are_those_of_numbers(spark, monkeypatch):
    """A few rows at a time are spread out; the neighbour map of the catalog makes no column of numbers."""
    rng = np.random.default_rng(6)
    rows = [(t, i, sorted(int(b) for b in rng.choice(20, rng.integers(0, 9), replace=False)), 0) for t in "AB" for i in range(40)]
    df = spark.createDataFrame([*rows, ("A", 99, None, 0)], "target string, mol_id bigint, fp array<int>, label int").repartition(2)
    dense, shares = space.fit_pca(features.dense_bits(df, n_bits=20), 2)
    monkeypatch.setattr(space, "SPREAD_ROWS", 7)
    made, parts = space.fit_pca(df, 2, features="fp", n_bits=20)
    points = lambda out: {(r.target, r.mol_id): r.embedding for r in out.collect()}
    want, found = points(dense), points(made)
    assert found.keys() == want.keys() and len(found) == 80
    np.testing.assert_allclose([found[i] for i in want], [want[i] for i in want], atol=1e-9)
    np.testing.assert_allclose(sorted(r.explained for r in parts.collect()), sorted(r.explained for r in shares.collect()), atol=1e-9)
    x = space.spread_rows(pa.array([[1], [], [0, 2]], pa.list_(pa.int32())).slice(1), 3)
    assert x.tolist() == [[0, 0, 0], [1, 0, 1]]
    assert [len(part) for part in space._slices(pa.record_batch({"i": list(range(16))}))] == [7, 7, 2]


def test_neighbour_map_makes_no_column_of_numbers(spark, tmp_path, monkeypatch):
    text = lambda i: " ".join(f"w{i % 3 + j}" for j in range(6 + i % 2))
    spark.createDataFrame([(i, text(i)) for i in range(12)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(features, "dense_bits", None)
    assert spaces.neighbour_panel(spark, str(tmp_path)).count() == 90


def test_neighbour_panel_places_both_ends(spark):
    rows = spark.createDataFrame([(1, [1, 2], 0), (2, [1, 3], 1), (3, [5], 1)], "mol_id bigint, fp array<int>, label int")
    points = rows.select("mol_id", "label", F.array(F.col("mol_id").cast("double"), -F.col("mol_id").cast("double")).alias("embedding"))
    drawn = panels.neighbour_panel(space.knn_jaccard(rows, 1, n_bits=8), points).collect()
    assert {(r.src, r.dst, r.src_x, r.src_y, r.dst_x, r.src_label, r.dst_label) for r in drawn} == {
        (1, 2, 1.0, -1.0, 2.0, 0, 1), (2, 1, 2.0, -2.0, 1.0, 1, 0), (3, 1, 3.0, -3.0, 1.0, 1, 0)}


def test_neighbour_panel_projects_each_row_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embedding(i):
        made.add(1)
        return [float(i), 0.0]

    rows = spark.createDataFrame([(i, [i, i + 1], 0) for i in range(6)], "mol_id bigint, fp array<int>, label int")
    assert panels.neighbour_panel(space.knn_jaccard(rows, 2, n_bits=8), rows.withColumn("embedding", embedding("mol_id"))).count() == 12
    assert made.value == 6


def test_fingerprints_of_wanted_documents(spark, tmp_path):
    """Only their texts are read through; the rows are those of all fingerprints joined to the labels, repeats included."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(6))
    spark.createDataFrame([(i, text(i)) for i in (1, 2, 2, 3)] + [(4, "too short"), (None, text(5))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 1), (4, 1), (None, 1)], "doc_id bigint, label int")
    few = spaces.fingerprints(spark, str(tmp_path), wanted=labels)
    assert sorted(r.doc_id for r in few.collect()) == [2, 2, 3]
    rows = lambda fps: sorted(map(str, features.align(fps, labels, ["doc_id"]).collect()))
    assert rows(few) == rows(spaces.fingerprints(spark, str(tmp_path))) and len(rows(few)) == 5


def brute(fps, k):
    out = {}
    for i, a in fps.items():
        near = sorted((1 - len(a & b) / len(a | b), j) for j, b in fps.items() if j != i)
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_neighbours_equal_brute_force(spark, block_rows):
    """With many copies of one fingerprint, ties and rows that share nothing."""
    rng = np.random.default_rng(4)
    fps = {int(i): frozenset(int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)) for i in range(60)}
    fps.update({int(i): frozenset({1, 2, 3}) for i in range(100, 130)})
    rows = [(i, sorted(bits)) for i, bits in fps.items()] + [(999, [])]
    df = spark.createDataFrame(rows, "mol_id bigint, fp array<int>").repartition(5)
    found = {}
    for r in space.knn_jaccard(df, 6, n_bits=64, block_rows=block_rows).collect():
        found.setdefault(r.src, []).append((r["rank"], r.dist, r.dst))
    want = brute(fps, 6)
    assert found.keys() == want.keys()
    for i, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6]
        assert [(round(d, 12), j) for _, d, j in rows] == [(round(d, 12), j) for d, j in want[i]]


@pytest.mark.parametrize("n_bits", [2048, 4000])
def test_neighbours_in_rounds_equal_brute_force(spark, monkeypatch, n_bits):
    """Each round copies a row to a fixed number of tasks as a bit for each entry, and leaves one table; tiles are smaller than blocks."""
    for name, value in (("ROUND_STEPS", 1), ("LEAST_ROWS", 9), ("TILE_ROWS", (4, 5))):
        monkeypatch.setattr(space, name, value)
    made, table = [], space.Scratch.table

    def kept(scratch, df, name):
        made.append((scratch, name, df.dtypes))
        return table(scratch, df, name)

    monkeypatch.setattr(space.Scratch, "table", kept)
    rng = np.random.default_rng(8)
    fps = {int(i): frozenset(int(b) for b in rng.choice(24 if i % 3 else n_bits, rng.integers(1, 20), replace=False)) for i in rng.permutation(90)}
    rows = [(i, sorted(bits)) for i, bits in fps.items()] + [(999, []), (998, None)]
    found = {}
    for r in space.knn_jaccard(spark.createDataFrame(rows, "mol_id bigint, fp array<int>"), 4, n_bits=n_bits).collect():
        found.setdefault(r.src, []).append((r["rank"], r.dist, r.dst))
    assert {i: [(d, j) for _, d, j in sorted(v)] for i, v in found.items()} == brute(fps, 4)
    assert ("fp", "binary") in made[0][2] and [name for _, name, _ in made].count("nearest") == 5
    assert sum("nearest" in path for path in made[0][0].paths.values()) == 1


def packed_rows(fps, n_bits, first=0):
    x = np.zeros((len(fps), n_bits), np.uint8)
    for row, bits in zip(x, fps):
        row[list(bits)] = 1
    return pd.DataFrame({"gid": range(first, first + len(fps)), "fp": [row.tobytes() for row in np.packbits(x, axis=1)]})


@pytest.mark.parametrize("tiles, seed_rows", [((16, 70), 40), ((3, 64), 7), ((128, 4096), 1024)])
def test_blocks_look_only_at_pairs_that_can_be_near(monkeypatch, tiles, seed_rows):
    """Within a block and across two: the rows of brute force, ties and rows that share nothing included; few pairs pass the counts of whole words."""
    rng = np.random.default_rng(11)
    fps = [frozenset(int(b) for b in rng.choice(500 if i % 4 else 30, rng.integers(1, 30), replace=False)) for i in range(300)] + [frozenset({400 + i}) for i in range(20)]
    fps = [fps[i] for i in rng.permutation(len(fps))]
    near = lambda rows: {i: sorted(zip(g["dist"], g["other"]))[:4] for i, g in rows.groupby("gid")}
    within = space.nearest_jaccard(packed_rows(fps, 500), None, 4, 500, tiles, seed_rows)
    want = brute(dict(enumerate(fps)), 4)
    assert near(within) == want and len(within) == 4 * len(fps)
    left, right = packed_rows(fps[:170], 500), packed_rows(fps[170:], 500, 170)
    looked, seen = [], space.Fingerprints.may_be_near
    monkeypatch.setattr(space.Fingerprints, "may_be_near", lambda *a: looked.append(seen(*a)) or looked[-1])
    parts = [space.nearest_jaccard(side, None, 4, 500, tiles, seed_rows) for side in (left, right)]
    for side, part in zip((left, right), parts):
        side["least"] = side["gid"].map(1 - part.groupby("gid")["dist"].max())
    looked.clear()
    across = space.nearest_jaccard(left, right, 4, 500, tiles, seed_rows)
    assert near(pd.concat([*parts, across])) == want
    assert sum(len(i) for i, _, _ in looked) < 0.7 * len(left) * len(right)


def test_rows_with_one_id_are_no_neighbours(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [1, 2, 3]), (2, [1, 2, 3, 4])], "mol_id bigint, fp array<int>")
    assert {(r.src, r.dst) for r in space.knn_jaccard(df, 1, n_bits=8).collect()} == {(1, 2), (2, 1)}


def test_single_row_has_no_neighbours(spark):
    df = spark.createDataFrame([(1, [3])], "mol_id bigint, fp array<int>")
    assert space.knn_jaccard(df, 3).count() == 0
