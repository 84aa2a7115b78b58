"""Shingle join, sorted passes, components and the pipeline: against plain Python."""

import re

import numpy as np
import pytest

import corpus_pipeline
from poolspark.llm import graph, joins, line_spread, mix_sources, shingle_join, sorted_passes, template_leaks, toxic_spans
from poolspark.llm.joins import join_narrow, shared_table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 300)] + [(5, 5)]
    edges = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    want = {n: r for n, r in roots({x for p in links for x in p}, links).items() if any(n in p and p[0] != p[1] for p in links)}
    got = graph.components(edges).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert graph.components(edges.limit(0)).count() == 0


def test_narrow_join_is_the_same_every_way(spark, monkeypatch):
    from pyspark.sql import functions as F

    left = spark.createDataFrame([(i, i % 5 if i % 7 else None, "l") for i in range(200)], "id bigint, k int, v string")
    right = shared_table(spark.createDataFrame([(k, f"r{k}", 1) for k in (0, 1, 2, 9, None)], "k int, name string, _x int"), "r")
    for how in ("inner", "left"):
        ways = []
        for rows, hot in ((100, 0), (2, 30), (2, 10**6)):  # broadcast, some keys hot, none
            monkeypatch.setattr(joins, "HOT_ROWS", hot)
            ways.append(sorted(map(str, join_narrow(left, right, ["k"], F.col("id"), how, rows).collect())))
        small = ways[0]
        assert ways[1] == ways[2] == small and len(small) == (200 if how == "left" else len([1 for i in range(200) if (i % 5 if i % 7 else None) in (0, 1, 2, None)]))


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_join(rows, num, den, size):
    sets = {i: shingles(t, size) for i, t, _ in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(ids, links).items()}


def family(rng, start, count, length, edits):
    """Texts derived one from another and from a common root."""
    base = [f"w{x}" for x in rng.integers(0, 3000, length)]
    rows, now = [], list(base)
    for i in range(count):
        now = list(base) if i % 3 else list(now)
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            now[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((start + i, " ".join(now), "s"))
    return rows


@pytest.mark.parametrize(("num", "den", "size"), [(85, 100, 4), (4, 5, 5)])
def test_shingle_join(make_docs, num, den, size, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 7)
    rng = np.random.default_rng(num)
    rows = [r for n, (count, length, edits) in enumerate([(40, 60, 2), (30, 200, 6), (25, 12, 1), (20, 700, 14), (15, 30, 3)]) for r in family(rng, 1000 * n, count, length, edits)]
    copies = [(9000 + i, rows[3][1], "s") for i in range(50)]
    odd = [(9500, None, "s"), (9501, "", "s"), (9502, " \n\t", "s"), (9503, "one", "s"), (9504, "ONE", "s"), (9505, "a b c", "s"), (9506, "a b\tC ", "s"), (9507, "a b c d", "s"), (9508, "d c b a", "s"),
           (9509, "z " * 30000, "s"), (9510, " ".join(f"v{i}" for i in range(30000)), "s"), (9511, " ".join(f"v{i}" for i in range(29000)), "s")]
    rows = rows + copies + odd
    docs = make_docs([*rows, rows[0]])
    got = shingle_join.near_duplicates(docs, num, den, size).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows, num, den, size)
    kept = shingle_join.keep_one(docs, num, den, size)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute_join(rows, num, den, size).items() if i == c}


def test_shingle_join_odd_tables(make_docs):
    docs = make_docs([(None, "a b c d e", "s"), (None, "x y", "s"), (3, "a b c d e", "s"), (1, None, "s")])
    got = sorted(map(str, map(tuple, shingle_join.near_duplicates(docs).collect())))
    assert got == sorted(map(str, [(None, 2, 3), (None, 1, None), (3, 2, 3), (1, 0, 1)]))
    assert shingle_join.near_duplicates(docs.limit(0)).count() == 0 and shingle_join.near_duplicates(docs.where("doc_id = 1")).count() == 1


def test_keep_one_with_null_and_repeated_ids(make_docs):
    text = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(9)]
    rows = [(7, text[0], "s"), (None, text[0], "s"), (None, text[1], "s"), (None, text[2], "t"),  # one row without doc_id is a copy
            (3, text[3], "s"), (20, text[3], "s"), (20, text[4], "s"),  # one text of 20 is a copy
            (9, text[5], "s"), (9, text[5], "s"), (9, text[5], "t"), (9, text[6], "s"),  # copies that repeat the doc_id, and another text
            (None, text[7], "s"), (None, text[7] + " more", "s"), (None, text[7], "s"),  # a group without doc_id
            (30, None, "s"), (30, None, "s"), (None, None, "s"), (30, " ", "s")]
    docs = make_docs(rows)
    kept = shingle_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    group = [g for g in got if g[1] and g[1].startswith(text[7])]
    assert len(group) == 1
    want = [(7, text[0]), (None, text[1]), (None, text[2]), (3, text[3]), (20, text[4]), (9, text[5]), (9, text[6]), (30, None), (30, None), (None, None), (30, " ")]
    assert sorted(map(str, got)) == sorted(map(str, want + group))


def test_tiles_lose_no_pair():
    """Sets at the threshold meet in a tile, whatever their sizes."""
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (4, 5)):
        table = shingle_join.bands(num, den, 4000)
        lows = [b[0] for b in table]
        for _ in range(1500):
            n = int(rng.integers(1, 1500))
            m = int(rng.integers(-(-n * num // den), n + 1))
            need = -(-num * (n + m) // (num + den))
            if need > m:
                continue
            pool = rng.integers(0, 2**63, n + m - need).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:need], pool[n:]]))
            if len(a) == n and len(b) == m and (n != need or m != need):
                assert set(shingle_join.tiles_of(a, num, den, table, lows).tolist()) & set(shingle_join.tiles_of(b, num, den, table, lows).tolist())


def test_unlike_sets_share_no_tile():
    """Sets without a common element are not gathered in a tile of their band, at any place of the band."""
    rng = np.random.default_rng(6)
    for num, den in ((85, 100), (4, 5)):
        table = shingle_join.bands(num, den)
        lows = [b[0] for b in table]
        for n in (30, 110, 380, 400, 474, 600, 1500, 2000):
            met = {}
            for _ in range(200):
                for key in set(shingle_join.tiles_of(np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)), num, den, table, lows).tolist()):
                    met[key] = met.get(key, 0) + 1
            assert max(met.values()) <= 3, (num, den, n)


def brute_vectors(rows, least):
    fit = {}
    for i, x, label in rows:
        if label is None or x is None or not len(x) or any(v is None or not np.isfinite(v) for v in x) or not any(x):
            fit[i] = None
        else:
            fit[i] = (label, np.array(x, float) / np.linalg.norm(np.array(x, float)))
    ids = sorted(fit)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if fit[a] and fit[b] and fit[a][0] == fit[b][0] and len(fit[a][1]) == len(fit[b][1]) and fit[a][1] @ fit[b][1] >= least]
    count = {i: 0 for i in ids}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    up = roots(ids, links)
    return {i: (count[i], up[i], up[i] == i) for i in ids}


def test_sorted_passes(spark, monkeypatch):
    monkeypatch.setattr(sorted_passes, "TILE", 30)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(300)]
    centre = rng.normal(size=16)
    rows += [(1000 + i, (centre + 0.06 * rng.normal(size=16)).tolist(), 1) for i in range(150)]  # more than a window
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(80)] + [(2100, rows[7][1], 99), (2101, [2 * v for v in rows[7][1]], rows[7][2])]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] * 16, 1), (3004, [1.0] * 4, 1), (3005, [1.0] * 4, 1), (3006, [], 1), (3007, [1.0] * 16, None), (3008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, 5) for r in [*rows, rows[0]]], "vec_id bigint, embedding array<float>, label int, n int")
    exact = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = sorted_passes.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(exact, 0.98)
    assert sorted_passes.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == (columns if name != "mixing" else [*columns, "copy"])
        before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
        if name == "toxicity":
            model = toxic_spans.train(docs, read("labels"))
            assert set(after) == {r.doc_id for r in toxic_spans.score(docs, model).collect() if r.score < 0.7}
        elif name == "line_dedup":
            assert set(after) == set(before)
            assert {d: r.text for d, r in after.items()} == {r.doc_id: r.text for r in line_spread.drop_boilerplate(docs).collect()}
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
        elif name == "near_duplicates":
            want = brute_join([(d, r.text, "s") for d, r in before.items()], 4, 5, 5)
            assert set(after) == {d for d, (_, c) in want.items() if d == c}
        elif name == "decontamination":
            assert set(before) - set(after) == {r.doc_id for r in template_leaks.leaks(docs, read("benchmark")).collect()}
        else:
            plan = {r.doc_id: r.copies for r in mix_sources.plan_mix(docs).collect()}
            assert out.count() == sum(plan.values()) and set(after) == {d for d, n in plan.items() if n}
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))
