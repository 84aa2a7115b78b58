"""Fill-in-middle, Merkle manifest and PPM scores against plain Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolspark.llm import fill_middle, merkle, ppm


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill in middle ------------------------------------------------------------------------------------------------

TEXTS = ["", None, "one line", "a\nb\nc", "a\nb\nc\n", "\n\n\n", "žluťoučký\nkůň 🐎\núpěl\n日本語", "x<P>y\nz", "<S>", "<M>\n", "<\nP>\nS>\n<<", "ascii only\n" * 400 + "é",
         "🐎" * 3000 + "\n" + "日\n" * 500, "tail\r\nwith cr\r\n", "ü"]


def cut_plainly(doc_id, text, unit, rate=100, spm=50):
    text = text or ""
    units = re.findall(unit, text)
    n = len(units)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


@pytest.mark.parametrize("units, unit, rate", [("lines", r"[^\n]*\n|[^\n]+", 100), ("chars", r"(?s).", 100), ("lines", r"[^\n]*\n|[^\n]+", 40)])
def test_fill_middle_like_plain_python(make_docs, units, unit, rate):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS * 5)] + [(None, "no\nid\n", "s"), (3, "again\nanother\ntext", "s"), (3, "again\nanother\ntext", "s")]
    docs = make_docs(rows).withColumn("form", F.lit(1)).withColumn("output", F.lit(2)).withColumn("h1", F.lit(3))
    got = fill_middle.transform(docs, units=units, rate=rate)
    want = [cut_plainly(i, t, unit, rate) for i, t, _ in rows]
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    back = got.select("doc_id", fill_middle.restore(F.col("output"), F.col("form")).alias("text"))
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, _ in rows)


def test_fill_middle_edges(make_docs):
    assert fill_middle.transform(make_docs([(1, "a", "s")]).limit(0)).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "a", "b"), ("<P>", "x<P>", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.check_sentinels(bad)
    with pytest.raises(ValueError):
        fill_middle.transform(make_docs([(1, "a", "s")]), units="words")


def test_exception_index_turns_bytes_and_points_round():
    draw = random.Random(3)
    for _ in range(50):
        texts = ["".join(draw.choice("ab\né日🐎") for _ in range(draw.randrange(0, 30))) for _ in range(4)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        index, zero = fill_middle.Exceptions.of(data), 0
        assert len(index.at) == sum(ord(c) > 127 for t in texts for c in t)
        for t in texts:
            for k in range(len(t) + 1):
                byte = zero + len(t[:k].encode())
                assert index.chars(np.array([byte]), np.array([zero]))[0] == k
                assert index.bytes(np.array([k]), np.array([zero]))[0] == byte
            zero += len(t.encode())


# Merkle manifest -----------------------------------------------------------------------------------------------


def leaf_of(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
        out.append([level[k] for k in run if k != i])
        i //= 3
    return out


def folded(digest, levels, i):
    for level in levels[:-1]:
        run = list(level[i // 3 * 3:i // 3 * 3 + 3])
        run[i % 3] = digest
        digest, i = sha("".join(run)), i // 3
    return digest


def prove_plainly(rows, alter):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in order:
        members[s] = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), leaf_of(r, alter(r))) for r in by_source[s]))
        trees[s] = tree([m[2] for m in members[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, (known, doc_id, leaf, changed) in enumerate(members[s]):
            root = folded(folded(changed, trees[s], i), top, g)
            out.append((doc_id if known else None, leaf, trees[s][-1][0], top[-1][0], siblings(trees[s], i) + siblings(top, g), root, root == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 4, "": 3, "b": 1, "é": 2, "Z": 10}, {"big": 1600, "mid": 730, "edge": 729, None: 28}, {f"host{k:04}": 1 + k % 3 for k in range(800)}])
def test_manifest_like_plain_python(make_docs, sizes):
    rows = [(1000 * g + k, f"text {k}\nof {s}\n" if k % 5 else None, s) for g, (s, n) in enumerate(sizes.items()) for k in range(n)]
    if "b" in sizes:
        rows += [(7, "same\n", "b"), (7, "same\n", "b"), (7, "other", "b"), (None, "no id\n", "b"), (None, "", "b")]
    docs = make_docs(rows).withColumns({c: F.lit(1) for c in ("rank", "block", "leaf", "_part", "path")})
    changed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    alter = lambda r: r["text"].replace("\n", "") if r["text"] and r["doc_id"] is not None and r["doc_id"] % 2 == 0 else r["text"]
    proofs = merkle.prove(merkle.build(docs, changed))
    want = prove_plainly([r.asDict() for r in docs.collect()], alter)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.siblings, r.folded_root, r.verified) for r in proofs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[-1] for r in got) or len(got) == 1


def test_manifest_requests_and_empty_table(make_docs, spark):
    docs = make_docs([(k, f"t{k}", f"s{k % 3}") for k in range(50)])
    manifest = merkle.build(docs)
    some = merkle.prove(manifest, spark.createDataFrame([(3,), (4,), (4,), (99,), (None,)], "doc_id bigint")).collect()
    assert sorted(r.doc_id for r in some) == [3, 4] and all(r.verified and r.root == manifest.root for r in some)
    assert merkle.build(docs.repartition(7)).root == manifest.root
    assert merkle.build(docs.where("doc_id <> 9")).root != manifest.root
    empty = merkle.build(docs.limit(0))
    assert empty.root is None and merkle.prove(empty).count() == 0


# prediction by partial matching ----------------------------------------------------------------------------------


class PlainPPM:
    """A trie of dicts and the usual walk from the longest context down, with a set of excluded symbols."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(lambda: defaultdict(int))
        for t in texts:
            for context, symbol in self.steps(t):
                for k in range(order + 1):
                    self.seen[context[order - k:]][symbol] += 1

    def steps(self, text):
        symbols = [256] * self.order + list((text or "").encode()) + [256]
        for k in range(self.order, len(symbols)):
            yield tuple(symbols[k - self.order:k]), symbols[k]

    def p(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            node = self.seen.get(context[self.order - k:])
            if not node:
                continue
            left = {s: n for s, n in node.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out * left[symbol] / total
            if total:
                out *= len(left) / total
            excluded |= set(node)
        return out / (257 - len(excluded))

    def score(self, text):
        return sum(math.log10(self.p(c, s)) for c, s in self.steps(text))


@pytest.mark.parametrize("order, hot", [(2, 1 << 20), (5, 1 << 20), (5, 300), (3, 0)])
def test_scores_like_a_plain_trie(make_docs, order, hot):
    draw = random.Random(5)
    vocabulary = ["The", "the", "cat", "sat", "on", "a", "mat", "kůň", "日本", "x" * 40, "🐎!"]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 40))) + draw.choice(["", "\n", "  "]) for _ in range(60)]
    texts += [None, "", "\x0b \t", "unseen Zeichen ÄÖ \x00", texts[0], "the cat " * 500]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "the cat", "s"), (3, "a mat", "s"), (3, "a mat", "s")]
    docs = make_docs(rows).withColumns({c: F.lit(1) for c in ("score", "kind", "key", "rest", "_row", "n")})
    got = ppm.score(docs, F.col("doc_id") % 4 != 2, order, hot)
    train = [t for i, t, _ in rows if i is None or i % 4 != 2]
    model = PlainPPM(train, order)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    counts = defaultdict(int)
    for t in train:
        for w in tokens(t):
            counts[w] += 1
    total = sum(counts.values())
    want = [(i, len(tokens(t)), sum(w in counts for w in tokens(t)), total,
             sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens(t)), model.score(t)) for i, t, _ in rows]
    key = lambda r: (str(r[0]), r[1], round(r[5], 6))
    for mine, plain in zip(sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key), strict=True):
        assert mine[:4] == plain[:4] and mine[4:] == pytest.approx(plain[4:], rel=1e-9)


def test_probabilities_of_a_context_add_up(make_docs, spark):
    texts = ["abracadabra", "banana", "", "cabbage bag"]
    counts = ppm.count_keys(make_docs([(i, t, "s") for i, t in enumerate(texts)]), F.lit(True), 2)
    seen = {r.key: r.n for r in counts.where("kind = 0").collect()}
    for context in {k >> ppm.BITS for k in seen}:
        asked = [(context << ppm.BITS | s, seen.get(context << ppm.BITS | s, 0), 1) for s in range(ppm.SYMBOLS)]
        # all edges of the context are asked for beside those that were counted
        every = spark.createDataFrame([*asked, *[(k, n, 1) for k, n in seen.items() if k >> ppm.BITS != context]], "key bigint, n bigint, seen bigint")
        got = [r.p for r in ppm.resolve(every, 2).collect() if r.key >> ppm.BITS == context]
        assert sum(got) == pytest.approx(1.0)
        break


def test_ppm_empty_and_untrained(make_docs):
    docs = make_docs([(1, "ab", "s"), (2, None, "s")])
    assert ppm.score(docs.limit(0), F.lit(True)).count() == 0
    got = {r.doc_id: r for r in ppm.score(docs, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(3 * math.log10(1 / 257)) and got[2].score == pytest.approx(math.log10(1 / 257))
    assert got[1].n_tokens == 2 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0.0
    assert set(ppm.score(docs.limit(0), F.lit(True)).columns) == set(ppm.score(docs, F.lit(True)).columns)


def test_longer_contexts_tell_more_about_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    cost = {k: ppm.score(docs, ~held_out, k).where(held_out).agg(-F.sum("score"), -F.sum("base_score")).first() for k in (1, 5)}
    assert cost[5][0] < 0.75 * cost[1][0] and cost[5][0] < 1.1 * cost[5][1]
