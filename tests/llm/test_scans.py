"""Toxic spans, license scan, template leaks, word arrays: against plain Python."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from poolspark.llm import license_scan, template_leaks, toxic_spans
from poolspark.llm import words as W

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = ["", None, "One", "A b  c\td\n", "é È x y", "  lead", "a" * 3000 + " b", "x.y,z 3.5", "\n\n", "tail \x0b\x0c"]


def test_words_match_regular_expressions():
    for size in (4, 1 << 20):
        got = []
        for _, data, offset in W.pieces(pa.array(TEXTS), size):
            w = W.words(data, offset)
            got += [[bytes(w.lower[w.start[i]:w.end[i]]).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(w.rows)]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in TEXTS]
    got = license_scan.split_words("ÀB c-d1 é—f")
    assert got == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ÀB c-d1 é—f".translate(LOWER))


def test_hashes_do_not_depend_on_place():
    a = next(W.pieces(pa.array(["one two", "zwei Two"])))
    w = W.words(a[1], a[2])
    h = W.hashes(w)
    assert h[1] == h[3] == W.word_hash("two") and len(set(h.tolist())) == 3
    key, row, at = W.windows(w, h, 2, short=True)
    assert row.tolist() == [0, 1] and at.tolist() == [0, 2]
    assert len(W.windows(w, h, 3)[0]) == 0 and len(W.windows(w, h, 3, short=True)[0]) == 2


WANTED = [(set(license_scan.split_words(t)), label) for t, label in license_scan.TEMPLATES]


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = sorted((i, label) for p, label in license_scan.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    labels, best = {x for _, x in base}, 0.0
    for line in (text or "").split("\n"):
        have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.translate(LOWER)))
        for want, label in WANTED:
            share = len(want & have) / len(want)
            if share >= 0.8 - 1e-12:
                labels.add(label)
                best = max(best, share)
    join = lambda s: ",".join(sorted(s))
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, join({x for _, x in base}), join(labels), 1.0 if base else best)


def test_license_scan(make_docs):
    texts = [None, "", "Licensed under the\nApache License, Version 2.0.", "x\nLicensed under the Apache License, Version 2.0.\nCC-BY cc by MIT license mit License",
             "This work is licensed under the GNU General Public License, version 3", "licensed the under apache version 2 0 and more words", "éapache license apache license",
             "Permission is granted free of charge to any person obtaining a copy of this software", "gnu general public\nlicense", "word " * 20000 + "Released under the MIT License " + "x " * 20000,
             "permission permission permission", "Licensed under CC BY-NC 4.0"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, texts[4], "s")]
    docs = make_docs(rows)
    got = license_scan.scan(docs).collect()
    assert sorted(map(str, [tuple(r)[:8] for r in got])) == sorted(map(str, [(i, *brute_license(t)) for i, t, _ in rows]))
    span = next(r for r in got if r.doc_id == 4).spans[0]
    assert (span.label, span.first, span.last) == ("gpl-3.0", 0, 11)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_scan_on_driver_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in license_scan.scan(docs).collect():
        assert tuple(r)[1:8] == brute_license(text[r.doc_id])


def brute_canonical(text):
    """(canonical word, slot value or None) of every word."""
    out = []
    for m in re.finditer(r"(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|(?<=[0-9])[.,](?=[0-9]))+", text or ""):
        raw, low = m.group(), m.group().translate(LOWER)
        before = re.sub(r"[ \t\r\x0b\x0c\"'(-]+$", "", text[:m.start()])
        begins = not before or before[-1] in ".!?:;\n"
        if raw[0] in "0123456789" or low in template_leaks.NUMBER_WORDS:
            out.append(("<num>", low))
        elif low in template_leaks.UNITS:
            out.append(("<unit>", low))
        elif "A" <= raw[0] <= "Z" and not begins:
            out.append(("<name>", low))
        else:
            out.append((low, None))
    return out


def brute_leaks(docs, items, size=8, share=0.5):
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = brute_canonical(item), brute_canonical(text)
        width = size if len(a) >= size else len(a)
        if width < 4:
            continue
        usable = [p for p in range(len(a) - width + 1) if 2 * sum(s is not None for _, s in a[p:p + width]) <= width]
        shifts = {}
        for p in usable:
            for q in range(len(b) - width + 1):
                if [x for x, _ in a[p:p + width]] == [x for x, _ in b[q:q + width]]:
                    shifts.setdefault(q - p, []).append(p)
        best = None
        for shift, at in shifts.items():
            pairs = {(a[p + k][1], b[p + shift + k][1]) for p in at for k in range(width) if a[p + k][1] is not None}
            if len(at) >= share * len(usable) and len({x for x, _ in pairs}) == len(pairs):
                kind = "exact" if all(x == y for x, y in pairs) else "parameters"
                best = max(best or (0,), (len(at) / len(usable), kind == "exact", -shift, min(at), max(at) + width - 1))
        if best:
            out.add((d, i, "exact" if best[1] else "parameters", round(best[0], 9), best[3] - best[2], best[4] - best[2]))
    return out


ITEMS = [
    (1, "A train leaves Boston at 40 miles per hour and another leaves Denver at 60 miles per hour toward Boston. How far apart are they?"),
    (2, "Tom has 3 apples and buys 2.5 kg more from Anna in the small shop near the river. How many apples has Tom now?"),
    (3, "one short item of six"), (4, "too few"), (5, None), (6, ""), (7, "same value 5 then again 5 in this question with some words around it"),
]


def test_template_leaks(spark, make_docs):
    texts = [
        "Before it all. " + ITEMS[0][1] + " After.", "x y. A train leaves Paris at 55 miles per hour and another leaves Rome at 90 miles per hour toward Paris. How far apart are they?",
        "x. A train leaves Paris at 55 miles per hour and another leaves Rome at 90 miles per hour toward London. How far apart are they?", None, "",
        "He said: Tom has 30 apples and buys 1,200 km more from Lisa in the small shop near the river. How many apples has Tom now?", "so one short item of six words", "too few", "plain text about nothing at all, in many words",
        "same value 6 then again 7 in this question with some words around it", "same value 8 then again 8 in this question with some words around it", ("filler " * 5000) + ITEMS[1][1] + " " + ITEMS[1][1],
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[0], "s")]
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS] + [(1, ITEMS[0][1], 1)], "item_id bigint, text string, total int")
    docs = make_docs(rows)
    got = template_leaks.leaks(docs, items)
    found = sorted(map(str, [(r.doc_id, r.item_id, r.kind, round(r.coverage, 9), r.first_word, r.last_word) for r in got.collect()]))
    assert found == sorted(map(str, brute_leaks(dict((r[:2] for r in rows)).items(), ITEMS)))
    kinds = {(r.doc_id, r.item_id): r.kind for r in got.collect()}
    assert kinds[(1, 1)] == "parameters" and kinds[(0, 1)] == "exact" and (9, 7) not in kinds and kinds[(10, 7)] == "parameters" and kinds[(6, 3)] == "exact"
    assert template_leaks.leaks(docs.limit(0), items).count() == 0 and template_leaks.leaks(docs, items.limit(0)).count() == 0


def test_every_leak(spark, make_docs):
    train, tom = ITEMS[0][1], ITEMS[1][1]
    texts = [
        tom.replace("Anna", "Mary Ann"), train.replace("Boston", "New York").replace("40", "twenty-five"), "x. " + train.lower(), train.upper(),
        tom.replace("the small shop", "the very small shop"), tom.replace("small ", ""), train.replace("Boston", "New York").replace("toward New York", "toward London"),
        "plain text about nothing at all, in many words", None, tom, "y. " + tom[:40],
    ]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[0], "s"), (0, texts[0], "s")])
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id bigint, text string")
    got = template_leaks.every_leak(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 2), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (9, 2), (None, 2)} and len(got) == 8
    row = {r.doc_id: r for r in got}
    assert row[1].kind == "parameters" and row[2].kind == row[3].kind == "exact" and (row[2].first_word, row[2].last_word) == (1, 25)
    assert {r.doc_id for r in template_leaks.leaks(docs, items).collect()} <= set(row) - {0, 1}
    assert template_leaks.every_leak(docs.limit(0), items).count() == 0 and template_leaks.every_leak(docs, items.limit(0)).count() == 0


def test_template_leaks_on_driver_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    got = {(r.doc_id, r.item_id, r.kind, round(r.coverage, 9), r.first_word, r.last_word) for r in template_leaks.leaks(read("documents"), read("benchmark")).collect()}
    pairs = lambda t, k: [(r[0], r[1]) for r in read(t).select(k, "text").collect()]
    items = pairs("benchmark", "item_id")
    # texts that hold a piece of an item, found by plain search
    near = [(d, t) for d, t in pairs("documents", "doc_id") if any(i[k:k + 30] in (t or "") for _, i in items for k in (0, 20, 40))]
    assert near and got == {x for d, t in near for x in brute_leaks([(d, t)], [(k, i) for k, i in items if any(i[p:p + 30] in t for p in (0, 20, 40))])}


def test_chain_against_enumeration():
    rng = np.random.default_rng(3)
    first = np.array([0, 5, 5, 6, 12])
    odds, move = np.exp(rng.normal(size=12)), (1.0, 0.4, 0.7, 2.0)
    p = toxic_spans.chain(odds, first, move, 2)[2]
    for a, b in zip(first[:-1], first[1:]):
        total, on = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            weight = math.prod(odds[a + k] for k in range(b - a) if y[k]) * math.prod(move[2 * y[k] + y[k + 1]] for k in range(b - a - 1))
            total += weight
            on += weight * np.array(y)
        assert p[a:b] == pytest.approx(on / total)


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_on_held_out_labels(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    scored = {r.doc_id: r for r in toxic_spans.score(docs, toxic_spans.train(docs, labels)).collect()}
    learned = {r.doc_id for r in toxic_spans.training_rows(labels).collect()}
    held = [(scored[r.doc_id].score, r.toxic) for r in labels.collect() if r.doc_id not in learned]
    assert len(held) > 80 and auc(*zip(*held)) > 0.75
    sure = [y for s, y in held if s >= 0.7]
    assert len(sure) >= 8 and np.mean(sure) > 0.9
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    spans = [text[d][s.start:s.end] for d, r in scored.items() for s in r.spans]
    assert spans and all(re.fullmatch(r"\w.*\w", s, re.S) for s in spans)


def test_toxicity_odd_rows(spark, make_docs):
    bad, good = "é you are a vile person", "é you are a kind person"
    rows = [(i, (bad if i % 2 else good) + f" number {i}", "s") for i in range(200)] + [(900, None, "s"), (901, "", "s"), (902, "so vile " * 3000, "s"), (None, bad, "s"), (903, good, "s"), (903, good, "s")]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (901, None, 0), (3, 0, 0)], "doc_id bigint, toxic int, score int")
    model = toxic_spans.train(docs, labels)
    got = toxic_spans.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].score > 0.9 and by[903].score < 0.1 and by[900].score == by[901].score < 0.5
    assert by[None].spans[0].start == bad.index("vile") and by[None].spans[0].end == bad.index("vile") + 4 and by[902].score > 0.9
    none = toxic_spans.train(docs, labels.where("toxic = 0"))
    assert {round(r.score, 9) for r in toxic_spans.score(docs, none).collect()} == {round(none.prior, 9)}
    assert toxic_spans.score(docs.limit(0), model).count() == 0
    toxic_spans.train(docs.limit(0), labels)
    toxic_spans.train(docs, labels.limit(0))
