"""Mixing, url reputation, line spread, secret scan, pseudonyms."""

import hashlib
import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from poolspark.llm import line_spread, mix_sources, pseudonyms, queries, secret_scan, shingle_join, trigrams, url_reputation


def test_mix_targets_and_copies(make_docs):
    rows = [(i, "w " * (i % 7 + 1), "abc"[min(i % 5, 2)]) for i in range(600)] + [(900, None, "a"), (901, "", "b"), (902, "x y", None), (None, "x", "a"), (1, "w w", "b")]
    docs = make_docs(rows)
    got = mix_sources.plan_mix(docs).collect()
    assert len(got) == len(rows)
    size = {s: sum(r.size for r in got if r.source == s) for s in ("a", "b", "c", None)}
    target = {r.source: r.target for r in got}
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s, n in size.items():
        assert target[s] <= 2 * n
        taken = sum(r.size * r.copies for r in got if r.source == s)
        assert abs(taken - target[s]) <= max(0.15 * target[s], 4)
        assert all(0 <= r.copies <= 2 for r in got)
    free = [(target[s] / w) for s, w in zip(("a", "b", "c", None), (3, 1, 2, 3)) if target[s] < 2 * size[s]]
    assert max(free) == pytest.approx(min(free))
    copies = sorted((r.doc_id is None, r.doc_id, r.size) for r in got for _ in range(r.copies))
    emitted = mix_sources.emit(docs)
    assert emitted.columns == [*docs.columns, "copy"]
    assert sorted((r.doc_id is None, r.doc_id, len((r.text or "").split())) for r in emitted.collect()) == copies
    assert mix_sources.plan_mix(docs.limit(0)).count() == 0 and mix_sources.emit(docs.limit(0)).count() == 0
    assert sorted(map(str, mix_sources.plan_mix(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_mix_draws_rows_without_id_each_on_their_own(make_docs):
    docs = make_docs([(None, f"w{i} x y", "a") for i in range(1000)] + [(7, f"v{i} x", "b") for i in range(1000)])
    got = mix_sources.plan_mix(docs, budget=1.37).collect()
    for source in "ab":
        rows = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.copies for r in rows) - rows[0].target) <= 0.05 * rows[0].target


def test_own_names_as_columns(make_docs):
    names = ("_rate", "rate", "copy", "copy_in", "_doc", "_body", "_places", "_removed", "_fate", "_gone", "_h", "_hot", "_salt", "_r_source", "_r_doc_id", "row")
    texts = ["one two three four five six seven", "a line that stands on many sites here\nx", None, ""]
    plain = make_docs([(i, texts[i % 4], f"s{i % 6}") for i in range(40)] + [(None, "no id", "s1")])
    docs = plain.withColumns({n: F.lit(n) for n in names})
    for stage in (line_spread.drop_boilerplate, shingle_join.keep_one, mix_sources.emit, lambda d: corpus_pipeline.line_dedup(None, d, ""),
                  lambda d: corpus_pipeline._without(d, d.where("doc_id < 9").select("doc_id", F.xxhash64("text").alias("body")))):
        out = stage(docs)
        kept = [c for c in out.columns if c in names and c not in ("copy", "copy_in")]
        assert set(names) - set(kept) <= {"copy", "copy_in"} and all(r[c] == c for r in out.collect() for c in kept)
        assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, stage(plain).select("doc_id", "text").collect()))
        assert stage(docs.limit(0)).count() == 0
    assert mix_sources.emit(docs).columns[-1] == "copy" and "_copy_in" in mix_sources.emit(docs).columns


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.org/en/12?x", "x", None, "https://example.org/es/a#b", "s://q.com/de/", "s://a.b://c/d", "http://org.com", "http://example.org"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id bigint, url string, share int")
    none = spark.createDataFrame([], "page_id bigint, good int")
    got = {r.page_id: tuple(r)[1:5] for r in url_reputation.judge(pages, none, queries.URL_RULES).collect()}
    assert got[0] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/a", "example.org/es/", "block")
    assert got[4] == ("q.com", "/de/", "com/de/", "block")
    assert got[5][:2] == ("a.b:", "//c/d") and got[6][1:3] == ("", None) and got[7][1:3] == ("", None)
    assert url_reputation.judge(pages.limit(0), none, queries.URL_RULES).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    pages = [(h * 100 + i, f"http://h{h}.d{h % 3}.net/{i}") for h in range(9) for i in range(60)] + [(5000, "http://new.d1.net/"), (5001, "http://other.zz/")]
    good = [(p, 0 if p // 100 == 4 else int(p % 10 > 0)) for p, _ in pages if p < 5000] + [(1, None), (None, 1), (402, 1)]
    got = url_reputation.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(good, "page_id bigint, good int"), [])
    share = {r.host: (r.share, r.verdict) for r in got.collect()}
    assert {h for h, (_, v) in share.items() if v == "block"} == {"h4.d1.net"}
    assert 0 < share["h4.d1.net"][0] < 0.2 and share["new.d1.net"][0] < share["h0.d0.net"][0]
    assert 0.5 < share["other.zz"][0] < 0.95


def test_line_spread(make_docs):
    common, rare = "this line is on every site", "this line is on three sites"
    rows = [(i, f"own text number {i} of all\n {common}\t\n{rare if i < 3 else 'short'}\n", f"s{i}") for i in range(6)]
    rows += [(6, f"{common}\n{common}", "s0"), (7, None, "s1"), (8, "", "s2"), (9, common, None), (None, common, "s3"), (9, common, None)]
    docs = make_docs(rows)
    got = line_spread.drop_boilerplate(docs)
    assert got.columns == [*docs.columns, "n_removed"] and got.count() == len(rows)
    text = {}
    for r in got.collect():
        text.setdefault(r.doc_id, []).append((r.text, r.n_removed))
    assert text[0] == [(rows[0][1], 0)]
    assert text[1] == [(f"own text number 1 of all\n{rare}\n", 1)]
    assert text[5] == [("own text number 5 of all\nshort\n", 1)]
    assert text[6] == [("", 2)] and text[7] == [(None, 0)] and text[8] == [("", 0)] and text[9] == [("", 1)] * 2 and text[None] == [("", 1)]
    assert line_spread.drop_boilerplate(docs.limit(0)).count() == 0


def test_line_spread_near_threshold_is_exact(make_docs):
    rows = [(i * 100 + s, f"line {i} with enough letters", f"site{s}") for i, n in enumerate((38, 39, 40, 41, 60, 200)) for s in range(n)]
    got = line_spread.boilerplate(make_docs(rows), min_sites=40).count()
    assert got == 4


def test_trigram_queries():
    assert trigrams.trigram_query(r"[0-9a-f]{16,}") == []
    assert trigrams.trigram_query("AKIA[A-Z]+") == [frozenset({"aki", "kia"})]
    query = trigrams.trigram_query(r"(?:token|api_?key)\s*=")
    assert query == sorted([frozenset({"tok", "oke", "ken"}), frozenset({"api", "pik", "ike", "key"}), frozenset({"api", "pi_", "i_k", "_ke", "key"})], key=sorted)
    assert trigrams.trigram_query("a(b|c)*d") == []
    for rule in secret_scan.RULES:
        for text in filter(None, SECRETS):
            assert not re.search(rule.pattern, text) or trigrams.holds(rule.pattern, text)


SECRETS = [
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "é PassWord:'abcdefghijkl' token=short token=secret=abcdefghijkl", "AKIAABCDEFGHIJKLMN AKIAshort AKIAAKIAAKIAAKIAAK",
    "APIKEY = abc-def-ghi-jkl api_key:x", "ghp_" + "a1" * 18 + " xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35,
    "eyJhbGciOiJ.eyJzdWIiOiI.abc", "", None, "deadbeef" * 4 + "\n" + "0" * 15, "token=password\"=\"longlonglong", "nothing at all",
]


def brute_spans(text):
    out = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), k, m.end(), rule.kind))
    return sorted(out)


def test_secret_scan(make_docs):
    rows = [(i, t, "s") for i, t in enumerate(SECRETS)] + [(0, SECRETS[0], "s"), (None, SECRETS[2], "s"), (1, SECRETS[0], "z"), (77, " ".join(f"token=abcdefgh{i:06d}" for i in range(3000)), "s")]
    docs = make_docs(rows)
    got = secret_scan.digest(docs)
    assert got.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    want = []
    for i, t, _ in rows:
        spans = brute_spans(t)
        said = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        base = [s for s in spans if s[3] in secret_scan.BASE]
        want.append((i, *[sum(s[3] == k for s in spans) for k in secret_scan.BASE], hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert secret_scan.digest(docs.limit(0)).count() == 0


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(make_docs):
    rows = [
        (1, "on 2024-02-29 or 31/12/1999 or 12/31/1999, not 2023-02-30; 4111 1111 1111 1111, 123-45-6789, 255.1.2.3 x", "a"),
        (2, "4111 1111 1111 1111 again, 2024-02-29 and a.b+c@mail.example.com", "a"), (3, None, "a"), (4, "", "a"), (5, "plain words é 1.2 v3.4.5", "a"),
        (6, "4111111111111112 is no card, x4111111111111111 neither; +1 (017) 555-7713.", "a"), (None, "255.1.2.3", "a"), (7, "a" * 50000 + " 255.1.2.3 " + "9" * 50000, "a"),
    ]
    docs = make_docs(rows)
    got = pseudonyms.pseudonymise(docs, "k1")
    assert got.columns == [*docs.columns, *[f"n_{k}" for k in pseudonyms.KINDS]]
    by = {r.doc_id: r for r in got.collect()}
    m = re.fullmatch(r"on (\S+) or (\S+) or (\S+), not 2023-02-30; ([0-9 ]{19}), (\d{3}-\d\d-\d{4}), (\S+) x", by[1].text)
    assert m and m[4] != "4111 1111 1111 1111" and luhn(m[4]) and m[5] != "123-45-6789"
    assert (by[1].n_date, by[1].n_card, by[1].n_ssn, by[1].n_ip) == (3, 1, 1, 1)
    assert re.fullmatch(re.escape(m[4]) + " again, " + re.escape(m[1]) + r" and u\d{17}@mail.example.com", by[2].text)
    assert by[3].text is None and by[4].text == "" and by[5].text == rows[4][1]
    assert re.fullmatch(r"4111111111111112 is no card, x4111111111111111 neither; \+1 \(\d{3}\) \d{3}-\d{4}\.", by[6].text) and by[6].text != rows[5][1]
    assert by[None].text == m[6] and by[7].text == "a" * 50000 + f" {m[6]} " + "9" * 50000
    assert pseudonyms.pseudonymise(docs.limit(0), "k1").count() == 0
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, "k2").collect()}
    assert other[1] != by[1].text
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(docs, "k'1")


def test_pseudonyms_are_permutations(spark, make_docs):
    days = [f"{y}-{m:02d}-{d:02d}" for y in range(1990, 2000) for m in range(1, 13) for d in range(1, 29)]
    rows = [(i, d, "a") for i, d in enumerate(days)] + [(10**6 + i, f"10.0.{i // 256}.{i % 256}", "a") for i in range(3000)] + [(2 * 10**6 + i, f"123-45-{i:04d}", "a") for i in range(1, 3000)]
    out = [r.text for r in pseudonyms.pseudonymise(make_docs(rows), "k").collect()]
    assert len(set(out)) == len(rows)
    assert all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", t) for t in out[:len(days)])
