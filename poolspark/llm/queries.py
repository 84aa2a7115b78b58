"""Registered queries of the operators over the driver tables, with SQL oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import fill_middle, license_scan, line_spread, merkle, mix_sources, ppm, pseudonyms, secret_scan, shingle_join, sorted_passes, template_leaks, toxic_spans, url_reputation

#: The rules of the url query, (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Production takes the key from a secret store; this one serves the tests.
PII_KEY = "poolsparktestkey"


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_shingle_join(spark, sf_dir):
    return shingle_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_mix_sources(spark, sf_dir):
    plan = mix_sources.plan_mix(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_url_reputation(spark, sf_dir):
    """The number in a page's path is the document it shows; that document's quality label is the page's outcome."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("page_id", F.regexp_extract("url", r"://[^/?#]*/[a-z]{2}/([0-9]{1,18})", 1).try_cast("bigint").alias("doc_id"))
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    outcomes = shown.where("doc_id is not null").join(labels, "doc_id").select("page_id", "good")
    return url_reputation.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_line_spread(spark, sf_dir):
    out = line_spread.drop_boilerplate(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_removed")


def op5_toxic_spans(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxic_spans.score(docs, toxic_spans.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         F.to_json("spans").alias("spans"))


def op6_license_scan(spark, sf_dir):
    return license_scan.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op7_secret_scan(spark, sf_dir):
    return secret_scan.digest(_read(spark, sf_dir, "documents"))


def op8_sorted_passes(spark, sf_dir):
    return sorted_passes.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_template_leaks(spark, sf_dir):
    found = template_leaks.every_leak(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "kind", "coverage", "first_word", "last_word")


def op11_fill_middle(spark, sf_dir):
    cut = fill_middle.transform(_read(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_merkle_manifest(spark, sf_dir):
    """Every leaf is requested; where 2 divides the crc32 of doc_id, the text is tampered with."""
    text = F.col("text")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    proofs = merkle.prove(merkle.build(_read(spark, sf_dir, "documents"), altered))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.flatten("siblings"), ""), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_ppm_score(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = ppm.score(_read(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_shingle_join, op2_mix_sources, op3_url_reputation, op4_line_spread, op5_toxic_spans, op6_license_scan, op7_secret_scan, op8_sorted_passes, op9_pseudonyms, op10_template_leaks,
                                  op11_fill_middle, op12_merkle_manifest, op13_ppm_score)}
QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

SQL["op1_shingle_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v),
k AS (SELECT v, min(m) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.v = d.doc_id
"""

SQL["op2_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS body, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, 2.0::DOUBLE * n AS top,
  [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, coalesce(sum(top) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest, sum(n) OVER () * 1.5::DOUBLE AS whole
  FROM w WINDOW before AS (ORDER BY top / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT min_by((whole - capped) / rest, top / weight) AS unit FROM o WHERE weight * ((whole - capped) / rest) < top),
t AS (SELECT source, n, least(top, weight * unit) AS target FROM w, u),
r AS (SELECT d.doc_id, d.size, t.n AS source_size, t.target, CASE WHEN t.n > 0 THEN t.target / t.n ELSE 0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.body), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM r
"""

SQL["op4_line_spread"] = r"""
WITH l AS (SELECT doc_id, source, i, line, trim(line, E' \t\r\v\f') AS t FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
b AS (SELECT t, min(struct_pack(d := doc_id, i := i)) AS keep FROM l WHERE length(t) >= 16 GROUP BY t HAVING count(DISTINCT source) >= 4),
m AS (SELECT l.*, b.keep IS NOT NULL AND b.keep <> struct_pack(d := l.doc_id, i := l.i) AS gone FROM l LEFT JOIN b ON l.t = b.t)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE NOT m.gone), '') END AS text,
  count(*) FILTER (WHERE m.gone)::BIGINT AS n_removed
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text
"""

SQL["op3_url_reputation"] = r"""
WITH u AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  try_cast(regexp_extract(url, '://[^/?#]*/[a-z]{2}/([0-9]{1,18})', 1) AS BIGINT) AS shown FROM u),
o AS (SELECT p.page_id, min(quality) AS good FROM p JOIN labels l ON l.doc_id = p.shown GROUP BY p.page_id),
h AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
  list_last(string_split(host, '.')) AS suffix FROM p LEFT JOIN o USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
g AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS mean FROM s),
v AS (SELECT 1 AS lv, n, good FROM h UNION ALL SELECT 2, n, good FROM d UNION ALL SELECT 3, n, good FROM s),
m AS (SELECT lv, count(*) AS k, sum(n) AS nn, sum(n * n)::DOUBLE AS sq, sum(n * (good / n - mean) ** 2) AS sp, any_value(mean * (1 - mean)) AS noise FROM v, g WHERE n > 0 GROUP BY lv),
r AS (SELECT lv, least(0.99, greatest(0.001, CASE WHEN nn - sq / nn - (k - 1) > 0 THEN (sp / noise - (k - 1)) / (nn - sq / nn - (k - 1)) ELSE 0.1 END)) AS r, k, noise FROM m),
c AS (SELECT lv, CASE WHEN k < 2 OR noise <= 0 THEN 10.0 ELSE (1 - r) / r END AS c FROM r),
c1 AS (SELECT coalesce(max(c) FILTER (WHERE lv = 1), 10.0) AS a, coalesce(max(c) FILTER (WHERE lv = 2), 10.0) AS b, coalesce(max(c) FILTER (WHERE lv = 3), 10.0) AS e FROM c),
s2 AS (SELECT suffix, (good + e * mean) / (n + e) AS ps FROM s, g, c1),
d2 AS (SELECT domain, (good + b * ps) / (n + b) AS pd FROM d JOIN s2 USING (suffix), c1),
h2 AS (SELECT host, n, a, (good + a * pd) / (n + a) AS ph FROM h JOIN d2 USING (domain), c1),
j AS (SELECT p.*, CASE WHEN least(1.0, ph + 1.645 * sqrt(ph * (1 - ph) / (n + a + 1))) < 0.6 THEN 'block' ELSE 'allow' END AS own,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM p JOIN h2 USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE own END AS verdict FROM j
"""


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in license_scan.PHRASES)
    wanted = ", ".join(f"({k}, '{label}', '{x}', {len(set(license_scan.split_words(t)))})"
                       for k, (t, label) in enumerate(license_scan.TEMPLATES) for x in sorted(set(license_scan.split_words(t))))
    return f"""
WITH p(seq, label) AS (VALUES {phrases}), t(k, label, x, size) AS (VALUES {wanted}),
w AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), p WHERE w[i:i + len(seq) - 1] = seq),
l AS (SELECT doc_id, i, unnest(list_distinct(regexp_extract_all({_LOWER.format('line')}, '{_ALNUM}'))) AS x
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, i, k, any_value(label) AS label, count(*)::DOUBLE / any_value(size) AS share FROM l JOIN t USING (x) GROUP BY doc_id, i, k HAVING count(*) >= 0.8 * any_value(size)),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM b GROUP BY doc_id),
own AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)"""


SQL["op6_license_scan"] = _license_sql()


def _leak_sql() -> str:
    """Words and the gaps before them give canonical words; windows are joined as lists."""
    word = r"(?:[0-9]+(?:[.,][0-9]+)*|[^\x00-\x40\x5B-\x60\x7B-\x7F]+)+"
    listed = lambda words: "[" + ", ".join(f"'{x}'" for x in words) + "]"
    size = 8

    def canonical(table: str, key: str) -> str:
        return f"""
{table}_w AS (SELECT DISTINCT {key} AS id, text, regexp_extract_all(text, '{word}') AS w, string_split_regex(text, '{word}') AS g FROM {'documents' if key == 'doc_id' else 'benchmark'} WHERE text IS NOT NULL),
{table}_k AS (SELECT id, i, {_LOWER.format('w[i]')} AS low, w[i] AS raw, regexp_replace(g[i], '[ \t\v\f\r"''(-]+$', '') AS gap FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM {table}_w)),
{table}_t AS (SELECT id, i, low, CASE WHEN regexp_matches(raw, '^[0-9]') OR low IN {tuple(template_leaks.NUMBER_WORDS)} THEN chr(1) || 'num' WHEN low IN {tuple(template_leaks.UNITS)} THEN chr(1) || 'unit'
  WHEN regexp_matches(raw, '^[A-Z]') AND NOT (CASE WHEN gap = '' THEN i = 1 ELSE regexp_matches(gap, '[.!?:;\n]$') END) THEN chr(1) || 'name' ELSE low END AS x FROM {table}_k),
{table}_c AS (SELECT id, list(x ORDER BY i) AS x, list(CASE WHEN x = low THEN NULL ELSE low END ORDER BY i) AS s, count(*) AS n FROM {table}_t GROUP BY id)"""

    widths = f"SELECT unnest(range({template_leaks.LEAST_WORDS}, {size + 1})) AS size"
    few = "len(list_filter(s[p + 1:p + size], lambda v: v IS NOT NULL)) * 2 <= size"
    cut = lambda table, more: (
        f"SELECT id, p, size, x[p + 1:p + size] AS win, s[p + 1:p + size] AS slots FROM (SELECT *, unnest(range(0, n - size + 1)) AS p FROM {table}_c, ({widths}) z WHERE n >= size{more}) WHERE {few}")
    return f"""
WITH {canonical('d', 'doc_id')}, {canonical('b', 'item_id')},
bw AS ({cut('b', f' AND (n = size OR size = {size})')}),
bn AS (SELECT id, count(*) AS total FROM bw GROUP BY id),
dw AS ({cut('d', ' AND size IN (SELECT size FROM bw)')}),
hit AS (SELECT dw.id AS doc_id, bw.id AS item_id, dw.p - bw.p AS shift, bw.p AS pos, bw.size, bw.slots AS a, dw.slots AS b FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
pairs AS (SELECT doc_id, item_id, shift, count(DISTINCT a) AS n_from, count(DISTINCT (a, b)) AS n_pairs, bool_and(a = b) AS same FROM (
  SELECT doc_id, item_id, shift, unnest(a) AS a, unnest(b) AS b FROM hit) WHERE a IS NOT NULL GROUP BY ALL),
place AS (SELECT doc_id, item_id, shift, count(DISTINCT pos) AS n, min(pos) AS lo, max(pos + size - 1) AS hi FROM hit GROUP BY ALL),
good AS (SELECT doc_id, item_id, n / total::DOUBLE AS coverage, coalesce(same, true) AS same, shift, lo, hi
  FROM place LEFT JOIN pairs USING (doc_id, item_id, shift) JOIN bn ON bn.id = item_id WHERE n >= total * 0.5 AND coalesce(n_pairs = n_from, true))
SELECT doc_id, item_id, CASE WHEN same THEN 'exact' ELSE 'parameters' END AS kind, coverage, (lo + shift)::BIGINT AS first_word, (hi + shift)::BIGINT AS last_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY coverage DESC, same DESC, shift, lo DESC, hi DESC) AS r FROM good) WHERE r = 1"""


SQL["op10_template_leaks"] = _leak_sql()


def _secret_sql() -> str:
    """Spans by splitting texts at the matches: a match starts after the parts and matches before it."""
    parts = []
    for rank, rule in enumerate(secret_scan.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        tested = f"length(regexp_extract(m[i], {pattern}, {rule.group}))" if rule.group else "length(m[i])"
        parts.append(
            f"SELECT doc_id, {rank} AS k, '{rule.kind}' AS kind, s, s + length(m[i]) AS e FROM (SELECT doc_id, m, i, "
            f"coalesce(length(array_to_string(g[1:i], '')), 0) + coalesce(length(array_to_string(m[1:i-1], '')), 0) AS s "
            f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, "
            f"string_split_regex(text, {pattern}) AS g FROM documents WHERE text IS NOT NULL))) WHERE {tested} >= {rule.least}")
    return (
        "WITH a AS (" + " UNION ALL ".join(parts) + "), b AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, "
        "count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, "
        "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM a GROUP BY doc_id) "
        "SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, "
        "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN b USING (doc_id)")


SQL["op7_secret_scan"] = _secret_sql()

# counts of links are sums of cosines over a threshold; no pair of these tables lies at it
SQL["op8_sorted_passes"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda t: t::DOUBLE * t)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
c(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.m FROM c JOIN l ON l.a = c.n),
g AS (SELECT n, min(m) AS component_id FROM c GROUP BY n), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN g ON g.n = vec_id LEFT JOIN k ON k.a = vec_id
"""

SQL["op11_fill_middle"] = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

# trees are grown level by level over (place, index), then each leaf is folded along its row of siblings
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"


def _crc32_sql() -> str:
    """crc32 of the decimal doc_id, byte by byte; the table follows from the polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    digits = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, c: xor(a >> 8, {table}[1 + (xor(a, c) & 255)]::BIGINT)), 4294967295)"


SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format('text')} AS leaf,
  CASE WHEN {_crc32_sql()} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format('text')} END AS altered FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source COLLATE C NULLS FIRST) - 1 AS place FROM d),
t(place, level, i, n, digest) AS (SELECT place, 0, pos, count(*) OVER (PARTITION BY place), leaf FROM r
  UNION ALL SELECT place, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY place, level, i // 3),
s AS (SELECT place, digest, level AS height FROM t WHERE n = 1),
u(level, i, n, digest) AS (SELECT 0, place, count(*) OVER (), digest FROM s
  UNION ALL SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3),
nodes AS (SELECT place, level, i, digest FROM t WHERE n > 1),
low AS (SELECT place, level, i // 3 AS run, list(digest ORDER BY i) AS run_digests FROM nodes GROUP BY ALL),
high AS (SELECT level, i // 3 AS run, list(digest ORDER BY i) AS run_digests FROM u WHERE n > 1 GROUP BY ALL),
w(pos, level, place, i, own, proof, up) AS (SELECT pos, 0, place, pos, altered, '', false FROM r
  UNION ALL SELECT w.pos, CASE WHEN low.run IS NULL AND NOT w.up THEN 0 ELSE w.level + 1 END,
    w.place, CASE WHEN low.run IS NULL AND NOT w.up THEN w.place ELSE w.i // 3 END,
    CASE WHEN low.run IS NULL AND high.run IS NULL THEN w.own
      ELSE sha256(array_to_string(coalesce(low.run_digests, high.run_digests)[1:w.i % 3], '') || w.own || array_to_string(coalesce(low.run_digests, high.run_digests)[w.i % 3 + 2:], '')) END,
    CASE WHEN low.run IS NULL AND high.run IS NULL THEN w.proof
      ELSE w.proof || array_to_string(coalesce(low.run_digests, high.run_digests)[1:w.i % 3], '') || array_to_string(coalesce(low.run_digests, high.run_digests)[w.i % 3 + 2:], '') END,
    w.up OR low.run IS NULL
  FROM w LEFT JOIN low ON NOT w.up AND low.place = w.place AND low.level = w.level AND low.run = w.i // 3
    LEFT JOIN high ON w.up AND high.level = w.level AND high.run = w.i // 3 WHERE NOT w.up OR high.run IS NOT NULL),
f AS (SELECT place, pos, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM w WHERE up GROUP BY place, pos)
SELECT k.doc_id, k.leaf, s.digest AS subroot, root.digest AS root, sha256(f.proof) AS proof_sha256, f.own AS folded_root, f.own = root.digest AS verified
FROM r k JOIN f USING (place, pos) JOIN s ON s.place = k.place, (SELECT digest FROM u WHERE n = 1) root
"""
