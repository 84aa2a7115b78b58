"""Secret scan over a trigram inverted index, in DataFrame operations only.

The Boolean trigram queries of all rules give the trigrams that matter. Texts are turned into postings
(trigram, document); postings that complete an alternative of a rule's query make the document a candidate
of that rule, and only candidates are matched against its expression. Rules without mandatory trigrams are
matched against every text.

Matches of a rule are leftmost and do not overlap; those that fail the rule's length test are dropped.
Offsets are code points, the end is exclusive. Cases: null texts have no spans; rows that repeat doc_id
and text give each span once; rows of one doc_id with other texts are told apart by ``body``; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from .trigrams import trigram_query


class Rule(NamedTuple):
    """``group`` of a match must have ``least`` characters or more; group 0 is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three kinds, in this order, are the base set.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("body"), "text").where("text is not null")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, body, kinds): the rules with a trigram query that a text satisfies."""
    queries = [(r.kind, n, g) for r in rules for n, g in enumerate(trigram_query(r.pattern))]
    grams = sorted({t for _, _, g in queries for t in g})
    if not grams:
        return docs.sparkSession.createDataFrame([], "doc bigint, body bigint, kinds array<string>")
    known = F.array(*[F.lit(g) for g in grams])
    present = F.flatten(F.transform(F.array(F.lower("text")), lambda text: F.filter(known, lambda gram: F.contains(text, gram))))
    postings = _keyed(docs).select("doc", "body", F.explode(present).alias("gram"))
    wanted = {g: [(k, n, len(all_)) for k, n, all_ in queries if g in all_] for g in grams}
    uses = F.create_map(*[x for g, us in wanted.items() for x in (
        F.lit(g), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n"), F.lit(size).alias("size")) for k, n, size in us]))])
    used = postings.distinct().select("doc", "body", F.explode(F.element_at(uses, F.col("gram"))).alias("use"))
    met = used.groupBy("doc", "body", "use.kind", "use.n", "use.size").count().where(F.col("count") == F.col("size"))
    return met.groupBy("doc", "body").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, body, kind, start, end): every span. ``body`` is xxhash64 of the text."""
    found = candidates(docs, rules)
    texts = _keyed(docs)
    joined = texts.join(found.select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), "kinds"),
                        texts["doc"].eqNullSafe(F.col("_doc")) & (texts["body"] == F.col("_body")), "left")
    spans = [_matches(r, F.col("text"), F.col("kinds")) for r in rules]
    rows = joined.select("doc", "body", F.concat(*spans).alias("all")).where(F.size("all") > 0)
    rows = rows.select("doc", "body", F.inline("all")).dropDuplicates(["doc", "body", "kind", "i"])
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc", "body", "kind").orderBy("i"))
    return rows.withColumn("end", end.cast("long")).where("ok").select(
        "doc", "body", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _matches(rule: Rule, text: Column, kinds: Column) -> Column:
    r"""Gap before each match, its length, and whether it passes. ``\G`` makes each search go on where the last ended."""
    walk = F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    part = lambda i: F.regexp_extract_all(text, walk, F.lit(i))
    length = F.transform(part(2), lambda m: F.length(m))
    tested = length if rule.group == 0 else F.transform(part(2 + rule.group), lambda m: F.length(m))
    gaps = F.transform(part(1), lambda g: F.length(g))
    rows = F.transform(F.arrays_zip(gaps.alias("gap"), length.alias("size"), tested.alias("t")), lambda z, i: F.struct(
        F.lit(rule.kind).alias("kind"), i.alias("i"), z["gap"].cast("long").alias("gap"), z["size"].cast("long").alias("size"),
        (z["t"] >= rule.least).alias("ok")))
    none = F.array().cast("array<struct<kind:string,i:int,gap:bigint,size:bigint,ok:boolean>>")
    wanted = F.rlike(text, F.lit(rule.pattern))
    if trigram_query(rule.pattern):
        wanted = F.array_contains(kinds, rule.kind) & wanted
    return F.when(wanted, rows).otherwise(none)


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of ``docs``: numbers of base spans, a hash over them, and all spans as one string."""
    order = {r.kind: i for i, r in enumerate(rules)}
    rank = reduce(lambda c, k: F.when(F.col("kind") == k, order[k]).otherwise(c), order, F.lit(len(order)))
    spans = find_secrets(docs, rules).groupBy("doc", "body").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    spans = spans.select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), *[count(k).alias(f"n_{k}") for k in BASE],
                         joined(base).alias("base"), joined(F.col("spans")).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"))
    out = rows.join(spans, rows["doc_id"].eqNullSafe(F.col("_doc")) & (rows["body"] == F.col("_body")), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
                      F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
