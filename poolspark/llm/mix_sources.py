"""Mixing sources to target weights.

Words are summed per source, each source gets a share of the budget by its weight, and every document
is taken floor(rate) times plus once more with the probability of the fraction, drawn from a hash of its doc_id and text.

Cases: a null or empty text has size 0 and is taken at the rate of its source; null is a source of its own; sources without words get
target 0; rows that repeat both doc_id and text draw alike; an empty table gives an empty result; extra columns are
kept by ``emit``, a column named ``copy`` as ``copy_in`` (with underscores before it if that is taken too); a source
missing from the weights has weight 0; a very long text is counted and hashed where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import free_name, join_narrow, shared_table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: str, body: Column) -> Column:
    """A number from 0 to 1 by doc_id and the hash of the text, so rows without doc_id draw each on their own."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), body)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _body(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, weight): the distinct sources in code-point order, null last, weigh ``cycle``, repeating.

    One row per source is ordered in one task; documents are not.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.select("source").distinct().select(
        "source", F.element_at(weights, (rank % len(cycle) + 1).cast("int")).alias("weight"))


def targets(totals: DataFrame, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, weight, source_size), a written table.

    The budget times all sizes is shared by weight; no source gets more than ``cap`` times its size, and
    the excess is shared again among the rest by weight until none is above. Each round is one aggregate
    row; the capped set only grows.
    """
    size, weight = F.col("source_size"), F.col("weight")
    top = size * F.lit(cap)
    whole = float(totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * budget
    unit, held = 0.0, -1
    while True:
        full = (weight * F.lit(unit) >= top) if held >= 0 else F.lit(False)
        n, capped, rest = totals.agg(
            F.coalesce(F.sum(full.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, weight)), F.lit(0.0))).first()
        if n == held or rest <= 0:
            break
        unit, held = max(0.0, (whole - capped) / rest), n
    return totals.withColumn("target", F.least(top, weight * F.lit(unit)))


def plan_mix(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.5, cap: float = 2.0,
             seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for each row of ``docs``.

    ``weights`` has (source, weight); without it the weights cycle over the sources.
    """
    sized = shared_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _body("text").alias("body")), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = cycle_weights(sums) if weights is None else weights.select("source", "weight")
    sums = shared_table(sums, "mix-sums")
    totals = shared_table(
        join_narrow(sums, shared_table(weights, "mix-weights"), ["source"], F.lit(0), "left")
        .na.fill(0.0, ["weight"]), "mix-totals")
    shares = shared_table(targets(totals, budget, cap).select("source", "source_size", "target"), "mix-targets")
    joined = join_narrow(sized, shares, ["source"], F.col("doc_id"), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = _draw(seed, F.col("body"))
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, weights: DataFrame | None = None, budget: float = 1.5, cap: float = 2.0,
         seed: str = "mix") -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``copy`` (1, 2, ...), a row for each time a row is taken.

    Copies follow from the source's rate and the document's own hash, so documents are not shuffled:
    only the rates, one row per source, are joined to them.
    """
    rate = free_name("rate", docs)
    renamed = {c: free_name("copy_in", docs) for c in docs.columns if c.lower() == "copy"}
    named = docs.withColumnsRenamed(renamed)
    plan = plan_mix(docs, weights, budget, cap, seed)
    rates = shared_table(plan.groupBy("source").agg(
        F.max(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias(rate)), "mix-rates")
    times = F.floor(rate) + (_draw(seed, _body("text")) < F.col(rate) - F.floor(rate)).cast("long")
    out = join_narrow(named, rates, ["source"], F.col("doc_id"))
    return out.where(times >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop(rate)
