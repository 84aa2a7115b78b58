"""Line dedup by the number of distinct sites that carry a line.

Each site adds to a HyperLogLog sketch per line hash; sketches merge in the aggregate. Lines whose
estimate is near the threshold get an exact distinct count. A line on ``min_sites`` sites or more is
boilerplate: it stays where it occurs first (smallest doc_id, then row text, then place) and goes elsewhere.

Lines are split at ``\\n`` and compared without outer white space. Lines shorter than ``min_chars`` are never
removed. Cases: null texts stay null; a null site counts as no site; a null doc_id comes last; rows that
repeat doc_id and text are changed alike; a text may become empty, its row stays; an empty table gives an empty result; a
very long text is cut where it lies, and only hashes of its lines move; extra columns are kept whatever their names, but for
one named as the count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import free_name, join_narrow, shared_table

#: log2 of sketch registers; about 6.5 % error, 256 bytes at most.
SKETCH = 8
#: Estimates within this share of the threshold are counted exactly: over four standard errors.
NEAR = 0.3


def _lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """(doc, body, pos, h1, h2, site): a row for each line that may count. ``body`` tells rows of one doc_id apart."""
    cut = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("body"), F.col(site).cast("string").alias("site"),
                      F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    trimmed = F.trim(F.col("line"), F.lit(" \t\r\v\f"))
    return cut.where(F.length(trimmed) >= min_chars).select(
        "doc", "body", "pos", F.xxhash64(trimmed).alias("h1"), F.hash(trimmed).alias("h2"), "site")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 4, min_chars: int = 16) -> DataFrame:
    """(h1, h2, sites, keep): the lines found on ``min_sites`` sites or more, and the occurrence that stays."""
    lines = _lines(docs, site, min_chars)
    first = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), "body", "pos")
    # sites of a line first: a sketch then sees each site of a line once per task and a hot line is split by its sites
    pairs = lines.groupBy("h1", "h2", "site").agg(F.min(first).alias("keep"))
    sketched = pairs.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(SKETCH)).alias("sketch"), F.count("site").alias("seen"), F.min("keep").alias("keep")
    ).where("seen > 1").select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"), "keep")
    wide = shared_table(sketched.where(F.col("sites") >= min_sites * (1 - NEAR)), "line-spread")
    near = shared_table(wide.where(F.col("sites") <= min_sites * (1 + NEAR)).select("h1", "h2", F.lit(1).alias("near")), "line-near")
    exact = join_narrow(lines.where("site is not null"), near, ["h1", "h2"], F.struct("doc", "pos")).groupBy("h1", "h2", "site").count()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    counted = wide.join(exact, ["h1", "h2"], "left").withColumn("sites", F.coalesce("exact", "sites"))
    return counted.where(F.col("sites") >= min_sites).select("h1", "h2", "sites", "keep")


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 4, min_chars: int = 16,
                     removed: str = "n_removed") -> DataFrame:
    """``docs`` with its ``text`` less the boilerplate lines, and a column ``removed`` with their number.

    Only the places to remove are shuffled and gathered per document; texts meet them once.
    """
    found = shared_table(boilerplate(docs, site, min_sites, min_chars), "boilerplate")
    doc, body, gone = (free_name(name, docs) for name in ("_doc", "_body", "_places"))
    places = join_narrow(_lines(docs, site, min_chars), found.select("h1", "h2", "keep"), ["h1", "h2"], F.struct("doc", "pos"))
    stays = F.col("doc").eqNullSafe(F.col("keep.doc")) & (F.col("body") == F.col("keep.body")) & (F.col("pos") == F.col("keep.pos"))
    places = places.where(~stays).groupBy(F.col("doc").alias(doc), F.col("body").alias(body)).agg(F.collect_set("pos").alias(gone))
    columns = [c for c in docs.columns if c != removed]
    out = docs.join(places, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(body)), "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(
        F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col(gone), i)), "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns],
                      F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed)).withColumn(
                          removed, F.greatest(removed, F.lit(0).cast("long")))
