"""Merkle manifest of a dataset: digests of all documents, one root, and proofs by descent.

Every document is a leaf. The leaves of a source, in order of doc_id, are hashed in runs of ``ARITY`` until one digest is left, the
source's subroot; the subroots, in order of their sources, likewise give the root. What is stored is content-addressed: records
of a digest and its children. A request for a leaf starts at the root, follows the digits of the leaf's rank from record to
record, collects the children it does not choose, and turns the path round at the end.

Records are stored by tiers: one row holds the records below a block of ``ARITY ** LEVELS`` consecutive nodes, so a descent
takes one join per tier and ``LEVELS`` look-ups within a row. Ranks come from a range sort of the keys, split over
tasks by size: a source that holds most documents is spread like any other. A tier is a table LEVELS powers smaller than the last.

Cases: a null field hashes as '-'; null doc_ids come first in their source, the null source comes first of all; rows that repeat a
doc_id are leaves of their own, in order of their digests; a null or empty text is a leaf like another; texts of any length are
hashed in the JVM; an empty table gives an empty result and a root of no nodes (null); columns beyond the hashed ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .joins import join_narrow, shared_table

ARITY = 3
LEVELS = 6
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_RECORDS = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
_PATH = pa.list_(pa.list_(pa.string()))


class Manifest(NamedTuple):
    """leaves: source, doc_id, leaf, altered, rank. tiers: source, block, digest, n, records, from the leaves up.
    subroots: source, digest, rank. top: the same tiers over the subroots. root: one digest, or None."""

    leaves: DataFrame
    tiers: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None
    n_sources: int


def digest_of(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(text: Column, others: tuple[str, ...] = FIELDS[:-1]) -> Column:
    """Digest of a document: each field as '-' or its size in bytes, ':' and its value."""
    fields = [F.col(c).cast("string") for c in others] + [text]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), 256)


def height(n: int) -> int:
    """Levels above n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def ranked(rows: DataFrame, group: str | None, order: list[str], tasks: int) -> tuple[DataFrame, DataFrame]:
    """Adds ``rank`` within ``group`` to ``rows``, a written table; and (group, n).

    A range sort deals the rows over tasks by size. Each task counts on within a group; what a group has in earlier tasks is added
    from a table of one row for each task and group met there.
    """
    named = [group] if group else []
    keys = [F.col(c).asc_nulls_first() for c in [*named, *order]]
    at = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = at.repartitionByRange(tasks, *keys, "_row").sortWithinPartitions(*keys, "_row").withColumn("_part", F.spark_partition_id())

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, n = None, 0
        for batch in batches:
            values = batch.column("_group").dictionary_encode(null_encoding="encode")
            codes = values.indices.to_numpy(zero_copy_only=False)
            if not len(codes):
                continue
            begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            run = np.diff(np.append(begin, len(codes)))
            own = np.arange(len(codes)) - np.repeat(begin, run)
            first = values.dictionary[int(codes[0])].as_py()
            if (first, True) == before:
                own[:run[0]] += n
            last = values.dictionary[int(codes[-1])].as_py()
            before, n = (last, True), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "_at"])

    keyed = ordered.withColumn("_group", F.col(group) if group else F.lit(0)).drop("_row")
    placed = shared_table(keyed.mapInArrow(count_on, T.StructType([*keyed.schema.fields, T.StructField("_at", T.LongType())])), "merkle-placed")
    counts = placed.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    past = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared_table(counts.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0))), "merkle-offsets")
    totals = offsets.groupBy("_group").agg(F.sum("_n").alias("n"))
    joined = join_narrow(placed, offsets.drop("_n"), ["_group", "_part"], F.col("_at"))
    out = joined.withColumn("rank", F.col("_at") + F.col("_before")).select(*rows.columns, "rank")
    return out, totals.select(F.col("_group").alias(group), "n") if group else totals.select("n")


def _bundle(levels: int):
    """One row for the nodes of a block: the digest above them and the records between, found level by level."""
    def work(key, table):
        n = table.column("n")[0].as_py()
        order = np.argsort(table.column("rank").to_numpy())
        nodes = table.column("digest").take(pa.array(order)).to_pylist()
        records = []
        for _ in range(min(levels, height(n))):
            above = []
            for k in range(0, len(nodes), ARITY):
                children = nodes[k:k + ARITY]
                above.append(digest_of(children))
                records.append({"digest": above[-1], "children": children})
            nodes = above
        return pa.table([table.column("source").slice(0, 1).combine_chunks(), pa.array([key[1].as_py()], pa.int64()), pa.array(nodes, pa.string()),
                         pa.array([n], pa.int64()), pa.array([records], _RECORDS)], ["source", "block", "digest", "n", "records"])
    return work


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tiers above (source, rank, digest, n), n the number of nodes of the source, and (source, digest) of what remains."""
    kind = nodes.schema["source"].dataType.simpleString()
    schema = f"source {kind}, block bigint, digest string, n bigint, records array<struct<digest:string,children:array<string>>>"
    tiers, ends = [], []
    while True:
        blocks = nodes.withColumn("block", F.floor(F.col("rank") / F.lit(BLOCK)).cast("long"))
        tier = shared_table(blocks.groupBy("source", "block").applyInArrow(_bundle(LEVELS), schema), "merkle-tier")
        tiers.append(tier)
        ends.append(tier.where(F.col("n") <= BLOCK).select("source", "digest"))
        above = tier.where(F.col("n") > BLOCK).select("source", F.col("block").alias("rank"), "digest", F.ceil(F.col("n") / F.lit(BLOCK)).cast("long").alias("n"))
        if above.isEmpty():
            break
        nodes = above
    out = ends[0]
    for part in ends[1:]:
        out = out.unionByName(part)
    return tiers, out


def build(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``altered`` is a text to be held against the leaf later, by default the document's own."""
    text = F.col("text")
    hashed = shared_table(docs.select(
        "source", "doc_id", leaf_digest(text).alias("leaf"), leaf_digest(text if altered is None else altered).alias("altered")), "merkle-hashed")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    leaves, totals = ranked(hashed, "source", ["doc_id", "leaf"], tasks)
    leaves = shared_table(join_narrow(leaves, shared_table(totals, "merkle-totals"), ["source"], F.col("rank")), "merkle-leaves")
    tiers, ends = grow(leaves.select("source", "rank", F.col("leaf").alias("digest"), "n"))
    # subroots are nodes of one group, ordered by source
    subroots = shared_table(ranked(shared_table(ends, "merkle-ends"), None, ["source"], tasks)[0], "merkle-subroots")
    n = subroots.count()
    if not n:
        return Manifest(leaves, tiers, subroots, [], None, 0)
    top, last = grow(subroots.select(F.lit(0).alias("source"), "rank", "digest", F.lit(n).cast("long").alias("n")))
    return Manifest(leaves, tiers, subroots, top, last.first()["digest"], n)


def _descend(records: dict[str, list[str]], digest: str, rank: int, levels: int) -> tuple[str, list[list[str]]]:
    """From ``digest`` down the digits of ``rank``: the digest arrived at and the children not chosen, lowest level first."""
    path = []
    for level in range(levels - 1, -1, -1):
        children, digit = records[digest], rank // ARITY**level % ARITY
        path.append(children[:digit] + children[digit + 1:])
        digest = children[digit]
    return digest, path[::-1]


def _opened(tier: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, rank, digest, path, ...) of all nodes below the blocks of ``tier`` that ``wanted`` (source, block, path, ...) holds."""
    joined = tier.select("source", "block", F.col("digest").alias("above"), "n", "records").join(
        wanted.withColumnRenamed("source", "_s").withColumnRenamed("block", "_b"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    more = [f for f in wanted.schema.fields if f.name not in ("source", "block", "path")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records = {r["digest"]: r["children"] for r in row["records"]}
                levels, begin = min(LEVELS, height(row["n"])), row["block"] * BLOCK
                size = min(BLOCK, row["n"] - begin)
                found = [_descend(records, row["above"], k, levels) for k in range(size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["source"]] * size, batch.schema.field("source").type), pa.array(np.arange(begin, begin + size), pa.int64()), pa.array([d for d, _ in found], pa.string()),
                     pa.array([p + row["path"] for _, p in found], _PATH), *[pa.array([row[f.name]] * size, batch.schema.field(f.name).type) for f in more]],
                    ["source", "rank", "digest", "path", *[f.name for f in more]])

    kind = tier.schema["source"].dataType
    fields = [T.StructField("source", kind), T.StructField("rank", T.LongType()), T.StructField("digest", T.StringType()),
              T.StructField("path", T.ArrayType(T.ArrayType(T.StringType()))), *more]
    return joined.mapInArrow(work, T.StructType(fields))


def _fold(digest: str, path: list[list[str]], digits: Iterator[int]) -> str:
    for others, digit in zip(path, digits):
        digest = digest_of([*others[:digit], digest, *others[digit:]])
    return digest


def _digits(rank: int, levels: int) -> list[int]:
    return [rank // ARITY**k % ARITY for k in range(levels)]


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, siblings, folded_root, verified) of all leaves, or of the doc_ids in ``wanted``.

    ``siblings`` are lists, one for each level from the leaf to the root, left to right. ``folded_root`` follows from the altered
    text and the siblings, and ``verified`` says whether it is the root.
    """
    spark = manifest.leaves.sparkSession
    requests = manifest.leaves
    if wanted is not None:
        ids = wanted.select("doc_id").distinct().withColumnRenamed("doc_id", "_id")
        requests = requests.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if not manifest.n_sources:
        return requests.select("doc_id", "source", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"),
                               F.expr("cast(array() as array<array<string>>)").alias("siblings"), F.col("leaf").alias("folded_root"), F.lit(True).alias("verified"))
    empty = F.expr("cast(array() as array<array<string>>)")
    frame = spark.range(1).select(F.lit(0).alias("source"), F.lit(0).cast("long").alias("block"), empty.alias("path"))
    for k in range(len(manifest.top) - 1, -1, -1):
        nodes = _opened(manifest.top[k], frame)
        frame = nodes.select("source", F.col("rank").alias("block"), "path")
    found = shared_table(nodes.select(F.col("rank").alias("place"), F.col("digest").alias("subroot"), "path"), "merkle-sources")
    entries = shared_table(manifest.subroots.join(found, F.col("rank") == F.col("place")).select("source", "place", "subroot", "path"), "merkle-entries")
    frame = None
    for k in range(len(manifest.tiers) - 1, -1, -1):
        # sources whose tree ends at this tier enter here, at the only block they have in it
        ends = manifest.tiers[k].where(F.col("n") <= BLOCK).select(F.col("source").alias("_s"))
        own = entries.join(ends, F.col("source").eqNullSafe(F.col("_s"))).select("source", F.lit(0).cast("long").alias("block"), "path", "place", "subroot")
        frame = own if frame is None else own.unionByName(frame)
        if k:
            nodes = shared_table(_opened(manifest.tiers[k], frame), "merkle-nodes")
            frame = nodes.select("source", F.col("rank").alias("block"), "path", "place", "subroot")
    asked = requests.withColumn("block", F.floor(F.col("rank") / F.lit(BLOCK)).cast("long")).groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(
        F.collect_list(F.struct("rank", "doc_id", "leaf", "altered")).alias("asked"), F.max("n").alias("leaves"))  # at most BLOCK ranks
    frame = frame.withColumnRenamed("source", "_s2").withColumnRenamed("block", "_b2")
    tier = manifest.tiers[0].select("source", "block", F.col("digest").alias("above"), "n", "records")
    joined = tier.join(frame, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("block") == F.col("_b2"))).join(
        asked, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).select("source", "block", "above", "n", "records", "path", "place", "subroot", "asked", "leaves")
    root, n_sources = manifest.root, manifest.n_sources

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                records = {r["digest"]: r["children"] for r in row["records"]}
                levels, top = min(LEVELS, height(row["n"])), _digits(row["place"], height(n_sources))
                out = []
                for x in row["asked"]:
                    leaf, path = _descend(records, row["above"], x["rank"], levels)
                    if leaf != x["leaf"]:
                        raise ValueError(f"rank {x['rank']} of source {row['source']!r} leads to another leaf")
                    path = path + row["path"]
                    folded = _fold(x["altered"], path, iter(_digits(x["rank"], height(row["leaves"])) + top))
                    out.append((x["doc_id"], row["source"], leaf, row["subroot"], root, path, folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)

    ids = manifest.leaves.schema
    names = ["doc_id", "source", "leaf", "subroot", "root", "siblings", "folded_root", "verified"]
    out_schema = (f"doc_id {ids['doc_id'].dataType.simpleString()}, source {ids['source'].dataType.simpleString()}, leaf string, subroot string, root string, "
                  "siblings array<array<string>>, folded_root string, verified boolean")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}
    kinds = [arrow[ids["doc_id"].dataType.simpleString()], arrow[ids["source"].dataType.simpleString()], pa.string(), pa.string(), pa.string(), _PATH, pa.string(), pa.bool_()]
    return joined.mapInArrow(work, out_schema)
