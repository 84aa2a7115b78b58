"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

A document's set holds its distinct word shingles. Two documents link when
``den * |A and B| >= num * |A or B|``; the default is 85 / 100.

* Equal sets are one class, compared once however many copies there are.
* Classes are put into bands by size. A pair belongs to the band of its larger set; a class near the upper end of
  its band also goes to the next. Within a band two linked sets differ in ``d`` elements at most, so if the hash range is
  cut into K > d segments, at least K - d segments hold the same elements in both. A tile is (band, segment, content of the segment):
  linked sets meet in K - d tiles at least. Segments that are empty in both make no tile. A set of n elements differs from linked
  ones of its band in e <= d elements at most, e by its own size; with K - e or more empty segments it is in a tile of the band as well.
  Few have: in a simulation of 4 / 5 and 85 / 100, at most one in a thousand of the sets of six or more elements.
* Tile mates are bounded by parity bitmaps of the sets, of a bit for each element or more: the bits in which they differ are no more
  than the elements in which the sets differ, which bounds the overlap from above. A wider bitmap is folded to the width of the other
  one, which gives the parity bitmap of that width. Pairs that pass are decided by intersecting the sorted arrays.
* First neighbours in tiles are decided, the most promising one of each class, then, twice, neighbours of different components;
  last every pair of a tile whose classes still are in different components. Tiles are cut into blocks, so no task holds
  a whole tile, and pairs inside a component are never formed. The components are those of all links.

Words are runs of characters other than space and \\t to \\r, with A-Z lower-cased. Cases: with fewer words than ``size`` the whole
sequence is the only shingle; null, empty and blank texts have empty sets and link with nothing; a null doc_id is its own null
component unless it has copies or links, then it takes the smallest doc_id of the component; repeated rows are copies; an empty table
gives an empty result; extra columns are ignored; a very long text is a piece of its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .joins import BROADCAST_ROWS, Scratch, free_name, join_narrow, shared_table
from .words import SPACED, hashes, mix, pieces, windows, words

BITMAP = 512  # bits of the narrowest bitmap; a power of two
WIDEST = 1 << 16  # beyond that many elements bitmaps stay as wide, and bound less
BITMAP_BYTES = 32 << 20  # bitmaps of at most this size in all are broadcast
BLOCK = 256  # classes of a tile in one block
GROWTH = 1.5  # upper to lower size of a band
ROUNDS = 2  # times that neighbours of different components are decided before all tile mates are


def bands(num: int, den: int, top: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(smallest size, most differing elements d, segments K) of each band; d = 0: only equal sets link."""
    out, low = [], 1
    while low < top:
        high = max(low + 1, int(low * GROWTH))
        d = 2 * (high - 1) * (den - num) // (den + num)
        out.append((low, d, d + 3 + -(-d * 6 // 100) if d else 0))
        low = high
    return out


def tiles_of(u: np.ndarray, num: int, den: int, table: list[tuple[int, int, int]], lows: list[int]) -> np.ndarray:
    """Tile keys of a sorted set of hashes."""
    n, keys = len(u), []
    band = bisect_right(lows, n) - 1
    largest = n * den // num
    while band < len(table) and table[band][0] <= max(n, largest):
        _, d, k = table[band]
        high = table[band + 1][0] if band + 1 < len(table) else largest + 1
        if d:
            part = ((u >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            content = np.add.reduceat(mix(u ^ np.uint64(0x2545F4914F6CDD1D)), at)
            salt = mix(np.array([band + 1], np.uint64))[0]
            keys.append(mix(content + part[at] * np.uint64(0x9E3779B97F4A7C15) + salt))
            # the largest set of the band that may link with this one bounds what differs more tightly than d
            if len(at) <= (n + min(high - 1, largest)) * (den - num) // (den + num):
                keys.append(mix(np.array([salt], np.uint64)))
        band += 1
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _sets(data: np.ndarray, offset: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a piece."""
    w = words(data, offset, SPACED)
    key, row, _ = windows(w, hashes(w), size, short=True)
    order = np.argsort(row, kind="stable")
    key, cut = key[order], np.searchsorted(row[order], np.arange(w.rows + 1))
    return [np.unique(key[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _name(u: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = mix(u ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) + np.uint64(len(u))
        b = mix(u + np.uint64(0x165667B19E3779F9)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _bitmap(u: np.ndarray) -> np.ndarray:
    """Parities of the elements by their low bits, 64 to a number."""
    width = BITMAP
    while width < min(len(u), WIDEST):
        width *= 2
    odd = np.bincount((u & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, body, n, h1, h2, bitmap): a row for each row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offset in pieces(batch.column(2)):
                n, h1, h2, bits = [], [], [], []
                for u in _sets(data, offset, size):
                    a, b = _name(u)
                    n.append(len(u))
                    h1.append(a)
                    h2.append(b)
                    bits.append(_bitmap(u))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(n)), batch.column(1).slice(begin, len(n)), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                     pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "body", "n", "h1", "h2", "bitmap"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(work, f"doc_id {ids}, body bigint, n bigint, h1 bigint, h2 bigint, bitmap array<bigint>")


def tile_rows(docs: DataFrame, num: int = 85, den: int = 100, size: int = 4) -> DataFrame:
    """(n, h1, tile): the tiles of every class, once for each task that meets it. They go straight into a shuffle and are not stored:
    to find the sets a second time costs less than to write the keys, most of which meet nobody."""
    table = bands(num, den)
    lows = [b[0] for b in table]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, data, offset in pieces(batch.column(0)):
                n, h1, tiles = [], [], []
                for u in _sets(data, offset, size):
                    if not len(u):
                        continue
                    name = _name(u)
                    if name not in seen:
                        seen.add(name)
                        tiles.append(tiles_of(u, num, den, table, lows))
                        n.append(len(u))
                        h1.append(name[0])
                if n:
                    times = [len(t) for t in tiles]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array(n, np.int64), times)), pa.array(np.repeat(np.array(h1, np.int64), times)), pa.array(np.concatenate(tiles).view(np.int64))], ["n", "h1", "tile"])

    return docs.select("text").mapInArrow(work, "n bigint, h1 bigint, tile bigint")


def set_arrays(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, shingles): the sorted arrays of the classes of ``wanted`` (doc_id, body, cid), a written table.

    A document is found by its doc_id and the hash of its text; rows that repeat both give the array once in a task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = [i for i, c in enumerate(batch.column(0).to_pylist()) if not (c in seen or seen.add(c))]
            cids, texts = batch.column(0).take(pa.array(fresh, pa.int64())), batch.column(1).take(pa.array(fresh, pa.int64()))
            for begin, data, offset in pieces(texts):
                sets = _sets(data, offset, size)
                yield pa.RecordBatch.from_arrays([cids.slice(begin, len(sets)), pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64()))], ["cid", "shingles"])

    texts = join_narrow(docs.select("doc_id", F.xxhash64("text").alias("body"), "text"), wanted.select("doc_id", "body", "cid"), ["doc_id", "body"], F.col("doc_id"))
    return texts.select("cid", "text").mapInArrow(work, "cid bigint, shingles array<bigint>")


def _folded(bits: str, other: str) -> Column:
    """The bitmap ``bits`` folded to the width of ``other`` where that is narrower."""
    wide, width = F.col(bits), F.size(other)
    parts = F.sequence(F.lit(1), (F.size(wide) / width).cast("int") - 1)
    folded = F.aggregate(parts, F.slice(wide, F.lit(1), width),
                         lambda done, i: F.zip_with(done, F.slice(wide, i * width + 1, width), lambda x, y: x.bitwiseXOR(y)))
    return F.when(F.size(wide) > width, folded).otherwise(wide)


def may_link(num: int, den: int) -> Column:
    """Whether sizes ``na``, ``nb`` and the bitmaps allow a link: the overlap is at most (na + nb - differing bits) / 2."""
    differ = F.aggregate(F.zip_with(_folded("ba", "bb"), _folded("bb", "ba"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    return fits & ((F.col("na") + F.col("nb") - differ) * (den + num) >= (F.col("na") + F.col("nb")) * (2 * num))


def decide(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by searching each sorted array in the other."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            short, long = (x, y) if len(x) <= len(y) else (y, x)
            # arrays are sorted as unsigned numbers; as signed ones they are sorted in two runs, swapped here
            short, long = np.asarray(short).view(np.uint64), np.asarray(long).view(np.uint64)
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            common = int((long[at] == short).sum())
            out.append(den * common >= num * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    # the array of b moves to a once for each pair, that of a once for all its pairs; a hot a is dealt over salts
    moved = join_narrow(arrays, pairs.select(F.col("b").alias("cid"), "a"), ["cid"], F.col("cid"))
    moved = moved.select("a", F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = join_narrow(moved, arrays.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), ["a"], F.col("b"), rows=0)
    return both.where(linked("sa", "sb")).select("a", "b").distinct()


def mixed_tiles(tiles: DataFrame, place: DataFrame, scratch: Scratch) -> DataFrame:
    """(tile, cid, component, n, bitmap, blocks), written: the tiles (tile, h1) that hold classes of several components.

    ``place`` has (h1, cid, n, bitmap, component). Of tiles with the same classes one is kept.
    """
    spread = join_narrow(tiles, place.select("h1", "cid", "component"), ["h1"], F.col("tile")).select("tile", "cid", "component")
    mixed = spread.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"),
                                       F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("sum"), F.min("cid").alias("first")).where("lo <> hi")
    mixed = mixed.groupBy("size", "sum", "first").agg(F.min("tile").alias("tile"))
    mixed = scratch.table(mixed.select("tile", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed-tiles")
    rows = join_narrow(spread, mixed, ["tile"], F.col("cid"))
    bits = place.agg(F.coalesce(F.sum(F.size("bitmap").cast("long") * 8), F.lit(0))).first()[0]
    few = BROADCAST_ROWS if bits <= BITMAP_BYTES else 0
    out = scratch.table(join_narrow(rows, place.select("cid", "n", "bitmap"), ["cid"], F.col("tile"), rows=few), "mixed-rows")
    scratch.drop(mixed)
    return out


def strangers_beside(mixed: DataFrame, num: int, den: int, step: int) -> DataFrame:
    """(a, b): neighbours in a tile that are of different components and may link; one stream over each tile.

    Every tile and step has an order of its own, so a class meets another mate in each of its tiles.
    """
    order = Window.partitionBy("tile").orderBy(F.xxhash64("tile", "cid", F.lit(step)), "cid")
    before = [F.lag(c).over(order).alias(name) for c, name in (("cid", "a"), ("component", "ca"), ("n", "na"), ("bitmap", "ba"))]
    pairs = mixed.select(F.col("cid").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"), *before)
    return pairs.where((F.col("ca") != F.col("cb")) & may_link(num, den)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tile_mates(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of tile mates of different components that sizes and bitmaps let pass.

    A tile is cut into blocks of about BLOCK classes, and each pair of blocks is a join key of its own.
    """
    rows = mixed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("bigint")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = rows.select("tile", F.col("cid").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("bitmap").alias("ba"),
                       F.col("block").alias("i"), F.explode(every).alias("j"))
    right = rows.select("tile", F.col("cid").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"),
                        F.col("block").alias("j"), F.explode(every).alias("i"))
    met = left.join(right, ["tile", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & may_link(num, den))
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, size: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    out = placed(docs, num, den, size)
    own = F.when(F.col("n") > 0, F.col("first_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, F.col("doc_id")).alias("component_id"))


def placed(docs: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """(doc_id, body, n, first_id, first_body), a row for each row of ``docs``: the first row of its component.

    ``body`` is xxhash64 of the text. First by doc_id, null last, then body. Rows with an empty set have null there.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    rows = scratch.table(signatures(docs, size), "signatures")
    named = rows.select("doc_id", "body", "n", "h1", "h2")
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    classes = rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(head).alias("head"), F.max("bitmap").alias("bitmap"))
    # numbers of classes are fixed by writing them; results do not depend on which they are
    classes = scratch.table(classes.select("h1", "h2", "n", "head.doc_id", "head.body", "bitmap", F.monotonically_increasing_id().alias("cid")), "classes")

    # neighbours in tiles: one sort, read in a stream however large a tile is
    members = tile_rows(docs, num, den, size)
    order = Window.partitionBy("tile").orderBy("n", "h1")
    members = members.select("tile", "h1", F.lag("h1").over(order).alias("before"), F.lead("h1").over(order).alias("after"))
    members = members.where("before <> h1 or after <> h1")  # a class met only by its own copies needs no mate
    tiles = scratch.table(members.select("tile", "h1", "before"), "tiles")
    del members
    met = scratch.table(tiles.select("h1").distinct().join(classes, "h1"), "met")
    scratch.collect()  # the shuffle of all tile keys

    next_to = tiles.where("before is not null and before <> h1").groupBy("before", "h1").agg(F.count("*").alias("shared"))
    one = met.select(F.col("h1").alias("before"), F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
    two = met.select("h1", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))
    pairs = next_to.join(one, "before").join(two, "h1").where(may_link(num, den)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    pairs = scratch.table(pairs.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("a", "b").distinct(), "pairs")
    every = scratch.table(tiles.select("tile", "h1").distinct(), "members")
    scratch.drop(tiles)

    # first the most promising neighbour of each class; then neighbours of different components, while that joins
    # components; last every pair of tile mates that are still apart
    place = scratch.table(met.withColumn("component", F.col("cid")), "place")
    place = _place(place, _decided(docs, pairs, met, scratch, num, den, size), scratch)
    for step in range(ROUNDS + 1):
        mixed = mixed_tiles(every, place, scratch)
        found = strangers_beside(mixed, num, den, step) if step < ROUNDS else tile_mates(mixed, num, den)
        fresh = scratch.table(found.join(pairs, ["a", "b"], "left_anti"), "fresh")
        scratch.drop(mixed)
        place = _place(place, _decided(docs, fresh, met, scratch, num, den, size), scratch)
        old, pairs = (pairs, fresh), scratch.table(pairs.union(fresh), "pairs")
        scratch.drop(*old)
        del old, fresh, found, mixed
        scratch.collect()
    scratch.drop(pairs, every, met)

    whole = classes.select("h1", "h2", "cid", "doc_id", "body").join(place.select("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = whole.groupBy("component").agg(F.min(head).alias("first"))
    least = least.select("component", F.col("first.doc_id").alias("first_id"), F.col("first.body").alias("first_body"))
    ids = scratch.table(whole.select("h1", "h2", "component").join(least, "component").select("h1", "h2", "first_id", "first_body"), "ids")
    scratch.drop(place, classes)
    return join_narrow(named, ids, ["h1", "h2"], F.col("doc_id"), "left").select("doc_id", "body", "n", "first_id", "first_body")


def _decided(docs: DataFrame, pairs: DataFrame, met: DataFrame, scratch: Scratch, num: int, den: int, size: int) -> DataFrame:
    """The pairs that link; only the sets of their classes are made again and moved."""
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = scratch.table(met.select("cid", "doc_id", "body").join(ends, "cid", "left_semi"), "wanted")
    arrays = scratch.table(set_arrays(docs, wanted, size), "arrays")
    out = scratch.table(decide(pairs, arrays, num, den), "links")
    scratch.drop(wanted, arrays)
    return out


def _place(place: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``place`` with the components that ``links`` join made one. Both tables are dropped.

    The graph has a node for each component met by a new link, so it shrinks as components grow.
    """
    at = place.select("cid", "component")
    one, two = (at.select(F.col("cid").alias(end), F.col("component").alias(f"c{end}")) for end in "ab")
    edges = links.join(one, "a").join(two, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    moved = scratch.table(components(edges).select(F.col("node").alias("component"), F.col("component").alias("into")), "moved")
    out = join_narrow(place, moved, ["component"], F.col("cid"), "left").withColumn("component", F.coalesce("into", "component")).drop("into")
    out = scratch.table(out, "place")
    scratch.drop(place, links, moved)
    return out


def keep_one(docs: DataFrame, num: int = 4, den: int = 5, size: int = 5) -> DataFrame:
    """``docs`` with one row of each component: the first by doc_id, null last, then hash of the text, then hash of the row.

    Rows without words link with nothing and all stay; so do rows without doc_id that have no copy and no link.
    """
    linked = placed(docs.select("doc_id", "text"), num, den, size).where("n > 0")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("body") == F.col("first_body"))
    seen = linked.groupBy("doc_id", "body").agg(F.max(first).alias("first"), F.count("*").alias("n"))
    fate = F.when(~F.col("first"), "gone").when(F.col("n") > 1, "repeated")
    body, mark = (free_name(name, docs) for name in ("_body", "_fate"))
    marks = shared_table(seen.select("doc_id", F.col("body").alias(body), fate.alias(mark)).where(F.col(mark).isNotNull()), "copies")
    named, key, spread = docs.withColumn(body, F.xxhash64("text")), ["doc_id", body], F.spark_partition_id()
    out = join_narrow(named, marks, key, spread, "left").where(F.col(mark).isNull()).select(*docs.columns)
    again = shared_table(marks.where(F.col(mark) == "repeated"), "repeated")
    if again.isEmpty():
        return out
    # a task hands on one row for each key, so the copies of a row never meet in one place
    rows = join_narrow(named, again, key, spread)
    chosen = rows.groupBy(*key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(mark))
    return out.union(chosen.select(f"{mark}.*"))
