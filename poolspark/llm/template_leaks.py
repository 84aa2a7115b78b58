"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of items and documents become typed placeholders. Windows of ``size`` canonical words
of the items are hash-joined with those of the documents. The windows of an item found at one alignment in a
document are put together, and the values of its slots are compared: each value of the item must stand for
one value of the document. An alignment that covers ``share`` of the item's windows and is consistent is a leak: "exact"
when all values agree, else "parameters".

``every_leak`` finds more: values of other lengths, copies with words put in or left out, and copies in other case. Runs of
numbers, and of names, between which only white space or hyphens stand, are one slot with the joined value; a second reading takes
names as lower-cased words, not as slots. Windows of both readings are chained over alignments that differ by at most ``size``
words, in ascending order of their places in item and document; a chain is judged as an alignment is.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased A-Z; a dot or comma between
digits belongs to a number. A number is a word that begins with a digit, or a number word; a unit is a word of
UNITS; a name is a word with a capital A-Z that does not begin a sentence. Windows of placeholders by more
than half are not used. Items of 4 to ``size`` - 1 words are one window of their own length; shorter items
are not searched.

Cases: null and empty texts hold no window; a document that repeats an item is a leak once; repeated rows give one
result; an item whose item_id repeats with another text is told apart by the text; empty tables give an empty result;
extra columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_narrow, shared_table
from .words import ALNUM, Words, hashes, mix, pieces, word_hash, words

#: Fixed values.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
                "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres "
         "second seconds minute minutes hour hours day days week weeks month months year years percent cent cents dollar dollars euro euros "
         "degree degrees mph kmh").split()
NUM, UNIT, NAME = (np.uint64(word_hash(f"\x01{x}")) for x in ("num", "unit", "name"))
FILTER_BITS = 23  # the filter is one MB, whatever the size of the benchmark
LEAST_WORDS = 4
READINGS = (True, False)  # of every_leak: with names as slots, with names as words


def _sorted_hashes(values: list[str]) -> np.ndarray:
    return np.sort(np.array([word_hash(v) for v in values], np.uint64))


_NUMBERS, _UNITS = _sorted_hashes(NUMBER_WORDS), _sorted_hashes(UNITS)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 58, 59, 63]] = True
_JOINS = np.zeros(256, bool)
_JOINS[[9, 10, 11, 12, 13, 32, 45]] = True
_GAP = np.ones(256, bool)
_GAP[[9, 11, 12, 13, 32, 34, 39, 40, 45]] = False


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def canonical(data: np.ndarray, offset: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a piece, the hash of each canonical word, and the hash of each slot's value (0: no slot)."""
    joint = np.zeros(len(data), bool)
    if len(data) > 2:
        point = (data[1:-1] == 46) | (data[1:-1] == 44)
        joint[1:-1] = point & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    shown = np.where(joint, np.uint8(48), data)  # as a digit, so that the number is one word
    w = words(shown, offset, ALNUM)
    w = w._replace(lower=np.where(joint, data, w.lower))
    h = hashes(w)
    number = _DIGIT[data[w.start]] | _among(h, _NUMBERS)
    unit = _among(h, _UNITS)
    # a sentence begins with the row, or where its end stands after the last character that is not a gap
    solid = np.where(_GAP[data], np.arange(len(data)), -1)
    last = np.maximum.accumulate(solid) if len(data) else solid
    before = np.where(w.start > 0, last[np.maximum(w.start - 1, 0)], -1)
    begins = (before < offset[w.row]) | _ENDS[data[np.maximum(before, 0)]]
    name = (data[w.start] >= 65) & (data[w.start] <= 90) & ~begins & ~number & ~unit
    slots = np.where(number | unit | name, h, np.uint64(0))
    h = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, h)))
    return w, h, slots


def joined(w: Words, h: np.ndarray, slots: np.ndarray, names: bool) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, hashes and slots with runs of numbers, and of names, as one word, and the first and last word of each run.

    Without ``names`` a name is the word itself.
    """
    if not names:
        h, slots = np.where(h == NAME, slots, h), np.where(h == NAME, np.uint64(0), slots)
    if not len(h):
        return w, h, slots, np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.concatenate([[0], np.cumsum(~_JOINS[w.data])])
    apart = np.ones(len(h), bool)
    apart[1:] = (h[1:] != h[:-1]) | (w.row[1:] != w.row[:-1]) | ~((h[1:] == NUM) | (h[1:] == NAME)) | (solid[w.start[1:]] != solid[w.end[:-1]])
    at = np.flatnonzero(apart)
    last = np.append(at[1:], len(h)) - 1
    place = np.arange(len(h)) - np.repeat(at, last - at + 1)
    value = np.add.reduceat(mix(slots + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at) | np.uint64(1)
    row = w.row[at]
    short = w._replace(start=w.start[at], end=w.end[last], row=row, first=np.searchsorted(row, np.arange(w.rows + 1)))
    return short, h[at], np.where(last > at, value, slots[at]), at, last


def _windows(w: Words, h: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of the usable windows of ``size`` words."""
    last = len(h) - size + 1
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.full(last, size, np.uint64)
    held = np.zeros(last, np.int64)
    for k in range(size):
        key *= np.uint64(0xD6E8FEB86659FD93)
        key += h[k:k + last]
        held += slots[k:k + last] != 0
    at = np.flatnonzero((w.row[:last] == w.row[size - 1:]) & (held * 2 <= size))
    return mix(key[at]), w.row[at], at


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, item, pos, size, total, hash, slots): the windows of every item; ``item`` is a hash of its text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offset in pieces(batch.column(2)):
                w, h, slots = canonical(data, offset)
                n = np.diff(w.first)
                for width in range(LEAST_WORDS, size + 1):
                    key, row, at = _windows(w, h, slots, width)
                    keep = (n[row] == width) | (width == size)
                    key, row, at = key[keep], row[keep], at[keep]
                    if len(key):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(row + begin)), batch.column(1).take(pa.array(row + begin)), pa.array(at - w.first[row]), pa.array(np.full(len(key), width, np.int32)),
                             pa.array(np.bincount(row, minlength=w.rows)[row]), pa.array(key.view(np.int64)), _lists(slots, at, width)],
                            ["item_id", "item", "pos", "size", "total", "hash", "slots"])

    ids = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where("text is not null").select("item_id", F.xxhash64("text").alias("item"), "text").dropDuplicates(["item_id", "item"])
    return rows.mapInArrow(work, f"item_id {ids}, item bigint, pos bigint, size int, total bigint, hash bigint, slots array<bigint>")


def _lists(slots: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    flat = slots.view(np.int64)[(at[:, None] + np.arange(size)).ravel()]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))


def window_filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for each value that the low bits of a window hash take, and the widths of the windows.

    At most 2^17 rows reach the driver, however large the benchmark is; a fuller filter only lets more windows through.
    """
    bit = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = items.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows:
        bits[r.at] = r.bits
    return np.unpackbits(bits.view(np.uint8), bitorder="little"), [r[0] for r in items.select("size").distinct().collect()]


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, body, pos, hash, slots): the windows of all documents that pass the filter."""
    packed = docs.sparkSession.sparkContext.broadcast(bits)
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = packed.value
        for batch in batches:
            for begin, data, offset in pieces(batch.column(2)):
                w, h, slots = canonical(data, offset)
                for size in sizes:
                    key, row, at = _windows(w, h, slots, size)
                    keep = known[(key & mask).astype(np.int64)] == 1
                    if keep.any():
                        key, row, at = key[keep], row[keep], at[keep]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(row + begin)), batch.column(1).take(pa.array(row + begin)), pa.array(at - w.first[row]),
                             pa.array(key.view(np.int64)), _lists(slots, at, size)], ["doc_id", "body", "pos", "hash", "slots"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(work, f"doc_id {ids}, body bigint, pos bigint, hash bigint, slots array<bigint>")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 8, share: float = 0.5) -> DataFrame:
    """(doc_id, body, item_id, kind, coverage, first_word, last_word): each item found in each document.

    ``body`` is xxhash64 of the document's text. A window that many documents hold is one row for each place, never a pair of documents.
    """
    items = shared_table(item_windows(benchmark, size), "item-windows")
    bits, sizes = window_filter(items)
    found = document_windows(docs, bits, sizes)
    sought = items.select("item_id", "item", F.col("pos").alias("item_pos"), "size", "total", "hash", F.col("slots").alias("item_slots"))
    hits = join_narrow(found, sought, ["hash"], F.struct("doc_id", "pos"))
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda z: z["a"] != 0)
    hits = hits.select("doc_id", "body", "item_id", "item", "size", "total", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), pairs.alias("pairs"))
    placed = hits.groupBy("doc_id", "body", "item_id", "item", "shift").agg(
        F.count_distinct("item_pos").alias("n"), F.max("total").alias("total"), F.min("item_pos").alias("lo"), F.max(F.col("item_pos") + F.col("size") - 1).alias("hi"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    values = F.size(F.array_distinct(F.transform("pairs", lambda z: z["a"])))
    same = F.forall("pairs", lambda z: z["a"] == z["b"])
    placed = placed.where((F.col("n") >= F.col("total") * share) & (values == F.size("pairs")))
    best = F.struct((F.col("n") / F.col("total")).alias("coverage"), same.alias("same"), (-F.col("shift")).alias("back"), F.col("lo"), F.col("hi"))
    out = placed.groupBy("doc_id", "body", "item_id", "item").agg(F.max(best).alias("b"))
    return out.select("doc_id", "body", "item_id", F.when(F.col("b.same"), "exact").otherwise("parameters").alias("kind"), F.col("b.coverage").alias("coverage"),
                      (F.col("b.lo") - F.col("b.back")).alias("first_word"), (F.col("b.hi") - F.col("b.back")).alias("last_word"))


def _readings(benchmark: DataFrame, key: str, sizes: list[int] | None, size: int, bits: np.ndarray | None) -> DataFrame:
    """(<key>, body, reading, at, first, last, size, total, hash, slots): the windows of both readings of ``benchmark``, items or documents.

    Items (``bits`` null) have a window of their own length if they are shorter than ``size``; of documents the windows that pass the filter are taken.
    """
    packed = None if bits is None else benchmark.sparkSession.sparkContext.broadcast(bits)
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offset in pieces(batch.column(2)):
                plain = canonical(data, offset)
                for reading, names in enumerate(READINGS):
                    w, h, slots, head, tail = joined(*plain, names)
                    n = np.diff(w.first)
                    for width in sizes or range(LEAST_WORDS, size + 1):
                        hashed, row, at = _windows(w, h, slots, width)
                        hashed = mix(hashed + np.uint64(reading + 1))
                        keep = (n[row] == width) | (width == size) if packed is None else packed.value[(hashed & mask).astype(np.int64)] == 1
                        hashed, row, at = hashed[keep], row[keep], at[keep]
                        if len(hashed):
                            base = plain[0].first[row]
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).take(pa.array(row + begin)), batch.column(1).take(pa.array(row + begin)), pa.array(np.full(len(row), reading, np.int32)),
                                 pa.array((at - w.first[row]).astype(np.int64)), pa.array((head[at] - base).astype(np.int64)), pa.array((tail[at + width - 1] - base).astype(np.int64)),
                                 pa.array(np.full(len(row), width, np.int32)), pa.array(np.bincount(row, minlength=w.rows)[row]), pa.array(hashed.view(np.int64)), _lists(slots, at, width)],
                                [key, "body", "reading", "at", "first", "last", "size", "total", "hash", "slots"])

    ids = benchmark.schema[key].dataType.simpleString()
    rows = benchmark.where("text is not null").select(key, F.xxhash64("text").alias("body"), "text")
    return rows.mapInArrow(work, f"{key} {ids}, body bigint, reading int, at bigint, first bigint, last bigint, size int, total bigint, hash bigint, slots array<bigint>")


def best_chain(hits: list, total: int, share: float, slack: int) -> tuple[int, bool, int, int] | None:
    """(windows, same, first, last) of the longest consistent chain of ``hits`` (at, pos, first, last, pairs) that covers ``share``.

    A chain ascends in item (pos) and document (at), and its alignments differ by ``slack`` words at most from one hit to the next.
    A chain that is not consistent is passed over as a whole.
    """
    hits = sorted(hits, key=lambda x: (x["at"], x["pos"]))
    top = max(x["pos"] for x in hits)
    length, back, begin = [1] * len(hits), [-1] * len(hits), 0
    for j, x in enumerate(hits):
        while hits[begin]["at"] < x["at"] - top - slack:
            begin += 1
        for i in range(j - 1, begin - 1, -1):
            y = hits[i]
            if y["at"] < x["at"] and y["pos"] < x["pos"] and abs((x["at"] - x["pos"]) - (y["at"] - y["pos"])) <= slack and length[i] + 1 > length[j]:
                length[j], back[j] = length[i] + 1, i
    used: set[int] = set()
    for end in sorted(range(len(hits)), key=lambda j: (-length[j], j)):
        if length[end] < total * share:
            break
        chain, j = [], end
        while j >= 0:
            chain.append(j)
            j = back[j]
        if used.intersection(chain):
            continue
        used.update(range(chain[-1], end + 1))
        pairs = {(z["a"], z["b"]) for j in chain for z in hits[j]["pairs"]}
        if len({a for a, _ in pairs}) == len(pairs):
            return len(chain), all(a == b for a, b in pairs), hits[chain[-1]]["first"], hits[end]["last"]
    return None


def every_leak(docs: DataFrame, benchmark: DataFrame, size: int = 8, share: float = 0.5) -> DataFrame:
    """The rows of ``leaks``, and those that only chains over both readings find. Columns as there."""
    base = shared_table(leaks(docs, benchmark, size, share), "leaks")
    items = _readings(benchmark.dropDuplicates(["item_id", "text"]), "item_id", None, size, None)
    items = shared_table(items.withColumnRenamed("body", "item"), "item-readings")
    bits, sizes = window_filter(items)
    found = _readings(docs, "doc_id", sizes, size, bits)
    sought = items.select("item_id", "item", F.col("at").alias("pos"), "size", "total", "hash", F.col("slots").alias("item_slots"))
    hits = join_narrow(found.drop("size", "total"), sought, ["hash"], F.struct("doc_id", "at"))
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda z: z["a"] != 0)
    key = ["doc_id", "body", "item_id", "item", "reading"]
    # rows that repeat a document give the same hits, which the set takes once
    groups = hits.groupBy(*key).agg(F.collect_set(F.struct("at", "pos", "first", "last", pairs.alias("pairs"))).alias("hits"), F.max("total").alias("total"))
    groups = groups.where(F.size(F.array_distinct(F.col("hits.pos"))) >= F.col("total") * share)

    @F.pandas_udf("n bigint, same boolean, first bigint, last bigint")
    def chained(hits: pd.Series, total: pd.Series) -> pd.DataFrame:
        rows = [best_chain(list(h), int(t), share, size) or (None, None, None, None) for h, t in zip(hits, total)]
        return pd.DataFrame(rows, columns=["n", "same", "first", "last"]).astype({"n": "Int64", "same": "boolean", "first": "Int64", "last": "Int64"})

    chains = groups.select(*key, "total", chained("hits", "total").alias("c")).where("c.n is not null")
    best = F.struct((F.col("c.n") / F.col("total")).alias("coverage"), F.col("c.same").alias("same"), (-F.col("c.first")).alias("back"), F.col("c.last").alias("last"))
    more = chains.groupBy("doc_id", "body", "item_id", "item").agg(F.max(best).alias("b"))
    more = more.select("doc_id", "body", "item_id", F.when(F.col("b.same"), "exact").otherwise("parameters").alias("kind"), F.col("b.coverage").alias("coverage"),
                       (-F.col("b.back")).alias("first_word"), F.col("b.last").alias("last_word"))
    known = base.select(F.col("doc_id").alias("_d"), F.col("body").alias("_b"), F.col("item_id").alias("_i")).distinct()
    same = more["doc_id"].eqNullSafe(F.col("_d")) & (more["body"] == F.col("_b")) & more["item_id"].eqNullSafe(F.col("_i"))
    return base.union(more.join(known, same, "left_anti"))
