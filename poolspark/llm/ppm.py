"""LM scoring: prediction by partial matching over bytes, beside a word model with add-one smoothing.

The trie of contexts is a set of tables, one for each order: an edge is a context of that many bytes and the symbol after it, with
its count in all training texts. A symbol is a byte, or the end of the text; contexts before the first byte are filled with a
boundary. An edge is one integer of nine bits a symbol, so a shorter context is the same number less its high bits.

Escapes follow method C: a context seen n times with u different symbols gives count / (n + u) to each of these and u / (n + u) to
all others, which are then coded in the next shorter context, with the symbols of the longer one excluded; below order 0 all
symbols left are alike. Contexts never seen cost nothing. What a symbol costs depends on its longest edge alone, so the tables are
resolved from order 0 up, by joins, into one probability for each distinct edge of the corpus, and texts only look these up.

Tasks count edges and words of their texts first; counts are merged by aggregation. Of the resolved table the ``HOT`` most frequent
rows at most are broadcast (16 bytes each); what a text has beyond them is joined by a shuffle with the whole table. Both ways
give the same sums, and no edge or word is left out.

Cases: a null text counts as empty and costs its end; texts of any length are scored whole, piece by piece; a null doc_id is never
held out; rows that repeat a doc_id score alike if their texts do; without training texts the word model has no counts and every
symbol costs the same; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import shared_table
from .words import hashes, pieces, words

ORDER = 5
BITS = 9
#: The symbol after the last byte and before the first one.
BOUNDARY = 256
SYMBOLS = 257
#: Rows of each kind that are broadcast at most, 16 bytes each.
HOT = 1 << 20
#: Distinct keys that a task holds before it hands their counts on.
HELD = 1 << 21

#: Kinds of keys in the counts. The end of a text counts as a word of its own.
EDGE, WORD = 0, 1
END_WORD = -0x7E57E57E57E57E57

COLUMNS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def edges(data: np.ndarray, offset: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The edge of every byte and every end of the texts of a piece, text by text; and where each text begins, one entry more."""
    rows = len(offset) - 1
    begin = offset + np.arange(rows + 1) * (order + 1)
    # each text is preceded by ``order`` boundaries and followed by one
    symbols = np.full(int(begin[-1]), BOUNDARY, np.int64)
    if len(data):
        symbols[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1) * (order + 1) - 1, np.diff(offset))] = data
    key = np.zeros(len(symbols) - order, np.int64) if rows else np.zeros(0, np.int64)
    for k in range(order + 1):
        key <<= BITS
        key |= symbols[k:len(symbols) - order + k]
    first = offset + np.arange(rows + 1)
    at = np.arange(int(first[-1])) + np.repeat(np.arange(rows) * order, np.diff(first))
    return key[at], first


def word_keys(data: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts of a piece; and where the words of each text begin, one entry more."""
    w = words(data, offset)
    return hashes(w).view(np.int64), w.first


def _merged(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each array of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return keys, *counts
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], *[np.add.reduceat(c[order], begin) for c in counts]


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of at most 62 bits, how often each occurs where ``train`` is 1, and in all."""
    marked = np.sort((keys << 1) | train)
    begin = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]])) if len(marked) else np.zeros(0, np.int64)
    n, found = np.diff(np.append(begin, len(marked))), marked[begin]
    return _merged(found >> 1, np.where(found & 1, n, 0), n)


def count_keys(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """(kind, key, n, seen): every distinct edge of order ``order`` and word of all texts, how often it occurs in training texts
    and in all. Words have the word hash as key, ends END_WORD."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {EDGE: [], WORD: []}

        def flush(kind: int) -> pa.RecordBatch:
            keys, n, seen = _merged(*(np.concatenate(x) for x in zip(*held[kind])))
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n), pa.array(seen)], ["kind", "key", "n", "seen"])

        def add_words(keys: np.ndarray, marks: np.ndarray) -> None:
            distinct, at = np.unique(keys, return_inverse=True)  # all 64 bits are in use
            seen = np.bincount(at, minlength=len(distinct))
            held[WORD].append((distinct, np.bincount(at, weights=marks, minlength=len(distinct)).astype(np.int64), seen))

        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for begin, data, offset in pieces(batch.column(0), 2 << 20):
                marks = flags[begin:begin + len(offset) - 1]
                keys, first = edges(data, offset, order)
                held[EDGE].append(_counted(keys, np.repeat(marks, np.diff(first)).astype(np.int64)))
                keys, first = word_keys(data, offset)
                add_words(np.append(keys, np.full(len(marks), END_WORD)), np.append(np.repeat(marks, np.diff(first)), marks))
                for kind, parts in held.items():
                    if sum(len(p[0]) for p in parts) > HELD:
                        yield flush(kind)
        for kind, parts in held.items():
            if parts:
                yield flush(kind)

    # the order of columns puts the text first, as the piece reader wants it
    parts = docs.select("text", train.alias("train")).mapInArrow(work, "kind tinyint, key bigint, n bigint, seen bigint")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _mask(order: int) -> Column:
    return F.lit((1 << (BITS * (order + 1))) - 1).cast("long")


def resolve(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, seen, p): the probability of each edge of ``counts`` (key, n, seen), edges of order ``order``.

    Per order one row for each edge met: ``c`` its count, ``full`` its probability when its context is the longest one, ``rest`` its
    probability below this context with the symbols seen in it excluded. ``size`` and ``kinds`` are those of the context.
    """
    levels = [counts.select("key", F.col("n").alias("c"), "seen")]
    for k in range(order - 1, -1, -1):
        levels.append(shared_table(levels[-1].groupBy(F.col("key").bitwiseAND(_mask(k)).alias("key")).agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")), "ppm-edges"))
    below = None
    for k in range(order + 1):
        edge = levels[order - k].withColumn("context", F.shiftright("key", BITS))
        if below is None:
            edge = edge.withColumns({"low_c": F.lit(0).cast("long"), "low_full": F.lit(1.0 / SYMBOLS), "low_rest": F.lit(0.0), "low_size": F.lit(0).cast("long"), "low_kinds": F.lit(0).cast("long")})
        else:
            low = below.select(F.col("key").alias("low"), *[F.col(c).alias(f"low_{c}") for c in ("c", "full", "rest", "size", "kinds")])
            edge = edge.withColumn("low", F.col("key").bitwiseAND(_mask(k - 1))).join(low, "low").drop("low")
        known = F.col("c") > 0
        nodes = edge.groupBy("context").agg(
            F.sum("c").alias("size"), F.count(F.when(known, 1)).alias("kinds"),
            # what the symbols of this context have in the next shorter one
            F.sum(F.when(known, F.col("low_c")).otherwise(0)).alias("cut"))
        edge = edge.join(nodes, "context")
        if below is None:
            rest = 1.0 / F.greatest(F.lit(1), F.lit(SYMBOLS) - F.col("kinds"))
        else:
            left, other = F.col("low_size") - F.col("cut"), F.col("low_kinds") - F.col("kinds")
            # a shorter context all of whose symbols are excluded is passed through
            rest = F.when(known, 0.0).when(F.col("low_c") > 0, F.col("low_c") / (left + other)).when(
                left + other > 0, other / (left + other) * F.col("low_rest")).otherwise(F.col("low_rest"))
        edge = edge.withColumn("rest", rest)
        both = F.col("size") + F.col("kinds")
        full = F.when(known, F.col("c") / both).when(F.col("size") > 0, F.col("kinds") / both * F.col("rest")).otherwise(F.col("low_full"))
        below = shared_table(edge.withColumn("full", full).select("key", "c", "seen", "full", "rest", "size", "kinds"), "ppm-level")
    return below.select("key", "seen", F.col("full").alias("p"))


def _hot(table: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (key, seen, value), a table of ``n`` rows, as sorted arrays: all, or those met most often, ``most`` at most."""
    if n > most:
        grade = F.floor(F.log2("seen") * 8).cast("int")
        left, least = most, None
        for row in sorted(table.groupBy(grade.alias("g")).count().collect(), reverse=True):  # a few hundred grades
            left -= row["count"]
            if left < 0:
                break
            least = row["g"]
        table = table.where(grade >= least) if least is not None else table.limit(0)
    got = table.select("key", "value").toArrow()
    keys, value = got.column("key").to_numpy(), got.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order], value[order]


def _look_up(keys: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key, 0 for those that are not hot, and whether it is hot."""
    distinct, at = np.unique(keys, return_inverse=True)
    place = np.minimum(np.searchsorted(hot[0], distinct), max(len(hot[0]) - 1, 0))
    is_hot = hot[0][place] == distinct if len(hot[0]) else np.zeros(len(distinct), bool)
    value = np.where(is_hot, hot[1][place], 0.0) if len(hot[0]) else np.zeros(len(distinct))
    return value[at], is_hot[at]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; each from its own values, so that a text scores the same beside any other."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


_REST = "array<struct<key:bigint,times:bigint>>"


def score(docs: DataFrame, train: Column, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``; ``train`` marks texts to learn from.

    ``score`` is the log10 probability of the bytes and the end of the text. ``base_score`` is that of its lower-cased words and the
    end, each with (count + 1) / (train_tokens + distinct + 1). A training text is scored with its own counts included.
    """
    counts = shared_table(count_keys(docs, F.coalesce(train, F.lit(True)), order), "ppm-counts")
    word = counts.where(F.col("kind") == WORD)
    sizes = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.count(F.when(F.col("n") > 0, 1)).alias("distinct")).collect()}
    if not sizes:
        return docs.limit(0).select("doc_id", *[F.lit(0).cast(t).alias(c) for c, t in zip(COLUMNS, ("long", "long", "long", "double", "double"))])
    total, distinct = sizes[WORD]["total"], sizes[WORD]["distinct"]
    base = total + distinct + 1
    prices = resolve(counts.where(F.col("kind") == EDGE).select("key", "n", "seen"), order).select("key", "seen", F.log10("p").alias("value"))
    known = word.select("key", "seen", F.col("n").cast("double").alias("value"))
    shipped = docs.sparkSession.sparkContext.broadcast(
        (_hot(prices, sizes[EDGE]["rows"], hot), _hot(known, sizes[WORD]["rows"], hot)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_edges, hot_words = shipped.value
        for batch in batches:
            for begin, data, offset in pieces(batch.column(0)):
                rows = len(offset) - 1
                keys, first = edges(data, offset, order)
                value, found = _look_up(keys, hot_edges)
                rest_edges = _left_over(keys, first, found)
                total_value = _sums(value, first)
                keys, first = word_keys(data, offset)
                # ends are words as well, after the last word of each text
                keys = np.insert(keys, first[1:], END_WORD)
                first = first + np.arange(rows + 1)
                n, found = _look_up(keys, hot_words)
                base_value = _sums(np.where(found, np.log10((n + 1) / base), 0.0), first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(begin, rows), pa.array(np.diff(first), pa.int64()), pa.array(_sums((found & (n > 0)).astype(np.int64), first)),
                     pa.array(base_value), pa.array(total_value), rest_edges, _left_over(keys, first, found)],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "rest_edges", "rest_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    first = docs.select("text", "doc_id").mapInArrow(
        work, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, rest_edges {_REST}, rest_words {_REST}")
    if max(r["rows"] for r in sizes.values()) > hot:
        first = _with_rest(first, prices, known, base)
    return first.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _left_over(keys: np.ndarray, first: np.ndarray, found: np.ndarray) -> pa.Array:
    """The keys of each text that are not among the hot ones, and how often each occurs in it."""
    at = np.flatnonzero(~found)
    row, key = np.searchsorted(first, at, "right") - 1, keys[at]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(key)))
    offsets = np.searchsorted(row[begin], np.arange(len(first)))
    entries = pa.StructArray.from_arrays([pa.array(key[begin], pa.int64()), pa.array(times, pa.int64())], ["key", "times"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


def _with_rest(first: DataFrame, prices: DataFrame, known: DataFrame, base: int) -> DataFrame:
    """Adds what the keys left over cost: joined with the whole tables by a shuffle, and summed for each row."""
    part = shared_table(first.withColumn("_row", F.monotonically_increasing_id()), "ppm-parts")
    edge = part.select("_row", F.inline("rest_edges")).join(prices, "key").select(
        "_row", (F.col("value") * F.col("times")).alias("more"), F.lit(0.0).alias("more_base"), F.lit(0).cast("long").alias("more_known"))
    word = part.select("_row", F.inline("rest_words")).join(known, "key").select(
        "_row", F.lit(0.0).alias("more"), (F.log10((F.col("value") + 1) / F.lit(base)) * F.col("times")).alias("more_base"),
        F.when(F.col("value") > 0, F.col("times")).otherwise(0).alias("more_known"))
    more = edge.unionByName(word).groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("more", "more_base", "more_known")])
    plus = lambda c, m: F.col(c) + F.coalesce(F.col(m), F.lit(0))
    return part.join(more, "_row", "left").withColumns(
        {"base_score": plus("base_score", "more_base"), "score": plus("score", "more"), "n_known": plus("n_known", "more_known")})
