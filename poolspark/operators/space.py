"""Feature space: principal components and the nearest-neighbour graph."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions.features import DEFAULT_BITS
from poolspark.operators.matrix import dense_rows
from poolspark.operators.ranking import top_k
from poolspark.session import BROADCAST_BYTES, Scratch, cut_lineage, shared_table

N_COMPONENTS = 10
PANEL_PAIRS = ((1, 2), (1, 3), (2, 3))
# Columns of a covariance block: a block of doubles is 512 KB, so a merge of FAN_IN of them stays small at any width.
BLOCK_COLUMNS = 256
FAN_IN = 32
# A task that scans rows hands its blocks on when they hold this many bytes.
SCAN_BYTES = 128 * 1024 * 1024
# Rows of on-bits that are spread out to 0/1 numbers at once.
SPREAD_ROWS = 1024

BLOCK_SCHEMA = "key string, i int, j int, n bigint, mean_i array<double>, mean_j array<double>, block array<double>"
LOADING_SCHEMA = "key string, component int, explained double, cumulative double, mean array<double>, loading array<double>"


def covariance_blocks(rows: DataFrame, block_columns: int = BLOCK_COLUMNS, fan_in: int = FAN_IN, scan_bytes: int = SCAN_BYTES, n_bits: int | None = None) -> DataFrame:
    """(key, i, j, n, mean_i, mean_j, block) of rows (key, features): block (i, j), i <= j, of the centred cross products of each key.

    A scan adds up its own rows and hands on blocks, not rows; partial blocks of a key are then merged, ``fan_in`` at a time, by the
    pairwise formula for sums around different means. No task holds a whole matrix, nothing depends on the order of the rows beyond
    rounding, and a key that holds all the rows gives no more blocks to a merge than a small one. With ``n_bits``, features are the
    on-bits of that many, spread out a few rows at a time.
    """

    def scan(batches):
        held: dict = {}
        for batch in (part for whole in batches for part in (_slices(whole) if n_bits else [whole])):
            x = spread_rows(batch.column("features"), n_bits) if n_bits else dense_rows(batch.column("features"))
            codes, keys = pd.factorize(batch.column("key").to_pandas(), use_na_sentinel=False)
            for code, key in enumerate(keys):
                key = None if pd.isna(key) else key
                held[key] = with_rows(held.get(key), x[codes == code])
            if sum(m[2].nbytes for m in held.values()) >= scan_bytes:
                yield from _block_batches(held, block_columns)
                held = {}
        yield from _block_batches(held, block_columns)

    partial = cut_lineage(rows.select("key", "features").mapInArrow(scan, BLOCK_SCHEMA))
    most = partial.groupBy("key", "i", "j").count().agg(F.max("count")).head()[0] or 0
    while most > 1:
        salt = F.floor(F.rand(17) * -(-most // fan_in)).cast("int") if most > fan_in else F.lit(0)
        partial = cut_lineage(partial.withColumn("_salt", salt)).groupBy("key", "i", "j", "_salt").applyInPandas(_merge_blocks, BLOCK_SCHEMA)
        partial = cut_lineage(partial)
        most = partial.groupBy("key", "i", "j").count().agg(F.max("count")).head()[0]
    return partial


def _slices(rows):
    cut = rows.slice if isinstance(rows, pa.RecordBatch) else lambda start, n: rows[start : start + n]
    return (cut(start, SPREAD_ROWS) for start in range(0, len(rows), SPREAD_ROWS))


def spread_rows(column: pa.Array, n_bits: int) -> np.ndarray:
    """list<int> column of on-bits -> n x n_bits matrix of 0/1 numbers."""
    x = np.zeros((len(column), n_bits))
    x[np.repeat(np.arange(len(column)), column.value_lengths()), column.flatten()] = 1.0
    return x


def with_rows(held: tuple | None, rows: np.ndarray) -> tuple:
    """(n, mean, centred cross products) of what ``held`` sums up and of ``rows``."""
    mean = rows.mean(axis=0)
    centred = rows - mean
    cross = centred.T @ centred
    if held is None:
        return len(rows), mean, cross
    n, delta = held[0] + len(rows), mean - held[1]
    return n, held[1] + delta * (len(rows) / n), held[2] + cross + np.outer(delta, delta) * (held[0] * len(rows) / n)


def _block_batches(held: dict, width: int):
    """One Arrow batch per key and row of blocks."""
    schema = pa.schema([
        ("key", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()),
        *((c, pa.list_(pa.float64())) for c in ("mean_i", "mean_j", "block")),
    ])
    for key, (n, mean, cross) in held.items():
        starts = range(0, len(mean), width)
        for i, a in enumerate(starts):
            rows = [
                {"key": key, "i": i, "j": j, "n": n, "mean_i": mean[a : a + width], "mean_j": mean[b : b + width],
                 "block": cross[a : a + width, b : b + width].ravel()}
                for j, b in enumerate(starts) if j >= i
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _merge_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Partial blocks of one place as one."""
    first, n = group.iloc[0], 0
    mean_i, mean_j, block = (np.zeros(len(first[c])) for c in ("mean_i", "mean_j", "block"))
    for row in group.itertuples():
        d_i, d_j, both = row.mean_i - mean_i, row.mean_j - mean_j, n + row.n
        block = block + row.block + np.outer(d_i, d_j).ravel() * (n * row.n / both)
        mean_i, mean_j, n = mean_i + d_i * (row.n / both), mean_j + d_j * (row.n / both), both
    return pd.DataFrame({
        "key": [first["key"]], "i": [first["i"]], "j": [first["j"]], "n": [n], "mean_i": [mean_i], "mean_j": [mean_j], "block": [block],
    })


def principal_components(rows: DataFrame, n_components: int = N_COMPONENTS, **options) -> DataFrame:
    """(key, component, explained, cumulative, mean, loading) of rows (key, features), each key by itself.

    ``explained`` is the share of the variance of the key's own rows (0 where rows do not vary). The sign of a component is
    arbitrary; it is fixed so that its largest loading is positive. A task decomposes the matrix of one key (width * width doubles).
    """
    return covariance_blocks(rows, **options).groupBy("key").applyInPandas(_decompose(n_components), LOADING_SCHEMA)


def _decompose(n_components: int):
    def decompose(group: pd.DataFrame) -> pd.DataFrame:
        means = {row.i: row.mean_i for row in group.itertuples() if row.i == row.j}
        mean = np.concatenate([means[i] for i in sorted(means)])
        starts = np.cumsum([0, *(len(means[i]) for i in sorted(means))])
        cross = np.zeros((len(mean), len(mean)))
        for row in group.itertuples():
            a, b = starts[row.i], starts[row.j]
            block = np.reshape(row.block, (len(row.mean_i), len(row.mean_j)))
            cross[a : a + block.shape[0], b : b + block.shape[1]] = block
            cross[b : b + block.shape[1], a : a + block.shape[0]] = block.T
        values, vectors = np.linalg.eigh(cross)
        k = min(n_components, len(mean))
        total = np.trace(cross)
        explained = np.maximum(values[::-1][:k], 0.0) / total if total > 0 else np.zeros(k)
        top = vectors[:, ::-1][:, :k].T
        top = top * np.where(top[np.arange(k), np.abs(top).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame({
            "key": group["key"].iloc[0], "component": np.arange(1, k + 1), "explained": explained, "cumulative": np.cumsum(explained),
            "mean": [mean] * k, "loading": list(top),
        })

    return decompose


def fit_pca(
    df: DataFrame, n_components: int = N_COMPONENTS, features: str = "features", key: str = "target", n_bits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows with an array column ``embedding``, variance table), components fitted for each ``key`` by itself.

    Rows without features are left out; rows without ``key`` are a group of their own. The variance table has (key, component from 1,
    explained ratio, running sum). Loadings go to the executors in blocks of at most BROADCAST_BYTES, a scan each; features are not shuffled.
    With ``n_bits``, ``features`` are on-bits and stay so: no column of 0/1 numbers is made.
    """
    plain = df.where(F.col(features).isNotNull())
    if isinstance(df.schema[features].dataType, VectorUDT):
        plain = plain.withColumn(features, vector_to_array(features))
    values = F.col(features).cast("array<int>" if n_bits else "array<double>")
    rows = plain.select(F.col(key).cast("string").alias("key"), values.alias("features"))
    loadings = shared_table(principal_components(rows, n_components, n_bits=n_bits), "loadings")
    variance = loadings.select(F.col("key").cast(df.schema[key].dataType).alias(key), "component", "explained", "cumulative")
    return _projected(plain, loadings, values, key, n_bits), variance


def _projected(plain: DataFrame, loadings: DataFrame, values: Column, key: str, n_bits: int | None) -> DataFrame:
    size = loadings.agg(F.sum(8 * F.size("loading") + F.when(F.col("component") == 1, 8 * F.size("mean")).otherwise(0))).head()[0] or 0
    n_parts = max(1, -(-2 * size // BROADCAST_BYTES))  # twice: parts are dealt by hash
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(n_parts))
    out = None
    for number in range(n_parts):
        held: dict = {}
        for row in loadings.where(part(F.col("key")) == number).orderBy("key", "component").toLocalIterator():
            mean, top = held.setdefault(row.key, (np.array(row.mean), []))
            top.append(row.loading)
        sent = plain.sparkSession.sparkContext.broadcast({k: (mean, np.array(top)) for k, (mean, top) in held.items()})
        own = plain if n_parts == 1 else plain.where(part(F.col(key).cast("string")) == number)
        embedded = own.withColumn("embedding", _embed(sent, n_bits)(F.col(key).cast("string"), values))
        out = embedded if out is None else out.unionByName(embedded)
    return out


def _embed(sent, n_bits: int | None):
    @F.pandas_udf("array<double>")
    def embed(keys: pd.Series, features: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(keys), dtype=object)
        for key, at in keys.groupby(keys, dropna=False).indices.items():
            mean, top = sent.value[None if pd.isna(key) else key]
            own = features.iloc[at].to_numpy()
            if n_bits:
                parts = (spread_rows(pa.array(part, pa.list_(pa.int32())), n_bits) for part in _slices(own))
                points = np.concatenate([(x - mean) @ top.T for x in parts])
            else:
                points = (np.stack(own) - mean) @ top.T
            out.iloc[at] = pd.Series(list(points), dtype=object).to_numpy()
        return out

    return embed


def share_of_variance(variance: DataFrame, key: str = "target", up_to: int = 2) -> DataFrame:
    """key, variance_<n>: what the first n components explain together (all, where there are fewer)."""
    first = variance.where(F.col("component") <= up_to)
    return first.groupBy(key).agg(F.max("cumulative").alias(f"variance_{up_to}"))


def projection_rows(projected: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[int, int]] = PANEL_PAIRS) -> DataFrame:
    """keys, pair, x, y, label: one row per item and pair of components."""
    points = [
        F.struct(
            F.lit(f"PC{i}-PC{j}").alias("pair"),
            F.element_at("embedding", i).alias("x"),
            F.element_at("embedding", j).alias("y"),
        )
        for i, j in pairs
    ]
    return projected.select(*keys, F.inline(F.array(*points)), "label")


def overlay(projected: DataFrame, tags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Embedding rows with the campaign tags of the same items, matched by key."""
    return projected.join(tags, list(keys))


# Nearest neighbours -----------------------------------------------------------------------------

N_NEIGHBORS = 15
# Rows per block; two blocks meet in one task, which holds a bit for each entry of them.
BLOCK_ROWS = 32768
# Small tables have more and smaller blocks than that, so that all cores have work.
LEAST_BLOCKS, LEAST_ROWS = 8, 2048
# Steps between blocks that meet in one round; a row is copied twice for each.
ROUND_STEPS = 5
# Rows of a block that are compared at once: queries, entry by entry, and candidates, 64 to a word.
TILE_ROWS = (128, 4096)
# Rows that are compared with each other as 0/1 numbers, for a first bound of their k-th best.
SEED_ROWS = 1024
# Up to so many new neighbours of a row are put in place one by one, more are sorted with those it has.
FEW = 8


def knn_jaccard(
    df: DataFrame, k: int = N_NEIGHBORS, row_id: str = "mol_id", fp: str = "fp", n_bits: int = DEFAULT_BITS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k-nearest-neighbour edges by Jaccard distance: src, dst, dist, rank; ties by smaller id.

    Identical fingerprints are searched once, so a large group of copies costs one search. Distinct
    fingerprints, a bit for each entry, are dealt to blocks of fixed size, and each pair of blocks is one task
    that keeps only the k best per row: no pair table is ever built, whatever the data look like. Blocks meet
    themselves first and then each other in rounds, each of which copies a row to a fixed number of tasks, with the
    similarity that it has to reach by now, and leaves the k best found so far, so what is stored grows with the
    rows. The number of comparisons is quadratic in the distinct fingerprints.
    """
    scratch = Scratch(df.sparkSession, "neighbours")
    # Written once: the rows are read again when the result is expanded to all copies.
    rows = scratch.table(df.select(F.col(row_id).alias("src"), _packed(n_bits)(F.col(fp)).alias("fp")), "bits").where("fp is not null")
    first = top_k(rows, ["fp"], [F.col("src")], k + 1, "_r")
    # At most k + 1 ids per group: enough to serve as neighbours of a copy or of another group.
    unique = first.groupBy("fp").agg(F.array_sort(F.collect_list("src")).alias("ids"))
    unique = scratch.table(unique.withColumn("gid", F.element_at("ids", 1)), "fingerprints")

    found = _nearest_groups(unique.select("gid", "fp"), k, n_bits, block_rows, scratch)
    members = unique.select(F.col("gid").alias("other"), F.col("ids").alias("other_ids"))
    expanded = found.join(members, "other").groupBy("gid").agg(
        F.flatten(F.collect_list(F.transform("other_ids", lambda i: F.struct(F.col("dist"), i.alias("dst"))))).alias("near")
    )
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("dst")))
    nothing = F.array().cast("array<struct<dist:double,dst:bigint>>")
    best = unique.join(expanded, "gid", "left").select(
        "fp", F.slice(F.array_sort(F.concat(own, F.coalesce("near", nothing))), 1, k + 1).alias("near")
    )
    others = F.slice(F.filter("near", lambda e: e["dst"] != F.col("src")), 1, k)
    edges = rows.join(best, "fp").select("src", F.posexplode(others).alias("rank", "edge"))
    return edges.select("src", "edge.dst", "edge.dist", (F.col("rank") + 1).alias("rank"))


def _packed(n_bits: int):
    """On-bits as bytes, a bit for each entry; NULL where there are none."""

    @F.pandas_udf("binary")
    def packed(bits: pd.Series) -> pd.Series:
        held = np.flatnonzero(bits.str.len().fillna(0) > 0)
        x = np.zeros((len(held), n_bits), np.uint8)
        if len(held):
            on = bits.iloc[held]
            x[np.repeat(np.arange(len(held)), on.str.len().astype(int)), np.concatenate(on.to_numpy())] = 1
        out = np.full(len(bits), None, dtype=object)
        out[held] = [row.tobytes() for row in np.packbits(x, axis=1)]
        return pd.Series(out)

    return packed


NEAREST_SCHEMA = "gid bigint, other bigint, dist double"


def _nearest_groups(unique: DataFrame, k: int, n_bits: int, block_rows: int, scratch: Scratch) -> DataFrame:
    """gid, other, dist: the k nearest other fingerprints of each fingerprint."""
    n = unique.count()
    n_blocks = max(1, -(-n // block_rows), min(LEAST_BLOCKS, -(-n // LEAST_ROWS)))
    own = F.pmod(F.xxhash64("gid"), F.lit(n_blocks)).cast("int")
    tiles, seed_rows = TILE_ROWS, SEED_ROWS

    def search(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[group["right"] == side] for side in (False, True))
        return nearest_jaccard(a, b if group["step"].iloc[0] else None, k, n_bits, tiles, seed_rows)

    best, last = None, n_blocks // 2
    for start, end in [(0, 1), *((i, min(i + ROUND_STEPS, last + 1)) for i in range(1, last + 1, ROUND_STEPS))]:
        # Block b meets block b + step, counted in a ring; half a ring away each pair would come twice.
        sides = []
        for step in range(start, end):
            for right in (False, True)[: 2 if step else 1]:
                left = F.pmod(F.col("own") - (step if right else 0), F.lit(n_blocks))
                met = left < step if 2 * step == n_blocks else F.lit(True)
                sides.append(F.struct(left.alias("left"), F.lit(step).alias("step"), F.lit(right).alias("right"), met.alias("met")))
        rows = unique.withColumn("least", F.lit(-1.0))
        if best is not None:
            least = F.when(F.count("dist") == k, 1 - F.max("dist")).otherwise(-1.0)
            rows = unique.join(best.groupBy("gid").agg(least.alias("least")), "gid", "left")
        placed = rows.withColumn("own", own).select("gid", "fp", "least", F.inline(F.filter(F.array(*sides), lambda s: s["met"]))).drop("met")
        # Four times as many partitions as pairs of blocks, so that few tasks get several of them.
        found = placed.repartition(4 * n_blocks * (end - start), "left", "step").groupBy("left", "step").applyInPandas(search, NEAREST_SCHEMA)
        if best is not None:
            found = found.unionByName(best)
        old, best = best, scratch.table(top_k(found, ["gid"], [F.col("dist"), F.col("other")], k).drop("rank"), "nearest")
        if old is not None:
            scratch.drop(old)
        del found, placed, rows
        scratch.collect()
    return best


def nearest_jaccard(
    left: pd.DataFrame, right: pd.DataFrame | None, k: int, n_bits: int, tiles: tuple[int, int] = TILE_ROWS, seed_rows: int = SEED_ROWS,
) -> pd.DataFrame:
    """The k nearest in ``right`` of each row of ``left`` and the other way round, by (distance, id); without ``right``, within ``left``.

    Rows (gid, fp, least) come as packed bits with the similarity below which a neighbour is of no use (-1: none is known). Rows are
    in order of their numbers of bits; of two groups, the one with fewer is read entry by entry. Shared bits are counted 64 pairs to a
    word; only pairs that can be among the k nearest of either row are then looked at one by one.
    """
    high, wide = tiles
    sides = [Fingerprints(s, k, n_bits, wide) for s in (left, right) if s is not None]
    a, b = sides[0], sides[-1]
    if right is None:
        # Rows of all sizes meet first: the nearest of a small row need not be small.
        chunk = np.arange(len(a.ids)) % -(-len(a.ids) // seed_rows)
        for number in range(chunk.max() + 1):
            a.meet_all(np.flatnonzero(chunk == number))
    for one, other in ((a, b), (b, a))[: len(sides)]:
        for g, rows in enumerate(one.groups):
            met = [
                t for t, tile in enumerate(other.groups)
                if (t >= g if one is other else one.middle[g] < other.middle[t] or one.middle[g] == other.middle[t] and one is a)
            ]
            for start in range(rows.start, rows.stop, high) if met else ():
                batch = np.arange(start, min(start + high, rows.stop))
                entries = one.entries(batch)
                for t in met:
                    i, j, shared = one.may_be_near(batch, entries, other, t)
                    if one is other:
                        new = (j > i) & (chunk[i] != chunk[j]) & (one.ids[i] != one.ids[j])
                        i, j, shared = i[new], j[new], shared[new]
                    near = shared / (one.sizes[i] + other.sizes[j] - shared)
                    one.add(i, near, other.ids[j])
                    other.add(j, near, one.ids[i])
    gid, other, near = (np.concatenate(x) for x in zip(*(s.rows() for s in sides)))
    return pd.DataFrame({"gid": gid, "other": other, "dist": 1.0 - near})


class Fingerprints:
    """Rows in order of their numbers of bits, in groups of ``wide`` at most, with the k nearest of each among those met so far."""

    def __init__(self, rows: pd.DataFrame, k: int, n_bits: int, wide: int) -> None:
        self.k, n = k, len(rows)
        bits = np.frombuffer(b"".join(rows["fp"]), np.uint8).reshape(n, -(-n_bits // 8))
        sizes = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        self.bits, self.sizes, self.ids = bits[order], sizes[order], rows["gid"].to_numpy()[order]
        self.least = rows["least"].fillna(-1.0).to_numpy()[order] if "least" in rows else np.full(n, -1.0)
        self.near, self.others = np.full((n, k), -1.0), np.zeros((n, k), np.int64)
        cuts = np.linspace(0, n, -(-n // wide) + 1).astype(int) if n else [0]
        self.groups = [slice(x, y) for x, y in zip(cuts[:-1], cuts[1:])]
        self.middle = [int(self.sizes[(g.start + g.stop) // 2]) for g in self.groups]
        self.words = [bit_columns(self.bits[g]) for g in self.groups]

    def entries(self, batch: np.ndarray) -> np.ndarray:
        """On-bits of the rows, a column for each row, filled up with the number of a column without bits."""
        row, bit = np.nonzero(np.unpackbits(self.bits[batch], axis=1))
        size = self.sizes[batch]
        out = np.full((size.max(), len(batch)), 8 * self.bits.shape[1])
        out[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), row] = bit
        return out

    def bound(self, rows) -> np.ndarray:
        """A similarity that the k nearest of these rows reach."""
        return np.maximum(self.near[rows, -1], self.least[rows])

    def may_be_near(self, batch: np.ndarray, entries: np.ndarray, other: Fingerprints, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, row of ``other``, shared bits) of all pairs of the batch and group ``t`` whose similarity reaches the bound of either."""
        tile = other.groups[t]
        starts = np.arange(tile.start, tile.stop, 64)
        size, fewest, most = self.sizes[batch, None], other.sizes[starts], other.sizes[np.minimum(starts + 63, tile.stop - 1)]
        bound = np.minimum(self.bound(batch)[:, None], np.minimum.reduceat(other.bound(tile), starts - tile.start))
        bound = np.maximum(bound, 0.0)
        # For each word: shared / (size + other size - shared) >= bound, with room for rounding.
        wanted = np.ceil(bound * (size + fewest) / (1.0 + bound) - 1e-6).astype(np.int64)
        can = wanted <= np.minimum(size, most)
        kept = np.flatnonzero(can.any(axis=1))
        if not len(kept):
            return (np.zeros(0, np.int64),) * 3
        planes = column_counts(other.words[t], entries[: self.sizes[batch[kept]].max(), kept])
        wanted, can = wanted[kept], can[kept] & (wanted[kept] >> len(planes) == 0)
        reached = np.where(can, ~np.uint64(0), np.uint64(0))
        for w, plane in enumerate(planes):
            needs = -(wanted >> w & 1).view(np.uint64)
            reached = plane & reached | ~needs & (plane | reached)
        reached[~can] = 0
        row, word = np.nonzero(reached)
        at, bit = np.nonzero(np.unpackbits(reached[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        row, word = row[at], word[at]
        column = 64 * word + bit
        real = column < tile.stop - tile.start
        row, word, bit, column = row[real], word[real], bit[real].astype(np.uint64), column[real]
        shared = np.zeros(len(row), np.int64)
        for w, plane in enumerate(planes):
            shared += (plane[row, word] >> bit & np.uint64(1)).astype(np.int64) << w
        return batch[kept[row]], tile.start + column, shared

    def meet_all(self, rows: np.ndarray) -> None:
        """Each of these rows meets those with another id."""
        x = np.unpackbits(self.bits[rows], axis=1).astype(np.float32)
        shared = (x @ x.T).astype(np.float64)
        near = shared / (self.sizes[rows, None] + self.sizes[None, rows] - shared)
        near[self.ids[rows, None] == self.ids[None, rows]] = -1.0
        k = min(self.k, len(rows) - 1)
        if k:
            i, j = np.nonzero(near >= np.maximum(np.partition(near, -k, axis=1)[:, -k], 0.0)[:, None])
            self.add(rows[i], near[i, j], self.ids[rows[j]])

    def add(self, at: np.ndarray, near: np.ndarray, ids: np.ndarray) -> None:
        """Rows ``at`` have met ``ids``."""
        last = self.near[at, -1]
        useful = ((near > last) | (near == last) & (ids < self.others[at, -1])) & (near >= self.least[at] - 1e-9)
        if not useful.any():
            return
        order = np.flatnonzero(useful)[np.argsort(at[useful], kind="stable")]
        at, near, ids = at[order], near[order], ids[order]
        rows, first, count = np.unique(at, return_index=True, return_counts=True)
        many = count > FEW
        if many.any():
            self._merge(rows[many], *(x[np.repeat(many, count)] for x in (at, near, ids)))
        first, count = first[~many], count[~many]
        for place in range(count.max(initial=0)):
            new = first[count > place] + place
            self._insert(at[new], near[new, None], ids[new, None])

    def _insert(self, rows: np.ndarray, value: np.ndarray, id_: np.ndarray) -> None:
        """One more neighbour of each of these rows."""
        near, others = self.near[rows], self.others[rows]
        ahead = (near > value) | (near == value) & (others < id_)
        here = np.arange(self.k) == ahead.sum(axis=1)[:, None]
        for held, kept, new in ((self.near, near, value), (self.others, others, id_)):
            held[rows] = np.where(ahead, kept, np.where(here, new, np.roll(kept, 1, axis=1)))

    def _merge(self, rows: np.ndarray, at: np.ndarray, near: np.ndarray, ids: np.ndarray) -> None:
        row = np.concatenate([np.repeat(rows, self.k), at])
        value = np.concatenate([self.near[rows].ravel(), near])
        id_ = np.concatenate([self.others[rows].ravel(), ids])
        order = np.lexsort((id_, -value, row))
        row, value, id_ = row[order], value[order], id_[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.near[row[kept], place[kept]] = value[kept]
        self.others[row[kept], place[kept]] = id_[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self.near >= 0
        return np.repeat(self.ids, known.sum(axis=1)), self.others[known], self.near[known]


def bit_columns(bits: np.ndarray) -> np.ndarray:
    """Packed rows turned round: for each entry the rows that have it, 64 to a word; then a column without any."""
    x = np.unpackbits(bits, axis=1)
    x = np.pad(x, ((0, -len(x) % 64), (0, 0)))
    words = np.packbits(np.ascontiguousarray(x.T), axis=1, bitorder="little").view(np.uint64)
    return np.pad(words, ((0, 1), (0, 0)))


def column_counts(words: np.ndarray, entries: np.ndarray, at_once: int = 16) -> list[np.ndarray]:
    """How many of the columns ``entries`` (a query in each column) of ``words`` have a bit, as binary digits, lowest first.

    Digits of one place wait until there are three, which become one of that place and one of the next.
    """
    waiting: list[list[np.ndarray]] = [[]]

    def push(place: int, x: np.ndarray) -> None:
        while True:
            if place == len(waiting):
                waiting.append([])
            if len(waiting[place]) < 2:
                waiting[place].append(x)
                return
            y, z = waiting[place]
            carry = y & z
            np.bitwise_xor(y, z, out=y)
            np.bitwise_and(y, x, out=z)
            np.bitwise_or(carry, z, out=carry)
            np.bitwise_xor(x, y, out=x)
            waiting[place] = [x]
            place, x = place + 1, carry

    for start in range(0, len(entries), at_once):
        for x in words.take(entries[start : start + at_once], axis=0):
            push(0, x)
    place = 0
    while place < len(waiting):
        if len(waiting[place]) == 2:
            y, z = waiting[place]
            waiting[place] = [y ^ z]
            push(place + 1, y & z)
        place += 1
    return [held[0] for held in waiting]
