"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are put in lexicographic order of their label and a string of random projection bits,
and each is compared with the next ``window`` ones. Pairs with cosine >= ``least`` are links; links of all passes
are united. Within each component so found the remaining links are counted in tiles, so that a group of
near copies larger than the window loses none.

Equal vectors of a label are one class and are compared once. Vectors that are null, empty, zero or hold null or
non-finite numbers, and rows without label, link with nothing; so do vectors of different length. Ties of the
sort are ordered by vec_id. Rows that repeat a vec_id are one vector (the smallest of their vectors and labels
counts). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .joins import join_narrow, shared_table

TILE = 512  # classes in one block of a component
BITS = 96


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bits(x: np.ndarray, seed: int) -> list[str]:
    """BITS random projection signs of each row as a string that sorts like them."""
    planes = np.random.default_rng([20, seed, x.shape[1]]).standard_normal((x.shape[1], BITS))
    return [bytes(b).hex() for b in np.packbits(x @ planes > 0, axis=1)]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, cls) and classes (cls, label, x, n), written; ``cls`` is the smallest vec_id of its vector and label."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fit = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    # one row for each vec_id; adding 0.0 makes -0.0 equal to 0.0
    rows = vectors.where(fit & F.col("vec_id").isNotNull()).select(
        "vec_id", F.struct(F.col("label").alias("label"), F.transform(x, lambda v: v + 0.0).alias("x")).alias("k"))
    rows = shared_table(rows.groupBy("vec_id").agg(F.min("k").alias("k")), "vectors")
    heads = shared_table(rows.groupBy("k").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n")), "vector-classes")
    key = F.xxhash64("k")
    # members meet their class by hash, then by value; a hot class is dealt over salts
    salted = rows.select("vec_id", F.col("k").alias("_k"), key.alias("h"), F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("s"))
    copies = heads.select("cls", "k", key.alias("h2"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("s2"))
    members = salted.join(copies, (F.col("h") == F.col("h2")) & (F.col("s") == F.col("s2")) & (F.col("_k") == F.col("k"))).select("vec_id", "cls")
    return shared_table(members, "vector-members"), heads.select("cls", "k.label", "k.x", "n")


def found_links(heads: DataFrame, least: float = 0.98, passes: int = 12, window: int = 32) -> DataFrame:
    """(a, b) with a < b: classes found to be linked. A task holds one batch and ``window`` rows before it."""
    sized = heads.withColumn("dim", F.size("x"))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, part in f.groupby("dim", sort=False):
                x = _unit(_matrix(part["x"]))
                for p in range(passes):
                    yield pd.DataFrame({"pass": p, "label": part["label"], "dim": part["dim"], "key": _bits(x, p), "cls": part["cls"], "x": list(x)})

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for f in frames:
            f = f if tail is None else pd.concat([tail, f], ignore_index=True)
            known = 0 if tail is None else len(tail)
            for (_, _, _), part in f.groupby(["pass", "label", "dim"], sort=False):
                at, x, c = part.index.to_numpy(), _matrix(part["x"]), part["cls"].to_numpy()
                for step in range(1, min(window, len(part) - 1) + 1):
                    near = ((x[:-step] * x[step:]).sum(axis=1) >= least - 1e-9) & (at[step:] >= known)
                    if near.any():
                        a, b = c[:-step][near], c[step:][near]
                        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            tail = f.iloc[-window:].reset_index(drop=True)

    kind = heads.schema["label"].dataType.simpleString()
    ids = heads.schema["cls"].dataType.simpleString()
    rows = sized.mapInPandas(keyed, f"pass int, label {kind}, dim int, key string, cls {ids}, x array<double>")
    ordered = rows.repartitionByRange("pass", "label", "dim", "key", "cls").sortWithinPartitions("pass", "label", "dim", "key", "cls")
    pairs = ordered.mapInPandas(compared, f"a {ids}, b {ids}").distinct()
    one = heads.select(F.col("cls").alias("a"), F.col("x").alias("xa"))
    two = heads.select(F.col("cls").alias("b"), F.col("x").alias("xb"))
    return pairs.join(one, "a").join(two, "b").where(cosine(F.col("xa"), F.col("xb")) >= least).select("a", "b")


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def link_counts(heads: DataFrame, comps: DataFrame, least: float = 0.98) -> DataFrame:
    """(cls, linked): vectors of other classes of the component within reach, counted tile by tile.

    A component is cut into tiles of about TILE classes; each pair of tiles is one group, so a group never
    holds more than two, and only counts leave it.
    """
    rows = comps.select(F.col("node").alias("cls"), "component").join(heads, "cls")
    size = rows.groupBy("component").agg(F.count("*").alias("size")).select("component", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    rows = join_narrow(rows, shared_table(size, "component-sizes"), ["component"], F.col("cls")).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles").cast("bigint")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("i"), F.greatest("tile", t).alias("j")))
    spread = rows.select("component", "cls", "n", "x", "tile", F.inline(pair))
    ids = heads.schema["cls"].dataType.simpleString()

    def count(f: pd.DataFrame) -> pd.DataFrame:
        i, j = int(f["i"].iloc[0]), int(f["j"].iloc[0])
        left, right = f[f["tile"] == i], f[f["tile"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"cls": [], "linked": []})
        x, y = _unit(_matrix(left["x"])), _unit(_matrix(right["x"]))
        near = x @ y.T >= least
        near &= left["cls"].to_numpy()[:, None] != right["cls"].to_numpy()[None, :]
        a = pd.DataFrame({"cls": left["cls"], "linked": near @ right["n"].to_numpy()})
        if i == j:
            return a
        return pd.concat([a, pd.DataFrame({"cls": right["cls"], "linked": left["n"].to_numpy() @ near})])

    parts = spread.groupBy("component", "i", "j").applyInPandas(count, f"cls {ids}, linked bigint")
    return parts.groupBy("cls").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, least: float = 0.98, passes: int = 12, window: int = 32) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each vec_id."""
    members, heads = classes(vectors.select("vec_id", "embedding", "label"))
    links = shared_table(found_links(heads, least, passes, window), "vector-links")
    comps = shared_table(components(links), "vector-components")
    linked = shared_table(link_counts(heads, comps, least), "vector-counts")
    info = heads.select("cls", "n").join(comps.withColumnRenamed("node", "cls"), "cls", "left").join(linked, "cls", "left")
    info = info.select("cls", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    copies = info.select("cls", "n_links", "component_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("s"))
    placed = members.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int")).join(copies, ["cls", "s"])
    out = vectors.select("vec_id").distinct().join(placed.select("vec_id", "n_links", "component_id"), "vec_id", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
