"""Features and descriptors as columns of the keyed table."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolspark.functions.features import DEFAULT_BITS, DEFAULT_RADIUS, hashed_bits, ngrams, profile, text_units

try:  # three times as fast on short texts as the one that hashlib takes from OpenSSL
    from _md5 import md5
except ImportError:
    from hashlib import md5

WORD = re.compile(rb"[^ \t\r\n]+")


def add_fingerprint(
    df: DataFrame, text: str, out: str = "fp", radius: int = DEFAULT_RADIUS, n_bits: int = DEFAULT_BITS,
    unit: str = "char", method: str = "xxhash64", valid_only: bool = False,
) -> DataFrame:
    """On-bits of the n-grams that span ``radius`` units to each side; NULL for rows too short.

    The text is split in a projection of its own, so the split is not repeated for every shift.
    ``valid_only`` drops short rows by their number of units: a filter on the result would be
    pushed down and compute every fingerprint twice. MD5 of words is taken in Arrow batches, where
    no array of n-grams is built and digests are not spelled out; the bits are the same.
    """
    if unit == "word" and method == "md5":
        enough = rf"^[ \t\r\n]*+(?:[^ \t\r\n]++[ \t\r\n]++){{{2 * radius - 1}}}[^ \t\r\n]"
        rows = df.where(F.col(text).rlike(enough)) if valid_only else df
        return rows.withColumn(out, _md5_bits(2 * radius, n_bits)(F.col(text)))
    split = df.withColumn("_units", text_units(F.col(text), unit))
    if valid_only:
        split = split.where(F.size("_units") >= 2 * radius)
    grams = split.withColumn("_grams", ngrams(F.col("_units"), 2 * radius, unit)).drop("_units")
    return grams.withColumn(out, hashed_bits(F.col("_grams"), n_bits, method)).drop("_grams")


def _md5_bits(size: int, n_bits: int):
    """As hashed_bits of ngrams of words, by MD5."""

    @F.pandas_udf("array<int>")
    def bits(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), None, dtype=object)
        for i in np.flatnonzero(texts.notna()):
            words = WORD.findall(texts.iloc[i].encode())
            if len(words) >= size:
                grams = set(map(b" ".join, zip(*(words[shift:] for shift in range(size)))))
                digests = b"".join([md5(g).digest()[:4] for g in grams])
                out[i] = np.unique(np.frombuffer(digests, ">u4") % n_bits).astype(np.int32)
        return pd.Series(out)

    return bits


def featurize(df: DataFrame, text: str, **options) -> DataFrame:
    """As add_fingerprint, keeping only the rows that could be featurised."""
    return add_fingerprint(df, text, valid_only=True, **options)


def add_profile(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns(profile(F.col(text)))


def dense_bits(df: DataFrame, fp: str = "fp", out: str = "features", n_bits: int = DEFAULT_BITS) -> DataFrame:
    """0/1 array of fixed width from on-bits, as the model operators expect it; NULL without on-bits array.

    Parquet stores such a column at about one bit per entry (two distinct values).
    """

    @F.pandas_udf("array<double>")
    def spread(bits: pd.Series) -> pd.Series:
        known = np.flatnonzero(bits.notna())
        x = np.zeros((len(known), n_bits))
        if len(known):
            held = bits.iloc[known]
            x[np.repeat(np.arange(len(known)), held.str.len()), np.concatenate(held.to_numpy()).astype(np.int64)] = 1.0
        out = pd.Series([None] * len(bits), dtype=object)
        out.iloc[known] = pd.Series(list(x), dtype=object).to_numpy()
        return out

    return df.withColumn(out, spread(F.col(fp)))


def packed_bits(df: DataFrame, fp: str = "fp", out: str = "packed", n_bits: int = DEFAULT_BITS) -> DataFrame:
    """On-bits as 64-bit words: 32 longs for 2048 bits."""

    def word(w):
        own = F.filter(fp, lambda b: F.shiftright(b, 6) == w)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b % 64)))

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(n_bits // 64 - 1)), word))


def as_vector(df: DataFrame, features: str = "features", out: str = "vector") -> DataFrame:
    """ml vector of an array column; a vector column is passed through."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df.withColumn(out, F.col(features))
    return df.withColumn(out, array_to_vector(features))


def align(features: DataFrame, labels: DataFrame, keys=("target", "mol_id")) -> DataFrame:
    """Features joined to labels or descriptors by key; rows without valid features drop out."""
    return features.join(labels, list(keys))
