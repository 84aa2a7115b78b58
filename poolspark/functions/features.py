"""Hashed n-gram fingerprints and string profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_RADIUS = 2
DEFAULT_BITS = 2048
DESCRIPTORS = (
    "length",
    "n_words",
    "n_digits",
    "n_upper",
    "n_punct",
    "vowel_ratio",
    "mean_word",
    "space_ratio",
)


def text_units(text: Column, unit: str = "char") -> Column:
    """Characters or words of a text, as an array."""
    if unit == "char":
        return F.split(text, "")
    if unit == "word":
        return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")
    raise ValueError("unit must be one of: 'char', 'word'")


def ngrams(units: Column, size: int, unit: str = "char") -> Column:
    """All runs of ``size`` consecutive units, joined to strings; NULL if there are too few.

    Shifted copies of the array are zipped, which stays linear in the text length. Taking a
    substring per position would rescan a UTF-8 string from its start each time, and reading the
    array inside a lambda would build it again for every position.
    """
    glue = F.lit("" if unit == "char" else " ")
    grams = units
    for shift in range(1, size):
        # zip_with pads the shorter side with NULL and concat turns those tails into NULL.
        tail = F.slice(units, F.lit(shift + 1), F.greatest(F.size(units) - shift, F.lit(0)))
        grams = F.zip_with(grams, tail, lambda left, right: F.concat(left, glue, right))
    return F.when(F.size(units) >= size, F.filter(grams, lambda g: g.isNotNull()))


def hashed_bits(grams: Column, n_bits: int = DEFAULT_BITS, method: str = "xxhash64") -> Column:
    """Sorted distinct bit numbers of an array of strings."""
    if method == "xxhash64":
        bit = lambda g: F.pmod(F.xxhash64(g), F.lit(n_bits)).cast("int")
    elif method == "md5":
        bit = lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint") % n_bits).cast("int")
    else:
        raise ValueError("method must be one of: 'xxhash64', 'md5'")
    # Repeated grams are dropped before hashing: long texts repeat themselves a lot.
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(grams), bit)))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def profile(text: Column) -> dict[str, Column]:
    """Eight numeric descriptors of a string, by DESCRIPTORS name."""
    n = F.length(text)
    size = F.nullif(n, F.lit(0)).cast("double")
    n_words = F.length(F.regexp_replace(F.regexp_replace(text, "[^ \t\r\n]+", "w"), "[ \t\r\n]+", ""))
    n_space = _count(text, " ")
    return {
        "length": n,
        "n_words": n_words,
        "n_digits": _count(text, "0123456789"),
        "n_upper": _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_punct": _count(text, ".,;:!?()"),
        "vowel_ratio": _count(text, "aeiouAEIOU") / size,
        "mean_word": (n - n_space) / F.nullif(n_words, F.lit(0)).cast("double"),
        "space_ratio": n_space / size,
    }
