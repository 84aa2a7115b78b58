"""Fill-in-middle transformation: prefix, suffix and middle of a text, cut at units and put in another order.

Cuts are found over UTF-8 bytes. A sparse index of exceptions holds, for the multibyte characters of a piece of texts only,
their position and the excess bytes before them; a binary search in it turns a byte into a code point or back, and in a span
without exceptions the two differ by a constant. A unit is a line with its line feed, or a single character.

Which cut and form a document gets follows from four numbers, the leading 32-bit groups of sha256 of ``seed:doc_id``, so reruns
and retried tasks agree.

Cases: a null text counts as empty and, like a text that holds a sentinel, stays plain; a null doc_id counts as an empty one;
rows that repeat a doc_id draw the same numbers and are cut by their own text; an empty table gives an empty result; a text of
any length is handled whole, alone in its piece; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import pieces

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("lines", "chars")


class Exceptions(NamedTuple):
    """Multibyte characters of a piece in order: the byte each starts at, and the excess bytes of all before it (one more entry)."""

    at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        own = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        return cls(at, np.concatenate([[0], np.cumsum(own)]))

    def chars(self, byte: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Code points between the bytes ``zero`` and ``byte``, both at starts of characters."""
        seen = self.excess[np.searchsorted(self.at, byte)] - self.excess[np.searchsorted(self.at, zero)]
        return byte - zero - seen

    def bytes(self, char: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """The byte at which the ``char``-th code point after the byte ``zero`` starts."""
        before = np.searchsorted(self.at, zero)
        # code points before each exception, counted from the start of the piece
        points = self.at - self.excess[:-1]
        origin = zero - self.excess[before]
        k = np.searchsorted(points, origin + char)
        return zero + char + self.excess[k] - self.excess[before]


def _draws(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """A text without sentinels must be found again: no sentinel may begin inside another one."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")
    if len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ")


def transform(docs: DataFrame, seed: int = 7, units: str = "lines", rate: int = 100, spm: int = 50,
              sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each row of ``docs``.

    ``n`` counts units. Of 100 texts about ``rate`` are cut, of 100 that are cut about ``spm`` put the suffix first (form spm, else
    psm); the others are plain. The prefix ends after the smaller, the middle after the larger of two drawn numbers of units.
    """
    if units not in UNITS:
        raise ValueError(f"units are one of {UNITS}")
    check_sentinels(sentinels)
    p, s, m = (x.encode() for x in sentinels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            for begin, data, offset in pieces(batch.column(1)):
                rows = len(offset) - 1
                yield _cut(batch.column(0).slice(begin, rows), data, offset, draws[:, begin:begin + rows])

    def _cut(ids: pa.Array, data: np.ndarray, offset: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        index, zero, end = Exceptions.of(data), offset[:-1], offset[1:]
        if units == "lines":
            feeds = np.flatnonzero(data == 10)
            first = np.searchsorted(feeds, offset)
            full = end > zero
            open_end = np.zeros(len(zero), bool)
            open_end[full] = data[end[full] - 1] != 10
            n = np.diff(first) + open_end

            def cut(k: np.ndarray) -> np.ndarray:
                # after k line feeds; a last line without one ends with the text
                last = np.minimum(first[:-1] + np.maximum(k, 1) - 1, max(len(feeds) - 1, 0))
                after = feeds[last] + 1 if len(feeds) else np.zeros_like(k)
                return np.where(k == 0, zero, np.where(k == n, end, after))
        else:
            n = index.chars(end, zero)
            cut = lambda k: index.bytes(k, zero)
        a, b = h[0] % (n + 1), h[1] % (n + 1)
        i, j = cut(np.minimum(a, b)), cut(np.maximum(a, b))
        prefix, middle = index.chars(i, zero), index.chars(j, i)
        forms, out = [], []
        for r in range(len(zero)):
            text = data[zero[r]:end[r]].tobytes()
            if not text or h[2, r] % 100 >= rate or p in text or s in text or m in text:
                forms.append("plain")
                out.append(text)
                continue
            x, y = i[r] - zero[r], j[r] - zero[r]
            if h[3, r] % 100 < spm:
                forms.append("spm")
                out.append(b"".join((s, text[y:], p, text[:x], m, text[x:y])))
            else:
                forms.append("psm")
                out.append(b"".join((p, text[:x], s, text[y:], m, text[x:y])))
        plain = np.array([f == "plain" for f in forms], bool)
        texts = pa.array(out, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), texts],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *_draws(seed)).mapInArrow(
        work, f"doc_id {ids}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(output, "|".join("\\Q" + x + "\\E" for x in sentinels), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
