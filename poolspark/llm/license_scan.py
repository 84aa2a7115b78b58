"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text. A block meets a template when it holds at least ``containment`` of the
template's distinct words. The templates' words are counted over the blocks of all documents; with each
template's words in ascending order of that count, a block that meets it must hold one of its first
``n - needed + 1`` words (prefix filter), have ``needed`` words at least (length filter), and, where its first
common word stands at place i, have enough of the template left after i (positional filter). Survivors are
counted exactly.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased A-Z. Cases: null and empty
texts have no words and no labels; ties of the word count are ordered by the word; repeated rows are scanned
alike; very long texts are pieces of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, Words, hashes, pieces, word_hash, words

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices as authors put them into files, and their labels.
TEMPLATES = (
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("licensed under the GNU General Public License, version 2", "gpl-2.0"),
    ("licensed under the GNU Lesser General Public License", "lgpl"),
    ("licensed under the GNU Affero General Public License", "agpl"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Released under the MIT License", "mit-notice"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit-text"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-text"),
    ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0-notice"),
    ("All rights reserved. No part of this publication may be reproduced without permission", "all-rights-reserved"),
)


def split_words(text: str) -> list[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    w = words(data, np.array([0, len(data)]), ALNUM)
    return [bytes(w.lower[a:b]).decode() for a, b in zip(w.start, w.end)]


def _ids(w: Words, known: np.ndarray) -> np.ndarray:
    """Place of each word's hash in the sorted ``known``, or -1."""
    h = hashes(w)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _blocks(w: Words) -> np.ndarray:
    """Block of each word: lines are numbered through the piece, rows begin new ones."""
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    return breaks[w.start] + w.row


def word_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """In how many blocks of all documents each word of the templates occurs. As many rows as the templates have words."""
    vocabulary = sorted({x for t, _ in templates for x in split_words(t)})
    known = np.array([word_hash(x) for x in vocabulary], np.uint64)
    order = np.argsort(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, data, offset in pieces(batch.column(0)):
                w = words(data, offset, ALNUM)
                ids, block = _ids(w, known[order]), _blocks(w)
                hit = ids >= 0
                pairs = np.unique(block[hit] * len(vocabulary) + ids[hit])
                total[order] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {r.word: r.n for r in rows}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), a row for each row of ``docs``.

    ``spans`` has (label, first word, last word, containment) of every block that meets a template; ``score`` is
    1 where a phrase stands, else the largest containment of the spans, else 0.
    """
    counts = word_counts(docs, templates)
    rank = {x: i for i, x in enumerate(sorted(counts, key=lambda x: (counts[x], x)))}
    sets = [(sorted(rank[x] for x in set(split_words(t))), label) for t, label in templates]
    extra = sorted({x for p, _ in phrases for x in split_words(p)} - set(rank))
    every = [*rank, *extra]  # place in this list = rank
    known = np.array([word_hash(x) for x in every], np.uint64)
    order = np.argsort(known)
    place = {x: i for i, x in enumerate(every)}
    sequences = [([place[x] for x in split_words(p)], label) for p, label in phrases]
    needed = [int(np.ceil(containment * len(s) - 1e-9)) for s, _ in sets]
    kept_id = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kept_id}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
              "spans array<struct<label:string,first:bigint,last:bigint,containment:double>>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offset in pieces(batch.column(1)):
                out = _piece(words(data, offset, ALNUM))
                ids = batch.column(0).slice(begin, len(offset) - 1)
                yield pa.RecordBatch.from_arrays([ids, *out], names=[x.split()[0] for x in schema.split(", ")])

    def _piece(w: Words) -> list[pa.Array]:
        found = _ids(w, known[order])
        ids = np.where(found >= 0, order[found], -1)
        n = np.diff(w.first)
        base: list[list[tuple[int, str]]] = [[] for _ in range(w.rows)]
        for seq, label in sequences:
            last = len(ids) - len(seq) + 1
            if last <= 0:
                continue
            ok = w.row[:last] == w.row[len(seq) - 1:]
            for k, x in enumerate(seq):
                ok &= ids[k:k + last] == x
            for at in np.flatnonzero(ok):
                base[w.row[at]].append((int(at - w.first[w.row[at]]), label))
        spans: list[list[dict]] = [[] for _ in range(w.rows)]
        block = _blocks(w)
        known_at = np.flatnonzero((ids >= 0) & (ids < len(rank)))
        held = ids[known_at]
        for (wanted, label), need in zip(sets, needed):
            prefix = wanted[:len(wanted) - need + 1]
            for b in np.unique(block[known_at[np.isin(held, prefix)]]):
                lo, hi = np.searchsorted(block, b), np.searchsorted(block, b, "right")
                if hi - lo < need:  # length
                    continue
                have = set(ids[lo:hi].tolist())
                firsts = next((i for i, x in enumerate(wanted) if x in have), len(wanted))
                if len(wanted) - firsts < need:  # position
                    continue
                share = sum(x in have for x in wanted)
                if share >= need:
                    row = w.row[lo]
                    spans[row].append({"label": label, "first": int(lo - w.first[row]), "last": int(hi - 1 - w.first[row]), "containment": share / len(wanted)})
        labels = [sorted({x for _, x in b}) for b in base]
        every_label = [sorted({*a, *(s["label"] for s in sp)}) for a, sp in zip(labels, spans)]
        score = [1.0 if b else max((s["containment"] for s in sp), default=0.0) for b, sp in zip(base, spans)]
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))
        return [pa.array(n.astype(np.int64)), pa.array([len(b) for b in base], pa.int64()), pa.array([min(b)[0] if b else None for b in base], pa.int64()),
                pa.array([max(b)[0] if b else None for b in base], pa.int64()), pa.array([",".join(x) for x in labels]), pa.array([",".join(x) for x in every_label]),
                pa.array(score, pa.float64()), pa.array(spans, kind)]

    return docs.select("doc_id", "text").mapInArrow(work, schema)
