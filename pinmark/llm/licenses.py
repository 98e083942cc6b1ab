"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

# Phrases that are looked for word by word, and the label of each.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Usual license notices, and the label of each.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Released under the MIT License": "mit",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl-notice",
    "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License": "lgpl-notice",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit-notice",
    "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted": "isc",
    "Licensed under CC BY 4.0": "cc-by-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4.0",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "creative-commons",
    "This is free and unencumbered software released into the public domain": "unlicense",
}

#: The share of a template's different words that a block must hold.
CONTAINMENT = 0.8

#: A block goes on with the next lines as long as all of them together have at most that many times the template's words.
BLOCK_SHARE = 2

_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def words_of(text: str) -> list[str]:
    """Words in lower case (A-Z), split at ASCII characters that are no letters or digits."""
    data, offsets = tokens.text_bytes(pa.array([text]))
    data = tokens.fold(data)
    found = tokens.split(data, offsets, tokens.MARKS)
    return [bytes(data[a:b]).decode() for a, b in zip(found.starts, found.ends)]


@dataclass
class Lexicon:
    """The words of all phrases and templates: a bounded list, known before the corpus is read."""

    words: list[str]
    hashes: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(texts: Mapping[str, str]) -> Lexicon:
        words = sorted({w for t in texts for w in words_of(t)})
        data, offsets = tokens.text_bytes(pa.array(words))
        hashes = tokens.slices_hash(data, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        return Lexicon(words, hashes[order], order)

    def ids(self, data: np.ndarray, found: tokens.Words) -> np.ndarray:
        """The number of each word that is in the lexicon, -1 for others."""
        hashes = tokens.slices_hash(data, found.starts, found.ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        out = np.full(len(hashes), -1, np.int64)
        out[hit] = self.order[at[hit]]
        return out


def _read(column: pa.Array, lexicon: Lexicon):
    """Words, their numbers, and for each word the line that it lies in, counted over the batch."""
    data, offsets = tokens.text_bytes(column)
    data = tokens.fold(data)
    found = tokens.split(data, offsets, tokens.MARKS)
    breaks = np.concatenate([[0], np.cumsum(_NEWLINE[data])])
    return found, lexicon.ids(data, found), breaks[found.starts] + found.rows


def _block_words(ids: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different (block, word) pairs, in order."""
    known = ids >= 0
    pairs = np.unique(blocks[known] * size + ids[known])
    return pairs // size, pairs % size


@dataclass
class _Template:
    label: str
    words: np.ndarray  # in the global order, rarest first
    needed: int

    @property
    def prefix(self) -> int:
        return len(self.words) - self.needed + 1


def _block_ends(lines: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line with words the place of its first word, and the place behind the last word of the block it begins."""
    first = np.flatnonzero(np.append(True, lines[1:] != lines[:-1])) if len(lines) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(lines))[: len(first)]
    reach = np.searchsorted(ends, first + most, "right") - 1
    last_of_row = np.searchsorted(rows[first], rows[first], "right") - 1
    return first, ends[np.maximum(np.minimum(reach, last_of_row), np.arange(len(first)))]


def _candidates(ranks: np.ndarray, lines: np.ndarray, rows: np.ndarray, template: _Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different (first line, word of the template) pairs, in order, of the blocks that may hold it.

    ``ranks``: the place of each word in the global order, -1 for words that are not in the lexicon. A block is left out if
    it has fewer of the template's words than are needed, or none of its prefix.
    """
    first, ends = _block_ends(lines, rows, BLOCK_SHARE * len(template.words))
    kind = np.zeros(size + 1, np.int8)  # the last one is what -1 finds
    kind[template.words] = 1
    kind[template.words[: template.prefix]] = 2
    kinds = kind[ranks]
    known = np.flatnonzero(kinds)
    low, high = np.searchsorted(known, first), np.searchsorted(known, ends)
    before = np.concatenate([[0], np.cumsum(kinds[known] == 2)])
    held = np.flatnonzero((high - low >= template.needed) & (before[high] > before[low]))
    counts = (high - low)[held]
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    words = ranks[known[np.repeat(low[held], counts) + within]]
    pairs = np.unique(np.repeat(lines[first[held]], counts) * size + words)
    return pairs // size, pairs % size


def matches(blocks: np.ndarray, ranks: np.ndarray, templates: list[_Template]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(block, overlap, template) of all blocks that hold ``needed`` words of a template.

    ``blocks`` and ``ranks``: the lexicon words of each block as places in the global order, sorted. A block that holds
    ``needed`` of a template's words holds one of its ``prefix`` rarest, and at least ``needed`` words; and from the first
    common word on, neither side may have too few words left.
    """
    out = []
    if not len(blocks):
        return out
    names, first, sizes = np.unique(blocks, return_index=True, return_counts=True)
    inside = np.repeat(np.arange(len(names)), sizes)
    left_in_block = sizes[inside] - (np.arange(len(blocks)) - first[inside])
    for number, template in enumerate(templates):
        place = np.full(int(max(ranks.max(), template.words.max())) + 1, -1, np.int64)
        place[template.words] = np.arange(len(template.words))
        at = place[ranks]
        probe = np.flatnonzero((at >= 0) & (at < template.prefix))  # prefix filter
        if not len(probe):
            continue
        owner, head = np.unique(inside[probe], return_index=True)
        probe = probe[head]  # the rarest common word of each block
        bound = np.minimum(len(template.words) - at[probe], left_in_block[probe])
        holds = (sizes[owner] >= template.needed) & (bound >= template.needed)  # length and positional filters
        candidates = np.zeros(len(names), bool)
        candidates[owner[holds]] = True
        overlap = np.bincount(inside[(at >= 0) & candidates[inside]], minlength=len(names))
        good = np.flatnonzero(overlap >= template.needed)
        if len(good):
            out.append((names[good], overlap[good], number))
    return out


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) of each row's whole text.

    Base: places where the words of a phrase stand one after the other; n_base counts them all, first_word and last_word
    are the least and greatest place. Every line with words begins a block, which goes on with the next lines of the text as
    long as it has at most ``BLOCK_SHARE`` times the template's words, so a notice may be wrapped and two short ones do not
    make a third; a longer line is a block of its own. Blocks that hold at least ``containment`` of the different words of a template are found: ``blocks`` lists (first line, template
    label, score), ``score`` is the best of them or 0. labels holds the labels of phrases and of templates. Null texts are
    empty; rows without a match have empty labels and null places. Every row gives a row, repeated rows the same one; an
    empty table gives none. Other columns are not read.

    Two passes over the texts, nothing of which is exchanged: the first counts in how many lines each of the lexicon's
    words occurs, over all rows, which fixes the global order of words; the second probes. The templates and counts are as
    many as the lexicon has words.
    """
    lexicon = Lexicon.of({**phrases, **templates})
    size = len(lexicon.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                _, ids, blocks = _read(batch.column(0).slice(start, 512), lexicon)
                total += np.bincount(_block_words(ids, blocks, size)[1], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["word", "n"])

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    counted = narrow.select("text").mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = dict(counted)
    rank = np.empty(size, np.int64)
    rank[sorted(range(size), key=lambda i: (frequency.get(i, 0), lexicon.words[i]))] = np.arange(size)
    numbers = {w: i for i, w in enumerate(lexicon.words)}
    sets = []
    for text, label in templates.items():
        words = sorted({int(rank[numbers[w]]) for w in words_of(text)})
        sets.append(_Template(label, np.array(words), max(1, ceil(containment * len(words) - 1e-9))))
    sequences = [([numbers[w] for w in words_of(text)], label) for text, label in phrases.items()]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield _probed(batch.slice(start, 512), lexicon, rank, sets, sequences)

    added = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<line: bigint, label: string, score: double>>"
    schema = T.StructType([narrow.schema["id"], *T._parse_datatype_string(added).fields])
    return narrow.mapInArrow(probe, schema)


def _probed(batch: pa.RecordBatch, lexicon: Lexicon, rank: np.ndarray, sets: list[_Template], sequences) -> pa.RecordBatch:
    found, ids, blocks = _read(batch.column(1), lexicon)
    n, rows = batch.num_rows, found.rows
    base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for words, label in sequences:
        last = len(ids) - len(words) + 1
        if last <= 0:
            continue
        here = np.ones(last, bool)
        for k, word in enumerate(words):
            here &= ids[k : k + last] == word
        at = np.flatnonzero(here)
        at = at[rows[at] == rows[at + len(words) - 1]]
        for i in at.tolist():
            base[rows[i]].append((i - int(found.first[rows[i]]), label))
    ranks = np.where(ids >= 0, rank[ids], -1)
    # Line numbers go on from row to row: the first word of a line tells its row, and the row its first line.
    lines: list[list[dict]] = [[] for _ in range(n)]
    row_first = _first_blocks(batch.column(1))
    for template in sets:
        for names, overlaps, _ in matches(*_candidates(ranks, blocks, rows, template, len(rank)), [template]):
            owners = rows[np.searchsorted(blocks, names)]
            for name, row, overlap in zip(names.tolist(), owners.tolist(), overlaps.tolist()):
                lines[row].append({"line": name - int(row_first[row]), "label": template.label, "score": overlap / len(template.words)})
    for row in lines:
        row.sort(key=lambda b: (b["line"], b["label"]))
    join = lambda labels: ",".join(sorted(set(labels)))
    columns = {
        "id": batch.column(0),
        "n_words": pa.array(found.counts, pa.int64()),
        "n_base": pa.array([len(b) for b in base], pa.int64()),
        "first_word": pa.array([min(b)[0] if b else None for b in base], pa.int64()),
        "last_word": pa.array([max(b)[0] if b else None for b in base], pa.int64()),
        "base_labels": pa.array([join(label for _, label in b) for b in base], pa.string()),
        "labels": pa.array([join([label for _, label in b] + [x["label"] for x in l]) for b, l in zip(base, lines)], pa.string()),
        "score": pa.array([max((x["score"] for x in l), default=0.0) for l in lines], pa.float64()),
        "blocks": pa.array(lines, pa.list_(pa.struct({"line": pa.int64(), "label": pa.string(), "score": pa.float64()}))),
    }
    return pa.RecordBatch.from_pydict(columns)


def _first_blocks(column: pa.Array) -> np.ndarray:
    """The number that the first line of each row has in ``_read``."""
    data, offsets = tokens.text_bytes(column)
    breaks = np.concatenate([[0], np.cumsum(_NEWLINE[data])])
    return breaks[offsets[:-1]] + np.arange(len(offsets) - 1)
