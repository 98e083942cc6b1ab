"""The operators against plain Python on small tables with nulls, empty texts, ties, repeated rows and odd columns."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pinmark.llm import exact, licenses, lines, packing, pieces, quality, simhash, suffixes, tokens, toxicity, windows

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
TEXTS = [
    None,
    "",
    " \n\t",
    "a",
    "A b\tc",
    "a b c",
    "a  b c ",
    "x y z " * 40,
    "x y z " * 40,
    "one two three four five\nsix seven\none two three four five\nsix seven\nlast",
    "one two three four five\nsix seven\nlast",
    "été 日本 😀 " * 20,
    "w" * 3000,
    "Licensed under the Apache License, Version 2.0\nAll rights reserved. CC-BY cc by",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with gaps, one twice, one null; columns whose names the operators use themselves."""
    rows = [(3 * i % 31, t, "kept", i, i) for i, t in enumerate(TEXTS)]
    rows += [(None, "x y z " * 40, None, None, 1), (6, "a b c", "same", 5, 2), (6, "a b c", "same", 5, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, block bigint, id int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def in_order(rows):
    return sorted(rows, key=repr)


def test_exact_duplicates(docs, empty):
    rows = rows_of(docs)
    found = in_order((r.id, r.keep, r.group_size, r.sha) for r in exact.exact_duplicates(docs).collect())
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACE, "", t), []).append((-len(t), i is None, i))
    expected = []
    for i, t in rows:
        key = re.sub(SPACE, "", t)
        best = min(groups[key], key=lambda g: (g[0], g[1], g[2] or 0))
        expected.append((i, best[2], len(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    assert found == in_order(expected)
    assert exact.exact_duplicates(docs).where("kept").count() == len(groups)
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.exact_duplicates(empty).count() == 0 and exact.exact_dedup(empty).count() == 0


def test_exact_dedup_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    assert exact.exact_duplicates(docs).where("kept").count() == exact.exact_dedup(docs).count()


def fingerprint(text):
    words = re.findall(WORD.encode(), text.encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    rows = rows_of(docs)
    prints = [fingerprint(t) for _, t in rows]
    near = {p: {q for q in prints if (p ^ q).bit_count() <= 3} for p in prints}
    changed = True
    while changed:
        wider = {p: set().union(*(near[q] for q in near[p])) for p in near}
        changed, near = wider != near, wider
    least = {p: min((i for (i, _), q in zip(rows, prints) if q in near[p] and i is not None), default=None) for p in near}
    found = simhash.near_duplicates(docs).select("id", simhash.hexadecimal("fingerprint").alias("f"), "component").collect()
    assert in_order(map(tuple, found)) == in_order((i, f"{p:016x}", least[p]) for (i, _), p in zip(rows, prints))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_dedup(docs).columns == docs.columns


def test_pigeonring_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    prints = set(rng.integers(-(2**63), 2**63 - 1, 60).tolist())
    for p in list(prints):
        for n in (1, 2, 3, 4):
            q = p % 2**64
            for bit in rng.choice(64, n, replace=False).tolist():
                q ^= 1 << bit
            prints.add(q - 2**64 if q >= 2**63 else q)
    expected = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and ((a ^ b) % 2**64).bit_count() <= 3}
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    assert {(r.a, r.b) for r in simhash.links(df).collect()} == expected


def test_statistics_and_quality(spark, docs, empty):
    counts, _ = quality.statistics(pa.array(TEXTS))
    for text, found in zip(TEXTS, counts.tolist()):
        text = text or ""
        words = re.findall(WORD, text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert found == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)]
    good = [(100 + i, " ".join(f"word{i}x{k}" for k in range(60)), 1) for i in range(60)]
    bad = [(300 + i, " ".join(f"word{i}x{k}%%%" for k in range(60)), 0) for i in range(20)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    forest = quality.fit(table, labels)
    judged = quality.judged(table, forest)
    narrow = quality.judged_measures(quality.measures(table), forest).withColumnRenamed("id", "doc_id")
    assert in_order(narrow.collect()) == in_order(judged.select(narrow.columns).collect())
    assert quality.judged_measures(quality.measures(empty), forest).count() == 0
    assert {r.doc_id for r in judged.where("kept").collect()} == {i for i, _, _ in good}
    none = quality.fit(empty, labels)
    assert quality.judged(docs, none).count() == docs.count()
    assert quality.judged(empty, none).count() == 0


def removed_by_windows(texts, width):
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    return [{i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)} for w in texts]


@pytest.mark.parametrize("size", [4 << 20, 300])
def test_windows(docs, empty, monkeypatch, size):
    monkeypatch.setattr(windows, "BLOCK_CHARS", size)
    monkeypatch.setattr(windows, "BUCKET_WINDOWS", max(10, size // 20))
    rows = rows_of(docs)
    for width in (2, 35):
        words = [re.findall(WORD, t) for _, t in rows]
        gone = removed_by_windows(words, width)
        expected = [(i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (i, _), w, g in zip(rows, words, gone)]
        found = windows.remove_repeated_windows(docs, width=width, one_space=True)
        assert in_order((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()) == in_order(expected)
    own = windows.remove_repeated_windows(docs)
    assert all(r.kept_text == (r.text or "") for r in own.where("n_removed = 0").collect())
    assert windows.remove_repeated_windows(empty).count() == 0


@pytest.mark.parametrize("size", [4 << 20, 200])
def test_suffixes(docs, empty, monkeypatch, size):
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", size)
    monkeypatch.setattr(suffixes, "BUCKET_CHARS", size)
    rows = rows_of(docs)
    key = [math.inf if i is None else i for i, _ in rows]
    for width in (4, 50):
        first = {}
        for k, (_, t) in zip(key, rows):
            b = t.encode()
            for p in range(len(b) - width + 1):
                first[b[p : p + width]] = min(first.get(b[p : p + width], math.inf), k)
        expected = []
        for k, (i, t) in zip(key, rows):
            b = t.encode()
            gone = {p + o for p in range(len(b) - width + 1) if first[b[p : p + width]] < k for o in range(width)}
            spans = sum(p - 1 not in gone for p in gone)
            expected.append((i, len(b), len(gone), spans, bytes(x for p, x in enumerate(b) if p not in gone)))
        found = suffixes.remove_repeated_bytes(docs, width=width).collect()
        assert in_order((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == in_order(expected)
    assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_strings_of_a_hot_gram_are_dealt_out():
    rng, phrase = np.random.default_rng(4), "a phrase that a third of all texts hold in their middle."
    odd = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = [odd(40) + phrase + odd(40) if i % 3 == 0 else odd(136) for i in range(900)]
    bits, blocks = 4, []
    for k in range(3):
        table = pa.table({"id": pa.array(range(k, 900, 3), pa.int64()), "text": texts[k::3]})
        # A third of each block's texts, in all blocks.
        table = pa.concat_tables([table.slice(0, 200), pa.table({"id": pa.array(range(1000 + k, 1300, 3), pa.int64()), "text": [odd(40) + phrase + odd(40) for _ in range(100)]})])
        blocks.append(suffixes._Asked(table, 50, bits))
    named = []
    for b in blocks:
        owners = [(0, b.chunk_owners().tobytes(), len(b.unique))]
        b.take_chunks(suffixes._answers(0, [(0, 0, payload, n) for _, payload, n in owners]))
        named.append((b.names, b.name_chars()))
    sizes, met = {}, {}
    for most in (1 << 30, 2000):
        total, buckets = Counter(), {}
        for b, payload in zip(blocks, suffixes._named(named, most)):
            b.take_names(suffixes._answers(1, [(0, 0, payload, len(b.names))]))
            for bucket, text, _, _ in b.segments():
                total[bucket] += len(text)
                for segment in text.split(b"\0"):
                    for p in range(len(segment) - 49):
                        buckets.setdefault(segment[p : p + 50], set()).add(bucket)
        sizes[most], met[most] = max(total.values()) / sum(total.values()), buckets
    assert sizes[1 << 30] > 0.3 and sizes[2000] < 0.15
    assert met[2000].keys() == met[1 << 30].keys() and all(len(x) == 1 for x in met[2000].values())


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_lines(spark, docs, empty, least):
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(rows_of(table))
    seen, expected = set(), []
    for i, text in rows:
        split = text.split("\n")
        gone = set()
        for p in range(len(split) - least + 1):
            run = tuple(split[p : p + least])
            if run in seen:
                gone |= set(range(p, p + least))
            seen.add(run)
        runs = sum(p - 1 not in gone for p in gone)
        expected.append((i, len(split), len(gone), runs, "\n".join(x for p, x in enumerate(split) if p not in gone)))
    found = lines.line_dedup(table, least=least)
    assert in_order(map(tuple, found.collect())) == in_order(expected)
    assert lines.line_dedup(docs, least=least).count() == docs.count()
    assert lines.line_dedup(empty, least=least).count() == 0


@pytest.mark.parametrize("least, words", [(1, 4), (3, 4), (3, 6), (4, 8)])
def test_short_runs_of_many_words(spark, docs, empty, least, words):
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    more = [(100, "p q r\ns t u\nv"), (101, "p q r\ns t u\nw"), (102, "one two three four five\nv"), (103, "a b c d e f g h\n1\na b c d e f g h")]
    table = table.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    seen, expected = set(), []
    for i, text in sorted(rows_of(table)):
        split, gone = text.split("\n"), set()
        for p in range(len(split)):
            for run in (tuple(split[p : p + d]) for d in range(1, least + 1) if p + d <= len(split)):
                if len(run) < least and len(re.findall(WORD, "\n".join(run))) < words:
                    continue
                gone |= set(range(p, p + len(run))) if run in seen else set()
                seen.add(run)
        runs = sum(p - 1 not in gone for p in gone)
        expected.append((i, len(split), len(gone), runs, "\n".join(x for p, x in enumerate(split) if p not in gone)))
    found = lines.line_dedup(table, least=least, words=words)
    assert in_order(map(tuple, found.collect())) == in_order(expected)
    assert lines.line_dedup(empty, least=least, words=words).count() == 0


def test_pieces(docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = pieces.encode_documents(docs, dropout=0.0).collect()
    texts = Counter((r.doc_id, tuple(model.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.id, tuple(r.pieces)) for r in plain) == texts
    dropped = pieces.encode_documents(docs, dropout=0.3)
    assert all(r.lossless for r in dropped.collect())
    assert in_order(map(tuple, dropped.collect())) != in_order(map(tuple, pieces.encode_documents(docs, dropout=0.3, seed=2).collect()))
    back = in_order((r.id, r.text) for r in pieces.decode_documents(dropped).collect())
    assert back == in_order((i, t) for i, t in rows_of(docs))
    assert pieces.encode_documents(empty).count() == 0


def test_long_runs_are_merged_alike(monkeypatch):
    vocabulary = pieces.Vocabulary.load()
    texts = ["the " * 20, "unbelievable▁things", "x" * 50, None, "日本😀"]
    keys = np.arange(5, dtype=np.uint64)
    found = pieces.encode(texts, keys, vocabulary, 0.3)
    monkeypatch.setattr(pieces, "_LONG_RUN", 0)
    again = pieces.encode(texts, keys, vocabulary, 0.3)
    assert all((a == b).all() for a, b in zip(found, again))


def test_packing(docs, empty):
    placed = packing.pack_documents(docs, capacities=(8, 16, 64), shard_tokens=200).collect()
    sizes = Counter()
    for r in placed:
        sizes[r.id] += r.length
    expected = Counter()
    for i, t in rows_of(docs):
        expected[i] += len(re.findall(WORD, t))
    assert sizes == expected
    bins = {}
    for r in placed:
        bins.setdefault(r.bin, []).append(r)
    for members in bins.values():
        fill, at = sum(r.length for r in members), 0
        for r in sorted(members, key=lambda r: (r.place, r.length)):
            assert r.place == at and r.fill == fill
            at += r.length
        assert members[0].capacity == min(c for c in (8, 16, 64) if c >= fill)
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_takes_the_fullest_bin_and_downsizes():
    bins, places, capacity = packing.pack([60, 50, 10, 4], (64, 16, 8), 0)
    assert bins.tolist() == [0, 1, 1, 0] and capacity.tolist() == [64, 64] and places.tolist() == [0, 0, 50, 60]
    assert packing.pack([5], (64, 16, 8), 0)[2].tolist() == [8]


def test_licenses(docs, empty):
    found = {r.id: r for r in licenses.scan(docs).collect()}
    row = found[39 % 31]
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (3, 8, 13, "cc-by,reserved")
    assert row.labels == "apache-2.0,cc-by,reserved" and row.score == 1.0
    assert found[0].n_words == 0 and found[0].labels == "" and found[0].first_word is None
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 30)
    seen, fitted = [], toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda *a, **k: seen.append((len(a[3]), k["mass"].sum())) or fitted(*a, **k))
    rows = [(i % 40, f"vile nasty w{i}" if i % 2 else f"kind mild w{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    assert seen[0][0] == 60 and abs(seen[0][1] - 400) < 1e-6 and len(model.words)


# How the usual headers are wrapped.
WRAPPED = {
    "gpl-notice": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by",
    "mpl-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this",
    "bsd": "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted provided that the following conditions",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
    "mit-notice": "Permission is hereby granted, free of charge,\nto any person\nobtaining a copy\nof this software and associated",
}


def test_wrapped_licenses(spark):
    rng = np.random.default_rng(8)
    words = sorted({w for t in licenses.TEMPLATES for w in licenses.words_of(t)}) + ["other", "words"] * 20
    odd = lambda n: " ".join(rng.choice(words, n))
    texts = ["int a;\n" + t + "\nfoo\n\n" for t in WRAPPED.values()]
    for _ in range(300):
        template = list(licenses.TEMPLATES)[rng.integers(len(licenses.TEMPLATES))].split()
        wrapped = "".join(w + (" ", "\n", "\n\n")[rng.choice(3, p=(0.8, 0.15, 0.05))] for w in template if rng.random() < 0.9)
        texts.append("\n".join([odd(rng.integers(0, 60)), wrapped, *(odd(rng.integers(0, 12)) for _ in range(rng.integers(0, 5)))]))
    sets = [(set(licenses.words_of(t)), label) for t, label in licenses.TEMPLATES.items()]
    expected = {}
    for i, text in enumerate(texts):
        split, found = [licenses.words_of(line) for line in text.split("\n")], []
        for p, (s, label) in itertools.product(range(len(split)), sets):
            block = list(split[p])
            for line in split[p + 1 :] if block else []:
                if len(block) + len(line) > licenses.BLOCK_SHARE * len(s):
                    break
                block += line
            if len(s & set(block)) >= math.ceil(0.8 * len(s) - 1e-9):
                found.append((p, label, len(s & set(block)) / len(s)))
        expected[i] = sorted(found)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.id: r for r in licenses.scan(table).collect()}
    assert {i: [tuple(b) for b in r.blocks] for i, r in rows.items()} == expected
    assert all(label in rows[i].labels.split(",") for i, label in enumerate(WRAPPED))


def test_filters_lose_no_block():
    rng = np.random.default_rng(5)
    order = np.arange(30)
    sets = [licenses._Template(str(k), np.sort(rng.choice(order, n, replace=False)), math.ceil(0.8 * n)) for k, n in enumerate((3, 5, 8, 12))]
    blocks = [np.sort(rng.choice(order, rng.integers(1, 25), replace=False)) for _ in range(400)]
    owners, words = np.repeat(np.arange(400), [len(b) for b in blocks]), np.concatenate(blocks)
    found = {(b, k, n) for names, overlaps, k in licenses.matches(owners, words, sets) for b, n in zip(names.tolist(), overlaps.tolist())}
    expected = {(b, k, len(set(x) & set(s.words))) for b, x in enumerate(blocks) for k, s in enumerate(sets) if len(set(x) & set(s.words)) >= s.needed}
    assert found == expected


def test_toxicity_held_out(spark, docs, empty):
    folder = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(table, labels.where("doc_id % 4 <> 0"))
    held = toxicity.graded(table, model).join(labels.where("doc_id % 4 = 0"), F.col("id") == F.col("doc_id"))
    counts = {(r[0], r[1]): r[2] for r in held.groupBy(labels.toxic, "severity").count().collect()}
    flagged = held.select(labels.toxic.alias("label"), (F.col("severity") > model.limit).alias("found")).groupBy("label", "found").count().collect()
    n = {(r.label, r.found): r["count"] for r in flagged}
    assert counts and n.get((1, True), 0) >= 0.8 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * (n.get((0, True), 0) + n[(0, False)])
    assert (np.diff(model.thresholds) > 0).all() and (model.weights >= 0).all()
    nothing = toxicity.fit(empty, labels)
    assert not toxicity.graded(docs, nothing).where("toxic").count()
    assert toxicity.graded(docs, model).count() == docs.count() and toxicity.graded(empty, model).count() == 0


def test_toxicity_of_a_sample_keeps_the_mix(spark, monkeypatch):
    rng = np.random.default_rng(8)
    grades = rng.choice(3, 300, p=[0.7, 0.2, 0.1])
    rows, words = np.repeat(np.arange(300), 3), rng.integers(0, 12, 900) // (1 + np.repeat(grades, 3))
    mass, values = np.where(grades > 0, 1, 4), np.ones(900)
    again = np.repeat(np.arange(300), mass)
    triples = np.repeat(np.arange(len(again)), 3), words.reshape(-1, 3)[again].ravel(), np.ones(3 * len(again))
    for a, b in zip(toxicity.fit_ordinal(rows, words, values, grades, 12, mass=mass), toxicity.fit_ordinal(*triples, grades[again], 12)):
        assert np.allclose(a, b, atol=1e-6)

    folder = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    whole = toxicity.fit(table, labels)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 450)
    part = toxicity.fit(table, labels)
    plain = [m.expected(np.zeros(1))[0] for m in (whole, part)]
    assert abs(plain[0] - plain[1]) < 0.05
    marked = toxicity.graded(table, part).join(labels.where("toxic = 0"), F.col("id") == F.col("doc_id"))
    assert marked.where(F.col("severity") > part.limit).count() <= toxicity.LOSS * marked.count()


def test_words_end_with_their_row():
    data, offsets = tokens.text_bytes(pa.array(["ab", None, "c d", ""]))
    found = tokens.split(data, offsets)
    assert found.counts.tolist() == [1, 0, 2, 0] and found.starts.tolist() == [0, 2, 4]
