"""Spelling variants, ranked search, n-gram groups, and texts of regular structure, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pinmark.llm import jaccard, quality, ranking, simhash, spelling, suffixes, windows
from tests.llm.test_operators import TEXTS
from tests.test_queries import FOLDER

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with gaps, one twice, some null; columns whose names the operators use themselves."""
    words = "information informations infomation Information ínformation größere grössere größeren".split()
    draw = random.Random(4)
    texts = [*TEXTS, *(" ".join(draw.choice(words[: 1 + i % 8]) for _ in range(draw.randint(1, 60))) for i in range(80))]
    base = " ".join(f"w{i}" for i in range(60))
    texts += [base, base.upper(), base + " x", "y " + base, base.replace("w30 ", ""), base.replace("w30", "q") + " z", "w1 w2 w3", "W1 w2\tw3", "w1 w2"]
    rows = [(3 * i % 311, t, "kept", i, "s") for i, t in enumerate(texts)]
    rows += [(None, base + " x y", None, None, None), (6, "information " * 30, "same", 5, "t"), (6, "information " * 30, "same", 5, "t"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n bigint_, word bigint, key string".replace("n bigint_", "n string"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def words_of(rows):
    counted = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counted[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counted.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(words):
    near = {w: sorted((v for v in words if v != w and one_edit(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= 10 * words[w] else None for w in words}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_variants(docs, empty):
    expected = variants_of(words_of(rows_of(docs)))
    found = spelling.variants(docs)
    assert {tuple(r) for r in found.collect()} == expected and len(expected) > 8 and any(e[1] for e in expected)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(empty).count() == 0


def test_forms_are_followed_to_the_last(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 30, "aaaaabb": 400, "aaaabbb": 5000, "zzzzzzz": 9}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    # An id that damages none of these words.
    i = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in counts))
    rows = spark.createDataFrame([(i, text)], "doc_id bigint, text string")
    assert {r.word: r.root for r in spelling.variants(rows).collect()} == {w: "zzzzzzz" if w == "zzzzzzz" else "aaaabbb" for w in counts}


@pytest.mark.parametrize("most", [1, 7, 1 << 17])
def test_crowded_lists_are_split_without_losing_a_pair(spark, most):
    draw = random.Random(most)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(7, 10))): draw.randint(2, 500) for _ in range(500)}
    words["a" * 300] = 3
    words["a" * 301] = 40
    rows = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = {(r.word, r.n_near, r.best, r.best_n) for r in spelling.near_words(rows, most).collect()}
    near = {w: sorted((v for v in words if v != w and one_edit(w, v)), key=lambda v: (-words[v], v)) for w in words}
    assert found == {(w, len(v), v[0], words[v[0]]) for w, v in near.items() if v}


def test_scan_finds_every_pair():
    draw = random.Random(3)
    for alphabet, size in (("ab", 6), ("abcdef", 4), ("aé", 12)):
        words = sorted({"".join(draw.choice(alphabet) for _ in range(draw.randint(1, size))) for _ in range(300)})
        matrix, sizes = spelling.letters([w.encode("latin-1") for w in words])
        half = len(words) // 2
        ends = np.where(np.arange(len(words)) < half, half, len(words))
        found = set(zip(*(x.tolist() for x in spelling.scan(matrix, sizes, ends))))
        assert found == {(i, k) for i in range(len(words)) for k in range(i + 1, ends[i]) if one_edit(words[i], words[k])}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking_of(docs, items, k):
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    total, df = sum(n for *_, n in terms), Counter(t for _, c, _ in terms for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(TERM.findall(lower(text)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c, n in terms:
            m = 50 + 50 * n * len(terms) // total
            score = sum(math.floor(1000 * math.log((2 * len(terms) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Information größere w30"), (2, None), (None, "w30"), (3, "..."), (4, "w1 w2 w3 w4 x y z"), (4, "GPL apache"), (5, "nothing here"), (6, "the a b c information infomation 日本 été")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("k,stages,block", [(50, 3, None), (4, 3, 900), (1, 5, 200), (7, 1, 5000)])
def test_ranked_search(docs, items, monkeypatch, k, stages, block):
    if block:
        monkeypatch.setattr(ranking, "BLOCK_BYTES", block)
        monkeypatch.setattr(ranking, "BUNDLE", 2)
        monkeypatch.setattr(ranking, "SHARING_BLOCKS", 2)
    found = ranking.ranked(docs, items, k=k, stages=stages)
    assert Counter(map(tuple, found.collect())) == ranking_of(rows_of(docs), rows_of(items.toDF("doc_id", "text")), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_of_nothing(docs, items, empty):
    assert ranking.ranked(empty, items).count() == 0
    assert ranking.ranked(docs, items.where("false")).count() == 0
    assert ranking.ranked(docs.where("text IS NULL"), items).count() == 0


def test_stages_drop_what_cannot_be_found_and_nothing_else(spark):
    """Many documents, few places: bounds must prune, the result must not change."""
    draw = random.Random(8)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(300)]
    texts = [" ".join(draw.choice(common if draw.random() < 0.9 else rare) for _ in range(40)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    asked = [(j, " ".join(draw.sample(rare, 8) + draw.sample(common, 6))) for j in range(30)]
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    found = ranking.ranked(docs, items, k=5)
    assert Counter(map(tuple, found.collect())) == ranking_of(list(enumerate(texts)), asked, 5)


def groups_of(rows, similarity=85):
    sets = []
    for i, text in rows:
        words = SPACE.findall(lower(text))
        sets.append((i, {tuple(words[j : j + 4]) for j in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return Counter((i, len(s), (least.get(root(x)) if s else i)) for x, (i, s) in enumerate(sets))


def shown(found):
    return Counter(map(tuple, found.select("id", "n_shingles", "component").collect()))


def test_similar_groups(docs, empty):
    assert shown(jaccard.similar_groups(docs)) == groups_of(rows_of(docs))
    assert jaccard.similar_groups(empty).count() == 0
    assert jaccard.similar_groups(docs.where("text IS NULL")).count() > 0


def copies(seed, n):
    """Families of texts of many sizes, each an altered copy of one before it, so that chains and unlinked texts arise."""
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and draw.random() < 0.8:
            words = draw.choice(texts).split()
            for _ in range(draw.randint(0, 2)):
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = draw.choices("abcdefgh", k=draw.randint(0, 2))
        else:
            words = [draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randint(1, 2) for _ in range(draw.choice([3, 9, 10, 14, 30, 80, 250]))]
        texts.append(" ".join(words or ["x"]))
    return list(enumerate(texts))


@pytest.mark.parametrize("setting", [{}, {"SHRINKING": 0.0, "BLOCK": 3}, {"SHRINKING": 1.0}, {"LARGEST_LIGHT": 5}, {"CROWDED": 1, "PARTS": 3, "SHRINKING": 0.0, "COMPARED": 50}])
def test_no_link_is_lost_whatever_the_cuts(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = copies(5, 300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shown(jaccard.similar_groups(docs)) == groups_of(rows)


@pytest.mark.parametrize("similarity", [60, 100])
def test_other_similarities(spark, similarity):
    rows = copies(similarity, 150)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shown(jaccard.similar_groups(docs, similarity=similarity)) == groups_of(rows, similarity)


@pytest.mark.parametrize("light", [0, 6, 30, 200])
def test_keys_meet_wherever_sets_become_heavy(light):
    """Every similar pair shares a key, for any boundary and any order of tokens."""
    draw = np.random.default_rng(light)
    levels = np.frombuffer(draw.integers(0, 5, 1 << jaccard.SLOT_BITS, dtype=np.uint8).tobytes(), np.uint8)

    def keyed(tokens):
        spare = jaccard._spare(len(tokens), 85)
        first = jaccard._first(tokens, levels, spare + 2)
        keys = set()
        if len(tokens) <= light:
            keys |= {frozenset((a, b)) for a in first.tolist() for b in first.tolist() if a != b}
        if 100 * len(tokens) >= 85 * (light + 1):
            keys |= {frozenset([a]) for a in first[: spare + 1].tolist()}
        return keys

    met = 0
    for _ in range(400):
        size = int(draw.integers(6, 60))
        one = draw.integers(0, 2**63, size, dtype=np.uint64)
        other = np.concatenate([one[int(draw.integers(0, 3)) :], draw.integers(0, 2**63, int(draw.integers(0, 4)), dtype=np.uint64)])
        one, other = np.unique(one), np.unique(other)
        common = len(np.intersect1d(one, other))
        if 100 * common >= 85 * (len(one) + len(other) - common) and len(one) != common or len(other) != common:
            if 100 * common >= 85 * (len(one) + len(other) - common):
                met += 1
                assert keyed(one) & keyed(other)
    assert met > 50


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_regular_texts_are_told_apart(spark, n):
    x = thue_morse(n)
    y = x.translate(str.maketrans("ab", "ba"))
    counts, _ = quality.statistics(spark.createDataFrame([(f"{x}\n{y}",), (f"{x}\n{x}",)], "t string").toArrow().column(0))
    assert counts[:, 3].tolist() == [0, 1]
    rest = " ".join(f"w{i}" for i in range(34))
    rows = spark.createDataFrame([(0, f"{x} {rest}"), (1, f"{y} {rest}")], "doc_id bigint, text string")
    assert [r.n_removed for r in windows.remove_repeated_windows(rows).collect()] == [0, 0]
    for first, second in ((x, y), (x, x)):
        rows = spark.createDataFrame([(0, first), (1, second)], "doc_id bigint, text string")
        found = {r.id: r.n_removed for r in suffixes.remove_repeated_bytes(rows).collect()}
        starts = {first[i : i + 50] for i in range(len(first) - 49)}
        gone = {j for i in range(len(second) - 49) if second[i : i + 50] in starts for j in range(i, i + 50)}
        assert found == {0: 0, 1: len(gone)}


def test_stages_leave_columns_of_any_name_alone(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    extra = ["kept", "score", "n_words", "n_removed", "kept_text", "__gone", "base_failed", "sha", "size", "id", "block", "c0"]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, wide, str(FOLDER))
        assert found.columns == wide.columns and found.schema == wide.schema, name
        rows = found.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra), name
        assert stage(spark, wide.where("false"), str(FOLDER)).count() == 0


def test_near_dedup_with_a_column_of_its_own(spark):
    rows = spark.createDataFrame([(0, "a b c", 1, 2), (1, "A B C", 3, 4)], "doc_id bigint, text string, __gone int, __gone_ int")
    assert [tuple(r) for r in simhash.near_dedup(rows).collect()] == [(0, "a b c", 1, 2)]
