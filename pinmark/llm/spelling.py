"""Spelling variants: words that differ by one edit, found by dynamic programming down a sorted vocabulary.

The edit matrix of a query against the words of a sorted list is kept as three-cell bands, one per letter of the list's
word. Where two neighbours of the list share a prefix, the bands of that prefix are used again; where a band holds no
cell of one edit or less, the whole range of words that share the prefix read so far is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

LEAST_LENGTH = 7
LEAST_COUNT = 2

#: A form is at least so many times as frequent as its variant.
RATIO = 10

#: Runs whose hash is divided by this lose a letter.
DAMAGE = 31

#: Words of one list, and letters that are scanned in one go.
LIST_WORDS = 1 << 17
CHUNK_LETTERS = 3 << 20

_LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): words of at least seven code points that occur at least twice, counted over all texts.

    Words are maximal runs of Latin letters, A-Z as a-z. Where 31 divides the crc32 of ``<id>:<run>``, the run loses the
    code point at the hash modulo its length. Shorter runs cannot become words and are never listed.
    """
    runs = F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(f"{_LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    run = docs.select(name.alias("id"), F.explode(runs).alias("run"))
    run = run.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    hashed = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGE == 0, less).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _listed(words: DataFrame, least: Column, start: Column, stop: Column) -> DataFrame:
    """Each word under the list of pairs whose shorter word has ``least`` letters and whose edit is in [start, stop).

    Such pairs share the letters before ``start`` and the last ``least - stop`` letters. Lists without a common prefix
    hold the words reversed, so that the common letters come first.
    """
    placed = words.withColumns({"least": least, "start": start, "stop": stop})
    tail = F.greatest(F.col("least") - F.col("stop"), F.lit(0))
    ends = F.when(tail > 0, F.substring("word", -1 * tail, tail)).otherwise(F.lit(""))
    return placed.select(
        "word", "n", "least", "start", "stop",
        F.concat_ws(" ", "start", "stop", F.substring("word", F.lit(1), F.col("start")), ends).alias("list"),
    )


def lists(words: DataFrame, most: int = LIST_WORDS) -> DataFrame:
    """(word, n, least, start, stop, list): every pair of words with one edit shares exactly one list.

    The place of the edit, the length of the longest common prefix, is in the first or in the second half of the shorter
    word; the letters of the other half are equal. A word is listed with partners of its own length or longer, and with
    shorter ones. A list of more than ``most`` words is replaced by two, for either half of its places, each of which
    asks for more equal letters; a list of a single place holds at most one word for each letter of the alphabet and
    length, so the rounds end.
    """
    size = F.length("word")
    shorter = words.withColumn("least", F.explode(F.array(size, size - 1))).where(F.col("least") >= LEAST_LENGTH)
    half = F.ceil(F.col("least") / 2).cast("int")
    part = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("least") + 1).alias("b"))))
    listed = _listed(shorter.withColumn("part", part), F.col("least"), F.col("part.a"), F.col("part.b"))
    done = None
    while True:
        crowded = F.col("stop") - F.col("start") > 1
        heavy = stored(listed.where(crowded).groupBy("least", "list").agg(F.count("*").alias("size")).where(F.col("size") > most).drop("size"))
        if heavy.isEmpty():
            return listed if done is None else done.unionByName(listed)
        rest = listed.join(heavy, ["least", "list"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        middle = ((F.col("start") + F.col("stop")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("start").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("stop").alias("b"))))
        split = listed.join(heavy, ["least", "list"], "left_semi").withColumn("part", halves)
        listed = stored(_listed(split, F.col("least"), F.col("part.a"), F.col("part.b")))


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of one byte a letter as rows of a matrix, padded by zeros, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=1))
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width), sizes


def scan(matrix: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, k) of rows with i < k < ends[i] that differ by exactly one edit.

    Rows must be sorted within each list, different, and ``ends[i]`` the end of row i's list. All rows walk down their
    list at the same time, each with its own place and its own bands. ``bands[q, d]`` holds the distances of the first d
    letters of the list's word to the first d - 1, d and d + 1 letters of the query, 2 standing for more than one.
    """
    n, width = matrix.shape
    padded = np.zeros((n, width + 2), np.uint8)
    padded[:, :width] = matrix
    # Common prefix of each row with the one before it, and per depth the rows that share fewer letters.
    shared = np.zeros(n + 1, np.int64)
    if n > 1:
        differs = matrix[1:] != matrix[:-1]
        shared[1:n] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared[1:n] = np.minimum(shared[1:n], np.minimum(sizes[1:], sizes[:-1]))
    borders: dict[int, np.ndarray] = {}

    def beyond(depth: int, at: np.ndarray) -> np.ndarray:
        """The next row that shares fewer than ``depth`` letters with the row before it."""
        if depth not in borders:
            borders[depth] = np.flatnonzero(shared < depth) if depth else np.zeros(0, np.int64)
        edge = borders[depth]
        place = np.searchsorted(edge, at, "right")
        return np.where(place < len(edge), edge[np.minimum(place, len(edge) - 1)], n) if len(edge) else np.full(len(at), n)

    # A row's own letters against themselves: 0 on the diagonal, 1 beside it, 2 outside the word.
    bands = np.empty((n, width + 1, 3), np.uint8)
    bands[:] = (1, 0, 1)
    bands[:, 0, 0] = 2
    depth = np.arange(width + 1)
    bands[:, :, 2][depth[None, :] + 1 > sizes[:, None]] = 2
    valid = sizes.copy()
    query, at = np.arange(n), np.arange(1, n + 1)
    found_a, found_b = [], []
    while True:
        going = at < ends[query]
        query, at, valid = query[going], at[going], valid[going]
        if not len(query):
            break
        # Bands that hold for the row before and the common prefix with it hold here; at least depth 0 always does.
        valid = np.minimum(valid, shared[at])
        following = at + 1
        # Rows are read letter by letter; those that go beyond one edit leave for the next range.
        active = np.arange(len(query))
        for d in range(int(valid.min()) + 1, width + 1):
            begun = active[(valid[active] < d) & (sizes[at[active]] >= d)]
            if not len(begun):
                if not ((valid[active] >= d) & (sizes[at[active]] > valid[active])).any():
                    break
                continue
            q, k = query[begun], at[begun]
            letter = padded[k, d - 1]
            above = bands[q, d - 1]
            size = sizes[q]
            low = above[:, 0] + (letter != padded[q, max(d - 2, 0)]) if d > 1 else np.full(len(q), 2, np.uint8)
            low = np.minimum(low, above[:, 1] + 1)
            low = np.where(d - 1 <= size, np.minimum(low, 2), 2) if d > 1 else np.minimum(above[:, 1] + 1, 2)
            mid = np.minimum(np.minimum(above[:, 1] + (letter != padded[q, d - 1]), above[:, 2] + 1), low + 1)
            mid = np.where(d <= size, np.minimum(mid, 2), 2)
            high = np.minimum(above[:, 2] + (letter != padded[q, d]), mid + 1)
            high = np.where(d + 1 <= size, np.minimum(high, 2), 2)
            bands[q, d, 0], bands[q, d, 1], bands[q, d, 2] = low, mid, high
            valid[begun] = d
            dead = np.minimum(np.minimum(low, mid), high) > 1
            if dead.any():
                gone = begun[dead]
                following[gone] = beyond(d, at[gone])
                valid[gone] = d - 1
                active = np.setdiff1d(active, gone, assume_unique=True)
        whole = active[valid[active] >= sizes[at[active]]]
        q, k = query[whole], at[whole]
        off = sizes[q] - sizes[k] + 1
        near = (off >= 0) & (off <= 2)
        q, k, off = q[near], k[near], off[near]
        hit = bands[q, sizes[k], off] == 1
        found_a.append(q[hit])
        found_b.append(k[hit])
        # After a skip the bands that held for the row skipped from are not those of the row before the next one, but
        # they hold up to any prefix that all rows between share, which is what the common prefixes tell.
        at = following
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (empty, empty)


def _near(batch: pa.Table) -> pa.RecordBatch:
    """Per word of some whole lists: how many near words it has there, and the best of them."""
    texts = batch.column("word").to_pylist()
    raw = [t.encode("latin-1") for t in texts]
    least, start, stop = (batch.column(c).to_numpy().astype(np.int64) for c in ("least", "start", "stop"))
    count = batch.column("n").to_numpy().astype(np.int64)
    name = np.array([f"{m} {x}" for m, x in zip(least, batch.column("list").to_pylist())], object)
    turned = [w[::-1] if s == 0 else w for w, s in zip(raw, start)]
    n = len(raw)
    heads = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    ends = np.repeat(np.append(heads[1:], n), np.diff(np.append(heads, n)))
    matrix, sizes = letters(turned)
    a, b = scan(matrix, sizes, ends)
    keep = np.minimum(sizes[a], sizes[b]) == least[a]
    a, b = a[keep], b[keep]
    # The place of the edit; lists of reversed words meet pairs of other places, too.
    forward, _ = letters(raw)
    differs = forward[a] != forward[b]
    place = np.minimum(differs.argmax(axis=1), least[a]) if len(a) else np.zeros(0, np.int64)
    keep = (place >= start[a]) & (place < stop[a])
    a, b = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
    order = np.empty(n, np.int64)
    order[np.array(raw, object).argsort(kind="stable")] = np.arange(n)
    sorted_by = np.lexsort((order[b], -count[b], a))
    a, b = a[sorted_by], b[sorted_by]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([texts[i] for i in a[first]], pa.string()),
            pa.array(np.diff(np.append(first, len(a))), pa.int64()),
            pa.array([texts[i] for i in b[first]], pa.string()),
            pa.array(count[b[first]], pa.int64()),
        ],
        ["word", "n_near", "best", "best_n"],
    )


def near_words(words: DataFrame, most: int = LIST_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near one; best by n, then by code points.

    ``words``: different words of letters up to U+00FF, with their n. Lists go to tasks by the hash of their name, are
    sorted there and scanned some at a time, in batches of bounded letters. What a word finds in its (at most four, unless
    lists were split) lists is combined in the end: a row per list and word is exchanged, never a row per pair.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total += batch.num_rows * (batch.column("least")[batch.num_rows - 1].as_py() + 1)
            if total < CHUNK_LETTERS:
                continue
            table = pa.Table.from_batches(held)
            # All but the last list are whole.
            last, least = table.column("list")[-1].as_py(), table.column("least")[-1].as_py()
            cut = table.num_rows - 1
            lists_, leasts = table.column("list").to_pylist(), table.column("least").to_pylist()
            while cut and lists_[cut - 1] == last and leasts[cut - 1] == least:
                cut -= 1
            if cut:
                yield _near(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                total = (table.num_rows - cut) * (least + 1)
        if held:
            yield _near(pa.Table.from_batches(held))

    turned = F.when(F.col("start") == 0, F.reverse("word")).otherwise(F.col("word"))
    dealt = lists(words, most).repartition("least", "list").sortWithinPartitions("least", "list", turned)
    found = dealt.mapInArrow(work, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n"))


def followed(forms: DataFrame) -> DataFrame:
    """Add ``root`` to (word, form): the last word that forms lead to, the word itself if it has none.

    Forms are at least ten times as frequent as their variants, so they never run in circles, and twice as many steps are
    taken in each round.
    """
    roots = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the corpus with its near words counted and its form.

    Two words are near if they differ by one inserted, deleted or replaced code point. The form is the near word of
    largest n (ties: smallest in code-point order) if that is at least ten times the word's own, else null; root is where
    forms lead to. Null texts have no words; a null id hashes as an empty text; repeated rows count each time, with equal
    ids they are damaged alike. A run of any length is a word; no text or an empty table gives no rows. Other columns
    are not read.
    """
    words = stored(vocabulary(docs, id_column, text_column))
    found = words.join(near_words(words), "word", "left")
    frequent = F.col("best_n") >= RATIO * F.col("n")
    forms = stored(
        found.select(
            "word",
            F.when(frequent, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(frequent, F.col("best_n")).alias("form_n"),
        )
    )
    return followed(forms).select("word", "form", "root", "n", "n_near", "form_n")
