"""Groups of texts with similar word n-grams: a size-aware join of sets, light sets by subsets, heavy ones by lists.

Tokens of all sets stand in one order, frequent ones last, so the tokens two similar sets have in common show among the
first few of both. A light set is filed under every pair of its first tokens: light sets that are similar share one of
these pairs. For larger sets pairs would be too many; a heavy set is filed in the inverted lists of its first tokens and
scans them. The size where sets become heavy is where the lists become the cheaper way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import stored
from .tokens import mix

SHINGLE = 4

#: Per cent: shared shingles of all shingles of two texts.
SIMILARITY = 85

#: Shingles are filed under slots by their leading bits, in tables whose size does not depend on the input.
SLOT_BITS = 20

#: Ranges of hashes whose tokens are counted in a set's signature.
SIGNATURE_BITS = 8

#: Words that are hashed in one go.
TOGETHER = 1 << 16

#: Shingles that a task counts in one go, and the count from which it tells of one.
COUNTED = 1 << 21
FREQUENT = 4

#: Sets above this size are heavy whatever the costs are.
LARGEST_LIGHT = 200

#: A frequency from which an inverted list is dealt out to several tasks, and to how many.
CROWDED = 1 << 16
PARTS = 64

#: Stars are drawn while each leaves at most this part of the open pairs.
SHRINKING = 0.5

#: Sets of a list that are compared in one block, and rows of blocks that are compared in one go.
BLOCK = 1 << 12
COMPARED = 1 << 16

_SEEDS = np.random.default_rng(13).integers(1, 2**63, SHINGLE + 2, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _sets(column: pa.Array, known: _Hashes) -> Iterator[np.ndarray]:
    """The different shingles of each text as sorted 64-bit hashes; mixed after every word, so that order counts."""

    def cut(texts: list[list[bytes]]) -> Iterator[np.ndarray]:
        words = [w for text in texts for w in text]
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        places = max(0, len(words) - SHINGLE + 1)
        mixed = np.full(places, _SEEDS[SHINGLE], np.uint64)
        for i in range(SHINGLE):
            mixed = mix(mixed + hashes[i : places + i])
        begin = 0
        for text in texts:
            size, end = len(text), begin + len(text)
            if size >= SHINGLE:
                yield np.unique(mixed[begin : end - SHINGLE + 1])
            elif size:
                whole = _SEEDS[size : size + 1]
                for i in range(begin, end):
                    whole = mix(whole + hashes[i])
                yield whole
            else:
                yield hashes[:0]
            begin = end

    held, size = [], 0
    for text in column:
        held.append(text.as_buffer().to_pybytes().lower().split() if text.is_valid else [])
        size += len(held[-1])
        if size > TOGETHER:
            yield from cut(held)
            held, size = [], 0
    yield from cut(held)


def _named(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist())


def _read(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))


def _kind(texts: DataFrame) -> str:
    return texts.schema["id"].dataType.simpleString()


def _signature(tokens: np.ndarray) -> bytes | None:
    """How many tokens lie in each of some ranges of hashes; None where a byte cannot hold a number.

    Two sets share at most the sum of the lesser numbers.
    """
    counts = np.bincount((tokens >> np.uint64(64 - SIGNATURE_BITS)).astype(np.int64), minlength=1 << SIGNATURE_BITS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def measured(texts: DataFrame, similarity: int) -> DataFrame:
    """Of (id, text), one row for each text: id, n, a, b, signature, the size and the name of its set; and two more kinds.

    Rows with ``times`` tell of tokens ``a`` that are frequent in a run of rows; they only serve the order of tokens. Rows
    without ``a`` sum up, for light enough sets of size ``n``, how long the lists of their first tokens are: ``lists`` for
    rare tokens, and ``shares``, as parts of all rows, for frequent ones.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, kind = _Hashes(), [], 0, None

        def told() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            costs = np.zeros((LARGEST_LIGHT + 1, 2))
            for one in held:
                n = len(one)
                if n <= LARGEST_LIGHT and has_partners(n, similarity):
                    first = _spare(n, similarity)
                    lengths = np.partition(times[np.searchsorted(tokens, one)], first)[: first + 1]
                    often = lengths >= FREQUENT
                    costs[n] += lengths[~often].sum(), lengths[often].sum() / len(held)
            sizes = np.flatnonzero(costs.any(axis=1))
            often = times >= FREQUENT
            tokens, times = tokens[often].view(np.int64), times[often]
            no, also = pa.nulls(len(tokens)), pa.nulls(len(sizes))
            columns = zip(
                (no, no, pa.array(tokens), no, no, pa.array(times), no, no),
                (also, pa.array(sizes), also, also, also, also, pa.array(costs[sizes, 0]), pa.array(costs[sizes, 1])),
                kinds(),
            )
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(t), y.cast(t)]) for x, y, t in columns], names)

        def kinds() -> list[pa.DataType]:
            return [kind, *[pa.int64()] * 3, pa.binary(), pa.int64(), pa.float64(), pa.float64()]

        for batch in batches:
            kind = batch.schema.field(0).type
            rows = []
            for tokens in _sets(batch.column(1), known):
                rows.append((len(tokens), *_named(tokens), _signature(tokens)))
                held.append(tokens)
                size += len(tokens)
                if size > COUNTED:
                    yield told()
                    held, size = [], 0
            found = [pa.array(c, t) for c, t in zip(zip(*rows), kinds()[1:])] if rows else [pa.nulls(0, t) for t in kinds()[1:5]]
            rest = [pa.nulls(batch.num_rows, t) for t in kinds()[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *rest], names)
        if held:
            yield told()

    names = ["id", "n", "a", "b", "signature", "times", "lists", "shares"]
    schema = f"id {_kind(texts)}, n bigint, a bigint, b bigint, signature binary, times bigint, lists double, shares double"
    return texts.mapInArrow(work, schema)


def token_levels(frequent: DataFrame) -> bytes:
    """Per slot the binary logarithm of the largest count of a token (a, times) in it: one byte a slot.

    One number for each slot leaves Spark.
    """
    counts = frequent.groupBy("a").agg(F.sum("times").alias("times"))
    slot = F.shiftrightunsigned("a", 64 - SLOT_BITS).cast("int")
    found = counts.groupBy(slot.alias("slot")).agg(F.floor(F.log2(F.max("times"))).cast("int").alias("level")).toPandas()
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    table[found["slot"].to_numpy()] = found["level"].to_numpy()
    return table.tobytes()


def _level(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[tokens >> np.uint64(64 - SLOT_BITS)]


def _first(tokens: np.ndarray, levels: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` tokens in the order of all tokens: by level, then by hash."""
    return tokens[np.argsort(_level(tokens, levels), kind="stable")[:n]]


def _spare(size: int, similarity: int) -> int:
    """How many of its tokens a set may not share with a similar one."""
    return size - -(-similarity * size // 100)


def has_partners(size: int, similarity: int) -> bool:
    """Whether a set of another text can be similar: at least the one with a single token more."""
    return 100 * size >= similarity * (size + 1)


def boundary(told: DataFrame, similarity: int) -> int:
    """The largest size of a light set: up to it pairs of tokens, beyond it inverted lists, at the least cost in total.

    The cost of a light set is its number of pairs, that of a heavy one its first tokens and the length of their lists. Costs
    are summed up for each size; one row for each size up to ``LARGEST_LIGHT`` leaves Spark.
    """
    sizes = told.where("times IS NULL").where(F.col("n") <= LARGEST_LIGHT).groupBy("n")
    found = sizes.agg(F.count("a").alias("sets"), F.sum("lists").alias("lists"), F.sum("shares").alias("shares")).toPandas().fillna(0)
    found = found[np.array([has_partners(int(n), similarity) for n in found["n"]], bool)].sort_values("n")
    if not len(found):
        return 0
    rows = told.where("times IS NULL AND a IS NOT NULL").count()
    first = np.array([_spare(int(n), similarity) + 1 for n in found["n"]])
    light = found["sets"].to_numpy() * (first + 1) * first / 2
    heavy = found["sets"].to_numpy() * first + found["lists"].to_numpy() + found["shares"].to_numpy() * rows
    # Nothing light at all, or light up to each size and heavy from there on.
    total = np.concatenate([[heavy.sum()], light.cumsum() + heavy.sum() - heavy.cumsum()])
    return int([0, *found["n"]][total.argmin()])


def keys(texts: DataFrame, levels: bytes, light: int, similarity: int) -> DataFrame:
    """(key, part, a, b, n): what each set is filed under; copies of a set in one run of rows are filed once.

    Light sets up to ``light`` shingles have a key for each pair of their first tokens, heavy ones a key for each of their
    first tokens. Light sets that may have a heavy partner have both. ``part`` spreads a list that is crowded.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, seen = _Hashes(), np.frombuffer(levels, np.uint8), set()
        for batch in batches:
            found, parts, names = [], [], []
            for tokens in _sets(batch.column(0), known):
                size = len(tokens)
                if not has_partners(size, similarity):
                    continue
                name = _named(tokens)
                if name in seen:
                    continue
                if len(seen) > 1 << 18:
                    seen.clear()
                seen.add(name)
                spare = _spare(size, similarity)
                first = _first(tokens, table, spare + 2)
                mine, hot = [], []
                if size <= light:
                    i, k = np.triu_indices(len(first), 1)
                    low, high = np.minimum(first[i], first[k]), np.maximum(first[i], first[k])
                    mine.append(mix(mix(low + _SEEDS[0]) + high))
                    hot.append(np.minimum(_level(low, table), _level(high, table)))
                if 100 * size >= similarity * (light + 1):
                    mine.append(first[: spare + 1])
                    hot.append(_level(first[: spare + 1], table))
                mine, hot = np.concatenate(mine), np.concatenate(hot)
                found.append(mine)
                parts.append(np.where(np.exp2(hot.astype(float)) >= CROWDED, 1 + name[0] % PARTS, 0))
                names.append((*name, size, len(mine)))
            if not found:
                continue
            a, b, n, times = (np.array(x, np.int64) for x in zip(*names))
            columns = [np.concatenate(found).view(np.int64), np.concatenate(parts).astype(np.int32), *(np.repeat(x, times) for x in (a, b, n))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "part", "a", "b", "n"])

    return texts.select("text").mapInArrow(work, "key bigint, part int, a bigint, b bigint, n bigint")


def shared_keys(filed: DataFrame) -> DataFrame:
    """(key, a, b, n): each set once under its keys, without keys of a single set. Crowded lists stay as they are.

    Keys are dealt and sorted once. A row is compared with its neighbours only, and a list of any length is spilled rather
    than held.
    """
    under = Window.partitionBy("key", "part").orderBy("a", "b")
    again = F.coalesce((F.lag("a").over(under) == F.col("a")) & (F.lag("b").over(under) == F.col("b")), F.lit(False))
    once = filed.withColumn("again", again).where(~F.col("again"))
    alone = F.lag("a").over(under).isNull() & F.lead("a").over(under).isNull()
    return once.withColumn("alone", alone).where(~F.col("alone") | (F.col("part") > 0)).select("key", "a", "b", "n")


def _most(m: np.ndarray, n: np.ndarray, one: pa.Array, other: pa.Array) -> np.ndarray:
    """How many tokens sets of m and n tokens share at most, by their signatures where both have one."""
    most = np.minimum(m, n)
    known = one.is_valid().to_numpy(zero_copy_only=False) & other.is_valid().to_numpy(zero_copy_only=False)
    if known.any():
        both = (np.frombuffer(b"".join(x.filter(pa.array(known)).to_pylist()), np.uint8).reshape(known.sum(), -1) for x in (one, other))
        most[known] = np.minimum(*both).sum(axis=1, dtype=np.int64)
    return most


def possible(pairs: DataFrame, signatures: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (x, y, m, n: two sets and their sizes) whose signatures leave enough to share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = _most(m, n, batch.column(4), batch.column(5))
            yield batch.select(range(4)).filter(pa.array(100 * most >= similarity * (m + n - most)))

    one, other = signatures.toDF("x", "one"), signatures.toDF("y", "other")
    met = pairs.join(one, "x").join(other, "y").select("x", "y", "m", "n", "one", "other")
    return met.mapInArrow(work, "x bigint, y bigint, m bigint, n bigint")


def _compared(block: pa.Table, similarity: int) -> pa.RecordBatch:
    """Pairs (x, y, m, n) of some whole blocks, sorted by block and size, that may be similar and are not connected yet."""
    key, low, high, part, node, root, n = (block.column(c).to_numpy() for c in ("key", "low", "high", "part", "node", "root", "n"))
    signature = block.column("signature").combine_chunks()
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    end = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
    active, ahead, found = np.arange(len(key)), 1, []
    while len(active):
        # Sizes grow in a block, so a set that is too short for the one ahead is too short for all behind that.
        other = active + ahead
        going = other < end[active]
        active, other = active[going], other[going]
        going = 100 * n[active] >= similarity * n[other]
        active, other = active[going], other[going]
        open_ = (root[active] != root[other]) & ((low[active] == high[active]) | (part[active] != part[other]))
        x, y = active[open_], other[open_]
        if len(x):
            most = _most(n[x], n[y], signature.take(pa.array(x)), signature.take(pa.array(y)))
            kept = 100 * most >= similarity * (n[x] + n[y] - most)
            found.append((x[kept], y[kept]))
        ahead += 1
    x, y = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), ())))
    first = node[x] < node[y]
    x, y = np.where(first, x, y), np.where(first, y, x)
    # Sets that share several keys met under each of them.
    _, once = np.unique(np.stack([node[x], node[y]]), axis=1, return_index=True)
    x, y = x[once], y[once]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (node[x], node[y], n[x], n[y])], ["x", "y", "m", "n"])


def compared(open_: DataFrame, signatures: DataFrame, similarity: int) -> DataFrame:
    """(x, y, m, n): the pairs under a key that may be similar and are in different components, by their signatures.

    A long list is cut into parts, and every two parts make a block, so a block is bounded and a list of any length is
    shared by many tasks. Pairs are compared inside the tasks; only those that may be similar leave them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < COMPARED:
                continue
            table = pa.Table.from_batches(held)
            names = np.stack([table.column(c).to_numpy() for c in ("key", "low", "high")])
            last = np.flatnonzero((names != names[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield _compared(table.slice(0, cut), similarity)
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield _compared(pa.Table.from_batches(held), similarity)

    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = open_.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(signatures, "node")
    blocks = blocks.select("key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "node", "root", "n", "signature")
    ordered = blocks.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "n")
    return ordered.mapInArrow(work, "x bigint, y bigint, m bigint, n bigint").distinct()


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens): the sets of the classes ``wanted`` (node, least, a, b), one row each.

    They are read from the texts of the rows that have a class's smallest id. Marks of those ids, in a table of fixed size,
    keep back nearly all other texts before they are read.
    """
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - SLOT_BITS).cast("int")
    marks = np.zeros(1 << SLOT_BITS, np.uint8)
    marks[wanted.select(F.col("least").alias("id")).select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy()] = 1
    bits = np.packbits(marks).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = _Hashes(), np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            held = batch.filter(pa.array(asked[batch.column(1).to_numpy()]))
            found = list(_sets(held.column(2), known))
            names = np.array([_named(tokens) for tokens in found], np.int64).reshape(-1, 2)
            tokens = pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([held.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), tokens], ["hash", "a", "b", "tokens"])

    rows = texts.select(F.xxhash64("id").alias("hash"), slot.alias("slot"), "text").mapInArrow(work, "hash bigint, a bigint, b bigint, tokens array<bigint>")
    asked = wanted.select("node", "a", "b", F.xxhash64("least").alias("hash"))
    return rows.join(asked, ["a", "b", "hash"]).dropDuplicates(["a", "b", "hash"]).select("node", "tokens")


def similar(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (x, y, m, n) whose sets are similar."""
    one, other = sets.toDF("x", "one"), sets.toDF("y", "other")
    met = pairs.join(one, "x").join(other, "y")
    common = F.size(F.array_intersect("one", "other"))
    return met.where(100 * common >= similarity * (F.col("m") + F.col("n") - common)).select("x", "y")


def linked(members: DataFrame, classes: DataFrame, texts: DataFrame, similarity: int) -> DataFrame | None:
    """(node, root) of all sets with a link; ``members`` (key, node, n) lists the sets under each key they share.

    The pairs under a key are never written out. A round draws a star: the set with the most shared keys, which the others
    of a group of copies resemble most, is compared with the rest of its key. What is connected then need not be compared,
    and the middle of a star leaves its key, so every pair is either compared or connected in the end. When stars do not
    connect much any more, what is open is compared inside tasks.
    """
    shares = members.groupBy("node").agg(F.count("*").alias("share"))
    open_ = stored(members.join(shares, "node").select("key", "node", "n", "share", F.col("node").alias("root")))
    links, found, before = None, None, None
    while True:
        # Pairs of sets in different components under a key, from counts of its components.
        parts = open_.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
        per_key = parts.groupBy("key").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("pairs"))
        pairs = per_key.agg(F.sum("pairs")).first()[0] or 0
        if not pairs:
            return found
        last = before is not None and pairs > SHRINKING * before
        before = pairs
        if last:
            drawn = compared(open_, classes.select("node", "signature"), similarity)
        else:
            middle = open_.groupBy("key").agg(F.max(F.struct("share", "node", "n", "root")).alias("hub"))
            rest = open_.join(middle, "key").where(F.col("node") != F.col("hub.node"))
            sizes = F.array_sort(F.array(F.struct("node", "n"), F.struct(F.col("hub.node").alias("node"), F.col("hub.n").alias("n"))))
            drawn = rest.where(F.col("root") != F.col("hub.root")).select(sizes.alias("s"))
            drawn = drawn.selectExpr("s[0].node AS x", "s[1].node AS y", "s[0].n AS m", "s[1].n AS n")
            drawn = drawn.where(100 * F.least("m", "n") >= similarity * F.greatest("m", "n")).distinct()
            drawn = possible(drawn, classes.select("node", "signature"), similarity)
        drawn = stored(drawn)
        ends = drawn.select(F.col("x").alias("node")).union(drawn.select("y")).distinct()
        sets = stored(sets_of(texts, classes.join(ends, "node", "left_semi")))
        new = stored(similar(drawn, sets, similarity))
        links = new if links is None else links.unionByName(new)
        found = stored(components(links, "x", "y"))
        if last:
            return found
        rest = rest.select("key", "node", "n", "share").join(found.toDF("node", "now"), "node", "left")
        rest = stored(rest.select("key", "node", "n", "share", F.coalesce("now", "node").alias("root")))
        several = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        open_ = stored(rest.join(several.select("key"), "key", "left_semi"))


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component): component is the smallest id that links lead to, over all texts.

    Texts link when ``similarity`` per cent or more of all their different shingles of four words (A-Z as a-z) are
    shared; a text of fewer words has its whole sequence as its only shingle, null, empty and blank texts have none and
    link with nothing. Equal sets are one node, so copies are never paired; repeated rows each give a row, and rows of one
    id take part with each of their texts. Rows without an id link too, but never name a component: it is null where all of
    its rows are without one. An empty table gives no rows, other columns are not read.
    """
    texts = _read(docs, id_column, text_column)
    told = stored(measured(texts, similarity))
    rows = told.where("times IS NULL AND a IS NOT NULL").select("id", "n", "a", "b", "signature")
    levels = token_levels(told.where("times IS NOT NULL").select("a", "times"))
    classes = rows.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("least"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    filed = shared_keys(keys(texts, levels, boundary(told, similarity), similarity))
    members = stored(filed.join(classes, ["a", "b"]).select("key", "node", "n"))
    found = linked(members, classes, texts, similarity)
    if found is None:
        named = classes.withColumn("component", F.col("least"))
    else:
        rooted = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = rooted.groupBy("root").agg(F.min("least").alias("component"))
        named = rooted.join(roots, "root")
    named = named.select("a", "b", "component")
    linked_rows = rows.where("n > 0").join(named, ["a", "b"])
    alone = rows.where("n = 0").withColumn("component", F.col("id"))
    columns = ["id", F.col("n").alias("n_shingles"), "component"]
    return linked_rows.select(*columns).unionByName(alone.select(*columns))
