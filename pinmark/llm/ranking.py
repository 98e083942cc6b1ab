"""Ranked lexical search: bundles of items pass through the owners of their terms, stage by stage.

Terms are owned by stages, rare terms by the first one. A bundle holds items and, for a block of documents, the sparse
scores that earlier stages gave them; each stage's cogroup adds the integer contributions of the terms it owns. What can
no longer reach an item's last place is dropped between stages, by bounds that never drop a result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

TOP = 50

# The score's scale, and the parts of a document's length in it.
IMPACT, PER_TF, PER_LENGTH = 1_000_000_000, 1000, 20
LENGTH_BASE, LENGTH_SLOPE = 50, 50

#: Owners of terms, one stage each.
STAGES = 3

#: Bytes of the documents of a block, and documents at most.
BLOCK_BYTES = 6 << 20
BLOCK_DOCUMENTS = 1 << 14

#: Items that travel together, and blocks that are given one copy of the bundles.
BUNDLE = 64
SHARING_BLOCKS = 32

#: Terms are filed under slots, one byte each, in a table whose size does not depend on the input.
SLOTS = 1 << 20

_NO_ID = 2**63 - 1

#: A-Z as a-z, and every ASCII byte that is neither a letter nor a digit as a space.
_FOLD = bytes(
    b + 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order; bytes beyond ASCII are never cut apart."""
    return text.translate(_FOLD).split() if text else []


def _slot(term: str = "term"):
    return F.crc32(F.col(term).cast("binary")).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for text in column:
        buffer = text.as_buffer() if text.is_valid else None
        yield buffer.to_pybytes() if buffer is not None else None


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): each term of an item's text (columns item_id, text) once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, terms = [], []
            for place, text in enumerate(_texts(batch.column(1))):
                found = set(terms_of(text))
                places += [place] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(terms, pa.binary()).cast(pa.string())], ["item_id", "term"])

    return items.mapInArrow(work, f"item_id {items.schema['item_id'].dataType.simpleString()}, term string").distinct()


def marked_slots(terms: DataFrame) -> bytes:
    """A byte for each slot, 1 where a term of the column ``term`` has it."""
    table = np.zeros(SLOTS, np.uint8)
    table[terms.select(_slot().alias("slot")).distinct().toPandas()["slot"].to_numpy()] = 1
    return table.tobytes()


def term_counts(texts: DataFrame, slots: bytes) -> DataFrame:
    """(term, df, terms): documents that hold the term, for all terms of the marked slots.

    Under the null term: the number of documents with a term, and in ``terms`` that of all their terms.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, terms = Counter(), 0, 0

        def told() -> pa.RecordBatch:
            held = [(t, c) for t, c in df.items() if slots[zlib.crc32(t) & (SLOTS - 1)]]
            columns = [None, *(t for t, _ in held)], [documents, *(c for _, c in held)], [terms] + [0] * len(held)
            arrays = [pa.array(columns[0], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, ["term", "df", "terms"])

        for batch in batches:
            for text in _texts(batch.column(0)):
                found = terms_of(text)
                documents += bool(found)
                terms += len(found)
                df.update(set(found))
                if len(df) > 1 << 18:
                    yield told()
                    df, documents, terms = Counter(), 0, 0
        yield told()

    found = texts.mapInArrow(work, "term string, df bigint, terms bigint")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms"))


def owners(asked: DataFrame, stages: int = STAGES) -> bytes:
    """The stage of each slot, from 1; 0 where no item has a term.

    Slots go in the order of their postings, rare ones first: a sixteenth of all postings to the first stage, the rest in
    equal parts to the others. Only the sums per slot leave Spark.
    """
    sums = asked.select("term", "df").distinct().groupBy(_slot().alias("slot")).agg(F.sum("df").alias("df")).toPandas()
    sums = sums.sort_values(["df", "slot"])
    table = np.zeros(SLOTS, np.uint8)
    if len(sums):
        share = sums["df"].cumsum().to_numpy()
        parts = 1 / 16 + 15 / 16 * np.arange(stages) / max(1, stages - 1)
        stage = np.searchsorted(parts * share[-1], share, "left")
        table[sums["slot"].to_numpy()] = np.minimum(stage, stages - 1) + 1
    return table.tobytes()


class _Local(dict):
    """Terms of a block, numbered as they come; -1 where no stage owns the term."""

    def __init__(self, table: bytes):
        super().__init__()
        self.table, self.terms, self.stages = table, [], []

    def __missing__(self, term: bytes) -> int:
        stage = self.table[zlib.crc32(term) & (SLOTS - 1)]
        number = len(self.terms) if stage else -1
        if stage:
            self.terms.append(term)
            self.stages.append(stage)
        self[term] = number
        return number


def _packed(block: int, local: _Local, ids: list, norms: list, numbers: list, tfs: list) -> pa.RecordBatch:
    """One row for each stage, and one of stage 0 that holds the ids of the documents."""
    number, tf = np.concatenate(numbers), np.concatenate(tfs)
    place = np.repeat(np.arange(len(ids)), [len(x) for x in numbers])
    owned = number >= 0
    number, tf, place = number[owned], tf[owned].astype(np.int64), place[owned]
    impact = (IMPACT * tf) // (PER_TF * tf + PER_LENGTH * np.array(norms, np.int64)[place])
    stages = np.array(local.stages, np.int64)
    order = np.lexsort((place, number, stages[number])) if len(number) else np.zeros(0, np.int64)
    number, place, impact = number[order], place[order].astype(np.int32), impact[order].astype(np.int32)
    rows = [(block, 0, [], [], np.array(ids, np.int64).tobytes(), None, None)]
    heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    tops = np.maximum.reduceat(impact, heads) if len(heads) else impact
    names = number[heads]
    for stage in np.unique(stages[names]):
        mine = np.flatnonzero(stages[names] == stage)
        begin, end = heads[mine[0]], heads[mine[-1] + 1] if mine[-1] + 1 < len(heads) else len(number)
        firsts = np.append(heads[mine] - begin, end - begin).astype(np.int32)
        terms = [local.terms[i] for i in names[mine]]
        rows.append((block, int(stage), terms, tops[mine].tolist(), firsts.tobytes(), place[begin:end].tobytes(), impact[begin:end].tobytes()))
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    arrays[2] = arrays[2].cast(pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays(arrays, ["block", "stage", "terms", "tops", "firsts", "places", "impacts"])


def postings(docs: DataFrame, table: bytes, documents: int, terms: int) -> DataFrame:
    """(block, stage, terms, tops, firsts, places, impacts): what a stage owns of a block of documents (id, text).

    A block is a run of documents of one reading task. ``places`` are documents of the block, the postings of a term stand
    between two of ``firsts``; an impact is the contribution for a weight of 1, ``tops`` the largest for each term. Under
    stage 0, ``firsts`` holds the ids. Only documents with a term are in a block, only terms of owned slots are posted.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        local, ids, norms, numbers, tfs, size = _Local(table), [], [], [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0), _texts(batch.column(1))):
                found = terms_of(text)
                if not found:
                    continue
                counted = Counter(found)
                numbers.append(np.fromiter(map(local.__getitem__, counted), np.int32, len(counted)))
                tfs.append(np.fromiter(counted.values(), np.int32, len(counted)))
                ids.append(row.as_py())
                norms.append(LENGTH_BASE + (LENGTH_SLOPE * len(found) * documents) // terms)
                size += len(text)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCUMENTS:
                    yield _packed(block, local, ids, norms, numbers, tfs)
                    block += 1
                    local, ids, norms, numbers, tfs, size = _Local(table), [], [], [], [], 0
        if ids:
            yield _packed(block, local, ids, norms, numbers, tfs)

    return docs.mapInArrow(work, "block bigint, stage int, terms array<string>, tops array<bigint>, firsts binary, places binary, impacts binary")


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, equal ones by id."""
    chosen = np.arange(len(scores))
    if len(scores) > k:
        chosen = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))][:k]


def _add(owned: pa.Table, sent: pa.Table, k: int) -> list[tuple]:
    """(item, places, scores, best scores, their ids) of a block, for each item that has documents left."""
    rows = {r["stage"]: r for r in owned.to_pylist()}
    if 0 not in rows:
        return []
    ids = np.frombuffer(rows.pop(0)["firsts"], np.int64)
    index, firsts, places, impacts = {}, None, None, None
    for row in rows.values():
        index = {t: i for i, t in enumerate(row["terms"])}
        firsts = np.frombuffer(row["firsts"], np.int32)
        places, impacts = np.frombuffer(row["places"], np.int32), np.frombuffer(row["impacts"], np.int32).astype(np.int64)
    asked, bounds, before = {}, [], {}
    for row in sent.to_pylist():
        bounds += row["bounds"] or []
        asked |= {x["item_id"]: x["terms"] for x in row["asked"] or []}
        if row["places"] is not None:
            before[row["item_id"]] = np.frombuffer(row["places"], np.int32), np.frombuffer(row["scores"], np.int64)
    out = []
    for bound in bounds:
        item = bound["item_id"]
        scores = np.zeros(len(ids), np.int64)
        old, had = before.get(item, (np.zeros(0, np.int32), np.zeros(0, np.int64)))
        scores[old] = had
        for term in asked.get(item, ()):
            i = index.get(term["term"])
            if i is not None:
                a, b = firsts[i], firsts[i + 1]
                scores[places[a:b]] += term["weight"] * impacts[a:b]
        # A document without a score so far gains from this stage on at most what the item's terms can give.
        held = old if bound["gain"] < bound["least"] else np.flatnonzero(scores > 0)
        if not len(held):
            continue
        reached = scores[held]
        least = bound["least"]
        if len(held) >= k:
            least = max(least, int(np.partition(reached, len(held) - k)[len(held) - k]))
        open_ = reached + bound["later"] >= least
        held, reached = held[open_].astype(np.int32), reached[open_]
        best = _first(reached, ids[held], k)
        out.append((item, held.tobytes(), reached.tobytes(), reached[best].tolist(), ids[held][best].tolist()))
    return out


def _stage(owned: DataFrame, sent: DataFrame, kind: str, k: int, last: bool) -> DataFrame:
    """The scores of all items in all blocks after the owner of a stage has added its terms."""

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _add(left, right, k)
        columns = list(zip(*rows)) if rows else [()] * 5
        packed = [None] * len(rows)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "item_id": pa.array(columns[0], right.schema.field("item_id").type),
                "places": pa.array(packed if last else columns[1], pa.binary()),
                "scores": pa.array(packed if last else columns[2], pa.binary()),
                "best": pa.array(columns[3], pa.list_(pa.int64())),
                "ids": pa.array(columns[4], pa.list_(pa.int64())),
            }
        )

    schema = f"block bigint, item_id {kind}, places binary, scores binary, best array<bigint>, ids array<bigint>"
    return owned.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(work, schema)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    k: int = TOP,
    stages: int = STAGES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest positive score for each item.

    Equal scores by ascending id, null ids last; rows that share an id each take a rank. Null and empty texts have no term:
    as documents they are not counted and never found, as items they find nothing. Items of one id are one item with the
    terms of all of them; items without an id are left out. Empty tables give no rows. Texts are read whole, other columns
    not at all.

    1. Documents are read for the df of item terms, their number and that of their terms.
    2. Terms get owners by their frequency, through a table of fixed size. Documents are read again, and each block's
       postings are written, one row for each owner: integers, packed.
    3. One stage for each owner: a cogroup by block brings the bundles, with the scores so far, to the owner's postings.
       After it, the ``k``-th best score of an item over all blocks bounds its result from below, and the terms still to
       come bound what a document can gain: documents without a score are taken up only while they could reach the
       former, and those that no longer can are left. A block holds a bounded number of documents, whatever they say.
    4. Each block names at most ``k`` documents for an item, of which the best are taken.
    """
    spark = docs.sparkSession
    kind = items.schema[item_column].dataType.simpleString()
    texts = items.where(F.col(item_column).isNotNull()).select(F.col(item_column).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    wanted = stored(item_terms(texts))
    rows = docs.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(_NO_ID)).alias("id"), F.col(text_column).cast("string").alias("text"))
    counts = stored(term_counts(rows.select("text"), marked_slots(wanted)))
    documents, terms = counts.where("term IS NULL").agg(F.sum("df"), F.sum("terms")).first()
    weight = F.floor(1000 * F.log((2 * F.lit(documents or 0) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    asked = stored(wanted.join(counts, "term").select("item_id", "term", "df", weight.alias("weight")))
    table = owners(asked, stages)
    posted = stored(postings(rows, table, documents or 0, terms or 1))

    # The terms of each item by stage, with what they can give a document at most.
    owned = posted.where("stage > 0").select("stage", F.explode(F.arrays_zip("terms", "tops")).alias("t"))
    tops = owned.groupBy(F.col("t.terms").alias("term")).agg(F.min("stage").alias("stage"), F.max("t.tops").alias("top"))
    by_stage = stored(
        asked.join(tops, "term")
        .groupBy("item_id", "stage")
        .agg(F.sum(F.col("weight") * F.col("top")).alias("gain"), F.collect_list(F.struct("term", "weight")).alias("terms"))
    )
    blocks = posted.where("stage = 0").select(F.col("block").alias("place"))
    copies = max(1, blocks.count() // SHARING_BLOCKS)
    bundles = max(1, -(-wanted.select("item_id").distinct().count() // BUNDLE))
    dealt = blocks.withColumn("copy", F.pmod(F.xxhash64("place"), F.lit(copies)))
    scores = None
    for stage in range(1, stages + 1):
        of = lambda column, when: F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0)).alias
        bounds = by_stage.groupBy("item_id").agg(
            of("gain", F.col("stage") >= stage)("gain"),
            of("gain", F.col("stage") > stage)("later"),
            F.first(F.when(F.col("stage") == stage, F.col("terms")), ignorenulls=True).alias("terms"),
        )
        least = F.lit(0).cast("bigint").alias("least")
        if scores is not None:
            reached = scores.select("item_id", F.explode("best").alias("score"))
            place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score")))
            kth = reached.withColumn("r", place).where(F.col("r") <= k).where(F.col("r") == k).select("item_id", F.col("score").alias("least"))
            bounds, least = bounds.join(kth, "item_id", "left"), F.coalesce("least", F.lit(0)).alias("least")
        bounds = bounds.select("item_id", "terms", "gain", "later", least).withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)))
        bundle = bounds.groupBy("bundle").agg(
            F.collect_list(F.struct("item_id", "gain", "later", "least")).alias("bounds"),
            F.collect_list(F.when(F.col("terms").isNotNull(), F.struct("item_id", "terms"))).alias("asked"),
        )
        copied = stored(bundle).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))))
        sent = dealt.join(copied, "copy").select(F.col("place").alias("block"), F.lit(None).cast(kind).alias("item_id"), "bounds", "asked")
        none = F.lit(None).cast("binary")
        sent = sent.withColumns({"places": none, "scores": none})
        if scores is not None:
            sent = sent.unionByName(scores.select("block", "item_id", "places", "scores"), allowMissingColumns=True)
        scores = stored(_stage(posted.where(F.col("stage").isin(0, stage)), sent, kind, k, last=stage == stages))
    named = scores.select("item_id", F.explode(F.arrays_zip("best", "ids")).alias("z"))
    named = named.select("item_id", F.col("z.ids").alias("id"), F.col("z.best").alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "id"))
    best = named.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.when(F.col("id") < _NO_ID, F.col("id")).alias("doc_id"), "score")
