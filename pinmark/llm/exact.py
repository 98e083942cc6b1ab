"""Exact duplicates by two passes of Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: ``[\x20\x09-\x0D]``
BLANKS = " \t\n\x0b\x0c\r"

#: Bits of the filter for each row, and hash functions.
BITS_A_ROW = 16
HASHES = 2

#: Up to this size the filter is sent to all executors; beyond it rows meet their part of the filter by a join.
BROADCAST_BYTES = 8 << 20

#: Bits of one row of the filter, as ``bitmap_construct_agg`` has them.
_PART = 32768


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _position(k: int, bits: int) -> Column:
    return F.xxhash64("sha", F.lit(k)).bitwiseAND(F.lit(bits - 1).cast("bigint"))


def filter_bits(rows: int) -> int:
    """A power of two, so that the filter grows with the table and its error rate does not."""
    return max(_PART, 1 << ceil(log2(max(1, rows) * BITS_A_ROW)))


def repeated_filter(hashed: DataFrame, bits: int) -> DataFrame:
    """First pass: (part, bitmap) of the bits that were set more than once.

    A hash that occurs twice sets all its bits twice, so a row with a bit that is not in the result is certainly alone.
    Only bit positions are exchanged, counted per task before.
    """
    positions = hashed.select(F.explode(F.array(*(_position(k, bits) for k in range(HASHES)))).alias("position"))
    twice = positions.groupBy("position").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.expr(f"position div {_PART}").alias("part")).agg(F.expr(f"bitmap_construct_agg(position % {_PART})").alias("bitmap"))


def tagged(hashed: DataFrame, seen_twice: DataFrame, bits: int, small: bool) -> DataFrame:
    """Second pass: the rows with ``maybe``, whether all their bits were set more than once.

    ``small``: the filter may be sent to all executors, so that no row moves.
    """
    out = hashed.withColumn("maybe", F.lit(True))
    for k in range(HASHES):
        side = seen_twice.toDF("__part", "__bitmap")
        out = out.withColumn("__position", _position(k, bits))
        out = out.join(F.broadcast(side) if small else side, F.expr(f"__position div {_PART}") == F.col("__part"), "left")
        byte = F.expr(f"cast(conv(hex(substring(__bitmap, cast(__position % {_PART} div 8 as int) + 1, 1)), 16, 10) as int)")
        bit = F.call_function("getbit", byte, F.expr("cast(__position % 8 as int)")) == 1
        out = out.withColumn("maybe", F.col("maybe") & F.coalesce(bit, F.lit(False))).drop("__part", "__bitmap", "__position")
    return out


def _filter(hashed: DataFrame) -> tuple[DataFrame, int, bool]:
    bits = filter_bits(hashed.count())
    return stored(repeated_filter(hashed, bits)), bits, bits // 8 <= BROADCAST_BYTES


def _best() -> Column:
    """The order in which rows of a group are preferred: most code points, then smallest id, then first read."""
    return F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("no_id"), "id", "row")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, keep, group_size, kept, sha) for each row: texts that are equal without white space are a group.

    Of a group the row with the most code points in its original text stays, then the one with the smallest id (null
    last), then any one; so of rows that repeat all this exactly one is kept. Null texts count as empty. Other columns
    are not read, an empty table gives an empty table.

    Texts are hashed once into a narrow table. Rows whose hash is certainly alone pass without an exchange; the others are
    grouped, combined per task first, and joined with their group, a join that adaptive execution splits for a large group.
    """
    hashed = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.sha2(normalised(F.col(text_column)), 256).alias("sha"),
            F.char_length(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).cast("bigint").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    seen_twice, bits, small = _filter(hashed)
    rows = tagged(hashed, seen_twice, bits, small)
    alone = rows.where("not maybe").select("id", F.col("id").alias("keep"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    several = rows.where("maybe").drop("maybe")
    groups = several.groupBy("sha").agg(F.min(_best()).alias("best"), F.count("*").alias("group_size"))
    decided = several.join(groups, "sha").select("id", F.col("best.id").alias("keep"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    return alone.unionByName(decided)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_duplicates`` for which these are.

    Rows that are certainly alone pass straight through with their texts; only the others are exchanged.
    """
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_, text = (inner[f"c{names.index(c)}"] for c in (id_column, text_column))
    whole = inner.withColumns(
        {"sha": F.sha2(normalised(text), 256), "size": F.char_length(F.coalesce(text.cast("string"), F.lit(""))).cast("bigint"), "id": id_}
    )
    hashed = stored(whole.select("id", "sha", "size", F.lit(0).alias("row")))
    seen_twice, bits, small = _filter(hashed)
    best = tagged(hashed, seen_twice, bits, small).where("maybe").groupBy("sha").agg(F.min(_best()).alias("best"))
    best = best.select(F.col("sha").alias("__sha"), F.col("best.id").alias("__id"), (-F.col("best.size")).alias("__size"))
    rows = tagged(whole, seen_twice, bits, small)
    columns = [f"c{i}" for i in range(len(names))]
    several = rows.where("maybe").join(best, F.expr("sha = __sha and size = __size and id <=> __id"), "left_semi").dropDuplicates(["sha"])
    return rows.where("not maybe").select(*columns).union(several.select(*columns)).toDF(*names)
