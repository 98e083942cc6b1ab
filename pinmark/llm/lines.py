"""Line deduplication: a suffix array over line sequences by distributed prefix doubling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Runs of at least that many lines are removed where they are repeated.
LEAST_LINES = 3

#: So are runs of fewer lines, one line included, that hold at least that many words.
LEAST_WORDS = 20

_WORD = r"[^\x20\x09-\x0D]+"


def _ranked(keys: DataFrame, *order: str) -> DataFrame:
    """``keys`` with ``rank``, their place in the order, without bringing them into one task.

    Keys are dealt by range and numbered in their partition; the partitions' sizes, as many rows as partitions, give
    the offsets.
    """
    dealt = stored(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("bigint")
    return dealt.withColumn("within", within).join(before, "part").withColumn("rank", F.col("within") + F.col("before")).drop("part", "within", "before")


def _refined(places: DataFrame, keys: list[str]) -> DataFrame:
    """Suffixes that share their keys with another one, and the rank of the keys; all others are alone and set aside."""
    shared = places.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return stored(places.join(_ranked(shared, *keys), keys).select("row", "id", "line", "rank"))


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """(row, id, line, rank) of all suffixes whose first ``depth`` lines begin another suffix as well.

    ``lines``: (row, id, line, key). rank is the place of those lines in the order of suffixes, so the suffixes of one rank
    are an interval of the suffix array whose longest common prefix is ``depth`` or more. Ranks by the first d lines are
    known; a pair of them, of a suffix and of the one ``step`` lines later, gives the order by d + step lines, with step = d
    as long as the depth allows it. A suffix without a partner ends before or goes on with lines that are nowhere else.
    """
    return list(_ranks(lines, depth, depth))[-1][1]


def _ranks(lines: DataFrame, depth: int, longest: int) -> Iterator[tuple[int, DataFrame]]:
    """(d, ``suffix_ranks`` of d lines) for growing d up to ``depth``, by steps of at most ``longest`` lines."""
    ranks, known = _refined(lines, ["key"]), 1
    yield known, ranks
    while known < depth:
        step = min(known, depth - known, longest)
        later = ranks.select("row", (F.col("line") - step).alias("line"), F.col("rank").alias("next"))
        pairs = ranks.withColumnRenamed("rank", "first").join(later, ["row", "line"])
        ranks, known = _refined(pairs, ["first", "next"]), known + step
        yield known, ranks


def _numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), F.split(text, "\n", -1).alias("lines"), F.monotonically_increasing_id().alias("row"))


def _place() -> Column:
    """Order of places: by id (null last), then row, then line."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "line")


def _later(ranks: DataFrame, depth: int) -> DataFrame:
    """(row, line) of the lines of all runs of ``depth`` lines but those at the first place of their rank."""
    first = ranks.groupBy("rank").agg(F.min(_place()).alias("place"))
    copies = ranks.join(first, "rank").where((F.col("row") != F.col("place.row")) | (F.col("line") != F.col("place.line")))
    return copies.select("row", F.explode(F.sequence(F.col("line"), F.col("line") + depth - 1)).alias("line"))


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_LINES, words: int | None = None) -> DataFrame:
    """(row, removed): the lines of each text that lie in a run of ``least`` lines which also stands earlier.

    With ``words`` not None, so do lines of a shorter run that holds that many words. Runs of one rank are an interval of the
    suffix array; all but the one at the first place are later copies. Copies that overlap or follow each other merge, so
    what is removed are the maximal repeated runs.
    """
    numbered = _numbered(docs, id_column, text_column)
    lines = numbered.select("row", "id", F.posexplode("lines").alias("line", "text"))
    lines = stored(lines.select("row", "id", "line", F.unhex(F.md5("text")).alias("key")))
    if words is None:
        gone = _later(suffix_ranks(lines, least), least)
    else:
        counts = numbered.select("row", F.transform("lines", lambda t: F.regexp_count(t, F.lit(_WORD))).alias("counts"))
        runs = [F.expr(f"transform(counts, (c, i) -> aggregate(slice(counts, i + 1, {d}), 0L, (a, x) -> a + x) >= {int(words)})") for d in range(1, least)]
        large = counts.select("row", F.posexplode(F.arrays_zip(*(r.alias(f"large{d}") for d, r in enumerate(runs, 1)))).alias("line", "of")) if runs else None
        large = stored(large.select("row", "line", "of.*").where(f"large{least - 1}")) if runs else None
        gone = None
        for depth, ranks in _ranks(lines, least, 1):
            # Equal runs hold equally many words, so a rank stays whole or goes whole.
            kept = ranks if depth == least else ranks.join(large.where(f"large{depth}").select("row", "line"), ["row", "line"])
            gone = _later(kept, depth) if gone is None else gone.union(_later(kept, depth))
    return gone.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_LINES, words: int | None = None) -> DataFrame:
    """(id, n_lines, n_removed, n_runs, kept_text) of each row: later copies of repeated line runs are deleted.

    A run counts from ``least`` lines on, and a shorter one, of one line or more, if it holds ``words`` words (None: never).
    Lines are what ``\\n`` separates, compared as they are. Of equal runs the one at the first place stays: the smallest id
    (null last), then the row that is read first, then the first line. Null texts are one empty line, as empty texts are;
    every row gives a row, repeated rows included. n_runs counts the maximal runs of deleted lines. ``docs`` is read twice
    and must give its rows in the same order both times, as files do. Other columns are not read.
    """
    gone = repeated_lines(docs, id_column, text_column, least, words)
    rows = _numbered(docs, id_column, text_column).join(gone, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.expr("transform(array_except(sequence(0, size(lines) - 1), removed), i -> lines[i])")
    heads = F.expr("size(filter(removed, (x, i) -> i = 0 or removed[i - 1] != x - 1))")
    return rows.select(
        "id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("removed").cast("bigint").alias("n_removed"),
        heads.cast("bigint").alias("n_runs"),
        F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.array_join("lines", "\n")).alias("kept_text"),
    )
