"""Substring deduplication: Rabin-Karp hashes of every fixed-length window of words, counted in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

WIDTH = 35

#: Characters of text that are hashed in one go, and that share one table of window hashes.
BLOCK_CHARS = 4 << 20

#: Window hashes that are counted in one go.
BUCKET_WINDOWS = 1 << 20


def _hashed(column: pa.ChunkedArray, width: int):
    data, offsets = tokens.text_bytes(column)
    words = tokens.split(data, offsets)
    hashes, at = tokens.windows_hash(tokens.slices_hash(data, words.starts, words.ends), words.first, width)
    return data, offsets, words, hashes, at


def _kept_text(data, offsets, words: tokens.Words, removed: np.ndarray, one_space: bool) -> pa.Array:
    if one_space:
        return tokens.to_strings(*tokens.joined(data, words, ~removed))
    # A word takes the space behind it along, the first word of a text also the space before it.
    starts, ends = words.starts.copy(), np.append(words.starts[1:], 0)
    has = words.counts > 0
    ends[words.first[1:][has] - 1] = offsets[1:][has]
    starts[words.first[:-1][has]] = offsets[:-1][has]
    out, lengths = tokens.cut(data, starts[~removed], ends[~removed])
    sizes = np.bincount(words.rows[~removed], weights=lengths, minlength=len(has)).astype(np.int64)
    return tokens.to_strings(out, np.concatenate([[0], np.cumsum(sizes)]))


def remove_repeated_windows(
    docs: DataFrame, text_column: str = "text", width: int = WIDTH, one_space: bool = False
) -> DataFrame:
    """All columns of ``docs`` and n_words, n_removed, kept_text; a column of ``docs`` of one of these names gives way.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A window is ``width`` successive words of one text. A word is removed if a
    window that holds it occurs at another place of any text, the same one included; overlapping windows so merge into
    maximal removal intervals. Windows are judged on the input. ``one_space``: kept words are joined by one space; else
    the white space between them stays as it is, and a text that loses nothing is unchanged. Null texts are empty and
    have no words; texts shorter than a window lose nothing; of repeated rows each loses all that repeats.

    Texts are dealt into blocks by a hash of the row. A block is hashed in one go and sends each different window hash
    once, with a mark if the block holds it twice, so a window that is everywhere comes once from each block. Hashes are
    packed by their leading bits, 8 bytes each, and meet in buckets whose number grows with the input; every bucket
    answers each block with one bit for each hash. Texts are exchanged once: both uses of the blocks share the exchange.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    inner = docs.select(*(docs[c] for c in names)).toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index(text_column)}"
    inner = inner.withColumn(text, F.col(text).cast("string"))
    chars = inner.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    bits = max(0, (max(1, chars // 6 // BUCKET_WINDOWS) - 1).bit_length())
    hashed_by = [c for c in inner.columns if not isinstance(inner.schema[c].dataType, (T.MapType, T.VariantType))]
    dealt = inner.withColumn("block", F.pmod(F.xxhash64(*hashed_by), F.lit(blocks))).repartition("block")

    def send(group: pa.Table) -> pa.Table:
        _, _, _, hashes, _ = _hashed(group.column(text), width)
        unique, counts = np.unique(hashes, return_counts=True)
        buckets = (unique >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(unique), np.int64)
        edges = np.searchsorted(buckets, np.arange((1 << bits) + 1))
        filled = np.flatnonzero(np.diff(edges))
        many = counts > 1
        return pa.table(
            {
                "bucket": pa.array(filled, pa.int64()),
                "block": pa.array(np.full(len(filled), group.column("block")[0].as_py()), pa.int64()),
                "hashes": pa.array([unique[edges[i] : edges[i + 1]].tobytes() for i in filled], pa.binary()),
                "many": pa.array([np.packbits(many[edges[i] : edges[i + 1]]).tobytes() for i in filled], pa.binary()),
            }
        )

    def count(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
        sizes = [len(p) for p in parts]
        many = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(group.column("many"), sizes)])
        _, place, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        repeated = (counts > 1)[place] | many.astype(bool)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table(
            {
                "block": group.column("block"),
                "bucket": group.column("bucket"),
                "size": pa.array(sizes, pa.int64()),
                "repeated": pa.array([np.packbits(repeated[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
            }
        )

    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets, words, hashes, at = _hashed(texts.column(text), width)
        removed = np.zeros(len(words.starts), bool)
        if len(hashes):
            answers = answers.sort_by("bucket")
            repeated = np.concatenate(
                [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n.as_py()) for x, n in zip(answers.column("repeated"), answers.column("size"))]
            ).astype(bool)
            _, place = np.unique(hashes, return_inverse=True)
            removed = tokens.covered(at[repeated[place]], width, len(removed))
        out = {c: texts.column(c) for c in columns}
        out["n_words"] = pa.array(words.counts, pa.int64())
        out["n_removed"] = pa.array(tokens.row_sums(removed, words.first), pa.int64())
        out["kept_text"] = _kept_text(data, offsets, words, removed, one_space)
        return pa.table(out)

    columns = inner.columns
    sent = dealt.groupBy("block").applyInArrow(send, "bucket bigint, block bigint, hashes binary, many binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "block bigint, bucket bigint, size bigint, repeated binary")
    schema = T.StructType([*inner.schema.fields, *T._parse_datatype_string("n_words bigint, n_removed bigint, kept_text string").fields])
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, schema)
    if not one_space:
        out = out.withColumn("kept_text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.coalesce(text, F.lit(""))))
    return out.toDF(*names, "n_words", "n_removed", "kept_text")
