"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .storage import stored

CAPACITIES = (512, 1024, 2048, 4096)

#: What a sequence costs besides its length, in tokens.
OVERHEAD = 16

#: Tokens that are packed together; each pack leaves a few sequences less full than they could be.
SHARD_TOKENS = 2 << 20


def _filled(lengths: list[int], counts: list[int], first: int, room: int) -> int:
    """What a bin with ``room`` left takes of the pieces not yet placed if it always takes the longest that fits."""
    taken, at = 0, bisect_left(lengths, room + 1) - 1
    while at >= 0 and room >= lengths[0]:
        if counts[at] - (at == first):
            used = min(counts[at] - (at == first), room // lengths[at] if lengths[at] else counts[at])
            taken, room = taken + used * lengths[at], room - used * lengths[at]
        at = min(at - 1, bisect_left(lengths, room + 1) - 1)
    return taken


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin and its place in the bin, and the capacity of each bin.

    Pieces go, longest first, to the open bin that they fill best (the least room that is enough, the oldest of equals).
    Where none has room, a bin is opened. Of the permitted capacities that hold the piece the one is taken that costs
    least for each token it will hold, judged by the pieces still to be placed; the smaller of equals. At the end a bin
    gets the smallest permitted capacity that holds its contents. No piece may be longer than the largest capacity;
    pieces of length 0 take no room.
    """
    capacities = sorted(set(capacities))
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    lengths, counts = (x.tolist() for x in np.unique(np.asarray(sizes, np.int64), return_counts=True))
    rooms: list[tuple[int, int]] = []
    fills: list[int] = []
    bins, places = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for piece in order.tolist():
        size = int(sizes[piece])
        kind = bisect_left(lengths, size)
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, bin_ = rooms.pop(at)
        else:
            options = [c for c in capacities if c >= size]
            costs = [(c + overhead) / max(1, size + _filled(lengths, counts, kind, c - size)) for c in options]
            room, bin_ = options[costs.index(min(costs))], len(fills)
            fills.append(0)
        counts[kind] -= 1
        bins[piece], places[piece] = bin_, fills[bin_]
        fills[bin_] += size
        insort(rooms, (room - size, bin_))
    return bins, places, np.array([capacities[bisect_left(capacities, f)] for f in fills], np.int64)


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """(id, piece, start, length, bin, place, capacity, fill) of each piece of each text, in words ``[^\\x20\\x09-\\x0D]``.

    A text longer than the largest capacity is cut into pieces of that size and a rest; start is the piece's first word.
    Every row is placed: null and empty texts as one piece of length 0, repeated rows each for itself, null ids as they
    are. Other columns are not read, and an empty table gives an empty table. Rows are dealt into packs of about
    ``shard_tokens`` words by a hash of their place, so their number grows with the input and no key gathers in one.
    """
    largest = max(capacities)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = tokens.split(*tokens.text_bytes(batch.column(1))).counts
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "size"])

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    sizes = narrow.mapInArrow(measure, f"id {kind}, size bigint")
    sizes = stored(sizes.withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // shard_tokens))
    pieces = sizes.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("size", F.lit(1)) - 1, F.lit(largest).cast("bigint"))))
    pieces = pieces.select("id", "row", "start", F.least(F.col("size") - F.col("start"), F.lit(largest)).alias("length"), F.pmod(F.xxhash64("row", "start"), F.lit(shards)).alias("shard"))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("start", "ascending")])
        length = group.column("length").to_numpy()
        bins, places, capacity = pack(length, capacities, overhead)
        fills = np.bincount(bins, weights=length, minlength=len(capacity)).astype(np.int64)
        return pa.table(
            {
                "id": group.column("id"),
                "piece": pa.array(group.column("start").to_numpy() // largest, pa.int64()),
                "start": group.column("start"),
                "length": group.column("length"),
                "bin": pa.array((group.column("shard")[0].as_py() << 32) + bins, pa.int64()),
                "place": pa.array(places, pa.int64()),
                "capacity": pa.array(capacity[bins], pa.int64()),
                "fill": pa.array(fills[bins], pa.int64()),
            }
        )

    return pieces.groupBy("shard").applyInArrow(fill, f"id {kind}, piece bigint, start bigint, length bigint, bin bigint, place bigint, capacity bigint, fill bigint")
