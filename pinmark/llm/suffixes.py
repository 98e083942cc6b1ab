"""Suffix-array deduplication of bytes: shard Burrows-Wheeler transforms are merged by interleave refinement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

#: Bytes of a string that counts as repeated.
WIDTH = 50

#: Bytes of the grams of which every string of ``WIDTH`` bytes names its least one.
GRAM = 20

#: One gram in so many begins a chunk.
CHUNK = 128

#: Characters that are worked on in one go.
BLOCK_CHARS = 4 << 20

#: Bytes of text for each bucket that shards are merged in.
BUCKET_CHARS = 4 << 20

#: Places that are hashed in one go, so that all arrays stay in the cache.
PIECE = 1 << 15

#: One in so many bytes of a bucket is what the strings under one gram may take before they are dealt by themselves.
HOT_SHARE = 4

_LAST = np.int64(np.iinfo(np.int64).max)
_NONE = np.uint32(np.iinfo(np.uint32).max)


# --- One bucket: shard transforms and their merge. ---------------------------------------------------------------------


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit keys in order and their stable order: one sort of numbers that carry their place in the low half."""
    packed = keys.astype(np.uint64) << np.uint64(32)
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    keys = (packed >> np.uint64(32)).astype(np.uint32)
    packed &= np.uint64(0xFFFFFFFF)
    return keys, packed.view(np.int64)


def _order_of_pairs(high: np.ndarray, low: np.ndarray, below: int) -> np.ndarray:
    """An order of pairs of numbers that are less than ``below``; pairs and places are packed into one word if they fit."""
    bits, place = max(1, below - 1).bit_length(), len(high).bit_length()
    if 2 * bits + place > 64:
        return np.lexsort((low, high))
    packed = (high << bits | low).astype(np.uint64) << np.uint64(place)
    packed |= np.arange(len(high), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << place) - 1)
    return packed.view(np.int64)


def _ended(strings: np.ndarray, length: int) -> np.ndarray:
    """Strings of up to eight symbols, the first in the high byte, with nothing left behind a terminator."""
    kind, bits = strings.dtype.type, 8 * strings.dtype.itemsize
    ones = kind(int.from_bytes(bytes([1] * (bits // 8)), "big"))
    # Some byte is 0 if and only if taking 1 from each byte borrows in a byte whose high bit was not set.
    some = np.flatnonzero((strings - ones) & ~strings & (ones << kind(7)))
    ending = strings[some]
    for place in range(8 * length - 8, 0, -8):
        ending[(ending >> kind(place)) & kind(0xFF) == 0] &= kind(np.iinfo(kind).max >> place << place)
    strings[some] = ending
    return strings


def shard_order(text: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of one shard by the first ``depth`` symbols, and which of its items differ in them from the one before.

    ``text``: segments with a terminator 0 after each; ``lengths``: with the terminator. Nothing behind a terminator
    counts. Suffixes are sorted by four symbols; then the rank of a suffix by some symbols and that of the one so many
    symbols later sort by twice as many. Only suffixes whose rank is shared are sorted again.
    """
    n = len(text)
    stops = np.cumsum(lengths)
    left = np.repeat(stops - 1, lengths) - np.arange(n)
    padded = np.concatenate([text, np.zeros(4, np.uint8)])
    known = min(4, depth)
    keys = _ended(np.lib.stride_tricks.sliding_window_view(padded, 4)[:n].copy().view(">u4").ravel().astype(np.uint32), 4)
    keys &= np.uint32(0xFFFFFFFF << 8 * (4 - known) & 0xFFFFFFFF)
    keys, order = _sorted(keys)
    head = np.append(keys[1:] != keys[:-1], True)
    head = np.append(True, head)  # with the end as last item
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:-1], np.arange(n), 0))
    while known < depth:
        reach = min(known, depth - known)
        at = np.flatnonzero(~(head[:-1] & head[1:]))
        at = at[left[order[at]] >= known]
        places = order[at]
        high, low = rank[places], rank[places + reach]
        dealt = _order_of_pairs(high, low, n)
        low, places = low[dealt], places[dealt]
        # Ranks are first places, and only places inside a rank change.
        first = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(at)]
        order[at] = places
        head[at] |= first
        rank[places] = np.maximum.accumulate(np.where(first, at, 0))
        known += reach
    return order, head[:-1]


def shard_transform(text: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of one shard.

    An item has the eight symbols before the suffix, the nearest one in the low byte; before the first symbol of a segment
    comes its terminator.
    """
    stops = np.cumsum(lengths)
    previous = np.arange(-1, len(text) - 1)
    previous[stops - lengths] = stops - 1
    near = text[previous].astype(np.uint64)
    for symbols in (1, 2, 4):
        near |= near[previous] << np.uint64(8 * symbols)
        previous = previous[previous]
    return near[order]


def merged_intervals(transforms: list[np.ndarray], depth: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, interval): the suffixes that share their first ``depth`` symbols with one of another owner, interval by interval.

    The transforms lie one after the other; ``order`` lists places in them, whose owners are ``owner``, and so is the
    interleave: it says from which shard the next suffix comes, and within a shard places only grow. It begins with shard
    after shard. In each round the symbols of the transforms are read in the order of the interleave and the suffixes dealt
    out by them, which sorts by eight symbols more (by what eights leave over in the last round); the place a suffix goes to
    in its shard is known from the shard's transform alone. A border that a round opens separates suffixes that differ in
    the symbols sorted by so far, so an interval holds the suffixes with a common prefix of that many symbols.

    An interval of one owner is closed and takes no part in further rounds: what its suffixes become with symbols before
    them is an interval of that owner again. So do suffixes that would begin with or before a terminator.
    """
    symbols = np.concatenate(transforms)
    n = len(symbols)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in transforms])]).tolist()
    order, interval = np.arange(n), np.zeros(n, np.int64)
    for length, rounds in ((8, depth // 8), (depth % 8, 1)):
        if not length or not rounds or not len(order):
            continue
        strings = _ended(symbols & np.uint64((1 << 8 * length) - 1), length)
        # What the rounds deal by are the numbers of the different strings.
        if length > 3:
            by = np.argsort(strings)
            dealt = strings[by]
            added = np.empty(n, np.uint32)
            added[by] = np.cumsum(np.append(False, dealt[1:] != dealt[:-1]), dtype=np.uint32)
        else:
            added = strings.astype(np.uint32)
        follows = np.empty(n, np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            follows[a + _sorted(added[a:b])[1]] = np.arange(a, b)
        # A terminator among the symbols ends them all, so it is the nearest one if there is any.
        added[strings & np.uint64(0xFF) == 0] = _NONE
        for _ in range(rounds):
            keys = added[order]
            held = np.flatnonzero(keys != _NONE)
            if not len(held):
                return order[:0], interval[:0]
            # Reading in the order of the interleave is nearly sequential, so one number with all goes through the deal.
            both = interval[held] << 32 | follows[order[held]]
            keys, dealt = _sorted(keys[held])
            both = both[dealt]
            interval, order = both >> 32, both & 0xFFFFFFFF
            same = (keys[1:] == keys[:-1]) & (interval[1:] == interval[:-1])
            whose = owner[order]
            # Heads of intervals, and whether an owner in them differs from the one before.
            heads = np.append(0, np.flatnonzero(~same) + 1)
            several = np.logical_or.reduceat(np.append(False, same & (whose[1:] != whose[:-1])), heads)
            sizes = np.diff(np.append(heads, len(order)))
            order = order[np.repeat(several, sizes)]
            sizes = sizes[several]
            interval = np.repeat(np.arange(len(sizes)), sizes)
    return order, interval


def _least(values: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each item the least one of its interval; ``head`` says which items begin one."""
    if not len(values):
        return values
    heads = np.flatnonzero(head)
    return np.repeat(np.minimum.reduceat(values, heads), np.diff(np.append(heads, len(values))))


def earlier(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> list[np.ndarray]:
    """For each shard (text, lengths, owner of each segment) and each of its places: does the string of ``depth`` symbols
    that begins there also begin in a segment of a smaller owner?"""
    orders = [shard_order(text, lengths, depth)[0] for text, lengths, _ in shards]
    transforms = [shard_transform(text, lengths, order) for (text, lengths, _), order in zip(shards, orders)]
    edges = np.concatenate([[0], np.cumsum([len(order) for order in orders])])
    place = np.concatenate([order + first for order, first in zip(orders, edges)])
    owner = np.concatenate([np.repeat(o, n) for _, n, o in shards])
    order, interval = merged_intervals(transforms, depth, owner[place])
    place = place[order]
    out = np.zeros(len(owner), bool)
    out[place] = owner[place] > _least(owner[place], np.append(True, interval[1:] != interval[:-1])[: len(place)])
    return [out[a:b] for a, b in zip(edges[:-1], edges[1:])]


# --- One block: which places are left to be asked for. ------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """For each place the next eight bytes as one number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _hash(words: np.ndarray, at: np.ndarray | slice, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each of the places, eight bytes a step; it only deals strings out."""
    shift = (lambda k: slice(at.start + k, at.stop + k)) if isinstance(at, slice) else (lambda k: at + k)
    out = np.zeros(1, np.uint64)
    for k in range(0, length, 8):
        step = np.array(words[shift(k)], np.uint64)
        if length - k < 8:
            step &= np.uint64((1 << 8 * (length - k)) - 1)
        step ^= out
        step *= np.uint64(0x9E3779B97F4A7C15)
        step ^= step >> np.uint64(32)
        out = step
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _grams(data: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the ``width`` bytes from each place the least hash of a gram, and whether their first gram begins a chunk.

    Both are meaningless where there are not so many bytes.
    """
    words, n = _words(data), len(data)
    out, cut, want = np.zeros(n, np.uint64), np.zeros(n, bool), width - gram + 1
    for a in range(0, n - width + 1, PIECE):
        b = min(a + PIECE, n - width + 1)
        least, have = _hash(words, slice(a, b + want - 1), gram), 1
        cut[a:b] = least[: b - a] & np.uint64(CHUNK - 1) == 0
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        out[a:b] = least
    return out, cut


def _segments(starts: np.ndarray, counts: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of places (first, number) that lie next to each other as one; ``apart`` says which do not go with the one before."""
    head = np.append(True, (starts[1:] != starts[:-1] + counts[:-1]) | apart[1:])[: len(starts)]
    first = np.flatnonzero(head)
    return first, np.add.reduceat(counts, first) if len(first) else counts


def _ended_text(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the segments as symbols from 1 on, a terminator after each."""
    text, _ = tokens.cut(data, starts, starts + lengths)
    out = np.zeros(len(text) + len(lengths), np.uint8)
    held = np.ones(len(out), bool)
    held[np.cumsum(lengths + 1) - 1] = False
    out[held] = text + np.uint8(1)  # no byte of UTF-8 is 255
    return out


def _by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fill, and the borders between them."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.searchsorted(buckets, np.arange((1 << bits) + 1))
    filled = np.flatnonzero(np.diff(edges))
    return filled, np.column_stack([edges[filled], edges[filled + 1]]) if len(filled) else np.zeros((0, 2), np.int64)


def _bits(values: np.ndarray) -> bytes:
    return np.packbits(values).tobytes()


def _unpacked(cell: pa.Scalar, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(cell.as_buffer(), np.uint8), count=n).astype(bool)


def _named(blocks: list[tuple[np.ndarray, np.ndarray]], most: int) -> list[bytes]:
    """For each block (grams, bytes of their strings): bits of the grams that several blocks have, then of the hot.

    A gram is hot if the strings under it take more than ``most`` bytes in all blocks together.
    """
    keys, chars = (np.concatenate(c) for c in zip(*blocks))
    different, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    several, hot = (counts > 1)[place], (np.bincount(place, chars, len(different)) > most)[place]
    edges = np.concatenate([[0], np.cumsum([len(b[0]) for b in blocks])])
    return [_bits(several[a:b]) + (_bits(hot[a:b]) if hot[a:b].any() else b"") for a, b in zip(edges[:-1], edges[1:])]


def _named_bits(cell: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    data, half = cell.as_buffer(), -(-n // 8)
    hot = np.unpackbits(np.frombuffer(data, np.uint8)[half:], count=n).astype(bool) if data.size > half else np.zeros(n, bool)
    return _unpacked(cell, n), hot


def _answer(answers: pa.Table, kind: int) -> list[tuple[int, pa.Scalar, int]]:
    rows = [(b.as_py(), p, s.as_py()) for k, b, p, s in zip(answers.column("kind"), answers.column("bucket"), answers.column("payload"), answers.column("size")) if k.as_py() == kind]
    return sorted(rows, key=lambda r: r[0])


def _by_id(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a block by growing id, null last, and the ids."""
    ids = np.asarray(table.column("id").fill_null(int(_LAST)).combine_chunks(), np.int64)
    by_id = np.argsort(ids, kind="stable")
    return table.take(pa.array(by_id)), ids[by_id]


class _Asked:
    """A block as far as the answers of the steps before allow it to be known.

    After ``take_chunks`` it holds runs of places whose strings are open and share their least gram. ``names`` are the
    different least grams; ``inside`` says which of them occur more than once in the block.
    """

    def __init__(self, table: pa.Table, width: int, bits: int):
        table, self.ids = _by_id(table)
        self.width, self.bits, self.gram = width, bits, min(GRAM, width)
        self.data, self.offsets = tokens.text_bytes(table.column("text"))
        self.least, head = _grams(self.data, self.gram, width)
        stops = np.maximum(self.offsets[:-1], self.offsets[1:] - width + 1)
        held = stops > self.offsets[:-1]
        self.firsts, stops, self.docs = self.offsets[:-1][held], stops[held], np.flatnonzero(held)
        # Strings begin from the first place of a text up to its stop.
        edges = np.column_stack([self.firsts, stops]).ravel()
        self.whole = np.repeat(np.arange(len(edges) + 1) % 2 == 1, np.diff(np.concatenate([[0], edges, [len(head)]])))
        head &= self.whole
        head[self.firsts] = True
        self.starts = np.flatnonzero(head)
        text = self._text_of(self.starts)
        self.stops = np.minimum(np.append(self.starts[1:], len(head)), stops[text])
        self.chunk_owner = self.ids[self.docs[text]]
        hashes = tokens.whole_hash(self.data, self.starts, self.stops + width - 1)
        self.unique, self.first, self.place = np.unique(hashes, return_index=True, return_inverse=True)

    def _text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, "right") - 1

    def chunk_owners(self) -> np.ndarray:
        """The least owner in the block of each different chunk."""
        return self.chunk_owner[self.first]

    def take_chunks(self, answers: pa.Table) -> None:
        """Chunks that a smaller owner has as well are removed; the rest stays open."""
        parts = [np.frombuffer(p.as_buffer(), np.int64) for _, p, _ in _answer(answers, 0)]
        later = self.chunk_owner > (np.concatenate(parts) if parts else np.zeros(0, np.int64))[self.place]
        n, least = len(self.data), self.least
        # Chunks lie one after the other, so marks at their borders tell what is inside.
        change = np.zeros(n + 1, np.int8)
        change[self.starts[later]] += 1
        change[self.stops[later]] -= 1
        self.removed = np.cumsum(change[:-1], dtype=np.int8) > 0
        is_open = self.whole & ~self.removed
        head = np.append(True, (least[1:] != least[:-1]) | (is_open[1:] != is_open[:-1]))[:n]
        head[self.firsts] = True
        starts = np.flatnonzero(head)
        held = is_open[starts]
        self.run_start, self.run_size = starts[held], np.diff(np.append(starts, n))[held]
        self.run_owner = self.ids[self.docs[self._text_of(self.run_start)]]
        self.names, self.name_of_run, runs = np.unique(
            tokens.mix(least[self.run_start]), return_inverse=True, return_counts=True  # mixed, as the least of many are small numbers
        )
        self.inside = runs > 1
        # So many places at most have one gram in common.
        self.inside[self.name_of_run[self.run_size > self.width - self.gram + 1]] = True

    def name_chars(self) -> np.ndarray:
        """For each different least gram the bytes of its strings, runs of them written once; runs that seem equal count once."""
        first = np.ones(len(self.run_start), bool)
        runs = np.flatnonzero(self.inside[self.name_of_run])
        # Runs that begin with the same string and go on as long, as those in copies of a text do.
        like = tokens.mix(_hash(_words(self.data), self.run_start[runs], self.width) + self.run_size[runs].astype(np.uint64))
        first[runs] = False
        first[runs[np.unique(like, return_index=True)[1]]] = True
        return np.bincount(self.name_of_run, (self.run_size + self.width) * first, len(self.names)).clip(max=2**31 - 1).astype(np.int64)

    def _places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, place) of each string of the runs."""
        counts = self.run_size[chosen]
        run = np.repeat(chosen, counts)
        return run, np.arange(len(run)) + np.repeat(self.run_start[chosen] - np.cumsum(counts) + counts, counts)

    def _merge_inside(self) -> None:
        """Intervals of the block's suffix array: of equal strings the first is asked for, and those of larger owners are removed."""
        self.copy = np.zeros(len(self.data), bool)
        self.same, self.same_as = np.zeros(0, np.int64), np.zeros(0, np.int64)
        run, at = self._places(np.flatnonzero(self.inside[self.name_of_run]))
        # Hashes keep back most strings that are in the block once; those that are left are compared in full.
        hashes = _hash(_words(self.data), at, self.width)
        by = np.argsort(hashes)
        same = np.append(False, hashes[by[1:]] == hashes[by[:-1]])
        held = np.sort(by[same | np.append(same[1:], False)]) if len(at) else by
        starts, owners = at[held], self.run_owner[run[held]]
        first, counts = _segments(starts, np.ones(len(starts), np.int64), np.append(True, owners[1:] != owners[:-1])[: len(owners)])
        if not len(first):
            return
        starts, owners, lengths = starts[first], owners[first], counts + self.width - 1
        text, lengths = _ended_text(self.data, starts, lengths), lengths + 1
        order, head = shard_order(text, lengths, self.width)
        # Strings that reach their terminator have less than ``width`` bytes.
        ends, segment = np.cumsum(lengths), np.repeat(np.arange(len(lengths)), lengths)
        whole = np.zeros(len(text), bool)
        whole[: len(text) - self.width] = segment[self.width :] == segment[: -self.width]
        shared = np.append(~(head[:-1] & head[1:]), ~head[-1]) & whole[order]
        order, head = order[shared], head[shared]
        segment = segment[order]
        owner, place = owners[segment], order - (ends - lengths)[segment] + starts[segment]
        # Places grow with their owner, so the first of equal strings is one of the least owner.
        least = _least(place, head)
        later = owner > _least(owner, head)
        self.copy[place[place != least]] = True
        self.removed[place[later]] = True
        same = ~later & (place != least)
        self.same, self.same_as = place[same], least[same]

    def take_names(self, answers: pa.Table) -> None:
        """Strings whose least gram is in no other block are done; of the others those that are no copy inside are sent.

        Strings go to the bucket of their least gram, those of a hot gram to that of their own hash: equal ones still meet.
        """
        self._merge_inside()
        parts = [_named_bits(p, n) for _, p, n in _answer(answers, 1)]
        several, hot = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, bool), np.zeros(0, bool))
        run, at = self._places(np.flatnonzero(several[self.name_of_run]))
        held = ~self.copy[at]
        run, at = run[held], at[held]
        least = self.names[self.name_of_run[run]]
        by_itself = np.flatnonzero(hot[self.name_of_run[run]])
        if len(by_itself):
            least[by_itself] = tokens.mix(_hash(_words(self.data), at[by_itself], self.width))
        buckets = (least >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(at), np.int64)
        # Runs of places of one bucket are a segment; it ends with the string that begins at its last place.
        owners = self.run_owner[run]
        apart = np.append(True, (buckets[1:] != buckets[:-1]) | (owners[1:] != owners[:-1]))[: len(at)]
        first, counts = _segments(at, np.ones(len(at), np.int64), apart)
        by = np.argsort(buckets[first], kind="stable")
        first, self.seg_count = first[by], counts[by]
        self.seg_start, self.seg_bucket, self.seg_owner = at[first], buckets[first], owners[first]

    def segments(self) -> list[tuple[int, bytes, bytes, bytes]]:
        """(bucket, text with terminators, lengths, owners) of each bucket."""
        out = []
        filled = np.unique(self.seg_bucket)
        lows = np.searchsorted(self.seg_bucket, filled)
        for bucket, a, b in zip(filled.tolist(), lows.tolist(), [*lows[1:].tolist(), len(self.seg_bucket)]):
            starts = self.seg_start[a:b]
            lengths = self.seg_count[a:b] + self.width - 1
            text = _ended_text(self.data, starts, lengths)
            out.append((bucket, text.tobytes(), (lengths + 1).astype(np.int32).tobytes(), self.seg_owner[a:b].tobytes()))
        return out

    def state(self) -> tuple[bytes, bytes, bytes]:
        """What ``_covered`` needs besides the answers about segments, so that nothing is worked out again.

        Bits of the places that are removed whatever the answers are; first places and counts of the segments in the order
        of buckets; pairs of a place and the one that is asked for in its stead.
        """
        pairs = np.concatenate([self.same, self.same_as])
        return _bits(self.removed), np.concatenate([self.seg_start, self.seg_count]).astype(np.int32).tobytes(), pairs.astype(np.int32).tobytes()


def _covered(n: int, state: tuple[bytes, bytes, bytes], flags: np.ndarray, width: int) -> np.ndarray:
    """Which of the n bytes of a block are removed; ``flags`` are the answers about its segments, one after the other."""
    removed = np.unpackbits(np.frombuffer(state[0], np.uint8), count=n).astype(bool)
    # An Arrow array of strings has less than 2^31 bytes, so places in a block fit 32 bits.
    starts, counts = np.frombuffer(state[1], np.int32).astype(np.int64).reshape(2, -1)
    place, first = np.frombuffer(state[2], np.int32).astype(np.int64).reshape(2, -1)
    if len(starts):
        # A segment has an answer for each of its symbols and one for its terminator; strings begin at the first ones.
        lengths = counts + width
        spread = np.repeat(np.arange(len(starts)), counts)
        within = np.arange(len(spread)) - (np.cumsum(counts) - counts)[spread]
        found = np.zeros(n, bool)
        found[(starts[spread] + within)[flags[(np.cumsum(lengths) - lengths)[spread] + within]]] = True
        removed |= found
        removed[place[found[first]]] = True
    return tokens.covered(np.flatnonzero(removed), width, n)


# --- The job. -------------------------------------------------------------------------------------------------------------

_ANSWER = "kind int, bucket bigint, block bigint, payload binary, size bigint"


def _answers(kind: int, rows: list[tuple[int, int, bytes, int]]) -> pa.Table:
    return pa.table(
        {
            "kind": pa.array([kind] * len(rows), pa.int32()),
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "block": pa.array([r[1] for r in rows], pa.int64()),
            "payload": pa.array([r[2] for r in rows], pa.binary()),
            "size": pa.array([r[3] for r in rows], pa.int64()),
        }
    )


def remove_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) of each row; ``kept`` are the bytes that stay.

    A byte is removed if a string of ``width`` bytes that covers it also begins in a text with a smaller id; strings are
    judged on the input and lie in one text. Ids are integers; null is larger than all ids and not smaller than itself,
    so is an id than its repetition: rows that share an id remove nothing from each other. Null texts are empty; texts
    shorter than ``width`` lose nothing. ``spans``: (first byte, bytes) of the maximal removed runs. Other columns are not
    read.

    Texts are dealt into blocks once. Three questions are asked, each by one exchange, and each leaves fewer strings open:

    1. Content-defined chunks, one hash each: a chunk that a smaller id has as well is removed as a whole.
    2. Of every open string the least gram: equal strings have the same, so strings whose gram is nowhere else are done.
       Strings whose gram occurs again inside the block are sorted there. Intervals of this suffix array with a common
       prefix of ``width`` are the equal strings; the least id of an interval decides, and only its first string is asked
       for outside.
    3. Strings whose gram other blocks have go to the bucket of that gram, so equal ones meet; where all strings under a
       gram take more than one in ``HOT_SHARE`` bytes of a bucket, each goes to the bucket of its own hash instead. There
       each block is a shard with its own Burrows-Wheeler transform, and the shards are merged by interleave refinement;
       again the least id of an interval with a common prefix of ``width`` decides.

    Hashes of chunks have 64 bits and decide; those of grams and strings only say where strings meet.
    A block asks for each different chunk, gram and string once, so what is everywhere comes once from each block. Buckets and
    blocks grow in number with the input, not in size, whatever the texts have in common; a string under a hot gram is
    sent by itself, so it takes more bytes than in a run of neighbours.
    """
    inner = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    chars = inner.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    bits = max(0, (max(1, chars // BUCKET_CHARS) - 1).bit_length())
    most = BUCKET_CHARS // HOT_SHARE
    dealt = inner.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition("block")
    by_block = dealt.groupBy("block")

    def send_chunks(texts: pa.Table) -> pa.Table:
        asked = _Asked(texts, width, bits)
        least, (filled, edges) = asked.chunk_owners(), _by_bucket(asked.unique, bits)
        return pa.table(
            {
                "bucket": pa.array(filled, pa.int64()),
                "block": pa.array([texts.column("block")[0].as_py()] * len(filled), pa.int64()),
                "keys": pa.array([asked.unique[a:b].tobytes() for a, b in edges], pa.binary()),
                "rest": pa.array([least[a:b].tobytes() for a, b in edges], pa.binary()),
            }
        )

    def answer_chunks(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(c.as_buffer(), np.uint64) for c in group.column("keys")]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        owners = np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for c in group.column("rest")])
        least = np.full(int(place.max()) + 1, _LAST)
        np.minimum.at(least, place, owners)
        edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        rows = zip(group.column("bucket").to_pylist(), group.column("block").to_pylist(), zip(edges[:-1], edges[1:]))
        return _answers(0, [(bucket, block, least[place[a:b]].tobytes(), b - a) for bucket, block, (a, b) in rows])

    def send_names(texts: pa.Table, answers: pa.Table) -> pa.Table:
        asked = _Asked(texts, width, bits)
        asked.take_chunks(answers)
        chars, (filled, edges) = asked.name_chars(), _by_bucket(asked.names, bits)
        return pa.table(
            {
                "bucket": pa.array(filled, pa.int64()),
                "block": pa.array([texts.column("block")[0].as_py()] * len(filled), pa.int64()),
                "keys": pa.array([asked.names[a:b].tobytes() for a, b in edges], pa.binary()),
                "chars": pa.array([chars[a:b].astype(np.int32).tobytes() for a, b in edges], pa.binary()),
            }
        )

    def answer_names(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(c.as_buffer(), np.uint64) for c in group.column("keys")]
        chars = [np.frombuffer(c.as_buffer(), np.int32) for c in group.column("chars")]
        payloads = _named(list(zip(keys, chars)), most)
        rows = zip(group.column("bucket").to_pylist(), group.column("block").to_pylist(), payloads, keys)
        return _answers(1, [(bucket, block, payload, len(k)) for bucket, block, payload, k in rows])

    def send_segments(texts: pa.Table, answers: pa.Table) -> pa.Table:
        asked = _Asked(texts, width, bits)
        asked.take_chunks(answers)
        asked.take_names(answers)
        # What the last step needs goes the same way as the segments, past the buckets.
        block = texts.column("block")[0].as_py()
        rows = [*asked.segments(), (-1 - block, *asked.state())]
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int64()),
                "block": pa.array([block] * len(rows), pa.int64()),
                "keys": pa.array([r[1] for r in rows], pa.binary()),
                "lengths": pa.array([r[2] for r in rows], pa.binary()),
                "rest": pa.array([r[3] for r in rows], pa.binary()),
            }
        )

    def answer_segments(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            state = [group.column(c)[0].as_py() for c in ("keys", "lengths", "rest")]
            return _answers(3, [(part, group.column("block")[0].as_py(), x, len(x)) for part, x in enumerate(state)])
        read = lambda name, kind: [np.frombuffer(c.as_buffer(), kind) for c in group.column(name)]
        shards = list(zip(read("keys", np.uint8), [n.astype(np.int64) for n in read("lengths", np.int32)], read("rest", np.int64)))
        flags = earlier(shards, width)
        rows = zip(group.column("bucket").to_pylist(), group.column("block").to_pylist(), flags)
        return _answers(2, [(bucket, block, _bits(f), len(f)) for bucket, block, f in rows])

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, _ = _by_id(texts)
        data, offsets = tokens.text_bytes(texts.column("text"))
        flags = [_unpacked(p, n) for _, p, n in _answer(answers, 2)]
        state = tuple(p.as_py() for _, p, _ in _answer(answers, 3))
        removed = _covered(len(data), state, np.concatenate(flags) if flags else np.zeros(0, bool), width)
        n = len(offsets) - 1
        gone = tokens.row_sums(removed, offsets)
        edge = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
        runs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        borders = offsets[1:-1]
        borders = np.unique(borders[(borders > 0) & (borders < len(removed))])
        borders = borders[removed[borders - 1] & removed[borders]] if len(borders) else borders
        starts, ends = np.sort(np.concatenate([runs[0], borders])), np.sort(np.concatenate([runs[1], borders]))
        span_first = np.searchsorted(starts, offsets)
        spans = pa.StructArray.from_arrays([pa.array(starts - np.repeat(offsets[:-1], np.diff(span_first))), pa.array(ends - starts)], ["first", "bytes"])
        kept_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) - gone)])
        kept = data[~removed]
        return pa.table(
            {
                "id": texts.column("id"),
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "n_spans": pa.array(np.diff(span_first), pa.int64()),
                "spans": pa.ListArray.from_arrays(pa.array(span_first, pa.int32()), spans),
                "kept": pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept_offsets.astype(np.int64)), pa.py_buffer(kept.tobytes())]).cast(pa.binary()),
            }
        )

    keyed = "bucket bigint, block bigint, keys binary"
    known = by_block.applyInArrow(send_chunks, keyed + ", rest binary").groupBy("bucket").applyInArrow(answer_chunks, _ANSWER)
    names = by_block.cogroup(known.groupBy("block")).applyInArrow(send_names, keyed + ", chars binary")
    known = known.union(names.groupBy("bucket").applyInArrow(answer_names, _ANSWER))
    segments = by_block.cogroup(known.groupBy("block")).applyInArrow(send_segments, keyed + ", lengths binary, rest binary")
    known = segments.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(answer_segments, _ANSWER)
    out = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<first: bigint, bytes: bigint>>, kept binary"
    return by_block.cogroup(known.groupBy("block")).applyInArrow(finish, T._parse_datatype_string(out))
