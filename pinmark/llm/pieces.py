"""SentencePiece encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 1234
DROPOUT = 0.1

#: The mark that stands for a space.
SPACE_MARK = "▁"

#: Texts are encoded together up to this many characters; runs with more symbols than ``LONG_RUN`` one at a time.
_CHARS = 1 << 17
_LONG_RUN = 256

_NONE = np.int64(np.iinfo(np.int64).max)
_WORD = (1 << 64) - 1
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class Vocabulary:
    """Pieces with their ids, and the merges that the scores imply; a few hundred thousand numbers at most."""

    texts: list[str]
    byte_of: np.ndarray
    first_byte: int
    chars: np.ndarray
    char_ids: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    rank: np.ndarray

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """From a BPE model with byte fallback whose pieces hold the space mark at their beginning only."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        byte_of = np.full(n, -1, np.int64)
        for i in range(n):
            if model.is_byte(i):
                byte_of[i] = int(texts[i][3:5], 16)
        ids = {texts[i]: i for i in plain}
        if any(SPACE_MARK in texts[i].lstrip(SPACE_MARK) for i in plain):
            raise ValueError("a piece holds a space mark after another character")
        rank = np.full(n, n, np.int64)
        rank[sorted(plain, key=lambda i: (-model.get_score(i), i))] = np.arange(len(plain))
        pairs = {}
        for text, i in ids.items():
            for cut in range(1, len(text)):
                left, right = ids.get(text[:cut]), ids.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        singles = sorted((ord(t), i) for t, i in ids.items() if len(t) == 1)
        keys, merged = _hash_table(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int64))
        chars, char_ids = (np.array(x, np.int64) for x in zip(*singles))
        return Vocabulary(texts, byte_of, int(np.flatnonzero(byte_of == 0)[0]), chars, char_ids, keys, merged, rank)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 if none."""
        wanted = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(wanted), -1, np.int64)
        slots = _slots(wanted, len(self.keys))
        open_ = np.flatnonzero(left < len(self.texts))
        open_ = open_[right[open_] < len(self.texts)]
        while len(open_):
            found = self.keys[slots[open_]]
            hit = found == wanted[open_]
            out[open_[hit]] = self.merged[slots[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(_WORD))]
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
        return out


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys * np.uint64(_FACTORS[0])) >> np.uint64(40)).astype(np.int64) & (size - 1)


def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing, at most a quarter full."""
    size = 1 << max(4, int(4 * len(keys) - 1).bit_length())
    table, held = np.full(size, np.uint64(_WORD)), np.zeros(size, np.int64)
    for key, slot, value in zip(keys.tolist(), _slots(keys, size).tolist(), values.tolist()):
        while table[slot] != _WORD:
            slot = (slot + 1) & (size - 1)
        table[slot], held[slot] = key, value
    return table, held


def skipped(keys: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the merge of the symbols at ``start:middle`` and ``middle:end`` is left out; a function of its arguments."""
    if dropout <= 0:
        return np.zeros(len(start), bool)
    drawn = keys
    for place, factor in zip((start, middle, end), _FACTORS):
        drawn = tokens.mix(drawn ^ (place.astype(np.uint64) * np.uint64(factor)))
    return (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def _long_run(vocabulary: Vocabulary, symbols: np.ndarray, start: np.ndarray, end: int, key: np.uint64, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """One run with an agenda of candidate merges, best score first and leftmost of equals."""
    ids, at = symbols.tolist(), start.tolist() + [end]
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    agenda: list[tuple[int, int, int, int, int, int]] = []
    stop = lambda i: at[after[i]]

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if not lefts:
            return
        rights = [after[i] for i in lefts]
        made = vocabulary.merge(np.array([ids[i] for i in lefts]), np.array([ids[j] for j in rights]))
        places = (np.array([at[i] for i in lefts]), np.array([at[j] for j in rights]), np.array([stop(j) for j in rights]))
        left_out = skipped(np.full(len(lefts), key, np.uint64), *places, dropout)
        for i, j, piece, out, e in zip(lefts, rights, made.tolist(), left_out.tolist(), places[2].tolist()):
            if piece >= 0 and not out:
                heapq.heappush(agenda, (int(vocabulary.rank[piece]), i, j, piece, at[j], e))

    offer(list(range(n - 1)))
    while agenda:
        _, i, j, piece, middle, e = heapq.heappop(agenda)
        # Stale if one of the two symbols has been merged meanwhile.
        if not (alive[i] and j < n and alive[j] and after[i] == j and at[j] == middle and stop(j) == e):
            continue
        ids[i], alive[j], after[i] = piece, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer([before[i], i])
    left = [i for i in range(n) if alive[i]]
    return np.array([ids[i] for i in left], np.int64), np.array([at[i] for i in left], np.int64)


def _merge_runs(vocabulary: Vocabulary, symbols, place, keys, runs, run_end, dropout, base) -> tuple[np.ndarray, np.ndarray]:
    """All runs side by side: in each round every run makes the best merge that it has left.

    ``place``: where a symbol begins, over all texts; ``base``: where the symbol's text begins; ``runs``: first symbol of
    each run; ``run_end``: where each run ends. A merge within a run never depends on another run, so the result is that
    of one agenda for the whole text.
    """
    done_symbols, done_places = [], []
    sizes = np.diff(np.append(runs, len(symbols)))
    # Looked up by place, so that rounds need not carry them along.
    keys_at, base_at = keys, base
    long = np.flatnonzero(sizes > _LONG_RUN)
    for r in long.tolist():
        a, b = runs[r], runs[r] + sizes[r]
        ids, at = _long_run(vocabulary, symbols[a:b], place[a:b] - base[a], int(run_end[r] - base[a]), keys[a], dropout)
        done_symbols.append(ids)
        done_places.append(at + base[a])
    if len(long):
        chosen = np.repeat(sizes <= _LONG_RUN, sizes)
        symbols, place = symbols[chosen], place[chosen]
        sizes, run_end = sizes[sizes <= _LONG_RUN], run_end[sizes <= _LONG_RUN]

    def candidates(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in one number, so that the least is the best and leftmost, and piece of the merges i and i + 1."""
        piece = vocabulary.merge(symbols[i].astype(np.int64), symbols[i + 1].astype(np.int64))
        out = np.full(len(i), _NONE)
        can = np.flatnonzero(piece >= 0)
        j = i[can]
        at = place[j]
        begin = base_at[at]
        dropped = skipped(keys_at[at], at - begin, place[j + 1] - begin, end[j + 1] - begin, dropout)
        can, at = can[~dropped], at[~dropped]
        out[can] = vocabulary.rank[piece[can]].astype(np.int64) << 32 | at
        return out, piece.astype(np.int32)

    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    symbols, place = symbols.astype(np.int32), place.astype(np.int32)
    end = np.append(place[1:], np.int32(0))
    best, made = np.full(len(symbols), _NONE), np.full(len(symbols), -1, np.int32)
    last = np.zeros(len(symbols), bool)
    if len(heads):
        tails = np.append(heads[1:], len(symbols)) - 1
        end[tails] = run_end
        last[tails] = True
        inner = np.flatnonzero(~last)
        best[inner], made[inner] = candidates(inner)
    while len(heads):
        least = np.minimum.reduceat(best, heads)
        going = least < _NONE
        sizes = np.diff(np.append(heads, len(symbols)))
        # Places stay in order, whatever has been merged.
        at = np.searchsorted(place, (least[going] & 0xFFFFFFFF).astype(np.int32))
        symbols[at] = made[at]
        end[at] = end[at + 1]
        last[at] = last[at + 1]
        if not going.all():
            ended = np.flatnonzero(np.repeat(~going, sizes))
            done_symbols.append(symbols[ended].astype(np.int64))
            done_places.append(place[ended].astype(np.int64))
            stays = np.repeat(going, sizes)
        else:
            stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        fresh = np.zeros(len(symbols), bool)
        fresh[at] = True
        fresh[(at - 1)[at > heads[going]]] = True
        kept = np.flatnonzero(stays)
        symbols, place, end, last, best, made = (x[kept] for x in (symbols, place, end, last, best, made))
        sizes = sizes[going] - 1
        heads = (np.cumsum(sizes) - sizes).astype(np.int64)
        fresh = np.flatnonzero(fresh[kept])
        best[fresh[last[fresh]]] = _NONE
        fresh = fresh[~last[fresh]]
        best[fresh], made[fresh] = candidates(fresh)
    return np.concatenate(done_symbols or [np.zeros(0, np.int64)]), np.concatenate(done_places or [np.zeros(0, np.int64)])


def encode(texts: list[str | None], keys: np.ndarray, vocabulary: Vocabulary, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of all texts one after the other, and where each text's begin; ``keys`` seeds each text's dropout."""
    texts = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    size = len(vocabulary.texts)
    # A mark that is in the text itself is spelled out in bytes, so that it is not read back as a space.
    mark = codes == ord(" ")
    wanted = np.where(mark, ord(SPACE_MARK), np.where(codes == ord(SPACE_MARK), -1, codes))
    found = np.minimum(np.searchsorted(vocabulary.chars, wanted), len(vocabulary.chars) - 1)
    known = vocabulary.chars[found] == wanted
    symbols = np.where(known, vocabulary.char_ids[found], size)
    heads = np.zeros(n, bool)
    heads[offsets[:-1][np.diff(offsets) > 0]] = True
    heads[1:] |= (mark[1:] & ~mark[:-1]) | ~known[1:] | ~known[:-1]
    runs = np.flatnonzero(heads)
    lengths = np.diff(offsets)
    base = np.repeat(offsets[:-1], lengths)
    ids, places = _merge_runs(vocabulary, symbols, np.arange(n), np.repeat(keys, lengths), runs, np.append(runs[1:], n), dropout, base)
    out = np.full(n, -1, np.int64)
    out[places] = ids
    at = np.flatnonzero(out >= 0)
    pieces = out[at]
    strange = np.flatnonzero(pieces == size)
    counts = np.ones(len(at), np.int64)
    spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[at[strange]].tolist()]
    if len(strange):
        counts[strange] = [len(b) for b in spelled]
    ends = np.cumsum(counts)
    result = np.repeat(pieces, counts)
    if len(strange):
        where = np.repeat(ends[strange] - counts[strange], counts[strange]) + np.concatenate([np.arange(c) for c in counts[strange]])
        result[where] = vocabulary.first_byte + np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
    first = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
    return result.astype(np.int32), first


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of one row of pieces: bytes are put together, the mark at the beginning goes, other marks are spaces."""
    out = bytearray()
    for i in ids.tolist():
        byte = int(vocabulary.byte_of[i])
        out += bytes([byte]) if byte >= 0 else vocabulary.texts[i].replace(SPACE_MARK, " ").encode()
    return out.decode("utf-8", "surrogatepass")[1:]


def decode_all(ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """``decode`` for many rows at once."""
    spelled = [bytes([b]) if b >= 0 else t.replace(SPACE_MARK, " ").encode() for t, b in zip(vocabulary.texts, vocabulary.byte_of.tolist())]
    data = np.frombuffer(b"".join(spelled), np.uint8)
    stops = np.cumsum([len(s) for s in spelled])
    starts = stops - [len(s) for s in spelled]
    begin, end = starts[ids], stops[ids]
    heads = first[:-1][np.diff(first) > 0]
    begin = begin.copy()
    begin[heads] += 1  # the space that was put before the text; its piece begins with the mark
    out, lengths = tokens.cut(data, begin, end)
    return tokens.to_strings(out, np.concatenate([[0], np.cumsum(tokens.row_sums(lengths, first))]))


def _batches(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > _CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    model: str = MODEL,
    dropout: float = DROPOUT,
    seed: int = SEED,
) -> DataFrame:
    """(id, pieces array<int>, lossless): the whole text of each row in pieces, and whether decoding gives it back.

    Merges are made in the order of an agenda, best score first. A candidate merge is skipped with probability
    ``dropout`` by a hash of the seed, the row's id and the places of its two symbols, so a run gives the same pieces on
    any number of machines, another seed gives other ones, and 0 gives the model's own. Null and empty texts have no
    pieces; rows with equal ids and texts have equal pieces; a null id is a key like any other. Nothing is exchanged.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary.value
        for batch in batches:
            text = batch.column(1).fill_null("")
            for a, b in _batches(np.asarray(pa.compute.utf8_length(text))):
                part = text.slice(a, b - a)
                keys = np.asarray(batch.column(2))[a:b].view(np.uint64)
                ids, first = encode(part.to_pylist(), keys, held, dropout)
                pieces = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                same = pa.compute.equal(decode_all(ids, first, held), part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pieces, same], ["id", "pieces", "lossless"])

    narrow = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.xxhash64(F.lit(seed).cast("bigint"), F.col(id_column)).alias("key")
    )
    schema = T.StructType([narrow.schema["id"], T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    return narrow.mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(id, text) of (id, pieces): an array without pieces, and null, give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0), np.int64)
            ids = np.asarray(lists.flatten(), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), decode_all(ids, np.concatenate([[0], np.cumsum(sizes)]), vocabulary.value)], ["id", "text"])

    narrow = encoded.select("id", "pieces")
    return narrow.mapInArrow(work, T.StructType([narrow.schema["id"], T.StructField("text", T.StringType())]))
