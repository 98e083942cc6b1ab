"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .storage import stored

#: ``[#*$%&|<>]``
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_MARK = tokens.MARKS & ~tokens.SPACES & ~_LETTER
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True

#: Rows that the forest is grown from at most, taken from the labelled ones by the smallest hash of their id.
FIT_ROWS = 20_000

TREES = 200
TREE_ROWS = 256

#: The share of labelled good rows that the threshold may reject.
LOSS = 0.002

_BINS = 4096

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("chars_a_word", "symbols_a_word", "dup_lines_a_line", "repeats_a_word", "upper_a_letter", "marks_a_word", "digits_a_char")


def _equal_in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return hashes ^ tokens.mix(rows.astype(np.uint64) + np.uint64(1))


def statistics(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text the counts of ``COUNTS`` and the rates of ``RATES``; null is empty, a rate of nothing is 0."""
    data, offsets = tokens.text_bytes(column)
    n = len(offsets) - 1
    words = tokens.split(data, offsets)

    def of_bytes(flags: np.ndarray) -> np.ndarray:
        return tokens.row_sums(flags, offsets)

    solid = ~tokens.SPACES[data]
    chars = of_bytes(solid & ((data & 0xC0) != 0x80))
    symbols = of_bytes(_SYMBOLS[data])

    lines = tokens.split(data, offsets, _NEWLINE)
    before = np.concatenate([[0], np.cumsum(solid)])
    worded = before[lines.ends] > before[lines.starts]
    owner = lines.rows[worded]
    keys = _equal_in_row(tokens.slices_hash(data, lines.starts[worded], lines.ends[worded]), owner)
    _, firsts = np.unique(keys, return_index=True)
    n_lines = np.bincount(owner, minlength=n)
    dup_lines = n_lines - np.bincount(owner[firsts], minlength=n)

    hashes, at = tokens.windows_hash(tokens.slices_hash(data, words.starts, words.ends), words.first, 3)
    _, place, counts = np.unique(_equal_in_row(hashes, words.rows[at]), return_inverse=True, return_counts=True)
    repeats = tokens.row_sums(tokens.covered(at[counts[place] > 1] if len(at) else at, 3, len(words.starts)), words.first)

    def rate(a, b):
        return np.divide(a, b, out=np.zeros(n), where=b > 0)

    letters = of_bytes(_LETTER[data])
    found = np.column_stack([words.counts, chars, symbols, dup_lines, repeats]).astype(np.int64).reshape(n, len(COUNTS))
    rates = np.column_stack(
        [
            rate(chars, words.counts),
            rate(symbols, words.counts),
            rate(dup_lines, n_lines),
            rate(repeats, words.counts),
            rate(of_bytes(_UPPER[data]), letters),
            rate(of_bytes(_MARK[data]), words.counts),
            rate(of_bytes(_DIGIT[data]), chars),
        ]
    ).reshape(n, len(RATES))
    return found, rates


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeats = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
    return (words < 50) | (100 * repeats > 50 * words)


def _usual_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Random trees as arrays by tree and node; node i has the children 2i + 1 and 2i + 2, feature -1 marks a leaf.

    Rates are seen as x / (x + scale), scale being the 99.5 % quantile of the good rows: good rows lie below a half or
    near it, and what good rows never have is near 1. Splits are drawn uniformly from the node's box, not from the range
    of its rows, so a rate that is constant in good rows still sets others apart.
    """

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    scale: np.ndarray
    usual: float
    threshold: float = 1.1

    @staticmethod
    def grow(rates: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rates))
        scale = np.maximum(np.quantile(rates, 0.995, axis=0), 1e-3) if size else np.ones(len(RATES))
        rows = rates / (rates + scale)
        depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        nodes = (2 << depth) - 1
        feature = np.full((trees, nodes), -1, np.int64)
        split, path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for tree in range(trees):
            part = rows[rng.choice(len(rows), size, replace=False)] if size else rows
            open_nodes = [(0, 0, part, np.zeros(rows.shape[1]), np.ones(rows.shape[1]))]
            while open_nodes:
                node, level, part, low, high = open_nodes.pop()
                if level == depth or len(part) < 2:
                    path[tree, node] = level + _usual_path(len(part))
                    continue
                chosen = rng.integers(rows.shape[1])
                at = rng.uniform(low[chosen], high[chosen])
                feature[tree, node], split[tree, node] = chosen, at
                left = part[:, chosen] < at
                under, over = high.copy(), low.copy()
                under[chosen] = over[chosen] = at
                open_nodes += [(2 * node + 1, level + 1, part[left], low, under), (2 * node + 2, level + 1, part[~left], over, high)]
        return Forest(feature, split, path, scale, float(_usual_path(size)) or 1.0)

    def scores(self, rates: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few random splits set apart."""
        rows = rates / (rates + self.scale)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(rows), np.int64)
            while True:
                asked = feature[node]
                inner = asked >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(asked, 0)] >= split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def _by_part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Few texts at a time, so that very long ones do not add up."""
    return (batch.slice(start, 512) for start in range(0, batch.num_rows, 512))


def _listed(rates: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rates) + 1) * len(RATES), pa.int32()), pa.array(rates.ravel()))


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, the counts of ``COUNTS``, rates) of each row's whole text, a narrow table; null is empty."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_part(batch):
                counts, rates = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in counts.T), _listed(rates)], ["id", *COUNTS, "rates"])

    fields = [texts.schema["id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("rates", T.ArrayType(T.DoubleType()))]
    return texts.mapInArrow(measure, T.StructType(fields))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", good: str = "quality") -> Forest:
    """``fit_measures`` of all rows of ``docs``."""
    return fit_measures(stored(measures(docs, id_column, text_column)), labels, id_column, good)


def fit_measures(measured: DataFrame, labels: DataFrame, id_column: str = "doc_id", good: str = "quality") -> Forest:
    """A forest grown from good rows, and the score from which on a row counts as an anomaly.

    The trees are grown from at most ``FIT_ROWS`` labelled good rows (``good`` = 1) that pass the base rules. The
    threshold is chosen over all labelled rows that pass them: of the scores that reject at most ``LOSS`` of the good
    ones, the one that rejects the most bad ones. Without good rows nothing is rejected; rows without a label, id or match
    are not used. Labels meet the narrow measures, so texts are not exchanged however many labels there are. Only counts
    by score and the bounded sample come to the driver.
    """
    marked = labels.where(F.col(good).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(good).alias("__good"))
    marked = marked.withColumnRenamed(id_column, "__id")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    measured = measured.where(~failed).join(marked, F.col("id") == F.col("__id"))
    measured = stored(measured.select(F.col("__good").cast("boolean").alias("good"), "rates", F.col("id").cast("string").alias("id")))
    sample = measured.where("good").orderBy(F.xxhash64("id"), "id", "rates").limit(FIT_ROWS).select("rates").collect()
    if not sample:
        return Forest.grow(np.zeros((0, len(RATES))))
    forest = Forest.grow(np.array([r.rates for r in sample]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = forest.scores(np.array(batch.column(1).to_pylist()).reshape(-1, len(RATES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((scores * _BINS).astype(np.int64))], ["good", "bin"])

    bins = measured.select("good", "rates").mapInArrow(binned, "good boolean, bin bigint").groupBy("bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    table = np.zeros((_BINS + 1, 2), np.int64)
    for row in bins.collect():
        table[row.bin] = row.good, row.bad
    lost, caught = np.cumsum(table[::-1, 0])[::-1], np.cumsum(table[::-1, 1])[::-1]
    allowed = np.flatnonzero(lost <= LOSS * max(1, lost[0]))
    if caught[allowed].max():
        # Of equal catches the middle of the gap between the last good and the first bad row.
        equal = allowed[caught[allowed] == caught[allowed].max()]
        forest.threshold = float(equal[0] + equal[-1] + 1) / 2 / _BINS
    return forest


def judged(docs: DataFrame, forest: Forest, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and the counts, base_failed, score and kept; columns of these names give way.

    Every row gives a row, on its whole text; null and empty texts have no words and fail the base rules.
    """
    added = (*COUNTS, "base_failed", "score", "kept")
    names = [c for c in docs.columns if c not in added]
    inner = docs.select(*(docs[c] for c in names)).toDF(*(f"c{i}" for i in range(len(names))))
    text, columns_in = names.index(text_column), inner.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_part(batch):
                counts, rates = statistics(part.column(text))
                failed, scores = base_failed(counts), forest.scores(rates)
                columns = [*part.columns, *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(scores)]
                columns.append(pa.array(~failed & (scores < forest.threshold)))
                yield pa.RecordBatch.from_arrays(columns, [*columns_in, *added])

    schema = T.StructType([*inner.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return inner.mapInArrow(work, schema).toDF(*names, *added)


def judged_measures(measured: DataFrame, forest: Forest) -> DataFrame:
    """(id, the counts, base_failed, score, kept) of each row of ``measures``: the verdict of ``judged`` without the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([np.asarray(batch.column(1 + i), np.int64) for i in range(len(COUNTS))])
            rates = np.asarray(batch.column(1 + len(COUNTS)).flatten()).reshape(-1, len(RATES))
            failed, scores = base_failed(counts), forest.scores(rates)
            added = [pa.array(failed), pa.array(scores), pa.array(~failed & (scores < forest.threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(COUNTS)], *added], ["id", *COUNTS, "base_failed", "score", "kept"])

    fields = [measured.schema["id"], *(T.StructField(c, T.LongType()) for c in COUNTS)]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return measured.select("id", *COUNTS, "rates").mapInArrow(work, T.StructType(fields))
