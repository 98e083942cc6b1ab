"""Toxicity: cumulative-link ordinal regression on sparse text features."""

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

#: Labelled rows that the model is fitted on at most, for each of toxic and not toxic, by the smallest hash of the id.
FIT_ROWS = 10_000

#: Features at most: the words whose odds in toxic rows are farthest above those in other rows, in units of their error.
WORDS = 2048

#: The odds of a feature are that many errors, and that much on the log scale, above those in other rows.
LEAST_ERRORS = 3.5
LEAST_ODDS = 1.5

#: Grades: 0 not toxic, 1 toxic, 2 toxic with more different marker words than the median of toxic rows.
GRADES = 3

#: Weight of the absolute values of all weights against the mean loss.
SPARSITY = 2e-5

#: The share of labelled rows that are not toxic which may be flagged.
LOSS = 0.002

#: Bins of severities, from 0 to ``GRADES`` - 1, that the limit is chosen from.
_BINS = 1 << 17


def _row_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words of each row as hashes, how often each occurs, and where each row's begin."""
    data, offsets = tokens.text_bytes(column)
    data = tokens.fold(data)
    found = tokens.split(data, offsets, tokens.MARKS)
    hashes, rows = tokens.slices_hash(data, found.starts, found.ends), found.rows
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    head = np.ones(len(hashes), bool)
    head[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(head)
    counts = np.diff(np.append(at, len(hashes)))
    return hashes[at], counts, np.searchsorted(rows[at], np.arange(len(offsets)))


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(threshold k - weights x features): all thresholds share the weights.

    A feature is the log of one more than the word's count. ``words`` is sorted; words that are not in it have weight 0.
    """

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    limit: float

    def expected(self, strain: np.ndarray) -> np.ndarray:
        """The mean grade: the sum over k of P(grade > k)."""
        return (1 - _sigmoid(self.thresholds[None, :] - strain[:, None])).sum(axis=1)

    def strain(self, column: pa.Array) -> np.ndarray:
        data, offsets = tokens.text_bytes(column)
        data = tokens.fold(data)
        found = tokens.split(data, offsets, tokens.MARKS)
        hashes = tokens.slices_hash(data, found.starts, found.ends)
        if not len(self.words) or not len(hashes):
            return np.zeros(len(offsets) - 1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == hashes)
        keys, counts = np.unique(found.rows[hit] * len(self.words) + at[hit], return_counts=True)
        return np.bincount(keys // len(self.words), weights=self.weights[keys % len(self.words)] * np.log1p(counts), minlength=len(offsets) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows, words, values, grades, width: int, sparsity: float = SPARSITY, steps: int = 1500, mass: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by proximal gradient steps with momentum on the mean negative log likelihood.

    The sparse features are given as (row, word, value) triples; a row counts ``mass`` times, 1 or more. Weights are not negative: a word may speak for severity,
    but none excuses another, so that a long text does not dilute it. The step that makes weights smaller sets many to 0.
    """
    n, top = len(grades), int(GRADES) - 1
    mass = np.ones(n) if mass is None else np.asarray(mass, float)
    total = mass.sum()
    weights, gap = np.zeros(width), np.zeros(top)
    share = np.clip([mass[grades <= k].sum() / total for k in range(top)], 0.02, 0.98)
    cuts = np.log(share / (1 - share))
    gap[0], gap[1:] = cuts[0], np.log(np.maximum(np.diff(cuts), 0.1))
    ahead, ahead_gap, momentum = weights.copy(), gap.copy(), 1.0
    energy = np.bincount(rows, weights=values**2, minlength=n)
    by_energy = np.argsort(energy)
    rate = 4.0 / max(1e-9, np.interp(0.9 * (total - 1), np.cumsum(mass[by_energy]) - 1, energy[by_energy])) if n else 1.0
    for _ in range(steps):
        theta = np.concatenate([[ahead_gap[0]], ahead_gap[0] + np.cumsum(np.exp(ahead_gap[1:]))])
        strain = np.bincount(rows, weights=values * ahead[words], minlength=n)
        up = _sigmoid(np.append(theta, 50.0)[grades] - strain)
        down = np.where(grades > 0, _sigmoid(np.append(theta, 50.0)[np.maximum(grades - 1, 0)] - strain), 0.0)
        likely = np.maximum(up - down, 1e-9)
        d_up, d_down = np.where(grades < top, up * (1 - up), 0) / likely, np.where(grades > 0, down * (1 - down), 0) / likely
        d_up, d_down = d_up * mass / total, d_down * mass / total
        slope = d_up - d_down  # by the strain
        d_theta = np.array([d_down[grades == k + 1].sum() - d_up[grades == k].sum() for k in range(top)])
        d_gap = np.concatenate([[d_theta.sum()], [d_theta[k:].sum() * np.exp(ahead_gap[k]) for k in range(1, top)]])
        moved = ahead - rate * np.bincount(words, weights=values * slope[rows], minlength=width)
        fresh = np.maximum(moved - rate * sparsity, 0)
        fresh_gap = ahead_gap - 0.5 * d_gap
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / following
        ahead, ahead_gap = fresh + push * (fresh - weights), fresh_gap + push * (fresh_gap - gap)
        weights, gap, momentum = fresh, fresh_gap, following
    return weights, np.concatenate([[gap[0]], gap[0] + np.cumsum(np.exp(gap[1:]))])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", toxic: str = "toxic") -> Ordinal:
    """A model from at most ``FIT_ROWS`` labelled rows of either kind; rows with a null label or id are not used.

    The labels know two kinds only. Toxic rows are graded by how many different marker words they hold, markers being
    the features. The sampled rows of a kind count for all labelled rows of it, so the mix does not depend on the size of
    the table, and the limit is chosen over all labelled rows. Where ids repeat, ``FIT_ROWS`` bounds the rows all the same,
    by the hash of the text. Labels meet ids and severities, not texts, but for the sample's. What comes to the driver is bounded: ``WORDS`` words, for each sampled row its counts of them, and counts by
    bin of severity. Without toxic rows, or without others, every row gets severity 0.
    """
    marked = labels.where(F.col(toxic).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg((F.max(toxic) > 0).alias("toxic"))
    ordered = F.xxhash64(F.col(id_column)), F.col(id_column)
    chosen = marked.where("toxic").orderBy(*ordered).limit(FIT_ROWS).union(marked.where("not toxic").orderBy(*ordered).limit(FIT_ROWS))
    chosen = chosen.withColumnRenamed(id_column, "__id")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    # At most 2 * FIT_ROWS ids, so the hint is bounded; texts stay where they are.
    sample = stored(texts.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("toxic", "text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                words, _, first = _row_words(part.column(1))
                kind = np.repeat(np.asarray(part.column(0)), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(kind)], ["word", "toxic"])

    every = marked.withColumnRenamed(id_column, "__id")
    totals = {r.toxic: r.n for r in texts.select("id").join(every, F.col("id") == F.col("__id")).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if max(sizes.values(), default=0) > FIT_ROWS:  # ids that repeat
        first = [sample.where(kind).orderBy(F.xxhash64("text"), "text").limit(FIT_ROWS) for kind in ("toxic", "not toxic")]
        sample, sizes = stored(first[0].union(first[1])), {kind: min(n, FIT_ROWS) for kind, n in sizes.items()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    nothing = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 40.0), 1.0)
    if not n_toxic or not n_clean:
        return nothing
    counted = sample.mapInArrow(split, "word bigint, toxic boolean").groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    odds = F.expr(f"ln((t + 0.5) / ({n_toxic} - t + 0.5)) - ln((c + 0.5) / ({n_clean} - c + 0.5))")
    scored = counted.select("word", "t", odds.alias("odds"), F.expr("sqrt(1 / (t + 0.5) + 1 / (c + 0.5))").alias("error"))
    above = scored.where(f"odds >= {LEAST_ODDS} and odds >= {LEAST_ERRORS} * error")
    best = above.orderBy((F.col("odds") / F.col("error")).desc(), "word").limit(WORDS).collect()
    if not best:
        return nothing
    best.sort(key=lambda r: r.word % 2**64)
    words = np.array([r.word for r in best], np.int64).view(np.uint64)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, counts, first = _row_words(part.column(1))
                at = np.minimum(np.searchsorted(words, found), len(words) - 1)
                hit = words[at] == found
                edges = np.concatenate([[0], np.cumsum(hit)])[first]
                at, counts = at[hit].astype(np.int32), counts[hit].astype(np.int32)
                pairs = zip(edges[:-1].tolist(), edges[1:].tolist())
                cells = [(at[a:b].tobytes(), counts[a:b].tobytes()) for a, b in pairs]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())],
                    ["toxic", "words", "counts"],
                )

    held = sample.mapInArrow(featured, "toxic boolean, words binary, counts binary").collect()
    at = [np.frombuffer(bytes(r.words), np.int32).astype(np.int64) for r in held]
    counts = [np.frombuffer(bytes(r.counts), np.int32).astype(float) for r in held]
    is_toxic = np.array([r.toxic for r in held])
    markers = np.array([len(a) for a in at])
    grades = np.where(is_toxic, 1 + (markers > np.median(markers[is_toxic])), 0).astype(np.int64)
    rows = np.repeat(np.arange(len(held)), [len(a) for a in at])
    weights, thresholds = fit_ordinal(rows, np.concatenate(at), np.log1p(np.concatenate(counts)), grades, len(words), mass=np.where(is_toxic, totals[True] / n_toxic, totals[False] / n_clean))
    kept = weights != 0
    model = Ordinal(words[kept], weights[kept], thresholds, 1.0)

    severe = graded(docs, model, id_column, text_column).select("id", "severity")
    bins = severe.join(every, F.col("id") == F.col("__id")).groupBy(F.floor(F.col("severity") * (_BINS / (GRADES - 1))).alias("bin"))
    found = bins.agg(F.min("severity").alias("least"), F.max("severity").alias("most"), F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("toxic")).collect()
    model.limit = _limit(*(np.array(c) for c in zip(*((r.least, r.most, r.clean, r.toxic) for r in found))))
    return model


def _limit(least: np.ndarray, most: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The severity that flags at most ``LOSS`` of the clean rows and most toxic ones; the middle of a gap if there is one.

    Of each bin the least and greatest severity and the number of clean and toxic rows are given; a cut lies between bins.
    """
    order = np.argsort(-least, kind="stable")
    lost, caught = np.cumsum(clean[order]), np.cumsum(toxic[order])
    good = np.flatnonzero(lost <= LOSS * max(1, clean.sum()))
    if not len(good) or not caught[good].max():
        return float(most.max()) + 1e-9
    # Of the cuts that catch almost all that can be caught the one that flags fewest clean rows.
    enough = good[caught[good] >= 0.98 * caught[good].max()]
    best = enough[np.lexsort((-caught[enough], lost[enough]))[0]]
    under = most[order][best + 1] if best + 1 < len(order) else 0.0
    return float(least[order][best] + under) / 2


def graded(docs: DataFrame, model: Ordinal, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, severity, grade, toxic): expected grade from 0 to 2, the nearest grade, and whether the row is flagged.

    Every row gives a row, on its whole text. Null and wordless texts have no features and so the severity that the
    thresholds alone give; they are never flagged.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                strain = model.strain(part.column(1))
                severity = np.round(model.expected(strain), 9)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(severity), pa.array(np.rint(severity).astype(np.int64)), pa.array((severity > model.limit) & (strain > 0))],
                    ["id", "severity", "grade", "toxic"],
                )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    added = T._parse_datatype_string("severity double, grade bigint, toxic boolean").fields
    return narrow.mapInArrow(work, T.StructType([narrow.schema["id"], *added]))
