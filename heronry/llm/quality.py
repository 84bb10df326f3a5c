"""Quality rules: an isolation forest over rule statistics of each document.

The statistics are what simple rules look at (lengths, shares of kinds of characters, repeated words). Trees split random
statistics at random values of the range that all fitted rows span, and hold rows labelled good; where those are rare or absent
a path ends early. The anomaly score is 2 ** -(mean path length / expected length); the most that is kept is calibrated on
all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import frugal, written

#: Labelled documents, by order of a hash of their id, from which trees are grown; trees, rows of a tree, and seed.
FIT_DOCUMENTS, TREES, ROWS, SEED = 4000, 100, 256, 7
NAMES = ("words", "word_length", "line_length", "symbols", "bars", "digits", "capitals", "marks", "ends", "repeats")
_b = np.arange(256)
_KINDS = np.stack([np.isin(_b, list(b"#$%&*@^~<>{}=_\\")), _b == ord("|"), (_b >= 48) & (_b < 58), (_b >= 65) & (_b < 91), np.isin(_b, list(b".,;:'\"!?-()")), np.isin(_b, list(b".!?")), _b == 10])


def statistics(column: pa.Array) -> np.ndarray:
    """One row of the statistics NAMES for each text. A null or empty text has none of anything."""
    data, offs = flat.buffers(column)
    out = np.zeros((len(offs) - 1, len(NAMES)))
    for row, end, part, at in flat.slices(data, offs):
        starts, ends, bounds = flat.spans(part, at, flat.DARK)
        words = np.diff(bounds)
        some = np.maximum(words, 1)
        size = np.maximum(np.diff(at), 1)
        sums = [np.diff(np.concatenate([[0], np.cumsum(k[part])])[at]) for k in _KINDS]
        h = flat.hashes(part, starts, ends)
        same = np.zeros(len(h), np.int64)
        same[1:] = h[1:] == h[:-1]
        first = bounds[:-1][bounds[:-1] < len(h)]
        same[first] = 0
        spent = np.concatenate([[0], np.cumsum(ends - starts)])
        repeated = np.diff(np.concatenate([[0], np.cumsum(same)])[bounds])
        lengths = np.diff(spent[bounds]) / some
        out[row:end] = np.stack([np.log1p(words), lengths, np.log1p(size / (sums[6] + 1)), sums[0] / size, sums[1] / size, sums[2] / size, sums[3] / size, sums[4] / size, sums[5] / some, repeated / some], 1)
    return out


class Forest:
    """Trees as flat arrays: the statistic and value of each split, its two children, and of a leaf its path length."""

    def __init__(self, good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = SEED):
        random = np.random.default_rng(seed)
        rows = min(rows, len(good))
        self.depth = max(1, int(np.ceil(np.log2(max(2, rows)))) + 2)
        self.expected = _path(rows)
        self.what, self.value, self.left, self.length, self.roots = [], [], [], [], []
        for _ in range(trees):
            self.roots.append(len(self.what))
            self._grow(good[random.choice(len(good), rows, replace=False)], low, high, random)
        self.what, self.left = np.array(self.what, np.int32), np.array(self.left, np.int32)
        self.value, self.length = np.array(self.value), np.array(self.length)

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, random: np.random.Generator) -> None:
        waiting = [(self._leaf(), rows, low, high, 0)]
        while waiting:
            at, own, lo, hi, depth = waiting.pop()
            wide = np.flatnonzero(hi > lo)
            if depth >= self.depth or len(own) <= 1 or not len(wide):
                self.length[at] = depth + _path(len(own))
                continue
            k = int(random.choice(wide))
            # half of the splits fall between the rows at hand, half anywhere in the box, so that what lies outside is cut off soon
            a, b = (own[:, k].min(), own[:, k].max()) if random.random() < 0.5 else (lo[k], hi[k])
            if not b > a:
                a, b = lo[k], hi[k]
            value = float(random.uniform(a, b))
            below = own[:, k] < value
            left = self._leaf()
            self._leaf()
            self.what[at], self.value[at], self.left[at] = k, value, left
            inner_hi, inner_lo = hi.copy(), lo.copy()
            inner_hi[k] = inner_lo[k] = value
            waiting.append((left, own[below], lo, inner_hi, depth + 1))
            waiting.append((left + 1, own[~below], inner_lo, hi, depth + 1))

    def _leaf(self) -> int:
        self.what.append(-1)
        self.value.append(0.0)
        self.left.append(0)
        self.length.append(0.0)
        return len(self.what) - 1

    def scores(self, stats: np.ndarray) -> np.ndarray:
        total = np.zeros(len(stats))
        for root in self.roots:
            node = np.full(len(stats), root, np.int32)
            active = np.arange(len(stats))
            while len(active):
                at = node[active]
                inner = self.what[at] >= 0
                active, at = active[inner], at[inner]
                node[active] = self.left[at] + (stats[active, self.what[at]] >= self.value[at])
            total += self.length[node]
        return 2.0 ** (-total / len(self.roots) / max(self.expected, 1e-9))


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, statistics(batch.column(2)).T)], ["doc_id", "quality", *NAMES])


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(forest.scores(statistics(batch.column(1))), 6))], ["doc_id", "score"])

    return flat.tidy(run)


def trained(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> tuple[Forest | None, DataFrame]:
    """(forest, marks): grown from the statistics of at most fit_documents labelled rows; marks are (doc_id, quality) of all labels.

    Label rows with a null are left out; a document labelled both ways is bad. The forest is None where no document is labelled good.
    """
    frugal(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = texts.select("doc_id").distinct().join(marks, "doc_id")
    chosen = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), "text")
    table = rows.mapInArrow(_counted, "doc_id long, quality long, " + ", ".join(f"{n} double" for n in NAMES)).toArrow().sort_by([("doc_id", "ascending"), *((n, "ascending") for n in NAMES)])
    stats = np.stack([table.column(n).to_numpy() for n in NAMES], 1)
    good = table.column("quality").to_numpy() > 0
    return (Forest(stats[good], stats.min(0), stats.max(0)) if good.any() else None), marks


def threshold(scored: DataFrame, marks: DataFrame) -> float:
    """The greatest score that is kept: the one that tells most labelled rows rightly, halfway to the next. Without bad ones all is kept."""
    told = scored.where("doc_id is not null").join(marks, "doc_id")
    table = told.groupBy(F.round("score", 3).alias("score")).agg(F.sum((F.col("quality") > 0).cast("long")).alias("yes"), F.count("*").alias("n")).orderBy("score").collect()
    score = np.array([r["score"] for r in table])
    yes, n = np.array([r["yes"] for r in table], float), np.array([r["n"] for r in table], float)
    if (n - yes).sum() == 0:
        return float("inf")
    accuracy = np.cumsum(yes) - np.cumsum(n - yes)
    at = np.flatnonzero(accuracy == accuracy.max())
    return float((score[at[-1]] + (score[at[-1] + 1] if at[-1] + 1 < len(score) else score[at[-1]])) / 2)


def kept(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, score) of the documents that are no anomaly.

    A null text is left out, an empty one is scored as one without words. A null id stays null; a repeated row comes again. Without
    labelled good documents everything is kept, with a null score. Other columns are not read. All texts are scored once, and none
    takes part in a join but those that the forest is grown from.
    """
    forest, marks = trained(docs, labels, fit_documents)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if forest is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("score"))
    scored = written(rows.mapInArrow(_scored(forest), "doc_id long, score double"), "quality-scores")
    return scored.where(F.col("score") <= threshold(scored, marks))
