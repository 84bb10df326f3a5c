"""Toxic spans by a linear-chain conditional random field over the words of each line, with labels O and T.

A word's features are the word and how it begins. Token labels come from labelled documents: a word is T, in a toxic document, if
one of its features stands nearly only in toxic documents, in many of them and in many different surroundings (a passage that
many copies share is one surrounding). The field is fitted by gradient steps on the exact
likelihood. Forward-backward runs over odds, all lines side by side; marginals p of at least one half form the spans, and a
document's score is their sum of -log(1 - p), so that 1 - exp(-score) is the probability that any of them is toxic. The least score that counts as toxic is the one of highest F1 over all labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .shared import frugal, written

#: Labelled documents that docs holds from which the field is fitted, and how many of them are toxic if there are so many, half of
#: them at most unless others are too few; of either kind the first by a hash of their id.
FIT_DOCUMENTS, TOXIC_DOCUMENTS = 2000, 400
#: Bytes of their texts, of each kind, that the fit reads: documents are taken up to that, in the same order.
FIT_BYTES = 32 << 20
#: Words of a line that are gone through one after another; longer lines are cut.
CUT = 256
SPANS = "array<struct<begin: int, end: int>>"
SCORED = f"doc_id long, score double, spans {SPANS}"
_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
#: Steps of Adam, its rate, weight of the squares; toxic documents and surroundings, and share of toxic ones, that make a feature T.
STEPS, RATE, SQUARES, SURROUNDINGS, SHARE = 30, 0.3, 1e-3, 5, 0.9
#: Bytes of the beginnings that are features.
BEGINNINGS = (5, 6, 7)


@dataclass
class Field:
    """Log odds of T against O: of each known feature, of any word; odds at a line's start; moves[i, j] from label i to j."""

    keys: np.ndarray
    weights: np.ndarray
    every: float
    start: float
    moves: np.ndarray


class Lines:
    """Words of a slice in columns: first all first words of lines, longest line first, then all second words, and so on.

    A line of more than `cut` words is cut into pieces that stand as lines of their own; what one piece hands to the next comes from
    the products of their words' matrices.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, bounds: np.ndarray, cut: int = 1 << 62):
        n = len(starts)
        first = np.zeros(n, bool)
        if n:
            line = np.cumsum(data == 10)[starts]
            first[1:] = line[1:] != line[:-1]
            first[bounds[bounds < n]] = True
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, n))
        parts = -(-sizes // cut)
        place = flat.runs(np.zeros(len(parts), np.int64), parts)  # of a piece in its line
        heads, left = np.repeat(heads, parts) + place * min(cut, n + 1), np.repeat(sizes, parts) - place * min(cut, n + 1)
        sizes = np.minimum(left, cut)
        order = np.argsort(-sizes, kind="stable")
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        #: Columns of the pieces of long lines, one after another, with their first words, sizes, and whether a line begins and ends with them.
        self.cut = np.flatnonzero(np.repeat(parts, parts) > 1)
        self.columns, self.heads, self.sizes, self.begins, self.ends = column[self.cut], heads[self.cut], sizes[self.cut], place[self.cut] == 0, left[self.cut] <= cut
        heads, sizes = heads[order], sizes[order]
        deepest = int(sizes[0]) if n else 0
        self.active = np.searchsorted(-sizes, -np.arange(deepest), "left")  # lines longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        self.word = np.empty(n, np.int64)
        for t in range(deepest):
            self.word[self.at[t] : self.at[t + 1]] = heads[: self.active[t]] + t

    def _handed(self, odds: np.ndarray, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece of a long line (forward odds of the word before, 0 at a line's start; backward odds of its last word)."""
        (oo, ot), (to, tt) = moves
        own = np.empty(len(odds))
        own[self.word] = odds
        m, depth = len(self.cut), int(self.sizes.max())
        ahead, back = np.tile(np.eye(2), (m, 1, 1)), np.tile(np.eye(2), (m, 1, 1))
        for t in range(depth):
            some = np.flatnonzero(self.sizes > t)
            e = own[self.heads[some] + t]
            step = np.empty((len(some), 2, 2))
            step[:, 0, 0], step[:, 0, 1], step[:, 1, 0], step[:, 1, 1] = oo, to, e * ot, e * tt
            if not t:
                new = self.begins[some]
                step[new, 0, 0], step[new, 0, 1], step[new, 1, 0], step[new, 1, 1] = 1, 0, e[new] * start, 0
            ahead[some] = step @ ahead[some]
            ahead[some] /= ahead[some].max((1, 2), keepdims=True)
            step[:, 0, 0], step[:, 0, 1], step[:, 1, 0], step[:, 1, 1] = oo, e * ot, to, e * tt
            back[some] = back[some] @ step
            back[some] /= back[some].max((1, 2), keepdims=True)
        before, after = np.zeros(m), np.ones(m)
        v = np.array([1.0, 0.0])
        for i in range(m):
            if self.begins[i]:
                v = np.array([1.0, 0.0])
            before[i] = v[1] / max(v[0], 1e-300)
            v = ahead[i] @ v
            v = v / v.max()
        v = np.ones(2)
        for i in range(m - 1, -1, -1):
            if self.ends[i]:
                v = np.ones(2)
            after[i] = v[1] / max(v[0], 1e-300)
            v = back[i] @ v
            v = v / v.max()
        return before, after

    def marginals(self, odds: np.ndarray, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(forward odds, backward odds, probability of T), all in columns."""
        (oo, ot), (to, tt) = moves
        ahead, back = odds.copy(), np.ones_like(odds)
        at, depth = self.at, len(self.active)
        if len(self.cut):
            before, last = self._handed(odds, start, moves)
            back[at[self.sizes - 1] + self.columns] = last
        for t in range(depth):
            if not t:
                gain = np.full(int(at[1]), start)
                if len(self.cut):
                    gain[self.columns] = np.where(self.begins, start, (ot + tt * before) / (oo + to * before))
                ahead[: at[1]] *= gain
            else:
                before = ahead[at[t - 1] : at[t - 1] + self.active[t]]
                ahead[at[t] : at[t + 1]] *= (ot + tt * before) / (oo + to * before)
        for t in range(depth - 2, -1, -1):
            k = self.active[t + 1]
            after = odds[at[t + 1] : at[t + 2]] * back[at[t + 1] : at[t + 2]]
            back[at[t] : at[t] + k] = (to + tt * after) / (oo + ot * after)
        both = ahead * back
        return ahead, back, both / (1 + both)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, then of their beginnings; 0 where the word is no longer than that."""
    out = flat.hashes(data, np.concatenate([starts] * (1 + len(BEGINNINGS))), np.concatenate([ends, *(np.minimum(ends, starts + n) for n in BEGINNINGS)])).reshape(-1, len(starts))
    return [out[0], *(np.where(ends - starts > n, h + flat.U(n), flat.U(0)) for n, h in zip(BEGINNINGS, out[1:]))]


def fitted(rows: list[tuple[str, int]], steps: int = STEPS) -> Field | None:
    """The field of labelled texts; None if no feature is told to be toxic."""
    rows = [r for r in rows if r[0]]
    if not rows:
        return None
    data, offs = flat.buffers(pa.array([r[0] for r in rows]))
    toxic = np.array([r[1] for r in rows], bool)
    found, inner, around, of = [], [], [], []
    for a, b, part, at in flat.slices(data, offs):
        starts, ends, bounds = flat.spans(part, at)
        found.append(features(part, starts, ends))
        padded = np.concatenate([np.zeros(1, flat.U), found[-1][0], np.zeros(1, flat.U)])
        inner.append(Lines(part, starts, bounds))
        around.append(flat.mix(padded[:-2] * flat.GRAM + padded[2:]))
        of.append(np.repeat(np.arange(a, b), np.diff(bounds)))
    context, doc = np.concatenate(around), np.concatenate(of)
    bad = toxic[doc]
    keys, ids, told = np.zeros(1, flat.U), [], [np.zeros(1, bool)]
    for k in range(1 + len(BEGINNINGS)):
        own, word = np.unique(np.concatenate([x[k] for x in found]), return_inverse=True)

        def distinct(what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            once = _once(word, what, bad)
            return np.bincount(word[once], bad[once], len(own)), np.bincount(word[once], minlength=len(own))

        yes, n = distinct(context)
        sure = (yes >= SURROUNDINGS) & (yes >= SHARE * n) & (distinct(doc)[0] >= SURROUNDINGS) & (own != 0)
        kept = (n >= 3) & (own != 0)
        place = np.where(kept, np.cumsum(kept) + len(keys) - 1, 0)
        ids.append(place[word])
        told.append(sure[kept])
        keys = np.concatenate([keys, own[kept]])
    told = np.concatenate(told)
    if not told.any():
        return None
    truth = np.logical_or.reduce([told[x] for x in ids]) & bad
    cut = np.concatenate([[0], np.cumsum([len(x) for x in around])])
    parts = [(x, [i[a:b][x.word] for i in ids], truth[a:b][x.word]) for x, a, b in zip(inner, cut[:-1], cut[1:])]
    n = len(keys)
    weights = np.zeros(n + 6)  # of features; start, four moves, every word
    weights[-1] = -3.0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        slope = gradient(weights, parts, n)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    order = np.argsort(keys[1:])
    return Field(keys[1:][order], weights[1:n][order], float(weights[-1]), float(np.exp(weights[-6])), np.exp(weights[-5:-1].reshape(2, 2)))


def gradient(weights: np.ndarray, parts: list[tuple[Lines, list[np.ndarray], np.ndarray]], n: int) -> np.ndarray:
    """Slope of the negative log-likelihood and the weighted squares, at the weights of n features (the first is none), then of a
    line's start, four moves, and any word. parts: lines, their words' features, and which words are T, in columns."""
    slope = SQUARES * weights
    moves = np.exp(weights[-5:-1].reshape(2, 2))
    for x, w, true in parts:
        odds = np.exp(np.clip(sum(weights[i] for i in w) + weights[-1], -30, 30))
        ahead, back, p = x.marginals(odds, float(np.exp(weights[-6])), moves)
        miss = p - true
        for i in w:
            slope[:n] += np.bincount(i, miss, n)
        slope[-1] += miss.sum()
        slope[-6] += miss[: x.at[1]].sum() if len(x.at) > 1 else 0
        if len(x.active) > 1:
            previous = flat.runs(x.at[:-2], x.active[1:])
            now = np.arange(x.at[1], x.at[-1])
            e = odds[now] * back[now]
            pairs = np.stack([np.full(len(e), moves[0, 0]), moves[0, 1] * e, moves[1, 0] * ahead[previous], moves[1, 1] * ahead[previous] * e])
            slope[-5:-1] += (pairs / pairs.sum(0)).sum(1) - np.bincount(true[previous] * 2 + true[now], minlength=4)
    slope[0] = 0
    return slope


def _once(*columns: np.ndarray) -> np.ndarray:
    """The first places of distinct rows."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order[new]


def _odds(field: Field, found: list[np.ndarray], sieve: np.ndarray) -> np.ndarray:
    out = np.full(len(found[0]), field.every)
    for h in found:
        at = np.flatnonzero(sieve[(h >> flat.U(42)).astype(np.int64)])
        near = np.minimum(np.searchsorted(field.keys, h[at]), len(field.keys) - 1)
        same = field.keys[near] == h[at]
        out[at[same]] += field.weights[near[same]]
    return np.exp(np.clip(out, -30, 30))


def scores(field: Field, column: pa.Array) -> Iterator[tuple[int, float, list[tuple[int, int]]]]:
    """(row, score, spans in characters) of each text with a span."""
    sieve = np.zeros(1 << 22, bool)
    sieve[(field.keys >> flat.U(42)).astype(np.int64)] = True
    data, offs = flat.buffers(column)
    for row, _, part, at in flat.slices(data, offs):
        starts, ends, bounds = flat.spans(part, at)
        lines = Lines(part, starts, bounds, CUT)
        p = np.empty(len(starts))
        p[lines.word] = lines.marginals(_odds(field, features(part, starts, ends), sieve)[lines.word], field.start, field.moves)[2]
        hot = np.flatnonzero(p >= 0.5)
        if not len(hot):
            continue
        rows = np.searchsorted(bounds, hot, "right") - 1
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        fresh = np.ones(len(hot), bool)
        fresh[1:] = (hot[1:] != hot[:-1] + 1) | (rows[1:] != rows[:-1])
        for r in np.unique(rows).tolist():
            own = np.flatnonzero(rows == r)
            heads = own[fresh[own]]
            tails = np.append(heads[1:], own[-1] + 1) - 1
            base = chars[at[r]]
            yield row + r, float(-np.log(np.maximum(1 - p[hot[own]], 1e-12)).sum()), list(zip((chars[starts[hot[heads]]] - base).tolist(), (chars[ends[hot[tails]]] - base).tolist()))


def _scored(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, round(s, 6), x) for r, s, x in scores(field, batch.column(1))]
            columns = [batch.column(0).take(pa.array([x[0] for x in rows], pa.int64())), pa.array([x[1] for x in rows], pa.float64()), pa.array([[{"begin": a, "end": b} for a, b in x[2]] for x in rows], _SPAN)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"])

    return flat.tidy(run)


def _clean(field: Field, least: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, s, _ in scores(field, batch.column(at)) if round(s, 6) >= least]] = False
            yield batch.filter(pa.array(keep))

    return flat.tidy(run)


def sampled(held: DataFrame, fit_documents: int, toxic_documents: int = TOXIC_DOCUMENTS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(doc_id, toxic) of the documents (doc_id, toxic, size in bytes, if known) to fit from; toxic ones first, as far as toxic_documents goes."""
    n = {r["bad"]: r["count"] for r in held.groupBy((F.col("toxic") > 0).alias("bad")).count().collect()}
    bad = min(n.get(True, 0), max(min(toxic_documents, fit_documents // 2), fit_documents - n.get(False, 0)))
    order, size = (F.xxhash64("doc_id"), F.col("doc_id")), F.col("size") if "size" in held.columns else F.lit(0)

    def some(of: str, most: int) -> DataFrame:
        first = held.where(of).orderBy(*order).limit(most)  # at most fit_documents rows, so that one window holds them
        return first.withColumn("all", F.sum(size).over(Window.orderBy(*order))).where(F.col("all") <= fit_bytes).select("doc_id", "toxic")

    return some("toxic > 0", bad).unionByName(some("toxic <= 0", fit_documents - bad))


def trained(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> tuple[Field | None, DataFrame]:
    """(field, labelled documents): fitted from at most fit_documents of the labelled documents (doc_id, toxic, size) that docs holds.

    Label rows with a null are left out; a document labelled both ways is toxic. With no labelled document of either kind, or no
    telling word, the field is None and nothing is toxic.
    """
    frugal(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = texts.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    held = written(sizes.join(marks, "doc_id").select("doc_id", "toxic", "size"), "labelled")
    rows = texts.join(F.broadcast(sampled(held, fit_documents)), "doc_id").select("doc_id", "text", "toxic").collect()
    return fitted([(r["text"], int(r["toxic"] > 0)) for r in sorted(rows)]), held


def threshold(found: DataFrame, held: DataFrame) -> float:
    """The least score that counts as toxic: that of highest F1 over all labelled documents. found: (doc_id, score) of those with a span."""
    told = found.where("score > 0").join(held, "doc_id")
    table = told.groupBy(F.round("score", 3).alias("score")).agg(F.sum((F.col("toxic") > 0).cast("long")).alias("yes"), F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    all_toxic = held.where("toxic > 0").count()
    least, best, yes, n = float("inf"), 0.0, 0, 0
    for r in table:
        yes, n = yes + r["yes"], n + r["n"]
        if 2 * yes / (n + all_toxic) >= best:
            least, best = r["score"] - 0.0005, 2 * yes / (n + all_toxic)
    return least


def toxic(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, score, spans) of each toxic document; a span is [begin, end) in characters.

    A null id or text, or an empty text, is never toxic. A repeated row gives its result again. Other columns are not read. All texts
    are scored once, and no text takes part in a join but those that the field is fitted from.
    """
    field, held = trained(docs, labels, fit_documents)
    if field is None:
        return docs.sparkSession.createDataFrame([], SCORED)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    found = written(rows.mapInArrow(_scored(field), SCORED), "toxic-scores")
    return found.where(F.col("score") >= threshold(found, held))


def clean(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """The documents, all columns, that are not toxic as toxic() has it; null texts and rows with a null id and no span stay.

    Texts are scored for the threshold and again as they are filtered, so that they need neither be joined to their scores nor written
    with them.
    """
    field, held = trained(docs, labels, fit_documents)
    if field is None:
        return docs
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    found = written(rows.mapInArrow(_scored(field), SCORED).select("doc_id", "score"), "toxic-scores")
    return docs.mapInArrow(_clean(field, threshold(found, held), docs.columns.index("text")), docs.schema)
