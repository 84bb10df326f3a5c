"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark items.

An item is the set of its word n-grams. It is found in a document if some window of the document as long as the item, in words,
holds at least `threshold` of the set. An item of k n-grams that must share `need` of them shares at least one of any
k - need + 1; its rarest are taken, by the number of documents that hold them. Documents are looked up for these prefixes alone. One
with an n-gram of a prefix is looked up for the others of its items, where its words are at hand, and verified if it is long enough and if, within
an item's length of a place of its prefix, there are as many n-grams of items as the item must share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .shared import frugal

N, THRESHOLD = 3, 0.7
#: n-grams of items that are sent to the executors at a time; a larger benchmark is joined slice by slice.
MOST_GRAMS = 1 << 21
SIEVE = flat.U((1 << 20) - 1)
MATCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.IntegerType()), T.StructField("n_shingles", T.IntegerType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType())])


class Items:
    """Items of a slice, with their n-grams as sorted distinct hashes (`keys`), by n-gram size."""

    def __init__(self, rows: list[tuple[int, str]], n: int, threshold: float):
        rows = list(dict.fromkeys(rows))
        self.ids, self.sizes, self.words, self.need, self.total = [], [], [], [], []
        grams: list[np.ndarray] = []
        self.text: dict[int, bytes] = {}
        for item, text in rows:
            data = np.frombuffer(text.encode(), np.uint8)
            offs = np.array([0, len(data)])
            starts, ends, _ = flat.spans(data, offs)
            if not len(starts):
                continue
            size = min(n, len(starts))
            own = flat.grams(flat.hashes(data, starts, ends), size)
            for at, h in enumerate(own.tolist()):
                self.text[h] = phrase(data, starts, ends, at, size)
            own = np.unique(own)
            self.ids.append(item)
            self.sizes.append(size)
            self.words.append(len(starts))
            self.total.append(len(own))
            self.need.append(max(1, math.ceil(threshold * len(own) - 1e-9)))
            grams.append(own)
        self.grams = grams
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted(set(self.sizes)):
            self.by_size[size] = sieved(np.unique(np.concatenate([g for g, s in zip(grams, self.sizes) if s == size])))
        self.first: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: n-gram of a prefix -> items, once their order is known.
        self.prefix: dict[int, list[int]] = {}

    def order(self, df: dict[int, int]) -> None:
        for k, g in enumerate(self.grams):
            for h in sorted(g.tolist(), key=lambda h: (df.get(h, 0), h))[: self.total[k] - self.need[k] + 1]:
                self.prefix.setdefault(h, []).append(k)
        for size in self.by_size:
            own = {h for h, ks in self.prefix.items() if any(self.sizes[k] == size for k in ks)}
            self.first[size] = sieved(np.sort(np.array(list(own), flat.U)))

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n-gram size, rows, word numbers, hashes) of the items' n-grams in a slice of texts."""
        for size, known in self.by_size.items():
            yield size, *met(flat.grams(words, size), known, bounds, size)


def sieved(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sieve = np.zeros(int(SIEVE) + 1, bool)
    sieve[(keys & SIEVE).astype(np.int64)] = True
    return keys, sieve


def met(grams: np.ndarray, known: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, size: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, word numbers, hashes) of the known ones of n-grams, of those at the places `among`, that lie within one row."""
    keys, sieve = known
    own = grams if among is None else grams[among]
    at = np.flatnonzero(sieve[(own & SIEVE).astype(np.int64)])
    found = own[at]
    same = keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found if len(keys) else np.zeros(len(at), bool)
    at, found = at[same] if among is None else among[at[same]], found[same]
    rows = np.searchsorted(bounds, at, "right") - 1
    whole = at + size <= bounds[rows + 1]
    return rows[whole], at[whole], found[whole]


def phrase(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> bytes:
    return b" ".join(flat.LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(at, at + size))


def _counts(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            data, offs = flat.buffers(batch.column(0))
            for _, _, part, at in flat.slices(data, offs):
                starts, ends, bounds = flat.spans(part, at)
                for _, rows, _, found in items.hits(flat.hashes(part, starts, ends), bounds):
                    once = np.unique(np.rec.fromarrays([rows, found]))
                    for h, c in zip(*(x.tolist() for x in np.unique(once.f1, return_counts=True))):
                        total[h] = total.get(h, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), flat.U).view(np.int64)), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    return flat.tidy(run)


def best(places: np.ndarray, grams: np.ndarray, span: int, need: int) -> tuple[int, int]:
    """(most distinct n-grams that start within span places of one another, the first place of the earliest such window)."""
    ends = np.searchsorted(places, places + span, "right")
    most, where = 0, -1
    for i in np.flatnonzero(ends - np.arange(len(places)) >= need).tolist():
        if ends[i] - i > most and (n := len(set(grams[i : ends[i]].tolist()))) > most:
            most, where = n, int(places[i])
    return most, where


def _found(items: Items, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, n-grams shared, first word of the window) of each match in a column of texts."""
    data, offs = flat.buffers(column)
    for row, _, part, at in flat.slices(data, offs):
        starts, ends, bounds = flat.spans(part, at)
        words = flat.hashes(part, starts, ends)
        for size in items.first:
            grams = flat.grams(words, size)
            likely, first, told = met(grams, items.first[size], bounds, size)
            some = np.unique(likely)
            among = flat.runs(bounds[some], np.maximum(np.minimum(bounds[some + 1], len(grams)) - bounds[some], 0)) if len(some) else some
            rows, places, found = met(grams, items.by_size[size], bounds, size, among)
            for r in some.tolist():
                i, j = np.searchsorted(rows, [r, r + 1])
                own, where = found[i:j], places[i:j]
                distinct = len(np.unique(own))
                i, j = np.searchsorted(likely, [r, r + 1])
                begun: dict[int, list[int]] = {}
                for h, at_ in zip(told[i:j].tolist(), first[i:j].tolist()):
                    for k in items.prefix[h]:
                        if items.sizes[k] == size:
                            begun.setdefault(k, []).append(at_)
                for k in sorted(begun):
                    need, span = items.need[k], items.words[k] - size
                    if bounds[r + 1] - bounds[r] - size + 1 < need or distinct < need:
                        continue
                    near = np.array(begun[k])
                    if (np.searchsorted(where, near + span, "right") - np.searchsorted(where, near - span) < need).all():
                        continue
                    mine = np.isin(own, items.grams[k])
                    mine[mine] = [phrase(part, starts, ends, int(p), size) == items.text[int(h)] for h, p in zip(own[mine], where[mine])]
                    n, begin = best(where[mine], own[mine], span, need)
                    if n >= need:
                        yield row + r, k, n, begin - int(bounds[r])


def _matches(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], items.ids[k], n, items.total[k], round(n / items.total[k], 6), first) for r, k, n, first in _found(items, batch.column(1))]
            yield pa.RecordBatch.from_pylist([dict(zip(MATCHES.names, x)) for x in rows], pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int32()), ("n_shingles", pa.int32()), ("containment", pa.float64()), ("first_word", pa.int64())]))

    return flat.tidy(run)


def _clean(items: Items, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, *_ in _found(items, batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return flat.tidy(run)


def prepared(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = MOST_GRAMS) -> Iterator[Items]:
    """The benchmark as slices of at most `most` n-grams (one item at least), ordered by rarity over all documents."""

    def ready(rows: list[tuple[int, str]]) -> Items:
        items = Items(rows, n, threshold)
        texts = docs.where(F.col("text").isNotNull()).select("text")
        counted = texts.mapInArrow(_counts(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        items.order({r["gram"] % (1 << 64): r["n"] for r in counted.collect()} if items.ids else {})
        return items

    frugal(docs.sparkSession)
    rows, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        long = row["text"].count(" ") + 1
        if rows and size + long > most:
            yield ready(rows)
            rows, size = [], 0
        rows.append((row["item_id"], row["text"]))
        size += long
    if rows:
        yield ready(rows)


def matches(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = MOST_GRAMS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment, first_word) of each item found in a document.

    first_word is the number, from 0, of the word at which the earliest of the best windows starts. An item of fewer than n words is
    one n-gram of them all; an item with no word, or null, is never found. A document with a null id or text has no match, an
    empty one neither. A repeated document row gives its matches again; a repeated item row counts once. Columns other than
    doc_id, text and item_id, text are not read, whatever their names.
    """
    pairs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for k, items in enumerate(prepared(docs, benchmark, n, threshold, most)):
        part = pairs.mapInArrow(_matches(items), MATCHES)
        out = part if not k else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = MOST_GRAMS) -> DataFrame:
    """The documents, all columns, in which no item is found, as matches() has it; null and empty texts stay, ids are not looked at."""
    out = docs
    for items in prepared(docs, benchmark, n, threshold, most):
        out = out.mapInArrow(_clean(items, docs.columns.index("text")), docs.schema)
    return out
