"""Repeated passages: windows of WINDOW words that stand in two documents at least, found in two ways.

Words are maximal runs of anything but ASCII white space, compared byte by byte. The minimiser of a window is the least hash of its
GRAM-word grams. Equal windows have equal minimisers, so only stretches of windows whose minimiser two documents share are
ever sent: a stretch is a super-k-mer, consecutive windows of one minimiser as one string.

super_kmers: stretches go to the bucket of their minimiser, where sorting the windows counts them.
suffixes: each stretch is the suffix that begins at its minimiser, with what is before it. Splitters sampled from the suffixes
range-partition them by leading words; a bucket sorts its suffixes by multikey quicksort. Where a splitter parts suffixes of one
minimiser they are compared across that boundary, in a group of their own.

A minimiser that more than HOT stretches have goes neither way, for its group could be a third of all: its windows are hashed where they
are, and combined before they are sent.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .shared import frugal, written

WINDOW, GRAM = 50, 8
#: Words of the stretches that make a bucket, and suffixes sampled for each splitter.
BUCKET, SAMPLES = 1 << 20, 32
#: Stretches of one minimiser that are compared in one bucket.
HOT = 1 << 14
#: Cells of documents in which sampled suffixes and hot windows are looked for.
CELLS = 1 << 22
_STRETCH = "doc_id long, mark long, start long, n int, lead int, key long"


def least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, done = h, 1
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def stretches(data: np.ndarray, offs: np.ndarray, window: int, gram: int, places: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, starts, windows, leads, minimisers) of the stretches of texts, by slices.

    lead: words from the start of a stretch to its minimiser's last place in the first window, or, if `places`, to its first place in
    every window of the stretch.
    """
    w = window - gram + 1
    for row, _, part, at in flat.slices(data, offs):
        starts, ends, bounds = flat.spans(part, at, flat.DARK)
        grams = flat.grams(flat.hashes(part, starts, ends, flat.SAME), gram)
        if len(grams) < w:
            continue
        low = least(grams, w)
        here, rows = flat.inside(bounds, window)
        if not len(here):
            continue
        value = low[here]
        new = np.ones(len(here), bool)
        new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
        lead = np.zeros(len(here), np.int64)
        if places:
            # first place of the minimum in each window: the next place, from the window's start on, that holds its value
            order = np.argsort(grams, kind="stable")
            lo = _next(grams, order, value, here)
            lead = lo - here
            new[1:] |= lo[1:] != lo[:-1]
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(here)))
        yield row, rows[heads], here[heads] - bounds[rows[heads]], n, lead[heads], value[heads]


def _next(grams: np.ndarray, order: np.ndarray, value: np.ndarray, here: np.ndarray) -> np.ndarray:
    """For each window the first place, not before it, of its value among the grams."""
    ranks = np.empty(len(grams), np.int64)
    ordered = grams[order]
    group = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    ranks[order] = group
    which = group[np.searchsorted(ordered, value)]
    size = np.int64(len(grams))
    return order[np.searchsorted(group * size + order, which * size + here)]


def _thin(window: int, gram: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat.buffers(batch.column(2))
            for row, rows, starts, n, lead, value in stretches(data, offs, window, gram, places):
                take = pa.array(rows + row)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(starts), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(value.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "start", "n", "lead", "key"])

    return flat.tidy(run)


def _packed(window: int, route: Callable[[list[bytes], np.ndarray], np.ndarray], tailed: bool):
    """Stretches with their words, joined by one space, and the bucket that `route` gives them, by what follows their lead if `tailed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat.buffers(batch.column(2))
            cut = batch.column(3).offsets.to_numpy()
            listed = {k: batch.column(i).values.to_numpy() for i, k in enumerate(("start", "n", "lead", "key"), 3)}
            for row, end, part, at in flat.slices(data, offs):
                starts, ends, bounds = flat.spans(part, at, flat.DARK)
                own = slice(cut[row], cut[end])
                rows = np.repeat(np.arange(end - row), np.diff(cut[row : end + 1]))
                first = bounds[rows] + listed["start"][own]
                words = listed["n"][own].astype(np.int64) + window - 1
                word = flat.runs(first, words)
                size = ends[word] - starts[word]
                body, inner = flat.gather(part, starts[word], size)
                spaced = np.full(len(body) + len(word), 32, np.uint8)
                spaced[np.arange(len(body)) + np.repeat(np.arange(len(word)), size)] = body
                edge = np.concatenate([[0], np.cumsum(words)])
                outer = (inner + np.arange(len(word) + 1))[edge]
                text = flat.strings(spaced, outer, pa.binary())
                take = pa.array(rows + row)
                lead = listed["lead"][own].astype(np.int64)
                begin = (inner[:-1] + np.arange(len(word)))[edge[:-1] + lead] if len(words) else edge[:0]
                tails = [spaced[a:b].tobytes() for a, b in zip(begin.tolist(), outer[1:].tolist())] if tailed else []
                columns = [pa.array(route(tails, listed["key"][own]), pa.int64()), batch.column(0).take(take), batch.column(1).take(take), *(pa.array(listed[k][own]) for k in ("start", "n", "lead")), text]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "mark", "start", "n", "lead", "body"])

    return flat.tidy(run)


def ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words by their bytes in lexical order, equal for equal bytes alone."""
    h = flat.hashes(data, starts, ends, flat.SAME)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    size, like = ends - starts, first[which]
    words = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if (size != size[like]).any() or (data[flat.runs(starts, size)] != data[flat.runs(starts[like], size)]).any():
        every = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        rank = {w: i for i, w in enumerate(sorted(set(every)))}
        return np.array([rank[w] for w in every], np.int64)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return rank[which]


def classes(hashed: np.ndarray, word: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class numbers in that order) of spans of `size` words from places `at` on that are equal, and equal in `hashed`, by sorting."""
    order = np.argsort(hashed, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashed[order][1:] != hashed[order][:-1]
    group = np.cumsum(new) - 1
    like = order[np.flatnonzero(new)][group]
    bad = np.zeros(len(order), bool)
    for k in range(size):
        bad |= word[at[order] + k] != word[at[like] + k]
    if bad.any():
        spans = np.stack([group, *(word[at[order] + k] for k in range(size))], 1)
        group = np.unique(spans, axis=0, return_inverse=True)[1].ravel()
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
    return order, group


def shared(order: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the class of each element, in the elements' own order, has more than one document."""
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    own = doc[order]
    many = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(many, np.diff(np.append(heads, len(order))))
    return out


def _opened(table: pa.Table):
    """(words of all stretches, words before each, documents, marks, starts, windows, leads) of a bucket."""
    data, offs = flat.buffers(table.column("body").cast(pa.large_binary()).combine_chunks())
    starts, ends, bounds = flat.spans(data, offs, flat.DARK)
    return ids(data, starts, ends), bounds, *(table.column(k).to_numpy().astype(np.int64) for k in ("doc_id", "mark", "start", "n", "lead"))


_COVER = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def _covers(rows: np.ndarray, places: np.ndarray, docs: np.ndarray, marks: np.ndarray, window: int) -> pa.Table:
    """The words that flagged windows cover, runs of consecutive windows as one."""
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (places[1:] > places[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(rows)) - 1 if len(heads) else heads
    return pa.table([pa.array(docs[rows[heads]]), pa.array(marks[rows[heads]]), pa.array(places[heads]), pa.array(places[tails] + window - 1)], schema=_COVER)


def _counted(window: int):
    def run(table: pa.Table) -> pa.Table:
        word, bounds, docs, marks, start, n, _ = _opened(table)
        rows = np.repeat(np.arange(len(n)), n)
        at = flat.runs(bounds[:-1], n)
        hashed = flat.grams(flat.mix(word.astype(flat.U) + flat.U(1)), window)[at]
        order, group = classes(hashed, word, at, window)
        hit = np.flatnonzero(shared(order, group, docs[rows]))
        return _covers(rows[hit], at[hit] - bounds[rows[hit]] + start[rows[hit]], docs, marks, window)

    return flat.tidy(run)


def multikey(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of rows of numbers sorted lexically; common: leading columns that a row has in common with the one before.

    Three-way radix quicksort, all segments of a depth at once: rows that are alone in their segment take no further part.
    """
    n, depth = columns.shape
    order = np.arange(n)
    common = np.full(n, depth)
    segment = np.zeros(n, np.int64)
    common[:1] = 0
    active = np.arange(n)
    for d in range(depth):
        if len(active) < 2:
            break
        key = columns[order[active], d]
        inner = np.lexsort((key, segment[active]))
        order[active] = order[active][inner]
        key = key[inner]
        seg = segment[active]  # active is in order, and lexsort keeps segments in place
        parted = np.zeros(len(active), bool)
        parted[1:] = (seg[1:] == seg[:-1]) & (key[1:] != key[:-1])
        common[active[parted]] = d
        new = np.ones(len(active), bool)
        new[1:] = (seg[1:] != seg[:-1]) | parted[1:]
        fresh = np.cumsum(new)
        segment[active] = fresh
        size = np.bincount(fresh)
        active = active[size[fresh] > 1]
    return order, common


def _sorted(window: int):
    def run(table: pa.Table) -> pa.Table:
        word, bounds, docs, marks, start, n, lead = _opened(table)
        anchor = bounds[:-1] + lead
        ahead = bounds[1:] - anchor
        right = np.full((len(n), window), -1, np.int64)
        for k in range(window):
            some = ahead > k
            right[some, k] = word[anchor[some] + k]
        order, common = multikey(right)
        del right
        anchor, lead, n, start, docs_, marks_ = anchor[order], lead[order], n[order], start[order], docs[order], marks[order]
        rows, places = [], []
        back = np.zeros(len(n), flat.U)
        for left in range(int(lead.max(initial=-1)) + 1):
            if left:
                can = lead >= left
                back[can] = (back[can] + word[anchor[can] - left].astype(flat.U) + flat.U(1)) * flat.GRAM
            own = np.flatnonzero((lead >= left) & (left > lead - n))
            if len(own) < 2:
                continue
            alike = np.cumsum(common < window - left)
            hashed = flat.mix(back[own] + flat.mix(alike[own].astype(flat.U)))
            by, group = classes(hashed, word, anchor[own] - left, window)
            hit = own[shared(by, group, docs_[own])]
            rows.append(hit)
            places.append(start[hit] + lead[hit] - left)
        rows = np.concatenate([np.zeros(0, np.int64), *rows])
        return _covers(rows, np.concatenate([np.zeros(0, np.int64), *places]), docs_, marks_, window)

    return flat.tidy(run)


def _hashed(window: int):
    """The windows of the stretches listed for each text, each with its place and two hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat.buffers(batch.column(2))
            cut = batch.column(3).offsets.to_numpy()
            start, n = (batch.column(k).values.to_numpy().astype(np.int64) for k in (3, 4))
            for row, end, part, at in flat.slices(data, offs):
                starts, ends, bounds = flat.spans(part, at, flat.DARK)
                words = flat.hashes(part, starts, ends, flat.SAME)
                own = slice(cut[row], cut[end])
                rows = np.repeat(np.repeat(np.arange(end - row), np.diff(cut[row : end + 1])), n[own])
                place = flat.runs(start[own], n[own])
                here = bounds[rows] + place
                one, two = flat.grams(words, window)[here], flat.grams(flat.mix(words + flat.U(1)), window)[here]
                take = pa.array(rows + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "mark", "place", "one", "two"])

    return flat.tidy(run)


def _hot(rows: DataFrame, some: DataFrame, window: int) -> DataFrame:
    """Covers of the stretches of minimisers that very many stretches have: their windows are counted by 128 bits of hash, one by one,
    which are combined before they travel."""
    each = written(_texts(_holding(rows, some), some).select("doc_id", "mark", "text", "start", "n").mapInArrow(_hashed(window), "doc_id long, mark long, place long, one long, two long"), "hot-windows")
    many = each.groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("one", "two")
    return each.join(many, ["one", "two"]).select("doc_id", "mark", F.col("place").alias("first_word"), (F.col("place") + window - 1).alias("last_word"))


def _listed(docs: DataFrame, window: int, gram: int, places: bool, hot: int) -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """(documents with an id and text, stretches whose minimiser two documents share, their number of words, covers of those whose
    minimiser more than `hot` stretches have, which are not among the stretches)."""
    frugal(docs.sparkSession)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    thin = written(rows.mapInArrow(_thin(window, gram, places), _STRETCH), "thin")
    by = thin.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("times")).where("low <> high").select("key", "times")
    names = ("doc_id", "mark", "start", "n", "lead", "key")
    both = written(thin.join(by, "key").select(*names, (F.col("times") > hot).alias("hot")).distinct(), "stretches")
    kept, some = both.where("not hot").select(*names), both.where("hot").select(*names)
    words = kept.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    return rows, kept, words, _hot(rows, some, window) if some.limit(1).count() else None


def _texts(rows: DataFrame, kept: DataFrame) -> DataFrame:
    names = ("start", "n", "lead", "key")
    lists = kept.groupBy("doc_id", "mark").agg(*(F.collect_list(k).alias(k) for k in names))
    # the lists grow with the texts: both sides are shuffled at every size
    return rows.join(lists, ["doc_id", "mark"]).select("doc_id", "mark", "text", *names)


def _holding(rows: DataFrame, few: DataFrame) -> DataFrame:
    """The rows whose document is in few, and others of their cells: texts without any of few are not shuffled for it. There
    are CELLS cells at most, so what is sent has a bound."""
    cell = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(CELLS)).alias("cell")
    return rows.select("*", cell).join(F.broadcast(few.select(cell).distinct()), "cell", "left_semi").drop("cell")


_COVERS = "doc_id long, mark long, first_word long, last_word long"
_PACKED = "bucket long, doc_id long, mark long, start long, n int, lead int, body binary"


def _merged(covers: DataFrame) -> DataFrame:
    by = Window.partitionBy("doc_id", "mark").orderBy("first_word", "last_word")
    edge = F.max("last_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.col("edge") + 1 < F.col("first_word")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    spans = covers.withColumn("edge", F.coalesce(edge, F.lit(-2))).withColumn("island", island).groupBy("doc_id", "mark", "island").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last"))
    return spans.select("doc_id", "first_word", (F.col("last") - F.col("first_word") + 1).alias("n_words")).distinct()


def super_kmers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, first_word, n_words) of the passages of `window` words and more, in every document that holds them, that others share.

    A word belongs to a passage if a window over it stands in another document, too; passages that touch are one. Words count from 0.
    Windows that only one document repeats don't count, nor do rows that are the same document again or that share its id.
    Rows with a null id or text, and texts of fewer words than a window, have no passage. Other columns are not read.
    """
    rows, kept, words, covers = _listed(docs, window, gram, False, hot)
    buckets = max(1, math.ceil(words / BUCKET))

    def route(tails: list[bytes], keys: np.ndarray) -> np.ndarray:
        return (flat.mix(keys.view(flat.U)) % flat.U(buckets)).astype(np.int64)

    packed = _texts(rows, kept).mapInArrow(_packed(window, route, False), _PACKED)
    found = packed.groupBy("bucket").applyInArrow(_counted(window), _COVERS)
    return _merged(found if covers is None else found.unionByName(covers))


def suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The same passages as super_kmers() has, by sorting suffixes; what holds there of rows and columns holds here."""
    rows, kept, words, covers = _listed(docs, window, gram, True, hot)
    buckets = max(1, math.ceil(words / BUCKET))
    splitters: list[bytes] = []
    if buckets > 1:
        every = max(1, kept.count() // (SAMPLES * buckets))
        few = kept.where(F.pmod(F.xxhash64("doc_id", "start", "key"), F.lit(every)) == 0)
        some = _texts(_holding(rows, few), few).mapInArrow(_packed(window, lambda tails, keys: np.zeros(len(keys), np.int64), False), _PACKED)
        tails = sorted(bytes(r["tail"]) for r in some.select(_tail(F.col("body"), F.col("lead")).alias("tail")).toLocalIterator())
        splitters = sorted({tails[i * len(tails) // buckets] for i in range(1, buckets)}) if tails else []
    edges = {_head(s, gram): -1 - k for k, s in reversed(list(enumerate(splitters)))}

    def route(tails: list[bytes], keys: np.ndarray) -> np.ndarray:
        # suffixes that begin with the minimiser at which a splitter cuts are compared across that boundary
        heads = (edges.get(_head(t, gram)) if edges else None for t in tails)
        return np.array([bisect.bisect_right(splitters, t) if h is None else h for t, h in zip(tails, heads)], np.int64)

    packed = _texts(rows, kept).mapInArrow(_packed(window, route, True), _PACKED)
    found = packed.groupBy("bucket").applyInArrow(_sorted(window), _COVERS)
    return _merged(found if covers is None else found.unionByName(covers))


def _head(tail: bytes, gram: int) -> bytes:
    return b" ".join(tail.split(b" ", gram)[:gram])


def _tail(body, lead):
    words = F.split(F.decode(body, "utf-8"), " ")
    return F.encode(F.array_join(F.slice(words, lead + 1, F.size(words)), " "), "utf-8")
