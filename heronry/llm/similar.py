"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of THRESHOLD at least are linked.

Documents with the same set are copies, and count as one. Of a set of k, two similar sets share at least l of the first
k - ceil(THRESHOLD * k) + l in each (the l-prefix), in an order common to all: n-grams that few sets have by hash, then the frequent
ones by frequency. Each set takes the l for which its estimated candidate cost is least, a pair the larger l of its two. Sets of x and
y n-grams must share c = THRESHOLD / (1 + THRESHOLD) * (x + y) at least, so for such a pair the first x - c + l and y - c + l will do.

Groups of near copies hold nearly all similar pairs, and these grow with the square of a group. So groups are found first, by linking
each set to the least one that shares two of its least n-grams. Then prefix n-grams travel packed to the bucket of their hash,
where only sets of different groups are paired; pairs that share l are verified on whole sets. The links within a group are
counted in place, whole sets against each other, in cells of bounded size; pairs are never sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import bucketed, frugal, unused, written

N, THRESHOLD = 3, 0.55
#: An n-gram is frequent if it is in one set of RARE, and in LEAST_FREQUENT at least.
RARE, LEAST_FREQUENT = 4000, 16
#: Largest l, cost of a verification in posting comparisons for each n-gram of the set.
MOST_SHARED, VERIFY = 32, 0.1
#: Least n-grams of a set by which groups are found, and how many of them a set shares with the one it is linked to.
FIRST, MET = 8, 2
#: n-grams of a counted block, postings of a bucket and of an n-gram in it, n-grams of the sets that are compared together.
BLOCK, BUCKET, SPLIT, TOGETHER = 8 << 20, 1 << 21, 1 << 14, 1 << 20
#: Groups in which met pairs are counted, for each bucket of postings.
COUNTS = 4


def sets(data: np.ndarray, offs: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text that has a word; fewer than n words are one n-gram of them all."""
    for row, end, part, at in flat.slices(data, offs):
        starts, ends, bounds = flat.spans(part, at)
        words = flat.hashes(part, starts, ends)
        all_grams = flat.grams(words, n)
        for k in range(end - row):
            a, b = bounds[k], bounds[k + 1]
            if b - a >= n:
                yield row + k, np.unique(all_grams[a : b - n + 1])
            elif b > a:
                yield row + k, flat.grams(words[a:b], int(b - a)) + flat.U(b - a)


def needed(k: int | np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * np.asarray(k) - 1e-9).astype(np.int64)


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sid, size, first = [], [], [], []
            for row, own in sets(*flat.buffers(batch.column(2)), n):
                rows.append(row)
                sid.append(_name(own))
                size.append(len(own))
                first.append(own[:FIRST].view(np.int64))
            take = pa.array(rows, pa.int64())
            lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in first]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), lists], ["doc_id", "mark", "sid", "size", "first"])

    return flat.tidy(run)


def _name(own: np.ndarray) -> int:
    return int(flat.mix(own * flat.GRAM).sum(dtype=flat.U).astype(np.int64))


def _likely(n: int, share: float):
    """(n-gram, sets of a block that hold it) of those that half of `share` of the sets of the block hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0

        def out() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(block), return_counts=True)
            many = times >= max(2, share * len(block) / 2)
            return pa.RecordBatch.from_arrays([pa.array(grams[many].view(np.int64)), pa.array(times[many])], ["gram", "times"])

        for batch in batches:
            for _, own in sets(*flat.buffers(batch.column(0)), n):
                block.append(own)
                size += len(own)
                if size >= BLOCK:
                    yield out()
                    block, size = [], 0
        if block:
            yield out()

    return flat.tidy(run)


def ordered(own: np.ndarray, keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in the common order, in how many sets each is known to be)."""
    df = np.ones(len(own), np.int64)
    if len(keys):
        near = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        same = keys[near] == own
        df[same] = times[near[same]]
        order = np.argsort(df, kind="stable")  # own is in the order of its hashes
        return own[order], df[order]
    return own, df


def chosen(df: np.ndarray, prefix: int) -> int:
    """The l whose l-prefix costs least: its postings, and at most their number / l candidates to verify."""
    most = min(MOST_SHARED, len(df) - prefix + 1)
    cost = np.cumsum(df[: prefix + most - 1])[prefix - 1 :]
    return int(np.argmin(cost * (1 + VERIFY * len(df) / np.arange(1, most + 1)))) + 1


def _split(number: np.ndarray, grams: np.ndarray, df: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, n-grams, sides) of postings, those of n-grams that more than `split` sets hold in the cells of a triangle.

    A set is in all cells of its row and column; in a cell off the diagonal only sets of different sides meet.
    """
    parts = -(-df // split)
    many = np.flatnonzero(parts > 1)
    if not len(many):
        return np.arange(len(grams)), grams, np.zeros(len(grams), np.uint8)
    few, s = np.flatnonzero(parts <= 1), parts[many]
    own = np.repeat((flat.mix(number[many].astype(flat.U)) % s.astype(flat.U)).astype(np.int64), s)
    other, at, s = flat.runs(np.zeros(len(s), np.int64), s), np.repeat(many, s), np.repeat(s, s)
    cell = (np.minimum(own, other) * s + np.maximum(own, other)).astype(flat.U) + flat.U(1)
    side = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)
    return np.concatenate([few, at]), np.concatenate([grams[few], flat.mix(grams[at] + cell * flat.GRAM)]), np.concatenate([np.zeros(len(few), np.uint8), side])


def _kind(count: int) -> type:
    """The type of numbers below count."""
    return np.uint32 if count <= 1 << 32 else np.int64


def _posted(kind: type) -> tuple:
    """Names and types of what is sent for postings; kind: the type of the numbers of sets."""
    return (("grams", np.uint32), ("places", np.uint8), ("sides", np.uint8), ("counts", np.uint8), ("numbers", kind), ("grouped", np.bool_), ("groups", kind), ("sizes", np.uint16), ("ells", np.uint8))


#: Sizes of sets are sent as powers of this, rounded down.
STEP = 1.0005
#: Places in sets are sent as so many parts of the set, rounded down.
PLACES = 255


def _postings(n: int, threshold: float, keys: np.ndarray, times: np.ndarray, buckets: int, split: int, kind: type):
    """The prefixes of sets (text, number, group), packed by bucket: half of each n-gram's hash (what that confuses is told apart when verified), and its place in the set."""
    posted = _posted(kind)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        number, group, size, ell = (np.array([h[k] for h in held], np.int64) for k in range(4))
        lens, level = np.array([len(h[4]) for h in held]), np.floor(np.log(size) / math.log(STEP) + 1e-9)
        doc = np.repeat(np.arange(len(held)), lens)
        place = (PLACES * flat.runs(np.zeros(len(held), np.int64), lens) // size[doc]).astype(np.uint8)
        at, grams, side = _split(number[doc], np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held]), split)
        doc, place = doc[at], place[at]
        bucket = ((grams >> flat.U(32)) % flat.U(buckets)).astype(np.int64)
        order = np.argsort(bucket * len(held) + doc, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out: dict[str, list] = {k: [] for k in ("bucket", *(k for k, _ in posted))}
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[b] : cut[b + 1]]
            docs, counts = np.unique(doc[own], return_counts=True)
            times = -(-counts // 255)  # a set of more n-grams comes again
            docs, counts = np.repeat(docs, times), np.minimum(np.repeat(counts, times) - 255 * flat.runs(np.zeros(len(docs), np.int64), times), 255)
            told = group[docs] != number[docs]
            values = (grams[own] & flat.U(0xFFFFFFFF), place[own], side[own], counts, number[docs], told, group[docs][told], level[docs], ell[docs])
            out["bucket"].append(b)
            for (k, own_kind), v in zip(posted, values):
                out[k].append(v.astype(own_kind).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k != "bucket" else pa.int64()) for k, v in out.items()], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            numbers, groups = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for row, own in sets(*flat.buffers(batch.column(0)), n):
                grams, df = ordered(own, keys, times)
                prefix = len(own) - int(needed(len(own), threshold)) + 1
                end = prefix + MOST_SHARED - 1
                ell = chosen(df, prefix)
                held.append((numbers[row], groups[row], len(own), ell, grams[:end], df[:end]))
                total += len(held[-1][4])
                if total >= 1 << 20:
                    yield packed(held)
                    held, total = [], 0
        if held:
            yield packed(held)

    return flat.tidy(run)


def _across(run: np.ndarray, group: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within a run and of different groups, about `most` at a time. Both arrays are sorted, group within run."""
    ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run))
    inner = np.append(np.flatnonzero((run[1:] != run[:-1]) | (group[1:] != group[:-1])) + 1, len(run))
    place = np.arange(len(run))
    begin = inner[np.searchsorted(inner, place, "right")]
    n = ends[np.searchsorted(ends, place, "right")] - begin
    done = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(run):
        b = max(a + 1, int(np.searchsorted(done, done[a] + most, "right")) - 1)
        yield np.repeat(place[a:b], n[a:b]), flat.runs(begin[a:b], n[a:b])
        a = b


def _told(kind: type) -> tuple:
    return (("a", kind), ("b", kind), ("times", np.uint8), ("ells", np.uint8))


def _paired(threshold: float, counted: int, kind: type):
    """Pairs of a bucket with the n-grams that they share there, packed for the group that counts those of their first set."""
    schema = pa.schema([("part", pa.int64()), *((k, pa.binary()) for k, _ in _told(kind))])

    def run(table: pa.Table) -> pa.Table:
        parts = {k: np.concatenate([np.frombuffer(x.as_buffer(), own) for x in table.column(k)]) for k, own in _posted(kind)}
        numbers, which, back = np.unique(parts["numbers"], return_index=True, return_inverse=True)
        groups = parts["numbers"].copy()
        groups[parts["grouped"]] = parts["groups"]
        size, ell, group = STEP ** parts["sizes"][which], parts["ells"][which], groups[which]
        doc = np.repeat(back.astype(np.int32), parts["counts"])
        gram, place, side = parts["grams"], parts["places"], parts["sides"]
        parts.clear()
        order = np.argsort(gram, kind="stable")
        heads = np.flatnonzero(np.diff(gram[order], prepend=gram[order][:1] + np.uint32(1))) if len(order) else order
        lens = np.diff(np.append(heads, len(order)))
        own = group[doc[order]]
        several = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads) if len(heads) else np.zeros(0, bool)
        order, number = order[np.repeat(several, lens)], np.repeat(np.arange(several.sum()), lens[several])
        inner = np.lexsort((doc[order], group[doc[order]], number))
        order, number = order[inner], number[inner]
        again = np.zeros(len(order), bool)
        again[1:] = (number[1:] == number[:-1]) & (doc[order][1:] == doc[order][:-1])
        order, number = order[~again], number[~again]
        own, side = doc[order], side[order]
        left = STEP * size[own] * (1 - place[order] / PLACES)  # n-grams from this one on, at most
        del gram, place, doc, order, inner, again
        keys, counts, pending = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def fold() -> None:
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            counts[:] = [np.bincount(back, np.concatenate(counts), len(k)).astype(np.int64)]
            keys[:] = [k]

        for a, b in _across(number, group[own]):
            x, y = own[a], own[b]
            common = 0.9999 * threshold / (1 + threshold) * (size[x] + size[y])
            ok = (np.minimum(left[a], left[b]) + np.maximum(ell[x], ell[y]) - 1 >= common) & ((side[a] == 0) | (side[a] != side[b])) & (STEP * np.minimum(size[x], size[y]) >= 0.9999 * threshold * np.maximum(size[x], size[y]))
            keys.append(x[ok].astype(np.int64) << 32 | y[ok])
            counts.append(np.ones(int(ok.sum()), np.int64))
            pending += len(keys[-1])
            if pending > 1 << 20:
                fold()
                pending = 0
        fold()
        x, y = keys[0] >> 32, keys[0] & 0xFFFFFFFF
        told = np.minimum(numbers[x], numbers[y]), np.maximum(numbers[x], numbers[y]), np.minimum(counts[0], 255), np.maximum(ell[x], ell[y])
        part = (flat.mix(told[0].astype(flat.U)) % flat.U(counted)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        heads = np.flatnonzero(np.diff(part[order], prepend=-1))
        ends = np.append(heads[1:], len(order))
        columns = [[v[order[i:j]].astype(own).tobytes() for i, j in zip(heads.tolist(), ends.tolist())] for v, (_, own) in zip(told, _told(kind))]
        return pa.table([pa.array(part[order[heads]]), *(pa.array(c, pa.binary()) for c in columns)], schema=schema)

    return flat.tidy(run)


def _met(kind: type):
    """The pairs (x, y) of a group, by number, that share as many n-grams as the larger l of their two."""

    def run(table: pa.Table) -> pa.Table:
        a, b, times, ell = (np.concatenate([np.frombuffer(x.as_buffer(), own) for x in table.column(k)]) for k, own in _told(kind))
        order = np.lexsort((b, a))
        a, b, times, ell = a[order], b[order], times[order], ell[order]
        heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        own = heads[np.add.reduceat(times.astype(np.int64), heads) >= ell[heads]]
        return pa.table([pa.array(a[own].astype(np.int64)), pa.array(b[own].astype(np.int64))], names=["x", "y"])

    return flat.tidy(run)


def _verified(n: int, threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        column = texts.column("text").cast(pa.large_string()).combine_chunks()
        of = {row: own for row, own in sets(*flat.buffers(column), n)}
        sids = texts.column("sid").to_numpy()
        by, first = np.unique(sids, return_index=True)
        own = [of[r] for r in first.tolist()]
        size = np.array([len(x) for x in own], np.int64)
        _, dense = np.unique(np.concatenate([np.zeros(0, flat.U), *own]), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(size)])
        a, b = (np.searchsorted(by, pairs.column(k).to_numpy()) for k in ("a", "b"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        mark = np.zeros(len(dense) + 1, bool)
        overlap = np.zeros(len(a), np.int64)
        cut = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            mine = dense[at[a[i]] : at[a[i] + 1]]
            mark[mine] = True
            for k in range(i, j, 4096):
                theirs = b[k : min(j, k + 4096)]
                hit = mark[dense[flat.runs(at[theirs], size[theirs])]]
                overlap[k : k + len(theirs)] = np.add.reduceat(hit, np.cumsum(size[theirs]) - size[theirs], dtype=np.int64)
            mark[mine] = False
        union = size[a] + size[b] - overlap
        ok = overlap >= needed(union, threshold)
        return pa.table([pa.array(by[a[ok]]), pa.array(by[b[ok]])], schema=schema)

    return flat.tidy(run)


def overlaps(grams: list[np.ndarray], most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, n-grams that some rows share with every row), about `most` numbers at a time.

    n-grams in an eighth of the sets are multiplied as a matrix, of eight times as many numbers as there are n-grams at most; the others
    are counted along their lists.
    """
    m, size = len(grams), np.array([len(x) for x in grams])
    _, ids, df = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    dense = (df > 1) & (df * 8 >= m)
    column = np.cumsum(dense) - 1
    matrix = np.zeros((m, int(dense.sum())), np.float32)
    matrix[row[dense[ids]], column[ids[dense[ids]]]] = 1
    rest = np.flatnonzero((df[ids] > 1) & ~dense[ids])
    row, ids = row[rest], ids[rest]
    lists = row[np.argsort(ids, kind="stable")]
    n = np.bincount(ids, minlength=len(df))
    begin = np.cumsum(n) - n
    step = max(1, most // m)
    for a in range(0, m, step):
        b = min(m, a + step)
        out = (matrix[a:b] @ matrix.T).astype(np.int64).ravel()
        i, j = np.searchsorted(row, [a, b])
        done = np.concatenate([[0], np.cumsum(n[ids[i:j]])])
        while i < j:  # the lists of some n-grams of these rows
            k = max(i + 1, int(np.searchsorted(done, done[0] + most, "right")) - 1 + i)
            own = ids[i:k]
            out += np.bincount(np.repeat(row[i:k] - a, n[own]) * m + lists[flat.runs(begin[own], n[own])], minlength=len(out))
            done, i = done[k - i :], k
        yield a, out.reshape(b - a, m)


def _linked(n: int, threshold: float, told: bool):
    """(sid, links) of the sets of each group and cell that similar ones link, or the pairs (a, b, jaccard) if they are to be told."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())] if told else [("sid", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        column = table.column("text").cast(pa.large_string()).combine_chunks()
        of = {row: own for row, own in sets(*flat.buffers(column), n)}
        sid, side = table.column("sid").to_numpy(), table.column("side").to_numpy()
        _, cell = np.unique(np.stack([table.column("root").to_numpy(), table.column("cell").to_numpy()]), axis=1, return_inverse=True)
        order = np.argsort(cell.ravel(), kind="stable")
        out = [pa.table([pa.array([], f.type) for f in schema], schema=schema)]
        for rows in np.split(order, np.flatnonzero(np.diff(cell.ravel()[order])) + 1):
            _, first = np.unique(sid[rows], return_index=True)
            rows = rows[first]
            grams = [of[r] for r in rows.tolist()]
            size = np.array([len(x) for x in grams])
            links = np.zeros(len(rows), np.int64)
            for a, shared in overlaps(grams):
                i = np.arange(a, a + len(shared))
                union = size[i, None] + size - shared
                ok = shared >= needed(union, threshold)
                ok &= (side[rows[i], None] == 0) | (side[rows[i], None] != side[rows])
                ok[i - a, i] = False
                links[i] = ok.sum(1)
                if told:
                    x, y = np.nonzero(ok)
                    x, y, alike = x[i[x] < y], y[i[x] < y], (shared / union)[ok][i[x] < y]
                    both = np.sort(np.stack([sid[rows[i[x]]], sid[rows[y]]]), axis=0)
                    out.append(pa.table([pa.array(both[0]), pa.array(both[1]), pa.array(np.round(alike, 6))], schema=schema))
            if not told:
                out.append(pa.table([pa.array(sid[rows][links > 0]), pa.array(links[links > 0])], schema=schema))
        return pa.concat_tables(out)

    return flat.tidy(run)


class Join:
    """The join of documents with themselves, as tables in the shared folder, where a copy of docs lies in buckets of (id, mark).

    signed: (doc_id, mark, sid, size, first), the set of each document with a word; mark is the hash of its text.
    kept: (sid, doc_id, mark, n, size, first, row), the least document of each set, and how many have it; row is its partition and its place there.
    groups: (sid, root) of the sets that similar pairs connect with a lesser one; root is the least of them.
    """

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, split: int = SPLIT, together: int = TOGETHER):
        frugal(docs.sparkSession)
        self.n, self.threshold, self.together = n, threshold, together
        self.id, self.mark = unused(docs, "id"), unused(docs, "mark")
        self.held = bucketed(docs.withColumns({self.id: F.col("doc_id").cast("long"), self.mark: F.xxhash64("text")}), [self.id, self.mark], "documents")
        rows = self.held.where(F.col(self.id).isNotNull() & F.col("text").isNotNull()).select(F.col(self.id).alias("doc_id"), F.col(self.mark).alias("mark"), "text")
        self.rows = rows
        self.signed = written(rows.mapInArrow(_signed(n), "doc_id long, mark long, sid long, size long, first array<long>").dropDuplicates(["doc_id", "mark"]), "signed")
        one = self.signed.groupBy("sid").agg(F.min(F.struct("doc_id", "mark")).alias("kept"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("first").alias("first"))
        self.kept = written(one.select("sid", "kept.*", "n", "size", "first").withColumn("row", F.monotonically_increasing_id()), "kept")
        place = F.col("row").bitwiseAND((1 << 33) - 1)
        total = self.kept.agg(F.count("*").alias("sets"), F.sum("size").alias("grams"), F.coalesce(F.max(F.shiftright("row", 33)) + 1, F.lit(1)).alias("parts"), F.max(place).alias("place")).first()
        # sets are numbered, so that most tables need 4 bytes to name one
        kind = _kind(((total["place"] or 0) + 1) * total["parts"])
        numbers = self.kept.select("sid", "doc_id", "mark", (place * total["parts"] + F.shiftright("row", 33)).alias("number"))
        near = self._similar(written(self._least(), "near"))
        groups = components(near).join(numbers.select(F.col("sid").alias("root"), F.col("number").alias("group")), "root").select("sid", "group")
        labels = numbers.join(groups, "sid", "left").select("doc_id", "mark", "number", F.coalesce("group", "number").alias("group"))
        keys, times = self._frequent(total["sets"])
        buckets = max(1, math.ceil((total["grams"] or 0) * (1 - threshold) / BUCKET))
        posted = self._with(labels, "text", "number", "group").mapInArrow(_postings(n, threshold, keys, times, buckets, split, kind), ", ".join(["bucket long", *(f"{k} binary" for k, _ in _posted(kind))]))
        told = posted.groupBy("bucket").applyInArrow(_paired(threshold, COUNTS * buckets, kind), ", ".join(["part long", *(f"{k} binary" for k, _ in _told(kind))]))
        met = written(told.groupBy("part").applyInArrow(_met(kind), "x long, y long"), "numbered")
        for end, side in (("x", "a"), ("y", "b")):
            met = met.join(numbers.select(F.col("number").alias(end), F.col("sid").alias(side)), end)
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        self.groups = components(near.unionAll(self._similar(written(met, "met"))))

    def _with(self, keys: DataFrame, *columns: str) -> DataFrame:
        """Columns of the documents whose (doc_id, mark) keys has, once for each of its rows. Only the keys are shuffled."""
        return self.rows.join(keys.hint("shuffle_hash"), ["doc_id", "mark"]).select(*columns)

    def _least(self) -> DataFrame:
        """(a, b): each set b with the least a that has MET of its first n-grams, for which it is the least."""
        each = self.kept.select("sid", F.explode("first").alias("gram"))
        low = each.groupBy("gram").agg(F.min("sid").alias("a"), F.count("*").alias("n")).where("n > 1").select("gram", "a")
        return each.join(low, "gram").where("sid <> a").groupBy("a", F.col("sid").alias("b")).count().where(F.col("count") >= MET).select("a", "b")

    def _similar(self, met: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar. The sets around the same a are compared together, in cells if they are many."""
        size = self.kept.select("sid", "size")
        weights = written(met.join(size.withColumnRenamed("sid", "b"), "b").groupBy("a").agg(F.sum("size").alias("weight")), "weights")
        many = max(1, math.ceil((weights.agg(F.sum("weight")).first()[0] or 0) / self.together))
        cell = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(2 * F.col("weight") / self.together)))
        keyed = written(met.join(weights, "a").select("a", "b", F.when(F.col("weight") > self.together, cell).otherwise(F.pmod(F.xxhash64("a"), F.lit(many))).alias("part")), "parts")
        sides = keyed.select("part", F.col("a").alias("sid")).unionAll(keyed.select("part", F.col("b").alias("sid"))).distinct()
        texts = self._with(written(sides.join(self.kept.select("sid", "doc_id", "mark"), "sid"), "places"), "part", "sid", "text")
        return written(texts.groupBy("part").cogroup(keyed.groupBy("part")).applyInArrow(_verified(self.n, self.threshold), "a long, b long"), "similar")

    def _frequent(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The frequent n-grams and in how many sets each is, as far as blocks of sets show it: it only orders, and estimates cost.

        Only those counted in the least number of sets or more are fetched: no more than RARE times the mean size of a set, 16 bytes each.
        """
        least = max(LEAST_FREQUENT, math.ceil(count / RARE))
        if count < least:
            return np.zeros(0, flat.U), np.zeros(0, np.int64)
        likely = self._with(self.kept.select("doc_id", "mark"), "text").mapInArrow(_likely(self.n, least / count), "gram long, times long")
        table = likely.groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= least).toArrow()
        keys, times = table.column("gram").to_numpy().view(flat.U), table.column("times").to_numpy()
        order = np.argsort(keys)
        return keys[order], times[order]

    def links(self, told: bool = False) -> DataFrame:
        """(sid, links): how many sets each set is similar to, for those that are to any; or the pairs (a, b, jaccard), a < b."""
        members = self.groups.unionAll(self.groups.select(F.col("root").alias("sid"), "root").distinct())
        sets_ = members.join(self.kept.select("sid", "doc_id", "mark", "size"), "sid")
        weights = written(sets_.groupBy("root").agg(F.sum("size").alias("weight")), "group-weights")
        many = max(1, math.ceil((weights.agg(F.sum("weight")).first()[0] or 0) / self.together))
        # a large group is cut in pieces, and each two of them meet in a cell
        pieces = F.when(F.col("weight") > self.together, F.ceil(2 * F.col("weight") / self.together)).otherwise(1).cast("long")
        cut = sets_.join(weights, "root").withColumn("c", pieces).withColumn("p", F.pmod(F.xxhash64("sid"), F.col("c"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
        cell = F.least("p", "q") * F.col("c") + F.greatest("p", "q")
        side = F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2)
        placed = cut.select("doc_id", "mark", "sid", "root", cell.alias("cell"), side.alias("side"), F.when(F.col("c") > 1, F.xxhash64("root", cell)).otherwise(F.pmod(F.xxhash64("root"), F.lit(many))).alias("part"))
        found = self._with(placed, "part", "sid", "root", "cell", "side", "text").groupBy("part").applyInArrow(_linked(self.n, self.threshold, told), "a long, b long, jaccard double" if told else "sid long, links long")
        return written(found if told else found.groupBy("sid").agg(F.sum("links").alias("links")), "links")


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, split: int = SPLIT, together: int = TOGETHER) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of each document that has a copy or a link.

    copy_of: the least id of the documents with the same set of n-grams, its own if there are no copies. n_links: how many different
    sets are similar to the document's own. class_id: the least id of all documents that copies and links connect with it. A document
    alone in its class has no row, as has one without a word; one of fewer than n words is the one n-gram of them all. Rows with a null
    id or text are left out, rows that are the same document again count once, rows that share an id with different texts have a row
    each. Other columns are not read.
    """
    join = Join(docs.select("doc_id", "text"), n, threshold, split, together)
    sets_ = join.kept.select("sid", F.col("doc_id").alias("copy_of"), "n").join(join.groups, "sid", "left").join(join.links(), "sid", "left")
    sets_ = sets_.select("sid", "copy_of", "n", F.coalesce("root", "sid").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    classes = sets_.groupBy("root").agg(F.min("copy_of").alias("class_id"), F.sum("n").alias("all")).where(F.col("all") > 1).select("root", "class_id")
    return join.signed.select("doc_id", "sid").join(sets_.join(classes, "root"), "sid").select("doc_id", "class_id", "copy_of", "n_links")


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, split: int = SPLIT, together: int = TOGETHER) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all similar pairs of different sets, each named by the least id that has it.

    Which documents copy these, links() tells. Rows that share an id are not paired with each other.
    """
    join = Join(docs.select("doc_id", "text"), n, threshold, split, together)
    of = lambda side: join.kept.select(F.col("sid").alias(side), F.col("doc_id").alias(f"doc_{side}"))
    out = join.links(told=True).join(of("a"), "a").join(of("b"), "b").where("doc_a <> doc_b")
    return out.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(sid, root) of each node of the edges (a, b) that is not the least of its component; root is the least. Alternating large and small stars."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = None
    while True:
        for large in (True, False):
            pairs_ = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            least = pairs_.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            starred = pairs_.join(least, "u")
            if large:
                edges = starred.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                edges = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
            edges = edges.where("u <> v").distinct()
        edges = written(edges, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("sid"), F.col("v").alias("root"))
        state = now


def deduped(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, split: int = SPLIT, together: int = TOGETHER) -> DataFrame:
    """The documents, all columns, less all but one of each group that similar pairs connect: the one of least id stays.

    Documents without id, text or word stay. Of rows that repeat an id with the same text one stays.
    """
    join = Join(docs, n, threshold, split, together)
    signed = join.signed.join(join.groups, "sid", "left").select("doc_id", "mark", F.coalesce("root", "sid").alias("root"))
    first = signed.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = signed.join(first, "root").where("doc_id <> first.doc_id or mark <> first.mark")
    key = [join.id, join.mark]
    out = join.held.join(written(gone.select(F.col("doc_id").alias(join.id), F.col("mark").alias(join.mark)), "gone"), key, "left_anti")
    real = F.col(join.id).isNotNull() & F.col("text").isNotNull()
    twice = written(join.held.where(real).groupBy(*key).count().where("count > 1").select(*key), "twice")
    if twice.limit(1).count():
        out = out.join(twice, key, "left_anti").unionByName(out.join(twice, key, "left_semi").dropDuplicates(key))
    return out.select(*docs.columns)
