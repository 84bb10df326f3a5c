"""The best chunks of all queries in one pass over the chunks: queries are sent to the chunks, and of each task only the k best hits of a query travel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores of queries and chunks that a task holds at once, products of terms it adds up at once, and tokens it counts at once.
CELLS, PRODUCTS, TOKENS = 4 << 20, 2 << 20, 1 << 20


class Best:
    """The k best hits of each query so far, by falling score, rounded to `digits`, and rising id. Scores that are no number don't count."""

    def __init__(self, n: int, k: int, digits: int | None):
        self.k, self.digits, self.held, self.size = k, digits, [], 0
        #: The k-th score of each query, from which on a hit counts.
        self.least = np.full(n, -np.inf)
        self.most = max(4 * n * k, 1 << 16)

    def low(self, q: np.ndarray) -> np.ndarray:
        """What a score must have before it is rounded."""
        return self.least[q] - (0 if self.digits is None else 10.0**-self.digits)

    def add(self, q: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        told = score if self.digits is None else np.round(score, self.digits)
        good = np.flatnonzero((told >= self.least[q]) & (told > -np.inf))
        if len(good):
            self.held.append((q[good], score[good], told[good], ids.take(pa.array(good))))
            self.size += len(good)
        if self.size > self.most:
            self.cut()

    def cut(self) -> None:
        if not self.held:
            return
        q, score, told = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        ids = pa.concat_arrays([h[3] for h in self.held])
        order = np.lexsort((pc.rank(ids, "ascending", tiebreaker="dense").to_numpy(), -told, q))
        own = q[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        last = order[place == self.k - 1]
        self.least[q[last]] = told[last]
        order = order[place < self.k]
        self.held, self.size = [(q[order], score[order], told[order], ids.take(pa.array(order)))], len(order)

    def rows(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        self.cut()
        for q, score, _, ids in self.held:
            for a in range(0, len(q), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q[b])), ids[b], pa.array(score[b])], ["query_id", "chunk_id", "score"])


class Filters:
    """Which rows of a column of maps have all keys and values wanted, compared as matches_map() does."""

    def __init__(self, metadata: pa.MapArray):
        at = metadata.offsets.to_numpy()
        self.n, self.seen = len(metadata), {}
        self.row = np.repeat(np.arange(self.n), np.diff(at))
        self.keys, self.items = metadata.keys[at[0] : at[-1]], metadata.items[at[0] : at[-1]]

    def rows(self, wanted: dict) -> np.ndarray:
        """A mask."""
        out = np.ones(self.n, bool)
        for pair in wanted.items():
            if pair not in self.seen:
                same = pc.and_(pc.equal(self.keys, pair[0]), pc.equal(self.items, pa.scalar(pair[1], self.items.type)))
                self.seen[pair] = np.zeros(self.n, bool)
                self.seen[pair][self.row[pc.fill_null(same, False).to_numpy(zero_copy_only=False)]] = True
            out &= self.seen[pair]
        return out


def numbered(filters: list) -> tuple[np.ndarray, list[dict]]:
    """The number of each filter, and those that differ."""
    wanted, at = [], {}
    for f in filters:
        key = frozenset(dict(f or {}).items())
        if key not in at:
            at[key] = len(wanted)
            wanted.append(dict(key))
    return np.array([at[frozenset(dict(f or {}).items())] for f in filters], np.int64), wanted


def counts(terms: list[str], words: list[str] | None):
    """Of batches (chunk_id, tokens, more): (chunk_id, i, tf, len, more), i and tf being lists, of the terms among the tokens.

    With words the last column is a text, in place of which comes a list of the words, by number, that it has anywhere.
    """
    automaton = None
    if words:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, i)
        automaton.make_automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = None
        for batch in batches:
            told = pc.list_value_length(batch.column(1))
            size = pc.fill_null(told, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in cuts(size, TOKENS):
                part, own = batch.slice(a, b - a), size[a:b]
                flat = part.column(1).flatten().dictionary_encode()
                values = values if values is not None else pa.array(terms, flat.type.value_type)
                code = pc.fill_null(pc.index_in(flat.dictionary, value_set=values), -1).to_numpy(zero_copy_only=False)
                code = code[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b - a), own)[code >= 0]
                key, tf = np.unique(row * max(len(terms), 1) + code[code >= 0], return_counts=True)
                row, i = key // max(len(terms), 1), key % max(len(terms), 1)
                at = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=b - a))).astype(np.int32))
                rest = [part.column(c) for c in range(2, part.num_columns)]
                if words is not None:
                    found = [sorted({i for _, i in automaton.iter(t)}) if t and automaton else [] for t in rest[-1].to_pylist()]
                    rest[-1] = pa.array(found, pa.list_(pa.int32()))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (i, tf)]
                names = ["chunk_id", "i", "tf", "len", *part.schema.names[2:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, told[a:b].cast(pa.int32()), *rest], names)

    return run


def cuts(size: np.ndarray, most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to `most` or that are one row, of no more rows than `rows`."""
    end, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + most, "right")))
        b = min(b, len(size), a + rows if rows else len(size))
        yield a, b
        a = b


def statistics(n_terms: int):
    """Of what counts() gives: (i, n), the number of rows that have term i; of i = -1 all rows, of i = -2 their tokens, of i = -3 those without a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size, none = np.zeros(n_terms, np.int64), 0, 0, 0
        for batch in batches:
            df += np.bincount(batch.column("i").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
            n, size, none = n + batch.num_rows, size + (pc.sum(pc.cast(batch.column("len"), pa.int64())).as_py() or 0), none + batch.column("len").null_count
        i = np.append(np.flatnonzero(df), [-1, -2, -3])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.append(df[i[:-3]], [n, size, none]))], ["i", "n"])

    return run


@dataclass
class Asked:
    """Queries by the terms they have: those of term i, with a weight each, are at start[i] to start[i + 1]."""

    ids: pa.Array
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> Asked:
        order = np.lexsort((query, term))
        return cls(ids, np.append(0, np.cumsum(np.bincount(term, minlength=n_terms))), query[order], weight[order])

    def met(self, row: np.ndarray, i: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell (query * rows + row), the entry and the weight of each query that has the term i of a row."""
        n = self.start[i + 1] - self.start[i]
        entry = np.repeat(np.arange(len(i)), n)
        at = np.arange(len(entry)) + np.repeat(self.start[i] - (np.cumsum(n) - n), n)
        return self.query[at] * rows + row[entry], entry, self.weight[at]

    def products(self, i: pa.ListArray) -> np.ndarray:
        """How many queries each row meets, by all its terms."""
        flat, at = i.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(i).to_numpy(zero_copy_only=False)))
        return np.diff(np.append(0, np.cumsum(self.start[flat + 1] - self.start[flat]))[at])


@dataclass
class Bm25:
    """What tells scores: idf of each term, avgdl, the parameters, and of each query how many terms it needs (none: any)."""

    idf: np.ndarray
    avgdl: float
    k1: float
    b: float
    need: np.ndarray | None = None
    phrases: Asked | None = None
    boost: float = 0.0
    #: The number of each query's filter, and the filters.
    own: np.ndarray | None = None
    filters: list[dict] = field(default_factory=list)

    def weights(self, i: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf[i] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * (size / self.avgdl)))


def bm25(asked: Asked, how: Bm25, k: int, digits: int | None):
    """(query_id, chunk_id, score): the k best chunks of a task for each query, of batches (chunk_id, i, tf, len, found, metadata); len may be one number or one of each term."""
    n = len(asked.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n, k, digits)
        for batch in batches:
            lists = batch.column("i")
            for a, b in cuts(asked.products(lists), PRODUCTS, max(1, CELLS // max(n, 1))):
                part = batch.slice(a, b - a)
                held = pc.list_value_length(part.column("i")).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b - a), held)
                i, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "tf"))
                size = part.column("len")
                size = size.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(size.type) else np.repeat(size.to_numpy(zero_copy_only=False), held)
                cell, entry, weight = asked.met(row, i, b - a)
                if not len(cell):
                    continue
                score = np.bincount(cell, how.weights(i, tf, size)[entry] * weight, n * (b - a))
                if how.need is not None:
                    score[np.bincount(cell, weight, n * (b - a)) != np.repeat(how.need, b - a)] = 0
                if how.phrases is not None:
                    found = part.column("found")
                    found_row = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
                    at, _, words = how.phrases.met(found_row, found.flatten().to_numpy(zero_copy_only=False), b - a)
                    score *= 1 + np.bincount(at, words, n * (b - a)) * how.boost
                score = score.reshape(n, b - a)
                if how.own is not None:
                    held_by = Filters(part.column("metadata"))
                    score[~np.array([held_by.rows(f) for f in how.filters])[how.own]] = 0
                q, r = np.nonzero((score > 0) & (score >= best.low(slice(None))[:, None]))
                best.add(q, score[q, r], part.column("chunk_id").take(pa.array(r)))
        yield from best.rows(asked.ids)

    return run


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1))
    return rows / np.where(norm == 0, 1, norm)[:, None]


def nearest(ids: pa.Array, vectors: list[list[float]], k: int, digits: int | None, filters: list | None = None):
    """(query_id, chunk_id, score): the k nearest chunks of a task for each query by cosine, of batches (chunk_id, vector, metadata).

    Queries of one length and filter are multiplied by the rows of one length, both cut to the shorter one, in tiles of CELLS scores.
    """
    own, wanted = numbered(filters or [None] * len(vectors))
    size = np.array([len(v) for v in vectors], np.int64)
    groups = []
    for n in np.unique(size):
        for f in np.unique(own[size == n]):
            q = np.flatnonzero((size == n) & (own == f))
            groups.append((q, np.array([vectors[i] for i in q], np.float64).reshape(len(q), n), wanted[f]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(vectors), k, digits)
        units = {}
        for batch in batches:
            length = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            held = Filters(batch.column("metadata")) if filters else None
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                part = batch.take(pa.array(at)) if len(at) < len(length) else batch
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n).astype(np.float64)
                for g, (q, matrix, f) in enumerate(groups):
                    m = min(n, matrix.shape[1])
                    if (g, m) not in units:
                        units[g, m] = _unit(matrix[:, :m])
                    kept = np.flatnonzero(held.rows(f)[at]) if f else np.arange(len(at))
                    step = max(1, CELLS // len(q))
                    for a in range(0, len(kept), step):
                        r = kept[a : a + step]
                        score = units[g, m] @ _unit(rows[r, :m]).T
                        score[np.isnan(score)] = -np.inf
                        low = best.low(q)
                        new = np.flatnonzero(low == -np.inf)
                        if len(new) and len(r) > k:
                            # before k are known, only what is among the best of the tile
                            low[new] = np.partition(score[new], len(r) - k, axis=1)[:, len(r) - k] - (0 if digits is None else 10.0**-digits)
                        i, j = np.nonzero(score >= low[:, None])
                        best.add(q[i], score[i, j], part.column(0).take(pa.array(r[j])))
        yield from best.rows(ids)

    return run
