"""SentencePiece encoding and decoding of whole columns with numpy, for BPE models.

Texts are cut where no piece can reach across; each distinct part of a batch is encoded once. Its characters are symbols of
one flat array. In each round every part merges the leftmost of its best-ranked adjacent pairs (all of them at once where no pair that
this makes could come first), the array is compacted, and a part in which no pair is a piece leaves with its symbols.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .shared import frugal

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.int64(1 << 40)
BATCH = 2 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        else:
            size, i = number(i) if kind == 2 else (4 if kind == 5 else 8, i)
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


class Model:
    """A BPE model file, read as far as encoding and decoding need it.

    Refused with ValueError: models that are not BPE, that rewrite characters or white space, put spaces behind words, or have
    user-defined or unused pieces.
    """

    def __init__(self, raw: bytes):
        pieces, kinds, score = [], [], []
        self.dummy = True
        trainer, rewrites = {}, False
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
                self.dummy = bool(norm.get(3, 1))
                rewrites = bool(norm.get(2)) or bool(norm.get(4, 1)) or not norm.get(5, 1)
        if trainer.get(3, 1) != 2 or rewrites or trainer.get(24, 0) or {USER, UNUSED} & set(kinds):
            raise ValueError("only BPE models without normalization, user-defined and unused pieces are supported")
        self.pieces, self.kinds = pieces, kinds
        self.unknown = kinds.index(UNKNOWN)
        self.n = len(pieces)
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.bytes = np.full(256, self.unknown, np.int64)
        for i, p in enumerate(pieces):
            if kinds[i] == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.fallback = BYTE in kinds
        # characters: id of the piece, or a number from self.n on where pieces hold it but it is none
        self.char = np.full(0x110000, -1, np.int64)
        inner, self.extra = set(), []
        for p in ids:
            if len(p) > 1:
                inner.update(p)
        for c in sorted(inner | {p for p in ids if len(p) == 1}):
            if c not in ids:
                self.extra.append(c)
            self.char[ord(c)] = ids.get(c, self.n + len(self.extra) - 1)
        number = dict(ids) | {c: self.n + k for k, c in enumerate(self.extra)}
        rank = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: (-score[i], i)))}
        keys, into = [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    keys.append(number[p[:k]] << 32 | number[p[k:]])
                    into.append(rank[i] << 32 | i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.into = np.array(keys, np.int64)[order], np.array(into, np.int64)[order]
        bits = 22
        self.shift = flat.U(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[self._slot(self.keys)] = True
        self.across = any("▁" in p.lstrip("▁") for p in ids)
        alone = np.array([128 > b and chr(b) not in inner and b != 32 for b in range(256)])
        self.alone = alone
        texts = [b"" if k in (CONTROL,) else (" ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace("▁", " ").encode()) for p, k in zip(pieces, kinds)]
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.silent = np.array([k == CONTROL for k in kinds])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(flat.U) * flat.BASE) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and id of the piece that each two symbols make, as rank << 32 | id; NONE where they make none."""
        keys = left << np.int64(32) | right
        out = np.full(len(keys), NONE << np.int64(20))
        at = np.flatnonzero(self.sieve[self._slot(keys)] & (left >= 0) & (right >= 0))
        near = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1) if len(self.keys) else at[:0]
        at, near = (at, near) if len(self.keys) else (at[:0], near)
        same = self.keys[near] == keys[at]
        out[at[same]] = self.into[near[same]]
        return out

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sizes) of parts after all merges. Parts are symbols one after another, none of them empty."""
        parts = len(sizes)
        done_symbols, done_at, left = [], [], np.arange(parts)
        out_sizes = np.zeros(parts, np.int64)
        none = NONE << np.int64(20)
        heads = np.cumsum(sizes) - sizes
        rank = np.full(len(symbols), none)
        if len(symbols) > 1:
            rank[:-1] = self.pair(symbols[:-1], symbols[1:])
        rank[heads + sizes - 1] = none
        while len(left):
            best = np.minimum.reduceat(rank, heads)
            idle = best == none
            if idle.any():
                gone = np.repeat(idle, sizes)
                done_symbols.append(symbols[gone])
                done_at.append(left[idle])
                out_sizes[left[idle]] = sizes[idle]
                symbols, rank = symbols[~gone], rank[~gone]
                left, sizes, best = left[~idle], sizes[~idle], best[~idle]
                if not len(left):
                    break
                heads = np.cumsum(sizes) - sizes
            part = np.repeat(np.arange(len(left)), sizes)
            hit = np.flatnonzero(rank == best[part])
            of = part[hit]
            first = np.ones(len(hit), bool)
            first[1:] = of[1:] != of[:-1]
            if not first.all():
                hit = hit[self._free(hit, of, first)]
                of = part[hit]
                first = np.ones(len(hit), bool)
                first[1:] = of[1:] != of[:-1]
                if not first.all():
                    hit = hit[first | ~self._early(symbols, rank, hit, of, best)[of]]
                    of = part[hit]
            made = best[of] & np.int64(0xFFFFFFFF)
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols[hit] = made
            symbols, rank = symbols[keep], rank[keep]
            sizes = sizes - np.bincount(of, minlength=len(left))
            heads = np.cumsum(sizes) - sizes
            now = hit - np.arange(len(hit))
            ends = heads + sizes - 1
            for at in (now, now[now > heads[of]] - 1):
                inner = at[at < ends[np.searchsorted(heads, at, "right") - 1]]
                rank[inner] = self.pair(symbols[inner], symbols[inner + 1])
            last = now[now == ends[of]]
            rank[last] = none
        if not done_at:
            return symbols, sizes
        order = np.concatenate(done_at)
        flat_symbols = np.concatenate(done_symbols)
        own = out_sizes[order]
        starts = np.empty(parts, np.int64)
        starts[order] = np.cumsum(own) - own
        return flat_symbols[flat.runs(starts, out_sizes)], out_sizes

    @staticmethod
    def _free(hit: np.ndarray, of: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of equal pairs that overlap, as in aaa, every second from the left."""
        chain = first.copy()
        chain[1:] |= hit[1:] != hit[:-1] + 1
        begin = np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))
        return (np.arange(len(hit)) - begin) % 2 == 0

    def _early(self, symbols: np.ndarray, rank: np.ndarray, hit: np.ndarray, of: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Parts in which a pair that these merges make could come before the pair merged; there, one merge at a time is made."""
        made = best[of] & np.int64(0xFFFFFFFF)
        early = np.zeros(len(best), bool)
        tests = [(made, made)]
        before, after = hit > 0, hit + 2 < len(symbols)
        tests.append((symbols[hit - 1 * before], made))
        tests.append((made, symbols[np.where(after, hit + 2, 0)]))
        for a, b in tests:
            early[of[self.pair(a, b) <= best[of]]] = True
        return early

    def cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of the parts: before a run of spaces, and around a character that is in no longer piece."""
        first = np.zeros(len(data), bool)
        if len(data):
            space, alone = data == 32, self.alone[data]
            if not self.across:
                first[1:] = space[1:] & ~space[:-1]
            first[1:] |= alone[1:] | alone[:-1]
            first[offs[:-1][offs[:-1] < len(data)]] = True
        return np.flatnonzero(first)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the pieces of each text; a null has none."""
        column = pc.replace_substring(column, "▁", " ")
        if self.dummy:
            some = pc.greater(pc.binary_length(column), 0)
            column = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)), column)
        data, offs = flat.buffers(column)
        ids, sizes = [], []
        for _, _, part, at in flat.slices(data, offs, BATCH):
            a, b = self._encode(part, at)
            ids.append(a)
            sizes.append(b)
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.cuts(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        h = flat.hashes(data, starts, ends, flat.SAME)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        size = ends - starts
        like = first[which]
        if (size != size[like]).any() or (data[flat.runs(starts, size)] != data[flat.runs(starts[like], size)]).any():
            _, first, which = np.unique([data[a:b].tobytes() for a, b in zip(starts, ends)], return_index=True, return_inverse=True)
        own, own_offs = flat.gather(data, starts[first], size[first])
        lead = (own & 0xC0) != 0x80
        points = np.frombuffer(flat.strings(own, np.array([0, len(own)]), pa.large_string())[0].as_py().encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 32] = 0x2581
        chars = np.diff(np.concatenate([[0], np.cumsum(lead)])[own_offs])
        known = self.char[points]
        symbols, sizes = self.merged(np.where(known >= 0, known, -1 - points), chars)
        ids, sizes = self._final(symbols, sizes)
        heads = np.cumsum(sizes) - sizes
        out = ids[flat.runs(heads[which], sizes[which])].astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(sizes[which])])
        return out, np.diff(upto[np.searchsorted(starts, offs)])

    def _final(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the pieces of their bytes, or the unknown piece (one for a run of them)."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.n))
        if not len(odd):
            return symbols, sizes
        part = np.repeat(np.arange(len(sizes)), sizes)
        points = [(-1 - s) if s < 0 else ord(self.extra[s - self.n]) for s in symbols[odd].tolist()]
        if not self.fallback:
            symbols = symbols.copy()
            symbols[odd] = self.unknown
            keep = np.ones(len(symbols), bool)
            keep[1:] = ~((symbols[1:] == self.unknown) & (symbols[:-1] == self.unknown) & (part[1:] == part[:-1]))
            return symbols[keep], np.bincount(part[keep], minlength=len(sizes))
        raw = [chr(p).encode() for p in points]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(x) for x in raw]
        out = np.repeat(symbols, times)
        heads = (np.cumsum(times) - times)[odd]
        out[flat.runs(heads, times[odd])] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(part, times, len(sizes)).astype(np.int64)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """The texts of rows of ids. Bytes that are no UTF-8 become U+FFFD; an id outside the model is an IndexError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise IndexError("id outside the model")
        data, starts, rows = [], [0], len(offs) - 1
        row = 0
        while row < rows:
            end = max(row + 1, int(np.searchsorted(offs, offs[row] + (1 << 20), "right")) - 1)
            own = ids[offs[row] : offs[end]]
            part, at = flat.gather(self.data, self.starts[own], self.sizes[own])
            cut = at[offs[row : end + 1] - offs[row]]
            if self.dummy and len(part):
                # the first space of a text, where its first piece that says anything begins with one, is the dummy
                drop = cut[:-1][(cut[:-1] < cut[1:])]
                first = np.zeros(len(own), bool)
                loud = np.flatnonzero(~self.silent[own])
                heads = loud[np.minimum(np.searchsorted(loud, (offs[row:end] - offs[row])), len(loud) - 1)] if len(loud) else np.zeros(0, np.int64)
                first[heads] = True
                spaced = np.array([k == NORMAL for k in self.kinds])
                ok = part[drop] == 32
                drop = drop[ok & spaced[own[np.searchsorted(at, drop, "right") - 1]]]
                keep = np.ones(len(part), bool)
                keep[drop] = False
                cut = np.concatenate([[0], np.cumsum(keep)])[cut]
                part = part[keep]
            data.append(part)
            starts.extend((cut[1:] + starts[-1]).tolist())
            row = end
        whole = np.concatenate([np.zeros(0, np.uint8), *data])
        at = np.array(starts, np.int64)
        try:
            whole.tobytes().decode()
            return flat.strings(whole, at, pa.large_string())
        except UnicodeDecodeError:
            return pa.array([whole[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.large_string())


_models: dict[bytes, Model] = {}


def model(raw: bytes) -> Model:
    """The model of a file's content, made once in a process."""
    if raw not in _models:
        _models.clear()
        _models[raw] = Model(raw)
    return _models[raw]


def load(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _coded(raw: bytes, schema: pa.Schema, at: int, write: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(raw)
        for batch in batches:
            for row in range(0, batch.num_rows, 2000):
                some = batch.slice(row, 2000)
                text = some.column(at)
                ids, offs = own.encode(text)
                nulls = text.is_null() if text.null_count else None
                listed = pa.ListArray.from_arrays(pa.array(offs, pa.int32(), mask=np.append(nulls.to_numpy(False), False) if nulls is not None else None), pa.array(ids))
                decoded = own.decode(ids, offs).cast(pa.string())
                if nulls is not None:
                    decoded = pc.if_else(nulls, pa.scalar(None, pa.string()), decoded)
                columns = some.columns[:]
                columns[at : at + 1] = [decoded if write else text]
                yield pa.RecordBatch.from_arrays([*columns, listed, decoded][: len(schema)], schema.names)

    return flat.tidy(run)


def coded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the pieces of each text and the text that they give again.

    An empty text has no piece and decodes to an empty text; a null has null for both. A null doc_id stays, a repeated row gives
    its result again. Other columns are not read.
    """
    frugal(docs.sparkSession)
    raw = load(path)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    names = pa.schema([(n, pa.null()) for n in schema.names])
    return rows.mapInArrow(_coded(raw, names, 1, False), schema).select("doc_id", "ids", "decoded")


def recoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The documents with a text that went through pieces and back, and the column `ids` of its pieces; a column of that name is replaced.

    A null text stays null and has null ids, an empty one is empty and has none. Nothing else of a row is looked at: a null id stays, a
    repeated row comes again, an empty table gives an empty one. A text changes only where the model can't say it: `▁` becomes a space,
    and what it doesn't know its unknown piece.
    """
    frugal(docs.sparkSession)
    raw = load(path)
    rows = docs.drop(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = pa.schema([(n, pa.null()) for n in schema.names])
    return rows.mapInArrow(_coded(raw, names, rows.columns.index("text"), True), schema)
