"""Line dedup: of repeated runs of several lines only what comes first stays.

Runs are found in two ways. Passages are whole: every two neighbouring lines that stand anywhere before, byte by byte, go, so that
a repeated run of two lines and more goes wherever it begins and ends. Chunks are cheaper, and lose runs whose ends they don't meet:
A chunk ends behind a line where a rolling hash over the hashes of the last WINDOW lines is a multiple of DIVISOR, so that the same
run of lines is cut alike wherever it stands. Chunks of two lines and more whose hash occurs again are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .shared import frugal, unused, written

DIVISOR, WINDOW, FACTOR = 4, 3, 31


def split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, lines): bytes of each line, and lines before each text."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    return starts, ends, np.arange(len(offs)) + np.searchsorted(breaks, offs)


def boundaries(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, lines, last): as split() has them, and whether a chunk ends behind the line."""
    starts, ends, lines = split(data, offs)
    raw = data.tobytes()
    h = np.array([int.from_bytes(md5(raw[a:b], usedforsecurity=False).digest()[:4]) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    place = np.arange(len(h)) - np.repeat(lines[:-1], np.diff(lines))
    rolled = h.copy()
    for k in range(1, WINDOW):
        rolled[k:] += np.where(place[k:] >= k, FACTOR**k * h[:-k], 0)
    last = rolled % DIVISOR == 0
    last[lines[1:] - 1] = True
    return starts, ends, lines, last


def _pieces(data: np.ndarray, offs: np.ndarray, passages: bool) -> tuple[np.ndarray, ...]:
    """(starts, ends, lines, head, tail): first and last line of each chunk of several lines, or of each two neighbouring lines."""
    if passages:
        starts, ends, lines = split(data, offs)
        last = np.zeros(len(starts), bool)
        last[lines[1:] - 1] = True
        head = np.flatnonzero(~last)
        return starts, ends, lines, head, head + 1
    starts, ends, lines, last = boundaries(data, offs)
    tail = np.flatnonzero(last)
    head = np.concatenate([[0], tail[:-1] + 1])
    many = tail > head
    return starts, ends, lines, head[many], tail[many]


def _thin(passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = flat.buffers(batch.column(2))
            for row, _, part, at in flat.slices(data, offs):
                starts, ends, lines, head, tail = _pieces(part, at, passages)
                own = np.searchsorted(lines, head, "right") - 1
                take = pa.array(own + row)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(head - lines[own], pa.int32()), pa.array(tail - head + 1, pa.int32()), pa.array(flat.hashes(part, starts[head], ends[tail], flat.SAME).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "begin", "n", "hash"])

    return flat.tidy(run)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines from begin on, n of them, of each chunk in the lists of (begin, n, hash) of a text."""
    for batch in batches:
        data, offs = flat.buffers(batch.column(0))
        cut = batch.column(1).offsets.to_numpy()
        begin, n = (batch.column(k).values.to_numpy() for k in (1, 2))
        for row, end, part, at in flat.slices(data, offs):
            starts, ends, lines = split(part, at)
            own = slice(cut[row], cut[end])
            head = np.repeat(lines[:-1], np.diff(cut[row : end + 1])) + begin[own]
            a, b = starts[head], ends[head + n[own] - 1]
            yield pa.RecordBatch.from_arrays([batch.column(3).values[own], flat.strings(*flat.gather(part, a, b - a))], ["hash", "body"])


def removals(rows: DataFrame, passages: bool = False) -> DataFrame:
    """(doc_id, mark, begin, n) of the chunks, or with passages of the pairs of lines, to go, of rows (doc_id, mark, text).

    Chunks with the same hash are alike if their least and greatest bodies are, byte by byte. Of a hash that differing bodies share each
    body is looked at for itself. Equal bodies meet before they travel, so that one that a third of all documents share is no burden.
    """
    rows = rows.where(F.col("text").contains("\n"))
    thin = written(rows.mapInArrow(_thin(passages), "doc_id long, mark long, begin int, n int, hash long").distinct(), "chunks")
    key = F.struct("doc_id", "mark", "begin")
    first = thin.groupBy("hash").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first <> last")
    again = written(thin.join(first.select("hash", "first"), "hash"), "repeated")
    lists = again.groupBy("doc_id", "mark").agg(*(F.collect_list(c).alias(c) for c in ("begin", "n", "hash")))
    bodies = rows.join(lists.hint("shuffle_hash"), ["doc_id", "mark"]).select("text", "begin", "n", "hash")
    told = bodies.mapInArrow(_bodies, "hash long, body string").groupBy("hash").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    mixed = written(told.where("low <> high").select("hash"), "mixed")
    gone = again.where(key != F.col("first")).select("doc_id", "mark", "begin", "n", "hash")
    if mixed.limit(1).count():
        gone = gone.join(mixed, "hash", "left_anti").unionByName(_apart(rows, again.join(mixed, "hash", "left_semi")))
    return written(gone.select("doc_id", "mark", "begin", "n"), "removals")


def _apart(rows: DataFrame, some: DataFrame) -> DataFrame:
    """removals() among the chunks `some`, each body for itself."""
    line = F.slice(F.split("text", "\n", -1), F.col("begin") + 1, F.col("n"))
    bodies = rows.join(some.hint("shuffle_hash"), ["doc_id", "mark"]).select("doc_id", "mark", "begin", "n", "hash", F.array_join(line, "\n").alias("body"))
    key = F.struct("doc_id", "mark", "begin")
    first = bodies.groupBy("hash", "body").agg(F.min(key).alias("first"))
    return bodies.join(first, ["hash", "body"]).where(key != F.col("first")).select("doc_id", "mark", "begin", "n", "hash")


def _rest(lines: Column, gone: Column) -> Column:
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def cleaned(docs: DataFrame, removed: str = "lines_removed", passages: bool = False) -> DataFrame:
    """The documents, all columns, with repeated chunks removed from the text, and how many lines that were, in column `removed`.

    With passages, pairs of neighbouring lines take the place of chunks; the first place of a line is then never removed, so no
    line is lost altogether. Of equal chunks the one stays that comes first by doc_id (nulls last), hash of the text, and place; rows that are the same
    document again, id and text alike, keep the same lines. A null text stays null and an empty one empty, with no line
    removed. A text all of whose lines go becomes empty. An input column named as `removed` is replaced.

    Texts are shuffled to what is found out about them twice, at every size: once for the bodies of repeated chunks, once for the result.
    """
    frugal(docs.sparkSession)
    docs = docs.drop(removed)
    own, mark, gone = (unused(docs, k) for k in ("id", "mark", "gone"))
    # a null id comes last, and its texts have marks of their own
    number, name = F.col("doc_id").cast("long"), F.xxhash64("text")
    keys = {own: F.coalesce(number, F.lit(2**63 - 1)), mark: F.when(number.isNull(), F.bitwise_not(name)).otherwise(name)}
    held = docs.withColumns(keys)
    found = removals(held.select(F.col(own).alias("doc_id"), F.col(mark).alias("mark"), "text"), passages)
    each = F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)
    lists = found.groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_list(each))).alias("gone"))
    right = lists.select(F.col("doc_id").alias(own), F.col("mark").alias(mark), F.col("gone").alias(gone))
    both = held.join(right.hint("shuffle_hash"), [own, mark], "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_rest(F.split("text", "\n", -1), F.col(gone)))
    return both.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.coalesce(F.size(gone), F.lit(0)).cast("int").alias(removed))


def deduped(docs: DataFrame, passages: bool = False) -> DataFrame:
    """The documents without repeated chunks, or with passages without repeated runs of lines, columns as they were, n_chars anew; those that lost every line are left out."""
    removed = unused(docs, "removed")
    out = cleaned(docs, removed, passages).where((F.col(removed) == 0) | (F.col("text") != "")).drop(removed)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return out.withColumn("n_chars", F.length("text").cast(kinds.get("n_chars", T.LongType()))) if "n_chars" in kinds else out
