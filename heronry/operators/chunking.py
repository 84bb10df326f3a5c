"""Chunkers: documents (id, content, metadata) become chunks (id, document_id, content, index, metadata), id being document_id:index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import context_key, detect_language, split_sentences, trim

PREFIX_KEYS = ("title", "topic", "section", "kind", "lang")
Chunker = Callable[[DataFrame], DataFrame]


def with_metadata(docs: DataFrame) -> DataFrame:
    """docs with a metadata column, MAP<STRING, STRING>, empty where it was missing."""
    empty = F.create_map().cast("map<string,string>")
    return docs.withColumn("metadata", F.coalesce(F.col("metadata"), empty) if "metadata" in docs.columns else empty)


def _numbered(docs: DataFrame, parts: Column) -> DataFrame:
    rows = with_metadata(docs).select("id", "metadata", F.posexplode(parts).alias("index", "content"))
    return rows.select(F.concat_ws(":", "id", "index").alias("id"), F.col("id").alias("document_id"), "content", "index", "metadata")


def _of_parts(parts: Callable[[Column], Column]) -> Chunker:
    """The chunker that cuts a text into an array of parts; it keeps the function that does."""

    def run(docs: DataFrame) -> DataFrame:
        return _numbered(docs, parts(F.col("content")))

    run.parts = parts
    return run


def fixed(size: int = 800, overlap: int = 100) -> Chunker:
    """Slices of `size` characters, each starting `size - overlap` behind the one before; blank ones are skipped."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")

    def parts(text: Column) -> Column:
        at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(at, lambda i: trim(F.substring(text, i + 1, size))), lambda c: F.length(c) > 0)

    return _of_parts(parts)


def pack(sentences: Column, target: int = 600, most: int = 1200) -> Column:
    """Sentences packed in order: closed before one that would pass `most`, and once `target` is reached. A longer sentence stays whole."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("buffer"), F.lit(0).alias("n"))

    def step(state: Column, s: Column) -> Column:
        flush = (state["n"] + F.length(s) > most) & (F.size(state["buffer"]) > 0)
        done = F.when(flush, F.concat(state["done"], F.array(F.array_join(state["buffer"], " ")))).otherwise(state["done"])
        buffer = F.concat(F.when(flush, F.array().cast("array<string>")).otherwise(state["buffer"]), F.array(s))
        n = F.when(flush, F.lit(0)).otherwise(state["n"]) + F.length(s) + 1
        full = n >= target
        return F.struct(
            F.when(full, F.concat(done, F.array(F.array_join(buffer, " ")))).otherwise(done).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(buffer).alias("buffer"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"),
        )

    end = lambda s: F.when(F.size(s["buffer"]) > 0, F.concat(s["done"], F.array(F.array_join(s["buffer"], " ")))).otherwise(s["done"])
    return F.aggregate(sentences, zero, step, end)


def _pack(sentences: list[str], target: int, most: int) -> list[str]:
    done, buffer, n = [], [], 0
    for s in sentences:
        if buffer and n + len(s) > most:
            done.append(" ".join(buffer))
            buffer, n = [], 0
        buffer.append(s)
        n += len(s) + 1
        if n >= target:
            done.append(" ".join(buffer))
            buffer, n = [], 0
    return done + [" ".join(buffer)] * bool(buffer)


def sentences(target: int = 600, most: int = 1200) -> Chunker:
    """Whole sentences packed as pack() does, over Arrow batches, so that a long text costs time in proportion to its length."""

    @F.pandas_udf("array<string>")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda s: [] if s is None else _pack(list(s), target, most))

    return _of_parts(lambda text: packed(split_sentences(text)))


def semantic(embed: Callable[[DataFrame, str, str], DataFrame], threshold: float = 0.65, most: int = 1500) -> Chunker:
    """Sentences packed until the next one's embedding is less alike than `threshold`, or the chunk would pass `most`."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, buffer, n, index, before, head = None, [], 0, 0, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, texts, vectors = batch.column("at").to_pylist(), batch.column("sentence").to_pylist(), batch.column("vector")
            near = _likeness(vectors if last is None else pa.concat_arrays([last, vectors]))
            near = (near if last is not None else np.append(np.nan, near)).tolist()
            # the row of the document's first sentence, of this batch or one before it
            heads = batch.select(["id", "metadata"])
            heads, own, first = (heads, 0, 0) if head is None else (pa.concat_batches([head, heads]), 0, 1)
            done: list[tuple[int, int, str]] = []
            for i, (place, s, alike) in enumerate(zip(at, texts, near)):
                if place and place != before + 1:
                    raise ValueError("the embedder has changed the order of rows")
                if buffer and (place == 0 or alike < threshold or n + len(s) > most):
                    done.append((own, index, " ".join(buffer)))
                    buffer, n, index = [], 0, index + 1
                if place == 0:
                    own, index = first + i, 0
                before = place
                n = n + len(s) + 1 if buffer else len(s)
                buffer.append(s)
            last, head = vectors[-1:], heads.slice(own, 1)
            yield _told(heads, done)
        if buffer:
            yield _told(head, [(0, index, " ".join(buffer))])

    def run(docs: DataFrame) -> DataFrame:
        docs = with_metadata(docs)
        rows = docs.select("id", "metadata", F.posexplode(split_sentences("content")).alias("at", "sentence"))
        # the sentences of a document stay where they are and in their order, so that nothing is shuffled; the first one has its metadata
        rows = rows.withColumn("metadata", F.when(F.col("at") == 0, F.col("metadata")))
        rows = embed(rows, "sentence", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
        kind = docs.select("id", "metadata").schema
        schema = T.StructType([*kind, T.StructField("index", T.IntegerType()), T.StructField("content", T.StringType())])
        out = rows.select("id", "metadata", "at", "sentence", "vector").mapInArrow(fold, schema)
        return out.select(F.concat_ws(":", "id", "index").alias("id"), F.col("id").alias("document_id"), "content", "index", "metadata")

    return run


def _told(heads: pa.RecordBatch, done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    """Chunks, each (the row of its document among heads, index, content)."""
    own = heads.take(pa.array([d[0] for d in done], pa.int64()))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.string())], ["id", "metadata", "index", "content"])


def _likeness(vectors: pa.ListArray) -> np.ndarray:
    """cosine() of each vector with the next one, its sums in the same order; NaN where one is missing."""
    size = pc.list_value_length(vectors)
    if vectors.null_count or len(pc.unique(size)) > 1:
        known = vectors.to_pylist()
        out = np.full(max(len(known) - 1, 0), np.nan)
        for i, (a, b) in enumerate(zip(known, known[1:])):
            if a is not None and b is not None:
                n = min(len(a), len(b))
                out[i] = _cosines(np.array([a[:n]], np.float64), np.array([b[:n]], np.float64))[0]
        return out
    v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    return _cosines(v[:-1], v[1:])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for d in range(x.shape[1]):
            out += x[:, d] * y[:, d]
        return out

    norm = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    return dot(a, b) / np.where(norm == 0, 1.0, norm)


def prefix(id_: Column, metadata: Column) -> Column:
    """[id | title: .. | topic: .. | section: .. | kind: .. | lang: ..] and a line break; keys without a value are left out."""
    shown = [F.when(F.length(F.element_at(metadata, k)) > 0, F.concat(F.lit(f"{k}: "), F.element_at(metadata, k))) for k in PREFIX_KEYS]
    return F.concat(F.lit("["), F.concat_ws(" | ", id_, *shown), F.lit("]\n"))


def metadata(base: Chunker, form: Callable[[Column, Column], Column] = prefix) -> Chunker:
    """The chunks of `base` behind a prefix made of the document's id and metadata; a blank prefix changes nothing."""

    def run(docs: DataFrame) -> DataFrame:
        chunks = base(docs)
        head = form(F.col("document_id"), F.col("metadata"))
        return chunks.withColumn("content", F.when(F.length(trim(head)) > 0, F.concat(head, "content")).otherwise(F.col("content")))

    return run


def contextual(base: Chunker, provider: Callable[[list[str], list[str]], list[str]], cache: Any = None, separator: str = "\n\n") -> Chunker:
    """The chunks of `base` behind a context that `provider` says for lists of documents and chunks.

    cache: (key, context) of those known, or an object with read() and add() of such a table, as store.ContextCache, to which new
    contexts are added when the chunker is called; the provider is asked for the others alone. A blank context changes nothing.
    """

    def ask(batches):
        for pdf in batches:
            said = provider(pdf["document"].tolist(), pdf["content"].tolist()) if len(pdf) else []
            yield pd.DataFrame({"key": pdf["key"], "context": said})

    def run(docs: DataFrame) -> DataFrame:
        if cache is None and hasattr(base, "parts"):
            return _contexts(docs, base.parts, provider, separator)
        chunks = base(docs)
        keyed = chunks.join(docs.select(F.col("id").alias("document_id"), F.col("content").alias("document")), "document_id")
        keyed = keyed.withColumn("key", context_key("document", "content"))
        kept = cache is not None and not isinstance(cache, DataFrame)
        known = (cache.read() if kept else cache).select("key", "context") if cache is not None else None
        missing = keyed if known is None else keyed.join(known, "key", "left_anti")
        told = missing.select("key", "document", "content").dropDuplicates(["key"]).mapInPandas(ask, "key string, context string")
        if kept:
            cache.add(told)
            every = cache.read()
        else:
            every = told if known is None else known.unionByName(told)
        said = trim(F.coalesce("context", F.lit("")))
        content = F.when(F.length(said) > 0, F.concat(said, F.lit(separator), "content")).otherwise(F.col("content"))
        return keyed.join(every, "key", "left").select("id", "document_id", content.alias("content"), "index", "metadata")

    return run


#: Chunks for which a provider is asked at once.
ASKED = 10_000


def _contexts(docs: DataFrame, parts: Callable[[Column], Column], provider: Callable[[list[str], list[str]], list[str]], separator: str) -> DataFrame:
    """contextual() without a cache: documents of the same content meet in one task, one behind another, so that the provider is asked
    once for each document and chunk, and only documents are shuffled, once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple[str, str], str | None] = {}
        for batch in batches:
            documents, lists = batch.column("content").to_pylist(), batch.column("parts").to_pylist()
            known, pairs = dict(last), []
            for d, own in zip(documents, lists):
                for c in own or ():
                    if (d, c) not in known:
                        known[d, c] = None
                        pairs.append((d, c))
            for a in range(0, len(pairs), ASKED):
                some = pairs[a : a + ASKED]
                known.update(zip(some, provider([d for d, _ in some], [c for _, c in some]), strict=True))
            said = pa.array([[known[d, c] for c in own or ()] for d, own in zip(documents, lists)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("metadata"), batch.column("parts"), said], ["id", "metadata", "parts", "said"])
            if documents:
                last = {(d, c): known[d, c] for d, own in zip(documents[-1:], lists[-1:]) for c in own or ()}

    rows = with_metadata(docs).select("id", "metadata", "content", F.xxhash64("content").alias("__h"))
    rows = rows.repartition("__h").sortWithinPartitions("__h", "content")
    rows = rows.select("id", "metadata", "content", parts(F.col("content")).alias("parts"))
    kind = rows.select("id", "metadata", "parts").schema
    out = rows.mapInArrow(ask, T.StructType([*kind, T.StructField("said", T.ArrayType(T.StringType()))]))
    said = lambda s: trim(F.coalesce(s, F.lit("")))
    content = F.zip_with("parts", "said", lambda c, s: F.when(F.length(said(s)) > 0, F.concat(said(s), F.lit(separator), c)).otherwise(c))
    return _numbered(out, content)


def questions(base: Chunker, generate: Callable[[list[str]], list[list[str]]], form: Callable[[str, list[str]], str] | None = None) -> Chunker:
    """The chunks of `base` with generated questions behind them, trimmed and each once."""

    def told(text: str, asked: list[str]) -> str:
        own = list(dict.fromkeys(q.strip() for q in asked if q and q.strip()))
        if form:
            return form(text, own)
        return text + "\n\nQuestions answered:" + "".join(f"\n- {q}" for q in own) if own else text

    def run(docs: DataFrame) -> DataFrame:
        chunks = base(docs)

        def ask(batches):
            for pdf in batches:
                pdf["content"] = [told(t, q) for t, q in zip(pdf["content"], generate(pdf["content"].tolist()) if len(pdf) else [])]
                yield pdf

        return chunks.mapInPandas(ask, chunks.schema)

    return run


def tagged(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with metadata.lang: as the user has it, else by the script of the whole document."""
    language = docs.select(F.col("id").alias("document_id"), detect_language("content").alias("lang"))
    own = chunks.join(language, "document_id")
    said = F.element_at("metadata", "lang")
    lang = F.when(F.length(said) > 0, said).otherwise(F.col("lang"))
    rest = F.map_filter("metadata", lambda k, v: k != "lang")
    return own.withColumn("metadata", F.map_concat(rest, F.create_map(F.lit("lang"), lang))).withColumn("lang", lang)
