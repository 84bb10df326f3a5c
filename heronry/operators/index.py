"""Tables of an index, and what changes them: chunks, postings (term, chunk_id, tf, doc_len), terms (term, df, idf), stats (n, avgdl)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize_advanced


@dataclass
class Index:
    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    stemmed: bool = False
    drop_stopwords: bool = False
    #: Whether the postings are a table, from which queries are answered; otherwise they are from the texts.
    stored: bool = False

    def tokens(self, df: DataFrame, text: str, column: str) -> DataFrame:
        """Tokens of queries, made as those of the chunks were."""
        return tokenize_advanced(df, text, column, self.stemmed, self.drop_stopwords)


def counted(tokens: Column) -> Column:
    """The terms of each row's tokens, each with its number."""

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def counts(own: pa.Array) -> pa.Array:
        flat = own.flatten().dictionary_encode()
        size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
        many = max(len(flat.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(len(own)), size) * many + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        at = np.append(0, np.cumsum(np.bincount(key // many, minlength=len(own))))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([flat.dictionary.take(pa.array(key % many)), pa.array(tf, pa.int64())], ["term", "tf"]))

    return counts(tokens)


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def build(chunks: DataFrame, stemmed: bool = False, drop_stopwords: bool = False, content: str = "content", chunk_id: str = "id", keep: Callable[[DataFrame], DataFrame] | None = None, unique: bool = False) -> Index:
    """Postings and statistics of all chunks; those without a token count in n and avgdl, too.

    unique: no id of a chunk repeats, so that its terms are counted where it lies and nothing is shuffled.

    keep: what makes a table of the postings, from which terms and statistics are then read, so that chunks are tokenized once.
    """
    tokens = tokenize_advanced(chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(content).alias("text")), "text", "tokens", stemmed, drop_stopwords)
    terms = tokens.select("chunk_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    postings = terms.groupBy("term", "chunk_id", "doc_len").agg(F.count("*").alias("tf"))
    if unique:
        each = tokens.select("chunk_id", F.size("tokens").alias("doc_len"), F.explode(counted(F.col("tokens"))).alias("c"))
        postings = each.select(F.col("c.term").alias("term"), "chunk_id", "doc_len", F.col("c.tf").alias("tf"))
    if keep:
        postings = keep(postings)
    return of_postings(chunks, postings, stemmed, drop_stopwords, bool(keep))


def of_postings(chunks: DataFrame, postings: DataFrame, stemmed: bool = False, drop_stopwords: bool = False, stored: bool = True) -> Index:
    """The index of chunks whose postings are there already."""
    size = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("size"))
    stats = chunks.agg(F.count("*").alias("n")).crossJoin(F.broadcast(size)).select("n", F.when(F.col("n") > 0, F.col("size") / F.col("n")).otherwise(0.0).alias("avgdl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    return Index(chunks, postings, terms, stats, stemmed, drop_stopwords, stored)


def last_of(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row of each id of a batch: the last by `order`; without one, the last as Spark numbers the rows, which for a list or a
    file is their own order."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    rows = batch.withColumn("__at", at)
    by = Window.partitionBy("id").orderBy(F.desc("__at"))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n", "__at")


def upsert(chunks: DataFrame, batch: DataFrame, order: str | None = None, whole_documents: bool = False) -> DataFrame:
    """chunks with those of `batch` in place of the ones of the same id; with whole_documents, of the same document."""
    new = last_of(batch, order)
    key = ["document_id"] if whole_documents else ["id"]
    kept = chunks.join(new.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(new.select(*[c for c in new.columns if c in chunks.columns]), allowMissingColumns=True)


def delete(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("id"), "id", "left_anti")


def clear(chunks: DataFrame) -> DataFrame:
    return chunks.limit(0)


def count(chunks: DataFrame) -> int:
    return chunks.count()
