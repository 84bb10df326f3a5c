"""Sparse vectors weighted by BM25, on the document's and the query's side, and their products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize_advanced
from ..sources.tables import written
from .index import build, idf
from .retrieve import B, K1, PAIRS, best_by_terms, ranked, slices, small, top


@dataclass
class SparseEncoder:
    """vocabulary: (term, idx, df, idf), idx by first appearance (document, then place); stats: (n, avgdl). fit() makes a new one."""

    vocabulary: DataFrame
    stats: DataFrame
    stemmed: bool = True
    k1: float = K1
    b: float = B

    @classmethod
    def fit(cls, corpus: DataFrame, text: str = "content", order: str = "id", stemmed: bool = True, k1: float = K1, b: float = B) -> SparseEncoder:
        tokens = tokenize_advanced(corpus.select(F.col(order).alias("__o"), F.col(text).alias("__t")), "__t", "tokens", stemmed)
        stats = tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))
        each = tokens.select("__o", F.posexplode("tokens").alias("at", "term"))
        terms = each.groupBy("term", "__o").agg(F.min("at").alias("at")).groupBy("term").agg(F.count("*").alias("df"), F.min(F.struct("__o", "at")).alias("first"))
        # numbered by two steps, a range partition at a time, rather than by one window over all terms; the ranges come from a sample,
        # which is another one whenever they are computed, so that they are written
        ranged = written(terms.repartitionByRange("first").withColumn("part", F.spark_partition_id()), "terms")
        own = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("first", "term")))
        before = own.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
        numbered = own.join(F.broadcast(before), "part").crossJoin(F.broadcast(stats.select("n")))
        return cls(numbered.select("term", (F.col("base") + F.col("k") - 1).cast("int").alias("idx"), "df", idf(F.col("n"), F.col("df")).alias("idf")), stats, stemmed, k1, b)

    def weights(self, df: DataFrame, text: str, key: str) -> DataFrame:
        """(key, idx, value) of the known terms; unknown ones are dropped."""
        tokens = tokenize_advanced(df.select(key, F.col(text).alias("__t")), "__t", "tokens", self.stemmed)
        counts = tokens.select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
        rows = counts.join(self.vocabulary, "term").crossJoin(F.broadcast(self.stats.select("avgdl")))
        size = F.when(F.col("avgdl") > 0, F.col("len") / F.col("avgdl")).otherwise(1.0)
        value = F.col("idf") * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * size))
        return rows.select(key, "idx", value.alias("value")).where("value > 0")

    def encode(self, df: DataFrame, text: str, key: str = "id") -> DataFrame:
        """(key, indices, values), indices rising; a text without a known term has empty ones."""
        packed = self.weights(df, text, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("all"))
        empty = F.array().cast("array<struct<idx:int,value:double>>")
        rows = df.select(key).distinct().join(packed, key, "left").withColumn("all", F.coalesce("all", empty))
        return rows.select(key, F.col("all.idx").alias("indices"), F.col("all.value").alias("values"))


def sparse_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): products of (query_id, idx, value) and (chunk_id, idx, value) weights."""
    q = small(queries.select("query_id", "idx", F.col("value").alias("__q")))
    return docs.join(q, "idx").groupBy("query_id", "chunk_id").agg(F.sum(F.col("value") * F.col("__q")).alias("score"))


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    return top(sparse_scores(queries, docs), k)


def text_topk(queries: DataFrame, docs: DataFrame, k: int = 10, query: str = "query", stemmed: bool = True, k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    """sparse_topk() of texts, weighted as SparseEncoder.fit(docs) does, without a row for each pair: queries are sent to the documents."""

    def weigh(idf_: np.ndarray, avgdl: float, rows: pa.Table) -> np.ndarray:
        tf, size = (rows.column(c).to_numpy() for c in ("weight", "len"))
        return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (size / avgdl if avgdl > 0 else np.ones(len(size)))))

    index = build(docs, stemmed)
    tokens = index.tokens(queries.select("query_id", F.col(query).alias("__t")), "__t", "tokens")
    asked = tokens.select("query_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("query_id", "len", "term").agg(F.count("*").cast("double").alias("weight"))
    parts = [best_by_terms(some, index, k, digits, weigh, k1, b, blank=False) for some in slices(asked, -(-asked.count() // PAIRS))]
    if not parts or parts[0] is None:
        encoder = SparseEncoder.fit(docs, stemmed=stemmed, k1=k1, b=b)
        hits = sparse_scores(encoder.weights(queries, query, "query_id"), encoder.weights(docs, "content", "id").withColumnRenamed("id", "chunk_id"))
        return top(hits if digits is None else hits.withColumn("score", F.round("score", digits)), k)
    return ranked(parts, k, digits)
