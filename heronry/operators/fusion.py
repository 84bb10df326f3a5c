"""Two ranked lists become one by weighted reciprocal ranks. Lists are (query_id, chunk_id, score, rank), ranks from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp
from .retrieve import top

K = 60
DEFAULT, LEXICAL, SHORT, LONG_QUESTION = 0.5, 0.3, 0.4, 0.7
SENSITIVITY, SWING, LOWEST, HIGHEST = 0.30, 0.20, 0.10, 0.90


def vector_weight(s: Column) -> Column:
    """The vector side's weight by the query's signals."""
    lexical = s["has_quoted_phrase"] | s["has_specific_tokens"] | s["has_code_like"]
    return F.when(lexical, LEXICAL).when(s["word_count"] <= 2, SHORT).when(s["is_question"] & (s["word_count"] >= 6), LONG_QUESTION).otherwise(DEFAULT)


def top_gap(hits: DataFrame) -> DataFrame:
    """(query_id, gap): the lead of the first over the second, as a share of that over the tenth or last; 0 for fewer than two."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    low = F.min(F.when(F.col("rank") <= 10, F.col("score")))
    rows = hits.groupBy("query_id").agg(at(1).alias("a"), at(2).alias("b"), low.alias("low"), F.count("*").alias("n"))
    span = F.col("a") - F.col("low")
    gap = F.when((F.col("n") < 2) | (span <= 0), 0.0).otherwise(clamp((F.col("a") - F.col("b")) / F.when(span > 0, span), 0.0, 1.0))
    return rows.select("query_id", gap.alias("gap"))


def adapted(base: Column, vector_gap: Column, keyword_gap: Column) -> Column:
    """The weight moved towards the side that is surer of its first hit."""
    return clamp(base + clamp((vector_gap - keyword_gap) * SENSITIVITY, -SWING, SWING), LOWEST, HIGHEST)


def adaptive_weights(weights: DataFrame, vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """(query_id, weight) of each (query_id, weight) given, adapted to both lists."""
    v = top_gap(vector).withColumnRenamed("gap", "__v")
    k = top_gap(keyword).withColumnRenamed("gap", "__k")
    rows = weights.select("query_id", "weight").join(v, "query_id", "left").join(k, "query_id", "left")
    zero = F.lit(0.0)
    return rows.select("query_id", adapted(F.col("weight"), F.coalesce("__v", zero), F.coalesce("__k", zero)).alias("weight"))


def fuse(vector: DataFrame, keyword: DataFrame, weights: DataFrame | float = DEFAULT, k: int = K, limit: int | None = None, clamped: bool = True, digits: int | None = None) -> DataFrame:
    """weight / (k + rank) of the vector list plus (1 - weight) / (k + rank) of the keyword list, with both scores."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("__v"), F.col("score").alias("vector_score"))
    w = keyword.select("query_id", "chunk_id", F.col("rank").alias("__k"), F.col("score").alias("keyword_score"))
    rows = v.join(w, ["query_id", "chunk_id"], "full_outer")
    if isinstance(weights, DataFrame):
        rows = rows.join(weights.select("query_id", F.col("weight").alias("__w")), "query_id")
    else:
        rows = rows.withColumn("__w", F.lit(float(weights)))
    weight = clamp("__w", 0.0, 1.0) if clamped else F.col("__w")
    zero = F.lit(0.0)
    score = F.coalesce(weight / (F.col("__v") + k), zero) + F.coalesce((1 - weight) / (F.col("__k") + k), zero)
    fused = rows.select("query_id", "chunk_id", (score if digits is None else F.round(score, digits)).alias("score"), "vector_score", "keyword_score")
    return top(fused, limit if limit is not None else 2**31 - 1)


def server_side(vector: DataFrame, keyword: DataFrame, limit: int) -> DataFrame:
    """Unweighted fusion, as a store does it that knows no weight; fetch prefetch(limit) of each side."""
    return fuse(vector, keyword, DEFAULT, limit=limit)


def prefetch(k: int) -> int:
    return max(4 * k, 20)


def alpha_blend(dense: DataFrame, sparse: DataFrame, alpha: float, limit: int) -> DataFrame:
    """alpha times the dense product plus 1 - alpha times the sparse one, as one list. Both are (query_id, chunk_id, score)."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("__d"))
    s = sparse.select("query_id", "chunk_id", F.col("score").alias("__s"))
    zero = F.lit(0.0)
    score = F.coalesce("__d", zero) * alpha + F.coalesce("__s", zero) * (1 - alpha)
    return top(d.join(s, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", score.alias("score")), limit)


def compose_filter(user: dict[str, str] | None, language: str | None) -> dict[str, str] | None:
    """The user's filter with the query's language, which a lang of the user's overrides."""
    out = ({"lang": language} if language else {}) | (user or {})
    return out or None


def composed(user: Column, language: Column) -> Column:
    """compose_filter() on columns."""
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(user, empty)
    auto = F.when(language.isNotNull() & ~F.map_contains_key(own, F.lit("lang")), F.create_map(F.lit("lang"), language)).otherwise(empty)
    return F.map_concat(auto, own)
