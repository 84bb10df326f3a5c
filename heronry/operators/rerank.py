"""Rerankers: functions (hits, top_k) -> hits. hits are (query_id, query, chunk_id, content, score, rank)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem
from ..functions.text import array_of, sigmoid, tokenize
from ..functions.words import STOPWORDS
from .embedding import imported, loaded
from .retrieve import top

Reranker = Callable[[DataFrame, int], DataFrame]


def query_tokens(query: Column | str) -> Column:
    """Distinct tokens of three letters and more that are no stopwords."""
    return F.array_distinct(F.filter(tokenize(query), lambda t: (F.length(t) >= 3) & ~F.array_contains(array_of(STOPWORDS), t)))


def proximity(tokens: Column, wanted: Column) -> Column:
    """0 without a wanted token, 0.5 with one, else 1 less the distance from the first to the last over 200, at least 0."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(F.array_contains(wanted, t), i)), lambda i: i.isNotNull())
    far = 1 - (F.array_max(at) - F.array_min(at)) / 200
    return F.when(F.size(at) == 0, 0.0).when(F.size(at) == 1, 0.5).otherwise(F.greatest(F.lit(0.0), far))


def heuristic(hits: DataFrame, top_k: int) -> DataFrame:
    """Half the squashed score, three tenths the share of query tokens found, two tenths their proximity."""
    rows = hits.withColumn("__q", query_tokens("query")).withColumn("__c", tokenize("content"))
    overlap = F.size(F.array_intersect("__q", F.array_distinct("__c"))) / F.greatest(F.size("__q"), F.lit(1))
    rows = rows.withColumn("original", F.col("score")).withColumn("overlap", overlap).withColumn("proximity", proximity(F.col("__c"), F.col("__q")))
    score = 0.5 * sigmoid("original") + 0.3 * F.col("overlap") + 0.2 * F.col("proximity")
    told = rows.where(F.size("__q") > 0).withColumn("score", score).drop("__q", "__c", "rank")
    plain = rows.where(F.size("__q") == 0).withColumn("overlap", F.lit(None).cast("double")).withColumn("proximity", F.lit(None).cast("double")).drop("__q", "__c")
    return top(told, top_k).unionByName(plain.where(F.col("rank") <= top_k))


def cascaded(stages: list[tuple[Reranker, int]]) -> Reranker:
    """Rerankers one after another, each with the number it keeps; the last keeps what the caller asks for."""
    if not stages:
        raise ValueError("a cascade needs a stage")

    def run(hits: DataFrame, top_k: int) -> DataFrame:
        for k, (stage, keep) in enumerate(stages):
            hits = stage(hits, top_k if k + 1 == len(stages) else keep)
        return hits

    return run


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def _tokens(text: str) -> frozenset[str]:
    """Stems of the tokens as tokenize() makes them, letters and numbers of any script, without stopwords."""
    kept = _APART.sub(" ", (text or "").lower()).split()
    return frozenset(stem(t) for t in kept if t not in _STOP)


_APART = regex.compile(r"[^\p{L}\p{N}\s]")


_STOP = frozenset(STOPWORDS)


def _alike(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def mmr_order(scores: list[float], alike: Callable[[int, int], float], top_k: int, weight: float) -> list[int]:
    """Places in the order of maximal marginal relevance; of equals the earlier."""
    left, out, most = list(range(len(scores))), [], [0.0] * len(scores)
    while left and len(out) < top_k:
        best = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * most[i], -i))
        left.remove(best)
        out.append(best)
        for i in left:
            most[i] = max(most[i], alike(i, best))
    return out


def mmr(weight: float = 0.7, similarity: Callable[[str, str], float] | None = None) -> Reranker:
    """Diverse hits: scores stay, the rank is the order chosen. A query's hits meet in one group, at most what retrieval kept."""

    def run(hits: DataFrame, top_k: int) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
            if similarity:
                text = pdf["content"].tolist()
                alike = lambda i, j: similarity(text[i], text[j])
            else:
                sets = [_tokens(t) for t in pdf["content"]]
                alike = lambda i, j: _alike(sets[i], sets[j])
            out = pdf.iloc[mmr_order(pdf["score"].tolist(), alike, top_k, weight)].copy()
            out["rank"] = range(1, len(out) + 1)
            return out

        return hits.groupBy("query_id").applyInPandas(one, hits.schema)

    return run


def local_reranker(name: str, batch: int = 16) -> Reranker:
    """Reranks with a local cross-encoder, loaded once in a Python worker. Needs the package sentence_transformers there."""

    def score(queries: list[str], contents: list[str]) -> list[float]:
        held = loaded(load).predict(list(zip(queries, contents)))
        return [float(x) for x in held]

    def load():
        return imported("sentence_transformers").CrossEncoder(name)

    return model(score, batch=batch)


def model(score: Callable[[list[str], list[str]], list[float]], squash: bool = True, batch: int = 16) -> Reranker:
    """A reranker around a model that scores lists of queries and contents; logits are squashed unless told otherwise."""

    @F.pandas_udf("double")
    def scored(query: pd.Series, content: pd.Series) -> pd.Series:
        q, c = query.tolist(), content.tolist()
        return pd.Series([float(x) for a in range(0, len(q), batch) for x in score(q[a : a + batch], c[a : a + batch])])

    def run(hits: DataFrame, top_k: int) -> DataFrame:
        raw = hits.withColumn("original", F.col("score")).withColumn("score", scored("query", "content")).drop("rank")
        return top(raw.withColumn("score", sigmoid("score")) if squash else raw, top_k)

    return run
