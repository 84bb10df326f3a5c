"""Which retrieval a query gets: a chain of rules over its signals, the first that holds decides."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("vector", "keyword", "hybrid", "rerank")
#: A latency budget has room for reranking above so many milliseconds.
RERANK_MS = 800


@dataclass(frozen=True)
class Capabilities:
    """What a store can do; the plan follows from it."""

    vector: bool = True
    keyword: bool = True
    hybrid: bool = True
    computes_embeddings: bool = False
    filtering: bool = True

    @property
    def both(self) -> bool:
        return self.hybrid or (self.vector and self.keyword)


#: Capabilities of known kinds of stores.
PROFILES = {
    "in-memory": Capabilities(),
    "pgvector": Capabilities(),
    "turbopuffer": Capabilities(),
    "pinecone": Capabilities(keyword=False, hybrid=False),
    "pinecone+sparse": Capabilities(keyword=False),
    "qdrant": Capabilities(keyword=False, hybrid=False),
    "qdrant+sparse": Capabilities(),
    "chroma": Capabilities(keyword=False, hybrid=False),
    "sqlite-vec": Capabilities(keyword=False, hybrid=False),
    "json-file": Capabilities(filtering=False),
}


def router_name(always_rerank: bool = True) -> str:
    return "heuristic-v1" + ("" if always_rerank else "+fast-keyword")


def _rules(s: Column, caps: Capabilities) -> list[tuple[Column, Column, str]]:
    """(condition, reason, strategy) of each rule that looks at the query's words, in order."""
    n, kind = s["word_count"], s["question_type"]
    both = "hybrid" if caps.both else None
    what = F.when(s["has_date_or_version"], "date, version or RFC").otherwise("identifier without code syntax")
    text = F.lit
    return [
        (s["has_quoted_phrase"], text("quoted phrase: keyword"), "keyword"),
        (s["has_code_like"] & (n <= 6), text("short query with code-like syntax: keyword"), "keyword"),
        ((s["has_specific_tokens"] | s["has_date_or_version"]) & (n <= 6), F.concat(text("short query with "), what, text(": hybrid")), both or "keyword"),
        (n <= 2, text("very short query of two words at most: keyword"), "keyword" if caps.keyword else "vector"),
        (s["has_named_entity"] & (n <= 6) & ~s["is_question"], text("named entity: keyword"), "keyword"),
        ((kind == "procedural") & (n >= 5), text("procedural question, how or why: semantic"), "vector"),
        ((kind == "definitional") & (n >= 3), text("definitional question, what is: semantic"), "vector"),
        ((kind == "factoid") & (n >= 3), text("factoid question: hybrid"), "hybrid"),
        (s["is_question"] & (n >= 5), text("natural-language question: semantic"), "vector"),
        (s["ambiguity"] > 0.6, text("ambiguous query: semantic"), "vector"),
        (F.lit(True), text("default: hybrid"), both or "vector"),
    ]


def decide(signals: Column, force: Column | None = None, budget_ms: Column | None = None, caps: Capabilities = Capabilities(), has_reranker: bool = True, always_rerank: bool = True) -> Column:
    """STRUCT<strategy, reasons, reranked> of a query. A forced strategy goes past all checks."""
    force = F.lit(None).cast("string") if force is None else force
    strategy, reason, fallback = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, why, to in reversed(_rules(signals, caps)):
        down = to if (to != "hybrid" or caps.both) and (to != "keyword" or caps.keyword) else "vector"
        note = F.lit(None).cast("string") if down == to else F.lit(f"{to} not supported by the store, falling back to vector")
        strategy = F.when(F.coalesce(when, F.lit(False)), down).otherwise(strategy)
        reason = F.when(F.coalesce(when, F.lit(False)), why).otherwise(reason)
        fallback = F.when(F.coalesce(when, F.lit(False)), note).otherwise(fallback)
    foreign = signals["language"] != "en"
    strategy = F.when(foreign, "vector").otherwise(strategy)
    reason = F.when(foreign, F.concat(signals["language"], F.lit(" query: semantic search"))).otherwise(reason)
    fallback = F.when(~foreign, fallback)
    if not caps.keyword and not caps.hybrid:
        strategy, reason, fallback = F.lit("vector"), F.lit("the store is vector-only"), F.lit(None).cast("string")
    strategy = F.coalesce(force, strategy)
    reason = F.when(force.isNotNull(), F.concat(F.lit("forced strategy "), force)).otherwise(reason)
    fallback = F.when(force.isNull(), fallback)
    wanted = should_rerank(strategy, signals["has_negation"], budget_ms, always_rerank)
    reranked = wanted & F.lit(has_reranker)
    said = (
        F.when(reranked & F.lit(always_rerank) & (strategy == "keyword"), "always reranking: keyword results, too")
        .when(reranked & signals["has_negation"] & (strategy != "rerank"), "negation: reranking forced")
        .when(reranked, "reranking enabled, the latency budget allows it")
        .when(wanted, "reranking skipped, no reranker configured")
        .when(strategy != "keyword", "reranking skipped, latency budget")
    )
    return F.struct(strategy.alias("strategy"), F.array_compact(F.array(reason, fallback, said)).alias("reasons"), reranked.alias("reranked"))


class Router(Protocol):
    """What decides how queries are searched: a name, and a call that gives a STRUCT<strategy, reasons, reranked> column."""

    name: str

    def __call__(self, signals: Column, force: Column, budget_ms: Column, caps: Capabilities, has_reranker: bool) -> Column: ...


class HeuristicRouter:
    """The rules as a Router."""

    def __init__(self, always_rerank: bool = True):
        self.always_rerank, self.name = always_rerank, router_name(always_rerank)

    def __call__(self, signals: Column, force: Column, budget_ms: Column, caps: Capabilities, has_reranker: bool) -> Column:
        return decide(signals, force, budget_ms, caps, has_reranker, self.always_rerank)


def should_rerank(strategy: Column, negation: Column, budget_ms: Column | None, always_rerank: bool = True) -> Column:
    """The rerank strategy always does. Else within the budget, if always; if not, negation does in any case and keyword doesn't."""
    roomy = F.lit(True) if budget_ms is None else budget_ms.isNull() | (budget_ms > RERANK_MS)
    other = roomy if always_rerank else F.when(negation, True).when(strategy == "keyword", False).otherwise(roomy)
    return F.when(strategy == "rerank", True).otherwise(other)
