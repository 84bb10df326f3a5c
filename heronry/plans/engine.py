"""The engine: documents are indexed, batches of queries routed, retrieved, fused and reranked. A single query is a batch of one."""

from __future__ import annotations

import time
import weakref
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators import chunking, fusion, metrics, retrieve
from ..operators.embedding import Embedder, hash_embedder
from ..operators.index import Index, build, clear, delete, last_of, of_postings, upsert
from ..operators.rerank import Reranker
from ..operators.router import PROFILES, Capabilities, HeuristicRouter, Router
from ..operators.signals import signals
from .trace import BoundedCache, Tracer, TraceStore

#: Hits of each side and of the fused pool from which reranking takes its results; hits of a side of a hybrid search for each asked for.
POOL_SIDE, POOL, HYBRID_SIDE = 50, 30, 4
QUERY_FIELDS = {"top_k": "int", "force_strategy": "string", "latency_budget_ms": "double", "filter": "map<string,string>", "min_score": "double"}


@dataclass
class Response:
    """results: (query_id, rank, chunk_id, document_id, content, index, metadata, score, vector_score, keyword_score); decisions:
    (query_id, query, signals, decision, language_filter, language_filter_dropped)."""

    results: DataFrame
    decisions: DataFrame
    trace: dict[str, Any] = field(default_factory=dict)


def materialized(df: DataFrame) -> DataFrame:
    """df persisted on executors' memory and disk, and computed, so that the plans that read it know its size. A lost part is computed again."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        embedder: Embedder | None = None,
        chunker: chunking.Chunker | None = None,
        reranker: Reranker | None = None,
        capabilities: Capabilities = PROFILES["in-memory"],
        always_rerank: bool = True,
        auto_language_filter: bool = False,
        stemmed: bool = False,
        drop_stopwords: bool = False,
        trace_store: TraceStore | None = None,
        ad_hoc_cache_size: int = 8,
        keep: Callable[[DataFrame], DataFrame] | None = None,
        router: Router | None = None,
        query_embedder: Embedder | None = None,
        k1: float = retrieve.K1,
        b: float = retrieve.B,
        digits: int = 12,
    ):
        """keep: what makes a table that is used again; by default it is persisted, and freed when nothing uses it any more.

        router: decides in place of the rules (see router.Router). query_embedder: embeds queries where they need another way than
        documents, as models with instructions do. k1 and b are those of BM25. Scores are rounded to `digits` before they are ranked.
        """
        self.spark, self.embedder, self.chunker, self.reranker = spark, embedder or hash_embedder(), chunker or chunking.sentences(), reranker
        self.query_embedder, self.router, self.k1, self.b, self.digits = query_embedder or self.embedder, router or HeuristicRouter(always_rerank), k1, b, digits
        self.capabilities, self.always_rerank, self.auto_language_filter = capabilities, always_rerank, auto_language_filter
        self.stemmed, self.drop_stopwords, self.trace_store = stemmed, drop_stopwords, trace_store
        self.keep = keep or materialized
        self.data: Index | None = None
        self._ad_hoc = BoundedCache(ad_hoc_cache_size, _forget) if ad_hoc_cache_size else None

    # ---- index

    def chunked(self, docs: DataFrame) -> DataFrame:
        """Chunks of documents (id, content, metadata), with their language and embedding."""
        return self.embedder(chunking.tagged(self.chunker(docs), docs), "content", "embedding")

    def _built(self, chunks: DataFrame, unique: bool = False) -> Index:
        index = build(chunks, self.stemmed, self.drop_stopwords, keep=self.keep, unique=unique)
        index.terms, index.stats = self.keep(index.terms), self.keep(index.stats)
        return index

    def _replace(self, chunks: DataFrame) -> None:
        """The index becomes one of `chunks`, a kept table; what the old one held is freed."""
        old, self.data = self.data, self._built(chunks, unique=True)  # of documents that repeat an id one stays
        if old:
            _forget(old)

    def index(self, docs: DataFrame, whole_documents: bool = False, order: str | None = None) -> dict[str, Any]:
        """Adds documents; chunks of the same id are replaced, with whole_documents all chunks of the same document.

        Of documents that repeat an id the last by column `order` stays; without one, the last as the rows of docs are numbered, which
        is their order in a list or file.
        """
        began = time.perf_counter()
        last = last_of(docs, order)
        new = self.keep(self.chunked(last))
        n = new.count()
        middle = time.perf_counter()
        if self.data is None:
            self._replace(new)
        else:
            self._replace(self.keep(upsert(self.data.chunks, new, whole_documents=whole_documents)))
            new.unpersist()
        end = time.perf_counter()
        return {"documents": docs.count(), "chunks": n, "trace": {"chunking_ms": (middle - began) * 1000, "upsert_ms": (end - middle) * 1000, "total_ms": (end - began) * 1000}}

    def attach(self, chunks: DataFrame, postings: DataFrame | None = None) -> None:
        """Serves chunks that are stored elsewhere, with their stored postings if there are any, without copying them."""
        old = self.data
        self.data = self._built(chunks) if postings is None else of_postings(chunks, postings, self.stemmed, self.drop_stopwords)
        if postings is not None:
            self.data.terms, self.data.stats = self.keep(self.data.terms), self.keep(self.data.stats)
        if old:
            _forget(old)

    def delete(self, ids: DataFrame) -> None:
        if self.data:
            self._replace(self.keep(delete(self.data.chunks, ids)))

    def clear(self) -> None:
        if self.data:
            self._replace(self.keep(clear(self.data.chunks)))

    def count(self) -> int:
        return self.data.chunks.count() if self.data else 0

    # ---- search

    def queries(self, queries: DataFrame | str, **fields: Any) -> DataFrame:
        """Requests with all their fields; those not given are null, top_k 10."""
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([(0, queries)], "query_id long, query string")
        for name, kind in QUERY_FIELDS.items():
            value = fields.get(name)
            if name not in queries.columns:
                given = F.create_map(*(F.lit(str(x)) for kv in value.items() for x in kv)) if isinstance(value, dict) and value else F.lit(None if isinstance(value, dict) else value)
                queries = queries.withColumn(name, given.cast(kind))
        return queries.withColumn("top_k", F.coalesce("top_k", F.lit(10)))

    def decisions(self, queries: DataFrame) -> DataFrame:
        rows = queries.withColumn("signals", signals("query"))
        made = self.router(F.col("signals"), F.col("force_strategy"), F.col("latency_budget_ms"), self.capabilities, self.reranker is not None)
        auto = F.when(F.lit(self.auto_language_filter) & (F.col("signals.language") != "en") & ~F.coalesce(F.map_contains_key("filter", F.lit("lang")), F.lit(False)), F.col("signals.language"))
        return rows.withColumn("decision", made).withColumn("language_filter", auto)

    def candidates(self, asked: DataFrame, index: Index, tracer: Tracer | None = None, held: list[DataFrame] | None = None) -> DataFrame:
        """What retrieval finds for decided queries: (query_id, chunk_id, score, rank, vector_score, keyword_score).

        Only the searches that some query needs are planned. Tables that are kept on the way are added to `held`.
        """
        caps, tracer, held = self.capabilities, tracer or Tracer("candidates"), [] if held is None else held
        again, kind = F.col("decision.reranked"), F.col("decision.strategy")
        mixed = again | (kind == "hybrid")
        side = F.when(again, POOL_SIDE).when(kind == "hybrid", F.col("top_k") * HYBRID_SIDE).otherwise(F.col("top_k"))
        rows = asked.withColumn("__side", side)
        any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
        told = rows.agg(F.max("__side"), any_(again), any_(mixed), any_(~mixed & kind.isin("vector", "rerank")), any_(~mixed & (kind == "keyword"))).first()
        most, (pooled, fused_any, dense, lexical) = max(told[0] or 1, 1), tuple(told)[1:]
        if lexical and not caps.keyword:
            raise ValueError("keyword search was forced on a store that has none")
        limit = rows.select("query_id", "__side")
        columns = ["query_id", "chunk_id", "score", "rank", "vector_score", "keyword_score"]

        def keep(df: DataFrame) -> DataFrame:
            held.append(self.keep(df))
            return held[-1]

        def cut(hits: DataFrame) -> DataFrame:
            return keep(hits.join(retrieve.small(limit), "query_id").where(F.col("rank") <= F.col("__side")).select("query_id", "chunk_id", "score", "rank"))

        def one(hits: DataFrame, name: str, kinds: tuple[str, ...]) -> DataFrame:
            own = hits.join(retrieve.small(rows.where(~mixed & kind.isin(*kinds)).select("query_id")), "query_id", "left_semi")
            return own.select("query_id", "chunk_id", "score", "rank", *(F.col("score").alias(c) if c == name else F.lit(None).cast("double").alias(c) for c in columns[4:]))

        empty = self.spark.createDataFrame([], asked.select("query_id").schema).join(index.chunks.select(F.col("id").alias("chunk_id")).limit(0), F.lit(True))
        empty = empty.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        vector = words = empty
        pool = "pool" if pooled else "search"
        if caps.vector and (fused_any or dense):
            with tracer.span("embed:query"):
                need = rows.where(mixed | kind.isin("vector", "rerank"))
                vectors = keep(self.query_embedder(need.select("query_id", "query", "filter"), "query", "vector"))
            with tracer.span(f"{pool}:vector"):
                vector = cut(retrieve.vector_topk(vectors, index.chunks, most, digits=self.digits))
        if caps.keyword and (fused_any or lexical):
            with tracer.span(f"{pool}:keyword"):
                need = rows.where(mixed | (kind == "keyword"))
                words = cut(retrieve.bm25_topk(need.select("query_id", "query", "filter"), index, most, k1=self.k1, b=self.b, digits=self.digits))
        parts = []
        if fused_any:
            with tracer.span("pool:hybrid" if pooled else "search:hybrid"):
                both = rows.where(mixed).select("query_id", "top_k", "decision", fusion.vector_weight(F.col("signals")).alias("weight"))
                weights = both.where(~again).select("query_id", "weight")
                if pooled:
                    weights = fusion.adaptive_weights(both.where(again), vector, words).unionByName(weights)
                most_of = both.select("query_id", F.when(again, POOL).otherwise(F.col("top_k")).alias("__k"))
                parts.append(fusion.fuse(vector, words, weights, clamped=False, digits=self.digits).join(retrieve.small(most_of), "query_id").where(F.col("rank") <= F.col("__k")).select(*columns))
        if dense:
            parts.append(one(vector, "vector_score", ("vector", "rerank")))
        if lexical:
            parts.append(one(words, "keyword_score", ("keyword",)))
        out = parts[0] if parts else empty.select("*", *(F.lit(None).cast("double").alias(c) for c in columns[4:]))
        for p in parts[1:]:
            out = out.unionByName(p)
        return keep(out)

    def search(self, queries: DataFrame | str, documents: DataFrame | None = None, **fields: Any) -> Response:
        """Results of all queries, computed. documents: searched alone, in an index made for this call and kept for the next ones."""
        tracer = Tracer(queries if isinstance(queries, str) else "batch")
        index, hit, held = self.data, None, []
        if documents is not None:
            with tracer.span("ad-hoc:index"):
                index, hit = self._scratch(documents)
        if index is None:
            raise ValueError("nothing is indexed")
        with tracer.span("route"):
            asked = self.keep(self.decisions(self.queries(queries, **fields)))
        held.append(asked)
        filtered = asked.withColumn("filter", fusion.composed(F.col("filter"), F.col("language_filter")))
        found = self.candidates(filtered, index, tracer, held)
        dropped = None
        if self.auto_language_filter:
            dropped = self.keep(asked.where(F.col("language_filter").isNotNull()).join(found, "query_id", "left_anti"))
            held.append(dropped)
            if dropped.limit(1).count():
                found = found.unionByName(self.candidates(dropped, index, tracer, held))
        content = index.chunks.select(F.col("id").alias("chunk_id"), "document_id", "content", "index", "metadata")
        again = F.col("decision.reranked")
        facts = asked.select("query_id", "query", "top_k", "min_score", again.alias("__again"))
        full = retrieve.small(found).join(content, "chunk_id").join(retrieve.small(facts), "query_id")
        rest = full.where(~F.col("__again") & (F.col("rank") <= F.col("top_k")))
        if self.reranker and asked.where(again).limit(1).count():
            with tracer.span("rerank"):
                most = asked.agg(F.max("top_k")).first()[0] or 10
                rest = rest.unionByName(self.reranker(full.where("__again"), most).where(F.col("rank") <= F.col("top_k")), allowMissingColumns=True)
        rest = rest.where(F.col("min_score").isNull() | (F.col("score") >= F.col("min_score")))
        said = asked.withColumn("language_filter_dropped", F.lit(False))
        if dropped is not None:
            gone = dropped.select("query_id", F.lit(True).alias("__d"))
            said = asked.join(gone, "query_id", "left").withColumn("language_filter_dropped", F.coalesce("__d", F.lit(False))).drop("__d")
        with tracer.span("results"):
            results = self.keep(rest.drop("__again", "query", "top_k", "min_score"))
            said = self.keep(said.select("query_id", "query", "signals", "decision", "language_filter", "language_filter_dropped"))
        for df in held:
            df.unpersist()
        trace = tracer.finish(router=self.router.name, ad_hoc=documents is not None, ad_hoc_cache_hit=bool(hit))
        if self.trace_store:
            self.trace_store.push(trace)
        out = Response(results, said, trace)
        weakref.finalize(out, _freed, results, said)
        return out

    def _scratch(self, documents: DataFrame) -> tuple[Index, bool]:
        key = fingerprint(documents) if self._ad_hoc is not None else None
        if key and key in self._ad_hoc:
            return self._ad_hoc.get(key), True
        index = self._built(self.keep(self.chunked(documents)))
        if key:
            self._ad_hoc.set(key, index)
        return index, False

    def describe(self) -> dict[str, Any]:
        return {"status": "ok", "router": self.router.name, "capabilities": self.capabilities.__dict__, "chunks": self.count()}


def _forget(index: Index) -> None:
    _freed(index.chunks, index.postings, index.terms, index.stats)


def _freed(*tables: DataFrame) -> None:
    for df in tables:
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()


def evaluate(engine: Engine, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 10, graded: bool = False) -> dict[str, DataFrame]:
    """One batch search over all queries (query_id, query, category), and its per-query scores, their means and the strategies' shares."""
    engine.clear()
    engine.index(corpus)
    found = engine.search(queries.drop("category"), top_k=k)
    scores = metrics.per_query(metrics.by_document(found.results), qrels, k, graded)
    category = F.col("category") if "category" in queries.columns else F.lit(None).cast("string")
    facts = found.decisions.select("query_id", F.col("decision.strategy").alias("strategy")).join(queries.select("query_id", category.alias("category")), "query_id")
    return {"per_query": scores, "groups": metrics.grouped(scores, facts), "strategies": metrics.strategy_shares(facts)}
