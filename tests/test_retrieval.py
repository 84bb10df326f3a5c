import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heronry.functions.text import split_sentences
from heronry.operators import chunking, embedding, fusion, index, metrics, rerank, retrieve, sparse
from heronry.plans import adapt
from heronry.plans.engine import Engine, evaluate
from heronry.plans.server import Service, engine_of
from heronry.plans.trace import BoundedCache, Tracer, TraceStore
from heronry.sources import beir
from heronry.sources.store import ContextCache, Store
from heronry.streaming.ingest import ingest

DOCS = "id string, content string, metadata map<string,string>"
CORPUS = [
    ("pool", "Connection pooling in a database. A pooler multiplexes clients in transaction mode."),
    ("vacuum", "Vacuum reclaims dead tuples and prevents bloat in the background."),
    ("vector", "A vector index serves similarity search. Graphs and lists are its kinds."),
    ("cache", "A cache bounds staleness with a lifetime. Eviction of old entries is common."),
    ("probe", "Liveness probes restart unhealthy containers. Readiness probes gate traffic."),
    ("budget", "A disruption budget protects availability while nodes drain."),
    ("overload", "HTTP 503 Service Unavailable tells of overload. Clients should retry later."),
    ("limit", "HTTP 429 Too Many Requests is the answer of a rate limit."),
    ("borrow", "The borrow checker forbids aliasing with mutation at compile time."),
    ("lock", "A global interpreter lock serializes bytecode. Threads still help for waiting."),
]
ASKED = [("How do I configure connection pooling in a database?", "pool"), ("bloat from dead tuples", "vacuum"), ("vector similarity search", "vector"), ('"liveness probes"', "probe"), ("503 Service Unavailable", "overload"), ("rate limit answer", "limit"), ("borrow checker", "borrow"), ("global interpreter lock", "lock"), ("cache eviction", "cache"), ("what is a disruption budget", "budget")]


def docs(spark, rows=CORPUS):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else {}) for r in rows], DOCS)


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, trace_store=TraceStore(5))
    assert e.index(docs(spark))["documents"] == 10
    return e


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")


def test_fixed_chunks(spark):
    rows = chunking.fixed(4, 1)(docs(spark, [("a", "abcdefgh", {}), ("b", "", {}), ("c", "      x", {})])).orderBy("id").collect()
    assert [(r["id"], r["content"]) for r in rows] == [("a:0", "abcd"), ("a:1", "defg"), ("a:2", "gh"), ("c:0", "x"), ("c:1", "x")] or [(r["id"], r["content"]) for r in rows if r["document_id"] == "a"] == [("a:0", "abcd"), ("a:1", "defg"), ("a:2", "gh")]
    with pytest.raises(ValueError):
        chunking.fixed(4, 4)


def test_both_ways_to_pack_agree(spark):
    text = " ".join(f"Sentence {'x' * (i * 37 % 90)} number {i}." for i in range(80))
    df = docs(spark, [("a", text, {}), ("b", "One. Two.", {}), ("c", "x" * 50, {})])
    fold = df.select("id", F.posexplode(chunking.pack(split_sentences("content"), 200, 400)).alias("i", "c"))
    quick = chunking.sentences(200, 400)(df)
    assert sorted((r["id"], r["i"], r["c"]) for r in fold.collect()) == sorted((r["document_id"], r["index"], r["content"]) for r in quick.collect())


def test_metadata_and_context(spark):
    df = docs(spark, [("d", "Some text.", {"title": "T", "topic": "", "lang": "fr", "other": "o"})])
    got = chunking.metadata(chunking.fixed())(df).first()["content"]
    assert got == "[d | title: T | lang: fr]\nSome text."
    asked = []

    def provider(documents, chunks):
        asked.extend(chunks)
        return [" said " if "Some" in c else " " for c in chunks]

    one = chunking.contextual(chunking.fixed(), provider)(df).first()["content"]
    assert one == "said\n\nSome text."
    q = chunking.questions(chunking.fixed(), lambda texts: [["Why? ", "Why?", ""] for _ in texts])(df).first()["content"]
    assert q == "Some text.\n\nQuestions answered:\n- Why?"
    tags = chunking.tagged(chunking.fixed()(docs(spark, [("a", "мир", {}), ("b", "мир", {"lang": "xx"})])), docs(spark, [("a", "мир", {}), ("b", "мир", {"lang": "xx"})])).orderBy("id").collect()
    assert [t["lang"] for t in tags] == ["ru", "xx"]


def test_semantic_chunks(spark):
    def topics(df, text, vector):
        return df.withColumn(vector, F.array(*(F.contains(F.col(text), F.lit(t)).cast("double") for t in ("alpha", "beta"))))

    df = docs(spark, [("a", "The alpha one. An alpha two. Now beta three. And beta four.", {})])
    assert [r["content"] for r in chunking.semantic(topics)(df).orderBy("index").collect()] == ["The alpha one. An alpha two.", "Now beta three. And beta four."]
    assert chunking.semantic(topics, most=20)(df).count() == 4


def test_hash_embedder_in_both_ways(spark):
    df = docs(spark)
    rows = embedding.hash_embedder()(df, "content", "v").withColumn("w", embedding.hashed("content")).collect()
    for r in rows:
        assert max(abs(a - b) for a, b in zip(r["v"], r["w"])) < 1e-12 and abs(sum(x * x for x in r["v"]) - 1) < 1e-9
    zero = embedding.hash_embedder()(docs(spark, [("e", "...", {})]), "content", "v").first()["v"]
    assert zero == [0.0] * 64
    model = embedding.model_embedder(lambda: lambda texts: [[float(len(t))] for t in texts], "q: ", 2)
    assert model(docs(spark, CORPUS[:3]), "content", "v").first()["v"] == [len(CORPUS[0][1]) + 3.0]
    with pytest.raises(Exception, match="dimension"):
        embedding.checked(zero_df(spark), "v", 3).collect()


def zero_df(spark):
    return spark.createDataFrame([([1.0],)], "v array<double>")


def test_upsert_and_delete(spark):
    base = chunking.fixed()(docs(spark, [("a", "one", {}), ("b", "two", {})]))
    new = base.where("id = 'a:0'").withColumn("content", F.lit("x")).withColumn("at", F.lit(1))
    later = new.withColumn("content", F.lit("y")).withColumn("at", F.lit(2))
    out = index.upsert(base, new.unionByName(later), "at")
    assert {(r["id"], r["content"]) for r in out.collect()} == {("a:0", "y"), ("b:0", "two")}
    assert index.count(index.delete(out, spark.createDataFrame([("b:0",)], "id string"))) == 1 and index.count(index.clear(out)) == 0


def test_bm25(spark):
    chunks = spark.createDataFrame([("a", "the vacuum runs"), ("b", "vacuums run"), ("c", "")], "id string, content string")
    q = spark.createDataFrame([(1, "vacuum"), (2, "the"), (3, "zzz")], "query_id long, query string")
    plain = retrieve.bm25_topk(q, index.build(chunks)).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in plain} == {(1, "a"), (2, "a")}
    stemmed = retrieve.bm25_topk(q, index.build(chunks, True, True)).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in stemmed} == {(1, "a"), (1, "b")}
    assert index.build(chunks).stats.first()["n"] == 3


def test_vectors(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0], {"l": "1"}), ("b", [0.6, 0.8], {"l": "2"}), ("c", [1.0, 0.0], {}), ("d", None, {}), ("e", [0.0, 0.0], {})], "id string, embedding array<double>, metadata map<string,string>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    want = [(1, "a", 1), (1, "c", 2), (2, "b", 1), (2, "a", 2)]
    by_matrix = retrieve.vector_topk(q, c, 2)
    by_join = retrieve.top(retrieve.vector_scores(q, c), 2)
    for df in (by_matrix, by_join):
        assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in df.orderBy("query_id", "rank").collect()] == want
    own = q.withColumn("filter", F.create_map(F.lit("l"), F.lit("2")))
    assert [(r["query_id"], r["chunk_id"]) for r in retrieve.vector_topk(own, c, 2).orderBy("query_id").collect()] == [(1, "b"), (2, "b")]
    assert {(r["query_id"], r["chunk_id"]) for r in retrieve.lsh_topk(q, c, 1, tables=20).collect()} == {(1, "a"), (2, "b")}
    assert retrieve.vector_topk(q, c.limit(0), 2).count() == 0


def test_boost_and_contained(spark):
    chunks = spark.createDataFrame([("a", "exit code 137"), ("b", "code exit 137")], "id string, content string")
    q = spark.createDataFrame([(1, "Exit code 137")], "query_id long, query string")
    rows = retrieve.bm25_topk(q, index.build(chunks)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "b"] and rows[0]["score"] / rows[1]["score"] == pytest.approx((1 + 0.15 * 7) / 1)
    assert [r["score"] for r in retrieve.contained_topk(q, chunks).collect()] == [1.0, 1.0]


def test_fusion(spark):
    v, k = hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.5, 2)]), hits(spark, [(1, "a", 7.0, 1), (1, "c", 3.0, 2)])
    rows = fusion.fuse(v, k, 0.5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "b", "c"] and rows[0]["score"] == pytest.approx(1 / 61) and rows[1]["keyword_score"] is None
    assert fusion.fuse(v, k, 7.0).where("chunk_id = 'c'").first()["score"] == 0
    assert fusion.top_gap(v).first()["gap"] == 1.0 and fusion.top_gap(hits(spark, [(1, "a", 1.0, 1)])).first()["gap"] == 0.0
    three = hits(spark, [(1, "a", 1.0, 1), (1, "b", 0.9, 2), (1, "c", 0.0, 3)])
    w = fusion.adaptive_weights(spark.createDataFrame([(1, 0.5)], "query_id long, weight double"), v, three).first()["weight"]
    assert w == pytest.approx(0.7)
    assert fusion.compose_filter({"lang": "fr"}, "ja") == {"lang": "fr"} and fusion.compose_filter(None, None) is None and fusion.compose_filter({"a": "b"}, "ja") == {"lang": "ja", "a": "b"}
    assert fusion.prefetch(3) == 20 and fusion.prefetch(10) == 40
    assert fusion.alpha_blend(v, k, 0.25, 1).first()["score"] == pytest.approx(0.25 * 0.9 + 0.75 * 7)
    assert fusion.server_side(v, k, 2).count() == 2


def test_sparse(spark):
    corpus = spark.createDataFrame([("1", "red apple apple"), ("2", "red car"), ("3", "")], "id string, content string")
    encoder = sparse.SparseEncoder.fit(corpus)
    vocabulary = {r["term"]: (r["idx"], r["df"]) for r in encoder.vocabulary.collect()}
    assert vocabulary == {"red": (0, 2), "appl": (1, 1), "car": (2, 1)}
    rows = {r["id"]: r for r in encoder.encode(corpus.union(spark.createDataFrame([("9", "unknown words")], "id string, content string")), "content").collect()}
    assert rows["1"]["indices"] == [0, 1] and rows["1"]["values"][1] > rows["1"]["values"][0] and rows["9"]["indices"] == []
    q = encoder.weights(spark.createDataFrame([(1, "apples")], "query_id long, t string"), "t", "query_id")
    d = encoder.weights(corpus, "content", "id").withColumnRenamed("id", "chunk_id")
    assert [r["chunk_id"] for r in sparse.sparse_topk(q, d).collect()] == ["1"]


def pool(spark, rows, query="red apple"):
    return spark.createDataFrame([(1, query, c, t, s, i + 1) for i, (c, t, s) in enumerate(rows)], "query_id long, query string, chunk_id string, content string, score double, rank int")


def test_rerankers(spark):
    rows = [("a", "blue car", 0.5), ("b", "red apple", 0.5), ("c", "red " + "x " * 300 + "apple", 0.5)]
    out = rerank.heuristic(pool(spark, rows), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["b", "c", "a"] and out[0]["proximity"] == pytest.approx(1 - 1 / 200) and out[1]["proximity"] == 0
    assert rerank.heuristic(pool(spark, rows, "is the"), 2).count() == 2
    three = pool(spark, [("a", "one two", 0.9), ("b", "one two", 0.85), ("c", "three four", 0.5)])
    order = lambda w: [r["chunk_id"] for r in rerank.mmr(w)(three, 3).orderBy("rank").collect()]
    assert order(1.0) == ["a", "b", "c"] and order(0.3) == ["a", "c", "b"]
    model = rerank.model(lambda q, c: [float(len(x)) for x in c], squash=False)
    assert rerank.cascaded([(rerank.heuristic, 2), (model, 9)])(pool(spark, rows), 1).first()["chunk_id"] == "c"
    with pytest.raises(ValueError):
        rerank.cascaded([])


def test_metrics(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id long, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "y", 1), (3, "z", 0)], "query_id long, doc_id string, rel int")
    rows = {r["query_id"]: r for r in metrics.per_query(results, qrels).collect()}
    from math import log2

    ideal = 1 + 1 / log2(3)
    assert rows[1]["ndcg"] == pytest.approx((1 / log2(3) + 1 / log2(4)) / ideal) and rows[1]["mrr"] == 0.5 and rows[1]["recall"] == 1.0
    assert (rows[2]["ndcg"], rows[2]["mrr"], rows[2]["recall"]) == (0, 0, 0) and 3 not in rows
    graded = metrics.per_query(results, qrels, graded=True).where("query_id = 1").first()["ndcg"]
    assert graded == pytest.approx((3 / log2(3) + 1 / log2(4)) / (3 + 1 / log2(3)))
    chunks = spark.createDataFrame([(1, "d", 1), (1, "e", 2), (1, "d", 3), (1, "f", 4)], "query_id long, document_id string, rank int")
    assert [(r["doc_id"], r["rank"]) for r in metrics.by_document(chunks).orderBy("rank").collect()] == [("d", 1), ("e", 2), ("f", 3)]
    p = metrics.percentiles(spark.createDataFrame([("g", float(v)) for v in range(1, 101)], "k string, v double"), "v", ["k"]).first()
    assert (p["p50"], p["p95"], p["p99"], p["n"]) == (51.0, 96.0, 100.0, 100)


def test_engine_finds(spark, engine):
    q = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ASKED)], "query_id long, query string")
    qrels = spark.createDataFrame([(i, d, 1) for i, (_, d) in enumerate(ASKED)], "query_id long, doc_id string, rel int")
    out = engine.search(q)
    assert "embedding" not in out.results.columns
    scores = metrics.per_query(metrics.by_document(out.results), qrels)
    assert scores.agg(metrics.mean("ndcg")).first()[0] > 0.65
    assert out.results.select("query_id").distinct().count() == len(ASKED)
    assert engine.trace_store.size >= 1 and engine.trace_store.list()[0]["id"] == out.trace["id"]
    found = evaluate(Engine(spark), docs(spark), q.withColumn("category", F.lit("c")), qrels)
    assert "all queries" in metrics.report(found["groups"], found["strategies"])


def test_engine_reranks_from_a_pool(spark):
    e = Engine(spark, reranker=rerank.heuristic)
    e.index(docs(spark))
    out = e.search("cache eviction", top_k=40)
    d = out.decisions.first()["decision"]
    assert d["strategy"] == "keyword" and d["reranked"] and out.results.count() > 2
    assert out.results.where("rank = 1").first()["document_id"] == "cache"
    assert e.search("cache eviction", latency_budget_ms=100.0).decisions.first()["decision"]["reranked"] is False
    assert e.search("cache eviction", min_score=10.0).results.count() == 0


def test_language_filter_and_ad_hoc(spark):
    rows = [("en1", "connection pool settings", {}), ("ja1", "接続 プール の 設定", {}), ("fr1", "réglages du pool", {"lang": "fr"})]
    e = Engine(spark, auto_language_filter=True)
    e.index(docs(spark, rows))
    out = e.search("接続 プール の")
    assert {r["document_id"] for r in out.results.collect()} == {"ja1"} and out.decisions.first()["language_filter"] == "ja"
    gone = e.search("настройка пула")
    assert gone.results.count() > 0 and gone.decisions.first()["language_filter_dropped"]
    assert {r["document_id"] for r in e.search("接続 プール の", filter={"lang": "fr"}).results.collect()} == {"fr1"}
    own = docs(spark, [("x", "alpha beta", {}), ("y", "gamma", {})])
    assert e.search("alpha", own, top_k=1).results.first()["document_id"] == "x"
    assert e.search("gamma", own).trace["ad_hoc_cache_hit"]
    with pytest.raises(ValueError):
        Engine(spark).search("x")


def test_shapes(spark, engine):
    found = engine.search("vacuum", top_k=2).results
    d = adapt.as_documents(found).first()
    assert d["metadata"]["documentId"] == "vacuum" and "score" in d["metadata"]
    assert adapt.as_nodes(found).first()["node"]["id_"] == "vacuum:0"
    tool = adapt.as_tool(engine.search)
    assert tool["execute"]("vacuum")[0]["documentId"] == "vacuum" and tool["parameters"]["required"] == ["query"]


def test_service(spark):
    s = Service(Engine(spark), "secret")
    key = {"Authorization": "Bearer secret"}
    assert s.call("GET", "/health") == (200, {"status": "ok"}) and s.call("GET", "/openapi.json")[0] == 200
    assert s.call("POST", "/search", b"{}")[0] == 401
    assert s.call("POST", "/index", b"[]", key)[0] == 400 and s.call("POST", "/search", b'{"query": 3}', key)[0] == 400
    body = json.dumps({"documents": [{"id": i, "content": t, "metadata": {"n": 1}} for i, t in CORPUS[:3]]}).encode()
    assert s.call("POST", "/index", body, key)[1]["chunks"] == 3
    status, found = s.call("POST", "/search", json.dumps({"query": "vacuum", "topK": 1}).encode(), key)
    assert status == 200 and found["results"][0]["document_id"] == "vacuum" and found["trace"]["decision"]["strategy"] == "keyword"
    id_ = found["trace"]["id"]
    assert s.call("GET", f"/traces/{id_}", b"", key)[0] == 200 and s.call("GET", "/traces/none", b"", key)[0] == 404
    assert len(s.call("GET", "/traces?limit=0", b"", key)[1]["traces"]) == 1
    assert s.call("GET", "/admin/stats", b"", key)[1]["chunks"] == 3
    assert s.call("POST", "/admin/clear", b"", key)[0] == 200 and s.call("GET", "/admin/stats", b"", key)[1]["chunks"] == 0
    assert s.call("DELETE", "/traces", b"", key)[0] == 200
    open_ = Service(Engine(spark))
    assert open_.call("POST", "/admin/clear")[0] == 503 and open_.call("GET", "/traces")[0] == 200


def test_traces_and_caches():
    store = TraceStore(2)
    for i in "abc":
        store.push({"id": i})
    assert [t["id"] for t in store.list()] == ["c", "b"] and store.get("a") is None
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            TraceStore(bad)
    gone = []
    cache = BoundedCache(2, gone.append)
    cache.set("a", 1), cache.set("b", 2), cache.get("a"), cache.set("c", 3)
    assert gone == [2] and "a" in cache and len(cache) == 2
    t = Tracer("q")
    with pytest.raises(KeyError), t.span("x"):
        raise KeyError("no")
    assert t.finish()["spans"][0]["attributes"]["error"] == "'no'"


def test_sources(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(r) for r in ({"_id": "d1", "title": "T", "text": "x"}, {"_id": "d2", "text": "y"})))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": q, "text": q}) for q in ("q1", "q2")))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq2\td2\t0\n")
    corpus, queries, qrels = beir.load(spark, str(tmp_path))
    assert {r["content"] for r in corpus.collect()} == {"T\n\nx", "y"} and [r["query_id"] for r in queries.collect()] == ["q1"] and qrels.first()["rel"] == 2
    chunks = embedding.hash_embedder()(chunking.fixed()(docs(spark)), "content", "embedding")
    for kind in ("parquet", "json"):
        store = Store(spark, f"{tmp_path}/{kind}", kind, 64)
        store.upsert(chunks), store.upsert(chunks.limit(2))
        store.delete(spark.createDataFrame([("pool:0",)], "id string"))
        assert store.count() == 9
        store.clear()
        assert store.count() == 0
    with pytest.raises(Exception, match="dimension"):
        Store(spark, f"{tmp_path}/bad", dimension=3).upsert(chunks)
    with pytest.raises(ValueError):
        Store(spark, "x", dimension=0)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": i, "content": t}) for i, t in CORPUS[:4]))
    store = Store(spark, f"{tmp_path}/out")
    for _ in range(2):
        ingest(Engine(spark), store, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination(120)
    assert store.count() == 4


def test_approximate_search_finds_nearly_all_at_any_length(spark):
    import numpy as np

    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(300, 32))
    v *= (10.0 ** rnd.uniform(-1, 2, 300) / np.sqrt((v * v).sum(1)))[:, None]
    chunks = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "id string, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:40])], "query_id long, vector array<double>")
    exact, near = ({(r["query_id"], r["chunk_id"]) for r in search(asked, chunks, 10).collect()} for search in (retrieve.vector_topk, retrieve.lsh_topk))
    assert len(exact & near) >= 0.9 * len(exact)


class Always:
    """A router that searches by words alone."""

    name = "always-keyword"

    def __call__(self, signals, force, budget_ms, caps, has_reranker):
        return F.struct(F.lit("keyword").alias("strategy"), F.array(F.lit("as ever")).alias("reasons"), F.lit(False).alias("reranked"))


def test_router_and_parameters_of_bm25(spark):
    e = Engine(spark, router=Always(), k1=0.0, b=0.0)
    rows = [("a", "pool pool pool", {}), ("b", "pool and more words than that", {}), ("b", "the last of two pool", {})]
    assert e.index(docs(spark, rows))["chunks"] == 2  # of two documents with the same id the last stays
    out = e.search("what is a pool and how does it work")
    assert out.decisions.first()["decision"]["strategy"] == "keyword" and out.trace["router"] == "always-keyword"
    found = {r["document_id"]: r for r in out.results.collect()}
    assert found["b"]["content"] == "the last of two pool" and found["a"]["score"] == found["b"]["score"]  # k1 = 0: a term counts once
    assert {s["name"] for s in out.trace["spans"]} == {"route", "search:keyword", "results"}


def test_stored_postings_and_segments(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", indexed=True)
    store.migrate(), store.migrate()
    with pytest.raises(ValueError, match="was made with"):
        Store(spark, f"{tmp_path}/s", dimension=4).migrate()
    chunks = chunking.fixed()(docs(spark))
    store.upsert(chunks)
    store.upsert(chunks.where("document_id in ('pool', 'lock')").withColumn("content", F.lit("changed words")))
    store.delete(spark.createDataFrame([("cache:0",)], "id string"))

    def same():
        got, want = store.index(), index.build(store.read())
        assert Counter(r["id"] for r in got.chunks.select("id").collect()) == Counter(f"{d}:0" for d, _ in CORPUS if d != "cache")
        assert sorted(map(tuple, got.postings.select("term", "chunk_id", "doc_len", "tf").collect())) == sorted(map(tuple, want.postings.select("term", "chunk_id", "doc_len", "tf").collect()))
        assert got.stats.first() == want.stats.first()

    same()
    store.compact()
    same()
    e = Engine(spark, router=Always())
    e.attach(store.read(), store.index().postings)
    assert {r["document_id"] for r in e.search("changed").results.collect()} == {"pool", "lock"}


def test_contexts_are_asked_once(spark, tmp_path):
    cache, asked = ContextCache(spark, f"{tmp_path}/contexts"), f"{tmp_path}/asked"

    def provider(documents, chunks):
        with open(asked, "a") as f:
            f.write("".join(c[:4] + "\n" for c in chunks))
        return ["seen" for _ in chunks]

    chunker = chunking.contextual(chunking.fixed(), provider, cache)
    for rows in (CORPUS[:3], CORPUS[1:5]):
        assert all(r["content"].startswith("seen\n\n") for r in chunker(docs(spark, rows)).collect())
    assert sorted(open(asked).read().split("\n")[:-1]) == sorted(t[:4] for _, t in CORPUS[:5]) and cache.read().count() == 5


def test_embedder_that_fits_once(spark):
    fits = []
    e = embedding.FitOnce(lambda df, text: fits.append(df.count()) or embedding.hash_embedder(8))
    for rows in (CORPUS[:2], CORPUS):
        assert all(len(r["v"]) == 8 for r in e(docs(spark, rows), "content", "v").collect())
    assert fits == [2]


def test_percentiles_of_one_value_that_most_rows_have(spark):
    rows = [("a", 5.0)] * 900 + [("a", float(i)) for i in range(100)] + [("b", 1.0), ("c", None)]
    got = {r["k"]: r for r in metrics.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(7), "v", ["k"]).collect()}
    v = sorted(x for k, x in rows if k == "a")
    assert (got["a"]["n"], got["a"]["p50"], got["a"]["p95"], got["a"]["p99"]) == (1000, v[500], v[950], v[990]) and got["b"]["p99"] == 1.0 and set(got) == {"a", "b"}


def test_judgements_for_all_queries(spark):
    results = spark.createDataFrame([(q, d, i + 1) for q in (1, 2) for i, d in enumerate("abc" if q == 1 else "xab")], "query_id long, doc_id string, rank int")
    shared = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0), ("z", 2)], "doc_id string, rel int")
    each = shared.crossJoin(spark.createDataFrame([(1,), (2,)], "query_id long"))
    for graded in (False, True):
        one, two = (sorted(map(tuple, metrics.per_query(results, q, 2, graded).collect())) for q in (shared, each))
        assert [[pytest.approx(x) for x in r] for r in one] == [list(r) for r in two]


def test_traces_are_saved(spark, tmp_path):
    store = TraceStore(3)
    for q in "abcd":
        store.push(Tracer(q).finish())
    assert store.save(spark, f"{tmp_path}/t") == 3 and store.save(spark, f"{tmp_path}/t") == 3
    assert {json.loads(r["trace"])["query"] for r in spark.read.parquet(f"{tmp_path}/t").collect()} == set("bcd")


def test_description_of_the_service(spark):
    s = Service(Engine(spark))
    spec, doc = s.call("GET", "/openapi.json")[1], s.call("GET", "/docs")[1]
    search = spec["paths"]["/search"]["post"]
    fields = search["requestBody"]["content"]["application/json"]["schema"]
    assert fields["required"] == ["query"] and "minScore" in fields["properties"] and "401" in search["responses"] and doc.startswith("<!doctype html>") and "/traces/{id}" in doc
    with pytest.raises(ValueError, match="profile"):
        engine_of(spark, profile="none")
    with pytest.raises(ImportError, match="is needed to run local models"):
        embedding.imported("no_such_package_of_models")


def test_spotted_words_in_slices(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "SMALL", 2)
    chunks = spark.createDataFrame([("a", "One two three"), ("b", "twofold"), ("c", None)], "id string, content string")
    wanted = spark.createDataFrame([("two",), ("one",), ("three",), ("old",), ("zzz",)], "word string")
    assert Counter(map(tuple, retrieve.spotted(chunks, wanted).collect())) == Counter([("a", "one"), ("a", "two"), ("a", "three"), ("b", "two"), ("b", "old")])
    assert retrieve.spotted(chunks, wanted.limit(0)).count() == 0
