"""Queries sent to the chunks, against the joins that give the same hits."""

import random

import pytest
from pyspark.sql import functions as F

from heronry.operators import chunking, embedding, index, retrieve, scan, sparse
from heronry.sources.tables import written


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(5)
    rows = [(f"c{i}", " ".join(r.choices("the red blue apple car tree Of on".split(), k=r.randint(0, 9))), {"l": r.choice("xy"), "n": str(i % 3)}) for i in range(60)]
    return written(spark.createDataFrame([*rows, ("none", None, {}), ("copy", rows[0][1], None)], "id string, content string, metadata map<string,string>"), "chunks")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "the red apple", {"l": "x"}), (2, "tree tree car", {"l": "y", "n": "1"}), (3, "zzz", None), (4, "", {}), (5, "'blue car' of on the", None), (6, "red blue", {"l": "z"})]
    return spark.createDataFrame(rows, "query_id long, query string, filter map<string,string>")


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def of_joins(q, i, k, digits=9, **how):
    return found(retrieve.top(retrieve.joined_topk(q, i, k, digits=digits, **how), k))


@pytest.mark.parametrize("how", [{"boost": False}, {"boost": True}, {"boost": False, "all_terms": True}, {"boost": True, "keep": "1"}])
def test_queries_sent_to_chunks(spark, chunks, asked, how):
    i, how = index.build(chunks), how | ({"keep": F.col("metadata")["n"] == how["keep"]} if "keep" in how else {})
    want = of_joins(asked.drop("filter"), i, 4, **how)
    assert want and found(retrieve.bm25_topk(asked.drop("filter"), i, 4, digits=9, **how)) == want
    kept = index.build(chunks, keep=lambda df: written(df, "postings"))
    assert kept.stored and found(retrieve.bm25_topk(asked, kept, 4, digits=9, **how)) == of_joins(asked, i, 4, **how)


def test_no_pair_of_query_and_chunk_travels(spark, asked):
    many = spark.range(400, numPartitions=2).select(F.concat(F.lit("d"), "id").alias("id"), F.lit("the red apple of the tree").alias("content"))
    q = asked.drop("filter")
    rows = retrieve.query_terms(q, i := index.build(many)).withColumn("weight", F.lit(1.0))
    part = retrieve.best_by_terms(rows, i, 3, 9)
    assert part.count() <= part.rdd.getNumPartitions() * 3 * 5  # of 1600 pairs
    assert found(retrieve.bm25_topk(q, i, 3, boost=False, digits=9)) == of_joins(q, i, 3, boost=False)


def test_slices_of_queries_and_repeated_ids(spark, chunks, asked, monkeypatch):
    monkeypatch.setattr(retrieve, "PAIRS", 3)
    i = index.build(chunks)
    assert found(retrieve.bm25_topk(asked, i, 4, digits=9)) == of_joins(asked, i, 4)
    twice = index.build(chunks.unionAll(chunks.limit(5)))
    assert found(retrieve.bm25_topk(asked, twice, 4, digits=9)) == of_joins(asked, twice, 4)


def test_small_tiles_and_many_hits():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    best, seen = scan.Best(3, 5, 1), []
    best.most = 20
    for _ in range(50):
        q, s, ids = r.integers(0, 3, 30), r.random(30), [f"{x:02}" for x in r.integers(0, 99, 30)]
        best.add(q, s, pa.array(ids))
        seen += zip(q, -np.round(s, 1), ids)
    rows = [b for b in best.rows(pa.array([7, 8, 9]))]
    got = sorted((q, -round(s, 1), i) for b in rows for q, i, s in zip(*(c.to_pylist() for c in b.columns)))
    assert got == sorted((q + 7, s, i) for n in range(3) for q, s, i in sorted(x for x in seen if x[0] == n)[:5])
    assert list(scan.cuts(np.array([3, 3, 9, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)] and list(scan.cuts(np.array([1, 1, 1]), 6, 2)) == [(0, 2), (2, 3)]


def test_nearest_in_tiles_with_filters_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(scan, "CELLS", 7)
    monkeypatch.setattr(retrieve, "MATRIX", 20)
    r = random.Random(3)
    vector = lambda n: [r.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(n)]
    c = spark.createDataFrame([(i, vector(2 if i % 5 == 0 else 3), {"l": str(i % 2)} if i % 7 else None) for i in range(50)] + [(99, None, {})], "id long, embedding array<double>, metadata map<string,string>")
    q = spark.createDataFrame([(i, vector(2 if i == 4 else 3), [None, {"l": "0"}, {"l": "1"}, {"l": "5"}, {}][i % 5]) for i in range(11)], "query_id long, vector array<double>, filter map<string,string>")
    for own in (q, q.drop("filter")):
        assert found(retrieve.vector_topk(own, c, 4, digits=9)) == found(retrieve.top(retrieve.vector_scores(own, c).withColumn("score", F.round("score", 9)), 4))


def test_terms_are_numbered_in_order_whatever_the_sample(spark):
    corpus = spark.range(4000, numPartitions=4).select("id", F.concat_ws(" ", *(F.concat(F.lit("t"), (F.col("id") * 7 + j) % 30011) for j in range(12))).alias("content"))
    rows = sparse.SparseEncoder.fit(corpus, stemmed=False).vocabulary.select("term", "idx").collect()
    first = {}
    for r in corpus.orderBy("id").collect():
        for t in r["content"].split():
            first.setdefault(t, len(first))
    assert {r["term"]: r["idx"] for r in rows} == first and len(rows) == len(first)


def test_sparse_products_of_texts(spark, chunks, asked):
    encoder = sparse.SparseEncoder.fit(chunks, stemmed=False)
    q, d = encoder.weights(asked, "query", "query_id"), encoder.weights(chunks, "content", "id").withColumnRenamed("id", "chunk_id")
    want = retrieve.top(sparse.sparse_scores(q, d).withColumn("score", F.round("score", 9)), 4)
    assert found(sparse.text_topk(asked, chunks, 4, stemmed=False, digits=9)) == found(want)


def test_chunks_without_shuffles(spark, tmp_path):
    said = f"{tmp_path}/said"

    def provider(documents, chunks):
        with open(said, "a") as f:
            f.write("".join(f"{d[:2]} {c[:2]}\n" for d, c in zip(documents, chunks)))
        return [None if c.startswith("x") else f" {len(d)} " for d, c in zip(documents, chunks)]

    rows = [(i, t, {"k": str(i)}) for i, t in enumerate(["abcdefgh" * 2, "xyxyxyxy", "abcdefgh" * 2, "", None, "  "])]
    docs = spark.createDataFrame(rows, "id long, content string, metadata map<string,string>").repartition(3)
    out = chunking.contextual(chunking.fixed(8, 0), provider)(docs)
    got = sorted((r["id"], r["content"], r["metadata"]["k"]) for r in out.collect())
    assert got == [("0:0", "16\n\nabcdefgh", "0"), ("0:1", "16\n\nabcdefgh", "0"), ("1:0", "xyxyxyxy", "1"), ("2:0", "16\n\nabcdefgh", "2"), ("2:1", "16\n\nabcdefgh", "2")]
    assert sorted(open(said).read().split("\n")[:-1]) == ["ab ab", "xy xy"]  # of equal documents and chunks one is asked for
    texts = chunking.semantic(embedding.hash_embedder())(spark.createDataFrame([(i, "One two. One two three. Else.", {}) for i in range(5)], "id long, content string, metadata map<string,string>"))
    assert sorted((r["id"], r["content"]) for r in texts.collect()) == sorted((f"{i}:{n}", c) for i in range(5) for n, c in enumerate(["One two. One two three.", "Else."]))
    assert "Exchange" not in texts._jdf.queryExecution().executedPlan().toString()


def test_documents_across_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, "One two. One two three. Else." + " A b." * i, {"k": str(i)}) for i in range(6)], "id long, content string, metadata map<string,string>").coalesce(1)
    chunker = chunking.semantic(embedding.hash_embedder())
    want = sorted((r["id"], r["content"], r["metadata"]["k"]) for r in chunker(docs).collect())
    assert {w[0] for w in want} >= {"0:0", "0:1", "5:2"} and all(w[0].split(":")[0] == w[2] for w in want)
    held = spark.conf.get(key)
    try:
        for n in (1, 2, 5):
            spark.conf.set(key, n)
            assert sorted((r["id"], r["content"], r["metadata"]["k"]) for r in chunker(docs).collect()) == want
    finally:
        spark.conf.set(key, held)
    shuffled = lambda df, text, vector: embedding.hash_embedder()(df.orderBy(F.desc("at")), text, vector)
    with pytest.raises(Exception, match="changed the order of rows"):
        chunking.semantic(shuffled)(docs).collect()


def test_postings_of_unique_chunks(spark, chunks):
    told = lambda i: sorted(map(tuple, i.postings.select("term", "chunk_id", "doc_len", "tf").collect()))
    one = index.build(chunks, unique=True)
    assert told(one) == told(index.build(chunks)) and "Exchange" not in one.postings._jdf.queryExecution().executedPlan().toString()
