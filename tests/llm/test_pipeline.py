"""Queries of the subpackage over the tables, against their SQL; the pipeline stage by stage against versions of its own."""

import os
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heronry.llm import queries, shared, similar, toxicity

from .. import compare
from . import fixtures
from .test_operators import brute_links, brute_matches, brute_passages, brute_threshold


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, data, name):
    compare.same(spark, data, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def brute_stage(name, spark, docs, data):
    """What a stage keeps, as [(doc_id, text)], by other means."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    if name == "toxicity":
        labels = queries.table(spark, data, "labels")
        field, _ = toxicity.trained(docs, labels)
        if field is None:
            return rows
        scores = {r: round(s, 6) for r, s, _ in toxicity.scores(field, pa.array([t for _, t in rows], pa.string()))}
        told = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()}
        truth = {i: int(told[i] > 0) for i, t in rows if i in told and t is not None}
        least = brute_threshold([(rows[r][0], s) for r, s in scores.items() if rows[r][0] is not None], truth)
        return [x for r, x in enumerate(rows) if scores.get(r, 0) < least]
    if name == "line_dedup":
        left = brute_passages(rows)
        out = [(i, *left.get((i, t), (None, 0))) for i, t in rows]
        return [(i, t) for i, t, n in out if not n or t]
    if name == "ngram_jaccard":
        gone = {i for i, least, _, _ in brute_links(rows, similar.N, similar.THRESHOLD) if i != least}
        return [x for x, n in Counter(rows).items() if x[0] not in gone for _ in range(n if None in x else 1)]
    if name == "decontaminate":
        items = [(r["item_id"], r["text"]) for r in queries.table(spark, data, "benchmark").collect()]
        return [x for x in rows if not brute_matches([x], items, 3, 0.7)]
    return [(i, t and t.replace("\u2581", " ")) for i, t in rows]  # the mark of a space among pieces is read as one


def through(spark, docs, data):
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        want = brute_stage(name, spark, docs, data)
        docs = shared.written(stage(spark, docs, data), f"test-{name}")
        after = docs.collect()
        assert docs.columns == columns + ["ids"] * (name == "sentencepiece")
        assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(want), name
        if "n_chars" in columns:
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    assert all((r["ids"] is None) == (r["text"] is None) and bool(r["ids"]) == bool(r["text"]) for r in after)
    return after


def test_pipeline(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontaminate", "sentencepiece"]
    left = {r["doc_id"] for r in through(spark, queries.table(spark, data, "documents"), data)}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data).select("doc_id").collect()} == left


def test_pipeline_of_awkward_rows(spark, data, tmp_path):
    """Nulls, empty and very long texts, ties and repeated rows, and columns named as those that operators make."""
    labels = [(i, 1, 0) for i in (1, 2, 3, 9)] + [(None, 0, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(fixtures.words(5, 20))), (2, ""), (3, None), (None, "x")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = fixtures.clashing(fixtures.frame(spark))
    left = through(spark, docs, str(tmp_path))
    assert all(r[c] == "clash" for r in left for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars"))
    assert {r["doc_id"] for r in left} >= {1, 9, 7, 8, None} and 2 not in {r["doc_id"] for r in left}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = shared.written(stage(spark, empty, str(tmp_path)), "test-empty")
    assert empty.count() == 0 and empty.columns == docs.columns + ["ids"]


def test_tokenizers_are_not_in_the_repository():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    assert not [f for _, _, files in os.walk(root) for f in files if f.endswith((".model", ".tiktoken"))]
