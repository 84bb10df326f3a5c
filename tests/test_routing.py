import pytest
from pyspark.sql import functions as F

from heronry.operators.router import PROFILES, Capabilities, decide, router_name
from heronry.operators.signals import signals


def signal(spark, query):
    return spark.createDataFrame([(query,)], "q string").select(signals("q").alias("s")).first()["s"]


def route(spark, query, force=None, budget=None, **options):
    df = spark.createDataFrame([(query, force, budget)], "q string, f string, b double")
    return df.withColumn("s", signals("q")).select(decide(F.col("s"), F.col("f"), F.col("b"), **options).alias("d")).first()["d"]


@pytest.mark.parametrize(
    ("query", "name", "value"),
    [
        ("how do i do it?", "is_question", True), ("how do i", "question_type", "procedural"), ("what is x", "question_type", "definitional"), ("who did it", "question_type", "factoid"), ("what version", "question_type", None),
        ("can it", "question_type", None), ("plain words", "question_type", None), ('say "exact words"', "has_quoted_phrase", True), ("error 404", "has_specific_tokens", True), ("ABC", "has_specific_tokens", True),
        ("v2-a", "has_specific_tokens", True), ("0xFF", "has_specific_tokens", True), ("404,", "has_specific_tokens", False), ("useState", "has_code_like", True), ("pool_mode", "has_code_like", True), ("a.b.io", "has_code_like", True),
        ("std::map", "has_code_like", True), ("foo(bar", "has_code_like", True), ("a=1", "has_code_like", True), ("plain", "has_code_like", False), ("in 2019", "has_date_or_version", True), ("v1.2", "has_date_or_version", True),
        ("é2018", "has_date_or_version", True), ("rfc 7519", "has_date_or_version", True), ("CVE-2024-3094", "has_date_or_version", True), ("x Redis", "has_named_entity", True), ("Redis x", "has_named_entity", False),
        ("x The", "has_named_entity", False), ("x TLS", "has_named_entity", False), ("x HTTP", "has_named_entity", True), ("a vs b", "has_negation", True), ("nothing", "has_negation", False), ("", "word_count", 0), ("", "ambiguity", 0.4),
        ("the of and", "ambiguity", 1.0), ("ab cd", "avg_word_len", 2.0), ("日本の", "language", "ja"),
    ],
)
def test_signals(spark, query, name, value):
    assert signal(spark, query)[name] == value


@pytest.mark.parametrize(
    ("query", "strategy"),
    [
        ('"liveness probes" fail', "keyword"), ("useState hook", "keyword"), ("503 status page", "hybrid"), ("cache", "keyword"), ("tuning of Redis pools", "keyword"), ("how do i set this up", "vector"), ("what is wal", "vector"),
        ("who wrote it first", "hybrid"), ("can it leave the group", "vector"), ("is it of the", "vector"), ("slow plans on large tables", "hybrid"), ("接続プール", "vector"),
    ],
)
def test_routes(spark, query, strategy):
    assert route(spark, query)["strategy"] == strategy


def test_capabilities(spark):
    dense = PROFILES["chroma"]
    assert route(spark, '"a phrase"', caps=dense)["strategy"] == "vector"
    assert "vector-only" in route(spark, "x", caps=dense)["reasons"][0]
    assert route(spark, "who wrote it first", caps=Capabilities(vector=False, hybrid=False))["strategy"] == "vector"
    assert route(spark, "cache", "keyword", caps=dense)["strategy"] == "keyword"
    assert route(spark, "cache", caps=PROFILES["pinecone+sparse"])["reasons"][0].startswith("very short")


@pytest.mark.parametrize(
    ("force", "budget", "always", "query", "reranked"),
    [
        (None, None, True, "cache", True), (None, 800.0, True, "cache", False), (None, 801.0, True, "cache", True), (None, None, False, "cache", False), (None, 10.0, False, "not a cache hit at all", True),
        (None, 10.0, True, "not a cache hit at all", False), ("rerank", 1.0, True, "x", True), (None, None, False, "slow plans on large tables", True),
    ],
)
def test_reranking(spark, force, budget, always, query, reranked):
    assert route(spark, query, force, budget, always_rerank=always)["reranked"] is reranked
    none = route(spark, query, force, budget, always_rerank=always, has_reranker=False)
    assert none["reranked"] is False and (not reranked or "no reranker" in none["reasons"][-1])


def test_reasons(spark):
    assert "latency" in route(spark, "slow plans on large tables", None, 5.0)["reasons"][-1]
    assert "negation" in route(spark, "tables not read at all", always_rerank=False)["reasons"][-1]
    assert router_name() == "heuristic-v1" and router_name(False).endswith("+fast-keyword")
