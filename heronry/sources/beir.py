"""Retrieval test collections: a folder of corpus.jsonl, queries.jsonl and qrels/SPLIT.tsv; and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = "_id string, title string, text string, metadata map<string,string>"


def load(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels). Judgements of 0 and less go, and queries without any; a header of the judgements is skipped."""
    docs = spark.read.schema(_TEXT).json(f"{folder}/corpus.jsonl")
    title = F.trim(F.coalesce("title", F.lit("")))
    content = F.when(F.length(title) > 0, F.concat(title, F.lit("\n\n"), "text")).otherwise(F.col("text"))
    empty = F.create_map().cast("map<string,string>")
    corpus = docs.select(F.col("_id").alias("id"), content.alias("content"), F.coalesce("metadata", empty).alias("metadata"))
    raw = spark.read.schema("q string, d string, s string").csv(f"{folder}/qrels/{split}.tsv", sep="\t")
    qrels = raw.select(F.col("q").alias("query_id"), F.col("d").alias("doc_id"), F.expr("try_cast(s AS int)").alias("rel")).where("rel > 0")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    return corpus, queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels


def load_eval(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of corpus.json and queries.json, lists of {id, content, metadata} and {query, relevant, category}."""
    corpus = spark.read.schema("id string, content string, metadata map<string,string>").json(f"{folder}/corpus.json", multiLine=True)
    raw = spark.read.schema("query string, relevant array<string>, category string").json(f"{folder}/queries.json", multiLine=True)
    rows = raw.withColumn("query_id", F.sha2(F.concat_ws("\u0000", "query", F.array_join("relevant", ",")), 256))
    return corpus, rows.select("query_id", "query", "category"), rows.select("query_id", F.explode("relevant").alias("doc_id"), F.lit(1).alias("rel"))


def save_report(groups: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").json(path)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level string, name string, n long, ndcg double, mrr double, recall double").json(path)
