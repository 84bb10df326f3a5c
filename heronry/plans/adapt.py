"""Results in the shapes that other frameworks take. results: as Engine.search gives them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_documents(results: DataFrame) -> DataFrame:
    """(query_id, rank, page_content, metadata): the user's metadata with chunkId, documentId and score, which win."""
    own = F.map_filter("metadata", lambda k, v: ~k.isin("chunkId", "documentId", "score"))
    ours = F.create_map(F.lit("chunkId"), F.col("chunk_id"), F.lit("documentId"), F.col("document_id"), F.lit("score"), F.col("score").cast("string"))
    return results.select("query_id", "rank", F.col("content").alias("page_content"), F.map_concat(own, ours).alias("metadata"))


def as_nodes(results: DataFrame) -> DataFrame:
    """(query_id, rank, node, score), node being a struct of id_, text and metadata."""
    own = F.map_filter("metadata", lambda k, v: k != "documentId")
    meta = F.map_concat(own, F.create_map(F.lit("documentId"), F.col("document_id")))
    return results.select("query_id", "rank", F.struct(F.col("chunk_id").alias("id_"), F.col("content").alias("text"), meta.alias("metadata")).alias("node"), "score")


def as_tool(search: Callable[..., Any], top_k: int = 5, description: str = "Searches the indexed documents and returns the passages that fit best.") -> dict[str, Any]:
    """A tool for a language model: its description, JSON schema and function; search: Engine.search."""

    def execute(query: str, top_k: int = top_k) -> list[dict[str, Any]]:
        rows = search(query, top_k=top_k).results.orderBy("rank").select("content", "document_id", "score").collect()
        return [{"content": r["content"].strip(), "documentId": r["document_id"], "score": r["score"]} for r in rows]

    schema = {"type": "object", "properties": {"query": {"type": "string"}, "top_k": {"type": "integer", "minimum": 1}}, "required": ["query"]}
    return {"description": description, "parameters": schema, "execute": execute}
