"""An index's chunks in a folder: a log of segments, so that an upsert or a deletion writes what it brings and no more.

The log names the segments in order. Readers take it once, and never see half a change. Of chunks with the same id the one of the last
segment counts, unless a later deletion names it. compact() makes one segment of all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embedding import checked
from ..operators.index import Index, build, last_of, of_postings

SCHEMA = "id string, document_id string, content string, index int, embedding array<double>, metadata map<string,string>, lang string"
POSTINGS = "term string, chunk_id string, doc_len int, tf long"
LOG = "n long, kind string, path string"


class Store:
    """format: parquet or json. dimension: that of embeddings, which is then enforced. indexed: postings are stored beside the chunks."""

    def __init__(self, spark: SparkSession, folder: str, format: str = "parquet", dimension: int | None = None, indexed: bool = False):
        if format not in ("parquet", "json"):
            raise ValueError("format must be parquet or json")
        if dimension is not None and (not isinstance(dimension, int) or dimension < 1):
            raise ValueError("dimension must be a positive whole number")
        self.spark, self.folder, self.format, self.dimension, self.indexed = spark, folder.rstrip("/"), format, dimension, indexed

    # ---- the folder

    def _there(self, name: str) -> bool:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)

    def migrate(self) -> None:
        """Makes the folder, or checks that what it holds was made with the same settings. May be called again and again."""
        own = {"format": self.format, "dimension": self.dimension, "indexed": self.indexed}
        if self._there("settings"):
            held = json.loads(self.spark.read.text(f"{self.folder}/settings").first()["value"])
            if held != own:
                raise ValueError(f"the store was made with {held}, not with {own}")
        else:
            self.spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{self.folder}/settings")

    def _log(self) -> list:
        """Entries since the last that leaves nothing of those before."""
        if not self._there("log"):
            return []
        entries = self.spark.read.schema(LOG).json(f"{self.folder}/log").orderBy("n").collect()
        last = max((i for i, e in enumerate(entries) if e["kind"] in ("clear", "compact")), default=0)
        return entries[last:]

    def _append(self, kind: str, path: str | None) -> None:
        entries = self._log()
        n = entries[-1]["n"] + 1 if entries else 1
        self.spark.createDataFrame([(n, kind, path)], LOG).coalesce(1).write.mode("append").json(f"{self.folder}/log")

    def _segment(self, chunks: DataFrame, kind: str) -> None:
        path = f"segment-{uuid.uuid4().hex}"
        chunks.write.format(self.format).save(f"{self.folder}/{path}")
        if self.indexed:
            stored = self.spark.read.schema(SCHEMA).format(self.format).load(f"{self.folder}/{path}")
            build(stored).postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.folder}/postings-{path}")
        self._append(kind, path)

    # ---- changes

    def upsert(self, batch: DataFrame, order: str | None = None) -> None:
        """Of rows that repeat an id in the batch the last stays, by `order` or as the rows are numbered."""
        batch = last_of(batch, order).drop(*([order] if order else []))
        if self.dimension:
            batch = checked(batch, "embedding", self.dimension)
        names = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMA).schema}
        self._segment(batch.select(*(F.col(c).cast(kind) if c in batch.columns else F.lit(None).cast(kind).alias(c) for c, kind in names.items())), "upsert")

    def delete(self, ids: DataFrame) -> None:
        path = f"deleted-{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("string")).distinct().write.parquet(f"{self.folder}/{path}")
        self._append("delete", path)

    def clear(self) -> None:
        self._append("clear", None)

    def compact(self) -> None:
        """One segment in place of all. Readers that began before still find the old ones."""
        self._segment(self.read(), "compact")

    # ---- reading

    def _live(self) -> tuple[list, DataFrame | None]:
        """(segments, (id, __n) of the chunks that count); None where all rows of the only segment do."""
        entries = self._log()
        segments = [e for e in entries if e["kind"] in ("upsert", "compact")]
        if len(segments) <= 1 and not any(e["kind"] == "delete" for e in entries):
            return segments, None
        ids = self.spark.createDataFrame([], "id string, __n long, gone boolean")
        for e in entries:
            if e["path"]:
                gone = e["kind"] == "delete"
                held = self.spark.read.schema("id string").format("parquet" if gone else self.format).load(f"{self.folder}/{e['path']}")
                ids = ids.unionAll(held.select("id", F.lit(e["n"]).cast("long"), F.lit(gone)))
        last = ids.groupBy("id").agg(F.max(F.struct("__n", "gone")).alias("last"))
        return segments, last.where("not last.gone").select("id", F.col("last.__n").alias("__n"))

    def _rows(self, segments: list, live: DataFrame | None, schema: str, prefix: str, format: str, key: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema + ", __n long")
        for e in segments:
            held = self.spark.read.schema(schema).format(format).load(f"{self.folder}/{prefix}{e['path']}").withColumn("__n", F.lit(e["n"]).cast("long"))
            out = held if len(segments) == 1 else out.unionAll(held)
        if live is not None:
            out = out.join(live.withColumnRenamed("id", key), [key, "__n"], "left_semi")
        return out.drop("__n")

    def read(self) -> DataFrame:
        segments, live = self._live()
        return self._rows(segments, live, SCHEMA, "", self.format, "id")

    def index(self) -> Index:
        """The chunks with their stored postings, or new ones where none are stored."""
        if not self.indexed:
            return build(self.read())
        segments, live = self._live()
        postings = self._rows(segments, live, POSTINGS, "postings-", "parquet", "chunk_id")
        return of_postings(self._rows(segments, live, SCHEMA, "", self.format, "id"), postings)

    def count(self) -> int:
        return self.read().count()


class ContextCache:
    """Contexts of chunks in a folder, by key; what a provider says is added, so that it is asked once for each chunk."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self) -> DataFrame:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "key string, context string")
        return self.spark.read.schema("key string, context string").parquet(self.folder).dropDuplicates(["key"])

    def add(self, contexts: DataFrame) -> None:
        contexts.select("key", "context").write.mode("append").parquet(self.folder)
