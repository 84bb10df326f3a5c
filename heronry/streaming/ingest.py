"""Documents that arrive as files are chunked, embedded and upserted, a micro-batch at a time; each writes a segment of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import last_of
from ..plans.engine import Engine
from ..sources.store import Store

DOCUMENTS = "id string, content string, metadata map<string,string>"


def ingest(engine: Engine, store: Store, source: str, checkpoint: str, format: str = "json", once: bool = True) -> StreamingQuery:
    """Starts the stream. A batch that is repeated after a failure replaces the same chunks, so that each document counts once."""
    docs = engine.spark.readStream.schema(DOCUMENTS).format(format).load(source)

    def one(batch: DataFrame, epoch: int) -> None:
        store.upsert(engine.chunked(last_of(batch)))

    writer = docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
