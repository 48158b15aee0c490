"""Continuous indexing: a stream of documents becomes one segment a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.index import latest
from lodestone.sources.segments import SegmentedStore


def ingest(stream: DataFrame, store: SegmentedStore, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Write a stream of (doc_id, text, ...) into a store. Within a batch the greatest ``order`` of an id wins, see latest(), and a later batch replaces an earlier one.

    A batch that is repeated after a failure replaces its own documents, so the store's content is the same as if it had run once.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.add(latest(batch, order))
        store.flush()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
