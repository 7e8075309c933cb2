"""Continuous ingestion: each micro-batch adds the documents whose digest is new and embeds the chunks that need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessellane.operators.store import DocumentStore


def ingest(stream: DataFrame, store: DocumentStore, checkpoint: str, every: str | None = None, then: Callable[[DocumentStore, int], None] | None = None) -> StreamingQuery:
    """Add new documents of ``stream`` (name, text) to ``store``.

    A batch is added by one version of the store that carries the batch's number, so a batch that is repeated after a failure
    adds nothing twice. Of the store only digests are read. Without ``every`` (such as ``2 seconds``) what is there is
    taken once. ``then`` is called after each batch, to embed what is pending, say.
    """

    def add(batch: DataFrame, number: int) -> None:
        store.add(batch, number)
        if then:
            then(store, number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()
