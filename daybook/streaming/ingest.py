"""An optional front end: new note files as a stream of batches.

The file source knows paths, not contents: an edited file of the same name is not read
again. Batches therefore only say that something arrived; what is done is found by hashes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from daybook.plans.consolidate import consolidate
from daybook.sources.store import Store


def watch(
    store: Store, name: str, folder: str, checkpoint: str, today: Callable[[], dt.date], done: Callable | None = None, available_now: bool = True
) -> StreamingQuery:
    """Consolidates ``folder`` whenever files appear in it."""
    stream = store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = stream.option("pathGlobFilter", "*.md").load(folder).select("path")

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            result = consolidate(store, [(name, folder)], today())
            if done:
                done(result)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
