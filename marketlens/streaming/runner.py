"""Running batch functions on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marketlens.operators.lookup import release_measured

# Fixed value: how often a batch starts.
TRIGGER = "10 seconds"


def run_stream(
    source: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: str | None = TRIGGER,
    output_mode: str = "update",
    name: str | None = None,
    keep: bool = True,
) -> StreamingQuery:
    """Start a query that calls ``handle(rows, batch_id)`` for each micro-batch.

    The checkpoint is required: with it a restart goes on where the query
    stopped, and a batch that failed half-way is run again under its number,
    so handlers write under that number. Errors end the query; rows that do
    not parse belong in quarantine, not in an exception handler. Without a
    ``trigger`` the query handles what is there and stops. The rows of a batch
    are kept while it is handled; without ``keep``, for handlers that read them
    once, they are not.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist() if keep else rows
        try:
            handle(rows, batch_id)
        finally:
            if keep:
                rows.unpersist()
            release_measured()

    writer = (
        source.writeStream.foreachBatch(batch)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
    )
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()
