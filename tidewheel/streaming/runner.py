"""Running a streaming query over all data there is now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def run_available(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    output_mode: str = "append",
    timeout: float | None = None,
) -> StreamingQuery:
    """Process everything available, then stop. Rows go to parquet files at ``path``,
    or nowhere if the query is run for its state alone."""
    writer = stream.writeStream.outputMode(output_mode).option(
        "checkpointLocation", checkpoint
    )
    writer = (
        writer.format("parquet").option("path", path) if path else writer.format("noop")
    )
    return finished(writer, timeout)


def finished(writer: DataStreamWriter, timeout: float | None = None) -> StreamingQuery:
    """Start a query over everything available and wait for its end."""
    query = writer.trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"streaming query not done after {timeout} s")
    return query


def batchwise(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str
) -> DataStreamWriter:
    """Writer that hands each micro-batch and its number to ``work``. A batch that fails
    comes again with the same number and rows, so work that replaces what it wrote under
    that number is done exactly once."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
