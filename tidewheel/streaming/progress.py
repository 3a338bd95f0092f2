"""What a stream reports after each micro-batch, kept as rows.

A listener takes Spark's progress events: counts named by ``observe``, rows received and
how far the stream is behind. Rows are few, one or two per micro-batch, and are written
below a folder of their own, each batch under its number, so a batch that runs again
counts once.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

EVENTS = "query string, batch bigint, name string, metric string, value bigint"


class ProgressLog(StreamingQueryListener):
    """Keeps the progress of the session's streams below ``folder``.

    Use it around the runs of one checkpoint::

        with ProgressLog(session, folder) as log:
            log.wait(run_available(...))
        observed(session, folder)
    """

    def __init__(self, session: SparkSession, folder: str):
        self.session, self.folder = session, folder
        self.ended: dict[str, threading.Event] = {}
        self.rows: list[tuple] = []

    def __enter__(self) -> ProgressLog:
        self.session.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.session.streams.removeListener(self)
        self.flush()

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        for name, row in (progress.get("observedMetrics") or {}).items():
            for metric, value in row.items():
                self._note(progress, name, metric, value)
        self._note(progress, "stream", "rows", progress["numInputRows"])

    def _note(self, progress: dict, name: str, metric: str, value: int) -> None:
        self.rows.append((progress["id"], progress["batchId"], name, metric, value))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def wait(self, query: StreamingQuery, timeout: float = 60) -> None:
        """Until all that ``query``, which has ended, reported is here, and write it."""
        if not self._end(query.runId).wait(timeout):
            raise TimeoutError("the query's last report did not come")
        self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            table = self.session.createDataFrame(rows, EVENTS).coalesce(1)
            table.write.mode("append").json(self.folder)


def progress_rows(session: SparkSession, folder: str) -> DataFrame:
    """(query, batch, name, metric, value), each batch as it was reported last. A batch
    without rows is reported with the number of the next one, so the largest counts."""
    logged = session.read.schema(EVENTS).json(folder)
    keys = ["query", "batch", "name", "metric"]
    return logged.groupBy(*keys).agg(F.max("value").alias("value"))


def observed(session: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The counts of ``observe_events`` per micro-batch."""
    counts = progress_rows(session, folder).where(F.col("name") == name)
    named = ["received", "scored", "rejected", "positive"]
    return counts.groupBy("query", "batch").pivot("metric", named).agg(F.first("value"))


def live_backlog(session: SparkSession, folder: str, landed: int) -> DataFrame:
    """(query, batch, received, backlog) at the end of every micro-batch: rows taken so
    far, and of the ``landed`` messages of a topic those that no batch has taken yet."""
    taken = progress_rows(session, folder).where("name = 'stream' and metric = 'rows'")
    so_far = Window.partitionBy("query").orderBy("batch")
    received = F.sum("value").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    return taken.select("query", "batch", received.alias("received")).withColumn(
        "backlog", F.lit(landed) - F.col("received")
    )
