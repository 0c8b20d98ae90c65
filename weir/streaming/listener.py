"""Input rows a second of running streams, one line for each progress report."""

from __future__ import annotations

from collections.abc import Callable
from threading import Thread

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: The observation that counts the rows a query reads, before its filters.
INPUT = "weir_input"


class ThroughputListener(StreamingQueryListener):
    """Appends ``second;rows_per_second`` to a file on the driver, and hands rows and seconds to ``keep``, if given.

    Only the queries given to :meth:`follow` are logged, ``limit`` reports in
    all; once all of these have ended the listener takes itself off.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, limit: int = 500, keep: Callable[[int, float], None] | None = None) -> None:
        self.spark, self.path, self.left, self.keep = spark, path, limit, keep
        self.runs: set[str] | None = None
        self.early: list = []
        self.ended: set[str] = set()

    def follow(self, queries: list[StreamingQuery]) -> None:
        self.runs = {str(q.runId) for q in queries}
        early, self.early = self.early, []
        for report in early:
            self._log(report)
        self._leave()

    def _log(self, report) -> None:
        if self.left <= 0 or str(report.runId) not in self.runs:
            return
        self.left -= 1
        observed = report.observedMetrics.get(INPUT)
        rows, seconds = observed["rows"] if observed else report.numInputRows, max(report.batchDuration, 1) / 1000
        if self.keep:
            self.keep(rows, seconds)
        if self.path:
            with open(self.path, "a") as out:
                out.write(f"{report.timestamp};{rows / seconds}\n")

    def _leave(self) -> None:
        if self.runs is not None and self.runs <= self.ended:
            Thread(target=self.spark.streams.removeListener, args=(self,), daemon=True).start()  # not from within its own call

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.runs is None:  # until the started queries are known
            self.early.append(event.progress)
        else:
            self._log(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))
        self._leave()
