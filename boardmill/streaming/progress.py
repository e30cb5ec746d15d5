"""Counters of a running scan, taken while its rows pass: no second pass, nothing kept in memory for it."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """The counters of each finished batch of the scans that were given to ``watch``.

    Counters are aggregates, one row for each batch.  A batch that was run again counts as it ran last.
    """

    def __init__(self, name: str, *counters: Column):
        super().__init__()
        self.name, self.counters = name, counters
        self._batches: dict[int, dict] = {}
        self._changed = threading.Condition()
        self._ended = False

    def watch(self, stream: DataFrame) -> DataFrame:
        """The stream, counted as it passes."""
        return stream.observe(self.name, *self.counters)

    def onQueryStarted(self, event) -> None:
        self._ended = False

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self._changed:
                self._batches[event.progress.batchId] = row.asDict()
                self._changed.notify_all()

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended = True
            self._changed.notify_all()

    def batches(self, wait: float = 10.0) -> dict[int, dict]:
        """Counters by batch; waits until the scan's end was reported, ``wait`` seconds at most."""
        with self._changed:
            self._changed.wait_for(lambda: self._ended, wait)
            return dict(self._batches)
