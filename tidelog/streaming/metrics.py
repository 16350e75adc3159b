"""Figures of running streams: rates, durations, lag behind the source and rows dropped as too late."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming.listener import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Keeps the last ``keep`` progress reports of all streams as plain dicts."""

    def __init__(self, keep: int = 1000):
        self.reports: deque[dict] = deque(maxlen=keep)
        self.failures: deque[str] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.reports.append(
            {
                "name": p.name,
                "batch": p.batchId,
                "rows": p.numInputRows,
                "input_rate": p.inputRowsPerSecond,
                "processed_rate": p.processedRowsPerSecond,
                "milliseconds": dict(p.durationMs).get("triggerExecution"),
                "watermark": dict(p.eventTime).get("watermark"),
                "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
                "dropped_late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            }
        )

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.failures.append(event.exception)
