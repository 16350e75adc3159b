"""Structured Streaming jobs over the same transforms that batch uses."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators import archive, candles, curated

LOGGER = logging.getLogger(__name__)
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
LATENESS = "15 minutes"


def to_archive(records: DataFrame, output: str, checkpoint: str, trigger: str | None = None, name: str = "archive") -> StreamingQuery:
    """Append log records to the archive, each offset once; without a trigger all that is there, then end."""
    if output.rstrip("/") == checkpoint.rstrip("/"):
        raise ValueError("archive and checkpoint must differ")
    writer = archive.archive_rows(records).writeStream.format("parquet").outputMode("append").queryName(name)
    writer = writer.option("checkpointLocation", checkpoint).partitionBy("event_date", "event_hour")
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start(output)


def once_within_watermark(trades: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each event_id once; its copies are remembered as long as the watermark allows."""
    return trades.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["event_id"])


def live_candles(trades: DataFrame, period: str = "1 minute", lateness: str | None = LATENESS) -> DataFrame:
    """Candles of closed windows; ``lateness`` is None where the stream has its watermark already."""
    return candles.candles(trades.withWatermark("event_time", lateness) if lateness else trades, period)


def split_write(raw: DataFrame, good_path: str, bad_path: str, checkpoint: str, observe: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Curated trades to one folder, quarantined ones with their reason to another.

    A batch that is tried again overwrites its own folder, so it is not written twice. If either write
    fails, so does the batch. ``observe`` sees the quarantined rows of a batch for reports; its failure
    stops nothing.
    """

    def both(batch: DataFrame, number: int) -> None:
        good, bad = curated.quarantined(curated.curated(batch))
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        if observe is not None:
            try:
                observe(number, batch.sparkSession.read.parquet(f"{bad_path}/batch={number}"))
            except Exception:  # a report never stops the data
                LOGGER.exception("observation of batch %s failed", number)

    return raw.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "previous long, observed long, gaps long, duplicates long, out_of_order long"
CONTINUITY = "key string, arrival long, current long, previous long, status string, missing_from long, missing_to long, observed long, gaps long"


_NEVER = -(1 << 62)
OUTPUT_ROWS = 10_000


class SequenceProcessor(StatefulProcessor):
    """The forward-only baseline and counters of a key, across batches; a timer reports one silence.

    Input: key string, arrival long, current long. With ``silence_ms`` a key that shows nothing for so
    long gives one row of status ``silence``, then none until it speaks again.
    """

    def __init__(self, silence_ms: int | None = None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sequence", _STATE)

    def _read(self) -> list[Any]:
        return list(self.state.get()) if self.state.exists() else [None, 0, 0, 0, 0]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        previous, observed, gaps, duplicates, late = self._read()
        arrival, current = self._in_order(rows)
        before = np.maximum.accumulate(np.r_[_NEVER if previous is None else previous, current])[:-1]
        first = before == _NEVER
        status = np.select([first, current == before + 1, current == before, current < before], ["initialized", "ok", "duplicate", "out_of_order"], "gap")
        gap = status == "gap"
        counts = observed + 1 + np.arange(len(current)), gaps + np.cumsum(gap)
        duplicates, late = duplicates + int((status == "duplicate").sum()), late + int((status == "out_of_order").sum())
        self.state.update((int(max(before[-1], current[-1])), int(counts[0][-1]), int(counts[1][-1]), duplicates, late))
        if self.silence_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        for at in range(0, len(current), OUTPUT_ROWS):
            part = slice(at, at + OUTPUT_ROWS)
            known, jump = ~first[part], gap[part]
            yield pd.DataFrame(
                {
                    "key": key[0], "arrival": arrival[part], "current": current[part], "previous": pd.Series(before[part]).where(known).astype("Int64"), "status": status[part],
                    "missing_from": pd.Series(before[part] + 1).where(jump).astype("Int64"), "missing_to": pd.Series(current[part] - 1).where(jump).astype("Int64"),
                    "observed": counts[0][part], "gaps": counts[1][part],
                }
            )

    @staticmethod
    def _in_order(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers a row are all that is held of a key's part of a batch."""
        parts = [(frame["arrival"].to_numpy(dtype=np.int64), frame["current"].to_numpy(dtype=np.int64)) for frame in rows]
        arrival, current = (np.concatenate(column) for column in zip(*parts, strict=True))
        order = np.argsort(arrival, kind="stable")
        return arrival[order], current[order]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        previous, observed, gaps, _, _ = self._read()
        yield _frame([(key[0], None, None, previous, "silence", None, None, observed, gaps)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in CONTINUITY.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({n: "Int64" for n in names if n not in ("key", "status")})


def continuity(rows: DataFrame, silence_ms: int | None = None) -> DataFrame:
    """(key, arrival, current) as a stream -> statuses, with state kept per key."""
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=SequenceProcessor(silence_ms), outputStructType=CONTINUITY, outputMode="Append", timeMode="None" if silence_ms is None else "ProcessingTime"
    )


def drained(stream: DataFrame, folder: str, start: Callable | None = None) -> DataFrame:
    """Run a stream over all that is there, into ``folder``, and read the result."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def sequence_rows(raw: DataFrame) -> DataFrame:
    """Trades as (key, arrival, current) for ``continuity``."""
    from tidelog.functions import text as X

    key = F.concat_ws(":", X.exchange_key(F.col("exchange")), X.symbol_key(F.col("symbol")))
    arrival = F.col("kafka_partition").cast("long") * (1 << 48) + F.col("kafka_offset")
    return raw.where("source_sequence is not null").select(key.alias("key"), arrival.alias("arrival"), F.col("source_sequence").alias("current"))
