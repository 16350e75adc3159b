"""Per-period aggregates by event time that late records correct up to a cut-off.

Every input partition is put in order of arrival and run through a finger B-tree keyed by
(period, source). With each arrival the tree's two bounds move on: what is inserted below the first is
late and updates the partial aggregates of its ancestors, what is inserted below the second is refused,
because its subtree is cut off; finished periods leave the tree as whole subtrees. The outcome of a row
is the tree's answer to its insertion. The partitions' partial aggregates are then merged by key. Raw
rows are not shuffled, so no source can make one task longer than the others; as the bounds follow
the row's own arrival, it does not matter which partition a row lies in.

Defined results: a row without event_time has no period and is left out; the arrival is the later
of the two clocks, or the one that is there; with neither the row counts as on time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.functions.finger_tree import CLOSED, OPEN, REFUSED, FingerTree

PERIOD_US = 60_000_000
GRACE_US = 60_000_000
CUT_OFF_US = 15 * 60_000_000

HOUR_US = 3_600_000_000

OUTCOMES = {OPEN: "on_time", CLOSED: "corrected", REFUSED: "refused"}

_VERDICTS = "kafka_partition int, kafka_offset long, outcome string"
_PARTIALS = (
    "exchange string, symbol string, period long, n long, n_corrected long, volume double, "
    "open_at struct<t:long,o:long>, open double, high double, low double, close_at struct<t:long,o:long>, close double"
)


def _merge(a: tuple, b: tuple) -> tuple:
    """(n, n_corrected, volume, (t, tie, open), high, low, (t, tie, close)); prices may be absent."""
    return (
        a[0] + b[0],
        a[1] + b[1],
        a[2] + b[2],
        min(a[3], b[3]) if a[3] and b[3] else a[3] or b[3],
        max(a[4], b[4]),
        min(a[5], b[5]),
        max(a[6], b[6]) if a[6] and b[6] else a[6] or b[6],
    )


class LatenessTree:
    """The tree of one partition, fed with arrays of rows in order of arrival.

    ``span``: if given, periods are kept until the span they lie in is over, and leave as one total of it.
    """

    def __init__(self, period: int, grace: int, cut_off: int, merge: Callable[[tuple, tuple], tuple] = _merge, span: int | None = None):
        self.period, self.grace, self.cut_off, self.span = period, grace, cut_off, span
        self.tree = FingerTree(merge)
        self.finished: list[tuple] = []

    def _bounds(self, arrival: np.ndarray, allowed: int) -> np.ndarray:
        """The first period that ends no more than ``allowed`` before the arrival."""
        return -((allowed + self.period - arrival) // self.period) * self.period

    def _cut(self, floor: int) -> None:
        if self.span is None:
            self.finished += self.tree.evict((floor, -1))
            return
        while (key := self.tree.lowest()) is not None and (end := (key[0] // self.span + 1) * self.span) <= floor:
            self._total(end)

    def _total(self, end: int) -> None:
        """Of one whole span: most of it are aggregates of inner nodes."""
        begin = end - self.span
        self.finished.append(((begin, -1), self.tree.range_total((begin, -1), (end, -1))))
        self.tree.evict((end, -1))

    def _fed(self, seg: np.ndarray, starts: np.ndarray, begin: np.ndarray, key: np.ndarray, closed: np.ndarray, floor: np.ndarray, parts: Iterable[tuple]) -> np.ndarray:
        """Insert the groups of rows that share key and bounds, in order of arrival; the tree's answers."""
        answers = np.empty(len(starts), dtype=np.int8)
        at_seg = -1
        for i, (at, (part, late)) in enumerate(zip(starts.tolist(), parts, strict=True)):
            if seg[at] != at_seg:
                at_seg = seg[at]
                self.tree.advance((int(closed[at]), -1), (int(floor[at]), -1))
                self._cut(int(floor[at]))
            answers[i] = self.tree.insert((int(begin[at]), int(key[at])), part, late)
        return answers

    def _grouped(self, key: np.ndarray, event: np.ndarray, arrival: np.ndarray, within: Sequence[np.ndarray]) -> tuple:
        """Order of the rows by bounds, period and key, and where a group begins."""
        begin = event - event % self.period
        closed, floor = self._bounds(arrival, self.grace), self._bounds(arrival, self.cut_off)
        seg = np.cumsum(np.r_[True, (closed[1:] != closed[:-1]) | (floor[1:] != floor[:-1])])
        order = np.lexsort((*within, key, begin, seg))
        seg, begin, key, closed, floor = (x[order] for x in (seg, begin, key, closed, floor))
        starts = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (begin[1:] != begin[:-1]) | (key[1:] != key[:-1])])
        return order, seg, starts, begin, key, closed, floor

    def outcomes(self, event: np.ndarray, arrival: np.ndarray) -> np.ndarray:
        """The tree's answer for every row; it holds numbers of rows only."""
        order, seg, starts, *rest = self._grouped(np.zeros(len(event), dtype=np.int64), event, arrival, ())
        n = np.diff(np.r_[starts, len(event)])
        answers = self._fed(seg, starts, *rest, (((x,), None) for x in n.tolist()))
        self.finished.clear()
        result = np.empty(len(event), dtype=np.int8)
        result[order] = np.repeat(answers, n)
        return result

    def take(self, key: np.ndarray, event: np.ndarray, arrival: np.ndarray, price: np.ndarray, size: np.ndarray, tie: np.ndarray) -> None:
        """Insert the partial aggregates of the rows."""
        order, seg, starts, begin, key, closed, floor = self._grouped(key, event, arrival, (tie, event))
        event, price, size, tie = (x[order] for x in (event, price, size, tie))
        self._fed(seg, starts, begin, key, closed, floor, self._parts(starts, event, price, size, tie))

    @staticmethod
    def _parts(starts: np.ndarray, event: np.ndarray, price: np.ndarray, size: np.ndarray, tie: np.ndarray) -> Iterator[tuple[tuple, tuple]]:
        """The partial aggregate of each group, on time and late."""
        priced = np.isfinite(price)
        n = np.diff(np.r_[starts, len(event)]).tolist()
        volume = np.add.reduceat(np.where(np.isfinite(size), size, 0.0), starts).tolist()
        high = np.maximum.reduceat(np.where(priced, price, -np.inf), starts).tolist()
        low = np.minimum.reduceat(np.where(priced, price, np.inf), starts).tolist()
        place = np.arange(len(event))
        first = np.minimum.reduceat(np.where(priced, place, len(event)), starts).tolist()
        last = np.maximum.reduceat(np.where(priced, place, -1), starts).tolist()
        for i in range(len(starts)):
            opens = closes = None
            if last[i] >= 0:
                a, b = first[i], last[i]
                opens = (int(event[a]), int(tie[a]), float(price[a]))
                closes = (int(event[b]), int(tie[b]), float(price[b]))
            values = (volume[i], opens, high[i], low[i], closes)
            yield (n[i], 0, *values), (n[i], n[i], *values)

    def done(self) -> list[tuple]:
        """What has left the tree since the last call."""
        done, self.finished = self.finished, []
        return done

    def rest(self) -> list[tuple]:
        """All that is left, at the end of the partition."""
        if self.span is None:
            return list(self.tree.items())
        while (key := self.tree.lowest()) is not None:
            self._total((key[0] // self.span + 1) * self.span)
        return self.done()


def _numbers(batch: pa.RecordBatch, name: str, kind: type, missing: float) -> np.ndarray:
    return batch.column(name).fill_null(missing).to_numpy(zero_copy_only=False).astype(kind)


def _verdicts(period: int, grace: int, cut_off: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = LatenessTree(period, grace, cut_off, lambda a, b: (a[0] + b[0],))
        for batch in batches:
            if batch.num_rows:
                outcome = tree.outcomes(_numbers(batch, "event", np.int64, 0), _numbers(batch, "arrival", np.int64, -(2**62)))
                late = np.flatnonzero(outcome != OPEN)
                chosen = batch.take(pa.array(late))
                names = pa.array([OUTCOMES[x] for x in outcome[late].tolist()], pa.string())
                yield pa.record_batch([chosen.column("kafka_partition"), chosen.column("kafka_offset"), names], names=["kafka_partition", "kafka_offset", "outcome"])

    return run


class _Sources:
    """Numbers for (exchange, symbol), in order of first sight."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.named: list[tuple] = []

    def numbers(self, batch: pa.RecordBatch) -> np.ndarray:
        pairs = pa.StructArray.from_arrays([batch.column("exchange"), batch.column("symbol")], ["e", "s"])
        index = batch.column("source").dictionary_encode().indices.to_numpy()
        codes, firsts = np.unique(index, return_index=True)
        lookup = np.zeros(codes.max() + 1, dtype=np.int64)
        for code, at in zip(codes.tolist(), firsts.tolist(), strict=True):
            pair = pairs[at].as_py()
            pair = (pair["e"], pair["s"])
            if pair not in self.known:
                self.known[pair] = len(self.named)
                self.named.append(pair)
            lookup[code] = self.known[pair]
        return lookup[index]


def _partials(period: int, grace: int, cut_off: int, span: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial aggregates of periods and sources, or of whole spans over all sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sources = LatenessTree(period, grace, cut_off, span=span), _Sources()

        def rows(entries: list[tuple]) -> pa.RecordBatch:
            out = []
            for (begin, key), (n, late, volume, opens, high, low, closes) in entries:
                exchange, symbol = sources.named[key] if key >= 0 else (None, None)
                out.append(
                    {
                        "exchange": exchange, "symbol": symbol, "period": begin, "n": n, "n_corrected": late, "volume": volume,
                        "open_at": opens and {"t": opens[0], "o": opens[1]}, "open": opens and opens[2], "high": high if opens else None,
                        "low": low if opens else None, "close_at": closes and {"t": closes[0], "o": closes[1]}, "close": closes and closes[2],
                    }
                )
            return pa.RecordBatch.from_pylist(out, schema=_PARTIALS_ARROW)

        for batch in batches:
            if batch.num_rows:
                tree.take(
                    sources.numbers(batch), _numbers(batch, "event", np.int64, 0), _numbers(batch, "arrival", np.int64, -(2**62)),
                    _numbers(batch, "price", np.float64, np.nan), _numbers(batch, "size", np.float64, np.nan), _numbers(batch, "tie", np.int64, 0),
                )
                if done := tree.done():
                    yield rows(done)
        if done := tree.rest():
            yield rows(done)

    return run


_AT = pa.struct([("t", pa.int64()), ("o", pa.int64())])
_PARTIALS_ARROW = pa.schema(
    [("exchange", pa.string()), ("symbol", pa.string()), ("period", pa.int64()), ("n", pa.int64()), ("n_corrected", pa.int64()), ("volume", pa.float64())]
    + [("open_at", _AT), ("open", pa.float64()), ("high", pa.float64()), ("low", pa.float64()), ("close_at", _AT), ("close", pa.float64())]
)


def arrival_time(df: DataFrame) -> Column:
    return F.greatest(df["ingested_at"], df["kafka_timestamp"])


def _timed(trades: DataFrame) -> DataFrame:
    """Rows of each input partition in order of arrival; those without arrival first."""
    times = [F.unix_micros("event_time").alias("event"), F.unix_micros(arrival_time(trades)).alias("arrival")]
    return trades.where("event_time is not null").select("kafka_partition", "kafka_offset", *times).sortWithinPartitions("arrival")


def _valued(trades: DataFrame) -> DataFrame:
    """As before, with source and readings."""
    price, size = X.reading(F.col("payload"), "price", "size")
    exchange, symbol = (X.exchange_key(F.col("exchange")), X.symbol_key(F.col("symbol")))
    position = F.coalesce("kafka_partition", F.lit(0)).cast("long") * (1 << 48) + F.coalesce("kafka_offset", F.lit(0))
    rows = trades.where("event_time is not null").select(
        exchange.alias("exchange"),
        symbol.alias("symbol"),
        F.unix_micros("event_time").alias("event"),
        F.unix_micros(arrival_time(trades)).alias("arrival"),
        price.alias("price"),
        size.alias("size"),
        position.alias("tie"),
    )
    return rows.withColumn("source", F.to_json(F.struct("exchange", "symbol"))).sortWithinPartitions("arrival")


def late_rows(trades: DataFrame, period: int = PERIOD_US, grace: int = GRACE_US, cut_off: int = CUT_OFF_US) -> DataFrame:
    """(kafka_partition, kafka_offset, outcome) of every row late for its period."""
    return _timed(trades).mapInArrow(_verdicts(period, grace, cut_off), _VERDICTS)


def _merged(partials: DataFrame, *keys: str) -> DataFrame:
    return partials.groupBy(*keys).agg(
        F.sum("n").alias("trades"),
        F.sum("n_corrected").alias("corrected"),
        F.sum("volume").alias("volume"),
        F.min_by("open", "open_at").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "close_at").alias("close"),
    )


def period_aggregates(trades: DataFrame, period: int = PERIOD_US, grace: int = GRACE_US, cut_off: int = CUT_OFF_US) -> DataFrame:
    """Count, volume, open, high, low, close per exchange, symbol and period, late rows up to the cut-off taken in.

    The open has the least event_time, then position, among rows with a price; the close the greatest.
    """
    partials = _valued(trades).mapInArrow(_partials(period, grace, cut_off, None), _PARTIALS)
    merged = _merged(partials, "exchange", "symbol", "period")
    return merged.select("exchange", "symbol", F.timestamp_micros("period").alias("minute"), "trades", "corrected", "volume", "open", "high", "low", "close")


def span_totals(trades: DataFrame, span: int = HOUR_US, period: int = PERIOD_US, grace: int = GRACE_US, cut_off: int = CUT_OFF_US) -> DataFrame:
    """(begin, trades, corrected, volume, high, low) over all sources of every span, late rows taken in as by their period.

    A partition's share of a span is the tree's total over a range of keys, so inner nodes give most of it.
    """
    partials = _valued(trades).mapInArrow(_partials(period, grace, cut_off, span), _PARTIALS)
    return _merged(partials, "period").select(F.timestamp_micros("period").alias("begin"), "trades", "corrected", "volume", "high", "low")
