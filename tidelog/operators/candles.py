"""Open, high, low, close and volume per source and period. Batch or stream, the same aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregates() -> list[Column]:
    """Every one is merged from partial results, so a source with most rows is reduced before the shuffle."""
    order = F.struct("event_time", "event_id")
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("trades"),
    ]


def candles(trades: DataFrame, period: str = "1 minute") -> DataFrame:
    """(exchange, symbol, period_start, open, high, low, close, volume, trades)."""
    grouped = trades.groupBy("exchange", "symbol", F.window("event_time", period).alias("w")).agg(*aggregates())
    return grouped.select("exchange", "symbol", F.col("w.start").alias("period_start"), "open", "high", "low", "close", "volume", "trades")


def rolled_up(fine: DataFrame, period: str = "1 hour") -> DataFrame:
    """Longer candles from shorter ones, without reading the trades again."""
    first, last = F.min_by("open", "period_start"), F.max_by("close", "period_start")
    grouped = fine.groupBy("exchange", "symbol", F.window("period_start", period).alias("w")).agg(
        first.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades")
    )
    return grouped.select("exchange", "symbol", F.col("w.start").alias("period_start"), "open", "high", "low", "close", "volume", "trades")


def candle_rules() -> dict[str, Column]:
    """What holds for every candle."""
    return {
        "high_bounds": F.expr("high >= greatest(open, close, low)"),
        "low_bounds": F.expr("low <= least(open, close, high)"),
        "volume_minimum": F.expr("volume >= 0"),
        "trades_minimum": F.expr("trades >= 1"),
    }
