"""Facts, dimensions and marts over curated trades and quality events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.operators.archive import normalised_symbols


def notional(price: Column, size: Column) -> Column:
    """The product to 12 decimals: exact up to ten digits before the point on either side, to six decimals beyond; null where it has no room."""
    exact = F.try_multiply(price.try_cast("decimal(18,8)"), size.try_cast("decimal(18,8)")).try_cast("decimal(38,12)")
    wide = F.try_multiply(price.try_cast("decimal(28,8)"), size.try_cast("decimal(28,8)")).try_cast("decimal(38,12)")
    return F.coalesce(exact, wide)


def fct_market_trade(trades: DataFrame) -> DataFrame:
    return trades.select("event_id", "exchange", "symbol", "event_time", "price", "size", "side", notional(F.col("price"), F.col("size")).alias("notional"))


def fct_quality_event(events: DataFrame) -> DataFrame:
    """Each event once (repeated rows are whole copies), names normalised."""
    latest = F.min_by(F.struct("observation_type", "detected_at", "affected_symbols", "sequence_gap_count", "malformed_message_count"), "detected_at").alias("e")
    once = events.where("event_id is not null").groupBy("event_id", "connection_id", X.exchange_key(F.col("exchange")).alias("exchange")).agg(latest)
    return once.select("event_id", "connection_id", "exchange", "e.observation_type", "e.detected_at", normalised_symbols(F.col("e.affected_symbols")).alias("symbols"))


def dim_instrument(trades: DataFrame) -> DataFrame:
    parts = F.split("symbol", "-")
    return trades.groupBy("exchange", "symbol").agg(F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen")).select(
        "exchange", "symbol", F.get(parts, 0).alias("base"), F.get(parts, 1).alias("quote"), "first_seen", "last_seen"
    )


def dim_exchange(trades: DataFrame) -> DataFrame:
    """Two steps, so that the distinct count is reduced before it is shuffled."""
    per = trades.groupBy("exchange", "symbol").agg(F.count("*").alias("n"))
    return per.groupBy("exchange").agg(F.count("*").alias("symbols"), F.sum("n").alias("trades"))


def mart_market_daily(trades: DataFrame) -> DataFrame:
    order = F.struct("event_time", "event_id")
    return trades.groupBy("exchange", "symbol", F.to_date("event_time").alias("day")).agg(
        F.count("*").alias("trades"), F.sum("size").alias("volume"), F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"), F.max("price").alias("high"), F.min("price").alias("low")
    )


def mart_pipeline_health_hourly(raw: DataFrame) -> DataFrame:
    """Per hour of arrival: records, records late by more than a minute, greatest and total lag in microseconds."""
    lag = F.unix_micros("kafka_timestamp") - F.unix_micros("event_time")
    rows = raw.select(F.date_trunc("hour", "kafka_timestamp").alias("hour"), lag.alias("lag"))
    return rows.groupBy("hour").agg(F.count("*").alias("records"), F.sum((F.col("lag") > 60_000_000).cast("long")).alias("late"), F.max("lag").alias("max_lag"), F.sum("lag").alias("total_lag"))


def mart_quality_daily(events: DataFrame) -> DataFrame:
    facts = fct_quality_event(events)
    return facts.groupBy("exchange", "observation_type", F.to_date("detected_at").alias("day")).agg(F.count("*").alias("events"))


def freshness(raw: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Per exchange: records and the lag's 50th, 95th and 99th percentile, by mergeable sketches."""
    lag = F.unix_micros("kafka_timestamp") - F.unix_micros("event_time")
    rows = raw.select(X.exchange_key(F.col("exchange")).alias("exchange"), lag.alias("lag"))
    marks = F.percentile_approx("lag", [0.5, 0.95, 0.99], accuracy)
    return rows.groupBy("exchange").agg(F.count("*").alias("records"), marks.alias("m")).select("exchange", "records", F.col("m")[0].alias("p50_us"), F.col("m")[1].alias("p95_us"), F.col("m")[2].alias("p99_us"))
