"""From raw trade events to curated trades: typed, normalised, each once, the rest set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.operators import archive, contracts

MONEY = "decimal(38,18)"


def _amount(text: Column) -> Column:
    return F.when(X.number(text).isNotNull(), F.trim(text).try_cast(MONEY))


def curated(raw: DataFrame) -> DataFrame:
    """Typed trades: normalised keys, derived identifier, price and size as decimals, side in capitals. Batch or stream."""
    parsed = raw.withColumn("_payload", F.from_json("payload", "price string, size string, side string"))
    return parsed.select(
        archive.event_id(F.col("exchange"), F.col("symbol"), F.col("source_event_id")).alias("event_id"),
        X.exchange_key(F.col("exchange")).alias("exchange"),
        X.symbol_key(F.col("symbol")).alias("symbol"),
        X.strip(F.col("source_event_id")).alias("source_event_id"),
        "source_sequence",
        "event_time",
        "ingested_at",
        _amount(F.col("_payload.price")).alias("price"),
        _amount(F.col("_payload.size")).alias("size"),
        F.upper("_payload.side").alias("side"),
        "kafka_partition",
        "kafka_offset",
        "kafka_timestamp",
    )


def trade_tests() -> dict[str, Column]:
    """Rules a curated trade must keep."""
    # the identifier is there if its three parts are; asking them spares a filter the digest
    identity = F.col("exchange").isNotNull() & F.col("symbol").isNotNull() & F.col("source_event_id").isNotNull()
    there = {f"{n}_present": F.col(n).isNotNull() for n in ("event_time", "price", "size")}
    return {"event_id_present": identity} | there | {
        "price_positive": F.coalesce(F.col("price") > 0, F.lit(False)),
        "size_positive": F.coalesce(F.col("size") > 0, F.lit(False)),
        "side_known": F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(True)),
        "not_before_event": F.coalesce(F.col("ingested_at") >= F.col("event_time"), F.lit(True)),
    }


def quarantined(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good trades, others with the first broken rule as reason)."""
    return contracts.split(trades, trade_tests())


def first_of_each(trades: DataFrame) -> DataFrame:
    """One row for each event_id: least ingested_at, then position. Rows are reduced before they are shuffled; rows without identity fall away."""
    order = F.struct(F.col("ingested_at").isNull(), "ingested_at", "kafka_partition", "kafka_offset")
    first = F.min_by(F.struct(*trades.columns), order).alias("row")
    named = trades.where("exchange is not null and symbol is not null and source_event_id is not null")
    return named.groupBy("event_id").agg(first).select("row.*")
