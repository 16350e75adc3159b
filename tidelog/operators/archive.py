"""The raw archive: projection of log records and the encoding of events as log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as X

#: Archive column -> log column.
RENAMES = {
    "kafka_topic": "topic",
    "kafka_partition": "partition",
    "kafka_offset": "offset",
    "kafka_timestamp": "timestamp",
    "kafka_timestamp_type": "timestampType",
    "kafka_key": "key",
    "kafka_value": "value",
    "kafka_headers": "headers",
}


def archive_rows(records: DataFrame) -> DataFrame:
    """Log records as archive rows; key, value and headers stay as they are. Batch or stream.

    The date and hour are those of the log timestamp in the session's zone, which is UTC; the hour
    is a two-digit text.
    """
    renamed = records.select(*[F.col(old).alias(new) for new, old in RENAMES.items()])
    return renamed.select("*", F.to_date("kafka_timestamp").alias("event_date"), F.date_format("kafka_timestamp", "HH").alias("event_hour"))


def log_records(archive: DataFrame) -> DataFrame:
    """Archive rows back as log records, to be replayed."""
    return archive.select(*[F.col(new).alias(old) for new, old in RENAMES.items()])


def event_id(exchange: Column, symbol: Column, source_event_id: Column) -> Column:
    return X.hyphenated(X.trade_identity_hex(exchange, symbol, source_event_id))


def trade_events(trades: DataFrame) -> DataFrame:
    """Normalised trades in the event envelope: derived identifier, fixed texts, no correlation or causation."""
    return trades.select(
        event_id(F.col("exchange"), F.col("symbol"), F.col("source_event_id")).alias("event_id"),
        F.lit("market.trade.raw").alias("event_type"),
        F.lit("v1").alias("schema_version"),
        X.strip(F.col("exchange")).alias("exchange"),
        X.strip(F.col("symbol")).alias("symbol"),
        "event_time",
        "ingested_at",
        X.strip(F.col("source_event_id")).alias("source_event_id"),
        "source_sequence",
        F.lit("apps.collector").alias("producer"),
        "trace_id",
        F.lit(None).cast("string").alias("correlation_id"),
        F.lit(None).cast("string").alias("causation_id"),
        "payload",
    )


def utc_text(moment: Column) -> Column:
    """ISO text with Z; microseconds only where there are some."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("Z"))


def encoded(events: DataFrame) -> DataFrame:
    """(key, value, headers) of trade events: key exchange:SYMBOL, compact JSON with nulls kept, three headers."""
    fields = [utc_text(F.col(c)).alias(c) if c in ("event_time", "ingested_at") else F.col(c) for c in events.columns if c != "payload"]
    head = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    # the payload goes in as it came, so numbers stay numbers
    value = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    headers = [F.struct(F.lit(n).alias("key"), F.encode(F.col(n), "utf-8").alias("value")) for n in ("event_type", "schema_version", "trace_id")]
    return events.select(
        F.encode(F.concat_ws(":", X.exchange_key(F.col("exchange")), X.symbol_key(F.col("symbol"))), "utf-8").alias("key"),
        F.encode(value, "utf-8").alias("value"),
        F.array(*headers).alias("headers"),
    )


def normalised_symbols(symbols: Column) -> Column:
    """Trimmed, upper-cased, blank ones dropped, each once in order of its first place."""
    clean = F.transform(symbols, lambda s: F.upper(X.strip(s)))
    return F.array_distinct(F.filter(clean, lambda s: s != ""))
