"""Schemas of the archived records and events, and the contracts' rules as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions import text as X

LOG_RECORD = (
    "topic string, partition int, offset long, timestamp timestamp, timestampType int, key binary, value binary, headers array<struct<key:string,value:binary>>"
)
ARCHIVE_ROW = (
    "kafka_topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, kafka_timestamp_type int, kafka_key binary, kafka_value binary, "
    "kafka_headers array<struct<key:string,value:binary>>, event_date date, event_hour string"
)
TRADE_EVENT = (
    "event_id string, event_type string, schema_version string, exchange string, symbol string, event_time timestamp, ingested_at timestamp, source_event_id string, "
    "source_sequence long, producer string, trace_id string, correlation_id string, causation_id string, payload string"
)
#: Kinds of quality events.
OBSERVATION_TYPES = (
    "connection_opened",
    "connection_closed",
    "connection_recovered",
    "reconnect_scheduled",
    "reconnect_attempt",
    "sequence_gap",
    "duplicate_sequence",
    "out_of_order_sequence",
    "heartbeat_gap",
    "heartbeat_silence",
    "malformed_message",
    "health_summary",
)
#: Counters and sequences of the quality event that are never negative.
NON_NEGATIVE = (
    "previous_sequence current_sequence missing_from missing_to last_envelope_sequence last_heartbeat_counter seconds_since_last_message "
    "seconds_since_last_heartbeat envelopes_observed trades_observed heartbeats_observed sequence_gap_count duplicate_sequence_count "
    "out_of_order_sequence_count malformed_message_count"
).split()


def _filled(name: str) -> Column:
    return F.coalesce(X.strip(F.col(name)) != "", F.lit(False))


def _uuid(name: str, optional: bool = False) -> Column:
    return F.coalesce(F.lower(F.col(name)).rlike(X.UUID_TEXT), F.lit(optional))


def _is(name: str, value: str) -> Column:
    return F.coalesce(F.col(name) == value, F.lit(False))


def trade_rules() -> dict[str, Column]:
    """Rule name -> whether a row of the trade event keeps it; never null."""
    return {
        "event_id_uuid5": F.coalesce(F.lower("event_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False)),
        "event_type_const": _is("event_type", "market.trade.raw"),
        "schema_version_const": _is("schema_version", "v1"),
        "exchange_filled": _filled("exchange"),
        "symbol_filled": _filled("symbol"),
        "event_time_present": F.col("event_time").isNotNull(),
        "ingested_at_present": F.col("ingested_at").isNotNull(),
        "source_event_id_filled": _filled("source_event_id"),
        "source_sequence_minimum": F.coalesce(F.col("source_sequence") >= 0, F.lit(True)),
        "producer_const": _is("producer", "apps.collector"),
        "trace_id_uuid": _uuid("trace_id"),
        "correlation_id_uuid": _uuid("correlation_id", True),
        "causation_id_uuid": _uuid("causation_id", True),
        "payload_object": F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False)),
    }


def quality_rules() -> dict[str, Column]:
    """Rule name -> whether a row of the quality event keeps it; never null."""
    symbols = F.coalesce("affected_symbols", F.array().cast("array<string>"))
    return {
        "event_id_uuid": _uuid("event_id"),
        "connection_id_uuid": _uuid("connection_id"),
        "trace_id_uuid": _uuid("trace_id"),
        "event_type_const": _is("event_type", "market.data.quality"),
        "schema_version_const": _is("schema_version", "v1"),
        "producer_const": _is("producer", "apps.collector"),
        "exchange_filled": _filled("exchange"),
        "observation_type_enum": F.coalesce(F.col("observation_type").isin(*OBSERVATION_TYPES), F.lit(False)),
        "detected_at_present": F.col("detected_at").isNotNull(),
        "connection_started_at_present": F.col("connection_started_at").isNotNull(),
        "affected_symbols_some": F.size(symbols) > 0,
        "affected_symbols_unique": F.size(symbols) == F.size(F.array_distinct(symbols)),
        "affected_symbols_upper": F.forall(symbols, lambda s: F.coalesce((s == F.upper(s)) & (s != ""), F.lit(False))),
        "reason_length": F.coalesce(F.length("reason") <= 500, F.lit(True)),
        "message_excerpt_length": F.coalesce(F.length("message_excerpt") <= 1024, F.lit(True)),
        "message_sha256_hex": F.coalesce(F.col("message_sha256").rlike("^[0-9a-f]{64}$"), F.lit(True)),
        **{f"{n}_minimum": F.coalesce(F.col(n) >= 0, F.lit(True)) for n in NON_NEGATIVE},
    }
