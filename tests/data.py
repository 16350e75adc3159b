"""Small frames in the schemas of the project's tables."""

from datetime import UTC, datetime, timedelta

TRADES = (
    "event_id string, event_type string, schema_version string, exchange string, symbol string, event_time timestamp, ingested_at timestamp, source_event_id string, source_sequence long, "
    "producer string, trace_id string, correlation_id string, causation_id string, payload string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, id string, rank int"
)
RECORDS = "kafka_topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, kafka_timestamp_type int, kafka_key binary, kafka_value binary, kafka_headers array<struct<key:string,value:binary>>"
START = datetime(2020, 1, 6, tzinfo=UTC)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def trade(offset, seconds=0.0, arrival=None, exchange="x", symbol="A-B", sid="1", price="10", size="1", partition=0, payload=..., event_id=None, sequence=None):
    """One row; ``id`` and ``rank`` are extra columns whose names clash with the operators' own."""
    arrival = seconds if arrival is None else arrival
    if payload is ...:
        payload = f'{{"price":{price if isinstance(price, int | float) else chr(34) + str(price) + chr(34)},"size":"{size}","side":"BUY"}}'
    return (
        event_id, "market.trade.raw", "v1", exchange, symbol, at(seconds), at(arrival), sid, sequence, "apps.collector", "11111111-2222-4333-8444-555555555555",
        None, None, payload, partition, offset, at(arrival), "clash", 1,
    )


def trades(spark, rows):
    return spark.createDataFrame(rows, TRADES)


def record(offset, value=b"v", partition=0, key=b"k", headers=None, seconds=0.0, kind=0, topic="t"):
    return (topic, partition, offset, at(seconds), kind, key, value, headers)


def records(spark, rows):
    return spark.createDataFrame(rows, RECORDS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
