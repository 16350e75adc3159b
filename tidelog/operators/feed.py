"""Continuity and health of recorded feed connections, message by message.

A message is judged whole and strictly, as it came: its envelope number first, then the counters of a
heartbeat message, then every trade of a trade message. One bad part makes the message malformed: none
of its trades counts. What its numbers tell about continuity still does if they were read before the
fault; if the fault lies in the numbers themselves, the baselines move on but nothing is counted.

Every connection has two streams, envelopes and heartbeats, each with a baseline of its own that only
moves forward; gaps, repeats and late numbers of both are counted together. Order within a
connection is ``arrival_no``; connections are cut into blocks of it, so none waits in one task.

Messages: connection_id string, arrival_no long, received_at timestamp, raw string.
Defined results: a null message is malformed; numbers beyond 64 bits are malformed; null connections
are a connection of their own; a message without events has no trades.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.operators import continuity
from tidelog.operators.running import running

ENVELOPES, HEARTBEATS = "envelope", "heartbeat"
EXCERPT = 256
#: log2 of the arrival numbers in a block.
BLOCK_BITS = 12
COUNTERS = ("envelopes", "trades", "heartbeats", "gaps", "duplicates", "out_of_order", "malformed")

_READ = (
    "connection_id string, arrival_no long, received_at timestamp, channel string, sequence long, counters array<long>, counted boolean, "
    "trades array<struct<trade_id:string,product_id:string,time:timestamp>>, reason string, message_bytes long, message_sha256 string, message_excerpt string"
)


class Malformed(ValueError):
    """A message that breaks the feed's contract; the text is the reason."""


def _whole(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise Malformed(f"invalid_{name}")
    if value < 0:
        raise Malformed(f"negative_{name}")
    if value >= 1 << 63:
        raise Malformed(f"too_large_{name}")
    return value


def _counter(event: Any) -> int:
    if not isinstance(event, dict):
        raise Malformed("invalid_heartbeat_event")
    value = event.get("heartbeat_counter")
    if value is None:
        raise Malformed("missing_heartbeat_counter")
    if isinstance(value, str):
        try:
            value = int(value)
        except ValueError as error:
            raise Malformed("invalid_heartbeat_counter") from error
    return _whole(value, "heartbeat_counter")


def _items(value: Any, name: str) -> list:
    """What Python iterates over: lists, and empty objects and texts, which hold nothing."""
    if isinstance(value, list):
        return value
    if value in ({}, ""):
        return []
    raise Malformed(f"invalid_{name}")


def _trade(trade: Any) -> dict:
    if not isinstance(trade, dict):
        raise Malformed("invalid_trade")
    for name in ("trade_id", "product_id", "time"):
        if name not in trade:
            raise Malformed(f"missing_{name}")
    try:
        moment = datetime.fromisoformat(str(trade["time"]).replace("Z", "+00:00"))
    except ValueError as error:
        raise Malformed("invalid_time") from error
    if moment.tzinfo is None:
        raise Malformed("time_without_zone")
    return {"trade_id": str(trade["trade_id"]), "product_id": str(trade["product_id"]), "time": moment}


def read_message(raw: str | None) -> dict[str, Any]:
    """channel, sequence, counters, counted, trades and reason of one message."""
    found: dict[str, Any] = {"channel": None, "sequence": None, "counters": [], "counted": False, "trades": [], "reason": None}
    try:
        if raw is None:
            raise Malformed("null_message")
        try:
            message = json.loads(raw)
        except (ValueError, RecursionError) as error:
            raise Malformed("invalid_json") from error
        if not isinstance(message, dict):
            raise Malformed("not_object")
        channel = message.get("channel")
        found["channel"] = channel if isinstance(channel, str) else None
        if message.get("sequence_num") is not None:
            found["sequence"] = _whole(message["sequence_num"], "sequence_num")
        if channel == "heartbeats":
            events = message.get("events", [])
            if not isinstance(events, list):
                raise Malformed("invalid_heartbeat_events")
            for event in events:
                found["counters"].append(_counter(event))
        found["counted"] = True
        if channel == "market_trades":
            trades = []
            for event in _items(message.get("events", []), "events"):
                if not isinstance(event, dict):
                    raise Malformed("invalid_event")
                trades += [_trade(t) for t in _items(event.get("trades", []), "trades")]
            found["trades"] = trades
    except Malformed as fault:
        found["reason"] = str(fault)
    return found


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = pd.DataFrame([read_message(raw) for raw in batch["raw"]], columns=["channel", "sequence", "counters", "counted", "trades", "reason"])
        data = [None if raw is None else raw.encode("utf-8", "replace") for raw in batch["raw"]]
        read["sequence"] = read["sequence"].astype("Int64")
        read["message_bytes"] = pd.array([None if d is None else len(d) for d in data], dtype="Int64")
        read["message_sha256"] = [None if d is None else hashlib.sha256(d).hexdigest() for d in data]
        read["message_excerpt"] = [None if raw is None else raw[:EXCERPT] for raw in batch["raw"]]
        yield pd.concat([batch[["connection_id", "arrival_no", "received_at"]].reset_index(drop=True), read], axis=1)


def read_messages(messages: DataFrame) -> DataFrame:
    """Every message once, judged. Batch or stream."""
    return messages.select("connection_id", "arrival_no", "received_at", "raw").mapInPandas(_reader, _READ)


def _block() -> Column:
    return F.shiftright("arrival_no", BLOCK_BITS).alias("block")


def observations(read: DataFrame) -> DataFrame:
    """Numbers in order, one row for each: connection_id, stream, arrival_no, place, current, counted, received_at, channel."""
    numbers = F.concat(
        F.when(F.col("sequence").isNotNull(), F.array(F.struct(F.lit(ENVELOPES).alias("stream"), F.col("sequence").alias("current")))).otherwise(F.array()),
        F.transform("counters", lambda c: F.struct(F.lit(HEARTBEATS).alias("stream"), c.alias("current"))),
    )
    placed = read.select("connection_id", "arrival_no", "received_at", "channel", "counted", F.posexplode(numbers).alias("place", "number"))
    return placed.select("connection_id", "number.stream", "arrival_no", "place", "number.current", "counted", "received_at", "channel", _block())


def feed_continuity(read: DataFrame) -> DataFrame:
    """The observations with previous, status, missing_from and missing_to by connection and stream."""
    return continuity.classified(observations(read), ["connection_id", "stream"], ["block"], ["arrival_no", "place"], "current")


def feed_health(read: DataFrame, judged: DataFrame) -> DataFrame:
    """The counters of its connection after every message: connection_id, arrival_no, received_at, COUNTERS, last_envelope, last_heartbeat.

    ``judged`` comes from ``feed_continuity``. Messages and observations meet by aggregation, not by a join.
    """
    nothing = {n: F.lit(0).cast("long") for n in COUNTERS}
    of_message = nothing | {"envelopes": F.lit(1).cast("long"), "trades": F.size("trades").cast("long"), "malformed": F.col("reason").isNotNull().cast("long")}

    def is_status(name: str) -> Column:
        return (F.col("status") == name).cast("long")

    of_number = nothing | {"heartbeats": (F.col("stream") == HEARTBEATS).cast("long"), "gaps": is_status("gap"), "duplicates": is_status("duplicate"), "out_of_order": is_status("out_of_order")}
    nobody = F.lit(None).cast("struct<place:int,current:long>")
    last = {f"last_{s}": F.when(F.col("stream") == s, F.struct("place", "current")) for s in (ENVELOPES, HEARTBEATS)}
    both = read.select("connection_id", "arrival_no", "received_at", _block(), *[c.alias(n) for n, c in of_message.items()], *[nobody.alias(n) for n in last]).unionByName(
        judged.where("counted").select("connection_id", "arrival_no", "received_at", "block", *[c.alias(n) for n, c in of_number.items()], *[c.alias(n) for n, c in last.items()])
    )
    each = both.groupBy("connection_id", "block", "arrival_no").agg(
        F.min("received_at").alias("received_at"), *[F.sum(n).alias(n) for n in COUNTERS], *[F.max(n).getField("current").alias(n) for n in last]
    )
    added = {n: ("sum", F.col(n)) for n in COUNTERS} | {n: ("last", F.col(n)) for n in last}
    own = each.select("connection_id", "block", "arrival_no", "received_at", *[F.col(n).alias(f"own_{n}") for n in (*COUNTERS, *last)])
    wanted = {n: (how, F.col(f"own_{n}")) for n, (how, _) in added.items()}
    return running(own, ["connection_id"], ["block"], ["arrival_no"], wanted).select("connection_id", "arrival_no", "received_at", *COUNTERS, *last, "own_trades", "own_malformed")


_KIND = {"duplicate": "duplicate_sequence", "out_of_order": "out_of_order_sequence"}


def feed_anomalies(judged: DataFrame, health: DataFrame) -> DataFrame:
    """An event for each gap, repeat and late number that counts, with the counters as they stood.

    The message's own trades and fault are counted after its numbers, so they are not in yet.
    """
    kind = F.when(F.col("status") == "gap", F.when(F.col("stream") == HEARTBEATS, "heartbeat_gap").otherwise("sequence_gap"))
    for status, name in _KIND.items():
        kind = kind.when(F.col("status") == status, F.lit(name))
    found = judged.where(F.col("counted") & F.col("status").isin("gap", *_KIND)).drop("received_at")
    met = found["connection_id"].eqNullSafe(health["connection_id"]) & (found["arrival_no"] == health["arrival_no"])
    name = F.to_json(F.struct(found["connection_id"], "stream", found["arrival_no"], "place"))
    return found.join(health, met).select(
        X.hyphenated(X.uuid5_hex(name)).alias("event_id"), kind.alias("observation_type"), found["connection_id"], found["arrival_no"], "received_at", "channel", "stream", "place",
        F.col("previous").alias("previous_sequence"), F.col("current").alias("current_sequence"), "missing_from", "missing_to",
        "envelopes", (F.col("trades") - F.col("own_trades")).alias("trades"), "heartbeats", "gaps", "duplicates", "out_of_order", (F.col("malformed") - F.col("own_malformed")).alias("malformed"),
        "last_envelope", "last_heartbeat",
    )


def feed_malformed(read: DataFrame) -> DataFrame:
    """(connection_id, arrival_no, reason, message_bytes, message_sha256, message_excerpt) of every malformed message."""
    return read.where("reason is not null").select("connection_id", "arrival_no", "reason", "message_bytes", "message_sha256", "message_excerpt")


def lifecycle_events(connections: DataFrame, timeout_s: float = continuity.HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """What happened to the connections of a source: (source, connection_id, at, observation_type, reason).

    ``connections``: source, connection_id, opened_at, last_sign, last_heartbeat. Every connection is
    opened; one that follows another of its source is recovered as well, and before it the earlier one
    was closed (for heartbeat silence if its last heartbeat, or its opening, was that long before its
    last sign), a reconnection scheduled and attempted. The last one is open still. A source's
    connections are few, as each is one row.
    """
    order = Window.partitionBy("source").orderBy("opened_at", "connection_id")
    seen = connections.withColumns({"following": F.lead("opened_at").over(order), "place": F.row_number().over(order)})
    silent = F.unix_micros("last_sign") - F.unix_micros(F.coalesce("last_heartbeat", "opened_at")) >= int(timeout_s * 1_000_000)

    def event(at: str, kind: str, when: Column, reason: Column | None = None) -> Column:
        return F.when(when, F.struct(F.col(at).alias("at"), F.lit(kind).alias("observation_type"), (F.lit(None).cast("string") if reason is None else reason).alias("reason")))

    followed = F.col("following").isNotNull()
    events = F.array_compact(
        F.array(
            event("opened_at", "connection_opened", F.lit(True)),
            event("opened_at", "connection_recovered", F.col("place") > 1),
            event("last_sign", "connection_closed", followed, F.when(silent, "heartbeat_silence").otherwise("stream_ended")),
            event("last_sign", "reconnect_scheduled", followed),
            event("following", "reconnect_attempt", followed),
        )
    )
    return seen.select("source", "connection_id", F.explode(events).alias("e")).select("source", "connection_id", "e.*")


#: The fields of the quality event in order, with their types.
QUALITY_EVENT = (
    "event_id string, event_type string, schema_version string, producer string, exchange string, connection_id string, trace_id string, observation_type string, detected_at timestamp, "
    "connection_started_at timestamp, affected_symbols array<string>, channel string, stream string, previous_sequence long, current_sequence long, missing_from long, missing_to long, "
    "last_envelope_sequence long, last_heartbeat_counter long, seconds_since_last_message double, seconds_since_last_heartbeat double, envelopes_observed long, trades_observed long, "
    "heartbeats_observed long, sequence_gap_count long, duplicate_sequence_count long, out_of_order_sequence_count long, malformed_message_count long, reason string, message_excerpt string, message_sha256 string"
)
_OBSERVED = {
    "envelopes": "envelopes_observed", "trades": "trades_observed", "heartbeats": "heartbeats_observed", "gaps": "sequence_gap_count", "duplicates": "duplicate_sequence_count",
    "out_of_order": "out_of_order_sequence_count", "malformed": "malformed_message_count", "last_envelope": "last_envelope_sequence", "last_heartbeat": "last_heartbeat_counter",
}


def health_summaries(health: DataFrame, interval_s: int = continuity.SUMMARY_INTERVAL_S) -> DataFrame:
    """The counters at the last message of every connection and interval that has one."""
    tick = F.floor(F.unix_micros("received_at") / (interval_s * 1_000_000))
    values = F.struct("arrival_no", "received_at", *COUNTERS, "last_envelope", "last_heartbeat")
    return health.groupBy("connection_id", tick.alias("tick")).agg(F.max_by(values, "arrival_no").alias("v")).select("connection_id", "v.*")


def heartbeat_silences(read: DataFrame, timeout_s: int = continuity.HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """One row for each time a connection's heartbeats stayed away: connection_id, silent_from, silent_to, seconds. The first message counts as a sign."""
    signs = read.where(F.col("counted") & (F.size("counters") > 0)).select("connection_id", "received_at")
    first = read.groupBy("connection_id").agg(F.min("received_at").alias("received_at"))
    return continuity.quiet_times(signs.unionByName(first), ["connection_id"], "received_at", timeout_s)


def quality_events(read: DataFrame, judged: DataFrame, health: DataFrame, connections: DataFrame) -> DataFrame:
    """All observations of a feed as events of QUALITY_EVENT.

    ``connections``: connection_id, source, opened_at, last_sign, last_heartbeat, symbols. Identifiers derive
    from what was observed, so a replay gives the same ones; trace identifiers are random.
    """
    at = F.timestamp_micros
    anomalies = feed_anomalies(judged, health).withColumn("detected_at", F.col("received_at"))
    bad = feed_malformed(read).withColumnRenamed("connection_id", "of_connection").withColumnRenamed("arrival_no", "of_arrival")
    malformed = health.join(bad, health["connection_id"].eqNullSafe(F.col("of_connection")) & (F.col("arrival_no") == F.col("of_arrival"))).withColumn("observation_type", F.lit("malformed_message"))
    timeout = continuity.HEARTBEAT_TIMEOUT_S
    silent = heartbeat_silences(read).select(
        "connection_id", at(F.col("silent_from") + timeout * 1_000_000).alias("received_at"), F.lit(float(timeout)).alias("seconds_since_last_heartbeat"), F.lit("heartbeats").alias("channel"),
        F.lit(HEARTBEATS).alias("stream"), F.lit("heartbeat_silence").alias("observation_type"), F.lit(f"no heartbeat for at least {timeout} seconds").alias("reason"),
    )
    lived = lifecycle_events(connections.select("source", "connection_id", "opened_at", "last_sign", "last_heartbeat")).select("connection_id", F.col("at").alias("received_at"), "observation_type", "reason")
    parts = [anomalies, malformed, silent, lived, health_summaries(health).withColumn("observation_type", F.lit("health_summary"))]
    names = [part.split() for part in QUALITY_EVENT.split(", ")]

    def shaped(part: DataFrame) -> DataFrame:
        own = part.withColumnsRenamed({old: new for old, new in _OBSERVED.items() if old in part.columns})
        wanted = [n for n, _ in names if n not in ("event_id", "event_type", "schema_version", "producer", "exchange", "trace_id", "detected_at", "connection_started_at", "affected_symbols")]
        kinds = dict((n, t) for n, t in names)
        columns = [F.col(n).cast(kinds[n]).alias(n) if n in own.columns else F.lit(0 if n in _OBSERVED.values() and not n.startswith("last_") else None).cast(kinds[n]).alias(n) for n in wanted]
        return own.select(*columns, F.col("received_at").alias("detected_at"), (F.col("arrival_no") if "arrival_no" in own.columns else F.lit(None).cast("long")).alias("arrival"), (F.col("place") if "place" in own.columns else F.lit(None).cast("int")).alias("place"))

    observed = shaped(parts[0])
    for part in parts[1:]:
        observed = observed.unionByName(shaped(part))
    known = connections.select(F.col("connection_id").alias("of_connection"), F.col("source").alias("exchange"), F.col("opened_at").alias("connection_started_at"), F.col("symbols").alias("affected_symbols"))
    joined = observed.join(known, F.col("connection_id").eqNullSafe(F.col("of_connection")))
    name = F.to_json(F.struct("connection_id", "observation_type", "stream", F.unix_micros("detected_at").alias("at"), "arrival", "place"))
    fixed = {"event_type": "market.data.quality", "schema_version": "v1", "producer": "apps.collector"}
    derived = {"event_id": X.hyphenated(X.uuid5_hex(name)), "trace_id": F.uuid(), **{n: F.lit(v) for n, v in fixed.items()}}
    return joined.withColumns(derived).select(*[F.col(n).cast(t).alias(n) for n, t in names])


def encoded_events(events: DataFrame) -> DataFrame:
    """(key, value, headers) of quality events: key exchange:connection, compact JSON with nulls kept, three headers."""
    headers = [F.struct(F.lit(n).alias("key"), F.encode(F.col(n), "utf-8").alias("value")) for n in ("event_type", "schema_version", "trace_id")]
    return events.select(
        F.encode(F.concat_ws(":", "exchange", "connection_id"), "utf-8").alias("key"),
        F.encode(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}), "utf-8").alias("value"),
        F.array(*headers).alias("headers"),
    )
