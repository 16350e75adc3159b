"""Continuity of feed sequences, heartbeats and connection counters.

A sequence's baseline moves forward only: the first number, the next one and a jump ahead move it,
repeats and late numbers do not. So the number before a row is the running maximum before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.operators.running import running

ANOMALIES = ("gap", "duplicate", "out_of_order")
HEARTBEAT_TIMEOUT_S, SUMMARY_INTERVAL_S = 10, 60

ENVELOPE = "channel string, client_id string, timestamp string, sequence_num string, events array<struct<type:string,heartbeat_counter:string,trades:array<map<string,string>>>>"


def status(previous: Column, current: Column) -> Column:
    return (
        F.when(previous.isNull(), "initialized")
        .when(current == previous + 1, "ok")
        .when(current == previous, "duplicate")
        .when(current < previous, "out_of_order")
        .otherwise("gap")
    )


def classified(df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``df`` with previous, status, missing_from, missing_to; rows without a number are left out."""
    seen = running(df.where(F.col(value).isNotNull()), keys, block, order, {"previous": ("max", F.col(value))}, inclusive=False)
    state = status(F.col("previous"), F.col(value))
    judged = seen.withColumn("status", state)
    gap = F.col("status") == "gap"
    return judged.withColumn("missing_from", F.when(gap, F.col("previous") + 1)).withColumn("missing_to", F.when(gap, F.col(value) - 1))


def gap_ranges(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return judged.where("status = 'gap'").select(*keys, "missing_from", "missing_to")


def health(judged: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``judged`` with the running counters and the last number received, also if it was out of order."""
    counts = {f"{n}_count": ("sum", (F.col("status") == n).cast("long")) for n in ANOMALIES}
    return running(judged, keys, block, order, {"observed": ("sum", F.lit(1).cast("long")), **counts, "last_observed": ("last", F.col(value))})


def silences(df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str], at: str, timeout_s: float = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """Intervals of at least ``timeout_s`` in which a key showed no sign: keys, silent_from, silent_to, seconds."""
    micros = F.unix_micros(F.col(at))
    seen = running(df.where(F.col(at).isNotNull()), keys, block, order, {"latest": ("max", micros)}, inclusive=False)
    quiet = micros - F.col("latest")
    return seen.where(quiet >= int(timeout_s * 1_000_000)).select(*keys, F.col("latest").alias("silent_from"), micros.alias("silent_to"), (quiet / 1e6).alias("seconds"))


def quiet_times(df: DataFrame, keys: Sequence[str], at: str, timeout_s: int = HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """As ``silences``, in order of time itself, for timeouts of a second and more.

    A silence cannot begin and end within one second, so seconds are reduced to their first and last sign
    before anything is put in order: a key has 3,600 rows an hour at most, however many signs it gives.
    """
    micros = F.unix_micros(F.col(at))
    second = F.floor(micros / 1_000_000)
    seconds = df.where(F.col(at).isNotNull()).groupBy(*keys, second.alias("second")).agg(F.min(micros).alias("first"), F.max(micros).alias("last"))
    hours = seconds.withColumn("hour", F.floor(F.col("second") / 3600))
    seen = running(hours, keys, ["hour"], ["second"], {"latest": ("max", F.col("last"))}, inclusive=False)
    quiet = F.col("first") - F.col("latest")
    return seen.where(quiet >= timeout_s * 1_000_000).select(*keys, F.col("latest").alias("silent_from"), F.col("first").alias("silent_to"), (quiet / 1e6).alias("seconds"))


def summaries(df: DataFrame, keys: Sequence[str], at: str, interval_s: int = SUMMARY_INTERVAL_S) -> DataFrame:
    """Rows per key and tumbling interval."""
    tick = F.floor(F.unix_micros(F.col(at)) / (interval_s * 1_000_000)) * interval_s
    return df.groupBy(*keys, tick.alias("tick_s")).agg(F.count("*").alias("observed"))


def envelopes(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Envelope text parsed by schema, beside the other columns."""
    return raw.withColumn("envelope", F.from_json(F.col(column).cast("string"), ENVELOPE))


def trades_of(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row for each trade of the market_trades envelopes; other channels and missing arrays yield none."""
    events = F.coalesce("envelope.events", F.array().cast("array<struct<type:string,heartbeat_counter:string,trades:array<map<string,string>>>>"))
    trades = F.flatten(F.transform(events, lambda e: F.coalesce(e["trades"], F.array().cast("array<map<string,string>>"))))
    found = parsed.where("envelope.channel = 'market_trades'").select(*keep, "envelope.sequence_num", F.posexplode(trades).alias("at", "trade"))
    return found.select(*keep, "sequence_num", "at", F.col("trade")["trade_id"].alias("trade_id"), F.col("trade")["product_id"].alias("product_id"), F.col("trade")["price"].alias("price"), F.col("trade")["size"].alias("size"), F.col("trade")["time"].alias("time"))


def heartbeats_of(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row for each heartbeat with its counter as number; a counter that is none gives null."""
    found = parsed.where("envelope.channel = 'heartbeats'").select(*keep, F.posexplode("envelope.events").alias("at", "event"))
    return found.select(*keep, "at", F.trim("event.heartbeat_counter").try_cast("long").alias("heartbeat_counter"))


COUNTERS = ("gap_count", "duplicate_count", "out_of_order_count")
_OBSERVATIONS = {"gap": "sequence_gap", "duplicate": "duplicate_sequence", "out_of_order": "out_of_order_sequence"}


def anomaly_events(counted: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, stream: str) -> DataFrame:
    """A quality observation for each anomaly, with the counters as they stood; ``counted`` comes from ``health``.

    The identifier is derived from key and place, so a replay gives the same one.
    """
    name = F.to_json(F.struct(F.lit(stream).alias("stream"), *keys, *order))
    kind = F.create_map(*[F.lit(x) for pair in _OBSERVATIONS.items() for x in pair])[F.col("status")]
    return counted.where(F.col("status").isin(*ANOMALIES)).select(
        X.hyphenated(X.uuid5_hex(name)).alias("event_id"),
        F.lit("market.data.quality").alias("event_type"),
        F.lit("v1").alias("schema_version"),
        kind.alias("observation_type"),
        F.lit(stream).alias("stream"),
        *keys,
        *order,
        F.col("previous").alias("previous_sequence"),
        F.col(value).alias("current_sequence"),
        "missing_from",
        "missing_to",
        F.col("last_observed").alias("last_envelope_sequence"),
        F.col("observed").alias("envelopes_observed"),
        *[F.col(c).alias(c.replace("_count", "_sequence_count").replace("gap_sequence", "sequence_gap")) for c in COUNTERS],
    )


def lifecycles(messages: DataFrame, source: str, connection: str, started: str, seen: str) -> DataFrame:
    """connection_opened for every connection of a source and, for every one after the first, connection_recovered as well.

    Connections are reduced before they are put in order, so a source's order holds one row for each.
    """
    each = messages.where(F.col(connection).isNotNull()).groupBy(source, connection).agg(F.min(started).alias("opened_at"), F.max(seen).alias("last_seen_at"))
    place = F.row_number().over(Window.partitionBy(source).orderBy("opened_at", connection))
    kinds = F.when(place == 1, F.array(F.lit("connection_opened"))).otherwise(F.array(F.lit("connection_opened"), F.lit("connection_recovered")))
    return each.withColumn("kinds", kinds).withColumn("observation_type", F.explode("kinds")).drop("kinds")
