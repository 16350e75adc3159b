"""Queries of the archive's own operators over the project's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog.functions import text as X
from tidelog.operators import archive, audit, candles, continuity, contracts, curated, data_tests, feed, models, reconcile, reject_rows
from tidelog.plans.problems import _KEYS, _NUMBER, _strip, parsed_sql, valid_sql
from tidelog.session import shared_dir, table, written
from tidelog.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kafka_record_snapshot")


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_kafka_record")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "market_trade_raw_event")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "market_data_quality_event")


def _text(at: str, pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS"):
    return F.date_format(at, pattern).alias(at)


_P = "kafka_topic, kafka_partition, kafka_offset"
_BOUNDS = """b AS (SELECT kafka_topic, kafka_partition, min(kafka_offset) AS earliest_offset, max(kafka_offset) + 1 AS ending_offset_exclusive, count(*) AS kafka_records
                   FROM kafka_record_snapshot GROUP BY 1, 2)"""
_INSIDE = f"""{_BOUNDS}, i AS (SELECT a.* FROM raw_kafka_record a JOIN b ON a.kafka_topic = b.kafka_topic AND a.kafka_partition = b.kafka_partition
                   AND a.kafka_offset >= b.earliest_offset AND a.kafka_offset < b.ending_offset_exclusive)"""
_MISSING = f"""m AS (SELECT DISTINCT {_P} FROM kafka_record_snapshot k WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.kafka_topic = k.kafka_topic
                   AND i.kafka_partition = k.kafka_partition AND i.kafka_offset = k.kafka_offset))"""
_DUPLICATES = f"d AS (SELECT {_P}, count(*) AS occurrences FROM i GROUP BY {_P} HAVING count(*) > 1)"


# --- audit ---------------------------------------------------------------------------------------


@query(
    f"""WITH {_INSIDE}, {_MISSING}, {_DUPLICATES},
    ci AS (SELECT kafka_topic t, kafka_partition p, count(*) n FROM i GROUP BY 1, 2), cm AS (SELECT kafka_topic t, kafka_partition p, count(*) n FROM m GROUP BY 1, 2),
    cd AS (SELECT kafka_topic t, kafka_partition p, count(*) n FROM d GROUP BY 1, 2)
    SELECT b.*, coalesce(ci.n, 0) AS parquet_records_in_range, coalesce(cm.n, 0) AS missing_from_parquet, coalesce(cd.n, 0) AS duplicate_parquet_positions
    FROM b LEFT JOIN ci ON ci.t = kafka_topic AND ci.p = kafka_partition LEFT JOIN cm ON cm.t = kafka_topic AND cm.p = kafka_partition
    LEFT JOIN cd ON cd.t = kafka_topic AND cd.p = kafka_partition"""
)
def flagship_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.partition_report(_log(spark, sf_dir), _archive(spark, sf_dir))


@query(f"SELECT {_P} FROM kafka_record_snapshot")
def kafka_identity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.positions(_log(spark, sf_dir))


def _comparable(rows: DataFrame) -> DataFrame:
    """All columns of the archive in types that both engines write alike."""
    header = F.transform("kafka_headers", lambda h: F.concat(F.coalesce(h["key"], F.lit("?")), F.lit("="), F.coalesce(F.hex(h["value"]), F.lit("?"))))
    return rows.select(
        *audit.POSITION, F.unix_micros("kafka_timestamp").alias("timestamp_us"), F.col("kafka_timestamp_type").alias("timestamp_type"), F.hex("kafka_key").alias("key"),
        F.sha2("kafka_value", 256).alias("value_sha256"), F.octet_length("kafka_value").cast("long").alias("value_bytes"), F.array_join(header, ",").alias("headers"),
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "event_hour",
    )


@query(
    f"""SELECT {_P}, epoch_us(kafka_timestamp) AS timestamp_us, kafka_timestamp_type AS timestamp_type, hex(kafka_key) AS key, sha256(kafka_value) AS value_sha256,
    CAST(octet_length(kafka_value) AS BIGINT) AS value_bytes, array_to_string(list_transform(kafka_headers, lambda h: coalesce(h.key, '?') || '=' || coalesce(hex(h.value), '?')), ',') AS headers,
    strftime(kafka_timestamp, '%Y-%m-%d') AS event_date, strftime(kafka_timestamp, '%H') AS event_hour FROM kafka_record_snapshot"""
)
def archive_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(archive.archive_rows(archive.log_records(_log(spark, sf_dir))))


@query(f"WITH {_BOUNDS} SELECT * FROM b")
def partition_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.partition_bounds(_log(spark, sf_dir))


@query(f"WITH {_INSIDE} SELECT {_P} FROM i")
def retained_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.positions(audit.in_range(_archive(spark, sf_dir), audit.partition_bounds(_log(spark, sf_dir))))


@query(f"WITH {_INSIDE}, {_MISSING} SELECT * FROM m")
def missing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return audit.missing_positions(log, audit.in_range(_archive(spark, sf_dir), audit.partition_bounds(log)))


@query(f"WITH {_INSIDE}, {_DUPLICATES} SELECT * FROM d")
def duplicate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_positions(audit.in_range(_archive(spark, sf_dir), audit.partition_bounds(_log(spark, sf_dir))))


@query(f"WITH {_INSIDE}, {_MISSING} SELECT * FROM m ORDER BY {_P} LIMIT 20")
def sample_missing_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_positions(spark, sf_dir).orderBy(*audit.POSITION).limit(20)


def _filled_sql(name: str) -> str:
    return f"coalesce(json_type(v, '$.{name}') = 'VARCHAR' AND {_strip(f"json_extract_string(v, '$.{name}')")} <> '', false)"


_READABLE = f"""CASE WHEN unread IS NOT NULL THEN unread WHEN NOT {_filled_sql('event_id')} THEN 'missing_or_invalid_event_id' WHEN NOT {_filled_sql('event_type')} THEN 'missing_or_invalid_event_type'
    WHEN NOT {_filled_sql('schema_version')} THEN 'missing_or_invalid_schema_version' END"""
_CHECKED = f"c AS (SELECT {_P}, kafka_value, v, {_READABLE} AS invalid_reason FROM w)"


@query(f"WITH {parsed_sql('raw_kafka_record')}, {_CHECKED} SELECT {_P}, CASE WHEN invalid_reason IS NULL THEN json_extract_string(v, '$.event_id') END AS event_id, invalid_reason FROM c")
def event_validation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.validated(_archive(spark, sf_dir))


@query(
    f"""WITH {parsed_sql('raw_kafka_record')}, {_CHECKED} SELECT json_extract_string(v, '$.event_id') AS event_id, count(*) AS occurrences FROM c WHERE invalid_reason IS NULL GROUP BY 1 HAVING count(*) > 1"""
)
def duplicate_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_event_ids(audit.validated(_archive(spark, sf_dir)))


_GLOBAL = f"""{_INSIDE}, {parsed_sql('i')}, {_CHECKED}, e AS (SELECT json_extract_string(v, '$.event_id') AS id FROM c WHERE invalid_reason IS NULL GROUP BY 1 HAVING count(*) > 1)"""


@query(
    f"""WITH {_GLOBAL} SELECT (SELECT count(*) FROM kafka_record_snapshot) AS kafka_records, (SELECT count(*) FROM c WHERE invalid_reason IS NOT NULL) AS invalid_event_values,
    (SELECT count(*) FROM e) AS duplicate_event_ids"""
)
def report_global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.global_counts(_log(spark, sf_dir), _archive(spark, sf_dir))


@query(
    f"""WITH {_GLOBAL}, {_MISSING}, {_DUPLICATES} SELECT min(b.kafka_topic) AS topic, count(*) AS partitions, CAST(sum(kafka_records) AS BIGINT) AS kafka_records, (SELECT count(*) FROM i) AS archived, (SELECT count(*) FROM m) AS missing,
    (SELECT count(*) FROM d) AS repeated, (SELECT count(*) FROM c WHERE invalid_reason IS NOT NULL) AS invalid, (SELECT count(*) FROM e) AS repeated_ids, 'failed' AS status,
    least(20, (SELECT count(*) FROM m)) + least(20, (SELECT count(*) FROM d)) + least(20, (SELECT count(*) FROM c WHERE invalid_reason IS NOT NULL)) + least(20, (SELECT count(*) FROM e)) AS sampled FROM b"""
)
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit, and its report in one row."""
    body = audit.audit(_log(spark, sf_dir), _archive(spark, sf_dir)).body
    sums = [sum(p[n] for p in body["partitions"]) for n in ("kafka_records", *audit.COUNTERS)]
    row = [body["topic"], len(body["partitions"]), *sums, body["invalid_event_values"], body["duplicate_event_ids"], body["status"], sum(map(len, body["samples"].values()))]
    return spark.createDataFrame([row], "topic string, partitions long, kafka_records long, archived long, missing long, repeated long, invalid long, repeated_ids long, status string, sampled long")


_EXCERPT = "substr(TRY(decode(kafka_value)), 1, 256) AS message_excerpt"


def _of_valid_text(df: DataFrame) -> DataFrame:
    """An excerpt with replaced bytes is the engine's own; the SQL knows those of valid texts."""
    return df.withColumn("message_excerpt", F.when(~F.col("message_excerpt").contains("\ufffd"), F.col("message_excerpt")))


@query(f"SELECT {_P}, sha256(kafka_value) AS message_sha256, CASE WHEN NOT contains(TRY(decode(kafka_value)), chr(65533)) THEN substr(TRY(decode(kafka_value)), 1, 256) END AS message_excerpt FROM raw_kafka_record")
def malformed_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_valid_text(audit.value_fingerprint(_archive(spark, sf_dir), 1 << 30)).withColumn("message_excerpt", F.substring("message_excerpt", 1, 256))


@query(
    f"""WITH {parsed_sql('raw_kafka_record')}, {_CHECKED} SELECT {_P}, invalid_reason AS reason, CAST(octet_length(kafka_value) AS BIGINT) AS message_bytes, sha256(kafka_value) AS message_sha256
    FROM c WHERE invalid_reason IS NOT NULL"""
)
def malformed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts are compared by malformed_fingerprint."""
    return audit.malformed_messages(_archive(spark, sf_dir)).drop("message_excerpt").withColumn("message_bytes", F.col("message_bytes").cast("long"))


# --- continuity ----------------------------------------------------------------------------------

_V5 = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4) + 1, 1)
    || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
_SEQ = ["exchange", "symbol"]
_BLOCK = ["kafka_partition", "block"]
_ORDER = ["kafka_partition", "kafka_offset"]
_SEQUENCE = f"""s AS (SELECT {_KEYS}, kafka_partition, kafka_offset, source_sequence FROM market_trade_raw_event WHERE source_sequence IS NOT NULL),
    p AS (SELECT *, max(source_sequence) OVER (PARTITION BY exchange, symbol ORDER BY kafka_partition, kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM s),
    c AS (SELECT *, CASE WHEN previous IS NULL THEN 'initialized' WHEN source_sequence = previous + 1 THEN 'ok' WHEN source_sequence = previous THEN 'duplicate'
                         WHEN source_sequence < previous THEN 'out_of_order' ELSE 'gap' END AS status FROM p)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _trades(spark, sf_dir)
    return trades.select(
        X.exchange_key(F.col("exchange")).alias("exchange"), X.symbol_key(F.col("symbol")).alias("symbol"), "kafka_partition", "kafka_offset",
        F.shiftright("kafka_offset", 12).alias("block"), "source_sequence", "kafka_timestamp",
    )


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.classified(_arrivals(spark, sf_dir), _SEQ, _BLOCK, _ORDER, "source_sequence")


@query(f"WITH {_SEQUENCE} SELECT exchange, symbol, kafka_partition, kafka_offset, source_sequence, previous, status FROM c")
def sequence_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select(*_SEQ, *_ORDER, "source_sequence", "previous", "status")


@query(f"WITH {_SEQUENCE} SELECT exchange, symbol, previous + 1 AS missing_from, source_sequence - 1 AS missing_to FROM c WHERE status = 'gap'")
def sequence_gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.gap_ranges(_classified(spark, sf_dir), _SEQ)


@query(
    f"""WITH {_SEQUENCE} SELECT exchange, symbol, kafka_partition, kafka_offset, CAST(count(*) OVER w AS BIGINT) AS observed,
    CAST(sum(CASE WHEN status = 'gap' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS gap_count, CAST(sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS duplicate_count,
    CAST(sum(CASE WHEN status = 'out_of_order' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS out_of_order_count, source_sequence AS last_observed
    FROM c WINDOW w AS (PARTITION BY exchange, symbol ORDER BY kafka_partition, kafka_offset ROWS UNBOUNDED PRECEDING)"""
)
def running_health_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = continuity.health(_classified(spark, sf_dir), _SEQ, _BLOCK, _ORDER, "source_sequence")
    return seen.select(*_SEQ, *_ORDER, "observed", "gap_count", "duplicate_count", "out_of_order_count", "last_observed")


@query(
    f"""WITH {_SEQUENCE}, h AS (SELECT *, sha1(unhex('{X.NAMESPACE_URL}') || encode('{{"stream":"trades","exchange":"' || exchange || '","symbol":"' || symbol || '","kafka_partition":' || kafka_partition || ',"kafka_offset":' || kafka_offset || '}}')) AS h,
    CAST(count(*) OVER w AS BIGINT) AS envelopes_observed, CAST(sum(CASE WHEN status = 'gap' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS sequence_gap_count,
    CAST(sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS duplicate_sequence_count, CAST(sum(CASE WHEN status = 'out_of_order' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS out_of_order_sequence_count
    FROM c WINDOW w AS (PARTITION BY exchange, symbol ORDER BY kafka_partition, kafka_offset ROWS UNBOUNDED PRECEDING))
    SELECT {_V5} AS event_id, 'market.data.quality' AS event_type, 'v1' AS schema_version, CASE status WHEN 'gap' THEN 'sequence_gap' WHEN 'duplicate' THEN 'duplicate_sequence' ELSE 'out_of_order_sequence' END AS observation_type,
    'trades' AS stream, exchange, symbol, kafka_partition, kafka_offset, previous AS previous_sequence, source_sequence AS current_sequence, CASE WHEN status = 'gap' THEN previous + 1 END AS missing_from,
    CASE WHEN status = 'gap' THEN source_sequence - 1 END AS missing_to, source_sequence AS last_envelope_sequence, envelopes_observed, sequence_gap_count, duplicate_sequence_count, out_of_order_sequence_count
    FROM h WHERE status IN ('gap', 'duplicate', 'out_of_order')"""
)
def anomaly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = continuity.health(_classified(spark, sf_dir), _SEQ, _BLOCK, _ORDER, "source_sequence")
    return continuity.anomaly_events(counted, _SEQ, _ORDER, "source_sequence", "trades")


@query(
    f"""WITH e AS (SELECT lower({_strip('exchange')}) AS exchange, connection_id, min(connection_started_at) AS opened, max(detected_at) AS seen FROM market_data_quality_event
    WHERE connection_id IS NOT NULL GROUP BY 1, 2) SELECT exchange, connection_id, epoch_us(opened) AS opened_us, epoch_us(seen) AS last_seen_us,
    unnest(CASE WHEN row_number() OVER (PARTITION BY exchange ORDER BY opened NULLS FIRST, connection_id) = 1 THEN ['connection_opened'] ELSE ['connection_opened', 'connection_recovered'] END) AS observation_type FROM e"""
)
def connection_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _quality(spark, sf_dir).withColumn("exchange", X.exchange_key(F.col("exchange")))
    found = continuity.lifecycles(events, "exchange", "connection_id", "connection_started_at", "detected_at")
    return found.select("exchange", "connection_id", F.unix_micros("opened_at").alias("opened_us"), F.unix_micros("last_seen_at").alias("last_seen_us"), "observation_type")


@query(f"WITH {_SEQUENCE} SELECT exchange, symbol, arg_max(source_sequence, (kafka_partition, kafka_offset)) AS last_observed, max(source_sequence) AS baseline FROM s GROUP BY 1, 2")
def last_observed_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir).where("source_sequence is not null")
    return rows.groupBy(*_SEQ).agg(F.max_by("source_sequence", F.struct(*_ORDER)).alias("last_observed"), F.max("source_sequence").alias("baseline"))


@query(
    f"""WITH s AS (SELECT {_KEYS}, epoch_us(kafka_timestamp) AS t, kafka_partition, kafka_offset FROM market_trade_raw_event),
    p AS (SELECT *, max(t) OVER (PARTITION BY exchange ORDER BY t, kafka_partition, kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM s)
    SELECT exchange, latest AS silent_from, t AS silent_to, (t - latest) / 1e6 AS seconds FROM p WHERE t - latest >= 60000000"""
)
def heartbeat_silence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.quiet_times(_arrivals(spark, sf_dir), ["exchange"], "kafka_timestamp", 60)


@query(f"SELECT exchange, tick_s, CAST(count(*) AS BIGINT) AS observed FROM (SELECT {_KEYS}, epoch_us(kafka_timestamp) // 60000000 * 60 AS tick_s FROM market_trade_raw_event) GROUP BY 1, 2")
def health_summary_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.summaries(_arrivals(spark, sf_dir), ["exchange"], "kafka_timestamp")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed envelopes around the stored trades: two trades a message of the trade channel, and heartbeats."""
    trades = _trades(spark, sf_dir).where("source_sequence is not null")
    head = F.concat(F.lit('{"channel":"market_trades","client_id":"","timestamp":"","sequence_num":'), F.col("source_sequence").cast("string"))
    body = F.concat(head, F.lit(',"events":[{"type":"update","trades":['), F.col("payload"), F.lit(","), F.col("payload"), F.lit("]}]}"))
    beat = F.concat(F.lit('{"channel":"heartbeats","sequence_num":0,"events":[{"heartbeat_counter":" '), F.col("source_sequence").cast("string"), F.lit('"},{"heartbeat_counter":"x"}]}'))
    return trades.select(*_ORDER, body.alias("raw"), beat.alias("beat"))


@query(
    """SELECT kafka_partition, kafka_offset, CAST(source_sequence AS VARCHAR) AS sequence_num, n AS "at", json_extract_string(payload, '$.trade_id') AS trade_id,
    json_extract_string(payload, '$.product_id') AS product_id, json_extract_string(payload, '$.price') AS price, json_extract_string(payload, '$.size') AS size, json_extract_string(payload, '$.time') AS time, epoch_us(CAST(json_extract_string(payload, '$.time') AS TIMESTAMPTZ)) AS time_us FROM market_trade_raw_event, (VALUES (0), (1)) v(n) WHERE source_sequence IS NOT NULL"""
)
def flatten_message_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = continuity.trades_of(continuity.envelopes(_messages(spark, sf_dir)), *_ORDER)
    return found.select(*_ORDER, "sequence_num", "at", "trade_id", "product_id", "price", "size", "time", F.unix_micros(X.instant(F.col("time"))).alias("time_us"))


@query(
    """SELECT kafka_partition, kafka_offset, n AS "at", CASE WHEN n = 0 THEN source_sequence END AS heartbeat_counter
    FROM market_trade_raw_event, (VALUES (0), (1)) v(n) WHERE source_sequence IS NOT NULL"""
)
def flatten_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.heartbeats_of(continuity.envelopes(_messages(spark, sf_dir), "beat"), *_ORDER)


# --- identity, envelope, contracts ---------------------------------------------------------------

_NAME = f"""'["market.trade.raw","v1","' || lower({_strip('exchange')}) || '","' || upper({_strip('symbol')}) || '","' || {_strip('source_event_id')} || '"]'"""
def _ids_sql(source: str) -> str:
    return f"ids AS (SELECT *, {_V5} AS derived_id FROM (SELECT *, sha1(unhex('{X.NAMESPACE_URL}') || encode({_NAME})) AS h FROM {source}))"


_IDS = _ids_sql("market_trade_raw_event")


@query(f"WITH {_IDS} SELECT kafka_partition, kafka_offset, derived_id FROM ids")
def event_id_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir).select(*_ORDER, archive.event_id(F.col("exchange"), F.col("symbol"), F.col("source_event_id")).alias("derived_id"))


@query(
    f"""WITH {_IDS} SELECT derived_id AS event_id, 'market.trade.raw' AS event_type, 'v1' AS schema_version, {_strip('exchange')} AS exchange, {_strip('symbol')} AS symbol,
    epoch_us(event_time) AS event_time, epoch_us(ingested_at) AS ingested_at, {_strip('source_event_id')} AS source_event_id, source_sequence, 'apps.collector' AS producer, trace_id,
    CAST(NULL AS VARCHAR) AS correlation_id, CAST(NULL AS VARCHAR) AS causation_id, payload FROM ids"""
)
def envelope_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.trade_events(_trades(spark, sf_dir)).withColumns({n: F.unix_micros(n) for n in ("event_time", "ingested_at")})


def _json_sql() -> str:
    def time(name: str) -> str:
        return f"""'"' || strftime({name}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({name}) % 1000000 = 0 THEN '' ELSE strftime({name}, '.%f') END || 'Z"'"""

    text = {n: f"to_json({_strip(n)})" for n in ("exchange", "symbol", "source_event_id")} | {"event_id": "to_json(derived_id)", "trace_id": "to_json(trace_id)", "source_sequence": "CAST(source_sequence AS VARCHAR)"}
    text |= {n: f"""'"{v}"'""" for n, v in (("event_type", "market.trade.raw"), ("schema_version", "v1"), ("producer", "apps.collector"))} | {n: time(n) for n in ("event_time", "ingested_at")} | {"payload": "payload"}
    names = [part.split()[0] for part in schemas.TRADE_EVENT.split(", ")]
    return "'{' || " + " || ',' || ".join(f"""'"{n}":' || coalesce(CAST({text.get(n, 'NULL')} AS VARCHAR), 'null')""" for n in names) + " || '}'"


@query(
    f"""WITH {_IDS} SELECT lower({_strip('exchange')}) || ':' || upper({_strip('symbol')}) AS key, {_json_sql()} AS value,
    'event_type=market.trade.raw,schema_version=v1,trace_id=' || coalesce(trace_id, '?') AS headers FROM ids"""
)
def kafka_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive.encoded(archive.trade_events(_trades(spark, sf_dir)))
    header = F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), F.coalesce(F.decode(h["value"], "utf-8"), F.lit("?"))))
    return records.select(F.decode("key", "utf-8").alias("key"), F.decode("value", "utf-8").alias("value"), F.array_join(header, ",").alias("headers"))


@query(
    f"""WITH n AS (SELECT event_id, connection_id, list_filter(list_transform(affected_symbols, lambda s: upper({_strip('s')})), lambda s: s <> '') AS l FROM market_data_quality_event)
    SELECT event_id, connection_id, array_to_string(list_filter(l, lambda s, i: list_position(l, s) = i), ',') AS symbols FROM n"""
)
def symbol_normalise_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = archive.normalised_symbols(F.col("affected_symbols"))
    return _quality(spark, sf_dir).select("event_id", "connection_id", F.array_join(symbols, ",").alias("symbols"))


@query(
    f"""WITH r AS (SELECT * FROM market_trade_raw_event),
    v AS (SELECT 'event_id_uuid5' AS rule, count(*) FILTER (WHERE NOT coalesce(regexp_matches(lower(event_id), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-5[0-9a-f]{{3}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$'), false)) AS violations FROM r
    UNION ALL SELECT 'event_type_const', count(*) FILTER (WHERE event_type IS DISTINCT FROM 'market.trade.raw') FROM r
    UNION ALL SELECT 'schema_version_const', count(*) FILTER (WHERE schema_version IS DISTINCT FROM 'v1') FROM r
    UNION ALL SELECT 'exchange_filled', count(*) FILTER (WHERE coalesce({_strip('exchange')}, '') = '') FROM r
    UNION ALL SELECT 'symbol_filled', count(*) FILTER (WHERE coalesce({_strip('symbol')}, '') = '') FROM r
    UNION ALL SELECT 'event_time_present', count(*) FILTER (WHERE event_time IS NULL) FROM r
    UNION ALL SELECT 'ingested_at_present', count(*) FILTER (WHERE ingested_at IS NULL) FROM r
    UNION ALL SELECT 'source_event_id_filled', count(*) FILTER (WHERE coalesce({_strip('source_event_id')}, '') = '') FROM r
    UNION ALL SELECT 'source_sequence_minimum', count(*) FILTER (WHERE source_sequence < 0) FROM r
    UNION ALL SELECT 'producer_const', count(*) FILTER (WHERE producer IS DISTINCT FROM 'apps.collector') FROM r
    UNION ALL SELECT 'trace_id_uuid', count(*) FILTER (WHERE NOT coalesce(regexp_matches(lower(trace_id), '{X.UUID_TEXT}'), false)) FROM r
    UNION ALL SELECT 'correlation_id_uuid', count(*) FILTER (WHERE NOT coalesce(regexp_matches(lower(correlation_id), '{X.UUID_TEXT}'), true)) FROM r
    UNION ALL SELECT 'causation_id_uuid', count(*) FILTER (WHERE NOT coalesce(regexp_matches(lower(causation_id), '{X.UUID_TEXT}'), true)) FROM r
    UNION ALL SELECT 'payload_object', count(*) FILTER (WHERE NOT coalesce(json_type(try_cast(payload AS JSON)) = 'OBJECT', false)) FROM r)
    SELECT rule, CAST(violations AS BIGINT) AS violations FROM v"""
)
def contract_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violation_counts(_trades(spark, sf_dir), schemas.trade_rules())


def _quality_sql() -> str:
    def uuid(c: str) -> str:
        return f"coalesce(regexp_matches(lower({c}), '{X.UUID_TEXT}'), false)"

    symbols = "coalesce(affected_symbols, CAST([] AS VARCHAR[]))"
    kinds = ", ".join(f"'{k}'" for k in schemas.OBSERVATION_TYPES)
    kept = {
        "event_id_uuid": uuid("event_id"),
        "connection_id_uuid": uuid("connection_id"),
        "trace_id_uuid": uuid("trace_id"),
        "event_type_const": "coalesce(event_type = 'market.data.quality', false)",
        "schema_version_const": "coalesce(schema_version = 'v1', false)",
        "producer_const": "coalesce(producer = 'apps.collector', false)",
        "exchange_filled": f"coalesce({_strip('exchange')} <> '', false)",
        "observation_type_enum": f"coalesce(observation_type IN ({kinds}), false)",
        "detected_at_present": "detected_at IS NOT NULL",
        "connection_started_at_present": "connection_started_at IS NOT NULL",
        "affected_symbols_some": f"len({symbols}) > 0",
        "affected_symbols_unique": f"len({symbols}) = len(list_distinct({symbols}))",
        "affected_symbols_upper": f"len(list_filter({symbols}, lambda s: NOT coalesce(s = upper(s) AND s <> '', false))) = 0",
        "reason_length": "coalesce(length(reason) <= 500, true)",
        "message_excerpt_length": "coalesce(length(message_excerpt) <= 1024, true)",
        "message_sha256_hex": "coalesce(regexp_matches(message_sha256, '^[0-9a-f]{64}$'), true)",
        **{f"{n}_minimum": f"coalesce({n} >= 0, true)" for n in schemas.NON_NEGATIVE},
    }
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(count(*) FILTER (WHERE NOT ({sql})) AS BIGINT) AS violations FROM market_data_quality_event" for rule, sql in kept.items())


@query(_quality_sql())
def quality_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violation_counts(_quality(spark, sf_dir), schemas.quality_rules())


# --- curated trades, candles, models -------------------------------------------------------------


def _amount(name: str) -> str:
    text = f"trim(json_extract_string(payload, '$.{name}'))"
    return f"CASE WHEN regexp_matches({text}, {_NUMBER}) THEN TRY_CAST({text} AS DOUBLE) END AS {name}"


def _curated_sql(ids: str) -> str:
    return f"""{ids}, t AS (SELECT derived_id AS event_id, {_KEYS}, {_strip('source_event_id')} AS source_event_id, source_sequence, event_time, ingested_at, {_amount('price')}, {_amount('size')},
    upper(json_extract_string(payload, '$.side')) AS side, kafka_partition, kafka_offset, kafka_timestamp FROM ids),
    j AS (SELECT *, CASE WHEN event_id IS NULL THEN 'event_id_present' WHEN event_time IS NULL THEN 'event_time_present' WHEN price IS NULL THEN 'price_present' WHEN size IS NULL THEN 'size_present'
      WHEN price <= 0 THEN 'price_positive' WHEN size <= 0 THEN 'size_positive' WHEN side NOT IN ('BUY', 'SELL') THEN 'side_known' WHEN ingested_at < event_time THEN 'not_before_event' END AS reason FROM t),
    o AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at, kafka_partition, kafka_offset) AS n FROM j WHERE reason IS NULL) WHERE n = 1)"""


_CURATED = _curated_sql(_IDS)


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated.quarantined(curated.curated(_trades(spark, sf_dir)))[0]


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated.first_of_each(_good(spark, sf_dir))


def _numbers(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6).cast("double") for n in names})


@query(f"WITH {_CURATED} SELECT event_id, exchange, symbol, kafka_partition, kafka_offset, round(price, 6) AS price, round(size, 6) AS size, side FROM o")
def curated_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(_once(spark, sf_dir), "price", "size").select("event_id", "exchange", "symbol", "kafka_partition", "kafka_offset", "price", "size", "side")


@query(f"WITH {_CURATED} SELECT kafka_partition, kafka_offset, reason FROM j WHERE reason IS NOT NULL")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated.quarantined(curated.curated(_trades(spark, sf_dir)))[1].select("kafka_partition", "kafka_offset", "reason")


def _candle_sql(seconds: int) -> str:
    return f"""WITH {_CURATED} SELECT exchange, symbol, strftime(make_timestamp(epoch_us(event_time) // {seconds}000000 * {seconds}000000), '%Y-%m-%d %H:%M') AS period_start,
    round(arg_min(price, (event_time, event_id)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (event_time, event_id)), 6) AS close,
    CAST(round(sum(CAST(size AS DECIMAL(38,12))), 6) AS DOUBLE) AS volume, CAST(count(*) AS BIGINT) AS trades FROM o GROUP BY exchange, symbol, epoch_us(event_time) // {seconds}000000"""


def _shown(bars: DataFrame) -> DataFrame:
    return _numbers(bars, "open", "high", "low", "close", "volume").withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd HH:mm"))


@query(_candle_sql(60))
def candles_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(candles.candles(_once(spark, sf_dir)))


@query(_candle_sql(3600))
def candles_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(candles.rolled_up(candles.candles(_once(spark, sf_dir))))


#: Candles over everything that could be read, good or not, so that the rules have something to find.
_RAW_BARS = f"""{_CURATED}, a AS (SELECT arg_min(price, (event_time, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (event_time, event_id)) AS close, sum(CAST(size AS DECIMAL(38,12))) AS volume, count(*) AS trades
    FROM t WHERE event_time IS NOT NULL GROUP BY exchange, symbol, epoch_us(event_time) // 60000000)"""
_BAR_RULES = {
    "high_bounds": "high >= greatest(open, close, low)",
    "low_bounds": "low <= least(open, close, high)",
    "volume_minimum": "volume >= 0",
    "trades_minimum": "trades >= 1",
}


def _violated(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(count(*) FILTER (WHERE NOT ({sql})) AS BIGINT) AS violations FROM {source}" for rule, sql in rules.items())


@query(f"WITH {_RAW_BARS} {_violated(_BAR_RULES, 'a')}")
def candle_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violation_counts(candles.candles(curated.curated(_trades(spark, sf_dir)).where("event_time is not null")), candles.candle_rules())


@query(
    f"""WITH {_CURATED} SELECT event_id, exchange, symbol, epoch_us(event_time) AS event_time, round(price, 6) AS price, round(size, 6) AS size, side,
    CAST(round(CAST(price AS DECIMAL(38,8)) * CAST(size AS DECIMAL(38,8)), 4) AS DOUBLE) AS notional FROM o"""
)
def fct_market_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _numbers(models.fct_market_trade(_once(spark, sf_dir)).withColumn("notional", F.round("notional", 4).cast("double")), "price", "size")
    return facts.withColumn("event_time", F.unix_micros("event_time"))


@query(
    f"""WITH {_CURATED} SELECT exchange, symbol, split_part(symbol, '-', 1) AS base, split_part(symbol, '-', 2) AS quote, strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
    strftime(max(event_time), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM o GROUP BY 1, 2"""
)
def dim_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.dim_instrument(_once(spark, sf_dir)).select("exchange", "symbol", "base", "quote", _text("first_seen"), _text("last_seen"))


@query(f"WITH {_CURATED} SELECT exchange, CAST(count(DISTINCT symbol) AS BIGINT) AS symbols, CAST(count(*) AS BIGINT) AS trades FROM o GROUP BY 1")
def dim_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.dim_exchange(_once(spark, sf_dir))


@query(
    f"""WITH {_CURATED} SELECT exchange, symbol, strftime(event_time, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS trades, CAST(round(sum(CAST(size AS DECIMAL(38,12))), 6) AS DOUBLE) AS volume,
    round(arg_min(price, (event_time, event_id)), 6) AS open, round(arg_max(price, (event_time, event_id)), 6) AS close, round(max(price), 6) AS high, round(min(price), 6) AS low FROM o GROUP BY 1, 2, 3"""
)
def mart_market_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(models.mart_market_daily(_once(spark, sf_dir)), "volume", "open", "close", "high", "low").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    """SELECT strftime(kafka_timestamp, '%Y-%m-%d %H') AS hour, CAST(count(*) AS BIGINT) AS records, CAST(sum(CASE WHEN lag > 60000000 THEN 1 ELSE 0 END) AS BIGINT) AS late,
    max(lag) AS max_lag, CAST(sum(lag) AS BIGINT) AS total_lag FROM (SELECT *, epoch_us(kafka_timestamp) - epoch_us(event_time) AS lag FROM market_trade_raw_event) GROUP BY 1"""
)
def mart_pipeline_health_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.mart_pipeline_health_hourly(_trades(spark, sf_dir))
    return found.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "records", "late", "max_lag", "total_lag")


@query(
    f"""WITH n AS (SELECT *, lower({_strip('exchange')}) AS e, list_filter(list_transform(affected_symbols, lambda s: upper({_strip('s')})), lambda s: s <> '') AS l FROM market_data_quality_event WHERE event_id IS NOT NULL)
    SELECT event_id, connection_id, e AS exchange, arg_min(observation_type, detected_at) AS observation_type, epoch_us(min(detected_at)) AS detected_at,
    array_to_string(arg_min(list_filter(l, lambda s, i: list_position(l, s) = i), detected_at), ',') AS symbols FROM n GROUP BY 1, 2, 3"""
)
def fct_quality_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = models.fct_quality_event(_quality(spark, sf_dir))
    return facts.select("event_id", "connection_id", "exchange", "observation_type", F.unix_micros("detected_at").alias("detected_at"), F.array_join("symbols", ",").alias("symbols"))


@query(
    f"""WITH e AS (SELECT event_id, connection_id, lower({_strip('exchange')}) AS exchange, arg_min(observation_type, detected_at) AS observation_type, min(detected_at) AS detected_at
    FROM market_data_quality_event WHERE event_id IS NOT NULL GROUP BY 1, 2, 3) SELECT exchange, observation_type, strftime(detected_at, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS events FROM e GROUP BY 1, 2, 3"""
)
def mart_quality_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.mart_quality_daily(_quality(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    f"""SELECT exchange, CAST(count(*) AS BIGINT) AS records, quantile_disc(lag, 0.5) AS p50_us, quantile_disc(lag, 0.95) AS p95_us, quantile_disc(lag, 0.99) AS p99_us
    FROM (SELECT lower({_strip('exchange')}) AS exchange, epoch_us(kafka_timestamp) - epoch_us(event_time) AS lag FROM market_trade_raw_event) GROUP BY 1"""
)
def freshness_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.freshness(_trades(spark, sf_dir))


# --- reconciliation ------------------------------------------------------------------------------


@query(f"WITH {_CURATED} SELECT CAST((SELECT count(*) FROM t) AS BIGINT) AS raw, CAST((SELECT count(*) FROM o) AS BIGINT) AS curated, CAST((SELECT count(*) FROM j WHERE reason IS NULL) - (SELECT count(*) FROM o) AS BIGINT) AS duplicates, CAST((SELECT count(*) FROM j WHERE reason IS NOT NULL) AS BIGINT) AS quarantined, true AS holds")
def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _trades(spark, sf_dir)
    good, bad = curated.quarantined(curated.curated(raw))
    return data_tests.reconciled_counts(raw, good, curated.first_of_each(good), bad)


_TRADE_RULES = {
    "event_id_present": "event_id IS NOT NULL", "event_time_present": "event_time IS NOT NULL", "price_present": "price IS NOT NULL", "size_present": "size IS NOT NULL", "price_positive": "coalesce(price > 0, false)",
    "size_positive": "coalesce(size > 0, false)", "side_known": "coalesce(side IN ('BUY', 'SELL'), true)", "not_before_event": "coalesce(ingested_at >= event_time, true)",
}


@query(
    f"""WITH {_RAW_BARS}, y AS (SELECT event_id FROM t WHERE event_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) {_violated(_TRADE_RULES, 't')} UNION ALL {_violated(_BAR_RULES, 'a')}
    UNION ALL SELECT 'event_id_unique', count(*) FROM y UNION ALL SELECT 'candle_unique', 0"""
)
def data_test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests over what could be read, before bad rows and copies are taken out."""
    typed = curated.curated(_trades(spark, sf_dir))
    return data_tests.trade_test_results(typed, candles.candles(typed.where("event_time is not null")))


@query(
    f"""WITH h AS (SELECT DISTINCT lower({_strip('exchange')}) AS exchange, epoch_us(event_time) // 3600000000 AS h FROM market_trade_raw_event WHERE event_time IS NOT NULL),
    g AS (SELECT exchange, h, lead(h) OVER (PARTITION BY exchange ORDER BY h) AS n FROM h)
    SELECT exchange, strftime(make_timestamp(x * 3600000000), '%Y-%m-%d %H') AS hour FROM (SELECT exchange, unnest(range(h + 1, n)) AS x FROM g WHERE n > h + 1)"""
)
def hourly_freshness_gaps_by_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which an exchange sent nothing, over all rows and by normalised exchange."""
    rows = _trades(spark, sf_dir).select(X.exchange_key(F.col("exchange")).alias("exchange"), "event_time")
    return reconcile.hourly_gaps(rows, "event_time", ["exchange"]).select("exchange", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"))


def _stored_bars(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Candles from the valid events among the values of the log or of the archive, each trade once."""
    events = reject_rows.loaded(table(spark, sf_dir, source)).withColumn("kafka_timestamp", F.lit(None).cast("timestamp"))
    good, _ = curated.quarantined(curated.curated(events))
    return _shown(candles.candles(curated.first_of_each(good)))


_BAR = ("open", "high", "low", "close", "volume", "trades")


def _replay_sql() -> str:
    def bars(source: str) -> str:
        order = "(event_time, event_id)"
        return f"""WITH {valid_sql(source)}, g AS (SELECT *, CAST(NULL AS TIMESTAMP) AS kafka_timestamp FROM f), {_curated_sql(_ids_sql('g'))}
        SELECT exchange, symbol, strftime(make_timestamp(epoch_us(event_time) // 60000000 * 60000000), '%Y-%m-%d %H:%M') AS period_start, round(arg_min(price, {order}), 6) AS open, round(max(price), 6) AS high,
        round(min(price), 6) AS low, round(arg_max(price, {order}), 6) AS close, CAST(round(sum(CAST(size AS DECIMAL(38,12))), 6) AS DOUBLE) AS volume, count(*) AS trades FROM o GROUP BY exchange, symbol, epoch_us(event_time) // 60000000"""

    met = "l.exchange = r.exchange AND l.symbol = r.symbol AND l.period_start = r.period_start"
    unequal = " UNION ALL ".join(f"SELECT l.exchange, l.symbol, l.period_start, '{c}' AS difference FROM live l JOIN replay r ON {met} WHERE l.{c} IS DISTINCT FROM r.{c}" for c in _BAR)
    return f"""WITH live AS ({bars('kafka_record_snapshot')}), replay AS ({bars('raw_kafka_record')})
    SELECT exchange, symbol, period_start, 'only_live' AS difference FROM live l WHERE NOT EXISTS (SELECT 1 FROM replay r WHERE {met})
    UNION ALL SELECT exchange, symbol, period_start, 'only_replay' FROM replay r WHERE NOT EXISTS (SELECT 1 FROM live l WHERE {met}) UNION ALL {unequal}"""


@query(_replay_sql())
def replay_equals_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, replay = (_stored_bars(spark, sf_dir, s) for s in ("kafka_record_snapshot", "raw_kafka_record"))
    return reconcile.replay_differences(live, replay, ["exchange", "symbol", "period_start"])


@query(
    f"""WITH h AS (SELECT DISTINCT {_KEYS}, {_strip('source_event_id')} AS source_event_id FROM market_trade_raw_event WHERE kafka_partition <= 2),
    a AS (SELECT DISTINCT {_KEYS}, {_strip('source_event_id')} AS source_event_id FROM market_trade_raw_event t WHERE EXISTS
         (SELECT 1 FROM raw_kafka_record r WHERE r.kafka_partition = t.kafka_partition AND r.kafka_offset = t.kafka_offset))
    SELECT *, 'archive' AS missing_in FROM (SELECT * FROM h EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'history' FROM (SELECT * FROM a EXCEPT SELECT * FROM h)"""
)
def rest_archive_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered trades of the archived partitions against those whose record the archive holds."""
    trades = _trades(spark, sf_dir)
    keyed = trades.select(X.exchange_key(F.col("exchange")).alias("exchange"), X.symbol_key(F.col("symbol")).alias("symbol"), X.strip(F.col("source_event_id")).alias("source_event_id"), "kafka_partition", "kafka_offset")
    archived = keyed.join(_archive(spark, sf_dir).select("kafka_partition", "kafka_offset"), ["kafka_partition", "kafka_offset"], "left_semi")
    return reconcile.history_differences(keyed.where("kafka_partition <= 2"), archived, ["exchange", "symbol", "source_event_id"])


@query(
    f"""WITH i AS (SELECT DISTINCT event_id || '/' || connection_id AS incident_id, lower({_strip('exchange')}) AS exchange, epoch_us(detected_at) AS t FROM market_data_quality_event WHERE observation_type = 'sequence_gap' AND event_id IS NOT NULL AND connection_id IS NOT NULL AND detected_at IS NOT NULL),
    k AS (SELECT lower({_strip('exchange')}) AS exchange, epoch_us(event_time) AS t FROM market_trade_raw_event WHERE event_time IS NOT NULL)
    SELECT i.incident_id, i.exchange, b.t AS last_before, a.t AS first_after FROM i ASOF LEFT JOIN k b ON i.exchange = b.exchange AND i.t >= b.t ASOF LEFT JOIN k a ON i.exchange = a.exchange AND i.t < a.t"""
)
def incident_windows_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last trade of the exchange before each sequence gap and the first one after it."""
    hour = F.floor(F.unix_micros("at") / 3_600_000_000).alias("block")
    gaps = _quality(spark, sf_dir).where("observation_type = 'sequence_gap' and detected_at is not null")
    incident = F.concat("event_id", F.lit("/"), "connection_id").alias("incident_id")
    incidents = gaps.select(incident, X.exchange_key(F.col("exchange")).alias("exchange"), F.col("detected_at").alias("at")).where("incident_id is not null").distinct()
    trades = _trades(spark, sf_dir).where("event_time is not null").select(X.exchange_key(F.col("exchange")).alias("exchange"), F.col("event_time").alias("at"))
    near = reconcile.near_incidents(trades, incidents, ["exchange"])
    found = reconcile.around_incidents(incidents.select("*", hour), near.select("*", hour), ["exchange"], "block")
    return found.select("incident_id", "exchange", F.unix_micros("last_before").alias("last_before"), F.unix_micros("first_after").alias("first_after"))


# --- streaming -----------------------------------------------------------------------------------


SLICES = 3


def _arriving(spark: SparkSession, df: DataFrame, folder: str, order: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows arrive as files in slices by a column; after each slice the stream is started anew from its checkpoint."""
    rank = F.unix_micros(order) if df.schema[order].dataType.typeName() == "timestamp" else F.col(order).cast("long")
    cuts = sorted(set(df.select(rank.alias("r")).approxQuantile("r", [i / SLICES for i in range(1, SLICES)], 0.01)))
    result = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        above = F.lit(True) if low is None else rank >= low
        inside = above if high is None else above & (rank < high)
        df.where(inside if low is not None else inside | rank.isNull()).write.mode("append").parquet(f"{folder}/input")
        result = run(spark.readStream.schema(df.schema).parquet(f"{folder}/input"))
    return result


@query(ORACLE_SQL["archive_projection"])
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)

    def run(stream: DataFrame) -> DataFrame:
        jobs.to_archive(stream, f"{folder}/archive", f"{folder}/checkpoint").awaitTermination()
        return spark.read.schema(schemas.ARCHIVE_ROW).parquet(f"{folder}/archive")

    return _comparable(_arriving(spark, archive.log_records(_log(spark, sf_dir)), folder, "timestamp", run))


@query(f"WITH {_CURATED} SELECT DISTINCT event_id, exchange, symbol FROM j WHERE reason IS NULL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)

    def run(stream: DataFrame) -> DataFrame:
        good, _ = curated.quarantined(curated.curated(stream))
        return jobs.drained(jobs.once_within_watermark(good, "60 days").select("event_id", "exchange", "symbol"), folder)

    return _arriving(spark, _trades(spark, sf_dir), folder, "kafka_timestamp", run)


#: Lateness of the candle stream: what comes later than that behind the greatest event time of an earlier batch is dropped.
_LATENESS_S = 6 * 3600


@query()
def stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of the windows that the watermark has closed; which those are depends on the batches, so there is no SQL."""
    folder = shared_dir(spark)

    def run(stream: DataFrame) -> DataFrame:
        good, _ = curated.quarantined(curated.curated(stream))
        return _shown(jobs.drained(jobs.live_candles(jobs.once_within_watermark(good, f"{_LATENESS_S} seconds"), lateness=None), folder))

    return _arriving(spark, _trades(spark, sf_dir), folder, "kafka_timestamp", run)


@query(
    f"""WITH {_SEQUENCE} SELECT exchange || ':' || symbol AS key, kafka_partition * 281474976710656 + kafka_offset AS arrival, source_sequence AS current, previous, status FROM c"""
)
def stream_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    for name, value in jobs.STATE_STORE.items():
        spark.conf.set(name, value)
    position = F.col("kafka_partition").cast("long") * (1 << 48) + F.col("kafka_offset")
    found = _arriving(spark, _trades(spark, sf_dir).withColumn("position", position), folder, "position", lambda s: jobs.drained(jobs.continuity(jobs.sequence_rows(s)), folder))
    return found.select("key", "arrival", "current", "previous", "status")


# --- feed ----------------------------------------------------------------------------------------


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed messages around the stored deliveries: one connection for each exchange and day, in order of position.

    Symbols against EUR stand for heartbeats. Dirt comes from dirt: a price that is no number makes the
    envelope's number a text, an odd side costs the trade its product, an odd identifier is an odd counter.
    """
    trades = _trades(spark, sf_dir)
    payload = F.from_json("payload", "price string, side string")
    number = F.when(X.number(payload["price"]).isNull(), F.lit('"x"')).otherwise(F.coalesce(F.col("source_sequence").cast("string"), F.lit("null")))
    beat = F.to_json(F.struct(F.col("source_event_id").alias("heartbeat_counter")))
    trade = F.when(F.coalesce(F.upper(payload["side"]).isin("BUY", "SELL"), F.lit(False)), F.col("payload")).otherwise(F.lit('{"trade_id":"1"}'))
    is_beat = X.symbol_key(F.col("symbol")).endswith("-EUR")
    head = F.concat(F.lit('","sequence_num":'), number, F.lit(',"events":['))
    raw = F.when(is_beat, F.concat(F.lit('{"channel":"heartbeats'), head, beat, F.lit("]}"))).otherwise(F.concat(F.lit('{"channel":"market_trades'), head, F.lit('{"type":"update","trades":['), trade, F.lit("]}]}")))
    return trades.select(
        F.concat_ws(":", X.exchange_key(F.col("exchange")), F.date_format("kafka_timestamp", "yyyy-MM-dd")).alias("connection_id"),
        (F.col("kafka_partition").cast("long") * (1 << 48) + F.col("kafka_offset")).alias("arrival_no"),
        F.col("kafka_timestamp").alias("received_at"),
        raw.alias("raw"),
    )


def _feed_sql() -> str:
    price = "trim(json_extract_string(payload, '$.price'))"
    obs = "connection_id, arrival_no, t, NOT (beat AND counter IS NULL) AS counted"
    window = "PARTITION BY connection_id, stream ORDER BY arrival_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""f AS (SELECT lower({_strip('exchange')}) || ':' || strftime(kafka_timestamp, '%Y-%m-%d') AS connection_id, kafka_partition * 281474976710656 + kafka_offset AS arrival_no, epoch_us(kafka_timestamp) AS t,
        ends_with(upper({_strip('symbol')}), '-EUR') AS beat, coalesce(regexp_matches({price}, {_NUMBER}), false) AS numbered, source_sequence AS sequence, source_event_id,
        TRY_CAST({_strip('source_event_id')} AS BIGINT) AS counter, coalesce(upper(json_extract_string(payload, '$.side')) IN ('BUY', 'SELL'), false) AS sided FROM market_trade_raw_event),
    m AS (SELECT *, CASE WHEN NOT numbered THEN 'invalid_sequence_num' WHEN beat AND source_event_id IS NULL THEN 'missing_heartbeat_counter' WHEN beat AND counter IS NULL THEN 'invalid_heartbeat_counter'
        WHEN NOT beat AND NOT sided THEN 'missing_product_id' END AS reason FROM f),
    n AS (SELECT {obs}, 'envelope' AS stream, sequence AS current FROM m WHERE numbered AND sequence IS NOT NULL
        UNION ALL SELECT {obs}, 'heartbeat', counter FROM m WHERE numbered AND beat AND counter IS NOT NULL),
    p AS (SELECT *, max(current) OVER ({window}) AS previous FROM n),
    q AS (SELECT *, CASE WHEN previous IS NULL THEN 'initialized' WHEN current = previous + 1 THEN 'ok' WHEN current = previous THEN 'duplicate' WHEN current < previous THEN 'out_of_order' ELSE 'gap' END AS status FROM p)"""


_JUDGED = f"""{_feed_sql()}, g AS (SELECT connection_id, arrival_no, sum(CASE WHEN stream = 'heartbeat' THEN 1 ELSE 0 END) AS heartbeats, sum(CASE WHEN status = 'gap' THEN 1 ELSE 0 END) AS gaps,
    sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS duplicates, sum(CASE WHEN status = 'out_of_order' THEN 1 ELSE 0 END) AS out_of_order,
    max(CASE WHEN stream = 'envelope' THEN current END) AS envelope, max(CASE WHEN stream = 'heartbeat' THEN current END) AS heartbeat FROM q WHERE counted GROUP BY 1, 2),
    a AS (SELECT m.connection_id, m.arrival_no, CASE WHEN NOT beat AND reason IS NULL THEN 1 ELSE 0 END AS own_trades, CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END AS own_malformed, g.* EXCLUDE (connection_id, arrival_no)
      FROM m LEFT JOIN g ON m.connection_id = g.connection_id AND m.arrival_no = g.arrival_no),
    h AS (SELECT connection_id, arrival_no, own_trades, own_malformed, CAST(count(*) OVER w AS BIGINT) AS envelopes, {', '.join(f"CAST(sum(coalesce({x}, 0)) OVER w AS BIGINT) AS {y}" for x, y in [('own_trades', 'trades'), *[(k, k) for k in ('heartbeats', 'gaps', 'duplicates', 'out_of_order')], ('own_malformed', 'malformed')])},
      last_value(envelope IGNORE NULLS) OVER w AS last_envelope, last_value(heartbeat IGNORE NULLS) OVER w AS last_heartbeat FROM a WINDOW w AS (PARTITION BY connection_id ORDER BY arrival_no ROWS UNBOUNDED PRECEDING))"""
_COUNTS = "envelopes, trades, heartbeats, gaps, duplicates, out_of_order, malformed, last_envelope, last_heartbeat"


def _read_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages are read once; what follows starts from the stored result."""
    return written(feed.read_messages(_feed(spark, sf_dir)), f"{shared_dir(spark)}/read")


@query(f"""WITH {_feed_sql()} SELECT connection_id, stream, arrival_no, current, previous, status, counted, CASE WHEN status = 'gap' THEN previous + 1 END AS missing_from, CASE WHEN status = 'gap' THEN current - 1 END AS missing_to FROM q""")
def feed_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = feed.feed_continuity(_read_feed(spark, sf_dir))
    return judged.select("connection_id", "stream", "arrival_no", "current", "previous", "status", "counted", "missing_from", "missing_to")


@query(f"WITH {_JUDGED} SELECT connection_id, arrival_no, {_COUNTS} FROM h")
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _read_feed(spark, sf_dir)
    return feed.feed_health(read, feed.feed_continuity(read)).drop("received_at", "own_trades", "own_malformed")


@query(
    f"""WITH {_JUDGED} SELECT q.connection_id, q.arrival_no, CASE status WHEN 'duplicate' THEN 'duplicate_sequence' WHEN 'out_of_order' THEN 'out_of_order_sequence' ELSE CASE stream WHEN 'heartbeat' THEN 'heartbeat_gap' ELSE 'sequence_gap' END END AS observation_type,
    stream, previous AS previous_sequence, current AS current_sequence, envelopes, trades - own_trades AS trades, heartbeats, gaps, duplicates, out_of_order, malformed - own_malformed AS malformed, last_envelope, last_heartbeat
    FROM q JOIN h ON q.connection_id = h.connection_id AND q.arrival_no = h.arrival_no WHERE counted AND status IN ('gap', 'duplicate', 'out_of_order')"""
)
def feed_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _read_feed(spark, sf_dir)
    judged = feed.feed_continuity(read)
    return feed.feed_anomalies(judged, feed.feed_health(read, judged)).drop("event_id", "received_at", "channel", "place", "missing_from", "missing_to")


@query(f"WITH {_feed_sql()} SELECT connection_id, arrival_no, reason FROM m WHERE reason IS NOT NULL")
def feed_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.feed_malformed(feed.read_messages(_feed(spark, sf_dir))).select("connection_id", "arrival_no", "reason")


@query(
    f"""WITH {_feed_sql()}, b AS (SELECT connection_id, max(t) AS last_heartbeat FROM q WHERE counted AND stream = 'heartbeat' GROUP BY 1),
    c AS (SELECT split_part(m.connection_id, ':', 1) AS source, m.connection_id, min(m.t) AS opened, max(m.t) AS last_sign, any_value(b.last_heartbeat) AS last_heartbeat FROM m LEFT JOIN b ON m.connection_id = b.connection_id GROUP BY 1, 2),
    d AS (SELECT *, lead(opened) OVER w AS following, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY source ORDER BY opened, connection_id))
    SELECT source, connection_id, opened AS at_us, 'connection_opened' AS observation_type, CAST(NULL AS VARCHAR) AS reason FROM d UNION ALL SELECT source, connection_id, opened, 'connection_recovered', NULL FROM d WHERE place > 1
    UNION ALL SELECT source, connection_id, last_sign, 'connection_closed', CASE WHEN last_sign - coalesce(last_heartbeat, opened) >= 10000000 THEN 'heartbeat_silence' ELSE 'stream_ended' END FROM d WHERE following IS NOT NULL
    UNION ALL SELECT source, connection_id, last_sign, 'reconnect_scheduled', NULL FROM d WHERE following IS NOT NULL UNION ALL SELECT source, connection_id, following, 'reconnect_attempt', NULL FROM d WHERE following IS NOT NULL"""
)
def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = feed.read_messages(_feed(spark, sf_dir))
    beat = F.when(F.col("counted") & (F.size("counters") > 0), F.col("received_at"))
    source = F.split_part("connection_id", F.lit(":"), F.lit(1)).alias("source")
    connections = read.groupBy(source, "connection_id").agg(F.min("received_at").alias("opened_at"), F.max("received_at").alias("last_sign"), F.max(beat).alias("last_heartbeat"))
    return feed.lifecycle_events(connections).select("source", "connection_id", F.unix_micros("at").alias("at_us"), "observation_type", "reason")


_FEED_KINDS = f"""{_JUDGED}, b AS (SELECT connection_id, max(t) AS last_heartbeat FROM q WHERE counted AND stream = 'heartbeat' GROUP BY 1),
    y AS (SELECT split_part(connection_id, ':', 1) AS source, connection_id, min(t) AS opened, max(t) AS last_sign FROM m GROUP BY 1, 2),
    d AS (SELECT *, lead(opened) OVER w AS following, row_number() OVER w AS place FROM y WINDOW w AS (PARTITION BY source ORDER BY opened, connection_id)),
    g2 AS (SELECT connection_id, t FROM q WHERE counted AND stream = 'heartbeat' UNION ALL SELECT connection_id, opened FROM y),
    r2 AS (SELECT connection_id, t - lag(t) OVER (PARTITION BY connection_id ORDER BY t) AS quiet FROM g2),
    k AS (SELECT connection_id, CASE status WHEN 'duplicate' THEN 'duplicate_sequence' WHEN 'out_of_order' THEN 'out_of_order_sequence' ELSE CASE stream WHEN 'heartbeat' THEN 'heartbeat_gap' ELSE 'sequence_gap' END END AS observation_type
      FROM q WHERE counted AND status IN ('gap', 'duplicate', 'out_of_order') UNION ALL SELECT connection_id, 'malformed_message' FROM m WHERE reason IS NOT NULL UNION ALL SELECT connection_id, 'heartbeat_silence' FROM r2 WHERE quiet >= 10000000
      UNION ALL SELECT connection_id, 'health_summary' FROM (SELECT DISTINCT connection_id, t // 60000000 FROM m) UNION ALL SELECT connection_id, 'connection_opened' FROM d UNION ALL SELECT connection_id, 'connection_recovered' FROM d WHERE place > 1
      UNION ALL SELECT connection_id, unnest(['connection_closed', 'reconnect_scheduled', 'reconnect_attempt']) FROM d WHERE following IS NOT NULL)"""


@query(f"WITH {_FEED_KINDS} SELECT split_part(connection_id, ':', 1) AS exchange, connection_id, observation_type, count(*) AS events, count(*) AS identifiers FROM k GROUP BY 1, 2, 3")
def feed_quality_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream of quality events, by kind; their identifiers are distinct."""
    read = _read_feed(spark, sf_dir)
    judged = feed.feed_continuity(read)
    beat = F.when(F.col("counted") & (F.size("counters") > 0), F.col("received_at"))
    source = F.split_part("connection_id", F.lit(":"), F.lit(1)).alias("source")
    connections = read.groupBy(source, "connection_id").agg(F.min("received_at").alias("opened_at"), F.max("received_at").alias("last_sign"), F.max(beat).alias("last_heartbeat"), F.array(F.lit("ALL")).alias("symbols"))
    events = feed.quality_events(read, judged, feed.feed_health(read, judged), connections)
    return events.groupBy("exchange", "connection_id", "observation_type").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("identifiers"))


# --- backfill ------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT DISTINCT kafka_partition, strftime(kafka_timestamp, '%Y-%m-%d %H') AS hour FROM market_trade_raw_event), d AS (SELECT DISTINCT kafka_partition, strftime(kafka_timestamp, '%Y-%m-%d %H') AS hour FROM raw_kafka_record)
    SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.kafka_partition = w.kafka_partition AND d.hour = w.hour)"""
)
def backfill_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a partition that were delivered and of which the archive has nothing."""
    hour = F.date_format("kafka_timestamp", "yyyy-MM-dd HH").alias("hour")
    wanted, held = (df.select("kafka_partition", hour).distinct() for df in (_trades(spark, sf_dir), _archive(spark, sf_dir)))
    return reconcile.backfill_due(wanted, held.withColumn("status", F.lit("done")), ["kafka_partition", "hour"])


@query(
    f"""WITH e AS (SELECT lower({_strip('exchange')}) AS exchange, epoch_us(min(event_time)) AS a, epoch_us(max(event_time)) AS b FROM market_trade_raw_event WHERE event_time IS NOT NULL GROUP BY 1),
    w AS (SELECT exchange, b, unnest(range(a, b + 1, 21600000000)) AS window_from FROM e) SELECT exchange, window_from, least(window_from + 21600000000, b + 1) AS window_to FROM w"""
)
def history_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of six hours in which an exchange's history has to be asked for."""
    rows = _trades(spark, sf_dir).where("event_time is not null").groupBy(X.exchange_key(F.col("exchange")).alias("exchange")).agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    windows = reconcile.request_windows(rows, "a", "b", 6 * 3600)
    return windows.select("exchange", F.unix_micros("window_from").alias("window_from"), F.unix_micros("window_to").alias("window_to"))


@query("SELECT count(*) AS rows, true AS same FROM raw_kafka_record")
def replay_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived records sent through the log's form and back have the checksum they had."""
    rows = _archive(spark, sf_dir).select(*archive.RENAMES)
    back = archive.archive_rows(archive.log_records(rows)).select(*archive.RENAMES)
    sums = ["s0", "s1", "s2"]
    one, other = reconcile.checksum(rows), reconcile.checksum(back).toDF("rows_back", *[f"{s}_back" for s in sums])
    met = F.lit(True)
    for name in sums:
        met = met & (F.col(name) == F.col(f"{name}_back"))
    return one.join(other, F.col("rows") == F.col("rows_back"), "left").select("rows", F.coalesce(met, F.lit(False)).alias("same"))
