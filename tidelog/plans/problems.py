"""Queries of the general problems p1 to p7, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import compaction, copy_diff, exactly_once, hot_keys, late_events, reject_rows, spikes
from tidelog.session import shared_dir, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactly_once.further_copies(table(spark, sf_dir, "market_trade_raw_event"), shared_dir(spark))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_events.late_rows(table(spark, sf_dir, "market_trade_raw_event"))


def p2_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = late_events.period_aggregates(table(spark, sf_dir, "market_trade_raw_event"))
    # sums of doubles depend on their order, so they come rounded
    return found.select("exchange", "symbol", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "trades", "corrected", F.round("volume", 6).alias("volume"), "open", "high", "low", "close")


def p2_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = late_events.span_totals(table(spark, sf_dir, "market_trade_raw_event"))
    return found.select(F.date_format("begin", "yyyy-MM-dd HH").alias("hour"), "trades", "corrected", F.round("volume", 6).alias("volume"), "high", "low")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, archive = (table(spark, sf_dir, n) for n in ("kafka_record_snapshot", "raw_kafka_record"))
    return copy_diff.differences(log, archive, shared_dir(spark))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_rows.rejected(table(spark, sf_dir, "raw_kafka_record"))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reject_rows.loaded(table(spark, sf_dir, "raw_kafka_record"))
    return rows.withColumns({n: F.unix_micros(n) for n in ("event_time", "ingested_at")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys.heavy_keys(table(spark, sf_dir, "market_trade_raw_event"))


def p5_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hot_keys.trade_key_results(table(spark, sf_dir, "market_trade_raw_event"))
    return found.select("exchange", "symbol", "trades", F.round("volume", 4).cast("double").alias("volume"), "last_price")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spikes.implausible(table(spark, sf_dir, "market_trade_raw_event"), shared_dir(spark))
    return found.select("kafka_partition", "kafka_offset")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compaction.fragmented_hours(table(spark, sf_dir, "archive_file"))
    return found.select(F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "event_hour")


def p7_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrite itself, and what became of each hour."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("raw_kafka_record", "archive_file")]
    found = compaction.compact(spark, *paths, shared_dir(spark))
    few = (F.col("files_after") <= F.greatest("needed", F.lit(1))).alias("few_enough")
    return found.select(F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "event_hour", "rows", "files_before", "needed", few)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_minutes, p2_hours, p3_found, p4_found, p4_loaded, p5_found, p5_results, p6_found, p7_found, p7_compacted)}

#: Fixed value: Unicode white space as RE2 and DuckDB understand it.
_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(name: str) -> str:
    return f"regexp_replace(regexp_replace({name}, '^{_WS}', ''), '{_WS}$', '')"


_KEYS = f"lower({_strip('exchange')}) AS exchange, upper({_strip('symbol')}) AS symbol"
_NUMBER = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _reading(name: str) -> str:
    text = f"json_extract_string(payload, '$.{name}')"
    return f"CASE WHEN regexp_matches({text}, {_NUMBER}) THEN CAST({text} AS DOUBLE) END AS {name}"


_DIFFERENT = " UNION ALL ".join(
    f"SELECT DISTINCT l.kafka_topic, l.kafka_partition, l.kafka_offset, '{f}' AS difference FROM kafka_record_snapshot l JOIN raw_kafka_record a "
    f"ON l.kafka_topic = a.kafka_topic AND l.kafka_partition = a.kafka_partition AND l.kafka_offset = a.kafka_offset WHERE l.{f} IS DISTINCT FROM a.{f}"
    for f in copy_diff.FIELDS
)
_POSITION = "kafka_topic, kafka_partition, kafka_offset"


def _only(one: str, other: str, name: str) -> str:
    met = " AND ".join(f"x.{k} = y.{k}" for k in copy_diff.KEYS)
    return f"SELECT DISTINCT {_POSITION}, '{name}' AS difference FROM {one} x WHERE NOT EXISTS (SELECT 1 FROM {other} y WHERE {met})"




def _field_sql(name: str) -> str:
    """Whether a field keeps its rule, of the JSON text ``v``."""
    kind, text = f"json_type(v, '$.{name}')", f"json_extract_string(v, '$.{name}')"
    uuid = f"regexp_full_match(lower({text}), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-{'5' if name == 'event_id' else '[0-9a-f]'}[0-9a-f]{{3}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}')"
    shape = reject_rows.FIELDS[name]
    if name == "source_sequence":
        rule = f"{kind} = 'NULL' OR ({kind} IN ('UBIGINT', 'BIGINT') AND TRY_CAST({text} AS BIGINT) >= 0)"
    elif name == "payload":
        rule = f"{kind} = 'OBJECT'"
    elif name in ("correlation_id", "causation_id"):
        rule = f"{kind} = 'NULL' OR ({kind} = 'VARCHAR' AND {uuid})"
    elif shape == "UUID":
        rule = f"{kind} = 'VARCHAR' AND {uuid}"
    elif shape == "TIMESTAMPTZ":
        zoned = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)"
        rule = f"{kind} = 'VARCHAR' AND regexp_full_match({text}, '{zoned}') AND TRY_CAST(replace(upper({text}), ',', '.') AS TIMESTAMPTZ) IS NOT NULL"
    elif name in reject_rows.CONSTANTS:
        rule = f"{kind} = 'VARCHAR' AND {text} = '{reject_rows.CONSTANTS[name]}'"
    else:
        rule = f"{kind} = 'VARCHAR' AND {_strip(text)} <> ''"
    return f"coalesce({rule}, false)"


def parsed_sql(source: str) -> str:
    """Common tables u and w: the rows with their text ``v`` and why it cannot be read. The engine's JSON lets a comma before a closing bracket pass."""
    strict = "json_valid(v) AND NOT regexp_matches(v, ',[ \\t\\r\\n]*[}\\]]')"
    return f"""u AS (SELECT *, TRY(decode(kafka_value)) AS v FROM {source}),
    w AS (SELECT *, CASE WHEN kafka_value IS NULL THEN 'null_value' WHEN v IS NULL THEN 'invalid_utf8' WHEN NOT ({strict}) THEN 'invalid_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_object' END AS unread FROM u)"""


_REASON = "CASE WHEN unread IS NOT NULL THEN unread " + " ".join(f"WHEN NOT {_field_sql(n)} THEN 'missing_or_invalid_{n}'" for n in reject_rows.FIELDS) + f" WHEN len(list_distinct(json_keys(v))) > {len(reject_rows.FIELDS)} THEN 'unexpected_field' END AS invalid_reason"


def valid_sql(source: str) -> str:
    """Common table f: the valid events of a table of log records, typed, with their position."""
    typed = {"event_time": "TIMESTAMPTZ", "ingested_at": "TIMESTAMPTZ", "source_sequence": "BIGINT"}
    fields = ", ".join(f"CAST(json_extract_string(v, '$.{n}') AS {typed.get(n, 'VARCHAR')}) AS {n}" for n in reject_rows.FIELDS)
    return f"{parsed_sql(source)}, z AS (SELECT *, {_REASON} FROM w), f AS (SELECT kafka_topic, kafka_partition, kafka_offset, {fields} FROM z WHERE invalid_reason IS NULL)"


ORACLE_SQL = {
    "p4_found": f"WITH {parsed_sql('raw_kafka_record')}, z AS (SELECT *, {_REASON} FROM w) SELECT DISTINCT kafka_topic, kafka_partition, kafka_offset, invalid_reason FROM z WHERE invalid_reason IS NOT NULL",
    "p4_loaded": f"""WITH {valid_sql('raw_kafka_record')} SELECT kafka_topic, kafka_partition, kafka_offset, lower(event_id) AS event_id, event_type, schema_version, exchange, symbol, epoch_us(event_time) AS event_time,
        epoch_us(ingested_at) AS ingested_at, source_event_id, source_sequence, producer, lower(trace_id) AS trace_id, lower(correlation_id) AS correlation_id, lower(causation_id) AS causation_id, payload FROM f""",
    "p1_found": f"""
        WITH k AS (SELECT lower({_strip('exchange')}) e, upper({_strip('symbol')}) s, {_strip('source_event_id')} i, ingested_at, kafka_partition, kafka_offset
                   FROM market_trade_raw_event),
        r AS (SELECT *, row_number() OVER (PARTITION BY e, s, i ORDER BY ingested_at, kafka_partition, kafka_offset) n FROM k)
        SELECT kafka_partition, kafka_offset FROM r WHERE n > 1""",
    "p2_found": """
        WITH r AS (SELECT kafka_partition, kafka_offset, greatest(epoch_us(ingested_at), epoch_us(kafka_timestamp)) - (epoch_us(event_time) // 60000000 + 1) * 60000000 AS late
                   FROM market_trade_raw_event)
        SELECT kafka_partition, kafka_offset, CASE WHEN late <= 900000000 THEN 'corrected' ELSE 'refused' END AS outcome FROM r WHERE late > 60000000""",
    "p2_minutes": f"""
        WITH r AS (SELECT {_KEYS}, epoch_us(event_time) AS t, epoch_us(event_time) // 60000000 AS m, {_reading('price')}, {_reading('size')},
                          greatest(epoch_us(ingested_at), epoch_us(kafka_timestamp)) AS a, kafka_partition * 281474976710656 + kafka_offset AS o FROM market_trade_raw_event),
        k AS (SELECT *, a - (m + 1) * 60000000 AS late, price IS NOT NULL AND isfinite(price) AS ok FROM r)
        SELECT exchange, symbol, strftime(make_timestamp(m * 60000000), '%Y-%m-%d %H:%M') AS minute, CAST(count(*) AS BIGINT) AS trades,
               CAST(sum(CASE WHEN late > 60000000 THEN 1 ELSE 0 END) AS BIGINT) AS corrected, round(coalesce(sum(CASE WHEN isfinite(size) THEN size END), 0), 6) AS volume,
               arg_min(price, (t, o)) FILTER (WHERE ok) AS open, max(price) FILTER (WHERE ok) AS high, min(price) FILTER (WHERE ok) AS low, arg_max(price, (t, o)) FILTER (WHERE ok) AS close
        FROM k WHERE late <= 900000000 GROUP BY exchange, symbol, m""",
    "p2_hours": f"""
        WITH r AS (SELECT epoch_us(event_time) // 60000000 AS m, {_reading('price')}, {_reading('size')}, greatest(epoch_us(ingested_at), epoch_us(kafka_timestamp)) AS a FROM market_trade_raw_event),
        k AS (SELECT *, a - (m + 1) * 60000000 AS late, price IS NOT NULL AND isfinite(price) AS ok FROM r)
        SELECT strftime(make_timestamp(m // 60 * 3600000000), '%Y-%m-%d %H') AS hour, CAST(count(*) AS BIGINT) AS trades, CAST(sum(CASE WHEN late > 60000000 THEN 1 ELSE 0 END) AS BIGINT) AS corrected,
               round(coalesce(sum(CASE WHEN isfinite(size) THEN size END), 0), 6) AS volume, max(price) FILTER (WHERE ok) AS high, min(price) FILTER (WHERE ok) AS low
        FROM k WHERE late <= 900000000 GROUP BY m // 60""",
    "p3_found": f"{_DIFFERENT} UNION ALL {_only('kafka_record_snapshot', 'raw_kafka_record', 'missing_in_archive')} UNION ALL {_only('raw_kafka_record', 'kafka_record_snapshot', 'missing_in_log')}",
    "p5_found": f"""
        SELECT exchange, symbol FROM (SELECT {_KEYS} FROM market_trade_raw_event) GROUP BY exchange, symbol
        HAVING count(*) > 0.03 * (SELECT count(*) FROM market_trade_raw_event)""",
    "p5_results": f"""
        WITH r AS (SELECT {_KEYS}, event_time, kafka_partition, kafka_offset, {_reading('price')}, {_reading('size')} FROM market_trade_raw_event)
        SELECT exchange, symbol, CAST(count(*) AS BIGINT) AS trades, CAST(round(sum(CAST(size AS DECIMAL(38,12))), 4) AS DOUBLE) AS volume,
               arg_max(price, (event_time, kafka_partition, kafka_offset)) FILTER (WHERE price IS NOT NULL) AS last_price
        FROM r GROUP BY exchange, symbol""",
    "p7_compacted": """
        WITH r AS (SELECT file_path, coalesce(strftime(event_date, '%Y-%m-%d'), regexp_extract(file_path, 'event_date=([0-9-]{10})', 1)) AS event_date,
                          coalesce(event_hour, regexp_extract(file_path, 'event_hour=([0-9]{2})', 1)) AS event_hour, n_records, size_bytes, file_action,
                          row_number() OVER (PARTITION BY file_path ORDER BY modified_at DESC) AS n FROM archive_file),
        h AS (SELECT event_date, event_hour, count(*) AS files_before, CAST(ceil(sum(size_bytes) / 131072.0) AS BIGINT) AS needed FROM r
              WHERE n = 1 AND file_action = 'add' AND n_records > 0 GROUP BY event_date, event_hour HAVING count(*) > ceil(sum(size_bytes) / 131072.0)),
        a AS (SELECT strftime(event_date, '%Y-%m-%d') AS event_date, event_hour, CAST(count(*) AS BIGINT) AS rows FROM raw_kafka_record GROUP BY 1, 2)
        SELECT h.event_date, h.event_hour, a.rows, h.files_before, h.needed, true AS few_enough FROM h JOIN a ON h.event_date = a.event_date AND h.event_hour = a.event_hour""",
    "p7_found": """
        WITH r AS (SELECT file_path, coalesce(strftime(event_date, '%Y-%m-%d'), regexp_extract(file_path, 'event_date=([0-9-]{10})', 1)) AS event_date,
                          coalesce(event_hour, regexp_extract(file_path, 'event_hour=([0-9]{2})', 1)) AS event_hour, n_records, size_bytes, file_action,
                          row_number() OVER (PARTITION BY file_path ORDER BY modified_at DESC) AS n FROM archive_file)
        SELECT event_date, event_hour FROM r WHERE n = 1 AND file_action = 'add' AND n_records > 0 GROUP BY event_date, event_hour
        HAVING count(*) > ceil(sum(size_bytes) / 131072.0)""",
}
