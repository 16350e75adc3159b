import json
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.data import at, record, records, rows, trade, trades
from tidelog import config, schemas
from tidelog.operators import archive, candles, continuity, contracts, curated, data_tests, models, reconcile
from tidelog.plans.archive import QUERIES


def test_projection_and_back(spark):
    df = records(spark, [record(1, b"\x00\xff", headers=[("h", None)], seconds=7 * 3600), record(2, None, key=None)])
    rows_ = {r.kafka_offset: r for r in archive.archive_rows(archive.log_records(df)).collect()}
    assert rows_[1].event_hour == "07" and rows_[1].event_date == date(2020, 1, 6) and rows_[1].kafka_value == b"\x00\xff" and rows_[2].kafka_key is None
    assert archive.archive_rows(archive.log_records(df)).schema.simpleString() == spark.createDataFrame([], schemas.ARCHIVE_ROW).schema.simpleString()


def test_envelope_and_encoding(spark):
    df = trades(spark, [trade(1, 1.5, exchange=" Northmere ", symbol="btc-usd", sid=" 7", sequence=3)])
    event = archive.trade_events(df).first()
    assert event.event_id == str(uuid.uuid5(uuid.NAMESPACE_URL, '["market.trade.raw","v1","northmere","BTC-USD","7"]'))
    assert (event.symbol, event.correlation_id) == ("btc-usd", None)
    sent = archive.encoded(archive.trade_events(df)).first()
    body = json.loads(sent.value)
    assert sent.key == b"northmere:BTC-USD" and body["correlation_id"] is None and body["event_time"] == "2020-01-06T00:00:01.500000Z"
    assert list(body) == [p.split()[0] for p in schemas.TRADE_EVENT.split(", ")] and body["payload"]["price"] == "10"
    assert [h.key for h in sent.headers] == ["event_type", "schema_version", "trace_id"]


def test_symbols(spark):
    df = spark.createDataFrame([([" btc ", "BTC", "", "eth"],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(archive.normalised_symbols(F.col("s"))).collect()] == [["BTC", "ETH"], None]


def sequence(spark, *numbers):
    df = spark.createDataFrame([("k", n // 3, n, v) for n, v in enumerate(numbers)], "k string, b long, o long, v long")
    judged = continuity.classified(df, ["k"], ["b"], ["o"], "v")
    return judged, [(r.status, r.missing_from, r.missing_to) for r in sorted(judged.collect(), key=lambda r: r.o)]


def test_sequence_statuses(spark):
    assert sequence(spark, 100)[1] == [("initialized", None, None)]
    assert [s for s, _, _ in sequence(spark, 100, 104, 105)[1]] == ["initialized", "gap", "ok"]
    assert sequence(spark, 100, 104)[1][1] == ("gap", 101, 103)
    judged, found = sequence(spark, 100, 100, 101, 99, 102, 110)
    assert [s for s, _, _ in found] == ["initialized", "duplicate", "ok", "out_of_order", "ok", "gap"]
    last = sorted(continuity.health(judged, ["k"], ["b"], ["o"], "v").collect(), key=lambda r: r.o)[-1]
    assert (last.observed, last.gap_count, last.duplicate_count, last.out_of_order_count, last.last_observed) == (6, 1, 1, 1, 110)
    assert rows(continuity.gap_ranges(judged, ["k"])) == [("k", 103, 109)]


def test_silences_and_summaries(spark):
    df = spark.createDataFrame([("k", n, at(s)) for n, s in enumerate([0, 5, 16, 15, 26, 70])], "k string, o long, t timestamp").withColumn("b", F.col("o") % 1)
    found = continuity.silences(df, ["k"], ["b"], ["o"], "t", 10)
    assert [r.seconds for r in found.orderBy("silent_to").collect()] == [11.0, 10.0, 44.0]
    assert [r.observed for r in continuity.summaries(df, ["k"], "t").orderBy("tick_s").collect()] == [5, 1]


def test_envelopes(spark):
    raw = [
        '{"channel":"market_trades","sequence_num":5,"events":[{"trades":[{"trade_id":"1","product_id":"A"},{"trade_id":"2","product_id":"B"}]},{"type":"x"}]}',
        '{"channel":"subscriptions","sequence_num":6,"events":[{"trades":[{"trade_id":"3"}]}]}', '{"channel":"market_trades"}', "broken",
        '{"channel":"heartbeats","events":[{"heartbeat_counter":" +7"},{"heartbeat_counter":"x"},{}]}',
    ]
    parsed = continuity.envelopes(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "n int, raw string"))
    assert [(r.n, r.sequence_num, r["at"], r.trade_id) for r in continuity.trades_of(parsed, "n").orderBy("at").collect()] == [(0, "5", 0, "1"), (0, "5", 1, "2")]
    assert [r.heartbeat_counter for r in continuity.heartbeats_of(parsed, "n").orderBy("at").collect()] == [7, None, None]


def test_contracts(spark):
    good = trade(1, event_id="3df00381-f849-5ff6-bef0-69aef86cb35a")
    bad = trade(2, None, exchange=" ", payload="[]", sequence=-1)
    broken = contracts.violations(trades(spark, [good, bad]), schemas.trade_rules())
    assert {(r.kafka_offset, r.rule) for r in broken.collect()} == {
        (2, n) for n in ("event_id_uuid5", "exchange_filled", "event_time_present", "ingested_at_present", "payload_object", "source_sequence_minimum")
    }
    kept, rest = contracts.split(trades(spark, [good, bad]), schemas.trade_rules())
    assert kept.count() == 1 and rest.first().reason == "event_id_uuid5"
    assert {r.violations for r in contracts.violation_counts(trades(spark, []), schemas.trade_rules()).collect()} == {0}


def test_curated_candles_and_reconciliation(spark):
    raw = trades(spark, [trade(1, 1, sid="1", price="5"), trade(2, 0, 3, sid="1", price="5"), trade(3, 30, sid="2", price="9", size="2.5"), trade(4, 59, sid="3", price="7"), trade(5, 61, sid="4", price="-1"), trade(6, 62, sid="5", size="x")])
    good, bad = curated.quarantined(curated.curated(raw))
    once = curated.first_of_each(good)
    assert {(r.kafka_offset, r.reason) for r in bad.collect()} == {(5, "price_positive"), (6, "size_present")}
    bar = candles.candles(once).collect()
    assert len(bar) == 1 and tuple(map(float, (bar[0].open, bar[0].high, bar[0].low, bar[0].close, bar[0].volume))) == (5, 9, 5, 7, 4.5) and bar[0].trades == 3
    hour = candles.rolled_up(candles.candles(once)).first()
    assert float(hour.volume) == 4.5 and hour.trades == 3
    counts = data_tests.reconciled_counts(raw, good, once, bad).first()
    assert tuple(counts) == (6, 3, 1, 2, True)
    assert {r.violations for r in data_tests.trade_test_results(once, candles.candles(once)).collect()} == {0}
    assert tuple(models.dim_instrument(once).first())[:4] == ("x", "A-B", "A", "B")


def test_replay_and_history(spark):
    live = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (5, None, None)], "k int, v string, w int")
    replay = spark.createDataFrame([(1, "a", None), (2, "x", None), (4, "d", 1), (5, None, None)], "k int, v string, w int")
    assert rows(reconcile.replay_differences(live, replay, ["k"])) == [(2, "v"), (2, "w"), (3, "only_live"), (4, "only_replay")]
    assert tuple(reconcile.checksum(live).first()) == tuple(reconcile.checksum(live.orderBy(F.desc("k"))).first()) != tuple(reconcile.checksum(replay).first())
    lists = [spark.createDataFrame([(v,)], "v array<string>") for v in (None, [], [None], [""], ["a"])]
    assert len({tuple(reconcile.checksum(df).first()) for df in lists}) == 5
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string")
    assert tuple(reconcile.checksum(twice).first()) != tuple(reconcile.checksum(spark.createDataFrame([(2, "b"), (2, "b")], "k int, v string")).first())
    assert rows(reconcile.history_differences(live.select("k"), replay.select("k"), ["k"])) == [(3, "archive"), (4, "history")]
    assert rows(reconcile.backfill_due(live.select("k"), spark.createDataFrame([(1, "done"), (2, "failed")], "k int, status string"), ["k"])) == [(2,), (3,), (5,)]


def test_windows_and_gaps(spark):
    one = spark.createDataFrame([(at(0), at(25))], "a timestamp, b timestamp")
    windows = [((r.window_from - at(0).replace(tzinfo=None)).total_seconds(), (r.window_to - at(0).replace(tzinfo=None)).total_seconds()) for r in reconcile.request_windows(one, "a", "b", 10).collect()]
    assert windows == [(0, 10), (10, 20), (20, 25.000001)]
    hours = spark.createDataFrame([(at(0),), (at(3 * 3600 + 5),), (None,)], "t timestamp")
    assert [r.hour.hour for r in reconcile.hourly_gaps(hours, "t").collect()] == [1, 2]


def test_gaps_of_each_key(spark):
    seen = [("a", at(0)), ("a", at(3 * 3600)), ("b", at(3600)), ("b", at(3 * 3600 + 5)), (None, at(0)), (None, at(2 * 3600)), ("c", None)]
    found = reconcile.hourly_gaps(spark.createDataFrame(seen, "k string, t timestamp"), "t", ["k"]).collect()
    assert sorted((r.k or "", r.hour.hour) for r in found) == [("", 1), ("a", 1), ("a", 2), ("b", 2)]


def test_every_exchange_has_its_gaps(spark, work):
    sent = [(0, "Pavisade"), (1, " pavisade\t"), (2, "pavisade"), (0, "brennix"), (3, "BRENNIX "), (0, "corvane"), (1, "corvane")]
    trades(spark, [trade(i, hour * 3600, exchange=exchange) for i, (hour, exchange) in enumerate(sent)]).coalesce(1).write.parquet(f"{work}/market_trade_raw_event.parquet")
    found = QUERIES["hourly_freshness_gaps_by_exchange"](spark, work).collect()
    assert sorted(map(tuple, found)) == [("brennix", "2020-01-06 01"), ("brennix", "2020-01-06 02")]


def test_incidents(spark):
    incidents = spark.createDataFrame([("i", "x", 1, at(50)), ("j", "y", 0, at(5))], "incident_id string, k string, b long, at timestamp")
    seen = spark.createDataFrame([("x", 0, at(10)), ("x", 1, at(50)), ("x", 2, at(90)), ("y", 0, at(9))], "k string, b long, at timestamp")
    found = {r.incident_id: (r.last_before, r.first_after) for r in reconcile.around_incidents(incidents, seen, ["k"], "b").collect()}
    plain = lambda s: at(s).replace(tzinfo=None)
    assert found == {"i": (plain(50), plain(90)), "j": (None, plain(9))}


def test_settings():
    env = {"TIDELOG_BROKERS": "b:1", "TIDELOG_ARCHIVE": "s3a://x/y/", "TIDELOG_CHECKPOINT": "s3a://x/z"}
    assert config.SinkSettings.read(env).output == "s3a://x/y"
    for change in ({"TIDELOG_CHECKPOINT": "s3a://x/y"}, {"TIDELOG_ARCHIVE": "ftp://x"}, {"TIDELOG_BROKERS": " "}):
        with pytest.raises(config.SettingsError):
            config.SinkSettings.read(env | change)
    for limit in ("0", "x", "-1"):
        with pytest.raises(config.SettingsError):
            config.AuditSettings.read(env | {"TIDELOG_SAMPLE_LIMIT": limit})
    assert config.symbols(" btc-usd,,BTC-USD, eth ") == ["BTC-USD", "ETH"]
    with pytest.raises(config.SettingsError):
        config.symbols(" , ")
    assert config.object_store("http://h", "a", "b")["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"


def test_instants(spark):
    from tidelog.functions import text as X

    texts = ["2020-01-06T00:00:01Z", "2020-01-06T02:00:01.5+02:00", "2020-01-06T00:00:01", "2020-02-30T00:00:00Z", "yesterday", "", None]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(X.instant(F.col("t")))).collect()]
    base = int(at(1).timestamp() * 1e6)
    assert found == [base, base + 500_000, None, None, None, None, None]


def test_anomaly_events_are_repeatable(spark):
    judged, _ = sequence(spark, 100, 104, 104, 99, 105)
    counted = continuity.health(judged, ["k"], ["b"], ["o"], "v")
    events = sorted(continuity.anomaly_events(counted, ["k"], ["o"], "v", "envelopes").collect(), key=lambda r: r.o)
    assert [(r.observation_type, r.missing_from, r.sequence_gap_count, r.duplicate_sequence_count, r.out_of_order_sequence_count) for r in events] == [
        ("sequence_gap", 101, 1, 0, 0), ("duplicate_sequence", None, 1, 1, 0), ("out_of_order_sequence", None, 1, 1, 1),
    ]
    again = {r.event_id for r in continuity.anomaly_events(counted, ["k"], ["o"], "v", "envelopes").collect()}
    assert again == {r.event_id for r in events} and len(again) == 3 and all(uuid.UUID(i).version == 5 for i in again)


def test_lifecycles(spark):
    df = spark.createDataFrame([("x", "a", at(0), at(5)), ("x", "a", at(0), at(9)), ("x", "b", at(20), at(21)), ("y", "c", at(1), at(1)), ("y", None, at(0), at(0))], "s string, c string, t timestamp, u timestamp")
    found = sorted((r.c, r.observation_type) for r in continuity.lifecycles(df, "s", "c", "t", "u").collect())
    assert found == [("a", "connection_opened"), ("b", "connection_opened"), ("b", "connection_recovered"), ("c", "connection_opened")]


def test_large_prices_do_not_stop_the_facts(spark):
    df = spark.createDataFrame([("2e10", "3.5"), ("1.00000001", "2"), ("9e19", "9e19"), (None, "1")], "p string, s string")
    found = df.select(models.notional(F.col("p").cast("double").cast("decimal(38,18)"), F.col("s").cast("double").cast("decimal(38,18)")).alias("n")).collect()
    assert [None if r.n is None else float(r.n) for r in found] == [7e10, 2.00000002, None, None]


def test_quiet_times_equal_silences_in_order_of_time(spark):
    df = spark.createDataFrame([("k", n, at(s)) for n, s in enumerate([0, 0.1, 5, 16.9, 15.2, 26, 70, 7300, 7300.5])] + [(None, 1, at(3)), ("k", 9, None)], "k string, o long, t timestamp")
    found = sorted((r.silent_from, r.seconds) for r in continuity.quiet_times(df, ["k"], "t", 10).collect())
    expected = continuity.silences(df.where("t is not null"), ["k"], [], ["t"], "t", 10)
    assert found == sorted((r.silent_from, r.seconds) for r in expected.collect()) and [s for _, s in found] == [10.2, 44.0, 7230.0]


def test_few_trades_lie_near_an_incident(spark):
    import random

    rng = random.Random(2)
    seen = [(rng.choice("xy"), at(rng.randrange(40_000) / 1000)) for _ in range(3000)]
    asked = [(str(i), rng.choice("xyz"), at(rng.randrange(-2000, 43_000) / 1000)) for i in range(12)]
    trades_, incidents = spark.createDataFrame(seen, "k string, at timestamp"), spark.createDataFrame(asked, "incident_id string, k string, at timestamp")
    near = reconcile.near_incidents(trades_, incidents, ["k"])
    assert near.count() < 2000
    block = F.floor(F.unix_micros("at") / 3_600_000_000).alias("block")
    found = {r.incident_id: (r.last_before, r.first_after) for r in reconcile.around_incidents(incidents.select("*", block), near.select("*", block), ["k"], "block").collect()}
    plain = lambda s: s and s.replace(tzinfo=None)
    for i, k, t in asked:
        times = [x for key, x in seen if key == k]
        assert found[i] == (plain(max((x for x in times if x <= t), default=None)), plain(min((x for x in times if x > t), default=None)))


def test_malformed_messages(spark):
    from tidelog.operators import audit

    df = records(spark, [record(1, b"\xff" * 300), record(2, None), record(3, b'{"event_id":"a","event_type":"b","schema_version":"c"}')])
    found = {r.kafka_offset: (r.reason, r.message_bytes, r.message_excerpt and len(r.message_excerpt)) for r in audit.malformed_messages(df, 16).collect()}
    assert found == {1: ("invalid_utf8", 300, 16), 2: ("null_value", None, None)}
