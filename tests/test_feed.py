import json

from tests.data import at
from tidelog.operators import feed

MESSAGES = "connection_id string, arrival_no long, received_at timestamp, raw string, block int, stream string"


def trades_message(sequence, *trades, **change):
    return json.dumps({"channel": "market_trades", "sequence_num": sequence, "events": [{"type": "update", "trades": list(trades)}]} | change)


def beat(sequence, *counters):
    return json.dumps({"channel": "heartbeats", "sequence_num": sequence, "events": [{"heartbeat_counter": c} for c in counters]})


TRADE = {"trade_id": 5, "product_id": "A-B", "time": "2020-01-06T00:00:00Z"}


def frame(spark, raws, connection="c"):
    return spark.createDataFrame([(connection, i, at(i), r, 1, "clash") for i, r in enumerate(raws)], MESSAGES)


def test_reasons():
    cases = {
        "null_message": [None], "invalid_json": ["x", "[" * 100_000, ""], "not_object": ["[]", "null"],
        "invalid_sequence_num": [beat("1"), beat(True), beat(1.0)], "negative_sequence_num": [beat(-1)], "too_large_sequence_num": [beat(1 << 63)],
        "invalid_heartbeat_events": ['{"channel":"heartbeats","events":{}}'], "invalid_heartbeat_event": ['{"channel":"heartbeats","events":[1]}'],
        "missing_heartbeat_counter": [beat(1, None)], "invalid_heartbeat_counter": [beat(1, "x"), beat(1, True), beat(1, 1.5)], "negative_heartbeat_counter": [beat(1, "-2")],
        "invalid_events": [trades_message(1, events=5), trades_message(1, events=None)], "invalid_event": [trades_message(1, events=["x"])], "invalid_trades": [trades_message(1, events=[{"trades": 1}])],
        "invalid_trade": [trades_message(1, "x")], "missing_trade_id": [trades_message(1, {"product_id": "A"})], "missing_time": [trades_message(1, {k: v for k, v in TRADE.items() if k != "time"})],
        "invalid_time": [trades_message(1, TRADE | {"time": "soon"})], "time_without_zone": [trades_message(1, TRADE | {"time": "2020-01-06T00:00:00"})],
        None: ["{}", beat(None), beat(0, " +7 ", 8, "1_0"), trades_message(None, TRADE, TRADE), trades_message(1, events={}), trades_message(1, channel="other", events=7), trades_message(1, channel=5)],
    }
    for reason, raws in cases.items():
        for raw in raws:
            assert feed.read_message(raw)["reason"] == reason, raw
    assert feed.read_message(beat(0, " +7 ", 8, "1_0"))["counters"] == [7, 8, 10]


def test_streams_counters_and_whole_rejection(spark):
    raws = [
        trades_message(100, TRADE, TRADE),  # initialized
        beat(101, "7"),  # ok, initialized
        '{"channel":"subscriptions","sequence_num":103}',  # gap, though no trades come of it
        beat(104, "9", "9"),  # ok, gap and duplicate of the heartbeats
        trades_message(104, TRADE, {"trade_id": 1}),  # duplicate; one bad trade rejects the message
        beat(110, "x"),  # its envelope moves the baseline, nothing is counted
        trades_message(111, TRADE),  # ok, since 110 was seen
        trades_message(102, TRADE),  # out of order
        "broken",
    ]
    read = feed.read_messages(frame(spark, raws))
    judged = feed.feed_continuity(read)
    found = [(r.arrival_no, r.stream, r.current, r.previous, r.status, r.counted) for r in judged.orderBy("arrival_no", "place").collect()]
    assert found == [
        (0, "envelope", 100, None, "initialized", True), (1, "envelope", 101, 100, "ok", True), (1, "heartbeat", 7, None, "initialized", True), (2, "envelope", 103, 101, "gap", True),
        (3, "envelope", 104, 103, "ok", True), (3, "heartbeat", 9, 7, "gap", True), (3, "heartbeat", 9, 9, "duplicate", True), (4, "envelope", 104, 104, "duplicate", True),
        (5, "envelope", 110, 104, "gap", False), (6, "envelope", 111, 110, "ok", True), (7, "envelope", 102, 111, "out_of_order", True),
    ]
    health = feed.feed_health(read, judged)
    last = health.orderBy("arrival_no").collect()[-1]
    assert [last[n] for n in feed.COUNTERS] == [9, 4, 3, 2, 2, 1, 3] and (last.last_envelope, last.last_heartbeat) == (102, 9)
    events = {(r.arrival_no, r.place): r for r in feed.feed_anomalies(judged, health).collect()}
    assert [(k, events[k].observation_type) for k in sorted(events)] == [
        ((2, 0), "sequence_gap"), ((3, 1), "heartbeat_gap"), ((3, 2), "duplicate_sequence"), ((4, 0), "duplicate_sequence"), ((7, 0), "out_of_order_sequence"),
    ]
    at_four = events[(4, 0)]
    assert (at_four.gaps, at_four.duplicates, at_four.malformed, at_four.trades, at_four.envelopes) == (2, 2, 0, 2, 5)
    assert (events[(7, 0)].trades, events[(7, 0)].malformed, events[(2, 0)].missing_from, events[(2, 0)].missing_to) == (3, 2, 102, 102)
    bad = {r.arrival_no: (r.reason, len(r.message_sha256), r.message_bytes) for r in feed.feed_malformed(read).collect()}
    assert {k: v[0] for k, v in bad.items()} == {4: "missing_product_id", 5: "invalid_heartbeat_counter", 8: "invalid_json"} and bad[8][1:] == (64, 6)


def test_a_new_connection_starts_anew_and_blocks_do_not_matter(spark, monkeypatch):
    raws = [beat(n % 50, str(n)) for n in range(120)]
    both = frame(spark, raws).unionByName(frame(spark, raws, "d")).unionByName(frame(spark, raws, None))
    whole = sorted(map(str, feed.feed_continuity(feed.read_messages(both)).drop("block").collect()))
    monkeypatch.setattr(feed, "BLOCK_BITS", 2)
    read = feed.read_messages(both)
    judged = feed.feed_continuity(read)
    assert sorted(map(str, judged.drop("block").collect())) == whole
    final = {r.connection_id: tuple(r[n] for n in feed.COUNTERS) for r in feed.feed_health(read, judged).where("arrival_no = 119").collect()}
    assert len(final) == 3 and len(set(final.values())) == 1
    assert feed.feed_health(feed.read_messages(both.limit(0)), judged.limit(0)).collect() == []


def test_lifecycle(spark):
    rows = [("s", "a", at(0), at(30), at(5)), ("s", "b", at(40), at(50), at(49)), ("s", "c", at(60), at(61), None), ("t", "d", at(0), at(9), None)]
    found = feed.lifecycle_events(spark.createDataFrame(rows, "source string, connection_id string, opened_at timestamp, last_sign timestamp, last_heartbeat timestamp")).collect()
    got = {}
    for r in found:
        got.setdefault(r.connection_id, []).append((r.observation_type, r.reason))
    closed = ["reconnect_scheduled", "reconnect_attempt"]
    assert got == {
        "a": [("connection_opened", None), ("connection_closed", "heartbeat_silence"), *[(k, None) for k in closed]],
        "b": [("connection_opened", None), ("connection_recovered", None), ("connection_closed", "stream_ended"), *[(k, None) for k in closed]],
        "c": [("connection_opened", None), ("connection_recovered", None)],
        "d": [("connection_opened", None)],
    }


def test_quality_events_keep_their_contract(spark):
    import uuid

    from pyspark.sql import functions as F

    from tidelog import schemas
    from tidelog.operators import contracts

    names = [str(uuid.UUID(int=n)) for n in (1, 2)]
    raws = [trades_message(1, TRADE), beat(2, "1"), beat(9, "5"), "broken", beat(9, "5"), trades_message(3)]
    df = frame(spark, raws, names[0]).unionByName(frame(spark, raws[:2], names[1]))
    df = df.withColumn("received_at", F.expr("case when arrival_no = 4 then received_at + interval 30 seconds else received_at end"))
    read = feed.read_messages(df)
    judged = feed.feed_continuity(read)
    health = feed.feed_health(read, judged)
    connections = spark.createDataFrame(
        [("x", names[0], at(0), at(34), at(34), ["A-B"]), ("x", names[1], at(40), at(41), None, ["A-B", "C-D"])],
        "source string, connection_id string, opened_at timestamp, last_sign timestamp, last_heartbeat timestamp, symbols array<string>",
    )
    events = feed.quality_events(read, judged, health, connections)
    assert events.schema.simpleString() == spark.createDataFrame([], feed.QUALITY_EVENT).schema.simpleString() and len(events.columns) == 31
    assert {r.rule: r.violations for r in contracts.violation_counts(events, schemas.quality_rules()).collect() if r.violations} == {}
    kinds = {}
    for r in events.collect():
        kinds[r.observation_type] = kinds.get(r.observation_type, 0) + 1
    assert kinds == {
        "connection_opened": 2, "connection_recovered": 1, "connection_closed": 1, "reconnect_scheduled": 1, "reconnect_attempt": 1, "sequence_gap": 1, "heartbeat_gap": 1, "duplicate_sequence": 2,
        "out_of_order_sequence": 1, "malformed_message": 1, "heartbeat_silence": 1, "health_summary": 2,
    }
    ids = [r.event_id for r in events.collect()]
    assert len(set(ids)) == len(ids) and sorted(ids) == sorted(r.event_id for r in feed.quality_events(read, judged, health, connections).collect())
    sent = feed.encoded_events(events.where("observation_type = 'malformed_message'")).first()
    body = json.loads(sent.value)
    assert sent.key.decode() == f"x:{names[0]}" and list(body) == events.columns and (body["reason"], body["malformed_message_count"], body["stream"]) == ("invalid_json", 1, None)
