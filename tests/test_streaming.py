import random

from tests.data import record, records, trade, trades
from tidelog.operators import archive, candles, continuity, curated
from tidelog.streaming import jobs


def staged(spark, df, folder):
    df.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_archive_restarts_from_its_checkpoint(spark, work):
    def run(*offsets):
        stream = staged(spark, archive.log_records(records(spark, [record(o, seconds=7 * 3600) for o in offsets])), f"{work}/in")
        jobs.to_archive(stream, f"{work}/out", f"{work}/check").awaitTermination()
        return sorted(r.kafka_offset for r in spark.read.parquet(f"{work}/out").collect())

    assert run(1, 2) == [1, 2]
    assert run(3) == [1, 2, 3]
    from tidelog.sources import log

    assert {r.event_hour for r in log.archive(spark, f"{work}/out").collect()} == {"07"}


def test_candles_of_closed_windows_equal_batch(spark, work):
    random.seed(4)
    data = [trade(i, i * 5, sid=str(i // 2), price=str(1 + random.random())) for i in range(600)]
    df = trades(spark, data)
    stream, _ = curated.quarantined(curated.curated(staged(spark, df, f"{work}/in")))
    live = jobs.drained(jobs.live_candles(stream), f"{work}/run").collect()
    good, _ = curated.quarantined(curated.curated(df))
    batch = {r.period_start: tuple(r) for r in candles.candles(good).collect()}
    assert live and all(batch[r.period_start] == tuple(r) for r in live)


def test_once_within_watermark(spark, work):
    df = trades(spark, [trade(i, i, sid=str(i % 5)) for i in range(20)])
    stream = jobs.once_within_watermark(curated.curated(staged(spark, df, f"{work}/in")))
    assert jobs.drained(stream.select("event_id"), f"{work}/run").count() == 5


def test_split_write(spark, work):
    df = trades(spark, [trade(1), trade(2, price="-1")])
    jobs.split_write(staged(spark, df, f"{work}/in"), f"{work}/good", f"{work}/bad", f"{work}/check").awaitTermination()
    assert [r.kafka_offset for r in spark.read.parquet(f"{work}/good").collect()] == [1]
    assert [r.reason for r in spark.read.parquet(f"{work}/bad").collect()] == ["price_positive"]


def test_a_failed_quarantine_fails_the_batch_and_a_failed_report_does_not(spark, work):
    import pytest

    seen = []

    def observe(number, bad):
        seen.append((number, bad.count()))
        raise RuntimeError("no report today")

    df = trades(spark, [trade(1), trade(2, price="-1")])
    jobs.split_write(staged(spark, df, f"{work}/in"), f"{work}/good", f"{work}/bad", f"{work}/check", observe).awaitTermination()
    assert seen == [(0, 1)] and spark.read.parquet(f"{work}/good").count() == 1
    spark.range(1).write.parquet(f"{work}/taken")
    from pyspark.errors import StreamingQueryException

    with pytest.raises(StreamingQueryException):
        jobs.split_write(staged(spark, df, f"{work}/in"), f"{work}/good2", f"{work}/taken/_SUCCESS", f"{work}/check2").awaitTermination()


def test_continuity_keeps_state_across_batches(spark, work):
    random.seed(6)
    data = [trade(i, exchange=random.choice("ab"), sequence=random.randrange(30)) for i in range(200)]
    for part in (data[:120], data[120:]):
        stream = jobs.sequence_rows(staged(spark, trades(spark, part), f"{work}/in"))
        found = jobs.drained(jobs.continuity(stream), f"{work}/run")
    rows_ = jobs.sequence_rows(trades(spark, data)).selectExpr("key", "arrival", "current", "0 AS block")
    batch = continuity.classified(rows_, ["key"], ["block"], ["arrival"], "current")
    columns = ["key", "arrival", "current", "previous", "status", "missing_from", "missing_to"]
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))


def test_recorded_feed_and_progress(spark, work):
    import json
    import os

    from tidelog.sources import log
    from tidelog.streaming.metrics import ProgressLog

    folder = work.removeprefix("file://") + "/feed"
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w") as file:
        file.write(json.dumps({"connection_id": "c", "arrival_no": 1, "raw": '{"channel":"heartbeats","events":[{"heartbeat_counter":"4"}]}'}) + "\n")
    seen = ProgressLog()
    spark.streams.addListener(seen)
    try:
        stream = continuity.heartbeats_of(continuity.envelopes(log.recorded_feed(spark, folder, streaming=True)), "connection_id")
        assert [r.heartbeat_counter for r in jobs.drained(stream, f"{work}/run").collect()] == [4]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(seen)
    assert not seen.failures and sum(r["rows"] for r in seen.reports) in (0, 1)
