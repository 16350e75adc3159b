from datetime import date

import pytest

from tests.data import at, record
from tidelog.operators import compaction
from tidelog.operators.compaction import ConflictError, compact, current, fragmented_hours, rollback
from tidelog.sources import store

LOG = "file_path string, event_date date, event_hour string, batch_id long, n_records long, size_bytes long, modified_at timestamp, file_action string, needed int"
ROWS = "kafka_topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, kafka_timestamp_type int, kafka_key binary, kafka_value binary, kafka_headers array<struct<key:string,value:binary>>, event_date date, event_hour string, source_file string, needed int"
DAY = date(2020, 1, 6)


def entry(name, hour="07", size=1000, n=1, seconds=0, action="add", known=True):
    return (f"raw/event_date=2020-01-06/event_hour={hour}/{name}", DAY if known else None, hour if known else None, 1, n, size, at(seconds), action, 1)


def hours(spark, log):
    return {r.event_hour: (r.files, r.needed) for r in fragmented_hours(spark.createDataFrame(log, LOG)).collect()}


def test_live_files_and_needs(spark):
    log = [
        entry("a"), entry("a"), entry("b", known=False),  # two small files need one
        entry("c", "08"), entry("d", "08", seconds=5), entry("d", "08", None, None, 9, "delete"), entry("d", "08", seconds=2),  # one live file
        entry("e", "09", 131072), entry("f", "09", 1), entry("g", "10", n=0), entry("h", "10"),  # as many as needed
        entry("i", "11", 131073), entry("j", "11", 131071), entry("k", "11", 1), entry("l", "11", 1),  # 262146 bytes need three
        entry("m", "12"), entry("n", "12"), entry("n", "12", seconds=3, action="delete"), entry("n", "12", seconds=7),  # added again
    ]
    assert hours(spark, log) == {"07": (2, 1), "11": (4, 3), "12": (2, 1)}
    assert hours(spark, []) == {}


def rows_of(hour, n, first=0):
    return [(*record(first + i, bytes([i % 9]), headers=[("h", b"1")]), DAY, hour, "f", 1) for i in range(n)]


@pytest.fixture
def place(spark, work):
    """(root, archive path, log path), with functions that append to either."""

    class Place:
        root, archive, log = f"{work}/root", f"{work}/archive", f"{work}/log"

        def rows(self, data):
            spark.createDataFrame(data, ROWS).write.mode("append").parquet(self.archive)

        def files(self, entries):
            spark.createDataFrame(entries, LOG).write.mode("append").parquet(self.log)

        def compact(self, **options):
            return compact(spark, self.archive, self.log, self.root, **options).collect()

        def current(self):
            return sorted((r.event_hour, r.kafka_offset, r.kafka_value, str(r.kafka_headers)) for r in current(spark, self.archive, self.root).collect())

    return Place()


def shown(data):
    return sorted((r[9], r[2], r[6], "[Row(key='h', value=b'1')]") for r in data)


def test_rewrite_keeps_every_row_and_other_hours(spark, place):
    data = rows_of("07", 50) + rows_of("07", 3) + rows_of("08", 5, 100)  # with repeated rows and an hour that needs nothing
    place.rows(data)
    place.files([entry("a"), entry("b"), entry("c", size=200_000), entry("x", "08")])
    assert place.current() == shown(data)
    report = place.compact()
    assert [(r.event_hour, r.rows, r.files_before, r.needed, r.files_after <= 2) for r in report] == [("07", 53, 3, 2, True)]
    assert place.current() == shown(data)
    stored = spark.read.parquet(f"{place.root}/data")
    assert stored.count() == 53 and "source_file" not in stored.columns
    assert store.read_json(spark, f"{place.root}/snapshots/1.json")["version"] == 1
    # nothing changed, so nothing is rewritten; a new file makes its hour due again
    assert place.compact() == []
    place.rows(rows_of("07", 2, 500))
    place.files([entry("d", seconds=9)])
    assert [r.rows for r in place.compact()] == [55]
    assert place.current() == shown(data + rows_of("07", 2, 500))


def test_a_claimed_version_is_a_conflict_until_it_runs_out(spark, place):
    place.rows(rows_of("07", 5))
    place.files([entry("a"), entry("b")])
    store.create_json(spark, f"{place.root}/claims/1-1.json", {"until": 9e12})
    with pytest.raises(ConflictError):
        place.compact()
    store.delete(spark, f"{place.root}/claims/1-1.json")
    store.create_json(spark, f"{place.root}/claims/1-1.json", {"until": 1})
    assert len(place.compact()) == 1


@pytest.mark.parametrize("lost", ["kafka_offset <> 3", "kafka_headers"])
def test_lost_rows_and_headers_are_noticed_and_never_seen(spark, place, monkeypatch, lost):
    real = compaction._sums

    def sums(rows):
        if "source_file" in rows.columns:
            return real(rows)
        return real(rows.withColumn("kafka_headers", compaction.F.lit(None).cast(rows.schema["kafka_headers"].dataType)) if lost == "kafka_headers" else rows.where(lost))

    monkeypatch.setattr(compaction, "_sums", sums)
    data = rows_of("07", 9)
    place.rows(data)
    place.files([entry("a"), entry("b")])
    with pytest.raises(RuntimeError, match="rows differ"):
        place.compact()
    assert not store.exists(spark, f"{place.root}/snapshots/1.json") and place.current() == shown(data)
    monkeypatch.setattr(compaction, "_sums", real)
    assert len(place.compact()) == 1  # the failed run gave its claim back
    assert place.current() == shown(data)


def test_a_commit_during_the_run_is_a_conflict(spark, place, monkeypatch):
    real = compaction._stored
    data = rows_of("07", 9)
    place.rows(data)
    place.files([entry("a"), entry("b")])

    def meanwhile(*args):
        place.files([entry("c", seconds=4)])
        return real(*args)

    monkeypatch.setattr(compaction, "_stored", meanwhile)
    with pytest.raises(ConflictError, match="changed meanwhile"):
        place.compact()
    monkeypatch.setattr(compaction, "_stored", real)
    assert place.current() == shown(data) and not store.exists(spark, f"{place.root}/snapshots/1.json")


def test_rollback(spark, place):
    data = rows_of("07", 9)
    place.rows(data)
    place.files([entry("a"), entry("b")])
    place.compact()
    assert rollback(spark, place.root) == 2
    assert place.current() == shown(data) and store.read_json(spark, f"{place.root}/snapshots/2.json")["index"] is None
    assert [r.rows for r in place.compact()] == [9]


def test_empty_tables(spark, place):
    place.rows([])
    place.files([])
    assert place.compact() == [] and place.current() == []
