import random

from tests.data import record, records, rows
from tidelog.operators.copy_diff import FIELDS, differences


def brute(log, archive):
    found = set()
    positions = {}
    for side, data in enumerate((log, archive)):
        for r in data:
            positions.setdefault(r[:3], ([], []))[side].append(r[3:])
    for position, (a, b) in positions.items():
        if not b:
            found.add((*position, "missing_in_archive"))
        elif not a:
            found.add((*position, "missing_in_log"))
        else:
            for i, name in enumerate(FIELDS):
                if len({repr(x[i]) for x in a + b}) > 1:
                    found.add((*position, name))
    return found


def test_equals_brute_force(spark, work):
    random.seed(5)
    log = [record(o, value=bytes([o % 7]), partition=p, headers=[("h", b"1"), (None, None)]) for p in (0, 1) for o in range(0, 70_000, 37)]
    archive = []
    for r in log:
        move = random.random()
        if move < 0.01:
            continue
        changed = list(r)
        if move < 0.02:
            changed[6] = random.choice([None, b"", b"other"])
        elif move < 0.03:
            changed[5] = None
        elif move < 0.04:
            changed[7] = random.choice([None, [], [("h", b"1")], [(None, None), ("h", b"1")], [("h", b"1"), (None, b"")]])
        elif move < 0.05:
            changed[4] = 1
        archive.append(tuple(changed))
        if move > 0.97:
            archive += [r, r]
        elif move > 0.95:
            archive.append((*r[:6], b"second copy", r[7]))
    archive += [record(o, partition=2) for o in range(5)] + [record(90_000 + o, partition=0) for o in range(3)] * 2
    assert set(map(tuple, differences(records(spark, log), records(spark, archive), work).collect())) == brute(log, archive)


def test_repeats_on_one_side_do_not_hide_a_gap(spark, work):
    assert rows(differences(records(spark, []), records(spark, [record(1), record(1)]), work)) == [("t", 0, 1, "missing_in_log")]


def test_null_and_empty_are_told_apart_and_equal_sides_give_nothing(spark, work):
    one = [record(1, value=None, key=b""), record(2, headers=[]), record(3, headers=[("a", None)])]
    assert rows(differences(records(spark, one), records(spark, one + one), work)) == []
    other = [record(1, value=b"", key=None), record(2, headers=None), record(3, headers=[("a", b"")])]
    assert rows(differences(records(spark, one), records(spark, other), work + "2")) == [
        ("t", 0, 1, "kafka_key"), ("t", 0, 1, "kafka_value"), ("t", 0, 2, "kafka_headers"), ("t", 0, 3, "kafka_headers"),
    ]
    assert rows(differences(records(spark, []), records(spark, []), work + "3")) == []


def test_null_keys_are_keys(spark, work):
    log, archive = [record(None, b"a"), record(1, b"a", topic=None)], [record(None, b"b"), record(1, b"c", topic=None)]
    found = differences(records(spark, log), records(spark, archive), work).collect()
    assert sorted(map(str, map(tuple, found))) == ["('t', 0, None, 'kafka_value')", "(None, 0, 1, 'kafka_value')"]


def test_large_side_is_joined_instead_of_broadcast(spark, work, monkeypatch):
    from tidelog.operators import copy_diff

    monkeypatch.setattr(copy_diff, "BROADCAST_LIMIT_BYTES", 0)
    assert rows(differences(records(spark, [record(9, b"a"), record(10)]), records(spark, [record(9, b"b"), record(10)]), work)) == [("t", 0, 9, "kafka_value")]


def test_copies_on_both_sides_do_not_cancel(spark, work):
    log, archive = [record(1, b"a"), record(1, b"a"), record(2)], [record(1, b"b"), record(1, b"b"), record(2)]
    assert rows(differences(records(spark, log), records(spark, archive), work)) == [("t", 0, 1, "kafka_value")]


def test_the_checksums_decide(spark, work, monkeypatch):
    from tidelog.operators import copy_diff

    log, archive = records(spark, [record(1, b"a"), record(2)]), records(spark, [record(1, b"b"), record(2)])
    monkeypatch.setattr(copy_diff, "_tree", lambda side, base, size: [copy_diff.np.zeros((1, 4))])
    assert rows(differences(log, archive, work)) == []


def test_ranges_far_apart_and_negative_offsets(spark, work):
    places = [-5, 0, (1 << 27) - 1, 1 << 27, (1 << 40) + 3]
    log = [record(o, b"a") for o in places]
    archive = [record(o, b"a" if o == 0 else b"b") for o in places[:-1]]
    assert rows(differences(records(spark, log), records(spark, archive), work)) == [
        ("t", 0, -5, "kafka_value"), ("t", 0, places[2], "kafka_value"), ("t", 0, places[3], "kafka_value"), ("t", 0, places[4], "missing_in_archive"),
    ]
