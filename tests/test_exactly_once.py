import random
import uuid

import pytest
from pyspark.sql import functions as F

from tests.data import rows, trade, trades
from tidelog.functions import text as X
from tidelog.operators.exactly_once import IdentifierIndex, exactly_once, further_copies, prefix_bits_for


def test_copies_by_normalised_identity(spark, work):
    df = trades(
        spark,
        [
            trade(1, 5, exchange="x", sid="1"),
            trade(2, 4, exchange=" X", symbol="a-b ", sid="1 "),  # the earliest, kept
            trade(3, 4, exchange="x", sid="1"),
            trade(4, 9, exchange="y", sid="1"),
            trade(5, None, arrival=None, exchange="x", sid="1"),  # no rank loses
        ],
    )
    assert rows(further_copies(df, work)) == [(0, 1), (0, 3), (0, 5)]


def test_one_identity_holds_most_rows_in_several_batches(spark, work):
    random.seed(1)
    data = [trade(i, random.randrange(1000), sid="hot" if i % 3 == 0 else str(i // 2)) for i in range(600)]
    best = {}
    for r in data:
        key, place = r[7], (r[6], r[14], r[15])
        best[key] = min(best.get(key, place), place)
    expected = sorted((r[14], r[15]) for r in data if best[r[7]] != (r[6], r[14], r[15]))
    assert rows(further_copies(trades(spark, data), work, batches=5)) == expected


def test_null_parts_fall_back_to_the_identifier(spark, work):
    one = "3df00381-f849-5ff6-bef0-69aef86cb35a"
    df = trades(spark, [trade(1, sid=None, event_id=one), trade(2, sid=None, event_id="urn:uuid:" + one.upper()), trade(3, sid=None), trade(4, sid=None), trade(5, exchange=None, sid="1")])
    assert rows(further_copies(df, work)) == [(0, 2)]


def test_empty_and_repeated_rows(spark, work):
    assert rows(further_copies(trades(spark, []), work)) == []
    df = trades(spark, [trade(1), trade(1), trade(2)])
    assert rows(further_copies(df, work + "2")) == [(0, 2)]
    kept = exactly_once(df, work + "3")
    assert kept.columns == df.columns and kept.count() == 2


def test_index_takes_a_batch_once_and_merges(spark, work):
    index = IdentifierIndex(spark, work, prefix_bits=2, merge_every=2)

    def batch(*ids):
        return spark.createDataFrame([(i.to_bytes(16, "big"), 1, 0, n) for n, i in enumerate(ids)], "id binary, rank long, part int, offset long")

    index.add(batch(1, 2 << 120, 3), "a")
    index.add(batch(1, 2 << 120, 3), "a")
    assert index.kept().count() == 3
    index.add(batch(3, 4, 5 << 100), "b")
    state = index.state()
    assert state["batches"] == ["a", "b"] and len(state["runs"]) == 1
    assert index.kept().count() == 5


def test_prefixes_grow_with_the_table(spark, work):
    assert prefix_bits_for(10) == 4 and prefix_bits_for(10**13) == 27
    index = IdentifierIndex(spark, work, prefix_bits=30)
    ids = spark.createDataFrame([(bytes([255] * 16),), (bytes(16),)], "id binary").select(index.prefix(F.col("id")))
    assert sorted(r[0] for r in ids.collect()) == [0, 2**30 - 1]


@pytest.mark.parametrize("parts", [("Northmere ", " btc-usd", "123456789"), ("é\tx", 'q"\\', "\U0001f600\x7f"), ("ﬁ z", "ß", "\n7　"), ("", "", "")])
def test_identifier_equals_uuid5(spark, parts):
    import json

    name = json.dumps(["market.trade.raw", "v1", parts[0].strip().lower(), parts[1].strip().upper(), parts[2].strip()], separators=(",", ":"))
    found = spark.createDataFrame([parts], "a string, b string, c string").select(X.hyphenated(X.trade_identity_hex(F.col("a"), F.col("b"), F.col("c")))).first()[0]
    assert found == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_strip_is_pythons(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "﻿", "\x00"]
    data = [(f"{s}a{s}b{s}",) for s in spaces]
    assert [r[1] for r in spark.createDataFrame(data, "t string").select("t", X.strip(F.col("t"))).collect()] == [t.strip() for (t,) in data]


def test_number(spark):
    texts = ["1", " 1.5 ", "1E+3", "-.5", "1.", "1d", "0x1", "NaN", "Infinity", "", "1,5", None, "1e999"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.number(F.col("t"))).collect()]
    assert found == [1.0, 1.5, 1000.0, -0.5, 1.0, None, None, None, None, None, None, None, float("inf")]
