import random

from pyspark.sql import functions as F

from tests.data import trade, trades
from tidelog.operators.hot_keys import chunked, heavy_keys, trade_key_results
from tidelog.operators.running import running


def test_results_equal_brute_force_and_chunks_are_bounded(spark):
    random.seed(2)
    data = [trade(o, random.choice([None, random.randrange(50)]), exchange=random.choice(["hot", "hot", "hot", " HOT", None, "b"]), price=random.choice(["1", "2", "x"]), size=random.choice(["3", "-", "0.5"]), partition=o % 3) for o in range(2000)]
    import json

    model = {}
    for r in data:
        m = model.setdefault(r[3] and r[3].strip().lower(), [0, 0.0, []])
        o = json.loads(r[13])
        m[0] += 1
        m[1] += float(o["size"]) if o["size"] != "-" else 0
        if o["price"] != "x":
            m[2].append((r[5] is not None, r[5], r[14], r[15], float(o["price"])))
    got = {r.exchange: r for r in trade_key_results(trades(spark, data), chunk_rows=100).collect()}
    assert set(got) == set(model)
    for key, (n, volume, prices) in model.items():
        r = got[key]
        last = max(prices, key=lambda p: (p[0], p[1] or 0, p[2], p[3]) if p[0] else (False, 0, p[2], p[3]))[4]
        assert (r.trades, float(r.volume), r.last_price, r.chunks) == (n, volume, last, -(-n // 100))


def test_row_numbers_are_exact(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") % 7).alias("block"), "id", F.lit("x").alias("chunk_rows"))
    sizes = [r["count"] for r in chunked(df, ["k"], "block", ["id"], 64).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [64] * 15 + [40]


def test_heavy_keys(spark):
    df = trades(spark, [trade(o, exchange="h") for o in range(60)] + [trade(100 + o, exchange=f"e{o}") for o in range(40)])
    assert [tuple(r) for r in heavy_keys(df).collect()] == [("h", "A-B")]
    assert heavy_keys(trades(spark, [])).collect() == []


def test_running_equals_one_window(spark):
    random.seed(9)
    data = [(random.choice(["a", "a", None]), i // 10, i, random.choice([None, random.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, b long, o long, v long")
    for inclusive in (True, False):
        got = running(df, ["k"], ["b"], ["o"], {"hi": ("max", F.col("v")), "total": ("sum", F.col("v")), "latest": ("last", F.col("v")), "lo": ("min", F.col("v"))}, inclusive)
        seen = {}
        expected = {}
        for k, _, o, v in data:
            past = seen.setdefault(k, [])
            use = past + ([v] if inclusive else [])
            there = [x for x in use if x is not None]
            expected[o] = (max(there, default=None), sum(there), there[-1] if there else None, min(there, default=None))
            past.append(v)
        assert {r.o: (r.hi, r.total, r.latest, r.lo) for r in got.collect()} == expected
