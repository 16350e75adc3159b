import random

import numpy as np

from tests.data import rows, trade, trades
from tidelog.functions.isolation import Forest
from tidelog.operators import spikes
from tidelog.operators.spikes import excursion, implausible


def series(n, exchange="x", start=0, seed=1):
    rng = random.Random(seed)
    price, out = 100.0, []
    for i in range(n):
        price += rng.choice([-1, 1]) * (0.5 + rng.random())
        out.append(trade(start + i, i * 7, exchange=exchange, sid=str(start + i), price=f"{price:.4f}", size=f"{1 + rng.random():.4f}"))
    return out


def put(data, i, price=None, size=None):
    old = data[i]
    import json

    o = json.loads(old[13])
    o["price"] = price if price is not None else o["price"]
    o["size"] = size if size is not None else o["size"]
    data[i] = (*old[:13], json.dumps(o), *old[14:])


def flagged(spark, data, work):
    return {(r.kafka_offset, r.rule) for r in implausible(trades(spark, data), work).collect()}


def test_each_rule(spark, work):
    data = series(400)
    for i in (50, 51, 52):
        put(data, i, price="900")
    for i in range(100, 104):  # four in a row: no spike
        put(data, i, price=str(900 + i))
    for i in range(200, 400):  # a move that lasts
        put(data, i, price=str(5000 + i + i % 3))
    put(data, 20, size="5000")
    for i in range(150, 165):
        put(data, i, size="2.5")
    for i in range(170, 184):  # one short of stuck
        put(data, i, size="2.5")
    bad = {300: "0", 301: "-1", 302: "NaN", 303: "Infinity", 304: "text", 305: "1d"}
    for i, p in bad.items():
        put(data, i, price=p)
    data[310] = (*data[310][:13], "not json", *data[310][14:])
    data[311] = (*data[311][:13], None, *data[311][14:])
    data.append((*data[51][:15], 9000, *data[51][16:]))  # a further delivery of a spike
    expected = {(i, "price_spike") for i in (50, 51, 52, 9000)} | {(20, "size_spike")} | {(i, "size_stuck") for i in range(150, 165)} | {(i, "impossible") for i in (*bad, 310, 311)}
    assert flagged(spark, data, work) == expected


def test_chunks_see_their_neighbours(spark, work, monkeypatch):
    data = series(300)
    for i in range(88, 108):
        put(data, i, price="77")
    for i in (199, 200, 201):
        put(data, i, price="4000")
    whole = flagged(spark, data, work)
    monkeypatch.setattr(spikes, "CHUNK_TRADES", 50)
    assert flagged(spark, data, work + "2") == whole
    assert {o for o, _ in whole} == {*range(88, 108), 199, 200, 201}


def test_short_sources_have_no_spikes_and_keys_are_normalised(spark, work):
    short = series(29, exchange="s", start=1000)
    put(short, 10, price="90000", size="90000")
    mixed = series(40, exchange="m", start=2000)
    mixed = [(*r[:3], r[3].upper() + " " if i % 2 else r[3], *r[4:]) for i, r in enumerate(mixed)]
    put(mixed, 20, price="90000")
    assert flagged(spark, short + mixed, work) == {(2020, "price_spike")}


def test_bursts_of_large_sizes_in_small_sources(spark, work):
    data, expected = [], set()
    for k, (n, burst) in enumerate([(37, 12), (37, 6), (61, 24)] * 3):
        key = series(n, exchange=f"k{k}", start=1000 * k, seed=k)
        rng = random.Random(k)
        for i in range(10, 10 + burst):
            put(key, i, size=f"{1.5 * rng.uniform(300, 390):.4f}")
            expected.add((1000 * k + i, "size_spike"))
        data += key
    assert flagged(spark, data, work) == expected


def test_forests_decide_on_spikes(spark, work, monkeypatch):
    data = series(200)
    put(data, 50, price="900")
    put(data, 20, size="5000")
    put(data, 70, price="0")
    assert flagged(spark, data, work) == {(50, "price_spike"), (20, "size_spike"), (70, "impossible")}
    monkeypatch.setattr(Forest, "score", lambda self, rows: np.zeros(len(rows)))
    assert flagged(spark, data, work + "2") == {(70, "impossible")}


def test_scores_alone_tell_spikes_from_the_rest(spark, work):
    data, spiked = [], set()
    for k in range(8):
        key = series(250, exchange=f"k{k}", start=1000 * k, seed=k)
        for i in range(20, 240, 40):
            put(key, i, price=str(300 + i), size=str(400 + i))
            spiked.add(i * 7_000_000)
        data += key
    start = data[0][5].timestamp() * 1e6
    scored = spikes.scored_trades(trades(spark, data), work).toPandas()
    is_spike = scored["t"].sub(int(start)).isin(spiked)
    for name in ("price_score", "size_score"):
        assert (scored[name][is_spike] > spikes.SPIKE_SCORE).all()
        assert (scored[name][~is_spike] > spikes.SPIKE_SCORE).mean() < 0.06  # the trade after a spike moves as far


def test_summaries_are_merged_step_by_step(spark, work, monkeypatch):
    data = series(400)
    for i in (50, 51, 52):
        put(data, i, price="900")
    whole = spikes.scored_trades(trades(spark, data), work).orderBy("t").toPandas()
    monkeypatch.setattr(spikes, "CHUNK_TRADES", 50)
    monkeypatch.setattr(spikes, "MERGE_BITS", 1)
    parts = spikes.scored_trades(trades(spark, data), work + "2").orderBy("t").toPandas()
    assert whole[["source", "t", "trade", "rule"]].equals(parts[["source", "t", "trade", "rule"]])
    # usual values are the same; the usual level of an hour comes from order statistics of its parts
    for name in ("price_score", "size_score"):
        assert np.abs(whole[name] - parts[name]).max() < 0.1


def test_spikes_in_the_smallest_sources(spark, work):
    """Many small sources of 30 trades, each with spikes of three trades and sizes little above the limit, which the median of a small source moves."""
    data, expected = [], set()
    for k in range(60):
        key = series(30, exchange=f"k{k}", start=1000 * k, seed=k)
        for i in (12, 13, 14):
            put(key, i, price=f"{100 + 40 + k:.2f}")
            expected.add((1000 * k + i, "price_spike"))
        for i in range(20, 20 + k % 9):
            put(key, i, size=f"{220 + i:.2f}")
            expected.add((1000 * k + i, "size_spike"))
        data += key
    found = flagged(spark, data, work)
    assert {x for x in expected if x[1] == "size_spike"} <= found and found == expected


def test_empty_and_nulls(spark, work):
    assert rows(implausible(trades(spark, []), work)) == []
    data = [trade(1, None, exchange=None), trade(2, None, exchange=None, sid=None), trade(3, sid=None, price="0")]
    assert flagged(spark, data, work + "2") == {(3, "impossible")}


def test_repeated_deliveries_count_once(spark, work):
    data = series(60)
    copies = [(*data[30][:15], 5000 + i, *data[30][16:]) for i in range(20)]  # the same trade twenty times is not stuck
    assert flagged(spark, data + copies, work) == set()


def test_excursion():
    price = np.array([1, 2, 1, 2, 1, 50, 1, 2, 1, 2, 1.0])
    assert excursion(price).argmax() == 5 and excursion(price)[5] >= 48
    assert excursion(np.array([1.0, 9.0])).max() == 0


def test_forest_ranks_outliers_first():
    rng = np.random.default_rng(0)
    rows_ = np.abs(rng.normal(size=(2000, 4))).astype(np.float32)
    rows_[:10, 0] = 60
    score = Forest.fit(rows_[rng.choice(2000, 512, replace=False)], seed=1).score(rows_)
    assert score[:10].min() > np.quantile(score[10:], 0.9)
    assert Forest.fit(np.ones((1, 2)), seed=1).score(np.ones((3, 2), dtype=np.float32)).shape == (3,)
