import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.data import rows, trade, trades
from tidelog.functions.finger_tree import CLOSED, OPEN, REFUSED, FingerTree
from tidelog.operators.late_events import late_rows, period_aggregates, span_totals


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 5), st.integers(0, 9))), st.integers(3, 6))
def test_tree_equals_a_dict(steps, width):
    tree, model, gone, floor = FingerTree(lambda a, b: a + b, width), {}, [], -1
    for key, value, action in steps:
        if action == 0:
            floor = max(floor, key)
            gone += tree.evict(floor)
        elif key >= floor:
            tree.insert(key, value)
            model[key] = model.get(key, 0) + value
    kept = sorted((k, v) for k, v in model.items() if k >= floor)
    assert list(tree.items()) == kept
    assert (tree.total() or 0) == sum(v for _, v in kept)
    assert (tree.range_total(10, 30) or 0) == sum(v for k, v in kept if 10 <= k < 30)
    evicted = {}
    for k, v in gone:
        evicted[k] = evicted.get(k, 0) + v
    assert evicted == {k: v for k, v in model.items() if k < floor}


def test_bounds_of_the_tree():
    tree = FingerTree(lambda a, b: a + b, 3)
    assert tree.insert(1, 1) == OPEN
    tree.advance(closed=10, floor=5)
    assert [tree.insert(k, 1, 100) for k in (4, 5, 9, 10, 30)] == [REFUSED, CLOSED, CLOSED, OPEN, OPEN]
    tree.advance(closed=2, floor=2)  # bounds do not go back
    assert tree.insert(4, 1) == REFUSED
    assert list(tree.items()) == [(1, 1), (5, 100), (9, 100), (10, 1), (30, 1)] and tree.lowest() == 1


def test_the_tree_decides(spark, monkeypatch):
    df = trades(spark, [trade(o, 30, a) for o, a in enumerate((10, 200, 5000))])
    assert rows(late_rows(df)) == [(0, 1, "corrected"), (0, 2, "refused")]
    monkeypatch.setattr(FingerTree, "insert", lambda self, key, part, late=None: OPEN)
    assert rows(late_rows(df)) == [] and rows(period_aggregates(df)) == []


def test_limits_of_lateness(spark):
    end = 60
    arrivals = {1: end + 60, 2: end + 60.000001, 3: end + 900, 4: end + 900.000001, 5: 10}
    df = trades(spark, [trade(o, 30, a) for o, a in arrivals.items()] + [trade(6, None, 5000), trade(7, 30, None)])
    assert rows(late_rows(df)) == [(0, 2, "corrected"), (0, 3, "corrected"), (0, 4, "refused")]


def test_the_later_clock_counts_and_nulls_are_on_time(spark):
    late, early = list(trade(1, 0, 5000)), list(trade(2, 0, 5000))
    late[6], early[6], early[16] = None, None, None
    assert rows(late_rows(trades(spark, [tuple(late), tuple(early)]))) == [(0, 1, "refused")]
    assert rows(late_rows(trades(spark, []))) == []


def test_aggregates_equal_brute_force(spark):
    random.seed(3)
    data = []
    for i in range(3000):
        when = random.random() * 4000
        lag = random.choice([0.1, 1, 30, 100, 500, 2000])
        data.append(trade(i, when, when + lag, exchange="hot" if i % 3 else f"e{i % 7}", price=random.choice(["1", "2.5", "3e1", "bad", None]), size=str(i % 5)))
    model = {}
    for r in data:
        event, arrival = r[5].timestamp(), max(r[6], r[16]).timestamp()
        minute = event // 60
        late = round((arrival - (minute + 1) * 60) * 1e6)
        if late > 900e6:
            continue
        m = model.setdefault((r[3], minute), [0, 0, 0.0, []])
        m[0] += 1
        m[1] += late > 60e6
        import json

        o = json.loads(r[13])
        m[2] += float(o["size"])
        try:
            m[3].append((r[5], r[15], float(o["price"])))
        except (TypeError, ValueError):
            pass
    got = {(r.exchange, r.minute.timestamp() // 60): r for r in period_aggregates(trades(spark, data).repartition(5)).collect()}
    assert len(got) == len(model)
    for key, (n, corrected, volume, prices) in model.items():
        r, prices = got[key], sorted(prices)
        assert (r.trades, r.corrected, round(r.volume, 6)) == (n, corrected, round(volume, 6))
        assert (r.open, r.close) == ((prices[0][2], prices[-1][2]) if prices else (None, None))
        assert (r.high, r.low) == ((max(p[2] for p in prices), min(p[2] for p in prices)) if prices else (None, None))


def test_span_totals_are_those_of_their_periods(spark):
    random.seed(4)
    data = []
    for i in range(4000):
        when = random.random() * 20_000
        data.append(trade(i, when, when + random.choice([0.1, 30, 100, 500, 2000]), exchange=f"e{i % 7}", price=random.choice(["1", "2.5", "bad"]), size=str(i % 5)))
    df = trades(spark, data).repartition(3)
    expected = {}
    for r in period_aggregates(df).collect():
        hour = expected.setdefault(r.minute.replace(minute=0), [0, 0, 0.0, [], []])
        hour[0] += r.trades
        hour[1] += r.corrected
        hour[2] += r.volume
        hour[3] += [r.high] if r.high else []
        hour[4] += [r.low] if r.low else []
    got = {r.begin: (r.trades, r.corrected, r.volume, r.high, r.low) for r in span_totals(df).collect()}
    assert got == {h: (n, c, v, max(a), min(b)) for h, (n, c, v, a, b) in expected.items()} and len(got) == 6


def test_null_keys_are_a_source(spark):
    df = trades(spark, [trade(1, exchange=None), trade(2, exchange=None), trade(3, symbol=None, payload=None)])
    got = {(r.exchange, r.symbol): (r.trades, r.open) for r in period_aggregates(df).collect()}
    assert got == {(None, "A-B"): (2, 10.0), ("x", None): (1, None)}
