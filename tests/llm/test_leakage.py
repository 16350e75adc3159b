import pickle
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import leakage
from tidelog.llm.automaton import SuffixAutomaton
from tidelog.session import BROADCAST_LIMIT_BYTES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 4))
def test_automaton_equals_brute_force(items, document, least):
    found = {}
    for place, length, held in SuffixAutomaton(items, least).matches(document):
        found[place] = (length, held)
    runs = [{tuple(i[a:b]) for a in range(len(i)) for b in range(a + 1, len(i) + 1)} for i in items]
    for place in range(len(document)):
        lengths = [n for n in range(1, place + 2) if any(tuple(document[place + 1 - n : place + 1]) in r for r in runs)]
        longest = max(lengths, default=0)
        if longest < least:
            assert place not in found
        else:
            tail = tuple(document[place + 1 - least : place + 1])
            assert found[place] == (longest, tuple(i for i, r in enumerate(runs) if tail in r))


def test_an_automaton_of_greatest_size_may_be_broadcast():
    rng = random.Random(3)
    texts, size = [], 0
    while size < leakage.AUTOMATON_CHARACTERS:
        texts.append([f"w{int(rng.paretovariate(0.6)) % 100_000}" for _ in range(100)])
        size += sum(len(w) + 1 for w in texts[-1])
    assert len(pickle.dumps(SuffixAutomaton(texts, 12))) < BROADCAST_LIMIT_BYTES


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(40)}" for _ in range(n)]


def items(spark, texts):
    return spark.createDataFrame([(100 + i, "s", t, 1) for i, t in enumerate(texts)], "item_id long, suite string, text string, doc_id int")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")


def test_leaks_and_limits(spark):
    held = words(40, 1)
    shown = "; ".join(w.upper() for w in held[5:17])
    texts = [f"before {shown}!\nafter", " ".join(held[5:16]), None, "", " ".join(held), " x ".join(held), "-".join(held[20:33]) * 1, " ".join(words(500, 9)) + " " + " ".join(held[1:14])]
    found = leakage.leaks(documents(spark, texts), items(spark, [" ".join(held), " ".join(held[:11]), None, " ".join(held[4:18] + ["end"])]))
    got = sorted(map(tuple, found.collect()))
    assert got == [(0, 100), (0, 103), (4, 100), (4, 103), (6, 100), (7, 100)]


def test_items_beyond_one_automaton_are_split(spark):
    texts = [" ".join(words(30, s)) for s in range(20)]
    docs, tests = documents(spark, texts + texts[:3]), items(spark, texts)
    whole = sorted(map(tuple, leakage.leaks(docs, tests).collect()))
    assert whole == sorted(map(tuple, leakage.leaks(docs, tests, characters=700).collect()))
    assert {(i, 100 + i) for i in range(20)} <= set(whole)


def test_empty_tables(spark):
    one = documents(spark, ["a"])
    assert leakage.leaks(one, items(spark, [])).collect() == [] and leakage.leaks(one.limit(0), items(spark, ["a b"])).collect() == []


def test_spans_are_removed(spark):
    held = " ".join(words(20, 2))
    filler = " ".join(f"z{i}" for i in range(60))
    cleaned = {r.doc_id: r for r in leakage.decontaminated(documents(spark, [f"{filler} {held.upper()} end", f"x {held}", "plain", None]), items(spark, [held])).collect()}
    assert cleaned[0].text == f"{filler}  end" and cleaned[0].removed_words == 20
    assert cleaned[1].text is None and cleaned[2].text == "plain" and cleaned[3].text is None and cleaned[3].removed_words == 0


def test_split_items_clean_as_one_automaton_does(spark):
    held = [[f"{name}{i}" for i in range(20)] for name in "abcdef"]
    rest = [f"z{i}" for i in range(60)]
    both = [*held[0][:15], *rest[:5], *held[1][:15], *rest[5:20]]  # 0.3 from either item, 0.6 together
    beside = [*rest[:30], *held[2][:6], *held[3], *held[2][6:], *rest[30:]]  # cutting one item would join the halves of another
    overlap = [*rest[:40], *held[4], *held[5][10:], *rest[40:]]
    tests = items(spark, [" ".join(h) for h in held] + [" ".join(held[4][10:] + held[5])])
    docs = documents(spark, [" ".join(both), " ".join(beside), " ".join(overlap), ", ".join(held[0]), "plain", "", None])
    whole = sorted(map(tuple, leakage.decontaminated(docs, tests).collect()))
    for characters in (400, 150, 60):
        assert sorted(map(tuple, leakage.decontaminated(docs, tests, characters=characters).collect())) == whole
    assert whole[0][1:] == (30, 0.6, None) and whole[3][1:] == (20, 1.0, None)
    assert [r[1] for r in whole[4:]] == [0, 0, 0] and [r[3] for r in whole[4:]] == ["plain", "", None]


def test_cleaning_without_items(spark):
    assert sorted(map(tuple, leakage.decontaminated(documents(spark, ["a b", None]), items(spark, [])).collect())) == [(0, 0, 0.0, "a b"), (1, 0, 0.0, None)]
