import random
import re

import pytest

from tidelog.llm import spam
from tidelog.llm.spam import _mixed, shapes, spam_pages, spam_share

SENTENCES = "The data desk asked the venue to check why the archive fell behind. Nobody had raised the limit before the open, so lag grew from 4 s to 90 s. Two analysts compared both copies by hand and found nothing odd."
SPAM = {
    "keyword lines": "\n".join(f"{a} gold wallet {p}" for a in ("Best", "Cheap", "Top", "Free") for p in ("Arno", "Brix", "Cole", "Dorn", "Elba")),
    "keyword prose": "Gold wallet gold wallet gold wallet. Best KORU gold wallet! cheap KORU!!! KORU gold wallet, buy gold wallet. " * 6,
    "comma list": ", ".join(["gold wallet", "best wallet", "cheap gold", "buy wallet"] * 6),
    "links": "\n".join(f"* [best offer {i}](https://a{i}.example/p/{i})" for i in range(20)),
    "bare links": "\n".join(f"- http://a{i}.example/p/{i}" for i in range(20)),
    "html links": "<ul>" + "".join(f'<li><a href="https://a{i}.example">Offer {i}</a></li>' for i in range(20)) + "</ul>",
    "tags": "\n".join(f"sku:{i} brand:b{i} tag:top" for i in range(20)),
    "hash tags": " ".join(f"#offer{i % 7}" for i in range(60)),
    "hosts on lines": "\n".join(f"example{i}.com/page/{i}" for i in range(80)),
    "one host again and again": "\n".join("example7.com/page/7" for _ in range(80)),
    "hosts in a row": " >> ".join(f"shop{i}.example" for i in range(40)),
    "products": " | ".join(f"KORU reader v{i} {i}.50" for i in range(20)),
}
PLAIN = {
    "prose": SENTENCES,
    "log": "\n".join(f"2021-01-01T00:00:{i:02d}Z WARN reader partition=1 offset={i} stopped" for i in range(40)),
    "settings": "\n".join(f"READER_LIMIT_{i}={i}" for i in range(40)),
    "table": "| symbol | price |\n|---|---|\n" + "\n".join(f"| AB-USD | {i}.5 |" for i in range(40)),
    "csv numbers": "\n".join(",".join(str((i * 7919 + j * 104729) % 1000) for j in range(10)) for i in range(40)),
    "csv prices": "symbol,venue,side,price,size,time,seq,flag,kind\n" + "\n".join(f"AB-USD,lumenex,BUY,{i}.5,{i},12:00:{i:02d},{i},ok,late" for i in range(40)),
    "cells": "symbol | price | size | side\n" + "\n".join(f"AB-USD | {i}.5 | 3 | BUY" for i in range(40)),
    "code": "\n".join(f"draw(canvas, left, top, width, height, colour, border, label, layer{i})" for i in range(30)),
    "files": "\n".join(f"- loader_{i}.py" for i in range(80)),
    "glossary": "\n".join(", ".join(w + e for w in pair for e in ("", "s", "ed", "ing")) for pair in (("count", "check"), ("load", "trim"), ("start", "reset"), ("jump", "walk"), ("call", "talk"), ("print", "paint"))),
    "some links": SENTENCES + "\nSee also\n- http://a.example/x\n- http://b.example/y",
    "some tags": SENTENCES + "\n#feeds #audit #lag",
    "templates": "Primero hay que contar los envíos y después avisar al turno de mañana. Primero hay que contar los precios y después avisar al turno de mañana. " * 5,
    "odd characters": "I'll we've they'd it's \U0001f1e9\U0001f1ea [UNK] I'll we've they'd it's x=1; I'll we've they'd it's",
    "link in a sentence": "Details are on https://a.example/wiki/1 under case 1, where the desk keeps the notes of the night. " * 3,
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert spam_share(SPAM[name]) > 0.9
    assert spam_share(SENTENCES.split(". ")[0] + ".\n" + SPAM[name]) > 0.5


@pytest.mark.parametrize("name", PLAIN)
def test_plain(name):
    assert spam_share(PLAIN[name]) < 0.4


@pytest.mark.parametrize("text", [None, "", " \n\t ", "...", "one", "￿\x00"])
def test_texts_without_words(text):
    assert spam_share(text) == 0.0


def test_shapes_cover_all_words():
    for name, text in (SPAM | PLAIN).items():
        if name != "html links":  # the separators between those are words too
            assert sum(n for _, n, _ in shapes(text)) == len(re.findall(r"[^\W_]+", text)), name


def test_shapes_decide(monkeypatch):
    """With one shape for every unit nothing is found any more."""
    one = spam.Shape("line", False, 8, "a", False)
    monkeypatch.setattr(spam, "Shape", lambda *_: one)
    assert not any(spam_share(t) for t in SPAM.values())


def test_few_shapes_must_dominate(monkeypatch):
    page = "\n".join(SPAM.values())
    assert spam_share(page) > 0.5
    monkeypatch.setattr(spam, "FEW_SHAPES", 1)
    assert spam_share(page) < 0.5


def test_pages(spark):
    texts = [SPAM["links"], PLAIN["prose"], None, "", SPAM["tags"] * 400, PLAIN["log"] * 400]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")], "doc_id long, text string, share string")
    assert sorted(r.doc_id for r in spam_pages(df).collect()) == [0, 4]
    assert spam_pages(df.limit(0)).collect() == []


def cycled(words, n, a_line, seed=1):
    rng = random.Random(seed)
    drawn = [f"kw{rng.randrange(words)}" for _ in range(n)]
    return "\n".join(" ".join(drawn[i : i + a_line]) for i in range(0, n, a_line))


def test_keywords_in_other_order_on_every_line():
    rng = random.Random(1)
    keywords = "gold wallet reader koru best cheap buy offer top free online store".split()
    page = "\n".join(" ".join(rng.sample(keywords, 12)) for _ in range(20))
    assert spam_share(page) > 0.9 and spam_share(SENTENCES + "\n" + page) > 0.4
    assert spam_share("\n".join([" ".join(keywords)] * 20)) < 0.4  # the same line again and again may be a template


@pytest.mark.parametrize(("words", "n", "a_line"), [(40, 400, 15), (80, 1000, 20), (80, 2000, 2000), (150, 1500, 20)])
def test_keywords_cycled_over_the_page(words, n, a_line):
    assert spam_share(cycled(words, n, a_line)) > 0.9


def test_prose_that_repeats_itself_is_not_in_random_order():
    rng = random.Random(2)
    who, did, what = ["the desk", "a night analyst", "our venue", "the second reader"], ["checked", "asked for", "wrote down", "compared"], ["the archive", "all late trades", "a copy of the log", "the open limit"]
    prose = [f"{rng.choice(who)} {rng.choice(did)} {rng.choice(what)} and then {rng.choice(did)} {rng.choice(what)}".split() for _ in range(200)]
    assert not any(_mixed(prose)) and all(_mixed([rng.sample(p, len(p)) for p in prose]))


@pytest.mark.parametrize("text", [
    "Buy gold wallet, gold wallet, best gold wallet. Gold wallet gold wallet!",
    "Best KORU gold wallet, KORU gold wallet free. Gold wallet KORU, cheap gold wallet KORU. KORU wallet gold wallet best KORU gold",
    "\n".join(f"{a} gold wallet KORU" for a in ("Best", "Cheap", "Top", "Free") * 2),
])
def test_short_stuffed_pages(text):
    assert 11 < len(re.findall(r"\w+", text)) < 40 and spam_share(text) > 0.9


def test_short_pages_that_repeat_a_little_are_plain():
    assert spam_share("bitte zuerst die Kurse zählen und danach anrufen\nbitte zuerst die Lücken zählen und danach anrufen\n" * 2) < 0.4
    assert spam_share("gold wallet gold wallet gold wallet") == 0.0
