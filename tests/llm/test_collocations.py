"""Collocations against counting by definition."""

import random

import pytest

from trajspark.llm import collocations


def rows():
    rng = random.Random(3)
    words = ["Aa", "b", "c", "d", "é", "\x01", "xxx", *(f"w{i}" for i in range(12))]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t  ", ". ", ",", "\n"]) for _ in range(n))
    out = [(i, prose(rng.choice([0, 1, 5, 50, 400])), rng.choice(["en", "de", None, "und"])) for i in range(80)]
    out += [(90, None, "en"), (91, "", "fr"), (92, "one two three four five six " * 300, "en"), (93, "z y " * 4000, "de"), (None, "b c " * 9, "en")]
    return out + [(94, "hot phrase here now then " * 200, None)] * 3


#: block 300: texts are cut; budget 200 and 20: frequent prefixes are dealt again by longer ones
@pytest.mark.parametrize("how", [{}, {"block": 300}, {"budget": 200}, {"budget": 20, "block": 500}, {"percent": 60}, {"top": 5}], ids=str)
def test_equals_brute_force(spark, how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows()], "doc_id long, text string, lang string, phrase string, n int")
    want = collocations.brute_force([(lang, t) for _, t, lang in rows()], least=5, **{k: v for k, v in how.items() if k in ("percent", "top")})
    assert sorted(map(tuple, collocations.collocations(docs, least=5, **how).collect())) == sorted(want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, " .,", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(docs, least=1).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 4_000_000_000_000
    counts = [("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big - 1)]
    tables = (spark.createDataFrame(counts, "lang string, phrase string, words int, f long"), spark.createDataFrame([("en", 9 * big + 7)], "lang string, n long"))
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, **k: tables)
    got = collocations.collocations(None).collect()
    assert [r.score for r in got] == [1000 * (big - 1) * (9 * big + 7) // ((big + 1) * big)]


def test_cut_texts_keep_every_suffix():
    data = b"aa bb  cc dd, ee ff gg hh ii jj kk ll mm"
    whole = list(collocations.segments(data, 1000, 5))
    assert whole == [(data, len(data))]
    parts = list(collocations.segments(data, 6, 5))
    assert b"".join(d[:own] for d, own in parts) == data and all(len(d) - own <= 15 for d, own in parts)
