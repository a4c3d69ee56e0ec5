import random
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfline.functions import keywords, terms
from shelfline.functions.terms import TermIndex
from shelfline.functions.text import extract_text
from shelfline.operators.dataset import unavailable_hits, unavailable_report


def plain(texts, words):
    return [(i, k, (t or "").count(w)) for i, t in enumerate(texts) for k, w in enumerate(words) if w and w in (t or "")]


WORDS = ["a", "ab", "aba", "abab", "ababa", "404", "sold out", "not found", "找不到", "无法", "é", "%%%", "zzzzz", "out of stock", ""]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab 4%éz找不到", max_size=40) | st.sampled_from(["x404y sold out out of stock", "not found 404", "ababababa"]), max_size=6),
       st.lists(st.sampled_from(WORDS), max_size=8, unique=True))
def test_index_counts_like_python(texts, words):
    text, term, n = TermIndex(words).hits(pa.array(texts, pa.string()))
    assert list(zip(text.tolist(), term.tolist(), n.tolist(), strict=True)) == plain(texts, words)


def test_terms_across_texts_are_none():
    got = TermIndex(["abcdef", "ab"]).hits(pa.array(["xxabc", "defab", "abcdef"]))
    assert [x.tolist() for x in got] == [[0, 1, 2, 2], [1, 1, 0, 1], [1, 1, 1, 1]]


def test_columns(spark, monkeypatch):
    monkeypatch.setattr(terms, "SLICE_BYTES", 50)
    rng = random.Random(4)
    texts = [None, "", "Sold Out sold out 404"] + ["".join(rng.choice("ab 40é") for _ in range(rng.randrange(80))) for _ in range(40)]
    words = [w for w in WORDS if w]
    df = spark.createDataFrame(list(enumerate(texts)), "i BIGINT, t STRING").repartition(3)
    want = sorted((i, words[k], n) for i, k, n in plain([t and t.lower() for t in texts], words))
    assert sorted(map(tuple, unavailable_hits(df, words, F.col("t"), "i").collect())) == want
    said = keywords.unavailable_terms("t", words)
    assert sorted(map(str, unavailable_report(df, words, F.col("t"), "i").collect())) == sorted(
        map(str, df.select("i", said.alias("u")).select("i", "u.*").collect()))
    assert unavailable_hits(df, [], F.col("t"), "i").count() == 0
    html = spark.createDataFrame([(1, "<p>not&nbsp;found &#52;04</p>")], "i BIGINT, t STRING")
    assert [tuple(r) for r in unavailable_hits(html, ["404"], extract_text("t"), "i").collect()] == [(1, "404", 1)]


def test_thousands_of_terms_cost_little_more_than_a_few():
    rng = random.Random(1)
    letters = "etaoinshrdlucmfwypvbgkqjxz"
    words = list({"".join(rng.choice(letters) for _ in range(rng.randrange(6, 14))) for _ in range(5000)})
    texts = pa.array([" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(400)) for _ in range(400)])

    def best(index):
        seconds = []
        for _ in range(5):
            t0 = time.perf_counter()
            index.hits(texts)
            seconds.append(time.perf_counter() - t0)
        return min(seconds)

    few, many = TermIndex(words[:50]), TermIndex(words)
    assert best(many) < 2 * best(few) + 0.01
    assert plain(texts.to_pylist()[:5], words) == [x for x in zip(*(v.tolist() for v in many.hits(texts.slice(0, 5))), strict=True)]
