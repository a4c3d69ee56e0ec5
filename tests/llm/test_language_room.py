"""Language filters keep their false-positive rate however many n-grams are learnt."""

import numpy as np

from shelfline.llm import langid


def test_a_large_language_does_not_outvote(spark, monkeypatch):
    monkeypatch.setattr(langid, "POSITIONS", 1 << 10)
    rng = np.random.default_rng(1)
    # Many n-grams of one alphabet, few of another.
    big = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 60, 400))) for _ in range(40)]
    small = ["the river and the bank of the stone"] * 20
    rows = [(i, t, "zz") for i, t in enumerate(big)] + [(100 + i, t, "en") for i, t in enumerate(small)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    asked = spark.createDataFrame([(1, "the bank of the river", None), (2, big[0], None), (3, None, None), (4, "..", None)], df.schema)
    want = {1: "en", 2: "zz", 3: "und", 4: "und"}
    assert {r.doc_id: r.lang_pred for r in langid.with_language(asked, df).collect()} == want


def test_what_is_learnt_is_bounded(spark):
    """A sample of the texts, the languages and the n-grams: every text is still predicted, by the same filters at every size."""
    rng = np.random.default_rng(2)
    words = {"en": ["river", "bank", "stone", "the", "and"], "de": ["fluss", "ufer", "stein", "und", "das"], "zz": ["qqxq"]}
    rows = [(lang, " ".join(rng.choice(words[lang], 30))) for lang, n in (("en", 300), ("de", 200), ("zz", 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "lang STRING, text STRING")
    sample, langs = langid.fit_sample(df, "text", "lang", fit_texts=100, fit_langs=2)
    assert langs == ["en", "de"] and 40 < sample.count() < 160
    assert langid.fit_sample(df, "text", "lang")[0].count() == 503
    known = langid.members(langid.count_grams(sample, "text", "lang"), fit_grams=20)
    assert all(0 < r["count"] <= 20 for r in known.groupBy("lang").count().collect())
    got = langid.with_language(df.withColumnRenamed("lang", "was"), df, fit_texts=100, fit_langs=2, fit_grams=40).collect()
    assert all(r.lang_pred == r.was for r in got if r.was != "zz") and len(got) == 503


def test_copies_do_not_enlarge_the_sample(spark):
    df = spark.createDataFrame([("en", f"text number {i % 20 if i > 40 else i}") for i in range(2000)], "lang STRING, text STRING")
    sample, _ = langid.fit_sample(df, "text", "lang", fit_texts=1000)
    assert sample.count() == 2000
    sample, _ = langid.fit_sample(df, "text", "lang", fit_texts=10)
    assert 1 <= sample.select("text").distinct().count() <= 25
