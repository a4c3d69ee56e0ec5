"""Repeated runs of lines are cut to their last line, against brute force."""

import random

import pytest

import corpus_pipeline
from shelfline.llm.lines import without_repeats


def slow_cut(rows, min_words):
    """Every run of at least `min_words` words that also starts earlier goes, whatever its length."""
    seen, out = set(), []
    for i, text in rows:
        keys = [x for x in text.split("\n") if x]
        gone = set()
        for a in range(len(keys)):
            for b in range(a + 1, len(keys) + 1):
                if sum(len(k.split()) for k in keys[a:b]) >= min_words:
                    w = tuple(keys[a:b])
                    if w in seen:
                        gone.update(range(a, b))
                    seen.add(w)
        out.append((i, len(keys), len(gone), "\n".join(k for n, k in enumerate(keys) if n not in gone)))
    return out


def test_the_last_line_of_a_copy_goes(spark):
    long, short = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(10))
    rows = [(1, f"{long}\n{short}", 0), (2, f"{long}\n{short}", 0), (3, f"c\n{long}\n{short}\nd", 0), (4, short, 0)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_chars BIGINT")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "", 3: "c\nd", 4: short}


@pytest.mark.parametrize("seed", range(3))
def test_spliced_texts(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(15)]
    passage = pool[:7]
    rows = [(i, "\n".join([*rng.choices(pool, k=rng.randrange(0, 9)), *passage[rng.randrange(3):rng.randrange(3, 8)]])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    got = without_repeats(df, 12, whole=True).select("doc_id", "__lines", "__removed", "text")
    assert sorted(map(tuple, got.collect())) == slow_cut(rows, 12)
