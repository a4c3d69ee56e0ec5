import random

import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, words STRING, n BIGINT, key STRING"


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "River", "stone", "Élan", "bank", "x1", "go,", "up."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empties, ties, repeated rows, a long text, and columns with names in use inside."""
    rng = random.Random(5)
    long = "\n".join(sentence(rng, 60) for _ in range(300))
    shared = sentence(rng, 70)
    texts = [
        (1, "One two three four"), (2, None), (3, ""), (4, " \n\t \n"), (5, long), (6, shared + "\nand then a tail of its own"),
        (7, "a head of its own\n" + shared), (7, "another text under the same id, with a few more words in it"), (8, shared), (8, shared),
        (None, "text without an id"), (None, None), (9, "<|endoftext|> Ünïcode gap   and 'quotes' 42 ###"), (10, long),
        (-3, "aaaa" * 200), (11, "aaaa" * 120), (12, long[:5000] + " changed " + long[5000:]),
    ]
    out = []
    for k, (i, t) in enumerate(texts):
        lang = [None, "en", "fr"][k % 3]
        out.append((i, t, lang, [None, "s1", "s2"][k % 3], len(t) if t else None, "w", k, "k"))
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    from pathlib import Path

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("driver tables not there")
    return spark.read.parquet(str(d / "documents.parquet"))


def multiset(rows):
    return sorted(map(repr, rows))
