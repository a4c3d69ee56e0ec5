"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import ranked
from shelfline.llm.ranked import Trie, ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    vectors = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [v for v in vectors if v[1]]
    n, length = len(held), sum(sum(v.values()) for _, v in held)
    df = Counter(t for _, v in held for t in v)
    out = []
    for item, text in items:
        scores = []
        for doc, v in held:
            m = 75 + (25 * sum(v.values()) * n) // length
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * v[t]) // (1000 * v[t] + 12 * m))
                for t in plain_terms(text) if v[t]
            )
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, doc))
        scores.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(scores[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


WORDS = ["the", "of", "River", "STONE", "Élan", "élan", "x1", "go", "Ünï", "bank", "a", "b", "c", "d", "rare", "日本", "r2", "q7"]


def some_text(rng, n):
    return "".join(rng.choice(WORDS[:rng.randint(1, len(WORDS))]) + rng.choice([" ", ", ", "\n", "_", "-", "."]) for _ in range(n))


@pytest.mark.parametrize("seed,shard,step", [(1, 1 << 20, 8192), (2, 60, 3), (3, 500, 7)])
def test_same_as_scoring_all(spark, monkeypatch, seed, shard, step):
    monkeypatch.setattr(ranked, "SHARD_TERMS", shard)
    monkeypatch.setattr(ranked, "STEP", step)
    rng = random.Random(seed)
    docs = [(i, some_text(rng, rng.choice([0, 1, 3, 20, 200]))) for i in range(150)]
    docs += [(1000 - i, docs[7][1]) for i in range(60)] + [(None, "rare bank"), (3, "rare"), (3, "rare"), (4, None), (5, " ,. ")]
    items = [(i, some_text(rng, rng.choice([1, 4, 30]))) for i in range(25)] + [(7, "rare rare q7"), (None, "the"), (8, None), (9, "..."), (10, "unseen")]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id BIGINT, text STRING, path STRING").repartition(4)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id BIGINT, text STRING, score INT")
    want = brute(docs, items)
    assert rows(ranked_search(d, b)) == want
    assert rows(ranked_search(d, b, block_bytes=40)) == want


def test_string_ids(spark):
    docs = [("b", "x y"), ("a", "x y"), ("c", "x")]
    d = spark.createDataFrame(docs, "doc_id STRING, text STRING")
    b = spark.createDataFrame([("i", "Y x")], "item_id STRING, text STRING")
    got = [(r.rank, r.doc_id) for r in ranked_search(d, b).orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_empty_tables(spark, nothing):
    b = spark.createDataFrame([(1, "x")], "item_id BIGINT, text STRING")
    assert ranked_search(nothing, b).count() == 0
    assert ranked_search(spark.createDataFrame([(1, "x")], "doc_id BIGINT, text STRING"), b.limit(0)).count() == 0


def test_odd_rows(spark, odd, odd_rows):
    items = [(1, "the river bank"), (2, "tail of its own"), (3, "aaaa")]
    b = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    assert rows(ranked_search(odd, b)) == brute([(r[0], r[1]) for r in odd_rows], items)


def test_terms():
    texts = ["Ab_c É2;x", "", "日本 -Z9-", "\x7f\x00a"]
    got, at = terms_of(pa.array(texts))
    flat = got.to_pylist()
    assert [flat[a:b] for a, b in zip(at[:-1], at[1:])] == [plain_terms(t) for t in texts]


def test_bounds_leave_branches_out(monkeypatch):
    """A shard in which one document has the rare term: the search looks at few of the others."""
    n = 4000
    vectors = [[0, 5]] + [[2 + k % 3, 5] for k in range(n - 1)]
    vectors.sort()
    at = np.arange(0, 2 * n + 1, 2)
    trie = Trie(np.array(vectors).ravel(), np.ones(2 * n, np.int64), at, np.arange(100, 100 + n), 6)
    seen = []
    plain = Trie._scores
    monkeypatch.setattr(Trie, "_scores", lambda self, e, d: seen.append(len(e)) or plain(self, e, d))
    monkeypatch.setattr(ranked, "STEP", 1)
    item, weight = np.array([0, 5]), np.array([900, 1])
    dense = np.zeros(6, np.int64)
    dense[item] = weight
    rows, scores = trie.best(item, weight, dense, np.arange(n), 1)
    assert rows.tolist() == [0] and sum(seen) < 10
