"""Near copies beyond the radius of the fingerprints, against brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from shelfline.llm import similar
from shelfline.llm.simhash import fingerprint
from shelfline.session import fresh_path, stage


def slow_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    return frozenset(parts)


def slow_kept(rows):
    """Ids that stay: the smallest of each group that two bits or a similarity of 0.8 connect."""
    sets, prints = [slow_set(t) for _, t in rows], [fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i for k, (i, _) in enumerate(rows) if i == least.get(root(k))), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return words


def kept(spark, df):
    return sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()), key=repr)


def test_near_copies_beyond_two_bits_go(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 5))), (3, " ".join(edited(rng, words, 60)))]
    assert (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])).bit_count() > 2
    assert kept(spark, spark.createDataFrame(rows, "doc_id BIGINT, text STRING")) == [1, 3] == slow_kept(rows)


@pytest.mark.parametrize("first,common", [(1, 1 << 17), (3, 0)])
def test_pairs_around_the_bound(spark, monkeypatch, first, common):
    monkeypatch.setattr(similar, "FIRST", first)
    monkeypatch.setattr(similar, "COMMON", common)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    texts = []
    for k in range(12):
        base = [f"w{k}x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(40, 300))]
        texts += [edited(rng, base, rng.randrange(0, len(base) // 20)) for _ in range(6)]
    for k in range(25):
        # One passage in unlike texts: candidates that are no pairs, and chains of texts that are.
        texts.append([*passage, *(f"q{k}x{i}" for i in range(rng.randrange(2, 40)))])
    # One set in texts that repeat other parts of it.
    loop = [f"r{i}" for i in range(30)]
    texts += [loop * 2, loop * 3 + loop[:7], [*loop, *loop[:9]], ["a", "b"], ["A", "b"], ["a", "b", "c"], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert kept(spark, spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)) == slow_kept(rows)


def test_whole_sets_of_candidates_only(spark, monkeypatch):
    """Unlike texts that share a short passage are told apart before their sets are written, long ones before sets are joined."""
    written = {}

    def counted(df, label, *more):
        done = stage(df, label, *more)
        written[label] = written.get(label, 0) + done.count()
        return done

    monkeypatch.setattr(similar, "stage", counted)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(7)]
    texts = [[*passage, *(f"u{k}x{i}" for i in range(200))] for k in range(30)]
    texts += [[*(f"p{i}" for i in range(100)), *(f"v{k}x{i}" for i in range(4000))] for k in range(4)]
    base = [f"w{i}" for i in range(300)]
    texts += [base, edited(rng, base, 5)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = kept(spark, spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert got == slow_kept(rows) and sorted(got) == list(range(35))
    assert 2 <= written["similar-items"] <= 6
    assert written["similar-close"] == 1


def test_sets_of_close_pairs_only(spark, monkeypatch):
    """However many long unlike texts share a passage, only sets of near copies are written and moved."""
    written = {}

    def counted(df, label, *more):
        done = stage(df, label, *more)
        written.setdefault(label, []).append(done.count())
        return done

    monkeypatch.setattr(similar, "stage", counted)
    rng = random.Random(7)
    texts = [[*(f"p{i}" for i in range(100)), *(f"v{k}x{i}" for i in range(2000))] for k in range(8)]
    base = [f"w{i}" for i in range(300)]
    texts += [base, edited(rng, base, 5)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = kept(spark, spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert got == slow_kept(rows) == list(range(9))
    assert sum(written["similar-items"]) == 2
    assert sum(written["similar-fine"]) > 8
    # Most shingles of the passage have the same carriers, and so have those of the near copies: one of each is enough.
    assert written["similar-places"][0] <= 3 * 10


def test_first_shared_shingles_stay(spark):
    rng = random.Random(11)
    sets = [[(s, t) for t in sorted(rng.sample(range(60), rng.randrange(1, 25)))] for s in range(30)]
    sets += [[(s, t) for t in range(100, 160)] for s in (100, 101, 102)]
    rows = [(t, s, pos) for held in sets for pos, (s, t) in enumerate(held)]
    got = similar.first_shared(spark.createDataFrame(rows, "token BIGINT, sig BIGINT, pos INT").repartition(3)).collect()
    left = {r.token for r in got}
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] in left)
    for a in sets:
        for b in sets:
            both = {t for _, t in a} & {t for _, t in b}
            assert a is b or not both or min(both) in left
    assert len([t for t in left if t >= 100]) == 1


@pytest.mark.parametrize("spots", [1, 7, 1 << 20])
def test_asked_rows(spark, monkeypatch, spots):
    monkeypatch.setattr(similar, "SPOTS", spots)
    rows = spark.createDataFrame([(v, f"t{v}") for v in [*range(-20, 20), 3, 4]], "version BIGINT, text STRING")
    asked = spark.createDataFrame([(10, 3), (11, -20), (12, 99)], "sig BIGINT, version BIGINT")
    got = similar.asked_rows(rows, asked).select("sig", "version", "text").collect()
    assert sorted(map(tuple, got)) == [(10, 3, "t3"), (11, -20, "t-20")]
    assert similar.asked_rows(rows, asked.limit(0)).collect() == []


def test_nothing_but_the_answer_stays(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i // 2, 100))) for i in range(12)]
    home = Path(fresh_path(spark, "x").removeprefix("file:")).parent
    before = set(home.iterdir())
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), "")
    assert [p.name.split("-")[0] for p in set(home.iterdir()) - before] == ["gone"]
    assert sorted(r.doc_id for r in got.collect()) == slow_kept(rows)


def test_fine_sketches_are_bounds():
    rng = np.random.default_rng(2)
    for n, shared, m in [(0, 0, 0), (3, 2, 9), (500, 450, 40), (2000, 0, 1700), (1000, 1000, 30)]:
        both = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (n, m))
        differ = len(np.setxor1d(a, b))
        found = similar.apart(similar.fine_sketch(a), similar.fine_sketch(b))
        assert found == similar.apart(similar.fine_sketch(b), similar.fine_sketch(a))
        assert found <= differ <= 2 * found


def test_odd_rows(spark, odd, odd_rows, nothing):
    got = corpus_pipeline.near_dedup(spark, odd, "")
    assert got.schema == odd.schema and corpus_pipeline.near_dedup(spark, nothing, "").collect() == []
    assert sorted((r.doc_id for r in got.collect()), key=repr) == slow_kept([(r[0], r[1]) for r in odd_rows])


def test_documents(spark, real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    assert kept(spark, real) == slow_kept(rows)
