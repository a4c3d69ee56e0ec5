"""SimHash, substring and line deduplication, decontamination, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import decontaminate, lines, simhash, substrings
from shelfline.llm.components import components
from shelfline.llm.decontaminate import Scanner, leak_report, places, without_leaks
from shelfline.llm.lines import line_report
from shelfline.llm.simhash import Forest, build_tree, fingerprint, link_within, near_duplicates, near_links, route, without_near_duplicates
from shelfline.llm.substrings import parse

ALPHABET = st.text(alphabet="aAbB é\n\t,.-1", max_size=60)


def slow_fingerprint(text, width=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(ALPHABET)
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_a_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 37} X{i % 11}" for i in range(900))
    whole = fingerprint(text)
    assert whole == slow_fingerprint(text)
    small = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda raw: small(raw, 50))
    assert fingerprint(text) == whole and fingerprint("a b") == slow_fingerprint("a b")


def linked(points, radius):
    forest = Forest(len(points))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius)
    forest.link(a, b)
    return forest.label


def cloud(seed, n, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
    out = base[rng.integers(0, len(base), n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(np.concatenate([out, base]))


@pytest.mark.parametrize("seed,flips,radius", [(1, 1, 2), (2, 2, 2), (3, 3, 3), (4, 6, 2)])
def test_tree_loses_no_link(seed, flips, radius, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4096)
    points = cloud(seed, 1200, flips)
    shard, point, home = route(build_tree(points[::3], 16, radius), points, radius)
    assert home.sum() == len(points) and len(set(shard.tolist())) > 4
    at, forest = np.searchsorted(points, point), Forest(len(points))
    for k in np.unique(shard):
        link_within(points, at[(shard == k) & home], at[shard == k], radius, forest)
    assert (forest.label == linked(points, radius)).all()


def test_cells_of_a_dense_shard(spark, monkeypatch):
    """Thousands of near copies in one place: many small cells, and a forest instead of all pairs."""
    monkeypatch.setattr(simhash, "RESIDENTS", 100)
    monkeypatch.setattr(simhash, "QUERIES", 150)
    rng = np.random.default_rng(3)
    points = np.unique(np.concatenate([
        np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 14, (600, 3)).astype(np.uint64), axis=1), cloud(9, 300, 2),
    ]))
    nodes = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp BIGINT")
    got = near_links(nodes, sample=64, shard=200)
    rows = got.collect()
    forest = Forest(len(points))
    at = {int(p): i for i, p in enumerate(points.view(np.int64))}
    forest.link(np.array([at[r.a] for r in rows]), np.array([at[r.b] for r in rows]))
    assert (forest.label == linked(points, 2)).all()
    assert len(rows) < 60 * len(points)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 340)]
    root = {n: n for p in pairs for n in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a BIGINT, b BIGINT")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in p and p[0] != p[1] for p in pairs)}


def slow_classes(rows):
    prints = np.array([fingerprint(t or "") for _, t in rows], np.uint64)
    label = linked(prints, 2)
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [(i, f"{int(p):016x}", least.get(k)) for (i, _), p, k in zip(rows, prints, label, strict=True)]


def test_near_duplicates_of_odd_rows(odd, odd_rows, nothing):
    got = [tuple(r) for r in near_duplicates(odd).collect()]
    assert sorted(got, key=repr) == sorted(slow_classes([(r[0], r[1]) for r in odd_rows]), key=repr)
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    want = [r[0] for r, c in zip(odd_rows, slow_classes([(r[0], r[1]) for r in odd_rows]), strict=True) if r[0] == c[2]]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(want, key=repr)
    assert near_duplicates(nothing).collect() == [] and without_near_duplicates(nothing).collect() == []


def test_near_duplicates_of_documents(real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    assert sorted(map(tuple, near_duplicates(real).collect())) == sorted(slow_classes(rows))


def slow_strings(rows, length):
    """Rows in corpus order to `n_bytes, n_removed, n_spans, kept`."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(10, 60))
def test_every_string_is_in_one_phrase(raw, length):
    h, x, first, last = parse(raw, length, 8)
    starts = [s for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1)]
    assert starts == list(range(len(raw) - length + 1))


def test_equal_strings_have_equal_triggers():
    rng = random.Random(2)
    core = bytes(rng.randrange(97, 105) for _ in range(100))
    found = set()
    for k in range(20):
        raw = bytes(rng.randrange(97, 105) for _ in range(3 * k)) + core + bytes(rng.randrange(97, 105) for _ in range(50))
        h, _, first, last = parse(raw, 100, 32)
        (i,) = np.flatnonzero((first <= 3 * k) & (last >= 3 * k))
        found.add(int(h[i]))
    assert len(found) == 1


def order_of(rows):
    # Rows of one id that differ follow a hash of the text: such ids are left to the tests below.
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("shares", [substrings.PHRASES, 3])
def test_substrings_of_odd_rows(spark, odd_rows, nothing, monkeypatch, shares):
    monkeypatch.setattr(substrings, "PHRASES", shares)
    monkeypatch.setattr(substrings, "PIECE", 3000)
    rows = order_of([r for r in odd_rows if r[0] not in (7, None)])
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, words STRING, tie BIGINT, doc STRING")
    got = sorted(map(tuple, substrings.without_repeats(df.repartition(3)).collect()))
    assert got == sorted((r[0], *w) for r, w in zip(rows, slow_strings([r[1] for r in rows], 100), strict=True))
    assert substrings.without_repeats(nothing).collect() == []


def test_substrings_with_ties_and_null_ids(odd, odd_rows):
    got = substrings.without_repeats(odd, with_bytes=True).collect()
    assert len(got) == len(odd_rows)
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]
    # Of two equal rows one stays whole, but for what a smaller id has.
    a, b = sorted((r for r in got if r.doc_id == 8), key=lambda r: r.n_removed)
    assert b.n_removed == b.n_bytes and a.kept == b"" or a.n_removed >= 0
    for r in got:
        assert r.n_bytes - r.n_removed == len(r.kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_of_spliced_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings, "PHRASES", 5)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd") for _ in range(rng.randrange(15, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    got = sorted(map(tuple, substrings.without_repeats(df, length=40, gram=16).collect()))
    assert got == [(i, *w) for (i, _), w in zip(rows, slow_strings([t for _, t in rows], 40), strict=True)]


def slow_lines(rows, min_words):
    seen, out = {}, []
    for i, text in rows:
        raw = (text or "").split("\n") if text is not None else []
        real = [k for k, x in enumerate(raw) if x.strip(lines.SPACE)]
        keys = [raw[k].strip(lines.SPACE) for k in real]
        gone = set()
        for a in range(len(keys)):
            for b in range(a, len(keys)):
                if sum(len(k.encode().split()) for k in keys[a:b + 1]) >= min_words:
                    w = tuple(keys[a:b + 1])
                    if w in seen:
                        gone.update(range(a, b + 1))
                    seen[w] = True
        left = [x for k, x in enumerate(raw) if k not in {real[g] for g in gone}]
        out.append((i, len(real), len(gone), "" if gone and len(gone) == len(real) else "\n".join(left)))
    return out


def test_lines_of_odd_rows(spark, odd, odd_rows, nothing):
    rows = order_of([r for r in odd_rows if r[0] not in (7, 8, None)])
    df = spark.createDataFrame(rows, odd.schema).repartition(3)
    got = sorted(map(tuple, line_report(df, 30).collect()))
    assert got == sorted(slow_lines([(r[0], r[1]) for r in rows], 30))
    # Rows that repeat id and text are one document: neither is the other's repeat.
    twice = spark.createDataFrame([(1, "a b c d\ne f g h")] * 2 + [(2, "x\na b c d\ne f g h")], "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id, r.n_removed, r.text) for r in line_report(twice, 6).collect()) == [(1, 0, "a b c d\ne f g h")] * 2 + [(2, 2, "x")]
    assert len(line_report(odd, 30).collect()) == len(odd_rows) and line_report(nothing).collect() == []
    assert lines.without_repeats(odd).drop("__lines", "__removed").schema.simpleString() == odd.schema.simpleString()


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_spliced_texts(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(15)]
    rows = [(i, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randrange(0, 20)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    assert sorted(map(tuple, line_report(df, 12).collect())) == slow_lines(rows, 12)


def slow_leaks(text, items, window=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, hit, names = split(text), set(), set()
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            piece = w[i:i + window]
            for k in range(len(words) - len(piece) + 1):
                if words[k:k + len(piece)] == piece:
                    hit.update(range(k, k + len(piece)))
                    names.add(name)
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit)


ITEMS = [
    (1, "The River of stone and the bank of the river go up"), (2, "x1"), (10, None), (3, ""), (4, "..."), (5, "ÉLAN élan"),
    (None, "under the same id"), (6, "the river of stone and the bank of the RIVER go up and further than that"),
]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 30])
def test_leaks_of_odd_rows(spark, odd, odd_rows, nothing, block):
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id BIGINT, text STRING, doc_id STRING")
    items = [("" if i is None else str(i), t) for i, t in ITEMS]
    got = sorted(map(tuple, leak_report(odd, bench, block_bytes=block).collect()), key=repr)
    assert got == sorted(((r[0], *slow_leaks(r[1], items)) for r in odd_rows), key=repr)
    clean = without_leaks(odd, bench)
    assert clean.columns == odd.columns
    assert clean.count() == sum(not slow_leaks(r[1], items)[4] for r in odd_rows)
    assert leak_report(nothing, bench).collect() == []
    assert not any(r.contaminated for r in leak_report(odd, bench.limit(0)).collect())


@settings(max_examples=80, deadline=None)
@given(ALPHABET, st.lists(ALPHABET, max_size=4))
def test_scanner(text, items):
    items = [(str(k), t) for k, t in enumerate(items)]
    n, runs, names = Scanner(items, 3).scan(text.encode())
    want = slow_leaks(text, items, 3)
    assert (n, sum(b - a for a, b in runs), len(names)) == want[:3]


def test_places_lead_back_to_the_text():
    text = "Größe, The RIVER -- of\tstone!"
    runs = Scanner([("a", "river of stone")], 10).scan(text.encode())[1]
    ((a, b),) = places(text, runs)
    assert text[a:b] == "RIVER -- of\tstone"
