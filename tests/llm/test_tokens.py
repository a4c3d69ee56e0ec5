"""Encoding, counts, wavelet shards and packing against the library and plain loops."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import encoding
from shelfline.llm.encoding import byte_slices, counted, encoded, encoder, split_text, vocabulary_path
from shelfline.llm.packing import encode_documents, pack
from shelfline.llm.token_counts import count_tokens
from shelfline.llm.wavelet import Shard, build, count_ids, documents_of, find_ids, read_shards, write_shards
from shelfline.session import fresh_path

VOCABULARY = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(VOCABULARY))


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(["áb C", "x\x1cy", "<|endoftext|>s", "it's we'll", " ", " a\n"]), max_size=6))
def test_words_give_the_ids_of_texts(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    ids, sizes = encoder(VOCABULARY).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want if texts else len(ids) == 0
    assert counted(VOCABULARY, pa.array(texts, pa.string())).tolist() == [len(w) for w in want]


def test_long_texts_are_cut_at_spaces(monkeypatch, library):
    monkeypatch.setattr(encoding, "BATCH_BYTES", 64)
    texts = pa.array(["word " * 100 + "Ende", "x" * 300, "short", "a\nb " * 90], pa.string())
    want = [plain(library, t) for t in texts.to_pylist()]
    assert counted(VOCABULARY, texts).tolist() == [len(w) for w in want]
    got = [ids.tolist() for a, b, all_ids, n in encoded(VOCABULARY, texts) for ids in np.split(all_ids, np.cumsum(n)[:-1])]
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBc1.,;!?' \n-éÉß\u0130\u00a0\u0301", max_size=20) | st.sampled_from(["U.S.A.", "it's.", "x1.5,y", "..a", "Ab:cD", "K<|endoftext|>Q."]), max_size=8))
def test_folding_keeps_ids(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path(VOCABULARY))
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    ids, sizes = encoder(VOCABULARY).encode(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_frequent_words_are_kept(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_WORDS", 40)
    enc = encoder(VOCABULARY)
    enc._clear()
    for k in range(12):
        enc.lengths(pa.array(["often seen words " + " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(12))]))
        assert {"often", "seen", "words"} <= set(enc.slot) and len(enc.slot) <= 40
    enc._clear()


def test_memo_stays_bounded(monkeypatch, library):
    monkeypatch.setattr(encoding, "MEMO_WORDS", 50)
    enc = encoder(VOCABULARY)
    for k in range(20):
        text = " ".join(f"w{k}q{j}" for j in range(30))
        assert enc.lengths(pa.array([text]))[0] == len(plain(library, text))
        assert len(enc.slot) <= 60
    enc._clear()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_encode_whole_texts(name):
    texts = ["  two  spaces", "", "<s> a </s>\n\nb"]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(vocabulary_path(name))
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    else:
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name)).encode(texts)
    assert counted(name, pa.array(texts)).tolist() == [len(w) for w in want]
    ids, _ = encoder(name).encode(pa.array(texts))
    assert ids.tolist() == [i for w in want for i in w]


def test_slices_and_parts():
    assert list(byte_slices(np.array([3, 3, 9, 1]), 6)) == [(0, 2), (2, 3), (3, 4)]
    assert list(byte_slices(np.array([], int), 6)) == []
    assert list(split_text("ab cd ef", 5)) == ["ab", "cd ef"] and list(split_text("abcdefgh", 3)) == ["abcdefgh"]


def test_counts_of_odd_rows(odd, odd_rows, nothing, library):
    got = sorted(map(tuple, count_tokens(odd, limit=10).collect()), key=repr)
    want = [(r[0], len((r[1] or "").encode()), len(plain(library, r[1])), len(plain(library, r[1])) > 10) for r in odd_rows]
    assert got == sorted(want, key=repr)
    assert count_tokens(nothing).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.data())
def test_wavelet_matrix(ids, data):
    x = np.array(ids, np.uint32)
    shard = Shard(build(x, np.array([len(x)]), pa.array([1])))
    assert shard.decode().tolist() == ids
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        v, j = ids[i], data.draw(st.integers(0, len(ids)))
        assert shard.access(i) == v and shard.rank(v, j) == ids[:j].count(v) and shard.count(v) == ids.count(v)
        places = [k for k, y in enumerate(ids) if y == v]
        assert [shard.select(v, k) for k in range(len(places))] == places
        with pytest.raises(IndexError):
            shard.select(v, len(places))
    assert shard.count(1 << 20) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9) | st.integers(0, 70_000), max_size=700))
def test_occurrences(ids):
    shard = Shard(build(np.array(ids, np.uint32), np.array([len(ids)]), pa.array([1])))
    for v in {*ids[:5], 3, 70_001, -1}:
        assert shard.occurrences(v).tolist() == [k for k, x in enumerate(ids) if x == v]


def test_ids_are_looked_up_in_shards(spark, odd, odd_rows, nothing, library):
    path = fresh_path(spark, "shards")
    write_shards(odd, path, shard_tokens=300)
    shards = read_shards(spark, path)
    texts = [(r[0], [*plain(library, r[1]), 2]) for r in odd_rows]
    wanted = [2, texts[0][1][0], texts[4][1][5], 40_000]
    want = sorted(((v, i, k) for i, ids in texts for v in set(wanted) for k, x in enumerate(ids) if x == v), key=repr)
    assert sorted(((r.id, r.doc_id, r.position) for r in find_ids(shards, wanted).collect()), key=repr) == want
    assert {r.id: r.n for r in count_ids(shards, [*wanted, 2]).collect()} == {v: sum(w[0] == v for w in want) for v in wanted}
    empty = fresh_path(spark, "shards")
    write_shards(nothing, empty)
    assert count_ids(read_shards(spark, empty), [2]).collect() == [] and find_ids(read_shards(spark, empty), [2]).collect() == []


def test_shards_of_odd_rows(spark, odd, odd_rows, nothing, library):
    path = fresh_path(spark, "shards")
    write_shards(odd, path, shard_tokens=500)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in documents_of(spark, path).collect())
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, []
    for r in order:
        ids = np.array([*plain(library, r[1]), 2], "<u4")
        want.append((at, r[0], len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    empty = fresh_path(spark, "shards")
    write_shards(nothing, empty)
    assert documents_of(spark, empty).collect() == []


@pytest.mark.parametrize("targets", [None, {"s1": 3.0, "s2": 1.0}])
def test_packing_of_odd_rows(odd, odd_rows, library, targets):
    rows = pack(odd, targets=targets, window=64, quantum=16, with_ids=True).collect()
    by_place = defaultdict(list)
    for r in rows:
        by_place[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert sorted(by_place) == list(range(len(by_place)))
    for k, pieces in by_place.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or k == max(by_place) and at <= 64
    # Pieces of an id put together are its rows' ids: rows of one id come apart by their first ids.
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, tuple(r.ids)) for r in rows)
    want_total = sum(len(plain(library, r[1])) + 1 for r in odd_rows)
    assert sum(len(g[3]) for g in got) == want_total
    for r in odd_rows:
        if sum(x[0] == r[0] for x in odd_rows) == 1:
            parts = sorted((x for x in rows if x.doc_id == r[0]), key=lambda x: x.start)
            assert [i for p in parts for i in p.ids] == [*plain(library, r[1]), 1]


def test_deficits_stay_within_a_quantum(spark, library):
    rows = [(i, "word " * (20 + 7 * (i % 9)), f"s{i % 3 if i % 5 else 0}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    held = {r.source: r.n for r in encode_documents(docs).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    source = {i: s for i, _, s in rows}
    total = sum(held.values())
    given_so_far = dict.fromkeys(held, 0)
    at = 0
    for r in sorted(pack(docs, window=64, quantum=16).collect(), key=lambda r: (r.sequence_id, r.offset)):
        given_so_far[source[r.doc_id]] += r.length
        at += r.length
        if at % 64 == 0:
            for s, n in given_so_far.items():
                assert abs(n - at * held[s] / total) <= 16 * len(held)


@pytest.mark.parametrize("targets,temper", [({"a": 5.0, "b": 1.0, "c": 2.0}, 1.0), (None, 0.5), (None, 1.0)])
def test_order_is_that_of_queues_served_in_turn(spark, library, targets, temper):
    """Deficit round-robin in plain Python: the queue whose credit covers its next quantum first is served, until all are empty."""
    rows = [(i, "word " * (5 + 11 * (i % 7)), "abc"[0 if i % 2 else i % 3]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").repartition(3)
    quantum, queues, at = 16, {}, {}
    for i, text, source in rows:
        n = len(plain(library, text)) + 1
        for start in range(0, n, quantum):
            queues.setdefault(source, []).append((i, start, min(quantum, n - start), at.get(source, 0) + start))
        at[source] = at.get(source, 0) + n
    weight = {s: (targets or {}).get(s) or n ** temper for s, n in at.items()}
    want, place = [], dict.fromkeys(queues, 0)
    while any(place[s] < len(q) for s, q in queues.items()):
        s = min((s for s in queues if place[s] < len(queues[s])), key=lambda s: (queues[s][place[s]][3] / weight[s], s))
        i, start, n, _ = queues[s][place[s]]
        place[s] += 1
        want += [(i, start + k) for k in range(n)]
    got = []
    for r in sorted(pack(docs, window=64, quantum=quantum, targets=targets, temper=temper).collect(), key=lambda r: (r.sequence_id, r.offset)):
        got += [(r.doc_id, r.start + k) for k in range(r.length)]
    assert got == want


def test_packing_nothing(nothing):
    assert pack(nothing).collect() == []
