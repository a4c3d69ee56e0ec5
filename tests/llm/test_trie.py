"""The trie of rebuilt conversations against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from shelfline.llm import trie
from shelfline.llm.trie import conversation_report, prefix_trie

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def key(turn):
    return (turn is not None, turn or 0)


def brute(rows, base, head):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((key(t), (r or "").encode(), (x or "").encode()))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, mine in own.items():
        h = head(c)
        whole = own.get(base(c), [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    out = []
    for path, held in members.items():
        under = [p for p in members if p[:len(path)] == path]
        leaf = [p for p in under if not any(q[:-1] == p and q for q in members)]
        saved = sum((len(members[p]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(held), len(path), min(members[path[:-1]]) if path else None, len(held),
                    sum(1 for p in under if len(p) == len(path) + 1), len(leaf), saved, digest))
    return sorted(out, key=repr)


def base20(c):
    return c - int(c - 20 * int(c / 20))


def crc(c):
    return zlib.crc32(str(c).encode()) % 4


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_turns(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, convs - 25), 1 << 40]:
        if c % 20 == 0 and rng.random() < 0.3:
            continue
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "user", None, "bot"]), rng.choice(["hi there", "a b  c", "", None, "x\x0by"])))
    rows += [rows[0]] * 3 + [(None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rebuilt_conversations(spark, seed):
    rows = odd_turns(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv STRING, depth INT").repartition(5)
    assert got(conversation_report(df)) == brute(rows, base20, crc)


def test_plain_trie_and_long_conversations(spark):
    rows = [(c, t, "u", f"{t % 7}") for c in (1, 2, 3) for t in range(300 + c)] + [(9, 0, "u", "0")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = {(r.conv_id, r.depth): r for r in prefix_trie(df).collect()}
    assert len(out) == 304 and out[1, 0].n_convs == 4 and out[1, 1].n_convs == 4 and out[1, 301].n_convs == 3
    assert out[1, 0].n_leaves == 1 and out[1, 0].saved_tokens == 3 + 2 * 300 + 1
    assert out[2, 302].parent_conv_id == 1 and out[3, 303].parent_conv_id == 2


def test_nothing(spark):
    assert got(conversation_report(spark.createDataFrame([], SCHEMA))) == []


def test_a_collision_starts_again(spark, monkeypatch):
    """Two primes so small that fingerprints collide at once: other bases, then the real primes, give the result."""
    rows = odd_turns(4, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    tries = []
    plain = trie._identity

    def narrow(seed):
        tries.append(seed)
        return [c % 2 if seed == 1 else c for c in plain(seed)] if seed > 1 else [
            (c % 2).alias(n) for c, n in zip(plain(seed), ("x0", "x1"))
        ]

    monkeypatch.setattr(trie, "_identity", narrow)
    assert got(conversation_report(df)) == brute(rows, base20, crc)
    assert max(tries) > 1


def test_digests_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "END_BITS", 2)
    rows = [(c, 0, "user", "same") for c in range(-30, 50)]
    assert got(conversation_report(spark.createDataFrame(rows, SCHEMA))) == brute(rows, base20, crc)
