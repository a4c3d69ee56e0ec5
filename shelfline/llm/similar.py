"""Near copies by the Jaccard similarity of word shingles: no pair of texts at or above the bound is missed.

A text is the set of hashes of its runs of `width` words. Sets are ordered alike, common shingles last. Two sets
at or above the bound share a shingle among their first n - ceil(bound * n) + 1, and at the first one they share
the sizes of what follows bound the overlap. A set has a sketch as well, the parity of its numbers of shingles in
each of 512 bins: two sketches differ in at most as many bits as the sets differ in shingles, so unlike sets that
share a passage go before anything whole is moved. Pairs that pass all this are compared by sketches as fine as their
sets are large, made in the same pass; only what is left of them, near copies but for a few, is verified on whole sets.

What is asked for is groups, not pairs. In each round some sets of a shingle are compared with all others that
carry it, then leave it; sets known to be of one group are not compared again. So n near copies cost about n
comparisons. Rounds end when every shingle has one group left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.components import components
from shelfline.llm.encoding import filled
from shelfline.llm.frames import add_columns
from shelfline.llm.simhash import SEED, word_blocks
from shelfline.session import scratch, stage

#: The bound as a fraction, so that sizes are compared without rounding.
WIDTH, BOUND = 5, (4, 5)
#: Shingles whose place in the order is by their count; any order gives the same groups, this one fewer candidates.
COMMON, BUFFER = 1 << 17, 1 << 20
#: About how many sets each shingle compares with the others in the first round, and how they grow from round to round.
FIRST, GROWTH = 1, 4
BINS = 512
#: Rows that are not asked for are left out by so many hashes of their versions, broadcast, before any is shuffled.
SPOTS = 1 << 20
LANES = [f"s{k}" for k in range(BINS // 64)]


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The different XXH64 of a text's word shingles in rising order. Fewer words are one shingle; none are none."""
    out, held = [], []
    for words in word_blocks(text.encode().lower()):
        words = held + words
        if len(words) >= width:
            parts = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
            h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(words) - width + 1)
            out.append(np.unique(h))
            words = words[len(words) - width + 1:]
        held = words
    if not out:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)] if held else [], np.uint64)
    return np.unique(np.concatenate(out))


def prefix_size(n: int, bound: tuple[int, int] = BOUND) -> int:
    """How many first shingles of a set of `n` must hold one of any set at or above the bound."""
    num, den = bound
    return n - -(-num * n // den) + 1 if n else 0


def parity(x: np.ndarray, bins: int) -> np.ndarray:
    """The parity of the number of shingles in each of `bins` (a power of two, from 8), eight to a byte."""
    odd = np.bincount((x & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketch(x: np.ndarray) -> np.ndarray:
    """The parity in `BINS`, 64 bins to a signed number."""
    return parity(x, BINS).view(np.int64)


def fine_sketch(x: np.ndarray, each: int = 4) -> bytes:
    """The parity in at least `each` bins for each shingle: it tells long sets apart as well. With one bin each, sets
    that pass for 0.8 have a similarity of about 0.74 or more."""
    return parity(x, 1 << max(3, (each * len(x) - 1).bit_length())).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many bins two fine sketches differ, the one of more bins folded to as many as the other has."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def common_shingles(texts: DataFrame, width: int) -> dict[int, int]:
    """Up to `COMMON` shingles met several times in a task's buffer of texts, and how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            some = n >= 4
            return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["token", "n"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for t in filled(batch.column(0)):
                held.append(shingles(t.as_py(), width))
                size += len(held[-1])
                if size >= BUFFER:
                    yield flush()
                    held, size = [], 0
        yield flush()

    found = texts.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    return dict(zip(rows["token"].to_pylist(), rows["n"].to_pylist(), strict=True))


def with_sets(docs: DataFrame, width: int = WIDTH, bound: tuple[int, int] = BOUND) -> DataFrame:
    """`docs` (with `text`) with `version` (a hash of the text) instead of it, and `sig` (a hash of its set), `n` (its
    size), `tokens` (the first shingles of the set), `fine` (its fine sketch) and the sketch."""
    common = common_shingles(docs.select("text"), width)
    spark = docs.sparkSession
    keys = np.array(sorted(common), np.int64)
    held = spark.sparkContext.broadcast((keys, np.array([common[k] for k in keys.tolist()], np.int64)))
    rows = docs.withColumn("version", F.xxhash64("text"))
    at = rows.columns.index("text")

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        keys, counts = held.value
        sig, size, first, fine, lanes = [], [], [], [], []
        for t in filled(batch.column(at)):
            x = shingles(t.as_py(), width)
            sig.append(xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63))
            size.append(len(x))
            fine.append(fine_sketch(x, 1))
            lanes.append(sketch(x))
            x = x.view(np.int64)
            if len(keys):
                spot = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                x = x[np.argsort(np.where(keys[spot] == x, counts[spot], 0), kind="stable")]
            first.append(x[:prefix_size(len(x), bound)])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
        parity = np.array(lanes, np.int64).reshape(-1, len(LANES))
        made = [pa.array(sig, pa.int64()), pa.array(size, pa.int64()), lists, pa.array(fine, pa.binary())]
        return [*made, *(pa.array(parity[:, k]) for k in range(len(LANES)))]

    fields = "sig bigint, n bigint, tokens array<bigint>, fine binary, " + ", ".join(f"{s} bigint" for s in LANES)
    return add_columns(rows, kernel, fields, ("text",))


def first_shared(carried: DataFrame) -> DataFrame:
    """The rows of `carried` (`token, sig, pos`) without shingles that the same sets carry as an earlier one.

    Two sets are compared at the first shingle they share, and that is the first of all its own sets share. Which sets
    these are is told by their number, the ends and two sums of hashes.
    """
    by = carried.groupBy("token").agg(
        F.count("*").alias("all"), F.min("sig").alias("low"), F.max("sig").alias("high"), F.min_by("pos", "sig").alias("at"),
        F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y"),
    )
    first = by.groupBy("all", "low", "high", "x", "y").agg(F.min_by("token", "at").alias("token"))
    return carried.join(first.select("token"), "token", "left_semi")


def asked_rows(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of `rows` whose `version` is in `asked` (`sig, version`), with that `sig`, one for each version.

    However many are asked for, no more of `rows` is shuffled than these and some that share a hash with one of them.
    """
    spot = F.pmod("version", F.lit(SPOTS))
    spots = F.broadcast(asked.select(spot.alias("spot")).distinct())
    some = rows.withColumn("spot", spot).join(spots, "spot", "left_semi").drop("spot")
    return some.join(asked, "version").dropDuplicates(["version"])


def sets_of(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """`sig, version` of the sets in `pairs` (`a, b`), as a written table."""
    asked = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    return stage(asked.join(one.select("sig", "version"), "sig"), "similar-asked")


def whole_sets(asked: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """`sig, items`, the whole set of each of `asked` (`sig, version`), as a written table."""
    rows = asked_rows(texts.withColumn("version", F.xxhash64("text")), asked).select("sig", "text")

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([shingles(t.as_py(), width).view(np.int64) for t in filled(batch.column(1))], pa.list_(pa.int64()))]

    return stage(add_columns(rows, kernel, "items array<bigint>", ("text",)), "similar-items")


def close_pairs(pairs: DataFrame, fine: DataFrame, bound: tuple[int, int]) -> DataFrame:
    """The rows of `pairs` (`a, b, ra, rb`) whose fine sketches (`sig, n, fine`) allow the bound, as a written table."""
    num, den = bound
    of = lambda c: fine.select(F.col("sig").alias(c), F.col("n").alias(f"{c}_n"), F.col("fine").alias(f"{c}_fine"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    at, to = both.columns.index("a_fine"), both.columns.index("b_fine")

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(at), batch.column(to), strict=True)], pa.int64())]

    both = add_columns(both, kernel, "apart bigint", ("a_fine", "b_fine"))
    near = F.col("apart") * (num + den) <= (F.col("a_n") + F.col("b_n")) * (den - num)
    return stage(both.filter(near).select("a", "b", "ra", "rb"), "similar-close")


def similar_groups(texts: DataFrame, roots: DataFrame, width: int = WIDTH, bound: tuple[int, int] = BOUND) -> DataFrame:
    """`node, root`: which groups become one where texts of theirs are at or above the bound.

    `texts` has `text`, `roots` the group `root` of each `version`, a hash of the text. A group that stays as it is may
    be left out. Texts without words are in no pair.
    """
    num, den = bound
    spark = texts.sparkSession
    with scratch(spark) as keep:
        sets = stage(with_sets(texts.select("text"), width, bound).filter("n > 0"), "similar-texts")
        owned = stage(sets.select("sig", "version").distinct().join(roots, "version").select("sig", "root").distinct(), "similar-owned")
        first = owned.groupBy("sig").agg(F.min("root").alias("root"))
        # Texts of one set may have several fingerprints.
        both = owned.join(first.withColumnRenamed("root", "low"), "sig").filter("root <> low")
        links = keep(both.select(F.col("root").alias("a"), F.col("low").alias("b")), "similar-links")
        # Rows of one set are equal but for the version.
        one = sets.groupBy("sig").agg(F.min("version").alias("version"), *(F.first(c).alias(c) for c in ("n", *LANES)))
        one = keep(one.join(first, "sig"), "similar-sets")
        fines = keep(sets.select("version", "n", "fine"), "similar-fines")
        spread = sets.select("sig", F.posexplode("tokens").alias("pos", "token"))
        # One row for each shingle: the smallest and the greatest set that carry it tell whether there are two.
        again = spread.groupBy("token").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).filter("low <> high")
        again = stage(again.select("token"), "similar-again")
        shared = spread.join(again, "token", "left_semi").groupBy("token", "sig").agg(F.min("pos").alias("pos"))
        shared = keep(first_shared(stage(shared, "similar-carried")), "similar-shared")
    groups = components(links)
    active = shared.join(one.drop("version"), "sig")
    some, turn = FIRST, 0
    while True:
        moved = active.join(groups.select(F.col("node"), F.col("root").alias("to")), F.col("root") == F.col("node"), "left")
        moved = moved.withColumn("root", F.coalesce("to", "root")).drop("node", "to")
        active = stage(moved, "similar-places")
        # Shingles of one group are done with.
        tokens = active.groupBy("token").agg(
            F.min("sig").alias("least"), F.count("*").alias("all"), F.min("root").alias("low"), F.max("root").alias("high")
        ).filter("low <> high")
        chosen = (F.col("sig") == F.col("least")) | (F.pmod(F.xxhash64("sig", "token", F.lit(turn)), F.col("all")) < some)
        active = active.join(stage(tokens.select("token", "least", "all"), "similar-tokens"), "token")
        active = stage(active.withColumn("chosen", chosen).drop("least", "all"), "similar-open")
        if active.isEmpty():
            return groups
        picked = active.filter("chosen").drop("chosen")
        picked = picked.select("token", *(F.col(c).alias(f"p_{c}") for c in picked.columns if c != "token"))
        sizes, rest = F.col("n") + F.col("p_n"), F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos"))
        differ = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"p_{s}"))) for s in LANES), F.lit(0))
        # At the bound sets differ in (den - num) / (den + num) of their sizes together.
        may = (
            (F.col("root") != F.col("p_root")) & (~F.col("chosen") | (F.col("sig") > F.col("p_sig")))
            & (rest * (num + den) >= sizes * num) & (differ * (num + den) <= sizes * (den - num))
        )
        pairs = active.join(picked, "token").filter(may).select(
            F.least("sig", "p_sig").alias("a"), F.greatest("sig", "p_sig").alias("b"),
            F.when(F.col("sig") < F.col("p_sig"), F.col("root")).otherwise(F.col("p_root")).alias("ra"),
            F.when(F.col("sig") < F.col("p_sig"), F.col("p_root")).otherwise(F.col("root")).alias("rb"),
        )
        pairs = stage(pairs.distinct(), "similar-pairs")
        with scratch(spark) as keep:
            # Sketches of these pairs only, then whole sets of the few that these leave, for this round only.
            fine = stage(asked_rows(fines, sets_of(pairs, one)).select("sig", "n", "fine"), "similar-fine")
            pairs = close_pairs(pairs, fine, bound)
            items = whole_sets(sets_of(pairs, one), texts, width)
            left = pairs.join(items.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a")
            both = left.join(items.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b")
            both = both.select("ra", "rb", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("sum"))
            found = both.filter(F.col("k") * den >= (F.col("sum") - F.col("k")) * num).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            links = links.unionByName(keep(found.distinct(), "similar-found"))
        groups = components(links)
        active = active.filter(~F.col("chosen")).drop("chosen")
        some, turn = some * GROWTH, turn + 1
