"""SimHash near-duplicates: fingerprints in a vantage-point tree, exact within a Hamming radius.

The top of the tree is built on a bounded sample of fingerprints and splits all of them into shards: at each
vantage point those within the median distance go left, the others right. A pair within `radius` on both
sides of a split has its left end within `radius` of the boundary, by the triangle inequality; only such ends
visit the right side too, as queries. Every pair is thus met in exactly the shard its right end lives in.
Shards are searched by the same splitting in memory, down to blocks that are compared bit by bit.

A shard of any size is dealt into cells of bounded numbers of residents and queries. A cell does not return
its pairs but a forest that connects the same fingerprints, so a group of n near copies gives n links.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.components import components
from shelfline.llm.encoding import filled
from shelfline.llm.frames import add_columns, sheltered
from shelfline.session import scratch, stage

WIDTH, RADIUS, SEED = 3, 2, 42
#: The tree's sample, and fingerprints a shard should have; a tree has at most SAMPLE / 16 shards.
SAMPLE, SHARD = 16_384, 8_192
RESIDENTS, QUERIES = 8_192, 65_536
BLOCK = 1 << 20
TEXT_BLOCK = 4 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(raw: bytes, size: int = TEXT_BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in blocks of about `size` bytes."""
    at = 0
    while at < len(raw):
        cut = SPACE.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The bits set in over half the XXH64 of a text's word shingles; 0 if it has no word."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text.encode().lower()):
        words = held + words
        if len(words) >= width:
            parts = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
            h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(words) - width + 1)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        held = words[-(width - 1):] if width > 1 else []
    if not total and held:
        return bits_over_half(np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64))
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def bits_over_half(h: np.ndarray) -> int:
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """`docs` with `__fp`, the 64 bits of the fingerprint as a signed number. A null text has no words."""
    at = docs.columns.index(text)

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [fingerprint(t.as_py(), width) for t in filled(batch.column(at))]
        return [pa.array(np.array(made, np.uint64).view(np.int64))]

    return add_columns(docs, kernel, "__fp bigint")


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def build_tree(sample: np.ndarray, shards: int, radius: int = RADIUS) -> list[tuple[int, int, int, int]]:
    """Nodes `(vantage, bound, left, right)`; a negative child -k - 1 is shard k. Empty for one shard."""
    nodes: list[tuple[int, int, int, int]] = []
    made = 0

    def split(points: np.ndarray, shards: int) -> int:
        nonlocal made
        best = None
        if shards > 1 and len(points) >= 32:
            for v in points[:: max(1, len(points) // 8)][:8]:
                d = distances(points, v)
                m = int(np.median(d))
                inside = d <= m
                if inside.all():
                    m -= 1
                    inside = d <= m
                if inside.any() and not inside.all():
                    # Prefer vantage points with few points near the boundary and even halves.
                    cost = ((d > m - radius) & inside).mean() + abs(inside.mean() - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, v, m, inside)
        if best is None:
            made += 1
            return -made
        _, v, m, inside = best
        k = len(nodes)
        nodes.append((0, 0, 0, 0))
        left = split(points[inside], shards // 2)
        right = split(points[~inside], shards - shards // 2)
        nodes[k] = (int(v), m, left, right)
        return k

    split(sample, shards)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`shard, point, resident` of all places a point goes to: the shard it lives in, and those it visits."""
    out: list[tuple[int, np.ndarray, bool]] = []

    def down(k: int, home: np.ndarray, visit: np.ndarray) -> None:
        if not len(home) and not len(visit):
            return
        if k < 0:
            out.append((-k - 1, home, True))
            out.append((-k - 1, visit, False))
            return
        vantage, m, left, right = nodes[k]
        d, e = distances(points[home], np.uint64(vantage)), distances(points[visit], np.uint64(vantage))
        down(left, home[d <= m], visit[e - radius <= m])
        down(right, home[d > m], np.concatenate([visit[e + radius > m], home[(d <= m) & (d + radius > m)]]))

    down(0 if nodes else -1, np.arange(len(points)), np.zeros(0, np.int64))
    shard = np.concatenate([np.full(len(x), s, np.int32) for s, x, _ in out])
    home = np.concatenate([np.full(len(x), h, bool) for _, x, h in out])
    return shard, points[np.concatenate([x for _, x, _ in out])], home


class Forest:
    """Labels of points by the smallest point they are linked with."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def link_within(points: np.ndarray, base: np.ndarray, query: np.ndarray, radius: int, forest: Forest) -> None:
    """Link each of `query` with all of `base` within `radius` (both indices of `points`), by vantage points."""
    todo = [(base, query)]
    while todo:
        base, query = todo.pop()
        if not len(base) or not len(query):
            continue
        work = len(base) * len(query)
        if work > BLOCK:
            v = points[base[len(base) // 2]]
            d, e = distances(points[base], v), distances(points[query], v)
            m = int(np.median(d))
            m -= int((d <= m).all())
            near, far = (base[d <= m], query[e - radius <= m]), (base[d > m], query[e + radius > m])
            if len(near[0]) * len(near[1]) + len(far[0]) * len(far[1]) < 0.9 * work:
                todo += [near, far]
                continue
        step = max(1, BLOCK // len(base))
        for i in range(0, len(query), step):
            some = query[i:i + step]
            close = np.bitwise_count(points[some][:, None] ^ points[base][None, :]) <= radius
            q, b = np.nonzero(close)
            forest.link(some[q], base[b])


def near_links(nodes: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """`a, b`: a forest over the different fingerprints `fp` of `nodes` that connects those within `radius`."""
    some = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64)
    shards = min(sample // 16, max(1, nodes.count() // shard))
    tree = build_tree(some.view(np.uint64), shards, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, fp, home = route(tree, batch.column(0).to_numpy().view(np.uint64), radius)
            for i in range(0, len(fp), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(where[cut]), pa.array(fp[cut].view(np.int64)), pa.array(home[cut])], ["shard", "fp", "home"])

    dealt = nodes.select("fp").mapInArrow(deal, "shard int, fp bigint, home boolean")
    dealt = stage(dealt, "shards")
    # One row for each shard, of which there are at most `sample / 16`.
    size = dealt.groupBy("shard").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / RESIDENTS).alias("rows"), F.ceil(F.count("*") / QUERIES).alias("cols")
    ).filter("rows > 0")
    placed = dealt.join(F.broadcast(size), "shard")
    own = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    base = placed.filter("home").select("shard", own(F.col("rows"), 1).alias("i"), upto(F.col("cols")).alias("j"), "fp", F.lit(True).alias("base"))
    query = placed.select("shard", upto(F.col("rows")).alias("i"), own(F.col("cols"), 2).alias("j"), "fp", F.lit(False).alias("base"))

    def search(cell: pa.Table) -> pa.Table:
        fp = cell.column("fp").to_numpy().view(np.uint64)
        base = cell.column("base").to_numpy()
        points, place = np.unique(fp, return_inverse=True)
        forest = Forest(len(points))
        link_within(points, place[base], place[~base], radius, forest)
        inner = np.flatnonzero(forest.label != np.arange(len(points)))
        return pa.table({"a": points[inner].view(np.int64), "b": points[forest.label[inner]].view(np.int64)})

    return base.unionByName(query).groupBy("shard", "i", "j").applyInArrow(search, "a bigint, b bigint")


def classes(prints: DataFrame, radius: int = RADIUS, joined: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`fp, component_id` of the different fingerprints of `prints` (`doc_id, fp`), as a written table: the
    smallest id that a chain of fingerprints within `radius` of each other leads to.

    `joined` may tell from `fp, root` which roots are one (`node, root`).
    """
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    linked = components(near_links(nodes, radius))
    rooted = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    if joined:
        more = joined(rooted.select("fp", "root")).select("node", F.col("root").alias("to"))
        more = rooted.join(more, F.col("root") == F.col("node"), "left")
        rooted = stage(more.select("fp", "least", F.coalesce("to", "root").alias("root")), "rooted")
    # Written first: then a component of a third of all fingerprints can be split in the join.
    lowest = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    return stage(rooted.join(lowest, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`doc_id, fingerprint, component_id` of every row.

    Null, empty and blank texts have fingerprint 0, and are linked like any other. Rows that repeat an id have a
    fingerprint each. Null ids get a component's smallest id, which is null only if no row in it has one. An
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stage(with_fingerprint(rows, width=width).select("doc_id", F.col("__fp").alias("fp")), "prints")
    found = prints.join(classes(prints, radius), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(
    docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id",
    joined: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows of `docs` with the smallest id of their component, with their own columns, whatever they are called.

    Rows that repeat that id and are near each other all stay; a component without ids stays whole. `joined` may tell
    which components are one, from the texts (`text`) and the component of each (`version`, its hash, and `root`).
    """

    def fewer(own: DataFrame, name: dict[str, str]) -> DataFrame:
        named = with_fingerprint(own, name[text], width)
        version = F.xxhash64(name[text]).alias("version")

        def merged(rooted: DataFrame) -> DataFrame:
            roots = prints.select("fp", "version").distinct().join(rooted, "fp").select("version", "root")
            return joined(own.select(F.col(name[text]).alias("text")), roots)

        with scratch(docs.sparkSession) as keep:
            prints = stage(named.select(F.col(name[doc_id]).alias("doc_id"), F.col("__fp").alias("fp"), version), "prints")
            found = classes(prints, radius, merged if joined else None)
            found = found.select(F.col("fp").alias("__class_fp"), F.col("component_id").alias("__component"))
            # Only numbers find out which rows go; the rows themselves meet the list of ids once.
            gone = prints.join(found, F.col("fp") == F.col("__class_fp")).filter(~F.col("doc_id").eqNullSafe(F.col("__component")))
            gone = keep(gone.select(F.col("doc_id").alias("__gone"), F.col("fp").alias("__gone_fp")).distinct(), "gone")
        same = F.col(name[doc_id]).eqNullSafe(F.col("__gone")) & (F.col("__fp") == F.col("__gone_fp"))
        return named.join(gone, same, "left_anti")

    return sheltered(docs, fewer)
