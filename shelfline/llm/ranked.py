"""Ranked lexical search: the best documents of each item, from a trie of documents.

Each document is its vector of the terms that items use, ordered by document frequency, rare terms first. Sorted by
these vectors, documents that begin alike share a path of a trie (an FP-tree), in which every node holds the
largest frequency of its term and the smallest length norm among the documents below. A term counts for more the
more often it occurs and the shorter the document, so both give an upper bound of what a document below a node can
score: its path so far plus all of the item's terms that may still come. The search goes down depth first, in
batches of branches, and leaves out branches whose bound is below the score of the last place.

Spark deals the sorted vectors into shards of bounded size, one trie each, and ranks the shards' best. Documents
are sorted once for all items of a block; a document's exact score comes from its own vector.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfline.llm.arrays import owners, raw_bytes, words
from shelfline.llm.decontaminate import FOLD
from shelfline.llm.encoding import byte_slices, filled
from shelfline.session import stage

BEST = 20
#: Bytes of item text whose terms make one trie; more items are searched for in further blocks.
BLOCK_BYTES = 8 << 20
#: Terms of the documents of one trie, bytes of text counted at once, and branches looked at in one step.
SHARD_TERMS, SLICE_BYTES, STEP = 2 << 20, 4 << 20, 8192
#: Length norms are rounded down to one of these many in bounds of what may still come.
LEVELS = 32
FOLDING = np.frombuffer(FOLD, np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lowered, and where each text's begin. No nulls."""
    data, at = raw_bytes(texts)
    folded = pa.py_buffer(FOLDING[data].tobytes())
    return words(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), folded]))


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term adds before its weight, for a document of norm `m`."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _added(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of each run of `values`, exact."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(size)])])


class Trie:
    """Documents of one shard. `terms` and `tf` are the vectors one after another, sorted; `at` where each begins.

    Equal vectors of equal norm are one entry. A branch is a run of nodes without a fork or an entry's end
    inside; nodes and branches are numbered in the order of the sorted vectors, parents first.
    """

    def __init__(self, terms: np.ndarray, tf: np.ndarray, at: np.ndarray, m: np.ndarray, n_terms: int):
        size = np.diff(at)
        spot = np.arange(len(terms)) - np.repeat(at[:-1], size)
        owner = owners(at)
        back = np.where(owner > 0, at[owner - 1] + spot, 0)
        shared = (owner > 0) & (spot < size[owner - 1])
        back = np.where(shared, back, 0)
        far = np.iinfo(np.int64).max
        def common(*columns: np.ndarray) -> np.ndarray:
            same = shared & reduce(np.logical_and, [c == c[back] for c in columns])
            return np.minimum(np.minimum.reduceat(np.where(same, far, spot), at[:-1]), size)
        # Rows equal to the one before belong to its entry.
        equal = (common(terms, tf) == size) & (size == np.concatenate([[-1], size[:-1]])) & (m == np.concatenate([[-1], m[:-1]]))
        equal[0] = False
        lcp = common(terms)
        self.first = np.flatnonzero(~equal)
        self.members = np.diff(np.append(self.first, len(size)))
        pick = _ranges(at[self.first], size[self.first])
        self.size, lcp, self.m = size[self.first], lcp[self.first], m[self.first]
        self.terms, self.tf = terms[pick], tf[pick]
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self._grow(lcp, n_terms)

    def _grow(self, lcp: np.ndarray, n_terms: int) -> None:
        path = np.zeros(int(self.size.max()), np.int64)
        node = np.empty(len(self.terms), np.int64)
        made = np.cumsum(self.size - lcp) - (self.size - lcp)
        for a, k, l, new in zip(self.at[:-1].tolist(), self.size.tolist(), lcp.tolist(), made.tolist(), strict=True):
            path[l:k] = np.arange(new, new + k - l)
            node[a:a + k] = path[:k]
        count = int(self.size.sum() - lcp.sum())
        spot = np.arange(len(node)) - np.repeat(self.at[:-1], self.size)
        fresh = spot >= np.repeat(lcp, self.size)
        self.node_term = self.terms[fresh]
        above = np.where(spot > 0, node[np.arange(len(node)) - 1], -1)
        parent = above[fresh]
        self.node_tf = np.zeros(count, np.int64)
        np.maximum.at(self.node_tf, node, self.tf)
        least = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(least, node, np.repeat(self.m, self.size))
        last = node[self.at[1:] - 1]
        forks = np.bincount(parent[parent >= 0], minlength=count)
        stops = np.zeros(count, bool)
        stops[last] = True
        head = (parent < 0) | (forks[parent] != 1) | stops[parent]
        branch = np.cumsum(head) - 1
        self.begin = np.flatnonzero(head)
        self.length = np.diff(np.append(self.begin, count))
        self.least = least[self.begin]
        up = np.where(parent[self.begin] >= 0, branch[parent[self.begin]], -1)
        self.children = np.argsort(up, kind="stable")
        n = len(self.begin)
        self.child_at = np.searchsorted(up[self.children], np.arange(-1, n + 1))
        ended = branch[last]
        self.ends = np.argsort(ended, kind="stable")
        self.end_at = np.searchsorted(ended[self.ends], np.arange(n + 1))
        # Norms rounded down to a scale, and the largest frequency of each term in the shard.
        low, high = int(self.least.min()), int(self.least.max())
        self.scale = np.unique(np.floor(np.geomspace(low, max(high, low), LEVELS)).astype(np.int64))
        self.scale[0] = low
        self.level = np.searchsorted(self.scale, self.least, side="right") - 1
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, self.terms, self.tf)

    def best(self, item: np.ndarray, weight: np.ndarray, dense: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the `k` best: score descending, then `order` of the row.

        `item` holds the item's terms in order, `weight` what each weighs, and `dense` the same weights by term.
        """
        potential = weight * gain(self.most[item], self.scale[:, None])
        potential = np.concatenate([np.cumsum(potential[:, ::-1], axis=1)[:, ::-1], np.zeros((len(self.scale), 1), np.int64)], axis=1)
        rows, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        roots = self.children[self.child_at[0]:self.child_at[1]]
        stack = [(roots[::-1], np.zeros(len(roots), np.int64))]
        while stack:
            at, sofar = stack.pop()
            if len(at) > STEP:
                stack.append((at[:-STEP], sofar[:-STEP]))
                at, sofar = at[-STEP:], sofar[-STEP:]
            coming = potential[self.level[at], np.searchsorted(item, self.node_term[self.begin[at]])]
            live = sofar + coming >= floor
            at, sofar = at[live], sofar[live]
            if not len(at):
                continue
            size = self.length[at]
            nodes = _ranges(self.begin[at], size)
            w = dense[self.node_term[nodes]]
            hit = np.flatnonzero(w)
            added = np.zeros(len(nodes), np.int64)
            added[hit] = w[hit] * gain(self.node_tf[nodes[hit]], np.repeat(self.least[at], size)[hit])
            sofar = sofar + _added(added, size)
            done = np.flatnonzero((sofar >= floor) & (self.end_at[at + 1] > self.end_at[at]))
            if len(done):
                lo = self.end_at[at[done]]
                entries = self.ends[_ranges(lo, self.end_at[at[done] + 1] - lo)]
                exact = self._scores(entries, dense)
                good = exact >= floor
                entries, exact = entries[good], exact[good]
                # Of equal entries the first `k` in `order` are enough; rows of an entry are in that order.
                n = np.minimum(self.members[entries], k)
                rows = np.concatenate([rows, _ranges(self.first[entries], n)])
                scores = np.concatenate([scores, np.repeat(exact, n)])
                if len(rows) >= k:
                    keep = np.lexsort((order[rows], -scores))[:k]
                    rows, scores = rows[keep], scores[keep]
                    floor = max(1, int(scores[-1]))
            more = self.child_at[at + 2] > self.child_at[at + 1]
            end = self.node_term[self.begin[at] + size - 1] + 1
            more &= sofar + potential[self.level[at], np.searchsorted(item, end)] >= floor
            if more.any():
                lo = self.child_at[at[more] + 1]
                n = self.child_at[at[more] + 2] - lo
                stack.append((self.children[_ranges(lo, n)][::-1], np.repeat(sofar[more], n)[::-1]))
        keep = np.lexsort((order[rows], -scores))[:k]
        return rows[keep], scores[keep]

    def _scores(self, entries: np.ndarray, dense: np.ndarray) -> np.ndarray:
        size = self.size[entries]
        spots = _ranges(self.at[entries], size)
        w = dense[self.terms[spots]]
        hit = np.flatnonzero(w)
        added = np.zeros(len(spots), np.int64)
        added[hit] = w[hit] * gain(self.tf[spots[hit]], np.repeat(self.m[entries], size)[hit])
        return _added(added, size)


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Items in blocks of about `most` bytes, fetched partition by partition."""
    block, size = [], 0
    for r in items.filter("t is not null").toLocalIterator():
        if size >= most:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t.encode())
    if block:
        yield block


def _vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """A written table `doc_id, n, codes, tfs`: terms in a text, and those of the vocabulary with their frequency."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for a, b in byte_slices(sizes, SLICE_BYTES):
                coded, at = terms_of(texts.slice(a, b - a))
                known = pc.fill_null(pc.index_in(coded.dictionary, value_set=held.value), -1).to_numpy()
                code = known[coded.indices.to_numpy()].astype(np.int64)
                mine = np.flatnonzero(code >= 0)
                pair, tf = np.unique(owners(at)[mine] * len(held.value) + code[mine], return_counts=True)
                ends = np.searchsorted(pair, np.arange(b - a + 1) * len(held.value)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % len(held.value), tf)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), *lists], ["doc_id", "n", "codes", "tfs"]
                )

    return stage(docs.mapInArrow(counted, f"doc_id {kind}, n bigint, codes array<int>, tfs array<int>"), "vectors")


def _block_hits(docs: DataFrame, block: list[tuple], id_type, k: int) -> DataFrame | None:
    """`item, item_id, doc_id, score` of the best documents of each shard for the items of one block."""
    spark = docs.sparkSession
    coded, at = terms_of(pa.array([t for _, t in block], pa.string()))
    vocabulary = coded.dictionary
    if not len(vocabulary):
        return None
    vectors = _vectors(docs, vocabulary)
    total = vectors.filter("n > 0").agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    if not total.N:
        return None
    # One row for each term of the block at most.
    counts = vectors.select(F.explode("codes").alias("code")).groupBy("code").count().collect()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counts:
        df[r["code"]] = r["count"]
    place = np.empty(len(df), np.int64)
    place[np.argsort(df, kind="stable")] = np.arange(len(df))
    weight = [math.floor(1000 * math.log((2 * total.N + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()]
    weight = np.array(weight, np.int64)
    items = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        often = Counter(c for c in coded.indices.to_numpy()[a:b].tolist() if df[c])
        code = np.array(sorted(often, key=lambda c: place[c]), np.int64)
        items.append((place[code], weight[code] * np.array([often[c] for c in code.tolist()], np.int64)))
    given = spark.sparkContext.broadcast((place, items, pa.array([i for i, _ in block], to_arrow_type(id_type))))
    kind, id_kind = docs.schema["doc_id"].dataType.simpleString(), id_type.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = given.value[0]
        for batch in batches:
            codes, tfs = batch.column(2), batch.column(3)
            owner = np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy())
            terms = rank[codes.flatten().to_numpy()]
            by = np.lexsort((terms, owner))
            ends = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy())]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[by].astype(np.int32))) for x in (terms, tfs.flatten().to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "m", "path", "tfs"])

    norm = F.expr(f"75L + ((25L * n * {total.N}L) div {total.L}L)")
    ready = vectors.filter("size(codes) > 0").select("doc_id", norm.alias("m"), "codes", "tfs")
    paths = ready.mapInArrow(placed, f"doc_id {kind}, m bigint, path array<int>, tfs array<int>")
    shards = max(spark.sparkContext.defaultParallelism, -(-int(df.sum()) // SHARD_TERMS))
    dealt = paths.repartitionByRange(shards, "path", "doc_id").sortWithinPartitions("path", "tfs", "m", "doc_id")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, items, names = given.value
        dense = np.zeros(len(place), np.int64)

        def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            ids, m, path, tfs = (c.chunk(0) for c in table.columns)
            at = np.concatenate([[0], np.cumsum(path.value_lengths().to_numpy(), dtype=np.int64)])
            trie = Trie(path.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), at, m.to_numpy(), len(place))
            order = np.empty(len(ids), np.int64)
            order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            item, row, score = [], [], []
            for number, (terms, weights) in enumerate(items):
                if not len(terms):
                    continue
                dense[terms] = weights
                rows, scores = trie.best(terms, weights, dense, order, k)
                dense[terms] = 0
                item.append(np.full(len(rows), number))
                row.append(rows)
                score.append(scores)
            item, row, score = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (item, row, score))
            return pa.RecordBatch.from_arrays(
                [pa.array(item), names.take(pa.array(item)), ids.take(pa.array(row)), pa.array(score)],
                ["item", "item_id", "doc_id", "score"],
            )

        held, size = [], 0
        for batch in batches:
            done = 0
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in range(len(lengths)):
                size += int(lengths[n])
                if size >= SHARD_TERMS:
                    held.append(batch.slice(done, n + 1 - done))
                    yield close(held)
                    held, size, done = [], 0, n + 1
            if done < batch.num_rows:
                held.append(batch.slice(done))
        if held:
            yield close(held)

    return dealt.mapInArrow(searched, f"item bigint, item_id {id_kind}, doc_id {kind}, score bigint")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the `k` best documents of every item, equal scores by ascending `doc_id`.

    Null texts have no terms, and an item without terms that occur has no rows; rows of `docs` that repeat an id are
    documents of their own, a null id comes before others; rows of `items` that repeat an id are ranked one by
    one; empty tables give an empty result; other columns are not read. Each block of items reads the documents again.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    id_type = asked.schema["i"].dataType
    found = []
    for number, block in enumerate(_blocks(asked, block_bytes)):
        hits = _block_hits(chosen, block, id_type, k)
        if hits is not None:
            found.append(hits.withColumn("block", F.lit(number)))
    if not found:
        kind = chosen.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id {kind}, score bigint")
    best = Window.partitionBy("block", "item").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY doc_id, term),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM size),
norm AS (SELECT doc_id, 75 + (25 * n * docs) // len AS m FROM size, total),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""
