"""Exact removal of long repeated byte strings by prefix-free parsing.

A rolling hash runs over each text. In every string of `length` bytes the place with the smallest hash is its
trigger, so equal strings have their trigger at the same place in them. Neighbouring strings mostly share a
trigger; together they make up a phrase, the bytes from the first of them to the end of the last. The
documents are parsed into phrases, each string lying in exactly one.

The parse is sorted by (trigger, phrase): an occurrence of a phrase that is not the first is repeated as a
whole, without looking at its bytes, and a trigger that is in one phrase only has no other repeats. What is
left are triggers with several different phrases, the dictionary. Its phrases' suffixes are sorted byte by byte:
strings of `length` bytes that are equal stand side by side, and all but the first in the corpus are repeats.
Both orders together say of each string in the corpus whether it starts earlier, too.

The text moves once, into a table bucketed by document; the parse and the dictionary are joined to it there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.arrays import mixed
from shelfline.llm.encoding import filled
from shelfline.session import fresh_path

LENGTH, GRAM = 100, 32
#: Bytes of a text parsed at once, and phrases whose suffixes are sorted at once.
PIECE, PHRASES = 4 << 20, 4_096
LOW = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15
LETTERS = mixed(np.arange(1, 257))


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on, put together from halves."""
    out, done, part, width = None, 0, LETTERS[raw], 1
    while size:
        if size & 1:
            if out is None:
                out, done = part, width
            else:
                n = len(raw) - done - width + 1
                out, done = out[:n] * np.uint64(pow(BASE, width, 1 << 64)) + part[done:done + n], done + width
        size >>= 1
        if size:
            n = len(part) - width
            part = part[:n] * np.uint64(pow(BASE, width, 1 << 64)) + part[width:]
            width *= 2
    return mixed(out)


def triggers(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`hash, first, last`: each trigger's hash and the first and last string that has it. At most 16 MB of bytes."""
    h = rolling(raw, gram)
    key = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    least, width, whole = key, 1, length - gram + 1
    while 2 * width <= whole:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    n = len(key) - whole + 1
    least = np.minimum(least[:n], least[whole - width:whole - width + n])
    at = (least & LOW).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cut])
    return h[at[first]], first, np.concatenate([cut - 1, [n - 1]])


def parse(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`trigger, phrase, first, last` of every phrase of a text: two hashes, and the strings it is made of."""
    data, out = np.frombuffer(raw, np.uint8), []
    for at in range(0, len(raw) - length + 1, PIECE):
        h, first, last = triggers(data[at:at + PIECE + length - 1], length, gram)
        first, last = first + at, last + at
        ids = [xxhash.xxh3_64_intdigest(raw[a:b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        out.append((h, np.array(ids, np.uint64), first, last))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_strings(phrases: list[bytes], first: np.ndarray, doc: np.ndarray, tie: np.ndarray, length: int):
    """Suffixes of the phrases in byte order: `phrase, start, rank, string` of every string of `length` bytes, where
    `rank` is 0 for the first occurrence of the string among the phrases, and `string` a hash of it."""
    sizes = np.array([len(p) for p in phrases])
    data = np.frombuffer(b"".join(phrases), np.uint8)
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    own = np.repeat(np.arange(len(phrases)), count)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[begin[own] + inner])
    strings = strings.view(f"V{length}").ravel()
    start = first[own] + inner
    # Strings in corpus order first: the sort by bytes then keeps that order among equal ones.
    corpus = np.lexsort((start, tie[own], doc[own]))
    order = corpus[np.argsort(strings[corpus], kind="stable")]
    same = strings[order][1:] == strings[order][:-1]
    new = np.concatenate([[True], ~same])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return own[order], start[order], rank, order, strings


def runs(start: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs covered by the strings `start..last`, each of `length` bytes: firsts and ends."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate([[True], a[1:] > b[:-1]]) if len(a) else np.zeros(0, bool)
    return a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])] if len(a) else a


def _bucketed(df: DataFrame, label: str, buckets: int) -> DataFrame:
    """`df`, dealt by `doc` already, written to the shared folder as a table of `buckets` by `doc`."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    name = "llm_" + path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(buckets, "doc").sortBy("doc").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _texts(docs: DataFrame, text: str, doc_id: str, buckets: int) -> DataFrame:
    """`doc, tie, doc_id, text`: `doc` is the id with null as the smallest number, `tie` numbers rows of one id."""
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).repartition(buckets, "doc")
    tie = F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"))) - 1
    return _bucketed(rows.withColumn("tie", tie), "texts", buckets)


def _parsed(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """`trigger, phrase, doc, tie, first, last`. Of equal phrases in a batch all but the first are known repeats:
    they leave without a phrase, runs of them as one row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for t in batch.column(2):
                found.append(parse(t.as_py().encode(), length, gram))
                sizes.append(len(found[-1][0]))
            h, x, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
            doc, tie = (np.repeat(batch.column(i).to_numpy().astype(np.int64), sizes) for i in (0, 1))
            order = np.lexsort((first, tie, doc, h, x))
            again = np.zeros(len(x), bool)
            again[order[1:]] = (x[order][1:] == x[order][:-1]) & (h[order][1:] == h[order][:-1])
            # A run of repeats is one row; phrases of a text follow one another.
            joins = again[1:] & again[:-1] & (np.diff(np.repeat(np.arange(len(sizes)), sizes)) == 0)
            head = np.concatenate([[True], ~joins]) if len(x) else np.zeros(0, bool)
            spots = np.flatnonzero(head)
            ends = last[np.concatenate([spots[1:] - 1, [len(x) - 1]])] if len(spots) else last
            h = np.where(again, mixed(doc.view(np.uint64) ^ (first.view(np.uint64) << np.uint64(40))), h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[spots].view(np.int64)), pa.array(x[spots].view(np.int64), mask=again[spots]), pa.array(doc[spots]),
                 pa.array(tie[spots].astype(np.int32)), pa.array(first[spots].astype(np.int32)), pa.array(ends.astype(np.int32))],
                ["trigger", "phrase", "doc", "tie", "first", "last"],
            )

    return texts.select("doc", "tie", "text").mapInArrow(
        rows, "trigger bigint, phrase bigint, doc bigint, tie int, first int, last int"
    )


def _marked(texts: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """`doc, spans`: for each document its repeated phrases (`phrases` 0), and first occurrences of phrases whose
    trigger has `phrases` different ones. Bucketed by document."""
    by = Window.partitionBy("trigger").orderBy("phrase", "doc", "tie", "first")
    whole = Window.partitionBy("trigger")
    before = F.lag("phrase").over(by)
    new = F.col("phrase").isNotNull() & (before.isNull() | (before != F.col("phrase")))
    rows = _parsed(texts, length, gram).withColumn("new", new)
    rows = rows.withColumn("phrases", F.sum(F.col("new").cast("int")).over(whole))
    rows = rows.filter(~F.col("new") | (F.col("phrases") > 1))
    span = F.struct(
        "tie", "first", "last", F.when(F.col("new"), F.col("phrases")).otherwise(F.lit(0)).alias("phrases"),
        F.when(F.col("new"), F.col("trigger")).alias("trigger"), F.when(F.col("new"), F.col("phrase")).alias("phrase"),
    )
    listed = rows.repartition(buckets, "doc").groupBy("doc").agg(F.collect_list(span).alias("spans"))
    return _bucketed(listed, "spans", buckets)


def _dictionary(texts: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """`trigger, share, open, doc, tie, first, body`: first occurrences of phrases, as bytes. A trigger of many
    phrases is dealt into shares of about `PHRASES`, and `open`."""
    spans = marked.select("doc", F.filter("spans", lambda s: s["phrases"] > 0).alias("spans")).filter(F.size("spans") > 0)
    one = texts.select("doc", "tie", "text").join(spans, "doc").select("doc", "tie", "text", F.explode("spans").alias("s"))
    one = one.filter(F.col("s.tie") == F.col("tie"))
    shares = F.ceil(F.col("s.phrases") / PHRASES)
    body = F.substring(F.col("text").cast("binary"), F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + length)
    return one.select(
        F.col("s.trigger").alias("trigger"), F.pmod(F.col("s.phrase"), shares).alias("share"), (shares > 1).alias("open"),
        "doc", "tie", F.col("s.first").alias("first"), body.alias("body"),
    )


def _resolved(dictionary: DataFrame, length: int) -> DataFrame:
    """`doc, tie, start`: strings of the dictionary that start earlier, too."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["string", "trigger", "doc", "tie", "start"]

        def done(table: pa.Table) -> pa.RecordBatch:
            cols = {c: table.column(c).to_numpy() for c in ("doc", "tie", "first", "trigger", "open")}
            own, start, rank, order, strings = repeated_strings(
                table.column("body").to_pylist(), cols["first"].astype(np.int64), cols["doc"], cols["tie"], length
            )
            # Repeats within a share are certain; the first of an open share may have an earlier one in another.
            out = (rank > 0) | cols["open"][own]
            own, start, rank, order = own[out], start[out], rank[out], order[out]
            ids = [xxhash.xxh3_64_intdigest(strings[k].tobytes()) - (1 << 63) if r == 0 else None for k, r in zip(order.tolist(), rank.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cols["trigger"][own]), pa.array(cols["doc"][own]), pa.array(cols["tie"][own]), pa.array(start)], names
            )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < PHRASES:
                continue
            table = pa.Table.from_batches(held)
            key = [table.column(c).to_numpy() for c in ("trigger", "share")]
            edge = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]))
            if len(edge):
                last = int(edge[-1]) + 1
                for a, b in _cuts(edge + 1, last):
                    yield done(table.slice(a, b - a))
                table = table.slice(last)
            held = table.combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield done(pa.Table.from_batches(held))

    rows = dictionary.repartition("trigger", "share").sortWithinPartitions("trigger", "share")
    found = rows.mapInArrow(sort, "string bigint, trigger bigint, doc bigint, tie int, start bigint")
    # Of a string in several shares, one place each is here: as many as shares at most.
    same = Window.partitionBy("trigger", "string", F.when(F.col("string").isNull(), F.struct("doc", "start"))).orderBy("doc", "tie", "start")
    return found.withColumn("k", F.row_number().over(same)).filter("string is null or k > 1").select("doc", "tie", "start")


def _cuts(edges: np.ndarray, last: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `PHRASES` rows up to `last`, cut at edges only."""
    a = 0
    for e in edges.tolist():
        if e - a >= PHRASES or e == last:
            yield a, e
            a = e


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", with_bytes: bool = False
) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` of every row (and the bytes `kept`).

    A byte goes if it is in a string of `length` bytes that also starts earlier: in a smaller id, or earlier in
    the same document. Ids are whole numbers; null is smaller than all. Rows that repeat an id come one after
    another by a hash of the text, so of two equal rows one stays. Null texts are empty; texts shorter than
    `length` stay; other columns are not read; an empty table gives an empty result.
    """
    if not 8 <= gram < length:
        raise ValueError("a trigger must be shorter than the strings")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, text, doc_id, buckets)
    marked = _marked(texts, length, gram, buckets)
    later = _resolved(_dictionary(texts, marked, length), length)
    later = later.groupBy("doc").agg(F.collect_list(F.struct("tie", "start")).alias("later"))
    whole = marked.select("doc", F.filter("spans", lambda s: s["phrases"] == 0).alias("spans"))
    paired = texts.join(whole, "doc", "left").join(later, "doc", "left").select("doc_id", "tie", "text", "spans", "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def starts(lists: pa.Array, k: int, tie: int, *names: str) -> list[np.ndarray]:
            flat = lists.slice(k, 1).flatten()
            mine = flat.field("tie").to_numpy() == tie
            return [flat.field(n).to_numpy().astype(np.int64)[mine] for n in names]

        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                raw, tie = batch.column(2)[k].as_py().encode(), batch.column(1)[k].as_py()
                first, last = starts(batch.column(3), k, tie, "first", "last")
                (single,) = starts(batch.column(4), k, tie, "start")
                a, b = runs(np.concatenate([first, single]), np.concatenate([last, single]), length)
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept))
            cols = [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                cols.append(pa.array([r[4] for r in rows], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = paired.schema["doc_id"].dataType.simpleString()
    return paired.mapInArrow(
        cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_bytes else "")
    )
