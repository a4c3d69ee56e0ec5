"""Packing of token ids into sequences with controlled proportions of the sources.

Each source is a queue of its documents. Deficit round-robin gives every queue credit in proportion to its
target in each window and serves the queue that is furthest behind; what a queue is owed or was given too
much is carried on. Served in quanta of `quantum` ids, the quantum that starts at position x of a queue with
share p comes when the queue's credit reaches x, after x / p ids in all. The order of service is therefore the same as
the order by x / p, which needs no loop (tests compare it with queues served one quantum after another): no window is more than a quantum of each queue away from its targets, across
windows and partitions. A queue that runs out leaves its share to the others.

Only numbers are ordered: the ids stay in a written table, meet their cuts in one join, and are never sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.encoding import encoded, filled
from shelfline.llm.offsets import with_running_total
from shelfline.session import stage

WINDOW = 2048
QUANTUM = 256


def encode_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, text: str = "text", doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """A written table `row_key, doc_id, source, n_tokens, wide, ids` of every row's ids with the end id.

    `ids` holds 2 bytes for each id, or 4 where `wide`. A null text has the end id only. `row_key` tells rows
    with the same id apart.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, got, n in encoded(vocabulary, filled(batch.column(3))):
                closed = np.insert(got, np.cumsum(n), end_id)
                wide = bool(len(closed)) and int(closed.max()) > 0xFFFF
                raw = closed.astype("<u4" if wide else "<u2")
                at = np.concatenate([[0], np.cumsum(n + 1)]) * raw.itemsize
                held = pa.Array.from_buffers(
                    pa.binary(), b - a, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)]
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(n + 1), pa.array([wide] * (b - a)), held],
                    ["row_key", "doc_id", "source", "n_tokens", "wide", "ids"],
                )

    chosen = docs.select(
        F.monotonically_increasing_id().alias("row_key"), F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"), F.col(text).alias("text"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    return stage(
        chosen.mapInArrow(
            rows,
            f"row_key bigint, doc_id {kinds['doc_id']}, source {kinds['source']}, n_tokens bigint, wide boolean, ids binary",
        ),
        "ids",
    )


def schedule(
    queues: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM, temper: float = 1.0
) -> DataFrame:
    """`row_key, start, length, sequence_id, offset`: where each cut of each document goes.

    `queues` has `row_key, doc_id, source, n_tokens`, as a written table. `targets` are weights by source; a
    source without one, or every source without `targets`, weighs what it holds to the power of `temper`: below 1, small
    sources come more often than they would by size, until they run out. A source is served from its smallest `doc_id`.
    """
    if not 0 < quantum <= window:
        raise ValueError("a quantum must fit a window")
    placed = with_running_total(queues, "n_tokens", ["doc_id", "row_key"], ["source"], "at", "queues")
    held = queues.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    weight = F.pow(F.col("held").cast("double"), F.lit(temper))
    for name, value in (targets or {}).items():
        if value <= 0:
            raise ValueError("targets must be positive")
        weight = F.when(F.col("name") == name, F.lit(float(value))).otherwise(weight)
    # Written first: then a source of a third of all rows can be split in the join.
    shares = stage(held.withColumnRenamed("source", "name").select("name", weight.alias("weight")), "shares")
    served = placed.join(shares, F.col("source").eqNullSafe(F.col("name"))).select(
        "row_key", "doc_id", "source", "at", "n_tokens", "weight",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(quantum).cast("bigint"))).alias("start"),
    )
    served = served.select(
        ((F.col("at") + F.col("start")) / F.col("weight")).alias("turn"), "source", "doc_id", "row_key", "start",
        F.least(F.lit(quantum), F.col("n_tokens") - F.col("start")).cast("bigint").alias("length"),
    )
    laid = with_running_total(served, "length", ["turn", "source", "doc_id", "row_key", "start"], [], "at", "turns")
    room = window - F.col("at") % window
    halves = F.array(
        F.struct(F.col("start"), F.least("length", room).alias("length"), F.col("at").alias("at")),
        F.struct(
            (F.col("start") + room).alias("start"), (F.col("length") - room).alias("length"), (F.col("at") + room).alias("at")
        ),
    )
    cut = laid.select("row_key", F.explode(halves).alias("c")).select("row_key", "c.*").filter("length > 0")
    return cut.select(
        "row_key", "start", "length", F.floor(F.col("at") / F.lit(window)).alias("sequence_id"),
        (F.col("at") % window).alias("offset"),
    )


def pack(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, targets: dict[str, float] | None = None,
    window: int = WINDOW, quantum: int = QUANTUM, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id",
    source: str = "source", temper: float = 1.0,
) -> DataFrame:
    """`doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset` of every piece (and its `ids`).

    Every id lies in one piece, sequences are full but for the last, pieces that follow each other in the same
    document and sequence are one. Null texts give their end id; null sources are a queue of their own; rows
    that repeat an id are packed one by one; an empty table gives no pieces; other columns are not read.
    """
    held = encode_documents(docs, vocabulary, end_id, text, doc_id, source)
    cuts = schedule(held.select("row_key", "doc_id", "source", "n_tokens"), targets, window, quantum, temper)
    lists = cuts.groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts")
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat = lists.flatten()
            start, length, seq, off = (flat.field(i).to_numpy() for i in range(4))
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            new = np.ones(len(start), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (seq[1:] != seq[:-1]) | (off[1:] != off[:-1] + length[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            length = np.add.reduceat(length, first)
            owner, start, seq, off = owner[first], start[first], seq[first], off[first]
            crc, ids = [], []
            raw, at = None, -1
            for o, s, n in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True):
                if o != at:
                    raw, at = batch.column(3)[o].as_buffer(), o
                    raw = np.frombuffer(raw, "<u4" if batch.column(2)[o].as_py() else "<u2").astype("<u4")
                crc.append(zlib.crc32(raw[s:s + n]))
                if with_ids:
                    ids.append(raw[s:s + n].astype(np.int32))
            cols = [batch.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    batch.column(1).take(pa.array(owner)), pa.array(seq), pa.array(off)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.join(lists, "row_key").select("doc_id", "n_tokens", "wide", "ids", "cuts").mapInArrow(
        pieces,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
        + (", ids array<int>" if with_ids else ""),
    )
