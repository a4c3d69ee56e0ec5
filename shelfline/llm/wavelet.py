"""Token ids of a corpus as wavelet matrices: one per shard, with access, rank, select and counting.

A shard holds whole documents in ascending order. Its bytes are one file:

    "WVM1" | header length (4 bytes) | header (JSON) | directory (Arrow) | per bit, highest first:
    bits (8 to a byte) | ones before every 512 bits (4 bytes each)

The header gives the number of ids, documents and planes and the zeros of each plane. Each plane holds one
bit of every id; ids whose bit is 0 go before the others in the next plane. A position is followed from
plane to plane by counting ones, so one id, the number of times an id occurs before a position, or its
k-th occurrence is found by reading a few bytes of each plane.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.encoding import encoded, filled

MAGIC = b"WVM1"
BLOCK = 512
SHARD_TOKENS = 2 << 20


def build(ids: np.ndarray, ends: np.ndarray, docs: pa.Array) -> bytes:
    """The bytes of a shard: `ids` of all documents, where each document ends, and the documents' names."""
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length()) if n else 1
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, body = [], []
    for b in range(levels - 1, -1, -1):
        packed = np.packbits((x & x.dtype.type(1 << b)) != 0, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(ones)])
        zeros.append(n - int(before[-1]))
        body += [packed.tobytes(), before.astype("<u4").tobytes()]
        # The plane serves as Arrow's mask: zeros first, then ones, each in their order.
        one = pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(packed)])
        x = np.concatenate([pc.filter(pa.array(x), keep).to_numpy() for keep in (pc.invert(one), one)])
    sink = pa.BufferOutputStream()
    directory = pa.record_batch([docs, pa.array(ends, pa.int64())], ["doc", "end"])
    with pa.ipc.new_stream(sink, directory.schema) as w:
        w.write_batch(directory)
    listed = sink.getvalue().to_pybytes()
    head = json.dumps({"n": n, "docs": len(ends), "levels": levels, "zeros": zeros, "directory": len(listed)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, listed, *body])


class Shard:
    """A shard's bytes, read in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, 4)
        head = json.loads(data[8:8 + size])
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        at = 8 + size
        with pa.ipc.open_stream(pa.py_buffer(data).slice(at, head["directory"])) as r:
            listed = r.read_all()
        self.docs = listed.column("doc").combine_chunks()
        self.ends = listed.column("end").to_numpy()
        at += head["directory"]
        blocks = -(-self.n // BLOCK)
        self.planes = []
        for _ in range(self.levels):
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
            at += bits.nbytes
            before = np.frombuffer(data, "<u4", blocks + 1, at)
            at += before.nbytes
            self.planes.append((bits, before))

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first `i` bits of a plane."""
        bits, before = self.planes[level]
        block, first = i // BLOCK, i // BLOCK * (BLOCK // 8)
        got = int(before[block]) + int(np.bitwise_count(bits[first:i // 8]).sum())
        return got + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else got

    def _find(self, level: int, one: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        bits, before = self.planes[level]
        counts = before if one else np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(counts, k, side="right")) - 1
        piece = np.unpackbits(bits[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(piece == one)[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bits, _ = self.planes[level]
            ones = self._ones(level, i)
            if bits[i // 8] >> (i % 8) & 1:
                value, i = value << 1 | 1, self.zeros[level] + ones
            else:
                value, i = value << 1, i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of `value` among the first `i` ids stand below the last plane."""
        a, b = 0, i
        for level in range(self.levels):
            ones_a, ones_b = self._ones(level, a), self._ones(level, b)
            if value >> (self.levels - 1 - level) & 1:
                a, b = self.zeros[level] + ones_a, self.zeros[level] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def rank(self, value: int, i: int) -> int:
        """How often an id occurs among the first `i`."""
        if value < 0 or value >> self.levels:
            return 0
        a, b = self._range(value, min(max(i, 0), self.n))
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._range(value, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            one = value >> (self.levels - 1 - level) & 1
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of an id, ascending: its range in the last plane followed back from plane to plane."""
        if value < 0 or value >> self.levels:
            return np.zeros(0, np.int64)
        a, b = self._range(value, self.n)
        at = np.arange(a, b)
        for level in range(self.levels - 1, -1, -1):
            if not len(at):
                break
            one = value >> (self.levels - 1 - level) & 1
            bits = np.unpackbits(self.planes[level][0], count=self.n, bitorder="little")
            at = np.flatnonzero(bits == one)[at - self.zeros[level] if one else at]
        return np.sort(at)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        x = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits, _ = self.planes[level]
            one = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(x)
            up[~one] = x[:self.zeros[level]]
            up[one] = x[self.zeros[level]:] | x.dtype.type(1 << (self.levels - 1 - level))
            x = up
        return x.astype(np.uint32)


def write_shards(
    docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, text: str = "text",
    doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode all texts and write shards in ascending `doc_id` order to a table at `path`.

    Rows of the table are `part, seq, n_tokens, shard`; `(part, seq)` is the order. Spark's writer commits
    them, so a lost task leaves nothing behind. A null text is empty and has the end id only; null ids come
    first; rows that repeat an id follow one another by text. Documents are not cut: a task holds one shard
    of `shard_tokens` ids, or one document if that is longer.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            blob = build(np.concatenate(ids), np.cumsum(np.concatenate(sizes)), pa.concat_arrays(names))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([blob], pa.large_binary()).cast(pa.binary())],
                ["part", "seq", "n_tokens", "shard"],
            )

        for batch in batches:
            for a, b, got, n in encoded(vocabulary, filled(batch.column(1))):
                closed = np.insert(got, np.cumsum(n), end_id)
                n, at, first = n + 1, np.concatenate([[0], np.cumsum(n + 1)]), 0
                while first < b - a:
                    room = at[first] + shard_tokens - held
                    last = int(np.searchsorted(at, room, side="right")) - 1
                    if last <= first and held:
                        yield flush()
                        ids, sizes, names, held, seq = [], [], [], 0, seq + 1
                        continue
                    last = min(max(last, first + 1), b - a)
                    ids.append(closed[at[first]:at[last]])
                    sizes.append(n[first:last])
                    names.append(batch.column(0).slice(a + first, last - first))
                    held, first = held + int(at[last] - at[first]), last
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(shards, "part int, seq int, n_tokens bigint, shard binary")
    made.write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, seq int, n_tokens bigint, shard binary").parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """`part, seq, before`: ids of all shards before each. Parts are summed first, so the window without
    partitions has one row per part."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return shards.select("part", "seq", inner.alias("inner")).join(parts, "part").select(
        "part", "seq", (F.col("base") + F.col("inner")).alias("before")
    )


def documents_of(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, decoded from the shards at `path`."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c) for c in ("part", "seq", "shard")), strict=True):
                shard = Shard(blob.as_buffer().to_pybytes())
                raw, at = shard.decode().astype("<u4"), np.concatenate([[0], shard.ends])
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                k = len(shard.ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), shard.docs,
                     pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    shards = read_shards(spark, path)
    rows = shards.select("part", "seq", "shard").mapInArrow(
        digests, f"part int, seq int, doc_id {kind}, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.join(_starts(shards.select("part", "seq", "n_tokens")), ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def count_ids(shards: DataFrame, ids: list[int]) -> DataFrame:
    """`id, n`: how often each of `ids` occurs in all shards, by rank; nothing is decoded. Repeated ids count once."""
    wanted = sorted(set(ids))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                shard = Shard(blob.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([shard.count(i) for i in wanted], pa.int64())], ["id", "n"])

    return shards.select("shard").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def find_ids(shards: DataFrame, ids: list[int], kind: str = "bigint") -> DataFrame:
    """`id, doc_id, position`: every occurrence of each of `ids` and its place in its document, by select.

    `kind` is the type of the documents' names. A shard's occurrences are found in the task that holds it.
    """
    wanted = sorted(set(ids))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                shard = Shard(blob.as_buffer().to_pybytes())
                starts = np.concatenate([[0], shard.ends[:-1]]) if len(shard.ends) else shard.ends
                for i in wanted:
                    at = shard.occurrences(i)
                    doc = np.searchsorted(shard.ends, at, side="right")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), i)), shard.docs.take(pa.array(doc)), pa.array(at - starts[doc] if len(at) else at)],
                        ["id", "doc_id", "position"],
                    )

    return shards.select("shard").mapInArrow(found, f"id bigint, doc_id {kind}, position bigint")
