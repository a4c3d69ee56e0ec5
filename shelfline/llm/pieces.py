"""SentencePiece ids of whole texts by a table of distinct chunks, and the text that ids stand for.

A model writes each space as a mark and adds one at the front. If none of its pieces holds a mark after another
character, no merge crosses from a character to a mark, so a text's ids are the ids of its chunks (marks and what
follows up to the next mark) one after another. Texts are cut into blocks of bounded size; a block is a list of
its different chunks and, for each document, positions in that list. Lists are dealt by a hash of the chunk, each
different chunk of the corpus is segmented once by the library, and its ids go back to the blocks that hold it,
by position. Shuffles carry numbers and each block's different chunks, never texts.

A block is named by its own chunks, so reading the texts a second time gives the same names. A table whose rows
come in another order on the second reading would give unknown names, which is an error, not a wrong result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.arrays import raw_bytes
from shelfline.llm.encoding import byte_slices, filled, vocabulary_path

MARK = "▁"
#: Text in a block, in a row of positions, and in one call of the library.
BLOCK_BYTES, ROW_BYTES, CALL_WORDS = 16 << 20, 1 << 20, 1 << 16


class PieceModel:
    """A SentencePiece model whose pieces do not cross marks."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        plain = (
            not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces and not spec.denormalizer_spec.precompiled_charsmap
            and not spec.trainer_spec.treat_whitespace_as_suffix
        )
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        own = [p.piece for p in spec.pieces if p.type == kinds.USER_DEFINED]
        if not plain or own or any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces):
            raise ValueError("chunks of this model are not independent: pieces or rules cross white space")
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lone_mark = self.lib.piece_to_id(MARK)
        surface = {kinds.CONTROL: lambda p: b"", kinds.BYTE: lambda p: bytes([int(p.piece[1:-1], 16)]),
                   kinds.UNKNOWN: lambda p: spec.trainer_spec.unk_surface.encode()}
        self.surfaces = pa.array(
            [surface.get(p.type, lambda p: p.piece.replace(MARK, " ").encode())(p) for p in spec.pieces], pa.binary()
        )

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks (each without its first mark) one after another, and how many each has."""
        ids, sizes = [], []
        for at in range(0, len(chunks), CALL_WORDS):
            part = chunks[at:at + CALL_WORDS]
            got = self.lib.encode(part, num_threads=1)
            got = [g if c else [self.lone_mark] for g, c in zip(got, part, strict=True)]
            sizes.append(np.array([len(g) for g in got], np.int64))
            ids.append(np.fromiter((i for g in got for i in g), np.int32, int(sizes[-1].sum())))
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def texts_of(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The text of each run of ids, `at` holding where runs begin and, last, where they end.

        Every text begins with the mark the model adds, which goes. Ids of encoded texts give whole characters.
        """
        taken = self.surfaces.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int32)[taken.offset:taken.offset + len(taken) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            lo, hi = offsets[a], offsets[b]
            out.append(raw[lo + (hi > lo and raw[lo] == 32):hi].tobytes().decode("utf-8", "replace"))
        return pa.array(out, pa.string())


_OPEN: dict[str, PieceModel] = {}


def piece_model(name: str) -> PieceModel:
    """The model of a file, opened once in each worker."""
    if name not in _OPEN:
        _OPEN[name] = PieceModel(name if os.path.isabs(name) else vocabulary_path(name))
    return _OPEN[name]


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts, each without its first mark, and how many each text has. No nulls.

    A run of r spaces before a character belongs to the chunk of that character; at the end of a text it is
    a chunk of its own. An empty text has no chunk.
    """
    texts = pc.replace_substring(texts, MARK, " ")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not empty.any():
        return flat, sizes
    ends = np.cumsum(sizes)
    last = np.zeros(len(flat), bool)
    last[ends[sizes > 0] - 1] = True
    # The number of empty parts right before each part, within its text.
    where = np.arange(len(flat))
    first = np.repeat(ends - sizes, sizes)
    solid = np.maximum.accumulate(np.where(empty, -1, where))
    before = where - 1 - np.maximum(np.concatenate([[-1], solid[:-1]]), first - 1)
    whole = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    kept = (~empty | last) & ~np.repeat(whole, sizes)
    changed = np.flatnonzero(kept & (before > 0))
    parts = flat.take(pa.array(changed)).to_pylist()
    made = [" " * n + p for n, p in zip(before[changed].tolist(), parts, strict=True)]
    pick = where.copy()
    pick[changed] = len(flat) + np.arange(len(changed))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    joined = pa.concat_arrays([flat, pa.array(made, flat.type)]).take(pa.array(pick[kept]))
    return joined, np.bincount(owner[kept], minlength=len(sizes)).astype(np.int64)


def _packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays one after another behind their sizes, compressed."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    body = np.array([len(raw), *map(len, raw)], "<i8").tobytes() + b"".join(raw)
    return np.array([len(body)], "<i8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list[bytes]:
    size = int(np.frombuffer(data, "<i8", 1)[0])
    body = pa.decompress(data[8:], size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    at = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(body, "<i8", n, 8))])
    return [body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _strings(lengths: bytes, data: bytes) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<u4"))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


class _Block:
    """Documents of one block: their chunks as positions in the list of the block's different chunks."""

    def __init__(self, chunks: list[pa.Array], sizes: list[np.ndarray], ids: list[pa.Array]):
        coded = pa.chunked_array(chunks, pa.string()).combine_chunks()
        coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        codes = coded.indices.to_numpy()
        # Frequent chunks first, so that positions are small numbers.
        often = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often), dtype=np.uint32)
        self.codes, self.words = place[codes], coded.dictionary.take(pa.array(often))
        self.sizes, self.ids = sizes, ids
        data, at = raw_bytes(self.words)
        self.data, self.at = data.tobytes(), at
        self.name = xxhash.xxh3_128_hexdigest(np.diff(at).tobytes() + self.data)

    def positions(self) -> Iterator[tuple[pa.Array, bytes]]:
        """Ids of some documents, and the packed sizes and positions of their chunks."""
        done = 0
        for ids, sizes in zip(self.ids, self.sizes, strict=True):
            n = int(sizes.sum())
            yield ids, _packed(sizes.astype("<i8"), self.codes[done:done + n].astype("<u4"))
            done += n

    def lists(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """For each bucket, the packed positions, lengths and bytes of the chunks dealt to it."""
        lo, hi = self.at[:-1].tolist(), self.at[1:].tolist()
        dealt = np.array([zlib.crc32(self.data[a:b]) % buckets for a, b in zip(lo, hi, strict=True)], np.int64)
        order = np.argsort(dealt, kind="stable")
        starts = np.flatnonzero(np.diff(dealt[order], prepend=-1))
        for a, b in zip(starts.tolist(), np.append(starts, len(order))[1:].tolist(), strict=True):
            at = order[a:b]
            words = self.words.take(pa.array(at))
            data, ends = raw_bytes(words)
            yield int(dealt[at[0]]), _packed(at.astype("<u4"), np.diff(ends).astype("<u4"), data.tobytes())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Blocks of the documents of one task; columns are the id and the text."""
    chunks, sizes, ids, held = [], [], [], 0
    for batch in batches:
        texts = filled(batch.column(1))
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for a, b in byte_slices(lengths, ROW_BYTES):
            got, n = chunks_of(texts.slice(a, b - a))
            chunks.append(got.cast(pa.string()))
            sizes.append(n)
            ids.append(batch.column(0).slice(a, b - a))
            held += int(lengths[a:b].sum()) + 64 * (b - a)
            if held >= BLOCK_BYTES:
                yield _Block(chunks, sizes, ids)
                chunks, sizes, ids, held = [], [], [], 0
    if ids:
        yield _Block(chunks, sizes, ids)


def encode_pieces(
    docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """`doc_id, ids, decoded` of every row: the ids the library gives its whole text, and the text they stand for.

    A null text counts as empty and has no ids; repeated rows and null ids come back one by one; an empty table
    gives an empty result; other columns are not read, whatever they are called. `ids` is an array of int.
    Texts of any length are encoded whole. `docs` is read twice and should be a stored table. A model whose
    pieces cross white space, or that rewrites texts, is refused.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    kind = chosen.schema["doc_id"].dataType.simpleString()
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // BLOCK_BYTES))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            rows = list(block.lists(buckets))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows]), pa.array([block.name] * len(rows)), pa.array([d for _, d in rows], pa.binary())],
                    ["bucket", "block", "packed"],
                )

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by bucket; each different chunk of a bucket is segmented once."""

        def close(names: list[str], rows: list[list[bytes]]) -> pa.RecordBatch:
            lists = [_strings(r[1], r[2]) for r in rows]
            coded = pa.concat_arrays(lists).dictionary_encode()
            ids, sizes = piece_model(model).segment(coded.dictionary.to_pylist())
            first, codes, done, out = np.cumsum(sizes) - sizes, coded.indices.to_numpy(), 0, []
            for words, row in zip(lists, rows, strict=True):
                at = codes[done:done + len(words)]
                n, done = sizes[at], done + len(words)
                ends = np.cumsum(n)
                flat = ids[np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]))]
                out.append(_packed(row[0], n.astype("<u4"), flat.astype("<u4")))
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], ["block", "packed"])

        bucket, names, rows = None, [], []
        for batch in batches:
            for b, name, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket and names:
                    yield close(names, rows)
                    names, rows = [], []
                bucket = b
                names.append(name)
                rows.append(_unpacked(data))
        if names:
            yield close(names, rows)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for ids, data in block.positions():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.name]), pa.array([data], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                    ["block", "packed", "doc_ids"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by block, the block's chunks (no `doc_ids`) before its documents."""
        enc, name, lists, table = piece_model(model), None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                block, owners = batch.column(0)[i].as_py(), batch.column(2)[i]
                if block != name:
                    name, lists, table = block, [], None
                parts = _unpacked(batch.column(1)[i].as_py())
                if not owners.is_valid:
                    lists.append([np.frombuffer(p, "<u4") for p in parts])
                    continue
                if table is None:
                    at, n, flat = (np.concatenate([r[k] for r in lists] or [np.zeros(0, np.uint32)]) for k in range(3))
                    size, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    size[at] = n
                    first[at] = np.cumsum(n, dtype=np.int64) - n
                    table = size, first, flat.astype(np.int32)
                    lists = []
                size, first, flat = table
                counts, codes = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<u4")
                if len(codes) and int(codes.max()) >= len(size):
                    raise ValueError("the documents changed between two readings: store the table first")
                n = size[codes]
                ends = np.cumsum(n)
                ids = flat[np.repeat(first[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
                at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                yield pa.RecordBatch.from_arrays(
                    [owners.values, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), enc.texts_of(ids, at)],
                    ["doc_id", "ids", "decoded"],
                )

    found = (
        chosen.mapInArrow(dealt, "bucket bigint, block string, packed binary")
        .repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(segmented, "block string, packed binary")
    )
    kept = chosen.mapInArrow(positions, f"block string, packed binary, doc_ids array<{kind}>")
    both = found.withColumn("doc_ids", F.lit(None).cast(f"array<{kind}>")).unionByName(kept)
    placed = both.repartition(buckets, "block").sortWithinPartitions("block", F.col("doc_ids").isNotNull())
    return placed.mapInArrow(joined, f"doc_id {kind}, ids array<int>, decoded string")


def piece_report(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of every row of `encode_pieces`."""
    return encode_pieces(docs, model, text, doc_id).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
