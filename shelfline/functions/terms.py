"""Many terms in many texts: an index of the terms by their rarest run of bytes.

Every term of four bytes or more is found by one of its runs of four bytes, a shorter one by itself. The runs of a batch of
texts are counted for all terms at once; a term is then looked for only where the rarest of its runs stands, and
compared there as a whole. What a batch costs grows with its text and with what is found in it, hardly with the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 4
#: Bits of the table that says which runs belong to a term at all.
TABLE_BITS = 20
SLICE_BYTES = 4 << 20


def _runs(data: np.ndarray, width: int) -> np.ndarray:
    """The runs of `width` bytes from every place on, as numbers."""
    n = max(0, len(data) - width + 1)
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out |= data[k:k + n].astype(np.uint32) << np.uint32(8 * k)
    return out


def _slot(runs: np.ndarray) -> np.ndarray:
    return (runs * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Width:
    """The terms that are found by runs of one width."""

    def __init__(self, terms: list[tuple[int, bytes]], width: int):
        self.width = width
        self.number = np.array([k for k, _ in terms])
        self.said = np.frombuffer(b"".join(b for _, b in terms), np.uint8)
        self.size = np.array([len(b) for _, b in terms])
        self.start = np.cumsum(self.size) - self.size
        # For each term, the runs it has and where in it they stand.
        count = self.size - width + 1
        self.own = np.cumsum(count) - count
        self.inside = _spans(np.zeros(len(terms), np.int64), count)
        every = np.concatenate([_runs(np.frombuffer(b, np.uint8), width) for _, b in terms])
        self.runs, self.place = np.unique(every, return_inverse=True)
        self.count = count
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[_slot(self.runs)] = True

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where terms begin, and which, for every occurrence."""
        runs = _runs(data, self.width)
        spots = np.flatnonzero(self.table[_slot(runs)])
        known = np.searchsorted(self.runs, runs[spots])
        known[known == len(self.runs)] = 0
        real = self.runs[known] == runs[spots]
        spots, known = spots[real], known[real]
        spots = spots[np.argsort(known, kind="stable")]
        often = np.bincount(known, minlength=len(self.runs))
        ends = np.cumsum(often)
        # The rarest run of each term, the first of several: counts and places in one number.
        counts = often[self.place]
        rarest = np.minimum.reduceat(counts * (1 << 20) + self.inside, self.own)
        at = rarest & ((1 << 20) - 1)
        run = self.place[self.own + at]
        some = np.flatnonzero(often[run])
        run, at = run[some], at[some]
        first = spots[_spans(ends[run] - often[run], often[run])] - np.repeat(at, often[run])
        term = np.repeat(some, often[run])
        fits = (first >= 0) & (first + self.size[term] <= len(data))
        first, term = first[fits], term[fits]
        for k in range(int(self.size.max())):
            long = self.size[term] > k
            same = np.ones(len(first), bool)
            same[long] = data[first[long] + k] == self.said[self.start[term[long]] + k]
            if not same.all():
                first, term = first[same], term[same]
            if not len(first):
                break
        return first, term


class TermIndex:
    """Terms in the order they were given; an empty one occurs nowhere."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        coded = [(k, t.encode()) for k, t in enumerate(terms) if t]
        widths = sorted({min(RUN, len(b)) for _, b in coded})
        self.widths = [_Width([c for c in coded if min(RUN, len(c[1])) == w], w) for w in widths]

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of every term in every text, occurrences not overlapping, ordered by text and term."""
        data, at = _bytes_of(texts)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in self.widths:
            first, term = width.places(data)
            owner = np.searchsorted(at, first, side="right") - 1
            inside = first + width.size[term] <= at[owner + 1]
            order = np.lexsort((first[inside], term[inside]))
            first, term, owner = first[inside][order], term[inside][order], owner[inside][order]
            kept = _apart(first, term, owner, width.size)
            pair, n = np.unique(term[kept] * len(texts) + owner[kept], return_counts=True)
            found.append((pair % len(texts), width.number[pair // len(texts)], n))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        text, term, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((term, text))
        return text[order], term[order], n[order]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _apart(first: np.ndarray, term: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of occurrences of a term that overlap in a text, the ones that counting from its start finds."""
    kept = np.ones(len(first), bool)
    touch = np.flatnonzero((term[1:] == term[:-1]) & (owner[1:] == owner[:-1]) & (first[1:] < first[:-1] + size[term[1:]])) + 1
    after, last = -1, -2
    # Few terms overlap themselves; a run of occurrences that do is gone through one by one.
    for k in touch.tolist():
        if k != last + 1 or kept[k - 1]:
            after = int(first[k - 1] + size[term[k]]) if kept[k - 1] else after
        kept[k] = first[k] >= after
        last = k
    return kept


def _parts(texts: pa.Array, index: TermIndex) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and end of parts of about `SLICE_BYTES`, and the hits in each."""
    out, ends = [], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, side="right"))))
        out.append((a, b, *index.hits(texts.slice(a, b - a))))
        a = b
    return out


def _texts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    return rows.select(key, F.lower(text).alias("__text"))


def hit_rows(rows: DataFrame, key: str, text: Column, terms: list[str]) -> DataFrame:
    """`key, term, n`: every term that occurs in the lowered `text` of a row, and how often, without overlaps.

    Worked out in the task that reads the row, in Arrow batches cut to parts of about `SLICE_BYTES`. A null text has no terms.
    """
    names = pa.array(terms, pa.string())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex(terms)
        for batch in batches:
            for a, b, text, term, n in _parts(batch.column(1), index):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(text)), names.take(pa.array(term)), pa.array(n, pa.int32())],
                    [key, "term", "n"],
                )

    kind = rows.schema[key].dataType.simpleString()
    return _texts(rows, key, text).mapInArrow(found, f"`{key}` {kind}, term string, n int")


def report_rows(rows: DataFrame, key: str, text: Column, terms: list[str]) -> DataFrame:
    """`key, terms, counts, total, unavailable` of every row: what `keywords.unavailable_terms` says of its text.

    A null text has none.
    """
    names, kind = pa.array(terms, pa.string()), rows.schema[key].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TermIndex(terms)
        for batch in batches:
            for a, b, text, term, n in _parts(batch.column(1), index):
                at = np.searchsorted(text, np.arange(b - a + 1))
                total = np.diff(np.concatenate([[0], np.cumsum(n)])[at])
                cut = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(cut, names.take(pa.array(term))),
                     pa.ListArray.from_arrays(cut, pa.array(n, pa.int32())), pa.array(total, pa.int32()), pa.array(total > 0)],
                    [key, "terms", "counts", "total", "unavailable"],
                )

    made = "terms array<string>, counts array<int>, total int, unavailable boolean"
    return _texts(rows, key, text).mapInArrow(report, f"`{key}` {kind}, {made}")
