"""Benchmark decontamination: one automaton over the windows of all test items, one scan of each text.

Words are runs of ASCII letters (A-Z lowered), digits and non-ASCII characters. Every `window` consecutive
words of an item, or a shorter item as a whole, is a pattern of the Aho-Corasick automaton. A text's words are
joined by single spaces and scanned once; the ends of matches lead back to words, and words to their places
in the original text.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.frames import add_columns, sheltered
from shelfline.session import stage

WINDOW = 10
#: Bytes of item text in one automaton; its windows overlap, so it has some ten times as many nodes. A larger
#: benchmark is scanned for in several automata of about this size.
BLOCK_BYTES = 256 << 10
RUNS, NAMES, COUNT = "__leak_runs", "__leak_items", "__leak_words"

#: Bytes that end a word become spaces, A-Z become a-z.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, with those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Scanner:
    """The automaton of some items' windows. A pattern carries its number of words and the items it is from."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[str, tuple[int, set[str]]] = {}
        for name, text in items:
            words = text.encode().translate(FOLD).split()
            for i in range(max(1, len(words) - window + 1)) if words else ():
                piece = words[i:i + window]
                found.setdefault(" " + b" ".join(piece).decode() + " ", (len(piece), set()))[1].add(name)
        self.automaton = ahocorasick.Automaton()
        for key, (n, names) in found.items():
            self.automaton.add_word(key, (n, tuple(names)))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, runs of hit words as (first, end), and the items whose windows occur."""
        words = text.translate(FOLD).split()
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if words and not self.empty:
            line = " " + b" ".join(words).decode() + " "
            spaces: list[int] = []
            for end, (n, names) in self.automaton.iter(line):
                spaces = spaces or np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32).tolist()
                last = bisect.bisect_left(spaces, end)
                items.update(names)
                runs.append((last - n, last))
        return len(words), joined(runs), items


def places(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as character ranges of the original text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(text.encode().translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(char[first[a]]), int(char[end[b - 1]])) for a, b in runs]


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about `most` bytes, fetched partition by partition; one empty block if there are none."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null")
    block, size, given = [], 0, False
    for r in rows.toLocalIterator():
        if size >= most:
            yield block
            block, size, given = [], 0, True
        block.append((r.i or "", r.t))
        size += len(r.t.encode())
    if block or not given:
        yield block


_OPEN: dict[str, Scanner] = {}


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """`docs` with `__leak_words` (number of words), `__leak_runs` (runs of hit words) and `__leak_items`.

    Each text is scanned where it is read. Items reach the tasks in blocks of `block_bytes`; a benchmark of more
    than one block is scanned for block after block, with the rows written between, so that no task holds
    more than one automaton.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text)

    def scanned(rows: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
        held, key, carried = spark.sparkContext.broadcast(items), uuid.uuid4().hex, RUNS in rows.columns
        names = rows.columns

        def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
            if key not in _OPEN:
                _OPEN.clear()
                _OPEN[key] = Scanner(held.value, window)
            counts, runs, items_hit = [], [], []
            for t in batch.column(at):
                n, r, i = _OPEN[key].scan((t.as_py() or "").encode())
                counts.append(n)
                runs.append(r)
                items_hit.append(i)
            if carried:
                runs = [joined([*map(tuple, a), *b]) for a, b in zip(batch.column(names.index(RUNS)).to_pylist(), runs, strict=True)]
                items_hit = [i.union(a) for a, i in zip(batch.column(names.index(NAMES)).to_pylist(), items_hit, strict=True)]
            pairs = pa.list_(pa.list_(pa.int64()))
            return [
                pa.array(counts, pa.int64()), pa.array([[list(x) for x in r] for r in runs], pairs),
                pa.array([sorted(i) for i in items_hit], pa.list_(pa.string())),
            ]

        made = add_columns(rows, kernel, "__n bigint, __r array<array<bigint>>, __i array<string>")
        return made.select(*docs.columns, F.col("__n").alias(COUNT), F.col("__r").alias(RUNS), F.col("__i").alias(NAMES))

    out, first = docs, True
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        out, first = scanned(out if first else stage(out, "leaks"), items), False
    return out


def hit_words() -> Column:
    """Number of hit words of a row of `with_leaks`."""
    return F.aggregate(RUNS, F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])


def leak_report(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items_sha256, contaminated` of every row.

    Null texts have no words; null or wordless items match nothing; a null item id counts as the empty string;
    rows that repeat an id are scanned one by one; other columns are not read; without items nothing is hit.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = with_leaks(rows, benchmark, **options)
    return found.select(
        "doc_id", F.col(COUNT).alias("n_words"), hit_words().alias("n_hit"), F.size(NAMES).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(NAMES)).cast("binary"), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, with their own columns, whatever they are called."""
    text = options.pop("text", "text")
    return sheltered(docs, lambda own, name: with_leaks(own, benchmark, text=name[text], **options).filter(F.size(RUNS) == 0))


SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), pattern AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS piece
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS piece
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)
), hit AS (SELECT doc_id, place.n, i, item FROM place JOIN pattern USING (n, piece)),
word AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""
