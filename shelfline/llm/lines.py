"""Line deduplication by winnowing.

A document is the sequence of hashes of its lines (trimmed; blank lines do not count). A window is the
shortest run of lines from a given line on that has `min_words` words. The smallest hash of a window is its
fingerprint, the same wherever the run occurs, so two equal runs of `min_words` words share a fingerprint for
certain, and neighbouring windows mostly share one. Places are joined on fingerprints that occur again; there
each match is extended both ways over all windows around the fingerprint, compared by a hash of the whole
window. A window that also starts earlier (smaller id, or earlier in the same document) is a later repeat, and
its lines go. Runs longer than a window are the union of their windows, but for last lines of fewer words than a
window. With `whole`, the shortest runs that end with a given line are windows too, and the union is the whole run:
a line after the start of the last window lies in the one that ends with the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.encoding import filled
from shelfline.llm.frames import add_columns, sheltered
from shelfline.session import stage

MIN_WORDS = 30
SPACE = " \t\r\v\f"
BACK = 0x2545F4914F6CDD1D


def line_windows(text: str, min_words: int, whole: bool = False) -> list[tuple[int, int, list[int], list[int], bool]]:
    """`(fingerprint, first line, hash of each window, end of each window, False)` of every fingerprint's windows.

    Windows of one fingerprint start at consecutive lines; lines are counted without blank ones. Windows made for
    `whole` end at consecutive lines, and have `True` and start and end exchanged.
    """
    lines = [x.strip(SPACE) for x in text.split("\n")]
    lines = [x for x in lines if x]
    if not lines:
        return []
    size = [len(x.encode().split()) for x in lines]
    upto = np.concatenate([[0], np.cumsum(size)])
    ends = np.searchsorted(upto, upto[:-1] + min_words)
    starts = int((ends <= len(lines)).sum())
    if not starts:
        return []
    # Signed, as Spark's numbers are.
    digest = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lines], np.uint64)
    raw, order = digest.tobytes(), digest.view(np.int64)
    out: list[tuple[int, int, list[int], list[int], bool]] = []
    at = -1
    for i in range(starts):
        e = int(ends[i])
        if at < i:
            at = i + int(order[i:e].argmin())
            new = True
        else:
            best = at
            prior = int(ends[i - 1])
            if e > prior:
                k = prior + int(order[prior:e].argmin())
                best = k if order[k] < order[at] else at
            new, at = best != at, best
        if new:
            out.append((int(order[at]), i, [], [], False))
        out[-1][2].append(xxhash.xxh64_intdigest(raw[8 * i:8 * e], 7) - (1 << 63))
        out[-1][3].append(e)
    return out + windows_back(raw, order, upto, ends, min_words) if whole else out


def windows_back(
    raw: bytes, order: np.ndarray, upto: np.ndarray, ends: np.ndarray, min_words: int
) -> list[tuple[int, int, list[int], list[int], bool]]:
    """The shortest runs of `min_words` words that end with each line, without fingerprints whose runs are all known."""
    out: list[tuple[int, int, list[int], list[int], bool]] = []
    starts = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    at = -1
    for e in range(int((starts < 0).sum()) + 1, len(starts) + 1):
        i, best = int(starts[e - 1]), at
        if at < i:
            best = i + int(order[i:e].argmin())
        elif order[e - 1] < order[at]:
            best = e - 1
        if best != at:
            # Their own fingerprints: those of the other windows of a text would all occur again.
            out.append((int(order[best]) ^ BACK, e, [], [], True))
        at = best
        out[-1][2].append(xxhash.xxh64_intdigest(raw[8 * i:8 * e], 7) - (1 << 63))
        out[-1][3].append(i)
    return [x for x in out if any(ends[i] != x[1] + k for k, i in enumerate(x[3]))]


def _fingerprints(docs: DataFrame, min_words: int, whole: bool) -> DataFrame:
    """`doc_id, version, fingerprint, first, keys, ends, back` of `docs` with `doc_id, version, text`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, own = [], []
            for k, t in enumerate(filled(batch.column(2))):
                got = line_windows(t.as_py(), min_words, whole)
                found += got
                own += [k] * len(got)
            own = pa.array(own, pa.int64())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array([x[0] for x in found], pa.int64()),
                 pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], longs),
                 pa.array([x[3] for x in found], longs), pa.array([x[4] for x in found], pa.bool_())],
                ["doc_id", "version", "fingerprint", "first", "keys", "ends", "back"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        find,
        f"doc_id {kind}, version bigint, fingerprint bigint, first bigint, keys array<bigint>, ends array<bigint>, back boolean",
    )


def repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id", whole: bool = False
) -> DataFrame:
    """`doc_id, version, cuts`: for each document with later repeats, its windows to delete as (first, end) lines.

    `version` is a hash of the text: it tells texts with the same id apart.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    prints = stage(_fingerprints(given, min_words, whole), "line-prints")
    # Partial counts in each task first: a fingerprint of a third of all documents is a few rows here.
    again = stage(prints.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"), "line-again")
    spread = prints.join(again, "fingerprint", "left_semi").select(
        "doc_id", "version", "fingerprint", "first", "back", F.posexplode(F.arrays_zip("keys", "ends")).alias("k", "w")
    )
    # Equal windows share their fingerprint, so a match is of both hashes.
    near, far = F.col("first") + F.col("k"), F.col("w.ends")
    i, e = F.when(F.col("back"), far).otherwise(near), F.when(F.col("back"), near).otherwise(far)
    places = stage(spread.select("fingerprint", F.col("w.keys").alias("key"), "doc_id", "version", i.alias("i"), e.alias("e")), "line-places")
    spot = F.struct("doc_id", "version", "i")
    firsts = places.groupBy("fingerprint", "key").agg(F.min(spot).alias("origin"), F.count("*").alias("n"))
    firsts = stage(firsts.filter("n > 1").select("fingerprint", "key", "origin"), "line-firsts")
    later = places.join(firsts, ["fingerprint", "key"]).filter(spot > F.col("origin"))
    return later.groupBy("doc_id", "version").agg(F.collect_list(F.struct("i", "e")).alias("cuts"))


def without_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id", whole: bool = False
) -> DataFrame:
    """`docs` with later repeats of runs of lines deleted from `text`, and `__lines` and `__removed`, numbers of lines.

    No row goes: a text whose lines are all repeats becomes empty. Null texts stay null and have no lines. A null
    id is the smallest. Rows that repeat both id and text are one document and are cut alike; rows that repeat
    an id only are ordered by a hash of the text. `whole` deletes repeated runs of `min_words` words to their last line.
    """
    cuts = repeated_lines(docs, min_words, text, doc_id, whole)
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("cuts").alias("__cuts"))
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__version"))
    paired = docs.join(cuts, same, "left").select(*docs.columns, "__cuts")
    at, last = paired.columns.index(text), len(paired.columns) - 1

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, count, removed = [], [], []
        for t, cuts in zip(batch.column(at), batch.column(last), strict=True):
            raw = t.as_py()
            lines = raw.split("\n") if raw is not None else []
            real = [k for k, x in enumerate(lines) if x.strip(SPACE)]
            gone: set[int] = set()
            for c in cuts.as_py() or ():
                gone.update(real[c["i"]:c["e"]])
            texts.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else raw)
            if gone and len(gone) == len(real):
                texts[-1] = ""
            count.append(len(real))
            removed.append(len(gone))
        return [pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64())]

    made = add_columns(paired, kernel, "__text string, __lines bigint, __removed bigint")
    return made.select(*(F.col("__text").alias(c) if c == text else F.col(c) for c in docs.columns), "__lines", "__removed")


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` without later repeats of whole runs of lines, with their own columns, whatever they are called."""
    return sheltered(docs, lambda own, name: without_repeats(own, min_words, name[text], name[doc_id], whole=True))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`doc_id, n_lines, n_removed, text` of every row: lines with words, those deleted, and the text left (null: empty).

    Repeated runs are deleted from their first line to their last one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    done = without_repeats(rows, min_words, whole=True)
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.coalesce("text", F.lit("")).alias("text"))


SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), line AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), summed AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM line),
whole AS (SELECT doc_id, list(x ORDER BY i) AS xs FROM line GROUP BY doc_id),
win AS (
  SELECT a.doc_id, a.i, b.i AS j
  FROM (SELECT doc_id, i, upto - w + {words} AS need FROM summed) a
  ASOF JOIN (SELECT doc_id, i, upto FROM summed) b ON a.doc_id = b.doc_id AND a.need <= b.upto
  UNION
  SELECT b.doc_id, a.i, b.i AS j
  FROM (SELECT doc_id, i, upto - {words} AS room FROM summed) b
  ASOF JOIN (SELECT doc_id, i, upto - w AS before FROM summed) a ON a.doc_id = b.doc_id AND b.room >= a.before
), run AS (SELECT win.doc_id, i, j, array_to_string(xs[i:j], chr(10)) AS body FROM win JOIN whole USING (doc_id)),
later AS (
  SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM run) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later),
marked AS (
  SELECT raw.doc_id, raw.pos, raw.line, line.i IS NOT NULL AS real, gone.i IS NOT NULL AS cut
  FROM raw LEFT JOIN line USING (doc_id, pos) LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = line.i
), done AS (
  SELECT doc_id, count(*) FILTER (real) AS n_lines, count(*) FILTER (cut) AS n_removed,
         CASE WHEN count(*) FILTER (cut) > 0 AND count(*) FILTER (cut) = count(*) FILTER (real) THEN ''
              ELSE string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut) END AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(done.text, '') AS text
FROM documents LEFT JOIN done USING (doc_id)
""".replace("{words}", str(MIN_WORDS))
