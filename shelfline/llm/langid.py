"""Language identification by bit-sliced Bloom filters.

There is one Bloom filter for each language over the n-grams found in its documents, and the filters lie bit
by bit beside each other: position i of the table is a mask of the languages whose filter has bit i. The
positions of an n-gram, and-ed, give all languages that contain it at once. A text's n-grams are counted for
each language, the hits expected by chance, from how full the language's filter is, are taken off, and the
language with the most hits left is predicted.

An n-gram belongs to a language if at least `share` of the rate of the language that uses it most, and at
least `least` times, occurs there; so a foreign passage in a document does not put its n-grams into the filter.

What is learnt is bounded by parameters: `fit_texts` different labelled texts, taken by a hash of the text where there are more,
their `fit_langs` most frequent languages, and the `fit_grams` n-grams a language has most of. So the table
has at most 13 * `fit_grams` positions, rounded up to a power of two, and reaches every task; every text is predicted by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.arrays import code_points, mixed, owners, sums
from shelfline.llm.encoding import byte_slices, filled
from shelfline.llm.frames import add_columns
from shelfline.session import stage

SIZES = (2, 3, 4)
POSITIONS = 1 << 21
HASHES = 3
#: A table has at least so many positions for each n-gram of its fullest language: a false positive in about 114.
ROOM = 13
#: Different texts, languages, and n-grams of a language that filters are learnt from.
FIT_TEXTS, FIT_LANGS, FIT_GRAMS = 1 << 18, 256, 1 << 18
SHARE, LEAST = 0.3, 3
SLICE = 1 << 19
UNKNOWN = "und"
ODD = np.uint64(0x9E3779B97F4A7C15)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Small letters of the texts with every run of other characters as one 0, a 0 first and last in each text,
    and where each text's begin."""
    low = pc.utf8_lower(texts)
    points, at = code_points(low)
    known = np.unique(points)
    alpha = np.array([chr(c).isalpha() for c in known.tolist()], bool)
    place = np.searchsorted(known, points)
    x = np.where(alpha[place], points, 0) if len(points) else points
    # A 0 before each text stands for its start and the end of the one before.
    x = np.insert(x, at[:-1], 0)
    starts = at[:-1] + np.arange(len(at) - 1)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    keep[starts] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return x[keep].astype(np.uint64), count[np.concatenate([starts, [len(x)]])]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every n-gram of the texts' words, with a mark for word ends, and the text each is in."""
    x, at = letters(texts)
    own, scattered = owners(at), mixed(x + np.uint64(1))
    out, who = [], []
    for n in SIZES:
        if len(x) < n:
            continue
        key = np.full(len(x) - n + 1, n, np.uint64)
        inside = own[n - 1:] == own[:len(x) - n + 1]
        some = np.zeros(len(key), bool)
        for j in range(n):
            real = x[j:len(x) - n + 1 + j] != 0
            key = key * ODD + scattered[j:len(x) - n + 1 + j]
            some |= real
            if 0 < j < n - 1:
                inside &= real
        inside &= some
        out.append(mixed(key[inside]))
        who.append(own[:len(x) - n + 1][inside])
    return (np.concatenate(out), np.concatenate(who)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """`lang, gram, n`: how often each n-gram occurs in the documents of each language, added up batch by batch."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            texts = filled(batch.column(1))
            for code, name in enumerate(langs.dictionary.to_pylist()):
                mine = texts.filter(pa.array(codes == code))
                sizes = pc.binary_length(mine).to_numpy(zero_copy_only=False)
                # Added up slice by slice, so that a batch of long texts is never held as n-grams.
                found = [np.unique(grams(mine.slice(a, b - a))[0], return_counts=True) for a, b in byte_slices(sizes, SLICE)]
                key, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c for _, c in found]), len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null")
    return rows.mapInArrow(counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_sample(rows: DataFrame, text: str, lang: str, fit_texts: int = FIT_TEXTS, fit_langs: int = FIT_LANGS) -> tuple[DataFrame, list[str]]:
    """`text, lang` of the rows to learn from, and their languages, the one with most rows first.

    Copies of a text are in the sample or out of it together, as its hash says.
    """
    given = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null")
    mark = F.shiftright(F.xxhash64("text", "lang"), 32)
    different = given.agg(F.approx_count_distinct(F.xxhash64("text", "lang"), 0.01)).first()[0]
    if different > fit_texts:
        given = given.filter(mark < int((fit_texts / different - 0.5) * (1 << 32)))
    top = given.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit_langs)
    langs = [r.lang for r in sorted(top.collect(), key=lambda r: (-r["count"], r.lang))]
    return given.filter(F.col("lang").isin(langs)), langs


def members(counts: DataFrame, share: float = SHARE, least: int = LEAST, fit_grams: int = FIT_GRAMS) -> DataFrame:
    """`lang, gram`: the languages each n-gram belongs to, of each language the `fit_grams` most frequent ones."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    known = rates.filter(F.col("n") >= least).join(top, "gram").filter(F.col("rate") >= share * F.col("top"))
    known = stage(known.select("lang", "gram", "n"), "language-rates")
    # The count that the last of the wanted n-grams has, from numbers of n-grams by count; of those with that count all go.
    often = known.groupBy("lang", "n").agg(F.count("*").alias("grams"))
    upto = F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    cut = often.withColumn("upto", upto).filter(F.col("upto") <= fit_grams).groupBy("lang").agg(F.min("n").alias("cut"))
    return known.join(F.broadcast(cut), "lang").filter(F.col("n") >= F.col("cut")).select("lang", "gram")


def table_size(most: int) -> int:
    """Positions of a table for up to `most` n-grams a language: a power of two with room for them."""
    return max(POSITIONS, 1 << (ROOM * most - 1).bit_length()) if most else POSITIONS


def positions(gram: np.ndarray, size: int = POSITIONS) -> np.ndarray:
    """The `HASHES` positions of each n-gram in a table of `size`."""
    second = mixed(gram ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([((gram + np.uint64(i) * second) >> np.uint64(20)) % np.uint64(size) for i in range(HASHES)])


class Filters:
    """Filters of up to 64 languages a word, position by position."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self.full = np.array([self._bits(table, i).mean() if len(table) else 0.0 for i in range(len(langs))])
        self.chance = self.full ** HASHES

    @staticmethod
    def _bits(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """The mask of languages that contain each n-gram."""
        spots = positions(gram, len(self.table))
        out = self.table[spots[0]]
        for s in spots[1:]:
            out &= self.table[s]
        return out

    def votes(self, gram: np.ndarray, who: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and for each text and language the hits without those expected by chance."""
        masks = self.containing(gram)
        n = np.bincount(who, minlength=texts)
        hits = np.stack([np.bincount(who, self._bits(masks, i), texts) for i in range(len(self.langs))], axis=1)
        return n, np.clip((hits - n[:, None] * self.chance) / (1 - self.chance), 0, None)


def build_filters(known: DataFrame, size: int = POSITIONS) -> DataFrame:
    """`word, position, mask`: the bit-sliced table of `members`, whose languages carry a number `code`."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.tile(batch.column(0).to_numpy(), HASHES)
            spot = positions(batch.column(1).to_numpy().view(np.uint64), size).ravel().astype(np.int64)
            bit = (np.uint64(1) << (code % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code // 64), pa.array(spot), pa.array(bit)], ["word", "position", "mask"])

    rows = known.select(F.col("code").cast("bigint"), "gram").mapInArrow(spread, "word bigint, position bigint, mask bigint")
    return rows.groupBy("word", "position").agg(F.bit_or("mask").alias("mask"))


_OPEN: dict[str, Filters] = {}


def with_language(
    docs: DataFrame, learn: DataFrame, text: str = "text", lang: str = "lang", fit_texts: int = FIT_TEXTS, fit_langs: int = FIT_LANGS,
    fit_grams: int = FIT_GRAMS,
) -> DataFrame:
    """`docs` with `lang_pred` and `score`, learnt from the rows of `learn` whose `lang` is not null.

    The filters reach the tasks as a table with room for what was learnt. Texts that are null or have no letter, and all texts where nothing could be learnt, are
    `und` with score 0. A text without hits gets the language with the most documents to learn from, with score 0.
    Ties go to the language with more documents, then the smaller name.
    """
    spark = docs.sparkSession
    sample, langs = fit_sample(learn, text, lang, fit_texts, fit_langs)
    code = spark.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, code int")
    counts = stage(count_grams(sample, "text", "lang"), "language-grams")
    known = members(counts, fit_grams=fit_grams).join(F.broadcast(code), "lang").select("code", "gram")
    known = stage(known, "language-members")
    size = table_size(max((r["count"] for r in known.groupBy("code").count().collect()), default=0))
    words = max(1, -(-len(langs) // 64))
    table = np.zeros((size, words), np.uint64)
    cells = build_filters(known, size).toArrow()
    table[cells["position"].to_numpy(), cells["word"].to_numpy()] = cells["mask"].to_numpy().view(np.uint64)
    held, key = spark.sparkContext.broadcast((langs, table)), uuid.uuid4().hex
    at = docs.columns.index(text)

    def predict(texts: pa.Array, filters: Filters) -> tuple[list[str], np.ndarray]:
        gram, who = grams(texts)
        n, votes = filters.votes(gram, who, len(texts))
        best = votes.argmax(axis=1)
        top = votes.max(axis=1)
        total = votes.sum(axis=1)
        score = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        return [filters.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = filled(batch.column(at))
        if not langs:
            return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Filters(*held.value)
        names, scores = [], [np.zeros(0)]
        for a, b in byte_slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE):
            got, score = predict(texts.slice(a, b - a), _OPEN[key])
            names += got
            scores.append(score)
        return [pa.array(names, pa.string()), pa.array(np.concatenate(scores))]

    return add_columns(docs, kernel, "lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: a third, by a checksum of the id. A null id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def language_report(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every row; learns from the rows that are not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    learn = rows.filter(~held_out())
    given = rows.select("doc_id", held_out().alias("held_out"), "text")
    return with_language(given, learn).select("doc_id", "held_out", "lang_pred", "score")
