"""Quality rules: base counts of words and repeats, then perplexity bands of each language.

The model is an interpolated modified Kneser-Ney model of character trigrams, one for each value of `lang`,
counted by Spark over every document that passes the base rules. Characters fall into 64 classes (letters,
one class for capitals, for digits, for kinds of punctuation, 15 for the rest), so a language has at most
64^3 trigrams, 2 MB, however large the corpus is. Which character of its class stands there is told by a
second Kneser-Ney model, of every pair of neighbouring code points whose second shares its class with others:
the probability of a character is that of its class after two classes times its own, among its class, after
the character before. These entries grow with the different pairs a language holds. Tasks hold all entries as
arrays sorted by a hash of language and n-gram and find them by binary search.

A document is rejected if its log-perplexity a character lies outside its language's band, `median - low *
spread` to `median + high * spread`, where `spread` is the median distance from the median. Short texts
scatter more: the band of a text of n words is wider by sqrt(1 + SHORT / n).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.arrays import code_points, mixed, owners, raw_bytes, sums, words
from shelfline.llm.encoding import byte_slices, filled
from shelfline.llm.frames import add_columns, sheltered
from shelfline.session import stage

ORDER, BITS, BEGIN = 3, 6, 63
REPEAT_WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
LOW, HIGH, SHORT = 8.0, 5.0, 100.0
#: Bins of log-perplexity, per nat, for medians that do not depend on how rows are dealt.
BINS = 1000
SLICE = 1 << 19

BASE = "__words bigint, __chars bigint, __symbols bigint, __dup_lines bigint, __repeats bigint, __failed boolean"


def _classes() -> np.ndarray:
    """The class of each of the 128 ASCII characters."""
    c = np.full(128, 46, np.uint8)
    c[97:123] = np.arange(1, 27)
    c[65:91], c[48:58] = 27, 28
    c[[9, 11, 12, 13, 32]], c[10] = 29, 30
    for chars, k in ((".", 31), (",", 32), ("!?", 33), (";:", 34), ("\"'", 35), ("()[]{}", 36), ("+-/=@\\^_`~", 45)):
        c[[ord(x) for x in chars]] = k
    c[[ord(x) for x in "#*$%&|<>"]] = np.arange(37, 45)
    return c


ASCII = _classes()
#: How many of all code points are in each class.
ROOM = np.bincount(ASCII, minlength=64) + np.bincount(47 + np.arange(128, 0x110000) % 15, minlength=64)
#: The bits of a code point, what stands before a text's first, and the part of a count its pair leaves to others.
POINT, NO_POINT, CUT = 21, (1 << 21) - 1, 0.75
#: Entries of the model of members: sizes from here on.
MEMBERS = ORDER + 1
SYMBOLS = np.isin(np.arange(256), [ord(x) for x in "#*$%&|<>"])


def classes(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, ASCII[np.minimum(points, 127)], 47 + points % 15).astype(np.int64)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigram of classes that ends at each character, and where each text's begin."""
    points, at = code_points(texts)
    x = classes(points)
    key = x.copy()
    for back in range(1, ORDER):
        before = np.full(len(x), BEGIN, np.int64)
        before[back:] = x[:-back] if back < len(x) else x[:0]
        first = at[:-1]
        for j in range(back):  # nothing stands before a text's first characters
            spots = first[first + j < at[1:]] + j
            before[spots] = BEGIN
        key |= before << (BITS * back)
    return key, at


def members(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of characters that share their class with others, and each one's pair: the code point before it,
    and its own."""
    points, at = code_points(texts)
    points = points.astype(np.int64)
    before = np.full(len(points), NO_POINT, np.int64)
    before[1:] = points[:-1]
    before[at[:-1][at[:-1] < at[1:]]] = NO_POINT
    spots = np.flatnonzero(ROOM[classes(points)] > 1)
    return spots, before[spots] << POINT | points[spots]


def base_counts(texts: pa.Array) -> list[np.ndarray]:
    """Words, their characters, symbols, repeated lines, words in repeated windows, and whether the rules fail."""
    coded, at = words(texts)
    n = np.diff(at)
    size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = coded.indices.to_numpy()
    raw, ends = raw_bytes(texts)
    lines = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        some = [x for x in t.as_py().split("\n") if x.strip(" \t\v\f\r")]
        lines[i] = len(some) - len(set(some))
    repeats = np.zeros(len(codes) + 1, np.int64)
    starts = np.arange(max(0, len(codes) - REPEAT_WINDOW + 1))
    owner = owners(at)
    starts = starts[starts + REPEAT_WINDOW <= at[1:][owner[starts]]] if len(starts) else starts
    if len(starts):
        scattered, key = mixed(codes + 1), mixed(owner[starts] + (1 << 40))
        for j in range(REPEAT_WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + scattered[starts + j]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(starts), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        np.add.at(repeats, starts[hit], 1)
        np.add.at(repeats, starts[hit] + REPEAT_WINDOW, -1)
    covered = sums(np.cumsum(repeats)[:-1] > 0, at)
    failed = (n < LEAST_WORDS) | (100 * covered > MOST_REPEATED * n)
    return [n, sums(size[codes] if len(codes) else codes, at), sums(SYMBOLS[raw], ends), lines, covered, failed]


def _slices(texts: pa.Array):
    for a, b in byte_slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE):
        yield a, b, texts.slice(a, b - a)


def _added(found: list[np.ndarray]) -> np.ndarray:
    """Rows of keys and counts, each key once."""
    every = np.concatenate(found, axis=1)
    key, place = np.unique(every[0], return_inverse=True)
    # Sums by `bincount` are doubles, exact up to 2^53.
    return np.stack([key, np.bincount(place, every[1], len(key)).astype(np.int64)])


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`lang, pair, gram, n`: trigrams of classes, and with `pair` pairs of code points, of all documents that pass
    the base rules. A null language is one of its own.

    A task adds up all its batches before anything is shuffled: at most 64^3 numbers a language, and its different pairs.
    """
    chosen = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))

    def counts(batches):
        seen: dict[str, int] = {}
        totals = {False: np.zeros((2, 0), np.int64), True: np.zeros((2, 0), np.int64)}
        bits = {False: BITS * ORDER, True: 2 * POINT}
        for batch in batches:
            codes = np.array([seen.setdefault(x, len(seen)) for x in batch.column(0).to_pylist()], np.int64)
            found = {k: [total] for k, total in totals.items()}
            for a, b, texts in _slices(filled(batch.column(1))):
                key, at = grams(texts)
                spots, pairs = members(texts)
                own = owners(at)
                good, own = (~base_counts(texts)[5])[own], codes[a:b][own]
                keys = {False: (own << bits[False] | key)[good], True: (own[spots] << bits[True] | pairs)[good[spots]]}
                for k, x in keys.items():
                    found[k].append(np.stack(np.unique(x, return_counts=True)))
            totals = {k: _added(f) for k, f in found.items()}
        names = pa.array(list(seen), pa.string())
        for k, total in totals.items():
            for at in range(0, total.shape[1], 1 << 16):
                key, n = total[:, at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(key >> bits[k])), pa.array(np.full(len(key), k)), pa.array(key & (1 << bits[k]) - 1), pa.array(n)],
                    ["lang", "pair", "gram", "n"],
                )

    parts = chosen.mapInArrow(counts, "lang string, pair boolean, gram bigint, n bigint")
    return parts.groupBy("lang", "pair", "gram").agg(F.sum("n").alias("n"))


def _level(counts: DataFrame, order: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Probabilities `lang, gram, p` of one order, and what its contexts `lang, gram, g` leave to the next lower one."""
    kinds = counts.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
    told = (F.col("n1") > 0) & (F.col("n2") > 0)
    kinds = kinds.withColumn("y", F.when(told, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5)))

    def cut(i: int) -> Column:
        a, b = F.col(f"n{i}"), F.col(f"n{i + 1}")
        # Where counts of counts are too few to tell, a fixed part of the count is taken off.
        d = F.when((a > 0) & (b > 0), i - (i + 1) * F.col("y") * b / a).otherwise(F.lit(i / 4))
        return F.greatest(F.lit(0.01), F.least(F.lit(i - 0.01), d))

    cuts = kinds.select("lang", *(cut(i).alias(f"d{i}") for i in (1, 2, 3)))
    rows = counts.join(cuts, "lang").withColumn("context", F.shiftright("gram", BITS))
    some = lambda test: F.sum(test.cast("bigint"))
    contexts = rows.groupBy("lang", "context", "d1", "d2", "d3").agg(
        F.sum("n").alias("total"), some(F.col("n") == 1).alias("a"), some(F.col("n") == 2).alias("b"),
        some(F.col("n") > 2).alias("c"),
    )
    left = (F.col("d1") * F.col("a") + F.col("d2") * F.col("b") + F.col("d3") * F.col("c")) / F.col("total")
    contexts = contexts.select("lang", "context", "total", left.alias("g"))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("kept", F.col("n") - d).join(contexts, ["lang", "context"])
    own = F.col("kept") / F.col("total")
    if lower is None:
        p = rows.select("lang", "gram", (own + F.col("g") / (1 << BITS)).alias("p"))
    else:
        tail = F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
        shorter = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
        p = rows.withColumn("tail", tail).join(shorter, ["lang", "tail"])
        p = p.select("lang", "gram", (own + F.col("g") * F.col("q")).alias("p"))
    return p, contexts.select("lang", F.col("context").alias("gram"), "g")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """`lang, size, gram, p, g` from trigram counts: the probability of each n-gram after its context, and the
    share that contexts leave to shorter ones. Lower orders count the different characters before an n-gram."""
    by_order = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1))
        by_order[n] = by_order[n + 1].groupBy("lang", tail.alias("gram")).agg(F.count("*").alias("n"))
    out, lower = None, None
    for n in range(1, ORDER + 1):
        lower, left = _level(by_order[n], n, lower)
        lower = stage(lower, "grams")
        for part in (
            lower.select("lang", F.lit(n).alias("size"), "gram", "p", F.lit(None).cast("double").alias("g")),
            left.select("lang", F.lit(n - 1).alias("size"), "gram", F.lit(None).cast("double").alias("p"), "g"),
        ):
            out = part if out is None else out.unionByName(part)
    return out.groupBy("lang", "size", "gram").agg(F.max("p").alias("p"), F.max("g").alias("g"))


def member_shares(pairs: DataFrame) -> DataFrame:
    """`lang, size, gram, p, g` like those of `kneser_ney`, from `lang, gram, n` of pairs of code points: the share of a
    character in its class after the one before (size `MEMBERS + 3`) and, counted by different characters before, anywhere
    (`+ 1`); what a character before leaves to the latter (`+ 2`), and a class to each character not met in it (`+ 0`)."""
    point = F.col("gram").bitwiseAND(F.lit(NO_POINT))
    of_ascii, room = (F.array(*(F.lit(int(x)) for x in v)) for v in (ASCII, ROOM))
    kind = F.when(point < 128, F.get(of_ascii, point.cast("int"))).otherwise((point % 15).cast("int") + 47)
    rows = pairs.select("lang", "gram", "n", F.shiftright("gram", POINT).alias("before"), point.alias("point"), kind.alias("kind"))
    left = F.lit(CUT) * F.col("kinds") / F.col("total")

    def totals(counts: DataFrame, *keys: str) -> DataFrame:
        return counts.groupBy("lang", *keys).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))

    def share(lower: Column) -> Column:
        return (F.col("n") - CUT) / F.col("total") + lower

    met = rows.groupBy("lang", "point", "kind").agg(F.count("*").alias("n"))
    in_class = totals(met, "kind").withColumn("each", left / F.get(room, F.col("kind")))
    anywhere = stage(met.join(in_class, ["lang", "kind"]).select("lang", "point", share(F.col("each")).alias("q")), "members")
    after = totals(rows, "before", "kind").withColumn("g", left)
    told = rows.join(after, ["lang", "before", "kind"]).join(anywhere, ["lang", "point"])

    def part(df: DataFrame, size: int, gram: Column, p: Column | None = None, g: Column | None = None) -> DataFrame:
        p, g = (F.lit(None).cast("double") if x is None else x for x in (p, g))
        return df.select("lang", F.lit(MEMBERS + size).alias("size"), gram.cast("bigint").alias("gram"), p.alias("p"), g.alias("g"))

    return (
        part(told, 3, F.col("gram"), p=share(F.col("g") * F.col("q")))
        .unionByName(part(after, 2, F.shiftleft("before", BITS) + F.col("kind"), g=F.col("g")))
        .unionByName(part(anywhere, 1, F.col("point"), p=F.col("q")))
        .unionByName(part(in_class, 0, F.col("kind"), p=F.col("each")))
    )


class Model:
    """The entries of all languages, sorted by a hash of language, length and n-gram."""

    def __init__(self, langs: list[str], key: np.ndarray, p: np.ndarray, g: np.ndarray):
        self.lang = {x: i for i, x in enumerate(langs)}
        order = np.argsort(key)
        self.key, self.log_p, self.log_g = key[order], p[order], g[order]

    @staticmethod
    def hashed(lang: np.ndarray, size: int, gram: np.ndarray) -> np.ndarray:
        return mixed((lang.astype(np.int64) << 24) | (size << 18) | gram) if size < MEMBERS else mixed(mixed(lang) ^ mixed((size << 2 * POINT) | gram))

    @classmethod
    def gathered(cls, entries: DataFrame) -> Model:
        """From `kneser_ney`, at most 64^3 + 64^2 + 64 + 1 entries a language, and `member_shares`, one for each different
        pair, character and character before."""
        got = entries.toArrow()
        names = got["lang"].combine_chunks().dictionary_encode()
        size, gram = got["size"].to_numpy(), got["gram"].to_numpy().astype(np.int64)
        code = names.indices.to_numpy().astype(np.int64)
        key = np.zeros(len(got), np.uint64)
        for n in range(MEMBERS + 4):
            own = size == n
            key[own] = cls.hashed(code[own], n, gram[own])
        logs = [np.log(np.nan_to_num(got[c].to_numpy().astype(float), nan=1.0)).astype(np.float32) for c in ("p", "g")]
        return cls(names.dictionary.to_pylist(), key, *logs)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return at, self.key[at] == key if len(self.key) else np.zeros(len(key), bool)

    def log_probabilities(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """For each trigram the log-probability of its last character after the others."""
        out, todo = np.zeros(len(gram), np.float64), np.arange(len(gram))
        for n in range(ORDER, 0, -1):
            short = gram[todo] & (1 << BITS * n) - 1
            at, hit = self.find(self.hashed(lang[todo], n, short))
            out[todo[hit]] += self.log_p[at[hit]]
            todo, short = todo[~hit], short[~hit]
            if not len(todo):
                return out
            at, hit = self.find(self.hashed(lang[todo], n - 1, short >> BITS))
            out[todo[hit]] += self.log_g[at[hit]]
        out[todo] -= BITS * np.log(2)
        return out

    def log_shares(self, lang: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """For each pair the log-probability of its second character, among those of its class, after the first."""
        out, todo = np.zeros(len(pair), np.float64), np.arange(len(pair))
        point = pair & NO_POINT
        kind = classes(point)
        for size, gram in ((3, pair), (1, point), (0, kind)):
            at, hit = self.find(self.hashed(lang[todo], MEMBERS + size, gram[todo]))
            out[todo[hit]] += self.log_p[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if size == 3:
                at, hit = self.find(self.hashed(lang[todo], MEMBERS + 2, pair[todo] >> POINT << BITS | kind[todo]))
                out[todo[hit]] += self.log_g[at[hit]]
        out[todo] -= np.log(ROOM[kind[todo]])
        return out

    def log_perplexity(self, lang: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Mean negative log-probability of a text's characters; 0 for an empty text."""
        key, at = grams(texts)
        own = lang[owners(at)]
        each = self.log_probabilities(own, key)
        spots, pair = members(texts)
        each[spots] += self.log_shares(own[spots], pair)
        total = sums(each, at)
        return -total / np.maximum(1, np.diff(at))


_OPEN: dict[str, Model] = {}


def with_scores(docs: DataFrame, entries: DataFrame, text: str = "text", lang: str = "lang", without: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with the columns of `BASE` and `__log_ppl` of each text under its language's model, in one pass.

    Columns of `without` are read and not handed on.
    """
    spark = docs.sparkSession
    model = Model.gathered(entries)
    held, key = spark.sparkContext.broadcast((list(model.lang), model.key, model.log_p, model.log_g)), uuid.uuid4().hex
    at, own = docs.columns.index(text), docs.columns.index(lang)

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Model(*held.value)
        model = _OPEN[key]
        # A language without a document that passes the base rules has no entries, and needs none.
        codes = np.array([model.lang.get(str(x.as_py()) if x.is_valid else "", len(model.lang)) for x in batch.column(own)], np.int64)
        parts = [(base_counts(t), model.log_perplexity(codes[a:b], t)) for a, b, t in _slices(filled(batch.column(at)))]
        kinds = [np.int64] * 5 + [bool]
        base = [pa.array(np.concatenate([p[i] for p, _ in parts]) if parts else np.zeros(0, kinds[i])) for i in range(6)]
        return [*base, pa.array(np.concatenate([q for _, q in parts]) if parts else np.zeros(0))]

    return add_columns(docs, kernel, f"{BASE}, __log_ppl double", without)


def bands(scores: DataFrame) -> DataFrame:
    """`lang, middle, spread` over rows `lang, score`: median and median distance from it.

    Scores are counted on bins once; medians come from the counts, a few thousand rows a language.
    """

    def median(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("lang").orderBy("bin")
        counts = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("lang"))})
        return counts.filter(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min("bin").alias(name))

    binned = scores.select("lang", F.round(F.col("score") * BINS).cast("bigint").alias("bin"))
    binned = stage(binned.groupBy("lang", "bin").agg(F.count("*").alias("n")), "bins")
    middle = median(binned, "middle")
    away = binned.join(middle, "lang").select("lang", F.abs(F.col("bin") - F.col("middle")).alias("bin"), "n")
    return middle.join(median(away, "spread"), "lang").select(
        "lang", (F.col("middle") / BINS).alias("middle"), (F.greatest(F.col("spread"), F.lit(1)) / BINS).alias("spread")
    )


def _entries(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The model of `docs`, as a written table."""
    counts = stage(count_grams(docs, text, lang), "counts")
    trigrams = counts.filter(~F.col("pair")).select("lang", F.col("gram").cast("int").alias("gram"), "n")
    pairs = counts.filter("pair").select("lang", "gram", "n")
    return stage(kneser_ney(trigrams).withColumn("gram", F.col("gram").cast("bigint")).unionByName(member_shares(pairs)), "model")


def _limits(scored: DataFrame, lang: str) -> DataFrame:
    name = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    passed = scored.filter(~F.col("__failed")).select(name.alias("lang"), F.col("__log_ppl").alias("score"))
    return bands(passed).select(F.col("lang").alias("__lang"), F.col("middle").alias("__mid"), F.col("spread").alias("__spread"))


def _with_verdict(scored: DataFrame, limits: DataFrame, lang: str, low: float, high: float, short: float) -> DataFrame:
    """`scored` with `__kept`. `limits` has one row for each language."""
    width = F.col("__spread") * F.sqrt(1 + F.lit(short) / F.greatest(F.col("__words"), F.lit(1)))
    inside = (F.col("__log_ppl") >= F.col("__mid") - low * width) & (F.col("__log_ppl") <= F.col("__mid") + high * width)
    name = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    # One row for each language, of which the tasks hold a whole model already.
    joined = scored.join(F.broadcast(limits), name == F.col("__lang"), "left")
    return joined.withColumn("__kept", ~F.col("__failed") & F.coalesce(inside, F.lit(False))).drop("__lang", "__mid", "__spread")


def quality_report(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", low: float = LOW, high: float = HIGH,
    short: float = SHORT,
) -> DataFrame:
    """`doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity` of every row.

    Null texts and texts of fewer than 20 words fail the base rules; a null language has a model and a band of
    its own; repeated rows count each time; an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    scored = stage(with_scores(rows, _entries(rows, "text", "lang"), without=("text",)), "scored")
    found = _with_verdict(scored, _limits(scored, "lang"), "lang", low, high, short)
    return found.select(
        "doc_id", F.col("__words").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"),
        F.col("__dup_lines").alias("n_dup_lines"), F.col("__repeats").alias("n_repeat_words"),
        F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__log_ppl").alias("log_perplexity"),
    )


def good_documents(
    docs: DataFrame, text: str = "text", lang: str = "lang", low: float = LOW, high: float = HIGH, short: float = SHORT
) -> DataFrame:
    """The rows of `docs` that the rules keep, with their own columns, whatever they are called. Texts are scored again
    rather than moved."""

    def good(own: DataFrame, name: dict[str, str]) -> DataFrame:
        entries = _entries(own, name[text], name[lang])
        said = own.select(name[text], name[lang])
        limits = stage(_limits(with_scores(said, entries, name[text], name[lang], (name[text],)), name[lang]), "bands")
        scored = with_scores(own, entries, name[text], name[lang])
        return _with_verdict(scored, limits, name[lang], low, high, short).filter("__kept")

    return sheltered(docs, good)
