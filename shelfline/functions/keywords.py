"""Term matching in page text. Text is lowercased once per page, never once per term."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import bind, col, is_true, terms_array


def any_term(lowered: Column, terms: list[str]) -> Column:
    return is_true(F.exists(terms_array(terms), lambda t: F.contains(lowered, t)))


def count_term(lowered: Column, term: Column, whole_word: bool = False) -> Column:
    """Non-overlapping occurrences of a term. The text is copied only if the term occurs at all."""
    if whole_word:
        edge = r"(?<![\p{L}\p{N}])"
        pattern = F.concat(F.lit(edge + r"\Q"), term, F.lit(r"\E(?![\p{L}\p{N}])"))
        n = F.regexp_count(lowered, pattern)
    else:
        n = (F.length(lowered) - F.length(F.replace(lowered, term, F.lit("")))) / F.length(term)
    return F.when(F.contains(lowered, term), n).otherwise(0).cast("int")


def product_keyword_hit(text: Column | str, terms: list[str]) -> Column:
    return bind(F.lower(col(text)), lambda t: any_term(t, terms))


def unavailable_counts(text: Column | str, terms: list[str], whole_word: bool = False) -> Column:
    """Map of term to number of occurrences."""
    vocab = terms_array(terms)
    return F.map_from_arrays(
        vocab, bind(F.lower(col(text)), lambda t: F.transform(vocab, lambda k: count_term(t, k, whole_word)))
    )


def unavailable_terms(text: Column | str, terms: list[str], whole_word: bool = False) -> Column:
    """Struct of the found terms in vocabulary order, their counts, the total and the flag."""
    vocab = terms_array(terms)

    def report(pairs: Column) -> Column:
        counts = F.transform(pairs, lambda p: p["n"])
        total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
        return F.struct(
            F.transform(pairs, lambda p: p["term"]).alias("terms"),
            counts.alias("counts"),
            total.alias("total"),
            ((F.size(pairs) > 0) & (total > 0)).alias("unavailable"),
        )

    def found(t: Column) -> Column:
        hits = F.filter(vocab, lambda k: F.contains(t, k))
        pairs = F.transform(
            hits, lambda k: F.struct(k.alias("term"), count_term(t, k, whole_word).alias("n"))
        )
        return bind(F.filter(pairs, lambda p: p["n"] > 0), report)

    return bind(F.lower(col(text)), found)


def is_unavailable(lowered: Column, terms: list[str], whole_word: bool = False) -> Column:
    """The flag alone: stops at the first term found."""
    if not whole_word:
        return any_term(lowered, terms)
    return is_true(F.exists(terms_array(terms), lambda k: count_term(lowered, k, True) > 0))
