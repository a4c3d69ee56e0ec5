"""Counts, quotas and audits of a product table. Every aggregate combines inside tasks first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import strip
from ..functions.terms import hit_rows, report_rows
from .ranking import first_n_per


def brand_quota(existing: DataFrame, products: DataFrame, want: int = 20) -> DataFrame:
    """Per category: number of existing brands, how many are still wanted, and the text naming them.

    `(product, n_existing, remaining, done, exclude_text)`. Brands are compared in lower case. A
    category that has enough needs no list, so the list never holds more than `want - 1` names.
    """
    brands = existing.filter(F.col("brand").isNotNull()).select("product", F.lower("brand").alias("b")).distinct()
    counts = brands.groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    # Up to `want` names per category are enough to tell, and to list, those with fewer.
    names = first_n_per(brands, ["product"], ["b"], want)
    names = names.groupBy("product").agg(F.array_sort(F.collect_list("b")).alias("names"))
    all_ = products.select("product").distinct().join(counts, "product", "left").join(names, "product", "left")
    n = F.coalesce("n", F.lit(0))
    text = F.concat(F.lit("Leave out what is known: "), F.array_join("names", ", "), F.lit(". "))
    return all_.select(
        "product",
        n.alias("n_existing"),
        (F.lit(want) - n).alias("remaining"),
        (n >= want).alias("done"),
        F.when(n >= want, F.lit(None)).when(n == 0, F.lit("")).otherwise(text).alias("exclude_text"),
    )


def category_counts(rows: DataFrame) -> DataFrame:
    """Per category: products, distinct models and brands."""
    per_brand = rows.groupBy("product", "brand").agg(F.count(F.lit(1)).alias("n"))
    return per_brand.groupBy("product").agg(
        F.sum("n").alias("n_rows"), F.count("brand").alias("n_brands")
    )


def dataset_counts(rows: DataFrame) -> DataFrame:
    """One row: categories, rows, distinct brands, brands per category (least and most)."""
    per_cat = category_counts(rows).agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_brands").alias("n_category_brands"),
        F.min("n_brands").alias("min_brands"),
        F.max("n_brands").alias("max_brands"),
    )
    distinct = rows.select(F.lower("brand").alias("b")).distinct().agg(F.count("b").alias("n_distinct_brands"))
    # Two one-row aggregates side by side.
    return per_cat.select("*", distinct.scalar().alias("n_distinct_brands"))


def products_per_brand(rows: DataFrame) -> DataFrame:
    """Histogram: how many (category, brand) pairs have how many products."""
    sizes = rows.filter(F.col("brand").isNotNull()).groupBy("product", "brand").agg(F.count(F.lit(1)).alias("n_products"))
    return sizes.groupBy("n_products").agg(F.count(F.lit(1)).alias("n_brands"))


def dataset_audit(rows: DataFrame, min_brands: int = 8, max_per_brand: int = 3) -> DataFrame:
    """Violations of what a finished dataset promises: `(rule, product, detail, n)`."""

    def found(df: DataFrame, rule: str, detail: Column, n: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), "product", detail.alias("detail"), n.cast("long").alias("n"))

    per_brand = rows.groupBy("product", "brand").agg(F.count(F.lit(1)).alias("n"))
    few = per_brand.groupBy("product").agg(F.count("brand").alias("n")).filter(F.col("n") < min_brands)
    many = per_brand.filter(F.col("brand").isNotNull() & (F.col("n") > max_per_brand))
    twice = rows.filter(F.col("url").isNotNull()).groupBy("product", "url").agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None).cast("string")
    empty = [F.sum((F.coalesce(strip(c), F.lit("")) == "").cast("long")).alias(c) for c in ("brand", "model", "url")]
    blanks = rows.groupBy("product").agg(*empty)
    pairs = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("n")) for c in ("brand", "model", "url")])
    blanks = blanks.select("product", F.inline(pairs)).filter(F.col("n") > 0)
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            found(few, "few_brands", nothing, F.col("n")),
            found(many, "many_products", F.col("brand"), F.col("n")),
            found(twice.filter(F.col("n") > 1), "repeated_url", F.col("url"), F.col("n")),
            found(blanks, "empty_field", F.col("f"), F.col("n")),
        ],
    )


def unavailable_hits(pages: DataFrame, terms: list[str], text: Column, key: str) -> DataFrame:
    """Long form of the term counts: `(key, term, n)` for every term found in a page.

    Each page meets an index of the terms in its own task and yields rows only for those it contains, so
    neither pages nor page-term pairs are shuffled, and thousands of terms cost hardly more than a few.
    """
    return hit_rows(pages, key, text, terms)


def unavailable_report(pages: DataFrame, terms: list[str], text: Column, key: str) -> DataFrame:
    """`(key, terms, counts, total, unavailable)` of every page, as `keywords.unavailable_terms` gives them, for term
    lists of any length."""
    return report_rows(pages, key, text, terms)


def term_totals(hits: DataFrame) -> DataFrame:
    """Per term: pages it occurs in and occurrences."""
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_hits"))
