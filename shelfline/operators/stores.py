"""Lookups in the stores of redirects, pages, answers and searches, and what they still lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import bind, col
from ..functions.keywords import any_term, is_unavailable
from ..functions.text import extract_text
from ..functions.urls import cache_key, drop_slash, pdf_guard, squeeze_url
from .skew import null_safe_join, skewed_join

QUESTION = ["product", "brand", "url"]

# Kinds of questions about one (product, brand, url).
URL_CHECK = "check_url"
BRAND_CHECK = "check_url_brand"
CATALOG_PICK = "find_in_catalog"
PAGE_CHECK = "check_product_page"
NAME_UPDATE = "update_model_name"
SITE_LIST = "find_sites"

# Folders of stores with a file for each key, and the characters of a whole path that make the key.
PAGE_FOLDER, ANSWER_FOLDER, SEARCH_FOLDER = "html_pages/pages/", "llm_responses/", "google_responses/"
KEY_WIDTH = 200
KEY = "cache_key"


def page_key(url: Column | str) -> Column:
    """Key of a page in a store of files."""
    return cache_key(PAGE_FOLDER, url, KEY_WIDTH)


def answer_key(kind: str, url: Column | str) -> Column:
    """Key of an answer in a store of files: kind of question and URL, whatever product and brand it was about."""
    return cache_key(f"{ANSWER_FOLDER}{kind}/", url, KEY_WIDTH)


def search_key(query: Column | str) -> Column:
    """Key of a search in a store of files."""
    return F.left(F.concat(F.lit(SEARCH_FOLDER), col(query)), F.lit(KEY_WIDTH))


def by_key(rows: DataFrame, key: Column, store: DataFrame, stored: bool = False) -> DataFrame:
    """`rows` with the columns of a store that has a `cache_key`; several rows may share one."""
    found = skewed_join(rows.withColumn("__key", key), store.withColumnRenamed(KEY, "__key"), ["__key"], stored=stored)
    return found.drop("__key")


def resolve_alias(rows: DataFrame, aliases: DataFrame, url: str = "url", out: str = "new_url") -> DataFrame:
    """Follow one redirect where the URL has one."""
    target = aliases.select(F.col("url").alias(url), F.col("new_url").alias("__to"))
    return rows.join(target, url, "left").withColumn(out, F.coalesce("__to", url)).drop("__to")


def lookup_pages(rows: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Attach page HTML; null means the fetch failed or has not happened. A store of files is looked up by key."""
    if KEY in pages.columns:
        return by_key(rows, page_key(url), pages.select(KEY, "html"), stored=True)
    return rows.join(pages.select(F.col("url").alias(url), "html"), url, "left")


def page_facts(
    pages: DataFrame,
    product_terms: list[str],
    unavailable_terms: list[str],
    whole_word: bool = False,
) -> DataFrame:
    """What the keyword rules need to know of each page: `(url, has_page, product_hit, unavailable)`, or
    with `cache_key` in place of the URL for a store of files.

    Done where the pages are scanned, so page bodies never take part in a shuffle: everything
    after works on this narrow row.
    """

    def facts(t: Column) -> Column:
        return F.struct(
            any_term(t, product_terms).alias("product_hit"),
            is_unavailable(t, unavailable_terms, whole_word).alias("unavailable"),
        )

    found = bind(F.lower(extract_text("html")), facts)
    # The null test stays outside the lookup: it must not make the struct be computed twice.
    name = KEY if KEY in pages.columns else "url"
    out = pages.filter(F.col("html").isNotNull()).select(name, found.alias("f"))
    return out.select(name, F.lit(True).alias("has_page"), "f.product_hit", "f.unavailable")


def pending_fetch(rows: DataFrame, pages: DataFrame, aliases: DataFrame, url: str = "url") -> DataFrame:
    """Distinct URLs still to be fetched, without spaces and after redirects, as the checks look them up.

    A stored page without HTML was not fetched.
    """
    link = squeeze_url(url)
    wanted = rows.select(link.alias("url")).filter(~pdf_guard("url")).distinct()
    wanted = resolve_alias(wanted, aliases).select(F.col("new_url").alias("url")).distinct()
    return wanted.join(pages.filter(F.col("html").isNotNull()).select("url"), "url", "left_anti")


def pending_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Questions without a stored answer."""
    key = ["query_type", *QUESTION]
    answered = responses.filter(F.col("response").isNotNull()).select(*key)
    return null_safe_join(requests, answered, key, "left_anti")


def pending_searches(queries: DataFrame, usable: DataFrame) -> DataFrame:
    """Distinct search queries without a usable stored result."""
    return queries.select("query").distinct().join(usable.select("query"), "query", "left_anti")


def trim_stores(
    rows: DataFrame, aliases: DataFrame, facts: DataFrame, responses: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of the stores that concern `rows`.

    For few rows against large stores: their keys are small enough to reach every scan task, so the
    stores are filtered where they are read and only the matches travel.
    """
    links = rows.select("product", "brand", squeeze_url("url").alias("url"))
    urls = links.select("url").distinct()
    moved = aliases.join(urls, "url", "left_semi")
    keys = resolve_alias(links, moved).select("product", "brand", F.col("new_url").alias("url")).distinct()
    if KEY in facts.columns:
        seen = facts.join(keys.select(page_key("url").alias(KEY)).distinct(), KEY, "left_semi")
    else:
        seen = facts.join(keys.select("url").distinct(), "url", "left_semi")
    asked = keys.withColumn("url", drop_slash("url"))
    if KEY in responses.columns:
        kinds = F.explode(F.array(*[answer_key(k, "url") for k in (URL_CHECK, CATALOG_PICK, PAGE_CHECK)]))
        return moved, seen, responses.join(asked.select(kinds.alias(KEY)).distinct(), KEY, "left_semi")
    return moved, seen, null_safe_join(responses, asked, QUESTION, "left_semi")


def lookup_verdicts(responses: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per `(product, brand, url)` with a column per kind of question, null where unanswered."""
    wanted = responses.filter(F.col("query_type").isin(kinds))
    # The store holds one answer per question; `min` only makes the pivot well defined.
    return wanted.groupBy(*QUESTION).agg(
        *[F.min(F.when(F.col("query_type") == k, F.col("response"))).alias(k) for k in kinds]
    )
