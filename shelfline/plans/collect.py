"""Pages, page text and refreshed model names of a finished dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import bind
from ..functions.text import clean_title, extract_text, extract_title
from ..functions.urls import squeeze_url
from ..functions.verdicts import fresh_model_name
from ..operators.rows import apply_model_names, first_page_per_brand
from ..operators.skew import skewed_join
from ..session import stage
from ..operators.stores import NAME_UPDATE, QUESTION, resolve_alias


def _resolved(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    links = rows.select(squeeze_url("url").alias("__fetch")).distinct()
    links = resolve_alias(links, aliases, "__fetch", "new_url")
    return skewed_join(rows.withColumn("__fetch", squeeze_url("url")), links, ["__fetch"]).drop("__fetch")


def choose_pages(rows: DataFrame, aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """Per brand, the first row with a page. Of the page store only the URLs move, and whether there is a page."""
    there = pages.filter(F.col("html").isNotNull() & F.col("url").isNotNull())
    there = there.select(F.col("url").alias("new_url"), F.lit(True).alias("has_page"))
    return first_page_per_brand(skewed_join(_resolved(rows, aliases), there, ["new_url"], stored=True))


def collect_pages(rows: DataFrame, aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """Page and text of the chosen row of each brand: `(product, brand, id, url, html, content)`.

    The choice is made on narrow rows; HTML joins the chosen ones only. With a page store bucketed
    by URL (`sinks.save_page_store`) the store is not shuffled for it.
    """
    chosen = choose_pages(rows, aliases, pages).select("product", "brand", "id", "new_url")
    bodies = pages.select(F.col("url").alias("new_url"), "html")
    # The chosen rows, one for each brand, are held in memory bucket by bucket; bodies are neither moved nor sorted.
    got = bodies.join(chosen.hint("shuffle_hash"), "new_url")
    return got.select(
        "product", "brand", "id", F.col("new_url").alias("url"), "html", extract_text("html").alias("content")
    )


def page_titles(pages: DataFrame) -> DataFrame:
    """`(url, title)` of pages that have a title; made where the pages are scanned."""
    title = bind(extract_title("html"), clean_title)
    return pages.select("url", title.alias("title")).filter(F.col("title").isNotNull())


def name_questions(rows: DataFrame, aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with the key of their naming question; rows without page or title have none."""
    titles = page_titles(pages).withColumnRenamed("url", "new_url")
    resolved = stage(_resolved(rows, aliases), "resolved")
    # Titles are made where the pages are read, once; those of wanted pages travel on.
    wanted = titles.join(resolved.select("new_url").distinct(), "new_url", "left_semi")
    found = skewed_join(resolved, wanted, ["new_url"]).filter(F.col("title").isNotNull())
    return found.withColumn("query_type", F.lit(NAME_UPDATE))


def refresh_model_names(rows: DataFrame, aliases: DataFrame, pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows with the model name given by the stored answer, where there is one that tells."""
    asked = name_questions(rows, aliases, pages).select("product", "brand", "id", F.col("new_url").alias("url"))
    names = responses.filter(F.col("query_type") == NAME_UPDATE).select(
        *QUESTION, fresh_model_name("response").alias("new_model")
    )
    told = skewed_join(asked, names, QUESTION).filter(F.col("new_model").isNotNull())
    return apply_model_names(rows, told)
