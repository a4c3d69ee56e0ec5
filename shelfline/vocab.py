"""Term lists. Every operator takes its terms as a parameter; these are the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Terms of which a product page shows at least one.
PRODUCT_TERMS = [
    "buy", "price", "add to cart", "product details", "specs",
    "purchase", "shop", "order", "shipping", "stock",
]

# Terms that mark a page as missing or a product as not on sale.
UNAVAILABLE_TERMS = [
    "404", "403", "503",
    "oops", "uh oh",
    "forbidden",
    "server is down",
    "doesn't exist", "does not exist",
    "can't find", "cannot find", "can't seem to find", "cannot seem to find",
    "nothing was found", "not found", "no seller found", "no sellers found",
    "out of stock", "no stock", "not in stock", "depleted stock", "awaiting stock",
    "no longer stocked", "exhausted stock", "out of inventory", "sold out",
    "ceased production", "no longer selling", "stopped selling", "out of production",
    "ended production", "no longer in production", "discontinue", "phased out",
    "no longer available", "retired product", "end of life", "backorder",
    "unavailable", "not available", "suspended sales", "not for sale",
    "off the market", "production halted", "withdrawn", "archived product",
    "supply exhausted", "not currently available",
    "找不到", "无法找到", "已被移除",
    "timed out", "pardon our interruption",
]

# A short default for links that are never a maker's own product page. Projects with a longer
# list keep it in a file, one term per line, and read it with `load_terms`.
URL_DISCARD_TERMS = [
    ".pdf",
    "ebay", "walmart", "etsy", "aliexpress", "costco",
    "youtube", "wikipedia", "facebook", "twitter", "reddit", "pinterest",
    "forum", "review", "support", "manual",
]

# The marketplace that also makes products: allowed only for its own brand.
MARKETPLACE = "amazon"


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """`(term)` rows of a one-term-per-line file, in no particular order, blanks and repeats removed."""
    lines = spark.read.text(path).select(F.trim("value").alias("term"))
    return lines.filter(F.col("term") != "").distinct()


def terms_of(vocab: DataFrame) -> list[str]:
    """A vocabulary table as a sorted list, to be used as an array literal in an expression.

    A term list is a parameter of a query, a few hundred words, kept in a file by people.
    """
    return sorted(r.term for r in vocab.select("term").distinct().collect())
