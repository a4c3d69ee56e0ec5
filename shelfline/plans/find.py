"""From a category list to candidate rows, in two jobs around the outside model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import brand_quota
from ..operators.rows import category_slice, exclude_known_brands, parse_product_lines
from ..operators.versions import latest_version, next_version, select_version
from .requests import find_requests, site_list_key

_KEY = ["query_type", "brand", "url"]


def first_minor_rows(versioned: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows of `{max_major}.0`, the collection whose brands count as existing."""
    source = latest.select("product", F.col("max_major").alias("major"), F.lit(0).alias("minor"))
    return select_version(versioned, source)


def quota_of(
    categories: DataFrame, versioned: DataFrame, versions: DataFrame, want: int = 20, exclude_existing: bool = True
) -> DataFrame:
    latest = latest_version(versions, categories)
    existing = first_minor_rows(versioned, latest)
    return brand_quota(existing if exclude_existing else existing.limit(0), categories, want)


def ask_for_products(
    categories: DataFrame,
    versioned: DataFrame,
    versions: DataFrame,
    start: int = 0,
    num: int | None = None,
    want: int = 20,
    exclude_existing: bool = True,
    model: str = "",
) -> DataFrame:
    """Job 1: the requests for new candidates, to be put to `model`."""
    chosen = category_slice(categories, start, num)
    return find_requests(quota_of(chosen, versioned, versions, want, exclude_existing), model, exclude_existing)


def find_products(
    categories: DataFrame,
    versioned: DataFrame,
    versions: DataFrame,
    responses: DataFrame,
    start: int = 0,
    num: int | None = None,
    want: int = 20,
    exclude_existing: bool = True,
    model: str = "",
) -> DataFrame:
    """Job 2: candidate rows of the stored answers of `model`, as the first version of the next major."""
    chosen = category_slice(categories, start, num)
    quota = quota_of(chosen, versioned, versions, want, exclude_existing)
    wanting = quota.filter(~F.col("done")).select("product")
    stored = responses.select("*", *[k.alias(f"__{n}") for n, k in zip(_KEY, site_list_key(model, exclude_existing), strict=True)])
    answers = stored.filter(" AND ".join(f"{n} = __{n}" for n in _KEY)).select("product", "response")
    rows = parse_product_lines(answers.join(wanting, "product", "left_semi"))
    latest = latest_version(versions, chosen)
    if exclude_existing:
        rows = exclude_known_brands(rows, first_minor_rows(versioned, latest))
    target = next_version(latest, minor_bump=False)
    return rows.join(target.select("product", "major", "minor"), "product").withColumnRenamed("line", "id")
