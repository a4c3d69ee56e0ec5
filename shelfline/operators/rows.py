"""Operators on product rows: slices, dedupe, first page per brand, subsets, write-back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.base import strip
from ..functions.text import clean_label
from ..session import stage
from .ranking import first_n_per, id_bucket, number_within
from .skew import null_safe_join


def category_slice(categories: DataFrame, start: int = 0, num: int | None = None) -> DataFrame:
    keep = F.col("idx") >= start
    if num is not None:
        keep = keep & (F.col("idx") < start + num)
    return categories.filter(keep)


def head_per_category(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The first `n` rows of every category by id, all if null; rows without category or id count, too.

    Rows are counted per range of ids. Ranges that lie before the n-th row pass as they are, those after it go, and
    only the range that holds it, one for each category, is ranked. The counts of ranges join
    the rows before anything else happens to them, one way for every `n`.
    """
    if n is None:
        return rows
    spot, size, start = "__bucket", "__n", "__start"
    dealt = rows.withColumn(spot, id_bucket("id"))
    counts = dealt.groupBy("product", spot).agg(F.count(F.lit(1)).alias(size))
    before = W.partitionBy("product").orderBy(spot).rowsBetween(W.unboundedPreceding, -1)
    open_ = counts.withColumn(start, F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col(start) < n)
    # Written first: both halves read it, and a category of a third of all rows can be split in the join.
    open_ = stage(open_, "ranges")
    whole = F.col(start) + F.col(size) <= n
    inside = null_safe_join(dealt, open_.filter(whole), ["product", spot], "inner")
    edge = null_safe_join(dealt, open_.filter(~whole), ["product", spot], "inner")
    rank = F.row_number().over(W.partitionBy("product").orderBy("id"))
    # The rank within `n` lets each task keep that many rows before the shuffle.
    edge = edge.withColumn("__rn", rank).filter((F.col("__rn") <= n) & (F.col("__rn") <= n - F.col(start)))
    return inside.select(*rows.columns).unionByName(edge.select(*rows.columns))


def dedupe_url(rows: DataFrame, key: list[str] = ["product", "url"]) -> DataFrame:
    """First row per URL within a category, by id."""
    return first_n_per(rows, key, ["id"], 1)


def group_urls_by_brand(rows: DataFrame) -> DataFrame:
    """Candidates of each brand in row order, one row per candidate with its place in the list.

    The list stays in long form: a brand with very many rows is numbered in ranges of ids and
    never gathered into one value. Rows without a brand are left out.
    """
    named = rows.filter(F.col("product").isNotNull() & F.col("brand").isNotNull()).select("product", "brand", "id", "url")
    numbered = number_within(
        named.withColumn("__bucket", id_bucket("id")), ["product", "brand"], ["__bucket"], ["id"], "place"
    )
    return numbered.select("product", "brand", "place", "id", "url")


def first_page_per_brand(candidates: DataFrame) -> DataFrame:
    """Per brand, the first candidate in row order whose page is there (`has_page`)."""
    ready = candidates.filter(F.col("has_page") & F.col("brand").isNotNull())
    return first_n_per(ready, ["product", "brand"], ["id"], 1)


def balanced_subset(rows: DataFrame, brands: int = 8, per_brand: int = 1, seed: int | None = None) -> DataFrame:
    """Exactly `brands` brands per category and `per_brand` rows per brand; smaller categories are left out.

    Lowest ids first, brands by first appearance; with a seed, both in a repeatable random order.
    """
    order: list[Column] = [F.col("id")] if seed is None else [F.xxhash64(F.lit(seed), F.col("id")), F.col("id")]
    picked = first_n_per(rows.filter(F.col("brand").isNotNull()), ["product", "brand"], order, per_brand)
    # At most `per_brand` rows per brand are left, and their shuffle serves the brand windows too.
    brand = W.partitionBy("product", "brand")
    full = picked.withColumns(
        {"__n": F.count(F.lit(1)).over(brand), "__lead": F.min(F.struct(*order)).over(brand)}
    ).filter(F.col("__n") == per_brand)
    ranked = full.withColumn("__place", F.dense_rank().over(W.partitionBy("product").orderBy("__lead")))
    # And at most `brands * per_brand` rows per category here.
    top = ranked.filter(F.col("__place") <= brands)
    enough = top.withColumn("__last", F.max("__place").over(W.partitionBy("product"))).filter(F.col("__last") == brands)
    return enough.select(*rows.columns)


def apply_updates(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Write new models and URLs back to kept rows and drop the rest. A missing category is one like any other."""
    kept = checked.filter(F.col("outcome") == "kept").select("product", "id", "new_model", "new_url")
    joined = null_safe_join(rows.drop("model", "url"), kept, ["product", "id"], "inner")
    return joined.withColumnsRenamed({"new_model": "model", "new_url": "url"}).select(*rows.columns)


def apply_model_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Replace the model where a new name exists."""
    fresh = names.select("product", "id", F.col("new_model").alias("__new"))
    joined = null_safe_join(rows, fresh, ["product", "id"])
    return joined.withColumn("model", F.coalesce("__new", "model")).select(*rows.columns)


def kept_dropped(checked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept, dropped and undecided rows: together the input, and disjoint."""
    o = F.col("outcome")
    return checked.filter(o == "kept"), checked.filter(o == "dropped"), checked.filter(o == "undecided")


def exclude_known_brands(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Drop candidates of brands the category already has, whatever their case.

    Known brands are reduced to distinct pairs before the join.
    """
    known = existing.select("product", F.lower("brand").alias("__brand")).distinct()
    named = candidates.withColumn("__brand", F.lower("brand"))
    return named.join(known, ["product", "__brand"], "left_anti").select(*candidates.columns)


def union_categories(parts: list[DataFrame]) -> DataFrame:
    """Tables of several categories as one, columns by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def sort_products(rows: DataFrame) -> DataFrame:
    """Rows in order of product, brand and model, ties by id; meant for exports."""
    return rows.orderBy("product", "brand", "model", "id")


def parse_product_lines(responses: DataFrame, header: str = "Brand,Model,URL", clean: bool = True) -> DataFrame:
    """Rows of semicolon-delimited answers: `(product, response)` to `(product, brand, model, url, line)`.

    Commas inside fields become spaces; lines with another number of fields are dropped. The first
    remaining line is dropped only if it is the header, so an answer without one loses nothing.
    """
    text = F.replace(F.replace(F.col("response"), F.lit(","), F.lit(" ")), F.lit(";"), F.lit(","))

    def tidy(line: Column) -> Column:
        return F.regexp_replace(strip(line), r",\z", "")

    lines = F.filter(
        F.transform(F.split(text, "\n"), tidy),
        lambda s: F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) == 2,
    )
    rows = responses.select("product", F.posexplode(lines).alias("line", "__s"))
    rows = rows.filter((F.col("line") != 0) | (F.col("__s") != header)).withColumn("__f", F.split("__s", ","))
    field = [F.nullif(F.get("__f", F.lit(i)), F.lit("")) for i in range(3)]
    named = [clean_label(f) for f in field[:2]] if clean else field[:2]
    return rows.select(
        "product", named[0].alias("brand"), named[1].alias("model"), field[2].alias("url"), "line"
    )
