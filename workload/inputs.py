"""Inputs of the operators, derived by Spark from the driver tables.

The driver has pages but no product rows, answers or search results; they follow from the pages by
arithmetic, over the whole table, so that their size grows with it. `workload/sql_inputs.py` says
the same in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.urls import drop_slash, link_prefix, search_query, squeeze_url
from shelfline.operators.classify import Rules
from shelfline.operators.stores import (
    BRAND_CHECK, CATALOG_PICK, NAME_UPDATE, PAGE_CHECK, URL_CHECK, resolve_alias,
)
from shelfline.session import stage
from shelfline.sources.readers import reduce_aliases, scan_search_results
from shelfline.sources.sinks import save_capture_store, save_page_store
from workload.terms import PRODUCT_TERMS, UNAVAILABLE_TERMS, URL_TERMS

RULES = Rules(product_terms=PRODUCT_TERMS, unavailable_terms=UNAVAILABLE_TERMS, url_terms=URL_TERMS)

PRODUCT_IN_URL = r"/([a-z]{2})/[0-9]+"
BRAND_IN_URL = r"^https?://(?:www\.|m\.|blog\.)?([^./]+)"
MODEL_IN_URL = r"/[a-z]{2}/([0-9]+)"
RANKS = 5
NAMED_MODELS = 6


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        F.col("page_id").alias("id"),
        F.regexp_extract("url", PRODUCT_IN_URL, 1).alias("product"),
        F.regexp_extract("url", BRAND_IN_URL, 1).alias("brand"),
        F.regexp_extract("url", MODEL_IN_URL, 1).alias("model"),
        "url",
    )


def versioned(spark: SparkSession, d: str) -> DataFrame:
    """Product rows spread over two majors with up to three minors each."""
    return products(spark, d).withColumns(
        {"major": (F.col("id") % 2 + 1).cast("int"), "minor": (F.col("id") % 3).cast("int")}
    )


def alias_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Redirects of pages with a query to the URL without it, after an older target of the same URL."""
    p = table(spark, d, "pages").filter(F.contains("url", F.lit("?")))
    now = p.select(F.col("page_id").alias("seq"), "url", F.substring_index("url", "?", 1).alias("new_url"))
    old = p.select(
        (F.col("page_id") - 1_000_000_000).alias("seq"),
        "url",
        F.concat(F.lit("http://old.example.com/"), F.col("page_id").cast("string")).alias("new_url"),
    )
    return now.unionByName(old)


def aliases(spark: SparkSession, d: str) -> DataFrame:
    return reduce_aliases(alias_pairs(spark, d))


def page_store(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the URL they were found at. Links to a place inside a page were not fetched."""
    p = table(spark, d, "pages").filter(~F.endswith("url", F.lit("#top")))
    at = F.substring_index("url", "?", 1)
    return p.groupBy(at.alias("url")).agg(F.min_by("html", "page_id").alias("html"))


def _numbered_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("hit"), F.col("url").alias("link"))


def _hits(asking: DataFrame, n: int, a: int, b: int, c: Column) -> DataFrame:
    ranked = asking.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(RANKS))))
    return ranked.withColumn("hit", (F.col("first") * a + F.col("rank") * b + c) % n)


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits of every product's search and of searches for each model an answer may name."""
    rows = products(spark, d)
    n = table(spark, d, "pages").count()
    own = rows.groupBy("product", "brand", "model").agg(F.min("id").alias("first"))
    pairs = rows.groupBy("product", "brand").agg(F.min("id").alias("first"))
    named = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(NAMED_MODELS - 1))))
    named = named.withColumn("model", F.concat(F.lit("m"), F.col("k").cast("string")))
    cols = ["product", "brand", "model", "rank", "hit", "first"]
    hits = (
        _hits(own, n, 7, 13, F.lit(0)).select(*cols)
        .unionByName(_hits(named, n, 11, 17, F.col("k") * 29).select(*cols))
    )
    links = _numbered_links(spark, d)
    return hits.join(links, "hit").select(
        "product", "brand", "model", search_query("brand", "model", "product").alias("query"), "rank",
        F.concat(F.lit("T"), F.col("hit").cast("string")).alias("title"), "link", "hit", "first",
    )


def search_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The hits as stored JSON bodies; some searches failed, some found nothing."""
    h = search_hits(spark, d)
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "title", "link"))),
        lambda x: F.struct(x["title"].alias("title"), x["link"].alias("link")),
    )
    q = h.groupBy("query").agg(items.alias("items"), F.min("first").alias("first"), F.min("model").alias("model"))
    good = F.to_json(F.struct("items"))
    body = (
        F.when(F.col("model") == "m5", F.lit('{"error": {"code": 429}, "items": []}'))
        .when(F.col("first") % 17 == 0, F.lit('{"kind": "search"}'))
        .otherwise(good)
    )
    return q.select("query", body.alias("body"))


def search_results(spark: SparkSession, d: str) -> DataFrame:
    return scan_search_results(search_bodies(spark, d))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Every `(product, brand, url)` a question may be about, with the page number that decides the answer."""
    own = products(spark, d).select("product", "brand", squeeze_url("url").alias("link"), F.col("id").alias("h"))
    hit = search_hits(spark, d).select("product", "brand", drop_slash("link").alias("link"), F.col("hit").alias("h"))
    both = resolve_alias(own.unionByName(hit), aliases(spark, d), "link", "url")
    both = both.select("product", "brand", drop_slash("url").alias("url"), "h")
    return both.groupBy("product", "brand", "url").agg(F.min("h").alias("h"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers in the shapes models give them: mixed case, reasons, quotes, full stops."""
    q = asked(spark, d)
    h = F.col("h")
    named = lambda n: F.concat(F.lit("M"), (n % NAMED_MODELS).cast("string"))

    def answers(kind: str, text: Column, given: Column) -> DataFrame:
        # A question whose answer failed is stored without one.
        said = F.when(given, text).alias("response")
        return q.select(F.lit(kind).alias("query_type"), "product", "brand", "url", said)

    link = (
        F.when(h % 7 == 0, F.lit("False\nreason: third party"))
        .when(h % 7 == 1, F.lit("Catalog\nIt's a lineup"))
        .when(h % 7 == 2, F.lit("Unsure"))
        .otherwise(F.lit("True \nIt's official"))
    )
    pick = F.when(h % 5 == 4, F.lit(" '' ")).otherwise(F.concat(F.lit("'"), named(h), F.lit("'.")))
    page = (
        F.when(h % 5 == 0, F.lit("True"))
        .when(h % 5 == 1, F.concat(F.lit("False\n"), named(h)))
        .when(h % 5 == 2, F.lit("False."))
        .when(h % 5 == 3, F.lit("TRUE\nlooks official"))
        .otherwise(F.concat(F.lit("false\n'"), named(h + 1), F.lit("'")))
    )
    hits = search_hits(spark, d).select("product", "brand", link_prefix(drop_slash("link")).alias("url")).distinct()
    size = F.length("brand") + F.length("url")
    brand = hits.select(
        F.lit(BRAND_CHECK).alias("query_type"), "product", "brand", "url",
        F.when(size % 11 == 7, None).when(size % 4 == 0, "False").otherwise(" 'True'.").alias("response"),
    )
    own = products(spark, d).select("product", "brand", squeeze_url("url").alias("link"), F.col("id").alias("h"))
    own = resolve_alias(own, aliases(spark, d), "link", "url").groupBy("product", "brand", "url").agg(
        F.min("h").alias("h")
    )
    name = F.when(h % 13 == 1, None).when(h % 11 == 0, F.lit("Title uninformative.")).otherwise(
        F.concat(F.lit(" Model 'X"), h.cast("string"), F.lit("' \nbecause of the title"))
    )
    names = own.select(
        F.lit(NAME_UPDATE).alias("query_type"), "product", "brand", "url", name.alias("response")
    )
    return (
        answers(URL_CHECK, link, h % 23 != 5)
        .unionByName(answers(CATALOG_PICK, pick, (h % 7 == 1) & (h % 29 != 1)))
        .unionByName(answers(PAGE_CHECK, page, h % 31 != 3))
        .unionByName(brand)
        .unionByName(names)
    )


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}
_TABLES: dict[tuple[str, str, str], str] = {}
BUCKETS = 8


def stored(name: str, spark: SparkSession, d: str) -> DataFrame:
    """An input as the stored table it would be, written once per session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        make = {
            "page_store": page_store, "aliases": aliases, "responses": responses,
            "search_bodies": search_bodies, "search_results": search_results,
        }[name]
        _WRITTEN[key] = stage(make(spark, d), name)
    return _WRITTEN[key]


def bucketed(name: str, spark: SparkSession, d: str) -> str:
    """Name of an input kept as a bucketed table, written once per session."""
    key = (spark.sparkContext.applicationId, d, f"bucketed {name}")
    if key not in _WRITTEN:
        save = {
            "pages": lambda t: save_page_store(table(spark, d, "pages"), t, BUCKETS),
            "page_store": lambda t: save_page_store(page_store(spark, d), t, BUCKETS),
            "captures": lambda t: save_capture_store(captures(spark, d), t, BUCKETS),
        }[name]
        kept = f"{name}_{uuid.uuid4().hex}"
        save(kept)
        _WRITTEN[key] = spark.table(kept)
        _TABLES[key] = kept
    return _TABLES[key]


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Events as captures of a page for each user, some of them failed or of another kind."""
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_id").alias("capture_id"),
        "ts",
        F.when(F.col("event_type").isin("view", "click"), "200").otherwise("404").alias("status"),
        F.when(F.col("value") < 20, "text/html").otherwise("application/pdf").alias("mime"),
        F.col("props").alias("html"),
    )


def without_category(rows: DataFrame) -> DataFrame:
    """Rows of which some have lost their category."""
    return rows.withColumn("product", F.when(F.col("id") % 19 != 3, F.col("product")))


def stores(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables the checks read."""
    return {n: stored(n, spark, d) for n in ("aliases", "responses")} | {"pages": stored("page_store", spark, d)}


def answer_texts(spark: SparkSession, d: str) -> DataFrame:
    """Answer-shaped texts made of the conversation turns, in every shape a verdict may take."""
    c = table(spark, d, "conversations")
    k = (F.col("conv_id") * 7 + F.col("turn")) % 12
    t = F.col("text")
    r = (
        F.when(k == 0, F.lit("True"))
        .when(k == 1, F.concat(F.lit("False\n"), t))
        .when(k == 2, F.concat(F.lit("Catalog\n"), t))
        .when(k == 3, F.lit("Unsure"))
        .when(k == 4, F.concat(F.lit(" 'True' because "), t))
        .when(k == 5, F.lit("FALSE."))
        .when(k == 6, F.concat(F.lit("True\n"), t))
        .when(k == 7, F.concat(F.lit("false\n\n"), t))
        .when(k == 8, F.lit(""))
        .when(k == 9, F.concat(F.lit("  "), t, F.lit(".\n")))
        .when(k == 10, F.lit("False reason"))
    )
    return c.select("conv_id", "turn", r.alias("r"), t.alias("text"))
