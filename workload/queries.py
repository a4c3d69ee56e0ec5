"""One query per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline import schemas
from shelfline.functions import keywords, sqlfuncs, text, urls, verdicts
from shelfline.functions.base import bind
from shelfline.operators import dataset, rows, search, stores, versions
from shelfline.operators.classify import classify_page, facts_of, fetch_and_check, rule_check
from shelfline.plans import clean, collect, find, requests
from shelfline.session import fresh_path, stage
from shelfline.sources import buckets, keyed, readers, sinks
from shelfline.streaming.verdicts import check_rows, final_rows, judge_rows, read_verdicts, stream_verdicts
from workload import inputs
from workload.inputs import RULES, answer_texts, products, stored, table, versioned, without_category
from workload.terms import PRODUCT_TERMS, UNAVAILABLE_TERMS, URL_TERMS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# Flagship


@query
def page_rules(spark, d):
    """Rule part of the page check, counted per category."""
    p = _pages(spark, d).select(
        F.regexp_extract("url", inputs.PRODUCT_IN_URL, 1).alias("product"),
        F.regexp_extract("url", inputs.BRAND_IN_URL, 1).alias("brand"),
        "url",
        bind(
            F.lower(text.extract_text("html")),
            lambda t: F.struct(
                keywords.any_term(t, PRODUCT_TERMS).alias("hit"),
                keywords.is_unavailable(t, UNAVAILABLE_TERMS).alias("gone"),
            ),
        ).alias("f"),
    )
    ok = rule_check(F.col("f.hit"), "url", "brand", RULES)
    one = lambda c: F.sum(c.cast("long"))
    return p.groupBy("product").agg(
        F.count(F.lit(1)).alias("n_pages"),
        one(ok).alias("n_by_rules"),
        one(F.col("f.gone")).alias("n_unavailable"),
        one(ok & ~F.col("f.gone")).alias("n_live"),
    )


# Scans


def category_lines(spark, d) -> DataFrame:
    k = F.col("doc_id")
    line = (
        F.when(k % 11 == 0, F.concat(F.lit("## Heading "), F.col("source")))
        .when(k % 13 == 0, F.lit("   "))
        .when(k % 17 == 0, F.lit("#"))
        .otherwise(F.concat(F.lit("  Cat "), F.upper("lang"), F.lit(" "), k.cast("string"), F.lit(" ")))
    )
    return table(spark, d, "documents").select("doc_id", line.alias("value"))


@query
def scan_categories(spark, d):
    path = fresh_path(spark, "categories")
    category_lines(spark, d).orderBy("doc_id").select("value").write.text(path)
    return readers.scan_categories(spark, path)


@query
def scan_products(spark, d):
    p = products(spark, d)
    k = F.col("id") % 4
    odd = F.when(k == 0, F.concat("model", F.lit(', 1/2" kit'))).when(k == 1, F.concat(F.lit(" "), "model"))
    path = fresh_path(spark, "products")
    sinks.export_csv(p.withColumn("model", F.coalesce(odd, "model")), path)
    return readers.scan_products(spark, path)


@query
def scan_url_aliases(spark, d):
    pairs = inputs.alias_pairs(spark, d)
    bad = pairs.select(
        (F.col("seq") + 1_000_000_000).alias("seq"), "url", F.concat(F.lit("x|"), "new_url").alias("new_url")
    )
    lines = pairs.unionByName(bad).repartitionByRange("seq").sortWithinPartitions("seq").select("url", "new_url")
    path = fresh_path(spark, "aliases")
    lines.write.option("header", True).option("sep", "|").option("quote", "").csv(path)
    return readers.scan_url_aliases(spark, path)


@query
def scan_page_store(spark, d):
    path = fresh_path(spark, "pages")
    _pages(spark, d).select("url", "html").write.parquet(path)
    s = readers.scan_page_store(spark, path)
    return s.select("url", urls.cache_key("pages/", "url").alias("cache_key"), F.md5("html").alias("html_md5"))


@query
def scan_responses(spark, d):
    path = fresh_path(spark, "responses")
    inputs.responses(spark, d).write.parquet(path)
    return readers.scan_responses(spark, path, stores.PAGE_CHECK)


@query
def scan_search_results(spark, d):
    return readers.scan_search_results(stored("search_bodies", spark, d))


@query
def capture_asof(spark, d):
    until = F.to_timestamp_ntz(F.lit("2024-01-20 12:00:00"))
    best = readers.capture_asof_stored(spark, inputs.bucketed("captures", spark, d), until)
    return best.select("url", "capture_id", F.date_format("ts", "yyyyMMddHHmmss").alias("at"), "html")


# Sinks


@query
def write_version(spark, d):
    path = fresh_path(spark, "versions")
    p = products(spark, d)
    first = p.withColumns({"major": F.lit(1), "minor": F.lit(0)})
    sinks.write_version(first, path)
    sinks.write_version(first.withColumn("minor", F.lit(1)).filter(F.startswith("url", F.lit("https"))), path)
    return spark.read.parquet(path).select(
        "id", F.col("product").cast("string").alias("product"), "brand", "model", "url", "major", "minor"
    )


@query
def write_version_files(spark, d):
    """Two versions as named files, read back."""
    path = fresh_path(spark, "named")
    p = products(spark, d).withColumns({"major": F.lit(1), "minor": F.lit(0)})
    sinks.write_version_files(p, path, rows_per_file=100)
    sinks.write_version_files(p.withColumn("minor", F.lit(1)).filter(F.startswith("url", F.lit("https"))), path)
    return readers.scan_versioned_products(spark, path)


@query
def publish_latest_files(spark, d):
    """Latest versions of a tree of files, in which half of the categories were never cleaned."""
    path = fresh_path(spark, "latest")
    p = products(spark, d).withColumns({"major": F.lit(1), "minor": F.lit(0)})
    sinks.write_version_files(p, path)
    cleaned = p.filter(F.startswith("url", F.lit("https")) & (F.col("product") < "es")).withColumn("minor", F.lit(2))
    sinks.write_version_files(cleaned, path, rows_per_file=50)
    sinks.publish_latest_files(spark, path)
    return readers.scan_latest(spark, path)


def _checked(spark, d) -> DataFrame:
    return clean.check_products(
        products(spark, d), stored("search_results", spark, d), rules=RULES, **inputs.stores(spark, d)
    )


@query
def write_kept_dropped(spark, d):
    path = fresh_path(spark, "outcome")
    sinks.write_kept_dropped(_checked(spark, d), path)
    return spark.read.parquet(path).select(
        "id", "product", "brand", "model", "url", "resolved_url", F.col("outcome").cast("string").alias("outcome")
    )


@query
def write_pages_content(spark, d):
    path = fresh_path(spark, "content")
    p = products(spark, d).join(table(spark, d, "pages").select("url", "html"), "url").select(
        "product", "id", F.md5("html").alias("html"), F.lit("old").alias("content")
    )
    sinks.write_pages_content(p, path)
    again = _pages(spark, d).select(
        F.regexp_extract("url", inputs.PRODUCT_IN_URL, 1).alias("product"),
        F.col("page_id").alias("id"),
        F.md5("html").alias("html"),
        F.md5(text.extract_text("html")).alias("content"),
    )
    sinks.write_pages_content(again.filter(F.col("product") != "de"), path)
    return spark.read.parquet(path).select("id", F.col("product").cast("string").alias("product"), "html", "content")


@query
def append_aliases(spark, d):
    path = fresh_path(spark, "aliases")
    fetched = stores.resolve_alias(products(spark, d).select("id", "url"), inputs.aliases(spark, d))
    secure = F.startswith("url", F.lit("https"))
    # Everything led elsewhere before; half of it moves on in a second batch, the rest in a third.
    older = fetched.withColumn("new_url", F.when(F.col("url") != F.col("new_url"), F.concat("new_url", F.lit("/old"))))
    sinks.append_aliases(older, path)
    sinks.append_aliases(fetched.filter(secure), path)
    sinks.append_aliases(fetched.filter(~secure), path)
    return readers.scan_alias_store(spark, path)


@query
def merge_responses(spark, d):
    path = fresh_path(spark, "answers")
    r = stored("responses", spark, d)
    key = ["query_type", *stores.QUESTION]
    old = r.filter(F.startswith("url", F.lit("https")) & F.col("response").isNotNull())
    old.write.parquet(path)
    fresh = r.withColumn("response", F.upper("response"))
    sinks.merge_responses(fresh.union(fresh), old, path, key)
    return spark.read.parquet(path)


@query
def bucketed_answers(spark, d):
    """`merge_responses` on a store in buckets: two merges, each made twice, then one generation of many."""
    path = fresh_path(spark, "buckets")
    r = stored("responses", spark, d)
    buckets.merge_answers(r.filter(F.startswith("url", F.lit("https"))), path, 8)
    fresh = r.withColumn("response", F.upper("response"))
    for _ in range(2):
        buckets.merge_answers(fresh.union(fresh), path)
    buckets.compact(spark, path, schemas.RESPONSES, buckets.ANSWER_KEY, most=1)
    return buckets.read_answers(spark, path)


@query
def bucketed_redirects(spark, d):
    """`append_aliases` on a store in buckets."""
    path = fresh_path(spark, "buckets")
    fetched = stores.resolve_alias(products(spark, d).select("url"), inputs.aliases(spark, d))
    older = fetched.withColumn("new_url", F.when(F.col("url") != F.col("new_url"), F.concat("new_url", F.lit("/old"))))
    for moved in (older, fetched, fetched):
        buckets.merge_redirects(moved, path, 8)
    return buckets.read_redirects(spark, path)


@query
def write_updated_names(spark, d):
    path = fresh_path(spark, "names")
    named = collect.refresh_model_names(products(spark, d), **inputs.stores(spark, d))
    sinks.write_updated_names(named, path)
    return spark.read.parquet(path).select(
        "id", F.col("product").cast("string").alias("product"), "brand", "model", "url"
    )


# Version catalog


def version_listing(spark, d) -> DataFrame:
    """File names as a folder listing gives them, leftovers included."""
    k = F.col("id")
    n = lambda c: c.cast("string")
    lead = F.when(k % 10 == 9, "temp_").when(k % 10 == 8, "dropped_").otherwise("")
    path = F.concat(
        F.lit("/data/"), "product", F.lit("/"), lead, F.lit("products_v"), n(k % 5), F.lit("."), n(k % 13), F.lit(".csv")
    )
    return products(spark, d).select("product", path.alias("path"))


def _versions(spark, d) -> DataFrame:
    return versions.parse_versions(version_listing(spark, d))


def _categories(spark, d) -> DataFrame:
    """Categories with versions and, from the part types, some without."""
    return products(spark, d).select("product").union(table(spark, d, "part").select(F.lower("p_type"))).distinct()


@query
def latest_version(spark, d):
    v, c = _versions(spark, d), _categories(spark, d)
    a = versions.latest_version(v, c).withColumn("custom", F.lit(-1))
    b = versions.latest_version(v, c, custom_major=2).withColumn("custom", F.lit(2))
    return a.unionByName(b)


@query
def next_version(spark, d):
    v, c = _versions(spark, d), _categories(spark, d)
    latest = versions.latest_version(v, c)
    return (
        versions.next_version(latest, minor_bump=True).withColumn("bump", F.lit("minor"))
        .unionByName(versions.next_version(latest, minor_bump=False).withColumn("bump", F.lit("major")))
        .unionByName(
            versions.next_version(versions.latest_version(v, c, 2), True, 2).withColumn("bump", F.lit("minor of 2"))
        )
    )


@query
def select_version(spark, d):
    v = without_category(versioned(spark, d))
    latest = versions.latest_version(v, v)
    newest = versions.select_version(v, versions.source_version(latest))
    custom = versions.source_version(versions.latest_version(v, v, 1), custom_major=1, custom_minor=0)
    return newest.withColumn("which", F.lit("latest")).unionByName(
        versions.select_version(v, custom).withColumn("which", F.lit("custom"))
    )


@query
def publish_latest(spark, d):
    v = versioned(spark, d)
    published = v.filter(F.col("product") == "en").select("product").distinct()
    return versions.publish_latest(v, versions.latest_version(v, v), published)


@query
def existing_categories(spark, d):
    v, c = _versions(spark, d), _categories(spark, d)
    there = versions.existing_categories(c, v).withColumn("there", F.lit(True))
    return there.unionByName(versions.missing_categories(c, v).withColumn("there", F.lit(False)))


# Rows and URLs


@query
def category_slice(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("product"))
    part = rows.category_slice(c, 40, 100).withColumn("num", F.lit(100))
    return part.unionByName(rows.category_slice(c, 150).withColumn("num", F.lit(-1)))


@query
def head_per_category(spark, d):
    p = without_category(products(spark, d))
    few = rows.head_per_category(p, 7).withColumn("n", F.lit(7))
    many = rows.head_per_category(p, 1_200).withColumn("n", F.lit(1_200))
    return few.unionByName(many)


def _url_variants(spark, d) -> DataFrame:
    """Page URLs with the irregularities the URL operators handle, by page number."""
    k = F.col("page_id")
    url = (
        F.when(k % 10 == 1, F.concat("url", F.lit("//")))
        .when(k % 10 == 2, F.concat(F.lit(" "), "url", F.lit(" x")))
        .when(k % 10 == 3, F.concat("url", F.lit(".pdf")))
        .when(k % 10 == 4, F.concat("url", F.lit(".PDF")))
        .when(k % 10 == 5, F.substring_index("url", "://", -1))
        .when(k % 10 == 6, F.replace("url", F.lit("example"), F.lit("Amazon")))
        .when(k % 10 == 7, F.concat(F.lit("web://"), "url", F.lit(".html?x.html")))
        .when(k % 10 == 8, F.substring_index("url", "/", 3))
        .when(k % 10 == 9, F.upper("url"))
        .when(k % 50 != 0, F.col("url"))
    )
    p = products(spark, d).withColumnRenamed("id", "page_id").drop("url")
    brand = F.when(k % 3 == 0, F.replace("brand", F.lit("t"), F.lit("é-T_"))).when(
        k % 12 == 4, F.lit("Amazon Basics")).otherwise(F.col("brand"))
    return table(spark, d, "pages").select("page_id", url.alias("url")).join(
        p.select("page_id", "product", brand.alias("brand"), "model"), "page_id"
    )


def _url_query(name: str, **cols: Callable[[], Column]) -> None:
    def run(spark, d):
        return _url_variants(spark, d).select("page_id", *[c().alias(n) for n, c in cols.items()])

    QUERIES[name] = run


_url_query("normalize_url", squeezed=lambda: urls.squeeze_url("url"), no_slash=lambda: urls.drop_slash("url"))
_url_query("pdf_guard", guarded=lambda: urls.pdf_guard("url"))
_url_query("url_has_path", has_path=lambda: urls.url_has_path("url"))
_url_query(
    "url_blocklisted",
    folded=lambda: urls.url_blocklisted("url", URL_TERMS + ["tion"]),
    exact=lambda: urls.url_blocklisted("url", URL_TERMS + ["tion"], fold_case=False),
)
_url_query("marketplace_guard", allowed=lambda: urls.marketplace_guard("url", "brand"))
_url_query("url_core", core=lambda: urls.url_core("url"))
_url_query("link_prefix", prefix=lambda: urls.link_prefix("url"))
_url_query("brand_in_link", hit=lambda: urls.brand_in_link("brand", urls.link_prefix("url")))
_url_query(
    "cache_key",
    cache_key=lambda: urls.cache_key("llm_responses/check_url/", "url"),
    short_key=lambda: urls.cache_key("pages/", F.repeat("url", 5)),
)
_url_query("search_query", search=lambda: urls.search_query("brand", "model", "product"))


# Text


@query
def extract_text(spark, d):
    return _pages(spark, d).select("page_id", text.extract_text("html").alias("text"))


@query
def extract_title(spark, d):
    return _pages(spark, d).select("page_id", text.extract_title("html").alias("title"))


@query
def clean_title(spark, d):
    c = table(spark, d, "conversations")
    t = F.concat(F.lit("\n\t"), F.translate("text", ",.", "—–"), F.lit(" | a-b  "))
    return c.select("conv_id", "turn", text.clean_title(t).alias("title"))


@query
def clean_label(spark, d):
    k = F.col("p_partkey")
    label = (
        F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(". **"), "p_name", F.lit("** (new)")))
        .when(k % 5 == 1, F.concat(F.lit("St. "), "p_name", F.lit(". Co")))
        .when(k % 5 == 2, F.concat(F.lit("  "), "p_brand", F.lit(" & 'x'  /y\\z? ")))
        .when(k % 5 == 3, F.concat("p_brand", F.lit("+=!*\"%:;")))
        .otherwise(F.col("p_name"))
    )
    return table(spark, d, "part").select(
        "p_partkey",
        text.clean_label(label).alias("label"),
        text.clean_label(label, numbered_only=True).alias("numbered_only"),
    )


@query
def first_n_words(spark, d):
    return _documents(spark, d).select("doc_id", text.first_n_words("text", 30).alias("words"))


@query
def truncate_to_budget(spark, d):
    return _documents(spark, d).select(
        "doc_id",
        F.md5(text.truncate_to_budget("text", 200)).alias("cut_200"),
        F.md5(text.truncate_to_budget("text")).alias("cut_default"),
    )


def _answer_query(name: str, **cols: Callable[[], Column]) -> None:
    def run(spark, d):
        return answer_texts(spark, d).select("conv_id", "turn", *[c().alias(n) for n, c in cols.items()])

    QUERIES[name] = run


_answer_query("strip_quotes", plain=lambda: text.strip_quotes(F.replace("text", F.lit(","), F.lit('"'))))
_answer_query(
    "clean_response",
    lowered=lambda: text.clean_response("r"),
    cased=lambda: text.clean_response("r", keep_case=True),
)
_answer_query("first_line", line=lambda: text.first_line("text"))


def list_answers(spark, d) -> DataFrame:
    """Semicolon-delimited answers as a model lists products: one per part type and price band."""
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://shop.example/"), k.cast("string"))
    line = (
        F.when(k % 9 == 0, F.concat(F.lit("Sure, here is more on "), "p_name"))
        .when(k % 9 == 1, F.concat_ws(";", "p_brand", "p_name", url, F.lit("extra")))
        .when(k % 9 == 2, F.concat(F.lit("  "), F.concat_ws(";", "p_brand", "p_name", url), F.lit(";  ")))
        .when(k % 9 == 3, F.concat_ws(";", "p_brand", F.concat("p_name", F.lit(", blue")), url))
        .when(k % 9 == 4, F.lit(""))
        .otherwise(F.concat(k.cast("string"), F.lit(". "), F.concat_ws(";", "p_brand", "p_name", url)))
    )
    band = F.floor(k / 50)
    p = table(spark, d, "part").select("p_type", band.alias("band"), k.alias("k"), line.alias("line"))
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    head = F.when(F.col("band") % 2 == 0, F.lit("Brand;Model;URL\n")).otherwise(F.lit(""))
    return p.groupBy("p_type", "band").agg(text_.alias("t")).select(
        F.concat(F.lower("p_type"), F.lit(" "), F.col("band").cast("string")).alias("product"),
        F.concat(head, "t").alias("response"),
    )


@query
def parse_product_lines(spark, d):
    return rows.parse_product_lines(list_answers(spark, d)).drop("line")


def _questions(spark, d) -> DataFrame:
    """Every kind of question about every page."""
    kinds = [stores.URL_CHECK, stores.BRAND_CHECK, stores.CATALOG_PICK, stores.PAGE_CHECK, stores.NAME_UPDATE]
    p = products(spark, d).select("product", "brand", "model", "url")
    return p.withColumn("query_type", F.explode(F.array(*[F.lit(k) for k in kinds])))


@query
def build_requests(spark, d):
    r = requests.build_requests(_questions(spark, d), spark.table(inputs.bucketed("pages", spark, d)))
    # Compared by what fills the template, not by its wording.
    said = F.col("request")
    kind = F.col("query_type")
    return r.select(
        "query_type",
        "product",
        "brand",
        "url",
        F.contains(said, F.col("product")).alias("names_product"),
        F.when(kind.isin(stores.PAGE_CHECK, stores.CATALOG_PICK), F.md5(F.regexp_replace(said, r"^[^\n]*\n", "")))
        .when(kind == stores.BRAND_CHECK, F.contains(said, F.col("url")).cast("string"))
        .when(kind == stores.URL_CHECK, F.contains(said, urls.url_core("url")).cast("string"))
        .otherwise(F.contains(said, F.col("brand")).cast("string"))
        .alias("filled"),
    )


# Keywords


@query
def product_keyword_hit(spark, d):
    return _documents(spark, d).select("doc_id", keywords.product_keyword_hit("text", PRODUCT_TERMS).alias("hit"))


@query
def unavailable_counts(spark, d):
    m = keywords.unavailable_counts("text", UNAVAILABLE_TERMS + ["the", "anan"])
    return _documents(spark, d).select("doc_id", F.to_json(m).alias("counts"))


@query
def unavailable_terms(spark, d):
    found = dataset.unavailable_report(_pages(spark, d), UNAVAILABLE_TERMS + ["thth"], text.extract_text("html"), "page_id")
    return found.select(
        "page_id",
        F.array_join("terms", "|").alias("terms"),
        F.array_join(F.transform("counts", lambda n: n.cast("string")), "|").alias("counts"),
        "total",
        "unavailable",
    )


@query
def unavailable_hits(spark, d):
    hits = dataset.unavailable_hits(_documents(spark, d), UNAVAILABLE_TERMS + ["the"], F.col("text"), "doc_id")
    long = hits.select(F.col("doc_id").cast("string").alias("key"), "term", F.col("n").cast("long").alias("n"))
    totals = dataset.term_totals(hits).select(F.lit("all").alias("key"), "term", F.col("n_hits").alias("n"))
    return long.unionByName(totals)


@query
def sql_term_hits(spark, d):
    """Titles and term hits of pages, said in SQL."""
    sqlfuncs.register(spark)
    terms = ", ".join(f"'{t}'" for t in UNAVAILABLE_TERMS + ["thth"])
    return spark.sql(
        f"""SELECT page_id, title, term, n
        FROM (SELECT page_id, clean_title(extract_title(html)) AS title, extract_text(html) AS said FROM {{pages}}),
        LATERAL term_hits(said, array({terms}))""",
        pages=_pages(spark, d),
    )


@query
def sql_product_lines(spark, d):
    """Listed answers as rows, said in SQL."""
    sqlfuncs.register(spark)
    return spark.sql(
        "SELECT a.product, l.brand, l.model, l.url FROM {answers} a, LATERAL product_lines(a.product, a.response) l",
        answers=list_answers(spark, d),
    )


# Verdicts

_answer_query("verdict_url", verdict=lambda: verdicts.verdict_url("r"))
_answer_query("catalog_model", model=lambda: verdicts.catalog_model("r"))
_answer_query(
    "verdict_page",
    verdict=lambda: verdicts.verdict_page("r")["verdict"],
    model=lambda: verdicts.verdict_page("r")["model"],
    loose=lambda: verdicts.verdict_page("r", strict=False)["verdict"],
)
_answer_query("verdict_brand", verdict=lambda: verdicts.verdict_brand("r"))


# Joins


@query
def resolve_alias(spark, d):
    return stores.resolve_alias(products(spark, d).select("id", "url"), inputs.aliases(spark, d))


@query
def lookup_pages(spark, d):
    r = stores.resolve_alias(products(spark, d).select("id", "url"), stored("aliases", spark, d))
    got = stores.lookup_pages(r, spark.table(inputs.bucketed("page_store", spark, d)), "new_url")
    return got.select("id", "new_url", F.md5("html").alias("html_md5"))


@query
def pending_fetch(spark, d):
    hits = inputs.search_hits(spark, d).select(urls.drop_slash("link").alias("url"))
    wanted = hits.unionByName(products(spark, d).select("url"))
    return stores.pending_fetch(wanted, stored("page_store", spark, d), stored("aliases", spark, d))


@query
def pending_requests(spark, d):
    q = inputs.asked(spark, d).withColumn(
        "query_type", F.explode(F.array(F.lit(stores.URL_CHECK), F.lit(stores.PAGE_CHECK)))
    )
    asked = stores.pending_requests(q.drop("h"), stored("responses", spark, d))
    usable = readers.usable_searches(stored("search_bodies", spark, d))
    searches = stores.pending_searches(inputs.search_hits(spark, d), usable)
    none = F.lit("")
    return asked.unionByName(
        searches.select(
            F.lit("search").alias("query_type"), none.alias("product"), none.alias("brand"), F.col("query").alias("url")
        )
    )


@query
def lookup_verdicts(spark, d):
    kinds = [stores.URL_CHECK, stores.CATALOG_PICK, stores.PAGE_CHECK]
    return stores.lookup_verdicts(stored("responses", spark, d), kinds)


@query
def exclude_known_brands(spark, d):
    p = products(spark, d)
    # Brands met on secure pages are known, in another case.
    existing = p.filter(F.startswith("url", F.lit("https"))).withColumn("brand", F.initcap("brand"))
    return rows.exclude_known_brands(p, existing)


@query
def apply_updates(spark, d):
    p = without_category(products(spark, d))
    checked = p.select(
        "product", "id", F.concat("model", F.lit("x")).alias("new_model"), F.upper("url").alias("new_url"),
        F.when(F.col("id") % 3 != 0, "kept").otherwise("dropped").alias("outcome"),
    )
    return rows.apply_updates(p, checked)


@query
def apply_model_names(spark, d):
    p = without_category(products(spark, d))
    names = p.filter(F.startswith("url", F.lit("https"))).select(
        "product", "id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("New "), "model")).alias("new_model")
    )
    return rows.apply_model_names(p, names)


# Aggregates


def _part_rows(spark, d) -> DataFrame:
    """Parts as product rows: six categories, 25 brands in mixed case."""
    brand = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select(
        F.col("p_type").alias("product"), brand.alias("brand"), F.col("p_name").alias("model"),
        F.concat(F.lit("https://shop.example/"), F.col("p_size").cast("string"), F.lit("/"), "p_name").alias("url"),
        F.col("p_partkey").alias("id"),
    )


@query
def brand_quota(spark, d):
    p = products(spark, d).select("product", "brand").union(_part_rows(spark, d).select("product", "brand"))
    return dataset.brand_quota(p, _categories(spark, d).union(p.select("product")))


@query
def dataset_counts(spark, d):
    return dataset.dataset_counts(_part_rows(spark, d))


@query
def products_per_brand(spark, d):
    return dataset.products_per_brand(products(spark, d))


@query
def dataset_audit(spark, d):
    p = products(spark, d)
    odd = p.withColumns(
        {
            "brand": F.when(F.col("id") % 29 != 3, F.col("brand")),
            "model": F.when(F.col("id") % 31 == 4, F.lit(" ")).otherwise(F.col("model")),
            "url": F.when(F.col("id") % 5 == 0, F.concat(F.lit("same/"), "brand")).otherwise(F.col("url")),
        }
    )
    return dataset.dataset_audit(odd, min_brands=25)


@query
def group_urls_by_brand(spark, d):
    p = products(spark, d).withColumn("brand", F.when(F.col("id") % 29 != 3, F.col("brand")))
    return rows.group_urls_by_brand(p)


# Windows


@query
def dedupe_url(spark, d):
    p = products(spark, d).withColumn("url", F.when(F.col("id") % 37 != 5, F.substring_index("url", "/", 4)))
    return rows.dedupe_url(p)


@query
def first_page_per_brand(spark, d):
    p = products(spark, d).withColumn("has_page", F.col("id") % 3 != 0)
    return rows.first_page_per_brand(p).drop("has_page")


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    s = inputs.stores(spark, d)
    starts = products(spark, d).select(*search.STATE).distinct()
    states = search.reachable_states(starts, s["responses"], RULES)
    cand = stage(search.gated_candidates(states, stored("search_results", spark, d), s["responses"], RULES), "candidates")
    checks = fetch_and_check(cand, rules=RULES, **s)
    return starts, search.judge_candidates(cand, checks)


@query
def first_search_match(spark, d):
    return search.first_search_match(_judged(spark, d)[1])


@query
def balanced_subset(spark, d):
    return rows.balanced_subset(products(spark, d)).select("product", "brand", "id", "model", "url")


# Sets and order


@query
def union_categories(spark, d):
    p = products(spark, d)
    # One table per share of the categories, all of them together, with its columns in another order.
    cols = p.columns
    share = F.pmod(F.xxhash64("product"), F.lit(4))
    parts = [p.filter(share == i).select(*(cols[i:] + cols[:i])) for i in range(4)]
    return rows.union_categories(parts)


@query
def kept_dropped_partition(spark, d):
    kept, dropped, open_ = rows.kept_dropped(_checked(spark, d))
    # Every row is in exactly one part.
    parts = kept.select("id", "outcome").union(dropped.select("id", "outcome")).union(open_.select("id", "outcome"))
    return parts


@query
def sort_products(spark, d):
    p = rows.sort_products(_part_rows(spark, d))
    return p.select("product", "brand", "model", "id")


# Composites


@query
def classify_page_query(spark, d):
    c = answer_texts(spark, d)
    k = F.col("conv_id") * 5 + F.col("turn")
    again = F.when(k % 4 != 0, F.concat(F.lit("False\n"), "text"))
    out = classify_page(k % 6 != 0, k % 7 == 0, F.col("r"), again, F.col("r"))
    return c.select("conv_id", "turn", out.alias("c")).select("conv_id", "turn", "c.*")


QUERIES["classify_page"] = QUERIES.pop("classify_page_query")


@query
def fetch_and_check_query(spark, d):
    return fetch_and_check(products(spark, d), rules=RULES, **inputs.stores(spark, d))


QUERIES["fetch_and_check"] = QUERIES.pop("fetch_and_check_query")


@query
def search_refine(spark, d):
    return search.search_refine(
        products(spark, d), stored("search_results", spark, d), rules=RULES, **inputs.stores(spark, d)
    )


@query
def check_product(spark, d):
    return _checked(spark, d)


@query
def clean_dataset(spark, d):
    # The base collection 1.0 holds every row, an older cleaning of it some; 1.0 is chosen by hand.
    # Some rows come a second time without their category, with the answers of the first.
    p = products(spark, d)
    # Not a constant, which would leave joins without a key. No URL is that short.
    lost = F.when(F.length("url") < 0, F.col("product"))
    p = p.unionByName(p.filter(F.col("id") % 19 == 3).withColumn("product", lost))
    base = p.withColumns({"major": F.lit(1), "minor": F.lit(0)})
    v = base.unionByName(base.filter(F.startswith("url", F.lit("https"))).withColumn("minor", F.lit(4)))
    kept = inputs.stores(spark, d)
    own = F.regexp_extract("url", inputs.PRODUCT_IN_URL, 1) == F.col("product")
    kept["responses"] = kept["responses"].unionByName(kept["responses"].filter(own).withColumn("product", lost))
    done = clean.clean_dataset(
        v, v.select("product", "major", "minor").distinct(), stored("search_results", spark, d),
        rules=RULES, custom_minor=0, **kept,
    )
    return done.select("id", "product", "brand", "model", "url", "major", "minor")


def _find_inputs(spark, d):
    """Listed answers for the part categories, brands partly known already."""
    answers = list_answers(spark, d)
    cats = answers.select("product").distinct().withColumn(
        "idx", F.regexp_extract("product", "([0-9]+)$", 1).cast("long")
    )
    known = rows.parse_product_lines(answers).filter(F.contains("brand", F.lit("#1")))
    known = known.select("product", "brand", "model", "url", F.lit(1).alias("major"), F.lit(0).alias("minor"))
    resp = answers.select(
        F.lit(stores.SITE_LIST).alias("query_type"), "product", F.lit("").alias("brand"), F.lit("").alias("url"), "response"
    )
    return cats, known, known.select("product", "major", "minor").distinct(), resp


@query
def find_products(spark, d):
    cats, known, versions_, resp = _find_inputs(spark, d)
    found = find.find_products(cats, known, versions_, resp, want=9)
    return found.select("product", "brand", "model", "url", "major", "minor")


@query
def ask_for_products(spark, d):
    """First half of `find_products`: who is asked for how many."""
    cats, known, versions_, _ = _find_inputs(spark, d)
    asked = find.ask_for_products(cats, known, versions_, want=9)
    return asked.select(
        "query_type", "product",
        F.regexp_extract("request", "^Name ([0-9]+) ", 1).cast("int").alias("n_brands"),
        F.regexp_extract("request", "(Leave out what is known: .*?\\. )Aim", 1).alias("excluded"),
    )


@query
def collect_pages(spark, d):
    pages = spark.table(inputs.bucketed("page_store", spark, d))
    got = collect.collect_pages(products(spark, d), stored("aliases", spark, d), pages)
    return got.select("product", "brand", "id", "url", F.md5("html").alias("html_md5"), "content")


@query
def refresh_model_names(spark, d):
    return collect.refresh_model_names(products(spark, d), **inputs.stores(spark, d))


# Streaming


@query
def stream_verdicts_query(spark, d):
    s = inputs.stores(spark, d)
    # A pattern matches one file as well as a folder of part files; a stream cannot be opened on a file itself.
    pages = spark.readStream.schema(table(spark, d, "pages").schema).parquet(f"{d}/pages.parque[t]")
    rows_ = pages.select(
        F.col("page_id").alias("id"),
        F.regexp_extract("url", inputs.PRODUCT_IN_URL, 1).alias("product"),
        F.regexp_extract("url", inputs.BRAND_IN_URL, 1).alias("brand"),
        F.regexp_extract("url", inputs.MODEL_IN_URL, 1).alias("model"),
        "url",
    )
    out = fresh_path(spark, "verdicts")
    facts = stage(facts_of(s.pop("pages"), RULES), "facts")
    q = stream_verdicts(rows_, lambda b: judge_rows(b, pages=facts, rules=RULES, **s), out, fresh_path(spark, "offsets"))
    q.awaitTermination()
    v = read_verdicts(spark, out)
    final = final_rows(v).select("product", "id", F.lit(True).alias("final"))
    return v.join(final, ["product", "id"], "left").select(
        "id", "product", "brand", "model", "url", "new_url", "outcome", F.coalesce("final", F.lit(False)).alias("final")
    )


def stream_checks(spark, d):
    """The whole check and repair as rows arrive, in two batches, with stores opened anew for each."""
    incoming, out = fresh_path(spark, "incoming"), fresh_path(spark, "checked")
    p = products(spark, d)
    p.repartition(2, "id").write.parquet(incoming)
    arriving = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    kept = inputs.stores(spark, d) | {"results": stored("search_results", spark, d)}
    pages = stage(facts_of(kept.pop("pages"), RULES), "facts")

    def open_stores():
        # Read by path, as a store that others append to is.
        reopened = {n: spark.read.schema(df.schema).parquet(*df.inputFiles()) for n, df in kept.items()}
        return reopened | {"pages": pages}

    q = stream_verdicts(arriving, check_rows(open_stores, RULES), out, fresh_path(spark, "offsets"))
    q.awaitTermination()
    v = read_verdicts(spark, out)
    final = final_rows(v).select("product", "id", F.lit(True).alias("final"))
    return v.join(final, ["product", "id"], "left").select(
        "id", "product", "brand", "model", "url", "new_url", "outcome", F.coalesce("final", F.lit(False)).alias("final")
    )


@query
def stream_backlog(spark, d):
    """Rows arrive in two batches, and half of the answers only after the first: its open rows are judged again."""
    incoming, out = fresh_path(spark, "incoming"), fresh_path(spark, "judged")
    p = products(spark, d)
    p.filter("id % 2 = 0").coalesce(1).write.parquet(incoming)
    p.filter("id % 2 = 1").coalesce(1).write.mode("append").parquet(incoming)
    arriving = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    s = inputs.stores(spark, d)
    facts = stage(facts_of(s.pop("pages"), RULES), "facts")
    early = s["responses"].filter(F.length("url") % 2 == 0)
    seen = []

    def answers():
        # The store grows between the batches; each batch opens it once.
        seen.append(early if not seen else s["responses"])
        return seen[-1]

    def judge(batch):
        return judge_rows(batch, s["aliases"], facts, seen[-1], RULES)

    stream_verdicts(arriving, judge, out, fresh_path(spark, "offsets"), answers=answers).awaitTermination()
    return read_verdicts(spark, out).select("id", "product", "brand", "model", "url", "new_url", "outcome")


@query
def keyed_stores(spark, d):
    """Pages and answers written as one file per key, and rows checked from the files."""
    root = fresh_path(spark, "files")
    s = inputs.stores(spark, d)
    own = (F.regexp_extract("url", inputs.PRODUCT_IN_URL, 1) == F.col("product")) & (
        F.regexp_extract("url", inputs.BRAND_IN_URL, 1) == F.col("brand"))
    kinds = [stores.URL_CHECK, stores.CATALOG_PICK, stores.PAGE_CHECK]

    def put(folder, key, body, rows):
        keyed.write_files(rows.select(keyed.file_name(folder, key).alias("name"), F.col(body).alias("body")), f"{root}/{folder}")

    put(stores.PAGE_FOLDER, stores.page_key("url"), "html", s["pages"])
    for kind in kinds:
        told = s["responses"].filter(own & (F.col("query_type") == kind) & F.col("response").isNotNull())
        put(f"{stores.ANSWER_FOLDER}{kind}/", stores.answer_key(kind, "url"), "response", told)
    found = fetch_and_check(
        products(spark, d), s["aliases"], keyed.scan_keyed_pages(spark, root), keyed.scan_keyed_responses(spark, root, kinds), RULES
    )
    return found


QUERIES["stream_verdicts"] = QUERIES.pop("stream_verdicts_query")
QUERIES["stream_checks"] = stream_checks
