"""Scans. Line order inside files matters to several of them and is carried explicitly."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.base import strip
from ..operators.ranking import number_within
from ..operators.versions import parse_versions, version_path

#: What a category's finished version is called.
LATEST = "latest.csv"
# Quoted fields may hold line feeds, so a file is read by one task.
_QUOTED = dict(header=True, escape='"', multiLine=True)

# A line's place: its file, the split of the file it came in, and its order within the split.
_SPOT = ["__path", "__block"]


def _placed(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.select(
        *cols,
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )


def parent_folder(path: Column | str) -> Column:
    """Name of the folder a file lies in, without the `column=` of a partition folder."""
    path = F.col(path) if isinstance(path, str) else path
    raw = F.element_at(F.split(path, "/"), -2)
    name = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, "^[^=]*=", "")


def scan_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category list: one name per line, `#` lines are headings, kept lines are numbered from 0."""
    name = F.lower(strip("value"))
    lines = _placed(spark.read.text(path), name.alias("product"))
    kept = lines.filter((F.col("product") != "") & ~F.startswith("product", F.lit("#")))
    return number_within(kept, [], _SPOT, ["__line"], "idx").select("idx", "product")


def scan_products(spark: SparkSession, root: str, file: str = "*.csv") -> DataFrame:
    """Product rows of every category folder in one scan; `id` is the row's place in its category.

    Quoted fields may hold line feeds, so a file is read by one task.
    """
    df = (
        spark.read.schema(schemas.PRODUCT_CSV)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file)
        .csv(root)
    )
    rows = _placed(df, "Brand", "Model", "URL").withColumn("product", parent_folder("__path"))
    return number_within(rows, ["product"], _SPOT, ["__line"], "id").select(
        "product", F.col("Brand").alias("brand"), F.col("Model").alias("model"), F.col("URL").alias("url"), "id"
    )


def scan_versioned_products(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all `products_v{major}.{minor}.csv` files: `product, major, minor, brand, model, url, id`.

    `id` is the row's place in its version. A version may be a folder of files of that name, read in their order.
    """
    return scan_version_paths(spark, [f"{root.rstrip('/')}/*/products_v*.csv"])


def scan_version_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """`scan_versioned_products` of the versions at `paths` only."""
    df = spark.read.schema(schemas.PRODUCT_CSV).options(**_QUOTED).csv(paths)
    path = version_path("_metadata.file_path")
    rows = parse_versions(_placed(df, "Brand", "Model", "URL", parent_folder(path).alias("product"), path.alias("path")))
    return number_within(rows, ["product", "major", "minor"], _SPOT, ["__line"], "id").select(
        "product", "major", "minor", F.col("Brand").alias("brand"), F.col("Model").alias("model"), F.col("URL").alias("url"), "id"
    )


def scan_latest(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every category's `latest.csv`, a file or a folder of files; `id` is the row's place in it."""
    df = spark.read.schema(schemas.PRODUCT_CSV).options(**_QUOTED).csv(f"{root.rstrip('/')}/*/{LATEST}")
    path = F.regexp_replace("_metadata.file_path", rf"(/{LATEST})/[^/]*$", "$1")
    rows = _placed(df, "Brand", "Model", "URL", parent_folder(path).alias("product"))
    return number_within(rows, ["product"], _SPOT, ["__line"], "id").select(
        "product", F.col("Brand").alias("brand"), F.col("Model").alias("model"), F.col("URL").alias("url"), "id"
    )


def scan_url_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Redirects from `url|new_url` lines below a heading; other shapes are ignored, the last one wins."""
    lines = _placed(spark.read.text(path), "value")
    nth = F.row_number().over(W.partitionBy(*_SPOT).orderBy("__line"))
    body = lines.withColumn("__nth", nth).filter((F.col("__block") != 0) | (F.col("__nth") != 1))
    parts = body.withColumn("__f", F.split("value", r"\|")).filter(F.size("__f") == 2)
    pairs = parts.select(
        F.get("__f", F.lit(0)).alias("url"),
        F.get("__f", F.lit(1)).alias("new_url"),
        F.struct("__path", "__block", "__nth").alias("seq"),
    )
    return reduce_aliases(pairs)


def reduce_aliases(pairs: DataFrame) -> DataFrame:
    """One target per URL: the one with the greatest `seq`."""
    return pairs.groupBy("url").agg(F.max_by("new_url", "seq").alias("new_url"))


def scan_alias_store(spark: SparkSession, path: str) -> DataFrame:
    """Redirects written by `append_aliases`: the last target of each URL."""
    stored = spark.read.schema("url STRING, new_url STRING, batch BIGINT, line BIGINT").parquet(path)
    return reduce_aliases(stored.select("url", "new_url", F.struct("batch", "line").alias("seq")))


def scan_page_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def scan_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Page store kept as one file per page; the file name is the cache key.

    Hadoop file systems do not open names with a colon: rename such files, or pack them into a
    table, before reading them here.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    key = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return files.select(key.alias("cache_key"), F.decode("content", "UTF-8").alias("html"))


def scan_responses(spark: SparkSession, path: str, query_type: str | None = None) -> DataFrame:
    df = spark.read.schema(schemas.RESPONSES).parquet(path)
    return df.filter(F.col("query_type") == query_type) if query_type else df


def _usable_bodies(stored: DataFrame) -> DataFrame:
    """Parsed bodies, without those that report an error or are no JSON."""
    parsed = stored.select("query", F.from_json("body", schemas.SEARCH_BODY).alias("b"))
    return parsed.filter(F.col("b").isNotNull() & F.col("b.error").isNull() & F.col("b._corrupt_record").isNull())


def scan_search_results(stored: DataFrame) -> DataFrame:
    """Ranked links of `(query, body)` rows; a body with an error counts as not stored."""
    items = _usable_bodies(stored).select("query", F.posexplode("b.items").alias("pos", "item"))
    return items.select(
        "query",
        (F.col("pos") + 1).alias("rank"),
        F.col("item.title").alias("title"),
        F.col("item.link").alias("link"),
    )


def usable_searches(stored: DataFrame) -> DataFrame:
    """Queries whose stored body can be used, also when it lists nothing."""
    return _usable_bodies(stored).select("query").distinct()


def _good(captures: DataFrame, until: datetime | Column, status: str, mime: str) -> DataFrame:
    bound = until if isinstance(until, Column) else F.lit(until)
    return captures.filter((F.col("status") == status) & (F.col("mime") == mime) & (F.col("ts") <= bound))


def capture_asof(
    captures: DataFrame, until: datetime | Column, status: str = "200", mime: str = "text/html"
) -> DataFrame:
    """Per URL, the latest good capture not after `until`; ties go to the greater capture id.

    A plain aggregate: each task keeps one capture per URL, with its body, before the shuffle. Captures kept with
    `save_capture_store` are picked without moving bodies by `capture_asof_stored`.
    """
    good = _good(captures, until, status, mime)
    rest = [c for c in captures.columns if c not in ("url", "status", "mime")]
    best = good.groupBy("url").agg(F.max_by(F.struct(*rest), F.struct("ts", "capture_id")).alias("c"))
    return best.select("url", *[F.col(f"c.{c}").alias(c) for c in rest])


def capture_asof_stored(
    spark: SparkSession, table: str, until: datetime | Column, status: str = "200", mime: str = "text/html"
) -> DataFrame:
    """`capture_asof` of a capture store: captures are picked by their narrow columns, and bodies are read after that.

    The store is scanned twice, the first time without bodies. The picked ids then go to the buckets of the second scan
    and meet the bodies there: ids move, bodies do not. Capture ids have to be unique.
    """
    captures = spark.table(table)
    narrow = _good(captures, until, status, mime).groupBy("url").agg(F.max(F.struct("ts", "capture_id")).alias("k"))
    picked = narrow.select(F.col("k.capture_id").alias("capture_id"))
    rest = [c for c in captures.columns if c not in ("url", "status", "mime")]
    # The picked ids are the small side, held in memory bucket by bucket, so that bodies are not sorted either.
    return captures.join(picked.hint("shuffle_hash"), "capture_id", "left_semi").select("url", *rest)
