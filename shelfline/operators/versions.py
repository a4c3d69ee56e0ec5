"""Version catalog: what a folder listing says about each category's versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.trees import NO_NAME, Tree
from .skew import null_safe_join

# The whole file name: leftovers such as `temp_products_v1.2.csv` are no version.
VERSION = ["product", "major", "minor"]
VERSION_FILE = r"^products_v([0-9]+)\.([0-9]+)\.csv$"


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions of a folder tree of `products_v{major}.{minor}.csv` files, or folders of files; contents are not read."""
    from ..sources.readers import parent_folder

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    ).select(version_path("path").alias("path"))
    return parse_versions(files.distinct().select(parent_folder("path").alias("product"), "path"))


def version_path(path: Column | str) -> Column:
    """The path of a version's file; of a file in a folder with a version's name, the path of the folder."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(path, r"(/products_v[0-9]+\.[0-9]+\.csv)/[^/]*$", "$1")


def parse_versions(listing: DataFrame) -> DataFrame:
    """The rows whose `path` names a version, with its `major` and `minor`."""
    name = F.substring_index(F.col("path"), "/", -1)
    major = F.regexp_extract(name, VERSION_FILE, 1)
    minor = F.regexp_extract(name, VERSION_FILE, 2)
    return listing.filter(F.rlike(name, F.lit(VERSION_FILE))).withColumns(
        {"major": major.cast("int"), "minor": minor.cast("int")}
    )


def list_table_versions(spark: SparkSession, root: str) -> DataFrame | None:
    """Versions of a table written by `write_version`, by its folders' names; None before the first write.

    Files are listed, not opened. A category named 007 stays text.
    """
    if not Tree(spark, root).exists():
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    named = F.regexp_extract_all("path", F.lit(r"/product=([^/]*)/major=([0-9]+)/minor=([0-9]+)/[^/]*$"))
    names = [F.regexp_extract("path", r"/product=([^/]*)/major=([0-9]+)/minor=([0-9]+)/[^/]*$", i) for i in (1, 2, 3)]
    product = F.nullif(F.url_decode(F.replace(names[0], F.lit("+"), F.lit("%2B"))), F.lit(NO_NAME))
    found = files.filter(F.size(named) > 0)
    return found.select(product.alias("product"), names[1].cast("int").alias("major"), names[2].cast("int").alias("minor")).distinct()


def latest_version(versions: DataFrame, products: DataFrame, custom_major: int | None = None) -> DataFrame:
    """Greatest version per category of `products`; `(0, -1)` where there is none.

    With a custom major, `max_minor` is the greatest within that major, `max_major` stays overall.
    """
    if custom_major is None:
        best = versions.groupBy("product").agg(F.max(F.struct("major", "minor")).alias("v"))
        best = best.select("product", F.col("v.major").alias("max_major"), F.col("v.minor").alias("max_minor"))
    else:
        best = versions.groupBy("product").agg(
            F.max("major").alias("max_major"),
            F.max(F.when(F.col("major") == custom_major, F.col("minor"))).alias("max_minor"),
        )
    return (
        null_safe_join(products.select("product").distinct(), best, ["product"])
        .select(
            "product",
            F.coalesce("max_major", F.lit(0)).alias("max_major"),
            F.coalesce("max_minor", F.lit(-1)).alias("max_minor"),
        )
    )


def next_version(latest: DataFrame, minor_bump: bool, custom_major: int | None = None) -> DataFrame:
    """The version to write next and its name."""
    if minor_bump:
        major: Column = F.col("max_major") if custom_major is None else F.lit(custom_major)
        minor: Column = F.col("max_minor") + 1
    else:
        major, minor = F.col("max_major") + 1, F.lit(0)
    out = latest.select("product", major.alias("major"), minor.alias("minor"))
    name = F.concat(F.lit("products_v"), F.col("major").cast("string"), F.lit("."), F.col("minor").cast("string"))
    return out.withColumn("name", name)


def source_version(latest: DataFrame, custom_major: int | None = None, custom_minor: int | None = None) -> DataFrame:
    """The version a cleaning pass starts from. A custom major selects both numbers."""
    major = F.col("max_major") if custom_major is None else F.lit(custom_major)
    minor = F.col("max_minor") if custom_minor is None else F.lit(custom_minor)
    return latest.select("product", major.alias("major"), minor.alias("minor"))


def select_version(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of the chosen version of each category; rows without a category are one."""
    return null_safe_join(rows, source.select(*VERSION), VERSION, "left_semi")


def due_versions(latest: DataFrame, published: DataFrame) -> DataFrame:
    """`product, major, minor` of categories that have no latest yet and whose greatest version was cleaned."""
    return (
        latest.filter(F.col("max_minor") > 0)
        .transform(lambda due: null_safe_join(due, published.select("product"), ["product"], "left_anti"))
        .select("product", F.col("max_major").alias("major"), F.col("max_minor").alias("minor"))
    )


def publish_latest(rows: DataFrame, latest: DataFrame, published: DataFrame) -> DataFrame:
    """Rows to expose as latest; `publish_latest_files` does the same for a tree of files."""
    return select_version(rows, due_versions(latest, published))


def existing_categories(categories: DataFrame, versions: DataFrame) -> DataFrame:
    """Categories that have a dataset."""
    return categories.join(versions.select("product"), "product", "left_semi")


def missing_categories(categories: DataFrame, versions: DataFrame) -> DataFrame:
    """Categories skipped because they have none."""
    return categories.join(versions.select("product"), "product", "left_anti")
