"""Writes."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.base import strip
from ..operators.ranking import id_bucket, number_within
from ..operators.skew import null_safe_join
from ..operators.versions import VERSION, due_versions, latest_version, list_versions
from .readers import LATEST, scan_version_paths
from .trees import NO_NAME, Tree, check_name, place_all, staging

#: Rows of a category in one file.
ROWS_PER_FILE = 1_000_000
CSV_FORM = dict(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
_FIELDS = ("brand", "model", "url")


def _balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Few files per partition folder: adaptive execution merges small folders and splits big ones."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def _measured(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """`rows` and what the pass that writes them will have counted: rows, and empty fields as `dataset_audit` counts them."""
    seen = Observation()
    blank = {c: F.sum((F.coalesce(strip(c), F.lit("")) == "").cast("long")) for c in _FIELDS if c in rows.columns}
    empty = [F.coalesce(n, F.lit(0)).alias(f"empty_{c}") for c, n in blank.items()]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *empty), seen


def write_version(rows: DataFrame, root: str) -> dict[str, int]:
    """Add rows that carry `product, major, minor` to a table; a version that exists already is refused.

    Versions are written beside the table and put in place by one rename each, so a failed or refused write leaves
    nothing, and only the folders of the new versions are looked at. Returns the number of rows and of empty
    brands, models and URLs, counted by the pass that writes.
    """
    tree, beside = Tree(rows.sparkSession, root), staging()
    measured, seen = _measured(rows)
    try:
        _balanced(measured, *VERSION).write.partitionBy(*VERSION).parquet(f"{tree.root}/{beside}")
        versions = [tuple(v.split("/")) for v in tree.find(f"{beside}/product=*/major=*/minor=*")]
        _place(tree, {v: v[1:] for v in versions})
    finally:
        tree.remove(beside)
    return seen.get


def _place(tree: Tree, moves: dict[tuple[str, ...], tuple[str, ...]]) -> None:
    try:
        place_all(tree, moves)
    except FileExistsError as e:
        raise ValueError(f"version exists: {_spoken(tree, str(e))}") from e


def _spoken(tree: Tree, place: str) -> str:
    """`a/products_v1.0.csv` or `product=a/major=1/minor=0` as one says it."""
    parts = place.split("/")
    if "=" not in parts[-1]:
        return f"{parts[0]} {parts[-1].removeprefix('products_').removesuffix('.csv')}"
    product, major, minor = (tree.value_of(p) for p in parts)
    return f"{product} v{major}.{minor}"


def _write_named(rows: DataFrame, root: str, file: Column, group: list[str], rows_per_file: int) -> dict[str, int]:
    """Write the rows of each `group`, whose first column is the category, to `{category}/{file}` under `root`.

    Rows are in order of id. More than `rows_per_file` make a folder of that name with numbered files instead of a
    file, so that no task has to write a whole large category.
    """
    tree, beside = Tree(rows.sparkSession, root), staging()
    measured, seen = _measured(rows)
    spot = measured.withColumn("__bucket", id_bucket("id"))
    placed = number_within(spot, group, ["__bucket"], ["id"], "__at")
    part = F.floor(F.col("__at") / F.lit(rows_per_file)).cast("int")
    fields = [F.col(c).alias(c.capitalize() if c != "url" else "URL") for c in ("product", *_FIELDS)]
    # Not as constants, which the optimizer would take out of the sort; the writer would then sort once more, by folders only.
    varies = F.col("__at") >= 0
    folders = [F.when(varies, F.col("product")).alias("category"), F.when(varies, file).alias("file"), part.alias("part")]
    out = placed.select(*folders, "__at", *fields)
    out = out.repartition("category", "file", "part").sortWithinPartitions("category", "file", "part", "__at").drop("__at")
    try:
        out.write.partitionBy("category", "file", "part").options(**CSV_FORM).csv(f"{tree.root}/{beside}/parts")
        found: dict[tuple[str, str], list[tuple[str, ...]]] = {}
        for place in tree.find(f"{beside}/parts/category=*/file=*/part=*/part-*"):
            steps = tuple(place.split("/"))
            found.setdefault((tree.value_of(steps[2]), tree.value_of(steps[3])), []).append(steps)
        moves = {}
        for (category, name), parts in found.items():
            if category == NO_NAME:
                raise ValueError("rows without a category have no folder to be written to")
            target = (check_name(category), name)
            parts.sort(key=lambda steps: int(tree.value_of(steps[4])))
            if len(parts) > 1:
                whole = (beside, "whole", category, name)
                for k, steps in enumerate(parts):
                    tree.move(steps, (*whole, f"part-{k:05d}.csv"))
                parts = [whole]
            moves[parts[0]] = target
        _place(tree, moves)
    finally:
        tree.remove(beside)
    return seen.get


def write_version_files(rows: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE) -> dict[str, int]:
    """Write rows that carry `product, major, minor` as `{product}/products_v{major}.{minor}.csv` files.

    The tree is what `scan_versioned_products` and `list_versions` read. A version that exists is refused, and a
    failed or refused write leaves nothing. Returns the counts `write_version` returns.
    """
    name = F.concat(F.lit("products_v"), F.col("major").cast("string"), F.lit("."), F.col("minor").cast("string"), F.lit(".csv"))
    return _write_named(rows, root, name, VERSION, rows_per_file)


def publish_latest_files(spark: SparkSession, root: str, rows_per_file: int = ROWS_PER_FILE) -> list[str]:
    """Give every category without a `latest.csv` a copy of its greatest version, if that was cleaned; returns which.

    Only the versions that are due are read. Each `latest.csv` appears at once and whole.
    """
    held = Tree(spark, root)
    listed = list_versions(spark, root)
    published = spark.createDataFrame([(p.split("/")[0],) for p in held.find(f"*/{LATEST}")], "product STRING")
    due = due_versions(latest_version(listed, listed), published).collect()
    if not due:
        return []
    paths = [f"{held.root}/{r.product}/products_v{r.major}.{r.minor}.csv" for r in due]
    rows = scan_version_paths(spark, paths)
    _write_named(rows, root, F.lit(LATEST), ["product"], rows_per_file)
    return sorted(r.product for r in due)


def export_csv(rows: DataFrame, root: str, ordered: bool = True) -> None:
    """One folder per category with `Product,Brand,Model,URL` files, fields quoted where needed.

    Files are cut by ranges of `(product, id)`, so their names sort like the rows.
    """
    out = rows.select(
        F.col("product").alias("category"),
        F.col("product").alias("Product"),
        F.col("brand").alias("Brand"),
        F.col("model").alias("Model"),
        F.col("url").alias("URL"),
        "id",
    )
    if ordered:
        out = out.repartitionByRange("category", "id").sortWithinPartitions("category", "id")
    (
        out.drop("id")
        .write.partitionBy("category")
        .options(**CSV_FORM)
        .csv(root)
    )


def split_outcome(checked: DataFrame) -> DataFrame:
    """Rows as they go to the kept, dropped and undecided outputs.

    Kept rows carry the new model and URL; the others what they came with. The URL the check ended
    at is kept beside it.
    """
    kept = F.col("outcome") == "kept"
    return checked.select(
        "id",
        "product",
        "brand",
        F.when(kept, F.col("new_model")).otherwise(F.col("model")).alias("model"),
        F.when(kept, F.col("new_url")).otherwise(F.col("url")).alias("url"),
        "resolved_url",
        "outcome",
    )


def write_kept_dropped(checked: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """One pass over the checked rows writes every outcome to its own folder."""
    split_outcome(checked).write.mode(mode).partitionBy("outcome").parquet(root)


def write_pages_content(pages: DataFrame, root: str) -> None:
    """Replace the pages and text of the categories present in `pages`, leaving the others."""
    _balanced(pages, "product").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "product"
    ).parquet(root)


def save_page_store(pages: DataFrame, table: str, buckets: int) -> None:
    """Keep a page store as a table bucketed and sorted by URL.

    Lookups by URL then bring their narrow side to the buckets, and HTML is not shuffled. Give it
    enough buckets that the HTML of one fits a task.
    """
    pages.select("url", "html").repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").saveAsTable(table)


def save_capture_store(captures: DataFrame, table: str, buckets: int) -> None:
    """Keep captures as a table bucketed by capture id, for `readers.capture_asof_stored`.

    Ids are unique, so no bucket holds more than its share, however many captures one URL has.
    """
    captures.repartition(buckets, "capture_id").write.bucketBy(buckets, "capture_id").saveAsTable(table)


def changed_aliases(fetched: DataFrame) -> DataFrame:
    """`(url, new_url)` of fetches that ended at another URL."""
    return fetched.filter(F.col("url") != F.col("new_url")).select("url", "new_url")


def append_aliases(fetched: DataFrame, path: str) -> None:
    """Add redirects to the store at `path`, each batch after those before it.

    `scan_alias_store` reads them back with the last target of each URL.
    """
    numbered = changed_aliases(fetched).select(
        "url", "new_url", F.lit(time.time_ns()).alias("batch"), F.monotonically_increasing_id().alias("line")
    )
    numbered.write.mode("append").parquet(path)


def new_responses(fresh: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """Successful fresh answers whose key the store lacks, one per key; a missing part of a key equals itself."""
    ok = fresh.filter(F.col("response").isNotNull())
    absent = null_safe_join(ok, store.select(*key), key, "left_anti")
    rest = [c for c in fresh.columns if c not in key]
    one = absent.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r"))
    return one.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*fresh.columns)


def merge_responses(fresh: DataFrame, store: DataFrame, path: str, key: list[str]) -> None:
    """Add answers to the store at `path`; what it already holds stays as it is."""
    new_responses(fresh, store, key).write.mode("append").parquet(path)


def write_updated_names(rows: DataFrame, path: str) -> None:
    _balanced(rows, "product").write.partitionBy("product").parquet(path)
