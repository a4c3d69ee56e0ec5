"""Stores of answers and redirects that grow by merges.

Rows lie in folders of a hash of their key, so a merge reads only the buckets its own keys fall into and adds one folder
of files, a generation, to each bucket that gets something new. Nothing is added for what the store holds
already. `compact` makes one generation of many. The number of buckets is fixed by the first merge.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.skew import null_safe_join
from ..operators.stores import QUESTION
from ..session import scratch, stage
from .trees import Tree, place_all, staging

ANSWER_KEY = ["query_type", *QUESTION]
BUCKETS = 64


def _bucket(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _home(spark: SparkSession, path: str) -> str | None:
    """The folder of the buckets, whose name tells how many there are."""
    found = Tree(spark, path).find("buckets=*")
    return found[0] if found else None


def _size(home: str) -> int:
    return int(home.split("=")[1])


def _held(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows with their `bucket` and `generation`, of some buckets only if they are given."""
    home, whole = _home(spark, path), f"{schema}, bucket INT, generation BIGINT"
    if home is None or not Tree(spark, path).find(f"{home}/bucket=*/generation=*"):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(f"{path.rstrip('/')}/{home}")
    # Numbers, of which there are as many as buckets at most: folders of the others are not opened.
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def _add(rows: DataFrame, path: str, home: str) -> None:
    """Put rows with their `bucket` in place as a new generation of each bucket."""
    tree, beside = Tree(rows.sparkSession, path), staging()
    born = f"generation={time.time_ns()}"
    try:
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{tree.root}/{beside}")
        made = tree.find(f"{beside}/bucket=*")
        place_all(tree, {tuple(p.split("/")): (home, p.split("/")[1], born) for p in made})
    finally:
        tree.remove(beside)


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def merge_answers(fresh: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Add successful answers to questions the store has none for, one for each; returns how many were added.

    A missing part of a question equals itself. Of several fresh answers to a question the smallest is kept.
    """
    spark = fresh.sparkSession
    home = _home(spark, path) or f"buckets={buckets}"
    with scratch(spark):
        ok = fresh.filter(F.col("response").isNotNull()).select(*ANSWER_KEY, "response")
        one = ok.groupBy(*ANSWER_KEY).agg(F.min("response").alias("response"))
        marked = stage(one.withColumn("bucket", _bucket(ANSWER_KEY, _size(home))), "fresh")
        held = _held(spark, path, schemas.RESPONSES, _touched(marked))
        new = stage(null_safe_join(marked, held.select(*ANSWER_KEY, "bucket"), [*ANSWER_KEY, "bucket"], "left_anti"), "new")
        added = new.count()
        if added:
            _add(new, path, home)
    return added


def merge_redirects(fetched: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Add the redirects that the store does not end at already; returns how many were added.

    The last target of a URL counts. Of several targets in one merge the greatest is kept.
    """
    spark = fetched.sparkSession
    home = _home(spark, path) or f"buckets={buckets}"
    with scratch(spark):
        moved = fetched.filter(F.col("url") != F.col("new_url")).groupBy("url").agg(F.max("new_url").alias("new_url"))
        marked = stage(moved.withColumn("bucket", _bucket(["url"], _size(home))), "fresh")
        held = _last(_held(spark, path, schemas.ALIASES, _touched(marked)), ["url"])
        new = stage(marked.join(held.select("url", "new_url"), ["url", "new_url"], "left_anti"), "new")
        added = new.count()
        if added:
            _add(new.select("url", "new_url", "bucket"), path, home)
    return added


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key, that of the last generation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "generation").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers, one for each question."""
    return _held(spark, path, schemas.RESPONSES).drop("bucket", "generation")


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    """The last target of each URL."""
    return _last(_held(spark, path, schemas.ALIASES), ["url"]).select("url", "new_url")


def compact(spark: SparkSession, path: str, schema: str, key: list[str], most: int = 8) -> list[int]:
    """Make one generation of every bucket with more than `most`; returns which. Not to be run beside readers."""
    home = _home(spark, path)
    if home is None:
        return []
    tree = Tree(spark, path)
    old: dict[int, list[str]] = {}
    for place in tree.find(f"{home}/bucket=*/generation=*"):
        old.setdefault(int(place.split("/")[1].split("=")[1]), []).append(place)
    full = sorted(b for b, places in old.items() if len(places) > most)
    if full:
        with scratch(spark):
            kept = stage(_last(_held(spark, path, schema, full), key).drop("generation"), "kept")
            _add(kept, path, home)
        for b in full:
            for place in old[b]:
                tree.remove(*place.split("/"))
    return full
