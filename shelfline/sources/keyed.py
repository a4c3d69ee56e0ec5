"""Stores kept as one file per key, as tools that fetch and ask write them: pages, answers, search results.

Their names are made of URLs and hold colons and backslashes, which Hadoop file systems do not open. They are read
through Spark's Python data source API: every task lists the folder itself and reads its share of the names, so no
list goes through the driver. The folder has to be there under the same path for every executor.

Names are cut to a number of characters, so long URLs share a file; a row then gets what the file holds.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.stores import ANSWER_FOLDER, KEY, PAGE_FOLDER, SEARCH_FOLDER
from .readers import scan_search_results

BATCH_BYTES = 4 << 20
FORMAT = "keyed_files"


def local_path(folder: str) -> str:
    """A folder as the operating system names it."""
    scheme, _, rest = folder.partition(":")
    if not rest or "/" in scheme:
        return folder
    if scheme != "file":
        raise ValueError(f"files are read through the operating system, not from {folder}")
    return "/" + rest.lstrip("/")


class _Share(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, root: str, shares: int):
        self.root, self.shares = root, shares

    def partitions(self) -> list[_Share]:
        return [_Share(k) for k in range(self.shares)]

    def read(self, share: _Share) -> Iterator[pa.RecordBatch]:
        names, bodies, size = [], [], 0
        if not os.path.isdir(self.root):
            return
        with os.scandir(self.root) as listing:
            for entry in listing:
                if entry.name.startswith(".") or zlib.crc32(os.fsencode(entry.name)) % self.shares != share.number or not entry.is_file():
                    continue
                with open(entry.path, "rb") as f:
                    body = f.read()
                names.append(os.fsencode(entry.name).decode("utf-8", "replace"))
                bodies.append(body.decode("utf-8", "replace"))
                size += len(body)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(bodies)], ["name", "body"])
                    names, bodies, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(bodies)], ["name", "body"])


class _Writer(DataSourceWriter):
    """One file for each row, each put in place by a rename; of rows with one name the last one written stays."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.root, exist_ok=True)
        for row in rows:
            place = os.path.join(self.root, row.name)
            beside = os.path.join(self.root, f".{os.getpid()}-{zlib.crc32(row.name.encode()):08x}")
            with open(beside, "w", encoding="utf-8", newline="") as f:
                f.write(row.body)
            os.replace(beside, place)
        return WriterCommitMessage()


class KeyedFiles(DataSource):
    """`name, body` of the files of the folder `path`, read in `shares` tasks."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name STRING, body STRING"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(local_path(self.options["path"]), int(self.options.get("shares", "8")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(local_path(self.options["path"]))


def scan_files(spark: SparkSession, folder: str, shares: int | None = None) -> DataFrame:
    """`name, body` of every file of a folder; a folder that is not there has none."""
    spark.dataSource.register(KeyedFiles)
    shares = shares or spark.sparkContext.defaultParallelism
    return spark.read.format(FORMAT).option("path", folder).option("shares", str(shares)).load()


def write_files(files: DataFrame, folder: str) -> None:
    """A file for each `name, body` row."""
    files.sparkSession.dataSource.register(KeyedFiles)
    files.select("name", "body").write.format(FORMAT).option("path", folder).mode("append").save()


def file_name(folder: str, key: Column) -> Column:
    """The name, below `folder`, of a file with a `cache_key`."""
    return F.substring(key, len(folder) + 1, 1 << 16)


def scan_keyed_pages(spark: SparkSession, root: str, shares: int | None = None) -> DataFrame:
    """`cache_key, html` of the page folder below `root`."""
    files = scan_files(spark, f"{root.rstrip('/')}/{PAGE_FOLDER}", shares)
    return files.select(F.concat(F.lit(PAGE_FOLDER), "name").alias(KEY), F.col("body").alias("html"))


def scan_keyed_responses(spark: SparkSession, root: str, kinds: list[str], shares: int | None = None) -> DataFrame:
    """`query_type, cache_key, response` of the answer folders of these kinds of question below `root`."""

    def answers(kind: str) -> DataFrame:
        folder = f"{ANSWER_FOLDER}{kind}/"
        files = scan_files(spark, f"{root.rstrip('/')}/{folder}", shares)
        return files.select(F.lit(kind).alias("query_type"), F.concat(F.lit(folder), "name").alias(KEY), F.col("body").alias("response"))

    return reduce(DataFrame.unionByName, map(answers, kinds))


def scan_keyed_searches(spark: SparkSession, root: str, shares: int | None = None) -> DataFrame:
    """`cache_key, rank, title, link` of the search folder below `root`; a body with an error counts as not stored."""
    files = scan_files(spark, f"{root.rstrip('/')}/{SEARCH_FOLDER}", shares)
    bodies = files.select(F.concat(F.lit(SEARCH_FOLDER), "name").alias("query"), "body")
    return scan_search_results(bodies).withColumnRenamed("query", KEY)
