"""Verdicts as rows arrive: every micro-batch is classified and appended to the kept or dropped output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import Rules, facts_of, fetch_and_check
from ..operators.rows import dedupe_url
from ..functions.urls import drop_slash
from ..operators.skew import null_safe_join, skewed_join
from ..operators.stores import QUESTION, trim_stores
from ..plans.clean import check_products
from ..session import scratch, stage
from ..sources.trees import Tree

OUTPUT = (
    "id BIGINT, product STRING, brand STRING, model STRING, url STRING, new_url STRING, ask_type STRING, ask_url STRING, outcome STRING"
)
#: A row as it arrives, and the question an undecided one waits for.
ROW, ASKED = ["id", "product", "brand", "model", "url"], ["ask_type", "ask_url"]


def judge_rows(
    rows: DataFrame, aliases: DataFrame, pages: DataFrame, responses: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """Own-page verdict of each row of a batch: kept, dropped or undecided.

    Keep the page facts as a table and pass that: with raw pages, every batch reads all of them.
    """
    stores = trim_stores(rows, aliases, facts_of(pages, rules), responses)
    checks = fetch_and_check(rows, *stores, rules)
    j = skewed_join(rows, checks, QUESTION)
    fits = F.col("is_prod") & ~F.col("unavailable") & F.col("model_from_catalog").isNull()
    waits = F.col("needs").isNotNull()
    outcome = F.when(F.coalesce(fits, F.lit(False)), "kept").when(waits, "undecided").otherwise("dropped")
    asked = F.when(outcome == "undecided", F.col("needs")), F.when(outcome == "undecided", drop_slash("new_url"))
    return j.select(*ROW, "new_url", *(c.alias(n) for c, n in zip(asked, ASKED, strict=True)), outcome.alias("outcome"))


def check_rows(open_stores: Callable[[], dict[str, DataFrame]], rules: Rules = Rules()) -> Callable[[DataFrame], DataFrame]:
    """A judge that checks and repairs each batch like the batch job does.

    `open_stores` gives `results, aliases, pages, responses`. It is called for every batch, so what was fetched
    and answered meanwhile counts from the next batch on.
    """

    def judge(batch: DataFrame) -> DataFrame:
        checked = check_products(batch, rules=rules, **open_stores())
        kept = F.col("outcome") == "kept"
        return checked.select(
            "id", "product", "brand", F.when(kept, F.col("new_model")).otherwise(F.col("model")).alias("model"), "url",
            F.when(kept, F.col("new_url")).otherwise(F.col("resolved_url")).alias("new_url"), *ASKED, "outcome",
        )

    return judge


def stream_verdicts(
    rows: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    answers: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Start the stream of `rows`; `judge` turns a batch of rows into rows with an `outcome`.

    Every batch writes its own `batch` folder and replaces it when it is run again after a
    failure, so each row lands exactly once. Without a trigger all available input is processed
    and the query ends.

    With `answers`, which opens the store of answers, undecided rows are kept as a backlog beside the output. Each
    batch takes those up again whose question the store can answer now; what they come out as replaces their
    earlier outcome in `read_verdicts`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            # Read several times by the checks.
            batch = stage(batch.select(*ROW), "batch")
            if answers is not None:
                waiting = _backlog(spark, out, batch_id)
                told = answers().filter(F.col("response").isNotNull())
                told = told.select(F.col("query_type").alias("ask_type"), "product", "brand", F.col("url").alias("ask_url")).distinct()
                question = ["ask_type", "product", "brand", "ask_url"]
                batch = batch.unionByName(null_safe_join(waiting, told, question, "left_semi").select(*ROW))
                still = null_safe_join(waiting, told, question, "left_anti")
            judged = stage(judge(batch), "judged")
            judged.write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/batch={batch_id}")
            if answers is not None:
                # The checks may have given a kept row another model or URL, but not one that waits.
                new = judged.filter(F.col("outcome") == "undecided").select(*ROW, *ASKED)
                still.unionByName(new).write.mode("overwrite").parquet(f"{_backlog_of(out)}/batch={batch_id}")
                # The one before is needed until this batch is known to be done.
                Tree(spark, _backlog_of(out)).remove(f"batch={batch_id - 2}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _backlog_of(out: str) -> str:
    return f"{out.rstrip('/')}-backlog"


def _backlog(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """Rows that waited for an answer after the batch before this one."""
    kind = ", ".join(f"{c} {'BIGINT' if c == 'id' else 'STRING'}" for c in [*ROW, *ASKED])
    if not Tree(spark, _backlog_of(out)).exists(f"batch={batch_id - 1}"):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{_backlog_of(out)}/batch={batch_id - 1}")


def waiting_rows(spark: SparkSession, out: str) -> DataFrame:
    """The backlog after the last batch: rows, and the question each waits for."""
    done = [int(p.split("=")[1]) for p in Tree(spark, _backlog_of(out)).find("batch=*")]
    return _backlog(spark, out, max(done, default=-1) + 1)


def read_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """What the stream has written so far, each row as it came out last."""
    every = spark.read.schema(OUTPUT + ", batch BIGINT").option("basePath", out).parquet(out)
    rest = [c for c in every.columns if c not in ("id", "product")]
    last = every.groupBy("id", "product").agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return last.select("id", "product", *[F.col(f"v.{c}").alias(c) for c in rest])


def final_rows(verdicts: DataFrame) -> DataFrame:
    """The batch pass over a finished stream: kept rows, the first of each URL within a category."""
    kept = verdicts.filter(F.col("outcome") == "kept")
    rows = kept.select("id", "product", "brand", "model", F.col("new_url").alias("url"))
    return dedupe_url(rows)
