"""Columns of a table may have names that operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfline.llm.decontaminate import without_leaks
from shelfline.llm.lines import without_repeated_lines
from shelfline.llm.quality import good_documents
from shelfline.llm.simhash import without_near_duplicates

NAMES = [
    "__n", "__r", "__i", "__id", "__text", "__gone", "__gone_fp", "__fp", "__words", "__failed", "__log_ppl", "__cuts",
    "__version", "__lines", "__removed", "__leak_runs", "__leak_items", "__leak_words", "__kept", "__lang", "own0", "own3",
    "a.b", "fp", "key", "component_id",
]


@pytest.fixture(scope="module")
def named(spark):
    """Texts long enough for every operator, a copy among them, beside columns of such names."""
    body = " ".join(f"w{chr(97 + i % 7)}{chr(97 + i % 11)}{chr(97 + i % 5)}" for i in range(90))
    rows = [(1, body, "en", "s", 1), (2, body, "en", "s", 1), (3, "other " + body[:250], "en", "s", 1), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    return df.select("*", *(F.lit(f"v{k}").alias(n) for k, n in enumerate(NAMES)))


@pytest.mark.parametrize("name", ["leaks", "good", "lines", "near"])
def test_own_columns_come_back(spark, named, name):
    items = spark.createDataFrame([(1, "nothing of this kind")], "item_id BIGINT, text STRING")
    work = {
        "leaks": lambda d: without_leaks(d, items), "good": good_documents, "lines": without_repeated_lines,
        "near": without_near_duplicates,
    }[name]
    got = work(named)
    assert got.schema.simpleString() == named.schema.simpleString()
    rows = got.collect()
    assert rows or name == "good"
    assert all(r[n] == f"v{k}" for r in rows for k, n in enumerate(NAMES))


def test_pipeline_stages_leave_the_session_alone(spark, named):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, apply in corpus_pipeline.STAGES:
        if name not in ("decontamination", "packing"):
            apply(spark, named, "").count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
