"""Checking and repairing the rows of a product table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_quotes
from ..functions.urls import drop_slash, pdf_guard
from ..operators.classify import Rules, fetch_and_check, kept_facts
from ..operators.rows import apply_updates, dedupe_url, head_per_category
from ..operators.search import STATE, explore, follow
from ..operators.skew import null_safe_join, skewed_join
from ..operators.stores import QUESTION
from ..operators.versions import latest_version, next_version, select_version, source_version
from ..session import stage

CHECKED = [
    "id", "product", "brand", "model", "new_model", "url", "resolved_url", "new_url", "is_prod", "outcome",
    "ask_type", "ask_url",
]


def check_products(
    rows: DataFrame,
    results: DataFrame,
    aliases: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    rules: Rules = Rules(),
) -> DataFrame:
    """Check every row and repair it from search where its own page will not do.

    A row is kept if its page is an available page of one product. Otherwise its model is searched
    for; if that finds nothing and the page was a catalog naming another model, that one is. Rows
    waiting for an answer are `undecided`, and `ask_type, ask_url` name the question.

    Own pages are checked first; only rows they do not settle are searched for, and only states that a search
    reaches are looked up. The tables read more than once are written to the shared folder in between.
    """
    facts = kept_facts(pages, rules)
    checks = stage(fetch_and_check(rows.select(*QUESTION), aliases, facts, responses, rules), "checks")

    own = skewed_join(rows.select("id", *STATE, "url"), checks, QUESTION, stored=True)
    catalog = F.col("model_from_catalog")
    # A row without URL has no check to look up.
    is_prod = F.when(pdf_guard("url"), False).otherwise(F.col("is_prod"))
    gone = F.coalesce("unavailable", F.lit(False))
    own = own.select(
        "id", *STATE, "url", F.col("new_url").alias("resolved_url"), "needs",
        is_prod.isNull().alias("waits"),
        F.coalesce(is_prod & ~gone & catalog.isNull(), F.lit(False)).alias("fits"),
        F.when(F.coalesce(catalog != F.col("model"), F.lit(True)), catalog).alias("catalog"),
    )
    own = stage(own, "own")

    searching = own.filter(~F.col("fits") & ~F.col("waits"))
    starts = searching.select(*STATE).union(
        searching.filter(F.col("catalog").isNotNull()).select("product", "brand", "catalog")
    )
    starts = stage(starts.distinct(), "starts")
    ends = stage(follow(starts, explore(starts, results, aliases, facts, responses, rules)), "ends")

    def looked_up(df: DataFrame, model: str, as_: str) -> DataFrame:
        end = F.struct("found", "link", "found_model", "ask_type", "ask_url").alias(as_)
        right = ends.select("product", "brand", F.col("model").alias(model), end)
        return skewed_join(df, right, ["product", "brand", model], stored=True)

    both = looked_up(looked_up(own, "model", "first"), "catalog", "second")
    return both.select(*_decide())


def _decide() -> list[Column]:
    fits, waits = F.col("fits"), F.col("waits")
    first_found = F.coalesce("first.found", F.lit(False))
    first_open = F.col("first").isNotNull() & F.col("first.found").isNull()
    second_found = F.coalesce("second.found", F.lit(False))
    second_open = F.col("second").isNotNull() & F.col("second.found").isNull()

    def choose(own: Column, first: str, second: str) -> Column:
        return F.when(fits, own).when(waits, None).when(first_found, F.col(first)).when(
            ~first_open & second_found, F.col(second)
        )

    undecided = ~fits & (waits | first_open | (~first_found & second_open))
    kept = fits | (~waits & (first_found | (~first_open & second_found)))
    outcome = F.when(kept, "kept").when(undecided, "undecided").otherwise("dropped")

    def asked(own: Column, field: str) -> Column:
        return F.when(undecided, F.when(waits, own).when(first_open, F.col(f"first.{field}")).otherwise(
            F.col(f"second.{field}")))

    return [
        F.col("id"), F.col("product"), F.col("brand"), F.col("model"),
        strip_quotes(choose(F.col("model"), "first.found_model", "second.found_model")).alias("new_model"),
        F.col("url"), F.col("resolved_url"),
        choose(F.col("resolved_url"), "first.link", "second.link").alias("new_url"),
        F.when(~undecided, kept).alias("is_prod"),
        outcome.alias("outcome"),
        asked(F.col("needs"), "ask_type").alias("ask_type"),
        asked(drop_slash("resolved_url"), "ask_url").alias("ask_url"),
    ]


def open_questions(checked: DataFrame) -> DataFrame:
    """Distinct questions the undecided rows are waiting for."""
    return (
        checked.filter(F.col("outcome") == "undecided")
        .select(F.col("ask_type").alias("query_type"), "product", "brand", F.col("ask_url").alias("url"))
        .distinct()
    )


def cleaned_rows(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Kept rows with their new models and URLs, the first of each URL within a category."""
    return dedupe_url(apply_updates(rows, checked))


def clean_dataset(
    versioned: DataFrame,
    versions: DataFrame,
    results: DataFrame,
    aliases: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    rules: Rules = Rules(),
    custom_major: int | None = None,
    custom_minor: int | None = None,
    head: int | None = None,
) -> DataFrame:
    """Clean the chosen version of every category; the result carries the next minor version.

    All categories are one table: a category without the chosen version simply has no rows.
    """
    latest = latest_version(versions, versions, custom_major)
    source = select_version(versioned, source_version(latest, custom_major, custom_minor))
    rows = head_per_category(source.select("id", *STATE, "url"), head)
    checked = check_products(rows, results, aliases, pages, responses, rules)
    done = cleaned_rows(rows, checked)
    target = next_version(latest, minor_bump=True, custom_major=custom_major)
    return null_safe_join(done, target.select("product", "major", "minor"), ["product"], "inner")
