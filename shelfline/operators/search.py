"""Repair from ranked search results, with a bounded number of restarts.

The outcome of a search depends only on (product, brand, model), never on the row that asked, so
everything below works on distinct states. A search looks at its results by rank and stops at the
first decisive one: a product page ends it, a catalog page naming another model restarts it with
that model. Searches are followed level by level: each level expands the states that the one before led to and
no level had before, side by side; a row then follows at most `MAX_RESTARTS` pointers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.urls import (
    brand_in_link, drop_slash, link_prefix, marketplace_guard, search_query, url_blocklisted, url_has_path,
)
from ..functions.verdicts import catalog_model, verdict_brand, verdict_page
from ..session import stage
from .classify import Rules, fetch_and_check, kept_facts
from .skew import null_safe_join, skewed_join
from .stores import BRAND_CHECK, CATALOG_PICK, KEY, PAGE_CHECK, QUESTION, answer_key, by_key, search_key

MAX_RESTARTS = 3
STATE = ["product", "brand", "model"]
FOUND, RESTART, OPEN, NOTHING = "found", "restart", "open", "nothing"


def reachable_states(starts: DataFrame, responses: DataFrame, rules: Rules) -> DataFrame:
    """The starts and every model a catalog answer names for one of their (product, brand) pairs.

    More than the searches will visit, but found without following them: what may be searched for in advance.
    """
    kind = F.col("query_type")
    model = F.when(kind == CATALOG_PICK, catalog_model("response")).when(
        kind == PAGE_CHECK, verdict_page("response", rules.strict)["model"]
    )
    answers = responses.filter(kind.isin(CATALOG_PICK, PAGE_CHECK))
    models = answers.select("product", "brand", model.alias("model")).distinct().filter(F.col("model").isNotNull())
    pairs = starts.select("product", "brand").distinct()
    return starts.select(*STATE).union(null_safe_join(models, pairs, ["product", "brand"], "left_semi")).distinct()


def gated_candidates(states: DataFrame, results: DataFrame, responses: DataFrame, rules: Rules) -> DataFrame:
    """Results of each state's query that pass the link gates; `brand_ok` is null while unanswered."""
    asked = states.withColumn("query", search_query("brand", "model", "product"))
    by = "query"
    if KEY in results.columns:
        by, asked = KEY, asked.withColumn(KEY, search_key("query"))
    # A query with very many results is split.
    c = skewed_join(results, asked, [by], "inner").withColumn("link", drop_slash("link"))
    c = c.filter(
        url_has_path("link")
        & ~url_blocklisted("link", rules.url_terms, fold_case=False)
        & marketplace_guard("link", "brand", rules.marketplace)
    ).withColumn("__prefix", link_prefix("link"))
    spoken = responses.filter(F.col("query_type") == BRAND_CHECK).withColumnRenamed("response", "__said")
    if KEY in responses.columns:
        c = by_key(c, answer_key(BRAND_CHECK, "__prefix"), spoken.select(KEY, "__said"), stored=True)
    else:
        spoken = spoken.select("product", "brand", F.col("url").alias("__prefix"), "__said")
        c = skewed_join(c, spoken, ["product", "brand", "__prefix"], stored=True)
    ok = F.when(brand_in_link("brand", "__prefix"), True).otherwise(verdict_brand("__said"))
    c = c.withColumn("brand_ok", ok).filter(F.coalesce("brand_ok", F.lit(True)))
    return c.select(*STATE, "rank", "title", F.col("link").alias("url"), "brand_ok", F.col("__prefix").alias("prefix"))


def judge_candidates(candidates: DataFrame, checks: DataFrame) -> DataFrame:
    """Candidates with their `kind`; those that decide nothing are gone.

    A missing answer is decisive too: what comes after it cannot be trusted yet.
    """
    j = skewed_join(candidates, checks, QUESTION)
    catalog = F.col("model_from_catalog")
    kind = (
        F.when(F.col("unavailable") | ~F.coalesce("is_prod", F.lit(True)), NOTHING)
        .when(F.col("brand_ok").isNull() | F.col("is_prod").isNull(), OPEN)
        .when(catalog.isNull(), FOUND)
        .when(catalog == F.col("model"), NOTHING)
        .otherwise(RESTART)
    )
    ask_brand = F.col("brand_ok").isNull()
    open_ = kind == OPEN
    return j.select(
        *STATE, "rank", "title", "new_url", "model_from_catalog", kind.alias("kind"),
        F.when(open_, F.when(ask_brand, F.lit(BRAND_CHECK)).otherwise(F.col("needs"))).alias("ask_type"),
        F.when(open_, F.when(ask_brand, F.col("prefix")).otherwise(drop_slash("new_url"))).alias("ask_url"),
    ).filter(F.col("kind") != NOTHING)


def expand_states(judged: DataFrame) -> DataFrame:
    """What each state's search does: `step` with restarts allowed, `last` with none left.

    A grouped minimum by rank combines inside each task, so the results of a hot query are
    reduced before the shuffle.
    """
    pick = F.struct(
        "kind", "title", F.col("new_url").alias("link"), F.col("model_from_catalog").alias("next"), "ask_type", "ask_url"
    )
    return judged.groupBy(*STATE).agg(
        F.min_by(pick, "rank").alias("step"),
        F.min_by(F.when(F.col("kind") != RESTART, pick), F.when(F.col("kind") != RESTART, F.col("rank"))).alias("last"),
    )


def first_search_match(judged: DataFrame) -> DataFrame:
    """Per state, the lowest-ranked result that passes every gate and is a product page."""
    pick = F.struct("rank", "title", F.col("new_url").alias("link"))
    best = judged.filter(F.col("kind") == FOUND).groupBy(*STATE).agg(F.min_by(pick, "rank").alias("b"))
    return best.select(*STATE, "b.rank", "b.title", "b.link")


def follow(starts: DataFrame, expanded: DataFrame, restarts: int = MAX_RESTARTS) -> DataFrame:
    """Outcome of every distinct start.

    `(product, brand, model, found, title, link, found_model, depth, ask_type, ask_url)`; `found` is
    null where an answer is missing, which the last two columns name. A fixed number of lookups:
    each moves the open searches to the model they restart with. Where very many restart with the
    same model, adaptive execution splits the left partition (a left outer join allows it).
    """
    s = starts.select(*STATE).distinct().withColumns({"now": F.col("model"), "depth": F.lit(0)})
    s = s.withColumn("end", F.lit(None).cast(expanded.schema["step"].dataType))
    for depth in range(restarts + 1):
        choice = "step" if depth < restarts else "last"
        hop = expanded.select("product", "brand", F.col("model").alias("__at"), F.col(choice).alias("__hop"))
        # Searches that have ended look up a name no model has, each its own, so that they spread out.
        moving = F.col("end").isNull()
        at = F.when(moving, F.col("now")).otherwise(F.concat(F.lit("\x00"), F.coalesce("model", F.lit(""))))
        s = skewed_join(s.withColumn("__at", at), hop, ["product", "brand", "__at"], stored=True)
        jumps = moving & (F.coalesce("__hop.kind", F.lit(NOTHING)) == RESTART)
        s = s.select(
            *STATE,
            F.when(jumps, F.col("__hop.next")).otherwise(F.col("now")).alias("now"),
            (F.col("depth") + jumps.cast("int")).alias("depth"),
            F.when(moving & ~jumps, _ended(F.col("__hop"))).otherwise(F.col("end")).alias("end"),
        )
    hit = F.col("end.kind") == FOUND
    return s.select(
        *STATE,
        F.when(F.col("end.kind") != OPEN, hit).alias("found"),
        F.when(hit, F.col("end.title")).alias("title"),
        F.when(hit, F.col("end.link")).alias("link"),
        F.when(hit, F.col("now")).alias("found_model"),
        "depth",
        "end.ask_type",
        "end.ask_url",
    )


def _ended(hop: Column) -> Column:
    """The decision of a state; one whose results decide nothing ends with nothing."""
    fields = ["kind", "title", "link", "next", "ask_type", "ask_url"]
    nothing = F.struct(*[F.lit(NOTHING if f == "kind" else None).cast("string").alias(f) for f in fields])
    return F.coalesce(hop, nothing)


def explore(
    starts: DataFrame,
    results: DataFrame,
    aliases: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    rules: Rules = Rules(),
    restarts: int = MAX_RESTARTS,
) -> DataFrame:
    """What the searches of `starts` and of the states they lead to do (`expand_states`), as a written table.

    Only states that a search reaches are looked up and checked, each once, however many searches come to it.
    A level without a restart is the last.
    """
    levels: list[DataFrame] = []
    facts = kept_facts(pages, rules)
    seen = level = stage(starts.select(*STATE).distinct(), "level")
    for depth in range(restarts + 1):
        # Read for the checks and for their outcome, so worked out once.
        candidates = stage(gated_candidates(level, results, responses, rules), "candidates")
        checks = fetch_and_check(candidates, aliases, facts, responses, rules)
        jumps = Observation()
        moving = F.coalesce(F.sum((F.col("step.kind") == RESTART).cast("long")), F.lit(0))
        expanded = expand_states(judge_candidates(candidates, checks)).observe(jumps, moving.alias("n"))
        levels.append(stage(expanded, "expanded"))
        if depth == restarts or not jumps.get["n"]:
            break
        led = levels[-1].filter(F.col("step.kind") == RESTART).select("product", "brand", F.col("step.next").alias("model"))
        level = stage(null_safe_join(led.distinct(), seen, STATE, "left_anti"), "level")
        seen = seen.unionByName(level)
    return reduce(DataFrame.unionByName, levels)


def search_refine(
    starts: DataFrame,
    results: DataFrame,
    aliases: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    rules: Rules = Rules(),
) -> DataFrame:
    """Search outcome of every distinct `(product, brand, model)` of `starts`."""
    starts = starts.select(*STATE).distinct()
    return follow(starts, explore(starts, results, aliases, pages, responses, rules))
