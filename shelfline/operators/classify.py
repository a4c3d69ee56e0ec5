"""Is a page an available page of a single product? Rules first, then stored verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.base import bind, col, is_true
from ..functions.urls import drop_slash, marketplace_guard, pdf_guard, squeeze_url, url_blocklisted, url_has_path
from ..functions.verdicts import ACCEPT, CATALOG, PASS, REJECT, catalog_model, verdict_page, verdict_url
from ..session import stage
from .skew import skewed_join
from .stores import (
    CATALOG_PICK, KEY, PAGE_CHECK, QUESTION, URL_CHECK, answer_key, by_key, page_facts, page_key, resolve_alias,
)


@dataclass(frozen=True)
class Rules:
    """Parameters of the checks."""

    product_terms: list[str] = field(default_factory=lambda: list(vocab.PRODUCT_TERMS))
    unavailable_terms: list[str] = field(default_factory=lambda: list(vocab.UNAVAILABLE_TERMS))
    url_terms: list[str] = field(default_factory=lambda: list(vocab.URL_DISCARD_TERMS))
    whole_word: bool = False
    strict: bool = True
    marketplace: str = vocab.MARKETPLACE


def rule_check(product_hit: Column | str, url: Column | str, brand: Column | str, rules: Rules) -> Column:
    """The rule part: path, product term, blocklist and marketplace. One trailing slash is ignored."""
    u = drop_slash(url)
    return (
        is_true(col(product_hit))
        & url_has_path(u)
        & ~url_blocklisted(u, rules.url_terms)
        & marketplace_guard(u, brand, rules.marketplace)
    )


def classify_page(
    by_rules: Column | str,
    unavailable: Column | str,
    url_answer: Column | str,
    catalog_answer: Column | str,
    page_answer: Column | str,
    strict: bool = True,
) -> Column:
    """Struct `(is_prod, unavailable, model_from_catalog, needs)`.

    `is_prod` is null while an answer is missing that the decision depends on, and `needs` then
    names the kind of question to ask. Answers that do not matter are not looked at.
    """
    listed = col(catalog_answer).isNotNull()
    page = verdict_page(page_answer, strict)
    return classify_parsed(by_rules, unavailable, verdict_url(url_answer), listed, catalog_model(catalog_answer), page)


def classify_parsed(
    by_rules: Column | str, unavailable: Column | str, link: Column | str, listed: Column | str, picked: Column | str,
    page: Column | str,
) -> Column:
    """`classify_page` of answers as `parsed_answers` keeps them."""
    parsed = F.struct(
        is_true(col(by_rules)).alias("ok"),
        is_true(col(unavailable)).alias("gone"),
        col(link).alias("link"),
        is_true(col(listed)).alias("listed"),
        col(picked).alias("picked"),
        col(page).alias("page"),
    )
    return bind(parsed, lambda x: bind(_route(x), _decide))


def parsed_answers(responses: DataFrame, strict: bool = True) -> DataFrame:
    """One row per `(product, brand, url)` with what its answers say: `link, listed, picked, page`.

    Answers are read where the store is scanned; their text goes no further. Answers from a store of files have one
    row per `cache_key`, which belongs to one kind of question.
    """
    kind, said = F.col("query_type"), F.col("response")
    name = [KEY] if KEY in responses.columns else QUESTION
    known = responses.filter(kind.isin(URL_CHECK, CATALOG_PICK, PAGE_CHECK)).select(
        *name,
        F.when(kind == URL_CHECK, verdict_url("response")).alias("link"),
        F.when((kind == CATALOG_PICK) & said.isNotNull(), True).alias("listed"),
        F.when(kind == CATALOG_PICK, catalog_model("response")).alias("picked"),
        F.when((kind == PAGE_CHECK) & said.isNotNull(), verdict_page("response", strict)).alias("page"),
    )
    # The store holds one answer per question; `min` only makes the row well defined.
    return known.groupBy(*name).agg(*[F.min(c).alias(c) for c in ("link", "listed", "picked", "page")])


def with_answers(asked: DataFrame, responses: DataFrame, strict: bool = True) -> DataFrame:
    """`asked`, about the URL `__ask`, with the columns of `parsed_answers`."""
    answers = parsed_answers(responses, strict)
    if KEY not in responses.columns:
        return skewed_join(asked, answers.withColumnRenamed("url", "__ask"), ["product", "brand", "__ask"])
    answers = stage(answers, "answers")
    for kind, said in ((URL_CHECK, ["link"]), (CATALOG_PICK, ["listed", "picked"]), (PAGE_CHECK, ["page"])):
        asked = by_key(asked, answer_key(kind, "__ask"), answers.select(KEY, *said), stored=True)
    return asked


def _route(x: Column) -> Column:
    """Which answer decides: the link's, the one picked from a listing, or the page's."""
    live = x["ok"] & ~x["gone"]
    by_link = live & is_true(x["link"] == CATALOG)
    from_list = by_link & x["picked"].isNotNull()
    to_page = live & (is_true(x["link"] == PASS) | (by_link & x["listed"] & x["picked"].isNull()))
    needs = (
        F.when(live & x["link"].isNull(), URL_CHECK)
        .when(by_link & ~x["listed"], CATALOG_PICK)
        .when(to_page & x["page"]["verdict"].isNull(), PAGE_CHECK)
    )
    return F.struct(x.alias("x"), from_list.alias("from_list"), to_page.alias("to_page"), needs.alias("needs"))


def _decide(r: Column) -> Column:
    x, page = r["x"], r["x"]["page"]
    is_prod = (
        F.when(~x["ok"], False)
        .when(x["gone"], True)
        .when(r["needs"].isNotNull(), F.lit(None).cast("boolean"))
        .when(x["link"] == REJECT, False)
        .when(r["from_list"], True)
        .otherwise(page["verdict"].isin(ACCEPT, CATALOG))
    )
    model = F.when(r["from_list"], x["picked"]).when(r["to_page"] & (page["verdict"] == CATALOG), page["model"])
    return F.struct(
        is_prod.alias("is_prod"),
        x["gone"].alias("unavailable"),
        model.alias("model_from_catalog"),
        r["needs"].alias("needs"),
    )


def facts_of(pages: DataFrame, rules: Rules) -> DataFrame:
    """Keyword facts of a page store; a table that holds them already is passed through."""
    if "product_hit" in pages.columns:
        return pages
    return page_facts(pages, rules.product_terms, rules.unavailable_terms, rules.whole_word)


def kept_facts(pages: DataFrame, rules: Rules) -> DataFrame:
    """`facts_of` as a written table, for work that reads them several times."""
    facts = facts_of(pages, rules)
    return facts if facts is pages else stage(facts, "facts")


def fetch_and_check(
    keys: DataFrame, aliases: DataFrame, pages: DataFrame, responses: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """Check every distinct `(product, brand, url)` of `keys`.

    `pages` is the page store, or the facts kept of it (`facts_of`); pages and answers from stores of files
    (`sources.keyed`) are looked up by their keys. Returns the key with `new_url`,
    the classification and `needs`. What depends on the URL alone
    (redirect, page, keyword facts) is worked out once per distinct URL, then brought back to the
    keys by a lookup that splits URLs shared by very many keys. A missing product or brand is a key like any other.
    """
    url = squeeze_url("url")
    keys = keys.select(*QUESTION).distinct().withColumn("__fetch", F.when(~pdf_guard(url), url))

    facts = facts_of(pages, rules)
    links = keys.select(F.col("__fetch")).filter(F.col("__fetch").isNotNull()).distinct()
    links = resolve_alias(links, aliases, "__fetch", "new_url")
    if KEY in facts.columns:
        links = by_key(links, page_key("new_url"), facts)
    else:
        links = links.join(facts.withColumnRenamed("url", "new_url"), "new_url", "left")

    seen = skewed_join(keys, links, ["__fetch"])
    # Asked about under the URL without its trailing slash; not fetched means nothing to ask.
    seen = seen.withColumn("new_url", F.coalesce("new_url", url)).withColumn("__ask", drop_slash("new_url"))
    seen = seen.withColumn("__rules", F.col("has_page") & rule_check("product_hit", "new_url", "brand", rules))

    judged = with_answers(seen, responses, rules.strict)
    c = classify_parsed("__rules", "unavailable", "link", "listed", "picked", "page")
    return judged.select(*QUESTION, "new_url", c.alias("c")).select(*QUESTION, "new_url", "c.*")
