"""From stored answer text to decisions. A null answer stays null: the row is undecided."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import bind, chop_last, strip
from .text import clean_response

REJECT, CATALOG, PASS, ACCEPT = "reject", "catalog", "pass", "accept"


def verdict_url(response: Column | str) -> Column:
    """Verdict on a URL from the first word of the first line."""

    def read(word: Column) -> Column:
        return F.when(word == "false", REJECT).when(word == "catalog", CATALOG).when(word.isNotNull(), PASS)

    return bind(F.substring_index(F.substring_index(clean_response(response), " ", 1), "\n", 1), read)


def catalog_model(response: Column | str) -> Column:
    """Model named by a catalog page, without one closing full stop; empty is null."""
    return bind(clean_response(response), lambda r: F.nullif(chop_last(r, "."), F.lit("")))


def verdict_page(response: Column | str, strict: bool = True) -> Column:
    """Verdict on page text: struct of the outcome and, for a catalog, the model it names.

    Strict: the first line decides, and a second line names a model only after `false`. Not
    strict: only an answer that is `true` as a whole accepts, and any other answer with a second
    line is a catalog. An empty model line names nothing and rejects.
    """

    def lines(r: Column) -> Column:
        head = strip(F.substring_index(r, "\n", 1))
        second = F.nullif(strip(F.get(F.split(r, "\n"), F.lit(1))), F.lit(""))
        return bind(F.struct(r.alias("r"), head.alias("head"), second.alias("second")), decide)

    def decide(x: Column) -> Column:
        yes = x["head"].isin("true", "true.") if strict else x["r"] == "true"
        lists = x["second"].isNotNull() & (x["head"].isin("false", "false.") if strict else F.lit(True))
        kind = F.when(yes, ACCEPT).when(lists, CATALOG).when(x["r"].isNotNull(), REJECT)
        return F.struct(kind.alias("verdict"), F.when(lists & ~yes, x["second"]).alias("model"))

    return bind(clean_response(response), lines)


def verdict_brand(response: Column | str) -> Column:
    """True where the answer starts with `true`."""
    return F.startswith(clean_response(response), F.lit("true"))


def fresh_model_name(response: Column | str) -> Column:
    """First line of a name answer; answers that decline are null."""

    def named(name: Column) -> Column:
        declined = F.rlike(F.lower(name), F.lit(r"^title (is )?uninformative\.?$"))
        return F.when(~declined & (name != ""), name)

    return bind(strip(F.substring_index(clean_response(response, keep_case=True), "\n", 1)), named)
