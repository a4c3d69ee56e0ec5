"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode text tools see it; `\s` alone covers ASCII only.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
# The same characters one by one, for trimming without a pattern.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`.

    Written inline, a costly argument would be evaluated again at each use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms_array(terms: list[str]) -> Column:
    """Terms as one array literal: splitting a constant is done once, while planning."""
    if not terms:
        return F.array().cast("array<string>")
    if any("\n" in t for t in terms):
        raise ValueError("a term cannot span lines")
    return F.split(F.lit("\n".join(terms)), "\n")


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"{SPACE}+", " ")


def is_true(c: Column) -> Column:
    """Two-valued reading of a condition: unknown counts as false."""
    return F.coalesce(c, F.lit(False))


def chop_last(c: Column | str, suffix: str) -> Column:
    """Remove exactly one trailing `suffix` of one character."""
    c = col(c)
    return F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
