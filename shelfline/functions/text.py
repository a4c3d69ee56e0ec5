"""Text expressions over page HTML, labels and answers."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import SPACE, bind, col, collapse_spaces, strip

# What is not visible text. One left-to-right pass over alternatives, so that a tag inside a
# comment or a closing tag inside a script is never taken for markup of its own. Whatever is not
# closed runs to the end of the page, which also keeps broken pages linear: no opening is tried twice.
# Names end at white space, a slash or the end of the tag: `<style-guide>` is an element of its own.
# A quoted value, after an equals sign, may hold `>`; quotes elsewhere, as in a value without quotes, are plain
# characters. A tag whose quotes do not close ends at the first `>`.
_ATTRIBUTES = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+"""
_HIDDEN = "|".join(
    rf"<{name}(?=[\s/>]){_ATTRIBUTES}>.*?(?:</{name}(?=[\s/>])[^>]*(?:>|\z)|\z)" for name in ("script", "style", "template")
)
MARKUP = rf"(?is)<!--.*?(?:-->|\z)|{_HIDDEN}|<[!?/a-z]{_ATTRIBUTES}>|<[!?/a-z][^>]*(?:>|\z)"
TITLE = r"(?is)<title(?=[\s/>])[^>]*(?:>|\z)(.*?)(?:</title|\z)"

# Fixed value: characters that no brand or model name keeps.
LABEL_NOISE = "%&?/:;=+!*()'\"\\"

# Named references as HTML defines them, with the few that may stand without a semicolon.
_NAMES = {k.removesuffix(";"): v for k, v in html5.items() if k.endswith(";")}
_BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
# Frequent ones first: a lookup goes through the names in order.
_COMMON = ["amp", "nbsp", "quot", "lt", "gt", "copy", "middot", "eacute", "auml", "ouml", "uuml"]
_NAMES = {k: _NAMES[k] for k in _COMMON} | _NAMES
_NAMED = r"^([a-zA-Z][a-zA-Z0-9]*+);"
_BARE_NAMED = "^(" + "|".join(_BARE) + ")"
_NUMBER = r"^#([0-9]++|[xX][0-9a-fA-F]++);?"
# Numbers 128 to 159 mean what they are in Windows-1252, where it has a character.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _table(pairs: dict[str, str]) -> Column:
    """One map literal, built while planning."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())), F.lit("\x1e"), F.lit("\x1f"))


def _code_point(digits: Column) -> Column:
    """The character of a numeric reference, `digits` as in `65` or `x41`; unusable numbers give the replacement character."""
    windows = _table({str(k): v for k, v in _WINDOWS.items()})
    hexed = F.lower(F.substring(digits, 1, 1)) == "x"
    plain = F.regexp_replace(digits, "^[xX]?0*", "")
    # More than seven digits are beyond all characters, however many they are.
    number = F.when(F.length(plain) > 7, F.lit(0x110000).cast("long")).otherwise(
        F.when(hexed, F.conv(plain, 16, 10)).otherwise(plain).try_cast("long")
    )

    def char(n: Column) -> Column:
        usable = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        plain_char = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.coalesce(F.when(n.between(128, 159), F.try_element_at(windows, n.cast("string"))), plain_char)

    return bind(F.coalesce(number, F.lit(0)), char)


def decode_entities(c: Column | str) -> Column:
    """Decode character references in one pass, so `&amp;lt;` becomes `&lt;` and not `<`."""
    c = col(c)
    table, bare = _table(_NAMES), _table({k: html5[k] for k in _BARE})

    def piece(p: Column) -> Column:
        def after(n: Column) -> Column:
            return F.substring(p, n + 1, F.length(p))

        def numeric(m: Column) -> Column:
            return F.when(m != "", F.concat(_code_point(F.regexp_extract(p, _NUMBER, 1)), after(F.length(m))))

        def named(m: Column) -> Column:
            return F.when(m != "", F.concat(F.try_element_at(table, m), after(F.length(m) + 1)))

        def unclosed(m: Column) -> Column:
            return F.when(m != "", F.concat(F.try_element_at(bare, m), after(F.length(m))))

        # Frequent names first: most references need no pattern and no table.
        frequent = reduce(
            lambda c, n: F.when(F.startswith(p, F.lit(n + ";")), F.concat(F.lit(_NAMES[n]), after(F.lit(len(n) + 1)))).otherwise(c),
            reversed(_COMMON), F.lit(None).cast("string"),
        )
        # Null where the ampersand starts nothing known: then it stands for itself.
        return F.coalesce(
            frequent,
            bind(F.regexp_extract(p, _NUMBER, 0), numeric), bind(F.regexp_extract(p, _NAMED, 1), named),
            bind(F.regexp_extract(p, _BARE_NAMED, 1), unclosed), F.concat(F.lit("&"), p),
        )

    def whole(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))

    return F.when(F.contains(c, F.lit("&")), bind(F.split(c, "&"), whole)).otherwise(c)


def extract_text(html: Column | str) -> Column:
    """Visible text of a page."""
    return bind(F.regexp_replace(col(html), MARKUP, ""), decode_entities)


def extract_title(html: Column | str) -> Column:
    """Content of the first title element; null where there is none or it is empty."""
    return bind(F.regexp_extract(col(html), TITLE, 1), lambda t: F.nullif(decode_entities(t), F.lit("")))


def clean_title(title: Column | str) -> Column:
    """Strip, turn line feeds, dashes and bars into spaces, collapse white space (no second strip)."""
    return collapse_spaces(F.translate(strip(title), "\n—–|-", "     "))


def clean_label(label: Column | str, numbered_only: bool = False) -> Column:
    """Clean a brand or model name as it comes out of a generated list.

    The text after the first `'. '` is the name (a list number precedes it); `numbered_only`
    removes nothing but a leading number, which keeps names like `St. Ives`.
    """
    label = col(label)
    plain = F.replace(label, F.lit("**"), F.lit(""))
    if numbered_only:
        name = F.regexp_replace(strip(plain), r"^[0-9]+\. ", "")
    else:
        name = F.coalesce(F.get(F.split(plain, r"\. "), F.lit(1)), label)
    return collapse_spaces(strip(F.translate(name, LABEL_NOISE, "")))


def first_n_words(text: Column | str, n: int = 30) -> Column:
    """The first `n` words joined by one space; the split stops after the n-th."""
    words = F.split(strip(text), f"{SPACE}+", n + 1)
    return F.array_join(F.slice(words, 1, n), " ")


def truncate_to_budget(text: Column | str, budget: int = 16_385) -> Column:
    """Text of at most `budget` words as it is, longer text cut to its first `budget` words."""
    text = col(text)

    def cut(words: Column) -> Column:
        return F.when(F.size(words) > budget, F.array_join(F.slice(words, 1, budget), " "))

    return F.coalesce(bind(F.split(strip(text), f"{SPACE}+", budget + 1), cut), text)


def strip_quotes(c: Column | str) -> Column:
    return F.replace(col(c), F.lit('"'), F.lit(""))


def clean_response(response: Column | str, keep_case: Column | bool = False) -> Column:
    """Answer text without apostrophes, stripped, lowercased unless the question asks for a name."""
    response = col(response)
    keep = F.lit(keep_case) if isinstance(keep_case, bool) else keep_case
    cased = F.when(keep, response).otherwise(F.lower(response))
    return strip(F.replace(cased, F.lit("'"), F.lit("")))


def first_line(c: Column | str) -> Column:
    return strip(F.substring_index(col(c), "\n", 1))
