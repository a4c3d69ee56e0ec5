"""URL expressions: normalising, guards and the brand test."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import MARKETPLACE
from .base import chop_last, col, is_true, terms_array

SCHEME = "://"


def squeeze_url(url: Column | str) -> Column:
    """Remove every space."""
    return F.replace(col(url), F.lit(" "), F.lit(""))


def drop_slash(url: Column | str) -> Column:
    """Remove exactly one trailing slash."""
    return chop_last(url, "/")


def pdf_guard(url: Column | str) -> Column:
    """True where there is nothing to fetch: no URL, or one ending in `.pdf` (case-sensitive)."""
    url = col(url)
    return url.isNull() | is_true(F.endswith(url, F.lit(".pdf")))


def after_scheme(url: Column | str) -> Column:
    """The text after the last `://`, or all of it."""
    return F.substring_index(col(url), SCHEME, -1)


def url_has_path(url: Column | str) -> Column:
    return is_true(F.contains(after_scheme(url), F.lit("/")))


def url_blocklisted(url: Column | str, terms: list[str], fold_case: bool = True) -> Column:
    """Any term is a substring of the URL. Own pages fold the case of the URL, search results do not."""
    url = F.lower(col(url)) if fold_case else col(url)
    return is_true(F.exists(terms_array(terms), lambda t: F.contains(url, t)))


def marketplace_guard(url: Column | str, brand: Column | str, marketplace: str = MARKETPLACE) -> Column:
    """A marketplace link passes only for the marketplace's own brand."""
    name = F.lit(marketplace)
    own = is_true(F.contains(F.lower(col(brand)), name))
    return own | ~is_true(F.contains(F.lower(col(url)), name))


def url_core(url: Column | str) -> Column:
    """The part of a URL worth showing: no scheme, cut before the first `.html`."""
    return F.substring_index(after_scheme(url), ".html", 1)


def link_prefix(url: Column | str) -> Column:
    """Host and first path segment."""
    url = col(url)
    parts = F.split(url, "/")
    return F.array_join(
        F.when(F.contains(url, F.lit(SCHEME)), F.slice(parts, 3, 2)).otherwise(F.slice(parts, 1, 2)), "/"
    )


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and the plain letter each stands for, by Unicode decomposition."""
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0180), *range(0x01CD, 0x0218), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            src.append(chr(cp))
            dst.append(base)
    # Single letters without a decomposition.
    for a, b in [("Ø", "O"), ("ø", "o"), ("Đ", "D"), ("đ", "d"), ("Ł", "L"), ("ł", "l"), ("ı", "i")]:
        src.append(a)
        dst.append(b)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _fold_table()
# Letters written with two plain ones.
_FOLD_WIDE = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th"}


def fold_accents(c: Column | str) -> Column:
    out = F.translate(col(c), _FOLD_FROM, _FOLD_TO)
    for wide, plain in _FOLD_WIDE.items():
        out = F.replace(out, F.lit(wide), F.lit(plain))
    return out


def brand_in_link(brand: Column | str, prefix: Column | str) -> Column:
    """The folded brand name, without separators, occurs in the link prefix."""
    name = F.lower(F.translate(fold_accents(brand), " -_", ""))
    where = F.lower(F.translate(col(prefix), "-_", ""))
    return is_true(F.contains(where, name))


def cache_key(prefix: str, url: Column | str, width: int = 200) -> Column:
    """File-name style key of stores written elsewhere: long URLs share keys.

    Offered for reading such stores; our own joins use the full URL with product and brand.
    """
    return F.left(F.concat(F.lit(prefix), F.replace(col(url), F.lit("/"), F.lit("\\")), F.lit(".html")), F.lit(width))


def search_query(brand: Column | str, model: Column | str, product: Column | str) -> Column:
    """Text of the search for one product; null parts are left out."""
    return F.concat_ws(" ", F.lit("buy"), col(brand), col(model), col(product))
