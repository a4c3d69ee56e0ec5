"""The functions by name for SQL users. Spark inlines their bodies, so they cost no call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text
from .base import SPACE, SPACES
from .urls import _FOLD_FROM, _FOLD_TO, _FOLD_WIDE

_SPACES = "".join(f"\\u{ord(c):04x}" for c in SPACES)


def _lit(x: str) -> str:
    """A string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `value` evaluated once under `name`."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _strip(x: str) -> str:
    return f"btrim({x}, '{_SPACES}')"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, {_lit(SPACE + '+')}, ' ')"


def _map(pairs: dict[str, str]) -> str:
    joined = "\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())
    return f"str_to_map({_lit(joined)}, '\x1e', '\x1f')"


def _character(digits: str) -> str:
    """The character of a numeric reference."""
    number = f"if(length(q) > 7, 1114112L, coalesce(try_cast(if(lower(left({digits}, 1)) = 'x', conv(q, 16, 10), q) AS BIGINT), 0L))"
    plain = "if(n > 0 AND n <= 1114111 AND NOT n BETWEEN 55296 AND 57343, decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32'), '\ufffd')"
    windows = _map({str(k): v for k, v in text._WINDOWS.items()})
    told = f"coalesce(if(n BETWEEN 128 AND 159, try_element_at({windows}, cast(n AS STRING)), NULL), {plain})"
    return _let("q", f"regexp_replace({digits}, '^[xX]?0*', '')", _let("n", number, told))


def _decode(x: str) -> str:
    """Character references decoded in one pass, as `text.decode_entities` does."""
    frequent = " ".join(
        f"WHEN startswith(p, '{n};') THEN concat({_lit(text._NAMES[n])}, substring(p, {len(n) + 2}))" for n in text._COMMON
    )
    number, named, bare = (_lit(x) for x in (text._NUMBER, text._NAMED, text._BARE_NAMED))
    digits = f"regexp_extract(p, {number}, 1)"
    after = "substring(p, length(m) + {})"
    piece = ", ".join([
        f"CASE {frequent} END",
        _let("m", f"regexp_extract(p, {number}, 0)", f"if(m <> '', concat({_character(digits)}, {after.format(1)}), NULL)"),
        _let("m", f"regexp_extract(p, {named}, 1)", f"if(m <> '', concat(try_element_at({_map(text._NAMES)}, m), {after.format(2)}), NULL)"),
        _let("m", f"regexp_extract(p, {bare}, 1)", f"if(m <> '', concat(try_element_at({_map({k: text.html5[k] for k in text._BARE})}, m), {after.format(1)}), NULL)"),
        "concat('&', p)",
    ])
    parts = f"concat(get(w, 0), array_join(transform(slice(w, 2, size(w)), p -> coalesce({piece})), ''))"
    return f"if(contains({x}, '&'), {_let('w', f'split({x}, {_lit(chr(38))})', parts)}, {x})"


def _fold(x: str) -> str:
    out = f"translate({x}, {_lit(_FOLD_FROM)}, {_lit(_FOLD_TO)})"
    for wide, plain in _FOLD_WIDE.items():
        out = f"replace({out}, '{wide}', '{plain}')"
    return out


def _label(x: str) -> str:
    name = f"coalesce(get(split(replace({x}, '**', ''), {_lit(chr(92) + '. ')}), 1), {x})"
    return _collapse(_strip(f"translate({name}, {_lit(text.LABEL_NOISE)}, '')"))


_ANSWER = _strip("replace(lower(r), '\\'', '')")
_WORDS = f"split({_strip('x')}, {_lit(SPACE + '+')}, n + 1)"
_TERM_COUNT = "if(contains(t, k), cast((length(t) - length(replace(t, k, ''))) / length(k) AS INT), 0)"
_HEAD = _strip("substring_index(a, '\\n', 1)")
_SECOND = f"nullif({_strip(chr(103) + 'et(split(a, ' + _lit(chr(92) + 'n') + '), 1)')}, '')"
_PAGE = _let("a", _ANSWER, _let("h", _HEAD, _let("s", _SECOND, (
    "named_struct('verdict', CASE WHEN h IN ('true', 'true.') THEN 'accept' WHEN s IS NOT NULL AND h IN ('false', 'false.')"
    " THEN 'catalog' WHEN a IS NOT NULL THEN 'reject' END, 'model', if(h IN ('false', 'false.'), s, NULL))"
))))

BODIES: dict[str, tuple[str, str, str]] = {
    "squeeze_url": ("u STRING", "STRING", "replace(u, ' ', '')"),
    "drop_slash": ("u STRING", "STRING", "if(endswith(u, '/'), left(u, length(u) - 1), u)"),
    "pdf_guard": ("u STRING", "BOOLEAN", "u IS NULL OR endswith(u, '.pdf')"),
    "url_has_path": ("u STRING", "BOOLEAN", "coalesce(contains(substring_index(u, '://', -1), '/'), false)"),
    "url_core": ("u STRING", "STRING", "substring_index(substring_index(u, '://', -1), '.html', 1)"),
    "link_prefix": (
        "u STRING", "STRING",
        "array_join(slice(split(u, '/'), if(contains(u, '://'), 3, 1), 2), '/')",
    ),
    "cache_key": ("p STRING, u STRING", "STRING", "left(concat(p, replace(u, '/', '\\\\'), '.html'), 200)"),
    "search_query": ("b STRING, m STRING, p STRING", "STRING", "concat_ws(' ', 'buy', b, m, p)"),
    "strip_quotes": ("x STRING", "STRING", "replace(x, '\"', '')"),
    "first_line": ("x STRING", "STRING", _strip("substring_index(x, '\\n', 1)")),
    "clean_response": ("r STRING", "STRING", _ANSWER),
    "verdict_brand": ("r STRING", "BOOLEAN", f"startswith({_ANSWER}, 'true')"),
    "verdict_url": (
        "r STRING", "STRING",
        f"CASE substring_index(substring_index({_ANSWER}, ' ', 1), '\\n', 1)"
        " WHEN 'false' THEN 'reject' WHEN 'catalog' THEN 'catalog' ELSE if(r IS NULL, NULL, 'pass') END",
    ),
    "verdict_page": ("r STRING", "STRUCT<verdict: STRING, model: STRING>", _PAGE),
    "catalog_model": ("r STRING", "STRING", _let("a", _ANSWER, "nullif(if(endswith(a, '.'), left(a, length(a) - 1), a), '')")),
    "url_blocklisted": (
        "u STRING, terms ARRAY<STRING>", "BOOLEAN", _let("l", "lower(u)", "coalesce(exists(terms, k -> contains(l, k)), false)"),
    ),
    "marketplace_guard": (
        "u STRING, b STRING, m STRING", "BOOLEAN", "coalesce(contains(lower(b), m), false) OR NOT coalesce(contains(lower(u), m), false)",
    ),
    "fold_accents": ("x STRING", "STRING", _fold("x")),
    "brand_in_link": (
        "b STRING, p STRING", "BOOLEAN",
        f"coalesce(contains(lower(translate(p, '-_', '')), lower(translate({_fold('b')}, ' -_', ''))), false)",
    ),
    "extract_text": ("h STRING", "STRING", _let("x", f"regexp_replace(h, {_lit(text.MARKUP)}, '')", _decode("x"))),
    "extract_title": ("h STRING", "STRING", _let("x", f"regexp_extract(h, {_lit(text.TITLE)}, 1)", f"nullif({_decode('x')}, '')")),
    "clean_title": ("x STRING", "STRING", _collapse(f"translate({_strip('x')}, '\\n—–|-', '     ')")),
    "clean_label": ("x STRING", "STRING", _label("x")),
    "first_n_words": ("x STRING, n INT", "STRING", f"array_join(slice({_WORDS}, 1, n), ' ')"),
    "truncate_to_budget": (
        "x STRING, n INT", "STRING", f"coalesce({_let('w', _WORDS, 'if(size(w) > n, array_join(slice(w, 1, n), chr(32)), NULL)')}, x)",
    ),
    "product_keyword_hit": (
        "x STRING, terms ARRAY<STRING>", "BOOLEAN", _let("t", "lower(x)", "coalesce(exists(terms, k -> contains(t, k)), false)"),
    ),
    "unavailable_counts": (
        "x STRING, terms ARRAY<STRING>", "MAP<STRING, INT>",
        f"map_from_arrays(terms, {_let('t', 'lower(x)', f'transform(terms, k -> {_TERM_COUNT})')})",
    ),
}

_HITS = _let("t", "lower(x)", f"filter(transform(terms, k -> named_struct('term', k, 'n', {_TERM_COUNT})), h -> h.n > 0)")
_COMMAS = "replace(replace(response, ',', ' '), ';', ',')"
_TIDY = f"transform(split({_COMMAS}, {_lit(chr(92) + 'n')}), s -> regexp_replace({_strip('s')}, ',\\\\z', ''))"
_LINES = f"filter({_TIDY}, s -> length(s) - length(replace(s, ',', '')) = 2)"

_ROWS = (
    f"filter(transform({_LINES}, (s, i) -> named_struct('at', i, 'line', s)), h -> h.at <> 0 OR h.line <> 'Brand,Model,URL')"
)


def _field(i: int) -> str:
    return f"nullif(get(split(line, ','), {i}), '')"


#: Functions that give rows: `FROM answers a, LATERAL product_lines(a.product, a.response)`.
TABLES: dict[str, tuple[str, str, str]] = {
    "term_hits": (
        "x STRING, terms ARRAY<STRING>", "term STRING, n INT", f"SELECT h.term, h.n FROM (SELECT explode({_HITS}) AS h)",
    ),
    "product_lines": (
        "product STRING, response STRING", "brand STRING, model STRING, url STRING, line INT",
        # Without a WHERE: that makes the rows of an answer come back by a join on its whole text.
        f"SELECT {_label(_field(0))}, {_label(_field(1))}, {_field(2)}, at FROM (SELECT h.at, h.line FROM (SELECT explode({_ROWS}) AS h))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session and return their names."""
    for name, (args, returns, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    for name, (args, returns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({returns}) RETURN {body}")
    return sorted([*BODIES, *TABLES])
