"""The inputs of `workload/inputs.py` as SQL, for the side-by-side comparison."""

from __future__ import annotations

from workload.terms import PRODUCT_TERMS, UNAVAILABLE_TERMS, URL_TERMS

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+\z', '')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def squeeze(u: str) -> str:
    return f"replace({u}, ' ', '')"


def drop_slash(u: str) -> str:
    return f"(CASE WHEN {u} LIKE '%/' THEN left({u}, length({u}) - 1) ELSE {u} END)"


def before(x: str, sep: str) -> str:
    return f"list_extract(string_split({x}, {sep}), 1)"


def after_scheme(u: str) -> str:
    return f"list_extract(string_split({u}, '://'), -1)"


def prefix(u: str) -> str:
    return (
        f"(CASE WHEN contains({u}, '://') THEN array_to_string(list_slice(string_split({u}, '/'), 3, 4), '/')"
        f" ELSE array_to_string(list_slice(string_split({u}, '/'), 1, 2), '/') END)"
    )


def any_of(x: str, terms: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ", false)"


def answer(r: str, lower: bool = True) -> str:
    r = f"lower({r})" if lower else r
    return strip(f"replace({r}, '''', '')")


# The driver pages close what they open, have no quoted `>` and no upper case in tags.
MARKUP = r"(?s)<!--.*?-->|<(?:script|style)>.*?</(?:script|style)>|<[^<>]*>|<[^>]*$"


def decode(x: str) -> str:
    # The references that occur in the driver pages; the ampersand last.
    return (
        f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
    )


def visible(html: str) -> str:
    return decode(f"regexp_replace({html}, '{MARKUP}', '', 'g')")


def title(html: str) -> str:
    return "nullif(" + decode(rf"regexp_extract({html}, '(?is)<title\b[^>]*>(.*?)</title', 1)") + ", '')"


def clean_title(t: str) -> str:
    return collapse(f"translate({strip(t)}, chr(10) || '—–|-', '     ')")


def clean_label(x: str) -> str:
    base = f"coalesce(list_extract(string_split(replace({x}, '**', ''), '. '), 2), {x})"
    return collapse(strip(rf"regexp_replace({base}, '[%&?/:;=+!*()''\"\\]', '', 'g')"))


def has_path(u: str) -> str:
    return f"contains({after_scheme(u)}, '/')"


def market_ok(u: str, brand: str) -> str:
    return f"(contains(lower({brand}), 'amazon') OR NOT contains(lower({u}), 'amazon'))"


def rules(hit: str, u: str, brand: str) -> str:
    u = drop_slash(u)
    return (
        f"({hit} AND {has_path(u)} AND NOT {any_of(f'lower({u})', URL_TERMS)} AND {market_ok(u, brand)})"
    )


def query(b: str, m: str, p: str) -> str:
    return f"concat_ws(' ', 'buy', {b}, {m}, {p})"


PRODUCTS = r"""products_v AS (
  SELECT page_id AS id, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS product,
    regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([^./]+)', 1) AS brand,
    regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS model, url
  FROM pages)"""

VERSIONED = PRODUCTS + """,
versioned AS (
  SELECT *, CAST(id % 2 + 1 AS INTEGER) AS major, CAST(id % 3 AS INTEGER) AS minor FROM products_v)"""

ALIASES = """aliases AS (
  SELECT url, string_split(url, '?')[1] AS new_url FROM pages WHERE contains(url, '?'))"""

STORE = """page_store AS (
  SELECT u AS url, arg_min(html, page_id) AS html FROM (
    SELECT page_id, html, string_split(url, '?')[1] AS u FROM pages WHERE url NOT LIKE '%#top')
  GROUP BY u)"""

FACTS = f"""texts AS (SELECT url, lower({visible('html')}) AS t FROM page_store),
facts AS (
  SELECT url, {any_of('t', PRODUCT_TERMS)} AS hit, {any_of('t', UNAVAILABLE_TERMS)} AS gone FROM texts)"""

HITS = f"""n AS (SELECT count(*) AS n FROM pages),
own_first AS (SELECT product, brand, model, min(id) AS first FROM products_v GROUP BY ALL),
pair_first AS (SELECT product, brand, min(id) AS first FROM products_v GROUP BY ALL),
raw_hits AS (
  SELECT product, brand, model, r AS rank, (first * 7 + r * 13) % n AS hit, first
  FROM own_first, range(1, 6) t(r), n
  UNION ALL
  SELECT product, brand, 'm' || k, r, (first * 11 + r * 17 + k * 29) % n, first
  FROM pair_first, range(0, 6) a(k), range(1, 6) b(r), n),
hits AS (
  SELECT h.*, 'T' || hit AS title, url AS link, {query('brand', 'model', 'product')} AS query
  FROM raw_hits h JOIN pages ON page_id = hit),
results AS (
  SELECT query, CAST(rank AS INTEGER) AS rank, title, link FROM hits
  WHERE query IN (SELECT query FROM hits GROUP BY query HAVING min(model) <> 'm5' AND min(first) % 17 <> 0))"""

ASKED = f"""asked_links AS (
  SELECT product, brand, {squeeze('url')} AS link, id AS h FROM products_v
  UNION ALL SELECT product, brand, {drop_slash('link')}, hit FROM hits),
asked AS (
  SELECT product, brand, {drop_slash('coalesce(a.new_url, l.link)')} AS url, min(h) AS h
  FROM asked_links l LEFT JOIN aliases a ON a.url = l.link GROUP BY ALL)"""

RESPONSES = f"""brand_keys AS (SELECT DISTINCT product, brand, {prefix(drop_slash('link'))} AS url FROM hits),
own_urls AS (
  SELECT product, brand, coalesce(a.new_url, p.url) AS url, min(id) AS h
  FROM products_v p LEFT JOIN aliases a ON a.url = {squeeze('p.url')} GROUP BY ALL),
responses AS (
  SELECT 'check_url' AS query_type, product, brand, url, CASE WHEN h % 23 <> 5 THEN CASE h % 7 WHEN 0 THEN 'False' || chr(10) || 'reason: third party'
    WHEN 1 THEN 'Catalog' || chr(10) || 'It''s a lineup' WHEN 2 THEN 'Unsure'
    ELSE 'True ' || chr(10) || 'It''s official' END END AS response
  FROM asked
  UNION ALL
  SELECT 'find_in_catalog', product, brand, url, CASE WHEN h % 7 = 1 AND h % 29 <> 1 THEN
    CASE WHEN h % 5 = 4 THEN ' '''' ' ELSE '''M' || (h % 6) || '''.' END END
  FROM asked
  UNION ALL
  SELECT 'check_product_page', product, brand, url, CASE WHEN h % 31 <> 3 THEN CASE h % 5 WHEN 0 THEN 'True'
    WHEN 1 THEN 'False' || chr(10) || 'M' || (h % 6) WHEN 2 THEN 'False.'
    WHEN 3 THEN 'TRUE' || chr(10) || 'looks official' ELSE 'false' || chr(10) || '''M' || ((h + 1) % 6) || '''' END END
  FROM asked
  UNION ALL
  SELECT 'check_url_brand', product, brand, url,
    CASE WHEN (length(brand) + length(url)) % 11 = 7 THEN NULL
      WHEN (length(brand) + length(url)) % 4 = 0 THEN 'False' ELSE ' ''True''.' END
  FROM brand_keys
  UNION ALL
  SELECT 'update_model_name', product, brand, url, CASE WHEN h % 13 = 1 THEN NULL WHEN h % 11 = 0 THEN 'Title uninformative.'
    ELSE ' Model ''X' || h || ''' ' || chr(10) || 'because of the title' END
  FROM own_urls)"""

# Everything the checks read.
WORLD = ",\n".join([PRODUCTS, ALIASES, STORE, FACTS, HITS, ASKED, RESPONSES])

_R = answer("response")
_LINE2 = f"nullif({strip(f'list_extract(string_split({_R}, chr(10)), 2)')}, '')"
_HEAD = strip(before(_R, "chr(10)"))

VERDICTS = f"""url_v AS (
  SELECT product, brand, url, {before(before(_R, "' '"), "chr(10)")} AS word
  FROM responses WHERE query_type = 'check_url'),
pick_v AS (
  SELECT product, brand, url, nullif(CASE WHEN {_R} LIKE '%.' THEN left({_R}, length({_R}) - 1) ELSE {_R} END, '') AS m
  FROM responses WHERE query_type = 'find_in_catalog' AND response IS NOT NULL),
page_v AS (
  SELECT product, brand, url, CASE WHEN {_HEAD} IN ('true', 'true.') THEN 'accept'
    WHEN {_HEAD} IN ('false', 'false.') AND {_LINE2} IS NOT NULL THEN 'catalog' ELSE 'reject' END AS v,
    CASE WHEN {_HEAD} IN ('false', 'false.') THEN {_LINE2} END AS m
  FROM responses WHERE query_type = 'check_product_page' AND response IS NOT NULL)"""


def checks(keys: str, name: str = "checks") -> str:
    """Classification of the `(product, brand, url)` rows of `keys`; needs WORLD and VERDICTS."""
    return f"""{name}_found AS (
  SELECT k.product, k.brand, k.url, coalesce(a.new_url, {squeeze('k.url')}) AS new_url, f.hit, f.gone,
    f.url IS NOT NULL AND k.url NOT LIKE '%.pdf' AS has_page
  FROM (SELECT DISTINCT product, brand, url FROM {keys}) k
  LEFT JOIN aliases a ON a.url = {squeeze('k.url')}
  LEFT JOIN facts f ON f.url = coalesce(a.new_url, {squeeze('k.url')})),
{name}_live AS (
  SELECT s.*, coalesce(has_page AND {rules('hit', 'new_url', 's.brand')}, false) AS ok,
    coalesce(gone, false) AS unavailable, u.word, p.url IS NOT NULL AS pick_there, p.m AS pick_m, g.v, g.m AS page_m
  FROM {name}_found s
  LEFT JOIN url_v u ON (u.product, u.brand, u.url) = (s.product, s.brand, {drop_slash('s.new_url')})
  LEFT JOIN pick_v p ON (p.product, p.brand, p.url) = (s.product, s.brand, {drop_slash('s.new_url')})
  LEFT JOIN page_v g ON (g.product, g.brand, g.url) = (s.product, s.brand, {drop_slash('s.new_url')})),
{name}_open AS (
  SELECT *, CASE WHEN NOT ok OR unavailable OR word = 'false' THEN NULL WHEN word IS NULL THEN 'check_url'
    WHEN word = 'catalog' AND NOT pick_there THEN 'find_in_catalog'
    WHEN word = 'catalog' AND pick_m IS NOT NULL THEN NULL
    WHEN v IS NULL THEN 'check_product_page' END AS needs
  FROM {name}_live),
{name} AS (
  SELECT product, brand, url, new_url,
    CASE WHEN NOT ok THEN false WHEN unavailable THEN true WHEN needs IS NOT NULL THEN NULL
      WHEN word = 'false' THEN false WHEN word = 'catalog' AND pick_m IS NOT NULL THEN true
      ELSE v <> 'reject' END AS is_prod,
    unavailable,
    CASE WHEN ok AND NOT unavailable AND needs IS NULL THEN
      CASE WHEN word = 'false' THEN NULL WHEN word = 'catalog' AND pick_m IS NOT NULL THEN pick_m
        WHEN v = 'catalog' THEN page_m END END AS model_from_catalog,
    needs
  FROM {name}_open)"""


# Search: every state a row may reach, its gated candidates, and four steps along them.
CANDIDATES = f"""starts AS (SELECT DISTINCT product, brand, model FROM products_v),
states AS (
  SELECT * FROM starts
  UNION SELECT product, brand, m FROM pick_v WHERE m IS NOT NULL AND (product, brand) IN (SELECT (product, brand) FROM starts)
  UNION SELECT product, brand, m FROM page_v WHERE m IS NOT NULL AND (product, brand) IN (SELECT (product, brand) FROM starts)),
linked AS (
  SELECT s.*, rank, title, {drop_slash('link')} AS url, {prefix(drop_slash('link'))} AS pre
  FROM states s JOIN results r ON r.query = {query('s.brand', 's.model', 's.product')}),
candidates AS (
  SELECT l.*, CASE WHEN contains(lower(translate(pre, '-_', '')), lower(replace(replace(replace(strip_accents(l.brand), ' ', ''), '-', ''), '_', ''))) THEN true
    ELSE {answer('b.response')} LIKE 'true%' END AS brand_ok
  FROM linked l LEFT JOIN responses b ON b.query_type = 'check_url_brand'
    AND (b.product, b.brand, b.url) = (l.product, l.brand, l.pre)
  WHERE {has_path('l.url')} AND NOT {any_of('l.url', URL_TERMS)} AND {market_ok('l.url', 'l.brand')}
    AND (brand_ok IS NULL OR brand_ok))"""

STEPS = f"""judged AS (
  SELECT c.product, c.brand, c.model, rank, title, k.new_url AS link, k.model_from_catalog AS nxt,
    CASE WHEN k.unavailable OR NOT coalesce(k.is_prod, true) THEN 'nothing'
      WHEN brand_ok IS NULL OR k.is_prod IS NULL THEN 'open' WHEN k.model_from_catalog IS NULL THEN 'found'
      WHEN k.model_from_catalog = c.model THEN 'nothing' ELSE 'restart' END AS kind,
    CASE WHEN brand_ok IS NULL THEN 'check_url_brand' ELSE needs END AS ask_type,
    CASE WHEN brand_ok IS NULL THEN pre ELSE {drop_slash('k.new_url')} END AS ask_url
  FROM candidates c JOIN checks k ON (k.product, k.brand, k.url) = (c.product, c.brand, c.url)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product, brand, model ORDER BY rank) AS rn
  FROM judged WHERE kind <> 'nothing'),
step AS (SELECT * FROM ranked WHERE rn = 1),
last_step AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, brand, model ORDER BY rank) AS rn2
    FROM ranked WHERE kind <> 'restart') WHERE rn2 = 1),
d0 AS (SELECT product, brand, model, model AS now FROM walk_from),
e0 AS (SELECT d.*, kind, title, link, nxt, ask_type, ask_url FROM d0 d LEFT JOIN step s
  ON (s.product, s.brand, s.model) = (d.product, d.brand, d.now)),
e1 AS (SELECT d.product, d.brand, d.model, d.nxt AS now, s.kind, s.title, s.link, s.nxt, s.ask_type, s.ask_url
  FROM e0 d LEFT JOIN step s ON (s.product, s.brand, s.model) = (d.product, d.brand, d.nxt) WHERE d.kind = 'restart'),
e2 AS (SELECT d.product, d.brand, d.model, d.nxt AS now, s.kind, s.title, s.link, s.nxt, s.ask_type, s.ask_url
  FROM e1 d LEFT JOIN step s ON (s.product, s.brand, s.model) = (d.product, d.brand, d.nxt) WHERE d.kind = 'restart'),
e3 AS (SELECT d.product, d.brand, d.model, d.nxt AS now, s.kind, s.title, s.link, s.nxt, s.ask_type, s.ask_url
  FROM e2 d LEFT JOIN last_step s ON (s.product, s.brand, s.model) = (d.product, d.brand, d.nxt) WHERE d.kind = 'restart'),
ends AS (
  SELECT product, brand, model,
    CASE WHEN kind IS DISTINCT FROM 'open' THEN coalesce(kind = 'found', false) END AS found,
    CASE WHEN kind = 'found' THEN title END AS title, CASE WHEN kind = 'found' THEN link END AS link,
    CASE WHEN kind = 'found' THEN now END AS found_model, CAST(depth AS INTEGER) AS depth,
    CASE WHEN kind = 'open' THEN ask_type END AS ask_type, CASE WHEN kind = 'open' THEN ask_url END AS ask_url
  FROM (SELECT *, 0 AS depth FROM e0 WHERE kind IS DISTINCT FROM 'restart'
    UNION ALL SELECT *, 1 FROM e1 WHERE kind IS DISTINCT FROM 'restart'
    UNION ALL SELECT *, 2 FROM e2 WHERE kind IS DISTINCT FROM 'restart'
    UNION ALL SELECT *, 3 FROM e3))"""

SEARCH = ",\n".join([
    WORLD, VERDICTS, CANDIDATES, checks("candidates", "checks"),
    "walk_from AS (SELECT * FROM starts)", STEPS,
])

CHECKED = ",\n".join([
    WORLD, VERDICTS, CANDIDATES,
    "all_keys AS (SELECT product, brand, url FROM products_v UNION ALL SELECT product, brand, url FROM candidates)",
    checks("all_keys", "checks"),
    """own AS (
  SELECT p.*, k.new_url AS resolved_url, k.is_prod IS NULL AS waits, needs,
    coalesce(k.is_prod AND NOT k.unavailable AND model_from_catalog IS NULL, false) AS fits,
    CASE WHEN model_from_catalog IS DISTINCT FROM p.model THEN model_from_catalog END AS catalog
  FROM products_v p JOIN checks k ON (k.product, k.brand, k.url) = (p.product, p.brand, p.url))""",
    """walk_from AS (
  SELECT product, brand, model FROM own WHERE NOT fits AND NOT waits
  UNION SELECT product, brand, catalog FROM own WHERE NOT fits AND NOT waits AND catalog IS NOT NULL)""",
    STEPS,
    f"""looked AS (
  SELECT o.*, CASE WHEN fits THEN 'own' WHEN waits THEN 'wait' WHEN a.found THEN 'first'
      WHEN a.found IS NULL THEN 'first_open' WHEN b.product IS NULL THEN 'nothing' WHEN b.found THEN 'second'
      WHEN b.found IS NULL THEN 'second_open' ELSE 'nothing' END AS how,
    a.link AS a_link, a.found_model AS a_model, a.ask_type AS a_type, a.ask_url AS a_url,
    b.link AS b_link, b.found_model AS b_model, b.ask_type AS b_type, b.ask_url AS b_url
  FROM own o LEFT JOIN ends a ON (a.product, a.brand, a.model) = (o.product, o.brand, o.model)
  LEFT JOIN ends b ON (b.product, b.brand, b.model) = (o.product, o.brand, o.catalog)),
checked AS (
  SELECT id, product, brand, model,
    replace(CASE how WHEN 'own' THEN model WHEN 'first' THEN a_model WHEN 'second' THEN b_model END, '"', '') AS new_model,
    url, resolved_url,
    CASE how WHEN 'own' THEN resolved_url WHEN 'first' THEN a_link WHEN 'second' THEN b_link END AS new_url,
    CASE WHEN how IN ('own', 'first', 'second') THEN true WHEN how = 'nothing' THEN false END AS is_prod,
    CASE WHEN how IN ('own', 'first', 'second') THEN 'kept' WHEN how = 'nothing' THEN 'dropped' ELSE 'undecided' END AS outcome,
    CASE how WHEN 'wait' THEN needs WHEN 'first_open' THEN a_type WHEN 'second_open' THEN b_type END AS ask_type,
    CASE how WHEN 'wait' THEN {drop_slash('resolved_url')} WHEN 'first_open' THEN a_url WHEN 'second_open' THEN b_url END AS ask_url
  FROM looked)""",
])

ANSWERS = """answers AS (
  SELECT conv_id, turn, text, CASE (conv_id * 7 + turn) % 12 WHEN 0 THEN 'True' WHEN 1 THEN 'False' || chr(10) || text
    WHEN 2 THEN 'Catalog' || chr(10) || text WHEN 3 THEN 'Unsure' WHEN 4 THEN ' ''True'' because ' || text
    WHEN 5 THEN 'FALSE.' WHEN 6 THEN 'True' || chr(10) || text WHEN 7 THEN 'false' || chr(10) || chr(10) || text
    WHEN 8 THEN '' WHEN 9 THEN '  ' || text || '.' || chr(10) WHEN 10 THEN 'False reason' END AS r
  FROM conversations)"""
