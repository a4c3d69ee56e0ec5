"""Explicit schemas of the tables the operators read and write; nothing is inferred."""

CATEGORIES = "idx BIGINT, product STRING"
PRODUCTS = "product STRING, brand STRING, model STRING, url STRING, id BIGINT"
# The product CSV as it lies on disk.
PRODUCT_CSV = "Product STRING, Brand STRING, Model STRING, URL STRING"
VERSIONS = "product STRING, path STRING, major INT, minor INT"
ALIASES = "url STRING, new_url STRING"
# Only fetched pages are stored: a URL that is there has its HTML.
PAGES = "url STRING, html STRING"
CAPTURES = "url STRING, capture_id BIGINT, ts TIMESTAMP, status STRING, mime STRING, html STRING"
# What the keyword rules need of a page, made from PAGES once and kept.
PAGE_FACTS = "url STRING, has_page BOOLEAN, product_hit BOOLEAN, unavailable BOOLEAN"
# Answers are keyed by everything that went into the question, so two rows never share one by accident.
RESPONSES = "query_type STRING, product STRING, brand STRING, url STRING, response STRING"
SEARCH_BODY = "error STRING, items ARRAY<STRUCT<title: STRING, link: STRING>>, _corrupt_record STRING"
SEARCH_RESULTS = "query STRING, rank INT, title STRING, link STRING"
