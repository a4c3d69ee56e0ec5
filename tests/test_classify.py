import itertools

from shelfline.operators.classify import Rules, classify_page, fetch_and_check, rule_check
from shelfline.operators.stores import page_facts

URL = [None, "False\nwhy", "Catalog\nwhy", "True\nwhy", "Unsure"]
PICK = [None, "", "M1."]
PAGE = [None, "True", "False", "False\nM2", "Maybe"]


def truth(ok, gone, url, pick, page):
    """The decision tree, written out step by step."""
    if not ok:
        return False, gone, None, None
    if gone:
        return True, True, None, None
    if url is None:
        return None, False, None, "check_url"
    word = url.lower().split("\n")[0]
    if word == "false":
        return False, False, None, None
    if word == "catalog":
        if pick is None:
            return None, False, None, "find_in_catalog"
        if pick:
            return True, False, pick.lower().rstrip("."), None
    if page is None:
        return None, False, None, "check_product_page"
    lines = page.lower().split("\n")
    if lines[0] == "true":
        return True, False, None, None
    if lines[0] == "false" and len(lines) > 1:
        return True, False, lines[1], None
    return False, False, None, None


def test_every_combination(spark):
    cases = list(itertools.product([True, False], [True, False], URL, PICK, PAGE))
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)], "i INT, ok BOOLEAN, gone BOOLEAN, u STRING, k STRING, p STRING"
    )
    got = df.select("i", classify_page("ok", "gone", "u", "k", "p").alias("c")).orderBy("i").collect()
    for row, case in zip(got, cases):
        assert tuple(row.c) == truth(*case), case


def test_rules(values):
    rules = Rules(url_terms=["ebay"])
    cases = [
        (True, "https://a.com/x", "Acme", True), (False, "https://a.com/x", "Acme", False), (None, "https://a.com/x", "Acme", False),
        (True, "https://a.com/", "Acme", False), (True, "https://a.com//", "Acme", True), (True, "https://EBAY.com/x", "Acme", False),
        (True, "https://amazon.com/x", "Acme", False), (True, "https://amazon.com/x", "amazonbasics", True), (True, None, "A", False),
    ]
    got = values(rule_check("h", "u", "b", rules), [c[:3] for c in cases], "h BOOLEAN, u STRING, b STRING")
    assert got == [c[3] for c in cases]


def test_fetch_and_check(spark):
    rules = Rules(product_terms=["buy"], unavailable_terms=["sold out"], url_terms=["ebay"])
    keys = spark.createDataFrame(
        [("d", "Acme", u) for u in ["https://a.com/ok ", "https://a.com/old", "https://a.com/gone/", "https://a.com/none",
                                    "https://a.com/x.pdf", "https://a.com/list", None, "https://a.com/ok "]],
        "product STRING, brand STRING, url STRING",
    )
    aliases = spark.createDataFrame([("https://a.com/old", "https://a.com/new/")], "url STRING, new_url STRING")
    pages = spark.createDataFrame(
        [("https://a.com/ok", "<p>Buy</p>"), ("https://a.com/new/", "<p>BUY now</p>"), ("https://a.com/gone/", "buy, Sold Out"),
         ("https://a.com/x.pdf", "buy"), ("https://a.com/list", "buy")],
        "url STRING, html STRING",
    )
    answers = spark.createDataFrame(
        [("check_url", "d", "Acme", "https://a.com/ok", "True"), ("check_product_page", "d", "Acme", "https://a.com/ok", "True"),
         ("check_url", "d", "Acme", "https://a.com/new", "Catalog"), ("find_in_catalog", "d", "Acme", "https://a.com/new", "Z9"),
         ("check_url", "d", "Other", "https://a.com/list", "True")],
        "query_type STRING, product STRING, brand STRING, url STRING, response STRING",
    )

    def run(pages):
        out = fetch_and_check(keys, aliases, pages, answers, rules).collect()
        return {r.url: (r.new_url, r.is_prod, r.unavailable, r.model_from_catalog, r.needs) for r in out}

    got = run(pages)
    assert got == {
        "https://a.com/ok ": ("https://a.com/ok", True, False, None, None),
        "https://a.com/old": ("https://a.com/new/", True, False, "z9", None),
        "https://a.com/gone/": ("https://a.com/gone/", True, True, None, None),
        "https://a.com/none": ("https://a.com/none", False, False, None, None),
        "https://a.com/x.pdf": ("https://a.com/x.pdf", False, False, None, None),
        "https://a.com/list": ("https://a.com/list", None, False, None, "check_url"),
        None: (None, False, False, None, None),
    }
    # Kept facts give the same.
    assert run(page_facts(pages, ["buy"], ["sold out"])) == got
