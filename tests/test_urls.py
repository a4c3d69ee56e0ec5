from pyspark.sql import functions as F

from shelfline.functions import sqlfuncs, urls


def test_normalising(values):
    assert values(urls.squeeze_url("x"), [" a b ", "ab", None]) == ["ab", "ab", None]
    assert values(urls.drop_slash("x"), ["a/", "a//", "a", "/", "", None]) == ["a", "a/", "a", "", "", None]


def test_pdf_guard(values):
    got = values(urls.pdf_guard("x"), ["http://a/b.pdf", "http://a/b.PDF", "http://a/b.pdf?x", None])
    assert got == [True, False, False, True]


def test_path(values):
    cases = ["https://a.com", "https://a.com/x", "a.com/x", "a.com", "http://r/?u=http://b", "http://r?u=http://b/c", None]
    assert values(urls.url_has_path("x"), cases) == [False, True, True, False, False, True, False]


def test_blocklist_case(values):
    cases = ["https://Shop.EBAY.com/x", "https://ebay.com", "https://maker.com", None]
    assert values(urls.url_blocklisted("x", ["ebay", ".pdf"]), cases) == [True, True, False, False]
    assert values(urls.url_blocklisted("x", ["ebay"], fold_case=False), cases) == [False, True, False, False]
    assert values(urls.url_blocklisted("x", []), cases) == [False] * 4


def test_marketplace(values):
    cases = [("https://www.Amazon.com/x", "Acme"), ("https://amazon.com/x", "Amazon Basics"), ("https://a.com", "Acme"),
             ("https://amazon.com", None)]
    assert values(urls.marketplace_guard("x", "b"), cases, "x STRING, b STRING") == [False, True, True, False]


def test_url_core(values):
    cases = ["https://a.com/p.html?x=1", "a.com/p.html/q.html", "http://r/http://b.com/c", None]
    assert values(urls.url_core("x"), cases) == ["a.com/p", "a.com/p", "b.com/c", None]


def test_link_prefix(values):
    cases = ["https://a.com/de/x/y", "https://a.com", "a.com/de/x", "a.com"]
    assert values(urls.link_prefix("x"), cases) == ["a.com/de", "a.com", "a.com/de", "a.com"]


def test_brand_in_link(values):
    cases = [
        ("Kärcher", "www.kaercher.com/de"), ("Kärcher", "www.karcher.com"), ("LOréal", "lorealparisusa.com"),
        ("TP-Link", "www.tp-link.com/us"), ("Black & Decker", "black&decker.com"), ("Søren Ł", "soren_l.pl"),
        ("Straße", "strasse.de"), ("Acme", "shop.com/acme"), ("Acme", None), (None, "a.com"),
    ]
    got = values(urls.brand_in_link("b", "p"), cases, "b STRING, p STRING")
    assert got == [False, True, True, True, True, True, True, True, False, False]
    # Only host and first segment count.
    deep = values(urls.brand_in_link("b", urls.link_prefix("p")), [("Acme", "https://shop.com/x/acme")], "b STRING, p STRING")
    assert deep == [False]


def test_cache_key(values):
    long = "https://a.com/" + "x" * 300
    key, other = values(urls.cache_key("pages/", "x"), [long, long + "y"])
    assert key == other and len(key) == 200 and key.startswith("pages/https:\\\\a.com\\")
    assert values(urls.cache_key("p/", "x"), ["a/b"]) == ["p/a\\b.html"]


def test_search_query(values):
    cases = [("Acme", "X1", "drill"), ("Acme", None, "drill")]
    assert values(urls.search_query("b", "m", "p"), cases, "b STRING, m STRING, p STRING") == [
        "buy Acme X1 drill", "buy Acme drill"]


def test_sql_functions_equal_columns(spark):
    from shelfline.functions import text, verdicts

    names = sqlfuncs.register(spark)
    assert len(names) == len(sqlfuncs.BODIES) + len(sqlfuncs.TABLES)
    xs = ["https://a.com/de/x/", "a.com", " x y ", "b.pdf", "True\nok", "'FALSE' reason", "catalog\n", "", "  a\n b", None]
    df = spark.createDataFrame([(x,) for x in xs], "x STRING")
    pairs = {
        "squeeze_url": urls.squeeze_url, "drop_slash": urls.drop_slash, "pdf_guard": urls.pdf_guard,
        "url_has_path": urls.url_has_path, "url_core": urls.url_core, "link_prefix": urls.link_prefix,
        "strip_quotes": text.strip_quotes, "first_line": text.first_line, "clean_response": text.clean_response,
        "verdict_brand": verdicts.verdict_brand, "verdict_url": verdicts.verdict_url,
    }
    for name, fn in pairs.items():
        rows = df.select(F.expr(f"{name}(x)").alias("a"), fn("x").alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], name
    key = df.select(F.expr("cache_key('p/', x)").alias("a"), urls.cache_key("p/", "x").alias("b")).collect()
    assert all(r.a == r.b for r in key)


def test_sql_text_functions_equal_columns(spark):
    from shelfline.functions import keywords, text, verdicts

    sqlfuncs.register(spark)
    xs = [
        "<p data-x=it's>a&amp;lt; &eacute; &#65;&#x42;&#150;&#0;</p> &Uuml &bogus; &;<script>y</script>", "<title> A &amp; B\n</title>x",
        "1. **Foo's** (new)", "St. Ives. Co", " a \n|b—c  d e", "False\n'M 2'", "false.\n", "TRUE.", "'M1'.", "Kärcher", "", None, "Sold out 404 404",
    ]
    terms, lit = ["404", "sold out", "aa"], "array('404', 'sold out', 'aa')"
    df = spark.createDataFrame([(x,) for x in xs], "x STRING")
    pairs = {
        "extract_text(x)": text.extract_text("x"), "extract_title(x)": text.extract_title("x"), "clean_title(x)": text.clean_title("x"),
        "clean_label(x)": text.clean_label("x"), "first_n_words(x, 2)": text.first_n_words("x", 2),
        "truncate_to_budget(x, 2)": text.truncate_to_budget("x", 2), "catalog_model(x)": verdicts.catalog_model("x"),
        "verdict_page(x)": verdicts.verdict_page("x"), "fold_accents(x)": urls.fold_accents("x"),
        "brand_in_link(x, 'karcher.com/a')": urls.brand_in_link("x", F.lit("karcher.com/a")),
        "marketplace_guard(x, 'acme', 'foo')": urls.marketplace_guard("x", F.lit("acme"), "foo"),
        f"url_blocklisted(x, {lit})": urls.url_blocklisted("x", terms), f"product_keyword_hit(x, {lit})": keywords.product_keyword_hit("x", terms),
        f"to_json(unavailable_counts(x, {lit}))": F.to_json(keywords.unavailable_counts("x", terms)),
    }
    for said, column in pairs.items():
        rows = df.select(F.expr(said).alias("a"), column.alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], said


def test_sql_functions_that_give_rows(spark):
    from shelfline.operators.dataset import unavailable_hits
    from shelfline.operators.rows import parse_product_lines

    sqlfuncs.register(spark)
    answers = [("t", "Brand;Model;URL\n1. A;m, x;http://u;  \nbad\nB;n;w"), ("u", "C;**o**;v\nBrand;Model;URL"), ("v", None), ("w", "")]
    df = spark.createDataFrame(answers, "product STRING, response STRING")
    df.createOrReplaceTempView("answers_given")
    got = spark.sql("SELECT a.product, l.* FROM answers_given a, LATERAL product_lines(a.product, a.response) l")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, parse_product_lines(df).collect()))
    texts = spark.createDataFrame([(1, "Not Found 404 404"), (2, None), (3, "x")], "i BIGINT, t STRING")
    texts.createOrReplaceTempView("texts_given")
    hits = spark.sql("SELECT i, h.* FROM texts_given, LATERAL term_hits(t, array('404', 'not found', 'zz')) h")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, unavailable_hits(texts, ["404", "not found", "zz"], F.col("t"), "i").collect()))


def test_product_lines_in_sql_stay_with_their_answer(spark):
    """Its rows come out of the answer itself, repeated answers too, not by a join on the text."""
    from shelfline.operators.rows import parse_product_lines

    sqlfuncs.register(spark)
    header = "Brand;Model;URL"
    answers = [("t", f"{header}\nA;m;u\n{header}")] * 2 + [("u", f"{header}\nA;m;u\n{header}"), (None, f"no\n{header}\nB;n;w"), ("x", header)]
    df = spark.createDataFrame(answers, "product STRING, response STRING")
    got = spark.sql("SELECT a.product, l.* FROM {a} a, LATERAL product_lines(a.product, a.response) l", a=df)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, parse_product_lines(df).collect()))
