import time

from pyspark.sql import functions as F

from shelfline.functions import keywords, text, verdicts
from shelfline.vocab import PRODUCT_TERMS, UNAVAILABLE_TERMS


def test_extract_text(values):
    cases = {
        "<p>a<b>b</b></p> c": "ab c",
        '<script>var t="</p>";</script>x': "x",
        "a<!-- <script> -->b<script>1</script >c": "abc",
        "<!DOCTYPE html><style>p{}</style><template><p>no</p></template>y": "y",
        "open<script>never closed <p>": "open",
        "<p>unclosed": "unclosed",
        "cut off <a href=": "cut off ",
        "<p data-x=it's>First words.</p><p>we don't stop.</p><p>Third.</p>": "First words.we don't stop.Third.",
        "<p a=b\"c title='x > y' d = \"e > f\" g=h=i>in</p>": "in",
        "<p 'odd\">quote names</p><a href=x/>y": "quote namesy",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "&amp;lt; &lt;b&gt; &#65;&#x42; &#x1F600; &nbsp;|": "&lt; <b> AB \U0001f600  |",
        "&unknown; & &; &#0; &#1114112; AT&T": "&unknown; & &; � � AT&T",
        "&eacute;&Uuml;&szlig;": "éÜß",
        "": "",
    }
    assert values(text.extract_text("x"), list(cases)) == list(cases.values())
    assert values(text.extract_text("x"), [None]) == [None]


def test_broken_pages_stay_linear(values):
    n = 300_000
    pages = ["<a" * n, "x<script>" + "</script" * n, "x<!--" + "-" * n, "<title " * n, "x" + "<script" * n, "&" * n, "y<style>" + "p" * n]
    start = time.time()
    assert values(F.length(text.extract_text("x")), pages) == [0, 1, 1, 0, 1, n, 1]
    assert values(text.extract_title("x"), pages[:4]) == [None] * 4
    assert time.time() - start < 60


def test_title(values):
    cases = ["<TITLE lang=x>\n A &amp; B </TITLE><title>2</title>", "<title></title>", "<p>none", "<titles>x</titles>", "<title>open", None]
    assert values(text.extract_title("x"), cases) == ["\n A & B ", None, None, None, "open", None]


def test_clean_title(values):
    cases = ["\n X1 — Pro–Max | A-B \t", "a  -  b", "end -", None]
    assert values(text.clean_title("x"), cases) == ["X1 Pro Max A B", "a b", "end ", None]


def test_clean_label(values):
    cases = ["1. Acme", "**Acme**", "St. Ives", "1. Dr. Foo", "2. **Acme** (US)", "a%&?/:;=+!*()'\"\\b", " a   b ", None]
    assert values(text.clean_label("x"), cases) == ["Acme", "Acme", "Ives", "Dr", "Acme US", "ab", "a b", None]
    kept = values(text.clean_label("x", numbered_only=True), cases)
    assert kept == ["Acme", "Acme", "St. Ives", "Dr. Foo", "Acme US", "ab", "a b", None]


def test_words(values):
    assert values(text.first_n_words("x", 3), [" a b\n c  d ", "a", "", None]) == ["a b c", "a", "", None]
    assert values(text.truncate_to_budget("x", 2), ["a  b", "a  b c", " a ", None]) == ["a  b", "a b", " a ", None]


def test_answers(values):
    assert values(text.clean_response("x"), [" 'Model X'. \n", None]) == ["model x.", None]
    assert values(text.clean_response("x", keep_case=True), [" 'Model X' "]) == ["Model X"]
    assert values(text.first_line("x"), [" X1 \nreason", "only", "\nsecond", None]) == ["X1", "only", "", None]
    assert values(text.strip_quotes("x"), ['1/2" kit', None]) == ["1/2 kit", None]


def test_verdicts(values):
    answers = ["True", "False", "False.", "False\nreason", "Catalog\nreason", "catalog page", "Unsure", "false reason", "", None]
    assert values(verdicts.verdict_url("x"), answers) == [
        "pass", "reject", "pass", "reject", "catalog", "catalog", "pass", "reject", "pass", None]
    assert values(verdicts.catalog_model("x"), ["'Model X'.", "A..", ".", "", None]) == ["model x", "a.", None, None, None]
    assert values(verdicts.verdict_brand("x"), [" 'True'", "truely", "False", "it is true", "", None]) == [
        True, True, False, False, False, None]
    assert values(verdicts.fresh_model_name("x"), [" 'X1'\nwhy", "Title uninformative", "title uninformative.", "", None]) == [
        "X1", None, None, None, None]


def test_verdict_page(values):
    answers = ["True", "true\nreason", "True.", "False", "False.", "False\nModel X", "false\n\nx", "Maybe\nModel Y", "Maybe", "", None]
    strict = values(verdicts.verdict_page("x"), answers)
    assert [(r.verdict, r.model) for r in strict] == [
        ("accept", None), ("accept", None), ("accept", None), ("reject", None), ("reject", None), ("catalog", "model x"),
        ("reject", None), ("reject", None), ("reject", None), ("reject", None), (None, None)]
    loose = values(verdicts.verdict_page("x", strict=False), answers)
    assert [(r.verdict, r.model) for r in loose] == [
        ("accept", None), ("catalog", "reason"), ("reject", None), ("reject", None), ("reject", None), ("catalog", "model x"),
        ("reject", None), ("catalog", "model y"), ("reject", None), ("reject", None), (None, None)]


def test_keyword_counts(values):
    vocab = ["aa", "404", "doesn't exist", "找不到"]
    texts = ["AAA 404 x404", "Doesn't exist. 找不到找不到", "", None]
    got = values(keywords.unavailable_counts("x", vocab), texts)
    assert got[0] == {"aa": 1, "404": 2, "doesn't exist": 0, "找不到": 0}
    assert got[1] == {"aa": 0, "404": 0, "doesn't exist": 1, "找不到": 2}
    assert got[2] == dict.fromkeys(vocab, 0)
    rep = values(keywords.unavailable_terms("x", vocab), texts)
    assert (rep[0].terms, rep[0].counts, rep[0].total, rep[0].unavailable) == (["aa", "404"], [1, 2], 3, True)
    assert (rep[2].terms, rep[2].total, rep[2].unavailable) == ([], 0, False)
    word = values(keywords.unavailable_terms("x", ["404"], whole_word=True), ["X4040 404, é404"])[0]
    assert (word.terms, word.counts) == (["404"], [1])


def test_counts_equal_python(values):
    texts = ["sold out sold  out Sold Out", "aaaa", "oops uh oh oops", "price STOCK no stock"]
    got = values(keywords.unavailable_counts("x", UNAVAILABLE_TERMS), texts)
    for t, m in zip(texts, got):
        assert m == {k: t.lower().count(k) for k in UNAVAILABLE_TERMS}
    hits = values(keywords.product_keyword_hit("x", PRODUCT_TERMS), texts + ["nothing", None])
    assert hits == [False, False, False, True, False, False]


def test_vocabulary_file(spark, tmp_path):
    from shelfline.vocab import load_terms, terms_of

    f = tmp_path / "terms.txt"
    f.write_text("ebay\n\n etsy \nebay\n")
    assert terms_of(load_terms(spark, str(f))) == ["ebay", "etsy"]


def test_hostile_pages(values):
    pages = [
        "<style-guide>buy now</style-guide>", "x <template-card>now</template-card> and the rest", '<a title="x > y">buy</a>',
        "a<script>no</script>b<script src=x>no</script >c", "<p title='unclosed>buy", '<a href="x>1</a><b title="y">2</b>',
        "<STYLE media=a>no</Style>yes", "<scripted>yes", "a <!-- <b> --> c",
    ]
    # The first quoted value of the sixth page ends at its third quote; the rest of that tag is a name with a quote in it.
    want = ["buy now", "x now and the rest", "buy", "abc", "buy", "2", "yes", "yes", "a  c"]
    assert values(text.extract_text("x"), pages) == want


def test_references_are_those_of_html(values):
    import html

    given = [
        "&rarr;&OElig;&Agrave;&oelig;&nbsp;x", "&#00000065;&#x0000000000041;&#65 b", "&ampx &copy2020 &notit; &nosuch; &", "&#0;&#xD800;&#x110000;&#99999999999999999999;",
        "&#128;&#x99;&#150;", "&amp;lt;", "&CounterClockwiseContourIntegral;", "&acE;&fjlig;", "a&b&&c;",
    ]
    assert values(text.decode_entities("x"), given) == [html.unescape(x) for x in given]
