"""Language identification, quality rules, page extraction and the pipeline."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfline.llm import frames, langid, quality
from shelfline.llm.arrays import code_points, raw_bytes, words
from shelfline.llm.html import article_report, best_run, main_text, weights_of
from shelfline.llm.labelled_pages import PAGES
from shelfline.llm.langid import Filters, language_report, positions, with_language
from shelfline.llm.quality import base_counts, good_documents, kneser_ney, quality_report

TEXTS = st.lists(st.text(alphabet="aAb éß\n\t#%.1\x1c　", max_size=50), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_views(texts):
    arr = pa.array(["skip", *texts], pa.string()).slice(1)
    raw, at = raw_bytes(arr)
    assert [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == texts
    points, at = code_points(arr)
    assert [[*map(ord, t)] for t in texts] == [points[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    coded, at = words(arr)
    got = coded.to_pylist()
    assert [got[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_added_columns_keep_rows_and_names(spark, monkeypatch):
    monkeypatch.setattr(frames, "PART_BYTES", 200)
    df = spark.createDataFrame([(i, "x" * (i % 90), None if i % 7 else i) for i in range(300)], "made BIGINT, text STRING, n BIGINT")
    out = frames.add_columns(df, lambda b: [pa.array([len(t.as_py()) for t in b.column(1)], pa.int64())], "size BIGINT")
    assert out.columns == ["made", "text", "n", "size"] and out.filter("size <> length(text)").isEmpty() and out.count() == 300
    with pytest.raises(ValueError, match="made"):
        frames.add_columns(df, lambda b: [], "made BIGINT")


def slow_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    some = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(some) - len(set(some)), len(covered), failed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bé", "#", "c\n", "\n", "d|"]), max_size=60).map(" ".join), max_size=5))
def test_base_counts(texts):
    got = [tuple(x) for x in zip(*(c.tolist() for c in base_counts(pa.array(texts, pa.string()))), strict=True)]
    assert got == [slow_base(t) for t in texts]


def slow_model(texts):
    """Interpolated modified Kneser-Ney over the classes of `quality`, counted with dictionaries."""
    counts = {3: Counter()}
    for t in texts:
        key, _ = quality.grams(pa.array([t]))
        counts[3].update(key.tolist())
    for n in (2, 1):
        counts[n] = Counter(k & ((1 << 6 * n) - 1) for k in counts[n + 1])
    p = {0: lambda g: 1 / 64}
    for n in (1, 2, 3):
        c = counts[n]
        kinds = [sum(v == i for v in c.values()) for i in range(5)]
        y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] and kinds[2] else 0.5
        cut = {}
        for i in (1, 2, 3):
            d = i - (i + 1) * y * kinds[i + 1] / kinds[i] if kinds[i] and kinds[i + 1] else i / 4
            cut[i] = max(0.01, min(i - 0.01, d))
        total, left = Counter(), Counter()
        for g, v in c.items():
            total[g >> 6] += v
            left[g >> 6] += cut[min(v, 3)]

        def prob(g, n=n, c=c, cut=cut, total=total, left=left, low=p[n - 1]):
            shorter = low(g & ((1 << 6 * (n - 1)) - 1))
            if not total[g >> 6]:
                return shorter
            own = c[g] - cut[min(c[g], 3)] if c[g] else 0.0
            return own / total[g >> 6] + left[g >> 6] / total[g >> 6] * shorter

        p[n] = prob
    return p[3]


def test_perplexity_is_that_of_the_model(spark):
    texts = ["the river and the bank of the river " * 3 + f"no {i}" for i in range(8)] + ["completely different wording stands here " * 2 + "x" * i for i in range(6)]
    rows = spark.createDataFrame([(t, "en") for t in texts], "text STRING, lang STRING").withColumn("text", F.col("text"))
    counted = spark.createDataFrame(
        [("en", g, n) for g, n in Counter(k for t in texts for k in quality.grams(pa.array([t]))[0].tolist()).items()],
        "lang STRING, gram INT, n BIGINT",
    )
    model = quality.Model.gathered(kneser_ney(counted))
    p = slow_model(texts)
    for t in ["the bank", "zebra quiz 77", "x#x", texts[0]]:
        key, _ = quality.grams(pa.array([t]))
        got = model.log_probabilities(np.zeros(len(key), np.int64), key)
        assert np.allclose(got, [np.log(p(k)) for k in key.tolist()], atol=1e-4)
    for context in (0, 5, key[0] >> 6):
        assert abs(sum(p((int(context) << 6) | w) for w in range(64)) - 1) < 1e-9
    assert rows.count() == 14


def test_quality_of_odd_rows(odd, odd_rows, nothing):
    got = sorted((tuple(r)[:7] for r in quality_report(odd).collect()), key=repr)
    assert got == sorted(((r[0], *slow_base(r[1] or "")) for r in odd_rows), key=repr)
    for r in quality_report(odd).collect():
        assert not (r.base_failed and r.kept)
    kept = good_documents(odd)
    assert kept.columns == odd.columns
    assert kept.count() == quality_report(odd).filter("kept").count()
    assert quality_report(nothing).collect() == [] and good_documents(nothing).collect() == []


def test_quality_keeps_good_documents(real):
    got = quality_report(real).filter("not base_failed")
    assert got.filter("kept").count() / got.count() > 0.85


def test_filters_have_no_false_negatives_and_the_expected_false_positives():
    rng = np.random.default_rng(1)
    langs = [f"l{i}" for i in range(70)]
    table = np.zeros((langid.POSITIONS, 2), np.uint64)
    own = {i: rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for i in (0, 3, 69)}
    for i, g in own.items():
        for spot in positions(g):
            np.bitwise_or.at(table[:, i // 64], spot, np.uint64(1 << (i % 64)))
    f = Filters(langs, table)
    for i, g in own.items():
        assert Filters._bits(f.containing(g), i).all()
        fresh = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
        rate = Filters._bits(f.containing(fresh), i).mean()
        assert abs(rate - f.chance[i]) < 0.002
        n, votes = f.votes(fresh, np.zeros(len(fresh), np.int64), 1)
        assert votes[0, i] < 0.01 * n[0]


def test_language_of_odd_rows(odd, odd_rows, nothing):
    got = language_report(odd).collect()
    assert len(got) == len(odd_rows) and language_report(nothing).collect() == []
    known = {r[2] for r in odd_rows if r[2]}
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred in known or r.lang_pred == "und")
    text = {r[0]: r[1] for r in odd_rows}
    for r in got:
        if r.doc_id in (2, 3, 4):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id is not None and re.search("[a-z]", text[r.doc_id]):
            assert r.lang_pred != "und"
    # Without a language to learn, nothing can be said.
    blank = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_report(blank).collect()} == {"und"}


def test_language_is_not_read_from_the_row(real):
    a = language_report(real).filter("held_out").collect()
    swapped = real.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    assert sorted(a) == sorted(language_report(swapped).filter("held_out").collect())


def test_held_out_accuracy(real):
    got = language_report(real).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_text_without_known_ngrams_gets_a_learnt_language(spark):
    learn = spark.createDataFrame([("der Hund und die Katze " * 5, "de")] * 3 + [("the dog and the cat " * 5, "en")] * 2, "text STRING, lang STRING")
    docs = spark.createDataFrame([("ωωωω",), ("the dog",), ("die Katze",), ("123",)], "text STRING")
    got = [(r.lang_pred, r.score) for r in with_language(docs, learn).collect()]
    assert got[0] == ("de", 0.0) and [g[0] for g in got[1:]] == ["en", "de", "und"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_run(scores):
    a, b = best_run(scores)
    every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    top = max(every, default=0)
    assert sum(scores[a:b]) == max(0, top) and (a < b) == (top > 0)


WEIGHTS = weights_of(PAGES)


@pytest.mark.parametrize("page,text", [
    ("", ""),
    ("plain &amp; simple &rarr; &#x41;&nbsp;b", "plain & simple → A b"),
    ("<p>One\n two<br>three<p>four <b>five", "One two three\n\nfour five"),
    ("<script>var a = '<p>no</p>'</script><p>yes it is</p>", "yes it is"),
    ("<p>before all</p><!-- <p>not this --><p>after that</p>", "before all\n\nafter that"),
    ("<p title='a > b'>quoted text stays</p>", "quoted text stays"),
    ("<style-guide>custom elements are text</style-guide>", "custom elements are text"),
    ("<nav><a href=1>Home</a></nav><h1>Title</h1><p>A body.</p><footer>c 2020 all rights</footer>", "Title\n\nA body."),
    ("<article><header><h1>Top</h1></header><p>Text of it.</p><div class='ad-box'>buy now</div><p>More.</p></article>", "Top\n\nText of it.\n\nMore."),
    ("<div class='post has-sidebar'><p>kept all the same</p></div><div id=comments><p>I like it</p></div>", "kept all the same"),
    ("<p>our text</p><ol class=commentlist><li>I say</ol><div id=siteFooter>c 2020</div><div class='ad2'>buy</div>", "our text"),
    ("<div role=navigation>a b c</div><div hidden>d e f</div><p>g h i</p>", "g h i"),
    ("<form><p>your name</p><button>send</button></form>", ""),
    ("<p>cut off <a href='x", "cut off"),
    ("<article><p data-x=it's>First words.</p><p>Second ones, we don't stop.</p><p>Third.", "First words.\n\nSecond ones, we don't stop.\n\nThird."),
    ("<article><p class=ad>buy" + "<b>" * 13 + "two<p>three is the real story, told at length</article>", "three is the real story, told at length"),
    ("<div class='elementor-widget'><p>The whole article.</p></div><div class='elementor-widget'><p>And its end.</p></div><div class=ad>buy</div>", "The whole article.\n\nAnd its end."),
    ("<div class='share-story'><h1>T</h1><p>All of the story is in here.</p></div><nav>a b</nav>", "T\n\nAll of the story is in here."),
    ("<article><p>A long enough text of the article itself.</p><div class=share>Share this <a href=x>now</a></div><p>Its end.</p></article>", "A long enough text of the article itself.\n\nIts end."),
    ("<p>where <math><mi>x</mi> = <mn>2</mn></math> holds</p>", "where x = 2 holds"),
    ("<ul><li>first<li>second</ul><p>third", "first\n\nsecond\n\nthird"),
])
def test_main_text(page, text):
    assert main_text(page, WEIGHTS) == text


def test_labelled_pages_are_recovered():
    for page in PAGES:
        inner = re.search(r"<!--main-->(.*)<!--/main-->", page, re.S)[1]
        want = Counter(re.sub(r"<[^>]*>", " ", inner).split())
        got = Counter(main_text(page, WEIGHTS).split())
        both = sum((want & got).values())
        assert both / sum(want.values()) > 0.97 and both / sum(got.values()) > 0.9


#: Pages of other layouts than those the weights are learnt from.
HELD_OUT = [
    """<html><body class="home page"><div id="masthead"><a href="/">Site</a></div><div class="wp-block-columns"><div class="entry-content">
    <!--main--><h1>Bees in the attic</h1><p>A swarm moved in under the roof last May and has stayed since.</p><p>The keeper who came to
    look <i>advised</i> patience, and a good veil.</p><ol><li>Close the hatch.</li><li>Wait for dusk.</li></ol><!--/main--></div></div>
    <div class="newsletter-signup"><p>Get our letter every week, free of charge and full of news.</p></div><footer>All rights reserved</footer></body></html>""",
    """<html><body><header class="site"><ul class="menu"><li><a href=/a>One</a><li><a href=/b>Two</a></ul></header><section class="elementor-section">
    <!--main--><div class="elementor-widget"><h2>Bread without kneading</h2></div><div class="elementor-widget"><p>Stir flour, water and salt, and leave
    the bowl alone for a night and a morning.</div><div class="elementor-widget"><p>Bake it in a hot pot with the lid on, half an hour, then without.</div><!--/main-->
    </section><section id="comments"><p>I did this and it worked on the first try, thank you so much!</p></section></body></html>""",
    """<table><tr><td class=nav><a href=1>Home</a> <a href=2>News</a></td><td><!--main--><h3>Minutes of the meeting</h3>The chair opened the meeting at
    seven and read the list of those present.<p>The accounts were passed without a vote against.<p>Next meeting in June.<!--/main--></td></tr></table>
    <div class="cookie-banner">This page keeps cookies. <button>Fine</button></div>""",
    """<main><!--main--><article><header><h1>Sorting in place</h1></header><p>An array is sorted in place when no second one is needed.</p><pre>for i in range(n):
    swap(i)</pre><p>It takes <code>O(1)</code> room.</p></article><!--/main--></main><aside class="related"><h4>Read next</h4><a href=x>Heaps</a></aside>""",
]


def test_precision_and_recall_on_other_pages():
    """Words of articles found, and found words that are of articles, over pages the weights were not learnt from."""
    both = wanted = given = 0
    for page in HELD_OUT:
        inner = re.search(r"<!--main-->(.*)<!--/main-->", page, re.S)[1]
        want = Counter(re.sub(r"<[^>]*>", " ", inner).split())
        got = Counter(main_text(page, WEIGHTS).split())
        both, wanted, given = both + sum((want & got).values()), wanted + sum(want.values()), given + sum(got.values())
    assert both / wanted > 0.95 and both / given > 0.95


def slow_stack(page):
    """Which words stand outside, by a plain stack that is searched through at every tag."""
    from shelfline.llm import html as h

    stack, out = [], []
    for m in h.TOKEN.finditer(page):
        if m["text"] is not None:
            out += [(w, bool(stack) and stack[-1][1]) for w in m["text"].split()]
        name = (m["name"] or "").lower()
        if not name or name in h.VOID:
            continue
        names = [n for n, _ in stack]
        if m["end"]:
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name):]
            continue
        if name in h.ENDED and name in names:
            top = len(names) - 1 - names[::-1].index(name)
            if not set(names[top + 1:]) & h.BARRIERS:
                del stack[top:]
        inside = any(n in ("article", "main") for n, _ in stack)
        stack.append((name, bool(stack) and stack[-1][1] or h._marks(name, m["attrs"] or "", inside)[0]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<p class=ad>", "<div class=menu>", "</div>", "<div>", "<article>", "</article>", "w ", "<nav>", "</nav>", "<td>", "<table>"]), max_size=40))
def test_open_elements_like_a_plain_stack(parts):
    from shelfline.llm.html import tokens

    page = "".join(p.replace("w ", f"w{k} ") for k, p in enumerate(parts))
    got = [(w, outside) for kind, value, _, outside in tokens(page) if kind not in ("tag", "note") for w in value.split()]
    assert got == slow_stack(page)


def test_hostile_pages_end():
    for page in ("<a " * 20_000 + '"', "<div>" * 20_000 + "x", "<!--" * 20_000, "<p " * 20_000, "&amp" * 50_000, "</p>" * 20_000):
        main_text(page, WEIGHTS)


def test_articles_of_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<p>a b c", "y"), (None, None, "", "z"), (2, "v", "<p>" + "w " * 200_000, "t")]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING")
    got = sorted((tuple(r) for r in article_report(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (1, "u", "a b c", 5), (None, None, "", 0), (2, "v", ("w " * 200_000).strip(), 399_999)], key=repr)
    assert article_report(pages.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from shelfline.llm.simhash import fingerprint

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, docs, d)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(k)))
        done = spark.read.parquet(str(tmp_path / str(k)))
        before, after = {r.doc_id: r for r in docs.collect()}, done.collect()
        ids = {r.doc_id for r in after}
        if name == "quality_rules":
            assert all(not slow_base(r.text)[5] for r in after) and len(after) > 0.7 * len(before)
        elif name == "line_dedup":
            assert ids == set(before) and all(r.n_chars == len(r.text) for r in after)
            assert sum(len(r.text) for r in after) < sum(len(r.text) for r in before.values())
        elif name == "near_dedup":
            # Brute force: the smallest id of everything that steps of two bits lead to stays.
            own = {i: fingerprint(r.text) for i, r in before.items()}
            root = {i: i for i in own}
            for i in sorted(own):
                for j in sorted(own):
                    if i < j and (own[i] ^ own[j]).bit_count() <= 2:
                        a, b = root[i], root[j]
                        root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
            assert ids == {i for i, r in root.items() if i == r}
        elif name == "decontamination":
            assert ids <= set(before)
        else:
            assert {r.doc_id for r in after} == set(before)
        docs = done


def test_pipeline_of_odd_rows(spark, odd, nothing, tmp_path):
    import corpus_pipeline

    for label, docs in (("odd", odd), ("none", nothing)):
        d = tmp_path / label
        docs.write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, "a benchmark question of no importance")], "item_id BIGINT, text STRING").write.parquet(str(d / "benchmark.parquet"))
        rows = corpus_pipeline.run(spark, str(d))
        assert (rows.count() > 0) == (label == "odd")


def slow_shares(texts):
    """The share of each character in its class after the one before, counted with dictionaries."""
    kind = lambda c: int(quality.classes(np.array([c]))[0])
    pairs = Counter((a, c) for t in texts for a, c in zip([None, *map(ord, t)], map(ord, t)))
    met = Counter(c for _, c in pairs)

    def anywhere(c):
        own = {x: n for x, n in met.items() if kind(x) == kind(c)}
        room = sum(kind(x) == kind(c) for x in range(128)) if c < 128 else len(range(kind(c) - 47, 0x110000, 15)) - len(range(kind(c) - 47, 128, 15))
        if not own:
            return 1 / room
        return max(0, own.get(c, 0) - 0.75) / sum(own.values()) + 0.75 * len(own) / sum(own.values()) / room

    def share(a, c):
        own = {x: n for (b, x), n in pairs.items() if b == a and kind(x) == kind(c)}
        if not own:
            return anywhere(c)
        return max(0, own.get(c, 0) - 0.75) / sum(own.values()) + 0.75 * len(own) / sum(own.values()) * anywhere(c)

    return share


def test_each_character_has_its_own_probability(spark):
    texts = ["Добрый день, река и БЕРЕГ реки 1234 " * 3, "Der Fluß (Größe: 12) und das Ufer? " * 3, "水は流れる\n川岸\t"]
    texts = [t + " и еще двадцать слов для правил " * 2 + " ".join("абвгдежзиклмнопрстуф") + " ".join(map(str, range(9))) + t for t in texts]
    texts = [t for t in texts if not slow_base(t)[5]]
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text STRING, lang STRING")
    model = quality.Model.gathered(quality._entries(docs, "text", "lang"))
    share = slow_shares(texts)
    assert texts
    for t in ["река Ъ", "Ø水Q!", "", "die 77 川", texts[0]]:
        spots, pair = quality.members(pa.array([t]))
        got = model.log_shares(np.zeros(len(pair), np.int64), pair)
        want = [np.log(share(ord(t[i - 1]) if i else None, ord(t[i]))) for i in spots]
        assert np.allclose(got, want, atol=1e-4)
        if t:
            key, _ = quality.grams(pa.array([t]))
            both = model.log_probabilities(np.zeros(len(key), np.int64), key).sum() + sum(want)
            assert np.allclose(model.log_perplexity(np.zeros(1, np.int64), pa.array([t])), -both / len(t), atol=1e-4)


def test_other_characters_of_the_same_classes_are_told_apart(spark):
    """Texts whose letters are changed for others of the same class had the perplexity of the texts they came from."""
    import random

    rng = random.Random(3)
    words = ["река", "берег", "город", "который", "время", "человек", "дорога", "сказал", "большой", "работа", "после", "вода"]
    good = [" ".join(rng.choice(words) + ("" if rng.random() < 0.9 else ".") for _ in range(60 + k)) for k in range(60)]
    bad = ["".join(chr(0x430 + (ord(c) - 0x430 + 15) % 30) if ord(c) > 0x42F else c for c in t) for t in good[:6]]
    assert all((quality.grams(pa.array([a]))[0] == quality.grams(pa.array([b]))[0]).all() for a, b in zip(good, bad))
    rows = [(i, t, "ru") for i, t in enumerate(good + bad)]
    got = {r.doc_id: r for r in quality_report(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i in range(60)) >= 57
    assert not any(got[60 + i].kept for i in range(6))
