import random

import pytest

from shelfline.operators import search
from shelfline.operators.classify import Rules
from shelfline.operators.search import search_refine
from shelfline.plans.clean import check_products, open_questions

RULES = Rules(product_terms=["buy"], unavailable_terms=["sold out"], url_terms=["ebay"])
RESP = "query_type STRING, product STRING, brand STRING, url STRING, response STRING"


class World:
    """A small set of stores, and the searches followed one by one in plain Python."""

    def __init__(self, spark):
        self.spark, self.results, self.pages, self.answers, self.alias = spark, {}, {}, {}, {}
        self.visited = set()

    def hit(self, model, *links, brand="acme", product="drill"):
        self.results[f"buy {brand} {model} {product}"] = [(f"t{i}", u) for i, u in enumerate(links)]

    def page(self, url, html="buy", link="True", page="True", pick=None, brand="acme", product="drill"):
        self.pages[url] = html
        u = url[:-1] if url.endswith("/") else url
        for kind, a in (("check_url", link), ("check_product_page", page), ("find_in_catalog", pick)):
            if a is not None:
                self.answers[kind, product, brand, u] = a

    def tables(self):
        s = self.spark
        rows = [(q, i + 1, t, u) for q, items in self.results.items() for i, (t, u) in enumerate(items)]
        return dict(
            results=s.createDataFrame(rows, "query STRING, rank INT, title STRING, link STRING"),
            aliases=s.createDataFrame(list(self.alias.items()), "url STRING, new_url STRING"),
            pages=s.createDataFrame(list(self.pages.items()), "url STRING, html STRING"),
            responses=s.createDataFrame([(*k, v) for k, v in self.answers.items()], RESP),
        )

    # The same by following each search on its own.

    def check(self, product, brand, url):
        """(resolved, is_prod, unavailable, catalog model); is_prod None while an answer is missing."""
        if url is None or url.endswith(".pdf"):
            return url, False, False, None
        url = self.alias.get(url, url)
        html = self.pages.get(url)
        if html is None:
            return url, False, False, None
        u = url[:-1] if url.endswith("/") else url
        gone = "sold out" in html
        ok = "/" in u.split("://")[-1] and "buy" in html and "ebay" not in u.lower()
        ok = ok and ("amazon" in brand or "amazon" not in u)
        if not ok or gone:
            return url, ok, gone, None
        ask = lambda kind: self.answers.get((kind, product, brand, u))
        a = ask("check_url")
        if a is None:
            return url, None, False, None
        if a == "False":
            return url, False, False, None
        if a == "Catalog":
            pick = ask("find_in_catalog")
            return (url, None, False, None) if pick is None else (url, True, False, pick.lower())
        a = ask("check_product_page")
        if a is None:
            return url, None, False, None
        if a.startswith("False\n"):
            return url, True, False, a.split("\n")[1].lower()
        return url, a == "True", False, None

    def search(self, product, brand, model, depth=0):
        self.visited.add((product, brand, model))
        for title, link in self.results.get(f"buy {brand} {model} {product}", []):
            link = link[:-1] if link.endswith("/") else link
            if "/" not in link.split("://")[-1] or "ebay" in link or ("amazon" in link and "amazon" not in brand):
                continue
            prefix = "/".join(link.split("/")[2:4])
            brand_open = False
            if brand not in prefix.replace("-", ""):
                a = self.answers.get(("check_url_brand", product, brand, prefix))
                brand_open = a is None
                if a is not None and not a.replace("'", "").strip().lower().startswith("true"):
                    continue
            url, is_prod, gone, cat = self.check(product, brand, link)
            if gone or is_prod is False:
                continue
            if brand_open or is_prod is None:
                return "open", None, None, None
            if cat is None:
                return "found", title, url, model
            if cat == model or depth >= 3:
                continue
            return self.search(product, brand, cat, depth + 1)
        return "nothing", None, None, None


@pytest.fixture
def world(spark):
    return World(spark)


def outcome(world, *models):
    starts = world.spark.createDataFrame([("drill", "acme", m) for m in models], "product STRING, brand STRING, model STRING")
    t = world.tables()
    rows = search_refine(starts, t["results"], t["aliases"], t["pages"], t["responses"], RULES).collect()
    assert len(rows) == len(models)
    return {r.model: ({True: "found", False: "nothing", None: "open"}[r.found], r.title, r.link, r.found_model) for r in rows}


A = "https://acme.com/"


def test_accepts(world):
    world.page(A + "good")
    world.page(A + "bad", link="False")
    world.page(A + "gone", html="buy sold out")
    world.page("https://other.com/x")
    world.answers["check_url_brand", "drill", "acme", "other.com/x"] = "False"
    world.hit("m1", A + "good/")
    world.hit("m3", "https://acme.com", "https://ebay.com/acme", "https://other.com/x", A + "bad", A + "gone", A + "good")
    world.hit("none", A + "bad")
    world.hit("empty")
    got = outcome(world, "m1", "m3", "none", "empty", "missing")
    assert got["m1"] == ("found", "t0", A + "good", "m1")
    assert got["m3"] == ("found", "t5", A + "good", "m3")
    assert got["none"] == got["empty"] == got["missing"] == ("nothing", None, None, None)


def test_restarts(world):
    world.page(A + "good")
    for n in range(6):
        # The listing names the next model, by link verdict or by page verdict.
        if n % 2:
            world.page(A + f"list{n}", page=f"False\nM{n + 1}")
        else:
            world.page(A + f"list{n}", link="Catalog", pick=f"M{n + 1}")
        world.hit(f"m{n}", A + f"list{n}", A + "good")
    got = outcome(world, "m0", "m1", "m5")
    # Three restarts lead from m0 to m3; there the listing is passed over.
    assert got["m0"] == ("found", "t1", A + "good", "m3")
    assert got["m1"] == ("found", "t1", A + "good", "m4")
    # m6 has no results, and a search that restarted does not come back.
    assert got["m5"] == ("nothing", None, None, None)


def test_same_model_is_skipped(world):
    world.page(A + "good")
    world.page(A + "self", link="Catalog", pick="m1")
    world.hit("m1", A + "self", A + "good")
    world.page(A + "swap", link="Catalog", pick="m3")
    world.page(A + "back", link="Catalog", pick="m2")
    world.hit("m2", A + "swap")
    world.hit("m3", A + "back")
    got = outcome(world, "m1", "m2")
    assert got["m1"] == ("found", "t1", A + "good", "m1")
    assert got["m2"] == ("nothing", None, None, None)


def test_missing_answers_leave_it_open(world):
    world.page(A + "good")
    world.page(A + "asked", link=None)
    world.page("https://other.com/x")
    world.hit("m1", A + "asked", A + "good")
    world.hit("m2", A + "good", A + "asked")
    world.hit("m3", "https://other.com/x", A + "good")
    got = outcome(world, "m1", "m2", "m3")
    assert got["m1"][0] == got["m3"][0] == "open"
    assert got["m2"] == ("found", "t0", A + "good", "m2")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_worlds(spark, seed, monkeypatch):
    """Rows checked by the job equal rows checked one by one, and no other states are looked up."""
    looked_up = []
    plain = search.gated_candidates

    def gated(states, *rest):
        looked_up.extend(tuple(r) for r in states.collect())
        return plain(states, *rest)

    monkeypatch.setattr(search, "gated_candidates", gated)
    rnd = random.Random(seed)
    w = World(spark)
    brands = ["acme", "zeta", "amazonbasics"]
    urls = [f"https://{h}/{p}" for h in ("acme.com", "zeta.com", "amazon.com", "x.org", "ebay.com") for p in range(12)]
    urls += ["https://acme.com", "https://x.org/y/"]
    for u in urls:
        for b in brands:
            w.page(
                u, brand=b, html=rnd.choice(["buy", "buy", "buy", "buy sold out", "nothing"]),
                link=rnd.choice(["True", "True", "Catalog", "False", None]),
                page=rnd.choice(["True", f"False\nM{rnd.randrange(6)}", "False", "True", None]),
                pick=rnd.choice([f"M{rnd.randrange(6)}", f"M{rnd.randrange(6)}", None]),
            )
    for u in rnd.sample(urls, 10):
        w.alias[u] = rnd.choice(urls)
    for u in rnd.sample(urls, 8):
        w.pages.pop(u)
    for u in urls:
        for b in brands:
            if rnd.random() < 0.8:
                prefix = "/".join((u[:-1] if u.endswith("/") else u).split("/")[2:4])
                w.answers["check_url_brand", "drill", b, prefix] = rnd.choice(["True", "'true'.", "False"])
    for b in brands:
        for m in [f"m{i}" for i in range(6)] + [f"s{i}" for i in range(30)]:
            if rnd.random() < 0.9:
                w.hit(m, *rnd.sample(urls, rnd.randrange(0, 7)), brand=b)
    rows = [
        (i, "drill", rnd.choice(brands), rnd.choice([f"s{j}" for j in range(30)] + ["m1"]), rnd.choice(urls + [None, "https://a/b.pdf"]))
        for i in range(400)
    ]
    # A third of all rows are copies of one.
    rows += [(400 + i, *rows[0][1:]) for i in range(200)]

    want = {}
    for i, p, b, m, url in rows:
        resolved, is_prod, gone, cat = w.check(p, b, url)
        if is_prod is None:
            want[i] = ("undecided", None, None)
        elif is_prod and not gone and cat is None:
            want[i] = ("kept", m, resolved)
        else:
            kind, _, link, model = w.search(p, b, m)
            if cat is not None and cat != m:
                # The model of the row's own catalog page is searched for side by side.
                second = w.search(p, b, cat)
                if kind == "nothing":
                    kind, _, link, model = second
            want[i] = ({"found": "kept", "open": "undecided", "nothing": "dropped"}[kind], model, link)

    df = spark.createDataFrame(rows, "id BIGINT, product STRING, brand STRING, model STRING, url STRING")
    t = w.tables()
    out = check_products(df.repartition(3), **t, rules=RULES)
    got = {r.id: (r.outcome, r.new_model, r.new_url) for r in out.collect()}
    assert got == want
    assert len(looked_up) == len(set(looked_up)) and set(looked_up) == w.visited
    assert {o for o, _, _ in want.values()} == {"kept", "undecided", "dropped"}
    # Every undecided row names a question that really has no answer yet.
    asked = open_questions(out).collect()
    assert asked and all((q.query_type, q.product, q.brand, q.url) not in w.answers for q in asked)
