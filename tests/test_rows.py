import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfline.operators import dataset, rows, skew
from shelfline.operators.ranking import id_bucket, number_within

ROWS = "id BIGINT, product STRING, brand STRING, model STRING, url STRING"


@pytest.fixture(scope="module")
def sample():
    rnd = random.Random(5)
    out = []
    for i in range(600):
        # One category, one brand and one URL hold a third of all rows and more.
        p = rnd.choice(["tent", "tent", "lamp", "desk"])
        b = rnd.choice(["Hot", "Hot", "Cold", None, "Kä", "b1", "b2", "b3", "b4", "b5", "b6"])
        u = rnd.choice([f"https://a/{rnd.randrange(150)}", "https://a/hot", None])
        out.append((i * 3 + 1, p, b, f"m{rnd.randrange(40)}", u))
    return out


@pytest.fixture(scope="module")
def table(spark, sample):
    return spark.createDataFrame(sample, ROWS).repartition(7)


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_numbering_equals_brute_force(table, sample, bits):
    df = table.filter("brand IS NOT NULL").withColumn("bucket", id_bucket("id", bits))
    got = {r.id: r.place for r in number_within(df, ["product", "brand"], ["bucket"], ["id"], "place").collect()}
    seen, want = defaultdict(int), {}
    for i, p, b, _, _ in sorted(sample):
        if b is not None:
            want[i] = seen[p, b]
            seen[p, b] += 1
    assert got == want


def test_skewed_join_is_null_safe(spark, table):
    right = table.select("url").distinct().withColumn("n", F.coalesce(F.length("url"), F.lit(-1))).filter("url IS NULL OR url <> 'https://a/7'")
    got = skew.skewed_join(table.select("id", "url"), right, ["url"])
    want = {(r.id, r.url, None if r.url == "https://a/7" else len(r.url) if r.url is not None else -1) for r in table.select("id", "url").collect()}
    assert got.count() == table.count() and {(r.id, r.url, r.n) for r in got.collect()} == want
    inner = skew.skewed_join(table.select("id", "url"), right, ["url"], "inner", stored=True)
    assert inner.count() == sum(n is not None for _, _, n in want)


def test_hot_key_is_split(spark):
    """The lookup keeps a shape that adaptive execution splits, also for an aggregated right side."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(None)).alias("k"))
        right = spark.range(0, 60_000, 3).groupBy(F.col("id").alias("k")).count()
        j = skew.skewed_join(left, right, ["k"])
        j.write.format("noop").mode("overwrite").save()
        got = j.collect()
        assert len(got) == 60_000 and "skew=true" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_head(table, sample, spark):
    def brute(n):
        by = defaultdict(list)
        for r in sorted(sample):
            by[r[1]].append(r[0])
        return sorted(i for v in by.values() for i in v[:n])

    assert ids(rows.head_per_category(table, 5)) == brute(5)
    assert ids(rows.head_per_category(table)) == sorted(r[0] for r in sample)
    odd = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (None, None)], "id BIGINT, product STRING")
    for n in (2, 1000, 1001):
        assert rows.head_per_category(odd, n).count() == 4
        assert ids(rows.head_per_category(table, n)) == brute(n)
    assert sorted((r.product is None, r.id) for r in rows.head_per_category(odd.filter("id IS NOT NULL"), 1).collect()) == [(False, 1), (True, 2)]


def test_head_ranks_only_the_range_of_the_last_row(spark, monkeypatch):
    """Ranges before the n-th row pass unranked, and the plan has no window over rows outside the edge."""
    monkeypatch.setattr(rows, "id_bucket", lambda c: F.shiftright(F.col(c), 3))
    data = [(i, p) for p, n in (("a", 100), ("b", 5), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(data, "id BIGINT, product STRING").repartition(4)
    for n in (0, 1, 7, 8, 9, 33, 1000):
        got = sorted((str(r.product), r.id) for r in rows.head_per_category(df, n).collect())
        assert got == sorted((str(p), i) for i, p in data if i < n)


def test_updates_keep_rows_without_category(spark):
    t = spark.createDataFrame([(1, None, "b", "m", "u"), (2, "a", "b", "m", "u"), (1, "a", "b", "m", "u")], "id BIGINT, product STRING, brand STRING, model STRING, url STRING")
    checked = t.select("product", "id", F.lit("n").alias("new_model"), F.lit("w").alias("new_url"), F.lit("kept").alias("outcome"))
    assert sorted((str(r.product), r.id, r.model, r.url) for r in rows.apply_updates(t, checked).collect()) == [
        ("None", 1, "n", "w"), ("a", 1, "n", "w"), ("a", 2, "n", "w")]
    named = rows.apply_model_names(t, checked.filter("product is null"))
    assert sorted((str(r.product), r.id, r.model) for r in named.collect()) == [("None", 1, "n"), ("a", 1, "m"), ("a", 2, "m")]


def test_dedupe(table, sample):
    first = {}
    for i, p, _, _, u in sorted(sample):
        first.setdefault((p, u), i)
    once = rows.dedupe_url(table)
    assert ids(once) == sorted(first.values())
    assert ids(rows.dedupe_url(once)) == ids(once)


def test_results_do_not_depend_on_partitioning(table):
    for op in (rows.dedupe_url, rows.balanced_subset, rows.group_urls_by_brand, lambda t: rows.head_per_category(t, 3)):
        one, many = op(table.coalesce(1)), op(table.repartition(13, "model"))
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_balanced(table, sample):
    got = rows.balanced_subset(table, brands=6).collect()
    per = defaultdict(list)
    for r in got:
        per[r.product].append((r.id, r.brand))
    first = defaultdict(dict)
    for i, p, b, _, _ in sorted(sample):
        if b is not None:
            first[p].setdefault(b, i)
    for p, brands in first.items():
        assert len(brands) >= 6
        assert sorted(per[p]) == sorted((i, b) for b, i in brands.items())[:6]
    assert not rows.balanced_subset(table, brands=11).collect()
    two = rows.balanced_subset(table, brands=3, per_brand=2).groupBy("product", "brand").count().collect()
    assert len(two) == 9 and all(r["count"] == 2 for r in two)
    seeded = rows.balanced_subset(table, brands=6, seed=7)
    assert ids(seeded) == ids(rows.balanced_subset(table.repartition(3), brands=6, seed=7))
    assert ids(seeded) != ids(rows.balanced_subset(table, brands=6))


def test_first_page(table, sample):
    t = table.withColumn("has_page", F.col("id") % 2 == 0)
    want = {}
    for i, p, b, _, _ in sorted(sample):
        if b is not None and i % 2 == 0:
            want.setdefault((p, b), i)
    assert ids(rows.first_page_per_brand(t)) == sorted(want.values())


def test_updates(spark):
    t = spark.createDataFrame([(1, "a", "b", "m", "u"), (2, "a", "b", "m2", "u2"), (1, "z", "b", "m3", "u3")], ROWS)
    checked = spark.createDataFrame(
        [("a", 1, "new", "nu", "kept"), ("a", 2, None, None, "dropped"), ("z", 1, None, None, "undecided")],
        "product STRING, id BIGINT, new_model STRING, new_url STRING, outcome STRING",
    )
    assert [tuple(r) for r in rows.apply_updates(t, checked).collect()] == [(1, "a", "b", "new", "nu")]
    kept, dropped, undecided = rows.kept_dropped(checked)
    assert kept.count() + dropped.count() + undecided.count() == checked.count()
    names = spark.createDataFrame([("a", 1, "N"), ("a", 2, None)], "product STRING, id BIGINT, new_model STRING")
    got = {(r.product, r.id): r.model for r in rows.apply_model_names(t, names).collect()}
    assert got == {("a", 1): "N", ("a", 2): "m2", ("z", 1): "m3"}


def test_known_brands(spark):
    c = spark.createDataFrame([("a", "Acme"), ("a", "New"), ("b", "Acme"), ("a", None)], "product STRING, brand STRING")
    e = spark.createDataFrame([("a", "ACME"), ("a", "acme"), ("a", None)], "product STRING, brand STRING")
    got = sorted((r.product, str(r.brand)) for r in rows.exclude_known_brands(c, e).collect())
    assert got == [("a", "New"), ("a", "None"), ("b", "Acme")]


def test_parse_lines(spark):
    text = "\n".join([
        "Here is the list, enjoy", "Brand;Model;URL", "1. **Acme**;X1, blue;https://a/1", " Zeta;Z;https://z;  ", "", "a;b", "a;b;c;d",
        "Brand;Model;URL", ";M;https://m",
    ])
    df = spark.createDataFrame([("tent", text), ("lamp", "Acme;L;https://l"), ("none", None)], "product STRING, response STRING")
    got = sorted((r.product, r.brand, r.model, r.url) for r in rows.parse_product_lines(df).collect() if r.brand)
    assert got == [
        ("lamp", "Acme", "L", "https://l"), ("tent", "Acme", "X1 blue", "https://a/1"),
        ("tent", "Brand", "Model", "URL"), ("tent", "Zeta", "Z", "https://z"),
    ]


def test_quota(spark):
    e = spark.createDataFrame(
        [("full", f"B{i}") for i in range(25)] + [("some", b) for b in ("Zeta", "ACME", "acme", None)], "product STRING, brand STRING"
    )
    cats = spark.createDataFrame([("full",), ("some",), ("none",)], "product STRING")
    got = {r.product: tuple(r)[1:] for r in dataset.brand_quota(e, cats).collect()}
    assert got == {
        "full": (25, -5, True, None), "some": (2, 18, False, "Leave out what is known: acme, zeta. "), "none": (0, 20, False, ""),
    }


def test_audit_and_counts(spark):
    t = spark.createDataFrame(
        [(i, "a", f"b{i}", "m", f"u{i}") for i in range(8)]
        + [(10 + i, "a", "b0", "m", "u0") for i in range(3)] + [(20, "b", None, " ", "u0"), (21, "b", "x", "m", None)], ROWS
    )
    got = {(r.rule, r.product, r.detail): r.n for r in dataset.dataset_audit(t).collect()}
    assert got == {
        ("few_brands", "b", None): 1, ("many_products", "a", "b0"): 4, ("repeated_url", "a", "u0"): 4,
        ("empty_field", "b", "brand"): 1, ("empty_field", "b", "model"): 1, ("empty_field", "b", "url"): 1,
    }
    c = dataset.dataset_counts(t).collect()[0]
    assert (c.n_categories, c.n_rows, c.n_category_brands, c.min_brands, c.max_brands, c.n_distinct_brands) == (2, 13, 9, 1, 8, 9)
    hist = {r.n_products: r.n_brands for r in dataset.products_per_brand(t).collect()}
    assert hist == {1: 8, 4: 1}
