from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfline.operators import stores, versions
from shelfline.plans import find
from shelfline.sources import readers, sinks

ROWS = "id BIGINT, product STRING, brand STRING, model STRING, url STRING"


def test_categories(spark, tmp_path):
    f = tmp_path / "categories.md"
    f.write_text("## Home\nAir Purifier  \n\n# Other\n  tent\n#x\nLaptop")
    got = sorted(map(tuple, readers.scan_categories(spark, str(f)).collect()))
    assert got == [(0, "air purifier"), (1, "tent"), (2, "laptop")]


def test_lines_keep_their_order_over_many_splits(spark, tmp_path):
    f = tmp_path / "long.md"
    f.write_text("# head\n" + "\n".join(f"Cat {i}" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.text(str(f)).rdd.getNumPartitions() > 5
        got = {r.idx: r.product for r in readers.scan_categories(spark, str(f)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"cat {i}" for i in range(3000)}


def test_products(spark, tmp_path):
    a, b = tmp_path / "slow cooker", tmp_path / "c+d"
    a.mkdir(), b.mkdir()
    (a / "latest.csv").write_bytes(
        b'Product,Brand,Model,URL\r\nslow cooker,Acme," X, 1/2"" kit",https://a/1\r\nslow cooker,Zeta, Lead,https://z'
    )
    (b / "latest.csv").write_text("Product,Brand,Model,URL\nx,Kärcher,K2,https://k\n")
    (b / "other.csv").write_text("Product,Brand,Model,URL\nx,No,No,https://no\n")
    got = sorted(map(tuple, readers.scan_products(spark, str(tmp_path), "latest.csv").collect()))
    assert got == [
        ("c+d", "Kärcher", "K2", "https://k", 0),
        ("slow cooker", "Acme", ' X, 1/2" kit', "https://a/1", 0),
        ("slow cooker", "Zeta", " Lead", "https://z", 1),
    ]


def test_aliases(spark, tmp_path):
    f = tmp_path / "aliases.csv"
    f.write_text("x|heading\na|1\nb|2\nonly\na|b|c\na|3\n")
    got = sorted(map(tuple, readers.scan_url_aliases(spark, str(f)).collect()))
    assert got == [("a", "3"), ("b", "2")]


def test_page_files(spark, tmp_path):
    (tmp_path / "a.com\\x y+z.html").write_text("<p>é</p>")
    got = [tuple(r) for r in readers.scan_page_files(spark, str(tmp_path)).collect()]
    assert got == [("a.com\\x y+z.html", "<p>é</p>")]


def test_search_results(spark):
    bodies = [
        ("q1", '{"items": [{"title": "A", "link": "https://a"}, {"link": "https://b", "x": 1}]}'),
        ("q2", '{"error": {"code": 429}, "items": [{"title": "A", "link": "l"}]}'), ("q3", '{"kind": "x"}'), ("q4", "not json"), ("q5", None),
    ]
    df = spark.createDataFrame(bodies, "query STRING, body STRING")
    got = sorted(map(tuple, readers.scan_search_results(df).collect()))
    assert got == [("q1", 1, "A", "https://a"), ("q1", 2, None, "https://b")]
    assert {r.query for r in readers.usable_searches(df).collect()} == {"q1", "q3"}


def test_capture(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [
        ("u", 1, t(1), "200", "text/html", "one"), ("u", 2, t(3), "200", "text/html", "two"), ("u", 3, t(3), "200", "text/html", "three"),
        ("u", 4, t(2), "404", "text/html", "x"), ("u", 5, t(9), "200", "text/html", "late"), ("v", 6, t(1), "200", "image/png", "x"),
    ]
    df = spark.createDataFrame(rows, "url STRING, capture_id BIGINT, ts TIMESTAMP, status STRING, mime STRING, html STRING")
    got = [(r.url, r.capture_id, r.html) for r in readers.capture_asof(df, t(3)).collect()]
    assert got == [("u", 3, "three")]


def listing(spark, *names, product="tent"):
    return spark.createDataFrame([(product, f"/d/{product}/{n}") for n in names], "product STRING, path STRING")


@pytest.mark.parametrize(
    "names, custom, want",
    [
        ([], None, (0, -1)),
        (["products_v1.0.csv"], None, (1, 0)),
        (["products_v1.2.csv", "products_v2.0.csv"], None, (2, 0)),
        (["products_v2.0.csv", "products_v2.10.csv", "products_v2.9.csv"], None, (2, 10)),
        (["products_v1.0.csv", "dropped_products_v9.9.csv", "products_v3.1.csv.bak", "latest.csv"], None, (1, 0)),
        (["products_v1.4.csv", "products_v3.7.csv"], 1, (3, 4)),
        (["products_v3.7.csv"], 2, (3, -1)),
    ],
)
def test_versions(spark, names, custom, want):
    v = versions.parse_versions(listing(spark, *names) if names else listing(spark, "x").limit(0))
    cats = spark.createDataFrame([("tent",)], "product STRING")
    latest = versions.latest_version(v, cats, custom)
    assert [tuple(r)[1:] for r in latest.collect()] == [want]
    minor = versions.next_version(latest, True, custom).collect()[0]
    major = want[0] if custom is None else custom
    assert (minor.major, minor.minor, minor.name) == (major, want[1] + 1, f"products_v{major}.{want[1] + 1}")
    assert versions.next_version(latest, False).collect()[0].name == f"products_v{want[0] + 1}.0"
    source = versions.source_version(latest, custom).collect()[0]
    assert (source.major, source.minor) == (major, want[1])


def test_version_listing_and_export(spark, tmp_path):
    for n in ("products_v1.0.csv", "products_v1.1.csv", "temp_products_v4.0.csv"):
        (tmp_path / "air fryer").mkdir(exist_ok=True)
        (tmp_path / "air fryer" / n).write_text("Product,Brand,Model,URL\n")
    got = sorted((r.product, r.major, r.minor) for r in versions.list_versions(spark, str(tmp_path)).collect())
    assert got == [("air fryer", 1, 0), ("air fryer", 1, 1)]


def test_write_version_refuses_to_overwrite(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "b", "m", "u", 1, 0), (2, "b", "b", "m", "u", 1, 0)], ROWS + ", major INT, minor INT")
    sinks.write_version(rows, root)
    with pytest.raises(ValueError, match="version exists"):
        sinks.write_version(rows.filter("product = 'a'"), root)
    sinks.write_version(rows.withColumn("minor", F.lit(1)), root)
    back = spark.read.parquet(root)
    assert back.count() == 4
    latest = versions.latest_version(versions.list_table_versions(spark, root), back)
    assert versions.select_version(back, versions.source_version(latest)).count() == 2
    done = spark.createDataFrame([("a",)], "product STRING")
    assert {r.product for r in versions.publish_latest(back, latest, done).collect()} == {"b"}


def test_csv_round_trip(spark, tmp_path):
    rows = [(0, "slow cooker", "Acme", ' a, "b"', "https://x"), (1, "slow cooker", None, "m ", "https://y"), (0, "tent", "T", "m", "https://z")]
    root = str(tmp_path / "csv")
    sinks.export_csv(spark.createDataFrame(rows, ROWS), root)
    back = readers.scan_products(spark, root).select("id", "product", "brand", "model", "url")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_outcomes_are_written_apart(spark, tmp_path):
    checked = spark.createDataFrame(
        [(1, "a", "b,c", "m", "n", "u", "r", "nu", "kept"), (2, "a", "b", "m", None, "u", "r", None, "dropped")],
        "id BIGINT, product STRING, brand STRING, model STRING, new_model STRING, url STRING, resolved_url STRING, new_url STRING, outcome STRING",
    )
    root = str(tmp_path / "o")
    sinks.write_kept_dropped(checked, root)
    kept = spark.read.parquet(root + "/outcome=kept").collect()
    dropped = spark.read.parquet(root + "/outcome=dropped").collect()
    assert [tuple(r) for r in kept] == [(1, "a", "b,c", "n", "nu", "r")]
    assert [tuple(r) for r in dropped] == [(2, "a", "b", "m", "u", "r")]


def test_pages_replace_only_their_category(spark, tmp_path):
    root = str(tmp_path / "p")
    ddl = "product STRING, id BIGINT, html STRING, content STRING"
    sinks.write_pages_content(spark.createDataFrame([("a", 1, "x", "x"), ("a", 2, "x", "x"), ("b", 1, "x", "x")], ddl), root)
    sinks.write_pages_content(spark.createDataFrame([("a", 9, "y", "y")], ddl), root)
    assert sorted((r.product, r.id) for r in spark.read.parquet(root).collect()) == [("a", 9), ("b", 1)]


def test_stores_grow_by_what_is_new(spark, tmp_path):
    key, ddl = ["query_type", "url"], "query_type STRING, url STRING, response STRING"
    old = spark.createDataFrame([("t", "a", "old")], ddl)
    path = str(tmp_path / "r")
    old.write.parquet(path)
    fresh = spark.createDataFrame([("t", "a", "new"), ("t", "b", "B"), ("t", "b", "A"), ("t", "c", None), ("s", "a", "S")], ddl)
    sinks.merge_responses(fresh, old, path, key)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("s", "a", "S"), ("t", "a", "old"), ("t", "b", "A")]
    moved = spark.createDataFrame([("a", "a"), ("b", "c"), ("d", None)], "url STRING, new_url STRING")
    sinks.append_aliases(moved, str(tmp_path / "al"))
    sinks.append_aliases(spark.createDataFrame([("b", "e"), ("f", "g")], "url STRING, new_url STRING"), str(tmp_path / "al"))
    known = readers.scan_alias_store(spark, str(tmp_path / "al"))
    assert sorted(map(tuple, known.collect())) == [("b", "e"), ("f", "g")]
    once = stores.resolve_alias(spark.createDataFrame([("b",), ("x",)], "url STRING"), known)
    assert sorted((r.url, r.new_url) for r in once.collect()) == [("b", "e"), ("x", "x")]


def test_null_keys_are_stored_once(spark, tmp_path):
    key, ddl = ["query_type", "brand"], "query_type STRING, brand STRING, response STRING"
    fresh, path = spark.createDataFrame([("t", None, "x")], ddl), str(tmp_path / "n")
    spark.createDataFrame([], ddl).write.parquet(path)
    for _ in range(2):
        sinks.merge_responses(fresh, spark.createDataFrame(spark.read.parquet(path).collect(), ddl), path, key)
    assert spark.read.parquet(path).count() == 1


def test_pending_fetch_follows_what_the_checks_look_up(spark):
    pages = spark.createDataFrame([("https://a/new", "x"), ("https://a/b", "x"), ("https://a/failed", None)], "url STRING, html STRING")
    aliases = spark.createDataFrame([("https://a/old", "https://a/new"), ("https://a/moved", "https://a/elsewhere")], "url STRING, new_url STRING")
    rows = spark.createDataFrame([(u,) for u in ("https://a/old", "https:// a/b", "https://a/failed", "https://a/moved", "x.pdf", None)], "url STRING")
    assert sorted(r.url for r in stores.pending_fetch(rows, pages, aliases).collect()) == ["https://a/elsewhere", "https://a/failed"]


def test_fields_with_line_feeds_and_versions_from_file_names(spark, tmp_path):
    for version, lines in (("1.0", ["t,A,m,https://a"]), ("2.1", ['t,B,"line1\nline2, ""x""",https://b', "t,C,n,https://c"])):
        folder = tmp_path / "007"
        folder.mkdir(exist_ok=True)
        (folder / f"products_v{version}.csv").write_text("Product,Brand,Model,URL\n" + "\n".join(lines) + "\n")
    got = sorted(tuple(r) for r in readers.scan_versioned_products(spark, str(tmp_path)).collect())
    assert got == [("007", 1, 0, "A", "m", "https://a", 0), ("007", 2, 1, "B", 'line1\nline2, "x"', "https://b", 0), ("007", 2, 1, "C", "n", "https://c", 1)]
    assert readers.scan_products(spark, str(tmp_path)).count() == 3


def test_category_names_stay_text(spark, tmp_path):
    root = str(tmp_path / "v")
    sinks.write_version(spark.createDataFrame([("007", 1, 0, 5)], "product STRING, major INT, minor INT, id BIGINT"), root)
    assert [tuple(r) for r in versions.list_table_versions(spark, root).collect()] == [("007", 1, 0)]
    with pytest.raises(ValueError, match="007 v1.0"):
        sinks.write_version(spark.createDataFrame([("007", 1, 0, 6)], "product STRING, major INT, minor INT, id BIGINT"), root)


def test_bucketed_page_store_is_not_shuffled(spark):
    pages = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("x"), 50).alias("html"))
    sinks.save_page_store(pages, "page_store_test", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.range(0, 300, 3).select(F.concat(F.lit("u"), "id").alias("url"), "id")
        j = wanted.join(spark.table("page_store_test"), "url")
        assert j.count() == 100
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") and "Bucketed: true" in plan
        assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE page_store_test")


def test_find_products(spark):
    cats = spark.createDataFrame([(0, "tent"), (1, "lamp"), (2, "desk")], "idx BIGINT, product STRING")
    old = spark.createDataFrame(
        [("tent", "Acme", 2, 0), ("tent", "Old", 1, 0), ("tent", "Zeta", 2, 1), ("desk", "D1", 1, 0), ("desk", "D2", 1, 0)],
        "product STRING, brand STRING, major INT, minor INT",
    )
    have = old.select("product", "major", "minor").distinct()
    asked = {r.product: r.request for r in find.ask_for_products(cats, old, have, want=2).collect()}
    assert set(asked) == {"tent", "lamp"}
    assert "Leave out what is known: acme. " in asked["tent"] and "Leave out" not in asked["lamp"] and "6 lines" in asked["lamp"]
    answers = spark.createDataFrame(
        [("find_sites", p, "", "", "Brand;Model;URL\nACME;A;https://a\nNew;N;https://n") for p in ("tent", "lamp", "desk")],
        "query_type STRING, product STRING, brand STRING, url STRING, response STRING",
    )
    got = sorted((r.product, r.brand, r.major, r.minor) for r in find.find_products(cats, old, have, answers, want=2).collect())
    assert got == [("lamp", "ACME", 1, 0), ("lamp", "New", 1, 0), ("tent", "New", 3, 0)]
    sliced = find.find_products(cats, old, have, answers, start=1, num=1, want=2)
    assert {r.product for r in sliced.collect()} == {"lamp"}
    # Answers belong to who was asked, and to the choice of leaving known brands out.
    assert find.find_products(cats, old, have, answers, want=2, exclude_existing=False).count() == 0
    assert find.find_products(cats, old, have, answers, want=2, model="other").count() == 0
    open_key = {r.product: (r.brand, r.url) for r in find.ask_for_products(cats, old, have, want=2, exclude_existing=False, model="m").collect()}
    assert set(open_key.values()) == {("m", "all")}
    answers = answers.withColumn("url", F.lit("all"))
    again = find.find_products(cats, old, have, answers, want=2, exclude_existing=False)
    assert {(r.product, r.brand) for r in again.collect()} == {(p, b) for p in ("tent", "lamp", "desk") for b in ("ACME", "New")}


VERSIONED = ROWS + ", major INT, minor INT"


def tree_of(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


@pytest.fixture
def dataset(spark):
    rows = [(i, c, f"b{i % 3}", "a, \"b\"\nc" if i == 2 else f"m{i}", f"https://x/{i}", 1, 0) for c in ("tent", "air fryer") for i in range(7)]
    return spark.createDataFrame(rows, VERSIONED).repartition(3)


def test_named_version_files_round_trip(spark, dataset, tmp_path):
    root = str(tmp_path)
    counts = sinks.write_version_files(dataset, root)
    assert counts == {"rows": 14, "empty_brand": 0, "empty_model": 0, "empty_url": 0}
    sinks.write_version_files(dataset.filter("product = 'tent' and id > 2").withColumn("minor", F.lit(1)), root)
    assert tree_of(tmp_path) == ["air fryer/products_v1.0.csv", "tent/products_v1.0.csv", "tent/products_v1.1.csv"]
    lines = (tmp_path / "tent" / "products_v1.1.csv").read_text().splitlines()
    assert lines == ["Product,Brand,Model,URL"] + [f"tent,b{i % 3},m{i},https://x/{i}" for i in range(3, 7)]
    back = readers.scan_versioned_products(spark, root)
    got = sorted((r.id, r.product, r.brand, r.model, r.url) for r in back.filter("minor = 0").collect())
    assert got == sorted(tuple(r)[:5] for r in dataset.collect())
    assert [r.model for r in back.filter("minor = 1").orderBy("id").collect()] == ["m3", "m4", "m5", "m6"]


def test_a_large_category_is_a_folder_of_files(spark, dataset, tmp_path):
    root = str(tmp_path)
    sinks.write_version_files(dataset, root, rows_per_file=3)
    assert [p for p in tree_of(tmp_path) if p.startswith("tent")] == [f"tent/products_v1.0.csv/part-0000{k}.csv" for k in range(3)]
    back = readers.scan_versioned_products(spark, root).select("id", "product", "brand", "model", "url")
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r)[:5] for r in dataset.collect())
    assert sorted(map(tuple, versions.list_versions(spark, root).select("product", "major", "minor").collect())) == [("air fryer", 1, 0), ("tent", 1, 0)]


@pytest.mark.parametrize("write", [sinks.write_version, sinks.write_version_files])
def test_a_refused_write_leaves_nothing(spark, dataset, tmp_path, write):
    root = str(tmp_path)
    write(dataset.filter("product = 'tent'"), root)
    before = tree_of(tmp_path)
    with pytest.raises(ValueError, match="version exists: tent v1.0"):
        write(dataset, root)
    assert tree_of(tmp_path) == before
    broken = dataset.filter("product <> 'tent'").withColumn("model", F.when(F.col("id") < 5, F.col("model")).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        write(broken, root)
    assert tree_of(tmp_path) == before and not list(tmp_path.glob(".staging*"))
    write(dataset.filter("product <> 'tent'"), root)


def test_a_claimed_version_is_refused(spark, dataset, tmp_path):
    (tmp_path / "tent").mkdir()
    (tmp_path / "tent" / ".products_v1.0.csv.claim").touch()
    with pytest.raises(ValueError, match="version exists: tent v1.0"):
        sinks.write_version_files(dataset, str(tmp_path))
    assert [p for p in tree_of(tmp_path) if p.endswith(".csv")] == []


def test_a_failed_move_is_taken_back(spark, dataset, tmp_path, monkeypatch):
    from shelfline.sources.trees import Tree

    plain, moved = Tree.move, []

    def move(self, source, target):
        if "." not in target[0][0] and len(target) == 2:
            moved.append(target)
            if len(moved) == 2:
                raise OSError("gone")
        plain(self, source, target)

    monkeypatch.setattr(Tree, "move", move)
    with pytest.raises(OSError, match="gone"):
        sinks.write_version_files(dataset, str(tmp_path))
    assert len(moved) == 2 and tree_of(tmp_path) == []


@pytest.mark.parametrize("name", [None, "", "a/b", ".x", "a:b"])
def test_names_that_are_no_folders(spark, dataset, tmp_path, name):
    with pytest.raises(ValueError):
        sinks.write_version_files(dataset.withColumn("product", F.lit(name).cast("string")), str(tmp_path))
    assert tree_of(tmp_path) == []


def test_rows_keep_their_order_in_files(spark, tmp_path):
    """Also where the whole table is one category and one version, written by constants."""
    rows = spark.range(500).select(F.col("id"), F.lit("b").alias("brand"), F.hex(F.xxhash64("id")).alias("model"), F.lit("u").alias("url"))
    rows = rows.repartition(5).select(F.lit("tent").alias("product"), "*", F.lit(1).alias("major"), F.lit(3).alias("minor"))
    root = str(tmp_path)
    sinks.write_version_files(rows, root, rows_per_file=60)
    assert sinks.publish_latest_files(spark, root, rows_per_file=90) == ["tent"]
    want = [r.model for r in rows.orderBy("id").collect()]
    for back in (readers.scan_versioned_products(spark, root), readers.scan_latest(spark, root)):
        assert [r.model for r in back.orderBy("id").collect()] == want


def test_publish_latest_files(spark, dataset, tmp_path):
    root = str(tmp_path)
    sinks.write_version_files(dataset, root)
    cleaned = dataset.filter("id > 3").withColumn("minor", F.lit(2))
    sinks.write_version_files(cleaned.filter("product = 'tent'"), root, rows_per_file=2)
    assert sinks.publish_latest_files(spark, root) == ["tent"]
    assert [r.url for r in readers.scan_latest(spark, root).orderBy("id").collect()] == [f"https://x/{i}" for i in (4, 5, 6)]
    # What is published stays, whatever is written later; what was never cleaned is not published.
    sinks.write_version_files(cleaned.filter("id > 5").withColumn("minor", F.lit(3)), root)
    assert sinks.publish_latest_files(spark, root) == ["air fryer"]
    got = sorted((r.product, r.id, r.url) for r in readers.scan_latest(spark, root).collect())
    assert got == [("air fryer", 0, "https://x/6"), *(("tent", k, f"https://x/{4 + k}") for k in range(3))]
    assert sinks.publish_latest_files(spark, root) == []


def test_counts_of_a_write_are_those_of_the_audit(spark, dataset, tmp_path):
    from shelfline.operators.dataset import dataset_audit

    odd = dataset.withColumn("model", F.when(F.col("id") > 2, F.col("model"))).withColumn("brand", F.when(F.col("id") == 1, F.lit(" ")).otherwise(F.col("brand")))
    counts = sinks.write_version(odd, str(tmp_path / "t"))
    audit = dataset_audit(odd).filter("rule = 'empty_field'").groupBy("detail").sum("n").collect()
    assert {f"empty_{r[0]}": r[1] for r in audit} == {k: v for k, v in counts.items() if k != "rows" and v}
    assert counts["rows"] == 14 and counts["empty_model"] == 6


def test_the_check_for_versions_opens_no_file(spark, dataset, tmp_path):
    """Footers of a table's files are not read: files that are no Parquet do not disturb a write."""
    root = tmp_path / "t"
    sinks.write_version(dataset.filter("product = 'tent'"), str(root))
    for f in root.rglob("*.parquet"):
        f.write_bytes(b"broken")
    for f in root.rglob("*.crc"):
        f.unlink()
    sinks.write_version(dataset.withColumn("minor", F.lit(1)), str(root))
    got = versions.list_table_versions(spark, str(root)).collect()
    assert sorted(map(tuple, got)) == [("air fryer", 1, 1), ("tent", 1, 0), ("tent", 1, 1)]


def test_a_missing_category_is_selected(spark):
    rows = spark.createDataFrame([(1, None, "b", "m", "u", 1, 1), (2, "a", "b", "m", "u", 1, 0)], VERSIONED)
    latest = versions.latest_version(rows, rows)
    assert {r.id for r in versions.select_version(rows, versions.source_version(latest)).collect()} == {1, 2}
    nobody = spark.createDataFrame([], "product STRING")
    assert {r.id for r in versions.publish_latest(rows, latest, nobody).collect()} == {1}
