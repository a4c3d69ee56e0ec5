import json
import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfline.operators.classify import Rules, facts_of, fetch_and_check
from shelfline.operators.search import search_refine
from shelfline.plans import clean, collect, requests
from shelfline.session import shared_dir
from shelfline.sources import keyed
from shelfline.streaming.verdicts import final_rows, judge_rows, read_verdicts, stream_verdicts, waiting_rows

RULES = Rules(product_terms=["buy"], unavailable_terms=["sold out"], url_terms=["ebay"])
ROWS = "id BIGINT, product STRING, brand STRING, model STRING, url STRING"
RESP = "query_type STRING, product STRING, brand STRING, url STRING, response STRING"


def stores(spark):
    pages = spark.createDataFrame(
        [("https://acme.com/1", "<title>Acme - X1</title>buy"), ("https://acme.com/2", "buy"), ("https://acme.com/3", "sold out"),
         ("https://acme.com/4", "<title>T</title>buy")],
        "url STRING, html STRING",
    )
    answers = [(k, "tent", "acme", f"https://acme.com/{n}", "True") for k in ("check_url", "check_product_page") for n in (1, 2, 3)]
    answers += [("update_model_name", "tent", "acme", "https://acme.com/1", "'X1 Pro'\nfrom the title"),
                ("update_model_name", "tent", "acme", "https://acme.com/4", "title uninformative")]
    aliases = spark.createDataFrame([("https://acme.com/old", "https://acme.com/1")], "url STRING, new_url STRING")
    results = spark.createDataFrame([("buy acme m3 tent", 1, "T", "https://acme.com/2")], "query STRING, rank INT, title STRING, link STRING")
    return dict(aliases=aliases, pages=pages, responses=spark.createDataFrame(answers, RESP)), results


def rows(spark):
    return spark.createDataFrame(
        [(0, "tent", "acme", "m0", "https://acme.com/1"), (1, "tent", "acme", "m1", "https://acme.com/old"),
         (2, "tent", "acme", "m3", "https://acme.com/3"), (3, "tent", "acme", "m4", "https://acme.com/4"),
         (4, "tent", "acme", "m5", None), (5, "tent", "acme", "m6", "https://gone.com/x")], ROWS)


def shuffled_columns(df):
    """What each exchange of the plan moves."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


def test_page_bodies_are_not_shuffled(spark, tmp_path):
    s, results = stores(spark)
    path = str(tmp_path / "pages")
    s["pages"].write.parquet(path)
    s["pages"] = spark.read.parquet(path)
    t = rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [
            fetch_and_check(t, rules=RULES, **s),
            judge_rows(t, rules=RULES, **s),
            collect.choose_pages(t, s["aliases"], s["pages"]),
            collect.refresh_model_names(t, **s),
            search_refine(t, results, rules=RULES, **s),
        ]
        for df in plans:
            moved = shuffled_columns(df)
            assert moved and not any("html" in m for m in moved)
        # Only the chosen pages meet their bodies.
        whole = collect.collect_pages(t, s["aliases"], s["pages"])
        assert sum("html" in m for m in shuffled_columns(whole)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clean_dataset(spark):
    s, results = stores(spark)
    v = rows(spark).withColumns({"major": F.lit(2), "minor": F.lit(0)})
    other = v.withColumns({"major": F.lit(1), "minor": F.lit(7)})
    both = v.unionByName(other)
    listed = both.select("product", "major", "minor").distinct()
    done = clean.clean_dataset(both, listed, results, rules=RULES, **s).collect()
    got = sorted((r.id, r.model, r.url, r.major, r.minor) for r in done)
    # Row 1 leads to the URL of row 0; row 2 is repaired from search; row 3 waits; 4 and 5 are dropped.
    assert got == [(0, "m0", "https://acme.com/1", 2, 1), (2, "m3", "https://acme.com/2", 2, 1)]
    first = clean.clean_dataset(both, listed, results, rules=RULES, custom_major=1, head=2, **s).collect()
    assert [(r.id, r.major, r.minor) for r in first] == [(0, 1, 8)]


def test_copies_fare_alike(spark):
    s, results = stores(spark)
    copies = spark.range(6, 300).select("id", F.lit("tent").alias("product"), F.lit("acme").alias("brand"),
                                        F.lit("m3").alias("model"), F.lit("https://acme.com/3").alias("url"))
    done = clean.check_products(rows(spark).unionByName(copies), results, rules=RULES, **s).collect()
    assert len(done) == 300
    assert len({tuple(r)[1:] for r in done if r.id == 2 or r.id >= 6}) == 1


def test_missing_brand_and_model_are_keys_like_others(spark):
    s, results = stores(spark)
    t = spark.createDataFrame([(0, "tent", None, "m", "https://acme.com/1"), (1, "tent", "acme", None, "https://acme.com/3"),
                               (2, None, None, None, "https://acme.com/2")], ROWS)
    found = results.unionByName(spark.createDataFrame([("buy acme tent", 1, "T", "https://acme.com/2")], results.schema))
    checked = clean.check_products(t, found, rules=RULES, **s)
    got = {r.id: (r.outcome, r.new_url, r.ask_type, r.ask_url) for r in checked.collect()}
    assert got == {0: ("undecided", None, "check_url", "https://acme.com/1"), 1: ("kept", "https://acme.com/2", None, None),
                   2: ("undecided", None, "check_url", "https://acme.com/2")}
    asked = [tuple(r) for r in clean.open_questions(checked).collect()]
    assert sorted(asked, key=repr) == sorted([("check_url", "tent", None, "https://acme.com/1"), ("check_url", None, None, "https://acme.com/2")], key=repr)
    # The stream's own-page verdict agrees where a row's own page decides.
    by_page = {r.id: r.outcome for r in judge_rows(t, rules=RULES, **s).collect()}
    assert by_page[0] == by_page[2] == "undecided"
    answers = s["responses"].unionByName(spark.createDataFrame(
        [(k, "tent", None, "https://acme.com/1", "True") for k in ("check_url", "check_product_page")], RESP))
    again = clean.check_products(t, found, s["aliases"], s["pages"], answers, RULES)
    assert {r.id: r.outcome for r in again.collect()}[0] == "kept"


def test_collect_pages(spark):
    s, _ = stores(spark)
    t = rows(spark).unionByName(spark.createDataFrame([(0, "lamp", "z", "m", "https://none"), (1, "lamp", None, "m", "https://acme.com/1")], ROWS))
    got = [tuple(r) for r in collect.collect_pages(t.filter("id <> 0 OR product = 'lamp'"), s["aliases"], s["pages"]).collect()]
    assert got == [("tent", "acme", 1, "https://acme.com/1", "<title>Acme - X1</title>buy", "Acme - X1buy")]


def test_refresh_names(spark):
    s, _ = stores(spark)
    got = {r.id: r.model for r in collect.refresh_model_names(rows(spark), **s).collect()}
    assert got == {0: "X1 Pro", 1: "X1 Pro", 2: "m3", 3: "m4", 4: "m5", 5: "m6"}


def test_requests_carry_their_facts(spark):
    s, _ = stores(spark)
    q = spark.createDataFrame(
        [(k, "tent", "acme", "m0", "https://acme.com/1") for k in
         ("check_url", "check_url_brand", "find_in_catalog", "check_product_page", "update_model_name")],
        "query_type STRING, product STRING, brand STRING, model STRING, url STRING")
    got = {r.query_type: r.request for r in requests.build_requests(q, s["pages"], budget=5).collect()}
    assert "acme.com/1" in got["check_url"] and "://" not in got["check_url"] and "tent" in got["check_url"]
    assert "https://acme.com/1" in got["check_url_brand"] and "acme" in got["check_url_brand"]
    assert got["find_in_catalog"].endswith("\nAcme - X1buy") and got["check_product_page"].endswith("\nAcme - X1buy")
    assert all(x in got["update_model_name"] for x in ("Acme X1", "m0", "tent", "acme"))


def test_stream_equals_batch(spark, tmp_path):
    s, _ = stores(spark)
    src = str(tmp_path / "in")
    t = rows(spark)
    for lo in (0, 2, 4):
        t.filter(F.col("id").between(lo, lo + 1)).coalesce(1).write.mode("append").parquet(src)
    facts = facts_of(s["pages"], RULES)

    def start():
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
        judge = lambda b: judge_rows(b, s["aliases"], facts, s["responses"], RULES)
        stream_verdicts(stream, judge, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    start()
    streamed = read_verdicts(spark, str(tmp_path / "out"))
    batch = judge_rows(t, rules=RULES, **s)
    assert sorted(map(str, streamed.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert streamed.select("batch").distinct().count() == 3
    # Started again, it takes only what is new.
    t.filter("id = 0").withColumn("id", F.lit(9).cast("long")).coalesce(1).write.mode("append").parquet(src)
    start()
    streamed = read_verdicts(spark, str(tmp_path / "out"))
    assert streamed.count() == 7
    assert [(r.id, r.url) for r in final_rows(streamed).collect()] == [(0, "https://acme.com/1")]


def test_backlog_is_judged_again(spark, tmp_path):
    """Rows of the first batch are decided once their question is answered, and only those are judged again."""
    s, _ = stores(spark)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = rows(spark).filter("id < 4")
    facts = facts_of(s["pages"], RULES)
    none = s["responses"].filter("false")
    known, judged = [none, none, s["responses"], s["responses"]], []

    def judge(batch):
        judged.append(sorted(r.id for r in batch.collect()))
        return judge_rows(batch, s["aliases"], facts, known[len(judged) - 1], RULES)

    def run(ids):
        t.filter(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(src)
        arriving = spark.readStream.schema(t.schema).parquet(src)
        stream_verdicts(arriving, judge, out, str(tmp_path / "cp"), answers=lambda: known[len(judged)]).awaitTermination()
        return {r.id: r.outcome for r in read_verdicts(spark, out).collect()}

    assert run([0, 3]) == {0: "undecided", 3: "undecided"}
    assert {(r.id, r.ask_type) for r in waiting_rows(spark, out).collect()} == {(0, "check_url"), (3, "check_url")}
    assert run([1]) == {0: "undecided", 3: "undecided", 1: "undecided"}
    # Now answers are there for rows 0 and 1; nobody asked about row 3.
    assert run([2]) == {0: "kept", 3: "undecided", 1: "kept", 2: "dropped"}
    assert judged == [[0, 3], [1], [0, 1, 2]]
    assert {r.id for r in waiting_rows(spark, out).collect()} == {3}
    whole = judge_rows(t, rules=RULES, **s)
    assert {r.id: r.outcome for r in whole.collect()} == {r.id: r.outcome for r in read_verdicts(spark, out).collect()}
    # Intermediate tables of the batches are gone.
    assert not [p for p in Path(shared_dir(spark).removeprefix("file:")).rglob("scratch-*/*")]


def test_bodies_stay_in_their_buckets(spark, tmp_path):
    """With stores bucketed by key no exchange carries HTML, broadcasts off."""
    from shelfline.operators.stores import lookup_pages
    from shelfline.sources import readers, sinks

    s, _ = stores(spark)
    t = rows(spark)
    sinks.save_page_store(s["pages"], "jobs_pages", 2)
    caught = spark.createDataFrame(
        [("u", k, datetime(2024, 1, k), "200", "text/html", f"h{k}") for k in range(1, 9)] + [("v", 9, datetime(2024, 1, 1), "404", "text/html", "x")],
        "url STRING, capture_id BIGINT, ts TIMESTAMP, status STRING, mime STRING, html STRING")
    sinks.save_capture_store(caught, "jobs_captures", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.table("jobs_pages")
        asked = t.select(F.lit("check_product_page").alias("query_type"), "product", "brand", "model", "url")
        until = datetime(2024, 1, 5, 12)
        plans = {
            "asof": readers.capture_asof_stored(spark, "jobs_captures", until),
            "lookup": lookup_pages(t, pages),
            "collect": collect.collect_pages(t, s["aliases"], pages),
            "ask": requests.build_requests(asked, pages),
        }
        for name, df in plans.items():
            moved = shuffled_columns(df)
            assert moved and not any("html" in m for m in moved), name
        assert sorted(map(tuple, plans["asof"].collect())) == sorted(map(tuple, readers.capture_asof(caught, until).collect()))
        assert [(r.url, r.html) for r in plans["asof"].collect()] == [("u", "h5")]
        got = sorted((r.id, r.html) for r in plans["lookup"].collect() if r.html)
        assert got == [(0, "<title>Acme - X1</title>buy"), (2, "sold out"), (3, "<title>T</title>buy")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("jobs_pages", "jobs_captures"):
            spark.sql(f"DROP TABLE {n}")


def keyed_name(url, folder):
    return (folder + url.replace("/", "\\") + ".html")[:200][len(folder):]


def test_a_folder_of_files_feeds_the_checks(spark, tmp_path):
    """The layout that fetching and asking tools write: a file per page, answer and search."""
    s, results = stores(spark)
    long = "https://acme.com/" + "x" * 250
    pages = {r.url: r.html for r in s["pages"].collect()} | {long: "buy"}
    page_dir = tmp_path / "html_pages" / "pages"
    page_dir.mkdir(parents=True)
    for url, html in pages.items():
        (page_dir / keyed_name(url, "html_pages/pages/")).write_text(html)
    answers = [tuple(r) for r in s["responses"].collect()] + [(k, "tent", "acme", long, "True") for k in ("check_url", "check_product_page")]
    for kind, _, _, url, said in answers:
        folder = tmp_path / "llm_responses" / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / keyed_name(url, f"llm_responses/{kind}/")).write_text(said)
    found = tmp_path / "google_responses"
    found.mkdir()
    (found / "buy acme m3 tent").write_text(json.dumps({"items": [{"title": "T", "link": "https://acme.com/2"}]}))
    (found / "buy acme m4 tent").write_text(json.dumps({"error": {"code": 429}}))

    t = rows(spark).unionByName(spark.createDataFrame([(6, "tent", "acme", "m7", long), (7, "tent", "acme", "m8", long + "y")], ROWS))
    kinds = ["check_url", "check_url_brand", "find_in_catalog", "check_product_page"]
    root = str(tmp_path)
    kept = dict(
        results=keyed.scan_keyed_searches(spark, root), aliases=s["aliases"], pages=keyed.scan_keyed_pages(spark, root, 3),
        responses=keyed.scan_keyed_responses(spark, root, kinds, 3),
    )
    checked = {r.id: (r.outcome, r.new_model, r.new_url) for r in clean.check_products(t, rules=RULES, **kept).collect()}
    plain = {r.id: (r.outcome, r.new_model, r.new_url) for r in clean.check_products(rows(spark), results, rules=RULES, **s).collect()}
    assert {i: checked[i] for i in plain} == plain
    # URLs that agree in the characters that make the key share their page and answers.
    assert checked[6] == ("kept", "m7", long) and checked[7] == ("kept", "m8", long + "y")
    assert {r.id: r.outcome for r in judge_rows(t, kept["aliases"], kept["pages"], kept["responses"], RULES).collect()}[7] == "kept"
    assert keyed.scan_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_files_are_written_whole_and_by_name(spark, tmp_path):
    files = spark.createDataFrame([("https:\\\\a.com\\x.html", "<p>é\r\n"), ("b", "")], "name STRING, body STRING")
    folder = f"file://{tmp_path}/f"
    keyed.write_files(files.repartition(2), folder)
    assert sorted(map(tuple, keyed.scan_files(spark, folder, 3).collect())) == sorted(map(tuple, files.collect()))
    with pytest.raises(ValueError):
        keyed.local_path("s3a://bucket/x")


def test_stream_reads_a_table_of_one_file_or_of_many(spark, tmp_path):
    from workload.queries import QUERIES

    pages = spark.createDataFrame(
        [(i, f"https://www.acme{i % 3}.com/{'ab' if i % 2 else 'cd'}/{i}", f"<title>Acme {i}</title><p>buy {i}") for i in range(24)],
        "page_id BIGINT, url STRING, html STRING",
    )
    pages.repartition(3).write.parquet(str(tmp_path / "many" / "pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "pages.parquet")
    # Another table beside it is not read.
    pages.coalesce(1).write.parquet(str(tmp_path / "many" / "labels.parquet"))
    many, one = (sorted(map(str, QUERIES["stream_verdicts"](spark, str(tmp_path / k)).collect())) for k in ("many", "one"))
    assert many == one and len(many) == 24
