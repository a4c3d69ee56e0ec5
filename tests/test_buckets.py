from shelfline import schemas
from shelfline.sources import buckets
from shelfline.sources.trees import Tree


def answers(spark, *rows):
    return spark.createDataFrame(rows, schemas.RESPONSES)


def redirects(spark, *rows):
    return spark.createDataFrame(rows, schemas.ALIASES)


def places(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("generation=*"))


def test_answers_are_merged_once(spark, tmp_path):
    path = str(tmp_path)
    assert buckets.read_answers(spark, path).count() == 0
    first = answers(spark, ("t", "a", "b", "u1", "old"), ("t", "a", "b", "u2", None), ("t", None, "b", "u1", "n"))
    assert buckets.merge_answers(first, path, 8) == 2
    more = answers(spark, ("t", "a", "b", "u1", "new"), ("t", "a", "b", "u2", "B"), ("t", "a", "b", "u2", "A"), ("t", None, "b", "u1", "m"))
    assert buckets.merge_answers(more, path) == 1
    before = places(tmp_path)
    # The same again changes nothing, and neither do failed answers.
    assert buckets.merge_answers(more, path) == 0 and buckets.merge_answers(first, path) == 0 and places(tmp_path) == before
    got = sorted((str(r.product), r.url, r.response) for r in buckets.read_answers(spark, path).collect())
    assert got == [("None", "u1", "n"), ("a", "u1", "old"), ("a", "u2", "A")]


def test_a_merge_opens_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    buckets.merge_answers(answers(spark, *(("t", "a", "b", f"u{i}", "x") for i in range(60))), path, 16)
    asked = []
    plain = buckets._held

    def held(spark, path, schema, some=None):
        rows = plain(spark, path, schema, some)
        asked.append((some, rows.inputFiles(), rows._jdf.queryExecution().executedPlan().toString()))
        return rows

    monkeypatch.setattr(buckets, "_held", held)
    assert buckets.merge_answers(answers(spark, ("t", "a", "b", "u7", "y")), path) == 0
    [(some, files, plan)] = asked
    assert len(some) == 1 and "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", " ") or f"bucket#{''}" in plan
    assert len(Tree(spark, path).find("buckets=16/bucket=*")) > 4


def test_last_redirect_counts_and_repeats_add_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert buckets.merge_redirects(redirects(spark, ("a", "b"), ("c", "c"), ("d", None), ("e", "f")), path, 4) == 2
    assert buckets.merge_redirects(redirects(spark, ("a", "b")), path) == 0
    assert buckets.merge_redirects(redirects(spark, ("a", "z"), ("a", "y")), path) == 1
    assert sorted(map(tuple, buckets.read_redirects(spark, path).collect())) == [("a", "z"), ("e", "f")]
    assert buckets.merge_redirects(redirects(spark, ("a", "b")), path) == 1
    assert sorted(map(tuple, buckets.read_redirects(spark, path).collect())) == [("a", "b"), ("e", "f")]


def test_compaction_keeps_what_is_read(spark, tmp_path):
    path = str(tmp_path)
    for k in range(4):
        buckets.merge_redirects(redirects(spark, ("a", f"x{k}"), (f"b{k}", "y")), path, 2)
    before = sorted(map(tuple, buckets.read_redirects(spark, path).collect()))
    full = buckets.compact(spark, path, schemas.ALIASES, ["url"], most=2)
    assert full and buckets.compact(spark, path, schemas.ALIASES, ["url"], most=2) == []
    assert sorted(map(tuple, buckets.read_redirects(spark, path).collect())) == before
    assert buckets.merge_redirects(redirects(spark, ("a", "x3")), path) == 0
    assert buckets.compact(spark, str(tmp_path / "none"), schemas.ALIASES, ["url"]) == []
