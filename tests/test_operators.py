"""Operators on small literals, and on tables where one key holds a third of the rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import clean, dedupe, detections, integrate, leaves, matching, ranking, reports, upsert


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """9,000 rows, a third of them under one key, in random order; ``o`` is unique."""
    source = [("hot" if i % 3 == 0 else f"k{i % 500}", i) for i in range(9000)]
    random.Random(5).shuffle(source)
    return source, spark.createDataFrame(source, "k string, o int").repartition(7).persist()


def expected_ranks(source, sign=1):
    groups = collections.defaultdict(list)
    for k, o in source:
        groups[k].append(o)
    return sorted((k, o, r) for k, os in groups.items() for r, o in enumerate(sorted(os, key=lambda v: sign * v), 1))


def test_rank_in_hot_group(skewed):
    source, df = skewed
    assert sorted(map(tuple, ranking.rank_in_group(df, ["k"], ["o"], slices=16).collect())) == expected_ranks(source)
    down = ranking.rank_in_group(df, ["k"], ["o"], descending=["o"], slices=16)
    assert sorted(map(tuple, down.collect())) == expected_ranks(source, -1)


def test_rank_splits_the_hot_group(spark, skewed):
    _, df = skewed
    sliced = df.repartitionByRange(16, "k", "o").withColumn("s", F.spark_partition_id())
    largest = sliced.groupBy("s", "k").count().agg(F.max("count")).first()[0]
    assert largest < 1000


def test_rank_with_null_keys_and_without_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, o int")
    assert sorted(rows(ranking.rank_in_group(df, ["k"], ["o"], slices=3)), key=str) == [("a", 2, 1), (None, 1, 1), (None, 3, 2)]
    assert rows(ranking.rank_in_group(df.drop("k"), [], ["o"], slices=3), "o") == [(1, 1), (2, 2), (3, 3)]


def test_global_rank_over_many_slices(skewed):
    source, df = skewed
    found = ranking.rank_in_group(df.select("o"), [], ["o"], slices=16)
    assert [r for _, r in rows(found, "o")] == list(range(1, len(source) + 1))


def test_ranks_count_nothing_beforehand(spark, skewed):
    source, df = skewed
    ranked = ranking.rank_in_group(df, ["k"], ["o"])
    assert "_slice" in ranked._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, ranked.collect())) == expected_ranks(source)


def test_equal_rows_go_over_slices(spark):
    same = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(1).alias("o"))
    placed = ranking.sliced(same, ["k"], [F.col("o").asc()], 8)
    assert placed.groupBy("_slice").count().agg(F.max("count")).first()[0] < 1000
    assert {r["rank"] for r in ranking.rank_in_group(same, ["k"], ["o"], slices=8).collect()} == set(range(1, 4001))


def test_pages_are_bounded_and_whole(skewed):
    source, df = skewed
    pages = ranking.paged_lists(df, ["k"], ["o"], F.col("o"), 100).collect()
    assert max(len(p["items"]) for p in pages) == 100
    hot = [v for p in sorted(pages, key=lambda p: p.page) if p.k == "hot" for v in p["items"]]
    assert hot == sorted(o for k, o in source if k == "hot")


def test_top_per_group_limits_before_the_shuffle(skewed):
    source, df = skewed
    top = ranking.top_per_group(df, ["k"], [F.desc("o")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    groups = collections.defaultdict(list)
    for k, o in source:
        groups[k].append(o)
    assert sorted(map(tuple, top.collect())) == sorted((k, o) for k, os in groups.items() for o in sorted(os)[-2:])


def _filled(rows, targets, default):
    """(leaf, phase, product, taken) by the definition; rows equal in all of it are alike."""
    by_leaf = collections.defaultdict(list)
    for leaf, phase, product in rows:
        by_leaf[leaf].append((phase, product))
    return sorted((leaf, *row, k) for leaf, own in by_leaf.items()
                  for k, row in enumerate(sorted(own, key=lambda r: (r[0], r[1] is not None, r[1] or 0))[:max(0, targets.get(leaf, default(leaf)))], 1))


def test_quota_of_a_hot_leaf(spark):
    """A third of all rows in one leaf, copies among them, targets above the thousand up to which Spark limits groups in the map tasks."""
    rng = random.Random(2)
    rows = [("hot", rng.randint(1, 2), rng.randrange(20_000)) for _ in range(10_000)] + [("copies", 1, 7)] * 3000
    rows += [(f"l{k % 40}", rng.randint(1, 2), rng.randrange(500)) for k in range(17_000)]
    given = {"hot": 9000, "copies": 1200, "l1": 0, "l2": 1, "l3": 425, "l4": 10 ** 6, "l5": -3, **{f"l{k}": 100 + k for k in range(6, 40)}}
    candidates = spark.createDataFrame(rows, "leaf string, phase int, product_id long").repartition(8)
    targets = spark.createDataFrame(list(given.items()), "leaf string, target long")
    found = leaves.fill_quota(candidates, targets)
    assert sorted((r.leaf, r.phase, r.product_id, r.taken) for r in found.collect()) == _filled(rows, given, lambda leaf: 11_000)


def test_quota_cuts_see_no_leaf_whole(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 50)).alias("leaf"), F.lit(1).alias("phase"),
                                      F.col("id").alias("product_id"), F.lit("wide").alias("more"))
    targets = rows.select("leaf").distinct().withColumn("target", F.lit(9000))
    cuts = leaves.quota_cuts(rows, targets)
    assert [(r.leaf, r.cut.product) for r in cuts.collect()] == [("hot", 26_997)]
    plan = cuts._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan)
    # Ranks inside a slice; sums over slices, a row for each of a leaf.
    assert windows and all("_slice" in keys + order for keys, order in windows) and "more" not in plan
    placed = ranking.sliced(rows.select("leaf", "phase", "product_id"), ["leaf"], [F.col("product_id").asc()], 16)
    assert placed.groupBy("leaf", "_slice").count().agg(F.max("count")).first()[0] < 4000


def test_required_fields_follow_the_columns(spark):
    df = spark.createDataFrame([("p", "s", "1", None, "n"), ("p", "s", "1", "t", None), ("p", "s", "1", None, None),
                                (None, "s", "1", "t", "n"), ("p", None, "1", "t", "n"), ("p", "s", None, "t", "n"), ("", "s", "1", "t", "n")],
                               "image_path string, sku string, price string, title string, name string")
    assert clean.required_fields(df).count() == 3
    assert clean.required_fields(df.drop("title")).count() == 2
    assert clean.required_fields(df.drop("title", "name")).count() == 4
    renamed = clean.clean_stage(df.withColumnRenamed("image_path", "photo"), "photo")
    assert "image_path" in renamed.columns and renamed.count() == 3


def test_identity(spark):
    df = spark.createDataFrame([("a", None, "p"), (None, "s", "p"), (None, None, "p"), ("a", "s", ""), ("a", "s", None)],
                               "product_id string, sku string, image_path string")
    assert clean.has_identity(df).count() == 2


def test_canonical_falls_back_by_column(spark):
    df = spark.createDataFrame([("i", "src", "s", "t", "x1")], "_id string, source string, sku string, title string, price string")
    assert integrate.canonical(df).first().asDict() == {
        "product_id": "i", "platform": "src", "sku": "s", "name": "t", "price": None, "image_path": None,
        "cleaning_state": "UNKNOWN", "integrate_state": "SUCCESS"}


def test_dedupe_keeps_first_and_all_without_identifier(spark):
    df = spark.createDataFrame([("b.json", "1", None), ("a.json", "1", "9"), ("c.json", "", ""), ("d.json", None, None), ("e.json", "", "1")],
                               "source_file string, id string, product_id string")
    kept = dedupe.first_per_identifier(dedupe.with_identifier(df))
    assert [r.source_file for r in kept.orderBy("source_file").collect()] == ["a.json", "c.json", "d.json"]


def test_null_price_policy(spark):
    df = spark.createDataFrame([("a", None), ("b", " 2 "), ("c", "x")], "name string, price string")
    assert rows(clean.normalize_values(df), "name") == [("a", None), ("b", 2.0), ("c", 0.0)]
    assert rows(clean.normalize_values(df, "drop"), "name") == [("b", 2.0), ("c", 0.0)]


def test_upsert_is_idempotent_and_merges(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, p double")
    new = spark.createDataFrame([(2, None, 5.0, "x"), (3, "c", None, "y")], "k int, s string, p double, extra string")
    once = upsert.upsert(base, new, ["k"])
    expected = [(1, "a", 1.0, None), (2, "b", 5.0, "x"), (3, "c", None, "y")]
    assert rows(once, "k") == expected
    assert rows(upsert.upsert(once, new, ["k"]), "k") == expected


def test_upsert_folds_versions(spark):
    base = spark.createDataFrame([(1, "a")], "k int, s string")
    new = spark.createDataFrame([(1, "late", 9), (1, "early", 2), (1, None, 12)], "k int, s string, v int")
    assert rows(upsert.upsert(base, new, ["k"], ["v"])) == [(1, "late")]


def test_image_preference(spark):
    products = spark.createDataFrame([("a.json",), ("b.json",), ("c.json",), ("d.json",)], "source_file string")
    files = spark.createDataFrame([("a.png",), ("a.jpg",), ("a.jpeg",), ("b.JPG",), ("c.jpeg",), ("c.png",)], "file_name string")
    assert rows(matching.match_images(products, files).select("source_file", "image_file"), "source_file") == [
        ("a.json", "a.jpg"), ("b.json", None), ("c.json", "c.jpeg"), ("d.json", None)]


def test_ingest_status(spark):
    incoming = spark.createDataFrame([(f"{c}.json",) for c in "abcde"], "source_file string")
    stored = spark.createDataFrame([("a.json", "x"), ("b.json", None), ("c.json", None)], "source_file string, image_path string")
    files = spark.createDataFrame([("c.jpg",), ("d.jpg",)], "file_name string")
    found = matching.ingest_status(incoming, stored, files)
    assert [r.status for r in found.orderBy("source_file").collect()] == ["skip_done", "skip_wait", "update", "new", "new"]
    assert reports.ingest_report(found).first().asDict() == {"scanned": 5, "collected": 3, "skipped": 2}


def test_paths_keep_the_row_count(spark):
    df = spark.createDataFrame([("1",), ("1",), (None,), ("2",)], "product_id string")
    paths = spark.createDataFrame([("1", "p1"), ("1", "p1b"), (None, "pn")], "product_id string, clean_path string")
    assert sorted(rows(matching.join_paths(df, paths, "clean_path")), key=str) == [
        ("1", "p1"), ("1", "p1"), ("2", None), (None, None)]


def test_enrichment_precedence(spark):
    listing = spark.createDataFrame([(1, "l1", "t"), (2, "l2", "t"), (3, "l3", "t")], "id int, name string, platform string")
    detail = spark.createDataFrame([(1, "d1", "m")], "id int, name string, maker string")
    page = spark.createDataFrame([(1, "{}"), (2, "{}")], "id int, ld_json string")
    found = matching.enrich(listing, detail, page).select("id", "name", "platform", "maker", "ld_json", "data_source")
    assert rows(found, "id") == [(1, "d1", "t", "m", None, "api_detail"), (2, "l2", "t", None, "{}", "requests_ld_json"),
                                 (3, "l3", "t", None, None, "listing_only")]


def test_open_records_merge_by_key(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"x":1}}', '{"b":null,"c":[1]}'), ('{"a":1}', None), (None, '{"z":2.5}'), (None, None)], "l string, d string")
    merged = df.select(F.to_json(matching.merge_open(F.try_parse_json("l"), F.try_parse_json("d"))))
    assert [r[0] for r in merged.collect()] == ['{"a":1,"b":null,"c":[1]}', '{"a":1}', '{"z":2.5}', "{}"]


def test_best_detection_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("i", 0, 0.7), ("i", 1, 0.9), ("i", 2, 0.9), ("j", 0, 0.5), ("j", 1, 0.49)],
                               "image_id string, det_idx int, confidence double")
    assert rows(detections.best_per_image(df).select("image_id", "det_idx"), "image_id") == [("i", 1), ("j", 0)]
    assert detections.confident(df).count() == 4


def test_boxes_are_cut_to_the_image(spark):
    df = spark.createDataFrame([([-2.7, 1.9, 50.0, 3.2],), ([5.0, 5.0, 5.9, 9.0],), ([20.0, 0.0, 30.0, 5.0],), ([9.0, 1.0, 2.0, 3.0],)],
                               "bbox array<double>")
    boxes = [r[0] for r in df.select(detections.clamp_box(F.col("bbox"), F.lit(10), F.lit(10))).collect()]
    assert boxes == [[0, 1, 10, 3], None, None, None]


def test_metadata_never_says_none(spark):
    products = spark.createDataFrame([("i", None, None, "", "T", None, None)],
                                     "image_id string, _id string, product_id string, name string, title string, price int, platform string")
    found = detections.object_metadata(spark.createDataFrame([("i", 0)], "image_id string, det_idx int"), products).first()
    assert (found.original_id, found.sku if "sku" in found.asDict() else None, found.name, found.sub_id, found.price, found.platform) == (
        "unknown", "unknown_sku", "T", "unknown_obj0", None, "")


def test_points_leave_out_empty_vectors(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", []), ("c", None)], "sub_id string, embedding array<float>")
    found = detections.points(df)
    assert [r.payload.sub_id for r in found.collect()] == ["a"]
    assert detections.id_collisions(found).count() == 0


def test_leaves(spark):
    edges = spark.createDataFrame([("r", "a", False), ("r", "b", True), ("a", "c", True), ("a", "d", False), ("r", None, True),
                                   ("e", "", True), ("r", "e", False)], "parent string, id string, is_leaf boolean")
    roots = spark.createDataFrame([("r",), ("alone",)], "root string")
    assert rows(leaves.resolve_leaves(roots, edges), "root", "leaf") == [
        ("alone", "alone"), ("r", "b"), ("r", "c"), ("r", "d"), ("r", "e")]


def test_nodes_are_met_once(spark):
    edges = spark.createDataFrame([("r", "a", False), ("a", "r", False), ("r", "b", False), ("a", "x", False), ("b", "x", False), ("x", "l", False)],
                                  "parent string, id string, is_leaf boolean")
    assert rows(leaves.resolve_leaves(spark.createDataFrame([("r",)], "root string"), edges), "root", "leaf") == [("r", "l")]


def test_keywords_of_roots_without_any(spark):
    found = leaves.leaf_keywords(spark.createDataFrame([("r", "l"), ("q", "m"), ("e", "n")], "root string, leaf string"),
                                 spark.createDataFrame([("r", ["x", "y"]), ("e", [])], "root string, keywords array<string>"))
    assert rows(found.select("leaf", "keyword"), "leaf", "keyword") == [("l", "x"), ("l", "y"), ("m", ""), ("n", "")]


def test_progress_of_an_empty_root(spark):
    df = spark.createDataFrame([("a", "1", True), ("a", "2", False), ("b", None, None)], "root string, leaf string, done boolean")
    assert rows(leaves.progress(df), "root") == [("a", 2, 1, 1, 50.0), ("b", 0, 0, 0, 100.0)]


def test_failed_requests_do_not_exhaust_a_keyword(spark):
    log = spark.createDataFrame([("l", "k", 1, 40, False), ("l", "k", 2, 0, True), ("m", "k", 1, 40, False), ("m", "k", 2, 0, False), ("n", "k", 1, 0, True)],
                                "leaf string, keyword string, page int, n_rows int, failed boolean")
    assert rows(leaves.next_cursor(log), "leaf") == [("l", "k", 2), ("m", "k", -1), ("n", "k", 1)]


def test_observed_count(spark, tmp_path):
    df, seen = reports.counted(spark.range(17), "n")
    df.write.parquet(str(tmp_path / "x"))
    assert seen.get["rows"] == 17
