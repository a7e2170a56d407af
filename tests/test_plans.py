"""Sources, sinks, streams and whole jobs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators.detections import points
from shelfspark.plans import checkout, collection, indexing, preprocessing
from shelfspark.sinks import tables, vector_index
from shelfspark.sources import dimensions, documents
from shelfspark.streaming.checkout import checkout_stream, read_carts, read_items
from shelfspark.streaming.ingest import distinct_stream, ingest, read_report
from shelfspark.streaming.quota import quota_stream
from tests.test_images import table


def write_documents(folder, **contents):
    folder.mkdir(exist_ok=True)
    for name, value in contents.items():
        (folder / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def test_run_folders_are_dropped(spark):
    from shelfspark.session import drop_scratch, materialize, run_folder, shared_folder
    assert run_folder(spark).startswith(shared_folder(spark))
    other = f"{shared_folder(spark)}/some-run"
    spark.range(3).write.parquet(f"{other}/t")
    assert materialize(spark.range(3), "kept").count() == 3
    assert drop_scratch(spark, "some-run") and not tables.exists(spark, other) and tables.exists(spark, run_folder(spark))


def test_documents(spark, tmp_path):
    write_documents(tmp_path / "d", a={"id": 1, "name": "Ê", "price": 12.5, "ld_json": [1, {"x": 2}]}, b={"id": "2", "ld_json": {"y": 1}, "primary_category_path": "r/l"},
                    c="{broken", d="[1, 2]", e="")
    (tmp_path / "d" / "f.txt").write_text("{}")
    found = {r.source_file: r for r in documents.read_products(spark, str(tmp_path / "d")).withColumn("ld", F.to_json(F.try_variant_get("body", "$.ld_json", "variant"))).collect()}
    assert sorted(found) == ["a.json", "b.json"]
    assert (found["a.json"].id, found["a.json"].name, found["a.json"].price, found["a.json"].ld) == ("1", "Ê", "12.5", '[1,{"x":2}]')
    assert found["b.json"].ld == '{"y":1}'
    assert sorted(r[0] for r in documents.unreadable_products(spark, str(tmp_path / "d")).collect()) == ["c.json", "d.json"]
    historic = documents.read_historic(spark, str(tmp_path / "d")).orderBy("product_id").collect()
    assert [tuple(r) for r in historic] == [("a", ""), ("b", "r/l")]


def test_listing(spark, tmp_path):
    import os
    for folder, age in (("x", 100), ("y", 50)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.jpg").write_bytes(folder.encode())
        os.utime(tmp_path / folder / "same.jpg", (10**9 - age, 10**9 - age))
    (tmp_path / "x" / "other.jpg").write_bytes(b"..")
    files = documents.list_files(spark, str(tmp_path))
    assert {r.file_name: r.length for r in files.collect()} == {"same.jpg": 1, "other.jpg": 2}
    assert "/y/same.jpg" in documents.find_file(files, "same.jpg").first().path
    assert documents.find_file(files, "none.jpg").count() == 0


def test_trial_limit_and_listing_ids(spark):
    assert [r.id for r in documents.first_rows(spark.range(50), ["id"], 3).collect()] == [0, 1, 2]
    assert documents.first_rows(spark.range(50), ["id"]).count() == 50
    assert documents.with_listing_id(spark.range(3)).count() == 2


def test_spread_rows_come_back_one_by_one(spark, tmp_path):
    """Every row of the collection is read back, copies and nulls too, and says whether the partitions are even."""
    from shelfspark.suite.catalogue import spread_collection
    rows = [(k // 2 if k % 9 else None, f"c{k}", k % 25, float(k), "M") for k in range(400)]
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "customer.parquet"))
    found = spread_collection(spark, str(tmp_path))
    assert found.columns == ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "spread"]
    assert sorted(found.collect(), key=lambda r: int(r[1][1:])) == [(*r[:3], r[4], True) for r in rows]


def test_dimensions(spark):
    assert dimensions.root_categories(spark).count() == 15
    assert dimensions.keyword_dimension(spark, {"1": ["a", "b"]}).first().keywords == ["a", "b"]


def test_runs_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(5).withColumn("image_data", F.lit(b"x"))
    for run in ("a", "b", "a"):
        stage = tables.append_stage(df, path, "clean", run)
    stored = spark.read.parquet(stage)
    assert stored.count() == 10 and "image_data" not in stored.columns


def test_insert_absent_reruns_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    for run, rows in (("007", [1, 2, 2]), ("008", [2, 3]), ("007", [1, 2, 2]), ("008", [2, 3])):
        tables.insert_absent(spark.createDataFrame([(r,) for r in rows], "k int"), path, ["k"], run)
    stored = spark.read.schema("k int, run_id string").parquet(path)
    assert sorted(map(tuple, stored.collect())) == [(1, "007"), (2, "007"), (3, "008")]


def test_change_log(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.log_changes(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int"), path, 0)
    for _ in range(2):
        tables.log_changes(spark.createDataFrame([(2, None, 5, "x")], "k int, s string, n int, extra string"), path, 1)
    state = [(1, "a", 1, None), (2, "b", 5, "x")]
    assert [tuple(r) for r in tables.current(spark, path, ["k"]).orderBy("k").select("k", "s", "n", "extra").collect()] == state
    tables.compact(spark, path, ["k"], str(tmp_path / "log2"))
    assert spark.read.parquet(str(tmp_path / "log2")).count() == 2


def test_resume_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.load_state(spark, path, ["leaf"]) is None
    tables.save_state(spark.createDataFrame([("l", 3, False)], "leaf string, count int, done boolean"), path, 0)
    tables.save_state(spark.createDataFrame([("l", None, True)], "leaf string, count int, done boolean"), path, 1)
    assert tuple(tables.load_state(spark, path, ["leaf"]).first()) == ("l", 3, True)


def test_vector_index(spark, tmp_path):
    path = str(tmp_path / "index")
    vector_index.ensure_index(spark, path, "i", 2, "m")
    vector_index.ensure_index(spark, path, "i", 2, "m")
    with pytest.raises(ValueError):
        vector_index.ensure_index(spark, path, "i", 3, "m")
    good = spark.createDataFrame([("a", [1.0, 2.0], "n"), ("b", [], "n")], "sub_id string, embedding array<float>, name string")
    vector_index.publish(points(good), path, 0)
    assert vector_index.read_points(spark, path).count() == 1
    wrong = spark.createDataFrame([("c", [1.0], "n")], "sub_id string, embedding array<float>, name string")
    with pytest.raises(Exception, match="without 2 dimensions"):
        vector_index.publish(points(wrong), path, 1)


def test_bytes_come_last(spark, tmp_path):
    """Files nobody wants are listed, never opened; a file that several rows want is read for each."""
    from shelfspark.session import materialize
    from shelfspark.sinks.files import write_files
    from shelfspark.sources import images as sources

    folder = str(tmp_path / "images")
    rows = spark.createDataFrame([(f"a/{k}.jpg", b"x" * k) for k in range(40)] + [(None, b"y"), ("none.jpg", None)], "path string, content binary")
    assert write_files(rows, folder, "path", "content") == write_files(rows, folder, "path", "content") == 40
    files = sources.manifest(spark, folder)
    assert "ReadSchema: struct<path:string,length:bigint>" in files._jdf.queryExecution().executedPlan().toString() and files.count() == 39  # not the empty one
    files = materialize(files, "files")
    for k in range(5, 40):
        (tmp_path / f"images/a/{k}.jpg").unlink()
    products = spark.createDataFrame([(k, f"s3://a/{k % 5}.jpg") for k in range(12)] + [(90, "a/missing.jpg"), (91, None)], "id int, image_path string")
    for task_bytes in (1, 1 << 20):
        found = sources.with_stored_bytes(products, files, task_bytes=task_bytes)
        assert found.columns == ["id", "image_path", "image_data"]
        assert {r.id: r.image_data and bytes(r.image_data) for r in found.collect()} == {**{k: b"x" * (k % 5) or None for k in range(12)}, 90: None, 91: None}


def _points(spark, rows):
    return spark.createDataFrame(rows, "point_id bigint, vector array<float>, sub string, place int").select(
        "point_id", "vector", F.struct(F.col("sub").alias("sub_id")).alias("payload"), "place")


def test_index_is_checked_before_it_is_written(spark, tmp_path):
    path = str(tmp_path / "index")
    vector_index.ensure_index(spark, path, "i", 1)
    vector_index.publish(_points(spark, [(1, [1.0], "a", 0), (2, [2.0], "b", 0)]), path, 0)
    for rows, problem in (([(2, [3.0], "other", 0)], "stands for"), ([(3, [3.0], "x", 0), (3, [3.0], "y", 1)], "stands for"),
                          ([(4, [1.0], "d", 1), (4, [2.0], "d", 2)], "without an order")):
        with pytest.raises(Exception, match=problem):
            vector_index.publish(_points(spark, rows), path, 1)
    # What was refused left nothing behind, so the index goes on.
    vector_index.publish(_points(spark, [(4, [1.0], "d", 1), (4, [2.0], "d", 2), (2, [9.0], "b", 0)]).repartition(3), path, 1, order=["place"])
    vector_index.publish(_points(spark, []), path, 2)
    assert {r.point_id: r.vector[0] for r in vector_index.read_points(spark, path).collect()} == {1: 1.0, 2: 9.0, 4: 2.0}
    assert vector_index.newest_batch(spark, path) == 1


def test_publishing_and_compaction_read_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    vector_index.ensure_index(spark, path, "i", 1, buckets=64)
    vector_index.publish(_points(spark, [(k, [float(k)], str(k), 0) for k in range(600)]), path, 0)
    assert len(vector_index.compact(spark, path)) > 50 and not (tmp_path / "index/points/batch=0").exists()
    later = _points(spark, [(k, [float(-k)], str(k), 0) for k in (5, 6, 1000)])
    vector_index.publish(later, path, 1)
    touched = {int(p.name.split("=")[1]) for p in (tmp_path / "index/points/batch=1").glob("bucket=*")}
    assert len(touched) == 3
    read = vector_index.rows(spark, path, sorted(touched))
    seen = {r.f.rsplit("bucket=", 1)[1].split("/")[0] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert seen == set(map(str, touched)) and "PartitionFilters: [bucket" in read._jdf.queryExecution().executedPlan().toString()
    untouched = sorted(p for p in (tmp_path / "index/base/fold=0").glob("bucket=*") if int(p.name.split("=")[1]) not in touched)
    assert vector_index.compact(spark, path) == sorted(touched) and vector_index.compact(spark, path) == []
    vector_index.publish(later, path, 1)  # a replay, behind the compaction
    assert sorted(p for p in (tmp_path / "index/base/fold=0").glob("bucket=*")) == untouched
    found = {r.point_id: r.vector[0] for r in vector_index.read_points(spark, path).collect()}
    assert found == {**{k: float(k) for k in range(600)}, 5: -5.0, 6: -6.0, 1000: -1000.0}


def test_changes_need_an_order_of_their_own(spark, tmp_path):
    changes = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, None, 1)], "k int, s string, at int")
    for n, parts in enumerate((1, 3)):
        tables.log_changes(changes.repartition(parts), str(tmp_path / f"ordered{n}"), 0, order=["at"])
        assert {r.k: r.s for r in tables.current(spark, str(tmp_path / f"ordered{n}"), ["k"]).collect()} == {1: "c", 2: None}
    tables.log_changes(changes, str(tmp_path / "plain"), 0)
    with pytest.raises(ValueError, match="without an order"):
        tables.current(spark, str(tmp_path / "plain"), ["k"])
    assert tables.current(spark, str(tmp_path / "plain"), ["k"], version=["at"]).count() == 2


def test_batches_keep_their_index_version(spark, tmp_path):
    from shelfspark.streaming import checkout as stream

    index, out = str(tmp_path / "i"), str(tmp_path / "o")
    vector_index.ensure_index(spark, index, "i", 1)
    for batch in range(2):
        vector_index.publish(_points(spark, [(batch, [1.0], str(batch), 0)]), index, batch)
        assert vector_index.publish_packed(spark, index) == batch
        assert [stream._version(spark, index, out, k) for k in range(batch + 1)] == list(range(batch + 1))


def test_collection_updates_waiting_documents(spark, tmp_path):
    write_documents(tmp_path / "d", a={"id": 1, "name": " A ", "price": "x"}, b={"id": 2, "name": "B"}, c={"id": 1, "name": "copy"})
    incoming = documents.read_products(spark, str(tmp_path / "d"))
    stored = spark.createDataFrame([("b.json", None, "old"), ("z.json", "p", "Z")], "source_file string, image_path string, name string")
    files = spark.createDataFrame([("a.png",), ("b.jpeg",)], "file_name string")
    found = collection.collect(incoming, stored, files).select("source_file", "image_path", "name", "price").orderBy("source_file").collect()
    assert [tuple(r) for r in found] == [("a.json", "products-images/a.jpg", "A", 0.0), ("b.json", "products-images/b.jpg", "B", None), ("z.json", "p", "Z", None)]


def test_stages(spark, tmp_path):
    picture = np.full((4, 4), 40, np.uint8)
    rasters = table(spark, {"bucket/a.jpg": picture, "bucket/b.jpg": (-1, -1, -1, bytearray(b"x"))}).withColumnRenamed("image_id", "path")
    products = spark.createDataFrame([("1", "s1", "n", "2.5", "bucket/a.jpg"), ("2", "s2", "n", "3", "bucket/b.jpg"), ("3", "s3", "n", "1", "bucket/none.jpg"), ("4", None, "n", "1", "bucket/a.jpg")],
                                     "product_id string, sku string, name string, price string, image_path string")

    def left_half(df):
        return df.withColumn("foreground", F.lit(bytearray([1, 1, 0, 0] * 4)))

    for _ in range(2):
        run = preprocessing.run_stages(products, rasters, left_half, str(tmp_path / "out"), "r1")
    assert run.rows == {"clean": 2, "integrate": 2, "transform": 2}
    rows = {r.product_id: r for r in run.last.collect()}
    assert rows["1"].pipeline_state.asDict() == {"cleaning_state": "SUCCESS", "integrate_state": "SUCCESS", "transform_state": "SUCCESS"}
    assert rows["2"].pipeline_state.cleaning_state == "FAILED_DECODE" and rows["2"].data == b"x"
    assert rows["1"].clean_path == "s3://products/preprocessing/clean/1.jpg" and rows["1"].transform_path.endswith("transform/1.jpg")
    assert rows["1"].data == bytes([40, 40, 255, 255] * 4)
    assert spark.read.parquet(run.metadata["integrate"]).count() == 2
    strict = preprocessing.run_stages(products, rasters, left_half, str(tmp_path / "strict"), "r1", only_success=True)
    assert strict.rows["transform"] == 1


def detector():
    return lambda images: [[{"bbox": [0, 0, 2, 4], "confidence": 0.9, "class_id": 0}, {"bbox": [2, 0, 4, 4], "confidence": 0.8, "class_id": 0}]
                           if image.max() > 20 else [] for image in images]


def embedder():
    return lambda images: [[float(image[0, 0, 0]), 255.0 - float(image[0, 0, 0])] for image in images]


def test_index_and_checkout(spark, tmp_path):
    pictures = table(spark, {"p": np.full((4, 4), 250, np.uint8), "q": np.full((4, 4), 30, np.uint8), "dark": np.zeros((4, 4), np.uint8)})
    products = pictures.withColumns({"product_id": F.col("image_id"), "sku": F.col("image_id"), "name": F.upper("image_id"), "price": F.lit("2.5"), "platform": F.lit("x"), "image_path": F.lit("b/i")})
    out = str(tmp_path / "out")
    for _ in range(2):
        assert indexing.build_index(products, detector, embedder, out, "objects", "r1", 0) == 2
    published = vector_index.read_points(spark, f"{out}/index/objects")
    assert published.count() == 2
    assert spark.read.parquet(f"{out}/crops").count() == 2 and spark.read.parquet(f"{out}/metadata/objects").count() == 2
    assert indexing.build_index(products.filter("image_id = 'dark'"), detector, embedder, str(tmp_path / "none"), "objects", "r1", 0) == 0

    basket = np.concatenate([np.full((4, 2), 250), np.full((4, 2), 30)], axis=1).astype(np.uint8)
    baskets = table(spark, {"one": basket, "nothing": np.zeros((4, 4), np.uint8)}).withColumn("cart_id", F.when(F.col("image_id") == "one", 1).otherwise(2).cast("bigint"))
    payload = published.select("point_id", "payload.*")
    items, carts = checkout.checkout(baskets, published, payload, detector, embedder, str(tmp_path / "vectors"))
    assert sorted(r.name for r in items.collect()) == ["P", "Q"]
    assert {r.cart_id: (r.n_detections, r.n_items, r.total_price) for r in carts.collect()} == {1: (2, 2, 5.0), 2: (0, 0, 0.0)}


def file_stream(spark, df, folder, files):
    df.repartitionByRange(files, df.columns[0]).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ingestion_takes_only_unseen_files(spark, tmp_path):
    feed_dir, log, checkpoint = (str(tmp_path / n) for n in ("feed", "log", "cp"))
    first = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, s string")
    ingest(file_stream(spark, first, feed_dir, 3), log, checkpoint).awaitTermination()
    before = spark.read.parquet(log).select(F.max("batch")).first()[0]
    later = spark.createDataFrame([(5, "new"), (99, "z")], "k int, s string")
    later.coalesce(1).write.mode("append").parquet(feed_dir)
    ingest(spark.readStream.schema(first.schema).parquet(feed_dir), log, checkpoint).awaitTermination()
    assert spark.read.parquet(log).filter(F.col("batch") > before).count() == 2
    state = {r.k: r.s for r in tables.current(spark, log, ["k"]).collect()}
    assert len(state) == 21 and state[5] == "new" and state[4] == "v4"


def test_distinct_feed(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 4) for i in range(40)], "i int, k int")
    out = distinct_stream(file_stream(spark, rows, str(tmp_path / "f"), 2), ["k"])
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 1, 2, 3]


def test_baskets_spread_over_batches(spark, tmp_path):
    index = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "point_id bigint, vector array<float>")
    payload = spark.createDataFrame([(0, "A", 2.0, "s", "p"), (1, "B", 3.0, "t", "p")], "point_id bigint, name string, price double, sku string, platform string")
    asked = spark.createDataFrame([(q, 1, [1.0, 0.1] if q < 2 else [0.1, 1.0]) for q in range(4)] + [(9, 2, [-1.0, -1.0])], "query_id bigint, cart_id bigint, vector array<float>")
    feed = file_stream(spark, asked, str(tmp_path / "f"), 3)
    with pytest.raises(Exception, match="no packed version"):
        checkout_stream(feed, str(tmp_path / "i"), payload, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    vector_index.ensure_index(spark, str(tmp_path / "i"), "i", 2)
    vector_index.publish(index.withColumn("payload", F.struct(F.col("point_id").cast("string").alias("sub_id"))), str(tmp_path / "i"), 0)
    assert vector_index.publish_packed(spark, str(tmp_path / "i")) == vector_index.publish_packed(spark, str(tmp_path / "i")) == 0
    checkout_stream(feed, str(tmp_path / "i"), payload, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    carts = {r.cart_id: (r.n_items, r.total_price) for r in read_carts(spark, str(tmp_path / "o")).collect()}
    assert carts == {1: (4, 10.0), 2: (0, 0.0)}
    assert read_items(spark, str(tmp_path / "o")).count() == 4


def test_quota_over_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(60)], "product_id int, leaf string")
    targets = spark.createDataFrame([("hot", 25), ("cold", 100)], "leaf string, target int")
    quota_stream(file_stream(spark, rows, str(tmp_path / "f"), 4), targets, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert {r.leaf: r["count"] for r in spark.read.parquet(str(tmp_path / "o")).groupBy("leaf").count().collect()} == {"hot": 25, "cold": 20}


def test_quotas_read_counts_not_rows(spark, tmp_path):
    """The third batch gives what it must although the rows of the first are gone; a product seen before and rows without a leaf do not count."""
    targets = spark.createDataFrame([("hot", 25), ("none", 0)], "leaf string, target int")
    feed, out, checkpoint = (str(tmp_path / name) for name in ("f", "o", "c"))
    accepted = []
    for batch in range(3):
        rows = [(i, "hot") for i in range(10 * batch, 10 * batch + 10)] + [(0, "hot"), (batch, None), (batch, "none"), (batch, "unlisted")]
        spark.createDataFrame(rows, "product_id int, leaf string").write.mode("append").parquet(feed)
        quota_stream(spark.readStream.schema("product_id int, leaf string").parquet(feed), targets, out, checkpoint).awaitTermination()
        taken = spark.read.parquet(f"{out}/batch={batch}").collect()
        accepted.append(sorted(r.product_id for r in taken if r.leaf == "hot"))
        assert {r.leaf for r in taken} == {"hot", "unlisted"}
        if batch == 1:
            tables.delete(spark, f"{out}/batch=0")
            assert tables.children(spark, f"{checkpoint}-held") == ["batch=0", "batch=1"]
    assert accepted == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert tables.children(spark, f"{checkpoint}-held") == ["batch=1", "batch=2"]
    held = spark.read.parquet(f"{checkpoint}-held/batch=2").collect()
    assert {r.leaf: r.held for r in held} == {"hot": 25, "unlisted": 3}


def test_first_rows_by_event_time(spark, tmp_path):
    """The first row is that of the least time though it came second; what was sent is forgotten; late rows and rows without a time are left out."""
    feed, out, checkpoint = (str(tmp_path / name) for name in ("f", "o", "c"))
    schema = "k string, at timestamp, v int"
    held = []
    for rows in ([("a", "2024-01-01 10:30:00", 1), (None, "2024-01-01 10:00:00", 2), ("a", None, 3)],
                 [("a", "2024-01-01 10:00:00", 4), ("a", "2024-01-01 10:00:00", 5), ("b", "2024-01-01 20:00:00", 6)],
                 [("a", "2024-01-01 09:45:00", 7), ("a", "2024-01-01 23:00:00", 8), ("z", "2024-01-03 00:00:00", 9)]):
        spark.createDataFrame(rows, "k string, at string, v int").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(feed)
        stream = distinct_stream(spark.readStream.schema(schema).parquet(feed), ["k"], "at")
        assert stream.columns == ["k", "at", "v"]
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress.stateOperators[0].numRowsTotal)
    found = sorted((r.k or "", f"{r['at']:%H:%M}", r.v) for r in spark.read.parquet(out).collect())
    assert found == [("", "10:00", 2), ("a", "10:00", 4), ("a", "23:00", 8), ("b", "20:00", 6)]
    assert held[-1] == 1  # the youngest group only


def test_reports_of_batches(spark, tmp_path):
    feed, log, checkpoint, report = (str(tmp_path / name) for name in ("f", "l", "c", "r"))
    for n in (4, 6):
        spark.range(n).write.mode("append").parquet(feed)
        ingest(spark.readStream.schema("id bigint").parquet(feed), log, checkpoint, lambda batch: batch.filter("id > 2"), report).awaitTermination()
    assert sorted(tuple(r) for r in read_report(spark, report).select("batch", "scanned", "collected", "skipped").collect()) == [(0, 4, 1, 3), (1, 6, 3, 3)]


def test_folders_are_read_once(spark, tmp_path):
    """A second run opens new and rewritten files only, a repeated run the same again; files that are no documents are not tried again."""
    from shelfspark.sources import file_ledger
    folder, out = tmp_path / "d", str(tmp_path / "o")

    def waiting(run):
        return sorted(r.file_name for r in file_ledger.pending(file_ledger.listed(spark, str(folder)), f"{out}/ledger", run).collect())

    write_documents(folder, a={"id": 1}, b="{broken", c={"id": 3, "name": "old"}, e="")
    (folder / "f.txt").write_text("{}")
    (folder / "deeper").mkdir()
    (folder / "deeper" / "g.json").write_text("{}")
    assert waiting(0) == ["a.json", "b.json", "c.json"]
    collection.ingest_folder(spark, str(folder), out, 0)
    assert waiting(1) == []
    collection.ingest_folder(spark, str(folder), out, 1)
    write_documents(folder, c={"id": 3, "name": "renamed"}, h={"id": 8, "name": "\u00ca"})
    assert waiting(2) == ["c.json", "h.json"]
    for _ in range(2):
        collection.ingest_folder(spark, str(folder), out, 2)
        assert waiting(2) == ["c.json", "h.json"] and waiting(3) == []
    found = collection.folder_documents(spark, out).orderBy("source_file").collect()
    assert [(r.source_file, r.id, r.name) for r in found] == [("a.json", "1", None), ("c.json", "3", "renamed"), ("h.json", "8", "\u00ca")]
    report = collection.folder_report(spark, out).orderBy("run").select("run", "scanned", "collected", "skipped", "broken").collect()
    assert [tuple(r) for r in report] == [(0, 3, 2, 0, 1), (1, 3, 0, 3, 0), (2, 4, 2, 2, 0)]


def test_small_files_share_tasks(spark, tmp_path):
    from shelfspark.sources import file_ledger
    write_documents(tmp_path / "d", **{f"f{i}": {"id": i} for i in range(40)})
    files = file_ledger.listed(spark, str(tmp_path / "d"))
    assert file_ledger.texts(files, task_bytes=48 << 20).select(F.spark_partition_id()).distinct().count() == 4
    assert file_ledger.texts(files).select("source_file").distinct().count() == 40
    assert file_ledger.texts(files.limit(0)).count() == 0


def test_very_many_small_files_ask_for_few_tasks(spark, tmp_path, monkeypatch):
    """Rows of one partition are written by several tasks; listings have a bounded number of them, reads one for many hundred files."""
    from shelfspark.sinks.files import write_files
    from shelfspark.sources import file_ledger, images as sources
    rows = spark.range(60).selectExpr("concat(id, '.json') AS name", "'{}' AS content").coalesce(1)
    spark.sparkContext.setJobGroup("written", "")
    assert write_files(rows, str(tmp_path / "d"), "name", "content") == 60
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("", "")
    stages = [tracker.getStageInfo(stage) for job in tracker.getJobIdsForGroup("written") for stage in tracker.getJobInfo(job).stageIds]
    assert max(stage.numTasks for stage in stages if stage) >= 4
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a task, as Spark would have it
    try:
        for module, name in ((file_ledger, "LISTING_TASKS"), (sources, "LISTING_TASKS"), (sources, "CONTENT_TASKS")):
            monkeypatch.setattr(module, name, 3)
        for found in (file_ledger.listed(spark, str(tmp_path / "d")), sources.manifest(spark, str(tmp_path / "d")), sources.read_content(spark, str(tmp_path / "d"))):
            assert found.withColumn("p", F.spark_partition_id()).agg(F.count("p"), F.countDistinct("p")).first() == (60, 3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files = file_ledger.listed(spark, str(tmp_path / "d")).crossJoin(spark.range(20).select())
    assert file_ledger.texts(files).select(F.spark_partition_id()).distinct().count() == 3
    # Empty or tiny files are no reason to read a million of them in one task.
    wanted = spark.range(60).selectExpr("concat('d/', id, '.json') AS image_path")
    stored = sources.with_stored_bytes(wanted, sources.manifest(spark, str(tmp_path)), open_bytes=64 << 20)
    assert stored.withColumn("p", F.spark_partition_id()).filter("image_data = cast('{}' AS binary)").agg(F.count("p"), F.countDistinct("p") > 4).first() == (60, True)


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """Spark's own file source lists on the driver, which holds each file; tasks list the same files, at any depth and of any name."""
    from shelfspark.sources import file_ledger, images as sources
    folder = tmp_path / "d"
    names = ["a.json", "b c.json", "100%25.json", "x#y.json", "\u00ca.json", "k=1.json", "_k=2.json", "_hidden.json", ".dot.json", "c._COPYING_", "n\nl.json", "t.txt", "empty.json"]
    for place in (folder, folder / "deep", folder / "deep/er d", folder / "_temporary"):
        place.mkdir()
        for name in names:
            (place / name).write_text("" if name == "empty.json" else f"{place.name}/{name}")
    (folder / "gone.json").symlink_to(folder / "nothing")
    (folder / "link.json").symlink_to(folder / "a.json")

    def own(path, recursive):
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,bin}").option("recursiveFileLookup", recursive).load(path)

    files = file_ledger.listed(spark, f"{folder}", "*.{json,bin}")
    assert "binaryfile" not in files._jdf.queryExecution().toString().lower()
    held = sorted(tuple(r) for r in files.select("uri", "length", "modified").collect())
    assert held == sorted(tuple(r) for r in own(f"{folder}", False).select("path", "length", "modificationTime").collect()) and len(held) == 9
    assert {r.uri.rsplit("/", 1)[1] for r in files.collect()} == {r.file_name for r in files.collect()}
    assert file_ledger.listed(spark, f"{folder}/deep*", "a*").count() == file_ledger.listed(spark, f"{folder}/a.js*").count() == 1
    content = sources.read_content(spark, str(folder), "*.{json,bin}")
    assert "binaryfile" not in content._jdf.queryExecution().toString().lower()
    root = f"file:{folder}/"
    read = sorted((r.path, bytes(r.content)) for r in content.collect())
    assert read == sorted((r.path.removeprefix(root), bytes(r.content)) for r in own(str(folder), True).collect()) and len(read) == 25
    for missing in (folder / "none", folder / "none*"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            file_ledger.listed(spark, str(missing))


def test_contents_are_not_broadcast(spark, tmp_path):
    """A listing is short where its files are few, whatever their size."""
    from shelfspark.sources import images as sources
    (tmp_path / "a.jpg").write_bytes(b"A")
    joined = sources.with_image_bytes(spark.range(2).selectExpr("concat(id, '.jpg') AS image_path"), sources.read_content(spark, str(tmp_path)))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2


def test_keyed_tables_touch_their_buckets_only(spark, tmp_path):
    """A run neither reads nor writes buckets its keys do not fall into, a lost or repeated run changes nothing, new columns are added."""
    from shelfspark.sinks import keyed_table
    path = str(tmp_path / "t")

    def rows():
        found = keyed_table.read(spark, path)
        names = [c for c in ("k", "a", "b") if c in found.columns]
        return sorted(tuple(r) for r in found.select(*names).collect())

    keyed_table.create(spark, path, ["k"], 16)
    keyed_table.create(spark, path, ["k"], 99)  # it stays as it was laid down
    assert keyed_table.read(spark, path) is None
    assert keyed_table.merge(spark.range(200).selectExpr("id AS k", "id AS a"), path, 0) == list(range(16))
    change = spark.createDataFrame([(7, None, "x"), (500, 1, None)], "k long, a long, b string")
    touched = keyed_table.merge(change, path, 1)
    assert len(touched) <= 2 and tables.children(spark, f"{path}/rows/run=1") == [f"bucket={b}" for b in sorted(touched, key=str)]
    tables.delete(spark, f"{path}/rows/run=0/bucket={min(set(range(16)) - set(touched))}")
    wanted = {r[0]: r for r in rows()}
    assert wanted[7] == (7, 7, "x") and wanted[500] == (500, 1, None)
    assert keyed_table.merge(change, path, 1) == touched and {r[0]: r for r in rows()} == wanted  # the deleted bucket is not needed
    tables.delete(spark, f"{path}/rows/run=1/_SUCCESS")
    assert 500 not in {r[0] for r in rows()}  # a run that is not whole is not read
    keyed_table.merge(change, path, 1)
    later = spark.createDataFrame([(7, 1, 70), (7, 2, None)], "k long, n int, a long")
    keyed_table.merge(later, path, 2, version=["n"])
    assert {r[0]: r for r in rows()} == wanted | {7: (7, 70, "x")}
    assert keyed_table.vacuum(spark, path) == len(touched) + 1 and {r[0]: r for r in rows()} == wanted | {7: (7, 70, "x")}
    for bad in (later, spark.createDataFrame([(None, 1)], "k long, a long")):
        with pytest.raises(Exception, match="without (an order|a key)"):
            keyed_table.merge(bad, path, 3)
    assert {r[0] for r in rows()} == set(wanted)
    assert keyed_table.merge(change.limit(0), path, 4) == [] and {r[0] for r in rows()} == set(wanted)


def test_insertions_read_keys_of_their_buckets(spark, tmp_path):
    from shelfspark.sinks import keyed_table
    path = str(tmp_path / "t")
    keyed_table.create(spark, path, ["k"], 16, merged=False)
    keyed_table.insert(spark.range(100).selectExpr("id AS k", "'old' AS v"), path, 0)
    new = spark.createDataFrame([(5, "b"), (300, "b"), (300, "a")], "k long, v string")
    for _ in range(2):
        touched = keyed_table.insert(new, path, 1, order=["v"])
    assert len(touched) <= 2
    plan = keyed_table.read(spark, path, before=1, only=touched).select("k")
    assert {f.split("bucket=")[1].split("/")[0] for f in plan.inputFiles()} == {str(b) for b in touched}
    found = {r.k: (r.v, r.run) for r in keyed_table.read(spark, path).collect()}
    assert len(found) == 101 and found[300] == ("a", 1) and found[5] == ("old", 0)
    assert keyed_table.read(spark, path).count() == 101 and keyed_table.vacuum(spark, path) == 0
