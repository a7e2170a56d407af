"""Queries over product metadata: cleaning, schema, paths, dedupe, matching, upserts, reports, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfspark.functions import ids, text
from shelfspark.operators import clean, dedupe, integrate, matching, ranking, reports, upsert
from shelfspark.operators.images import decode_mask
from shelfspark.plans.collection import collect, folder_documents as taken_documents, folder_report as taken_report, ingest_folder
from shelfspark.session import materialize, scratch_path
from shelfspark.sinks import keyed_table, tables
from shelfspark.sinks.files import write_files
from shelfspark.sources import documents, images as image_sources, pages
from shelfspark.sources.dimensions import ROOT_CATEGORIES, root_categories
from shelfspark.suite.adapters import cte, image_files, pages_ld, table, view

NUMBER = "try_cast(price AS double)"


def clean_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    return clean.required_fields(view(spark, sf, "products")).select("product_id", "sku", "title", "name", "price", "image_path")


def missing_identity(spark, sf):
    return clean.has_identity(view(spark, sf, "products")).select("product_id", "sku", "image_path")


def kept_columns(spark, sf):
    return clean.keep_columns(view(spark, sf, "products"), ["_id", "product_id", "sku", "name", "image_path"])


def canonical_products(spark, sf):
    return integrate.canonical(view(spark, sf, "products"))


def strip_and_price_default(spark, sf):
    return clean.normalize_values(view(spark, sf, "products_padded"))


def strip_and_price_drop(spark, sf):
    return clean.normalize_values(view(spark, sf, "products_padded"), on_null_price="drop")


def dedupe_identifier(spark, sf):
    return dedupe.first_per_identifier(dedupe.with_identifier(view(spark, sf, "identifiers"))).select("doc_id", "identifier", "source_file")


def distinct_identifiers(spark, sf):
    named = dedupe.with_identifier(view(spark, sf, "identifiers"))
    return named.agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("identifier").alias("n_identifiers"),
                     F.count_if(F.col("identifier").isNull()).alias("n_unidentified"))


def path_normalize(spark, sf):
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("s3://"), "image_path")).otherwise(F.col("image_path"))
    parts = text.split_bucket(F.col("path"))
    return view(spark, sf, "products").withColumn("path", path).select(
        "product_id", text.normalize_path(F.col("path")).alias("normal"), parts["bucket"].alias("bucket"),
        parts["object_name"].alias("object_name"), text.base_name(parts["object_name"]).alias("base"),
        text.extension(parts["object_name"]).alias("ext"), text.jpg_name(F.col("source_file")).alias("jpg"))


def full_image_path(spark, sf):
    located = view(spark, sf, "products").withColumn("storage_refs", F.struct(F.lit("bronze_v2").alias("bucket")))
    return integrate.with_image_location(located).select("product_id", "full_image_path", "image_type")


def image_match_extension(spark, sf):
    return matching.match_images(view(spark, sf, "products"), image_files(spark, sf)).select("product_id", "source_file", "image_file")


def _statuses(spark, sf):
    checkpoint = documents.checkpoint_of(view(spark, sf, "checkpoint"))
    return matching.ingest_status(view(spark, sf, "products").drop("image_path"), checkpoint, image_files(spark, sf))


def ingest_status(spark, sf):
    return _statuses(spark, sf).select("source_file", "image_file", "status")


def ingest_status_repeats(spark, sf):
    """Every stored file twice in the checkpoint, once without its image."""
    stored = view(spark, sf, "checkpoint").select("source_file", "image_path")
    checkpoint = stored.unionByName(stored.withColumn("image_path", F.lit(None).cast("string")))
    return matching.ingest_status(view(spark, sf, "products").drop("image_path"), checkpoint, image_files(spark, sf)).select("source_file", "image_file", "status")


def ingest_report(spark, sf):
    return reports.ingest_report(_statuses(spark, sf))


def checkpoint_scan(spark, sf):
    return documents.checkpoint_of(view(spark, sf, "checkpoint"))


def stage_paths(spark, sf):
    products = view(spark, sf, "products")
    uid = ids.upload_id(products.drop("product_id"))
    return products.select("product_id", *[
        text.s3_path("products", text.stage_object_name(step, uid)).alias(f"{step}_path")
        for step in ("clean", "integrate", "transform")])


def crop_paths(spark, sf):
    products = view(spark, sf, "image_products")
    sub = ids.sub_id(ids.original_id(products), F.lit(0))
    return products.select("product_id", text.s3_path("products", text.crop_object_name(ids.sku_or_product(products), sub)).alias("object_path"))


def join_paths(spark, sf):
    docs = view(spark, sf, "identifiers").select("doc_id", F.nullif("id", F.lit("")).alias("product_id"))
    stored = docs.select("product_id", F.concat(F.lit("s3://products/clean/"), F.col("doc_id").cast("string")).alias("clean_path"))
    return matching.join_paths(docs, stored, "clean_path")


def bytes_by_path(spark, sf):
    """Files stored under the image paths of all products, some of them wanted by two products; the content is the product's own text."""
    products, folder = view(spark, sf, "products"), scratch_path(spark, "images")
    write_files(products.withColumn("content", F.coalesce("name", "title", "platform")), folder, "image_path", "content")
    asked = products.withColumn("image_path", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("products-images/"), (F.col("p_partkey") - 1).cast("string"), F.lit(".jpg")))
                                .otherwise(F.concat(F.lit("s3://"), "image_path")))
    joined = image_sources.with_stored_bytes(asked, image_sources.manifest(spark, folder))
    return joined.select("product_id", F.octet_length("image_data").cast("bigint").alias("n_bytes"), F.md5("image_data").alias("digest"))


def content_scan(spark, sf):
    """Contents of all files of a folder by path, joined to the products."""
    products, folder = view(spark, sf, "products"), scratch_path(spark, "images")
    write_files(products.withColumn("content", F.coalesce("name", "title", "platform")), folder, "image_path", "content")
    joined = image_sources.with_image_bytes(products, image_sources.read_content(spark, folder, "*.jpg"))
    return joined.select("product_id", F.octet_length("image_data").cast("bigint").alias("n_bytes"), F.md5("image_data").alias("digest"))


def cleaned_rows(spark, sf):
    """Rows with bytes, and their metadata cleaned under another name of the path column."""
    products = view(spark, sf, "products").withColumns({"data": F.when(F.col("p_partkey") % 4 != 0, F.encode("platform", "UTF-8")), "photo": F.col("image_path")})
    return clean.clean_stage(clean.with_bytes(products.drop("image_path"), "data"), "photo").select("product_id", "image_path", "photo")


def rooted_orders(spark, sf):
    """Orders of each root category, by the order's priority and a number of its key."""
    roots = root_categories(spark).withColumn("place", F.row_number().over(Window.orderBy("root")) - 1)
    orders = table(spark, sf, "orders").withColumn("place", F.col("o_orderkey") % 15)
    return orders.join(roots, "place").groupBy("root", "root_name").agg(F.count(F.lit(1)).alias("n_orders"))


def byte_fallback(spark, sf):
    """Bytes in the row for some, at the transformed path for others, at the image path for the rest."""
    products = view(spark, sf, "products").withColumns({
        "image_data": F.when(F.col("p_partkey") % 4 == 0, F.encode("platform", "UTF-8")),
        "transform_path": F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("s3://products/t-"), F.col("product_id")))})
    content = (products.filter("image_path IS NOT NULL").select(F.col("image_path").alias("path"), F.encode("source_file", "UTF-8").alias("content"))
               .unionByName(products.filter("transform_path IS NOT NULL").select(F.col("transform_path").alias("path"), F.encode("product_id", "UTF-8").alias("content"))))
    return image_sources.with_any_bytes(products.select("product_id", "image_data", "transform_path", "image_path"), content).select(
        "product_id", F.decode("image_data", "UTF-8").alias("content"))


def _old_new_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority", "o_orderdate")
    base = orders.filter("o_orderdate < '1999-01-01'").drop("o_orderdate")
    new = orders.filter("o_orderdate >= '1997-01-01'").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.lit("N")).alias("o_orderstatus"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.round(F.col("o_totalprice") + 1, 2)).alias("o_totalprice"),
        F.lit("batch-2").alias("loaded_by"))
    return base, new


def upsert_latest(spark, sf):
    base, new = _old_new_orders(spark, sf)
    return upsert.upsert(base, new, ["o_orderkey"])


def upsert_buckets(spark, sf):
    """As the plain upsert, into a stored table in buckets; the second run is repeated, and what it replaced is deleted."""
    base, new = _old_new_orders(spark, sf)
    path = scratch_path(spark, "keyed")
    keyed_table.create(spark, path, ["o_orderkey"], 8)
    for run, changes in ((0, base), (1, new), (1, new)):
        keyed_table.merge(changes, path, run)
    keyed_table.vacuum(spark, path)
    return keyed_table.read(spark, path).drop("run")


def anti_new_rows(spark, sf):
    base, new = _old_new_orders(spark, sf)
    return upsert.absent_from(new, base, ["o_orderkey"])


def semi_reusable(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return upsert.reusable_from(customers, orders.filter("o_orderstatus = 'F'"), ["c_custkey"])


def copy_from_old(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_orderpriority")
    return upsert.copy_from_old(customers, orders.filter("o_orderpriority = '1-URGENT'"), ["c_custkey"], orders.filter("o_orderpriority = '5-LOW'"))


def insert_absent(spark, sf):
    """Two runs into one table, the second one repeated."""
    base, new = _old_new_orders(spark, sf)
    path = scratch_path(spark, "absent")
    tables.insert_absent(base.select("o_orderkey"), path, ["o_orderkey"], "r1")
    for _ in range(2):
        tables.insert_absent(new.select("o_orderkey"), path, ["o_orderkey"], "r2")
    return spark.read.parquet(path).select("o_orderkey", F.col("run_id").cast("string").alias("run_id"))


def insert_buckets(spark, sf):
    """Two runs of insertions into a table in buckets, the second one repeated."""
    base, new = _old_new_orders(spark, sf)
    path = scratch_path(spark, "keyed")
    keyed_table.create(spark, path, ["o_orderkey"], 8, merged=False)
    for run, rows in ((0, base), (1, new), (1, new)):
        keyed_table.insert(rows.select("o_orderkey"), path, run)
    return keyed_table.read(spark, path).select("o_orderkey", F.concat(F.lit("r"), F.col("run") + 1).alias("run_id"))


def stage_append(spark, sf):
    """Metadata of two runs; rerunning one replaces its rows."""
    path = scratch_path(spark, "stages")
    frame = integrate.canonical(view(spark, sf, "products").withColumn("image_data", F.encode("platform", "UTF-8")))
    for run in ("r1", "r2", "r2"):
        stage = tables.append_stage(frame, path, "integrated", run)
    return spark.read.parquet(stage).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("sku").alias("n_skus"), F.round(F.sum("price"), 2).alias("sum_price"))


def insert_absent_order(spark, sf):
    """First event of each user, in two runs of which the second brings other events."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    path = scratch_path(spark, "absent")
    for run, rest in (("r1", 0), ("r2", 1), ("r1", 0)):
        tables.insert_absent(events.filter(F.col("event_id") % 2 == rest), path, ["user_id"], run, order=["event_id"])
    return spark.read.parquet(path).select("user_id", "event_id", "event_type", F.col("run_id").cast("string").alias("run_id"))


def _event_log(spark, sf, label):
    """Events as changes in three batches, many of one user in each."""
    path = scratch_path(spark, label)
    rows = table(spark, sf, "events").select("user_id", F.when(F.col("value") >= 50, F.round("value", 2)).alias("value"), "event_type", F.col("event_id").alias("seq"))
    for batch in range(3):
        tables.log_changes(rows.filter(F.col("seq") % 3 == batch), path, batch)
    return path


def change_log_ties(spark, sf):
    """Newest non-null value of each column: by batch, then by place in it."""
    return tables.current(spark, _event_log(spark, sf, "ties"), ["user_id"])


def change_log_rows(spark, sf):
    """Newest change of each user as a whole row."""
    return upsert.fold_rows(tables.read_changes(spark, _event_log(spark, sf, "rows")), ["user_id"], ["batch", "seq"])


def resume_state(spark, sf):
    """Progress per user saved by two runs, the second one twice, and loaded again."""
    path = scratch_path(spark, "state")
    state = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n_events"))
    tables.save_state(state, path, 0)
    for _ in range(2):
        tables.save_state(state.filter("n_events > 5").select("user_id", F.lit(None).cast("bigint").alias("last_event"), (F.col("n_events") * 2).alias("n_events")), path, 1)
    return tables.load_state(spark, path, ["user_id"])


def enrich_repeats(spark, sf):
    """As the plain query, with every detail and page record repeated under other values."""
    listing, detail, structured = _enriched(spark, sf)
    return matching.enrich(listing, detail.unionByName(detail.withColumn("name", F.lit("zz"))), structured.unionByName(structured.withColumn("ld_json", F.lit("~~"))))


def enrich_merge(spark, sf):
    return matching.enrich(*_enriched(spark, sf))


def _enriched(spark, sf):
    part = table(spark, sf, "part")
    listing = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.round("p_retailprice", 2).alias("price"), F.lit("listing").alias("platform"))
    detail = part.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(" "), "p_name").alias("name"), F.when(F.col("p_size") > 20, F.round("p_retailprice", 2) * 2).alias("price"), F.col("p_size").cast("bigint").alias("size"))
    structured = part.filter("p_size <= 25").select(F.col("p_partkey").alias("id"), F.to_json(F.struct("p_brand")).alias("ld_json"))
    return listing, detail, structured


def enrich_open_fields(spark, sf):
    """Open event properties overlaid by a second record, which some events lack."""
    newer = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.col("user_id").alias("k"), F.col("event_type").alias("kind")))).when(
        F.col("event_type") == "view", F.to_json(F.struct(F.col("user_id").alias("viewer"))))
    merged = matching.merge_open(F.parse_json("props"), F.parse_json(newer))
    return table(spark, sf, "events").select("event_id", F.to_json(merged).alias("merged"))


def product_uuid(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ids.product_uuid(F.col("p_partkey")).alias("product_uuid"))


def product_fingerprint(spark, sf):
    documents_ = view(spark, sf, "products").select("product_id", "sku", "name", "platform", "price")
    return documents_.withColumn("doc", ids.sorted_json(["sku", "name", "product_id", "platform", "price"])).select(
        "product_id", F.md5("doc").alias("etag"), F.octet_length("doc").cast("bigint").alias("size"))


def storage_refs(spark, sf):
    products = view(spark, sf, "products").withColumn("doc", ids.sorted_json(["sku", "name"]))
    name = text.document_object_name("run", F.lit("2024-01-02"), F.col("product_id"))
    return products.withColumn("refs", ids.storage_refs(F.col("doc"), "bronze_v2", name, F.lit("2024-01-02T03:04:05+00:00"))).select("product_id", "refs.*")


def thumbnails(spark, sf):
    url = F.concat(F.lit("https://img.example.com/cache/280x280/"), F.col("product_id"), F.lit(".png"))
    return view(spark, sf, "products").select("product_id", text.large_thumbnail(url).alias("thumbnail_url"))


def stage_states(spark, sf):
    """States of a stage packed in one struct, and their distribution."""
    states = {"cleaning_state": F.when(F.col("image_path").isNull(), "FAILED_EMPTY").when(F.col("price") == "n/a", "FAILED_DECODE").otherwise("SUCCESS"),
              "transform_state": F.when(F.col("sku").isNull(), "FAILED_EXCEPTION").otherwise("SUCCESS")}
    staged = integrate.canonical(view(spark, sf, "products").withColumns(states), carry=["transform_state"])
    packed = integrate.pack_states(staged)
    flat = integrate.unpack_result(packed, "pipeline_state", {"cleaning_state": "cleaning_state", "transform_state": "transform_state"})
    return (integrate.state_counts(flat, "cleaning_state").withColumn("stage", F.lit("clean"))
            .unionByName(integrate.state_counts(flat, "transform_state").withColumn("stage", F.lit("transform"))))


def run_report(spark, sf):
    return reports.outcome_report(view(spark, sf, "event_rows"))


def batch_numbers(spark, sf):
    return ranking.batch_numbers(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 50)


def batch_sizes_64(spark, sf):
    numbered = ranking.batch_numbers(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 64)
    return numbered.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_key"))


def page_structured_data(spark, sf):
    found = pages.with_structured_data(pages_ld(spark, sf))
    return found.select("page_id", "n_found", "n_parsed", F.to_json("ld_json").alias("ld_json"),
                        F.try_variant_get("ld_json", "$.name", "string").alias("single_name"))


def _documents(spark, sf):
    """The products as JSON documents with their file names, some of them broken."""
    products = view(spark, sf, "products").withColumn("id", F.col("p_partkey").cast("string"))
    good = F.to_json(F.struct("id", "sku", "name", "title", "price", "platform"))
    return products.select("source_file", F.when(F.col("p_partkey") % 31 == 0, F.lit('{"id": ')).when(F.col("p_partkey") % 37 == 0, F.lit("[1]")).otherwise(good).alias("value"))


def document_scan(spark, sf):
    parsed = documents.parse_documents(_documents(spark, sf))
    return parsed.filter("body IS NOT NULL").select("source_file", "id", "sku", "name", "title", "price", "platform")


def _document_files(spark, sf):
    """A folder with a file for every supplier, named for its key: documents, broken ones, and texts that are none."""
    path = scratch_path(spark, "files")
    suppliers = table(spark, sf, "supplier")
    good = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).cast("string").alias("price"),
                              F.concat(F.lit("root/N"), "s_nationkey").alias("primary_category_path")))
    ending = F.when(F.col("s_suppkey") % 11 == 5, F.lit(".txt")).otherwise(F.lit(".json"))
    files = suppliers.select(F.concat(F.col("s_suppkey").cast("string"), ending).alias("name"), F.when(F.col("s_suppkey") % 7 == 3, F.lit("{broken")).otherwise(good).alias("value"))
    write_files(files, path, "name", "value")
    return path


def document_files(spark, sf):
    """Files of a folder read as documents."""
    return documents.read_products(spark, _document_files(spark, sf)).select("source_file", "id", "name", "price")


def broken_files(spark, sf):
    """Files whose content is no document."""
    return documents.unreadable_products(spark, _document_files(spark, sf))


def historic_files(spark, sf):
    """Old products and their category, from files; the id is the file's name."""
    return documents.read_historic(spark, _document_files(spark, sf))


def file_listing(spark, sf):
    """Names and lengths of a folder's documents."""
    return documents.list_files(spark, _document_files(spark, sf), "*.json").select("file_name", "length")


def found_files(spark, sf):
    """One file by its name, and one document by a condition."""
    path = _document_files(spark, sf)
    named = documents.find_file(documents.list_files(spark, path), "8.json").select(F.lit("name").alias("asked"), "file_name")
    held = documents.find_one(documents.read_products(spark, path), F.col("id") == "9").select(F.lit("id").alias("asked"), F.col("source_file").alias("file_name"))
    return named.unionByName(held)


def _ingested_folder(spark, sf):
    """Two runs over a folder: files of some customers, then those of the others and some of the first rewritten; the second run is repeated."""
    folder, out = scratch_path(spark, "landed"), scratch_path(spark, "taken")
    customers = table(spark, sf, "customer").withColumn("key", F.col("c_custkey"))
    for run, condition, label in ((0, "key % 3 < 2", "first"), (1, "key % 3 = 2 OR key % 5 = 0", "a second")):
        good = F.to_json(F.struct(F.col("key").cast("string").alias("id"), F.concat(F.lit(f"{label} "), "c_name").alias("name"), F.col("c_mktsegment").alias("platform")))
        files = customers.filter(condition).select(
            F.concat("key", F.lit(".json")).alias("name"), F.when(F.col("key") % 7 == 3, F.lit(f"{label} broken")).otherwise(good).alias("value"))
        write_files(files, folder, "name", "value")
        for _ in range(run + 1):
            ingest_folder(spark, folder, out, run)
    return out


def folder_documents(spark, sf):
    """Newest document of each file of a folder that was read in two runs, and the run that read it."""
    return taken_documents(spark, _ingested_folder(spark, sf)).select("source_file", "id", "name", "platform")


def folder_report(spark, sf):
    """What each of two runs over a folder listed, stored, knew already and could not read."""
    return taken_report(spark, _ingested_folder(spark, sf))


def trial_rows(spark, sf):
    return documents.first_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000)


def spread_collection(spark, sf):
    """A stored collection read back over sixteen partitions, row by row; ``spread`` where each has rows, and none many more than the others."""
    path = scratch_path(spark, "collection")
    table(spark, sf, "customer").write.parquet(path)
    spread = documents.read_collection(spark, path, exclude=("c_acctbal",), partitions=16)
    placed = materialize(spread.withColumn("p", F.spark_partition_id()), "spread")
    held = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    even = held.agg(((F.count(F.lit(1)) == 16) & (F.max("n") * 8 <= F.sum("n"))).alias("spread"))
    return placed.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").crossJoin(F.broadcast(even))


def counted_rows(spark, sf):
    """Rows counted while they are written, beside those that were written."""
    watched, seen = reports.counted(table(spark, sf, "lineitem").filter("l_quantity > 25").select("l_orderkey"), f"counted-{scratch_path(spark, 'n')[-32:]}")
    path = scratch_path(spark, "counted")
    watched.write.parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_stored")).withColumn("n_counted", F.lit(seen.get["rows"]).cast("bigint"))


def run_times(spark, sf):
    stamp = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", ids.utc_iso(stamp).alias("iso"), ids.utc_day(stamp).alias("day"))


def decoded_masks(spark, sf):
    """Masks sent as base64, some of them damaged."""
    sent = F.when(F.col("p_partkey") % 5 == 0, F.lit("no base64!")).otherwise(F.base64(F.encode("p_name", "UTF-8")))
    return table(spark, sf, "part").select("p_partkey", F.hex(decode_mask(sent)).alias("mask"))


def collection_scan(spark, sf):
    """A stored collection read back without its open column."""
    path = scratch_path(spark, "collection")
    view(spark, sf, "products").withColumn("ld_json", F.array(F.lit(1))).write.parquet(path)
    return documents.read_collection(spark, path).select("product_id", "sku", "platform", "price")


def listing_ids(spark, sf):
    listings = view(spark, sf, "identifiers").select("doc_id", "id")
    return documents.with_listing_id(listings)


def collect_products(spark, sf):
    """Documents taken into a collection that holds some of them already."""
    parsed = documents.parse_documents(_documents(spark, sf)).filter("body IS NOT NULL")
    stored = view(spark, sf, "checkpoint").filter("source_file IS NOT NULL").withColumn("stored", F.lit(True))
    return collect(parsed, stored, image_files(spark, sf)).select("source_file", "image_path", "stored", "id", "name", "price")


QUERIES = {f.__name__: f for f in (
    clean_required_fields, missing_identity, kept_columns, canonical_products, strip_and_price_default, strip_and_price_drop,
    dedupe_identifier, distinct_identifiers, path_normalize, full_image_path, image_match_extension, ingest_status,
    ingest_report, checkpoint_scan, stage_paths, crop_paths, join_paths, bytes_by_path, byte_fallback, upsert_latest, upsert_buckets, insert_buckets,
    anti_new_rows, semi_reusable, copy_from_old, document_files, broken_files, historic_files, file_listing, found_files, folder_documents, folder_report, content_scan, cleaned_rows, rooted_orders, trial_rows, spread_collection, counted_rows, run_times, decoded_masks, insert_absent, insert_absent_order, change_log_ties, change_log_rows, resume_state, stage_append, enrich_merge, enrich_repeats, ingest_status_repeats, enrich_open_fields, product_uuid,
    product_fingerprint, storage_refs, thumbnails, stage_states, run_report, batch_numbers, batch_sizes_64,
    page_structured_data, document_scan, collection_scan, listing_ids, collect_products)}

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PADDED = f"""SELECT product_id, {_STRIP.format('name')} AS name, {_STRIP.format('sku')} AS sku,
    CASE WHEN price IS NOT NULL THEN coalesce(try_cast({_STRIP.format('price')} AS double), 0.0) END AS price
    FROM products_padded"""
_MATCH = """matched AS (SELECT p.*, f.file_name AS image_file FROM products p LEFT JOIN (
    SELECT file_name, split_part(file_name, '.', 1) AS base,
           row_number() OVER (PARTITION BY split_part(file_name, '.', 1)
                              ORDER BY list_position(['.jpg', '.jpeg', '.png'], regexp_extract(file_name, '\\.[^.]*$'))) AS rn
    FROM image_files WHERE regexp_extract(file_name, '\\.[^.]*$') IN ('.jpg', '.jpeg', '.png')) f
    ON f.base = p.product_id AND f.rn = 1)"""
_STATUS = """statuses AS (SELECT m.source_file, m.image_file, CASE WHEN c.source_file IS NULL THEN 'new'
    WHEN c.image_path IS NOT NULL THEN 'skip_done' WHEN m.image_file IS NULL THEN 'skip_wait' ELSE 'update' END AS status
    FROM matched m LEFT JOIN (SELECT * FROM checkpoint WHERE source_file IS NOT NULL) c ON c.source_file = m.source_file)"""
_ORDERS = """base AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority
        FROM orders WHERE o_orderdate < '1999-01-01'),
    new AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'N' END AS o_orderstatus,
        CASE WHEN o_orderpriority <> '5-LOW' THEN round(round(o_totalprice, 2) + 1, 2) END AS o_totalprice, 'batch-2' AS loaded_by
        FROM orders WHERE o_orderdate >= '1997-01-01')"""
_UUID = """SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('tiki_', p_partkey))) AS h FROM part"""


def _json_field(name: str) -> str:
    return f"""'"{name}": ' || coalesce('"' || replace({name}, '"', '\\"') || '"', 'null')"""


def _json(*names: str) -> str:
    return "'{' || " + " || ', ' || ".join(_json_field(n) for n in sorted(names)) + " || '}'"


_DOCUMENTS = """docs AS (SELECT * FROM products WHERE p_partkey % 31 <> 0 AND p_partkey % 37 <> 0)"""

ORACLE = {
    "clean_required_fields": cte("products") + """SELECT product_id, sku, title, name, price, image_path FROM products
        WHERE image_path IS NOT NULL AND sku IS NOT NULL AND price IS NOT NULL AND (title IS NOT NULL OR name IS NOT NULL)""",
    "missing_identity": cte("products") + """SELECT product_id, sku, image_path FROM products
        WHERE NOT (product_id IS NULL AND sku IS NULL) AND image_path IS NOT NULL AND image_path <> ''""",
    "kept_columns": cte("products") + "SELECT product_id, sku, name, image_path FROM products",
    "canonical_products": cte("products") + f"""SELECT product_id, platform, sku, coalesce(name, title) AS name,
        {NUMBER} AS price, image_path, 'UNKNOWN' AS cleaning_state, 'SUCCESS' AS integrate_state FROM products""",
    "strip_and_price_default": cte("products_padded") + _PADDED,
    "strip_and_price_drop": cte("products_padded") + _PADDED + " WHERE price IS NOT NULL",
    "dedupe_identifier": cte("identifiers") + """, named AS (SELECT *, coalesce(nullif(id, ''), nullif(product_id, '')) AS identifier FROM identifiers)
        SELECT doc_id, identifier, source_file FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY source_file) AS rn FROM named)
        WHERE identifier IS NULL OR rn = 1""",
    "distinct_identifiers": cte("identifiers") + """SELECT count(*) AS n_records, count(DISTINCT coalesce(nullif(id, ''), product_id)) AS n_identifiers,
        count(*) FILTER (coalesce(nullif(id, ''), product_id) IS NULL) AS n_unidentified FROM identifiers""",
    "path_normalize": cte("products") + """, p AS (SELECT product_id, source_file, CASE WHEN p_partkey % 3 = 0 THEN 's3://' || image_path ELSE image_path END AS path FROM products),
        n AS (SELECT *, replace(path, 's3://', '') AS plain FROM p)
        SELECT product_id, plain AS normal, split_part(plain, '/', 1) AS bucket, substr(plain, strpos(plain, '/') + 1) AS object_name,
               replace(substr(plain, strpos(plain, '/') + 1), '.jpg', '') AS base, right(plain, 4) AS ext, replace(source_file, '.json', '.jpg') AS jpg FROM n""",
    "full_image_path": cte("products") + """SELECT product_id, concat_ws('/', 'bronze_v2', image_path) AS full_image_path,
        'single_object' AS image_type FROM products""",
    "image_match_extension": cte("products", "image_files") + f", {_MATCH} SELECT product_id, source_file, image_file FROM matched",
    "ingest_status": cte("products", "image_files", "checkpoint") + f", {_MATCH}, {_STATUS} SELECT source_file, image_file, status FROM statuses",
    "ingest_report": cte("products", "image_files", "checkpoint") + f""", {_MATCH}, {_STATUS} SELECT count(*) AS scanned,
        count(*) FILTER (status IN ('new', 'update')) AS collected, count(*) FILTER (status LIKE 'skip%') AS skipped FROM statuses""",
    "checkpoint_scan": cte("checkpoint") + "SELECT source_file, image_path FROM checkpoint WHERE source_file IS NOT NULL",
    "stage_paths": cte("products") + """, h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(coalesce(image_path, ''))) AS h FROM products),
        u AS (SELECT product_id, coalesce(sku, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
            translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS uid FROM h)
        SELECT product_id, 's3://products/preprocessing/clean/' || uid || '.jpg' AS clean_path,
               's3://products/preprocessing/integrate/' || uid || '.jpg' AS integrate_path,
               's3://products/preprocessing/transform/' || uid || '.jpg' AS transform_path FROM u""",
    "crop_paths": cte("image_products") + """SELECT product_id, 's3://products/processing/objects/' || coalesce(sku, product_id) || '/' || product_id || '_obj0.jpg' AS object_path
        FROM image_products""",
    "join_paths": cte("identifiers") + """, docs AS (SELECT doc_id, nullif(id, '') AS product_id FROM identifiers),
        stored AS (SELECT product_id, min('s3://products/clean/' || doc_id) AS clean_path FROM docs WHERE product_id IS NOT NULL GROUP BY product_id)
        SELECT doc_id, d.product_id, clean_path FROM docs d LEFT JOIN stored s ON s.product_id = d.product_id""",
    "bytes_by_path": cte("products") + """SELECT p.product_id, strlen(coalesce(q.name, q.title, q.platform))::bigint AS n_bytes, md5(coalesce(q.name, q.title, q.platform)) AS digest
        FROM products p LEFT JOIN products q ON q.image_path IS NOT NULL AND q.p_partkey = CASE WHEN p.p_partkey % 5 = 0 THEN p.p_partkey - 1 ELSE p.p_partkey END""",
    "byte_fallback": cte("products") + """SELECT product_id, CASE WHEN p_partkey % 4 = 0 THEN platform WHEN p_partkey % 3 = 0 THEN product_id ELSE source_file END AS content
        FROM products WHERE p_partkey % 4 = 0 OR p_partkey % 3 = 0 OR image_path IS NOT NULL""",
    "upsert_latest": f"""WITH {_ORDERS} SELECT coalesce(b.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, b.o_orderstatus) AS o_orderstatus,
        coalesce(n.o_totalprice, b.o_totalprice) AS o_totalprice, b.o_orderpriority, n.loaded_by
        FROM base b FULL OUTER JOIN new n ON n.o_orderkey = b.o_orderkey""",
    "anti_new_rows": f"WITH {_ORDERS} SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.o_orderkey = new.o_orderkey)",
    "semi_reusable": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "copy_from_old": """SELECT c_custkey, c_name, c_mktsegment FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "folder_documents": """SELECT concat(c_custkey, '.json') AS source_file, c_custkey::varchar AS id,
        concat(CASE WHEN c_custkey % 3 = 2 OR c_custkey % 5 = 0 THEN 'a second ' ELSE 'first ' END, c_name) AS name, c_mktsegment AS platform
        FROM customer WHERE c_custkey % 7 <> 3""",
    "folder_report": """WITH landed AS (SELECT c_custkey % 7 = 3 AS broken, c_custkey % 3 < 2 AS early, c_custkey % 3 = 2 OR c_custkey % 5 = 0 AS late FROM customer)
        SELECT 0 AS run, count(*) FILTER (early) AS scanned, count(*) FILTER (early AND NOT broken) AS collected, 0 AS skipped, count(*) FILTER (early AND broken) AS broken FROM landed
        UNION ALL SELECT 1, count(*), count(*) FILTER (late AND NOT broken), count(*) FILTER (NOT late), count(*) FILTER (late AND broken) FROM landed""",
    "document_files": """SELECT s_suppkey || '.json' AS source_file, s_suppkey::varchar AS id, s_name AS name, round(s_acctbal, 2)::varchar AS price
        FROM supplier WHERE s_suppkey % 7 <> 3 AND s_suppkey % 11 <> 5""",
    "trial_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000",
    "spread_collection": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, true AS spread FROM customer",
    "broken_files": "SELECT s_suppkey || '.json' AS source_file FROM supplier WHERE s_suppkey % 7 = 3 AND s_suppkey % 11 <> 5",
    "historic_files": "SELECT s_suppkey::varchar AS product_id, 'root/N' || s_nationkey AS primary_category_path FROM supplier WHERE s_suppkey % 7 <> 3 AND s_suppkey % 11 <> 5",
    "file_listing": """SELECT s_suppkey || '.json' AS file_name, strlen(CASE WHEN s_suppkey % 7 = 3 THEN '{broken' ELSE '{"id":' || s_suppkey || ',"name":"' || s_name ||
        '","price":"' || round(s_acctbal, 2)::varchar || '","primary_category_path":"root/N' || s_nationkey || '"}' END)::bigint AS length
        FROM supplier WHERE s_suppkey % 11 <> 5""",
    "found_files": """SELECT 'name' AS asked, s_suppkey || '.json' AS file_name FROM supplier WHERE s_suppkey = 8
        UNION ALL SELECT 'id', s_suppkey || '.json' FROM supplier WHERE s_suppkey = 9""",
    "content_scan": cte("products") + """SELECT product_id, CASE WHEN image_path IS NOT NULL THEN strlen(coalesce(name, title, platform)) END::bigint AS n_bytes,
        CASE WHEN image_path IS NOT NULL THEN md5(coalesce(name, title, platform)) END AS digest FROM products""",
    "cleaned_rows": cte("products") + """SELECT product_id, image_path, image_path AS photo FROM products WHERE p_partkey % 4 <> 0 AND image_path IS NOT NULL AND sku IS NOT NULL
        AND price IS NOT NULL AND (title IS NOT NULL OR name IS NOT NULL)""",
    "rooted_orders": f"""SELECT root, root_name, count(*) AS n_orders FROM orders JOIN (SELECT root, root_name, row_number() OVER (ORDER BY root) - 1 AS place
        FROM (VALUES {", ".join(map(str, ROOT_CATEGORIES))}) t(root, root_name)) ON place = o_orderkey % 15 GROUP BY root, root_name""",
    "counted_rows": "SELECT count(*) AS n_stored, count(*) AS n_counted FROM lineitem WHERE l_quantity > 25",
    "run_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "decoded_masks": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN hex(encode(p_name)) END AS mask FROM part",
    "insert_absent_order": """SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, 'r1' AS run_id FROM events WHERE event_id % 2 = 0 GROUP BY user_id
        UNION ALL SELECT user_id, min(event_id), arg_min(event_type, event_id), 'r2' FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY user_id""",
    "change_log_ties": """SELECT user_id, arg_max(round(value, 2), event_id % 3 * 1000000000 + event_id) FILTER (value >= 50) AS value,
        arg_max(event_type, event_id % 3 * 1000000000 + event_id) AS event_type FROM events GROUP BY user_id""",
    "change_log_rows": """SELECT user_id, CASE WHEN value >= 50 THEN round(value, 2) END AS value, event_type FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "resume_state": "SELECT user_id, max(event_id) AS last_event, CASE WHEN count(*) > 5 THEN 2 * count(*) ELSE count(*) END AS n_events FROM events GROUP BY user_id",
    "insert_absent": f"""WITH {_ORDERS} SELECT o_orderkey, 'r1' AS run_id FROM base
        UNION ALL SELECT o_orderkey, 'r2' FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM base)""",
    "stage_append": cte("products") + f"""SELECT run_id, count(*) AS n_rows, count(sku) AS n_skus, round(sum({NUMBER}), 2) AS sum_price
        FROM products, (SELECT unnest(['r1', 'r2']) AS run_id) GROUP BY run_id""",
    "enrich_merge": """SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN p_brand || ' ' || p_name ELSE p_name END AS name,
        CASE WHEN p_type = 'ECONOMY' AND p_size > 20 THEN round(p_retailprice, 2) * 2 ELSE round(p_retailprice, 2) END AS price,
        'listing' AS platform, CASE WHEN p_type = 'ECONOMY' THEN p_size::bigint END AS size,
        CASE WHEN p_type <> 'ECONOMY' AND p_size <= 25 THEN '{"p_brand":"' || p_brand || '"}' END AS ld_json,
        CASE WHEN p_type = 'ECONOMY' THEN 'api_detail' WHEN p_size <= 25 THEN 'requests_ld_json' ELSE 'listing_only' END AS data_source FROM part""",
    "enrich_open_fields": """SELECT event_id, CASE event_type WHEN 'purchase' THEN '{"k":' || user_id || ',"kind":"purchase"}'
        WHEN 'view' THEN '{"k":' || (props->>'$.k') || ',"viewer":' || user_id || '}' ELSE '{"k":' || (props->>'$.k') || '}' END AS merged FROM events""",
    "product_uuid": f"""SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
        translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS product_uuid FROM ({_UUID})""",
    "product_fingerprint": cte("products") + f"""SELECT product_id, md5(doc) AS etag, strlen(doc)::bigint AS size
        FROM (SELECT product_id, {_json('sku', 'name', 'product_id', 'platform', 'price')} AS doc FROM products)""",
    "storage_refs": cte("products") + f"""SELECT product_id, 'bronze_v2' AS bucket, 'run/2024-01-02/products/' || product_id || '.json' AS object_name,
        strlen(doc)::bigint AS size, md5(doc) AS etag, '2024-01-02T03:04:05+00:00' AS "timestamp"
        FROM (SELECT product_id, {_json('sku', 'name')} AS doc FROM products)""",
    "thumbnails": cte("products") + "SELECT product_id, 'https://img.example.com/cache/w1200/' || product_id || '.png' AS thumbnail_url FROM products",
    "stage_states": cte("products") + """, s AS (SELECT CASE WHEN image_path IS NULL THEN 'FAILED_EMPTY' WHEN price = 'n/a' THEN 'FAILED_DECODE' ELSE 'SUCCESS' END AS c,
            CASE WHEN sku IS NULL THEN 'FAILED_EXCEPTION' ELSE 'SUCCESS' END AS t FROM products)
        SELECT c AS state, count(*) AS n, 'clean' AS stage FROM s GROUP BY c UNION ALL SELECT t, count(*), 'transform' FROM s GROUP BY t""",
    "run_report": cte("event_rows") + """SELECT count(*) FILTER (outcome = 'reused') AS reused, count(*) FILTER (outcome = 'crawled') AS crawled,
        count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped,
        count(*) FILTER (outcome IN ('reused', 'crawled')) AS total FROM event_rows""",
    "batch_numbers": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS batch FROM orders",
    "batch_sizes_64": """SELECT batch, count(*) AS n, min(l_orderkey) AS first_key FROM (SELECT l_orderkey,
        (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 64 AS batch FROM lineitem) GROUP BY batch""",
    "page_structured_data": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::bigint AS n_found,
        CASE page_id % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END::bigint AS n_parsed,
        CASE page_id % 4 WHEN 0 THEN NULL WHEN 2 THEN '[' || good || ',' || good || ']' ELSE good END AS ld_json,
        CASE WHEN page_id % 4 IN (1, 3) THEN 'page ' || page_id END AS single_name FROM (SELECT page_id,
        '{"@type":"Product","name":"page ' || page_id || '","offers":{"price":' || (page_id * 2) || '},"sizes":[1,2,3]}' AS good FROM pages)""",
    "document_scan": cte("products") + f", {_DOCUMENTS} SELECT source_file, product_id AS id, sku, name, title, price, platform FROM docs",
    "collection_scan": cte("products") + "SELECT product_id, sku, platform, price FROM products",
    "listing_ids": cte("identifiers") + "SELECT doc_id, id FROM identifiers WHERE id <> '' AND id <> '0'",
    "collect_products": cte("products", "image_files", "checkpoint") + f""", {_MATCH}, {_STATUS}, {_DOCUMENTS},
        todo AS (SELECT d.*, s.image_file FROM docs d JOIN statuses s ON s.source_file = d.source_file WHERE status IN ('new', 'update')),
        fresh AS (SELECT source_file, CASE WHEN image_file IS NOT NULL THEN 'products-images/' || split_part(image_file, '.', 1) || '.jpg' END AS image_path,
            product_id AS id, name, CASE WHEN price IS NOT NULL THEN coalesce({NUMBER}, 0.0) END AS price FROM todo),
        stored AS (SELECT source_file, image_path, true AS stored FROM checkpoint WHERE source_file IS NOT NULL)
        SELECT coalesce(s.source_file, f.source_file) AS source_file, coalesce(f.image_path, s.image_path) AS image_path, stored, id, name, price
        FROM stored s FULL OUTER JOIN fresh f ON f.source_file = s.source_file""",
}

ORACLE["enrich_repeats"] = ORACLE["enrich_merge"]
ORACLE["ingest_status_repeats"] = ORACLE["ingest_status"]

ORACLE["upsert_buckets"] = ORACLE["upsert_latest"]
ORACLE["insert_buckets"] = ORACLE["insert_absent"]
