"""Several models in one index: registration, publication of all parts or none, backlog, search and preference."""

import pytest
from pyspark.sql import functions as F

from shelfspark.sinks import model_index, vector_index


def _rows(spark, rows):
    return spark.createDataFrame(rows, "model string, point_id bigint, vector array<float>, sub string, place int").select(
        "model", "point_id", "vector", F.struct(F.col("sub").alias("sub_id"), "place").alias("payload"), "place")


ODD = "family/b:32 *é"


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "models")
    model_index.register(spark, path, "wide", 3)
    model_index.register(spark, path, ODD, 2)
    return path


def _held(spark, path, model):
    stored = vector_index.rows(spark, model_index.part_path(path, model))
    return set() if stored is None else {(r.point_id, tuple(r.vector)) for r in vector_index.read_points(spark, model_index.part_path(path, model)).collect()}


def test_models_are_registered_once(spark, tmp_path, path):
    model_index.register(spark, path, "wide", 3)
    assert model_index.models(spark, path) == {"wide": 3, ODD: 2}
    with pytest.raises(ValueError, match="3-dimensional|holds"):
        model_index.register(spark, path, "wide", 4)
    with pytest.raises(ValueError, match="name"):
        model_index.register(spark, path, "", 4)
    with pytest.raises(ValueError, match="no model"):
        model_index.models(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="not registered"):
        model_index.backlog(spark, path, "other")


def test_all_parts_are_published_or_none(spark, path):
    model_index.publish(_rows(spark, [("wide", 1, [1.0, 0.0, 0.0], "a", 0), (ODD, 1, [1.0, 0.0], "a", 0)]), path, 0)
    # The part named first is right each time; the other one, or a row of no part, is not.
    good = (ODD, 2, [0.0, 1.0], "b", 0)
    for bad, problem in ((("wide", 2, [0.0, 1.0], "b", 0), "without 3 dimensions"), (("wide", 1, [0.0, 1.0, 0.0], "other", 0), "stands for"),
                         ((None, 3, [0.0, 1.0], "c", 0), "null is not registered"), (("new", 3, [0.0, 1.0], "c", 0), "new is not registered")):
        with pytest.raises(Exception, match=problem):
            model_index.publish(_rows(spark, [good, bad]), path, 1)
        assert _held(spark, path, ODD) == {(1, (1.0, 0.0))} and _held(spark, path, "wide") == {(1, (1.0, 0.0, 0.0))}
    both = _rows(spark, [good, good[:2] + ([0.0, 5.0], "b", 1), ("wide", 2, [0.0, 1.0, 0.0], "b", 0)])
    for _ in range(2):
        model_index.publish(both.repartition(3), path, 1, order=["place"])
    assert _held(spark, path, ODD) == {(1, (1.0, 0.0)), (2, (0.0, 5.0))} and len(_held(spark, path, "wide")) == 2


def test_backlog_and_status(spark, path):
    assert [tuple(r) for r in model_index.status(spark, path).orderBy("dim").collect()] == [(ODD, 2, 0, 0), ("wide", 3, 0, 0)]
    assert model_index.backlog(spark, path, ODD).count() == 0
    model_index.publish(_rows(spark, [("wide", k, [1.0, float(k), 0.0], f"s{k}", 0) for k in range(9)]), path, 0)
    # Points published again, and one that the old model never had.
    later = [("wide", k, [2.0, float(k), 0.0], f"s{k}", 0) for k in range(3)] + [(ODD, k, [1.0, float(k)], f"s{k}", 0) for k in (0, 1, 20)]
    model_index.publish(_rows(spark, later), path, 1)
    vector_index.compact(spark, model_index.part_path(path, "wide"))
    assert {tuple(r) for r in model_index.backlog(spark, path, ODD).collect()} == {(k, f"s{k}") for k in range(2, 9)}
    assert [tuple(r) for r in model_index.backlog(spark, path, "wide").collect()] == [(20, "s20")]
    assert {tuple(r) for r in model_index.status(spark, path).collect()} == {("wide", 3, 9, 1), (ODD, 2, 3, 7)}
    plan = model_index.backlog(spark, path, ODD)._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan  # ids and names only


def test_queries_meet_the_part_of_their_model(spark, path):
    def asked(rows):
        return spark.createDataFrame(rows, "model string, query_id bigint, vector array<float>").withColumn("extra", F.lit(1))

    model_index.publish(_rows(spark, [("wide", 1, [1.0, 0.0, 0.0], "a", 0), ("wide", 2, [0.0, 1.0, 0.0], "b", 0)]), path, 0)
    queries = asked([("wide", 7, [1.0, 0.1, 0.0]), (ODD, 7, [1.0, 0.1]), ("wide", 8, None), ("wide", 9, []), ("wide", 10, [0.0, 0.0, 0.0])])
    assert [tuple(r)[:3] for r in model_index.nearest(queries, path).collect()] == [("wide", 7, 1)]  # the other model has no points yet
    with pytest.raises(ValueError, match="no packed version"):
        model_index.nearest(queries, path, packed=True)
    model_index.publish(_rows(spark, [(ODD, 2, [1.0, 0.0], "b", 0)]), path, 1)
    assert model_index.publish_packed(spark, path) == {"wide": 0, ODD: 1}
    for packed in (False, True):
        found = model_index.nearest(queries, path, k=1, threshold=None, packed=packed)
        assert {tuple(r)[:3] for r in found.filter("query_id = 7").collect()} == {("wide", 7, 1), (ODD, 7, 2)}
        assert not found.filter("query_id IN (8, 9)").count()
    with pytest.raises(Exception, match="not registered"):
        model_index.nearest(asked([("other", 1, [1.0])]), path)
    with pytest.raises(Exception, match="dimensions"):
        model_index.nearest(asked([("wide", 1, [1.0])]), path).collect()


def test_first_model_with_matches_is_preferred(spark):
    matches = spark.createDataFrame([("new", 1, 5), ("old", 1, 6), ("old", 2, 6), ("old", 2, 7), ("third", 3, 1)], "model string, query_id bigint, point_id bigint")
    kept = {tuple(r) for r in model_index.preferred(matches, ["new", "old"]).collect()}
    assert kept == {("new", 1, 5), ("old", 2, 6), ("old", 2, 7)}
    assert model_index.preferred(matches.limit(0), ["new"]).count() == 0
