"""Exact search in blocks of bounded size, and search in lists by the same blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import bounds, graph_index
from textloom.operators import retrieval as R


@pytest.fixture(scope="module")
def rows(spark):
    """Vectors in one Arrow batch, with copies, a null and a zero vector."""
    rng = np.random.default_rng(11)
    own = [(i, rng.standard_normal(8).tolist()) for i in range(1200)]
    own += [(2000 + i, own[3][1]) for i in range(30)] + [(3000, None), (3001, [0.0] * 8)]
    return spark.createDataFrame(own, "id long, embedding array<float>").coalesce(1).cache()


def test_a_block_is_never_larger_than_its_size(rows, monkeypatch):
    side = R._side(rows, "id", "embedding")
    sizes = [r.n for r in R._blocks(side, 100, "c").select(F.size("c_ids").alias("n")).collect()]
    assert max(sizes) <= 100 and sum(sizes) == 1230 and len(sizes) == 13  # a batch of all rows was one block before
    monkeypatch.setattr(R, "BLOCK_BYTES", 8 * 8 * 50)
    assert max(r.n for r in R._blocks(side, 100, "c").select(F.size("c_ids").alias("n")).collect()) == 50


def test_products_in_slices_give_the_same(rows, monkeypatch):
    q = rows.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    want = [tuple(r) for r in R.nearest(q, rows, 40).orderBy("query_id", "rank").select("query_id", "id", "rank").collect()]
    for name, value in (("AT_ONCE", 1000), ("HELD", 500), ("QUERY_BLOCK", 30), ("ROW_BLOCK", 70)):
        monkeypatch.setattr(R, name, value)
    assert [tuple(r) for r in R.nearest(q, rows, 40).orderBy("query_id", "rank").select("query_id", "id", "rank").collect()] == want


def test_lists_are_searched_by_blocks(rows):
    q = rows.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    found = R.nearest_in_lists(q, rows, 5, 6, 6)
    key = lambda df: {(r.query_id, r.rank): (r.id, round(r.similarity, 6)) for r in df.collect()}
    assert key(found) == key(R.nearest(q, rows, 5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "c_unit" in plan and "zip_with" not in plan  # before, each pair of a query and a row was a row with its own sum of products
    few = key(R.nearest_in_lists(q, rows, 5, 6, 2))
    assert few and {i for i, _ in few} <= {i for i, _ in key(found)}


def test_kinds_meet_only_themselves(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.standard_normal(8).tolist(), "abc"[i % 3]) for i in range(600)], "id long, embedding array<float>, kind string")
    met, _ = bounds._classes(rows, -1.0, "id", "embedding", "kind", 4, 50)
    pairs = met.select("q_ids", "c_ids").collect()
    assert all(len({i % 3 for i in [*r.q_ids, *r.c_ids]}) == 1 for r in pairs)
    assert sum(len(r.q_ids) * len(r.c_ids) for r in pairs) < 600 * 600 / 4  # before, all blocks met, of whatever kind
    assert {r.links for r in bounds.linked_rows(rows, -1.0, kind="kind", n_centres=4, size=50).collect()} == {199}


def test_queries_of_many_lists_stay_off_the_driver(spark, rows, tmp_path):
    path = f"{tmp_path}/index"
    graph_index.build(rows, path, lists=4, size=300)
    q = rows.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    for exact in (False, True):
        found = graph_index.search(q, path, 5, exact=exact)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [shard" in plan  # before, the side with the queries went through the driver
    assert found.where("rank = 1").count() == q.where("query_id < 3000").count()
