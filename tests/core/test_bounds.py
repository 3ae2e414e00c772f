"""Search and joins that leave blocks out against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import bounds, retrieval


@pytest.fixture(scope="module")
def clustered(spark):
    """Tight clusters, one with a third of all rows; copies, a null, a zero vector, a null kind."""
    rng = np.random.default_rng(3)
    around = rng.standard_normal((12, 16))
    at = [0 if i % 3 == 0 else i % 12 for i in range(600)]
    rows = [(i, (around[c] + 0.05 * rng.standard_normal(16)).tolist(), "ab"[i % 2] if i % 50 else None, 0.5 + (i % 7) / 10) for i, c in enumerate(at)]
    rows += [(1000 + i, rows[i][1], rows[i][2], 1.0) for i in range(0, 60, 2)] + [(2000, None, "a", 1.0), (2001, [0.0] * 16, "a", 1.0), (2002, rows[5][1], "b", None)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, kind string, w double").repartition(6).cache()


@pytest.mark.parametrize("how", [{}, {"kind": "kind"}, {"kind": "kind", "null_for_all": True}, {"weight": "w"}])
def test_search_equals_all_pairs_and_skips(clustered, how):
    q = clustered.where("id % 20 = 0").withColumnRenamed("id", "query_id").drop("w")
    want = {(r.query_id, r.rank): (r.id, round(r.similarity, 9)) for r in retrieval.nearest(q, clustered, 5, **how).collect()}
    found, report = bounds.search(q, clustered, 5, n_centres=12, size=50, first=2, **how)
    got = {(r.query_id, r.rank): (r.id, round(r.similarity, 9)) for r in found.collect()}
    assert got == want and want
    r = report.first()
    assert r.met_first + r.met_then < r.block_pairs if how else r.share < 0.5


def test_search_edges(spark, clustered):
    q = clustered.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    for a, b in ((q.limit(0), clustered), (q, clustered.limit(0))):
        found, report = bounds.search(a, b, 5, n_centres=4)
        assert found.count() == 0 and report.count() == 1
    minus = clustered.withColumn("w", -F.col("w"))
    want = {(r.query_id, r.rank): r.id for r in retrieval.nearest(q.drop("w"), minus, 5, weight="w").collect()}
    assert {(r.query_id, r.rank): r.id for r in bounds.search(q.drop("w"), minus, 5, weight="w", n_centres=12, size=50)[0].collect()} == want
    few = clustered.where("id < 3")
    assert bounds.search(q, few, 5, n_centres=2)[0].groupBy("query_id").count().where("count <> 3").count() == 0


@pytest.mark.parametrize("kind", [None, "kind"])
def test_similarity_join_equals_all_pairs(clustered, kind):
    rows = [(r.id, r.embedding, r.kind if kind else None) for r in clustered.collect()]
    first = {}
    for i, v, g in sorted(rows):
        first.setdefault((tuple(v), g) if v else i, i)
    of = {i: first[(tuple(v), g) if v else i] for i, v, g in rows}
    base = [(i, np.array(v), g) for i, v, g in rows if v and of[i] == i and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in base])
    s = unit @ unit.T
    links = {i: {base[y][0]: s[x, y] for y in np.flatnonzero(s[x] >= 0.985) if y != x and (kind is None or g == base[y][2])} for x, (i, _, g) in enumerate(base)}
    got = bounds.linked_rows(clustered, 0.985, kind=kind, n_centres=12, size=40).collect()
    assert len(got) == len(rows) and {r.id: r.class_id for r in got} == of
    assert {r.id: r.links for r in got} == {i: len(links.get(of[i], {})) for i, _, _ in rows}
    for r in got:
        own = links.get(r.class_id, {})
        assert r.nearest == min((-round(x, 12), j) for j, x in own.items())[1] if own else r.nearest is None
    assert bounds.linked_rows(clustered.limit(0), 0.9, kind=kind).count() == 0
