"""The graph index against exact search: recall, inserts, versions, hot groups and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import graph_index as G
from textloom.operators import retrieval


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in zip(ids, v, strict=True)], "id long, embedding array<double>").repartition(5)


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def asked(df):
    return df.where("id % 20 = 0").withColumnRenamed("id", "query_id")


@pytest.fixture(scope="module")
def spread(spark):
    """Vectors without clusters, tight clusters of near copies, and a third of all rows equal."""
    rng = np.random.default_rng(5)
    loose, tight = rng.standard_normal((1200, 24)), rng.standard_normal((6, 24))
    near = tight[rng.integers(6, size=600)] + 0.01 * rng.standard_normal((600, 24))
    v = np.vstack([loose, near, np.tile(rng.standard_normal(24), (900, 1))])
    return frame(spark, rng.permutation(len(v)), v).cache()


@pytest.mark.parametrize("how", [{}, {"lists": 4, "size": 200}])
def test_recall_after_inserts(spark, tmp_path, spread, how):
    path = str(tmp_path / "index")
    G.build(spread.where("id % 10 <> 3"), path, **how)
    before = {r.shard: r.n for r in G.stored(spark, path).select("shard", "n").collect()}
    G.append(spread.where("id % 10 = 3"), path)
    shards = G.stored(spark, path).collect()
    assert sum(r.n for r in shards) == spread.count() and sum(before.values()) == spread.where("id % 10 <> 3").count()
    assert sorted(i for r in shards for i in r.ids) == sorted(r.id for r in spread.collect())
    if how:
        assert len(shards) > 10 and max(r.n for r in shards) <= 1.3 * 200
    values = lambda df: {(r.query_id, r["rank"], round(r.similarity, 9)) for r in df.collect()}
    want = G.search(asked(spread), path, 6, exact=True)
    assert values(want) == values(retrieval.nearest(asked(spread), spread, 6))
    r = G.recall(G.search(asked(spread), path, 6), want).first()
    assert r.queries == asked(spread).count() and r.wanted == 6 * r.queries and r.recall >= 0.95
    # The first version is still there.
    assert values(G.search(asked(spread), path, 6, exact=True, version=1)) == values(retrieval.nearest(asked(spread), spread.where("id % 10 <> 3"), 6))


def test_graph_reaches_every_node_and_keeps_its_cycles(spark):
    rng = np.random.default_rng(1)
    v = np.vstack([c + 1e-3 * rng.standard_normal((200, 8)) for c in rng.standard_normal((5, 8))])
    rng.shuffle(v)
    got = np.zeros((0, 8)), np.zeros((0, G.NEAR), np.int32), np.zeros((0, G.LONG), np.int32)
    for part in (v[:1], v[1:700], v[700:]):
        got = G._grown(*got, part, 7)
    _, near, far = got
    for c in range(G.LONG):
        at, n = 0, 0
        while n == 0 or at:
            at, n = far[at, c], n + 1
        assert n == len(v)
    assert ((near >= -1) & (near < len(v))).all() and (near != np.arange(len(v))[:, None]).all()
    assert all(len(set(x[x >= 0])) == (x >= 0).sum() for x in near)
    nodes, sims = G._walk(G._unit(v), near, far, G._unit(v), 64)
    assert (nodes[:, 0] == np.arange(len(v))).mean() > 0.99 and (np.diff(sims, axis=1) <= 0).all()


def test_inserts_touch_only_their_shards_and_known_ids_stay(spark, tmp_path):
    rng = np.random.default_rng(2)
    around = np.eye(4)
    v = np.repeat(around, 100, 0) + 0.01 * rng.standard_normal((400, 4))
    path, rows = str(tmp_path / "index"), frame(spark, range(400), v)
    G.build(rows, path, lists=4, size=256)
    G.append(frame(spark, [5, 1000], [[0, 0, 0, 9.0], [9.0, 0.1, 0, 0]]), path)
    shards = {r.shard: r for r in G.stored(spark, path).select("shard", "seq", "n", "ids").collect()}
    assert sorted(r.seq for r in shards.values()) == [1, 1, 1, 2] and sum(r.n for r in shards.values()) == 401
    assert next(r for r in shards.values() if r.seq == 2).n == 101 and 5 in next(r for r in shards.values() if r.seq == 2).ids
    # What a writer left without a commit is not read.
    G.stored(spark, path).drop("seq", "token").write.parquet(f"{path}/blocks/token=lost")
    assert G.stored(spark, path).count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        G.build(rows, path)


def test_odd_rows(spark, tmp_path):
    t = "id long, embedding array<double>, shard string, list string, v string"
    odd = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, 1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "x", None, "") for r in odd], t)
    path = str(tmp_path / "a")
    G.build(df, path)
    assert sorted(i for r in G.stored(spark, path).collect() for i in r.ids) == [1, 2, 8]
    found = G.search(df.withColumnRenamed("id", "query_id"), path, 2)
    assert [(r.query_id, r.id, r["rank"]) for r in found.orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (8, 8, 1), (8, 1, 2)]
    empty = str(tmp_path / "b")
    G.build(df.limit(0), empty)
    assert G.search(df.withColumnRenamed("id", "query_id"), empty, 2).count() == 0
    G.append(df, empty)
    assert pairs(G.search(df.withColumnRenamed("id", "query_id"), empty, 2)) == pairs(found)
    G.append(df.limit(0), empty)
    assert pairs(G.search(df.withColumnRenamed("id", "query_id"), empty, 2)) == pairs(found)
    assert G.recall(found.limit(0), found.limit(0)).first().recall == 1.0
