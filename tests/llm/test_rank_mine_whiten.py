"""Operators 11 to 13: held-out accuracy, brute force, numpy's eigenvectors, and the edge cases of their docstrings."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import jacobi_davidson, pairwise_rank, queries, segment_negatives, vector_rows

SF = "/root/testdata/sf0.01"


# ---- 11


def test_ranking_on_held_out_documents(spark):
    out = queries.QUERIES["op11_pairwise_rank"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 < r.score < 1 and r.predicted == int(r.score >= 0.3) for r in out)
    test = [r for r in out if r.held_out and r.doc_id in quality]
    good, bad = [r.score for r in test if quality[r.doc_id]], [r.score for r in test if not quality[r.doc_id]]
    assert len(bad) > 5 and sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(r.predicted == quality[r.doc_id] for r in test) >= 0.95 * len(test)
    by_text = {}
    assert all(by_text.setdefault(docs[r.doc_id].text, r.score) == r.score for r in out)


def test_ranking_edges(spark):
    rng = random.Random(3)
    plain = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n)) + "."
    texts = [(i, plain(60), 1) for i in range(40)] + [(100 + i, "buy$$$ ### " * 30, 0) for i in range(40)]
    odd = [(200, None, None), (201, "", None), (None, plain(20), None), (203, "x " * 400_000, None), (204, plain(30), 7), (0, texts[0][1], None), (205, "\n \n", None)]
    df = spark.createDataFrame([(a, b, 1.0, 2) for a, b, _ in texts + odd], "doc_id long, text string, score double, row int")
    labels = spark.createDataFrame([(a, q, 0) for a, _, q in texts + odd if q is not None] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    never = F.lit(False)
    got = pairwise_rank.ranked(df, labels, never).collect()
    assert len(got) == len(texts) + len(odd) and all(0 < r.score < 1 and r.predicted == int(r.score >= 0.3) and r.row.score == 1.0 for r in got)
    right = [r.predicted == q for r in got for a, t, q in texts if r.row.doc_id == a and a != 5]
    assert sum(right) >= 0.95 * len(right)
    assert len({r.score for r in got if r.row.doc_id in (200, 201, 205)}) == 1 and len({r.score for r in got if r.row.doc_id == 0}) == 1
    assert pairwise_rank.ranked(df.limit(0), labels, never).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert {(round(r.score, 12), r.predicted) for r in pairwise_rank.scored(df, few).collect()} == {(0.3, 1)}
    held = pairwise_rank.scored(df, labels).collect()
    assert {r.held_out for r in held if r.doc_id is None} == {False}


def test_pairs_grow_with_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("quality"), F.array(F.col("id").cast("double")).alias("features"))
    n = pairwise_rank.pairs(rows).count()
    assert 0.85 * 4 * 2700 < n < 1.15 * 4 * 2700
    assert pairwise_rank.pairs(rows.where("quality = 1")).count() == 0


def test_features_of_whole_texts():
    got = dict(zip(pairwise_rank.FEATURES, pairwise_rank.described("One two two.\nOne two two.\n### END9"), strict=True))
    assert got["words"] == math.log1p(8) and got["doubles"] == 0
    assert math.isclose(got["dup_lines"], math.log1p(100 / 3)) and math.isclose(got["digits"], math.log1p(100 / 27))
    tail = "calm words here and there " * 300_000 + "$$$"
    assert pairwise_rank.described(tail)[12] > pairwise_rank.described(tail[:-3])[12] and pairwise_rank.described(None) == [0.0] * len(pairwise_rank.FEATURES)


# ---- 12


def brute_negatives(rows, anchors, k=5, m=10):
    out = []
    for a, label, x in anchors:
        dot = lambda y, x=x: sum(int(p) * int(q) for p, q in zip(x, y, strict=False))
        near = sorted((-dot(y), i) for i, other, y in rows if other == label and i != a)[:k]
        for s, p in near:
            found = sorted((-dot(y), i) for i, other, y in rows if other != label and 30 * -s <= 100 * dot(y) <= 90 * -s)[:m]
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(found, start=1)]
    return sorted(out)


def columns(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_rows, "BLOCK_BYTES", 8 * 6 * 40)
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, (4, 6))
    rows = [(i, i % 3, (centres[i % 4] + rng.integers(-9, 9, 6)).tolist()) for i in range(700)]
    rows += [(i + 2000, 1, rows[8][2]) for i in range(30)]  # ties
    df = spark.createDataFrame([(i, b, x, "s") for i, b, x in rows], "id long, label int, x array<long>, rank string").repartition(5)
    want = brute_negatives(rows, [r for r in rows if r[0] % 50 == 0])
    assert len(want) > 300 and columns(segment_negatives.mined(df, F.col("id") % 50 == 0)) == want


def test_negatives_edges(spark):
    nan, inf, big = float("nan"), float("inf"), 1e30
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.5]), (2, 1, None), (3, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (4, 2, [0.5, nan]), (5, 2, [0.5, inf]), (6, 2, [0.5, None]), (8, 2, [0.5, 0.7]), (8, 2, [0.5, 0.7]), (9, 2, [0.9]), (10, 3, []), (100, 1, [1.0, 1.5]), (100, 4, [1.0, 1.5])]
    df = spark.createDataFrame([(a, b, v, 0) for a, b, v in rows], "vec_id long, label int, embedding array<double>, rank int")
    got = columns(segment_negatives.hard_negatives(df))
    fixed = [(i, (b + 1) % 10 if i % 7 == 0 else b, [math.floor(256 * c) for c in v]) for i, b, v in rows if i is not None and b is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    first = {}
    for r in sorted(fixed):
        first.setdefault(r[0], r)
    assert got == brute_negatives(fixed, [r for r in first.values() if r[0] % 100 == 0]) and got
    assert columns(segment_negatives.hard_negatives(df.limit(0))) == [] == columns(segment_negatives.hard_negatives(df.where("vec_id % 100 <> 0")))
    huge = spark.createDataFrame([(0, 1, [big]), (1, 2, [big]), (2, 2, [-big]), (3, 3, [1.0])], "vec_id long, label int, embedding array<double>")
    assert columns(segment_negatives.hard_negatives(huge)) == []  # the only row of its label has moved on to 2, as the first one did
    long = spark.createDataFrame([(i, b, [v] * 5000) for i, b, v in ((0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.5), (3, 3, 0.95))], "vec_id long, label int, embedding array<double>")
    assert columns(segment_negatives.hard_negatives(long)) == [(0, 1, 1, 2, 5000 * 65536, 5000 * 32768)]


def test_bounds_hold_and_rule_out(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-300, 300, (40, 37)), np.repeat(rng.integers(-300, 300, (30, 1)), 37, 1) + rng.integers(-5, 5, (30, 37))
    exact = (a @ b.T).astype(float)
    for n in (1, 4, 16):
        middle, radius = segment_negatives._near(segment_negatives.summaries(a, n), segment_negatives.summaries(b, n))
        assert (np.abs(exact - middle) <= radius).all() and (n > 1 or (radius < 60_000).mean() > 0.5)
    side = lambda x: segment_negatives.Side(np.arange(len(x)), np.zeros(len(x), np.int64), x, [segment_negatives.summaries(x, n) for n in segment_negatives.LEVELS])
    met = {}
    best = np.sort(exact, axis=1)[:, -3]
    at, to, score = segment_negatives.open_pairs(side(a), side(b), np.ones(exact.shape, bool), best, np.full(40, np.inf), met)
    assert set(zip(*np.nonzero(exact >= best[:, None]), strict=True)) <= set(zip(at, to, strict=True)) and (score == exact[at, to]).all()
    assert met["level1"] <= met["level0"] < met["pairs"] / 2
    x = np.array([[1 << 40, 3], [-(1 << 40), 1]])
    assert vector_rows.products(x, x).tolist() == [[(1 << 63) - 1, -(1 << 63)], [-(1 << 63), (1 << 63) - 1]]


# ---- 13


def whole(v):
    return [math.floor(256 * c) for c in v]


def test_whitening_against_numpy(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    out = queries.QUERIES["op13_jacobi_davidson"](spark, SF).toPandas()
    rows = {r.vec_id: whole(r.embedding) for r in e.collect()}
    u = np.unique(np.array(list(rows.values()), np.int64), axis=0)
    n, sums = len(u), u.sum(0)
    c = (n * u - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    assert len(out) == 4 * len(rows) and set(out.n) == {n} and out.identity_error.max() < 1e-10 and out.identity_error.nunique() == 1
    for k in range(4):
        own = out[out.component == k + 1].set_index("vec_id").loc[list(rows)]
        x = np.array(list(rows.values()), np.int64)
        assert (own.deviation.to_numpy() == ((n * x - sums) ** 2).sum(1)).all()
        want = (n * x - sums) / n @ vectors[:, -1 - k] / math.sqrt(values[-1 - k])
        got = own.whitened.to_numpy()
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-10
        assert np.allclose(own.explained, values[-1 - k] / values.sum(), rtol=1e-12) and (own.residual < 1e-10 * values[-1]).all()


@pytest.mark.parametrize(("d", "top"), [(1, []), (2, []), (5, []), (64, [1704, 1665]), (150, [40]), (30, [1.0, 1.0, 1.0])])
def test_solver(d, top):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.sort(np.concatenate((top, rng.uniform(0, 1, d - len(top)))))[::-1]
    a = (q * e) @ q.T
    jobs = []
    values, u, left = jacobi_davidson.leading(lambda v: (jobs.append(v.shape), a @ v)[1], d)
    k = min(4, d)
    assert np.allclose(values, e[:k], atol=1e-12 * e[0]) and (left < 1e-12 * e[0]).all() and np.allclose(u.T @ u, np.eye(k), atol=1e-13)
    assert np.abs(a @ u - u * values).max() < 1e-12 * e[0] and len(jobs) < 150 and all(w <= 16 for _, w in jobs)


def test_minres_solves_projected_equations():
    rng = np.random.default_rng(1)
    d = 20
    a = rng.standard_normal((d, d))
    a = a + a.T
    space = np.linalg.qr(rng.standard_normal((d, 3)))[0]
    right = rng.standard_normal((d, 2))
    shifts = np.array([0.3, -1.1])
    t = jacobi_davidson.minres(lambda v: a @ v, shifts, right, space, 40)
    p = np.eye(d) - space @ space.T
    for k in range(2):
        assert np.abs(p @ (a - shifts[k] * np.eye(d)) @ p @ t[:, k] - p @ right[:, k]).max() < 1e-8 and np.abs(space.T @ t).max() < 1e-12


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, None), (3, [nan, 1.0, 1.0]), (4, [1.0, inf, 1.0]), (5, [1.0, None, 1.0]), (None, [0.0, -0.0, 1.0]), (7, [3.0, 1.0]), (8, [])]
    df = spark.createDataFrame([(a, v, "c", 5) for a, v in rows], "vec_id long, embedding array<float>, component string, n int")
    got = jacobi_davidson.whitened(df, "embedding").collect()
    assert len(got) == 5 * 3 and {r.n for r in got} == {4} and {r.row.component for r in got} == {"c"}
    x = np.array([[256, 512, 128], [0, 0, 256], [768, 256, 0], [0, 0, 0]])
    c = 4 * x - x.sum(0)
    assert {r.deviation for r in got if r.row.vec_id == 8} == {int((c[3] ** 2).sum())}
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12 and max(r.identity_error for r in got) < 1e-10
    assert jacobi_davidson.report(df.limit(0)).count() == 0 and len(jacobi_davidson.report(df.limit(0)).columns) == 9
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in jacobi_davidson.report(same).collect()} == {(1, 0, None, 0.0, 0.0)}
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r.whitened is None for r in jacobi_davidson.report(flat).collect() if r.component == 2} == {True}
    far = spark.createDataFrame([(i, [1e15 * i, 1.0 * i * i]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in jacobi_davidson.report(far).collect()} == {(1 << 63) - 1}
    long = spark.createDataFrame([(i, [float((i * k) % 7) for k in range(300)]) for i in range(40)], "vec_id long, embedding array<double>")
    assert max(r.identity_error for r in jacobi_davidson.report(long).collect()) < 1e-8
