"""Exact vector search and similarity joins that leave out blocks which cannot matter.

Rows are dealt to the nearest of a number of centres and cut into blocks, each with its own centre and radius (the largest angle of a row to it). Two blocks whose centres are an
angle apart hold no two vectors nearer to each other than that angle less both radii. What lies under the similarity that is needed never meets: such block pairs fall to the
condition of the join, before any vector is multiplied. How many are left depends on the data: vectors without clusters, in many dimensions, leave all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import retrieval, scratch

#: Centres; rows of a block at most; blocks that each query block meets in the first round; angle that is granted to rounding.
CENTRES, ROWS, FIRST, SLACK = 64, 4096, 2, 1e-7


def centres(rows: DataFrame, n: int = CENTRES, seed: int = 42) -> np.ndarray:
    """At most ``n`` unit vectors that rows (id, v) gather around, fitted on a sample of about retrieval.FIT_ROWS rows by the hash of their id; none without rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    there = rows.where(F.col("v").isNotNull() & (length > 0))
    total = there.count()
    if not total:
        return np.zeros((0, 0))
    some = there.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, retrieval.FIT_ROWS / total) * (1 << 30)))
    model = KMeans(k=max(2, n), seed=seed, maxIter=10, distanceMeasure="cosine").fit(some.select(array_to_vector(F.col("v").cast("array<double>")).alias("features")))
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def blocks(rows: DataFrame, around: np.ndarray, side: str, size: int = ROWS, by_kind: bool = False) -> DataFrame:
    """Rows (id, v, kind, w) as blocks of one centre's rows: the columns of retrieval's blocks, and centre, radius, least and most (of the weights), n. Written.

    Rows are dealt out by ranges of centre and hash, so that a centre with a third of all rows spreads over tasks. Null and zero vectors and null weights are left out.
    With ``by_kind`` a block has rows of one kind, and those of several centres where a centre has few of it.
    """
    schema = rows.schema

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column("v").to_pylist(), np.float64)
            cell = (v @ around.T).argmax(1).astype(np.int32) if len(v) and around.size else np.zeros(b.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            v, w = np.array([r["v"] for r in held], np.float64), np.array([r["w"] for r in held], np.float64)
            length = np.linalg.norm(v, axis=1)
            good = np.flatnonzero(length > 0)
            if not len(good):
                return
            unit, w = v[good] / length[good, None], w[good]
            middle = unit.mean(0)
            far = np.linalg.norm(middle)
            middle = middle / far if far > 1e-12 else unit[0]
            radius = float(np.arccos(np.clip(unit @ middle, -1, 1)).max())
            number += 1
            own = [number - 1, [held[i]["id"] for i in good], [held[i]["kind"] for i in good], (unit * w[:, None]).tobytes(), middle.tolist(), radius, float(w.min()), float(w.max()), len(good)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, types, strict=True)], [f"{side}_{c}" for c in ("block", "ids", "kinds", "unit", "centre", "radius", "least", "most", "n")])

        for row in (r for b in batches for r in b.to_pylist()):
            other = held and held[-1]["cell"] != row["cell"] and (not by_kind or len(held) >= size // 8)
            if held and (other or len(held) == size or by_kind and held[-1]["kind"] != row["kind"]):
                yield from block()
                held.clear()
            held.append(row)
        if held:
            yield from block()

    dealt = rows.where("v is not null and w is not null").mapInArrow(nearest, schema.simpleString()[7:-1].replace(":", " ") + ", cell int")
    order = ["kind", "cell"] if by_kind else ["cell"]
    ordered = dealt.repartitionByRange(*order, F.xxhash64("id")).sortWithinPartitions(*order)
    p = side
    shape = f"{p}_block long, {p}_ids array<long>, {p}_kinds array<string>, {p}_unit binary, {p}_centre array<double>, {p}_radius double, {p}_least double, {p}_most double, {p}_n int"
    return scratch.written(ordered.mapInArrow(pack, shape), f"{side}-blocks")


def reach(a: str = "q", b: str = "c") -> Column:
    """No similarity of a row of block ``b``, times its weight, with a row of block ``a`` is larger; endless where a weight is negative."""
    cosine = F.aggregate(F.zip_with(f"{a}_centre", f"{b}_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col(f"{a}_radius") - F.col(f"{b}_radius") - SLACK
    most = F.cos(F.greatest(F.lit(0.0), apart))
    return F.when(F.col(f"{b}_least") < 0, float("inf")).otherwise(F.greatest(most * F.col(f"{b}_least"), most * F.col(f"{b}_most")))


def _rows(df: DataFrame, i: str, vector: str, kind: str | None, w: str | None = None) -> DataFrame:
    return df.select(F.col(i).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(kind).cast("string") if kind else F.lit(None).cast("string")).alias("kind"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w"))


def search(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", row_id: str = "id", vector: str = "embedding", kind: str | None = None, null_for_all: bool = False, weight: str | None = None, n_centres: int = CENTRES, size: int = ROWS, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``retrieval.nearest``, a report of one row: block_pairs, met_first, met_then, share).

    In the first round each query block meets the ``first`` blocks that reach nearest, which gives each query its k-th best similarity so far. In the second one it meets those of the
    others that reach the smallest of these of its queries; where a query has found fewer than ``k`` rows, all of them.
    """
    given = _rows(corpus, row_id, vector, kind, weight)
    around = centres(given, n_centres)
    c, q = blocks(given, around, "c", size), blocks(_rows(queries, query_id, vector, kind), around, "q", size)
    plain = lambda df, p: df.select(*[f"{p}_{x}" for x in ("block", "centre", "radius", "least", "most", "n")])
    order = Window.partitionBy("q_block").orderBy(F.desc("reach"), "c_block")
    near = plain(c, "c").join(plain(q, "q")).select("q_block", "c_block", reach().alias("reach")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first)
    chosen = scratch.written(near.groupBy("q_block").agg(F.collect_list("c_block").alias("near")), "first-blocks")
    q = scratch.written(q.join(chosen, "q_block"), "queries-near")
    got = scratch.written(retrieval.best_of(c.join(q, F.array_contains("near", F.col("c_block"))), k, kind is not None, null_for_all), "first-found")
    worst = retrieval.ranked(got, k).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("kth"))
    members = q.select("q_block", F.explode(F.arrays_zip(F.col("q_ids").alias("query_id"), F.col("q_kinds").alias("kind"))).alias("x")).select("q_block", "x.*").join(worst, "query_id", "left")
    # A query whose null kind matches nothing needs nothing.
    idle = F.col("kind").isNull() & F.lit(kind is not None and not null_for_all)
    needed = members.groupBy("q_block").agg(F.min(F.when(idle, float("inf")).otherwise(F.coalesce("kth", F.lit(float("-inf"))))).alias("needed"))
    q = scratch.written(q.join(needed, "q_block"), "queries-needed")
    left = ~F.array_contains("near", F.col("c_block")) & (reach() >= F.col("needed"))
    then = retrieval.best_of(c.join(q, left), k, kind is not None, null_for_all)
    met = plain(c, "c").join(q.select("near", "needed", *[f"q_{x}" for x in ("block", "centre", "radius")]), left).agg(F.count(F.lit(1)).alias("met_then"))
    counts = c.agg(F.count(F.lit(1)).alias("cs")).join(q.agg(F.count(F.lit(1)).alias("qs"), F.coalesce(F.sum(F.size("near")), F.lit(0)).alias("met_first"))).join(met)
    pairs = F.col("cs") * F.col("qs")
    report = counts.select(pairs.alias("block_pairs"), "met_first", "met_then", F.when(pairs > 0, (F.col("met_first") + F.col("met_then")) / pairs).alias("share"))
    return retrieval.ranked(got.unionByName(then), k), report


def _classes(rows: DataFrame, threshold: float, row_id: str, vector: str, kind: str | None, n_centres: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of blocks of classes that may hold pairs at ``threshold`` or above; id and class_id of all rows), as in ``similar_pairs``."""
    given = _rows(rows, row_id, vector, kind)
    firsts = given.where("v is not null").groupBy("v", "kind").agg(F.min("id").alias("class_id"))
    member = given.join(firsts.select(F.col("v").alias("_v"), F.col("kind").alias("_kind"), "class_id"), F.col("v").eqNullSafe(F.col("_v")) & F.col("kind").eqNullSafe(F.col("_kind")), "left")
    members = member.select("id", F.coalesce("class_id", "id").alias("class_id"))
    one = scratch.written(firsts.select(F.col("class_id").alias("id"), "v", F.coalesce("kind", F.lit("")).alias("kind"), F.lit(1.0).alias("w")), "join-classes")
    a = blocks(one, centres(one, n_centres), "c", size, kind is not None).withColumn("c_kind", F.get("c_kinds", 0))
    b = a.select(*[F.col(x).alias("q" + x[1:]) for x in a.columns])
    # Kinds meet only themselves. As two comparisons this is no key to deal by, of which there may be few.
    same = (F.col("q_kind") <= F.col("c_kind")) & (F.col("q_kind") >= F.col("c_kind")) if kind is not None else F.lit(True)
    met = a.join(b, (F.col("q_block") <= F.col("c_block")) & same & (reach() >= threshold))
    return met.select("q_block", "q_ids", "q_unit", "c_block", "c_ids", "c_unit"), members


def _products(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, others, similarities, which of them count) of pairs of blocks, a bounded number of rows at once; a block with itself gives each pair once."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c, batch=batch, i=i: batch.column(c)[i]
            ids, others = (get(c).values.to_numpy() for c in ("q_ids", "c_ids"))
            q, c = (np.frombuffer(get(x).as_buffer()).reshape(n, -1) for x, n in (("q_unit", len(ids)), ("c_unit", len(others))))
            order = np.argsort(others)
            others, c = others[order], c[order]
            step = max(1, retrieval.AT_ONCE // len(others))
            for at in range(0, len(ids), step):
                own, s = ids[at : at + step], q[at : at + step] @ c.T
                fits = s >= threshold
                if get("q_block").as_py() == get("c_block").as_py():
                    fits &= own[:, None] < others[None, :]
                yield own, others, s, fits


def similar_pairs(rows: DataFrame, threshold: float, row_id: str = "id", vector: str = "embedding", kind: str | None = None, n_centres: int = CENTRES, size: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, other and similarity of all pairs of classes at ``threshold`` or above, id below other; id and class_id of all rows).

    Rows of one kind with equal vectors are a class, named by its smallest id, so that copies are never set against each other. Without ``kind`` all rows are of one; a null kind is one too. Null and zero vectors are
    in no pair and a class by themselves. All pairs are found: block pairs are left out only where their reach is under the threshold, or their kinds differ.
    """
    met, members = _classes(rows, threshold, row_id, vector, kind, n_centres, size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, others, s, fits in _products(batches, threshold):
            at, to = np.nonzero(fits)
            x, y = ids[at], others[to]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(s[at, to])], ["id", "other", "similarity"])

    return met.mapInArrow(score, "id long, other long, similarity double"), members


def linked_rows(rows: DataFrame, threshold: float, row_id: str = "id", vector: str = "embedding", kind: str | None = None, n_centres: int = CENTRES, size: int = ROWS) -> DataFrame:
    """One row for each row: id, class_id, links (other classes at the threshold or above), nearest (the most similar of them, ties to the smaller id) and its similarity.

    Pairs are those of ``similar_pairs``. They are counted where they are found: a pair of blocks gives a row for each class that it links, never one for each pair.
    """
    met, members = _classes(rows, threshold, row_id, vector, kind, n_centres, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, others, s, fits in _products(batches, threshold):
            s[~fits] = -np.inf
            order = np.argsort(ids)
            # ``others`` rise, and so do ``ids`` now: the first of equal similarities has the smallest id.
            for own, partners, sims, fit in ((ids, others, s, fits), (others, ids[order], s[order].T, fits.T)):
                n, best = fit.sum(1), sims.argmax(1)
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(own[has]), pa.array(n[has]), pa.array(partners[best[has]]), pa.array(sims[has, best[has]])], ["class_id", "n", "other", "similarity"])

    found = met.mapInArrow(count, "class_id long, n long, other long, similarity double")
    best = found.groupBy("class_id").agg(F.sum("n").alias("links"), F.max_by("other", F.struct("similarity", -F.col("other"))).alias("nearest"), F.max("similarity").alias("similarity"))
    return members.join(best, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "nearest", "similarity")
