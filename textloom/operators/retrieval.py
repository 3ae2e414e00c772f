"""Batch vector retrieval: exact top-k of a stated query set, in blocks, against every row; reranking; context assembly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V

#: Rows in a block of queries and of the corpus, and bytes of its vectors, at most; similarities that are worked out at once; results that a task keeps before it sends them on.
QUERY_BLOCK, ROW_BLOCK, BLOCK_BYTES, AT_ONCE, HELD = 2048, 4096, 4 << 20, 1 << 20, 2_000_000


def _blocks(df: DataFrame, size: int, side: str) -> DataFrame:
    """Rows (id, v, kind, w, cell) packed, as they lie, into blocks of unit vectors times w, each of one cell; null and zero vectors and null weights are left out.

    No block has more than ``size`` rows or about BLOCK_BYTES of vectors, however many rows come at once.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n, cell, most = 0, None, size

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            whole = pa.Table.from_batches(held).combine_chunks()
            v = whole.column("v").combine_chunks()
            width = len(v[0])
            v = v.cast(pa.list_(pa.float64(), width)).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            length = np.linalg.norm(v, axis=1)
            good = np.flatnonzero(length > 0)
            unit = v[good] / length[good, None] * whole.column("w").to_numpy()[good, None]
            ids, kinds = (whole.column(c).take(pa.array(good)).to_pylist() for c in ("id", "kind"))
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([cell], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([kinds], pa.list_(pa.string())), pa.array([unit.tobytes()], pa.binary())], [f"{side}_{c}" for c in ("block", "cell", "ids", "kinds", "unit")])

        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column("cell").to_numpy(zero_copy_only=False)
            most = max(1, min(size, BLOCK_BYTES // (8 * max(1, len(b.column("v")[0])))))
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), b.num_rows]
            for start, end in pairwise(edges):
                if held and (cells[start] != cell or n >= most):
                    yield block()
                    held.clear()
                    n = 0
                cell = int(cells[start])
                while start < end:
                    take = min(most - n, end - start)
                    held.append(b.slice(start, take))
                    n, start = n + take, start + take
                    if n >= most:
                        yield block()
                        held.clear()
                        n = 0
        if held:
            yield block()

    return df.where("v is not null and w is not null").mapInArrow(pack, f"{side}_block long, {side}_cell long, {side}_ids array<long>, {side}_kinds array<string>, {side}_unit binary")


def _side(df: DataFrame, i: str, vector: str, kind: str | None = None, w: str | None = None, cell: str | None = None) -> DataFrame:
    return df.select(F.col(i).cast("long").alias("id"), F.col(vector).alias("v"), (F.col(kind).cast("string") if kind else F.lit(None).cast("string")).alias("kind"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w"), (F.col(cell) if cell else F.lit(0)).cast("long").alias("cell"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", row_id: str = "id", vector: str = "embedding", kind: str | None = None, null_for_all: bool = False, weight: str | None = None) -> DataFrame:
    """query_id, id, similarity and rank of the ``k`` corpus rows most similar to each query; ties go to the smaller id. With ``weight``, a column of the corpus, similarities are multiplied by it.

    With ``kind``, a column of both sides, only rows of the query's kind count; a query's null kind matches nothing, or everything with ``null_for_all``.

    Blocks of the stated query set meet blocks of the corpus in one job (the smaller side is broadcast only below Spark's size limit). A task multiplies
    matrices, a bounded number of similarities at once, and keeps the best k of each query it has met, so the shuffle holds about k rows a query and task. Null and
    zero vectors match nothing.
    """
    pairs = _blocks(_side(corpus, row_id, vector, kind, weight), ROW_BLOCK, "c").join(_blocks(_side(queries, query_id, vector, kind), QUERY_BLOCK, "q"))
    return ranked(best_of(pairs, k, kind is not None, null_for_all), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.select("query_id", "id", "similarity").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_of(pairs: DataFrame, k: int, by_kind: bool = False, null_for_all: bool = False) -> DataFrame:
    """query_id, id, similarity and q_block of the ``k`` best rows that each task has met for each query, from pairs of blocks."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}  # by query block: its ids, and positions, similarities, ids of the best rows
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for block, (ids, at, s, rid) in best.items():
                for i in range(0, len(at), 65536):
                    n = len(at[i : i + 65536])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[i : i + 65536]]), pa.array(rid[i : i + 65536]), pa.array(s[i : i + 65536]), pa.array(np.full(n, block))], ["query_id", "id", "similarity", "q_block"])

        def nearest_of(at: np.ndarray, s: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((rid, -s, at))
            at, s, rid = at[order], s[order], rid[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            return at[first], s[first], rid[first]

        for b in batches:
            for i in range(b.num_rows):
                get = lambda c, b=b, i=i: b.column(c)[i]
                ids, rid = (get(c).values.to_numpy() for c in ("q_ids", "c_ids"))
                if not len(ids) or not len(rid):
                    continue
                q, c = (np.frombuffer(get(x).as_buffer()).reshape(n, -1) for x, n in (("q_unit", len(ids)), ("c_unit", len(rid))))
                mine, theirs = (np.array(get(x).as_py(), object) for x in ("q_kinds", "c_kinds")) if by_kind else (None, None)
                block, found = get("q_block").as_py(), []
                step = max(1, AT_ONCE // len(rid))
                for a in range(0, len(ids), step):
                    sims = q[a : a + step] @ c.T
                    if by_kind:
                        own = mine[a : a + step]
                        no_kind = np.array([x is None for x in own])
                        other = (own[:, None] != theirs[None, :]) | no_kind[:, None]
                        sims[other & ~no_kind[:, None] if null_for_all else other] = -2.0
                    least = np.full(len(sims), -2.0) if len(rid) <= k else -np.partition(-sims, k - 1, axis=1)[:, k - 1]
                    at, col = np.nonzero((sims >= least[:, None]) & (sims > -2.0))
                    found.append(nearest_of(at + a, sims[at, col], rid[col]))
                _, *old = best.get(block, (ids, *(x[:0] for x in found[0])))
                size -= len(old[0])
                best[block] = ids.copy(), *nearest_of(*(np.concatenate(x) for x in zip(old, *found, strict=True)))
                size += len(best[block][1])
                if size > HELD:
                    yield from out()
                    best.clear()
                    size = 0
        yield from out()

    return pairs.select("q_block", "q_ids", "q_kinds", "q_unit", "c_ids", "c_kinds", "c_unit").mapInArrow(score, "query_id long, id long, similarity double, q_block long")


def reranked(found: DataFrame, corpus: DataFrame, score: Column, k: int) -> DataFrame:
    """Nearest rows reordered by ``score`` over their corpus columns, the first ``k`` of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.drop("rank").join(corpus, "id").withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def semantic_duplicates(corpus: DataFrame, queries: DataFrame, kind: str, threshold: float, k: int = 8, compat: bool = False) -> DataFrame:
    """Each query's most similar other row of its kind, at the threshold or above; ties go to the smaller id.

    Similarities are taken inside the kind. ``compat`` takes the ``k`` + 1 nearest rows of all kinds first and filters these by kind, as the
    reference does, and so loses matches behind rows of other kinds.
    """
    if compat:
        q = queries.select(F.col("id").alias("query_id"), F.col(kind).alias("_kind"), "embedding")
        found = nearest(q, corpus, k + 1).where("query_id <> id").join(q.select("query_id", "_kind"), "query_id").join(corpus.select("id", kind), "id").where(F.col(kind) == F.col("_kind"))
    else:
        found = nearest(queries.select(F.col("id").alias("query_id"), kind, "embedding"), corpus, 2, kind=kind).where("query_id <> id")
    return found.where(F.col("similarity") >= threshold).groupBy("query_id").agg(F.max_by("id", F.struct("similarity", -F.col("id"))).alias("duplicate_of"), F.max("similarity").alias("similarity"))


#: Fixed limits of a context: rows by layer, over-fetch of voice, characters of a line, of all, and of voice at least.
RULES, VOICE, EXPERIENCES, KNOWLEDGE, OVERFETCH, LINE, LONG_LINE, BUDGET, LEAST = 20, 6, 4, 3, 4, 1200, 1800, 30_000, 1000


def layer(found: DataFrame, line: Column, name: str, joiner: str = "\n") -> DataFrame:
    """One text of ranked lines a query, with its line count."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return found.groupBy("query_id").agg(F.array_join(lines, joiner).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))


def rule_line(rule_type: Column, topic: Column, content: Column) -> Column:
    return F.format_string("- [%s] %s: %s", rule_type, topic, T.clip(F.coalesce(content, F.lit("")), LINE))


def voice_line(rank: Column, source_type: Column, text: Column) -> Column:
    return F.format_string("[example %d; source=%s]\n%s", rank, source_type, T.clip(F.coalesce(text, F.lit("")), LINE))


def experience_line(is_regret: Column, title: Column, context: Column, choice: Column, lessons: Column) -> Column:
    return F.format_string("- [%s] %s: %s → %s → %s", F.when(is_regret, "REGRET").otherwise("EXPERIENCE"), title, context, choice, T.clip(F.coalesce(lessons, F.lit("")), LINE))


def knowledge_line(source: Column, chapter: Column, status: Column, content: Column) -> Column:
    return F.format_string("- [%s / %s / %s] %s", source, F.coalesce(chapter, F.lit("General")), status, T.clip(F.coalesce(content, F.lit("")), LONG_LINE))


def voice_examples(queries: DataFrame, voice: DataFrame, as_of: str, k: int = VOICE, rate: float = 0.002) -> DataFrame:
    """Over-fetched nearest examples, the ``k`` best by similarity times quality, those in the order of that score with their age taken into account."""
    facts = voice.drop("embedding")
    best = reranked(nearest(queries, voice, k * OVERFETCH), facts, F.col("similarity") * F.col("quality_weight"), k)
    return reranked(best.select("query_id", "id", "similarity"), facts, V.recency(F.col("similarity") * F.coalesce("quality_weight", F.lit(0.5)), F.col("occurred_at"), as_of, rate), k)


def gated_knowledge(queries: DataFrame, knowledge: DataFrame, k: int = KNOWLEDGE) -> DataFrame:
    """Nearest knowledge of queries (query_id, embedding, factual, religious) that ask for it: factual or religious ones; religious ones get verified rows only.

    However similar a row is, it does not open the gate.
    """
    asked = queries.where("factual or religious").select("query_id", "embedding", F.when(F.col("religious"), "verified").alias("_only"))
    return nearest(asked, knowledge.withColumn("_only", F.col("verification_status")), k, kind="_only", null_for_all=True)


def context(queries: DataFrame, layers: dict[str, tuple[DataFrame, str]], budget: int = BUDGET, frame: int = 0, shrink: str = "voice", least: int = LEAST) -> DataFrame:
    """Layers (text by query, and what stands for an empty one) joined to the query table.

    Where they and the ``frame`` characters around them are over the budget, one layer is clipped by as much, not below ``least``.
    """
    out = queries
    for name, (df, placeholder) in layers.items():
        out = out.join(df, "query_id", "left").withColumn(name, F.coalesce(name, F.lit(placeholder))).withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    total = lambda: sum((F.length(n) for n in layers), F.lit(frame))
    room = F.greatest(F.lit(least), F.length(shrink) - (total() - budget))
    clipped = F.concat(T.rstrip(F.substring(F.col(shrink), F.lit(1), room - 1)), F.lit("…"))
    out = out.withColumn(shrink, F.when((total() > budget) & (F.length(shrink) > room), clipped).otherwise(F.col(shrink)))
    return out.withColumn("context_chars", total())


#: Rows that the coarse index is fitted on, about, at most, chosen by the hash of their id; every row is indexed.
FIT_ROWS = 50_000
#: Parts that a list's rows are dealt into for the blocks of its queries.
SALTS = 8


def index_lists(corpus: DataFrame, lists: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(the corpus with the number of its nearest centre as ``list``, the centres). Centres are fitted on a bounded sample, every row is indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    there = corpus.where(F.col("embedding").isNotNull())
    n = there.count()
    some = there.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / max(n, 1)) * (1 << 30)))
    model = KMeans(k=lists, seed=seed, featuresCol="v", maxIter=10).fit(some.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    centres = np.array(model.clusterCenters())

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, centres.shape[1]))
            pdf["list"] = ((centres**2).sum(1) - 2 * v @ centres.T).argmin(1).astype(np.int32) if len(pdf) else pd.Series([], dtype=np.int32)
            yield pdf

    rows = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    return rows.mapInPandas(assign, "id long, embedding array<float>, list int"), centres


def nearest_in_lists(queries: DataFrame, corpus: DataFrame, k: int, lists: int, probe: int) -> DataFrame:
    """Approximate ``nearest``: exact within the ``probe`` lists whose centres are nearest to the query. With ``probe == lists`` it is exact.

    Blocks of a list's queries meet blocks of its rows, as in ``nearest``; a list's rows are in ``SALTS`` parts, so that no list is one task's.
    """
    indexed, centres = index_lists(corpus, lists)
    squares = (centres**2).sum(1)

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = np.stack(pdf["q"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, centres.shape[1]))
            near = np.argsort(squares - 2 * q @ centres.T, axis=1, kind="stable")[:, :probe].astype(np.int32)
            yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), near.shape[1]), "q": np.repeat(pdf["q"].to_numpy(), near.shape[1]), "list": near.ravel()})

    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q")).mapInPandas(probed, "query_id long, q array<float>, list int")
    of_list = lambda df, i: df.repartitionByRange("cell", F.xxhash64(i)).sortWithinPartitions("cell")
    c = _blocks(of_list(_side(indexed, "id", "embedding", cell="list"), "id"), ROW_BLOCK, "c").withColumn("salt", F.pmod("c_block", F.lit(SALTS)))
    q = _blocks(of_list(_side(asked, "query_id", "q", cell="list"), "id"), QUERY_BLOCK, "q").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return ranked(best_of(c.join(q, (F.col("c_cell") == F.col("q_cell")) & (c["salt"] == q["salt"])), k), k)


def embedded(changed: DataFrame, known: DataFrame, text: str, predict: object = None, n: int = 64, batch: int = 96) -> DataFrame:
    """``embedding`` of rows whose (id, fingerprint) is not among the known ones. ``predict`` makes a model's batch function; without one words are hashed."""
    new = changed.withColumn("fingerprint", T.fingerprint(F.col(text))).join(known.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")
    if predict is None:
        return new.withColumn("embedding", V.hashed_words(F.col(text), n))
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    return new.withColumn("embedding", predict_batch_udf(predict, return_type=ArrayType(FloatType()), batch_size=batch)(F.col(text)))
