"""Approximate vector search by navigable graphs that are stored, take inserts and are never fitted again.

Rows are dealt to the nearest of a number of centres (a list) and, inside a list, to shards of bounded size. A shard is one row of a Parquet table: its vectors, their ids and the links of
its graph. A node is a distinct vector, so that copies are one node with many ids. It is linked to ``NEAR`` close nodes that lie in different directions, and to its
successors on ``LONG`` random cycles through all nodes, which keep every node in reach. A query starts at some spread nodes and follows links with a beam.

Inserts go to the last shard of their list, or to new ones where it is full; only those shards are written again, as a version of their own. A version counts once it stands in the table of
commits: what a stopped writer leaves is never read. One writer at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import bounds, retrieval, scratch

#: Rows of a shard and bytes of its vectors, at most, about; close and random links of a node; nodes that close links are chosen from; queries of a block.
SHARD, SHARD_BYTES, NEAR, LONG, POOL, QUERIES = 16384, 32 << 20, 16, 4, 64, 512
#: Nodes that a search keeps, those it follows at once, and what stands for no similarity.
BEAM, AT_ONCE, NONE = 128, 4, -9.0

BLOCK = "shard long, list int, n int, d int, ids array<long>, starts array<int>, vectors binary, near binary, far binary"


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _without_repeats(nodes: np.ndarray) -> np.ndarray:
    """A copy in which all but one of equal entries of a row are -1."""
    order = np.argsort(nodes, axis=1, kind="stable")
    ranked = np.take_along_axis(nodes, order, 1)
    ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1].copy()] = -1
    out = np.empty_like(nodes)
    np.put_along_axis(out, order, ranked, 1)
    return out


def _similar(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of nodes ``a`` to nodes ``b``, one by one."""
    return np.concatenate([np.einsum("ij,ij->i", unit[a[i : i + 65536]], unit[b[i : i + 65536]]) for i in range(0, max(len(a), 1), 65536)])


def _first(nodes: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(unit: np.ndarray, pool: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """``NEAR`` of each row's nodes, which come nearest first: those that are nearer to the row than to any chosen before them, then the nearest others; -1 where there are no more."""
    out = np.full((len(pool), NEAR), -1, np.int32)
    step = max(1, (4 << 20) // max(1, pool.shape[1] * unit.shape[1]))
    for a in range(0, len(pool), step):
        c, s = pool[a : a + step], sims[a : a + step]
        x = unit[c]
        between, kept = x @ x.transpose(0, 2, 1), np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            kept[:, j] = (c[:, j] >= 0) & ~((between[:, j, :j] >= s[:, j, None]) & kept[:, :j]).any(1)
        order = np.argsort(np.where(c < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :NEAR]
        out[a : a + step, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def _link_back(unit: np.ndarray, near: np.ndarray, of: np.ndarray) -> None:
    """The nodes that ``of`` link to choose their own links again, with ``of`` among the candidates."""
    x, y = np.repeat(of, NEAR), near[of].ravel()
    x, y = x[y >= 0], y[y >= 0]
    if not len(x):
        return
    s = _similar(unit, x, y)
    order = np.lexsort((-s, y))
    x, y, s = x[order], y[order], s[order]
    nth = np.arange(len(y)) - np.searchsorted(y, y)
    x, y, nth = x[nth < POOL], y[nth < POOL], nth[nth < POOL]
    to, row = np.unique(y, return_inverse=True)
    pool = np.full((len(to), NEAR + POOL), -1, np.int32)
    pool[:, :NEAR] = near[to]
    pool[row, NEAR + nth] = x
    pool = _without_repeats(pool)
    sims = _similar(unit, np.repeat(to, pool.shape[1]), pool.ravel()).reshape(pool.shape)
    near[to] = _diverse(unit, *_first(pool, np.where(pool < 0, NONE, sims), NEAR + POOL))


def _walk(unit: np.ndarray, near: np.ndarray, far: np.ndarray, q: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the ``keep`` best nodes that a beam of this width meets for each query; -1 where there are fewer."""
    links = _without_repeats(np.hstack([near, far]))
    entries = np.unique(np.linspace(0, len(unit) - 1, min(len(unit), 2 * math.isqrt(len(unit)) + 1)).astype(np.int32))
    nodes, sims = np.full((len(q), keep), -1, np.int32), np.full((len(q), keep), NONE)
    for a in range(0, len(q), 256):
        x = q[a : a + 256]
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), len(unit)), bool)
        seen[:, entries] = True
        at, s = _first(np.tile(entries, (len(x), 1)), x @ unit[entries].T, keep)
        done = np.zeros(at.shape, bool)
        while True:
            unread = np.where(done, NONE, s)
            best = np.argsort(-unread, axis=1, kind="stable")[:, :AT_ONCE]
            there = np.take_along_axis(unread, best, 1) > NONE
            busy = np.flatnonzero(there.any(1))
            if not len(busy):
                break
            done[rows, best] = True
            step = np.where(there[busy, :, None], links[at[busy[:, None], best[busy]]], -1).reshape(len(busy), -1)
            step = _without_repeats(step)
            new = (step >= 0) & ~seen[busy[:, None], step]
            who, which = np.nonzero(new)
            seen[busy[who], step[who, which]] = True
            found = np.full(step.shape, NONE)
            found[who, which] = np.einsum("ij,ij->i", x[busy[who]], unit[step[who, which]])
            wide, wide_s = np.full((len(x), at.shape[1] + step.shape[1]), -1, np.int32), np.full((len(x), at.shape[1] + step.shape[1]), NONE)
            wide[:, : at.shape[1]], wide_s[:, : at.shape[1]] = at, s
            wide[busy, at.shape[1] :], wide_s[busy, at.shape[1] :] = np.where(new, step, -1), found
            order = np.argsort(-wide_s, axis=1, kind="stable")[:, :keep]
            marks = np.hstack([done, np.zeros((len(x), step.shape[1]), bool)])
            at, s, done = (np.take_along_axis(m, order, 1) for m in (wide, wide_s, marks))
        nodes[a : a + 256, : at.shape[1]], sims[a : a + 256, : at.shape[1]] = at, s
    return nodes, sims


def _nearest(unit: np.ndarray, first: int, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``pool`` nodes nearest to each node from ``first`` on, among these."""
    mine = unit[first:]
    k = min(pool, len(mine) - 1)
    nodes, sims = np.zeros((len(mine), max(k, 0)), np.int32), np.zeros((len(mine), max(k, 0)))
    for a in range(0, len(mine) if k > 0 else 0, 512):
        s = mine[a : a + 512] @ mine.T
        s[np.arange(len(s)), a + np.arange(len(s))] = NONE
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        at, s = _first(top, np.take_along_axis(s, top, 1), k)
        nodes[a : a + 512], sims[a : a + 512] = at + first, s
    return nodes, sims


def _grown(v: np.ndarray, near: np.ndarray, far: np.ndarray, more: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A graph's vectors and links with the nodes ``more``, none of which it has. Candidates of a new node: what a walk over the old graph finds, and the nearest new nodes."""
    n, m = len(v), len(more)
    v = np.vstack([v, more]) if n else more
    unit = _unit(v)
    pool, sims = _nearest(unit, n, POOL)
    if n:
        old, old_sims = _walk(unit[:n], near, far, unit[n:], POOL)
        pool, sims = _first(np.hstack([pool, old]), np.hstack([sims, old_sims]), POOL)
    near = np.vstack([near, _diverse(unit, pool, sims) if pool.shape[1] else np.full((m, NEAR), -1, np.int32)])
    _link_back(unit, near, np.arange(n, n + m, dtype=np.int32))
    # Each cycle takes all new nodes, in random order, in the place of one of its links.
    rng, grown = np.random.default_rng(seed + n), np.zeros((n + m, LONG), np.int32)
    grown[:n] = far
    for c in range(LONG):
        order = n + rng.permutation(m)
        grown[order[:-1], c] = order[1:]
        if n:
            cut = rng.integers(n)
            grown[order[-1], c], grown[cut, c] = grown[cut, c], order[0]
        else:
            grown[order[-1], c] = order[0]
    return v, near, grown


def _read(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, vectors, near, far) of a stored shard."""
    shape = lambda x, t, w: np.frombuffer(block[x], t).reshape(-1, w)
    return np.array(block["ids"], np.int64), np.array(block["starts"], np.int64), shape("vectors", np.float64, block["d"]), shape("near", np.int32, NEAR), shape("far", np.int32, LONG)


def _insert(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """One shard with more rows (shard, list, id, v). Rows with the vector of a node add their id to it."""
    new, schema = rows.to_pydict(), [("shard", pa.int64()), ("list", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("vectors", pa.binary()), ("near", pa.binary()), ("far", pa.binary())]
    if not new["id"]:
        return pa.table({k: pa.array([], t) for k, t in schema})
    given, width = np.array(new["v"], np.float64) + 0.0, len(new["v"][0])
    ids, starts, v, near, far = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, width)), np.zeros((0, NEAR), np.int32), np.zeros((0, LONG), np.int32)
    if blocks.num_rows:
        ids, starts, v, near, far = _read(blocks.to_pylist()[0])
    known = {x.tobytes(): i for i, x in enumerate(v)}
    node = np.array([known.setdefault(x.tobytes(), len(known)) for x in given])
    fresh, where = np.unique(node[node >= len(v)], return_index=True)
    if len(fresh):
        v, near, far = _grown(v, near.copy(), far, given[node >= len(v)][where], new["shard"][0])
    of = np.concatenate([np.repeat(np.arange(len(starts) - 1), np.diff(starts)), node])
    ids = np.concatenate([ids, np.array(new["id"], np.int64)])
    order = np.lexsort((ids, of))
    own = [new["shard"][0], new["list"][0], len(ids), width, ids[order].tolist(), np.searchsorted(of[order], np.arange(len(v) + 1)).tolist(), v.tobytes(), near.astype(np.int32).tobytes(), far.tobytes()]
    return pa.table({k: pa.array([x], t) for (k, t), x in zip(schema, own, strict=True)})


def _usable(df: DataFrame, i: str, vector: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector of finite entries that are not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return df.select(F.col(i).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _dealt(rows: DataFrame, centres: np.ndarray, probe: int = 1) -> DataFrame:
    """Rows (id, v) with the ``probe`` lists whose centres lie nearest as ``list``, a row each; list 0 without centres."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = min(probe, max(1, len(centres)))
            v = np.array(b.column("v").to_pylist(), np.float64)
            own = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :k] if len(v) and centres.size else np.zeros((b.num_rows, k), np.int64)
            again = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(again)) for c in b.columns), pa.array(own.ravel().astype(np.int32))], ["id", "v", "list"])

    return rows.mapInArrow(near, "id long, v array<double>, list int")


def _commits(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    found = spark.read.schema("seq long, token string, size int, d int").parquet(f"{path}/commits")
    return found if version is None else found.where(F.col("seq") <= version)


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("list int, centre array<double>").parquet(f"{path}/centres").orderBy("list").collect()
    return np.array([r.centre for r in rows]) if rows else np.zeros((0, 0))


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The shards as the last commit, or that of ``version``, left them."""
    blocks = spark.read.schema(BLOCK + ", token string").parquet(f"{path}/blocks").join(_commits(spark, path, version).select("token", "seq"), "token")
    last = blocks.groupBy("shard").agg(F.max("seq").alias("seq"))
    return blocks.join(last, ["shard", "seq"])


def _write(spark: SparkSession, path: str, rows: DataFrame, old: DataFrame | None, seq: int, size: int, d: int) -> None:
    token = uuid.uuid4().hex
    old = spark.createDataFrame([], BLOCK) if old is None else old.select(*[c.split()[0] for c in BLOCK.split(", ")])
    grown = rows.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_insert, BLOCK)
    grown.write.option("compression", "zstd").parquet(f"{path}/blocks/token={token}")
    spark.createDataFrame([(seq, token, size, d)], "seq long, token string, size int, d int").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def build(rows: DataFrame, path: str, lists: int | None = None, size: int | None = None, row_id: str = "id", vector: str = "embedding") -> None:
    """Writes an index of ``rows`` to ``path``, which must not exist.

    Left out are rows without an id, null, zero and non-finite vectors and those of another length than most. Of rows with one id that with the smallest vector is indexed.
    Centres are fitted on a bounded sample (retrieval.FIT_ROWS), every row is indexed. An index of no rows is one list, and takes inserts.
    """
    spark = rows.sparkSession
    given = _usable(rows, row_id, vector)
    n, d = given.agg(F.count(F.lit(1)), F.mode(F.size("v"))).first()
    d = d or 0
    given = scratch.written(given.where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")), "graph-rows")
    size = size or max(256, min(SHARD, SHARD_BYTES // (8 * max(d, 1))))
    lists = lists or max(1, min(math.isqrt(n), 2 * n // size, retrieval.FIT_ROWS // 16))
    around = bounds.centres(given, lists) if lists > 1 else np.zeros((0, 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(around)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    dealt = scratch.written(_dealt(given, around), "graph-dealt")
    _write(spark, path, _placed(dealt, None, size), None, 1, size, d)


def _placed(dealt: DataFrame, sizes: DataFrame | None, size: int) -> DataFrame:
    """Rows (id, v, list) with their shard: the last one of the list where all fit in, else new ones, three quarters full."""
    new = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("more"))
    last = sizes.groupBy("list").agg(F.max("shard").alias("last"), F.max_by("n", "shard").alias("n")) if sizes is not None else None
    plan = new.join(last, "list", "left") if last is not None else new.withColumn("last", F.lit(None).cast("long")).withColumn("n", F.lit(0))
    fits = F.col("last").isNotNull() & (F.col("n") + F.col("more") <= size)
    start = F.when(fits, F.col("last")).otherwise(F.coalesce(F.col("last") + 1, F.col("list").cast("long") * (1 << 32)))
    plan = plan.select("list", start.alias("start"), F.when(fits, 1).otherwise(F.ceil(F.col("more") / (0.75 * size))).alias("shards"))
    return dealt.join(plan, "list").select((F.col("start") + F.pmod(F.xxhash64("id"), "shards")).alias("shard"), "list", "id", "v")


def append(rows: DataFrame, path: str, row_id: str = "id", vector: str = "embedding") -> None:
    """Inserts the rows whose ids the index has not yet; those it has stay as they are. Centres are not fitted again, and only shards that rows go to are written."""
    spark = rows.sparkSession
    seq, size, d = _commits(spark, path, None).agg(F.max("seq"), F.max("size"), F.max("d")).first()
    given, now = _usable(rows, row_id, vector), stored(spark, path)
    if not d:
        d = given.agg(F.mode(F.size("v"))).first()[0] or 0
    given = given.where(F.size("v") == d).join(now.select(F.explode("ids").alias("id")).hint("merge"), "id", "left_anti").groupBy("id").agg(F.min("v").alias("v"))
    dealt = scratch.written(_dealt(given, _centres(spark, path)), "graph-dealt")
    placed = scratch.written(_placed(dealt, now.select("list", "shard", "n"), size), "graph-placed")
    _write(spark, path, placed, now.join(placed.select("shard").distinct(), "shard", "left_semi"), seq + 1, size, d)


def search(queries: DataFrame, path: str, k: int, probe: int | None = None, beam: int = BEAM, exact: bool = False, version: int | None = None, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, similarity and rank of about the ``k`` most similar rows of the index; ties go to the smaller id.

    A query walks the graphs of the ``probe`` lists nearest to it (three quarters of them, at least 8; clustered vectors need fewer) with a beam of ``beam`` nodes. ``exact`` compares it with every node of every
    list. Queries with a null, zero or non-finite vector, or one of another length, find nothing; repeated ones give their rows once.
    """
    spark = queries.sparkSession
    around = _centres(spark, path)
    probe = max(1, len(around)) if exact else probe or max(8, 3 * len(around) // 4)
    d = _commits(spark, path, version).agg(F.max("d")).first()[0] or 0
    asked = _usable(queries, query_id, vector).where(F.size("v") == d).dropDuplicates(["id"])
    asked = scratch.written(_dealt(asked, around, probe), "graph-asked")
    # Queries of a list in blocks of bounded size, in the order of a range partition.
    place = Window.partitionBy("list", "part").orderBy("id")
    parts = asked.withColumn("part", F.spark_partition_id()).withColumn("nth", F.floor((F.row_number().over(place) - 1) / QUERIES))
    packed = parts.groupBy("list", "part", "nth").agg(F.collect_list(F.struct("id", "v")).alias("asked")).drop("part", "nth")
    now = stored(spark, path, version)
    # A row a shard is little; queries are not, though those of many lists lie so well compressed in their file that Spark would take them for it and send them through the driver.
    packed = scratch.written(packed.join(F.broadcast(now.select("list", "shard")), "list").drop("list"), "graph-queries")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids, starts, v, near, far = _read(row)
                q, unit = _unit(np.array([x["v"] for x in row["asked"]], np.float64)), _unit(v)
                if exact:
                    nodes, sims = np.broadcast_to(np.arange(len(unit)), (len(q), len(unit))), q @ unit.T
                else:
                    nodes, sims = _walk(unit, near, far, q, max(beam, k))
                # All nodes as similar as the k-th: ties are told apart by ids. Equal vectors get equal similarities, wherever they lie.
                least = np.partition(sims, -k, axis=1)[:, -k] if k < sims.shape[1] else np.full(len(q), NONE)
                who, which = np.nonzero((nodes >= 0) & (sims >= least[:, None] - 1e-12))
                at = nodes[who, which]
                sim = np.concatenate([(q[who[j : j + 65536]] * unit[at[j : j + 65536]]).sum(1) for j in range(0, max(len(at), 1), 65536)])
                # A node's ids are in order: its k smallest are enough.
                many = np.minimum(starts[at + 1] - starts[at], k)
                again = np.repeat(np.arange(len(at)), many)
                pick = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many) + starts[at][again]
                found, s, of = ids[pick], sim[again], who[again]
                order = np.lexsort((found, -s, of))
                found, s, of = found[order], s[order], of[order]
                nth = np.arange(len(of)) - np.searchsorted(of, of)
                own = np.array([x["id"] for x in row["asked"]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[of[nth < k]]), pa.array(found[nth < k]), pa.array(s[nth < k])], ["query_id", "id", "similarity"])

    met = now.join(packed.hint("merge"), "shard").select("d", "ids", "starts", "vectors", "near", "far", "asked")
    return retrieval.ranked(met.mapInArrow(walk, "query_id long, id long, similarity double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries and rows of the exact result, and the share of its rows (query_id, id) that ``found`` has; 1 where it has none."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    wanted = F.count(F.lit(1))
    return both.agg(F.countDistinct("query_id").alias("queries"), wanted.alias("wanted"), F.coalesce(F.try_divide(F.count("hit"), wanted), F.lit(1.0)).alias("recall"))
