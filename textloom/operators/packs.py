"""Greedy packs of rows in order, however many rows a key has: next-pointers, composed by doubling.

A greedy pack starts where the one before it ends, so packs seem to need one walk through a key's rows. But where a pack ends depends on its start alone: each row has a
pointer to the start of the pack after one that starts there. Rows are placed on an axis by the total size of what comes before them in their key, and the axis is cut
into cells at least as long as a pack: a pointer then leads into its own cell or the next one that has rows. Inside a cell pointers are followed locally, which leaves one
pointer for each row at which a cell can be entered: the cell's border table. The way through all cells is found on border tables alone, by pointer doubling: each round joins
the table with itself and doubles the steps that a pointer makes and the cells that have been reached. So a key with n cells takes log2(n) rounds, and all cells
are worked on at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textloom.operators import scratch

#: Length of a cell, in the unit of the sizes; a pack's limit where that is more.
CELL = 1 << 20
#: Bits of a row's number within its range.
PART = 33


def key_of(key: list[str]):
    """One string for a key of any columns, nulls included."""
    return F.md5(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))


def numbered(rows: DataFrame, key: list[str], order: list[str], *sizes: str) -> DataFrame:
    """All columns with ``_key``, ``_seq`` (rising in the order of ``_key`` and ``order``) and, for each of ``sizes``, ``_at_<size>``: its total over the rows before this one in its key.

    Rows are dealt out by ranges of key and order, so a key's rows spread over tasks; the upper bits of ``_seq`` (PART) number the ranges. A task sums what it has; the sums of the
    parts of a key, one row for each part, give the rest.
    """
    given = rows.withColumn("_key", key_of(key))
    schema = StructType([*given.schema, *[StructField(c, LongType()) for c in ("_seq", *[f"_at_{x}" for x in sizes])]])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, last, totals = TaskContext.get().partitionId() << PART, None, [0] * len(sizes)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("_key").to_numpy(zero_copy_only=False)
            first = np.concatenate(([keys[0] != last], keys[1:] != keys[:-1]))
            group, before = np.cumsum(first), []
            for k, name in enumerate(sizes):
                own = b.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.concatenate(([0], np.cumsum(own)))[:-1] + totals[k]
                before.append(sums - np.concatenate(([0], sums[first]))[group])
                totals[k] = int(before[-1][-1] + own[-1])
            last = keys[-1]
            seqs = pa.array(np.arange(seq, seq + b.num_rows))
            seq += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, seqs, *map(pa.array, before)], schema.names)

    dealt = given.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    out = scratch.written(dealt.mapInArrow(number, schema), "numbered")
    if not sizes:
        return out
    out = out.withColumn("_part", F.shiftright("_seq", PART))
    parts = out.groupBy("_key", "_part").agg(*[F.sum(x).alias(f"_own_{x}") for x in sizes])
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that lie in several parts need this, at most two for each part.
    before = parts.select("_key", "_part", *[F.sum(f"_own_{x}").over(earlier).alias(f"_off_{x}") for x in sizes]).where(f"`_off_{sizes[0]}` is not null")
    out = out.join(before, ["_key", "_part"], "left")
    return out.select(*given.columns, "_seq", *[(F.col(f"_at_{x}") + F.coalesce(f"_off_{x}", F.lit(0))).alias(f"_at_{x}") for x in sizes])


def _ends(p: np.ndarray, limit: int, at_least: bool) -> np.ndarray:
    """For a pack that starts at each row: where the next one starts, by prefix sums ``p``. With ``at_least`` one more than the rows stands for a pack that isn't full yet."""
    if at_least:
        return np.searchsorted(p, p[:-1] + limit, "left")
    return np.maximum(np.arange(1, len(p)), np.searchsorted(p, p[:-1] + limit, "right") - 1)


def _border(sizes: np.ndarray, after: np.ndarray | None, limit: int, at_least: bool) -> Iterator[tuple[int, int, int]]:
    """(row at which the cell is entered, row at which the next cell is, packs that start between) for every row at which it can be."""
    p, q = (np.concatenate(([0], np.cumsum(x))) for x in (sizes, after if after is not None else sizes[:0]))
    n, ends = len(sizes), _ends(p, limit, at_least)
    last, packs = np.arange(n), np.ones(n, np.int64)
    for i in range(n - 1, -1, -1):
        if ends[i] < n:
            last[i], packs[i] = last[ends[i]], packs[ends[i]] + 1
    reach = int(np.searchsorted(p, limit, "left")) + 1 if at_least else int(np.searchsorted(p, limit, "right"))
    for i in range(min(reach, n + 1)):
        if i == n:
            yield n, 0, 0
            continue
        held = p[n] - p[last[i]]
        if at_least:
            to = 0 if held >= limit else min(int(np.searchsorted(q, limit - held, "left")), len(q) - 1)
        else:
            to = 0 if held > limit else max(0, int(np.searchsorted(q, limit - held, "right")) - 1)
        yield i, to, int(packs[i])


def _starts(sizes: np.ndarray, entry: int, limit: int, at_least: bool) -> list[int]:
    ends = _ends(np.concatenate(([0], np.cumsum(sizes))), limit, at_least)
    out, i = [], entry
    while i < len(sizes):
        out.append(i)
        i = int(ends[i])
    return out


def packs(rows: DataFrame, key: list[str], order: list[str], size: str, limit: int, at_least: bool = False, cell: int = CELL) -> DataFrame:
    """The key columns, ``pack_no`` (from 1) and ``rows`` (structs of all columns, in order) of the greedy packs of each key's rows.

    A pack takes rows up to a total ``size`` of ``limit``; a row beyond it is a pack of its own. With ``at_least`` a pack takes rows until they have ``limit``; the last of a key may have less.
    Sizes are whole numbers of 0 or more. ``order`` should be total: ties are in any order. Null keys are keys. An empty table gives an empty table.
    """
    width = max(cell, limit)
    placed = numbered(rows, key, order, size).withColumn("_cell", F.floor(F.col(f"_at_{size}") / width))
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    cells = placed.groupBy("_key", "_cell").agg(F.array_sort(F.collect_list(F.struct("_seq", own.alias("row")))).alias("r"), F.max(F.col(f"_at_{size}") + F.col(size)).alias("end"))
    whole = F.transform("r", lambda x: x["row"])
    cells = scratch.written(cells.select("_key", "_cell", F.transform("r", lambda x: x["row"][size].cast("long")).alias("sizes"), F.floor(F.col("end") / width).alias("next"), whole.alias("rows")), "pack-cells")
    many = scratch.written(cells.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pack-keys")
    most = many.agg(F.max("n").alias("n")).first().n or 1
    # The last cell of a key ends in itself or where no row is.
    bare = cells.where("next > _cell").select("_key", "_cell", "sizes", "next").join(many.select("_key"), "_key", "left_semi")
    follow = cells.select("_key", F.col("_cell").alias("next"), F.col("sizes").alias("after"))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                found = list(_border(np.array(row["sizes"], np.int64), np.array(row["after"], np.int64), limit, at_least))
                entry, to, n = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["_key"]] * len(entry)), pa.array([row["_cell"]] * len(entry), pa.int64()), pa.array(entry, pa.int32()), pa.array([row["next"]] * len(entry), pa.int64()), pa.array(to, pa.int32()), pa.array(n, pa.int64())], ["_key", "_cell", "entry", "next", "to", "n"])

    reached = many.select("_key", F.lit(0).cast("long").alias("_cell"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))
    if most > 1:
        jump = scratch.written(bare.join(follow, ["_key", "next"]).mapInArrow(borders, "_key string, _cell long, entry int, next long, to int, n long"), "pack-borders")
        rounds = math.ceil(math.log2(most))
        for k in range(rounds):
            on = ["_key", "_cell", "entry"]
            step = reached.join(jump, on).select("_key", F.col("next").alias("_cell"), F.col("to").alias("entry"), (F.col("before") + F.col("n")).alias("before"))
            reached = scratch.written(reached.unionByName(step), "pack-reached")
            if k + 1 < rounds:
                second = jump.select("_key", F.col("_cell").alias("next"), F.col("entry").alias("to"), F.col("next").alias("next2"), F.col("to").alias("to2"), F.col("n").alias("n2"))
                jump = scratch.written(jump.join(second, ["_key", "next", "to"]).select("_key", "_cell", "entry", F.col("next2").alias("next"), F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n")), "pack-jumps")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [_starts(np.array(s, np.int64), e, limit, at_least) for s, e in zip(b.column("sizes").to_pylist(), b.column("entry").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_cell"), b.column("before"), pa.array(at, pa.list_(pa.int32()))], ["_key", "_cell", "before", "starts"])

    entered = cells.select("_key", "_cell", "sizes").join(reached, ["_key", "_cell"], "left").select("_key", "_cell", "sizes", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("before", F.lit(0)).alias("before"))
    starts = entered.mapInArrow(cut, "_key string, _cell long, before long, starts array<int>")
    lasts = many.join(cells.groupBy("_key").agg(F.max("_cell").alias("last")), "_key").select("_key", "last")
    led = F.coalesce(F.get("starts", 0) > 0, F.lit(True))  # the first rows belong to the last pack of an earlier cell
    found = cells.select("_key", "_cell", "rows").join(starts, ["_key", "_cell"]).join(lasts, "_key", "left")
    found = found.withColumn("cuts", F.when(led, F.concat(F.array(F.lit(0)), "starts")).otherwise(F.col("starts"))).withColumn("led", led.cast("int"))
    piece = F.transform("cuts", lambda s, i: F.struct(
        (F.col("before") + 1 - F.col("led") + i).alias("pack_no"),
        F.slice("rows", s + 1, F.coalesce(F.get("cuts", i + 1), F.size("rows")) - s).alias("rows"),
        ((i < F.col("led")) | ((i == F.size("cuts") - 1) & F.coalesce(F.col("_cell") < F.col("last"), F.lit(False)))).alias("shared")))
    pieces = found.select("_key", "_cell", F.explode(piece).alias("x")).select("_key", "_cell", "x.*")
    joined = pieces.where("shared").groupBy("_key", "pack_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "rows"))), lambda x: x["rows"])).alias("rows"))
    out = pieces.where("not shared").select("_key", "pack_no", "rows").unionByName(joined)
    return out.select(*[F.get("rows", 0)[k].alias(k) for k in key], "pack_no", "rows")
