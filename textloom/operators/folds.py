"""Folds over rows in order: what depends on the row before, where no window function can say it."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.operators import packs, scratch

#: A fold gives rows and, at its end, the state that the next rows are to start with.
Fold = Callable[[object, Iterator[dict]], Generator[dict, None, object]]


def over_sorted(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterable[dict]], schema: StructType, rows_at_once: int = 1024) -> DataFrame:
    """``fold`` turns the rows of a key, in order, into rows of ``schema``; it reads its rows to the end.

    Rows are dealt out by key, sorted there and streamed: a task holds what the fold keeps, never a whole key. For keys of bounded size.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        rows = (row for b in batches for row in b.to_pylist())
        for _, own in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            for row in fold(own):
                out.append(row)
                if len(out) >= rows_at_once:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def in_segments(df: DataFrame, keys: list[str], order: list[str], fold: Fold, flush: Callable[[object], Iterable[dict]]) -> DataFrame:
    """``fold`` over each key's rows in order, however many they are: rows with the columns of ``df``, of the fold and, from a key's last state, of ``flush``.

    Rows are dealt out by ranges, so a large key falls into segments, each of which is folded by itself. At first a segment starts without a state (None), as a key does. Then each is
    compared with the end of the one before it, and those that should have started otherwise are folded again, until none is left. Where a fold soon forgets how
    it started, as one that compares neighbours does, that is after a round or two; at worst there are as many rounds as a key has segments. Only states are kept
    in these rounds; rows come in a last pass. Null keys are keys.
    """
    schema, names = df.schema, df.columns
    rows = packs.numbered(df, keys, order).withColumn("_part", F.shiftright("_seq", packs.PART))
    parts = rows.groupBy("_key", "_part").agg(F.lit(1).alias("one"))
    several = scratch.written(parts.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.max("_part").alias("_last")).where("n > 1"), "segment-keys")
    given = lambda own: ({c: r[c] for c in names} for r in own)

    def ends(own: Iterator[dict]) -> Iterator[dict]:
        first = next(own)
        state = pickle.loads(first["_entry"]) if first["_entry"] else None
        run = fold(state, given(r for part in ([first], own) for r in part))
        try:
            while True:
                next(run)
        except StopIteration as done:
            state = done.value
        yield {"_key": first["_key"], "_part": first["_part"], "_entry": first["_entry"], "end": pickle.dumps(state)}

    def folded(own: Iterator[dict]) -> Iterator[dict]:
        first = next(own)
        state = pickle.loads(first["_entry"]) if first["_entry"] else None
        state = yield from fold(state, given(r for part in ([first], own) for r in part))
        if first["_last"] is None or first["_last"] == first["_part"]:
            yield from flush(state)

    large = rows.join(several.select("_key"), "_key", "left_semi")
    shape = StructType.fromDDL("_key string, _part long, _entry binary, end binary")
    found = scratch.written(over_sorted(large.withColumn("_entry", F.lit(None).cast("binary")), ["_key", "_part"], ["_seq"], ends, shape), "segments")
    while True:
        due = found.withColumn("_due", F.lag("end").over(Window.partitionBy("_key").orderBy("_part")))
        wrong = scratch.written(due.where("not (_due <=> _entry)").select("_key", "_part", F.col("_due").alias("_entry")), "segments-due")
        if wrong.isEmpty():
            break
        again = over_sorted(large.join(wrong, ["_key", "_part"]), ["_key", "_part"], ["_seq"], ends, shape)
        found = scratch.written(found.join(wrong.select("_key", "_part"), ["_key", "_part"], "left_anti").select(*shape.names).unionByName(again), "segments")
    entered = rows.join(found.select("_key", "_part", "_entry"), ["_key", "_part"], "left").join(several.select("_key", "_last"), "_key", "left")
    return over_sorted(entered, ["_key", "_part"], ["_seq"], folded, schema)
