"""Helpers that several operators share: scratch tables, row blocks, word splitting and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

#: A word, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a single machine (a ``local`` master, as in tests) gets one of our own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "textloom-scratch")).rstrip("/")


#: Paths of the tables that this process has written.
MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()  # what the driver no longer refers to, shuffle files of the written plan above all, goes now and not at Spark's half-hourly cleaning
    return spark.read.schema(df.schema).parquet(path)


def drop_unread(docs: DataFrame, paths: list[str]) -> None:
    """Delete the tables at ``paths`` and empty the list, unless ``docs`` reads one of them. What was made from them must have been written before."""
    if not paths or any(path.rpartition("/")[2] in f for f in docs.inputFiles() for path in paths):
        return
    jvm, conf = docs.sparkSession._jvm, docs.sparkSession._jsparkSession.sessionState().newHadoopConf()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def text_or_empty(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def word_lists(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of UTF-8 ``data`` in order, in lists from about ``size`` bytes each, so that a huge text never becomes one huge list.

    ``bytes.split`` breaks at exactly the six bytes that ``WORD`` excludes.
    """
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 20
#: Words over so many bytes are hashed by XXH3: long words of a special form can be made to collide in any polynomial modulo 2 ** 64.
LONG_WORD = 48
#: Odd multipliers of the two polynomial word hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    if not _POWERS:
        for base in BASES:
            _POWERS.append(tuple(np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(CHUNK, x % (1 << 64), np.uint64))) for x in (base, pow(base, -1, 1 << 64))))
    return _POWERS


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word of UTF-8 ``data``."""
    inside = np.concatenate(([False], ~SPACE[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashed_words(data: bytes, hashes: int = 2) -> tuple[np.ndarray, ...]:
    """(start, end, hash, other hash) of every word of UTF-8 ``data``, in whole-array steps; only as many hashes as asked for.

    The two 64-bit hashes of a word up to LONG_WORD bytes are polynomials of its bytes with different bases, got from prefix sums a megabyte
    at a time; those of a longer word are the halves of its XXH3 hash.
    """
    arr = np.frombuffer(data, np.uint8)
    starts, ends = word_places(data)
    out = np.empty((hashes, len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
        at, to = starts[i:j] - low, np.minimum(ends[i:j] - low, CHUNK)
        seg = arr[low : low + int(to[-1])].astype(np.uint64) + np.uint64(1)
        for k, (power, inverse) in enumerate(_powers()[:hashes]):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(seg * power[: len(seg)])))
            h = (sums[to] - sums[at]) * inverse[at]
            h ^= h >> np.uint64(31)
            h *= power[5]
            out[k, i:j] = h ^ (h >> np.uint64(29))
        i = j
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        whole = xxh3_128_intdigest(data[starts[i] : ends[i]])
        out[:, i] = (whole >> 64, whole & (1 << 64) - 1)[:hashes]
    return starts, ends, *out


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of ``text`` (a single longer row stays whole)."""
    for batch in batches:
        start = size = 0
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def block_ids() -> Iterator[int]:
    """Numbers for the blocks of this task: the partition in the high bits."""
    base = TaskContext.get().partitionId() << 24
    return iter(range(base, base + (1 << 24)))


def freeze(batch: pa.RecordBatch) -> bytes:
    """All columns of a run of rows as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thaw(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def over_rows(fn: Callable[[dict], Iterator[dict]], schema: pa.Schema, rows_at_once: int = 512) -> Callable:
    """A ``mapInArrow`` function from one that turns a row into rows; output goes out in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(i) for i in range(len(names))]
            for i in range(batch.num_rows):
                for row in fn({n: c[i].as_py() for n, c in zip(names, columns, strict=True)}):
                    out.append(row)
                    if len(out) >= rows_at_once:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (u, v: long) as (node, component), the component being its smallest node.

    Alternating large-star and small-star steps: joins and minimum aggregates only, no neighbour list is ever gathered,
    so a hub with any number of neighbours is split like any skewed join key. Each round is written to the scratch folder.
    Self-loops, repeated and null edges are allowed and ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = written(e, name)
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == seen or not now.n:
            break
        seen = (now.n, now.h)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = written(moved.select("x.u", "x.v").where("u <> v").distinct(), name)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
