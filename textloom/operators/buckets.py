"""A keyed table in buckets of its key's hash: a merge writes only the buckets that its rows touch, and earlier versions stay readable.

Rows of a version are Parquet under ``rows/_token=.../_bucket=...``; what a version replaces is one row a bucket in ``commits``. A version counts once its commit is written, in
one file by one task, so what a stopped writer leaves is never read. Of two writers that began at one version the second finds the other's commit and fails; a commit looks before it
writes, so writers that commit in the same moment have to be kept apart by their owner.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from textloom.operators import tables

COMMIT = "bucket int, token string, buckets int, fields string"


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def _state(spark: SparkSession, path: str, version: int | None) -> tuple[int, int, StructType, dict[str, list[int]]]:
    """(version, number of buckets, fields, the buckets to be read of each token): at most one entry a bucket reaches the driver."""
    log = spark.read.schema(COMMIT + ", version long").parquet(f"{path}/commits")
    log = log if version is None else log.where(F.col("version") <= version)
    newest = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("version")))
    rows = log.withColumn("_n", newest).where("_n = 1").collect()
    last = max(rows, key=lambda r: r.version)
    held: dict[str, list[int]] = {}
    for r in rows:
        held.setdefault(r.token, []).append(r.bucket)
    return last.version, last.buckets, StructType.fromJson(json.loads(last.fields)), held


def _rows(spark: SparkSession, path: str, fields: StructType, held: dict[str, list[int]], only: set[int] | None = None) -> DataFrame:
    picked = F.lit(False)
    for token, of in held.items():
        wanted = [b for b in of if only is None or b in only]
        if wanted:
            picked |= (F.col("_token") == token) & F.col("_bucket").isin(wanted)
    schema = StructType([*fields.fields]).add("_token", StringType()).add("_bucket", IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/rows").where(picked).drop("_token", "_bucket")


def _commit(rows: DataFrame, path: str, key: str, n: int, touched: list[int], version: int, base: StructType) -> None:
    spark, token = rows.sparkSession, f"t{uuid.uuid4().hex}"
    placed = rows.withColumn("_bucket", _bucket(key, n)).hint("rebalance", "_bucket")
    placed.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{path}/rows/_token={token}")
    _log(spark, path, token, n, touched, version, base)


def _log(spark: SparkSession, path: str, token: str, n: int, touched: list[int], version: int, fields: StructType) -> None:
    log = spark.createDataFrame([(b, token, n, fields.json()) for b in touched], COMMIT).coalesce(1)
    try:
        log.write.mode("errorifexists").parquet(f"{path}/commits/version={version}")
    except Exception as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            raise Conflict(f"version {version} of {path} is another writer's") from error
        raise


def create(df: DataFrame, path: str, key: str, n: int = 256) -> None:
    """Version 1 at ``path``, which must not exist, of all rows. ``n`` buckets: about the bytes of the table over 128 MB, so that a merge of few rows rewrites little; a bucket of many rows is written in several files."""
    _commit(df, path, key, n, list(range(n)), 1, df.schema)


def version(spark: SparkSession, path: str) -> int:
    return _state(spark, path, None)[0]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default: only the folders that hold them are read."""
    _, _, fields, held = _state(spark, path, version)
    return _rows(spark, path, fields, held)


def merge(source: DataFrame, path: str, key: str, base: int | None = None) -> int:
    """``tables.upsert`` of ``source`` into the table as a new version, which it returns; the other buckets stay as they are and are not read.

    ``base`` is the version that the source was worked out from: if it isn't the newest any more, ``Conflict``. Repeated rows of the source all stay; a null key is replaced by no
    row and stays. Columns that only the source has are null in older rows; an empty source is a version that changes nothing. The source is evaluated twice: write it first if that is dear.
    """
    spark = source.sparkSession
    at, n, fields, held = _state(spark, path, None)
    if base is not None and base != at:
        raise Conflict(f"{path} is at version {at}, not {base}")
    touched = sorted(r[0] for r in source.select(_bucket(key, n)).distinct().collect())
    if not touched:
        token = next(iter(held))
        _log(spark, path, token, n, held[token], at + 1, fields)
        return at + 1
    old = _rows(spark, path, fields, held, set(touched))
    wider = StructType([*fields.fields, *[f for f in source.schema.fields if f.name not in fields.names]])
    new = tables.upsert(old, source, key).select(*[F.col(f.name).cast(f.dataType) for f in wider.fields])
    _commit(new, path, key, n, touched, at + 1, wider)
    return at + 1
