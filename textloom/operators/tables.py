"""Set-like jobs over keyed tables: insert-if-new, upsert, resume, latest, conflicts, ledgers, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; a plain rank, so which row survives is stated."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def insert_new(source: DataFrame, target: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of ``source`` to append: the first of each key that the target lacks."""
    return first_of(source, [key], order).join(target.select(key), key, "left_anti")


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return target.join(source.select(key), key, "left_anti").unionByName(source, allowMissingColumns=True)


def pending(all_keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: keys not finished with status ok."""
    return all_keys.join(done.where("status = 'ok'").select(key), key, "left_anti")


def conflicts(df: DataFrame, keys: list[str], row_id: str, newest: Column) -> DataFrame:
    """Winner (newest) and sorted losers of each key with more than one row."""
    groups = df.groupBy(*keys).agg(F.max_by(row_id, newest).alias("winner"), F.sort_array(F.collect_list(row_id)).alias("ids"))
    return groups.where(F.size("ids") > 1).select(*keys, "winner", F.array_remove("ids", F.col("winner")).alias("losers"))


def conflict_log(found: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Rows for an append log of ``conflicts``: subject (the keys, joined by bars), winner, losers, at."""
    return found.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("subject"), "winner", "losers", at.alias("at"))


def next_versions(new: DataFrame, existing: DataFrame, key: str, order: Column, version: str = "version") -> DataFrame:
    top = existing.groupBy(key).agg(F.max(version).alias("_top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.join(top, key, "left").withColumn(version, F.coalesce("_top", F.lit(0)) + n).drop("_top")


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """Row count and an order-free digest: the sum of the first 48 bits of each row's MD5; a field comes with its length, so a null differs from an empty one."""
    fields = [F.col(c).cast("string") for c in df.columns]
    row = F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields])
    return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """One row of ``snapshot`` for each table."""
    rows = [snapshot(df, name) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def export(df: DataFrame, path: str) -> None:
    """The rows as JSON lines, fields in the order of their names, nulls kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def run_report(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows by status."""
    return df.groupBy(F.coalesce(status, F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def import_report(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """How many rows ``insert_new`` would append (``remaining``) and pass over (``skipped``)."""
    held = target.select(key).distinct().withColumn("_has", F.lit(True))
    new = F.countDistinct(F.when(F.col("_has").isNull(), F.col(key)))
    return source.select(key).join(held, key, "left").agg(new.alias("remaining"), (F.count(F.lit(1)) - new).alias("skipped"))


def deprecated(df: DataFrame, losers: DataFrame, row_id: str) -> DataFrame:
    """``is_deprecated`` set for the rows whose id is in the ``losers`` arrays of ``conflicts``."""
    gone = losers.select(F.explode("losers").alias(row_id)).distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, row_id, "left").withColumn("is_deprecated", F.coalesce("_gone", F.lit(False))).drop("_gone")


def publish_ledger(requests: DataFrame) -> DataFrame:
    """One accepted request for each token (the earliest from an allowed state); the others are duplicates or rejected."""
    allowed = F.col("state").isin("approved", "publishing")
    nth = F.sum(F.when(allowed, 1).otherwise(0)).over(Window.partitionBy("token").orderBy("at", "request_id"))
    return requests.withColumn("outcome", F.when(~allowed, "rejected").when(nth == 1, "accepted").otherwise("duplicate"))


def systematic_sample(df: DataFrame, order: str, m: int, buckets: int | None = None) -> DataFrame:
    """Rows at floor(i * n / m) for i below m in the order of ``order``, a unique numeric key without nulls.

    Rows are numbered within ranges of the key and the counts of earlier ranges added. The bounds of the ranges are worked out once and stand in the plan, so that every
    pass deals the rows out alike; any bounds give the same numbers.
    """
    spark = df.sparkSession
    buckets = buckets or spark.sparkContext.defaultParallelism
    marks = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)] or [0.5])).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(marks))]) if marks else F.array().cast("array<double>")
    ranged = df.withColumn("_part", F.size(F.filter(bounds, lambda x: x < F.col(order))))
    counts = {r._part: r.n for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, offsets, at = sum(counts.values()), [], 0
    if total < m:
        raise ValueError(f"{total} rows are fewer than {m}")
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    place = local.join(F.broadcast(spark.createDataFrame(offsets, "_part int, _before long")), "_part").withColumn("position", F.col("_before") + F.col("_n"))
    i = f"(position * {m} + {total - 1}) div {total}"  # the first i with i * n / m at or beyond the position
    return place.where(f"{i} < {m} and ({i}) * {total} div {m} = position").drop("_part", "_n", "_before")
