"""Review lifecycle and audits: decisions in bulk, duplicates archived, reports and named checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def apply_decisions(candidates: DataFrame, decisions: DataFrame, active: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """candidates (id, kind, content) joined to decisions (id, decision, at and, for edits, text): kind, status, content, match_type and duplicate_of after review.

    ``edit`` sets the content and leaves the row pending; of a row's other decisions the last counts, edits come first. An accepted row whose normalised content is active
    already, or was accepted earlier in the batch (by time, then id), is a duplicate, and so is one that ``similar`` (query_id, duplicate_of; see
    ``retrieval.semantic_duplicates``) finds among the active rows. ``duplicate_of`` is an active row's id, or null for a row of the batch.
    """
    given = decisions if "text" in decisions.columns else decisions.withColumn("text", F.lit(None).cast("string"))
    edit = F.col("decision") == "edit"
    last = F.struct(F.col("at").isNotNull(), "at")
    told = given.groupBy("id").agg(F.max_by(F.when(edit, F.col("text")), F.when(edit, last)).alias("text"), F.max_by("decision", F.when(~edit, last)).alias("decision"), F.max_by("at", F.when(~edit, last)).alias("at"))
    c = candidates.join(told, "id", "left").withColumn("content", F.coalesce("text", "content")).withColumn("print", T.fingerprint(F.col("kind"), F.col("content")))
    held = active.select(T.fingerprint(F.col("kind"), F.col("content")).alias("print"), F.col("id").alias("held") if "id" in active.columns else F.lit(None).cast("long").alias("held")).groupBy("print").agg(F.min("held").alias("held"), F.lit(True).alias("is_active"))
    c = c.join(held, "print", "left")
    near = (similar if similar is not None else c.sparkSession.createDataFrame([], "query_id long, duplicate_of long")).select(F.col("query_id").alias("id"), F.col("duplicate_of").alias("near"))
    c = c.join(near, "id", "left")
    accepted = F.col("decision") == "accept"
    nth = F.sum(F.when(accepted, 1).otherwise(0)).over(Window.partitionBy("print").orderBy(F.asc_nulls_last("at"), "id"))
    match = F.when(~F.coalesce(accepted, F.lit(False)), None).when(F.coalesce("is_active", F.lit(False)) | (nth > 1), "exact_content").when(F.col("near").isNotNull(), "semantic_similarity")
    c = c.withColumn("match_type", match)
    status = F.when(F.col("decision").isNull(), "pending").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "skip", "skipped").when(F.col("match_type").isNotNull(), "duplicate").otherwise("active")
    found = F.when(F.col("match_type") == "exact_content", F.col("held")).when(F.col("match_type") == "semantic_similarity", F.col("near"))
    return c.withColumn("status", status).select("id", "kind", "status", "content", "match_type", found.alias("duplicate_of"))


def archive_duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row with status: the first of each key stays active, the rest are archived with a reason."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).withColumn("status", F.when(F.col("_n") == 1, "active").otherwise("archived")).withColumn("reason", F.when(F.col("_n") > 1, "duplicate")).drop("_n")


def counts(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Several filtered counts in one pass, as (metric, value) rows."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def dashboard(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """``counts`` of several tables, one pass each, as (table_name, metric, value)."""
    parts = [counts(df, metrics).select(F.lit(name).alias("table_name"), "metric", "value") for name, (df, metrics) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def gates(values: DataFrame, limits: dict[str, tuple[int | None, int | None]], reviewed: bool, only_reviewed: tuple[str, ...] = ()) -> DataFrame:
    """(metric, value) rows held against (least, most): columns check, value, ok. Before a review the checks in ``only_reviewed`` are left out; a metric without a row counts as 0."""
    spark = values.sparkSession
    rows = [(n, *limits[n]) for n in limits if reviewed or n not in only_reviewed]
    table = F.broadcast(spark.createDataFrame(rows, "check string, least long, most long"))
    held = table.join(values.select(F.col("metric").alias("check"), "value"), "check", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return held.select("check", "value", (F.coalesce(F.col("value") >= F.col("least"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("most"), F.lit(True))).alias("ok"))


def next_items(items: DataFrame, owner: str = "owner", priority: tuple[str, ...] = ("candidate", "rule", "experience")) -> DataFrame:
    """Each owner's next pending item of (kind, id, created_at, status): by kind in order of priority, then the oldest, then the smallest id."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("kind"))
    first = F.min(F.struct(place.alias("place"), F.col("created_at").isNull().alias("undated"), "created_at", "id", "kind"))
    return items.where((F.col("status") == "pending") & (place > 0)).groupBy(owner).agg(first.alias("n")).select(owner, "n.kind", "n.id", "n.created_at")


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of each rule and whether it holds, in one pass."""
    return counts(df, rules).select(F.col("metric").alias("check"), F.col("value").alias("violations"), (F.col("value") == 0).alias("ok"))


def latest_status(events: DataFrame) -> DataFrame:
    """Of each source type the latest success and error; an error counts only if it is newer than the last success."""
    when = lambda s, c: F.max_by(c, F.when(F.col("status") == s, F.struct("created_at", "event_id")))
    g = events.groupBy("event_type").agg(when("success", "created_at").alias("last_success"), when("error", "created_at").alias("last_error"), when("error", "event_id").alias("error_id"))
    shown = F.col("last_error").isNotNull() & (F.col("last_success").isNull() | (F.col("last_error") > F.col("last_success")))
    return g.withColumn("error_shown", shown)


def profile_fold(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Case-insensitive distinct values of each key in order of first appearance."""
    first = items.where(T.strip(F.col(value)) != "").groupBy(key, F.lower(T.strip(F.col(value))).alias("_v")).agg(F.min(F.struct(order, value)).alias("f"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x[value]).alias("values"))
