"""The retrieval functions of a memory database, each from a table of queries to a table of matches.

A query table has query_id and embedding and may have a column for each parameter, which then holds for that query: match_count, filter_category, include_regrets,
verified_only. A memory table has id, embedding and what its function names; rows without a vector never match, and where there is a ``status`` only active rows do.
Matches have query_id, rank, similarity and the memory table's other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import retrieval


def active(df: DataFrame) -> DataFrame:
    """Rows that retrieval may see: active ones with a vector."""
    there = df.where(F.col("embedding").isNotNull())
    return there.where(F.col("status") == "active") if "status" in df.columns else there


def _matches(queries: DataFrame, table: DataFrame, most: int, only: Column | None = None, kind: Column | None = None) -> DataFrame:
    counted = queries if "match_count" in queries.columns else queries.withColumn("match_count", F.lit(most))
    k = counted.agg(F.coalesce(F.max("match_count"), F.lit(0))).first()[0]
    rows = active(table)
    if only is None:
        found = retrieval.nearest(counted, rows, max(1, k))
    else:
        found = retrieval.nearest(counted.withColumn("_kind", only), rows.withColumn("_kind", kind), max(1, k), kind="_kind", null_for_all=True)
    cut = found.join(counted.select("query_id", "match_count"), "query_id").where(F.col("rank") <= F.col("match_count")).drop("match_count")
    return cut.join(table.drop("embedding"), "id")


def _parameter(queries: DataFrame, name: str, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in queries.columns else F.lit(default)


def match_knowledge_chunks(queries: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """Nearest chunks; a query with filter_category sees that category only."""
    wanted = F.col("filter_category").cast("string") if "filter_category" in queries.columns else F.lit(None).cast("string")
    return _matches(queries, chunks, most, wanted, F.col("category"))


def match_knowledge_chunks_v21(queries: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """Nearest chunks; a query with verified_only sees verified ones only."""
    return _matches(queries, chunks, most, F.when(_parameter(queries, "verified_only", False), "verified"), F.col("verification_status"))


def match_persona_rules(queries: DataFrame, rules: DataFrame, most: int = 12) -> DataFrame:
    return _matches(queries, rules, most)


def match_life_experiences(queries: DataFrame, experiences: DataFrame, most: int = 4) -> DataFrame:
    """Nearest experiences; a query with include_regrets false sees none that is a regret. Also for tables without a status, where every row with a vector counts."""
    wanted = F.when(~_parameter(queries, "include_regrets", True), "false")
    return _matches(queries, experiences, most, wanted, F.col("is_regret").cast("string"))


def match_life_experience(queries: DataFrame, decisions: DataFrame, most: int = 5) -> DataFrame:
    """``match_life_experiences`` over the older table, which has no status."""
    return match_life_experiences(queries, decisions.drop("status"), most)


def match_voice_examples(queries: DataFrame, voice: DataFrame, most: int = 6, mode: str = "overfetch") -> DataFrame:
    """Examples by similarity times quality (``score``): the best of four times as many nearest ones, or with ``mode="exact"`` of all rows."""
    counted = queries if "match_count" in queries.columns else queries.withColumn("match_count", F.lit(most))
    k = counted.agg(F.max("match_count")).first()[0] or 1
    rows, asked = active(voice), counted.select("query_id", "match_count")
    if mode == "exact":
        best = retrieval.nearest(counted, rows, k, weight="quality_weight").withColumnRenamed("similarity", "score").join(rows.drop("embedding"), "id")
    else:
        found = retrieval.nearest(counted, rows, k * retrieval.OVERFETCH).join(asked, "query_id").where(F.col("rank") <= F.col("match_count") * retrieval.OVERFETCH).drop("match_count")
        best = retrieval.reranked(found, rows.drop("embedding"), F.col("similarity") * F.col("quality_weight"), k)
    return best.join(asked, "query_id").where(F.col("rank") <= F.col("match_count")).drop("match_count")
