"""One audit of several tables: all domain, unique and foreign-key rules in one pass over each table and one shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a key that a report shows.
SHOWN = 80


@dataclass(frozen=True)
class Domain:
    """Rows of ``table`` for which the SQL condition ``bad`` is true break the rule; null is no break. ``shown`` names the columns that tell a row."""

    rule: str
    table: str
    bad: str
    shown: tuple[str, ...]


@dataclass(frozen=True)
class Unique:
    """No two rows of ``table`` share a key. As in SQL, a key with a null in it equals no other."""

    rule: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Foreign:
    """Every key of ``table`` stands in ``parent``; a key with a null in it refers to nothing and is well."""

    rule: str
    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


Rule = Domain | Unique | Foreign


def _entry(rule: int, columns: tuple[str, ...], digest: Column, child: int, parent: int) -> Column:
    shown = F.substring(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 1, SHOWN)
    return F.struct(F.lit(rule).alias("rule"), digest.alias("digest"), shown.alias("shown"), F.lit(child).cast("long").alias("child"), F.lit(parent).cast("long").alias("parent"))


def _key(columns: tuple[str, ...]) -> Column:
    """128 bits of the key's values as text, each with its length; null where one of them is null."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.unhex(F.md5(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])))


def _entries(table: str, rules: list[Rule]) -> list[Column]:
    """What a row of the table has to say to each rule; null where nothing."""
    out = []
    for i, r in enumerate(rules):
        if isinstance(r, Domain) and r.table == table:
            out.append(F.when(F.expr(r.bad), _entry(i, r.shown, F.lit(None).cast("binary"), 1, 0)))
        if not isinstance(r, Domain) and r.table == table:
            out.append(F.when(_key(r.columns).isNotNull(), _entry(i, r.columns, _key(r.columns), 1, 0)))
        if isinstance(r, Foreign) and r.parent == table:
            out.append(F.when(_key(r.parent_columns).isNotNull(), _entry(i, r.parent_columns, _key(r.parent_columns), 0, 1)))
    return out


def audited(tables: Callable[[str], DataFrame], rules: list[Rule]) -> DataFrame:
    """One row a rule: rule, table_name, kind, violations, bad_keys and sample.

    ``violations`` are the rows that break a domain rule, the rows beyond the first of each key of a unique rule, and the rows whose key the parent lacks; ``bad_keys`` is how
    many keys they have (null for domain rules); ``sample`` shows the smallest such key. Every table is read once, with the columns that its rules need. Keys of all
    rules meet in one shuffle by (rule, key); rows of a key are counted before it, so that a key with a third of all rows, or a domain rule that most rows break, is a row a task.
    Names of rules are unique; an empty table breaks nothing, but what refers to it does.
    """
    if len({r.rule for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    names = dict.fromkeys(n for r in rules for n in ([r.table, r.parent] if isinstance(r, Foreign) else [r.table]))
    said = [tables(n).select(F.explode(F.array_compact(F.array(*_entries(n, rules)))).alias("e")).select("e.*") for n in names]
    spark = said[0].sparkSession
    kinds = [(i, r.rule, r.table, type(r).__name__.lower()) for i, r in enumerate(rules)]
    catalogue = spark.createDataFrame(kinds, "_rule int, rule string, table_name string, kind string")
    is_kind = lambda kind: F.col("rule").isin([i for i, _, _, k in kinds if k == kind])
    keys = reduce(DataFrame.unionByName, said).groupBy("rule", "digest").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent"), F.min(F.when(F.col("child") > 0, F.col("shown"))).alias("shown"))
    broken = F.when(is_kind("unique"), F.col("child") - 1).when(is_kind("foreign"), F.when(F.col("parent") == 0, F.col("child")).otherwise(0)).otherwise(F.col("child"))
    found = keys.withColumn("broken", broken).where("broken > 0").groupBy("rule").agg(F.sum("broken").alias("violations"), F.count("digest").alias("bad_keys"), F.min("shown").alias("sample"))
    report = catalogue.join(found.withColumnRenamed("rule", "_rule"), "_rule", "left")
    none = F.lit(0).cast("long")
    return report.select("rule", "table_name", "kind", F.coalesce("violations", none).alias("violations"), F.when(F.col("kind") != "domain", F.coalesce("bad_keys", none)).alias("bad_keys"), "sample")
