"""Audits, tables in buckets, canonical JSON and chunks of raw texts, each against plain Python."""

import json
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import audit, buckets, chunking

RULES = [
    audit.Domain("small", "child", "n > 50", ("id", "n")),
    audit.Unique("pair", "child", ("a", "b")),
    audit.Foreign("parent", "child", ("a", "b"), "parent", ("x", "y")),
    audit.Foreign("self", "child", ("n",), "child", ("id",)),
    audit.Unique("parents", "parent", ("x",)),
]


def brute(child, parent):
    text = lambda r: "|".join("null" if v is None else str(v) for v in r)
    out = {"small": [text((r[0], r[3])) for r in child if r[3] is not None and r[3] > 50]}
    whole = lambda keys: Counter(k for k in keys if None not in k)
    pairs, held, xs = whole((r[1], r[2]) for r in child), {(str(p[0]), str(p[1])) for p in parent if None not in p}, whole((p[0],) for p in parent)
    beyond = lambda counts: [text(k) for k, n in counts.items() for _ in range(n - 1)]
    out |= {"pair": beyond(pairs), "parents": beyond(xs), "parent": [text(k) for k, n in pairs.items() if tuple(map(str, k)) not in held for _ in range(n)]}
    ids = {r[0] for r in child}
    out["self"] = [str(r[3]) for r in child if r[3] is not None and r[3] not in ids]
    return {k: (len(v), None if k == "small" else len(set(v)), min(v, default=None)) for k, v in out.items()}


@pytest.mark.parametrize("rows", [0, 400])
def test_audit(spark, rows):
    rng = random.Random(7)
    some = lambda *v: rng.choice(v)
    child = [(i, "hot" if i % 3 == 0 else some("a", "b|c", "", None, "é"), rng.randrange(30) if i % 3 else 1, some(None, *range(0, 500, 7))) for i in range(rows)]
    parent = [(some("a", "b|c", "hot", None), str(rng.randrange(30))) for _ in range(60)]
    frames = {"child": spark.createDataFrame(child, "id long, a string, b int, n long").withColumn("rule", F.lit("clash")).withColumn("digest", F.lit(1)), "parent": spark.createDataFrame(parent, "x string, y string")}
    got = {r.rule: (r.violations, r.bad_keys, r["sample"]) for r in audit.audited(frames.__getitem__, RULES).collect()}
    assert got == brute(child, parent)
    with pytest.raises(ValueError):
        audit.audited(frames.__getitem__, [RULES[1], RULES[1]])


def test_audit_tells_parts_of_a_key_apart(spark):
    frame = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("1:a", "b"), ("1", ":a1:b")], "a string, b string")
    assert audit.audited(lambda _: frame, [audit.Unique("u", "t", ("a", "b"))]).first().violations == 0


def test_audit_meets_in_one_shuffle_by_key(spark):
    frame = spark.createDataFrame([(1, "a", 2, 3)], "id long, a string, b int, n long")
    plan = audit.audited(lambda n: frame if n == "child" else frame.select(F.col("a").alias("x"), F.col("b").alias("y")), RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and len(re.findall(r"Exchange hashpartitioning\(rule[^)]*digest", plan)) == 1


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_versions_and_conflicts(spark, tmp_path):
    path, fields = str(tmp_path / "t"), "k string, v long"
    frame = lambda rows: spark.createDataFrame(rows, fields)
    first = [(str(i), i) for i in range(200)] + [(None, -1), ("7", 70)]
    buckets.create(frame(first), path, "k", 8)
    change = [("7", 700), ("7", 701), ("new", 1), (None, -2)]
    assert buckets.merge(frame(change), path, "k", base=1) == 2
    second = [r for r in first if r[0] != "7"] + change
    assert rows_of(buckets.read(spark, path)) == sorted(second, key=str) and rows_of(buckets.read(spark, path, 1)) == sorted(first, key=str)
    touched = spark.read.parquet(f"{path}/commits/version=2").count()
    token = spark.read.parquet(f"{path}/commits/version=2").first().token
    assert touched <= 3 and {f"_bucket={r.bucket}" for r in spark.read.parquet(f"{path}/commits/version=2").collect()} == {d for d in os.listdir(f"{path}/rows/_token={token}") if d.startswith("_bucket")}
    with pytest.raises(buckets.Conflict):
        buckets.merge(frame([("8", 0)]), path, "k", base=1)
    assert buckets.merge(frame([]), path, "k") == 3 and buckets.version(spark, path) == 3
    wider = spark.createDataFrame([(True, "8", 88)], "extra boolean, k string, v long")
    assert buckets.merge(wider, path, "k", base=3) == 4
    got = buckets.read(spark, path)
    assert got.columns == ["k", "v", "extra"] and rows_of(got.where("extra")) == [("8", 88, True)] and got.count() == len(second)
    assert rows_of(buckets.read(spark, path, 3)) == sorted(second, key=str)


def test_what_a_stopped_writer_leaves_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(spark.createDataFrame([(1, "a")], "k long, v string"), path, "k", 4)
    spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string").withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{path}/rows/_token=tgone")
    assert rows_of(buckets.read(spark, path)) == [(1, "a")]
    buckets.create(spark.createDataFrame([], "k long, v string"), str(tmp_path / "none"), "k", 4)
    assert buckets.merge(spark.createDataFrame([(5, "x")], "k long, v string"), str(tmp_path / "none"), "k") == 2 and rows_of(buckets.read(spark, str(tmp_path / "none"))) == [(5, "x")]


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=5, deadline=None)
@given(st.lists(VALUES, min_size=40, max_size=80))
def test_canonical_json(spark, values):
    rows = [(json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None), json.dumps(v, ensure_ascii=False, sort_keys=True)) for i, v in enumerate(values)]
    assert spark.createDataFrame(rows, "given string, want string").where(~T.canonical_json(F.col("given")).eqNullSafe(F.col("want"))).collect() == []


def test_what_is_not_json(spark):
    given = [None, "", "{", "[" * 100000, '{"a": 1, "a": 2}', ' [1.50, 1e2, 12345678901234567890123] ', '{"b": "\\u00e9\\/", "B": []}', '"\\ud800"']
    got = [r.x for r in spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", T.canonical_json(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [None, None, None, None, '{"a": 2}', "[1.5, 100.0, 12345678901234567890123]", '{"B": [], "b": "é/"}', '"?"']


def test_chunks_of_raw_texts(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["sun", "moon", "Tax", "rate", "of", "x1", "…", "3.5"])
    made = lambda n: "".join(" ".join(word() for _ in range(rng.randrange(1, 6))) + rng.choice([". ", "? ", "!\n\n", ". ", ", ", ""]) for _ in range(n))
    texts = [None, "", " ", "one", "No end", "a. b", "... ... ...", "A. B. C. D! ", *[made(n) for n in (3, 9, 30, 200)], made(3000)]

    def want(text):
        pieces = re.split(r"(?<=[.?!])\s+", text)
        counts = np.array([np.bincount([zlib.crc32(w.encode()) % 8 for w in re.findall("[a-z0-9]+", s.lower())], minlength=8) for s in pieces], float)
        v = np.array([counts[max(i - 1, 0) : i + 2].sum(0) for i in range(len(pieces))])
        d = [1 - a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) if a.any() and b.any() else 0.0 for a, b in zip(v, v[1:])]
        over = [i + 1 for i, x in enumerate(d) if x > np.percentile(d, 95)] if d else []
        spans = [(b - a, " ".join(pieces[a:b]).strip()) for a, b in zip([0, *over], [*over, len(pieces)])]
        return [s for s in spans if s[1]]

    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0))
    bag = lambda s: T.let(F.transform(words(s), lambda w: F.crc32(w) % 8), lambda b: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.size(F.filter(b, lambda x: x == i))))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("chunk", F.lit("clash"))
    got = {}
    for r in chunking.document_chunks(df, "id", "text", bag).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append((r.sentences, r.chunk))
        assert r.chunk_no == len(got[r.id])
    assert got == {i: want(t) for i, t in enumerate(texts) if t and want(t)}
    assert chunking.document_chunks(df.limit(0), "id", "text", lambda s: V.hashed_words(s, 4)).count() == 0


def test_equal_distances_make_no_break(spark):
    """All steps have a cosine of 4 / 5, which rounding makes larger or smaller; before, the one that came out largest was a break."""
    text = ". ".join(f"{k},{2 * k}" if i % 2 else f"{2 * k},{k}" for i, k in enumerate([5, 17, 7, 17, 1, 5, 3, 9, 3, 13, 3, 17, 1, 7])) + "."
    v = [np.array(eval(f"({x})"), float) for x in text.rstrip(".").split(". ")]
    assert len({1 - a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) for a, b in zip(v, v[1:])}) > 1
    numbers = lambda s: F.transform(F.split(F.replace(s, F.lit("."), F.lit("")), ","), lambda x: x.cast("double"))
    got = chunking.document_chunks(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", numbers, around=0).collect()
    assert [(r.sentences, r.chunk) for r in got] == [(14, text)]
