"""Operator 11, a quality classifier by Bradley-Terry ranking.

Labelled documents are set against each other in pairs of a better and a worse one. A document's strength is a weighted sum of its text's features; the chance that one
document beats another is the logistic function of the difference of their strengths, so the weights are a logistic regression, without intercept, on feature differences.
Strengths are cut at the quantile that the share of worse documents among the labelled ones gives.

The labelled rows that are learnt from are all used. Each better one meets about ``MEETINGS`` worse ones: both are dealt at random into as many slots as there are rows of
the rarer class, once for each meeting, and those in a slot meet. So pairs grow with the labelled rows and never with their square, and a slot holds a few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Meetings of a row of the commoner class; strength of the ridge penalty; rounds of the fit.
MEETINGS, RIDGE, ROUNDS = 4, 1e-3, 60
#: Where a score counts as good. Scores are set so that the quantile cut falls here.
CUT = 0.3
#: Ranks to either side of the quantile, as a share of each class: the cut lies half-way between the strengths there.
MARGIN = 0.01
#: Relative error of a quantile's rank is one over this.
ACCURACY = 20_000
#: Strengths beyond this many units from the cut count as this far, so that a score never is 0 or 1.
FAR = 30.0

SYMBOLS, STOPS, SHOUTS, INNER = (np.frombuffer(s, np.uint8) for s in (b"#*$%&|<>{}=\\^~_@+[]/", b".,;:", b"!?", b"-'"))
FEATURES = (
    "words", "word_length", "length_spread", "short", "long", "distinct", "distinct_late", "doubles", "repeats", "commonest", "dup_lines", "line_words", "symbols", "stops", "shouts", "capitals",
    "digits", "beyond_ascii", "marked", "lone_marks", "shouted", "sentences", "stop_ends",
)


def _share(part: float, whole: float) -> float:
    return float(part) / max(float(whole), 1.0)


def described(text: str | None) -> list[float]:
    """The FEATURES of a whole text; all are 0 for a text without words. Shares are damped by logarithms, so that the first hundredths count most."""
    data = common.text_or_empty(text)
    starts, ends, h = common.hashed_words(data, 1)
    n = len(starts)
    if not n:
        return [0.0] * len(FEATURES)
    arr = np.frombuffer(data, np.uint8)
    count = np.zeros(256, np.int64)
    for k in range(0, len(arr), common.CHUNK):
        count += np.bincount(arr[k : k + common.CHUNK], minlength=256)
    letters, upper = count[65:91].sum() + count[97:123].sum() + count[192:].sum(), count[65:91].sum()
    size = ends - starts
    chars = int(size.sum())
    _, first, times = np.unique(h, return_index=True, return_counts=True)
    # Words in 8-word windows that the text holds twice or more.
    repeated = 0
    if n >= 9:
        run = np.zeros(n - 7, np.uint64)
        for k in range(8):
            run = (run + h[k : n - 7 + k]) * np.uint64(common.BASES[0]) ^ (run >> np.uint64(29))
        _, place, often = np.unique(run, return_inverse=True, return_counts=True)
        marks = np.zeros(n + 1, np.int64)
        hit = np.flatnonzero(often[place] > 1)
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + 8, -1)
        repeated = int((np.cumsum(marks) > 0).sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    head, tail = arr[starts], arr[ends - 1]
    special = np.zeros(256, bool)
    special[SYMBOLS] = True
    stop = np.zeros(256, bool)
    stop[STOPS] = True
    ends_sentence = np.isin(tail, np.frombuffer(b".!?", np.uint8))
    caps = (head >= 65) & (head <= 90)
    shouted = int(((size > 3) & caps & (arr[np.minimum(starts + 1, len(arr) - 1)] >= 65) & (arr[np.minimum(starts + 1, len(arr) - 1)] <= 90) & (tail >= 65) & (tail <= 90)).sum())
    logged = lambda part, whole: math.log1p(100 * _share(part, whole))
    return [
        math.log1p(n), _share(chars, n), math.log1p(float(size.std())), _share((size <= 3).sum(), n), logged((size > 20).sum(), n),
        math.log(len(first) / math.sqrt(n)), _share((first >= n // 2).sum(), n), logged((h[1:] == h[:-1]).sum(), n), logged(repeated, n), logged(times.max(), n), logged(len(lines) - len(set(lines)), len(lines)), math.log1p(n / len(lines)),
        logged(count[SYMBOLS].sum(), chars), logged(count[STOPS].sum(), n), logged(count[SHOUTS].sum(), n), logged(upper, letters), logged(count[48:58].sum(), chars), logged(count[128:].sum(), chars),
        logged(special[tail].sum(), n), logged(((size == 1) & special[tail]).sum(), n), logged(shouted, n), logged((ends_sentence[:-1] & caps[1:]).sum(), n), logged(stop[tail].sum(), n),
    ]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, features) of every row of ``docs``: all its columns as a struct, and the features of its whole text as an array of doubles."""
    given = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    kind = given.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in common.slices([x], "text")):
            own = pa.array([described(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("row"), own], ["row", "features"])

    return given.mapInArrow(run, f"row {kind}, features array<double>")


def pairs(labelled: DataFrame, seed: int = 42) -> DataFrame:
    """Feature differences of pairs of a better and a worse row of (id, quality, features): ``label`` 1 where the better one comes first, 0 where it is taken away."""
    counts = {r.quality: r.n for r in labelled.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = max(1, min(counts.get(0, 0), counts.get(1, 0)))
    dealt = labelled.select("quality", "features", "id", F.explode(F.sequence(F.lit(1), F.lit(MEETINGS))).alias("meeting")).withColumn("slot", F.pmod(F.xxhash64("id", "quality", F.col("meeting") + seed), F.lit(slots)))
    side = lambda q, name: dealt.where(F.col("quality") == q).select("meeting", "slot", F.col("features").alias(name), F.col("id").alias(f"{name}_id"))
    met = side(1, "better").join(side(0, "worse"), ["meeting", "slot"])
    first = F.pmod(F.xxhash64("better_id", "worse_id", "meeting"), F.lit(2)) == 0
    return met.select(F.zip_with("better", "worse", lambda a, b: F.when(first, a - b).otherwise(b - a)).alias("difference"), first.cast("double").alias("label"))


def fitted(labelled: DataFrame, seed: int = 42) -> np.ndarray:
    """A weight for each of the features; zeros where one of the classes is missing."""
    met = common.written(pairs(labelled, seed).select(array_to_vector("difference").alias("features"), "label"), "rank-pairs")
    seen = {r.label for r in met.select("label").distinct().collect()}
    if len(seen) < 2:
        return np.zeros(len(FEATURES)) if not seen else _single(met)
    model = LogisticRegression(fitIntercept=False, regParam=RIDGE, maxIter=ROUNDS, standardization=True).fit(met)
    return model.coefficients.toArray()


def _single(met: DataFrame) -> np.ndarray:
    """Weights from pairs that all stand the same way round, as a few may: the mean difference."""
    from pyspark.ml.stat import Summarizer

    signed = met.select(Summarizer.mean(F.col("features")).alias("m"), F.max("label").alias("label")).first()
    return signed.m.toArray() * (1 if signed.label else -1)


def strength(features: Column, weights: np.ndarray) -> Column:
    by = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(features, by, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def cut(labelled: DataFrame, weights: np.ndarray) -> float:
    """The strength at the quantile that the share of worse rows gives: half-way between those a little under and a little over it; 0 without rows."""
    s = strength(F.col("features"), weights)
    share = labelled.agg(F.avg((F.col("quality") == 0).cast("double")).alias("s")).first().s
    if share is None:
        return 0.0
    under, over = max(0.0, share * (1 - MARGIN)), min(1.0, share + (1 - share) * MARGIN)
    low, high = labelled.agg(F.percentile_approx(s, [under, over], ACCURACY).alias("q")).first().q
    return (low + high) / 2


def ranked(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``row`` (all columns of ``docs``), held_out, strength, score and predicted of every row.

    Learns from the rows of ``docs`` that are not held out and have a quality of 0 or 1 in ``labels`` (doc_id, quality); where a document's labels differ, 0 counts. A null text
    counts as empty and is scored like any; a null doc_id has no label and isn't held out; repeated rows get equal scores. Columns of other names, clashing ones
    too, stay in ``row``. Without labels of both classes all strengths are 0 and all scores CUT. An empty table gives an empty table.
    """
    rows = common.written(with_features(docs).select("row", "features", F.coalesce(held_out, F.lit(False)).alias("held_out")), "rank-rows")
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    learnt = rows.where("not held_out").select(F.col(f"row.{key}").alias("id"), "features").join(marked, "id")
    learnt = common.written(learnt.select("id", "quality", "features"), "rank-labelled")
    weights = fitted(learnt, seed)
    at = cut(learnt, weights)
    unit = math.log(CUT / (1 - CUT))
    s = strength(F.col("features"), weights)
    far = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), s - at))
    # The cut itself is decided on strengths: rounding of the logistic function can't move a row over it.
    score = 1 / (1 + F.exp(-(far + unit)))
    good = s >= at
    score = F.when(good, F.greatest(score, F.lit(CUT))).otherwise(F.least(score, F.lit(math.nextafter(CUT, 0.0))))
    return rows.select("row", "held_out", s.alias("strength"), score.alias("score"), good.cast("int").alias("predicted"))


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; see ``ranked``."""
    out = ranked(docs.select("doc_id", "text"), labels, held_out(F.col("row.doc_id")))
    return out.select("row.doc_id", "held_out", "score", "predicted")
