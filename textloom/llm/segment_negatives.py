"""Operator 12, hard negatives by segment summaries.

A vector is cut into segments; of each its sum and its deviation (the length of what is left without the mean) are stored. Over a segment two vectors' inner product is
the product of their sums over its length, give or take at most the product of their deviations, and the sums of these over all segments bound the whole product. Coarse
segments come first; what they can't decide is looked at with segments a quarter as long, and only what is still open then is scored, exactly and in whole numbers.

Anchors are a stated query set. Blocks of them meet blocks of all rows; a task keeps what is best so far for each anchor, which raises the bound that
later blocks must reach, and hands on a few rows for each anchor, which a window by anchor puts in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, vector_rows

#: Segments of a vector on each level of summaries; a level with as many segments as entries would be the vector itself.
LEVELS = (4, 16)
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score from which and up to which a negative's score counts.
LEAST, MOST = 30, 90
#: Relative error that is granted to bounds in floating point.
SLACK = 1e-9
#: Share of open pairs of a block from which on the next level is worked out for all its pairs at once rather than one by one.
DENSE = 0.05
#: Anchors in a block.
ANCHORS = 1024
NONE = np.iinfo(np.int64).min


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's segments: the sum over the square root of the length, and the deviation."""
    v = x.astype(np.float64)
    edges = np.unique(np.linspace(0, v.shape[1], segments + 1).astype(int)) if v.shape[1] else np.zeros(1, int)
    size = np.maximum(np.diff(edges), 1)
    mean = np.add.reduceat(v, edges[:-1], axis=1) / size if len(edges) > 1 else np.zeros((len(v), 0))
    left = v - np.repeat(mean, np.diff(edges), axis=1)
    deviation = np.sqrt(np.add.reduceat(left * left, edges[:-1], axis=1)) if len(edges) > 1 else mean
    return mean * np.sqrt(size), deviation


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], at: np.ndarray | None = None, to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(middle, radius) of the inner products of all rows of two summaries, or of the pairs (at, to); the radius holds the rounding as well."""
    (m, d), (n, e) = a, b
    if at is None:
        middle, radius, length = m @ n.T, d @ e.T, np.sqrt((m * m + d * d).sum(1))[:, None] * np.sqrt((n * n + e * e).sum(1))[None, :]
    else:
        middle, radius = np.einsum("ij,ij->i", m[at], n[to]), np.einsum("ij,ij->i", d[at], e[to])
        length = np.sqrt((m * m + d * d).sum(1))[at] * np.sqrt((n * n + e * e).sum(1))[to]
    return middle, radius + SLACK * length + 1


class Side:
    """A block of vectors with its summaries by level, worked out from what was stored."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids, self.labels, self.x, self.levels = ids, labels, x, levels


def open_pairs(a: Side, b: Side, fits: np.ndarray, low: np.ndarray, high: np.ndarray, met: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, exact score) of the pairs in ``fits`` whose score may lie in low..high of their row of ``a``: none that does is left out."""
    at, to = np.nonzero(fits)
    met = {} if met is None else met
    met["pairs"] = met.get("pairs", 0) + len(at)
    for k, (own, other) in enumerate(zip(a.levels, b.levels, strict=True)):
        if not len(at):
            break
        if len(at) >= DENSE * fits.size:
            middle, radius = (x[at, to] for x in _near(own, other))
        else:
            middle, radius = _near(own, other, at, to)
        keep = (middle + radius >= low[at]) & (middle - radius <= high[at])
        at, to = at[keep], to[keep]
        met[f"level{k}"] = met.get(f"level{k}", 0) + len(at)
    if not len(at):
        return at, to, np.zeros(0, np.int64)
    if len(at) >= DENSE * fits.size:
        score = vector_rows.products(a.x, b.x)[at, to]
    elif vector_rows.largest(a.x) * vector_rows.largest(b.x) * max(1, a.x.shape[1]) < vector_rows.EXACT:
        score = np.einsum("ij,ij->i", a.x[at].astype(np.float64), b.x[to].astype(np.float64)).astype(np.int64)
    else:
        score = np.array([vector_rows.products(a.x[i : i + 1], b.x[j : j + 1])[0, 0] for i, j in zip(at, to, strict=True)], np.int64)
    return at, to, score


BLOCK = "block long, ids array<long>, labels array<long>, x binary, means array<binary>, deviations array<binary>"


def blocks(rows: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """Rows (id, label, x: array of longs) packed, as they lie, into blocks with their summaries; written, since every block is read by many tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = common.block_ids()
        for b, x in vector_rows.runs(batches, "x"):
            for k in range(0, len(x), size or max(1, len(x))):
                part, v = b.slice(k, size or len(x)), x[k : k + (size or len(x))]
                levels = [summaries(v, n) for n in LEVELS]
                raw = lambda i, levels=levels: [[m[i].astype("<f8").tobytes() for m in levels]]
                yield pa.RecordBatch.from_arrays([pa.array([next(number)]), *[pa.array([part.column(part.schema.get_field_index(c)).to_pylist()], pa.list_(pa.int64())) for c in ("id", "label")], pa.array([vector_rows.frozen(v)], pa.binary()), pa.array(raw(0), pa.list_(pa.binary())), pa.array(raw(1), pa.list_(pa.binary()))], ["block", "ids", "labels", "x", "means", "deviations"])

    return common.written(rows.select("id", "label", "x").mapInArrow(pack, BLOCK), name)


def _side(row: dict, prefix: str) -> Side:
    x = vector_rows.thawed(row[f"{prefix}x"])
    get = lambda c: [np.frombuffer(m, "<f8").reshape(len(x), -1) for m in row[f"{prefix}{c}"]]
    return Side(np.array(row[f"{prefix}ids"], np.int64), np.array(row[f"{prefix}labels"], np.int64), x, list(zip(get("means"), get("deviations"), strict=True)))


def _same_width(a: Side, b: Side) -> tuple[Side, Side]:
    """Both with vectors of one width; where theirs differ, shorter ones are filled up with zeros and summed up anew."""
    d = max(a.x.shape[1], b.x.shape[1])

    def wide(s: Side) -> Side:
        x = vector_rows.widened(s.x, d)
        return s if x is s.x else Side(s.ids, s.labels, x, [summaries(x, n) for n in LEVELS])

    return wide(a), wide(b)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: each holds two blocks."""
    return (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows))


def _met(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors with every block of rows."""
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    return named(rows, "r_").join(named(anchors, "a_"))


def _first(ids: np.ndarray, scores: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each group by falling score, then id."""
    order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == NONE else -scores, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def positives(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_no, positive_id, positive_score): of each anchor the first ``k`` rows of its label and another id, by falling score, then id.

    ``anchors`` and ``rows`` are tables of ``blocks``. An anchor's rows below the best ``k`` of a task are ruled out by summaries where possible.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for row in _rows(batches):
            a, b = _same_width(_side(row, "a_"), _side(row, "r_"))
            ids, group, old, score = best.get(row["a_block"], (a.ids, *[np.zeros(0, np.int64)] * 3))
            low = np.full(len(a.ids), -np.inf)
            if len(group):
                full = np.bincount(group, minlength=len(ids)) == k
                low[full] = np.array([score[group == i].min() if f else 0 for i, f in enumerate(full)])[full]
            at, to, s = open_pairs(a, b, (a.labels[:, None] == b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :]), low, np.full(len(a.ids), np.inf))
            group, old, score = np.concatenate((group, at)), np.concatenate((old, b.ids[to])), np.concatenate((score, s))
            keep = _first(old, score, group, k)
            best[row["a_block"]] = ids, group[keep], old[keep], score[keep]
        for ids, group, other, score in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids[group]), pa.array(other), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])

    found = _met(anchors, rows).mapInArrow(search, "anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("positive_no", F.row_number().over(w)).where(F.col("positive_no") <= k)


def limits(score: Column) -> tuple[Column, Column]:
    """Whole scores from which and up to which a negative of a positive with this score counts."""
    s = score.cast("decimal(38,0)")
    return F.ceil(s * LEAST / 100).cast("long"), F.floor(s * MOST / 100).cast("long")


def negatives(anchors: DataFrame, rows: DataFrame, bands: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_no, negative_id, negative_score, rank): the first ``k`` rows of another label than the anchor's with a score in low..high.

    ``bands`` has (anchor_id, positive_no, low, high), at most a few for each anchor; they are laid beside the anchors of each block. Summaries rule out what lies under all of an anchor's
    bands or the ``k`` best that its bands have in a task, and what lies over all of them.
    """
    by_anchor = bands.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_no", "low", "high"))).alias("b"))
    opened = anchors.select("block", F.posexplode("ids").alias("pos", "anchor_id")).join(by_anchor, "anchor_id", "left").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda s: s["b"]).alias("bands"))
    asked = common.written(anchors.join(opened, "block"), "negatives-asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for row in _rows(batches):
            a, b = _same_width(_side(row, "a_"), _side(row, "r_"))
            flat = [(i, x["positive_no"], x["low"], x["high"]) for i, own in enumerate(row["a_bands"]) for x in own or [] if x["low"] <= x["high"]]
            if not flat:
                continue
            # Of each band: its row of the block, its number, its limits. What is held: bands, ids and scores of the best so far.
            of, no, low, high = (np.array(c, np.int64) for c in zip(*flat, strict=True))
            _, _, group, other, score = best.get(row["a_block"], (a.ids, no, *[np.zeros(0, np.int64)] * 3))
            least = low.copy()
            if len(group):
                full = np.bincount(group, minlength=len(of)) == k
                worst = np.full(len(of), np.iinfo(np.int64).max)
                np.minimum.at(worst, group, score)
                least[full] = np.maximum(least[full], worst[full])
            bottom, top = np.full(len(a.ids), np.inf), np.full(len(a.ids), -np.inf)
            np.minimum.at(bottom, of, least)
            np.maximum.at(top, of, high)
            at, to, s = open_pairs(a, b, (a.labels[:, None] != b.labels[None, :]) & np.isfinite(bottom)[:, None], bottom, top)
            # Each open pair with each of its anchor's bands that its score lies in.
            n = np.bincount(of, minlength=len(a.ids))
            start = np.concatenate(([0], np.cumsum(n)))
            pair = np.repeat(np.arange(len(at)), n[at])
            band = start[at[pair]] + np.arange(len(pair)) - np.repeat(np.concatenate(([0], np.cumsum(n[at])[:-1])) if len(at) else np.zeros(0, int), n[at])
            inside = (s[pair] >= least[band]) & (s[pair] <= high[band])
            pair, band = pair[inside], band[inside]
            group, other, score = np.concatenate((group, band)), np.concatenate((other, b.ids[to[pair]])), np.concatenate((score, s[pair]))
            keep = _first(other, score, group, k)
            best[row["a_block"]] = a.ids[of], no, group[keep], other[keep], score[keep]
        for anchor, no, group, other, score in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(anchor[group]), pa.array(no[group].astype(np.int32)), pa.array(other), pa.array(score)], ["anchor_id", "positive_no", "negative_id", "negative_score"])

    found = _met(asked, rows).mapInArrow(search, "anchor_id long, positive_no int, negative_id long, negative_score long")
    w = Window.partitionBy("anchor_id", "positive_no").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor: Column, k_positive: int = POSITIVES, k_negative: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows (id, label, x: array of longs) of which those of ``is_anchor`` are asked.

    Rows with a null id, label or x take no part. A shorter vector counts as filled up with zeros; scores beyond a long are its nearest value. A row that stands several times
    is several rows; rows with an anchor's id are never its positives; of anchors with one id that with the smallest label and vector is asked. Ties go to the smaller id.
    An empty table, or one without anchors, gives an empty table.
    """
    there = rows.where("id is not null and label is not null and x is not null").select("id", F.col("label").cast("long").alias("label"), "x")
    everything = blocks(there, "negatives-rows")
    one = there.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "x")).alias("own")).select("id", "own.label", "own.x")
    anchors = blocks(one, "negatives-anchors", ANCHORS)
    near = common.written(positives(anchors, everything, k_positive), "negatives-positives")
    low, high = limits(F.col("positive_score"))
    found = negatives(anchors, everything, near.select("anchor_id", "positive_no", low.alias("low"), high.alias("high")), k_negative)
    return found.join(near, ["anchor_id", "positive_no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mined`` over (vec_id, embedding, label): components as floor(256 * x), every seventh label moved on by one of ten, every hundredth row an anchor.

    Rows whose vector is null or has an entry that is null or not finite take no part; nor do rows without an id or label. See ``mined`` for the other cases.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(vector_rows.usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), vector_rows.whole(F.col("embedding")).alias("x"))
    return mined(rows, F.col("id") % 100 == 0)
