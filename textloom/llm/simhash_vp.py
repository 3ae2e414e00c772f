"""Operator 2, SimHash near-dedup with vantage-point trees.

Fingerprints are routed down a vantage-point tree over their Hamming distances. A node keeps a vantage fingerprint and a radius:
those within the radius go to the inner child, the others to the outer one. By the triangle inequality two fingerprints within r bits can
only be parted at a node if the inner one lies within r of the boundary, so exactly these inner ones are copied to the outer child too. Each
pair within r bits therefore meets in some shard, and shards need no further look at each other. Inside a shard the same
partition goes on until few fingerprints are left, which are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: The routing tree is fitted on at most about this many distinct fingerprints; every fingerprint is routed through it.
SAMPLE = 40_000
#: Distinct fingerprints a shard should hold before copies.
SHARD = 4096
#: From here on a shard's part is compared exactly.
LEAF = 384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles (repeats count), as an unsigned number; 0 without words."""
    ones, n, carry = np.zeros(64, np.int64), 0, []
    for words in common.word_lists(common.text_or_empty(text).lower()):
        words = carry + words
        for at in range(0, max(0, len(words) - shingle + 1), 65536):
            part = words[at : at + 65536 + shingle - 1]
            h = np.array([xxh64_intdigest(b" ".join(t), SEED) for t in zip(*(part[k:] for k in range(shingle)), strict=False)], ">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(h)
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if not n and carry:
        return xxh64_intdigest(b" ".join(carry), SEED)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``keep`` columns of every row and ``name`` (long, the fingerprint's bits)."""
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [signed(fingerprint(t.as_py(), shingle)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(fp, pa.int64())], ["row", "fp"])

    kind = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(run, f"row {kind}, fp long").select("row.*", F.col("fp").alias(name))


# ---- the tree


def _split(points: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage fingerprint and a radius that part ``points`` with few copies; None if nothing parts them usefully."""
    best = None
    for vantage in rng.choice(points, min(12, len(points)), replace=False):
        d = np.bitwise_count(points ^ vantage)
        upto = np.cumsum(np.bincount(d, minlength=66))
        for radius in range(65):
            inner = int(upto[radius])
            if not 0.2 * len(points) <= inner <= 0.8 * len(points):
                continue
            copies = inner - int(upto[radius - bits] if radius >= bits else 0)
            cost = max(inner, len(points) - inner + copies) + 0.7 * copies
            if best is None or cost < best[0]:
                best = cost, int(vantage), radius, len(points) - inner + copies
    return None if best is None or best[3] > 0.92 * len(points) else best[1:3]


def fit(sample: np.ndarray, depth_size: int, bits: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inner, outer); a leaf has radius -1. ``depth_size``: sample points at which a node becomes a shard."""
    rng, nodes = np.random.default_rng(7), []

    def grow(points: np.ndarray) -> int:
        me = len(nodes)
        nodes.append((0, -1, 0, 0))
        found = _split(points, bits, rng) if len(points) > depth_size else None
        if found:
            d = np.bitwise_count(points ^ np.uint64(found[0]))
            nodes[me] = (*found, grow(points[d <= found[1]]), grow(points[d > found[1]]))
        return me

    grow(sample)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of its fingerprints), copies at the boundary included."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        vantage, radius, inner, outer = nodes[node]
        if not len(at):
            continue
        if radius < 0:
            yield node, at
            continue
        d = np.bitwise_count(points[at] ^ np.uint64(vantage))
        todo += [(inner, at[d <= radius]), (outer, at[d > radius - bits])]


def _exact(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Links inside ``points``, as groups around a member: a breadth-first walk that measures each fingerprint against the unvisited ones only."""
    if len(points) > 8192:
        yield from (_by_flips if bits <= 2 else _by_blocks)(points, bits)
        return
    yield from _walked(points, bits)


def _walked(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    if len(points) <= 2 * LEAF:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= bits
        points = points[near.sum(1) > 1]
    rest = points
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        group = []
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for x in front:
                hit |= np.bitwise_count(rest ^ x) <= bits
            front, rest = rest[hit], rest[~hit]
            group.append(front)
        group = np.concatenate(group) if group else front[:0]
        if len(group):
            yield group, int(root)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that ``a`` and ``b`` (positions, pairwise linked) reach the smallest label among them, in place."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def _labelled(points: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    order = np.argsort(label, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(at) > 1:
            yield points[at[1:]], int(points[at[0]])


def _by_flips(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """For a ball that no vantage point parts: look up every fingerprint with up to ``bits`` bits flipped, in linear time; each link found unites both ends."""
    points = np.sort(points)
    label = np.arange(len(points))
    for m in (sum(1 << b for b in c) for k in range(1, bits + 1) for c in combinations(range(64), k)):
        other = points ^ np.uint64(m)
        at = np.minimum(np.searchsorted(points, other), len(points) - 1)
        hit = np.flatnonzero((points[at] == other) & (other < points))
        if len(hit):
            _unite(label, hit, at[hit])
    yield from _labelled(points, label)


def _by_blocks(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """The same for more bits, where flips are too many: fingerprints within ``bits`` bits agree in one of ``bits`` + 1 blocks of bits, so those
    that share a block are walked together."""
    points = np.sort(points)
    label = np.arange(len(points))
    cuts = [64 * k // (bits + 1) for k in range(bits + 2)]
    for low, high in zip(cuts, cuts[1:]):  # noqa: B905
        key = points >> np.uint64(low) & np.uint64((1 << high - low) - 1)
        order = np.argsort(key, kind="stable")
        a, b = [], []
        for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            for members, root in _walked(points[at], bits) if len(at) > 1 else ():
                a.append(members)
                b.append(np.full(len(members), root, np.uint64))
        if a:
            _unite(label, np.searchsorted(points, np.concatenate(a)), np.searchsorted(points, np.concatenate(b)))
    yield from _labelled(points, label)


def links(points: np.ndarray, bits: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, int]]:
    """Groups (members, a fingerprint that they reach through links) that connect all of ``points`` within ``bits`` bits."""
    rng, todo = np.random.default_rng(7), [points]
    while todo:
        p = todo.pop()
        found = _split(p if len(p) <= 4096 else rng.choice(p, 4096, replace=False), bits, rng) if len(p) > leaf else None
        if not found:
            yield from _exact(p, bits)
            continue
        d = np.bitwise_count(p ^ np.uint64(found[0]))
        parts = [p[d <= found[1]], p[d > found[1] - bits]]
        if max(map(len, parts)) > 0.95 * len(p):
            yield from _exact(p, bits)
        else:
            todo += parts


def linked_components(fps: DataFrame, bits: int = MAX_BITS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(fp, component) for the distinct non-null longs in ``fps.fp`` that have a link; component: a fingerprint of the group."""
    nodes_df = common.written(fps.select("fp").where("fp is not null").distinct(), "vp-nodes")
    n = nodes_df.count()
    share = min(1.0, sample / max(n, 1))
    picked = nodes_df.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp")
    points = np.array([r.fp for r in picked.collect()], np.int64).view(np.uint64)
    tree = fit(np.sort(points), max(16, int(shard * share)), bits)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for node, at in route(tree, fp, bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), node, np.int32)), pa.array(fp[at].view(np.int64))], ["shard", "fp"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(links(pdf["fp"].to_numpy(np.int64).view(np.uint64), bits))
        u = np.concatenate([m for m, _ in found]) if found else np.zeros(0, np.uint64)
        v = np.concatenate([np.full(len(m), r, np.uint64) for m, r in found]) if found else u
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    edges = nodes_df.mapInArrow(routed, "shard int, fp long").groupBy("shard").applyInPandas(compare, "u long, v long")
    return common.components(edges, "vp-components").select(F.col("node").alias("fp"), "component")


def near_duplicate_components(docs: DataFrame, bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of at most ``bits`` bits) of every row.

    A null text counts as empty; documents without words share fingerprint zero. Rows with a null doc_id take part
    in links but never name a component (null component_id if a group has no other id). Repeated rows stay. Empty in, empty out.
    """
    fps = common.written(with_fingerprints(docs, ["doc_id"], shingle=shingle), "simhash")
    found = linked_components(fps, bits)
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = ids.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(roots, "component").select("fp", "component_id")
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, bits: int, shingle: int) -> DataFrame:
    """The rows of ``docs``, all columns, less those of a linked group that aren't its first (smallest doc_id; ties: any one of equal rows).

    A null text counts as empty; rows with a null doc_id come last in their group. Extra columns, clashing names included, pass through.
    """
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    fps = common.written(with_fingerprints(whole, ["row", "id"], shingle=shingle), "simhash-rows")
    found = linked_components(fps, bits)
    local = fps.groupBy("fp").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row"), F.min(F.struct(F.col("id").isNull(), "id")).alias("key"))
    grouped = local.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = grouped.groupBy("component").agg(F.min_by("row", F.struct("key", "fp")).alias("row"))
    return best.select("row.*")
