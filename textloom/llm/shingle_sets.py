"""Near-duplicates by the similarity of word-shingle sets: candidates from SimHash groups and shared shingles, each confirmed on the whole texts.

A document's keys are the ``KEYS`` smallest hashes of its shingle set. Two sets with Jaccard similarity s share none of them with a chance of
about (1 - s) ** KEYS, 1e-17 at 0.8. Holders of a key are put in two orders and linked to the ``NEXT`` holders before them in each: by the key that follows in each
document, which brings those together that share more than this key; and by how many of their keys other documents hold at all, which brings those together that are
nearest to what a crowd has in common, for two sets cannot be more alike than the shares of them that stand elsewhere. Up to ``NEXT`` + 1 holders
of a key all meet. What these links leave apart in a crowd, a key with more holders, is settled by all pairs of its holders in different groups: blocks of a bounded
number of holders meet, and pairs that share enough keys are compared as whole sets, block with block. Groups are the work of the links; where few holders of
a crowd are alike enough to be grouped, that step grows with the square of the crowd, spread over tasks of bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash_vp

KEYS, NEXT, LIKELY, CROWD = 24, 3, 7 / 24, 100_000
#: Holders of a crowd's key that meet at once, and sets and bytes of their hashes in a block that is compared with others.
CELL, BLOCK_SETS, BLOCK_BYTES = 1024, 512, 4 << 20
#: Bits of their sets' SimHash that two holders of a commoner key may differ in: at a similarity of 0.8 about 10 do, and more than this with a chance of about 1e-5.
BITS = 22
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, odd in zip((30, 27), MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles in lower case; a shorter text is one shingle, a text without words the number 0."""
    _, _, h, g = common.hashed_words(common.text_or_empty(text).lower())
    h = h ^ _mixed(g)
    n = min(words, len(h))
    if not n:
        return np.zeros(1, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> int:
    """64-bit SimHash of the set: a bit is 1 if it is in over half of the hashes."""
    ones = sum(np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for k in range(0, len(hashes), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose whole texts have shingle sets of similarity ``least`` or more."""
    sides = pairs.join(texts.select(F.col("sig").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("sig").alias("v"), F.col("text").alias("b")), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (similarity(shingles(x.as_py(), words), shingles(y.as_py(), words)) >= least for x, y in zip(b.column("a"), b.column("b"), strict=True))
            good = pa.array(own, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(good), b.column("v").filter(good)], ["u", "v"])

    return sides.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Without the pairs that share under LIKELY of the ``KEYS`` smallest hashes of their union: at a similarity of 0.8 a chance of about 1e-9."""
    keys = lambda c, name: sets.select(F.col("sig").alias(c), F.col("keys").alias(name))
    least = F.slice(F.array_sort(F.array_union("a", "b")), 1, KEYS)
    shared = F.size(F.array_intersect(least, F.array_intersect("a", "b")))
    return pairs.join(keys("u", "a"), "u").join(keys("v", "b"), "v").where(shared >= LIKELY * F.size(least)).select("u", "v")


def _shared_keys(sets: DataFrame) -> DataFrame:
    """A row for each set and each of its keys that another set holds too: sig, size, sketch, key, next (key), holders, elsewhere (such keys of the set). Written."""
    after = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("keys", (i + 1) % F.size("keys")).alias("next")))
    held = sets.select("sig", "size", "sketch", F.explode(after).alias("x")).select("sig", "size", "sketch", "x.key", "x.next")
    holders = common.written(held.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "near-holders")
    shared = common.written(held.join(holders, "key"), "near-shared")
    standing = common.written(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("elsewhere")), "near-standing")
    return shared.join(standing, "sig")


def _neighbours(ranked: DataFrame, least: float) -> DataFrame:
    """(sig, others): links to the NEXT holders before in each of two orders, of those that size and sketch allow, a list with repeats for each set: at most 2 * NEXT * KEYS long.

    Where ``ranked`` has a ``place``, only links between sets in different places.
    """
    # A crowd beyond CROWD holders is cut into parts, by the order itself or at random, so that no task gets a key's every row.
    parts = F.ceil(F.col("holders") / CROWD)
    by_next = F.pmod(F.shiftrightunsigned("next", 16), F.lit(1 << 48)) * parts / F.lit(1 << 48)
    placed = "place" in ranked.columns
    near = []
    for part, order in ((F.floor(by_next), ["next", F.xxhash64("sig", "key")]), (F.pmod(F.xxhash64("sig", "key"), parts), [F.desc("elsewhere"), F.xxhash64("key", "sig")])):
        w = Window.partitionBy("key", "part").orderBy(*order)
        before = F.array(*[F.lag(F.struct("sig", "size", "sketch", *["place"] * placed), k).over(w) for k in range(1, NEXT + 1)])
        apart = lambda y: (F.col("place") != y["place"]) if placed else F.lit(True)
        fits = lambda y: apart(y) & (F.least("size", y["size"]) >= least * F.greatest("size", y["size"])) & ((F.col("holders") <= NEXT + 1) | (F.bit_count(F.col("sketch").bitwiseXOR(y["sketch"])) <= BITS))  # noqa: E731, B023
        met = ranked.withColumn("part", part.cast("long")).withColumn("before", F.filter(before, fits)).where("size(before) > 0")
        near.append(met.select("sig", F.transform("before", lambda y: y["sig"]).alias("others")))
    return near[0].union(near[1]).groupBy("sig").agg(F.flatten(F.collect_list("others")).alias("others"))


def _groups(prints: DataFrame, bits: int) -> DataFrame:
    """(sig, other): every set with the set that stands for its SimHash group's root, and with one that has its fingerprint. Written."""
    groups = simhash_vp.linked_components(prints, bits)
    holder = prints.groupBy("fp").agg(F.min("sig").alias("other"))
    root = prints.join(groups, "fp", "left").select("sig", F.coalesce("component", "fp").alias("fp")).join(holder, "fp").select("sig", "other")
    return common.written(root.union(prints.join(holder, "fp").select("sig", "other")).where("sig <> other"), "near-groups")


def _ends(links: DataFrame) -> DataFrame:
    """Distinct (u, v), u > v, of links (sig, other)."""
    return links.where("sig <> other").select(F.greatest("sig", "other").alias("u"), F.least("sig", "other").alias("v")).distinct()


def _joining(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As few of the pairs as join what all of them join: fewer than they have ends."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for x, y in pairs:
        a, b = top(x), top(y)
        if a != b:
            root[a] = b
            kept.append((x, y))
    return kept


def _set_places(sets: DataFrame) -> DataFrame:
    """sig, block and nth: sets (sig, near, size) dealt into blocks of a bounded number of sets and of bytes of their hashes, those with neighbouring ``near`` together. Written."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, size = common.block_ids(), 0, 0
        block = next(number)
        for b in batches:
            blocks, nth = [], []
            for own in b.column("size").to_pylist():
                if n and (n == BLOCK_SETS or size + 8 * own > BLOCK_BYTES):
                    block, n, size = next(number), 0, 0
                blocks.append(block)
                nth.append(n)
                n, size = n + 1, size + 8 * own
            yield pa.RecordBatch.from_arrays([b.column("sig"), pa.array(blocks, pa.int64()), pa.array(nth, pa.int64())], ["sig", "block", "nth"])

    ordered = sets.repartitionByRange("near", "sig").sortWithinPartitions("near", "sig").select("sig", "size")
    return common.written(ordered.mapInArrow(deal, "sig long, block long, nth long"), "near-crowd-places")


def _hashed(texts: DataFrame, words: int) -> DataFrame:
    """sig and the hashes of its set, of texts (sig, text)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in common.slices([x], "text")):
            yield pa.RecordBatch.from_arrays([b.column("sig"), pa.array([shingles(t, words).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["sig", "hashes"])

    return texts.select("sig", "text").mapInArrow(describe, "sig long, hashes binary")


def _crowd_pairs(held: DataFrame, least: float) -> DataFrame:
    """(a, b, pairs): places in two blocks of all pairs of sets in different places that share enough keys, from rows (key, holders, part, block, nth, place, size, keys) of crowds.

    A pair is found at the smallest key that it shares, so once. It needs LIKELY of its keys, as in ``_likely``: pairs that share a key which is none of a crowd have met before.
    """
    parts = F.ceil(F.col("holders") / CELL).cast("long")
    own = F.pmod(F.xxhash64("block", "nth", "key"), parts)
    dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cell = [F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")]
    cells = dealt.groupBy("key", *cell).agg(F.collect_list(F.struct("own", "block", "nth", "place", "size", "keys")).alias("r"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, x, y, row in zip(b.column("key").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("r"), strict=True):
                r = row.values
                part, block, nth, place, size = (r.field(c).to_numpy() for c in ("own", "block", "nth", "place", "size"))
                lists = r.field("keys")
                n = lists.value_lengths().to_numpy()
                values, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
                # Each set's keys in rising order, a row; no key has the number of none.
                table = np.full((len(n), int(n.max())), len(values))
                table[np.arange(table.shape[1]) < n[:, None]] = ids
                this, has = int(np.searchsorted(values, key)), np.zeros(len(values) + 1, bool)
                left = np.flatnonzero(part == x)
                code, found = block * BLOCK_SETS + nth, []
                for i in left.tolist():
                    there = np.flatnonzero((part == y) & (place != place[i]) & (np.minimum(size, size[i]) / np.maximum(size, size[i]) >= least))
                    if x == y:
                        there = there[there > i]
                    if not len(there):
                        continue
                    has[table[i]] = True
                    has[-1] = False
                    shared = has[table[there]]
                    has[table[i]] = False
                    enough = shared.sum(1) >= LIKELY * np.minimum(KEYS, np.maximum(size[there], size[i]))
                    first = table[there, shared.argmax(1)] == this
                    there = there[enough & first]
                    found.append(np.stack([np.minimum(code[there], code[i]), np.maximum(code[there], code[i])]))
                u, v = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
                if not len(u):
                    continue
                order = np.lexsort((v // BLOCK_SETS, u // BLOCK_SETS))
                u, v = u[order], v[order]
                ends = np.flatnonzero(np.append((u[1:] // BLOCK_SETS != u[:-1] // BLOCK_SETS) | (v[1:] // BLOCK_SETS != v[:-1] // BLOCK_SETS), True)) + 1
                for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    pairs = u[start:end] % BLOCK_SETS * BLOCK_SETS + v[start:end] % BLOCK_SETS
                    yield pa.RecordBatch.from_arrays([pa.array([u[start] // BLOCK_SETS]), pa.array([v[start] // BLOCK_SETS]), pa.array([pairs.tolist()], pa.list_(pa.int32()))], ["a", "b", "pairs"])

    met = cells.mapInArrow(meet, "a long, b long, pairs array<int>")
    return common.written(met.groupBy("a", "b").agg(F.flatten(F.collect_list("pairs")).alias("pairs")), "near-crowd-pairs")


def _crowds(ranked: DataFrame, place: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, least: float) -> DataFrame:
    """(u, v), u > v, that join all holders of a crowd's key in different places whose whole sets have similarity ``least`` or more. No partner is left out; of the links
    that a pair of blocks has, those are given that join as much as all do, so that they grow with its sets and not with their square."""
    rows = ranked.where(F.col("holders") > NEXT + 1).join(place, "sig").select("sig", "key", "size", "place")
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("holders"), F.min("place").alias("x"), F.max("place").alias("y")).where("x <> y").select("key", "holders")
    rows = common.written(rows.join(several, "key"), "near-crowds")
    sets = common.written(rows.groupBy("sig").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.min("size").alias("size")), "near-crowd-sets")
    where = _set_places(sets.select("sig", F.get("keys", 0).alias("near"), "size"))
    pairs = _crowd_pairs(rows.join(sets.select("sig", "keys"), "sig").join(where, "sig"), least)
    # Of two blocks only the sets that a pair names meet: most holders of a crowd's key are in no pair, and two blocks mostly share few.
    named = lambda side, block, nth: F.transform(F.array_distinct(F.transform("pairs", nth)), lambda n: F.struct(F.col(block).alias("block"), n.cast("long").alias("nth"), F.lit(side).alias("side")))
    both = F.concat(named(0, "a", lambda x: F.floor(x / BLOCK_SETS)), named(1, "b", lambda x: x % BLOCK_SETS))
    ends = pairs.select("a", "b", F.explode(both).alias("x")).select("a", "b", "x.*")
    asked = common.written(ends.select("block", "nth").distinct().join(where, ["block", "nth"]), "near-crowd-asked")
    hashed = asked.join(_hashed(texts(asked.select("sig")), words), "sig")
    met = ends.join(hashed, ["block", "nth"]).groupBy("a", "b").agg(F.collect_list(F.struct("side", "nth", "sig", "hashes")).alias("sets"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, row in zip(batch.column("pairs"), batch.column("sets"), strict=True):
                side, nth, sig = (row.values.field(c).to_numpy() for c in ("side", "nth", "sig"))
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in row.values.field("hashes")]
                size = np.array([len(x) for x in own])
                values, ids = np.unique(np.concatenate(own), return_inverse=True)
                at = np.concatenate(([0], np.cumsum(size)))
                # The row at which a block's set stands, by its side and number.
                there = np.zeros((2, BLOCK_SETS), np.int64)
                there[side, nth] = np.arange(len(sig))
                codes = np.sort(pairs.values.to_numpy())
                has, u, v, good = np.zeros(len(values), bool), there[0, codes // BLOCK_SETS], there[1, codes % BLOCK_SETS], []
                edges = np.flatnonzero(np.append(u[1:] != u[:-1], True)) + 1
                for start, end in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=True):
                    x, others = u[start], v[start:end]
                    mine = ids[at[x] : at[x + 1]]
                    has[mine] = True
                    both = np.array([np.count_nonzero(has[ids[at[y] : at[y + 1]]]) for y in others.tolist()])
                    has[mine] = False
                    good += [(int(sig[x]), int(sig[y])) for y in others[both / (size[x] + size[others] - both) >= least].tolist()]
                # A set has one name in both blocks, which may be one block.
                kept = _joining(good)
                yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in kept], pa.int64()) for j in (0, 1)], ["sig", "other"])

    return _ends(pairs.join(met, ["a", "b"]).select("pairs", "sets").mapInArrow(compare, "sig long, other long"))


def keep_one_per_group(docs: DataFrame, bits: int, words: int, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, less those that a chain of confirmed pairs joins to a row with a smaller doc_id (ties: any one of equal rows).

    A null text counts as empty; texts without words are one set; rows with a null doc_id come last in their group. Extra columns, clashing
    names included, pass through. An empty table gives an empty table.
    """
    given = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("rid"))
    row_type = given.schema["row"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in common.slices([x], "text")):
            fp, sig, size, keys, sketches = [], [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, words)
                fp.append(simhash_vp.signed(simhash_vp.fingerprint(t, words)))
                sig.append(simhash_vp.signed(simhash_vp.xxh64_intdigest(s.tobytes(), 5)))
                size.append(len(s))
                sketches.append(simhash_vp.signed(sketch(s)))
                keys.append(np.sort(s.view(np.int64))[:KEYS])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("rid"), pa.array(fp, pa.int64()), pa.array(sig, pa.int64()), pa.array(size, pa.int64()), pa.array(sketches, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "id", "rid", "fp", "sig", "size", "sketch", "keys"])

    rows = common.written(given.mapInArrow(describe, f"row {row_type}, id long, rid long, fp long, sig long, size long, sketch long, keys array<long>"), "near-rows")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    sets = common.written(rows.groupBy("sig").agg(F.min(first).alias("first"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys")), "near-sets")
    ranked, links = _shared_keys(sets), _groups(sets.select("sig", "fp"), bits)

    def texts(pairs: DataFrame) -> DataFrame:
        sigs = pairs if pairs.columns == ["sig"] else pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct()
        asked = sigs.join(sets.select("sig", "first.rid"), "sig").select("rid")
        return common.written(rows.select("rid", "sig", F.col("row.text").alias("text")).join(asked, "rid", "left_semi").select("sig", "text"), "near-texts")

    # Each set is compared with the one that most of its links lead to first. Links inside a group that these make can add nothing, so they aren't compared: only those
    # between sets in different places are, and all of these: holders of rare keys by links, which reach them all, those of crowds block by block.
    most = F.array_max(F.transform(F.array_distinct("others"), lambda x: F.struct(F.size(F.filter("others", lambda y: y == x)).alias("n"), x.alias("other"))))
    closest = common.written(_ends(_neighbours(ranked, least).select("sig", most["other"].alias("other")).union(links)), "near-closest")
    best = common.written(_confirmed(closest, texts(closest), words, least), "near-best")
    joined = common.components(best, "near-joined")
    place = common.written(sets.select("sig").join(joined.select(F.col("node").alias("sig"), "component"), "sig", "left").select("sig", F.coalesce("component", "sig").alias("place")), "near-places")
    apart = _ends(_neighbours(ranked.where(F.col("holders") <= NEXT + 1).join(place, "sig"), least).select("sig", F.explode(F.array_distinct("others")).alias("other")))
    apart = common.written(_likely(apart, sets), "near-apart")
    crowds = _crowds(ranked, place, texts, words, least)
    found = common.components(best.union(_confirmed(apart, texts(apart), words, least)).union(crowds), "near-components")
    groups = sets.select("sig", "first").join(found.select(F.col("node").alias("sig"), "component"), "sig", "left").groupBy(F.coalesce("component", "sig").alias("g")).agg(F.min("first").alias("first"))
    return rows.join(groups.select("first.rid"), "rid", "left_semi").select("row.*")
