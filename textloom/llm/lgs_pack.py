"""Operator 4, best-fit packing by linear grouping.

Documents become token pieces of at most 1024 ids. All planning works on the table of piece lengths, at most 1024 counts whatever the
number of documents: large lengths are ranked and cut into groups of equal cardinality, each rounded up to its largest member; few-size
configurations that fill a sequence best are chosen for the rounded sizes; the actual, shorter documents then take their group's places,
and small pieces go best-fit into what is left. The plan says which ranks of a length go where, so pieces find their place by one
join on length, and sequences, not their members, are what the plan counts.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID, GROUPS = 1024, 2, 1024
#: Shares of the capacity up to which a piece counts as small; the plan with the fewest sequences is taken.
SMALL = (1 / 16, 1 / 4, 1 / 3, 1 / 2)

#: Fixed value of the tokenizer file: its one special token, which it recognises inside a text too.
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit numbers, as the tokenizer file gives them without added special tokens.

    The ids come from tiktoken, which has the same vocabulary as ranks and gives the same ids several times faster than the
    tokenizer file's own library (the tests hold both against each other, special tokens in a text included).
    """

    def __init__(self) -> None:
        import base64

        import public_tokenizers as public
        import tiktoken

        with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def __call__(self, text: str) -> bytes:
        ids = self.own.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else self.own.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder() -> Encoder:
    if "own" not in _ENCODERS:
        _ENCODERS["own"] = Encoder()
    return _ENCODERS["own"]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("block", pa.int64()), ("nth", pa.int64())])


def tokenised(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece; ``nth`` numbers the pieces of one length within their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ids = encoder(), common.block_ids()
        block, seen = next(ids), Counter()
        for part in common.slices(batches, "text"):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = encode(text or "") + END_ID.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    out.append((doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), block, seen[length]))
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long, block long, nth long")


# ---- the plan: everything below works on counts of lengths

Run = tuple[int, int, int]  # length, first rank, number


def groups_of(counts: dict[int, int], groups: int) -> list[tuple[int, list[Run]]]:
    """Equal-cardinality groups of the ranked lengths, longest first, each with its rounded-up size."""
    total, out, have = sum(counts.values()), [], 0
    size = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            if not have:
                out.append((length, []))
            n = min(left, size - have)
            out[-1][1].append((length, first, n))
            first, left, have = first + n, left - n, (have + n) % size
    return out


def configurations(sizes: dict[int, int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """(sizes of a sequence, number of such sequences) until all are used.

    The largest size left is filled up as tightly as what is left allows: a subset-sum search over a bit mask of reachable sums,
    large sizes first. Each configuration is used as often as its sizes last, so there are few more of them than sizes.
    """
    left, order = dict(sizes), sorted(sizes, reverse=True)
    while order:
        room = capacity - order[0]
        reach, steps, within = 1, [], (1 << room + 1) - 1
        for s in order:
            if s > room or reach >> room & 1:
                continue
            for _ in range(min(left[s] - (s == order[0]), room // s)):
                grown = reach | reach << s & within
                if grown == reach:
                    break
                steps.append((s, reach))
                reach = grown
        chosen, t = [order[0]], reach.bit_length() - 1
        for s, before in reversed(steps):
            if not before >> t & 1:
                chosen.append(s)
                t -= s
        need = Counter(chosen)
        times = min(left[s] // k for s, k in need.items())
        yield chosen, times
        for s, k in need.items():
            left[s] -= k * times
        order = [s for s in order if left[s]]


def _take(runs: deque[Run], n: int) -> list[Run]:
    out = []
    while n:
        length, first, have = runs.popleft()
        k = min(n, have)
        out.append((length, first, k))
        if have > k:
            runs.appendleft((length, first + k, have - k))
        n -= k
    return out


def _classes(places: list[list[Run]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Cut parallel runs where any of them changes: (number of sequences, [(length, first rank)])."""
    queues = [deque(p) for p in places]
    while queues[0]:
        n = min(q[0][2] for q in queues)
        yield n, [_take(q, n)[0][:2] for q in queues]


def plan_with(counts: dict[int, int], capacity: int, groups: int, small: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first rank, end rank, first sequence, offset)], number of sequences) for ``counts`` pieces of each length.

    A piece with rank r in its length's interval goes to sequence first + r - first rank, at the offset.
    """
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    members: dict[int, deque[Run]] = defaultdict(deque)
    for size, runs in groups_of({n: c for n, c in counts.items() if n > small}, groups):
        members[size].extend(runs)
    for chosen, times in configurations({s: sum(r[2] for r in runs) for s, runs in members.items()}, capacity):
        for n, slots in _classes([_take(members[s], times) for s in chosen]):
            rooms[capacity - sum(length for length, _ in slots)].append((n, slots))
    for length in sorted((n for n in counts if n <= small), reverse=True):  # best fit
        first, left = 0, counts[length]
        open_rooms = sorted(r for r, c in rooms.items() if r >= length and c)
        while left:
            if open_rooms:
                room = open_rooms[0]
                n, slots = rooms[room].pop()
                if n > left:
                    rooms[room].append((n - left, [(a, b + left) for a, b in slots]))
                    n = left
                if not rooms[room]:
                    open_rooms.pop(0)
                if room - length >= length:
                    bisect.insort(open_rooms, room - length)
                    open_rooms = sorted(set(open_rooms))
                rooms[room - length].append((n, [*slots, (length, first)]))
            else:
                per = min(left, capacity // length)
                n = left // per
                rooms[capacity - per * length].append((n, [(length, first + k * n) for k in range(per)]))
                first, left = first + per * n, left - per * n
                continue
            first, left = first + n, left - n
    out, sequence = [], 0
    for classes in rooms.values():
        for n, slots in classes:
            offset = 0
            for length, rank in slots:
                out.append((length, rank, rank + n, sequence, offset))
                offset += length
            sequence += n
    return out, sequence


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    return min((plan_with(counts, capacity, groups, int(capacity * s)) for s in SMALL), key=lambda x: x[1])


def packed(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    A null text counts as empty (one piece: the end id alone); null ids and repeated rows are packed like any other; an empty table gives
    an empty table. Other columns are not read. A piece's rank in its length comes from its number in its block plus the pieces of
    earlier blocks, so no task sees more than a block's counts and the driver sees one count for each length.
    """
    spark = docs.sparkSession
    pieces = common.written(tokenised(docs, capacity), "pieces")
    per_block = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity, groups)
    places = F.broadcast(spark.createDataFrame(rows, "length int, first long, end long, sequence long, offset long"))
    before = per_block.withColumn("earlier", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("length", "block", F.coalesce("earlier", F.lit(0)).alias("earlier")), ["length", "block"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    return ranked.join(places, "length").where("rank >= first and rank < end").select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
