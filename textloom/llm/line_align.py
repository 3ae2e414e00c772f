"""Operator 9, line dedup by pairwise alignment.

Documents are sequences of lines; a line's words count, not its spacing, and blank lines go with the line before them. A mark is the hash of a telling line
(five words or more, or forty bytes) or of three lines in a row that are too short to tell. Overlapping documents share a mark:

- of documents with the same lines all but the first lose everything, and only the first takes part in what follows;
- a rare mark, held by at most RARE different documents, links each of them to all that come before it;
- a commoner mark links each of its documents to the first one that holds it, so links grow with the lines, never with the square of a group.

Linked documents are aligned with patience diff (equal ends, then unique common lines, their longest increasing subsequence, again between those) over the span of their shared
marks and the two lines around it. The later document loses the aligned blocks that hold a telling line or three lines; alignment alone decides. So a line that the earlier document
has in another order stays unless a document that it is linked to has it in its order. Document order is by doc_id, then by place.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh3_64_intdigest

from . import common

#: A line of so many words or bytes is telling; of shorter ones so many in a row are.
MIN_WORDS, MIN_BYTES, RUN = 5, 40, 3
#: Different documents up to which a mark is rare.
RARE = 8
BLOCK = 4 << 20
LONGS = pa.list_(pa.int64())
#: Bytes of a line's hash, and lines on each side of the shared marks that can belong to a block with one.
WIDTH, AROUND = 16, RUN - 1


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, both rising: patience diff, without recursion."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a[x] == 1}
        pairs = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place]
        if not pairs:
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            at = bisect.bisect_left(tails, j)
            back[k] = ends[at - 1] if at else -1
            if at == len(tails):
                tails.append(j)
                ends.append(k)
            else:
                tails[at], ends[at] = j, k
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        last_a, last_b = a0, b0
        for i, j in [*chain[::-1], (a1, b1)]:
            todo.append((last_a, i, last_b, j))
            if i < a1:
                out.append((i, j))
            last_a, last_b = i + 1, j + 1
    return sorted(out)


def common_lines(later: list[int], earlier: list[int], telling: list[bool]) -> list[int]:
    """Positions in ``later`` of the aligned blocks (lines next to each other in both) with a telling line or RUN lines. What isn't aligned stays, whatever the earlier one has elsewhere."""
    out: list[int] = []
    block: list[int] = []
    before = -2
    for i, j in [*patience(later, earlier), (len(later) + 1, -1)]:
        if block and (i != block[-1] + 1 or j != before + 1):
            if len(block) >= RUN or any(telling[k] for k in block):
                out += block
            block = []
        block.append(i)
        before = j
    return out


def described(text: str | None) -> tuple[bytes, list[bool], dict[int, tuple[int, int]]]:
    """(128-bit hashes of the lines with words, which are telling, the first and last place of each mark) of a text."""
    hashes, telling, marks = [], [], {}
    for line in common.text_or_empty(text).split(b"\n"):
        words = line.split()
        if words:
            plain = b" ".join(words)
            hashes.append(xxh3_128_digest(plain))
            telling.append(len(words) >= MIN_WORDS or len(plain) >= MIN_BYTES)
    for i, tells in enumerate(telling):
        if tells:
            mark = xxh3_64_intdigest(hashes[i])
        elif i + 1 >= RUN and not any(telling[i - RUN + 1 : i]):
            mark = xxh3_64_intdigest(b"".join(hashes[i - RUN + 1 : i + 1]), RUN)
        else:
            continue
        first = i if tells else i - RUN + 1
        marks[mark] = (min(marks.get(mark, (first,))[0], first), i)
    return b"".join(hashes), telling, marks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(places: list[int]) -> bytes:
    return np.packbits(np.isin(np.arange(max(places) + 1), places)).tobytes()


def deduplicated(docs: DataFrame, text: str = "text", order: str = "doc_id", rare: int = RARE) -> DataFrame:
    """Struct columns ``row`` (all columns as given, the text without its deleted lines) and ``lines`` (n_lines, n_deleted) of every row.

    A null text has no lines and stays null; empty texts and texts of blank lines stay; a document whose lines all go becomes empty, its row stays. Rows with a
    null ``order`` come last; of equal ids the one read first is the earlier, so repeated rows lose their text but for one.
    An empty table gives an empty table; other columns pass through, whatever their names.
    """
    names = docs.columns
    given = docs.select(F.struct("*").alias("row"), F.col(f"`{order}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    row_type = given.schema["row"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in zip(common.block_ids(), common.slices(batches, "text", BLOCK)):  # noqa: B905
            out = []
            for t in part.column("text").to_pylist():
                hashes, telling, marks = described(t)
                whole = xxh3_128_digest(hashes)
                out.append({"whole": whole, "hashes": hashes, "telling": np.packbits(np.array(telling, bool)).tobytes(), "marks": [{"mark": _signed(k), "low": low, "high": high} for k, (low, high) in marks.items()]})
            for x, i in zip(out, part.column("id").to_pylist(), strict=True):
                x["id"] = i
            yield pa.RecordBatch.from_pylist([{"block": number, "payload": common.freeze(part.select(["row", "text"])), "docs": out}], gathered)

    gathered = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("docs", pa.list_(pa.struct([("id", pa.int64()), ("whole", pa.binary()), ("hashes", pa.binary()), ("telling", pa.binary()), ("marks", pa.list_(pa.struct([("mark", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])))])))])
    blocks = common.written(given.mapInArrow(gather, "block long, payload binary, docs array<struct<id: long, whole: binary, hashes: binary, telling: binary, marks: array<struct<mark: long, low: int, high: int>>>>"), "lines")
    at = F.struct(F.col("d.id").isNull().alias("none"), F.col("d.id").alias("id"), F.col("block").alias("block"), F.col("pos").alias("pos"))
    texts = blocks.select("block", F.posexplode("docs").alias("pos", "d")).where("length(d.hashes) > 0").select(at.alias("rank"), "d.whole", "d.hashes", "d.telling", "d.marks")
    # Documents with the same lines: all but the first are copies.
    firsts = common.written(texts.groupBy("whole").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("whole", "first"), "line-firsts")
    copies = texts.select("whole", "rank").join(firsts, "whole").where("rank <> first").select("rank.block", "rank.pos", F.lit(0).alias("low"), F.lit(None).cast("binary").alias("gone"))
    # Marks of the first documents only; copies meet in the minimum before they are shuffled.
    held = texts.select("rank", "whole", F.inline("marks")).groupBy("mark", "whole").agg(F.min(F.struct("rank", "low", "high")).alias("h"))
    held = common.written(held.select("mark", "h.*"), "marks")
    often = common.written(held.groupBy("mark").agg(F.min(F.struct("rank", "low", "high")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "line-often")
    side = lambda c: [F.col(f"{c}.rank").alias(c), F.col(f"{c}.low").alias(f"{c}_low"), F.col(f"{c}.high").alias(f"{c}_high")]
    links = held.join(often.where(F.col("n") > rare).select("mark", "first"), "mark").where("rank <> first.rank").select(F.col("rank").alias("later"), F.col("low").alias("later_low"), F.col("high").alias("later_high"), F.col("first.rank").alias("earlier"), F.col("first.low").alias("earlier_low"), F.col("first.high").alias("earlier_high"))
    few = common.written(held.join(often.where(F.col("n") <= rare).select("mark"), "mark"), "line-rare").groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("of"))
    before = F.flatten(F.transform("of", lambda x, i: F.transform(F.slice("of", 1, i), lambda y: F.struct(x.alias("later"), y.alias("earlier")))))
    links = links.unionByName(few.select(F.explode(before).alias("x")).select("x.*").select(*side("later"), *side("earlier")))
    pairs = links.groupBy("later", "earlier").agg(*[(F.min if c.endswith("low") else F.max)(c).alias(c) for c in ("later_low", "later_high", "earlier_low", "earlier_high")])
    pairs = common.written(pairs, "line-pairs")

    def span(side: str) -> tuple:
        low = F.greatest(F.col(f"{side}_low") - AROUND, F.lit(0))
        return low, F.substring("hashes", WIDTH * low + 1, WIDTH * (F.col(f"{side}_high") + AROUND + 1 - low))

    low, own = span("later")
    some = pairs.join(texts.select(F.col("rank").alias("earlier"), "hashes"), "earlier").withColumn("other", span("earlier")[1]).drop("hashes")
    sides = some.join(texts.select(F.col("rank").alias("later"), "hashes", "telling"), "later").select("later.block", "later.pos", low.alias("low"), own.alias("own"), "telling", "other")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for block, pos, low, own, telling, other in zip(*(b.column(c).to_pylist() for c in ("block", "pos", "low", "own", "telling", "other")), strict=True):
                number: dict[bytes, int] = {}
                later, earlier = ([number.setdefault(x[k : k + WIDTH], len(number)) for k in range(0, len(x), WIDTH)] for x in (own, other))
                found = common_lines(later, earlier, np.unpackbits(np.frombuffer(telling, np.uint8))[low : low + len(later)].astype(bool).tolist())
                if found:
                    out.append((block, pos, low, _bits(found)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "pos", "low", "gone"])

    cuts = sides.mapInArrow(align, "block long, pos int, low int, gone binary").distinct().unionByName(copies).groupBy("block").agg(F.collect_list(F.struct("pos", "low", "gone")).alias("cuts"))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table, gone, whole = common.thaw(batch.column("payload")[i].as_py()), {}, set()
                for cut in batch.column("cuts")[i].as_py() or []:
                    if cut["gone"] is None:
                        whole.add(cut["pos"])
                    else:
                        gone.setdefault(cut["pos"], set()).update((np.flatnonzero(np.unpackbits(np.frombuffer(cut["gone"], np.uint8))) + cut["low"]).tolist())
                new, n, k = [], [], []
                for pos, t in enumerate(table.column("text").to_pylist()):
                    lines, cut = [] if t is None else t.split("\n"), gone.get(pos)
                    if pos in whole:
                        left: list[str] = []
                    elif cut is None:
                        left = lines
                    else:
                        left, number, dropped = [], -1, False
                        for line in lines:
                            if common.text_or_empty(line).split():
                                number += 1
                                dropped = number in cut
                            if not dropped:
                                left.append(line)
                    new.append(t if len(left) == len(lines) else "\n".join(left))
                    n.append(len(lines))
                    k.append(len(lines) - len(left))
                yield pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), pa.array(new, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], ["row", "text", "n_lines", "n_deleted"])

    out = blocks.select("block", "payload").join(cuts, "block", "left").mapInArrow(delete, f"row {row_type}, text string, n_lines long, n_deleted long")
    row = F.struct(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names])
    return out.select(row.alias("row"), F.struct("n_lines", "n_deleted").alias("lines"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, and the SHA-256 (lower-case hex) of the text left, for every row; the cases of ``deduplicated`` hold."""
    found = deduplicated(docs.select("doc_id", "text"))
    return found.select("row.doc_id", "lines.*", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))
