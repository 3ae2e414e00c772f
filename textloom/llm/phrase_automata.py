"""Operator 8, substring dedup with repeated-phrase automata.

1. Passages. Of every 35-word window one phrase of 8 words is its anchor (the smallest by hash, the leftmost of equals), so equal windows have equal
   anchors. The windows that one occurrence of an anchor stands for lie next to each other; the words they cover are a passage of 35 to 62 words.
2. Confirmation. Passages are counted over all documents by the 128-bit hash of their words; those found twice or more recur whole. Where an anchor recurs but
   a passage around it does not, its windows are counted one by one, so that a passage comes out with a mask of its recurring windows.
3. Automata. The documents are kept in blocks of a few megabytes. A block is a shard: an Aho-Corasick automaton is compiled from the anchors of
   the confirmed passages that the block holds, and every document of the block is streamed through it. Each hit is held against the confirmed passages of
   that anchor, byte by byte, and the words of their recurring windows go. What the automaton does not locate is not removed.

A shard's automaton is bounded by its block, however many passages recur in the corpus, and a document meets one automaton only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from . import common

WINDOW, PHRASE = 35, 8
#: Phrases in a window.
WITHIN = WINDOW - PHRASE + 1
BLOCK = 8 << 20
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
#: A place is a word's number in its block, how many words of its passage come before it, and the passage's windows.
BEFORE_BITS = WINDOWS_BITS = 5


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * ODD[0]) ^ (b + ODD[1])
    h ^= h >> np.uint64(29)
    h *= ODD[2]
    return h ^ (h >> np.uint64(32))


def phrase_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every PHRASE consecutive entries, never 0; empty if there are fewer."""
    width = 1
    while width < PHRASE:
        words = _mix(words[:-width], words[width:]) if len(words) > width else words[:0]
        width *= 2
    return words | np.uint64(1)


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` over every ``n`` consecutive entries, by doubling."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x = pick(x[:-step], x[step:])
        width += step
    return x


class Block:
    """The texts of a block, their words joined by single spaces: where each word starts and ends, and which words are whose."""

    def __init__(self, texts: list[str | None]) -> None:
        self.texts = [common.text_or_empty(t) for t in texts]
        plain = [b" ".join(b" ".join(words) for words in common.word_lists(t)) for t in self.texts]
        self.data = b"\n".join(plain)
        self.start, self.end = common.word_places(self.data)
        self.first = np.searchsorted(self.start, np.cumsum([0] + [len(t) + 1 for t in plain]))
        self.first[-1] = len(self.start)

    def words(self) -> np.ndarray:
        return common.hashed_words(self.data, 1)[2]

    def passages(self) -> tuple[np.ndarray, ...]:
        """(anchor's hash, two halves of the passage's hash, place, times up to 2) of each distinct passage of the block."""
        phrases = phrase_hashes(self.words())
        n = len(phrases) - WITHIN + 1
        if n < 1:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int32))
        inside = np.zeros(n, bool)  # windows that cross no end of a document
        for a, b in zip(self.first.tolist(), self.first[1:].tolist(), strict=False):
            if b - a >= WINDOW:
                inside[a : b - WINDOW + 1] = True
        least = np.where(inside, _sliding(phrases, WITHIN, np.minimum), np.uint64(0))
        padded = np.concatenate((np.zeros(WITHIN - 1, np.uint64), least, np.zeros(WITHIN - 1, np.uint64)))
        at = np.flatnonzero(_sliding(padded, WITHIN, np.maximum) == phrases)  # each is the smallest of some window
        own, low, high = phrases[at], np.full(len(at), -1), np.full(len(at), -2)
        for k in range(WITHIN):
            hit = padded[at + k] == own  # the window that starts at - WITHIN + 1 + k
            low = np.where(hit & (low < 0), at - WITHIN + 1 + k, low)
            high = np.where(hit, at - WITHIN + 1 + k, high)
        again = np.flatnonzero((own[1:] == own[:-1]) & (np.diff(at) < WITHIN)) + 1
        low[again] = np.maximum(low[again], at[again - 1] + 1)  # windows with two such phrases are the left one's
        good = np.flatnonzero((low >= 0) & (high >= low))
        own, at, low, high = own[good], at[good], low[good], high[good]
        data, seen, where, times = self.data, {}, [], []
        for k, (a, b) in enumerate(zip(self.start[low].tolist(), self.end[high + WINDOW - 1].tolist(), strict=True)):
            i = seen.setdefault(xxh3_128_intdigest(data[a:b]), len(where))
            if i == len(where):
                where.append(k)
                times.append(1)
            else:
                times[i] = 2
        where = np.array(where, np.int64)
        halves = [np.array([h >> 64 for h in seen], np.uint64), np.array([h & (1 << 64) - 1 for h in seen], np.uint64)]
        place = (at[where] << BEFORE_BITS | at[where] - low[where]) << WINDOWS_BITS | high[where] - low[where]
        return own[where], *halves, place, np.array(times, np.int32)

    @staticmethod
    def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of the passage, words before its anchor, number of windows)."""
        before = place >> WINDOWS_BITS & (1 << BEFORE_BITS) - 1
        return (place >> WINDOWS_BITS + BEFORE_BITS) - before, before, (place & (1 << WINDOWS_BITS) - 1) + 1

    def windows(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``place``, window's number in its passage, two halves of its hash) of every window of passages."""
        low, _, n = self.unpacked(place)
        which = np.repeat(np.arange(len(place)), n)
        number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = low[which] + number
        data = self.data
        found = [xxh3_128_intdigest(data[a:b]) for a, b in zip(self.start[at].tolist(), self.end[at + WINDOW - 1].tolist(), strict=True)]
        return which, number, np.array([h >> 64 for h in found], np.uint64), np.array([h & (1 << 64) - 1 for h in found], np.uint64)

    def located(self, place: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Which words of the block go: every document is streamed through the automaton of the confirmed passages (their places in the block
        and the masks of their recurring windows).

        Two letters of a small alphabet, from its hash, stand for a word: a node then has few children, which the automaton searches one by one.
        Passages are compared as bytes, so words that share letters do no harm.
        """
        gone = np.zeros(len(self.start) + 1, np.int64)
        if not len(place):
            return gone[:-1] > 0
        codes = (self.words() >> np.uint64(40)).astype(np.uint8)
        letters = (np.stack((codes >> 4, codes & 15), axis=1) + 65).astype(np.uint8).tobytes().decode("ascii")
        data, start, end = self.data, self.start.tolist(), self.end.tolist()
        anchors: dict[str, set[tuple[int, int]]] = {}
        passages: dict[bytes, int] = {}
        for low, before, n, bits in zip(*(x.tolist() for x in self.unpacked(place)), mask.tolist(), strict=True):
            anchors.setdefault(letters[2 * (low + before) : 2 * (low + before + PHRASE)], set()).add((before, n + WINDOW - 1))
            passages[data[start[low] : end[low + n + WINDOW - 2]]] = bits
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for anchor, shapes in anchors.items():
            automaton.add_word(anchor, tuple(shapes))
        automaton.make_automaton()
        froms, tos = [], []
        for a, b in zip(self.first.tolist(), self.first[1:].tolist(), strict=False):
            if b - a < WINDOW:
                continue
            for last, shapes in automaton.iter(letters[2 * a : 2 * b]):
                if not last & 1:  # between words
                    continue
                for before, size in shapes:
                    low = a + (last >> 1) - PHRASE + 1 - before
                    if low < a or low + size > b:
                        continue
                    bits = passages.get(data[start[low] : end[low + size - 1]])
                    if bits is None:
                        continue
                    if bits < 0:  # all windows
                        froms.append(low)
                        tos.append(low + size)
                        continue
                    for k in range(bits.bit_length()):
                        if bits >> k & 1:
                            froms.append(low + k)
                            tos.append(low + k + WINDOW)
        np.add.at(gone, np.array(froms, np.int64), 1)
        np.add.at(gone, np.array(tos, np.int64), -1)
        return np.cumsum(gone[:-1]) > 0

    def without(self, k: int, gone: np.ndarray, keep_text: bool) -> tuple[int, int, str, str | None]:
        """(words, words removed, SHA-256 of the kept words joined by spaces, text left) of document ``k``; ``gone`` is for all words of the block.

        The text is untouched where nothing goes; else a removed word goes with the white space after it.
        """
        a, b = int(self.first[k]), int(self.first[k + 1])
        own = gone[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], own, [True])).astype(np.int8))).tolist()
        parts = list(zip(edges[::2], edges[1::2], strict=True))  # runs of kept words
        digest = hashlib.sha256()
        for n, (i, j) in enumerate(parts):
            digest.update((b" " if n else b"") + self.data[self.start[a + i] : self.end[a + j - 1]])
        text = None
        if keep_text:
            text = data = self.texts[k]
            if own.any():
                start = common.word_places(data)[0]
                text = b"".join(data[int(start[i]) if i else 0 : int(start[j]) if j < b - a else len(data)] for i, j in parts)
            text = text.decode("utf-8", "surrogatepass")
        return b - a, int(own.sum()), digest.hexdigest(), text


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def one_list(values: pa.Array) -> pa.Array:
    """A column of one row: the list of these values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _texts(payload: pa.Scalar) -> list[str | None]:
    return common.thaw(payload.as_py()).column("text").to_pylist()


def _provided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the passages asked for: block and place, number, hash, and how often it is known to stand somewhere (1 or 2)."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked = batch.column("asked")[i].values
            place, times = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("place", "times"))
            which, number, a, b = Block(_texts(batch.column("payload")[i])).windows(place)
            for at in range(0, len(which), 65536):
                w = which[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), batch.column("block")[i].as_py())), pa.array(place[w]), pa.array(number[at : at + 65536].astype(np.int32)), _signed(a[at : at + 65536]), _signed(b[at : at + 65536]), pa.array(times[w].astype(np.int32))], ["block", "place", "number", "a", "b", "times"])


def confirmed(blocks: DataFrame) -> DataFrame:
    """(block, place, mask) of the passages with a window that stands elsewhere too: bit k of the mask is window k, all bits if the whole passage recurs.

    Counts go through partial aggregates and, once written, joins only: a key as frequent as the input is large is split like any skewed key of a join.
    """
    each = blocks.select("block", F.explode(F.arrays_zip("anchor", "a", "b", "place", "times")).alias("x")).select("block", "x.*")
    often = common.written(each.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "often")
    recurring = common.written(each.join(often, "anchor"), "recurring")
    spot = F.struct("block", "place")
    passages = common.written(recurring.groupBy("anchor", "a", "b").agg(F.least(F.sum("times"), F.lit(2)).cast("int").alias("times"), F.min(spot).alias("spot")), "passages")
    whole = recurring.join(passages.where("times > 1").select("anchor", "a", "b"), ["anchor", "a", "b"]).select("block", "place", F.lit(-1).cast("long").alias("mask"))
    # Anchors with a passage that stands alone: the windows of each of their passages, from one place each.
    mixed = common.written(passages.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("least")).where("n > 1 and least = 1").select("anchor"), "mixed")
    asked = passages.join(mixed, "anchor").select("spot.*", "times")
    asked = common.written(asked, "asked").groupBy("block").agg(F.collect_list(F.struct("place", "times")).alias("asked"))
    windows = common.written(blocks.select("block", "payload").join(asked, "block").select("block", "payload", "asked").mapInArrow(_provided, "block long, place long, number int, a long, b long, times int"), "windows")
    repeated = common.written(windows.groupBy("a", "b").agg(F.sum("times").alias("n")).where("n > 1").select("a", "b"), "repeated")
    single = common.written(windows.where("times = 1").join(repeated, ["a", "b"]).select("block", "place", "number"), "single")
    parts = single.groupBy("block", "place").agg(F.bit_or(F.expr("shiftleft(1L, number)")).alias("mask"))
    return whole.unionByName(parts)


def deduplicated(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Struct columns ``row`` (all columns as given, the text column in its new form) and ``removal`` (n_words, n_removed, kept_sha256) of every row.

    Words are removed where a window of 35 of them also starts elsewhere, the same document included; windows are judged on the input.
    A null text has no words and stays null; empty and short texts stay as they are; repeated rows lose what they share;
    an empty table gives an empty table; other columns pass through, whatever their names. With ``keep_text=False`` the text comes back null.
    """
    names = docs.columns
    given = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("rest") if len(names) > 1 else F.struct(F.lit(1).alias("none")).alias("rest"))
    rest_type = given.schema["rest"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in zip(common.block_ids(), common.slices(batches, "text", BLOCK)):  # noqa: B905
            anchor, a, b, place, times = Block(part.column("text").to_pylist()).passages()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([common.freeze(part)], pa.binary()), *(one_list(_signed(x)) for x in (anchor, a, b)), one_list(pa.array(place)), one_list(pa.array(times))], ["block", "payload", "anchor", "a", "b", "place", "times"])

    blocks = common.written(given.mapInArrow(gather, "block long, payload binary, anchor array<long>, a array<long>, b array<long>, place array<long>, times array<int>"), "blocks")
    by_block = confirmed(blocks).groupBy("block").agg(F.collect_list(F.struct("place", "mask")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table, found = common.thaw(batch.column("payload")[i].as_py()), batch.column("found")[i]
                texts = table.column("text").to_pylist()
                block = Block(texts)
                place, mask = (found.values.field(c).to_numpy(zero_copy_only=False) if found.is_valid else np.zeros(0, np.int64) for c in ("place", "mask"))
                gone = block.located(place, mask)
                out = [block.without(k, gone, keep_text) for k in range(len(texts))]
                new = pa.array([None if t is None else x[3] for t, x in zip(texts, out, strict=True)], pa.string())
                done = pa.StructArray.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["n_words", "n_removed", "kept_sha256"])
                yield pa.RecordBatch.from_arrays([table.column("rest").combine_chunks(), new, done], ["rest", "text", "removal"])

    out = blocks.select("block", "payload").join(by_block, "block", "left").select("block", "payload", "found").mapInArrow(remove, f"rest {rest_type}, text string, removal struct<n_words: long, n_removed: long, kept_sha256: string>")
    row = F.struct(*[_column(c, text) for c in names])
    return out.select(row.alias("row"), "removal")


def _column(name: str, text: str) -> Column:
    return (F.col("text") if name == text else F.col("rest").getField(name)).alias(name)


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; the cases of ``deduplicated`` hold."""
    return deduplicated(docs.select("doc_id", "text"), keep_text=False).select("row.doc_id", "removal.*")
