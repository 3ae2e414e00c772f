"""Operator 7, LM scoring by the likelihood of a subword lattice.

A text's probability is the sum over all its segmentations into pieces of the product of their probabilities, times an end
token's. Pieces never cross words, so the sum factorises by word; a word's is found by log-space forward recursion. The
vocabulary and its starting scores exist already (see ``sp_unigram``); the training texts' expected piece counts re-estimate them.

Words are counted in blocks of a few megabytes and then over all blocks by partial sums; a word's lattice is worked out once for the whole corpus, and its
figures come back to the blocks that use it by a join, so the most frequent word costs one row a block and is split like any skewed key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .sp_unigram import MARK, Vocabulary

BLOCK, ROUNDS, SMOOTHING, FOLDS, HELD_OUT = 6 << 20, 2, 0.1, 5, 1


@cache
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Natural-log probabilities of pieces, by their text; single bytes spell what has no piece."""

    def __init__(self, pieces: dict[str, float], spelt: list[float], longest: int) -> None:
        self.pieces, self.spelt, self.longest = pieces, spelt, longest

    def edges(self, word: str, i: int) -> Iterator[tuple[int, str | None, float]]:
        pieces = self.pieces
        for j in range(i + 1, min(len(word), i + self.longest) + 1):
            if (p := pieces.get(word[i:j])) is not None:
                yield j, word[i:j], p
        if word[i] not in pieces:
            yield i + 1, None, sum(self.spelt[b] for b in word[i].encode("utf-8", "surrogatepass"))

    def forward(self, word: str) -> list[float]:
        """Log probability of all segmentations of each prefix."""
        n = len(word)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        into[0].append(0.0)
        for i in range(n + 1):
            xs = into[i]
            if len(xs) == 1:
                a = xs[0]
            elif xs:
                top = max(xs)
                a = top + math.log(sum([math.exp(x - top) for x in xs]))
            else:
                a = -math.inf
            alpha[i] = a
            if i < n and a > -math.inf:
                for j, _, p in self.edges(word, i):
                    into[j].append(a + p)
        return alpha

    def log10(self, word: str) -> float:
        return self.forward(MARK + word)[-1] / math.log(10)

    def expect(self, word: str, times: float, counts: dict) -> None:
        """Add ``times`` the expected uses of each piece (by text) and byte (by number) in ``word``."""
        word = MARK + word
        alpha = self.forward(word)
        n, total = len(word), alpha[-1]
        beta = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            xs = []
            if alpha[i] == -math.inf:
                continue
            for j, piece, p in self.edges(word, i):
                if beta[j] == -math.inf:
                    continue
                xs.append(p + beta[j])
                gain = times * math.exp(alpha[i] + p + beta[j] - total)
                if piece is None:
                    for b in word[i].encode("utf-8", "surrogatepass"):
                        counts[b] = counts.get(b, 0.0) + gain
                else:
                    counts[piece] = counts.get(piece, 0.0) + gain
            if xs:
                top = max(xs)
                beta[i] = top + math.log(sum([math.exp(x - top) for x in xs]))


class Arrays:
    """The same lattice over many words at once: words of one length are the columns of whole-array steps.

    A substring is looked up by its rolling hash among the pieces of its length, after a bitmap has turned most others away;
    words beyond ``LONG`` characters go one by one.
    """

    LONG, TOGETHER, BASE, SHIFT = 64, 16384, np.uint64(0x9E3779B97F4A7C15), np.uint64(46)

    def __init__(self, lattice: Lattice) -> None:
        self.one, self.names = lattice, list(lattice.pieces)
        self.logs = np.array([lattice.pieces[p] for p in self.names])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in set(map(len, self.names)):
            own = np.array([i for i, p in enumerate(self.names) if len(p) == k])
            h = self._codes([self.names[i] for i in own])
            rolled = np.zeros(len(own), np.uint64)
            for c in h.T:
                rolled = rolled * self.BASE + c
            order = np.argsort(rolled)
            maybe = np.zeros(1 << 18, bool)
            maybe[rolled * self.BASE >> self.SHIFT] = True
            self.by_length[k] = rolled[order], own[order], maybe

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64) + np.uint64(1)

    def _forward(self, words: list[str]) -> tuple[np.ndarray, list, int]:
        """(log probability of each prefix, edges as (start, end, which words, piece or -1, log probability), length)."""
        codes = self._codes(words)
        n, size = codes.shape
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        edges = []
        for i in range(size):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(size, i + self.one.longest) + 1):
                h = h * self.BASE + codes[:, j - 1]
                if j - i not in self.by_length:
                    continue
                keys, ids, maybe = self.by_length[j - i]
                which = np.flatnonzero(maybe[h * self.BASE >> self.SHIFT])
                at = np.minimum(np.searchsorted(keys, h[which]), len(keys) - 1)
                hit = keys[at] == h[which]
                which, at = which[hit], at[hit]
                found = [(which, ids[at])]
                if j == i + 1 and len(which) < n:
                    found.append((np.setdiff1d(np.arange(n), which, assume_unique=True), None))
                for which, piece in found:
                    if not len(which):
                        continue
                    p = self.logs[piece] if piece is not None else np.array([sum(self.one.spelt[b] for b in words[w][i].encode("utf-8", "surrogatepass")) for w in which])
                    edges.append((i, j, which, piece, p))
                    alpha[j, which] = np.logaddexp(alpha[j, which], alpha[i, which] + p)
        return alpha, edges, size

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        lengths = np.array([len(w) + 1 for w in words])
        for k in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == k)
            yield at, [MARK + words[i] for i in at]

    def log10(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for at, own in self.groups(words):
            out[at] = [self.one.forward(w)[-1] for w in own] if len(own[0]) > self.LONG else self._forward(own)[0][-1]
        return out / math.log(10)

    def expect(self, words: list[str], times: list[int], counts: dict, sums: np.ndarray) -> None:
        """Add expected uses: of pieces to ``sums`` by number (or ``counts`` by text), of bytes to ``counts``."""
        for at, own in self.groups(words):
            many = np.array([times[i] for i in at], np.float64)
            if len(own[0]) > self.LONG:
                for w, k in zip(own, many, strict=True):
                    self.one.expect(w[1:], k, counts)
                continue
            alpha, edges, size = self._forward(own)
            beta = np.full_like(alpha, -np.inf)
            beta[size] = 0.0
            for i, j, which, piece, p in reversed(edges):
                on = p + beta[j, which]
                beta[i, which] = np.logaddexp(beta[i, which], on)
                gain = many[which] * np.exp(alpha[i, which] + on - alpha[size, which])
                if piece is not None:
                    sums += np.bincount(piece, gain, len(sums))
                else:
                    for w, g in zip(which.tolist(), gain.tolist(), strict=True):
                        for b in own[w][i].encode("utf-8", "surrogatepass"):
                            counts[b] = counts.get(b, 0.0) + g


def first_lattice(path: str | None = None) -> Lattice:
    """The existing scores, with the byte pieces sharing the unknown character's."""
    v = vocabulary(path)
    return Lattice({p: v.score[i] for p, i in v.by_piece.items()}, [v.unknown] * 256, v.longest)


def lattice_from(counts: dict, ends: int, path: str | None = None) -> tuple[Lattice, float]:
    """(lattice, log10 probability of an end) from expected counts, smoothed."""
    v = vocabulary(path)
    total = sum(counts.values()) + ends + SMOOTHING * (len(v.by_piece) + 257)
    get = lambda k: math.log((counts.get(k, 0.0) + SMOOTHING) / total)
    return Lattice({p: get(p) for p in v.by_piece}, [get(b) for b in range(256)], v.longest), math.log10((ends + SMOOTHING) / total)


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def together(batches: Iterator[pa.RecordBatch], n: int, *columns: str) -> Iterator[list[list]]:
    """The columns' values, about ``n`` rows at a time."""
    held: list[list] = [[] for _ in columns]
    for b in batches:
        for have, c in zip(held, columns, strict=True):
            have += b.column(c).to_pylist()
        if len(held[0]) >= n:
            yield held
            held = [[] for _ in columns]
    if held[0]:
        yield held


def gathered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, of ``n`` rows and a little more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= n:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def scored(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null text counts as empty: its end token is all it has. Null ids and repeated rows count like any others. Without training texts every
    count is 0 and the smoothed starting model scores; an empty table gives an empty table. Other columns are not read.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(1)
        for number, part in zip(common.block_ids(), common.slices(batches, "text", BLOCK)):  # noqa: B905
            texts = [common.text_or_empty(t).lower() for t in part.column("text").to_pylist()]
            ids = part.column("doc_id").to_pylist()
            data = b"\n".join(texts)
            start, end, a, b = common.hashed_words(data)
            first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
            n = np.diff(first)
            _, at, word = np.unique(a, return_index=True, return_inverse=True)
            if (b[at][word] != b).any():  # two words of one hash: number them by their bytes
                numbers: dict[bytes, int] = {}
                word = np.array([numbers.setdefault(data[s:e], len(numbers)) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
                at = np.unique(word, return_index=True)[1]
            out = np.array([held_out(i) for i in ids], bool)
            train = np.bincount(word, weights=np.repeat(~out, n), minlength=len(at)).astype(np.int64)
            words = [data[s:e].decode("utf-8", "surrogatepass") for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{"block": number, "doc_id": ids, "held_out": out.tolist(), "n": n.tolist(), "tokens": packer.compress(word.astype("<u4").tobytes()), "words": words, "train": train.tolist()}], schema)

    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("train", pa.list_(pa.int64()))])
    blocks = common.written(docs.select("doc_id", "text").mapInArrow(gather, "block long, doc_id array<long>, held_out array<boolean>, n array<long>, tokens binary, words array<string>, train array<long>"), "lm-blocks")
    uses = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("pos", "x")).select("block", "pos", F.col("x.words").alias("word"), F.col("x.train").alias("train"))
    words = common.written(uses.groupBy("word").agg(F.sum("train").alias("c")), "lm-words")
    counts = words.where("c > 0")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda x: ~x))), F.lit(0)).alias("n")).first().n
    n_all, v_all = totals.n + ends, totals.v + (ends > 0)

    lattice, end_score = first_lattice(path), None
    for _ in range(max(1, rounds)):
        now = (lattice.pieces, lattice.spelt, lattice.longest)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            model, found = Arrays(Lattice(*now)), {}
            uses = np.zeros(len(model.names))
            for words, times in together(batches, Arrays.TOGETHER, "word", "c"):
                model.expect(words, times, found, uses)
            for k in np.flatnonzero(uses).tolist():
                found[model.names[k]] = found.get(model.names[k], 0.0) + float(uses[k])
            keys = [k if isinstance(k, str) else f"<{k}>" for k in found]
            yield pa.RecordBatch.from_arrays([pa.array([isinstance(k, int) for k in found], pa.bool_()), pa.array(keys, pa.string()), pa.array(list(found.values()), pa.float64())], ["spelt", "piece", "uses"])

        sums = counts.mapInArrow(expect, "spelt boolean, piece string, uses double").groupBy("spelt", "piece").agg(F.sum("uses").alias("uses")).collect()
        lattice, end_score = lattice_from({int(r.piece[1:-1]) if r.spelt else r.piece: r.uses for r in sums}, ends, path)
    last = (lattice.pieces, lattice.spelt, lattice.longest)

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Arrays(Lattice(*last))
        for b in gathered(batches, Arrays.TOGETHER):
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(model.log10(b.column("word").to_pylist()), pa.float64())], ["word", "c", "p"])

    known = common.written(words.mapInArrow(by_word, "word string, c long, p double"), "lm-scores")
    back = uses.select("word", "block", "pos").join(known, "word").groupBy("block").agg(F.collect_list(F.struct("pos", "c", "p")).alias("words"))

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    floor = n_all + 0.5 * (v_all + 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, out, n = (batch.column(c)[i].as_py() for c in ("doc_id", "held_out", "n"))
                word = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("tokens")[i].as_py(), max_output_size=1 << 31), "<u4")
                c, p = np.zeros(0), np.zeros(0)
                if batch.column("words")[i].is_valid:
                    found = batch.column("words")[i].values
                    pos, got_c, got_p = (found.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    c, p = np.empty(len(pos)), np.empty(len(pos))
                    c[pos], p[pos] = got_c, got_p
                doc = np.repeat(np.arange(len(ids)), n)
                total = lambda x, doc=doc, ids=ids, word=word: np.bincount(doc, weights=x[word], minlength=len(ids)) if len(word) else np.zeros(len(ids))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(np.array(n, np.int64) + 1), pa.array((total((c > 0).astype(float)) + (ends > 0)).astype(np.int64)),
                    pa.array(np.full(len(ids), n_all, np.int64)), pa.array(total(np.log10((c + 0.5) / floor)) + math.log10((ends + 0.5) / floor)), pa.array(total(p) + end_score)], schema=result)

    return blocks.select("block", "doc_id", "held_out", "n", "tokens").join(back, "block", "left").mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
