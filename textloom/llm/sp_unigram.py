"""Operator 6, SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

Spaces become the marker U+2581 and one is put in front; characters without a piece fall back to byte pieces; decoding undoes both
exactly. The vocabulary is a file, never trained here. A model whose stored scores are merge ranks gets log scores by Zipf's rule:
rank r has a probability in proportion to 1 / (r + 2).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK, MODEL, REMEMBER = "▁", "piece_bpe_32k.model", 400_000


class Vocabulary:
    """Pieces by id, their log scores, and the byte pieces."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        stored = [model.get_score(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and self.pieces[i] and MARK not in self.pieces[i].lstrip(MARK)]
        if all(stored[i] == int(stored[i]) for i in normal):
            ranked = sorted(normal, key=lambda i: -stored[i])
            total = math.log(sum(1 / (r + 2) for r in range(len(ranked))))
            self.score = {i: -math.log(r + 2) - total for r, i in enumerate(ranked)}
        else:
            self.score = {i: stored[i] for i in normal}
        self.by_piece = {self.pieces[i]: i for i in normal}
        #: A character without a piece costs this much, as bytes.
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.by_piece), default=1)


class DoubleArray:
    """A trie over UTF-8 bytes: the child of state s by byte b is t = base[s] + b + 1, if check[t] is s."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        self.base, self.check, self.value = [0], [-1], [-1]
        self._free = 1
        items = sorted(keys.items())
        todo = [(0, 0, len(items), 0)] if items else []
        while todo:
            state, low, high, depth = todo.pop()
            if len(items[low][0]) == depth:
                self.value[state] = items[low][1]
                low += 1
            parts: list[tuple[int, int, int]] = []
            while low < high:
                b, end = items[low][0][depth], low + 1
                while end < high and items[end][0][depth] == b:
                    end += 1
                parts.append((b, low, end))
                low = end
            if not parts:
                continue
            base = self._place([b for b, _, _ in parts])
            self.base[state] = base
            for b, lo, hi in parts:
                self.check[base + b + 1] = state
                todo.append((base + b + 1, lo, hi, depth + 1))

    def _place(self, labels: list[int]) -> int:
        """A base at which all labels' cells are free: single children fill the gaps, larger families look near the end only."""
        if len(labels) == 1:
            while self._free < len(self.check) and (self.check[self._free] >= 0 or self._free <= labels[0]):
                self._free += 1
            base = max(self._free - labels[0] - 1, 0)
        else:
            base = max(0, len(self.check) - 300)
        while True:
            need = base + labels[-1] + 2 - len(self.check)
            if need > 0:
                for a, x in ((self.base, 0), (self.check, -1), (self.value, -1)):
                    a.extend([x] * need)
            if all(self.check[base + b + 1] < 0 for b in labels):
                return base
            base += 1

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that starts at ``at``."""
        base, check, value, state, size = self.base, self.check, self.value, 0, len(self.check)
        for i in range(at, len(data)):
            t = base[state] + data[i] + 1
            if t >= size or check[t] != state:
                return
            state = t
            if value[t] >= 0:
                yield i + 1, value[t]


class Known(dict):
    """Unit to its ids as bytes; a unit that is not there yet is segmented once, and remembered unless it is long."""

    def __init__(self, segment: Callable[[str], bytes]) -> None:
        self.segment = segment

    def __missing__(self, unit: str) -> bytes:
        found = self.segment(unit)
        if len(unit) < 64:
            self[unit] = found
        return found


class Unigram:
    def __init__(self, path: str | None = None) -> None:
        v = self.vocabulary = Vocabulary(path)
        self.trie = DoubleArray({p.encode(): i for p, i in v.by_piece.items()})
        self.piece_score = [v.score.get(i, 0.0) for i in range(len(v.pieces))]
        #: The same by id, with what a character without a piece costs at its first byte, and which ids are bytes.
        self.id_score, self.is_byte = np.array(self.piece_score), np.zeros(len(v.pieces), bool)
        for b, i in v.byte_ids.items():
            self.id_score[i], self.is_byte[i] = 0.0 if 0x80 <= b < 0xC0 else v.unknown, True
        self.spelt = [p.replace(MARK, " ").encode() for p in v.pieces]
        for b, i in v.byte_ids.items():
            self.spelt[i] = bytes([b])
        self.base, self.check, self.value = (np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.byte_ids = np.array([v.byte_ids[b] for b in range(256)])
        self.known = Known(lambda unit: np.array(self.viterbi(unit)[0], "<u4").tobytes())
        #: Words between spaces, each a few units in a row.
        self.words = Known(lambda word: b"".join(map(self.known.__getitem__, self.units.findall(MARK + word))))
        #: A marker that is in the text itself is spelt in bytes.
        self.literal = np.array([v.byte_ids[b] for b in MARK.encode()], "<u4").tobytes()
        inner = "".join(re.escape(c) for c in "\n\t" if not any(c in p for p in v.by_piece)) or "\0"
        #: Punctuation that no piece holds after a letter or digit.
        apart = "".join(re.escape(c) for c in ",.;:!?" if not any(re.search(rf"\w{re.escape(c)}", p) for p in v.by_piece)) or "\0"
        #: Units that no piece crosses: a run of markers with what follows, up to such punctuation, or a character that is in no piece.
        self.units = re.compile(rf"[{inner}]|{MARK}*[^{MARK}{inner}{apart}]*\w(?=[{apart}])|{MARK}*[^{MARK}{inner}]+|{MARK}+")

    def viterbi(self, unit: str) -> tuple[list[int], float]:
        """Best ids and their score; of equal scores, the first found from the left stands."""
        data, v = unit.encode("utf-8", "surrogatepass"), self.vocabulary
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.piece_score
        n, size, low, unknown = len(data), len(check), -math.inf, v.unknown
        best, came, piece_at = [low] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == low:
                continue
            lead = data[i]
            char_end = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            state, whole = 0, False
            for j in range(i, n):  # the trie's walk
                t = base[state] + data[j] + 1
                if t >= size or check[t] != state:
                    break
                state = t
                piece = value[t]
                if piece >= 0:
                    j += 1
                    if j == char_end:
                        whole = True
                    s = here + score[piece]
                    if s > best[j]:
                        best[j], came[j], piece_at[j] = s, i, piece
            if not whole and here + unknown > best[char_end]:
                best[char_end], came[char_end], piece_at[char_end] = here + unknown, i, -1
        ids, j = [], n
        while j > 0:
            i, piece = came[j], piece_at[j]
            ids += [piece] if piece >= 0 else [v.byte_ids[b] for b in reversed(data[i:j])]
            j = i
        return ids[::-1], best[n]

    def viterbi_many(self, units: list[bytes]) -> list[bytes]:
        """``viterbi``'s ids, as bytes, of units of one length in bytes: the same walks through the trie, a column for each unit."""
        data = np.frombuffer(b"".join(units), np.uint8).reshape(len(units), -1).T.astype(np.int64)
        n, width = data.shape
        score, unknown, size = self.id_score, self.vocabulary.unknown, len(self.check)
        best, came, piece_at = np.full((n + 1, width), -np.inf), np.zeros((n + 1, width), np.int64), np.full((n + 1, width), -1)
        best[0] = 0.0
        for i in range(n):
            at = np.flatnonzero(best[i] > -np.inf)
            if not len(at):
                continue
            lead = data[i, at]
            char_end = i + 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            whole, walk, state = np.zeros(len(at), bool), np.arange(len(at)), np.zeros(len(at), np.int64)
            for j in range(i, n):
                t = self.base[state] + data[j, at[walk]] + 1
                on = self.check[np.minimum(t, size - 1)] == state
                on &= t < size
                walk, state = walk[on], t[on]
                if not len(walk):
                    break
                piece = self.value[state]
                end = np.flatnonzero(piece >= 0)
                if not len(end):
                    continue
                which, piece = at[walk[end]], piece[end]
                whole[walk[end]] |= char_end[walk[end]] == j + 1
                s = best[i, which] + score[piece]
                better = s > best[j + 1, which]
                which = which[better]
                best[j + 1, which], came[j + 1, which], piece_at[j + 1, which] = s[better], i, piece[better]
            at, char_end = at[~whole], np.minimum(char_end[~whole], n)
            s = best[i, at] + unknown
            better = s > best[char_end, at]
            at, char_end = at[better], char_end[better]
            best[char_end, at], came[char_end, at], piece_at[char_end, at] = s[better], i, -1
        # Ids go to the place of their last byte; what stands before is dropped. A character without a piece has an id at each byte.
        ids, column, j = np.full((n, width), -1), np.arange(width), np.full(width, n)
        while len(column):
            i, piece = came[j, column], piece_at[j, column]
            ids[j - 1, column] = piece
            for k in np.flatnonzero(piece < 0).tolist():
                ids[i[k] : j[k], column[k]] = self.byte_ids[data[i[k] : j[k], column[k]]]
            left = i > 0
            column, j = column[left], i[left]
        ids = ids.T
        there = ids >= 0
        flat, ends = ids[there].astype("<u4").tobytes(), np.cumsum(there.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def plain(text: str) -> bool:
        """Whether each marker in the marked text starts a unit of its own."""
        return not text.startswith(" ") and "  " not in text and MARK not in text

    def learn(self, texts: Iterable[str]) -> None:
        """Segment the units of these texts that are not known yet, many at once."""
        if len(self.known) > REMEMBER:
            self.known.clear()
            self.words.clear()
        words = {w for text in texts if self.plain(text) for w in text.split(" ")} - self.words.keys()
        by_length: dict[int, dict[bytes, str]] = {}
        for unit in {u for w in words for u in self.units.findall(MARK + w)} - self.known.keys():
            data = unit.encode("utf-8", "surrogatepass")
            if len(data) < 48:
                by_length.setdefault(len(data), {})[data] = unit
        for found in by_length.values():
            units = list(found)
            for k in range(0, len(units), 16384):
                for data, ids in zip(units[k : k + 16384], self.viterbi_many(units[k : k + 16384]), strict=True):
                    self.known[found[data]] = ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of the best segmentation."""
        if not text:
            return np.zeros(0, "<u4")
        if self.plain(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, text.split(" "))), "<u4")
        out: list[bytes] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(self.literal)
            out += map(self.known.__getitem__, self.units.findall(("" if k else MARK) + part.replace(" ", MARK)))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 again: byte pieces are joined to characters, markers become spaces, the first one goes."""
        return b"".join(map(self.spelt.__getitem__, ids.tolist()))[1:]


@cache
def unigram(path: str | None = None) -> Unigram:
    return Unigram(path)


CODED = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_pieces, n_byte_pieces, ids_crc32, score, decoded_sha256, round_trip.

    A null text counts as empty (no pieces, score 0); null ids and repeated rows stay; an empty table gives an empty table;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for part in common.slices(batches, "text"):
            texts, out = [t or "" for t in part.column("text").to_pylist()], []
            model.learn(texts)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = model.encode(text)
                back = model.decode(ids)
                out.append((doc_id, len(ids), int(model.is_byte[ids].sum()), zlib.crc32(ids), float(model.id_score[ids].sum()), hashlib.sha256(back).hexdigest(), back == common.text_or_empty(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CODED, strict=True)], schema=CODED)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean")
