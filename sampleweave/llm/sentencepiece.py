"""SentencePiece encoding and decoding by a max-plus scan.

A text is a lattice whose edges are the vocabulary pieces found in it; an encoding is the best path. States are (position, last
piece), values add up along a path and paths compete by maximum. A unigram model gives an edge its piece's score. A BPE
model gives an edge 0 if the piece may follow the last one and minus infinity if not: two pieces may be neighbours when
merging the characters of both in order of rank leaves just these two. A sequence in which all neighbours are allowed is
the BPE encoding, and there is exactly one (no merge across a boundary is ever the next one), so the same scan serves both kinds.

Nothing crosses the place before a space that follows another character; there all states meet, and what lies between two such
places (a word) has a path of its own, found for all new words of a slice at once and kept in a bounded table per worker, where words are
looked up by hash, a slice of texts at a time.
Texts of up to ``chunk`` characters are one chunk. Longer ones are cut into chunks at fixed positions: each yields a transfer
matrix from the states that cross its left boundary to those that cross its right one; matrices are multiplied (max, +) in
groups of ``group`` and the products once more per document; the winning boundary states are then handed back down, and
each chunk traces its own path back between them, independently of all others. Only matrices meet in one task.

The model file is read by the driver and broadcast (its size is that of the vocabulary). Only identity normalisation with
escaped white space is supported; another model is refused.

Defined results: a null or empty text has no pieces; repeated rows are encoded one by one; characters outside the vocabulary
become byte pieces, or the unknown piece in a model without bytes. Decoding gives the text back, but that the
sign U+2581 comes back as a space.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleweave.llm.common import column, giving_back, map_rows
from sampleweave.llm.tokenfiles import Column, WordHashes, Words, ranges
from sampleweave.session import cut

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NEVER = np.iinfo(np.int64).max
SLICE = 400_000  # bytes of text whose words a worker looks up at once
CACHE_WORDS = 250_000  # that a worker keeps; a slice's words come on top
CACHE_BITS = 20  # of the places in their hash table
WINDOWS = 32  # chunks whose words are looked up together
CELLS = 100_000  # bytes of words of a common scan; each takes some 150 bytes
SAFE = re.compile(f"(?<!{SPACE}){SPACE}")


@dataclass(frozen=True)
class EncodeSettings:
    model: str = MODEL
    chunk: int = 32_768
    group: int = 256


class PairRanks:
    """Rank of the piece that two neighbouring pieces merge into; an open hash table, so that arrays are looked up at once."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(2, 4 * len(keys))))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]
            placed = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[placed]]] = ranks[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NEVER)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[todo]] == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (self.keys[slot[todo]] >= 0)]
        return out


@dataclass(frozen=True)
class Decoder:
    """What turns ids into text."""

    text: list[str]
    byte_of: dict[int, int]
    hidden: set[int]
    special: set[int]
    unknown_id: int
    prefix: bool


class Vocabulary:
    """A model's pieces as arrays: a trie over characters, scores, and for BPE the merge history of every piece.

    Pieces are numbered as in the model; number ``size`` stands for a character outside the vocabulary, ``size`` + 1 for the
    start of a text or word, which may be followed by anything.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type not in (1, 2) or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces \
                or not model.normalizer_spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with identity normalisation and escaped white space are supported")
        self.bpe, self.prefix = model.trainer_spec.model_type == 2, model.normalizer_spec.add_dummy_prefix
        self.size = len(model.pieces)
        self.text = [p.piece for p in model.pieces]
        self.unknown_id = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.special = {*self.byte_of, *self.hidden, self.unknown_id}
        number = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        if any(c == SPACE and x != SPACE for p in number for x, c in zip(p, p[1:], strict=False)):
            raise ValueError("pieces with a space inside are not supported")
        self.score = np.array([p.score for p in model.pieces] + [min(p.score for p in model.pieces) - 10.0, 0.0])
        if self.bpe:
            number = self.merge_history(number)
        self.known = self.answers = None
        self.longest = max(map(len, number), default=1)
        self.length = np.array([len(t) for t in self.text] + [1, 0])
        self.trie(number)

    def merge_history(self, number: dict[str, int]) -> dict[str, int]:
        """``formed``, ``left`` and ``right`` of every piece that merging can reach, and the ranks of all mergeable pairs."""
        order = {s: k for k, s in enumerate(sorted({-float(x) for x in self.score[:self.size]}))}
        rank = {p: order[-float(self.score[i])] for p, i in number.items()}
        self.formed = np.full(self.size + 2, -1, np.int64)
        self.left, self.right = np.arange(self.size + 2), np.arange(self.size + 2)
        reached: dict[str, int] = {}
        for p, i in number.items():
            parts, halves = list(p), (p, p)
            while len(parts) > 1:
                best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
                if best is None:
                    break
                k = best[1]
                halves = (parts[k], parts[k + 1])
                parts[k:k + 2] = [halves[0] + halves[1]]
            if len(parts) == 1 and (len(p) == 1 or all(len(h) == 1 or h in number for h in halves)):
                reached[p] = i
                if len(p) > 1:
                    self.formed[i], self.left[i], self.right[i] = rank[p], number.get(halves[0], self.size), number.get(halves[1], self.size)
        pairs = [(number[p[:k]] * (self.size + 2) + number[p[k:]], rank[p]) for p in number for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.pairs = PairRanks(np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64))
        self.spaces = np.array([len(t) if t and not t.strip(SPACE) else 0 for t in self.text] + [0, 0])
        self.most_spaces = int(self.spaces.max())
        return reached

    def trie(self, number: dict[str, int]) -> None:
        inside = sorted({c for p in number if len(p) > 1 for c in p})
        alone = sorted({p for p in number if len(p) == 1} - set(inside))
        self.char = np.zeros(0x110000, np.int32)  # 0: not in the vocabulary
        for k, c in enumerate([*inside, *alone], 1):
            self.char[ord(c)] = k
        self.width = len(inside) + 1
        nodes: dict[str, int] = {"": 0}
        for p in number:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        parents = sorted({p[:-1] for p in nodes if len(p) > 1})
        row = {p: k for k, p in enumerate(parents, 1)}
        self.node_piece, self.node_row = np.full(len(nodes) + 1, -1, np.int32), np.zeros(len(nodes) + 1, np.int32)
        self.next = np.zeros((len(parents) + 1, self.width), np.uint16 if len(nodes) <= 1 << 16 else np.int32)
        self.first = np.zeros(len(inside) + len(alone) + 1, np.int32)
        for p, n in nodes.items():
            self.node_piece[n], self.node_row[n] = number.get(p, -1), row.get(p, 0)
            if len(p) == 1:
                self.first[self.char[ord(p)]] = n
            elif p:
                self.next[row[p[:-1]], self.char[ord(p[-1])]] = n

    def decoder(self) -> Decoder:
        return Decoder(self.text, self.byte_of, self.hidden, self.special, self.unknown_id, self.prefix)

    def codes(self, text: str) -> np.ndarray:
        return self.char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves piece ``b`` next to piece ``a``; answers stay in a table of fixed size, the newest per slot."""
        if self.known is None:
            self.known, self.answers = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        keys = a.astype(np.int64) * (self.size + 2) + b
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out, new = self.answers[slot], np.flatnonzero(self.known[slot] != keys)
        if len(new):
            keys, first = np.unique(keys[new], return_index=True)
            asked = new[first]
            found = self.settled(a[asked], b[asked])
            out[new] = found[np.searchsorted(keys, a[new].astype(np.int64) * (self.size + 2) + b[new])]
            self.known[slot[asked]], self.answers[slot[asked]] = keys, found
        return out

    def settled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``follows`` by the merge history.

        Walks back in time along the last parts of ``a`` and the first parts of ``b``, always undoing the later merge (of equal
        ranks the right one, since the left one came first), and looks for a merge across the boundary that would have come
        before the one just undone.
        """
        ok = np.ones(len(a), bool)
        both = (self.spaces[a] > 0) & (self.spaces[b] > 0)  # all runs of spaces have one rank: they grow from the left
        ok[both] = self.spaces[a[both]] == self.most_spaces
        rows = np.flatnonzero(~both)
        i, j = a[rows].astype(np.int64), b[rows].astype(np.int64)
        until_a, until_b = np.full(len(rows), NEVER), np.full(len(rows), NEVER)
        while len(rows):
            r = self.pairs.get(i * (self.size + 2) + j)
            broken = (r < until_a) & (r <= until_b) & (r < NEVER)
            ok[rows[broken]] = False
            fi, fj = self.formed[i], self.formed[j]
            go = ~broken & ((fi >= 0) | (fj >= 0))
            undo = fi > fj
            until_a, until_b = np.where(undo, fi, until_a), np.where(undo, until_b, fj)
            i, j = np.where(undo, self.right[i], i), np.where(undo, j, self.left[j])
            rows, i, j, until_a, until_b = rows[go], i[go], j[go], until_a[go], until_b[go]
        return ok

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces found in rows of characters that lie one after another: where they begin, their lengths and numbers.

        ``left`` tells how many characters a row has from each one on. A character that is no piece itself has the number ``size``.
        """
        at, node, length = np.arange(len(codes)), self.first[codes], 1
        inside, after = np.where(codes < self.width, codes, 0), self.next.reshape(-1)
        piece = np.where(node > 0, self.node_piece[node], -1)
        found = [(at, np.where(piece < 0, self.size, piece))]
        while True:
            row = self.node_row[node]
            go = (row > 0) & (left[at] > length)
            at = at[go]
            if not len(at):
                break
            node = after[row[go] * self.width + inside[at + length]]
            at, node, length = at[node > 0], node[node > 0], length + 1
            piece = self.node_piece[node]
            found.append((at[piece >= 0], piece[piece >= 0]))
        return np.concatenate([x for x, _ in found]), np.repeat(np.arange(1, len(found) + 1), [len(x) for x, _ in found]), np.concatenate([x for _, x in found])

    def scan(self, codes: np.ndarray, lengths: np.ndarray, start: np.ndarray, entry: np.ndarray, stop: int | None = None):
        """``scan_rows`` for the rows of a matrix (padded): value, last piece and its length per (row, position), and the crossing pieces."""
        n, width = codes.shape
        inside = np.arange(width + 1) <= lengths[:, None]
        _, *found, crossing = self.scan_rows(codes[inside[:, 1:]], lengths, start, entry, stop)
        out = [np.full((n, width + 1), -np.inf), np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int32)]
        for matrix, states in zip(out, found, strict=True):
            matrix[inside] = states
        return *out, crossing

    def scan_rows(self, codes: np.ndarray, lengths: np.ndarray, start: np.ndarray, entry: np.ndarray, stop: int | None = None):
        """Best paths through rows of characters, one after another in ``codes``, each from its ``start`` after its ``entry`` piece.

        Returns where each row's states begin, then value, last piece and its length per state (a row has one more than characters);
        with ``stop`` no piece begins there or later, and the list of (rows, positions, pieces, values) of the pieces that reach or
        cross it. All pieces that begin at one position of any row are weighed together.
        """
        n = len(lengths)
        row = np.repeat(np.arange(n), lengths)
        place = np.arange(len(codes)) - (np.cumsum(lengths) - lengths)[row]
        states = np.cumsum(lengths + 1) - lengths - 1
        last, size, value = np.full(len(codes) + n, -1, np.int32), np.zeros(len(codes) + n, np.int32), np.full(len(codes) + n, -np.inf)
        last[states + start], value[states + start] = entry, 0.0
        begin, length, piece = self.edges(codes, lengths[row] - place)
        upto = place[begin]
        if stop is not None:
            begin, length, piece, upto = (x[upto < stop] for x in (begin, length, piece, upto))
        order = np.argsort(upto.astype(np.uint16) if len(upto) and upto.max() < 1 << 16 else upto, kind="stable")
        begin, length, piece = begin[order], length[order], piece[order]
        own = row[begin]
        begin = begin + own  # the state before the piece
        end = begin + length
        crossing, bounds = [], np.append(0, np.cumsum(np.bincount(upto))).tolist()
        for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
            b, e, p = begin[low:high], end[low:high], piece[low:high]
            before = last[b]
            if before.size and before.min() < 0:
                live = np.flatnonzero(before >= 0)
                b, e, p, before = b[live], e[live], p[live], before[live]
            else:
                live = slice(None)
            if self.bpe:
                new = value[b] if i == 0 and (before == self.size + 1).all() else np.where(self.follows(before, p), value[b], -np.inf)
            else:
                new = value[b] + self.score[p]
            if stop is not None:
                r = own[low:high][live]
                ends = e - states[r]
                good = (new > -np.inf) & (ends >= stop)
                crossing.append((r[good], ends[good], p[good], new[good]))
            better = new > value[e]
            e, p = e[better], p[better]
            last[e], size[e], value[e] = p, length[low:high][live][better], new[better]
        return states, value, last, size, crossing

    def ids(self, pieces: Iterable[int], text: str) -> tuple[int, ...]:
        """Model ids of a path over ``text``; what is outside the vocabulary becomes bytes."""
        out, at = [], 0
        for p in pieces:
            if p == self.size:
                out += [self.byte_id[b] for b in text[at].encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown_id]
                at += 1
            else:
                out.append(int(p))
                at += len(self.text[p])
        return tuple(out)

    def trace(self, last: np.ndarray, size: np.ndarray, start: int, end: int) -> list[int]:
        """The pieces of one row's path from ``start`` to ``end``."""
        out = []
        while end > start:
            out.append(int(last[end]))
            end -= int(size[end])
        return out[::-1]

    def encode_words(self, signs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, whose characters ``signs`` lie one after another; the number of ids and the value of every word."""
        states, value, last, size, _ = self.scan_rows(self.char[signs], lengths, np.zeros(len(lengths), int), np.full(len(lengths), self.size + 1))
        on, at, least = np.zeros(len(last), bool), states + lengths, states
        while len(at):  # all words step back together
            on[at] = True
            at = at - size[at]
            at, least = at[at > least], least[at > least]
        pieces, of = last[on], np.repeat(np.arange(len(lengths)), lengths + 1)[on]
        foreign = np.flatnonzero(pieces == self.size)
        if not len(foreign):
            return pieces, np.bincount(of, minlength=len(lengths)), value[states + lengths]
        if not self.byte_id:
            pieces[foreign] = self.unknown_id
            return pieces, np.bincount(of, minlength=len(lengths)), value[states + lengths]
        sign = signs[np.flatnonzero(on)[foreign] - of[foreign] - 1].astype(np.int64)
        count = 1 + (sign >= 0x80) + (sign >= 0x800) + (sign >= 0x10000)
        sizes = np.ones(len(pieces), np.int64)
        sizes[foreign] = count
        out, first = np.repeat(pieces, sizes), (np.cumsum(sizes) - sizes)[foreign]
        byte_id = np.array([self.byte_id.get(b, self.unknown_id) for b in range(256)], np.int32)
        for k in range(4):  # the bytes of UTF-8
            more = count > k
            bits = sign[more] >> 6 * (count[more] - 1 - k)
            out[first[more] + k] = byte_id[bits & 0x3F | 0x80 if k else bits | np.array([0, 0, 0xC0, 0xE0, 0xF0])[count[more]]]
        return out, np.bincount(of, sizes, len(lengths)).astype(np.int64), value[states + lengths]

    def normal(self, text: str) -> str:
        return ((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else ""


class Encoder:
    """A worker's vocabulary and the words that it has met: found by hash, told apart by their bytes, all forgotten beyond ``CACHE_WORDS``."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.hashed = vocabulary, WordHashes()
        self.lines = vocabulary.char[ord("\n")] == 0  # a line feed that the vocabulary lacks is a word of its own
        self.ready: dict[str, tuple[bytes, float]] = {}
        self.forget()

    def forget(self) -> None:
        self.met, self.values = Words("<i4", CACHE_BITS), Column("f8")

    def whole(self, normals: list[str]) -> list[bytes]:
        return [ids for ids, _ in self.paths(normals)]

    def paths(self, normals: list[str]) -> list[tuple[bytes, float]]:
        """Ids (32 bits each) and value of every text; some ``SLICE`` bytes are looked up at once."""
        out, held, size = [], [], 0
        for k, text in enumerate(normals, 1):
            held.append(text.replace(SPACE, " ").encode("utf-8", "surrogatepass"))  # a space is one byte here
            size += len(held[-1])
            if size >= SLICE or k == len(normals):
                out += self.batch(held)
                held, size = [], 0
        return out

    def batch(self, texts: list[bytes]) -> list[tuple[bytes, float]]:
        """Cuts before every space that follows another character and around lone line feeds, and looks the words up."""
        data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
        if not len(data):
            return [(b"", 0.0)] * len(texts)
        ends = np.cumsum(lengths)
        cut_ = data == 32
        cut_[1:] &= ~cut_[:-1]
        if self.lines:
            feed = data == 10
            cut_ |= feed
            cut_[1:] |= feed[:-1]
        cut_[(ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(cut_)
        sizes = np.diff(np.append(starts, len(data)))
        keys = self.hashed.hashes(data, starts, sizes)
        if self.met.at.n > CACHE_WORDS:
            self.forget()
        words = self.met.find(keys)
        missing = np.flatnonzero(words < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            self.learn(data, keys, starts, sizes, missing[first])
            words[missing] = self.met.find(keys[missing])
        w = self.met
        same = w.size.data[words] == sizes
        kept = w.bytes.data[ranges(w.at.data[words], np.where(same, sizes, 0))]
        if not same.all() or not np.array_equal(kept, data):  # two words with one hash
            return [x for t in texts for x in self.plain(t)]
        counts = w.ids_size.data[words]
        ids = w.ids.data[ranges(w.ids_at.data[words], counts)].tobytes()
        upto = np.append(0, np.cumsum(counts, dtype=np.int64)) * 4
        first = np.searchsorted(starts, ends - lengths)
        bounds = list(zip(first.tolist(), np.append(first[1:], len(starts)).tolist(), strict=True))
        values = [0.0] * len(texts) if self.v.bpe else [float(self.values.data[words[a:b]].sum()) for a, b in bounds]
        return [(ids[upto[a]:upto[b]], x) for (a, b), x in zip(bounds, values, strict=True)]

    def plain(self, text: bytes) -> list[tuple[bytes, float]]:
        """The same for one text, scanned as one row."""
        if not text:
            return [(b"", 0.0)]
        signs = self.signs(text)
        ids, _, value = self.v.encode_words(signs, np.array([len(signs)]))
        return [(ids.astype("<i4").tobytes(), float(value[0]))]

    def signs(self, data: bytes) -> np.ndarray:
        found = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(found == 32, ord(SPACE), found)

    def learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, new: np.ndarray) -> None:
        """Scans new words, those of like length together, in blocks of some ``CELLS`` characters."""
        new = new[np.argsort(sizes[new], kind="stable")]
        block = np.cumsum(sizes[new]) // CELLS
        for some in np.split(new, np.flatnonzero(np.diff(block)) + 1):
            begins, lengths = starts[some], sizes[some]
            own = data[ranges(begins, lengths)]
            raw = own.tobytes()
            at = np.cumsum(lengths) - lengths
            ids, counts, values = self.v.encode_words(self.signs(raw), np.add.reduceat((own & 0xC0) != 0x80, at, dtype=np.int64))
            self.met.learn(keys[some], [raw[a:a + n] for a, n in zip(at.tolist(), lengths.tolist(), strict=True)], ids, counts)
            self.values.add(values)

    def prepare(self, windows: list[tuple[str, int, int]]) -> None:
        """Encodes what lies between the safe places of several chunks (window, begin, end) together."""
        safe = [(w, self.parts(w, begin, end)) for w, begin, end in windows]
        inner = list({w[own[0]:own[1]] for w, own in safe if own is not None})
        self.ready = dict(zip(inner, self.paths(inner), strict=True))

    def inner(self, text: str) -> tuple[bytes, float]:
        """Ids and value of what lies between two safe places."""
        return self.ready[text] if text in self.ready else self.paths([text])[0]

    def crossing(self, text: str, at: int) -> list[tuple[int, int]]:
        """(overrun, piece) of all pieces in ``text`` that begin before ``at`` and end there or later, in a fixed order."""
        codes, found = self.v.codes(text), []
        for begin in range(max(0, at - self.v.longest), at):
            node = self.v.first[codes[begin]]
            k = 1
            if begin + 1 == at and (node == 0 or self.v.node_piece[node] < 0):
                found.append((0, self.v.size))
            while node > 0:
                if begin + k >= at and self.v.node_piece[node] >= 0:
                    found.append((begin + k - at, int(self.v.node_piece[node])))
                if not self.v.node_row[node] or begin + k >= len(codes) or codes[begin + k] >= self.v.width:
                    break
                node = self.v.next[self.v.node_row[node], codes[begin + k]]
                k += 1
        return sorted(found)

    def parts(self, window: str, begin: int, end: int) -> tuple[int, int] | None:
        """First and last safe place in [begin + longest, end], or None."""
        stop = min(end + 1, len(window))
        found = SAFE.search(window, begin + self.v.longest, stop)
        if found is None:
            return None
        last = window.rfind(SPACE, found.start(), stop)
        while window[last - 1] == SPACE:
            last = window.rfind(SPACE, found.start(), last)
        return found.start(), last

    def head(self, window: str, begin: int, stop: int, entries: list[tuple[int, int]], exits: bool):
        """The scan from all entry states at ``begin`` to ``stop``, one row per state."""
        codes = self.v.codes(window[begin:] if exits else window[begin:stop])
        rows = np.repeat(codes[None, :], len(entries), axis=0)
        return self.v.scan(rows, np.full(len(entries), len(codes)), np.array([j for j, _ in entries], int), np.array([p for _, p in entries], int), stop - begin if exits else None)

    def states(self, window: str, begin: int, end: int, first: bool) -> tuple[list, list]:
        return ([(0, self.v.size + 1)] if first else self.crossing(window, begin)), self.crossing(window, end)

    def transfer(self, window: str, begin: int, end: int, first: bool) -> np.ndarray:
        """Value of the best path from every state at the left boundary to every state at the right one."""
        entries, exits = self.states(window, begin, end, first)
        place, out = {x: k for k, x in enumerate(exits)}, np.full((len(entries), len(exits)), -np.inf)
        for r, (j, p) in enumerate(entries):  # a piece that reaches past the whole chunk (only a short last one)
            if j >= end - begin:
                out[r, place[(j - (end - begin), p)]] = 0.0

        def filled(scan, offset, into):
            for rows, ends, pieces, values in scan[3]:
                for r, e, p, x in zip(rows, ends, pieces, values, strict=True):
                    k = place[(int(e) - offset, int(p))]
                    into[r, k] = max(into[r, k], x)
            return into

        safe = self.parts(window, begin, end)
        if safe is None:
            return filled(self.head(window, begin, end, entries, True), end - begin, out)
        lead = self.head(window, begin, safe[0], entries, False)[0][:, safe[0] - begin]
        value = 0.0 if self.v.bpe else self.inner(window[safe[0]:safe[1]])[1]  # every BPE path has the value 0, and words always have one
        if safe[1] == end:  # the boundary itself is safe: whatever piece ends there, what follows does not depend on it
            tail = np.array([0.0 if j == 0 else -np.inf for j, _ in exits])
        else:
            tail = filled(self.head(window, safe[1], end, [(0, self.v.size + 1)], True), end - safe[1], np.full((1, len(exits)), -np.inf))[0]
        return lead[:, None] + value + tail[None, :]

    def between(self, window: str, begin: int, end: int, first: bool, entry: int, leave: int) -> list[int]:
        """Ids of the pieces of the best path that begin in the chunk, given its boundary states."""
        entries, exits = self.states(window, begin, end, first)
        state, (over, piece) = entries[entry], exits[leave]
        if state[0] >= end - begin:
            return []
        safe = self.parts(window, begin, end)
        size = int(self.v.length[piece]) if piece < self.v.size else 1
        last_begin = end + over - size  # where the crossing piece begins

        def path(start, stop, entry_state):
            scan = self.head(window, start, stop, [entry_state], False)
            own = self.v.trace(scan[1][0], scan[2][0], entry_state[0], stop - start)
            return list(self.v.ids(own, window[start + entry_state[0]:stop]))

        if safe is None:
            return path(begin, last_begin, state) + list(self.v.ids([piece], window[last_begin:]))
        out = path(begin, safe[0], state)
        out += np.frombuffer(self.inner(window[safe[0]:safe[1]])[0], np.int32).tolist()
        if safe[1] < end:
            out += path(safe[1], last_begin, (0, self.v.size + 1)) + list(self.v.ids([piece], window[last_begin:]))
        return out


def shared_encoder(spark: SparkSession, settings: EncodeSettings):
    """A function that gives a worker its encoder; the vocabulary is broadcast once per call.

    The encoder outlasts a task, so it cannot lie in this module, which travels with each task anew.
    """
    sent = spark.sparkContext.broadcast(Vocabulary(settings.model))
    name = f"{settings.model}-{uuid.uuid4().hex}"

    def get() -> Encoder:
        kept = sys.__dict__.setdefault("_kept_piece_encoders", {})
        if name not in kept:
            kept.clear()
            kept[name] = Encoder(sent.value)
        return kept[name]
    return get


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    out = np.full((a.shape[0], b.shape[1]), -np.inf)
    for k in range(a.shape[1]):
        np.maximum(out, a[:, k, None] + b[None, k, :], out=out)
    return out


def best_states(matrices: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """State indices at all boundaries of a chain of matrices from ``entry`` to ``leave`` (or the best last state)."""
    values, back = np.full(matrices[0].shape[0], -np.inf), []
    values[entry] = 0.0
    for m in matrices:
        paths = values[:, None] + m
        back.append(paths.argmax(axis=0))
        values = paths.max(axis=0)
    at = int(values.argmax()) if leave is None else leave
    out = [at]
    for b in back[::-1]:
        at = int(b[at])
        out.append(at)
    return out[::-1]


def unpacked(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m).reshape(n, -1) for m, n in zip(frame["matrix"], frame["n_in"], strict=True)]


def boundary_states(matrices: DataFrame, group: int) -> DataFrame:
    """(row, chunk, entry, leave) from (row, chunk, n_in, matrix), through products of ``group`` matrices.

    A string has at most 2^31 characters, so a row has at most a few hundred groups.
    """
    matrices = matrices.withColumn("part", F.floor(F.col("chunk") / group).cast("int"))

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        out, *rest = unpacked(frame)
        for m in rest:
            out = times(out, m)
        return pd.DataFrame({"row": frame["row"].iloc[:1], "part": frame["part"].iloc[:1], "n_in": [out.shape[0]], "matrix": [out.tobytes()]})

    def descend(at: str, fixed: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(at)
            entry, leave = (int(frame["entry"].iloc[0]), int(frame["leave"].iloc[0])) if fixed else (0, None)
            states = best_states(unpacked(frame), entry, leave)
            return pd.DataFrame({"row": frame["row"].to_numpy(), at: frame[at].to_numpy(), "entry": states[:-1], "leave": states[1:]})
        return run

    products = matrices.groupBy("row", "part").applyInPandas(product, "row long, part int, n_in int, matrix binary")
    outer = products.groupBy("row").applyInPandas(descend("part", False), "row long, part int, entry int, leave int")
    return (matrices.join(outer, ["row", "part"]).groupBy("row", "part")
            .applyInPandas(descend("chunk", True), "row long, chunk int, entry int, leave int"))


def together(rows: Iterable[tuple], n: int) -> Iterator[list[tuple]]:
    rows = iter(rows)
    while held := list(islice(rows, n)):
        yield held


def id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or the first longer one of its kind that is not taken (names are compared without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def encode(docs: DataFrame, settings: EncodeSettings = EncodeSettings()) -> DataFrame:
    """``docs`` with the column ``ids`` instead of any of that name; every row, whatever its length."""
    short, long = encoded_parts(docs, settings)
    return short if long is None else short.unionByName(long)


def encoded_parts(docs: DataFrame, settings: EncodeSettings) -> tuple[DataFrame, DataFrame | None]:
    """The texts of one chunk and, if there are any, those of several."""
    spark = docs.sparkSession
    marker = fresh("__row", docs.columns)
    encoder, size = shared_encoder(spark, settings), settings.chunk
    keep = [c for c in docs.columns if c not in ("ids", "text")]
    text = column(docs, "text", "string")
    is_long = F.coalesce(F.length(text) > size, F.lit(False))

    def at_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = e.whole([e.v.normal(t or "") for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, id_lists(ids)], names=[*part.schema.names, "ids"])

    own = docs.where(~is_long).select(*(f"`{c}`" for c in keep), text.alias("text"))
    short = own.mapInArrow(giving_back(at_once), T.StructType([*own.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))

    long_rows = cut(docs.where(is_long).select(*(f"`{c}`" for c in keep), text.alias("text")).withColumn(marker, F.monotonically_increasing_id()))
    if long_rows.isEmpty():
        return short, None

    def windows(rows: Iterable[tuple]) -> Iterator[tuple]:
        v = encoder().v
        margin = max(32, v.longest)
        for row, own in rows:
            normal = v.normal(own)
            for k, at in enumerate(range(0, len(normal), size)):
                begin = max(0, at - margin)
                end = min(len(normal), at + size)
                yield row, k, at - begin, end - begin, normal[begin:end + margin]

    def matrices(rows: Iterable[tuple]) -> Iterator[tuple]:
        e = encoder()
        for held in together(rows, WINDOWS):
            if not e.v.bpe:
                e.prepare([(window, begin, end) for _, _, begin, end, window in held])
            for row, k, begin, end, window in held:
                m = e.transfer(window, begin, end, k == 0)
                yield row, k, m.shape[0], m.tobytes()

    def traced(rows: Iterable[tuple]) -> Iterator[tuple]:
        e = encoder()
        for held in together(rows, WINDOWS):
            e.prepare([(window, begin, end) for _, _, begin, end, window, *_ in held])
            for row, k, begin, end, window, entry, leave in held:
                yield row, k, e.between(window, begin, end, k == 0, entry, leave)

    chunks = cut(map_rows(long_rows.select(marker, "text"), giving_back(windows), "row long, chunk int, begin int, end int, window string"))
    # written, since a stage that made and used the states would hold two workers a task
    states = cut(boundary_states(cut(map_rows(chunks, giving_back(matrices), "row long, chunk int, n_in int, matrix binary")), settings.group))
    given = chunks.join(states, ["row", "chunk"]).select("row", "chunk", "begin", "end", "window", "entry", "leave")
    pieces = (map_rows(given, giving_back(traced), "row long, chunk int, ids array<int>").groupBy("row")
              .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids")))
    long = long_rows.join(pieces.withColumnRenamed("row", marker), marker).select(*(f"`{c}`" for c in keep), "text", "ids")
    return short, long


def decode_ids(v: Decoder, ids: Iterable[int]) -> str:
    ids, out, held = list(ids), [], bytearray()
    if v.special.isdisjoint(ids):
        text = "".join(map(v.text.__getitem__, ids)).replace(SPACE, " ")
        return text[1:] if v.prefix and text.startswith(" ") else text
    for i in ids:
        if i in v.byte_of:
            held.append(v.byte_of[i])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held.clear()
        if i not in v.hidden:
            out.append(v.text[i] if i != v.unknown_id else " ⁇ ")
    if held:
        out.append(held.decode("utf-8", "replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if v.prefix and text.startswith(" ") else text


def decode(encoded: DataFrame, settings: EncodeSettings = EncodeSettings()) -> DataFrame:
    """``encoded`` with the column ``decoded``, the text of its ``ids`` (null for null)."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(settings.model).decoder())

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        v = sent.value
        return pd.Series([None if x is None else decode_ids(v, x.tolist()) for x in ids], index=ids.index, dtype=object)

    return encoded.withColumn("decoded", back("ids"))


def encode_documents(docs: DataFrame, settings: EncodeSettings = EncodeSettings()) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 and exact (decoding gives the text back; null counts as empty) for every row."""
    own = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    encoded = encode(own, settings)
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(settings.model).decoder())

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                back = [decode_ids(v, x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(x) for x in part.column("ids")], pa.int64()), part.column("ids"),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                    pa.array([t == (own or "") for t, own in zip(back, part.column("text").to_pylist(), strict=True)])],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256", "exact"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(giving_back(check), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, exact boolean")
