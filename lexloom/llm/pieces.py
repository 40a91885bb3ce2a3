"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked as the model says (a mark for each space, one in front) and cut into marked words: over their ends no
piece reaches, as no piece of the model holds the two characters there side by side. The distinct words that a worker
has not met yet are sorted, which is their trie in depth-first order: a word's nodes are the characters that it does not
share with the word before. Many walkers go through it side by side, each depth-first through words next to each other
with a stack of its own, one entry for each character from the root down: the state of the pieces' automaton, the best
forward score, and its last piece. Going to the next word pops what the two do not share, so a common prefix is scored
once for each walker that meets it. One step of all walkers is a few operations on arrays.

For a unigram model the forward score of a prefix is the best sum over its pieces. A BPE model's segmentation is not
the one with the best sum, so there a piece may follow another only if merging the two's text gives these two again; of
the paths that are left, one for each prefix, the score is the sum as well.

Characters of no piece become byte pieces. Null and empty texts have no ids. Decoding gives the text back, but that a
mark in the text itself becomes a space. Ties between equal scores go to the longer last piece. The columns that are
added replace columns of their name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.anchors import by_size
from lexloom.llm.common import map_columns, sources

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker keeps (twice as many for a while), their longest, and pairs of pieces.
CACHE, LENGTH, PAIRS = 600_000, 48, 2_000_000
#: Nodes of the trie for each walker.
STRETCH = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """Pieces of a model file and how its texts are marked."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.unigram, self.prefix, charsmap, squeeze = True, True, b"", True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif field == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif field == 3:
                norm = dict(_fields(value))
                charsmap, self.prefix, squeeze = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if charsmap or squeeze:
            raise ValueError("models that normalise characters or squeeze spaces are not supported")
        usable = (NORMAL, DEFINED, UNUSED)
        self.ids = {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind in usable}
        self.scores = {p: s for p, s, kind in self.pieces if kind in usable}
        self.bytes_of = {}
        for k, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes_of[int(p[3:5], 16)] = k
        self.unknown = next((k for k, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.scores.values(), default=0.0) - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("models with pieces over the ends of words are not supported")
        self.units = re.compile(self._pattern(), re.S).findall
        self.mark, self.lines = MARK if self.prefix else "", not any("\n" in p for p in self.ids)
        self.plain = [b"" if kind in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        # By number, that of a piece or one that a character of no piece gets when it is met: text, length, score, ids.
        self.texts = [p for p, _, _ in self.pieces]
        self.numbers = dict(self.ids)
        self.other: dict[int, bytes] = {}
        self._forget()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._automaton()

    def _pattern(self) -> str:
        """Words: a mark or marks, then characters that some piece holds side by side, told by what stands beside letters."""
        chars = {c for p in self.ids for c in p} - {MARK}
        letter = re.compile(r"[^\W_]").match
        others = {c for c in chars if not letter(c)}
        after = {b for p in self.ids for a, b in zip(p, p[1:]) if letter(a)} & others
        kind = lambda some: "[" + "".join(map(re.escape, sorted(some))) + "]" if some else r"(?!)"
        other, run = kind(others), rf"(?:[^\W_]++(?:{kind(after)}{kind(others)}*+)?+)++" if after else r"[^\W_]++"
        return f"{MARK}*+{other}*+{run}|{MARK}*+{other}++|{MARK}++|."

    def _automaton(self) -> None:
        """Over the pieces' characters: steps, where to go on from if there is none, and the pieces that end at a state, longest first."""
        tree: dict[tuple[int, str], int] = {}
        ends: list[list[int]] = [[]]
        above = [(0, 0, "")]
        for piece, k in self.ids.items():
            if not self.unigram and (len(piece) < 2 or self.merged(piece) != [piece]):
                continue
            state = 0
            for c in piece:
                to = tree.get((state, c))
                if to is None:
                    to = tree[state, c] = len(ends)
                    above.append((above[state][0] + 1, state, c))
                    ends.append([])
                state = to
            ends[state].append(k)
        back = [0] * len(ends)
        for state in sorted(range(1, len(ends)), key=lambda s: above[s][0]):
            size, parent, c = above[state]
            at = parent
            while size > 1 and at:
                at = back[at]
                if (at, c) in tree:
                    back[state] = tree[at, c]
                    break
            ends[state] += ends[back[state]]
        self.steps = np.array([s << 21 | ord(c) for s, c in tree], np.int64)
        order = np.argsort(self.steps)
        self.steps, self.to = self.steps[order], np.array(list(tree.values()), np.int64)[order]
        self.back = np.array(back, np.int64)
        self.n_ends = np.array([len(e) for e in ends], np.int64)
        self.first_end = np.cumsum(self.n_ends) - self.n_ends
        self.ends = np.array([k for e in ends for k in e], np.int64)
        self.size = np.array([len(p) for p, _, _ in self.pieces], np.int64)
        self.score = np.array([s for _, s, _ in self.pieces])

    def marked(self, text: str) -> str:
        return self.mark + text.replace(" ", MARK) if text else ""

    def merged(self, text: str) -> list[str]:
        """The text's pieces by merging the neighbours with the best score, the first of equals, again and again."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def number(self, c: str) -> int:
        """The number of a character by itself, whether it is a piece or not."""
        k = self.numbers.get(c)
        if k is None:
            k = self.numbers[c] = len(self.texts)
            ids = [self.bytes_of[b] for b in c.encode()] if self.bytes_of else [self.unknown]
            self.texts.append(c)
            self.score = np.append(self.score, self.least)
            self.other[k] = np.array(ids, "<u4").tobytes()
        return k

    def _forget(self) -> None:
        """Pairs of pieces met so far, sorted, and whether they fit; the latest apart. The first key is no pair's."""
        self.pairs, self.fitting = np.full(1, -1, np.int64), np.zeros(1, bool)
        self.fresh, self.fresh_fitting = np.zeros(0, np.int64), np.zeros(0, bool)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces gives the two again; -1 on the left is the start of a word."""
        key = (left + 1) << 32 | right
        if len(self.pairs) > PAIRS:
            self._forget()
        if len(self.fresh) > 4096:
            at = np.searchsorted(self.pairs, self.fresh)
            self.pairs, self.fitting = np.insert(self.pairs, at, self.fresh), np.insert(self.fitting, at, self.fresh_fitting)
            self.fresh, self.fresh_fitting = self.fresh[:0], self.fresh_fitting[:0]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        out = self.fitting[at]
        miss = np.flatnonzero(self.pairs[at] != key)
        if len(miss):
            key, at = key[miss], np.searchsorted(self.fresh, key[miss])
            new = np.append(self.fresh, -1)[at] != key
            if new.any():
                more = np.sort(key[new])
                more = more[np.append(True, more[1:] != more[:-1])]
                texts = [(self.texts[(k >> 32) - 1] if k >> 32 else "", self.texts[k & 0xFFFFFFFF]) for k in more.tolist()]
                found = np.array([not a or self.merged(a + b) == [a, b] for a, b in texts], bool)
                at = np.searchsorted(self.fresh, more)
                self.fresh, self.fresh_fitting = np.insert(self.fresh, at, more), np.insert(self.fresh_fitting, at, found)
                at = np.searchsorted(self.fresh, key)
            out[miss] = self.fresh_fitting[at]
        return out

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        out, state, todo = np.zeros(len(state), np.int64), state.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo] << 21 | char[todo]
            at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            hit = self.steps[at] == key
            out[todo[hit]] = self.to[at[hit]]
            todo = todo[~hit & (state[todo] > 0)]
            state[todo] = self.back[state[todo]]
        return out

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """The coded ids of each of the distinct words."""
        out: dict[str, bytes] = {}
        words = sorted(words)
        short = [w for w in words if len(w) <= LENGTH]
        for k in range(0, len(short), 1 << 16):
            out.update(self._walk(short[k : k + (1 << 16)]))
        for w in words:
            if len(w) > LENGTH:
                out.update(self._walk([w]))
        return out

    def _walk(self, words: list[str]) -> dict[str, bytes]:
        """The same of sorted words."""
        if not len(self.steps):
            return {w: b"".join([self._coded(self.number(c)) for c in w]) for w in words}
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        start = np.cumsum(size) - size
        # Nodes of the trie in depth-first order; each walker's first word has all of its own.
        shared = np.zeros(len(words), np.int64)
        alike = np.ones(len(words), bool)
        alike[0] = False
        for k in range(int(size.max())):
            alike[1:] &= (size[1:] > k) & (size[:-1] > k)
            on = np.flatnonzero(alike)
            if not len(on):
                break
            same = flat[start[on] + k] == flat[start[on - 1] + k]
            alike[on[~same]] = False
            shared[on[same]] += 1
        upto = np.cumsum(size - shared)
        walker = (upto - 1) // STRETCH
        leads = np.append(True, walker[1:] != walker[:-1])
        shared[leads] = 0
        count = size - shared
        first = np.cumsum(count) - count
        word = np.repeat(np.arange(len(words)), count)
        depth = np.arange(len(word)) - first[word] + shared[word] + 1
        char = flat[start[word] + depth - 1]
        kinds, which = np.unique(char, return_inverse=True)
        alone = np.array([self.number(chr(c)) for c in kinds.tolist()], np.int64)[which]
        begin = first[leads]
        length = np.diff(np.append(begin, len(word)))
        begin, length = begin[by := np.argsort(-length, kind="stable")], length[by]
        # A walker's stack has the node of each depth; by node (the last entry is the root's): state, score, piece, node before it.
        wide = int(size.max()) + 1
        stack = np.full(len(begin) * wide, len(word), np.int64)
        nodes = [np.zeros(len(word) + 1, np.int64), np.zeros(len(word) + 1), np.full(len(word) + 1, -1, np.int64), np.full(len(word) + 1, -1, np.int64)]
        for step in range(int(length[0])):
            at = begin[: int(np.searchsorted(-length, -step))] + step
            top = np.arange(len(at)) * wide + depth[at]
            self._forward(at, stack, top, self._step(nodes[0][stack[top - 1]], char[at]), alone[at], *nodes)
            stack[top] = at
        return self._read_off(words, first + count - 1, nodes[2], nodes[3])

    def _forward(self, at: np.ndarray, stack: np.ndarray, top: np.ndarray, now: np.ndarray, k: np.ndarray, state: np.ndarray, best: np.ndarray, piece: np.ndarray, before: np.ndarray) -> None:
        """Fills in the nodes at the top of the stacks; k: the number of the last character alone."""
        start = stack[top - 1]
        score = best[start] + (self.least if self.unigram else self.score[k])
        size, turn, ends, n_ends = np.ones(len(at), np.int64), 0, self.first_end[now], self.n_ends[now]
        todo = np.flatnonzero(n_ends)
        while len(todo):
            p = self.ends[ends[todo] + turn]
            n = self.size[p]
            node = stack[top[todo] - n]
            if self.unigram:
                s = best[node] + self.score[p]
                good = (s > score[todo]) | ((s == score[todo]) & (n > size[todo]))
            else:
                good = self.fits(piece[node], p)
                s = None
            on, p, node = todo[good], p[good], node[good]
            k[on], start[on], size[on] = p, node, n[good]
            score[on] = best[node] + self.score[p] if s is None else s[good]
            if s is None:
                todo = todo[~good]
            turn += 1
            todo = todo[n_ends[todo] > turn]
        state[at], best[at], piece[at], before[at] = now, score, k, start

    def _coded(self, k: int) -> bytes:
        return self.other[k] if k >= len(self.pieces) else k.to_bytes(4, "little")

    def _read_off(self, words: list[str], end: np.ndarray, piece: np.ndarray, before: np.ndarray) -> dict[str, bytes]:
        """Ids of each word, from its last piece back to its first."""
        found, todo = [], np.arange(len(words))
        while len(todo):
            found.append((todo, piece[end[todo]]))
            end[todo] = before[end[todo]]
            todo = todo[end[todo] < len(piece) - 1]
        word, k = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        turn = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        order = np.lexsort((-turn, word))
        word, k = word[order], k[order]
        upto = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        data, out, at = k.astype("<u4").tobytes(), {}, 0
        for w, to in zip(words, upto):
            out[w], at = data[4 * at : 4 * to], to
        for j in np.unique(word[k >= len(self.pieces)]).tolist():
            out[words[j]] = b"".join([self._coded(x) for x in k[upto[j - 1] if j else 0 : upto[j]].tolist()])
        return out

    def words(self, text: str) -> list[str]:
        """Marked words, and lines' ends, whose ids put together are the text's."""
        if self.lines and "  " not in text and MARK not in text and text[0] != " ":
            return (self.mark + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")
        return self.units(self.marked(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known  # words that come again come back from the older ones
        known, older, words = self.known, self.older, [self.words(t) if t else [] for t in texts]
        new = set().union(*words).difference(known)
        again = {w: older[w] for w in new if w in older} if older else {}
        known.update(again)
        new.difference_update(again)
        cut = {w: self.units(w) for w in new if not w[len(self.mark) :].isalpha()}
        units = set().union(*cut.values())
        known.update(self.segment(list((units | new.difference(cut)).difference(known))))
        for w, us in cut.items():
            known[w] = b"".join([known[u] for u in us])
        out = [b"".join(map(known.__getitem__, ws)) for ws in words]
        if max(map(len, new), default=0) > LENGTH:
            for w in new | units:
                if len(w) > LENGTH:
                    del known[w]
        return out

    def decode(self, data: bytes) -> str:
        plain = self.plain
        out = b"".join([plain[k] for k in np.frombuffer(data, "<u4").tolist()]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


_MODELS: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """The pieces that this worker has for a model file: words that one task has met, the next need not segment again."""
    key = hashlib.sha256(model).digest()
    if key not in _MODELS:
        _MODELS[key] = Pieces(model)
    return _MODELS[key]


def _run(model: bytes, place: int, kept: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in by_size(batches, place, 1 << 20):
            texts = batch.column(place).to_pylist()
            coded = pieces.encode(texts)
            decoded = [pieces.decode(c) for c in coded]
            ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], ids, pa.array(decoded, pa.string()), pa.array([d == (t or "").replace(MARK, " ") for d, t in zip(decoded, texts)], pa.bool_()), pa.array([zlib.crc32(c) for c in coded], pa.int64())], names)

    return run


ADDED = (("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()), ("round_trip", T.BooleanType()), ("ids_crc32", T.LongType()))


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """The columns of docs but text, and ids, decoded, round_trip, ids_crc32."""
    place = docs.columns.index("text")
    kept = [k for k, f in enumerate(docs.schema.fields) if k != place and f.name not in dict(ADDED)]
    schema = T.StructType([docs.schema.fields[k] for k in kept] + [T.StructField(*a) for a in ADDED])
    return map_columns(docs, _run(model, place, kept, schema.names), schema)


def digest(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip, decoded_sha256."""
    out = encode(sources(docs, "doc_id", "text"), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", "round_trip", F.sha2("decoded", 256).alias("decoded_sha256"))
