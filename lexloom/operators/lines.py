"""Lines, words and candidates of whole documents, in one pass over their texts; nothing is dealt or sorted for it."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

PARTS = ("s", "e", "n", "tok_no", "k")
FIELDS = "array<struct<s:int,e:int,n:int,tok_no:int,k:int>>"
SCHEMA = f"seg_no int, seg_start bigint, cands {FIELDS}, blocked {FIELDS}, kept {FIELDS}, words array<struct<word:string,n:int>>"


@lru_cache(maxsize=1)
def word_pattern() -> str:
    """functions.text.WORD for Python's regular expressions, whose classes know no \\p; made once, on the driver."""
    runs, first = [], None
    for c in range(sys.maxunicode + 2):
        own = c <= sys.maxunicode and (unicodedata.category(chr(c))[0] in "LN" or c == 0x5F or 0x300 <= c <= 0x36F)
        if own and first is None:
            first = c
        elif not own and first is not None:
            runs.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    unit = f"[{''.join(runs)}]+"
    return f"{unit}(?:[-.]{unit})*"


def fold(x: str) -> str:
    return x.lower().replace("ß", "ss")


class _Piece:
    def __init__(self, text: str, at: int) -> None:
        self.group, self.start, self.end = (lambda: text), (lambda: at), (lambda: at + len(text))


class Matcher:
    """Candidates of a line, those in forbidden phrases, and what is left of the others where no protected text is near."""

    def __init__(self, rows: list[tuple], phrases: list[tuple], words: list[str], longest: int, pattern: str) -> None:
        self.numbers = {r[0]: k for k, r in enumerate(rows)}
        self.single = {key: k for key, k in self.numbers.items() if " " not in key}
        self.more = {key.split(" ")[0] for key in self.numbers if " " in key}
        self.words, self.longest = set(words), longest
        self.seen = self.words | set(self.single) | self.more
        concepts = [(r[2], r[3]) for r in rows]
        self.phrases = [(p, {k for k, (c, g) in enumerate(concepts) if c == concept and (g == "shared" or (g is not None and g == lang))}) for concept, lang, p in phrases]
        self.pattern, self.folded = re.compile(pattern), {}

    def _key(self, word: str) -> str:
        """The folded word if any list has it or a key may begin with it, else nothing; kept for frequent words."""
        key = self.folded.get(word)
        if key is None:
            key = fold(word)
            key = key if key in self.seen else ""
            if len(self.folded) < 200_000:
                self.folded[word] = key
        return key

    def _found(self, line: str) -> list:
        """Words with their places; where the text has the marks that the SQL cuts by, they are pieces of the cut."""
        if "\x01" not in line and "\x02" not in line:
            return list(self.pattern.finditer(line))
        out, at = [], 0
        for k, piece in enumerate(re.split("[\x01\x02]", self.pattern.sub("\x01\\g<0>\x02", line))):
            if k % 2:
                out.append(_Piece(piece, at))
            at += len(piece)
        return out

    def line(self, line: str) -> tuple[list, list, list, dict]:
        cands, words = [], {}
        found = self._found(line)
        key_of = self._key
        for at, m in enumerate(found):
            key = key_of(m.group())
            if not key:
                continue
            if key in self.words:
                words[key] = words.get(key, 0) + 1
            k = self.single.get(key)
            if k is not None:
                cands.append((m.start(), m.end(), 1, at + 1, k))
            if key in self.more:
                run = key
                for n in range(2, self.longest + 1):
                    if at + n > len(found):
                        break
                    run = f"{run} {fold(found[at + n - 1].group())}"
                    k = self.numbers.get(run)
                    if k is not None:
                        cands.append((m.start(), found[at + n - 1].end(), n, at + 1, k))
        blocked = []
        if cands:
            blocked = self._blocked(line, cands)
            if blocked:
                gone = set(blocked)
                cands = [c for c in cands if c not in gone]
        return cands, blocked, keep(cands), words

    def _blocked(self, line: str, cands: list) -> list:
        out, lowered = [], None
        for phrase, own in self.phrases:
            lowered = line.lower() if lowered is None else lowered
            at = lowered.find(phrase)
            if at < 0:
                continue
            places = []
            while at >= 0:
                places.append(at)
                at = lowered.find(phrase, at + 1)
            size, j = len(phrase), 0
            for c in cands:
                if c[4] in own:
                    # Candidates are in order of their starts: the last place before a start reaches furthest.
                    while j + 1 < len(places) and places[j + 1] <= c[0]:
                        j += 1
                    if places[j] <= c[0] and c[1] <= places[j] + size:
                        out.append(c)
        return out if len(self.phrases) < 2 else list(dict.fromkeys(out))


def keep(cands: list) -> list:
    """Of overlapping candidates the one of more words wins, then the one that starts first; in runs of those that overlap."""
    if len(cands) < 2:
        return cands
    out, run, reach = [], [], -1
    for c in cands:
        if c[0] >= reach and run:
            out += _best(run)
            run = []
        run.append(c)
        reach = max(reach, c[1]) if len(run) > 1 else c[1]
    return out + _best(run)


def _best(run: list) -> list:
    if len(run) == 1:
        return run
    taken: dict[int, None] = {}
    out = []
    for c in sorted(run, key=lambda c: (-c[2], c[0])):
        own = range(c[3], c[3] + c[2])
        if not any(t in taken for t in own):
            taken.update(dict.fromkeys(own))
            out.append(c)
    return out


def _lists(rows: list[list]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.array([c for r in rows for c in r], dtype=np.int32).reshape(-1, len(PARTS))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(len(PARTS))], names=list(PARTS)))


def pass_over(make):
    """A function of Arrow batches of an id and a text: one row for each line that holds candidates or listed words."""

    def run(batches):
        matcher = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, size = [], 0
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                if text is None:
                    continue
                start = 0
                for no, line in enumerate(text.split("\n")):
                    cands, blocked, kept, words = matcher.line(line)
                    if cands or blocked or words:
                        rows.append((at, no, start, cands, blocked, kept, words))
                        size += len(cands) + 1
                    start += len(line) + 1
                if size > 200_000:
                    yield _batch(batch.schema.field(0).name, ids, rows)
                    rows, size = [], 0
            if rows:
                yield _batch(batch.schema.field(0).name, ids, rows)

    return run


def _batch(name: str, ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r[6]) for r in rows], out=offsets[1:])
    words = pa.StructArray.from_arrays([pa.array([w for r in rows for w in r[6]], pa.string()), pa.array([n for r in rows for n in r[6].values()], pa.int32())], names=["word", "n"])
    columns = [ids.take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), *(_lists([r[k] for r in rows]) for k in (3, 4, 5)), pa.ListArray.from_arrays(offsets, words)]
    return pa.RecordBatch.from_arrays(columns, names=[name, "seg_no", "seg_start", "cands", "blocked", "kept", "words"])
