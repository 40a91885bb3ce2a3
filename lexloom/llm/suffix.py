"""Suffix-array dedup over bytes: a distributed merge sort that never compares a known prefix again.

Only sampled suffixes are sorted: those that start at the anchor of a 50-byte window whose anchor occurs in another
text too (see anchors.py). Windows in a row with one anchor make a region: the bytes from the anchor on, 50 at most,
and the bytes before it, read backwards. Each task sorts its regions, keeps one of those that are all alike (its
other documents lose theirs to the least), and sends a front-coded run to each bucket: for each region the length of
the prefix it shares with the one before, and the rest. A bucket's runs are merged eight bytes at a time, all runs at
once: regions that agree so far are ordered by their next eight bytes alone, and only where these differ, so a known
prefix is never compared again (``merged`` gives the same order key by key, by a loser tree). The order and its shared
prefixes say which regions agree on any window; the least document of each window keeps it, all others lose it.
Windows in a row that a region loses are sent as the first and the last, which cover the same bytes.

Regions go to buckets by anchor. The windows of hot anchors, which more than ``anchors.HOT`` documents have, get a
longer anchor (the least 40-byte window inside) and go to buckets by that, so what surrounds a passage of many
documents is spread and still makes regions of several windows. Those of crowded anchors (over ``anchors.CROWD``
documents) go one by one, by their content, so no bucket gathers more.

Null and empty texts have no bytes; a null doc_id counts as greater than all others; rows that share a doc_id never
remove bytes from each other. Texts are bytes in UTF-8: a kept text may be cut within a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import anchors
from lexloom.llm.anchors import Kind
from lexloom.llm.common import Scratch, slices

SPAN, GRAM, LONG = 50, 20, 40
REACH = SPAN - GRAM
#: A region as one key: what follows, its length, what precedes (backwards), its length.
WIDTH = SPAN + 1 + REACH + 1
#: Regions that a task holds before it sends them.
HELD = 100_000
_TABLE = np.random.default_rng(77).integers(0, 1 << 63, 256, np.uint64)


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    plain = [(t or "").encode() for t in texts]
    return _TABLE[np.frombuffer(b"".join(plain), np.uint8)], np.array([len(p) for p in plain], np.int64), plain


KIND = Kind(units, SPAN, GRAM)


def first_least(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each n values in a row, and the first place that has it."""
    size, level, at = 1, values, np.arange(len(values), dtype=np.int32)

    def joined(a, b, i, j):
        right = b < a
        return np.where(right, b, a), np.where(right, j, i)

    while 2 * size <= n:
        short = max(0, len(level) - size)
        level, at = joined(level[:short], level[size:], at[:short], at[size:])
        size *= 2
    short = max(0, len(values) - n + 1)
    return joined(level[:short], level[n - size :][:short], at[:short], at[n - size :][:short])


def first_places(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each n values in a row by their upper 48 bits, and the first place that has it.

    The place within a block stands below those bits, so one minimum finds both.
    """
    value, at, step = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], (1 << 16) - n + 1
    for k in range(0, len(values) - n + 1, step):
        some = values[k : k + step + n - 1] & np.uint64(0xFFFFFFFFFFFF0000)
        some |= np.arange(len(some), dtype=np.uint64)
        found = anchors.least(some, n)
        value.append(found >> np.uint64(16))
        at.append((found & np.uint64(0xFFFF)).astype(np.int64) + k)
    return np.concatenate(value), np.concatenate(at)


def keys_of(data: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Keys (rows of WIDTH bytes) of regions whose first and last windows start at low and high."""
    out = np.empty((len(low), WIDTH), np.uint8)
    after, before = high + SPAN - anchor, anchor - low
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(SPAN, np.uint8)]), SPAN)
    out[:, :SPAN] = ahead[anchor] * (np.arange(SPAN) < after[:, None])
    out[:, SPAN] = after
    behind = np.lib.stride_tricks.sliding_window_view(np.concatenate([data[::-1], np.zeros(REACH, np.uint8)]), REACH)
    out[:, SPAN + 1 : WIDTH - 1] = behind[len(data) - anchor] * (np.arange(REACH) < before[:, None])
    out[:, WIDTH - 1] = before + 1
    return out


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row of a shares with that of b."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def front_coded(keys: np.ndarray) -> bytes:
    """Sorted keys: shared lengths, then what follows them."""
    common = np.zeros(len(keys), np.uint8)
    common[1:] = shared(keys[1:], keys[:-1])
    rest = keys[np.arange(keys.shape[1]) >= common[:, None]]
    return zstandard.ZstdCompressor(3).compress(len(keys).to_bytes(4, "little") + common.tobytes() + rest.tobytes())


def decoded(data: bytes) -> Iterator[tuple[bytes, int]]:
    """Keys of a run and the length of the prefix that each shares with the one before."""
    plain = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(plain[:4], "little")
    at, key = 4 + n, b""
    for common in plain[4 : 4 + n]:
        size = WIDTH - common
        key = key[:common] + plain[at : at + size]
        at += size
        yield key, common


def matrix(runs: list[bytes]) -> np.ndarray:
    """All keys of some runs, one row each."""
    common, rest, n = [], [], 0
    for data in runs:
        plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        size = int.from_bytes(plain[:4].tobytes(), "little")
        common.append(plain[4 : 4 + size])
        rest.append(plain[4 + size :])
        n += size
    same, rest = np.concatenate(common), np.concatenate(rest)
    ends = np.concatenate([[0], np.cumsum(WIDTH - same.astype(np.int64))])
    out, column = np.empty((n, WIDTH), np.uint8), np.arange(WIDTH)
    last = np.zeros((1, WIDTH), np.uint8)
    # A byte that is shared is that of the last row which has its own; the row before a block stands at its head.
    for k in range(0, n, 4096):
        own = column >= same[k : k + 4096, None]
        rows = len(own)
        block = np.concatenate([last, np.zeros((rows, WIDTH), np.uint8)])
        block[1:][own] = rest[ends[k] : ends[k + rows]]
        source = np.zeros((rows + 1, WIDTH), np.int16)
        source[1:] = np.where(own, np.arange(1, rows + 1, dtype=np.int16)[:, None], 0)
        np.maximum.accumulate(source, axis=0, out=source)
        out[k : k + rows] = block[source[1:], column]
        last = out[k + rows - 1 : k + rows]
    return out


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes (of equal ones the first comes first) and the prefix each shares with the one before.

    Rows that agree so far are ordered by their next eight bytes, if these differ; what is before is not looked at again.
    """
    n, width = keys.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = keys
    words = wide.view(">u8").T.astype(np.uint64, order="C")
    order, common = np.arange(n), np.zeros(n, np.int64)
    tied = np.ones(n, bool)  # with the row before
    tied[:1] = False
    for k, word in enumerate(words):
        at = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(at):
            break
        group, value = np.cumsum(~tied)[at], word[order[at]]
        inner = np.append(False, (group[1:] == group[:-1]) & (value[1:] != value[:-1]))
        if not inner.any():
            continue
        split = np.zeros(int(group[-1]) + 1, bool)
        split[group[inner]] = True
        on = split[group]
        at, group, value = at[on], group[on], value[on]
        by = np.lexsort((value, group)) if k else np.argsort(value, kind="stable")
        order[at], value = order[at[by]], value[by]
        differ = np.append(False, (group[1:] == group[:-1]) & (value[1:] != value[:-1]))
        place = np.flatnonzero(differ)
        x = value[place] ^ value[place - 1]
        common[at[place]] = 8 * k + sum((x < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))
        tied[at[place]] = False
    common[tied] = width
    return order, common


def common_from(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two different keys, given that they share so much."""
    return WIDTH - ((int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")).bit_length() + 7) // 8


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Run, key and prefix shared with the key before, over all runs in order, by a loser tree.

    A player is (key, shared, run): shared with the last winner. Of two players the one that shares more is less,
    without a look at its bytes; only if they share as much are they compared, from there on. The loser keeps what it
    shares with the winner that beat it, and that is again the last winner by the time it plays.
    """
    k = len(runs)
    END = (b"", -1, -1)

    def player(run: int) -> tuple:
        got = next(runs[run], None)
        return END if got is None else (got[0], got[1], run)

    def play(a: tuple, b: tuple) -> tuple[tuple, tuple]:
        """Winner and loser."""
        if a[1] > b[1]:
            return a, b
        if a[1] < b[1]:
            return b, a
        if a[1] < 0:
            return a, b
        x, y = a[0], b[0]
        if x == y:
            return (a, (y, WIDTH, b[2])) if a[2] < b[2] else (b, (x, WIDTH, a[2]))
        common = common_from(x, y, a[1])
        return (a, (y, common, b[2])) if x < y else (b, (x, common, a[2]))

    size = 1
    while size < k:
        size *= 2
    losers: list[tuple] = [END] * size
    # Before the first winner nothing is known to be shared.
    level = []
    for r in range(size):
        p = player(r) if r < k else END
        level.append((p[0], 0, p[2]) if p[2] >= 0 else END)
    base = size
    while base > 1:
        base //= 2
        up = []
        for j in range(base):
            winner, losers[base + j] = play(level[2 * j], level[2 * j + 1])
            up.append(winner)
        level = up
    winner = level[0]
    while winner[2] >= 0:
        yield winner[2], winner[0], winner[1]
        at = winner[2]
        now = player(at)
        at = (at + size) // 2
        while at:
            other = losers[at]
            if now[1] == other[1] or other[1] > now[1]:
                now, losers[at] = play(now, other)
            at //= 2
        winner = now


_REGIONS = {"kind": pa.int32(), "part": pa.int64(), "packed": pa.binary(), "bucket": pa.int64(), "run": pa.binary(), "owners": pa.binary()}
REGIONS = "kind int, part long, packed binary, bucket long, run binary, owners binary"
_DEALT = {"part": pa.int64(), "packed": pa.binary()}
DEALT = "part long, packed binary"


def _regions(buckets: int, parts: int, hot: np.ndarray, crowd: np.ndarray | None = None):
    """Rows of kind 1: places to remove, settled here, by part. 2: a front-coded run for a bucket, and its regions' documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            bucket, key, doc, tag, place = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            if not len(bucket):
                return
            whole = np.ascontiguousarray(key).view(f"S{WIDTH}").reshape(-1)
            order = np.lexsort((doc, whole, bucket))
            bucket, key, doc, tag, place = [x[order] for x in (bucket, key, doc, tag, place)]
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]).any(axis=1)
            gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            # the first and the last window of a region that a smaller document has too
            last = place[gone] + key[gone, SPAN].astype(np.int64) + key[gone, WIDTH - 1] - 1 - SPAN
            more = last > place[gone]
            every = [np.concatenate([x[gone], x[gone][more]]) for x in (doc, tag)] + [np.concatenate([place[gone], last[more]])]
            rows = [(1, *s, None, None, None) for s in anchors.dealt(*every, parts)]
            bucket, key, doc, tag, place = [x[~gone] for x in (bucket, key, doc, tag, place)]
            for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                rows.append((2, None, None, int(bucket[part[0]]), front_coded(key[part]), anchors.pack(doc[part], tag[part], place[part].astype(np.int32))))
            for k in range(0, len(rows), 2048):
                yield anchors.batch_of(rows[k : k + 2048], _REGIONS)

        for batch in anchors.by_size(batches, 2, 1 << 17):
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hashed, sizes, plain = units(anchors.texts_of(batch.column(2)))
            value, at = first_places(anchors.windows(hashed, GRAM), REACH + 1)
            text = np.repeat(np.arange(len(sizes)), sizes)[: len(value)]
            place = np.flatnonzero(np.arange(len(value)) + SPAN <= np.cumsum(sizes)[text])
            text, value, at = text[place], value[place], at[place]
            on = anchors.marked(text, value, anchors.known(batch.column(3).to_pylist()))
            place, text, value, at = place[on], text[on], value[on], at[on]
            if not len(place):
                continue
            bucket = (value % np.uint64(buckets)).astype(np.int64)
            warm = anchors.among(value, hot)
            single = warm & anchors.among(value, crowd) if crowd is not None else np.zeros(len(place), bool)
            if warm.any():
                # the bytes of these windows alone, put together
                inside = anchors.covered(place[warm], SPAN, len(hashed))
                some, spot = hashed[inside], (np.cumsum(inside) - 1)[place[warm]]
                long, there = first_places(anchors.windows(some, LONG), SPAN - LONG + 1)
                bucket[warm] = (long[spot] % np.uint64(buckets)).astype(np.int64)
                at[warm] = place[warm] + there[spot] - spot
                if single.any():
                    bucket[single] = (anchors.windows(some, SPAN)[spot[single[warm]]] % np.uint64(buckets)).astype(np.int64)
            new = np.ones(len(place), bool)
            new[1:] = (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1) | (text[1:] != text[:-1]) | (warm[1:] != warm[:-1]) | single[1:] | single[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            data = np.frombuffer(b"".join(plain), np.uint8)
            held.append((bucket[first], keys_of(data, place[first], place[last], at[first]), doc[text[first]], tag[text[first]], place[first] - start[text[first]]))
            if sum(len(h[0]) for h in held) > HELD:
                yield from out()
        if held:
            yield from out()

    return run


def classes(common: np.ndarray, length: int) -> np.ndarray:
    """Sorted rows that agree on so many leading bytes have one number."""
    return np.cumsum(common < length)


def _merge(parts: int):
    """Of a bucket's regions, the windows that a smaller document has too, packed by the part of their documents."""

    def run(table: pa.Table) -> pa.Table:
        rows = anchors.dealt(*_later(table), parts)
        return pa.Table.from_batches([anchors.batch_of(rows, _DEALT)])

    return run


def _later(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owners = [anchors.unpack(x, "i8", "i8", "i4") for x in table.column("owners").to_pylist()]
    doc, tag, place = [np.concatenate(x) for x in zip(*owners)]
    keys, n = matrix(table.column("run").to_pylist()), len(doc)
    order, common = ordered(keys)
    doc, tag, place, keys = doc[order], tag[order], place[order].astype(np.int64), keys[order]
    after, before = keys[:, SPAN].astype(np.int64), keys[:, WIDTH - 1].astype(np.int64) - 1
    ahead = np.minimum(common, after)
    ahead[1:] = np.minimum(ahead[1:], after[:-1])
    ahead[:1] = 0
    # The same order for what precedes the anchors.
    by, behind = ordered(keys[:, SPAN + 1 :])
    behind = np.minimum(behind, before[by])
    behind[1:] = np.minimum(behind[1:], before[by][:-1])
    behind[:1] = 0
    by_doc = np.argsort(doc, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_doc] = np.arange(n)
    bits = max(1, n.bit_length())
    gone = np.zeros((n, REACH + 3), bool)  # column x + 1: the window that starts x bytes before the anchor
    for x in range(REACH + 1):
        on = np.flatnonzero((after >= SPAN - x) & (before >= x))
        if len(on) < 2:
            continue
        left = np.empty(n, np.int64)
        left[by] = classes(behind, x)
        right = classes(ahead, SPAN - x)
        if 3 * bits <= 63:
            # what agrees, then the document, as one number; the row follows from the rank of its document
            code = np.sort(right[on] << 2 * bits | left[on] << bits | rank[on])
            on, code = by_doc[code & (1 << bits) - 1], code >> bits
        else:
            code = right[on] * (n + 1) + left[on]
            turn = np.lexsort((rank[on], code))
            on, code = on[turn], code[turn]
        new = np.ones(len(on), bool)
        new[1:] = code[1:] != code[:-1]
        least = doc[on[new]][np.cumsum(new) - 1]
        gone[on[doc[on] > least], x + 1] = True
    # Of windows in a row the first and the last: they cover what lies between, for REACH is less than SPAN.
    edge = gone[:, 1:-1] & ~(gone[:, 2:] & gone[:, :-2])
    row, x = np.nonzero(edge)
    return doc[row], tag[row], place[row] + before[row] - x


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = {"doc": pa.int64(), "tag": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    for batch in slices(batches):
        rows = []
        for doc, tag, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), anchors.texts_of(batch.column(2)), batch.column(3).to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            out = anchors.covered(np.frombuffer(b"".join(places), "<i4"), SPAN, len(data))
            spans = int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum())
            rows.append((doc, tag, int(out.sum()), spans, hashlib.sha256(data[~out].tobytes()).hexdigest()))
        yield anchors.batch_of(rows, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    from lexloom.llm.substring import finished

    kept = Scratch(docs.sparkSession, "suffix")
    every, repeats, hot = anchors.candidates(docs, KIND, kept)
    size = every.agg(F.sum("n")).first()[0] or 0
    held = anchors.with_text(docs, KIND, repeats).select("doc", "tag", "text", "packed")
    parts = size // anchors.BUCKET + 1
    crowd = anchors.crowd(kept)
    found = kept.save(held.mapInArrow(_regions(parts, parts, hot, crowd), REGIONS), "regions")
    met = found.where("kind = 2").select("bucket", "run", "owners").groupBy("bucket").applyInArrow(_merge(parts), DEALT)
    places = found.where("kind = 1").select("part", "packed").unionByName(met).groupBy("part").applyInArrow(anchors.by_document, anchors.SPOTS)
    places = places.select("doc", "tag", F.array("places").alias("places"))
    places = kept.save(places, "places")
    kept.drop("regions")
    edited = anchors.with_text(docs, KIND, places).select("doc", "tag", "text", "places").mapInArrow(_cut, "doc long, tag long, n_removed long, n_spans long, kept_sha256 string")
    out = every.join(edited.hint("merge"), ["doc", "tag"], "left")
    spans = lambda copy: F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans")
    return finished(out, SPAN, [spans]).withColumnRenamed("n_words", "n_bytes")
