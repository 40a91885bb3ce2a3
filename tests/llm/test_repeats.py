import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import anchors, substring, suffix


def brute_words(rows, span):
    first, out = {}, {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        doc, text = rows[k]
        words, doc = (text or "").encode().split(), anchors.LAST if doc is None else doc
        gone = [False] * len(words)
        for p in range(len(words) - span + 1):
            if first.setdefault(tuple(words[p : p + span]), doc) < doc:
                gone[p : p + span] = [True] * span
        out[k] = (rows[k][0], len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return [out[k] for k in range(len(rows))]


def brute_bytes(rows, span=50):
    first, out = {}, {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        doc, data = rows[k][0], (rows[k][1] or "").encode()
        doc = anchors.LAST if doc is None else doc
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            if first.setdefault(data[p : p + span], doc) < doc:
                gone[p : p + span] = b"\1" * span
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (rows[k][0], len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest())
    return [out[k] for k in range(len(rows))]


def made(odd):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["é", "ß", "日本"]
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [fresh(rng.randrange(8, 120)) for _ in range(12)]
    texts = list(odd)
    for _ in range(70):
        texts.append(" ".join(rng.choice(passages) if rng.random() < 0.5 else fresh(rng.randrange(1, 90)) for _ in range(rng.randrange(1, 6))))
    texts += [texts[30]] * 5 + ["\0" * 120, "a\0" * 70, "\0" * 60, "ab " * 400, "ab " * 300, "x", "same " * 49, "same " * 50]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    return rows + [(None, texts[31]), (None, passages[0] + " tail"), (31, passages[1] + " " + passages[2]), (40, texts[-1])]


def rows_of(table, *names):
    return sorted((tuple(r[n] for n in names) for r in table.collect()), key=str)


def test_words(spark, docs, odd):
    rows = made(odd)
    got = rows_of(substring.dedup(docs(rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = sorted(brute_words(rows, 50), key=str)
    assert got == want and sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("hot", [False, True])
def test_bytes(spark, docs, odd, hot, monkeypatch):
    if hot:  # in this process the setting does not reach the workers, so the filter itself is filled
        full = np.full(1 << 19, 0xFFFFFFFF, np.uint32)
        found = anchors.candidates
        monkeypatch.setattr(anchors, "candidates", lambda *a: (*found(*a)[:2], full))
    rows = made(odd)
    got = rows_of(suffix.dedup(docs(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(brute_bytes(rows), key=str)
    assert got == want and sum(r[2] for r in want) > 5000


def test_small_tables(spark, docs):
    for dedup in (substring.dedup, suffix.dedup):
        assert dedup(docs([])).count() == 0
        assert [r["n_removed"] for r in dedup(docs([None, "", "a"])).collect()] == [0, 0, 0]


def test_windows_and_least():
    rng = np.random.default_rng(1)
    units = rng.integers(0, 5, 300).astype(np.uint64)
    for n in (1, 2, 3, 7, 20, 25, 50):
        h, seen = anchors.windows(units, n), {}
        for p in range(300 - n + 1):
            assert seen.setdefault(tuple(units[p : p + n]), h[p]) == h[p]
        assert len(set(h.tolist())) == len(seen)
    values = rng.integers(0, 40, 200).astype(np.uint64)
    for n in (1, 2, 26, 31):
        assert anchors.least(values, n).tolist() == [min(values[p : p + n]) for p in range(200 - n + 1)]
        low, at = suffix.first_least(values, n)
        assert at.tolist() == [p + int(np.argmin(values[p : p + n])) for p in range(200 - n + 1)]


def test_loser_tree():
    rng = random.Random(2)
    runs = []
    for _ in range(7):
        keys = sorted(bytes([rng.choice(b"ab")] * rng.randrange(1, 60)).ljust(suffix.WIDTH, bytes([rng.choice(b"ab")])) for _ in range(rng.randrange(0, 40)))
        runs.append(suffix.front_coded(np.array([list(k) for k in dict.fromkeys(keys)], np.uint8).reshape(-1, suffix.WIDTH)))
    got = list(suffix.merged([suffix.decoded(r) for r in runs]))
    plain = [k for r in runs for k, _ in suffix.decoded(r)]
    assert [k for _, k, _ in got] == sorted(plain)
    for (_, a, _), (_, b, same) in zip(got, got[1:]):
        want = next((i for i in range(suffix.WIDTH) if a[i] != b[i]), suffix.WIDTH)
        assert same == want
    assert list(suffix.merged([])) == []


def test_places_by_part():
    rng = np.random.default_rng(5)
    doc, tag, place = rng.integers(0, 40, 2000), rng.integers(-9, 9, 2000), rng.integers(0, 500, 2000)
    rows = anchors.dealt(doc, tag, place, 7)
    assert len({p for p, _ in rows}) == len(rows) <= 7
    got = {}
    for _, packed in rows:
        for r in anchors.by_document(pa.table({"packed": [packed]})).to_pylist():
            assert (r["doc"], r["tag"]) not in got
            got[r["doc"], r["tag"]] = sorted(np.frombuffer(r["places"], "<i4").tolist())
    want = {}
    for d, t, p in zip(doc.tolist(), tag.tolist(), place.tolist()):
        want.setdefault((d, t), []).append(p)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert anchors.dealt(*[np.zeros(0, np.int64)] * 3, 7) == []


def held(texts):
    """A batch as _regions gets it: all anchors of all texts are marked as repeating."""
    rows = []
    for k, text in enumerate(texts):
        units, sizes, _ = suffix.units([text])
        rows.append((k, k, anchors.zstandard.ZstdCompressor().compress(text.encode()), [anchors.pack(np.unique(suffix.KIND.anchors(units, sizes)[2]))]))
    return anchors.batch_of(rows, {"doc": pa.int64(), "tag": pa.int64(), "text": pa.binary(), "packed": pa.list_(pa.binary())})


def test_hot_windows_stay_together():
    rng = random.Random(3)
    batch = held(["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(5)])
    full, none = np.full(1 << 8, 0xFFFFFFFF, np.uint32), np.zeros(1 << 8, np.uint32)
    count = lambda *f: sum(len(anchors.unpack(r["owners"], "i8", "i8", "i4")[0]) for b in suffix._regions(4, 1, *f)(iter([batch])) for r in b.to_pylist() if r["kind"] == 2)
    windows = 5 * (4000 - 50 + 1)
    assert count(none) < windows / 10
    assert count(full) < windows / 4
    assert count(full, full) == windows


def test_places_sent_do_not_grow_with_a_passage():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [r for b in suffix._regions(1, 1, np.zeros(8, np.uint32))(iter([held([text, "x" + text])])) for r in b.to_pylist()]
    runs = pa.table({"bucket": [0], "run": [r["run"] for r in rows if r["kind"] == 2], "owners": [r["owners"] for r in rows if r["kind"] == 2]})
    packed = [r["packed"] for r in rows if r["kind"] == 1] + suffix._merge(1)(runs).column("packed").to_pylist()
    doc, tag, place = [np.concatenate(x) for x in zip(*[anchors.unpack(p, "i8", "i8", "i4") for p in packed])]
    assert set(doc.tolist()) == {1} and len(place) < 3000 / 4
    assert anchors.covered(place, 50, 3001).tolist() == [False] + [True] * 3000


@pytest.mark.parametrize("alphabet", [b"ab", b"\0a", bytes(range(256))])
def test_merge_by_words(alphabet):
    rng = random.Random(6)
    runs, plain = [], []
    for _ in range(9):
        keys = sorted({bytes(rng.choice(alphabet) for _ in range(rng.choice((1, 9, 60)))).rjust(suffix.WIDTH, rng.choice(("a", "b")).encode()) for _ in range(rng.randrange(1, 900))})
        runs.append(suffix.front_coded(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, suffix.WIDTH)))
        plain += keys
    keys = suffix.matrix(runs)
    assert [k.tobytes() for k in keys] == plain
    order, common = suffix.ordered(keys)
    want = list(suffix.merged([suffix.decoded(r) for r in runs]))
    assert [keys[k].tobytes() for k in order] == [k for _, k, _ in want] and common[1:].tolist() == [c for _, _, c in want][1:]
    start = np.cumsum([0, *(len(list(suffix.decoded(r))) for r in runs)])
    assert (np.searchsorted(start, order, "right") - 1).tolist() == [r for r, _, _ in want]


def test_first_places():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, 200_000).astype(np.uint64) << np.uint64(16)
    values[70_000:140_000] = 0  # ties over the edge of a block
    for n in (1, 11, 31):
        low, at = suffix.first_least(values, n)
        value, there = suffix.first_places(values, n)
        assert (value == low >> np.uint64(16)).all() and (there == at).all()


def test_bytes_of_crowded_anchors(spark, docs, odd, monkeypatch):
    full, found = np.full(1 << 15, 0xFFFFFFFF, np.uint32), anchors.candidates
    monkeypatch.setattr(anchors, "candidates", lambda *a: (*found(*a)[:2], full))
    monkeypatch.setattr(anchors, "crowd", lambda kept: full)
    rows = made(odd)
    got = rows_of(suffix.dedup(docs(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute_bytes(rows), key=str)
