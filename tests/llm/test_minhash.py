from collections import Counter

import numpy as np
import pytest

from lexloom.llm import minhash
from lexloom.llm.common import Scratch
from lexloom.llm.components import components


def brute(texts, n, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def made(seed, n=150):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            words = str(texts[int(rng.integers(max(0, len(texts) - 30), len(texts)))] or "a").split()
            for _ in range(int(rng.integers(0, max(2, len(words) // 8)))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary, int(rng.integers(1, 80)))))
    return texts


@pytest.mark.parametrize("n", [2, 5])
def test_like_brute_force(spark, docs, odd, n):
    texts = odd + made(n) + [f"{'hot group of one text ' * 8} {k % 7}" for k in range(60)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(texts), n=n).collect()}
    for k, (size, root) in enumerate(brute(texts, n)):
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (size, root, root == k), texts[k]


def test_odd_tables(spark, docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    rows = minhash.near_duplicates(docs([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "x"), (7, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 7)]


def test_registers_estimate():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.8, 0.95):
        common = rng.integers(0, 1 << 63, int(2000 * share), np.uint64)
        rest = rng.integers(0, 1 << 63, (2, (2000 - len(common)) // 2), np.uint64)
        a, b = [minhash.registers(np.unique(np.concatenate([common, r]))) for r in rest]
        assert abs(minhash.estimate(a, b) - share) < 0.13


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for a, b in edges if a != b for k in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_prefixes_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        pivot = rng.choice(400, int(rng.integers(1, 60)), replace=False).astype(np.uint64)
        sets = []
        for _ in range(8):
            stay = pivot[rng.random(len(pivot)) < rng.uniform(0.6, 1.0)]
            sets.append(np.unique(np.concatenate([stay, rng.choice(420, int(rng.integers(0, 8)), replace=False).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]
        pivot = np.sort(pivot)
        on = [minhash.is_linked(pivot, s, percent) for s in sets]
        apart = [np.setxor1d(pivot, s).tolist() for s in sets]
        often = Counter(e for d in apart for e in d)
        first = []
        for s, d, o in zip(sets, apart, on):
            size = minhash.prefix_size(len(s), len(pivot), len(d), o, percent)
            first.append({e: k for k, e in enumerate(sorted(d, key=lambda e: (often[e], e))[:size])})
        for i in range(len(sets)):
            for j in range(i):
                if not (on[i] and on[j]) and minhash.is_linked(sets[i], sets[j], percent) and set(sets[i]) != set(sets[j]):
                    if set(sets[i]) != set(pivot) and set(sets[j]) != set(pivot):
                        need = (100 + percent) * (len(apart[i]) + len(apart[j])) - (100 - percent) * (len(sets[i]) + len(sets[j]))
                        left = [min(len(apart[i]) - first[i][e], len(apart[j]) - first[j][e]) for e in first[i].keys() & first[j].keys()]
                        assert any(2 * (100 + percent) * x >= need for x in left)
