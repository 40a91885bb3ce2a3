import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from lexloom.llm import digest, mixing, tokenstore
from lexloom.llm.common import Scratch
from lexloom.llm.queries import tokenizer_file


def texts_of(odd):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "Gamma", "Δέλτα", "épsilon", "12,5", "<|endoftext|>", "it's"]
    return odd + [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 3000, 20)]


def test_store_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    texts = texts_of(odd)
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    path = Scratch(spark, "test").path("store")
    tokenstore.write(docs(texts), path, tokenizer_file("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in tokenstore.read(spark, path).collect()}
    ids = {r["doc_id"]: bytes(r["ids"]) for r in tokenstore.reconstruct(spark, path).collect()}
    start = 0
    for k, t in enumerate(texts):
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        assert ids[k] == want.tobytes()
        start += len(want)
    assert tokenstore.verify_manifest(spark, path).count() == 0
    chunks, recipes, _ = tokenstore.open_store(spark, path)
    assert chunks.count() == chunks.select("name").distinct().count()
    assert recipes.where("doc_id in (4, 5)").select("root").distinct().count() == 1


def test_store_empty(spark, docs):
    path = Scratch(spark, "test").path("store")
    tokenstore.write(docs([]), path, tokenizer_file("word_bpe_49k.json"))
    assert tokenstore.read(spark, path).count() == 0


@pytest.mark.parametrize("damage", ["lost", "repeated", "swapped"])
def test_reading_checks_the_manifest(spark, docs, damage):
    path = Scratch(spark, "test").path("store")
    tokenstore.write(docs([f"text number {k} of the store" for k in range(12)]), path, tokenizer_file("word_bpe_49k.json"))
    recipes = tokenstore.open_store(spark, path)[1]
    rows = [r.asDict() for r in recipes.orderBy("shard", "start_in_shard").collect()]
    if damage == "lost":
        del rows[3]
    elif damage == "repeated":
        rows.append(rows[3])
    else:
        a, b = next((a, b) for a, b in zip(rows, rows[1:]) if a["shard"] == b["shard"])
        a["root"], b["root"], a["chunks"], b["chunks"] = b["root"], a["root"], b["chunks"], a["chunks"]
    spark.createDataFrame([tuple(r[c] for c in recipes.columns) for r in rows], recipes.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="do not match the manifest"):
        tokenstore.read(spark, path)


def test_store_finds_damage(spark, docs, odd):
    batches = list(tokenstore._sums(iter([])))
    assert batches == []
    import pyarrow as pa

    bad = pa.RecordBatch.from_arrays([pa.array([b"x" * 16]), pa.array([1], pa.int64()), pa.array([b"\1\0"])], ["name", "n", "ids"])
    with pytest.raises(ValueError, match="does not match"):
        list(tokenstore._sums(iter([bad])))


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 49000, 20000).astype("<u4")
    b = np.concatenate([rng.integers(0, 49000, 777).astype("<u4"), a])
    part = lambda x: {x[s:e].tobytes() for s, e in zip([0, *tokenstore.cuts(x)], tokenstore.cuts(x))}
    assert len(part(a) & part(b)) > 0.8 * len(part(a))
    assert all(e - s <= tokenstore.MOST for s, e in zip([0, *tokenstore.cuts(a)], tokenstore.cuts(a)))


def test_crc_of_parts():
    rng = np.random.default_rng(2)
    parts = [[rng.bytes(int(n)) for n in rng.integers(0, 400, 9)] for _ in range(20)]
    parts[7], parts[9] = [], parts[9][:1]
    sizes, sums = [np.array([f(p) for x in parts for p in x]) for f in (len, zlib.crc32)]
    assert tokenstore.combined(sizes, sums, np.cumsum([0, *map(len, parts)])).tolist() == [zlib.crc32(b"".join(x)) for x in parts]


def test_cuts_of_streams_put_together():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 49000, n).astype("<u4") for n in (1, 15, 16, 17, 128, 129, 3000, 1, 9000, 40, 5000)]
    together = tokenstore.cuts_of(np.concatenate(streams), [len(s) for s in streams])
    assert together == [tokenstore.cuts(s) for s in streams]


def test_tree_is_merkle():
    for n in range(20):
        names = [bytes([k]) * 16 for k in range(n)]
        tree = tokenstore.Tree()
        for x in names:
            tree.add(x)
        assert tree.root() == tokenstore.merkle(names)


def test_fingerprints(spark, docs, odd):
    texts = texts_of(odd)
    got = {r["doc_id"]: r for r in digest.fingerprints(docs(texts)).collect()}
    plain = [t or "" for t in texts]
    for k, t in enumerate(plain):
        after = plain[(k + 1) % len(plain)]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == digest.digest(t) and r["edited_fingerprint"] == digest.digest(changed)
        assert r["near_edited"] == float(digest.canonical(t) == digest.canonical(changed))
        assert r["near_next"] == float(digest.canonical(t) == digest.canonical(after))
    assert got[4]["fingerprint"] == got[5]["fingerprint"] == got[6]["fingerprint"]
    assert len(got) == len(texts)


def test_fingerprints_small_tables(spark, docs):
    assert digest.fingerprints(docs([])).count() == 0
    one = digest.fingerprints(docs(["abcd"])).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    twice = digest.fingerprints(docs([(1, "abcd"), (1, "abcd"), (None, None)])).collect()
    assert len(twice) == 3


def test_fingerprints_that_collide(spark, docs, monkeypatch):
    every = digest.fingerprints(docs(["one text", "another text", "third"]))
    every = every.replace(digest.digest("another text"), digest.digest("one text"), "fingerprint")
    clash = spark.createDataFrame([(digest.digest("one text"),)], "key string")
    out = {r["doc_id"]: r["fingerprint"] for r in digest.resolve(docs(["one text", "another text", "third"]), every, clash).collect()}
    assert out[0].startswith(digest.digest("one text") + "-") and out[2] == digest.digest("third")


def brute_mix(texts, source):
    size = [len((t or "").split()) for t in texts]
    names = sorted({source(k) for k in range(len(texts))}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(n for k, n in enumerate(size) if source(k) == s) for s in names}
    goal, free, left = {}, set(names), 1.5 * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * total[s] <= level * weight[s]}
        if not over:
            goal |= {s: level * weight[s] for s in free}
            break
        goal |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        free -= over
    return size, total, goal


def test_mix(spark, docs, odd):
    source = lambda k: [None, "b", "a", "z", "é"][k % 5]
    rng = np.random.default_rng(3)
    texts = odd + [" ".join("w" * int(n)) for n in rng.integers(1, 900, 60)]
    table = docs(texts, source)
    rows = mixing.taken(table, block=16).collect()
    size, total, goal = brute_mix(texts, source)
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        k = r["doc_id"]
        assert r["size"] == size[k] and r["source_size"] == total[source(k)]
        assert r["target"] == pytest.approx(goal[source(k)])
        assert 0 <= r["taken"] <= 2 * size[k]
        by[source(k)] = by.get(source(k), 0) + r["taken"]
    for s, got in by.items():
        assert abs(got - goal[s]) <= 16 * 6
    again = mixing.taken(docs(texts, source), block=16).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_mix_plan_is_whole(spark, docs):
    table = docs(["a b c d e f g " * 9] * 12)
    placed, goal, parts = mixing.mix(table, block=8)
    slots = parts.groupBy("slot").sum("words").collect()
    assert all(r[1] <= 8 for r in slots)
    assert parts.groupBy("source", "start", "copy").sum("words").where("`sum(words)` > 63").count() == 0


def test_mix_odd_tables(spark, docs):
    assert mixing.taken(docs([])).count() == 0
    assert [r["taken"] for r in mixing.taken(docs([None, ""])).collect()] == [0, 0]
    assert len(mixing.taken(docs([(1, "a b"), (1, "a b"), (None, "c")])).collect()) == 3


def test_long_hash_is_wide():
    assert len(digest.digest("x")) == 32 == len(xxhash.xxh3_128_hexdigest(b""))


def test_odd_texts_by_code_point():
    import re

    rule = re.compile(r"[\x1c-\x1f\x85\xa0İɐ-\U0010ffff]|(?:[^\w\s]|_){2}").search
    for c in map(chr, [*range(1, 0x300), 0x1F600]):
        for text in (c, f"a{c}b", f".{c}", f"{c}_", f" {c} "):
            assert tokenstore.odd(text) == bool(rule(text)), repr(text)
