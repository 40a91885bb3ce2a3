import numpy as np

from lexloom.llm import hamming, templates


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>, code string, ids string").repartition(3)


def brute(rows, asked, k, dims=64):
    coded = [(i, c) for (i, _, _, _), c in zip(rows, hamming.codes([r[1] for r in rows], dims)) if c is not None and i is not None]
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    out = set()
    for at, (i, c) in enumerate(coded):
        if i in asked:
            near = sorted((far(c, d), j) for other, (j, d) in enumerate(coded) if other != at)[:k]
            out |= {(i, n + 1, j, d) for n, (d, j) in enumerate(near)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(5, 64))
    rows = [(k, (centers[k % 5] + rng.normal(size=64) * (0.2 + k % 3)).astype(float).tolist(), "x", "y") for k in range(240)]
    rows += [(1000 + k, rows[0][1], "x", "y") for k in range(40)]
    rows += [(2000, None, "x", "y"), (2020, [], "x", "y"), (2040, [1.0] * 3, "x", "y"), (None, [1.0] * 64, "x", "y"), (2060, [None, float("nan")] * 32, "x", "y")]
    table = vectors(spark, rows)
    for k in (1, 10):
        got = {tuple(r) for r in hamming.top_k(table, table.where("id % 20 = 0"), k).collect()}
        assert got == brute(rows, {r[0] for r in rows if r[0] is not None and r[0] % 20 == 0}, k)


def test_top_k_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "CODES", 40)
    monkeypatch.setattr(hamming, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=20).tolist(), "x", "y") for k in range(150)]
    table = vectors(spark, rows)
    got = {tuple(r) for r in hamming.top_k(table, table.where("id % 20 = 0"), 5, 20).collect()}
    assert got == brute(rows, {k for k in range(0, 150, 20)}, 5, 20)


def test_top_k_small_tables(spark):
    empty = vectors(spark, [])
    assert hamming.top_k(empty, empty).count() == 0
    one = vectors(spark, [(0, [1.0] * 64, "x", "y")])
    assert hamming.top_k(one, one).count() == 0


def test_templates(spark, docs, odd):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    texts = list(odd)
    for k in range(80):
        lines = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 14)))) for _ in range(int(rng.integers(1, 6)))]
        lines.insert(int(rng.integers(len(lines) + 1)), f"Page {k} of {k + 7} printed for user{k} on the office machine today")
        if k % 3 == 0:
            lines.append("All rights reserved by the owner of this page")
        if k % 4 == 0:
            lines.append(f"Posted by {rng.choice(vocabulary)} in the news section of the site")
        texts.append("\n".join(lines))
    texts += [texts[20]] * 15
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in templates.digest(docs(texts)).collect()}
    want = templates.brute_force(list(enumerate(texts)))
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[1] for w in want) > 100


def test_template_rules(spark, docs):
    same = "one two three four five"
    out = {r["doc_id"]: r for r in templates.drop_templates(docs([(k, f"{same}\nown line {chr(97 + k)} here") for k in range(8)])).collect()}
    assert out[0]["text"].startswith(same) and all(not out[k]["text"].startswith(same) for k in range(1, 8))
    assert out[3]["text"] == "own line d here" and out[3]["source"] == "s0" and out[3]["size"] == "y"
    few = templates.drop_templates(docs([(k, same + " " * k) for k in range(7)])).collect()
    assert all(r["n_removed"] == 0 for r in few)
    assert templates.drop_templates(docs([])).count() == 0
    nulls = templates.drop_templates(docs([(None, f"{same}\n{k}a") for k in range(9)])).collect()
    assert len(nulls) == 9


def test_copied_lines_go_from_the_second_document(spark, docs):
    long, field, short = "The harbour office closes at noon", "Call 555 0100 or 555 0101 today", "Read more"
    texts = [f"{short}\nfirst text\n{long}", f"{long}\nsecond text\n{field}\n{short}", f"{field}\n{long}\n{long}\nthird text", long, *["a text of its own that is there twice"] * 2, None, ""]
    out = [r["text"] for r in templates.drop_templates(docs(texts)).orderBy("doc_id").collect()]
    assert out == [texts[0], f"second text\n{field}\n{short}", "third text", "", *texts[4:]]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in templates.digest(docs(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == templates.brute_force(list(enumerate(texts)))
    nulls = templates.drop_templates(docs([(None, f"{long}\na"), (None, f"{long}\nb")])).collect()
    assert all(r["n_removed"] == 0 for r in nulls)
    nulls = templates.drop_templates(docs([(None, f"{long}\na"), (4, f"{long}\nb")])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in nulls} == {None: 1, 4: 0}
