from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import langid, mixing, templates
from lexloom.llm.queries import piece_model
from tests.llm.test_minhash import brute, made


@pytest.fixture
def corpus(spark):
    texts = made(11, 80)
    texts += [f"Printed on page {k} of the yearly report\n{t}" for k, t in enumerate(made(12, 30))]
    texts += [None, "", "123 456", "same words here now and then again", "same words here now and then again"]
    rows = [(k, t, "en" if k % 2 else "de", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages(spark, corpus, tmp_path):
    rows, docs = corpus
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        out = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(out)
        now = spark.read.parquet(out)
        after = now.collect()
        by = {r["doc_id"]: r for r in before}
        if name != "encoded":
            assert now.columns == names
        if name == "language":
            model = langid.Scorer(langid.fit(docs))
            keep = {r["doc_id"] for r in before if model.score(r["text"])[0] != "und" and model.score(r["text"])[1] >= 0.5}
            assert {r["doc_id"] for r in after} == keep
        elif name == "lines":
            want = templates.brute_force([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r, w in zip(before, want) if not w[1] or w[1] < w[0]}
            assert any(r["text"] != by[r["doc_id"]]["text"] for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "near_duplicates":
            before.sort(key=lambda r: r["doc_id"])
            roots = brute([r["text"] for r in before], 5)
            assert {r["doc_id"] for r in after} == {before[k]["doc_id"] for k, (_, root) in enumerate(roots) if root == k}
        elif name == "mixture":
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
            plain = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in before]
            goal = water_level(plain)
            for source, target in goal.items():
                got = sum(len(r["text"].split()) for r in after if r["source"] == source)
                largest = max(n for _, s, n in plain if s == source)
                assert abs(got - target) <= largest + 2 * mixing.BLOCK, (source, got, target)
        else:
            assert len(after) == len(before) and all(r["round_trip"] for r in after)
            library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
            text = {r["doc_id"]: r["text"] for r in before}
            assert all(r["ids"] == library.encode(text[r["doc_id"]]) for r in after)


def water_level(rows):
    """Targets by pouring: 150 % of all words by weight; what is over twice a source's words goes to the others."""
    sizes = {}
    for _, source, n in rows:
        sizes[source] = sizes.get(source, 0) + n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    left, free, goal = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= share * weight[s]}
        for s in full or free:
            goal[s] = 2 * sizes[s] if full else share * weight[s]
            left -= goal[s]
        free -= full or free
    return goal


def run_all(spark, docs, tmp_path, names):
    """The rows after each stage but the last; all have the columns they started with."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "encoded":
            assert docs.columns == names
        out[name] = docs.collect()
    return out


def test_clashing_columns(spark, corpus, tmp_path):
    rows, _ = corpus
    more = ["score", "lang_pred", "n_lines", "n_removed", "__id", "__lines", "n_shingles", "kept", "component_id", "text_hash", "size", "taken", "start", "ids", "Round_Trip", "decoded", "__times", "__copy", "__score", "a.b"]
    names = ["doc_id", "text", "lang", "source", "n_chars", *more]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in more]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more)).repartition(3)
    out = run_all(spark, docs, tmp_path, names)
    assert len(out["encoded"]) > 50
    assert all(r[c] == f"{c}{r['doc_id']}" for c in more for r in out["mixture"])


def test_repeated_and_null_ids(spark, tmp_path):
    a, b, c, d = ["One language for all of these plain words " + " ".join(f"{w}{x}" for x in "abcdefghijkl") for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (7, d), (7, d), (9, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, a), (5, b), (None, c), (7, d), (7, d), (9, None), (None, "")])
    mixed = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect())
    # one source takes 1.5 times its words: each row once or twice, those of one doc_id by themselves
    assert set(mixed) == {(k, t) for k, t in rows if t} and all(n in (1, 2, 4) for n in mixed.values())
    labelled = docs.withColumn("doc_id", F.col("doc_id") + 1)
    out = run_all(spark, labelled, tmp_path, docs.columns)
    assert all(r["text"] for r in out["language"])


def test_run(spark, corpus, tmp_path):
    _, docs = corpus
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where("n_tokens > 0 and round_trip").count() > 50
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
