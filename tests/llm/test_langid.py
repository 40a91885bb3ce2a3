import zlib

import numpy as np

from lexloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def corpus(spark, n=200):
    rng = np.random.default_rng(7)
    base = {"aa": ["lo", "mi", "ke", "ra"], "bb": ["zu", "sch", "ang", "und"], "cc": ["wyn", "xi", "qu", "oth"]}
    rows = []
    for k in range(n):
        lang = sorted(base)[k % 3]
        made = " ".join("".join(rng.choice(base[lang], int(rng.integers(1, 5)))) for _ in range(12))
        rows.append((k, made, lang, "s", "x"))
    rows += [(n, None, "aa", "s", "x"), (n + 1, "", None, "s", "x"), (n + 2, "123 --", "bb", "s", "x"), (None, "lomi", None, "s", "x"), (n + 3, "一", None, "s", "x")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_held_out(spark):
    rows, table = corpus(spark)
    got = langid.identify(table).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] < 200]
    assert len(right) > 20 and np.mean(right) > 0.98
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in (200, 201, 202):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_backs_off():
    model = langid.Model(["x", "y"], {"abc": (-1.0, -5.0)}, {3: {"<ab": (-2.0, -3.0)}, 1: {"z": (-9.0, -1.0), "q": (-3.0, -1.0)}})
    assert model.vector("abc") == (-1.0, -5.0)
    assert model.vector("abd") == (-2.0, -3.0)
    assert model.vector("qzq") == (-5.0, -1.0)
    assert model.vector("w") is None


def test_nothing_to_learn(spark):
    table = spark.createDataFrame([(1, "a b", None, "s", "x")], SCHEMA)
    assert [r["lang_pred"] for r in langid.identify(table).collect()] == ["und"]
    assert langid.identify(table.limit(0)).count() == 0


def test_labels_are_no_input(spark):
    rows, table = corpus(spark)
    model = langid.fit(table)
    from pyspark.sql import functions as F

    hidden = table.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    key = lambda f: sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in f.collect())
    assert key(langid.predict(hidden, model)) == key(langid.predict(table.drop("score"), model))
