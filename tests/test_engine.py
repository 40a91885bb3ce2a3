"""The normalizer's contract on small texts, files, streams and the command line."""

from __future__ import annotations

import hashlib
import itertools
import json

import pytest

from lexloom import lexicon
from lexloom.__main__ import main
from lexloom.engine import Engine
from lexloom.operators import building
from lexloom.sources import files
from lexloom.streaming import flows


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, *texts):
    rows = Engine(spark, docs(spark, *texts)).table("events").orderBy("doc_id", "seg_no", "s").collect()
    return [(r.doc_id, r.s, r.e, r.key, r.mode) for r in rows]


def test_longest_match_wins_then_the_leftmost(spark):
    got = found(spark, "part of the house", "and of and the end")
    assert (0, 5, 11, "of the", "auto") in got and not any(k == "of" for d, _, _, k, _ in got if d == 0)
    assert [k for d, _, _, k, _ in got if d == 1] == ["and", "of", "and the"]


def test_overlapping_surfaces_resolve_by_length_then_place(spark):
    """Every pair of surfaces where an end of one is a beginning of the other."""
    more = [("core.the", "en", "the end", "alt", "auto", 3), ("core.of", "en", "end of", "alt", "auto", 4), ("core.in", "en", "end of the", "alt", "auto", 5), ("core.by", "en", "the end and", "alt", "auto", 6)]
    multi = sorted({f[2] for f in [*lexicon.FORMS, *more] if f[4] == "auto" and f[3] != "observed" and " " in f[2]})
    cases = []
    for a, b in itertools.permutations(multi, 2):
        x, y = a.split(), b.split()
        cases += [(a, b, " ".join(x + y[k:])) for k in range(1, min(len(x), len(y)) + 1) if x[-k:] == y[:k] and len(y) > k]
    assert len(cases) >= 8
    forms = spark.createDataFrame([*lexicon.FORMS, *more], lexicon.TABLES["forms"][0])
    rows = Engine(spark, docs(spark, *[c[2] for c in cases]), forms=forms).table("events").collect()
    for k, (a, b, text) in enumerate(cases):
        runs = [text.split()[i : i + n] for n in (3, 2, 1) for i in range(len(text.split()) - n + 1)]
        want = next(" ".join(r) for r in runs if " ".join(r) in multi)
        assert want in {r.key for r in rows if r.doc_id == k}, text


def test_places_of_all_events(spark):
    texts = ["Straße é of the 🙂 hill\n\n  \nñ and 🙂 the sea\nthe end", "the", "🙂\nof é of the"]
    engine = Engine(spark, docs(spark, *texts))
    events = engine.table("events").collect()
    assert {v.n for v in events} >= {1, 2}
    octets = lambda d, at: len(texts[d][:at].encode())
    want = sorted((v.doc_id, v.seg_no, v.s, octets(v.doc_id, v.seg_start + v.s), octets(v.doc_id, v.seg_start + v.e)) for v in events)
    assert sorted(tuple(r) for r in engine.run("p_byte_offsets").collect()) == want
    before = [(v.doc_id, texts[v.doc_id][: v.seg_start + v.s]) for v in events]
    want = sorted((d, len(x), x.count("\n") + 1, len(x) - x.rfind("\n") - 1) for d, x in before)
    assert sorted(tuple(r) for r in engine.run("p_line_col").select("doc_id", "start_at", "line", "col").collect()) == want


def test_forbidden_phrases_free_their_span(spark):
    assert all(k != "of" for _, _, _, k, _ in found(spark, "cup of of tea"))
    assert any(k == "of" for _, _, _, k, _ in found(spark, "cup of tea"))


def test_records_cover_their_segments(spark):
    texts = ["The house of the king\n\nis not on a hill.", "", "\n \n", "ß Straße és el perro de la casa", "🙂 the 🙂 of the 🙂"]
    out = Engine(spark, docs(spark, *texts)).normalize().collect()
    assert {r.doc_id for r in out} == {0, 3, 4}
    for r in out:
        assert texts[r.doc_id][r.start : r.end] == r.original
        for v in r.match_events or []:
            assert 0 <= v.s < v.e <= len(r.original)
    assert {r.status for r in out} <= {"review", "accepted", "partial"}
    assert next(r for r in out if r.doc_id == 0 and r.seg_no == 2).needs_review


def test_null_texts_and_empty_tables(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert Engine(spark, none).normalize().count() == 0
    assert Engine(spark, none.limit(0)).table("events").count() == 0


def test_partitioning_changes_nothing(spark):
    d = docs(spark, *["the king of the hill and the sea"] * 20)
    assert sorted(Engine(spark, d).table("events").collect()) == sorted(Engine(spark, d.repartition(7)).table("events").collect())


def test_search_ranks_by_score_then_id(spark):
    engine = Engine(spark, docs(spark, "red fox runs", "red red fox", "blue whale", "red fox runs"))
    rows = engine.search(spark.createDataFrame([(7, "fox runs")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in rows][:2] == [0, 3] and {r.item_id for r in rows} == {7}


def test_term_frequency_of_all_terms(spark):
    rows = Engine(spark, docs(spark, "red red fox", "fox", "")).run("a_tf").collect()
    assert sorted(tuple(r) for r in rows) == [(0, "fox", 1), (0, "red", 2), (1, "fox", 1)]


def test_bootstrap_resamples_paired_deltas(spark):
    engine = Engine(spark, docs(spark, "x"))
    deltas = [0.0, 0.5, -0.25, 1.0, 0.1]
    engine.dialect.frames["deltas"] = spark.createDataFrame([("B", k, len(deltas), d) for k, d in enumerate(deltas)], "arm string, place long, n long, delta double")
    draw = lambda rep, k: int(hashlib.md5(f"1729:{rep}:{k}".encode()).hexdigest()[:12], 16) % len(deltas)
    means = sorted(round(sum(deltas[draw(rep, k)] for k in range(5)) / 5, 9) for rep in range(2000))
    (row,) = engine.run("e_bootstrap").collect()
    assert (row.low, row.high, row.n) == (pytest.approx(means[50], abs=1e-5), pytest.approx(means[1949], abs=1e-5), 2000)
    assert row.low < 0 < row.high


def test_deltas_of_the_bootstrap_are_those_of_the_ablation(spark):
    engine = Engine(spark, docs(spark, "red fox runs", "of the hill", "blue whale of the sea"))
    engine.dialect.frames["benchmark"] = spark.createDataFrame([(1, "fox"), (2, "of the"), (3, "absent")], "item_id long, text string")
    rows = engine.run("e_ablation").orderBy("arm", "item_id").collect()
    assert [(r.arm, round(r.delta, 6)) for r in engine.table("deltas").orderBy("arm", "place").collect()] == [(r.arm, r.delta) for r in rows]
    assert [r.arm for r in rows] == ["B", "B", "C", "C", "D", "D", "E", "E"]


def test_protected_families(spark):
    texts = {
        "html_block": ["a <PRE class='x'>one <b>\ntwo</pre > b <code>c</code>", ["<PRE class='x'>one <b>\ntwo</pre >", "<code>c</code>"]],
        "frontmatter": ["---\ntitle: x\n---\nbody\n---\n", ["---\ntitle: x\n---"]],
        "fenced_code": ["see\n```py\nx = 1\n```\nand\n~~~\ny\n~~~ z\nend ``` no\n", ["```py\nx = 1\n```\n", "~~~\ny\n~~~ z\n"]],
        "link_destination": ["[a](b/c.md) and ![](d) [e] (f)", ["b/c.md", "d"]],
        "placeholder": ["${{ a b }} {{c}} ${d_1} %(e)s <% f %> {g}", ["${{ a b }}", "{{c}}", "${d_1}", "%(e)s", "<% f %>", "{g}"]],
    }
    rows = Engine(spark, docs(spark, *[t for t, _ in texts.values()], "x\n---\nno front matter\n---\n")).run("g_protected_raw").collect()
    for k, (family, (text, want)) in enumerate(texts.items()):
        got = sorted((r.s, r.e, r.piece) for r in rows if r.doc_id == k and r.family == family)
        assert [p for _, _, p in got] == want and all(text[s:e] == p for s, e, p in got), family
    assert not any(r.family == "frontmatter" for r in rows if r.doc_id == len(texts))


def test_recall_at_all_cutoffs(spark):
    engine = Engine(spark, docs(spark, "x"))
    engine.dialect.frames["qrels"] = spark.createDataFrame([(1, d) for d in (10, 20, 30, 40)], "item_id long, doc_id long")
    engine.dialect.frames["ranked"] = spark.createDataFrame([(1, 10, 9.0, 2), (1, 20, 8.0, 4), (1, 30, 7.0, 9), (1, 40, 6.0, 50), (1, 5, 9.5, 1)], "item_id long, doc_id long, score double, rank int")
    (row,) = engine.run("e_metrics").collect()
    assert [row[f"recall_{k}"] for k in (1, 3, 5, 10, 50)] == [0, 0.25, 0.5, 0.75, 1]


def test_rounds_end_with_the_pool_or_at_their_limit(spark, tmp_path):
    docs(spark, " ".join(f"word{k}" for k in range(200)) + " a bc").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda *limits: [tuple(r) for r in building.converge(spark, str(tmp_path), *limits).orderBy("round").collect()]
    assert run() == [(k, 24 * k, 24 * k, 202) for k in range(1, 9)]
    assert [r[:2] for r in run(90)] == [(1, 90), (2, 180), (3, 200)]
    assert [r[:2] for r in run(50, 3)] == [(1, 50), (2, 100), (3, 150)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("of the hill")
    (tmp_path / "in" / "deep" / "b.txt").write_text("the sea")
    rows = files.scan(spark, str(tmp_path / "in")).collect()
    assert sorted((r.kind, r.text) for r in rows) == [("markdown", "of the hill"), ("text", "the sea")]
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe\x00x")
    assert files.quarantined(spark, str(tmp_path / "in")).count() == 1
    with pytest.raises(Exception):
        files.scan(spark, str(tmp_path / "in")).collect()
    table = spark.createDataFrame([(2, "b"), (1, None)], "z int, a string")
    files.write_jsonl(table, str(tmp_path / "out"), ["z"], one_file=True)
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [{"a": None, "z": 1}, {"a": "b", "z": 2}]
    assert files.append(table, str(tmp_path / "store"), "z") == 2
    assert files.append(table, str(tmp_path / "store"), "z") == 0


def test_python_segments(spark):
    source = '"""Top é."""\nx = 1  # one\n\ndef f():\n    """Inner."""\n    return "# no"\n'
    got = files.python_parts(source)
    assert [source[s:e] for s, e, _ in got] == ['"""Top é."""', "# one", '"""Inner."""']
    assert files.python_segments(docs(spark, source)).count() == 3
    with pytest.raises(files.ContractError):
        files.python_parts("def (:")


def test_ledger_steps():
    assert flows.step(0, "open", "ABSTAIN", 0, ["a"]) == (1, "unresolved", "")
    assert flows.step(1, "unresolved", "a", 0.5, ["a"]) == (2, "accepted", "")
    assert flows.step(1, "unresolved", "ABSTAIN", 0, ["a"]) == (2, "rejected", "")
    assert flows.step(2, "accepted", "a", 0.5, ["a"])[2] == "terminal"
    assert flows.step(0, "open", "b", 0.5, ["a"])[2] == "invalid"


def test_command_line(spark, tmp_path, capsys):
    assert main(["query", "part of the whole"], spark) == 0
    record = json.loads(capsys.readouterr().out.splitlines()[0])
    assert record["match_events"][0]["key"] == "of the"
    assert main(["validate"], spark) == 0
    assert main(["export", "skos", str(tmp_path / "skos")], spark) == 0
    assert spark.read.text(str(tmp_path / "skos")).count() > 50
    assert main(["normalize", str(tmp_path / "absent"), str(tmp_path / "x")], spark) == 2


def test_matches_do_not_cross_protected_text(spark):
    texts = ["see `of the` and of the sea", "go to [x](is/of the/a) is", "<b>of</b> the sea", "run --of-the now of"]
    rows = Engine(spark, docs(spark, *texts)).table("events").collect()
    found = {(r.doc_id, texts[r.doc_id][r.seg_start + r.s : r.seg_start + r.e]) for r in rows}
    assert found == {(0, "and"), (0, "of the"), (1, "to"), (1, "is"), (2, "of"), (2, "the"), (3, "of")}
    assert [r.s for r in rows if r.doc_id == 0 and r.key == "of the"] == [17]


def test_unsafe_rewrites_are_not_done(spark):
    forms = spark.createDataFrame(
        [("a.near", "en", "afar", "pref", "auto", 0), ("a.near", "en", "near", "alt", "auto", 1), ("a.seen", "en", "seen", "pref", "auto", 0), ("a.seen", "en", "is seen", "alt", "auto", 1),
         ("a.cut", "en", "part of", "pref", "auto", 0), ("a.cut", "en", "part of it", "alt", "auto", 1), ("a.num", "en", "rule", "pref", "auto", 0), ("a.num", "en", "rule 17", "alt", "auto", 1), ("a.ok", "en", "quick", "pref", "auto", 0), ("a.ok", "en", "fast", "alt", "auto", 1)],
        "concept_id string, lang string, form string, kind string, policy string, ord int")
    concepts = spark.createDataFrame([(f"a.{c}", "entity", "noun", "x", "core", "A") for c in ("near", "seen", "cut", "num", "ok")], "concept_id string, semantic_class string, pos string, definition string, contexts string, authority string")
    engine = Engine(spark, docs(spark, "near\nis seen\npart of it\nrule 17\nfast"), forms=forms, concepts=concepts)
    assert [r.verdict for r in engine.run("f_rewrite_safe").orderBy("seg_no").collect()] == ["antonym", "copula", "dangling", "protected", "safe"]
    assert [r.canonical_text for r in engine.table("canonical").orderBy("seg_no").collect()] == ["near", "is seen", "part of it", "rule 17", "quick"]


def test_amendments_of_a_users_own_tables(spark):
    kind = "seq int, batch int, op string, concept_id string, lang string, form string, value string"
    made = [(1, 1, "add_concept", "core.up", "en", "up", "above"), (2, 1, "link_broader", "core.up", "", "", "core.in"), (3, 2, "demote", "core.of", "en", "of", ""), (4, 2, "demote", "core.of", "en", "off", "")]
    engine = Engine(spark, amendments=spark.createDataFrame(made, kind))
    assert [(r.seq, r.fault) for r in engine.run("x_amend_refusals").collect()] == [(4, "unknown_form")]
    forms = {(r.concept_id, r.form): r.policy for r in engine.run("x_amend").collect()}
    assert forms["core.up", "up"] == "auto" and forms["core.of", "of"] == "auto"  # batch 2 is not written at all
    assert ("core.up", "core.in") in {tuple(r) for r in engine.run("x_amend_links").collect()}
