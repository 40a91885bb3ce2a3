"""What keeps the plans in proportion to their input: no token is dealt, texts are read once, and shortcuts change nothing."""

from __future__ import annotations

import random
import re

import pytest

from lexloom.engine import Engine
from lexloom.operators import lines
from lexloom.plans import queries_core


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_and_candidates_are_made_within_documents(spark):
    """F13 to F31: windows over all tokens of a document had them dealt and sorted three times."""
    engine = Engine(spark, docs(spark, "part of the house"))
    for name in ("segments", "tokens", "spans", "found"):
        text = plan(engine.table(name))
        assert "Window" not in text and "Aggregate" not in text, name


def test_runs_are_counted_once_for_the_value_of_terms(spark):
    """the runs of all texts were made six times."""
    engine = Engine(spark, docs(spark, *["the end of the end of the end"] * 3))
    frame = engine.run("a_cvalue")
    assert plan(frame).count("regexp_replace(") == 1
    rows = {r.key: (r.freq, r.cvalue) for r in frame.collect()}
    # "the end" lies within "end of the"? No: within "the end of" (6 times) and "of the end" (6 times); it occurs 9 times.
    assert rows["the end"] == (9, round(1.584962500721156 * (9 - 6), 4))
    # A run that holds a part twice gives its frequency to it once: "the" is in 2 runs of two words and 3 of three.
    assert rows["the"] == (9, round(9 - (9 + 6 + 6 + 6 + 6) / 5, 4))


def test_events_are_made_once_for_all_uses(spark):
    """F2 to F6, F9 to F11: each use of the events in a query made them again from the texts."""
    engine = Engine(spark, docs(spark, "part of the house is not that by 1234 of"))
    for name in ("a_drift", "a_outlier", "a_priority", "a_risk", "j_semi_risk", "j_absorbed", "i_sidecar"):
        text = plan(engine.run(name))
        assert "MapInArrow" not in text and "html_block" not in text, name


def test_only_terms_that_queries_ask_for_are_kept(spark):
    """F8 to F10, F27 to F30: all postings of all terms were dealt and written."""
    queries = spark.createDataFrame([("q", "hill end")], "item_id string, text string")
    engine = Engine(spark, docs(spark, "the hill of the end", "sea"), benchmark=queries)
    assert {r.term for r in engine.table("asked").collect()} == {"hill", "end"}
    assert {r.term for r in engine.table("postings").collect() if r.field == "raw"} == {"hill", "end"}
    assert [(r.item_id, r.doc_id) for r in engine.run("r_bm25").collect()] == [("q", 0)]


@pytest.mark.parametrize("seed", range(3))
def test_hints_never_hide_a_match(spark, seed):
    pieces = ["<code>x</code>", "<pre >\n</pre>", "---\na\n---\n", "```\nx\n```\n", "~~~\nx\n~~~", "<b>", "`x`", "[a](b c)", "https://a.b/c", "a@b.cd", "${{ x }}", "{{x}}", "${a}", "%(a)s", "<% x %>", "{a_b}", "--flag", "-f", "C:\\x", "D:/y", "./p", "../p", "/p", "1.2.3", "0123456789abcdef01", "AB-1", "A-B-C", "3 km", "5%", "a_b", "aB", "a.b", "a..b", "x-.y", "é.b", "word", " ", "\n"]
    rand = random.Random(seed)
    texts = ["".join(rand.choice(pieces) + rand.choice(["", " ", "\n"]) for _ in range(rand.randint(1, 4))) for _ in range(400)]
    frame = docs(spark, *texts)
    for name, p, *around in queries_core.FAMILIES:
        if name in queries_core.HINTS:
            before, after = around or ("", "")
            whole = f"({before})({p.replace('(?ms)', '(?msd)')})({after})"
            assert frame.where(f"regexp_like(text, r'{whole}') AND NOT {queries_core.HINTS[name].format('text')}").count() == 0, name


def test_candidates_of_one_line_equal_all_pairs(spark):
    """Resolution in runs of overlapping candidates equals the fold over all of them."""
    rows = [(k, "auto", f"core.c{j}", "en", f"core.c{j}") for j, k in enumerate(["a", "b", "a b", "b a", "a b a", "b b", "b b a"])]
    matcher = lines.Matcher(sorted(rows), [("core.c0", "en", "a c"), ("core.c2", "en", "c a b")], ["c"], 3, lines.word_pattern())
    rand = random.Random(5)
    for _ in range(300):
        line = " ".join(rand.choice("aabbc") for _ in range(rand.randint(1, 30)))
        cands, blocked, kept, words = matcher.line(line)
        taken = []
        for c in sorted(cands, key=lambda c: (-c[2], c[0])):
            if not any(t[0] < c[1] and t[1] > c[0] for t in taken):
                taken.append(c)
        assert sorted(kept) == sorted(taken)
        assert words.get("c", 0) == line.count("c")
        keys = sorted(r[0] for r in rows)
        inside = lambda c: any(keys[c[4]] == key and any(at <= c[0] and c[1] <= at + len(p) for at in (m.start() for m in re.finditer(f"(?={p})", line))) for key, p in (("a", "a c"), ("a b", "c a b")))  # noqa: B023, E731
        assert all(inside(c) for c in blocked) and not any(inside(c) for c in cands)


def test_places_of_a_text_of_one_line(spark):
    """Places are sums over blocks of pieces: they hold beyond one block and for words beyond ASCII."""
    text = "\n".join(["é of 🙂 hill, the end " * 90, "", "by " * 70])
    engine = Engine(spark, docs(spark, text))
    rows = engine.table("tokens").collect()
    assert len(rows) == 5 * 90 + 70
    assert all(text[r.seg_start + r.s : r.seg_start + r.e] == r.token for r in rows)
    events = engine.table("events").collect()
    assert all(text[v.seg_start + v.s : v.seg_start + v.e].lower() == v.key for v in events) and len(events) == 2 * 90 + 70


def test_contexts_are_made_within_lines(spark):
    """all tokens met all events twice for each use of the contexts."""
    engine = Engine(spark, docs(spark, "red hill of the blue sea and by green"))
    assert "Aggregate" not in plan(engine.table("kwic")) and "Window" not in plan(engine.table("kwic"))
    rows = {(r.key, r.word, r["at"]) for r in engine.table("kwic").collect() if r.key == "of the"}
    assert rows == {("of the", "red", -2), ("of the", "hill", -1), ("of the", "blue", 2), ("of the", "sea", 3), ("of the", "by", 5), ("of the", "green", 6)}
    for name in ("a_drift", "a_risk"):
        assert "regexp_replace" not in plan(engine.run(name)), name
