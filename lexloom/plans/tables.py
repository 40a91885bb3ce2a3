"""Tables that queries build on: for Spark a DataFrame, for DuckDB the text of the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import lexicon
from lexloom.functions import text as T
from lexloom.operators import normalize
from lexloom.sources.shared import stored

SPARK, DUCK = {}, {}
DOCUMENTS = "documents"
FOLD = "replace(lower({}), 'ß', 'ss')"


def _add(name: str, spark, duck) -> None:
    if name in SPARK:
        raise ValueError(f"table {name} twice")
    SPARK[name], DUCK[name] = spark, duck


def table(name: str, duck):
    """Register the decorated DataFrame maker and its SQL."""

    def add(make):
        _add(name, make, duck if callable(duck) else lambda m: duck)
        return make

    return add


for _name, (_columns, _rows) in lexicon.TABLES.items():
    table(_name, lexicon.values(_rows, _columns))(lambda m, c=_columns, r=_rows: m.session.sql(lexicon.values(r, c)))


def derived(name: str, keep: bool = False):
    """Register a table whose text both engines take; with keep Spark writes it once for all uses in a plan."""

    def add(make):
        _add(name, lambda m: stored(m.session.sql(make(m)), name) if keep else m.session.sql(make(m)), make)
        return make

    return add


#: Tables with rows of their own that a user's tables may replace.
GIVEN: set[str] = set()


def fixture(name: str, columns: str, rows: list[tuple]) -> None:
    """A small table of literals in both engines; the engine takes a user's table of the same columns in its place."""
    GIVEN.add(name)
    names = [c.split()[0] for c in columns.split(", ")]
    typed = ", ".join(f"cast({n} AS {kind}) AS {n}" for n, kind in (c.split() for c in columns.split(", ")))
    table(name, lexicon.values(rows, names))(lambda m: m.session.sql(f"SELECT {typed} FROM ({lexicon.values(rows, names)})"))


def chain(p: str, docs: str) -> None:
    """Segments, tokens, spans, candidates and events of a table of doc_id and text, each named with the prefix."""

    @table(f"{p}segments", lambda m: f"""
SELECT doc_id, seg_no, seg_start, line FROM (
  SELECT doc_id, seg_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg_start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS seg_no FROM {m.t(docs)}))
WHERE trim(line) <> ''""")
    def _segments(m):
        return normalize.segments(m.frame(docs))

    @table(f"{p}tokens", lambda m: f"""
SELECT doc_id, seg_no, seg_start, ((ix + 1) // 2)::INTEGER AS tok_no, piece AS token, {FOLD.format('piece')} AS key, s::INTEGER AS s, (s + length(piece))::INTEGER AS e FROM (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, seg_no ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, seg_no, seg_start, unnest(parts) AS piece, generate_subscripts(parts, 1) - 1 AS ix
        FROM (SELECT *, string_split_regex(regexp_replace(line, '({T.WORD})', chr(1) || '\\1' || chr(2), 'g'), '[\\x01\\x02]') AS parts FROM {m.t(p + 'segments')})))
WHERE ix % 2 = 1""")
    def _tokens(m):
        return normalize.tokens(m.frame(f"{p}segments"))

    @table(f"{p}spans", lambda m: f"""
SELECT doc_id, seg_no, seg_start, tok_no, s, 1 AS n, key, e FROM {m.t(p + 'tokens')}
UNION ALL SELECT doc_id, seg_no, seg_start, tok_no, s, 2, key || ' ' || k2, e2 FROM (SELECT *, lead(key) OVER w AS k2, lead(e) OVER w AS e2 FROM {p}tokens WINDOW w AS (PARTITION BY doc_id, seg_no ORDER BY tok_no)) WHERE e2 IS NOT NULL
UNION ALL SELECT doc_id, seg_no, seg_start, tok_no, s, 3, key || ' ' || k2 || ' ' || k3, e3 FROM (SELECT *, lead(key) OVER w AS k2, lead(key, 2) OVER w AS k3, lead(e, 2) OVER w AS e3 FROM {p}tokens WINDOW w AS (PARTITION BY doc_id, seg_no ORDER BY tok_no)) WHERE e3 IS NOT NULL""")
    def _spans(m):
        return normalize.spans(m.frame(f"{p}segments"))

    @table(f"{p}found", lambda m: f"SELECT s.*, k.mode, k.concept_id, k.lang, k.owners FROM {m.t(p + 'spans')} s JOIN {m.t('matcher')} k ON s.key = k.key")
    def _found(m):
        return m.keys().rows_of(m.frame(f"{p}matched").selectExpr("doc_id", "seg_no", "seg_start", "concat(cands, blocked) AS cands"), "cands")

    @table(f"{p}blocked", lambda m: f"""
SELECT DISTINCT f.doc_id, f.seg_no, f.s, f.e, f.concept_id FROM {m.t(p + 'found')} f
JOIN {m.t('forbidden')} b ON f.concept_id = b.concept_id AND (f.lang = 'shared' OR b.lang = f.lang) JOIN {m.t(p + 'segments')} g ON f.doc_id = g.doc_id AND f.seg_no = g.seg_no
WHERE len(list_filter(range(greatest(0, f.s - length(b.phrase) + (f.e - f.s)), f.s + 1), lambda p: substr(lower(g.line), (p + 1)::BIGINT, length(b.phrase)) = lower(b.phrase))) > 0""")
    def _blocked(m):
        return m.keys().rows_of(m.frame(f"{p}matched"), "blocked").select("doc_id", "seg_no", "s", "e", "concept_id").distinct()

    @table(f"{p}crossed", lambda m: f"""
SELECT DISTINCT f.doc_id, f.seg_no, f.s, f.e FROM {m.t(p + 'found')} f JOIN {m.t(p + 'shielded')} x
ON x.doc_id = f.doc_id AND f.seg_start + f.s < x.e AND f.seg_start + f.e > x.s AND NOT (f.seg_start + f.s <= x.s AND f.seg_start + f.e >= x.e)""")
    def _crossed(m):
        found = m.frame(f"{p}found")
        return normalize.crossing(found, m.frame(f"{p}shielded")).select("doc_id", "seg_no", "s", "e").distinct()

    @table(f"{p}events", lambda m: f"""
WITH {p}free AS (SELECT f.* FROM {m.t(p + 'found')} f LEFT JOIN {m.t(p + 'blocked')} b ON f.doc_id = b.doc_id AND f.seg_no = b.seg_no AND f.s = b.s AND f.e = b.e AND f.concept_id = b.concept_id
  LEFT JOIN {m.t(p + 'crossed')} c ON c.doc_id = f.doc_id AND c.seg_no = f.seg_no AND c.s = f.s AND c.e = f.e WHERE b.doc_id IS NULL AND c.doc_id IS NULL),
{p}per AS (SELECT doc_id, seg_no, seg_start, list_transform(list(struct_pack(s := s, e := e, n := n, key := key, mode := mode, concept_id := concept_id, lang := lang, owners := owners) ORDER BY -n, s), lambda c: [c]) AS every FROM {p}free GROUP BY ALL),
{p}kept AS (SELECT doc_id, seg_no, seg_start, unnest(list_reduce(every, lambda acc, y: CASE WHEN len(list_filter(acc, lambda a: a.s < y[1].e AND a.e > y[1].s)) > 0 THEN acc ELSE list_concat(acc, y) END)) AS x FROM {p}per)
SELECT doc_id, seg_no, seg_start, x.s AS s, x.e AS e, x.n AS n, x.key AS key, x.mode AS mode, x.concept_id AS concept_id, x.lang AS lang, x.owners AS owners FROM {p}kept""")
    def _events(m):
        return m.keys().rows_of(m.frame(f"{p}resolved"), "kept").drop("tok_no")

    # Tables of Spark's plan alone: candidates and events as arrays of a line, written once for all uses in a plan, and listed words.
    SPARK[f"{p}matched"] = lambda m: m.keys().matched(m.frame(docs))
    SPARK[f"{p}resolved"] = lambda m: stored(normalize.resolved(m.frame(f"{p}matched"), m.keys(), m.frame(f"{p}shielded")), f"{p}resolved")
    SPARK[f"{p}listed"] = lambda m: m.frame(f"{p}resolved").selectExpr("doc_id", "seg_no", "inline(words)")


SPARK["runs"] = lambda m: normalize.run_keys(m.frame("segments"))


@derived("q_documents")
def _(m):
    """Queries as documents."""
    return f"SELECT item_id AS doc_id, text FROM {m.t('benchmark')}"


chain("", "documents")
chain("q_", "q_documents")


@table("matcher", lambda m: f"""
WITH keyed AS (SELECT *, {FOLD.format('form')} AS key FROM {m.t('forms')}),
autos AS (SELECT * FROM keyed WHERE policy = 'auto' AND kind <> 'observed'),
owner AS (SELECT key, count(DISTINCT concept_id) AS n, min(concept_id) AS concept_id, CASE WHEN count(DISTINCT lang) > 1 THEN 'shared' ELSE min(lang) END AS lang FROM autos GROUP BY key),
claims AS (SELECT DISTINCT key, concept_id FROM keyed WHERE policy = 'review' UNION SELECT DISTINCT a.key, a.concept_id FROM autos a JOIN owner o ON a.key = o.key AND o.n > 1),
by_key AS (SELECT key, string_agg(concept_id, ',' ORDER BY concept_id) AS owners, count(*) AS n, min(concept_id) AS first FROM claims GROUP BY key),
united AS (SELECT coalesce(o.key, b.key) AS key, o.concept_id, o.lang, b.owners, b.owners IS NOT NULL AND (o.concept_id IS NULL OR b.n > 1 OR b.first <> o.concept_id) AS review
  FROM (SELECT * FROM owner WHERE n = 1) o FULL JOIN by_key b ON o.key = b.key)
SELECT key, CASE WHEN review THEN 'review' ELSE 'auto' END AS mode, CASE WHEN NOT review THEN concept_id END AS concept_id, CASE WHEN NOT review THEN lang END AS lang, coalesce(owners, concept_id) AS owners FROM united""")
def _matcher(m):
    return normalize.matcher(m.frame("forms"))


@table("doc_terms", lambda m: f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS term FROM documents")
def _doc_terms(m):
    return m.frame("documents").select("doc_id", F.explode(T.tokens("text")).alias("term"))


@table("query_terms", lambda m: f"SELECT item_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS term FROM benchmark")
def _query_terms(m):
    return m.frame("benchmark").select("item_id", F.explode(T.tokens("text")).alias("term"))
