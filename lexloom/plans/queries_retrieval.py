"""Queries of fielded BM25 retrieval, ranks, metrics and gates."""

from __future__ import annotations

from lexloom.functions import text as T
from lexloom.plans.registry import query
from lexloom.plans.tables import SPARK, derived, table
from lexloom.sources.shared import stored

K1, B = 1.2, 0.75
#: Resamples of the paired bootstrap and their seed.
RESAMPLES, SEED = 2000, 1729


@derived("tf")
def _(m):
    return f"SELECT doc_id, term, count(*) AS tf FROM {m.t('doc_terms')} GROUP BY doc_id, term"


@derived("dl")
def _(m):
    if m.spark:
        size = f"coalesce(size(regexp_extract_all(lower(text), r'{T.WORD}', 0)), 0)"
        return f"SELECT d.doc_id, coalesce(t.dl, 0) AS dl FROM {m.t('documents')} AS d LEFT JOIN (SELECT doc_id, sum(CASE WHEN text IS NULL THEN 0 ELSE {size} END) AS dl FROM {m.t('documents')} AS x GROUP BY doc_id) AS t ON t.doc_id = d.doc_id"
    return f"SELECT d.doc_id, coalesce(t.dl, 0) AS dl FROM {m.t('documents')} AS d LEFT JOIN (SELECT doc_id, count(*) AS dl FROM {m.t('doc_terms')} GROUP BY doc_id) AS t ON t.doc_id = d.doc_id"


@derived("df")
def _(m):
    return f"SELECT term, count(*) AS df FROM {m.t('tf')} GROUP BY term"


@derived("qtf")
def _(m):
    return f"SELECT item_id, term, count(*) AS qtf FROM {m.t('query_terms')} GROUP BY item_id, term"


def _asked(m):
    """doc_id, term, tf of the terms that queries have: no other is looked up. Written once; queries are few and go to all tasks."""
    terms = f"(SELECT DISTINCT term FROM {m.t('query_terms')})"
    return stored(m.session.sql(f"SELECT /*+ BROADCAST(q) */ t.doc_id, t.term, count(*) AS tf FROM {m.t('doc_terms')} AS t LEFT SEMI JOIN {terms} AS q ON q.term = t.term GROUP BY t.doc_id, t.term"), "asked")


SPARK["asked"] = _asked
SPARK["asked_df"] = lambda m: m.session.sql(f"SELECT term, count(*) AS df FROM {m.t('asked')} GROUP BY term")


@derived("bm25")
def _(m):
    """Query terms meet postings by term; a repeated query term counts as often. Spark deals postings by document, so that scores are added up where they are made."""
    if m.spark:
        return f"""SELECT /*+ BROADCAST(q), BROADCAST(f) */ q.item_id, p.doc_id, round(sum(q.qtf * ln(1 + (s.n - f.df + 0.5e0) / (f.df + 0.5e0)) * p.tf * {K1 + 1}e0 / (p.tf + {K1}e0 * (1 - {B}e0 + {B}e0 * l.dl / s.avgdl))), 6) AS score
          FROM (SELECT /*+ REPARTITION(doc_id) */ * FROM {m.t('asked')}) AS p JOIN {m.t('dl')} AS l ON l.doc_id = p.doc_id JOIN {m.t('qtf')} AS q ON q.term = p.term JOIN {m.t('asked_df')} AS f ON f.term = p.term CROSS JOIN (SELECT count(*) AS n, avg(dl) AS avgdl FROM {m.t('dl')}) AS s GROUP BY q.item_id, p.doc_id"""
    return f"""SELECT q.item_id, p.doc_id, round(sum(q.qtf * ln(1 + (s.n - f.df + 0.5e0) / (f.df + 0.5e0)) * p.tf * {K1 + 1}e0 / (p.tf + {K1}e0 * (1 - {B}e0 + {B}e0 * l.dl / s.avgdl))), 6) AS score
      FROM {m.t('qtf')} AS q JOIN {m.t('tf')} AS p ON p.term = q.term JOIN {m.t('df')} AS f ON f.term = q.term JOIN {m.t('dl')} AS l ON l.doc_id = p.doc_id CROSS JOIN (SELECT count(*) AS n, avg(dl) AS avgdl FROM {m.t('dl')}) AS s GROUP BY q.item_id, p.doc_id"""


@derived("ranked")
def _(m):
    return f"SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {m.t('bm25')} WHERE score > 0) AS r WHERE rank <= 50"


HELD = "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON position({} IN {}) > 0"


def holders(m, fold):
    """Items and the documents that hold their text, with fold around both texts.

    Where a text has three words or more, a document that holds it has all but the first and last as words of its own,
    so only documents with the rarest of these are looked at. The few shorter texts are looked for in all documents.
    """
    terms = f"(SELECT item_id, text, ts, {m.size('ts')} AS n FROM (SELECT item_id, text, regexp_extract_all(lower(text), r'{T.WORD}', 0) AS ts FROM {m.t('benchmark')}) AS a)"
    inner = f"(SELECT item_id, explode(slice(ts, 2, n - 2)) AS term FROM {terms} AS b WHERE n > 2)"
    rarest = f"(SELECT item_id, min_by(term, struct(df, term)) AS term FROM (SELECT i.item_id, i.term, coalesce(f.df, 0) AS df FROM {inner} AS i LEFT JOIN {m.t('asked_df')} AS f ON f.term = i.term) AS c GROUP BY item_id)"
    return f"""SELECT p.item_id, d.doc_id FROM (SELECT r.item_id, t.doc_id FROM {rarest} AS r JOIN {m.t('asked')} AS t ON t.term = r.term) AS p JOIN {m.t('benchmark')} AS b ON b.item_id = p.item_id JOIN {m.t('documents')} AS d ON d.doc_id = p.doc_id WHERE position({fold('b.text')} IN {fold('d.text')}) > 0
      UNION ALL SELECT b.item_id, d.doc_id FROM {terms} AS b JOIN {m.t('documents')} AS d ON position({fold('b.text')} IN {fold('d.text')}) > 0 WHERE b.n <= 2"""


@table("qrels", HELD.format("b.text", "d.text"))
def _(m):
    """Items whose text a document holds."""
    return stored(m.session.sql(holders(m, "{}".format)), "qrels")


@table("grepped", HELD.format("lower(b.text)", "lower(d.text)"))
def _(m):
    """The same whatever the case."""
    return m.session.sql(holders(m, "lower({})".format))


@query("a_tf")
def _(m):
    return f"SELECT doc_id, term, tf FROM {m.t('tf')}"


@query("a_df")
def _(m):
    return f"SELECT term, df FROM {m.t('df')}"


@query("a_avgdl")
def _(m):
    return f"SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM {m.t('dl')}"


@query("r_bm25")
def _(m):
    return f"SELECT item_id, doc_id, round(score, 4) AS score FROM {m.t('ranked')} WHERE rank <= 10"


@query("o_rank")
def _(m):
    return f"SELECT item_id, doc_id, rank FROM {m.t('ranked')} WHERE rank <= 10"


@query("o_rank_delta")
def _(m):
    return f"""SELECT q.item_id, {m.big('coalesce(min(r.rank), 51)')} AS first_rank, {m.big('51 - coalesce(min(r.rank), 51)')} AS gain FROM {m.t('qrels')} AS q LEFT JOIN {m.t('ranked')} AS r ON r.item_id = q.item_id AND r.doc_id = q.doc_id GROUP BY q.item_id"""


CUTOFFS = (1, 3, 5, 10, 50)
RECALLS = ", ".join(f"round(sum(CASE WHEN r.rank <= {k} THEN 1 ELSE 0 END) / max(q.relevant), 6) AS recall_{k}" for k in CUTOFFS)
METRICS = f"""SELECT q.item_id, max(q.relevant) AS relevant, {RECALLS},
      round(sum(CASE WHEN r.rank <= 5 THEN 1 ELSE 0 END) / 5e0, 6) AS precision_5, round(coalesce(max(CASE WHEN r.rank <= 10 THEN 1e0 / r.rank END), 0e0), 6) AS mrr_10, round(coalesce(sum(CASE WHEN r.rank <= 10 THEN 1e0 / log2(r.rank + 1) END), 0e0) / max(q.ideal), 6) AS ndcg_10"""


def metrics(m, ranked="ranked"):
    ideal = f"(SELECT item_id, count(*) AS relevant, sum(CASE WHEN k <= 10 THEN 1e0 / log2(k + 1) ELSE 0e0 END) AS ideal FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS k FROM {m.t('qrels')}) AS i GROUP BY item_id)"
    return f"({METRICS} FROM {ideal} AS q LEFT JOIN (SELECT r.item_id, r.rank FROM {m.t(ranked)} AS r JOIN {m.t('qrels')} AS l ON l.item_id = r.item_id AND l.doc_id = r.doc_id) AS r ON r.item_id = q.item_id GROUP BY q.item_id)"


@query("e_metrics")
def _(m):
    return f"SELECT item_id, relevant, {', '.join(f'recall_{k}' for k in CUTOFFS)}, precision_5, mrr_10, ndcg_10 FROM {metrics(m)} AS x"


FIELDS = ("raw", "canonical", "concept", "operator")
#: Weights of the fields in each arm; arm B adds the automatic forms of the query's concepts to the raw field.
ARMS = {"A": {"raw": 1.0}, "B": {"raw": 1.0}, "C": {"raw": 3.0, "canonical": 2.0}, "D": {"raw": 3.0, "concept": 2.0, "operator": 2.0}, "E": {"canonical": 1.0}}
EXPANSION = 0.5


OPERATOR = "semantic_class IN ('modality', 'polarity', 'temporal', 'condition', 'quantity')"


def _field_dl(m):
    """field, doc_id, dl: how many terms each field of a document has, without a row for each."""
    size = lambda x: f"size(regexp_extract_all(lower({x}), r'{T.WORD}', 0))"
    text = f"(SELECT g.doc_id, coalesce(c.canonical_text, g.line) AS text FROM {m.t('segments')} AS g LEFT JOIN {m.t('canonical')} AS c ON c.doc_id = g.doc_id AND c.seg_no = g.seg_no)"
    return stored(m.session.sql(f"""SELECT 'raw' AS field, doc_id, sum({size('text')}) AS dl FROM {m.t('documents')} AS d WHERE text IS NOT NULL GROUP BY doc_id
      UNION ALL SELECT 'canonical', doc_id, sum({size('text')}) FROM {text} AS a GROUP BY doc_id
      UNION ALL SELECT 'concept', doc_id, count(*) FROM (SELECT DISTINCT doc_id, seg_no, concept_id FROM {m.t('auto_events')}) AS v GROUP BY doc_id
      UNION ALL SELECT 'operator', doc_id, count(*) FROM (SELECT DISTINCT doc_id, seg_no, concept_id FROM {m.t('auto_events')} WHERE {OPERATOR}) AS v GROUP BY doc_id"""), "field_dl")


SPARK["field_dl"] = _field_dl


def field_terms(m, p: str, raw: str) -> str:
    """field, doc_id, term, n: the terms of the fields but the raw one, of documents or queries."""
    text = f"(SELECT g.doc_id, coalesce(c.canonical_text, g.line) AS text FROM {m.t(p + 'segments')} AS g LEFT JOIN {m.t(p + 'canonical')} AS c ON c.doc_id = g.doc_id AND c.seg_no = g.seg_no)"
    words = f"(SELECT doc_id, {m.explode(m.rx_all('lower(text)', T.WORD), 'term')} FROM {text} AS a)"
    return f"""SELECT 'raw' AS field, {raw}
      UNION ALL SELECT 'canonical', doc_id, term, count(*) FROM {words} AS w GROUP BY doc_id, term
      UNION ALL SELECT 'concept', doc_id, concept_id, count(*) FROM (SELECT DISTINCT doc_id, seg_no, concept_id FROM {m.t(p + 'auto_events')}) AS v GROUP BY doc_id, concept_id
      UNION ALL SELECT 'operator', doc_id, concept_id, count(*) FROM (SELECT DISTINCT doc_id, seg_no, concept_id FROM {m.t(p + 'auto_events')} WHERE {OPERATOR}) AS v GROUP BY doc_id, concept_id"""


@derived("postings", keep=True)
def _(m):
    """All postings; for Spark those of terms that some arm asks for, as no other is looked up."""
    if m.spark:
        asked = lambda field: f"(SELECT DISTINCT term FROM {m.t('arm_parts')} WHERE field = '{field}')"
        text = f"(SELECT g.doc_id, coalesce(c.canonical_text, g.line) AS text FROM {m.t('segments')} AS g LEFT JOIN {m.t('canonical')} AS c ON c.doc_id = g.doc_id AND c.seg_no = g.seg_no)"
        words = f"(SELECT doc_id, {m.explode(m.rx_all('lower(text)', T.WORD), 'term')} FROM {text} AS a)"
        few = lambda field, rows: f"SELECT /*+ BROADCAST(q) */ '{field}' AS field, t.doc_id, t.term, count(*) AS n FROM {rows} AS t LEFT SEMI JOIN {asked(field)} AS q ON q.term = t.term GROUP BY t.doc_id, t.term"
        ids = lambda where: f"(SELECT DISTINCT doc_id, seg_no, concept_id AS term FROM {m.t('auto_events')} {where})"
        return " UNION ALL ".join([few("raw", m.t("doc_terms")), few("canonical", words), few("concept", ids("")), few("operator", ids(f"WHERE {OPERATOR}"))])
    return field_terms(m, "", f"doc_id, term, tf AS n FROM {m.t('tf')}")


@derived("query_parts")
def _(m):
    return field_terms(m, "q_", f"item_id AS doc_id, term, qtf AS n FROM {m.t('qtf')}")


@derived("arm_parts", keep=True)
def _(m):
    """item_id, arm, field, term, weight: all parts of the queries of all arms."""
    weights = " UNION ALL ".join(f"SELECT '{arm}' AS arm, '{field}' AS field, {w}e0 AS weight" for arm, fields in ARMS.items() for field, w in fields.items())
    forms = f"(SELECT DISTINCT v.doc_id, f.form FROM {m.t('q_auto_events')} AS v JOIN {m.t('forms')} AS f ON f.concept_id = v.concept_id AND f.policy = 'auto' AND f.kind <> 'observed')"
    more = f"(SELECT doc_id, {m.explode(m.rx_all('lower(form)', T.WORD), 'term')} FROM {forms} AS a)"
    return f"""SELECT item_id, arm, field, term, sum(weight) AS weight FROM (
      SELECT q.doc_id AS item_id, w.arm, q.field, q.term, w.weight * q.n AS weight FROM {m.t('query_parts')} AS q JOIN ({weights}) AS w ON w.field = q.field
      UNION ALL SELECT doc_id, 'B', 'raw', term, {EXPANSION}e0 FROM {more} AS x) AS u GROUP BY item_id, arm, field, term"""


@derived("contributions")
def _(m):
    """item_id, doc_id and a column for each arm: query terms meet postings once for all arms."""
    arms = ", ".join(f"sum(CASE WHEN arm = '{a}' THEN weight ELSE 0e0 END) AS w_{a}" for a in ARMS)
    parts = f"(SELECT item_id, field, term, {arms} FROM {m.t('arm_parts')} AS a GROUP BY item_id, field, term)"
    df = f"(SELECT field, term, count(*) AS df FROM {m.t('postings')} AS p GROUP BY field, term)"
    if m.spark:
        df = f"(SELECT field, term, count(*) AS df FROM {m.t('postings')} AS p GROUP BY field, term)"
        sums = f"(SELECT y.field, x.n, sum(y.dl) / max(x.n * 1e0) AS avgdl FROM {m.t('field_dl')} AS y CROSS JOIN (SELECT count(*) AS n FROM {m.t('documents')}) AS x GROUP BY y.field, x.n)"
        one = f"ln(1 + (s.n - f.df + 0.5e0) / (f.df + 0.5e0)) * p.n * {K1 + 1}e0 / (p.n + {K1}e0 * (1 - {B}e0 + {B}e0 * l.dl / s.avgdl))"
        return f"""SELECT item_id, doc_id, {', '.join(f'sum(w_{a} * one) AS {a}' for a in ARMS)} FROM (
          SELECT /*+ BROADCAST(q), BROADCAST(f), BROADCAST(s) */ q.item_id, p.doc_id, {', '.join(f'q.w_{a}' for a in ARMS)}, {one} AS one FROM (SELECT /*+ REPARTITION(doc_id) */ * FROM {m.t('postings')}) AS p JOIN (SELECT /*+ REPARTITION(doc_id) */ * FROM {m.t('field_dl')}) AS l ON l.doc_id = p.doc_id AND l.field = p.field
          JOIN {parts} AS q ON p.field = q.field AND p.term = q.term JOIN {df} AS f ON f.field = q.field AND f.term = q.term JOIN {sums} AS s ON s.field = q.field) AS z GROUP BY item_id, doc_id"""
    dl = f"(SELECT field, doc_id, sum(n) AS dl FROM {m.t('postings')} AS p GROUP BY field, doc_id)"
    sums = f"(SELECT y.field, x.n, sum(y.dl) / max(x.n * 1e0) AS avgdl FROM {dl} AS y CROSS JOIN (SELECT count(*) AS n FROM {m.t('documents')}) AS x GROUP BY y.field, x.n)"
    one = f"ln(1 + (s.n - f.df + 0.5e0) / (f.df + 0.5e0)) * p.n * {K1 + 1}e0 / (p.n + {K1}e0 * (1 - {B}e0 + {B}e0 * l.dl / s.avgdl))"
    return f"""SELECT item_id, doc_id, {', '.join(f'sum(w_{a} * one) AS {a}' for a in ARMS)} FROM (
      SELECT q.item_id, p.doc_id, {', '.join(f'q.w_{a}' for a in ARMS)}, {one} AS one FROM {parts} AS q JOIN {m.t('postings')} AS p ON p.field = q.field AND p.term = q.term
      JOIN {df} AS f ON f.field = q.field AND f.term = q.term JOIN {dl} AS l ON l.field = p.field AND l.doc_id = p.doc_id JOIN {sums} AS s ON s.field = q.field) AS z GROUP BY item_id, doc_id"""


@derived("arm_ranked", keep=True)
def _(m):
    arms = " UNION ALL ".join(f"SELECT '{a}' AS arm" for a in ARMS)
    own = "CASE x.arm " + " ".join(f"WHEN '{a}' THEN round(c.{a}, 5)" for a in ARMS) + " END"
    every = f"SELECT c.item_id, x.arm, c.doc_id, {own} AS score FROM {m.t('contributions')} AS c CROSS JOIN ({arms}) AS x"
    return f"SELECT item_id, arm, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id, arm ORDER BY score DESC, doc_id) AS rank FROM ({every}) AS u WHERE score > 0) AS r WHERE rank <= 50"


@derived("fielded")
def _(m):
    return f"SELECT item_id, doc_id, score, rank FROM {m.t('arm_ranked')} AS r WHERE arm = 'D'"


@derived("arm_metrics")
def _(m):
    """Metrics of each item and arm, with whether the arm found nothing."""
    ideal = f"(SELECT item_id, count(*) AS relevant, sum(CASE WHEN k <= 10 THEN 1e0 / log2(k + 1) ELSE 0e0 END) AS ideal FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS k FROM {m.t('qrels')}) AS i GROUP BY item_id)"
    arms = " UNION ALL ".join(f"SELECT '{a}' AS arm" for a in ARMS)
    found = f"(SELECT r.item_id, r.arm, CASE WHEN l.doc_id IS NOT NULL THEN r.rank END AS rank FROM {m.t('arm_ranked')} AS r LEFT JOIN {m.t('qrels')} AS l ON l.item_id = r.item_id AND l.doc_id = r.doc_id)"
    return f"""{METRICS}, a.arm, CASE WHEN count(r.item_id) = 0 THEN 1 ELSE 0 END AS zero_result FROM {ideal} AS q CROSS JOIN ({arms}) AS a LEFT JOIN {found} AS r ON r.item_id = q.item_id AND r.arm = a.arm GROUP BY q.item_id, a.arm"""


@query("r_fielded")
def _(m):
    return f"SELECT item_id, doc_id, round(score, 3) AS score FROM {m.t('fielded')} WHERE rank <= 10"


@query("e_arms")
def _(m):
    return f"SELECT item_id, arm, field, term, round(weight, 6) AS weight FROM {m.t('arm_parts')} AS a"


@query("e_retrieval")
def _(m):
    """Each arm over the items that some document answers, and how often it finds nothing."""
    return f"SELECT arm, count(*) AS queries, {', '.join(f'round(avg(recall_{k}), 5) AS recall_{k}' for k in CUTOFFS)}, round(avg(precision_5), 5) AS precision_5, round(avg(mrr_10), 5) AS mrr, round(avg(ndcg_10), 5) AS ndcg, {m.big('sum(zero_result)')} AS abstained FROM {m.t('arm_metrics')} AS x GROUP BY arm"


@query("e_ablation_summary")
def _(m):
    return f"""SELECT arm, stratum, count(*) AS n, round(avg(mrr_10), 5) AS mrr, round(avg(recall_10), 5) AS recall_10 FROM (SELECT arm, CASE WHEN relevant > 1 THEN 'many' ELSE 'one' END AS stratum, mrr_10, recall_10 FROM {m.t('arm_metrics')} AS x) AS y GROUP BY GROUPING SETS ((arm), (arm, stratum))"""


def against_raw(m) -> str:
    """item_id, arm, raw, own, delta: each arm but A against A."""
    return f"(SELECT a.item_id, b.arm, a.mrr_10 AS raw, b.mrr_10 AS own, round(b.mrr_10 - a.mrr_10, 6) AS delta FROM {m.t('arm_metrics')} AS a JOIN {m.t('arm_metrics')} AS b ON a.item_id = b.item_id AND a.arm = 'A' AND b.arm <> 'A')"


@query("e_ablation")
def _(m):
    return f"SELECT item_id, arm, raw, own, delta FROM {against_raw(m)} AS x"


@query("o_regressions")
def _(m):
    return f"SELECT item_id, arm, -delta AS fall FROM {against_raw(m)} AS x WHERE delta < 0 ORDER BY fall DESC, item_id, arm LIMIT 20"


@query("e_literal_regressions")
def _(m):
    """Items whose own words found an answer among the first ten documents that an arm puts further back or loses."""
    first = f"(SELECT r.item_id, r.arm, min(r.rank) AS first FROM {m.t('arm_ranked')} AS r JOIN {m.t('qrels')} AS l ON l.item_id = r.item_id AND l.doc_id = r.doc_id GROUP BY r.item_id, r.arm)"
    arms = " UNION ALL ".join(f"SELECT '{a}' AS arm" for a in ARMS if a != "A")
    return f"""SELECT a.item_id, x.arm, a.first AS raw_rank, b.first AS own_rank FROM {first} AS a CROSS JOIN ({arms}) AS x LEFT JOIN {first} AS b ON b.item_id = a.item_id AND b.arm = x.arm
      WHERE a.arm = 'A' AND a.first <= 10 AND coalesce(b.first, 51) > a.first"""


@derived("deltas")
def _(m):
    """Numbered gains of each arm over the raw one."""
    return f"SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY item_id) - 1 AS place, count(*) OVER (PARTITION BY arm) AS n, own - raw AS delta FROM {against_raw(m)} AS x"


@query("e_bootstrap")
def _(m):
    """Means of resampled deltas by arm, drawn by a digest of seed, replicate and place; their 2.5 and 97.5 percentiles by nearest rank, half to even. n is the number of resamples."""
    draw = m.hashed(f"concat('{SEED}:', {m.text('r.rep')}, ':', {m.text('d.place')})")
    draws = f"(SELECT r.rep, d.arm, {m.big(f'{draw} % d.n')} AS pick FROM {m.numbers(0, RESAMPLES - 1, 'rep')} AS r CROSS JOIN {m.t('deltas')} AS d)"
    ends = [m.half_even(f"(c - 1) * {p}e0") for p in (0.025, 0.975)]
    return f"""SELECT arm, coalesce(round(min(CASE WHEN k - 1 = {ends[0]} THEN mean END), 5), 0e0) AS low, coalesce(round(min(CASE WHEN k - 1 = {ends[1]} THEN mean END), 5), 0e0) AS high, count(*) AS n FROM (
      SELECT arm, mean, row_number() OVER (PARTITION BY arm ORDER BY mean, rep) AS k, count(*) OVER (PARTITION BY arm) AS c FROM (SELECT w.arm, w.rep, round(avg(v.delta), 9) AS mean FROM {draws} AS w JOIN {m.t('deltas')} AS v ON v.place = w.pick AND v.arm = w.arm GROUP BY w.arm, w.rep) AS a) AS b GROUP BY arm"""


@query("a_percentile")
def _(m):
    """Nearest rank, half to even; over counts of each length, so that no task orders all documents of a language."""
    counts = f"(SELECT lang, n_chars, count(*) AS c FROM {m.t('documents')} GROUP BY lang, n_chars)"
    run = f"(SELECT lang, n_chars, sum(c) OVER (PARTITION BY lang ORDER BY n_chars ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY lang) AS n FROM {counts} AS c)"
    return f"SELECT lang, min(n_chars) AS p90 FROM {run} AS r WHERE upto > {m.half_even('(n - 1) * 0.9e0')} GROUP BY lang"


@query("a_index_bytes")
def _(m):
    return f"""SELECT 'raw' AS arm, {m.big('sum(' + m.octets('line') + ')')} AS bytes FROM {m.t('segments')} UNION ALL SELECT 'canonical', {m.big('sum(' + m.octets('canonical_text') + ')')} FROM {m.t('canonical')}"""


@query("e_grep_gate")
def _(m):
    """Hits of a search for the whole text, whatever the case, in documents as they are and in those whose text some arm finds among the first ten."""
    beside = f"(SELECT g.item_id, count(DISTINCT g.doc_id) AS hits FROM {m.t('grepped')} AS g JOIN {m.t('fielded')} AS r ON r.item_id = g.item_id AND r.doc_id = g.doc_id AND r.rank <= 10 GROUP BY g.item_id)"
    raw = f"(SELECT item_id, count(*) AS hits FROM {m.t('grepped')} AS g GROUP BY item_id)"
    return f"""SELECT b.item_id, coalesce(r.hits, 0) AS hits, coalesce(x.hits, 0) AS indexed, CASE WHEN r.hits IS NULL THEN 'none' WHEN r.hits > 1 THEN 'many' ELSE 'one' END AS stratum FROM {m.t('benchmark')} AS b LEFT JOIN {raw} AS r ON r.item_id = b.item_id LEFT JOIN {beside} AS x ON x.item_id = b.item_id"""


@query("e_snippet_pack")
def _(m):
    return f"""SELECT item_id, doc_id, rank, used FROM (SELECT r.item_id, r.doc_id, r.rank, {m.big('sum(least(d.n_chars, 2000)) OVER (PARTITION BY r.item_id ORDER BY r.rank ROWS UNBOUNDED PRECEDING)')} AS used FROM {m.t('ranked')} AS r JOIN {m.t('documents')} AS d ON d.doc_id = r.doc_id WHERE r.rank <= 10) AS x WHERE used <= 8000"""


@query("u_candidates")
def _(m):
    return f"SELECT 'document' AS origin, count(*) AS n FROM {m.t('documents')} UNION ALL SELECT 'query', count(*) FROM {m.t('benchmark')} UNION ALL SELECT 'turn', count(*) FROM {m.t('conversations')}"


@query("u_cooccur")
def _(m):
    return f"SELECT item_id, doc_id FROM {m.t('qrels')} INTERSECT SELECT item_id, doc_id FROM {m.t('ranked')} WHERE rank <= 10"


@query("u_relation_except")
def _(m):
    return f"SELECT 'missing' AS side, item_id, doc_id FROM (SELECT item_id, doc_id FROM {m.t('qrels')} EXCEPT SELECT item_id, doc_id FROM {m.t('ranked')} WHERE rank <= 3) AS a"


@query("u_set_equal")
def _(m):
    return f"SELECT count(*) AS apart FROM (SELECT concept_id FROM {m.t('concepts')} EXCEPT SELECT concept_id FROM {m.t('forms')}) AS a"
