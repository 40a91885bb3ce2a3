"""Queries of corpus analytics: contexts, company, entropy, keyness, terms, strata, sampling, precision, coverage."""

from __future__ import annotations

from lexloom.functions import text as T
from lexloom.operators import normalize
from lexloom.plans.queries_core import headings
from lexloom.plans.registry import query
from lexloom.plans.tables import SPARK, derived, fixture

#: Words on either side of a match that count as its context.
AROUND = 8
#: A synthetic table of senses: how many a word has.
SENSES = [("the", 1), ("of", 2), ("and", 1), ("in", 3), ("is", 4), ("to", 2), ("that", 2), ("for", 5), ("with", 3), ("not", 1), ("by", 6), ("on", 7), ("was", 2), ("de", 2), ("la", 1), ("que", 3), ("por", 4), ("con", 1)]
fixture("senses", "word string, n_senses int", SENSES)
WILSON_Z = 1.96


def wilson(hits: str, n: str, sign: str = "-") -> str:
    """A bound of the Wilson interval; null without cases."""
    z = f"{WILSON_Z}e0"
    p = f"({hits} * 1e0 / {n})"
    return f"CASE WHEN {n} > 0 THEN ({p} + {z} * {z} / (2 * {n}) {sign} {z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n})) / (1 + {z} * {z} / {n}) END"


@derived("kwic")
def _(m):
    """Words around each automatic event, stop words left out; at counts from the event's first token. Spark makes them within a line, so that no token is dealt."""
    if m.spark:
        return f"SELECT v.* FROM {m.t('contexts')} AS v JOIN {m.t('concepts')} AS c ON c.concept_id = v.concept_id"
    return f"""SELECT v.doc_id, v.seg_no, v.s, v.concept_id, v.key, t.key AS word, t.tok_no - b.tok_no AS at FROM {m.t('auto_events')} AS v
      JOIN {m.t('tokens')} AS b ON b.doc_id = v.doc_id AND b.seg_no = v.seg_no AND b.s = v.s JOIN {m.t('tokens')} AS t ON t.doc_id = v.doc_id AND t.seg_no = v.seg_no
      WHERE t.tok_no BETWEEN b.tok_no - {AROUND} AND b.tok_no + v.n - 1 + {AROUND} AND NOT t.tok_no BETWEEN b.tok_no AND b.tok_no + v.n - 1 AND t.key NOT IN (SELECT word FROM {m.t('stop_words')})"""


@derived("pair_counts")
def _(m):
    return f"SELECT concept_id, key, max(n) AS width, count(*) AS n FROM {m.t('auto_events')} GROUP BY concept_id, key"


def _contexts(m):
    stop = sorted({r["word"] for r in m.frame("stop_words").collect()} - {None})
    return normalize.contexts(m.frame("segments"), m.frame("resolved"), m.keys(), stop, AROUND)


SPARK["contexts"] = _contexts


@derived("surface_profiles", keep=True)
def _(m):
    return f"SELECT concept_id, key, word, count(*) AS n FROM {m.t('kwic')} GROUP BY concept_id, key, word"


@derived("profiles", keep=True)
def _(m):
    return f"SELECT concept_id, word, count(*) AS n FROM {m.t('kwic')} GROUP BY concept_id, word"


@derived("company")
def _(m):
    per = f"(SELECT doc_id, seg_no, count(DISTINCT concept_id) AS kinds FROM {m.t('auto_events')} GROUP BY doc_id, seg_no)"
    return f"""SELECT v.concept_id, count(*) AS n, avg(p.kinds - 1) AS company, avg(CASE WHEN p.kinds = 1 THEN 1e0 ELSE 0e0 END) AS isolation FROM {m.t('auto_events')} AS v JOIN {per} AS p ON p.doc_id = v.doc_id AND p.seg_no = v.seg_no GROUP BY v.concept_id"""


@derived("entropy")
def _(m):
    return f"""SELECT concept_id, sum(n) AS total, CASE WHEN sum(n) <= 1 THEN 0e0 ELSE -sum((n * 1e0 / whole) * log2(n * 1e0 / whole)) END AS h FROM (SELECT concept_id, n, sum(n) OVER (PARTITION BY concept_id) AS whole FROM {m.t('profiles')}) AS p GROUP BY concept_id"""


@derived("risk")
def _(m):
    return f"""SELECT p.concept_id, p.key, p.n, (CASE WHEN p.width = 1 THEN 2e0 ELSE 1e0 END) * log2(1 + p.n) * (1 + c.isolation) * (1 + coalesce(h.h, 0e0) / 6) / (1 + c.company) AS risk
      FROM {m.t('pair_counts')} AS p JOIN {m.t('company')} AS c ON c.concept_id = p.concept_id LEFT JOIN {m.t('entropy')} AS h ON h.concept_id = p.concept_id"""


@query("a_pair_counts")
def _(m):
    return f"SELECT concept_id, key, n, round(n * 1e0 / sum(n) OVER (PARTITION BY concept_id), 6) AS share FROM {m.t('pair_counts')}"


@query("a_examples")
def _(m):
    return f"""SELECT concept_id, {m.all_of("concat(" + m.text('doc_id') + ", ':', " + m.text('start_at') + ")", 'k')} AS examples FROM (
      SELECT concept_id, doc_id, seg_start + s AS start_at, row_number() OVER (PARTITION BY concept_id ORDER BY doc_id, seg_start + s) AS k FROM {m.t('auto_events')}) AS x WHERE k <= 3 GROUP BY concept_id"""


@query("a_company")
def _(m):
    return f"SELECT concept_id, n, round(company, 6) AS company, round(isolation, 6) AS isolation FROM {m.t('company')}"


@query("a_entropy")
def _(m):
    return f"SELECT concept_id, {m.big('total')} AS total, round(h, 5) AS entropy, round(CASE WHEN total <= 1 THEN 0e0 ELSE h / log2(total) END, 5) AS normal FROM {m.t('entropy')}"


@query("a_risk")
def _(m):
    return f"SELECT concept_id, key, n, round(risk, 5) AS risk FROM {m.t('risk')}"


@query("o_top_context")
def _(m):
    return f"SELECT concept_id, word, n, k FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY n DESC, word) AS k FROM {m.t('profiles')}) AS p WHERE k <= 8"


@derived("distances")
def _(m):
    """Cosine distance of each occurrence's context to the centroid of its concept."""
    occ = f"(SELECT doc_id, seg_no, s, concept_id, word, count(*) AS n FROM {m.t('kwic')} GROUP BY doc_id, seg_no, s, concept_id, word)"
    norm = f"(SELECT concept_id, sqrt(sum(n * n * 1e0)) AS length FROM {m.t('profiles')} GROUP BY concept_id)"
    return f"""SELECT o.doc_id, o.seg_no, o.s, o.concept_id, 1 - sum(o.n * p.n) / (sqrt(sum(o.n * o.n * 1e0)) * max(c.length)) AS distance FROM {occ} AS o JOIN {m.t('profiles')} AS p ON p.concept_id = o.concept_id AND p.word = o.word
      JOIN {norm} AS c ON c.concept_id = o.concept_id GROUP BY o.doc_id, o.seg_no, o.s, o.concept_id"""


@derived("spread")
def _(m):
    return f"SELECT concept_id, count(*) AS n, avg(distance) AS mean, {m.pstdev('distance')} AS spread, max(distance) AS farthest FROM {m.t('distances')} GROUP BY concept_id"


@query("a_outlier")
def _(m):
    return f"SELECT concept_id, n, round(mean, 5) AS mean, round(spread, 5) AS spread, round(farthest, 5) AS farthest FROM {m.t('spread')}"


@query("o_topk_outliers")
def _(m):
    large = f"(SELECT concept_id FROM (SELECT concept_id, row_number() OVER (ORDER BY n DESC, concept_id) AS k FROM {m.t('spread')}) AS x WHERE k <= 50)"
    return f"""SELECT concept_id, doc_id, seg_no, s, k FROM (SELECT d.concept_id, d.doc_id, d.seg_no, d.s, row_number() OVER (PARTITION BY d.concept_id ORDER BY round(d.distance, 6) DESC, d.doc_id, d.seg_no, d.s) AS k FROM {m.t('distances')} AS d JOIN {large} AS l ON l.concept_id = d.concept_id) AS x WHERE k <= 5"""


@query("a_drift")
def _(m):
    """Cosine of the contexts of a concept's preferred surface and of each other surface of it, from four occurrences on."""
    prof = f"(SELECT concept_id, key, word, count(*) AS n FROM {m.t('kwic')} GROUP BY concept_id, key, word)"
    if m.spark:
        prof = m.t("surface_profiles")
    norm = f"(SELECT concept_id, key, sqrt(sum(n * n * 1e0)) AS length FROM {prof} AS q GROUP BY concept_id, key)"
    pref = f"(SELECT DISTINCT concept_id, form FROM {m.t('forms')} WHERE kind = 'pref' AND policy = 'auto')"
    pairs = f"(SELECT a.concept_id, a.key AS pref, b.key AS other FROM {m.t('pair_counts')} AS a JOIN {pref} AS f ON f.concept_id = a.concept_id AND f.form = a.key JOIN {m.t('pair_counts')} AS b ON b.concept_id = a.concept_id AND b.key <> a.key WHERE a.n >= 4 AND b.n >= 4)"
    return f"""SELECT p.concept_id, p.pref, p.other, round(coalesce(sum(a.n * b.n), 0) / max(x.length * y.length), 5) AS cosine FROM {pairs} AS p JOIN {norm} AS x ON x.concept_id = p.concept_id AND x.key = p.pref JOIN {norm} AS y ON y.concept_id = p.concept_id AND y.key = p.other
      JOIN {prof} AS a ON a.concept_id = p.concept_id AND a.key = p.pref LEFT JOIN {prof} AS b ON b.concept_id = p.concept_id AND b.key = p.other AND b.word = a.word GROUP BY p.concept_id, p.pref, p.other"""


@query("a_priority")
def _(m):
    n_senses = f"(SELECT f.concept_id, max(coalesce(w.n_senses, 0)) AS senses FROM {m.t('forms')} AS f LEFT JOIN {m.t('senses')} AS w ON w.word = lower(f.form) GROUP BY f.concept_id)"
    return f"""SELECT concept_id, round(priority, 5) AS priority, greatest(2, least(n, {m.half_even('40e0 * priority / sum(priority) OVER ()')})) AS budget FROM (
      SELECT s.concept_id, s.n, log2(1 + x.senses) * (15e-2 + s.spread) * log2(1 + s.n) AS priority FROM {m.t('spread')} AS s JOIN {n_senses} AS x ON x.concept_id = s.concept_id) AS p"""


@derived("strata")
def _(m):
    return f"""SELECT p.concept_id, p.key, p.n, coalesce(w.n_senses, 0) AS senses, CASE WHEN p.width > 1 THEN 'A' WHEN coalesce(w.n_senses, 0) = 0 THEN 'B' WHEN w.n_senses <= 2 THEN 'C' ELSE 'D' END AS stratum FROM {m.t('pair_counts')} AS p LEFT JOIN {m.t('senses')} AS w ON w.word = p.key"""


@query("j_stratum")
def _(m):
    return f"SELECT concept_id, key, n, senses, stratum FROM {m.t('strata')}"


@query("a_strata")
def _(m):
    return f"SELECT stratum, count(*) AS pairs, {m.big('sum(n)')} AS events, round(sum(n) * 1e0 / sum(sum(n)) OVER (), 6) AS share FROM {m.t('strata')} GROUP BY stratum"


@derived("risky")
def _(m):
    return f"SELECT concept_id, key FROM (SELECT concept_id, key, row_number() OVER (ORDER BY round(risk, 6) DESC, concept_id, key) AS k FROM {m.t('risk')}) AS r WHERE k <= 8"


@query("j_semi_risk")
def _(m):
    return f"SELECT v.doc_id, v.seg_no, v.s, v.key FROM {m.t('auto_events')} AS v LEFT SEMI JOIN {m.t('risky')} AS r ON r.concept_id = v.concept_id AND r.key = v.key" if m.spark else f"SELECT v.doc_id, v.seg_no, v.s, v.key FROM {m.t('auto_events')} AS v SEMI JOIN {m.t('risky')} AS r ON r.concept_id = v.concept_id AND r.key = v.key"


@query("j_unread")
def _(m):
    read = f"(SELECT DISTINCT doc_id FROM {m.t('labels')})"
    forms = f"(SELECT DISTINCT v.key FROM {m.t('auto_events')} AS v JOIN {read} AS x ON x.doc_id = v.doc_id)"
    return f"""SELECT v.doc_id, v.seg_no, v.s, v.key, CASE WHEN f.key IS NULL THEN 'new' ELSE 'known' END AS form FROM {m.t('auto_events')} AS v LEFT JOIN {read} AS r ON r.doc_id = v.doc_id LEFT JOIN {forms} AS f ON f.key = v.key WHERE r.doc_id IS NULL"""


@derived("term_counts")
def _(m):
    """Words of English documents against words of all others."""
    return f"SELECT t.term, {m.big('sum(CASE WHEN d.lang = ' + repr('en') + ' THEN 1 ELSE 0 END)')} AS here, {m.big('sum(CASE WHEN d.lang = ' + repr('en') + ' THEN 0 ELSE 1 END)')} AS there FROM {m.t('doc_terms')} AS t JOIN {m.t('documents')} AS d ON d.doc_id = t.doc_id GROUP BY t.term"


@derived("keyness")
def _(m):
    e1, e2 = "(n1 * (here + there) * 1e0 / (n1 + n2))", "(n2 * (here + there) * 1e0 / (n1 + n2))"
    g2 = f"2 * ((CASE WHEN here > 0 THEN here * ln(here / {e1}) ELSE 0e0 END) + (CASE WHEN there > 0 THEN there * ln(there / {e2}) ELSE 0e0 END))"
    return f"""SELECT term, here, there, CASE WHEN here * 1e0 / n1 >= there * 1e0 / n2 THEN 1 ELSE -1 END * ({g2}) AS g2, ((here + 5e-1) / n1) / ((there + 5e-1) / n2) AS weirdness
      FROM {m.t('term_counts')} AS c CROSS JOIN (SELECT greatest(1, {m.big('sum(here)')}) AS n1, greatest(1, {m.big('sum(there)')}) AS n2 FROM {m.t('term_counts')}) AS n"""


@query("a_keyness")
def _(m):
    return f"SELECT term, here, there, round(g2, 3) AS g2, round(weirdness, 4) AS weirdness FROM {m.t('keyness')}"


@query("f_term_admissible")
def _(m):
    return f"""SELECT CASE WHEN here < 3 THEN 'rare' WHEN f.word IS NOT NULL THEN 'function' WHEN g2 <= 0 THEN 'common' WHEN weirdness < 8 THEN 'ordinary' ELSE 'term' END AS verdict, count(*) AS n FROM {m.t('keyness')} AS k LEFT JOIN (SELECT DISTINCT word FROM {m.t('function_words')}) AS f ON f.word = k.term
      GROUP BY CASE WHEN here < 3 THEN 'rare' WHEN f.word IS NOT NULL THEN 'function' WHEN g2 <= 0 THEN 'common' WHEN weirdness < 8 THEN 'ordinary' ELSE 'term' END"""


@derived("grams")
def _(m):
    if m.spark:
        return f"SELECT key, n, count(*) AS freq FROM {m.t('runs')} GROUP BY key, n"
    return f"SELECT key, n, count(*) AS freq FROM {m.t('spans')} GROUP BY key, n"


@derived("cvalue")
def _(m):
    """log2 of length and one, times the frequency less the mean frequency of longer runs around it, each counted once.

    Spark counts the runs once; each then gives its frequency to itself and to each different part of it, in one more exchange.
    """
    if m.spark:
        a, b, c = (f"split_part(key, ' ', {k})" for k in (1, 2, 3))
        parts = f"CASE n WHEN 1 THEN cast(array() AS array<string>) WHEN 2 THEN array_distinct(array({a}, {b})) ELSE array_distinct(array({a}, {b}, {c}, concat({a}, ' ', {b}), concat({b}, ' ', {c}))) END"
        none = "cast(null AS bigint)"
        each = f"transform({parts}, p -> named_struct('key', p, 'n', cast(null AS int), 'freq', {none}, 'around', freq))"
        own = f"CASE WHEN freq >= 3 THEN array(named_struct('key', key, 'n', n, 'freq', freq, 'around', {none})) ELSE array() END"
        runs = ", ".join(f"named_struct('n', {n}, 'freq', max(CASE WHEN n = {n} THEN freq END))" for n in (1, 2, 3))
        sums = f"(SELECT key, avg(around) AS mean, array({runs}) AS runs FROM (SELECT inline(concat({own}, {each})) FROM {m.t('grams')}) AS g GROUP BY key)"
        return f"SELECT key, r.n, r.freq, log2(r.n + 1) * (r.freq - coalesce(mean, 0e0)) AS cvalue FROM (SELECT key, mean, explode(filter(runs, r -> r.freq IS NOT NULL)) AS r FROM {sums} AS s) AS x"
    w = lambda k: f"split_part(key, ' ', {k})"
    subs = f"""(SELECT DISTINCT part, key, freq FROM (
      SELECT {w(1)} AS part, key, freq FROM {m.t('grams')} WHERE n >= 2 UNION ALL SELECT {w(2)}, key, freq FROM {m.t('grams')} WHERE n >= 2 UNION ALL SELECT {w(3)}, key, freq FROM {m.t('grams')} WHERE n = 3
      UNION ALL SELECT concat({w(1)}, ' ', {w(2)}), key, freq FROM {m.t('grams')} WHERE n = 3 UNION ALL SELECT concat({w(2)}, ' ', {w(3)}), key, freq FROM {m.t('grams')} WHERE n = 3) AS p)"""
    return f"SELECT g.key, g.n, g.freq, log2(g.n + 1) * (g.freq - coalesce(s.mean, 0e0)) AS cvalue FROM {m.t('grams')} AS g LEFT JOIN (SELECT part, avg(freq) AS mean FROM {subs} AS s GROUP BY part) AS s ON s.part = g.key WHERE g.freq >= 3"


@query("a_cvalue")
def _(m):
    return f"SELECT key, n, freq, round(cvalue, 4) AS cvalue FROM {m.t('cvalue')}"


@query("o_topk_terms")
def _(m):
    return f"SELECT n, key, k FROM (SELECT n, key, row_number() OVER (PARTITION BY n ORDER BY CASE WHEN n = 1 THEN freq * 1e0 ELSE round(cvalue, 6) END DESC, key) AS k FROM {m.t('cvalue')}) AS x WHERE k <= 25"


@query("o_curve")
def _(m):
    """Share of all words that the most frequent ones cover, at fixed ranks."""
    top = f"(SELECT key, freq, row_number() OVER (ORDER BY freq DESC, key) AS k FROM {m.t('grams')} WHERE n = 1 ORDER BY freq DESC, key LIMIT 300)"
    return f"""SELECT {m.big('k')} AS rank, {m.big('run')} AS covered, round(run * 1e0 / total, 6) AS share FROM (SELECT k, sum(freq) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM {top} AS t) AS r
      CROSS JOIN (SELECT sum(freq) AS total FROM {m.t('grams')} WHERE n = 1) AS w WHERE k IN (25, 50, 100, 150, 200, 300)"""


@query("o_sample")
def _(m):
    return f"SELECT doc_id, digest FROM (SELECT doc_id, {m.sha('concat(' + repr('seed-7|') + ', ' + m.text('doc_id') + ')')} AS digest FROM {m.t('documents')}) AS d ORDER BY digest, doc_id LIMIT 60"


@derived("judged")
def _(m):
    """Documents that are long enough for quality, held against labels; documents without a label are uncertain."""
    return f"""SELECT d.doc_id, CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS predicted, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'UNCERTAIN' WHEN l.quality = 1 THEN 'GOOD' ELSE 'NO_CONCEPT' END AS gold
      FROM {m.t('documents')} AS d LEFT JOIN {m.t('labels')} AS l ON l.doc_id = d.doc_id"""


@query("j_adjudicate")
def _(m):
    return f"SELECT doc_id, gold, CASE WHEN gold = 'UNCERTAIN' THEN 'UNCERTAIN' WHEN predicted = 1 AND gold = 'GOOD' THEN 'TP' WHEN predicted = 1 THEN 'FP' WHEN gold = 'GOOD' THEN 'FN' ELSE 'TN' END AS outcome FROM {m.t('judged')}"


CONFUSION = """sum(CASE WHEN predicted = 1 AND gold = 'GOOD' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN predicted = 1 AND gold = 'NO_CONCEPT' THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN predicted = 0 AND gold = 'GOOD' THEN 1 ELSE 0 END) AS fn,
      sum(CASE WHEN gold = 'UNCERTAIN' THEN 1 ELSE 0 END) AS uncertain, sum(predicted) AS positives, count(*) AS n"""


@query("a_confusion")
def _(m):
    return f"""SELECT {m.big('tp')} AS tp, {m.big('fp')} AS fp, {m.big('fn')} AS fn, {m.big('uncertain')} AS uncertain, round(CASE WHEN uncertain = 0 THEN tp * 1e0 / nullif(tp + fp, 0) END, 6) AS precision_all, round(tp * 1e0 / nullif(tp + fp, 0), 6) AS precision_selective,
      round(tp * 1e0 / nullif(tp + fn, 0), 6) AS coverage, round((n - uncertain) * 1e0 / nullif(n, 0), 6) AS adjudicated FROM (SELECT {CONFUSION} FROM {m.t('judged')}) AS c"""


@query("a_wilson")
def _(m):
    per = f"(SELECT d.lang, count(*) AS n, {m.big('sum(l.quality)')} AS hits FROM {m.t('labels')} AS l JOIN {m.t('documents')} AS d ON d.doc_id = l.doc_id GROUP BY d.lang)"
    return f"SELECT lang, n, hits, round({wilson('hits', 'n')}, 6) AS low, round({wilson('hits', 'n', '+')}, 6) AS high FROM {per} AS p"


@query("a_precision")
def _(m):
    """Labelled documents are read in full; the rest is bounded by what the read ones show."""
    return f"""SELECT {m.big('n')} AS population, {m.big('n - uncertain')} AS swept, round({wilson('tp', '(tp + fp)')}, 6) AS residual_low, round(((tp + fp) + (positives - tp - fp) * ({wilson('tp', '(tp + fp)')}) - fp) / nullif(positives, 0), 6) AS combined_low, round(1 - (n - uncertain) * 1e0 / n, 6) AS undetectable
      FROM (SELECT {CONFUSION} FROM {m.t('judged')}) AS c"""


@query("x_two_readers")
def _(m):
    """Both labels as two readers: only agreement on good counts as right."""
    hits = "sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)"
    return f"SELECT count(*) AS n, {m.big(hits)} AS agreed, round({wilson(hits, 'count(*)')}, 6) AS low FROM {m.t('labels')}"


@derived("seg_status")
def _(m):
    """Each segment as covered, decided or pending by the words that no key explains."""
    known = f"(SELECT word FROM {m.t('stop_words')} UNION SELECT word FROM {m.t('function_words')} UNION SELECT word FROM {m.t('senses')})"
    own = f"(SELECT t.doc_id, t.seg_no, count(*) AS n, count(k.key) AS hits, sum(CASE WHEN k.key IS NULL AND w.word IS NOT NULL THEN 1 ELSE 0 END) AS decided FROM {m.t('tokens')} AS t LEFT JOIN (SELECT key FROM {m.t('matcher')}) AS k ON k.key = t.key LEFT JOIN {known} AS w ON w.word = t.key GROUP BY t.doc_id, t.seg_no)"
    return f"SELECT doc_id, seg_no, n, hits, {m.big('decided')} AS decided, {m.big('n - hits - decided')} AS pending, CASE WHEN hits = n THEN 'covered' WHEN hits + decided = n THEN 'decided' ELSE 'pending' END AS status FROM {own} AS o"


@query("a_partition")
def _(m):
    return f"SELECT status, count(*) AS segments, {m.big('sum(n)')} AS tokens, {m.big('sum(pending)')} AS pending FROM {m.t('seg_status')} GROUP BY status"


@query("a_coverage")
def _(m):
    return f"SELECT count(*) AS segments, round(avg(CASE WHEN hits > 0 THEN 1e0 ELSE 0e0 END), 6) AS with_concept, round(avg(hits), 6) AS hits_each, round(sum(hits) * 1e0 / sum(n), 6) AS token_share FROM {m.t('seg_status')}"


@derived("oov")
def _(m):
    return f"""SELECT t.key AS token, CASE WHEN k.mode = 'review' THEN 'ambiguous' WHEN f.word IS NOT NULL THEN 'function' ELSE 'unknown' END AS stratum, count(*) AS n FROM {m.t('tokens')} AS t LEFT JOIN {m.t('matcher')} AS k ON k.key = t.key
      LEFT JOIN (SELECT word FROM {m.t('stop_words')} UNION SELECT word FROM {m.t('function_words')}) AS f ON f.word = t.key WHERE k.key IS NULL OR k.mode = 'review' GROUP BY t.key, CASE WHEN k.mode = 'review' THEN 'ambiguous' WHEN f.word IS NOT NULL THEN 'function' ELSE 'unknown' END"""


@query("a_oov")
def _(m):
    return f"SELECT token, stratum, n FROM {m.t('oov')}"


@query("x_ceiling")
def _(m):
    return f"SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS k FROM (SELECT token, n FROM {m.t('oov')} WHERE stratum = 'unknown' ORDER BY n DESC, token LIMIT 100) AS o"


@query("k_target_mass")
def _(m):
    """Mass of unknown words by how many senses they have."""
    return f"""SELECT CASE WHEN s.n_senses IS NULL THEN 'unlisted' WHEN s.n_senses <= 2 THEN 'few' ELSE 'many' END AS kind, count(*) AS terms, {m.big('sum(o.n)')} AS mass FROM {m.t('oov')} AS o LEFT JOIN {m.t('senses')} AS s ON s.word = o.token
      GROUP BY CASE WHEN s.n_senses IS NULL THEN 'unlisted' WHEN s.n_senses <= 2 THEN 'few' ELSE 'many' END"""


@derived("heading_status")
def _(m):
    """Headings by whether some word is a key; what recurs has mass."""
    hit = f"(SELECT DISTINCT x.page_id, x.ix FROM (SELECT page_id, ix, {m.explode(m.rx_all('lower(title)', T.WORD), 'word')} FROM {headings(m)} AS h) AS x JOIN {m.t('matcher')} AS k ON k.key = x.word)"
    return f"""SELECT h.page_id, h.ix, trim(h.title) AS title, CASE WHEN length(trim(h.title)) < 4 OR lower(trim(h.title)) IN ('menu', 'contents', 'index', 'home') THEN 'furniture' WHEN c.page_id IS NOT NULL THEN 'covered' ELSE 'missing' END AS status
      FROM {headings(m)} AS h LEFT JOIN {hit} AS c ON c.page_id = h.page_id AND c.ix = h.ix"""


@query("f_furniture")
def _(m):
    return f"SELECT page_id, ix, status = 'furniture' AS furniture FROM {m.t('heading_status')}"


@query("a_heading_coverage")
def _(m):
    return f"SELECT status, count(*) AS n, {m.big('sum(length(title))')} AS mass, round(count(*) * 1e0 / sum(count(*)) OVER (), 6) AS share FROM {m.t('heading_status')} GROUP BY status"


@derived("cuts")
def _(m):
    """Sensitivity and specificity of short texts as a sign of low quality, at each hundredth."""
    return f"""SELECT t.cut, avg(CASE WHEN j.quality = 0 THEN CASE WHEN j.score <= t.cut THEN 1e0 ELSE 0e0 END END) AS sensitivity, avg(CASE WHEN j.quality = 1 THEN CASE WHEN j.score > t.cut THEN 1e0 ELSE 0e0 END END) AS specificity
      FROM (SELECT l.quality, least(100e0, d.n_chars / 20e0) AS score FROM {m.t('labels')} AS l JOIN {m.t('documents')} AS d ON d.doc_id = l.doc_id) AS j CROSS JOIN {m.numbers(0, 100, 'cut')} AS t GROUP BY t.cut"""


@query("a_youden")
def _(m):
    return f"""SELECT {m.big('cut')} AS cut, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, sensitivity + specificity - 1 >= 5e-1 AS usable FROM {m.t('cuts')} ORDER BY round(sensitivity + specificity, 9) DESC, cut LIMIT 1"""


@query("k_specificity")
def _(m):
    """Concepts whose contexts are less spread than the best cut count as domain terms."""
    return f"""SELECT CASE WHEN h.total <= 1 THEN 'unscored' WHEN h.h / log2(h.total) <= c.middle THEN 'domain' ELSE 'general' END AS verdict, count(*) AS n, {m.big('sum(h.total)')} AS mass FROM {m.t('entropy')} AS h CROSS JOIN (SELECT {m.median('h / log2(total)')} AS middle FROM {m.t('entropy')} WHERE total > 1) AS c
      GROUP BY CASE WHEN h.total <= 1 THEN 'unscored' WHEN h.h / log2(h.total) <= c.middle THEN 'domain' ELSE 'general' END"""


@query("a_summary")
def _(m):
    return f"SELECT lang, round(avg(n_chars), 4) AS mean, {m.dbl(m.median('n_chars'))} AS middle, round({m.pstdev('n_chars')}, 4) AS spread, min(n_chars) AS least, max(n_chars) AS most FROM {m.t('documents')} GROUP BY lang"


@query("a_corpus_sha")
def _(m):
    """A digest of digests: documents by bucket in order of id, then the buckets."""
    per = f"(SELECT doc_id % 512 AS bucket, {m.sha(m.all_of(m.sha('text'), 'doc_id', ''))} AS digest, count(*) AS n FROM {m.t('documents')} GROUP BY doc_id % 512)"
    return f"SELECT {m.sha(m.all_of('digest', 'bucket', ''))} AS digest, {m.big('sum(n)')} AS n FROM {per} AS p"


@query("a_fragments")
def _(m):
    """Matches that stand next to a capitalised word on either side within a line."""
    edge = f"(SELECT doc_id, seg_no, s, lag(token) OVER w AS before, lead(token) OVER w AS after FROM {m.t('tokens')} WINDOW w AS (PARTITION BY doc_id, seg_no ORDER BY tok_no))"
    near = f"{m.rx('coalesce(x.before, ' + repr('') + ')', '^[A-Z]')} AND {m.rx('coalesce(x.after, ' + repr('') + ')', '^[A-Z]')}"
    return f"SELECT v.key, count(*) AS n, {m.big(f'sum(CASE WHEN {near} THEN 1 ELSE 0 END)')} AS inside, round(avg(CASE WHEN {near} THEN 1e0 ELSE 0e0 END), 6) AS share FROM {m.t('auto_events')} AS v JOIN {edge} AS x ON x.doc_id = v.doc_id AND x.seg_no = v.seg_no AND x.s = v.s GROUP BY v.key"


@query("a_argmax")
def _(m):
    return f"SELECT concept_id, doc_id, n FROM (SELECT concept_id, doc_id, n, row_number() OVER (PARTITION BY concept_id ORDER BY n DESC, doc_id) AS k FROM (SELECT concept_id, doc_id, count(*) AS n FROM {m.t('auto_events')} GROUP BY concept_id, doc_id) AS c) AS r WHERE k = 1"


@query("a_contexts")
def _(m):
    return f"SELECT contexts, count(*) AS n, {m.set_of('concept_id')} AS concepts FROM {m.t('concepts')} GROUP BY contexts"


@query("f_prose")
def _(m):
    return f"SELECT doc_id, seg_no, NOT {m.rx('line', '^[ ]{0,3}#')} AND position('![' IN line) = 0 AND position('|' IN line) = 0 AS prose FROM {m.t('segments')}"


@query("f_attested")
def _(m):
    """Up to six citations of each surface; a surface's words must be whole tokens, so that a hyphen is no boundary."""
    return f"SELECT concept_id, key, doc_id, seg_no, s, k FROM (SELECT f.concept_id, f.key, f.doc_id, f.seg_no, f.s, row_number() OVER (PARTITION BY f.concept_id, f.key ORDER BY f.doc_id, f.seg_no, f.s) AS k FROM {m.t('auto_found')} AS f) AS x WHERE k <= 6"


@derived("auto_found")
def _(m):
    return f"SELECT doc_id, seg_no, s, e, n, key, concept_id, lang FROM {m.t('found')} WHERE mode = 'auto'"


@query("f_attest_count")
def _(m):
    """Occurrences of single words where a hyphen or a point is a boundary too."""
    return f"""SELECT k.key, count(*) AS n FROM (SELECT {m.explode(m.rx_all('lower(line)', T.UNIT), 'word')} FROM {m.t('segments')}) AS w JOIN (SELECT key FROM {m.t('matcher')}) AS k ON k.key = w.word GROUP BY k.key"""


@query("f_undecided")
def _(m):
    owned = f"(SELECT DISTINCT lower(form) AS form FROM {m.t('forms')})"
    return f"SELECT g.key, g.freq FROM {m.t('grams')} AS g LEFT JOIN {owned} AS o ON o.form = g.key LEFT JOIN (SELECT word FROM {m.t('stop_words')}) AS s ON s.word = g.key WHERE g.n = 1 AND g.freq >= 3 AND o.form IS NULL AND s.word IS NULL"


@query("x_candidates")
def _(m):
    """Terms that no surface owns and that are characteristic of English texts, with their first place."""
    owned = f"(SELECT DISTINCT lower(form) AS form FROM {m.t('forms')})"
    first = f"(SELECT key, min(doc_id) AS doc_id FROM {m.t('tokens')} GROUP BY key)"
    return f"""SELECT term, here, round(g2, 3) AS g2, f.doc_id AS cited FROM (SELECT k.term, k.here, k.g2 FROM {m.t('keyness')} AS k LEFT JOIN {owned} AS o ON o.form = k.term LEFT JOIN (SELECT word FROM {m.t('function_words')} GROUP BY word) AS w ON w.word = k.term
      WHERE o.form IS NULL AND w.word IS NULL AND k.here >= 3 AND k.g2 > 0 AND k.weirdness >= 8 ORDER BY round(k.g2, 6) DESC, k.term LIMIT 40) AS t JOIN {first} AS f ON f.key = t.term"""
