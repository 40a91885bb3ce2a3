"""Queries of language, canonical text, projections, status and the relation grammar."""

from __future__ import annotations

from lexloom import lexicon
from lexloom.plans.registry import query
from lexloom.plans.tables import derived

#: The temporal concept that puts what follows it first.
AFTER = "after"


def canonical(p: str) -> None:
    """Automatic events, languages, replacements and canonical text of documents (no prefix) or queries (q_)."""

    @derived(f"{p}auto_events", keep=bool(p))
    def _(m):
        return f"SELECT v.doc_id, v.seg_no, v.seg_start, v.s, v.e, v.n, v.key, v.concept_id, v.lang, c.semantic_class FROM {m.t(p + 'events')} AS v JOIN {m.t('concepts')} AS c ON v.concept_id = c.concept_id WHERE v.mode = 'auto'"

    @derived(f"{p}seg_lang")
    def _(m):
        lone = f"(SELECT word, min(lang) AS lang FROM {m.t('function_words')} GROUP BY word HAVING count(DISTINCT lang) = 1)"
        words = f"SELECT t.doc_id, t.seg_no, f.lang, t.n FROM {m.t(p + 'listed')} AS t JOIN {lone} AS f ON t.word = f.word" if m.spark else f"SELECT t.doc_id, t.seg_no, f.lang, 1 FROM {m.t(p + 'tokens')} AS t JOIN {lone} AS f ON t.key = f.word"
        return f"""SELECT doc_id, seg_no, en, es, CASE WHEN en + es = 0 THEN 'unknown' WHEN least(en, es) * 2 >= greatest(en, es) THEN 'mixed' WHEN en > es THEN 'en' ELSE 'es' END AS language FROM (
          SELECT doc_id, seg_no, {m.big("sum(CASE WHEN lang = 'en' THEN weight ELSE 0 END)")} AS en, {m.big("sum(CASE WHEN lang = 'es' THEN weight ELSE 0 END)")} AS es FROM (
            SELECT doc_id, seg_no, lang, 2 AS weight FROM {m.t(p + 'auto_events')}
            UNION ALL {words}
            UNION ALL SELECT doc_id, seg_no, 'none', 0 FROM {m.t(p + 'segments')}) AS w GROUP BY doc_id, seg_no) AS x"""

    @derived(f"{p}proposed")
    def _(m):
        """Automatic events with the text that a rewrite would put in their place."""
        return f"""SELECT v.doc_id, v.seg_no, v.seg_start, v.s, v.e, v.key, v.concept_id, v.semantic_class, g.line, substring(g.line, v.s + 1, v.e - v.s) AS original, coalesce(f.form, substring(g.line, v.s + 1, v.e - v.s)) AS replacement
          FROM {m.t(p + 'auto_events')} AS v JOIN {m.t(p + 'segments')} AS g ON g.doc_id = v.doc_id AND g.seg_no = v.seg_no JOIN {m.t(p + 'seg_lang')} AS l ON l.doc_id = v.doc_id AND l.seg_no = v.seg_no
          LEFT JOIN {m.t('first_surface')} AS f ON f.concept_id = v.concept_id AND f.lang = CASE WHEN v.lang = 'shared' THEN l.language ELSE v.lang END"""

    @derived(f"{p}rewrites")
    def _(m):
        """Whether a rewrite keeps the sentence: no fragment, no lost copula, no change of one word for its opposite, no token of numbers, names or marks lost."""
        old, new = m.words("lower(original)"), m.words("lower(replacement)")
        has = lambda words, word: m.has(words, word)
        crossed = " OR ".join(
            f"((({has('old', a)} AND {has('new', b)}) OR ({has('old', b)} AND {has('new', a)})) AND NOT ({has('old', a)} AND {has('old', b)} AND {has('new', a)} AND {has('new', b)}))"
            for a, b in ((repr(x), repr(y)) for x, y in lexicon.ANTONYMS)
        )
        short = f"{m.size('new')} < {m.size('old')} AND substring(lower(original), 1, length(replacement)) = lower(replacement) AND {m.at('new', m.size('new'))} IN (SELECT word FROM {m.t('dangling')})"
        copula = f"{m.at('old', '1')} IN (SELECT word FROM {m.t('copulas')}) AND {m.at('new', '1')} NOT IN (SELECT word FROM {m.t('copulas')})"
        marked = m.rx("x", "[0-9_@/<>{}$%`]|[.].|^-")
        lost = f"{m.size(m.filter('old', 'x', f'{marked} AND NOT ' + has('new', 'x')))} > 0"
        return f"""SELECT doc_id, seg_no, seg_start, s, e, key, concept_id, semantic_class, line, original, replacement,
          CASE WHEN {short} THEN 'dangling' WHEN {copula} THEN 'copula' WHEN {crossed} THEN 'antonym' WHEN {lost} THEN 'protected' ELSE 'safe' END AS verdict
          FROM (SELECT *, {old} AS old, {new} AS new FROM {m.t(p + 'proposed')} AS v) AS w"""

    @derived(f"{p}replaced")
    def _(m):
        """What each event is rewritten to: itself where the rewrite is not safe."""
        return f"SELECT doc_id, seg_no, seg_start, s, e, key, concept_id, semantic_class, line, original, CASE WHEN verdict = 'safe' THEN replacement ELSE original END AS replacement FROM {m.t(p + 'rewrites')} AS j"

    @derived(f"{p}canonical")
    def _(m):
        pieces = f"(SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, seg_no ORDER BY s), 0) AS before FROM {m.t(p + 'replaced')})"
        return f"""SELECT doc_id, seg_no, concat(head, substring(line, reach + 1)) AS canonical_text FROM (
          SELECT doc_id, seg_no, max(line) AS line, max(e) AS reach, {m.all_of('concat(substring(line, before + 1, s - before), replacement)', 's', '')} AS head FROM {pieces} AS r GROUP BY doc_id, seg_no) AS p"""


@derived("first_surface")
def _(m):
    return f"""SELECT concept_id, lang, form FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, lang ORDER BY CASE WHEN kind = 'pref' THEN 0 ELSE 1 END, ord) AS rn FROM {m.t('forms')} WHERE policy = 'auto' AND kind <> 'observed') AS f WHERE rn = 1"""


canonical("")
canonical("q_")


@query("p_language")
def _(m):
    return f"SELECT doc_id, seg_no, en, es, language FROM {m.t('seg_lang')}"


@query("p_replacement")
def _(m):
    return f"SELECT doc_id, seg_no, s, e, original, replacement FROM {m.t('replaced')}"


@query("p_canonical_text")
def _(m):
    return f"SELECT doc_id, seg_no, length(canonical_text) AS points, {m.sha('canonical_text')} AS digest FROM {m.t('canonical')}"


@query("p_mappings")
def _(m):
    shift = "coalesce(sum(length(replacement) - length(original)) OVER (PARTITION BY doc_id, seg_no ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"SELECT doc_id, seg_no, s, e, {m.big(f's + {shift}')} AS canonical_s, {m.big(f's + {shift} + length(replacement)')} AS canonical_e FROM {m.t('replaced')}"


@query("a_mutations")
def _(m):
    return f"""SELECT CASE WHEN original = replacement THEN 'same' WHEN lower(original) = lower(replacement) THEN 'case' ELSE 'changed' END AS kind, count(*) AS n FROM {m.t('replaced')} GROUP BY CASE WHEN original = replacement THEN 'same' WHEN lower(original) = lower(replacement) THEN 'case' ELSE 'changed' END"""


@query("f_mutates_protected")
def _(m):
    """Events whose proposed rewrite would lose protected text that they hold."""
    return f"SELECT doc_id, seg_no, s, e FROM {m.t('rewrites')} AS j WHERE verdict = 'protected'"


@query("f_rewrite_safe")
def _(m):
    return f"SELECT doc_id, seg_no, s, e, verdict FROM {m.t('rewrites')} AS j"


def tokens_of(m, p=""):
    """doc_id, seg_no, concept_tokens, operator_tokens."""
    return f"""(SELECT doc_id, seg_no, {m.set_of("concat('c__', replace(concept_id, '.', '__'))", ' ')} AS concept_tokens, {m.set_of("CASE WHEN semantic_class IN ('modality', 'polarity', 'temporal', 'condition', 'quantity') THEN concat(semantic_class, '__', split_part(concept_id, '.', 2)) END", ' ')} AS operator_tokens FROM {m.t(p + 'auto_events')} GROUP BY doc_id, seg_no)"""


@query("p_tokens")
def _(m):
    return f"SELECT doc_id, seg_no, concept_tokens, operator_tokens FROM {tokens_of(m)} AS k"


@derived("surfaces")
def _(m):
    """By segment: all automatic forms of its concepts, those of its own language and those of others, shared ones with its own."""
    form = lambda test: m.set_of(f"CASE WHEN {test} THEN f.form END", " ")
    return f"""SELECT v.doc_id, v.seg_no, {m.set_of('f.form', ' ')} AS added, {form("f.lang = l.language OR f.lang = 'shared'")} AS same, {form("f.lang <> l.language AND f.lang <> 'shared'")} AS crossed
      FROM (SELECT DISTINCT doc_id, seg_no, concept_id FROM {m.t('auto_events')}) AS v JOIN {m.t('seg_lang')} AS l ON l.doc_id = v.doc_id AND l.seg_no = v.seg_no
      JOIN {m.t('forms')} AS f ON f.concept_id = v.concept_id AND f.policy = 'auto' AND f.kind <> 'observed' GROUP BY v.doc_id, v.seg_no"""


@query("p_text_expanded")
def _(m):
    """The line, all automatic forms of its concepts, and its concept tokens, in one text."""
    return f"""SELECT g.doc_id, g.seg_no, concat_ws(' ', g.line, nullif(s.added, ''), nullif(k.concept_tokens, '')) AS expanded FROM {m.t('segments')} AS g
      LEFT JOIN {m.t('surfaces')} AS s ON s.doc_id = g.doc_id AND s.seg_no = g.seg_no LEFT JOIN {tokens_of(m)} AS k ON k.doc_id = g.doc_id AND k.seg_no = g.seg_no"""


@query("p_search_fields")
def _(m):
    """Fields by segment: the line, forms of its own language, forms of other languages, concept tokens."""
    return f"""SELECT g.doc_id, g.seg_no, g.line AS raw, coalesce(s.same, '') AS same, coalesce(s.crossed, '') AS crossed, coalesce(k.concept_tokens, '') AS concepts FROM {m.t('segments')} AS g
      LEFT JOIN {m.t('surfaces')} AS s ON s.doc_id = g.doc_id AND s.seg_no = g.seg_no LEFT JOIN {tokens_of(m)} AS k ON k.doc_id = g.doc_id AND k.seg_no = g.seg_no"""


@query("p_preferred")
def _(m):
    return f"""SELECT v.doc_id, f.lang, {m.set_of('f.form')} AS preferred FROM (SELECT DISTINCT doc_id, concept_id FROM {m.t('auto_events')}) AS v JOIN {m.t('first_surface')} AS f ON f.concept_id = v.concept_id GROUP BY v.doc_id, f.lang"""


@query("p_status")
def _(m):
    return f"""SELECT g.doc_id, g.seg_no, CASE WHEN count(CASE WHEN v.mode = 'review' THEN 1 END) > 0 THEN 'review' WHEN count(v.key) > 0 THEN 'accepted' ELSE 'partial' END AS status FROM {m.t('segments')} AS g LEFT JOIN {m.t('events')} AS v ON v.doc_id = g.doc_id AND v.seg_no = g.seg_no GROUP BY g.doc_id, g.seg_no"""


@query("p_recon_stub")
def _(m):
    return f"SELECT doc_id, seg_no, s, e, key, owners, 'pending' AS state, 0 AS attempts FROM {m.t('events')} WHERE mode = 'review'"


@query("p_units")
def _(m):
    return f"""SELECT doc_id, seg_no, concat('u', {m.text('row_number() OVER (PARTITION BY doc_id, seg_no ORDER BY s, e, concept_id)')}) AS unit_id, s, e, concept_id,
      CASE semantic_class WHEN 'action' THEN 'predicate' WHEN 'actor' THEN 'agent' WHEN 'entity' THEN 'theme' WHEN 'quantity' THEN 'measure' WHEN 'property' THEN 'attribute' ELSE 'marker' END AS role FROM {m.t('auto_events')}"""


@query("f_unresolved")
def _(m):
    return f"""SELECT doc_id, seg_no, count(*) AS gaps, {m.big('sum(s - before)')} AS points FROM (SELECT doc_id, seg_no, s, coalesce(lag(e) OVER (PARTITION BY doc_id, seg_no ORDER BY s), 0) AS before FROM {m.t('auto_events')}) AS x WHERE s - before > 1 GROUP BY doc_id, seg_no"""


@derived("uncertain")
def _(m):
    """Segments with a word that joins parts or points back: the grammar abstains there."""
    if m.spark:
        return f"SELECT t.doc_id, t.seg_no, sum(t.n) AS hints FROM {m.t('listed')} AS t JOIN {m.t('hedges')} AS h ON h.word = t.word GROUP BY t.doc_id, t.seg_no"
    return f"SELECT t.doc_id, t.seg_no, count(*) AS hints FROM {m.t('tokens')} AS t JOIN {m.t('hedges')} AS h ON h.word = t.key GROUP BY t.doc_id, t.seg_no"


@query("f_abstain")
def _(m):
    return f"SELECT doc_id, seg_no, hints FROM {m.t('uncertain')} AS u"


@derived("units")
def _(m):
    """Automatic events of segments where the grammar does not abstain."""
    return f"SELECT v.* FROM {m.t('auto_events')} AS v WHERE NOT EXISTS (SELECT 1 FROM {m.t('uncertain')} AS u WHERE u.doc_id = v.doc_id AND u.seg_no = v.seg_no)"


@derived("classed")
def _(m):
    one = lambda c: f"count(CASE WHEN semantic_class = '{c}' THEN 1 END)"
    at = lambda c, f, x='s': f"{f}(CASE WHEN semantic_class = '{c}' THEN {x} END)"
    return f"""SELECT doc_id, seg_no, {one('action')} AS actions, {one('entity')} AS entities, {one('condition')} AS conditions, {one('temporal')} AS temporals, {one('quantity')} AS quantities,
      {at('action', 'min')} AS action_at, {at('action', 'min', 'e')} AS action_end, {at('action', 'max')} AS action_last, {at('action', 'max', 'e')} AS last_end, {at('temporal', 'min')} AS temporal_at, {at('temporal', 'min', 'e')} AS temporal_end,
      {at('temporal', 'min', 'concept_id')} AS temporal_id, {at('condition', 'min')} AS condition_at FROM {m.t('units')} AS v GROUP BY doc_id, seg_no"""


@query("m_actor_object")
def _(m):
    """With one action: the only actor that ends before it, the only entity that starts after it."""
    sides = f"""(SELECT v.doc_id, v.seg_no, min(k.action_at) AS action_at, count(CASE WHEN v.semantic_class = 'actor' AND v.e <= k.action_at THEN 1 END) AS actors, max(CASE WHEN v.semantic_class = 'actor' AND v.e <= k.action_at THEN v.s END) AS actor_at,
      count(CASE WHEN v.semantic_class = 'entity' AND v.s >= k.action_end THEN 1 END) AS things, min(CASE WHEN v.semantic_class = 'entity' AND v.s >= k.action_end THEN v.s END) AS thing_at
      FROM {m.t('units')} AS v JOIN {m.t('classed')} AS k ON k.doc_id = v.doc_id AND k.seg_no = v.seg_no WHERE k.actions = 1 GROUP BY v.doc_id, v.seg_no)"""
    return f"""SELECT doc_id, seg_no, 'actor_of' AS relation, actor_at AS source, action_at AS target FROM {sides} AS a WHERE actors = 1
      UNION ALL SELECT doc_id, seg_no, 'object_of', thing_at, action_at FROM {sides} AS b WHERE things = 1"""


@query("m_condition")
def _(m):
    return f"SELECT v.doc_id, v.seg_no, v.s AS source, k.action_at AS target FROM {m.t('units')} AS v JOIN {m.t('classed')} AS k ON k.doc_id = v.doc_id AND k.seg_no = v.seg_no WHERE v.semantic_class = 'condition' AND k.actions = 1"


@query("m_polarity_modality")
def _(m):
    """With one action: polarity within four characters on either side of it, modality that ends within four of its start."""
    return f"""SELECT a.doc_id, a.seg_no, CASE WHEN a.semantic_class = 'polarity' THEN 'negates' ELSE 'modality' END AS relation, a.s AS source, k.action_at AS target FROM {m.t('units')} AS a JOIN {m.t('classed')} AS k ON k.doc_id = a.doc_id AND k.seg_no = a.seg_no
      WHERE k.actions = 1 AND ((a.semantic_class = 'polarity' AND (abs(a.e - k.action_at) <= 4 OR abs(k.action_end - a.s) <= 4)) OR (a.semantic_class = 'modality' AND abs(a.e - k.action_at) <= 4))"""


@derived("ordered")
def _(m):
    """Segments of two actions and one temporal marker: which action stands on its left and right side of the relation.

    The marker stands between the two, or before both with the one comma of the line between them.
    """
    return f"""SELECT doc_id, seg_no, temporal_id, CASE WHEN infix THEN action_at WHEN prefix THEN action_last END AS one, CASE WHEN infix THEN action_last WHEN prefix THEN action_at END AS two FROM (
      SELECT k.*, k.action_end <= k.temporal_at AND k.temporal_end <= k.action_last AS infix, k.temporal_end <= k.action_at AND length(g.line) - length(replace(g.line, ',', '')) = 1 AND position(',' IN g.line) - 1 BETWEEN k.action_end AND k.action_last - 1 AS prefix
      FROM {m.t('classed')} AS k JOIN {m.t('segments')} AS g ON g.doc_id = k.doc_id AND g.seg_no = k.seg_no WHERE k.actions = 2 AND k.temporals = 1) AS x"""


@query("m_temporal")
def _(m):
    """One relation each way; or that the grammar abstains: the marker's place is no known form, or there are more than two actions."""
    after = f"temporal_id LIKE '%.{AFTER}'"
    return f"""SELECT doc_id, seg_no, CASE WHEN {after} THEN 'after' ELSE 'before' END AS relation, one AS source, two AS target FROM {m.t('ordered')} AS a WHERE one IS NOT NULL
      UNION ALL SELECT doc_id, seg_no, CASE WHEN {after} THEN 'before' ELSE 'after' END, two, one FROM {m.t('ordered')} AS b WHERE one IS NOT NULL
      UNION ALL SELECT k.doc_id, k.seg_no, 'abstain', k.action_at, k.action_last FROM {m.t('classed')} AS k LEFT JOIN {m.t('ordered')} AS o ON o.doc_id = k.doc_id AND o.seg_no = k.seg_no
        WHERE k.actions > 2 OR (k.actions = 2 AND k.temporals = 1 AND o.one IS NULL) OR (k.actions = 2 AND k.temporals <> 1 AND k.conditions <> 1)"""


@query("m_condition_comma")
def _(m):
    """Two actions, no temporal marker, one condition before the first comma and one action after it: a condition of that one."""
    return f"""SELECT doc_id, seg_no, source, target, comma FROM (SELECT k.doc_id, k.seg_no, k.condition_at AS source, k.action_last AS target, k.action_at, position(',' IN g.line) - 1 AS comma FROM {m.t('classed')} AS k JOIN {m.t('segments')} AS g ON g.doc_id = k.doc_id AND g.seg_no = k.seg_no
      WHERE k.actions = 2 AND k.temporals <> 1 AND k.conditions = 1) AS x WHERE comma >= 0 AND source < comma AND action_at <= comma AND target > comma"""


@query("m_quantity")
def _(m):
    return f"""SELECT a.doc_id, a.seg_no, a.s AS source, b.s AS target FROM {m.t('units')} AS a JOIN {m.t('units')} AS b ON b.doc_id = a.doc_id AND b.seg_no = a.seg_no JOIN {m.t('classed')} AS k ON k.doc_id = a.doc_id AND k.seg_no = a.seg_no
      WHERE a.semantic_class = 'quantity' AND b.semantic_class = 'entity' AND k.quantities = 1 AND k.entities = 1 AND b.s - a.e BETWEEN 0 AND 2"""


@query("k_query_payload")
def _(m):
    return f"SELECT doc_id, {m.set_of('concept_id')} AS concepts, count(*) AS n, max(CASE WHEN mode = 'review' THEN 1 ELSE 0 END) AS any_review FROM {m.t('events')} GROUP BY doc_id"


@query("a_doc_rollup")
def _(m):
    first = f"(SELECT doc_id, concept_id, min(seg_start + s) AS first FROM {m.t('auto_events')} GROUP BY doc_id, concept_id)"
    return f"SELECT doc_id, {m.all_of('concept_id', 'first')} AS concepts FROM {first} AS f GROUP BY doc_id"


@query("x_match")
def _(m):
    return f"SELECT d.lang, count(DISTINCT v.doc_id) AS docs, count(*) AS events FROM {m.t('auto_events')} AS v JOIN {m.t('documents')} AS d ON d.doc_id = v.doc_id GROUP BY d.lang"


@query("p_build_record")
def _(m):
    return f"""SELECT c.concept_id, c.semantic_class, coalesce(max(CASE WHEN f.lang = 'en' AND f.kind = 'pref' THEN f.form END), '') AS en, coalesce(max(CASE WHEN f.lang = 'es' AND f.kind = 'pref' THEN f.form END), '') AS es, {m.set_of("CASE WHEN f.kind = 'alt' THEN f.form END")} AS alt FROM {m.t('concepts')} AS c LEFT JOIN {m.t('forms')} AS f ON f.concept_id = c.concept_id GROUP BY c.concept_id, c.semantic_class"""


@query("p_semantic_digest")
def _(m):
    return f"SELECT {m.sha(m.all_of('definition', 'concept_id', '|'))} AS digest, count(*) AS n FROM {m.t('concepts')}"


@query("p_canonical_json")
def _(m):
    return f"""SELECT concept_id, concat('{{"concept_id":"', concept_id, '","contexts":"', contexts, '","pos":"', pos, '"}}') AS json FROM {m.t('concepts')}"""


@query("p_strip_math")
def _(m):
    clean = m.rx_sub(m.rx_sub("text", "[$][^$]*[A-Za-z][^$]*[$]", " "), "  +", " ")
    return f"SELECT doc_id, length({clean}) AS points, {m.int(m.rx_count('text', '[$]'))} AS signs FROM {m.t('documents')}"


assert lexicon.LONGEST == 3
