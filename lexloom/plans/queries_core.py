"""Queries of segmentation, tokens, matching and lexicon integrity."""

from __future__ import annotations

from lexloom.functions import text as T
from lexloom.plans.registry import query
from lexloom.plans.tables import FOLD, derived


@query("s_infer_kind")
def _(m):
    return f"""SELECT page_id, CASE WHEN suffix IN ('.md', '.markdown') THEN 'markdown' WHEN suffix = '.py' THEN 'python' ELSE 'text' END AS kind
      FROM (SELECT page_id, lower({m.rx_get('url', '([.][A-Za-z]+)$')}) AS suffix FROM {m.t('pages')}) AS p"""


@query("s_prose_lines")
def _(m):
    return f"""SELECT doc_id, seg_no, {m.rx_sub('line', '[ ]+', ' ')} AS line FROM {m.t('segments')} WHERE NOT {m.rx('line', '^[ ]{0,3}#')} AND position('![' IN line) = 0"""


@query("s_rg_index")
def _(m):
    return f"""SELECT e.doc_id, e.seg_no, concat({m.text('e.doc_id')}, '|', {m.text('e.seg_no')}, '|', min(g.line), '|', {m.set_of('e.concept_id', ' ')}) AS entry
      FROM {m.t('events')} AS e JOIN {m.t('segments')} AS g ON e.doc_id = g.doc_id AND e.seg_no = g.seg_no WHERE e.mode = 'auto' GROUP BY e.doc_id, e.seg_no"""


@query("s_skos")
def _(m):
    iri = "concat('<urn:lex:', concept_id, '>')"
    return f"""SELECT line FROM (
      SELECT concat({iri}, ' <inScheme> <urn:lex> .') AS line FROM {m.t('concepts')}
      UNION ALL SELECT concat({iri}, ' <definition> "', definition, '"@en .') FROM {m.t('concepts')}
      UNION ALL SELECT concat({iri}, ' <', kind, 'Label> "', form, '"@', lang, ' .') FROM {m.t('forms')} WHERE kind <> 'observed' AND lang <> 'shared'
      UNION ALL SELECT concat('<urn:lex:', child, '> <broader> <urn:lex:', parent, '> .') FROM {m.t('broader')}
      UNION ALL SELECT concat('<urn:lex:', parent, '> <narrower> <urn:lex:', child, '> .') FROM {m.t('broader')}
      UNION ALL SELECT concat('<urn:lex:', one, '> <related> <urn:lex:', other, '> .') FROM {m.t('related')}) AS x"""


@query("s_synonyms")
def _(m):
    return f"""SELECT concept_id, {m.set_of('form')} AS surfaces FROM {m.t('forms')} WHERE policy = 'auto' AND kind <> 'observed' GROUP BY concept_id HAVING count(DISTINCT form) >= 2"""


@query("s_pending_tasks")
def _(m):
    return f"""SELECT d.doc_id FROM {m.t('documents')} AS d LEFT JOIN {m.t('labels')} AS l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL"""


@query("s_manifest")
def _(m):
    return f"""SELECT concat('{{"concepts":', {m.text('count(DISTINCT concept_id)')}, ',"forms":', {m.text('count(*)')}, '}}') AS manifest FROM {m.t('forms')}"""


@query("s_jsonl")
def _(m):
    return f"""SELECT concat('{{"doc":', {m.text('doc_id')}, ',"end":', {m.text('seg_start + e')}, ',"key":"', key, '","start":', {m.text('seg_start + s')}, '}}') AS line FROM {m.t('events')}"""


@query("s_registry")
def _(m):
    return f"""SELECT c.concept_id, c.semantic_class, c.pos, count(f.form) AS n_forms FROM {m.t('concepts')} AS c LEFT JOIN {m.t('forms')} AS f ON c.concept_id = f.concept_id GROUP BY c.concept_id, c.semantic_class, c.pos"""


@query("g_line_segments")
def _(m):
    return f"SELECT doc_id, seg_no, seg_start, seg_start + length(line) AS seg_end, {m.sha('line')} AS digest FROM {m.t('segments')}"


@query("g_tokens")
def _(m):
    return f"SELECT doc_id, term, count(*) AS n FROM {m.t('doc_terms')} GROUP BY doc_id, term"


@query("g_token_spans")
def _(m):
    return f"SELECT doc_id, seg_no, tok_no, token, seg_start + s AS start_at, seg_start + e AS end_at FROM {m.t('tokens')}"


@query("g_candidate_spans")
def _(m):
    return f"SELECT n, count(*) AS spans, count(DISTINCT key) AS keys, {m.big('sum(e - s)')} AS points FROM {m.t('spans')} GROUP BY n"


@query("g_ngrams")
def _(m):
    grams = f"(SELECT key, n, count(*) AS freq FROM {m.t('spans')} GROUP BY key, n HAVING count(*) >= 3)"
    return f"""SELECT g.key, g.n, g.freq FROM {grams} AS g LEFT JOIN {m.t('stop_words')} AS a ON a.word = split_part(g.key, ' ', 1) LEFT JOIN {m.t('stop_words')} AS b ON b.word = split_part(g.key, ' ', g.n) WHERE g.n = 1 OR (a.word IS NULL AND b.word IS NULL)"""


SENTENCES = "trim(sentence)"


def sentences(m):
    cut = m.rx_sub("line", "([.!?])[ ]+", "$1#|#")
    parts = f"split({cut}, '#[|]#')" if m.spark else f"string_split({cut}, '#|#')"
    return f"(SELECT doc_id, seg_no, {m.explode(parts, 'sentence')} FROM {m.t('segments')})"


@query("g_sentences")
def _(m):
    return f"""SELECT doc_id, seg_no, trim(sentence) AS sentence FROM {sentences(m)} AS x WHERE length(trim(sentence)) > 40 AND length(trim(sentence)) < 300 AND NOT {m.rx('sentence', '^[#|]')}"""


@query("g_prose_sentences")
def _(m):
    return f"""SELECT doc_id, count(*) AS n, {m.big('sum(length(trim(sentence)))')} AS points FROM {sentences(m)} AS x WHERE length(trim(sentence)) BETWEEN 20 AND 400 AND NOT {m.rx('sentence', '^#')} GROUP BY doc_id"""


def headings(m):
    every = m.rx_all("html", "<h[1-4][^>]*>[^<]*</h[1-4]>")
    if m.spark:
        return f"(SELECT page_id, pos AS ix, {m.rx_sub('col', '<[^>]*>', '')} AS title FROM {m.t('pages')} LATERAL VIEW posexplode({every}) v AS pos, col)"
    return f"(SELECT page_id, (generate_subscripts({every}, 1) - 1)::INTEGER AS ix, {m.rx_sub(f'unnest({every})', '<[^>]*>', '')} AS title FROM {m.t('pages')})"


@query("g_headings")
def _(m):
    return f"SELECT page_id, ix, trim(title) AS title FROM {headings(m)} AS h WHERE length(trim(title)) BETWEEN 1 AND 90"


@query("j_prev_heading")
def _(m):
    return f"SELECT page_id, ix, trim(title) AS title, lag(trim(title)) OVER (PARTITION BY page_id ORDER BY ix) AS before FROM {headings(m)} AS h"


@query("g_title_variants")
def _(m):
    bare = m.rx_sub("title", "^[0-9.]+ *", "")
    gloss = m.rx_sub("title", "[(][^)]*[)]", "")
    first = m.rx_get("title", "^([^:-]+)")
    return f"""SELECT DISTINCT page_id, ix, trim(variant) AS variant FROM (
      SELECT page_id, ix, {bare} AS variant FROM {headings(m)} AS h UNION ALL SELECT page_id, ix, {gloss} FROM {headings(m)} AS h
      UNION ALL SELECT page_id, ix, {first} FROM {headings(m)} AS h UNION ALL SELECT page_id, ix, {m.rx_sub('title', 's$', '')} FROM {headings(m)} AS h) AS v WHERE trim(variant) <> ''"""


WHITE = r"[ \t\n\x0b\f\r]*"
WORDS = r"\pL\pN_"
UNITS = "ms|s|min|h|Hz|kHz|MHz|GB|MB|KB|B|kg|g|km|m|cm|mm|°C|°F"
#: Families of protected text: name, pattern and, where the piece is a part of what is matched, what stands before and
#: after it; in the order of precedence. (?ms) is for lines that end at \n alone. Where a piece must end with a word, the
#: pattern takes all of the word, and CHECKED says what the piece must then be like.
FAMILIES = [
    ("html_block", "(?is)" + "|".join(f"<{tag}(?:[^>{WORDS}][^>]*)?>.*?</{tag}{WHITE}>" for tag in ("code", "pre"))),
    ("frontmatter", rf"(?ms)\A---\n.*?^---{WHITE}$"),
    ("fenced_code", r"(?ms)^```.*?^```[^\n]*(?:\n|$)|^~~~.*?^~~~[^\n]*(?:\n|$)"),
    ("html", "<[^<>]+>"),
    ("code", "`[^`]+`"),
    ("link_destination", r"[^)\n]+", r"!?\[[^\]\n]*\]\(", r"\)"),
    ("url", "https?://[^ )]+"),
    ("email", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z.]+"),
    ("placeholder", r"[$][{][{][^\n]*?[}][}]|[{][{][^\n]*?[}][}]|[$][{][A-Za-z_][A-Za-z0-9_]*[}]|%[(][^)]+[)]s|<%[^\n]*?%>|[{][A-Za-z_]+[}]"),
    ("path_or_flag", rf"--?[A-Za-z][{WORDS}-]*|[A-Za-z]:[\\/][^ \t\n\r]+|(?:[.]{{0,2}}/)[^ \t\n\r`]+", rf"^|[^{WORDS}]", ""),
    ("version", "[0-9]+[.][0-9]+(?:[.][0-9]+)*"),
    ("hash", "[0-9a-f]{16,}"),
    ("identifier", rf"[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+[{WORDS}]*", rf"^|[^{WORDS}]", ""),
    ("number_unit", rf"[0-9]+(?:[.,][0-9]+)?[ \t]?(?:%|(?:{UNITS})[{WORDS}]*)", rf"^|[^{WORDS}]", ""),
    ("number", "[0-9]+"),
    ("name", rf"[A-Za-z]+_[A-Za-z0-9_]+[{WORDS}]*|[a-z]+[A-Z][A-Za-z0-9]*[{WORDS}]*|[A-Za-z][{WORDS}-]*[.][A-Za-z0-9_.-]*[A-Za-z0-9_][{WORDS}]*", rf"^|[^{WORDS}]", ""),
]
CHECKED = {
    "identifier": "^[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+$",
    "number_unit": rf"^[0-9]+(?:[.,][0-9]+)?[ \t]?(?:%|{UNITS})$",
    "name": rf"^(?:[A-Za-z]+_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Za-z][{WORDS}-]*[.][A-Za-z0-9_.-]+)$",
}
#: What a text must hold for a family to match in it, cheaper to look for than the family's pattern.
HINTS = {
    "html_block": "contains({}, '</')",
    "frontmatter": "startswith({}, '---')",
    "fenced_code": "(contains({0}, '```') OR contains({0}, '~~~'))",
    "html": "contains({}, '<')",
    "code": "contains({}, '`')",
    "link_destination": "contains({}, '](')",
    "url": "contains({}, '://')",
    "email": "contains({}, '@')",
    "placeholder": "(contains({0}, '{{') OR contains({0}, '%(') OR contains({0}, '<%'))",
    "path_or_flag": r"(contains({0}, '/') OR contains({0}, r':\') OR contains({0}, '-') AND regexp_like({0}, '-[A-Za-z]'))",
    "identifier": "(contains({0}, '-') AND regexp_like({0}, '[A-Z0-9]-[A-Z0-9]'))",
    "number_unit": "regexp_like({}, '[0-9]')",
    "name": rf"regexp_like({{}}, r'[A-Za-z]_|[a-z][A-Z]|[{WORDS}-][.][A-Za-z0-9_.-]')",
}


def protected(m, table="documents", key="doc_id", text="text"):
    """key, family, piece, s, e of all matches of all families, by the marks of cut texts.

    Texts without a match of a family are left at once; of the others only the matches and the lengths of what lies
    between are dealt out, once for all families.
    """
    parts = []
    for name, p, *around in FAMILIES:
        before, after = around or ("", "")
        if m.spark:
            p = p.replace("(?ms)", "(?msd)")
        whole = f"({before})({p})({after})"
        group, some = m.rx_sub(text, whole, ("$1\u0001$2\u0002$3")), m.rx(text, whole)
        if m.spark:
            some = f"{HINTS[name].format(text)} AND {some}" if name in HINTS else some
            parts.append(f"named_struct('family', '{name}', 'parts', CASE WHEN {some} THEN split({group}, '[\u0001\u0002]') END)")
        else:
            src = f"SELECT {key}, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS ix FROM (SELECT {key}, string_split_regex({group}, '[\\x01\\x02]') AS ps FROM {m.t(table)} WHERE {some})"
            parts.append(f"SELECT {key}, '{name}' AS family, ix, length(piece) AS n, CASE WHEN ix % 2 = 1 THEN piece END AS piece FROM ({src}) AS a")
    if m.spark:
        cut = f"(SELECT {key}, explode(array({', '.join(parts)})) AS f FROM {m.t(table)})"
        every = f"SELECT /*+ REPARTITION({key}) */ {key}, f.family AS family, pos AS ix, length(col) AS n, CASE WHEN pos % 2 = 1 THEN col END AS piece FROM {cut} AS a LATERAL VIEW posexplode(f.parts) v AS pos, col"
    else:
        every = " UNION ALL ".join(parts)
    checks = " ".join(f"WHEN '{name}' THEN {m.rx('piece', p)}" for name, p in CHECKED.items())
    return f"""(SELECT {key}, family, piece, s, s + n AS e FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY {key}, family ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM ({every}) AS b) AS c WHERE ix % 2 = 1 AND n > 0 AND CASE family {checks} ELSE true END)"""


@query("g_protected_raw")
def _(m):
    return f"SELECT doc_id, family, piece, {m.big('s')} AS s, {m.big('e')} AS e FROM {protected(m)} AS p"


@query("g_protected_pages")
def _(m):
    return f"SELECT family, count(*) AS n, {m.big('sum(e - s)')} AS points FROM {protected(m, 'pages', 'page_id', 'html')} AS p GROUP BY family"


def shield(p: str, docs: str) -> None:
    """Protected spans of a table of documents, merged, and those that no match may cross."""

    @derived(f"{p}guarded")
    def _(m):
        """In order of start, the longer first: one inside what came before goes, one that overlaps it starts at its end."""
        rank = " ".join(f"WHEN '{name}' THEN {k}" for k, (name, *_) in enumerate(FAMILIES))
        order = f"PARTITION BY doc_id ORDER BY s, e DESC, CASE family {rank} END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return f"""SELECT doc_id, family, {m.big('greatest(s, reach)')} AS s, {m.big('e')} AS e, substring(piece, {m.int('greatest(reach - s, 0) + 1')}) AS piece FROM (
          SELECT *, coalesce(max(e) OVER ({order}), 0) AS reach FROM {protected(m, docs)} AS a) AS b WHERE e > reach"""

    @derived(f"{p}shielded")
    def _(m):
        """A span whose text is an automatic form by itself is none."""
        return f"SELECT doc_id, family, s, e, piece FROM {m.t(p + 'guarded')} AS g WHERE NOT EXISTS (SELECT 1 FROM {m.t('matcher')} AS k WHERE k.mode = 'auto' AND k.key = {FOLD.format('g.piece')})"


shield("", "documents")
shield("q_", "q_documents")


def merged(m):
    return m.t("guarded")


@query("g_merge_spans")
def _(m):
    return f"SELECT doc_id, family, s, e FROM {merged(m)} AS x"


@query("f_overlaps")
def _(m):
    return f"SELECT v.doc_id, v.seg_no, v.s, v.key FROM {m.t('events')} AS v WHERE EXISTS (SELECT 1 FROM {merged(m)} AS p WHERE p.doc_id = v.doc_id AND v.seg_start + v.s < p.e AND v.seg_start + v.e > p.s)"


@query("f_crossing")
def _(m):
    return f"""SELECT DISTINCT t.doc_id, t.seg_no, t.tok_no FROM {m.t('tokens')} AS t JOIN {merged(m)} AS p ON p.doc_id = t.doc_id AND t.seg_start + t.s < p.e AND t.seg_start + t.e > p.s
      WHERE NOT (t.seg_start + t.s <= p.s AND t.seg_start + t.e >= p.e)"""


@query("j_segment_protected")
def _(m):
    return f"""SELECT g.doc_id, g.seg_no, count(*) AS n FROM {m.t('segments')} AS g JOIN {merged(m)} AS p ON p.doc_id = g.doc_id AND g.seg_start < p.e AND g.seg_start + length(g.line) > p.s GROUP BY g.doc_id, g.seg_no"""


@query("f_protected_unless_key")
def _(m):
    return f"SELECT doc_id, family, count(*) AS n FROM {m.t('shielded')} AS p GROUP BY doc_id, family"


@query("f_absorbed")
def _(m):
    return f"""SELECT p.doc_id, {m.big('p.s')} AS s, {m.big('p.e')} AS e FROM {merged(m)} AS p WHERE NOT EXISTS (SELECT 1 FROM {m.t('events')} AS v WHERE v.doc_id = p.doc_id AND v.seg_start + v.s <= p.s AND v.seg_start + v.e >= p.e)"""


@query("g_chunks")
def _(m):
    """Groups of 25 in order of doc_id: rows are numbered within ranges of ids, ranges by what lies before them."""
    ranged = f"(SELECT doc_id, {m.big('floor(doc_id / 1024)')} AS span FROM {m.t('labels')})"
    before = f"(SELECT span, coalesce(sum(n) OVER (ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT span, count(*) AS n FROM {ranged} AS a GROUP BY span) AS c)"
    return f"SELECT r.doc_id, {m.int('floor((b.before + r.k - 1) / 25)')} AS chunk FROM (SELECT doc_id, span, row_number() OVER (PARTITION BY span ORDER BY doc_id) AS k FROM {ranged} AS x) AS r JOIN {before} AS b ON b.span = r.span"


@query("g_sequence")
def _(m):
    return f"""SELECT doc_id, seg_no, s, e, key, s - coalesce(lag(e) OVER (PARTITION BY doc_id, seg_no ORDER BY s), 0) AS gap FROM {m.t('events')}"""


@query("g_kwic")
def _(m):
    return f"""SELECT v.doc_id, v.seg_no, v.s, v.concept_id, count(*) AS around, {m.all_of('t.key', 't.tok_no', ' ')} AS words
      FROM {m.t('events')} AS v JOIN {m.t('tokens')} AS b ON b.doc_id = v.doc_id AND b.seg_no = v.seg_no AND b.s = v.s
      JOIN {m.t('tokens')} AS t ON t.doc_id = v.doc_id AND t.seg_no = v.seg_no AND t.tok_no BETWEEN b.tok_no - 4 AND b.tok_no + 4 AND t.tok_no <> b.tok_no
      WHERE t.key NOT IN (SELECT word FROM {m.t('stop_words')}) GROUP BY v.doc_id, v.seg_no, v.s, v.concept_id"""


@query("g_compound")
def _(m):
    return f"""SELECT doc_id, seg_no, {m.int(m.rx_count('line', '[A-Z][a-z]+ [A-Z][a-z]+'))} AS runs, {m.rx_get('line', '([A-Z][a-z]+( [A-Z][a-z]+)+)')} AS compound FROM {m.t('segments')} WHERE {m.rx('line', '[A-Z][a-z]+ [A-Z][a-z]+')}"""


@query("g_glosses")
def _(m):
    return f"""SELECT doc_id, seg_no, coalesce(nullif({m.rx_get('line', '[(]([a-z ]+)[)]')}, ''), nullif({m.rx_get('line', ', or ([a-z]+)')}, ''), nullif({m.rx_get('line', '([a-z]+) [|]')}, '')) AS gloss
      FROM {m.t('segments')} WHERE {m.rx('line', '[(][a-z ]+[)]|, or [a-z]+|[a-z]+ [|]')}"""


@query("g_lemma_candidates")
def _(m):
    base = f"(SELECT DISTINCT key FROM {m.t('tokens')} WHERE {m.rx('key', '(ies|es|s|ing|ed)$')})"
    return f"""SELECT DISTINCT key, lemma FROM (SELECT key, {m.rx_sub('key', 'ies$', 'y')} AS lemma FROM {base} AS b UNION ALL SELECT key, {m.rx_sub('key', '(es|s)$', '')} FROM {base} AS b UNION ALL SELECT key, {m.rx_sub('key', '(ing|ed)$', '')} FROM {base} AS b) AS x WHERE lemma <> key AND lemma <> ''"""


@query("j_auto_match")
def _(m):
    return f"SELECT doc_id, seg_no, seg_start + s AS start_at, seg_start + e AS end_at, key, concept_id, lang FROM {m.t('found')} WHERE mode = 'auto'"


@query("j_review_match")
def _(m):
    return f"SELECT doc_id, seg_no, s, e, key, owners FROM {m.t('found')} WHERE mode = 'review'"


@query("o_longest_match")
def _(m):
    return f"SELECT doc_id, seg_no, seg_start + s AS start_at, seg_start + e AS end_at, key, mode, concept_id, lang, owners FROM {m.t('events')}"


@query("j_concept_dim")
def _(m):
    return f"SELECT c.semantic_class, c.pos, count(*) AS n, count(DISTINCT v.doc_id) AS docs FROM {m.t('events')} AS v JOIN {m.t('concepts')} AS c ON v.concept_id = c.concept_id GROUP BY c.semantic_class, c.pos"


@query("f_forbidden")
def _(m):
    return f"SELECT doc_id, seg_no, s, e, concept_id FROM {m.t('blocked')}"


@query("f_scope")
def _(m):
    return f"SELECT concept_id FROM {m.t('concepts')} WHERE contexts LIKE '%logic%' OR contexts LIKE '%time%'"


@query("i_matcher_tables")
def _(m):
    return f"SELECT key, mode, concept_id, lang, owners FROM {m.t('matcher')}"


@query("i_registry")
def _(m):
    return f"""SELECT 'observed_not_review' AS rule, count(*) AS n FROM {m.t('forms')} WHERE kind = 'observed' AND policy <> 'review'
      UNION ALL SELECT 'pref_repeated', count(*) FROM (SELECT concept_id, lang FROM {m.t('forms')} WHERE kind = 'pref' GROUP BY concept_id, lang HAVING count(*) > 1) AS a
      UNION ALL SELECT 'form_repeated', count(*) FROM (SELECT concept_id, lang, lower(form) AS f FROM {m.t('forms')} GROUP BY concept_id, lang, lower(form) HAVING count(*) > 1) AS b
      UNION ALL SELECT 'no_form', count(*) FROM {m.t('concepts')} AS c WHERE c.concept_id NOT IN (SELECT concept_id FROM {m.t('forms')})
      UNION ALL SELECT 'bad_id', count(*) FROM {m.t('concepts')} WHERE NOT {m.rx('concept_id', '^[a-z]+([.][a-z_]+)+$')}"""


@query("i_violations")
def _(m):
    return f"""SELECT doc_id, CASE WHEN length(text) < 20 THEN 'minLength' WHEN lang NOT IN ('en', 'es') THEN 'enum' ELSE 'pattern' END AS rule FROM {m.t('documents')} WHERE length(text) < 20 OR lang NOT IN ('en', 'es') OR NOT {m.rx('source', '^src[0-9]$')}"""


@query("p_auto_surfaces")
def _(m):
    return f"""SELECT concept_id, lang, {m.all_of('form', "(CASE WHEN kind = 'pref' THEN 0 ELSE 1 END) * 100 + ord")} AS surfaces FROM {m.t('forms')} WHERE policy = 'auto' AND kind <> 'observed' GROUP BY concept_id, lang"""


@query("j_demote")
def _(m):
    return f"""SELECT DISTINCT a.concept_id, a.lang, a.form FROM {m.t('forms')} AS a JOIN {m.t('forms')} AS b ON a.lang = b.lang AND lower(a.form) = lower(b.form) AND a.concept_id <> b.concept_id
      JOIN {m.t('concepts')} AS ca ON ca.concept_id = a.concept_id JOIN {m.t('concepts')} AS cb ON cb.concept_id = b.concept_id
      WHERE {m.size(m.both("split(ca.contexts, ',')" if m.spark else "string_split(ca.contexts, ',')", "split(cb.contexts, ',')" if m.spark else "string_split(cb.contexts, ',')"))} > 0 OR a.policy = 'review'"""


@query("j_contested")
def _(m):
    return f"""SELECT a.concept_id, a.form, {m.set_of('b.concept_id')} AS others, CASE WHEN a.policy = 'review' THEN 'review' ELSE 'auto' END AS standing FROM {m.t('forms')} AS a JOIN {m.t('forms')} AS b ON lower(a.form) = lower(b.form) AND a.concept_id <> b.concept_id GROUP BY a.concept_id, a.form, a.policy"""


@query("j_inverse_edges")
def _(m):
    return f"SELECT r.one, r.other FROM {m.t('related')} AS r LEFT JOIN {m.t('related')} AS q ON r.one = q.other AND r.other = q.one WHERE q.one IS NULL"


@query("h_closure")
def _(m):
    return f"""WITH RECURSIVE reach(child, parent, depth) AS (SELECT child, parent, 1 FROM {m.t('broader')} UNION ALL SELECT r.child, b.parent, r.depth + 1 FROM reach AS r JOIN {m.t('broader')} AS b ON r.parent = b.child WHERE r.depth < 10)
      SELECT child, parent, min(depth) AS depth FROM reach GROUP BY child, parent"""


@query("h_cycles")
def _(m):
    return f"""WITH RECURSIVE reach(child, parent, depth) AS (SELECT child, parent, 1 FROM {m.t('broader')} UNION ALL SELECT r.child, b.parent, r.depth + 1 FROM reach AS r JOIN {m.t('broader')} AS b ON r.parent = b.child WHERE r.depth < 10)
      SELECT count(CASE WHEN child = parent THEN 1 END) AS cycles, count(*) AS pairs FROM reach"""


@query("h_link_guards")
def _(m):
    new = "(SELECT * FROM (VALUES ('core.of', 'core.in'), ('core.in', 'core.of'), ('core.as', 'core.as'), ('core.by', 'core.nowhere'), ('core.by', 'core.as')) AS v(child, parent))"
    return f"""SELECT n.child, n.parent, CASE WHEN n.child = n.parent THEN 'self' WHEN n.child NOT IN (SELECT concept_id FROM {m.t('concepts')}) OR n.parent NOT IN (SELECT concept_id FROM {m.t('concepts')}) THEN 'unknown'
      WHEN EXISTS (SELECT 1 FROM {m.t('broader')} AS b WHERE b.child = n.child AND b.parent = n.parent) THEN 'duplicate' WHEN EXISTS (SELECT 1 FROM {m.t('broader')} AS b WHERE b.child = n.parent AND b.parent = n.child) THEN 'inverse' ELSE 'ok' END AS verdict FROM {new} AS n"""


@query("a_duplicates")
def _(m):
    return f"SELECT {m.sha('text')} AS digest, count(*) AS n, min(doc_id) AS first FROM {m.t('documents')} GROUP BY text HAVING count(*) > 1"


@query("p_fold")
def _(m):
    return f"SELECT doc_id, {m.sha(T_FOLD.format('text'))} AS digest FROM {m.t('documents')}"


T_FOLD = "replace(lower({}), 'ß', 'ss')"


@query("p_ascii_fold")
def _(m):
    plain = m.rx_sub(f"translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}')", "[^\\x00-\\x7f]", "")
    return f"SELECT doc_id, length({plain}) AS points, {m.sha(plain)} AS digest FROM {m.t('documents')}"


def wide(m):
    """doc_id, seg_no, line, wide: bytes before the segment beyond its code points. Blank lines hold none: they are spaces."""
    return f"""(SELECT doc_id, seg_no, line, coalesce(sum({m.octets('line')} - length(line)) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wide FROM {m.t('segments')})"""


@query("p_byte_offsets")
def _(m):
    """Of all events: bytes before the segment and those of the line's beginning, so that no text is cut as a whole."""
    start, end = (m.big(f"v.seg_start + g.wide + {m.octets(f'substring(g.line, 1, {m.int(at)})')}") for at in ("v.s", "v.e"))
    return f"SELECT v.doc_id, v.seg_no, v.s, {start} AS byte_start, {end} AS byte_end FROM {m.t('events')} AS v JOIN {wide(m)} AS g ON g.doc_id = v.doc_id AND g.seg_no = v.seg_no"


@query("p_line_col")
def _(m):
    """Of all events; segments are numbered by lines, blank ones too."""
    return f"SELECT doc_id, seg_start + s AS start_at, seg_no + 1 AS line, s AS col FROM {m.t('events')}"


@query("p_sha256")
def _(m):
    return f"SELECT doc_id, {m.sha('text')} AS digest, substring({m.sha('text')}, 1, 16) AS short FROM {m.t('documents')}"


@query("p_occurrence_id")
def _(m):
    return f"SELECT doc_id, seg_no, s, concat('occ-', {m.sha('concat_ws(' + repr('|') + ', ' + m.text('doc_id') + ', ' + m.text('seg_no') + ', ' + m.text('s') + ', key)')}) AS occurrence_id FROM {m.t('events')} WHERE mode = 'review'"


@query("k_registry_summary")
def _(m):
    return f"SELECT mode, count(*) AS n FROM {m.t('matcher')} GROUP BY mode"


@query("k_digest")
def _(m):
    return f"SELECT c.concept_id, substring(c.definition, 1, 20) AS short, {m.set_of('f.form')} AS surfaces FROM {m.t('concepts')} AS c JOIN {m.t('forms')} AS f ON c.concept_id = f.concept_id WHERE c.contexts LIKE '%core%' GROUP BY c.concept_id, c.definition"


@query("k_next_number")
def _(m):
    return f"SELECT coalesce(max(ord), -1) + 1 AS next, count(*) AS n FROM {m.t('forms')}"
