"""A small governed lexicon in English and Spanish; each surface belongs to a concept, a language and a policy.

Tables are plain Python rows, so that they can become DataFrames or VALUES lists of SQL alike. ``shared`` marks a
surface that belongs to no single language.
"""

from __future__ import annotations

#: concept_id, semantic_class, pos, definition, contexts (by comma), authority
CONCEPTS = [
    ("core.the", "entity", "determiner", "marks a definite entity that is known", "core,grammar", "ISO-1"),
    ("core.of", "relation", "preposition", "links a part to its whole", "core,grammar", "ISO-1"),
    ("core.of_the", "relation", "preposition", "links a part to its definite whole", "core,grammar", "ISO-2"),
    ("core.and", "operator", "conjunction", "joins two parts of one kind", "core", "ISO-1"),
    ("core.and_the", "operator", "conjunction", "joins a definite part of one kind", "core", "ISO-3"),
    ("core.in", "property", "preposition", "inside a place or time", "core,place", "ISO-1"),
    ("core.be", "action", "verb", "has a state or identity", "core", "ISO-4"),
    ("core.to", "action", "particle", "moves toward a place or goal", "core,place", "ISO-4"),
    ("core.to_the", "action", "particle", "moves toward a definite place or goal", "core,place", "ISO-4"),
    ("core.that", "actor", "pronoun", "the one pointed at from afar", "core", "ISO-5"),
    ("core.it", "actor", "pronoun", "the one spoken of before", "core", "ISO-5"),
    ("core.for", "condition", "preposition", "holds in case of a purpose", "logic", "ISO-6"),
    ("core.with", "quantity", "preposition", "in the company of some number", "core", "ISO-6"),
    ("core.not", "polarity", "adverb", "denies what follows", "logic", "ISO-7"),
    ("core.by", "temporal", "preposition", "before or at a time", "time", "ISO-8"),
    ("core.after", "temporal", "preposition", "after or at a time", "time", "ISO-8"),
    ("core.as", "modality", "adverb", "in the role or manner of", "logic", "ISO-7"),
    ("core.this", "entity", "determiner", "the one pointed at from near", "core", "ISO-5"),
    ("core.a", "entity", "determiner", "marks an entity that is not known", "core,grammar", "ISO-1"),
    ("core.on", "property", "preposition", "upon a place or surface", "place", "ISO-9"),
    ("core.about", "property", "preposition", "upon a matter or topic", "topic", "ISO-9"),
    ("core.was", "action", "verb", "had a state or identity", "time", "ISO-4"),
    ("core.has", "action", "verb", "owns a state or thing", "core", "ISO-4"),
    ("core.se", "actor", "pronoun", "the one acting on itself", "grammar", "ISO-5"),
]

#: concept_id, lang, form, kind, policy, ord
FORMS = [
    ("core.the", "en", "the", "pref", "auto", 0), ("core.the", "es", "el", "pref", "auto", 0), ("core.the", "es", "la", "alt", "auto", 1), ("core.the", "es", "los", "alt", "auto", 2),
    ("core.of", "en", "of", "pref", "auto", 0), ("core.of", "es", "de", "pref", "auto", 0),
    ("core.of_the", "en", "of the", "pref", "auto", 0), ("core.of_the", "es", "de la", "pref", "auto", 0), ("core.of_the", "es", "del", "alt", "auto", 1),
    ("core.and", "en", "and", "pref", "auto", 0), ("core.and", "es", "y", "pref", "auto", 0),
    ("core.and_the", "en", "and the", "pref", "auto", 0), ("core.and_the", "es", "y el", "pref", "auto", 0),
    ("core.in", "en", "in", "pref", "auto", 0), ("core.in", "es", "en", "pref", "auto", 0), ("core.in", "en", "in the", "observed", "review", 1),
    ("core.be", "en", "is", "pref", "auto", 0), ("core.be", "en", "be", "alt", "auto", 1), ("core.be", "en", "are", "alt", "auto", 2), ("core.be", "es", "es", "pref", "auto", 0),
    ("core.to", "en", "to", "pref", "auto", 0), ("core.to", "es", "al", "pref", "auto", 0), ("core.to_the", "en", "to the", "pref", "auto", 0),
    ("core.that", "en", "that", "pref", "auto", 0), ("core.that", "es", "que", "pref", "auto", 0),
    ("core.it", "en", "it", "pref", "auto", 0), ("core.it", "es", "ello", "pref", "auto", 0),
    ("core.for", "en", "for", "pref", "auto", 0), ("core.for", "es", "para", "pref", "auto", 0),
    ("core.with", "en", "with", "pref", "auto", 0), ("core.with", "es", "con", "pref", "auto", 0),
    ("core.not", "en", "not", "pref", "auto", 0), ("core.not", "es", "nunca", "pref", "auto", 0), ("core.not", "shared", "no", "alt", "auto", 1),
    ("core.by", "en", "by", "pref", "auto", 0), ("core.by", "es", "por", "pref", "auto", 0),
    ("core.after", "en", "after", "pref", "auto", 0), ("core.after", "es", "tras", "pref", "auto", 0),
    ("core.as", "en", "as", "pref", "auto", 0), ("core.as", "es", "su", "pref", "auto", 0),
    ("core.this", "en", "this", "pref", "auto", 0), ("core.this", "es", "un", "pref", "auto", 0), ("core.this", "es", "una", "alt", "auto", 1),
    ("core.a", "shared", "a", "pref", "auto", 0),
    ("core.on", "en", "on", "pref", "review", 0), ("core.about", "en", "on", "hidden", "review", 1), ("core.about", "en", "about", "pref", "auto", 0), ("core.on", "es", "sobre", "pref", "auto", 0),
    ("core.was", "en", "was", "pref", "auto", 0), ("core.was", "es", "era", "pref", "auto", 0), ("core.be", "en", "was", "observed", "review", 3),
    ("core.has", "en", "has", "pref", "auto", 0), ("core.has", "es", "ha", "pref", "auto", 0),
    ("core.se", "es", "se", "pref", "auto", 0), ("core.it", "es", "se", "alt", "auto", 1),
]

#: source, target of broader edges; symmetric pairs of related ones
BROADER = [("core.of_the", "core.of"), ("core.and_the", "core.and"), ("core.to_the", "core.to"), ("core.of", "core.in"), ("core.was", "core.be"), ("core.this", "core.the"), ("core.a", "core.the")]
RELATED = [("core.that", "core.this"), ("core.by", "core.after"), ("core.on", "core.about")]
#: concept_id, lang, phrase
FORBIDDEN = [("core.of", "en", "of of"), ("core.in", "en", "in and"), ("core.be", "en", "to be"), ("core.not", "shared", "no no"), ("core.that", "es", "de que")]
#: Words that hint at a language by themselves.
FUNCTION_WORDS = [("en", w) for w in ("the", "of", "and", "to", "is", "that", "it", "for", "was", "with", "by", "this", "not", "are")] + [("es", w) for w in ("de", "la", "que", "el", "los", "se", "del", "un", "con", "su", "una", "para", "por", "las")]
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "it", "de", "la", "que", "el", "en", "der", "die", "und", "le", "les", "des", "et"]
ANTONYMS = [("before", "after"), ("near", "afar"), ("known", "unknown"), ("part", "whole")]
#: Words that no term ends with; verbs without which a clause has none; words that join parts or point back.
DANGLING = ["of", "the", "in", "on", "at", "to", "for", "and", "or", "a", "an", "de", "del", "la", "el", "los", "las", "en", "con", "por", "para", "y", "o", "un", "una", "al"]
COPULAS = ["is", "are", "was", "were", "es", "son", "era", "eran", "fue"]
HEDGES = ["and", "or", "it", "this", "these", "those", "they", "them", "y", "o", "se", "ello", "esto", "estos", "ellos"]
#: Longest automatic surface, in tokens.
LONGEST = 3

TABLES: dict[str, tuple[list[str], list[tuple]]] = {
    "concepts": (["concept_id", "semantic_class", "pos", "definition", "contexts", "authority"], CONCEPTS),
    "forms": (["concept_id", "lang", "form", "kind", "policy", "ord"], FORMS),
    "broader": (["child", "parent"], BROADER),
    "related": (["one", "other"], RELATED),
    "forbidden": (["concept_id", "lang", "phrase"], FORBIDDEN),
    "function_words": (["lang", "word"], FUNCTION_WORDS),
    "stop_words": (["word"], [(w,) for w in STOP_WORDS]),
    "antonyms": (["one", "other"], ANTONYMS),
    "dangling": (["word"], [(w,) for w in DANGLING]),
    "copulas": (["word"], [(w,) for w in COPULAS]),
    "hedges": (["word"], [(w,) for w in HEDGES]),
}


def values(rows: list[tuple], names: list[str]) -> str:
    """The rows as a SELECT from VALUES that Spark and DuckDB both take."""

    def one(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({', '.join(names)})"
