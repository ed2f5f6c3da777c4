"""Tokenizers, normalisers and parsers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.functions.exprs import let

# Fixed values of the text rules.
STOP_WORDS = ("a", "an", "and", "for", "from", "is", "of", "the", "to", "what", "which", "who")
ARTICLES = ("a", "an", "the")
MENTION_STOP = ("the", "is", "of", "a", "an", "in", "to", "for", "are", "was", "were", "and")
AGGREGATION_PHRASES = (
    "how many", "number of", "count of", "total number", "amount of", "list all", "list the", "name all", "name the", "who are all", "which are all", "what are all", "all the",
    "children of", "children did", "kids did", "spouses of", "spouses did", "wives did", "wives of", "sons of", "sons did", "daughters of", "daughters did", "who were the",
)
AGGREGATION = r"\b(" + "|".join(AGGREGATION_PHRASES) + r")\b"


def _among(x: Column, words: tuple[str, ...]) -> Column:
    return x.isin(*words)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text; everything else separates."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    return F.filter(ascii_tokens(text), lambda t: ~_among(t, STOP_WORDS))


def answer_key(text: Column) -> Column:
    """Lower-case tokens without articles."""
    return F.array_join(F.filter(tokens(text), lambda t: ~_among(t, ARTICLES)), " ")


def answer_text(text: Column) -> Column:
    """Lower case, padding marks as blanks, ASCII punctuation deleted, articles dropped."""
    bare = F.regexp_replace(F.replace(F.lower(text), F.lit("<pad>"), F.lit(" ")), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda t: (t != "") & ~_among(t, ARTICLES)), " ")


def compact_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def mention_key(text: Column) -> Column:
    """Content words of at least two characters, empty for more than four."""
    words = F.filter(ascii_tokens(text), lambda t: (F.length(t) >= 2) & ~_among(t, MENTION_STOP))
    return let(words, lambda w: F.when(F.size(w) <= 4, F.array_join(w, " ")).otherwise(""))


def split_distinct(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != ""))


def entity_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\bQ[0-9]+\b"), F.lit(0))


def citation_labels(text: Column) -> Column:
    """Distinct ``P<n>.E<n>`` and ``S<n>`` labels in order, without their brackets."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(P[0-9]+\.E[0-9]+|S[0-9]+)\]"), F.lit(1)))


def ngrams(words: Column, longest: int) -> Column:
    """All n-grams of 1 to ``longest`` words, longest first."""

    def of(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return let(words, lambda w: F.concat(*[of(w, n) for n in range(longest, 0, -1)]))


def mentions(question: Column, ascii_only: bool = False) -> Column:
    """Distinct lower-case mention candidates: n-grams of all words, then of the content words."""
    part = "[a-z0-9]+" if ascii_only else r"[\p{L}\p{N}]+"
    raw = F.regexp_extract_all(F.lower(F.replace(question, F.lit("’"), F.lit("'"))), F.lit(f"{part}(?:'{part})?"), F.lit(0))
    content = F.filter(raw, lambda t: (F.length(t) >= 2) & ~_among(t, STOP_WORDS))
    both = F.concat(ngrams(raw, 5), ngrams(content, 4))
    return F.array_distinct(F.filter(both, lambda m: (F.length(m) >= 2) & ~_among(m, MENTION_STOP)))


def shorten(text: Column, limit: int) -> Column:
    return F.rtrim(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit))


def literal_list(text: Column) -> Column:
    """``['a', 'b']`` as an array; a bare value as an array of one."""
    bare = F.trim(text)
    inner = F.transform(F.split(F.regexp_replace(bare, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return F.when(bare.startswith("["), F.filter(inner, lambda x: x != "")).when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))


def premises(grounding: Column) -> Column:
    """Triples ``h|r|t`` before the arrow."""
    triples = F.split(F.get(F.split(grounding, "=>"), F.lit(0)), r"\|")
    parts = F.transform(triples, lambda t: F.filter(F.split(F.trim(t), r"\s+"), lambda x: x != ""))
    return F.transform(F.filter(parts, lambda p: F.size(p) >= 3), lambda p: F.array_join(F.slice(p, 1, 3), "|"))


def conclusion(grounding: Column) -> Column:
    """The last token after the arrow, null without one."""
    after = F.get(F.split(grounding, "=>"), F.lit(1))
    return F.element_at(F.filter(F.split(F.trim(after), r"\s+"), lambda x: x != ""), -1)


def embedding_text(name: Column, aliases: Column, descr: Column) -> Column:
    """Name, up to eight aliases and the first 300 characters of the description."""
    known = F.when(F.size(aliases) > 0, F.concat(F.lit(" Also known as: "), F.array_join(F.slice(aliases, 1, 8), ", "))).otherwise("")
    return F.concat(name, known, F.when(descr != "", F.concat(F.lit(". "), F.substring(descr, 1, 300))).otherwise(""))


def any_of(col: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(p) for p in parts])
