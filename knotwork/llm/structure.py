"""Per-document text statistics and a verdict on structure: natural prose or lists, tables and junk.

A text is read in stretches of some twenty to forty tokens, in line order. The tokens of a stretch fall
into classes (function words by kind, other words, numbers, sentence marks, commas, marks of structure);
their distribution is compared with prose profiles of each language and with profiles of lists, tables,
records, references, dumps, numbers and strings of words by Jensen-Shannon divergence, and the nearest profile
names the stretch. A document is no prose if most of its characters stand in such stretches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm.text import FUNCTION_WORDS

LANGUAGES = tuple(FUNCTION_WORDS)
#: word -> {language position: kind}
_KNOWN: dict[str, dict[int, int]] = {}
for _at, _lists in enumerate(FUNCTION_WORDS.values()):
    for _kind, _words in enumerate(_lists):
        for _word in _words.split():
            _KNOWN.setdefault(_word, {}).setdefault(_at, _kind)

#: Classes of tokens: five kinds of function words, other words, letters that no word could be, numbers, sentence marks, commas and the like, marks of structure.
CLASSES = ("article", "preposition", "conjunction", "pronoun", "auxiliary", "word", "garbled", "number", "sentence", "pause", "mark")
N_FUNCTION = 5
# Typical shares of the classes. A language's prose profile has its function words in these shares.
PROSE = {
    "en": (0.13, 0.12, 0.04, 0.02, 0.05, 0.50, 0.00, 0.04, 0.05, 0.04, 0.01),
    "de": (0.08, 0.12, 0.03, 0.02, 0.06, 0.56, 0.00, 0.04, 0.05, 0.03, 0.01),
    "fr": (0.11, 0.11, 0.03, 0.02, 0.05, 0.52, 0.00, 0.05, 0.05, 0.03, 0.03),
    "es": (0.10, 0.11, 0.04, 0.02, 0.05, 0.56, 0.00, 0.04, 0.05, 0.02, 0.01),
}
STRUCTURES = {
    "word string": (0.00, 0.01, 0.00, 0.00, 0.00, 0.90, 0.00, 0.00, 0.08, 0.01, 0.00),
    "menu": (0.00, 0.06, 0.00, 0.00, 0.00, 0.92, 0.00, 0.01, 0.00, 0.00, 0.01),
    "enumeration": (0.00, 0.01, 0.00, 0.00, 0.00, 0.58, 0.00, 0.01, 0.00, 0.40, 0.00),
    "list": (0.01, 0.02, 0.00, 0.00, 0.00, 0.65, 0.00, 0.03, 0.01, 0.06, 0.22),
    "record": (0.00, 0.01, 0.00, 0.00, 0.00, 0.55, 0.00, 0.10, 0.00, 0.02, 0.32),
    "table": (0.00, 0.05, 0.00, 0.00, 0.00, 0.42, 0.00, 0.08, 0.00, 0.00, 0.45),
    "columns": (0.00, 0.00, 0.00, 0.00, 0.00, 0.60, 0.00, 0.36, 0.02, 0.02, 0.00),
    "separated values": (0.00, 0.00, 0.00, 0.00, 0.00, 0.34, 0.00, 0.25, 0.01, 0.40, 0.00),
    "contents": (0.00, 0.00, 0.00, 0.00, 0.00, 0.38, 0.00, 0.31, 0.31, 0.00, 0.00),
    "references": (0.01, 0.01, 0.00, 0.00, 0.00, 0.46, 0.00, 0.09, 0.22, 0.11, 0.10),
    "code": (0.01, 0.01, 0.00, 0.00, 0.00, 0.30, 0.02, 0.08, 0.01, 0.08, 0.49),
    "markup": (0.06, 0.00, 0.00, 0.00, 0.00, 0.34, 0.06, 0.02, 0.00, 0.00, 0.52),
    "log": (0.01, 0.03, 0.00, 0.00, 0.00, 0.35, 0.02, 0.34, 0.02, 0.02, 0.21),
    "numbers": (0.00, 0.00, 0.00, 0.00, 0.00, 0.02, 0.02, 0.94, 0.01, 0.01, 0.00),
    "dump": (0.01, 0.01, 0.00, 0.00, 0.00, 0.05, 0.29, 0.64, 0.00, 0.00, 0.00),
    "characters": (0.00, 0.00, 0.00, 0.00, 0.00, 0.10, 0.70, 0.02, 0.02, 0.06, 0.10),
    "marks": (0.00, 0.00, 0.00, 0.00, 0.00, 0.03, 0.03, 0.02, 0.10, 0.10, 0.72),
}
NAMES = tuple(f"prose:{lang}" for lang in PROSE) + tuple(STRUCTURES)
_PROFILES = np.array([*PROSE.values(), *STRUCTURES.values()]) + 0.002
_PROFILES /= _PROFILES.sum(axis=1, keepdims=True)

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
SENTENCE, PAUSE = frozenset(".!?…。"), frozenset(",;:，、；()«»„“”\"'’‘-–—>¿¡")
STRETCH, LONG = 20, 60
_V = "aeiouyáàâäãåéèêëíìîïóòôöõúùûüæœøýÿı"
_NO_WORD = re.compile(rf"^(?:[^{_V}]{{3,}}|.*[^{_V}]{{6}}.*|(?=.{{7}})[^{_V}]*[{_V}][^{_V}]{{5,}})$")
#: A structural profile needs few function words among the words, many marks among the tokens, or few words at all.
FEW_FUNCTION, MANY_MARKS, MOST_WORDS = 0.18, 0.3, 0.55
#: At least so many lines of fewer than so many tokens on average are no wrapped prose.
STACKED_LINES, STACKED_WORDS = 5, 3
CITATION = re.compile(r"\[P\d+\.E\d+\]")
_DIGIT = re.compile(r"\d")
_OPENERS = re.compile(r"^\s*(?:[*•·+-]\s|\d+[.)]\s|\|)")

SCHEMA = (
    "key bigint, n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, upper_ratio double, "
    "punctuated_lines double, bullet_lines double, common_words double, distinct_words double, language string, divergence double, profile string, nonprose_share double"
)
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


_SEEN: dict[str, bool] = {}


def _garbled(word: str) -> bool:
    """Letters that no word of these languages could be: no vowel at all, or six consonants in a row."""
    known = _SEEN.get(word)
    if known is None:
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        known = _SEEN[word] = len(word) >= 3 and word[0] <= "ɏ" and _NO_WORD.match(word) is not None
    return known


def _stretches(text: str) -> list[str]:
    out, held, n = [], [], 0
    for line in text.split("\n"):
        if not line.strip():
            continue
        tokens = line.count(" ") + line.count("\t") + 1
        if tokens > LONG:
            if held:
                out.append("\n".join(held))
                held, n = [], 0
            parts = re.split(r"(\s+)", line)
            step = 2 * (LONG - STRETCH)
            pieces = ["".join(parts[i : i + step]) for i in range(0, len(parts), step)]
            if len(pieces) > 1 and len(pieces[-1].split()) < STRETCH:
                last = pieces.pop()
                pieces[-1] += last
            out += pieces
            continue
        held.append(line)
        n += tokens
        if n >= STRETCH:
            out.append("\n".join(held))
            held, n = [], 0
    if held:
        if out and n < STRETCH // 2:
            out[-1] += "\n" + "\n".join(held)
        else:
            out.append("\n".join(held))
    return out


def _counts(stretch: str) -> tuple[list[int], int, str]:
    """Class counts of a stretch in the language with most function words; function words; the language."""
    counts = [0] * len(CLASSES)
    words: Counter = Counter()
    for token in TOKEN.findall(CITATION.sub(" ", stretch).lower()):
        first = token[0]
        if first.isalpha() or first.isdigit():
            if token.isalpha():
                words[token] += 1
            else:
                counts[7] += 1
        elif first in SENTENCE:
            counts[8] += 1
        elif first in PAUSE:
            counts[9] += 1
        else:
            counts[10] += 1
    hits, known = [0] * len(LANGUAGES), []
    for w, n in words.items():
        kinds = _KNOWN.get(w)
        if kinds is None:
            counts[6 if _garbled(w) else 5] += n
        else:
            known.append((n, kinds))
            for at in kinds:
                hits[at] += n
    best = max(hits)
    at = hits.index(best)
    for n, kinds in known:
        counts[kinds.get(at, 5)] += n
    return counts, best, LANGUAGES[at]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits between each row of ``p`` and each row of ``q``."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=2)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=2)
    return (left + right) / 2


def describe(keys: list, texts: list[str | None]) -> pa.Table:
    rows: dict[str, list] = {f: [] for f in _FIELDS}
    counts, owner, sizes, langs, stacked = [], [], [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\W_]+", text)
        lower = [w.lower() for w in words]
        lines = [x for x in text.split("\n") if x.strip()]
        letters = sum(map(len, words))
        solid = len("".join(text.split()))
        common = 0
        for stretch in _stretches(text):
            c, n_function, lang = _counts(stretch)
            counts.append(c)
            owner.append(i)
            sizes.append(len("".join(stretch.split())))
            langs.append(lang)
            n_lines = stretch.count("\n") + 1
            stacked.append(n_lines >= STACKED_LINES and len(stretch.split()) < STACKED_WORDS * n_lines)
            common += n_function
        n = max(1, len(words))
        for name, value in (
            ("key", keys[i]), ("n_chars", len(text)), ("n_words", len(words)), ("n_lines", len(lines)), ("mean_word_length", letters / n),
            ("symbol_ratio", (solid - letters) / max(1, solid)), ("digit_ratio", len(_DIGIT.findall(text)) / max(1, solid)), ("upper_ratio", sum(map(str.isupper, text)) / max(1, letters)),
            ("punctuated_lines", sum(x.rstrip()[-1:] in ".!?…:;\"'»”" for x in lines) / max(1, len(lines))), ("bullet_lines", sum(bool(_OPENERS.match(x)) for x in lines) / max(1, len(lines))),
            ("common_words", common / n), ("distinct_words", len(set(lower)) / n),
        ):
            rows[name].append(value)
    n_docs = len(texts)
    odd, whole = np.zeros(n_docs), np.zeros(n_docs)
    kind = [Counter() for _ in range(n_docs)]
    tongue = [Counter() for _ in range(n_docs)]
    far = np.zeros(n_docs)
    if counts:
        shares = np.array(counts, dtype=float)
        shares /= np.maximum(1, shares.sum(axis=1, keepdims=True))
        js = divergence(shares, _PROFILES)
        nearest = js.argmin(axis=1)
        function = shares[:, :N_FUNCTION].sum(axis=1)
        worded = function + shares[:, N_FUNCTION : N_FUNCTION + 2].sum(axis=1)
        fluent = (function >= FEW_FUNCTION * worded) & (shares[:, -1] < MANY_MARKS) & (worded >= MOST_WORDS)
        nearest = np.where(fluent, js[:, : len(PROSE)].argmin(axis=1), nearest)
        nearest = np.where(stacked, len(PROSE) + js[:, len(PROSE) :].argmin(axis=1), nearest)
        for s, i in enumerate(owner):
            whole[i] += sizes[s]
            odd[i] += sizes[s] * (nearest[s] >= len(PROSE))
            kind[i][NAMES[nearest[s]]] += sizes[s]
            tongue[i][langs[s]] += sizes[s]
            far[i] += sizes[s] * js[s, : len(PROSE)].min()
    top = lambda c: min(c, key=lambda x: (-c[x], x)) if c else None
    rows["language"] = [top(c) for c in tongue]
    rows["divergence"] = list(far / np.maximum(1, whole))
    rows["profile"] = [top(c) for c in kind]
    rows["nonprose_share"] = [float(o / w) if w else None for o, w in zip(odd, whole)]
    types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.table({f: pa.array(rows[f], types[kind_]) for f, kind_ in (x.split() for x in SCHEMA.split(", "))})


def statistics(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row per input row, ``key`` and the columns of ``SCHEMA``.

    Null, empty and blank texts have zero counts and null ``language``, ``profile`` and ``nonprose_share``. Repeated
    rows are described each time; very long texts whole. An empty table gives an empty result; only the key (a whole
    number, which may be null) and the text are read, and no row needs another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield from describe(part["key"].to_pylist(), part["txt"].to_pylist()).to_batches()

    return df.select(df[key].cast("bigint").alias("key"), df[field].alias("txt")).mapInArrow(run, SCHEMA).withColumnRenamed("key", key)
