"""Word weights and summaries of one text.

Small functions on the words of a single text, run on Arrow batches where the
text is: nothing is exploded, shuffled or sorted beyond one text's own words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults
from .text import split_sentences

# Word pattern of the word-cloud weights: a letter/digit/underscore followed
# by at least one more such character or apostrophe (Unicode-aware).
WORD_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"
TERM_TOKEN = r"[\p{L}\p{N}]+"
# The same in Python, whose \w is a letter, a digit or '_'.
_WORD, _TERM, _SPACED = re.compile(r"\w[\w']+"), re.compile(r"[^\W_]+"), re.compile(r"[^ \t\n\x0b\f\r]+")
_STOP = frozenset(defaults.STOP_WORDS)
#: Bytes of text whose words are Python objects at a time; a longer text is alone.
SLICE_BYTES = 1 << 20


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of neighbouring rows of a text column, up to ``most`` bytes together."""
    start = held = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if held and held + n > most or k - start >= 1000:
            yield start, k - start
            start, held = k, 0
        held += n
    if start < len(column):
        yield start, len(column) - start


def _word(w: str) -> tuple[str, str] | None:
    """(word, key) of a token, a trailing "'s" removed; None for a number."""
    if w.endswith(("'s", "'S")):
        w = w[:-2]
    if w.isdigit() if w.isascii() else all(c.isnumeric() and not c.isalpha() for c in w):
        return None
    return w, w.lower()


def _folded(forms: dict[str, dict[str, int]]) -> tuple[dict[str, list], dict[str, str]]:
    """(folded key -> [count, term], plural key -> folded key) of the spellings of
    every key: one that ends in 's' (not 'ss') counts for its stem where that
    occurs, its spellings losing their last character.  The term is the most
    frequent spelling (ties: the larger)."""
    fold = {k: k[:-1] for k in forms if k[-1:] == "s" and k[:-1] in forms and k[-2:] != "ss"}
    for plural, stem in fold.items():
        to = forms[stem]
        for w, n in forms.pop(plural).items():
            to[w[:-1]] = to.get(w[:-1], 0) + n
    groups = {}
    for key, spelled in forms.items():
        if len(spelled) == 1:
            (w, n), = spelled.items()
            groups[key] = [n, w]
        else:
            groups[key] = [sum(spelled.values()), max((n, w) for w, n in spelled.items())[1]]
    return groups, fold


def _llr(k: float, n: float, x: float) -> float:
    return k * math.log(max(x, 1e-10)) + (n - k) * math.log(max(1.0 - x, 1e-10))


def _score(c12: float, c1: float, c2: float, n: float) -> float:
    """-2 log lambda for a bigram, as ``operators.text.collocation_score``."""
    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1) if n - c1 > 0 else 0.0
    return -2.0 * (_llr(c12, c1, p) + _llr(c2 - c12, n - c1, p) - _llr(c12, c1, p1) - _llr(c2 - c12, n - c1, p2))


def word_weights(text: str | None, collocations: bool = False, threshold: float = defaults.COLLOCATION_THRESHOLD) -> list[tuple[int, str]]:
    """A12 (+ L06) of one text: (-count, term), heaviest first."""
    tokens = _WORD.findall(text or "")
    counts = Counter(tokens)
    known = {w: (w, w.lower()) if w.isalpha() else _word(w) for w in counts}
    forms = {}
    for token, n in counts.items():
        if (told := known[token]) and told[1] not in _STOP:
            spelled = forms.setdefault(told[1], {})
            spelled[told[0]] = spelled.get(told[0], 0) + n
    words, fold = _folded(forms)
    if not collocations:
        return sorted([(-n, term) for n, term in words.values()])
    told = [x for x in map(known.get, tokens) if x]
    pairs = {}
    for ((w, key), (w2, key2)), n in Counter(zip(told, told[1:])).items():
        if key not in _STOP and key2 not in _STOP:
            pairs.setdefault(f"{key} {key2}", {})[f"{w} {w2}"] = n
    total = sum(n for n, _ in words.values())
    found, left = [], {k: n for k, (n, _) in words.items()}
    for n, term in _folded(pairs)[0].values():
        fk1, fk2 = (fold.get(k, k) for k in term.lower().split(" "))
        if fk1 in words and fk2 in words and _score(n, words[fk1][0], words[fk2][0], total) > threshold:
            found.append((-n, term))
            left[fk1] -= n
            left[fk2] -= n
    return sorted([(-n, words[k][1]) for k, n in left.items() if n > 0] + found)


def weight_rows(batches: Iterator[pa.RecordBatch], collocations: bool, threshold: float, max_words: int | None) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, term, n, weight, rank)."""
    for batch in batches:
        for start, n in slices(batch.column(1)):
            part = batch.slice(start, n)
            found = [word_weights(text, collocations, threshold)[:max_words] for text in part.column(1).to_pylist()]
            sizes = np.array([len(f) for f in found])
            firsts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            counts = -np.array([c for f in found for c, _ in f], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.repeat(np.arange(n), sizes))), pa.array([t for f in found for _, t in f], pa.string()), pa.array(counts),
                 pa.array(np.floor(counts / counts[firsts] * 1e6 + 0.5) / 1e6), pa.array(np.arange(len(counts)) - firsts + 1)],
                names=[part.schema.names[0], "term", "n", "weight", "rank"])


def top_terms(text: Column, k: int) -> Column:
    """The ``k`` heaviest terms of a text, in order; none for null."""
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([[t for _, t in word_weights(x)[:k]] for x in texts.slice(a, n).to_pylist()], pa.list_(pa.string()))
                                 for a, n in slices(texts)] or [pa.array([], pa.list_(pa.string()))])
    return run(F.make_valid_utf8(text))


def summarized(sentences: list[str] | None, budget: int | None, terms: list[list[str]] | None = None) -> dict | None:
    """T03 of the stripped sentences of a text, with their terms where these are given."""
    found = []
    for k, s in enumerate(sentences or []):
        if s:
            found.append((k, len(_SPACED.findall(s)), [w for w in _TERM.findall(s.lower()) if w not in _STOP] if terms is None else terms[k]))
    if not found:
        return None
    counts = Counter(w for _, _, ws in found for w in ws)
    total = sum(counts.values())
    share = {w: n / total for w, n in counts.items()}
    scored = sorted((-math.floor((sum([share[w] for w in ws]) / len(ws) if ws else 0.0) * 1e6 + 0.5) / 1e6, k, n) for k, n, ws in found)
    running, chosen = 0, []
    for _, k, n in scored:
        running += n
        if chosen and (budget is None or running > budget):
            break
        chosen.append(k)
    return {"summary": ". ".join(sentences[k] for k in sorted(chosen)) + ".", "n_sentences": len(chosen)}


def summary(text: Column, budget: Column, stops: Column | None = None) -> Column:
    """T03 of a text: (summary, n_sentences), null without a sentence; ``stops`` is a
    set of stop words in the place of the built-in one."""
    told = pa.struct([("summary", pa.string()), ("n_sentences", pa.int64())])

    @F.arrow_udf("struct<summary string, n_sentences long>")
    def run(texts: pa.Array, sentences: pa.Array, budgets: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(map(summarized, *(c.slice(a, n).to_pylist() for c in (sentences, budgets, terms))), told)
                                 for a, n in slices(texts)] or [pa.array([], told)])
    found = split_sentences(F.make_valid_utf8(text))
    terms = F.lit(None).cast("array<array<string>>") if stops is None else F.transform(
        found, lambda s: F.filter(F.regexp_extract_all(F.lower(s), F.lit(TERM_TOKEN), F.lit(0)), lambda w: ~F.array_contains(stops, w)))
    return run(F.make_valid_utf8(text), found, budget.cast("long"), terms)
