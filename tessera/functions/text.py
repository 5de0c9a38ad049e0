"""Scalar text functions: Column -> Column, all JVM-side built-ins.

These are the small building blocks the operators share (word counts,
trimming, sentence splitting, answer cleaning, prompt templates, ...).
None of them leaves whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults

ColumnOrName = Column | str

# Python's str.strip()/split() treat newlines and tabs as whitespace; Spark's
# trim() only removes spaces, so a regex is used everywhere instead.
WS_EDGES = r"^\s+|\s+$"
WS_RUN = r"\s+"


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c: ColumnOrName) -> Column:
    """remove leading/trailing whitespace including newlines and tabs."""
    return F.regexp_replace(_c(c), WS_EDGES, "")


def words(c: ColumnOrName) -> Column:
    """Whitespace-separated words (array), without empty strings."""
    return F.filter(F.split(_c(c), WS_RUN), lambda w: w != "")


def word_count(c: ColumnOrName) -> Column:
    """Number of whitespace-separated words."""
    return F.size(words(c)).cast("long")


def truncate_chars(c: ColumnOrName, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(c), 1, n)


def normalize_question(c: ColumnOrName) -> Column:
    """lower-cased lookup key (question marks kept, as in a dict lookup)."""
    return F.lower(_c(c))


def drop_question_marks(c: ColumnOrName) -> Column:
    """every '?' removed."""
    return F.replace(_c(c), F.lit("?"), F.lit(""))


def split_sentences(c: ColumnOrName) -> Column:
    """split on every '.', each piece stripped (empty pieces kept)."""
    return F.transform(F.split(_c(c), r"\."), strip_ws)


def first_line(c: ColumnOrName) -> Column:
    """text before the first newline."""
    return F.substring_index(_c(c), "\n", 1)


def first_sentence(c: ColumnOrName) -> Column:
    """Text before the first '.'."""
    return F.substring_index(_c(c), ".", 1)


def strip_speaker(c: ColumnOrName, prefix: str) -> Column:
    """remove every occurrence of ``prefix`` then strip."""
    return strip_ws(F.replace(_c(c), F.lit(prefix), F.lit("")))


def contains_any(c: ColumnOrName, keywords: Iterable[str]) -> Column:
    """true when any keyword is a substring of ``c`` (null stays null).

    One regular expression finds all keywords in one pass over the string; its
    alternatives share their beginnings, so a character is compared with the
    few ways on, not with every keyword."""
    col = _c(c)
    kws = set(keywords)
    if not kws:
        return F.lit(False)
    return F.when(col.isNotNull(), F.lit(True)) if "" in kws else col.rlike(any_of(kws))


def any_of(words_: Iterable[str]) -> str:
    """Regular expression that finds any of the (non-empty) literals."""
    by_head: dict[str, list[str]] = {}
    for w in sorted(set(words_)):
        by_head.setdefault(w[0], []).append(w[1:])
    ways = []
    for head, tails in by_head.items():
        quoted = head if head.isalnum() or head == " " else f"\\x{{{ord(head):x}}}"
        ways.append(quoted + ("" if "" in tails else any_of(tails)))   # a shorter literal settles it
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def clean_response(c: ColumnOrName, max_len: int = 150) -> Column:
    """text between the first and second 'Answer:' (stripped) or the
    whole text; then its first sentence plus '.'; then, when longer than
    ``max_len``, cut at the last space of the first ``max_len`` characters
    and append '...'."""
    r = _c(c)
    body = F.when(F.contains(r, F.lit("Answer:")),
                  strip_ws(F.split_part(r, F.lit("Answer:"), F.lit(2)))).otherwise(r)
    sent = F.concat(F.substring_index(body, ".", 1), F.lit("."))
    head = F.substring(sent, 1, max_len)
    last_space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), last_space)).otherwise(head)
    return F.when(F.length(sent) > max_len, F.concat(cut, F.lit("..."))).otherwise(sent)


def question_template(title: ColumnOrName, template: str = "What is {}?") -> Column:
    """question built from a title."""
    pre, post = template.split("{}")
    return F.concat(F.lit(pre), _c(title), F.lit(post))


def build_prompt(context: ColumnOrName, question: ColumnOrName, template: str,
                 context_chars: int = defaults.QA_CONTEXT_BUDGET) -> Column:
    """template with ``{context}`` (first ``context_chars`` characters)
    and ``{question}`` placeholders filled from columns."""
    parts = []
    rest = template
    while rest:
        i_c, i_q = rest.find("{context}"), rest.find("{question}")
        hits = [(i, k) for i, k in ((i_c, "c"), (i_q, "q")) if i >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        i, k = min(hits)
        if i:
            parts.append(F.lit(rest[:i]))
        if k == "c":
            parts.append(truncate_chars(context, context_chars))
            rest = rest[i + len("{context}"):]
        else:
            parts.append(_c(question))
            rest = rest[i + len("{question}"):]
    return F.concat(*parts)


def metadata_text(m: ColumnOrName) -> Column:
    """map -> 'key: value' lines, keys sorted for determinism."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(_c(m))),
                    lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def python_bool_text(c: ColumnOrName) -> Column:
    """Boolean rendered the way Python prints it: True / False / None."""
    b = _c(c)
    return F.when(b.isNull(), F.lit("None")).when(b, F.lit("True")).otherwise(F.lit("False"))


def feedback_format(question: ColumnOrName, answer: ColumnOrName, helpful: ColumnOrName) -> Column:
    """structured feedback entry -> one log line."""
    return F.concat(F.lit("Question: "), _c(question), F.lit(", Answer: "), _c(answer),
                    F.lit(", Helpful: "), python_bool_text(helpful))


def to_string_nan(c: ColumnOrName) -> Column:
    """value as text; a missing value becomes 'nan'."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan"))


def bounded_length(c: ColumnOrName, cap: int = 100) -> Column:
    """min(len // 2, cap)."""
    return F.least(F.floor(F.length(_c(c)) / 2), F.lit(cap)).cast("long")


def percent_label(c: ColumnOrName) -> Column:
    """percentage with one decimal (half up) and a '%' sign."""
    rounded = (F.floor(_c(c) * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)).cast("double")
    return F.concat(rounded.cast("string"), F.lit("%"))


def to_base64(c: ColumnOrName) -> Column:
    """text/bytes -> base64 text (one line, no MIME line breaks)."""
    return F.regexp_replace(F.base64(_c(c).cast("binary")), r"[\r\n]", "")


def from_base64(c: ColumnOrName) -> Column:
    """base64 text -> UTF-8 text (null when not decodable)."""
    return F.try_to_binary(_c(c), F.lit("base64")).cast("string")
