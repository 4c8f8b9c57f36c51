"""Text signals as column expressions; a document stays in its row.

Nothing is exploded: spans and sentences are arrays inside the row, so the
scans need no shuffle however large the table is.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake.config import HEDGE_WORDS, SETTINGS

# --- fixed values: patterns -------------------------------------------------------
SENTENCE_BREAK = r"(?<=[.!?])\s+"
WORD = r"[a-z']+"
KEY_LIKE = r"[A-Za-z0-9+/=_-]{16,}"
SECRET_SHAPES: tuple[str, ...] = (
    r"\bsk-[A-Za-z0-9_-]{16,}",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{30,}",
    r"\bxox[baprs]-[0-9A-Za-z-]{10,}",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i:\b(api[_-]?key|secret|token|passwd|password)\b\s*[=:]\s*\S{8,})",
)
PII_SHAPES: tuple[str, ...] = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"(?<!\d)(?:\+91[- ]?)?[6-9]\d{9}(?!\d)",
    r"(?<!\d)(?:\d[ -]?){13,16}(?!\d)",
    r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)",
    r"\b[A-Z]{5}\d{4}[A-Z]\b",
    r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
)
ENTROPY_FLOOR = 4.5
ENTROPY_RANGE = 1.5
# --- end of fixed values ----------------------------------------------------------

ANY_SECRET = "|".join(f"(?:{shape})" for shape in SECRET_SHAPES)
ANY_PII = "|".join(f"(?:{shape})" for shape in PII_SHAPES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Non-blank sentences. Only the outer ends can carry blanks: the break itself takes all inner ones."""
    return F.filter(F.split(strip(text), SENTENCE_BREAK), lambda s: s != "")


def spans(text: Column, words: int = SETTINGS.flush_tokens) -> Column:
    """Sentences cut into runs of ``words`` words joined by one blank; blank text gives one empty span."""
    def cut(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size(tokens)) - 1, F.lit(words))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(words)), " "))

    tokens = F.transform(sentences(text), lambda s: F.split(s, r"\s+"))
    found = F.flatten(F.transform(tokens, cut))
    return let(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit(""))).otherwise(f))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def hedge_density(text: Column, lexicon: Sequence[str] = HEDGE_WORDS) -> Column:
    """Share of the words that are in the lexicon; 0 without words."""
    def share(tokens: Column) -> Column:
        hits = F.size(F.filter(tokens, lambda w: w.isin(*lexicon)))
        return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(hits / F.size(tokens))

    return let(words(text), share)


def sentence_support(text: Column, chunks: Column) -> Column:
    """Per sentence: the largest share of its word set found in one chunk (1.0 for a wordless sentence)."""
    def best(asked: Column, chunk_sets: Column) -> Column:
        share = F.transform(chunk_sets, lambda c: F.size(F.array_intersect(asked, c)) / F.size(asked))
        return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(F.array_max(share))

    asked_sets = F.transform(sentences(text), lambda s: F.array_distinct(words(s)))
    return let(
        F.transform(chunks, lambda c: F.array_distinct(words(c))),
        lambda chunk_sets: F.transform(asked_sets, lambda asked: best(asked, chunk_sets)),
    )


def support_min(scores: Column, chunks: Column) -> Column:
    return F.when((F.size(scores) == 0) | (F.size(chunks) == 0), F.lit(0.0)).otherwise(F.array_min(scores))


def support_mean(scores: Column, chunks: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(scores) == 0) | (F.size(chunks) == 0), F.lit(0.0)).otherwise(total / F.size(scores))


def entropy(token: Column) -> Column:
    """Shannon entropy in bits per character."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.length(token).cast("double")

    def part(c: Column) -> Column:
        share = (F.length(token) - F.length(F.replace(token, c, F.lit("")))) / n
        return -share * F.log2(share)

    return F.aggregate(F.transform(F.array_distinct(letters), part), F.lit(0.0), lambda a, x: a + x)


def key_likeness(token: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (entropy(token) - ENTROPY_FLOOR) / ENTROPY_RANGE))


def _loose(shape: str) -> str:
    """The shape with any run of blanks where a span has a single one.

    Spans join the words of the text by one blank, so whatever a span matches,
    the raw text matches loosely.
    """
    for joint in ("[ -]?", "[- ]?"):
        shape = shape.replace(joint, r"(?:-|\s+)?")
    return shape.replace("[A-Z ]*", r"[A-Z\s]*").replace("BEGIN ", r"BEGIN\s+").replace("PRIVATE KEY", r"PRIVATE\s+KEY")


def _any(shapes: Sequence[str]) -> str:
    return "|".join(f"(?:{shape})" for shape in shapes)


def _in_some_span(text: Column, shapes: str) -> Column:
    return F.exists(spans(text), lambda s: s.rlike(shapes))


# a text that a credential shape matches contains one of the shape's fixed parts
SECRET_MARKS = (
    ("sk-",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("AKIA",), ("AIza",),
    ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), ("eyJ",), ("-----BEGIN",), ("=", ":"),
)
LOOSE_NUMBERS = _any([_loose(s) for s in PII_SHAPES[1:]])


def secret_score(text: Column) -> Column:
    """1.0 for a credential shape in a span, else the largest key-likeness of a long token; never NULL.

    Cheap tests on the raw text run first; spans are cut only for the few texts that pass.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"({KEY_LIKE})"), F.lit(1))
    dense = F.coalesce(F.array_max(F.transform(tokens, key_likeness)), F.lit(0.0))
    marked = [
        reduce(operator.or_, [text.contains(m) for m in marks]) & text.rlike(_loose(shape))
        for shape, marks in zip(SECRET_SHAPES, SECRET_MARKS)
    ]
    shaped = reduce(operator.or_, marked) & _in_some_span(text, ANY_SECRET)
    return F.when(text.isNull(), F.lit(0.0)).when(shaped, F.lit(1.0)).when(text.rlike(KEY_LIKE), dense).otherwise(0.0)


def pii_score(text: Column) -> Column:
    """1.0 for a personal-data shape in a span. A miss is NULL: no shape is no proof of absence.

    Every shape needs an @ or a digit, so most texts are done after one linear test.
    """
    mail = text.contains("@") & text.rlike(PII_SHAPES[0])
    number = text.rlike("[0-9]") & text.rlike(LOOSE_NUMBERS)
    return F.when((mail | number) & _in_some_span(text, ANY_PII), F.lit(1.0))


def truthy(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def tool_retries(calls: Column) -> Column:
    return F.coalesce(F.size(F.filter(calls, lambda c: truthy(c["is_retry"]))), F.lit(0))


def tool_errors(calls: Column) -> Column:
    return F.coalesce(F.size(F.filter(calls, lambda c: F.coalesce(c["error"] != "", F.lit(False)))), F.lit(0))


def quoted_after(prompt: Column, marker: str = "Customer says:") -> Column:
    """The first line after the first marker without surrounding blanks and quotes; "" without marker."""
    tail = F.substring(prompt, F.instr(prompt, marker) + len(marker), F.length(prompt))
    line = strip(F.substring_index(strip(tail), "\n", 1))
    bare = F.regexp_replace(line, r"""^['"]+|['"]+$""", "")
    return F.when(prompt.contains(marker), bare).otherwise(F.lit(""))
