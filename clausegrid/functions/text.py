"""Text helpers as native Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausegrid import constants as K

_HYPHEN = "\ufdd0"  # Unicode non-character standing for a removed line-end hyphen
_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def jvm(pattern: str) -> str:
    """ASCII word edges and the full whitespace class, whatever the JVM's defaults."""
    return pattern.replace(r"\b", _EDGE).replace(r"\s", f"[{K.JVM_WS}]")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_page(text: Column | str) -> Column:
    """Join hyphenated line ends, collapse whitespace runs, strip the ends."""
    t = F.replace(col(text), F.lit("-\n"), F.lit(_HYPHEN))
    t = F.regexp_replace(t, f"^[{_HYPHEN}{K.JVM_WS}]+", "")
    t = F.regexp_replace(t, rf"[{K.JVM_WS}]+\z", "")
    t = F.regexp_replace(t, rf"[{K.JVM_WS_NO_NEWLINE}]*\n[{K.JVM_WS}]*", "\n")
    t = F.regexp_replace(t, f"[{K.JVM_WS_NO_NEWLINE}]+", " ")
    return F.replace(t, F.lit(_HYPHEN), F.lit(""))


def normalize_for_compare(text: Column | str) -> Column:
    """One form for quotes, dashes and spaces; lower case."""
    t = F.translate(col(text), K.COMPARE_FROM, K.COMPARE_TO)
    return F.lower(F.trim(F.regexp_replace(t, f"[{K.JVM_WS}]+", " ")))


def collapse_lower(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(text), f"[{K.JVM_WS}]+", " ")))


def trim_ws(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), f"^[{K.JVM_WS}]+", ""), rf"[{K.JVM_WS}]+\z", "")


def is_blank(text: Column | str) -> Column:
    return col(text).rlike(rf"\A[{K.JVM_WS}]*+\z")


#: Characters whose upper case is several characters, and what each becomes by itself.
_WIDE = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
_WIDE_UPPER = "".join("\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in _WIDE)


def upper_each(text: Column | str) -> Column:
    """Upper case without changing the number of characters."""
    chars = F.regexp_extract_all(col(text), F.lit("(?s)."), F.lit(0))
    return F.array_join(F.transform(chars, lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(
        F.translate(c, _WIDE, _WIDE_UPPER))), "")


def words(text: Column | str) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(col(text), f"[{K.JVM_WS}]+"), lambda w: w != "")


def clause_type(title: Column | str, body: Column | str) -> Column:
    """First clause type whose pattern hits the title or the body."""
    def first(t: Column, t_low: Column, b: Column, b_low: Column) -> Column:
        chain = None
        for pattern, name in K.CLAUSE_TYPES:
            hit = _hits(t, t_low, pattern) | _hits(b, b_low, pattern)
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain

    return _with_lower(title, lambda t, t_low: _with_lower(body, lambda b, b_low: first(t, t_low, b, b_low)))


def ocr_candidate(text: Column | str) -> Column:
    return F.length(F.regexp_replace(col(text), f"[{K.JVM_WS}]+", "")) < K.OCR_MIN_CHARS


def literal(pattern: str) -> str:
    """The longest text that every match of a pattern holds, in lower case."""
    rest = re.sub(r"\([^()]*\)\??", "\0", pattern.replace("(?i)", "")).replace(r"\.", "\1")
    rest = re.sub(r"\\[a-z][*+?]?|\[[^\]]*\][*+?]?|.[*?]", "\0", rest)
    return max(rest.split("\0"), key=len).replace("\1", ".").lower()


def _with_lower(text: Column | str, body: Callable[[Column, Column], Column]) -> Column:
    """`body` of a text and its lower case, which is made once."""
    t = F.coalesce(col(text), F.lit(""))
    return F.element_at(F.transform(F.array(F.struct(t.alias("t"), F.lower(t).alias("low"))), lambda s: body(s["t"], s["low"])), 1)


def _hits(text: Column, low: Column, pattern: str) -> Column:
    """Does an alternation of words, in any case, occur? It is tried only where the lower case holds one of the words."""
    held = F.lit(False)
    for word in pattern.removeprefix("(?i)").split("|"):
        held = held | F.contains(low, F.lit(word))
    return held & text.rlike(pattern)


def any_word(text: Column | str, pattern: str) -> Column:
    """`rlike` of an alternation of words in any case; null counts as empty."""
    return _with_lower(text, lambda t, low: _hits(t, low, pattern))


def lint(text: Column | str) -> Column:
    """All unwanted phrases found, as array<struct<phrase, reason>>. A pattern is tried only where its literal part occurs."""
    return _with_lower(text, lambda t, low: F.filter(F.array(*[
        F.struct(F.when(F.contains(low, F.lit(literal(p))), F.regexp_extract(t, jvm(p), 0)).otherwise("").alias("phrase"), F.lit(reason).alias("reason"))
        for p, reason in K.LINT_PATTERNS]), lambda h: h["phrase"] != ""))


def lint_clean(text: Column | str) -> Column:
    def clean(t: Column, low: Column) -> Column:
        dirty = F.lit(False)
        for pattern, _ in K.LINT_PATTERNS:
            dirty = dirty | (F.contains(low, F.lit(literal(pattern))) & t.rlike(jvm(pattern)))
        return ~dirty

    return _with_lower(text, clean)


def tokens(text: Column | str) -> Column:
    """Lower-case alphanumeric tokens."""
    return F.filter(F.split(F.lower(col(text)), "[^a-z0-9]+"), lambda w: w != "")


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of an ASCII token as an unsigned value in a LONG."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(
        F.filter(codes, lambda c: c > 0),
        F.lit(2166136261).cast("long"),
        lambda h, c: ((h.bitwiseXOR(c)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")),
    )


def hash_dimension(token: Column, dim: int) -> Column:
    signed = F.shiftright(F.shiftleft(fnv1a(token), 32), 32)  # as a 32-bit signed value
    return (F.abs(signed) % dim).cast("int")
