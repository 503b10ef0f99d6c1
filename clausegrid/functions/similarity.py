"""Similarity, numeric agreement and confidence as native Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions.text import col, normalize_for_compare


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bigrams(text: Column) -> Column:
    """Character bigrams of a string; empty when shorter than two characters."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return let(chars, lambda c: F.when(F.size(c) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.concat(x, y))))


def _numbered(grams: Column) -> Column:
    """Tag each gram with its occurrence number, so that set intersection counts a multiset."""
    return let(F.array_sort(grams), lambda o: F.transform(
        o, lambda g, i: F.concat(g, (i.cast("long") - F.array_position(o, g)).cast("string"))))


def dice_of_numbered(na: Column, ga: Column, nb: Column, gb: Column) -> Column:
    """Dice from two normalised texts and their numbered bigrams (all evaluated already)."""
    return (
        F.when(na == nb, F.lit(1.0))
        .when((F.length(na) < 2) | (F.length(nb) < 2), F.lit(0.0))
        .otherwise(F.lit(2.0) * F.size(F.array_intersect(ga, gb)) / (F.length(na) + F.length(nb) - 2))
    )


def dice_of_normalized(na: Column, nb: Column) -> Column:
    return let(na, lambda a: let(nb, lambda b: dice_of_numbered(a, _numbered(bigrams(a)), b, _numbered(bigrams(b)))))


def profile(text: Column | str) -> Column:
    """Normalised text with its numbered bigrams, for repeated comparison."""
    return let(normalize_for_compare(text), lambda n: F.struct(n.alias("n"), _numbered(bigrams(n)).alias("g")))


def dice_of_profiles(a: Column, b: Column) -> Column:
    return dice_of_numbered(a["n"], a["g"], b["n"], b["g"])


def dice(a: Column | str, b: Column | str) -> Column:
    """Dice coefficient on multiset bigrams of normalised text; meant for short spans."""
    return dice_of_normalized(normalize_for_compare(a), normalize_for_compare(b))


def dice_table(pairs: DataFrame, key: str, a: str, b: str, out: str = "score") -> DataFrame:
    """Dice for texts of any length, one row a pair: a batched count of bigrams, which takes time linear in the texts and shuffles nothing."""
    norm = pairs.select(key, normalize_for_compare(a).alias("na"), normalize_for_compare(b).alias("nb"))
    return norm.select(key, dice_batched(F.col("na"), F.col("nb")).alias(out))


def _gram_counts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of several texts as (row << 42 | bigram), ascending and distinct, and how often each occurs."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = (row[:-1] << 42 | codes[:-1] << 21 | codes[1:])[row[:-1] == row[1:]]
    return np.unique(keys, return_counts=True)


def dice_scores(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Dice of normalised texts, row by row, in time linear in their length: all rows' bigrams are counted by one sort."""
    same = np.array([x == y for x, y in zip(a, b)], bool)
    la, lb = (np.array([len(t) for t in side], np.int64) for side in (a, b))
    (ka, na), (kb, nb) = _gram_counts(a), _gram_counts(b)
    shared = np.zeros(len(a))
    if len(ka) and len(kb):
        at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
        hit = kb[at] == ka
        np.add.at(shared, (ka[hit] >> 42), np.minimum(na[hit], nb[at[hit]]))
    score = np.where((la < 2) | (lb < 2), 0.0, 2.0 * shared / np.maximum(la + lb - 2, 1))
    return np.where(same, 1.0, score)


#: Characters that are counted at once.
_SCORED = 2_000_000


def _scored_in_slices(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    rows = np.flatnonzero(known)
    left, right = a.to_numpy(object)[rows], b.to_numpy(object)[rows]
    ends = np.cumsum([len(x) + len(y) for x, y in zip(left, right)])
    first = 0
    while first < len(rows):
        upto = (ends[first - 1] if first else 0) + _SCORED
        last = max(int(np.searchsorted(ends, upto, "right")), first + 1)
        out[rows[first:last]] = dice_scores(left[first:last], right[first:last])
        first = last
    return pd.Series([None if np.isnan(x) else x for x in out], dtype=object).astype("Float64") if not known.all() else pd.Series(out)


@cache
def _dice_udf():
    # marked non-deterministic so that a filter on the score is not pushed below it and scored again
    return F.pandas_udf(_scored_in_slices, "double").asNondeterministic()


def dice_batched(na: Column, nb: Column) -> Column:
    """Dice of two normalised columns, batch by batch; the native form numbers equal bigrams in quadratic time."""
    return _dice_udf()(na, nb)


def content_words(text: Column | str) -> Column:
    parts = F.split(normalize_for_compare(text), "[^a-z0-9]+")
    kept = F.filter(parts, lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(w) for w in K.STOP_WORDS]))


def lexical_overlap(claim: Column | str, evidence: Column | str) -> Column:
    """Share of the claim's distinct content words that the evidence holds."""
    wc, we = content_words(claim), content_words(evidence)
    return F.when(F.size(wc) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wc, we)) / F.size(wc))


def grounded(claim: Column | str, evidence: Column | str) -> Column:
    return lexical_overlap(claim, evidence) >= K.GROUNDING_THRESHOLD


def numeric_ok(value: Column | str, quote: Column | str) -> Column:
    """Does every number in the value appear in the quote, as digits or as a number word?"""
    value, quote = col(value), col(quote)
    claimed = F.regexp_extract_all(value, F.lit(r"\d[\d,\.]*"), F.lit(0))
    in_quote = F.transform(
        F.regexp_extract_all(quote, F.lit(r"\d[\d,\.]*"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    lowered = F.lower(F.translate(quote, "\u2018\u2019", "''"))
    spelled = F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(w)), F.lit(d)) for w, d in K.NUMBER_WORDS]))
    facts = F.struct(in_quote.alias("digits"), spelled.alias("spelled"), lowered.alias("low"))

    def found(n: Column, f: Column) -> Column:
        clean = F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), r"\.\z", "")
        digits = F.regexp_replace(F.regexp_extract(clean, r"^\d+", 0), "^0+", "")
        whole = F.when(digits == "", F.lit("0")).otherwise(digits)
        return (
            F.array_contains(f["digits"], clean) | F.array_contains(f["digits"], whole)
            | F.array_contains(f["spelled"], whole) | F.contains(f["low"], clean)
        )

    return F.coalesce(let(facts, lambda f: F.forall(claimed, lambda n: found(n, f))), F.lit(True))


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def blend_confidence(
    self_report: Column | str, agreement: Column | str | float, match: Column | str,
    ocr: Column | str, conflicting: Column | None = None,
) -> Column:
    """Weighted blend of three scores, lowered for OCR text and for conflicts, to three digits."""
    agreement = F.lit(agreement) if isinstance(agreement, float) else col(agreement)
    c = F.lit(0.5) * _unit(col(self_report)) + F.lit(0.3) * _unit(agreement) + F.lit(0.2) * _unit(col(match))
    c = F.when(col(ocr), c * F.lit(0.8)).otherwise(c)
    if conflicting is not None:
        c = F.when(conflicting, c * F.lit(0.85)).otherwise(c)
    return F.floor(c * 1000 + F.lit(0.5)) / F.lit(1000.0)


def confidence_band(confidence: Column | str) -> Column:
    c = col(confidence)
    return F.when(c >= 0.85, "high").when(c >= 0.6, "medium").otherwise("low")
