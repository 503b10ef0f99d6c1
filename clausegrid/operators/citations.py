"""Citations: locating quotes in pages, validating extracted fields, corrections."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import ordered
from clausegrid.functions import similarity as S
from clausegrid.functions import text as T
from clausegrid.sources import io

LAYOUT_BUCKET = 512


def _span(start: Column, end: Column, score: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), score.alias("score"))


def _slice(text: Column, start: Column, size: Column) -> Column:
    return F.substr(text, start + 1, size)


_WS = frozenset(re.sub(r"\\x\{([0-9a-f]+)\}|\\([tnfr])", lambda m: chr(int(m[1], 16)) if m[1] else {"t": "\t", "n": "\n", "f": "\f", "r": "\r"}[m[2]],
                       K.WS.replace(r"\x{2000}-\x{200a}", "".join(map(chr, range(0x2000, 0x200B))))))
_WHITE = np.zeros(0x10000, bool)
_WHITE[[ord(c) for c in _WS]] = True
_UNIFY = str.maketrans(K.COMPARE_FROM, K.COMPARE_TO)
_LOOSE = str.maketrans(K.LOOSE_FROM, K.LOOSE_TO)


def _lower(text: str) -> str:
    """Lower case without changing the number of characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _collapsed(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with white space runs as one space, the place of each of its characters in `text`, and which characters of `text` are white."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = _WHITE[np.minimum(codes, 0xFFFF)]
    kept = ~white
    kept[1:] |= ~white[:-1]
    kept[:1] = True
    at = np.flatnonzero(kept)
    return np.where(white, np.uint32(32), codes)[at].tobytes().decode("utf-32-le", "surrogatepass"), at, white


def loose_hit(page: str, quote: str, hint: int | None) -> tuple[int, int] | None:
    """The place nearest the hint where the page equals the normalised quote up to case, quotes, dashes and spaces."""
    flat, at, _ = _collapsed(_lower(page.translate(_LOOSE)))
    best, i = None, flat.find(quote)
    while i >= 0:
        start = int(at[i])
        distance = abs(start - hint) if hint is not None else 0
        if best is None or distance < best[0]:
            best = (distance, start, int(at[i + len(quote) - 1]) + 1)
        i = flat.find(quote, i + 1)
    return best and best[1:]


#: Counts of a quote's bigrams that are held at once.
_COUNTED = 2_000_000


def fuzzy_hit(page: str, quote: str, length: int) -> tuple[int, int, float] | None:
    """The best window of the whole page: starts on a grid, three sizes around the quote's `length`.

    Only bigrams of the quote count: their places in the page are counted from the left, and a window's share is the difference at its two ends."""
    n, span = len(page), max(length, 40)
    step = max(20, span // 4)
    starts = np.arange(0, n - span + 1, step)
    if not len(starts) or len(quote) < 2:
        return None
    sizes = [span, int(span * 0.8), int(np.ceil(span * 1.25))]
    begin = np.repeat(starts, 3)
    end = begin + np.tile(sizes, len(starts))
    begin, end = begin[end <= n], end[end <= n]
    flat, at, white = _collapsed(_lower(page.translate(_UNIFY)))
    solid = np.flatnonzero(~white)
    if not len(solid):
        return None
    # a window without its white edges, as a range of the collapsed text
    place = np.zeros(n, np.int64)
    place[at] = np.arange(len(at))
    first = np.minimum(np.searchsorted(solid, begin), len(solid) - 1)
    last = np.searchsorted(solid, end) - 1
    low, high = place[solid[first]], np.where(last >= first, place[solid[np.maximum(last, 0)]] + 1, place[solid[first]])
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    q = np.frombuffer(quote.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wanted, often = np.unique(q[:-1] << 21 | q[1:], return_counts=True)
    grams = code[:-1] << 21 | code[1:]
    which = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
    spots = np.flatnonzero(wanted[which] == grams)
    which = which[spots]
    shared = np.zeros(len(low), np.int64)
    # a window's places among the spots, then how many of them hold each gram, some grams at a time
    first, last = np.searchsorted(spots, low), np.maximum(np.searchsorted(spots, high - 1), np.searchsorted(spots, low))
    some = max(1, _COUNTED // (len(spots) + len(low) + 1))
    for g in range(0, len(wanted), some):
        held = np.zeros((min(some, len(wanted) - g), len(spots) + 1), np.int32)
        here = np.flatnonzero((which >= g) & (which < g + some))
        held[which[here] - g, here + 1] = 1
        np.cumsum(held, axis=1, out=held)
        shared += np.minimum(held[:, last] - held[:, first], often[g:g + some, None]).sum(axis=0)
    size = high - low
    score = np.where(size < 2, 0.0, 2.0 * shared / np.maximum(size + len(quote) - 2, 1))
    best = int(np.argmax(score))  # the first of equals: earliest start, then the first size
    return (int(begin[best]), int(end[best]), float(score[best])) if score[best] >= K.REANCHOR_FLOOR else None


@cache
def _inexact_udf():
    def search(page: pd.Series, quote: pd.Series, form: pd.Series, hint: pd.Series) -> pd.DataFrame:
        rows = []
        for text, raw, flat, at in zip(page, quote, form, hint):
            row = (None, None, None)
            if isinstance(text, str) and flat:
                if near := loose_hit(text, flat, None if at is None or at != at else int(at)):
                    row = (*near, 1.0)
                elif window := fuzzy_hit(text, flat, len(raw)):
                    row = window
            rows.append(row)
        return pd.DataFrame({"start": pd.array([r[0] for r in rows], "Int32"), "end": pd.array([r[1] for r in rows], "Int32"),
                             "score": pd.array([r[2] for r in rows], "Float64")})

    return F.pandas_udf(search, "start int, end int, score double").asNondeterministic()


def find_slice(page: Column | str, quote: Column | str, hint: Column | str | None = None, only: Column | None = None) -> Column:
    """Where a quote stands in a page: struct<start, end, score>, null when nowhere.

    Exact text first; then, for the rest, the same text up to case, quotes, dashes and spaces (nearest to the hint), then the best window
    of a grid over the whole page. `only`: rows to look at."""
    page, quote = T.col(page), T.col(quote)
    hint = F.lit(None).cast("int") if hint is None else T.col(hint).cast("int")
    wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    form, exact = T.normalize_for_compare(quote), F.instr(page, quote)
    rest = _inexact_udf()(F.when(wanted & (exact == 0), page), quote, form, hint)
    hit = F.when(wanted & (exact > 0) & (form != ""), _span(exact - 1, exact - 1 + F.length(quote), F.lit(1.0)))
    # one call for all three values: a search that is named again is made again
    return F.coalesce(hit, S.let(rest, lambda r: F.when(r["start"].isNotNull(), _span(r["start"], r["end"], r["score"]))))


def resolve_citations(evidence: DataFrame, pages: DataFrame, threshold: float = K.CITATION_THRESHOLD,
                      global_spans: bool = False) -> DataFrame:
    """Check every quoted span against its page; below the threshold try one re-anchor.

    `evidence`: dv_id, page, char_start, char_end, quoted_text and any further columns.
    Spans are page-local, or whole-document ones with `global_spans`. Evidence whose page
    is missing is dropped; unresolvable evidence keeps its own span.
    """
    base = pages.select(
        "dv_id", F.col("page_number").alias("page"), F.col("text").alias("__text"),
        F.coalesce(F.col("ocr_derived"), F.lit(False)).alias("ocr_derived"),
        (F.col("char_start").cast("int") if global_spans else F.lit(0)).alias("__base"))
    joined = evidence.join(base, ["dv_id", "page"])
    start = F.col("char_start").cast("int") - F.col("__base")
    end = F.col("char_end").cast("int") - F.col("__base")
    joined = joined.withColumns({"__s": start, "__e": end})
    slice_ = _slice(F.col("__text"), F.col("__s"), F.greatest(F.lit(0), F.col("__e") - F.col("__s")))
    scored = joined.withColumn("__own", S.dice_batched(T.normalize_for_compare(slice_), T.normalize_for_compare("quoted_text")))
    found = scored.withColumn("__hit", find_slice("__text", "quoted_text", "__s", only=F.col("__own") < threshold))
    score = F.coalesce(F.col("__hit.score"), F.col("__own"))
    ok = F.col("match_confidence") >= threshold
    moved = ok & F.col("__hit").isNotNull()
    return (found.withColumn("match_confidence", score).withColumns({
        "resolvable": ok,
        "char_start": F.when(moved, F.col("__hit.start") + F.col("__base")).otherwise(F.col("char_start").cast("int")),
        "char_end": F.when(moved, F.col("__hit.end") + F.col("__base")).otherwise(F.col("char_end").cast("int")),
    }).drop("__text", "__s", "__e", "__own", "__hit", "__base"))


def validate_fields(candidates: DataFrame, pages: DataFrame, agreement: float = K.RETRIEVAL_AGREEMENT) -> DataFrame:
    """Status, value and citations of each field candidate.

    `candidates`: dv_id, field_key, status, value_text, value_normalized, extraction_kind,
    evidence (array of spans), self_confidence. Evidence is exploded, resolved by one
    equi-join with the pages, and gathered back per candidate (as many as its own array).
    """
    key = ["dv_id", "field_key"]
    spans = candidates.select(*key, F.posexplode("evidence").alias("pos", "e")).select(*key, "pos", "e.*")
    resolved = resolve_citations(spans, pages).filter("resolvable")
    cited = resolved.select(
        *key, "pos", F.concat_ws("#", *key, "pos").alias("citation_id"), "quoted_text", "match_confidence", "ocr_derived")
    gathered = cited.groupBy(*key).agg(
        F.count("*").alias("resolved"),
        F.min_by(F.struct("citation_id", "quoted_text", "match_confidence", "ocr_derived"), "pos").alias("p"),
        F.array_sort(F.collect_list(F.struct("pos", "citation_id"))).alias("all"))
    row = candidates.join(gathered, key, "left")
    n = F.coalesce("resolved", F.lit(0))
    conflicting = F.col("status") == "conflicting"
    quote, value = F.col("p.quoted_text"), F.col("value_text")
    has_value = value.isNotNull() & (value != "")
    lone_conflict = conflicting & (n < 2)
    verdict = (
        F.when((F.col("status") == "not_found") | (F.size("evidence") <= 0), "absent")
        .when(n == 0, "no citation")
        .when(lone_conflict, "lone conflict")
        .when(has_value & ~S.numeric_ok(value, quote), "numbers differ")
        .when((F.col("extraction_kind") == "factual") & has_value & ~S.grounded(value, quote), "not grounded")
        .when(~T.lint_clean(value), "phrasing")
        .otherwise("valid"))
    row = row.withColumn("verdict", verdict)
    kept = F.col("verdict").isin("lone conflict", "valid")
    confidence = S.blend_confidence(
        "self_confidence", agreement, "p.match_confidence", "p.ocr_derived", conflicting & (F.col("verdict") == "valid"))
    row = row.withColumn("confidence", F.when(kept, confidence).otherwise(F.lit(0.0)))
    status = (F.when(~kept, "not_found").when(F.col("verdict") == "lone conflict", "found").when(conflicting, "conflicting")
              .when(S.confidence_band("confidence") == "low", "needs_confirmation").otherwise("found"))
    others = F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x["citation_id"])
    return row.select(
        *[c for c in candidates.columns if c not in ("status", "value_text", "value_normalized", "evidence", "self_confidence")],
        "verdict", status.alias("status"), F.when(kept, value).alias("value_text"),
        F.when(kept, F.col("value_normalized")).alias("value_normalized"), "confidence",
        F.when(kept, F.col("p.citation_id")).alias("primary_citation_id"),
        F.when(F.col("verdict") == "valid", others).otherwise(F.array().cast("array<string>")).alias("alt_citation_ids"),
        (~kept & (F.col("verdict") != "absent")).alias("superseded"))


FIELD_KEY = ["dv_id", "field_key", "prompt_version"]


def merge_fields(existing: DataFrame, validated: DataFrame, order_by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """One row per (version, field, prompt); the later write wins. Values a person corrected
    or confirmed stay unless `strict`."""
    keep = None if strict else F.col("validation_status").isin("corrected", "confirmed")
    return io.upsert(existing, validated, FIELD_KEY, "update", order_by=order_by, keep=keep)


def dedupe_candidates(candidates: DataFrame, position: str, known: Sequence[str]) -> DataFrame:
    """First candidate per (version, field key) by position; unknown keys are dropped."""
    return ordered.earliest(candidates.filter(F.col("field_key").isin(*known)), ["dv_id", "field_key"], [position])


def complete_coverage(fields: DataFrame, versions: DataFrame, prompt_version: str, searched: DataFrame | None = None) -> DataFrame:
    """Explicit not_found rows for the target fields a version has no row for, with the sections that were searched for them.

    `searched`: dv_id, sections (the comma-joined references that `assemble_context` gives); a version without a row was not searched."""
    specs = F.array(*[
        F.struct(F.lit(k).alias("field_key"), F.lit(label).alias("label"), F.lit(g).alias("field_group"), F.lit(1 << i).cast("long").alias("bit"))
        for i, (k, label, g) in enumerate(K.TARGET_FIELDS)])
    # what a version has is one number, a bit a field, which meets the version's row before that becomes a row for each missing field
    bit = F.coalesce(*[F.when(F.col("field_key") == k, F.lit(1 << i).cast("long")) for i, (k, _, _) in enumerate(K.TARGET_FIELDS)])
    present = fields.select("dv_id", bit.alias("bit")).filter("bit IS NOT NULL").groupBy("dv_id").agg(F.bit_or("bit").alias("__present"))
    rows = versions.join(present, "dv_id", "left")
    none = F.array().cast("array<string>")
    if searched is None:
        rows = rows.withColumn("searched_sections", none)
    else:
        sections = F.filter(F.split("sections", ","), lambda s: s != "")
        rows = rows.join(searched.select("dv_id", sections.alias("searched_sections")), "dv_id", "left").withColumn(
            "searched_sections", F.coalesce("searched_sections", none))
    lacking = F.filter(specs, lambda s: F.coalesce("__present", F.lit(0)).bitwiseAND(s["bit"]) == 0)
    missing = rows.withColumn("s", F.explode(lacking)).select(
        "dv_id", "s.field_key", *[c for c in versions.columns if c != "dv_id"], "s.label", "s.field_group", "searched_sections")
    return missing.withColumns({
        "validation_status": F.lit("not_found"), "value_text": F.lit(None).cast("string"),
        "extraction_kind": F.lit("factual"), "confidence": F.lit(0.0), "prompt_version": F.lit(prompt_version)})


def citation_rects(citations: DataFrame, layout: DataFrame) -> DataFrame:
    """Layout boxes overlapping each citation's span on its page.

    Both sides are cut into fixed character buckets; a pair is taken in the first bucket
    both share, so it comes out once and long pages do not pair everything.
    """
    def buckets(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("__b", F.explode(F.sequence(
            F.floor(F.col(s) / LAYOUT_BUCKET), F.floor(F.greatest(F.col(s), F.col(e) - 1) / LAYOUT_BUCKET))))

    c = buckets(citations.withColumnsRenamed({"char_start": "c_start", "char_end": "c_end"}), "c_start", "c_end")
    box = buckets(layout.select("dv_id", F.col("page_number").alias("page"), F.col("char_start").alias("l_start"),
                                F.col("char_end").alias("l_end"), "x", "y", "w", "h"), "l_start", "l_end")
    hit = c.join(box, ["dv_id", "page", "__b"]).filter(
        (F.col("l_start") < F.col("c_end")) & (F.col("l_end") > F.col("c_start"))
        & (F.col("__b") == F.floor(F.greatest("c_start", "l_start") / LAYOUT_BUCKET)))
    return hit.drop("__b")


def citation_views(citations: DataFrame, layout: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations with box count and page count; shown as resolvable only with a box."""
    boxes = citation_rects(citations, layout).groupBy("citation_id").agg(F.count("*").alias("boxes"))
    counts = pages.groupBy("dv_id").agg(F.count("*").alias("page_count"))
    return (citations.join(boxes, "citation_id", "left").join(counts, "dv_id", "left")
            .withColumns({"boxes": F.coalesce("boxes", F.lit(0)), "page_count": F.coalesce("page_count", F.lit(0))})
            .withColumn("resolvable", F.col("resolvable") & (F.col("boxes") > 0)))


def apply_corrections(fields: DataFrame, corrections: DataFrame, history: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fields after their latest correction, and the newest history rows per field.

    `corrections`: correction_id, field_id, new_value, new_normalized, corrected_by, corrected_at.
    """
    order = ["corrected_at", "correction_id"]
    last = ordered.latest(corrections, ["field_id"], order).select(
        "field_id", F.col("new_value").alias("__v"), F.lit(True).alias("__fixed"))
    last_norm = corrections.groupBy("field_id").agg(
        F.max_by("new_normalized", F.when(F.col("new_normalized").isNotNull(), F.struct(*order))).alias("__n"))
    fixed = F.coalesce("__fixed", F.lit(False))
    current = fields.join(last, "field_id", "left").join(last_norm, "field_id", "left").withColumns({
        "value_text": F.when(fixed, F.col("__v")).otherwise(F.col("value_text")),
        "value_normalized": F.coalesce("__n", "value_normalized"),
        "validation_status": F.when(fixed, "corrected").otherwise(F.col("validation_status")),
    }).drop("__v", "__n", "__fixed")
    chained = ordered.previous(corrections, ["field_id"], order, ["new_value"])
    first = fields.select("field_id", F.col("value_text").alias("__original"))
    rows = chained.join(first, "field_id").withColumn("previous_value", F.coalesce("prev_new_value", "__original")).drop("prev_new_value", "__original")
    newest = ordered.top_n(rows, ["field_id"], [F.col("corrected_at").desc(), F.col("correction_id").desc()], history, split=[ordered.down("corrected_at")])
    return current, newest
