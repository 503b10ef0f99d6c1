"""Comparison of document versions: which versions, clause alignment, changed pairs and change rows.

Clauses carry pair_id (one base and one target version), clause_id, char_start,
section_ref and text; `ord` is the text order.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import ordered
from clausegrid.functions import similarity as S
from clausegrid.functions import text as T
from clausegrid.operators.citations import resolve_citations
from clausegrid.operators.text import page_of
from clausegrid.session import unwrite, written

#: Distinct base texts of one comparison that meet its target texts in one place.
BLOCK = 256


def consecutive_versions(versions: DataFrame) -> DataFrame:
    """Every version of a contract with the one before it: pair_id, contract_id, base_id, target_id, base_version, target_version.

    `versions`: contract_id, dv_id, version_number."""
    order = W.partitionBy("contract_id").orderBy("version_number", "dv_id")
    rows = versions.select("contract_id", "dv_id", "version_number", F.lag(F.struct("dv_id", "version_number")).over(order).alias("base"))
    return rows.filter(F.col("base").isNotNull()).select(
        F.concat_ws(">", F.col("base.dv_id"), F.col("dv_id")).alias("pair_id"), "contract_id", F.col("base.dv_id").alias("base_id"),
        F.col("dv_id").alias("target_id"), F.col("base.version_number").alias("base_version"), F.col("version_number").alias("target_version"))


def start_comparisons(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """What becomes of requested comparisons: `action` is refused (versions of different contracts or a missing one), reuse (a comparison
    that did not fail exists), restart (one failed) or create.

    `wanted`: base_id, target_id, base_contract_id, target_contract_id; `existing`: comparison_id, base_id, target_id, status."""
    known = ordered.latest(existing, ["base_id", "target_id"], ["comparison_id"])
    same = F.coalesce(F.col("base_contract_id") == F.col("target_contract_id"), F.lit(False))
    found = F.col("comparison_id").isNotNull()
    return wanted.join(known, ["base_id", "target_id"], "left").select(
        "base_id", "target_id", F.when(same, F.col("comparison_id")).alias("comparison_id"),
        F.when(~same, "refused").when(found & (F.col("status") != "failed"), "reuse").when(found, "restart").otherwise("create").alias("action"),
        F.when(same, F.when(found & (F.col("status") != "failed"), F.col("status")).otherwise("computing")).alias("status"))


def form_of(text: Column | str) -> Column:
    """Digest of the normalised text: 16 bytes of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(T.normalize_for_compare(text), "UTF-8"), 256), 1, 32))


def _text(chars: int | None) -> Column:
    return F.substring("text", 1, chars) if chars else F.col("text")


def _formed(clauses: DataFrame, chars: int | None) -> DataFrame:
    """Clauses with `form` (see `form_of`) and `size`, the length of the normalised text, unless they bring them along."""
    if {"form", "size"} <= set(clauses.columns) and not chars:
        return clauses
    return clauses.withColumns({"form": form_of(_text(chars)), "size": F.length(T.normalize_for_compare(_text(chars)))})


def _classes(clauses: DataFrame, chars: int | None) -> DataFrame:
    """Clauses with `class`, one id for all clauses of a comparison with the same normalised text, and that text on the class's own row.

    Clauses that bring that text's digest along (`form`, see `form_of`) are classed by it, so that what needs the classes only moves no texts."""
    rows = clauses if "form" in clauses.columns and not chars else clauses.withColumn("form", form_of(_text(chars)))
    rows = rows.withColumn("class", F.min("clause_id").over(W.partitionBy("pair_id", "form"))).drop("form")
    if "text" not in clauses.columns:
        return rows
    return rows.withColumn("norm", F.when(F.col("class") == F.col("clause_id"), T.normalize_for_compare(_text(chars))))


def _similar_classes(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """pair_id, base_class, target_class, score of the distinct texts with dice above the threshold.

    Two texts whose dice exceeds t have bigram counts whose ratio is above t / (2 - t), which is tested before they are counted; the base texts
    of a large comparison lie in blocks, which the target texts visit. One batched count of bigrams scores them. Where both sides bring them,
    a class whose first place (`first`) is not before the place from which on the other is taken (`until`) is not scored."""
    def texts(rows: DataFrame, name: str, bound: str) -> DataFrame:
        bounds = [F.col(bound)] if bound in rows.columns else []
        return rows.filter("norm IS NOT NULL").select(
            "pair_id", F.col("class").alias(name), F.col("norm").alias(f"{name}_norm"), (F.length("norm") - 1).alias(f"{name}_grams"), *bounds)

    a, b = texts(left, "base_class", "first"), texts(right, "target_class", "until")
    blocks = a.groupBy("pair_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    a = a.join(blocks, "pair_id").withColumn("block", F.pmod(F.xxhash64("base_class"), F.col("blocks")).cast("int")).drop("blocks")
    b = b.join(blocks, "pair_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    na, nb = F.col("base_class_grams"), F.col("target_class_grams")
    near = a.join(b, ["pair_id", "block"]).filter(
        (F.col("base_class_norm") == F.col("target_class_norm")) | (2 * F.least(na, nb) > threshold * (na + nb)))
    if "first" in a.columns and "until" in b.columns:
        near = near.filter(F.col("until").isNull() | (F.col("until") > F.col("first")))
    scored = near.withColumn("score", S.dice_batched(F.col("base_class_norm"), F.col("target_class_norm")))
    return scored.filter(F.col("score") > threshold).select("pair_id", "base_class", "target_class", "score")


def _edges(left: DataFrame, right: DataFrame, base: DataFrame, target: DataFrame, threshold: float, chars: int | None) -> DataFrame:
    """`_similar_classes` of clauses without texts (pair_id, clause_id, class, form, size; ord on the left, until on the right, if known), whose texts
    are looked up in `base` and `target` for those classes alone that another one can be similar to by its length and place."""
    width = math.log((2 - threshold) / threshold)
    grams = F.col("size") - 1
    band = F.when(grams < 1, -9).otherwise(F.floor(F.log(grams.cast("double")) / width)).cast("int")
    placed = "ord" in left.columns and "until" in right.columns
    first = [F.min("ord").alias("first")] if placed else []
    until = [F.when(F.count("until") == F.count("*"), F.max("until")).alias("until")] if placed else []
    key = ["pair_id", "class"]
    a = left.groupBy(*key).agg(F.first("form").alias("a_form"), F.first("size").alias("a_size"), *first)
    b = right.groupBy(*key).agg(F.first("form").alias("form"), F.first("size").alias("size"), *until).withColumn("band", band)
    near = a.withColumn("size", F.col("a_size")).withColumn("band", F.explode(F.array(band - 1, band, band + 1))).select(
        "pair_id", "band", "a_form", "a_size", *(["first"] if placed else []))
    na, nb = F.col("a_size") - 1, F.col("size") - 1
    can = (F.col("a_form") == F.col("form")) | (2 * F.least(na, nb) > threshold * (na + nb))
    if placed:
        can = can & (F.col("until").isNull() | (F.col("until") > F.col("first")))
    x, y = near.alias("x"), b.alias("y")
    b = y.join(x, (F.col("x.pair_id") == F.col("y.pair_id")) & (F.col("x.band") == F.col("y.band")) & can, "left_semi").select("y.*")

    def with_text(classes: DataFrame, source: DataFrame, *bound: str) -> DataFrame:
        ids = classes.select("pair_id", "class", F.col("class").alias("clause_id"), *bound)
        by = [c for c in ("pair_id", "clause_id") if c in source.columns]
        return ids.join(source.select(*by, "text"), by).select(*key, *bound, T.normalize_for_compare(_text(chars)).alias("norm"))

    return _similar_classes(with_text(a, base, *(["first"] if placed else [])), with_text(b, target, *(["until"] if placed else [])), threshold)


def _ids(clauses: DataFrame, *others: str) -> DataFrame:
    """The clauses' ids, classes, digests and lengths, without their texts."""
    marked = clauses.withColumn("__form", F.col("form")).select("pair_id", "clause_id", "form", "__form", "size", *others)
    return _classes(marked, None).withColumnRenamed("__form", "form")


def similar_clauses(left: DataFrame, right: DataFrame, threshold: float = K.ALIGN_THRESHOLD, chars: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Clause pairs of one comparison with dice above the threshold: pair_id, base_id, target_id, score. Equal texts are scored once.

    Where the left side has a place (`ord`) and the right one `until`, a place from which on it is taken, pairs beyond that are left out.
    Sides that bring `form` and `size` need no text of their own: `texts` (clause_id, text) has them."""
    left, right = _formed(left, chars), _formed(right, chars)
    place = [c for c in ("ord",) if c in left.columns and "until" in right.columns]
    until = [c for c in ("until",) if place]
    a, b = written(_ids(left, *place)), written(_ids(right, *until))
    edges = written(_edges(a, b, left if texts is None else texts, right if texts is None else texts, threshold, chars))
    found = (edges.join(a.select("pair_id", F.col("class").alias("base_class"), F.col("clause_id").alias("base_id"), *place), ["pair_id", "base_class"])
             .join(b.select("pair_id", F.col("class").alias("target_class"), F.col("clause_id").alias("target_id"), *until), ["pair_id", "target_class"]))
    if place:
        found = found.filter("until IS NULL OR until > ord")
    return found.select("pair_id", "base_id", "target_id", "score")


_MATCH = pa.schema([("base_id", pa.string()), ("target_id", pa.string())])


def _walk(rows: pa.Table) -> pa.Table:
    """One comparison: every base in text order takes the best target that is still free for it.

    Targets of one text are a queue in text order; a target that is used, or kept for an earlier base from some place on, never becomes free
    again, so every queue is only ever read forward."""
    edges, queues, bases = defaultdict(list), defaultdict(list), []
    for kind, own, other, place, until, score in zip(*(rows.column(c).to_pylist() for c in ("kind", "id", "class", "ord", "until", "score"))):
        if kind == "edge":
            edges[own].append((-score, other))
        elif kind == "target":
            queues[other].append((place, own, until))
        else:
            bases.append((place, own, other))
    for e in edges.values():
        e.sort()
    for q in queues.values():
        q.sort(key=lambda t: (-t[0], t[1]))  # the first in text order at the end; of one place the greatest id
    found = []
    for place, base, text in sorted(bases):
        best, choices = None, edges[text]
        for negative, target_text in choices:
            if best is not None and negative > best[0]:
                break
            queue = queues[target_text]
            while queue and queue[-1][2] is not None and queue[-1][2] <= place:
                queue.pop()
            if queue and (best is None or queue[-1][0] < best[1]):
                best = (negative, queue[-1][0], target_text)
        if best:
            found.append((base, queues[best[2]].pop()[1]))
        edges[text] = [c for c in choices if queues[c[1]]]
    return pa.Table.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*found)) or [(), ()])], schema=_MATCH)


def greedy_matches(bases: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """One-to-one matching in base order: each base takes its best target still free; base_id, target_id.

    `bases`: pair_id, base_id, class, ord; `targets`: pair_id, target_id, class, ord, until (a place from which on the target is not free);
    `edges`: pair_id, base_class, target_class, score. The walk depends on all earlier choices, so a comparison is one group: ids and
    places of the clauses of two versions, without texts, and one edge for each two similar texts."""
    def rows(df: DataFrame, kind: str, own: str, other: str, place: Column, until: Column, score: Column) -> DataFrame:
        return df.select("pair_id", F.lit(kind).alias("kind"), F.col(own).cast("string").alias("id"), F.col(other).cast("string").alias("class"),
                         place.cast("long").alias("ord"), until.cast("long").alias("until"), score.cast("double").alias("score"))

    null = F.lit(None)
    with_edge = edges.select("pair_id").distinct()
    every = ordered.stack(
        rows(edges, "edge", "base_class", "target_class", null, null, F.col("score")),
        rows(bases.join(edges.select("pair_id", F.col("base_class").alias("class")).distinct(), ["pair_id", "class"], "left_semi"), "base", "base_id", "class", F.col("ord"), null, null),
        rows(targets.join(with_edge, "pair_id", "left_semi"), "target", "target_id", "class", F.col("ord"), F.col("until"), null))
    return every.groupBy("pair_id").applyInArrow(_walk, "base_id string, target_id string")


def align_clauses(base: DataFrame, target: DataFrame, chars: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Pairs of clauses: same section first, then greedy by similarity; leftovers are one-sided.

    Output: pair_id, base_id, target_id, base_ord, how (section, similar, removed, added). `chars`: compare only so many characters.
    Ids, digests and lengths are aligned; a text moves only if its class has to be scored. Sides that bring `form` and `size` need no text of
    their own: `texts` (clause_id, text) has them.
    """
    base, target = _formed(base, chars), _formed(target, chars)
    b = base.select("pair_id", F.col("clause_id").alias("base_id"), F.col("char_start").alias("base_ord"), "section_ref", "form", "size")
    by_ref = target.filter(F.col("section_ref").isNotNull()).groupBy("pair_id", "section_ref").agg(
        F.max_by("clause_id", F.struct("char_start", "clause_id")).alias("target_id"))
    joined = written(b.join(by_ref, ["pair_id", "section_ref"], "left"))
    same = joined.filter(F.col("target_id").isNotNull()).select("pair_id", "base_id", "base_ord", "target_id")
    taken = same.groupBy("pair_id", F.col("target_id").alias("clause_id")).agg(F.min("base_ord").alias("until"))
    left = written(_ids(joined.filter(F.col("target_id").isNull()).select("pair_id", F.col("base_id").alias("clause_id"), F.col("base_ord").alias("ord"), "form", "size"), "ord"))
    offered = target.select("pair_id", "clause_id", F.col("char_start").alias("ord"), "form", "size").join(left.select("pair_id").distinct(), "pair_id", "left_semi")
    right = written(_ids(offered.join(taken, ["pair_id", "clause_id"], "left"), "ord", "until"))
    edges = written(_edges(left, right, base if texts is None else texts, target if texts is None else texts, K.ALIGN_THRESHOLD, chars))
    similar = written(greedy_matches(
        left.select("pair_id", F.col("clause_id").alias("base_id"), "class", "ord"),
        right.select("pair_id", F.col("clause_id").alias("target_id"), "class", "ord", "until"), edges))
    unwrite(left, right, edges)
    b = joined.select("pair_id", "base_id", "base_ord")
    matched = written(ordered.stack(same.withColumn("how", F.lit("section")), similar.join(b, "base_id").select(
        "pair_id", "base_id", "base_ord", "target_id").withColumn("how", F.lit("similar"))))
    used = matched.select("target_id").distinct()
    b_side = b.join(matched.select("base_id", "target_id", "how"), "base_id", "left")
    added = target.select("pair_id", F.col("clause_id").alias("target_id"), F.col("char_start").alias("base_ord")).join(
        used, "target_id", "left_anti").withColumns({"base_id": F.lit(None).cast("string"), "how": F.lit("added")})
    aligned = written(ordered.stack(b_side.withColumn("how", F.coalesce("how", F.lit("removed"))), added))
    unwrite(joined, similar, matched)
    return aligned


def with_texts(aligned: DataFrame, base: DataFrame, target: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Aligned pairs with the columns of both clauses (b_*, t_*).

    With `texts` (clause_id, text), for sides that bring `form` instead of their texts, only the rows that can be changes: one-sided clauses and
    pairs whose normalised texts differ. The others' texts are not looked up."""
    cols = ["dv_id", "section_ref", "section_title", "char_start", "char_end", "text" if texts is None else "form"]
    b = base.select(F.col("clause_id").alias("base_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    t = target.select(F.col("clause_id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in cols])
    both = aligned.join(b, "base_id", "left").join(t, "target_id", "left")
    if texts is None:
        return both
    both = written(both.filter(~F.col("b_form").eqNullSafe(F.col("t_form"))).drop("b_form", "t_form"))
    return (both.join(texts.select(F.col("clause_id").alias("base_id"), F.col("text").alias("b_text")), "base_id", "left")
            .join(texts.select(F.col("clause_id").alias("target_id"), F.col("text").alias("t_text")), "target_id", "left"))


def changed_pairs(pairs: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Matched pairs whose texts really differ, in text order with their rank per comparison, and per comparison the total
    with its completeness: `partial` where a `limit` leaves some out."""
    both = pairs.filter(F.col("base_id").isNotNull() & F.col("target_id").isNotNull())
    differ = both.filter(T.collapse_lower("b_text") != T.collapse_lower("t_text"))
    differ = differ.withColumn("__dice", S.dice_batched(T.normalize_for_compare("b_text"), T.normalize_for_compare("t_text")))
    differ = differ.filter(F.col("__dice") < K.CHANGED_BELOW).drop("__dice")
    over = F.lit(False) if limit is None else F.col("changed") > limit
    totals = differ.groupBy("pair_id").agg(F.count("*").alias("changed")).withColumn("status", F.when(over, "partial").otherwise("ready"))
    return ordered.top_n(differ, ["pair_id"], [F.col("base_ord"), F.col("base_id")], limit), totals


def _resolve(rows: DataFrame, side: str, quote: Column, pages: DataFrame) -> DataFrame:
    """Citations of a clause that resolve. Without an own quote a clause is cited by what its first page holds of it."""
    spans = rows.select("change_id", F.col(f"{side}_dv_id").alias("dv_id"), F.col(f"{side}_char_start").cast("int").alias("char_start"),
                        F.col(f"{side}_char_end").cast("int").alias("char_end"), quote.alias("quoted_text"), F.col(f"{side}_text").alias("clause_text"))
    placed = page_of(spans, pages, "char_start", "page", fallback="first")
    ends = pages.select("dv_id", F.col("page_number").alias("page"), F.col("char_end").cast("int").alias("page_end"))
    placed = placed.join(ends, ["dv_id", "page"])
    on_page = F.substr("clause_text", F.lit(1), F.greatest(F.lit(0), F.col("page_end") - F.col("char_start")))
    placed = placed.withColumns({"quoted_text": F.coalesce("quoted_text", on_page), "char_end": F.least("char_end", "page_end")}).drop("clause_text", "page_end")
    return resolve_citations(placed, pages, global_spans=True).filter("resolvable").select(
        "change_id", F.concat_ws("#", "change_id", F.lit(side)).alias(f"{side}_citation_id"))


CHANGE_COLUMNS = ["change_id", "pair_id", "change_type", "impact_category", "is_material", "clause_ref", "before_text", "after_text", "business_impact",
                  "risk_delta", "suggested_reviewer_role", "base_citation_id", "target_citation_id", "confidence"]


def build_changes(listed: DataFrame, labels: DataFrame, one_sided: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Change rows (CHANGE_COLUMNS): labelled pairs whose impact text is clean and whose two spans resolve, and
    added or removed clauses with one span.

    `labels`: pair_id, rank, change_type, impact_category, is_material, business_impact,
    before_text, after_text (quotes, or null), risk_delta, suggested_reviewer_role, self_confidence.
    """
    named = listed.join(labels.filter(T.lint_clean("business_impact")), ["pair_id", "rank"]).withColumn(
        "change_id", F.concat_ws("/", "pair_id", "rank"))
    before, after = _resolve(named, "b", F.col("before_text"), pages), _resolve(named, "t", F.col("after_text"), pages)
    modified = named.join(before, "change_id").join(after, "change_id").select(
        "change_id", "pair_id", "change_type", "impact_category", "is_material", F.col("b_section_ref").alias("clause_ref"), "before_text", "after_text",
        "business_impact", "risk_delta", "suggested_reviewer_role", F.col("b_citation_id").alias("base_citation_id"),
        F.col("t_citation_id").alias("target_citation_id"), F.col("self_confidence").cast("double").alias("confidence"))
    top = ordered.top_n(one_sided.filter(F.col("how").isin("added", "removed")), ["pair_id"], [
        F.when(F.col("how") == "removed", 0).otherwise(1), F.col("base_ord"), F.coalesce("base_id", "target_id")], limit)
    is_new = F.col("how") == "added"
    top = top.withColumns({
        "change_id": F.concat_ws("/", "pair_id", "how", "rank"),
        **{f"x_{c}": F.when(is_new, F.col(f"t_{c}")).otherwise(F.col(f"b_{c}")) for c in ["dv_id", "section_ref", "section_title", "char_start", "char_end", "text"]}})
    found = _resolve(top, "x", F.lit(None).cast("string"), pages)
    alone = top.join(found, "change_id").select(
        "change_id", "pair_id", F.col("how").alias("change_type"), F.coalesce(T.clause_type("x_section_title", "x_text"), F.lit("cosmetic")).alias("impact_category"),
        F.lit(True).alias("is_material"), F.col("x_section_ref").alias("clause_ref"),
        F.when(~is_new, F.col("x_text")).alias("before_text"), F.when(is_new, F.col("x_text")).alias("after_text"),
        F.when(is_new, "A clause was added in this version.").otherwise("A clause was removed in this version.").alias("business_impact"),
        F.lit("unchanged").alias("risk_delta"), F.lit("legal").alias("suggested_reviewer_role"),
        F.when(~is_new, F.col("x_citation_id")).alias("base_citation_id"), F.when(is_new, F.col("x_citation_id")).alias("target_citation_id"),
        F.lit(0.8).alias("confidence"))
    return ordered.stack(modified, alone).select(*CHANGE_COLUMNS)


def list_changes(changes: DataFrame) -> DataFrame:
    """Changes of every comparison with their place in its list: material ones first, then by category."""
    return ordered.top_n(changes, ["pair_id"], [F.col("is_material").desc(), F.col("impact_category"), F.col("change_id")], None, "place")


def summarize_comparisons(changes: DataFrame, totals: DataFrame) -> DataFrame:
    """Material and cosmetic counts per comparison with its completeness."""
    counts = changes.groupBy("pair_id").agg(
        F.count_if("is_material").alias("material"), F.count_if(~F.col("is_material")).alias("cosmetic"))
    return (totals.join(counts, "pair_id", "full_outer").select(
        "pair_id", F.coalesce("material", F.lit(0)).alias("material"), F.coalesce("cosmetic", F.lit(0)).alias("cosmetic"),
        F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce("status", F.lit("ready")).alias("status")))
