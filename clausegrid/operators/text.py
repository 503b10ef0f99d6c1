"""Document text: pages, offsets, clauses, chunks and context blocks.

A document version is one uploaded file. `page_offsets` moves each page once, to the task of its version, and `assemble` puts the
version's text and its page starts into one row there; headings, clauses and their pages are computed from that row's pieces by
windows over the version, without moving the text again. Nothing is cut or refused by size here: what is to be refused
(`ingest_documents`) becomes a row with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import ordered
from clausegrid.functions import similarity as S
from clausegrid.functions import text as T

OFFSET_BUCKET = 4096
_MARK = "struct<at:bigint,page:int,before:int>"


def page_offsets(pages: DataFrame) -> DataFrame:
    """Normalised pages with their span in whole-document coordinates."""
    norm = pages.withColumn("text", T.normalize_page("text"))
    before = W.partitionBy("dv_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    placed = norm.withColumn("char_start", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)).cast("long"))
    return placed.withColumn("char_end", F.col("char_start") + F.length("text"))


def document_outcome(pages: DataFrame) -> DataFrame:
    """Page count, OCR flag and parse outcome per version, from pages with normalised text."""
    agg = pages.groupBy("dv_id").agg(
        F.count("*").alias("page_count"), F.coalesce(F.bool_or("ocr_derived"), F.lit(False)).alias("has_ocr_pages"),
        F.bool_and(T.is_blank("text")).alias("empty"))
    return agg.select(
        "dv_id", "page_count", "has_ocr_pages",
        F.when(F.col("empty"), "failed").when(F.col("has_ocr_pages"), "degraded").otherwise("succeeded").alias("outcome"),
        F.when(F.col("empty"), "No text could be extracted.").alias("failure_reason"))


def ocr_candidates(pages: DataFrame) -> DataFrame:
    """Pages too short to trust, with the confidence ceiling applied."""
    return (pages.filter(T.ocr_candidate("text"))
            .withColumn("ocr_confidence", F.least(F.col("ocr_confidence"), F.lit(K.OCR_CEILING))))


def _marks(pages: str) -> Column:
    """Starts of the pages that hold text, ascending, each with the page before it."""
    live = F.filter(pages, lambda p: p["char_end"] > p["char_start"])
    return S.let(live, lambda a: F.transform(a, lambda p, i: F.struct(
        p["char_start"].alias("at"), p["page_number"].alias("page"), F.get(a, i - 1)["page_number"].alias("before"))))


def assemble(pages: DataFrame) -> DataFrame:
    """One row per version from offset pages: dv_id, text, and `pages` (page_number, char_start, char_end) in order."""
    parts = F.array_sort(F.collect_list(F.struct(
        "page_number", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "text")))
    return pages.groupBy("dv_id").agg(parts.alias("parts")).select(
        "dv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in ("page_number", "char_start", "char_end")])).alias("pages"))


def _parsed(head: Column) -> tuple[Column, Column, Column, Column]:
    """Section, title and depth of a heading-like line, and whether it is a heading."""
    rx = T.jvm(K.HEADING)
    token = F.regexp_replace(T.trim_ws(F.regexp_extract(head, rx, 1)), r"\.\z", "")
    title = T.trim_ws(F.regexp_extract(head, rx, 2))
    depth = F.size(F.split(token, r"\."))
    return token, title, depth, F.coalesce((depth <= K.HEADING_DEPTH) & (F.length(title) <= K.HEADING_CHARS), F.lit(False))


def _cut(docs: DataFrame) -> DataFrame:
    """`docs` with `gap`, the text between heading-like lines, and `hit`, those lines."""
    rx = T.jvm(K.HEADING)
    return docs.withColumns({"gap": F.split("text", rx, -1), "hit": F.regexp_extract_all("text", F.lit(rx), F.lit(0))})


def _units(cut: DataFrame, marks: Column | None = None) -> DataFrame:
    """The text before every heading-like line as one row; rows concatenate to the text. Clause starts are numbered through the version.

    `marks` (see `_marks`): page starts that come along as rows of their own, without a clause, so that a version's clauses and pages lie together."""
    def unit(gap: Column, i: Column) -> Column:
        head = F.when(i > 0, F.regexp_replace(F.get("hit", i - 1), r"\A\n", ""))
        tail = F.when(F.coalesce(F.get("hit", i).startswith("\n"), F.lit(False)), "\n").otherwise("")
        body = F.concat(F.coalesce(head, F.lit("")), gap, tail)
        return F.struct(head.alias("head"), body.alias("body"), F.lit(None).cast(_MARK).alias("mark"))

    units = F.transform("gap", unit)
    if marks is not None:
        none = F.lit(None).cast("string")
        units = F.concat(units, F.transform(marks, lambda m: F.struct(none.alias("head"), none.alias("body"), m.cast(_MARK).alias("mark"))))
    exploded = cut.select("dv_id", F.posexplode(units).alias("n", "u")).select("dv_id", "n", "u.*")
    token, title, depth, ok = _parsed(F.col("head"))
    doc = W.partitionBy("dv_id").orderBy("n")
    rows = exploded.select("dv_id", "n", "body", token.alias("section_ref"), title.alias("title"), depth.alias("depth"),
                           F.coalesce((F.col("n") > 0) & ok, F.lit(False)).alias("accepted"), "mark")
    is_mark = F.col("mark").isNotNull()
    return rows.withColumns({
        "char_start": F.coalesce(F.col("mark.at"), F.sum(F.length("body").cast("long")).over(doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "clause_no": F.when(~is_mark, F.sum(F.col("accepted").cast("int")).over(doc.rowsBetween(W.unboundedPreceding, 0))),
    })


def headings(docs: DataFrame) -> DataFrame:
    """Numbered headings with their offset."""
    return _units(_cut(docs)).filter("accepted").select("dv_id", "char_start", "section_ref", "title", "depth")


def page_of(spans: DataFrame, pages: DataFrame, offset: str, out: str = "page", ocr_out: str | None = None,
            fallback: str = "last") -> DataFrame:
    """Page holding an offset: equi-join on (version, offset bucket), then the exact range.

    Buckets keep the join from pairing every span with every page of a long document.
    """
    live = pages.filter("char_end > char_start")
    bucketed = live.select(
        F.col("dv_id").alias("__pg_dv"),
        F.explode(F.sequence(F.floor(F.col("char_start") / OFFSET_BUCKET), F.floor((F.col("char_end") - 1) / OFFSET_BUCKET))).alias("__pg_b"),
        F.col("page_number").alias("__pg"), F.col("char_start").alias("__pg_from"), F.col("char_end").alias("__pg_to"),
        F.coalesce(F.col("ocr_derived"), F.lit(False)).alias("__pg_ocr"))
    off = F.col(offset)
    hit = spans.withColumn("__at", F.floor(off / OFFSET_BUCKET)).join(
        bucketed,
        (F.col("dv_id") == F.col("__pg_dv")) & (F.col("__at") == F.col("__pg_b"))
        & (off >= F.col("__pg_from")) & (off < F.col("__pg_to")), "left").drop("__pg_dv", "__pg_b", "__at")
    if fallback == "last":
        last = pages.groupBy("dv_id").agg(F.max("page_number").alias("__final"))
        hit = hit.join(last, "dv_id", "left")
    else:
        hit = hit.withColumn("__final", F.lit(1))
    hit = hit.withColumn(out, F.coalesce("__pg", "__final"))
    if ocr_out:
        hit = hit.withColumn(ocr_out, F.coalesce("__pg_ocr", F.lit(False)))
    return hit.drop("__pg", "__pg_from", "__pg_to", "__pg_ocr", "__final")


def segment(docs: DataFrame) -> DataFrame:
    """Clauses with section, span, pages, type and text, from the rows of `assemble`.

    Clauses and page starts are ordered together by their place in the version: the last start up to a clause's first character is its
    first page, the last one before the next clause's first character its last page. A version without headings has a clause per page.
    """
    cut = _cut(docs)
    numbered = F.exists("hit", lambda h: _parsed(F.regexp_replace(h, r"\A\n", ""))[3])
    with_headings = cut.filter(numbered)
    # clauses and page starts are rows of one table, not of a union, so that the texts need not move again to be ordered together
    both = _units(with_headings, _marks("pages")).groupBy("dv_id", "clause_no", "mark").agg(
        F.min("char_start").alias("char_start"), F.min_by(F.struct("section_ref", "title", "depth"), "n").alias("h"),
        F.array_sort(F.collect_list(F.struct("n", "body"))).alias("parts"))
    both = both.select("dv_id", "clause_no", "char_start", "h", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("text"), "mark")
    up_to = W.partitionBy("dv_id").orderBy("char_start", F.col("clause_no").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("dv_id").orderBy(F.col("char_start").desc(), F.col("clause_no").desc_nulls_last())
    seen = F.last("mark", ignorenulls=True).over(up_to)
    # what the following clause finds before its first character; of the last clause, the last start of the version
    strictly = F.when(F.col("seen.at") == F.col("char_start"), F.col("seen.before")).otherwise(F.col("seen.page"))
    placed = both.withColumn("seen", seen)
    placed = placed.withColumn("edge", F.when(F.col("clause_no").isNotNull(), strictly))
    placed = placed.withColumns({
        "next_edge": F.last(F.when(F.col("clause_no").isNotNull(), F.struct("edge")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)),
        "final": F.max(F.col("mark.page")).over(W.partitionBy("dv_id"))}).filter("clause_no IS NOT NULL")
    is_preamble = F.col("clause_no") == 0
    from_headings = placed.select(
        "dv_id", F.when(~is_preamble, F.col("h.section_ref")).alias("section_ref"),
        F.when(is_preamble, "Preamble").otherwise(F.split(F.col("h.title"), f"[{K.JVM_WS}]{{2,}}").getItem(0)).alias("section_title"),
        F.when(is_preamble, 1).otherwise(F.col("h.depth")).alias("depth"), F.col("seen.page").alias("page_start"),
        F.when(F.col("next_edge").isNull(), F.col("final")).otherwise(F.col("next_edge.edge")).alias("page_end"), "char_start",
        F.when(~is_preamble, T.clause_type(F.col("h.title"), F.col("text"))).alias("clause_type"), "text")
    page = F.col("p.page_number")
    by_page = cut.filter(~numbered).select("dv_id", "text", F.explode("pages").alias("p")).select(
        "dv_id", F.lit(None).cast("string").alias("section_ref"), F.concat(F.lit("Page "), page.cast("string")).alias("section_title"),
        F.lit(1).alias("depth"), page.alias("page_start"), page.alias("page_end"), F.col("p.char_start").alias("char_start"),
        F.lit(None).cast("string").alias("clause_type"),
        F.substr("text", (F.col("p.char_start") + 1).cast("int"), (F.col("p.char_end") - F.col("p.char_start")).cast("int")).alias("text"))
    rows = ordered.stack(from_headings, by_page).filter(~T.is_blank("text"))
    return rows.select(
        F.concat_ws(":", "dv_id", "char_start").alias("clause_id"), "dv_id", "section_ref", "section_title", "depth",
        "page_start", "page_end", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "clause_type", "text")


def segment_outcome(clauses: DataFrame) -> DataFrame:
    """A version without any numbered section is segmented only coarsely."""
    return clauses.groupBy("dv_id").agg(
        F.count("*").alias("clauses"),
        F.when(F.count("section_ref") == 0, "degraded").otherwise("succeeded").alias("outcome"))


def _page_at(pages: Column, offset: Column) -> Column:
    """The last of the pages (sorted by char_start) that begins at or before the offset, by halving; null before the first."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(pages))))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).otherwise(S.let(mid, lambda m: F.when(
            F.get(pages, m)["char_start"] <= offset, F.struct(m.alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), (m - 1).alias("high")))))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), (F.size(pages) - 1).alias("high")), halve)
    return S.let(F.get(pages, found["low"]), lambda p: F.when(p["char_start"] <= offset, p))


def chunk(clauses: DataFrame, pages: DataFrame, target: int = K.CHUNK_WORDS, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping word windows over each clause, numbered through the document.

    The windows of a clause are made inside its row: one running sum over the words gives their true starts, and only the finished windows
    leave the row. Page lookups halve the version's sorted page starts."""
    step = target - overlap
    ws = f"[{K.JVM_WS}]+"
    listed = clauses.withColumns({"raw": F.split("text", ws, -1), "gaps": F.regexp_extract_all("text", F.lit(ws), F.lit(0))})
    listed = listed.withColumns({"w": F.filter("raw", lambda x: x != ""), "lead": F.when(F.get("raw", F.lit(0)) == "", 1).otherwise(0)})
    listed = listed.withColumn("n", F.size("w")).filter("n > 0")

    def chars(parts: str, first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(parts, first + 1, count), F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    def advance(acc: Column, i: Column) -> Column:
        first = F.when(i == 0, 0).otherwise((i - 1) * step + F.col("lead"))
        count = F.when(i == 0, F.col("lead")).otherwise(step)
        here = acc["at"] + chars("raw", first, count) + chars("gaps", first, count)
        return S.let(here, lambda h: F.struct(h.alias("at"), F.array_append(acc["starts"], h).alias("starts")))

    last = F.greatest(F.lit(0), F.ceil((F.col("n") - target) / step)).cast("int")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    listed = listed.withColumn("starts", F.aggregate(F.sequence(F.lit(0), last), empty, advance)["starts"])

    def window(start: Column, i: Column) -> Column:
        first = i * step
        count = F.least(F.lit(target), F.col("n") - first)
        return F.struct(
            i.alias("i"), F.array_join(F.slice("w", first + 1, count), " ").alias("text"), count.alias("token_count"),
            (F.col("char_start") + F.greatest(F.lit(0), F.instr(F.col("text"), F.get("w", first)) - 1)).cast("long").alias("char_start"),
            (F.col("char_start") + start).alias("true_start"))

    rows = listed.select("dv_id", "clause_id", "section_ref", F.col("char_start").alias("clause_start"), F.col("char_end").alias("clause_end"),
                         F.explode(F.transform("starts", window)).alias("x")).select("dv_id", "clause_id", "section_ref", "clause_start", "clause_end", "x.*")
    rows = rows.withColumn("char_end", F.least(F.col("char_start") + F.length("text"), F.col("clause_end")))
    span = F.struct(F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "page_number",
                    F.coalesce(F.col("ocr_derived"), F.lit(False)).alias("ocr"))
    starts = pages.groupBy("dv_id").agg(F.array_sort(F.collect_list(F.when(F.col("char_end") > F.col("char_start"), span))).alias("pages"),
                                        F.max("page_number").alias("final"))
    rows = rows.join(starts, "dv_id")
    seq = (F.row_number().over(W.partitionBy("dv_id").orderBy("clause_start", "i")) - 1).cast("long")
    at, end = _page_at(F.col("pages"), F.col("char_start")), _page_at(F.col("pages"), F.greatest(F.col("char_start"), F.col("char_end") - 1))

    def inside(found: Column, offset: Column, value: Column, other: Column) -> Column:
        return S.let(found, lambda p: F.when(p.isNotNull() & (offset < p["char_end"]), value(p)).otherwise(other))

    rows = rows.withColumns({
        "page_start": inside(at, F.col("char_start"), lambda p: p["page_number"], F.col("final")),
        "ocr_derived": inside(at, F.col("char_start"), lambda p: p["ocr"], F.lit(False)),
        "page_end": inside(end, F.greatest(F.col("char_start"), F.col("char_end") - 1), lambda p: p["page_number"], F.col("final"))})
    return rows.drop("pages").withColumn("seq", seq).select(
        F.concat_ws("-", "dv_id", "seq").alias("chunk_id"), "dv_id", "clause_id", "seq", "page_start", "page_end",
        "char_start", "char_end", "true_start", "section_ref", "ocr_derived", "token_count", "text")


def language_gate(docs: DataFrame, lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Versions that go on, and versions refused with a reason."""
    ok = F.coalesce(F.col(lang) == "en", F.lit(False))
    refused = docs.filter(~ok).withColumn("status", F.lit("failed")).withColumn(
        "failure_reason", F.concat(F.lit("Unsupported language: "), F.coalesce(F.col(lang), F.lit("unknown"))))
    return docs.filter(ok), refused


def assemble_context(clauses: DataFrame, stage: str, docs: DataFrame | None = None, clause_limit: int | None = None, chars: int | None = None) -> DataFrame:
    """Context block per version: the clauses that match the stage's pattern, in text order and wrapped.

    The field stage looks at numbered sections only and falls back to the document (`docs`) when fewer than three match. A model with a
    small window passes `clause_limit` and `chars` (K.CONTEXT_BOUNDS); without them everything that matches is given whole.
    """
    pattern = K.CONTEXT_STAGES[stage]
    title = F.concat(F.coalesce("section_title", F.lit("")), F.lit(" "), F.col("text"))
    rows = clauses
    if stage == "extract":
        rows = rows.filter(F.col("section_ref").isNotNull())
    rows = rows.filter(T.any_word(F.col("text") if stage == "obligations" else title, pattern))
    rows = rows.select("dv_id", "char_start", "page_start", "section_ref", (F.substring("text", 1, chars) if chars else F.col("text")).alias("text"))
    kept = ordered.top_n(rows, ["dv_id"], [F.col("char_start")], clause_limit) if clause_limit else rows
    block = F.concat(
        F.lit('<page page="'), F.col("page_start").cast("string"), F.lit('" section="'), F.coalesce("section_ref", F.lit("")),
        F.lit('">\n'), F.col("text"), F.lit("\n</page>"))
    agg = kept.groupBy("dv_id").agg(
        F.array_sort(F.collect_list(F.struct("char_start", block.alias("b"), F.coalesce("section_ref", F.lit("")).alias("s")))).alias("x"))
    out = agg.select(
        "dv_id", F.size("x").alias("hits"), F.array_join(F.transform("x", lambda r: r["b"]), "\n").alias("context"),
        F.array_join(F.transform("x", lambda r: r["s"]), ",").alias("sections"))
    if stage != "extract" or docs is None:
        return out
    few = F.coalesce("hits", F.lit(0)) < K.CONTEXT_MIN_HITS
    return docs.select("dv_id", F.col("text").alias("start")).join(out, "dv_id", "left").select(
        "dv_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(few, F.col("start")).otherwise(F.col("context")).alias("context"),
        F.coalesce("sections", F.lit("")).alias("sections"))
