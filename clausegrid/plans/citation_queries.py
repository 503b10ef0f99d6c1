"""Registered queries: similarity, citations, field validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import ordered
from clausegrid.functions import similarity as S
from clausegrid.functions import text as T
from clausegrid.operators import citations as C
from clausegrid.plans import date_queries as DQ
from clausegrid.plans import entities as E
from clausegrid.plans import sqltext as Q
from clausegrid.plans import text_queries as TQ
from clausegrid.plans.entities import CTE, with_ctes
from clausegrid.session import cut_lineage

QUERIES: dict = {}
SPAN = ("struct<page:int,section_ref:string,section_title:string,char_start:int,char_end:int,quoted_text:string>")


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def version_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.contract_texts(spark, d).groupBy("contract_id").agg(
        F.max(F.when(F.col("version_number") == 1, F.col("text"))).alias("a"),
        F.max(F.when(F.col("version_number") == 2, F.col("text"))).alias("b"))


CTE["version_pairs"] = (["contract_texts"], f"""
SELECT contract_id, {Q.norm_compare("max(text) FILTER (WHERE version_number = 1)")} AS na, {Q.norm_compare("max(text) FILTER (WHERE version_number = 2)")} AS nb FROM contract_texts GROUP BY contract_id""")


@_register("c01_dice", with_ctes(["version_pairs"], "SELECT contract_id, round(score, 6) AS score FROM (" + Q.dice_table("version_pairs", "contract_id", "na", "nb") + ")"))
def c01(spark, d):
    return S.dice_table(version_pairs(spark, d), "contract_id", "a", "b").withColumn("score", F.round("score", 6))


@_register("c02_overlap", f"""
SELECT conv_id, turn, round(CASE WHEN len(wc) = 0 THEN 0.0 ELSE len(list_intersect(wc, we)) / len(wc) END, 6) AS overlap,
       CASE WHEN len(wc) = 0 THEN false ELSE len(list_intersect(wc, we)) / len(wc) >= 0.5 END AS grounded
FROM (SELECT conv_id, turn, {Q.content_words('text')} AS wc, {Q.content_words('prev_text')} AS we
      FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text FROM conversations) WHERE prev_text IS NOT NULL)""")
def c02(spark, d):
    turns = ordered.previous(E.table(spark, d, "conversations"), ["conv_id"], ["turn"], ["text"])
    return turns.filter("prev_text IS NOT NULL").select(
        "conv_id", "turn", F.round(S.lexical_overlap("text", "prev_text"), 6).alias("overlap"), S.grounded("text", "prev_text").alias("grounded"))


# ------------------------------------------------------------------ evidence: one quote per contract page, in six variants

def evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = cut_lineage(TQ.pages(spark, d))
    return cut_lineage(evidence_of(p)), p


def evidence_of(p: DataFrame) -> DataFrame:
    n = F.length("text")
    dv, pg = F.col("dv_id"), F.col("page_number")
    start = ((dv * 31 + pg * 17) % F.greatest(n - 200, F.lit(1))).cast("int")
    size = (dv % 40 + 60).cast("int")
    quote = F.substr("text", start + 1, size)
    v = (dv + pg) % 6
    quoted = (F.when(v == 2, F.translate(quote, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(v == 3, F.concat(F.lit(" "), F.replace(quote, F.lit(" "), F.lit("  "))))
              .when(v == 4, F.concat(F.substr(quote, F.lit(1), F.lit(20)), F.substr(quote, F.lit(29), F.lit(1000))))
              .when(v == 5, E.concat("zq ", dv, " xj wholly unrelated kvq ", pg, " pzzx")).otherwise(quote))
    shift = F.when(v == 0, 0).when(v == 2, F.when(dv % 4 == 0, 15).otherwise(0)).otherwise(25)
    return p.filter(n > 0).select(
        F.concat_ws(":", "dv_id", "page_number").alias("citation_id"), "dv_id", F.col("page_number").alias("page"), v.alias("variant"),
        (start + shift).cast("int").alias("char_start"), (start + size + shift).cast("int").alias("char_end"), quoted.alias("quoted_text"))


CTE["evidence"] = (["pages_o"], """
SELECT dv_id || ':' || page AS citation_id, dv_id, page, variant, st + shift AS char_start, st + size + shift AS char_end, ptext, ocr_derived,
       CASE variant WHEN 2 THEN translate(quote, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 3 THEN ' ' || replace(quote, ' ', '  ') WHEN 4 THEN substr(quote, 1, 20) || substr(quote, 29, 1000)
            WHEN 5 THEN 'zq ' || dv_id || ' xj wholly unrelated kvq ' || page || ' pzzx' ELSE quote END AS quoted_text
FROM (SELECT *, substr(ptext, st + 1, size) AS quote, CASE variant WHEN 0 THEN 0 WHEN 2 THEN CASE WHEN dv_id % 4 = 0 THEN 15 ELSE 0 END ELSE 25 END AS shift
      FROM (SELECT dv_id, page_number AS page, text AS ptext, ocr_derived, (dv_id + page_number) % 6 AS variant,
                   CAST((dv_id * 31 + page_number * 17) % greatest(length(text) - 200, 1) AS INTEGER) AS st, CAST(dv_id % 40 + 60 AS INTEGER) AS size FROM pages_o WHERE length(text) > 0))""")


def _resolution(prefix: str, source: str) -> None:
    """SQL steps of citation resolution over `source`, written relationally."""
    CTE[f"{prefix}_norm"] = ([source], f"""
SELECT *, {Q.norm_compare("substr(ptext, char_start + 1, char_end - char_start)")} AS na, {Q.norm_compare('quoted_text')} AS nb,
       lower(translate(ptext, '‘’“”–—' || chr(10), '''''""-- ')) AS np FROM {source}""")
    CTE[f"{prefix}_own"] = ([f"{prefix}_norm"], Q.dice_table(f"{prefix}_norm", "citation_id", "na", "nb"))
    CTE[f"{prefix}_weak"] = ([f"{prefix}_norm", f"{prefix}_own"], f"""
SELECT n.*, o.score AS own, instr(ptext, quoted_text) - 1 AS exact_at,
       CASE WHEN nb <> '' AND instr(ptext, quoted_text) = 0 THEN list_filter(range(0, greatest(length(np) - length(nb) + 1, 0)), lambda i: substr(np, i + 1, length(nb)) = nb) ELSE [] END AS loose
FROM {prefix}_norm n JOIN {prefix}_own o USING (citation_id) WHERE o.score < 0.92""")
    CTE[f"{prefix}_loose"] = ([f"{prefix}_weak"], f"""
SELECT citation_id, arg_min(s, (abs(s - char_start), s)) AS s, any_value(length(nb)) AS z FROM (SELECT *, unnest(loose) AS s FROM {prefix}_weak WHERE exact_at < 0) GROUP BY citation_id""")
    CTE[f"{prefix}_grid"] = ([f"{prefix}_weak"], f"""
SELECT citation_id || '/' || s || '/' || k AS wid, citation_id, s, k, z, {Q.norm_compare('substr(ptext, CAST(s AS INTEGER) + 1, CAST(z AS INTEGER))')} AS na, nb
FROM (SELECT *, unnest(range(1, 4)) AS k, CAST(CASE unnest(range(1, 4)) WHEN 1 THEN span WHEN 2 THEN floor(span * 0.8::DOUBLE) ELSE ceil(span * 1.25::DOUBLE) END AS BIGINT) AS z
      FROM (SELECT *, unnest(range(0, length(ptext) - span + 1, greatest(20, span // 4))) AS s
            FROM (SELECT *, greatest(length(quoted_text), 40) AS span FROM {prefix}_weak WHERE exact_at < 0 AND len(loose) = 0 AND nb <> '')))
WHERE s + z <= length(ptext)""")
    CTE[f"{prefix}_fuzzy"] = ([f"{prefix}_grid"], f"""
SELECT g.citation_id, arg_max(g.s, (d.score, -g.s, -g.k)) AS s, arg_max(g.z, (d.score, -g.s, -g.k)) AS z, max(d.score) AS score
FROM {prefix}_grid g JOIN ({Q.dice_table(f"{prefix}_grid", "wid", "na", "nb")}) d USING (wid) GROUP BY g.citation_id HAVING max(d.score) >= 0.5""")
    CTE[f"{prefix}_resolved"] = ([f"{prefix}_norm", f"{prefix}_own", f"{prefix}_weak", f"{prefix}_loose", f"{prefix}_fuzzy"], f"""
SELECT *, score >= 0.92 AS resolvable, CASE WHEN score >= 0.92 THEN coalesce(hit_start, char_start) ELSE char_start END AS final_start,
       CASE WHEN score >= 0.92 THEN coalesce(hit_end, char_end) ELSE char_end END AS final_end
FROM (SELECT n.* EXCLUDE (na, nb, np), CASE WHEN w.citation_id IS NULL THEN o.score WHEN w.exact_at >= 0 THEN 1.0::DOUBLE WHEN l.citation_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(f.score, o.score) END AS score,
             CASE WHEN w.exact_at >= 0 THEN w.exact_at WHEN l.citation_id IS NOT NULL THEN l.s ELSE f.s END AS hit_start,
             CASE WHEN w.exact_at >= 0 THEN w.exact_at + length(n.quoted_text) WHEN l.citation_id IS NOT NULL THEN l.s + l.z ELSE f.s + f.z END AS hit_end
      FROM {prefix}_norm n JOIN {prefix}_own o USING (citation_id) LEFT JOIN {prefix}_weak w USING (citation_id) LEFT JOIN {prefix}_loose l USING (citation_id) LEFT JOIN {prefix}_fuzzy f USING (citation_id))""")


_resolution("ev", "evidence")


@_register("c03_find_slice", with_ctes(["ev_weak", "ev_loose", "ev_fuzzy"], """
SELECT w.citation_id, CAST(CASE WHEN exact_at >= 0 THEN exact_at WHEN l.citation_id IS NOT NULL THEN l.s ELSE f.s END AS INTEGER) AS hit_start,
       CAST(CASE WHEN exact_at >= 0 THEN exact_at + length(quoted_text) WHEN l.citation_id IS NOT NULL THEN l.s + l.z ELSE f.s + f.z END AS INTEGER) AS hit_end,
       round(CASE WHEN exact_at >= 0 OR l.citation_id IS NOT NULL THEN 1.0 ELSE f.score END, 6) AS score
FROM ev_weak w LEFT JOIN ev_loose l USING (citation_id) LEFT JOIN ev_fuzzy f USING (citation_id)"""))
def c03(spark, d):
    ev, p = evidence(spark, d)
    rows = ev.join(p.select("dv_id", F.col("page_number").alias("page"), F.col("text").alias("ptext")), ["dv_id", "page"])
    own = F.substr("ptext", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    rows = rows.withColumn("own", S.dice_batched(T.normalize_for_compare(own), T.normalize_for_compare("quoted_text")))
    weak = rows.filter(F.col("own") < K.CITATION_THRESHOLD)
    return (weak.withColumn("hit", C.find_slice("ptext", "quoted_text", "char_start"))
            .select("citation_id", F.col("hit.start").alias("hit_start"), F.col("hit.end").alias("hit_end"), F.round("hit.score", 6).alias("score")))


@_register("c04_resolve_citations", with_ctes(["ev_resolved"], """
SELECT citation_id, dv_id, page, CAST(final_start AS INTEGER) AS char_start, CAST(final_end AS INTEGER) AS char_end, quoted_text, round(score, 6) AS match_confidence, resolvable, ocr_derived FROM ev_resolved"""))
def c04(spark, d):
    out = C.resolve_citations(*evidence(spark, d))
    return out.select("citation_id", "dv_id", "page", "char_start", "char_end", "quoted_text", F.round("match_confidence", 6).alias("match_confidence"), "resolvable", "ocr_derived")


# ------------------------------------------------------------------ numbers, phrases, confidence

def _amounts(spark, d):
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey") % 5
    total = F.format_number(F.col("l_extendedprice").cast("decimal(15,2)"), 2)
    word = F.when(q == 30, "thirty").when(q == 20, "TWENTY").when(q == 7, "seven").otherwise(q.cast("string"))
    quote = (F.when(p == 0, E.concat("deliver ", q, " units for ", total)).when(p == 1, E.concat("deliver ", word, " units for ", F.replace(total, F.lit(","), F.lit("")), "."))
             .when(p == 2, E.concat("deliver ", q + 1, " units for ", total)).when(p == 3, E.concat("for ", total, " deliver ", word)).otherwise("no figures here"))
    return E.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", E.concat(q, " units, total ", total).alias("value"), quote.alias("quote"))


_AMOUNTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q || ' units, total ' || total AS value,
       CASE l_partkey % 5 WHEN 0 THEN 'deliver ' || q || ' units for ' || total WHEN 1 THEN 'deliver ' || word || ' units for ' || replace(total, ',', '') || '.'
            WHEN 2 THEN 'deliver ' || (q + 1) || ' units for ' || total WHEN 3 THEN 'for ' || total || ' deliver ' || word ELSE 'no figures here' END AS quote
FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q, format('{:,.2f}', l_extendedprice) AS total,
             CASE CAST(l_quantity AS INTEGER) WHEN 30 THEN 'thirty' WHEN 20 THEN 'TWENTY' WHEN 7 THEN 'seven' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS word FROM lineitem)"""


@_register("c05_numeric_check", f"SELECT l_partkey, ok, count(*) AS lines, min(quote) AS sample FROM (SELECT *, {Q.numeric_ok('value', 'quote')} AS ok FROM ({_AMOUNTS})) GROUP BY l_partkey, ok")
def c05(spark, d):
    return (_amounts(spark, d).withColumn("ok", S.numeric_ok("value", "quote"))
            .groupBy("l_partkey", "ok").agg(F.count("*").alias("lines"), F.min("quote").alias("sample")))


_PHRASES = ["this term is unenforceable", "The deal is legally  binding", "you should sue", "You're not liable", "this violates rules", "it is compliant with law",
            "we recommend terminating", "you should terminate", "under 42 U.S.C. 1", "Roe v. Wade", "per § 5 of the Data Act", "guarantees", "consult your lawyer", "legal advice", "a plain text"]


@_register("c06_lint", with_ctes(["pages_o"], "SELECT dv_id, page_number, phrase, reason FROM (" + " UNION ALL ".join(
    f"SELECT dv_id, page_number, regexp_extract(t, '{Q.esc(p)}', 0) AS phrase, '{r}' AS reason FROM (SELECT dv_id, page_number, text || ' ' || "
    f"[{', '.join(repr(x).replace(chr(34), chr(39)) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in _PHRASES)}][CAST(dv_id % 15 AS INTEGER) + 1] AS t FROM pages_o)"
    for p, r in K.LINT_PATTERNS) + ") WHERE phrase <> ''"))
def c06(spark, d):
    extra = F.element_at(F.array(*[F.lit(x) for x in _PHRASES]), (F.col("dv_id") % 15).cast("int") + 1)
    hits = F.explode(T.lint(F.concat_ws(" ", "text", extra)))
    return TQ.pages(spark, d).select("dv_id", "page_number", hits.alias("h")).select("dv_id", "page_number", "h.phrase", "h.reason")


_BLEND = Q.blend("l_discount * 10", "l_tax * 12", "l_quantity / 50", "l_returnflag = 'R'", "l_linestatus = 'O'")


@_register("c07_confidence", f"SELECT l_returnflag, l_linestatus, confidence, count(*) AS lines FROM (SELECT *, {_BLEND} AS confidence FROM lineitem) GROUP BY 1, 2, 3")
def c07(spark, d):
    c = S.blend_confidence(F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return E.table(spark, d, "lineitem").withColumn("confidence", c).groupBy("l_returnflag", "l_linestatus", "confidence").agg(F.count("*").alias("lines"))


@_register("c08_bands", f"""
SELECT l_returnflag, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS lines, min(confidence) AS lowest, max(confidence) AS highest
FROM (SELECT *, {_BLEND} AS confidence FROM lineitem) GROUP BY 1, 2""")
def c08(spark, d):
    c = S.blend_confidence(F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return (E.table(spark, d, "lineitem").withColumn("confidence", c).withColumn("band", S.confidence_band("confidence"))
            .groupBy("l_returnflag", "band").agg(F.count("*").alias("lines"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest")))


# ------------------------------------------------------------------ field candidates

def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One candidate per contract page; the value, status and number of quotes vary."""
    ev, p = evidence(spark, d)
    return candidates_of(ev), p


def candidates_of(ev: DataFrame) -> DataFrame:
    c = (F.col("dv_id") * 7 + F.col("page") * 3) % 8
    head = F.regexp_extract("quoted_text", "^ *([^ ]+ +){0,4}", 0)
    value = (F.when(c == 1, F.concat(head, F.lit(" 987654"))).when(c == 2, F.concat(head, F.lit(" is certified")))
             .when(c == 3, "entirely different words").when(c == 4, F.lit(None)).otherwise(head))
    status = F.when(c.isin(5, 6), "conflicting").when(c == 7, "not_found").otherwise("found")
    span = F.struct("page", F.lit(None).cast("string").alias("section_ref"), F.lit(None).cast("string").alias("section_title"), "char_start", "char_end", "quoted_text")
    # the second quote is the same text with a span of length zero, which must be re-anchored
    again = F.struct("page", F.lit(None).cast("string").alias("section_ref"), F.lit(None).cast("string").alias("section_title"),
                     "char_start", F.col("char_start").alias("char_end"), "quoted_text")
    evidence_list = F.when(c == 5, F.array(span, again)).when(c == 0, F.array(again, span)).otherwise(F.array(span)).cast(f"array<{SPAN}>")
    return ev.select(
        "dv_id", F.concat(F.lit("field."), F.col("page").cast("string")).alias("field_key"), status.alias("status"), value.alias("value_text"),
        F.when(c == 4, F.lit(None)).otherwise(F.to_json(F.struct(F.length("quoted_text").alias("n")))).alias("value_normalized"),
        F.when(c == 3, F.when(F.col("dv_id") % 2 == 0, "interpretation").otherwise("factual")).otherwise("factual").alias("extraction_kind"),
        evidence_list.alias("evidence"), ((F.col("dv_id") % 101) / 100.0).alias("self_confidence"))


CTE["candidates"] = (["evidence"], """
SELECT *, CASE WHEN c IN (5, 6) THEN 'conflicting' WHEN c = 7 THEN 'not_found' ELSE 'found' END AS status,
       CASE c WHEN 1 THEN head || ' 987654' WHEN 2 THEN head || ' is certified' WHEN 3 THEN 'entirely different words' WHEN 4 THEN NULL ELSE head END AS value_text,
       CASE WHEN c <> 4 THEN '{"n":' || length(quoted_text) || '}' END AS value_normalized,
       CASE WHEN c = 3 AND dv_id % 2 = 0 THEN 'interpretation' ELSE 'factual' END AS extraction_kind, (dv_id % 101) / 100.0 AS self_confidence, 'field.' || page AS field_key
FROM (SELECT *, (dv_id * 7 + page * 3) % 8 AS c, regexp_extract(quoted_text, '^ *([^ ]+ +){0,4}', 0) AS head FROM evidence)""")
CTE["cand_spans"] = (["candidates"], """
SELECT dv_id || '#' || field_key || '#' || pos AS citation_id, dv_id, field_key, pos, char_start, CASE WHEN (c = 5 AND pos = 1) OR (c = 0 AND pos = 0) THEN char_start ELSE char_end END AS char_end, quoted_text, ptext, ocr_derived
FROM (SELECT *, unnest(range(0, CASE WHEN c IN (0, 5) THEN 2 ELSE 1 END)) AS pos FROM candidates)""")
_resolution("cs", "cand_spans")
_CONF_V = Q.blend("self_confidence", "0.8::DOUBLE", "p.score", "p.ocr_derived", "status = 'conflicting' AND verdict = 'valid'")
CTE["validated"] = (["candidates", "cs_resolved"], f"""
SELECT *, CASE WHEN NOT kept THEN 'not_found' WHEN verdict = 'lone conflict' THEN 'found' WHEN status = 'conflicting' THEN 'conflicting' WHEN confidence < 0.6 THEN 'needs_confirmation' ELSE 'found' END AS final_status
FROM (SELECT *, CASE WHEN kept THEN {_CONF_V.replace('p.score', 'score').replace('p.ocr_derived', 'ocr')} ELSE 0.0 END AS confidence FROM (
  SELECT *, verdict IN ('lone conflict', 'valid') AS kept FROM (
    SELECT c.dv_id, c.field_key, c.status, c.value_text, c.value_normalized, c.extraction_kind, c.self_confidence, p.score, p.ocr_derived AS ocr, p.citation_id, p.others,
      CASE WHEN status = 'not_found' THEN 'absent' WHEN p.n IS NULL THEN 'no citation' WHEN status = 'conflicting' AND p.n < 2 THEN 'lone conflict'
           WHEN coalesce(value_text, '') <> '' AND NOT ({Q.numeric_ok('value_text', 'p.quoted_text')}) THEN 'numbers differ'
           WHEN extraction_kind = 'factual' AND coalesce(value_text, '') <> '' AND NOT (len(wc) > 0 AND len(list_intersect(wc, we)) / len(wc) >= 0.5) THEN 'not grounded'
           WHEN NOT ({Q.lint_clean('value_text')}) THEN 'phrasing' ELSE 'valid' END AS verdict
    FROM (SELECT *, {Q.content_words('value_text')} AS wc FROM candidates) c LEFT JOIN (
      SELECT *, {Q.content_words('quoted_text')} AS we FROM (
        SELECT dv_id, field_key, count(*) AS n, arg_min(citation_id, pos) AS citation_id, arg_min(quoted_text, pos) AS quoted_text, arg_min(score, pos) AS score, arg_min(ocr_derived, pos) AS ocr_derived,
               array_to_string(list(citation_id ORDER BY pos)[2:], ',') AS others FROM cs_resolved WHERE resolvable GROUP BY dv_id, field_key)) p ON p.dv_id = c.dv_id AND p.field_key = c.field_key)))""")


@_register("c09_validate_fields", with_ctes(["validated"], """
SELECT dv_id, field_key, verdict, final_status AS status, CASE WHEN kept THEN value_text END AS value_text, CASE WHEN kept THEN value_normalized END AS value_normalized, extraction_kind, confidence,
       CASE WHEN kept THEN citation_id END AS primary_citation_id, CASE WHEN verdict = 'valid' THEN others ELSE '' END AS alt_citation_ids, NOT kept AND verdict <> 'absent' AS superseded FROM validated"""))
def c09(spark, d):
    out = C.validate_fields(*candidates(spark, d))
    return out.withColumn("alt_citation_ids", F.array_join("alt_citation_ids", ","))


def _stored_fields(spark, d):
    cols = ["dv_id", "field_key", "value_text", "validation_status", "confidence"]
    return E.extracted_fields(spark, d).select(*cols, F.lit("p1").alias("prompt_version")).withColumn(
        "validation_status", F.when(F.col("dv_id") % 4 == 0, "corrected").otherwise(F.col("validation_status")))


def _rerun_fields(spark, d):
    """Shipped lines re-extract two fields of their order, one of them new."""
    key = F.when(F.col("l_linenumber") % 2 == 0, "dates.effective").otherwise("law.venue")
    return E.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("dv_id"), key.alias("field_key"), E.concat("run ", F.col("l_partkey")).alias("value_text"),
        F.lit("found").alias("validation_status"), F.lit(0.9).alias("confidence"), F.lit("p1").alias("prompt_version"),
        F.col("l_shipdate").alias("run_at"), "l_partkey", "l_suppkey")


def _merge_sql(strict: bool) -> str:
    protect = "" if strict else "AND o.validation_status NOT IN ('corrected', 'confirmed')"
    return with_ctes(["extracted_fields"], f""",
stored AS (SELECT dv_id, field_key, value_text, CASE WHEN dv_id % 4 = 0 THEN 'corrected' ELSE validation_status END AS validation_status, confidence, 'p1' AS prompt_version FROM extracted_fields),
rerun AS (SELECT l_orderkey AS dv_id, CASE WHEN l_linenumber % 2 = 0 THEN 'dates.effective' ELSE 'law.venue' END AS field_key, 'run ' || l_partkey AS value_text, 'found' AS validation_status, 0.9 AS confidence, 'p1' AS prompt_version,
                 l_shipdate, l_partkey, l_suppkey FROM lineitem),
last_run AS (SELECT * FROM rerun QUALIFY row_number() OVER (PARTITION BY dv_id, field_key ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1)
SELECT coalesce(o.dv_id, n.dv_id) AS dv_id, coalesce(o.field_key, n.field_key) AS field_key,
       CASE WHEN n.dv_id IS NOT NULL AND (o.dv_id IS NULL OR (true {protect})) THEN n.value_text ELSE o.value_text END AS value_text,
       CASE WHEN n.dv_id IS NOT NULL AND (o.dv_id IS NULL OR (true {protect})) THEN n.validation_status ELSE o.validation_status END AS validation_status,
       CASE WHEN n.dv_id IS NOT NULL AND (o.dv_id IS NULL OR (true {protect})) THEN n.confidence ELSE o.confidence END AS confidence, 'p1' AS prompt_version
FROM stored o FULL OUTER JOIN last_run n ON n.dv_id = o.dv_id AND n.field_key = o.field_key""")


@_register("c10_merge_fields", _merge_sql(False))
def c10(spark, d):
    return C.merge_fields(_stored_fields(spark, d), _rerun_fields(spark, d), ["run_at", "l_partkey", "l_suppkey"])


@_register("c10_merge_fields_strict", _merge_sql(True))
def c10b(spark, d):
    return C.merge_fields(_stored_fields(spark, d), _rerun_fields(spark, d), ["run_at", "l_partkey", "l_suppkey"], strict=True)


_KEYS = "[" + ", ".join(f"'{k}'" for k, _, _ in K.TARGET_FIELDS) + ", 'unknown.key']"


def _listed(spark, d):
    keys = F.array(*[F.lit(k) for k, _, _ in K.TARGET_FIELDS], F.lit("unknown.key"))
    return E.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("dv_id"), F.element_at(keys, (F.col("l_partkey") % 32).cast("int") + 1).alias("field_key"),
        E.concat(F.col("l_linenumber") + 1000, "-", F.col("l_partkey") + 1000000, "-", F.col("l_suppkey")).alias("position"), E.concat("v", F.col("l_suppkey")).alias("value_text"))


CTE["listed"] = ([], f"""
SELECT l_orderkey AS dv_id, {_KEYS}[CAST(l_partkey % 32 AS INTEGER) + 1] AS field_key, (l_linenumber + 1000) || '-' || (l_partkey + 1000000) || '-' || l_suppkey AS position, 'v' || l_suppkey AS value_text FROM lineitem""")


@_register("c11_dedupe_candidates", with_ctes(["listed"], "SELECT dv_id, field_key, position, value_text FROM listed WHERE field_key <> 'unknown.key' QUALIFY row_number() OVER (PARTITION BY dv_id, field_key ORDER BY position) = 1"))
def c11(spark, d):
    return C.dedupe_candidates(_listed(spark, d), "position", [k for k, _, _ in K.TARGET_FIELDS])


@_register("c12_coverage", with_ctes(["listed"], f"""
SELECT o_orderkey AS dv_id, k.field_key, k.label, k.field_group, 'not_found' AS validation_status, CAST(NULL AS VARCHAR) AS value_text, 'factual' AS extraction_kind, 0.0 AS confidence, 'p1' AS prompt_version,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '1,' || (o_orderkey % 4 + 2) || '.1' END AS searched_sections
FROM orders CROSS JOIN (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in K.TARGET_FIELDS)}) k(field_key, label, field_group)
WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.dv_id = o_orderkey AND l.field_key = k.field_key)"""))
def c12(spark, d):
    versions = E.table(spark, d, "orders").select(F.col("o_orderkey").alias("dv_id"))
    k = F.col("dv_id")
    searched = versions.filter(k % 5 != 0).select("dv_id", E.concat("1,,", k % 4 + 2, ".1").alias("sections"))
    return C.complete_coverage(_listed(spark, d), versions, "p1", searched).withColumn("searched_sections", F.array_join("searched_sections", ","))


def layout(spark: SparkSession, d: str) -> DataFrame:
    """Strips of eighty characters as boxes, in page coordinates."""
    n = F.length("text")
    return (TQ.pages(spark, d).filter(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 80).cast("int"))))
            .select("dv_id", "page_number", (F.col("i") * 80).alias("char_start"), F.least(F.col("i") * 80 + 80, n).alias("char_end"),
                    F.lit(0).alias("x"), (F.col("i") * 12).alias("y"), F.lit(480).alias("w"), F.lit(12).alias("h")))


CTE["layout"] = (["pages_o"], """
SELECT dv_id, page_number, i * 80 AS char_start, least(i * 80 + 80, n) AS char_end, i * 12 AS y
FROM (SELECT dv_id, page_number, length(text) AS n, unnest(range(0, (length(text) - 1) // 80 + 1)) AS i FROM pages_o WHERE length(text) > 0)""")


@_register("c13_citation_rects", with_ctes(["evidence", "layout"], """
SELECT citation_id, l.y, l.char_start AS l_start, l.char_end AS l_end FROM evidence e JOIN layout l ON l.dv_id = e.dv_id AND l.page_number = e.page AND l.char_start < e.char_end AND l.char_end > e.char_start"""))
def c13(spark, d):
    ev, _ = evidence(spark, d)
    return C.citation_rects(ev, layout(spark, d)).select("citation_id", "y", "l_start", "l_end")


@_register("c13_citation_views", with_ctes(["evidence", "layout", "pages_o"], """
SELECT e.citation_id, coalesce(b.boxes, 0) AS boxes, p.page_count, e.variant <> 5 AND coalesce(b.boxes, 0) > 0 AS resolvable
FROM evidence e LEFT JOIN (SELECT citation_id, count(*) AS boxes FROM evidence e JOIN layout l ON l.dv_id = e.dv_id AND l.page_number = e.page AND l.char_start < e.char_end AND l.char_end > e.char_start GROUP BY citation_id) b USING (citation_id)
JOIN (SELECT dv_id, count(*) AS page_count FROM pages_o GROUP BY dv_id) p ON p.dv_id = e.dv_id"""))
def c13b(spark, d):
    ev, p = evidence(spark, d)
    return C.citation_views(ev.withColumn("resolvable", F.col("variant") != 5), layout(spark, d), p).select("citation_id", "boxes", "page_count", "resolvable")


@_register("c14_apply_corrections", with_ctes(["corrected_fields"], "SELECT field_id, value_text, value_normalized, validation_status FROM corrected_fields"))
def c14(spark, d):
    current, _ = C.apply_corrections(E.extracted_fields(spark, d), DQ.field_corrections(spark, d))
    return current.select("field_id", "value_text", "value_normalized", "validation_status")


@_register("c14_correction_history", with_ctes(["corrections", "extracted_fields"], """
SELECT field_id, rank, correction_id, new_value, previous_value FROM (
  SELECT c.field_id, correction_id, new_value, coalesce(lag(new_value) OVER (PARTITION BY c.field_id ORDER BY corrected_at, correction_id), f.value_text) AS previous_value,
         row_number() OVER (PARTITION BY c.field_id ORDER BY corrected_at DESC, correction_id DESC) AS rank FROM corrections c JOIN extracted_fields f ON f.field_id = c.field_id)"""))
def c14b(spark, d):
    _, history = C.apply_corrections(E.extracted_fields(spark, d), DQ.field_corrections(spark, d))
    return history.select("field_id", "rank", "correction_id", "new_value", "previous_value")
