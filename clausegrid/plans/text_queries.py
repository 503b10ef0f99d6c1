"""Registered queries: document text (pages, clauses, chunks, context)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import text as T
from clausegrid.operators import text as ops
from clausegrid.plans import entities as E
from clausegrid.plans import sqltext as Q
from clausegrid.plans.entities import CTE, with_ctes

# ------------------------------------------------------------------ derived text tables, Spark side


def pages(spark: SparkSession, d: str) -> DataFrame:
    return ops.page_offsets(E.raw_pages(spark, d))


def clauses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = pages(spark, d)
    return ops.segment(ops.assemble(p)), p


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """The given documents as pages of fixed length, text untouched."""
    p = F.col("page_number")
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / E.PAGE_CHARS)).cast("int")
    return (E.table(spark, d, "documents").select(F.col("doc_id").alias("dv_id"), "text")
            .withColumn("page_number", F.explode(F.sequence(F.lit(1), n)))
            .withColumn("text", F.substr("text", (p - 1) * E.PAGE_CHARS + 1, F.lit(E.PAGE_CHARS)))
            .withColumn("char_start", ((p - 1) * E.PAGE_CHARS).cast("long"))
            .withColumn("char_end", F.col("char_start") + F.length("text"))
            .withColumn("ocr_derived", (F.col("dv_id") + p) % 9 == 0))


def doc_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Every given document as one clause, so that long texts span many chunks."""
    return E.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("clause_id"), F.col("doc_id").alias("dv_id"),
        F.lit(None).cast("string").alias("section_ref"), F.lit(0).cast("long").alias("char_start"),
        F.length("text").cast("long").alias("char_end"), "text")


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ops.chunk(doc_clauses(spark, d), doc_pages(spark, d)).withColumn("workspace_id", F.col("dv_id") % 5)


# ------------------------------------------------------------------ the same in SQL

CTE["pages_n"] = (["raw_pages"], f"SELECT * REPLACE ({Q.norm_page('text')} AS text) FROM raw_pages")
CTE["pages_o"] = (["pages_n"], """
SELECT *, char_start + length(text) AS char_end FROM (
  SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY dv_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM pages_n)""")
CTE["full_text"] = (["pages_o"], "SELECT dv_id, string_agg(text, '' ORDER BY page_number) AS text, max(page_number) AS last_page FROM pages_o GROUP BY dv_id")
_RX = Q.esc(K.HEADING)
CTE["heading_hits"] = (["full_text"], f"""
SELECT dv_id, char_start, section_ref, title, len(string_split(section_ref, '.')) AS depth FROM (
  SELECT dv_id, CAST(sum(length(gap)) OVER (PARTITION BY dv_id ORDER BY i) + sum(length(hit)) OVER (PARTITION BY dv_id ORDER BY i) - length(hit)
         + CASE WHEN starts_with(hit, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS char_start,
         regexp_replace({Q.trim_ws(f"regexp_extract(hit, '{_RX}', 1)")}, '\\.$', '') AS section_ref,
         {Q.trim_ws(f"regexp_extract(hit, '{_RX}', 2)")} AS title
  FROM (SELECT dv_id, i, gaps[i] AS gap, hits[i] AS hit FROM (
          SELECT dv_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT dv_id, string_split_regex(text, '{_RX}') AS gaps, regexp_extract_all(text, '{_RX}') AS hits FROM full_text))))
WHERE len(string_split(section_ref, '.')) <= {K.HEADING_DEPTH} AND length(title) <= {K.HEADING_CHARS}""")


def page_of_sql(source: str, offset: str, out: str, pages_name: str = "pages_o", extra: str = "") -> str:
    return f"""SELECT s.*, coalesce(p.page_number, l.last_page) AS {out} {extra} FROM {source} s
LEFT JOIN {pages_name} p ON p.dv_id = s.dv_id AND s.{offset} >= p.char_start AND s.{offset} < p.char_end
LEFT JOIN (SELECT dv_id, max(page_number) AS last_page FROM {pages_name} GROUP BY dv_id) l ON l.dv_id = s.dv_id"""


CTE["clause_spans"] = (["heading_hits", "full_text"], f"""
SELECT *, char_start + length(text) AS char_end, greatest(char_start, char_start + length(text) - 1) AS last_char FROM (
  SELECT h.dv_id, section_ref, string_split_regex(title, '[{K.WS}]{{2,}}')[1] AS section_title, depth, char_start,
         {Q.clause_type("title", "substr(text, char_start + 1, nxt - char_start)")} AS clause_type, substr(text, char_start + 1, nxt - char_start) AS text
  FROM (SELECT h.*, t.text, coalesce(lead(char_start) OVER (PARTITION BY h.dv_id ORDER BY char_start), length(t.text)) AS nxt FROM heading_hits h JOIN full_text t ON t.dv_id = h.dv_id) h
  UNION ALL
  SELECT t.dv_id, NULL, 'Preamble', 1, 0, NULL, substr(text, 1, f.first_start) FROM full_text t JOIN (SELECT dv_id, min(char_start) AS first_start FROM heading_hits GROUP BY dv_id) f ON f.dv_id = t.dv_id
  UNION ALL
  SELECT dv_id, NULL, 'Page ' || page_number, 1, char_start, NULL, text FROM pages_o WHERE dv_id NOT IN (SELECT dv_id FROM heading_hits))
WHERE {Q.trim_ws('text')} <> ''""")
CTE["clauses_1"] = (["clause_spans", "pages_o"], page_of_sql("clause_spans", "char_start", "page_start"))
CTE["clauses"] = (["clauses_1"], "SELECT dv_id || ':' || char_start AS clause_id, * FROM (" + page_of_sql("clauses_1", "last_char", "page_end") + ")")

CTE["doc_pages"] = ([], f"""
SELECT doc_id AS dv_id, CAST(p AS INTEGER) AS page_number, substr(text, (p - 1) * {E.PAGE_CHARS} + 1, {E.PAGE_CHARS}) AS text, (p - 1) * {E.PAGE_CHARS} AS char_start,
       (p - 1) * {E.PAGE_CHARS} + length(substr(text, (p - 1) * {E.PAGE_CHARS} + 1, {E.PAGE_CHARS})) AS char_end, (doc_id + p) % 9 = 0 AS ocr_derived
FROM (SELECT *, unnest(generate_series(1, greatest(1, CAST(ceil(length(text) / {E.PAGE_CHARS}.0) AS BIGINT)))) AS p FROM documents)""")
CTE["doc_windows"] = ([], f"""
SELECT *, least(char_start + length(text), clause_end) AS char_end, greatest(char_start, least(char_start + length(text), clause_end) - 1) AS last_char,
       row_number() OVER (PARTITION BY dv_id ORDER BY i) - 1 AS seq FROM (
  SELECT dv_id, i, clause_end, array_to_string(w[i * 680 + 1 : least(i * 680 + 800, n)], ' ') AS text, least(800, n - i * 680) AS token_count,
         greatest(instr(body, w[i * 680 + 1]) - 1, 0) AS char_start,
         coalesce(list_sum(list_transform(raw[1 : i * 680 + lead_gap], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gaps[1 : i * 680 + lead_gap], lambda x: length(x))), 0) AS true_start
  FROM (SELECT *, len(w) AS n, CASE WHEN raw[1] = '' THEN 1 ELSE 0 END AS lead_gap, unnest(range(0, CAST(greatest(0, ceil((len(w) - 800) / 680.0)) AS BIGINT) + 1)) AS i FROM (
    SELECT doc_id AS dv_id, text AS body, length(text) AS clause_end, string_split_regex(text, '[{K.WS}]+') AS raw, regexp_extract_all(text, '[{K.WS}]+') AS gaps,
           list_filter(string_split_regex(text, '[{K.WS}]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))""")
CTE["doc_chunks_1"] = (["doc_windows", "doc_pages"], page_of_sql("doc_windows", "char_start", "page_start", "doc_pages", ", coalesce(p.ocr_derived, false) AS ocr_derived"))
CTE["doc_chunks"] = (["doc_chunks_1"], "SELECT dv_id || '-' || seq AS chunk_id, dv_id % 5 AS workspace_id, * FROM (" + page_of_sql("doc_chunks_1", "last_char", "page_end", "doc_pages") + ")")

# ------------------------------------------------------------------ registered queries

QUERIES: dict = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


@_register("t01_normalize_pages", with_ctes(["pages_n"], "SELECT dv_id, page_number, text, length(text) AS chars FROM pages_n"))
def t01(spark, d):
    return E.raw_pages(spark, d).select("dv_id", "page_number", T.normalize_page("text").alias("text")).withColumn("chars", F.length("text"))


@_register("t02_page_offsets", with_ctes(["pages_o"], "SELECT dv_id, page_number, char_start, char_end FROM pages_o"))
def t02(spark, d):
    return pages(spark, d).select("dv_id", "page_number", "char_start", "char_end")


@_register("t02_document_outcome", with_ctes(["pages_o"], f"""
SELECT dv_id, count(*) AS page_count, bool_or(ocr_derived) AS has_ocr_pages,
       CASE WHEN bool_and({Q.trim_ws('text')} = '') THEN 'failed' WHEN bool_or(ocr_derived) THEN 'degraded' ELSE 'succeeded' END AS outcome,
       CASE WHEN bool_and({Q.trim_ws('text')} = '') THEN 'No text could be extracted.' END AS failure_reason FROM pages_o GROUP BY dv_id"""))
def t02b(spark, d):
    return ops.document_outcome(pages(spark, d))


@_register("t03_ocr_candidates", with_ctes(["raw_pages"], f"""
SELECT dv_id, page_number, least(ocr_confidence, 0.75) AS ocr_confidence, length(text) AS chars FROM raw_pages WHERE length(regexp_replace(text, '[{K.WS}]+', '', 'g')) < 100"""))
def t03(spark, d):
    out = ops.ocr_candidates(E.raw_pages(spark, d))
    return out.select("dv_id", "page_number", "ocr_confidence", F.length("text").alias("chars"))


@_register("t04_headings", with_ctes(["heading_hits"], "SELECT dv_id, char_start, section_ref, title, depth FROM heading_hits"))
def t04(spark, d):
    return ops.headings(ops.assemble(pages(spark, d)))


@_register("t05_clauses", with_ctes(["clauses"], "SELECT clause_id, dv_id, section_ref, section_title, depth, page_start, page_end, char_start, char_end, clause_type, text FROM clauses"))
def t05(spark, d):
    return clauses(spark, d)[0]


@_register("t05_segment_outcome", with_ctes(["clauses"], "SELECT dv_id, count(*) AS clauses, CASE WHEN count(section_ref) = 0 THEN 'degraded' ELSE 'succeeded' END AS outcome FROM clauses GROUP BY dv_id"))
def t05b(spark, d):
    return ops.segment_outcome(clauses(spark, d)[0])


@_register("t06_clause_types", f"""
SELECT source, clause_type, count(*) AS documents, sum(n_chars) AS chars FROM (SELECT source, n_chars, {Q.clause_type('source', "'payment schedule ' || text")} AS clause_type FROM documents
UNION ALL SELECT role, length(text), {Q.clause_type('role', 'text')} FROM conversations) GROUP BY source, clause_type""")
def t06(spark, d):
    docs = E.table(spark, d, "documents").select(
        "source", "n_chars", T.clause_type("source", F.concat(F.lit("payment schedule "), F.col("text"))).alias("clause_type"))
    turns = E.table(spark, d, "conversations").select(
        F.col("role").alias("source"), F.length("text").cast("long").alias("n_chars"), T.clause_type("role", "text").alias("clause_type"))
    return E.union_all([docs, turns]).groupBy("source", "clause_type").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@_register("t07_page_of", with_ctes(["doc_pages"], "SELECT s.dv_id, s.off, p.page_number AS page FROM (SELECT doc_id AS dv_id, unnest(range(0, length(text), 997)) AS off FROM documents) s "
           "JOIN doc_pages p ON p.dv_id = s.dv_id AND s.off >= p.char_start AND s.off < p.char_end"))
def t07(spark, d):
    spans = E.table(spark, d, "documents").filter(F.length("text") > 0).select(
        F.col("doc_id").alias("dv_id"), F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(997))).alias("off"))
    return ops.page_of(spans, doc_pages(spark, d), "off").select("dv_id", "off", "page")


@_register("t08_chunks", with_ctes(["doc_chunks"], "SELECT chunk_id, dv_id, seq, page_start, page_end, char_start, char_end, true_start, ocr_derived, token_count, text FROM doc_chunks"))
def t08(spark, d):
    return doc_chunks(spark, d).drop("clause_id", "section_ref", "workspace_id")


@_register("t09_language_gate", "SELECT lang, CASE WHEN lang = 'en' THEN 'accepted' ELSE 'failed' END AS status, CASE WHEN lang <> 'en' THEN 'Unsupported language: ' || lang END AS failure_reason, count(*) AS documents FROM documents GROUP BY lang")
def t09(spark, d):
    ok, refused = ops.language_gate(E.table(spark, d, "documents").select("doc_id", "lang"))
    rows = E.union_all([ok.withColumns({"status": F.lit("accepted"), "failure_reason": F.lit(None).cast("string")}), refused])
    return rows.groupBy("lang", "status", "failure_reason").agg(F.count("*").alias("documents"))


@_register("t10_compare_form", with_ctes(["contract_texts"], f"SELECT form, count(*) AS copies, min(dv_id) AS first_dv FROM (SELECT dv_id, sha256({Q.norm_compare('text')}) AS form FROM contract_texts) GROUP BY form"))
def t10(spark, d):
    form = F.sha2(F.encode(T.normalize_for_compare("text"), "UTF-8"), 256)
    return E.contract_texts(spark, d).select("dv_id", form.alias("form")).groupBy("form").agg(
        F.count("*").alias("copies"), F.min("dv_id").alias("first_dv"))


def _context_sql(stage: str) -> str:
    pattern = K.CONTEXT_STAGES[stage]
    title = "coalesce(section_title, '') || ' ' || text"
    source = "SELECT * FROM clauses" + (" WHERE section_ref IS NOT NULL" if stage == "extract" else "")
    hits = f"""SELECT dv_id, count(*) AS hits, string_agg('<page page="' || page_start || '" section="' || coalesce(section_ref, '') || '">' || chr(10) || text || chr(10) || '</page>', chr(10) ORDER BY char_start) AS context,
       string_agg(coalesce(section_ref, ''), ',' ORDER BY char_start) AS sections
FROM ({source}) WHERE regexp_matches({'text' if stage == 'obligations' else title}, '{pattern}') GROUP BY dv_id"""
    if stage != "extract":
        return with_ctes(["clauses"], hits)
    return with_ctes(["clauses", "full_text"], f"""
SELECT f.dv_id, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) < 3 THEN f.text ELSE context END AS context, coalesce(sections, '') AS sections
FROM full_text f LEFT JOIN ({hits}) h ON h.dv_id = f.dv_id""")


@_register("t11_context_extract", _context_sql("extract"))
def t11a(spark, d):
    p = pages(spark, d)
    docs = ops.assemble(p)
    return ops.assemble_context(ops.segment(docs), "extract", docs)


@_register("t11_context_obligations", _context_sql("obligations"))
def t11b(spark, d):
    return ops.assemble_context(clauses(spark, d)[0], "obligations")


@_register("t11_context_risk", _context_sql("risk"))
def t11c(spark, d):
    return ops.assemble_context(clauses(spark, d)[0], "risk")
