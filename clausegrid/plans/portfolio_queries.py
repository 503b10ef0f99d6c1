"""Registered queries: reports, exports, governance, sources and idempotent writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.operators import obligations as O
from clausegrid.operators import portfolio as P
from clausegrid.operators import risk as R
from clausegrid.plans import date_queries as DQ
from clausegrid.plans import entities as E
from clausegrid.plans.entities import AS_OF, CTE, with_ctes
from clausegrid.session import checkpoint_root
from clausegrid.sources import io

QUERIES: dict = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _scratch(spark, name):
    """A new folder in the shared checkpoint area."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _overdue(spark, d):
    return O.mark_overdue(DQ.obligations(spark, d), AS_OF)


CTE["swept"] = (["obligations"], f"SELECT * REPLACE (CASE WHEN status = 'active' AND due_date + grace_days < DATE '{AS_OF}' THEN 'overdue' ELSE status END AS status) FROM obligations")


@_register("p01_dashboard", with_ctes(["contracts", "swept", "risk_flags", "document_versions"], f"""
SELECT workspace_id, coalesce(in_review, 0) AS in_review, coalesce(renewals_90, 0) AS renewals_90, coalesce(contracts, 0) AS contracts, coalesce(overdue, 0) AS overdue, coalesce(high_risk_open, 0) AS high_risk_open, coalesce(failed_documents, 0) AS failed_documents
FROM (SELECT workspace_id, count(*) FILTER (WHERE status = 'in_review') AS in_review, count(*) FILTER (WHERE renewal_notice_by BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 90) AS renewals_90, count(*) AS contracts FROM contracts WHERE deleted_at IS NULL GROUP BY 1)
FULL OUTER JOIN (SELECT workspace_id, count(*) FILTER (WHERE status = 'overdue') AS overdue FROM swept GROUP BY 1) USING (workspace_id)
FULL OUTER JOIN (SELECT workspace_id, count(*) FILTER (WHERE status = 'open' AND severity IN ('critical', 'high')) AS high_risk_open FROM risk_flags GROUP BY 1) USING (workspace_id)
FULL OUTER JOIN (SELECT workspace_id, count(*) FILTER (WHERE status = 'failed') AS failed_documents FROM document_versions GROUP BY 1) USING (workspace_id)"""))
def p01(spark, d):
    return P.dashboard(E.contracts(spark, d), _overdue(spark, d), E.risk_flags(spark, d), E.document_versions(spark, d), AS_OF)


_ACT = "SELECT a.workspace_id, a.rank, a.audit_id, a.action, a.resource_type, coalesce(u.email, 'system') AS actor FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, audit_id DESC) AS rank FROM audit_events {w}) a LEFT JOIN users u ON u.user_id = a.actor_user_id WHERE rank <= {n}"


@_register("p02_recent_activity", with_ctes(["audit_events", "users"], _ACT.format(w="", n=8)))
def p02(spark, d):
    return P.recent_activity(E.audit_events(spark, d), E.users(spark, d), n=8).select("workspace_id", "rank", "audit_id", "action", "resource_type", "actor")


_SEARCH = "SELECT workspace_id, rank, contract_id, title, status FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY updated_at DESC, contract_id) AS rank FROM contracts WHERE deleted_at IS NULL AND {w})"


@_register("p03_search_contracts", with_ctes(["contracts"], _SEARCH.format(w="contract_type = 'sow' AND status = 'in_review' AND expiration_date <= DATE '2001-06-30'")))
def p03(spark, d):
    return P.search_contracts(E.contracts(spark, d), status="in_review", contract_type="sow", expiring_before="2001-06-30").select("workspace_id", "rank", "contract_id", "title", "status")


@_register("p03_search_text", with_ctes(["contracts"], _SEARCH.format(w="list_contains(string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(counterparty, '')), '[^a-z0-9]+'), 'nation') AND list_contains(string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(counterparty, '')), '[^a-z0-9]+'), '7')")))
def p03b(spark, d):
    return P.search_contracts(E.contracts(spark, d), text="Nation 7").select("workspace_id", "rank", "contract_id", "title", "status")


@_register("p04_document_activity", with_ctes(["document_versions", "usage_rows"], """
SELECT v.workspace_id, v.rank, v.dv_id, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, coalesce(latency_ms, 0) AS latency_ms
FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY uploaded_at DESC, dv_id) AS rank FROM document_versions) v
LEFT JOIN (SELECT dv_id, count(*) AS calls, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS tokens, sum(coalesce(latency_ms, 0)) AS latency_ms FROM usage_rows GROUP BY 1) u ON u.dv_id = v.dv_id"""))
def p04(spark, d):
    docs, _ = P.document_activity(E.document_versions(spark, d), E.stage_events(spark, d), E.usage_rows(spark, d))
    return docs.select("workspace_id", "rank", "dv_id", "calls", "tokens", "latency_ms")


@_register("p04_stage_runs", with_ctes(["document_versions", "stage_events"], """
SELECT dv_id, seq, stage, status, row_number() OVER (PARTITION BY dv_id ORDER BY happened_at, seq) AS position FROM stage_events
WHERE dv_id IN (SELECT dv_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY uploaded_at DESC, dv_id) AS rank FROM document_versions))"""))
def p04b(spark, d):
    _, runs = P.document_activity(E.document_versions(spark, d), E.stage_events(spark, d), E.usage_rows(spark, d))
    return runs.select("dv_id", "seq", "stage", "status", "position")


_USE = "count(*) AS calls, sum(input_tokens) AS input_tokens, sum(coalesce(output_tokens, 0)) AS output_tokens, round(avg(latency_ms), 3) AS avg_latency_ms, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, count(*) FILTER (WHERE validation_outcome <> 'passed') AS not_passed"


@_register("p05_usage_ledger", with_ctes(["usage_rows"], f"SELECT agent, model_version, prompt_version, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, {_USE} FROM usage_rows GROUP BY 1, 2, 3, 4"))
def p05(spark, d):
    return P.usage_ledger(E.usage_rows(spark, d), ["agent", "model_version", "prompt_version", "day"])


@_register("p05_usage_rollup", with_ctes(["usage_rows"], f"SELECT agent, model_version, {_USE} FROM usage_rows GROUP BY ROLLUP (agent, model_version)"))
def p05b(spark, d):
    return P.usage_ledger(E.usage_rows(spark, d), ["agent", "model_version"], rollup=True)


@_register("p06_audit_query", with_ctes(["audit_events", "users", "memberships"], _ACT.format(n=200, w="WHERE action LIKE 'contract.%' AND resource_type = 'contract' AND workspace_id IN (SELECT workspace_id FROM memberships WHERE role IN ('legal_reviewer', 'workspace_admin'))")))
def p06(spark, d):
    return P.audit_query(E.audit_events(spark, d), E.users(spark, d), E.memberships(spark, d), "contract.", "contract", limit=200).select("workspace_id", "rank", "audit_id", "action", "resource_type", "actor")


def _versioned(spark, d):
    """Contracts whose current version is their newest order."""
    newest = E.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("contract_id")).agg(F.max("o_orderkey").alias("current_version_id"))
    return E.contracts(spark, d).drop("current_version_id").join(newest, "contract_id", "left")


CTE["versioned"] = (["contracts"], "SELECT c.* EXCLUDE (current_version_id), n.current_version_id FROM contracts c LEFT JOIN (SELECT o_custkey AS contract_id, max(o_orderkey) AS current_version_id FROM orders GROUP BY 1) n ON n.contract_id = c.contract_id")


def _current(spark, d):
    """The current versions: dv_id."""
    return _versioned(spark, d).select(F.col("current_version_id").alias("dv_id")).filter("dv_id IS NOT NULL")


def _brief(spark, d):
    k = F.col("dv_id")
    fields = E.extracted_fields(spark, d, _current(spark, d)).withColumns({
        "primary_citation_id": F.when(F.col("value_text").isNotNull(), k - k % 6), "alt_citation_ids": F.array(k - k % 6 + 6, k - k % 6 + 12)})
    return P.brief(_versioned(spark, d), fields, E.order_citations(spark, d), E.risk_flags(spark, d), DQ.obligations(spark, d), _stored_briefs(spark, d))


def _stored_briefs(spark, d):
    """Briefs of most versions as they are stored: JSON with one or two sentences and now and then a question, built from the version's fields."""
    versions = _current(spark, d)
    fields = E.extracted_fields(spark, d, versions).filter("value_text IS NOT NULL")
    k = F.col("dv_id")
    made = fields.groupBy("dv_id").agg(F.min("field_key").alias("a"), F.max("field_key").alias("b")).filter(k % 4 != 0)
    sentence = lambda x, p: F.struct(F.concat(F.lit("Concerns "), F.col(x)).alias("text"), F.array(F.col(x)).alias("field_ids"), F.lit(p).alias("self_confidence"))
    both = F.struct(
        F.when(F.col("a") == F.col("b"), F.array(sentence("a", 0.5))).otherwise(F.array(sentence("a", 0.5), sentence("b", 0.25))).alias("interpretation"),
        F.when(k % 3 == 0, F.array(F.struct(F.concat(F.lit("Is "), F.col("b"), F.lit(" final?")).alias("question"), F.array(F.col("b")).alias("field_ids")))).otherwise(
            F.array().cast("array<struct<question:string,field_ids:array<string>>>")).alias("open_questions"))
    return io.parse_briefs(made.select("dv_id", F.to_json(both).alias("brief")), versions.distinct())


@_register("p07_brief_facts", with_ctes(["versioned", "extracted_fields", "order_citations"], """
SELECT v.contract_id, f.field_id, f.field_key, f.field_group, f.value_text, f.validation_status, c.citation_id, c.page, c.quoted_text AS quote,
       concat_ws(',', a.citation_id, b.citation_id) AS alt_citations
FROM extracted_fields f JOIN versioned v ON v.current_version_id = f.dv_id
LEFT JOIN order_citations c ON f.value_text IS NOT NULL AND c.citation_id = f.dv_id - f.dv_id % 6
LEFT JOIN order_citations a ON a.citation_id = f.dv_id - f.dv_id % 6 + 6 LEFT JOIN order_citations b ON b.citation_id = f.dv_id - f.dv_id % 6 + 12 WHERE f.extraction_kind = 'factual'"""))
def p07(spark, d):
    f = _brief(spark, d)["facts"]
    return f.select("contract_id", "field_id", "field_key", "field_group", "value_text", "validation_status", "citation.citation_id", "citation.page", "citation.quote",
                    F.array_join(F.coalesce("alt_citations", F.array().cast("array<bigint>")).cast("array<string>"), ",").alias("alt_citations"))


@_register("p07_brief_risks", with_ctes(["risk_flags"], """
SELECT contract_id, rank, flag_id, severity, status FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY created_at DESC, flag_id) AS rank FROM risk_flags) WHERE status <> 'superseded'"""))
def p07b(spark, d):
    return _brief(spark, d)["risks"].select("contract_id", "rank", "flag_id", "severity", "status")


@_register("p07_brief_counts", with_ctes(["versioned", "extracted_fields", "obligations"], """
SELECT v.contract_id, v.title, v.status, coalesce(o.n, 0) AS obligations_count, coalesce(f.not_found, 0) AS not_found, coalesce(f.conflicts, 0) AS conflicts
FROM versioned v LEFT JOIN (SELECT contract_id, count(*) AS n FROM obligations GROUP BY 1) o USING (contract_id)
LEFT JOIN (SELECT dv_id, count(*) FILTER (WHERE validation_status = 'not_found') AS not_found, count(*) FILTER (WHERE validation_status = 'conflicting') AS conflicts FROM extracted_fields WHERE extraction_kind = 'factual' GROUP BY 1) f ON f.dv_id = v.current_version_id"""))
def p07c(spark, d):
    return _brief(spark, d)["contracts"]


CTE["stored_briefs"] = (["versioned", "extracted_fields"], """
SELECT v.contract_id, f.* FROM versioned v JOIN (SELECT dv_id, min(field_key) AS a, max(field_key) AS b FROM extracted_fields WHERE value_text IS NOT NULL GROUP BY 1) f ON f.dv_id = v.current_version_id WHERE f.dv_id % 4 <> 0""")


@_register("p07_brief_interpretation", with_ctes(["stored_briefs"], """
SELECT contract_id, 0 AS pos, 'Concerns ' || a AS text, a AS field_ids, 'interpretation' AS extraction_kind, 0.5 AS confidence FROM stored_briefs
UNION ALL SELECT contract_id, 1, 'Concerns ' || b, b, 'interpretation', 0.25 FROM stored_briefs WHERE a <> b"""))
def p07d(spark, d):
    return _brief(spark, d)["interpretation"].withColumn("field_ids", F.array_join("field_ids", ","))


@_register("p07_brief_questions", with_ctes(["stored_briefs"], "SELECT contract_id, 0 AS pos, 'Is ' || b || ' final?' AS question, b AS field_ids FROM stored_briefs WHERE dv_id % 3 = 0"))
def p07e(spark, d):
    return _brief(spark, d)["open_questions"].withColumn("field_ids", F.array_join("field_ids", ","))


@_register("p07_brief_conflicting", with_ctes(["versioned", "extracted_fields"], """
SELECT v.contract_id, f.field_group, f.field_key, f.field_id FROM extracted_fields f JOIN versioned v ON v.current_version_id = f.dv_id WHERE f.extraction_kind = 'factual' AND f.validation_status = 'conflicting'"""))
def p07f(spark, d):
    return _brief(spark, d)["conflicting"]


@_register("p08_fields_by_group", with_ctes(["extracted_fields"], """
SELECT dv_id, field_group, count(*) AS fields, count(*) FILTER (WHERE validation_status = 'not_found') AS not_found, count(*) FILTER (WHERE validation_status IN ('needs_confirmation', 'conflicting')) AS to_review FROM extracted_fields GROUP BY 1, 2"""))
def p08(spark, d):
    return P.fields_by_group(E.extracted_fields(spark, d))


def _uploads(spark, d):
    """Ready documents are stored as versions already, the others are new uploads."""
    v = E.document_versions(spark, d)
    stored = v.filter("status = 'ready'").withColumn("version_number", F.lit(0))
    stored = P.assign_versions(stored.drop("version_number"), stored.select("contract_id", F.lit(0).alias("version_number")))
    return v.filter("status <> 'ready'"), stored


CTE["numbered_versions"] = (["document_versions"], """
SELECT contract_id, dv_id, status, row_number() OVER (PARTITION BY contract_id ORDER BY status <> 'ready', uploaded_at, dv_id) AS version_number FROM document_versions""")


@_register("p09_assign_versions", with_ctes(["numbered_versions"], "SELECT contract_id, dv_id, version_number, 'v' || version_number AS version_label FROM numbered_versions WHERE status <> 'ready'"))
def p09(spark, d):
    new, stored = _uploads(spark, d)
    return P.assign_versions(new, stored).select("contract_id", "dv_id", "version_number", "version_label")


@_register("p09_current_versions", with_ctes(["numbered_versions"], "SELECT contract_id, arg_max(dv_id, version_number) AS current_version_id, max(version_number) AS versions FROM numbered_versions GROUP BY 1"))
def p09b(spark, d):
    new, stored = _uploads(spark, d)
    cols = ["contract_id", "dv_id", "version_number"]
    return P.current_versions(E.union_all([P.assign_versions(new, stored).select(*cols), stored.select(*cols)]))


@_register("p10_duplicate_content", """
WITH v AS (SELECT doc_id AS dv_id, doc_id // 3 AS contract_id, (doc_id // 3) % 2 AS workspace_id, sha256(text) AS h FROM documents)
SELECT n.dv_id, n.contract_id, n.workspace_id, min(e.dv_id) AS existing_dv_id, arg_min(e.contract_id, e.dv_id) AS existing_contract_id
FROM v n JOIN v e ON e.workspace_id = n.workspace_id AND e.h = n.h AND e.contract_id <> n.contract_id GROUP BY 1, 2, 3""")
def p10(spark, d):
    v = E.document_versions(spark, d).withColumn("workspace_id", F.col("contract_id") % 2).select("dv_id", "contract_id", "workspace_id", "sha256")
    return P.duplicate_content(v, v)


@_register("p11_stage_runs", with_ctes(["stage_events"], """
SELECT dv_id, stage, attempt, status, strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(CASE WHEN status <> 'running' THEN last_at END, '%Y-%m-%d %H:%M:%S') AS finished_at
FROM (SELECT dv_id, stage, attempt, arg_max(status, (happened_at, seq)) AS status, max(happened_at) FILTER (WHERE status = 'running') AS started, max(happened_at) AS last_at FROM stage_events GROUP BY 1, 2, 3)"""))
def p11(spark, d):
    runs, _ = P.stage_state(E.stage_events(spark, d))
    return runs.select("dv_id", "stage", "attempt", "status", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "finished_at")])


@_register("p11_next_attempt", with_ctes(["stage_events"], "SELECT dv_id, stage, max(attempt) + 1 AS next_attempt FROM stage_events GROUP BY 1, 2"))
def p11b(spark, d):
    return P.stage_state(E.stage_events(spark, d))[1]


@_register("p11_version_status", with_ctes(["stage_events"], """,
u AS (SELECT dv_id, happened_at, seq, stage = 'risk' AND status = 'failed' AS forced, CASE WHEN stage = 'risk' AND status = 'failed' THEN 'failed' WHEN status = 'succeeded' AND stage = 'summarizing' THEN 'ready' WHEN status = 'degraded' THEN 'sleeping' ELSE stage END AS status FROM stage_events),
ok AS (SELECT * FROM u WHERE status IN ('parsing', 'segmenting', 'extracting', 'summarizing', 'ready', 'failed')),
f AS (SELECT dv_id, max((happened_at, seq)) FILTER (WHERE forced) AS at FROM ok GROUP BY 1)
SELECT f.dv_id, CASE WHEN bool_or(o.status = 'ready') THEN 'ready' ELSE coalesce(arg_max(o.status, (o.happened_at, o.seq)), 'failed') END AS status
FROM f LEFT JOIN ok o ON o.dv_id = f.dv_id AND NOT o.forced AND (f.at IS NULL OR (o.happened_at, o.seq) > f.at) GROUP BY f.dv_id"""))
def p11c(spark, d):
    e = E.stage_events(spark, d)
    retry = (F.col("stage") == "risk") & (F.col("status") == "failed")
    status = (F.when(retry, "failed").when((F.col("status") == "succeeded") & (F.col("stage") == "summarizing"), "ready")
              .when(F.col("status") == "degraded", "sleeping").otherwise(F.col("stage")))
    return P.version_status(e.select("dv_id", "happened_at", "seq", retry.alias("forced"), status.alias("status")))


@_register("p12_members", with_ctes(["memberships", "users"], "SELECT workspace_id, m.user_id, email, display_name, role FROM memberships m JOIN users u ON u.user_id = m.user_id"))
def p12(spark, d):
    return P.members(E.memberships(spark, d), E.users(spark, d))


@_register("p12_sole_admins", """
SELECT g AS workspace_id, min(c_custkey) AS user_id FROM (SELECT c_custkey, c_custkey // 7 AS g FROM customer WHERE c_custkey % 6 = 5) GROUP BY g HAVING count(*) = 1""")
def p12b(spark, d):
    m = E.memberships(spark, d).withColumn("workspace_id", F.floor(F.col("user_id") / 7))
    return P.sole_admins(m)


_ACTS = list(K.ACTIONS)


@_register("p13_authorize", with_ctes(["memberships"], f"""
SELECT event_id, action, CASE WHEN role IS NULL THEN 'not_found' WHEN need = 'edit' AND role NOT IN ('external_signer', 'viewer') THEN 'allowed' WHEN need = 'review' AND role IN ('legal_reviewer', 'workspace_admin') THEN 'allowed'
       WHEN need = 'admin' AND role = 'workspace_admin' THEN 'allowed' ELSE 'forbidden' END AS decision
FROM (SELECT event_id, user_id, CAST(event_id % 25 AS BIGINT) AS w, ['{"', '".join(_ACTS)}'][CAST(event_id % {len(_ACTS)} AS INTEGER) + 1] AS action, ['{"', '".join(K.ACTIONS.values())}'][CAST(event_id % {len(_ACTS)} AS INTEGER) + 1] AS need FROM events) e
LEFT JOIN memberships m ON m.user_id = e.user_id AND m.workspace_id = CASE WHEN event_id % 3 = 0 THEN w ELSE m.workspace_id END"""))
def p13(spark, d):
    m = E.memberships(spark, d)
    e = F.col("event_id")
    home = m.select("user_id", F.col("workspace_id").alias("home"))
    act = F.element_at(F.array(*[F.lit(a) for a in _ACTS]), (e % len(_ACTS)).cast("int") + 1)
    acts = E.table(spark, d, "events").join(home, "user_id", "left").select(
        "event_id", "user_id", F.when(e % 3 == 0, e % 25).otherwise(F.col("home")).alias("workspace_id"), act.alias("action"))
    return P.authorize(acts, m).select("event_id", "action", "decision")


@_register("p14_scope", with_ctes(["contracts"], "SELECT contract_id, workspace_id FROM contracts WHERE workspace_id IN (SELECT CAST(n_nationkey AS BIGINT) FROM nation WHERE n_regionkey = 2)"))
def p14(spark, d):
    grants = E.table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("workspace_id"))
    return P.scope(E.contracts(spark, d), grants).select("contract_id", "workspace_id")


@_register("p15_constraint_audit", with_ctes(["obligations", "contracts", "risk_flags", "risk_decisions", "extracted_fields", "stage_events", "swept"], """
SELECT 'obligations' AS "table", CAST(obligation_id AS VARCHAR) AS row_key, 'due date or assumption' AS violation FROM obligations WHERE due_date IS NULL AND status NOT IN ('needs_assumption', 'suggested', 'rejected', 'void')
UNION ALL SELECT 'obligations', CAST(obligation_id AS VARCHAR), 'orphan contract_id' FROM obligations WHERE contract_id IN (SELECT contract_id FROM contracts WHERE deleted_at IS NOT NULL)
UNION ALL SELECT 'risk_decisions', decision_id, 'orphan flag_id' FROM risk_decisions WHERE flag_id IN (SELECT flag_id FROM risk_flags WHERE status = 'superseded')
UNION ALL SELECT 'citations', dv_id || ':' || field_key, 'span' FROM extracted_fields WHERE dv_id % 100 = 0
UNION ALL SELECT 'stages', concat_ws('|', dv_id, stage, attempt), 'unique(dv_id,stage,attempt)' FROM stage_events GROUP BY dv_id, stage, attempt HAVING count(*) > 1"""))
def p15(spark, d):
    fields = E.extracted_fields(spark, d)
    flags = E.risk_flags(spark, d)
    return P.constraint_audit({
        "contracts": E.contracts(spark, d).filter("deleted_at IS NULL"), "obligations": DQ.obligations(spark, d), "risk_flags": flags.filter("status <> 'superseded'"),
        "risk_decisions": E.risk_decisions(spark, d), "fields": fields, "stages": E.stage_events(spark, d),
        "citations": fields.select(F.col("field_id").alias("citation_id"), F.lit(0).alias("char_start"), (F.col("dv_id") % 100).alias("char_end"))})


# ------------------------------------------------------------------ sources, sinks, idempotent writes

def _files(spark, d):
    k = F.col("doc_id")
    docs = E.table(spark, d, "documents")
    content = F.when(k % 31 == 0, F.lit("").cast("binary")).otherwise(F.encode("text", "UTF-8"))
    files = docs.filter(k % 37 != 0).select(k.alias("dv_id"), content.alias("content")).withColumn("length", F.length("content").cast("long"))
    declared = docs.select(
        k.alias("dv_id"), F.when(k % 3 == 0, F.concat(F.lit("Scan."), "source", F.lit(".Pdf"))).otherwise(F.concat(F.lit("file"), k.cast("string"))).alias("filename"),
        F.when(k % 2 == 0, "text/plain").when(k % 5 == 0, "application/pdf").otherwise("image/png").alias("mime_type"),
        F.when(k % 29 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha256"))
    return io.ingest_documents(files, declared)


_INGEST = """
SELECT doc_id AS dv_id, CASE WHEN doc_id % 37 = 0 THEN 'missing content' WHEN doc_id % 31 = 0 OR length(text) = 0 THEN 'empty file' WHEN doc_id % 29 = 0 THEN 'hash mismatch' END AS reason,
       CASE WHEN doc_id % 3 = 0 THEN 'pdf' WHEN doc_id % 2 = 0 THEN 'txt' WHEN doc_id % 5 = 0 THEN 'pdf' ELSE 'bin' END AS extension, sha256(text) AS h FROM documents"""


@_register("s01_ingest_accepted", f"SELECT dv_id, extension, h AS sha256 FROM ({_INGEST}) WHERE reason IS NULL")
def s01(spark, d):
    return _files(spark, d)[0].select("dv_id", "extension", "sha256")


@_register("s01_ingest_rejected", f"SELECT dv_id, extension, reason FROM ({_INGEST}) WHERE reason IS NOT NULL")
def s01b(spark, d):
    return _files(spark, d)[1].select("dv_id", "extension", "reason")


@_register("s02_read_pages", with_ctes(["raw_pages"], "SELECT dv_id, page_number, ocr_derived, ocr_confidence, length(text) AS chars, sha256(text) AS h FROM raw_pages"))
def s02(spark, d):
    path = _scratch(spark, "pages")
    E.raw_pages(spark, d).drop("contract_id").write.json(path)
    return io.read_pages(spark, path, "json").select(
        "dv_id", "page_number", "ocr_derived", "ocr_confidence", F.length("text").alias("chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))


def _read_back(fmt):
    def query(spark, d):
        path = _scratch(spark, "pages")
        rows = E.raw_pages(spark, d).drop("contract_id")
        writer = rows.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) if fmt == "csv" else rows.write
        writer.format(fmt).save(path)
        return io.read_pages(spark, path, fmt).select(
            "dv_id", "page_number", "ocr_derived", "ocr_confidence", F.length("text").alias("chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    return query


for _fmt in ("csv", "orc", "parquet"):
    _register(f"s02_read_pages_{_fmt}", QUERIES["s02_read_pages"][1])(_read_back(_fmt))


@_register("s03_read_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 250000")
def s03(spark, d):
    return io.read_table(spark, d, "orders", ["o_orderkey", "o_totalprice"], (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 250000))


def _tabs(spark, d):
    decided = R.latest_decision(E.risk_decisions(spark, d), E.users(spark, d))
    return P.portfolio_tabs(E.contracts(spark, d), DQ.obligations(spark, d), E.risk_flags(spark, d), decided, E.users(spark, d), E.order_citations(spark, d))


_MONEY = """coalesce(currency, 'USD') || ' ' || rtrim(rtrim(format('{:,.2f}', value_minor / 100.0), '0'), '.')"""


@_register("s04_tab_contracts", with_ctes(["contracts", "risk_flags", "users"], f"""
SELECT c.workspace_id, title AS "Contract name", coalesce(counterparty, '') AS "Counterparty", coalesce(contract_type, '') AS "Type", status AS "Status", coalesce(u.display_name, '') AS "Owner",
       CASE WHEN value_minor IS NULL THEN '' ELSE {_MONEY} END AS "Value", coalesce(CAST(effective_date AS VARCHAR), '') AS "Effective date", coalesce(CAST(expiration_date AS VARCHAR), '') AS "Expiration date",
       coalesce(CAST(renewal_notice_by AS VARCHAR), '') AS "Renewal notice by", coalesce(n, 0) AS "Open risk flags", strftime(updated_at, '%Y-%m-%d %H:%M') AS "Last activity", '/w/contracts' AS "Link", CAST(c.contract_id AS VARCHAR) AS "_id"
FROM contracts c LEFT JOIN users u ON u.user_id = c.owner_user_id LEFT JOIN (SELECT contract_id, count(*) AS n FROM risk_flags WHERE status = 'open' GROUP BY 1) f ON f.contract_id = c.contract_id WHERE deleted_at IS NULL"""))
def s04(spark, d):
    return _tabs(spark, d)["contracts"]


@_register("s04_tab_obligations", with_ctes(["obligations", "contracts", "users", "order_citations"], """
SELECT o.workspace_id, o.title AS "Title", c.title AS "Contract", obligor AS "Obligor", obligee AS "Obligee", coalesce(CAST(due_date AS VARCHAR), '') AS "Due date", coalesce(due_date_math, '') AS "Due date logic", priority AS "Priority", o.status AS "Status",
       coalesce(u.display_name, '') AS "Owner", coalesce(ci.quoted_text || ' (p.' || ci.page || ')', '') AS "Source citation", '/w/contracts' AS "Link", CAST(obligation_id AS VARCHAR) AS "_id"
FROM obligations o JOIN contracts c ON c.contract_id = o.contract_id LEFT JOIN users u ON u.user_id = o.owner_user_id LEFT JOIN order_citations ci ON ci.citation_id = o.citation_id"""))
def s04b(spark, d):
    return _tabs(spark, d)["obligations"]


@_register("s04_tab_risk_flags", with_ctes(["risk_flags", "contracts", "users", "order_citations", "risk_decisions"], """
SELECT f.workspace_id, c.title AS "Contract", f.title AS "Flag", category AS "Category", severity AS "Severity", CASE WHEN confidence IS NULL THEN '' ELSE format('{:.2f}', confidence) END AS "Confidence", f.status AS "Status", coalesce(l.decision, '') AS "Decision",
       coalesce(u.display_name, '') AS "Decided by", coalesce(ci.quoted_text || ' (p.' || ci.page || ')', '') AS "Source citation", '/w/risk' AS "Link", f.flag_id AS "_id"
FROM risk_flags f JOIN contracts c ON c.contract_id = f.contract_id LEFT JOIN order_citations ci ON ci.citation_id = f.citation_id
LEFT JOIN (SELECT * FROM risk_decisions QUALIFY row_number() OVER (PARTITION BY flag_id ORDER BY created_at DESC, decision_id DESC) = 1) l ON l.flag_id = f.flag_id LEFT JOIN users u ON u.user_id = l.decided_by"""))
def s04c(spark, d):
    flags = E.risk_flags(spark, d, E.contracts(spark, d), E.order_citations(spark, d))
    return P.risk_tab(flags, None, R.latest_decision(E.risk_decisions(spark, d, known=False), E.users(spark, d)), None)


def _sections(spark, d):
    k = F.col("dv_id")
    fields = E.extracted_fields(spark, d, _current(spark, d)).withColumns({
        "label": F.concat(F.lit("Field "), "field_key"), "primary_citation_id": F.when(F.col("value_text").isNotNull(), k - k % 6)})
    rule = F.to_json(F.struct("anchor", "offset_days", "calendar", "recurrence"))
    obligations = DQ.obligations(spark, d).withColumns({"description": F.when(F.col("obligation_id") % 2 == 0, F.concat_ws(" to ", "obligor", "obligee")), "rule": rule})
    return P.export_sections(_versioned(spark, d), fields, obligations, E.risk_flags(spark, d))


@_register("s05_export_fields", with_ctes(["versioned", "extracted_fields"], """
SELECT f.workspace_id, v.title AS contract, f.field_id, f.field_key, 'Field ' || f.field_key AS label, f.field_group, coalesce(f.value_text, '') AS value, f.confidence, f.validation_status,
  CASE WHEN f.value_text IS NULL THEN '' ELSE CAST(f.dv_id - f.dv_id % 6 AS VARCHAR) END AS citation, 'AI assistance, not legal advice' AS disclaimer FROM extracted_fields f JOIN versioned v ON v.current_version_id = f.dv_id WHERE extraction_kind = 'factual'"""))
def s05(spark, d):
    return _sections(spark, d)["fields"]


@_register("s05_export_obligations", with_ctes(["obligations", "contracts"], """
SELECT o.workspace_id, rank, obligation_id, c.title AS contract, o.title, CASE WHEN obligation_id % 2 = 0 THEN obligor || ' to ' || obligee ELSE '' END AS description,
  '{"anchor":"' || anchor || '","offset_days":' || offset_days || ',"calendar":"' || calendar || '","recurrence":"' || recurrence || '"}' AS rule, coalesce(CAST(due_date AS VARCHAR), '') AS due_date, coalesce(due_date_math, '') AS due_date_math, priority, o.status, CASE WHEN o.status = 'needs_assumption' THEN 'yes' ELSE 'no' END AS needs_assumption
FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, obligation_id) AS rank FROM obligations) o JOIN contracts c ON c.contract_id = o.contract_id"""))
def s05b(spark, d):
    return _sections(spark, d)["obligations"]


@_register("s05_export_risk_flags", with_ctes(["risk_flags", "contracts"], """
SELECT f.workspace_id, rank, flag_id, c.title AS contract, f.title, severity, category, confidence, f.status, recommended_step
FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, flag_id) AS rank FROM risk_flags) f JOIN contracts c ON c.contract_id = f.contract_id WHERE f.status <> 'superseded'"""))
def s05c(spark, d):
    return _sections(spark, d)["risk_flags"]


def _snapshots(spark, d):
    new = E.table(spark, d, "orders").filter("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = E.table(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    return new, old


_STATE = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'created' WHEN o_orderkey % 5 = 0 THEN 'removed' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0"""


@_register("s06_snapshot_diff", _STATE)
def s06(spark, d):
    return io.snapshot_diff(*_snapshots(spark, d), "o_orderkey")


@_register("s06_sync_counts", f"""SELECT count(*) FILTER (WHERE state = 'created') AS created_rows, count(*) FILTER (WHERE state IN ('changed', 'unchanged')) AS updated_rows,
count(*) FILTER (WHERE state = 'changed') AS changed_rows, count(*) FILTER (WHERE state = 'removed') AS removed_rows FROM ({_STATE})""")
def s06b(spark, d):
    return io.sync_counts(*_snapshots(spark, d), "o_orderkey")


def _upsert_inputs(spark, d):
    base = E.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("base").alias("origin"), F.col("o_totalprice").alias("amount"))
    upd = E.table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("id"), E.concat("line ", F.col("l_partkey") + 1000000).alias("origin"), F.col("l_extendedprice").alias("amount"))
    return base, upd


_UPD = "SELECT l_orderkey * 2 AS id, 'line ' || (l_partkey + 1000000) AS origin, l_extendedprice AS amount FROM lineitem"


@_register("s07_upsert_ignore", f"""SELECT o_orderkey AS id, 'base' AS origin, o_totalprice AS amount FROM orders UNION ALL
SELECT id, arg_min(origin, (origin, amount)), arg_min(amount, (origin, amount)) FROM ({_UPD}) WHERE id NOT IN (SELECT o_orderkey FROM orders) GROUP BY id""")
def s07(spark, d):
    return io.upsert(*_upsert_inputs(spark, d), ["id"], "ignore")


@_register("s07_upsert_update", f"""SELECT coalesce(o.o_orderkey, u.id) AS id, coalesce(CASE WHEN o.o_orderkey IS NOT NULL THEN 'base' END, u.origin) AS origin, coalesce(u.amount, o.o_totalprice) AS amount
FROM orders o FULL OUTER JOIN (SELECT id, arg_max(origin, (origin, amount)) AS origin, arg_max(amount, (origin, amount)) AS amount FROM ({_UPD}) GROUP BY id) u ON u.id = o.o_orderkey""")
def s07b(spark, d):
    return io.upsert(*_upsert_inputs(spark, d), ["id"], "update", columns=["amount"])


@_register("s08_replace_slice", with_ctes(["obligations"], """
SELECT contract_id, obligation_id, status, 0 AS run FROM obligations WHERE NOT (status = 'suggested' AND contract_id IN (SELECT contract_id FROM obligations WHERE priority = 'critical'))
UNION ALL SELECT contract_id, obligation_id, 'suggested', 1 FROM obligations WHERE priority = 'critical'"""))
def s08(spark, d):
    base = DQ.obligations(spark, d).select("contract_id", "obligation_id", "status", "priority", F.lit(0).alias("run"))
    new = base.filter("priority = 'critical'").withColumns({"status": F.lit("suggested"), "run": F.lit(1)})
    return io.replace_slice(base, new, ["contract_id"], F.col("status") == "suggested").drop("priority")


@_register("s09_briefs", """
SELECT doc_id AS dv_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS sentences, CASE WHEN doc_id % 4 <> 0 THEN 'About ' || source END AS first_text, 0 AS questions FROM documents""")
def s09(spark, d):
    k = F.col("doc_id")
    docs = E.table(spark, d, "documents")
    made = F.struct(F.array(F.struct(F.concat(F.lit("About "), "source").alias("text"), F.array(k.cast("string")).alias("field_ids"), F.lit(0.5).alias("self_confidence"))).alias("interpretation"),
                    F.array().cast("array<struct<question:string,field_ids:array<string>>>").alias("open_questions"))
    path = _scratch(spark, "briefs")
    io.write_briefs(docs.filter(k % 4 != 0).select((k % 5).alias("workspace_id"), k.alias("dv_id"), made.alias("brief")), path)
    out = io.read_briefs(spark, path, docs.select(k.alias("dv_id")))
    return out.select("dv_id", F.size("interpretation").alias("sentences"), F.get("interpretation", F.lit(0))["text"].alias("first_text"), F.size("open_questions").alias("questions"))


@_register("s10_audit_rows", """
SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, 'sync' AS actor, 'order.sync' AS action,
       CASE WHEN o_orderkey % 7 <> 0 THEN sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END || '"}') END AS before_hash,
       CASE WHEN o_orderkey % 5 <> 0 THEN sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') END AS after_hash
FROM orders WHERE (o_orderkey % 7 = 0) <> (o_orderkey % 5 = 0) OR (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0)""")
def s10(spark, d):
    new, old = _snapshots(spark, d)
    return io.audit_rows(old.drop("o_totalprice"), new.drop("o_totalprice"), "o_orderkey", F.lit("sync"), "order.sync")


def _payloads(spark, d):
    n = F.col("l_partkey") % 8
    obj = F.struct(
        F.when(n != 1, F.lit("missing_clause")).alias("flag_type"), F.when(n == 2, "legalish").otherwise("legal").alias("category"), F.lit("T").alias("title"), F.lit("E").alias("explanation"),
        F.when(n == 3, "severe").otherwise("high").alias("severity"), F.lit("S").alias("recommended_step"), F.lit("legal").alias("suggested_reviewer_role"), F.lit("factual").alias("extraction_kind"),
        F.array(F.struct(F.when(n == 4, 0).otherwise(1).alias("page"), F.lit(0).alias("char_start"), F.lit(5).alias("char_end"), F.lit("quote").alias("quoted_text"))).alias("evidence"),
        F.when(n == 5, 1.5).otherwise(F.col("l_discount")).alias("self_confidence"))
    text = F.to_json(obj)
    payload = F.when(n == 6, F.substring(text, 1, 20)).otherwise(text)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    raw = E.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("row_id"), payload.alias("payload"))
    return io.parse_candidates(raw, "flag")


_ROWID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id"


@_register("s11_valid_candidates", f"SELECT {_ROWID}, 'missing_clause' AS flag_type, 'high' AS severity, 1 AS quotes, l_discount AS self_confidence FROM lineitem WHERE l_partkey % 8 IN (0, 7)")
def s11(spark, d):
    return _payloads(spark, d)[0].select("row_id", "flag_type", "severity", F.size("evidence").alias("quotes"), "self_confidence")


@_register("s11_invalid_candidates", f"""
SELECT {_ROWID}, CASE l_partkey % 8 WHEN 1 THEN 'bad flag_type' WHEN 2 THEN 'bad category' WHEN 3 THEN 'bad severity' WHEN 4 THEN 'bad evidence' WHEN 5 THEN 'range self_confidence' ELSE 'malformed' END AS problems FROM lineitem WHERE l_partkey % 8 BETWEEN 1 AND 6""")
def s11b(spark, d):
    return _payloads(spark, d)[1].select("row_id", F.array_join("problems", ",").alias("problems"))


_QUOTE = {"page": 1, "char_start": 0, "char_end": 5, "quoted_text": "quote"}
#: A valid payload of each kind; a required field, an enumerated one with a wrong value and one out of range, where the kind has them.
_KINDS = {
    "classify": ({"doc_type": "nda", "language": "en", "is_amendment": False, "confidence": 0.5, "suspicious_content": False}, "language", ("doc_type", "poem"), ("confidence", 1.5)),
    "field": ({"field_key": "k", "label": "L", "status": "found", "extraction_kind": "factual", "evidence": [_QUOTE], "searched_sections": ["1"], "self_confidence": 0.5},
              "field_key", ("status", "perhaps"), ("self_confidence", -0.1)),
    "obligation": ({"title": "T", "obligor": "A", "obligee": "B", "due_rule": K.DUE_RULES[0], "due_rule_detail": {"anchor": "absolute", "calendar": "business"}, "anchor_known": True,
                    "grace_period_days": 0, "priority": "low", "extraction_kind": "factual", "evidence": [_QUOTE], "self_confidence": 0.5},
                   "obligor", ("priority", "urgent"), ("grace_period_days", -1)),
    "flag": ({"flag_type": "one_sided", "category": "legal", "title": "T", "explanation": "E", "severity": "low", "recommended_step": "S", "suggested_reviewer_role": "legal",
              "extraction_kind": "factual", "evidence": [_QUOTE], "self_confidence": 0.5}, "explanation", ("category", "sport"), ("self_confidence", 2)),
    "change": ({"change_type": "moved", "impact_category": "money", "is_material": True, "business_impact": "I", "risk_delta": "decreased", "suggested_reviewer_role": "legal",
                "evidence": [_QUOTE], "self_confidence": 0.5}, "business_impact", ("risk_delta", "sideways"), ("self_confidence", 2)),
    "answer": ({"answer_kind": "grounded", "claims": [{"text": "t", "evidence_ids": ["chk_0"], "kind": "fact"}], "self_confidence": 0.5}, "claims", ("answer_kind", "shrug"), ("self_confidence", 2)),
    "brief": ({"interpretation": [], "open_questions": [], "suspicious_content": False}, "open_questions", None, None),
}


def _variants(kind):
    """Five payloads of a kind with the problems that intake should find: valid, a field missing, a wrong value, a value out of range, cut off."""
    good, needed, wrong, beyond = _KINDS[kind]
    missing = {k: v for k, v in good.items() if k != needed}
    rows = [(json.dumps(good), ""), (json.dumps(missing), f"missing {needed}")]
    rows += [(json.dumps({**good, f: v}), f"{what} {f}") for what, (f, v) in (("bad", wrong or ("", "")), ("range", beyond or ("", ""))) if f]
    return [*rows, (json.dumps(good)[:20], "malformed")]


@_register("s11_all_kinds", " UNION ALL ".join(
    f"SELECT o_orderkey, '{kind}' AS kind, CASE o_orderkey % {len(_variants(kind))} " + " ".join(f"WHEN {i} THEN '{p}'" for i, (_, p) in enumerate(_variants(kind))) + " END AS problems FROM orders" for kind in _KINDS))
def s11c(spark, d):
    orders = E.table(spark, d, "orders").select("o_orderkey")
    out = []
    for kind in _KINDS:
        texts = F.array(*[F.lit(x) for x, _ in _variants(kind)])
        raw = orders.withColumn("payload", F.get(texts, (F.col("o_orderkey") % len(_variants(kind))).cast("int")))
        valid, invalid = io.parse_candidates(raw, kind)
        out += [valid.select("o_orderkey", F.lit(kind).alias("kind"), F.lit("").alias("problems")),
                invalid.select("o_orderkey", F.lit(kind).alias("kind"), F.array_join("problems", ",").alias("problems"))]
    return E.union_all(out)
