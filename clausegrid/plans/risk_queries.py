"""Registered queries: risk flags, playbook, comparison of versions, derived obligations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import text as T
from clausegrid.operators import compare as C
from clausegrid.operators import obligations as O
from clausegrid.operators import risk as R
from clausegrid.plans import citation_queries as CQ
from clausegrid.plans import date_queries as DQ
from clausegrid.plans import entities as E
from clausegrid.plans import sqltext as Q
from clausegrid.plans import text_queries as TQ
from clausegrid.plans.entities import CTE, with_ctes
from clausegrid.session import unwrite, written

QUERIES: dict = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _evidence_list():
    return F.array(F.struct("page", "char_start", "char_end", "quoted_text"))


@_register("d05_derive_obligations", with_ctes(["ev_resolved", "anchors"], f"""
SELECT citation_id, dv_id, title, status, risk_note, confidence, CAST(CASE WHEN status = 'suggested' THEN due END AS VARCHAR) AS due_date FROM (
  SELECT *, CASE WHEN known AND start IS NOT NULL THEN 'suggested' ELSE 'needs_assumption' END AS status, CASE WHEN page % 4 = 0 THEN raw + CASE isodow(raw) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END ELSE raw END AS due FROM (
    SELECT e.*, CASE WHEN (e.dv_id + page) % 5 = 0 THEN 'Deliver certified goods' ELSE 'Deliver goods' END AS title,
           CASE WHEN (e.dv_id + page) % 5 = 0 THEN 'Review required: output triggered the safety lint.' END AS risk_note,
           {Q.blend('(e.dv_id % 101) / 100.0', '0.8::DOUBLE', 'score', 'ocr_derived')} AS confidence, e.dv_id % 10 <> 3 AS known,
           CAST(CASE page % 3 WHEN 0 THEN a.effective_date WHEN 1 THEN a.expiration_date END AS DATE) AS start,
           CAST(CASE page % 3 WHEN 0 THEN a.effective_date WHEN 1 THEN a.expiration_date END AS DATE) + CAST(page * 7 - 20 AS INTEGER) AS raw
    FROM ev_resolved e LEFT JOIN anchors a ON a.dv_id = e.dv_id WHERE resolvable AND (e.dv_id + 2 * page) % 9 <> 0))"""))
def d05(spark, d):
    ev, p = CQ.evidence(spark, d)
    out = R.derive_obligations(obligation_candidates(ev), O.anchors(E.extracted_fields(spark, d, keys=K.ANCHOR_FIELDS.values())), p)
    return out.select("citation_id", "dv_id", "title", "status", "risk_note", "confidence", F.col("due_date").cast("string").alias("due_date"))


def obligation_candidates(ev):
    dv, pg = F.col("dv_id"), F.col("page")
    return ev.select(
        "citation_id", "dv_id", pg.alias("n"), F.when((dv + pg) % 5 == 0, "Deliver certified goods").otherwise("Deliver goods").alias("title"),
        F.lit(None).cast("string").alias("description"), F.when(pg % 3 == 0, "effective_date").when(pg % 3 == 1, "expiration_date").otherwise("event:launch").alias("anchor"),
        F.lit(None).cast("date").alias("anchor_value"), (pg * 7 - 20).alias("offset_days"), F.when(pg % 4 == 0, "business").otherwise("calendar").alias("calendar"),
        (dv % 10 != 3).alias("anchor_known"), F.when((dv + 2 * pg) % 9 != 0, _evidence_list()).otherwise(F.slice(_evidence_list(), 1, 0)).alias("evidence"),
        ((dv % 101) / 100.0).alias("self_confidence"))


@_register("k01_build_flags", with_ctes(["ev_resolved"], f"""
SELECT citation_id, dv_id, 'Flag ' || page AS title, {Q.blend('(dv_id % 101) / 100.0', '0.8::DOUBLE', 'score', 'ocr_derived')} AS confidence, 'open' AS status, CAST(final_start AS INTEGER) AS char_start
FROM ev_resolved WHERE resolvable AND (dv_id + 2 * page) % 9 <> 0 AND (dv_id + page) % 7 <> 0"""))
def k01(spark, d):
    ev, p = CQ.evidence(spark, d)
    return R.build_flags(flag_candidates(ev), p).select("citation_id", "dv_id", "title", "confidence", "status", "char_start")


def flag_candidates(ev):
    dv, pg = F.col("dv_id"), F.col("page")
    return ev.select(
        "citation_id", "dv_id", E.concat("Flag ", pg).alias("title"), F.when((dv + pg) % 7 == 0, "You should terminate.").otherwise("Differs from the playbook.").alias("explanation"),
        F.lit("Ask the owner").alias("recommended_step"), F.when(dv % 2 == 0, F.col("quoted_text")).alias("found_text"),
        F.when((dv + 2 * pg) % 9 != 0, _evidence_list()).otherwise(F.slice(_evidence_list(), 1, 0)).alias("evidence"), ((dv % 101) / 100.0).alias("self_confidence"))


#: Largest value that the fixture gives each numeric field, and the date fields it fills (plans/entities.py).
_RANGES = {"commercial.payment_net_days": 59, "liability.cap_months": 23, "renewal.notice_period_days": 89, "confidentiality.years": 5}
_DATES = ["dates.expiration", "dates.signature", "dates.effective", "dates.commencement"]
_REVIEWERS = ["legal", "finance", "security", "privacy", "procurement", "business"]
#: Rules of the fixture: evaluator type, field, comparison, value, outcome, reviewer, severity. Both halves of every numeric range, one exact
#: value, and presence of each date.
FIXTURE_RULES = [
    ("threshold", field, op, str(top // 2), ("review_required", "unacceptable")[i % 2], _REVIEWERS[i % 6], K.SEVERITIES[i % 4])
    for i, (field, top, op) in enumerate((f, t, op) for f, t in _RANGES.items() for op in ("<=", ">="))
] + [("threshold", "confidentiality.years", "==", "3", "review_required", "privacy", "low")] + [
    ("presence", field, "==", "true", "unacceptable", _REVIEWERS[i], K.SEVERITIES[3 - i]) for i, field in enumerate(_DATES)
]


def rules(spark, d):
    specs = F.array(*[F.struct(
        F.lit(i).alias("n"), F.lit(f'{{"type":"{kind}","field":"{field}","op":"{op}","value":{value}}}').alias("evaluator"),
        F.lit(outcome).alias("outcome"), F.lit(sev).alias("severity"), F.lit(reviewer).alias("reviewer_role"))
        for i, (kind, field, op, value, outcome, reviewer, sev) in enumerate(FIXTURE_RULES)])
    return E.workspaces(spark, d).select("workspace_id", F.explode(specs).alias("s")).select(
        "workspace_id", E.concat(F.col("workspace_id"), ".", F.col("s.n")).alias("rule_id"), "s.evaluator", "s.outcome", "s.severity", "s.reviewer_role",
        ((F.col("workspace_id") + F.col("s.n")) % 11 != 0).alias("active"))


_PB = ", ".join(f"({i}, '{k}', '{f}', '{op}', '{v}', '{o}', '{s}', '{r}')" for i, (k, f, op, v, o, r, s) in enumerate(FIXTURE_RULES))


@_register("k02_playbook", with_ctes(["extracted_fields"], f"""
SELECT dv_id, workspace_id, rule_id, field_key, result, CASE WHEN result = 'violated' THEN outcome END AS outcome, severity, reviewer_role FROM (
  SELECT v.dv_id, v.workspace_id, v.workspace_id || '.' || p.n AS rule_id, p.field AS field_key, p.outcome, p.severity, p.reviewer AS reviewer_role,
         CASE WHEN p.kind = 'presence' THEN CASE WHEN f.dv_id IS NOT NULL THEN 'ok' ELSE 'violated' END
              WHEN f.value IS NULL THEN 'not_evaluated' WHEN p.op = '>=' AND TRY_CAST(f.value AS DOUBLE) >= TRY_CAST(p.value AS DOUBLE) THEN 'ok' WHEN p.op = '<=' AND TRY_CAST(f.value AS DOUBLE) <= TRY_CAST(p.value AS DOUBLE) THEN 'ok' WHEN p.op = '==' AND f.value = p.value THEN 'ok' ELSE 'violated' END AS result
  FROM (SELECT o_orderkey AS dv_id, CAST(c_nationkey AS BIGINT) AS workspace_id FROM orders JOIN customer ON c_custkey = o_custkey) v
  JOIN (VALUES {_PB}) p(n, kind, field, op, value, outcome, severity, reviewer) ON (v.workspace_id + p.n) % 11 <> 0
  LEFT JOIN (SELECT dv_id, field_key, coalesce(json_extract_string(CASE WHEN value_normalized LIKE '{{%' THEN value_normalized END, '$.value'), json_extract_string(CASE WHEN value_normalized LIKE '{{%' THEN value_normalized END, '$.days')) AS value
             FROM extracted_fields WHERE value_text IS NOT NULL AND validation_status <> 'not_found') f ON f.dv_id = v.dv_id AND f.field_key = p.field)"""))
def k02(spark, d):
    home = E.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("workspace_id"))
    versions = E.table(spark, d, "orders").join(home, "o_custkey").select(F.col("o_orderkey").alias("dv_id"), "workspace_id")
    return R.evaluate_playbook(versions, E.extracted_fields(spark, d), rules(spark, d))


_SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def _queue_sql(where):
    return with_ctes(["risk_flags", "contracts"], f"""
SELECT q.workspace_id, q.rank, q.flag_id, q.contract_id, c.title AS contract_title, q.severity, q.status FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY {_SEV}, created_at DESC, flag_id) AS rank FROM risk_flags WHERE {where}) q JOIN contracts c ON c.contract_id = q.contract_id""")


def _queue(spark, d, **kw):
    return R.risk_queue(E.risk_flags(spark, d), E.contracts(spark, d), **kw).select("workspace_id", "rank", "flag_id", "contract_id", "contract_title", "severity", "status")


@_register("k03_review_queue", _queue_sql("status = 'open'"))
def k03(spark, d):
    return _queue(spark, d)


@_register("k03_review_queue_medium", _queue_sql("severity = 'medium'"))
def k03b(spark, d):
    return _queue(spark, d, status="all", severity="medium")


@_register("k03_severity_counts", with_ctes(["risk_flags"], "SELECT workspace_id, severity, count(*) AS flags FROM risk_flags WHERE status = 'open' GROUP BY 1, 2"))
def k03c(spark, d):
    return R.risk_counts(E.risk_flags(spark, d))


@_register("k04_open_flags", with_ctes(["risk_flags"], f"SELECT workspace_id, contract_id, count(*) AS flags, arg_min(severity, {_SEV}) AS worst, max(severity) AS text_max FROM risk_flags WHERE status = 'open' GROUP BY 1, 2"))
def k04(spark, d):
    return R.open_flags(E.risk_flags(spark, d))


@_register("k05_latest_decision", with_ctes(["risk_decisions", "users"], """
SELECT flag_id, decision_id, decision, decided_by, u.display_name AS decider FROM (SELECT * FROM risk_decisions QUALIFY row_number() OVER (PARTITION BY flag_id ORDER BY created_at DESC, decision_id DESC) = 1) LEFT JOIN users u ON u.user_id = decided_by"""))
def k05(spark, d):
    return R.latest_decision(E.risk_decisions(spark, d), E.users(spark, d)).select("flag_id", "decision_id", "decision", "decided_by", "decider")


@_register("k05_decision_history", with_ctes(["risk_decisions"], "SELECT flag_id, decision_id, decision, row_number() OVER (PARTITION BY flag_id ORDER BY created_at DESC, decision_id DESC) AS newest FROM risk_decisions"))
def k05b(spark, d):
    return R.decision_history(E.risk_decisions(spark, d)).select("flag_id", "decision_id", "decision", "newest")


@_register("k06_fold_flags", with_ctes(["risk_flags", "risk_decisions"], """
SELECT f.flag_id, CASE WHEN l.decision IS NULL THEN f.status WHEN l.decision = 'reopened' THEN 'open' ELSE 'decided' END AS status, l.decision AS last_decision
FROM risk_flags f LEFT JOIN (SELECT flag_id, arg_max(decision, (created_at, decision_id)) AS decision FROM risk_decisions GROUP BY 1) l ON l.flag_id = f.flag_id"""))
def k06(spark, d):
    return R.fold_flags(E.risk_flags(spark, d), E.risk_decisions(spark, d)).select("flag_id", "status", "last_decision")


@_register("k07_approval_gate", with_ctes(["contracts", "risk_flags", "obligations"], """
SELECT c.contract_id, coalesce(f.n, 0) AS open_flags, coalesce(o.n, 0) AS open_assumptions, CASE WHEN coalesce(f.n, 0) > 0 OR coalesce(o.n, 0) > 0 THEN 'blocked' ELSE 'unblocked' END AS gate
FROM contracts c LEFT JOIN (SELECT contract_id, count(*) AS n FROM risk_flags WHERE status = 'open' AND severity IN ('critical', 'high') GROUP BY 1) f USING (contract_id)
LEFT JOIN (SELECT contract_id, count(*) AS n FROM obligations WHERE needs_assumption GROUP BY 1) o USING (contract_id)"""))
def k07(spark, d):
    obs = DQ.obligations(spark, d).withColumn("status", F.when(F.col("needs_assumption"), "needs_assumption").otherwise(F.col("status")))
    return R.approval_gate(E.contracts(spark, d), E.risk_flags(spark, d), obs).select("contract_id", "open_flags", "open_assumptions", "gate")


# ------------------------------------------------------------------ version comparison

def version_pairs(spark, d):
    """Every two consecutive versions of a contract."""
    return C.consecutive_versions(E.contract_texts(spark, d).select("contract_id", "dv_id", "version_number"))


def sides(spark, d):
    """Clauses of the base and of the target version of every comparison, without their texts but with digest and length; all clauses; pages."""
    cl, p = TQ.clauses(spark, d)
    columns = ["clause_id", "dv_id", "section_ref", "section_title", "char_start", "char_end"]
    cl = written(cl.select(*columns, "text", C.form_of("text").alias("form"), F.length(T.normalize_for_compare("text")).alias("size")))
    ids, pairs = cl.select(*columns, "form", "size"), version_pairs(spark, d)
    base = written(ids.join(pairs.select("pair_id", F.col("base_id").alias("dv_id")), "dv_id"))
    target = written(ids.join(pairs.select("pair_id", F.col("target_id").alias("dv_id")), "dv_id"))
    return base, target, cl.select("clause_id", "text"), p


def changeable(spark, d):
    """Aligned clauses that can be changes (one-sided or of different text) with their texts, and the pages."""
    base, target, texts, p = sides(spark, d)
    aligned = C.align_clauses(base, target, texts=texts)
    pairs = written(C.with_texts(aligned, base, target, texts))
    unwrite(base, target, aligned, texts)
    return pairs, p


CTE["compared"] = (["contract_texts"], """
SELECT base_id || '>' || dv_id AS pair_id, contract_id, base_id, dv_id AS target_id, base_version, version_number AS target_version
FROM (SELECT *, lag(dv_id) OVER w AS base_id, lag(version_number) OVER w AS base_version FROM contract_texts WINDOW w AS (PARTITION BY contract_id ORDER BY version_number, dv_id)) WHERE base_id IS NOT NULL""")
CTE["sides"] = (["clauses", "compared"], "SELECT c.*, p.pair_id, 0 AS side FROM clauses c JOIN compared p ON p.base_id = c.dv_id UNION ALL SELECT c.*, p.pair_id, 1 FROM clauses c JOIN compared p ON p.target_id = c.dv_id")
CTE["by_section"] = (["sides"], """
SELECT b.pair_id, b.clause_id AS base_id, b.char_start AS base_ord, t.target_id FROM sides b
JOIN (SELECT pair_id, section_ref, arg_max(clause_id, (char_start, clause_id)) AS target_id FROM sides WHERE side = 1 AND section_ref IS NOT NULL GROUP BY 1, 2) t ON t.pair_id = b.pair_id AND t.section_ref = b.section_ref WHERE b.side = 0""")
CTE["sim_pairs"] = (["sides", "by_section"], f"""
SELECT b.pair_id, b.clause_id || '>' || t.clause_id AS eid, b.clause_id AS base_id, b.char_start AS base_ord, t.clause_id AS target_id, t.char_start AS target_ord,
       {Q.norm_compare('b.text')} AS na, {Q.norm_compare('t.text')} AS nb
FROM sides b JOIN sides t ON t.pair_id = b.pair_id AND t.side = 1 LEFT JOIN (SELECT target_id, min(base_ord) AS taken_at FROM by_section GROUP BY 1) k ON k.target_id = t.clause_id
WHERE b.side = 0 AND b.clause_id NOT IN (SELECT base_id FROM by_section) AND (k.taken_at IS NULL OR k.taken_at > b.char_start)""")
CTE["sim_edges"] = (["sim_pairs"], f"""
SELECT p.*, s.score, dense_rank() OVER (PARTITION BY pair_id ORDER BY base_ord, base_id) AS turn FROM sim_pairs p JOIN ({Q.dice_table('sim_pairs', 'eid', 'na', 'nb')}) s USING (eid) WHERE s.score > 0.6""")


@_register("k08_similar_clauses", with_ctes(["sim_edges"], "SELECT pair_id, base_id, target_id, round(score, 6) AS score FROM sim_edges"))
def k08b(spark, d):
    base, target, texts, _ = sides(spark, d)
    by_ref = target.filter("section_ref IS NOT NULL").groupBy("pair_id", "section_ref").agg(F.max_by("clause_id", F.struct("char_start", "clause_id")).alias("target_id"))
    joined = written(base.select("pair_id", "clause_id", "section_ref", "char_start", "form", "size").join(by_ref, ["pair_id", "section_ref"], "left"))
    rest = joined.filter("target_id IS NULL").select("pair_id", "clause_id", F.col("char_start").alias("ord"), "form", "size")
    taken = joined.filter("target_id IS NOT NULL").groupBy(F.col("target_id").alias("clause_id")).agg(F.min("char_start").alias("until"))
    offered = target.select("pair_id", "clause_id", "form", "size").join(taken, "clause_id", "left")
    edges = C.similar_clauses(rest, offered, texts=texts)
    return edges.select("pair_id", "base_id", "target_id", F.round("score", 6).alias("score"))


CTE["walked"] = (["sim_edges"], """
SELECT pair_id, base_id, base_ord, target_id FROM (
  WITH RECURSIVE walk AS (
    SELECT DISTINCT pair_id, 0::BIGINT AS turn, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS base_id, CAST(NULL AS BIGINT) AS base_ord, CAST(NULL AS VARCHAR) AS target_id FROM sim_edges
    UNION ALL
    SELECT n.pair_id, n.turn, CASE WHEN n.target_id IS NULL THEN n.used ELSE list_append(n.used, n.target_id) END, n.base_id, n.base_ord, n.target_id FROM (
      SELECT w.pair_id, w.turn + 1 AS turn, any_value(w.used) AS used, min(e.base_id) AS base_id, min(e.base_ord) AS base_ord,
             arg_max(e.target_id, (e.score, -e.target_ord, e.target_id)) FILTER (WHERE NOT list_contains(w.used, e.target_id)) AS target_id
      FROM walk w JOIN sim_edges e ON e.pair_id = w.pair_id AND e.turn = w.turn + 1 GROUP BY w.pair_id, w.turn) n)
  SELECT * FROM walk) WHERE target_id IS NOT NULL""")
CTE["alignment"] = (["by_section", "walked", "sides"], """
SELECT pair_id, base_id, target_id, base_ord, 'section' AS how FROM by_section UNION ALL SELECT pair_id, base_id, target_id, base_ord, 'similar' FROM walked
UNION ALL SELECT pair_id, clause_id, NULL, char_start, 'removed' FROM sides WHERE side = 0 AND clause_id NOT IN (SELECT base_id FROM by_section UNION SELECT base_id FROM walked)
UNION ALL SELECT pair_id, NULL, clause_id, char_start, 'added' FROM sides WHERE side = 1 AND clause_id NOT IN (SELECT target_id FROM by_section UNION SELECT target_id FROM walked)""")


@_register("k08_align_clauses", with_ctes(["alignment"], "SELECT pair_id, base_id, target_id, how FROM alignment"))
def k08(spark, d):
    base, target, texts, _ = sides(spark, d)
    aligned = C.align_clauses(base, target, texts=texts)
    unwrite(base, target, texts)
    return aligned.select("pair_id", "base_id", "target_id", "how")


CTE["differing"] = (["alignment", "sides"], f"""
SELECT a.*, b.text AS b_text, t.text AS t_text, b.section_ref, a.base_id || '>' || a.target_id AS eid, {Q.norm_compare('b.text')} AS na, {Q.norm_compare('t.text')} AS nb
FROM alignment a JOIN sides b ON b.clause_id = a.base_id JOIN sides t ON t.clause_id = a.target_id
WHERE lower(trim(regexp_replace(b.text, '[{K.WS}]+', ' ', 'g'))) <> lower(trim(regexp_replace(t.text, '[{K.WS}]+', ' ', 'g')))""")
CTE["changed"] = (["differing"], f"""
SELECT d.*, row_number() OVER (PARTITION BY pair_id ORDER BY base_ord, base_id) AS rank, count(*) OVER (PARTITION BY pair_id) AS total FROM differing d JOIN ({Q.dice_table('differing', 'eid', 'na', 'nb')}) s USING (eid) WHERE s.score < 0.98""")


@_register("k09_changed_pairs", with_ctes(["changed"], "SELECT pair_id, rank, base_id, target_id FROM changed"))
def k09(spark, d):
    return C.changed_pairs(changeable(spark, d)[0])[0].select("pair_id", "rank", "base_id", "target_id")


@_register("k09_changed_totals", with_ctes(["changed"], "SELECT pair_id, count(*) AS changed, 'ready' AS status FROM changed GROUP BY 1"))
def k09b(spark, d):
    return C.changed_pairs(changeable(spark, d)[0])[1]


def changes(spark, d):
    """Change rows and totals: labels that a model would give are made from the contract and the rank; every fifth one quotes the new text itself."""
    pairs, p = changeable(spark, d)
    p = written(p)
    listed, totals = C.changed_pairs(pairs)
    listed = written(listed)  # labels and changes see one list, also where rows repeat and their order is a tie
    r = F.col("rank")
    labels = listed.select("pair_id", "rank", F.lit("modified").alias("change_type"), F.when(r % 2 == 0, "money").otherwise("cosmetic").alias("impact_category"),
                           (r % 2 == 0).alias("is_material"), F.when((F.split("pair_id", ">").getItem(0).cast("long") + r) % 7 == 0, "This violates the plan.").otherwise("The amount changed.").alias("business_impact"),
                           F.lit(None).cast("string").alias("before_text"), F.when(r % 5 == 0, F.substring("t_text", 1, 200)).alias("after_text"),
                           F.when(r % 3 == 0, "increased").otherwise("unchanged").alias("risk_delta"),
                           F.when(r % 4 == 0, "finance").otherwise("legal").alias("suggested_reviewer_role"), (F.lit(0.5) + (r % 5) / 10).alias("self_confidence"))
    return C.build_changes(listed, labels, pairs, p), totals


CTE["one_sided"] = (["alignment"], """
SELECT *, pair_id || '/' || how || '/' || rank AS change_id FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY CASE how WHEN 'removed' THEN 0 ELSE 1 END, base_ord, coalesce(base_id, target_id)) AS rank FROM alignment WHERE how IN ('added', 'removed'))""")
CTE["change_spans"] = (["changed", "one_sided", "sides", "pages_o"], """
SELECT change_id || '#' || side AS citation_id, s.change_id, s.side, s.char_start - p.char_start AS char_start, least(s.char_end, p.char_end) - p.char_start AS char_end, p.text AS ptext,
       coalesce(s.quote, substr(s.text, 1, greatest(0, p.char_end - s.char_start))) AS quoted_text, p.ocr_derived
FROM (SELECT c.pair_id || '/' || c.rank AS change_id, s.side_name AS side, x.dv_id, x.char_start, x.char_end, x.text, CASE WHEN s.side_name = 't' AND c.rank % 5 = 0 THEN substr(x.text, 1, 200) END AS quote
      FROM changed c CROSS JOIN (VALUES ('b'), ('t')) s(side_name) JOIN sides x ON x.clause_id = CASE s.side_name WHEN 'b' THEN c.base_id ELSE c.target_id END AND x.pair_id = c.pair_id
      WHERE (CAST(split_part(c.pair_id, '>', 1) AS BIGINT) + c.rank) % 7 <> 0
      UNION ALL SELECT o.change_id, 'x', x.dv_id, x.char_start, x.char_end, x.text, NULL FROM one_sided o JOIN sides x ON x.clause_id = coalesce(o.base_id, o.target_id) AND x.pair_id = o.pair_id) s
JOIN pages_o p ON p.dv_id = s.dv_id AND s.char_start >= p.char_start AND s.char_start < p.char_end""")
CQ._resolution("ch", "change_spans")
CTE["change_rows"] = (["ch_resolved", "changed", "one_sided", "sides"], f"""
SELECT c.pair_id || '/' || c.rank AS change_id, c.pair_id, 'modified' AS change_type, CASE WHEN c.rank % 2 = 0 THEN 'money' ELSE 'cosmetic' END AS impact_category, c.rank % 2 = 0 AS is_material, c.section_ref AS clause_ref,
  CAST(NULL AS VARCHAR) AS before_text, CASE WHEN c.rank % 5 = 0 THEN substr(c.t_text, 1, 200) END AS after_text, 'The amount changed.' AS business_impact,
  CASE WHEN c.rank % 3 = 0 THEN 'increased' ELSE 'unchanged' END AS risk_delta, CASE WHEN c.rank % 4 = 0 THEN 'finance' ELSE 'legal' END AS suggested_reviewer_role,
  c.pair_id || '/' || c.rank || '#b' AS base_citation_id, c.pair_id || '/' || c.rank || '#t' AS target_citation_id, 0.5::DOUBLE + (c.rank % 5) / 10::DOUBLE AS confidence
FROM changed c WHERE c.pair_id || '/' || c.rank IN (SELECT change_id FROM ch_resolved WHERE resolvable AND side IN ('b', 't') GROUP BY change_id HAVING count(*) = 2)
UNION ALL
SELECT o.change_id, o.pair_id, o.how, coalesce({Q.clause_type('x.section_title', 'x.text')}, 'cosmetic'), true, x.section_ref, CASE o.how WHEN 'removed' THEN x.text END, CASE o.how WHEN 'added' THEN x.text END,
  CASE o.how WHEN 'added' THEN 'A clause was added in this version.' ELSE 'A clause was removed in this version.' END, 'unchanged', 'legal',
  CASE o.how WHEN 'removed' THEN o.change_id || '#x' END, CASE o.how WHEN 'added' THEN o.change_id || '#x' END, 0.8::DOUBLE
FROM one_sided o JOIN sides x ON x.clause_id = coalesce(o.base_id, o.target_id) AND x.pair_id = o.pair_id WHERE o.change_id IN (SELECT change_id FROM ch_resolved WHERE resolvable AND side = 'x')""")


@_register("k10_changes", with_ctes(["change_rows"], "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM change_rows"))
def k10(spark, d):
    return changes(spark, d)[0].withColumn("confidence", F.round("confidence", 6))


@_register("k11_summary", with_ctes(["change_rows", "changed"], """
SELECT pair_id, coalesce(material, 0) AS material, coalesce(cosmetic, 0) AS cosmetic, coalesce(changed, 0) AS changed, 'ready' AS status
FROM (SELECT pair_id, count(*) AS changed FROM changed GROUP BY 1)
FULL OUTER JOIN (SELECT pair_id, count(*) FILTER (WHERE is_material) AS material, count(*) FILTER (WHERE NOT is_material) AS cosmetic FROM change_rows GROUP BY 1) USING (pair_id)"""))
def k11(spark, d):
    return C.summarize_comparisons(*changes(spark, d))


@_register("k11_change_list", with_ctes(["change_rows"], """
SELECT pair_id, change_id, row_number() OVER (PARTITION BY pair_id ORDER BY is_material DESC, encode(impact_category), encode(change_id)) AS place FROM change_rows"""))
def k11b(spark, d):
    return C.list_changes(changes(spark, d)[0]).select("pair_id", "change_id", "place")


@_register("k11_start_comparisons", with_ctes(["compared"], """
SELECT base_id, target_id, CASE WHEN target_id % 11 = 0 THEN NULL WHEN contract_id % 3 = 0 THEN NULL ELSE 'cmp' || contract_id END AS comparison_id,
       CASE WHEN target_id % 11 = 0 THEN 'refused' WHEN contract_id % 3 = 0 THEN 'create' WHEN contract_id % 3 = 1 AND contract_id % 4 = 0 THEN 'restart' ELSE 'reuse' END AS action,
       CASE WHEN target_id % 11 = 0 THEN NULL WHEN contract_id % 3 = 0 OR (contract_id % 3 = 1 AND contract_id % 4 = 0) THEN 'computing' ELSE CASE WHEN contract_id % 4 = 0 THEN 'partial' ELSE 'ready' END END AS status
FROM compared"""))
def k11c(spark, d):
    pairs, c = version_pairs(spark, d), F.col("contract_id")
    wanted = pairs.select("base_id", "target_id", c.alias("base_contract_id"), F.when(F.col("target_id") % 11 == 0, -1).otherwise(c).alias("target_contract_id"))
    existing = pairs.filter(c % 3 != 0).select(
        E.concat("cmp", c).alias("comparison_id"), "base_id", "target_id",
        F.when((c % 3 == 1) & (c % 4 == 0), "failed").when(c % 4 == 0, "partial").otherwise("ready").alias("status"))
    return C.start_comparisons(wanted, existing)
