"""Risk flags, playbook rules, review queue and approval gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import dates as D
from clausegrid.functions import ordered
from clausegrid.functions import similarity as S
from clausegrid.functions import text as T
from clausegrid.operators import obligations as O
from clausegrid.operators.citations import resolve_citations


def severity_rank(col: Column | str) -> Column:
    """0 for critical up to 3 for low."""
    c = T.col(col)
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2).otherwise(3)


def _first_evidence(cands: DataFrame, quote: Column) -> DataFrame:
    """Candidates that have evidence, with its first item spread into columns."""
    e = F.element_at("evidence", 1)
    return cands.filter(F.size("evidence") > 0).select(
        *[c for c in cands.columns if c != "evidence"], e["page"].alias("page"), e["char_start"].alias("char_start"),
        e["char_end"].alias("char_end"), quote.alias("quoted_text"))


def build_flags(cands: DataFrame, pages: DataFrame, agreement: float = K.RETRIEVAL_AGREEMENT) -> DataFrame:
    """Open flags from candidates with a resolvable citation and clean wording."""
    first = F.element_at("evidence", 1)
    spread = _first_evidence(cands, F.coalesce(F.nullif("found_text", F.lit("")), first["quoted_text"]))
    worded = spread.filter(T.lint_clean(F.concat_ws(" ", "title", "explanation", "recommended_step")))
    cited = resolve_citations(worded, pages).filter("resolvable")
    return cited.withColumns({
        "confidence": S.blend_confidence("self_confidence", agreement, "match_confidence", "ocr_derived"), "status": F.lit("open"),
    }).drop("self_confidence")


def derive_obligations(cands: DataFrame, anchor_table: DataFrame, pages: DataFrame, event_date: str | None = None,
                       agreement: float = K.RETRIEVAL_AGREEMENT) -> DataFrame:
    """Obligations from candidates whose evidence resolves: due date by rule, state, risk note."""
    spread = _first_evidence(cands, F.element_at("evidence", 1)["quoted_text"])
    cited = resolve_citations(spread, pages).filter("resolvable")
    dated = O.due_dates(cited, anchor_table, event_date)
    unknown = ~F.col("anchor_known") | F.col("needs_assumption")
    clean = T.lint_clean(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))
    return dated.withColumns({
        "due_date": F.when(~unknown, F.col("due_date")),
        "status": F.when(unknown, "needs_assumption").otherwise("suggested"),
        "risk_note": F.when(~clean, "Review required: output triggered the safety lint."),
        "confidence": S.blend_confidence("self_confidence", agreement, "match_confidence", "ocr_derived"),
    }).drop("self_confidence", "needs_assumption", "assumption_reason")


def evaluate_playbook(versions: DataFrame, fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome of every active rule for every version of its workspace.

    `rules`: rule_id, workspace_id, evaluator (JSON type/field/op/value), outcome, severity,
    reviewer_role, active. A missing field violates a presence rule and leaves a threshold
    rule not evaluated.
    """
    spec = rules.filter("active").withColumn("e", F.from_json("evaluator", "type string, field string, op string, value string")).select(
        "rule_id", "workspace_id", F.col("e.type").alias("kind"), F.col("e.field").alias("field_key"), F.col("e.op").alias("op"),
        F.col("e.value").alias("wanted"), "outcome", "severity", "reviewer_role")
    known = fields.filter(F.col("value_text").isNotNull() & (F.col("validation_status") != "not_found"))
    value = F.coalesce(F.get_json_object("value_normalized", "$.value"), F.get_json_object("value_normalized", "$.days"))
    known = known.groupBy("dv_id", "field_key").agg(F.max_by(value, D.written(known)).alias("value"), F.lit(True).alias("present"))
    rows = versions.select("dv_id", "workspace_id").join(spec, "workspace_id").join(known, ["dv_id", "field_key"], "left")
    present = F.coalesce("present", F.lit(False))
    a, b = F.col("value").try_cast("double"), F.col("wanted").try_cast("double")
    op = F.col("op")
    holds = (F.when(op == ">=", a >= b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == "<", a < b)
             .when(op == "==", F.coalesce(a == b, F.col("value") == F.col("wanted")))
             .when(op == "!=", ~F.coalesce(a == b, F.col("value") == F.col("wanted"))))
    result = (F.when((F.col("kind") == "presence") & (present == (F.col("wanted") == "true")), "ok").when(F.col("kind") == "presence", "violated")
              .when(holds.isNull(), "not_evaluated").when(holds, "ok").otherwise("violated"))
    return rows.select("dv_id", "workspace_id", "rule_id", "field_key", result.alias("result"),
                       F.when(result == "violated", F.col("outcome")).alias("outcome"), "severity", "reviewer_role")


def risk_queue(flags: DataFrame, contracts: DataFrame, status: str = "open", severity: str | None = None, limit: int | None = None) -> DataFrame:
    """Flags to review, worst first then newest; all of a workspace unless `limit` is given."""
    rows = flags if status == "all" else flags.filter(F.col("status") == status)
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    top = ordered.top_n(rows, ["workspace_id"], [severity_rank("severity"), F.col("created_at").desc(), F.col("flag_id")], limit,
                        split=[severity_rank("severity"), ordered.down("created_at"), F.col("flag_id")])
    return top.join(contracts.select("contract_id", F.col("title").alias("contract_title")), "contract_id")


def risk_counts(flags: DataFrame, status: str = "open") -> DataFrame:
    return flags.filter(F.col("status") == status).groupBy("workspace_id", "severity").agg(F.count("*").alias("flags"))


def open_flags(flags: DataFrame) -> DataFrame:
    """Open flags per contract with the worst severity; `text_max` is the alphabetical maximum."""
    return flags.filter("status = 'open'").groupBy("workspace_id", "contract_id").agg(
        F.count("*").alias("flags"), F.min_by("severity", severity_rank("severity")).alias("worst"), F.max("severity").alias("text_max"))


def latest_decision(decisions: DataFrame, users: DataFrame) -> DataFrame:
    last = ordered.latest(decisions, ["flag_id"], ["created_at", "decision_id"])
    return last.join(users.select(F.col("user_id").alias("decided_by"), F.col("display_name").alias("decider")), "decided_by", "left")


def decision_history(decisions: DataFrame) -> DataFrame:
    """Every decision with its place counted from the newest (blocked, safe for long histories)."""
    up = ordered.numbered(decisions, ["flag_id"], ["created_at", "decision_id"], "n")
    total = decisions.groupBy("flag_id").agg(F.count("*").alias("total"))
    return up.join(total, "flag_id").withColumn("newest", F.col("total") - F.col("n") + 1).drop("n")


def fold_flags(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status after the latest decision: reopened flags are open, others decided."""
    last = ordered.latest(decisions.select("flag_id", "decision_id", "decision", "created_at"), ["flag_id"], ["created_at", "decision_id"])
    joined = flags.join(last.select("flag_id", F.col("decision").alias("last_decision")), "flag_id", "left")
    return joined.withColumn("status", F.when(F.col("last_decision").isNull(), F.col("status"))
                             .when(F.col("last_decision") == "reopened", "open").otherwise("decided"))


def approval_gate(contracts: DataFrame, flags: DataFrame, obligations: DataFrame) -> DataFrame:
    """Contracts blocked by open critical/high flags or obligations that need an assumption."""
    f = flags.filter(F.col("status").isin("open") & F.col("severity").isin("critical", "high")).groupBy("contract_id").agg(F.count("*").alias("open_flags"))
    o = obligations.filter("status = 'needs_assumption'").groupBy("contract_id").agg(F.count("*").alias("open_assumptions"))
    return (contracts.select("contract_id", "workspace_id").join(f, "contract_id", "left").join(o, "contract_id", "left")
            .withColumns({"open_flags": F.coalesce("open_flags", F.lit(0)), "open_assumptions": F.coalesce("open_assumptions", F.lit(0))})
            .withColumn("gate", F.when((F.col("open_flags") > 0) | (F.col("open_assumptions") > 0), "blocked").otherwise("unblocked")))
