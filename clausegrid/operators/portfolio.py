"""Portfolio, usage and governance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import dates as D
from clausegrid.functions import ordered
from clausegrid.functions import text as T


def _text(c: Column | str) -> Column:
    c = T.col(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def money(minor: Column | str, currency: Column | str) -> Column:
    """Minor units as 'CUR 1,234.5'; empty when unknown."""
    value = F.call_function("format_number", T.col(minor).cast("decimal(18,2)") / 100, F.lit("#,##0.###"))
    return F.coalesce(F.concat_ws(" ", F.coalesce(T.col(currency), F.lit("USD")), F.nullif(value, F.lit(""))), F.lit(""))


# ------------------------------------------------------------------ report tabs and export

def contract_tab(contracts: DataFrame, flags: DataFrame, users: DataFrame, link: str = "/w/contracts") -> DataFrame:
    open_flags = flags.filter("status = 'open'").groupBy("contract_id").agg(F.count("*").alias("n"))
    owners = users.select(F.col("user_id").alias("owner_user_id"), "display_name")
    rows = contracts.filter("deleted_at IS NULL").join(owners, "owner_user_id", "left").join(open_flags, "contract_id", "left")
    value = F.when(F.col("value_minor").isNotNull(), money("value_minor", "currency")).otherwise("")
    cols = [_text("title"), _text("counterparty"), _text("contract_type"), _text("status"), _text("display_name"), value,
            _text("effective_date"), _text("expiration_date"), _text("renewal_notice_by"), F.coalesce("n", F.lit(0)),
            F.date_format("updated_at", "yyyy-MM-dd HH:mm"), F.lit(link), _text("contract_id")]
    return rows.select("workspace_id", *[c.alias(n) for c, n in zip(cols, K.REPORT_TABS["contracts"])])


def _quote() -> Column:
    return F.when(F.coalesce("quoted_text", F.lit("")) != "", F.concat(
        F.col("quoted_text"), F.lit(" (p."), F.col("page").cast("string"), F.lit(")"))).otherwise("")


def obligation_tab(obligations: DataFrame, contracts: DataFrame, users: DataFrame, citations: DataFrame, link: str = "/w/contracts") -> DataFrame:
    rows = (obligations.filter("status <> 'void'").join(contracts.select("contract_id", F.col("title").alias("c_title")), "contract_id")
            .join(users.select(F.col("user_id").alias("owner_user_id"), "display_name"), "owner_user_id", "left")
            .join(citations.select("citation_id", "quoted_text", "page"), "citation_id", "left"))
    cols = [_text("title"), _text("c_title"), _text("obligor"), _text("obligee"), _text("due_date"), _text("due_date_math"), _text("priority"),
            _text("status"), _text("display_name"), _quote(), F.lit(link), _text("obligation_id")]
    return rows.select("workspace_id", *[c.alias(n) for c, n in zip(cols, K.REPORT_TABS["obligations"])])


def risk_tab(flags: DataFrame, contracts: DataFrame | None, decided: DataFrame, citations: DataFrame | None, link: str = "/w/risk") -> DataFrame:
    """`decided`: latest decision per flag with its decider. No `contracts` if the flags carry their contract's title as c_title, no `citations` if
    they carry quoted_text and page: flags that are looked up in fewer, larger units move once only, to their decisions."""
    rows = flags if contracts is None else flags.join(contracts.select("contract_id", F.col("title").alias("c_title")), "contract_id")
    if citations is not None:
        rows = rows.join(citations.select("citation_id", "quoted_text", "page"), "citation_id", "left")
    rows = rows.join(decided.select("flag_id", "decision", "decider"), "flag_id", "left")
    confidence = F.when(F.col("confidence").isNotNull(), F.format_string("%.2f", "confidence")).otherwise("")
    cols = [_text("c_title"), _text("title"), _text("category"), _text("severity"), confidence, _text("status"), _text("decision"),
            _text("decider"), _quote(), F.lit(link), _text("flag_id")]
    return rows.select("workspace_id", *[c.alias(n) for c, n in zip(cols, K.REPORT_TABS["risk_flags"])])


def portfolio_tabs(contracts: DataFrame, obligations: DataFrame, flags: DataFrame, decided: DataFrame, users: DataFrame, citations: DataFrame) -> dict[str, DataFrame]:
    """The three report tabs, of one workspace or of all (filter on workspace_id)."""
    return {"contracts": contract_tab(contracts, flags, users), "obligations": obligation_tab(obligations, contracts, users, citations),
            "risk_flags": risk_tab(flags, contracts, decided, citations)}


def export_sections(contracts: DataFrame, fields: DataFrame, obligations: DataFrame, flags: DataFrame, contract_id: int | str | None = None,
                    newest: int | None = None) -> dict[str, DataFrame]:
    """Factual fields of current versions, the newest obligations, and the newest flags minus superseded ones.

    The newest rows are chosen per workspace before the contract filter and the status filter; all of them without `newest`.
    `fields` carry label and primary_citation_id, `obligations` description and rule (as extracted).
    """
    named = contracts.select("contract_id", F.col("title").alias("contract"))
    facts = fields.filter("extraction_kind = 'factual'").join(
        contracts.select(F.col("current_version_id").alias("dv_id"), F.col("title").alias("contract")), "dv_id")
    if contract_id is not None:
        facts = facts.filter(F.col("contract_id") == contract_id)

    def recent(df: DataFrame, key: str) -> DataFrame:
        top = ordered.top_n(df, ["workspace_id"], [F.col("created_at").desc(), F.col(key)], newest, split=[ordered.down("created_at"), F.col(key)])
        top = top if contract_id is None else top.filter(F.col("contract_id") == contract_id)
        return top.join(named, "contract_id", "left").withColumn("contract", F.coalesce("contract", F.col("contract_id").cast("string")))

    obs = recent(obligations, "obligation_id").select(
        "workspace_id", "rank", "obligation_id", "contract", "title", _text("description").alias("description"), _text("rule").alias("rule"), _text("due_date").alias("due_date"), _text("due_date_math").alias("due_date_math"), "priority", "status",
        F.when(F.col("status") == "needs_assumption", "yes").otherwise("no").alias("needs_assumption"))
    risks = recent(flags, "flag_id").filter("status <> 'superseded'").select(
        "workspace_id", "rank", "flag_id", "contract", "title", "severity", _text("category").alias("category"), "confidence", "status", _text("recommended_step").alias("recommended_step"))
    return {"fields": facts.select("workspace_id", "contract", "field_id", "field_key", "label", "field_group", _text("value_text").alias("value"), "confidence", "validation_status",
                                   _text("primary_citation_id").alias("citation"), F.lit(K.DISCLAIMER).alias("disclaimer")),
            "obligations": obs, "risk_flags": risks}


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per section; values with quotes, commas or newlines are quoted."""
    for name, df in sections.items():
        df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{name}")


# ------------------------------------------------------------------ dashboards and lists

def dashboard(contracts: DataFrame, obligations: DataFrame, flags: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    """Counters per workspace: one aggregate per table, joined on the workspace."""
    today = D.as_date(as_of)
    live = F.col("deleted_at").isNull()
    soon = F.col("renewal_notice_by").between(today, F.date_add(today, 90))
    c = contracts.groupBy("workspace_id").agg(
        F.count_if(live & (F.col("status") == "in_review")).alias("in_review"), F.count_if(live & soon).alias("renewals_90"), F.count_if(live).alias("contracts"))
    o = obligations.groupBy("workspace_id").agg(F.count_if(F.col("status") == "overdue").alias("overdue"))
    f = flags.groupBy("workspace_id").agg(F.count_if((F.col("status") == "open") & F.col("severity").isin("critical", "high")).alias("high_risk_open"))
    v = versions.groupBy("workspace_id").agg(F.count_if(F.col("status") == "failed").alias("failed_documents"))
    out = c.join(o, "workspace_id", "full_outer").join(f, "workspace_id", "full_outer").join(v, "workspace_id", "full_outer")
    names = ["in_review", "renewals_90", "contracts", "overdue", "high_risk_open", "failed_documents"]
    return out.select("workspace_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def recent_activity(audit: DataFrame, users: DataFrame, n: int | None = None) -> DataFrame:
    top = ordered.top_n(audit, ["workspace_id"], [F.col("created_at").desc(), F.col("audit_id").desc()], n, split=[ordered.down("created_at"), -F.col("audit_id")])
    return top.join(users.select(F.col("user_id").alias("actor_user_id"), "email"), "actor_user_id", "left").withColumn("actor", F.coalesce("email", F.lit("system"))).drop("email")


def search_contracts(contracts: DataFrame, status: str | None = None, contract_type: str | None = None, text: str | None = None,
                     expiring_before: str | None = None, limit: int | None = None) -> DataFrame:
    """Live contracts matching all given conditions, latest change first; all of a workspace unless `limit` is given."""
    rows = contracts.filter("deleted_at IS NULL")
    if status:
        rows = rows.filter(F.col("status") == status)
    if contract_type:
        rows = rows.filter(F.col("contract_type") == contract_type)
    if expiring_before:
        rows = rows.filter(F.col("expiration_date") <= D.as_date(expiring_before))
    if text:
        words = T.tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("counterparty", F.lit(""))))
        rows = rows.filter(F.size(F.array_except(T.tokens(F.lit(text)), words)) == 0)
    return ordered.top_n(rows, ["workspace_id"], [F.col("updated_at").desc(), F.col("contract_id")], limit, split=[ordered.down("updated_at"), F.col("contract_id")])


def document_activity(versions: DataFrame, stages: DataFrame, calls: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Newest versions per workspace with call, token and latency sums, and their stage runs in
    order. Stage runs stay rows, so a version with very many runs needs no single large value."""
    top = ordered.top_n(versions, ["workspace_id"], [F.col("uploaded_at").desc(), F.col("dv_id")], n, split=[ordered.down("uploaded_at"), F.col("dv_id")])
    sums = calls.groupBy("dv_id").agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
        F.sum(F.coalesce("latency_ms", F.lit(0))).alias("latency_ms"))
    docs = top.join(sums, "dv_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ["calls", "tokens", "latency_ms"]})
    runs = stages.join(top.select("dv_id"), "dv_id", "left_semi")
    return docs, ordered.numbered(runs, ["dv_id"], ["happened_at", "seq"], "position")


def usage_ledger(calls: DataFrame, by: list[str], rollup: bool = False) -> DataFrame:
    """Calls, tokens, latency, cost and outcomes per agent, model, prompt, day or any of them."""
    rows = calls.withColumn("day", F.to_date("created_at").cast("string"))
    grouped = rows.rollup(*by) if rollup else rows.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"), F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.count_if(F.col("validation_outcome") != "passed").alias("not_passed"))


def audit_query(audit: DataFrame, users: DataFrame, readers: DataFrame, action_prefix: str | None = None, resource_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest audit events per workspace for readers whose role allows it.

    `readers`: workspace_id, user_id, role. Only workspaces with an allowed reader appear.
    """
    allowed = readers.filter(F.col("role").isin(*K.REVIEW_ROLES)).select("workspace_id").distinct()
    rows = audit.join(allowed, "workspace_id", "left_semi")
    if action_prefix:
        rows = rows.filter(F.col("action").startswith(action_prefix))
    if resource_type:
        rows = rows.filter(F.col("resource_type") == resource_type)
    return recent_activity(rows, users, limit)


def brief(contracts: DataFrame, fields: DataFrame, citations: DataFrame, flags: DataFrame, obligations: DataFrame,
          briefs: DataFrame | None = None, risks: int | None = None) -> dict[str, DataFrame]:
    """Contract brief: facts of the current version with citations, risks from the newest on, counts, the fields whose candidates
    conflict, and the stored interpretation and open questions.

    `fields`: dv_id, field_id, field_key, field_group, value_text, validation_status,
    extraction_kind, primary_citation_id, alt_citation_ids. `citations`: citation_id, page, quoted_text.
    `briefs`: dv_id, interpretation, open_questions (see `sources.io.parse_briefs`).
    """
    current = contracts.select("contract_id", F.col("current_version_id").alias("dv_id"))
    facts = fields.drop("contract_id").filter("extraction_kind = 'factual'").join(current, "dv_id")
    cite = citations.select("citation_id", "page", F.col("quoted_text").alias("quote"))
    wanted = facts.select("field_id", F.col("primary_citation_id").alias("citation_id"), F.lit(0).alias("pos"))
    alts = facts.select("field_id", F.posexplode("alt_citation_ids").alias("p", "citation_id")).select("field_id", "citation_id", (F.col("p") + 1).alias("pos"))
    # a field carries its own short citation list, so gathering it back is bounded by that list
    cited = ordered.stack(wanted, alts).join(cite, "citation_id").groupBy("field_id").agg(
        F.max(F.when(F.col("pos") == 0, F.struct("citation_id", "page", "quote"))).alias("citation"),
        F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "citation_id")))).alias("alts"))
    rows = facts.join(cited, "field_id", "left").select(
        "contract_id", "field_id", "field_key", "field_group", "value_text", "validation_status", "citation", F.transform("alts", lambda a: a["citation_id"]).alias("alt_citations"))
    top = ordered.top_n(flags, ["contract_id"], [F.col("created_at").desc(), F.col("flag_id")], risks,
                        split=[ordered.down("created_at"), F.col("flag_id")]).filter("status <> 'superseded'")
    counted = obligations.groupBy("contract_id").agg(F.count("*").alias("obligations_count"))
    conflicting = F.col("validation_status") == "conflicting"
    states = facts.groupBy("contract_id").agg(
        F.count_if(F.col("validation_status") == "not_found").alias("not_found"), F.count_if(conflicting).alias("conflicts"))
    head = contracts.select("contract_id", "title", "status").join(counted, "contract_id", "left").join(states, "contract_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ["obligations_count", "not_found", "conflicts"]})
    out = {"contracts": head, "facts": rows, "risks": top, "conflicting": facts.filter(conflicting).select("contract_id", "field_group", "field_key", "field_id")}
    if briefs is not None:
        stored = current.join(briefs.select("dv_id", "interpretation", "open_questions"), "dv_id")
        out["interpretation"] = stored.select("contract_id", F.posexplode("interpretation").alias("pos", "i")).select(
            "contract_id", "pos", "i.text", "i.field_ids", F.lit("interpretation").alias("extraction_kind"), F.col("i.self_confidence").alias("confidence"))
        out["open_questions"] = stored.select("contract_id", F.posexplode("open_questions").alias("pos", "q")).select("contract_id", "pos", "q.question", "q.field_ids")
    return out


def fields_by_group(fields: DataFrame) -> DataFrame:
    return fields.groupBy("dv_id", "field_group").agg(
        F.count("*").alias("fields"), F.count_if(F.col("validation_status") == "not_found").alias("not_found"),
        F.count_if(F.col("validation_status").isin("needs_confirmation", "conflicting")).alias("to_review"))


# ------------------------------------------------------------------ versions, duplicates, stages

def assign_versions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Version numbers for uploads: after the highest number of the contract, in upload order."""
    top = existing.groupBy("contract_id").agg(F.max("version_number").alias("top"))
    seq = ordered.numbered(new, ["contract_id"], ["uploaded_at", "dv_id"], "n")
    number = F.coalesce("top", F.lit(0)) + F.col("n")
    return seq.join(top, "contract_id", "left").withColumn("version_number", number).withColumn(
        "version_label", F.concat(F.lit("v"), F.col("version_number").cast("string"))).drop("n", "top")


def current_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("contract_id").agg(F.max_by("dv_id", "version_number").alias("current_version_id"), F.max("version_number").alias("versions"))


def duplicate_content(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads whose content the workspace already holds under another contract, with the first
    such version. Existing rows are reduced to the two lowest contracts per content before the
    join, so a content with very many copies joins at most two rows."""
    holder = existing.groupBy("workspace_id", "sha256", "contract_id").agg(F.min("dv_id").alias("held_dv"))
    first = holder.groupBy("workspace_id", "sha256").agg(F.min(F.struct("held_dv", "contract_id")).alias("a"))
    again = holder.join(first, ["workspace_id", "sha256"]).filter(F.col("contract_id") != F.col("a.contract_id")).groupBy("workspace_id", "sha256").agg(
        F.min(F.struct("held_dv", "contract_id")).alias("b"))
    both = first.join(again, ["workspace_id", "sha256"], "left")
    hit = new.join(both, ["workspace_id", "sha256"])
    pick = F.when(F.col("a.contract_id") != F.col("contract_id"), F.col("a")).otherwise(F.col("b"))
    return hit.withColumn("x", pick).filter("x IS NOT NULL").select(
        "dv_id", "contract_id", "workspace_id", F.col("x.held_dv").alias("existing_dv_id"), F.col("x.contract_id").alias("existing_contract_id"))


def stage_state(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs per (version, stage, attempt) with status, start and finish; and per (version,
    stage) the attempt a retry would get. `events`: dv_id, stage, attempt, status, happened_at, seq."""
    order = F.struct("happened_at", "seq")
    running = F.col("status") == "running"
    runs = events.groupBy("dv_id", "stage", "attempt").agg(
        F.max_by("status", order).alias("status"), F.max(F.when(running, F.col("happened_at"))).alias("started_at"),
        F.max_by("happened_at", order).alias("last_at"))
    runs = runs.withColumn("finished_at", F.when(~F.col("status").isin("running", "pending"), F.col("last_at"))).drop("last_at")
    retries = runs.groupBy("dv_id", "stage").agg((F.max("attempt") + 1).alias("next_attempt"))
    return runs, retries


def version_status(updates: DataFrame) -> DataFrame:
    """Status of each version after its updates: unknown names are ignored and a version that
    was ready once stays ready unless an explicit retry failed it afterwards."""
    order = F.struct("happened_at", "seq")
    valid = updates.filter(F.col("status").isin(*K.VERSION_STATUS))
    forced = F.coalesce("forced", F.lit(False))
    agg = valid.groupBy("dv_id").agg(
        F.max(F.when(forced, F.struct(F.col("happened_at").alias("t"), F.col("seq").alias("s"), F.col("status").alias("status")))).alias("f"))
    later = valid.filter(~forced).join(agg, "dv_id").filter(
        F.col("f").isNull() | (order > F.struct(F.col("f.t"), F.col("f.s"))))
    tail = later.groupBy("dv_id").agg(F.bool_or(F.col("status") == "ready").alias("was_ready"), F.max_by("status", order).alias("last"))
    return agg.join(tail, "dv_id", "left").select("dv_id", F.when(F.col("was_ready"), "ready").otherwise(F.coalesce("last", "f.status")).alias("status"))


# ------------------------------------------------------------------ members, roles, isolation, constraints

def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    return memberships.join(users, "user_id").select("workspace_id", "user_id", "email", "display_name", "role")


def sole_admins(memberships: DataFrame) -> DataFrame:
    """Workspaces with one admin, who may not be demoted or removed."""
    admins = memberships.filter(F.col("role") == K.ADMIN_ROLE)
    return admins.groupBy("workspace_id").agg(F.count("*").alias("admins"), F.min("user_id").alias("user_id")).filter("admins = 1").drop("admins")


def role_rank(role: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in K.ROLES]), T.col(role)) - 1


def authorize(actions: DataFrame, memberships: DataFrame) -> DataFrame:
    """Allowed, forbidden, or not_found where the user is no member of the workspace."""
    need = F.create_map(*[F.lit(x) for kv in K.ACTIONS.items() for x in kv])[F.col("action")]
    joined = actions.join(memberships.select("workspace_id", "user_id", "role"), ["workspace_id", "user_id"], "left")
    edit = role_rank("role") >= K.ROLES.index(K.EDIT_MIN_ROLE)
    ok = (F.when(need == "edit", edit).when(need == "review", F.col("role").isin(*K.REVIEW_ROLES)).when(need == "admin", F.col("role") == K.ADMIN_ROLE).otherwise(F.lit(False)))
    return joined.withColumn("decision", F.when(F.col("role").isNull(), "not_found").when(ok, "allowed").otherwise("forbidden"))


def scope(df: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows of granted workspaces only; others are invisible."""
    return df.join(grants.select("workspace_id").distinct(), "workspace_id", "left_semi")


def check_rows(df: DataFrame, table: str, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per violated row-level constraint; a null check passes, as in SQL."""
    broken = F.array_compact(F.array(*[F.when(~cond, F.lit(name)) for name, cond in checks.items()]))
    return df.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("violation"))


def check_unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    name = "unique(" + ",".join(keys) + ")"
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit(table).alias("table"), F.concat_ws("|", *keys).alias("row_key"), F.lit(name).alias("violation"))


def check_parent(df: DataFrame, table: str, key: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    ids = parent.select(F.col(parent_key).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(ids, column, "left_anti").select(
        F.lit(table).alias("table"), F.col(key).cast("string").alias("row_key"), F.lit(f"orphan {column}").alias("violation"))


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations in the given entities (those that are present)."""
    def among(c: str, values: list[str]) -> Column:
        return F.col(c).isin(*values)

    unit = F.col("confidence").isNull() | F.col("confidence").between(0, 1)
    found = []
    if "contracts" in tables:
        found.append(check_rows(tables["contracts"], "contracts", "contract_id", {"status": among("status", K.CONTRACT_STATUS)}))
    if "obligations" in tables:
        o = tables["obligations"]
        found.append(check_rows(o, "obligations", "obligation_id", {
            "status": among("status", K.OBLIGATION_STATUS), "priority": among("priority", K.SEVERITIES),
            "due date or assumption": F.col("due_date").isNotNull() | among("status", K.UNDATED_STATUS)}))
        if "contracts" in tables:
            found.append(check_parent(o, "obligations", "obligation_id", "contract_id", tables["contracts"], "contract_id"))
    if "risk_flags" in tables:
        found.append(check_rows(tables["risk_flags"], "risk_flags", "flag_id", {
            "status": among("status", K.FLAG_STATUS), "severity": among("severity", K.SEVERITIES), "confidence": unit}))
    if "risk_decisions" in tables:
        found.append(check_rows(tables["risk_decisions"], "risk_decisions", "decision_id", {"decision": among("decision", K.DECISIONS)}))
        if "risk_flags" in tables:
            found.append(check_parent(tables["risk_decisions"], "risk_decisions", "decision_id", "flag_id", tables["risk_flags"], "flag_id"))
    if "citations" in tables:
        found.append(check_rows(tables["citations"], "citations", "citation_id", {"span": F.col("char_end") > F.col("char_start")}))
    if "fields" in tables:
        f = tables["fields"]
        found.append(check_rows(f, "fields", "field_id", {"status": among("validation_status", K.FIELD_STATUS), "kind": among("extraction_kind", K.KINDS), "confidence": unit}))
        found.append(check_unique(f, "fields", ["dv_id", "field_key"]))
    if "stages" in tables:
        found.append(check_unique(tables["stages"], "stages", ["dv_id", "stage", "attempt"]))
    return ordered.stack(*found)
