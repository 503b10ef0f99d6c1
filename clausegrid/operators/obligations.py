"""Obligations: anchors, due dates from rules, recurrence, recomputation and action logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import dates as D
from clausegrid.functions import ordered

DUE_COLUMNS = ["due_date", "due_date_math", "needs_assumption", "assumption_reason"]
#: Fields that a renewal notice is computed from.
RENEWAL_FIELDS = ("dates.expiration", "renewal.notice_period_days")


def anchors(fields: DataFrame) -> DataFrame:
    """One row per version with the four anchor dates; the invoice date is never known."""
    picked = [
        F.max_by(D.json_date("value_normalized"), F.when(F.col("field_key") == key, D.written(fields))).alias(name)
        for name, key in K.ANCHOR_FIELDS.items()
    ]
    return fields.groupBy("dv_id").agg(*picked).withColumn("invoice_date", F.lit(None).cast("date"))


def pick_anchor(anchor: Column) -> Column:
    """The anchor date named by a rule, out of the columns made by `anchors`."""
    chain = None
    for name in [*K.ANCHOR_FIELDS, "invoice_date"]:
        chain = F.when(anchor == name, F.col(name)) if chain is None else chain.when(anchor == name, F.col(name))
    return chain


def with_due_date(rules: DataFrame, anchor_date: Column, recurring_from: Column | None = None) -> DataFrame:
    """Add due date, readable arithmetic and assumption state.

    Rules carry `anchor`, `anchor_value` (fixed date), `offset_days`, `calendar` and, when
    `recurring_from` is given, `recurrence`: an undated fixed rule then falls on its first
    occurrence on or after that date.
    """
    anchor, fixed = F.col("anchor"), F.col("anchor_value").cast("date")
    offset = F.coalesce(F.col("offset_days").cast("int"), F.lit(0))
    business = F.coalesce(F.col("calendar"), F.lit("calendar")) == "business"
    absolute, event = anchor == "absolute", anchor.startswith("event:")
    if recurring_from is not None:
        fixed = F.coalesce(fixed, first_occurrence(F.col("recurrence"), recurring_from))
    used = F.when(absolute, fixed).otherwise(anchor_date)
    raw = F.when(absolute, fixed).otherwise(F.date_add(anchor_date, offset))
    due = F.when(business, D.roll_business(raw)).otherwise(raw)
    event_name = F.replace(F.substr(anchor, F.lit(7)), F.lit("_"), F.lit(" "))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in K.ANCHOR_LABELS.items() for x in kv])[anchor], anchor)
    start, end = F.col("__used").cast("string"), F.col("__due").cast("string")
    math = (
        F.when(F.col("__used").isNull(), F.lit(None).cast("string"))
        .when(absolute & business, F.concat(F.lit("fixed date "), start, F.lit(" (business calendar) = "), end))
        .when(absolute, F.concat(F.lit("fixed date "), start, F.lit(" = "), end))
        .otherwise(F.concat(
            F.when(event, F.concat(F.lit('event "'), event_name, F.lit('"'))).otherwise(label),
            F.lit(" "), start, F.lit(" "), D.offset_text(offset), F.lit(" = "), end,
            F.when(business, F.lit(" (business days)")).otherwise(F.lit(""))))
    )
    reason = (
        F.when(F.col("__used").isNotNull(), F.lit(None).cast("string"))
        .when(absolute, "No fixed date supplied.")
        .when(event, F.concat(F.lit('The event "'), event_name, F.lit('" has not happened yet or is not dated in the document.')))
        .otherwise(F.concat(F.lit("The "), label, F.lit(
            " date is not known — it is not stated in the document and no value has been supplied.")))
    )
    base = rules.drop(*DUE_COLUMNS).withColumns({"__used": used, "__due": due})
    return base.withColumns({
        "due_date": F.when(F.col("__used").isNotNull(), F.col("__due")), "due_date_math": math,
        "needs_assumption": F.col("__used").isNull(), "assumption_reason": reason,
    }).drop("__used", "__due")


def due_dates(rules: DataFrame, anchor_table: DataFrame, event_date: str | None = None) -> DataFrame:
    """Due dates for rules of many versions; `event_date` names a column dating events."""
    names = [*K.ANCHOR_FIELDS, "invoice_date"]
    joined = rules.join(anchor_table.select("dv_id", *names), "dv_id", "left")
    chosen = pick_anchor(F.col("anchor"))
    if event_date:
        chosen = F.when(F.col("anchor").startswith("event:"), F.col(event_date)).otherwise(chosen)
    return with_due_date(joined.withColumn("__anchor", chosen), F.col("__anchor")).drop("__anchor", *names)


def _rule_parts(rule: Column) -> tuple[Column, Column, Column]:
    parts = F.str_to_map(rule, F.lit(";"), F.lit("="))
    return F.upper(parts["FREQ"]), parts["BYMONTHDAY"].try_cast("int"), parts["BYMONTH"].try_cast("int")


def _in_month(first_of_month: Column, day: Column) -> Column:
    return F.date_add(first_of_month, F.least(day, F.dayofmonth(F.last_day(first_of_month))) - 1)


def _monthly(start: Column, day: Column, n: Column) -> Column:
    return _in_month(F.add_months(F.trunc(start, "month"), n), day)


def _yearly(start: Column, month: Column, day: Column, n: Column) -> Column:
    return _in_month(F.make_date(F.year(start) + n, month, F.lit(1)), day)


def first_occurrence(rule: Column, start: Column) -> Column:
    freq, day, month = _rule_parts(rule)
    same_year = _yearly(start, month, day, F.lit(0))
    return (F.when(freq == "MONTHLY", _monthly(start, day, F.lit(1)))
            .when((freq == "YEARLY") & month.between(1, 12), F.when(same_year >= start, same_year).otherwise(_yearly(start, month, day, F.lit(1)))))


def expand_recurrence(df: DataFrame, rule: str, start: str, count: int) -> DataFrame:
    """One row per occurrence (n, occurrence). Monthly rules begin in the month after the
    start; yearly rules in the same year unless past. Days are clamped to the month."""
    freq, day, month = _rule_parts(F.col(rule))
    begin = F.col(start)
    # the rule is read and the first month found once a row; an explode between keeps the planner from repeating that for every occurrence
    same_year = F.make_date(F.year(begin), F.col("__m"), F.lit(1))
    skip = F.when(_in_month(same_year, F.col("__day")) >= begin, 12).otherwise(0)
    first = F.when(F.col("__freq") == "MONTHLY", F.trunc(begin, "month")).when(
        (F.col("__freq") == "YEARLY") & F.col("__m").between(1, 12), F.add_months(same_year, -skip))
    step = F.when(F.col("__freq") == "MONTHLY", 1).otherwise(12)
    once = df.withColumns({"__freq": freq, "__day": day, "__m": month}).withColumns({"__first": first, "__step": step}).drop("__freq", "__m")
    dated = once.filter("__first IS NOT NULL AND __day IS NOT NULL").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(count))))
    month_of = F.add_months("__first", F.col("__step") * F.col("n"))
    return dated.withColumn("occurrence", _in_month(month_of, F.col("__day"))).drop("__first", "__day", "__step")


def recompute(corrections: DataFrame, obligations: DataFrame, fields: DataFrame, event_date: str | None = None
              ) -> tuple[DataFrame, DataFrame]:
    """New dates for open obligations that depend on a corrected field, and one event for
    each (obligation, corrected field). The dependency list is exploded and equi-joined."""
    live = obligations.filter(F.col("status").isin("active", "suggested", "needs_assumption"))
    links = live.select("obligation_id", F.explode("derived_from").alias("field_id")).distinct()
    touched = links.join(corrections.select("field_id").distinct(), "field_id")
    targets = live.join(touched.select("obligation_id").distinct(), "obligation_id", "left_semi")
    dated = due_dates(targets, anchors(fields), event_date)
    status = F.when(F.col("needs_assumption") & (F.col("status") != "suggested"), "needs_assumption").otherwise(F.col("status"))
    updated = dated.withColumn("status", status)
    events = touched.join(updated.select("obligation_id", "due_date_math"), "obligation_id").select(
        "obligation_id", F.lit("recalculated").alias("event_type"), F.col("field_id").alias("from_correction"),
        F.col("due_date_math").alias("math"))
    return updated, events


def renewal_notice_by(fields: DataFrame) -> DataFrame:
    """Expiration minus the notice period, where both are known."""
    newest = D.written(fields)
    raw = F.max_by("value_normalized", F.when(F.col("field_key") == RENEWAL_FIELDS[1], newest))
    expiration = F.max_by(D.json_date("value_normalized"), F.when(F.col("field_key") == RENEWAL_FIELDS[0], newest))
    agg = fields.groupBy("dv_id").agg(expiration.alias("expiration_date"), raw.alias("raw"))
    is_object = F.col("raw").rlike(r"^\s*\{")
    named = F.when(is_object, F.get_json_object("raw", "$.days").try_cast("int"))
    digits = F.when(F.get_json_object("raw", "$").isNotNull(), F.regexp_replace("raw", "[^0-9]", "").try_cast("int"))
    days = F.coalesce(F.nullif(named, F.lit(0)), F.nullif(digits, F.lit(0)))
    return agg.select("dv_id", "expiration_date", days.alias("notice_days")).select(
        "*", F.date_sub("expiration_date", F.col("notice_days")).alias("renewal_notice_by"))


def promote_dates(fields: DataFrame, contracts: DataFrame) -> DataFrame:
    """ISO dates written in the effective and expiration fields of each contract's newest
    version replace the dates on the contract row; a date which that version lacks becomes null.
    The newest version has the largest `version_no`, or id where there is no such column."""
    number = F.struct(*[c for c in ("version_no", "dv_id") if c in fields.columns])
    versions = fields.groupBy("contract_id").agg(F.max_by("dv_id", number).alias("dv_id"))
    fields = fields.join(versions, ["contract_id", "dv_id"], "left_semi")
    picked = {
        name: F.max_by(D.iso_date_in("value_text"), F.when(F.col("field_key") == key, D.written(fields)))
        for name, key in [("effective_date", "dates.effective"), ("expiration_date", "dates.expiration")]
    }
    newest = fields.groupBy("contract_id").agg(*[c.alias(f"__{n}") for n, c in picked.items()])
    seen = F.col("__seen").isNotNull()
    joined = contracts.join(newest.withColumn("__seen", F.lit(True)), "contract_id", "left")
    return joined.withColumns({n: F.when(seen, F.col(f"__{n}")).otherwise(F.col(n)) for n in picked}).drop(
        "__seen", *[f"__{n}" for n in picked])


_STATUS_OF = {"accept": "active", "reject": "rejected", "snooze": "snoozed", "complete": "completed", "supply_anchor": "suggested"}


def _valid_actions(obligations: DataFrame, actions: DataFrame) -> DataFrame:
    """Join actions to their obligation; an anchor that cannot date the rule has no effect."""
    rule = obligations.select("obligation_id", "anchor", "anchor_value", F.col("status").alias("initial_status"))
    joined = actions.join(rule, "obligation_id")
    usable = F.when(F.col("anchor") == "absolute", F.col("anchor_value").isNotNull()).otherwise(F.col("anchor_date").isNotNull())
    mapped = F.create_map(*[F.lit(x) for kv in _STATUS_OF.items() for x in kv])
    return (joined.filter((F.col("action") != "supply_anchor") | usable)
            .withColumn("sets_status", mapped[F.col("action")]))


def fold_obligations(obligations: DataFrame, actions: DataFrame) -> DataFrame:
    """Current state of each obligation after its action log.

    Every attribute is the last value set, found by mergeable aggregates, so an obligation
    with a very long log is reduced before the shuffle.
    """
    log = _valid_actions(obligations, actions)
    order = F.struct("acted_at", "action_id")
    action = F.col("action")

    def last(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(when & value.isNotNull(), order))

    # what an edit can change; a log or obligations without one of these leave it out
    edited = [c for c in ("title", "description", "priority") if c in obligations.columns and c in actions.columns]
    given = action.isin("accept", "assign")
    folded = log.groupBy("obligation_id").agg(
        last(F.col("sets_status"), F.col("sets_status").isNotNull()).alias("n_status"),
        *[last(F.col(c), action == "edit").alias(f"n_{c}") for c in edited],
        last(F.col("owner_user_id"), given).alias("n_owner"),
        F.min_by("actor", F.when(action == "accept", order)).alias("first_accepter"),
        last(F.col("anchor_date"), action == "supply_anchor").alias("supplied"),
        F.count("*").alias("actions"))
    joined = obligations.join(folded, "obligation_id", "left")
    redated = with_due_date(
        joined.withColumnsRenamed({c: f"o_{c}" for c in DUE_COLUMNS}), F.col("supplied"))
    supplied = F.col("supplied").isNotNull()
    return redated.withColumns({
        "status": F.coalesce("n_status", "status"), **{c: F.coalesce(f"n_{c}", c) for c in edited},
        "owner_user_id": F.coalesce("n_owner", "owner_user_id", "first_accepter"),
        "due_date": F.when(supplied, F.col("due_date")).otherwise(F.col("o_due_date")),
        "due_date_math": F.when(supplied, F.col("due_date_math")).otherwise(F.col("o_due_date_math")),
        "actions": F.coalesce("actions", F.lit(0)),
    }).select(*[c for c in obligations.columns if c not in ("needs_assumption", "assumption_reason")], "actions")


def action_events(obligations: DataFrame, actions: DataFrame) -> DataFrame:
    """One event per action with the status before it."""
    log = _valid_actions(obligations, actions)
    ranked = ordered.last_known_before(log, ["obligation_id"], ["acted_at", "action_id"], "sets_status", "before")
    kind = F.when(F.col("action") == "supply_anchor", "anchor_supplied").when(F.col("action") == "complete", "completed").otherwise(F.col("action"))
    return ranked.select("obligation_id", "action_id", "acted_at", kind.alias("event_type"), "actor",
                         F.coalesce("before", "initial_status").alias("prior_status"))


def manual_obligations(rows: DataFrame) -> DataFrame:
    """Hand-entered obligations: a given date is the due date, otherwise an assumption is needed."""
    day = F.col("anchor_value").cast("string")
    return rows.withColumns({
        "due_date": F.col("anchor_value").cast("date"),
        "due_date_math": F.concat(F.lit("fixed date "), day, F.lit(" = "), day),
        "status": F.when(F.col("anchor_value").isNull(), "needs_assumption").otherwise("suggested"),
    })


def window_days(window: Column) -> Column:
    """'30d' → 30, 'all' → null (no end), anything without digits → 30."""
    digits = F.regexp_replace(window, "[^0-9]", "").try_cast("int")
    return F.when(window == "all", F.lit(None)).otherwise(F.coalesce(F.nullif(digits, F.lit(0)), F.lit(30)))


def obligations_due(obligations: DataFrame, contracts: DataFrame, as_of: str, window: str = "30d", limit: int | None = None) -> DataFrame:
    """Obligations due in the coming window, soonest first; all of a workspace unless `limit` is given."""
    today = D.as_date(as_of)
    until = F.date_add(today, window_days(F.lit(window)))
    due = obligations.filter((F.col("due_date") >= today) & (until.isNull() | (F.col("due_date") <= until)))
    top = ordered.top_n(due, ["workspace_id"], [F.col("due_date"), F.col("obligation_id")], limit, split=[F.col("due_date"), F.col("obligation_id")])
    return top.join(contracts.select("contract_id", F.col("title").alias("contract_title")), "contract_id")


def mark_overdue(obligations: DataFrame, as_of: str) -> DataFrame:
    late = (F.col("status") == "active") & (F.date_add("due_date", F.coalesce("grace_days", F.lit(0))) < D.as_date(as_of))
    return obligations.withColumn("status", F.when(late, "overdue").otherwise(F.col("status")))


def due_bands(obligations: DataFrame, as_of: str) -> DataFrame:
    return (obligations.withColumn("band", D.due_band("due_date", as_of))
            .groupBy("workspace_id", "band").agg(F.count("*").alias("obligations")))
