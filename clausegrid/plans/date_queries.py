"""Registered queries: dates, obligations and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import dates as D
from clausegrid.operators import alerts as A
from clausegrid.operators import obligations as O
from clausegrid.plans import entities as E
from clausegrid.plans.entities import AS_OF, AS_OF_TS, CTE, with_ctes

QUERIES: dict = {}
SCHEDULED_AT = "1999-06-15 12:00:00"


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ derived tables

def obligations(spark: SparkSession, d: str) -> DataFrame:
    return O.with_due_date(E.obligation_rules(spark, d), F.col("anchor_date"))


def schedulable(spark: SparkSession, d: str) -> DataFrame:
    zone = E.workspaces(spark, d).select("workspace_id", "timezone")
    channel = F.when(F.col("obligation_id") % 2 == 0, "in_app").otherwise("email")
    return obligations(spark, d).filter("status = 'active'").withColumn("channel", channel).join(zone, "workspace_id")


def schedules(spark: SparkSession, d: str) -> DataFrame:
    return A.alert_schedule(schedulable(spark, d), SCHEDULED_AT)


def deliveries(sched: DataFrame) -> DataFrame:
    """Schedules of every fifth obligation 90 days ahead have been delivered."""
    hit = (F.col("obligation_id") % 5 == 0) & (F.col("offset_days") == 90)
    return sched.filter(hit).select(
        "schedule_id", F.col("schedule_id").alias("idempotency_key"), F.col("scheduled_for").alias("delivered_at"))


CTE["schedules"] = (["obligations", "workspaces"], f"""
SELECT obligation_id || ':' || offset_days || ':' || channel AS schedule_id, workspace_id, obligation_id, offset_days, channel, owner_user_id AS recipient_user_id,
       ((CAST(CAST((fires AT TIME ZONE 'UTC') AT TIME ZONE timezone AS DATE) AS TIMESTAMP) + INTERVAL 9 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS scheduled_for, 'scheduled' AS status
FROM (SELECT *, CAST(due_date AS TIMESTAMP) + INTERVAL 9 HOUR - to_days(offset_days) AS fires FROM (
        SELECT o.obligation_id, o.workspace_id, o.due_date, o.owner_user_id, w.timezone, unnest([90, 30, 14, 7, 1]) AS offset_days,
               CASE WHEN o.obligation_id % 2 = 0 THEN 'in_app' ELSE 'email' END AS channel
        FROM obligations o JOIN workspaces w ON w.workspace_id = o.workspace_id WHERE o.status = 'active' AND o.due_date IS NOT NULL))
WHERE fires > TIMESTAMP '{SCHEDULED_AT}'""")
CTE["deliveries"] = (["schedules"], "SELECT schedule_id, schedule_id AS idempotency_key, scheduled_for AS delivered_at FROM schedules WHERE obligation_id % 5 = 0 AND offset_days = 90")


def _day(c: str):
    return F.col(c).cast("string").alias(c)


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _tsq(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


# ------------------------------------------------------------------ queries

_ANCHORS_SQL = """
SELECT dv_id, max(CASE WHEN field_key = 'dates.expiration' THEN json_extract_string(value_normalized, '$.date') END) AS expiration_date,
       max(CASE WHEN field_key = 'dates.signature' THEN json_extract_string(value_normalized, '$') END) AS signature_date,
       max(CASE WHEN field_key = 'dates.effective' THEN json_extract_string(value_normalized, '$.date') END) AS effective_date,
       max(CASE WHEN field_key = 'dates.commencement' THEN json_extract_string(value_normalized, '$.date') END) AS commencement_date,
       CAST(NULL AS VARCHAR) AS invoice_date
FROM extracted_fields GROUP BY dv_id"""
CTE["anchors"] = (["extracted_fields"], _ANCHORS_SQL)


@_register("d01_anchors", with_ctes(["anchors"], "SELECT * FROM anchors"))
def d01(spark, d):
    a = O.anchors(E.extracted_fields(spark, d, keys=K.ANCHOR_FIELDS.values()))
    return a.select("dv_id", *[_day(c) for c in a.columns[1:]])


@_register("d02_due_dates", with_ctes(["obligations"], "SELECT obligation_id, CAST(due_date AS VARCHAR) AS due_date, due_date_math, needs_assumption, assumption_reason FROM obligations"))
def d02(spark, d):
    return obligations(spark, d).select("obligation_id", _day("due_date"), "due_date_math", "needs_assumption", "assumption_reason")


_NEXT_MONTH = "make_date(2000, 7, CAST(obligation_id % 31 + 1 AS BIGINT))"  # the month after AS_OF has 31 days


@_register("d02_recurring_due_dates", with_ctes(["obligations"], f"""
SELECT obligation_id, CAST(CASE WHEN anchor = 'absolute' AND anchor_value IS NULL THEN {_NEXT_MONTH} + CASE WHEN calendar = 'business' THEN CASE isodow({_NEXT_MONTH}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END ELSE 0 END ELSE due_date END AS VARCHAR) AS due_date,
       needs_assumption AND anchor <> 'absolute' AS needs_assumption FROM obligations"""))
def d02b(spark, d):
    """Rules without a fixed date fall on the first occurrence of their recurrence."""
    out = O.with_due_date(E.obligation_rules(spark, d), F.col("anchor_date"), recurring_from=F.lit(AS_OF).cast("date"))
    return out.select("obligation_id", _day("due_date"), "needs_assumption")


@_register("d03_business_days", """
SELECT CAST(rolled AS VARCHAR) AS rolled, count(*) AS orders, count(*) FILTER (WHERE rolled <> day) AS moved
FROM (SELECT day, day + CASE isodow(day) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS rolled FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)) GROUP BY rolled""")
def d03(spark, d):
    day = F.col("o_orderdate").cast("date")
    return (E.table(spark, d, "orders").select(day.alias("day"), D.roll_business(day).alias("rolled"))
            .groupBy("rolled").agg(F.count("*").alias("orders"), F.count_if(F.col("rolled") != F.col("day")).alias("moved"))
            .withColumn("rolled", F.col("rolled").cast("string")))


@_register("d04_recurrence", """
WITH r AS (SELECT o_orderkey AS obligation_id, CAST(o_orderdate AS DATE) AS start, o_orderkey % 31 + 1 AS day, o_orderkey % 12 + 1 AS month, o_orderkey % 2 = 0 AS monthly, unnest([1, 2, 3, 4, 5]) AS n FROM orders),
m AS (SELECT *, CASE WHEN monthly THEN date_trunc('month', start) + to_months(CAST(n AS INTEGER)) ELSE make_date(year(start) + n - 1, month, 1) END AS first_day,
             make_date(year(start), month, 1) AS this_year FROM r),
y AS (SELECT *, CASE WHEN NOT monthly AND this_year + CAST(least(day, day(last_day(this_year))) - 1 AS INTEGER) < start THEN first_day + INTERVAL 1 YEAR ELSE first_day END AS base FROM m)
SELECT obligation_id, n, CAST(CAST(base AS DATE) + CAST(least(day, day(last_day(CAST(base AS DATE)))) - 1 AS INTEGER) AS VARCHAR) AS occurrence FROM y""")
def d04(spark, d):
    k = F.col("o_orderkey")
    rule = F.when(k % 2 == 0, E.concat("FREQ=MONTHLY;BYMONTHDAY=", k % 31 + 1)).otherwise(
        E.concat("FREQ=YEARLY;BYMONTH=", k % 12 + 1, ";BYMONTHDAY=", k % 31 + 1))
    rows = E.table(spark, d, "orders").select(k.alias("obligation_id"), F.col("o_orderdate").cast("date").alias("start"), rule.alias("rule"))
    return O.expand_recurrence(rows, "rule", "start", 5).select("obligation_id", "n", _day("occurrence"))


def field_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines correct a date field of their order."""
    key = F.when(F.col("l_linenumber") % 2 == 0, "dates.effective").otherwise("dates.expiration")
    day = F.col("l_shipdate").cast("date").cast("string")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return E.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("correction_id"),
        F.concat_ws(":", "l_orderkey", key).alias("field_id"), F.concat(F.lit("Corrected to "), day).alias("new_value"),
        E.concat('{"date":"', day, '"}').alias("new_normalized"), F.col("l_suppkey").alias("corrected_by"),
        F.col("l_shipdate").cast("timestamp").alias("corrected_at"))


CTE["corrections"] = ([], """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS correction_id,
       l_orderkey || ':' || CASE WHEN l_linenumber % 2 = 0 THEN 'dates.effective' ELSE 'dates.expiration' END AS field_id,
       'Corrected to ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS new_value, '{"date":"' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '"}' AS new_normalized,
       l_suppkey AS corrected_by, CAST(l_shipdate AS TIMESTAMP) AS corrected_at
FROM lineitem WHERE l_returnflag = 'R'""")
CTE["corrected_fields"] = (["extracted_fields", "corrections"], """
SELECT f.* REPLACE (coalesce(c.new_value, f.value_text) AS value_text, coalesce(c.new_normalized, f.value_normalized) AS value_normalized,
                    CASE WHEN c.field_id IS NULL THEN f.validation_status ELSE 'corrected' END AS validation_status)
FROM extracted_fields f LEFT JOIN (SELECT * FROM corrections QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY corrected_at DESC, correction_id DESC) = 1) c ON c.field_id = f.field_id""")


def dependents(spark: SparkSession, d: str) -> DataFrame:
    """Obligations that know which field their anchor came from."""
    key = F.when(F.col("anchor") == "effective_date", "dates.effective").when(F.col("anchor") == "expiration_date", "dates.expiration")
    derived = F.when(key.isNotNull(), F.array(F.concat_ws(":", "obligation_id", key))).otherwise(F.array().cast("array<string>"))
    return obligations(spark, d).withColumns({"dv_id": F.col("obligation_id"), "derived_from": derived})


_RECOMPUTE = ["obligations", "corrections", "corrected_fields"]
CTE["corrected_anchors"] = (["corrected_fields"], _ANCHORS_SQL.replace("extracted_fields", "corrected_fields"))
CTE["recomputed"] = (["obligations", "corrections", "corrected_anchors"], """
SELECT obligation_id, start, CASE WHEN start IS NULL THEN NULL WHEN calendar = 'business' THEN raw + CASE isodow(raw) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END ELSE raw END AS due_date,
       CASE WHEN start IS NULL AND status <> 'suggested' THEN 'needs_assumption' ELSE status END AS status, field_id FROM (
  SELECT o.*, CAST(start AS DATE) + offset_days AS raw FROM (
    SELECT o.obligation_id, o.anchor, o.calendar, o.offset_days, o.status, CASE o.anchor WHEN 'effective_date' THEN a.effective_date ELSE a.expiration_date END AS start,
           o.obligation_id || ':' || CASE o.anchor WHEN 'effective_date' THEN 'dates.effective' ELSE 'dates.expiration' END AS field_id
    FROM obligations o LEFT JOIN corrected_anchors a ON a.dv_id = o.obligation_id
    WHERE o.anchor IN ('effective_date', 'expiration_date') AND o.status IN ('active', 'suggested', 'needs_assumption')) o)
WHERE field_id IN (SELECT field_id FROM corrections)""")


@_register("d06_recompute", with_ctes(["recomputed"], "SELECT obligation_id, CAST(due_date AS VARCHAR) AS due_date, status FROM recomputed"))
def d06(spark, d):
    from clausegrid.operators.citations import apply_corrections
    corr = field_corrections(spark, d)
    fields, _ = apply_corrections(E.extracted_fields(spark, d), corr)
    updated, _ = O.recompute(corr, dependents(spark, d), fields, "anchor_date")
    return updated.select("obligation_id", _day("due_date"), "status")


@_register("d06_recompute_events", with_ctes(["recomputed"], "SELECT obligation_id, 'recalculated' AS event_type, field_id AS from_correction, start IS NOT NULL AS dated FROM recomputed"))
def d06b(spark, d):
    from clausegrid.operators.citations import apply_corrections
    corr = field_corrections(spark, d)
    fields, _ = apply_corrections(E.extracted_fields(spark, d), corr)
    _, events = O.recompute(corr, dependents(spark, d), fields, "anchor_date")
    return events.select("obligation_id", "event_type", "from_correction", F.col("math").isNotNull().alias("dated"))


@_register("d07_renewal_notice", with_ctes(["extracted_fields"], """
SELECT dv_id, expiration_date, notice_days, CAST(CAST(expiration_date AS DATE) - notice_days AS VARCHAR) AS renewal_notice_by FROM (
  SELECT dv_id, max(CASE WHEN field_key = 'dates.expiration' THEN json_extract_string(value_normalized, '$.date') END) AS expiration_date,
         nullif(max(CASE WHEN field_key = 'renewal.notice_period_days' THEN CAST(regexp_extract(value_normalized, '[0-9]+') AS INTEGER) END), 0) AS notice_days
  FROM extracted_fields GROUP BY dv_id)"""))
def d07(spark, d):
    return O.renewal_notice_by(E.extracted_fields(spark, d, keys=O.RENEWAL_FIELDS)).select("dv_id", _day("expiration_date"), "notice_days", _day("renewal_notice_by"))


@_register("d08_promote_dates", with_ctes(["contracts", "extracted_fields"], """
SELECT c.contract_id, CASE WHEN f.contract_id IS NULL THEN CAST(c.effective_date AS VARCHAR) ELSE f.effective END AS effective_date,
       CASE WHEN f.contract_id IS NULL THEN CAST(c.expiration_date AS VARCHAR) ELSE f.expiration END AS expiration_date
FROM contracts c LEFT JOIN (
  SELECT contract_id, max(CASE WHEN field_key = 'dates.effective' THEN nullif(regexp_extract(value_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') END) AS effective,
         max(CASE WHEN field_key = 'dates.expiration' THEN nullif(regexp_extract(value_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') END) AS expiration
  FROM extracted_fields WHERE (contract_id, dv_id) IN (SELECT (contract_id, max(dv_id)) FROM extracted_fields GROUP BY contract_id) GROUP BY contract_id) f ON f.contract_id = c.contract_id"""))
def d08(spark, d):
    out = O.promote_dates(E.extracted_fields(spark, d), E.contracts(spark, d))
    return out.select("contract_id", _day("effective_date"), _day("expiration_date"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Shipped lines act on the obligation of their order."""
    n = (F.col("l_linenumber") + F.col("l_quantity").cast("int")) % 7
    act = (F.when(n == 0, "accept").when(n == 1, "edit").when(n == 2, "reject").when(n == 3, "assign")
           .when(n == 4, "snooze").when(n == 5, "supply_anchor").otherwise("complete"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return E.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("action_id"),
        F.col("l_orderkey").alias("obligation_id"), F.col("l_shipdate").cast("timestamp").alias("acted_at"), act.alias("action"),
        F.col("l_suppkey").alias("actor"), F.when(n == 1, E.concat("Title ", F.col("l_partkey"))).alias("title"),
        F.when((n == 1) & (F.col("l_partkey") % 3 == 0), E.concat("Changed Title ", F.col("l_partkey"))).alias("description"),
        F.when((n == 1) & (F.col("l_partkey") % 2 == 0), "low").alias("priority"),
        F.when((n == 3) | ((n == 0) & (F.col("l_partkey") % 2 == 0)), F.col("l_partkey")).alias("owner_user_id"),
        F.when((n == 5) & (F.col("l_partkey") % 5 != 0), F.date_add(F.col("l_shipdate").cast("date"), 10)).alias("anchor_date"))


CTE["actions"] = ([], """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS action_id, l_orderkey AS obligation_id, CAST(l_shipdate AS TIMESTAMP) AS acted_at,
       CASE n WHEN 0 THEN 'accept' WHEN 1 THEN 'edit' WHEN 2 THEN 'reject' WHEN 3 THEN 'assign' WHEN 4 THEN 'snooze' WHEN 5 THEN 'supply_anchor' ELSE 'complete' END AS action,
       l_suppkey AS actor, CASE WHEN n = 1 THEN 'Title ' || l_partkey END AS title, CASE WHEN n = 1 AND l_partkey % 2 = 0 THEN 'low' END AS priority,
       CASE WHEN n = 3 OR (n = 0 AND l_partkey % 2 = 0) THEN l_partkey END AS owner_user_id,
       CASE WHEN n = 5 AND l_partkey % 5 <> 0 THEN CAST(l_shipdate AS DATE) + 10 END AS anchor_date
FROM (SELECT *, (l_linenumber + CAST(l_quantity AS INTEGER)) % 7 AS n FROM lineitem)""")
CTE["valid_actions"] = (["actions", "obligations"], """
SELECT a.*, o.status AS initial_status, CASE action WHEN 'accept' THEN 'active' WHEN 'reject' THEN 'rejected' WHEN 'snooze' THEN 'snoozed' WHEN 'complete' THEN 'completed' WHEN 'supply_anchor' THEN 'suggested' END AS sets_status
FROM actions a JOIN obligations o ON o.obligation_id = a.obligation_id
WHERE action <> 'supply_anchor' OR CASE WHEN o.anchor = 'absolute' THEN o.anchor_value IS NOT NULL ELSE a.anchor_date IS NOT NULL END""")


@_register("d09_fold_obligations", with_ctes(["obligations", "valid_actions"], """
SELECT o.obligation_id, coalesce(s.sets_status, o.status) AS status, coalesce(t.title, o.title) AS title, coalesce(d.description, 'By ' || o.obligor) AS description, coalesce(p.priority, o.priority) AS priority,
       coalesce(w.owner_user_id, o.owner_user_id, fa.actor) AS owner_user_id, coalesce(n.actions, 0) AS actions,
       CAST(CASE WHEN x.anchor_date IS NULL OR o.anchor = 'absolute' THEN o.due_date
            ELSE x.anchor_date + o.offset_days + CASE WHEN o.calendar = 'business' THEN CASE isodow(x.anchor_date + o.offset_days) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END ELSE 0 END END AS VARCHAR) AS due_date
FROM obligations o
LEFT JOIN (SELECT obligation_id, arg_max(sets_status, (acted_at, action_id)) AS sets_status FROM valid_actions WHERE sets_status IS NOT NULL GROUP BY ALL) s USING (obligation_id)
LEFT JOIN (SELECT obligation_id, arg_max(title, (acted_at, action_id)) AS title FROM valid_actions WHERE action = 'edit' AND title IS NOT NULL GROUP BY ALL) t USING (obligation_id)
LEFT JOIN (SELECT obligation_id, arg_max('Changed ' || title, (acted_at, action_id)) AS description FROM valid_actions WHERE action = 'edit' AND title IS NOT NULL AND CAST(substr(title, 7) AS BIGINT) % 3 = 0 GROUP BY ALL) d USING (obligation_id)
LEFT JOIN (SELECT obligation_id, arg_max(priority, (acted_at, action_id)) AS priority FROM valid_actions WHERE action = 'edit' AND priority IS NOT NULL GROUP BY ALL) p USING (obligation_id)
LEFT JOIN (SELECT obligation_id, arg_max(owner_user_id, (acted_at, action_id)) AS owner_user_id FROM valid_actions WHERE owner_user_id IS NOT NULL GROUP BY ALL) w USING (obligation_id)
LEFT JOIN (SELECT obligation_id, arg_min(actor, (acted_at, action_id)) AS actor FROM valid_actions WHERE action = 'accept' GROUP BY ALL) fa USING (obligation_id)
LEFT JOIN (SELECT obligation_id, arg_max(anchor_date, (acted_at, action_id)) AS anchor_date FROM valid_actions WHERE action = 'supply_anchor' AND anchor_date IS NOT NULL GROUP BY ALL) x USING (obligation_id)
LEFT JOIN (SELECT obligation_id, count(*) AS actions FROM valid_actions GROUP BY ALL) n USING (obligation_id)"""))
def d09(spark, d):
    out = O.fold_obligations(obligations(spark, d).withColumn("description", F.concat(F.lit("By "), "obligor")), actions(spark, d))
    return out.select("obligation_id", "status", "title", "description", "priority", "owner_user_id", _day("due_date"), "actions")


@_register("d09_action_events", with_ctes(["valid_actions"], """
SELECT obligation_id, action_id, CASE action WHEN 'supply_anchor' THEN 'anchor_supplied' WHEN 'complete' THEN 'completed' ELSE action END AS event_type, actor,
       coalesce(last_value(sets_status IGNORE NULLS) OVER (PARTITION BY obligation_id ORDER BY acted_at, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial_status) AS prior_status
FROM valid_actions"""))
def d09b(spark, d):
    return O.action_events(obligations(spark, d), actions(spark, d)).select("obligation_id", "action_id", "event_type", "actor", "prior_status")


@_register("d10_manual_obligations", with_ctes(["obligation_rules"], """
SELECT obligation_id, CAST(anchor_value AS VARCHAR) AS due_date, 'fixed date ' || anchor_value || ' = ' || anchor_value AS due_date_math, CASE WHEN anchor_value IS NULL THEN 'needs_assumption' ELSE 'suggested' END AS status FROM obligation_rules"""))
def d10(spark, d):
    return O.manual_obligations(E.obligation_rules(spark, d)).select("obligation_id", _day("due_date"), "due_date_math", "status")


_BAND = f"""CASE WHEN due_date IS NULL THEN 'no date' WHEN due_date < DATE '{AS_OF}' THEN 'overdue' WHEN due_date - DATE '{AS_OF}' <= 7 THEN 'within 7 days'
 WHEN due_date - DATE '{AS_OF}' <= 31 THEN 'within 31 days' WHEN due_date - DATE '{AS_OF}' <= 90 THEN 'within 90 days' ELSE 'later' END"""


@_register("d11_due_bands", with_ctes(["obligations"], f"SELECT workspace_id, {_BAND} AS band, count(*) AS obligations FROM obligations GROUP BY 1, 2"))
def d11(spark, d):
    return O.due_bands(obligations(spark, d), AS_OF)


def _due_sql(days: int) -> str:
    return with_ctes(["obligations", "contracts"], f"""
SELECT o.workspace_id, o.rank, o.obligation_id, o.contract_id, c.title AS contract_title, o.title, o.status, CAST(o.due_date AS VARCHAR) AS due_date, o.due_date_math
FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY due_date, obligation_id) AS rank FROM obligations WHERE due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + {days}) o
JOIN contracts c ON c.contract_id = o.contract_id""")


def _due(spark, d, window):
    out = O.obligations_due(obligations(spark, d), E.contracts(spark, d), AS_OF, window)
    return out.select("workspace_id", "rank", "obligation_id", "contract_id", "contract_title", "title", "status", _day("due_date"), "due_date_math")


@_register("d12_due_window", _due_sql(90))
def d12(spark, d):
    return _due(spark, d, "90d")


@_register("d12_due_all", _due_sql(3650))
def d12b(spark, d):
    return _due(spark, d, "all")


@_register("d13_mark_overdue", with_ctes(["obligations"], f"""
SELECT obligation_id, CASE WHEN status = 'active' AND due_date + grace_days < DATE '{AS_OF}' THEN 'overdue' ELSE status END AS status FROM obligations"""))
def d13(spark, d):
    return O.mark_overdue(obligations(spark, d), AS_OF).select("obligation_id", "status")


_SCHED_COLS = ["schedule_id", "workspace_id", "obligation_id", "offset_days", "channel", "recipient_user_id", "status"]


@_register("d14_alert_schedule", with_ctes(["schedules"], f"SELECT {', '.join(_SCHED_COLS)}, {_tsq('scheduled_for')} FROM schedules"))
def d14(spark, d):
    return schedules(spark, d).select(*_SCHED_COLS, _ts("scheduled_for"))


@_register("d15_nine_local", with_ctes(["workspaces"], """
SELECT event_id, timezone, strftime(((CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE timezone AS DATE) AS TIMESTAMP) + INTERVAL 9 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS fires
FROM events JOIN workspaces ON workspace_id = user_id % 25"""))
def d15(spark, d):
    e = E.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 25).alias("workspace_id"))
    return (e.join(E.workspaces(spark, d), "workspace_id")
            .select("event_id", "timezone", F.date_format(D.at_nine_local("ts", "timezone"), "yyyy-MM-dd HH:mm:ss").alias("fires")))


def _changes(spark, d):
    """Half a year on, the dates of every business-calendar obligation move by 45 days."""
    return schedulable(spark, d).filter("calendar = 'business'").withColumn("due_date", F.date_add("due_date", 45))


def _reschedule_sql(strict: bool) -> str:
    keep = "false" if strict else "o.status2 = 'cancelled' AND n.schedule_id IS NOT NULL"
    return with_ctes(["schedules", "deliveries", "obligations", "workspaces"], f""",
fresh AS (
  SELECT obligation_id || ':' || offset_days || ':' || channel AS schedule_id, workspace_id, obligation_id, offset_days, channel, owner_user_id AS recipient_user_id,
         ((CAST(CAST((fires AT TIME ZONE 'UTC') AT TIME ZONE timezone AS DATE) AS TIMESTAMP) + INTERVAL 9 HOUR) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS scheduled_for
  FROM (SELECT *, CAST(due_date + 45 AS TIMESTAMP) + INTERVAL 9 HOUR - to_days(offset_days) AS fires FROM (
    SELECT o.* EXCLUDE (offset_days), w.timezone, unnest([90, 30, 14, 7, 1]) AS offset_days, CASE WHEN o.obligation_id % 2 = 0 THEN 'in_app' ELSE 'email' END AS channel
    FROM obligations o JOIN workspaces w ON w.workspace_id = o.workspace_id WHERE o.status = 'active' AND o.due_date IS NOT NULL AND o.calendar = 'business'))
  WHERE fires > TIMESTAMP '{AS_OF_TS}'),
base AS (SELECT s.*, CASE WHEN s.obligation_id IN (SELECT obligation_id FROM obligations WHERE status = 'active' AND calendar = 'business')
                         AND s.schedule_id NOT IN (SELECT schedule_id FROM deliveries) THEN 'cancelled' ELSE s.status END AS status2 FROM schedules s)
SELECT coalesce(o.schedule_id, n.schedule_id) AS schedule_id, CASE WHEN o.schedule_id IS NULL OR {keep} THEN 'scheduled' ELSE o.status2 END AS status,
       strftime(CASE WHEN o.schedule_id IS NULL OR {keep} THEN n.scheduled_for ELSE o.scheduled_for END, '%Y-%m-%d %H:%M:%S') AS scheduled_for
FROM base o FULL OUTER JOIN fresh n ON n.schedule_id = o.schedule_id""")


@_register("d16_reschedule", _reschedule_sql(False))
def d16(spark, d):
    s = schedules(spark, d)
    return A.reschedule(s, deliveries(s), _changes(spark, d), AS_OF_TS).select("schedule_id", "status", _ts("scheduled_for"))


@_register("d16_reschedule_strict", _reschedule_sql(True))
def d16b(spark, d):
    s = schedules(spark, d)
    return A.reschedule(s, deliveries(s), _changes(spark, d), AS_OF_TS, strict=True).select("schedule_id", "status", _ts("scheduled_for"))


def _notify_sql(batch: str) -> str:
    return with_ctes(["schedules", "deliveries", "obligations", "contracts", "memberships", "users"], f"""
SELECT r.schedule_id, r.schedule_id AS idempotency_key, r.workspace_id, r.channel, r.user_id, CASE WHEN r.channel = 'email' THEN u.email END AS email,
       'Reminder: ' || o.title AS title, c.title || ' — due ' || o.due_date AS body, '/obligations?focus=' || o.contract_id AS link
FROM (SELECT s.*, coalesce(s.recipient_user_id, m.user_id) AS user_id FROM (SELECT * FROM schedules WHERE scheduled_for <= TIMESTAMP '{AS_OF_TS}' AND schedule_id NOT IN (SELECT idempotency_key FROM deliveries) {batch}) s
      LEFT JOIN (SELECT workspace_id, user_id FROM memberships WHERE role IN ('workspace_admin', 'contract_owner')) m ON s.recipient_user_id IS NULL AND m.workspace_id = s.workspace_id
      WHERE coalesce(s.recipient_user_id, m.user_id) IS NOT NULL) r
JOIN obligations o ON o.obligation_id = r.obligation_id JOIN contracts c ON c.contract_id = o.contract_id LEFT JOIN users u ON u.user_id = r.user_id""")


def _notify(spark, d, batch):
    s = schedules(spark, d)
    return A.due_notifications(s, deliveries(s), obligations(spark, d), E.contracts(spark, d), E.memberships(spark, d), E.users(spark, d), AS_OF_TS, batch)


@_register("d17_due_notifications", _notify_sql(""))
def d17(spark, d):
    return _notify(spark, d, None)


@_register("d17_sweep_batch", _notify_sql("ORDER BY scheduled_for, schedule_id LIMIT 50"))
def d17b(spark, d):
    return _notify(spark, d, 50)


@_register("d17_settle", with_ctes(["schedules"], f"""
SELECT schedule_id, CASE WHEN scheduled_for <= TIMESTAMP '{AS_OF_TS}' AND obligation_id % 7 <> 0 THEN 'sent' ELSE status END AS status,
       strftime(CASE WHEN scheduled_for <= TIMESTAMP '{AS_OF_TS}' AND obligation_id % 7 = 0 THEN TIMESTAMP '{AS_OF_TS}' + INTERVAL 15 MINUTE ELSE scheduled_for END, '%Y-%m-%d %H:%M:%S') AS scheduled_for FROM schedules"""))
def d17c(spark, d):
    s = schedules(spark, d)
    results = s.filter(F.col("scheduled_for") <= F.lit(AS_OF_TS).cast("timestamp")).select("schedule_id", (F.col("obligation_id") % 7 != 0).alias("ok"))
    return A.settle_deliveries(s, results, AS_OF_TS).select("schedule_id", "status", _ts("scheduled_for"))


def _settled(spark, d):
    s = schedules(spark, d)
    return s.withColumn("status", F.when(F.col("obligation_id") % 5 == 0, "sent").otherwise(F.col("status")))


def _section_sql(section: str) -> str:
    where = {"sent": "status = 'sent'", "needs_action": f"status = 'scheduled' AND scheduled_for <= TIMESTAMP '{AS_OF_TS}'",
             "upcoming": f"status = 'scheduled' AND scheduled_for > TIMESTAMP '{AS_OF_TS}'"}[section]
    direction = "DESC" if section == "sent" else "ASC"
    return with_ctes(["schedules", "obligations", "contracts", "workspaces", "order_citations", "users"], f"""
SELECT s.workspace_id, s.rank, s.schedule_id, s.channel, strftime(s.scheduled_for, '%Y-%m-%d %H:%M:%S') AS scheduled_for, o.title AS obligation_title, CAST(o.due_date AS VARCHAR) AS due_date,
       c.title AS contract_title, w.timezone, ci.page, ci.section_ref, u.email AS recipient_email
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY scheduled_for {direction}, schedule_id) AS rank
      FROM (SELECT * REPLACE (CASE WHEN obligation_id % 5 = 0 THEN 'sent' ELSE status END AS status) FROM schedules) WHERE {where})) s
JOIN obligations o ON o.obligation_id = s.obligation_id JOIN contracts c ON c.contract_id = o.contract_id JOIN workspaces w ON w.workspace_id = s.workspace_id
LEFT JOIN order_citations ci ON ci.citation_id = o.citation_id LEFT JOIN users u ON u.user_id = s.recipient_user_id""")


def _section(section):
    def run(spark, d):
        out = A.alert_section(section, _settled(spark, d), obligations(spark, d), E.contracts(spark, d), E.workspaces(spark, d),
                              E.order_citations(spark, d), E.users(spark, d), AS_OF_TS)
        return out.select("workspace_id", "rank", "schedule_id", "channel", _ts("scheduled_for"), "obligation_title", _day("due_date"),
                          "contract_title", "timezone", "page", "section_ref", "recipient_email")
    return run


for _s in ("upcoming", "needs_action", "sent"):
    QUERIES[f"d18_alerts_{_s}"] = (_section(_s), _section_sql(_s))


def notifications(spark: SparkSession, d: str) -> DataFrame:
    """Events seen as notifications; every third one has been read."""
    return E.table(spark, d, "events").select(
        F.col("event_id").alias("notification_id"), "user_id", F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp")).alias("read_at"))


@_register("d19_unread", """
SELECT user_id, rank, notification_id, kind FROM (
  SELECT user_id, event_id AS notification_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events WHERE event_id % 3 <> 0)""")
def d19(spark, d):
    return A.unread(notifications(spark, d)).select("user_id", "rank", "notification_id", "kind")


@_register("d19_mark_read", """
SELECT user_id, event_id AS notification_id, event_id % 3 = 0 OR event_type = 'click' AS read FROM events""")
def d19b(spark, d):
    n = notifications(spark, d)
    reads = n.filter("kind = 'click'").select("notification_id", "user_id", F.lit(AS_OF_TS).cast("timestamp").alias("read_at"))
    return A.mark_read(n, reads).select("user_id", "notification_id", F.col("read_at").isNotNull().alias("read"))
