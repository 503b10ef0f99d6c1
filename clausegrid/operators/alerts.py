"""Alert schedules, delivery and notification lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import dates as D
from clausegrid.functions import ordered

KEY = ["obligation_id", "offset_days", "channel"]
#: Members of a workspace that its messages without a named recipient meet in one place.
STAFF_BLOCK = 1024


def _instant(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def alert_schedule(obligations: DataFrame, as_of: str | Column) -> DataFrame:
    """Schedules at 09:00 local time 90/30/14/7/1 days before the due date; past ones are left out.

    Rows carry `obligation_id, workspace_id, due_date, owner_user_id, channel, timezone`.
    """
    nine = F.col("due_date").cast("timestamp") + F.expr(f"INTERVAL {K.ALERT_HOUR} HOURS")
    rows = (obligations.filter(F.col("due_date").isNotNull())
            .withColumn("offset_days", F.explode(F.array(*[F.lit(o) for o in K.ALERT_OFFSETS])))
            .withColumn("__when", nine - F.make_interval(days=F.col("offset_days"))))
    live = rows.filter(F.col("__when") > _instant(as_of))
    return live.select(
        F.concat_ws(":", *KEY).alias("schedule_id"), "workspace_id", *KEY,
        F.col("owner_user_id").alias("recipient_user_id"), D.at_nine_local("__when", "timezone").alias("scheduled_for"),
        F.lit("scheduled").alias("status"))


def reschedule(schedules: DataFrame, deliveries: DataFrame, changes: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """Cancel pending, undelivered schedules of changed obligations and schedule the new dates.

    A cancelled row whose key comes up again is revived with the new time; `strict` keeps
    the row that exists. Delivered history never changes.
    """
    done = deliveries.filter(F.col("delivered_at").isNotNull()).select("schedule_id").distinct().withColumn("__done", F.lit(True))
    changed = changes.select("obligation_id").distinct().withColumn("__changed", F.lit(True))
    base = schedules.join(done, "schedule_id", "left").join(changed, "obligation_id", "left")
    cancel = F.col("__changed").isNotNull() & F.col("__done").isNull() & F.col("status").isin("scheduled", "due")
    base = base.withColumn("status", F.when(cancel, "cancelled").otherwise(F.col("status"))).drop("__done", "__changed")
    fresh = alert_schedule(changes, as_of)
    old = base.select(*KEY, F.struct(*schedules.columns).alias("o"))
    new = fresh.select(*KEY, F.struct(*schedules.columns).alias("n"))
    both = old.join(new, KEY, "full_outer")
    revive = F.lit(False) if strict else (F.col("o.status") == "cancelled") & F.col("n").isNotNull()
    pick = F.when(F.col("o").isNull() | revive, F.col("n")).otherwise(F.col("o"))
    return both.select(pick.alias("r")).select("r.*")


def due_schedules(schedules: DataFrame, deliveries: DataFrame, as_of: str, batch: int | None = None) -> DataFrame:
    """Schedules that are due and not yet delivered, with their idempotency key; a batch is taken from what is left to do."""
    due = schedules.filter((F.col("status") == "scheduled") & (F.col("scheduled_for") <= _instant(as_of)))
    due = due.withColumn("idempotency_key", F.concat_ws(":", *KEY)).join(
        deliveries.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    return due if batch is None else due.orderBy("scheduled_for", "schedule_id").limit(batch)


def due_notifications(
    schedules: DataFrame, deliveries: DataFrame, obligations: DataFrame, contracts: DataFrame,
    memberships: DataFrame, users: DataFrame, as_of: str, batch: int | None = None, recipients: int | None = None,
) -> DataFrame:
    """Messages to send for schedules that are due and not yet delivered.

    A named recipient gets the message; otherwise the admins and owners of the workspace do,
    the first `recipients` of them if given. `batch` bounds a sweep; None takes everything that is due.
    """
    return notifications_for(due_schedules(schedules, deliveries, as_of, batch), obligations, contracts, memberships, users, recipients)


def notifications_for(due: DataFrame, obligations: DataFrame, contracts: DataFrame, memberships: DataFrame, users: DataFrame, recipients: int | None = None) -> DataFrame:
    """The messages of due schedules, one per recipient.

    What a message says of its obligation and its recipient is joined before schedules and recipients meet, so that messages are not shuffled.
    The staff of a large workspace lies in blocks, which its schedules visit: a workspace is many tasks."""
    facts = obligations.select("obligation_id", F.col("title").alias("o_title"), "contract_id", "due_date")
    names = contracts.select("contract_id", F.col("title").alias("c_title"))
    emails = users.select("user_id", "email")
    told = due.join(facts, "obligation_id").join(names, "contract_id", "left")
    named = told.filter(F.col("recipient_user_id").isNotNull()).withColumn("user_id", F.col("recipient_user_id")).join(emails, "user_id", "left")
    staff = memberships.filter(F.col("role").isin(*K.ALERT_ROLES)).select("workspace_id", "user_id")
    if recipients is not None:
        staff = ordered.top_n(staff, ["workspace_id"], [F.col("user_id")], recipients).drop("rank")
    blocks = staff.groupBy("workspace_id").agg(F.ceil(F.count("*") / STAFF_BLOCK).cast("int").alias("__blocks"))
    staff = staff.join(emails, "user_id", "left").join(blocks, "workspace_id").withColumn(
        "__block", F.pmod(F.xxhash64("user_id"), F.col("__blocks")).cast("int")).drop("__blocks")
    shared = told.filter(F.col("recipient_user_id").isNull()).join(blocks, "workspace_id").withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    shared = shared.join(staff, ["workspace_id", "__block"]).drop("__block")
    rows = ordered.stack(named, shared)
    return rows.select(
        "schedule_id", "idempotency_key", "workspace_id", "channel", "user_id",
        F.when(F.col("channel") == "email", F.col("email")).alias("email"),
        F.concat(F.lit("Reminder: "), F.col("o_title")).alias("title"),
        F.concat(F.coalesce("c_title", F.lit("Contract")), F.lit(" — due "),
                 F.coalesce(F.col("due_date").cast("string"), F.lit("date pending"))).alias("body"),
        F.concat(F.lit("/obligations?focus="), F.col("contract_id").cast("string")).alias("link"))


def settle_deliveries(schedules: DataFrame, results: DataFrame, as_of: str, due: DataFrame | None = None) -> DataFrame:
    """Schedules after a sweep: delivered ones are sent, failed ones move 15 minutes ahead. Of the `due` ones, those
    without any recipient have no result and are sent as well."""
    r = results.groupBy("schedule_id").agg(F.bool_and("ok").alias("ok"))
    if due is not None:
        r = due.select("schedule_id").distinct().join(r, "schedule_id", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    later = _instant(as_of) + F.expr(f"INTERVAL {K.RETRY_MINUTES} MINUTES")
    return schedules.join(r, "schedule_id", "left").withColumns({
        "status": F.when(F.col("ok"), "sent").otherwise(F.col("status")),
        "scheduled_for": F.when(~F.col("ok"), later).otherwise(F.col("scheduled_for")),
    }).drop("ok")


def alert_section(
    section: str, schedules: DataFrame, obligations: DataFrame, contracts: DataFrame, workspaces: DataFrame,
    citations: DataFrame, users: DataFrame, as_of: str, limit: int | None = None,
) -> DataFrame:
    """Upcoming, due or sent alerts, all of a workspace unless `limit` is given, with citation and recipient."""
    at, now = F.col("scheduled_for"), _instant(as_of)
    wanted = {
        "sent": F.col("status") == "sent",
        "needs_action": (F.col("status") == "scheduled") & (at <= now),
        "upcoming": (F.col("status") == "scheduled") & (at > now),
    }[section]
    first = at.desc() if section == "sent" else at.asc()
    top = ordered.top_n(schedules.filter(wanted), ["workspace_id"], [first, F.col("schedule_id")], limit,
                        split=[ordered.down(at) if section == "sent" else at, F.col("schedule_id")])
    o = obligations.select("obligation_id", F.col("title").alias("obligation_title"), "due_date", "contract_id", "citation_id")
    return (top.join(o, "obligation_id")
            .join(contracts.select("contract_id", F.col("title").alias("contract_title")), "contract_id")
            .join(workspaces.select("workspace_id", "timezone"), "workspace_id")
            .join(citations.select("citation_id", "page", "section_ref"), "citation_id", "left")
            .join(users.select(F.col("user_id").alias("recipient_user_id"), F.col("email").alias("recipient_email")), "recipient_user_id", "left"))


def unread(notifications: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest unread notifications of every user."""
    open_rows = notifications.filter(F.col("read_at").isNull())
    return ordered.top_n(open_rows, ["user_id"], [F.col("created_at").desc(), F.col("notification_id")], limit, split=[ordered.down("created_at"), F.col("notification_id")])


def mark_read(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """Apply (notification_id, user_id, read_at) marks; a user marks only own rows."""
    r = reads.groupBy("notification_id", "user_id").agg(F.max("read_at").alias("__read"))
    return notifications.join(r, ["notification_id", "user_id"], "left").withColumn(
        "read_at", F.coalesce("__read", "read_at")).drop("__read")
