"""Registered queries: streaming jobs and their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions import ordered
from clausegrid.operators import obligations as O
from clausegrid.plans import citation_queries as CQ
from clausegrid.plans import date_queries as DQ
from clausegrid.plans import entities as E
from clausegrid.plans import risk_queries as RQ
from clausegrid.plans.entities import AS_OF_TS, CTE, with_ctes
from clausegrid.session import checkpoint_root
from clausegrid.streaming import jobs as S

QUERIES: dict = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _folder(spark) -> str:
    """A fresh folder in the shared checkpoint area."""
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def _status_of(events):
    """Status updates out of the event log."""
    e = F.col("event_type")
    status = F.when(e == "view", "parsing").when(e == "click", "parsing").when(e == "purchase", "extracting").when(e == "signup", "ready").otherwise("failed")
    return events.select(F.col("user_id").alias("dv_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("happened_at"), status.alias("status"))


_STATUS = """SELECT user_id AS dv_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS happened_at,
CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'parsing' WHEN 'purchase' THEN 'extracting' WHEN 'signup' THEN 'ready' ELSE 'failed' END AS status FROM events"""
_FEED = f"""SELECT dv_id, seq, status, status IN ('ready', 'failed', 'degraded') AS done FROM (SELECT *, lag(status) OVER (PARTITION BY dv_id ORDER BY happened_at, seq) AS prev FROM ({_STATUS}))
WHERE prev IS NULL OR prev IN ('ready', 'failed', 'degraded') OR prev <> status"""


@_register("st1_status_changes", _FEED)
def st1(spark, d):
    return S.status_changes(_status_of(E.table(spark, d, "events"))).select("dv_id", "seq", "status", "done")


_DELAY_DAYS = 5


@_register("st1_status_change_stream", _FEED.replace("WHERE prev", f"WHERE happened_at < (SELECT max(ts) FROM events) - INTERVAL {_DELAY_DAYS} DAY AND (prev").rstrip() + ")")
def st1b(spark, d):
    """The events of all days arrive in six files, up to four days out of order; the feed gives what the watermark has passed."""
    spark.conf.set(*S.STATE_CONF)
    root = _folder(spark)
    rows = _status_of(E.table(spark, d, "events"))
    first, days = rows.select(F.min("happened_at").cast("date"), F.datediff(F.max("happened_at"), F.min("happened_at"))).first()
    late = F.datediff("happened_at", F.lit(first)) + F.pmod(F.xxhash64("seq"), F.lit(4))
    # a file spans more days than its rows are late, so that the watermark of the files before it drops none
    arrived = rows.withColumn("file", F.floor(late / max(6, ((days or 0) + 4 + 5) // 6)).cast("int"))
    for n in range(6):
        arrived.filter(F.col("file") == n).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feed = S.status_change_stream(stream, f"{_DELAY_DAYS} days")
    S.run_to_sink(feed, lambda df, _: df, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("dv_id", "seq", "status", "done")


# ------------------------------------------------------------------ two sweeps, the first of which breaks off

_LATER = "2000-07-20 12:00:00"
CTE["swept_schedules"] = (["schedules", "deliveries"], f"""
SELECT schedule_id, CASE WHEN scheduled_for <= TIMESTAMP '{AS_OF_TS}' THEN 0 ELSE 1 END AS tick FROM schedules
WHERE status = 'scheduled' AND scheduled_for <= TIMESTAMP '{_LATER}' AND schedule_id NOT IN (SELECT schedule_id FROM deliveries)""")


def _two_sweeps(spark, d):
    return E.shared(spark, d, "two_sweeps", lambda: _make_two_sweeps(spark, d))


def _make_two_sweeps(spark, d):
    """A store after a tick that broke off when half of its messages were sent, its repetition, and a later tick."""
    root = _folder(spark)
    store = S.SweepStore(spark, f"{root}/store")
    sched = DQ.schedules(spark, d)
    first = {"schedules": sched, "deliveries": DQ.deliveries(sched), "obligations": DQ.obligations(spark, d)}
    refs = {"contracts": E.contracts(spark, d), "memberships": E.memberships(spark, d), "users": E.users(spark, d)}

    def send(messages):
        return messages.select("message_id", F.lit(True).alias("ok"))

    def half(messages):
        return send(messages.filter(F.pmod(F.xxhash64("message_id"), F.lit(2)) == 0))

    class Broken(Exception):
        pass

    def commit_fails(df, part, tick, put=store._put):
        if part == "tables/schedules":
            raise Broken
        return put(df, part, tick)

    store._put = commit_fails
    try:
        store.run(0, AS_OF_TS, first, refs, half)
    except Broken:
        pass
    del store._put
    ticks = S.table_stream(spark, d, "region.parquet")
    S.alert_sweep_stream(ticks, store, lambda: first, lambda: refs, lambda _: AS_OF_TS, send, f"{root}/checkpoint", every=None).awaitTermination()
    store.run(1, _LATER, first, refs, send)
    return store


@_register("st2_alert_sweep", with_ctes(["swept_schedules", "schedules", "obligations"], f"""
SELECT 'schedules' AS kind, s.schedule_id AS id, CASE WHEN w.tick IS NOT NULL THEN 'sent' ELSE status END AS status FROM schedules s LEFT JOIN swept_schedules w USING (schedule_id)
UNION ALL SELECT 'obligations', CAST(obligation_id AS VARCHAR), CASE WHEN status = 'active' AND due_date + grace_days < DATE '{_LATER[:10]}' THEN 'overdue' ELSE status END FROM obligations"""))
def st2(spark, d):
    tables = _two_sweeps(spark, d).tables({})
    return ordered.stack(tables["schedules"].select(F.lit("schedules").alias("kind"), F.col("schedule_id").alias("id"), "status"),
                         tables["obligations"].select(F.lit("obligations").alias("kind"), F.col("obligation_id").cast("string").alias("id"), "status"))


@_register("st2_sent_messages", with_ctes(["swept_schedules", "schedules", "memberships"], f"""
SELECT w.tick, s.schedule_id || ':' || coalesce(s.recipient_user_id, m.user_id) AS message_id, 1 AS times FROM swept_schedules w JOIN schedules s USING (schedule_id)
LEFT JOIN (SELECT workspace_id, user_id FROM memberships WHERE role IN ({', '.join(f"'{r}'" for r in K.ALERT_ROLES)})) m ON s.recipient_user_id IS NULL AND m.workspace_id = s.workspace_id
WHERE coalesce(s.recipient_user_id, m.user_id) IS NOT NULL"""))
def st2b(spark, d):
    store = _two_sweeps(spark, d)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{store.root}/receipts")
    tick = F.regexp_extract(F.input_file_name(), "tick=([0-9]+)", 1).cast("int")
    return rows.select(tick.alias("tick"), "message_id").groupBy("tick", "message_id").agg(F.count("*").cast("int").alias("times"))


def _limit_sql(n: int, seconds: int) -> str:
    return f"""SELECT user_id, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts, {n}) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < {seconds * 1000000}, false) AS limited FROM events"""


def _attempts(df):
    return df.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))


@_register("st3_rate_flags_day", _limit_sql(5, 86400))
def st3(spark, d):
    return S.rate_flags(_attempts(E.table(spark, d, "events")), "user_id", "ts", "event_id", 5, 86400).select("user_id", "event_id", "limited")


@_register("st3_rate_flags_minutes", _limit_sql(2, 600))
def st3b(spark, d):
    return S.rate_flags(_attempts(E.table(spark, d, "events")), "user_id", "ts", "event_id", 2, 600).select("user_id", "event_id", "limited")


@_register("st3_rate_flag_stream", _limit_sql(5, 86400))
def st3c(spark, d):
    spark.conf.set(*S.STATE_CONF)
    root = _folder(spark)
    flags = S.rate_flag_stream(_attempts(S.table_stream(spark, d, "events.parquet")), "user_id", "ts", "event_id", 5, 86400)
    S.run_to_sink(flags, lambda df, _: df, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", "event_id", "limited")


def _delivery_stream(spark, d):
    return S.table_stream(spark, d, "events.parquet").select(
        F.concat_ws(":", "user_id", "event_type", F.col("event_id") % 3).alias("idempotency_key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


@_register("st4_dedupe_deliveries", """
SELECT user_id || ':' || event_type || ':' || (event_id % 3) AS idempotency_key, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def st4(spark, d):
    """The whole stream is sent twice: the second query starts from an empty checkpoint over the same ledger and sends nothing."""
    root = _folder(spark)
    for n in (1, 2):
        S.dedupe_deliveries(_delivery_stream(spark, d), f"{root}/out", f"{root}/checkpoint-{n}", ["ts", "event_id"]).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("idempotency_key", "event_id")


@_register("st4_dedupe_stream", "SELECT user_id || ':' || event_type || ':' || (event_id % 3) AS idempotency_key, 1 AS times FROM events GROUP BY 1")
def st4b(spark, d):
    root = _folder(spark)
    spark.conf.set(*S.STATE_CONF)
    once = S.dedupe_stream(_delivery_stream(spark, d), "ts", "60 days")
    S.run_to_sink(once, lambda df, _: df, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("idempotency_key").agg(F.count("*").cast("int").alias("times"))


# ------------------------------------------------------------------ documents through all stages

_ERROR = "The model gave no answer."


def _draft(pages):
    """Candidates as the batch queries make them; for every seventeenth version the model fails."""
    evidence = CQ.evidence_of(pages.filter("dv_id % 17 <> 0"))
    return {"fields": CQ.candidates_of(evidence), "obligations": RQ.obligation_candidates(evidence), "flags": RQ.flag_candidates(evidence),
            "errors": pages.filter("dv_id % 17 = 0").select("dv_id", F.lit(_ERROR).alias("reason"))}


def _documents(spark, d):
    return E.shared(spark, d, "document_stream", lambda: _stream_documents(spark, d))


def _stream_documents(spark, d):
    """All documents as a stream, one without text and one without a language among them."""
    root = _folder(spark)
    k = F.col("dv_id")

    def prepare(batch):
        return E.number_sections(batch).withColumns({
            "text": F.when(k % 100 != 42, F.col("text")), "lang": F.when(k % 100 != 44, F.col("lang"))})

    anchors = O.anchors(E.extracted_fields(spark, d, keys=K.ANCHOR_FIELDS.values()))
    S.document_stream(S.table_stream(spark, d, "documents.parquet"), prepare, E.cut_pages, _draft, anchors, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


CTE["streamed"] = (["contract_texts"], "SELECT dv_id FROM contract_texts WHERE lang = 'en' AND dv_id % 100 NOT IN (42, 44)")


@_register("st5_document_stream", with_ctes(["clauses", "streamed"], """
SELECT clause_id, section_ref, clause_type, char_start, char_end, sha256(text) AS h FROM clauses WHERE dv_id IN (SELECT dv_id FROM streamed)"""))
def st5(spark, d):
    return S.latest_outputs(spark, _documents(spark, d), "clauses", ["dv_id"]).select(
        "clause_id", "section_ref", "clause_type", "char_start", "char_end", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))


@_register("st5_document_fields", with_ctes(["validated", "streamed"], """
SELECT dv_id, field_key, verdict, final_status AS status, confidence FROM validated WHERE dv_id % 17 <> 0 AND dv_id IN (SELECT dv_id FROM streamed)"""))
def st5c(spark, d):
    return S.latest_outputs(spark, _documents(spark, d), "fields", ["dv_id"]).select("dv_id", "field_key", "verdict", "status", "confidence")


@_register("st5_document_flags", with_ctes(["streamed"], "SELECT * FROM (" + RQ.QUERIES["k01_build_flags"][1] + ") WHERE dv_id % 17 <> 0 AND dv_id IN (SELECT dv_id FROM streamed)"))
def st5d(spark, d):
    return S.latest_outputs(spark, _documents(spark, d), "flags", ["dv_id"]).select("citation_id", "dv_id", "title", "confidence", "status", "char_start")


@_register("st5_document_obligations", with_ctes(["streamed"], "SELECT citation_id, title, status, due_date FROM (" + RQ.QUERIES["d05_derive_obligations"][1] + ") WHERE dv_id % 17 <> 0 AND dv_id IN (SELECT dv_id FROM streamed)"))
def st5e(spark, d):
    return S.latest_outputs(spark, _documents(spark, d), "obligations", ["dv_id"]).select("citation_id", "title", "status", F.col("due_date").cast("string").alias("due_date"))


@_register("st5_outcomes", with_ctes(["pages_o", "contract_texts", "streamed"], f"""
SELECT dv_id, CASE WHEN bool_or(ocr_derived) OR dv_id % 17 = 0 THEN 'degraded' ELSE 'succeeded' END AS status, CASE WHEN dv_id % 17 = 0 THEN '{_ERROR}' END AS failure_reason
FROM pages_o WHERE dv_id IN (SELECT dv_id FROM streamed) GROUP BY dv_id
UNION ALL SELECT dv_id, 'failed', CASE WHEN dv_id % 100 = 44 THEN 'Unsupported language: unknown' WHEN lang <> 'en' THEN 'Unsupported language: ' || lang ELSE 'No text could be extracted.' END
FROM contract_texts WHERE dv_id NOT IN (SELECT dv_id FROM streamed)"""))
def st5b(spark, d):
    return spark.read.parquet(f"{_documents(spark, d)}/outcomes").select("dv_id", "status", "failure_reason")


@_register("st5_arrival_counts", """
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def st5f(spark, d):
    root = _folder(spark)
    spark.conf.set(*S.STATE_CONF)
    stream = S.table_stream(spark, d, "events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    S.run_to_sink(S.arrival_counts(stream, "ts", ["event_type"]), lambda df, _: df, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("window_start", "event_type", "n")
