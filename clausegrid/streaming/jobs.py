"""Structured Streaming jobs over the batch operators.

Sinks write one partition per micro-batch and overwrite it when the batch is replayed, so a
lost executor or a restarted query leaves no duplicates. State needs the RocksDB provider
(`STATE_CONF`) on the session that starts the query.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from clausegrid import constants as K
from clausegrid.functions import ordered
from clausegrid.functions.text import is_blank as text_is_blank
from clausegrid.operators import alerts as A
from clausegrid.operators import citations as C
from clausegrid.operators import obligations as O
from clausegrid.operators import retrieval as Rt
from clausegrid.operators import risk as Rk
from clausegrid.operators import text as T
from clausegrid.session import shuffles_dropped

STATE_CONF = ("spark.sql.streaming.stateStore.providerClass",
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SWEEP = "15 minutes"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of one table, which is a file or a folder of files, as a stream, schema taken from the files present."""
    path = f"{folder}/{name}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_to_sink(stream: DataFrame, process: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str,
                every: str | None = None) -> StreamingQuery:
    """Apply a batch operator to every micro-batch and keep its result under `out`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


# ------------------------------------------------------------------ status change feed

def status_changes(events: DataFrame) -> DataFrame:
    """Batch form of the feed: events whose status differs from the one before. A terminal
    status closes the feed, so the next event opens it again."""
    seen = ordered.previous(events, ["dv_id"], ["happened_at", "seq"], ["status"])
    opened = F.col("prev_status").isNull() | F.col("prev_status").isin(*K.TERMINAL_STATUS) | (F.col("prev_status") != F.col("status"))
    return seen.filter(opened).withColumn("done", F.col("status").isin(*K.TERMINAL_STATUS)).drop("prev_status")


def status_change_stream(stream: DataFrame, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """The feed in event time over a stream of (dv_id, happened_at, seq, status).

    Rows wait in a list state until the watermark (`delay` behind the newest row) has passed them, so rows that arrive late or in
    another order give the same feed as the batch form; rows later than that are dropped by the watermark. The last payload is
    cleared at a terminal status, and after `idle_ms` of event time without rows."""
    terminal = set(K.TERMINAL_STATUS)

    class Feed(StatefulProcessor):
        def init(self, handle) -> None:
            self._handle = handle
            self._waiting = handle.getListState("waiting", "t long, seq long, status string")
            self._last = handle.getValueState("last", "status string, t long")

        def _alarm(self, at_ms: int) -> None:
            for old in list(self._handle.listTimers()):
                self._handle.deleteTimer(old)
            self._handle.registerTimer(at_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            first = None
            for frame in rows:
                times = frame["happened_at"].astype("datetime64[us]").astype("int64")
                self._waiting.appendList([(int(t), int(q), str(s)) for t, q, s in zip(times, frame["seq"], frame["status"])])
                low = int(times.min())
                first = low if first is None else min(first, low)
            pending = [t for t, _, _ in self._waiting.get()]
            self._alarm(min([*pending, first]) // 1000 + 1)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            mark = timerValues.getCurrentWatermarkInMs()
            rows = sorted(self._waiting.get())
            ready = [r for r in rows if r[0] // 1000 < mark]
            rest = rows[len(ready):]
            status, at = self._last.get() if self._last.exists() else (None, None)
            out = []
            for t, seq, now in ready:
                if idle_ms is not None and at is not None and t - at > idle_ms * 1000:
                    status = None
                if now != status:
                    out.append((seq, now))
                status, at = (None if now in terminal else now), t
            if rest:
                self._waiting.put(rest)
                self._alarm(rest[0][0] // 1000 + 1)
            else:
                self._waiting.clear()
                if status is not None and idle_ms is not None:
                    self._alarm(at // 1000 + idle_ms + 1)
            if status is None or (not rest and idle_ms is not None and mark > at // 1000 + idle_ms):
                self._last.clear()
            else:
                self._last.update((status, at))
            if out:
                yield pd.DataFrame({"dv_id": [key[0]] * len(out), "seq": [q for q, _ in out], "status": pd.Series([x for _, x in out], dtype=object),
                                    "done": [x in terminal for _, x in out]})

        def close(self) -> None:
            pass

    return stream.withWatermark("happened_at", delay).groupBy("dv_id").transformWithStateInPandas(
        statefulProcessor=Feed(), outputStructType="dv_id long, seq long, status string, done boolean", outputMode="Append", timeMode="EventTime")


# ------------------------------------------------------------------ attempt limiter

def rate_flags(events: DataFrame, key: str, ts: str, tie: str, n: int = 5, seconds: int = 600) -> DataFrame:
    """Attempts that are more than the n-th within the trailing window (denied ones count; an
    attempt exactly as old as the window does not). Attempt i is flagged when attempt i-n is
    still inside the window, which is an equi-join on the attempt number."""
    numbered = ordered.numbered(events, [key], [ts, tie], "attempt_no")
    earlier = numbered.select(F.col(key).alias("__k"), (F.col("attempt_no") + n).alias("__n"), F.col(ts).alias("__t"))
    joined = numbered.join(earlier, (F.col(key) == F.col("__k")) & (F.col("attempt_no") == F.col("__n")), "left")
    inside = F.unix_micros(F.col(ts)) - F.unix_micros(F.col("__t")) < seconds * 1_000_000
    return joined.withColumn("limited", F.coalesce(inside, F.lit(False))).drop("__k", "__n", "__t")


def rate_flag_stream(stream: DataFrame, key: str, ts: str, tie: str, n: int = 5, seconds: int = 600, watermark: str = "10 minutes") -> DataFrame:
    """The limiter over a stream; state holds the last n attempt times of a key and expires
    when the watermark has passed them by the window."""
    micros, name = seconds * 1_000_000, key

    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            self._handle = handle
            self._recent = handle.getListState("recent", "t long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat(list(rows)).sort_values([ts, tie])
            recent = [r[0] for r in self._recent.get()]
            limited = []
            for t in frame[ts].astype("datetime64[us]").astype("int64"):
                limited.append(len(recent) >= n and t - recent[-n] < micros)
                recent = (recent + [int(t)])[-n:]
            self._recent.put([(t,) for t in recent])
            for old in list(self._handle.listTimers()):
                self._handle.deleteTimer(old)
            self._handle.registerTimer(recent[-1] // 1000 + seconds * 1000 + 1)
            yield pd.DataFrame({name: frame[name], tie: frame[tie], "limited": limited})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self._recent.clear()
            yield pd.DataFrame({name: [], tie: [], "limited": []})

        def close(self) -> None:
            pass

    key_type, tie_type = (stream.schema[c].dataType.simpleString() for c in (key, tie))
    return stream.withWatermark(ts, watermark).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Limiter(), outputStructType=f"{key} {key_type}, {tie} {tie_type}, limited boolean", outputMode="Append", timeMode="EventTime")


# ------------------------------------------------------------------ exactly-once deliveries

def dedupe_stream(stream: DataFrame, ts: str, delay: str, key: str = "idempotency_key") -> DataFrame:
    """First row per key within the watermark; later repeats meet the sink's own check."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


#: Hash buckets of a ledger of keys.
LEDGER_BUCKETS = 256


def dedupe_deliveries(stream: DataFrame, out: str, checkpoint: str, order_by: list[str], key: str = "idempotency_key") -> StreamingQuery:
    """At most one delivery per key over the whole life of the sink: the earliest of the
    micro-batch, and none for keys that the ledger holds.

    `out` is the ledger, partitioned by the hash of the key; a micro-batch (the first one of a new checkpoint as well) reads the buckets
    of its own keys only. A partition names the query that wrote it and its batch, so that a replayed batch replaces its own
    rows and a new checkpoint over an old ledger replaces none."""
    spark, started, query_id = stream.sparkSession, threading.Event(), []
    bucket = F.pmod(F.xxhash64(key), F.lit(LEDGER_BUCKETS)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        name = f"{query_id[0]}-{batch_id}"
        first = ordered.earliest(batch, [key], order_by).withColumn("bucket", bucket)
        wanted = [r[0] for r in first.select("bucket").distinct().collect()]  # at most LEDGER_BUCKETS numbers
        ledger = spark.read.schema(t.StructType([first.schema[key], t.StructField("bucket", t.IntegerType()), t.StructField("batch", t.StringType())]))
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            held = ledger.parquet(out).filter(F.col("bucket").isin(wanted) & (F.col("batch") != name))
            first = first.join(held.select(key, "bucket"), [key, "bucket"], "left_anti")
        first.withColumn("batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(out)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query_id.append(query.id)
    started.set()
    return query


# ------------------------------------------------------------------ alert sweep

def sweep(tables: dict[str, DataFrame], as_of: str, batch: int | None = None, sent: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """One sweep: messages that are due, their delivery keys (write them before sending), schedules after delivery, obligations after the overdue rule.

    `sent` maps messages to (schedule_id, ok) as the transport reports them; by default all go out.
    """
    due = A.due_schedules(tables["schedules"], tables["deliveries"], as_of, batch)
    messages = A.notifications_for(due, tables["obligations"], tables["contracts"], tables["memberships"], tables["users"])
    results = sent(messages) if sent else messages.select("schedule_id", F.lit(True).alias("ok"))
    return {"messages": messages, "schedules": A.settle_deliveries(tables["schedules"], results, as_of, due),
            "deliveries": due.select("idempotency_key", "schedule_id"),
            "obligations": O.mark_overdue(tables["obligations"], as_of[:10])}


class SweepStore:
    """What a sweep leaves to the next one, under one folder.

    `outbox/tick=n`: what is due at a tick, and its messages, written before anything is sent. `receipts/tick=n`: what the transport reported, by
    message. `tables/tick=n`: schedules, obligations and deliveries after the tick. `commits/tick=n`: written last; the greatest one names the tables
    that hold. A tick that broke off is run again: its outbox is read, not made anew, and only messages without a receipt are sent."""

    STATE = ("schedules", "obligations", "deliveries")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _has(self, part: str, tick: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}/tick={tick}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _put(self, df: DataFrame, part: str, tick: int) -> DataFrame:
        path = f"{self.root}/{part}/tick={tick}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _get(self, part: str, tick: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{part}/tick={tick}")

    def committed(self) -> int | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        ticks = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((t for t in ticks if self._has("commits", t)), default=None)

    def tables(self, first: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The state after the last committed tick; `first` before any."""
        tick = self.committed()
        return {k: first[k] if tick is None else self._get(f"tables/{k}", tick) for k in self.STATE}

    def run(self, tick: int, as_of: str, first: dict[str, DataFrame], refs: dict[str, DataFrame], send: Callable[[DataFrame], DataFrame],
            batch: int | None = None) -> None:
        """One tick. `refs`: contracts, memberships, users. `send` maps messages to (message_id, ok) and sends them when it is evaluated; a transport
        should refuse a message_id that it has seen, since a task can be repeated before its receipts are written."""
        done = self.committed()
        if done is not None and done >= tick:
            return  # a replayed trigger
        state = self.tables(first)
        if not self._has("outbox/messages", tick):
            due = self._put(A.due_schedules(state["schedules"], state["deliveries"], as_of, batch), "outbox/due", tick)
            made = A.notifications_for(due, state["obligations"], refs["contracts"], refs["memberships"], refs["users"])
            self._put(made.withColumn("message_id", F.concat_ws(":", "idempotency_key", "user_id")), "outbox/messages", tick)
        due, messages = self._get("outbox/due", tick), self._get("outbox/messages", tick)
        receipts, attempt = [], 0
        while self._has(f"receipts/attempt={attempt}", tick):
            receipts.append(self._get(f"receipts/attempt={attempt}", tick))
            attempt += 1
        open_messages = messages
        for r in receipts:
            open_messages = open_messages.join(r.select("message_id"), "message_id", "left_anti")
        receipts.append(self._put(send(open_messages), f"receipts/attempt={attempt}", tick))
        results = ordered.stack(*receipts).join(messages.select("message_id", "schedule_id"), "message_id").select("schedule_id", "ok")
        schedules = A.settle_deliveries(state["schedules"], results, as_of, due)
        failed = results.groupBy("schedule_id").agg(F.bool_and("ok").alias("ok")).filter("NOT ok")
        delivered = due.select("schedule_id", "idempotency_key").join(failed, "schedule_id", "left_anti").withColumn(
            "delivered_at", F.lit(as_of).cast("timestamp"))
        self._put(schedules, "tables/schedules", tick)
        self._put(O.mark_overdue(state["obligations"], as_of[:10]), "tables/obligations", tick)
        self._put(ordered.stack(state["deliveries"].select(*delivered.columns), delivered), "tables/deliveries", tick)
        self._put(self.spark.range(1), "commits", tick)


def alert_sweep_stream(ticks: DataFrame, store: SweepStore, first: Callable[[], dict[str, DataFrame]], refs: Callable[[], dict[str, DataFrame]],
                       clock: Callable[[int], str], send: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = SWEEP) -> StreamingQuery:
    """Run the sweep at every trigger (15 minutes by default), each on what the one before it committed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store.run(batch_id, clock(batch_id), first(), refs(), send)

    writer = ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


# ------------------------------------------------------------------ incremental documents

def _refusal(lang: Column, text: Column) -> Column:
    return (F.when(lang.isNull() | (lang != "en"), F.concat(F.lit("Unsupported language: "), F.coalesce(lang, F.lit("unknown"))))
            .when(text.isNull() | text_is_blank(text), "No text could be extracted."))


def process_documents(batch: DataFrame, to_pages: Callable[[DataFrame], DataFrame], draft: Callable[[DataFrame], dict[str, DataFrame]],
                      anchors: DataFrame, put: Callable[[str, DataFrame], DataFrame], dim: int = 1536) -> None:
    """One batch of versions (dv_id, lang, text, ...) through all stages, from pages to risk flags.

    `put(name, rows)` writes a table and reads it again: every stage is evaluated once and later ones read what it wrote. `draft(pages)` gives
    the model's candidates: fields, obligations and flags, and errors (dv_id, reason). Versions in another language or without text
    are failed rows with their reason, versions that a draft failed for are degraded ones; the rest go on."""
    intake = put("intake", batch.withColumn("failure_reason", _refusal(F.col("lang"), F.col("text"))))
    pages = put("pages", T.page_offsets(to_pages(intake.filter("failure_reason IS NULL").drop("failure_reason"))))
    clauses = put("clauses", T.segment(T.assemble(pages)))
    chunks = put("chunks", T.chunk(clauses, pages))
    put("vectors", chunks.select("chunk_id", Rt.vector_of("text", dim).alias("vector")).filter("vector IS NOT NULL"))
    drafted = draft(pages)
    errors = drafted["errors"].groupBy("dv_id").agg(F.min("reason").alias("draft_reason"))
    put("fields", C.validate_fields(drafted["fields"], pages))
    put("obligations", Rk.derive_obligations(drafted["obligations"], anchors, pages))
    put("flags", Rk.build_flags(drafted["flags"], pages))
    found = T.document_outcome(pages).join(errors, "dv_id", "left").select(
        "dv_id", F.when((F.col("outcome") == "succeeded") & F.col("draft_reason").isNotNull(), "degraded").otherwise(F.col("outcome")).alias("status"),
        F.coalesce("failure_reason", "draft_reason").alias("failure_reason"))
    refused = intake.filter("failure_reason IS NOT NULL").select("dv_id", F.lit("failed").alias("status"), "failure_reason")
    put("outcomes", ordered.stack(found, refused))


def document_stream(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], to_pages: Callable[[DataFrame], DataFrame],
                    draft: Callable[[DataFrame], dict[str, DataFrame]], anchors: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New document versions as a stream; a replayed batch overwrites its own partition of every table."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(name: str, rows: DataFrame) -> DataFrame:
            path = f"{out}/{name}"
            rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
                "compression", "zstd").partitionBy("batch").parquet(path)
            return spark.read.schema(t.StructType([*rows.schema.fields, t.StructField("batch", t.IntegerType())])).parquet(path).filter(F.col("batch") == batch_id).drop("batch")

        with shuffles_dropped(batch.sparkSession):  # every stage is read from the table it wrote
            process_documents(prepare(batch), to_pages, draft, anchors, put)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrival_counts(stream: DataFrame, ts: str, by: Sequence[str], window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows per window of event time and `by`, given out once the watermark has passed the window's end."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), *by, "n")


def latest_outputs(spark: SparkSession, out: str, name: str, key: list[str]) -> DataFrame:
    """Rows of the newest batch per slice, for versions that were sent again."""
    rows = spark.read.parquet(f"{out}/{name}")
    newest = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*key, "batch"], "left_semi").drop("batch")
