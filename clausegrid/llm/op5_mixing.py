"""Mixing sources to target weights by weighted fair queueing.

Each source owns a queue of its documents in a fixed random order, passed through up to three times. Every copy in a queue has a virtual finish
time: the number of its source's words up to its end, divided by the source's target, so that all sources reach their
targets at time 1. All copies are range-sorted by finish time, their words are summed in that order, and the mix ends where the sum
reaches the budget, the words of all documents, inside a copy where the budget ends there. Amounts differ from the targets by the
copies that are open at that moment, at most one per source.

Cases: a null text has size 0; a document without words is never taken; a null source is a source of its own, last in order; null ids
are kept; repeated rows are separate entries of the queue; very long texts count as one entry; an empty table, or one without words, gives rows with
nothing taken; other columns are ignored by `report` and kept by `choose`, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import WORD, keep, positions

REPEATS = 3
BROADCAST_IDS = 2_000_000


def sizes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, source, size of every row, and its `key` if given."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return docs.select("doc_id", "source", size, (F.col(key) if key else F.lit(0)).cast("long").alias("key"))


def targets(rows: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """One row per source: rank (0, 1, ...), weight (1, 2, 3, repeating), source_size, target, and where its queue begins.

    Targets share all words by weight; one above `repeats` times its source's size is held there, and what it leaves is
    shared again. Each round of that is one aggregate over the sources; only two sums come to the driver."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(by_source, [F.col("source").asc_nulls_last()], ["source_size"], "mix-sources")
    ranked = keep(ranked.select(
        "source", "source_size", F.col("_row").alias("rank"), (F.col("_row") % 3 + 1).alias("weight"),
        F.col("_before_source_size").alias("queue_start")), "mix-ranked")
    cap = repeats * F.col("source_size")
    level = None
    while True:  # the level only rises, so each round holds at least one source more
        held = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        got = ranked.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(held, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0)).alias("weights")).first()
        if not got["weights"]:
            break
        above = (got["all"] - got["held"]) / got["weights"]
        if above == level:
            break
        level = above
    share = F.lit(0.0 if level is None else level) * F.col("weight")
    return ranked.withColumn("target", F.when(cap < share, cap.cast("double")).otherwise(share))


def queue(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Every row with the place of its first copy in its source's queue (`start`) and its source's figures, as a written table.

    The queues lie one behind the other in one global prefix sum, so a source of any size spreads over many ranges."""
    on = rows.source.eqNullSafe(by_source.source)
    ranked = rows.join(by_source, on).select(
        "key", "doc_id", "size", by_source.source, "rank", "source_size", "target", "queue_start",
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffled"))
    placed = positions(ranked, ["rank", "shuffled", "doc_id", "size", "key"], ["size"], "mix-queue")
    return keep(placed.select("key", "doc_id", "source", "rank", "size", "source_size", "target",
                              (F.col("_before_size") - F.col("queue_start")).alias("start")), "mix-places")


def _finish(copy: int | Column) -> Column:
    """Virtual finish time of a row's copy 0, 1, ..."""
    return (F.lit(copy) * F.col("source_size") + F.col("start") + F.col("size")).cast("double") / F.col("target")


def schedule(placed: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """All copies in the order of virtual finish time: key, doc_id, source, copy, rank, start, words, finish, and position (words before it)."""
    copies = placed.where("size > 0 AND target > 0").withColumn("copy", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    copies = copies.select("key", "doc_id", "source", "copy", "rank", "start", F.col("size").alias("words"), _finish(F.col("copy")).alias("finish"))
    return positions(copies, ["finish", "rank", "copy", "start"], ["words"], "mix-order").select(*copies.columns, F.col("_before_words").alias("position"))


def taken(placed: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """`placed` with `whole` (copies before the end of the mix) and `part` (words of the copy in which it ends).

    The end is one row of the sorted copies, where the sum of words reaches the budget; only that row comes to the driver."""
    budget = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    end = schedule(placed, repeats).where((F.col("position") < budget) & (F.col("position") + F.col("words") >= budget)).first()
    whole, part = F.lit(0), F.lit(0)
    if end is not None:  # there are words
        place = F.struct(F.lit(end["finish"]), F.lit(end["rank"]).cast("long"), F.lit(end["copy"]).cast("int"), F.lit(end["start"]).cast("long"))
        counts = (F.col("size") > 0) & (F.col("target") > 0)
        for r in range(repeats):
            here = F.struct(_finish(r), F.col("rank").cast("long"), F.lit(r).cast("int"), F.col("start").cast("long"))
            whole = whole + F.when(counts, (here < place).cast("int")).otherwise(0)
            part = part + F.when(counts & (here == place), F.lit(budget - end["position"])).otherwise(0)
    return placed.select(*placed.columns, whole.alias("whole"), part.cast("long").alias("part"))


def mix(docs: DataFrame, repeats: int = REPEATS, key: str | None = None) -> DataFrame:
    """key, doc_id, source, rank, size, source_size, target, start, whole, part of every row."""
    rows = sizes(docs, key)
    return taken(queue(rows, targets(rows, repeats)), repeats)


def report(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Per document: size, source_size, target of its source, and taken: the words that the mix takes, repeats counted."""
    return mix(docs, repeats).select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def choose(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The documents of the mix as rows with the columns of `docs`: each as often as the mix takes it whole, the copy in which the mix ends
    included when more than half of it is inside. Documents without words go: the mix takes nothing of them.

    The rows are numbered in a written copy of `docs`, so rows of one id stay apart."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    numbered = keep(docs.withColumn(key, F.monotonically_increasing_id()), "mix-docs")
    copies = F.col("whole") + (2 * F.col("part") > F.col("size")).cast("int")
    picks = mix(numbered, repeats, key).select(F.col("key").alias(key), copies.alias(key + "copies")).where(F.col(key + "copies") > 0)
    picks = keep(picks, "mix-picks")
    few = picks.count() <= BROADCAST_IDS  # two numbers a row; beyond that the rows meet in a shuffle
    out = numbered.join(F.broadcast(picks) if few else picks, key).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(key + "copies"))).alias(key))
    return out.drop(key)


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM by_source),
weighted AS (
  SELECT *, (rank % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM ranked),
steps AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS weights
  FROM weighted WINDOW before AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(rest::DOUBLE / weights, cap::DOUBLE / weight) AS level FROM steps WHERE cap >= rest::DOUBLE / weights * weight),
targets AS (
  SELECT *, CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE level * weight END AS target FROM weighted, level),
queued AS (
  SELECT row_number() OVER () AS key, d.doc_id, d.size, t.rank, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (copy * source_size + start + size)::DOUBLE / target AS finish FROM queued, (VALUES (0), (1), (2)) c(copy) WHERE size > 0),
timed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, rank, copy, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM copies),
picked AS (
  SELECT key, sum(greatest(0, least(size, (SELECT sum(size) FROM sized) - position))) AS taken FROM timed GROUP BY key)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN picked USING (key)
"""
