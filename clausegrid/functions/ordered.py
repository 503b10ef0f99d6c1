"""Ordered computations per key that stay spread out when one key is huge.

A plain window over a key puts all rows of that key into one task. Here each key is cut into ranges of its own order: a sample of its
rows, chosen by their hash, gives the bounds, so a key with many rows in one day, or one instant, is cut as well as one that
spreads over years. Every range is summarised first (a grouped aggregate with map-side combine), the short table of summaries is
scanned in order, and only then a window runs inside each (key, range). Results equal those of the plain window, wherever the bounds fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_B = "__block"
#: One row in so many is a bound, so a range holds about as many rows.
SAMPLE = 65_536


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = _B) -> DataFrame:
    """`df` with the range of every row within its key, in the order of the given columns (ascending, nulls first).

    A key's bounds are one row in `SAMPLE`: some thousands for a key of a billion rows, none for most keys, whose rows are one range."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    placed = df.withColumn("__place", place)
    bounds = placed.filter(F.pmod(F.xxhash64("__place", *keys), F.lit(SAMPLE)) == 0).groupBy(*keys).agg(
        F.array_sort(F.collect_set("__place")).alias("__bounds"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).when(
            F.get("__bounds", mid) <= F.col("__place"), F.struct((mid + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), mid.alias("high")))

    steps = F.sequence(F.lit(0), F.length(F.bin(F.size("__bounds"))))
    below = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size("__bounds").alias("high")), halve)["low"]
    # so few bounds go to all tasks: a join by the key would move every row to the task of its key only to cut it
    return placed.join(F.broadcast(bounds), list(keys), "left").withColumn(
        out, F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(below)).drop("__place", "__bounds")


def down(column: Column | str) -> Column:
    """A timestamp for an order from the newest on, as an ascending value; nulls last."""
    c = F.col(column) if isinstance(column, str) else column
    return F.struct(c.isNull().alias("none"), (-F.unix_micros(c.cast("timestamp"))).alias("back"))


def stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name that is safe to group afterwards.

    Spark 4.1 reports a union of equally partitioned inputs as partitioned, although
    adaptive execution may coalesce the inputs differently; groups then come out split.
    The setting is switched off for the session before such a union is planned.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in others:
        first = first.unionByName(other)
    return first


def _order(order_by: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order_by]


def running_total(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: Column, out: str,
) -> DataFrame:
    """Sum of `value` over all earlier rows of the key (the row itself not included)."""
    rows = blocked(df, keys, [F.col(c) for c in order_by]).withColumn("__v", value)
    sums = rows.groupBy(*keys, _B).agg(F.sum("__v").alias("__s"))
    scan = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, _B, F.coalesce(F.sum("__s").over(scan), F.lit(0)).alias("__before"))
    inner = W.partitionBy(*keys, _B).orderBy(*_order(order_by)).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(before, [*keys, _B])
        .withColumn(out, F.col("__before") + F.coalesce(F.sum("__v").over(inner), F.lit(0)))
        .drop(_B, "__v", "__before")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str, start: int = 1,
) -> DataFrame:
    """Row number per key in order."""
    ranked = running_total(df, keys, order_by, F.lit(1), "__n")
    return ranked.withColumn(out, (F.col("__n") + start).cast("long")).drop("__n")


def previous(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Columns of the preceding row of the key; null on its first row."""
    value = F.struct(*columns)
    rows = blocked(df, keys, [F.col(c) for c in order_by])
    ends = rows.groupBy(*keys, _B).agg(F.max_by(value, F.struct(*order_by)).alias("__last"))
    carry = ends.select(*keys, _B, F.lag("__last").over(W.partitionBy(*keys).orderBy(_B)).alias("__carry"))
    inner = W.partitionBy(*keys, _B).orderBy(*_order(order_by))
    joined = rows.join(carry, [*keys, _B]).withColumn("__p", F.coalesce(F.lag(value).over(inner), F.col("__carry")))
    named = {f"{prefix}{c}": F.col(f"__p.{c}") for c in columns}
    return joined.withColumns(named).drop(_B, "__carry", "__p")


def following(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str],
    prefix: str = "next_",
) -> DataFrame:
    """Columns of the next row of the key; null on its last row."""
    value = F.struct(*columns)
    rows = blocked(df, keys, [F.col(c) for c in order_by])
    starts = rows.groupBy(*keys, _B).agg(F.min_by(value, F.struct(*order_by)).alias("__first"))
    carry = starts.select(*keys, _B, F.lead("__first").over(W.partitionBy(*keys).orderBy(_B)).alias("__carry"))
    inner = W.partitionBy(*keys, _B).orderBy(*_order(order_by))
    joined = rows.join(carry, [*keys, _B]).withColumn("__p", F.coalesce(F.lead(value).over(inner), F.col("__carry")))
    named = {f"{prefix}{c}": F.col(f"__p.{c}") for c in columns}
    return joined.withColumns(named).drop(_B, "__carry", "__p")


def last_known_before(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], column: str, out: str,
) -> DataFrame:
    """Latest non-null value of `column` among earlier rows of the key."""
    rows = blocked(df, keys, [F.col(c) for c in order_by])
    ends = rows.groupBy(*keys, _B).agg(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order_by))).alias("__last"))
    scan = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*keys, _B, F.last("__last", ignorenulls=True).over(scan).alias("__carry"))
    inner = W.partitionBy(*keys, _B).orderBy(*_order(order_by)).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(carry, [*keys, _B])
        .withColumn(out, F.coalesce(F.last(column, ignorenulls=True).over(inner), F.col("__carry")))
        .drop(_B, "__carry")
    )


def latest(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row with the greatest order per key, by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    if any(kind in df.select(*rest).schema.simpleString() for kind in ("map<", "variant")):  # no order
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("__r"))
    else:  # the order comes first in the row, so that it moves once
        picked = df.groupBy(*keys).agg(F.max(F.struct(*order_by, *[c for c in rest if c not in order_by])).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}") for c in rest])


def earliest(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("__r"))
    return picked.select(*keys, "__r.*")


def top_n(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int | None, rank: str = "rank",
          split: Sequence[Column] | None = None) -> DataFrame:
    """First n rows per key, with their rank: the planner limits each partition before the shuffle, so a large key sends at most n rows
    per task. All rows if n is None; `split` then names ascending columns that the order begins with, by which a large key is cut into
    ranges that are ranked apart (rows that tie in them stay together)."""
    if n is not None or split is None:
        ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order_by)))
        return ranked if n is None else ranked.filter(F.col(rank) <= n)
    rows = blocked(df, keys, split)
    scan = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*keys, _B).agg(F.count("*").alias("__c")).select(*keys, _B, F.coalesce(F.sum("__c").over(scan), F.lit(0)).alias("__before"))
    inner = F.row_number().over(W.partitionBy(*keys, _B).orderBy(*order_by))
    return rows.join(before, [*keys, _B]).withColumn(rank, (F.col("__before") + inner).cast("int")).drop(_B, "__before")
