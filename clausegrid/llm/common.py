"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clausegrid.session import checkpoint_root

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (`spark.checkpoint.dir`)."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: later steps survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by `keep` that no later step reads."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/llm-{df.sparkSession.sparkContext.applicationId}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering the session's Arrow batches to TEXT_ROWS rows: batches of whole texts are held several times at once, on both
    sides of a Python worker, and workers and executors keep the memory. Results don't depend on it."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= TEXT_ROWS:
        spark.conf.set(_BATCH_CONF, str(TEXT_ROWS))
    return df


def release_memory() -> None:
    """Give back what Arrow keeps for later: the worker goes on to other tasks and stages."""
    pa.default_memory_pool().release_unused()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its texts in them, from 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(max(int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1, first + 1), n)
        yield first, last
        first = last


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _local_sums(amounts: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, sums = TaskContext.get().partitionId(), 0, [0] * len(amounts)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols, names = list(b.columns), list(b.schema.names)
            cols += [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(row, row + n, dtype=np.int64))]
            names += ["_part", "_row"]
            for k, a in enumerate(amounts):
                v = b.column(names.index(a)).to_numpy(zero_copy_only=False).astype(np.int64)
                c = np.cumsum(v)
                cols.append(pa.array(c - v + sums[k]))
                names.append(f"_before_{a}")
                sums[k] += int(c[-1])
            row += n
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def with_part_sums(df: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """First pass of prefix sums: `_part`, `_row` and `_before_<amount>` within each partition, in its present row order."""
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.LongType()) for c in ["_part", "_row", *(f"_before_{a}" for a in amounts)]])
    return df.mapInArrow(_local_sums(amounts), schema)


def with_global_sums(local: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """Second pass: the totals of the partitions, one row each, become offsets that are added to the local sums.

    `local` must be a written table, so that both uses see the same partitions."""
    totals = local.groupBy("_part").agg(
        F.count("*").alias("_t_row"), *[F.sum(a).alias(f"_t_{a}") for a in amounts])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{a}").over(before), F.lit(0)).alias(f"_o_{a}") for a in ["row", *amounts]])
    out = local.join(F.broadcast(offsets), "_part")  # as many rows as partitions
    out = out.withColumn("_row", F.col("_row") + F.col("_o_row"))
    for a in amounts:
        out = out.withColumn(f"_before_{a}", F.col(f"_before_{a}") + F.col(f"_o_{a}"))
    return out.drop("_part", "_o_row", *[f"_o_{a}" for a in amounts])


def positions(df: DataFrame, order: Sequence, amounts: Sequence[str], label: str) -> DataFrame:
    """`df` with `_row` (gapless from 0) and exclusive prefix sums `_before_<amount>` in the global order `order`.

    Range partitions are sorted and summed one by one, their totals give the offsets: no task sees more than its range."""
    ranged = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    return with_global_sums(keep(with_part_sums(ranged, amounts), label), amounts)
