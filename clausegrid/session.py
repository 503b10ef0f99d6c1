"""Session set-up shared by the entry points, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's own setting: the shuffle files of a run are deleted when it ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "clausegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution left on.

    The shuffle partition count is only a starting point: AQE coalesces small
    partitions and splits skewed ones, so on a cluster set it high (a few per core).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only where the setting is absent (local tests) a temporary folder is used; on a
    cluster the setting must name storage that every executor can reach.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="clausegrid-checkpoint-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives the loss of executors."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Runs within delete their shuffle files when they end, for steps whose result is written and read again."""
    before = spark.conf.get(CLEANUP_CONF)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def written(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the shared checkpoint folder, read again: later steps survive the loss of executors, and what was
    shuffled to make it goes as soon as it is written."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unwrite(*tables: DataFrame) -> None:
    """Delete the files of tables made by `written` that no later step reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("table-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
