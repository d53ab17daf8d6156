"""Session settings and the two cluster-safety helpers every operator shares."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count that is ever broadcast or gathered by a bounded step.
BROADCAST_ROWS = 200_000

# Bytes of stored input that one task of CPU-heavy work gets at most, on average.
SPREAD_BYTES = 4 * 1024 * 1024

# Sizes from here on are not known to Spark.
_UNKNOWN_BYTES = 1 << 60


def build_session(master: str | None = None, app: str = "textloom", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides anything."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder.

    Row numbering needs the same rows in the same partitions each time they are read; a reliable
    checkpoint gives that and survives lost executors.
    """
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` has at most ``max_rows`` rows; else leave the join to Spark.

    The check reads at most ``max_rows + 1`` rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input by ``keys`` before CPU-heavy, row-local work: over all cores twice, and so that no task gets more than about ``SPREAD_BYTES``.

    A scan has no more tasks than its files have row groups, and a task of 128 MB of text takes many minutes. The size is that of the stored
    tables below; an input whose size Spark does not know is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= _UNKNOWN_BYTES:
        return df
    return df.repartition(max(2 * cores, -(-size // SPREAD_BYTES)), *keys)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="textloom-")) / package.name), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context._textloom_shipped = True
