"""What the operators share on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import scratch_folder, ship_package

# Bytes of rows that a Python worker gets at once, about: Spark's own limit counts rows, and 10,000 texts or a few packed chunks are many MB, held
# by the executor and the worker at the same time.
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_texts(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """Only the key, the text and ``more``, under fixed names, so that no other column can clash with internal ones.

    From here on the session's Arrow batches hold about ``BATCH_BYTES``, unless it has a limit of its own.
    """
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df.select(quoted(key).alias("key"), F.coalesce(quoted(text), F.lit("")).alias("text"), *[quoted(c).alias(f"more_{i}") for i, c in enumerate(more)])


def written(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """``df`` stored once in the shared folder and read back: later steps neither compute it again nor lose it.

    The shuffle files of the write go with it, not only when the driver happens to collect its garbage. With a whole number ``by``, the
    rows of each of its values lie in a folder of their own.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", compression)
        (writer.partitionBy(by) if by else writer).parquet(folder)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(folder).select(*df.columns)
    stored.scratch = folder
    return stored


def released(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has stored and that nothing reads any more."""
    for stored in tables:
        context = stored.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(stored.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
