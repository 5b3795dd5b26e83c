"""Cutting lineage so that executors may be lost."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Compressed bytes up to which Spark may broadcast a table as it likes; rows take many times as much of the driver's memory.
PLAIN_BYTES = 256 << 10


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where none is and all runs on one machine."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not jsc.isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="relata-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, written once and read back; unlike a checkpoint it is computed only once.

    The files go away when the session's process ends. Shuffles that the table needed go at once: Spark deletes theirs
    when the driver collects its garbage, which a driver with memory to spare puts off. A table beyond PLAIN_BYTES is
    joined by sorting: its files, by which Spark would judge, tell nothing of its size in the driver's memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def clean() -> None:
        try:
            fs.delete(at, True)
        except Exception:  # the session is gone already; the shared folder has its own retention
            return

    atexit.register(clean)
    out = spark.read.schema(df.schema).parquet(path)
    return out if fs.getContentSummary(at).getLength() <= PLAIN_BYTES else out.hint("merge")
