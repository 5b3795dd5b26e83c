"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+`` and of ``bytes.split()``.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Arrow batches that go to Python workers; at Spark's own 64 MB, batches of long texts fill an executor, and at 8 MB the
#: executor and each of its workers still hold some times that.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to understand. The session's Arrow batches are kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a fresh temporary folder is made
    and set if all runs on one machine, as in tests; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="relata-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Paths that the running scope has made, by scope; what has none stays until the process ends.
_made: dict[str, list[str]] = {}
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """What is written inside stays until the next scope of this name, which deletes it, begins.

    For a row of steps of which each one's result is written before the next one starts.
    """
    for path in _made.pop(name, []):
        delete(spark, path)
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def _fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go away when the session's process ends."""
    path = f"{shared_dir(spark)}/relata-{name}-{uuid.uuid4().hex}"
    if _scope.get():
        _made.setdefault(_scope.get(), []).append(path)

    def clean() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session is gone already; the shared folder has its own retention
            return

    atexit.register(clean)
    return path


def written(df: DataFrame, name: str, sort: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back; this cuts lineage and survives lost executors."""
    path = _fresh(df.sparkSession, name)
    (df.sortWithinPartitions(sort) if sort else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.relata_path = path
    return out


def appended(df: DataFrame, to: DataFrame | None) -> DataFrame:
    """The rows of a table that this function gave before and those of df, which are all that is written."""
    path = to.relata_path if to is not None else _fresh(df.sparkSession, "rows")
    df.write.mode("append").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.relata_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that written() gave and that nothing reads any more."""
    for df in tables:
        if df is not None:
            delete(df.sparkSession, df.relata_path)


def numbered(rows: DataFrame, by: list, n: int, name: str = "number_", per_range: int = 100_000) -> DataFrame:
    """rows, n of them, numbered from 0 in an order. Each task numbers a range of the order; no task gets all."""
    dealt = rows.repartitionByRange(n // per_range + 1, *by).withColumn("range_", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    count = dict(dealt.groupBy("range_").count().collect())  # a row for each range
    start, total = {}, 0
    for r in sorted(count):
        start[r], total = total, total + count[r]
    base = F.element_at(F.create_map(*(F.lit(x) for r, s in start.items() for x in (r, s))), F.col("range_")) if start else F.lit(0)
    return dealt.withColumn(name, (F.row_number().over(Window.partitionBy("range_").orderBy(*by)) - 1 + base).cast("long")).drop("range_")


def at_rest() -> None:
    """Gives memory that a Python worker no longer uses back to the system; Spark keeps idle workers for a minute."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def over_batches(kind, several: bool = False):
    """An Arrow function, of one array or of several, that leaves no unused memory in the worker behind."""

    def wrap(f):
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            try:
                yield from map(f, batches)
            finally:
                at_rest()

        def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            try:
                yield from (f(*x) for x in batches)
            finally:
                at_rest()

        return arrow_udf(more if several else one, kind)

    return wrap


def unused(name: str, columns: list[str]) -> str:
    """A name like the given one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def binary(column: str):
    """A text column's UTF-8 bytes, for Arrow functions that need no decoding."""
    return F.col(column).cast("binary")


def values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and row offsets of a (large) binary or string array, without copies; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def n_words(array: pa.Array) -> np.ndarray:
    """Number of ``[^\x20\x09-\x0D]+`` in each row of a binary or string array."""
    data, at = values(array)
    if not len(array):
        return np.zeros(0, np.int64)
    first, data = at[0], data[at[0] : at[-1]]
    ink = ~WHITE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    rows = at[:-1] - first
    full = rows[(at[1:] > at[:-1])]
    begins[full] = ink[full]  # a row's first byte begins a word whatever the row before ended with
    total = np.concatenate([[0], np.cumsum(begins)])
    return (total[at[1:] - first] - total[rows]).astype(np.int64)


#: A node with more edges than this, and more than a HUB_SHARE of all, is a hub; there are at most 2 * HUB_SHARE of them.
HUB_EDGES, HUB_SHARE = 4096, 1000


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for each node that has an edge.

    Alternating large-star and small-star steps until nothing changes; each step joins and groups by node, and is
    written to the shared folder. The number of rounds grows with the logarithm of the longest chain; nothing but
    counts reaches the driver. Hubs get their least neighbour by broadcast, so that no task gets a hub's edges;
    no more than 2 * HUB_SHARE nodes can be hubs.
    """

    def state(df: DataFrame) -> tuple:
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def given(both: DataFrame, least: DataFrame, hub: int) -> DataFrame:
        """both with m, the least neighbour of a."""
        few = F.broadcast(least.where(F.col("n") > hub).select(F.col("a").alias("hub_"), F.col("m").alias("hub_m")))
        marked = both.join(few, F.col("a") == F.col("hub_"), "left")
        rest = marked.where("hub_ IS NULL").select("a", "b").join(least.where(F.col("n") <= hub).select("a", "m"), "a")
        return rest.select("a", "b", "m").unionByName(marked.where("hub_ IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")))

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = state(now)
    while seen[0]:
        hub = max(HUB_EDGES, seen[0] // HUB_SHARE)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = written(given(both, least, hub).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = given(large, least, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, now = now, written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        forget(old, large)
        before, seen = seen, state(now)
        if seen == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
