"""Column statistics, z-scores, vocabulary and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.sources.database import numbered
from relata.sources.schema import BOOLEAN, DATETIME, NUMBER, TEXT
from relata.storage import cut

FLOOR = 1e-8


def present(cells: DataFrame) -> DataFrame:
    """Cells with a value: neither null nor NaN."""
    return cells.where(F.col("txt").isNotNull() | (F.col("num").isNotNull() & ~F.isnan("num")))


def _std(c: str):
    return F.when(F.count(c) > 1, F.greatest(F.stddev_samp(c), F.lit(FLOOR))).otherwise(1.0)


def column_stats(cells: DataFrame) -> DataFrame:
    """(column_idx, n, mean, std) of number and boolean columns; without values 0 and 1."""
    num = F.when(~F.isnan("num"), F.col("num"))
    rows = cells.where(F.col("semantic_type").isin(NUMBER, BOOLEAN)).select("column_idx", num.alias("num"))
    return rows.groupBy("column_idx").agg(F.count("num").alias("n"), F.coalesce(F.avg("num"), F.lit(0.0)).alias("mean"), _std("num").alias("std"))


def datetime_stats(cells: DataFrame) -> DataFrame:
    """One row: n, mean, std, least and most over all date and time cells together."""
    rows = cells.where(F.col("semantic_type") == DATETIME)
    return rows.agg(F.count("num").alias("n"), F.coalesce(F.avg("num"), F.lit(0.0)).alias("mean"), _std("num").alias("std"), F.min("num").alias("least"), F.max("num").alias("most"))


def normalised(cells: DataFrame, stats: DataFrame, times: DataFrame) -> DataFrame:
    """cells with norm: z-scores by column, date and time by the pooled figures, null for text.

    stats has one row a column and times one row in all, both bounded by the schema; they are joined by broadcast.
    """
    pooled = times.select(F.lit(DATETIME).alias("semantic_type"), F.col("mean").alias("t_mean"), F.col("std").alias("t_std"))
    out = cells.join(F.broadcast(stats.select("column_idx", "mean", "std")), "column_idx", "left").join(F.broadcast(pooled), "semantic_type", "left")
    return out.withColumn("norm", (F.col("num") - F.coalesce("t_mean", "mean")) / F.coalesce("t_std", "std")).drop("mean", "std", "t_mean", "t_std")


def vocabulary(cells: DataFrame) -> DataFrame:
    """(text_id, txt): distinct texts, numbered in their order from 0, range by range beyond a million."""
    texts = cut(cells.where((F.col("semantic_type") == TEXT) & F.col("txt").isNotNull()).select("txt").distinct())
    return numbered(texts, ("txt",), texts.count()).select(F.col("row_gid").alias("text_id"), "txt")


def most_neighbours(tok: DataFrame, f2p: DataFrame) -> DataFrame:
    """(seq_id, most): the most parents of a row that are in the row's own sequence, 1 at least."""
    rows = tok.select("seq_id", "row_gid").distinct()
    up = rows.join(f2p.select(F.col("from_gid").alias("row_gid"), F.explode(F.array_distinct("f2p")).alias("parent")), "row_gid")
    inside = up.join(rows.withColumnRenamed("row_gid", "parent"), ["seq_id", "parent"]).groupBy("seq_id", "row_gid").agg(F.count("*").alias("n"))
    return rows.select("seq_id").distinct().join(inside.groupBy("seq_id").agg(F.max("n").alias("n")), "seq_id", "left").select("seq_id", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("most"))


def degrees(edges: DataFrame, side: str) -> DataFrame:
    """(n_edges, most, n_rows) of one side, ``from_gid`` or ``to_gid``."""
    return edges.groupBy(side).count().agg(F.sum("count").alias("n_edges"), F.max("count").alias("most"), F.count("*").alias("n_rows"))


def parents(edges: DataFrame, most: int = 5) -> DataFrame:
    """(from_gid, f2p): each row's first parents in the order of the foreign key columns."""
    pairs = edges.groupBy("from_gid").agg(F.sort_array(F.collect_list(F.struct("from_col", "to_gid"))).alias("p"))
    return pairs.select("from_gid", F.slice(F.transform("p", lambda x: x["to_gid"]), 1, most).alias("f2p"))


def throughput(timings: DataFrame, seconds: str, items: str) -> DataFrame:
    """One row over timed steps: n, total, mean, least and most seconds, items, and items per second."""
    return timings.agg(F.count(seconds).alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.sum(items).alias("items"), F.try_divide(F.sum(items).cast("double"), F.sum(seconds)).alias("rate"))
