"""Made-up inputs for trying things out: random sequences of cells and random phrases, a function of the seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of made-up phrases.
ADJECTIVES = "old new small large quick slow bright dark early late".split()
NOUNS = "river table engine garden letter window market teacher station winter".split()
VERBS = "holds follows opens carries finds leaves meets paints counts keeps".split()


def _draw(seed: int, what: str, *parts: str) -> Column:
    """A number from 0 to 2 ** 31 - 1 by seed, purpose and columns; every engine's crc32 gives the same."""
    return F.crc32(F.concat_ws(":", F.lit(seed), F.lit(what), *(F.col(p).cast("string") for p in parts)).cast("binary")) % (1 << 31)


def sequences(spark: SparkSession, n: int, seq_len: int = 1024, tables: int = 5, columns: int = 100, cells_a_row: int = 10, masked: float = 0.15, task_share: float = 0.1, seed: int = 42, pool: int | None = None) -> DataFrame:
    """n sequences of cells: seq_id, pos, row_gid, table_idx, column_idx, semantic_type, num, is_target, is_task_node, is_padding, f2p.

    About cells_a_row cells share a row, a row has up to five earlier rows as parents, the first task_share of the
    rows are task rows, and ``masked`` of the cells that are no text are targets. With a pool only so many different
    sequences are drawn, again and again.
    """
    rows = spark.range(n).withColumnRenamed("id", "seq_id").withColumn("of_", F.pmod("seq_id", F.lit(pool)) if pool else F.col("seq_id"))
    rows = rows.withColumn("length_", (F.lit(seq_len // 2) + _draw(seed, "length", "of_") % (seq_len - seq_len // 2 + 1)).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(seq_len - 1))).alias("pos"))
    rows = rows.withColumns({"row_gid": F.floor(F.col("pos") / cells_a_row).cast("long"), "is_padding": F.col("pos") >= F.col("length_")})
    last = F.floor((F.col("length_") - 1) / cells_a_row)
    rows = rows.withColumns({"table_idx": _draw(seed, "table", "of_", "row_gid") % tables, "column_idx": _draw(seed, "column", "of_", "pos") % columns})
    rows = rows.withColumns({"semantic_type": (_draw(seed, "type", "column_idx") % 4).cast("int"), "num": _draw(seed, "value", "of_", "pos") / float(1 << 30) - 1.0, "is_task_node": F.col("row_gid") < F.greatest(F.lit(1), F.ceil(last * task_share))})
    rows = rows.withColumn("is_target", (F.col("semantic_type") != 1) & ~F.col("is_padding") & (_draw(seed, "mask", "of_", "pos") < masked * (1 << 31)))
    parents = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(F.col("row_gid") > i, F.pmod(_draw(seed, "parent", "of_", "row_gid") + i * 7919, F.col("row_gid")).cast("long")).otherwise(F.lit(-1).cast("long")))
    return rows.withColumn("f2p", parents).drop("of_", "length_")


def phrases(spark: SparkSession, n: int, words: int = 5, seed: int = 42) -> DataFrame:
    """(id, txt): phrases of so many words by the pattern adjective, noun, verb."""
    pick = lambda kind, i: F.get(F.split(F.lit(" ".join(kind)), " "), (F.pmod(_draw(seed, "word", "id") + i * 7919 + F.col("id") * i, F.lit(len(kind)))).cast("int"))
    parts = [pick((ADJECTIVES, NOUNS, VERBS)[i % 3], F.lit(i)) for i in range(words)]
    return spark.range(n).select("id", F.concat_ws(" ", *parts).alias("txt"))
