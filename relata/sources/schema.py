"""Relational schemas: tables, keys, time columns and semantic types."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Codes of the semantic types.
NUMBER, TEXT, DATETIME, BOOLEAN = 0, 1, 2, 3


def semantic_type(kind: T.DataType) -> int | None:
    """Code of a column type; None for nested and binary types, which are no cells."""
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.StringType):
        return TEXT
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return DATETIME
    return NUMBER if isinstance(kind, T.NumericType) else None


@dataclass(frozen=True)
class TableSpec:
    """One table: its key, foreign keys (column to table), time column, row order and kind (db, train, val, test)."""

    name: str
    pk: str | None = None
    fks: dict[str, str] = field(default_factory=dict)
    time: str | None = None
    order: tuple[str, ...] = ()
    kind: str = "db"
    booleans: tuple[str, ...] = ()

    @property
    def row_order(self) -> tuple[str, ...]:
        return self.order or ((self.pk,) if self.pk else ())


def from_footer(spark: SparkSession, name: str, path: str, kind: str = "db") -> TableSpec:
    """The table's spec from JSON under fixed keys of a parquet footer; what isn't valid JSON is ignored.

    The footer is read by Spark's own Parquet library, from any store that it reaches.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        found = dict(reader.getFooter().getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()

    def value(key: str):
        try:
            return json.loads(found[key])
        except (KeyError, ValueError):
            return None

    fks = value("fkey_col_to_pkey_table")
    return TableSpec(name, value("pkey_col"), fks if isinstance(fks, dict) else {}, value("time_col"), kind=kind)


#: The provided tables. Core tables come first, in order of their names, then task tables.
FIXTURE = (
    TableSpec("customer", "c_custkey", {"c_nationkey": "nation"}),
    TableSpec("documents", "doc_id"),
    TableSpec("events", "event_id", {"user_id": "customer"}, "ts"),
    TableSpec("lineitem", None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")),
    TableSpec("nation", "n_nationkey", {"n_regionkey": "region"}),
    TableSpec("orders", "o_orderkey", {"o_custkey": "customer"}, "o_orderdate"),
    TableSpec("part", "p_partkey"),
    TableSpec("region", "r_regionkey"),
    TableSpec("supplier", "s_suppkey", {"s_nationkey": "nation"}),
    TableSpec("labels", None, {"doc_id": "documents"}, None, ("doc_id",), "train", ("quality", "toxic")),
)
