"""A relational database as lazy DataFrames: rows with global ids, columns, edges, cells."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.storage import cut

from .schema import BOOLEAN, DATETIME, FIXTURE, NUMBER, TEXT, TableSpec, from_footer, semantic_type

#: Tables beyond this many rows are numbered range by range instead of by one window.
ONE_WINDOW_ROWS = 1_000_000


#: Tables up to this many rows are joined by broadcast where their number is known.
FEW_ROWS = 100_000
#: An ancestor in one number: its row times this, plus its hop.
HOPS = 256


#: What is known of files that have not changed since: schema and number of rows by (path, time, length).
_SCHEMAS: dict[tuple, T.StructType] = {}
_ROWS: dict[tuple, int] = {}


def stamp(spark: SparkSession, path: str) -> tuple:
    """Path, time of change and length; any of them differs once a file is replaced."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    return path, found.getModificationTime(), found.getLen()


def parquet(spark: SparkSession, mark: tuple) -> DataFrame:
    """The stamped file or folder; its schema is inferred once."""
    if mark not in _SCHEMAS:
        _SCHEMAS[mark] = spark.read.parquet(mark[0]).schema
    return spark.read.schema(_SCHEMAS[mark]).parquet(mark[0])


def discover(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """(path, name, kind) of root/db/*.parquet, then root/tasks/<task>/{train,val,test}.parquet; each sorted."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def glob(pattern: str) -> list[str]:
        return sorted(str(x.getPath().toString()) for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")) or [])

    stem = lambda p: p.rsplit("/", 1)[1].removesuffix(".parquet")
    return [(p, stem(p), "db") for p in glob("db/*.parquet")] + [(p, p.rsplit("/", 2)[1], stem(p)) for p in glob("tasks/*/*.parquet") if stem(p) in ("train", "val", "test")]


def _literal(row: tuple, kinds: list[T.DataType]) -> Column:
    return F.struct(*(F.lit(v).cast(k).alias(f"f{i}") for i, (v, k) in enumerate(zip(row, kinds, strict=True))))


def ranges(df: DataFrame, order: tuple[str, ...], pieces: int, rows: int) -> Column:
    """The number of the range, of about ``pieces``, that a row is in by all columns of the order together.

    Limits are taken from a sample of 64 rows a range, and found for each row by halving.
    """
    columns = [f"order_{i}" for i in range(len(order))]
    few = df.select(*(F.col(c).alias(n) for c, n in zip(order, columns, strict=True))).sample(min(1.0, 64 * pieces / max(1, rows)), 17).orderBy(*columns).collect()
    kinds = [df.schema[c].dataType for c in order]
    cuts = list(dict.fromkeys(tuple(few[i * len(few) // pieces]) for i in range(1, pieces))) if few else []
    if not cuts:
        return F.lit(0)
    limits, own = F.array(*(_literal(c, kinds) for c in cuts)), F.struct(*(F.col(c).cast(k).alias(f"f{i}") for i, (c, k) in enumerate(zip(order, kinds, strict=True))))
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halved(s: Column, _: Column) -> Column:
        above = F.get(limits, half(s)) <= own
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(above, half(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(half(s)).alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halved, lambda s: s["lo"])


def numbered(df: DataFrame, order: tuple[str, ...], rows: int, start: int = 0) -> DataFrame:
    """df with row_gid: start plus the row's number in the given order.

    Small tables use one window. Others are cut into ranges by all columns of the order, of whatever type; rows are
    numbered inside their range and ranges by their counts, so that no task sorts the whole table. Rows that are
    equal in all of these columns share a range.
    """
    if not order:
        order = tuple(c for c, k in df.dtypes if not k.startswith(("array", "map", "struct")))
    if rows <= ONE_WINDOW_ROWS:
        return df.withColumn("row_gid", (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long"))
    dealt = df.withColumn("piece_", ranges(df, order, rows // ONE_WINDOW_ROWS + 1, rows))
    base, total = {}, start
    for piece, n in sorted(dealt.groupBy("piece_").count().collect()):  # a row for each range
        base[piece], total = total, total + n
    first = F.get(F.array(*(F.lit(base.get(i, 0)) for i in range(max(base, default=0) + 1))), F.col("piece_"))
    number = F.row_number().over(Window.partitionBy("piece_").orderBy(*order)) - 1
    return dealt.withColumn("row_gid", (number + first).cast("long")).drop("piece_")


def epoch_seconds(c: str, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(c) * F.lit(86400.0)
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)


class RelDatabase:
    """Tables of a directory with their relational schema. Nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], specs: tuple[TableSpec, ...]) -> None:
        self.spark, self.frames, self.specs = spark, tables, specs
        self.root = ""
        self.marks: dict[str, tuple] = {}  # stamps of the tables' files, where known
        self.index = {s.name: i for i, s in enumerate(specs)}
        self.db_index = {s.name: i for i, s in enumerate(specs) if s.kind == "db"}

    @classmethod
    def fixture(cls, spark: SparkSession, sf_dir: str) -> RelDatabase:
        frames, marks = {}, {}
        for s in FIXTURE:
            marks[s.name] = stamp(spark, f"{sf_dir}/{s.name}.parquet")
            df = parquet(spark, marks[s.name])
            frames[s.name] = df.withColumns({c: F.col(c) == 1 for c in s.booleans}) if s.booleans else df
        db = cls(spark, frames, FIXTURE)
        db.root, db.marks = sf_dir, marks
        return db

    @classmethod
    def directory(cls, spark: SparkSession, root: str) -> RelDatabase:
        """A directory with db/ and tasks/; keys come from the files' footers."""
        frames, specs = {}, []
        for path, name, kind in discover(spark, root):
            spec = from_footer(spark, name, path, kind)
            key = name if kind == "db" else f"{name}/{kind}"
            specs.append(TableSpec(key, spec.pk, spec.fks, spec.time, kind=kind))
            frames[key] = spark.read.parquet(path)
        return cls(spark, frames, tuple(specs))

    def extra(self, name: str) -> DataFrame:
        """A table beside the schema."""
        return parquet(self.spark, stamp(self.spark, f"{self.root}/{name}.parquet"))

    def spec(self, name: str) -> TableSpec:
        return self.specs[self.index[name]]

    @cached_property
    def counts(self) -> dict[str, int]:
        """Rows of each table, in one job over parquet footers for those not counted before."""
        out = {s.name: _ROWS.get(self.marks.get(s.name)) for s in self.specs}
        union = None
        for name in (name for name, n in out.items() if n is None):
            one = self.frames[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
            union = one if union is None else union.unionByName(one)
        for name, n in union.collect() if union is not None else ():
            out[name] = n
            if name in self.marks:
                _ROWS[self.marks[name]] = n
        return out

    def start(self, name: str) -> int:
        return sum(self.counts[s.name] for s in self.specs[: self.index[name]])

    def rows(self, name: str) -> DataFrame:
        """The table with row_gid, pruned to what is used of it."""
        return numbered(self.frames[name], self.spec(name).row_order, self.counts[name], self.start(name))

    @cached_property
    def columns(self) -> list[dict]:
        """Catalog of cell columns with global numbers; a foreign key to an unknown table is none."""
        out = []
        for s in self.specs:
            for local, f in enumerate(self.frames[s.name].schema.fields):
                kind = semantic_type(f.dataType)
                target = s.fks.get(f.name)
                out.append({"table_idx": self.index[s.name], "table_name": s.name, "column_idx": len(out), "local_idx": local, "name": f.name, "semantic_type": kind, "dtype": f.dataType.simpleString(), "is_pk": f.name == s.pk, "is_time": f.name == s.time, "fk_table_idx": self.db_index.get(target, -1) if target else -1, "description": f"{f.name} of {s.name}"})
        return out

    def table_index(self, table: str) -> int:
        """The table's number, or -1."""
        return self.index.get(table, -1)

    def column_index(self, table: str, column: str) -> int:
        """The column's number among all columns, or -1."""
        return next((c["column_idx"] for c in self.columns if (c["table_name"], c["name"]) == (table, column)), -1)

    def catalog(self) -> DataFrame:
        return self.spark.createDataFrame(self.columns, "table_idx long, table_name string, column_idx long, local_idx long, name string, semantic_type int, dtype string, is_pk boolean, is_time boolean, fk_table_idx long, description string")

    def row_table(self, *names: str) -> DataFrame:
        """(row_gid, table_idx, is_task_row, pk, ts) of the named tables, or of all."""
        out = None
        for s in self.specs:
            if names and s.name not in names:
                continue
            ts = F.col(s.time).cast("timestamp_ntz") if s.time else F.lit(None).cast("timestamp_ntz")
            pk = F.col(s.pk).cast("string") if s.pk else F.lit(None).cast("string")
            one = self.rows(s.name).select("row_gid", F.lit(self.index[s.name]).cast("long").alias("table_idx"), F.lit(s.kind != "db").alias("is_task_row"), pk.alias("pk"), ts.alias("ts"))
            out = one if out is None else out.unionByName(one)
        return out

    def key_index(self, name: str) -> DataFrame:
        """(pk, row_gid) of a table: of rows with one key the last wins; null keys are left out."""
        pk = self.spec(name).pk
        return self.rows(name).where(F.col(pk).isNotNull()).groupBy(F.col(pk).alias("pk")).agg(F.max("row_gid").alias("row_gid"))

    def keys(self, name: str) -> list[tuple[str, str]]:
        """The table's foreign keys to tables that have a key: (column, target)."""
        return [(c, t) for c, t in self.spec(name).fks.items() if t in self.db_index and self.spec(t).pk]

    def above(self, name: str, *children: str, path: tuple[str, ...] = ()) -> DataFrame:
        """(row_gid, above[, pk]): each row of a table with all rows that it reaches over keys of the named tables, or of all.

        above has each ancestor once, at its least hop, as row_gid * HOPS + hop. Targets come first; a row gets what
        its parents reach in the joins that find them, so that it is shuffled once a key and not once an ancestor.
        Of rows with one key the last wins. Tables whose keys lead back to them raise ValueError; sample() takes those.
        """
        if name in path or len(path) >= HOPS - 1:
            raise ValueError(f"foreign keys of {name} lead back to it")
        pk, keys = self.spec(name).pk, self.keys(name) if not children or name in children else []
        own = [F.col(pk).alias("pk")] if pk else []
        if not keys:
            return self.rows(name).select("row_gid", F.array().cast("array<long>").alias("above"), *own)
        one = cut(self.rows(name).select("row_gid", *own, *(F.col(c).alias(f"key_{i}") for i, (c, _) in enumerate(keys))))
        for i, (_, target) in sorted(enumerate(keys), key=lambda x: self.counts[x[1][1]]):  # what is joined last is shuffled once only
            up = self.above(target, *children, path=(*path, name)).where("pk IS NOT NULL").groupBy(F.col("pk").alias(f"key_{i}")).agg(F.max("row_gid").alias("to_"), F.max_by("above", "row_gid").alias("reach_"))
            here = F.concat(F.array(F.col("to_") * HOPS + 1), F.transform("reach_", lambda x: x + 1)).alias(f"up_{i}")
            up = cut(up.select(f"key_{i}", here, F.lit(0).cast("long").alias("spread_")))
            up = F.broadcast(up) if self.counts[target] <= FEW_ROWS else up.hint("merge")
            one = one.withColumn("spread_", F.when(F.col(f"key_{i}").isNull(), F.col("row_gid")).otherwise(F.lit(0)))
            one = one.join(up, [f"key_{i}", "spread_"], "left").drop("spread_", f"key_{i}")
        every = F.sort_array(F.concat(*(F.coalesce(f"up_{i}", F.array().cast("array<long>")) for i in range(len(keys)))))
        first = lambda x, i: (i == 0) | (F.shiftright(F.get("above", i - 1), 8) != F.shiftright(x, 8))
        return one.select("row_gid", every.alias("above"), *(["pk"] if pk else [])).withColumn("above", F.filter("above", first))

    def edges(self, *children: str) -> DataFrame:
        """(from_gid, from_col, to_gid, from_table, to_table, from_ts, from_task): child to parent by foreign key.

        Null and dangling keys have no edge. from_col is the column's global number. A table's rows are numbered
        once for all its keys, each of which adds a left join; its edges are then taken out of the one row. Null keys
        are spread by the row's number, so that they don't meet in one task.
        """
        out = None
        for s in self.specs:
            keys = self.keys(s.name)
            if not keys or (children and s.name not in children):
                continue
            ts = F.col(s.time).cast("timestamp_ntz") if s.time else F.lit(None).cast("timestamp_ntz")
            one = self.rows(s.name).select(F.col("row_gid").alias("from_gid"), ts.alias("from_ts"), *(F.col(c).alias(f"key_{i}") for i, (c, _) in enumerate(keys)))
            ends = []
            for i, (column, target) in enumerate(keys):
                index = self.key_index(target).select(F.col("pk").alias(f"key_{i}"), F.col("row_gid").alias(f"to_{i}"), F.lit(0).cast("long").alias("spread_"))
                one = one.withColumn("spread_", F.when(F.col(f"key_{i}").isNull(), F.col("from_gid")).otherwise(F.lit(0)))
                one = one.join(index, [f"key_{i}", "spread_"], "left").drop("spread_")
                ends.append(F.struct(F.lit(self.column_index(s.name, column)).cast("long").alias("from_col"), F.col(f"to_{i}").alias("to_gid"), F.lit(self.index[target]).cast("long").alias("to_table")))
            one = one.select("from_gid", "from_ts", F.inline(F.array(*ends))).where("to_gid IS NOT NULL")
            one = one.select("from_gid", "from_col", "to_gid", F.lit(self.index[s.name]).cast("long").alias("from_table"), "to_table", "from_ts", F.lit(s.kind != "db").alias("from_task"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "from_gid long, from_col long, to_gid long, from_table long, to_table long, from_ts timestamp_ntz, from_task boolean")

    def dangling(self, name: str, column: str) -> DataFrame:
        """Rows whose foreign key names no row of its target."""
        target = self.spec(name).fks[column]
        return self.frames[name].where(F.col(column).isNotNull()).join(self.frames[target], F.col(column) == F.col(self.spec(target).pk), "left_anti")

    def table(self, which: str | int) -> DataFrame:
        """A table by name or number, with row_gid."""
        return self.rows(which if isinstance(which, str) else self.specs[which].name)

    def column(self, number: int) -> dict:
        """What the catalog has of a column."""
        return self.columns[number]

    def row(self, gid: int) -> DataFrame:
        """The row of a global number, in the shape of row_table(); empty if there is none."""
        name = next((s.name for s in self.specs if self.start(s.name) <= gid < self.start(s.name) + self.counts[s.name]), None)
        return self.row_table(name or self.specs[0].name).where(F.col("row_gid") == gid if name else F.lit(False))

    def cells(self, *names: str, policy: str = "all", declared: dict[str, int] | None = None) -> DataFrame:
        """(row_gid, table_idx, column_idx, local_idx, semantic_type, num, txt), nulls kept.

        num is the value as a double: epoch seconds of date and time, 0 or 1 of booleans. policy ``features``
        leaves out keys and the time column. Nested and binary columns are no cells. declared gives columns another
        semantic type by name; a value that doesn't fit it becomes null.
        """
        out = None
        for s in self.specs:
            if names and s.name not in names:
                continue
            skip = {s.pk, s.time, *s.fks} if policy == "features" else set()
            parts = []
            for c in self.columns:
                if c["table_name"] != s.name or c["name"] in skip or c["semantic_type"] is None:
                    continue
                kind, col = c["semantic_type"], F.col(c["name"])
                if declared and declared.get(c["name"], kind) != kind:
                    kind, dtype = declared[c["name"]], {NUMBER: "double", DATETIME: "timestamp_ntz", BOOLEAN: "boolean", TEXT: "string"}[declared[c["name"]]]
                    c, col = c | {"dtype": dtype}, col.cast("string").try_cast(dtype)
                    seconds = F.unix_micros(col.cast("timestamp")) / F.lit(1e6) if kind == DATETIME else None
                    value = {NUMBER: col, DATETIME: seconds, BOOLEAN: col.cast("int").cast("double") if kind == BOOLEAN else None, TEXT: F.lit(None).cast("double")}[kind]
                    parts.append(F.struct(F.lit(c["column_idx"]).cast("long").alias("column_idx"), F.lit(c["local_idx"]).cast("long").alias("local_idx"), F.lit(kind).alias("semantic_type"), value.alias("num"), (col if kind == TEXT else F.lit(None).cast("string")).alias("txt")))
                    continue
                num = {NUMBER: col.cast("double"), DATETIME: epoch_seconds(c["name"], c["dtype"]) if kind == DATETIME else None, BOOLEAN: col.cast("int").cast("double"), TEXT: F.lit(None).cast("double")}[kind]
                parts.append(F.struct(F.lit(c["column_idx"]).cast("long").alias("column_idx"), F.lit(c["local_idx"]).cast("long").alias("local_idx"), F.lit(kind).alias("semantic_type"), num.alias("num"), (col if kind == TEXT else F.lit(None).cast("string")).alias("txt")))
            if not parts:
                continue
            one = self.rows(s.name).select("row_gid", F.lit(self.index[s.name]).cast("long").alias("table_idx"), F.inline(F.array(*parts)))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "row_gid long, table_idx long, column_idx long, local_idx long, semantic_type int, num double, txt string")

    def described(self, embedder, size: int) -> DataFrame:
        """(column_idx, description, vector) of every column; an unknown column has the zero vector."""
        from relata.functions.vectors import embed

        texts = self.catalog().select("column_idx", "description")
        return texts.join(embed(texts, "description", embedder), "description").select("column_idx", "description", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), size)).alias("vector"))

    def describe(self, vocabulary: int = 50, rows: int = 20, edges: int = 30, keys: int = 20) -> dict[str, DataFrame]:
        """What a verbose dump shows: counts, tables, columns, first texts, rows, edges and keys, degrees."""
        from relata.operators.stats import degrees

        texts = self.cells().where("txt IS NOT NULL").select("txt").distinct()
        pairs = self.edges()
        nodes = self.row_table()
        counts = self.spark.createDataFrame([("tables", len(self.specs)), ("columns", len(self.columns)), ("rows", sum(self.counts.values()))], "what string, n long").unionByName(texts.agg(F.lit("texts").alias("what"), F.count("*").alias("n"))).unionByName(pairs.agg(F.lit("edges").alias("what"), F.count("*").alias("n")))
        tables = self.spark.createDataFrame([(self.index[s.name], s.name, s.kind, self.start(s.name), self.counts[s.name], s.pk, s.time) for s in self.specs], "table_idx long, table_name string, kind string, first_gid long, n_rows long, pk string, time_col string")
        return {
            "counts": counts,
            "tables": tables,
            "columns": self.catalog(),
            "vocabulary": texts.orderBy("txt").limit(vocabulary),
            "rows": nodes.orderBy("row_gid").limit(rows),
            "edges": pairs.orderBy("from_gid", "from_col", "to_gid").limit(edges),
            "keys": nodes.where("pk IS NOT NULL").orderBy("row_gid").select("table_idx", "pk", "row_gid").limit(keys),
            "degrees": degrees(pairs, "from_gid").withColumn("side", F.lit("from")).unionByName(degrees(pairs, "to_gid").withColumn("side", F.lit("to"))),
        }

    def save(self, path: str) -> None:
        """A snapshot: rows, edges and cells as Parquet, cells by table."""
        self.row_table().write.mode("overwrite").parquet(f"{path}/rows")
        self.edges().write.mode("overwrite").parquet(f"{path}/edges")
        self.cells().write.mode("overwrite").partitionBy("table_idx").parquet(f"{path}/cells")
        self.catalog().write.mode("overwrite").parquet(f"{path}/columns")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("rows", "edges", "cells", "columns")}
