"""Registered queries of the relational context engine, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.functions import vectors as V
from relata.operators import context as C
from relata.operators import sequence as Q
from relata.operators import stats as S
from relata.operators.sampler import ContextSampler, TaskConfig
from relata.sources.database import RelDatabase
from relata.sources.schema import BOOLEAN, NUMBER, TEXT
from relata.storage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED, EPOCH, WIDTH = 42, 0, 8
SEQ_LEN = 64
BATCH, WORLD = 32, 4


def query(f: Callable[[RelDatabase], DataFrame]) -> Callable[[RelDatabase], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(RelDatabase.fixture(spark, sf_dir))
    return f


def r6(c, name: str | None = None):
    out = F.round(c if not isinstance(c, str) else F.col(c), 6) + F.lit(0.0)
    return out.alias(name or c)


def long(c: str, name: str | None = None):
    return F.col(c).cast("long").alias(name or c)


@query
def table_census(db):
    rows = [(s.name, db.counts[s.name], s.pk, s.time, len(s.fks)) for s in db.specs]
    each = db.spark.createDataFrame(rows, "table_name string, n_rows long, pk string, time_col string, n_fks long")
    return each.unionByName(each.agg(F.lit("TOTAL").alias("table_name"), F.sum("n_rows").alias("n_rows"), F.lit(None).cast("string").alias("pk"), F.lit(None).cast("string").alias("time_col"), F.sum("n_fks").alias("n_fks")))


@query
def column_catalog(db):
    return db.catalog().select("table_idx", "table_name", "column_idx", "local_idx", "name", "is_pk", "is_time", "fk_table_idx", "description")


@query
def semantic_type_counts(db):
    return db.catalog().where("semantic_type IS NOT NULL").groupBy(long("semantic_type")).agg(F.count("*").alias("n"))


@query
def auto_target(db):
    fit = db.catalog().where("semantic_type = 0 AND NOT is_pk AND fk_table_idx < 0 AND NOT is_time")
    sizes = db.spark.createDataFrame(list(db.counts.items()), "table_name string, n_rows long").where("n_rows >= 32")
    return fit.join(F.broadcast(sizes), "table_name").orderBy("table_idx", "column_idx").limit(1).select("table_name", "name", "column_idx")


@query
def row_gid_orders(db):
    return db.rows("orders").select("row_gid", "o_orderkey")


@query
def row_gid_lineitem(db):
    return db.rows("lineitem").select("row_gid", "l_orderkey", long("l_linenumber"), "l_partkey")


@query
def pk_lookup(db):
    return db.key_index("customer").select("pk", "row_gid")


@query
def cells_orders_all(db):
    return db.cells("orders").select("row_gid", "column_idx", long("semantic_type"), r6("num"), "txt")


@query
def cells_orders_features(db):
    return db.cells("orders", policy="features").select("row_gid", "column_idx", "txt", r6("num"))


@query
def null_cell_counts(db):
    return db.cells().groupBy("column_idx").agg(F.count("*").alias("n"), F.count_if(F.col("num").isNull() & F.col("txt").isNull()).alias("n_null"))


@query
def epoch_seconds_lineitem(db):
    return db.cells("lineitem").where(F.col("column_idx") == db.column_index("lineitem", "l_shipdate")).select("row_gid", "num")


@query
def timestamp_range(db):
    return S.datetime_stats(db.cells("orders", "lineitem", "events")).select("least", "most")


@query
def column_stats(db):
    return S.column_stats(db.cells()).select("column_idx", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query
def global_datetime_stats(db):
    return S.datetime_stats(db.cells("orders", "lineitem", "events")).select("n", F.round("mean", 0).alias("mean"), F.round("std", 0).alias("std"))


def _norm(db, *tables):
    cells = db.cells(*tables)
    return S.normalised(S.present(cells), S.column_stats(cells), S.datetime_stats(db.cells("orders", "lineitem", "events")))


@query
def zscore_orders(db):
    return _norm(db, "orders").where("semantic_type = 0").select("row_gid", "column_idx", F.round("norm", 5) + F.lit(0.0)).toDF("row_gid", "column_idx", "norm")


@query
def zscore_boolean_labels(db):
    return _norm(db, "labels").where("semantic_type = 3").select("row_gid", "column_idx", r6("norm"))


@query
def zscore_datetime_global(db):
    return _norm(db, "orders").where("semantic_type = 2").select("row_gid", F.round("norm", 5).alias("norm"))


@query
def vocab_ids(db):
    return S.vocabulary(db.cells()).select("text_id", "txt")


@query
def vocab_size(db):
    return db.cells().where("txt IS NOT NULL").agg(F.countDistinct("txt").alias("n_texts"))


@query
def text_ids_part(db):
    cells = db.cells("part")
    return cells.where("txt IS NOT NULL").join(S.vocabulary(cells), "txt").select("row_gid", "column_idx", "text_id")


@query
def token_length_stats(db):
    n = F.size(V.tokenised(F.col("txt")))
    texts = db.cells().where("txt IS NOT NULL").select("txt").distinct().select(n.alias("n"))
    return texts.agg(F.sum("n").alias("total"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"), r6(F.avg("n"), "mean"))


@query
def column_descriptions(db):
    return db.catalog().select("column_idx", F.concat_ws(" of ", "name", "table_name").alias("description"))


@query
def cardinality_report(db):
    cells = db.cells()
    kinds = cells.groupBy("semantic_type").count().select(F.concat(F.lit("cells_"), F.col("semantic_type").cast("string")).alias("what"), F.col("count").alias("n"))
    fixed = db.spark.createDataFrame([("tables", len(db.specs)), ("columns", len(db.columns)), ("rows", sum(db.counts.values()))], "what string, n long")
    edges = db.edges().agg(F.lit("edges").alias("what"), F.count("*").alias("n"))
    return fixed.unionByName(edges).unionByName(kinds)


@query
def epoch_to_date(db):
    return db.cells("orders").where("semantic_type = 2").select("row_gid", F.date_format(F.timestamp_seconds("num"), "yyyy-MM-dd").alias("day"))


@query
def text_preview(db):
    t = F.col("text")
    return db.frames["documents"].select("doc_id", F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 60), F.lit("..."))).otherwise(t).alias("preview"))


@query
def sample_previews(db):
    return db.row_table("orders", "customer").orderBy("row_gid").limit(20).select("row_gid", "table_idx", "pk")


@query
def memory_estimate(db):
    return db.extra("embeddings").agg(F.sum(F.size("embedding") * 2).alias("n_bytes"), F.count_if(F.size("embedding") > 0).alias("n_embedded"), F.count("*").alias("n_vectors"))


@query
def fk_edges_count(db):
    return db.edges().groupBy("from_col").agg(F.count("*").alias("n"))


@query
def fk_edges_lineitem(db):
    return db.edges("lineitem").select("from_gid", "from_col", "to_gid")


@query
def degree_stats(db):
    e = cut(db.edges().select("from_gid", "to_gid"))
    return S.degrees(e, "from_gid").withColumn("side", F.lit("from")).unionByName(S.degrees(e, "to_gid").withColumn("side", F.lit("to")))


@query
def f2p_neighbors_top5(db):
    return S.parents(db.edges("lineitem", "orders")).select("from_gid", F.array_join("f2p", ",").alias("f2p"))


@query
def p2f_children(db):
    return db.edges("orders").groupBy("to_gid").agg(F.count("*").alias("n"), F.sum("from_gid").alias("sum_gid"), F.min("from_gid").alias("least"))


@query
def dangling_fk(db):
    return db.dangling("lineitem", "l_orderkey").agg(F.count("*").alias("n"))


@query
def task_entity_left(db):
    docs = db.rows("documents").select(F.col("row_gid").alias("entity_gid"), "doc_id")
    return db.rows("labels").join(docs, "doc_id", "left").select("row_gid", F.coalesce("entity_gid", F.lit(-1)).alias("entity_gid"), "quality")


def _seeds(db, table, time=None):
    return db.rows(table).select(F.col("row_gid").alias("seq_id"), "row_gid", (F.col(time) if time else F.lit(None)).cast("timestamp_ntz").alias("seed_ts"))


@query
def temporal_children(db):
    return C.children(_seeds(db, "orders", "o_orderdate"), db.edges("lineitem"), 1 << 30).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("row_gid").alias("sum_gid"))


@query
def temporal_children_nulltime(db):
    return C.children(_seeds(db, "customer"), db.edges("orders"), 1 << 30).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("row_gid").alias("sum_gid"))


@query
def children_width_bound(db):
    return C.children(_seeds(db, "supplier"), db.edges("lineitem"), WIDTH).select("seq_id", "row_gid", long("rank"))


def _context(db, table, time=None, hops=1, *children):
    return C.sample(_seeds(db, table, time), db.edges(*children), WIDTH, hops)


@query
def ancestor_closure(db):
    return C.closure(db.above("lineitem", "lineitem", "orders", "customer", "supplier", "nation")).select("seq_id", "row_gid", long("hop"))


def _order_context(db):
    return _context(db, "orders", "o_orderdate", 1, "orders", "customer", "nation", "lineitem", "supplier")


def _customer_tokens(db):
    seeds = _context(db, "customer", None, 1, "orders", "customer", "nation")
    cells = S.present(db.cells("customer", "orders", "nation", "region"))
    return C.tokens(seeds, cells, SEQ_LEN, target=db.column_index("customer", "c_acctbal"))


def _mask_tokens(db):
    """What masks need of the cells, once."""
    return cut(_customer_tokens(db).select("seq_id", "pos", "row_gid", "table_idx", "column_idx"))


def _customer_parents(db, tok=None):
    """Parents of the rows that tok has, or of all."""
    edges = db.edges("orders", "customer", "nation")
    return S.parents(edges if tok is None else edges.join(tok.select(F.col("row_gid").alias("from_gid")).distinct(), "from_gid", "left_semi"))


@query
def context_rows(db):
    return _order_context(db).select("seq_id", "row_gid", long("bucket"), long("hop"))


@query
def hop_distance(db):
    return _order_context(db).groupBy((F.col("bucket") + F.col("hop")).cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query
def context_tokens_budget(db):
    return _customer_tokens(db).select("seq_id", long("pos"), "row_gid", "column_idx")


@query
def seed_drop_columns(db):
    seeds = _context(db, "customer", None, 0, "customer", "nation")
    tok = C.tokens(seeds, S.present(db.cells("customer", "nation", "region")), SEQ_LEN, drop=(db.column_index("customer", "c_acctbal"),))
    return tok.select("seq_id", long("pos"), "column_idx")


@query
def target_mask(db):
    return _customer_tokens(db).where("is_target").select("seq_id", long("pos"), "column_idx", r6("num"))


@query
def task_node_flag(db):
    tok = C.tokens(_context(db, "labels", None, 0, "labels"), S.present(db.cells("labels", "documents")), SEQ_LEN, target=db.column_index("labels", "quality"))
    return tok.select("seq_id", long("pos"), (F.col("table_idx") == db.index["labels"]).alias("is_task_node"), "is_target")


@query
def typed_slots(db):
    cells = db.cells("orders")
    rows = Q.slots(S.normalised(S.present(cells), S.column_stats(cells), S.datetime_stats(cells)))
    return rows.select("row_gid", "column_idx", F.round("number", 5).alias("number"), F.round("datetime", 5).alias("datetime"), F.round("boolean", 5).alias("boolean"))


@query
def local_node_index(db):
    return _customer_tokens(db).select("seq_id", "row_gid", long("node")).distinct()


@query
def attn_column(db):
    return Q.column_mask(_mask_tokens(db)).select("seq_id", long("q"), long("kv"))


@query
def attn_feature(db):
    tok = _mask_tokens(db)
    return Q.feature_mask(tok, _customer_parents(db, tok)).select("seq_id", long("q"), long("kv"))


@query
def attn_neighbor(db):
    tok = _mask_tokens(db)
    return Q.neighbour_mask(tok, _customer_parents(db, tok)).select("seq_id", long("q"), long("kv"))


@query
def attn_density(db):
    tok = _mask_tokens(db)
    f2p = cut(_customer_parents(db, tok))
    masks = [Q.column_mask(tok).withColumn("kind", F.lit("column")), Q.feature_mask(tok, f2p).withColumn("kind", F.lit("feature")), Q.neighbour_mask(tok, f2p).withColumn("kind", F.lit("neighbour"))]
    n = tok.groupBy("seq_id").agg(F.count("*").alias("cells"))
    pairs = masks[0].unionByName(masks[1]).unionByName(masks[2]).groupBy("kind", "seq_id").agg(F.count("*").alias("pairs"))
    return pairs.join(n, "seq_id").select("seq_id", "kind", "pairs", r6(F.col("pairs") * 100.0 / (F.col("cells") * F.col("cells")), "density"))


@query
def attn_full(db):
    """The unrestricted mask, told for every cell by the number and sum of those that it sees."""
    return Q.full_mask(_mask_tokens(db)).groupBy("seq_id", long("q")).agg(F.count("*").alias("n"), F.sum("kv").alias("sum_kv"))


@query
def most_neighbours(db):
    tok = _mask_tokens(db)
    return S.most_neighbours(tok, _customer_parents(db, tok)).select("seq_id", long("most"))


@query
def context_two_hops(db):
    return _context(db, "customer", None, 2, "orders", "customer", "nation", "lineitem", "supplier").select("seq_id", "row_gid", long("bucket"), long("hop"))


@query
def context_full_size(db):
    """Suppliers as seeds with 256 children a row and 1,024 cells a sequence, the sizes of training runs."""
    seeds = C.sample(_seeds(db, "supplier"), db.edges("lineitem", "supplier", "nation", "orders"), 256, 1)
    tok = C.tokens(seeds, S.present(db.cells("supplier", "nation", "region", "lineitem", "orders", "part", "customer")), 1024, target=db.column_index("supplier", "s_acctbal"))
    return tok.groupBy("seq_id").agg(F.count("*").alias("n_cells"), F.max("node").cast("long").alias("last_node"), F.sum("row_gid").alias("sum_gid"), F.sum(F.col("pos") * F.col("column_idx")).cast("long").alias("check"), F.count_if("is_target").alias("n_targets"))


@query
def batch_summary(db):
    return _customer_tokens(db).groupBy("seq_id").agg(F.count("*").alias("n_cells"), F.count_if("is_target").alias("n_masked"), F.countDistinct("row_gid").alias("n_rows"))


def _places(db):
    return Q.shuffled(_seeds(db, "customer"), SEED, EPOCH)


@query
def epoch_shuffle(db):
    return _places(db).select("row_gid", "place")


@query
def batch_assignment(db):
    return Q.assigned(_places(db), BATCH, WORLD).select("row_gid", long("batch_idx"), "rank", long("slot"))


@query
def wraparound_slots(db):
    return Q.batches(_places(db), db.counts["customer"], BATCH, WORLD).select(long("batch_idx"), "rank", "slot", "row_gid", "true_size")


@query
def num_batches(db):
    return db.frames["customer"].agg(F.ceil(F.count("*") / F.lit(BATCH * WORLD)).cast("long").alias("n"))


@query
def sequence_pack(db):
    packed = Q.pack(_customer_tokens(db), SEQ_LEN, ("column_idx", "row_gid"))
    return packed.select("seq_id", long("n_cells"), F.array_join("column_idx", ",").alias("columns"), F.size(F.filter("is_padding", lambda x: x)).cast("long").alias("n_padding"))


@query
def epoch_orders(db):
    """The first three epochs' orders."""
    out = None
    for epoch in range(3):
        one = Q.shuffled(_seeds(db, "customer"), SEED, epoch, db.counts["customer"]).select(F.lit(epoch).cast("long").alias("epoch"), "row_gid", "place")
        out = one if out is None else out.unionByName(one)
    return out


@query
def batch_collate(db):
    packed = Q.pack(_customer_tokens(db), SEQ_LEN, ("column_idx",))
    places = Q.assigned(_places(db), BATCH, WORLD).select("batch_idx", "rank", "slot", F.col("row_gid").alias("seq_id"))
    each = F.transform("sequences", lambda x: F.concat_ws(":", x["slot"].cast("string"), x["seq_id"].cast("string"), x["n_cells"].cast("string")))
    return Q.collated(packed, places).select(long("batch_idx"), "rank", F.size("sequences").cast("long").alias("n"), F.array_join(each, ",").alias("slots"))


def _sampler(db):
    tasks = [TaskConfig(db, "customer", "c_acctbal", ("c_mktsegment",)), TaskConfig(db, "labels", "quality")]
    return ContextSampler(tasks, batch_size=16, seq_len=SEQ_LEN, rank=1, world=2, width=WIDTH, seed=SEED)


@query
def sampler_places(db):
    """The order of an epoch over the seeds of two tasks."""
    return _sampler(db).places().select(long("task"), "row_gid", "seq_id", "place")


@query
def sampler_batch(db):
    """One rank's first batch over two tasks."""
    return _sampler(db).batch(0).groupBy("slot", long("task"), "seq_id", long("true_size")).agg(F.count("*").alias("n_cells"), F.count_if("is_target").alias("n_targets"), F.count_if("is_task_node").alias("n_task_cells"))


@query
def seed_tasks(db):
    """Seeds of two tasks, numbered task by task."""
    return _sampler(db).seeds().select(long("task"), "row_gid", "seq_id")


@query
def row_lookup(db):
    found = None
    for gid in (0, db.start("orders"), db.start("orders") + 7, db.start("supplier") + 1, sum(db.counts.values())):
        one = db.row(gid).select("row_gid", "table_idx", "pk")
        found = one if found is None else found.unionByName(one)
    return found


@query
def mismatched_cells(db):
    """Columns read under types that not all of their values fit."""
    cells = db.cells("orders", "events", declared={"props": NUMBER, "event_type": BOOLEAN, "o_orderpriority": NUMBER, "o_orderkey": TEXT, "user_id": BOOLEAN})
    return cells.groupBy("column_idx", long("semantic_type")).agg(F.count("*").alias("n"), F.count("num").alias("n_num"), F.count("txt").alias("n_txt"))


@query
def throughput_summary(db):
    """Events as timed steps: a value's hundredth as seconds, one item each."""
    timed = db.frames["events"].select((F.col("value") / 100).alias("seconds"), F.lit(1).cast("long").alias("items"))
    out = S.throughput(timed, "seconds", "items")
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("total", "mean", "least", "most")), "items", F.round("rate", 4).alias("rate"))


@query
def swap_embedder(db):
    """The vocabulary's vectors again, by another embedder."""
    texts = db.cells("nation", "region").where("txt IS NOT NULL")
    return _values(V.embed(texts, "txt", V.hashing_embedder(16)), "txt")


@query
def half_vectors(db):
    """Bytes of the vectors in half precision."""
    halves = db.extra("embeddings").select("vec_id", V.halved("embedding").alias("h"))
    return halves.select("vec_id", F.octet_length("h").cast("long").alias("n_bytes"))


@query
def index_lookups(db):
    """Numbers of tables and columns by name, -1 for unknown ones."""
    asked = [("orders", "o_custkey"), ("orders", "nothing"), ("nothing", "o_custkey"), ("labels", "toxic")]
    return db.spark.createDataFrame([(t, c, db.table_index(t), db.column_index(t, c)) for t, c in asked], "table_name string, name string, table_idx long, column_idx long")


@query
def describe_counts(db):
    return db.describe()["counts"]


@query
def describe_previews(db):
    found = db.describe()
    texts = found["vocabulary"].select(F.lit("vocabulary").alias("what"), F.substring("txt", 1, 40).alias("value"))
    edges = found["edges"].select(F.lit("edge").alias("what"), F.concat_ws(" ", "from_gid", "from_col", "to_gid").alias("value"))
    keys = found["keys"].select(F.lit("key").alias("what"), F.concat_ws(" ", "table_idx", "pk", "row_gid").alias("value"))
    return texts.unionByName(edges).unionByName(keys)


@query
def split_rows(db):
    d = F.col("o_orderdate")
    return db.frames["orders"].groupBy(F.when(d < "1999-01-01", "train").when(d < "2000-01-01", "val").otherwise("test").alias("split")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("sum_key"))


@query
def seed_enumeration(db):
    return db.row_table("labels").select(F.lit(0).cast("long").alias("db_id"), "row_gid", "is_task_row")


@query
def vec_l2_normalize(db):
    v = V.l2_normalised(F.col("embedding"))
    return db.extra("embeddings").select("vec_id", r6(V.dot(v, v), "norm2"), r6(v[0], "first"))


@query
def vec_prefix_renorm(db):
    v = V.prefix(F.col("embedding"), 16)
    return db.extra("embeddings").select("vec_id", F.size(v).cast("long").alias("n"), r6(v[0], "first"), r6(v[15], "last"))


@query
def vec_mean_pool_by_label(db):
    return V.mean_pool(db.extra("embeddings"), "label", "embedding").select(long("label"), long("i"), r6("mean"))


@query
def vec_last_token(db):
    return V.last_token(db.extra("embeddings"), "label", "vec_id", "embedding").select(long("label"), r6(F.col("embedding")[0].cast("double"), "first"))


@query
def cosine_topk(db):
    """For each label's first vector its five nearest of that label."""
    e = db.extra("embeddings").select("vec_id", "label", V.l2_normalised(F.col("embedding")).alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("q"), F.min("vec_id").alias("q_id"))
    near = e.join(first, "label").where("vec_id <> q_id").withColumn("cosine", F.round(V.dot(F.col("v"), F.col("q")), 6))
    return near.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cosine"), "vec_id"))).where("k <= 5").select(long("label"), "vec_id", long("k"), "cosine")


def _predictions(db):
    """A stand-in for a model: the discount predicts the tax, a tenth of the rows is masked."""
    return db.rows("lineitem").select("row_gid", (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("z"), (F.col("row_gid") % 10 == 0).alias("mask"), (F.col("row_gid") % 4).cast("int").alias("kind"))


@query
def huber_loss(db):
    return _predictions(db).agg(F.round(F.avg(V.huber(F.col("x"), F.col("z"))), 6).alias("loss"))


@query
def bce_logits(db):
    return _predictions(db).agg(F.round(F.avg(V.bce_logits(F.col("x"), F.col("z") - 0.3)), 6).alias("loss"))


@query
def masked_mean_loss(db):
    return _predictions(db).agg(F.round(V.masked_mean(V.typed_loss(F.col("kind"), F.col("x"), F.col("z")), F.col("mask")), 6).alias("loss"))


@query
def running_loss(db):
    p = _predictions(db).select(F.floor(F.col("row_gid") / 5000).alias("step"), V.huber(F.col("x"), F.col("z")).alias("loss"))
    return p.groupBy("step").agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


def _values(rows, *keys):
    """A row for each component that is not 0."""
    return rows.select(*keys, F.posexplode("embedding").alias("i", "x")).where("x <> 0").select(*keys, long("i"), r6(F.col("x").cast("double"), "x"))


@query
def hash_embed_vocab(db):
    texts = db.cells("part", "nation", "region").where("txt IS NOT NULL")
    return _values(V.embed(texts, "txt", V.hashing_embedder(64)), "txt")


@query
def column_vectors(db):
    """Vectors of all columns' descriptions."""
    return _values(db.described(V.hashing_embedder(64), 64).withColumnRenamed("vector", "embedding"), "column_idx")


@query
def cell_vectors(db):
    """Every cell of parts with its text's and its column's vector, told by a few of their components."""
    cells = db.cells("part")
    out = V.with_vectors(cells, V.embed(cells.where("txt IS NOT NULL"), "txt", V.hashing_embedder(64)), db.described(V.hashing_embedder(64), 64), 64)
    norm = lambda c: F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return out.select("row_gid", "column_idx", F.round(norm("text_vector"), 3).alias("text_norm"), F.round(norm("column_vector"), 3).alias("column_norm"))


@query
def padded_tokens(db):
    """Ids padded to the longest text of a batch, and their mask; batches by the text's length."""
    texts = db.cells("part", "nation").where("txt IS NOT NULL").select("txt").distinct().select("txt", (F.length("txt") % 7).alias("batch"), V.token_ids(F.col("txt")).alias("ids"))
    padded = V.padded(texts, "batch")
    return padded.select("txt", F.size("ids").cast("long").alias("width"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n"), F.size(F.filter("ids", lambda x: x > 0)).cast("long").alias("n_ids"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as seeds: ancestors, temporal children, cells cut at 1024, target o_totalprice masked."""
    db = RelDatabase.fixture(spark, sf_dir)
    cells = S.present(db.cells("orders", "customer", "nation", "region", "lineitem", "part", "supplier"))
    tok = C.tokens(C.sample(_seeds(db, "orders", "o_orderdate"), db.edges("orders", "customer", "nation", "lineitem", "supplier"), 128, 1), cells, 1024, target=db.column_index("orders", "o_totalprice"))
    return tok.select("seq_id", "pos", "node", "row_gid", "table_idx", "column_idx", "semantic_type", F.when(~F.col("is_target"), F.col("num")).alias("num"), F.when(~F.col("is_target"), F.col("txt")).alias("txt"), "is_target")
