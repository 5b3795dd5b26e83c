"""Context sampling: around each seed its ancestors, then width-bounded, time-respecting children, level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.operators.draws import Draws
from relata.sources.database import HOPS
from relata.storage import cut

#: A parent with more children than this has its pairs of seeds and children drawn by NumPy.
KIDS = 2048
#: Children, and seeds, of such a parent that one row holds.
PART, CHUNK = 1 << 16, 1 << 11


def draw(seed: int, epoch: int, seq: str, gid: str) -> Column:
    """Randomness as a pure function of its arguments: an md5 that any engine can repeat."""
    return drawn(seed, epoch, F.col(seq), F.col(gid))


def drawn(seed: int, epoch: int, seq: Column, gid: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), seq.cast("string"), gid.cast("string")).cast("binary"))


def visible(ts: str, cutoff: str) -> Column:
    """No time, or no cut-off, hides nothing."""
    return F.coalesce(F.col(ts) <= F.col(cutoff), F.lit(True))


def children(frontier: DataFrame, edges: DataFrame, width: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(seq_id, seed_ts, parent, row_gid, h, rank): at most width visible children of each frontier row (seq_id, row_gid, seed_ts), in hash order.

    Frontier rows are distinct; several keys of a child for one parent are one edge. A parent's children are one row,
    which is cut to the width where it is joined: no pair of a seed and a child that the width leaves out is sorted,
    spilled or shuffled. The pairs of parents with more than KIDS children are drawn by NumPy, see crowded().
    """
    once = edges.select("from_gid", "to_gid", "from_ts")
    hubs = cut(once.groupBy("to_gid").count().where(F.col("count") > KIDS).select(F.col("to_gid").alias("hub"), F.ceil(F.col("count") / PART).cast("int").alias("parts")))  # at most a row for KIDS edges
    more = [c for c in ("depth",) if c in frontier.columns]
    front = frontier.select("seq_id", "seed_ts", F.col("row_gid").alias("parent"), *more)
    heavy = None
    if not hubs.isEmpty():
        hubs = F.broadcast(hubs)
        heavy = crowded(front, once, hubs, width, seed, epoch, more)
        front = front.join(hubs, F.col("parent") == F.col("hub"), "left_anti")
        once = once.join(hubs, F.col("to_gid") == F.col("hub"), "left_anti")
    kids = once.groupBy(F.col("to_gid").alias("parent")).agg(F.collect_set(F.struct("from_gid", "from_ts")).alias("kids"))
    seen = F.filter("kids", lambda x: F.coalesce(x["from_ts"] <= F.col("seed_ts"), F.lit(True)))
    each = F.transform(seen, lambda x: F.struct(drawn(seed, epoch, F.col("seq_id"), x["from_gid"]).alias("h"), x["from_gid"].alias("row_gid")))
    found = front.join(kids.hint("merge"), "parent").select("seq_id", "seed_ts", "parent", *more, F.posexplode(F.slice(F.sort_array(each), 1, width)).alias("place", "x"))
    light = found.select("seq_id", "seed_ts", "parent", "x.row_gid", *more, "x.h", (F.col("place") + 1).alias("rank"))
    return light if heavy is None else light.unionByName(heavy)


def crowded(front: DataFrame, once: DataFrame, hubs: DataFrame, width: int, seed: int, epoch: int, more: list[str]) -> DataFrame | None:
    """The rows of children() under parents that hubs names, or None where the frontier (seq_id, seed_ts, parent) has none.

    At most about PART children of a parent meet at most about CHUNK seeds in one row, so that the pairs, of which there are
    the product of both, are spread over tasks; a row's pairs are drawn together and only those inside the width leave it.
    """
    met = cut(front.join(hubs, F.col("parent") == F.col("hub")).drop("hub"))
    often = met.groupBy("parent").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.first("parts").alias("parts"))
    units, parts = often.agg(F.sum(F.col("chunks").cast("long") * F.col("parts")), F.max("parts")).first()
    if not units:
        return None
    dealt = met.join(F.broadcast(often.select("parent", "chunks")), "parent").withColumn("chunk", F.pmod(F.xxhash64("seq_id"), F.col("chunks")).cast("int"))
    rows = dealt.groupBy("parent", "parts", "chunk").agg(F.collect_list(F.struct("seq_id", "seed_ts", *more, F.col("seq_id").cast("string").alias("name"))).alias("seeds"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kids = once.join(hubs, F.col("to_gid") == F.col("hub")).withColumn("part", F.pmod(F.xxhash64("from_gid"), F.col("parts")).cast("int"))
    kids = kids.groupBy(F.col("to_gid").alias("parent"), "part").agg(F.collect_set(F.struct("from_gid", "from_ts")).alias("kids"))
    rows = rows.hint("merge").join(kids, ["parent", "part"]).select("parent", "part", "chunk", "seeds", "kids")
    rows = rows.repartition(min(units, 1024), "parent", "part", "chunk").select("parent", "seeds", "kids")

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield from drawn_rows(*(batch.column(c).slice(i, 1) for c in range(3)), width, seed, epoch)

    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    columns = ", ".join(f"{c} {kinds[c]}" for c in ("seq_id", "seed_ts", "parent", *more))
    found = rows.mapInArrow(run, f"{columns}, row_gid long, h string, rank int").select("seq_id", "seed_ts", "parent", "row_gid", *more, "h", "rank")
    if parts == 1:
        return found
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("seq_id", "parent").orderBy("h", "row_gid"))).where(F.col("rank") <= width)


def drawn_rows(parent: pa.Array, seeds: pa.Array, kids: pa.Array, width: int, seed: int, epoch: int) -> Iterator[pa.RecordBatch]:
    """The children that the seeds of one row of crowded() take, in batches of about 2 ** 18 pairs."""
    seeds, kids = seeds.flatten(), kids.flatten()
    never, ever = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def times(x: pa.Array, missing: int) -> np.ndarray:
        return np.asarray(x.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(missing))

    fields = {f.name: seeds.field(k) for k, f in enumerate(seeds.type)}
    draws = Draws(np.asarray(kids.field(0)), times(kids.field(1), never))
    prefixes, until = [f"{seed}:{epoch}:{x}:".encode() for x in fields.pop("name").to_pylist()], times(fields["seed_ts"], ever)
    step = max(1, (1 << 18) // max(1, min(width, len(kids))))
    for k in range(0, len(seeds), step):
        place, kid, digest, rank = draws.lowest(prefixes[k : k + step], until[k : k + step], width)
        own = {c: x.take(pa.array(place + k)) for c, x in fields.items()}
        own |= {"parent": parent.take(pa.array(np.zeros(len(place), np.int64))), "row_gid": pa.array(kid), "h": pa.array(digest.tolist(), pa.binary()).cast(pa.string()), "rank": pa.array(rank.astype(np.int32))}
        yield pa.RecordBatch.from_pydict({c: own[c] for c in ("seq_id", "seed_ts", "parent", *(c for c in fields if c not in ("seq_id", "seed_ts")), "row_gid", "h", "rank")})


def closure(above: DataFrame) -> DataFrame:
    """(seq_id, row_gid, hop): each row that RelDatabase.above() gives, with its ancestors, as a context without children."""
    each = above.select(F.col("row_gid").alias("seq_id"), F.explode(F.concat(F.array(F.col("row_gid") * HOPS), F.col("above"))).alias("x"))
    return each.select("seq_id", F.shiftright("x", 8).alias("row_gid"), F.col("x").bitwiseAND(F.lit(HOPS - 1)).alias("hop"))


def sample(seeds: DataFrame, edges: DataFrame, width: int = 128, max_hops: int = 1, seed: int = 42, epoch: int = 0, filter_parents: bool = False, task_rows: bool = False, row_times: DataFrame | None = None, same_table: bool = False, ready: bool = False) -> DataFrame:
    """(seq_id, row_gid, bucket, hop, root_hash, root_gid) of every row of every seed's context.

    seeds: (seq_id, row_gid, seed_ts). A bucket's rows are visited in hash order, each followed by all its
    ancestors that are not visited yet; children of a row at depth d wait for bucket d + 1, the ancestors' depth
    being their descendant's plus their hop. Ancestors shared in a bucket go to the nearest row, then the lower
    hash. Buckets go up to max_hops. Order by bucket, root_hash, root_gid, hop, row_gid.
    filter_parents hides parents later than the seed (row_times then has row_gid and ts); task_rows lets other
    task rows in as children; same_table is for seeds that are no task rows: only children of the seed's own table,
    which seeds then name in seed_table, are let in. ready says that edges are a written table already, which is not
    written again.
    """
    edges = edges if ready else cut(edges.select(*[c for c in ("from_gid", "to_gid", "from_ts", "from_task", *(["from_table"] if same_table else [])) if c in edges.columns]))
    down = edges if task_rows else edges.where(~F.col("from_task"))
    pending = seeds.select("seq_id", "row_gid", "seed_ts").withColumn("bucket", F.lit(0))
    own = cut(seeds.select("seq_id", "seed_table").distinct()) if same_table else None
    root = draw(seed, epoch, "seq_id", "root_gid")  # not carried along: half of a level's bytes
    visited = None
    for bucket in range(max_hops + 1):
        now = pending.where(F.col("bucket") == bucket).select("seq_id", "row_gid", "seed_ts").distinct()
        if visited is not None:
            now = now.join(visited.select("seq_id", "row_gid").hint("merge"), ["seq_id", "row_gid"], "left_anti")
        level = cut(now.select("seq_id", "row_gid", "seed_ts", F.lit(bucket).alias("bucket"), F.lit(0).alias("hop"), F.col("row_gid").alias("root_gid")))
        front, hop = level, 0
        while not front.isEmpty():  # ancestors; what is known already stops a cycle
            hop += 1
            up = front.join(edges.select("from_gid", "to_gid"), F.col("row_gid") == F.col("from_gid"))
            if filter_parents:
                up = up.join(row_times.select(F.col("row_gid").alias("to_gid"), F.col("ts").alias("to_ts")), "to_gid").where(visible("to_ts", "seed_ts"))
            up = up.groupBy("seq_id", "to_gid", "seed_ts").agg(F.min(F.struct(F.unhex(root).alias("h"), "root_gid")).alias("r"))
            up = up.select("seq_id", F.col("to_gid").alias("row_gid"), "seed_ts", F.lit(bucket).alias("bucket"), F.lit(hop).alias("hop"), "r.root_gid")
            known = level.select("seq_id", "row_gid")
            known = known if visited is None else known.unionByName(visited.select("seq_id", "row_gid"))
            front = cut(up.join(known.hint("merge"), ["seq_id", "row_gid"], "left_anti"))
            level = level.unionByName(front)
        visited = level if visited is None else visited.unionByName(level)
        if bucket < max_hops:
            front = level.select("seq_id", "row_gid", "seed_ts", (F.col("bucket") + F.col("hop")).alias("depth")).where(F.col("depth") < max_hops)
            if same_table:  # the tables that a sequence lets in, by the frontier's rows
                let_in = front.join(own, "seq_id").select("seq_id", "row_gid", "seed_ts", "depth", "seed_table")
                tables = [r[0] for r in own.select("seed_table").distinct().collect()]  # numbers of tables
                parts = [children(let_in.where(F.col("seed_table") == t).drop("seed_table"), down.where(F.col("from_table") == t), width, seed, epoch) for t in tables]
                found = parts[0]
                for x in parts[1:]:
                    found = found.unionByName(x)
            else:
                found = children(front, down, width, seed, epoch)
            new = found.select("seq_id", "row_gid", "seed_ts", (F.col("depth") + 1).cast("int").alias("bucket"))
            pending = pending.where(F.col("bucket") > bucket).unionByName(new)
            pending = cut(pending) if bucket + 1 < max_hops else pending  # the last bucket reads it once
    return visited.select("seq_id", "row_gid", "bucket", "hop", root.alias("root_hash"), "root_gid")


def tokens(context: DataFrame, cells: DataFrame, seq_len: int, seeds: DataFrame | None = None, target: int | None = None, drop: tuple[int, ...] = ()) -> DataFrame:
    """Cells of each context in visiting order, cut at seq_len: pos, node, and is_target on the seed's target cell.

    drop names columns that the seed row leaves out. A null target gives no target cell.
    """
    is_seed = (F.col("bucket") == 0) & (F.col("hop") == 0)
    rows = context.hint("merge").join(cells, "row_gid").where(~(is_seed & F.col("column_idx").isin(*drop)) if drop else F.lit(True))
    order = ["bucket", "root_hash", "root_gid", "hop", "row_gid", "local_idx"]
    out = rows.withColumn("pos", F.row_number().over(Window.partitionBy("seq_id").orderBy(*order)) - 1).where(F.col("pos") < seq_len)
    node = F.dense_rank().over(Window.partitionBy("seq_id").orderBy(*order[:-1])) - 1
    return out.withColumns({"node": node, "is_target": is_seed & (F.col("column_idx") == F.lit(target if target is not None else -1))})
