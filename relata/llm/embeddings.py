"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Equal vectors of a label are one class. A class is indexed in the bucket of its nearest axes in every table, and
also looks into the buckets of its next nearest axes. Depth grows with the number of classes, so that classes meet
by chance about once at most, and the number of tables is what pairs of the least cosine need at that depth, found
on simulated pairs. Only bucket and class are shuffled; vectors are fetched for classes that share a bucket.

First every member of a bucket is compared with one leader, twice; then buckets that still hold classes of several
components are compared in full. Both hand on one link a member. Links are at last counted inside each component,
where all pairs are compared: classes that no link joins can't be linked themselves. Groups beyond HOT classes are
cut into blocks; every cosine is taken in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_rest, connected_components, forget, over_batches, written

#: Index rows of a group that one block holds.
HOT = 4096
#: Rows compared with an index at once.
SLICE = 1024
#: Rounds of one leader a bucket.
LEADER_ROUNDS = 2
#: Share of pairs at the least cosine that the tables are made for, on simulated pairs, and the most tables.
RECALL, MOST_TABLES = 0.98, 64


class CrossPolytope:
    """Codes of vectors: for each table the nearest axes of ``depth`` rotations, and the next nearest ones."""

    def __init__(self, dim: int, tables: int, depth: int, probes: int, seed: int = 17) -> None:
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.tables, self.depth, self.probes = tables, depth, min(probes, 2 * depth)
        self.signs = np.random.default_rng([seed, dim]).choice(np.array([-1, 1], np.float32), (tables, depth, 3, self.size, 1))

    def rotated(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """x, a column for each vector, after three rounds of random signs and the fast Hadamard transform."""
        y = x
        for flip in signs:
            y, width = y * flip, 1
            while width < self.size:
                pairs = y.reshape(self.size // (2 * width), 2, width, -1)
                y = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], 1).reshape(self.size, -1)
                width *= 2
        return y

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes): the own bucket, then the others looked into."""
        n, rows = len(x), np.arange(len(x))
        columns = np.zeros((self.size, n), np.float32)
        columns[: x.shape[1]] = x.T
        out = np.zeros((n, self.tables, 1 + self.probes), np.int64)
        scale = [(2 * self.size) ** k for k in range(self.depth)]
        for t in range(self.tables):
            own, step, loss = np.zeros(n, np.int64), [], []
            for k in range(self.depth):
                y = np.ascontiguousarray(self.rotated(columns, self.signs[t, k]).T)
                far, names, ways = np.abs(y), [], []
                for _ in range(3):
                    axis = far.argmax(1)
                    ways.append(far[rows, axis])
                    names.append(axis + self.size * (y[rows, axis] < 0))
                    far[rows, axis] = -1
                own += names[0] * scale[k]
                length = np.sqrt((y * y).sum(1))
                step += [(name - names[0]) * scale[k] for name in names[1:]]
                loss += [(ways[0] - way) / length for way in ways[1:]]
            near = np.argsort(np.stack(loss, 1), axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + np.take_along_axis(np.stack(step, 1), near, 1)
        return out


def made_for(dim: int, classes: int, least: float, probes: int) -> CrossPolytope:
    """Buckets for so many classes of one size, and as many tables as simulated pairs of the least cosine need."""
    size = 1 << max(1, (dim - 1).bit_length())
    depth = 1
    while (2 * size) ** depth < classes and (2 * size) ** (depth + 1) < 1 << 62:
        depth += 1
    rng = np.random.default_rng(dim)
    x, z = rng.normal(size=(2, 512, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * z
    all_ = CrossPolytope(dim, MOST_TABLES, depth, probes)
    met = np.zeros(len(x), bool)
    for t in range(MOST_TABLES):  # table by table, as the first tables are the same however many there are
        one = CrossPolytope(dim, 1, depth, probes)
        one.signs = all_.signs[t : t + 1]
        a, b = one.codes(x)[:, 0], one.codes(y)[:, 0]
        met |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
        if met.mean() >= RECALL:
            break
    all_.tables, all_.signs = t + 1, all_.signs[: t + 1]
    return all_


def unit(array: pa.Array) -> np.ndarray:
    x = np.array(array.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(array), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (class_, vector_, ...) grouped by some columns; groups beyond HOT rows are cut into blocks.

    index_ marks the rows that a block holds; they come first. All rows of the group are compared with them.
    """
    hot = rows.groupBy(*by).agg(F.count("*").alias("n_")).where(F.col("n_") > HOT).select(*by, F.ceil(F.col("n_") / HOT).cast("int").alias("blocks_"))
    blocks = F.coalesce("blocks_", F.lit(1))
    cut = rows.join(hot, by, "left").withColumn("block_", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumn("index_", F.pmod(F.xxhash64("class_"), blocks) == F.col("block_")).withColumn("place_", F.xxhash64(*by, "block_")).drop("blocks_", "block_", *by)
    return cut.repartition("place_").sortWithinPartitions("place_", F.desc("index_"))


def compared(least: float, count: bool):
    """A function of what dealt() gives: links (class_, 1, other) or, to count, (class_, 0, weight of its links)."""

    def run(batches):
        at, index, held, found = None, [], None, []

        def flush():
            cols = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
            found.clear()
            if count:
                own, back = np.unique(cols[0], return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, back, cols[1])
                cols = np.stack([own, total])
            else:
                cols = np.unique(cols, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1])], names=["class_", "value_"])

        def look(who: np.ndarray, x: np.ndarray) -> None:
            other, weight, y = held
            ok = x @ y.T >= least
            if count:
                ok &= who[:, None] != other[None, :]
                total = (ok.astype(np.float64) @ weight.astype(np.float64)).astype(np.int64)
                found.append(np.stack([who[total > 0], total[total > 0]]))
                return
            q, i = np.nonzero(ok)
            q, i = who[q], other[i]
            ends, back = np.unique(np.concatenate([q, i]), return_inverse=True)
            label, a, b = np.arange(len(ends)), back[: len(q)], back[len(q) :]
            while True:  # each member to the smallest that links reach here
                before = label.copy()
                lower = np.minimum(label[a], label[b])
                np.minimum.at(label, a, lower)
                np.minimum.at(label, b, lower)
                label = label[label]
                if (label == before).all():
                    break
            far = label != np.arange(len(ends))
            found.append(np.stack([ends[far], ends[label[far]]]))

        def settle() -> None:
            """The index is whole: its own rows are compared with it."""
            nonlocal held
            if held is None:
                held = tuple(np.concatenate(parts) for parts in zip(*index, strict=True)) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1)))
                for i in range(0, len(held[0]), SLICE):
                    look(held[0][i : i + SLICE], held[2][i : i + SLICE])

        try:
            for batch in batches:
                place, flag = np.asarray(batch.column("place_")), batch.column("index_").to_numpy(zero_copy_only=False)
                who, weight = np.asarray(batch.column("class_")), np.asarray(batch.column("many_"))
                edges = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(flag.astype(int)) != 0)) + 1).tolist(), len(batch)]
                for s, e in zip(edges, edges[1:], strict=False):
                    if s == e:
                        continue
                    if place[s] != at:
                        settle()
                        at, index, held = place[s], [], None
                    if flag[s]:
                        index.append((who[s:e], weight[s:e], unit(batch.column("vector_").slice(s, e - s))))
                        continue
                    settle()
                    for i in range(s, e, SLICE) if len(held[0]) else ():
                        j = min(e, i + SLICE)
                        look(who[i:j], unit(batch.column("vector_").slice(i, j - i)))
                if sum(x.shape[1] for x in found) > 200_000:
                    yield flush()
            settle()
            yield flush()
        finally:
            at_rest()

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, probes: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id and kept for every row of vectors.

    Rows link when their labels are equal and not null and their cosine is at least ``least``. Vectors that are
    null, empty or zero, or hold a null or a component that is not finite, link with nothing, nor do vectors of
    different lengths with each other, nor rows with a null key. Rows with equal vectors link. A key that several
    rows share names each of them: every row has its own links and component. A row without links is its own
    component and kept. component_id is the smallest key that links reach, and ties in the cosine play no part, as
    all that reach ``least`` link. Other columns are ignored; an empty table gives an empty result. Rows are found
    again in their class by 128 bits of a hash.
    """
    zero = F.lit(0).cast(vectors.schema[vector].dataType.elementType)
    rows = vectors.select(F.col(key).alias("id_"), F.col(label).alias("label_"), F.transform(vector, lambda x: x + zero).alias("vector_"))  # no -0.0
    fine = F.col("id_").isNotNull() & F.col("label_").isNotNull() & F.col("vector_").isNotNull() & (F.size("vector_") > 0) & ~F.coalesce(F.exists("vector_", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.coalesce(F.exists("vector_", lambda x: x != 0), F.lit(False))
    names = [F.xxhash64(F.lit(i), "label_", "vector_").alias(f"name{i}_") for i in (1, 2)]
    classes = rows.where(fine).groupBy("label_", "vector_").agg(F.min("id_").alias("least_"), F.count("*").alias("many_"))
    classes = classes.select(F.monotonically_increasing_id().alias("class_"), *names, "least_", "many_", F.xxhash64("label_", F.size("vector_")).alias("group_"), F.size("vector_").alias("dim_"), "vector_")
    classes = written(classes, "classes")
    sizes = {r["dim_"]: r["n"] for r in classes.groupBy("dim_").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors

    def spread(batches):
        made: dict[int, CrossPolytope] = {}
        try:
            for batch in batches:
                size = np.asarray(batch.column("dim_"))
                for dim in np.unique(size).tolist():
                    if dim not in made:
                        made[dim] = made_for(dim, sizes[dim], least, probes)
                    hasher, part = made[dim], batch.filter(pa.array(size == dim))
                    for i in range(0, len(part), 1024):
                        some = part.slice(i, 1024)
                        codes = hasher.codes(unit(some.column("vector_")))
                        n, each = len(some), codes[0].size
                        at = pa.array(np.repeat(np.arange(n), each))
                        table_no = np.tile(np.repeat(np.arange(hasher.tables), codes.shape[2]), n)
                        yield pa.RecordBatch.from_arrays([some.column("group_").take(at), pa.array(table_no.astype(np.int32)), pa.array(codes.reshape(-1)), some.column("class_").take(at)], names=["group_", "table_", "code_", "class_"])
        finally:
            at_rest()

    placed = classes.select("group_", "dim_", "class_", "vector_").mapInArrow(spread, "group_ long, table_ int, code_ long, class_ long")
    placed = written(placed.select(F.xxhash64("group_", "table_", "code_").alias("bucket_"), "class_"), "buckets")
    busy = placed.groupBy("bucket_").agg((F.min("class_") < F.max("class_")).alias("two_")).where("two_").select("bucket_")
    busy, every = written(busy, "busy"), placed
    placed = written(every.join(busy, "bucket_", "left_semi"), "shared")
    forget(busy, every)
    held = classes.select("class_", "group_", "many_", "vector_")

    @over_batches("boolean", several=True)
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), bool)
        size = np.diff(np.asarray(a.offsets))
        for dim in np.unique(size):
            own = np.flatnonzero(size == dim)
            for i in range(0, len(own), 8192):
                at = pa.array(own[i : i + 8192])
                out[own[i : i + 8192]] = np.einsum("ij,ij->i", unit(a.take(at)), unit(b.take(at))) >= least
        return pa.array(out)

    roots, links = None, None
    for k in range(LEADER_ROUNDS + 1):
        now = placed.withColumn("root", F.col("class_"))
        if roots is not None:  # buckets that one component fills are done
            now = placed.join(roots.withColumnRenamed("node", "class_"), "class_", "left").withColumn("root", F.coalesce("root", "class_"))
            apart = now.groupBy("bucket_").agg((F.min("root") < F.max("root")).alias("apart_")).where("apart_").select("bucket_")
            now = written(now.join(written(apart, "apart"), "bucket_", "left_semi"), "open")
        if k < LEADER_ROUNDS:
            lead = written(now.groupBy("bucket_").agg(F.min_by(F.struct("class_", "root"), F.xxhash64("class_", F.lit(k))).alias("lead_")), "leaders")
            pairs = now.join(lead, "bucket_").where(F.col("root") != F.col("lead_.root")).select(F.greatest("class_", F.col("lead_.class_")).alias("a"), F.least("class_", F.col("lead_.class_")).alias("b")).distinct()
            side = lambda x: held.select(F.col("class_").alias(x), F.col("group_").alias(f"{x}_group"), F.col("vector_").alias(f"{x}_vector"))
            both = written(pairs, "pairs").join(side("a"), "a").join(side("b"), "b").where("a_group = b_group")
            more = written(both.where(close("a_vector", "b_vector")).select("a", "b"), "links")
        else:
            told = dealt(now.select("bucket_", "class_").join(held, "class_"), ["bucket_", "group_"]).mapInArrow(compared(least, False), "class_ long, value_ long")
            more = written(told.select(F.col("class_").alias("a"), F.col("value_").alias("b")), "links")
        if more.isEmpty():
            continue
        links = more if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        roots = written(connected_components(links, "embeddings"), "roots")
    out = classes.select("class_", "name1_", "name2_", "least_", "many_")
    if roots is None:
        known = out.select("name1_", "name2_", (F.col("many_") - 1).alias("links_"), F.col("least_").alias("root_"))
    else:
        linked = written(roots.withColumnRenamed("node", "class_").join(out.select("class_", "least_"), "class_"), "linked")
        smallest = written(linked.groupBy("root").agg(F.min("least_").alias("root_")), "smallest")
        counted = dealt(roots.withColumnRenamed("node", "class_").join(held, "class_"), ["root"]).mapInArrow(compared(least, True), "class_ long, value_ long")
        counted = written(counted.groupBy("class_").agg(F.sum("value_").alias("links_")), "counted")
        known = out.join(linked.select("class_", "root").join(smallest, "root"), "class_", "left").join(counted, "class_", "left")
        known = known.select("name1_", "name2_", (F.coalesce("links_", F.lit(0)) + F.col("many_") - 1).alias("links_"), F.coalesce("root_", "least_").alias("root_"))
    named = rows.where(fine).select("id_", *names).join(written(known, "known"), ["name1_", "name2_"]).select("id_", "links_", "root_")
    named = named.unionByName(rows.where(~fine).select("id_", F.lit(0).cast("long").alias("links_"), F.col("id_").alias("root_")))
    return named.select(F.col("id_").alias(key), F.col("links_").alias("n_links"), F.col("root_").alias("component_id"), F.coalesce(F.col("id_") == F.col("root_"), F.lit(True)).alias("kept"))
