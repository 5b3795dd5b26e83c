"""SimHash near-duplicates: pigeonhole blocks, block joins, verified Hamming distance.

Fingerprints of 64 bits are cut into four blocks of 16. Two that differ in at most two bits agree on two
blocks or more, so that they meet under one of the six pairs of blocks. Only distinct fingerprints are
joined. Within a bucket the links are verified, and a bucket hands on one link a member, never all pairs;
large buckets are cut again by the blocks that are left, which loses no pair.

For sets of Jaccard 0.8, which differ in far more bits, fingerprints are longer and blocks are as many as it takes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import appended, at_rest, binary, connected_components, forget, over_batches, written

SEED = 42
BLOCK = 16
#: Buckets beyond this size are cut again.
DENSE = 2048


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text's UTF-8 bytes."""
    import xxhash

    words = text.lower().split() if text else []  # bytes lower A-Z only and split at the six ASCII white spaces
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # bounded memory for long texts
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@over_batches(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64))


def masks(parts: int = 4) -> list[int]:
    width = 64 // parts
    return [((1 << width) - 1) << (width * i) for i in range(parts)]


def local_roots(found: np.ndarray, most: int) -> np.ndarray:
    """For sorted distinct fingerprints: the index of the smallest that links reach inside this array.

    Many are dealt by parts of the bits in which they differ at all: two that differ in ``most`` bits agree on one of
    most + 1 parts, so that only those with an equal part are compared, and again so. Links become roots part by
    part; no list of pairs is kept.
    """
    root = np.arange(len(found))
    if len(found) <= DENSE:
        for i in range(0, len(found), 256):
            a, b = np.nonzero(np.bitwise_count(found[i : i + 256, None] ^ found[None, :]) <= most)
            _unite(root, a + i, b)
        return _settled(root)
    differ = int(np.bitwise_or.reduce(found ^ found[0]))
    bits = [b for b in range(64) if differ >> b & 1]
    for part in range(most + 1):
        own = bits[part::most + 1]
        value = found & np.uint64(sum(1 << b for b in own))
        order = np.argsort(value, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(rows) > 1:
                rows = np.sort(rows)
                _unite(root, rows, rows[local_roots(found[rows], most)])
    return _settled(root)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives both ends of links, and what they point to, the lower root, until nothing changes."""
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return
        for at in (a, b, x, y):
            np.minimum.at(root, at, low)
        root[:] = root[root]


def _settled(root: np.ndarray) -> np.ndarray:
    while (root != root[root]).any():
        root = root[root]
    return root


def bucket_links(batches, most: int):
    """Rows (key, fp) sorted by key, then fp: links (a, b) from each member to its root in the bucket."""
    rest_key, rest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def groups(key, fp, last):
        nonlocal rest_key, rest
        key, fp = np.concatenate([rest_key, key]), np.concatenate([rest, fp])
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        if not last and len(key):
            rest_key, rest = key[edges[-2] :], fp[edges[-2] :]
            edges = edges[:-1]
        size = np.diff(edges)
        a, b = [], []
        for i in np.flatnonzero(size > 1):
            members = fp[edges[i] : edges[i + 1]]
            root = local_roots(members.view(np.uint64), most)
            far = root != np.arange(len(root))
            a.append(members[far])
            b.append(members[root[far]])
        a, b = (np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0).T if a else (np.zeros(0, np.int64),) * 2)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        yield groups(np.asarray(batch.column(0)), np.asarray(batch.column(1)), False)
    yield groups(np.zeros(0, np.int64), np.zeros(0, np.int64), True)


def near_duplicates(docs: DataFrame, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 lowercase hex digits) and component_id for every row of docs.

    Fingerprints link at ``most`` or fewer differing bits (0 to 2); component_id is the smallest key that
    links reach. Texts without words, null ones too, have fingerprint zero and link like any other. Rows with
    a null key belong to a component but never name it, and a component of such rows alone has a null id.
    Repeated rows are in one component. Texts are taken whole, however long; a bit that exactly half of the shingles
    have is 0. Other columns are ignored; an empty table gives an empty result.
    """
    marked = written(docs.select(F.col(key), fingerprints(binary(text)).alias("fp")), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min(key).alias("least_"))
    pairs = list(combinations([m - (1 << 64) if m >> 63 else m for m in masks()], 2))
    # the mixed value spreads over partitions; different agreements that mix alike only meet, and are verified
    blocks = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(a | b))) for i, (a, b) in enumerate(pairs)]
    spread = classes.select("fp", F.explode(F.array(*blocks)).alias("block_")).select("block_", "fp").repartition("block_").sortWithinPartitions("block_", "fp")
    links = spread.mapInArrow(lambda batches: bucket_links(batches, most), "a long, b long")
    roots = connected_components(links, "simhash")
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least_", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least_").alias("component_id"))
    member = written(joined.where("root <> fp").select("fp", "root").join(least, "root").select("fp", "component_id").unionByName(joined.where("root = fp").select("fp", F.col("fp").alias("root")).join(least, "root").select("fp", "component_id")), "members")
    return marked.join(member, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Share of bits in which fingerprints of sets of Jaccard 0.8 differ at most: arccos(8 / 9) / pi, for large sets; with
#: two bits a shingle no pair of small ones differs in more (computed for all sizes up to 40).
DIFFER = 0.1515
#: Probability that a pair of Jaccard 0.8 agrees on no block.
MISS = 1e-6
#: Bits that go with a set into its buckets, and the most that may differ: in all, and in the first 64 of them. A pair of
#: Jaccard 0.8 differs in more with probability 2e-7 and 3e-7, a pair that shares nothing in as few with 6e-9.
BESIDE, NEAR, NEAR_64 = 192, 56, 26
#: Bits that are compared where sets of a cluster are, and the most that may differ; a pair of Jaccard 0.8 differs in more
#: with probability 1e-9.
COMPARED, APART = 1024, 230
#: Least width of a block, and other sets that share one with a set by chance, about.
NARROW, BY_CHANCE = 8, 512
#: Blocks of 16 bits by which members of a cluster get leaders, besides the cluster itself.
PARTS = 12
_odd = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 2, 2048), np.uint64)
_flips, _odds = _odd[0], _odd[1] | np.uint64(1)
#: Rounds of one leader a set, before pairs that are still apart are looked for.
LEADER_ROUNDS = 2
#: Sets up to this number are found among texts by broadcast.
FEW = 100_000
#: Sets, and their shingles, that a part of a group holds; all of the group are compared with them.
HOT, HOT_SHINGLES = 2048, 1 << 22


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``size`` words, or of all its words if it has no more."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64))


def scheme(n: int) -> tuple[int, int, int]:
    """For about n sets: the bits of a block, the number of blocks, and the 64-bit words of a fingerprint.

    Sets of Jaccard 0.8 differ in up to 15 of 100 bits, so that no block of a useful width has to agree, as one has to
    for two bits of 64. There are as many blocks as it takes for one to agree all the same, but for MISS.
    """
    width = max(NARROW, int(np.log2(max(n, 1) / BY_CHANCE)))
    blocks = int(np.ceil(np.log(MISS) / np.log1p(-((1 - DIFFER) ** width))))
    return width, blocks, max(COMPARED, BESIDE + 64 * -(-width * blocks // 64)) // 64


def long_fingerprint(found: np.ndarray, words: int) -> bytes:
    """The SimHash of a set of shingles: 64 * words bits, 1 if set in over half the hashes; two hashes a shingle and word.

    A longer one begins with the bits of a shorter one.
    """
    ones = np.zeros(64 * words, np.int64)
    flips, odds = _flips[:, :words].ravel(), _odds[:, :words].ravel()
    for i in range(0, len(found), 127):  # counts of a part fit a byte
        h = (found[i : i + 127, None] ^ flips) * odds
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64 * words).sum(0, dtype=np.uint8)
    return np.packbits(ones > len(found)).tobytes()


def block_rows(batches, width: int, blocks: int):
    """Rows (set_, print_): block_, set_ and the bits beside it, for each block of the fingerprint."""
    weight = 1 << np.arange(width, dtype=np.int64)
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            prints = np.frombuffer(b"".join(part.column("print_").to_pylist()), np.uint8).reshape(len(part), -1)
            bits = np.unpackbits(prints[:, BESIDE // 8 :], axis=1)[:, : width * blocks].reshape(-1, blocks, width)
            name = (bits @ weight) + (np.arange(blocks, dtype=np.int64) << width)
            beside = np.repeat(np.ascontiguousarray(prints[:, : BESIDE // 8]).view("<i8"), blocks, axis=0)
            columns = [name.ravel(), np.repeat(np.asarray(part.column("set_")), blocks), *beside.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["block_", "set_", "w0_", "w1_", "w2_"])


def near_roots(words: np.ndarray) -> np.ndarray:
    """For n fingerprints of three words: the index of the smallest that links of at most NEAR differing bits reach.

    In a large bucket a few members are compared with all first. What the largest group they find does not hold is then
    compared with all; pairs inside that group are linked already, so that a bucket of near copies takes few comparisons.
    """
    n = len(words)
    root, order = np.arange(n), np.arange(n)

    def link(own: np.ndarray, others: np.ndarray) -> None:
        for j in range(0, len(others), 1 << 14):
            other = others[j : j + (1 << 14)]
            a, b = np.nonzero(np.bitwise_count(words[own, 0][:, None] ^ words[other, 0]) <= NEAR_64)
            a, b = own[a], other[b]
            near = np.bitwise_count(words[a] ^ words[b]).sum(1) <= NEAR
            near &= a != b
            if near.any():
                _unite(root, a[near], b[near])

    if n > DENSE:
        reached = np.zeros(n, bool)
        for _ in range(16):
            rest = np.flatnonzero(~reached)
            if not len(rest):
                break
            lead = rest[len(rest) // 2 :][:1]
            link(lead, order)
            reached |= np.bitwise_count(words ^ words[lead]).sum(1) <= NEAR
        root = _settled(root)
        most = np.bincount(root).argmax()
        order = np.concatenate([np.flatnonzero(root != most), np.flatnonzero(root == most)])
        n -= int((root == most).sum())
    for i in range(0, n, 128):
        link(order[i : min(n, i + 128)], order[i:])
    return _settled(root)


def near_links(batches):
    """Rows (block_, set_, bits beside it) sorted by block, then set: links (a, b) from each set to its root in the bucket."""

    def groups(held):
        block, name, *words = (np.concatenate(c) for c in zip(*held, strict=True))
        words = np.stack(words, 1).view(np.uint64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        found = [np.zeros((2, 0), np.int64)]
        for s, e in zip(edges, edges[1:], strict=False):
            if e - s > 1:
                root = near_roots(words[s:e])
                far = np.flatnonzero(root != np.arange(e - s))
                found.append(np.stack([name[s:e][far], name[s:e][root[far]]]))
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held = []
    try:
        for batch in batches:
            if not len(batch):
                continue
            columns = [np.asarray(c) for c in batch.columns]
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # where the bucket begins that may go on
            if held and (last or columns[0][0] != held[0][0][0]):
                yield groups([*held, [c[:last] for c in columns]])
                held = []
            elif last:
                yield groups([[c[:last] for c in columns]])
            held.append([c[last:] for c in columns])
        if held:
            yield groups(held)
    finally:
        at_rest()


def stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links as two rows: each end that isn't the smallest of those it reaches, and that smallest."""
    ends, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(ends))
    _unite(root, back[: len(a)], back[len(a) :])
    root = _settled(root)
    far = root != np.arange(len(ends))
    return np.stack([ends[far], ends[root[far]]])


def compared(prints: pa.Array) -> np.ndarray:
    """The bits of fingerprints that are compared inside a cluster, as words."""
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint64).reshape(len(prints), -1)[:, : COMPARED // 64]


def group_links(exact: bool):
    """A function of groups of sets that dealt() gives: links (a, b) between sets of two roots, none of all pairs.

    Sets of like sizes whose fingerprints differ in at most APART bits link: their roots, or, if exact, themselves once
    their shingles are confirmed.
    """

    def run(batches):
        at, held, found = None, [], []
        index = None

        def settle() -> None:
            """Makes one table of what the part holds, and compares it with itself."""
            nonlocal index
            if index is not None or not held:
                return
            index = [np.concatenate([h[k] for h in held]) for k in range(4)]
            if exact:
                grams = [g for h in held for g in h[4]]
                known, flat = np.unique(np.concatenate(grams), return_inverse=True)
                index += [known, flat, np.cumsum([0, *map(len, grams)])]
            for rows in list(held):
                look(rows)

        def look(rows: list) -> None:
            name, size, root, bits = index[:4]
            for i in range(0, len(rows[0]), 32):
                own = [x[i : i + 32] for x in rows]
                ok = (5 * np.minimum(own[1][:, None], size) >= 4 * np.maximum(own[1][:, None], size)) & (own[2][:, None] != root)
                for q in np.flatnonzero(ok.any(1)).tolist():
                    near = np.flatnonzero(ok[q])
                    near = near[np.bitwise_count(own[3][q] ^ bits[near]).sum(1) <= APART]
                    if not len(near):
                        continue
                    if exact:
                        known, flat, edge = index[4:]
                        place = np.searchsorted(known, own[4][q])
                        place = place[place < len(known)][known[place[place < len(known)]] == own[4][q][place < len(known)]]
                        mark = np.zeros(len(known), np.int64)
                        mark[place] = 1
                        both = np.array([mark[flat[edge[k] : edge[k + 1]]].sum() for k in near.tolist()])
                        near = near[5 * both >= 4 * (len(own[4][q]) + size[near] - both)]
                        found.append(np.stack([np.full(len(near), own[0][q]), name[near]]))
                    else:
                        found.append(np.unique(np.stack([np.full(len(near), own[2][q]), root[near]]), axis=1))
                if len(found) > 4096:
                    found[:] = [stars(*np.concatenate(found, 1))]

        def flush():
            out = stars(*np.concatenate([np.zeros((2, 0), np.int64), *found], 1))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

        try:
            for batch in batches:
                place, flag = np.asarray(batch.column("place_")), batch.column("held_").to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(flag.astype(int)) != 0)) + 1).tolist(), len(batch)]
                for s, e in zip(edges, edges[1:], strict=False):
                    if s == e:
                        continue
                    if place[s] != at:
                        settle()
                        at, held, index = place[s], [], None
                    part = batch.slice(s, e - s)
                    rows = [np.asarray(part.column(c)) for c in ("set_", "size_", "root")] + [compared(part.column("print_"))]
                    if exact:
                        rows.append([np.frombuffer(x, np.uint64) for x in part.column("grams_").to_pylist()])
                    if flag[s]:
                        held.append(rows)
                        continue
                    settle()
                    if index is not None:
                        look(rows)
                if sum(x.shape[1] for x in found) > 100_000:
                    yield flush()
            settle()
            yield flush()
        finally:
            at_rest()

    return run


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """rows (set_, size_, root, ...) with place_, the part of the group that a column tells, and held_, what the part holds.

    All of a group are compared with what its parts hold: all that have another root than most of the group.
    """
    roots = rows.groupBy(by, "root").agg(F.count("*").alias("n_"), F.sum("size_").alias("all_"))
    main = roots.groupBy(by).agg(F.max_by("root", F.struct("n_", "root")).alias("main_"), F.max(F.struct("n_", "root", "all_")).alias("most_"), F.sum("n_").alias("n_"), F.sum("all_").alias("all_"))
    n, size = F.col("n_") - F.col("most_.n_"), F.col("all_") - F.col("most_.all_")
    main = main.select(by, "main_", F.greatest(F.ceil(n / HOT), F.ceil(size / HOT_SHINGLES), F.lit(1)).cast("int").alias("parts_"))
    cut = rows.join(main, by).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)))
    own = (F.col("root") != F.col("main_")) & (F.pmod(F.xxhash64("set_"), F.col("parts_")) == F.col("part_"))
    return cut.withColumn("held_", own).withColumn("place_", F.xxhash64(by, "part_")).drop("parts_", "part_", "main_", by)


def similar(docs: DataFrame, rest: list, shingle: int = 5, text: str = "text") -> DataFrame:
    """The columns ``rest`` of every row of docs, and root_, alike for all rows that links reach.

    Rows link where the Jaccard similarity of their sets of shingles is 0.8 or more. Sets have SimHash fingerprints,
    which meet under blocks of bits as scheme() says; in a bucket their Hamming distance is verified, and the bucket
    hands on one link a member. What these links reach is a cluster, and pairs in it are candidates: each that is not
    linked by others is confirmed on the sets themselves, which are made again for the texts concerned. In each of a
    few rounds every set is compared with the likest of the leaders of its cluster and of parts of it. Then clusters that
    still hold sets apart tell which components their distances join, and inside those the candidates are confirmed where
    they are: no list of pairs leaves a group. Texts without words, null ones too, have equal sets. Texts are taken
    whole; sets and texts are told apart by 64 bits.
    """

    width, parts, words = scheme(docs.count())

    @over_batches("set_ long, size_ long, print_ binary")
    def sets(texts: pa.Array) -> pa.Array:
        import xxhash

        found = [shingles(x.as_py(), shingle) for x in texts]
        names = np.array([xxhash.xxh3_64_intdigest(f.tobytes()) for f in found], np.uint64).view(np.int64)
        prints = [long_fingerprint(f, words) for f in found]
        return pa.StructArray.from_arrays([pa.array(names), pa.array([len(f) for f in found], pa.int64()), pa.array(prints, pa.binary())], ["set_", "size_", "print_"])

    @over_batches("binary")
    def grams_of(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py(), shingle).tobytes() for x in texts], pa.binary())

    @over_batches("int", several=True)
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.bitwise_count(compared(a) ^ compared(b)).sum(1), pa.int32())

    @over_batches("boolean", several=True)
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(5 * both >= 4 * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    body = F.coalesce(binary(text), F.lit(b""))
    marked = written(docs.select(*rest, F.xxhash64(body).alias("text_"), sets(body).alias("s_")).select("*", "s_.*").drop("s_"), "sets")
    # texts of a set may differ in white space and case; the first by hash stands for all
    classes = written(marked.groupBy("set_").agg(F.min("text_").alias("text_"), F.first("size_").alias("size_"), F.first("print_").alias("print_")), "classes")
    light = written(marked.drop("text_", "size_", "print_"), "names")
    forget(marked)
    spread = classes.where("size_ > 0").select("set_", "print_").mapInArrow(lambda batches: block_rows(batches, width, parts), "block_ long, set_ long, w0_ long, w1_ long, w2_ long")
    near = written(spread.repartition("block_").sortWithinPartitions("block_", "set_").mapInArrow(near_links, "a long, b long"), "near")
    reached = written(connected_components(near, "clusters"), "clusters")
    forget(near)
    own = written(classes.join(reached.select(F.col("node").alias("set_"), F.col("root").alias("block_")), "set_").select("set_", "size_", "print_", "block_"), "own")
    forget(reached)
    some = [F.xxhash64("block_", F.lit(k), F.substring("print_", BESIDE // 8 + 2 * k + 1, 2)) for k in range(PARTS)]
    blocks = written(own.select("set_", "size_", F.explode(F.array("block_", *some)).alias("block_")), "blocks")
    prints = own.select("set_", "print_")
    grams, roots = None, None

    def side(table: DataFrame, column: str, name: str) -> DataFrame:
        return table.select(F.col("set_").alias(name), F.col(column).alias(f"{name}_{column}"))

    def fetch(wanted: DataFrame) -> None:
        """Adds the shingles of further sets to grams."""
        nonlocal grams
        wanted = wanted if grams is None else wanted.join(grams, "set_", "left_anti")
        wanted = written(wanted.join(classes.select("set_", "text_"), "set_"), "wanted")
        found = docs.select(F.xxhash64(body).alias("text_"), body.alias("body_")).join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "text_")
        grams = appended(found.select("set_", "body_").groupBy("set_").agg(F.first("body_").alias("body_")).select("set_", grams_of("body_").alias("grams_")), grams)
        forget(wanted)

    def joined(more: DataFrame) -> None:
        """Adds links to the components."""
        nonlocal roots
        if not more.isEmpty():
            links = more if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
            old, roots = roots, written(connected_components(links, "similar"), "roots")
            forget(old)
        forget(more)

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("set_"))
        return rows.join(roots.withColumnRenamed("node", "set_"), "set_", "left").withColumn("root", F.coalesce("root", "set_"))

    def still_apart(rows: DataFrame) -> DataFrame:
        """Blocks of rows that more than one component fills."""
        now = rooted(rows)
        apart = now.groupBy("block_").agg((F.min("root") < F.max("root")).alias("apart_")).where("apart_").select("block_")
        return written(now.join(apart, "block_", "left_semi"), "open")

    for k in range(LEADER_ROUNDS):
        now = still_apart(blocks)
        lead = written(now.groupBy("block_").agg(F.min_by(F.struct("set_", "size_", "root"), F.xxhash64("set_", F.lit(k))).alias("lead_")), "leaders")
        near = now.join(lead, "block_").where((F.col("root") != F.col("lead_.root")) & (5 * F.least("size_", F.col("lead_.size_")) >= 4 * F.greatest("size_", F.col("lead_.size_"))))
        near = written(near.select(F.col("set_").alias("a"), F.col("lead_.set_").alias("b")).distinct(), "near")
        both = near.join(side(prints, "print_", "a"), "a").join(side(prints, "print_", "b"), "b").select("a", "b", distance("a_print_", "b_print_").alias("far_"))
        best = both.where(F.col("far_") <= APART).groupBy("a").agg(F.min_by("b", F.struct("far_", "b")).alias("b"))
        close = written(best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "close")
        forget(now, lead, near)
        if close.isEmpty():
            break
        fetch(close.select(F.col("a").alias("set_")).unionByName(close.select(F.col("b").alias("set_"))).distinct())
        both = close.join(side(grams, "grams_", "a"), "a").join(side(grams, "grams_", "b"), "b")
        joined(written(both.where(alike("a_grams_", "b_grams_")).select("a", "b"), "similar"))
        forget(close)
    now = still_apart(own)
    candidates = written(dealt(now, "block_").select("place_", "held_", "set_", "size_", "root", "print_").repartition("place_").sortWithinPartitions("place_", F.desc("held_")).mapInArrow(group_links(False), "a long, b long").distinct(), "candidates")
    forget(now)
    if not candidates.isEmpty():
        clusters = written(connected_components(candidates, "clusters"), "clusters")
        members = rooted(own.select("set_", "size_", "print_")).join(clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster_")), "root")
        members = written(members, "members")
        fetch(members.select("set_"))
        rows = dealt(members, "cluster_").join(grams, "set_")
        rows = rows.select("place_", "held_", "set_", "size_", "root", "print_", "grams_").repartition("place_").sortWithinPartitions("place_", F.desc("held_"))
        joined(written(rows.mapInArrow(group_links(True), "a long, b long").distinct(), "similar"))
        forget(clusters, members)
    forget(candidates)
    forget(blocks, own, grams, classes)
    if roots is None:
        return light.withColumnRenamed("set_", "root_")
    return light.join(roots.withColumnRenamed("node", "set_"), "set_", "left").withColumn("root_", F.coalesce("root", "set_")).drop("set_", "root")
