"""Substring dedup: every word of a window that also starts somewhere else goes.

A window is WINDOW consecutive words of one document. Its fingerprint is the least hash among the windows of
ANCHOR words inside it: equal windows have equal fingerprints, and neighbours mostly share theirs, so that an
index needs one entry for about ten words. The index is log-structured: sorted immutable runs of (fingerprint,
group of documents), dealt into buckets by fingerprint, in a folder that later sessions open again. A new batch
becomes a run, is merge-joined with the runs of the history, and stays beside them; when there are many, runs are
compacted into one. Fingerprints with a second place are handed to the groups of documents that hold them, old
ones too, whose texts the index keeps. Candidates are verified by 128 bits in all, the fingerprint and a hash of
the window's text, again by counting in buckets. Entries are made unique within a task and group before any
shuffle, and buckets that a passage of very many documents fills are made unique by group in parts first.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, _fresh, at_rest, binary, delete, values, written

WINDOW = 35
ANCHOR = 18
#: Text of one group of documents, and index entries of one bucket.
GROUP_BYTES = 16 << 20
BUCKET_ENTRIES = 1 << 20
#: Parts in which a bucket with more than four times its entries is made unique.
SALTS = 16
#: Runs of an index beyond which they are compacted.
MOST_RUNS = 4
#: Bytes of text hashed at once, and of those that a worker has out of Arrow; each needs some 60 times that in arrays.
CHUNK = 1 << 18
PIECE = 1 << 20

TWICE, GROUP = np.uint32(1 << 31), np.uint32((1 << 31) - 1)
_B, _R = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i below n at least."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(n + n // 4, base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


def rest() -> None:
    """Leaves no long arrays behind in a worker."""
    _powers.clear()
    at_rest()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[begin:end] for each span, alike wherever the span lies."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n)[:n], out=total[1:])
    return mixed((total[end] - total[begin]) * powers(pow(base, -1, 1 << 64), n)[begin])


def anchors(texts: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the texts, in order: its text's number, its anchor's place among all words, its fingerprint."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = ~WHITE[data]
    edges = np.flatnonzero(ink[1:] != ink[:-1])
    begin, end = edges[::2], edges[1::2]
    if len(begin) < window:
        return none
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")
    word = spans(data.astype(np.uint64) + np.uint64(1), begin, end, _B)
    at = np.arange(len(word) - anchor + 1)
    gram = spans(word, at, at + anchor, _R)
    width = window - anchor + 1
    first = np.flatnonzero(owner[window - 1 :] == owner[: len(owner) - window + 1])
    if not len(first):
        return none
    views = np.lib.stride_tricks.sliding_window_view(gram, width)
    place = np.concatenate([views[first[i : i + 65536]].argmin(1) for i in range(0, len(first), 65536)]) + first
    return owner[first], place, gram[place]


def chunks(texts: list[bytes]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield slice(start, len(texts))


def pieces(batch: pa.RecordBatch, text: str = "text_") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with PIECE bytes of text, or one text if that is longer."""
    end = values(batch.column(text))[1]
    cuts = [0, *(np.flatnonzero(np.diff((end[1:] - end[0]) // PIECE)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def unique_entries(keys: list[np.ndarray], groups: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct (keys, group); a group number gets TWICE where there were several."""
    order = np.lexsort([groups & GROUP, *keys[::-1]])
    keys, groups = [k[order] for k in keys], groups[order]
    new = np.ones(len(groups), bool)
    new[1:] = (groups[1:] & GROUP) != (groups[:-1] & GROUP)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(groups))) > 1
    flags = np.bitwise_or.reduceat(groups, at) if len(at) else groups[:0]
    return [k[at] for k in keys], flags | np.where(many, TWICE, np.uint32(0))


def dealt(keys: list[np.ndarray], groups: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries as a row for each bucket: bucket, the first key's bytes, the second's (or none), groups' bytes."""
    bucket = (mixed(keys[0]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    rows = np.split(order, at[1:]) if len(found) else []
    blobs = [pa.array([k[r].tobytes() for r in rows], pa.binary()) for k in [*keys, groups]]
    if len(keys) == 1:
        blobs.insert(1, pa.nulls(len(rows), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *blobs], names=["bucket", "k1", "k2", "groups"])


ENTRIES = "bucket int, k1 binary, k2 binary, groups binary"


def grouped(docs: DataFrame, text: str, groups: int, first: int = 0) -> DataFrame:
    """(group_, text_, null_, row_) for every row, groups from first on; row_ is the whole row but for the text."""
    rest = [F.col(c) for c in docs.columns if c != text]
    return docs.select((F.pmod(F.xxhash64(text, *rest[:1]), F.lit(groups)) + first).cast("int").alias("group_"), F.coalesce(binary(text), F.lit(b"")).alias("text_"), F.col(text).isNull().alias("null_"), F.struct(*(rest or [F.lit(0).alias("none_")])).alias("row_"))


def entries(docs: DataFrame, buckets: int, batches: int = 1, first: int = 0, groups: int = 1) -> DataFrame:
    """Level 0 of the index: (batch, bucket, k1, k2, groups) of the fingerprints in the texts of grouped().

    Batches are ranges of groups, so that a later one's groups are greater.
    """

    def run(it):
        held: list[list] = [[] for _ in range(batches)]
        try:
            for arrow in (x for batch in it for x in pieces(batch)):
                group, texts = np.asarray(arrow.column(0)).astype(np.uint32), arrow.column(1).to_pylist()
                for part in chunks(texts):
                    owner, place, key = anchors(texts[part])
                    new = np.ones(len(place), bool)
                    new[1:] = place[1:] != place[:-1]
                    own = group[part][owner[new]]
                    for b in range(batches):
                        mine = (own.astype(np.int64) - first) * batches // groups == b
                        held[b].append((key[new][mine], own[mine]))
            for b, parts in enumerate(held):
                if parts:
                    keys, own = unique_entries([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]))
                    out = dealt(keys, own, buckets)
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(out), pa.int32()), *out.columns], names=["batch", *out.schema.names])
        finally:
            rest()

    return docs.select("group_", "text_").mapInArrow(run, f"batch int, {ENTRIES}")


def thinned(rows: DataFrame) -> DataFrame:
    """Entries of one batch; of buckets that are too large each group's are made unique, in SALTS parts."""
    sizes = rows.groupBy("bucket").agg(F.sum(F.octet_length("groups") / 4).alias("n_")).where(F.col("n_") > 4 * BUCKET_ENTRIES)
    hot = [r["bucket"] for r in sizes.select("bucket").collect()]  # numbers of buckets, at most one for 60 MB of text
    if not hot:
        return rows

    def split(batches):
        for batch in batches:
            for i in range(len(batch)):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                keys, groups = _arrays(one)
                for salt in range(SALTS):
                    mine = (groups & GROUP) % SALTS == salt
                    yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), one.column("bucket").combine_chunks(), pa.array([keys[0][mine].tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([groups[mine].tobytes()], pa.binary())], names=["salt", "bucket", "k1", "k2", "groups"])

    def unique(part: pa.Table) -> pa.Table:
        keys, groups = unique_entries(*_arrays(part))
        return pa.table([part.column("bucket").slice(0, 1).combine_chunks(), pa.array([keys[0].tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([groups.tobytes()], pa.binary())], names=["bucket", "k1", "k2", "groups"])

    large = rows.where(F.col("bucket").isin(hot)).mapInArrow(split, f"salt int, {ENTRIES}").groupBy("bucket", "salt").applyInArrow(unique, ENTRIES)
    return rows.where(~F.col("bucket").isin(hot)).unionByName(written(large, "thinned"))


def _arrays(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    join = lambda c, t: np.frombuffer(b"".join(x for x in rows.column(c).to_pylist() if x), t)
    keys = [join("k1", np.uint64), join("k2", np.uint64)]
    return keys if len(keys[1]) else keys[:1], join("groups", np.uint32)


def several(keys: list[np.ndarray], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries: whether an entry's key has several places, and where each key begins."""
    same = np.ones(max(0, len(groups) - 1), bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    edges = np.flatnonzero(~np.concatenate([[False], same])) if len(groups) else np.zeros(0, np.int64)
    if not len(edges):
        return np.zeros(0, bool), edges
    size = np.diff(np.append(edges, len(groups)))
    return np.repeat((size > 1) | np.logical_or.reduceat((groups & TWICE) > 0, edges), size), edges


def told(keys: list[np.ndarray], groups: np.ndarray, tell: np.ndarray) -> list[list]:
    """Columns group, k1, k2 and none of a row for each group that gets the entries marked in tell."""
    order = np.flatnonzero(tell)[np.argsort((groups & GROUP)[tell], kind="stable")]
    own, at = np.unique((groups & GROUP)[order], return_index=True)
    parts = np.split(order, at[1:]) if len(own) else []
    return [own.tolist(), *([k[p].tobytes() for p in parts] for k in keys), *([[None] * len(parts)] * (2 - len(keys))), [None] * len(parts)]


def _rows(columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "k1", "k2", "groups"])


def _verify(rows: pa.Table) -> pa.Table:
    """For a bucket's candidates: those with several places, by group."""
    keys, groups = unique_entries(*_arrays(rows))
    return _rows(told(keys, groups, several(keys, groups)[0]))


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs (keys, groups) as one, every group of b after those of a; neither is sorted anew."""
    at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
    key, group = np.zeros(len(a[0]) + len(b[0]), np.uint64), np.zeros(len(a[0]) + len(b[0]), np.uint32)
    old = np.ones(len(key), bool)
    old[at] = False
    key[at], group[at], key[old], group[old] = b[0], b[1], a[0], a[1]
    return key, group


def _join(rows: pa.Table) -> pa.Table:
    """A bucket's new entries (run -1), as a sorted run, merge-joined with the history's runs.

    Rows: for each group the keys that it shares with a place of the new run, or has twice in it; and, under the
    bucket's number turned negative, the new run.
    """
    number = np.asarray(rows.column("run"))
    pick = lambda k: _arrays(rows.filter(pa.array(number == k)))
    keys, groups = unique_entries(*pick(-1))
    new = keys[0], groups
    every = new
    if (number >= 0).any():
        for k in sorted({*number.tolist()} - {-1}, reverse=True):  # the latest runs are the smallest
            past, own = pick(k)
            every = merge((past[0], own), every)
    many, _ = several([every[0]], every[1])
    at = np.minimum(np.searchsorted(new[0], every[0]), max(0, len(new[0]) - 1))
    fresh = new[0][at] == every[0] if len(new[0]) else np.zeros(len(every[0]), bool)
    out = told([every[0]], every[1], many & fresh)
    if len(new[0]):
        run_row = [-rows.column("bucket")[0].as_py() - 1, new[0].tobytes(), None, new[1].tobytes()]
        out = [[*c, x] for c, x in zip(out, run_row, strict=True)]
    return _rows(out)


class FingerprintIndex:
    """Sorted immutable runs of the history's fingerprints, and the history's texts, in one folder.

    The folder holds a table for each run, one for each batch's texts, and numbered states, of which the last whole
    one counts: a batch that fails midway leaves no trace in it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict) -> None:
        self.spark, self.path, self.state = spark, path, state

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int) -> FingerprintIndex:
        out = cls(spark, path, {"version": 0, "buckets": buckets, "next_group": 0, "entries": 0, "runs": [], "texts": []})
        out._keep()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as its last whole state has it."""
        jvm = spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{path}/state/*/_SUCCESS")
        found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top) or []
        names = sorted(str(x.getPath().getParent().getName()) for x in found)
        if not names:
            raise FileNotFoundError(f"no index at {path}")
        return cls(spark, path, json.loads(spark.read.text(f"{path}/state/{names[-1]}").first()[0]))

    def _keep(self) -> None:
        self.state["version"] += 1
        one = self.spark.range(0, 1, 1, 1).select(F.lit(json.dumps(self.state)).alias("value"))  # needs no Python worker of another kind
        one.write.text(f"{self.path}/state/{self.state['version']:09d}")

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.path}/{name}")

    def history(self) -> DataFrame | None:
        """(run, bucket, k1, k2, groups) of all runs."""
        out = None
        for i, name in enumerate(self.state["runs"]):
            one = self._run(name).withColumn("run", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out

    def texts(self) -> DataFrame | None:
        """(group_, text_) of all documents that were kept."""
        names = self.state["texts"]
        return self.spark.read.schema("group_ int, text_ binary").parquet(*(f"{self.path}/{x}" for x in names)) if names else None

    def append(self, level0: DataFrame) -> DataFrame:
        """Merge-joins a batch's entries with the history, adds them as a run, and returns the hits.

        Hits are (group, k1, k2): of each group, old ones too, the fingerprints with several places, one of them in
        the batch. The batch's groups have to be above those of the history.
        """
        rows = thinned(level0.select("bucket", "k1", "k2", "groups")).withColumn("run", F.lit(-1))
        past = self.history()
        rows = rows if past is None else rows.unionByName(past)
        found = written(rows.groupBy("bucket").applyInArrow(_join, ENTRIES), "joined")
        name = f"runs/{uuid.uuid4().hex}"
        found.where("bucket < 0").withColumn("bucket", -F.col("bucket") - 1).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.state["runs"].append(name)
        return found.where("bucket >= 0").select(F.col("bucket").alias("group"), "k1", "k2")

    def keep(self, rows: DataFrame, next_group: int) -> None:
        """Stores a batch's texts, for batches to come, and the state; compacts where there are many runs."""
        name = f"texts/{uuid.uuid4().hex}"
        rows.select("group_", "text_").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.state["texts"].append(name)
        self.state["next_group"] = next_group
        if len(self.state["runs"]) > MOST_RUNS:
            self.compact()
        else:
            self._keep()

    def compact(self) -> None:
        """Merges all runs into one, with more buckets where theirs have grown; the old ones are deleted."""
        past = self.history()
        if past is None:
            return
        entries_ = past.agg(F.sum(F.octet_length("groups") / 4)).first()[0] or 0
        buckets = self.state["buckets"]
        times = 1
        while entries_ > 2 * BUCKET_ENTRIES * buckets * times:
            times *= 2

        def one(rows: pa.Table) -> pa.Table:
            number, every = np.asarray(rows.column("run")), None
            for k in sorted({*number.tolist()}, reverse=True):
                keys, groups = _arrays(rows.filter(pa.array(number == k)))
                every = (keys[0], groups) if every is None else merge((keys[0], groups), every)
            return pa.Table.from_batches([dealt([every[0]], every[1], buckets * times)])

        name = f"runs/{uuid.uuid4().hex}"
        past.groupBy("bucket").applyInArrow(one, ENTRIES).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        old, self.state["runs"], self.state["buckets"] = self.state["runs"], [name], buckets * times
        self._keep()
        for x in old:
            delete(self.spark, f"{self.path}/{x}")


def beside(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents (kind 1, history's 2) of each group after the hits (kind 0) of that group, by partition."""
    told_ = hits.select(F.col("group").alias("group_"), F.lit(0).alias("kind_"), F.col("k1").alias("k1_"), F.col("k2").alias("k2_"))
    return docs.unionByName(told_, allowMissingColumns=True).select("group_", "kind_", "k1_", "k2_", "text_", "null_", "row_").repartition("group_").sortWithinPartitions("group_", "kind_")


def by_group(batches) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray], pa.RecordBatch, int]]:
    """(group, its hits, some of its documents, their kind) of what beside() gives."""
    group, keys = -1, ([], [])
    for batch in batches:
        own, kind = np.asarray(batch.column("group_")), np.asarray(batch.column("kind_"))
        edges = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(own)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b == a:
                continue
            if own[a] != group:
                group, keys = int(own[a]), ([], [])
            part = batch.slice(a, b - a)
            if kind[a] == 0:
                for k, c in zip(keys, ("k1_", "k2_"), strict=True):
                    k.extend(np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist() if x)
            else:
                yield group, tuple(np.concatenate([np.zeros(0, np.uint64), *k]) for k in keys), part, int(kind[a])


def candidates(texts: list[bytes], known: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts with windows whose fingerprint is known: number, words, such windows' first words, fingerprints, text hashes."""
    import xxhash

    for part in chunks(texts) if len(known) else ():
        owner, place, key = anchors(texts[part])
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        inside = np.arange(len(owner)) - np.searchsorted(owner, owner)
        owner, inside, key = owner[hit], inside[hit], key[hit]
        edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            number = part.start + int(owner[a])
            words = texts[number].split()
            line = b" ".join(words)
            length = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(length + 1) - 1
            begin = end - length
            first = inside[a:b]
            digest = xxhash.xxh3_64_intdigest
            text_hash = np.fromiter((digest(line[i:j]) for i, j in zip(begin[first].tolist(), end[first + WINDOW - 1].tolist(), strict=True)), np.uint64, len(first))
            yield number, words, first, key[a:b], text_hash


def result(n: int, removed: int, kept: bytes) -> tuple[int, int, str]:
    return n, removed, hashlib.sha256(kept).hexdigest()


def whole(text: bytes) -> tuple[int, int, str]:
    """The result of a text that loses nothing."""
    words = text.split()
    return result(len(words), 0, b" ".join(words))


DONE = "n_words long, n_removed long, kept_sha256 string"
_DONE = [pa.int64(), pa.int64(), pa.string()]


def remove_repeats(docs: DataFrame, text: str = "text", batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """docs with n_words, n_removed and kept_sha256, and the text without repeated windows.

    A text that loses nothing stays as it is, a null text null; in others the kept words are joined by one
    blank. kept_sha256 is the digest of the kept words joined by one blank in any case. A window repeats if its
    words start anywhere else in docs: in another row, equal rows and rows with equal or null keys included, or
    elsewhere in the same text, overlapping or not. Texts of fewer than WINDOW words lose nothing, and long ones are
    searched whole. Columns of docs named as the three are replaced; an empty table gives an empty result.

    With an index docs is a new batch: a window also repeats if it starts in a text of the index's history, which
    stays as it is; then docs are added to the history, as they were. Without one, docs are taken in so many
    batches by an index that is forgotten.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    spark, keep = docs.sparkSession, index is not None
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(64, size // GROUP_BYTES)
    if index is None:
        index = FingerprintIndex.create(spark, _fresh(spark, "index"), max(64, size // (60 * BUCKET_ENTRIES)))
    batches, first, buckets, past = (1 if keep else batches), index.state["next_group"], index.state["buckets"], index.texts()
    rows = grouped(docs, text, groups, first)
    level0 = written(entries(rows, buckets, batches, first, groups), "level0")
    known = None
    for b in range(batches):
        hits = index.append(level0.where(F.col("batch") == b))
        known = hits if known is None else known.unionByName(hits)
    if keep:
        index.keep(rows, first + groups)
    every = rows.withColumn("kind_", F.lit(1))
    if past is not None:  # of the history only groups that are told something
        old = past.join(known.where(F.col("group") < first).select(F.col("group").alias("group_")).distinct(), "group_", "left_semi")
        every = every.unionByName(old.withColumn("kind_", F.lit(2)), allowMissingColumns=True)
    row_type = rows.schema["row_"].dataType.simpleString()
    out_schema = f"open int, group_ int, text_ binary, null_ boolean, row_ {row_type}, {DONE}, {ENTRIES}"
    arrow_row: list[pa.DataType] = []

    def table_of(docs_part, at, open_, group, texts, done, entry=None):
        row = docs_part.column("row_").take(pa.array(at, pa.int64())) if docs_part is not None else None
        n = len(at) if row is not None else len(entry)
        if row is not None and not arrow_row:
            arrow_row.append(row.type)
        cols = [pa.array([open_] * n, pa.int32()), pa.array([group] * n, pa.int32()), pa.array(texts, pa.binary()) if row is not None else pa.nulls(n, pa.binary()), docs_part.column("null_").take(pa.array(at, pa.int64())) if row is not None else pa.nulls(n, pa.bool_()), row if row is not None else pa.nulls(n, arrow_row[0])]
        cols += [pa.array([d[k] for d in done], t) for k, t in enumerate(_DONE)] if done else [pa.nulls(n, t) for t in _DONE]
        cols += entry.columns if entry is not None else [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["open", "group_", "text_", "null_", "row_", "n_words", "n_removed", "kept_sha256", "bucket", "k1", "k2", "groups"])

    def look(batches):
        """open 0: documents that are done; 1: documents with candidates; 2: the candidates' entries."""
        held: list[tuple] = []
        size_held = 0

        def unique() -> list[tuple]:
            keys, own = unique_entries([np.concatenate([h[k] for h in held]) for k in (0, 1)], np.concatenate([h[2] for h in held]))
            return [(*keys, own)]

        def flush():
            (*keys, own), = unique()
            return table_of(None, (), 2, None, None, None, dealt(keys, own, buckets))

        for group, (known, _), part, kind in by_group(batches):
            known = np.unique(known)
            for piece in pieces(part):
                texts = piece.column("text_").to_pylist()
                open_ = set()
                for number, _, _, key, text_hash in candidates(texts, known):
                    open_.add(number)
                    held.append((key, text_hash, np.full(len(key), group, np.uint32)))
                    size_held += len(key)
                if kind == 2:  # the history's documents stay as they are
                    continue
                shut = [k for k in range(len(texts)) if k not in open_]
                yield table_of(piece, shut, 0, group, [texts[k] for k in shut], [whole(texts[k]) for k in shut])
                if open_:
                    yield table_of(piece, sorted(open_), 1, group, [texts[k] for k in sorted(open_)], None)
                if size_held > BUCKET_ENTRIES:
                    held = unique()  # copies in a group become few
                    size_held = len(held[0][0])
                    if size_held > BUCKET_ENTRIES // 2:
                        yield flush()
                        held, size_held = [], 0
        if held:
            yield flush()
        rest()

    looked = written(beside(every, known).mapInArrow(look, out_schema), "looked")
    verified = looked.where("open = 2").select("bucket", "k1", "k2", "groups").groupBy("bucket").applyInArrow(_verify, ENTRIES).select(F.col("bucket").alias("group"), "k1", "k2")

    def settle(batches):
        for group, (k1, k2), part, _ in by_group(batches):
            order = np.lexsort([k1, mixed(k1) + k2])
            k1, k2 = k1[order], k2[order]
            known, both = np.unique(k1), mixed(k1) + k2
            for piece in pieces(part):
                texts = piece.column("text_").to_pylist()
                kept, done = list(texts), [None] * len(texts)
                for number, words, first, key, text_hash in candidates(texts, known):
                    wanted, sure = mixed(key) + text_hash, np.zeros(len(key), bool)
                    at = np.searchsorted(both, wanted)
                    while True:  # sums may be equal where the two hashes are not
                        inside = at < len(both)
                        inside[inside] = both[at[inside]] == wanted[inside]
                        if not inside.any():
                            break
                        sure[inside] |= (k1[at[inside]] == key[inside]) & (k2[at[inside]] == text_hash[inside])
                        at = np.where(inside, at + 1, len(both))
                    first = first[sure]
                    if not len(first):
                        continue
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + WINDOW, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    left = b" ".join([words[k] for k in np.flatnonzero(stay)])
                    kept[number], done[number] = left, result(len(words), int((~stay).sum()), left)
                for k, d in enumerate(done):
                    if d is None:
                        done[k] = whole(texts[k])
                yield table_of(piece, range(len(texts)), 0, group, kept, done)
        rest()

    again = looked.where("open = 1").select("group_", "text_", "null_", "row_", F.lit(1).alias("kind_"))
    final = looked.where("open = 0").unionByName(beside(again, verified).mapInArrow(settle, out_schema))
    return final.select(*("row_." + c for c in docs.columns if c != text), F.when(~F.col("null_"), F.col("text_").cast("string")).alias(text), "n_words", "n_removed", "kept_sha256")
