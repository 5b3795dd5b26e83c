"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents become pieces in one pass (ids, CRC, length). Only the number of pieces of each length, at most
``capacity`` numbers, reaches the driver. There the plan is made: exact complements of one, two and three
lengths are looked up by their sum under the availability counts and consumed as often as they fit, the rest
is packed best-fit. The plan says for every length which ranks go to which sequences; pieces learn their rank
within their length by two-level counting and look their place up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import at_rest, values, written
from .merges import Merges

#: What a worker remembers of the ids of words of one generation; there are two, and the older one is then forgotten.
CACHE_BYTES = 48 << 20
#: Rows of one bucket in which ranks are counted.
BUCKET_ROWS = 1 << 18
#: Bytes of text whose words are told apart at once; a longer text is one such part.
CHUNK = 1 << 22

PIECES = "piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, as little-endian bytes.

    The file's pattern begins a token at every blank that follows a non-blank, so that a text is encoded word
    by word: a word is a blank with the non-blanks behind it. A text where blanks meet other white space, or that
    begins or ends with white space, is encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.forget()
        self.blank = np.zeros(self.model.get_vocab_size(), bool)
        self.blank[[i for t, i in self.model.get_vocab().items() if t.startswith("Ġ")]] = True  # how byte-level files write a blank
        self.split = all(self._pack(self.model.encode(a + b, add_special_tokens=False)) == self._pack(self.model.encode(a, add_special_tokens=False)) + self._pack(self.model.encode(b, add_special_tokens=False)) for a, b in (("one", " two"), ("a.", " 's"), ("é\n", " 9,"), ("x", " <|endoftext|>")))
        self.merges = Merges.of(path) if self.split else None
        if self.merges:  # a file whose merges the library applies in another way is left to the library
            some = [t[1:] for t in self.model.get_vocab() if t.startswith("Ġ") and t.isalpha() and t[1:].isascii()][:200]
            some += ["".join(some[k : k + 4]) + end for k in range(0, len(some), 4) for end in ("", ",", "7éŒ.")]
            self.learn(some)
            if any(self.words[w] != self.whole(f" {w}") for w in some):
                self.merges = None
            self.forget()

    def forget(self) -> None:
        """Drops what is remembered of words."""
        self.first: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = CACHE_BYTES

    @staticmethod
    def _pack(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.model.encode_batch_fast([text], add_special_tokens=False)[0])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text of a string array; null is the empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.diff(values(texts)[1])
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1).tolist(), len(texts)]
        return [x for a, b in zip(cuts, cuts[1:], strict=False) for x in self.some(texts.slice(a, b - a))]

    def some(self, texts: pa.Array) -> list[bytes]:
        """Words of several texts are told apart by Arrow, so that only distinct ones are looked up."""
        if not self.split or not len(texts):
            return [self.whole(t) if t else b"" for t in texts.to_pylist()]
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.array(coded.indices)
        begin = np.concatenate([[0], np.cumsum(np.array(pc.list_value_length(lists), np.int64))])
        unknown = set(words).difference(self.words)
        older = self.older
        again = [w for w in unknown if w in older]
        self.words.update((w, older[w]) for w in again)
        unknown.difference_update(again)
        odd = {w for w in unknown if not w or w[0].isspace() or w[-1].isspace()}
        unknown -= odd
        if unknown:
            self.learn(list(unknown))
        heads = [words[k] for k in place[begin[:-1]].tolist()]
        found = [*(self.words.get(w, b"") for w in words), *(b"" if w in odd else self.head(w) for w in heads)]
        place[begin[:-1]] = np.arange(len(words), len(found))  # a text's first word has no blank before it
        many = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, ids = np.cumsum(many) - many, np.frombuffer(b"".join(found), "<u4")
        n = many[place]
        end = np.cumsum(n)
        kind = np.int32 if max(end[-1], len(ids)) < 1 << 31 else np.int64
        line = ids[np.arange(end[-1], dtype=kind) + np.repeat((first[place] - end + n).astype(kind), n)]
        edge = np.concatenate([[0], end])[begin]
        data, at = line.tobytes(), (4 * edge).tolist()
        out = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        if odd:
            strange = np.append(np.array([w in odd for w in words]), [w in odd for w in heads])
            for k in np.flatnonzero(np.add.reduceat(strange[place], begin[:-1])).tolist():
                text = texts[k].as_py()
                out[k] = self.whole(text) if text else b""
        self.room -= sum(map(len, unknown)) + 170 * (len(unknown) + len(again))
        if self.room < 0:
            self.first, self.words, self.older, self.room = {}, {}, self.words, CACHE_BYTES
        return out

    def learn(self, words: list[str]) -> None:
        """Words hold no blank, so that in the ids of all of them a new word begins where a token begins with one."""
        if self.merges:
            known, data, edges, words = self.merges.words(words)
            self.words.update(zip(known, map(data.__getitem__, map(slice, edges, edges[1:])), strict=False))
            if not words:
                return
        ids = np.array(self.model.encode_batch_fast([f" {' '.join(words)}"], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.blank[ids])
        if len(at) != len(words):
            raise ValueError("a word has no token of its own that begins with a blank")
        data, edges = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
        self.words.update(zip(words, map(data.__getitem__, map(slice, edges, edges[1:])), strict=True))

    def head(self, word: str) -> bytes:
        """A text's first word has no blank before it."""
        if word not in self.first:
            self.first[word] = self.whole(word)
            self.room -= 5 * len(word) + 150
        return self.first[word]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of one document's ids; only the first of several pieces may be short."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        yield k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])


def pieces(docs: DataFrame, file: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) for every piece of every row; a null text has the end id alone."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        import public_tokenizers

        found = encoder(file if "/" in file else public_tokenizers.path(file))
        try:
            for batch in batches:
                for i in range(0, len(batch), 2048):
                    keys, rows = batch.column(0).slice(i, 2048), [(k, *x) for k, ids in enumerate(found.encode(batch.column(1).slice(i, 2048))) for x in cut(ids + tail, capacity)]
                    at, *cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=[key, "piece", "start", "length", "ids_crc32"])
        finally:  # the worker stays for other stages
            found.forget()
            at_rest()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {PIECES}")


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; they hold every piece once.

    counts[n] pieces have length n, 1 to capacity. Every use of a complement empties one of its lengths, so
    the number of patterns is bounded by the capacity in each step, however many pieces there are.
    """
    have = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> bool:
        need = defaultdict(int)
        for n in lengths:
            need[n] += 1
        times = min(int(have[n]) // k for n, k in need.items())
        if times:
            out.append((lengths, times))
            for n, k in need.items():
                have[n] -= k * times
        return bool(times)

    if have[capacity]:
        use(capacity)
    for n in range(capacity - 1, (capacity - 1) // 2, -1):  # single complements
        if have[n] and have[capacity - n]:
            use(n, capacity - n)

    def pair(total: int, most: int):
        """(a, b) with a + b = total, a <= most, both to be had; the largest a comes first."""
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        a = a[(have[a] > 0) & (have[total - a] > 0)] if len(a) else a
        return ((int(x), int(total - x)) for x in a)

    for n in range(capacity - 2, 0, -1):  # pair sums that fill the gap
        gap = capacity - n
        while have[n]:
            for a, b in pair(gap, capacity):
                if have[n] and have[a] and have[b]:
                    use(n, a, b)
            if not any(have[x] > (x == n) and have[y] > (y == n) + (x == y) for x, y in pair(gap, capacity)):
                break
    for n in range(capacity - 3, 0, -1):  # triple sums
        gap = capacity - n
        for a in range(min(n, gap - 2), (gap - 1) // 3, -1):
            if not have[n]:
                break
            if have[a]:
                for b, c in pair(gap - a, a):
                    if have[n] and have[a] and have[b] and have[c]:
                        use(n, a, b, c)
    # Best fit of the rest, longest first. Open sequences are kept as groups with equal contents.
    free: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for n in range(capacity, 0, -1):
        while have[n]:
            gap = next((g for g in range(n, capacity) if free.get(g)), None)
            if gap is None:
                fit = capacity // n
                times, rest = divmod(int(have[n]), fit)
                if times:
                    free[capacity - n * fit].append(((n,) * fit, times))
                if rest:
                    free[capacity - n * rest].append(((n,) * rest, 1))
                have[n] = 0
                break
            lengths, times = free[gap].pop()
            fit = gap // n
            full = min(times, int(have[n]) // fit)
            if full:
                free[gap - n * fit].append((lengths + (n,) * fit, full))
                have[n] -= full * fit
            if times > full and have[n]:
                rest = int(have[n])
                free[gap - n * rest].append((lengths + (n,) * rest, 1))
                have[n], full = 0, full + 1
            if times > full:
                free[gap].append((lengths, times - full))
    return out + [x for groups in free.values() for x in groups]


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: sorted keys (length, first rank), first sequence, offset."""
    taken, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n << 44 | int(taken[n]), sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    key, first, offset = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return {"key": key, "sequence": first, "offset": offset}


def ranked(parts: DataFrame, by: list[str]) -> DataFrame:
    """parts with rank, from 0, among the rows of a length; no task gets more than its share of a frequent length."""
    n = max(256, parts.count() // BUCKET_ROWS)
    dealt = parts.withColumn("bucket_", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket_").agg(F.count("*").alias("n_")).select("length", "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    inside = dealt.repartition("bucket_").withColumn("rank", F.row_number().over(Window.partitionBy("bucket_", "length").orderBy(*by)) - 1)
    return inside.join(base, ["length", "bucket_"]).withColumn("rank", F.col("rank") + F.col("base_")).drop("bucket_", "base_")


def pack(docs: DataFrame, file: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every row of docs into sequences of at most capacity tokens.

    Result, a row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset. A null text is the
    empty text, whose single token is the end id. Repeated rows, and rows with a null key, are packed each on
    its own; other columns of docs are ignored. Texts are encoded whole, however long; one text's ids have to fit a
    worker's memory. Pieces of one length take their places in the order of key, piece, start and CRC; pieces that
    are equal in all of these may change places. An empty table gives an empty result.
    """
    parts = written(pieces(docs, file, capacity, end, key, text), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in parts.groupBy("length").count().collect():  # at most capacity rows
        counts[n] = k
    where = slots(plan(counts, capacity), capacity)

    @arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        wanted = np.asarray(length, np.int64) << 44 | np.asarray(rank, np.int64)
        at = np.searchsorted(where["key"], wanted, "right") - 1
        return pa.StructArray.from_arrays([pa.array(where["sequence"][at] + wanted - where["key"][at]), pa.array(where["offset"][at])], ["sequence_id", "offset"])

    cols = [key, "piece", "start", "length", "ids_crc32"]
    return ranked(parts, [key, "piece", "start", "ids_crc32"]).withColumn("at_", place("length", "rank")).select(*cols, "at_.sequence_id", "at_.offset")
