"""Vector expressions, pooling, pluggable text embedders, losses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalised(v: Column) -> Column:
    wide = v.cast("array<double>")
    return _once(F.sqrt(dot(wide, wide)) + EPSILON, lambda norm: F.transform(wide, lambda x: x / norm))


def zero_vector(size: int) -> Column:
    """What stands for a text without a vector."""
    return F.array_repeat(F.lit(0.0).cast("float"), size)


def prefix(v: Column, size: int) -> Column:
    """The first components, brought to length 1 again."""
    return l2_normalised(F.slice(v, 1, min(size, 1024)))


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, mean) of each component."""
    return rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("mean"))


def last_token(rows: DataFrame, key: str, place: str, vector: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(vector, place).alias(vector))


#: Tokens of a text that embedders see; what follows is cut on the right, as the models to embed with do.
MOST_TOKENS = 512


def tokenised(text: Column, most: int = MOST_TOKENS) -> Column:
    """A stand-in tokenizer: words at blanks, cut on the right after ``most``."""
    return F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, most)


def token_ids(text: Column, size: int = 30_522, most: int = MOST_TOKENS) -> Column:
    """Ids of the stand-in tokenizer's words, from 1 to size - 1: a hash of each; 0 is the pad."""
    return F.transform(tokenised(text, most), lambda w: (F.pmod(F.crc32(w.cast("binary")), F.lit(size - 1)) + 1).cast("int"))


def padded(rows: DataFrame, batch: str, ids: str = "ids") -> DataFrame:
    """rows with ids padded by 0 to the longest of their batch, and mask, 1 where a token is."""
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("longest_"))
    wide = rows.join(longest, batch)
    fill = F.col("longest_") - F.size(ids)
    mask = F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), fill))
    return wide.withColumns({"mask": mask, ids: F.concat(ids, F.array_repeat(F.lit(0), fill))}).drop("longest_")


def hashing_embedder(size: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder that needs no model: signed counts of byte trigrams by hash, of length 1.

    A trigram's hash is its three bytes, with two blanks before and one behind the text, as a number times a fixed
    odd number modulo 2 ** 32; the hash modulo size is the component, its highest bit the sign.
    """

    def embed(texts: list[str]) -> np.ndarray:
        lines = [f"  {t} ".encode() for t in texts]
        data = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint32)
        length = np.array([len(x) for x in lines])
        owner = np.repeat(np.arange(len(lines)), length)[:-2] if len(data) > 2 else np.zeros(0, np.int64)
        inside = np.concatenate([np.arange(n) < n - 2 for n in length])[:-2] if len(data) > 2 else np.zeros(0, bool)
        h = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]).astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) if len(data) > 2 else np.zeros(0, np.uint64)
        h, owner = h[inside], owner[inside]
        place = owner * size + (h % np.uint64(size)).astype(np.int64)
        out = np.bincount(place, np.where(h >> np.uint64(31), 1.0, -1.0), len(texts) * size).reshape(len(texts), size)
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + EPSILON)).astype(np.float32)

    return embed


def embed(texts: DataFrame, column: str, embedder: Callable[[list[str]], np.ndarray], chunk: int = 256) -> DataFrame:
    """texts, distinct ones, with embedding, and failed, whether the embedder failed on the text.

    A chunk on which it fails is tried text by text, so that only texts it can't embed have a null vector; a null
    text has one too. Runs of failures are told by the column.
    """

    def one(text: str):
        try:
            return embedder([text]).tolist()[0]
        except Exception:  # an embedder is foreign code; failed tells
            return None

    @arrow_udf("embedding array<float>, failed boolean")
    def run(batch: pa.Array) -> pa.Array:
        rows = []
        for i in range(0, len(batch), chunk):
            part = batch.slice(i, chunk).to_pylist()
            known = [t for t in part if t is not None]
            try:
                found = iter(embedder(known).tolist() if known else [])
            except Exception:
                found = iter([one(t) for t in known])
            rows += [(None, False) if t is None else (v := next(found), v is None) for t in part]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float32())), pa.array([r[1] for r in rows], pa.bool_())], ["embedding", "failed"])

    return texts.select(column).distinct().withColumn("found_", run(column)).select(column, "found_.*")


def embed_one(text: str, embedder: Callable[[list[str]], np.ndarray]) -> list[float]:
    """One text's vector, on the driver."""
    return np.asarray(embedder([text]), np.float32)[0].tolist()


@arrow_udf(BinaryType())
def halved(vectors: pa.Array) -> pa.Array:
    """Vectors as little-endian half-precision numbers, two bytes a component; null stays null."""
    return pa.array([None if v is None else np.array(v, "<f2").tobytes() for v in vectors.to_pylist()], pa.binary())


def with_vectors(cells: DataFrame, vocabulary: DataFrame, described: DataFrame, size: int) -> DataFrame:
    """cells with text_vector, that of their text's embedding, and column_vector, that of their column's description.

    vocabulary has txt and embedding, described column_idx and vector, one row for each column, which the schema
    bounds and which is broadcast. Cells without a text, and texts without a vector, have the zero vector.
    """
    known = vocabulary.select("txt", F.col("embedding").alias("text_vector"))
    text = cells.where("txt IS NOT NULL").join(known, "txt", "left")
    rest = cells.where("txt IS NULL").withColumn("text_vector", F.lit(None).cast("array<float>"))
    both = text.select(*rest.columns).unionByName(rest).withColumn("text_vector", F.coalesce("text_vector", zero_vector(size)))
    return both.join(F.broadcast(described.select("column_idx", F.col("vector").alias("column_vector"))), "column_idx", "left").withColumn("column_vector", F.coalesce("column_vector", zero_vector(size)))


def huber(predicted: Column, target: Column) -> Column:
    d = F.abs(predicted - target)
    return F.when(d <= 1, 0.5 * d * d).otherwise(d - 0.5)


def bce_logits(logit: Column, z: Column) -> Column:
    """Binary cross-entropy; the target is true where its z-score is above 0."""
    return F.greatest(logit, F.lit(0.0)) - logit * (z > 0).cast("double") + F.log1p(F.exp(-F.abs(logit)))


def typed_loss(kind: Column, predicted: Column, z: Column) -> Column:
    return F.when(kind.isin(0, 2), huber(predicted, z)).when(kind == 3, bce_logits(predicted, z)).otherwise(0.0)


def masked_mean(loss: Column, mask: Column) -> Column:
    """Null without masked cells; text adds to the denominator only."""
    return F.try_divide(F.sum(F.when(mask, loss).otherwise(0.0)), F.sum(mask.cast("double")))
