"""Mixing sources to target weights by entropy balancing.

Among all token rates with the wanted total for every source, the one closest to the corpus in relative entropy is
an exponential tilt of it, whose exponents solve a convex dual. Newton's iterations gather the dual's gradient and
Hessian from the documents, which are first counted by source and size; a document is in one source, so that the
Hessian is diagonal, and an iteration is one aggregation by source. They go on until no source is off by more than
TOLERANCE of its target. A document's tilted rate is then rounded into copies: whole ones, and one more where the
document's place in its source, by the order of a hash and in words, is below the rate's fraction; the document at
that place gives the part of its words that lies below.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import binary, n_words, numbered, over_batches, unused, written

#: Documents of one bucket in which running sums are taken.
BUCKET_ROWS = 1 << 16
#: Largest relative residual of a source's constraint.
TOLERANCE = 1e-12
#: Sources up to this number are joined by broadcast.
FEW_SOURCES = 100_000


@over_batches(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    return pa.array(n_words(texts))


def targets(sources: DataFrame, n: int, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources (skey_, source, source_size), n of them, with target, the words that the mix takes of each.

    Sources in code point order, null last, weigh weights[0], weights[1], ..., repeating. They share ``share``
    times all words; a target stops at ``most`` times its source, and what it leaves is shared again. That ends at
    min(most * size, level * weight) with one level for all. Rounds raise the level until no further source is above
    its stop; only sums reach the driver.
    """
    rows = numbered(sources, [F.col("source").isNull(), F.col("source")], n)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("number_", F.lit(len(weights))) + 1).cast("int"))
    rows = written(rows.select("skey_", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap_")), "weights")
    total, level = None, 0.0
    while True:
        over = F.col("cap_") < F.lit(level) * F.col("weight")
        all_, capped, open_ = rows.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap_"))), F.sum(F.when(~over, F.col("weight")))).first()
        total = share * (all_ or 0)
        now = (total - (capped or 0.0)) / open_ if open_ else level
        if now <= level:
            break
        level = now
    return rows.select("skey_", "source_size", F.least("cap_", F.lit(level) * F.col("weight")).alias("target"))


def tilted(sizes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """wanted (skey_, source_size, target) with rate, the exponential of the dual's solution.

    sizes has (skey_, size, docs_): how many documents of a source have a size. Newton's iteration on the dual, the
    sum of docs_ * size * exp(x) over the documents less target * x, begins at 0.
    """
    few = F.broadcast if n <= FEW_SOURCES else lambda x: x
    state = written(wanted.withColumn("x_", F.lit(0.0)), "dual")
    active = (F.col("source_size") > 0) & (F.col("target") > 0)
    while True:
        mass = sizes.join(few(state.where(active).select("skey_", "x_")), "skey_").groupBy("skey_").agg(F.sum(F.col("docs_") * F.col("size") * F.exp("x_")).alias("mass_"))
        # gradient mass - target over Hessian mass; a step is at most 1
        step = F.least(F.lit(1.0), (F.col("target") - F.col("mass_")) / F.col("mass_"))
        state = state.drop("mass_", "off_").join(mass, "skey_", "left").withColumn("off_", F.abs(F.col("mass_") - F.col("target")) / F.col("target"))
        state = written(state.withColumn("x_", F.when(F.col("off_") > TOLERANCE, F.col("x_") + step).otherwise(F.col("x_"))), "dual")
        if not (state.agg(F.max("off_")).first()[0] or 0.0) > TOLERANCE:
            break
    return state.select("skey_", "source_size", "target", F.when(active, F.exp("x_")).otherwise(0.0).alias("rate"))


def ordered(sized: DataFrame, n: int, key: str) -> DataFrame:
    """sized (key, source, size, ...) with the source's key, and the hash that orders its documents, in n ranges."""
    text = F.concat_ws("|", F.col(key).cast("string"), F.col("source"), F.col("size").cast("string"))
    hashed = sized.withColumns({"skey_": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "hash_": F.md5(text.cast("binary"))})
    return hashed.withColumn("bucket_", F.floor(F.conv(F.substring("hash_", 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(float(1 << 32))).cast("int"))


def buckets(rows: int) -> int:
    return max(256, rows // BUCKET_ROWS)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, key: str = "doc_id", text: str = "text", source: str = "source", places_too: bool = False) -> DataFrame:
    """key, source, size, source_size, target, rate and taken for every row of docs.

    size counts the words of the text (null: 0). taken is a number of words: copies times size, but for one
    document a source whose last copy is cut so that the source's words meet its target. Never more than
    ``most`` times size. Documents are in the order of md5 of key, source and size, so reruns agree; equal rows are
    told apart by nothing and share their places. A null source is a source, and a null key a key. Texts are counted
    whole; other columns are ignored. An empty table gives an empty result.
    """
    sized = written(docs.select(F.col(key), F.col(source).alias("source"), word_count(binary(text)).alias("size")), "sizes")
    sized = ordered(sized, buckets(sized.count()), key)
    sums = written(sized.groupBy("skey_", "bucket_", "source").agg(F.sum("size").alias("bucket_size_")), "sums")
    found = written(sums.groupBy("skey_", "source").agg(F.sum("bucket_size_").alias("source_size")), "sources")
    n = found.count()
    sizes = written(sized.groupBy("skey_", "size").agg(F.count("*").alias("docs_")), "docs")
    sources = tilted(sizes, targets(found, n, weights, share, most), n)
    sources = sources.withColumn("whole_", F.floor(F.col("rate") + 1e-9))
    # words of further copies: the rate's fraction of the source
    sources = sources.withColumn("rest_", F.round(F.round(F.col("rate") * F.col("source_size"), 3)).cast("long") - F.col("whole_") * F.col("source_size"))
    before = Window.partitionBy("skey_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("base_", F.coalesce(F.sum("bucket_size_").over(before), F.lit(0))).join(written(sources, "rates"), "skey_").drop("source", "bucket_size_")
    inside = Window.partitionBy("bucket_", "skey_").orderBy("hash_", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = sized.repartition("bucket_").withColumn("sum_", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = F.col("whole_") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest_") - F.col("base_") - F.col("sum_")))
    return dealt.join(places, ["bucket_", "skey_"]).select(key, "source", "size", "source_size", "target", "rate", taken.cast("long").alias("taken"), "skey_", "bucket_", "hash_", "whole_").drop(*([] if places_too else ["skey_", "bucket_", "hash_", "whole_"]))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, key: str = "doc_id", text: str = "text", source: str = "source", taken: str = "taken_", size: str = "size_") -> DataFrame:
    """docs with two columns, taken and size: how many of their words the mix takes, without moving the texts.

    In a source's order whole further copies go up to one document, whose last copy is cut; so a table of one such
    place a source tells every document what it gives. Rows equal to that document in key, source and size count
    like it. A null text has size 0; columns of docs named as the two are replaced; an empty table gives an empty
    result.
    """
    docs = docs.drop(taken, size)
    found = written(mix(docs, weights, share, most, key, text, source, places_too=True), "taken")
    place = F.struct("hash_", F.col(key).alias("key"), "size")
    extra = F.col("taken") - F.col("whole_") * F.col("size")
    cuts = found.groupBy("skey_").agg(F.max("whole_").alias("whole_"), F.max(F.when(extra > 0, F.struct(place.alias("place"), extra.alias("extra")))).alias("cut_"))
    counted = unused("count", docs.columns)
    rows = docs.withColumn(counted, word_count(binary(text)))
    own = ordered(rows.select(rows[key].alias(key), rows[source].alias("source"), F.col(counted).alias("size"), F.struct(*docs.columns).alias("row_")), 1, key)
    last = F.col("cut_.place")
    more = F.when(last.isNull(), 0).when(place < last, F.col("size")).when(place == last, F.col("cut_.extra")).otherwise(0)
    return own.join(written(cuts, "cuts"), "skey_").select("row_.*", F.col("size").alias(size), (F.col("whole_") * F.col("size") + more).cast("long").alias(taken))
