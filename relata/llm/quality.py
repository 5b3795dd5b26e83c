"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Tokens are runs of letters or digits and runs of other signs, in lower case; features are hashes of single tokens
and of neighbours into BINS bins. Two multinomials are counted over them, one over all documents, one over
trusted ones. A document's score is the mean logarithm of the ratio of its features' probabilities, and every
document is judged by one fixed threshold. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

BINS = 1 << 14
#: The trusted multinomial is counted over so many labelled documents at most, by the order of a hash.
MOST_TRUSTED = 20_000
#: Added to each bin of both multinomials, the raw one at the trusted one's size: what neither can tell weighs nothing.
SMOOTHING = 1.0
#: Natural logarithms a feature. Text like the target is near 0 or above.
THRESHOLD = -0.30

SPACE = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def gram(words: Column, i: Column) -> Column:
    return F.struct(*(F.get(words, i + k) for k in range(3)))


def repeated(words: Column) -> Column:
    """Words in three-word windows found twice or more in the text.

    Windows are compared by 64-bit hashes; only where two are equal, windows are sorted with their places and
    neighbours compared in full.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ordered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def flagged(rows: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (gram(words, a["i"]) == gram(words, b["i"]))
        found = F.filter(rows, lambda x, k: F.coalesce(same(x, F.get(rows, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, k + 1)), F.lit(False)))
        starts = F.sort_array(F.transform(found, lambda x: x["i"]))
        return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])

    counted = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == n - 2, F.lit(0)).otherwise(bound(ordered(h), flagged)))
    return F.when(n < 3, F.lit(0)).otherwise(counted).cast("long")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used and wherever the optimiser moves the whole."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text is empty."""

    def counts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        dup = bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        symbols = (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long")
        return bound(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"), repeated(w).alias("n_repeat_words")))

    failed = lambda c: (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return bound(bound(F.coalesce(text, F.lit("")), counts), lambda c: F.struct(*(c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed(c).alias("base_failed")))


def features(text: Column) -> Column:
    """Bins of a text's tokens and of its pairs of neighbouring tokens."""
    tokens = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))
    bins = lambda hashes: F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(BINS)).cast("int")), F.transform(hashes, lambda h, i: F.when(i > 0, F.pmod(F.xxhash64(h, F.get(hashes, i - 1)), F.lit(BINS)).cast("int"))))
    return F.flatten(F.transform(F.array(tokens), bins))


def trusted_ids(labels: DataFrame, key: str = "doc_id", quality: str = "quality", most: int = MOST_TRUSTED) -> DataFrame:
    """At most ``most`` distinct ids of documents that are labelled as good."""
    return labels.where((F.col(quality) == 1) & F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(most)


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", smoothing: float = SMOOTHING) -> list[float]:
    """BINS logarithms of the ratio of the trusted and the raw multinomial; raw counts are over all of docs.

    trusted has ids, at most MOST_TRUSTED rows, and is broadcast for that bound. Without trusted documents every
    logarithm is 0, so that the method keeps all.
    """
    good = F.broadcast(trusted.select(F.col(key).alias("good_")).distinct())
    found = docs.select(key, text).join(good, F.col(key) == F.col("good_"), "left").select(F.col("good_").isNotNull().cast("int").alias("good_"), F.explode_outer(features(F.coalesce(F.col(text), F.lit("")))).alias("bin"))  # from an inner one Spark infers a filter that computes the features twice
    counts = found.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("raw"), F.sum("good_").alias("good")).collect()  # at most BINS rows
    import math

    raw, target = [0.0] * BINS, [0.0] * BINS
    for b, n, g in counts:
        raw[b], target[b] = float(n), float(g)
    if not sum(target):
        return [0.0] * BINS
    share = sum(target) / sum(raw)
    return [math.log(t + smoothing) - math.log(r * share + smoothing) for r, t in zip(raw, target, strict=True)]


def score(text: Column, weights: list[float]) -> Column:
    """Mean weight of a text's features; 0 without any. The weights are one constant, folded by the optimiser."""
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    total = lambda bins: F.aggregate(bins, F.lit(0.0), lambda a, b: a + F.coalesce(F.get(table, b), F.lit(0.0)))
    mean = lambda bins: F.when(F.size(bins) > 1, total(bins) / (F.size(bins) - 1)).otherwise(0.0)  # noqa: E731  the first pair is null
    return F.aggregate(F.array(features(text)), F.lit(0.0), lambda _, bins: mean(bins))


def judge(docs: DataFrame, weights: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, llr and kept for every row.

    A null text counts as empty: no words, base_failed. kept is false where base_failed, else whether llr reaches
    the threshold. Repeated rows are judged alike; columns of docs named as the new ones are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    llr = lambda c: F.when(~c["base_failed"], score(F.coalesce(F.col(text), F.lit("")), weights))
    facts = bound(base(F.col(text)), lambda c: bound(llr(c), lambda x: F.struct(*(c[n].alias(n) for n in names), x.alias("llr"), F.coalesce(x >= threshold, F.lit(False)).alias("kept"))))
    rest = docs.drop(*names, "llr", "kept")
    own = unused("facts", rest.columns)
    return rest.withColumn(own, facts).select(*rest.columns, f"{own}.*")
