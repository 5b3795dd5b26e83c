"""Licence scans: a trained paragraph classifier over word n-grams, with an unknown class and a template check.

A softmax regression over n-grams of one to three words is fitted on public licences' paragraphs, on their names in
usual phrases, and on a bounded sample of corpus paragraphs, which are both text that is no licence and the company
that notices keep. Phrases and paragraphs kept from training calibrate its probabilities and the least one that
tells a family; below it the class is unknown. A paragraph is a run of neighbouring sentences or lines with a word
of TRIGGERS, or a sentence, wrapped or not, with another of the model's anchors, and a line that one of those is
wrapped from or into. Anchors are words and pairs of words without which no text reaches the least probability,
whatever else it says: they are computed from the weights, so that leaving out the rest loses nothing. So are bounds
of what a paragraph's n-grams can add up to; those that reach the least probability are scored. Scoring is a join of paragraphs'
n-grams with the small table of weights. DataFrame functions only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import HELD, NAMES, OTHER, PARAGRAPHS, PHRASES
from .quality import bound

#: Corpus paragraphs the model is fitted on, of the documents with the least hashes, and characters of all of them.
MOST_PARAGRAPHS, MOST_CHARS = 2_000, 1 << 20
UNKNOWN = "unknown"
WORD = "[a-z0-9]+(?:\\.[0-9]+)*"
#: Least share of a paragraph's n-grams that its family's texts have, for a confirmed prediction.
CONFIRM = 0.5
#: Bounds of the least probability that tells a family.
LEAST = 0.5, 0.95
#: Bits of the table of bounds.
SLOTS = 15

#: Words that hold sentences of a notice together, and make a text without a known family ``unknown``.
TRIGGERS = "affero agpl agplv3 apache bsd bsl cc cc0 copyright copyrighted eclipse epl expat gnu gpl gplv2 gplv3 isc lgpl lgplv2.1 lgplv3 libpng licence licences licenced license licensed licensee licenses licensing licensor mozilla mpl merchantability noninfringement permission proprietary redistribute redistributed redistribution redistributions reproduced reserved spdx sublicense unencumbered unlicense warranties warranty wtfpl zlib creativecommons liable".split()


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def tokens(line: str) -> list[str]:
    return re.findall(WORD, line.lower())


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


class Rows:
    """Sets of features as two flat arrays, a constant feature at each one's end."""

    def __init__(self, rows: list[list[str]], place: dict[str, int]) -> None:
        found = [sorted({place[g] for g in grams(words) if g in place}) + [len(place)] for words in rows]
        self.flat = np.array([i for row in found for i in row], np.int64)
        self.begin = np.cumsum([0, *map(len, found)])[:-1].astype(np.int64)
        self.owner = np.repeat(np.arange(len(found)), [len(row) for row in found])

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.flat], self.begin, axis=0)

    def gradient(self, error: np.ndarray, size: int) -> np.ndarray:
        each = error[self.owner]
        return np.stack([np.bincount(self.flat, each[:, k], size) for k in range(error.shape[1])], 1)


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Classifier:
    """Weights by n-gram and class; class 0 is unknown."""

    def __init__(self, paragraphs: list[str], names: dict[str, list[str]] = NAMES, texts: dict[str, list[str]] = PARAGRAPHS, steps: int = 150) -> None:
        self.families = sorted({*names, *texts})
        prose = [w for w in map(tokens, paragraphs) if w and set(w).isdisjoint(TRIGGERS)]  # others may hold a notice
        train: list[tuple[list[str], int, float]] = []
        held: list[tuple[list[str], int]] = []
        company = iter(prose * (1 + 4000 // max(1, len(prose)))) if prose else iter(())

        def beside(words: list[str]) -> list[str]:
            """words with some prose before or behind."""
            some = next(company, [])[:30]
            return some + words if len(words) % 2 else words + some

        self.members = {}
        for k, family in enumerate(self.families, 1):
            own = [tokens(phrase.format(name)) for name in names.get(family, []) for phrase in PHRASES]
            whole = [tokens(text) for text in texts.get(family, [])]
            self.members[family] = {g for words in own + whole for g in grams(words)}
            cuts = [words[i : i + 16] for words in whole for i in range(0, max(1, len(words) - 8), 8)]
            share = 1.0 / (len(own) + 1), 1.0 / (len(whole) + len(cuts) + 1)
            train += [(words, k, share[0]) for words in own] + [(words, k, share[1]) for words in whole + cuts] + [(beside(words), k, share[1]) for words in whole + own[:: len(PHRASES)]]
            held += [(tokens(phrase.format(name)), k) for name in names.get(family, []) for phrase in HELD]
            held += [(words[len(words) // 3 :], k) for words in whole]
        nothing = [tokens(x) for x in OTHER]
        for i, words in enumerate(nothing):
            if i % 3:
                train += [(words, 0, 0.5), (beside(words), 0, 0.5)]
            else:
                held += [(words, 0), (beside(words), 0)]
        train += [(words, 0, 4.0 / len(prose)) for words in prose[::2]] + [([w], 0, 0.2) for w in sorted({*TRIGGERS} - {"agplv3", "gplv2", "gplv3", "wtfpl", "unlicense"})]
        held += [(words, 0) for words in prose[1::2][:500]]
        counted: dict[str, set[str]] = {}
        for family, found in self.members.items():
            for g in found:
                counted.setdefault(g, set()).add(family)
        self.only = {f: {g for g in found if counted[g] == {f}} for f, found in self.members.items()}
        self.vocabulary = sorted({*counted, *(g for words in nothing for g in grams(words))})
        place = {g: i for i, g in enumerate(self.vocabulary)}
        x, y = Rows([r[0] for r in train], place), np.eye(len(self.families) + 1)[[r[1] for r in train]]
        weight = np.array([r[2] for r in train])[:, None]
        w, past = np.zeros((len(place) + 1, y.shape[1])), np.full((len(place) + 1, y.shape[1]), 1e-6)
        # n-grams of one prose paragraph in a hundred tell nothing, unless a licence's name has them
        lines = Counter(g for words in prose for g in {*grams(words)})
        named = {g for found in names.values() for name in found for g in grams(tokens(name))}
        tells = np.array([g in named or 100 * lines[g] < len(prose) or not lines[g] for g in self.vocabulary] + [True])[:, None]
        for _ in range(steps):  # AdaGrad on all rows
            step = tells * (x.gradient(weight * (softmax(x.logits(w)) - y), len(w)) + 1e-3 * w)
            past += step * step
            w -= 0.3 * step / np.sqrt(past)
        z, own = Rows([h[0] for h in held], place), np.array([h[1] for h in held])
        logits = z.logits(w)
        heat = min((-np.log(softmax(logits / t)[np.arange(len(own)), own] + 1e-12).mean(), t) for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0))[1]
        self.weights = np.round(w / heat, 6)
        p = softmax(z.logits(self.weights))
        told = p[own == 0, 1:].max(1)
        worst = float(np.quantile(told, 0.99)) if len(told) else 0.0
        self.least = min(LEAST[1], max(LEAST[0], worst + 0.02))
        #: Of held-out phrases and paragraphs: the share that gets its own family, and of text that is no licence, unknown.
        self.anchors = self._anchors(lines)
        said = np.where(p[:, 1:].max(1) >= self.least, p[:, 1:].argmax(1) + 1, 0)
        self.recall, self.silence = float((said == own)[own > 0].mean()), float((said == 0)[own == 0].mean())

    def _anchors(self, seen: dict[str, int]) -> list[str]:
        """Words and pairs of words of which every text that gets a family has one; what prose often has is spared.

        A family needs a logit above unknown's by that of the least probability. What n-grams without an anchor can add
        up to stays below it for every family, even if a text held them all and nothing against it.
        """
        gain = self.weights[:, 1:] - self.weights[:, :1]
        room = np.log(self.least / (1 - self.least)) - 0.01 - gain[-1]
        left = [{x for x in grams(g.split(" ")) if x.count(" ") < 2} for g in self.vocabulary]
        holds: dict[str, list[int]] = {}
        for i, found in enumerate(left):
            for part in found:
                holds.setdefault(part, []).append(i)
        out = []
        for part in sorted(holds, key=lambda g: (-seen[g], g)):
            bare = [i for i in holds[part] if left[i] == {part}]  # what else is in them is spared
            more = np.maximum(gain[bare], 0).sum(0)
            if (more < room).all():
                room = room - more
                for i in holds[part]:
                    left[i].discard(part)
            else:
                out.append(part)
        return out

    def bounds(self) -> tuple[bytearray, float]:
        """The most that an n-gram can add for any family, by the last bits of its CRC-32, and what a family needs.

        In whole steps of 1 / 127 of the greatest, rounded up; n-grams that share a place share the greatest, and others
        that fall there get it too, so that no sum is too small.
        """
        gain = self.weights[:, 1:] - self.weights[:, :1]
        most = np.maximum(gain[:-1].max(1), 0)
        step = max(float(most.max()), 1e-6) / 127
        out = bytearray(1 << SLOTS)
        for g, x in zip(self.vocabulary, most, strict=True):
            at = zlib.crc32(g.encode()) % len(out)
            out[at] = max(out[at], min(127, int(np.ceil(x / step))))
        return out, float((np.log(self.least / (1 - self.least)) - 0.01 - gain[-1].max()) / step)

    def predict(self, paragraph: str) -> tuple[str, float]:
        """Family and probability of one paragraph, as the scan finds them."""
        p = softmax(Rows([tokens(paragraph)], {g: i for i, g in enumerate(self.vocabulary)}).logits(self.weights))[0]
        best = int(p[1:].argmax()) + 1
        return (self.families[best - 1] if p[best] >= self.least else UNKNOWN), float(p[best])


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_PARAGRAPHS, chars: int = MOST_CHARS) -> list[str]:
    """At most ``most`` distinct paragraphs, of ``chars`` characters in all, of the documents with the least hashes.

    A bounded sample to fit on; a paragraph beyond the bound is cut there.
    """
    few = docs.where(F.col(text).isNotNull()).select(F.xxhash64(key).alias("h_"), F.col(key).alias("picked_")).orderBy("h_", "picked_").limit(most // 10)
    lines = docs.join(F.broadcast(few.select("picked_").distinct()), F.col(key).eqNullSafe(F.col("picked_"))).select(F.explode(F.split(text, "\n")).alias("line")).distinct()
    lines = lines.select(F.xxhash64("line").alias("h_"), F.substring("line", 1, chars // most).alias("line"))
    return [r[1] for r in lines.orderBy("h_", "line").limit(most).collect()]


def holds_any(words: Column, parts: list[str]) -> Column:
    """True where words hold one of the parts, which are words and pairs of words."""
    some = lambda n: F.split(F.lit("\n".join(x for x in parts if x.count(" ") == n)), "\n")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.coalesce(F.arrays_overlap(words, some(0)), F.lit(False)) | F.coalesce(F.arrays_overlap(pairs, some(1)), F.lit(False))


def segments(text: Column, anchors: list[str]) -> Column:
    """Array of (line, text): runs of sentences with a trigger, others with an anchor, and what they are wrapped from or into."""
    triggers = F.split(F.lit(" ".join(TRIGGERS)), " ")
    kind = lambda words: F.when(F.arrays_overlap(words, triggers), 2).when(holds_any(words, anchors), 1).otherwise(0)
    unit = lambda u, i: F.struct(i.alias("line"), u.alias("text"), bound(tokens_of(u), kind).alias("hit"), u.rlike("[.!?;:]\\s*$").alias("ends"))
    units = F.flatten(F.transform(F.split(text, "\n"), lambda line, i: F.transform(F.split(line, "(?<=[.!?;])[ \\t]+"), lambda u: unit(u, i))))
    before = lambda all_, i: F.when(i > 0, F.when(~F.get(all_, i - 1)["ends"], F.get(all_, i - 1)["hit"]))
    after = lambda all_, u, i: F.when(~u["ends"], F.get(all_, i + 1)["hit"])
    marked = bound(units, lambda all_: F.transform(all_, lambda u, i: u.withField("kind", F.greatest(u["hit"], before(all_, i), after(all_, u, i)))))
    # an empty line cuts: between kinds, and behind a sentence that has no trigger near
    cut = lambda all_, u, i: (u["kind"] != F.coalesce(F.get(all_, i + 1)["kind"], F.lit(0))) | ((u["kind"] == 1) & u["ends"])
    line = lambda all_, u, i: F.when(u["kind"] > 0, F.concat(u["line"].cast("string"), F.lit("\t"), u["text"], F.when(cut(all_, u, i), "\n").otherwise(""))).otherwise("")
    joined = bound(marked, lambda all_: F.array_join(F.transform(all_, lambda u, i: line(all_, u, i)), "\n"))
    parts = F.filter(F.split(joined, "\n{2,}"), lambda x: x.rlike("\\S"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^\\n?([0-9]+)\t", 1).cast("int").alias("line"), F.regexp_replace(x, "(?m)^[0-9]+\t", "").alias("text")))


def scan(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_paragraphs, n_licences, family, probability, confirmed and line for every row of docs.

    n_paragraphs counts lines with a word. n_licences counts paragraphs of a known family; family, probability,
    confirmed and line (from 0, the paragraph's first) tell of the likeliest one, confirmed ones first, then the
    earliest; without any, the family is ``unknown`` where a trigger occurs and null elsewhere, as for null and
    empty texts. Texts without any trigger are scored like others. A prediction is confirmed where the family's texts have CONFIRM of the paragraph's n-grams and one
    that no other family has. Texts are scanned whole. Equal rows are told alike, and a null key is a key. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    k = len(model.families) + 1
    members = [[float(g in model.members[f]) for f in model.families] for g in model.vocabulary]
    only = [next((i for i, f in enumerate(model.families) if g in model.only[f]), -1) for g in model.vocabulary]
    weights = F.broadcast(spark.createDataFrame([(g, [float(v) for v in w], m, o) for g, w, m, o in zip(model.vocabulary, model.weights[:-1], members, only, strict=True)], "gram string, w array<float>, m array<float>, o int"))  # as many rows as the texts to learn from have n-grams
    triggers = F.split(F.lit(" ".join(TRIGGERS)), " ")
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_")).withColumns({"hash_": F.xxhash64("text_", "key_"), "n_paragraphs": F.size(F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"\S"))).cast("long")})
    # outer explodes: from others Spark infers filters on what is exploded, and computes it anew where it moves them
    found = rows.where(bound(tokens_of(F.col("text_")), lambda words: F.arrays_overlap(words, triggers) | holds_any(words, model.anchors))).select("key_", "hash_", F.explode_outer(segments(F.col("text_"), model.anchors)).alias("s_")).where("s_ IS NOT NULL")
    some = lambda words, n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    most, needed = model.bounds()
    adds = lambda total, g: total + F.ascii(F.substring(F.lit(most), (F.crc32(g.cast("binary")) % len(most) + 1).cast("int"), 1).cast("string"))
    enough = lambda all_: F.when(F.aggregate(all_, F.lit(0), adds) >= needed, all_)
    grams_of = bound(tokens_of(F.col("s_.text")), lambda words: bound(F.array_distinct(F.concat(*(some(words, n) for n in (1, 2, 3)))), enough))
    # exploded at once: a filter on what lambdas give would be moved into them, and compute it for each element
    found = found.select("key_", "hash_", "s_.line", F.explode_outer(F.array(grams_of)).alias("grams")).where("grams IS NOT NULL").distinct()
    found = found.select("key_", "hash_", "line", F.size("grams").alias("all_"), F.explode_outer("grams").alias("gram")).join(weights, "gram")
    each = [F.sum(F.col("w")[i].cast("double")).alias(f"w{i}") for i in range(k)] + [F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(k - 1)]
    sums = found.groupBy("key_", "hash_", "line", "all_").agg(*each, F.collect_set(F.when(F.col("o") >= 0, F.col("o"))).alias("only_"))
    # lambdas bind the logits, their greatest and the sum, so that the plan holds each expression once
    logits = F.array(*(F.col(f"w{i}") + float(model.weights[-1, i]) for i in range(k)))
    share = F.array(*(F.col(f"m{i}") / F.col("all_") for i in range(k - 1)))
    names = F.split(F.lit("\n".join(model.families)), "\n")
    option = lambda x, s, top, total, i: F.struct(F.round(F.exp(F.get(x, i + 1) - top) / total, 6).alias("p"), F.get(names, i).alias("family"), ((F.get(s, i) >= CONFIRM) & F.array_contains("only_", i)).alias("confirmed"))
    options = lambda x, s, top, total: F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: option(x, s, top, total, i))
    summed = lambda x, top: F.aggregate(x, F.lit(0.0), lambda a, y: a + F.exp(y - top))
    likeliest = bound(share, lambda s: bound(logits, lambda x: bound(F.array_max(x), lambda top: bound(summed(x, top), lambda total: F.array_max(options(x, s, top, total))))))
    told = sums.select("key_", "hash_", "line", likeliest.alias("best")).where(F.col("best.p") >= model.least)
    best = told.groupBy("key_", "hash_").agg(F.count("*").alias("n_licences"), F.max_by(F.struct("best.family", F.col("best.p").alias("probability"), "best.confirmed", "line"), F.struct("best.confirmed", "best.p", -F.col("line"))).alias("b"))
    best = best.select(F.col("key_").alias("told_"), F.col("hash_").alias("of_"), "n_licences", "b")
    out = rows.select("key_", "hash_", "n_paragraphs", F.arrays_overlap(tokens_of(F.col("text_")), triggers).alias("near_")).join(best, (F.col("hash_") == F.col("of_")) & F.col("key_").eqNullSafe(F.col("told_")), "left")
    return out.select(F.col("key_").alias(key), "n_paragraphs", F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("b.family", F.when(F.col("near_"), F.lit(UNKNOWN))).alias("family"), F.col("b.probability").alias("probability"), F.coalesce("b.confirmed", F.lit(False)).alias("confirmed"), F.col("b.line").alias("line"))
