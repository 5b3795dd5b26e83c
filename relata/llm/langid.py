"""Language identification by character models with interpolated Kneser-Ney smoothing, one for each language.

A text's words are its runs of letters, in lower case; a model predicts a word's characters and its end, each
from the ORDER - 1 before, where blanks stand before the word. Full-order counts come from all documents to
learn from; lower orders count the distinct characters that precede. Models are kept as sorted arrays of n-gram
hashes with one column a language: the discounted part of an n-gram, and the weight that its history leaves to
the next shorter one. A text gets the language of the lowest cross-entropy a character. Counts are summed by Spark
and reach the driver as packed arrays, 30 bytes for an n-gram of a language; every worker holds the models.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, unused, values

ORDER = 4
#: Distinct n-grams that a task holds before it hands on its counts; all counts are summed, none is dropped.
MOST_GRAMS = 500_000
#: Scales of the score among which the likeliest for the documents to learn from is taken.
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
#: What a worker remembers of the scores of recent words; it is emptied beyond that.
CACHE_WORDS = 250_000

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letters(text: str) -> list[str]:
    """Runs of letters (categories L), in lower case."""
    found = LETTERS.findall(text.lower())  # numerals that are no digits are among them
    if all(map(str.isalpha, found)):
        return found
    return [run for w in found for run in "".join(c if c.isalpha() else " " for c in w).split()]


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that end at each place from n - 1 on."""
    out = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def columns_hash(codes: np.ndarray, first: int, n: int) -> np.ndarray:
    """What hashes() gives for the n codes from first on of each row."""
    out = np.full(len(codes), n, np.uint64)
    for k in range(first, first + n):
        out = (out ^ codes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def lines(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all padded words in a row, the words' sizes, and where each predicted character stands."""
    codes = np.frombuffer("".join(map(padded, words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words])
    begin = np.concatenate([[0], np.cumsum(size + ORDER)[:-1]])
    at = np.repeat(begin + ORDER - 1, size + 1) + np.arange((size + 1).sum()) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    return codes, size, at


def padded(word: str) -> str:
    return " " * (ORDER - 1) + word + " "


def gram_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n): the full-order n-grams of every text of docs by language, as four little-endian code points."""

    def run(batches):
        words: dict[str, Counter] = {}
        grams: dict[str, Counter] = {}

        def settle():
            for name, found in words.items():
                own = grams.setdefault(name, Counter())
                split = [(word, n) for token, n in found.items() for word in letters(token)]
                if not split:
                    continue
                codes, size, at = lines([word for word, _ in split])
                _, first, kind = np.unique(hashes(codes, ORDER)[at - ORDER + 1], return_index=True, return_inverse=True)
                times = np.zeros(len(first), np.int64)
                np.add.at(times, kind, np.repeat(np.array([n for _, n in split], np.int64), size + 1))
                for begin, n in zip((at[first] - ORDER + 1).tolist(), times.tolist(), strict=True):
                    own[codes[begin : begin + ORDER].astype("<u4").tobytes()] += n
            words.clear()

        def rows():
            out = [(name, g, n) for name, own in grams.items() for g, n in own.items()]
            grams.clear()
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.setdefault(name, Counter()).update(value.as_py().split())
                if sum(map(len, words.values())) > CACHE_WORDS:
                    settle()
            if sum(map(len, grams.values())) > MOST_GRAMS:
                yield rows()
        settle()
        yield rows()

    return docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string"), text).mapInArrow(run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Models:
    """The languages' models; immutable once fitted."""

    def __init__(self, langs: list[str], lang: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
        """langs are sorted; entry i tells that the ORDER characters codes[i] occur n[i] times in langs[lang[i]]."""
        self.langs = langs
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # for each length: hashes, discounted parts
        self.history: list[tuple[np.ndarray, np.ndarray]] = []  # for each history length: hashes, weights left
        lang, codes, n = np.asarray(lang, np.int64), np.asarray(codes, np.uint64).reshape(-1, ORDER), np.asarray(n, np.float64)
        self.floor = 1.0 / (len(np.unique(codes[:, -1])) + 1)
        longest = codes[:0]
        for size in range(ORDER, 0, -1):
            grams, hist = columns_hash(codes, ORDER - size, size), columns_hash(codes, ORDER - size, size - 1) if size > 1 else np.zeros(len(codes), np.uint64)
            once, twice = np.bincount(lang[n == 1], minlength=len(langs)), np.bincount(lang[n == 2], minlength=len(langs))
            discount = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)
            heads, first, own = np.unique(self._pair(hist, lang), return_index=True, return_inverse=True)
            total, kinds = np.bincount(own, n, len(heads)), np.bincount(own, minlength=len(heads))
            self.grams.append(self._table(grams, lang, np.maximum(n - discount[lang], 0) / total[own], 0.0))
            self.history.append(self._table(hist[first], lang[first], discount[lang[first]] * kinds / total, 1.0))
            if size == ORDER:
                longest = codes[np.unique(grams, return_index=True)[1]]
            # a shorter gram counts the distinct longer ones that end with it
            _, first, n = np.unique(self._pair(columns_hash(codes, ORDER - size + 1, size - 1), lang), return_index=True, return_counts=True)
            lang, codes, n = lang[first], codes[first], n.astype(np.float64)
        #: Of the longest n-grams: their hashes, and minus the logarithm of their interpolated probability.
        self.whole = (self.grams[0][0], self._surprise(longest, self.grams[0][1]))
        self.limit = np.full(len(langs), np.inf)
        self.scale = 1.0
        self.cache: dict[str, int] = {}

    @classmethod
    def of(cls, counts: dict[str, dict[str, int]]) -> Models:
        """From counts of n-grams by language."""
        langs = sorted(counts)
        rows = [(k, g, n) for k, x in enumerate(langs) for g, n in counts[x].items()]
        codes = np.frombuffer("".join(g for _, g, _ in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(langs, np.array([r[0] for r in rows]), codes, np.array([r[2] for r in rows]))

    @staticmethod
    def _pair(grams: np.ndarray, lang: np.ndarray) -> np.ndarray:
        out = (grams ^ lang.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))

    def _table(self, keys: np.ndarray, lang: np.ndarray, value: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes with one column a language."""
        found, at = np.unique(keys, return_inverse=True)
        rows = np.full((len(found), len(self.langs)), missing)
        rows[at, lang] = value
        return found, rows

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: float) -> np.ndarray:
        keys, rows = table
        if not len(keys):
            return np.full((len(wanted), rows.shape[1]), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], rows[at], missing)

    def _surprise(self, codes: np.ndarray, longest=0.0) -> np.ndarray:
        """(rows, languages): minus the logarithm of the probability of each row's last code after those before it."""
        p = np.full((len(codes), len(self.langs)), self.floor)
        for n in range(1, ORDER + 1):
            left = self._look(self.history[ORDER - n], columns_hash(codes, ORDER - n, n - 1) if n > 1 else np.zeros(len(codes), np.uint64), 1.0)
            p = (longest if n == ORDER else self._look(self.grams[ORDER - n], columns_hash(codes, ORDER - n, n), 0.0)) + left * p
        return -np.log(p)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): minus the logarithm of each word's probability."""
        codes, size, at = lines(words)
        at = at - ORDER + 1
        wanted, (keys, rows) = hashes(codes, ORDER)[at], self.whole
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out, other = rows[place], np.flatnonzero(keys[place] != wanted)
        if len(other):  # n-grams that were not learned
            _, first, kind = np.unique(wanted[other], return_index=True, return_inverse=True)
            out[other] = self._surprise(codes[at[other[first]][:, None] + np.arange(ORDER)])[kind]
        return np.add.reduceat(out, np.cumsum(size + 1) - size - 1, axis=0)

    def text_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) sums of minus logarithms, and the number of predicted characters."""
        sums, chars = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if not self.cache:
            self.scores, self.chars = np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        tokens = [t.split() if t else [] for t in texts]
        new = list({w for row in tokens for w in row if w not in self.cache})
        if new:
            found = [letters(w) for w in new]
            words = [w for row in found for w in row]
            own = np.repeat(np.arange(len(new)), [len(row) for row in found])
            more, length = np.zeros((len(new), len(self.langs))), np.zeros(len(new), np.int64)
            if words and self.langs:  # without a model no character is predicted
                scores = self.word_scores(words)
                for k in range(len(self.langs)):
                    more[:, k] = np.bincount(own, scores[:, k], len(new))
                np.add.at(length, own, np.array([len(w) + 1 for w in words]))
            self.cache.update(zip(new, range(len(self.chars), len(self.chars) + len(new)), strict=True))
            self.scores, self.chars = np.concatenate([self.scores, more]), np.concatenate([self.chars, length])
        for i, row in enumerate(tokens):
            if row:
                at = np.fromiter(map(self.cache.__getitem__, row), np.int64, len(row))
                sums[i], chars[i] = self.scores[at].sum(0), self.chars[at].sum()
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        return sums, chars

    def carried(self) -> dict:
        """What goes to workers; the longest n-grams' parts are told by whole."""
        grams = [(k[:0], v[:0]) if i == 0 else (k, v) for i, (k, v) in enumerate(self.grams)]
        return self.__dict__ | {"grams": grams, "cache": {}, "scores": None, "chars": None}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score in 0 to 1, cross-entropy, and whether the cross-entropy is beyond the language's limit."""
        sums, chars = self.text_scores(texts)
        cross = sums / np.maximum(chars, 1)[:, None]
        best = cross.argmin(1) if len(self.langs) else np.zeros(len(texts), int)
        least = cross[np.arange(len(texts)), best] if len(self.langs) else np.zeros(len(texts))
        odds = np.exp(-self.scale * (cross - least[:, None]) * np.sqrt(np.maximum(chars, 1))[:, None])
        some = chars > 0
        score = np.where(some, 1 / np.maximum(odds.sum(1), 1), 0.0)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score, np.where(some, least, 0.0), some & (least > self.limit[best] if len(self.langs) else False)

    def own_scores(self, texts: list[str | None], langs: list[str]) -> list[dict | None]:
        """Of each text the cross-entropy in its own language, and the loss at each of SCALES; None without a letter."""
        sums, chars = self.text_scores(texts)
        own, some = np.array([self.langs.index(x) if x in self.langs else -1 for x in langs], np.int64), chars > 0
        cross = sums / np.maximum(chars, 1)[:, None]
        rows, mine = np.arange(len(own)), cross[np.arange(len(own)), own]
        loss = []
        for scale in SCALES:
            gap = -scale * (cross - cross.min(1, keepdims=True)) * np.sqrt(chars)[:, None]
            loss.append(np.log(np.exp(gap).sum(1)) - gap[rows, own])
        return [{"own": m, "loss": x} if s else None for m, x, s in zip(mine.tolist(), np.stack(loss, 1).tolist(), some & (own >= 0), strict=True)]

    def calibrate(self, found: dict[str, tuple[int, float, float]], loss: list[float]) -> None:
        """Takes the score's scale of least loss, and each language's limit: mean and five deviations of its own texts.

        found has number, mean and deviation of the own cross-entropies by language, loss one sum for each of SCALES.
        """
        for k, x in enumerate(self.langs):
            n, mean, std = found.get(x, (0, 0.0, 0.0))
            if n > 1:
                self.limit[k] = mean + 5 * std + 0.05
        self.scale = min(zip(loss, SCALES, strict=True))[1]


def fit(docs: DataFrame, learn, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Models:
    """Models from the rows of docs where the column learn is true and lang and text are not null.

    Scale and limits are fitted on all of these rows, which are scored whole where they are; only sums by language
    reach the driver. Repeated rows count as often as they occur.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key_"), F.col(lang).cast("string").alias("lang_"), F.col(text).alias("text_"))
    found = gram_counts(known, "lang_", "text_").toArrow().combine_chunks()
    langs = sorted(x for x in pc.unique(found["lang"]).to_pylist())
    data, at = values(found["gram"])
    codes = data[at[0] : at[-1]].view("<u4").reshape(-1, ORDER) if len(found) else np.zeros((0, ORDER), np.uint32)
    models = Models(langs, np.asarray(pc.index_in(found["lang"], pa.array(langs, pa.string())).combine_chunks()), codes, np.asarray(found["n"].combine_chunks()))
    if not langs:
        return models
    carried, name = models.carried(), uuid.uuid4().hex

    @over_batches("own double, loss array<double>", several=True)
    def scores(texts: pa.Array, names: pa.Array) -> pa.Array:
        out = [x for i in range(0, len(texts), 256) for x in loaded(name, carried).own_scores(texts.slice(i, 256).to_pylist(), names.slice(i, 256).to_pylist())]
        return pa.array(out, pa.struct([("own", pa.float64()), ("loss", pa.list_(pa.float64()))]))

    rows = known.select("lang_", scores("text_", "lang_").alias("s")).select("lang_", "s.*")  # a filter would have Spark score twice
    each = rows.groupBy("lang_").agg(F.count("own").alias("n"), F.avg("own").alias("mean"), F.stddev_pop("own").alias("std"), *(F.sum(F.col("loss")[i]).alias(f"loss_{i}") for i in range(len(SCALES)))).collect()  # a row for each language
    if any(r["n"] for r in each):
        models.calibrate({r["lang_"]: (r["n"], r["mean"], r["std"]) for r in each}, [sum(r[f"loss_{i}"] or 0.0 for r in each) for i in range(len(SCALES))])
    return models


_loaded: dict[str, Models] = {}


def loaded(name: str, carried: dict) -> Models:
    """A worker's models; it holds one at a time."""
    if name not in _loaded:
        _loaded.clear()
        own = Models.__new__(Models)
        own.__dict__.update(carried)
        _loaded[name] = own
    return _loaded[name]


def identify(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected for every row.

    lang_pred is ``und``, with score 0, where the text is null or has no letter, and wherever nothing was
    learned. rejected marks texts unlike all that was learned of the predicted language. Texts are scored whole,
    however long; of languages that tie the first by name is told; repeated rows are told alike. Columns of docs
    named as the four are replaced, others stay; an empty table gives an empty result.
    """
    name, carried = uuid.uuid4().hex, models.carried()

    @over_batches("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(texts: pa.Array) -> pa.Array:
        out = [loaded(name, carried).predict(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)]
        join = lambda k: np.concatenate([x[k] for x in out]) if out else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array([x for o in out for x in o[0]], pa.string()), pa.array(join(1), pa.float64()), pa.array(join(2), pa.float64()), pa.array(join(3).astype(bool))], ["lang_pred", "score", "cross_entropy", "rejected"])

    rest = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    own = unused("found", rest.columns)
    return rest.withColumn(own, predict(F.col(text))).select(*rest.columns, f"{own}.*")


def held_out(key: str = "doc_id"):
    """Documents kept from learning: crc32 of the id's text modulo 3 is 1. A null id is not among them, nor learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
