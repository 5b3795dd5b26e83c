"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and none."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.llm import chat, embeddings, langid, licenses, mixing, packing, quality, simhash, substring, tokens

RANDOM = random.Random(5)
WORDS = [f"w{i}x" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def some_text(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


def make_rows():
    long = some_text(6000)
    shared = some_text(60)
    near = some_text(300).split(" ")
    rows = [(i, some_text(RANDOM.randint(1, 120)), "en", f"s{i % 5}", "clash") for i in range(40)]
    rows += [(40, None, None, None, None), (41, "", "en", "s1", None), (42, " \t\n ", None, "s0", None), (43, long, "de", "s2", None), (44, "ab\n" + long + "\x0bTail é 😀", "de", "s2", None)]
    rows += [(50 + i, f"{some_text(20)}  {shared}\n{some_text(20)}", "en", "s3", None) for i in range(4)]
    rows += [(60, rows[3][1], "en", "s3", None), (60, rows[3][1], "en", "s3", None), (None, rows[3][1], "en", None, None), (None, None, None, None, None)]
    rows += [(70 + i, " ".join([*near[: 40 * i], "changed", *near[40 * i + 1 :]]), "fr", "s4", None) for i in range(5)]
    rows += [(80, "a " * 90, "en", "s4", None), (81, "one two", "en", "s4", None), (82, "ONE two", "en", "s4", None)]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def empty(docs):
    return docs.where("false")


def test_token_counts(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    odd = [(200 + i, t, None, None, None) for i, t in enumerate([" ", "  a  b ", "a\n b\n \nc", "<s> </s> <unk>", "▁▁ a", "x" * 3000, "<|endoftext|> a", "é b"])]
    df = docs.unionByName(docs.sparkSession.createDataFrame(odd, SCHEMA))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = tokens.count_tokens(df, "piece_bpe_32k.model").collect()
    assert len(got) == len(ROWS) + len(odd)
    for r in got:
        n = len(model.encode(r.text)) if r.text else 0
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 4096)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in tokens.count_tokens(df, "byte_bpe_50k.json").collect():
        assert r.n_tokens == (len(other.encode(r.text, add_special_tokens=False).ids) if r.text else 0)
    assert tokens.count_tokens(empty(docs), "piece_bpe_32k.model").count() == 0


def test_long_texts_are_cut_where_nothing_merges(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "PART_CHARS", 40)
    counter = tokens.FileCounter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [some_text(300), "x" * 500, ("y" * 100 + " ") * 9, " \n".join(["a b", "  c", "\t d e"] * 40), "é " * 200, "", None]
    assert counter.safe and len(counter.parts(texts[0])) > 20 and all("".join(counter.parts(t)) == t for t in texts if t)
    want = [len(counter.model.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    assert counter.lengths(texts).tolist() == want


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substring(docs, batches):
    lines = [split(r[1]) for r in ROWS]
    count = collections.Counter(tuple(w[i : i + 35]) for w in lines for i in range(len(w) - 34))
    want = collections.Counter()
    for row, w in zip(ROWS, lines, strict=True):
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[row[0], row[3], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else row[1]] += 1
    got = collections.Counter((r.doc_id, r.source, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substring.remove_repeats(docs, batches=batches).collect())
    assert got == want
    assert substring.remove_repeats(empty(docs)).count() == 0


def gone_words(words, others, own):
    """Places of words that windows cover which start in others, or twice in own."""
    count = collections.Counter(tuple(w[i : i + 35]) for w in own for i in range(len(w) - 34))
    past = {tuple(w[i : i + 35]) for w in others for i in range(len(w) - 34)}
    return {k for i in range(len(words) - 34) if count[tuple(words[i : i + 35])] > 1 or tuple(words[i : i + 35]) in past for k in range(i, i + 35)}


def test_substring_memory(monkeypatch):
    """Stage functions, run here over Arrow batches as Spark's workers get them, hold a few times a batch's bytes."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(3)
    passage = " ".join(f"p{r.randrange(9000)}" for _ in range(60))
    texts = [f"{' '.join(f'w{r.randrange(90000)}' for _ in range(900))} {passage}".encode() for _ in range(700)]
    size, taken = sum(map(len, texts)), {}

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, f, *_):
            taken["run"] = f

    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(texts, pa.binary())], names=["group_", "text_"])
    substring.rest()
    substring.entries(Frame(), 64)
    tracemalloc.start()
    try:
        out = list(taken["run"](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == 1 and size > 4 << 20 and peak < 8 * size
    got = list(substring.pieces(batch))
    assert [x for p in got for x in p.column("text_").to_pylist()] == texts and all(sum(map(len, p.column("text_").to_pylist())) < substring.PIECE + 8000 for p in got)
    odd = pa.RecordBatch.from_arrays([pa.array([b"", b"a" * (3 << 20), None, b"", b"b"], pa.binary())], names=["text_"])
    assert [x for p in substring.pieces(odd.slice(1)) for x in p.column(0).to_pylist()] == [b"a" * (3 << 20), None, b"", b"b"] and not list(substring.pieces(odd.slice(0, 0)))


@pytest.mark.parametrize("entries", [1 << 20, 40])
def test_substring_index_over_sessions(docs, tmp_path, monkeypatch, entries):
    monkeypatch.setattr(substring, "MOST_RUNS", 2)
    monkeypatch.setattr(substring, "BUCKET_ENTRIES", entries)  # few entries: buckets are thinned, and doubled by compaction
    spark, path = docs.sparkSession, str(tmp_path / "index")
    substring.FingerprintIndex.create(spark, path, 4)
    lines = [split(r[1]) for r in ROWS]
    parts = [list(range(0, len(ROWS), 4)), list(range(1, len(ROWS), 4)), list(range(2, len(ROWS), 4)), list(range(3, len(ROWS), 4)), []]
    seen = []
    for part in parts:
        session = spark.newSession()
        index = substring.FingerprintIndex.open(session, path)
        batch = session.createDataFrame([ROWS[k] for k in part], SCHEMA)
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(batch, index=index).collect())
        want = collections.Counter()
        for k in part:
            gone = gone_words(lines[k], [lines[x] for x in seen], [lines[x] for x in part])
            kept = " ".join(x for i, x in enumerate(lines[k]) if i not in gone)
            want[ROWS[k][0], len(lines[k]), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
        assert got == want
        seen += part
    assert len(substring.FingerprintIndex.open(spark, path).state["runs"]) <= 2
    assert (substring.FingerprintIndex.open(spark, path).state["buckets"] > 4) == (entries == 40)
    with pytest.raises(FileNotFoundError):
        substring.FingerprintIndex.open(spark, str(tmp_path / "none"))


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for row in ROWS:
        size[row[3]] += len(split(row[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    assert len(got) == len(ROWS)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size)
    assert sorted((r.doc_id or -1, r["size"], r.taken) for r in got) == sorted((r.doc_id or -1, r["size"], r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(empty(docs)).count() == 0
    # the same words by the way that moves no texts; clashing columns are replaced
    more = mixing.mixed(docs.withColumn("size_", F.lit("x")).withColumn("hash_", F.lit(1)))
    both = collections.Counter((r.doc_id, r.source, r.size_, r.taken_) for r in more.collect())
    assert {k: n for k, n in both.items() if k[0] != 60} == {k: n for k, n in collections.Counter((r.doc_id, r.source, r["size"], r.taken) for r in got).items() if k[0] != 60}
    assert more.columns == [*docs.columns, "hash_", "size_", "taken_"] and mixing.mixed(empty(docs)).count() == 0


def test_mixing_of_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 211:03d}") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    target, taken = {r.source: r.target for r in got}, collections.Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and abs(sum(target.values()) - 1.5 * sum(1 + i % 7 for i in range(900))) < 1e-6


def test_simhash(docs):
    import xxhash

    prints = []
    for _, t, *_ in ROWS:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(ROWS)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    least = {}
    for row, r in zip(ROWS, root, strict=True):
        if row[0] is not None:
            least[r] = min(least.get(r, 1 << 60), row[0])
    want = collections.Counter((row[0], f"{p:016x}", least.get(r)) for row, p, r in zip(ROWS, prints, root, strict=True))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_dense_buckets():
    rng = np.random.default_rng(3)
    base = np.uint64(rng.integers(1 << 62))
    found = np.unique([base ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(i)] + [base ^ np.uint64(int(x)) for x in rng.integers(0, 1 << 62, 3000)])
    want = np.arange(len(found))
    while True:
        lower = np.array([want[np.bitwise_count(found ^ x) <= 2].min() for x in found])
        if (lower == want).all():
            break
        want = lower
    assert (simhash.local_roots(found, 2) == want).all()


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(300 + i, t, None, None, None) for i, t in enumerate([" ", "a  b", "a\n b\n \nc 12's", " \nx", "<|endoftext|> a<|endoftext|>", "a  b"])]
    rows = packing.pack(docs.unionByName(docs.sparkSession.createDataFrame(odd, SCHEMA)), "byte_bpe_50k.json", 512).collect()
    want = collections.Counter()
    for row in [*ROWS, *odd]:
        ids = (model.encode(row[1], add_special_tokens=False).ids if row[1] else []) + [0]
        first = len(ids) if len(ids) <= 512 else len(ids) % 512 or 512
        for k, a in enumerate([0, *range(first, len(ids), 512)]):
            part = ids[a : first if k == 0 else a + 512]
            want[row[0], k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(empty(docs), "byte_bpe_50k.json").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 101, 4000) if seed % 2 else np.minimum(100, rng.geometric(0.05, 4000)), minlength=101)
    patterns, held = packing.plan(counts, 100), np.zeros(101, int)
    for lengths, times in patterns:
        assert sum(lengths) <= 100
        for n in lengths:
            held[n] += times
    assert (held == counts).all()
    assert sum(t for _, t in patterns) <= 1.02 * max(-(-int((counts * np.arange(101)).sum()) // 100), int(counts[51:].sum())) + 1


def test_quality(docs):
    texts = {r[0]: r[1] for r in ROWS}
    trusted = docs.sparkSession.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    extra = docs.sparkSession.createDataFrame([(90, "good words here\n" * 40, None, None, None), (91, " ".join(f"{w}***" for w in some_text(80).split()), None, None, None), (92, some_text(80), None, None, None)], SCHEMA)
    df = docs.unionByName(extra)
    weights = quality.fit(df, quality.trusted_ids(trusted))
    got = quality.judge(df, weights).collect()
    assert len(got) == len(ROWS) + 3
    for r in got:
        t = r.text or ""
        w = split(t)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = len({k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)})
        lines = [x for x in t.split("\n") if split(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
        assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w))
    by = {r.doc_id: r for r in got}
    assert by[92].kept and not by[91].kept and not by[90].kept and not by[40].kept and by[91].n_words >= 50
    assert len(texts) and quality.judge(empty(docs), weights).count() == 0
    assert quality.judge(df, weights).where("kept").select("doc_id").count() == sum(r.kept for r in got)


def plain_features(text):
    """Bins of tokens and of pairs of neighbours, by the public hash function itself."""
    import regex
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = [xxhash.xxh64_intdigest(w.encode(), 42) for w in regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+", text.lower())]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for b, a in zip(found, found[1:], strict=False)]
    return [signed(h) % quality.BINS for h in found + pairs]


def test_quality_against_a_plain_model(docs):
    """The two multinomials, every document's mean ratio, and the verdict."""
    good = {i for i in range(0, 40, 2)}
    trusted = docs.sparkSession.createDataFrame([(i, 1) for i in good] + [(1, 0), (3, None), (None, 1), (2, 1)], "doc_id long, quality int")
    raw, target = collections.Counter(), collections.Counter()
    for i, t, *_ in ROWS:
        bins = plain_features(t or "")
        raw.update(bins)
        if i in good:
            target.update(bins)
    share = sum(target.values()) / sum(raw.values())
    weight = {b: np.log(target[b] + 1) - np.log(raw[b] * share + 1) for b in range(quality.BINS)}
    weights = quality.fit(docs, quality.trusted_ids(trusted))
    assert weights == pytest.approx([weight[b] for b in range(quality.BINS)])
    got = quality.judge(docs.withColumns({"facts": F.lit(1), "kept": F.lit("x")}), weights, threshold=0.001).collect()
    assert len(got) == len(ROWS) and {r.facts for r in got} == {1}
    for r in got:
        bins = plain_features(r.text or "")
        if r.base_failed:
            assert not r.kept and r.llr is None
        else:
            mean = sum(weight[b] for b in bins) / len(bins)
            assert r.llr == pytest.approx(mean, abs=2e-6) and (r.kept == (mean >= 0.001) or abs(mean - 0.001) < 1e-5)
    assert not quality.fit(docs, quality.trusted_ids(trusted.where("false")))[5] and quality.judge(empty(docs), weights).count() == 0


def test_language(docs):
    spark = docs.sparkSession
    say = {"aa": "banana mango papaya tomato", "bb": "xylem zephyr crypt lynx", "cc": "übung größe fähre öl"}
    rows = [(i, " ".join(RANDOM.choice(say[x].split()) for _ in range(30)), x) for i, x in enumerate(["aa", "bb", "cc"] * 20)] + [(90, None, "aa"), (91, "123 !?", "bb"), (92, "", None), (None, "papaya mango", "aa"), (94, "lynx " * 9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(df, F.col("doc_id").isNotNull() & ~langid.held_out())
    got = {r.doc_id: r for r in langid.identify(df, models).withColumn("held", langid.held_out()).collect()}
    for i, t, x in rows:
        r = got[i]
        assert r.held == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not t or not re.search(r"[^\W\d_]", t):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred == (x or "bb")
    p = models.word_scores(["mango"])[0]
    assert models.word_scores(["mango", "lynx"])[0] == pytest.approx(p) and langid.identify(df.where("false"), models).count() == 0
    # probabilities of all next characters and the unseen one sum to 1
    total = np.zeros(3)
    symbols = sorted({c for t in say.values() for c in t if c != " "} | {" "})
    for c in symbols:
        both, alone = models.word_scores(["b" + c]) if c != " " else models.word_scores(["b"]), None
        codes = np.array([ord(x) for x in "  b" + c], np.uint64)
        q = np.full((1, 3), models.floor)
        for n in range(1, 5):
            parts, left = models.grams[4 - n], models.history[4 - n]
            w = models._look(left, langid.hashes(codes[-n:-1], n - 1) if n > 1 else np.zeros(1, np.uint64), 1.0)
            q = models._look(parts, langid.hashes(codes[-n:], n), 0.0) + w * q
        total += q[0]
    assert (total <= 1 + 1e-9).all() and (total > 0.9).all() and len(both) == 1 and alone is None


def test_language_models_hold_every_gram(docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_GRAMS", 20)
    rows = [(i, " ".join(RANDOM.choice(WORDS) for _ in range(40)), "aa") for i in range(30)] + [(40, "xylem", "bb"), (41, "zephyr crypt", "bb")]
    counts = {}
    for _, text, lang in rows:
        for word in langid.letters(text):
            p = langid.padded(word)
            counts.setdefault(lang, collections.Counter()).update(p[i : i + 4] for i in range(len(p) - 3))
    want = langid.Models.of(counts)
    got = langid.fit(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert got.langs == ["aa", "bb"] and got.predict(["crypt"])[0] == ["bb"]
    for a, b in zip(got.grams + got.history, want.grams + want.history, strict=True):
        assert (a[0] == b[0]).all() and a[1] == pytest.approx(b[1])


def test_language_against_a_plain_model(spark):
    """Interpolated Kneser-Ney by dictionaries and recursion, a character at a time."""
    say = {"aa": "banana mango papaya tomato", "bb": "xylem mzephyr crypt lynx", "cc": "übung größe fähre öl ana"}
    rows = [(i, " ".join(RANDOM.choice(say[x].split()) for _ in range(12)), x) for i, x in enumerate(["aa", "bb", "cc"] * 8)]
    tables, symbols = {}, set()
    for x in say:
        grams = collections.Counter(p[i : i + 4] for _, t, lang in rows if lang == x for w in t.split() for p in ["   " + w + " "] for i in range(len(p) - 3))
        symbols |= {g[3] for g in grams}
        tables[x] = [grams]
        while len(tables[x]) < 4:
            tables[x].append(collections.Counter(g[1:] for g in tables[x][-1]))

    def p(x, history, c):
        if history is None:
            return 1 / (len(symbols) + 1)
        table = tables[x][3 - len(history)]
        same = {g: n for g, n in table.items() if g[:-1] == history}
        lower = p(x, history[1:] if history else None, c)
        if not same:
            return lower
        once, twice = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        return (max(same.get(history + c, 0) - d, 0) + d * len(same) * lower) / sum(same.values())

    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = ["mango lynx", "Zebra", "fähre öl", "größe x", "crypt" * 3]
    cross = []
    for t in texts:
        score = []
        for x in sorted(say):
            padded = ["   " + w + " " for w in t.lower().split()]
            parts = [-np.log(p(x, w[i - 3 : i], w[i])) for w in padded for i in range(3, len(w))]
            score.append(sum(parts) / len(parts))
        cross.append(score)
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, score in zip(got, cross, strict=True):
        assert r.lang_pred == sorted(say)[int(np.argmin(score))] and r.cross_entropy == pytest.approx(min(score))


def test_language_calibrates_on_every_document(spark):
    """Limits come from all texts to learn from, more than any sample of 2,000."""
    say = ["banana mango papaya tomato", "xylem zephyr crypt lynx"]
    rows = [(i, " ".join(RANDOM.choice(say[i % 2].split()) for _ in range(6)), "ab"[i % 2]) for i in range(2600)] + [(5000, "12 %", "a"), (5001, None, "b")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    sums, chars = model.text_scores([t for _, t, _ in rows])
    for k, x in enumerate("ab"):
        own = [s[k] / c for s, c, (_, _, y) in zip(sums, chars, rows, strict=True) if y == x and c]
        assert len(own) == 1300 and model.limit[k] == pytest.approx(np.mean(own) + 5 * np.std(own) + 0.05, abs=1e-12)


def test_what_is_a_letter(spark):
    rows = [(1, "½ ² Ⅷ ③"), (2, "_ 12 %"), (3, "x²y"), (4, None), (5, ""), (6, "ªb"), (7, "b " * 30000), (7, "b " * 30000)]
    model = langid.fit(spark.createDataFrame([(1, "ab xy ba yx ª", "aa"), (2, "q w", "bb")], "doc_id long, text string, lang string"), F.lit(True))
    df = spark.createDataFrame([(*r, 1.0, "c") for r in rows], "doc_id long, text string, score double, found string")
    got = langid.identify(df, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "aa", "und", "und", "aa", "aa", "aa"] and got[6].score == got[7].score and got[0].found == "c"
    assert langid.letters("x²y") == ["x", "y"]


def test_language_without_models():
    tags, score, cross, rejected = langid.Models.of({}).predict(["banana", None, ""])
    assert tags == ["und"] * 3 and not score.any() and not cross.any() and not rejected.any()


def brute_links(rows, least=0.93):
    """(id, n_links, component_id) of each row (id, vector, label), by all pairs."""
    fine = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    root, n = list(range(len(rows))), [0] * len(rows)
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in fine}
    for x in fine:
        for y in fine:
            if x < y and rows[x][2] == rows[y][2] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= least:
                n[x] += 1
                n[y] += 1
                a, b = root[x], root[y]
                root = [b if r == a else r for r in root]
    smallest = {r: min(rows[k][0] for k in fine if root[k] == r) for r in {root[k] for k in fine}}
    return [(i, n[k], smallest[root[k]] if k in unit else i) for k, (i, _, _) in enumerate(rows)]


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 20))
    x = np.concatenate([x, x[:40] + 0.1 * rng.normal(size=(40, 20)), x[:10], x[:5] * 7, np.repeat(x[100:101], 30, 0) + 0.05 * rng.normal(size=(30, 20))]).astype(np.float32)
    rows = [(i, [float(v) for v in row], int(i % 2 if i < 120 else (i - 120) % 2)) for i, row in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 20, 0), (902, [float("nan")] * 20, 0), (903, rows[0][1], None), (904, [None, *rows[0][1][1:]], 0), (905, rows[0][1][:8], 0), (906, [], 1), (0, rows[0][1], 0), (None, rows[0][1], 0), (907, [-0.0, 1.0], 0), (908, [0.0, 2.0], 0), (909, [float("inf")] * 20, 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, class_ int").repartition(3)
    got = embeddings.near_duplicates(df).collect()
    want = brute_links(rows)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    # all pairs of these few vectors are found; recall on many is measured in test_recall
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == collections.Counter(want)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_ids_repeated_with_other_vectors(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 16)).astype(np.float32)
    rows = [(5, a, 1), (3, a + np.float32(0.01), 1), (5, b, 2), (6, b, 2)]
    df = spark.createDataFrame([(i, [float(v) for v in x], k) for i, x, k in rows], "vec_id long, embedding array<float>, label int")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == {(5, 1, 3, False): 1, (3, 1, 3, True): 1, (5, 1, 5, True): 1, (6, 1, 5, False): 1}


def test_recall(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(1500, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.932 * x + (1 - 0.932**2) ** 0.5 * z  # pairs just above the least cosine
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(np.concatenate([x, y]).astype(np.float32))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.95 * 3000 and max(got.values()) == 1


def test_hot_bucket_is_cut(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HOT", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + 0.01 * rng.normal(size=(100, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df).collect()
    assert all((r.n_links, r.component_id) == (99, 0) for r in got)


#: Notices by other words than those of the texts to learn from.
NOTICES = {
    "mit": ["Dual-licensed MIT, see COPYING", "The library is offered under the terms of the MIT license as found in the root folder", 'the software is provided "as is", without warranty of any kind, and the authors or copyright holders shall not be liable for any claim'],
    "apache-2.0": ["Apache License 2.0 applies to all files here", "Contributions are accepted under the Apache License, version 2.0 (see LICENSE.txt)", "you may not use these files except in compliance with the License; a copy is at www.apache.org/licenses/LICENSE-2.0"],
    "gpl": ["GPLv3 or later", "This script may be redistributed under the GNU General Public License v2 as published by the FSF", "foo is free software: you can redistribute it and/or modify it under the terms of the GNU GPL"],
    "lgpl": ["the runtime is covered by the GNU Lesser General Public License", "linking is allowed by the LGPL license"],
    "bsd": ["Redistribution and use in source and binary forms are permitted for everyone", "governed by a BSD-style license", "neither the name of the university nor the names of its contributors may be used to endorse products without prior written permission"],
    "cc-by-sa": ["Article text is available under the Creative Commons Attribution-ShareAlike License", "photos: CC BY-SA 3.0 license"],
    "cc-by-nc": ["Slides are licensed CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial license covers the images"],
    "mpl-2.0": ["subject to the Mozilla Public License, v. 2.0", "licensed under the MPL 2.0"],
    "epl-2.0": ["Eclipse Public License v 2.0", "made available under the Eclipse Public License"],
    "bsl-1.0": ["Boost Software License", "use is subject to the Boost Software License, version 1.0"],
    "unlicense": ["this code is free and unencumbered, released into the public domain under the Unlicense"],
    "proprietary": ["All rights reserved worldwide", "no part of this book may be reproduced in any form without the written permission of the publisher"],
    "isc": ["permission to use, copy, modify and distribute this program for any purpose with or without fee is hereby granted"],
    "zlib": ["the zlib license covers the decoder"],
    "unknown": ["a licensed driver", "the licence of the pub was lost", "permission was refused by the mayor", "he reserved two seats", "the warranty of the car", "copyright is a right", "the license plate of the car was stolen"],
}


def test_licences(docs):
    model = licenses.Classifier(licenses.sample(docs))
    wrong = [(f, t, model.predict(t)) for f, texts in NOTICES.items() for t in texts if model.predict(t)[0] != f]
    assert len(wrong) <= 3 and not [x for x in wrong if x[0] == "unknown"], wrong  # 31 of 34 at least
    assert model.recall > 0.95 and model.silence > 0.95 and model.predict("Dual licensed under MIT and Apache 2.0")[0] in ("mit", "apache-2.0")
    lines = {"mit": "Released under the MIT\nLicense.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "proprietary": "All rights reserved.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    rows = [(500 + i, f"{some_text(30)}.\n{t}\n{some_text(10)}", "x") for i, t in enumerate(lines.values())]
    rows += [(510, "a licensed driver", "x"), (511, None, None), (512, lines["gpl"], None), (512, lines["gpl"], None), (513, f"{some_text(9000)}. {lines['gpl']} {some_text(9000)}", None), (514, "", None), (None, lines["gpl"], None), (515, lines["gpl"] + "\nx.\ny.\n" + lines["apache-2.0"], None)]
    df = docs.select("doc_id", "text", F.lit("y").alias("family")).unionByName(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, family string"))
    found = licenses.scan(df, model).collect()
    assert len(found) == len(ROWS) + len(rows)
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    assert [got[500 + i].family for i in range(5)] == list(lines) and all(got[500 + i].confirmed and got[500 + i].line == 1 for i in range(1, 5))
    assert got[510].family == "unknown" and got[511].family is None and got[514].family is None and got[512].n_licences == 1 and got[7].family is None
    assert got[513].family == "gpl" and got[513].line == 0 and got[515].n_licences == 2 and sum(r.family == "gpl" and r.doc_id is None for r in found) == 1
    # a tie of equal paragraphs goes to the earlier one
    assert got[515].line in (0, 3)
    assert licenses.scan(empty(docs), licenses.Classifier([])).count() == 0


def test_scan_finds_what_the_classifier_says(docs):
    model = licenses.Classifier(licenses.sample(docs))
    rows = [(i, t) for i, t in enumerate(t for texts in NOTICES.values() for t in texts)]
    got = {r.doc_id: (r.family or "unknown", r.probability) for r in licenses.scan(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        family, p = model.predict(t)
        if ". " not in t and "; " not in t:  # one paragraph
            assert got[i][0] == family and (family == "unknown" or abs(got[i][1] - p) < 1e-3)


def test_notices_without_a_licence_word_are_found(docs):
    """Every sentence of the texts to learn from alone, wrapped, and amid other text, whatever words it has."""
    model = licenses.Classifier(licenses.sample(docs))
    told = []
    for text in (x for texts in licenses.PARAGRAPHS.values() for x in texts):
        for s in re.split(r"(?<=[.!?;:])\s+", text):
            words, (family, p) = s.split(), model.predict(s)
            if family != "unknown" and not {*licenses.tokens(s)} & {*licenses.TRIGGERS}:
                told.append((s, family, p))
                told.append((" ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :]), family, p))
                told.append((f"{some_text(40)}.\n{s}\n{some_text(40)}", family, None))
    assert len({s for s, _, _ in told}) >= 30 and not [x for x in NOTICES["unknown"] if model.predict(x)[0] != "unknown"]
    got = {r.doc_id: r for r in licenses.scan(docs.sparkSession.createDataFrame([(i, s) for i, (s, _, _) in enumerate(told)], "doc_id long, text string"), model).collect()}
    for i, (s, family, p) in enumerate(told):
        assert got[i].n_licences >= 1 and got[i].family == family, (s, got[i])
        assert p is None or abs(got[i].probability - p) < 1e-3
    # what has no anchor, or too low a bound, is told nothing, even if it holds all that is spared
    bare = " ".join(w for w in model.vocabulary if " " not in w and w not in model.anchors)
    most, needed = model.bounds()
    assert model.predict(bare)[0] == "unknown"
    for s, family, _ in told:
        if family != "unknown":
            found = {*licenses.grams(licenses.tokens(s))}
            assert found & {*model.anchors} and sum(most[zlib.crc32(g.encode()) % len(most)] for g in found) >= needed


def test_chat_levels_of_long_chains_and_of_graphs(spark):
    r = random.Random(4)
    after = {(1, str(i)): [str(i - 1)] if i > 1 else [] for i in range(1, 1103)}
    after |= {(2, str(i)): sorted({str(r.randrange(max(0, i - 6), i)) for _ in range(r.randrange(4))}) if i else [] for i in range(60)}
    after |= {(3, "a"): ["b"], (3, "b"): ["a"], (3, "c"): ["b"], (3, "d"): ["c", "e"], (3, "e"): [], (3, "f"): ["d"], (3, "g"): ["g"], (3, "h"): ["e", "zz"]}
    turn = {c: {k: i for i, k in enumerate(r.sample(sorted(k for d, k in after if d == c), sum(d == c for d, _ in after)))} for c in (1, 2, 3)}
    level, order = {}, {}
    while True:
        new = [x for x, a in after.items() if x not in level and all((x[0], b) in level for b in a if (x[0], b) in after)]
        if not new:
            break
        for c, k in new:
            before = [(c, b) for b in after[c, k] if (c, b) in after]
            level[c, k] = max((level[b] + 2 for b in before), default=0)
            order[c, k] = max([turn[c][k], *(order[b] for b in before)])
    rows = [(c, turn[c][k], "assistant", f'<tool_call>{{"id": "{k}", "name": "fetch", "arguments": {{"url": "u"}}, "after": [{",".join(chr(34) + b + chr(34) for b in a)}]}}</tool_call>') for (c, k), a in after.items()]
    got = {(x.conv_id, x.turn): x for x in chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, k in after:
        x = got[c, turn[c][k]]
        assert x.level == level.get((c, k)) and (x.level is None or x.order_turn == order[c, k])
    assert max(level.values()) == 2202 and sum(x.level is None for x in got.values()) == 6


def test_chat(spark):
    call = lambda i, name, args, after=(): f'<tool_call>{{"id": "{i}", "name": "{name}", "arguments": {args}, "after": [{",".join(chr(34) + a + chr(34) for a in after)}]}}</tool_call>'
    rows = [
        (1, 0, "user", "hé"),
        (1, 1, "tool", '{"id": "a", "content": {"b": 1, "a": [true, null]}}'),
        (1, 2, "assistant", "see " + call("a", "search", '{"query": "x", "limit": 3}')),
        (1, 3, "assistant", call("b", "search", '{"limit": "3"}', ["c"])),
        (1, 4, "tool", '{"id": "b", "content": 1}'),
        (1, 5, "assistant", call("c", "calculate", '{"expression": "1+1"}')),
        (1, 6, "tool", '{"id": "zz", "content": 1}'),
        (2, 0, "assistant", call("d", "nope", "{}", ["e"])),
        (2, 1, "assistant", call("e", "fetch", '{"url": "u", "method": "PUT"}', ["d"])),
        (2, 2, "assistant", "<tool_call>{broken</tool_call>"),
        (None, 0, "tool", '{"id": "a"}'),
        (3, 0, None, None),
        (3, 0, None, None),
    ]
    got = chat.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 0].message_json == '{"content":"hé","role":"user"}' and by[1, 0].status == "plain"
    assert by[1, 1].message_json == '{"content":{"a":[true,null],"b":1},"role":"tool","tool_call_id":"a"}'
    assert (by[1, 1].status, by[1, 1].order_turn, by[1, 1].level) == ("linked", 2, 1)
    assert by[1, 2].message_json == '{"content":"see ","role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search"}]}'
    assert (by[1, 2].n_calls, by[1, 2].n_invalid) == (1, 0) and by[1, 3].n_invalid == 1
    assert (by[1, 3].order_turn, by[1, 3].level, by[1, 4].order_turn, by[1, 4].level) == (5, 2, 5, 3)
    assert by[1, 6].status == "orphan" and by[2, 0].level is None and by[2, 1].level is None and by[2, 1].n_invalid == 1 and by[2, 2].n_invalid == 1
    assert by[None, 0].status == "orphan"
    assert chat.format_messages(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    huge = "x" * 3_000_000  # one very long text, and columns with clashing names
    long = spark.createDataFrame([(1, 0, "assistant", huge + call("a", "fetch", '{"url": "u"}'), 5, "x")], "conv_id long, turn long, role string, text string, level int, c_ string")
    assert [(r.n_calls, r.n_invalid, len(r.message_json) > 3_000_000) for r in chat.format_messages(long).collect()] == [(1, 0, True)]


def test_chat_from_turns(spark):
    texts = ["hi there", "hello\n</tool_call> \"you\"", None, "", "w " * 65, "z", "é", "é"]
    rows = [(1, 0, "system", "be nice"), *((1, i + 1, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)), (2, 0, "assistant", "first"), (2, 1, "user", "x"), (2, 4, "assistant", None), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "a"), (4, 0, None, None)]
    got = chat.format_messages(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == len(rows)
    users = {(c, t) for c, t, r, _ in rows if r == "user" and c is not None}
    for r in got:
        c, t, role, text = next(x for x in rows if (x[0], x[1]) == (r.conv_id, r.turn))
        if role == "user":
            words = len(split(text))
            call = {"arguments": {"words": words} | ({"text": text} if text is not None else {}), "id": f"t{t}", "name": "reply"}
            level, back = 0, t - 2
            while (c, back) in users:
                level, back = level + 2, back - 2
            assert r.message_json == chat.canonical({"content": "", "role": "assistant", "tool_calls": [call]})
            assert (r.status, r.n_calls, r.n_invalid, r.level) == ("call", 1, int(not text or not 1 <= words <= 64), level if c is not None else None) or c is None
        elif role == "assistant":
            assert r.message_json == chat.canonical({"content": text, "role": "tool", "tool_call_id": f"t{t - 1}"})
            assert r.status == ("linked" if (c, t - 1) in users else "orphan") and r.order_turn == t
        else:
            assert r.status == "plain" and r.message_json == chat.canonical({"content": text, "role": role})


def test_columns_with_clashing_names(docs):
    """Other columns named like the operators' own, in every operator on documents."""
    names = "piece start length ids_crc32 sequence_id offset fp root node least_ component_id fingerprint set_ size_ place_ group_ text_ row_ kind_ bucket size hash_ skey_ taken target n_tokens n_bytes over_limit words gram line found facts key_ h_ llr score".split()
    odd = docs.drop("n_words").withColumns({n: F.lit("x") for n in names}).where("doc_id < 20")
    plain = odd.select("doc_id", "text", "lang", "source")
    same = lambda f, *keys: assert_same(f(odd), f(plain), keys)

    def assert_same(a, b, keys):
        assert sorted(map(repr, a.select(*keys).collect())) == sorted(map(repr, b.select(*keys).collect())) and a.count() == odd.count()

    same(lambda d: tokens.count_tokens(d, "piece_bpe_32k.model"), "doc_id", "n_bytes", "n_tokens", "over_limit")
    same(substring.remove_repeats, "doc_id", "n_words", "n_removed", "kept_sha256", "text")
    same(mixing.mix, "doc_id", "size", "taken", "target")
    same(mixing.mixed, "doc_id", "text", "taken_", "size_")
    same(simhash.near_duplicates, "doc_id", "fingerprint", "component_id")
    same(lambda d: simhash.similar(d, ["doc_id"]), "doc_id")
    same(lambda d: quality.judge(d, [0.0] * quality.BINS), "doc_id", "n_words", "kept")
    model = licenses.Classifier([])
    same(lambda d: licenses.scan(d, model), "doc_id", "family")
    packed = [r[:-1] for r in map(tuple, packing.pack(odd, "byte_bpe_50k.json").collect())]
    assert len(packed) >= odd.count()


def test_components_with_hubs_and_long_chains(spark, monkeypatch):
    from relata.llm import common

    monkeypatch.setattr(common, "HUB_EDGES", 3)
    edges = [(i, i + 1) for i in range(150)] + [(1000, i) for i in range(900, 960)] + [(i, i) for i in range(5)] + [(RANDOM.randrange(2000, 2100), RANDOM.randrange(2000, 2100)) for _ in range(70)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges + edges[:20], "a long, b long"), "test").collect()}
    assert got == {x: find(x) for x in root}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_scopes_delete_what_they_left(spark):
    from relata.llm import common

    with common.scope(spark, "test"):
        one = common.written(spark.range(3).toDF("a"), "one")
    outside = common.written(spark.range(3).toDF("a"), "outside")
    assert one.count() == 3
    with common.scope(spark, "test"):
        two = common.written(spark.range(4).toDF("a"), "two")
    assert two.count() == 4 and outside.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(one.relata_path).count()
    more = common.appended(spark.range(2).toDF("a"), common.appended(spark.range(3).toDF("a"), None))
    assert more.count() == 5
    common.forget(outside, None)


def test_numbers_across_ranges(spark):
    from relata.llm import common

    rows = spark.createDataFrame([(f"k{i % 997:04d}" if i % 5 else None,) for i in range(3000)], "k string").distinct()
    n = rows.count()
    got = common.numbered(rows, [F.col("k").isNull(), F.col("k")], n, per_range=90).orderBy("number_").collect()
    keys = [r.k for r in got]
    assert [r.number_ for r in got] == list(range(n)) and keys == sorted(keys, key=lambda k: (k is None, k or ""))


def test_words_are_merged_as_the_library_merges_them(docs):
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    found, plain = packing.Encoder(path), packing.Encoder(path)
    plain.merges = None
    rng = random.Random(3)
    letters = "aaeeiinnrrssttlo" + "éñßÆŒſŸżªº·×÷µǅɐжЖ中" + "0123456789²" + ".,;:!?-_/\\()[]{}#$%&*+=<>|@\"'`~^" + "\n\n\t\r\x0b\x1c\x85\xa0 "
    words = ["".join(rng.choices(letters[: rng.choice((16, 30, 60, len(letters)))], k=rng.choice((1, 2, 3, 5, 9, 17, 40)))) for _ in range(20000)]
    words += ["don't", "a\nb", "a\n\nb", "<|endoftext|>", "x<|endoftext|>y", "a" * 3000, "=" * 200, "ab1.c\nd", "😀a", "é"]
    texts = pa.array([" ".join(words[k : k + 50]) for k in range(0, len(words), 50)] + [" ".join(r.text for r in docs.limit(20).collect() if r.text)])
    assert found.encode(texts) == plain.encode(texts) == [plain.whole(t) for t in texts.to_pylist()]
    calls = []
    found.forget()
    found.model = type("Counted", (), {"encode_batch_fast": lambda self, x, **k: calls.append(x) or plain.model.encode_batch_fast(x, **k)})()
    found.learn(["word", "Straße,", "été12.", "a\nb"])
    assert not calls and set(found.words) == {"word", "Straße,", "été12.", "a\nb"}
    found.learn(["a" * 64])  # of more than 64 characters with the blank; rounds would be as many as its letters
    assert calls


def test_files_of_another_make_are_left_to_the_library(tmp_path):
    import json

    import public_tokenizers
    from relata.llm.merges import Merges

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"model": spec["model"] | {"ignore_merges": True}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}):
        (tmp_path / "file.json").write_text(json.dumps(spec | change), encoding="utf-8")
        assert Merges.of(str(tmp_path / "file.json")) is None
