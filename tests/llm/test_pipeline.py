"""The pipeline's stages, each on what the one before left."""

import random
from collections import Counter

import corpus_pipeline as P


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = P.table(spark, d, "documents")
    columns = docs.columns
    n = docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        docs = P.written(stage(spark, docs, d), name)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if k < 2:
            assert docs.count() < n and docs.select("doc_id").distinct().count() == docs.count()
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
    assert P.run(spark, d).count() == docs.count()


def _sets(text, n=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def planted():
    """Documents with copies that share more and less than four fifths of their shingles, repeated rows and null ids."""
    r = random.Random(8)
    some = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = [(i, " ".join(some(120))) for i in range(30)]
    for k in range(8):  # chains of copies, each a few words further from the first
        words = some(200)
        for step in range(4):
            rows.append((100 + 10 * k + step, " ".join(words)))
            for _ in range(k // 2 + 1):
                words[r.randrange(200)] = f"x{r.randrange(5000)}"
    again, nameless = " ".join(some(90)), " ".join(some(90))
    rows += [(200, again)] * 3 + [(None, again), (201, rows[0][1]), (None, nameless), (None, nameless), (None, " ".join(some(90)))]
    return [(i, t, "en", "s", len(t)) for i, t in rows]


def test_near_duplicates_leave_one_row_of_each_component(spark):
    rows = planted()
    sets = [_sets(x[1]) for x in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = {}
    for x, k in zip(rows, root, strict=True):
        groups.setdefault(k, []).append(x)
    want = Counter(min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = P.written(docs, "planted")
    kept = P.written(P.near_duplicates(spark, docs, ""), "kept")
    assert Counter(map(tuple, kept.collect())) == want and len(want) < len(rows) - 15
    # what is left once keeps all its words
    lost = {x.doc_id: x.text for x in P.repeated_passages(spark, kept, "").collect()}
    again = next(x[1] for x in rows if x[0] == 200)
    assert lost[200] == again and len(lost) >= len({x[0] for x in want})


def test_pairs_in_large_groups(spark, monkeypatch):
    """Sets of which many share a part and few are alike, groups cut into parts, and no leader: links by clusters alone."""
    from relata.llm import simhash

    r = random.Random(11)
    shared = [f"s{r.randrange(9000)}" for _ in range(75)]
    rows = []
    for i in range(60):
        own = [f"o{r.randrange(90000)}" for _ in range(24)]
        rows.append((2 * i, " ".join(shared + own)))
        if i % 4 == 0:
            rows.append((2 * i + 1, " ".join(shared + own[:22] + ["x", f"y{i}"])))
    sets = [_sets(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    want = Counter(frozenset(rows[k][0] for k in range(len(rows)) if root[k] == g) for g in set(root))
    docs = P.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "large")
    for rounds, hot in ((2, 2048), (0, 7)):
        monkeypatch.setattr(simhash, "LEADER_ROUNDS", rounds)
        monkeypatch.setattr(simhash, "HOT", hot)
        found = {}
        for x in simhash.similar(docs, ["doc_id"]).collect():
            found.setdefault(x.root_, set()).add(x.doc_id)
        assert Counter(map(frozenset, found.values())) == want and 30 < len(want) < len(rows)


def _split(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage's rows, on what the stage before left, with nulls, repeated rows, an empty and a long text."""
    import numpy as np
    import public_tokenizers
    from test_operators import gone_words, plain_features
    from tokenizers import Tokenizer

    r = random.Random(21)
    some = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    passage, copy, junk = some(60), some(120), " ".join(f"%{r.randrange(50)} #@" for _ in range(80))
    rows = [(i, some(r.randint(55, 160)), "en", f"s{i % 4}") for i in range(30)]
    rows += [(40 + i, f"{some(50)}\n{passage} {some(40)}", "en", "s1") for i in range(3)]
    rows += [(50, copy, "en", "s0"), (51, copy + " x", "de", "s2"), (52, copy, None, None), (None, copy, "en", "s0"), (50, copy, "en", "s0")]
    rows += [(60, None, "en", "s1"), (61, "", "en", None), (62, "few words", None, "s3"), (63, junk, "en", "s3"), (64, some(5000), "fr", None), (None, some(90), None, None), (None, some(90), None, None)]
    rows = [(*x, len(x[1] or "")) for x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = [i for i in range(30) if i % 3]
    spark.createDataFrame([(i, 1, 0) for i in good] + [(63, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    now, tables = P.table(spark, d, "documents"), [rows]
    for name, step in P.STAGES:
        now = P.written(step(spark, now, d), name)
        tables.append([tuple(x) for x in now.collect()])
    # quality rules
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(plain_features(t or ""))
        if i in good:
            target.update(plain_features(t or ""))
    share = sum(target.values()) / sum(raw.values())
    weight = lambda b: np.log(target[b] + 1) - np.log(raw[b] * share + 1)

    def passes(t):
        w = _split(t)
        count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = len({k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)})
        return len(w) >= 50 and 100 * repeat <= 50 * len(w) and np.mean([weight(b) for b in plain_features(t)]) >= -0.30

    assert Counter(tables[1]) == Counter(x for x in rows if passes(x[1]))
    # near duplicates
    left, groups = tables[1], []
    for x in left:
        near = [g for g in groups if any(5 * len(_sets(x[1]) & _sets(y[1])) >= 4 * len(_sets(x[1]) | _sets(y[1])) for y in g)]
        groups = [g for g in groups if g not in near] + [[x] + [y for g in near for y in g]]
    assert len(tables[2]) == len(groups) and all(sum(x in g for x in set(tables[2])) == 1 for g in groups)
    assert sorted(min((y[0] is None, y[0] or 0) for y in g) for g in groups) == sorted((x[0] is None, x[0] or 0) for x in tables[2])
    # repeated passages
    words = [_split(x[1]) for x in tables[2]]
    want = Counter()
    for x, w in zip(tables[2], words, strict=True):
        gone = gone_words(w, [], words)
        text = " ".join(y for i, y in enumerate(w) if i not in gone) if gone else x[1]
        want[x[0], text, x[2], x[3], len(text)] += 1
    assert Counter(tables[3]) == want and want != Counter(tables[2])
    # source mix: copies of whole documents, one cut document a source, the target's words
    size = Counter()
    for x in tables[3]:
        size[x[3]] += len(_split(x[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weights, open_, target_, left_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), {}, 1.5 * sum(size.values())
    while True:
        over = {s for s in open_ if left_ * weights[s] / sum(weights[x] for x in open_) > 2 * size[s]}
        if not over:
            target_ |= {s: left_ * weights[s] / sum(weights[x] for x in open_) for s in open_}
            break
        target_ |= {s: 2.0 * size[s] for s in over}
        left_ -= sum(target_[s] for s in over)
        open_ -= over
    taken, cut = Counter(), Counter()
    for x in tables[4]:
        taken[x[3]] += len(_split(x[1]))
        mine = [y for y in tables[3] if (y[0], y[2], y[3]) == (x[0], x[2], x[3])]
        assert x[4] == len(x[1]) and any(_split(y[1])[: len(_split(x[1]))] == _split(x[1]) for y in mine)
        cut[x[3]] += not any(y[1] == x[1] for y in mine)
    assert all(abs(taken[s] - target_[s]) <= 0.5 for s in size) and max(cut.values()) <= 1
    assert all(n <= 2 for n in Counter((x[0], x[1]) for x in tables[4]).values())
    # packing
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for x in tables[4]:
        n = len(model.encode(x[1], add_special_tokens=False).ids) + 1
        first = n if n <= 2048 else n % 2048 or 2048
        for k, a in enumerate([0, *range(first, n, 2048)]):
            pieces[x[0], k, a, (first if k == 0 else 2048)] += 1
    assert Counter(x[:4] for x in tables[5]) == pieces
    by = {}
    for x in tables[5]:
        by.setdefault(x[5], []).append((x[6], x[3]))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    empty = P.table(spark, d, "documents").where("false")
    for _, step in P.STAGES:
        assert step(spark, empty, d).count() == 0


def test_near_duplicates_meet_by_fingerprints(spark):
    """Pairs at four fifths exactly, from four and five shingles on, meet under blocks of SimHash fingerprints."""
    import numpy as np
    from relata.llm import simhash

    r = random.Random(31)
    mask = (1 << 64) - 1

    def plain(found, words):  # bit by bit
        out = b""
        for w in range(words):
            h = []
            for x in found.tolist():
                for k in (0, 1):
                    y = (x ^ int(simhash._flips[k, w])) * int(simhash._odds[k, w]) & mask
                    y = (y ^ y >> 32) * 0x9E3779B97F4A7C15 & mask
                    h.append((y ^ y >> 32).to_bytes(8, "little"))
            for byte in range(8):
                out += bytes([sum(1 << b for b in range(8) if 2 * sum(x[byte] >> b & 1 for x in h) > len(h))])
        return out

    for n in (0, 1, 5, 126, 300):
        found = np.array(sorted(r.getrandbits(64) for _ in range(n)), np.uint64)
        assert simhash.long_fingerprint(found, 17) == plain(found, 17)
    rows = []
    for i, (n, extra) in enumerate([(8, 1), (24, 5), (84, 20), (404, 100)] * 30):  # n - 4 shingles of n - 4 + extra
        words = [f"w{r.randrange(10**6)}" for _ in range(n + extra)]
        rows += [(2 * i, " ".join(words[:n])), (2 * i + 1, " ".join(words))]
        assert 5 * (n - 4) == 4 * (n - 4 + extra)
    width, blocks, words = simhash.scheme(len(rows))
    prints = [simhash.long_fingerprint(simhash.shingles(t.encode(), 5), words) for _, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(prints)], ["set_", "print_"])
    dealt = pa.Table.from_batches(simhash.block_rows([batch], width, blocks)).sort_by([("block_", "ascending"), ("set_", "ascending")])
    assert dealt.num_rows == blocks * len(rows)
    links = {(a, b) for x in simhash.near_links(dealt.to_batches(max_chunksize=7)) for a, b in zip(*map(pa.Array.to_pylist, x.columns), strict=True)}
    bits = [int.from_bytes(p, "big") for p in prints]
    assert {(2 * i + 1, 2 * i) for i in range(len(rows) // 2)} == links
    assert all((bits[a] >> 64 * words - 192 ^ bits[b] >> 64 * words - 192).bit_count() <= 56 for a, b in links)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    root = {x.doc_id: x.root_ for x in simhash.similar(docs, ["doc_id"]).collect()}
    assert all(root[2 * i] == root[2 * i + 1] for i in range(len(rows) // 2)) and len(set(root.values())) == len(rows) // 2


def test_links_in_buckets():
    """Roots in small and large buckets, of near copies and of others, against all pairs."""
    import numpy as np
    from relata.llm import simhash

    rng = np.random.default_rng(2)
    base = np.unpackbits(rng.integers(0, 1 << 64, 3, np.uint64).view(np.uint8))
    for n in (1, 300, 2600):
        words = np.repeat(base[None], n, 0)
        for i in range(n):
            words[i, rng.choice(192, rng.integers(0, 100), False)] ^= 1
        words = np.packbits(words, axis=1).view(np.uint64)
        far = np.bitwise_count(words[:, None] ^ words)
        ok = (far.sum(2) <= simhash.NEAR) & (far[:, :, 0] <= simhash.NEAR_64)
        want = np.arange(n)
        while True:
            lower = np.array([want[x].min() for x in ok])
            if (lower == want).all():
                break
            want = lower
        assert (simhash.near_roots(words) == want).all()


def test_scheme_of_blocks():
    from relata.llm import simhash

    for n in (0, 1, 10**4, 10**6, 10**8):
        width, blocks, words = simhash.scheme(n)
        assert (1 - (1 - simhash.DIFFER) ** width) ** blocks <= 1e-6 and 64 * words >= simhash.BESIDE + width * blocks
        assert n / 2**width <= 1024
