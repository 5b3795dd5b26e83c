"""Micro-graphs by hand: cycles, null and dangling keys, null times, width, budget, batches."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from relata.functions import vectors as V
from relata.operators import context as C
from relata.operators import sequence as Q
from relata.operators import stats as S
from relata.operators.sampler import ContextSampler, TaskConfig
from relata.sources.database import RelDatabase, load_snapshot
from relata.sources.schema import TableSpec, from_footer

DAY = [dt.datetime(2020, 1, d) for d in range(1, 10)]
EDGES = "from_gid long, from_col long, to_gid long, from_ts timestamp_ntz, from_task boolean"


def edges(spark, pairs):
    return spark.createDataFrame([(a, c, b, t, False) for a, c, b, t in pairs], EDGES)


def seeds(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, row_gid long, seed_ts timestamp_ntz")


def test_cycle_and_self_edge(spark):
    e = edges(spark, [(1, 0, 2, None), (2, 0, 1, None), (1, 0, 1, None)])
    rows = C.sample(seeds(spark, [(0, 1, None)]), e, 5, 3).collect()
    assert sorted((r.row_gid, r.hop) for r in rows) == [(1, 0), (2, 1)]


def test_time_is_inclusive_and_null_time_is_seen(spark):
    e = edges(spark, [(10, 0, 1, DAY[1]), (11, 0, 1, DAY[2]), (12, 0, 1, DAY[3]), (13, 0, 1, None)])
    got = {r.row_gid for r in C.children(seeds(spark, [(0, 1, DAY[2])]), e, 10).collect()}
    assert got == {10, 11, 13}
    assert C.children(seeds(spark, [(0, 1, None)]), e, 10).count() == 4
    assert C.children(seeds(spark, [(0, 1, None)]), e, 2).count() == 2


def test_keys(spark):
    big = 16777217
    parent = spark.createDataFrame([(1,), (big,), (big + 1,), (1,)], "k long")
    child = spark.createDataFrame([(0, 1, big), (1, None, 1), (2, 99, big + 1)], "id long, a long, b long")
    db = RelDatabase(spark, {"child": child, "parent": parent}, (TableSpec("child", "id", {"a": "parent", "b": "parent"}), TableSpec("parent", "k")))
    got = db.edges().collect()
    assert len(got) == 4  # null and dangling keys have none
    one = {r.to_gid for r in got if r.from_gid in (0, 1) and (r.from_gid, r.from_col) in ((0, 1), (1, 2))}
    assert len(one) == 1  # of rows with one key the last counts
    assert db.dangling("child", "a").count() == 1


def test_statistics(spark):
    cells = spark.createDataFrame([(1, 0, 5.0, None), (1, 0, 5.0, None), (2, 0, 3.0, None), (3, 0, None, None), (4, 0, math.nan, None), (4, 0, 1.0, None), (4, 0, 3.0, None)], "column_idx long, semantic_type int, num double, txt string")
    got = {r.column_idx: (r.n, r["mean"], round(r["std"], 9)) for r in S.column_stats(cells).collect()}
    assert got == {1: (2, 5.0, 1e-8), 2: (1, 3.0, 1.0), 3: (0, 0.0, 1.0), 4: (2, 2.0, round(math.sqrt(2), 9))}
    assert S.present(cells).count() == 5


def test_masks(spark):
    tok = spark.createDataFrame([(0, 0, 1, 0, 0), (0, 1, 1, 0, 1), (0, 2, 2, 1, 2), (0, 3, 3, 0, 0)], "seq_id long, pos int, row_gid long, table_idx long, column_idx long")
    f2p = spark.createDataFrame([(1, [2, 9]), (3, [2, 2])], "from_gid long, f2p array<long>")
    pairs = lambda df: {(r.q, r.kv) for r in df.collect()}
    column, feature, near = pairs(Q.column_mask(tok)), pairs(Q.feature_mask(tok, f2p)), pairs(Q.neighbour_mask(tok, f2p))
    assert column == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 3), (3, 0)}
    assert feature == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3), (0, 2), (1, 2), (3, 2)}
    assert near == {(2, 0), (2, 1), (2, 3)}


def test_budget_target_and_padding(spark):
    ctx = C.sample(seeds(spark, [(0, 1, None)]), edges(spark, [(1, 0, 2, None)]), 5, 0)
    cells = spark.createDataFrame([(g, 0, c, c, 0, float(c), None) for g in (1, 2) for c in range(3)], "row_gid long, table_idx long, column_idx long, local_idx long, semantic_type int, num double, txt string")
    tok = C.tokens(ctx, cells, 4, target=1, drop=(2,))
    got = [(r.pos, r.row_gid, r.column_idx, r.is_target) for r in tok.orderBy("pos").collect()]
    assert got == [(0, 1, 0, False), (1, 1, 1, True), (2, 2, 0, False), (3, 2, 1, False)]
    packed = Q.pack(tok, 6, ("column_idx",)).first()
    assert packed.column_idx == [0, 1, 0, 1, 0, 0] and packed.is_padding == [False] * 4 + [True] * 2


@pytest.mark.parametrize("n", [0, 1, 7, 12])
def test_batches(spark, n):
    rows = spark.range(n).select(F.col("id").alias("row_gid"))
    places = Q.shuffled(rows, 1, 0)
    got = Q.batches(places, n, 2, 3).collect()
    assert len(got) == -(-n // 6) * 6 if n else not got
    order = {r.place: r.row_gid for r in places.collect()}
    assert sorted(order) == list(range(n))
    for r in got:
        start = r.batch_idx * 6 + r["rank"] * 2
        assert r.row_gid == order[(start + r.slot) % n] and r.true_size == min(2, max(0, n - start))


def test_numbers_by_ranges(spark, monkeypatch):
    from relata.sources import database

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    want = {r.k: r.row_gid for r in database.numbered(df, ("k",), 5000).collect()}
    monkeypatch.setattr(database, "ONE_WINDOW_ROWS", 300)
    assert {r.k: r.row_gid for r in database.numbered(df, ("k",), 5000).collect()} == want == {i: i for i in range(5000)}


def test_numbers_by_ranges_of_any_type(spark, monkeypatch):
    from relata.sources import database

    rows = [(("x" * (i % 3)) or None, i % 50, i) for i in range(900)] + [("http://a/b", 1, i) for i in range(900)] + [(None, None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "t string, n int, i long")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    monkeypatch.setattr(database, "ONE_WINDOW_ROWS", 100)
    got = database.numbered(df, ("t", "n", "i"), len(rows), 7).orderBy("row_gid").collect()
    assert [(r.t, r.n, r.i) for r in got] == order and [r.row_gid for r in got] == list(range(7, 7 + len(rows)))
    again = [("a",)] * 500 + [("b",)] * 3  # equal rows share a range
    got = database.numbered(spark.createDataFrame(again, "t string"), ("t",), 503).orderBy("row_gid").collect()
    assert [r.row_gid for r in got] == list(range(503)) and [r.t for r in got] == sorted(r[0] for r in again)


def test_accessors_and_declared_types(spark):
    users = spark.createDataFrame([(i, x) for i, x in enumerate(["1.5", "x", None, "true", "2020-01-02"])], "id long, v string")
    db = RelDatabase(spark, {"users": users}, (TableSpec("users", "id"),))
    assert db.table(0).count() == db.table("users").count() == 5 and db.column(1)["name"] == "v" and db.column_index("users", "v") == 1
    assert [r.pk for r in db.row(3).collect()] == ["3"] and db.row(5).count() == 0
    num = lambda kind: [r.num for r in db.cells(declared={"v": kind}).where("column_idx = 1").orderBy("row_gid").collect()]
    assert num(0) == [1.5, None, None, None, None] and num(3) == [None, None, None, 1.0, None] and num(2)[4] == 1577923200.0
    assert [r.txt for r in db.cells(declared={"id": 1}).where("column_idx = 0").orderBy("row_gid").collect()] == list("01234")
    assert V.embed_one("a", V.hashing_embedder(4)) == V.hashing_embedder(4)(["a"])[0].tolist()
    halves = spark.createDataFrame([([1.0, -2.0],), (None,)], "v array<float>").select(V.halved("v").alias("h")).collect()
    assert [r.h and bytes(r.h) for r in halves] == [b"\x00\x3c\x00\xc0", None]


def test_null_keys_are_spread(spark):
    parent = spark.createDataFrame([(i,) for i in range(5)], "k long")
    child = spark.createDataFrame([(i, None if i % 3 else i % 5, "p" if i % 2 else None) for i in range(100)], "id long, a long, b string")
    other = spark.createDataFrame([("p",)], "name string")
    db = RelDatabase(spark, {"child": child, "other": other, "parent": parent}, (TableSpec("child", "id", {"a": "parent", "b": "other"}), TableSpec("other", "name"), TableSpec("parent", "k")))
    got = {(r.from_gid, r.to_gid) for r in db.edges().collect()}
    assert got == {(i, 101 + i % 5) for i in range(100) if i % 3 == 0} | {(i, 100) for i in range(100) if i % 2}
    assert db.table_index("nothing") == db.column_index("child", "nothing") == -1


def test_children_of_the_seeds_table(spark):
    e = edges(spark, [(10, 0, 1, None), (11, 0, 1, None), (12, 0, 2, None)]).withColumn("from_table", F.when(F.col("from_gid") == 11, 1).otherwise(0))
    rows = seeds(spark, [(0, 1, None), (1, 2, None)]).withColumn("seed_table", F.lit(0))
    got = {(r.seq_id, r.row_gid) for r in C.sample(rows, e, 5, 1, same_table=True).collect()}
    assert got == {(0, 1), (0, 10), (1, 2), (1, 12)}


def test_masks_of_self_parents_and_rendering(spark):
    tok = spark.createDataFrame([(0, 0, 1, 0, 0), (0, 1, 1, 0, 1), (0, 2, 2, 0, 0)], "seq_id long, pos int, row_gid long, table_idx long, column_idx long")
    f2p = spark.createDataFrame([(1, [1, 2])], "from_gid long, f2p array<long>")
    pairs = sorted((r.q, r.kv) for r in Q.feature_mask(tok, f2p).collect())
    assert pairs == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 2)]
    assert Q.rendered(Q.column_mask(tok), 0, 3) == "#.#\n.#.\n#.#" and Q.rendered(Q.column_mask(tok), 0, 3, 2) == "#.\n.#"
    assert Q.full_mask(tok).count() == 9
    assert [tuple(r) for r in S.most_neighbours(tok, f2p).collect()] == [(0, 2)]


def test_sampler(spark):
    users = spark.createDataFrame([(i, f"u{i}", float(i)) for i in range(7)], "id long, name string, score double")
    posts = spark.createDataFrame([(100 + i, i % 7, DAY[i % 9]) for i in range(20)], "id long, user long, at timestamp_ntz")
    db = RelDatabase(spark, {"posts": posts, "users": users}, (TableSpec("posts", "id", {"user": "users"}, "at"), TableSpec("users", "id")))
    tasks = [TaskConfig(db, "users", "score", ("name",)), TaskConfig(db, "posts", "user")]
    found, slots = [], []
    for rank in range(2):
        s = ContextSampler(tasks, batch_size=4, seq_len=16, rank=rank, world=2, width=2)
        assert len(s) == 4  # 27 seeds
        for i in range(len(s)):
            rows = s.batch(i).collect()
            slots.append((rank, i, len({r.slot for r in rows}), {r.true_size for r in rows}))
            found += [(r.task, r.seq_id) for r in rows if r.slot < r.true_size and r.pos == 0]
            assert all(sum(r.is_target for r in rows if r.slot == k) == 1 for k in range(4))
            names = db.column_index("users", "name")
            assert not any(r.column_idx == names and r.task == 0 and r.bucket == 0 and r.hop == 0 for r in rows)
    assert sorted(found) == [(int(i >= 7), i) for i in range(27)] and all(n == 4 for _, _, n, _ in slots)
    assert sorted(next(iter(t)) for *_, t in slots) == [0, 3] + [4] * 6 or sum(next(iter(t)) for *_, t in slots) == 27
    first = {r.seq_id for r in s.batch(0).collect()}
    epochs = s.epochs()
    seen = [{r.seq_id for r in next(epochs).select("seq_id").distinct().collect()} for _ in range(5)]
    assert seen[0] == first and s.epoch == 1 and seen[4] != first
    masks = s.masks(s.batch(0))
    assert set(masks) == {"column", "feature", "neighbour", "full"} and masks["full"].count() >= masks["feature"].count() > 0
    with pytest.raises(IndexError):
        s.batch(4)
    with pytest.raises(ValueError):
        ContextSampler([TaskConfig(db, "users", "nothing")])


def test_generators(spark):
    from relata.sources.generate import phrases, sequences

    rows = sequences(spark, 3, 64, pool=2).collect()
    by = {k: [r for r in rows if r.seq_id == k] for k in range(3)}
    assert all(len(x) == 64 for x in by.values()) and [r.num for r in by[0]] == [r.num for r in by[2]] != [r.num for r in by[1]]
    assert all(p < r.row_gid for r in rows for p in r.f2p) and not any(r.is_target and (r.is_padding or r.semantic_type == 1) for r in rows)
    assert any(r.is_target for r in rows) and any(r.is_task_node for r in rows) and any(r.is_padding for r in rows)
    lines = [r.txt for r in phrases(spark, 50, 6).collect()]
    assert all(len(x.split()) == 6 for x in lines) and len(set(lines)) > 10 and lines == [r.txt for r in phrases(spark, 50, 6).collect()]


def test_command_line(spark, tmp_path, capsys):
    from relata.__main__ import main

    (tmp_path / "db").mkdir()
    spark.createDataFrame([(1, "a")], "id long, t string").toPandas().to_parquet(tmp_path / "db/one.parquet")
    main([str(tmp_path), "--save", str(tmp_path / "out"), "--verbose"])
    said = capsys.readouterr().out
    assert "vocabulary" in said and "saved" in said and load_snapshot(spark, str(tmp_path / "out"))["cells"].count() == 2


def test_directory_footers_and_snapshot(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "db").mkdir()
    (tmp_path / "tasks/t").mkdir(parents=True)

    def put(path, table, **meta):
        pq.write_table(pa.table(table).replace_schema_metadata({k: v for k, v in meta.items()}), path)

    put(tmp_path / "db/users.parquet", {"id": [1, 2], "name": ["a", None]}, pkey_col='"id"')
    put(tmp_path / "db/posts.parquet", {"id": [5], "user": [2], "at": pa.array([DAY[0]])}, pkey_col='"id"', time_col='"at"', fkey_col_to_pkey_table='{"user": "users"}')
    put(tmp_path / "tasks/t/train.parquet", {"user": [1, 3], "label": [True, False]}, fkey_col_to_pkey_table='{"user": "users"}', pkey_col="not json")
    assert from_footer(spark, "x", str(tmp_path / "tasks/t/train.parquet"), "train").pk is None
    db = RelDatabase.directory(spark, str(tmp_path))
    assert [s.name for s in db.specs] == ["posts", "users", "t/train"]
    assert sorted((r.from_gid, r.to_gid) for r in db.edges().collect()) == [(0, 2), (3, 1)]
    db.save(str(tmp_path / "snapshot"))
    back = load_snapshot(spark, str(tmp_path / "snapshot"))
    assert back["cells"].count() == db.cells().count() == 11 and back["rows"].count() == 5


def test_losses_and_vectors(spark):
    df = spark.createDataFrame([(2.0, 0.0, False), (0.5, 0.0, False)], "x double, z double, m boolean")
    assert df.agg(V.masked_mean(V.huber(F.col("x"), F.col("z")), F.col("m")).alias("l")).first().l is None
    assert [r[0] for r in df.select(V.huber(F.col("x"), F.col("z"))).collect()] == [1.5, 0.125]
    texts = spark.createDataFrame([("a",), ("a",), (None,), ("é😀",)], "t string")
    got = {r.t: r.embedding for r in V.embed(texts, "t", V.hashing_embedder(8)).collect()}
    assert got[None] is None and abs(sum(x * x for x in got["a"]) - 1) < 1e-3 and len(got) == 3

    def broken(some):
        if len(some) > 1 or some == ["a"]:
            raise RuntimeError
        return V.hashing_embedder(8)(some)

    got = {r.t: (r.embedding is None, r.failed) for r in V.embed(texts.coalesce(1), "t", broken).collect()}
    assert got == {"a": (True, True), None: (True, False), "é😀": (False, False)}  # one bad text takes no others with it
    empty = V.hashing_embedder(8)(["", ""])
    assert (abs((empty**2).sum(1) - 1) < 1e-3).all()
    ids = spark.createDataFrame([(0, "a b c"), (0, "a"), (1, "")], "k int, t string").select("k", V.token_ids(F.col("t"), 100, 2).alias("ids"))
    rows = sorted((r.k, len(r.ids), r["mask"]) for r in V.padded(ids, "k").collect())
    assert rows == [(0, 2, [1, 0]), (0, 2, [1, 1]), (1, 0, [])]


def test_stream_of_edges(spark, tmp_path):
    from relata.streaming.incremental import append_edges

    spark.createDataFrame([(1, 7), (2, 8)], "id long, fk long").write.parquet(str(tmp_path / "in"))
    parents = spark.createDataFrame([(7, 100)], "pk long, row_gid long")
    stream = spark.readStream.schema("id long, fk long").parquet(str(tmp_path / "in"))
    append_edges(stream, "fk", parents, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "row_gid").collect()] == [(1, 100)]


def test_ancestors_of_a_table(spark):
    """Over two ways to one ancestor the shorter counts; null, dangling and repeated keys; tables that lead back."""
    frame = lambda rows, names: spark.createDataFrame(rows, f"id long, {names}" if names else "id long")
    tables = {
        "a": frame([(0, 1, 7), (1, None, 7), (2, 99, None), (3, 2, 7)], "b long, d long"),
        "b": frame([(1, 5), (2, None)], "c long"),
        "c": frame([(5, 7)], "d long"),
        "d": frame([(7,), (7,)], ""),
    }
    specs = (TableSpec("a", "id", {"b": "b", "d": "d"}), TableSpec("b", "id", {"c": "c"}), TableSpec("c", "id", {"d": "d"}), TableSpec("d", "id"))
    db = RelDatabase(spark, tables, specs)
    for children in ((), ("a", "b")):
        all_ = seeds(spark, [(k, k, None) for k in range(4)])
        want = {(r.seq_id, r.row_gid, r.hop) for r in C.sample(all_, db.edges(*children), 3, 0).collect()}
        got = [(r.seq_id, r.row_gid, r.hop) for r in C.closure(db.above("a", *children)).collect()]
        assert set(got) == want and len(got) == len(want) > 8
    rows = C.closure(db.above("a")).where("seq_id = 0").collect()
    assert sorted((r.row_gid, r.hop) for r in rows) == [(0, 0), (4, 1), (6, 2), (8, 1)]
    with pytest.raises(ValueError):
        RelDatabase(spark, {"a": frame([(0, 0)], "up long")}, (TableSpec("a", "id", {"up": "a"}),)).above("a")


def test_parents_with_many_children(spark, monkeypatch):
    """Children are cut to the width part by part; no seed is sorted with all children of a hub."""
    import hashlib

    monkeypatch.setattr(C, "KIDS", 7)
    e = [(100 + k, c, k % 2, DAY[k % 9] if k % 5 else None) for k in range(90) for c in (0, 1)] + [(300, 0, 2, None)]
    front = [(s, p, DAY[4] if s else None) for s in range(3) for p in (0, 1, 2)]
    found = C.children(seeds(spark, front), edges(spark, e), 4)
    got = {(r.seq_id, r.parent, r["rank"], r.row_gid) for r in found.collect()}
    want = set()
    for s, p, cut in front:
        seen = {a for a, _, b, t in e if b == p and (t is None or cut is None or t <= cut)}
        order = sorted(seen, key=lambda a: (hashlib.md5(f"42:0:{s}:{a}".encode()).hexdigest(), a))[:4]
        want |= {(s, p, k, a) for k, a in enumerate(order, 1)}
    assert got == want


def test_written_tables_are_not_broadcast(spark, monkeypatch):
    """Few bytes of a file may be many rows in the driver's memory, to which Spark would gather them."""
    from relata import storage

    monkeypatch.setattr(storage, "PLAIN_BYTES", 0, raising=False)
    tok = storage.cut(spark.range(1000).selectExpr("id % 10 AS seq_id", "id AS pos", "id AS row_gid", "id % 3 AS table_idx", "id % 5 AS column_idx"))
    f2p = storage.cut(spark.range(1000).selectExpr("id AS from_gid", "array(id - 1) AS f2p"))
    for mask in (Q.column_mask(tok), Q.feature_mask(tok, f2p), Q.neighbour_mask(tok, f2p)):
        plan = mask._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize(("width", "part"), [(4, 8), (1 << 30, 1 << 16)])
def test_children_of_hubs_are_drawn_by_numpy(spark, monkeypatch, width, part):
    """Numbers of any length, times, nulls, equal edges and a depth; pairs of hubs go to NumPy."""
    import hashlib

    for name, x in (("KIDS", 20), ("PART", part), ("CHUNK", 2)):
        monkeypatch.setattr(C, name, x)
    kids = sorted({7 * 11**k % 10 ** (1 + k % 18) for k in range(120)})
    e = [(a, c, 5, DAY[k % 9] if k % 5 else None) for k, a in enumerate(kids) for c in (0, 1)] + [(9, 0, 6, None)]
    front = [(s, p, DAY[s % 8] if s % 3 else None) for s in (0, 12, 10**6, 10**17 + 1, 5) for p in (5, 6, 7)]
    rows = seeds(spark, front).withColumn("depth", F.col("row_gid") % 2)
    found = C.children(rows, edges(spark, e), width)
    got = sorted((r.seq_id, r.parent, r.depth, r["rank"], r.row_gid, r.h) for r in found.collect())
    want = []
    for s, p, cut in front:
        seen = {a for a, _, b, t in e if b == p and (t is None or cut is None or t <= cut)}
        order = sorted((hashlib.md5(f"42:0:{s}:{a}".encode()).hexdigest(), a) for a in seen)[:width]
        want += [(s, p, p % 2, k, a, h) for k, (h, a) in enumerate(order, 1)]
    assert got == sorted(want)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_least_draws_when_the_limit_lets_in_too_few(monkeypatch):
    import hashlib

    import numpy as np
    from relata.operators import draws

    monkeypatch.setattr(draws.math, "sqrt", lambda x: -9.0)  # a limit that has to be raised
    monkeypatch.setattr(draws, "LANES", 100)
    kids, since = np.arange(90, 1190), np.arange(1100) % 50
    prefixes, until = [b"42:0:%d:" % s for s in (3, 14, 159)] + [b"x" * 60], np.array([60, -1, 20, 30])
    place, kid, digest, rank = draws.Draws(kids, since).lowest(prefixes, until, 10)
    want = []
    for s, p in enumerate(prefixes):
        order = sorted((hashlib.md5(p + b"%d" % a).hexdigest().encode(), int(a)) for a, t in zip(kids, since, strict=True) if t <= until[s])[:10]
        want += [(s, a, h, k) for k, (h, a) in enumerate(order, 1)]
    assert list(zip(place.tolist(), kid.tolist(), digest.tolist(), rank.tolist(), strict=True)) == want
