"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from relata.sources.schema import FIXTURE

# Columns of the provided tables in file order, with their semantic types (None: no cell).
COLUMNS = {
    "customer": "c_custkey:0 c_name:1 c_nationkey:0 c_acctbal:0 c_mktsegment:1",
    "documents": "doc_id:0 text:1 lang:1 source:1 n_chars:0",
    "events": "event_id:0 ts:2 user_id:0 event_type:1 value:0 props:1",
    "lineitem": "l_orderkey:0 l_partkey:0 l_suppkey:0 l_linenumber:0 l_quantity:0 l_extendedprice:0 l_discount:0 l_tax:0 l_returnflag:1 l_linestatus:1 l_shipdate:2",
    "nation": "n_nationkey:0 n_name:1 n_regionkey:0",
    "orders": "o_orderkey:0 o_custkey:0 o_orderstatus:1 o_totalprice:0 o_orderdate:2 o_orderpriority:1",
    "part": "p_partkey:0 p_name:1 p_brand:1 p_type:1 p_size:0 p_retailprice:0",
    "region": "r_regionkey:0 r_name:1",
    "supplier": "s_suppkey:0 s_name:1 s_nationkey:0 s_acctbal:0",
    "labels": "doc_id:0 quality:3 toxic:3",
}
NAMES = [s.name for s in FIXTURE]
CATALOG = [(t, NAMES.index(t), i, *c.split(":")) for t in NAMES for i, c in enumerate(COLUMNS[t].split())]
IDX = {(t, c): k for k, (t, _, _, c, _) in enumerate(CATALOG)}
SPEC = {s.name: s for s in FIXTURE}


def rows(t: str) -> str:
    start = " + ".join(f"(SELECT count(*) FROM {x})" for x in NAMES[: NAMES.index(t)]) or "0"
    return f"(SELECT *, row_number() OVER (ORDER BY {', '.join(SPEC[t].row_order)}) - 1 + {start} AS row_gid FROM {t})"


def edges(*children: str) -> str:
    out = []
    for t in children or NAMES:
        s = SPEC[t]
        for c, p in s.fks.items():
            out.append(f"SELECT a.row_gid from_gid, {IDX[t, c]} from_col, b.row_gid to_gid, {f'a.{s.time}' if s.time else 'NULL::TIMESTAMP'} from_ts, {str(s.kind != 'db').upper()} from_task FROM {rows(t)} a JOIN {rows(p)} b ON a.{c} = b.{SPEC[p].pk}")
    return "(" + " UNION ALL ".join(out) + ")"


def cells(*tables: str, features: bool = False) -> str:
    out = []
    for t, ti, local, c, kind in CATALOG:
        if tables and t not in tables or features and c in (SPEC[t].pk, SPEC[t].time, *SPEC[t].fks):
            continue
        num = {"0": f"{c}::DOUBLE", "1": "NULL::DOUBLE", "2": f"epoch_us({c})/1e6", "3": f"({c}=1)::INT::DOUBLE"}[kind]
        out.append(f"SELECT row_gid, {ti} table_idx, {IDX[t, c]} column_idx, {local} local_idx, {kind} semantic_type, {num} num, {c if kind == '1' else 'NULL::VARCHAR'} txt FROM {rows(t)}")
    return "(" + " UNION ALL ".join(out) + ")"


STD = "CASE WHEN count(num) > 1 THEN greatest(stddev_samp(num), 1e-8) ELSE 1 END"
TIMES = cells("orders", "lineitem", "events")
POOLED = f"(SELECT avg(num) m, {STD} s, min(num) lo, max(num) hi, count(num) n FROM {TIMES} WHERE semantic_type = 2)"


def stats(*tables: str) -> str:
    return f"(SELECT column_idx, count(num) n, coalesce(avg(num), 0) mean, {STD} std FROM {cells(*tables)} WHERE semantic_type IN (0, 3) GROUP BY 1)"


def draw(seq: str, gid: str) -> str:
    return f"md5('42:0:' || {seq} || ':' || {gid})"


def children(seeds: str, e: str, width: int) -> str:
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, parent ORDER BY h, row_gid) rank FROM (SELECT DISTINCT s.seq_id, "
        f"s.seed_ts, e.to_gid parent, e.from_gid row_gid, {draw('s.seq_id', 'e.from_gid')} h FROM {seeds} s JOIN {e} e ON e.to_gid = s.row_gid"
        f" WHERE coalesce(e.from_ts <= s.seed_ts, true))) WHERE rank <= {width})"
    )


def seeds(t: str, time: str | None = None) -> str:
    return f"(SELECT row_gid seq_id, row_gid, {time or 'NULL::TIMESTAMP'} seed_ts FROM {rows(t)})"


def closure(start: str, pairs: str) -> str:
    """Recursive body: every ancestor of start(seq_id, row_gid, root_hash, root_gid) by all paths."""
    return (
        f"SELECT seq_id, row_gid, 0 hop, root_hash, root_gid FROM {start} UNION SELECT u.seq_id, p.to_gid, u.hop + 1, u.root_hash, u.root_gid"
        f" FROM {{me}} u JOIN {pairs} p ON p.from_gid = u.row_gid"
    )


def context(seed: str, e: str, width: int, hops: int) -> str:
    """WITH clause whose last table is ctx(seq_id, row_gid, bucket, hop, root_hash, root_gid).

    Bucket b has the rows that wait for it, and their ancestors; rows at depth d, bucket plus hop, send their
    children to bucket d + 1.
    """
    first = "(hop, root_hash, root_gid)"
    pick = f"arg_min(hop, {first}) hop, arg_min(root_hash, {first}) root_hash, arg_min(root_gid, {first}) root_gid"
    out = [
        f"e AS MATERIALIZED (SELECT * FROM {e})",
        "pairs AS (SELECT DISTINCT from_gid, to_gid FROM e)",
        f"sd AS MATERIALIZED (SELECT *, {draw('seq_id', 'row_gid')} root_hash, row_gid root_gid FROM {seed})",
        "k0 AS (SELECT seq_id, row_gid, root_hash, root_gid FROM sd)",
    ]
    waiting: dict[int, list[str]] = {}
    for b in range(hops + 1):
        seen = f"v{b - 1}" if b else "(SELECT -1 seq_id, -1 row_gid)"
        if b:
            new = " UNION ".join(f"SELECT seq_id, row_gid FROM {x}" for x in waiting[b])
            out.append(f"k{b} AS MATERIALIZED (SELECT n.seq_id, n.row_gid, {draw('n.seq_id', 'n.row_gid')} root_hash, n.row_gid root_gid FROM ({new}) n ANTI JOIN {seen} v ON v.seq_id = n.seq_id AND v.row_gid = n.row_gid)")
        out.append(f"a{b} AS ({closure(f'k{b}', 'pairs').format(me=f'a{b}')})")
        out.append(f"c{b} AS MATERIALIZED (SELECT a.seq_id, a.row_gid, {b} bucket, {pick} FROM a{b} a ANTI JOIN {seen} v ON v.seq_id = a.seq_id AND v.row_gid = a.row_gid GROUP BY 1, 2)")
        out.append(f"v{b} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM c{i}' for i in range(b + 1))})")
        for h in range(hops - b):
            front = f"(SELECT c.seq_id, c.row_gid, sd.seed_ts FROM c{b} c JOIN sd ON sd.seq_id = c.seq_id WHERE c.hop = {h})"
            out.append(f"w{b}_{h} AS MATERIALIZED (SELECT seq_id, row_gid FROM {children(front, 'e', width)})")
            waiting.setdefault(b + h + 1, []).append(f"w{b}_{h}")
    return f"WITH RECURSIVE {', '.join(out)}, ctx AS (SELECT * FROM v{hops})"


def embedded(texts: str, key: str, size: int = 64) -> str:
    """Components that are not 0 of the hashing embedder's vectors, for texts(key, t) of ASCII characters."""
    return f"""(WITH p AS (SELECT {key}, '  ' || t || ' ' s FROM {texts}), g AS (SELECT {key}, s, unnest(range(1, len(s) - 1)) k FROM p),
h AS (SELECT {key}, (ord(substr(s, k, 1)) * 65536 + ord(substr(s, k + 1, 1)) * 256 + ord(substr(s, k + 2, 1)))::BIGINT * 2654435761 % 4294967296 h FROM g),
c AS (SELECT {key}, h % {size} i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE n FROM h GROUP BY 1, 2)
SELECT {key}, i, (n / (sqrt(sum(n * n) OVER (PARTITION BY {key})) + 1e-9))::FLOAT::DOUBLE x FROM c WHERE true QUALIFY n <> 0)"""


def tokens(with_: str, c: str, seq_len: int, drop: str = "false") -> str:
    order = "bucket, root_hash, root_gid, hop, row_gid"
    return (
        f"{with_}, cl AS MATERIALIZED (SELECT * FROM {c} WHERE txt IS NOT NULL OR (num IS NOT NULL AND NOT isnan(num))), "
        f"tok AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY seq_id ORDER BY {order}) - 1 node FROM (SELECT *, row_number()"
        f" OVER (PARTITION BY seq_id ORDER BY {order}, local_idx) - 1 pos FROM ctx JOIN cl USING (row_gid) WHERE NOT (bucket = 0 AND hop = 0"
        f" AND {drop})) WHERE pos < {seq_len})"
    )


def oracle() -> dict[str, str]:
    customer_context = context(seeds("customer"), edges("orders", "customer", "nation"), 8, 1)
    tok = tokens(customer_context, cells("customer", "orders", "nation", "region"), 64)
    f2p = (
        f", f2p AS (SELECT from_gid, list(to_gid ORDER BY from_col, to_gid)[1:5] f2p FROM {edges('orders', 'customer', 'nation')} GROUP BY 1), "
        f"par AS (SELECT DISTINCT seq_id, pos, unnest(f2p) parent FROM tok JOIN f2p ON tok.row_gid = f2p.from_gid)"
    )
    col = "SELECT q.seq_id, q.pos q, k.pos kv FROM tok q JOIN tok k USING (seq_id, table_idx, column_idx)"
    up = "SELECT p.seq_id, p.pos q, k.pos kv FROM par p JOIN tok k ON k.seq_id = p.seq_id AND k.row_gid = p.parent"
    feat = f"SELECT q.seq_id, q.pos q, k.pos kv FROM tok q JOIN tok k USING (seq_id, row_gid) UNION {up}"
    neigh = f"SELECT DISTINCT seq_id, kv q, q kv FROM ({up})"
    order_context = context(seeds("orders", "o_orderdate"), edges("orders", "customer", "nation", "lineitem", "supplier"), 8, 1)
    places = f"(SELECT row_gid, row_number() OVER (ORDER BY md5('42:0:' || row_gid), row_gid) - 1 place FROM {rows('customer')})"
    unit = "list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9))"
    short = "list_transform(embedding[1:16], lambda x: x::DOUBLE / (sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])) + 1e-9))"
    pred = f"(SELECT row_gid, l_discount * 10 x, l_tax * 10 z, row_gid % 10 = 0 mask, row_gid % 4 kind FROM {rows('lineitem')})"
    huber = "(CASE WHEN abs(x - z) <= 1 THEN 0.5 * (x - z) * (x - z) ELSE abs(x - z) - 0.5 END)"
    bce = "(greatest(x, 0) - x * (CASE WHEN {z} > 0 THEN 1 ELSE 0 END) + ln(1 + exp(-abs(x))))"
    values = ", ".join(f"({ti}, '{t}', {k}, {local}, '{c}', {str(SPEC[t].pk == c).upper()}, {str(SPEC[t].time == c).upper()}, {NAMES.index(SPEC[t].fks[c]) if c in SPEC[t].fks else -1}, '{c} of {t}', {kind})" for k, (t, ti, local, c, kind) in enumerate(CATALOG))
    catalog = (
        f"(SELECT * FROM (VALUES {values}) v(table_idx, table_name, column_idx, local_idx, name, is_pk, is_time, fk_table_idx, description, "
        f"semantic_type))"
    )
    census = " UNION ALL ".join(f"SELECT '{s.name}' table_name, count(*) n_rows, {f"'{s.pk}'" if s.pk else 'NULL'} pk, {f"'{s.time}'" if s.time else 'NULL'} time_col, {len(s.fks)} n_fks FROM {s.name}" for s in FIXTURE)
    words = "least(512, len(list_filter(string_split_regex(txt, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')))"
    nodes = " UNION ALL ".join(f"SELECT row_gid, {NAMES.index(x.name)} table_idx, {f'{x.pk}::VARCHAR' if x.pk else 'NULL'} pk FROM {rows(x.name)}" for x in FIXTURE)
    sampled = (
        f"(SELECT *, row_number() OVER (ORDER BY md5('42:0:' || seq_id), seq_id) - 1 place FROM (SELECT 0::BIGINT task, row_gid, row_gid seq_id"
        f" FROM {rows('customer')} UNION ALL SELECT 1, row_gid, row_gid - (SELECT min(row_gid) FROM {rows('labels')}) + (SELECT count(*)"
        f" FROM customer) FROM {rows('labels')}))"
    )
    vocab = lambda *t: f"(SELECT txt, row_number() OVER (ORDER BY txt) - 1 text_id FROM (SELECT DISTINCT txt FROM {cells(*t)} WHERE txt IS NOT NULL))"
    norm = lambda *t: f"(SELECT c.*, (num - mean) / std norm FROM {cells(*t)} c JOIN {stats(*t)} USING (column_idx))"
    o_times = f"(SELECT avg(num) m, {STD} s FROM {cells('orders')} WHERE semantic_type = 2)"
    return {
        "table_census": f"WITH c AS ({census}) SELECT * FROM c UNION ALL SELECT 'TOTAL', sum(n_rows)::BIGINT, NULL, NULL, sum(n_fks)::BIGINT FROM c",
        "column_catalog": (
            f"SELECT table_idx::BIGINT table_idx, table_name, column_idx::BIGINT column_idx, local_idx::BIGINT local_idx, name, is_pk, is_time, "
            f"fk_table_idx::BIGINT fk_table_idx, description FROM {catalog}"
        ),
        "semantic_type_counts": f"SELECT semantic_type::BIGINT semantic_type, count(*) n FROM {catalog} GROUP BY 1",
        "auto_target": (
            f"WITH c AS ({census}) SELECT table_name, name, column_idx::BIGINT column_idx FROM {catalog} JOIN c USING (table_name) WHERE n_rows >= 32"
            f" AND semantic_type = 0 AND NOT is_pk AND fk_table_idx < 0 AND NOT is_time ORDER BY table_idx, column_idx LIMIT 1"
        ),
        "row_gid_orders": f"SELECT row_gid, o_orderkey FROM {rows('orders')}",
        "row_gid_lineitem": f"SELECT row_gid, l_orderkey, l_linenumber::BIGINT l_linenumber, l_partkey FROM {rows('lineitem')}",
        "pk_lookup": f"SELECT c_custkey pk, max(row_gid) row_gid FROM {rows('customer')} GROUP BY 1",
        "cells_orders_all": (
            f"SELECT row_gid, column_idx::BIGINT column_idx, semantic_type::BIGINT semantic_type, round(num, 6) + 0.0::DOUBLE num, txt"
            f" FROM {cells('orders')}"
        ),
        "cells_orders_features": f"SELECT row_gid, column_idx::BIGINT column_idx, txt, round(num, 6) + 0.0::DOUBLE num FROM {cells('orders', features=True)}",
        "null_cell_counts": f"SELECT column_idx::BIGINT column_idx, count(*) n, count(*) FILTER (num IS NULL AND txt IS NULL) n_null FROM {cells()} GROUP BY 1",
        "epoch_seconds_lineitem": f"SELECT row_gid, num FROM {cells('lineitem')} WHERE column_idx = {IDX['lineitem', 'l_shipdate']}",
        "timestamp_range": f"SELECT lo least, hi most FROM {POOLED}",
        "column_stats": f"SELECT column_idx::BIGINT column_idx, n, round(mean, 4) mean, round(std, 4) std FROM {stats()}",
        "global_datetime_stats": f"SELECT n, round(m, 0) mean, round(s, 0) std FROM {POOLED}",
        "zscore_orders": f"SELECT row_gid, column_idx::BIGINT column_idx, round(norm, 5) + 0.0::DOUBLE norm FROM {norm('orders')} WHERE semantic_type = 0",
        "zscore_boolean_labels": f"SELECT row_gid, column_idx::BIGINT column_idx, round(norm, 6) + 0.0::DOUBLE norm FROM {norm('labels')} WHERE semantic_type = 3",
        "zscore_datetime_global": f"SELECT row_gid, round((num - m) / s, 5) norm FROM {cells('orders')}, {POOLED} WHERE semantic_type = 2",
        "vocab_ids": f"SELECT text_id, txt FROM {vocab()}",
        "vocab_size": f"SELECT count(DISTINCT txt) n_texts FROM {cells()}",
        "text_ids_part": f"SELECT row_gid, column_idx::BIGINT column_idx, text_id FROM {cells('part')} JOIN {vocab('part')} USING (txt)",
        "token_length_stats": (
            f"SELECT sum(n)::BIGINT total, min(n)::BIGINT least, max(n)::BIGINT most, round(avg(n), 6) + 0.0::DOUBLE mean FROM (SELECT {words} n"
            f" FROM {vocab()})"
        ),
        "column_descriptions": f"SELECT column_idx::BIGINT column_idx, description FROM {catalog}",
        "cardinality_report": (
            f"SELECT 'tables' what, {len(NAMES)}::BIGINT n UNION ALL SELECT 'columns', {len(CATALOG)} UNION ALL SELECT 'rows', sum(n_rows)::BIGINT"
            f" FROM ({census}) UNION ALL SELECT 'edges', count(*) FROM {edges()} UNION ALL SELECT 'cells_' || semantic_type, count(*) FROM {cells()}"
            f" GROUP BY semantic_type"
        ),
        "epoch_to_date": f"SELECT row_gid, strftime(o_orderdate, '%Y-%m-%d') AS day FROM {rows('orders')}",
        "text_preview": "SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' ELSE text END preview FROM documents",
        "sample_previews": (
            f"SELECT row_gid, {NAMES.index('customer')}::BIGINT table_idx, c_custkey::VARCHAR pk FROM {rows('customer')} UNION ALL SELECT row_gid, "
            f"{NAMES.index('orders')}, o_orderkey::VARCHAR FROM {rows('orders')} ORDER BY row_gid LIMIT 20"
        ),
        "memory_estimate": "SELECT sum(len(embedding) * 2)::BIGINT n_bytes, count(*) FILTER (len(embedding) > 0) n_embedded, count(*) n_vectors FROM embeddings",
        "fk_edges_count": f"SELECT from_col::BIGINT from_col, count(*) n FROM {edges()} GROUP BY 1",
        "fk_edges_lineitem": f"SELECT from_gid, from_col::BIGINT from_col, to_gid FROM {edges('lineitem')}",
        "degree_stats": " UNION ALL ".join(f"SELECT sum(n)::BIGINT n_edges, max(n) most, count(*) n_rows, '{x}' side FROM (SELECT count(*) n FROM {edges()} GROUP BY {x}_gid)" for x in ("from", "to")),
        "f2p_neighbors_top5": f"SELECT from_gid, array_to_string(list(to_gid ORDER BY from_col, to_gid)[1:5], ',') f2p FROM {edges('lineitem', 'orders')} GROUP BY 1",
        "p2f_children": f"SELECT to_gid, count(*) n, sum(from_gid)::BIGINT sum_gid, min(from_gid) least FROM {edges('orders')} GROUP BY 1",
        "dangling_fk": "SELECT count(*) n FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey",
        "task_entity_left": (
            f"SELECT l.row_gid, coalesce(d.row_gid, -1) entity_gid, l.quality = 1 quality FROM {rows('labels')} l LEFT"
            f" JOIN {rows('documents')} d USING (doc_id)"
        ),
        "temporal_children": (
            f"SELECT seq_id, count(*) n, sum(row_gid)::BIGINT sum_gid FROM {children(seeds('orders', 'o_orderdate'), edges('lineitem'), 1 << 30)}"
            f" GROUP BY 1"
        ),
        "temporal_children_nulltime": f"SELECT seq_id, count(*) n, sum(row_gid)::BIGINT sum_gid FROM {children(seeds('customer'), edges('orders'), 1 << 30)} GROUP BY 1",
        "children_width_bound": f"SELECT seq_id, row_gid, rank FROM {children(seeds('supplier'), edges('lineitem'), 8)}",
        "ancestor_closure": (
            f"{context(seeds('lineitem'), edges('lineitem', 'orders', 'customer', 'supplier', 'nation'), 8, 0)} SELECT seq_id, row_gid, hop::BIGINT hop"
            f" FROM ctx"
        ),
        "context_rows": f"{order_context} SELECT seq_id, row_gid, bucket::BIGINT bucket, hop::BIGINT hop FROM ctx",
        "hop_distance": f"{order_context} SELECT (bucket + hop)::BIGINT AS depth, count(*) n FROM ctx GROUP BY 1",
        "context_tokens_budget": f"{tok} SELECT seq_id, pos, row_gid, column_idx::BIGINT column_idx FROM tok",
        "seed_drop_columns": (
            f"{tokens(context(seeds('customer'), edges('customer', 'nation'), 8, 0), cells('customer', 'nation', 'region'), 64, f'column_idx = {IDX["customer", "c_acctbal"]}')} SELECT seq_id, "
            f"pos, column_idx::BIGINT column_idx FROM tok"
        ),
        "target_mask": (
            f"{tok} SELECT seq_id, pos, column_idx::BIGINT column_idx, round(num, 6) + 0.0::DOUBLE num FROM tok WHERE bucket = 0 AND hop = 0"
            f" AND column_idx = {IDX['customer', 'c_acctbal']}"
        ),
        "task_node_flag": (
            f"{tokens(context(seeds('labels'), edges('labels'), 8, 0), cells('labels', 'documents'), 64)} SELECT seq_id, pos, "
            f"table_idx = {NAMES.index('labels')} is_task_node, bucket = 0 AND hop = 0 AND column_idx = {IDX['labels', 'quality']} is_target FROM tok"
        ),
        "typed_slots": (
            f"SELECT c.row_gid, c.column_idx::BIGINT column_idx, round(CASE WHEN semantic_type = 0 THEN (num - mean) / std ELSE 0 END, 5) number, "
            f"round(CASE WHEN semantic_type = 2 THEN (num - m) / s ELSE 0 END, 5) \"datetime\", 0::DOUBLE \"boolean\" FROM {cells('orders')} c LEFT"
            f" JOIN {stats('orders')} USING (column_idx), {o_times}"
        ),
        "local_node_index": f"{tok} SELECT DISTINCT seq_id, row_gid, node FROM tok",
        "attn_column": f"{tok} {col}",
        "attn_feature": f"{tok}{f2p} {feat}",
        "attn_neighbor": f"{tok}{f2p} {neigh}",
        "attn_density": (
            f"{tok}{f2p}, m AS (SELECT 'column' kind, * FROM ({col}) UNION ALL SELECT 'feature', * FROM ({feat}) UNION ALL SELECT 'neighbour', *"
            f" FROM ({neigh})), n AS (SELECT seq_id, count(*) cells FROM tok GROUP BY 1) SELECT seq_id, kind, pairs, "
            f"round(pairs * 100.0::DOUBLE / (cells * cells), 6) density FROM (SELECT kind, seq_id, count(*) pairs FROM m GROUP BY 1, 2)"
            f" JOIN n USING (seq_id)"
        ),
        "attn_full": (
            f"{tok}, n AS (SELECT seq_id, count(*) n, sum(pos)::BIGINT sum_kv FROM tok GROUP BY 1) SELECT seq_id, pos q, n, sum_kv FROM tok"
            f" JOIN n USING (seq_id)"
        ),
        "most_neighbours": (
            f"{tok}{f2p}, r AS (SELECT DISTINCT seq_id, row_gid FROM tok), u AS (SELECT DISTINCT f.seq_id, f.row_gid, p.parent FROM r f"
            f" JOIN (SELECT from_gid, unnest(f2p) parent FROM f2p) p ON p.from_gid = f.row_gid), i AS (SELECT u.seq_id, u.row_gid, count(*) n FROM u"
            f" JOIN r ON r.seq_id = u.seq_id AND r.row_gid = u.parent GROUP BY 1, 2) SELECT s.seq_id, greatest(1, coalesce(max(n), 1))::BIGINT most"
            f" FROM (SELECT DISTINCT seq_id FROM r) s LEFT JOIN i ON i.seq_id = s.seq_id GROUP BY 1"
        ),
        "context_two_hops": (
            f"{context(seeds('customer'), edges('orders', 'customer', 'nation', 'lineitem', 'supplier'), 8, 2)} SELECT seq_id, row_gid, "
            f"bucket::BIGINT bucket, hop::BIGINT hop FROM ctx"
        ),
        "context_full_size": (
            f"{tokens(context(seeds('supplier'), edges('lineitem', 'supplier', 'nation', 'orders'), 256, 1), cells('supplier', 'nation', 'region', 'lineitem', 'orders', 'part', 'customer'), 1024)} SELECT seq_id, "
            f"count(*) n_cells, max(node) last_node, sum(row_gid)::BIGINT sum_gid, sum(pos * column_idx)::BIGINT \"check\", count(*) FILTER (bucket = 0"
            f" AND hop = 0 AND column_idx = {IDX['supplier', 's_acctbal']}) n_targets FROM tok GROUP BY 1"
        ),
        "epoch_orders": " UNION ALL ".join(f"SELECT {e}::BIGINT epoch, row_gid, row_number() OVER (ORDER BY md5('42:{e}:' || row_gid), row_gid) - 1 place FROM {rows('customer')}" for e in range(3)),
        "batch_collate": (
            f"{tok}, n AS (SELECT seq_id, count(*) n_cells FROM tok GROUP BY 1), p AS {places} SELECT place // 128 batch_idx, "
            f"(place % 128) // 32 AS rank, count(*) n, string_agg((place % 32) || ':' || seq_id || ':' || n_cells, ',' ORDER BY place) slots FROM p JOIN n"
            f" ON n.seq_id = p.row_gid GROUP BY 1, 2"
        ),
        "sampler_places": f"SELECT task, row_gid, seq_id, place FROM {sampled}",
        "sampler_batch": " UNION ALL ".join(
            f"SELECT * FROM ({tokens(context(f'(SELECT seq_id, row_gid, NULL::TIMESTAMP seed_ts FROM {sampled} WHERE task = {k} AND place BETWEEN 16 AND 31)', edges(), 8, 1), cells(), 64, drop)} "
            f"SELECT place - 16 slot, {k}::BIGINT task, t.seq_id, 16::BIGINT true_size, count(*) n_cells, "
            f"count(*) FILTER (bucket = 0 AND hop = 0 AND column_idx = {IDX[table, target]}) n_targets, count(*) FILTER (table_idx = {NAMES.index(table)}) n_task_cells "
            f"FROM tok t JOIN {sampled} s ON s.seq_id = t.seq_id GROUP BY ALL)"
            for k, (table, target, drop) in enumerate((("customer", "c_acctbal", f"column_idx = {IDX['customer', 'c_mktsegment']}"), ("labels", "quality", "false")))
        ),
        "seed_tasks": f"SELECT task, row_gid, seq_id FROM {sampled}",
        "row_lookup": f"SELECT row_gid, table_idx::BIGINT table_idx, pk FROM ({nodes}) WHERE row_gid IN (0, (SELECT min(row_gid) FROM {rows('orders')}), (SELECT min(row_gid) + 7 FROM {rows('orders')}), (SELECT min(row_gid) + 1 FROM {rows('supplier')}))",
        "mismatched_cells": (
            f"WITH o AS (SELECT column_idx, semantic_type, num, txt FROM {cells('orders', 'events')}), "
            f"x AS (SELECT column_idx, CASE column_idx WHEN {IDX['events', 'props']} THEN 0 WHEN {IDX['events', 'event_type']} THEN 3 WHEN {IDX['orders', 'o_orderpriority']} THEN 0 "
            f"WHEN {IDX['orders', 'o_orderkey']} THEN 1 WHEN {IDX['events', 'user_id']} THEN 3 ELSE semantic_type END kind, semantic_type, num, txt FROM o) "
            f"SELECT column_idx::BIGINT column_idx, kind::BIGINT semantic_type, count(*) n, "
            f"count(CASE WHEN kind = semantic_type THEN num WHEN kind = 1 THEN NULL WHEN semantic_type = 1 AND kind = 0 THEN TRY_CAST(txt AS DOUBLE) "
            f"WHEN semantic_type = 1 THEN CASE WHEN lower(txt) IN ('t', 'true', 'y', 'yes', '1', 'f', 'false', 'n', 'no', '0') THEN 1 END "
            f"WHEN num IN (0, 1) THEN num END) n_num, count(CASE WHEN kind = 1 THEN coalesce(txt, num::VARCHAR) END) n_txt FROM x GROUP BY 1, 2"
        ),
        "throughput_summary": "SELECT count(*) n, round(sum(value / 100), 4) total, round(avg(value / 100), 4) mean, round(min(value / 100), 4) least, round(max(value / 100), 4) most, count(*) items, round(count(*)::DOUBLE / sum(value / 100), 4) rate FROM events",
        "swap_embedder": f"SELECT txt, i, round(x, 6) + 0.0::DOUBLE x FROM {embedded('(SELECT txt, txt t FROM ' + vocab('nation', 'region') + ')', 'txt', 16)}",
        "half_vectors": "SELECT vec_id, (2 * len(embedding))::BIGINT n_bytes FROM embeddings",
        "index_lookups": (
            f"SELECT * FROM (VALUES ('orders', 'o_custkey', {NAMES.index('orders')}::BIGINT, {IDX['orders', 'o_custkey']}::BIGINT), ('orders', 'nothing', "
            f"{NAMES.index('orders')}, -1), ('nothing', 'o_custkey', -1, -1), ('labels', 'toxic', {NAMES.index('labels')}, "
            f"{IDX['labels', 'toxic']})) v(table_name, name, table_idx, column_idx)"
        ),
        "describe_counts": (
            f"SELECT 'tables' what, {len(NAMES)}::BIGINT n UNION ALL SELECT 'columns', {len(CATALOG)} UNION ALL SELECT 'rows', sum(n_rows)::BIGINT"
            f" FROM ({census}) UNION ALL SELECT 'texts', count(DISTINCT txt) FROM {cells()} UNION ALL SELECT 'edges', count(*) FROM {edges()}"
        ),
        "describe_previews": (
            f"(SELECT 'vocabulary' what, substring(txt, 1, 40) AS value FROM {vocab()} ORDER BY text_id LIMIT 50) UNION ALL (SELECT 'edge', "
            f"from_gid || ' ' || from_col || ' ' || to_gid FROM {edges()} ORDER BY from_gid, from_col, to_gid LIMIT 30) UNION ALL (SELECT 'key', "
            f"table_idx || ' ' || pk || ' ' || row_gid FROM ({nodes}) WHERE pk IS NOT NULL ORDER BY row_gid LIMIT 20)"
        ),
        "hash_embed_vocab": f"SELECT txt, i, round(x, 6) + 0.0::DOUBLE x FROM {embedded('(SELECT txt, txt t FROM ' + vocab('part', 'nation', 'region') + ')', 'txt')}",
        "column_vectors": (
            f"SELECT column_idx::BIGINT column_idx, i, round(x, 6) + 0.0::DOUBLE x"
            f" FROM {embedded(f'(SELECT column_idx, description t FROM {catalog})', 'column_idx')}"
        ),
        "cell_vectors": (
            f"SELECT row_gid, column_idx::BIGINT column_idx, CASE WHEN txt IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE text_norm, 1.0::DOUBLE column_norm"
            f" FROM {cells('part')}"
        ),
        "padded_tokens": (
            f"SELECT txt, max(n) OVER (PARTITION BY len(txt) % 7)::BIGINT width, n::BIGINT n, n::BIGINT n_ids FROM (SELECT txt, {words} n"
            f" FROM {vocab('part', 'nation')})"
        ),
        "batch_summary": (
            f"{tok} SELECT seq_id, count(*) n_cells, count(*) FILTER (bucket = 0 AND hop = 0 AND column_idx = {IDX['customer', 'c_acctbal']}) n_masked, "
            f"count(DISTINCT row_gid) n_rows FROM tok GROUP BY 1"
        ),
        "epoch_shuffle": f"SELECT row_gid, place FROM {places}",
        "batch_assignment": f"SELECT row_gid, place // 128 batch_idx, (place % 128) // 32 AS rank, place % 32 slot FROM {places}",
        "wraparound_slots": (
            f"WITH p AS {places}, n AS (SELECT count(*) n FROM customer), g AS (SELECT unnest(range(((n + 127) // 128) * 128)) id, n"
            f" FROM n) SELECT id // 128 batch_idx, (id // 32) % 4 AS rank, id % 32 slot, row_gid, greatest(0, least(32, "
            f"n - (id // 32) * 32))::BIGINT true_size FROM g JOIN p ON p.place = g.id % n"
        ),
        "num_batches": "SELECT ceil(count(*) / 128.0)::BIGINT n FROM customer",
        "sequence_pack": (
            f"{tok} SELECT seq_id, count(*) n_cells, array_to_string(list_concat(list(column_idx ORDER BY pos), list_transform(range(64 - count(*)), "
            f"lambda x: 0)), ',') \"columns\", 64 - count(*) n_padding FROM tok GROUP BY 1"
        ),
        "split_rows": "SELECT CASE WHEN o_orderdate < '1999-01-01' THEN 'train' WHEN o_orderdate < '2000-01-01' THEN 'val' ELSE 'test' END split, count(*) n, sum(o_orderkey)::BIGINT sum_key FROM orders GROUP BY 1",
        "seed_enumeration": f"SELECT 0::BIGINT db_id, row_gid, true is_task_row FROM {rows('labels')}",
        "vec_l2_normalize": f"SELECT vec_id, round(list_dot_product(v, v), 6) norm2, round(v[1], 6) + 0.0::DOUBLE AS first FROM (SELECT vec_id, {unit} v FROM embeddings)",
        "vec_prefix_renorm": (
            f"SELECT vec_id, len(v) n, round(v[1], 6) + 0.0::DOUBLE AS first, round(v[16], 6) + 0.0::DOUBLE AS last FROM (SELECT vec_id, {short} v"
            f" FROM embeddings)"
        ),
        "vec_mean_pool_by_label": "SELECT label::BIGINT AS label, (i - 1)::BIGINT i, round(avg(x::DOUBLE), 6) + 0.0::DOUBLE mean FROM (SELECT label, unnest(embedding) x, generate_subscripts(embedding, 1) i FROM embeddings) GROUP BY 1, 2",
        "vec_last_token": "SELECT label::BIGINT AS label, round(arg_max(embedding, vec_id)[1]::DOUBLE, 6) + 0.0::DOUBLE AS first FROM embeddings GROUP BY 1",
        "cosine_topk": (
            f"WITH e AS (SELECT vec_id, label, {unit} v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) q, min(vec_id) q_id FROM e GROUP BY 1), "
            f"n AS (SELECT e.label, vec_id, round(list_dot_product(v, q), 6) cosine FROM e JOIN f USING (label)"
            f" WHERE vec_id <> q_id) SELECT label::BIGINT AS label, vec_id, k, cosine FROM (SELECT *, row_number() OVER (PARTITION BY label"
            f" ORDER BY cosine DESC, vec_id) k FROM n) WHERE k <= 5"
        ),
        "huber_loss": f"SELECT round(avg({huber}), 6) loss FROM {pred}",
        "bce_logits": f"SELECT round(avg({bce.format(z='(z - 0.3)')}), 6) loss FROM {pred}",
        "masked_mean_loss": (
            f"SELECT round(sum(CASE WHEN NOT mask THEN 0 WHEN kind IN (0, "
            f"2) THEN {huber} WHEN kind = 3 THEN {bce.format(z='z')} ELSE 0 END) / count(*) FILTER (mask), 6) loss FROM {pred}"
        ),
        "running_loss": f"SELECT row_gid // 5000 step, round(avg({huber}), 6) loss, count(*) n FROM {pred} GROUP BY 1",
    }
