from fractions import Fraction
from math import floor

import numpy as np
from pyspark.sql import functions as F

from pulseloom.llm.embeddings import decode_e8, embedding_links, linked_in_cell, shortest_vectors
from pulseloom.llm.topk import Best, CoverTree, search, search_top

SCHEMA = "vec_id long, embedding array<double>, label int"


def odd_vectors(seed=0, n=250, dim=24):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    rows = [(int(i * 5), v.tolist(), 0) for i, v in enumerate(x)]
    for i in range(80):  # near copies at cosines from 0.85 to 1
        v = x[i % 20] / np.linalg.norm(x[i % 20])
        e = r.normal(size=dim)
        e -= (e @ v) * v
        c = r.uniform(0.85, 1)
        rows.append((5000 + i, ((c * v + np.sqrt(1 - c * c) * e / np.linalg.norm(e)) * r.uniform(0.1, 9)).tolist(), 1))
    rows += [(6000 + i, x[3].tolist(), 2) for i in range(5)]
    bad = x[4].tolist()
    rows += [(7000, None, None), (7001, [], None), (7002, [0.0] * dim, 1), (7003, [None, *bad[1:]], 1), (7004, [float("nan"), *bad[1:]], 1), (7005, [float("inf"), *bad[1:]], 1), (None, bad, 1), (7006, bad[:5], 1), (7007, (np.array(bad[:5]) * 2).tolist(), 1), (7008, (x[7] * 1e200).tolist(), 1), (7009, (x[7] * 1e-200).tolist(), 1)]
    return rows


def unit(v):
    if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v):
        return None
    v = np.array(v) / np.abs(v).max()
    return v / np.linalg.norm(v)


def test_links_against_brute_force(spark):
    rows = odd_vectors()
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).repartition(3)).collect()}
    ids = [r[0] for r in rows if r[0] is not None]
    u = {r[0]: unit(r[1]) for r in rows if r[0] is not None}
    near = {a: {b for b in ids if a != b and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.9} for a in ids}
    total, found = sum(map(len, near.values())), sum(got[a].n_links for a in ids)
    assert total > 200 and 0.9 * total <= found <= total and all(got[a].n_links <= len(near[a]) for a in ids)
    for a in ids:
        assert got[a].kept == (got[a].component_id == a)
        if u[a] is None:
            assert (got[a].n_links, got[a].component_id) == (0, a)
    assert {got[6000 + i].component_id for i in range(5)} == {got[15].component_id}
    assert got[None].component_id is None and not got[None].kept and got[7008].component_id == got[7009].component_id == got[35].component_id
    assert got[7007].component_id == 7006


def near_copies(n, dim=16, seed=11):
    r = np.random.default_rng(seed)
    return r.normal(size=dim) + 0.05 * r.normal(size=(n, dim))


def test_hot_cells_are_dealt_to_tasks(spark):
    rows = odd_vectors(3) + [(10000 + i, v.tolist(), 1) for i, v in enumerate(near_copies(300))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, whole = ({(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_links(df, hot=h).collect()} for h in (40, 10**6))
    assert got == whole
    assert {r[1:] for r in got if r[0] is not None and r[0] >= 10000} == {(299, 10000, True), (299, 10000, False)}


def test_pairs_of_a_cell_are_never_held_at_once():
    import tracemalloc

    n, x = 3000, near_copies(3000)
    node, role, side = np.arange(n), np.zeros(n, np.int8), np.full(n, 2, np.int8)
    tracemalloc.start()
    found = linked_in_cell(x, role, side, node, np.ones(n, np.int64), 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found[1] == n - 1).all() and (found[2] == 0).all() and len(found[0]) == n
    assert peak < 200e6  # 4.5 million pairs: 16 bytes for the places of each and 64 for a code would be 360 MB


def test_decoding_is_nearest():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 3
    p = decode_e8(x)
    d = ((x - p) ** 2).sum(axis=1)
    for v in shortest_vectors():
        assert (((x - p - v) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert len(shortest_vectors()) == 240 and d.max() <= 1 + 1e-9


def brute_top(rows, k=20, every=20):
    """Every row for itself, in Python's integers; scores that no long holds are null."""
    good = [(i, [floor(64 * Fraction(c)) for c in v]) for i, v, _ in rows if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -x if abs(x) < 2**63 - 1 else None) for n, (x, j) in enumerate(s)]
    return sorted(out, key=str)


def found_top(df, **more):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in search_top(df, **more).collect()), key=str)


def small_blocks(monkeypatch):
    from pulseloom.llm import topk

    for name, v in (("BLOCK", 40), ("GROUP", 6), ("LEAF", 8)):
        monkeypatch.setattr(topk, name, v)


def test_top_against_brute_force(spark):
    rows = odd_vectors(2) + [(9000 + i, [0.25] * 24, 1) for i in range(30)]  # ties
    assert found_top(spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit(1)).repartition(3)) == brute_top(rows)


def test_huge_components_keep_their_order(spark):
    r = np.random.default_rng(9)
    rows = [(i, (r.normal(size=3) * 10.0 ** r.integers(0, 22)).tolist(), 0) for i in range(60)]
    rows += [(100 + i, [c, 0.0, 0.0], 0) for i, c in enumerate((1e18, 5e17, 1e17, -1e18, -5e17, 1e300, -1e300))]
    want = brute_top(rows)
    assert sum(x[3] is None for x in want) > 20 and found_top(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_finite_components_beyond_all_doubles_once_multiplied(spark):
    rows = [(0, [1.0, 2.0], 0), (20, [1e307, 1.0], 0), (1, [-1e308, 0.5], 0), (40, [-1.7e308, -1e-300], 0), (2, [0.0, 0.0], 0), (3, [3.25, -1e307], 0), (60, [float("inf"), 1.0], 0)]
    rows += [(100 + i, [float(i), 1.0 - i], 0) for i in range(30)]
    want = brute_top(rows)
    assert {w[0] for w in want} == {0, 20, 40, 100, 120} and found_top(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_negative_ties_go_to_the_smaller_id(spark):
    rows = [(20 * i + 1, [10.0, 500.0, 0.0], 0) for i in range(8300)] + [(10_000_001 + 20 * i, [10.0, 0.0, 0.0], 0) for i in range(25)] + [(10_000_000, [-40.0, 0.0, 0.0], 0)]
    got = search_top(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()
    assert [(g.vec_id, g.score) for g in got] == [(20 * i + 1, -1638400) for i in range(20)]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0], 0), (1, [1.0, -2.0], 0), (40, [3.0], 0)], SCHEMA)
    assert [tuple(r) for r in search_top(df).collect()] == [(20, 1, 1, 64 * 64 - 128 * 128)]
    assert search_top(df.where("false")).count() == 0 and embedding_links(df.where("false")).count() == 0


def test_many_blocks(spark, monkeypatch):
    small_blocks(monkeypatch)
    rows = odd_vectors(5)
    assert found_top(spark.createDataFrame(rows, SCHEMA), every=5) == brute_top(rows, every=5)


def test_repeated_rows_against_brute_force(spark, monkeypatch):
    small_blocks(monkeypatch)
    r = np.random.default_rng(7)
    x = r.normal(size=(200, 12))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += 3 * [(i, x[i].tolist(), 0) for i in range(0, 200, 3)]  # equal rows, queries and candidates
    rows += [(i, (x[i] + 0.1 * r.normal(size=12)).tolist(), 0) for i in range(0, 200, 4) for _ in range(3)]  # other vectors of an id
    rows += [(n, v.tolist(), 0) for n in (40, 41) for v in 2 * r.normal(size=(150, 12))]  # a hot query and a hot candidate
    assert found_top(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute_top(rows)


def test_repeated_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(20, [1.0], 0), (1, [2.0], 0), (1, [2.0], 0), (2, [1.0], 0)], SCHEMA)
    assert found_top(df) == [(20, 1, 1, 8192), (20, 2, 1, 8192), (20, 3, 2, 4096)]


def test_tree_covers_and_prunes():
    r = np.random.default_rng(3)
    x = (r.normal(size=(8, 16))[r.integers(0, 8, 2000)] * 30 + r.normal(size=(2000, 16))).round()
    t = CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(2000))
    for c, rad, a, z in zip(t.centers, t.radii, t.start, t.end, strict=True):
        assert np.linalg.norm(x[t.order[a:z]] - c, axis=1).max() <= rad + 1e-9
    q, best = CoverTree(x[:50]), Best(50)
    search(q, x[:50][q.order], q.order, t, x[t.order], t.order, t.order, best)
    s = x[:50][q.order] @ x.T
    for i in range(50):
        want = sorted((-int(v), j) for j, v in enumerate(s[i]) if j != q.order[i])[:20]
        assert list(zip((-best.score[i]).tolist(), best.id[i].tolist(), strict=True)) == want


def test_query_equals_its_sql(spark):
    import duckdb

    from pulseloom.llm.registry import ORACLE_SQL, QUERIES

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op10_topk"]).fetchall())
    assert sorted(map(tuple, QUERIES["op10_topk"](spark, small).collect())) == want and want
