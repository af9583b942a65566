import random
import re

import numpy as np
import xxhash

from pulseloom.llm.components import components
from pulseloom.llm.simhash import cells, fingerprint, keep_one, near_duplicate_report

from .fixtures import frame, key, odd_documents


def brute_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = {}
    for r in rows:
        if r[0] is not None:
            fp.setdefault(brute_fingerprint(r[1]), set()).add(r[0])
    prints = list(fp)
    label = {p: min(fp[p]) for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_report_against_brute_force(spark):
    rows = odd_documents()
    label = brute(rows)
    want = [(r[0], f"{brute_fingerprint(r[1]):016x}", label.get(brute_fingerprint(r[1]))) for r in rows]
    got = [tuple(r) for r in near_duplicate_report(frame(spark, extra=("fingerprint", "node", "fp"))).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_one_of_each_group_stays(spark):
    rows = odd_documents()
    label = brute(rows)
    want = {label[brute_fingerprint(r[1])] for r in rows if r[0] is not None}
    df = frame(spark, extra=("component_id", "fingerprint"))
    out = keep_one(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == sorted(want)


def test_pairs_within_the_bound_always_share_a_cell():
    r = random.Random(1)
    a = [r.getrandbits(64) for _ in range(2000)]
    b = [x ^ sum(1 << k for k in r.sample(range(64), r.randrange(5))) for x in a]
    keys = zip(cells(np.array(a, np.uint64)), cells(np.array(b, np.uint64)), strict=True)
    assert np.any([x == y for x, y in keys], axis=0).all()


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert near_duplicate_report(frame(spark, [])).count() == 0 and fingerprint(None) == fingerprint(" \n") == 0


def test_unary_counts_have_the_manhattan_distance():
    from pulseloom.llm.simhash import segment_counts, unary_counts

    r = np.random.default_rng(4)
    a = r.integers(0, 2**63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64))
    manhattan = np.abs(segment_counts(a).astype(int) - segment_counts(b).astype(int)).sum(axis=1)
    assert (np.bitwise_count(unary_counts(a) ^ unary_counts(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all() and (manhattan < np.bitwise_count(a ^ b)).any()
