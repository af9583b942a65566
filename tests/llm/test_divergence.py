"""Operator 11 against a plain loop with Python's integers, and against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from pulseloom.llm import divergence
from pulseloom.llm.registry import ORACLE_SQL, QUERIES

from .fixtures import SCHEMA, frame, key, odd_documents

SMALL = "/root/testdata/sf0.001"


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = ["".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        f = lambda x, y: (x - y) * (x - y) // (x + y)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for n, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, n))
    return sorted(out, key=key)


def corpus():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéñ한") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    rows = odd_documents()
    for i in range(150):
        words = [r.choice(vocabulary[: r.randrange(2, 60)]) for _ in range(r.randrange(0, 25))]
        rows.append((5000 + i, r.choice([" ", "1", "\n"]).join(words).title(), r.choice(["en", "fr", None]), r.choice(["a", "b", "s1", "", None, "é"]), 1))
    rows += [(6000 + i, f"same tie{'abcdefghij'[i % 10]}x tie{'abcdefghij'[i % 10]}yz", "xx", "s", 1) for i in range(100)] + [(6200, "", "xx", "t", 0), (6300, None, "yy", "a", 0), (6301, "rare", "yy", "b", 0)]
    return rows


@pytest.mark.parametrize(("least", "top", "block", "slice_rows", "finish"), [(10, 10, 256, 10_000, 4096), (2, 3, 2, 5, 0), (1, 25, 3, 40, 1)])
def test_report_equals_brute_force(spark, least, top, block, slice_rows, finish):
    rows = corpus()
    got = divergence.divergence_report(frame(spark, rows, ("term", "N", "a.b", "x`y")), least, top, block, slice_rows, finish)
    assert sorted(map(tuple, got.collect()), key=key) == brute(rows, least, top)


def test_counts_gathered_in_portions(spark):
    rows = corpus()
    once, often = (sorted(map(tuple, divergence.term_counts(frame(spark, rows), g).collect()), key=key) for g in (10**6, 20))
    assert once == often


def test_ties_along_common_and_short_beginnings(spark):
    items = ["a" * i for i in range(1, 40)] + ["a" * 30 + c for c in "bcd"] + ["é" * 5, "é" * 5 + "a", "z", "aé"]
    rows = [("g", 7, x) for x in items] + [("g", 9, "top"), ("h", 7, "one"), ("i", 2**30 - 1, "x"), ("i", 0, "y"), ("i", 1024, "z")]
    path_rows = spark.createDataFrame(rows, "g string, value long, item string")
    for k in (1, 7, 33, 100):
        got = {(r.g, r["rank"]): (r.value, r.item) for r in divergence.radix_top(path_rows, ["g"], "value", "item", k, finish=0).collect()}
        want = {}
        for g in "ghi":
            own = sorted(((v, x) for h, v, x in rows if h == g), key=lambda t: (-t[0], t[1].encode()))[:k]
            want |= {(g, n): t for n, t in enumerate(own, 1)}
        assert got == want


def test_shares_beyond_products_of_64_bits(spark):
    pairs = [(0, 4), (10**13, 2 * 10**13 + 7), (8 * 10**15, 9 * 10**15), (2 * 10**12 + 1, 3 * 10**12)]
    want = [1 + 10**9 * (c + 2) // w for c, w in pairs]
    df = spark.createDataFrame(pairs, "c long, w long")
    assert [r.p for r in divergence.share_of(df, df.c, df.w, "p").collect()] == want
    import numpy as np

    assert divergence.share(*np.array(pairs, np.int64).T).tolist() == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op11_divergence"]).fetchall(), key=key)
    assert sorted(map(tuple, QUERIES["op11_divergence"](spark, SMALL).collect()), key=key) == want and want


def test_empty_tables(spark):
    assert divergence.divergence_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert divergence.divergence_report(frame(spark, [(1, None, None, None, None)])).collect() == []
