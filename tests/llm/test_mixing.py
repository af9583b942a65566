import math
import re
from collections import Counter, defaultdict

from pulseloom.llm.mixing import mix, mix_report

from .fixtures import frame, odd_documents


def brute_targets(sizes):
    """Share out, stop what is over twice its size, share what is left again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_words_taken(spark):
    rows = odd_documents(n=400)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    df = frame(spark, rows)
    got = mix_report(df).collect()
    assert len(got) == len(rows)
    source = Counter()
    taken = Counter()
    by_id = {(r[0], size(r[1])): r[3] for r in rows}
    for g in got:
        s = by_id[(g.doc_id, g["size"])]
        assert g.source_size == sizes[s] and abs(g.target - want[s]) <= 1e-9 * max(1, want[s])
        assert 0 <= g.taken <= 2 * g["size"]
        taken[s] += g.taken
        source[s] += 1
    biggest = max(size(r[1]) for r in rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, min(biggest, 12)), (s, taken[s], t)


def test_reruns_agree_and_copies_keep_columns(spark):
    df = frame(spark, extra=("copies", "target", "rate", "l", "mean"))
    a, b = (Counter(map(tuple, mix(df).collect())) for _ in range(2))
    assert a == b and max(a.values()) <= 4  # 2 copies of a row that stands twice
    assert mix(df).columns == df.columns
    taken = {(g.doc_id, g["size"]): g.taken for g in mix_report(frame(spark)).collect()}
    n = Counter((r[0], size(r[1])) for r in odd_documents())
    for r, k in Counter((x[0], size(x[1])) for x in a.elements()).items():
        if r[1]:
            assert k * r[1] == taken[r] * n[r]


def test_empty_and_wordless_tables(spark):
    assert mix_report(frame(spark, [])).count() == 0
    rows = [(1, "", "en", "a", 0), (2, None, "en", None, 0)]
    assert {tuple(r) for r in mix_report(frame(spark, rows)).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


CLASHING = ["__s", "__l", "__mean", "__u", "__rate", "__copy", "__low0", "__most0", "__shift0", "row", "l", "u", "rate", "mean", "nth", "text_hash", "same_doc_id", "low0", "most0", "shift0", "size", "source_size", "target", "copies", "n", "at"]


def test_columns_of_any_name_pass_through(spark):
    df = frame(spark, extra=CLASHING)
    out = mix(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    plain = Counter((r.doc_id, r.text) for r in mix(frame(spark)).collect())
    assert Counter((r.doc_id, r.text) for r in rows) == plain


def test_null_and_repeated_ids_meet_the_targets(spark):
    for doc_id in (lambda i: None, lambda i: 7, lambda i: i % 3):
        for text in (lambda i: "four words in all", lambda i: f"row {i} has six words here"):
            rows = [(doc_id(i), text(i), "en", f"s{i % 3}", 1) for i in range(600)]
            got = mix_report(frame(spark, rows)).collect()
            each = size(text(0))
            taken = Counter()
            for g in got:
                taken[round(g.target, 3)] += g.taken
            assert len(taken) == 3 and all(abs(t - n) <= each for t, n in taken.items()), taken


def test_the_dual_by_bisection(spark):
    """Rates against a dual that is found another way: bisection on plain lists."""
    from pyspark.sql import functions as F

    from pulseloom.llm.mixing import CAP, targets, tilt

    sizes = {"a": [3, 9, 40, 200], "b": [5] * 30 + [70], "c": [1, 2, 3, 4]}
    by_size = spark.createDataFrame([(s, x) for s, xs in sizes.items() for x in xs], "source string, size long").groupBy("source", "size").agg(F.count("*").alias("n"))
    rows = targets(by_size).collect()
    got = tilt(by_size, rows)
    for r in rows:
        xs = sizes[r.source]
        mean = sum(xs) / len(xs)
        words = lambda l: sum(x * min(CAP, math.exp(min(50.0, l * x / mean))) for x in xs)  # noqa: B023, E731
        if r.target >= CAP * r.source_size:
            assert abs(words(got[r.source]) - r.target) < 1e-6
            continue
        low, high = -500.0, 500.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < r.target else (low, mid)
        assert abs(got[r.source] - low) < 1e-6 * max(1, abs(low))
