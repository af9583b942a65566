"""Small documents with every odd case, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of ronta mentir osque Idal pelo, vanor. strin edlo onti hea with Thon. ublé ção größe 12 3,5 — x".split()


def odd_documents(seed=0, n=60):
    r = random.Random(seed)
    para = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    rows = []
    for i in range(n):
        text = "\n".join(para(r.randrange(3, 40)) for _ in range(r.randrange(1, 5)))
        rows.append([i * 7, text, "en", f"s{i % 4}", len(text)])
    for i in range(8):  # exact and near copies, some with smaller ids
        a = rows[r.randrange(n)]
        rows.append([1000 + i, a[1], "en", "s0", len(a[1])])
        words = a[1].split(" ")
        words[r.randrange(len(words))] = "CHANGED"
        rows.append([i * 7 + 3, " ".join(words), "fr", "s1", 0])
    shared = para(30)
    rows += [[2000 + i, f"{para(5)}\n{shared}\n{para(12)}", "de", "s2", 1] for i in range(4)]
    rows += [
        [3000, None, None, None, None],
        [3001, "", "en", "s1", 0],
        [3002, " \n\t \n", "en", "s1", 5],
        [3003, "a" * 5000, "en", "s3", 5000],
        [3004, para(6000), "en", "s3", 1],
        [None, "no id at all in this row here", "en", "s0", 1],
        [None, None, None, None, None],
        [3005, "<|endoftext|> is <|startoftext|> text", "en", None, 2],
        [3006, "emoji 😀 İ Σσς ﬁ é 한국어 \x00 \x1c x", "en", "sé", 2],
        [3007, rows[0][1], "en", "s0", 1],
        [3007, rows[0][1], "en", "s0", 1],  # a repeated row
        [3008, "== ==" * 40, "en", "s0", 1],
    ]
    r.shuffle(rows)
    return [tuple(x) for x in rows]


def frame(spark, rows=None, extra=()):
    """Documents with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})


def key(t):
    return tuple((x is None, x) for x in t)
