import math
import random
import re
import zlib

import numpy as np

from pulseloom.llm.toxicity import Scorer, fit, held_out, toxicity, toxicity_report, train

from .fixtures import WORDS, frame, odd_documents


def labelled(n=900, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        sents = [" ".join(r.choice(WORDS) for _ in range(r.randrange(4, 20))) + "." for _ in range(r.randrange(2, 12))]
        if bad:
            k = r.randrange(len(sents))
            sents[k] = sents[k].replace(" ", f" {r.choice(['grobian', 'grobianus', 'Villain,'])} ", 1)
        docs.append((i, " ".join(sents), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_offending_sentences(spark):
    docs, labels = labelled()
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {a: c for a, _, c in labels}
    got = toxicity_report(df, lab).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.97
    spans = toxicity(df, train(df, lab), spans="bad").where("score >= 0.5").collect()
    hit = sum(any(w in r.text[b.start : b.end].lower() for b in r.bad for w in ("grobian", "villain")) for r in spans)
    assert hit / len(spans) > 0.95


def test_labels_held_out_do_not_matter(spark):
    docs, labels = labelled(200)
    df = frame(spark, docs)
    flipped = [(a, b, 1 - c if zlib.crc32(str(a).encode()) % 5 == 0 else c) for a, b, c in labels]
    a, b = (train(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a, b)


def test_odd_rows_and_no_labels(spark):
    df = frame(spark, extra=("score", "offending"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity_report(df, none).collect()
    assert len(got) == len(odd_documents()) and all(r.score == 0 or r.score < 1e-6 for r in got)
    assert toxicity_report(frame(spark, []), none).count() == 0
    assert frame(spark).where("doc_id is null").select(held_out().alias("h")).first().h is False
    odd = spark.createDataFrame([(7, None, None), (None, 1, 1), (3001, 0, 1), (14, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity_report(df, odd).count() == len(got)


def test_noisy_or_of_sentences():
    w = fit(["foul word. fine", "fine fine. all fine", "foul again", "all well here"] * 5, np.array([1, 0, 1, 0] * 5))
    score, p = Scorer(w).score("fine. foul. foul")
    assert abs(score - (1 - np.prod(1 - p))) < 1e-9 and p[1] > 0.5 > p[0] and Scorer(w).score("")[0] == 0


def naive_ascent(docs, y, share, steps, n_features):
    """ascend() with loops: docs are lists of sentences, those lists of features."""
    from pulseloom.llm import toxicity as t

    w, b = [0.0] * n_features, t.BIAS
    m1, m2 = [0.0] * (n_features + 1), [0.0] * (n_features + 1)
    for step in range(1, steps + 1):
        grad = [-t.LASSO] * n_features + [0.0]
        for doc, label, part in zip(docs, y, share, strict=True):
            p = [1 / (1 + math.exp(-(b + sum(w[f] for f in s)))) for s in doc]
            score = 1 - math.prod(1 - x for x in p)
            for s, x in zip(doc, p, strict=True):
                g = (label - score) / score * part * x
                for f in s:
                    grad[f] += g
                grad[-1] += g
        for i, g in enumerate(grad):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            move = t.RATE * (m1[i] / (1 - 0.9**step)) / (math.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
            if i < n_features:
                w[i] = max(w[i] + move, 0.0)
            else:
                b += move
    return w, b


def test_fit_against_loops(monkeypatch):
    from pulseloom.llm import toxicity as t

    monkeypatch.setattr(t, "STEPS", 12)
    r = random.Random(3)
    docs = [[[r.randrange(6) for _ in range(r.randrange(0, 5))] for _ in range(r.randrange(1, 4))] for _ in range(20)]
    y = [int(any(0 in s for s in d)) for d in docs]
    share = [0.5 / (sum(y) if label else 20 - sum(y)) for label in y]
    x, sent_of, doc_of = [], [], []
    for d, doc in enumerate(docs):
        for s in doc:
            x += s
            sent_of += [len(doc_of)] * len(s)
            doc_of.append(d)
    w, b = t.ascend(np.array(x), np.array(sent_of), np.array(doc_of), np.array(y, float), np.array(share), 6)
    want_w, want_b = naive_ascent(docs, y, share, 12, 6)
    assert np.allclose(w, want_w, atol=1e-6) and abs(b - want_b) < 1e-6


def test_report_against_loops(spark):
    docs, labels = labelled(150)
    rows = odd_documents() + [(a + 50000, *x) for a, *x in docs]
    lab = spark.createDataFrame([(a + 50000, b, c) for a, b, c in labels], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    from pulseloom.llm.toxicity import features

    weights = train(df, lab)
    want = []
    for d, text, *_ in rows:
        quiet, offending = 1.0, 0
        for sentence in re.split(r"[.!?\n]", text or ""):
            if sentence.split():
                z = float(weights[-1]) + sum(float(weights[f]) for w in sentence.split() for f in features(w))
                p = 1 / (1 + math.exp(-min(max(z, -30), 30)))
                quiet *= 1 - p
                offending += p >= 0.5
        want.append((d, d is not None and zlib.crc32(str(d).encode()) % 5 == 0, round(1 - quiet, 6), int(1 - quiet >= 0.5), offending))
    got = [(r.doc_id, r.held_out, round(r.score, 6), r.predicted, r.n_offending) for r in toxicity_report(df, lab).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and 0 < sum(x[3] for x in got) < len(got)
