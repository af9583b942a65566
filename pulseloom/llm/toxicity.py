"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over hashed features of its words
(the word and its first 3 to 6 letters); a document's score is the noisy-or of its sentences'. The
weights are fitted to document labels alone, by gradient ascent on the documents' likelihood in one task
over a bounded sample (SAMPLE documents of each label); scoring covers every whole text where it lies. A
sentence's own score then locates the offending ones. Weights are kept from falling below 0, with a small
price on each: a word can speak for toxicity, and no number of harmless words beside it speaks against.

Defined results: null, empty and blank texts score the bias of an empty bag, 0; a null doc_id is not held
out; without labels of both kinds every score is 0; repeated rows score alike; other columns pass
through toxicity(). Labels, lang, source and doc_id are never features.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, keep_only, named, pieces, unfolded

#: Hashed features, and how many a word has at most.
FEATURES, PER_WORD = 1 << 18, 5
#: Documents of each label that the fit takes, the first by a hash of doc_id.
SAMPLE = 2500
STEPS, RATE, LASSO = 100, 0.2, 2e-5
#: A feature must stand in so many sampled documents, and in so many times as large a share of the toxic ones.
LEAST_DOCS, LEAST_LIFT = 4, 3.0
#: Features below this weight after the first fit are left out of the second: many small ones add up in long sentences.
LEAST_WEIGHT = 1.0
BIAS = -6.0
#: Words that a worker keeps with their summed weights.
CACHED_WORDS = 250_000
SENTENCE = re.compile(r"[^.!?\n]+")
_trim = ".,;:!?\"'()[]{}<>*_-"


def features(word: str) -> list[int]:
    """The hashed features of a word: itself and its first letters."""
    w = word.lower().strip(_trim)
    if not w:
        return []
    found = [f"={w}"] + [w[:k] for k in range(3, 7) if len(w) >= k]
    return [zlib.crc32(f.encode()) & (FEATURES - 1) for f in found]


def sentences(text: str) -> list[str]:
    return SENTENCE.findall(text)


def fit(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights, the bias last, that make the noisy-or of sentence scores likely under the labels."""
    weights = np.zeros(FEATURES + 1)
    weights[-1] = BIAS
    if not len(labels) or labels.min() == labels.max():
        weights[-1] = -30.0
        return weights
    y = labels.astype(float)
    # words as numbers, with each one's features; then which words stand in which sentence of which document
    number: dict[str, int] = {}
    of_word, words, sent_of, doc_of = array("i"), array("i"), array("i"), array("i")
    seen = np.zeros((2, FEATURES), np.int32)  # documents of each label that have a feature
    for t, label in zip(texts, labels.tolist(), strict=True):
        here = set(t.split())
        for w in here.difference(number):
            number[w] = len(number)
            own = features(w)
            of_word.extend(own + [-1] * (PER_WORD - len(own)))
        has: set[int] = set()
        for w in here:
            has.update(of_word[number[w] * PER_WORD : (number[w] + 1) * PER_WORD])
        seen[int(label), [x for x in has if x >= 0]] += 1
    for d, t in enumerate(texts):
        for s in sentences(t):
            if found := s.split():
                words.extend([number.get(w, -1) for w in found])
                sent_of.extend([len(doc_of)] * len(found))
                doc_of.append(d)
    number.clear()
    # weights start at 0 and never fall below it, so what speaks for nothing can be left out at once
    share_of = (seen + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1)
    useful = np.append((seen.sum(axis=0) >= LEAST_DOCS) & (share_of[1] >= LEAST_LIFT * share_of[0]), False)  # the last for -1
    of_word = np.append(np.frombuffer(of_word, np.int32), [-1] * PER_WORD).astype(np.int32).reshape(-1, PER_WORD)  # the last for words of no text as a whole
    words, sent_of, doc_of = np.frombuffer(words, np.int32), np.frombuffer(sent_of, np.int32), np.array(doc_of, np.int64)
    some = useful[of_word].any(axis=1)[words]  # few words have a useful feature
    words, sent_of = words[some], sent_of[some]
    x = of_word[words]
    keep = useful[x]
    x, sent_of = x[keep].astype(np.int64), np.repeat(sent_of.astype(np.int64), keep.sum(axis=1))
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(2):
        used, x = np.unique(x, return_inverse=True)
        w, b = ascend(x, sent_of, doc_of, y, share, len(used))
        strong = w >= LEAST_WEIGHT
        weights[:-1] = 0
        weights[used], weights[-1] = w, b
        keep = strong[x]
        x, sent_of = used[x[keep]], sent_of[keep]
    return weights


def ascend(x: np.ndarray, sent_of: np.ndarray, doc_of: np.ndarray, y: np.ndarray, share: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the documents' weighted log-likelihood; weights stay at 0 or above."""
    n = len(doc_of)
    w, b = np.zeros(features), BIAS
    m1, m2 = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sent_of, w[x], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))  # log of 1 - score
        score = np.clip(1 - np.exp(quiet), 1e-9, 1 - 1e-9)
        # d log-likelihood / d z: (y - score) / score * p, sentence by sentence
        g = ((y - score) / score * share)[doc_of] * p
        grad = np.append(np.bincount(x, g[sent_of], minlength=features) - LASSO, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w = np.maximum(w + move[:-1], 0)
        b += move[-1]
    return w, b


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted to the labels that are not held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # only labels with a document count against the bound
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("__order", F.xxhash64("doc_id", "toxic"))
    picked = known.where("toxic = 1").orderBy("__order").limit(sample).unionByName(known.where("toxic = 0").orderBy("__order").limit(sample))
    bags = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["text", "toxic"], kind="stable")  # the sum's order, so that reruns agree
        return pd.DataFrame({"weights": [fit(pdf.text.tolist(), pdf.toxic.to_numpy()).astype("<f4").tobytes()]})

    got = bags.groupBy(F.lit(0).alias("__one")).applyInPandas(one, "weights binary").collect()  # one row of 1 MB
    return np.frombuffer(bytes(got[0].weights), "<f4") if got else fit([], np.zeros(0)).astype("f4")


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights, self.bias = weights[:-1], float(weights[-1])
        self.known: dict[str, float] = {}

    def sentence_logits(self, found: list[str]) -> np.ndarray:
        known, weights = self.known, self.weights
        if len(known) > CACHED_WORDS:
            known.clear()
        out = []
        for s in found:
            words = s.split()
            got = list(map(known.get, words))
            if None in got:
                for w in words:
                    if w not in known:
                        known[w] = float(weights[features(w)].sum())
                got = list(map(known.get, words))
            out.append(sum(got) if words else -np.inf)
        return np.array(out, float)

    def score(self, text: str) -> tuple[float, np.ndarray]:
        """The document's score, and those of its sentences."""
        z = self.sentence_logits(sentences(text)) + self.bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p[np.isneginf(z)] = 0
        return float(0.0 - np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), p


def toxicity(docs: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score", spans: str | None = None, drop_text: bool = False) -> DataFrame:
    """docs with the score of each document and, if named, its offending sentences as (start, end, score)."""
    made = [c for c in (score, spans) if c]
    through = [c for c in docs.columns if c not in made and not (drop_text and c == text)]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    given = docs.select(carried(through), named(text).alias("text"))
    schema = T.StructType([given.schema["row"], T.StructField("score", T.DoubleType(), False)] + [T.StructField("spans", span)] * bool(spans))
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # FEATURES + 1 numbers, whatever the input
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        keep_only("toxicity")
        for whole in batches:
            for batch in pieces(whole):
                row, texts = batch.columns
                scores, located = [], []
                for t in texts.to_pylist():
                    s, p = scorer.score(t or "")
                    scores.append(s)
                    if spans:
                        hot = set(np.flatnonzero(p >= 0.5).tolist())
                        located.append([{"start": m.start(), "end": m.end(), "score": float(p[k])} for k, m in enumerate(SENTENCE.finditer(t or "")) if k in hot] if hot else [])
                cols = [row, pa.array(scores, pa.float64())] + [pa.array(located, kind)] * bool(spans)
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    own = [named(c).alias(name) for c, name in zip(schema.names[1:], made, strict=True)]
    return given.mapInArrow(run, schema).select(*unfolded(through), *own)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of offending sentences of each document."""
    scored = toxicity(docs.select("doc_id", "text"), train(docs, labels), spans="offending", drop_text=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
