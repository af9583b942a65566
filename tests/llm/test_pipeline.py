"""The pipeline on small tables: each stage against brute force on its own input."""

import hashlib
import os

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipe
from pulseloom.llm import mixing, toxicity

from . import test_lines, test_mixing, test_simhash
from .fixtures import SCHEMA, odd_documents
from .test_toxicity import labelled


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels = labelled(250)
    docs = [(a + 20000, *x) for a, *x in docs]
    rows = [r for r in odd_documents() if r[0] != 3004] + docs
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(a + 20000, b, c) for a, b, c in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows(df):
    return [tuple(r) for r in df.select(*pipe.COLUMNS).collect()]


def test_stages_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = rows(docs)
    scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    after = {}
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, sf)
        path = os.path.join(sf, "after-" + name)
        out.write.parquet(path)
        docs = after[name] = spark.read.parquet(path)
    clean = sorted(rows(after["toxicity"]), key=repr)
    assert clean == sorted([r for r in given if scorer.score(r[1] or "")[0] < 0.5], key=repr)
    assert 0 < len(given) - len(clean) < 80
    lined = rows(after["line_dedup"])
    assert sorted([(r[0], r[1]) for r in lined], key=repr) == sorted(test_lines.brute(clean), key=repr)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in lined)
    label = test_simhash.brute(lined)
    kept = rows(after["simhash"])
    assert sorted(r[0] for r in kept if r[0] is not None) == sorted(set(label.values()))
    mixed = rows(after["mixing"])
    taken = {r.doc_id: r.taken for r in mixing.mix_report(after["simhash"]).collect() if r.doc_id is not None}
    words = {}
    for r in mixed:
        words[r[0]] = words.get(r[0], 0) + test_mixing.size(r[1])
    assert {k: v for k, v in words.items() if v and k is not None} == {k: v for k, v in taken.items() if v}
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in mixed:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, after["bpe"].collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, pipe.run(spark, sf).collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipe.run(spark, str(tmp_path)).count() == 0
