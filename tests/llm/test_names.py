"""Extra columns of any name go through the general interfaces untouched."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import bpe, lines, mixing, simhash, tokenfile, toxicity
from pulseloom.llm.common import named

from .fixtures import frame, key, odd_documents

ODD = ("__Key", "__GONE", "__text", "__FINGERPRINT", "row", "c0", "gone", "a.b", "x`y", "doc_key", "Line", "K1", "same_source", "u")
WEIGHTS = np.zeros(toxicity.FEATURES + 1, np.float32)

INTERFACES = {
    "bpe_encode": lambda d: bpe.bpe_encode(d, public_tokenizers.path("word_bpe_49k.json"), ids="my.ids", decoded="my`text"),
    "toxicity": lambda d: toxicity.toxicity(d, WEIGHTS, score="the.score", spans="the`spans"),
    "fingerprints": lambda d: simhash.fingerprints(d, column="f.p"),
    "keep_one": simhash.keep_one,
    "dedup_lines": lambda d: lines.dedup_lines(d, "n.gone"),
    "copies": mixing.copies,
    "mix": mixing.mix,
}


@pytest.mark.parametrize("name", INTERFACES)
def test_columns_of_any_name_go_through(spark, name):
    docs = frame(spark, odd_documents()[:40], ODD)
    out = INTERFACES[name](docs)
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    plain = INTERFACES[name](frame(spark, odd_documents()[:40]))
    rows = out.select("doc_id", "text", *[named(c).alias(f"e{i}") for i, c in enumerate(ODD)]).collect()
    assert sorted((r[:2] for r in rows), key=key) == sorted(map(tuple, plain.select("doc_id", "text").collect()), key=key)
    assert rows and all(r[2:] == tuple(f"own {c}" for c in ODD) for r in rows)


def test_token_files_leave_them_out(spark, tmp_path):
    docs = frame(spark, odd_documents()[:10], ODD).withColumn("part", F.lit("own"))
    tokenfile.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t"), 2)
    assert tokenfile.read_tokens(spark, str(tmp_path / "t")).count() == 10
