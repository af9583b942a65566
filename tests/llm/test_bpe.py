import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pulseloom.llm.bpe import PairIndexBpe, bpe_digest, bpe_encode

from .fixtures import frame, key, odd_documents

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text_equal_the_library(library):
    bpe, r = PairIndexBpe(PATH), random.Random(4)
    parts = [*"aabbAB  'sStTrRe19²½ⅫǅΣσςİıé́ͅ한😀\n\t\x0b\x1c\x85  _-!?.,<|>", "<|endoftext|>", "<|startoftext|>", "'ll", "aaaa", "!!!!!!", "hahaha", "Å", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(1500)] + ["", "a" * 999, "!" * 999]
    for text, mine, theirs in zip(texts, bpe.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(mine, "<i4")
        assert ids.tolist() == theirs.ids, repr(text)
        assert bpe.decode(ids) == library.decode(theirs.ids, skip_special_tokens=False)


def test_query_on_odd_rows(spark, library):
    def want(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    got = [tuple(r) for r in bpe_digest(frame(spark), PATH).collect()]
    assert sorted(got, key=key) == sorted([want(r[0], r[1]) for r in odd_documents()], key=key)


def test_extra_columns_and_empty_tables(spark):
    out = bpe_encode(frame(spark, extra=("ids", "decoded", "__text")), PATH, decoded="decoded")
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "decoded", "__text"}
    assert out.where("__text = 'own __text' and size(ids) > 0").count() > 50
    assert bpe_digest(frame(spark, []), PATH).count() == 0
