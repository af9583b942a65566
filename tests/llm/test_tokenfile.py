import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulseloom.llm.tokenfile import PieceEncoder, Segment, token_digest, write_segment

from .fixtures import frame, odd_documents

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=6), st.sampled_from([0.5, 0.9, 1.0]))
def test_segments_round_trip(docs, percentile):
    ids = np.array([x for d in docs for x in d], "<u4")
    s = Segment(write_segment(list(range(len(docs))), np.array([len(d) for d in docs], int), ids, percentile))
    assert s.ids().tolist() == ids.tolist() and s.per_doc.tolist() == [len(d) for d in docs]
    if len(ids) > 3:
        a, z = len(ids) // 3, 2 * len(ids) // 3
        assert s.ids(a, z).tolist() == ids[a:z].tolist()


def test_blocks_are_smaller_than_their_outliers():
    ids = np.random.default_rng(0).integers(0, 1000, 100_000).astype("<u4")
    ids[::1000] = 2**31
    assert len(write_segment([1], np.array([len(ids)]), ids)) < 100_000 * 1.5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab AB'st19  \n\t\x1c\x85 \u3000.,!é한😀\x00", "<|endoftext|>"]), max_size=40).map("".join), max_size=5))
def test_pieces_equal_the_library(texts):
    e = encoder()
    assert e.encode(texts) == e.library(texts)


_encoder = []


def encoder():
    if not _encoder:
        _encoder.append(PieceEncoder(PATH))
    return _encoder[0]


def test_query_on_odd_rows(spark):
    t = Tokenizer.from_file(PATH)
    rows = sorted(odd_documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_digest(frame(spark, extra=("part", "image")), PATH).collect()), key=lambda x: x[1])
    assert got == want


def test_empty_table(spark):
    assert token_digest(frame(spark, []), PATH).count() == 0


def test_not_a_segment():
    with pytest.raises(ValueError):
        Segment(b"XXXX" + bytes(48))
