"""Operator 13 against a plain loop over whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from pulseloom.llm import alignment
from pulseloom.llm.bpe import byte_symbols

from .fixtures import frame, key, odd_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "it's  two   spaces", " leading", "trailing ", "  ", "\n", "\n\nx\n y\n", "a\nb c\n's d.\nNext\tword", "tab\t x", "x y  z", "　 a",
    "under▁score", "a ▁ b", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00 \x1c \x1d a", "12 345 6,7", "'s 't 're I'll", "ﬁ ½ é é", "한국어 텍스트", "x" * 300, "😀😀 👩‍👩‍👧",
    " \n a", "a \nb", "a\r\nb\r\n", "if (x) {\r\n}\r\n", "a\x85b  c", "word.\n\nNext", "mixed\n \n", "same text here", "same text here", "end\n",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(libraries, rows):
    """The contract's columns by the libraries over whole texts."""
    a, b = libraries
    byte_of = {c: i for i, c in enumerate(byte_symbols())}
    name = {i: t for t, i in a.get_vocab().items()}

    def a_bytes(i):
        return bytes(byte_of[c] for c in name[i]) if i != 50256 else name[i].encode()

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for doc, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(map(a_bytes, ids_a)) != raw or b"".join(map(b_bytes, ids_b)) != raw:
            ids_a = ids_b = []
        ends = {}
        for which, ids, size in ((0, ids_a, a_bytes), (1, ids_b, b_bytes)):
            at = 0
            for n, i in enumerate(ids):
                at += len(size(i))
                ends.setdefault(at, [None, None])[which] = n
        groups, links, x, y = [], [], 0, 0
        for at in sorted(ends):
            i, j = ends[at]
            if i is not None and j is not None:
                groups.append(",".join(map(str, ids_a[x : i + 1])) + "|" + ",".join(map(str, ids_b[y : j + 1])))
                links.append((ids_a[i], ids_b[j]))
                x, y = i + 1, j + 1
        found.append((doc, len(ids_a), len(ids_b), ";".join(groups), links))
    counts = Counter(p for *_, links in found for p in links)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted(
        ((d, na, nb, len(links), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if links else "") for d, na, nb, g, links in found),
        key=key,
    )


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=key)


@pytest.fixture(scope="module")
def documents():
    return odd_documents() + [(9000 + i, t, "en", "s0", 1) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_report_equals_brute_force(spark, libraries, documents, frequent):
    docs = frame(spark, documents, ("links", "row", "n_A", "a.b", "x`y"))
    assert rows_of(alignment.alignment_report(docs, A, B, frequent)) == brute(libraries, [r[:2] for r in documents])


def test_blocks_of_long_texts_and_groups(spark, libraries, documents):
    texts = [(1, " ".join(t for _, t, *_ in documents[:40] if t)), (2, "\n".join(ODD)), (3, "  ".join(ODD)), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align_tokens(docs, A, B, block=50).collect()}
    want = {r[0]: r for r in brute(libraries, texts)}
    for d, r in got.items():
        assert (r.n_a, r.n_b, len(r.links)) == want[d][1:4]
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == want[d][-1]


def test_cache_starts_anew(libraries, documents, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_UNITS", 5)
    monkeypatch.setattr(alignment, "LONGEST_KEPT", 3)
    aligner = alignment.Aligner(A, B)
    want = brute(libraries, [(i, t) for i, t in enumerate(ODD)])
    for i, t in enumerate(ODD + ODD):
        g = b"".join(x[0] for x in next(aligner.texts([t])))[:-1]
        assert (hashlib.sha256(g).hexdigest() if g else "") == want[i % len(ODD)][-1]
        assert len(aligner.known) <= 5 and not aligner.long


def test_counts_gathered_in_portions(spark, libraries, documents):
    aligned = alignment.align_tokens(frame(spark, documents), A, B).cache()
    want = Counter(c for r in aligned.collect() for c in r.links)
    got = {r.code: (r.n, r.best) for r in alignment.pair_counts(aligned, most=3).collect()}
    assert {c: n for c, (n, _) in got.items()} == want
    for c, (n, best) in got.items():
        assert best == (n == max(m for d, m in want.items() if d & alignment.LOW == c & alignment.LOW))


def test_empty_table(spark):
    assert alignment.alignment_report(frame(spark, []), A, B).collect() == []
