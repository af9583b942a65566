import hashlib
import random

import numpy as np
import pytest

from pulseloom.llm import substrings as sub
from pulseloom.llm import suffixes
from pulseloom.llm.substrings import LENGTH, anchors, repeat_report
from pulseloom.llm.suffixes import common_prefixes, suffix_array

from .fixtures import frame, key, odd_documents


def test_suffix_arrays_and_prefixes_against_sorting(monkeypatch):
    r = random.Random(0)
    for waves in (512, 0.2, 0):  # buckets always, by the number of names, suffixes always
        monkeypatch.setattr(suffixes, "WAVES", waves)
        for _ in range(150):
            k = r.choice([1, 2, 3, 10, 200])
            s = [r.randrange(1, k + 1) for _ in range(r.randrange(1, 60))] + [0]
            want = sorted(range(len(s)), key=lambda i: s[i:])
            sa = suffix_array(np.array(s, np.uint16))
            assert sa.tolist() == want
            p = common_prefixes(np.array(s, np.uint16), sa)
            for a, b in zip(want, want[1:], strict=False):
                m = next((m for m in range(len(s)) if a + m >= len(s) or b + m >= len(s) or s[a + m] != s[b + m]))
                assert p[b] == m


def brute(rows):
    owner = {}
    for r in rows:
        if r[0] is not None:
            b = (r[1] or "").encode()
            for j in range(len(b) - LENGTH + 1):
                w = b[j : j + LENGTH]
                owner[w] = min(owner.get(w, r[0]), r[0])
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        if r[0] is not None:
            for j in range(len(b) - LENGTH + 1):
                if owner[b[j : j + LENGTH]] < r[0]:
                    gone[j : j + LENGTH] = True
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = odd_documents()
    base = "".join(r.choice("ab") for _ in range(400))
    rows += [(7000 + i, base[r.randrange(200) :][: r.randrange(45, 160)] + "z" * i, "", "", 1) for i in range(30)]
    rows += [(8000 + i, "ß" * r.randrange(20, 60), "", "", 1) for i in range(5)] + [(1, "x" * LENGTH, "", "", 1), (2, "x" * LENGTH, "", "", 1), (2, "y" + "x" * LENGTH, "", "", 1)]
    got = [tuple(x) for x in repeat_report(frame(spark, rows, extra=("chunk", "blob"))).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_every_window_has_an_anchor():
    x = np.random.default_rng(0).integers(97, 99, 5000).astype(np.uint8)
    h, first, last = anchors(x, np.array([1200, 1210, 5000]))
    seen = np.zeros(5000, int)
    for a, z in zip(first, last, strict=True):
        seen[a : z + 1] += 1
    want = np.zeros(5000, int)
    want[: 1200 - LENGTH + 1] = want[1210 : 5000 - LENGTH + 1] = 1
    assert (seen == want).all()


def test_empty_table(spark):
    assert repeat_report(frame(spark, [])).count() == 0


def test_names_of_real_text_are_sorted_by_induction(monkeypatch):
    """Every level of the recursion is an induction, over many names as well."""
    seen = []
    inner = suffixes.induce
    monkeypatch.setattr(suffixes, "induce", lambda s, small, lms, names: seen.append((len(s), names)) or inner(s, small, lms, names))
    text = "\n".join(r[1] for r in odd_documents(n=200) if r[1]).encode()[:120_000]
    s = np.append(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, np.uint16(0))
    sa = suffix_array(s)
    assert len({n for n, _ in seen}) > 2 and max(names for n, names in seen[1:-1]) > 1000
    for a, b in zip(sa[1:].tolist(), sa[2:].tolist(), strict=False):
        assert text[a : a + 400] <= text[b : b + 400]


def by_hand(rows, chunks):
    """remove_repeats() without Spark, in one process: what each row keeps, and the fragments that were sent."""
    held = [[r for k, r in enumerate(rows) if k % chunks == i] for i in range(chunks)]
    made = lambda rs: sub.Chunk([r[0] for r in rs], [r[1] for r in rs])
    sent = [sub.sent_hashes(made(rs)) for rs in held]
    told = sub.shared_hashes([sub.squeezed(np.diff(h, prepend=np.uint64(0)), w) for h, w in sent])
    blobs, hots = [], []
    for rs, b in zip(held, told, strict=True):
        c = made(rs)
        known, hot = sub.read_shared([b]) if b else (np.zeros(0, np.uint64),) * 2
        records, start, end = sub.fragments(c, known, hot)
        blobs.append(sub.ANSWERED + sub.sent_fragments(records, sub.gathered(c.text, start, end)))
        hots.append(hot)
    out = {}
    for rs, answer, hot in zip(held, sub.solve_shard(list(range(chunks)), blobs), hots, strict=True):
        c = made(rs)
        gone = sub.removed(c, sub.read_answers([answer[1:]] if answer else []), hot)
        for r, e, n in zip(rs, c.ends.tolist(), c.sizes.tolist(), strict=True):
            out[r[0]] = c.text[e - n : e][~gone[e - n : e]].tobytes()
    return out, [len(sub.read_fragments(b[1:])[0]) for b in blobs]


def test_hot_anchors_and_periodic_text(monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    lead = "a phrase that stands in many documents "
    rows = [(i, " ".join(word() for _ in range(12)) + lead + " ".join(word() for _ in range(12)), "", "", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:140], "", "", 1) for i in range(0, 60, 5)]
    rows += [(200, "ab" * 9000, "", "", 1), (201, "ab" * 7000 + "x" + "abc" * 3000, "", "", 1), (202, "abc" * 1000, "", "", 1)]
    want = {x[0]: x[4] for x in brute(rows)}
    for hot in (1 << 14, 3):
        monkeypatch.setattr(sub, "HOT_FRAGMENTS", hot)
        monkeypatch.setattr(sub, "FEW", 2)
        got, sent = by_hand(rows, 3)
        assert {k: hashlib.sha256(v).hexdigest() for k, v in got.items()} == want
    assert len(sub.Chunk([1], ["ab" * 500_000]).hash) < 1000


def test_folding_different_fragments_stops():
    text = np.frombuffer(b"abcdefabcxef", np.uint8)
    sub.check_equal(text, np.array([6]), np.array([9]), np.array([0]), np.array([3]))
    with pytest.raises(RuntimeError):
        sub.check_equal(text, np.array([6]), np.array([12]), np.array([0]), np.array([6]))


def test_suffixes_at_some_places_and_their_prefixes(monkeypatch):
    r = random.Random(4)
    for waves in (512, 0):
        monkeypatch.setattr(suffixes, "WAVES", waves)
        for _ in range(150):
            s = [c for _ in range(r.randrange(1, 12)) for c in [r.randrange(1, 4)] * r.choice([1, 1, 2, 30])] * r.choice([1, 3]) + [0]
            places = sorted(r.sample(range(len(s)), r.randrange(1, len(s) + 1)))
            want = sorted(places, key=lambda i: s[i:])
            sa = suffix_array(np.array(s, np.uint16), np.array(places))
            assert sa.tolist() == want
            p = common_prefixes(np.array(s, np.uint16), sa)
            for a, b in zip(want, want[1:], strict=False):
                assert p[b] == next(m for m in range(len(s)) if s[a + m] != s[b + m])


def test_a_shard_places_its_windows_alone(monkeypatch):
    """A window takes some three other suffixes of its fragment along, which only serve to sort it."""
    placed, inner = [], suffixes.induce
    monkeypatch.setattr(suffixes, "induce", lambda *given: placed.append(inner(*given)) or placed[-1])
    r = random.Random(6)
    text = np.array([r.randrange(97, 101) for _ in range(3000)], np.uint8)
    start = np.arange(0, 2900, 29)
    runs, _ = sub.least_owners(text, start, start + 65, np.arange(len(start)))
    assert len(placed[-1]) == 16 * len(start) == runs[:, 2].sum()
