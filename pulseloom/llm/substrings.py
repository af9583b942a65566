"""Operator 1: exact substring dedup by suffix arrays in shards.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.
Every LENGTH-byte window has an anchor, the least-hashed ANCHOR-byte string in it, so equal windows have
equal anchors and meet in the shard of the anchor's hash:

1. documents are dealt to chunks; a chunk sends the hashes of its anchors to their shards, packed, with
   the number of different texts around each;
2. a shard tells each chunk which of them other documents have too, and which stand amid so many different
   texts (HOT_FRAGMENTS) that one shard should not have them all;
3. the chunk sends the text around those, the neighbouring windows of an anchor as one fragment, equal
   fragments once with their least doc_id; windows of the hot anchors go one by one, each to the shard of
   its own hash;
4. a shard sorts the suffixes of all its fragments by induction, in its last step only those that begin a
   window, and common prefixes of LENGTH or more give the groups of equal windows and the least doc_id of
   each; runs of windows are sent back;
5. the chunk removes the bytes that they cover.

All steps are one plan, in which the texts are dealt once and that exchange is used again. A passage in a
third of all documents reaches its shard once a chunk, not once a document. Fragments are folded by 128
bits of hash, and the bytes of those folded are compared: should two differ, the job stops with an error.

Defined results: a null text is empty; a document without a doc_id loses nothing and takes nothing from
others; rows that repeat a doc_id take nothing from each other; matches never cross documents; extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, text_or_empty
from .suffixes import common_prefixes, suffix_array

LENGTH, ANCHOR = 50, 20
#: Places of the text that are looked at together; a place fits in the low bits of a hash.
STEP_BITS = 20
#: Bytes of fragments whose suffixes are sorted together, about; fragments of one hash are never parted.
SHARD_BYTES = 1 << 19
#: Chunks and shards for each partition; a chunk sends a row to each shard. A partition has about so many bytes at most.
CHUNKS, SHARDS = 2, 1
PARTITION_BYTES = 64 << 20
#: Windows of a fragment at most: periodic text would make endless ones.
FRAGMENT_WINDOWS = 2048
#: Different texts around one anchor, beyond which its windows are dealt to all shards. Fewer than FEW of them in a chunk
#: are counted with repeats.
HOT_FRAGMENTS, FEW = 1 << 14, 16
#: Low bits of an anchor's hash that do not travel; what they would tell apart is told apart by the text.
LOOSE_BITS = 12
POWER = np.uint64(0x9E3779B97F4A7C15)


def anchors(x: np.ndarray, doc_end: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of each anchor of a text of documents: its windows start at first to last.

    doc_end: for each document the place behind it, in order; no window crosses one.
    """
    width, out = length - k + 1, []
    inside = np.ones(len(x), bool)  # places where a window of a document starts
    first = 0
    for end in doc_end.tolist():
        inside[max(first, end - length + 1) : end] = False
        first = end
    step = (1 << STEP_BITS) - length
    for base in range(0, len(x) - length + 1, step):
        part = np.ascontiguousarray(x[base : base + step + length - 1])
        if len(part) < length:
            break
        words = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,)).copy()
        with np.errstate(over="ignore"):
            h = words[: len(part) - k + 1] * np.uint64(0xD6E8FEB86659FD93)
            for o in sorted({*range(8, k - 7, 8), k - 8}):  # eight bytes at a time, the last eight as they come
                h ^= h >> np.uint64(32)
                h = (h ^ words[o : o + len(h)]) * POWER
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        mask = np.uint64((1 << STEP_BITS) - 1)
        low = h & ~mask | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & mask).astype(np.int32)  # the anchor of each window
        ok = inside[base : base + len(at)]
        # neighbouring windows whose anchors are equal, as in periodic text, are one fragment
        other = h[at[1:]] != h[at[:-1]]
        begins = np.flatnonzero(ok & np.append(True, other | ~ok[:-1]))
        ends = np.flatnonzero(ok & np.append(other | ~ok[1:], True))
        begins, ends = split_runs(begins, ends)
        own = h[at[begins]]
        with np.errstate(over="ignore"):  # least hashes are small ones: mixed again, so that shards are even
            own = (own ^ own >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            own = (own ^ own >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
        out.append((own ^ own >> np.uint64(29), begins + base, ends + base))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def split_runs(begins: np.ndarray, ends: np.ndarray, most: int = FRAGMENT_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Runs of places, in pieces of so many at most."""
    pieces = (ends - begins) // most + 1
    if not len(begins) or pieces.max() == 1:
        return begins, ends
    of = np.repeat(np.arange(len(begins)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = begins[of] + nth * most
    return first, np.minimum(first + most - 1, ends[of])


class Chunk:
    """The texts of a chunk, one behind another, with their anchors."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        data = [(t or "").encode() for t in texts]
        self.ids = ids
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.text = np.frombuffer(b"".join(data), np.uint8)
        self.ends = np.cumsum(self.sizes)
        # documents without an id have no anchors
        self.known = np.array([i is not None for i in ids], bool)
        self.doc_ids = np.array([i if i is not None else 0 for i in ids], np.int64)
        self.hash, self.first, self.last = anchors(self.text, self.ends)
        doc = np.searchsorted(self.ends, self.first, side="right")
        keep = self.known[doc] if len(doc) else np.zeros(0, bool)
        self.hash, self.first, self.last, self.doc = self.hash[keep], self.first[keep], self.last[keep], self.doc_ids[doc[keep]]

    def take(self, at: np.ndarray) -> None:
        self.hash, self.first, self.last, self.doc = self.hash[at], self.first[at], self.last[at], self.doc[at]

    def part_hot(self, hot: np.ndarray) -> None:
        """From now on the windows of the anchors in hot (sorted, without LOOSE_BITS) stand one by one."""
        if not len(hot) or not len(self.hash):
            return
        h = self.hash >> np.uint64(LOOSE_BITS)
        is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        n = np.where(is_hot, self.last - self.first + 1, 1)
        of = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        one = is_hot[of]
        first = self.first[of] + nth
        last = np.where(one, first, self.last[of])
        self.hash, self.first, self.last, self.doc = self.hash[of], first, last, self.doc[of]
        self.hash[one] = content_hashes(self.text, first[one], last[one] + LENGTH, np.zeros(int(one.sum()), np.uint64))

    def contents(self) -> np.ndarray:
        return content_hashes(self.text, self.first, self.last + LENGTH, self.hash | np.uint64(1))


def content_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A hash of each fragment, starts rising, and its anchor's hash, from sums of bytes times powers."""
    out = np.zeros(len(start), np.uint64)
    step, room = 1 << 18, 4096
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(step + room, POWER, np.uint64)])
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(step, pow(int(POWER), -1, 1 << 64), np.uint64)])
        for base in range(0, len(text), step):
            i, j = np.searchsorted(start, [base, base + step])
            if i == j:
                continue
            part = text[base : base + step + room].astype(np.uint64) + np.uint64(1)
            sums = np.r_[np.uint64(0), np.cumsum(part * power[: len(part)])]
            a, z = start[i:j] - base, end[i:j] - base
            h = (sums[z] - sums[a]) * back[a] ^ (z - a).astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) ^ anchor[i:j]
            out[i:j] = h ^ (h >> np.uint64(29))
    return out


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns behind one another, wide ones byte by byte, compressed: they wait in a shuffle."""
    raw = []
    for c in columns:
        c = np.ascontiguousarray(c)
        body = (c.view(np.uint8).reshape(-1, 8).T if c.dtype.itemsize == 8 and len(c) else c).tobytes()
        raw += [len(body).to_bytes(8, "little"), body]
    joined = b"".join(raw)
    return len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)


def opened(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        body = np.frombuffer(raw, np.uint8, n, at + 8)
        if kind.endswith("8"):
            body = np.ascontiguousarray(body.reshape(8, -1).T).ravel()
        out.append(body.view(kind))
        at += 8 + n
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash; it rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The slice of each shard in sorted hashes."""
    of = shard_of(h, shards)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
        yield int(of[a]), slice(a, z)


def sent_hashes(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchor hashes of a chunk, sorted, without their LOOSE_BITS, and for each the number of different texts
    around it, doubled, plus 1 if several of its documents have it."""
    h = c.hash >> np.uint64(LOOSE_BITS)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], c.doc[order]
    if not len(h):
        return h, np.zeros(0, "<u4")
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    number = np.diff(np.r_[starts, len(h)])
    if (number >= FEW).any():
        many = np.repeat(number >= FEW, number)
        at = np.sort(order[many])  # starts rise with the text
        content = content_hashes(c.text, c.first[at], c.last[at] + LENGTH, c.hash[at])
        own = c.hash[at] >> np.uint64(LOOSE_BITS)
        turn = np.lexsort((content, own))
        own, content = own[turn], content[turn]
        new = np.r_[True, (own[1:] != own[:-1]) | (content[1:] != content[:-1])]
        number[number >= FEW] = np.add.reduceat(new.astype(np.int64), np.flatnonzero(np.r_[True, own[1:] != own[:-1]]))
    return h[starts], (2 * number + several).astype("<u4")


def shared_hashes(blobs: list[bytes]) -> list[bytes]:
    """Of each chunk's hashes those that several documents have, and which of them are hot."""
    parts, flags = [], []
    for b in blobs:
        gaps, weight = opened(b, "<u8", "<u4")
        parts.append(np.cumsum(gaps, dtype=np.uint64))
        flags.append(weight)
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    sorted_h, weight = h[order], np.concatenate(flags)[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_h[1:] != sorted_h[:-1]])
    number = np.diff(np.r_[starts, len(sorted_h)])
    several = (number > 1) | (np.add.reduceat(weight & 1, starts) > 0)
    hot = np.add.reduceat(weight >> 1, starts) > HOT_FRAGMENTS
    flag = np.empty(len(h), np.uint8)
    flag[order] = np.repeat(several * (1 + hot), number)
    out, at = [], 0
    for p in parts:
        own = flag[at : at + len(p)]
        got = p[own > 0]
        out.append(squeezed(np.diff(got, prepend=np.uint64(0)), own[own > 0] - np.uint8(1)) if len(got) else b"")
        at += len(p)
    return out


def read_shared(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shared hashes, those of them that are hot), each sorted."""
    got = [opened(b, "<u8", "u1") for b in blobs]
    h, hot = np.concatenate([np.cumsum(g, dtype=np.uint64) for g, _ in got]), np.concatenate([x for _, x in got]) > 0
    return np.sort(h), np.sort(h[hot])


FRAGMENT = np.dtype([("hash", "<u8"), ("content", "<u8"), ("least", "<i8"), ("most", "<i8"), ("size", "<u2")])
ANSWER = np.dtype([("hash", "<u8"), ("content", "<u8"), ("least", "<i8"), ("at", "<u2"), ("count", "<u2")])


def sent_fragments(r: np.ndarray, body: np.ndarray) -> bytes:
    """Fragments for the shuffle; their contents' hashes are made again from the text."""
    return squeezed(np.diff(r["hash"], prepend=np.uint64(0)), r["least"], r["most"] - r["least"], r["size"], body)


def read_fragments(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, least, more, size, body = opened(blob, "<u8", "<i8", "<i8", "<u2", "u1")
    out = np.zeros(len(gaps), FRAGMENT)
    with np.errstate(over="ignore"):
        out["hash"], out["least"], out["most"], out["size"] = np.cumsum(gaps, dtype=np.uint64), least, least + more, size
    end = np.cumsum(size.astype(np.int64))
    out["content"] = content_hashes(body, end - size, end, out["hash"])
    return out, body


def read_answers(blobs: list[bytes]) -> np.ndarray:
    parts = []
    for b in blobs:
        gaps, content, least, at, count = opened(b, "<u8", "<u8", "<i8", "<u2", "<u2")
        x = np.zeros(len(content), ANSWER)
        x["hash"] = np.cumsum(gaps, dtype=np.uint64)
        x["content"], x["least"], x["at"], x["count"] = content, least, at, count
        parts.append(x)
    return np.concatenate(parts) if parts else np.zeros(0, ANSWER)


def check_equal(text: np.ndarray, start: np.ndarray, end: np.ndarray, lead_start: np.ndarray, lead_end: np.ndarray) -> None:
    """Stop if a range of text differs from the one that it was folded into."""
    for i in range(0, len(start), 50_000):
        some = slice(i, i + 50_000)
        if not np.array_equal(end[some] - start[some], lead_end[some] - lead_start[some]) or not np.array_equal(gathered(text, start[some], end[some]), gathered(text, lead_start[some], lead_end[some])):
            raise RuntimeError("two different fragments have one hash of 128 bits")


def fragments(c: Chunk, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records sorted by hash, text starts, text ends) of the distinct fragments whose anchors are shared."""
    h = c.hash >> np.uint64(LOOSE_BITS)
    at = np.minimum(np.searchsorted(shared, h), max(len(shared) - 1, 0))
    c.take(np.flatnonzero(shared[at] == h) if len(shared) else np.zeros(0, np.int64))
    c.part_hot(hot)
    content = c.contents()
    order = np.lexsort((content, c.hash | np.uint64(1)))
    if not len(order):
        return np.zeros(0, FRAGMENT), order, order
    h, content, doc = (c.hash | np.uint64(1))[order], content[order], c.doc[order]
    starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (content[1:] != content[:-1])])
    out = np.zeros(len(starts), FRAGMENT)
    out["hash"], out["content"] = h[starts], content[starts]
    out["least"], out["most"] = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    lead = order[starts]
    again = np.ones(len(order), bool)
    again[starts] = False
    folded, into = order[again], lead[(np.cumsum(~again) - 1)[again]]
    check_equal(c.text, c.first[folded], c.last[folded] + LENGTH, c.first[into], c.last[into] + LENGTH)
    out["size"] = c.last[lead] + LENGTH - c.first[lead]
    return out, c.first[lead], c.last[lead] + LENGTH


def gathered(text: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int = 0) -> np.ndarray:
    """The ranges of text one behind another, each with a gap of zeros behind it."""
    size = end - start + gap
    total = np.cumsum(size)
    at = np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)
    out = text[np.minimum(at, max(len(text) - 1, 0))] if len(text) else np.zeros(0, text.dtype)
    if gap:
        out = out.copy()
        out[total - 1] = 0
    return out


def least_owners(text: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the fragments of text: (fragment, place in it, least owner of any equal window), as runs.

    Returns records (fragment, at, count, least) in two arrays: integers, and owners.
    """
    size = end - start
    s = gathered(text.astype(np.uint16) + np.uint16(2), start, end, 1)
    s[np.cumsum(size + 1) - 1] = 1
    s = np.append(s, np.uint16(0))
    windows = size - LENGTH + 1
    f = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    p = np.arange(len(f), dtype=np.int32) - (np.cumsum(windows) - windows).astype(np.int32)[f]
    w = (np.cumsum(size + 1) - (size + 1)).astype(np.int32)[f] + p
    sa = suffix_array(s, w)
    starts = np.flatnonzero(common_prefixes(s, sa)[sa] < LENGTH)
    owner = np.empty(len(s), np.int64)
    owner[w] = least[f]
    group = np.minimum.reduceat(owner[sa], starts) if len(sa) else owner[:0]
    owner[sa] = np.repeat(group, np.diff(np.append(starts, len(sa))))
    v = owner[w]
    cuts = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (v[1:] != v[:-1]))) if len(f) else np.zeros(0, int)
    count = np.diff(np.append(cuts, len(f)))
    return np.stack([f[cuts], p[cuts], count], axis=1).astype(np.int64) if len(cuts) else np.zeros((0, 3), np.int64), v[cuts]


#: What a blob holds: fragments and the answers to them, or the chunk's hot hashes, which come back as they are.
ANSWERED, HOT = b"A", b"H"


def solve_shard(chunks: list[int], blobs: list[bytes]) -> list[bytes]:
    """The answer to each blob of a shard: runs of windows with an owner smaller than the chunk's largest, or itself."""
    out = list(blobs)
    asked = [i for i, b in enumerate(blobs) if b[:1] != HOT]
    if asked:
        for i, answer in zip(asked, answers_to([blobs[i][1:] for i in asked]), strict=True):
            out[i] = answer
    return out


def answers_to(blobs: list[bytes]) -> list[bytes]:
    records, texts = [], []
    for b in blobs:
        r, body = read_fragments(b)
        records.append(r)
        texts.append(body)
    every, text = np.concatenate(records), np.concatenate(texts)
    of_chunk = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(r) for r in records])
    del records, texts
    size = every["size"].astype(np.int64)
    end = np.cumsum(size)
    order = np.lexsort((every["content"], every["hash"]))
    r = every[order]
    starts = np.flatnonzero(np.r_[True, (r["hash"][1:] != r["hash"][:-1]) | (r["content"][1:] != r["content"][:-1])])
    least = np.minimum.reduceat(r["least"], starts)
    lead = order[starts]
    kind = np.empty(len(every), np.int64)  # of each fragment, its place among the distinct ones
    kind[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
    folded = np.flatnonzero(lead[kind] != np.arange(len(every)))
    into = lead[kind[folded]]
    check_equal(text, (end - size)[folded], end[folded], (end - size)[into], end[into])
    runs, owners, hashes = [], [], r["hash"][starts]
    filled, at = np.cumsum(size[lead]), 0
    while at < len(lead):  # batches of whole hashes
        z = int(np.searchsorted(filled, (filled[at - 1] if at else 0) + SHARD_BYTES)) + 1
        z = int(np.searchsorted(hashes, hashes[min(z, len(lead)) - 1], side="right"))
        got, who = least_owners(text, (end - size)[lead[at:z]], end[lead[at:z]], least[at:z])
        got[:, 0] += at
        runs.append(got)
        owners.append(who)
        at = z
    run, who = np.concatenate(runs), np.concatenate(owners)
    back = np.argsort(run[:, 0], kind="stable")
    run, who = run[back], who[back]
    first = np.searchsorted(run[:, 0], np.arange(len(lead) + 1))
    out = []
    for i in range(len(blobs)):
        mine = np.flatnonzero(of_chunk == i)
        k = kind[mine]
        n = first[k + 1] - first[k]
        at = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        answer = np.zeros(len(at), ANSWER)
        answer["hash"], answer["content"] = np.repeat(every["hash"][mine], n), np.repeat(every["content"][mine], n)
        answer["least"], answer["at"], answer["count"] = who[at], run[at, 1], run[at, 2]
        answer = answer[who[at] < np.repeat(every["most"][mine], n)]
        out.append(ANSWERED + squeezed(np.diff(answer["hash"], prepend=np.uint64(0)), answer["content"], answer["least"], answer["at"], answer["count"]) if len(answer) else b"")
    return out


def removed(c: Chunk, answers: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which bytes of the chunk go."""
    c.part_hot(hot)
    content = c.contents()
    answers = answers[np.argsort(answers["content"], kind="stable")]
    a = np.searchsorted(answers["content"], content, side="left")
    n = np.searchsorted(answers["content"], content, side="right") - a
    which = np.repeat(np.arange(len(content)), n)
    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    hit = (answers["least"][at] < c.doc[which]) & (answers["hash"][at] == (c.hash | np.uint64(1))[which])
    which, at = which[hit], at[hit]
    start = c.first[which] + answers["at"][at]
    edge = np.zeros(len(c.text) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + answers["count"][at].astype(np.int64) + LENGTH - 1, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _by_shard(solve, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, blob) made by solve(chunks, blobs) of each shard; batches are sorted by shard."""
    now, chunks, blobs = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        got = solve(chunks, blobs)
        some = [(c, b) for c, b in zip(chunks, got, strict=True) if len(b)]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], names=["chunk", "blob"])

    for batch in batches:
        for s, c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if s != now and chunks:
                yield from done()
                chunks, blobs = [], []
            now = s
            chunks.append(c)
            blobs.append(b)
    if chunks:
        yield from done()


def _table_chunk(docs: pa.Table) -> Chunk:
    return Chunk(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())


def _blob_rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: the remaining bytes) of each row of docs (doc_id, text)."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    n = max(parallelism(docs.sparkSession), -(-size // PARTITION_BYTES))
    shards = SHARDS * n
    dealt = docs.select("doc_id", text_or_empty().alias("text")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(CHUNKS * n)).cast("int")).repartition(n, "chunk")

    def send(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        h, several = sent_hashes(_table_chunk(group))
        return _blob_rows([(s, chunk, squeezed(np.diff(h[at], prepend=np.uint64(0)), several[at])) for s, at in by_shard(h << np.uint64(LOOSE_BITS), shards)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_shard(lambda chunks, blobs: shared_hashes(blobs), batches)

    def cut_out(group: pa.Table, shared: pa.Table) -> pa.Table:
        if not group.num_rows or not shared.num_rows:
            return _blob_rows([])
        chunk, c = group.column("chunk")[0].as_py(), _table_chunk(group)
        known, hot = read_shared(shared.column("blob").to_pylist())
        records, start, end = fragments(c, known, hot)
        rows = [(chunk % shards, chunk, HOT + squeezed(hot))] if len(hot) else []
        for s, at in by_shard(records["hash"], shards):
            rows.append((s, chunk, ANSWERED + sent_fragments(records[at], gathered(c.text, start[at], end[at]))))
        return _blob_rows(rows)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_shard(solve_shard, batches)

    def finish(group: pa.Table, answered: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        if not group.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        ids = group.column("doc_id").to_pylist()
        if answered.num_rows:
            c = _table_chunk(group)
            blobs = answered.column("blob").to_pylist()
            hot = [opened(b[1:], "<u8")[0] for b in blobs if b[:1] == HOT]
            gone = removed(c, read_answers([b[1:] for b in blobs if b[:1] == ANSWERED]), hot[0] if hot else np.zeros(0, np.uint64))
            text, ends, sizes = c.text, c.ends, c.sizes
        else:
            data = [(t or "").encode() for t in group.column("text").to_pylist()]
            text, sizes = np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64)
            ends, gone = np.cumsum(sizes), np.zeros(int(sizes.sum()), bool)
        rows = []
        for e, size in zip(ends.tolist(), sizes.tolist(), strict=True):
            mask = gone[e - size : e]
            spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(size > 0 and mask[0])
            rows.append((size, int(mask.sum()), spans, text[e - size : e][~mask].tobytes() if spans else text[e - size : e].tobytes()))
        return pa.table([pa.array(ids, pa.int64()), *(pa.array([r[i] for r in rows], kinds[i + 1]) for i in range(4))], names=names)

    blob = "shard int, chunk int, blob binary"
    hashes = dealt.groupBy("chunk").applyInArrow(send, blob)
    shared = hashes.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(find, "chunk int, blob binary")
    found = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(cut_out, blob)
    answers = found.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(sort, "chunk int, blob binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
