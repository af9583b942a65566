"""Suffix arrays by induced sorting, and their permuted common prefixes.

Suffixes are smaller (S) or larger (L) than the one after them. The leftmost-smaller ones (LMS) are
sorted first: their substrings, each up to the next LMS place, are sorted and named, and where names
repeat, the string of names is sorted in its turn by the same method. Induction then places all suffixes
by the LMS suffixes behind them: two that have the same symbols up to their next LMS places stand as those
do. Symbols are packed, so that a sort over whole numpy arrays takes several at once. Where few symbols
stand in long runs, it goes from bucket to bucket (first symbols) instead, a few waves over arrays each.
"""

from __future__ import annotations

import numpy as np

#: Symbols for each symbol up to a next LMS place, up to which induction goes by buckets: those cost some milliseconds each
#: in a shard, and a symbol some ten nanoseconds.
WAVES = 1 / 50_000


def smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix of s is smaller than the next; the last symbol, smallest of all, is."""
    n = len(s)
    up = np.r_[s[:-1] < s[1:], True]
    differs = np.r_[s[:-1] != s[1:], True]
    at = np.where(differs, np.arange(n), n - 1)
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _spread(found: np.ndarray, symbols: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append found, in order, to the buckets of its symbols."""
    n = len(found)
    if not n:
        return
    order = symbols.argsort(kind="stable")
    found, symbols = found[order], symbols[order]
    cuts = (symbols[1:] != symbols[:-1]).nonzero()[0]
    at = 0
    for z, c in zip((cuts + 1).tolist(), symbols[cuts].tolist(), strict=True):
        buckets[c].append(found[at:z])
        at = z
    buckets[int(symbols[-1])].append(found[at:])


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, names: int, places: np.ndarray | None = None) -> np.ndarray:
    """The order of all suffixes of s, or of those at places, from the LMS suffixes in order."""
    gap = np.diff(np.sort(lms).astype(np.int64), prepend=0)
    if names > WAVES * int((gap * (gap + 1) // 2).sum()):
        return by_runs(s, lms, names, np.arange(len(s)) if places is None else places)
    order = by_bucket(s, small, lms, names)
    if places is None:
        return order
    among = np.zeros(len(s), bool)
    among[places] = True
    return order[among[order]]


def next_of(lms: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The next LMS place behind each place; the last symbol has itself."""
    rising = np.sort(lms).astype(np.int64)
    return rising[np.minimum(np.searchsorted(rising, places, side="right"), len(rising) - 1)]


def by_runs(s: np.ndarray, lms: np.ndarray, names: int, places: np.ndarray) -> np.ndarray:
    """The suffixes at places in order, by their symbols up to the next LMS place and by the LMS suffix there.

    What no such place tells apart is the last symbol alone; its suffix is the first.
    """
    end = next_of(lms, places)
    run, _ = named_ranges(s, places.astype(np.int64), end + 1, names)
    rank = np.zeros(len(s), np.int64)
    rank[lms] = np.arange(len(lms))
    return places[np.argsort(run << 32 | rank[end])].astype(lms.dtype)


def by_bucket(s: np.ndarray, small: np.ndarray, lms: np.ndarray, names: int) -> np.ndarray:
    """Induction by whole buckets."""
    large: list[list[np.ndarray]] = [[] for _ in range(names)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(names)]
    _spread(lms, s[lms], seeds)
    none = np.zeros(0, lms.dtype)
    larges: list[np.ndarray] = []
    for c in range(names):  # larger suffixes, from the smallest bucket up
        waves, k = large[c], 0
        while k < len(waves):
            now = waves[k]
            before = now[now > 0] - 1
            before = before[~small[before]]
            symbols = s[before]
            same = symbols == c
            if same.any():
                waves.append(before[same])
                _spread(before[~same], symbols[~same], large)
            else:
                _spread(before, symbols, large)
            k += 1
        larges.append(np.concatenate(waves) if waves else none)
        large[c] = []
        for now in seeds[c]:
            before = now[now > 0] - 1
            before = before[~small[before]]
            _spread(before, s[before], large)
    smalls: list[list[np.ndarray]] = [[] for _ in range(names)]
    out: list[np.ndarray] = []
    for c in range(names - 1, -1, -1):  # smaller ones, from the largest bucket down and each from its end
        waves, k = smalls[c], 0
        while k < len(waves):
            now = waves[k]
            before = now[now > 0] - 1
            before = before[small[before]]
            symbols = s[before]
            same = symbols == c
            if same.any():
                waves.append(before[same])
                _spread(before[~same], symbols[~same], smalls)
            else:
                _spread(before, symbols, smalls)
            k += 1
        now = larges[c][::-1]
        before = now[now > 0] - 1
        before = before[small[before]]
        _spread(before, s[before], smalls)
        if waves:
            out.append(np.concatenate(waves)[::-1])
        out.append(larges[c])
        larges[c] = none
    if names:
        out.append(np.array([len(s) - 1], lms.dtype))  # the last symbol alone
    return np.concatenate(out[::-1])


def named_ranges(s: np.ndarray, start: np.ndarray, end: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
    """The rank of each range of s that goes up to and with an LMS place, equal ones alike, and the number of ranks.

    Several symbols are packed in a number, and only what is still tied goes on to the next ones. A range that is
    the beginning of another is the larger of the two, as its last suffix is of type S and the other's of L.
    """
    n, bits = len(s), int(symbols).bit_length()
    per = 63 // bits
    behind = np.append(s, np.zeros(per, s.dtype))
    full = np.zeros(n, np.int64)  # the symbols from each place on
    for o in range(per):
        full <<= bits
        full |= behind[o : o + n]
    # of so many symbols all are kept, and behind them stand ones larger than all
    rest = np.array([(1 << bits * (per - k)) - 1 for k in range(per + 1)], np.int64)
    fill = np.array([sum(symbols << bits * j for j in range(per - k)) for k in range(per + 1)], np.int64)

    def packed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = np.clip(end - start, 0, per)
        return full[np.minimum(start, n - 1)] & ~rest[length] | fill[length]

    key = packed(start, end)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    done = per
    at = np.arange(len(order))
    while True:
        # whole groups of equal ranges so far, some of which go on
        starts = np.flatnonzero(new[at])
        sizes = np.diff(np.append(starts, len(at)))
        tied = (sizes > 1) & np.logical_or.reduceat((end - start)[order[at]] > done, starts)
        at = at[np.repeat(tied, sizes)]
        if not len(at):
            break
        mine, group = order[at], np.cumsum(new[at])
        key = packed(start[mine] + done, end[mine])
        turn = np.lexsort((key, group))
        order[at], key = mine[turn], key[turn]
        new[at] = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        done += per
    rank = np.cumsum(new) - 1
    names = np.empty(len(start), np.int64)
    names[order] = rank
    return names, int(rank[-1]) + 1


def suffix_array(s: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of s in order, or those at places. s: integers from 0, the last of which is the only 0."""
    n, symbols = len(s), int(s.max()) + 1
    if n == 1:
        return np.zeros(1, np.int32) if places is None else places
    small = smaller(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    names, kinds = named_ranges(s, lms.astype(np.int64), np.append(lms[1:], n - 1).astype(np.int64) + 1, symbols)
    order = suffix_array(names.astype(np.int32)) if kinds < len(lms) else np.argsort(names)
    return induce(s, small, lms[order], symbols, *(() if places is None else (places,)))


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of s the length it shares with the suffix before it in sa (permuted LCP), which may hold some suffixes only.

    Only irreducible places, whose left neighbours differ or are no neighbours in sa, are compared; elsewhere the value
    is one less than at the place before.
    """
    n = len(s)
    prior = np.full(n, -1, np.int32)
    prior[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    has = prior >= 0
    reducible = np.zeros(n, bool)
    reducible[1:] = has[1:] & has[:-1] & (prior[:-1] == prior[1:] - 1) & (s[:-1] == s[np.maximum(prior[1:] - 1, 0)])
    value = np.zeros(n, np.int32)
    i = np.flatnonzero(~reducible & has)
    # four symbols at a time; behind the end stand symbols that match nothing
    wide = np.concatenate([s.astype("<u2"), np.array([60000, 60001, 60002, 60003], "<u2")])
    quads = np.ndarray((n + 1,), "<u8", wide, 0, (2,))
    a, b, start = i, prior[i].astype(np.int64), i
    while len(a):
        x = quads[np.minimum(a, n)] ^ quads[np.minimum(b, n)]
        same = x == 0
        stop = ~same
        # whole equal symbols: trailing zero bits over 16
        low = x[stop] & (~x[stop] + np.uint64(1))
        value[start[stop]] = (a[stop] - start[stop]) + (np.frexp(low.astype(np.float64))[1] - 1) // 16
        a, b, start = a[same] + 4, b[same] + 4, start[same]
    head = np.maximum.accumulate(np.where(reducible, 0, at))
    plcp = value[head] - (at - head)
    return np.where(has, np.maximum(plcp, 0), 0)
