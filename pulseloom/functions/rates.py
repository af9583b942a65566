"""Beat rates of many windows at once: evidence from spectrum, autocorrelation and peaks, judged by a table of gates.

x is a matrix, a row for each window. Whatever differs from window to window (how far apart peaks must be, where a
low-pass ends) is a vector over the rows, so that no kernel goes window by window; the few loops left run over the
places of a window's peaks, all windows abreast. NaN stands for "no such estimate".
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np

from .waves import rolling_mean, welch, zero_phase

MAD = 1.4826
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Limits:
    """What an estimate must satisfy; the defaults are the published profile."""

    low: float = 40.0
    high: float = 180.0
    agree: float = 6.0
    beats: int = 8
    cv: float = 0.20
    valid: float = 0.70
    template: float = 0.60
    refractory_s: float = 0.40
    #: Peaks are at least this part of the spectrum's period apart, or, guided, of the autocorrelation's.
    spacing: float = 0.65
    guided_spacing: float = 0.70
    prominence: float = 0.35
    strength: float = 0.30
    support: float = 0.10
    low_pass: float = 1.5


def quietly(f):
    """f without numpy's word on rows that hold nothing but NaN."""

    def run(*args, **named):
        with warnings.catch_warnings(), np.errstate(invalid="ignore", divide="ignore"):
            warnings.simplefilter("ignore", RuntimeWarning)
            return f(*args, **named)

    return run


def deviation(x: np.ndarray) -> np.ndarray:
    """The scaled median absolute deviation of each row, NaN left out."""
    return MAD * np.nanmedian(np.abs(x - np.nanmedian(x, axis=1, keepdims=True)), axis=1)


def tops(x: np.ndarray) -> np.ndarray:
    """Places of the local maxima of each row in order, the middles of plateaus; -1 behind the last."""
    w, t = x.shape
    flat = x.ravel()
    begins = np.r_[True, flat[1:] != flat[:-1]]
    begins[::t] = True
    start = np.flatnonzero(begins)
    end = np.r_[start[1:], len(flat)] - 1
    level, row = flat[start], start // t
    up = np.r_[False, (level[1:] > level[:-1]) & (row[1:] == row[:-1])]
    down = np.r_[(level[:-1] > level[1:]) & (row[1:] == row[:-1]), False]
    hit = up & down
    row, at = row[hit], (start[hit] + end[hit]) // 2 % t
    count = np.bincount(row, minlength=w)
    out = np.full((w, int(count.max(initial=0))), -1)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = at
    return out


def heights(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), 1), -np.inf)


def packed(at: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The places kept, moved to the left."""
    keep = keep & (at >= 0)
    order = np.argsort(~keep, axis=1, kind="stable")
    out = np.take_along_axis(np.where(keep, at, -1), order, 1)
    return out[:, : int(keep.sum(axis=1).max(initial=0))]


def spaced(x: np.ndarray, at: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The tops that stay if the highest first silences all nearer than distance (of equals the last is the higher)."""
    high = heights(x, at)
    alive, keep = at >= 0, np.zeros(at.shape, bool)
    rows = np.flatnonzero(alive.any(axis=1))
    while len(rows):
        h = np.where(alive[rows], high[rows], -np.inf)
        best = h.shape[1] - 1 - h[:, ::-1].argmax(axis=1)
        keep[rows, best] = True
        alive[rows] &= np.abs(at[rows] - at[rows, best][:, None]) >= distance[rows, None]
        rows = rows[alive[rows].any(axis=1)]
    return packed(at, keep)


def prominent(x: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The places that stand out by least above the higher of the two lows which part them from anything higher."""
    w, t = x.shape
    place, high, keep = np.arange(t), heights(x, at), np.zeros(at.shape, bool)
    for k in range(at.shape[1]):
        p, h = at[:, k, None], high[:, k, None]
        taller = x > h
        left = np.where(taller & (place < p), place, -1).max(axis=1)[:, None]
        right = np.where(taller & (place > p), place, t).min(axis=1)[:, None]
        low = np.where((place > left) & (place <= p), x, np.inf).min(axis=1)
        low_right = np.where((place >= p) & (place < right), x, np.inf).min(axis=1)
        keep[:, k] = (at[:, k] >= 0) & (high[:, k] - np.maximum(low, low_right) >= least)
    return packed(at, keep)


def steps(at: np.ndarray, rate: float, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(seconds between neighbouring places, the same where a heart could beat so): NaN elsewhere."""
    gap = np.where(at[:, 1:] >= 0, np.diff(at, axis=1) / rate, np.nan) if at.shape[1] > 1 else np.full((len(at), 1), np.nan)
    return gap, np.where((gap >= 60 / limits.high) & (gap <= 60 / limits.low), gap, np.nan)


@quietly
def regular(at: np.ndarray, rate: float, limits: Limits) -> dict[str, np.ndarray]:
    """bpm, cv and share of the intervals near the median of the plausible ones."""
    gap, some = steps(at, rate, limits)
    mid = np.nanmedian(some, axis=1)
    enough = np.isfinite(some).sum(axis=1) >= 2
    near = np.abs(some - mid[:, None]) <= np.maximum(3 * deviation(some), 0.1 * mid)[:, None]
    good = np.where(near & enough[:, None], some, np.nan)
    n, all_ = np.isfinite(good).sum(axis=1), np.isfinite(gap).sum(axis=1)
    two = n >= 2
    return {
        "bpm": np.where(two, 60 / np.nanmedian(good, axis=1), np.nan),
        "cv": np.where(two, np.nanstd(good, axis=1) / np.nanmean(good, axis=1), np.nan),
        "share": np.where(enough, n / np.maximum(all_, 1), np.nan),
        "beats": (at >= 0).sum(axis=1),
    }


@quietly
def template(x: np.ndarray, at: np.ndarray, rate: float, before: float = 0.25, after: float = 0.40, least: int = 3) -> np.ndarray:
    """The median correlation of the beats around the places with their median beat."""
    a, z = int(round(before * rate)), int(round(after * rate))
    whole = (at >= a) & (at + z < x.shape[1])
    places = np.clip(at[:, :, None] + np.arange(-a, z + 1), 0, x.shape[1] - 1)
    beats = np.where(whole[:, :, None], np.take_along_axis(x, places.reshape(len(x), -1), 1).reshape(places.shape), np.nan)
    middle = np.nanmedian(beats, axis=1)
    dev = beats - beats.mean(axis=2, keepdims=True)
    mid = (middle - middle.mean(axis=1, keepdims=True))[:, None, :]
    size = np.sqrt((dev**2).sum(axis=2) * (mid**2).sum(axis=2))
    r = np.where(size > 0, (dev * mid).sum(axis=2) / size, np.nan)
    return np.where(whole.sum(axis=1) >= least, np.nanmedian(r, axis=1) if r.shape[1] else np.nan, np.nan)


def spectrum(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    return welch(x, rate, x.shape[1], max(4096, 1 << int(np.ceil(np.log2(max(x.shape[1], 2))))))


@quietly
def strongest_line(f: np.ndarray, power: np.ndarray, limits: Limits) -> np.ndarray:
    inside = (f >= limits.low / 60) & (f <= limits.high / 60)
    return np.where(power[:, inside].sum(axis=1) > 0, 60 * f[inside][power[:, inside].argmax(axis=1)], np.nan)


@quietly
def strongest_lag(x: np.ndarray, rate: float, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(bpm, correlation) of the highest local peak of the autocorrelation among the plausible lags."""
    t = x.shape[1]
    y = x - x.mean(axis=1, keepdims=True)
    n = 1 << int(np.ceil(np.log2(2 * t)))
    r = np.fft.irfft(np.abs(np.fft.rfft(y, n, axis=1)) ** 2, n, axis=1)[:, :t]
    live = (y * y).sum(axis=1) > 0
    a, z = max(1, int(np.floor(60 * rate / limits.high))), min(int(np.ceil(60 * rate / limits.low)), t - 1)
    if z <= a:
        return np.full(len(x), np.nan), np.zeros(len(x))
    part = np.where(live[:, None], r / np.where(live, r[:, 0], 1)[:, None], 0)[:, a : z + 1]
    at = tops(part)
    if not at.shape[1]:
        return np.full(len(x), np.nan), np.zeros(len(x))
    high = heights(part, at)
    best = high.argmax(axis=1)
    some = live & (at[:, 0] >= 0)
    lag = np.take_along_axis(at, best[:, None], 1)[:, 0] + a
    return np.where(some, 60 * rate / np.maximum(lag, 1), np.nan), np.where(some, high[np.arange(len(x)), best], 0.0)


@quietly
def agreeing(estimates: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """(number, median) of the largest set of a row's estimates that lie near one of them, the first of equals."""
    near = np.abs(estimates[:, None, :] - estimates[:, :, None]) <= within
    best = near.sum(axis=2).argmax(axis=1)
    of_best = near[np.arange(len(near)), best]
    return of_best.sum(axis=1), np.nanmedian(np.where(of_best, estimates, np.nan), axis=1)


def judged(bpm: np.ndarray, gates: dict[str, np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """(bpm where no gate is shut, names of the shut ones): gates hold True for windows that they refuse."""
    names = list(gates)
    shut = np.stack([gates[k] for k in names], axis=1)
    code = shut @ (1 << np.arange(len(names)))
    text = {c: ";".join(n for i, n in enumerate(names) if c >> i & 1) for c in np.unique(code).tolist()}
    return np.where(code == 0, np.round(bpm, 2), np.nan), [text[c] for c in code.tolist()]


def _common(found: dict[str, np.ndarray], likeness: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """The gates of both estimators; what could not be measured does not pass."""
    return {"beats": found["beats"] < limits.beats, "interval_cv": ~(found["cv"] <= limits.cv), "valid_intervals": ~(found["share"] >= limits.valid), "template": ~(likeness >= limits.template)}


@quietly
def by_agreement(x: np.ndarray, rate: float, limits: Limits = Limits()) -> tuple[np.ndarray, list[str]]:
    """(beats a minute, reasons against it) of filtered windows: two of spectrum, autocorrelation and peaks must agree."""
    line = strongest_line(*spectrum(x, rate), limits)
    period = np.where(np.isfinite(line), 60 / line, 0)
    distance = np.maximum(1, np.round(np.maximum(limits.refractory_s, limits.spacing * period) * rate))
    at = prominent(x, spaced(x, tops(x), distance), np.maximum(limits.prominence * deviation(x), EPS))
    found = regular(at, rate, limits)
    n, bpm = agreeing(np.stack([line, strongest_lag(x, rate, limits)[0], found["bpm"]], axis=1), limits.agree)
    return judged(bpm, _common(found, template(x, at, rate), limits) | {"methods": n < 2})


@quietly
def guided(x: np.ndarray, rate: float, limits: Limits = Limits()) -> tuple[np.ndarray, list[str]]:
    """(beats a minute, reasons against it): peaks of a smoothed copy, spaced by the autocorrelation, must agree with it.

    The spectrum can only veto the lag: its line there must not be weak against the strongest one.
    """
    w, t = x.shape
    fit = np.isfinite(x).all(axis=1) & (t >= 28) & (rate > 6)
    x = np.where(fit[:, None], x, 0.0)
    if not fit.any():
        return np.full(w, np.nan), ["invalid_input"] * w
    bpm, strength = strongest_lag(x, rate, limits)
    f, power = spectrum(x, rate)
    inside = (f >= limits.low / 60) & (f <= limits.high / 60)
    beside = np.abs(f - bpm[:, None] / 60) <= max(rate / t, rate / 4096)
    support = np.where(beside, power, 0).max(axis=1) / np.maximum(power[:, inside].max(axis=1), EPS)
    usable = fit & np.isfinite(bpm)
    guess = np.where(usable, bpm, 60.0)
    smooth = zero_phase(x, second_order_low_pass(np.minimum(np.minimum(3.0, limits.low_pass * guess / 60), 0.45 * rate), rate))
    distance = np.maximum(1, np.round(np.maximum(limits.refractory_s, limits.guided_spacing * 60 / guess) * rate))
    at = prominent(smooth, spaced(smooth, tops(smooth), distance), np.maximum(limits.prominence * deviation(smooth), EPS))
    found = regular(at, rate, limits)
    gates = {"weak_autocorrelation": strength < limits.strength, "unsupported_fundamental": support < limits.support}
    gates |= _common(found, template(x, at, rate), limits) | {"disagree": ~(np.abs(found["bpm"] - bpm) <= limits.agree)}
    alone = {"invalid_input": ~fit, "no_autocorrelation": fit & ~np.isfinite(bpm)}
    return judged((bpm + found["bpm"]) / 2, alone | {k: v & usable for k, v in gates.items()})


def second_order_low_pass(at: np.ndarray, rate: float) -> np.ndarray:
    """A Butterworth section (b0 b1 b2 a1 a2) for each frequency: one section, its numbers vectors over the rows."""
    k = np.tan(np.pi * at / rate)
    whole = 1 + np.sqrt(2) * k + k * k
    b = k * k / whole
    return np.array([[b, 2 * b, b, 2 * (k * k - 1) / whole, (1 - np.sqrt(2) * k + k * k) / whole]])


@quietly
def finger(ir: np.ndarray, rate: float, limits: Limits = Limits(), share: float = 0.25, base_s: float = 0.75, smooth_s: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(beats a minute or NaN, number of peaks) of raw windows: base line removed, smoothed, the median plausible interval.

    A top counts above a share of the row's standard deviation; one too near the last takes its place if it is higher.
    """
    x = rolling_mean(ir - rolling_mean(ir, max(5, int(round(base_s * rate)))), max(3, int(round(smooth_s * rate))))
    inner, limit = x[:, 1:-1], np.maximum(0.0, share * x.std(axis=1))[:, None]
    hit = (inner > limit) & (inner >= x[:, :-2]) & (inner > x[:, 2:])
    count = hit.sum(axis=1)
    row, place = np.nonzero(hit)
    at = np.full((len(x), int(count.max(initial=0))), -1)
    at[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = place + 1
    high, kept, n = heights(x, at), np.full_like(at, -1), np.zeros(len(x), np.int64)
    last, level, rows = np.full(len(x), -(1 << 40)), np.full(len(x), -np.inf), np.arange(len(x))
    for k in range(at.shape[1]):
        there = at[:, k] >= 0
        far = there & ((at[:, k] - last) / rate >= 60 / limits.high)
        take = far | (there & (high[:, k] > level))
        n = n + far
        kept[rows[take], n[take] - 1] = at[take, k]
        last, level = np.where(take, at[:, k], last), np.where(take, high[:, k], level)
    _, some = steps(kept, rate, limits)
    enough = (n >= 3) & (np.isfinite(some).sum(axis=1) >= 2)
    return np.where(enough, np.round(60 / np.nanmedian(some, axis=1), 2), np.nan), n.astype(np.int32)
