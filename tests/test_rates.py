"""The matrix kernels of beat rates against window-by-window loops, and on known pulses."""

import numpy as np
import pytest
from test_waves import RATE, naive_peaks, pulse

from pulseloom.functions import rates as r
from pulseloom.functions import waves as w

RNG = np.random.default_rng(8)
LIMITS = r.Limits()


def band(x, rate=RATE):
    return w.zero_phase(x, w.band_pass(4, 0.7, 3.0, rate))


def places(row):
    return [int(p) for p in row if p >= 0]


def test_tops_spacing_and_prominence_against_loops():
    for _ in range(60):
        x = RNG.integers(0, 9, (7, int(RNG.integers(3, 60)))).astype(float)
        distance, least = RNG.integers(1, 9, 7), RNG.integers(0, 6, 7).astype(float)
        at = r.tops(x)
        apart = r.spaced(x, at, distance)
        out = r.prominent(x, apart, least)
        for k in range(7):
            assert places(at[k]) == naive_peaks(x[k], 1, 0)
            assert places(apart[k]) == naive_peaks(x[k], distance[k], 0)
            assert places(out[k]) == naive_peaks(x[k], distance[k], least[k])


def test_template_and_intervals_against_loops():
    x = band(np.stack([pulse(b, noise=0.2, seed=b) for b in (50, 72, 110)] + [np.zeros(1200)]))
    at = r.spaced(x, r.tops(x), np.full(4, 30))
    got, found = r.template(x, at, RATE), r.regular(at, RATE, LIMITS)
    for k in range(4):
        beats = np.array([x[k, p - 25 : p + 41] for p in places(at[k]) if p >= 25 and p + 40 < 1200])
        if len(beats) < 3:
            assert np.isnan(got[k])
            continue
        middle = np.median(beats, axis=0)
        assert abs(got[k] - np.median([np.corrcoef(b, middle)[0, 1] for b in beats])) < 1e-9
        gap = np.diff(places(at[k])) / RATE
        some = gap[(gap >= 60 / 180) & (gap <= 1.5)]
        mid = np.median(some)
        near = some[np.abs(some - mid) <= max(3 * 1.4826 * np.median(np.abs(some - mid)), 0.1 * mid)]
        assert np.allclose([found["bpm"][k], found["cv"][k], found["share"][k]], [60 / np.median(near), near.std() / near.mean(), len(near) / len(gap)])
        assert found["beats"][k] == len(places(at[k]))


def test_strongest_lag_is_that_of_the_plain_sum():
    x = band(np.stack([pulse(b, noise=0.4, seed=b) for b in (45, 66, 95, 150)]))
    bpm, strength = r.strongest_lag(x, RATE, LIMITS)
    for k in range(4):
        y = x[k] - x[k].mean()
        c = np.array([(y[lag:] * y[: len(y) - lag]).sum() for lag in range(160)]) / (y * y).sum()
        lags = [lag for lag in range(34, 150) if c[lag] > c[lag - 1] and c[lag] > c[lag + 1]]
        best = max(lags, key=lambda lag: c[lag])
        assert abs(bpm[k] - 6000 / best) < 1e-9 and abs(strength[k] - c[best]) < 1e-9


def test_agreement_takes_the_first_largest_set():
    n, mid = r.agreeing(np.array([[70, 74, 80.5], [70, 90, np.nan], [np.nan] * 3, [60, 66, 67.0]]), 6.0)
    assert n.tolist() == [2, 1, 0, 3] and np.allclose(mid, [72, 70, np.nan, 66], equal_nan=True)


@pytest.mark.parametrize("bpm", [55, 72, 100, 130])
def test_pulses_are_accepted_and_noise_is_not(bpm):
    x = np.concatenate([band(pulse(bpm, 20, noise=0.05)), RNG.normal(size=(1, 2000)), np.zeros((1, 2000))])
    for estimator in (r.by_agreement, r.guided):
        got, why = estimator(x, RATE)
        assert why[0] == "" and abs(got[0] - bpm) < 1.5
        assert np.isnan(got[1:]).all() and why[1] and why[2]


def test_windows_do_not_see_each_other():
    x = band(np.stack([pulse(b, 8, noise=0.3, seed=b) for b in range(45, 150, 7)]))
    for estimator in (r.by_agreement, r.guided):
        whole, why = estimator(x, RATE)
        for k in range(len(x)):
            one, reason = estimator(x[k : k + 1], RATE)
            assert reason == [why[k]] and np.allclose(one, whole[k : k + 1], equal_nan=True)


def test_invalid_input_and_limits():
    x = band(np.stack([pulse(), pulse()]))
    x[1, 5] = np.nan
    got, why = r.guided(x, RATE)
    assert why == ["", "invalid_input"] and r.guided(x[:, :10], RATE)[1] == ["invalid_input"] * 2
    assert r.by_agreement(x[:1], RATE, r.Limits(beats=1000))[1] == ["beats"]
    assert r.guided(x[:1], RATE, r.Limits(support=2.0, strength=2.0))[1] == ["weak_autocorrelation;unsupported_fundamental"]


def test_finger_rate_replaces_lower_tops_that_are_too_near():
    x = 90_000 + 6000 * np.stack([pulse(), pulse(90), np.zeros(1200), pulse(72, noise=0.4)])
    got, n = r.finger(x, RATE)
    assert np.allclose(got[:2], [72, 90], atol=1) and np.isnan(got[2]) and n[2] == 0
    y = w.rolling_mean(x - w.rolling_mean(x, 75), 5)
    for k in range(4):
        kept, limit = [], max(0.0, 0.25 * y[k].std())
        for i in range(1, 1199):
            if y[k, i] > limit and y[k, i] >= y[k, i - 1] and y[k, i] > y[k, i + 1]:
                if not kept or i - kept[-1] >= 34:
                    kept.append(i)
                elif y[k, i] > y[k, kept[-1]]:
                    kept[-1] = i
        assert n[k] == len(kept)
