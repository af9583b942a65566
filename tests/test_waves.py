"""The signal kernels against plain loops and known signals."""

import numpy as np
import pytest

from pulseloom.functions import waves as w

RATE = 100.0


def pulse(bpm=72, seconds=12, rate=RATE, seed=0, noise=0.0):
    t = np.arange(int(seconds * rate)) / rate
    phase = 2 * np.pi * bpm / 60 * t
    return np.sin(phase) + 0.25 * np.sin(2 * phase) + noise * np.random.default_rng(seed).normal(size=len(t))


def naive_filter(x, b, a):
    """Direct form, one polynomial, begun as if the first value had always been there."""
    y = []
    level = x[0] * sum(b) / sum(a)
    for n in range(len(x)):
        past = lambda v, k, n=n: v[n - k] if n - k >= 0 else (x[0] if v is x else level)
        y.append(sum(b[k] * past(x, k) for k in range(len(b))) - sum(a[k] * past(y, k) for k in range(1, len(a))))
    return np.array(y)


@pytest.mark.parametrize("sections", [w.band_pass(2, 0.7, 8.0, RATE), w.low_pass(2, 3.0, RATE)])
def test_sections_against_one_polynomial(sections):
    b, a = np.array([1.0]), np.array([1.0])
    for s in sections:
        b, a = np.convolve(b, s[:3]), np.convolve(a, [1, s[3], s[4]])
    x = 5 + pulse(seconds=3, noise=0.3)
    assert np.allclose(w._run(x[None, :], sections)[0], naive_filter(x, b, a), atol=1e-6)


def test_band_pass_gain_is_that_of_the_butterworth_family():
    s = w.band_pass(4, 0.5, 8.0, RATE)
    at = lambda f: abs(np.prod([(r[0] + r[1] * z + r[2] * z * z) / (1 + r[3] * z + r[4] * z * z) for r in s for z in [np.exp(-2j * np.pi * f / RATE)]]))
    warp = lambda f: np.tan(np.pi * f / RATE)
    for f in (0.2, 0.5, 1.0, 2.0, 5.0, 8.0, 15.0):
        side = (warp(f) ** 2 - warp(0.5) * warp(8.0)) / (warp(f) * (warp(8.0) - warp(0.5)))
        assert abs(at(f) - 1 / np.sqrt(1 + side**8)) < 1e-6
    with pytest.raises(ValueError):
        w.band_pass(4, 5.0, 60.0, RATE)


def test_zero_phase_keeps_peaks_in_place():
    x = pulse()
    y = w.zero_phase(1000 + x, w.band_pass(4, 0.5, 8.0, RATE))[0]
    assert np.abs(w.find_peaks(y, 40)[2:-2] - w.find_peaks(x, 40)[2:-2]).max() <= 1 and abs(y[200:-200].mean()) < 0.05


def naive_peaks(x, distance, prominence):
    at = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j] == x[i]:
            j += 1
        if x[i - 1] < x[i] and x[j] < x[i]:
            at.append((i + j - 1) // 2)
        i = j if j > i else i + 1
    alive = dict.fromkeys(at, True)
    for p in sorted(at, key=lambda p: (x[p], p), reverse=True):
        if alive[p]:
            for q in at:
                if q != p and abs(q - p) < distance:
                    alive[q] = False
    out = []
    for p in (p for p in at if alive[p]):
        a, b = p, p
        while a > 0 and x[a - 1] <= x[p]:
            a -= 1
        while b < len(x) - 1 and x[b + 1] <= x[p]:
            b += 1
        if x[p] - max(min(x[a : p + 1]), min(x[p : b + 1])) >= prominence:
            out.append(p)
    return out


def test_peaks_against_loops():
    r = np.random.default_rng(1)
    for _ in range(200):
        x = r.integers(0, 12, r.integers(3, 80)).astype(float)
        d, p = int(r.integers(1, 9)), float(r.integers(0, 6))
        assert w.find_peaks(x, d, p).tolist() == naive_peaks(x, d, p), (x, d, p)


def test_welch_of_a_sine_and_its_power():
    t = np.arange(800) / RATE
    x = np.stack([3 * np.sin(2 * np.pi * 5 * t), np.random.default_rng(0).normal(size=800)])
    f, p = w.welch(x, RATE, 400)
    assert f[p[0].argmax()] == 5.0 and abs(p[0].sum() * (f[1] - f[0]) - 4.5) < 0.05
    assert abs(p[1].sum() * (f[1] - f[0]) - x[1].var()) < 0.15


def test_rolling_mean():
    r = np.random.default_rng(5).normal(size=(3, 40))
    for k in (1, 4, 7):
        plain = [[row[max(0, i - (k - 1) // 2 - (k - 1) % 2) : i + (k - 1) // 2 + 1].mean() for i in range(40)] for row in r]
        assert np.allclose(w.rolling_mean(r, k), plain)


def test_morphology_finds_the_polarity():
    t = np.arange(1200) / RATE
    beat = (t * 1.2) % 1
    x = np.exp(-((beat - 0.25) ** 2) / 0.01) + 0.3 * np.exp(-((beat - 0.6) ** 2) / 0.02)
    up = w.morphology(w.zero_phase(x, w.band_pass(4, 0.5, 8.0, RATE))[0], RATE)
    assert up["sign"] == 1 and up["rejection"] == "" and abs(up["bpm"] - 72) < 1.5 and up["agreement"] > 0.95
    f = dict(zip(w.BEAT_FEATURES, np.median(up["features"], axis=0), strict=True))
    assert 0 < f["width_75_phase"] < f["width_50_phase"] < f["width_25_phase"] < 1 and f["rise_time_s"] < f["fall_time_s"]
    assert w.morphology(np.zeros(800), RATE)["rejection"] == "too_few_beats"


def test_clean_runs_are_filtered_apart():
    x, usable = 500 + pulse(seconds=20), np.ones(2000, bool)
    usable[900:1000] = usable[1100:1150] = False
    y = w.clean_runs_filtered(x, usable, RATE)
    assert np.isnan(y[900:1150]).all() and np.isfinite(y[:900]).all() and np.isfinite(y[1150:]).all()
    assert np.allclose(y[:900], w.zero_phase(x[:900], w.band_pass(4, 0.7, 3.0, RATE))[0])


def test_resampling_keeps_a_sine():
    t = np.arange(1000) / 100
    y = w.resampled(np.sin(2 * np.pi * 3 * t), 5, 4)
    assert len(y) == 1250 and np.abs(y[100:-100] - np.sin(2 * np.pi * 3 * np.arange(1250) / 125)[100:-100]).max() < 0.01
    assert w.resampled(t, 3, 3) is not None


def test_pressure_reference():
    t = np.arange(1000) / 100
    s, d, n = w.pressure_reference(100 + 20 * np.sin(2 * np.pi * 1.2 * t), 100)
    assert abs(s - 120) < 0.1 and abs(d - 80) < 0.1 and n >= 10 and w.pressure_reference(np.full(100, 90.0), 100) == (None, None, 0)


def test_synchronized_vector_of_known_windows():
    n, rate = 800, RATE
    ir = 60_000 + 1200 * np.stack([pulse(seconds=8), pulse(seconds=8)])
    axes = np.zeros((2, n, 3))
    axes[:, :, 2] = 1.0
    axes[1, :, 0] = 0.3 * np.sin(2 * np.pi * 1.5 * np.arange(n) / rate)
    got = w.synchronized(ir, ir * 0.8, axes, rate)
    assert len(got) == 37 and all(len(v) == 2 for v in got.values())
    assert got["imu_dynamic_rms_g"][0] < 1e-9 < got["imu_dynamic_rms_g"][1] and got["imu_activity_above_threshold_fraction"][0] == 0
    assert abs(got["imu_dominant_frequency_hz"][1] % 1.5) < 0.26 and np.allclose(got["ppg_red_ir_correlation"], 1) and (got["ppg_morphology_accepted"] == 1).all()
    assert abs(got["imu_accel_rms_g"][0] - 1) < 1e-9 and (got["ppg_clipping_fraction"] == 0).all() and abs(got["ppg_pulse_rate_bpm"][0] - 72) < 1.5


def test_lag_correlation_and_orientation():
    r = np.random.default_rng(2)
    a = r.normal(size=(1, 200))
    assert abs(w.lag_correlation(a, np.roll(a, 7, axis=1), 10)[0] - 1) < 0.05
    g = np.zeros((1, 100, 3))
    g[0, :50, 0] = g[0, 50:, 1] = 1
    assert abs(w.orientation(g, 20)[0] - 90) < 1e-9


@pytest.mark.parametrize("rate,n,rounded", [(16.0, 128, 9), (25.0, 400, 1), (16.0, 200, 0)])
def test_beats_of_many_windows_against_each_alone(rate, n, rounded):
    """Also with plateaus, equal peaks, flat and missing samples."""
    r = np.random.default_rng(n)
    x = 3 * np.sin(np.arange(n) / r.uniform(1.5, 6, (120, 1)) + r.uniform(0, 6, (120, 1))) * r.uniform(0.2, 1.5, (120, 1)) + r.normal(size=(120, n)) * r.uniform(0, 1, (120, 1))
    x = np.concatenate([np.round(x, rounded), np.zeros((2, n)), np.full((1, n), np.nan)])
    got = w.morphologies(x, rate, abreast=50)
    for i, one in enumerate(w.morphology(row, rate) for row in x):
        assert (got["sign"][i], got["beats"][i], got["peaks"][i], got["rejection"][i]) == (one["sign"], one["beats"], one["peaks"], one["rejection"])
        for k in ("bpm", "cv", "agreement"):
            assert np.isnan(got[k][i]) if one[k] is None else abs(got[k][i] - one[k]) < 1e-12
        want = np.median(one["features"], axis=0) if len(one["features"]) else np.full(len(w.BEAT_FEATURES), np.nan)
        assert np.allclose(got["features"][i], want, rtol=0, atol=1e-12, equal_nan=True)
    assert len({*got["rejection"].tolist()}) >= 3 and {*got["sign"].tolist()} == {1, -1}
    assert len(w.morphologies(x[:0], rate)["bpm"]) == 0
