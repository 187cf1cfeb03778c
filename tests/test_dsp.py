"""Numeric kernels against closed forms and brute force."""

import numpy as np
import pytest

from oscilla.functions import dsp

T = np.arange(250) / 25.0
SINE = 30 * np.sin(2 * np.pi * 1.5 * T)


def polynomials(sos):
    b, a = np.array([1.0]), np.array([1.0])
    for row in sos:
        b, a = np.convolve(b, row[:3]), np.convolve(a, row[3:])
    return b, a


def test_published_lowpass_coefficients():
    b, a = polynomials(dsp.butterworth(4, 0.0, 0.2))
    assert np.allclose(b, [0.00482434, 0.01929737, 0.02894606, 0.01929737, 0.00482434], atol=1e-8)
    assert np.allclose(a, [1.0, -2.36951301, 2.31398841, -1.05466541, 0.18737949], atol=1e-8)


@pytest.mark.parametrize("order", [2, 3, 4, 5])
@pytest.mark.parametrize("low", [0.0, 0.05])
def test_half_power_at_the_edges(order, low):
    sos = dsp.butterworth(order, low, 0.3)
    for edge in [e for e in (low, 0.3) if e > 0]:
        z = np.exp(1j * np.pi * edge)
        b, a = polynomials(sos)
        assert abs(np.polyval(b, z) / np.polyval(a, z)) == pytest.approx(0.5**0.5, rel=1e-6)


def test_zero_phase_filter_keeps_constants_and_passband():
    assert np.allclose(dsp.band_filter(np.full((60, 1), 7.0), 25, 2.5, 0.0, 4), 7.0)
    y = dsp.band_filter(SINE[:, None], 25, 2.5, 0.1, 4)[:, 0]
    assert np.argmax(np.correlate(y, SINE, "full")) == 249
    assert np.allclose(dsp.band_filter(np.arange(20.0)[:, None], 25, 2.5, 0.1, 4)[:, 0], np.arange(20.0))


def test_detrend_removes_drift():
    # a cubic drift lies in the span of the fit, so it must leave no trace at all
    drift = 500 * (T / 10) ** 3 - 40 * T
    assert np.allclose(dsp.detrend(SINE + drift, 25, 3), dsp.detrend(SINE, 25, 3))
    assert dsp.detrend(SINE[:9], 25, 3) is not None and len(dsp.detrend(SINE[:9], 25, 3)) == 9


def test_running_median_mirrors_ends():
    x = np.array([5.0, 1, 4, 2, 8])
    assert dsp.running_median(x, 3).tolist() == [5.0, 4.0, 2.0, 4.0, 8.0]


def test_peaks_on_plateaus_and_distance():
    x = np.array([0, 1, 1, 1, 0, 3, 0, 2, 0, 2.5, 0.0])
    assert dsp.local_maxima(x).tolist() == [2, 5, 7, 9]
    assert dsp.prominences(x, np.array([2, 5, 7, 9])).tolist() == [1, 3, 2, 2.5]
    assert dsp.find_peaks(x, 3, 0.5).tolist() == [2, 5, 9]


def test_period_and_envelope():
    assert dsp.dominant_period(SINE, 25) in (16, 17)
    assert dsp.dominant_period(np.zeros(100), 25) == 0
    assert dsp.dominant_period(SINE[:19], 25) == 0
    assert np.median(dsp.envelope(SINE)) == pytest.approx(30, rel=0.01)


def brute_entropy(x, m=2):
    r = 0.2 * x.std(ddof=1)

    def count(k):
        t = [x[i : i + k] for i in range(len(x) - k)]
        return sum(
            np.max(np.abs(t[i] - t[j])) < r for i in range(len(t)) for j in range(i + 1, len(t))
        )

    a, b = count(m + 1), count(m)
    return np.nan if b == 0 else np.log(b) if a == 0 else -np.log(a / b)


def test_sample_entropy_brute_force():
    x = np.random.default_rng(0).normal(size=80)
    assert dsp.sample_entropy(x) == pytest.approx(brute_entropy(x))
    assert np.isnan(dsp.sample_entropy(np.arange(6.0))) and np.isnan(dsp.sample_entropy(np.ones(50)))


def test_sample_entropy_in_blocks():
    x = np.random.default_rng(1).normal(size=2600)
    close = np.abs(x[:, None] - x[None, :]) < 0.2 * x.std(ddof=1)
    k = len(x) - 2
    b = np.triu(close[:k, :k] & close[1 : k + 1, 1 : k + 1], 1)
    a = np.triu(b[: k - 1, : k - 1] & close[2 : k + 1, 2 : k + 1], 1)
    assert dsp.sample_entropy(x) == pytest.approx(np.log(b.sum() / a.sum()))


def test_periodicity_scores():
    share, strength, plausible = dsp.periodicity(SINE, 25, 0.3, 4)
    assert share > 0.95 and strength > 0.9 and plausible == 1.0
    fast = np.sin(2 * np.pi * 6 * T)
    assert dsp.periodicity(fast, 25, 0.3, 4)[2] < 0.01
    assert dsp.periodicity(SINE[:29], 25, 0.3, 4) == (0.0, 0.0, 0.0)
    assert dsp.periodicity(np.ones(60), 25, 0.3, 4) == (0.0, 0.0, 0.0)
    c = SINE - SINE.mean()
    lags = np.array([c[: len(c) - k] @ c[k:] for k in range(len(c))])
    assert np.allclose(dsp.autocorrelation(c), lags)
    assert strength == pytest.approx(lags[6:84].max() / lags[0])


def test_cycle_regularity():
    assert dsp.cycle_regularity(SINE, np.array([4, 21, 38, 54]), 50) > 0.99
    rng = np.random.default_rng(2)
    x, peaks = rng.normal(size=90), np.array([0, 14, 16, 40, 61, 88])
    grid = np.linspace(0, 1, 50)
    warped = [np.interp(grid, np.linspace(0, 1, b - a), x[a:b]) for a, b in zip(peaks, peaks[1:]) if b - a > 2]
    rs = [np.corrcoef(u, v)[0, 1] for u, v in zip(warped, warped[1:])]
    assert dsp.cycle_regularity(x, peaks, 50) == pytest.approx((np.mean(rs) + 1) / 2)
    x[20] = np.nan
    assert dsp.cycle_regularity(x, peaks[:4], 50) == 0.0
