"""Small NumPy kernels for the few steps that Catalyst cannot express.

Each kernel maps one packed signal (or a stack of equally long ones) and runs
inside an Arrow UDF.  Everything around them - interpolation, outlier replacement, crossings,
cycles, features - is Spark (see :mod:`oscilla.operators.kinematics`).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


# Butterworth design, as cascaded second-order sections


def _prototype_poles(order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))


def _digital(poles: np.ndarray, zeros: np.ndarray, gain: complex) -> tuple:
    """Bilinear transform at a sampling rate of 2 (so the map is (4 + s) / (4 - s))."""
    z_d = (4.0 + zeros) / (4.0 - zeros)
    p_d = (4.0 + poles) / (4.0 - poles)
    k_d = (gain * np.prod(4.0 - zeros) / np.prod(4.0 - poles)).real
    at_infinity = len(poles) - len(zeros)
    return np.append(z_d, -np.ones(at_infinity)), p_d, k_d


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Pair conjugate poles; real leftovers share sections; real zeros are dealt out in order."""
    upper = poles[poles.imag > 1e-12]
    real = np.sort(poles[np.abs(poles.imag) <= 1e-12].real)
    denominators = [np.array([1.0, -2.0 * p.real, abs(p) ** 2]) for p in upper]
    for i in range(0, len(real), 2):
        pair = real[i : i + 2]
        denominators.append(np.poly(pair) if len(pair) == 2 else np.array([1.0, -pair[0], 0.0]))
    # alternate +1 and -1 zeros so that every section of a band filter blocks both ends
    ordered = np.sort(zeros.real)
    half = len(ordered) // 2
    dealt = [z for pair in zip(ordered[:half], ordered[half:], strict=False) for z in pair]
    dealt += list(ordered[2 * half :])
    rows = []
    for i, den in enumerate(denominators):
        mine = dealt[2 * i : 2 * i + 2]
        num = np.zeros(3)
        num[: len(mine) + 1] = np.poly(mine) if mine else 1.0
        rows.append(np.concatenate([num, den]))
    sos = np.array(rows)
    sos[0, :3] *= gain
    return sos


@lru_cache(maxsize=64)
def butterworth(order: int, low: float, high: float) -> np.ndarray:
    """Sections of a low-pass (``low`` 0) or band-pass with edges in units of Nyquist."""
    warp = 4.0 * np.tan(np.pi * np.array([low, high]) / 2.0)
    poles = _prototype_poles(order)
    if low <= 0:
        wc = warp[1]
        return _sections(*_digital(poles * wc, np.zeros(0), wc**order))
    width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    scaled = poles * width / 2.0
    root = np.sqrt(scaled**2 - centre**2 + 0j)
    both = np.concatenate([scaled + root, scaled - root])
    return _sections(*_digital(both, np.zeros(order), width**order))


def steady_state(sos: np.ndarray) -> np.ndarray:
    """State of the whole cascade for a unit input that has always been on."""
    states, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        out = level * (b0 + b1 + b2) / (1.0 + a1 + a2)
        last = b2 * level - a2 * out
        states += [b1 * level - a1 * out + last, last]
        level = out
    return np.array(states)


@lru_cache(maxsize=64)
def _system(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The cascade as one linear system: state' = A state + B x, y = C state + D x."""
    sos = butterworth(order, low, high)
    d = 2 * len(sos)
    unit = np.eye(d + 1)
    signal, rows = unit[d], []
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        out = b0 * signal + unit[2 * k]
        rows += [b1 * signal - a1 * out + unit[2 * k + 1], b2 * signal - a2 * out]
        signal = out
    rows = np.array(rows)
    return rows[:, :d], rows[:, d], signal[:d], float(signal[d])


def filter_from(edges: tuple[int, float, float], x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter the columns of ``x`` from the states ``state`` (one column each); the output and the last states.

    A stretch of samples maps the state by an affine map, and such maps compose.  So the signal is
    cut into blocks of about the root of its length, all blocks run side by side from a zero state, the
    states at their starts follow from block to block, and what a start adds to its block is a
    product.  Time and memory are linear in the length.
    """
    a, b, c, d = _system(*edges)
    n, columns = x.shape
    length = max(1, int(np.sqrt(n)))
    blocks = n // length
    whole = blocks * length
    lanes = x[:whole].reshape(blocks, length, columns).transpose(1, 0, 2).reshape(length, blocks * columns)
    inner = np.zeros((len(a), blocks * columns))
    y = np.empty_like(lanes)
    reach = np.empty((length, len(a)))  # what a state at the start adds to each sample of a block
    power = np.eye(len(a))
    for k in range(length):
        y[k] = c @ inner + d * lanes[k]
        inner = a @ inner + b[:, None] * lanes[k]
        reach[k] = c @ power
        power = a @ power
    starts = np.empty((len(a), blocks, columns))
    for j, end in enumerate(inner.reshape(len(a), blocks, columns).transpose(1, 0, 2)):
        starts[:, j] = state
        state = power @ state + end
    y += reach @ starts.reshape(len(a), -1)
    out = np.empty_like(x)
    out[:whole] = y.reshape(length, blocks, columns).transpose(1, 0, 2).reshape(whole, columns)
    for i in range(whole, n):
        out[i] = c @ state + d * x[i]
        state = a @ state + b[:, None] * x[i]
    return out, state


def carried(edges: tuple[int, float, float], n: int, state: np.ndarray, own: np.ndarray) -> np.ndarray:
    """State after ``n`` samples that end in ``own`` when they start from zero, starting from ``state``."""
    return np.linalg.matrix_power(_system(*edges)[0], n) @ state + own


def padding(edges: tuple[int, float, float]) -> int:
    """Samples that a signal is extended by on either side."""
    sos = butterworth(*edges)
    return 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


def band_edges(fps: float, cutoff_hz: float, highpass_hz: float, order: int) -> tuple[int, float, float]:
    """Order and edges in units of Nyquist; a low-pass where the lower edge makes no sense."""
    nyquist = fps / 2.0
    high = float(np.clip(cutoff_hz / nyquist, 1e-4, 0.999))
    low = highpass_hz / nyquist if highpass_hz and highpass_hz > 0 else 0.0
    return order, 0.0 if low < 1e-4 or low >= high else low, high


def shortest_filtered(order: int) -> int:
    """Signals below this length are left as they are."""
    return 3 * (2 * order + 3)


def zero_phase(edges: tuple[int, float, float], x: np.ndarray) -> np.ndarray:
    """Forward and backward over the columns of ``x``, extended by their point reflection at both ends."""
    pad, steady = padding(edges), steady_state(butterworth(*edges))[:, None]
    y = np.vstack([2.0 * x[0] - x[pad:0:-1], x, 2.0 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        y, _ = filter_from(edges, y, steady * y[0])
        y = y[::-1]
    return y[pad:-pad]


def band_filter(
    x: np.ndarray, fps: float, cutoff_hz: float, highpass_hz: float, order: int
) -> np.ndarray:
    """Zero-phase band-pass of the columns of ``x``; low-pass without a high-pass edge."""
    if len(x) < shortest_filtered(order):
        return x.copy()
    return zero_phase(band_edges(fps, cutoff_hz, highpass_hz, order), x)


# drift


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Centred median of an odd window, the signal mirrored at its ends."""
    half = size // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="symmetric"), size)
    return np.median(windows, axis=1)


def detrend(x: np.ndarray, fps: float, order: int) -> np.ndarray:
    """Polynomial drift, then a running median of two dominant periods, subtracted."""
    n = len(x)
    if n < 10 or order < 1:
        return x
    t = np.arange(n) / fps
    rest = x - np.polyval(np.polyfit(t, x, order), t)
    freqs = np.fft.rfftfreq(n, d=1.0 / fps)
    power = np.abs(np.fft.rfft(rest)) ** 2
    plausible = (freqs >= 0.25) & (freqs <= 3.5)
    dominant = freqs[plausible][np.argmax(power[plausible])] if plausible.any() else 1.5
    size = max(5, int(fps / dominant * 2))
    return rest - running_median(rest, size + 1 - size % 2)


# peaks


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Strict local maxima; a plateau counts once, at its middle."""
    if len(x) < 3:
        return np.zeros(0, dtype=int)
    change = np.flatnonzero(np.diff(x) != 0)
    starts = np.concatenate([[0], change + 1])
    ends = np.concatenate([change, [len(x) - 1]])
    level = x[starts]
    top = np.zeros(len(level), dtype=bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[top] + ends[top]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height above the higher of the two lowest points on the way to higher ground."""
    out = np.empty(len(peaks))
    for j, p in enumerate(peaks):
        higher = np.flatnonzero(x > x[p])
        left = higher[higher < p]
        right = higher[higher > p]
        lo = left[-1] + 1 if len(left) else 0
        hi = right[0] if len(right) else len(x)
        out[j] = x[p] - max(x[lo : p + 1].min(), x[p:hi].min())
    return out


def find_peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Peaks kept by height under a minimum distance, then by prominence."""
    peaks = local_maxima(x)
    keep = np.ones(len(peaks), dtype=bool)
    if distance > 1:
        for j in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[j]:
                near = np.abs(peaks - peaks[j]) < distance
                near[j] = False
                keep &= ~near
    peaks = peaks[keep]
    return peaks[prominences(x, peaks) >= prominence]


def dominant_period(x: np.ndarray, fps: float) -> int:
    """Lag of the most prominent autocorrelation peak in the plausible range, 0 if none."""
    n = len(x)
    c = x - x.mean() if n else x
    if n < 20 or float(c @ c) < 1e-12:
        return 0
    acf = autocorrelation(c)
    lo, hi = max(3, int(fps / 3.5)), min(n // 2, int(fps / 0.25))
    if hi <= lo + 2:
        return 0
    part = acf[lo : hi + 1] / acf[0]
    peaks = local_maxima(part)
    strength = prominences(part, peaks)
    usable = strength >= 0.03
    if not usable.any():
        return 0
    return int(peaks[usable][np.argmax(strength[usable])] + lo)


def remove_running_mean(x: np.ndarray, period: int, fps: float, cycles: float) -> np.ndarray:
    """Signal minus its mean over about two periods, mirrored at the ends."""
    n = len(x)
    size = max(5, int(cycles * period) if period > 4 else int(2.0 * fps))
    size += 1 - size % 2
    size = max(3, min(size, n - 1 + n % 2))
    half = size // 2
    padded = np.pad(x, half, mode="reflect")
    total = np.concatenate([[0.0], np.cumsum(padded)])
    return x - (total[size:] - total[:-size]) / size


def envelope(x: np.ndarray) -> np.ndarray:
    """Instantaneous amplitude of the analytic signal."""
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1.0
    weight[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        weight[n // 2] = 1.0
    return np.abs(np.fft.ifft(np.fft.fft(x) * weight))


# complexity and periodicity


def sample_entropy(x: np.ndarray, m: int = 2, r_mult: float = 0.2, stride_above: int | None = None) -> float:
    """SampEn with strict tolerance; NaN where undefined.

    All pairs of samples are compared, in blocks of rows, so memory does not grow with the square of
    the length.  ``stride_above`` thins longer signals to about so many samples; it is off by default.
    """
    x = x[np.isfinite(x)]
    least = 2 * m + 3
    tolerance = r_mult * x.std(ddof=1) if len(x) >= least else 0.0
    if stride_above and len(x) > stride_above:
        x = x[:: len(x) // stride_above]
    if len(x) < least or tolerance < 1e-12 * r_mult:
        return float("nan")
    pairs = np.zeros(2, dtype=np.int64)  # that agree over m and over m + 1 samples
    starts = len(x) - m
    block = max(1, 4_000_000 // len(x))
    for low in range(0, starts, block):
        i, j = np.arange(low, min(low + block, starts)), np.arange(low, starts)
        close = j[None, :] > i[:, None]
        for step in range(m):
            close &= np.abs(x[i + step][:, None] - x[j + step][None, :]) < tolerance
        pairs[0] += np.count_nonzero(close)
        # the last start has no sample left for the longer template
        i, j = i[i < starts - 1], j[:-1]
        pairs[1] += np.count_nonzero(close[: len(i), :-1] & (np.abs(x[i + m][:, None] - x[j + m][None, :]) < tolerance))
    shorter, longer = pairs
    return float(np.log(shorter / max(longer, 1))) if shorter else float("nan")


def autocorrelation(centred: np.ndarray) -> np.ndarray:
    """Sums of products at all lags from 0, by a padded transform."""
    n = len(centred)
    size = 1 << (2 * n - 1).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(centred, size)) ** 2, size)[:n]


def periodicity(x: np.ndarray, fps: float, lo: float, hi: float) -> tuple[float, float, float]:
    """Three scores in [0, 1] of a signal that should repeat ``lo`` to ``hi`` times a second.

    The share of the power in that range within 0.3 Hz of its maximum; the largest normalised
    autocorrelation at the lags of that range; and 1 if the strongest frequency of 0.1 to 8 Hz lies in
    the range, falling off by a steep sigmoid outside.  Signals of fewer than 30 samples score zero.
    """
    n = len(x)
    if n < 30:
        return 0.0, 0.0, 0.0
    c = x - x.mean()
    hz, power = np.fft.rfftfreq(n, 1.0 / fps), np.abs(np.fft.rfft(c)) ** 2

    def bins(low: float, high: float) -> slice:
        return slice(np.searchsorted(hz, low, "left"), np.searchsorted(hz, high, "right"))

    def strongest(band: slice) -> float | None:
        part = power[band]
        return float(hz[band][part.argmax()]) if len(part) >= 2 and part.sum() >= 1e-12 else None

    share = strength = plausible = 0.0
    inside = bins(lo, hi)
    if (peak := strongest(inside)) is not None:
        near = bins(max(lo, peak - 0.3), min(hi, peak + 0.3))
        share = float(power[near].sum() / power[inside].sum())
    lags = slice(max(1, int(fps / hi)), min(n // 2, int(fps / lo)) + 1)
    if lags.stop - lags.start >= 2 and float(c @ c) >= 1e-12:
        strength = float(np.clip(autocorrelation(c)[lags].max() / float(c @ c), 0.0, 1.0))
    if (peak := strongest(bins(0.1, 8.0))) is not None:
        outside = max(lo - peak, peak - hi, 0.0)
        plausible = 1.0 if not outside else float(1.0 / (1.0 + np.exp(10.0 * outside)))
    return share, strength, plausible


def cycle_regularity(x: np.ndarray, peaks: np.ndarray, points: int) -> float:
    """Mean correlation of neighbouring cycles, each stretched to ``points`` samples, mapped to [0, 1].

    Cycles are stretched together into one table of standardised rows, whose neighbours are multiplied.
    Cycles of fewer than three samples, with a hole, or past the end are left out, and flat ones make no pair.
    """
    starts, lengths = peaks[:-1], np.diff(peaks)
    holes = np.concatenate([[0], np.cumsum(np.isnan(x))])
    fits = (lengths >= 3) & (peaks[1:] <= len(x))
    starts, lengths = starts[fits], lengths[fits]
    whole = holes[starts + lengths] == holes[starts]
    starts, lengths = starts[whole], lengths[whole]
    if len(starts) < 2:
        return 0.0
    at = np.linspace(0.0, 1.0, points)[None, :] * (lengths - 1)[:, None]
    left = np.minimum(np.floor(at).astype(int), (lengths - 2)[:, None])
    base = starts[:, None] + left
    table = x[base] + (at - left) * (x[base + 1] - x[base])
    spread = table.std(axis=1)
    usable = (spread[:-1] >= 1e-9) & (spread[1:] >= 1e-9)
    if not usable.any():
        return 0.0
    rows = (table - table.mean(axis=1, keepdims=True)) / np.where(spread >= 1e-9, spread, 1.0)[:, None]
    r = (rows[:-1] * rows[1:]).mean(axis=1)[usable]
    return float(np.clip((r.mean() + 1.0) / 2.0, 0.0, 1.0))
