"""Spectral descriptors of a block of windows in numpy, for use inside a task.

Blocks are ``(windows, samples)``; every function works on the whole block. The
transform is centred with zero padding and a periodic Hann window, mel bands follow
the Slaney scale with area normalisation.
"""

from __future__ import annotations

import numpy as np

# Summary statistics, contrast base frequency, floor of a power.
STATS = ("mean", "std", "p10", "p90")
CONTRAST_FMIN = 100.0
AMIN = 1e-10
TOP_DB = 80.0
SCALARS = (
    "centroid",
    "bandwidth",
    "rolloff85",
    "flatness",
    "zero_crossing_rate",
    "rms",
    "spectral_entropy",
)


def contrast_bands(rate: float, fmin: float = CONTRAST_FMIN) -> int:
    """Largest octave count with ``fmin * 2 ** (bands + 1)`` still allowed below Nyquist."""
    octaves = int(np.ceil(np.log2(rate / 2 / fmin))) - 1
    return max(octaves, 1)


def framed(block: np.ndarray, length: int, hop: int, mode: str) -> np.ndarray:
    padded = np.pad(block, ((0, 0), (length // 2, length // 2)), mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, length, axis=1)[:, ::hop]


def magnitudes(block: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """``(windows, bins, frames)`` magnitudes out of one transform."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    spectrum = np.fft.rfft(framed(block, n_fft, hop, "constant") * hann, axis=2)
    return np.abs(spectrum).transpose(0, 2, 1)


def hz_to_mel(hz):
    hz = np.asarray(hz, dtype=float)
    logs = 15.0 + np.log(np.maximum(hz, 1e-9) / 1000.0) * 27.0 / np.log(6.4)
    return np.where(hz < 1000.0, hz * 3.0 / 200.0, logs)


def mel_to_hz(mel):
    mel = np.asarray(mel, dtype=float)
    return np.where(
        mel < 15.0, mel * 200.0 / 3.0, 1000.0 * np.exp((mel - 15.0) * np.log(6.4) / 27.0)
    )


def mel_frequencies(count: int, fmin: float, fmax: float) -> np.ndarray:
    return mel_to_hz(np.linspace(hz_to_mel(fmin), hz_to_mel(fmax), count))


def mel_filters(rate: float, n_fft: int, n_mels: int, fmin: float, fmax: float) -> np.ndarray:
    """Triangular filters ``(n_mels, bins)`` of equal area."""
    bins = np.linspace(0, rate / 2, 1 + n_fft // 2)
    edges = mel_frequencies(n_mels + 2, fmin, fmax)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rising, falling = (bins - low) / (mid - low), (high - bins) / (high - mid)
    return np.maximum(0, np.minimum(rising, falling)) * (2.0 / (high - low))


def decibels(power: np.ndarray, axes, relative: bool) -> np.ndarray:
    """Power in dB with an 80 dB floor below the loudest cell of each window."""
    db = 10 * np.log10(np.maximum(power, AMIN))
    top = db.max(axis=axes, keepdims=True)
    floored = np.maximum(db, top - TOP_DB)
    return floored - top if relative else floored


def log_mel(block, rate, n_fft, hop, filters) -> np.ndarray:
    """Standardised mel spectrogram in dB: ``(windows, mels, frames)``."""
    db = decibels(filters @ magnitudes(block, n_fft, hop) ** 2, (1, 2), True)
    centred = db - db.mean(axis=(1, 2), keepdims=True)
    spread = centred.std(axis=(1, 2), keepdims=True)
    return centred / np.where(spread > 1e-6, spread, 1.0)


def summarise(series: np.ndarray) -> np.ndarray:
    """``(windows, series, frames)`` to statistics, statistic-major."""
    blocks = [series.mean(axis=2), series.std(axis=2)]
    blocks += [np.percentile(series, q, axis=2) for q in (10, 90)]
    return np.concatenate(blocks, axis=1)


def cosine_transform(values: np.ndarray, keep: int) -> np.ndarray:
    """Orthonormal DCT-II along axis 1, first ``keep`` coefficients."""
    n = values.shape[1]
    basis = np.cos(np.pi * np.arange(keep)[:, None] * (2 * np.arange(n) + 1) / (2 * n))
    basis *= np.sqrt(2.0 / n)
    basis[0] /= np.sqrt(2.0)
    return basis @ values


def slopes(values: np.ndarray) -> np.ndarray:
    """Least-squares slope over up to nine frames; the ends repeat the nearest full fit."""
    count = values.shape[2]
    width = max(min(9, count if count % 2 else count - 1), 3)
    if count < width:
        return np.zeros_like(values)
    half = width // 2
    k = np.arange(-half, half + 1)
    views = np.lib.stride_tricks.sliding_window_view(values, width, axis=2)
    inner = views @ (k / (k * k).sum())
    return np.pad(inner, ((0, 0), (0, 0), (half, half)), mode="edge")


def contrast(magnitude: np.ndarray, bins: np.ndarray, bands: int) -> np.ndarray:
    """Peak against valley level in each octave: ``(windows, bands + 1, frames)``."""
    edges = np.concatenate([[0.0], CONTRAST_FMIN * 2.0 ** np.arange(bands + 1)])
    peaks, valleys = [], []
    for band in range(bands + 1):
        low = np.searchsorted(bins, edges[band], side="left")
        high = np.searchsorted(bins, edges[band + 1], side="right")
        low = max(low - 1, 0) if band else low
        high = len(bins) if band == bands else high
        width = max(int(np.rint(0.02 * (high - low))), 1)
        # Below the last octave the bin on the upper edge belongs to the next one.
        stop = high if band == bands else max(high - 1, low + 1)
        ordered = np.sort(magnitude[:, low:stop], axis=1)
        valleys.append(ordered[:, :width].mean(axis=1))
        peaks.append(ordered[:, -width:].mean(axis=1))
    axes = (1, 2)
    peak = decibels(np.stack(peaks, axis=1), axes, False)
    return peak - decibels(np.stack(valleys, axis=1), axes, False)


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros_like(part), where=whole > 0)


def descriptor_names(rate: float, n_mfcc: int = 20) -> list[str]:
    groups = [("mfcc", n_mfcc), ("mfcc_delta", n_mfcc), ("contrast", contrast_bands(rate) + 1)]
    names = [f"{name}_{i}_{stat}" for name, n in groups for stat in STATS for i in range(n)]
    names += [f"{name}_{stat}" for name in SCALARS for stat in STATS]
    return [*names, "dominant_frequency", "dominant_frequency_ratio"]


def descriptors(block, rate, n_fft, hop, filters, n_mfcc: int = 20) -> np.ndarray:
    """Every descriptor of every window of a block, out of one transform."""
    magnitude = magnitudes(block, n_fft, hop)
    power = magnitude**2
    bins = np.linspace(0, rate / 2, 1 + n_fft // 2)
    column = bins[None, :, None]
    mfcc = cosine_transform(decibels(filters @ power, (1, 2), True), n_mfcc)

    total = magnitude.sum(axis=1, keepdims=True)
    weight = share(magnitude, np.broadcast_to(total, magnitude.shape))
    centroid = (weight * column).sum(axis=1, keepdims=True)
    bandwidth = np.sqrt((weight * (column - centroid) ** 2).sum(axis=1, keepdims=True))
    reached = np.cumsum(magnitude, axis=1) >= 0.85 * total
    rolloff = bins[reached.argmax(axis=1)][:, None]
    floored = np.maximum(power, AMIN)
    flatness = np.exp(np.log(floored).mean(axis=1, keepdims=True)) / floored.mean(
        axis=1, keepdims=True
    )
    held = framed(block, n_fft, hop, "edge")
    up = np.where(np.abs(held) <= AMIN, 0.0, held) >= 0
    crossings = (up[:, :, 1:] != up[:, :, :-1]).sum(axis=2)[:, None] / n_fft
    ends = power.copy()
    ends[:, 0] *= 0.5
    ends[:, -1] *= 0.5 if n_fft % 2 == 0 else 1.0
    rms = np.sqrt(2 * ends.sum(axis=1, keepdims=True)) / n_fft
    spread = share(power, np.broadcast_to(power.sum(axis=1, keepdims=True), power.shape))
    logs = np.log(np.where(spread > 0, spread, 1.0))
    entropy = -(spread * logs).sum(axis=1, keepdims=True) / np.log(power.shape[1])

    mean_power = power.mean(axis=2)
    peak = mean_power.argmax(axis=1)
    loudest = np.take_along_axis(mean_power, peak[:, None], axis=1)
    dominance = share(loudest, mean_power.sum(axis=1, keepdims=True))
    series = [mfcc, slopes(mfcc), contrast(magnitude, bins, contrast_bands(rate))]
    series += [centroid, bandwidth, rolloff, flatness, crossings, rms, entropy]
    table = np.concatenate(
        [*map(summarise, series), bins[peak][:, None], dominance], axis=1
    ).astype(np.float32)
    return np.nan_to_num(table, nan=0.0, posinf=0.0, neginf=0.0)
