"""Parameters that guard data, checked when they are built."""

from __future__ import annotations

from dataclasses import dataclass, fields

PAD_MODES = ("reflect", "wrap", "edge", "constant")


@dataclass(frozen=True)
class Band:
    """Sampling, windows and spectrum. No up-sampling, no gaps, nothing above Nyquist."""

    target_rate: int
    min_native_rate: int
    window: int
    hop: int
    min_seconds: float = 0.0
    max_windows: int = 0
    pad_mode: str = "reflect"
    n_fft: int = 512
    fft_hop: int = 128
    n_mels: int = 64
    fmin: float = 0.0
    fmax: float | None = None

    def __post_init__(self):
        if self.min_native_rate < self.target_rate:
            raise ValueError("min_native_rate below target_rate would up-sample a recording")
        if self.window <= 0 or not 0 < self.hop <= self.window:
            raise ValueError("need a positive window and a hop no longer than it")
        if self.max_windows < 0:
            raise ValueError("max_windows must not be negative")
        if self.pad_mode not in PAD_MODES:
            raise ValueError(f"pad_mode must be one of {PAD_MODES}")
        top = self.target_rate / 2 if self.fmax is None else self.fmax
        if not 0 <= self.fmin < top <= self.target_rate / 2:
            raise ValueError("need 0 <= fmin < fmax <= Nyquist")


@dataclass(frozen=True)
class Split:
    """Folds, repeats and the seed they are dealt from."""

    n_folds: int = 5
    repeats: int = 1
    seed: int = 1234
    validation_splits: int = 5

    def __post_init__(self):
        if self.n_folds < 2:
            raise ValueError("need at least two folds")
        if self.repeats < 1:
            raise ValueError("need at least one repeat")
        if self.validation_splits < 2:
            raise ValueError("need at least two validation splits")


def from_mapping(kind, raw: dict):
    """Build parameters from a mapping, refusing unknown keys."""
    unknown = sorted(set(raw) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"unknown keys for {kind.__name__}: {unknown}")
    return kind(**raw)
