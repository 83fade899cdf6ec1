"""Sample values: peaks, normalisation and clipping, and resampling by a bank of filters, for whole signals and for parts of them."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOUD = 1.05


def normalise(samples: np.ndarray) -> np.ndarray:
    """float32 samples divided by their peak if it passes LOUD, then clipped to -1 .. 1. A NaN peak scales nothing."""
    return scaled(samples, np.abs(np.asarray(samples, np.float32)).max(initial=0.0))


def scaled(samples: np.ndarray, peak: float) -> np.ndarray:
    """The same for a part of a signal whose peak is known."""
    out = np.array(samples, np.float32)  # a copy of its own, changed in place
    if peak > LOUD:
        out /= np.float32(peak)
    return out.clip(-1.0, 1.0, out=out)


def _clipped(samples: Column, peak: Column) -> Column:
    scale = F.when((peak > LOUD) & ~F.isnan(peak), peak).otherwise(F.lit(1.0))
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), (x.cast("double") / scale).cast("float"))))


def array_peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x))).cast("double")


def normalised_array(samples: Column) -> Column:
    """normalise for a column of float arrays without NaN; null and empty arrays stay."""
    return F.when(F.size(samples) > 0, _clipped(samples, array_peak(samples))).otherwise(samples)


def normalise_parts(parts: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """parts of signals (keys, a float array) normalised by the peak of their whole signal.

    Each part gives its own peak, of which one partial aggregate makes the signal's: neither a signal nor its parts
    are gathered. A NaN anywhere makes a NaN peak, which scales nothing. Null and empty parts stay as they are.
    """
    peaks = parts.groupBy(*keys).agg(F.max(array_peak(F.col(samples))).alias("_peak"))
    a, b = parts.alias("a"), peaks.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    scaled_array = F.when(F.size(samples) > 0, _clipped(F.col(samples), F.coalesce("_peak", F.lit(0.0)))).otherwise(F.col(samples))
    return a.join(b, same).select("a.*", "_peak").withColumn(samples, scaled_array).drop("_peak")


# Kernel: zero crossings to either side, share of the narrower band that passes, and the window's shape (70 dB).
CROSSINGS, PASSED, SHAPE = 24, 0.91, 6.76


class FilterBank:
    """Resampling from one whole rate to another: up / down in lowest terms, one Kaiser-windowed sinc kernel for each of the up phases.

    Each output sample is a sum of taps input samples in fixed order, so any part of a signal, computed from the input
    samples that needs() names, equals the same part of the whole bit by bit.
    """

    def __init__(self, old: int, new: int):
        common = gcd(old, new)
        self.up, self.down = new // common, old // common
        share = PASSED * min(1.0, new / old)
        self.half = ceil(CROSSINGS / share)
        offsets = np.arange(1 - self.half, self.half + 1)
        at = (np.arange(self.up) / self.up)[:, None] - offsets
        kernel = np.sinc(at * share) * np.i0(SHAPE * np.sqrt(np.maximum(0.0, 1 - (at / self.half) ** 2)))
        self.kernels = (kernel / kernel.sum(axis=1, keepdims=True)).T.copy()

    def needs(self, start: int, stop: int) -> tuple[int, int]:
        """The input samples that outputs start to stop are made of; they may lie outside the signal."""
        return start * self.down // self.up + 1 - self.half, (stop - 1) * self.down // self.up + self.half + 1

    def run(self, samples: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Outputs start to stop from the input samples that they need."""
        n = np.arange(start, stop, dtype=np.int64)
        phase, base = n * self.down % self.up, n * self.down // self.up
        base -= start * self.down // self.up
        x, out = samples.astype(np.float64), np.zeros(len(n))
        for t, kernel in enumerate(self.kernels):
            out += kernel[phase] * x[base + t]
        return out.astype(np.float32)


@lru_cache(maxsize=16)
def filter_bank(old: int, new: int) -> FilterBank:
    return FilterBank(old, new)


def resampled_length(n: int, old: int, new: int) -> int:
    """Samples of a signal of n at another rate, one at least."""
    return max(1, round(n * new / old)) if n else 0


def source_range(start: int, stop: int, old: int, new: int) -> tuple[int, int]:
    """The input samples that outputs start to stop are made of, at equal rates the same; they may lie outside the signal."""
    return (start, stop) if old == new else filter_bank(old, new).needs(start, stop)


def resample_part(read, n: int, start: int, stop: int, old: int, new: int) -> np.ndarray:
    """Outputs start to stop of a signal of n samples, of which read(a, b) gives those from a to b. Its ends are held beyond them."""
    a, b = source_range(start, stop, old, new)
    x = np.asarray(read(max(0, min(a, n - 1)), min(n, max(b, 1))), np.float32)
    if old == new:
        return x
    x = np.pad(x, (max(0, -a), max(0, b - n)), mode="edge")
    return filter_bank(old, new).run(x, start, stop)
