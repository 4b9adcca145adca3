"""Comparison of signals and vectors: norms, level, envelope, correlation and lag as columns; offsets of long signals by FFT."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value of the envelope: samples a block, 10 ms at 16 kHz.
BLOCK = 160
# Fixed values of the search for an offset: blocks at most either way, and samples compared in the fine search.
SPAN, PROBE = 200, 16_000 * 20
#: Correlations nearer than this to the best are made again from the samples, since FFT rounds.
NEAR = 1e-7


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def l2_norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(x), lambda v: v * v)))


def rms(x: Column) -> Column:
    """Root of the mean square; 0 for no samples."""
    return F.when(F.size(x) == 0, 0.0).otherwise(l2_norm(x) / F.sqrt(F.size(x)))


def envelope(x: Column, block: int = BLOCK) -> Column:
    """Level of each block; the last one may be shorter."""
    starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: rms(F.slice(x, at, block)))


def correlation(a: Column, b: Column) -> Column:
    """Normalised correlation of the part that both have; 0 where one is silent or empty."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(_doubles(a), 1, n), F.slice(_doubles(b), 1, n)
    size = l2_norm(x) * l2_norm(y)
    return F.coalesce(F.try_divide(_sum(F.zip_with(x, y, lambda p, q: p * q)), F.when(size > 0, size)), F.lit(0.0))


def best_lag(a: Column, b: Column, reach: int) -> Column:
    """correlation and lag: how far b is shifted against a where they agree best; the least lag on ties."""
    rest = lambda x, skip: F.slice(x, skip + 1, F.greatest(F.size(x) - skip, F.lit(0)))

    def at(lag: Column) -> Column:
        ahead, behind = F.greatest(lag, F.lit(0)), F.greatest(-lag, F.lit(0))
        fits = (ahead < F.size(b)) & (behind < F.size(a))
        return F.when(fits, F.struct(correlation(rest(a, behind), rest(b, ahead)).alias("correlation"), (-lag).alias("back")))

    best = F.array_max(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), at))
    return F.struct(best["correlation"].alias("correlation"), (-best["back"]).alias("lag"))


def _correlation(a: np.ndarray, b: np.ndarray, lag: int) -> float:
    x, y = a[max(-lag, 0) :], b[max(lag, 0) :]
    n = min(len(x), len(y))
    size = np.sqrt((x[:n] ** 2).sum()) * np.sqrt((y[:n] ** 2).sum())
    return float(x[:n] @ y[:n] / size) if size else 0.0


def lag_by_fft(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Best normalised correlation for lags from low to high, and the least lag that has it; (-inf, low) where none fits."""
    lags = np.arange(max(low, 1 - len(a)), min(high, len(b) - 1) + 1)
    if not len(lags):
        return float("-inf"), low
    size = 1 << (len(a) + len(b)).bit_length()
    products = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[lags]
    sa, sb = (np.concatenate(([0.0], np.cumsum(x**2))) for x in (a, b))
    skip_a, skip_b = np.maximum(-lags, 0), np.maximum(lags, 0)
    n = np.minimum(len(a) - skip_a, len(b) - skip_b)
    energy = np.sqrt(np.maximum((sa[skip_a + n] - sa[skip_a]) * (sb[skip_b + n] - sb[skip_b]), 0.0))
    found = np.where(energy > 1e-12 * max(sa[-1], sb[-1], 1e-300), products / np.maximum(energy, 1e-300), 0.0)
    exact = [(_correlation(a, b, int(k)), -int(k)) for k in lags[found >= found.max() - NEAR]]
    best, back = max(exact)
    return best, -back


def offset(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> int:
    """Samples by which b is behind a: coarsely by the levels of blocks, then by samples within a block of that."""
    level = lambda x: np.sqrt(np.add.reduceat(x**2, np.arange(0, len(x), block)) / np.diff(np.append(np.arange(0, len(x), block), len(x)))) if len(x) else x
    ea, eb = level(a), level(b)
    n = min(len(ea), len(eb))
    span = min(n // 4, SPAN)
    best, coarse = lag_by_fft(ea[:n], eb[:n], -span, span)
    centre = coarse * block if best > float("-inf") else 0
    probe = min(PROBE, len(a), len(b))
    best, fine = lag_by_fft(a[:probe], b[:probe], centre - block, centre + block)
    return fine if best > float("-inf") else centre


def global_offset(a: Column, b: Column, block: int = BLOCK) -> Column:
    """`offset` of two arrays of samples, null for a null one."""

    @F.pandas_udf(T.LongType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left, right, strict=True)
        return pd.Series([None if x is None or y is None else offset(np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64), block) for x, y in pairs], dtype="Int64")

    return run(a, b)


def shifted(a: Column, b: Column, lag: Column) -> Column:
    """A struct of `a` and `b`, the parts of both that overlap once b is moved back by the lag."""
    x, y = (F.slice(c, skip.cast("int") + 1, F.greatest(F.size(c) - skip.cast("int"), F.lit(0))) for c, skip in ((a, F.greatest(-lag, F.lit(0))), (b, F.greatest(lag, F.lit(0)))))
    n = F.least(F.size(x), F.size(y))
    return F.struct(F.slice(x, 1, n).alias("a"), F.slice(y, 1, n).alias("b"))
