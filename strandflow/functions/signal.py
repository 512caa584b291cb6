"""Column functions on signals (`array<double>`); all of them stay in the JVM.

Arithmetic is in double precision. Empty and null signals give empty and null results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The factor between MAD and standard deviation, and the least MAD.
MAD_SCALE = 1.4826
LEAST_MAD = 1e-8


def _with(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def median(signal: Column) -> Column:
    """Exact median; null for an empty signal."""
    middle = _with(F.array_sort(signal), lambda s: (
        F.element_at(s, F.shiftright(F.size(s) + 1, 1)) + F.element_at(s, F.shiftright(F.size(s), 1) + 1)) / 2.0)
    return F.when(F.size(signal) > 0, middle)


def mad(signal: Column, center: Column) -> Column:
    """Median absolute deviation from `center`, `LEAST_MAD` if it is 0."""
    m = median(F.transform(signal, lambda x: F.abs(x - center)))
    return F.when(m == 0, LEAST_MAD).otherwise(m)


def to_picoamperes(raw: Column, digitisation: Column, offset: Column, span: Column) -> Column:
    return F.transform(raw, lambda x: (x.cast("double") + offset) * (span / digitisation))


def robust_scale(signal: Column, center: Column, spread: Column, clip: float | None = 5.0) -> Column:
    """(x - center) / (MAD_SCALE * spread), clipped to +-clip."""
    scaled = F.transform(signal, lambda x: (x - center) / (spread * MAD_SCALE))
    return scaled if clip is None else F.transform(scaled, lambda x: F.greatest(F.lit(-clip), F.least(F.lit(clip), x)))


def normalize(signal: Column, clip: float | None = 5.0) -> Column:
    """Struct (norm, median, mad) of a signal, each computed once."""
    return _with(signal, lambda s: _with(median(s), lambda m: _with(mad(s, m), lambda d: F.struct(
        robust_scale(s, m, d, clip).alias("norm"), m.alias("median"), d.alias("mad")))))


def chunks(signal: Column, size: int) -> Column:
    """Array of (start, chunk); the last may be short, an empty signal has none."""
    n = F.size(signal)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    parts = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(signal, s + 1, F.lit(size)).alias("chunk")))
    return F.when(n > 0, parts).otherwise(F.filter(parts, lambda p: F.lit(False)))


def normalize_chunks(signal: Column, size: int, clip: float | None = 5.0) -> Column:
    return F.flatten(F.transform(chunks(signal, size), lambda c: normalize(c["chunk"], clip)["norm"]))


def denormalize(norm: Column, center: Column, spread: Column, mad_scale: float = MAD_SCALE) -> Column:
    scale = F.struct(center.alias("center"), (spread * mad_scale).alias("spread"))
    return _with(scale, lambda c: F.transform(norm, lambda x: x * c["spread"] + c["center"]))


def median_filter(signal: Column, kernel: int) -> Column:
    """Centred window cut at the edges; the upper median where it is even."""
    if kernel % 2 == 0:
        raise ValueError("an even kernel has no centre")
    if kernel == 1:
        return signal
    half = kernel // 2

    def of(s: Column) -> Column:
        n = F.size(s)
        out = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _with(
            F.array_sort(F.slice(s, F.greatest(F.lit(1), i - half), F.least(n, i + half) - F.greatest(F.lit(1), i - half) + 1)),
            lambda w: F.element_at(w, F.shiftright(F.size(w), 1) + 1)))
        return F.when(n > 0, out).otherwise(s)

    return _with(signal, of)


def spikes(signal: Column, threshold: float) -> Column:
    return F.transform(signal, lambda x: F.abs(x) > threshold)


def trim_position(signal: Column, window: int = 200, threshold: float = 2.0, min_trim: int = 100) -> Column:
    """Samples to cut: the first largest jump between means of neighbouring windows, if it is large enough.

    The difference of neighbouring rolling means is (x[i + window] - x[i]) / window, so no mean is computed.
    """

    def of(s: Column) -> Column:
        n = F.size(s)
        more = F.greatest(n - window, F.lit(0))
        jumps = F.zip_with(F.slice(s, window + 1, more), F.slice(s, 1, more), lambda a, b: F.abs(a - b) / window)
        best = lambda j: F.struct(F.array_max(j).alias("jump"), F.array_position(j, F.array_max(j)).cast("int").alias("at"))
        found = lambda b: F.when(b["jump"] < threshold, min_trim).otherwise(F.greatest(b["at"] - 1 + window // 2, F.lit(min_trim)))
        place = _with(_with(_with(jumps, best), found), lambda p: F.when(p >= n, min_trim).otherwise(p))
        return F.when(n < 2 * window, 0).otherwise(place)

    return _with(signal, of)


def trim(signal: Column, window: int = 200, threshold: float = 2.0, min_trim: int = 100) -> Column:
    """Signal after its `trim_position`; empty if that lies beyond its end."""
    return _with(signal, lambda s: F.slice(s, trim_position(s, window, threshold, min_trim) + 1, F.greatest(F.size(s), F.lit(0))))
