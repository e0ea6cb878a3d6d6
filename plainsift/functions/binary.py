"""Functions on bytes, numbers in bytes, and arrays of numbers, as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def big_endian(col: Column, at: int, size: int) -> Column:
    """The unsigned number of up to 7 bytes at a place of a binary, most significant first."""
    return F.conv(F.hex(F.substring(col, at + 1, size)), 16, 10).cast("bigint")


def little_endian(col: Column, at: int, size: int) -> Column:
    """The unsigned number of up to 7 bytes at a place of a binary, least significant first."""
    return F.conv(F.concat(*[F.hex(F.substring(col, at + size - k, 1)) for k in range(size)]), 16, 10).cast("bigint")


def syncsafe(col: Column, at: int) -> Column:
    """A number of four bytes of seven bits."""
    out = F.lit(0).cast("bigint")
    for k in range(4):
        out = F.shiftleft(out, 7).bitwiseOR(big_endian(col, at + k, 1).bitwiseAND(F.lit(127)))
    return out


def hex_context(col: Column, offset: Column, length: Column, around: int = 8) -> Column:
    """The bytes of a place with some around it, in lower-case hex."""
    low = F.greatest(offset - around, F.lit(0))
    return F.lower(F.hex(F.substr(col, low + 1, offset + length + around - low)))


def dos_time(date: Column, time: Column) -> Column:
    """A packed date and time as a timestamp; null where they name no moment."""
    part = lambda v, shift, mask: F.shiftright(v, shift).bitwiseAND(F.lit(mask))
    return F.try_make_timestamp(part(date, 9, 127) + 1980, part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), part(time, 0, 31) * 2)


def unix_time(seconds: Column) -> Column:
    """Seconds since 1970 as a timestamp."""
    return F.timestamp_seconds(seconds)


def mac_time(seconds: Column) -> Column:
    """Seconds since 1904 as a timestamp; 0 is none."""
    return F.when(seconds != 0, F.timestamp_seconds(seconds - 2082844800))


def uuid8(col: Column) -> Column:
    """A version-8 UUID made of the SHA-256 of col."""
    h = F.sha2(col, 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def blanked(col: Column, offset: int, length: int) -> Column:
    """col with a span of zeros in place, its length kept."""
    return F.overlay(col, F.lit(bytes(length)), F.lit(offset + 1), F.lit(length))


def shifted(offsets: Column, delta: Column, limit: Column) -> Column:
    """A table of offsets moved by delta; null if one would leave [0, limit)."""
    moved = F.transform(offsets, lambda x: x + delta)
    return F.when(F.forall(moved, lambda x: (x >= 0) & (x < limit)), moved)


def bit_agreement(a: Column, b: Column) -> Column:
    """The share of equal bits of two arrays of 32-bit numbers, over their common length."""
    n = F.least(F.size(a), F.size(b))
    wrong = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda acc, x: acc + x)
    return F.when(n > 0, 1 - wrong / (n * 32))


def hamming(a: Column, b: Column) -> Column:
    """The number of different bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def _squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def rmse(a: Column, b: Column, digits: int = 2) -> Column:
    """The root of the mean squared difference of two arrays; null if their lengths differ or they are empty."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.round(F.sqrt(_squares(a, b) / F.size(a)), digits))


def psnr(a: Column, b: Column, peak: float = 255.0) -> Column:
    """The peak signal-to-noise ratio in dB; infinite for equal arrays."""
    mean = _squares(a, b) / F.size(a)
    return F.when(mean == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / mean))


def pooled(profile: Column, bins: int = 128) -> Column:
    """A profile averaged into a fixed number of bins; an empty bin takes 0."""
    n = F.size(profile)

    def one(i: Column) -> Column:
        low, high = F.floor(i * n / bins).cast("int"), F.floor((i + 1) * n / bins).cast("int")
        part = F.slice(profile, low + 1, high - low)
        return F.when(high > low, F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / (high - low)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)


def band_limit(rate: Column) -> Column:
    """The highest frequency to compare at a sample rate."""
    return F.least(F.lit(16000), F.floor(F.lit(0.92) * rate / 2).cast("int"))


def similar_enough(correlation: Column, envelope: Column) -> Column:
    """Two recordings count as the same if they correlate by 0.99, or by 0.75 with envelopes that do by 0.99."""
    return (correlation >= 0.99) | ((correlation >= 0.75) & (envelope >= 0.99))


def time_limit(size: Column) -> Column:
    """Seconds a program may take: 300, and 20 for each megabyte."""
    return 300 + 20 * size / 1_000_000


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """The chance of k or more successes in n tries of chance p."""

    def one(k: int, n: int, p: float) -> float:
        if k <= 0:
            return 1.0
        if k > n:
            return 0.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)] if 0 < p < 1 else []
        return min(1.0, math.fsum(map(math.exp, logs))) if logs else float(p >= 1)

    return pd.Series([one(int(a), int(b), float(c)) if pd.notna(a) and pd.notna(b) and pd.notna(c) else None for a, b, c in zip(k, n, p, strict=True)])


LAGS, LAG_STEP = 3000, 25


@F.pandas_udf(T.StructType([T.StructField("lag", T.IntegerType()), T.StructField("correlation", T.DoubleType())]))
def best_lag(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The lag, up to LAGS samples in steps of LAG_STEP, at which two sample arrays correlate best, and how well; whole arrays
    are compared. The first lag of the greatest value counts; arrays without variation, or too short to overlap, give 0 and 0."""
    import numpy as np

    def one(x, y) -> tuple[int | None, float | None]:  # noqa: ANN001
        if x is None or y is None:
            return None, None
        x, y = np.asarray(x, float), np.asarray(y, float)
        best = (0, 0.0)
        for lag in range(-LAGS, LAGS + 1, LAG_STEP):
            u, v = (x[lag:], y) if lag >= 0 else (x, y[-lag:])
            n = min(len(u), len(v))
            if n < 2:
                continue
            u, v = u[:n] - u[:n].mean(), v[:n] - v[:n].mean()
            size = np.sqrt((u @ u) * (v @ v))
            if size and (found := float(u @ v / size)) > best[1]:
                best = (lag, found)
        return best

    return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=["lag", "correlation"])


def lag_correlation(a: Column, b: Column) -> Column:
    """The greatest normalised correlation of two sample arrays over the lags of `best_lag`."""
    return best_lag(a, b)["correlation"]


def band_energies(samples, frame: int = 4096, hop: int = 2048, bands: int = 24):  # noqa: ANN001, ANN201
    """Of each frame of a sample array, under a Hann window, the summed amplitude of each band of its spectrum."""
    import numpy as np

    x = np.asarray(samples if samples is not None else [], float)
    if len(x) < frame:
        return np.zeros((0, bands))
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(frame), axis=1))
    edges = np.linspace(0, spectrum.shape[1], bands + 1).astype(int)
    return np.stack([spectrum[:, lo:hi].sum(axis=1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)], axis=1)


def framed_energy(samples: Column, frame: int = 4096, hop: int = 2048, bands: int = 24) -> Column:
    """`band_energies` of a column of sample arrays: an array of frames, each an array of bands."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: [list(r) for r in band_energies(x, frame, hop, bands)])

    return run(samples)


def envelope_similarity(a: Column, b: Column, frame: int = 4096, hop: int = 2048, bands: int = 24) -> Column:
    """How the energies of two recordings over time and frequency correlate, on a logarithmic scale; 0 where one has none."""

    @F.pandas_udf(T.DoubleType())
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        import numpy as np

        def one(x, y) -> float:  # noqa: ANN001
            u, v = band_energies(x, frame, hop, bands), band_energies(y, frame, hop, bands)
            n = min(len(u), len(v))
            u, v = (np.log10(e[:n] + 1e-12).ravel() for e in (u, v))
            return float(np.corrcoef(u, v)[0, 1]) if n and u.std() > 1e-9 and v.std() > 1e-9 else 0.0

        return pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)])

    return run(a, b)


def band_limited(samples, rate: int, highest: int, block: int = 1 << 20, overlap: int = 1 << 15):  # noqa: ANN001, ANN201
    """A sample array without what lies above a frequency, filtered in blocks whose edges overlap and are left out."""
    import numpy as np

    def cut(x):  # noqa: ANN001, ANN202
        spectrum = np.fft.rfft(x)
        spectrum[np.fft.rfftfreq(len(x), 1 / rate) > highest] = 0
        return np.fft.irfft(spectrum, len(x))

    x = np.asarray(samples if samples is not None else [], float)
    out = np.zeros(len(x))
    for at in range(0, len(x), block - 2 * overlap):  # the middle of each block is kept, and the ends of the whole
        low, high = max(0, at - overlap), min(len(x), at - overlap + block)
        out[at : high if high == len(x) else high - overlap] = cut(x[low:high])[at - low : (high if high == len(x) else high - overlap) - low]
        if high == len(x):
            break
    return out
