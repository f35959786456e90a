"""Amplitude spectrum (L5 derivative trace, L6 ad-hoc).

Bins k = 1 .. floor(N/2)-1 of the DFT (DC and, for even N, Nyquist
excluded), magnitude divided by the sum of those magnitudes, x = k * f1
where f1 = 1/(dt*N) converted to the display unit.  ``frequency_min/max`` of
the reference's configuration are stored but not applied, and neither are
they here.  A constant signal whose bins are exactly 0 gives NaN (no error).

Traces up to ``max_single`` samples are transformed in one grouped task
(numpy FFT over an Arrow batch).  Longer traces use the four-step FFT on array
pieces.  With N = A * B the samples are a matrix of A rows of B; a task takes a
bundle of columns, transforms them, multiplies by exp(-2 pi i n2 k1 / N), and
hands each bundle of the A transformed rows on; there a task has whole rows,
transforms them over n2 and has the bins k1 + A * k2.  The samples are real, so
only rows k1 <= A / 2 exist (the others mirror them): 8 bytes a sample move to
the columns and 8 to the rows, as slices of many values, and no task holds more
than about ``BUNDLE`` values or one row.  A length with no balanced split (a
prime, 2 x prime, ...) goes through Bluestein's chirp-z transform: the chirp is
made in the column tasks, both sequences are transformed together, multiplied
where their rows are, and the way back begins there, as a row of the product is
a column of the inverse.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from ..functions.units import FREQUENCY_PERIOD_S, TIME_TO_FREQ, TIME_UNITS
from ..session import scratch_path
from .util import bounded_broadcast

KEY = blocks.KEY
MAX_SINGLE = 1 << 22


def bin_width(implied_dt: float, dt_unit: str, n: int, display_unit: str) -> float:
    """f1 = 1/(dt*N) in the display unit, with the reference's operation
    order (value * period(display) / period(own))."""
    unit = {u.lower(): u for u in TIME_UNITS}[dt_unit.strip().lower()]
    f = 1 / (implied_dt * n)
    own = TIME_TO_FREQ[unit]
    disp = _freq_unit(display_unit)
    return f * FREQUENCY_PERIOD_S[disp] / FREQUENCY_PERIOD_S[own]


def _freq_unit(u: str) -> str:
    m = {k.lower(): k for k in FREQUENCY_PERIOD_S}
    key = u.strip().lower()
    if key not in m:
        raise ValueError(f"{u!r} is no frequency unit; known: {sorted(FREQUENCY_PERIOD_S)}")
    return m[key]


def spectrum_values(y: np.ndarray, f1: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole-signal numpy version: (x, y) of the normalised amplitude spectrum."""
    bins = np.arange(1, len(y) // 2)
    size = np.abs(np.fft.rfft(y))[bins]
    with np.errstate(invalid="ignore", divide="ignore"):
        return bins * f1, size / size.sum()


def _single(implied_dt, dt_unit, display_unit, out_trace):
    def fn(rows: list[dict]) -> list[dict]:
        y = np.concatenate([r["y"].astype(float) for r in rows])
        x, v = spectrum_values(y, bin_width(implied_dt, dt_unit, len(y), display_unit))
        return [{"project": rows[0]["project"], "version": rows[0]["version"],
                 "trace": out_trace or rows[0]["trace"], "x": x, "y": v}]
    return fn


def split_factor(n: int) -> int:
    """Largest divisor of n not above sqrt(n) (1 for primes)."""
    for d in range(int(math.isqrt(n)), 0, -1):
        if n % d == 0:
            return d
    return 1


#: Values that a column or row task holds at a time (or one column, one row).
BUNDLE = 1 << 20

_TRACE = "project string, version int, trace string"
#: A piece of a column bundle: row n1, first column, values.
_COLUMNS = f"{_TRACE}, size_n bigint, size_a bigint, size_b bigint, bundle bigint, n1 bigint, col bigint, re array<double>"
#: A piece of a row bundle: its rows' values in some columns, row by row.
_ROWS = (f"{_TRACE}, size_n bigint, size_a bigint, size_b bigint, bundle bigint, col bigint, width bigint, "
         "re array<double>, im array<double>, re2 array<double>, im2 array<double>")
_BINS = f"{_TRACE}, size_n bigint, k array<bigint>, mag array<double>"
_SIZES = ["size_n", "size_a", "size_b"]


def _width(other: int, bundle: int) -> int:
    """Columns (of ``other`` values each) or rows in a bundle.  Where columns
    are long for the bundle, still a few of them (within ``BUNDLE`` values), as
    pieces one value wide would be a row for each sample."""
    return max(1, bundle // other, min(other // 32, BUNDLE // other))


def _cut(r: dict, bundle: int, chunk: int) -> list[dict]:
    """A block of samples as pieces of column bundles."""
    y, at = r["y"].astype(float), r["block"] * chunk
    b, w = r["size_b"], _width(r["size_a"], bundle)
    head = {c: r[c] for c in [*KEY, *_SIZES]}
    out, i = [], at
    while i < at + len(y):
        n1, n2 = divmod(i, b)
        to = min(i + w - n2 % w, (n1 + 1) * b, at + len(y))  # the end of the bundle, the row or the block
        out.append({**head, "bundle": n2 // w, "n1": n1, "col": n2, "re": y[i - at:to - at]})
        i = to
    return out


def _matrix(rows: list[dict], bundle: int) -> tuple[int, np.ndarray]:
    """First column and the values [A, columns] of a column bundle (absent: 0)."""
    a, b = rows[0]["size_a"], rows[0]["size_b"]
    w = _width(a, bundle)
    first = rows[0]["bundle"] * w
    v = np.zeros((a, min(w, b - first)))
    for r in rows:
        at = r["col"] - first
        v[r["n1"], at:at + len(r["re"])] = r["re"]
    return first, v


def _rows_out(rows: list[dict], first: int, width: int, tall: int, *values: np.ndarray) -> list[dict]:
    """Transformed columns [rows, width], dealt to row bundles of ``tall``."""
    head = {c: rows[0][c] for c in [*KEY, *_SIZES]}
    out = []
    for g, at in enumerate(range(0, len(values[0]), tall)):
        part = [x for v in values for x in (np.ascontiguousarray(v[at:at + tall].real).ravel(),
                                            np.ascontiguousarray(v[at:at + tall].imag).ravel())]
        part += [None] * (4 - len(part))
        out.append({**head, "bundle": g, "col": first, "width": width, **dict(zip(("re", "im", "re2", "im2"), part))})
    return out


def _columns(rows: list[dict], bundle: int) -> list[dict]:
    """Real columns transformed and twisted."""
    n, b = rows[0]["size_n"], rows[0]["size_b"]
    first, v = _matrix(rows, bundle)
    t = np.fft.rfft(v, axis=0)
    n2, k1 = np.arange(first, first + v.shape[1]), np.arange(len(t))
    t *= np.exp(-2j * np.pi * (k1[:, None] * n2[None, :]) / n)  # k1 * n2 < n: exact
    return _rows_out(rows, first, v.shape[1], _width(b, bundle), t)


def _gather(rows: list[dict], length: int, names: tuple[str, str]) -> np.ndarray:
    """The rows of a bundle [rows, length] from their pieces."""
    tall = len(rows[0]["re"]) // rows[0]["width"]
    out = np.empty((tall, length), dtype=complex)
    for r in rows:
        out[:, r["col"]:r["col"] + r["width"]] = (r[names[0]] + 1j * r[names[1]]).reshape(tall, r["width"])
    return out


def _bins(rows: list[dict], bundle: int) -> list[dict]:
    """Magnitudes of all bins that a bundle of rows holds, mirrored where the
    row that holds them was left out."""
    n, a, b = (rows[0][c] for c in _SIZES)
    z = np.abs(np.fft.fft(_gather(rows, b, ("re", "im")), axis=1))
    head, out, first = {**{c: rows[0][c] for c in KEY}, "size_n": n}, [], rows[0]["bundle"] * _width(b, bundle)
    for k1, m in enumerate(z, first):
        k = k1 + a * np.arange(b, dtype=np.int64)
        direct = (k >= 1) & (k < n // 2)
        if k1 and 2 * k1 != a:  # the row a - k1 mirrors this one
            far = (n - k >= 1) & (n - k < n // 2)
            k, m = np.concatenate([k[direct], n - k[far]]), np.concatenate([m[direct], m[far]])
        else:
            k, m = k[direct], m[direct]
        out.append({**head, "k": k, "mag": m})
    return out


def _passes(columns: DataFrame, steps, bundle: int) -> DataFrame:
    """Array pieces through grouped steps: (function, key columns, schema)."""
    df = columns
    for fn, schema in steps:
        df = blocks.map_groups(df, [*KEY, "bundle"], "col", lambda rows, fn=fn: fn(rows, bundle), schema)
    return df


def _four_step(data: DataFrame, bundle: int, chunk: int) -> DataFrame:
    """Blocks with size_n = size_a * size_b -> bins of 1..N/2-1 (_BINS)."""
    return _passes(blocks.map_rows(data, lambda r: _cut(r, bundle, chunk), _COLUMNS),
                   ((_columns, _ROWS), (_bins, _BINS)), bundle)


def _phase(start: np.ndarray, width: int, n: int) -> np.ndarray:
    """pi j^2 / n for j = start + 0..width-1, from j^2 mod 2n in integers."""
    s2 = np.array([int(s) * int(s) % (2 * n) for s in start], dtype=np.int64)
    d = np.arange(width, dtype=np.int64)
    return np.pi * ((s2[:, None] + (2 * start[:, None] % (2 * n)) * d % (2 * n) + d * d % (2 * n)) % (2 * n)) / n


def _chirp_columns(rows: list[dict], bundle: int) -> list[dict]:
    """Columns of a_j = y_j e^(-i pi j^2 / N) and of b_j = e^(i pi j^2 / N)
    (j and M - j), transformed and twisted; M = A * B >= 2 N - 1."""
    n, a, b = (rows[0][c] for c in _SIZES)
    m = a * b
    first, y = _matrix(rows, bundle)
    w = y.shape[1]
    at = np.arange(a, dtype=np.int64) * b + first
    th = _phase(at, w, n)
    j = at[:, None] + np.arange(w)
    far = _phase(np.maximum(m - at - w + 1, 0), w, n)[:, ::-1]  # of m - j
    chirp = np.where(j < n, np.exp(1j * th), np.where(m - j < n, np.exp(1j * far), 0))
    twist = np.exp(-2j * np.pi * (np.arange(a)[:, None] * (first + np.arange(w))[None, :]) / m)
    va, vb = (np.fft.fft(x, axis=0) * twist for x in (y * np.exp(-1j * th), chirp))
    return _rows_out(rows, first, w, _width(b, bundle), va, vb)


def _chirp_rows(rows: list[dict], bundle: int) -> list[dict]:
    """Rows of both transforms multiplied; the inverse's columns (k1 fixed, k2
    running), transformed and twisted: its rows are the A-long ones."""
    _, a, b = (rows[0][c] for c in _SIZES)
    va, vb = (np.fft.fft(_gather(rows, b, names), axis=1) for names in (("re", "im"), ("re2", "im2")))
    first = rows[0]["bundle"] * _width(b, bundle)
    t = np.fft.fft(np.conj(va * vb), axis=1)
    t *= np.exp(-2j * np.pi * ((first + np.arange(len(t)))[:, None] * np.arange(b)[None, :]) / (a * b))
    return _rows_out(rows, first, len(t), _width(a, bundle), np.ascontiguousarray(t.T))


def _chirp_bins(rows: list[dict], bundle: int) -> list[dict]:
    n, a, b = (rows[0][c] for c in _SIZES)
    z = np.abs(np.fft.fft(_gather(rows, a, ("re", "im")), axis=1)) / (a * b)
    head, out = {**{c: rows[0][c] for c in KEY}, "size_n": n}, []
    for j1, m in enumerate(z, rows[0]["bundle"] * _width(a, bundle)):
        k = j1 + b * np.arange(a, dtype=np.int64)
        ok = (k >= 1) & (k < n // 2)
        out.append({**head, "k": k[ok], "mag": m[ok]})
    return out


def _bluestein(data: DataFrame, bundle: int, chunk: int) -> DataFrame:
    """Blocks of traces of any length size_n, with size_a * size_b >= 2 N - 1 ->
    bins (_BINS): |X_k| = |(a * b)_k|, the convolution being
    conj(FFT(conj(FFT(a) FFT(b)))) / M."""
    return _passes(blocks.map_rows(data, lambda r: _cut(r, bundle, chunk), _COLUMNS),
                   ((_chirp_columns, _ROWS), (_chirp_rows, _ROWS), (_chirp_bins, _BINS)), bundle)


def _sizes(r: dict, max_single: int) -> dict:
    """The matrix of a long trace: its own balanced factors, else those of the
    power of two that Bluestein needs."""
    n = r["size_n"]
    a = split_factor(n)
    if n // a <= max_single:
        return {**r, "size_a": n // a, "size_b": a, "own": True}
    bits = (2 * n - 2).bit_length()
    return {**r, "size_a": 1 << (bits // 2), "size_b": 1 << (bits - bits // 2), "own": False}


def spectrum(sig: DataFrame, implied_dt: float, dt_unit: str, display_unit: str | None = None,
             out_trace: str | None = None, max_single: int = MAX_SINGLE) -> DataFrame:
    """L5/L6 on every trace of ``sig`` (all one project's step).  Output rows
    use ``i`` = bin - 1, x = frequency, domain FREQUENCY.  Without a display
    unit (the ad-hoc spectrum, L6) x is in the frequency unit matching the
    project's time unit (ms -> KHz, us -> MHz, ...)."""
    if display_unit is None:
        display_unit = TIME_TO_FREQ[{u.lower(): u for u in TIME_UNITS}[dt_unit.strip().lower()]]
    _freq_unit(display_unit)
    # the input, which may be a computed trace, is evaluated once: block rows
    # are written, and lengths come from them
    spark = sig.sparkSession
    path = scratch_path(spark, "spectrum-blocks")
    blocks.to_blocks(sig, blocks.MIN_CHUNK).write.mode("overwrite").parquet(path)
    data = spark.read.parquet(path)
    lengths = data.groupBy(*KEY).agg(F.sum(F.size("y")).cast("bigint").alias("size_n"))
    lengths = bounded_broadcast(lengths)
    small = data.join(lengths.where(F.col("size_n") <= max_single), KEY)
    small = blocks.map_groups(small.select(*KEY, "block", "y"), KEY, "block",
                              _single(implied_dt, dt_unit, display_unit, out_trace),
                              "project string, version int, trace string, x array<double>, y array<double>")
    # a zero-sum spectrum is NaN (Q16)
    out = small.select("project", "version", "trace", F.posexplode(F.arrays_zip("x", "y")).alias("k", "v")).select(
        "project", "version", "trace", F.col("k").cast("bigint").alias("i"), F.col("v.x").alias("x"),
        F.coalesce("v.y", F.lit(float("nan"))).alias("y"), F.lit("FREQUENCY").alias("domain"))
    big_traces = lengths.where(F.col("size_n") > max_single)
    if big_traces.limit(1).count() == 0:
        return out
    facts = blocks.map_rows(big_traces, lambda r: [_sizes(r, max_single)],
                            f"{_TRACE}, size_n bigint, size_a bigint, size_b bigint, own boolean")
    long = data.select(*KEY, "block", "y").join(bounded_broadcast(facts), KEY)
    pieces = min(BUNDLE, max_single * 4)
    bins = _four_step(long.where("own").drop("own"), pieces, blocks.MIN_CHUNK).unionByName(
        _bluestein(long.where("not own").drop("own"), pieces, blocks.MIN_CHUNK))
    path = scratch_path(spark, "spectrum-bins")
    bins.write.mode("overwrite").parquet(path)
    bins = spark.read.parquet(path)
    sums = bins.groupBy(*KEY).agg(F.sum(F.aggregate("mag", F.lit(0.0), lambda a, v: a + v)).alias("_s"))
    bins = bins.select(*KEY, "size_n", F.explode(F.arrays_zip("k", "mag")).alias("v")).select(*KEY, "size_n", "v.k", "v.mag")
    unit = {u.lower(): u for u in TIME_UNITS}[dt_unit.strip().lower()]
    per_disp = FREQUENCY_PERIOD_S[_freq_unit(display_unit)]
    per_own = FREQUENCY_PERIOD_S[TIME_TO_FREQ[unit]]
    f1 = (F.lit(1.0) / (F.lit(float(implied_dt)) * F.col("size_n").cast("double"))) * F.lit(per_disp) / F.lit(per_own)
    norm = F.when(F.col("_s") == 0, F.lit(float("nan"))).otherwise(F.col("mag") / F.col("_s"))
    large = (bins.join(bounded_broadcast(sums), KEY)
             .select("project", "version",
                     (F.lit(out_trace) if out_trace else F.col("trace")).alias("trace"),
                     (F.col("k") - 1).alias("i"), (f1 * F.col("k").cast("double")).alias("x"),
                     norm.alias("y"), F.lit("FREQUENCY").alias("domain")))
    return out.unionByName(large)
