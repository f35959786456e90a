"""Savitzky-Golay (L3) and zero-phase Butterworth low-pass (L1, L2) filters,
overlay dispatch (L4), normalised cutoff (U11).

Both filters work on blocks of ``blocks.MIN_CHUNK`` samples, whatever the
width of the window or the length of the impulse response.

Low-pass: every block is filtered from zero state; what it makes of the filter
state (ten numbers) is an affine map, and a scan over these maps, by segments
of bounded size, gives the state that enters each block.  The backward pass
does the same from the end.  Then each block is filtered from its true states.  There is no truncated response and
no halo.  A trace with a null sample is null throughout (the recurrence would
carry it to every later sample of either pass).

Savitzky-Golay: the weights of a window are a polynomial of the offset, so a
window sum is a combination of moments.  A block of outputs needs the samples
at the two moving ends of its windows and the moments of the whole blocks
between them, taken about each block's own origin and moved to the output's.
A null sample makes exactly the windows null that contain it.

The true signal ends get the edge rules: "nearest" padding for Savitzky-Golay,
odd extension of 33 samples plus steady-state start for the low-pass.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from ..functions import units
from ..functions.units import frequency_hz, sampling_rate_hz
from ..session import remove, scratch_path
from .util import bounded_broadcast

KEY = blocks.KEY
OUT_SCHEMA = "project string, version int, trace string, i bigint, x double, y double, domain string"

# Overlay names and defaults.
SAVGOL_NAME = "Savitzky–Golay"
LOWPASS_NAME = "Lowpass"
NONE_NAME = "None"
SAVGOL_DEFAULT_WINDOW = "3%"
SAVGOL_DEFAULT_POLYORDER = 2
LOWPASS_DEFAULT_CUTOFF = "0.5 MHz"
BUTTER_ORDER = 10
FILTFILT_PADLEN = 33  # 3 * (order + 1)


# --------------------------------------------------------------------------
# Savitzky-Golay

def savgol_window(window_length: str, n: int) -> int:
    """"N%" -> int(n * N / 100) points; otherwise an absolute integer."""
    w = window_length.strip()
    if w.endswith("%"):
        return int(n * float(w.replace("%", "").strip()) / 100)
    return int(w)


def savgol_offsets(window: int) -> np.ndarray:
    """Sample offsets of the window around the output sample: -h..h for odd
    windows, -(W/2-1)..W/2 for even ones (fit centred half a sample right)."""
    if window % 2:
        h = window // 2
        return np.arange(-h, h + 1)
    return np.arange(-(window // 2 - 1), window // 2 + 1)


@lru_cache(maxsize=256)
def savgol_coeffs(window: int, polyorder: int) -> np.ndarray:
    """Weights of the least-squares polynomial's value at the window centre,
    aligned with :func:`savgol_offsets`."""
    if window <= polyorder:
        raise ValueError(f"a window of {window} samples cannot carry a fit of order {polyorder}")
    pos = savgol_offsets(window).astype(float) - (0.0 if window % 2 else 0.5)
    scale = max(1.0, np.abs(pos).max())
    A = np.vander(pos / scale, polyorder + 1, increasing=True)
    return np.linalg.pinv(A)[0]


def _saved(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _dropped(*tables: DataFrame) -> None:
    """Delete tables of ``_saved`` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.scratch)


@lru_cache(maxsize=64)
def _faulhaber(k: int) -> tuple[Fraction, ...]:
    """Coefficients (by power) of sum_{d=1..n} d^k as a polynomial of n."""
    rows = [[Fraction(n) ** (j + 1) for j in range(k + 1)] + [Fraction(sum(d ** k for d in range(1, n + 1)))]
            for n in range(1, k + 2)]
    for c in range(k + 1):  # exact elimination
        rows[c] = [v / rows[c][c] for v in rows[c]]
        for r in range(k + 1):
            if r != c:
                rows[r] = [v - rows[r][c] * w for v, w in zip(rows[r], rows[c])]
    return (Fraction(0), *(r[-1] for r in rows))


def power_sum(lo: int, hi: int, k: int) -> int:
    """sum_{d=lo..hi} d^k, exactly (0 for an empty range)."""
    if hi < lo:
        return 0
    at = (lambda n: sum(c * n ** j for j, c in enumerate(_faulhaber(k))))
    return int(at(hi) - at(lo - 1))


@lru_cache(maxsize=256)
def savgol_poly(window: int, polyorder: int) -> tuple[int, int, float, np.ndarray]:
    """(left, right, shift, c): the weight of offset d in -left..right is
    sum_k c[k] ((d - shift) / right)^k."""
    if window <= polyorder:
        raise ValueError(f"a window of {window} samples cannot carry a fit of order {polyorder}")
    left, right = (window - 1) // 2, window // 2
    h = max(right, 1)
    twice = 0 if window % 2 else 1  # 2 * shift
    def moment(k):
        total = sum(Fraction(math.comb(k, j)) * 2 ** j * (-twice) ** (k - j) * power_sum(-left, right, j)
                    for j in range(k + 1))
        return float(total / Fraction(2 * h) ** k)
    m = np.array([[moment(a + b) for b in range(polyorder + 1)] for a in range(polyorder + 1)])
    return left, right, twice / 2, np.linalg.solve(m, np.eye(polyorder + 1)[0])


def _combine(q: np.ndarray, sigma: np.ndarray, c: np.ndarray) -> np.ndarray:
    """sum_k c_k sum_j (tau_j - sigma_i)^k y_j from moments q[r, i] = sum_j tau_j^r y_j."""
    out = np.zeros(len(sigma))
    for k in range(len(c)):
        term = sum(math.comb(k, r) * (-sigma) ** (k - r) * q[r] for r in range(k + 1))
        out += c[k] * term
    return out


def _band(y: np.ndarray, start: int, centre: int, h: int, order: int) -> np.ndarray:
    """Running moments [order + 1, len + 1] of samples start, start + 1, ..."""
    tau = (np.arange(start, start + len(y)) - centre) / h
    terms = np.stack([tau ** r * y for r in range(order + 1)])
    return np.concatenate([np.zeros((order + 1, 1)), np.cumsum(terms, axis=1)], axis=1)


def savgol_ends(a: int, e: int, w: int, p: int, left: np.ndarray, left_at: int, right: np.ndarray, right_at: int,
                middle: np.ndarray) -> np.ndarray:
    """Outputs a..e.  ``left`` holds the samples from ``left_at`` <= a - hl up
    to the first that every window has, ``right`` those from ``right_at`` (the
    sample after the last that every window has) up to e + hr at least,
    ``middle`` the moments of those between about centre (a + e) // 2."""
    hl, hr, shift, c = savgol_poly(w, p)
    h, centre = max(hr, 1), (a + e) // 2
    i = np.arange(a, e + 1)
    lead, tail = _band(left, left_at, centre, h, p), _band(right, right_at, centre, h, p)
    q = middle[:, None] + (lead[:, -1:] - lead[:, i - hl - left_at]) + tail[:, i + hr + 1 - right_at]
    return _combine(q, (i + shift - centre) / h, c)


def savgol_run(y: np.ndarray, at: int, a: int, e: int, w: int, p: int) -> np.ndarray:
    """Outputs a..e from the contiguous samples ``y`` that begin at ``at`` and
    cover every window."""
    hl, hr, _, _ = savgol_poly(w, p)
    if w <= 64:
        return np.correlate(y[a - hl - at:e + hr + 1 - at], savgol_coeffs(w, p), mode="valid")
    out, h = [], max(hr, 1)
    for s in range(a, e + 1, max(hl, 1)):
        t = min(s + max(hl, 1) - 1, e)
        m0, m1 = t - hl, s + hr  # common to all windows of s..t
        tau = (np.arange(m0, m1 + 1) - (s + t) // 2) / h
        mid = np.array([(tau ** r * y[m0 - at:m1 + 1 - at]).sum() for r in range(p + 1)])
        out.append(savgol_ends(s, t, w, p, y[s - hl - at:m0 - at], s - hl, y[m1 + 1 - at:t + hr + 1 - at], m1 + 1, mid))
    return np.concatenate(out)


def _reach(a: int, e: int, hl: int, hr: int, size: int) -> tuple[int, int]:
    """Whole blocks m0..m1 (nominal) that lie in every window of a..e."""
    return -(-(e - hl) // size), (a + hr + 1) // size - 1


# Moments of stretches of whole blocks: level 0 has one row per block, every
# further level one per FAN rows of the level below, each about its own centre
# and in units of its own length.  A window's whole blocks are a few nodes of
# every level, so the work per output block grows with the logarithm of the
# window, and no task needs a trace's blocks together.

FAN = 8
NODE = "project string, version int, trace string, level int, node bigint, p int, bad bigint, moments array<double>"


def _shifted(moments: np.ndarray, unit: float, to: float, by: float) -> np.ndarray:
    """Moments in units of ``unit`` as moments in units of ``to`` about a
    centre ``by`` samples lower."""
    p = len(moments) - 1
    return np.array([sum(math.comb(q, k) * (unit / to) ** k * (by / to) ** (q - k) * moments[k] for k in range(q + 1))
                     for q in range(p + 1)])


def _centre(level: int, node: int, size: int) -> int:
    return node * size * FAN ** level + size * FAN ** level // 2


def _block_node(r: dict, size: int) -> dict:
    y = r["y"].astype(float)
    nan = np.isnan(y)
    u, z = (np.arange(len(y)) - size // 2) / size, np.where(nan, 0.0, y)
    return {**{c: r[c] for c in KEY}, "level": 0, "node": r["block"], "p": r["p"], "bad": int(nan.sum()),
            "moments": [float((u ** k * z).sum()) for k in range(r["p"] + 1)]}


def _parent(rows: list[dict], size: int) -> dict:
    level, node = rows[0]["level"] + 1, rows[0]["parent"]
    unit, to = size * FAN ** (level - 1), size * FAN ** level
    total = sum(_shifted(r["moments"], unit, to, _centre(level - 1, r["node"], size) - _centre(level, node, size)) for r in rows)
    return {**{c: rows[0][c] for c in [*KEY, "p"]}, "level": level, "node": node, "bad": sum(r["bad"] for r in rows),
            "moments": total.tolist()}


def cover(lo: int, hi: int, top: int) -> list[tuple[int, int]]:
    """The nodes (level, node) of levels 0..top that make up blocks lo..hi."""
    out, end = [], hi + 1
    for level in range(top + 1):
        up, down = -(-lo // FAN), end // FAN
        if level == top or up >= down:
            return out + [(level, v) for v in range(lo, end)]
        out += [(level, v) for v in (*range(lo, up * FAN), *range(down * FAN, end))]
        lo, end = up, down
    return out


def _span(r: dict, size: int) -> tuple[int, int, int, int, int]:
    """(a, e, centre, m0, m1) of an output block: its samples, their centre,
    and the whole blocks that all its windows contain."""
    hl, hr, _, _ = savgol_poly(r["w"], r["p"])
    a = r["target"] * size
    e = min(a + size, r["n"]) - 1
    return a, e, (a + e) // 2, *_reach(a, e, hl, hr, size)


def _middles(data: DataFrame, plan: DataFrame, size: int, whole: int) -> DataFrame:
    """(KEY, target, mid, gone): moments about the target's centre, in units of
    its half window, and nulls of the whole blocks in all its windows.
    ``whole``: the largest number of such blocks."""
    top = 0
    while FAN ** (top + 1) <= whole:
        top += 1
    key = "project string, version int, trace string"
    wide = plan.select(*KEY, "p").where("target = 0")
    level = _saved(blocks.map_rows(data.select(*KEY, "block", "y").join(bounded_broadcast(wide), KEY),
                                   lambda r: [_block_node(r, size)], NODE), "savgol-moments")
    levels = [level]
    for _ in range(top):
        up = level.withColumn("parent", F.floor(F.col("node") / FAN).cast("bigint"))
        level = _saved(blocks.map_groups(up, [*KEY, "parent"], "node", lambda rows: [_parent(rows, size)], NODE), "savgol-moments")
        levels.append(level)

    def wanted(r):
        a, e, centre, m0, m1 = _span(r, size)
        own = (r["n"] - 1) // size
        for k, v in cover(max(m0, 0), min(m1, own), top) if m1 >= m0 and m0 <= own and m1 >= 0 else ():
            yield {**{c: r[c] for c in KEY}, "target": r["target"], "centre": centre, "h": max(r["w"] // 2, 1), "level": k, "node": v}

    asked = blocks.map_rows(plan.select(*KEY, "target", "w", "p", "n"), wanted,
                            f"{key}, target bigint, centre bigint, h bigint, level int, node bigint")
    nodes = reduce(DataFrame.unionByName, levels).drop("p")

    def add(rows):
        total = sum(_shifted(r["moments"], size * FAN ** r["level"], r["h"], _centre(r["level"], r["node"], size) - r["centre"])
                    for r in rows)
        return [{**{c: rows[0][c] for c in [*KEY, "target"]}, "mid": total.tolist(), "gone": sum(r["bad"] for r in rows)}]

    out = _saved(blocks.map_groups(asked.join(nodes, [*KEY, "level", "node"]), [*KEY, "target"], "node", add,
                                   f"{key}, target bigint, mid array<double>, gone bigint"), "savgol-middles")
    _dropped(*levels)
    return out


def _savgol_block(rows: list[dict], size: int) -> list[dict]:
    """Outputs of one block from the pieces shipped to it."""
    r = next(r for r in rows if r["block"] == r["target"])
    w, p, n = r["w"], r["p"], r["n"]
    hl, hr, _, _ = savgol_poly(w, p)
    a, e, centre, m0, m1 = _span(r, size)
    first, last = (np.nan if r[c] is None else r[c] for c in ("first", "last"))

    def span(lo: int, hi: int) -> np.ndarray:
        """Samples lo..hi, padded beyond the signal's ends."""
        v = np.empty(max(hi - lo + 1, 0))
        v[:max(min(-lo, len(v)), 0)] = first
        v[max(n - lo, 0):] = last
        for s in rows:
            x, y = max(lo, s["at"]), min(hi, s["at"] + len(s["piece"]) - 1)
            if y >= x:
                v[x - lo:y + 1 - lo] = s["piece"][x - s["at"]:y + 1 - s["at"]]
        return v

    if m1 < m0:
        y = span(a - hl, e + hr)
        nan = np.isnan(y)
        out = savgol_run(np.where(nan, 0.0, y), a - hl, a, e, w, p)
        if nan.any():
            count = np.concatenate([[0], np.cumsum(nan)])
            out[count[hl + hr + 1:] - count[:-(hl + hr + 1)] > 0] = np.nan
    else:
        h = max(hr, 1)
        mid, gone = (np.zeros(p + 1), 0) if r["mid"] is None else (np.array(r["mid"]), r["gone"])
        for value, x, y in ((first, m0 * size, min(-1, (m1 + 1) * size - 1)), (last, max(n, m0 * size), (m1 + 1) * size - 1)):
            if y >= x:  # padding that every window has
                gone += int(np.isnan(value))
                mid += [np.nan_to_num(value) * float(Fraction(power_sum(x - centre, y - centre, k), h ** k)) for k in range(p + 1)]
        lead, tail = span(a - hl, m0 * size - 1), span((m1 + 1) * size, e + hr)
        bad_l, bad_r = np.isnan(lead), np.isnan(tail)
        out = savgol_ends(a, e, w, p, np.where(bad_l, 0.0, lead), a - hl, np.where(bad_r, 0.0, tail), (m1 + 1) * size, mid)
        i = np.arange(a, e + 1)
        nl, nr = np.concatenate([[0], np.cumsum(bad_l)]), np.concatenate([[0], np.cumsum(bad_r)])
        out[(gone + nl[-1] - nl[i - hl - (a - hl)] + nr[i + hr + 1 - (m1 + 1) * size]) > 0] = np.nan
    return [{**{c: r[c] for c in KEY}, "block": r["target"], "x": r["x"], "y": out, "domain": r["domain"]}]


def _window_column(n):
    """:func:`savgol_window` of ``window_length`` for traces of ``n`` samples."""
    share = F.regexp_extract("window_length", r"^(.*?)\s*%$", 1)
    return F.when(share != "", (n * share.cast("double") / 100).cast("bigint")).otherwise(
        F.when(share == "", F.col("window_length")).cast("bigint"))


def savgol(sig: DataFrame, params: DataFrame, min_chunk: int = blocks.MIN_CHUNK) -> DataFrame:
    """L3 on every trace of ``sig`` that has a row in ``params``
    (project, trace, window_length STRING, polyorder INT); ``min_chunk``
    samples make a block.

    The blocks are written once (the input may be a computed trace).  Traces of
    one block are filtered where they lie.  Otherwise each sample travels to
    the blocks whose windows begin or end in its reach: once plus the window's
    share of a block for narrow windows, about four times for wide ones, never
    more; whole blocks within a window come as moments (:func:`_middles`).
    """
    size = int(min_chunk)
    prm = params.select("project", "trace", F.trim("window_length").alias("window_length"),
                        F.col("polyorder").cast("int").alias("p"))
    data = _saved(blocks.to_blocks(sig.join(prm, ["project", "trace"]), size, ["window_length", "p"]), "savgol-blocks")
    key = "project string, version int, trace string"
    schema = f"{key}, block bigint, x array<double>, y array<double>, domain string"
    done = (lambda df: blocks.from_blocks(df, size).select(
        "project", "version", "trace", "i", "x", F.nanvl("y", F.lit(None).cast("double")).alias("y"), "domain"))
    n, ends = F.size("y").cast("bigint"), (F.element_at("y", 1).alias("first"), F.element_at("y", -1).alias("last"))
    none = (F.lit(None).cast("array<double>").alias("mid"), F.lit(0).cast("bigint").alias("gone"))
    if not data.agg(F.max("block")).first()[0]:
        rows = data.withColumn("n", n).withColumn("w", _window_column(F.col("n"))).select(
            *KEY, "block", F.col("block").alias("target"), "w", "p", "n", *ends, *none, F.lit(0).cast("bigint").alias("at"),
            F.col("y").alias("piece"), "x", "domain")
        return done(blocks.map_rows(rows, lambda r: _savgol_block([r], size), schema))

    per_trace = data.select(*KEY, "block", "window_length", "p", n.alias("len"), *ends).groupBy(*KEY).agg(
        F.sum("len").alias("n"), F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("last"),
        F.first("window_length").alias("window_length"), F.first("p").alias("p"))
    per_trace = bounded_broadcast(_saved(per_trace.withColumn("w", _window_column(F.col("n"))).drop("window_length"),
                                         "savgol-traces"))
    plan = data.select(*KEY, F.col("block").alias("target")).join(per_trace, KEY)
    w, n, b = F.col("w"), F.col("n"), F.col("block")
    hl, hr = F.floor((w - 1) / 2), F.floor(w / 2)

    def reach(t):
        """Samples of block t, and the whole blocks in all its windows."""
        a = t * size
        e = F.least(a + size, n) - 1
        return a, e, F.ceil((e - hl) / size), F.floor((a + hr + 1) / size) - 1

    _, _, m0, m1 = reach(F.col("target"))
    whole = plan.agg(F.max(m1 - m0 + 1)).first()[0]
    if whole > 0:
        plan = plan.join(bounded_broadcast(_middles(data, plan, size, whole)), [*KEY, "target"], "left")
    else:
        plan = plan.select("*", *none)
    rows = data.select(*KEY, "block", "x", "y", "domain").join(per_trace.select(*KEY, "w", "n"), KEY)

    def ends_of(t):
        """Sample ranges that block t needs: (from, to) of its left and right part."""
        a, e, m0, m1 = reach(t)
        inner = m1 >= m0
        return (a - hl, F.when(inner, m0 * size - 1).otherwise(e + hr),
                F.when(inner, (m1 + 1) * size).otherwise(a - hl), e + hr)

    def wanted(t):
        lo, l1, r0, hi = ends_of(t)
        mine = (lambda x, y: (x <= b * size + size - 1) & (y >= b * size))
        return (t == b) | mine(lo, l1) | mine(r0, hi)

    # the blocks whose moving ends reach this one: around it, and a half window away on either side
    top, near = F.ceil(n / size) - 1, 2
    far_l, far_r = F.floor((b * size - hr) / size), F.floor((b * size + size - 1 + hl) / size)
    around = F.flatten(F.array(*(F.sequence(c - near, c + near) for c in (b, far_l, far_r))))
    targets = F.filter(F.array_distinct(around), lambda t: (t >= 0) & (t <= top) & wanted(t))
    rows = rows.withColumn("target", F.explode(targets))
    # only the part of the block that the target's windows end in
    lo, l1, r0, hi = ends_of(F.col("target"))
    left = (lo <= b * size + size - 1) & (l1 >= b * size)
    right = (r0 <= b * size + size - 1) & (hi >= b * size)
    frm = F.greatest(b * size, F.when(left, lo).otherwise(r0))
    to = F.least(b * size + size - 1, F.when(right, hi).otherwise(l1))
    need = left | right
    rows = rows.withColumn("at", F.when(need, frm).otherwise(b * size)).withColumn(
        "piece", F.when(need, F.slice("y", (frm - b * size + 1).cast("int"), F.greatest(to - frm + 1, F.lit(0)).cast("int")))
        .otherwise(F.array().cast("array<double>")))
    own = F.col("target") == b
    rows = rows.select(*KEY, "target", "block", "at", "piece", "domain", F.when(own, F.col("x")).alias("x"))
    rows = rows.join(bounded_broadcast(_saved(plan, "savgol-plan")), [*KEY, "target"])
    return done(blocks.map_groups(rows, [*KEY, "target"], "block", lambda rs: _savgol_block(rs, size), schema))


def savgol_reference(y: np.ndarray, window: int, polyorder: int) -> np.ndarray:
    """Whole-signal numpy version ("nearest" edges), for tests and checks."""
    off = savgol_offsets(window)
    coef = savgol_coeffs(window, polyorder)
    ext = np.concatenate([np.full(-off[0], y[0]), y, np.full(off[-1], y[-1])])
    return np.correlate(ext, coef, mode="valid")


# --------------------------------------------------------------------------
# Butterworth low-pass, zero phase

def normalized_cutoff(cutoff: str, implied_dt: float, dt_unit: str) -> float:
    """Wn = fc / (fs / 2); must lie in (0, 1)."""
    fs = sampling_rate_hz(implied_dt, dt_unit)
    w = frequency_hz(cutoff) / (fs / 2)
    if not 0 < w < 1:
        raise ValueError(f"cutoff {cutoff} lies outside (0, fs / 2) at fs = {fs} Hz")
    return w


@lru_cache(maxsize=64)
def butter_sos(wn: float, order: int = BUTTER_ORDER) -> np.ndarray:
    """Digital Butterworth low-pass as second-order sections (rows b0 b1 b2
    a0 a1 a2), each with unit DC gain: analogue poles on the unit circle,
    pre-warped bilinear transform (fs = 2), zeros at z = -1."""
    if order % 2:
        raise ValueError("even order only")
    warped = 4.0 * math.tan(math.pi * wn / 2.0)
    k = np.arange(1, order // 2 + 1)
    poles = warped * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    zp = (4.0 + poles) / (4.0 - poles)
    sos = []
    for z in zp:
        a = np.array([1.0, -2.0 * z.real, abs(z) ** 2])
        b = np.array([1.0, 2.0, 1.0]) * (a.sum() / 4.0)
        sos.append(np.concatenate([b, a]))
    return np.array(sos)


@lru_cache(maxsize=64)
def state_space(wn: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The cascade as one linear system: state' = A state + B u, y = C state + D u
    (two numbers of state for each section)."""
    sos = butter_sos(wn)
    n = 2 * len(sos)

    def step(z, u):
        out = np.empty(n)
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            y = b0 * u + z[2 * k]
            out[2 * k] = b1 * u - a1 * y + z[2 * k + 1]
            out[2 * k + 1] = b2 * u - a2 * y
            u = y
        return out, u

    unit = [step(e, 0.0) for e in np.eye(n)]
    b, d = step(np.zeros(n), 1.0)
    return np.stack([s for s, _ in unit], axis=1), b, np.array([y for _, y in unit]), d


def steady_state(wn: float, u: float) -> np.ndarray:
    """State after an endless constant input ``u`` (unit DC gain)."""
    return np.concatenate([[u * (b1 + b2 - a1 - a2), u * (b2 - a2)] for _, b1, b2, _, a1, a2 in butter_sos(wn)])


RUN = 128  # samples of the dense inner step


@lru_cache(maxsize=16)
def _dense(wn: float):
    """For a run of ``RUN`` samples: response matrix, output and state by
    initial state, final state by input, powers of A."""
    a, b, c, d = state_space(wn)
    powers = [np.eye(len(b))]
    for _ in range(RUN):
        powers.append(a @ powers[-1])
    h = np.array([d, *(c @ powers[k] @ b for k in range(RUN - 1))])
    toeplitz = np.zeros((RUN, RUN))
    for k in range(RUN):
        toeplitz[k, :k + 1] = h[k::-1]
    free = np.stack([c @ powers[k] for k in range(RUN)])             # [RUN, state]
    into = np.stack([powers[RUN - 1 - k] @ b for k in range(RUN)])   # [RUN, state]
    return toeplitz, free, into, powers


def filter_block(u: np.ndarray, state: np.ndarray, wn: float) -> tuple[np.ndarray, np.ndarray]:
    """(output, final state) of the recurrence over ``u`` from ``state``."""
    toeplitz, free, into, powers = _dense(wn)
    full = len(u) // RUN
    rows = u[:full * RUN].reshape(full, RUN)
    gain = rows @ into
    states = np.empty((full + 1, len(state)))
    states[0] = state
    for k in range(full):
        states[k + 1] = powers[RUN] @ states[k] + gain[k]
    out = (rows @ toeplitz.T + states[:full] @ free.T).ravel()
    rest = u[full * RUN:]
    m = len(rest)
    if m:
        out = np.concatenate([out, toeplitz[:m, :m] @ rest + free[:m] @ states[full]])
        return out, powers[m] @ states[full] + rest @ into[RUN - m:]
    return out, states[full]


def final_state(u: np.ndarray, wn: float) -> np.ndarray:
    """The state that ``u`` leaves from zero state (no output is computed)."""
    _, _, into, powers = _dense(wn)
    full = len(u) // RUN
    state = np.zeros(into.shape[1])
    for gain in u[:full * RUN].reshape(full, RUN) @ into:
        state = powers[RUN] @ state + gain
    rest = u[full * RUN:]
    return powers[len(rest)] @ state + rest @ into[RUN - len(rest):] if len(rest) else state


@lru_cache(maxsize=64)
def carry(wn: float, n: int) -> np.ndarray:
    """What ``n`` samples of zero input make of a state."""
    return np.linalg.matrix_power(state_space(wn)[0], n)


# A block turns the state that enters it into A^len state + end: an affine map,
# and so is a stretch of blocks.  States are handed along a trace by a scan
# over these maps: stretches of SEGMENT blocks become one row each, and so on
# until a trace is one row; then each row hands its entry state to its parts.

SEGMENT = 512
KEEP = FILTFILT_PADLEN + 1
STRETCH = ("project string, version int, trace string, block bigint, wn double, len bigint, bad boolean, "
           "end array<double>, start array<double>, tail array<double>")
ENTRY = "project string, version int, trace string, block bigint, state array<double>, back array<double>"


def _order(rows: list[dict], back: bool) -> list[dict]:
    return sorted(rows, key=lambda r: -r["block"] if back else r["block"])


def _stretch(rows: list[dict], back: bool) -> dict:
    """The map of consecutive rows as one row: its length, whether it holds a
    null, the state it leaves from zero state, the trace's start state if the
    rows have it, and its last samples."""
    rows, wn = _order(rows, back), rows[0]["wn"]
    bad, end = any(r["bad"] for r in rows), np.zeros(2 * len(butter_sos(wn)))
    if not bad:
        for r in rows:
            end = carry(wn, r["len"]) @ end + r["end"]
    start = next((r["start"] for r in rows if r["start"] is not None), None)
    tail = [] if back else np.concatenate([r["tail"] for r in rows[-KEEP:]])[-KEEP:]
    return {**{c: rows[0][c] for c in KEY}, "wn": wn, "len": sum(r["len"] for r in rows), "bad": bad,
            "end": end.tolist(), "start": start, "tail": tail}


def _turn(trace: dict) -> list[float] | None:
    """The state in which the backward pass enters the last block, from the
    whole trace as one stretch (null: a null sample)."""
    wn, n = trace["wn"], trace["len"]
    if n <= FILTFILT_PADLEN:
        raise ValueError(f"trace {trace['trace']!r}: the low-pass needs more than {FILTFILT_PADLEN} samples, got {n}")
    if trace["bad"]:
        return None
    tail = np.asarray(trace["tail"])
    beyond, _ = filter_block(2 * tail[-1] - tail[-2::-1], carry(wn, n) @ np.asarray(trace["start"]) + trace["end"], wn)
    return filter_block(beyond[::-1], steady_state(wn, beyond[-1]), wn)[1].tolist()


def _spread(rows: list[dict], state, back: bool) -> list[dict]:
    """The entry state of each of consecutive rows (null where the trace has a
    null sample)."""
    out = []
    for r in _order(rows, back):
        out.append({**{c: r[c] for c in KEY}, "block": r["block"], "state": None if state is None else np.asarray(state).tolist()})
        if state is not None:
            state = carry(r["wn"], r["len"]) @ np.asarray(state) + r["end"]
    return out


def _whole(rows: list[dict], back: bool) -> list[dict]:
    """The scan of a trace of at most a segment's blocks."""
    trace = _stretch(rows, back)
    turn = None if back else _turn(trace)
    return [{**o, "back": turn} for o in _spread(rows, None if trace["bad"] else trace["start"], back)]


def scan_states(first: DataFrame, back: bool, largest: int, segment: int = SEGMENT) -> DataFrame:
    """ENTRY rows of the blocks in ``first`` (STRETCH rows; ``largest``: the
    highest block number): the state that enters each block, and (forward) the
    state that the backward pass starts with.  No task has more than
    ``segment`` rows of a trace."""
    if largest < segment:
        return _saved(blocks.map_groups(first, KEY, "block", lambda rows: _whole(rows, back), ENTRY), "lowpass-states")
    levels = [_saved(first, "lowpass-level")]
    own = F.floor(F.col("block") / segment).cast("bigint")
    while largest:
        up = blocks.map_groups(levels[-1].withColumn("part", own), [*KEY, "part"], "block",
                               lambda rows: [{**_stretch(rows, back), "block": rows[0]["part"]}], STRETCH)
        levels.append(_saved(up, "lowpass-level"))
        largest //= segment
    entry = _saved(blocks.map_rows(levels[-1], lambda r: [{
        **{c: r[c] for c in KEY}, "block": 0, "state": None if r["bad"] else r["start"], "back": None if back else _turn(r)}],
        ENTRY), "lowpass-states")
    for level in reversed(levels[:-1]):
        above = bounded_broadcast(entry.withColumnRenamed("block", "part"))
        rows = level.drop("start", "tail").withColumn("part", own).join(above, [*KEY, "part"])
        below = _saved(blocks.map_groups(rows, [*KEY, "part"], "block", lambda rs: [
            {**o, "back": rs[0]["back"]} for o in _spread(rs, rs[0]["state"], back)], ENTRY), "lowpass-states")
        _dropped(entry, level)
        entry = below
    _dropped(levels[-1])
    return entry


def _forward(r: dict) -> dict:
    """A block's map in the forward pass; the first block knows the start."""
    y, wn = r["y"].astype(float), r["wn"]
    bad, start = bool(np.isnan(y).any()), None
    if r["block"] == 0 and not bad and len(y) > FILTFILT_PADLEN:
        left = 2 * y[0] - y[FILTFILT_PADLEN:0:-1]
        start = filter_block(left, steady_state(wn, left[0]), wn)[1].tolist()
    return {**{c: r[c] for c in [*KEY, "block", "wn"]}, "len": len(y), "bad": bad, "start": start,
            "tail": y[-KEEP:].tolist(), "end": None if bad else final_state(y, wn).tolist()}


def _filtfilt(r: dict) -> np.ndarray:
    """A trace that is one block, both ways."""
    trace = _forward(r)
    back = _turn(trace)
    if back is None:
        return np.full(trace["len"], np.nan)
    out = filter_block(r["y"].astype(float), np.asarray(trace["start"]), r["wn"])[0]
    return filter_block(out[::-1], np.asarray(back), r["wn"])[0][::-1]


def lowpass_by(sig: DataFrame, params: DataFrame, min_chunk: int = blocks.MIN_CHUNK,
               segment: int = SEGMENT) -> DataFrame:
    """L1/L2 on every trace of ``sig`` with a row in ``params`` (project, trace,
    wn): all traces and cutoffs in one pass.

    The blocks are written once.  Where every trace is one block, that is
    filtered where it lies.  Otherwise two passes over their values give each
    block's map, forward and backward (only rows of some dozen numbers leave
    them); the last pass filters a block both ways from its true states, and
    only there x comes along."""
    size = max(int(min_chunk), KEEP)
    key = "project string, version int, trace string, block bigint"
    data = _saved(blocks.to_blocks(sig.join(params.select("project", "trace", "wn"), ["project", "trace"]), size, ["wn"]),
                  "lowpass-blocks")
    largest = data.agg(F.max("block")).first()[0] or 0

    out_schema = f"{key}, domain string, x array<double>, y array<double>"
    done = (lambda df: blocks.from_blocks(df, size).select(
        "project", "version", "trace", "i", "x", F.nanvl("y", F.lit(None).cast("double")).alias("y"), "domain"))
    if not largest:
        return done(blocks.map_rows(data, lambda r: [{**{c: r[c] for c in [*KEY, "block", "domain", "x"]}, "y": _filtfilt(r)}],
                                    out_schema))

    entry = scan_states(blocks.map_rows(data.select(*KEY, "block", "wn", "y"), lambda r: [_forward(r)], STRETCH), False, largest, segment)

    def backward(r):
        bad, end = r["state"] is None, None
        if not bad:
            end = final_state(filter_block(r["y"].astype(float), r["state"], r["wn"])[0][::-1], r["wn"]).tolist()
        yield {**{c: r[c] for c in [*KEY, "block", "wn"]}, "len": len(r["y"]), "bad": bad,
               "start": None if bad else r["back"].tolist(), "tail": [], "end": end}

    turned = blocks.map_rows(data.select(*KEY, "block", "wn", "y").join(bounded_broadcast(entry), [*KEY, "block"]),
                             backward, STRETCH)
    again = scan_states(turned, True, largest, segment)
    states = _saved(entry.drop("back").join(again.select(*KEY, "block", F.col("state").alias("back")), [*KEY, "block"]),
                    "lowpass-states")
    _dropped(entry, again)

    def both(r):
        y = np.full(len(r["y"]), np.nan)
        if r["state"] is not None:
            out = filter_block(r["y"].astype(float), r["state"], r["wn"])[0]
            y = filter_block(out[::-1], r["back"], r["wn"])[0][::-1]
        yield {**{c: r[c] for c in [*KEY, "block", "domain"]}, "x": r["x"], "y": y}

    return done(blocks.map_rows(data.join(bounded_broadcast(states), [*KEY, "block"]), both, out_schema))


def lowpass(sig: DataFrame, cutoff: str, implied_dt: float, dt_unit: str,
            out_trace: str | None = None, min_chunk: int = blocks.MIN_CHUNK) -> DataFrame:
    """L1/L2: order-10 Butterworth, zero phase, on every trace of ``sig``;
    x unchanged.  Traces of 33 samples or fewer raise.  ``out_trace`` renames
    the output (derivative trace); None keeps the names (overlay)."""
    wn = normalized_cutoff(cutoff, implied_dt, dt_unit)
    out = lowpass_by(sig, sig.select("project", "trace").distinct().withColumn("wn", F.lit(wn)), min_chunk)
    return out if out_trace is None else out.withColumn("trace", F.lit(out_trace))


def filtfilt_reference(x: np.ndarray, wn: float, padlen: int = FILTFILT_PADLEN) -> np.ndarray:
    """Sample-by-sample cascade with steady-state initial conditions (the
    textbook filtfilt), for tests: independent of the FFT path above."""
    sos = butter_sos(wn)

    def run(sig):
        out = sig.astype(float).copy()
        for b0, b1, b2, a0, a1, a2 in sos:
            u0 = out[0]
            # steady state for constant input u0 (unit DC gain): y = u0
            z1 = u0 * (b1 + b2) - u0 * (a1 + a2)  # transposed direct form II
            z2 = b2 * u0 - a2 * u0
            z1, z2 = z1, z2
            res = np.empty_like(out)
            for k, v in enumerate(out):
                yk = b0 * v + z1
                z1 = b1 * v - a1 * yk + z2
                z2 = b2 * v - a2 * yk
                res[k] = yk
            out = res
        return out
    ext = np.concatenate([2 * x[0] - x[padlen:0:-1], x, 2 * x[-1] - x[-2:-padlen - 2:-1]])
    yf = run(ext)
    yb = run(yf[::-1])[::-1]
    return yb[padlen:-padlen]


# --------------------------------------------------------------------------
# L4: overlay dispatch

def overlay(sig: DataFrame, registry: DataFrame, projects: DataFrame) -> DataFrame:
    """L4: apply each trace's configured overlay -> (project, version, trace,
    i, x, y_overlay, filter).  Unknown or "None" filters yield no rows.  All
    Savitzky-Golay traces are one pass and all low-pass traces another: window
    and cutoff are columns, not plan branches."""
    reg = registry.select("project", "trace", "overlay")
    sg = (reg.where(F.col("overlay.filter_name") == SAVGOL_NAME)
          .select("project", "trace",
                  F.coalesce("overlay.window_length", F.lit(SAVGOL_DEFAULT_WINDOW)).alias("window_length"),
                  F.coalesce("overlay.polyorder", F.lit(SAVGOL_DEFAULT_POLYORDER)).alias("polyorder")))
    fc = units.frequency_as(units.parse_frequency(F.coalesce("overlay.frequency", F.lit(LOWPASS_DEFAULT_CUTOFF))), "Hz")
    lp = (reg.where(F.col("overlay.filter_name") == LOWPASS_NAME)
          .join(projects.select("project", "implied_dt", "dt_unit"), "project")
          .select("project", "trace", units.normalized_cutoff(fc, F.col("implied_dt"), F.col("dt_unit")).alias("wn")))

    def shown(df: DataFrame, name: str) -> DataFrame:
        return df.select(*KEY, "i", "x", F.col("y").alias("y_overlay"), F.lit(name).alias("filter"))

    parts = []
    if sg.limit(1).count():
        parts.append(shown(savgol(sig, sg), SAVGOL_NAME))
    if lp.limit(1).count():
        # the step of a spectrum is not a time step: a low-pass overlay on a
        # FREQUENCY trace is refused (Savitzky-Golay stays allowed)
        src = sig.withColumn("y", F.when(F.col("domain") == "FREQUENCY", F.raise_error(F.concat(
            F.lit("a low-pass overlay needs a trace over time: "), F.col("trace")))).otherwise(F.col("y")))
        parts.append(shown(lowpass_by(src, lp), LOWPASS_NAME))
    if not parts:
        return shown(sig.limit(0), NONE_NAME)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
