import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.functions import units as U
from wavespark.operators import filters, pointwise, spectrum, stats

SIG = "project string, version int, trace string, i long, x double, y double, domain string"


def _sig(spark, traces: dict, version=1, project="p"):
    rows = [(project, version, t, i, float(i), float(v), "TIME")
            for t, ys in traces.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, SIG)


def _ys(df, trace=None):
    if trace is not None:
        df = df.where(F.col("trace") == trace)
    return [r.y for r in df.orderBy("i").collect()]


def test_pointwise_shortest_wins_and_duplicates(spark):
    s = _sig(spark, {"a": [1, 2, 3, 4], "b": [10, 20, 30], "c": [2, 2, 2, 2, 2]})
    assert _ys(pointwise.add(s, ["a", "b", "c"])) == [13, 24, 35]
    assert _ys(pointwise.add(s, ["a", "a"])) == [2, 4, 6, 8]
    assert _ys(pointwise.multiply(s, ["a", "b", "c"])) == [20, 80, 180]
    assert _ys(pointwise.subtract(s, ["b", "a"])) == [9, 18, 27]
    assert _ys(pointwise.divide(s, ["b", "c"])) == [5, 10, 15]
    with pytest.raises(ValueError):
        pointwise.subtract(s, ["a", "b", "c"])
    with pytest.raises(ValueError):
        pointwise.divide(s, ["a"])


def test_divide_by_zero(spark):
    s = _sig(spark, {"a": [1, 2], "z": [1, 0]})
    with pytest.raises(Exception):
        pointwise.divide(s, ["a", "z"]).collect()
    assert _ys(pointwise.divide(s, ["a", "z"], on_zero="null")) == [1.0, None]


def test_stats_population_and_constant(spark):
    s = _sig(spark, {"a": [1, 2, 3, 4], "k": [5, 5, 5]})
    r = {x.trace: x for x in stats.trace_stats(s).collect()}
    assert r["a"]["min"] == 1 and r["a"]["max"] == 4 and r["a"]["range"] == 3
    assert r["a"]["mean"] == 2.5 and math.isclose(r["a"]["stdev"], np.std([1, 2, 3, 4]))
    assert r["k"]["stdev"] == 0.0
    with pytest.raises(RuntimeError):
        stats.check_stat_names(["median"])


def test_units(spark):
    df = spark.createDataFrame([(" 1.5 MHz ", "10 us", "2 ms")], "f string, d string, e string")
    q = df.select(U.parse_frequency(F.col("f")).alias("f"), U.parse_duration(F.col("d")).alias("d"),
                  U.parse_duration(F.col("e")).alias("e"))
    r = q.select(U.frequency_as("f", "Hz").alias("hz"), U.frequency_as("f", "khz").alias("khz"),
                 U.duration_as("d", "ns").alias("ns"), U.period_of(F.col("f")).alias("per"),
                 U.rate_of(F.col("d")).alias("rate"), U.add("d", "e", "duration").alias("sum"),
                 U.lt("d", "e", "duration").alias("lt"), U.eq("d", "d", "duration").alias("eq"),
                 U.format_quantity(F.col("f")).alias("txt"),
                 U.matching_time_unit(F.lit("GHz")).alias("m")).first()
    assert r.hz == 1.5e6 and math.isclose(r.khz, 1500.0)
    assert math.isclose(r.ns, 10000.0)
    assert (r.per.unit, math.isclose(r.per.value, 1 / 1.5)) == ("us", True)
    assert (r.rate.unit, r.rate.value) == ("MHz", 0.1)
    assert r.sum.unit == "us" and math.isclose(r.sum.value, 10 + 2 * 1e-3 / 1e-6)
    assert r.lt is True and r.eq is True and r.txt == "1.5 MHz" and r.m == "ns"
    with pytest.raises(Exception):
        spark.createDataFrame([("12 parsecs",)], "f string").select(U.parse_frequency(F.col("f"))).collect()
    assert filters.normalized_cutoff("100 Hz", 0.5, "ms") == 0.1
    with pytest.raises(ValueError):
        filters.normalized_cutoff("2 KHz", 0.5, "ms")


def test_savgol_chunk_invariance_and_polynomials(spark):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=5000))
    s = _sig(spark, {"w": y})
    for win in ("11", "10", "3%"):
        prm = spark.createDataFrame([("p", "w", win, 2)], "project string, trace string, window_length string, "
                                                          "polyorder int")
        got = np.array(_ys(filters.savgol(s, prm, min_chunk=300)))
        w = filters.savgol_window(win, len(y))
        ref = filters.savgol_reference(y, w, 2)
        assert np.abs(got - ref).max() < 1e-9
    # a quadratic is reproduced away from the edges (odd window)
    q = np.arange(100.0) ** 2 / 7.0
    out = filters.savgol_reference(q, 9, 2)
    assert np.abs(out[5:-5] - q[5:-5]).max() < 1e-9
    with pytest.raises(ValueError):
        filters.savgol_coeffs(2, 2)


def test_lowpass_chunked_equals_whole_signal_recurrence(spark):
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=8000))
    s = _sig(spark, {"w": y})
    got = np.array(_ys(filters.lowpass(s, "100 Hz", 0.5, "ms", min_chunk=1000)))
    ref = filters.filtfilt_reference(y, 0.1)
    assert np.abs(got - ref).max() < 1e-9
    # a constant stays constant; a short trace raises
    c = np.array(_ys(filters.lowpass(_sig(spark, {"k": [3.0] * 50}), "100 Hz", 0.5, "ms")))
    assert np.abs(c - 3.0).max() < 1e-9
    with pytest.raises(Exception):
        filters.lowpass(_sig(spark, {"k": [1.0] * 33}), "100 Hz", 0.5, "ms").collect()


def test_spectrum_peak_constant_and_four_step(spark):
    n = 64
    t = np.arange(n)
    sine = np.sin(2 * np.pi * 5 * t / n)
    s = _sig(spark, {"sine": sine, "const": [2.0] * n, "tiny": [1.0, 2.0, 3.0]})
    out = spectrum.spectrum(s, 1.0, "ms", display_unit="Hz")
    sp = out.where("trace = 'sine'").orderBy("i").collect()
    assert len(sp) == 31
    peak = max(sp, key=lambda r: r.y)
    assert math.isclose(peak.x, 5 * 1000.0 / n) and peak.y > 0.99
    assert all(math.isnan(r.y) for r in out.where("trace = 'const'").collect())
    assert out.where("trace = 'tiny'").count() == 0
    four = spectrum.spectrum(s.where("trace = 'sine'"), 1.0, "ms", display_unit="Hz", max_single=8)
    a = np.array([r.y for r in four.orderBy("i").collect()])
    b = np.array([r.y for r in sp])
    assert np.abs(a - b).max() < 1e-12
    assert spectrum.split_factor(10007) == 1 and spectrum.split_factor(64) == 8


def test_two_significant_matches_python(spark):
    vals = [1234.5, 0.0012345, 0.00012345, 1.2345e-05, 98765432.1, 1.5e17, -0.5, 7.0, 0.0, 99.9, 1e-4, 5e-7, 3e-250]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(stats.two_significant("v")).collect()]
    assert got == [repr(float(f"{v:.2g}")) for v in vals]


def test_py_repr_matches_python(spark):
    vals = [1.5, 0.5, 1234.5678, 12345678.9, 1e7, 0.00012, 1.2e-05, 1e-05, 1e16, 1.5e17, 123456789012345.6,
            -3.25, 0.001, 100.0, 2e-300, 6.02e23, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(U.py_repr(F.col("v"))).collect()]
    assert got == [repr(v) for v in vals]


def test_long_traces_four_step_and_bluestein(spark):
    rng = np.random.default_rng(11)
    lengths = {"prime": 1009, "two_prime": 1018, "pow2": 1024, "mixed": 700}
    data = {k: rng.normal(size=n) for k, n in lengths.items()}
    s = _sig(spark, data)
    out = spectrum.spectrum(s, 1.0, "ms", display_unit="Hz", max_single=64)
    got = {t: np.array([r.y for r in out.where(F.col("trace") == t).orderBy("i").collect()]) for t in lengths}
    for t, y in data.items():
        x_ref, ref = spectrum.spectrum_values(y, spectrum.bin_width(1.0, "ms", len(y), "Hz"))
        assert len(got[t]) == len(ref), t
        assert np.abs(got[t] - ref).max() < 1e-12, t


def test_savgol_windows_wider_than_blocks(spark):
    rng = np.random.default_rng(9)
    ys = {"w": np.cumsum(rng.normal(size=4000)), "v": rng.normal(size=333) + 50.0}
    s = _sig(spark, ys)
    for win, p in (("3%", 2), ("10%", 3), ("500", 2), ("4%", 0)):
        prm = spark.createDataFrame([("p", t, win, p) for t in ys],
                                    "project string, trace string, window_length string, polyorder int")
        out = filters.savgol(s, prm, min_chunk=128)
        for t, y in ys.items():
            got = np.array(_ys(out, t))
            ref = filters.savgol_reference(y, filters.savgol_window(win, len(y)), p)
            assert len(got) == len(ref)
            assert np.abs(got - ref).max() <= 1e-10 * max(1.0, np.abs(ref).max()), (win, p, t)


def test_lowpass_overlay_refuses_frequency_domain(spark):
    from wavespark import schemas
    rows = [("p", 1, "f", i, float(i), float(i % 5), "FREQUENCY") for i in range(64)]
    s = spark.createDataFrame(rows, SIG)
    reg = spark.createDataFrame([("p", "f", "f", "Active", 1.0, 0.0, ("Lowpass", "100 Hz", None, None), [], None, 0)],
                                schemas.REGISTRY)
    prj = spark.createDataFrame([("p", 0.5, "ms", "")], schemas.PROJECTS)
    with pytest.raises(Exception):
        filters.overlay(s, reg, prj).collect()
    reg2 = spark.createDataFrame([("p", "f", "f", "Active", 1.0, 0.0, ("Savitzky–Golay", None, "5", 2), [], None, 0)],
                                 schemas.REGISTRY)
    assert filters.overlay(s, reg2, prj).count() == 64


def test_x_unit(spark):
    from wavespark import schemas
    from wavespark.operators.signal import with_x_unit
    df = spark.createDataFrame([("p", 1, "a", 0, 0.0, 1.0, "TIME"), ("p", 1, "s", 0, 5.0, 0.1, "FREQUENCY")], SIG)
    reg = spark.createDataFrame(
        [("p", "a", "a", "Active", 1.0, 0.0, None, [], None, 0),
         ("p", "s", "s", "Active", 1.0, 0.0, None, [],
          ("fourier_transform", {"display_frequency_unit": "KHz"}, ["a"]), 1)], schemas.REGISTRY)
    prj = spark.createDataFrame([("p", 0.5, "us", "")], schemas.PROJECTS)
    got = {r.trace: r.x_unit for r in with_x_unit(df, reg, prj).collect()}
    assert got == {"a": "us", "s": "KHz"}


def test_version_helpers(spark):
    from wavespark.operators import compare
    cap = spark.createDataFrame([("p", 1, 0), ("p", 2, 1), ("p", 3, 0), ("q", 1, 0)],
                                "project string, version int, t0_index long")
    assert compare.latest_and_previous(None, cap, "p") == (3, 2)
    with pytest.raises(ValueError):
        compare.latest_and_previous(None, cap, "q")
    vl = {(r.project, r.version): r.rank for r in compare.version_list(cap).collect()}
    assert vl[("p", 3)] == 1 and vl[("p", 1)] == 3 and vl[("q", 1)] == 1
    req = spark.createDataFrame([("p", -1), ("p", -3), ("p", -4), ("p", 0), ("p", 4), ("q", 1)],
                                "project string, requested int")
    got = {r.requested if r.project == "p" else 100: r.version for r in compare.resolve_versions(req, cap).collect()}
    assert got == {-1: 3, -3: 1, -4: None, 0: None, 4: None, 100: 1}
    s = spark.createDataFrame([("p", 1, "a", i, 0.0, float(i), "TIME") for i in range(4)]
                              + [("p", 2, "a", i, 0.0, float(10 * i), "TIME") for i in range(3)], SIG)
    out = {r.k: (r.y_a, r.y_b) for r in compare.compare_versions(s, cap, 1, 2).collect()}
    # version 2 has its trigger at 1: k = i - 1, a full outer join keeps both ends
    assert out[-1] == (None, 0.0) and out[0] == (0.0, 10.0) and out[3] == (3.0, None)


def test_savgol_many_blocks_wide_and_null(spark):
    """n / W = 2,000 and windows of many blocks stay at round-off; a null
    sample reaches exactly the windows that contain it."""
    rng = np.random.default_rng(4)
    y = rng.normal(size=60_000) + 5.0
    s = _sig(spark, {"w": y})
    for win, p, chunk in (("31", 2, 700), ("101", 2, 90), ("20001", 3, 512), ("30000", 5, 512)):
        prm = spark.createDataFrame([("p", "w", win, p)], "project string, trace string, window_length string, polyorder int")
        got = np.array(_ys(filters.savgol(s, prm, min_chunk=chunk)))
        assert np.abs(got - filters.savgol_reference(y, int(win), p)).max() < 1e-9, win
    z = [float(v) for v in y[:3000]]
    z[1500] = None
    rows = [("p", 1, "n", i, float(i), v, "TIME") for i, v in enumerate(z)]
    d = spark.createDataFrame(rows, SIG)
    for win, chunk in (("11", 64), ("601", 64), ("601", 5000)):
        prm = spark.createDataFrame([("p", "n", win, 2)], "project string, trace string, window_length string, polyorder int")
        got = _ys(filters.savgol(d, prm, min_chunk=chunk))
        h = int(win) // 2
        assert [i for i, v in enumerate(got) if v is None] == list(range(1500 - h, 1500 + h + 1))


def test_lowpass_very_low_cutoff_and_null(spark):
    rng = np.random.default_rng(6)
    y = np.cumsum(rng.normal(size=6000))
    s = _sig(spark, {"w": y, "v": y[::-1] * 2})
    prm = spark.createDataFrame([("p", "w", 1e-3), ("p", "v", 0.25)], "project string, trace string, wn double")
    for chunk in (100, 4096):
        out = filters.lowpass_by(s, prm, min_chunk=chunk)
        for t, wn, src in (("w", 1e-3, y), ("v", 0.25, y[::-1] * 2)):
            ref = filters.filtfilt_reference(src, wn)
            assert np.abs(np.array(_ys(out, t)) - ref).max() < 1e-8 * max(1.0, np.abs(ref).max()), (t, chunk)
    rows = [("p", 1, "n", i, float(i), None if i == 3000 else float(v), "TIME") for i, v in enumerate(y)]
    d = spark.createDataFrame(rows, SIG)
    for chunk in (500, 65536):
        got = _ys(filters.lowpass(d, "100 Hz", 0.5, "ms", min_chunk=chunk))
        assert got == [None] * len(y)


def test_lowpass_states_by_segments(spark):
    """Traces of 1 to 250 blocks in segments of 4 (up to four levels) give
    what one segment gives; a null keeps its trace out, a short one raises."""
    rng = np.random.default_rng(8)
    data = {f"t{n}": np.cumsum(rng.normal(size=n)) for n in (40, 41, 170, 1999, 10_000)}
    s = _sig(spark, data)
    prm = spark.createDataFrame([("p", t, 0.01 * (k + 1)) for k, t in enumerate(data)], "project string, trace string, wn double")
    out = filters.lowpass_by(s, prm, min_chunk=40, segment=4)
    for k, (t, y) in enumerate(data.items()):
        ref = filters.filtfilt_reference(y, 0.01 * (k + 1))
        assert np.abs(np.array(_ys(out, t)) - ref).max() < 1e-9 * max(1.0, np.abs(ref).max()), t
    rows = [("p", 1, "n", i, float(i), None if i == 900 else 1.0, "TIME") for i in range(2000)]
    got = filters.lowpass_by(s.unionByName(spark.createDataFrame(rows, SIG)), prm.union(
        spark.createDataFrame([("p", "n", 0.1)], prm.schema)), min_chunk=40, segment=4)
    assert _ys(got, "n") == [None] * 2000 and None not in _ys(got, "t1999")
    with pytest.raises(Exception, match="more than 33 samples"):
        short = _sig(spark, {"t40": data["t1999"], "t41": np.ones(20)})
        filters.lowpass_by(short, prm, min_chunk=40, segment=4).collect()


@pytest.mark.parametrize("lo, hi, top", [(0, 0, 0), (3, 200, 2), (8, 63, 3), (5, 8, 1), (0, 511, 3), (63, 64, 2), (1, 4000, 1)])
def test_cover_is_exact(lo, hi, top):
    got = [b for level, v in filters.cover(lo, hi, top) for b in range(v * filters.FAN ** level, (v + 1) * filters.FAN ** level)]
    assert sorted(got) == list(range(lo, hi + 1))
    if hi - lo < filters.FAN ** (top + 1):
        assert len(filters.cover(lo, hi, top)) <= 2 * filters.FAN * (top + 1)


def test_savgol_of_many_tiny_blocks(spark):
    """A 3 % window on 20,000 blocks: 600 whole blocks in every window, by a
    tree of moments; nulls and both ends stay exact."""
    rng = np.random.default_rng(9)
    n, size = 80_000, 4
    y = rng.normal(size=n) + 3.0
    s = _sig(spark, {"w": y})
    prm = spark.createDataFrame([("p", "w", "3 %", 3)], "project string, trace string, window_length string, polyorder int")
    got = np.array(_ys(filters.savgol(s, prm, min_chunk=size)))
    assert np.abs(got - filters.savgol_reference(y, 2400, 3)).max() < 1e-9
    z = [None if i in (0, 40_000) else float(v) for i, v in enumerate(y)]
    d = spark.createDataFrame([("p", 1, "w", i, float(i), v, "TIME") for i, v in enumerate(z)], SIG)
    got = _ys(filters.savgol(d, prm, min_chunk=size))
    gone = {i for i in range(n) if i <= 1199 or 40_000 - 1200 <= i <= 40_000 + 1199}
    assert {i for i, v in enumerate(got) if v is None} == gone


@pytest.mark.parametrize("bundle, chunk", [(64, 50), (1 << 20, 1 << 16), (7, 1000)])
def test_spectrum_on_array_pieces(spark, bundle, chunk):
    """The kernels of both long paths, pieces of every shape, against numpy."""
    rng = np.random.default_rng(3)
    for n in (64, 60, 63, 97, 2 * 53, 1000, 1009, 121):
        y = rng.normal(size=n) + 2
        want = np.abs(np.fft.rfft(y))[1:n // 2]
        for own in (True, False):
            a = spectrum.split_factor(n)
            bits = (2 * n - 2).bit_length()
            dims = (n // a, a) if own else (1 << (bits // 2), 1 << (bits - bits // 2))
            head = {"project": "p", "version": 1, "trace": "t", "size_n": n, "size_a": dims[0], "size_b": dims[1]}
            rows = [p for b in range(0, n, chunk) for p in spectrum._cut({**head, "block": b // chunk, "y": y[b:b + chunk]}, bundle, chunk)]
            steps = (spectrum._columns, spectrum._bins) if own else (spectrum._chirp_columns, spectrum._chirp_rows, spectrum._chirp_bins)
            for fn in steps:
                groups = {}
                for r in rows:
                    groups.setdefault(r["bundle"], []).append(r)
                rows = [o for g in sorted(groups) for o in fn(sorted(groups[g], key=lambda r: r["col"]), bundle)]
            got = np.full(n // 2 - 1, np.nan)
            for r in rows:
                assert np.isnan(got[r["k"] - 1]).all()  # each bin once
                got[r["k"] - 1] = r["mag"]
            assert np.abs(got - want).max() < 1e-9 * want.max(), (n, own)


def test_statistics_and_triggers_from_blocks(spark):
    """Block statistics merge to what the samples give, also far from zero,
    with nulls, under a negative scale, and without any value."""
    from wavespark.operators.signal import trigger_index
    rng = np.random.default_rng(12)
    rows = [("p", 1, "a", i, float(v)) for i, v in enumerate(rng.normal(size=1000) + 1e8)]
    rows += [("p", 1, "b", i, None if i % 3 else float(i)) for i in range(500)]
    rows += [("p", 2, "none", i, None) for i in range(5)] + [("p", 2, "one", 0, 4.0)]
    rows += [("p", v, "TRIGGER", i, 1.0 if i >= at else 0.0) for v, at, n in ((1, 150, 400), (2, 0, 2), (3, 0, 300), (4, 999, 70)) for i in range(n)]
    smp = spark.createDataFrame(rows, "project string, version int, trace string, i long, y_raw double")
    reg = spark.createDataFrame([("p", "a", -2.0, 3.0), ("p", "b", 0.5, -1.0)], "project string, trace string, y_scale double, y_offset double")
    scaled = smp.join(reg, ["project", "trace"], "left").withColumn(
        "y", F.coalesce("y_scale", F.lit(1.0)) * F.col("y_raw") + F.coalesce("y_offset", F.lit(0.0)))
    blocks = stats.block_stats(smp, 64)
    want = {(r.version, r.trace): r for r in stats.trace_stats(scaled).collect()}
    got = stats.stats_of_blocks(blocks, reg).collect()
    assert len(got) == len(want)
    for r in got:
        for c in ("n", *stats.STAT_FUNCTIONS):
            a, b = r[c], want[r.version, r.trace][c]
            assert a == b or abs(a - b) <= 1e-7 * max(1, abs(b)), (r, c)
    assert {(r.version, r.t0_index) for r in stats.trigger_of_blocks(blocks).collect()} == {
        (r.version, r.t0_index) for r in trigger_index(smp).collect()}
